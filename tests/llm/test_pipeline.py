"""The pipeline from end to end, and its stages on awkward rows."""

import re

import numpy as np
import pytest

from tapewise.llm import ngram_join, pieces, quality, secrets_scan

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _quality double, _text string, row string, _k1 int, _words string, component string, slice int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.5, "x", "y", 1, "z", "c", 3) for i, t, s in rows], COLUMNS)


LONG = " ".join(f"word{i * i % 9973}" for i in range(60_000))
ROWS = [(1, "a b c d e f", "s"), (2, None, None), (3, "", "s"), (4, LONG, "t"), (5, "a b c d e f", None), (5, "g h i j k l m", "t"), (5, "g h i j k l m", "t"), (None, "x y z", "s"), (None, "x y z", "s"), (6, "long" * 20_000, "t")]


def test_stages_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, none = table(spark, ROWS), table(spark, [])
    for _, stage in p.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
    kept = p.keep_quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and set(map(tuple, kept.collect())) <= set(map(tuple, docs.collect()))
    once = p.keep_one_of_similar(spark, docs, "")
    assert once.columns == docs.columns
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:9], r["_words"]) for r in once.collect()) == sorted((str(i), (t or "")[:9], "z") for i, t, _ in [*ROWS[:4], ROWS[5], *ROWS[7:]])
    clean = p.redact_secrets(spark, docs, "")
    assert sorted(map(str, map(tuple, clean.collect()))) == sorted(map(str, map(tuple, docs.collect())))
    mixed = p.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        assert r["_words"] == "z" and r["_k1"] == 1 and r["n_chars"] == len(r["text"])
        whole = [t for i, t, s in ROWS if (i, s) == (r["doc_id"], r["source"])]
        assert any(set(r["text"].split()) <= set((t or "").split()) for t in whole)
    assert all(r["lossless"] for r in p.encode(spark, docs, "").collect()) and p.encode(spark, docs, "").count() == len(ROWS)


def test_the_same_row_in_two_sources_keeps_both(spark):
    from tapewise.llm import mixing

    text = "a b c d e f g h"
    rows = spark.createDataFrame([(1, text, "s", "en"), (1, text, "t", "fr"), (1, text, "t", "de"), (1, text, "t", "de")], "doc_id long, text string, source string, lang string")
    placed, slots = mixing.mix(rows)
    assert placed.count() == 4 and {r["source"]: r["blocks"] for r in placed.collect()} == {"s": 1, "t": 1}
    got = mixing.mixed_documents(rows, weights=(1.0,)).collect()
    assert {(r["source"], r["lang"]) for r in got} == {("s", "en"), ("t", "fr"), ("t", "de")}


def test_run_equals_its_stages_by_brute_force(spark, tmp_path):
    """Every stage's decision, taken again in plain Python over the whole of a small table."""
    import corpus_pipeline as p

    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = p.run(spark, str(tmp_path)).collect()
    assert got and all(r["lossless"] and r["n_pieces"] == len(r["pieces"]) for r in got)
    net = quality.train(docs, labels)
    good = [r for r in rows if net.probabilities(np.frombuffer((r[1] or "").encode(), np.uint8), np.array([0, len((r[1] or "").encode())]))[0] >= 0.5]
    sets = [ngram_join.shingle_sets(np.frombuffer((r[1] or "").encode(), np.uint8), np.array([0, len((r[1] or "").encode())]), 5)[0] for r in good]
    root = list(range(len(good)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(good)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(good):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    one = [r for i, r in enumerate(good) if r[0] == least[find(i)]]
    ids = {r["doc_id"] for r in got}
    assert ids <= {r[0] for r in one}
    # what the mix shows of a document are its words, without the secrets
    scanner = secrets_scan.train(spark.createDataFrame(one, "doc_id long, text string, lang string, source string, n_chars long"))
    decode = pieces.Decoder(pieces.load())
    by_id = {r[0]: r[1] for r in one}
    for r in got:
        text = decode(np.array(r["pieces"]), np.array([0, len(r["pieces"])]))[0].tobytes().decode()
        words = set(re.findall(r"[^\x20\x09-\x0D]+", by_id[r["doc_id"]]))
        assert all(w in words or "[SECRET]" in w for w in re.findall(r"[^\x20\x09-\x0D]+", text))
        assert not secrets_scan.base_spans(text)
    assert min(scanner.thresholds) > 0
