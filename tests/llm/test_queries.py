"""The registered queries on a folder of tables: columns, digests and hold-outs by plain Python, and empty tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from tapewise.llm import registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = {
    "op1_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op6_topk_join": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op7_secrets_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op8_ngram_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op9_learned_index": "query_id bigint, rank int, vec_id bigint, score double",
    "op10_quality": "doc_id bigint, held_out boolean, score double, predicted int",
}
TABLES = ("documents", "labels", "embeddings", "conversations")
AWKWARD = [(10_001, None, None), (10_002, "", "s"), (10_003, "one word", "s"), (10_003, "one word", "s"), (10_004, "token = a1b2c3d4 AKIA" + "Z9" * 10 + " " + "0f" * 20, "s")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables with awkward rows and, beside them, the same tables without rows."""
    base = tmp_path_factory.mktemp("tables")
    for name in TABLES:
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "documents":
            rows = rows.unionByName(spark.createDataFrame([(i, t, s) for i, t, s in AWKWARD], "doc_id long, text string, source string"), allowMissingColumns=True)
            rows = rows.selectExpr("*", "0 AS size", "'x' AS score", "'y' AS spans")  # names of results
        rows.write.parquet(str(base / "some" / f"{name}.parquet"))
        rows.limit(0).write.parquet(str(base / "none" / f"{name}.parquet"))
    return base


def texts(spark, folder):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in spark.read.parquet(str(folder / "some" / "documents.parquet")).collect()]


def rows(spark, folder, name):
    got = registry.QUERIES[name](spark, str(folder / "some"))
    want = COLUMNS[name].split(", ")
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema][: len(want)] == want
    return got.collect()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, folder, name):
    assert registry.QUERIES[name](spark, str(folder / "none")).count() == 0


def test_mixing_query(spark, folder):
    docs, got = texts(spark, folder), rows(spark, folder, "op1_mixing")
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, len(WORD.findall(t))) for i, t, _ in docs)
    total = sum(r["size"] for r in got)
    of = {s: sum(len(WORD.findall(t)) for _, t, x in docs if x == s) for _, _, s in docs}
    level, order = {}, sorted(of, key=lambda s: (s is None, s or ""))
    weights, left, free = {s: 1.0 + k % 3 for k, s in enumerate(order)}, float(total), set(of)
    while free:  # what is above three times a source goes to the others by weight
        share = left / sum(weights[s] for s in free)
        above = {s for s in free if share * weights[s] > 3 * of[s]}
        level |= {s: 3.0 * of[s] if above else share * weights[s] for s in above or free}
        left -= sum(level[s] for s in above)
        free -= above or free
    source = {i: s for i, _, s in docs}
    assert all(r["source_size"] == of[source[r["doc_id"]]] and r["target"] == pytest.approx(level[source[r["doc_id"]]]) and 0 <= r["taken"] <= 3 * r["size"] for r in got)


@pytest.mark.parametrize(("name", "modulus", "rest", "at"), [("op4_toxicity", 4, 2, 0.3), ("op10_quality", 3, 1, 0.5)])
def test_classifier_queries(spark, folder, name, modulus, rest, at):
    got = rows(spark, folder, name)
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _, _ in texts(spark, folder))
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= at)


def test_substring_query(spark, folder):
    docs = {i: WORD.findall(t) for i, t, _ in texts(spark, folder)}
    first = {}
    for i in sorted(docs):
        for k in range(len(docs[i]) - 12):
            first.setdefault(tuple(docs[i][k : k + 13]), i)
    for r in rows(spark, folder, "op5_substring_dedup"):
        words = docs[r["doc_id"]]
        gone = {k + j for k in range(len(words) - 12) if first[tuple(words[k : k + 13])] < r["doc_id"] for j in range(13)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_secrets_query(spark, folder):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    docs = sorted((i, t) for i, t, _ in texts(spark, folder))
    got = sorted(rows(spark, folder, "op7_secrets_scan"), key=lambda r: r["doc_id"])
    assert len(got) == len(docs)
    for (i, text), r in zip(docs, got):
        base = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        base += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        base += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        said = [f"{k}:{a}:{b}" for a, _, k, b in sorted(base)]
        assert r["doc_id"] == i and [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _, _ in base) for n in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest() and set(said) <= set(r["spans"].split(","))
    assert got[-1]["n_access"] == got[-1]["n_hex"] == got[-1]["n_assign"] == 1


def test_ngram_query(spark, folder):
    lower = {c: chr(c + 32) for c in range(65, 91)}
    words = {i: WORD.findall(t.translate(lower)) for i, t, _ in texts(spark, folder)}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in sets}
    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    got = rows(spark, folder, "op8_ngram_join")
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, len(s), root[i]) for i, s in sets.items()}


@pytest.mark.parametrize(("name", "step", "k", "recall"), [("op6_topk_join", 100, 10, 1.0), ("op9_learned_index", 20, 20, 0.9)])
def test_vector_queries(spark, folder, name, step, k, recall):
    table = spark.read.parquet(str(folder / "some" / "embeddings.parquet")).collect()
    ids = np.array([r["vec_id"] for r in table])
    vectors = np.array([[float(x) for x in r["embedding"]] for r in table])
    if name == "op6_topk_join":
        vectors = np.floor(1024 * vectors)
    scores, hit, want = vectors @ vectors.T, 0, 0
    got = rows(spark, folder, name)
    assert {r["query_id"] for r in got} == {int(i) for i in ids if i % step == 0}
    for q in {r["query_id"] for r in got}:
        at = int(np.flatnonzero(ids == q)[0])
        best = [j for j in np.lexsort((ids, -scores[at])) if j != at][:k]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, len(best) + 1))
        assert all(s == pytest.approx(scores[at][np.flatnonzero(ids == v)[0]], abs=1e-9) for _, v, s in mine)
        hit, want = hit + len({v for _, v, _ in mine} & {int(ids[j]) for j in best}), want + len(best)
    assert hit >= recall * want
