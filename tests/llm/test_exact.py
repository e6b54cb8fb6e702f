"""Words that polynomial hashes mix up, common phrases, and work that must not grow with pairs."""

import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tapewise.llm import ngram_join, pieces, substring_dedup
from tapewise.llm.arrays import word_hashes
from tapewise.llm.training import joined


def morse(n):
    """Two words of n letters that polynomials modulo 2**64 cannot tell apart, whatever their base."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


ONE, OTHER = morse(2048)


def test_hashes_of_colliding_words():
    raw, offsets = joined([ONE.encode(), OTHER.encode(), ONE.encode(), b"", b"x", b"x\0", ("ab" * 3000).encode(), ("ab" * 2999 + "ba").encode()])
    for salt in (0, 1):
        h = word_hashes(raw, offsets[:-1], offsets[1:], salt).tolist()
        assert h[0] == h[2] and len(set(h)) == len(h) - 1
    # a word's hash does not depend on what stands around it
    assert word_hashes(np.frombuffer(b"zz" + ONE.encode() + b"q", np.uint8), np.array([2]), np.array([2050]))[0] == word_hashes(raw, offsets[:1], offsets[1:2])[0]


def test_colliding_words_in_operators(spark):
    text = lambda w: " ".join([*(f"x{i}" for i in range(6)), w, *(f"y{i}" for i in range(6))])
    docs = spark.createDataFrame([(1, text(ONE)), (2, text(OTHER)), (3, text(ONE)), (4, ONE), (5, OTHER)], "doc_id long, text string")
    removed = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup_substrings(docs).collect()}
    assert removed == {1: 0, 2: 0, 3: 13, 4: 0, 5: 0}
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.similar_documents(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    pytest.importorskip("sentencepiece")
    assert all(r["lossless"] for r in pieces.encode_texts(docs).collect())


def test_units_with_one_hash_are_encoded_again(monkeypatch, spark):
    pytest.importorskip("sentencepiece")
    true = pieces.word_hashes
    # under the first salt all units of four characters have one hash
    monkeypatch.setattr(pieces, "word_hashes", lambda raw, a, b, salt: np.where((b - a == 16) & (salt == 0), np.uint64(7), true(raw, a, b, salt)))
    vocab = pieces.load()
    raw, offsets = joined(["one two six ten".encode(), b"all fine here"])
    keys = np.arange(2).astype(np.uint64)
    ids, bounds = pieces.encode(raw, offsets, keys, vocab, 0.0)
    decode = pieces.Decoder(vocab)
    assert not pieces._equal_rows(raw, offsets, *decode(ids, bounds))[0]
    ids, bounds, good = pieces._again(raw, offsets, keys, 0, ids, bounds, vocab, decode, 0.0, 0)
    assert good and pieces._equal_rows(raw, offsets, *decode(ids, bounds))[0]


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def components(texts, least=0.8):
    """Smallest index reachable, by all pairs that share a shingle."""
    sets, where, root = [shingles(t) for t in texts], defaultdict(list), list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, s in enumerate(sets):
        for j in {j for g in s for j in where[g]}:
            if len(s & sets[j]) >= least * len(s | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            where[g].append(i)
    return [find(i) for i in range(len(texts))]


def run(spark, texts, **more):
    got = ngram_join.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **more)
    return [r["component_id"] for r in got.orderBy("doc_id").collect()]


def test_a_phrase_in_thousands_of_different_documents(spark, monkeypatch):
    """Pairs that trees look at grow with the documents, not with their square."""
    rng = random.Random(1)
    phrase = [f"p{i}" for i in range(40)]
    texts = [" ".join([*phrase, *(f"u{rng.randrange(10**9)}" for _ in range(rng.choice([6, 7, 8, 30])))]) for _ in range(5000)]
    looked = []
    true = ngram_join._tasks
    monkeypatch.setattr(ngram_join, "_tasks", lambda members, *a: (looked.append(members.count()), true(members, *a))[1])
    assert run(spark, texts) == list(range(5000))
    assert sum(looked) <= 2 * 5000


@pytest.mark.parametrize("block", [512, 20])
def test_templates_of_many_sizes(spark, monkeypatch, block):
    """Texts of common lines only: every feature is frequent, some texts are similar, groups are large."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    monkeypatch.setattr(ngram_join, "HOT", 8)
    rng = random.Random(2)
    lines = [" ".join(f"l{k}w{i}" for i in range(12)) for k in range(30)]
    texts = [" ".join(rng.sample(lines, rng.choice([2, 3, 8]))) for _ in range(150)]
    for _ in range(60):
        w = rng.choice(texts).split()
        w[rng.randrange(len(w))] = f"edit{rng.randrange(20)}"
        texts.append(" ".join(w))
    assert run(spark, texts) == components(texts)


def test_lower_thresholds(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 10)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.choice([3, 6, 9, 12]))) for _ in range(70)]
    assert run(spark, texts, threshold=Fraction(2, 5)) == components(texts, 0.4 - 1e-12)
