import zlib

import numpy as np
import pytest
from corpus_cases import got, rows, sentences, tables  # noqa: F401  (fixtures)

from ruleweave.llm import language_id as g


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    scores, trans = rng.random((5, 3)) + 0.1, rng.random((3, 3)) + 0.1
    marginals, pairs = g.forward_backward(scores, np.array([0]), np.array([5]), trans)
    total, want, want_pairs = 0.0, np.zeros((5, 3)), np.zeros((3, 3))
    for path in np.ndindex(3, 3, 3, 3, 3):
        p = np.prod([scores[t, path[t]] for t in range(5)]) * np.prod([trans[path[t], path[t + 1]] for t in range(4)])
        total += p
        for t in range(5):
            want[t, path[t]] += p
        for t in range(4):
            want_pairs[path[t], path[t + 1]] += p
    assert np.allclose(marginals, want / total) and np.allclose(pairs, want_pairs / total)
    sums = g._marginals(scores, np.array([0, 3]), np.array([3, 2]), trans)
    one, _ = g.forward_backward(scores[:3], np.array([0]), np.array([3]), trans)
    two, _ = g.forward_backward(scores[3:], np.array([0]), np.array([2]), trans)
    assert np.allclose(sums, [one.sum(0), two.sum(0)])


def test_held_out_accuracy(spark):
    out = g.op7_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in out if r["held_out"] and lang[r["doc_id"]]]
    assert len(out) == len(lang) and len(held) > 200
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97


def test_awkward_rows(tables, rows):
    out = g.language_id(tables[0])
    langs = {"en", "de", "fr"}
    for r in out.collect():
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in langs | {"und"}
    und = sorted(((r[0]) for r in rows if not r[1] or not any(map(str.isalpha, r[1]))), key=repr)
    assert sorted((r["doc_id"] for r in out.collect() if r["lang_pred"] == "und"), key=repr) == und
    assert got(out, "doc_id") == sorted(((r[0],) for r in rows), key=repr)


def test_code_switching(tables):
    """Words of one text get different labels."""
    import random
    model, rnd = g.fit(tables[0]), random.Random(8)
    words = (sentences(rnd, "en", 30) + " " + sentences(rnd, "de", 30)).split()
    e = g._emissions(words, model["weights"], model["lexicon"])
    marginals, _ = g.forward_backward(np.exp(e - e.max(1, keepdims=True)), np.array([0]), np.array([60]), model["trans"])
    said = [model["langs"][i] for i in marginals.argmax(1)]
    assert said[:25].count("en") > 20 and said[35:].count("de") > 20


def test_empty_and_unlabelled(tables):
    assert got(g.language_id(tables[1])) == []
    blank = tables[0].withColumn("lang", tables[0]["lang"].substr(100, 1)).where("doc_id < 5")
    none = g.language_id(blank.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {(r["lang_pred"], r["score"]) for r in none.collect()} == {("und", 0.0)}
    assert g.train([]) is None


@pytest.mark.parametrize("word", ["", "...", "ß", "x" * 500])
def test_features(word):
    assert all(0 <= x < g.FEATURES for x in g.word_features(word, {}))
