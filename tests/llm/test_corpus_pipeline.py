import re
from collections import Counter

import __spark_entry__
import corpus_pipeline as c
from corpus_cases import got, rows, tables  # noqa: F401  (fixtures)
from test_exact_dedup import brute as exact_brute
from test_ngram_join import brute as near_brute

from ruleweave.llm.common import staged

DOCS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain(df):
    return [tuple(r[x] for x in DOCS) for r in df.collect()]


def test_stages_against_brute_force(spark, tables):
    """Each stage on its own input."""
    docs = tables[0]
    one = staged(c.language_stage(spark, docs, ""), "t")
    assert one.columns == docs.columns
    kept, before = Counter(plain(one)), Counter(plain(docs))
    assert not kept - before
    assert all(any(map(str.isalpha, r[1])) for r in kept) and sum(kept.values()) >= sum(
        n for r, n in before.items() if r[1] and len(re.findall(r"[^\W\d_]+", r[1])) > 20)

    two = staged(c.exact_stage(spark, one, ""), "t")
    assert two.columns == docs.columns
    assert sorted((r[0] for r in plain(two)), key=repr) == sorted((r[0] for r in exact_brute(plain(one)) if r[3]), key=repr)

    three = staged(c.near_stage(spark, two, ""), "t")
    assert three.columns == docs.columns
    rows = plain(two)
    group = {r[0]: r[2] for r in near_brute(rows, c.NEAR_WORDS, c.NEAR_NUM, c.NEAR_DEN)}
    best = {}
    for r in rows:
        key = group[r[0]] if r[0] is not None else ("none", r[1])
        best[key] = min(best.get(key, r), r, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))
    assert sorted(plain(three), key=repr) == sorted(best.values(), key=repr)

    four = staged(c.mix_stage(spark, three, ""), "t")
    assert four.columns == docs.columns
    taken = Counter()
    for r in c.mixing.mix(three).collect():
        taken[r["doc_id"]] += int(r["taken"] / r["size"] + 0.5) if r["size"] else 0
    assert Counter(r[0] for r in plain(four)) == +taken

    five = c.encode_stage(spark, four, "")
    assert got(five, "doc_id") == sorted(((r[0],) for r in plain(four)), key=repr)
    assert all(r["lossless"] for r in five.collect())


def test_clashing_names(spark, tables):
    """Columns with the names of the pipeline's own don't matter to any stage."""
    own = ["__path", "__index", "__file", "_metadata", "__copy", "__text", "rid", "id", "times", "nth", "key1"]
    docs = staged(tables[0].select(*DOCS).withColumns({n: c.F.lit("x") for n in own}), "clash")
    for name, stage in c.STAGES[:-1]:
        columns, rows = docs.columns, docs.count()
        docs = staged(stage(spark, docs, ""), "t")
        assert docs.columns == columns and 0 < docs.count() <= 3 * rows, name
        assert docs.where(" AND ".join(f"`{n}` = 'x'" for n in own)).count() == docs.count()


def test_least_score():
    assert c.least_score(None) == 0 == c.least_score({"langs": ["en"]})
    assert c.least_score({"langs": ["de", "en"]}) == 0.55 and 0.01 < c.least_score({"langs": ["x"] * 100}) < 0.11


def test_empty(spark, tables):
    docs = tables[1]
    for _, stage in c.STAGES:
        docs = staged(stage(spark, docs, ""), "t")
        assert docs.count() == 0


def test_registered():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert {int(x[2:].split("_")[0]) for x in q if x.startswith("op")} == set(range(1, 14)) and "pipeline" in q
    assert "op9_exact_dedup" in o and set(o) <= set(q)
    assert [n for n, _ in c.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
