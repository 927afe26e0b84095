import random
import re

import pytest
from corpus_cases import got, rows, tables  # noqa: F401  (fixtures)

from ruleweave.llm import components, ngram_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(rows, k):
    out = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOWER))
        out.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k
                   else frozenset([tuple(w)] if w else []))
    return out


def brute(rows, k, num, den):
    found, n = sets(rows, k), len(rows)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(n):
        for j in range(i):
            o = len(found[i] & found[j])
            if o and den * o >= num * (len(found[i]) + len(found[j]) - o):
                parent[root(i)] = root(j)
    ids = {}
    for i in range(n):
        if rows[i][0] is not None and found[i]:
            ids[root(i)] = min(ids.get(root(i), rows[i][0]), rows[i][0])
    return sorted(((r[0], len(found[i]), ids.get(root(i)) if found[i] else r[0]) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100), (2, 50, 100)])
def test_against_brute_force(tables, rows, k, num, den):
    out = ngram_join.jaccard_join(tables[0], k, num, den)
    assert got(out, "doc_id", "n_shingles", "component_id") == brute(rows, k, num, den)


def test_chain_of_links(spark, tmp_path):
    """Each text links with the next one only: the second round has to find
    what the star of the first one leaves apart."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[6 * i:6 * i + 150])) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "d"))
    out = ngram_join.jaccard_join(spark.read.parquet(str(tmp_path / "d")), 3, 90, 100)
    assert got(out, "doc_id", "n_shingles", "component_id") == brute(rows, 3, 90, 100)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_group_of_near_copies(spark, tmp_path, monkeypatch, seed):
    """Copies that are near, but seldom near enough to link, in any order of the
    rows: few pairs are formed, and each about once."""
    rnd = random.Random(11)
    base, vocabulary = [f"b{i}" for i in range(300)], [f"v{i}" for i in range(4000)]
    texts = [" ".join(rnd.choice(vocabulary) if rnd.random() < 0.04 else w for w in base) for _ in range(250)]
    rows = list(enumerate(texts))
    random.Random(seed).shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    formed = []
    pairs = ngram_join._open_pairs

    def counted(*args):
        formed.extend(map(tuple, pairs(*args).collect()))
        return pairs(*args)
    monkeypatch.setattr(ngram_join, "_open_pairs", counted)
    out = ngram_join.jaccard_join(spark.read.parquet(str(tmp_path / "d")), 3, 90, 100)
    assert got(out, "doc_id", "n_shingles", "component_id") == brute(sorted(rows), 3, 90, 100)
    assert len(formed) < 3 * len(rows) and len(formed) <= 2 * len(set(formed))


def test_empty(tables):
    assert got(ngram_join.jaccard_join(tables[1])) == []


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 3), (2, 1), (10, 11), (12, 11), (7, 9), (9, 8), (8, 6), (None, 4)]
    out = components.components(spark.createDataFrame(links, "a long, b long"))
    assert got(out) == sorted([(1, 1), (2, 1), (3, 1), (10, 10), (11, 10), (12, 10), (6, 6), (7, 6), (8, 6), (9, 6)], key=repr)
    assert got(components.components(spark.createDataFrame([], "a long, b long"))) == []
