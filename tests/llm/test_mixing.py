import re
from collections import Counter

import pytest
from corpus_cases import got, rows, tables  # noqa: F401  (fixtures)

from ruleweave.llm import mixing as m


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_targets():
    assert m.targets([100, 100], [1, 1]) == [100, 100]
    assert m.targets([10, 100, 100], [5, 1, 1]) == [30, 90, 90]
    assert m.targets([0, 10], [1, 1]) == [0, 10]
    assert m.targets([], []) == []
    # what one source can't take may push another one over its limit
    got_ = m.targets([1, 20, 300], [10, 10, 1])
    assert got_ == [3, 60, 258]


def cost(cells, distinct, flows):
    total = 0
    for p, u in distinct.items():
        taken, price = sum(f for (q, _), f in flows.items() if q == p), 0
        while taken > 0 and u:
            total += price * min(u, taken)
            taken, price = taken - u, price + 1
    return total


def test_route_is_cheapest():
    """Against every split of a small case."""
    cells = {("0", 0): 4, ("1", 1): 3, ("0,1", 0): 3, ("0,1", 1): 3}
    distinct = {"0": 4, "1": 3, "0,1": 3}
    for quotas in ([5, 5], [9, 2], [12, 8], [0, 10], [21, 18]):
        flows = m.route(cells, distinct, quotas)
        assert [sum(f for (_, s), f in flows.items() if s == k) for k in (0, 1)] == quotas
        assert all(0 <= f <= 3 * cells[c] for c, f in flows.items())
        best = min(cost(cells, distinct, {("0", 0): quotas[0] - a, ("0,1", 0): a, ("1", 1): quotas[1] - b, ("0,1", 1): b})
                   for a in range(min(9, quotas[0]) + 1) for b in range(min(9, quotas[1]) + 1)
                   if quotas[0] - a <= 12 and quotas[1] - b <= 9)
        assert cost(cells, distinct, flows) == best


def test_route_of_many_passes_is_cheapest():
    """Beyond eight passes: few distinct words with many copies beside many words,
    against every split."""
    cells = {("0", 0): 6, ("0,1", 0): 20, ("0,1", 1): 20, ("1", 1): 4}
    for distinct in ({"0": 6, "0,1": 1, "1": 1}, {"0": 1, "0,1": 2, "1": 4}):
        for quotas in ([40, 50], [30, 5], [78, 72], [20, 61]):
            flows = m.route(cells, distinct, quotas)
            assert [sum(f for (_, s), f in flows.items() if s == k) for k in (0, 1)] == quotas
            best = min(cost(cells, distinct, {("0", 0): a, ("0,1", 0): quotas[0] - a, ("1", 1): b, ("0,1", 1): quotas[1] - b})
                       for a in range(min(18, quotas[0]) + 1) for b in range(min(12, quotas[1]) + 1)
                       if quotas[0] - a <= 60 and quotas[1] - b <= 60)
            assert cost(cells, distinct, flows) == best


def test_route_of_many_patterns():
    """Beyond 4,096 patterns: all of them enter, none is used twice while another
    one that serves the same sources is unused."""
    n = 5000
    names = [f"p{i}" for i in range(n)]
    cells = {(p, s): 2 for i, p in enumerate(names) for s in (i % 7, 7 + i % 3)}
    distinct = dict.fromkeys(names, 2)
    sizes = [sum(w for (_, s), w in cells.items() if s == k) for k in range(10)]
    flows = m.route(cells, distinct, [size // 2 for size in sizes])
    assert [sum(f for (_, s), f in flows.items() if s == k) for k in range(10)] == [s // 2 for s in sizes]
    taken = Counter()
    for (p, _), f in flows.items():
        taken[p] += f
    assert max(taken.values()) == 2   # half of either side: every text once


def test_many_copies_and_sources(spark):
    """A text of 300 copies in two of 5,000 sources; blocks of a few rows."""
    data = [(i, f"w{i} x", f"s{i:05d}") for i in range(5000)] + [
        (10000 + i, "hot text here", f"s{i % 2:05d}") for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    out = m.mix(docs).collect()
    taken, target = Counter(), {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert len(out) == 5300 and len(target) == 5000
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_blocks_and_shuffled_joins_agree(tables, monkeypatch):
    """Small blocks deal other documents, but the same words to every source."""
    def words_of(out):
        total = Counter()
        for r in out.collect():
            total[r["source"]] += r["taken"]
        return total
    want = words_of(m.mix(tables[0]))
    monkeypatch.setattr(m, "BLOCK_ROWS", 2)
    monkeypatch.setattr(m, "BROADCAST_ROWS", 0)
    assert words_of(m.mix(tables[0])) == want


def test_mix(tables, rows):
    out = m.mix(tables[0])
    a, b = got(out), got(m.mix(tables[0]))
    assert a == b   # reruns agree
    taken, size, target = Counter(), Counter(), {}
    for r in out.collect():
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        assert r["source_size"] == sum(words(x[1]) for x in rows if x[3] == r["source"])
    order = sorted(size, key=lambda x: (x is None, x or ""))
    want = m.targets([size[x] for x in order], [1 + i % 3 for i in range(len(order))])
    assert [target[x] for x in order] == pytest.approx(want)
    assert all(abs(taken[x] - target[x]) <= 1 for x in order)
    assert sorted(((r["doc_id"], r["size"]) for r in out.collect()), key=repr) == sorted(
        ((r[0], words(r[1])) for r in rows), key=repr)


def test_empty(tables):
    assert got(m.mix(tables[1])) == []
