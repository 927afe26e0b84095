import hashlib
import random
import zlib
from collections import Counter

from corpus_cases import got, rows, tables  # noqa: F401  (fixtures)

from ruleweave.llm import sharding as s


def brute_capacity(weights, shards):
    """Smallest capacity by dynamic programming over contiguous parts."""
    total = [0]
    for w in weights:
        total.append(total[-1] + w)
    best = [total[i] for i in range(len(weights) + 1)]
    for _ in range(shards - 1):
        best = [min(max(best[j], total[i] - total[j]) for j in range(i + 1)) for i in range(len(weights) + 1)]
    return best[-1]


def test_smallest_capacity():
    rnd = random.Random(1)
    for _ in range(200):
        weights = [rnd.choice([1, 5, rnd.randint(1, 400)]) for _ in range(rnd.randint(1, 30))]
        items = [(f"{i:064x}", w, False) for i, w in enumerate(weights)]
        shards = rnd.randint(1, 9)
        assert s.smallest_capacity(items, shards) == brute_capacity(weights, shards)


def test_cuts_by_levels(spark):
    """Ranges are split until the cut is exact, also with a group that holds a third."""
    rnd = random.Random(2)
    for hot in (0, 30_000):
        weights = {hashlib.sha256(str(i).encode()).hexdigest(): rnd.randint(1, 300) for i in range(600)}
        if hot:
            weights["7f" * 32] = hot
        groups = spark.createDataFrame(list(weights.items()), "key string, weight long")
        cuts = s.minimax_cuts(groups, 8, 1)
        ordered = sorted(weights.items())
        loads = Counter(sum(k >= c for c in cuts) for k, w in ordered for _ in range(w))
        assert max(loads.values()) == brute_capacity([w for _, w in ordered], 8)


def test_law(tables, rows):
    out = s.minimax_shards(tables[0]).collect()
    texts = [(r[0], r[1]) for r in rows]
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32(t.encode()) if t is not None else None, "bytes", None)
                   for i, t in texts), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in out), key=repr) == want
    for shard in range(8):
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    # equal texts (told by size and crc here) share a shard, and the largest shard is as small as can be
    place = {}
    for r in out:
        assert place.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]
    weights = Counter()
    for _, t in texts:
        weights["0" * 64 if t is None else hashlib.sha256(t.encode()).hexdigest()] += len((t or "").encode()) + 1
    load = Counter()
    for r in out:
        load[r["shard"]] += r["size"]
    assert max(load.values()) == brute_capacity([w for _, w in sorted(weights.items())], 8)


def test_empty(tables):
    assert got(s.minimax_shards(tables[1])) == []
