import collections
import math
import re

import pytest
import xxhash
from corpus_cases import got, rows, tables  # noqa: F401  (fixtures)

from ruleweave.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def buckets(text):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    out = [signed(x) % q.BUCKETS for x in h]
    for a, b in zip(h, h[1:]):
        # Spark hashes several columns one into the next
        first = xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)
        out.append(signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little"), first)) % q.BUCKETS)
    return out


def labels_of(spark):
    rows = [(i, 1, 0) for i in range(0, 20)] + [(2, 1, 0), (3, 0, 0), (4, 1, 1), (5, None, 0), (None, 1, 0), (300, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_against_brute_force(spark, tables, rows):
    out = q.judge_quality(tables[0], labels_of(spark)).collect()
    assert sorted((tuple(r[c] for c in COLS) for r in out), key=repr) == sorted(
        ((r[0], *base(r[1])) for r in rows), key=repr)

    trusted = {i for i in range(20)} - {3, 4, 5} | {300}
    raw, good = collections.Counter(), collections.Counter()
    for r in rows:
        b = buckets(r[1])
        raw.update(b)
        if r[0] in trusted:
            good.update(b)
    n_raw, n_good = sum(raw.values()) + q.BUCKETS, sum(good.values()) + q.BUCKETS
    score = {}
    for r in rows:
        b = buckets(r[1])
        score[r[0], r[1]] = sum(math.log((good[x] + 1) / n_good) - math.log((raw[x] + 1) / n_raw) for x in b) / max(len(b), 1)
    by_id = {(r[0], len(WORD.findall(r[1] or ""))): s for r in rows for s in [score[r[0], r[1]]]}
    for r in out:
        want = by_id[r["doc_id"], r["n_words"]]
        assert abs(r["llr"] - want) < 1e-9
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= q.THRESHOLD)


def test_no_labels_and_empty(spark, tables):
    none = labels_of(spark).limit(0)
    out = q.judge_quality(tables[0], none).collect()
    assert all(r["llr"] == 0 and r["kept"] != r["base_failed"] for r in out)
    assert got(q.judge_quality(tables[1], labels_of(spark))) == []


@pytest.mark.parametrize("length, glued_share", [(60, 0.1), (400, 0.03)])
def test_threshold_is_learned_from_all_trusted_documents(spark, length, glued_share):
    # some words of bad documents are glued to symbols.  The constant -0.2 keeps all the bad long
    # documents, and drops all clean ones of the short corpus, where add-one smoothing weighs most
    import random
    deal = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    text = lambda glued: " ".join(w + "###" * (deal.random() < glued) for w in deal.choices(words, k=length))
    docs = [(i, text(0)) for i in range(300)] + [(i, text(glued_share)) for i in range(300, 340)]
    labels = [(i, 1, 0) for i in range(0, 300, 2)] + [(i, 0, 0) for i in range(300, 320)]
    frames = (spark.createDataFrame(docs, "doc_id long, text string"),
              spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))

    trusted = {i for i, good, _ in labels if good}
    raw, good = collections.Counter(), collections.Counter()
    for i, t in docs:
        raw.update(buckets(t))
        if i in trusted:
            good.update(buckets(t))
    n_raw, n_good = sum(raw.values()) + q.BUCKETS, sum(good.values()) + q.BUCKETS

    def score(t, out):
        b = buckets(t)
        return sum(math.log((max(good[x] - out, 0) + 1) / n_good) - math.log((raw[x] + 1) / n_raw) for x in b) / len(b)
    ok = {i for i, t in docs if not base(t)[5]}
    held = sorted(score(t, 1) for i, t in docs if i in trusted & ok)
    want = min(math.floor(held[int(q.LOSS * len(held))] / q.STEP), 0) * q.STEP

    out = {r["doc_id"]: r for r in q.judge_quality(*frames, None).collect()}
    assert len(out) == len(docs)
    for i, t in docs:
        assert abs(out[i]["llr"] - score(t, 0)) < 1e-9
        assert out[i]["kept"] == (i in ok and out[i]["llr"] >= want)
    assert not any(out[i]["kept"] for i in range(300, 340))
    assert sum(out[i]["kept"] for i in ok if i < 300) >= 0.99 * len(ok & set(range(300)))


def test_learned_threshold_without_trusted_documents(spark, tables):
    out = q.judge_quality(tables[0], labels_of(spark).limit(0), None).collect()
    assert all(r["kept"] != r["base_failed"] for r in out)
    assert got(q.judge_quality(tables[1], labels_of(spark), None)) == []
