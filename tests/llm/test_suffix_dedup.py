import collections
import hashlib

import numpy as np
import pytest
from corpus_cases import got, rows, tables  # noqa: F401  (fixtures)
from hypothesis import given, settings
from hypothesis import strategies as st

from ruleweave.llm import suffix_array, suffix_dedup


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=120), st.integers(0, 60))
def test_suffix_array(body, again):
    body = body + body[:again]
    text = np.array(body, np.uint8)
    raw = text.tobytes()
    sa = suffix_array.suffix_array(text)
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    plcp, phi = suffix_array.permuted_lcp(text, sa)
    for i in range(len(raw)):
        n = 0
        while phi[i] >= 0 and max(i, phi[i]) + n < len(raw) and raw[i + n] == raw[phi[i] + n]:
            n += 1
        assert plcp[i] == n


def brute(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, texts):
        spans = suffix_dedup.union([(i, i + length) for i in range(len(t) - length + 1) if seen[t[i:i + length]] > 1])
        out.append((r[0], len(t), sum(b - a for a, b in spans), len(spans),
                    hashlib.sha256(suffix_dedup.kept_parts(t, spans)).hexdigest()))
    return sorted(out, key=repr)


# few contexts a group: the windows of large groups are counted one by one
@pytest.mark.parametrize("length,gram,group,shard", [(400, 160, 2000, 3 << 20), (60, 24, 2000, 2000), (40, 16, 2, 2000)])
def test_against_brute_force(tables, rows, length, gram, group, shard):
    out = suffix_dedup.remove_repeats(tables[0], length, gram, shard, group)
    assert got(out) == brute(rows, length)


def test_anchors_of_equal_windows():
    rng = np.random.default_rng(3)
    shared = rng.integers(97, 100, 700).astype(np.uint8)
    found = []
    for n in (0, 513, 90):
        data = np.concatenate([rng.integers(97, 123, n).astype(np.uint8), shared, rng.integers(97, 123, 50).astype(np.uint8)])
        key, first, end = suffix_dedup.anchors(data)
        per_window = np.repeat(key, end - first)
        assert len(per_window) == len(data) - 399
        found.append(per_window[n:n + 301].tolist())
    assert found[0] == found[1] == found[2]


def test_empty(tables):
    assert got(suffix_dedup.remove_repeats(tables[1])) == []
