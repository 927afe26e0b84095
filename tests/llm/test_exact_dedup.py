import hashlib
import random
import re

from corpus_cases import got, rows, tables  # noqa: F401  (fixtures)
from hypothesis import given, settings
from hypothesis import strategies as st

from ruleweave.llm import exact_dedup as x


def brute(rows):
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(k)
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda k: (-len(rows[k][1] or ""), rows[k][0] is None, rows[k][0] or 0))
        for k in members:
            out.append((rows[k][0], rows[best][0], len(members), k == best, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


COLS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_against_brute_force(tables, rows):
    assert got(x.exact_dedup(tables[0]), *COLS) == brute(rows)


def test_long_common_prefixes(spark, tmp_path):
    """Texts that part after the first blocks, end at block ends, or never part."""
    rnd = random.Random(4)
    base = "".join(rnd.choice("abcdé") for _ in range(300_000))
    rows = [(i, base[:n] + tail) for i, (n, tail) in enumerate(
        (n, tail) for n in (0, 63, 64, 65, 1024, 16_384, 262_144, 280_000) for tail in ("", "", "x", "y", " x"))]
    rows += [(500 + i, "same") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    assert got(x.exact_dedup(spark.read.parquet(str(tmp_path / "d"))), *COLS) == brute(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=30))
def test_local_radix(texts):
    groups = sorted(sorted(g) for g in x._radix(texts, list(range(len(texts))), 0, 2)) if texts else []
    want = {}
    for i, t in enumerate(texts):
        want.setdefault(t, []).append(i)
    assert groups == sorted(want.values())


def test_empty(tables):
    assert got(x.exact_dedup(tables[1])) == []
