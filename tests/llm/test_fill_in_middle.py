import hashlib
import random
import re

import pyarrow as pa
from corpus_cases import got, rows, tables  # noqa: F401  (fixtures)
from hypothesis import given, settings
from hypothesis import strategies as st

from ruleweave.llm import fill_in_middle as x

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    """One document by the definition, on a list of its units."""
    text = text or ""
    parts = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(parts)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text, text
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


COLS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")


def test_against_brute_force(tables, rows):
    assert got(x.restore(x.transform(tables[0])), *COLS) == sorted((brute(r[0], r[1]) for r in rows), key=repr)


def test_awkward_texts(spark):
    rnd = random.Random(3)
    alphabet = ["a", "é", "\U0001F600", "<", "P", "S", ">", "M", " ", "\n", " ", "\u0085", "\x00", "<P>", "<<", "<S"]
    rows = [(i, "".join(rnd.choices(alphabet, k=rnd.randint(0, 12)))) for i in range(1500)]
    rows += [(5000 + i, " word" * 40_000 + "\n") for i in range(6)] + [(None, "a b c"), (7000, None), (7001, "\t \n")] * 2
    back = x.restore(x.transform(spark.createDataFrame(rows, "doc_id long, text string")))
    result = got(back, *COLS)
    assert result == sorted((brute(*r) for r in rows), key=repr)
    assert {r[2] for r in result} == {"plain", "spm", "psm"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\x0bé <", max_size=12), max_size=8))
def test_units(texts):
    assert x.units(pa.array(texts, pa.string())).to_pylist() == [UNIT.findall(t) for t in texts]


def test_restore_keeps_other_columns(spark):
    given_ = x.transform(spark.createDataFrame([(1, "a b"), (2, "c <P> d")], "doc_id long, text string"))
    back = x.restore(given_.withColumnRenamed("n", "output size"))
    assert [r["restored"] for r in back.orderBy("doc_id").collect()] == ["a b", "c <P> d"]


def test_empty(tables):
    assert got(x.restore(x.transform(tables[1]))) == []
