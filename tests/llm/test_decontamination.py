import random
import re
from collections import Counter

import pytest
from corpus_cases import got, rows, tables  # noqa: F401  (fixtures)

from ruleweave.llm import common
from ruleweave.llm import decontamination as x

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLS = ("doc_id", "n_words", "n_hit", "items", "near_items", "contaminated")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, slop=x.SLOP):
    """Every window at every place; near ones beside each occurrence of the
    window's rarest term."""
    docs = [(d, words(t)) for d, t in docs]
    count = Counter(w for _, ws in docs for w in ws)
    windows = {}
    for item, text in items:
        ws = words(text)
        for s in range(max(len(ws) - x.WINDOW, 0) + 1 if ws else 0):
            windows.setdefault(tuple(ws[s:s + x.WINDOW]), set()).add(item)
    out = []
    for d, ws in docs:
        at = {}
        for p, w in enumerate(ws):
            at.setdefault(w, []).append(p)
        hit, exact, near = set(), set(), set()
        for window, owners in windows.items():
            if any(w not in at for w in window):
                continue
            k = min(range(len(window)), key=lambda k: (count[window[k]], k))
            for p in at[window[k]]:
                away = max(min(abs(q - (p - k + j)) for q in at[w]) for j, w in enumerate(window))
                if away == 0:
                    hit.update(range(p - k, p - k + len(window)))
                    exact |= owners
                if away <= slop:
                    near |= owners
        out.append((d, len(ws), len(hit), sorted(exact - {None}), len(near - {None}), bool(hit)))
    return sorted(out, key=repr)


def cases():
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)] + ["ÉTÉ", "été", "Ünder", "naïve", "x1"]
    text = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    items = [(f"i{k}", text(rnd.randint(11, 40))) for k in range(20)]
    items += [("short", "w1 w2 w3"), ("one", "w7"), ("ten", text(10)), ("none", " .,! "), ("null", None), (None, text(12)),
              ("i3", text(14)), ("copy", items[0][1]), ("copy", items[0][1]), ("loop", "w9 w9 w9 w9 w9 w9 w9 w9 w9 w9 w9"), ("absent", "never " * 12)]
    docs = [(k, text(rnd.randint(0, 120))) for k in range(60)]
    for k, (_, t) in enumerate(items):
        if t and len(t.split()) >= 10:
            ws = t.split()
            s = rnd.randrange(len(ws) - 9)
            passage = ws[s:s + rnd.randint(9, 20)]
            docs.append((100 + k, f"{text(20)}, {'--'.join(passage).upper()} {text(9)}"))
            gap = passage[:5] + ["between"] + passage[5:]   # a proximity match
            docs.append((200 + k, " ".join(gap)))
            docs.append((300 + k, " ".join([*passage, *passage])))
    docs += [(400, None), (401, ""), (402, " ;; "), (403, "w9 " * 300), (404, text(6000)), (None, items[5][1]),
             (405, items[2][1]), (405, items[2][1]), (406, items[0][1].replace(" ", "\x00"))]
    return docs, items


@pytest.mark.parametrize("limit", [common.SMALL_ROWS, 0])   # terms and documents broadcast, or shuffled
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(x, "small", lambda rows: common.small(rows, limit))
    docs, items = cases()
    found = x.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                            spark.createDataFrame(items, "item_id string, text string"))
    want = brute(docs, items)
    assert got(found, *COLS) == want
    assert sum(r[2] > 0 for r in want) > 30


def test_proximity(spark):
    docs = [(1, "a0 a1 a2 a3 x a4 a5 a6 a7 a8 a9"), (2, "a0 a1 a2 a3 a4 a5 a6 a7 a8 a9"), (3, "a1 a0 a2 a3 a4 a5 a6 a7 a9 a8"),
            (4, "a0 a1 x x x a2 a3 a4 a5 a6 a7 a8 a9"), (5, "a0 a1 a2 a3 a4 a5 a6 a7 a8"), (6, "b")]
    items = [("it", "a0 a1 a2 a3 a4 a5 a6 a7 a8 a9")]
    spark_docs = spark.createDataFrame(docs, "doc_id long, text string")
    spark_items = spark.createDataFrame(items, "item_id string, text string")
    for slop in (0, 1, 2, 3):
        found = x.decontaminate(spark_docs, spark_items, slop=slop)
        assert got(found, *COLS) == brute(docs, items, slop)
    near = {slop: [r[0] for r in brute(docs, items, slop) if r[4]] for slop in (0, 1, 2, 3)}
    assert near == {0: [2], 1: [1, 2], 2: [1, 2, 3], 3: [1, 2, 3, 4]}


def test_awkward_documents(tables, rows, spark):
    items = [("a", rows[0][1]), ("b", rows[5][1][:60]), ("c", "one")]
    found = x.decontaminate(tables[0], spark.createDataFrame(items, "item_id string, text string"), slop=0)
    assert got(found, *COLS) == brute([r[:2] for r in rows], items, 0)


def test_empty(tables, spark):
    items = spark.createDataFrame([("a", "one two")], "item_id string, text string")
    assert got(x.decontaminate(tables[1], items)) == []
    none = x.decontaminate(tables[0], items.limit(0))
    assert {(r["n_hit"], r["contaminated"]) for r in none.collect()} == {(0, False)}
