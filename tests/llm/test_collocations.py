import random
import re
from collections import Counter

import pyarrow as pa
from corpus_cases import got, rows, tables  # noqa: F401  (fixtures)
from hypothesis import given, settings
from hypothesis import strategies as st

from ruleweave.llm import collocations as x

COLS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(docs, least, top):
    """Every n-gram of one to four words counted by itself."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            n[lang] += len(ws)
            f.update((lang, *ws[i:i + k]) for k in range(1, 5) for i in range(len(ws) - k + 1))
    frequent = {p: c for p, c in f.items() if c >= least and len(p) > 2}
    out = {}
    for (lang, *ws), a in frequent.items():
        cuts = [(2_000_000 * a // (f[lang, *ws[:k]] + f[lang, *ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        longer = [c for (other, *vs), c in frequent.items() if other == lang and len(vs) > len(ws)
                  and any(vs[s:s + len(ws)] == ws for s in range(len(vs) - len(ws) + 1))]
        if not any(100 * c >= 80 * a for c in longer):
            out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[lang, *ws[:k]], f[lang, *ws[k:]]))
    return sorted(((lang, r, p.decode(), -a, le, ri, n[lang], -s) for lang, best in out.items()
                   for r, (s, a, p, le, ri) in enumerate(sorted(best)[:top], 1)), key=repr)


def corpus(seed=2):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "été", "NEW", "new", "#x", "a b"]
    phrases = [rnd.choices(vocabulary, k=rnd.randint(2, 6)) for _ in range(30)]
    docs = []
    for i in range(150):
        words = []
        for _ in range(rnd.randint(0, 40)):
            words += rnd.choice(phrases) if rnd.random() < 0.6 else [rnd.choice(vocabulary)]
        text = "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "?! "]) for w in words)
        docs.append((rnd.choice(["en", "de", None, "und"]), text))
    return docs + [("en", None), (None, ""), ("en", " .,"), ("fr", "only here"), ("en", "the very same " * 900)] + [docs[0]] * 3


def run(spark, docs, least, top, **more):
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    return got(x.collocations(df, least, top, **more), *COLS)


def test_against_brute_force(spark):
    docs = corpus()
    want = brute(docs, 6, 10_000)
    assert run(spark, docs, 6, 10_000) == want
    assert len(want) > 150 and {len(r[2].split(" ")) for r in want} == {2, 3, 4}
    assert run(spark, docs, 6, 25) == brute(docs, 6, 25)


def test_slices_bitmaps_and_keys(spark, monkeypatch):
    """Small slices, bitmaps in which nearly all keys meet, and keys that collide
    at first change nothing."""
    docs = corpus(3)
    want = brute(docs, 5, 1000)
    monkeypatch.setattr(x, "SLICE_BYTES", 300)
    assert run(spark, docs, 5, 1000) == want
    full = lambda keys: keys.sparkSession.sparkContext.broadcast(x.np.full(x.BITMAP_BITS // 64 + 1, -1))
    monkeypatch.setattr(x, "_bitmap", full)
    assert run(spark, docs, 5, 1000) == want
    assert run(spark, docs, 5, 1000, masks=(15, x._FULL)) == want


def test_awkward_documents(tables, rows):
    docs = [(r[2], r[1]) for r in rows]
    assert got(x.collocations(tables[0], 4, 50), *COLS) == brute(docs, 4, 50)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é.\t\n\r!", max_size=14)), max_size=8), st.integers(0, 3))
def test_tokens(texts, skip):
    words, text, first = x.tokens(pa.array(["x y.", *texts], pa.string()).slice(min(skip, len(texts))))
    want = [(i, k == 0, w) for i, t in enumerate(["x y.", *texts][min(skip, len(texts)):])
            for p in pieces(t) for k, w in enumerate(p)]
    assert list(zip(text.tolist(), first.tolist(), words.to_pylist())) == want


def test_empty(tables):
    assert got(x.collocations(tables[1])) == []
