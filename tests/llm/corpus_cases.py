import random

import pytest

# names that operators use inside, as columns of the input
EXTRA = ["rid", "n", "key", "shard", "size", "head", "block", "gid", "score", "root", "s", "at", "lang_pred"]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          + ", ".join(f"`{c}` string" for c in EXTRA))


def sentences(rnd, lang, n):
    stems = {"en": ["the", "of", "thing", "ouring", "shtion", "wherly"], "de": ["der", "und", "lich", "schung", "keit", "zuver"],
             "fr": ["le", "eaux", "ère", "ment", "queille", "dévoi"]}[lang]
    words = ["".join(rnd.choice(stems) for _ in range(rnd.randint(1, 2))) for _ in range(n)]
    return " ".join(words)


def make_rows(seed=5):
    """Small documents with every awkward case: nulls in each column, empty and
    blank texts, a very long one, exact and near copies, repeated rows, ties."""
    rnd = random.Random(seed)
    texts = [(lang, sentences(rnd, lang, rnd.randint(30, 120))) for lang in ("en", "de", "fr") for _ in range(9)]
    rows = []
    for i, (lang, t) in enumerate(texts):
        rows.append((i, t, lang, f"src{i % 4}"))
    for i in range(12):   # copies, of the same and of other sources, some with other white space
        lang, t = texts[i % 5]
        rows.append((100 + i, t if i % 2 else t.replace(" ", "\n", 3) + "\t", lang, f"src{i % 3}"))
    for i in range(8):    # near copies
        lang, t = texts[6]
        w = t.split()
        w[rnd.randrange(len(w))] = f"changed{i}"
        rows.append((200 + i, " ".join(w), lang, "src1"))
    long_ = sentences(rnd, "en", 9000)
    rows += [(300, long_, "en", "src2"), (301, "x" * 30_000, "en", "src2"), (302, (texts[0][1] + "\n") * 4, "en", "src0"),
             (303, None, "en", "src0"), (304, "", None, "src1"), (305, " \n\t ", "de", None), (306, None, None, None),
             (307, "12 34 ?!", "en", "src3"), (None, texts[2][1], "en", "src0"), (None, "Only Here once", None, "src5"),
             (309, "One", "en", "src1"), (310, "one", "en", "src1"), (311, "▁ mark and \U0001F600 ▁▁", "en", "src1")]
    rows += [(2, texts[2][1], "en", "src2")] * 2 + [(303, None, "en", "src0")]   # repeated rows
    # a null in every other column, too
    return [(*r, None if k % 7 == 0 else len(r[1] or ""), *["clash" if k % 3 else None] * len(EXTRA))
            for k, r in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory, rows):
    """(documents, an empty table of the same columns), as scans."""
    out = []
    for name, data in (("full", rows), ("empty", [])):
        path = str(tmp_path_factory.mktemp("docs") / name)
        spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(path)
        out.append(spark.read.parquet(path))
    return tuple(out)


def got(df, *cols):
    """Rows as sorted tuples."""
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=repr)
