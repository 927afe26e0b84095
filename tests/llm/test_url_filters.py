import re

from corpus_cases import got, rows, tables  # noqa: F401  (fixtures)

from ruleweave.llm import url_filters as u

LOWER = str.maketrans(u._UPPER, u._LOWER)


def base(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(LOWER)
    fits = [(h + p, said) for said, h, p in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None))


ODD = [None, "", "no scheme", "http://", "://", "HTTP://WWW.Example.NET/en/X", "http://example.net/enx", "http://net", "http://a.net?x=/",
       "http://a.net/?x", "https://fr.org/fr/", "https://x.org/FR/", "http://notexample.com/de/", "http://example.com/de/#a",
       "http://É.example.org/fr/ü?ö", "a://b://c.net/d", "http://a.b.example.net/en/ q", "http://" + "x" * 5000 + ".com/" + "y/" * 2000]


def test_rules_and_parts(spark, tmp_path):
    rows = [(i, x, "clash", "clash") for i, x in enumerate(ODD)] + [(None, "http://z.com/q", None, None), (3, "http://", "c", None)]
    spark.createDataFrame(rows, "page_id long, url string, host string, features string").write.parquet(str(tmp_path / "p"))
    out = u.judge_urls(spark.read.parquet(str(tmp_path / "p"))).collect()
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in out), key=repr) == sorted(
        ((r[0], *base(r[1])[:3]) for r in rows), key=repr)
    said = {r[0]: base(r[1])[3] for r in rows}
    assert all(r["verdict"] == (said[r["page_id"]] or r["verdict"]) and r["verdict"] in ("allow", "block") for r in out)


def test_whole_table_and_trees(spark):
    out = u.op8_url_filter(spark, "/root/testdata/sf0.01").collect()
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(out) == len(pages)
    for r in out:
        host, path, rule, said = base(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (said or ("block" if r["block_score"] > 0.5 else "allow"))


def test_trees_learn_the_labels(spark, tmp_path):
    """Without a rule for them, URLs like labelled ones get their verdict."""
    rows = [(i, f"http://site{i % 7}.net/a/{i}?a=1&b=2") for i in range(60)] + [
        (100 + i, f"https://good{i % 5}.org/fr/{i}") for i in range(60)]
    other = [(200 + i, f"https://good{i % 5}.org/es/{i}") for i in range(10)]
    spark.createDataFrame(rows + other, "page_id long, url string").write.parquet(str(tmp_path / "p"))
    out = {r["page_id"]: r["verdict"] for r in u.judge_urls(spark.read.parquet(str(tmp_path / "p"))).collect()}
    assert all(out[i] == "allow" for i, _ in other)


def test_one_kind_of_label_and_empty(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.com/x")], "page_id long, url string").write.parquet(path)
    assert {r["verdict"] for r in u.judge_urls(spark.read.parquet(path)).collect()} == {"block"}
    assert got(u.judge_urls(spark.read.parquet(path).limit(0))) == []
