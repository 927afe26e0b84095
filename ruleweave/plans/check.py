"""Compare each Spark query with its SQL oracle (row count, columns, values).

``python -m ruleweave.plans.check [sf_dir] [query ...]`` prints one line per
query.  DuckDB runs the oracle in this process over the same Parquet files.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()
    if hasattr(v, "item"):  # numpy scalar
        return _norm(v.item())
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    data = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)
    digest = hashlib.sha256(repr(data).encode()).hexdigest()
    return cols, data, digest


def duck_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir: str, names=None, verbose: bool = True) -> dict:
    from .oracle import oracle_sql
    from .queries import QUERIES
    sqls = oracle_sql()
    con = duck_connection(sf_dir)
    out = {}
    for name, fn in QUERIES.items():
        if names and name not in names:
            continue
        t0 = time.time()
        df = fn(spark, sf_dir)
        s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
        t1 = time.time()
        res = {"rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
        if name in sqls:
            cur = con.execute(sqls[name])
            o_cols = [d[0] for d in cur.description]
            o_rows = cur.fetchall()
            a, b = canonical(s_cols, s_rows), canonical(o_cols, o_rows)
            res.update(oracle_rows=len(o_rows), cols_match=a[0] == b[0], hash_match=a[2] == b[2])
            if verbose and not (a[0] == b[0] and a[2] == b[2]):
                res["spark_cols"], res["oracle_cols"] = a[0], b[0]
                sa, sb = set(a[1]), set(b[1])
                res["only_spark"] = sorted(sa - sb, key=repr)[:3]
                res["only_oracle"] = sorted(sb - sa, key=repr)[:3]
        out[name] = res
        if verbose:
            print(name, res, flush=True)
    return out


def main(argv):
    from ..session import get_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = set(argv[2:]) or None
    spark = get_session("local[8]", 8)
    res = compare(spark, sf_dir, names)
    bad = [n for n, r in res.items() if not r.get("hash_match", True)]
    print("MISMATCH:", bad if bad else "none")


if __name__ == "__main__":
    main(sys.argv)
