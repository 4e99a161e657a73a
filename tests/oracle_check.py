"""Run registered Spark queries next to their DuckDB oracle statements and compare results.

Mirrors the driver's check: same column names, same row count, same multiset of rows (columns sorted
by name, rows sorted). Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
ROOT = os.path.dirname(HERE)
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def duckdb_conn(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, repr(v))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return (1, repr([_norm(x) for x in v]))
    if isinstance(v, dict):
        return (1, repr(sorted((k, _norm(x)) for k, x in v.items())))
    return (1, repr(v))


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in records)


def compare(spark, name: str, sf_dir: str, sql: str, con=None) -> dict:
    from __spark_entry__ import queries

    con = con or duckdb_conn(sf_dir)
    t0 = time.time()
    sdf = queries()[name](spark, sf_dir)
    s_cols = list(sdf.columns)
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    o_cols = [d[0] for d in cur.description]
    o_rows = cur.fetchall()
    t2 = time.time()
    res = {"name": name, "spark_rows": len(s_rows), "oracle_rows": len(o_rows),
           "cols_match": sorted(s_cols) == sorted(o_cols), "spark_s": round(t1 - t0, 2), "oracle_s": round(t2 - t1, 2)}
    ours = {f.name: DUCK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema}
    res["types_match"] = ours == {d[0]: str(d[1]) for d in cur.description}
    if not res["types_match"]:
        res["types"] = [ours, {d[0]: str(d[1]) for d in cur.description}]
    a, b = rows_of(s_cols, s_rows), rows_of(o_cols, o_rows)
    res["values_match"] = res["cols_match"] and a == b
    if not res["values_match"]:
        res["spark_cols"], res["oracle_cols"] = s_cols, o_cols
        sa, sb = set(a), set(b)
        res["only_spark"] = [x for x in a if x not in sb][:3]
        res["only_oracle"] = [x for x in b if x not in sa][:3]
    return res


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import get_spark

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(queries())
    spark = get_spark("local[8]")
    con = duckdb_conn(sf_dir)
    sqls = oracle_sql()
    bad = 0
    for n in names:
        if n not in sqls:
            df = queries()[n](spark, sf_dir)
            print({"name": n, "rows_only": df.count()})
            continue
        try:
            r = compare(spark, n, sf_dir, sqls[n], con)
        except Exception as e:  # report and continue
            r = {"name": n, "error": repr(e)[:2000]}
        bad += not r.get("values_match", False)
        print(r, flush=True)
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
