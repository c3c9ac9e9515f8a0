"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

    python tests/oracle_check.py [sf_dir] [name ...]

Compares row count, column names and an order-insensitive hash of the values
(floats rounded to 6 places), like the correctness gate.  Prints one line per
query and a sample of differing rows.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    return repr(v)


def spark_type_name(t) -> str:
    from pyspark.sql import types as T

    simple = {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.StringType: "VARCHAR", T.DoubleType: "DOUBLE",
              T.BooleanType: "BOOLEAN", T.FloatType: "FLOAT", T.ShortType: "SMALLINT", T.ByteType: "TINYINT"}
    for k, v in simple.items():
        if isinstance(t, k):
            return v
    if isinstance(t, T.ArrayType):
        return spark_type_name(t.elementType) + "[]"
    return t.simpleString().upper()


def rows_key(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(norm(r[i]) for i in order) for r in rows)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from scrivener.session import get_session
    import __spark_entry__ as E

    spark = get_session("local[8]")
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf)
            scols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} SPARK-ERROR {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"{name:28s} rows={len(srows)} (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            dtypes = {d[0]: str(d[1]) for d in cur.description}
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} DUCKDB-ERROR {str(e)[:300]}")
            bad += 1
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        stypes = {f.name: spark_type_name(f.dataType) for f in df.schema.fields}
        type_diff = {c: (stypes.get(c), dtypes.get(c)) for c in scols if stypes.get(c) != dtypes.get(c)}
        if type_diff:
            print(f"   types differ: {type_diff}")
        a, b = rows_key(scols, srows), rows_key(dcols, drows)
        ok = ok_cols and len(a) == len(b) and a == b
        h = hashlib.sha1("\n".join(a).encode()).hexdigest()[:10]
        print(f"{name:28s} {'OK ' if ok else 'BAD'} rows={len(srows)}/{len(drows)} cols_ok={ok_cols} {h} {ts:.1f}s")
        if not ok:
            bad += 1
            if not ok_cols:
                print("   spark:", scols, "\n   duck: ", dcols)
            else:
                sa, sb = set(a), set(b)
                for x in list(sa - sb)[:3]:
                    print("   spark-only:", x[:400])
                for x in list(sb - sa)[:3]:
                    print("   duck-only: ", x[:400])
    print("BAD" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
