"""Compare every registered Spark query with its DuckDB oracle.

Mirrors the driver's check: row count, column names (sorted), column types
(coarse classes) and an order-insensitive hash of the values.

    python tests/oracle_check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return repr(round(v, 9) + 0.0)
    if hasattr(v, "tolist"):
        return repr([_norm(x) for x in v.tolist()])
    if isinstance(v, (list, tuple)):
        return repr([_norm(x) for x in v])
    return repr(v)


def value_hash(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def duck(sf_dir: str):
    from plotwise.plans.fixtures import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _type_class(t: str) -> str:
    t = t.lower()
    if any(k in t for k in ("char", "string", "varchar")):
        return "str"
    if any(k in t for k in ("double", "float", "real", "decimal")):
        return "float"
    if any(k in t for k in ("int", "long", "short", "byte")):
        return "int"
    if "bool" in t:
        return "bool"
    return t


def compare(spark, con, name, fn, sql, sf_dir, verbose=False):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    stypes = {f.name: _type_class(f.dataType.simpleString()) for f in sdf.schema.fields}
    ts = time.time() - t0
    if sql is None:
        return {"name": name, "rows": len(srows), "check": "rows", "spark_s": round(ts, 2)}
    rel = con.sql(sql)
    dcols = rel.columns
    dtypes = {c: _type_class(str(t)) for c, t in zip(rel.columns, rel.types)}
    drows = rel.fetchall()
    sh, sl = value_hash(srows, scols)
    dh, dl = value_hash(drows, dcols)
    res = {"name": name, "rows": len(srows), "oracle_rows": len(drows), "spark_s": round(ts, 2),
           "cols_ok": sorted(scols) == sorted(dcols), "types_ok": stypes == dtypes,
           "hash_ok": sh == dh}
    res["ok"] = res["cols_ok"] and res["hash_ok"] and len(srows) == len(drows)
    if not res["ok"] or not res["types_ok"]:
        res["spark_cols"], res["oracle_cols"] = scols, dcols
        if not res["types_ok"]:
            res["types"] = {c: (stypes.get(c), dtypes.get(c)) for c in set(stypes) | set(dtypes)
                            if stypes.get(c) != dtypes.get(c)}
        if not res["hash_ok"]:
            diff_s = sorted(set(sl) - set(dl))[:3]
            diff_d = sorted(set(dl) - set(sl))[:3]
            res["only_spark"], res["only_oracle"] = diff_s, diff_d
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in argv[1:] if not a.startswith("/")]
    from plotwise.session import get_spark
    from plotwise.plans import registry
    registry.load_all()
    spark = get_spark("local[8]", 8)
    con = duck(sf_dir)
    bad = 0
    for name, fn in registry.QUERIES.items():
        if pats and not any(p in name for p in pats):
            continue
        try:
            r = compare(spark, con, name, fn, registry.ORACLES.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "error": f"{type(e).__name__}: {str(e)[:600]}"}
        ok = r.get("ok", r.get("check") == "rows")
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"done: {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
