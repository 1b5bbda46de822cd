"""Side-by-side run of registered queries and their SQL (also usable by hand)."""

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    rows = []
    for r in pdf.itertuples(index=False, name=None):
        row = []
        for v in r:
            if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NA or v is pd.NaT:
                row.append("~")
            elif isinstance(v, bool) or type(v).__name__ == "bool_":
                row.append(str(bool(v)))
            elif isinstance(v, (int, float)) or hasattr(v, "dtype"):
                row.append(repr(round(float(v), 6) + 0.0))
            else:
                row.append(str(v))
        rows.append(tuple(row))
    return sorted(rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    got_df = fn(spark, sf_dir)
    got = got_df.toPandas()
    spent = time.time() - t
    if sql is None:
        return f"{name:34s} rows={len(got):7d} {spent:6.2f}s  (rows only)", len(got) > 0
    t = time.time()
    want = con.execute(sql).df()
    oracle_spent = time.time() - t
    head = f"{name:34s} rows={len(got):7d} {spent:6.2f}s  sql {oracle_spent:5.2f}s"
    if sorted(got.columns) != sorted(want.columns):
        return f"{head} COLUMNS {sorted(set(got.columns) ^ set(want.columns))}", False
    if len(got) != len(want):
        return f"{head} ROWS {len(got)} vs {len(want)}", False
    kinds = []
    for c in got.columns:
        a, b = got[c].dtype.kind, want[c].dtype.kind
        if a != b and not {a, b} & {"O"} and got[c].notna().all() and want[c].notna().all():
            kinds.append(f"{c}:{got[c].dtype}/{want[c].dtype}")
    a, b = canonical(got), canonical(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        cols = sorted(got.columns)
        diff = [(cols[i], bad[0][0][i], bad[0][1][i]) for i in range(len(cols)) if bad[0][0][i] != bad[0][1][i]]
        return f"{head} VALUES {len(bad)} rows differ, e.g. {diff[:4]}", False
    if kinds:
        return f"{head} TYPES {kinds}", False
    if len(got) == 0:
        return f"{head} EMPTY", False
    return f"{head} ok", True


def main(argv):
    from tests.conftest import make_session
    from __spark_entry__ import oracle_sql, queries
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:]
    spark = make_session()
    con = duck(sf_dir)
    sqls = oracle_sql()
    good, failed = 0, []
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            line, ok = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            line, ok = f"{name:34s} ERROR {type(e).__name__}: {str(e)[:900]}", False
        print(line, flush=True)
        good += ok
        if not ok:
            failed.append(name)
    print(f"{good} good, {len(failed)} bad: {failed}")


if __name__ == "__main__":
    main(sys.argv)
