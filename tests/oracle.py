"""Compare registered queries with their SQL in DuckDB: ``python -m tests.oracle [name…]``."""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("tabsight-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or type(v).__name__ in ("NAType", "NaTType") or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if v != v:  # NaT
        return None
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_cell(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(type(x).__name__ == "str"), x if not isinstance(x, bool) else int(x)) if x is not None else (True, "", 0) for x in r))


def compare(got, want) -> str:
    """'' when equal, else what differs; also notes values equal only within tolerance."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    cols, a = rows_of(got)
    _, b = rows_of(want)
    kinds = [(c, got[c].dtype.kind, want[c].dtype.kind) for c in cols]
    odd = [k for k in kinds if k[1] != k[2] and len(got)]
    bad, close = [], 0
    for x, y in zip(a, b):
        for c, p, q in zip(cols, x, y):
            if p == q:
                continue
            if isinstance(p, float) and isinstance(q, (float, int)) and math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-9):
                close += 1
                continue
            bad.append((c, p, q))
    if bad:
        return f"{len(bad)} cells differ, e.g. {bad[:3]}"
    note = []
    if close:
        note.append(f"{close} cells equal only within tolerance")
    if odd:
        note.append(f"dtype kinds {odd}")
    return ("~ " + "; ".join(note)) if note else ""


def main(names):
    import __spark_entry__ as e

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = session(), connect(sf_dir)
    queries, sql = e.queries(), e.oracle_sql()
    failed = 0
    for name in names or queries:
        t = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            took = time.time() - t
            if name not in sql:
                print(f"ROWS {name} {took:.1f}s rows={len(got)}", flush=True)
                continue
            t = time.time()
            want = con.execute(sql[name]).df()
            verdict = compare(got, want)
            status = "OK  " if not verdict else ("NEAR" if verdict.startswith("~") else "FAIL")
            failed += status == "FAIL"
            print(f"{status} {name} {took:.1f}s/{time.time() - t:.1f}s rows={len(got)} {verdict}", flush=True)
        except Exception as err:  # noqa: BLE001
            failed += 1
            print(f"ERR  {name} {type(err).__name__}: {str(err)[:600]}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
