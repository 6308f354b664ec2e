"""Run registered queries in Spark and their oracle in DuckDB and compare all rows.

    python tests/compare.py SF_DIR [KEY ...]
"""

from __future__ import annotations

import pathlib
import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

ROOT = pathlib.Path(__file__).resolve().parent.parent
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

from fundlake import registry  # noqa: E402


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fundlake-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(pathlib.Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def _columns(con: duckdb.DuckDBPyConnection, relation: str) -> dict[str, str]:
    rows = con.execute(f"describe {relation}").fetchall()
    return {name: kind for name, kind, *_ in sorted(rows)}


def differences(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, key: str,
                folder: str) -> str:
    """Empty when the query and its oracle give the same columns, types and rows (as multisets)."""
    path = f"{folder}/{key}"
    registry.queries()[key](spark, sf_dir).write.parquet(path)
    con.execute(f"create or replace temp view got as select * from read_parquet('{path}/*.parquet')")
    con.execute(f"create or replace temp table want as {registry.oracle_sql()[key]}")
    got, want = _columns(con, "got"), _columns(con, "want")
    if got != want:
        return f"columns {sorted(set(got.items()) ^ set(want.items()))}"
    names = ", ".join(f'"{name}"' for name in got)
    extra, missing = (
        con.execute(f"select {names} from {a} except all select {names} from {b} limit 2").fetchall()
        for a, b in (("got", "want"), ("want", "got"))
    )
    if extra or missing:
        counts = con.execute("select (select count(*) from got), (select count(*) from want)").fetchone()
        return f"rows {counts}; only spark {extra}; only oracle {missing}"
    return ""


def main() -> None:
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con, folder = session(), oracle(sf_dir), tempfile.mkdtemp(prefix="compare-")
    for key in wanted or registry.ENTRIES:
        start = time.time()
        try:
            problem = differences(spark, con, sf_dir, key, folder)
            rows = con.execute("select count(*) from want").fetchone()[0]
        except Exception as error:  # report every key, then go on
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", None
        print(f"{key:30s} {time.time() - start:6.1f}s {rows} rows {problem or 'ok'}", flush=True)


if __name__ == "__main__":
    main()
