"""Runs registered queries against DuckDB: python -m checks.compare SF [name-prefix ...]"""

from __future__ import annotations

import datetime
import sys
import time

import duckdb

from checks import load, registry
from threatlake import session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.isoformat(sep=" ")
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = registry.QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    spent = time.time() - start
    if name not in registry.ORACLES:
        return True, f"{len(got)} rows, no SQL, {spent:.1f}s"
    cursor = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} / {sorted(columns)}"
    types = {d[0]: str(d[1]) for d in cursor.description}
    want = rows_of(columns, cursor.fetchall())
    note = " ".join(f"{f.name}:{f.dataType.simpleString()}/{types[f.name]}" for f in df.schema.fields
                    if not _same_type(f.dataType.simpleString(), types[f.name]))
    if got != want:
        only_got = [r for r in got if r not in set(want)][:2]
        only_want = [r for r in want if r not in set(got)][:2]
        return False, f"{len(got)} / {len(want)} rows\n   spark {only_got}\n   duck  {only_want}"
    return (not note), f"{len(got)} rows, {spent:.1f}s {note}"


def _same_type(spark: str, duck: str) -> bool:
    pairs = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN",
             "timestamp_ntz": "TIMESTAMP"}
    return pairs.get(spark) == duck.upper()


def main() -> int:
    sf_dir = f"/root/testdata/{sys.argv[1]}"
    prefixes = tuple(sys.argv[2:]) or ("",)
    load()
    spark = (session.builder("compare").master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(sf_dir), 0
    for name in registry.QUERIES:
        if not name.startswith(prefixes):
            continue
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
