"""Run queries next to their SQL: ``python -m checks.compare [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import tempfile
import time

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES
from kinshelf.session import removing_steps

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
benchmark labels conversations""".split()


def local_session(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="compare-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (pd.Timestamp, np.datetime64)):
        return pd.Timestamp(value).tz_localize(None).isoformat()
    if isinstance(value, np.generic):
        value = value.item()
    if isinstance(value, float) and value == int(value):
        return int(value)
    return value


def rows(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    found = [tuple(_plain(v) for v in r) for r in frame[names].itertuples(index=False, name=None)]
    return sorted(found, key=repr)


def compare(spark: SparkSession, folder: str, name: str) -> tuple[bool, str]:
    started = time.time()
    with removing_steps(spark):
        frame = QUERIES[name](spark, folder).toPandas()
    spark_time = time.time() - started
    if name not in ORACLES:
        return True, f"{len(frame)} rows, {spark_time:.1f} s, no SQL"
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    started = time.time()
    expected = con.execute(ORACLES[name]).df()
    timing = f"{spark_time:.1f} s, SQL {time.time() - started:.1f} s"
    if sorted(frame.columns) != sorted(expected.columns):
        return False, f"columns {sorted(frame.columns)} and {sorted(expected.columns)}"
    got, want = rows(frame), rows(expected)
    if got == want:
        return True, f"{len(got)} rows, {timing}"
    differing = [(g, w) for g, w in zip(got, want) if g != w][:3]
    return False, f"{len(got)} and {len(want)} rows, {timing}; {str(differing)[:1200]}"


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    bad = []
    for name in names:
        try:
            same, note = compare(spark, folder, name)
        except Exception as error:  # noqa: BLE001 - report and go on with the others
            same, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        if not same:
            bad.append(name)
        print("ok  " if same else "FAIL", name, note, flush=True)
    print(len(names) - len(bad), "of", len(names), "as expected; not:", bad)


if __name__ == "__main__":
    main()
