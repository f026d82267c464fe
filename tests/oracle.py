"""Side-by-side comparison of a registered query and its SQL on the given tables."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: int = 8):
    """Local session; its shared folder is a fresh one under the system's scratch folder."""
    import tempfile

    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="simloom-tests-"))
        .appName("simloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def duck(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        value = round(value, 6) + 0.0
        return int(value) if value.is_integer() else value
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    data = [tuple(plain(row[k]) for k in order) for row in rows]
    return [columns[k] for k in order], sorted(data, key=repr)


def compare(spark, connection, sf_dir: str, run, sql: str) -> str:
    """Empty text if both agree, else a short description of the difference."""
    got = run(spark, sf_dir)
    mine = normalized(got.columns, got.collect())
    answer = connection.sql(sql)
    theirs = normalized(answer.columns, answer.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if mine[1] != theirs[1]:
        only_mine = [r for r in mine[1] if r not in set(theirs[1])][:3]
        only_theirs = [r for r in theirs[1] if r not in set(mine[1])][:3]
        return f"rows {len(mine[1])} vs {len(theirs[1])}: {only_mine} != {only_theirs}"
    return ""


def main(sf_dir: str, names: list[str]) -> int:
    from simloom.catalog import ORACLES, QUERIES

    spark, connection, failed = session(), duck(sf_dir), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name, run in QUERIES.items():
        if names and not any(part in name for part in names):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, connection, sf_dir, run, ORACLES[name])
            else:
                problem = "" if (rows := run(spark, sf_dir).count()) else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        note = "" if name in ORACLES else f" (rows only: {rows if not problem else '?'})"
        print(f"{'FAIL' if problem else 'ok':4} {time.time() - start:6.2f}s {name}{note} {problem}", flush=True)
    print(f"{failed} failed, {len(QUERIES)} queries, {len(ORACLES)} with SQL")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
