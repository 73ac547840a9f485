"""Runs all queries (or the named ones) against their SQL:
python tests/check_queries.py SF_DIR [name ...]"""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from checker import connect, differences, spark_rows  # noqa: E402


def main() -> int:
    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db, oracles, bad = connect(sf), contract.oracle_sql(), 0
    for name, query in contract.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.perf_counter()
        try:
            df = query(spark, sf)
            if name in oracles:
                problems = differences(df, db, oracles[name])
            else:
                problems = [] if spark_rows(df)[2] else ["no rows"]
        except Exception as e:
            problems = [f"{type(e).__name__}: {str(e)[:1500]}"]
        seconds = time.perf_counter() - start
        bad += bool(problems)
        mark = "BAD" if problems else "ok " if name in oracles else "row"
        print(f"{mark} {name} {seconds:.1f}s", *problems, sep="\n      ", flush=True)
    print(f"{bad} with problems", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
