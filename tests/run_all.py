"""python tests/run_all.py SF_DIR [NAME...]: run queries, compare with SQL, print times."""

from __future__ import annotations

import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402
import oracle  # noqa: E402


def main(sf_dir: str, *names: str) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle.connect(sf_dir)
    queries, sql = contract.queries(), contract.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.perf_counter()
        try:
            actual = oracle.spark_result(queries[name](spark, sf_dir))
            seconds = time.perf_counter() - start
            if name in sql:
                problem = oracle.compare(actual, oracle.sql_result(connection, sql[name]))
            else:
                problem = None if actual[1] else "no rows"
        except Exception as error:  # noqa: BLE001
            seconds, actual, problem = time.perf_counter() - start, (None, []), str(error)[:600]
        bad += problem is not None
        kind = "exact" if name in sql else "rows"
        print(f"{seconds:7.2f}s {kind:5} {len(actual[1]):7} {name}: {problem or 'ok'}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
