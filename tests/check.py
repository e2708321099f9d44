"""Run registered queries against their SQL checks: ``python tests/check.py [folder] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession

from riskloom.plans import ORACLES, QUERIES
from tests.compare import connect, difference


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    for name in names:
        started = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                outcome = difference(df, connection, ORACLES[name]) or "equal"
            else:
                outcome = f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001 - a report line per query
            outcome = f"FAILED {type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:32s} {time.time() - started:6.2f}s {outcome}", flush=True)


if __name__ == "__main__":
    main()
