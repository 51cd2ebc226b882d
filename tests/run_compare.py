"""python tests/run_compare.py FOLDER [NAME...]: each registered query beside its SQL."""

import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).parents[1])
sys.path[:0] = [ROOT, str(Path(__file__).parent)]
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from compare import connect, differences  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

if __name__ == "__main__":
    folder, names = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master(f"local[{os.environ.get('CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, queries, oracles = connect(folder), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or [n for n in queries if n in oracles]:
        began = time.time()
        try:
            said = differences(queries[name](spark, folder), con, oracles[name])
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:400]}"
        if said:
            bad += 1
            print(f"{name} ({time.time() - began:.1f} s): {said}", flush=True)
    print(f"{bad} differ", flush=True)
