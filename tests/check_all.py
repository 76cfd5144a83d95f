"""Compare all (or the named) queries with their SQL: check_all.py SF_DIR [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402
from threadsieve.session import build_session  # noqa: E402


def main():
    sf_dir, names = sys.argv[1], sys.argv[2:]
    sql = contract.oracle_sql()
    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    for name, fn in contract.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, fn, sql[name], sf_dir)
                kind = "same"
            else:
                kind, problem = f"rows {fn(spark, sf_dir).count()}", None
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{time.time() - t:7.2f}s {name:28s} {problem or kind}", flush=True)
        if problem:
            failed.append(name)
    print("FAILED:" if failed else "all fine", *failed)


main()
