"""DuckDB baseline: each oracle_sql() statement on the same parquet tables, warm, median of N runs,
its rows written to a table of DuckDB's own (none are fetched into Python).

Usage: python tools/duckdb_baseline.py [sf_dir] [runs]
Prints one JSON line shaped like bench.py's output.
"""
import json
import os
import statistics
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from ledgerline.plans.oracle import ORACLE  # noqa: E402

TABLES = ["customer", "orders", "events", "nation", "region"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    runs = int(sys.argv[2]) if len(sys.argv) > 2 else 5
    con = duckdb.connect()
    con.execute(f"SET threads = {int(os.environ.get('BENCH_CPUS', '8'))}")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    times = {}
    for name, sql in ORACLE.items():
        ts = []
        for _ in range(runs + 1):  # the first one warms up
            t0 = time.perf_counter()
            con.execute(f"CREATE OR REPLACE TEMP TABLE result AS {sql}")
            ts.append(time.perf_counter() - t0)
        ts = ts[1:]
        times[name] = round(statistics.median(ts), 4)
    print(json.dumps({"metric": "duckdb_oracle_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
