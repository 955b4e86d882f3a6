"""Headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line.

Every query is run to the end into a no-op sink after one warm-up of the session.
``BENCH_QUERIES`` (comma-separated) picks others; ``all`` runs every registered query.

The supplied ``lineitem`` is one file with one row group, which one core would scan and parse.
It is written once, before the clock starts, as a folder of several files, as a table of any
size would be; the other tables are read as they are.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowloom.plans.catalog import QUERIES  # noqa: E402
from flowloom.session import ROCKSDB_PROVIDER, local_session  # noqa: E402

HEADLINE = (
    "flagship d1 d1_cleaned d2 d5_sizes e4 b8 d8 d9 d13 d16 i1 c1 c6 h11 h11_fitted d23 d29 d31 d46 "
    "e5 e10 h20 k1 j1 j3 j4 j5 j6 k1_stream k9"
).split()


def spread(spark, sf_dir: str, files: int) -> str:
    """A folder like ``sf_dir`` with ``lineitem`` in several files."""
    made = tempfile.mkdtemp(prefix="bench-")
    for table in Path(sf_dir).glob("*.parquet"):
        if table.name != "lineitem.parquet":
            os.symlink(table, f"{made}/{table.name}")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition(files).write.parquet(f"{made}/lineitem.parquet")
    return made


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [q for q in chosen.split(",") if q] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, **{"spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER})
    spark.sparkContext.setLogLevel("ERROR")
    data = spread(spark, sf_dir, 2 * int(cpus) if cpus.isdigit() else 16)
    spark.read.parquet(f"{data}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds, failed = {}, {}
    for name in names:
        start = time.perf_counter()
        try:
            QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        except Exception as exc:  # noqa: BLE001 - the bench reports what failed
            failed[name] = str(exc)[:200]
        if chosen:
            print(name, seconds.get(name, failed.get(name)), file=sys.stderr, flush=True)
    line = {"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}
    if failed:
        line["failed"] = failed
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
