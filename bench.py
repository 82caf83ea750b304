"""Headline timings: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from fieldstone import api  # noqa: E402
from fieldstone import queries as q  # noqa: E402
from fieldstone.plans import spec as S  # noqa: E402
from fieldstone.plans.spec import Dialect, ReadSpec  # noqa: E402
from fieldstone.sources import encode  # noqa: E402

RUNS = 5


def timed(run) -> float:
    run()  # warm
    found = []
    for _ in range(RUNS):
        t = time.perf_counter()
        run()
        found.append(time.perf_counter() - t)
    return round(statistics.median(found), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    df = q.table(spark, sf_dir, "lineitem").repartition(int(cpus))
    path = encode.write_table(df, q.PLAIN)
    quoted_dialect = Dialect(";", "\n", header_rows=())
    quoted = encode.write_table(df, quoted_dialect, quote_all=True)
    rows = df.count()
    queries = {}

    def consume(d):
        d.write.format("noop").mode("overwrite").save()

    for scan in ("native", "expression", "exact"):
        read = ReadSpec(q.PLAIN, S.indexed(*q.fields_of(df)), scan=scan)
        queries[f"scan_typed_{scan}"] = timed(lambda r=read: consume(api.read_delimited(spark, path, r)))
        queries[f"scan_count_{scan}"] = timed(lambda r=read: api.read_delimited(spark, path, r, [0]).count())
    read = ReadSpec(quoted_dialect, S.indexed(*q.fields_of(df)))
    queries["scan_typed_exact_quoted"] = timed(lambda: consume(api.read_delimited(spark, quoted, read)))
    read = ReadSpec(q.PLAIN, S.indexed(*q.fields_of(df)))
    queries["scan_agg"] = timed(lambda: consume(api.read_delimited(spark, path, read).toDF(*df.columns).groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity"), F.count("*"))))
    out = {"metric": "typed scan of lineitem as text, all paths", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": Path(sf_dir).name.removeprefix("sf"), "rows": rows, "rows_per_s": {k: round(rows / v) for k, v in queries.items()}}
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
