"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from landprice import catalog
from landprice.plans.imports import import_years
from landprice.session import local_session

HEADLINE = (
    "price_report_summary",
    "price_report_transactions",
    "price_report_two_years",
    "price_report_with_garage",
    "price_report_whole_population",
    "analyse_all_prices",
    "analyse_parcels",
    "daily_price_series",
    "surface_bands",
    "outlier_bounds",
    "mean_price_by_property_type",
    "mean_price_m2_prefix",
    "clean_transactions",
    "dedup_first",
    "insert_absent",
    "import_status_by_year",
    "table_stats_report",
    "register_price_report",
    "register_by_parcel",
)


def seconds(action) -> float:
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))

    def run(name: str) -> None:
        result = catalog.QUERIES[name](spark, folder)
        result.write.format("noop").mode("overwrite").save()

    # One warm-up run each: the published comparison numbers are for a running server.
    for name in HEADLINE:
        run(name)
    timings = {name: min(seconds(lambda: run(name)) for _ in range(2)) for name in HEADLINE}

    template = catalog.landed_files(spark, folder) + "/import_year={year}"
    table = catalog.new_table(spark, "bench")
    timings["import_years"] = seconds(
        lambda: import_years(spark, table, template, 1995, 2001, file_name="")
    )
    rows = spark.table(table).count()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "import_rows": rows,
                "import_rows_per_sec": round(rows / timings["import_years"]),
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
