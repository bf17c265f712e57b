"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the sample folder, ``BENCH_CPUS`` the local cores and
``BENCH_QUERIES`` optionally a comma-separated choice of query names.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from reelshelf import build_session  # noqa: E402
from reelshelf.functions.text import entity_name  # noqa: E402
from reelshelf.queries import QUERIES  # noqa: E402

HEADLINE = (
    "a3_public_scan",
    "c2_search",
    "c3_score_year_range",
    "d1_genre_include_all",
    "d2_genre_exclude",
    "d5_studio_any",
    "d7_author_any",
    "f1_sort_top_rated",
    "f3_page",
    "f3_keyset_page",
    "f5_seasonal_most_popular",
    "f9_random_window",
    "f12_streaming_queue",
    "b1_anime_detail",
    "b2_manga_detail",
    "b5_hydrated_page",
    "e1_total",
    "e2_filter_ranges",
    "e8_build_facets",
    "f6_facet_page",
    "e6_visit_totals",
    "e7_visits_by_week",
    "a9_visit_upsert",
    "a1_read_pages",
    "h2_detailed_tags",
    "i1_merge_anime",
    "i6_parse_studios",
    "i9_reconcile_studio_links",
    "i12_resolve_studios",
    "a4_anime_page_upsert",
    "j1_page_stream",
    "j2_visit_stream",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        app="bench",
        master=f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM and the Python workers before the clock runs.
    words = spark.range(0, 10_000, 1, int(cpus)).select(F.concat(F.lit("é"), "id").alias("w"))
    words.select(entity_name(F.col("w"))).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
