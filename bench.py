"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores, BENCH_RUNS the warm runs
per query (the median counts), BENCH_QUERIES (comma-separated, or ``all``) the queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from turnstile import Tickets  # noqa: E402
from turnstile.operators import (  # noqa: E402
    audience,
    compare,
    kpi,
    marketing,
    operations,
    revenue,
    sales,
)
from turnstile.plans import queries as registry  # noqa: E402
from turnstile.session import local_session  # noqa: E402
from turnstile.sources import published, tables  # noqa: E402

HEADLINE = [
    "tenant_tickets",
    "ingest_pages",
    "incremental_new_tickets",
    "norm_utm_source",
    "norm_order_parts",
    "filter_dff",
    "data_summary",
    "kpis",
    "kpis_dated",
    "sales_daily_until",
    "sales_cumulative",
    "sales_lead_time",
    "sales_heatmap",
    "show_summary",
    "compare_ref_vs_avg",
    "compare_loyalty",
    "evolution_avg_others",
    "revenue_by_category",
    "revenue_by_payment",
    "channel_by_medium",
    "channel_by_show",
    "unique_buyers",
    "audience_age_gender",
    "audience_top_loyal",
    "attendance_by_show",
    "category_mix",
    "door_rows",
    "channel_comparison",
]


PUBLISHED = {
    "kpis": (kpi.headline, registry.ALL),
    "kpis_dated": (kpi.headline, registry.DATED),
    "sales_cumulative": (sales.cumulative, registry.Y98),
    "show_summary": (sales.show_summary, registry.ALL),
    "compare_loyalty": (compare.loyalty, registry.Y98),
    "revenue_by_category": (revenue.by_category, registry.ALL),
    "channel_by_medium": (marketing.channel_by_medium, registry.ALL),
    "audience_age_gender": (audience.age_by_gender, registry.ALL),
    "audience_top_loyal": (audience.top_loyal, registry.ALL),
    "attendance_by_show": (operations.attendance_by_show, registry.ALL),
}


def _run(df) -> None:
    """Compute every row and send none to the driver."""
    df.write.format("noop").mode("overwrite").save()


def _median(action, runs: int) -> float:
    """Median of the warm runs; the first run compiles and does not count."""
    seconds = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        action()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds[1:]), 3)


def _published(spark, directory: str, cores: str, runs: int) -> dict[str, float]:
    """The same metrics over tickets that were normalised and written once."""
    path = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "tickets")
    start = time.perf_counter()
    whole = Tickets.from_raw(tables.tickets(spark, directory), registry.AS_OF)
    published.publish(whole, path, files=int(cores) if cores.isdigit() else 8)
    timed = {"publish": round(time.perf_counter() - start, 3)}
    for name, (metric, f) in PUBLISHED.items():
        timed[name] = _median(
            lambda: _run(metric(published.open_published(spark, path), f)), runs
        )
    return timed


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    registered = registry.queries()
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(registered) if asked == "all" else asked.split(",") if asked else HEADLINE

    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    timed = {
        name: _median(lambda: _run(registered[name](spark, directory)), runs) for name in names
    }
    over_published = _published(spark, directory, cores, runs)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries from the tables, sum of warm medians",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": timed,
                "published": over_published,
                "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
                "cpus": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
