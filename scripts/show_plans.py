"""Print the physical plans of key operators (markdown), for docs/PLANS.md.

usage: python scripts/show_plans.py [SF_DIR] > docs/PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def physical(df) -> str:
    p = df._jdf.queryExecution().executedPlan().toString()
    p = re.sub(r"#\d+L?", "", p)
    p = re.sub(r"file:[^,\]]*", "<path>", p)
    return "\n".join(line[:160] for line in p.splitlines())


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from airsignal.operators import features as FE
    from airsignal.operators import windows as W
    from airsignal.plans.frames import SERIES, obs_wide
    from airsignal.plans.q_sources import merged
    from airsignal.session import local_session, scratch_path
    from airsignal.sources import store as ST

    spark = local_session(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # show the static plan, not a stage snapshot
    K = ["location_id"]
    base = obs_wide(spark, sf)
    raw = scratch_path(spark, "raw")
    ST.raw_append(merged(spark, sf), raw, keys=["location_id", "event_id"])
    cases = [
        ("derived_features, plain plan: one Exchange on the location after the pivot, one Sort, one walk (MapInArrow)",
         FE.derived_features(base, K, "ts", strategy="plain")),
        ("all_features: a first, narrow walk for the series' first values, then one walk that derives and fills",
         FE.all_features(base, K, "ts", "aqi", strategy="plain")),
        ("derived_features, blocked plan (hot keys): distributed row number, blocks with halos and seed rows",
         FE.derived_features(base.select("location_id", "ts", *SERIES), K, "ts", strategy="blocked")),
        ("fill_missing, plain plan", W.fill_missing(base, SERIES, K, "ts", strategy="plain")),
        ("raw_range_scan: event_date partition pruning and ts pushdown",
         ST.raw_range_scan(spark, raw, hours=72, as_of="2024-01-30 00:00:00")),
    ]
    print("# Physical plans of key operators\n")
    print(f"Generated by `python scripts/show_plans.py {sf}` (AQE off, so the static plan is shown).\n")
    for title, df in cases:
        print(f"## {title}\n\n```\n{physical(df)}\n```\n")


if __name__ == "__main__":
    main()
