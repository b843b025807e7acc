"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores. Each query runs once to warm up and is then timed,
written to the no-op sink so that every row and column is produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

from recordloom import plans
from recordloom.session import local_session

HEADLINE = (
    "invoice_tax_status", "invoice_record_lines", "tier_evaluate", "account_balance", "claims_settlement", "claims_totals",
    "compute_expression", "rounded_vs_truncated", "rounding_modes", "size_error_branch", "divide_remainder", "divide_exact",
    "packed_roundtrip", "zoned_roundtrip", "edited_pictures", "running_counters",
    "string_concat", "unstring_split", "inspect_tally", "inspect_convert", "occurs_table", "redefines_views",
    "fixed_file_roundtrip", "line_file_roundtrip", "indexed_file_load",
    "keyed_lookup_status", "alt_key_first", "keyed_write_dup", "keyed_write_repeated_alternate", "keyed_write_unique_alternate",
    "keyed_mixed_stream", "keyed_mixed_master",
    "sql_inner_join", "sql_left_join_indicator", "sql_group_having", "sql_in_subquery", "sql_singleton_select",
    "sort_multi_key", "merge_files", "utility_sort_fields", "running_balance", "report_pages",
    "reconcile_diff", "reconcile_verdict", "bag_difference",
    "call_graph_edges", "control_flow_edges", "data_flow_edges", "lineage_reach", "job_data_sets",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "recordloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = plans.load()
    wanted = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in wanted:
        for _ in range(2):
            t = time.perf_counter()
            run(queries[name](spark, sf))
            times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")), "cpus": cpus, "spark": spark.version}))


if __name__ == "__main__":
    main()
