"""Benchmark: the reference's evaluation cases over generated records and driver tables.

Records are generated from the customer keys of ``$BENCH_SF_DIR`` (130 per
key, the benchmark's record layout), written to Parquet once, then every
case reads the Parquet, appends its result column and writes to the no-op
sink (full evaluation, output discarded).  ``$BENCH_WARMUPS`` (2) warm-ups
and ``$BENCH_RUNS`` (4) measured runs per case; the median is reported.
The same cases also run on generated 100k and 1M rows
(``$BENCH_GEN_SIZES``), reported with an ``@100k`` / ``@1m`` suffix; wide
suites over the orders table with an ``@wide`` suffix (not in the sum).

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from ruleframe.model import Id, Rule, RuleSet, RuleSuite  # noqa: E402
from ruleframe.operators.decision import DecisionModel, rule_hits  # noqa: E402
from ruleframe.operators.results import distinct_suite_results, rule_counts  # noqa: E402
from ruleframe.operators.runner import audit_compat, run_rules, template_vector, with_vector  # noqa: E402
from ruleframe.session import local_session  # noqa: E402
from ruleframe.sources.bindings import bind_fields, bind_json, bind_struct  # noqa: E402
from ruleframe.sources.io import read_parquet, scratch_path, write_noop, write_parquet  # noqa: E402
from ruleframe.sources.records import generate, generate_records  # noqa: E402
from ruleframe.sources.tables import customer_records, read_table  # noqa: E402
from ruleframe.suites import (DECISION_SUITE_RULES, ORDERS_FIELDS, baseline_rules, decision_suite,  # noqa: E402
                              orders_suite, sql_suite)


def _cases(spark, data, sf_dir):
    suite, dsuite = sql_suite(), decision_suite()
    model = DecisionModel(dsuite)
    base = baseline_rules()

    def noop(build):
        return lambda: write_noop(build())

    cases = {
        # reference: "baseline in codegen"
        "baseline": noop(lambda: data.withColumn("quality", template_vector(base))),
        # reference: "audit baseline in codegen" (interim projection of the vector)
        "audit_baseline": noop(lambda: data.withColumn("rr", template_vector(base))
                               .withColumn("quality", audit_compat(F.col("rr"), len(base))).drop("rr")),
        # reference: rule runner with functions inlined and constants folded
        "rule_runner": noop(lambda: run_rules(spark, data, suite)),
        "rule_runner_json": noop(lambda: run_rules(spark, data, suite, bind_json("payload"))),
        # reference: decision model, struct/fields/JSON in, booleans or JSON out, evaluate all
        "decision_struct_bools": noop(lambda: model.evaluate(spark, data, bind_struct("struct_payload"), service=None)),
        "decision_fields_bools": noop(lambda: model.evaluate(spark, data, bind_fields(), service=None)),
        "decision_json_bools": noop(lambda: model.evaluate(spark, data, bind_json("payload"), service=None)),
        "decision_json_json": noop(lambda: model.evaluate(spark, data, bind_json("payload"), service=None,
                                                          as_json=True)),
        # distinct audit results with counts (grouped by rule vector, audits built per distinct vector)
        "distinct_results": lambda: distinct_suite_results(spark, data, suite, compat=True).collect(),
        # rules as rows: broadcast equi-join of records with the (rule, member, department) table
        "decision_rules_join": noop(lambda: rule_hits(
            spark, data.withColumn("key", F.xxhash64("id", "idPrefix", "location")), DECISION_SUITE_RULES, "key")),
    }
    if sf_dir:
        # driver tables: customer x nation binding, per-rule counts (partial aggregation)
        # a second suite bound by column mapping to the whole orders table
        orders = read_table(spark, sf_dir, "orders")
        cases["orders_rule_runner"] = noop(lambda: run_rules(spark, orders, orders_suite(), bind_fields(ORDERS_FIELDS)))
        cases["customer_rule_counts"] = lambda: rule_counts(
            with_vector(spark, customer_records(spark, sf_dir), suite), "quality",
            [r.id.id for _, r in suite.rules()]).collect()
    return cases


def _wide_cases(spark, sf_dir):
    """Suites of 15 to 1,000 rules over the orders table: the cost of a rule should not grow with their number."""
    orders = read_table(spark, sf_dir, "orders")
    rules = [Rule(Id(k), f"(cast({{o_totalprice}} AS BIGINT) % {k % 50 + 2} = {k % 5} AND {{o_orderstatus}} <> 'P') "
                         f"OR {{o_custkey}} % {k % 31 + 2} = 1") for k in range(1000)]
    suites = {n: RuleSuite(Id(1), (RuleSet(Id(1), tuple(rules[:n])),)) for n in (15, 100, 400, 1000)}
    return {f"rules_{n}@wide": lambda s=s: write_noop(with_vector(spark, orders, s)) for n, s in suites.items()}, orders.count()


def _measure(fn, warmups, runs):
    for _ in range(warmups):
        fn()
    times = []
    for _ in range(runs):
        s = time.time()
        fn()
        times.append(time.time() - s)
    return round(statistics.median(times), 4), [round(min(times), 4), round(max(times), 4)]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    ncpu = int(cpus) if cpus.isdigit() else os.cpu_count()
    warmups = int(os.environ.get("BENCH_WARMUPS", "2"))
    runs = int(os.environ.get("BENCH_RUNS", "4"))
    sizes = [int(x) for x in os.environ.get("BENCH_GEN_SIZES", "100000,1000000").split(",") if x]
    spark = local_session(cpus, shuffle_partitions=ncpu, app="ruleframe-bench",
                          event_log_dir=os.environ.get("BENCH_EVENT_LOG_DIR") or None)
    parts = int(os.environ.get("BENCH_PARTITIONS", str(4 * ncpu)))

    # Datasets, written to Parquet once: records from the sf's customer keys
    # (headline), and the benchmark's generated sizes.
    t0 = time.time()
    datasets = {"": write_parquet(
        generate_records(read_table(spark, sf_dir, "customer"), "c_custkey", num_partitions=parts),
        scratch_path(spark, "bench-records"))}
    for n in sizes:
        label = f"@{n // 1000}k" if n < 1_000_000 else f"@{n // 1_000_000}m"
        datasets[label] = write_parquet(generate(spark, n, num_partitions=parts), scratch_path(spark, f"bench-gen-{n}"))
    setup_sec = time.time() - t0

    # the session is warmed on every case before anything is measured, so that no dataset pays for cold code
    warm = read_parquet(spark, datasets[min(datasets, key=lambda k: (not k, k))])
    for fn in _cases(spark, warm, sf_dir).values():
        fn()

    medians, spread, rows, totals = {}, {}, {}, {}
    for label, path in datasets.items():
        data = read_parquet(spark, path)
        rows[label or "sf"] = data.count()
        for name, fn in _cases(spark, data, sf_dir if label == "" else None).items():
            medians[name + label], spread[name + label] = _measure(fn, warmups, runs)
        totals[label or "sf"] = round(sum(v for k, v in medians.items() if k.endswith(label) and
                                          (label or "@" not in k)), 4)

    wide, rows["@wide"] = _wide_cases(spark, sf_dir)
    for name, fn in wide.items():
        medians[name], spread[name] = _measure(fn, warmups, runs)

    def rps(k, v):
        label = k[k.index("@"):] if "@" in k else "sf"
        return round(rows[label] / v) if v > 0 else None

    print(json.dumps({
        "metric": "sum_of_median_case_sec",
        "value": totals["sf"],
        "unit": "sec",
        "queries": medians,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "spread_min_max": spread,
        "rows": rows,
        "totals": totals,
        "rows_per_sec": {k: rps(k, v) for k, v in medians.items() if not k.startswith(("customer_", "orders_"))},
        "usec_per_order_rule": {k: round(1e6 * medians[k] / rows["@wide"] / int(k[6:k.index("@")]), 4) for k in wide},
        "setup_sec": round(setup_sec, 3),
        "cpus": ncpu,
        "driver_memory": spark.conf.get("spark.driver.memory", "default"),
        "warmups": warmups,
        "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
