"""Driver tables and record bindings built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleframe.functions.columns import case_lookup
from ruleframe.sources.records import record_struct, with_payloads

# --- fixed values (test fixture: maps the driver tables onto the record) ---
# n_regionkey -> location.
REGION_LOCATION = {0: "US", 1: "UK", 2: "CH", 3: "MX", 4: "BR"}
# c_mktsegment -> department.
SEGMENT_DEPARTMENT = {
    "AUTOMOBILE": "sales",
    "BUILDING": "marketing",
    "FURNITURE": "hr",
    "HOUSEHOLD": "it",
    "MACHINERY": "ops",
}
# ---------------------------------------------------------------------------


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _customer_nation(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = (),
                     customer: DataFrame | None = None) -> DataFrame:
    # The planner knows nation's size from its file and broadcasts it; left
    # join keeps every customer (an unknown nation gives a NULL location).
    c = (customer if customer is not None else read_table(spark, sf_dir, "customer")).select(
        "c_custkey", "c_nationkey", "c_mktsegment", *extra)
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left")


def customer_records(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = (),
                     customer: DataFrame | None = None) -> DataFrame:
    """One record per customer, covering all 25 location x department pairs.

    location from the nation's region, department from the market segment,
    id = customer key, idPrefix = nation name, page = nation key.  Carries
    ``key``, the ``keep`` customer/nation columns, the record as fields,
    ``payload`` (JSON) and ``struct_payload``.  ``customer`` may be a
    streaming frame of the customer table (joined to the static nation table).
    """
    base = ("c_custkey", "c_nationkey", "c_mktsegment", "n_nationkey", "n_name", "n_regionkey")
    j = _customer_nation(spark, sf_dir, extra=tuple(k for k in keep if k not in base), customer=customer)
    rec = record_struct(case_lookup(F.col("n_regionkey"), REGION_LOCATION), F.col("n_name"),
                        F.col("c_custkey"), F.col("c_nationkey").cast("bigint"),
                        case_lookup(F.col("c_mktsegment"), SEGMENT_DEPARTMENT))
    return with_payloads(j.select(F.col("c_custkey").alias("key"), *keep, rec.alias("f")), keep=("key", *keep))


def customer_edge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer records with nulls, blanks and bad JSON, chosen by account balance.

    balance < -500: location NULL, payload is malformed JSON;
    -500..0: department NULL, payload has ``id`` as non-numeric text;
    0..500: id NULL, payload lacks ``id``;
    500..700 / 700..900 / 900..1000: ``code`` is '', '  ', 's';
    otherwise a normal record.  ``code`` is the market segment elsewhere.
    """
    j = _customer_nation(spark, sf_dir, extra=("c_acctbal",))
    bal = F.col("c_acctbal")
    location = F.when(bal < -500, F.lit(None)).otherwise(case_lookup(F.col("n_regionkey"), REGION_LOCATION))
    department = F.when((bal >= -500) & (bal < 0), F.lit(None)).otherwise(
        case_lookup(F.col("c_mktsegment"), SEGMENT_DEPARTMENT))
    id_ = F.when((bal >= 0) & (bal < 500), F.lit(None)).otherwise(F.col("c_custkey"))
    code = (F.when((bal >= 500) & (bal < 700), F.lit(""))
            .when((bal >= 700) & (bal < 900), F.lit("  "))
            .when((bal >= 900) & (bal < 1000), F.lit("s"))
            .otherwise(F.col("c_mktsegment")))
    rec = record_struct(location, F.col("n_name"), id_, F.col("c_nationkey").cast("bigint"), department)
    base = j.select(F.col("c_custkey").alias("key"), bal.alias("balance"), code.alias("code"), rec.alias("f"))
    good = F.to_json("f")
    bal = F.col("balance")
    payload = (F.when(bal < -500, F.expr("substring(to_json(f), 1, length(to_json(f)) - 1)"))
               .when(bal < 0, F.regexp_replace(good, '"id":([0-9]+)', '"id":"x$1"'))
               .otherwise(good))
    return base.select("key", "balance", "code", "f.*", payload.alias("payload"), F.col("f").alias("struct_payload"))
