"""The registry that query modules fill, and the driver tables as the operators' inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that gives the same rows."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Events as call traces; the same text runs in Spark and in DuckDB.
TRACES = """
    SELECT event_id, ts, cast(cast(ts AS date) AS string) AS run_id, cast(user_id AS string) AS job_id, event_type AS agent,
           CASE k % 3 WHEN 0 THEN 'gemini' WHEN 1 THEN 'groq-llama' ELSE 'local' END AS provider, concat('m', cast(k % 5 AS string)) AS model,
           k * 40 AS prompt_chars, k * 31 + 10 AS response_chars, cast(floor(value) AS bigint) AS total_tokens, value * 10 AS duration_ms,
           k % 20 = 0 AS truncated, CASE WHEN event_type = 'error' THEN 'rate limit' END AS error, k * 8 AS max_tokens_requested, k % 7 AS key_idx, k
    FROM (SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k FROM events) AS e"""

#: Orders as application runs.
RUNS = """
    SELECT o_orderkey AS run_id, o_custkey AS user_id, o_orderpriority AS experience_level, o_orderstatus AS status,
           cast(floor(o_totalprice / 5000) AS int) AS score, o_orderdate AS ts, o_orderkey % 4 + 1 AS attempts,
           CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS applied
    FROM orders"""

#: Events as product events.
EVENTS = "SELECT event_id, ts, cast(user_id AS string) AS distinct_id, event_type AS event, value, props FROM events"


def bound(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    """A driver table under one of the renamings above."""
    text = sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(text, **{name: table(spark, sf_dir, name)})


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, TRACES, "events")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, RUNS, "orders")


def product_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, EVENTS, "events")

TITLES = "Senior Product Manager|Lead Data Scientist|Junior Backend Engineer|Director, Operations|Principal Engineer|Product Manager|VP Sales|Engineering Manager|Graduate Analyst|Software Engineer, Platform|Staff Engineer|Head of Data|Consultant|Chef|Sr. QA Engineer|Associate Designer".split("|")
ASKS = "5+ years of work|minimum 8 years here|At least 3 years of it|3-7 years asked|10 or more years|2 to 4 years needed|no figure at all|12 years needed, 3 years liked|40 years old firm|1 year of practice".split("|")
PLACES = "Dublin, Ireland|London, UK|Berlin, Germany|New York, USA|Kyiv, Ukraine|Remote|Madrid Spain|".split("|")
LABELS = "Fresher (0-1 yrs)|Entry / Associate|Mid-level|Senior (6-10)|Lead / Manager|Director / VP+|Unknown".split("|")


def pick(expr: str, values: list[str]) -> str:
    """SQL that picks a text by an expression's remainder."""
    return f"CASE ({expr}) % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


#: Orders as job postings and as candidates.
POSTINGS = f"""SELECT o_orderkey AS seq, {pick('o_orderkey', TITLES)} AS title, concat('c', cast(o_custkey % 40 AS string)) AS company, {pick('o_custkey', PLACES)} AS location,
    CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('https://Jobs.example.com/p/', cast(o_orderkey % 3000 AS string), CASE o_orderkey % 3 WHEN 0 THEN '/?utm_source=x&id=1' WHEN 1 THEN '#top' ELSE '/' END) END AS url,
    concat('We look for someone with ', {pick('o_orderkey + o_custkey', ASKS)}, ' in ', o_orderpriority) AS description, {pick('o_custkey', ['LinkedIn', 'Indeed', 'Glassdoor'])} AS source, o_orderstatus AS job_type FROM orders"""
CANDIDATES = f"""SELECT o_orderkey AS candidate_id, {pick('o_orderkey', LABELS)} AS experience_level FROM orders WHERE o_orderkey % 100 = 0"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, POSTINGS, "orders")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, CANDIDATES, "orders")
