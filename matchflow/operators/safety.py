"""Redaction of nested data, and the text functions under SQL names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchflow.functions.text import redact_pii

TOO_DEEP = "[TRUNCATED]"


def redacted(c: Column, kind: T.DataType, name: Column | None, email: Column | None, depth: int) -> Column:
    """A column with every string inside redacted; other values are kept, what lies deeper than `depth` becomes a marker (strings) or null."""
    if isinstance(kind, T.StringType):
        return F.when(c.isNotNull(), redact_pii(c, name, email) if depth >= 0 else F.lit(TOO_DEEP))
    if not isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return c
    if depth <= 0:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: redacted(x, kind.elementType, name, email, depth - 1))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: redacted(v, kind.valueType, name, email, depth - 1))
    return F.when(c.isNotNull(), F.struct(*(redacted(c[f.name], f.dataType, name, email, depth - 1).alias(f.name) for f in kind)))


def redact_struct(df: DataFrame, columns: list[str], name: Column | None = None, email: Column | None = None, depth: int = 10) -> DataFrame:
    """df with the strings inside the given columns redacted, at any nesting up to depth."""
    return df.withColumns({c: redacted(F.col(c), df.schema[c].dataType, name, email, depth) for c in columns})


def register_sql(spark: SparkSession) -> None:
    """SQL functions for the expressions that queries ask for most: plain SQL bodies, so Catalyst sees through them."""
    for name, args, returns, body in (
        ("upper_median", "xs ARRAY<DOUBLE>", "DOUBLE", "element_at(sort_array(xs), cast(size(xs) div 2 + 1 as int))"),
        ("score_tier", "score DOUBLE", "STRING", "case when score >= 80 then 'green' when score >= 60 then 'amber' else 'red' end"),
        ("doc_fingerprint", "text STRING", "STRING", "substring(sha2(text, 256), 1, 16)"),
        ("search_title", "title STRING", "STRING", "trim(split_part(title, ',', 1))"),
        ("user_key", "email STRING", "STRING", "lower(trim(email))"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
