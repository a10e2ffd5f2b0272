"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from matchflow.operators.written import checkpointed, discarded, drop_intermediates, shared_folder  # noqa: F401

#: The five columns of a documents table, as the pipeline hands them from stage to stage.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Rows of one Arrow batch: whole texts travel in batches, so a batch stays a few MB.
ROWS_PER_BATCH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a DataFrame, whatever file system the path is on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    # Python workers of a local session import this package from where the driver did
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty), nothing else: the heavy jobs read two columns."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def crc_remainder(col: Column | str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo mod: the contracts' held-out rule."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % mod


def in_pandas(df: DataFrame, run: Callable, keep: Sequence[str], made: str) -> DataFrame:
    """The columns in keep, as they are in df, and those that run adds (`made`, as a schema), by mapInPandas.

    Integers in keep travel as text: pandas holds a column with nulls as floats, which tell no large integers apart.
    """
    as_text = {c: df.schema[c].dataType for c in keep if isinstance(df.schema[c].dataType, IntegralType)}
    sent = df.withColumns({c: F.col(f"`{c}`").cast("string") for c in as_text})
    fields = [f"`{c}` {'string' if c in as_text else df.schema[c].dataType.simpleString()}" for c in keep]
    out = sent.mapInPandas(run, ", ".join([*fields, made]))
    return out.withColumns({c: F.col(f"`{c}`").cast(kind) for c, kind in as_text.items()})


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of a text column, one aggregate."""
    return int(docs.agg(F.sum(F.octet_length(col))).first()[0] or 0)


def partitions_for(total_bytes: int, bytes_each: int, least: int = 1) -> int:
    return max(least, -(-total_bytes // bytes_each))


def with_document_columns(docs: DataFrame, columns: Sequence[str] = DOCUMENT_COLUMNS) -> DataFrame:
    return docs.select(*columns)


def id_ranges(rows: DataFrame, col: str, ranges: int, name: str) -> DataFrame:
    """rows with an int column that numbers about equally filled ranges of an id column, ascending; nulls are in the first.

    The bounds are quantiles; at most 100,000 of them are held by the driver.
    """
    ranges = min(ranges, 100_000)
    at = F.coalesce(F.col(col).cast("double"), F.lit(-float("inf")))
    bounds = rows.filter(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("at")).approxQuantile("at", [k / ranges for k in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    inner = sorted(set(bounds))
    if not inner:
        return rows.withColumn(name, F.lit(0))
    place = Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol="__at", outputCol="__range")
    return place.transform(rows.withColumn("__at", at)).withColumn(name, F.col("__range").cast("int")).drop("__at", "__range")
