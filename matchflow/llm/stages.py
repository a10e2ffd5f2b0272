"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

All but the last return the columns of documents. A stage decides for every row it is given, by its whole text;
null texts count as empty, an empty table gives an empty one, and columns beside those of documents are left out.
Only near-dedup joins rows by id; the others keep or drop each row, repeated ones and those without an id too, on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.llm.common import DOCUMENT_COLUMNS, checkpointed, table


def written(docs: DataFrame) -> DataFrame:
    """docs as Parquet in the shared folder, read again."""
    return checkpointed(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go (an empty text scores as one without matches, and stays); the model learns from the labelled documents of the tables."""
    from matchflow.llm.toxicity import fit_toxicity, score_toxicity

    model = fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, keep=DOCUMENT_COLUMNS).filter("score < 0.5").select(*DOCUMENT_COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; of its rows, if the id is repeated, the least.

    Rows without an id stay, as nothing tells them apart; texts without words are copies of each other.
    """
    from matchflow.llm.simhash import near_duplicate_components

    groups = near_duplicate_components(docs)
    kept = groups.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("__rows"))
    left = docs.select(*DOCUMENT_COLUMNS).join(kept, "doc_id")
    repeated = left.filter("__rows > 1").groupBy("doc_id").agg(F.min(F.struct(*DOCUMENT_COLUMNS)).alias("__least")).select("__least.*")
    without = docs.filter("doc_id is null").select(*DOCUMENT_COLUMNS)
    return left.filter("__rows = 1").select(*DOCUMENT_COLUMNS).unionByName(repeated).unionByName(without)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within its error budget, go; empty texts hold none, nor does an empty benchmark."""
    from matchflow.llm.decontamination import find_leaks

    marked = find_leaks(docs, table(spark, sf_dir, "benchmark"), keep=DOCUMENT_COLUMNS)
    return marked.filter(F.size("leaks") == 0).select(*DOCUMENT_COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret's characters become [SECRET], overlapping ones one mask; every row stays, null texts null."""
    from matchflow.llm.secret_scan import find_secrets, masked

    found = find_secrets(docs, keep=DOCUMENT_COLUMNS)
    return masked(found).select(*DOCUMENT_COLUMNS)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids with the end id (of an empty text that alone), their number, and the text decoded from them, a row each."""
    from matchflow.llm.pieces import pieces_round_trip
    from matchflow.llm.queries import PIECE_BPE, tokenizer

    decoded = pieces_round_trip(docs, tokenizer(PIECE_BPE))
    return decoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.col("decoded").alias("text"))
