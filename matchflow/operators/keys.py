"""Keys resolved to headers of the same document, through inverted indexes over characters and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchflow.operators.audit import key_tokens
from matchflow.operators.written import checkpointed

GRAM = 3
#: Different keys, or headers, of a document whose keys meet all of its headers.
DOCUMENT_TEXTS = 64


def in_shuffle(df: DataFrame) -> DataFrame:
    """df as a join's side that is never broadcast: Spark takes a table of equal texts for as small as its files, and parts of texts for as many as the texts."""
    return df.hint("merge")


def low(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def contained(small: DataFrame, large: DataFrame) -> DataFrame:
    """doc_id, s, l: the texts of small (doc_id, s) that stand inside texts of large (doc_id, l) of the same document; empty ones are in none.

    A text can only stand where all of its three-letter parts (a shorter one: itself) do; it meets the texts that
    have the rarest of them, so a document of many texts is split by parts, and no text meets all.
    """
    some = large.filter("l <> ''").distinct()
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("l")), lambda i: F.array(*(F.substring(F.col("l"), i, F.lit(n)) for n in range(1, GRAM + 1)))))
    have = some.select("doc_id", "l", F.explode(F.array_distinct(parts)).alias("gram"))
    counted = have.groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    size = F.least(F.length("s"), F.lit(GRAM))
    own = F.transform(F.sequence(F.lit(1), F.length("s") - size + 1), lambda i: F.substring(F.col("s"), i, size))
    asked = small.filter("s <> ''").distinct().select("doc_id", "s", F.explode(F.array_distinct(own)).alias("gram")).join(in_shuffle(counted), ["doc_id", "gram"], "left")
    rarest = asked.groupBy("doc_id", "s").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    return rarest.join(in_shuffle(have), ["doc_id", "gram"]).filter(F.contains("l", "s")).select("doc_id", "s", "l")


def first_header(pairs: DataFrame, headers: DataFrame) -> DataFrame:
    """Of pairs of lowered texts (doc_id, k, h) each k's header of the least place."""
    met = pairs.join(in_shuffle(headers.select("doc_id", F.col("low").alias("h"), "header", "place")), ["doc_id", "h"])
    return met.groupBy("doc_id", "k").agg(F.min_by("header", F.struct("place", "header")).alias("header"))


def indexed(headers: DataFrame) -> DataFrame:
    """Each header once, at its first place."""
    return headers.groupBy("doc_id", "header").agg(F.min("place").alias("place")).withColumn("low", low("header"))


def containing_headers(keys: DataFrame, headers: DataFrame) -> DataFrame:
    """doc_id, key, header: the first header that a key stands in, or that stands in it (an empty one does); unmatched keys are left out."""
    once, asked = indexed(headers), keys.select("doc_id", "key").distinct().withColumn("k", low("key")).filter("k <> ''")
    k, h = asked.select("doc_id", "k"), once.select("doc_id", "low")
    inside = contained(k.withColumnRenamed("k", "s"), h.withColumnRenamed("low", "l")).select("doc_id", F.col("s").alias("k"), F.col("l").alias("h"))
    around = contained(h.withColumnRenamed("low", "s"), k.withColumnRenamed("k", "l")).select("doc_id", F.col("l").alias("k"), F.col("s").alias("h"))
    empty = k.join(in_shuffle(h.filter("low = ''").distinct()), "doc_id").select("doc_id", "k", F.col("low").alias("h"))
    return first_header(inside.union(around).union(empty).distinct(), once).join(in_shuffle(asked), ["doc_id", "k"]).select("doc_id", "key", "header")


def met_by_index(keys: DataFrame, headers: DataFrame, least: float) -> DataFrame:
    """doc_id, key, header of documents of many texts.

    Equal texts meet by hash, contained ones by their rarest letters, and a key that needs n of its m words
    to agree meets the headers that have one of its m - n + 1 rarest, so no key meets all headers of its document.
    """
    once = checkpointed(indexed(headers))
    asked = checkpointed(keys.select("doc_id", "key").distinct().withColumn("k", low("key")).filter("k <> ''"))
    texts = asked.select("doc_id", "k").distinct()
    equal = first_header(texts.withColumn("h", F.col("k")), once)
    equal = checkpointed(equal)
    rest = checkpointed(texts.join(in_shuffle(equal), ["doc_id", "k"], "left_anti"))
    h = once.select("doc_id", "low").distinct()
    inside = contained(rest.withColumnRenamed("k", "s"), h.withColumnRenamed("low", "l")).select("doc_id", F.col("s").alias("k"), F.col("l").alias("h"))
    begun = contained(h.withColumnRenamed("low", "s"), rest.withColumnRenamed("k", "l")).filter(F.startswith("l", "s")).select("doc_id", F.col("l").alias("k"), F.col("s").alias("h"))
    empty = rest.join(in_shuffle(h.filter("low = ''")), "doc_id").select("doc_id", "k", F.col("low").alias("h"))
    within = checkpointed(first_header(inside.union(begun).union(empty), once))
    left = rest.join(in_shuffle(within), ["doc_id", "k"], "left_anti").withColumn("kt", key_tokens("k")).filter(F.size("kt") > 0)
    have = once.select("doc_id", "header", "place", key_tokens("header").alias("ht")).filter(F.size("ht") > 0)
    posted = have.select("doc_id", "header", "place", "ht", F.explode("ht").alias("token"))
    counted = posted.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    words = left.select("doc_id", "k", "kt", F.explode("kt").alias("token")).join(in_shuffle(counted), ["doc_id", "token"], "left")
    place = F.row_number().over(Window.partitionBy("doc_id", "k").orderBy(F.coalesce("n", F.lit(0)), "token"))
    spare = F.size("kt") - F.ceil(F.size("kt") * F.lit(least) - 1e-9) + 1
    rare = words.withColumn("__at", place).filter((F.col("__at") <= spare) & F.col("n").isNotNull()).select("doc_id", "k", "kt", "token")
    met = rare.join(in_shuffle(posted), ["doc_id", "token"]).select("doc_id", "k", "header", "place", (F.size(F.array_intersect("kt", "ht")) / F.size("kt")).alias("overlap"))
    best = F.min_by("header", F.struct((-F.col("overlap")).alias("o"), F.length("header").alias("n"), "place"))
    overlapping = met.filter(F.col("overlap") >= least).groupBy("doc_id", "k").agg(best.alias("header"))
    return equal.union(within).union(overlapping).join(in_shuffle(asked), ["doc_id", "k"]).select("doc_id", "key", "header")


def rank_of(least: float) -> Column:
    """What orders the headers of a key in a joined row (k, low, kt, ht, header, place), the least first; null where they do not match."""
    share = F.when(F.size("kt") > 0, F.size(F.array_intersect("kt", "ht")) / F.size("kt")).otherwise(0.0)
    held = F.contains("low", "k") | F.startswith("k", "low")
    rank = lambda tier, o, n: F.struct(F.lit(tier).alias("tier"), o.cast("double").alias("o"), n.cast("int").alias("n"), "place", "header")
    zero = F.lit(0)
    return F.when(F.col("low") == F.col("k"), rank(0, zero, zero)).when(held, rank(1, zero, zero)).when(share >= least, rank(2, -share, F.length("header")))


def met_in_document(keys: DataFrame, headers: DataFrame, least: float) -> DataFrame:
    """doc_id, key, header of documents of few texts: keys (doc_id, key) meet all headers (doc_id, header, place) of their document."""
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(tasks, "doc_id")
    k = dealt(keys).withColumn("k", low("key")).withColumn("kt", key_tokens("k"))
    h = dealt(headers).withColumn("low", low("header")).withColumn("ht", key_tokens("header"))
    ranked = k.join(in_shuffle(h), "doc_id").withColumn("rank", rank_of(least)).filter("rank is not null")
    return ranked.groupBy("doc_id", "key").agg(F.min("rank").alias("rank")).select("doc_id", "key", "rank.header")


def resolve_keys(keys: DataFrame, headers: DataFrame, least: float = 0.60) -> DataFrame:
    """Each key's header: equal, else the first that contains it or that it begins with, else the best overlap of words.

    keys: doc_id, key. headers: doc_id, header, place. Unmatched and empty keys get a null header; repeated keys
    each get theirs. In a document of at most DOCUMENT_TEXTS different keys and as many headers they all meet; documents of more
    go by inverted indexes, so that no key meets all headers of a large document.
    """
    once = headers.filter("doc_id is not null").groupBy("doc_id", "header").agg(F.min("place").alias("place"))
    asked = keys.filter("doc_id is not null").select("doc_id", "key").distinct().filter(low("key") != "")
    many = lambda df: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > DOCUMENT_TEXTS).select("doc_id")
    large = checkpointed(many(once).union(many(asked)).distinct())
    if large.isEmpty():
        found = met_in_document(asked, once, least)
    else:
        of = lambda df, how: df.join(in_shuffle(large), "doc_id", how)
        found = met_in_document(of(asked, "left_anti"), of(once, "left_anti"), least).union(met_by_index(of(asked, "left_semi"), of(once, "left_semi"), least))
    return keys.join(in_shuffle(found), ["doc_id", "key"], "left")
