"""Document quality by co-training of two views.

The *content* view sees what a text says and how (character classes, repetition of words, lines and
phrases, hashed words); the *metadata* view sees the page around it (source, language, stored length,
number and length of lines). Each view's classifier starts from the labelled documents; in every round
each gives the other the unlabelled documents that it is surest of, keeping the classes' shares, and
both are fitted again; how sure a view is, is calibrated on labelled documents that neither was fitted on, so that
a view that knows little teaches little. At the end each view's scores are calibrated on labelled documents that neither
was fitted on, and the two are combined by a logistic model fitted on those.

Both views are scored over all documents in every round, in Spark; pseudo-labels are chosen by
quantiles of those scores. Classifiers are fitted on bounded samples: at most FIT_ROWS labelled and
POOL_ROWS pseudo-labelled rows, chosen by a hash of the id.

Results: every row gets a score in 0 to 1 and keep = score >= 0.5; null and empty texts have zero
features; null metadata is a value of its own; with no labels of one of the classes every score is the
share of good ones (1 with no labels at all); repeated ids get a row each; an empty table gives none; texts of any
length are measured whole; rows that tie at a quantile are pseudo-labelled alike; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchflow.llm.common import checkpointed, in_pandas
from matchflow.llm.toxicity import fit_logistic

FIT_ROWS, POOL_ROWS = 20_000, 20_000
ROUNDS = 3
#: Share of the documents that a view labels for the other in a round, and how sure it has to be.
SHARE, SURE = 0.1, 0.9
VIEWS = ("content", "metadata")
WORD_BUCKETS, SOURCE_BUCKETS = 32, 16


def content_view(text: str) -> list[float]:
    """What the text says: 12 measures and hashed word shares."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * (12 + WORD_BUCKETS)
    count = Counter(words)
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    digits = sum(map(str.isdigit, text))
    spaces = sum(map(str.isspace, text))
    plain = sum(map(text.count, ".,"))
    lines = text.split("\n")
    total = len(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    hashed = np.zeros(WORD_BUCKETS)
    for word, c in count.items():
        hashed[zlib.crc32(word.encode()) % WORD_BUCKETS] += c
    return [
        letters / n,
        upper / n,
        digits / n,
        (n - letters - digits - spaces - plain) / n,
        plain / total,
        len(count) / total,
        count.most_common(1)[0][1] / total,
        len(pairs) / max(1, total - 1),
        len(set(lines)) / len(lines),
        np.log1p(total) / 10,
        letters / total / 10,
        sum(w.isalpha() for w in count) / len(count),
        *(np.sqrt(hashed / total)).tolist(),
    ]


def metadata_view(text: str, source: str | None, lang: str | None, n_chars: float) -> list[float]:
    """The page around the text: where it comes from, in what language, how long, in how many lines."""
    out = [0.0] * (6 + 2 * SOURCE_BUCKETS)
    n_chars = 0.0 if n_chars is None or n_chars != n_chars else max(0.0, float(n_chars))
    lines = text.count("\n") + 1
    out[:6] = np.log1p(n_chars) / 10, np.log1p(lines) / 5, np.log1p(n_chars / lines) / 10, float(n_chars < 200), float(abs(n_chars - len(text)) > 0), len(text.encode()) / (1 + len(text)) - 1
    out[6 + zlib.crc32(str(source).encode()) % SOURCE_BUCKETS] = 1.0
    out[6 + SOURCE_BUCKETS + zlib.crc32(str(lang).encode()) % SOURCE_BUCKETS] = 1.0
    return out


def views(docs: DataFrame) -> DataFrame:
    """row (an id of the row's own), doc_id, content and metadata, the latter two as arrays of floats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = pdf.text.fillna("")
            yield pd.DataFrame(
                {
                    "doc_id": pdf.doc_id,
                    "content": [np.asarray(content_view(t), np.float32) for t in text],
                    "metadata": [np.asarray(metadata_view(*x), np.float32) for x in zip(text, pdf.source, pdf.lang, pdf.n_chars, strict=True)],
                }
            )

    rows = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("double"))
    return in_pandas(rows, run, ("doc_id",), "content array<float>, metadata array<float>")


def hash_sample(df: DataFrame, rows: int, salt: str, total: int | None = None) -> DataFrame:
    """About `rows` rows of df (all, if it has fewer), chosen by a hash of doc_id."""
    total = df.count() if total is None else total
    share = min(1.0, rows / max(1, total))
    return df.filter(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < int(share * 1_000_000))


def fitted(x: list, y: np.ndarray) -> np.ndarray:
    """Weights (the bias last) of a logistic model."""
    x = np.array(x, float)
    return fit_logistic(x, y, np.zeros(x.shape[1] + 1), strength=0.3)


def scored(df: DataFrame, content: np.ndarray, metadata: np.ndarray) -> DataFrame:
    """df with content_logit and metadata_logit, by array functions."""

    def logit(view: str, weights: np.ndarray):
        terms = F.zip_with(view, F.array(*map(F.lit, weights[:-1].tolist())), lambda a, b: a * b)
        return F.aggregate(terms, F.lit(float(weights[-1])), lambda a, b: a + b)

    return df.withColumn("content_logit", logit("content", content)).withColumn("metadata_logit", logit("metadata", metadata))


def one_of_each(table: DataFrame, chosen: DataFrame, *columns: str) -> DataFrame:
    """The rows of the ids in chosen (a bounded number, told apart) with columns of the table; of repeated ids the least row."""
    least = F.min(F.struct(*columns)).alias("least")
    mine = table.select("doc_id", *columns).join(chosen.select("doc_id"), "doc_id").groupBy("doc_id").agg(least).select("doc_id", "least.*")
    return mine.join(chosen, "doc_id")


def sure_ones(pool: DataFrame, logit: str, positive_share: float) -> DataFrame:
    """The rows that a view is surest of, and a pseudo-label y.

    The classes keep their shares: where a view is sure of too few rows of one class, it gives fewer of the other.
    """
    low, high = pool.approxQuantile(logit, [SHARE * (1 - positive_share), 1 - SHARE * positive_share], 0.001)
    least = float(np.log(SURE / (1 - SURE)))
    label = F.when(F.col(logit) >= max(high, least), 1).when(F.col(logit) <= min(low, -least), 0)
    sure = pool.withColumn("y", label).filter("y is not null")
    found = sure.agg(F.count_if(F.col("y") == 1).alias("good"), F.count_if(F.col("y") == 0).alias("bad")).first()
    whole = min(found.good / positive_share, found.bad / (1 - positive_share))
    given = {1: whole * positive_share / max(1, found.good), 0: whole * (1 - positive_share) / max(1, found.bad)}
    chance = F.pmod(F.xxhash64("doc_id", F.lit("class")), F.lit(1_000_000))
    return sure.filter(chance < F.when(F.col("y") == 1, round(given[1] * 1e6)).otherwise(round(given[0] * 1e6)))


def quality_scores(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, content_score, metadata_score, score and keep of every document."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    n_known = known.count()
    share = known.agg(F.avg("quality")).first()[0] if n_known else 1.0
    same = F.lit(float(share))
    constant = docs.select("doc_id", same.alias("content_score"), same.alias("metadata_score"), same.alias("score"), (same >= 0.5).alias("keep"))
    if share in (0.0, 1.0):
        return constant
    table = checkpointed(views(docs))
    # about FIT_ROWS rows of two numbers, whatever the size of the tables
    sample = F.broadcast(hash_sample(known, FIT_ROWS, "fit", n_known))
    rows = one_of_each(table, sample, *VIEWS).withColumn("aside", F.pmod(F.crc32(F.concat(F.lit("aside"), F.col("doc_id"))), F.lit(4)) == 0).toPandas()
    if rows.quality.nunique() < 2:  # the labels are of other documents
        return constant
    fit, aside = rows[~rows.aside], rows[rows.aside]
    if fit.quality.nunique() < 2 or aside.quality.nunique() < 2:
        fit = aside = rows
    names = VIEWS
    given = {v: (fit[v].tolist(), fit.quality.to_numpy(float)) for v in names}
    weights = {v: fitted(*given[v]) for v in names}
    truth = aside.quality.to_numpy(float)

    def calibrations() -> dict[str, np.ndarray]:
        """For each view slope and bias that make its logits true on rows that neither view was fitted on."""
        logits = {v: np.array(aside[v].tolist(), float) @ weights[v][:-1] + weights[v][-1] for v in names}
        return {v: fit_logistic(logits[v][:, None], truth, np.array([1.0, 0.0])) for v in names}

    pool = table.join(sample.select("doc_id"), "doc_id", "left_anti")
    for k in range(rounds):
        scale = calibrations()
        calibrated = [(F.col(f"{v}_logit") * float(scale[v][0]) + float(scale[v][1])).alias(f"{v}_logit") for v in names]
        measured = checkpointed(scored(pool, weights["content"], weights["metadata"]).select("doc_id", *calibrated))
        if measured.isEmpty():
            break
        for teacher, student in (names, names[::-1]):
            chosen = F.broadcast(hash_sample(sure_ones(measured, f"{teacher}_logit", share).groupBy("doc_id").agg(F.min("y").alias("y")), POOL_ROWS, f"{teacher}{k}"))
            more = one_of_each(table, chosen, student).toPandas()
            x, y = given[student]
            if len(more):
                weights[student] = fitted([*x, *more[student].tolist()], np.append(y, more.y.to_numpy(float)))
    # calibration and combination, on rows that neither view was fitted on
    logits = np.column_stack([np.array(aside[v].tolist(), float) @ weights[v][:-1] + weights[v][-1] for v in names])
    scale = list(calibrations().values())
    both = fit_logistic(logits, truth, np.array([0.5, 0.5, 0.0]))
    chance = lambda z: 1 / (1 + F.exp(-z))
    c, m = F.col("content_logit"), F.col("metadata_logit")
    score = chance(c * float(both[0]) + m * float(both[1]) + float(both[2]))
    return scored(table, weights["content"], weights["metadata"]).select(
        "doc_id",
        chance(c * float(scale[0][0]) + float(scale[0][1])).alias("content_score"),
        chance(m * float(scale[1][0]) + float(scale[1][1])).alias("metadata_score"),
        score.alias("score"),
        (score >= 0.5).alias("keep"),
    )
