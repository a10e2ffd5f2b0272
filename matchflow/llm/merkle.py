"""Merkle fingerprints of documents, in DataFrame functions alone.

A text is a tree: sections hold paragraphs, paragraphs hold clauses. A section begins at a line after a
blank one, at a heading mark, or at a line whose first letter is one of SECTION_LETTERS (so boundaries
depend on content, and an edit moves none but its own). Those letters begin about a third of the lines of running
text; which they are is arbitrary, but has to stay, as with the bit mask of content-defined chunking: texts without
blank lines or headings would otherwise be one section. A paragraph is a line; a clause ends at a
punctuation mark before a space. A node's hash is the SHA-256 of its children's hashes, a clause's that
of its text. The fingerprint writes the root in full, then the tree with the first eight digits of each
node: `root:section=paragraph.clauseclause,paragraph.clause;section=...`. Equal roots mean equal texts;
where two fingerprints differ, the differing branches say in which section, paragraph and clause.

Results: a null text counts as empty: one empty section, paragraph and clause. Texts of any length are
used whole. Repeated ids keep their rows, ordered by text; null ids come before all others. An empty table gives no
rows, and the only row of a table is followed by itself. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchflow.llm.common import id_ranges

SECTION_LETTERS = "AEIOULRT"
#: Rows of one range of ids.
BUCKET_ROWS = 2000
#: Digits of a hash inside the tree.
SHORT = 8

_CUT, _ESCAPE = "\u0001", "\u0002"


def clauses(text: Column) -> Column:
    """array<array<array<string>>>: the sections, paragraphs and clauses of a text."""
    # the mark itself, where a text has it, is written otherwise, so that unequal texts never get equal trees
    plain = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(f"{_ESCAPE}b")), F.lit(_CUT), F.lit(f"{_ESCAPE}a"))
    marked = F.regexp_replace(plain, rf"\n(\n|#|[{SECTION_LETTERS}])", f"\n{_CUT}$1")
    sections = F.split(marked, f"\n{_CUT}", -1)
    clause = lambda p: F.split(F.regexp_replace(p, r"([^\p{L}\p{N}\s]) ", f"$1{_CUT}"), _CUT, -1)
    return F.transform(sections, lambda s: F.transform(F.split(s, "\n", -1), clause))


def hashed_tree(text: Column) -> Column:
    """The clauses' hashes, in the same shape."""
    return F.transform(clauses(text), lambda s: F.transform(s, lambda p: F.transform(p, lambda c: F.sha2(c, 256))))


def with_fingerprint(df: DataFrame, text: str, fingerprint: str, leaves: str) -> DataFrame:
    """df with the fingerprint of a text column, and the short hashes of its clauses as an array."""
    short = lambda h: F.substring(h, 1, SHORT)
    paragraph = lambda p: F.sha2(F.array_join(p, ""), 256)
    section = lambda s: F.sha2(F.array_join(F.transform(s, paragraph), ""), 256)
    tree = df.withColumn("__tree", hashed_tree(F.col(text)))
    nodes = tree.withColumn("__sections", F.transform("__tree", section)).withColumn(
        "__lines",
        F.transform("__tree", lambda s: F.array_join(F.transform(s, lambda p: F.concat(short(paragraph(p)), F.lit("."), F.array_join(F.transform(p, short), ""))), ",")),
    )
    written = F.concat(
        F.sha2(F.array_join("__sections", ""), 256),
        F.lit(":"),
        F.array_join(F.zip_with("__sections", "__lines", lambda h, lines: F.concat(short(h), F.lit("="), lines)), ";"),
    )
    out = nodes.withColumn(fingerprint, written).withColumn(leaves, F.array_distinct(F.transform(F.flatten(F.flatten("__tree")), short)))
    return out.drop("__tree", "__sections", "__lines")


def likeness(a: str, b: str) -> Column:
    """Share of two fingerprints' distinct clauses that both have (Dice), from 0 to 1."""
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def with_next_text(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text, that of the next document by ascending doc_id (after the last: the first).

    Ids are cut into ranges of about BUCKET_ROWS rows at their quantiles. Each range gets a copy of the
    first document behind it, so the texts move once and no window spans the table.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    placed = id_ranges(rows, "key", rows.count() // BUCKET_ROWS, "bucket").withColumn("guest", F.lit(False))
    # a row for each range
    ranges = [(r.bucket, r.least) for r in placed.groupBy("bucket").agg(F.min("key").alias("least")).orderBy("bucket").collect()]
    if not ranges:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"))
    guests = F.broadcast(docs.sparkSession.createDataFrame([(ranges[(i + 1) % len(ranges)][1], host) for i, (host, _) in enumerate(ranges)], "key long, host int"))
    copies = placed.join(guests, "key").select("doc_id", "text", "key", F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    order = Window.partitionBy("bucket").orderBy("guest", "key", "text")
    whole = placed.unionByName(copies).withColumn("next_text", F.lead("text").over(order))
    return whole.filter(~F.col("guest")).select("doc_id", "text", "next_text")


def edited_text(text: str, following: str) -> Column:
    """text with its last floor(n/2) code points replaced by the first as many of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), F.length(text) - half), F.substring(F.col(following), F.lit(1), half))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with the likeness to the edited and to the next text."""
    rows = with_next_text(docs).withColumn("edited", edited_text("text", "next_text"))
    rows = with_fingerprint(rows, "text", "fingerprint", "leaves")
    rows = with_fingerprint(rows, "edited", "edited_fingerprint", "edited_leaves")
    short_leaf = F.array_distinct(F.transform(F.flatten(F.flatten(hashed_tree(F.col("next_text")))), lambda h: F.substring(h, 1, SHORT)))
    rows = rows.withColumn("next_leaves", short_leaf)
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("leaves", "edited_leaves").alias("near_edited"),
        likeness("leaves", "next_leaves").alias("near_next"),
    )
