"""Documents to lines, sections, roles, bullets, chunks and quality reports.

Windows run within one document's lines; line order is always an explicit column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchflow.functions import structure as S
from matchflow.functions.text import ascii_ratio, let
from matchflow.operators.written import by_row_or_key


def doc_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("line_no", "text"))


def assign_sections(lines: DataFrame) -> DataFrame:
    """kind and section_no of each line; heading lines open a section, what comes before the first is `header`."""
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("heading", S.classify_heading("text"))
    return out.withColumns({"kind": F.coalesce(F.last("heading", ignorenulls=True).over(upto), F.lit("header")), "section_no": F.count("heading").over(upto).cast("int")})


def coalesce_bullets(lines: DataFrame) -> DataFrame:
    """Lines that go on after a bullet are joined to it; blank lines and headings end it."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    blank, bullet = F.trim(F.col("text")) == "", S.is_bullet("text")
    kind = F.when(blank, 0).when(bullet, 1).when(S.classify_heading("text").isNotNull(), 0).otherwise(2)
    marked = lines.withColumn("__kind", kind)
    # a plain line continues if the last line that is not plain was a bullet
    before = F.last(F.when(F.col("__kind") < 2, F.col("__kind")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("__starts", ~((F.col("__kind") == 2) & (F.coalesce(before, F.lit(0)) == 1)))
    islands = marked.withColumn("__island", F.sum(F.col("__starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct("line_no", F.when(F.col("__starts"), F.col("text")).otherwise(F.trim(F.col("text"))).alias("text"))))
    return islands.groupBy("doc_id", "__island").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text")).drop("__island")


def drop_consecutive_dups(lines: DataFrame) -> DataFrame:
    """Lines without those equal to the last line before them that is not blank."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.trim(F.col("text")) != "", F.col("text")), ignorenulls=True).over(w)
    return lines.withColumn("__last", last).filter("trim(text) = '' or __last is null or text <> __last").drop("__last")


def assign_roles(lines: DataFrame) -> DataFrame:
    """role_no of the lines in experience and projects: a plain line after a bullet, or first in its section, opens a role; bullets before any role have role 0."""
    body = lines.filter("heading is null and trim(text) <> '' and kind in ('experience', 'projects')").withColumn("bullet", S.is_bullet("text"))
    w = Window.partitionBy("doc_id", "section_no").orderBy("line_no")
    starts = ~F.col("bullet") & F.coalesce(F.lag("bullet").over(w), F.lit(True))
    return body.withColumn("opens", starts).withColumn("role_no", F.sum(F.col("opens").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def role_table(roles: DataFrame) -> DataFrame:
    """doc_id, section_no, kind, role_no, header and the bullets in order; roles without bullets are left out."""
    entry = F.struct("line_no", S.strip_bullet("text").alias("text"))
    out = roles.groupBy("doc_id", "section_no", "kind", "role_no").agg(
        F.coalesce(F.max(F.when(F.col("opens"), F.trim("text"))), F.lit("(unnamed)")).alias("header"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("bullet"), entry))), lambda e: e["text"]).alias("bullets"),
    )
    return out.filter(F.size("bullets") > 0)


def document_roles(docs: DataFrame, text: str = "text") -> DataFrame:
    """`role_table` of whole documents, joined bullets and sections included.

    A document of one row is cut up in that row and its lines are never shuffled; the rows of a repeated doc_id are lines of one document.
    """

    def of_rows(d: DataFrame) -> DataFrame:
        given = lambda s: s["kind"].isin("experience", "projects") & (F.size(s["lines"]) > 0)
        # explode would get a filter below it that computes the whole array again
        parts = d.select("doc_id", F.explode_outer(F.filter(S.sections(S.joined_lines("text")), given)).alias("s")).filter("s is not null")
        roles = parts.select("doc_id", "s.section_no", "s.kind", F.explode_outer(S.section_roles("s.lines")).alias("r")).filter("r is not null")
        return roles.select("doc_id", "section_no", "kind", "r.*")

    of_keys = lambda d: role_table(assign_roles(assign_sections(coalesce_bullets(doc_lines(d)))))
    return by_row_or_key(docs.select("doc_id", F.col(text).alias("text")), "doc_id", of_rows, of_keys)


# A year, a month in full or by three letters, an open end; or a long dash between two words.
ROLE_SIGNAL = (
    r"(?i)\b((19|20)\d{2}|Jan|January|Feb|February|Mar|March|Apr|April|May|Jun|June|Jul|July|Aug|August|Sep|September|Oct|October|Nov|November|Dec|December"
    r"|present|current|now|today)\b|[\pL\pN_]\s+[–—]\s+[\pL\pN_]"
)


def merge_fragmented_roles(roles: DataFrame) -> DataFrame:
    """Rows of `role_table` in which a role without a date or dash in its header gives its bullets to the one before it.

    A section's first role always stays, so no bullet is lost; a null header counts as one without a signal.
    """
    w = Window.partitionBy("doc_id", "section_no").orderBy("role_no")
    keeps = F.coalesce(F.col("header").rlike(ROLE_SIGNAL), F.lit(False)) | (F.row_number().over(w) == 1)
    marked = roles.withColumn("__keeps", keeps).withColumn("__role", F.sum(F.col("__keeps").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("role_no", "bullets"))), lambda p: p["bullets"])
    merged = marked.groupBy("doc_id", "section_no", "kind", "__role").agg(F.min_by("header", "role_no").alias("header"), F.min("role_no").alias("role_no"), F.flatten(parts).alias("bullets"))
    return merged.select("doc_id", "section_no", "kind", "role_no", "header", "bullets")


def section_texts(lines: DataFrame) -> DataFrame:
    """Each section's lines joined, by document, kind and number."""
    body = lines.filter("heading is null and trim(text) <> ''")
    parts = F.sort_array(F.collect_list(F.struct("line_no", F.trim("text").alias("text"))))
    return body.groupBy("doc_id", "kind", "section_no").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def parse_outline(docs: DataFrame, text: str = "text", merge_roles: bool = False) -> DataFrame:
    """doc_id, summary, education, skills and roles (header, section, bullets) of every document.

    With merge_roles, a role without a date or dash in its header gives its bullets to the one before it.
    """
    lines = assign_sections(coalesce_bullets(doc_lines(docs, text)))
    first = lambda kind: F.min_by(F.when(F.col("kind") == kind, F.col("text")), F.when(F.col("kind") == kind, F.col("section_no")))
    flat = section_texts(lines).groupBy("doc_id").agg(first("summary").alias("summary"), first("education").alias("education"), first("skills").alias("skills"))
    roles = role_table(assign_roles(lines))
    roles = merge_fragmented_roles(roles) if merge_roles else roles
    listed = roles.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("section_no", "role_no", "header", F.col("kind").alias("section"), "bullets"))).alias("roles"))
    out = docs.select("doc_id").join(flat, "doc_id", "left").join(listed, "doc_id", "left")
    return out.select("doc_id", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("education", F.lit("")).alias("education"), S.split_skills("skills").alias("skills"), "roles")


def promote_summary(sections: DataFrame) -> DataFrame:
    """For a document without a summary, the first experience section with text and no bullets becomes it."""
    w = Window.partitionBy("doc_id")
    fit = (F.col("kind") == "experience") & ~S.is_bullet("text") & ~F.col("text").rlike("\\n\\s*[-•▪●◦*+]\\s")
    marked = sections.withColumn("__has", F.max(F.col("kind") == "summary").over(w)).withColumn("__first", F.min(F.when(fit, F.col("section_no"))).over(w))
    return marked.withColumn("kind", F.when(~F.col("__has") & fit & (F.col("section_no") == F.col("__first")), "summary").otherwise(F.col("kind"))).drop("__has", "__first")


def build_chunks(outline: DataFrame) -> DataFrame:
    """Retrievable chunks: the summary, one for each role, all skills, the education; blank ones are left out."""
    part = lambda section, text: F.struct(F.lit(section).alias("section"), F.lit("").alias("role"), F.lit(0).alias("idx"), text.alias("text"))
    empty = F.array().cast("array<struct<section_no:int,role_no:int,header:string,section:string,bullets:array<string>>>")
    roles = F.transform(
        F.coalesce("roles", empty),
        lambda r, i: F.struct(F.lit("role_block").alias("section"), r["header"].alias("role"), i.cast("int").alias("idx"), F.concat(r["header"], F.lit("\n"), F.array_join(F.transform(r["bullets"], lambda b: F.concat(F.lit("• "), b)), "\n")).alias("text")),
    )
    skills = F.when(F.size("skills") > 0, F.concat(F.lit("SKILLS: "), F.array_join("skills", ", "))).otherwise("")
    education = F.when(F.col("education") != "", F.concat(F.lit("EDUCATION:\n"), "education")).otherwise("")
    every = F.concat(F.array(part("summary", F.col("summary"))), roles, F.array(part("skills_block", skills), part("education", education)))
    return outline.select("doc_id", F.explode(every).alias("c")).select("doc_id", "c.*").filter("trim(text) <> ''")


def embed_chunks(chunks: DataFrame, encode=None, size: int = 64) -> DataFrame:
    """chunks with `embedding`: by a vectorised function of a text series, else by hashed words of unit length."""
    if encode is not None:
        return chunks.withColumn("embedding", F.pandas_udf(encode, "array<float>")("text"))
    from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
    from pyspark.ml.functions import vector_to_array

    tokens = Tokenizer(inputCol="text", outputCol="__w").transform(chunks)
    counted = HashingTF(numFeatures=size, inputCol="__w", outputCol="__tf").transform(tokens)
    unit = Normalizer(inputCol="__tf", outputCol="__v").transform(counted)
    return unit.withColumn("embedding", vector_to_array("__v", "float32")).drop("__w", "__tf", "__v")


def to_index(chunks: DataFrame, stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks of documents whose stored chunks are fewer than they now have."""
    have = stored.groupBy(key).agg(F.count(F.lit(1)).alias("__have"))
    now = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("__now"))
    stale = now.join(have, key, "left").filter(F.coalesce("__have", F.lit(0)) < F.col("__now")).select(key)
    return chunks.join(stale, key, "left_semi")


# The headings of assembled context, in order.
CONTEXT = {"summary": "## Summary", "role_block": "## Experience", "skills_block": "## Skills", "education": "## Education"}


def assemble_context(chunks: DataFrame) -> DataFrame:
    """One text for each document: its chunks under their headings, in order."""
    entry = lambda s: F.transform(F.sort_array(F.collect_list(F.when(F.col("section") == s, F.struct("idx", "text")))), lambda e: e["text"])
    grouped = chunks.groupBy("doc_id").agg(*(entry(s).alias(s) for s in CONTEXT))
    parts = [F.when(F.size(s) > 0, F.concat(F.lit(head + "\n"), F.array_join(s, "\n"))) for s, head in CONTEXT.items()]
    return grouped.select("doc_id", F.coalesce(F.nullif(F.concat_ws("\n\n", *parts), F.lit("")), F.lit("(no context)")).alias("context"))


def context_or_full(context: Column | str, full: Column | str) -> Column:
    """The context if it has at least 95 % of the full text's length, else the full text."""
    c, f = (F.col(x) if isinstance(x, str) else x for x in (context, full))
    return F.when(F.length(c) < 0.95 * F.length(f), f).otherwise(c)


def extraction_coverage(df: DataFrame, source_chars: str, converted_chars: str, sections: str, columns: str, source_bytes: str, bytes_: str, threshold: int = 70) -> DataFrame:
    c = F.col
    score = F.when(c(converted_chars) >= 0.8 * c(source_chars), 60).when(c(converted_chars) >= 0.5 * c(source_chars), 30).otherwise(0)
    score = score + F.when(c(sections) >= 2, 20).otherwise(0) + F.when(c(columns) <= 1, 10).otherwise(0) + F.when(c(bytes_) <= 3 * c(source_bytes), 10).otherwise(0)
    return df.withColumn("coverage", score).withColumn("accepted", F.col("coverage") >= threshold)


SECTION_WORDS = r"(?i)\b(summary|experience|education|skills|projects|certifications)\b"


# Personal details that designers' templates put beside the text.
DESIGNER_TOKENS = r"(?i)\bDOB\b|\bdate of birth\b|\bmarital status\b|\bnationality\b|\b(?:male|female|gender)\b|\bSCHOLASTIC\s+RECORD\b"
MOST_PAGES = 12


def document_quality(docs: DataFrame, text: str = "text", keep: tuple = (), layout: DataFrame | None = None) -> DataFrame:
    """chars, ascii, sections and bullets measured, then score, status, and what lowered it (warnings) or blocks it (errors); `keep` are further columns of docs.

    layout: doc_id, pages, columns and has_sidebar of the documents that have one, a row each. Over MOST_PAGES pages, and columns, a
    sidebar or personal details of a designer's template lower the score too; a document of no pages is blocked.
    """
    t = F.coalesce(text, F.lit(""))
    words = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(SECTION_WORDS), F.lit(1)), lambda w: F.lower(w)))
    measured = docs.select(
        "doc_id", *keep, F.length(F.trim(t)).alias("chars"), F.round(ascii_ratio(t), 3).alias("ascii"), F.size(words).alias("sections"), F.regexp_count(t, F.lit("[•▪●◦]")).alias("bullets"), t.rlike(DESIGNER_TOKENS).alias("personal")
    )
    pages, columns, sidebar = F.lit(1), F.lit(1), F.lit(False)
    if layout is not None:
        measured = measured.join(layout.select("doc_id", "pages", "columns", "has_sidebar"), "doc_id", "left")
        pages, columns, sidebar = F.coalesce("pages", pages), F.coalesce("columns", columns), F.coalesce("has_sidebar", sidebar)
    errors = {"no_text": F.col("chars") < 200, "no_pages": pages < 1}
    severity = F.least(F.lit(35), F.lit(15) + F.when(sidebar, 10).otherwise(0) + F.when(F.col("personal"), 10).otherwise(0))
    lows = {
        "long": (pages > MOST_PAGES, 10),
        "short": (F.col("chars") < 400, 15),
        "non_ascii": (F.col("ascii") < 0.7, 20),
        "few_sections": (F.col("sections") < 2, 15),
        "few_bullets": (F.col("bullets") < 3, 10),
        "designer": ((columns >= 2) | sidebar | F.col("personal"), severity),
    }
    score = F.lit(100)
    for test, penalty in lows.values():
        score = score - F.when(test, penalty).otherwise(0)
    named = lambda tests: F.filter(F.array(*(F.when(test, name) for name, test in tests.items())), lambda x: x.isNotNull())
    blocked = F.size("errors") > 0
    out = measured.withColumn("errors", named(errors)).withColumn("score", F.when(blocked, 0).otherwise(F.greatest(score, F.lit(0))))
    out = out.withColumn("warnings", F.when(blocked, F.array().cast("array<string>")).otherwise(named({k: test for k, (test, _) in lows.items()})))
    return out.withColumn("status", F.when(blocked, "block").when(F.size("warnings") > 0, "warn").otherwise("pass"))


def quality_report(quality: DataFrame) -> DataFrame:
    """Documents of each status, with mean score."""
    return quality.groupBy("status").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("score"), 4).alias("mean_score"))


def term_mode(df: DataFrame, key: str, value: str, order: str, default: str) -> DataFrame:
    """The most frequent value of each key, the first seen of equal ones; the default where there is none."""
    counted = df.groupBy(key, value).agg(F.count(value).alias("n"), F.min(order).alias("first"))
    best = counted.groupBy(key).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct("n", (-F.col("first")).alias("f")))).alias("mode"))
    return best.withColumn("mode", F.coalesce("mode", F.lit(default)))


def list_mode(df: DataFrame, key: str, values: str, default: str) -> DataFrame:
    """term_mode of lists: the most frequent value of each key's list, the first of equal ones; rows of one key are one list."""

    def of_rows(df: DataFrame) -> DataFrame:
        placed = F.sort_array(F.filter(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("p"))), lambda e: e["v"].isNotNull()))
        # where runs of equal values begin, among the values in order
        begins = lambda es: F.filter(F.transform(es, lambda e, i: F.when((i == 0) | (F.get(es, i - 1)["v"] != e["v"]), i)), lambda i: i.isNotNull())
        runs = lambda es, at: F.transform(at, lambda b, k: F.struct((F.coalesce(F.get(at, k + 1), F.size(es)) - b).alias("n"), (-F.get(es, b)["p"]).alias("f"), F.get(es, b)["v"].alias("v")))
        best = let(placed, lambda es: let(begins(es), lambda at: F.array_max(runs(es, at))))
        return df.filter(F.size(values) > 0).select(key, F.coalesce(best["v"], F.lit(default)).alias("mode"))

    def of_keys(df: DataFrame) -> DataFrame:
        return term_mode(df.select(key, F.posexplode(values).alias("__p", "__v")), key, "__v", "__p", default)

    return by_row_or_key(df, key, of_rows, of_keys)


def drop_zero_bullet_docs(outline: DataFrame) -> DataFrame:
    """Documents with the flag zero_bullets, which skip rewriting."""
    n = F.aggregate(F.coalesce("roles", F.array().cast("array<struct<section_no:int,role_no:int,header:string,section:string,bullets:array<string>>>")), F.lit(0), lambda a, r: a + F.size(r["bullets"]))
    return outline.select("doc_id", n.alias("bullets"), (n == 0).alias("zero_bullets"))
