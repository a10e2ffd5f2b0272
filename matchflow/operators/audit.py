"""Rewrite audits: edits applied and completed, guards in order, vocabulary differences and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchflow.functions import guards as G
from matchflow.functions.summary import summary_violation
from matchflow.functions.text import ascii_ratio, let, words
from matchflow.operators.written import by_row_or_key

TERM = r"([A-Za-z][A-Za-z0-9+&-]{2,})"
# Words that say nothing about a key.
KEY_STOP_WORDS = (
    "a", "an", "the", "and", "or", "of", "at", "in", "on", "for", "to", "with", "by", "as", "is", "are", "was", "were", "be", "been",
    "client", "role", "project", "company", "position", "title", "experience", "work", "team", "jan", "feb", "mar", "apr", "may", "jun",
    "jul", "aug", "sep", "oct", "nov", "dec", "january", "february", "march", "april", "june", "july", "august", "september", "october",
    "november", "december", "present", "current",
)

#: Why a rewrite may be reverted, in the order of the guards.
REASONS = ("keyword_jam", "identical", "unsafe", "solo_project", "borrowed_number", "injected_term", "filler", "not_english")


def audit_rewrites(pairs: DataFrame) -> DataFrame:
    """pairs with accepted_text and reason: guards in order, the first violation keeps the original.

    Columns: original, rewrite, section, terms (array), source_text, sibling_numbers (array: number tokens
    of the role's other originals).
    """
    filler = G.filler("original", "rewrite")
    cleaned = G.without_filler("rewrite", filler)
    new_numbers = F.array_except(G.numbers("rewrite"), G.numbers("original"))
    bare = lambda t: F.regexp_replace(t, "[%+kKmM,$]", "").try_cast("double")
    telling = F.filter(new_numbers, lambda t: ~F.coalesce(bare(t).between(1900, 2099) | ((bare(t) < 10) & ~t.rlike("[%+km]")), F.lit(False)))
    borrowed = F.size(F.array_intersect(telling, F.coalesce("sibling_numbers", F.array().cast("array<string>")))) > 0
    reason = (
        F.when(F.col("rewrite").isNull(), "kept")
        .when(G.keyword_jam("original", "rewrite"), "keyword_jam")
        .when(G.identical("original", "rewrite"), "identical")
        .when(~G.rewrite_safe("original", "rewrite"), "unsafe")
        .when(G.solo_project("original", "rewrite", "section").isNotNull(), "solo_project")
        .when(borrowed, "borrowed_number")
        .when(G.injected_term("original", "rewrite", "terms", "source_text").isNotNull(), "injected_term")
        .when(filler.isNotNull() & ~G.rewrite_safe(F.col("original"), cleaned), "filler")
        .when(ascii_ratio("rewrite") < 0.85, "not_english")
    )
    out = pairs.withColumn("reason", reason)
    return out.withColumn("accepted_text", F.when(F.col("reason").isNotNull(), F.col("original")).otherwise(cleaned))


def audit_summary(summaries: DataFrame) -> DataFrame:
    """summaries with accepted_summary and summary_reason: the first violation keeps the original, one without an original is dropped.

    Columns: original, rewrite, roles (header, section, bullets), source_text.
    """
    out = summaries.withColumn("summary_reason", summary_violation("original", "rewrite", "roles", "source_text"))
    kept = F.when(F.col("summary_reason").isNull() & (F.trim("rewrite") != ""), F.trim("rewrite")).otherwise(F.trim("original"))
    return out.withColumn("accepted_summary", F.coalesce(kept, F.lit("")))


def sibling_numbers(pairs: DataFrame, role: list[str], i: str = "i") -> DataFrame:
    """pairs with sibling_numbers: number tokens in originals of the same role's other bullets, by tokens counted per role."""
    tokens = pairs.select(*role, i, F.explode(G.numbers("original")).alias("__t"))
    spread = tokens.groupBy(*role, "__t").agg(F.countDistinct(i).alias("__n"), F.min(i).alias("__only"))
    listed = spread.groupBy(*role).agg(F.collect_list(F.struct("__t", "__n", "__only")).alias("__all"))
    own = F.transform(F.filter("__all", lambda e: (e["__n"] > 1) | (e["__only"] != F.col(i))), lambda e: e["__t"])
    return pairs.join(listed, role, "left").withColumn("sibling_numbers", F.coalesce(own, F.array().cast("array<string>"))).drop("__all")


def apply_edits(bullets: DataFrame, edits: DataFrame) -> DataFrame:
    """Bullets in the order of the edits, with their texts; then, in original order, those that no edit names.

    edits: doc_id, header, pos, i, text. A null text keeps the original; an index out of range or repeated
    is ignored (the first counts).
    """
    key = ["doc_id", "header", "i"]
    first = edits.groupBy(*key).agg(F.min_by(F.struct("pos", "text"), "pos").alias("e"))
    joined = bullets.join(first, key, "left")
    place = F.row_number().over(Window.partitionBy("doc_id", "header").orderBy(F.col("e").isNull(), F.col("e.pos"), "i"))
    return joined.select(*key, place.alias("place"), F.coalesce("e.text", "text").alias("text"), F.col("e").isNotNull().alias("listed"))


def edit_counts(edits: DataFrame, bullets: DataFrame) -> DataFrame:
    """rewrites and drops of each document."""
    listed = edits.groupBy("doc_id").agg(F.count("text").alias("rewrites"), F.count(F.lit(1)).alias("entries"))
    whole = bullets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("bullets"))
    out = whole.join(listed, "doc_id", "left")
    return out.select("doc_id", F.coalesce("rewrites", F.lit(0)).alias("rewrites"), F.greatest(F.lit(0), F.col("bullets") - F.coalesce("entries", F.lit(0))).alias("drops"))


def bullet_change_rate(originals: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Share of a document's bullets that changed at their place; half is enough, and so is having none."""
    both = originals.join(rewrites.select("doc_id", "i", F.col("text").alias("new")), ["doc_id", "i"], "left")
    changed = F.coalesce(F.trim("text") != F.trim("new"), F.lit(False)).cast("double")
    out = both.groupBy("doc_id").agg(F.round(F.avg(changed), 6).alias("rate"))
    return out.withColumn("passes", F.coalesce(F.col("rate") >= 0.5, F.lit(True)))


def guard_rollup(audited: DataFrame) -> DataFrame:
    """By document: whether all rewrites were reverted, whether none was tried, and reverts by reason."""
    tried, reverted = F.col("rewrite").isNotNull(), F.col("reason").isNotNull() & (F.col("reason") != "kept")
    return audited.groupBy("doc_id").agg(
        *(F.count_if(F.col("reason") == r).alias(f"reverted_{r}") for r in REASONS),
        F.count(F.lit(1)).alias("bullets"),
        F.count_if(tried).alias("tried"),
        F.count_if(reverted).alias("reverted"),
        ((F.count_if(tried) > 0) & (F.count_if(reverted) == F.count_if(tried))).alias("all_reverted"),
        ((F.count(F.lit(1)) >= 5) & (F.count_if(tried) == 0)).alias("untouched"),
    )


def terms_of(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(1)), lambda t: F.lower(F.regexp_replace(t, "[-+&]+$", "")))


def salient_terms(docs: DataFrame, text: str, stop: list[str], most: int = 28) -> DataFrame:
    """A document's terms by frequency: those seen twice or more if there are six such, else all; at most `most`."""
    counted = docs.select("doc_id", F.explode(terms_of(text)).alias("term")).filter(~F.col("term").isin(*stop) & (F.length("term") >= 3)).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("doc_id")
    strong = counted.withColumn("__strong", F.count_if(F.col("n") >= 2).over(w)).filter("n >= 2 or __strong < 6")
    return strong.withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), "term"))).filter(F.col("place") <= most).drop("__strong")


def vocabulary(docs: DataFrame, key: str, *texts: str) -> DataFrame:
    """The distinct terms of each key's texts: words of two characters or more, and pairs of neighbouring words, in lower case.

    A row's texts are joined by a space first. Null texts count as empty; a key without words has no row.
    """
    words_ = F.filter(F.split(F.lower(F.concat_ws(" ", *texts)), "[^a-z0-9+]+"), lambda w: w != "")
    pairs = F.transform(F.slice("__w", F.lit(2), F.greatest(F.size("__w") - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.get("__w", i), w))
    terms = F.array_distinct(F.concat(F.filter("__w", lambda w: F.length(w) >= 2), pairs))
    each = lambda df: df.select(key, words_.alias("__w")).select(key, F.explode(terms).alias("term"))
    return by_row_or_key(docs.select(key, *texts), key, each, lambda df: each(df).distinct())


def novel_terms(source: DataFrame, target: DataFrame, text: str = "text") -> DataFrame:
    """Distinct terms of each pair's targets that its sources lack, also with an s more or less; both have pair_id.

    Source terms are added up to one row for each term without its last s: whether the bare word is there, and whether the one
    with an s is. A target's term asks for the rows that it can be known by: one, or up to three if it ends in s.
    """
    each = lambda df: df.select("pair_id", F.explode(F.array_distinct(terms_of(text))).alias("term"))
    bare = lambda t: F.regexp_replace(t, "s$", "")
    here, plural = 1, 2
    known = each(source).groupBy("pair_id", bare("term").alias("base")).agg(F.bit_or(F.when(F.col("term").endswith("s"), plural).otherwise(here)).alias("has"))
    ask = lambda base, forms: F.struct(base.alias("base"), F.lit(forms).alias("forms"))
    term, cut = F.col("term"), bare("term")
    # a word t is known by t and ts; us by u, us and uss, where u may end in s itself
    asked = F.when(~term.endswith("s"), F.array(ask(term, here | plural))).when(~cut.endswith("s"), F.array(ask(cut, here | plural), ask(term, plural))).otherwise(F.array(ask(cut, plural), ask(term, plural), ask(bare(cut), plural)))
    wanted = each(target).distinct().withColumn("a", F.explode(asked)).select("pair_id", "term", "a.base", "a.forms")
    met = wanted.join(known, ["pair_id", "base"], "left").withColumn("hit", F.coalesce(F.col("has").bitwiseAND(F.col("forms")) != 0, F.lit(False)))
    plain = met.filter(~F.col("term").endswith("s") & ~F.col("hit")).select("pair_id", "term")
    ending = met.filter(F.col("term").endswith("s")).groupBy("pair_id", "term").agg(F.max("hit").alias("hit")).filter(~F.col("hit")).select("pair_id", "term")
    return plain.union(ending)


def merge_terms(df: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """By key, both lists in order without terms of two letters or fewer; of spellings that differ in case the first wins."""

    def of_rows(df: DataFrame) -> DataFrame:
        each = F.transform(F.concat(first, second), lambda t, i: F.struct(F.lower(F.trim(t)).alias("low"), i.alias("pos"), F.trim(t).alias("term")))
        found = F.sort_array(F.filter(each, lambda e: F.length(e["term"]) >= 3))
        once = let(found, lambda es: F.filter(es, lambda e, i: (i == 0) | (F.get(es, i - 1)["low"] != e["low"])))
        terms = F.transform(F.sort_array(F.transform(once, lambda e: F.struct(e["pos"], e["term"]))), lambda e: e["term"])
        return df.select(key, terms.alias("terms")).filter(F.size("terms") > 0)

    def of_keys(df: DataFrame) -> DataFrame:
        each = df.select(key, F.posexplode(F.concat(first, second)).alias("pos", "term")).withColumn("term", F.trim("term")).filter(F.length("term") >= 3)
        once = each.groupBy(key, F.lower("term").alias("__low")).agg(F.min("pos").alias("pos"), F.min_by("term", "pos").alias("term"))
        return once.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "term"))), lambda e: e["term"]).alias("terms"))

    return by_row_or_key(df, key, of_rows, of_keys)


def subtract_terms(terms: Column | str, safe: list[str]) -> Column:
    """Terms that are not made of whitelisted words alone."""
    allowed = F.array(*map(F.lit, safe))
    return F.filter(terms, lambda t: (F.size(terms_of(t)) == 0) | ~F.forall(terms_of(t), lambda w: F.array_contains(allowed, w)))


def scrub_terms(phrase: Column | str, terms: Column | str) -> Column:
    """A phrase without forbidden words and the connective they leave; blank if fewer than two words are left."""
    start = F.col(phrase) if isinstance(phrase, str) else phrase
    out = F.aggregate(terms, start, lambda p, t: F.regexp_replace(p, F.concat(F.lit(r"(?i)\b\Q"), t, F.lit(r"\E\b")), F.lit("")))
    tidy = F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"(?i)[\s,;]*\b(and|or|with|for|of|in|to)\s*$", ""))
    return F.when(F.size(words(tidy)) < 2, "").otherwise(tidy)


def key_tokens(text: Column | str) -> Column:
    parts = F.split(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda w: (F.length(w) >= 2) & ~w.isin(*KEY_STOP_WORDS) & ~w.rlike("^[0-9]+$")))
