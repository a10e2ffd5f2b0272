"""Model answers resolved to decisions: matches, reviews, letters, plans and strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchflow.functions.levels import job_level, level_gap_exit, level_gap_penalty, posting_years, unscorable, years_exit
from matchflow.functions.text import extract_json, let, words
from matchflow.operators.keys import containing_headers
from matchflow.operators.postings import split_missing

MATCH = "match_score double, matched_skills array<string>, missing_skills array<string>, reasoning string"
REVIEW = "score double, strengths array<string>, weaknesses array<string>, fabrications array<string>, feedback string, verdict string"
ACCEPT, LETTER_ACCEPT = 65, 70


def clamp(c: Column, low: int = 0, high: int = 100) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(c.cast("int"), F.lit(0))))


def texts_of(c: Column, most: int = 5) -> Column:
    return F.slice(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != ""), 1, most)


def resolve_match(df: DataFrame, raw: str, title: str, cand_level: str, cv: str | None = None, description: str | None = None) -> DataFrame:
    """Score, skills and reasoning of a raw match answer: clamped, lowered by the level gap; no JSON gives 0 and the answer's first 300 characters.

    With cv, missing skills that it has move to the matched ones. With description, a text too short to be scored (the CV's
    too, if it is given), then levels or years that rule a posting out come before the answer: their score holds, there
    are no skills, and the reasoning says which rule it was.
    """
    out = df.withColumn("__j", extract_json(raw, MATCH))
    bad = F.col("__j").isNull() | F.col("__j.match_score").isNull()
    gap = job_level(title) - F.col(cand_level)
    ruled, too_short = F.lit(None).cast("int"), F.lit(None).cast("string")
    if description is not None:
        too_short = unscorable(description, cv if cv else F.repeat(F.lit("x"), F.lit(50)))
        ruled = F.when(too_short.isNotNull(), 0).otherwise(F.coalesce(level_gap_exit(gap), years_exit(F.col(cand_level), posting_years(description)))).cast("int")
    out = out.withColumn("__ruled", ruled)
    out_of_play, none = F.col("__ruled").isNotNull(), F.array().cast("array<string>")
    score = F.when(out_of_play, F.col("__ruled")).when(bad, 0).otherwise(level_gap_penalty(clamp(F.col("__j.match_score")), gap))
    by_rule = F.when(too_short.isNotNull(), too_short).when(level_gap_exit(gap).isNotNull(), "level gap").otherwise("years asked")
    reason = F.when(out_of_play, by_rule).when(bad, F.substring(F.coalesce(F.col(raw), F.lit("")), 1, 300)).otherwise(F.coalesce("__j.reasoning", F.lit("")))
    skills = lambda k: F.when(out_of_play, none).otherwise(texts_of(F.col(f"__j.{k}"), 50))
    out = out.withColumns({"score": score.cast("int"), "matched": skills("matched_skills"), "missing": skills("missing_skills"), "reasoning": reason}).drop("__j", "__ruled")
    return split_missing(out, "missing", "matched", cv) if cv else out


def resolve_review(df: DataFrame, raw: str) -> DataFrame:
    """A review with its verdict by the threshold; no answer counts 55 and retry, an answer that is no JSON 50 and retry: reviews fail closed."""
    out = df.withColumn("__j", extract_json(raw, REVIEW))
    empty = F.trim(F.coalesce(F.col(raw), F.lit(""))) == ""
    bad = F.col("__j").isNull() | F.col("__j.score").isNull()
    score = F.when(empty, 55).when(bad, 50).otherwise(clamp(F.col("__j.score")))
    said = F.lower(F.coalesce("__j.verdict", F.lit("")))
    verdict = F.when(empty | bad, "retry").when(said.isin("accept", "retry"), said).when(score >= ACCEPT, "accept").otherwise("retry")
    return out.withColumns({"score": score.cast("int"), "verdict": verdict, "strengths": texts_of(F.col("__j.strengths")), "weaknesses": texts_of(F.col("__j.weaknesses")), "feedback": F.substring(F.coalesce("__j.feedback", F.lit("")), 1, 500)}).drop("__j")


def resolve_letter_review(df: DataFrame, raw: str) -> DataFrame:
    """A letter's review: any fabrication caps the score at 55, the verdict follows the score; no JSON accepts with 100: letters fail open."""
    out = df.withColumn("__j", extract_json(raw, REVIEW))
    bad = F.col("__j").isNull() | F.col("__j.score").isNull()
    found = texts_of(F.col("__j.fabrications"), 10)
    score = F.when(bad, 100).when(F.size(found) > 0, F.least(clamp(F.col("__j.score")), F.lit(55))).otherwise(clamp(F.col("__j.score")))
    return out.withColumns({"score": score.cast("int"), "verdict": F.when(score >= LETTER_ACCEPT, "accept").otherwise("retry"), "fabrications": F.when(bad, F.array().cast("array<string>")).otherwise(found)}).drop("__j")


PLAN = "keyword_bundles array<struct<title:string>>, min_matches double, min_score double, max_rounds double, emphasis_skills array<string>"


def resolve_plan(df: DataFrame, raw: str, primary: str) -> DataFrame:
    """A search plan: the primary title leads at most eight distinct bundles, numbers are clamped, at most eight distinct skills; no JSON gives the primary title alone."""
    out = df.withColumn("__j", extract_json(raw, PLAN))
    titles = F.transform(F.coalesce("__j.keyword_bundles", F.array().cast("array<struct<title:string>>")), lambda b: F.trim(F.coalesce(b["title"], F.lit(""))))
    others = F.filter(F.array_distinct(titles), lambda t: (t != "") & (F.lower(t) != F.lower(F.col(primary))))
    bundles = F.slice(F.concat(F.array(primary), others), 1, 8)
    number = lambda name, low, high, default: F.least(high, F.greatest(F.lit(low), F.coalesce(F.col(f"__j.{name}").cast("int"), F.lit(default))))
    return out.withColumns(
        {
            "bundles": bundles,
            "min_matches": number("min_matches", 1, F.lit(10), 3),
            "min_score": number("min_score", 40, F.lit(95), 60),
            "max_rounds": number("max_rounds", 1, F.least(F.size(bundles), F.lit(5)), 3),
            "skills": F.slice(F.array_distinct(texts_of(F.col("__j.emphasis_skills"), 100)), 1, 8),
        }
    ).drop("__j")


STRATEGY = "summary_angle string, keywords array<string>, section_notes map<string,string>, bullet_strategy map<string,array<struct<i:int,lead_with:string,jd_keyword:string>>>"
# Words that make a keyword of three words a role's phrase.
ROLE_NOUNS = ("ownership", "management", "experience", "practice", "skills", "literacy", "expertise", "background", "mindset")
# Labels of a whole part of a document, which are no role's key, and what ends the title in a key.
OUTER_LABELS = ("roles", "role", "projects", "project", "skills", "skill", "education", "experience", "work experience", "professional experience", "summary", "about")
KEY_END = r"(?i)\s\s+|\s\|\s|\s[-—]\s|\s+(?:Tech\s+Stack|Stack|Skills|Tools|Tech)\s*:"
# Words that say nothing about a lead.
LEAD_STOP_WORDS = ("a", "an", "the", "and", "or", "of", "for", "to", "in", "on", "with", "by", "at", "as", "into", "from")


def normalize_key(key: Column | str) -> Column:
    """A role's title out of an echoed header line; null for a label of a whole part."""
    c = F.col(key) if isinstance(key, str) else key
    tidy = F.regexp_replace(F.get(F.split(c, KEY_END, 2), F.lit(0)), r"^[ \t\r\n.,:;]+|[ \t\r\n.,:;]+$", "")
    return let(F.when(tidy == "", F.trim(c)).otherwise(tidy), lambda k: F.when(~F.lower(k).isin(*OUTER_LABELS), k))


def normalize_keys(entries: Column) -> Column:
    """A map with its keys as titles, labels left out; of keys that become equal the last one's value holds."""
    each = F.filter(F.transform(F.map_entries(entries), lambda e: F.struct(normalize_key(e["key"]).alias("key"), e["value"].alias("value"))), lambda e: e["key"].isNotNull())
    keys = lambda a: F.transform(a, lambda e: e["key"])
    last = lambda a: F.filter(a, lambda e, i: ~F.array_contains(keys(F.slice(a, i + 2, F.size(a))), e["key"]))
    return F.map_from_entries(let(each, last))


def long_keyword(keyword: Column) -> Column:
    """Four words or more, or three that end in a role's noun."""
    parts = words(keyword)
    return (F.size(parts) >= 4) | ((F.size(parts) >= 3) & F.regexp_replace(F.lower(F.element_at(parts, -1)), "[.,]+$", "").isin(*ROLE_NOUNS))


def lead_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*LEAD_STOP_WORDS))


def clean_leads(leads: DataFrame, bullets: DataFrame) -> DataFrame:
    """leads (doc_id, header, i, lead_with) with the lead blanked that is over nine content words long or begins as its bullet does.

    bullets: doc_id, header, place (of the header), i, text. A lead's header means the first one that contains it, or that it
    contains; a lead whose bullet is not there stays.
    """
    meant = containing_headers(leads.select("doc_id", F.col("header").alias("key")), bullets.select("doc_id", "header", "place")).select("doc_id", F.col("key").alias("header"), F.col("header").alias("__header"))
    texts = bullets.groupBy("doc_id", F.col("header").alias("__header"), "i").agg(F.min("text").alias("__text"))
    joined = leads.join(meant, ["doc_id", "header"], "left").join(texts, ["doc_id", "__header", "i"], "left")
    lead, opening = lead_words(F.col("lead_with")), F.slice(lead_words(F.col("__text")), 1, 8)
    echo = (F.size(lead) >= 3) & (F.size(opening) >= 3) & (F.slice(lead, 1, 3) == F.slice(opening, 1, 3))
    bad = F.col("__text").isNotNull() & ((F.size(lead) > 9) | echo)
    return joined.withColumn("lead_with", F.when(bad, "").otherwise(F.trim(F.coalesce("lead_with", F.lit(""))))).drop("__text", "__header")


def resolve_strategy(df: DataFrame, raw: str) -> DataFrame:
    """A fixed set of keys with empty defaults; keys of sections are titles, role-like keywords are blanked.

    bullet_strategy's leads meet their bullets in clean_leads, once they are rows.
    """
    out = df.withColumn("__j", extract_json(raw, STRATEGY))
    tight = lambda k: F.when(long_keyword(k), "").otherwise(F.trim(F.coalesce(k, F.lit(""))))
    action = lambda a: F.struct(a["i"].alias("i"), a["lead_with"].alias("lead_with"), tight(a["jd_keyword"]).alias("jd_keyword"))
    empty = lambda k, kind: F.coalesce(F.col(f"__j.{k}"), F.create_map().cast(kind))
    return out.withColumns(
        {
            "summary_angle": F.coalesce("__j.summary_angle", F.lit("")),
            "keywords": F.filter(F.transform(F.coalesce("__j.keywords", F.array().cast("array<string>")), tight), lambda k: k != ""),
            "section_notes": normalize_keys(empty("section_notes", "map<string,string>")),
            "bullet_strategy": F.transform_values(normalize_keys(empty("bullet_strategy", "map<string,array<struct<i:int,lead_with:string,jd_keyword:string>>>")), lambda _, v: F.transform(v, action)),
        }
    ).drop("__j")


def estimate_budget(roles: DataFrame, key: str, bullets: str) -> DataFrame:
    """Tokens that a plan for each document's roles needs, 1500 to 6000; rows have a role's bullet count (null: no outline, 2500)."""
    measured = roles.groupBy(key).agg(F.count(bullets).alias("roles"), F.sum(F.least(F.col(bullets), F.lit(12))).alias("bullets"))
    need = (F.lit(1500) + F.col("roles") * 120 + F.coalesce("bullets", F.lit(0)) * 290) / 4 * 1.3
    return measured.select(key, F.when(F.col("roles") == 0, 2500).otherwise(F.least(F.lit(6000), F.greatest(F.lit(1500), F.floor(need)))).cast("int").alias("tokens"))
