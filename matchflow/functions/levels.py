"""Seniority rules: levels of candidates and postings, exits before scoring, and the penalty after it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchflow.functions.text import col, required_years

# Levels by label, and the most years of a candidate of each level.
LEVELS = {"fresher": 0, "entry / associate": 1, "entry/associate": 1, "mid-level": 2, "mid level": 2, "senior": 3, "lead / manager": 4, "lead/manager": 4, "director / vp+": 5, "director/vp+": 5}
MOST_YEARS = {0: 1, 1: 3, 2: 6, 3: 10, 4: 15, 5: 25}
YEARS_TOLERANCE = 4

# Title patterns in the order in which they decide.
TITLE_LEVELS = (
    (r"\b(chief|c[eo]o|cto|cfo|cpo|svp|evp|vp|vice\s+president)\b", 5),
    (r"\b(director|head\s+of)\b", 5),
    (r"\b(principal|staff)\b", 4),
    (r"\b(junior|jr\.?|associate|intern|graduate|trainee|entry|apprentice|fresher)\b", 1),
    (r"\b(senior|sr\.?|snr)\b", 3),
    (r"\blead\b", 4),
    (
        r"\b(product\s+manager|software\s+engineer|data\s+scientist|data\s+analyst|backend\s+engineer|frontend\s+engineer|full\s+stack\s+engineer|devops\s+engineer|qa\s+engineer|business\s+analyst|project\s+manager"
        r"|program\s+manager|operations\s+manager|marketing\s+manager|sales\s+manager|hr\s+manager|finance\s+manager|account\s+manager|customer\s+success\s+manager|consultant|specialist|analyst|coordinator)\b",
        2,
    ),
    (r"\b(manager|mgr)\b", 4),
)
# Country by the first name that a location holds.
COUNTRIES = {
    "usa": "United States",
    "united states": "United States",
    "uk": "United Kingdom",
    "united kingdom": "United Kingdom",
    "ireland": "Ireland",
    "canada": "Canada",
    "australia": "Australia",
    "germany": "Germany",
    "france": "France",
    "netherlands": "Netherlands",
    "spain": "Spain",
    "italy": "Italy",
}


def chain(pairs: list[tuple[Column, object]], default: object) -> Column:
    out = None
    for test, value in pairs:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default)


def candidate_level(label: Column | str) -> Column:
    """Level of a label, the hint in parentheses dropped; 2 if unknown."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(col(label), F.lit(""))), r"\s*\(.*$", ""))
    return chain([(plain == k, v) for k, v in LEVELS.items()], 2)


def job_level(title: Column | str) -> Column:
    t = F.lower(F.coalesce(col(title), F.lit("")))
    return chain([(t.rlike(p), v) for p, v in TITLE_LEVELS], 2)


def most_years(level: Column) -> Column:
    return chain([(level == k, v) for k, v in MOST_YEARS.items()], 6)


def level_gap_exit(gap: Column) -> Column:
    """The score of a pair that is too far apart in level, else null."""
    return F.when(gap >= 2, 30).when(gap <= -3, 40)


def years_exit(level: Column, years: Column) -> Column:
    return F.when((years > 0) & (years > most_years(level) + YEARS_TOLERANCE), 25)


def level_gap_penalty(score: Column | str, gap: Column) -> Column:
    """A score lowered by the gap in levels, at least 0."""
    s = col(score)
    over = s - F.least(gap * 15, F.lit(60))
    over = F.when(gap >= 3, F.least(over, F.lit(35))).otherwise(over)
    under = s - F.least(-gap * 5 + (-gap - 1) * 2, F.lit(20))
    return F.greatest(F.lit(0), F.when(gap > 0, over).when(gap < 0, under).otherwise(s)).cast("int")


def unscorable(description: Column | str, cv: Column | str) -> Column:
    """Why a pair cannot be scored (its score is 0), else null."""
    short = lambda c, n: F.length(F.trim(F.coalesce(col(c), F.lit("")))) < n
    return F.when(short(description, 30), "description too short").when(short(cv, 50), "cv too short")


def search_title(title: Column | str) -> Column:
    return F.trim(F.split_part(col(title), F.lit(","), F.lit(1)))


def country_of(location: Column | str) -> Column:
    l = F.lower(F.coalesce(col(location), F.lit("")))
    return chain([(l.contains(k), v) for k, v in COUNTRIES.items()], "Ireland")


def posting_years(description: Column | str) -> Column:
    return required_years(description)
