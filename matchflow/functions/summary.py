"""Is a summary's rewrite supported by its source? Column functions over (original, rewrite) and the document's outline.

An outline is an array of structs with header, section and bullets (array of texts), as `roles` below.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchflow.functions.guards import length_band, lost_credentials, low
from matchflow.functions.text import col, is_english, let, words

ROLES = "array<struct<header:string,section:string,bullets:array<string>>>"

# Wordings that announce a change of field.
TRANSITIONS = ("passionate about", "interested in", "eager to", "looking to", "transitioning to", "pivot into", "exploring", "aspiring to")
# Titles of one family, between which a summary may move.
FAMILIES = {
    "account_management": (
        "account manager", "account executive", "senior account executive", "social media account manager", "social media account executive", "client manager", "client executive",
        "customer success manager", "relationship manager", "key account manager",
    ),
    "marketing": (
        "marketing manager", "marketing executive", "digital marketing", "social media manager", "content marketing", "brand marketing", "marketing and communications", "communications manager",
        "marketing specialist", "marketing coordinator",
    ),
    "sales": ("sales manager", "sales executive", "business development", "sales representative", "account manager", "sales director", "enterprise sales", "sales engineer"),
    "product": ("product manager", "product owner", "senior product manager", "technical product manager", "product lead", "associate product manager"),
    "engineering": (
        "software engineer", "senior software engineer", "full stack engineer", "backend engineer", "frontend engineer", "devops engineer", "software developer", "principal engineer", "staff engineer",
    ),
    "data": ("data scientist", "data analyst", "data engineer", "machine learning engineer", "analytics engineer", "business analyst"),
    "design": ("product designer", "ux designer", "ui designer", "design lead", "visual designer", "interaction designer", "service designer"),
    "operations": ("operations manager", "operations analyst", "devops engineer", "site reliability engineer", "it operations", "business operations"),
    "finance": ("financial analyst", "finance manager", "controller", "accountant", "fp&a analyst", "treasury analyst"),
    "hr": ("hr manager", "recruiter", "talent acquisition", "people operations", "hr business partner", "recruiting coordinator"),
    "consulting": ("consultant", "management consultant", "strategy consultant", "advisor", "principal consultant", "senior consultant"),
}
# Fields, in the order of their check, and words of bullets that bear them out.
DOMAINS = {
    "sales": ("client", "revenue", "quota", "account", "deal", "customer", "target", "growth"),
    "marketing": ("campaign", "brand", "content", "social", "engagement", "reach", "promotion"),
    "engineering": ("code", "develop", "build", "software", "technical", "system", "architecture"),
    "product": ("feature", "roadmap", "user", "launch", "iteration", "strategy"),
    "design": ("ui", "ux", "visual", "creative", "interface", "user experience"),
    "operations": ("process", "workflow", "efficiency", "optimize", "scale", "logistics"),
    "finance": ("budget", "financial", "reporting", "analysis", "forecast", "investment"),
    "hr": ("recruitment", "hiring", "talent", "people", "culture", "onboarding"),
    "consulting": ("advisory", "client", "strategy", "recommendation", "solution"),
    "data": ("analytics", "analysis", "insight", "metrics", "report", "database"),
}
# The form of names in a summary, and capitalised words that are none.
NAME = r"\b(?:[A-Z]{2,}(?:[\/\-&][A-Z0-9]+)*|[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}|[A-Z][a-z]+[A-Z][A-Za-z]+)\b"
NO_NAMES = (
    "The", "A", "An", "And", "Or", "But", "Of", "In", "On", "At", "To", "For", "With", "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November",
    "December", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun", "I", "My", "Me", "We", "Our", "Us", "They", "You", "Responsible", "Experienced", "Skilled", "Proven", "Strong", "Professional",
    "Summary", "Experience", "Education", "Skills",
)
# Words of titles, which name no institution or place.
TITLE_WORDS = (
    "manager", "builder", "engineer", "developer", "analyst", "designer", "specialist", "architect", "consultant", "strategist", "scientist", "researcher", "leader", "owner", "officer", "director",
    "associate", "principal", "coordinator", "administrator", "advisor", "adviser", "marketer", "expert", "professional", "practitioner", "generalist", "executive", "founder", "partner", "programmer",
    "technologist", "planner", "writer", "editor", "producer", "operator", "technician", "representative", "facilitator", "evangelist", "ambassador", "mentor", "coach", "lead", "head", "chief",
    "senior", "junior", "staff", "global", "regional", "intern", "trainee",
)


def has_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(or_, map(text.contains, phrases))


def identity_added(original: Column | str, rewrite: Column | str, roles: Column | str) -> Column:
    """The first field that a summary newly claims and no bullet bears out, else null.

    Wordings of a change are free, and so are titles of a family that the document's headers have.
    """
    text_of = lambda part: let(F.concat_ws(" ", part), lambda t: F.lower(t))
    headers = F.transform(col(roles), lambda r: r["header"])
    bullets = F.flatten(F.transform(col(roles), lambda r: F.coalesce(r["bullets"], F.array().cast("array<string>"))))

    def added(old: Column, new: Column, heads: Column, done: Column) -> Column:
        family = lambda titles: has_any(heads, titles) & has_any(new, titles)
        free = has_any(new, TRANSITIONS)
        for titles in FAMILIES.values():
            free = free | family(titles)
        claims = F.coalesce(*(F.when(new.contains(d) & ~old.contains(d) & ~has_any(done, related), d) for d, related in DOMAINS.items()))
        return F.when((old != "") & (new != "") & ~free, claims)

    return let(low(original), lambda o: let(low(rewrite), lambda n: let(F.coalesce(text_of(headers), F.lit("")), lambda h: let(F.coalesce(text_of(bullets), F.lit("")), lambda b: added(o, n, h, b)))))


def foreign_terms(summary: Column | str, source: Column | str, exempt: Column | None = None) -> Column:
    """Names of a summary with a word (four letters or more, no title) that the source lacks; each spelling once, in order. None for an empty source."""
    exempt = F.array().cast("array<string>") if exempt is None else F.coalesce(exempt, F.array().cast("array<string>"))
    lone = lambda t, k, all_: F.array_position(F.transform(all_, lambda x: F.lower(x)), F.lower(t)) == k + 1

    def foreign(names: Column, text: Column) -> Column:
        once = F.filter(names, lambda t, k: lone(t, k, names))
        strange = lambda w: (F.length(w) >= 4) & ~text.contains(w) & ~w.isin("with", *TITLE_WORDS) & ~F.array_contains(exempt, w) & ~w.rlike("^[0-9]+$")
        words_of = lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"[a-z0-9][a-z0-9\-/&]*"), F.lit(0))
        return F.filter(once, lambda t: ~text.contains(F.lower(t)) & F.exists(words_of(t), strange))

    names = F.filter(F.regexp_extract_all(F.coalesce(col(summary), F.lit("")), F.lit(NAME), F.lit(0)), lambda t: ~t.isin(*NO_NAMES))
    return let(names, lambda n: let(low(source), lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(foreign(n, s))))


def absorbed_bullet(summary: Column | str, roles: Column | str, least: float = 0.75) -> Column:
    """Whether a sentence of six distinct words or more has `least` of them in one bullet of six or more."""
    tokens = lambda t: F.array_distinct(words(F.regexp_replace(low(t), "[^a-z0-9 ]+", " ")))
    long = lambda texts: F.filter(F.transform(texts, tokens), lambda w: F.size(w) >= 6)
    sentences = long(F.split(F.coalesce(col(summary), F.lit("")), r"(?<=[.!?])\s+"))
    bullets = long(F.flatten(F.transform(col(roles), lambda r: F.coalesce(r["bullets"], F.array().cast("array<string>")))))
    within = lambda s, bs: F.exists(bs, lambda b: F.size(F.array_intersect(s, b)) / F.size(s) >= least)
    return F.coalesce(let(bullets, lambda bs: F.exists(sentences, lambda s: within(s, bs))), F.lit(False))


def project_dropped(original: Column | str, rewrite: Column | str, roles: Column | str) -> Column:
    """The first project that the original summary names and the rewrite does not, else null."""
    projects = F.filter(col(roles), lambda r: F.lower(F.coalesce(r["section"], F.lit(""))).contains("project"))
    names = F.transform(projects, lambda r: F.trim(F.get(F.split(F.trim(F.coalesce(r["header"], F.lit(""))), r"\s*\|\s*|\s{2,}|\bTech Stack\b", 2), F.lit(0))))
    gone = lambda o, n: F.get(F.filter(names, lambda p: (F.length(p) >= 4) & o.contains(F.lower(p)) & ~n.contains(F.lower(p))), F.lit(0))
    return let(low(original), lambda o: let(low(rewrite), lambda n: F.when((o != "") & (n != ""), gone(o, n))))


def summary_violation(original: Column | str, rewrite: Column | str, roles: Column | str, source: Column | str, exempt: Column | None = None) -> Column:
    """The first guard that a summary's rewrite breaks, null if none or if there is no rewrite."""
    old, new = F.trim(F.coalesce(col(original), F.lit(""))), F.trim(F.coalesce(col(rewrite), F.lit("")))
    size, band = F.size(words(old)), length_band(old, new)
    return (
        F.when(new == "", F.lit(None).cast("string"))
        .when(old == "", "no_original")
        .when((size < 20) & (band == "long"), "stub_overflow")
        .when(identity_added(old, new, roles).isNotNull(), "identity")
        .when(F.size(foreign_terms(new, source, exempt)) > 0, "foreign_terms")
        .when(F.size(lost_credentials(old, new)) > 0, "credentials")
        .when(~is_english(new), "language")
        .when((new != old) & absorbed_bullet(new, roles), "absorbed_bullet")
        .when((new != old) & project_dropped(old, new, roles).isNotNull(), "project_dropped")
        .when(band.isin("short", "long"), "length")
    )
