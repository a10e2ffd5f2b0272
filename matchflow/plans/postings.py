"""Posting and matching queries on orders, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.functions import levels as L
from matchflow.functions import text as X
from matchflow.operators import postings as P
from matchflow.operators import retrieval as R
from matchflow.plans.registry import CANDIDATES, POSTINGS, bound, candidates, postings, query, runs, table

_P = f"WITH p AS ({POSTINGS})"


def case(pairs: list[tuple[str, object]], default: object) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else "NULL" if v is None else str(v)
    return "CASE " + " ".join(f"WHEN {t} THEN {show(v)}" for t, v in pairs) + f" ELSE {show(default)} END"


JOB_LEVEL = case([(f"regexp_matches(lower(title), '{p}')", v) for p, v in L.TITLE_LEVELS], 2)
CAND_LEVEL = case([(f"trim(regexp_replace(lower(experience_level), '\\s*\\(.*$', '')) = '{k}'", v) for k, v in L.LEVELS.items()], 2)
MOST_YEARS = case([(f"cand_level = {k}", v) for k, v in L.MOST_YEARS.items()], 6)
_T = r"regexp_replace(lower(description), '\s+', ' ', 'g')"
_ALL = lambda p: f"regexp_extract_all({_T}, '{p}', 1)"
YEARS = rf"""coalesce(list_min(list_filter([x::INT for x in list_concat({_ALL(r'\b(\d{1,2})\s*\+?\s*(?:or\s+more\s+)?years?\b')}, {_ALL(r'\b(?:at\s+least|minimum(?:\s+of)?)\s+(\d{1,2})\s*years?\b')}, {_ALL(r'\b(\d{1,2})\s*(?:-|to)\s*\d{1,2}\s*years?\b')})], lambda n: n > 0 AND n <= 25)), 0)"""
_KEYS = "('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'ref', 'refid', 'source', 'trk', 'trkcampaign', 'trackingid', 'currentjobid', 'originalsubdomain')"


def url_sql(u: str) -> str:
    piece = lambda k: rf"regexp_extract(trim(coalesce({u}, '')), '^(?:([^:/?#]+)://)?([^/?#]*)([^?#;]*)[^?#]*(?:\?([^#]*))?', {k})"
    q = f"array_to_string(list_filter(string_split({piece(4)}, '&'), lambda x: regexp_matches(x, '^[^=]*=.+') AND lower(regexp_extract(x, '^([^=]*)', 1)) NOT IN {_KEYS}), '&')"
    return f"CASE WHEN {piece(1)} <> '' THEN lower({piece(1)}) || '://' ELSE '' END || lower({piece(2)}) || regexp_replace({piece(3)}, '/+$', '') || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END"


@query(f"SELECT page_id, {url_sql('url')} AS url_norm FROM pages")
def normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.normalize_url("url").alias("url_norm"))


_DOC_POST = "coalesce(nullif(trim({}), ''), 'N/A')"


@query(
    """SELECT coalesce(nullif(trim(split_part(text, chr(10), 1)), ''), 'N/A') AS title, coalesce(nullif(trim(source), ''), 'N/A') AS company, 'N/A' AS location, '' AS url,
    trim(text) || CASE WHEN trim(coalesce(lang, '')) <> '' THEN ' ' || trim(lang) ELSE '' END AS description, 'N/A' AS posted, 'N/A' AS posted_label, 'docs' AS source, doc_id FROM documents"""
)
def normalize_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").withColumn("head", F.split_part("text", F.lit("\n"), F.lit(1)))
    return P.normalize_postings(d, "docs", {"title": "head", "company": "source", "description": "text"}, ("lang",)).drop("text", "lang", "head")


@query(f"{_P} SELECT seq, source, title FROM p QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq) <= 200")
def union_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir)
    return P.union_boards(*(p.filter(F.col("source") == b) for b in ("LinkedIn", "Indeed", "Glassdoor")), n=600, order="seq").select("seq", "source", "title")


@query(f"{_P} SELECT seq, source, title FROM p QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq) <= 25")
def limit_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.limit_per_source(postings(spark, sf_dir), 25, "seq").select("seq", "source", "title")


@query(
    f"""{_P}, s AS (SELECT seq, title, location, source, CASE source WHEN 'Glassdoor' THEN 0 WHEN 'LinkedIn' THEN 1 ELSE 2 END AS place FROM p)
    SELECT seq, title, location, source FROM s QUALIFY place = min(place) OVER (PARTITION BY title, location)"""
)
def first_nonempty_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each title and location as a search."""
    return P.first_nonempty_source(postings(spark, sf_dir), "Glassdoor", ["title", "location"]).select("seq", "title", "location", "source")


@query(
    f"""{_P}, f AS (SELECT seq, source, title, location, coalesce(contains(lower(location), 'dublin'), false) AS fits FROM p),
    a AS (SELECT source, title, bool_or(fits) AS found FROM f GROUP BY ALL) SELECT seq, source, title, location FROM f JOIN a USING (source, title) WHERE fits OR NOT found"""
)
def with_location_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_location_fallback(postings(spark, sf_dir), "Dublin", ["source", "title"]).select("seq", "source", "title", "location")


@query(f"{_P} SELECT seq, url FROM p WHERE url = '' UNION ALL SELECT min(seq), url FROM p WHERE url <> '' GROUP BY url")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dedupe_first(postings(spark, sf_dir).select("seq", "url"), "url", ["seq"])


@query(
    f"""{_P}, u AS (SELECT *, seq % 3 AS round FROM p) SELECT seq, url, round::INT AS round FROM u WHERE url = ''
    UNION ALL SELECT seq, url, round::INT FROM (SELECT * FROM u WHERE url <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY round, seq) = 1) AS f"""
)
def merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir).select("seq", "url")
    return P.merge_rounds(*(p.filter(f"seq % 3 = {k}") for k in range(3)))


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir)
    return p.select("company", "url", (F.col("seq") % 5 == 0).alias("applied")).select(F.col("company").alias("user_key"), X.normalize_url("url").alias("url_norm"), "applied")


@query(
    f"""{_P}, h AS (SELECT DISTINCT company AS user_key, {url_sql('url')} AS url_norm FROM p WHERE seq % 5 = 0), k AS (SELECT seq, company AS user_key, nullif({url_sql('url')}, '') AS url_norm FROM p)
    SELECT seq, user_key, url_norm, EXISTS (SELECT 1 FROM h WHERE h.user_key = k.user_key AND h.url_norm = k.url_norm) AS skipped FROM k"""
)
def filter_out_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir).select("seq", F.col("company").alias("user_key"), "url")
    return P.with_applied(p, _applied(spark, sf_dir)).select("seq", "user_key", "url_norm", "skipped")


@query(f"{_P} SELECT seq, url FROM p WHERE seq % 2 = 1 AND (url = '' OR url NOT IN (SELECT url FROM p WHERE seq % 2 = 0 AND url <> ''))")
def new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir).select("seq", "url")
    return P.new_only(p.filter("seq % 2 = 1"), p.filter("seq % 2 = 0"))


@query(f"{_P} SELECT seq, url FROM p WHERE seq % 4 = 3 AND (url = '' OR url NOT IN (SELECT url FROM p WHERE seq % 4 < 3 AND url <> ''))")
def unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir).select("seq", "url")
    return P.unscored(p.filter("seq % 4 = 3"), p.filter("seq % 4 = 0"), p.filter("seq % 4 in (1, 2)"))


_LEVELED = f"l AS (SELECT *, {JOB_LEVEL} AS job_level, {YEARS} AS years FROM p), c AS (SELECT *, {CAND_LEVEL} AS cand_level FROM ({CANDIDATES}) AS x)"


@query(f"{_P}, {_LEVELED} SELECT candidate_id, seq, job_level, cand_level, years FROM c JOIN l ON job_level - cand_level BETWEEN -2 AND 1 AND NOT (years > 0 AND years > {MOST_YEARS} + 4)")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.candidate_pairs(candidates(spark, sf_dir), postings(spark, sf_dir)).select("candidate_id", "seq", "job_level", "cand_level", "years")


@query(f"{_P}, {_LEVELED} SELECT seq, title, job_level, years FROM l")
def job_level_and_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).select("seq", "title", L.job_level("title").alias("job_level"), X.required_years("description").alias("years"))


_EVERY = CANDIDATES.replace(" WHERE o_orderkey % 100 = 0", "")


@query(f"WITH c AS ({_EVERY}) SELECT candidate_id, {CAND_LEVEL} AS cand_level FROM c")
def candidate_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, _EVERY, "orders").select("candidate_id", L.candidate_level("experience_level").alias("cand_level"))


@query(
    f"""WITH r AS (SELECT o_orderkey AS run_id, (o_orderkey % 11 - 5)::INT AS gap, (o_custkey % 6)::INT AS cand_level, (o_orderkey % 27)::INT AS years, floor(o_totalprice / 5000)::INT AS score FROM orders)
    SELECT run_id, CASE WHEN gap >= 2 THEN 30 WHEN gap <= -3 THEN 40 END AS level_exit, CASE WHEN years > 0 AND years > {MOST_YEARS} + 4 THEN 25 END AS years_exit,
    greatest(0, CASE WHEN gap >= 3 THEN least(score - least(gap * 15, 60), 35) WHEN gap > 0 THEN score - gap * 15 WHEN gap < 0 THEN score - least(-gap * 5 + (-gap - 1) * 2, 20) ELSE score END)::INT AS penalised FROM r"""
)
def level_exits_and_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).select("run_id", (F.col("run_id") % 11 - 5).cast("int").alias("gap"), (F.col("user_id") % 6).cast("int").alias("cand_level"), (F.col("run_id") % 27).cast("int").alias("years"), "score")
    return r.select("run_id", L.level_gap_exit(F.col("gap")).alias("level_exit"), L.years_exit(F.col("cand_level"), F.col("years")).alias("years_exit"), L.level_gap_penalty("score", F.col("gap")).alias("penalised"))


@query("SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) < 30 THEN 'description too short' WHEN length(trim(coalesce(source, ''))) < 50 THEN 'cv too short' END AS reason FROM documents")
def prune_unscorable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", L.unscorable("text", "source").alias("reason"))


@query(f"{_P} SELECT seq, trim(split_part(title, ',', 1)) AS search_title, {case([(f'''contains(lower(location), '{k}')''', v) for k, v in L.COUNTRIES.items()], 'Ireland')} AS country FROM p")
def search_title_and_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).select("seq", L.search_title("title").alias("search_title"), L.country_of("location").alias("country"))


@query(f"{_P} SELECT seq, array_to_string(list_filter([CASE WHEN title = 'Chef' THEN 'title' END, CASE WHEN location = '' THEN 'location' END, CASE WHEN url = '' THEN 'url' END], lambda x: x IS NOT NULL), ',') AS errors FROM p")
def validate_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"title": F.col("title") != "Chef", "location": F.col("location") != "", "url": F.col("url") != ""}
    return P.validate_inputs(postings(spark, sf_dir), rules).select("seq", F.array_join("errors", ",").alias("errors"))


_CONTENT = lambda c: rf"[regexp_replace(w, 's+$', '') for w in string_split_regex(trim(regexp_replace(lower({c}), '[^a-z0-9 ]+', ' ', 'g')), ' +') if length(w) > 1 AND w NOT IN ({', '.join(repr(w) for w in X.SKILL_STOP_WORDS)})]"
_TOGETHER = lambda t: f"(len({t}) > 0 AND len(list_filter(range(1, len(cv) + 1), lambda i: list_contains({t}, cv[i]) AND len(list_filter({t}, lambda x: NOT list_contains(cv[i:i + len({t}) + 2], x))) = 0)) > 0)"


@query(
    f"""WITH d AS (SELECT doc_id, {_CONTENT('text')} AS cv, {_CONTENT("concat_ws(' ', split_part(text, ' ', 4), split_part(text, ' ', 3))")} AS a, {_CONTENT("concat(split_part(text, ' ', 2), ' zebra')")} AS b FROM documents),
    f AS (SELECT doc_id, {_TOGETHER('a')}::INT + {_TOGETHER('b')}::INT AS n FROM d) SELECT doc_id, (2 - n)::INT AS missing, (1 + n)::INT AS matched FROM f"""
)
def split_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda n: F.split_part("text", F.lit(" "), F.lit(n))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.array(F.concat_ws(" ", part(4), part(3)), F.concat(part(2), F.lit(" zebra"))).alias("missing"), F.array(F.lit("python")).alias("matched"))
    return P.split_missing(d, "missing", "matched", "text").select("doc_id", F.size("missing").alias("missing"), F.size("matched").alias("matched"))


@query(
    """WITH q AS (SELECT vec_id AS query_id, label, embedding AS a FROM embeddings WHERE vec_id % 100 = 0),
    d AS (SELECT query_id, vec_id AS chunk_id, list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE) for x in list_zip(a, embedding)]) AS distance FROM q JOIN embeddings USING (label))
    SELECT query_id, chunk_id, round(distance, 9) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id)::INT AS rank FROM d QUALIFY rank <= 10"""
)
def retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").withColumnRenamed("label", "doc_fp")
    found = R.retrieve_topk(v.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "chunk_id"), 10)
    return found.select("query_id", "chunk_id", F.round("distance", 9).alias("distance"), "rank")


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 100 = 0),
    d AS (SELECT query_id, vec_id AS chunk_id, list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE) for x in list_zip(a, embedding)]) AS distance FROM q CROSS JOIN embeddings)
    SELECT query_id, chunk_id, round(distance, 9) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id)::INT AS rank FROM d QUALIFY rank <= 10"""
)
def retrieve_topk_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as one collection; every hundredth id is a query, against all rows."""
    v = table(spark, sf_dir, "embeddings").withColumn("doc_fp", F.lit("all")).drop("label")
    found = R.retrieve_topk(v.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "chunk_id"), 10)
    return found.select("query_id", "chunk_id", F.round("distance", 9).alias("distance"), "rank")
