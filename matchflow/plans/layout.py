"""Layout and letter queries: documents' lines placed on pages by their number and length, and whole documents as letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.functions import letters as C
from matchflow.functions import text as X
from matchflow.operators import layout as Y
from matchflow.operators.outline import DESIGNER_TOKENS, SECTION_WORDS, document_quality
from matchflow.operators.postings import dedupe_first, limit_per_source
from matchflow.plans.postings import YEARS
from matchflow.plans.registry import bound, query, table

#: A line for each line of a text; places and sizes follow from its number and length.
_LINES_DUCK = "SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents"
_PLACED = """SELECT doc_id, line_no, text, line_no // 40 AS page, CASE WHEN (doc_id + line_no) % 4 = 0 THEN 320.0 WHEN (doc_id + line_no) % 5 = 0 THEN 30.0 ELSE 72.0 END + length(text) % 3 AS x0, (line_no % 40) * 14.0 + length(text) % 2 AS y0,
    CASE length(text) % 3 WHEN 0 THEN 'Inter' WHEN 1 THEN 'Lato' ELSE 'Arial' END AS font, 8.0 + length(text) % 7 AS size FROM"""
_L = f"WITH raw AS ({_LINES_DUCK}), l AS ({_PLACED} raw)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    return spark.sql(_PLACED.replace("//", "div") + " {raw}", raw=raw)


def _middle(keys: str, value: str, name: str, src: str) -> str:
    return f"SELECT {keys}, list(CAST({value} AS DOUBLE) ORDER BY {value})[count(*) // 2 + 1] AS {name} FROM {src} GROUP BY {keys}"


@query(f"{_L}, m AS ({_middle('doc_id, page', 'x0', 'mid', 'l')}), s AS (SELECT l.*, count(*) OVER w AS n, max(x0) OVER w - min(x0) OVER w AS span FROM l WINDOW w AS (PARTITION BY doc_id, page)) SELECT doc_id, line_no::INT AS line_no FROM s JOIN m USING (doc_id, page) WHERE NOT (n >= 3 AND span >= 50 AND x0 < mid - 30)")
def sidebar_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.sidebar_outliers(lines(spark, sf_dir), ["doc_id", "page"]).select("doc_id", "line_no")


@query(
    f"""{_L}, f AS (SELECT doc_id, font FROM (SELECT doc_id, font, count(*) AS n FROM l GROUP BY ALL) AS c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, font) = 1), m AS ({_middle('doc_id', 'size', 'mid', 'l')}),
    w AS (SELECT doc_id, max(size)::DOUBLE AS largest, round(least(32.0, greatest(12.0, min(x0)::DOUBLE * 25.4 / 72)), 4)::DOUBLE AS margin_mm, count(DISTINCT page) AS pages FROM l GROUP BY 1)
    SELECT doc_id, largest, margin_mm, pages, font, least(12.0, greatest(9.0, mid))::DOUBLE AS size FROM w JOIN f USING (doc_id) JOIN m USING (doc_id)"""
)
def style_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Y.style_profile(lines(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in ("x0", "y0", "size")}))
    return out.withColumn("size", F.col("size").cast("double"))


@query(
    f"""{_L}, y AS (SELECT DISTINCT doc_id, page, round(y0::DOUBLE, 1) AS y FROM l), g AS (SELECT doc_id, round(y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y), 4) AS gap FROM y), m AS ({_middle('doc_id', 'gap', 'mid', '(SELECT * FROM g WHERE gap > 0)')}),
    b AS (SELECT doc_id, size::DOUBLE AS first FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no) = 1) SELECT doc_id, round(coalesce(least(1.3, greatest(1.0, mid / first)), 1.15), 4)::DOUBLE AS line_gap FROM b LEFT JOIN m USING (doc_id)"""
)
def line_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.line_gap(lines(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in ("x0", "y0", "size")}))


@query(
    f"""{_L}, c AS (SELECT doc_id, least(9, greatest(0, floor(x0 * 10 / 612.0)))::INT AS bin, count(*) AS n FROM l GROUP BY ALL), g AS (SELECT doc_id, sum(n) AS total, [coalesce(list_sum(list_filter(list([bin, n]), lambda e: e[1] = k)[1][2:]), 0)::INT for k in range(10)] AS h FROM c GROUP BY 1),
    p AS (SELECT *, list_filter(range(10), lambda k: h[k + 1] >= greatest(3, total * 0.1) AND h[k + 1] >= CASE WHEN k > 0 THEN h[k] ELSE 0 END AND h[k + 1] > CASE WHEN k < 9 THEN h[k + 2] ELSE 0 END) AS ks FROM g)
    SELECT doc_id, greatest(1, len(ks))::INT AS columns, len(ks) >= 2 AND ks[1] <= 2 AND h[ks[1] + 1] < 0.7 * list_max(h) AS has_sidebar FROM p"""
)
def column_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.column_histogram(lines(spark, sf_dir).withColumn("x0", F.col("x0").cast("double")), 612.0)


@query(
    f"""{_L}, c AS (SELECT doc_id, floor(x0 / 25)::INT AS bin, count(*) AS n FROM l GROUP BY ALL), h AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM c), k AS (SELECT * FROM h WHERE n >= greatest(3, floor(total * 0.15))),
    o AS (SELECT doc_id, bin - lag(bin) OVER (PARTITION BY doc_id ORDER BY bin) > 2 AS opens FROM k), g AS (SELECT doc_id, count_if(opens) AS n FROM o GROUP BY 1)
    SELECT doc_id, (coalesce(n, 0) + 1)::INT AS columns, coalesce(n, 0) = 0 AS compatible FROM (SELECT DISTINCT doc_id FROM l) AS d LEFT JOIN g USING (doc_id)"""
)
def replica_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.replica_columns(lines(spark, sf_dir).withColumn("x0", F.col("x0").cast("double")))


@query(
    f"""{_L}, b AS (SELECT *, floor(greatest(0.0, least(0.9999, x0::DOUBLE / 612.0)) * 20)::INT AS bin FROM l), c AS (SELECT doc_id, page, bin, count(*) AS n FROM b GROUP BY ALL),
    h AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, page) AS total FROM c), p AS (SELECT doc_id, page, coalesce(list([bin] ORDER BY bin) FILTER (n >= greatest(3, floor(total * 0.1))), []) AS high FROM h GROUP BY ALL),
    k AS (SELECT doc_id, page, CASE WHEN len(high) > 0 THEN list_reduce(high, lambda kept, e: CASE WHEN e[1] - kept[-1] < 3 THEN kept ELSE list_concat(kept, e) END) ELSE [] END AS peaks FROM p),
    e AS (SELECT doc_id, page, [(peaks[i] + peaks[i + 1]) / 2 / 20 * 612.0::DOUBLE for i in range(1, len(peaks))] AS edges FROM k),
    z AS (SELECT doc_id, page, line_no, y0, x0, len(list_filter(edges, lambda v: x0 >= v))::INT AS column FROM l JOIN e USING (doc_id, page))
    SELECT doc_id, line_no::INT AS line_no, z.column, row_number() OVER (PARTITION BY doc_id, page ORDER BY z.column, y0, x0, line_no)::INT AS place FROM z"""
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = lines(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in ("x0", "y0")})
    return Y.reading_order(l, 612.0).select("doc_id", "line_no", "column", "place")


#: Every third document with personal details; pages, columns and sidebars from the placed lines.
_PERSONAL = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat(text, ' Nationality: none') ELSE text END AS text FROM documents"


@query(
    rf"""{_L}, c AS (SELECT doc_id, least(9, greatest(0, floor(x0 * 10 / 612.0)))::INT AS bin, count(*) AS n FROM l GROUP BY ALL), g AS (SELECT doc_id, sum(n) AS total, [coalesce(list_sum(list_filter(list([bin, n]), lambda e: e[1] = k)[1][2:]), 0)::INT for k in range(10)] AS h FROM c GROUP BY 1),
    k AS (SELECT *, list_filter(range(10), lambda k: h[k + 1] >= greatest(3, total * 0.1) AND h[k + 1] >= CASE WHEN k > 0 THEN h[k] ELSE 0 END AND h[k + 1] > CASE WHEN k < 9 THEN h[k + 2] ELSE 0 END) AS ks FROM g),
    f AS (SELECT doc_id, greatest(1, len(ks)) AS columns, len(ks) >= 2 AND ks[1] <= 2 AND h[ks[1] + 1] < 0.7 * list_max(h) AS sidebar FROM k), n AS (SELECT doc_id, count(DISTINCT page) AS pages FROM l GROUP BY 1),
    t AS (SELECT * FROM ({_PERSONAL}) AS x), m AS (SELECT doc_id, length(trim(text)) AS chars, round(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / length(text), 3) AS ascii,
    len(list_distinct([lower(w) for w in regexp_extract_all(text, '{SECTION_WORDS}', 1)])) AS sections, len(regexp_extract_all(text, '[•▪●◦]')) AS bullets, contains(lower(text), 'nationality:') AS personal FROM t),
    w AS (SELECT doc_id, chars, CASE WHEN pages > 12 THEN {{'w': 'long', 'p': 10}} END AS a, CASE WHEN chars < 400 THEN {{'w': 'short', 'p': 15}} END AS b, CASE WHEN ascii < 0.7 THEN {{'w': 'non_ascii', 'p': 20}} END AS c, CASE WHEN sections < 2 THEN {{'w': 'few_sections', 'p': 15}} END AS d,
        CASE WHEN bullets < 3 THEN {{'w': 'few_bullets', 'p': 10}} END AS e, CASE WHEN columns >= 2 OR sidebar OR personal THEN {{'w': 'designer', 'p': least(35, 15 + 10 * sidebar::INT + 10 * personal::INT)}} END AS g FROM m JOIN f USING (doc_id) JOIN n USING (doc_id)),
    s AS (SELECT doc_id, chars, list_filter([a, b, c, d, e, g], lambda x: x IS NOT NULL) AS all_ FROM w)
    SELECT doc_id, CASE WHEN chars < 200 THEN 0 ELSE greatest(0, 100 - coalesce(list_sum([x.p for x in all_]), 0)) END::INT AS score, CASE WHEN chars < 200 THEN 'block' WHEN len(all_) > 0 THEN 'warn' ELSE 'pass' END AS status,
        CASE WHEN chars < 200 THEN '' ELSE array_to_string([x.w for x in all_], ',') END AS warnings, CASE WHEN chars < 200 THEN 'no_text' ELSE '' END AS errors FROM s"""
)
def document_quality_with_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = lines(spark, sf_dir).withColumn("x0", F.col("x0").cast("double"))
    pages = l.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    found = document_quality(bound(spark, sf_dir, _PERSONAL, "documents"), layout=Y.column_histogram(l, 612.0).join(pages, "doc_id"))
    return found.select("doc_id", "score", "status", F.array_join("warnings", ",").alias("warnings"), F.array_join("errors", ",").alias("errors"))


_LETTERS = "SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN 'I am thrilled: 42% more. ' WHEN 1 THEN 'My passion for synergy. ' ELSE '' END, text, CASE doc_id % 3 WHEN 0 THEN ' and.' ELSE '' END) AS letter, text AS cv FROM documents"
_PHRASES = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in C.BANNED) + "]"
_BUZZ = "['dynamic', 'passionate', 'fast-paced', 'rockstar', 'ninja', 'game-changer', 'synergy', 'synergies', 'think outside the box', 'results-driven', 'detail-oriented', 'self-starter']"
_LOOSE = r"list_filter(regexp_extract_all(lower(letter), '\b\d[\d,.]+\b'), lambda x: NOT contains(lower(cv), x))"
_W = r"len(list_filter(string_split_regex(letter, '\s+'), lambda w: w <> ''))"


@query(
    rf"""WITH l AS ({_LETTERS}) SELECT doc_id, array_to_string(list_filter({_PHRASES}, lambda p: contains(lower(letter), p)), ',') AS banned,
    length(trim(letter)) >= 380 AND {_W} >= 100 AND regexp_matches(trim(letter), '[.!?"'']$') AND NOT regexp_matches(lower(trim(letter)), '\b({'|'.join(C.TRAILERS)})\.?$') AS complete,
    CASE WHEN {_W} NOT BETWEEN 280 AND 460 THEN 'word_count=' || {_W} WHEN len(list_filter({_BUZZ}, lambda p: contains(lower(letter), p))) > 0 THEN 'buzzword:' || list_filter({_BUZZ}, lambda p: contains(lower(letter), p))[1]
    WHEN len({_LOOSE}) > 0 THEN 'ungrounded_number:' || {_LOOSE}[1] ELSE 'ok' END AS precheck FROM l"""
)
def letter_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = bound(spark, sf_dir, _LETTERS, "documents")
    return l.select("doc_id", F.array_join(C.banned_phrases("letter"), ",").alias("banned"), C.letter_complete("letter").alias("complete"), C.letter_precheck("letter", "cv", F.lit("")).alias("precheck"))


def _tidy(letter: str) -> str:
    for pattern, new in (("  +", " "), (r"\s+([,.;:!?])", r"\1"), (r"\(\s+", "("), (r"\s+\)", ")"), *((rf"(^|[.!?]\s+){c}", rf"\1{c.upper()}") for c in "abcdefghijklmnopqrstuvwxyz")):
        letter = f"regexp_replace({letter}, '{pattern}', '{new}', 'g')"
    return rf"regexp_replace({letter}, '^\s+|\s+$', '', 'g')"


_BROKEN = r"[.,;:!?]\s*[.,;:!?]|(^|[^\pL\pN_])(is|am|are|was|were|be|been|being)\s*,"


@query(
    f"""WITH l AS ({_LETTERS}), r AS (SELECT doc_id, CASE WHEN regexp_matches(letter, '{_BROKEN}') THEN letter ELSE replace(letter, 'My passion for synergy. ', 'my interest in alignment. ') END AS letter FROM l) SELECT doc_id, {_tidy('letter')} AS letter FROM r"""
)
def strip_banned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, _LETTERS, "documents").select("doc_id", C.strip_banned("letter").alias("letter"))


_POSTINGS = "SELECT doc_id, concat('About us, a firm. ', text, chr(10), 'Benefits: many', chr(10), 'Required Skills ', text, chr(10), 'Company: x') AS posting FROM documents"
#: From a part's heading to what ends it.
_PARTS = ", ".join(f"regexp_extract(posting, '(?is)((?:{p.replace(chr(39), chr(39) * 2)}).*?)(?:{X.POSTING_ENDS}|$)', 1)" for p in X.POSTING_PARTS)


@query(
    rf"""WITH p AS ({_POSTINGS}), w AS (SELECT *, list_filter(string_split_regex(posting, '\s+'), lambda x: x <> '') AS ws FROM p),
    k AS (SELECT *, array_to_string(list_filter([regexp_replace(x, '^\s+|\s+$', '', 'g') for x in [{_PARTS}]], lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda y: y <> '')) > 10), chr(10) || chr(10)) AS part FROM w),
    c AS (SELECT *, list_filter(string_split_regex(part, '\s+'), lambda x: x <> '') AS cs FROM k)
    SELECT doc_id, sha256(CASE WHEN len(ws) <= 200 THEN posting WHEN len(cs) > 200 THEN array_to_string(cs[1:200], ' ') || '...' WHEN part <> '' THEN part ELSE array_to_string(ws[1:200], ' ') || '...' END) AS short FROM c"""
)
def compress_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bound(spark, sf_dir, _POSTINGS, "documents")
    return p.select("doc_id", F.sha2(X.compress_text("posting", 200), 256).alias("short"))


@query(
    f"""{_L}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY round(y0, 1), round(x0, 1), line_no) AS k FROM l WHERE line_no % 7 > 0), i AS (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY doc_id, page ORDER BY k) <= 1.2 THEN 0 ELSE 1 END AS new FROM o),
    g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY k) AS row FROM i)
    SELECT doc_id, page, min(x0)::DOUBLE AS x0, min(y0)::DOUBLE AS y0, count(*)::INT AS n FROM g GROUP BY doc_id, page, row UNION ALL SELECT doc_id, page, x0::DOUBLE, y0::DOUBLE, 1 FROM l WHERE line_no % 7 = 0"""
)
def merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = lines(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in ("x0", "y0")})
    # a one-letter text each, so that the joined text counts the lines
    marked = l.withColumns({"x1": F.col("x0") + 10, "y1": F.col("y0") + 10, "text": F.lit("x"), "is_marker": F.col("line_no") % 7 == 0})
    return Y.merge_rows(marked).select("doc_id", "page", "x0", "y0", F.regexp_count("text", F.lit("x")).alias("n"))


@query(
    rf"""{_L}, n AS (SELECT doc_id, max(CASE WHEN size >= 14 THEN line_no END) AS named FROM l GROUP BY 1), b AS (SELECT l.* FROM l JOIN n USING (doc_id) WHERE named IS NULL OR line_no > named),
    s AS (SELECT doc_id, count(*) AS k, sum(length(text)) AS chars, min(CASE WHEN NOT regexp_matches(text, '(?i)(@|linkedin\.com|https?://|\+?\d[\d\s\-]{{6,}})') THEN line_no END) AS first FROM b GROUP BY 1)
    SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS summary FROM b JOIN s USING (doc_id) WHERE k >= 2 AND chars >= 120 AND line_no >= first GROUP BY doc_id"""
)
def infer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.infer_summary(lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("place"), "text", F.col("size").cast("double").alias("size")))


_SAFE = "coalesce(text, '')"
for _pattern, _new in ((r"[\x00-\x08\x0B-\x1F]", ""), *((p.replace("'", "''"), X.INJECTION_MARK) for p in X.INJECTION_PATTERNS), (r"\n{4,}", "\n\n"), (r"^\s+|\s+$", ""), (X.EMAIL, "[EMAIL]")):
    _SAFE = f"regexp_replace({_SAFE}, '{_pattern}', '{_new}', 'g')"


@query(
    f"""WITH safe AS (SELECT doc_id, source, {_SAFE} AS text FROM documents), once AS (SELECT *, substr(sha256(text), 1, 16) AS fingerprint FROM safe QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1),
    m AS (SELECT doc_id, source, fingerprint, {YEARS.replace("description", "text")}::INT AS years, length(trim(text)) AS chars, CASE WHEN text = '' THEN 1.0 ELSE length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / length(text) END AS share,
    len(list_distinct([lower(w) for w in regexp_extract_all(text, '{SECTION_WORDS}', 1)])) AS sections, len(regexp_extract_all(text, '[•▪●◦]')) AS bullets, regexp_matches(text, '{DESIGNER_TOKENS}') AS personal FROM once),
    p AS (SELECT *, 100 - CASE WHEN chars < 400 THEN 15 ELSE 0 END - CASE WHEN round(share, 3) < 0.7 THEN 20 ELSE 0 END - CASE WHEN sections < 2 THEN 15 ELSE 0 END - CASE WHEN bullets < 3 THEN 10 ELSE 0 END - CASE WHEN personal THEN 25 ELSE 0 END AS s FROM m),
    q AS (SELECT doc_id, source, fingerprint, years, round(share, 4) AS ascii, chars::INT AS chars, CASE WHEN chars < 200 THEN 0 ELSE greatest(0, s) END::INT AS score, CASE WHEN chars < 200 THEN 'block' WHEN s < 100 THEN 'warn' ELSE 'pass' END AS status FROM p)
    SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, chars DESC, doc_id) <= 10"""
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents made safe, redacted, measured, freed of copies, and the best ten of each source.

    Every text is measured where it is read, so that neither the copies' aggregate nor the ranking carries one.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", X.redact_emails(X.sanitise_untrusted("text", most=None)).alias("text"))
    further = (F.col("source"), X.doc_fingerprint("text").alias("fingerprint"), X.required_years("text").alias("years"), F.round(X.ascii_ratio("text"), 4).alias("share"))
    measured = document_quality(docs, keep=further).select("doc_id", "source", "fingerprint", "years", F.col("share").alias("ascii"), "chars", "score", "status")
    once = dedupe_first(measured, "fingerprint", ["doc_id"], keyed=True)
    best = limit_per_source(once.withColumn("place", F.struct((-F.col("score")).alias("s"), (-F.col("chars")).alias("c"), "doc_id")), 10, "place")
    return best.drop("place")
