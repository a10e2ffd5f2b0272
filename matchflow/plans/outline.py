"""Document-structure queries: documents written out as CVs with sections, roles and bullets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.functions import structure as S
from matchflow.operators import outline as O
from matchflow.operators.written import checkpointed
from matchflow.plans.registry import bound, query, table

#: Every document's whole text as bullets under headings; the same text runs in Spark and in DuckDB.
CVS = """SELECT doc_id, text AS body, concat('Jane Doe', chr(10), CASE doc_id % 3 WHEN 0 THEN 'Professional Summary:' WHEN 1 THEN 'Profile' ELSE 'Open-Source Projects' END, chr(10), 'About ', source, chr(10),
    'Experience', chr(10), 'Acme Corp | 2019 - 2021', chr(10), '• ', replace(text, '. ', concat('.', chr(10), CASE doc_id % 2 WHEN 0 THEN '• ' ELSE '- ' END)), chr(10), chr(10), 'Initech Jan 2015 to 2018', chr(10), 'Senior clerk', chr(10), '• Ran it', chr(10), '• Ran it', chr(10),
    'Skills', chr(10), 'SQL, ', lang, '; Spark', chr(10), 'Education', chr(10), 'BSc ', source) AS text FROM documents"""

_HEAD = "trim(regexp_replace(trim(lower(text)), ':+$', ''))"
_HEADING = "CASE " + " ".join(f"WHEN {_HEAD} IN ({', '.join(repr(n) for n in names)}) THEN '{kind}'" for kind, names in S.HEADINGS.items()) + f" WHEN length({_HEAD}) <= 40 AND regexp_matches({_HEAD}, '{S.PROJECTS}') THEN 'projects' END"
_BULLET = f"regexp_matches(text, '{S.BULLET}')"
_C = f"WITH cvs AS ({CVS}), raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM cvs)"
_SECTIONS = lambda src: f"""(SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER w, 'header') AS kind, count(heading) OVER w AS section_no FROM (SELECT *, {_HEADING} AS heading FROM {src}) AS x
    WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""  # noqa: E731
_JOINED = f"""k AS (SELECT *, CASE WHEN trim(text) = '' THEN 0 WHEN {_BULLET} THEN 1 WHEN {_HEADING} IS NOT NULL THEN 0 ELSE 2 END AS kk FROM raw),
    s AS (SELECT *, NOT (kk = 2 AND coalesce(last_value(CASE WHEN kk < 2 THEN kk END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1) AS starts FROM k),
    i AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM s),
    joined AS (SELECT doc_id, min(line_no) AS line_no, string_agg(CASE WHEN starts THEN text ELSE trim(text) END, ' ' ORDER BY line_no) AS text FROM i GROUP BY doc_id, island)"""
_ROLES = f"""sec AS {_SECTIONS('joined')}, body AS (SELECT *, {_BULLET} AS bullet FROM sec WHERE heading IS NULL AND trim(text) <> '' AND kind IN ('experience', 'projects')),
    o AS (SELECT *, NOT bullet AND coalesce(lag(bullet) OVER (PARTITION BY doc_id, section_no ORDER BY line_no), true) AS opens FROM body),
    r AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id, section_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS role_no FROM o),
    roles AS (SELECT doc_id, section_no, kind, role_no, coalesce(max(CASE WHEN opens THEN trim(text) END), '(unnamed)') AS header, list(trim(regexp_replace(text, '{S.BULLET}', '')) ORDER BY line_no) FILTER (bullet) AS bullets FROM r GROUP BY ALL HAVING count_if(bullet) > 0)"""
_FLAT = """t AS (SELECT doc_id, kind, section_no, string_agg(trim(text), chr(10) ORDER BY line_no) AS text FROM sec WHERE heading IS NULL AND trim(text) <> '' GROUP BY ALL)"""


def cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, CVS, "documents")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.doc_lines(cvs(spark, sf_dir))


@query(f"{_C} SELECT doc_id, line_no::INT AS line_no, kind, section_no::INT AS section_no FROM {_SECTIONS('raw')} AS z")
def assign_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.assign_sections(_lines(spark, sf_dir)).select("doc_id", "line_no", "kind", "section_no")


@query(f"{_C}, {_JOINED} SELECT doc_id, line_no::INT AS line_no, text FROM joined")
def coalesce_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.coalesce_bullets(_lines(spark, sf_dir)).select("doc_id", "line_no", "text")


@query(
    f"""{_C}, l AS (SELECT *, last_value(CASE WHEN trim(text) <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM raw)
    SELECT doc_id, line_no::INT AS line_no, text FROM l WHERE trim(text) = '' OR last IS NULL OR text <> last"""
)
def drop_consecutive_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.drop_consecutive_dups(_lines(spark, sf_dir)).select("doc_id", "line_no", "text")


@query(
    rf"""{_C}, z AS (SELECT doc_id, line_no, CASE line_no % 4 WHEN 0 THEN concat('Own Projects Tool | ', text) WHEN 1 THEN concat('Degree | ', text) WHEN 2 THEN concat('2019 - 2021 | ', text) ELSE text END AS t FROM raw)
    SELECT doc_id, line_no::INT AS line_no, contains(t, '|') AND (regexp_matches(t, '(?i)year|degree') OR regexp_matches(t, '\d{{4}}\s*[-–]\s*\d{{4}}\s*\|')) AS is_table,
    CASE WHEN line_no % 4 = 0 AND regexp_matches(t, '^((?:[A-Z][a-z]+ ){{0,2}}Projects) +(\S.{{3,}})$') THEN 'Own Projects~' || substr(t, 14) ELSE t END AS parts FROM z"""
)
def tables_and_merged_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.when(F.col("line_no") % 4 == 0, "Own Projects Tool | ").when(F.col("line_no") % 4 == 1, "Degree | ").when(F.col("line_no") % 4 == 2, "2019 - 2021 | ").otherwise("")
    l = _lines(spark, sf_dir).withColumn("t", F.concat(lead, "text"))
    return l.select("doc_id", "line_no", S.looks_like_table("t").alias("is_table"), F.array_join(S.split_merged_heading("t"), "~").alias("parts"))


_KINDS = "SELECT o_custkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN 'summary' WHEN 1 THEN 'experience' WHEN 2 THEN 'experience' ELSE 'skills' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN '• led it' ELSE 'led it' END AS text, o_orderkey AS section_no FROM orders"


@query(
    f"""WITH s AS ({_KINDS}), m AS (SELECT *, bool_or(kind = 'summary') OVER w AS has, min(CASE WHEN kind = 'experience' AND text = 'led it' THEN section_no END) OVER w AS first FROM s WINDOW w AS (PARTITION BY doc_id))
    SELECT doc_id, section_no, CASE WHEN NOT has AND section_no = first THEN 'summary' ELSE kind END AS kind FROM m"""
)
def promote_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.promote_summary(bound(spark, sf_dir, _KINDS, "orders")).select("doc_id", "section_no", "kind")


_CONVERTED = "SELECT o_orderkey AS doc_id, 1000 + o_orderkey % 500 AS a, 300 + o_orderkey % 1200 AS b, o_orderkey % 4 AS sections, o_orderkey % 3 AS columns, 1000 AS bytes_in, 1000 * (o_orderkey % 5) AS bytes_out FROM orders"


@query(
    f"""WITH c AS ({_CONVERTED}), s AS (SELECT doc_id, CASE WHEN b >= 0.8 * a THEN 60 WHEN b >= 0.5 * a THEN 30 ELSE 0 END + CASE WHEN sections >= 2 THEN 20 ELSE 0 END + CASE WHEN columns <= 1 THEN 10 ELSE 0 END + CASE WHEN bytes_out <= 3 * bytes_in THEN 10 ELSE 0 END AS coverage FROM c)
    SELECT doc_id, coverage::INT AS coverage, coverage >= 70 AS accepted FROM s"""
)
def extraction_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound(spark, sf_dir, _CONVERTED, "orders")
    return O.extraction_coverage(c, "a", "b", "sections", "columns", "bytes_in", "bytes_out").select("doc_id", "coverage", "accepted")


@query(f"{_C}, {_JOINED}, {_ROLES} SELECT doc_id, section_no::INT AS section_no, kind, role_no::INT AS role_no, header, array_to_string(bullets, '|') AS bullets FROM roles")
def assign_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.document_roles(cvs(spark, sf_dir)).select("doc_id", "section_no", "kind", "role_no", "header", F.array_join("bullets", "|").alias("bullets"))


@query(
    f"""{_C}, {_JOINED}, {_ROLES}, b AS (SELECT doc_id, section_no, kind, role_no, unnest(bullets) AS b, generate_subscripts(bullets, 1) - 1 AS i FROM roles),
    x AS (SELECT doc_id, section_no, kind, role_no * 1000000 + i AS role_no, CASE WHEN i % 4 = 3 THEN b || ' – Acme' ELSE b END AS header, b FROM b),
    m AS (SELECT *, row_number() OVER w = 1 OR regexp_matches(header, '{O.ROLE_SIGNAL}') AS keeps FROM x WINDOW w AS (PARTITION BY doc_id, section_no ORDER BY role_no)),
    n AS (SELECT *, sum(keeps::INT) OVER (PARTITION BY doc_id, section_no ORDER BY role_no) AS place FROM m)
    SELECT doc_id, section_no::INT AS section_no, kind, min(role_no)::INT AS role_no, arg_min(header, role_no) AS header, string_agg(b, '|' ORDER BY role_no) AS bullets FROM n GROUP BY doc_id, section_no, kind, place"""
)
def merge_fragmented_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bullet as a role of its own, each fourth with a dash in its header."""
    roles = O.document_roles(cvs(spark, sf_dir))
    single = roles.select("doc_id", "section_no", "kind", "role_no", F.posexplode("bullets").alias("i", "b"))
    header = F.when(F.col("i") % 4 == 3, F.concat("b", F.lit(" – Acme"))).otherwise(F.col("b"))
    merged = O.merge_fragmented_roles(single.select("doc_id", "section_no", "kind", (F.col("role_no") * 1_000_000 + F.col("i")).alias("role_no"), header.alias("header"), F.array("b").alias("bullets")))
    return merged.select("doc_id", "section_no", "kind", "role_no", "header", F.array_join("bullets", "|").alias("bullets"))


_OUTLINE = f"""{_C}, {_JOINED}, {_ROLES}, {_FLAT}, f AS (SELECT doc_id, arg_min(text, section_no) FILTER (kind = 'summary') AS summary, arg_min(text, section_no) FILTER (kind = 'education') AS education, arg_min(text, section_no) FILTER (kind = 'skills') AS skills FROM t GROUP BY doc_id),
    n AS (SELECT doc_id, count(*) AS n_roles, sum(len(bullets)) AS n_bullets, list(struct_pack(h := header, b := bullets) ORDER BY section_no, role_no) AS roles FROM roles GROUP BY doc_id),
    outline AS (SELECT doc_id, coalesce(summary, '') AS summary, coalesce(education, '') AS education, [trim(x) for x in string_split_regex(coalesce(skills, ''), '[,;|•\\n]') if trim(x) <> ''] AS skills, coalesce(n_roles, 0) AS n_roles, coalesce(n_bullets, 0) AS n_bullets, roles FROM cvs LEFT JOIN f USING (doc_id) LEFT JOIN n USING (doc_id))"""


_WRITTEN = lambda roles: f"sha256(coalesce(array_to_string([r.h || '~' || array_to_string(r.b, '~') for r in {roles}], chr(10)), ''))"


def _outlines(spark: SparkSession, sf_dir: str, merge_roles: bool) -> DataFrame:
    out = O.parse_outline(cvs(spark, sf_dir), merge_roles=merge_roles)
    written = F.array_join(F.transform("roles", lambda r: F.concat_ws("~", r["header"], F.array_join(r["bullets"], "~"))), "\n")
    return out.select("doc_id", "summary", "education", F.array_join("skills", "|").alias("skills"), F.coalesce(F.size("roles"), F.lit(0)).alias("n_roles"), F.sha2(F.coalesce(written, F.lit("")), 256).alias("roles"))


@query(f"{_OUTLINE} SELECT doc_id, summary, education, array_to_string(skills, '|') AS skills, n_roles::INT AS n_roles, {_WRITTEN('roles')} AS roles FROM outline")
def parse_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outlines(spark, sf_dir, False)


@query(
    f"""{_OUTLINE}, mk AS (SELECT *, row_number() OVER w = 1 OR regexp_matches(header, '[0-9]{{4}}') AS keeps FROM roles WINDOW w AS (PARTITION BY doc_id, section_no ORDER BY role_no)),
    mn AS (SELECT *, sum(keeps::INT) OVER (PARTITION BY doc_id, section_no ORDER BY role_no) AS place FROM mk),
    mm AS (SELECT doc_id, section_no, min(role_no) AS role_no, arg_min(header, role_no) AS h, flatten(list(bullets ORDER BY role_no)) AS b FROM mn GROUP BY doc_id, section_no, place),
    md AS (SELECT doc_id, count(*) AS k, list(struct_pack(h := h, b := b) ORDER BY section_no, role_no) AS roles FROM mm GROUP BY doc_id)
    SELECT doc_id, summary, education, array_to_string(skills, '|') AS skills, coalesce(k, 0)::INT AS n_roles, {_WRITTEN('md.roles')} AS roles FROM outline LEFT JOIN md USING (doc_id)"""
)
def parse_outline_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles without a date or dash are merged; the written CVs' only signals are years."""
    return _outlines(spark, sf_dir, True)


@query(f"{_OUTLINE} SELECT doc_id, n_bullets::INT AS bullets, n_bullets = 0 AS zero_bullets FROM outline")
def drop_zero_bullet_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.drop_zero_bullet_docs(O.parse_outline(cvs(spark, sf_dir)))


_CHUNKS = f"""{_OUTLINE}, e AS (SELECT doc_id, unnest(roles) AS r, generate_subscripts(roles, 1) - 1 AS idx FROM outline),
    chunks AS (SELECT doc_id, 'summary' AS section, '' AS role, 0 AS idx, summary AS text FROM outline WHERE trim(summary) <> '' UNION ALL SELECT doc_id, 'role_block', r.h, idx, r.h || chr(10) || array_to_string(['• ' || b for b in r.b], chr(10)) FROM e
    UNION ALL SELECT doc_id, 'skills_block', '', 0, 'SKILLS: ' || array_to_string(skills, ', ') FROM outline WHERE len(skills) > 0 UNION ALL SELECT doc_id, 'education', '', 0, 'EDUCATION:' || chr(10) || education FROM outline WHERE education <> '')"""


@query(f"{_CHUNKS} SELECT doc_id, section, role, idx::INT AS idx, text FROM chunks")
def build_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.build_chunks(O.parse_outline(cvs(spark, sf_dir)))


@query()
def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.embed_chunks(O.build_chunks(O.parse_outline(cvs(spark, sf_dir)))).select("doc_id", "section", "idx", "embedding")


@query(f"{_CHUNKS} SELECT doc_id, section, idx::INT AS idx FROM chunks WHERE doc_id % 3 > 0")
def to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = checkpointed(O.build_chunks(O.parse_outline(cvs(spark, sf_dir))).select("doc_id", "section", "idx"))
    stored = chunks.filter("doc_id % 3 = 0 or section = 'summary'").select("doc_id")
    return O.to_index(chunks, stored).select("doc_id", "section", "idx")


_CONTEXT = f"""{_CHUNKS}, g AS (SELECT doc_id, section, CASE section {' '.join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(O.CONTEXT))} END AS place,
    CASE section {' '.join(f"WHEN '{s}' THEN '{h}'" for s, h in O.CONTEXT.items())} END || chr(10) || string_agg(text, chr(10) ORDER BY idx) AS part FROM chunks GROUP BY doc_id, section),
    context AS (SELECT doc_id, string_agg(part, chr(10) || chr(10) ORDER BY place) AS context FROM g GROUP BY doc_id)"""


@query(f"{_CONTEXT} SELECT doc_id, context FROM context")
def assemble_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.assemble_context(O.build_chunks(O.parse_outline(cvs(spark, sf_dir))))


@query(f"{_CONTEXT} SELECT doc_id, length(context) < 0.95 * length(text) AS full_text, length(CASE WHEN length(context) < 0.95 * length(text) THEN text ELSE context END)::INT AS chars FROM context JOIN cvs USING (doc_id)")
def context_or_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cvs(spark, sf_dir)
    both = O.assemble_context(O.build_chunks(O.parse_outline(c))).join(c, "doc_id")
    return both.select("doc_id", (F.length("context") < 0.95 * F.length("text")).alias("full_text"), F.length(O.context_or_full("context", "text")).alias("chars"))


_QUALITY = f"""WITH cvs AS ({CVS}), m AS (SELECT doc_id, length(trim(text)) AS chars, round(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / length(text), 3) AS ascii,
    len(list_distinct([lower(w) for w in regexp_extract_all(text, '{O.SECTION_WORDS}', 1)])) AS sections, len(regexp_extract_all(text, '[•▪●◦]')) AS bullets, regexp_matches(text, '{O.DESIGNER_TOKENS}') AS personal FROM cvs),
    p AS (SELECT *, 100 - CASE WHEN chars < 400 THEN 15 ELSE 0 END - CASE WHEN ascii < 0.7 THEN 20 ELSE 0 END - CASE WHEN sections < 2 THEN 15 ELSE 0 END - CASE WHEN bullets < 3 THEN 10 ELSE 0 END - CASE WHEN personal THEN 25 ELSE 0 END AS s FROM m),
    q AS (SELECT doc_id, chars, ascii, sections, bullets, CASE WHEN chars < 200 THEN 0 ELSE greatest(s, 0) END AS score, CASE WHEN chars < 200 THEN 'block' WHEN s < 100 THEN 'warn' ELSE 'pass' END AS status FROM p)"""


@query(f"{_QUALITY} SELECT doc_id, chars::INT AS chars, ascii, sections::INT AS sections, bullets::INT AS bullets, score::INT AS score, status FROM q")
def document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.document_quality(cvs(spark, sf_dir)).select("doc_id", "chars", "ascii", "sections", "bullets", "score", "status")


@query(f"{_QUALITY} SELECT status, count(*) AS documents, round(avg(score), 4) AS mean_score FROM q GROUP BY status")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.quality_report(O.document_quality(cvs(spark, sf_dir)))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS p FROM documents), c AS (SELECT doc_id, w, count(*) AS n, min(p) AS f FROM l GROUP BY ALL)
    SELECT doc_id, w AS mode FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1"""
)
def term_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ", -1).alias("words"))
    return O.list_mode(words, "doc_id", "words", "-")


@query(f"{_C} SELECT doc_id, section_no::INT AS section_no, kind, row_number() OVER (PARTITION BY doc_id ORDER BY CASE kind {' '.join(f'''WHEN '{k}' THEN {i}''' for i, k in enumerate(S.ORDER))} ELSE 5 END, section_no)::INT AS place FROM {_SECTIONS('raw')} AS z WHERE heading IS NOT NULL")
def section_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    heads = O.assign_sections(_lines(spark, sf_dir)).filter("heading is not null")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(S.section_rank("kind"), "section_no"))
    return heads.select("doc_id", "section_no", "kind", place.alias("place"))


#: Headers in three cases of letters, and what the SQL takes for their dates.
_CASED = "CASE doc_id % 3 WHEN 0 THEN upper(header) WHEN 1 THEN lower(header) ELSE header END"
_DATED = r"((jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s*[0-9]{4}.*|\b[0-9]{4}\s*[-–—]\s*([0-9]{4}|present|current|[0-9]{2}))"
_EDGE = r"[\s.,–—(|:;-]+"


@query(
    rf"""{_C}, {_JOINED}, {_ROLES}, h AS (SELECT *, trim({_CASED}) AS raw FROM roles), d AS (SELECT *, regexp_extract(raw, '(?i){_DATED}') AS found FROM h),
    t AS (SELECT *, regexp_replace(regexp_replace(replace(raw, found, ''), '^{_EDGE}', ''), '[\s.,–—(|:;)-]+$', '') AS title FROM d)
    SELECT doc_id, section_no::INT AS section_no, role_no::INT AS role_no, CASE WHEN found = '' OR title = '' THEN raw ELSE title END AS title, trim(found) AS dates FROM t"""
)
def role_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = O.document_roles(cvs(spark, sf_dir))
    return roles.select("doc_id", "section_no", "role_no", S.split_role_header(F.expr(_CASED)).alias("h")).select("doc_id", "section_no", "role_no", "h.*")


#: A third each: bullets with glyphs inside, lines that begin with verbs, sentences that end lines.
_RUN_TOGETHER = f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN concat('Built it ', replace(replace(text, '•', ''), '. ', concat(' ', chr(10), ' Led a ')), chr(10), 'Kept') ELSE replace(replace(text, '•', ''), '. ', concat('.', chr(10))) END AS text FROM ({CVS}) AS cvs"


@query(
    rf"""WITH m AS ({_RUN_TOGETHER}), c AS (SELECT doc_id, trim(text) AS c FROM m), l AS (SELECT *, string_split_regex(c, '\s*\n\s*') AS rows FROM c),
    n AS (SELECT *, len(list_filter(rows, lambda r: regexp_matches(r, '^(Built|Led)\b'))) AS led FROM l),
    p AS (SELECT doc_id, CASE WHEN length(c) < 100 THEN [c] WHEN regexp_matches(c, '\n\s*[•▪●◦]') THEN string_split_regex(c, '\n\s*[•▪●◦]\s*') WHEN length(c) > 250 AND led >= 2 AND 2 * led >= len(rows) - len(rows) % 2 THEN rows
        WHEN length(c) - length(replace(c, chr(10), '')) >= 2 AND length(c) > 250 THEN list_transform(string_split_regex(c, '\.\s*\n\s*'), lambda x, i: CASE WHEN i < len(string_split_regex(c, '\.\s*\n\s*')) THEN x || '.' ELSE x END) ELSE [c] END AS parts FROM n),
    b AS (SELECT doc_id, list_filter([trim(regexp_replace(x, '^\s*[•▪●◦]\s*', '')) for x in parts], lambda x: x <> '') AS parts FROM p)
    SELECT doc_id, unnest(parts) AS bullet, (generate_subscripts(parts, 1) - 1)::INT AS i FROM b"""
)
def split_mega_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, _RUN_TOGETHER, "documents").select("doc_id", F.posexplode(S.split_mega_bullets("text")).alias("i", "bullet"))
