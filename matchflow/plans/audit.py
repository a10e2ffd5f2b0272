"""Rewrite-audit queries: neighbouring turns of conversations as originals and rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.functions import guards as G
from matchflow.functions import summary as S
from matchflow.operators import audit as A
from matchflow.operators.keys import resolve_keys as resolved_keys
from matchflow.operators.similarity import batch_similarity as batch_similarity_links
from matchflow.plans.registry import bound, query, table

#: Each turn as an original with a figure and a name of its own, and a rewrite that breaks a guard or none.
PAIRS = """SELECT conv_id AS doc_id, role AS header, turn AS i, CASE turn % 2 WHEN 0 THEN 'projects' ELSE 'experience' END AS section, text AS source_text, concat('Led ', 40 + turn, '% growth of Zembla in ', text) AS original,
    CASE (conv_id + turn) % 9 WHEN 0 THEN concat('Led very agentic modern ', 40 + turn, '% growth of Zembla in ', text) WHEN 1 THEN concat('led the ', 40 + turn, '% growth of Zembla in ', text) WHEN 2 THEN concat('Led growth of Zembla in ', text)
    WHEN 3 THEN concat('Led a team to ', 40 + turn, '% growth of Zembla in ', text) WHEN 4 THEN concat('Drove ', 40 + turn, '% growth of Zembla in ', text, ' and attention to detail') WHEN 5 THEN NULL
    WHEN 6 THEN concat('Drove ', 40 + turn, '% growth and ', 42 + turn, '% of Zembla in ', text) WHEN 7 THEN concat('Drove ', 40 + turn, '% growth of Xembla in ', text) ELSE concat('Drove ', 40 + turn, '% kubernetes growth of Zembla in ', text) END AS rewrite FROM conversations"""
_P = f"WITH p AS ({PAIRS}), q AS (SELECT *, lower(original) AS o, lower(coalesce(rewrite, '')) AS r FROM p)"
_PLAIN = lambda c: rf"trim(regexp_replace(regexp_replace(' ' || regexp_replace({c}, '[^a-z0-9]+', ' ', 'g') || ' ', ' (?:(?:a|an|the) )+', ' ', 'g'), ' +', ' ', 'g'))"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, PAIRS, "conversations")


@query(
    rf"""{_P}, w AS (SELECT doc_id, header, i, [x for x in string_split_regex(o, '\s+') if x <> ''] AS a, [x for x in string_split_regex(r, '\s+') if x <> ''] AS b FROM q)
    SELECT doc_id, header, i, len(a) >= 2 AND len(b) - len(a) >= 2 AND coalesce(b[1] = a[1] AND b[len(b) - len(a) + 2:] = a[2:], false) AS jam FROM w"""
)
def keyword_jam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("doc_id", "header", "i", G.keyword_jam("original", "rewrite").alias("jam"))


@query(f"{_P} SELECT doc_id, header, i, {_PLAIN('o')} = {_PLAIN('r')} AS same FROM q")
def identical_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("doc_id", "header", "i", G.identical("original", "rewrite").alias("same"))


@query(
    rf"""{_P}, n AS (SELECT *, length(trim(original)) AS s, length(trim(coalesce(rewrite, ''))) AS t, list_filter(list_distinct(regexp_extract_all(o, '{G.NUMBER}', 1)), lambda x: NOT contains(r, x) AND NOT regexp_matches(x, '^\d+\+$') AND NOT regexp_matches(x, '^\d+[kmb]$')) AS lost FROM q)
    SELECT doc_id, header, i, t BETWEEN least(greatest(45, round_even(s * 0.78, 0)), greatest(95, round_even(s * 1.08, 0)) + 4) AND greatest(95, round_even(s * 1.08, 0)) + 4 AS fits, len(lost)::INT AS lost FROM n"""
)
def length_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("doc_id", "header", "i", G.length_fits("original", "rewrite").alias("fits"), F.size(G.lost_numbers("original", "rewrite")).alias("lost"))


@query(f"{_P} SELECT doc_id, header, i, CASE WHEN section = 'projects' AND len(list_filter({_LIST(G.TEAM_HINTS)}, lambda h: contains(o, h))) = 0 THEN list_filter({_LIST(G.TEAM_CLAIMS)}, lambda c: contains(r, c) AND NOT contains(o, c))[1] END AS claim FROM q")
def solo_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("doc_id", "header", "i", G.solo_project("original", "rewrite", "section").alias("claim"))


@query(f"{_P} SELECT doc_id, header, i, CASE WHEN regexp_matches(r, '\\bkubernetes\\b') AND NOT regexp_matches(o, '\\bkubernetes\\b') THEN 'kubernetes' END AS term, list_filter({_LIST(G.FILLERS)}, lambda c: contains(r, c) AND NOT contains(o, c))[1] AS filler FROM q")
def injected_terms_and_fillers(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array(F.lit("Kubernetes"), F.lit("io"))
    return pairs(spark, sf_dir).select("doc_id", "header", "i", G.injected_term("original", "rewrite", terms, "source_text").alias("term"), G.filler("original", "rewrite").alias("filler"))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.sibling_numbers(pairs(spark, sf_dir), ["doc_id", "header"]).withColumn("terms", F.array(F.lit("kubernetes")))
    return A.audit_rewrites(p)


_FITS = lambda t: f"length(trim({t})) BETWEEN least(greatest(45, round_even(s * 0.78, 0)), greatest(95, round_even(s * 1.08, 0)) + 4) AND greatest(95, round_even(s * 1.08, 0)) + 4"
_LOST = lambda t: rf"len(list_filter(list_distinct(regexp_extract_all(o, '{G.NUMBER}', 1)), lambda x: NOT contains(lower({t}), x) AND NOT regexp_matches(x, '^\d+\+$') AND NOT regexp_matches(x, '^\d+[kmb]$'))) > 0"
#: The opening word is always "led"; only what is around a turn's text changes, so the planted name alone is ever lost.
_GONE = lambda t: f"NOT contains(lower({t}), 'zembla')"
_BACK = lambda t: rf"""coalesce(list_filter(list_zip(({t})[2:], ({t})[:len({t}) - 1]), lambda z: regexp_replace(lower(z[1]), '[^a-z]', '', 'g') = 'led')[1][2], 'and')"""
_STRANDED = lambda t: f"(regexp_replace(lower({_BACK(t)}), '[^a-z]', '', 'g') NOT IN {_IN(G.CONNECTIVES)} AND NOT regexp_matches({_BACK(t)}, '[,;:]$'))"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_SPLIT = lambda t: rf"list_filter(string_split_regex({t}, '\s+'), lambda x: x <> '')"
_AUDITED = rf"""{_P}, w AS (SELECT *, length(trim(original)) AS s, {_SPLIT('o')} AS a, {_SPLIT('r')} AS b, {_SPLIT("coalesce(rewrite, '')")} AS ws FROM q),
    f AS (SELECT *, coalesce(len(a) >= 2 AND len(b) - len(a) >= 2 AND b[1] = a[1] AND b[len(b) - len(a) + 2:] = a[2:], false) AS jam, {_PLAIN('o')} = {_PLAIN('r')} AS same,
        CASE WHEN section = 'projects' AND len(list_filter({_LIST(G.TEAM_HINTS)}, lambda h: contains(o, h))) = 0 THEN list_filter({_LIST(G.TEAM_CLAIMS)}, lambda c: contains(r, c) AND NOT contains(o, c))[1] END AS claim,
        list_filter({_LIST(G.FILLERS)}, lambda c: contains(r, c) AND NOT contains(o, c))[1] AS filler FROM w),
    c AS (SELECT *, CASE WHEN filler IS NULL THEN rewrite ELSE trim(regexp_replace(regexp_replace(rewrite, '(?i)[\s,;]*(?:\b(?:while|and|by|thereby|thus)\s+)?' || filler, '', 'g'), '\s+([.,;])', '\1', 'g')) END AS cleaned FROM f),
    d AS (SELECT *, {_SPLIT("coalesce(cleaned, '')")} AS cs FROM c),
    t AS (SELECT DISTINCT doc_id, header, i, unnest(regexp_extract_all(o, '{G.NUMBER}', 1)) AS n FROM q),
    m AS (SELECT DISTINCT doc_id, header, i, unnest(list_filter(regexp_extract_all(r, '{G.NUMBER}', 1), lambda x: NOT list_contains(regexp_extract_all(o, '{G.NUMBER}', 1), x))) AS n FROM q),
    v AS (SELECT *, TRY_CAST(regexp_replace(n, '[%+km,$]', '', 'g') AS DOUBLE) AS bare FROM m),
    h AS (SELECT DISTINCT v.doc_id, v.header, v.i FROM v JOIN t ON t.doc_id = v.doc_id AND t.header = v.header AND t.n = v.n AND t.i <> v.i WHERE NOT coalesce(bare BETWEEN 1900 AND 2099 OR (bare < 10 AND NOT regexp_matches(v.n, '[%+km]')), false)),
    k AS (SELECT d.*, h.i IS NOT NULL AS borrowed FROM d LEFT JOIN h USING (doc_id, header, i)),
    e AS (SELECT *, CASE WHEN rewrite IS NULL THEN 'kept' WHEN jam THEN 'keyword_jam' WHEN same THEN 'identical' WHEN NOT ({_FITS('rewrite')}) OR {_LOST('rewrite')} OR {_GONE('rewrite')} OR {_STRANDED('ws')} THEN 'unsafe' WHEN claim IS NOT NULL THEN 'solo_project' WHEN borrowed THEN 'borrowed_number'
        WHEN regexp_matches(r, '\bkubernetes\b') AND NOT regexp_matches(o, '\bkubernetes\b') THEN 'injected_term' WHEN filler IS NOT NULL AND (NOT ({_FITS('cleaned')}) OR {_LOST('cleaned')} OR {_GONE('cleaned')} OR {_STRANDED('cs')}) THEN 'filler'
        WHEN length(regexp_replace(rewrite, '[^\x00-\x7F]', '', 'g')) / length(rewrite) < 0.85 THEN 'not_english' END AS reason FROM k)"""


@query(f"{_AUDITED} SELECT doc_id, header, i, reason, CASE WHEN reason IS NULL THEN cleaned ELSE original END AS accepted_text FROM e")
def audit_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).select("doc_id", "header", "i", "reason", "accepted_text")


@query(
    f"""{_AUDITED} SELECT doc_id, {', '.join(f"count_if(reason = '{r}')::BIGINT AS reverted_{r}" for r in ('keyword_jam', 'identical', 'unsafe', 'solo_project', 'borrowed_number', 'injected_term', 'filler', 'not_english'))},
    count(*) AS bullets, count(rewrite) AS tried, count_if(reason <> 'kept')::BIGINT AS reverted, count(rewrite) > 0 AND count_if(reason <> 'kept') = count(rewrite) AS all_reverted, count(*) >= 5 AND count(rewrite) = 0 AS untouched FROM e GROUP BY doc_id"""
)
def guard_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.guard_rollup(_audited(spark, sf_dir))


@query(
    f"""{_P}, t AS (SELECT DISTINCT doc_id, header, i, unnest(regexp_extract_all(o, '{G.NUMBER}', 1)) AS n FROM q),
    o AS (SELECT q.doc_id, q.header, q.i, string_agg(DISTINCT t.n, ',' ORDER BY t.n) AS shared FROM q JOIN t ON t.doc_id = q.doc_id AND t.header = q.header AND t.i <> q.i GROUP BY ALL)
    SELECT doc_id, header, i, coalesce(shared, '') AS shared FROM q LEFT JOIN o USING (doc_id, header, i)"""
)
def sibling_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.sibling_numbers(pairs(spark, sf_dir), ["doc_id", "header"])
    return found.select("doc_id", "header", "i", F.array_join(F.sort_array("sibling_numbers"), ",").alias("shared"))


_BULLETS = "SELECT conv_id AS doc_id, role AS header, turn AS i, text FROM conversations"
_EDITS = "SELECT conv_id AS doc_id, role AS header, 100 - turn AS pos, CASE turn % 4 WHEN 3 THEN turn + 50 ELSE turn END AS i, CASE turn % 3 WHEN 0 THEN NULL ELSE concat('new ', text) END AS text FROM conversations WHERE turn % 5 > 0"


@query(
    f"""WITH b AS ({_BULLETS}), e AS (SELECT * FROM ({_EDITS}) AS x QUALIFY row_number() OVER (PARTITION BY doc_id, header, i ORDER BY pos) = 1)
    SELECT doc_id, header, i, row_number() OVER (PARTITION BY doc_id, header ORDER BY e.pos IS NULL, e.pos, i)::INT AS place, coalesce(e.text, b.text) AS text, e.pos IS NOT NULL AS listed FROM b LEFT JOIN e USING (doc_id, header, i)"""
)
def apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.apply_edits(bound(spark, sf_dir, _BULLETS, "conversations"), bound(spark, sf_dir, _EDITS, "conversations"))


@query(f"WITH b AS (SELECT doc_id, count(*) AS n FROM ({_BULLETS}) AS x GROUP BY 1), e AS (SELECT doc_id, count(text) AS r, count(*) AS m FROM ({_EDITS}) AS y GROUP BY 1) SELECT doc_id, coalesce(r, 0) AS rewrites, greatest(0, n - coalesce(m, 0)) AS drops FROM b LEFT JOIN e USING (doc_id)")
def edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.edit_counts(bound(spark, sf_dir, _EDITS, "conversations"), bound(spark, sf_dir, _BULLETS, "conversations"))


@query(f"{_P}, c AS (SELECT doc_id, round(avg(coalesce(trim(original) <> trim(rewrite), false)::INT), 6) AS rate FROM p GROUP BY 1) SELECT doc_id, rate, coalesce(rate >= 0.5, true) AS passes FROM c")
def bullet_change_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).withColumn("i", F.concat_ws(":", "header", "i"))
    return A.bullet_change_rate(p.select("doc_id", "i", F.col("original").alias("text")), p.select("doc_id", "i", F.col("rewrite").alias("text")))


_TERMS = f"[lower(regexp_replace(t, '[-+&]+$', '')) for t in regexp_extract_all(text, '{A.TERM}', 1)]"
_SALIENT = ["the", "and", "for", "with"]


@query(
    f"""WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS n FROM t WHERE term NOT IN ('the', 'and', 'for', 'with') AND length(term) >= 3 GROUP BY ALL),
    s AS (SELECT *, count_if(n >= 2) OVER (PARTITION BY doc_id) AS strong FROM c), p AS (SELECT doc_id, term, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term)::INT AS place FROM s WHERE n >= 2 OR strong < 6) SELECT * FROM p WHERE place <= 28"""
)
def salient_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.salient_terms(table(spark, sf_dir, "documents"), "text", _SALIENT)


@query(
    f"""WITH k AS (SELECT conv_id AS pair_id, unnest(list_distinct({_TERMS})) AS term FROM conversations WHERE role = 'user'), v AS (SELECT * FROM k UNION SELECT pair_id, term || 's' FROM k UNION SELECT pair_id, regexp_replace(term, 's$', '') FROM k),
    t AS (SELECT DISTINCT conv_id AS pair_id, unnest(list_distinct({_TERMS})) AS term FROM conversations WHERE role = 'assistant') SELECT pair_id, term FROM t WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.pair_id = t.pair_id AND v.term = t.term)"""
)
def novel_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "pair_id")
    return A.novel_terms(c.filter("role = 'user'"), c.filter("role = 'assistant'"))


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(concat_ws(' ', text, source)), '[^a-z0-9+]+'), lambda x: x <> '') AS w FROM documents),
    t AS (SELECT doc_id, unnest(list_concat(list_filter(w, lambda x: length(x) >= 2), [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS term FROM w) SELECT DISTINCT doc_id, term FROM t"""
)
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.vocabulary(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


@query(
    """WITH t AS (SELECT doc_id, unnest(list_concat(string_split(text, ' '), string_split_regex(text, '[ .]'))) AS term, generate_subscripts(list_concat(string_split(text, ' '), string_split_regex(text, '[ .]')), 1) AS pos FROM documents),
    m AS (SELECT doc_id, arg_min(trim(term), pos) AS term FROM t WHERE length(trim(term)) >= 3 GROUP BY doc_id, lower(trim(term))) SELECT doc_id, count(*)::INT AS merged, count_if(lower(term) NOT IN ('the', 'and', 'that'))::INT AS kept FROM m GROUP BY doc_id"""
)
def merge_and_subtract_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("a"), F.split("text", "[ .]").alias("b"))
    merged = A.merge_terms(d, "doc_id", "a", "b")
    plain = F.filter("terms", lambda t: t.rlike("^[A-Za-z]+$"))
    kept = F.size("terms") - F.size(plain) + F.size(A.subtract_terms(plain, ["the", "and", "that"]))
    return merged.select("doc_id", F.size("terms").alias("merged"), kept.alias("kept"))


_KEYS = """SELECT o_custkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN concat('Acme ', o_orderpriority) WHEN 1 THEN concat('acme ', lower(o_orderpriority), ' Jan 2020') WHEN 2 THEN 'Globex North team lead' ELSE 'nothing' END AS key FROM orders"""


_KEY_TOKENS = lambda c: f"list_distinct(list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: length(w) >= 2 AND w NOT IN {_IN(A.KEY_STOP_WORDS)} AND NOT regexp_matches(w, '^[0-9]+$')))"
_HEADERS = "SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN concat('Acme ', o_orderpriority) ELSE 'Lead of North, Globex' END AS header, min(o_orderkey) AS place FROM orders GROUP BY 1, 2"


@query(
    f"""WITH k AS (SELECT DISTINCT * FROM ({_KEYS}) AS x), h AS ({_HEADERS}), p AS (SELECT k.*, header, place, lower(trim(key)) AS a, lower(trim(header)) AS b, {_KEY_TOKENS('key')} AS x, {_KEY_TOKENS('header')} AS y FROM k JOIN h USING (doc_id)),
    r AS (SELECT *, CASE WHEN len(x) > 0 THEN len(list_intersect(x, y)) / len(x) ELSE 0 END AS share FROM p), t AS (SELECT *, CASE WHEN a = b THEN 0 WHEN a <> '' AND (starts_with(b, a) OR starts_with(a, b) OR contains(b, a)) THEN 1 WHEN share >= 0.6 THEN 2 END AS tier FROM r),
    m AS (SELECT doc_id, key, header FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY tier, CASE WHEN tier = 2 THEN -share ELSE 0 END, CASE WHEN tier = 2 THEN length(header) ELSE 0 END, place) = 1) SELECT doc_id, key, header FROM k LEFT JOIN m USING (doc_id, key)"""
)
def resolve_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = bound(spark, sf_dir, _KEYS, "orders").distinct()
    headers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Acme "), "o_orderpriority")).otherwise("Lead of North, Globex").alias("header"), F.col("o_orderkey").alias("place"))
    return resolved_keys(keys, headers)


@query(
    f"""WITH s AS (SELECT source, doc_id, list_distinct({_TERMS}) AS x FROM documents WHERE len({_TERMS}) > 0), c AS (SELECT *, min(doc_id) OVER (PARTITION BY source, list_sort(x)) AS first FROM s), f AS (SELECT * FROM c WHERE doc_id = first),
    p AS (SELECT a.source, a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.x, b.x)) AS k, len(a.x) AS m, len(b.x) AS n FROM f AS a JOIN f AS b ON a.source = b.source AND a.doc_id < b.doc_id)
    SELECT source, a, b, round(k / (m + n - k), 6) AS similarity FROM p WHERE round(k / (m + n - k), 6) >= 0.7 UNION ALL SELECT source, first, doc_id, 1.0 FROM c WHERE doc_id > first"""
)
def batch_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_similarity_links(table(spark, sf_dir, "documents"), "source")


#: What is put before each turn's text, and its parts of each kind; texts have none of these forms but figures.
_AWARDED = "First-class graduate (3.8/4.0 GPA) with 5+ years, $3M saved, Spotlight Awards. "


@query(
    rf"""{_P}, c AS (SELECT *, concat('{_AWARDED}', original) AS t FROM p), g AS (SELECT *, [lower(trim(x)) for x in regexp_extract_all(t, '(?i)(\d[\d.,]*%|\$\d[\d.,]*[KMB]?)', 1)] AS found FROM c), n AS (SELECT *, list_concat(['first-class', '3.8/4.0 gpa', '5+ years'], list_filter(found, lambda x, k: list_position(found, x) = k), ['saved', 'spotlight']) AS every FROM g),
    b AS (SELECT *, len(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')) AS o, len(list_filter(string_split_regex(coalesce(rewrite, ''), '\s+'), lambda x: x <> '')) AS m FROM n)
    SELECT doc_id, header, i, array_to_string(list_filter(every, lambda x: x <> 'saved' AND NOT contains(lower(coalesce(rewrite, '')), x)), ',') AS lost,
    CASE WHEN o < 20 THEN CASE WHEN m > 60 THEN 'long' ELSE 'stub' END WHEN m < o * 0.80 THEN 'short' WHEN m > o * 1.12 THEN 'long' WHEN m BETWEEN o * 0.97 AND o * 1.08 THEN 'ok' ELSE 'off_target' END AS band FROM b"""
)
def lost_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).withColumn("original", F.concat(F.lit(_AWARDED), "original"))
    return p.select("doc_id", "header", "i", F.array_join(G.lost_credentials("original", "rewrite"), ",").alias("lost"), G.length_band("original", "rewrite").alias("band"))


#: A summary around each turn's text, and a rewrite that breaks the guard that its number stands for, or none.
_SUMMARIES = """SELECT conv_id, role, turn, b, CASE WHEN k = 0 THEN '' WHEN k = 1 THEN 'Short profile of Cedar Ports.' ELSE concat(lead, b, ' ends.') END AS original,
    CASE k WHEN 1 THEN concat(lead, b, b, ' one two three four five six seven eight nine ten', extra, extra, extra, extra, extra) WHEN 2 THEN concat(lead, b, ' in marketing.') WHEN 3 THEN concat(lead, b, ' of Zanzibar.') WHEN 4 THEN concat('builder of Cedar Ports, 5+ years. ', b, ' ends.')
    WHEN 5 THEN concat(lead, b, ' ends', repeat('é', 20 + length(b))) WHEN 6 THEN concat(lead, b, '. Made seven small tools for dull daily chores.') WHEN 7 THEN concat('builder of things, 5+ years, 40%. ', b, ' ends.') WHEN 8 THEN concat(lead, b, extra, extra, extra, extra, ' ', b, ' ', b)
    WHEN 9 THEN NULL ELSE concat(lead, b, ' ended.') END AS rewrite, k
    FROM (SELECT conv_id, role, turn, (conv_id + turn) % 11 AS k, 'builder of Cedar Ports, 5+ years, 40%. ' AS lead, ' one two three four five six seven eight nine ten eleven twelve' AS extra,
        concat(lower(text), ' and one two three four five six seven eight nine ten eleven twelve') AS b FROM conversations) AS c"""


@query(
    f"""WITH s AS ({_SUMMARIES}), r AS (SELECT *, CASE k WHEN 0 THEN 'no_original' WHEN 1 THEN 'stub_overflow' WHEN 2 THEN 'identity' WHEN 3 THEN 'foreign_terms' WHEN 4 THEN 'credentials' WHEN 5 THEN 'language' WHEN 6 THEN 'absorbed_bullet' WHEN 7 THEN 'project_dropped' WHEN 8 THEN 'length' END AS reason FROM s)
    SELECT conv_id, role, turn, reason AS summary_reason, trim(CASE WHEN reason IS NULL AND rewrite IS NOT NULL THEN rewrite ELSE original END) AS accepted_summary FROM r"""
)
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bound(spark, sf_dir, _SUMMARIES, "conversations")
    bullets = "array('made seven small tools for dull daily chores', 'led a few friends')"
    roles = F.expr(f"array(named_struct('header', 'Cedar Ports | Python', 'section', 'Projects', 'bullets', {bullets}), named_struct('header', 'Lead of North', 'section', 'Experience', 'bullets', cast(array() as array<string>)))")
    ready = s.withColumn("roles", roles.cast(S.ROLES)).withColumn("source_text", F.concat_ws(" ", "b", F.lit("builder of Cedar Ports made short profile")))
    return A.audit_summary(ready).select("conv_id", "role", "turn", "summary_reason", "accepted_summary")


_NAMED = "SELECT doc_id, text, concat('Built with ', CASE doc_id % 4 WHEN 0 THEN 'JavaHouse and AWS' WHEN 1 THEN 'Node.js' WHEN 2 THEN 'the University of Zembla' ELSE 'It' END, '. ', text) AS letter FROM documents"


@query(
    rf"""WITH l AS ({_NAMED}), t AS (SELECT *, regexp_extract_all(letter, '\b(?:[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+|[A-Z]{{2,}}(?:\+\+|#)?|[A-Z][A-Za-z]*(?:\.[A-Za-z]+)+)') AS names FROM l)
    SELECT doc_id, array_to_string([n for n, i in names if NOT contains(lower(text), lower(n)) AND list_position([lower(x) for x in names], lower(n)) = i], '|') AS in_letter, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS in_summary FROM t"""
)
def foreign_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchflow.functions import letters

    d = bound(spark, sf_dir, _NAMED, "documents")
    strange = F.filter(S.foreign_terms("letter", "text"), lambda t: t.rlike("Zembla|JavaHouse"))
    return d.select("doc_id", F.array_join(letters.foreign_terms("letter", "text"), "|").alias("in_letter"), F.size(strange).alias("in_summary"))


@query(
    r"""WITH s AS (SELECT conv_id, turn, role, trim(regexp_replace(regexp_replace(regexp_replace(concat('Led Kubernetes and ', text), '(?i)\b(kubernetes|the)\b', '', 'g'), '\s+', ' ', 'g'), '(?i)[\s,;]*\b(and|or|with|for|of|in|to)\s*$', '')) AS t FROM conversations)
    SELECT conv_id, turn, role, CASE WHEN len(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')) < 2 THEN '' ELSE t END AS phrase FROM s"""
)
def scrub_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("phrase", F.concat(F.lit("Led Kubernetes and "), "text"))
    return c.select("conv_id", "turn", "role", A.scrub_terms("phrase", F.array(F.lit("kubernetes"), F.lit("the"))).alias("phrase"))
