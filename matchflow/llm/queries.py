"""One thin query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.llm.common import crc_remainder, shared_folder, table

#: Vocabulary files, beside the library that reads them.
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchflow.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds within the item's error budget."""
    from matchflow.llm.decontamination import find_leaks

    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchflow.llm.warc import read_warc, write_warc

    path = shared_folder(spark)
    write_warc(table(spark, sf_dir, "pages"), path)
    records = read_warc(spark, path, payload=False).filter("reason is null")
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchflow.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchflow.llm.context_tree import model_scores

    return model_scores(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchflow.llm.secret_scan import BASE_KINDS, find_secrets, joined, of_kind

    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(F.size(of_kind("spans", kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(joined(of_kind("spans", *BASE_KINDS)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchflow.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE))


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchflow.llm.merkle import document_fingerprints

    return document_fingerprints(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchflow.llm.simhash import near_duplicate_components

    found = near_duplicate_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchflow.llm.pieces import pieces_round_trip

    return pieces_round_trip(table(spark, sf_dir, "documents"), tokenizer(PIECE_BPE)).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchflow.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document by crc32 of its id repeats its words from one on, with a period that they decide; the others stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), F.size("__words")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - F.col("__a")) / (3 + g % 8))).cast("int")
    word = lambda i: F.get("__words", F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p")))
    planted = (h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select("doc_id", "text", F.when(planted, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("__words"))
    rows = rows.withColumn("__a", a).withColumn("__p", p)
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")
    return rows.select("doc_id", F.when(F.col("__words").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchflow.llm.periodic_runs import periodic_runs

    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # of two runs the one with the greater exponent; runs come by start, then period
    better = lambda best, r: F.when(best.isNull() | (r.length * best.period > best.length * r.period), r).otherwise(best)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), better)
    line = lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchflow.llm.sharding import even_tree, sharded

    found = sharded(table(spark, sf_dir, "documents"), even_tree(8))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op") and callable(f)}


#: RFC 4648 base 32 of a SHA-1 in hexadecimal: five bits a letter.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {1 + 10 * part}, 10))::BIGINT >> {35 - 5 * k}) & 31)::INT + 1, 1)" for part in range(4) for k in range(8))

#: The tree of a text column t and its hashes, as merkle.py defines them.
_MARKED = r"regexp_replace(replace(replace({t}, chr(2), chr(2) || 'b'), chr(1), chr(2) || 'a'), '\n(\n|#|[AEIOULRT])', chr(10) || chr(1) || '\1', 'g')"
_CLAUSES = r"string_split(regexp_replace(p, '([^\p{{L}}\p{{N}}\s]) ', '\1' || chr(1), 'g'), chr(1))"
_TREE = f"[[[sha256(c) for c in {_CLAUSES}] for p in string_split(s, chr(10))] for s in string_split({_MARKED}, chr(10) || chr(1))]"
_PRINT = """sha256(array_to_string([sha256(array_to_string([sha256(array_to_string(p, '')) for p in s], '')) for s in {t}], '')) || ':' ||
    array_to_string([substr(sha256(array_to_string([sha256(array_to_string(p, '')) for p in s], '')), 1, 8) || '=' ||
        array_to_string([substr(sha256(array_to_string(p, '')), 1, 8) || '.' || array_to_string([substr(c, 1, 8) for c in p], '') for p in s], ',') for s in {t}], ';')"""
_LEAVES = "list_distinct([substr(c, 1, 8) for c in flatten(flatten({t}))])"

#: CRC-32 of a text, four bits a step: the remainders of the values of four bits.
_REMAINDERS = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
_STEP = f"xor(({{c}}) >> 4, {_REMAINDERS}[(xor(({{c}}), {{n}}) & 15) + 1])"
_BOTH = _STEP.format(c=_STEP.format(c="c", n="b & 15"), n="b >> 4")
_CRC32 = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({{t}})), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: {_BOTH}), 4294967295::BIGINT)"

#: The children of a hash tree's node and the least of their draws: eight shards in four racks and two regions, and a ninth alone.
_LEAST = "list_min(list_transform({children}, lambda n: {{'draw': -ln((('0x' || substr(md5(k || '|' || n.node), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / n.weight, 'node': n.node}})).node"
_NODES = lambda names, weight: "[" + ", ".join(f"{{'node': {n}, 'weight': {weight}}}" for n in names) + "]"

ORACLES = {
    "op11_prefix_trie": f"""
        WITH turns AS (
            SELECT conv_id, turn, strlen(coalesce(text, '')) AS n_bytes, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t
            FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, list({{'t': t, 'n_bytes': n_bytes}} ORDER BY turn NULLS FIRST, substr(t, 1, 30)) AS turns, {_CRC32.format(t='conv_id::VARCHAR')} % 9 AS h FROM turns GROUP BY conv_id),
        built AS (SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
        prefixes AS (SELECT conv_id, d, list_transform(turns[1:d], lambda x: x.t) AS p, turns[d].n_bytes AS n_bytes, d = len(turns) AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM built)),
        nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce((count(*) - 1) * max(n_bytes), 0) AS saved,
                         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY p, d),
        kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
        full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (p, d)),
        sums AS (SELECT p[1:a] AS p, a AS d, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_nodes) GROUP BY ALL)
        SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
        FROM full_nodes n JOIN sums USING (p, d) LEFT JOIN nodes u ON n.d > 0 AND u.d = n.d - 1 AND u.p = n.p[1:n.d - 1]""",
    "op12_periodic_runs": f"""
        WITH given AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, coalesce({_CRC32.format(t='doc_id::VARCHAR')}, 1) AS h FROM documents),
        shifts AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM given),
        periods AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM shifts),
        texts AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM periods),
        words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM texts),
        alike AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        islands AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM alike) GROUP BY doc_id, q, g),
        runs AS (SELECT doc_id, start, length, min(q) AS period FROM islands WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
        listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
                          list(r ORDER BY r.length * 1.0 / r.period DESC, r.start, r.period)[1] AS best FROM (SELECT doc_id, start, length, period, runs AS r FROM runs) GROUP BY doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS rest FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, (1000 * best.length) // best.period AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
        FROM texts LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op13_sharding": f"""
        WITH d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, strlen(coalesce(text, '')) + 1 AS size, {_CRC32.format(t="coalesce(text, '')")} AS text_crc32 FROM documents),
        r AS (SELECT *, {_LEAST.format(children=_NODES(["'r0'", "'r1'"], 4.0))} AS r,
                     -ln((('0x' || substr(md5(k || '|own8'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
                       < list_min(list_transform(['r0', 'r1'], lambda n: -ln((('0x' || substr(md5(k || '|' || n), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / 4)) AS leaves FROM d),
        racks AS (SELECT *, {_LEAST.format(children=_NODES(["r || '/k' || (2 * substr(r, 2)::INT)", "r || '/k' || (2 * substr(r, 2)::INT + 1)"], 2.0))} AS rack FROM r),
        s AS (SELECT *, split_part({_LEAST.format(children=_NODES(["rack || '/' || (2 * split_part(rack, 'k', 2)::INT)", "rack || '/' || (2 * split_part(rack, 'k', 2)::INT + 1)"], 1.0))}, '/', 3)::INT AS shard FROM racks)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(k || ':' || text_crc32 || ':' || size), doc_id NULLS FIRST) - 1 AS slot,
               CASE WHEN leaves THEN 8 ELSE shard END AS grown_shard
        FROM s""",
    "op8_merkle": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following FROM d),
        e AS (SELECT *, left(text, (length(text) - length(text) // 2)::INT) || left(following, (length(text) // 2)::INT) AS edited FROM n),
        t AS (SELECT *, {_TREE.format(t='text')} AS a, {_TREE.format(t='edited')} AS b, {_TREE.format(t='following')} AS c FROM e),
        l AS (SELECT *, {_LEAVES.format(t='a')} AS la, {_LEAVES.format(t='b')} AS lb, {_LEAVES.format(t='c')} AS lc FROM t)
        SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
               {_PRINT.format(t='a')} AS fingerprint, {_PRINT.format(t='b')} AS edited_fingerprint,
               2.0 * len(list_intersect(la, lb)) / (len(la) + len(lb)) AS near_edited,
               2.0 * len(list_intersect(la, lc)) / (len(la) + len(lc)) AS near_next
        FROM l""",
    "op3_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        g AS (SELECT h, max(page_id) AS keeper FROM p GROUP BY h)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keeper THEN keeper END AS refers_to
        FROM p JOIN g USING (h)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
