"""Postings: normal form, unions of boards, fallbacks, duplicates, what is new, and candidate pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchflow.functions import levels as L
from matchflow.functions.text import content_words, in_window, let, normalize_url

POSTING = ("title", "company", "location", "url", "description", "posted", "posted_label", "source")
# The order in which boards are tried.
BOARDS = ("LinkedIn", "Indeed", "Glassdoor", "Jobs.ie", "Builtin")
#: Parts of a source or collection whose rows one task may hold.
SLICES = 32
#: Postings of one class that a task pairs with the class's candidates at once: at least, and at most; and how many such parts a core gets.
POSTING_PART, MOST_POSTINGS, PARTS_A_CORE = 1_000, 50_000, 32


def filled(c: Column, default: str = "N/A") -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def normalize_postings(df: DataFrame, source: str, mapping: dict[str, str], extra: tuple[str, ...] = ()) -> DataFrame:
    """The canonical columns from a source's own; missing ones become N/A, descriptions and urls ''; extra columns join the description."""
    has = lambda name: F.col(mapping[name]).cast("string") if name in mapping else F.lit(None).cast("string")
    parts = [F.nullif(F.trim(c), F.lit("")) for c in (has("description"), *(F.col(x).cast("string") for x in extra))]
    out = {c: filled(has(c)) for c in POSTING} | {"url": filled(has("url"), ""), "description": F.concat_ws(" ", *parts), "source": F.lit(source)}
    return df.select("*", *(v.alias(f"__{k}") for k, v in out.items())).select(*(F.col(f"__{k}").alias(k) for k in out), *(c for c in df.columns if c not in out))


def union_boards(*boards: DataFrame, n: int, order: str) -> DataFrame:
    """All boards, each with at most its even share of n rows."""
    share = max(1, n // len(boards))
    return limit_per_source(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), boards), share, order)


def limit_per_source(df: DataFrame, n: int, order: str, source: str = "source") -> DataFrame:
    """The first n rows of each source: of each of its slices, then of what these leave, so that no task sorts a whole source."""
    sliced = df.withColumn("__slice", F.pmod(F.xxhash64(order), F.lit(SLICES)))
    first = lambda rows, *keys: rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("__n") <= n)
    return first(first(sliced, source, "__slice"), source).drop("__n", "__slice")


def first_nonempty_source(df: DataFrame, preferred: str, keys: list[str] | None = None, boards: tuple[str, ...] = BOARDS, source: str = "source") -> DataFrame:
    """For each search (keys; one if there are none) the rows of the first board, the preferred one leading, that returned any; All keeps everything."""
    if preferred == "All":
        return df
    order = list(dict.fromkeys([preferred if preferred in boards else boards[0], *boards]))
    rank = L.chain([(F.col(source) == b, k) for k, b in enumerate(order)], None).cast("int")
    ranked = df.withColumn("__rank", rank)
    first = ranked.groupBy(*keys or []).agg(F.min("__rank").alias("__rank"))
    return ranked.join(first, [*(keys or []), "__rank"]).drop("__rank")


def with_location_fallback(df: DataFrame, location: str, keys: list[str], at: str = "location") -> DataFrame:
    """Rows of the location; for a (board, query) without any, all its rows."""
    fits = F.coalesce(F.lower(F.col(at)).contains(location.lower()), F.lit(False))
    found = df.groupBy(*keys).agg(F.max(fits).alias("__any"))
    return df.join(found, keys).filter(fits | ~F.col("__any")).drop("__any")


def dedupe_first(df: DataFrame, key: str, order: list[str], keyed: bool = False) -> DataFrame:
    """The first row of each key; rows without one all stay. An aggregate finds the firsts, so a hot key is no one's window.

    keyed: every row is known to have a key, so df is read once and no filter computes the key again.
    """
    if keyed:
        row = F.struct(*order, *(c for c in df.columns if c not in order))
        return df.groupBy(F.col(key).alias("__key")).agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*").select(*df.columns)
    keyless = df.filter(F.col(key).isNull() | (F.col(key) == ""))
    rest = df.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    row = F.struct(*order, *(c for c in df.columns if c not in order))
    first = rest.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")
    return first.select(*df.columns).unionByName(keyless)


def merge_rounds(*rounds: DataFrame, key: str = "url", order: str = "seq") -> DataFrame:
    """The union of search rounds without duplicate urls, earlier rounds winning."""
    numbered = [df.withColumn("round", F.lit(k)) for k, df in enumerate(rounds)]
    return dedupe_first(reduce(lambda a, b: a.unionByName(b), numbered), key, ["round", order])


def with_applied(postings: DataFrame, history: DataFrame) -> DataFrame:
    """postings with their normalised url and `skipped`: whether the user has applied to it; rows without a url are not."""
    done = history.filter("applied").select("user_key", "url_norm").distinct().withColumn("__done", F.lit(True))
    keyed = postings.withColumn("url_norm", F.nullif(normalize_url("url"), F.lit("")))
    return keyed.join(done, ["user_key", "url_norm"], "left").withColumn("skipped", F.coalesce("__done", F.lit(False))).drop("__done")


def filter_out_applied(postings: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): skipped are postings whose normalised url the user has applied to; rows without a url are kept."""
    marked = with_applied(postings, history)
    return marked.filter(~F.col("skipped")).drop("skipped"), marked.filter("skipped").drop("skipped")


def new_only(postings: DataFrame, pool: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose raw url is not in the pool; rows without a url always stay."""
    known = pool.select(F.nullif(F.col(key), F.lit("")).alias("__key")).filter("__key is not null").distinct()
    return postings.join(known, F.col(key) == F.col("__key"), "left_anti")


def unscored(postings: DataFrame, *scored: DataFrame, key: str = "url") -> DataFrame:
    """Rows in none of the scored tables."""
    return new_only(postings, reduce(lambda a, b: a.union(b), [s.select(key) for s in scored]), key)


def rule_grid(spark) -> DataFrame:
    """Candidate level, job level and years asked (0 to 25) that may be scored: 6 x 6 x 26 rows at most."""
    levels = spark.range(6)
    grid = levels.select(F.col("id").cast("int").alias("cand_level")).crossJoin(levels.select(F.col("id").cast("int").alias("job_level"))).crossJoin(spark.range(26).select(F.col("id").cast("int").alias("years")))
    gap = F.col("job_level") - F.col("cand_level")
    return grid.filter(L.level_gap_exit(gap).isNull() & L.years_exit(F.col("cand_level"), F.col("years")).isNull())


def candidate_pairs(candidates: DataFrame, postings: DataFrame) -> DataFrame:
    """Pairs that level and years allow: the rule grid turns the theta join into an equi-join, so other pairs never form.

    As few classes hold all rows, a class's postings are dealt to parts, and its candidates meet each part, so that no class and no
    input file is one task's. A candidate is copied for each part that it meets: parts are as large as PARTS_A_CORE allow,
    within POSTING_PART and MOST_POSTINGS, so copies do not grow with the square of the tables until parts are full. A join
    holds one part in memory, and may spill it.
    """
    spark = candidates.sparkSession
    tasks, many = int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS_A_CORE * spark.sparkContext.defaultParallelism
    c = candidates.withColumn("cand_level", L.candidate_level("experience_level"))
    p = postings.withColumn("job_level", L.job_level("title")).withColumn("years", L.posting_years("description"))
    # as many rows as there are levels and years
    counted = p.groupBy("job_level", "years").agg(F.count(F.lit(1)).alias("__n"))
    most = F.least(F.lit(MOST_POSTINGS), F.greatest(F.lit(POSTING_PART), F.col("__all") / many))
    parts = F.broadcast(counted.crossJoin(counted.agg(F.sum("__n").alias("__all"))).select("job_level", "years", F.ceil(F.col("__n") / most).cast("int").alias("__parts")))
    allowed = F.broadcast(rule_grid(spark))
    asked = c.join(allowed, "cand_level").join(parts, ["job_level", "years"]).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    dealt = p.join(parts, ["job_level", "years"]).withColumn("__part", F.pmod(F.xxhash64(*postings.columns), F.col("__parts")).cast("int")).drop("__parts")
    by = ["job_level", "years", "__part"]
    return asked.repartition(tasks, *by).join(dealt.repartition(tasks, *by).hint("merge"), by).drop("__part")


def split_missing(df: DataFrame, missing: str, matched: str, cv: str) -> DataFrame:
    """Missing skills whose words stand together in the CV move to the matched ones."""
    words = df.withColumn("__words", content_words(cv))
    found = lambda s, w: let(content_words(s), lambda t: in_window(t, w))
    held = let(F.col("__words"), lambda w: F.filter(missing, lambda s: found(s, w)))
    out = words.withColumn("__found", held).withColumn(missing, F.filter(missing, lambda s: ~F.array_contains("__found", s)))
    return out.withColumn(matched, F.concat(matched, "__found")).drop("__words", "__found")


def validate_inputs(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with `errors`, the names of all rules that a row fails."""
    return df.withColumn("errors", F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items())), lambda e: e.isNotNull()))
