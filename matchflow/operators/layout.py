"""Page layout from line tables: doc_id, page, line_no, x0, y0, x1, y1, text, font, size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upper_middle(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The element at n div 2 of each group's sorted values, from counts of distinct values."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys)
    placed = counted.withColumn("__upto", F.sum("__n").over(w.orderBy(value))).withColumn("__half", F.floor(F.sum("__n").over(w) / 2))
    return placed.filter("__upto > __half and __upto - __n <= __half").select(*keys, F.col(value).alias(name))


def column_histogram(lines: DataFrame, page_width: float, bins: int = 10) -> DataFrame:
    """Columns of each document: bins of line starts that are local maxima with 10 % of the lines and three lines at least."""
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col("x0") * bins / page_width))).cast("int")
    counted = lines.groupBy("doc_id", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = counted.groupBy("doc_id").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    n = lambda k: F.coalesce(F.col("m")[k], F.lit(0))
    heights = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), n)
    peak = lambda h, k: (h >= F.greatest(F.lit(3), F.col("total") * 0.1)) & (h >= F.coalesce(F.get("h", k - 1), F.lit(0))) & (h > F.coalesce(F.get("h", k + 1), F.lit(0)))
    peaks = F.filter(F.transform("h", lambda h, k: F.when(peak(h, k), k)), lambda k: k.isNotNull())
    spaced = F.aggregate("peaks", F.array().cast("array<int>"), lambda kept, k: F.when((F.size(kept) == 0) | (k - F.coalesce(F.element_at(kept, -1), F.lit(-9)) >= 2), F.concat(kept, F.array(k))).otherwise(kept))
    out = grid.withColumn("h", heights).withColumn("peaks", peaks).withColumn("peaks", spaced)
    first = F.get("peaks", F.lit(0))
    sidebar = (F.size("peaks") >= 2) & (first <= 2) & (F.get("h", first) < 0.7 * F.array_max("h"))
    return out.select("doc_id", F.greatest(F.lit(1), F.size("peaks")).alias("columns"), F.coalesce(sidebar, F.lit(False)).alias("has_sidebar"))


def replica_columns(lines: DataFrame, bin_width: float = 25.0, share: float = 0.15, reach: int = 2) -> DataFrame:
    """Columns of each document: bins of line starts with `share` of its lines, and three, of which those within `reach` bins of the last are one.

    Lines without a start count towards the share alone; a document without such a bin has one column.
    """
    counted = lines.groupBy("doc_id", F.floor(F.col("x0") / bin_width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.groupBy("doc_id").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))).alias("bins"))
    least = F.greatest(F.lit(3), F.floor(F.col("total") * share))
    high = F.transform(F.filter("bins", lambda b: b["n"] >= least), lambda b: b["bin"])
    found = total.select("doc_id", high.alias("high"))
    opens = F.size(F.filter("high", lambda b, i: (i > 0) & (b - F.coalesce(F.get("high", i - 1), b) > reach)))
    columns = opens + 1
    return found.select("doc_id", columns.alias("columns"), (columns == 1).alias("compatible"))


def sidebar_outliers(bullets: DataFrame, keys: list[str]) -> DataFrame:
    """Bullets without those more than 30 left of their role's upper median, in roles of three bullets or more that span 50 or more."""
    w = Window.partitionBy(*keys)
    middle = upper_middle(bullets, keys, "x0", "__middle")
    spread = bullets.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__span", F.max("x0").over(w) - F.min("x0").over(w)).join(middle, keys)
    return spread.filter("not (__n >= 3 and __span >= 50 and x0 < __middle - 30)").drop("__n", "__span", "__middle")


def style_profile(lines: DataFrame) -> DataFrame:
    """Most frequent font, upper-median size within 9 to 12, largest size, left margin in mm within 12 to 32, pages."""
    fonts = lines.groupBy("doc_id", "font").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.min_by("font", F.struct((-F.col("n")).alias("n"), "font")).alias("font"))
    margin = F.least(F.lit(32.0), F.greatest(F.lit(12.0), F.min("x0") * 25.4 / 72))
    whole = lines.groupBy("doc_id").agg(F.max("size").alias("largest"), F.round(margin, 4).alias("margin_mm"), F.countDistinct("page").alias("pages"))
    size = upper_middle(lines, ["doc_id"], "size", "size")
    return whole.join(fonts, "doc_id").join(size, "doc_id").withColumn("size", F.least(F.lit(12.0), F.greatest(F.lit(9.0), F.col("size"))))


def line_gap(lines: DataFrame) -> DataFrame:
    """Upper median of the gaps between lines over the first size, within 1.0 to 1.3; 1.15 where there are none."""
    ys = lines.select("doc_id", "page", F.round("y0", 1).alias("y")).distinct()
    gaps = ys.withColumn("gap", F.round(F.col("y") - F.lag("y").over(Window.partitionBy("doc_id", "page").orderBy("y")), 4)).filter("gap > 0")
    middle = upper_middle(gaps, ["doc_id"], "gap", "gap")
    body = lines.groupBy("doc_id").agg(F.min_by("size", F.struct("page", "line_no")).alias("first"))
    ratio = F.least(F.lit(1.3), F.greatest(F.lit(1.0), F.col("gap") / F.col("first")))
    return body.join(middle, "doc_id", "left").select("doc_id", F.round(F.coalesce(ratio, F.lit(1.15)), 4).alias("line_gap"))


def reading_order(lines: DataFrame, page_width: float, bins: int = 20) -> DataFrame:
    """Lines with their column and place by column, y, x.

    Columns of a page: bins of line starts with 10 % of the lines and three at least are peaks, of peaks
    less than three bins apart the left one counts, and boundaries lie midway between those left.
    """
    at = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(0.9999), F.col("x0") / page_width)) * bins).cast("int")
    counted = lines.groupBy("doc_id", "page", at.alias("__bin")).agg(F.count(F.lit(1)).alias("__n"))
    pages = counted.groupBy("doc_id", "page").agg(F.sum("__n").alias("__total"), F.sort_array(F.collect_list(F.struct("__bin", "__n"))).alias("__bins"))
    high = F.filter("__bins", lambda e: e["__n"] >= F.greatest(F.lit(3), F.floor(F.col("__total") * 0.1)))
    spaced = F.aggregate(F.transform(high, lambda e: e["__bin"]), F.array().cast("array<int>"), lambda kept, k: F.when((F.size(kept) > 0) & (k - F.coalesce(F.get(kept, F.size(kept) - 1), F.lit(-bins)) < 3), kept).otherwise(F.concat(kept, F.array(k))))
    found = pages.select("doc_id", "page", spaced.alias("__peaks"))
    edges = F.transform(F.slice("__peaks", 2, bins), lambda k, i: (F.get("__peaks", i) + k) / 2 / bins * page_width)
    placed = lines.join(found.select("doc_id", "page", edges.alias("__edges")), ["doc_id", "page"])
    w = Window.partitionBy("doc_id", "page")
    column = F.size(F.filter("__edges", lambda b: F.col("x0") >= b))
    return placed.withColumn("column", column).drop("__edges").withColumn("place", F.row_number().over(w.orderBy("column", "y0", "x0", "line_no")))


def merge_rows(lines: DataFrame, tolerance: float = 1.2) -> DataFrame:
    """Lines at one height become one row: texts joined, the box around all; lines with is_marker stay as they are.

    A line joins the row before it if its y0 is within `tolerance` of that row's top, by y, then x. A page's lines
    come together as one array.
    """
    at = F.struct(F.round("y0", 1).alias("y"), F.round("x0", 1).alias("x"), "line_no", "x0", "y0", "x1", "y1", "text", F.coalesce("is_marker", F.lit(False)).alias("is_marker"))
    pages = lines.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(at)).alias("rows"))
    part = lambda r: F.struct(*(r[c].alias(c) for c in ("line_no", "x0", "y0", "x1", "y1", "text")))

    def joined(a, b):
        box = [F.least(a[c], b[c]).alias(c) for c in ("x0", "y0")] + [F.greatest(a[c], b[c]).alias(c) for c in ("x1", "y1")]
        return F.struct(a["line_no"].alias("line_no"), *box, F.trim(F.concat(a["text"], F.lit("   "), b["text"])).alias("text"))

    def step(done, line):
        last = F.element_at(done, -1)
        same = (F.size(done) > 0) & (F.abs(line["y0"] - F.coalesce(last["y0"], F.lit(0.0))) <= tolerance)
        return F.when(same, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined(last, part(line))))).otherwise(F.concat(done, F.array(part(line))))

    kind = "array<struct<line_no:int,x0:double,y0:double,x1:double,y1:double,text:string>>"
    plain = F.filter("rows", lambda r: ~r["is_marker"])
    rows = F.aggregate(plain, F.array().cast(kind), step)
    markers = F.transform(F.filter("rows", lambda r: r["is_marker"]), part)
    return pages.select("doc_id", "page", F.explode(F.concat(rows, markers)).alias("r")).select("doc_id", "page", "r.*")


def infer_summary(lines: DataFrame, name_size: float = 14.0) -> DataFrame:
    """doc_id, summary: the header's text behind its last line of name_size, if it has two lines and 120 characters; leading contact lines go.

    lines: doc_id, place, text, size of the lines before the first heading.
    """
    contact = r"(?i)(@|linkedin\.com|https?://|\+?\d[\d\s\-]{6,})"
    named = lines.groupBy("doc_id").agg(F.max(F.when(F.col("size") >= name_size, F.col("place"))).alias("__name"))
    body = lines.join(named, "doc_id").filter("__name is null or place > __name")
    said = body.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("__lines"),
        F.sum(F.length("text")).alias("__chars"),
        F.min(F.when(~F.col("text").rlike(contact), F.col("place"))).alias("__first"),
        F.sort_array(F.collect_list(F.struct("place", "text"))).alias("__all"),
    )
    long = said.filter("__lines >= 2 and __chars >= 120 and __first is not null")
    kept = F.transform(F.filter("__all", lambda r: r["place"] >= F.col("__first")), lambda r: r["text"])
    return long.select("doc_id", F.array_join(kept, "\n").alias("summary"))
