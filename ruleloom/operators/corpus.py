"""Texts as lines, junk lines, spans and their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, line_no, start, line)``: every line with the place of its first character.

    Places are running sums inside one row, so the window's group is one text,
    and rows that share an id keep their own places.
    """
    rows = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("_row"), F.col(text_col)).select(id_col, "_row", F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    before = F.sum(F.length("line") + 1).over(Window.partitionBy("_row").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("start", F.coalesce(before, F.lit(0))).drop("_row")


def junk_lines(rows: DataFrame, id_col: str = "doc_id", longest: int = 30, repeats: int = 3) -> DataFrame:
    """``(id, line, times)`` of short lines without a digit or an end of sentence that one document repeats."""
    short = rows.where((F.length("line") > 0) & (F.length("line") <= longest) & ~F.col("line").rlike("[0-9]") & ~F.col("line").rlike("[.!?;:]$"))
    return short.groupBy(id_col, "line").agg(F.count("*").alias("times")).where(F.col("times") >= repeats)


def junk_runs(rows: DataFrame, id_col: str = "doc_id", longest: int = 30, repeats: int = 3, run: int = 4) -> DataFrame:
    """``rows`` of menus: short lines that their document repeats and that stand in a run of ``run`` short lines at least.

    A short line has no digit and no end of a sentence or clause; blank lines don't
    break a run.  Both windows are of one document.
    """
    line = F.regexp_replace("line", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    short = (F.length("bare") > 0) & (F.length("bare") <= longest) & ~F.col("bare").rlike(r"(?U)\d") & ~F.col("bare").rlike(r"[.:;,)\"”]\z")
    marked = rows.withColumn("bare", line).withColumn("short", short)
    broken = F.when(~F.col("short") & (F.col("bare") != ""), 1).otherwise(0)
    marked = marked.withColumn("island", F.sum(broken).over(Window.partitionBy(id_col).orderBy("line_no")))
    marked = marked.withColumn("in_run", F.count_if("short").over(Window.partitionBy(id_col, "island"))).withColumn("times", F.count("*").over(Window.partitionBy(id_col, "bare")))
    return marked.where(F.col("short") & (F.col("times") >= repeats) & (F.col("in_run") >= run)).select(*rows.columns)


def line_class(line: Column, before: Column) -> Column:
    """heading, item, paragraph (after a blank line) or line."""
    return F.when(line.rlike(r"^(?:SEC(?:TION)?\.? |§|ARTICLE |CHAPTER )|^[A-Z][A-Z ]{3,}$"), "heading").when(line.rlike(r"^\(?[0-9a-z]{1,3}[.)] "), "item").when(F.coalesce(before, F.lit("")) == "", "paragraph").otherwise("line")


def first_span(text: Column, quote: Column) -> Column:
    """``(start, end)`` of the first place of a quote, end exclusive; nulls where it doesn't occur."""
    at = F.when(F.length(quote) > 0, F.position(quote, text))
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(quote)).alias("end")))


def window_around(text: Column, start: Column, end: Column, margin: int) -> Column:
    """The text about a span, widened to whole lines where a line's end is near."""
    low = F.greatest(start - margin, F.lit(0))
    left = F.substring(text, low + 1, start - low)
    right = F.substring(text, end + 1, F.lit(margin))
    lead = F.when((low > 0) & left.contains("\n"), F.substring_index(left, "\n", -1)).otherwise(left)
    tail = F.when(right.contains("\n"), F.substring_index(right, "\n", 1)).otherwise(right)
    return F.concat(lead, F.substring(text, start + 1, end - start), tail)


def numbered(df: DataFrame, bucket: str, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the row's number in the order of ``bucket``, then ``order``, over the whole table.

    ``bucket`` is a column that rises with the order and splits the table into parts a
    task can sort; numbers run on from one bucket to the next, by a sum of their sizes.
    """
    sizes = df.groupBy(bucket).agg(F.count("*").alias("_n"))
    before = sizes.select(bucket, F.coalesce(F.sum("_n").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    return df.withColumn("_own", own).join(before, bucket).withColumn(name, F.col("_before") + F.col("_own")).drop("_own", "_before")
