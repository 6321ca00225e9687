"""What rule records have to be before they are published: problems as rows, so a sink can refuse and a report can count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATUSES = ("in_force", "not_yet_effective", "pending", "failed")
DAY = r"^[0-9]{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12][0-9]|3[01]))?)?$"


def rule_problems(rules: DataFrame, documents: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """``(rule_id, problem)``: all that is wrong with each record, a row a problem.

    ``rules(rule_id string, title, category, jurisdiction, level, status, effective_date, citation, quoted_span,
    confidence, doc_id, superseded_by)``; ``documents(doc_id)`` those there are. A record's form is
    checked in its row; ids that repeat, documents and successors that don't exist by grouped counts and joins.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    city = F.col("jurisdiction").contains(", ")
    of: list[tuple[str, Column]] = [
        ("id has another form", ~F.coalesce(F.col("rule_id").rlike("^r-[0-9]{4,}$"), F.lit(False))), *[(f"{c} is missing", blank(c)) for c in ("title", "citation", "quoted_span")],
        ("category not known", ~F.coalesce(F.col("category").isin(*categories), F.lit(False))), ("level is not the jurisdiction's", F.coalesce(F.col("level") != F.when(city, "city").otherwise("state"), F.lit(True))),
        ("status not known", ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))), ("date has another form", F.col("effective_date").isNotNull() & ~F.col("effective_date").rlike(DAY)),
        ("in force without a date's year", (F.col("status") == "in_force") & F.coalesce(F.col("effective_date") < "1600", F.lit(False))), ("confidence out of bounds", ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))),
        ("supersedes itself", F.coalesce(F.col("superseded_by") == F.col("rule_id"), F.lit(False))),
    ]
    in_row = F.array_compact(F.array(*[F.when(holds, said) for said, holds in of]))
    rows = rules.withColumn("_own", in_row).withColumn("_same", F.count("*").over(Window.partitionBy("rule_id")))
    rows = rows.join(documents.select(F.col("doc_id"), F.lit(True).alias("_doc")).distinct(), "doc_id", "left")
    known = rules.select(F.col("rule_id").alias("superseded_by"), F.lit(True).alias("_next")).distinct()
    rows = rows.join(known, "superseded_by", "left")
    more = F.array_compact(F.array(F.when(F.col("_same") > 1, "id repeats"), F.when(F.col("_doc").isNull(), "document not there"), F.when(F.col("superseded_by").isNotNull() & F.col("_next").isNull(), "successor not there")))
    return rows.select("rule_id", F.explode(F.concat("_own", more)).alias("problem"))
