"""Rankings with shared places, winners of documents and shared credit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docscore.operators.score import correct_fields, judged


def _place(order: Column) -> Column:
    # one row per engine: a small, fixed set
    return F.rank().over(Window.orderBy(order))


def ranking(totals: DataFrame, by: str = "total_correct") -> DataFrame:
    """Competition ranking of engines by ``by`` alone; rows are ordered by all of correct, present and id.

    ``totals`` has a row per engine. ``shown_rank`` is blank where the row above has the
    same count. Engines without a judged row (``judged``) come last, without a place, if
    they have blocked ones (``blocked``); both columns are optional.
    """
    have = {"judged", "blocked"} <= set(totals.columns)
    ranked = totals.where("judged > 0").drop("judged", "blocked") if have else totals
    order = [F.desc(by), F.desc("present_correct"), F.col("engine_id")]
    above = F.lag(by).over(Window.orderBy(*order))
    ranked = ranked.withColumn("rank", _place(F.desc(by)))
    ranked = ranked.withColumn("shown_rank", F.when(above.eqNullSafe(F.col(by)), "").otherwise(F.col("rank").cast("string"))).withColumn("status", F.lit("RANKED"))
    if have:
        rest = totals.where("judged = 0 AND blocked > 0").select("engine_id")
        ranked = ranked.unionByName(rest.withColumns({"shown_rank": F.lit("—"), "status": F.lit("BLOCKED")}), allowMissingColumns=True)
    return ranked


def document_winners(scores: DataFrame) -> DataFrame:
    """Engines with the most correct fields of each document, sorted; with none correct anywhere all of them.

    Correct fields are counted inside the rows of ``scores``, by their verdicts if they have these; a document has one row per
    engine at most, so its engines are a small group.
    """
    correct = correct_fields() if "verdicts" in scores.columns else F.size(F.filter("outcomes", lambda o: o["scorable"] & o["correct"]))
    each = judged(scores).select("document_id", F.struct(correct.alias("n"), F.col("engine_id").alias("e")).alias("r"))
    found = each.groupBy("document_id").agg(F.collect_list("r").alias("r"), F.max("r.n").cast("long").alias("correct_fields"))
    best = F.transform(F.filter("r", lambda r: r["n"] == F.col("correct_fields")), lambda r: r["e"])
    return found.select("document_id", "correct_fields", F.array_sort(best).alias("winners"))


def win_credit(winners: DataFrame) -> DataFrame:
    """Documents won by each engine, a tie shared equally."""
    share = winners.select(F.explode("winners").alias("engine_id"), (F.lit(1.0) / F.size("winners")).alias("share"))
    return share.groupBy("engine_id").agg(F.sum("share").alias("docs_won"))
