"""Human review: the state of spans from a decision log, eligibility, what comes next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_decisions(log: DataFrame) -> DataFrame:
    """Each actor's latest decision on a span, by write sequence."""
    return log.groupBy("span_id", "actor_key").agg(F.max_by(F.struct("kind", "heard", "flagged"), "sequence").alias("d")).select("span_id", "actor_key", "d.*")


def span_states(log: DataFrame) -> DataFrame:
    """Approvers and disapprovers of each span, sorted, and its state: disputed, approved, rejected or open."""
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("actor_key"))))
    s = last_decisions(log).groupBy("span_id").agg(of("APPROVE").alias("approvers"), of("DISAPPROVE").alias("disapprovers"))
    a, d = F.size("approvers"), F.size("disapprovers")
    return s.withColumn("state", F.when((a > 0) & (d > 0), "disputed").when(a > 0, "approved").when(d > 0, "rejected").otherwise("open"))


def current_flags(log: DataFrame) -> DataFrame:
    """Flags that are set now: the last action decides, and only then are cleared ones left out."""
    return log.groupBy("span_id").agg(F.max_by("flagged", "sequence").alias("flagged")).where("flagged")


def eligibility(log: DataFrame, chunk: Column, least: float) -> DataFrame:
    """Per chunk: whether each span is approved, unflagged and heard by each approver; else the sorted reasons."""
    d = last_decisions(log)
    spans = d.groupBy("span_id").agg(F.bool_and(F.col("kind") == "APPROVE").alias("done"), F.bool_or("flagged").alias("flagged"), F.min(F.when(F.col("kind") == "APPROVE", F.col("heard"))).alias("heard"))
    reason = F.array_compact(F.array(F.when(~F.col("done"), F.lit("not_done")), F.when(F.col("flagged"), F.lit("flagged")), F.when(F.coalesce(F.col("heard") < least, F.lit(False)), F.lit("not_heard"))))
    each = spans.select(chunk.alias("chunk_id"), reason.alias("reasons"))
    return each.groupBy("chunk_id").agg(F.count("*").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons")).withColumn("eligible", F.size("reasons") == 0)


def next_open(states: DataFrame, after: int) -> DataFrame:
    """The next span after an ordinal that is not approved, from the start again at the end."""
    return states.where("state <> 'approved'").orderBy((F.col("span_id") <= after).asc(), "span_id").limit(1)


def played_share(played: DataFrame, speech: DataFrame, keys: list[str]) -> DataFrame:
    """Share of speech seconds that were played; 1 without speech."""
    from .intervals import overlapping, shared_length, union

    p = union(played, keys, tolerance=0.0)
    s = union(speech, keys, tolerance=0.0).select(*keys, F.col("start_sec").alias("lo"), F.col("end_sec").alias("hi"))
    heard = overlapping(s, p, keys).groupBy(*keys).agg(F.sum(shared_length(F.col("lo"), F.col("hi"), F.col("start_sec"), F.col("end_sec"))).alias("heard"))
    total = s.groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo")).alias("total"))
    return total.join(heard, keys, "left").select(*keys, F.when(F.col("total") <= 0, 1.0).otherwise(F.coalesce(F.col("heard") / F.col("total"), F.lit(0.0))).alias("share"))


def playback_steps(ticks: DataFrame) -> DataFrame:
    """Ticks (player, at, position, rate) -> stretches played through: a forward step of at most 1.5 max(1, rate) seconds at the same rate extends one."""
    w = Window.partitionBy("player").orderBy("at")
    step = F.col("position") - F.lag("position").over(w)
    joined = (step >= 0) & (step <= 1.5 * F.greatest(F.lit(1.0), F.col("rate"))) & (F.col("rate") == F.lag("rate").over(w))
    rows = ticks.withColumn("new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("player", "run").agg(F.min("position").alias("start_sec"), F.max("position").alias("end_sec"), F.count("*").alias("ticks")).drop("run")
