"""Mixing sources to target weights by capped water-filling.

Sources get shares of a budget in proportion to their weights; a source whose share
exceeds its cap (a number of epochs over it) is held there, and the excess goes to
the others by weight until none is above. In closed form: sort the sources by
cap / weight; the level is the first at which the rest of the budget, dealt by
weight, keeps all later sources under their caps.

A source's repetitions are whole ones for all of its documents and one fractional
one: documents in a seeded order join it until the target is reached. The cut is
found without sorting a source: sizes are summed by hash ranges, the range that
holds the cut is found from those sums, and only its documents are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, shared_dir, stored, unused

WEIGHTS, BUDGET, EPOCHS, SEED = (3, 1, 2), 1.5, 2, 17
#: Hash ranges of a source, and the most sources whose plan is broadcast.
RANGES, BROADCAST_SOURCES = 4096, 10_000


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def water_fill(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, epochs: float = EPOCHS) -> DataFrame:
    """sizes (source, source_size; one row a source) with target.

    Sources by code point, null last, get the weights in turn. If all caps together
    are less than the budget, each source is at its cap. Runs in one partition, which
    holds one row for each source.
    """
    named = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("place"))
    upto = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    total = F.sum("source_size").over(whole).cast("double") * budget
    return (
        sizes.withColumn("place", F.row_number().over(named) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size").cast("double") * epochs)
        # if all sources before this one are at their caps, the rest is dealt by weight
        .withColumn("level", (total - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("held", F.col("level") * F.col("weight") >= F.col("cap"))
        .withColumn("final", F.min(F.when(~F.col("held"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level")))).over(whole)["level"])
        .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))))
        .select("source", "source_size", "target")
    )


def _draw(doc_id: Column, seed: int) -> Column:
    """A number below 2**60 by the id and the seed; null ids share one."""
    return F.conv(F.left(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))), F.lit(15)), 16, 10).cast("long")


def _range_of(draw: Column) -> Column:
    return F.shiftright(draw, 60 - (RANGES - 1).bit_length()).cast("int")


def planned(rows: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """rows (doc_id, source, size) -> (source, source_size, target, whole, cut_draw, cut_id).

    A document is taken `whole` times, and once more if (draw, doc_id) comes before
    the cut. Documents with equal ids share the draw and so the decision. The cut is
    put where the sum comes nearest to the target, so that a source misses it by half
    a document (or group of rows of one id) at most.
    """
    spread = rows.withColumn("draw", _draw(F.col("doc_id"), seed)).withColumn("range", _range_of(F.col("draw")))
    hist = spread.groupBy("source", "range").agg(F.sum("size").alias("size"))
    hist = stored(hist, shared_dir(rows.sparkSession))
    goal = water_fill(hist.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, epochs)
    ratio = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    goal = goal.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = stored(goal, shared_dir(rows.sparkSession))
    run = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    edges = hist.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
    edges = edges.join(goal.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
    edges = edges.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size"))).select("s", F.col("range").alias("r"), "before", "rest")
    inside = spread.join(F.broadcast(edges) if small(goal) else edges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    inside = inside.groupBy("s", "before", "rest", "draw", "doc_id").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("s").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    # the first document with which the sum would pass the target by more than half of it
    over = inside.withColumn("upto", F.col("before") + F.sum("size").over(order)).where(F.col("upto") - F.col("size") / 2 > F.col("rest"))
    first = over.groupBy("s").agg(F.min(F.struct("draw", F.col("doc_id").alias("id"))).alias("cut"))
    ends = edges.join(first.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")), "left").select("s", "r", "cut")
    return goal.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", "rest", F.col("r").alias("cut_range"), F.col("cut")["draw"].alias("cut_draw"), F.col("cut")["id"].alias("cut_id"))


def small(plan: DataFrame) -> bool:
    """Whether a table with a row for each source may be broadcast: its size is counted."""
    return plan.count() <= BROADCAST_SOURCES


def _epochs(doc_id: Column, plan: Column, seed: int) -> Column:
    """How often a document is taken, given its source's plan as a struct."""
    draw = _draw(doc_id, seed)
    at, p = _range_of(draw), plan
    first = (draw < p["cut_draw"]) | (draw == p["cut_draw"]) & F.coalesce(doc_id < p["cut_id"], doc_id.isNull() & p["cut_id"].isNotNull())
    extra = F.when((p["rest"] <= 0) | p["cut_range"].isNull(), False).when(at != p["cut_range"], at < p["cut_range"]).when(p["cut_draw"].isNull(), True).otherwise(first)
    return (p["whole"] + extra.cast("int")).cast("int")


def _with_plan(rows: DataFrame, plan: DataFrame, source: Column, into: str) -> DataFrame:
    """rows with their source's plan as a struct; every source has one."""
    s = unused("_mix_source", rows.columns)
    side = plan.select(F.col("source").alias(s), F.struct(*[c for c in plan.columns if c != "source"]).alias(into))
    return rows.join(F.broadcast(side) if small(plan) else side, source.eqNullSafe(F.col(s))).drop(s)


def sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(doc_id, source, size), kept in a shared folder: texts are read once for it."""
    return stored(docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{source_col}`"].alias("source"), n_words(docs[f"`{text_col}`"]).alias("size")), shared_dir(docs.sparkSession))


def taken(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED, **how) -> DataFrame:
    """(doc_id, size, source, source_size, target, epochs, taken), one row for each row of docs.

    Null and empty texts have size 0 and count for nothing; a null source is a source of
    its own, the last; repeated rows each count. epochs: whole times that the mix repeats
    the document, 0 included; taken: epochs * size. Reruns agree: the order is a hash of
    the id and the seed.
    """
    rows = sized(docs, id_col, source_col, text_col)
    plan = stored(planned(rows, seed=seed, **how), shared_dir(docs.sparkSession))
    out = _with_plan(rows, plan, rows["source"], "plan").withColumn("epochs", _epochs(F.col("doc_id"), F.col("plan"), seed))
    return out.select("doc_id", "size", "source", "plan.source_size", "plan.target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED, **how) -> DataFrame:
    """The mix itself: each row of docs as often as the plan takes it, with its columns."""
    rows = sized(docs, id_col, source_col, text_col)
    plan = stored(planned(rows, seed=seed, **how), shared_dir(docs.sparkSession))
    mark, each = unused("_mix_plan", docs.columns), unused("_mix_each", docs.columns)
    out = _with_plan(docs, plan, docs[f"`{source_col}`"], mark)
    n = _epochs(docs[f"`{id_col}`"], F.col(mark), seed)
    return out.withColumn(each, F.explode(F.array_repeat(F.lit(1), n))).drop(mark, each)
