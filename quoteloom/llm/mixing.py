"""Operator 7: mixing sources to target weights on a time-varying curriculum.

Targets: sources in code-point order take the weights in turn; together they get ``share`` of all words, and none more
than ``cap`` times its own (water filling: the excess of full sources goes to the others by weight).

Curriculum: a source's weight changes linearly over training time t from 0 to 1, ``(1 - tilt) + 2 * tilt * t``, with mean
1. Its integral, scaled to the target, is the cumulative demand of words. A document stands on the line of its
source's words at a place fixed by a hash; the demand curve, inverted, turns that place into a time, which is
the document's training position. Passes over the source follow each other on that line until the target is
reached, so the last document taken may be taken in part.

Places are running sums inside hash tiles of a source plus the sums of earlier tiles: no source, however large, is
ordered in one task.

Nulls and edge cases: a null source is a source, the last one; a null text has no words and is never taken; rows equal
in id and text take neighbouring places; with no words at all every target is 0; an empty table gives an empty
table; other columns pass through when asked for.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.llm.text import NOT_SPACES, positions, row_key, sheltered
from quoteloom.session import durable

WEIGHTS = (5.0, 2.0, 1.0)
TILTS = (0.5, 0.0, -0.5)  # heavy sources grow over training, light ones fade
SHARE, CAP = 1.5, 2
TILE_ROWS = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACES)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, tilts: Sequence[float] = TILTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``source, _source_size, _rows, _weight, _tilt, _target`` per source, from rows of ``source, _size``."""
    totals = sizes.groupBy("source").agg(F.sum("_size").alias("_source_size"), F.count(F.lit(1)).alias("_rows"))
    ranked = positions(totals, [F.col("source").isNull(), F.col("source")], "_rank")
    turn = (F.col("_rank") % len(weights)).cast("int")
    named = {"_weight": weights, "_tilt": tilts}
    table = durable(ranked.withColumns({n: F.get(F.array(*[F.lit(float(v)) for v in vs]), turn) for n, vs in named.items()}))
    whole = table.agg(F.sum("_source_size").alias("s"), F.sum("_weight").alias("w")).first()
    wanted = share * (whole.s or 0)
    level = wanted / whole.w if whole.w else 0.0
    full = F.col("_source_size") * cap
    while True:  # each round fills at least one more source or ends
        over = F.col("_weight") * level > full
        r = table.agg(F.sum(F.when(over, full)).alias("c"), F.sum(F.when(~over, F.col("_weight"))).alias("w")).first()
        if not r.w:
            break
        higher = (wanted - (r.c or 0)) / r.w
        if higher <= level:
            break
        level = higher
    return table.withColumn("_target", F.least(F.col("_weight") * level, full.cast("double")))


def demand_time(x: Column, tilt: Column) -> Column:
    """Training time at which a source has met the part ``x`` of its demand: the inverse of (1 - s) t + s t^2."""
    root = F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * x)
    return F.when(tilt == 0, x).otherwise(2 * x / ((1 - tilt) + root))


def plan(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), weights: Sequence[float] = WEIGHTS, tilts: Sequence[float] = TILTS, share: float = SHARE, cap: int = CAP
) -> DataFrame:
    """``keep`` plus ``_size, _source_size, _target, _taken, _position`` (time of the first pass; null: not taken) per row.

    ``_passes`` holds, per pass that takes words of the document, its time and its words.
    """
    extra = [c for c in keep if c != "source"]
    base = durable(docs.select("source", *extra, *row_key("doc_id", "text"), word_count(F.col("text")).alias("_size")))
    targets = durable(source_targets(base, weights, tilts, share, cap).withColumn("_tiles", F.ceil(F.col("_rows") / TILE_ROWS)))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(11), "_k1", "_k2"), 11) * float(2.0**-53)
    rows = base.withColumnRenamed("source", "_s").join(targets, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    rows = rows.withColumn("_unit", unit).withColumn("_tile", F.floor(F.col("_unit") * F.col("_tiles")))
    sums = rows.groupBy("_rank", "_tile").agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy("_rank").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)  # a row per tile
    starts = sums.select("_rank", "_tile", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_rank", "_tile").orderBy("_unit", "_k1", "_k2").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inner", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(starts, ["_rank", "_tile"])
    at, goal = F.col("_start") + F.col("_inner"), F.floor(F.col("_target") + 0.5)

    def one(r):
        place = at + r * F.col("_source_size")
        words = F.greatest(F.lit(0), F.least(F.col("_size"), goal - place)).cast("long")
        return F.struct(demand_time(place / F.greatest(F.col("_target"), F.lit(1.0)), F.col("_tilt")).alias("time"), words.alias("words"))

    passes = F.filter(F.array(*[one(r) for r in range(math.ceil(cap))]), lambda p: p["words"] > 0)
    out = placed.withColumn("_passes", passes)
    taken = F.aggregate("_passes", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return out.withColumns({"_taken": taken, "_position": F.get("_passes", F.lit(0))["time"]}).select(
        *keep, "_k1", "_k2", "_size", "_source_size", "_target", "_taken", "_position", "_passes"
    )


@sheltered("doc_id", "text", "source")
def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus in training order: a row of ``docs`` for each pass that takes it, sorted by position.

    Texts are never cut: a document taken in part counts as taken when at least half of it is.
    """
    planned = plan(docs, docs.columns, **settings)
    passes = planned.select(*docs.columns, "_size", "_k1", "_k2", F.explode("_passes").alias("_p")).filter(F.col("_p.words") * 2 >= F.col("_size"))
    return passes.orderBy("_p.time", "_k1", "_k2").select(*docs.columns)
