"""As-of joins and bounded range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.functions.timing import DAY, HOUR, cell
from quoteloom.operators.scans import balanced_tile, prefix_scan

_UP = (Window.unboundedPreceding, Window.currentRow)


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys,
    columns: dict[str, str],
    left_us: str = "us",
    right_us: str = "us",
    right_order=(),
    width: int | None = DAY,
    inclusive: bool = True,
) -> DataFrame:
    """Each left row with the last right row at or before it (unbounded look-back).

    Tiles are ``width`` wide, or balanced by row count when it is None.
    ``columns`` maps output names to right columns. Both sides meet in one union per tile; the last
    right row of earlier tiles arrives as a carry, so no task ever holds a whole series.
    """
    keys = list(keys)
    payload = F.struct(*[F.col(c) for c in left.columns])
    found = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    ties = [F.col(c).cast("double").alias(f"_t{i}") for i, c in enumerate(right_order)]
    no_ties = [F.lit(None).cast("double").alias(f"_t{i}") for i in range(len(right_order))]
    lhs = left.select(
        *keys,
        F.col(left_us).alias("_at"),
        F.lit(1 if inclusive else -1).alias("_side"),
        *no_ties,
        payload.alias("_left"),
    )
    rhs = right.select(*keys, F.col(right_us).alias("_at"), F.lit(0).alias("_side"), *ties, found.alias("_right"))
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    both = balanced_tile(both, keys, "_at") if width is None else both.withColumn("_tile", cell("_at", width))
    order = ["_at", "_side", *[f"_t{i}" for i in range(len(right_order))]]
    scanned = prefix_scan(both, keys, order, {"_found": ("last", F.col("_right"))})
    return scanned.filter("_left IS NOT NULL").select("_left.*", *[F.col(f"_found.{n}").alias(n) for n in columns])


def asof_backward_many(left: DataFrame, rights: list[tuple[DataFrame, str, dict[str, str]]], keys, width: int = DAY) -> DataFrame:
    """Several backward as-of lookups of the same left rows in one union and one scan.

    Each right is ``(table, time column, {output: column})``; its row at the left time counts.
    """
    keys = list(keys)
    payload = F.struct(*[F.col(c) for c in left.columns])
    both = left.select(*keys, F.col("us").alias("_at"), F.lit(1).alias("_side"), payload.alias("_left"))
    for i, (right, right_us, columns) in enumerate(rights):
        found = F.struct(*[F.col(c).alias(n) for n, c in columns.items()]).alias(f"_right{i}")
        rows = right.select(*keys, F.col(right_us).alias("_at"), F.lit(0).alias("_side"), found)
        both = both.unionByName(rows, allowMissingColumns=True)
    running = {f"_found{i}": ("last", F.col(f"_right{i}")) for i in range(len(rights))}
    scanned = prefix_scan(both.withColumn("_tile", cell("_at", width)), keys, ["_at", "_side"], running)
    picks = [F.col(f"_found{i}.{n}").alias(n) for i, (_, _, columns) in enumerate(rights) for n in columns]
    return scanned.filter("_left IS NOT NULL").select("_left.*", *picks)


def past_values(rows: DataFrame, specs: dict[str, tuple[str, int]], keys, order=("us",), width: int = DAY) -> DataFrame:
    """Values at or before ``T - back`` for several ``name: (column, back)`` in one scan.

    Instead of probing the past, every row is sent ``back`` into the future and meets T there.
    """
    keys, names = list(keys), list(specs)
    carried = [c for c in rows.columns if c not in keys]
    steps = F.explode(F.sequence(F.lit(-1), F.lit(len(names) - 1))).alias("_step")
    wide = rows.select("*", steps)
    here = F.col("_step") == -1
    at = F.when(here, F.col("us"))
    for i, n in enumerate(names):
        at = at.when(F.col("_step") == i, F.col("us") + specs[n][1])
    rest = [c for c in order if c != "us"]
    wide = wide.select(
        *keys,
        at.alias("_at"),
        here.cast("int").alias("_here"),
        *[F.col(c).alias(f"_o_{c}") for c in rest],
        *[F.when(here, F.col(c)).alias(c) for c in carried],
        *[F.when(F.col("_step") == i, F.col(specs[n][0])).alias(f"_v_{n}") for i, n in enumerate(names)],
    )
    wide = wide.withColumn("_tile", cell("_at", width))
    scan_order = ["_at", "_here", *[f"_o_{c}" for c in rest]]
    out = prefix_scan(wide, keys, scan_order, {n: ("last", F.col(f"_v_{n}")) for n in names})
    return out.filter("_here = 1").select(*keys, *carried, *names)


def asof_forward(
    left: DataFrame,
    right: DataFrame,
    keys,
    columns: dict[str, str],
    tolerance: int,
    left_us: str = "us",
    right_us: str = "us",
    right_order=(),
    width: int = DAY,
) -> DataFrame:
    """Each left row with the first right row at or after it, if within ``tolerance`` microseconds.

    Because of the tolerance a right row matters only to its own tile and, near a border, to the one
    before: those copies replace any carry, and the whole match is a single shuffle.
    """
    keys = list(keys)
    payload = F.struct(*[F.col(c) for c in left.columns])
    found = F.struct(F.col(right_us).alias("_hit_us"), *[F.col(c).alias(n) for n, c in columns.items()])
    ties = [F.col(c).cast("double").alias(f"_t{i}") for i, c in enumerate(right_order)]
    no_ties = [F.lit(None).cast("double").alias(f"_t{i}") for i in range(len(right_order))]
    lhs = left.select(
        *keys,
        F.col(left_us).alias("_at"),
        F.lit(1).alias("_side"),
        cell(left_us, width).alias("_tile"),
        *no_ties,
        payload.alias("_left"),
    )
    rhs = right.select(
        *keys,
        F.col(right_us).alias("_at"),
        F.lit(0).alias("_side"),
        F.explode(F.sequence(cell(F.col(right_us) - tolerance, width), cell(right_us, width))).alias("_tile"),
        *ties,
        found.alias("_right"),
    )
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    order = [F.col("_at").desc(), F.col("_side").asc()]
    order += [F.col(f"_t{i}").desc() for i in range(len(right_order))]
    w = Window.partitionBy(*keys, "_tile").orderBy(*order)
    w = w.rowsBetween(*_UP)
    # descending: at equal times the right row (side 0) precedes the left row, so it is visible to it
    met = both.withColumn("_found", F.last("_right", ignorenulls=True).over(w)).filter("_left IS NOT NULL")
    near = F.col("_found._hit_us") - F.col("_at") <= tolerance
    return met.select("_left.*", *[F.when(near, F.col(f"_found.{n}")).alias(n) for n in columns])


def range_join(
    obs: DataFrame,
    rows: DataFrame,
    keys,
    start: Column,
    stop: Column,
    columns: dict[str, str],
    width: int = HOUR,
    rows_us: str = "us",
) -> DataFrame:
    """Rows with ``start <= time <= stop`` of each observation, through cells of ``width``.

    For aggregates that cannot be scanned (medians, run statistics). Keep the observations sparse
    (sampled or triggered rows): the output has one row per observation and covered row, and none for
    an observation with an empty range.
    """
    keys = list(keys)
    lhs = obs.withColumns({"_from": start, "_to": stop})
    lhs = lhs.withColumn("_cell", F.explode(F.sequence(cell("_from", width), cell("_to", width))))
    rhs = rows.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        F.col(rows_us).alias("_r_us"),
        cell(rows_us, width).alias("_r_cell"),
        *[F.col(c).alias(n) for n, c in columns.items()],
    )
    on = F.col("_cell") == F.col("_r_cell")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    hit = lhs.join(rhs, on & (F.col("_r_us") >= F.col("_from")) & (F.col("_r_us") <= F.col("_to")))
    return hit.drop("_cell", "_r_cell", *[f"_r_{k}" for k in keys])
