"""Exact ranks and quantiles of very large columns.

Equal values are counted first (combining before the shuffle), so a value that a third of the rows
share costs one row. The distinct values are then cut into tiles at approximate quantiles, and cumulative counts
cross the tiles as a carry: no key, however large, is sorted in one task. The counted table is written
once, because cut finding, scan and carry each read it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.operators.scans import balanced_tile, prefix_scan
from quoteloom.session import durable


def _tiles_wanted(df: DataFrame) -> int:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, min(1000, partitions))


def value_counts(df: DataFrame, keys, x: str, weight: Column | None = None) -> DataFrame:
    """One row per (keys, value) with its count ``n`` and the count of rows up to it, ``upto``."""
    keys = list(keys)
    weight = F.lit(1) if weight is None else weight
    counts = df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.sum(weight).cast("long").alias("n"))
    return cumulate(durable(counts), keys, x, {"upto": F.col("n")})


def cumulate(counts: DataFrame, keys, x: str, sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """Running sums over the distinct values of ``x`` per key, through value tiles."""
    keys = list(keys)
    tiled = balanced_tile(counts, keys, x, F.col(x).cast("double"))
    ordered = tiled.withColumn("_tile", -F.col("_tile")) if descending else tiled
    if descending:
        ordered = ordered.withColumn("_rev", -F.col(x))
    order = ["_rev"] if descending else [x]
    scanned = prefix_scan(ordered, keys, order, {n: ("sum", c) for n, c in sums.items()})
    return scanned.drop("_tile", "_rev")


def average_rank(counted: DataFrame) -> Column:
    """Average rank of tied values, from ``value_counts``."""
    return F.col("upto") - (F.col("n") - 1) / 2


def exact_quantiles(df: DataFrame, keys, x: str, qs: dict[str, float], weight: Column | None = None) -> DataFrame:
    """Linearly interpolated quantiles per key, exact at any size; with ``weight`` a row stands for so many."""
    keys = list(keys)
    counted = value_counts(df, keys, x, weight)
    total = counted.groupBy(*keys).agg(F.sum("n").alias("_total"))
    joined = counted.join(total, keys) if keys else counted.join(F.broadcast(total))  # one row without keys
    parts = []
    for name, q in qs.items():
        pos = F.lit(q) * (F.col("_total") - 1)
        parts.append(F.min(F.when(F.col("upto") > F.floor(pos), F.col(x))).alias(f"_lo_{name}"))
        parts.append(F.min(F.when(F.col("upto") > F.ceil(pos), F.col(x))).alias(f"_hi_{name}"))
    got = joined.groupBy(*keys).agg(F.max("_total").alias("_total"), *parts)
    out = []
    for name, q in qs.items():
        pos = F.lit(q) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return got.select(*keys, *out)


SHORT = 10_000  # rows of a key that one group may sort


def quantiles_of_many_keys(df: DataFrame, keys, x: str, qs: dict[str, float]) -> DataFrame:
    """``exact_quantiles`` for many keys: those of up to ``SHORT`` rows are sorted in their groups, as tiles and cuts per key would cost more than the rows."""
    keys = list(keys)
    rows = durable(df.filter(F.col(x).isNotNull()).dropna(subset=keys).select(*keys, x))
    long = durable(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > SHORT).select(*keys))
    if long.isEmpty():
        return rows.groupBy(*keys).agg(*[F.percentile(x, F.lit(q)).alias(n) for n, q in qs.items()])
    short = rows.join(long, keys, "left_anti").groupBy(*keys).agg(*[F.percentile(x, F.lit(q)).alias(n) for n, q in qs.items()])
    return short.unionByName(exact_quantiles(rows.join(long, keys, "left_semi"), keys, x, qs))


def spearman(df: DataFrame, pairs: dict[str, tuple[str, str]], keys=()) -> DataFrame:
    """Rank correlation (average ranks) of several column pairs per key; null for a constant column.

    The input is melted to (pair, x, y); each side is ranked through ``value_counts``.
    """
    keys = list(keys)
    items = F.array(
        *[
            F.struct(F.lit(n).alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
            for n, (a, b) in pairs.items()
        ]
    )
    long = df.select(*keys, F.explode(items).alias("_i")).select(*keys, "_i.*")
    return spearman_long(long, [*keys, "pair"])


def spearman_long(long: DataFrame, keys, x: str = "x", y: str = "y", weight: Column | None = None) -> DataFrame:
    """``spearman`` on a long table; adds ``rho`` and ``n`` per key. With ``weight`` a row stands for so many."""
    keys = list(keys)
    both = long.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    # joint counts first: repeated pairs shrink before either ranking and both joins
    joint = durable(both.groupBy(*keys, x, y).agg(F.sum(F.lit(1) if weight is None else weight).cast("long").alias("w")))
    rx = value_counts(joint, keys, x, F.col("w"))
    rx = rx.select(*keys, x, average_rank(rx).alias("rx"))
    ry = value_counts(joint, keys, y, F.col("w"))
    ry = ry.select(*keys, y, average_rank(ry).alias("ry"))
    ranked = joint.join(rx, [*keys, x]).join(ry, [*keys, y])
    return weighted_corr(ranked, keys, "rx", "ry", "w")


def kendall_long(long: DataFrame, keys, x: str = "x", y: str = "y", weight: Column | None = None) -> DataFrame:
    """Kendall's tau-b with ties per key, over all pairs of rows; adds ``tau`` and ``n``; null where a column is constant or rows are fewer than three.

    Discordant pairs are counted by dominance, not listed. The values of ``y`` are numbered; two rows differ first at some bit of
    their numbers, so at that bit, among rows that share the bits above, every row with a 0 counts the rows with a 1 and a smaller ``x``. Each bit
    is a running sum along ``x`` through value tiles, all bits in one scan: n log n work, and no value is ever whole in one task.
    """
    keys = list(keys)
    both = long.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    joint = durable(both.groupBy(*keys, x, y).agg(F.sum(F.lit(1) if weight is None else weight).cast("long").alias("w")))
    ny = value_counts(joint, keys, y, F.col("w"))
    numbered = durable(cumulate(ny.select(*keys, y, "n"), keys, y, {"_rank": F.lit(1)}))
    nx = joint.groupBy(*keys, x).agg(F.sum("w").alias("n"))
    bits = max(1, int(numbered.agg(F.max("_rank")).first()[0] or 0).bit_length())
    ranked = joint.join(numbered.select(*keys, y, "_rank"), [*keys, y])
    levels = ranked.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    upper = F.call_function("shiftright", F.col("_rank"), F.col("_bit"))
    one = upper.bitwiseAND(F.lit(1)) == 1
    block = [*keys, "_bit", "_above"]
    sides = levels.withColumn("_above", F.call_function("shiftright", F.col("_rank"), F.col("_bit") + 1)).groupBy(*block, x).agg(
        F.sum(F.when(one, F.col("w")).otherwise(0)).alias("_high"), F.sum(F.when(one, 0).otherwise(F.col("w"))).alias("_low")
    )
    tiled = balanced_tile(durable(sides), keys, x, F.col(x).cast("double"))
    before = prefix_scan(tiled, block, [x], {"_seen": ("sum", F.col("_high"))}, exclusive=True)
    discordant = before.groupBy(*keys).agg(F.sum(F.col("_low").cast("double") * F.coalesce("_seen", F.lit(0))).alias("_d"))

    def tied(counts: DataFrame, n: str, name: str) -> DataFrame:
        return counts.groupBy(*keys).agg(F.sum(F.col(n).cast("double") * (F.col(n) - 1) / 2).alias(name), F.sum(n).alias(f"{name}_n"))

    parts = tied(joint, "w", "_txy").join(tied(nx, "n", "_tx"), keys).join(tied(ny, "n", "_ty"), keys).join(discordant, keys)
    n = F.col("_txy_n").cast("double")
    pairs = n * (n - 1) / 2
    free_x, free_y = pairs - F.col("_tx"), pairs - F.col("_ty")
    concordant = pairs - F.col("_d") - F.col("_tx") - F.col("_ty") + F.col("_txy")
    tau = F.when((n >= 3) & (free_x > 0) & (free_y > 0), (concordant - F.col("_d")) / (F.sqrt(free_x) * F.sqrt(free_y)))
    return parts.select(*keys, F.col("_txy_n").alias("n"), tau.alias("tau"))


def weighted_corr(df: DataFrame, keys, a: str, b: str, w: str) -> DataFrame:
    """Pearson correlation of rank columns with integer weights."""
    wa, wb, ww = F.col(a), F.col(b), F.col(w)
    sums = df.groupBy(*keys).agg(
        F.sum(ww).cast("double").alias("_n"),
        F.sum(ww * wa).alias("_sa"),
        F.sum(ww * wb).alias("_sb"),
        F.sum(ww * wa * wa).alias("_saa"),
        F.sum(ww * wb * wb).alias("_sbb"),
        F.sum(ww * wa * wb).alias("_sab"),
    )
    n, sa, sb = F.col("_n"), F.col("_sa"), F.col("_sb")
    va = n * F.col("_saa") - sa * sa
    vb = n * F.col("_sbb") - sb * sb
    rho = F.when((n >= 3) & (va > 0) & (vb > 0), (n * F.col("_sab") - sa * sb) / (F.sqrt(va) * F.sqrt(vb)))
    return sums.select(*keys, n.cast("long").alias("n"), rho.alias("rho"))


def ordered_index(df: DataFrame, keys, x: str, tie: str, name: str = "rn") -> DataFrame:
    """Row number per key in the order (x, tie), and the group size ``<name>_n``; both columns numeric.

    Tiles are cut at approximate quantiles of ``x``. A value common enough to fill tiles shows up among
    the cuts itself; its rows form their own run of tiles, cut by the tie column instead.
    """
    keys = list(keys)
    k = _tiles_wanted(df)
    at = F.array(*[F.lit((i + 1) / k) for i in range(k - 1)])
    xv, tv = F.col(x).cast("double"), F.col(tie).cast("double")
    rows = df.filter(F.col(x).isNotNull())
    # written, so that the optimizer knows how small they are and does not bring all rows of a key to one task
    cuts = durable(rows.groupBy(*keys).agg(
        F.percentile_approx(xv, at, F.lit(10_000)).alias("_cx"),
        F.percentile_approx(tv, at, F.lit(10_000)).alias("_ct"),
        F.count(F.lit(1)).alias(f"{name}_n"),
    ))
    both = rows.join(cuts, keys) if keys else rows.join(F.broadcast(cuts))  # one row without keys
    place = F.size(F.filter("_cx", lambda c: c < xv)).cast("long")
    common = F.array_contains("_cx", xv)
    inner = F.when(common, F.size(F.filter("_ct", lambda c: c < tv)).cast("long")).otherwise(F.lit(0).cast("long"))
    tile = (place * 2 + common.cast("long")) * (k + 1) + inner
    tiled = durable(both.withColumn("_tile", tile).drop("_cx", "_ct"))
    return prefix_scan(tiled, keys, [x, tie], {name: ("count", F.lit(1))}).drop("_tile")


def global_index(df: DataFrame, order, name: str = "rn") -> DataFrame:
    """Row number from 1 over a whole table in any order: numbers inside range partitions plus the sizes of earlier ones."""
    sort = list(order)
    part = df.repartitionByRange(_tiles_wanted(df), *sort).withColumn("_part", F.spark_partition_id())
    part = durable(part)  # the borders of the ranges hold for both uses
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    counts = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*sort)
    rows = part.withColumn("_at", F.row_number().over(inside)).join(starts, "_part")
    return rows.withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def ntile_of(rn: Column, n: Column, k: int) -> Column:
    """Bin of a row number when ``n`` rows go into ``k`` bins and the first bins take the extra rows."""
    q, r = F.floor(n / k), n % k
    wide = r * (q + 1)
    return F.when(rn <= wide, F.ceil(rn / (q + 1))).otherwise(r + F.ceil(F.try_divide(rn - wide, q))).cast("long")


def _binned(df: DataFrame, keys, x: str, tie: str, starts: list[Column], name: str, first: int) -> DataFrame:
    """Bins in the order (x, tie) per key, from the row numbers at which all but the lowest begin (columns of the group size ``_all``).

    Distinct values are counted and only values that lie across a border are ordered by the tie; the rows themselves are compared
    with the first row of each bin and go through no shuffle.
    """
    keys = list(keys)
    rows = df.filter(F.col(x).isNotNull())
    counted = value_counts(rows, keys, x)
    total = counted.groupBy(*keys).agg(F.sum("n").alias("_all"))
    counted = counted.join(total, keys) if keys else counted.join(F.broadcast(total))  # one row without keys
    at = F.array(*[F.struct(F.lit(i).alias("cut"), p.cast("long").alias("at")) for i, p in enumerate(starts)])
    here = F.filter(at, lambda c: (c["at"] > F.col("upto") - F.col("n")) & (c["at"] <= F.col("upto")))
    found = counted.withColumn("_c", F.explode(here)).select(*keys, F.col(x).alias("_x"), "n", "_c.cut", (F.col("_c.at") - F.col("upto") + F.col("n")).alias("_nth"))
    found = durable(found)  # at most a row per key and border
    across = found.filter("_nth > 1")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"v.{k}")) for k in keys] + [F.col(f"r.{x}") == F.col("v._x")]
    met = None
    if not across.isEmpty():
        values = across.select(*keys, "_x").distinct()
        met = rows.alias("r").join(values.alias("v"), same, "left_semi").select(*[F.col(f"r.{k}") for k in keys], F.col(f"r.{x}").alias("_x"), F.col(f"r.{tie}").alias("_t"))
        ties = value_counts(met, [*keys, "_x"], "_t")
        on = [F.col(f"v.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys] + [F.col("v._x") == F.col("t._x")]
        place = (F.col("v._nth") == F.col("t.upto") - F.col("t.n") + 1, F.col("t._t"))
        picked = across.alias("v").join(ties.alias("t"), on).groupBy(*[F.col(f"v.{k}").alias(k) for k in keys], F.col("v._x").alias("_x"), F.col("v.n").alias("n"), F.col("v.cut").alias("cut"))
        picked = durable(picked.agg(F.max(F.when(*place)).alias("_t"), F.sum("t.n").alias("_seen")))
        if picked.filter("_t IS NOT NULL AND _seen = n").count() < across.count():  # the tie leaves rows equal: they are numbered one by one
            return _numbered_bins(rows, keys, x, tie, starts, name, first)
        found = found.filter("_nth = 1").select(*keys, "_x", "cut", F.lit(None).alias("_t")).unionByName(picked.select(*keys, "_x", "cut", "_t"))
    else:
        found = found.select(*keys, "_x", "cut", F.lit(None).cast("long").alias("_t"))
    # a few borders per key; written, so that the optimizer knows how small they are
    borders = durable(found.groupBy(*keys).agg(F.collect_list(F.struct("_x", "_t")).alias("_borders")))
    both = rows.join(borders, keys, "left") if keys else rows.join(F.broadcast(borders))  # one row without keys
    past = F.filter("_borders", lambda c: (F.col(x) > c["_x"]) | ((F.col(x) == c["_x"]) & (c["_t"].isNull() | (F.col(tie) >= c["_t"]))))
    return both.withColumn(name, F.lit(first) + F.coalesce(F.size(past), F.lit(0)).cast("long")).drop("_borders")


def _numbered_bins(rows: DataFrame, keys, x: str, tie: str, starts: list[Column], name: str, first: int) -> DataFrame:
    """``_binned`` by the number of every row, for ties that leave rows equal."""
    out = ordered_index(rows, keys, x, tie, "_rn").withColumn("_all", F.col("_rn_n"))
    value = F.lit(first).cast("long")
    for p in starts:
        value = value + F.when(F.col("_rn") >= p, 1).otherwise(0)
    return out.withColumn(name, value).drop("_rn", "_rn_n", "_all")


def equal_count_bins(df: DataFrame, keys, x: str, tie: str, k: int, name: str = "bin") -> DataFrame:
    """Bins 1 to ``k`` of ``ntile_of``."""
    n = F.col("_all")
    return _binned(df, keys, x, tie, [F.floor(n / k) * i + F.least(F.lit(i), n % k) + 1 for i in range(1, k)], name, 1)


def floor_bins(df: DataFrame, keys, x: str, tie: str, k: int, name: str = "bin") -> DataFrame:
    """Bins ``floor(i * k / n)`` of the row position i from 0."""
    n = F.col("_all")
    return _binned(df, keys, x, tie, [F.floor((n * i + k - 1) / k) + 1 for i in range(1, k)], name, 0)
