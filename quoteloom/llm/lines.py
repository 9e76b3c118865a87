"""Operator 8: line dedup by overlapping three-line windows.

Each window of consecutive lines is hashed to 128 bits. Windows met more than once in the corpus have a first
occurrence, the least (doc_id, text hash, position); every later occurrence covers its lines, covered positions of
a document are merged, and those lines go. A line is only removed where an earlier copy of its window
exists, so at least one copy of every line stays somewhere.

A window that a third of all documents share is one row per map task in the count; in the join back its rows form a
skewed side, which adaptive execution splits.

Nulls and edge cases: a null text stays null; texts of fewer than three lines have no window and stay as they are; windows
of blank lines only are no windows; rows equal in id and text count as one document (none is later than the
other); a null doc_id comes before all ids; empty tables give empty tables; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.llm.text import free_name, row_key, sheltered
from quoteloom.session import durable

WINDOW = 3


def _windows(lines: Column, size: int) -> Column:
    def one(i):
        part = F.slice(lines, i + 1, size)
        text = F.array_join(part, "\n")
        return F.struct(
            i.cast("long").alias("at"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"), (F.length(F.trim(F.replace(text, F.lit("\n")))) > 0).alias("used")
        )

    n = F.size(lines)
    found = F.transform(F.sequence(F.lit(0), n - size), one)
    return F.when(n >= size, F.filter(found, lambda w: w["used"]))


def later_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Rows ``_k1, _k2, at`` of the windows that repeat an earlier one; ``at`` is the first line's position."""
    split = docs.select("doc_id", *row_key("doc_id", "text"), F.split("text", "\n").alias("_lines"))
    rows = split.select("doc_id", "_k1", "_k2", F.explode(_windows(F.col("_lines"), size)).alias("_w"))
    rows = durable(rows.select("doc_id", "_k1", "_k2", "_w.at", "_w.h1", "_w.h2"))
    place = F.struct(F.col("doc_id").isNotNull(), "doc_id", "_k1", "_k2", "at")
    counts = rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = counts.filter("first != last").drop("last")
    return rows.join(repeated, ["h1", "h2"]).filter(place != F.col("first")).select("_k1", "_k2", "at")


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` with repeated windows removed from ``text``, and ``n_lines`` and ``n_removed`` (underscores stand before them where the input has columns of these names)."""
    names = {n: free_name(n, docs.columns) for n in ("n_lines", "n_removed")}
    return _dedup_lines(docs, size, names)


@sheltered("doc_id", "text")
def _dedup_lines(docs: DataFrame, size: int, names: dict[str, str]) -> DataFrame:
    later = later_windows(docs, size).groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set("at")).alias("_at"))
    keyed = docs.select("*", *row_key("doc_id", "text"))
    joined = keyed.join(later, ["_k1", "_k2"], "left").withColumn("_lines", F.split("text", "\n"))
    at, n, m = F.col("_at"), F.size("_lines"), F.size("_at")

    def gap(i):  # what stands before window i of the sorted ones, or behind the last
        return F.struct(F.when(i == 0, 0).otherwise(F.get(at, i - 1) + size).alias("a"), F.when(i == m, n).otherwise(F.get(at, i)).alias("b"))

    gaps = F.filter(F.transform(F.sequence(F.lit(0), m), gap), lambda g: g["a"] < g["b"])
    stay = F.flatten(F.transform(gaps, lambda g: F.slice("_lines", (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int"))))
    marked = joined.withColumn("_stay", F.when(at.isNull(), F.col("_lines")).otherwise(stay))
    out = marked.withColumns(
        {
            "text": F.when(at.isNull(), F.col("text")).otherwise(F.array_join("_stay", "\n")),
            names["n_lines"]: F.when(F.col("text").isNull(), 0).otherwise(n).cast("long"),
            names["n_removed"]: F.when(F.col("text").isNull(), 0).otherwise(n - F.size("_stay")).cast("long"),
        }
    )
    return out.drop("_k1", "_k2", "_at", "_lines", "_stay")
