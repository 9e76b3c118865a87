"""Operator 4: benchmark decontamination by winnowing, in DataFrame functions only.

Of every ``span - gram + 1`` consecutive word grams the least hash is kept. Two texts that share ``span`` consecutive
words share all grams of that stretch, so they keep the same one: the join of kept hashes misses no shared span.
A hit is then extended word by word to both sides, at most ``span - gram`` words each way; if the run reaches
``span`` words, all its words are hit. Items shorter than ``span`` are one window: their only gram is the
whole item, and documents keep all grams of that length (at most ``span - 1`` such lengths exist).

Plan: one pass splits the texts and writes word counts and kept hashes; their join with the benchmark's hashes names
the candidates; only candidates are split again, placed and extended. The benchmark's tables are read from
Parquet, so the optimizer broadcasts them only when their size allows.

Nulls and edge cases: a null text has no words and no hit; an item without words is never found; items with a null
id hit words but are not listed; items that share an id are listed once; repeated rows of documents each
get the same result; empty tables are allowed; other columns of either table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.llm.text import BETWEEN_ALNUM, ascii_lower, row_key, sheltered
from quoteloom.session import durable

SPAN, GRAM = 10, 5


def _none() -> Column:
    return F.array().cast("array<long>")


def words(text: Column) -> Column:
    parts = F.array_remove(F.split(ascii_lower(text), BETWEEN_ALNUM), "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def gram_hashes(hashes: str, gram: int) -> Column:
    """Hash of each gram of words, from the column of word hashes; the gram's length goes into the hash."""
    h = F.col(hashes)
    each = F.transform(F.sequence(F.lit(0), F.size(h) - gram), lambda i: F.xxhash64(F.lit(gram), *[F.get(h, i + j) for j in range(gram)]))
    return F.when(F.size(h) >= gram, each).otherwise(_none())


def least_hashes(grams: str, width: int) -> Column:
    """Distinct minima of all windows of ``width`` grams."""
    g = F.col(grams)
    each = F.transform(F.sequence(F.lit(0), F.size(g) - width), lambda i: F.least(*[F.get(g, i + j) for j in range(width)]))
    return F.array_distinct(F.when(F.size(g) >= width, each).otherwise(_none()))


def _placed(rows: DataFrame, grams: str, gram: int, wanted: Column, reach: int) -> DataFrame:
    """One row per gram whose hash is wanted: position, hash and the word hashes around it, nearest first."""
    h, g = F.col("_h"), F.col(grams)
    at = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.array_contains(wanted, F.get(g, i)))

    def place(i):
        left = F.reverse(F.slice(h, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))))
        return F.struct(i.cast("long").alias("at"), F.get(g, i).alias("hash"), left.alias("left"), F.slice(h, i + gram + 1, reach).alias("right"))

    places = F.when(F.size(g) > 0, F.transform(at, place))
    keep = [c for c in rows.columns if not c.startswith("_g") and c not in ("_h", "_wanted", "text")]
    return rows.select(*keep, F.explode(places).alias("_p")).select(*keep, "_p.*", F.lit(gram).alias("gram"))


def _run(a: str, b: str) -> Column:
    """How many leading entries of two arrays agree."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("long")


def anchors(items: DataFrame, span: int = SPAN, gram: int = GRAM) -> tuple[DataFrame, list[int]]:
    """Benchmark side: hash, contexts and the items they come from; and the lengths of short items present.

    Equal anchors are one row with all their items, so repeated words or items do not multiply rows.
    """
    base = items.select("item_id", word_hashes(F.col("text")).alias("_h")).withColumn("_n", F.size("_h"))
    base = durable(base.filter("_n > 0"))
    short = [r[0] for r in base.filter(F.col("_n") < span).select("_n").distinct().collect()]  # fewer than span numbers
    full = base.filter(F.col("_n") >= span).withColumn("_g", gram_hashes("_h", gram))
    full = full.withColumn("_wanted", least_hashes("_g", span - gram + 1))
    rows = _placed(full, "_g", gram, F.col("_wanted"), span - gram).withColumn("need", F.lit(span))
    for m in sorted(short):
        whole = base.filter(F.col("_n") == m).withColumn("_g", gram_hashes("_h", m))
        rows = rows.union(_placed(whole, "_g", m, F.col("_g"), 0).withColumn("need", F.lit(m)))
    grouped = rows.groupBy("hash", "gram", "need", "left", "right").agg(F.collect_set("item_id").alias("items"))
    return durable(grouped), sorted(short)


def hits(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``doc_id, _k1, _k2, n_words, ranges, items`` per row; ranges are the hit stretches of words [from, to)."""
    bench, short = anchors(items, span, gram)
    width = span - gram + 1
    split = docs.select("doc_id", *row_key("doc_id", "text"), word_hashes(F.col("text")).alias("_h"))
    split = split.withColumn("_g", gram_hashes("_h", gram))
    kept = F.concat(least_hashes("_g", width), *[F.array_distinct(gram_hashes("_h", m)) for m in short])
    narrow = durable(split.select("doc_id", "_k1", "_k2", F.size("_h").cast("long").alias("n_words"), kept.alias("kept")))

    known = bench.select("hash").distinct()
    shared = narrow.select("_k1", "_k2", F.explode("kept").alias("hash")).join(known, "hash")
    candidates = durable(shared.groupBy("_k1", "_k2").agg(F.collect_set("hash").alias("_wanted")))

    texts = docs.select("text", *row_key("doc_id", "text")).join(candidates, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])
    again = texts.select("_k1", "_k2", "_wanted", word_hashes(F.col("text")).alias("_h"))
    again = again.withColumns({"_g": gram_hashes("_h", gram), **{f"_g{m}": gram_hashes("_h", m) for m in short}})
    placed = _placed(again, "_g", gram, F.col("_wanted"), span - gram)
    for m in short:
        placed = placed.union(_placed(again, f"_g{m}", m, F.col("_wanted"), 0))
    theirs = bench.select("hash", "gram", "need", F.col("left").alias("_left"), F.col("right").alias("_right"), "items")
    met = placed.join(theirs, ["hash", "gram"])
    met = met.select("_k1", "_k2", "at", "gram", "need", "items", _run("left", "_left").alias("l"), _run("right", "_right").alias("r"))
    whole = met.filter("l + gram + r >= need")
    found = whole.groupBy("_k1", "_k2").agg(
        F.collect_set(F.struct((F.col("at") - F.col("l")).alias("from"), (F.col("at") + F.col("gram") + F.col("r")).alias("to"))).alias("ranges"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    return narrow.drop("kept").join(found, ["_k1", "_k2"], "left")


def covered(ranges: Column) -> Column:
    """Number of positions inside the union of ranges."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))

    def add(acc, r):
        more = F.greatest(F.lit(0).cast("long"), r["to"] - F.greatest(r["from"], acc["upto"]))
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["upto"], r["to"]).alias("upto"))

    return F.coalesce(F.aggregate(F.array_sort(ranges), start, add)["n"], F.lit(0).cast("long"))


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Per document row: n_words, n_hit (words inside shared windows), the sorted ids of items found."""
    found = hits(docs, items, span, gram)
    ids = F.array_sort(F.coalesce(F.transform("items", lambda i: i.cast("string")), F.array().cast("array<string>")))
    return found.select("doc_id", "_k1", "_k2", "n_words", covered(F.col("ranges")).alias("n_hit"), ids.alias("item_ids"))


@sheltered("doc_id", "text")
def without_contaminated(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with all their columns, whatever their names.

    Null and wordless texts hold none and stay; without items every row stays; rows equal in id and text stay or go together.
    """
    bad = contamination(docs, items, span, gram).filter("n_hit > 0").select("_k1", "_k2").distinct()
    return docs.select("*", *row_key("doc_id", "text")).join(durable(bad), ["_k1", "_k2"], "left_anti").drop("_k1", "_k2")


def digest(items: str | Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)
