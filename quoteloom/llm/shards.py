"""Operator 3: k-d tree sharding, in DataFrame functions only.

Rows are points in a space of metadata: source, language, length and id, each mapped to [0, 1). A node that must
become k shards is cut along its widest dimension at the weighted quantile that gives its two sides their share of
k, until every leaf is one shard (``shards_for`` turns target bytes into a number of leaves). Leaves so hold
equal bytes up to one row, and rows close in metadata stay together.

The quantile is searched where the rows are: every pass sums the bytes of at most ``BINS`` bins per node, finds the
bin that crosses the target, and looks into that bin next, between its least and greatest key. Keys carry a hash
of the row behind the dimension's value, so a source that holds a third of all rows is cut like any other.
No row moves; a pass returns one line per node, and there are fewer nodes than shards.

Nulls and edge cases: null metadata counts as the start of its dimension; a null text has 16 bytes; rows equal in id and
text cannot be told apart, each gets its own slot; with fewer rows than shards some shards stay empty; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.llm.text import row_key
from quoteloom.session import durable

BINS = 4096
SLOT_ROWS = 100_000
_BITS = 31
_DIMS = ("_source", "_lang", "_length", "_id")


@dataclass
class Node:
    shards: int
    first: int  # number of its first shard
    dim: str | None = None
    cut: int | None = None
    low: Node | None = None
    high: Node | None = None


def _scaled(x: Column) -> Column:
    """[0, 1) as the upper bits of a key."""
    top = (1 << _BITS) - 1
    return F.coalesce(F.least(F.greatest(F.floor(x * float(1 << _BITS)), F.lit(0)), F.lit(top)), F.lit(0)).cast("long")


def points(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32``, a 31-bit hash ``_tie`` and one 62-bit key per dimension; written once."""
    span = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    low, high = float(span.a or 0), float(span.b or 0)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    base = docs.select("doc_id", "source", "lang", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), *row_key("doc_id", "text"))
    tie = F.shiftrightunsigned("_k1", 64 - _BITS)
    parts = {
        "_source": F.crc32(F.col("source").cast("binary")) / float(1 << 32),
        "_lang": F.crc32(F.col("lang").cast("binary")) / float(1 << 32),
        "_length": F.log2(F.col("size").cast("double")) / 64.0,
        "_id": (F.col("doc_id").cast("double") - low) / (high - low + 1.0),
    }
    keys = {d: F.shiftleft(_scaled(x), _BITS) + tie for d, x in parts.items()}
    return durable(base.withColumns({"_tie": tie, **keys}).drop("source", "lang"))


def _walk(node: Node, leaf) -> Column:
    if node.cut is None:
        return F.lit(leaf(node))
    return F.when(F.col(node.dim) < node.cut, _walk(node.low, leaf)).otherwise(_walk(node.high, leaf))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.cut is None else _leaves(node.low) + _leaves(node.high)


def _cuts(rows: DataFrame, at: Column, open_nodes: dict[int, Node]) -> None:
    """Find the dimension and the cut of each open node."""
    named = rows.withColumn("_node", at).filter(F.col("_node").isin(list(open_nodes)))
    aggs = [F.sum("size").alias("bytes")]
    for d in _DIMS:
        aggs += [F.min(d).alias(f"{d}_lo"), F.max(d).alias(f"{d}_hi")]
    search, width = {}, 1 << _BITS
    for r in named.groupBy("_node").agg(*aggs).collect():  # a line per node
        node = open_nodes[r._node]
        node.dim = max(_DIMS, key=lambda d: r[f"{d}_hi"] // width - r[f"{d}_lo"] // width)
        share = node.shards // 2 / node.shards
        search[r._node] = [r[f"{node.dim}_lo"], r[f"{node.dim}_hi"], 0, r.bytes * share]
    while search:
        key = lo = step = None
        for n, (a, b, _, _) in search.items():
            here, d = F.col("_node") == n, F.col(open_nodes[n].dim)
            inside, one = here & d.between(a, b), max(1, math.ceil((b - a + 1) / BINS))
            key = F.when(inside, d) if key is None else key.when(inside, d)
            lo = F.when(here, F.lit(a)) if lo is None else lo.when(here, F.lit(a))
            step = F.when(here, F.lit(one)) if step is None else step.when(here, F.lit(one))
        binned = named.select("_node", "size", key.alias("_key"), lo.alias("_lo"), step.alias("_step")).filter("_key IS NOT NULL")
        sums = binned.groupBy("_node", F.expr("(_key - _lo) div _step").alias("_bin")).agg(
            F.sum("size").alias("w"), F.min("_key").alias("a"), F.max("_key").alias("b")
        )
        upto = Window.partitionBy("_node").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows
        before = F.when(F.lit(False), 0.0)
        for n, (_, _, below, goal) in search.items():
            before = before.when(F.col("_node") == n, goal - below)
        run = sums.withColumn("under", F.coalesce(F.sum("w").over(upto), F.lit(0))).withColumn("goal", before)
        # the bin that reaches the goal; the last one if rounding leaves the goal beyond all
        hit = run.groupBy("_node").agg(
            F.min(F.when(F.col("under") + F.col("w") >= F.col("goal"), F.struct("_bin", "a", "b", "under", "w"))).alias("h"),
            F.max(F.struct("_bin", "a", "b", "under", "w")).alias("last"),
        )
        for r in hit.collect():  # a line per node
            bin_, (_, _, below, goal) = r.h or r.last, search.pop(r._node)
            if bin_.a == bin_.b:
                nearer = goal - below - bin_.under <= bin_.w / 2
                open_nodes[r._node].cut = bin_.a if nearer else bin_.b + 1
            else:
                search[r._node] = [bin_.a, bin_.b, below + bin_.under, goal]


def grow(rows: DataFrame, shards: int) -> Node:
    """The tree of a table of ``points``, level by level."""
    root = Node(shards, 0)
    while True:
        named = dict(enumerate(_leaves(root)))
        number = {id(n): i for i, n in named.items()}
        open_nodes = {i: n for i, n in named.items() if n.shards > 1 and n.dim is None}
        if not open_nodes:
            return root
        _cuts(rows, _walk(root, lambda n: number[id(n)]), open_nodes)
        for n in open_nodes.values():
            if n.cut is None:  # a node without rows
                n.dim, n.cut = _DIMS[0], 0
            half = n.shards // 2
            n.low, n.high = Node(half, n.first), Node(n.shards - half, n.first + half)


def shards_for(docs: DataFrame, target_bytes: int) -> int:
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    return max(1, math.ceil(total / target_bytes))


def shard(docs: DataFrame, shards: int) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``; slots count the rows of a shard from 0 without a gap."""
    rows = points(docs)
    root = grow(rows, shards)
    placed = rows.select("doc_id", "size", "text_crc32", "_tie", "_k1", "_k2", _walk(root, lambda n: n.first).alias("shard"))
    largest = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 1
    tiles = math.ceil(largest / SLOT_ROWS)
    tiled = placed.withColumn("_tile", F.shiftrightunsigned(F.col("_tie") * tiles, _BITS))
    counts = tiled.groupBy("shard", "_tile").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)  # a row per tile
    starts = counts.select("shard", "_tile", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_tile").orderBy("_tie", "_k1", "_k2")
    numbered = tiled.withColumn("_rn", F.row_number().over(inside)).join(starts, ["shard", "_tile"])
    slot = (F.col("_start") + F.col("_rn") - 1).cast("long")
    return numbered.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))
