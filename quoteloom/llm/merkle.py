"""Operator 12: Merkle manifest of a dataset by time-forward processing.

Every row is a leaf; the leaves of a group form a tree of runs of ``ARITY`` nodes, the subroots of the groups form another.
Nodes are labelled level by level, so that a child's label is always below its parent's. Time-forward processing
visits nodes in the order of their labels: a node takes the digests that were sent to its label out of a priority queue,
hashes them, and sends its own digest to its parent's label. A second sweep runs against the labels and sends
every node its proof suffix: the siblings from its parent up to the root. A leaf puts its own siblings before it.

The queue is external. Its far part is Spark's: digests due in another block are rows of a table, brought together by a
shuffle on the receiving node's block, one round for every ``log2(BLOCK)`` levels. Its near part is a heap inside the
task that sweeps one block of at most ``BLOCK`` consecutive nodes. No task holds more than a block and no group is
ever whole in one place; a group that holds a third of all rows is simply many blocks. A round's table has 1 / ``BLOCK`` of the
rows of the one before, and the reversed sweep reads the same tables backwards. Texts are hashed where they are read
and never shuffled.

Nulls and edge cases: a null field is encoded as ``-``, so a null and an empty text differ; a null group is a group of
its own and stands first; rows of a group stand by id (null first), rows with equal ids by leaf digest, so the root does not depend
on the order of the input; repeated rows are leaves of their own; a group of one row is its own subroot, and one group's subroot is
the root; a leaf without siblings has the digest of nothing as proof; an empty table gives an empty table; columns
that are not named as fields are not read, whatever their names. A tampered row whose field is null stays as it is.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.llm.text import positions
from quoteloom.session import durable

ARITY = 2
BLOCK = 4096  # nodes a task sweeps at a time; a power of ARITY
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


# --- one block ---------------------------------------------------------------------------------------------------------


def widths(nodes: int, levels: int | None, arity: int) -> list[int]:
    """Nodes per level from the lowest up: ``levels`` of them, or until one node is left."""
    out = [nodes]
    while (levels is None and out[-1] > 1) or (levels is not None and len(out) <= levels):
        out.append(-(-out[-1] // arity))
    return out


class Block:
    """Consecutive nodes of one level and what stands above them, swept forwards and backwards over their labels."""

    def __init__(self, digests: Sequence[str], levels: int | None, arity: int = ARITY):
        self.arity, self.wide = arity, widths(len(digests), levels, arity)
        self.first = [0]  # label of each level's first node
        for n in self.wide:
            self.first.append(self.first[-1] + n)
        self.digests = list(digests)
        self._forward()

    def _parents(self) -> Iterator[tuple[int, int, int]]:
        """(label, first child's label, end of its children's labels) of the inner nodes in ascending order of labels."""
        for level in range(1, len(self.wide)):
            low, high = self.first[level - 1], self.first[level]
            for i in range(self.wide[level]):
                yield high + i, low + i * self.arity, min(low + (i + 1) * self.arity, high)

    def _sent_to(self, label: int, level: int) -> int:
        return self.first[level + 1] + (label - self.first[level]) // self.arity

    def _forward(self) -> None:
        queue, level, top = [], 0, self.first[-2]
        if len(self.wide) > 1:
            queue = [(self._sent_to(i, 0), i, d) for i, d in enumerate(self.digests)]
            heapq.heapify(queue)
        for label in range(self.wide[0], self.first[-1]):
            while label >= self.first[level + 1]:
                level += 1
            met = []
            while queue and queue[0][0] == label:
                met.append(heapq.heappop(queue)[2])
            digest = sha("".join(met))
            self.digests.append(digest)
            if label < top:
                heapq.heappush(queue, (self._sent_to(label, level), label, digest))

    def tops(self) -> list[str]:
        return self.digests[self.first[-2] :]

    def suffixes(self, above: list[str]) -> list[list[str]]:
        """Siblings of every lowest node, level by level up to this block's top, then what stands above it."""
        queue = [(-(self.first[-2] + i), list(above)) for i in range(self.wide[-1])]
        out: list[list[str]] = [[]] * self.wide[0]
        for label, start, end in reversed(list(self._parents())):
            below = heapq.heappop(queue)
            assert below[0] == -label  # the node whose turn it is has been served by its parent
            for child in range(start, end):
                others = [self.digests[c] for c in range(start, end) if c != child]
                heapq.heappush(queue, (-child, others + below[1]))
        while queue:
            label, suffix = heapq.heappop(queue)
            out[-label] = suffix
        return out


# --- rounds ------------------------------------------------------------------------------------------------------------


def _levels(size: int, block: int, arity: int) -> int | None:
    """A block that is one of many climbs a fixed number of levels; a tree's only block climbs to its root."""
    return round(math.log(block, arity)) if size > block else None


_NODES = "tree string, at long, size long, digest string"


def _forward(key, table: pa.Table, block: int, arity: int) -> pa.Table:
    table = table.sort_by("at")
    size = table["size"][0].as_py()
    top = Block(table["digest"].to_pylist(), _levels(size, block, arity), arity).tops()
    assert len(top) == 1
    return pa.table({"tree": [key[0].as_py()], "at": [key[1].as_py()], "size": [-(-size // block)], "digest": top})


def _blocks(nodes: DataFrame, block: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("at") / block).cast("long"))


def climb(nodes: DataFrame, block: int = BLOCK, arity: int = ARITY) -> list[DataFrame]:
    """Rounds from ``tree, at, size, digest`` to one node per tree; the last table holds the roots of all trees."""
    rounds = [nodes]
    largest = nodes.agg(F.max("size")).first()[0] or 0
    while largest > 1:
        up = _blocks(rounds[-1].select("tree", "at", "size", "digest"), block).groupBy("tree", "block")
        rounds.append(durable(up.applyInArrow(lambda k, t: _forward(k, t, block, arity), _NODES)))
        largest = -(-largest // block)
    return rounds


def _backward(nodes: pa.Table, above: pa.Table, block: int, arity: int) -> tuple[pa.Table, list[list[str]]]:
    nodes = nodes.sort_by("at")
    served = Block(nodes["digest"].to_pylist(), _levels(nodes["size"][0].as_py(), block, arity), arity)
    return nodes, served.suffixes(above["suffix"][0].as_py())


def _fold(digest: str, at: int, suffix: list[str], sizes: Sequence[tuple[int, int]], arity: int) -> str:
    """The root that ``digest`` leads to; ``sizes`` are (place, nodes) where a tree's lowest level begins."""
    used = 0
    for at, size in sizes:
        while size > 1:
            place, run = at % arity, min(arity, size - at // arity * arity)
            others = suffix[used : used + run - 1]
            digest, used = sha("".join([*others[:place], digest, *others[place:]])), used + run - 1
            at, size = at // arity, -(-size // arity)
    return digest


_PROVED = "tree string, at long, suffix array<string>"


def descend(rounds: list[DataFrame], above: DataFrame, block: int = BLOCK, arity: int = ARITY, until: int = 0) -> DataFrame:
    """``tree, at, suffix`` of the nodes of round ``until``, from those of the trees' roots (``at`` 0)."""

    def step(nodes: pa.Table, suffix: pa.Table) -> pa.Table:
        if not nodes.num_rows or not suffix.num_rows:
            return pa.schema([("tree", pa.string()), ("at", pa.int64()), ("suffix", pa.list_(pa.string()))]).empty_table()
        nodes, found = _backward(nodes, suffix, block, arity)
        return pa.table({"tree": nodes["tree"], "at": nodes["at"], "suffix": pa.array(found, pa.list_(pa.string()))})

    for nodes in reversed(rounds[until:-1]):
        left = _blocks(nodes.select("tree", "at", "size", "digest"), block).groupBy("tree", "block")
        right = above.withColumnRenamed("at", "block").groupBy("tree", "block")
        above = durable(left.cogroup(right).applyInArrow(step, _PROVED))
    return above


# --- the manifest ------------------------------------------------------------------------------------------------------


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", tampered: dict[str, Column] | None = None, block: int = BLOCK, arity: int = ARITY
) -> DataFrame:
    """Every row's ``order`` column with ``leaf``, ``subroot``, ``root``, ``proof`` (sibling digests) and ``folded_root``.

    ``tampered`` maps a field to the value it is claimed to have (null: as it is): ``folded_root`` is what the proof makes of the claimed row.
    """
    if arity ** round(math.log(block, arity)) != block:
        raise ValueError("a block is a power of the arity")
    spark = docs.sparkSession
    claimed = [F.coalesce(tampered[f], F.col(f)) if tampered and f in tampered else F.col(f) for f in fields]
    leaf, claim = leaf_digest([F.col(f) for f in fields]), leaf_digest(claimed)
    if tampered:
        changed = F.lit(False)
        for f, c in tampered.items():
            changed = changed | ~F.col(f).eqNullSafe(F.coalesce(c, F.col(f)))
        claim = F.when(changed, claim).otherwise(leaf)  # most texts are hashed once
    tree = F.col(group).cast("string")
    kind = dict(docs.dtypes)[order]
    leaves = docs.select(tree.alias("tree"), F.col(order).alias("id"), leaf.alias("digest"), claim.alias("claim"))
    # equal rows are spread by a last key of no other meaning
    numbered = positions(leaves.withColumn("_salt", F.monotonically_increasing_id()), [F.col("tree"), F.col("id"), F.col("digest"), F.col("_salt")], "place")
    numbered = durable(numbered.drop("_salt"))
    # groups come in the order of their places: null first, then by UTF-8 bytes
    groups = durable(numbered.groupBy("tree").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("size")))
    key = F.coalesce(F.concat(F.lit("="), F.col("tree")), F.lit("-"))  # a grouping key without nulls
    sized = numbered.withColumn("_key", key).join(groups.select(key.alias("_key"), "start", "size"), "_key")
    nodes = durable(sized.select(F.col("_key").alias("tree"), (F.col("place") - F.col("start")).alias("at"), "size", "digest", "id", "claim"))
    lower = climb(nodes, block, arity)
    roots = lower[-1].select(F.col("tree").alias("name"), "digest")
    ordered = positions(roots.join(groups.select(key.alias("name"), "start"), "name"), [F.col("start")], "at")
    count = groups.count()
    tops = durable(ordered.select(F.lit("").alias("tree"), "at", F.lit(count).cast("long").alias("size"), "digest", "name"))
    upper = climb(tops, block, arity)
    found = upper[-1].select("digest").head(1)  # one row: the root of all
    root = found[0][0] if found else ""
    empty = F.array().cast("array<string>")
    start = spark.createDataFrame([("", 0)], "tree string, at long").withColumn("suffix", empty)
    proved = descend(upper, start, block, arity)
    subroots = proved.select("at", "suffix").join(tops.select("at", "size", "name", F.col("digest").alias("subroot")), "at")
    subroots = durable(subroots.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("at"), "suffix", "subroot", F.col("at").alias("top"), F.col("size").alias("tops")))
    above = descend(lower, subroots.select("tree", "at", "suffix"), block, arity, until=1) if len(lower) > 1 else subroots.select("tree", "at", "suffix")
    types = pa.schema([("id", _arrow(spark, kind)), ("leaf", pa.string()), ("proof", pa.list_(pa.string())), ("folded_root", pa.string()), ("tree", pa.string())])

    def finish(own: pa.Table, suffix: pa.Table) -> pa.Table:
        if not own.num_rows or not suffix.num_rows:
            return types.empty_table()
        own, found = _backward(own, suffix, block, arity)
        top, tops = suffix["top"][0].as_py(), suffix["tops"][0].as_py()
        places, sizes = own["at"].to_pylist(), own["size"].to_pylist()
        folded = [
            _fold(claim, 0, proof, [(at, size), (top, tops)], arity) for claim, at, size, proof in zip(own["claim"].to_pylist(), places, sizes, found, strict=True)
        ]
        return pa.table([own["id"], own["digest"], pa.array(found, types.field("proof").type), pa.array(folded, pa.string()), own["tree"]], schema=types)

    # a tree's place among the trees travels with the suffix of each of its blocks
    last = above.join(subroots.select("tree", "top", "tops"), "tree").withColumnRenamed("at", "block")
    out = _blocks(nodes, block).groupBy("tree", "block").cogroup(last.groupBy("tree", "block"))
    done = out.applyInArrow(finish, f"id {kind}, leaf string, proof array<string>, folded_root string, tree string")
    named = done.join(subroots.select("tree", "subroot"), "tree")
    return named.select(F.col("id").alias(order), "leaf", "subroot", F.lit(root).alias("root"), "proof", "folded_root")


def _arrow(spark, kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(spark.createDataFrame([], f"id {kind}").schema["id"].dataType)
