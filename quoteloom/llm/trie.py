"""Operator 10: language-model scoring with a sharded Elias-Fano trie of n-grams (orders 1 to 3).

Training, all counts over all training documents:

1. Word counts are combined per task and by a grouped sum, and written in hash order as vocabulary files; a word's id is
   its place in that order. The end of a document is a word too, and stands before each document as its context.
2. Two- and three-word grams are counted per task and packed (numbers, not rows) for the shard their first two words
   fall into. Shards are stretches of (word, next word) that hold about ``SHARD_TOKENS`` tokens by the word counts
   alone, so a word that makes up a third of all text is spread over as many shards as it needs.
3. Each shard's task merges its grams and writes one file: a trie whose levels are Elias-Fano sequences. The entry of word w
   below context c is stored as c * V + w, so looking a successor up relative to its context is one search in the
   sequence; pointers to the next level are a monotone sequence as well. Probabilities and back-off weights are
   16-bit numbers on a logarithmic scale (``STEP`` decades apart), down to 1e-300, far below 1 / any count.

Scoring memory-maps the files in the shared folder; a batch of documents looks up all its grams shard by shard. The score
is interpolated absolute discounting: p(w | h) = max(c(hw) - D, 0) / c(h) + D t(h) / c(h) p(w | shorter h), t(h) the
number of distinct words after h, down to the add-one word probability, which includes one unknown word.

Files are written whole under a temporary name and renamed, so tasks may run again. The shared folder must be mounted at the
same path everywhere (memory mapping asks for that); anything else is refused. The driver keeps a line per
vocabulary file and per shard, never words or grams.

Nulls and edge cases: a null text is an empty one (its end alone is scored); a null doc_id counts as the empty string and
trains; repeated rows train and are scored each; without training documents every word is unknown and only the
add-one probability is left; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.llm import eliasfano
from quoteloom.llm.batches import slices, split
from quoteloom.session import durable, shared_path

DISCOUNT = 0.75
STEP = 0.03
SHARD_TOKENS = 2_500_000
_CHUNK = 2_000_000  # tokens whose grams a task counts at a time
_KNOWN = 500_000  # words a task remembers
_END = np.array([xxhash.xxh64_intdigest(b"")], np.uint64).view(np.int64)[0]  # no word is empty


def mounted(uri: str) -> str:
    parts = urlsplit(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"the trie is memory-mapped: {uri} must be a folder mounted at one path on all machines")
    return parts.path


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


# --- vocabulary -------------------------------------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        h, n = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        held.clear()
        h, which = np.unique(h, return_inverse=True)
        n = np.bincount(which, weights=n, minlength=len(h)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    for batch in (piece for whole in batches for piece in slices(whole, 0)):
        numbers, words, lengths = split(batch.column(0), lower=True)
        words = words.to_pylist()
        n = np.bincount(numbers, minlength=len(words))
        held.append((np.append(_hashes(words), _END), np.append(n, len(lengths))))
        if sum(len(x[0]) for x in held) > 2 * _KNOWN:
            yield flush()
    if held:
        yield flush()


def _write_words(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """A range partition in hash order becomes a vocabulary file; its line goes to the driver."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not got:
        return
    h, n = (np.concatenate([g[i] for g in got]) for i in (0, 1))
    part = TaskContext.get().partitionId()
    upto = np.concatenate([[0], np.cumsum(n)])
    eliasfano.save(f"{root}/words-{part:06d}", {"h": h, "n": n, "upto": upto[:-1]}, {})
    yield pa.RecordBatch.from_pylist([{"part": part, "first": int(h[0]), "size": len(h), "tokens": int(upto[-1])}])


class Words:
    """The vocabulary files, mapped; ids are places in hash order over all files."""

    def __init__(self, root: str, lines: list[list[int]]):
        self.root, self.files = root, {}
        self.part = [r[0] for r in lines]
        self.first = np.array([r[1] for r in lines], np.int64)
        sizes, tokens = [r[2] for r in lines], [r[3] for r in lines]
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(tokens)]).astype(np.int64)
        self.size, self.tokens = int(self.start[-1]), int(self.before[-1])

    def _file(self, k: int) -> dict:
        if k not in self.files:
            self.files[k] = eliasfano.load(f"{self.root}/words-{self.part[k]:06d}")[0]
        return self.files[k]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of word hashes, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        file = np.searchsorted(self.first, hashes, "right") - 1
        for k in np.unique(file[file >= 0]):
            who = np.nonzero(file == k)[0]
            h = self._file(k)["h"]
            at = np.minimum(np.searchsorted(h, hashes[who]), len(h) - 1)
            same = h[at] == hashes[who]
            out[who[same]] = at[same] + self.start[k]
        return out

    def take(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each id and count of all words before it; zeros for -1."""
        n, upto = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        file = np.where(ids >= 0, np.searchsorted(self.start, ids, "right") - 1, -1)
        for k in np.unique(file[file >= 0]):
            who = np.nonzero(file == k)[0]
            at, f = ids[who] - self.start[k], self._file(k)
            n[who], upto[who] = f["n"][at], f["upto"][at] + self.before[k]
        return n, upto


class Reader:
    """Word ids of texts, remembered per distinct word."""

    def __init__(self, root: str, lines: list[list[int]]):
        self.words = Words(root, lines)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        end = self.words.find(np.array([_END]))
        n, upto = self.words.take(end)
        self.ids, self.n, self.upto = [end], [n], [upto]  # entry 0 is the end of a document
        self.place, self.after = [np.full(1, -2)], [np.zeros(1, np.int64)]  # what a scorer finds out about contexts

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(entries, ends): one end before the first document, then each document's words and its end; and where the ends are."""
        if len(self.known) > _KNOWN:
            self.forget()
        numbers, words, lengths = split(texts, lower=True)
        words = words.to_pylist()
        new = list(set(words).difference(self.known))
        if new:
            first = sum(map(len, self.ids))
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            ids = self.words.find(_hashes(new))
            n, upto = self.words.take(ids)
            self.ids.append(ids), self.n.append(n), self.upto.append(upto)
            self.place.append(np.full(len(new), -2)), self.after.append(np.zeros(len(new), np.int64))
        ends = np.cumsum(lengths + 1)
        entries = np.zeros(int(ends[-1]) + 1, np.int64)
        inner = np.ones(len(entries), bool)
        inner[0], inner[ends] = False, False
        entries[inner] = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[numbers]
        return entries, ends

    def columns(self) -> tuple[np.ndarray, ...]:
        """Per entry: id, count, count of all words before, place as a context (-2: not looked up), words after it."""
        for name in ("ids", "n", "upto", "place", "after"):
            if len(getattr(self, name)) > 1:
                setattr(self, name, [np.concatenate(getattr(self, name))])
        return self.ids[0], self.n[0], self.upto[0], self.place[0], self.after[0]


def _shard_of(n: np.ndarray, upto: np.ndarray, next_upto: np.ndarray, tokens: int, per_shard: int) -> np.ndarray:
    """Shard of (word, next word): where the pair would stand if next words were spread as words are."""
    return ((upto + n * (next_upto / tokens)) // per_shard).astype(np.int64)


# --- grams ------------------------------------------------------------------------------------------------------------


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Unsigned arrays as compressed byte planes."""
    out = [len(arrays).to_bytes(4, "little")]
    for a in arrays:
        planes = np.ascontiguousarray(a.reshape(-1, 1).view(np.uint8).T).tobytes()
        data = zstandard.ZstdCompressor(level=1).compress(planes)
        out.append(len(a).to_bytes(8, "little") + a.itemsize.to_bytes(4, "little") + len(data).to_bytes(8, "little") + data)
    return b"".join(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 4
    for _ in range(int.from_bytes(blob[:4], "little")):
        n, item, size = (int.from_bytes(blob[at + a : at + b], "little") for a, b in ((0, 8), (8, 12), (12, 20)))
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[at + 20 : at + 20 + size], max_output_size=max(1, n * item)), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(item, n).T).reshape(-1).view(f"<u{item}"))
        at += 20 + size
    return out


def _gaps(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


def _count_grams(batches: Iterator[pa.RecordBatch], root: str, lines: list[list[int]], per_shard: int) -> Iterator[pa.RecordBatch]:
    reader = Reader(root, lines)
    tokens = reader.words.tokens
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush():
        first, second, third = (np.concatenate([h[i] for h in held]) for i in range(3))  # third: -1 where there is none
        held.clear()
        pairs, pair = np.unique((first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64), return_inverse=True)
        pair_n = np.bincount(pair, minlength=len(pairs))
        there = third >= 0
        triples, triple_n = np.unique((pair[there].astype(np.uint64) << np.uint64(32)) | third[there].astype(np.uint64), return_counts=True)
        a, b = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        n, upto = reader.words.take(a)
        shard = _shard_of(n, upto, reader.words.take(b)[1], tokens, per_shard)
        owner = (triples >> np.uint64(32)).astype(np.int64)
        names, blobs = [], []
        for s in np.unique(shard):
            lo, hi = np.searchsorted(shard, [s, s + 1])
            t0, t1 = np.searchsorted(owner, [lo, hi])
            blobs.append(
                _pack([
                    _gaps(a[lo:hi].astype(np.uint32)), b[lo:hi].astype(np.uint32), pair_n[lo:hi].astype(np.uint32),
                    _gaps((owner[t0:t1] - lo).astype(np.uint32)), (triples[t0:t1] & np.uint64(0xFFFFFFFF)).astype(np.uint32), triple_n[t0:t1].astype(np.uint32),
                ])
            )
            names.append(int(s))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    for batch in (piece for whole in batches for piece in slices(whole, 0)):
        entries, ends = reader.read(batch.column(0))
        ids = reader.columns()[0][entries]
        third = np.append(ids[2:], -1)
        third[ends[:-1] - 1] = -1  # nothing follows (word, end)
        held.append((ids[:-1].astype(np.uint32), ids[1:].astype(np.uint32), third))
        if sum(len(h[0]) for h in held) > _CHUNK:
            yield flush()
    if held:
        yield flush()


# --- the trie of a shard ----------------------------------------------------------------------------------------------


_LEAST = 300.0  # decades; a count would have to pass 1e299


def _code(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(np.maximum(p, 10.0**-_LEAST)) / STEP), 0, round(_LEAST / STEP)).astype(np.uint16)


_VALUE = 10.0 ** (-STEP * np.arange(round(_LEAST / STEP) + 1))


def _build(key, table: pa.Table, root: str, lines: list[list[int]], discount: float) -> pa.Table:
    """Merge the packed grams of a shard into its file; returns the counts of its outermost contexts."""
    words = Words(root, lines)
    parts = [_unpack(b.as_py()) for b in table["blob"]]
    a = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
    pairs = np.concatenate([(x << np.uint64(32)) | p[1] for x, p in zip(a, parts, strict=True)])
    starts = np.cumsum([0, *[len(p[0]) for p in parts]])
    pairs, pair = np.unique(pairs, return_inverse=True)
    pair_n = np.bincount(pair, weights=np.concatenate([p[2] for p in parts]), minlength=len(pairs)).astype(np.int64)
    owner = np.concatenate([pair[s + np.cumsum(p[3], dtype=np.int64)] for s, p in zip(starts, parts, strict=False)])
    triples = (owner.astype(np.uint64) << np.uint64(32)) | np.concatenate([p[4] for p in parts])
    triples, triple = np.unique(triples, return_inverse=True)
    triple_n = np.bincount(triple, weights=np.concatenate([p[5] for p in parts]), minlength=len(triples)).astype(np.int64)
    del a, parts, pair, triple

    first, v = (pairs >> np.uint64(32)).astype(np.int64), words.size
    contexts, begin = np.unique(first, return_index=True)
    place = np.searchsorted(contexts, first)
    owner = (triples >> np.uint64(32)).astype(np.int64)
    after = np.bincount(owner, minlength=len(pairs))  # distinct words after each pair
    levels = {
        "context": (contexts, v),
        "pointer2": (np.append(begin, len(pairs)), len(pairs) + 1),
        "word2": (place * v + (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), len(contexts) * v),
        "pointer3": (np.concatenate([[0], np.cumsum(after)]), len(triples) + 1),
        "word3": (owner * v + (triples & np.uint64(0xFFFFFFFF)).astype(np.int64), len(pairs) * v),
    }
    arrays, meta = {}, {}
    for name, (values, universe) in levels.items():
        more, meta[name] = eliasfano.encode(name, values, universe, name.startswith("pointer"))
        arrays |= more
    arrays["p2"] = _code((pair_n - discount) / words.take(first)[0])
    arrays["p3"] = _code((triple_n - discount) / pair_n[owner])
    arrays["back3"] = _code(discount * after / pair_n)
    eliasfano.save(f"{root}/trie-{key[0].as_py():08d}", arrays, meta)
    sizes = np.diff(np.append(begin, len(pairs)))
    edge = sorted({0, len(contexts) - 1})  # only these may go on in a neighbouring shard
    return pa.table({"word": pa.array(contexts[edge], pa.int64()), "after": pa.array(sizes[edge], pa.int64())})


class Shard:
    def __init__(self, path: str):
        self.arrays, meta = eliasfano.load(path)
        self.context, self.pointer2, self.word2, self.pointer3, self.word3 = (
            eliasfano.EliasFano(self.arrays, name, meta[name]) for name in ("context", "pointer2", "word2", "pointer3", "word3")
        )


class Model:
    """A trained model: where its files are and the few numbers that go with them."""

    def __init__(self, root: str, lines: list[list[int]], per_shard: int, wide: dict[int, int], discount: float):
        self.root, self.lines, self.per_shard, self.wide, self.discount = root, lines, per_shard, wide, discount


def _texts(docs: DataFrame) -> Column:
    return F.col("text").cast("binary")


def train(docs: DataFrame, shard_tokens: int = SHARD_TOKENS, discount: float = DISCOUNT) -> Model:
    spark = docs.sparkSession
    uri = shared_path(spark, "trie")
    root = mounted(uri)
    os.makedirs(root, exist_ok=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(_texts(docs).alias("text"))
    counts = texts.mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    ranged = durable(counts).repartitionByRange(parts, "h").sortWithinPartitions("h")
    files = ranged.mapInArrow(lambda it: _write_words(it, root), "part long, first long, size long, tokens long")
    lines = sorted([list(r) for r in files.collect()])  # a line per file
    words = Words(root, lines)
    if words.size >= 1 << 32:
        raise ValueError("ids of words are 32-bit numbers")
    if not words.tokens:
        return Model(root, [], shard_tokens, {}, discount)
    packed = texts.mapInArrow(lambda it: _count_grams(it, root, lines, shard_tokens), "shard long, blob binary")
    edges = packed.groupBy("shard").applyInArrow(lambda key, t: _build(key, t, root, lines, discount), "word long, after long")
    wide = {r.word: r.after for r in edges.groupBy("word").agg(F.sum("after").alias("after")).collect()}  # two per shard at most
    with open(f"{root}/model.json", "w") as f:
        json.dump({"words": lines, "per_shard": shard_tokens, "discount": discount, "wide": sorted(wide.items())}, f)
    return Model(root, lines, shard_tokens, wide, discount)


# --- scoring ----------------------------------------------------------------------------------------------------------


class Scorer:
    def __init__(self, model: Model):
        self.model, self.reader, self.shards = model, Reader(model.root, model.lines), {}
        self.wide = np.array(sorted(model.wide), np.int64)
        self.wide_after = np.array([model.wide[w] for w in self.wide.tolist()], np.int64)

    def shard(self, s: int) -> Shard | None:
        if s not in self.shards:
            if len(self.shards) > 512:
                self.shards.pop(next(iter(self.shards)))
            path = f"{self.model.root}/trie-{s:08d}"
            self.shards[s] = Shard(path) if os.path.exists(path) else None
        return self.shards[s]

    def _contexts(self, entries: np.ndarray) -> None:
        """Fill in place and after of the words among ``entries`` that are new as contexts.

        A word whose pairs lie in one shard is looked up there once; one whose pairs are spread (``wide``) has its number
        of next words in the model and a place in each of its shards (-1 here).
        """
        ids, n, upto, place, after = self.reader.columns()
        new = np.unique(entries[(place[entries] == -2) & (ids[entries] >= 0)])
        if not len(new):
            return
        place[new] = -1
        if not len(self.wide):
            return
        k = np.minimum(np.searchsorted(self.wide, ids[new]), len(self.wide) - 1)
        wide = self.wide[k] == ids[new]
        after[new[wide]] = self.wide_after[k[wide]]
        home = new[~wide]
        shard = _shard_of(n[home], upto[home], np.zeros(len(home)), self.reader.words.tokens, self.model.per_shard)
        # a word's pairs may all lie in the second of two shards that its stretch touches; then it is wide
        for number, who in _grouped(shard):
            s = self.shard(number)
            if s is not None:
                c = s.context.find(ids[home[who]])
                there = np.nonzero(c >= 0)[0]
                c, to = c[there], home[who][there]
                place[to] = c
                after[to] = s.pointer2.get(c + 1) - s.pointer2.get(c)

    def score(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score, score."""
        entries, ends = self.reader.read(texts)
        self._contexts(entries[:-1])
        columns = self.reader.columns()
        words, discount = self.reader.words, self.model.discount
        ids, n, upto = (c[entries] for c in columns[:3])
        begins = np.concatenate([[0], ends[:-1]])  # of each document's first token, when the leading end is dropped
        p1 = (n[1:] + 1) / (words.tokens + words.size + 1)
        p2, p3, back3 = np.zeros(len(p1)), np.zeros(len(p1)), np.ones(len(p1))
        after = columns[4][entries[:-1]]
        back2 = np.where(after > 0, discount * after / np.maximum(n[:-1], 1), 1.0)
        pair = np.nonzero((after > 0) & (ids[1:] >= 0))[0]  # token i follows entry i
        shard = _shard_of(n[pair], upto[pair], upto[pair + 1], max(words.tokens, 1), self.model.per_shard)
        v = words.size
        for number, some in _grouped(shard):
            s = self.shard(number)
            if s is None:
                continue
            at = pair[some]
            context = columns[3][entries[at]]
            spread = np.nonzero(context < 0)[0]
            if len(spread):
                names, which = np.unique(ids[at[spread]], return_inverse=True)
                context[spread] = s.context.find(names)[which]
                at, context = at[context >= 0], context[context >= 0]
            found = s.word2.find(context * v + ids[at + 1])
            at, found = at[found >= 0], found[found >= 0]
            p2[at] = _VALUE[s.arrays["p2"][found]]
            # the pair is the context of the token behind it, unless it ends its document
            go = entries[at + 1] != 0
            longer, follow = found[go], at[go] + 1
            back3[follow] = _VALUE[s.arrays["back3"][longer]]
            ok = ids[follow + 1] >= 0
            longer, follow = longer[ok], follow[ok]
            third = s.word3.find(longer * v + ids[follow + 1])
            p3[follow[third >= 0]] = _VALUE[s.arrays["p3"][third[third >= 0]]]
        log = np.log10(np.minimum(p3 + back3 * (p2 + back2 * p1), 1.0))
        tokens = np.diff(np.append(begins, len(p1)))
        known = np.add.reduceat((n[1:] > 0).astype(np.int64), begins)
        return tokens, known, np.add.reduceat(np.log10(p1), begins), np.add.reduceat(log, begins)


def _grouped(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each number with the positions that hold it, in order."""
    order = np.argsort(numbers, kind="stable")
    cuts = [*np.nonzero(np.diff(numbers[order], prepend=-1))[0], len(order)]
    for lo, hi in itertools.pairwise(cuts):
        yield int(numbers[order[lo]]), order[lo:hi]


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    tokens = scorer.reader.words.tokens
    for batch in (piece for whole in batches for piece in slices(whole, 2)):
        n, known, base, score = scorer.score(batch.column(2))
        total = pa.array(np.full(batch.num_rows, tokens, np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n), pa.array(known), total, pa.array(base), pa.array(score)],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return F.crc32(text) % folds == fold


def score(docs: DataFrame, out: Column, shard_tokens: int = SHARD_TOKENS, discount: float = DISCOUNT) -> DataFrame:
    """Scores of all rows by a model of the rows where ``out`` is false."""
    model = train(docs.filter(~out), shard_tokens, discount)
    rows = docs.select("doc_id", out.alias("held_out"), _texts(docs).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.mapInArrow(lambda it: _score(it, model), schema)
