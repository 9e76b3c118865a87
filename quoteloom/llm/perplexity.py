"""Operator 11: documents are rejected by the perplexity of a modified Kneser-Ney model, in bands of their language.

The tokens are characters: a text is lower-cased, its digits become 0, a stretch of white space becomes one blank, and ``ORDER - 1``
start marks stand before it, one end mark behind it. Characters keep the model small beside the corpus and leave no
unknown words, so the perplexity of a short text means something too; spelling, mark-up, tables and noise show in it.

Training is counting in Spark, per language:

1. grams of the highest order are counted in the tasks and added by a grouped sum;
2. a lower gram's count is the number of different characters seen before it: one grouped count per order over the
   distinct grams of the order above, never over text;
3. the three discounts of each order come from the numbers of grams with count 1 to 4 (D_i = i - (i + 1) Y n_{i+1} / n_i, Y = n_1 / (n_1 + 2 n_2)),
   held between ``LEAST_DISCOUNT`` (so that nothing is impossible) and i; where these numbers say nothing, they are ``DISCOUNTS``;
4. p(w | h) = max(c(hw) - D(c(hw)), 0) / c(h) + g(h) p(w | shorter h), g(h) = (D1 N1(h) + D2 N2(h) + D3 N3+(h)) / c(h); below the single
   characters stand all characters of the language and one unknown, equally likely. Joins on (language, context)
   and (language, suffix) add these up order by order.

The model is stored as sorted arrays: 64-bit hashes of (language, gram), log p and log g, range-partitioned into files of the shared
folder. A scoring task maps them, looks up the distinct grams of a few megabytes of text in sorted order, and
backs off through g where a gram is absent.

Bands: a language's documents have quartiles of log perplexity (over the different texts that pass the base rules); a document
outside [q1 - ``FENCE`` w, q3 + ``FENCE`` w] is rejected, w the distance of the quartiles, ``LEAST_WIDTH`` at least. The upper bound
rejects noise, the lower one repetition and boilerplate.

Files are written whole and renamed, so tasks may run again; the shared folder must be mounted at one path on all machines, anything
else is refused. The driver keeps a line per file, never grams or documents; discounts and bands are small tables that are joined.

Nulls and edge cases: a null or wordless text has no words, fails the base rules and has no perplexity; a null language is a language
of its own; start and end marks in texts count as the replacement character; copies count as often as they stand in the table,
but once for the bands; very long texts are scored whole; a language without documents that pass has no band and nothing to judge;
an empty table gives an empty table; all columns pass through, new ones get names that the input does not hold.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.llm.batches import slices, split
from quoteloom.llm.trie import mounted
from quoteloom.session import durable, shared_path

ORDER = 5
FENCE, LEAST_WIDTH = 3.0, 0.02
DISCOUNTS = (0.5, 1.0, 1.5)
LEAST_DISCOUNT = 0.05
MIN_WORDS, MAX_REPEATED = 50, 50  # fixed values: words, percent
SYMBOLS = b"#*$%&|<>"  # fixed value
_MERGE, _KNOWN = 200_000, 600_000  # grams between merges, and those a task remembers
_PIECE = 1 << 20  # bytes of text whose grams a task sorts at a time
START, END, OTHER = "\x02", "\x03", "�"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_NO_LANGUAGE = b"\xff"  # no UTF-8 text


# --- texts as numbers ---------------------------------------------------------------------------------------------------


def _owners(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def characters(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts with their marks, where each text begins)."""
    plain = texts.fill_null("")
    joined = "".join(plain.to_pylist())
    lengths = pc.utf8_length(plain).to_numpy().astype(np.int64)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
    owner = np.repeat(np.arange(len(lengths)), lengths)
    points[(points == 2) | (points == 3)] = ord(OTHER)
    points[(points >= 48) & (points <= 57)] = 48
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    points[blank] = 32
    first = np.ones(len(points), bool)
    first[1:] = owner[1:] != owner[:-1]
    last = np.append(first[1:], True) if len(points) else first
    after_blank = np.zeros(len(points), bool)
    after_blank[1:] = blank[:-1]
    keep = ~blank | ~(first | after_blank)  # of each stretch the first, none at the beginning
    points, owner = points[keep], owner[keep]
    ends = np.ones(len(points), bool)
    ends[:-1] = owner[1:] != owner[:-1]
    keep = ~(ends & (points == 32))  # and none at the end
    points, owner = points[keep], owner[keep]
    del first, last, after_blank, ends
    n = np.bincount(owner, minlength=len(lengths)).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(n + order)])
    out = np.full(int(begins[-1]), 2, np.uint32)
    out[np.arange(len(points)) + owner * order + order - 1] = points
    out[begins[1:] - 1] = 3
    return out, begins


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.fill_null(""))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _stir(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def gram_hashes(points: np.ndarray, seeds: np.ndarray, order: int) -> np.ndarray:
    """The hash of the gram of ``order`` characters that begins at each place with enough places behind it.

    A gram is read backwards, so that one more character makes the next longer gram; ``seeds`` is the language's number at each place.
    """
    h = np.zeros(len(points) + 1, np.uint64)
    for n in range(1, order + 1):
        h = h[1:] * _MIX
        h += points[: len(points) - n + 1]
        h += np.uint64(1)
        h = _stir(h)
    return _stir(h ^ seeds[: len(h)])


def hashes_of(windows: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The same for grams given as rows of characters; one without characters is the language itself."""
    h = np.zeros(len(windows), np.uint64)
    for n in range(windows.shape[1] - 1, -1, -1):
        h = _stir(h * _MIX + windows[:, n] + np.uint64(1))
    return _stir(h ^ seeds)


def language_seed(name: str | None) -> int:
    return xxhash.xxh64_intdigest(_NO_LANGUAGE if name is None else name.encode(), 11)


def _seeds(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode(null_encoding="encode")
    table = np.array([language_seed(x) for x in coded.dictionary.to_pylist()], np.uint64)
    return table[coded.indices.to_numpy()]


# --- counting -----------------------------------------------------------------------------------------------------------


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts h, where each distinct value begins in it).

    Upper bits and places are sorted as one number, which is several times faster than sorting places by values; where two
    values share their upper bits, the plain way is taken.
    """
    bits = np.uint64(max(1, (len(h) - 1).bit_length()))
    packed = np.sort(h >> bits << bits | np.arange(len(h), dtype=np.uint64))
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ranked, upper = h[order], packed >> bits
    new = np.ones(len(h), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if (new[1:] & (upper[1:] == upper[:-1])).any():
        order = np.argsort(h, kind="stable")
        ranked = h[order]
        new[1:] = ranked[1:] != ranked[:-1]
    return order, np.nonzero(new)[0]


class _Counter:
    """Counts of grams of many slices: sorted hashes, counts, languages and characters, merged when they have doubled."""

    def __init__(self, order: int):
        self.order, self.names, self.place = order, [], {}
        self.held: list[tuple[np.ndarray, ...]] = []
        self.merged = self.rows = 0

    def add(self, langs: pa.Array, texts: pa.Array) -> None:
        points, begins = characters(_lowered(texts), self.order)
        owner = _owners(begins)
        inside = np.nonzero(owner[self.order - 1 :] == owner[: len(owner) - self.order + 1])[0]
        if not len(inside):
            return
        h = gram_hashes(points, _seeds(langs)[owner], self.order)[inside]
        by, begin = _runs(h)
        at = inside[by[begin]]
        lang = np.array([self._number(x) for x in langs.to_pylist()], np.int32)[owner[at]]
        self.held.append((h[by[begin]], np.diff(np.append(begin, len(h))), lang, np.lib.stride_tricks.sliding_window_view(points, self.order)[at]))
        self.rows += len(at)
        if self.rows > 2 * self.merged + _MERGE:
            self._merge()

    def _number(self, lang: str | None) -> int:
        if lang not in self.place:
            self.place[lang] = len(self.names)
            self.names.append(lang)
        return self.place[lang]

    def _merge(self) -> None:
        h, n, lang, grams = (np.concatenate([x[i] for x in self.held]) for i in range(4))
        by, begin = _runs(h)
        at = by[begin]
        self.held = [(h[at], np.add.reduceat(n[by], begin), lang[at], grams[at])]
        self.merged = self.rows = len(at)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._merge()
            _, n, lang, grams = self.held[0]
            text = grams.astype("<u4").tobytes().decode("utf-32-le")
            parts = pa.array([text[i : i + self.order] for i in range(0, len(text), self.order)], pa.string())
            names = pa.array(self.names, pa.string()).take(pa.array(lang))
            yield pa.RecordBatch.from_arrays([names, parts, pa.array(n)], ["lang", "gram", "n"])
        self.__init__(self.order)


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """``lang, gram, n`` of the highest order, combined as far as a bounded table in the task allows."""
    counter = _Counter(order)
    for batch in (piece for whole in batches for piece in slices(whole, 1, _PIECE)):
        counter.add(batch.column(0), batch.column(1))
        if counter.merged > _KNOWN:
            yield from counter.flush()
    yield from counter.flush()


_ROW = ["lang", "gram"]


def _suffix(gram: Column) -> Column:
    return F.substring(gram, 2, 1 << 20)


def _prefix(gram: Column, n: int) -> Column:
    return F.substring(gram, 1, n - 1)


def discounts(counted: DataFrame) -> DataFrame:
    """``lang, d1, d2, d3``: the discounts of one order by the numbers of grams with count 1 to 4; a row per language."""
    of = [F.count(F.when(F.col("n") == i, 1)).cast("double").alias(f"n{i}") for i in range(1, 5)]
    seen = counted.groupBy("lang").agg(*of)
    n = [F.col(f"n{i}") for i in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])

    def d(i: int) -> Column:
        value = F.lit(float(i)) - (i + 1) * y * n[i] / n[i - 1]
        known = (n[0] > 0) & (n[1] > 0) & (n[i - 1] > 0)
        return F.when(known, F.greatest(F.lit(LEAST_DISCOUNT), F.least(F.lit(float(i)), value))).otherwise(DISCOUNTS[i - 1])

    return seen.select("lang", *[d(i).alias(f"d{i}") for i in (1, 2, 3)])


def _joined(left: DataFrame, right: DataFrame, on: dict[str, Column], how: str = "inner") -> DataFrame:
    """Join on columns that may be null; ``on`` maps a column of the right side to an expression of the left."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    met = None
    for c, e in on.items():
        same = e.eqNullSafe(F.col(f"_r_{c}")) if c == "lang" else e == F.col(f"_r_{c}")
        met = same if met is None else met & same
    return left.join(renamed, met, how).drop(*[f"_r_{c}" for c in on])


def probabilities(docs: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """For n = 1 .. order: ``lang, gram, p, back``; ``back`` is g of the gram as a context, 1 where it is none.

    ``docs`` holds ``lang`` and ``text``. ``back`` is 1 in the table of the highest order. Before these tables comes one row per
    language for the empty context: the share of one character in an even spread, and g.
    """
    pairs = docs.select("lang", "text").mapInArrow(lambda it: _count(it, order), "lang string, gram string, n long")
    counts = {order: durable(pairs.groupBy(*_ROW).agg(F.sum("n").alias("n")))}
    for k in range(order - 1, 0, -1):
        counts[k] = durable(counts[k + 1].select("lang", _suffix(F.col("gram")).alias("gram")).groupBy(*_ROW).agg(F.count(F.lit(1)).alias("n")))
    # all characters of a language and an unknown one
    shorter = counts[1].groupBy("lang").agg((1.0 / (F.count(F.lit(1)) + 1)).alias("p")).withColumn("gram", F.lit(""))
    tables: list[DataFrame] = []
    for k in range(1, order + 1):
        with_d = _joined(counts[k], durable(discounts(counts[k])), {"lang": F.col("lang")})
        n, d = F.col("n"), F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = with_d.select("lang", "gram", "n", d.alias("d"), _prefix(F.col("gram"), k).alias("context"), _suffix(F.col("gram")).alias("rest"))
        contexts = durable(rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("back")))
        seen = _joined(rows, contexts, {"lang": F.col("lang"), "context": F.col("context")})
        less = _joined(seen, shorter.select("lang", F.col("gram").alias("rest"), F.col("p").alias("less")), {"lang": F.col("lang"), "rest": F.col("rest")})
        p = F.greatest(n - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("back") * F.col("less")
        own = durable(less.select("lang", "gram", p.alias("p")))
        if tables:  # what the shorter grams are worth as contexts of this order
            held = contexts.select("lang", F.col("context").alias("gram"), F.lit(None).cast("double").alias("p"), "back")
            both = tables[-1].withColumn("back", F.lit(None).cast("double")).unionByName(held)
            tables[-1] = both.groupBy(*_ROW).agg(F.max("p").alias("p"), F.max("back").alias("back"))
        else:  # the empty context stands for the language itself: what an unknown character gets
            base = _joined(contexts, shorter.select("lang", F.col("p").alias("less")), {"lang": F.col("lang")})
            tables.append(base.select("lang", F.lit("").alias("gram"), F.col("less").alias("p"), "back"))
        tables.append(own)
        shorter = own
    # start marks alone are contexts and never come next: their p is not asked for
    back = [F.coalesce("back", F.lit(1.0)) if "back" in t.columns else F.lit(1.0) for t in tables]
    return [t.select("lang", "gram", F.coalesce("p", F.lit(1.0)).alias("p"), b.alias("back")) for t, b in zip(tables, back, strict=True)]


# --- sorted hash arrays -------------------------------------------------------------------------------------------------


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``h, p, back`` (logarithms) of grams."""
    for batch in batches:
        seeds, grams = _seeds(batch.column(0)), batch.column(1)
        sizes = pc.utf8_length(grams).to_numpy()
        out = np.zeros(len(sizes), np.uint64)
        for n in np.unique(sizes).tolist():
            who = np.nonzero(sizes == n)[0]
            points = np.frombuffer("".join(grams.take(pa.array(who)).to_pylist()).encode("utf-32-le"), np.uint32)
            out[who] = hashes_of(points.reshape(len(who), n).astype(np.uint64), seeds[who])
        logs = [pa.array(np.log10(batch.column(i).to_numpy()).astype(np.float32)) for i in (2, 3)]
        yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), *logs], ["h", "p", "back"])


_KIND = np.dtype([("h", "<i8"), ("p", "<f4"), ("back", "<f4")])


def _write(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """A range partition in hash order becomes a file of three arrays; its line goes to the driver."""
    part, n, first = TaskContext.get().partitionId(), 0, None
    names = [f"{root}/{c}-{part:06d}" for c in _KIND.names]
    temporary = [f"{x}.{uuid.uuid4().hex}" for x in names]
    files = [open(x, "wb") for x in temporary]
    for batch in batches:
        if batch.num_rows:
            first = batch.column(0)[0].as_py() if first is None else first
            n += batch.num_rows
            for f, column, c in zip(files, batch.columns, _KIND.names, strict=True):
                f.write(column.to_numpy().astype(_KIND[c]).tobytes())
    for f in files:
        f.close()
    for old, new in zip(temporary, names, strict=True):
        os.replace(old, new)
    if n:
        yield pa.RecordBatch.from_pylist([{"part": part, "first": first, "size": n}])


class Model:
    """Where a model's arrays are: the folder and a line (part, first hash, size) per file."""

    def __init__(self, root: str, lines: list[list[int]], order: int):
        self.root, self.lines, self.order = root, lines, order


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """The model of ``lang, text``."""
    spark = docs.sparkSession
    root = mounted(shared_path(spark, "perplexity"))
    os.makedirs(root, exist_ok=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = probabilities(docs, order)
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    ranged = durable(every.mapInArrow(_hashed, "h long, p float, back float")).repartitionByRange(parts, "h").sortWithinPartitions("h")
    lines = sorted([list(r) for r in ranged.mapInArrow(lambda it: _write(it, root), "part long, first long, size long").collect()])
    with open(f"{root}/model.json", "w") as f:
        json.dump({"order": order, "files": lines}, f)
    return Model(root, lines, order)


class Arrays:
    """The mapped arrays of a model; hashes are looked up in sorted order."""

    def __init__(self, model: Model):
        self.model, self.files = model, {}
        self.first = np.array([r[1] for r in model.lines], np.int64)

    def _file(self, k: int) -> list[np.ndarray]:
        if k not in self.files:
            part, _, size = self.model.lines[k]
            self.files[k] = [np.memmap(f"{self.model.root}/{c}-{part:06d}", _KIND[c], "r", shape=(size,)) for c in _KIND.names]
        return self.files[k]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, log p, log back) of each hash; zeros where absent."""
        found, p, back = np.zeros(len(hashes), bool), np.zeros(len(hashes)), np.zeros(len(hashes))
        wanted = hashes.view(np.int64)
        order = np.argsort(wanted)
        ranked = wanted[order]
        cuts = np.searchsorted(ranked, self.first)
        for k, lo in enumerate(cuts.tolist()):
            hi = int(cuts[k + 1]) if k + 1 < len(cuts) else len(ranked)
            if lo == hi:
                continue
            h, ps, backs = self._file(k)
            at = np.minimum(np.searchsorted(h, ranked[lo:hi]), len(h) - 1)
            same = h[at] == ranked[lo:hi]
            who, at = order[lo:hi][same], at[same]
            found[who], p[who], back[who] = True, ps[at], backs[at]
        return found, p, back


def score_texts(arrays: Arrays, langs: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability, characters with the end mark) of each text; texts without a word have neither."""
    order = arrays.model.order
    points, begins = characters(_lowered(texts), order)
    owner = _owners(begins)
    seeds = _seeds(langs)
    inside = np.nonzero(owner[order - 1 :] == owner[: len(owner) - order + 1])[0]
    longest = gram_hashes(points, seeds[owner], order)[inside]
    by, begin = _runs(longest)
    at = inside[by[begin]]  # a place where each distinct gram begins
    grams, own = np.lib.stride_tricks.sliding_window_view(points, order)[at].astype(np.uint64), seeds[owner[at]]
    log, open_ = np.zeros(len(at)), np.arange(len(at))
    for n in range(order, 0, -1):
        found, p, _ = arrays.find(hashes_of(grams[open_, order - n :], own[open_]))
        log[open_[found]] += p[found]
        open_ = open_[~found]
        if n > 1 and len(open_):  # back off: the characters before the last one
            log[open_] += arrays.find(hashes_of(grams[open_, order - n : -1], own[open_]))[2]
    if len(open_):  # an unknown character of the language
        _, p, back = arrays.find(_stir(own[open_]))
        log[open_] += p + back
    each = np.empty(len(longest))
    each[by] = np.repeat(log, np.diff(np.append(begin, len(longest))))
    n = np.diff(begins) - order + 1
    total = np.add.reduceat(each, begins[:-1] - np.arange(len(n)) * (order - 1)) if len(each) else np.zeros(len(n))
    return np.where(n > 1, total, 0.0), np.where(n > 1, n, 0)


# --- base counts --------------------------------------------------------------------------------------------------------


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Words, their characters, symbols, repeated lines and words of repeated three-word windows of each text."""
    plain = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    numbers, words, lengths = split(texts.cast(pa.string()), lower=False)
    out = {
        "n_words": lengths,
        "word_chars": _per_text(~_SPACE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_text(_SYMBOL[data], offsets),
    }
    parts = pc.split_pattern(plain, "\n")
    coded = parts.flatten().dictionary_encode()
    blank = pc.or_(pc.equal(coded.dictionary, ""), pc.ascii_is_space(coded.dictionary)).to_numpy(zero_copy_only=False)
    line, count = coded.indices.to_numpy().astype(np.int64), pc.list_value_length(parts).to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(count)), count)
    used = ~blank[line] if len(blank) else np.zeros(0, bool)
    line, text = line[used], text[used]
    different = np.unique(text * max(len(blank), 1) + line) // max(len(blank), 1)
    out["n_dup_lines"] = np.bincount(text, minlength=len(count)) - np.bincount(different, minlength=len(count))
    out["n_repeat_words"] = _repeated(numbers.astype(np.int64), lengths, len(words))
    return out


def _repeated(words: np.ndarray, lengths: np.ndarray, distinct: int) -> np.ndarray:
    """Words that lie in a three-word window found twice or more in their text, per text."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    covered = np.zeros(len(words), bool)
    if len(words) > 2:
        _, pair = np.unique(words[:-1] * distinct + words[1:], return_inverse=True)
        _, triple = np.unique(pair[:-1] * distinct + words[2:], return_inverse=True)
        inside = np.nonzero(text[2:] == text[:-2])[0]
        window = (text[inside] * (int(triple.max()) + 1) + triple[inside]).astype(np.uint64)
        by, begin = _runs(window * _MIX)  # an odd factor tells as many apart and spreads them
        size = np.diff(np.append(begin, len(inside)))
        at = inside[by[np.repeat(size > 1, size)]]
        for k in range(3):
            covered[at + k] = True
    return np.bincount(text[covered], minlength=len(lengths))


# --- documents ----------------------------------------------------------------------------------------------------------

_FOUND = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log10_p double, n_chars_scored long"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]
_STRUCT = pa.struct([(n, pa.float64() if n == "log10_p" else pa.int64()) for n in _NAMES])


def _examined(model: Model):
    @F.arrow_udf(_FOUND)
    def examine(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        arrays = Arrays(model)
        for langs, texts in batches:
            out = []
            for piece in slices(pa.RecordBatch.from_arrays([langs, texts], ["lang", "text"]), 1, _PIECE):
                log, n = score_texts(arrays, piece.column(0), piece.column(1))
                counts = base_counts(piece.column(1)) | {"log10_p": log, "n_chars_scored": n}
                out.append(pa.StructArray.from_arrays([pa.array(counts[c], type=_STRUCT.field(c).type) for c in _NAMES], fields=list(_STRUCT)))
            yield pa.concat_arrays(out) if out else pa.array([], _STRUCT)

    return examine


def bands(judged: DataFrame, fence: float = FENCE, least: float = LEAST_WIDTH) -> DataFrame:
    """``lang, lower, upper`` of the logarithm of perplexity, from the different texts of ``lang, _text_key, log_perplexity``; a row per language."""
    texts = judged.groupBy("lang", "_text_key").agg(F.first("log_perplexity").alias("x"))
    q = F.percentile_approx("x", F.array(F.lit(0.25), F.lit(0.75)), 10_000)
    wide = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(least)) * fence
    return texts.groupBy("lang").agg(q.alias("q")).select("lang", (F.col("q")[0] - wide).alias("lower"), (F.col("q")[1] + wide).alias("upper"))


def judge(docs: DataFrame, lang: str = "lang", text: str = "text", order: int = ORDER, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) and a struct ``_quality`` (a free name: underscores are put before it where the input has it).

    Its fields: the base counts, ``log10_p``, ``n_chars_scored``, ``log_perplexity`` (null without words), ``lower`` and ``upper`` of the
    language's band, ``base_failed`` and ``kept``.
    """
    keep = docs.columns if keep is None else keep
    model = train(docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")), order)
    inner = docs.select(
        F.struct(*keep).alias("row"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(text)).alias("_text_key"),
        _examined(model)(F.col(lang).cast("string"), F.col(text)).alias("q"),
    )
    n = F.col("q.n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("q.n_repeat_words") > MAX_REPEATED * n)
    log_perplexity = F.when(F.col("q.n_chars_scored") > 0, -F.col("q.log10_p") / F.col("q.n_chars_scored"))
    scored = durable(inner.withColumn("base_failed", failed).withColumn("log_perplexity", log_perplexity))
    passing = scored.filter(~F.col("base_failed")).select("lang", "_text_key", "log_perplexity")
    met = _joined(scored, durable(bands(passing)), {"lang": F.col("lang")}, "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    name = "_quality"
    while name in keep:
        name = "_" + name
    fields = [*[F.col(f"q.{c}").alias(c) for c in _NAMES], "log_perplexity", "lower", "upper", "base_failed", kept.alias("kept")]
    return met.select("row.*", F.struct(*fields).alias(name))
