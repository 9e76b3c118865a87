"""Operator 2: token ids in length-delimited binary records, with a separate offset index.

File format: each record is its payload's length (8 bytes, little endian), the masked CRC-32C of those 8 bytes, the payload,
and the masked CRC-32C of the payload: the framing that public record readers expect. A payload is a 16-bit flag
word (1: no document id), the document id (8 bytes), the token ids in 16 or 32 bits as the vocabulary needs.

Order: tokenized documents are range-partitioned by doc_id and each partition becomes one or more files, so ids ascend
within a file and from file to file. A file is written under a name of the task's attempt and then renamed: a task
that runs again, or twice at once, leaves the same file. The index (file, offset, length, document, tokens, tokens
before it) is a Parquet table; readers take any rows of it in any order and read just those bytes.

Tokenizing: the tokenizer drops white space and never joins what it separates, so a text is the sequence of its white-space
pieces; each distinct piece is encoded by the library once per Python worker and remembered (``_CACHE`` pieces at most).

The output folder must be a file system that ``pyarrow.fs`` can open by its URI (local or mounted paths, HDFS, S3, GCS).

Nulls and edge cases: a null text is an empty one (its record holds the end id alone); rows without doc_id come first; rows
that share a doc_id stand in the order of a hash of their texts; repeated rows each have a record; an empty table writes no
file; other columns are not read.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from itertools import chain, pairwise
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoteloom.llm.batches import slices, split
from quoteloom.session import durable, shared_path

END_ID = 2
FILE_BYTES = 64 << 20
_CACHE = 800_000
_POLY = 0x82F63B78  # Castagnoli, reflected
_MASK_ADD = 0xA282EAD8
_LANE = 64  # 16-bit words per lane


# --- CRC-32C of many messages at once ---------------------------------------------------------------------------------


def _table16() -> np.ndarray:
    """What a 16-bit word leaves in the register."""
    v = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        v = np.where(v & 1, (v >> 1) ^ np.uint32(_POLY), v >> 1)
    return v


class Crc32c:
    """Vectorised CRC-32C over messages of whole 16-bit words: lanes of 64 words run side by side, then join.

    A register started at 0 ignores leading zeros, so messages are padded on the left to whole lanes.
    """

    def __init__(self):
        self.step = _table16()
        unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(_LANE):
            unit = self._feed(unit, np.uint32(0))
        # shifting by one lane is linear: tables for its lower and upper half
        self.low = self._span(unit[:16])
        self.high = self._span(unit[16:])

    def _feed(self, reg, word):
        return self.step[(reg ^ word) & 0xFFFF] ^ (reg >> np.uint32(16))

    @staticmethod
    def _span(basis: np.ndarray) -> np.ndarray:
        out = np.zeros(1, np.uint32)
        for b in basis:
            out = np.concatenate([out, out ^ b])
        return out

    def many(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """CRCs of consecutive messages of ``lengths`` (at least 2) 16-bit words each, laid end to end in ``words``."""
        if not len(lengths):
            return np.zeros(0, np.uint32)
        ends = np.cumsum(lengths)
        data = words.astype(np.uint16, copy=True)
        for k in (0, 1):  # a register started with ones is one started with zeros whose first 32 bits are flipped
            data[ends - lengths + k] ^= np.uint16(0xFFFF)
        lanes = -(-lengths // _LANE)
        stop = np.cumsum(lanes)
        padded = np.zeros(int(stop[-1]) * _LANE, np.uint16)
        shift = stop * _LANE - ends
        padded[np.arange(len(data)) + np.repeat(shift, lengths)] = data
        grid = np.ascontiguousarray(padded.reshape(-1, _LANE).T).astype(np.uint32)
        reg = np.zeros(grid.shape[1], np.uint32)
        for row in grid:
            reg = self._feed(reg, row)
        out = np.zeros(len(lengths), np.uint32)
        longest_first = np.argsort(-lanes, kind="stable")
        start, count = (stop - lanes)[longest_first], lanes[longest_first]
        alive = len(count)
        for i in range(int(count[0])):
            while count[alive - 1] <= i:
                alive -= 1
            who = longest_first[:alive]
            r = out[who]
            out[who] = self.low[r & 0xFFFF] ^ self.high[r >> np.uint32(16)] ^ reg[start[:alive] + i]
        return out ^ np.uint32(0xFFFFFFFF)

    @staticmethod
    def masked(crc: np.ndarray) -> np.ndarray:
        crc = crc.astype(np.uint32)
        return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(_MASK_ADD)


_CRC: list[Crc32c] = []


def _crc() -> Crc32c:
    if not _CRC:
        _CRC.append(Crc32c())
    return _CRC[0]


# --- tokenizing -------------------------------------------------------------------------------------------------------


class Encoder:
    """Ids of texts with the end id behind; the library sees each distinct white-space piece once, where its setup lets pieces stand for texts.

    Pieces live as long as the Python worker, so its next tasks find them: ids of all pieces in one array, and where each
    begins.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = _width(self.tokenizer.get_vocab_size(), end_id)
        self.end_id = end_id
        self.letters = letters_alone(self.tokenizer)
        self.apart = self.letters or pieces_apart(self.tokenizer)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts = np.array([self.end_id], self.kind), np.array([0, 1])  # piece 0 is the end

    def _learn(self, pieces: list[str]) -> None:
        if len(self.known) > _CACHE:
            self.forget()
        new = [p for p in pieces if p not in self.known]
        short = [p for p in new if p.isascii() and p.isalpha()] if self.letters else []
        rest = [p for p in new if not (p.isascii() and p.isalpha())] if self.letters else new
        new, found, lengths = short + rest, [self.ids], []
        tokenize = self.tokenizer.model.tokenize
        for at in range(0, len(short), 10_000):
            lists = [[t.id for t in tokenize(p.lower())] for p in short[at : at + 10_000]]
            lengths += map(len, lists)
            found.append(np.fromiter(chain.from_iterable(lists), self.kind))
        for at in range(0, len(rest), 10_000):
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(rest[at : at + 10_000], add_special_tokens=False)]
            lengths += map(len, lists)
            found.append(np.fromiter(chain.from_iterable(lists), self.kind))
        if new:
            self.known.update(zip(new, range(len(self.starts) - 1, len(self.starts) - 1 + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
            self.ids = np.concatenate(found)

    def _whole(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 1000):
            for e in self.tokenizer.encode_batch_fast(texts[at : at + 1000], add_special_tokens=False):
                out.append(np.array([*e.ids, self.end_id], self.kind).tobytes())
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        if not self.apart:
            return self._whole(texts.fill_null("").to_pylist())
        numbers, words, lengths = split(texts, lower=False)
        words = words.to_pylist()
        self._learn(words)
        piece = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[numbers]
        ends = np.cumsum(lengths + 1) - 1  # where each text's end stands among all pieces
        pieces = np.zeros(int(ends[-1]) + 1, np.int64)
        inner = np.ones(len(pieces), bool)
        inner[ends] = False
        pieces[inner] = piece
        first, size = self.starts[pieces], np.diff(self.starts)[pieces]
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(first - (upto - size), size) + np.arange(upto[-1])]
        cuts = np.concatenate([[0], upto[ends]])
        data, item = ids.tobytes(), self.kind.itemsize
        return [data[a * item : b * item] for a, b in pairwise(cuts.tolist())]


def letters_alone(tokenizer) -> bool:
    """Whether a piece of ASCII letters reaches the tokenizer's model as it is, but for lower case.

    So it is where the steps before the model are composition, white space, lower case, a split that keeps runs of
    letters whole, and bytes as characters; such pieces go to the library's model without the steps before it.
    """
    setup = json.loads(tokenizer.to_str())
    before, cut = setup["normalizer"] or {}, setup["pre_tokenizer"] or {}
    kinds = [n["type"] for n in before.get("normalizers", [])]
    first, *others = cut.get("pretokenizers") or [{}]
    return (
        kinds == ["NFC", "Replace", "Lowercase"]
        and before["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
        and first.get("type") == "Split"
        and first["pattern"] == {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
        and (first["behavior"], first["invert"]) == ("Removed", True)
        and [(o["type"], o["add_prefix_space"], o["use_regex"]) for o in others] == [("ByteLevel", False, False)]
        and setup["post_processor"] is None
        and not any(t["content"].isalpha() for t in setup["added_tokens"])
    )


def pieces_apart(tokenizer) -> bool:
    """Whether the ids of a text are those of its white-space pieces one after the other.

    So it is where white space only separates: the first split drops it, and what comes before works on single characters.
    Tokenizers that keep blanks in their tokens are given whole texts.
    """
    setup = json.loads(tokenizer.to_str())
    before, cut = setup["normalizer"], setup["pre_tokenizer"] or {}
    steps = [] if before is None else before.get("normalizers", [before])
    plain = all(n["type"] in ("NFC", "NFD", "Lowercase", "StripAccents", "BertNormalizer") for n in steps)
    first = (cut.get("pretokenizers") or [cut])[0]
    drops = first.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")
    return plain and drops and setup["post_processor"] is None and not any(any(c.isspace() for c in t["content"]) for t in setup["added_tokens"])


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def _width(vocabulary: int, end_id: int) -> np.dtype:
    return np.dtype("<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4")


# --- writing ----------------------------------------------------------------------------------------------------------


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder's URI; plain paths and file: URIs are mounted folders."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), parts.path
    return pafs.FileSystem.from_uri(uri)


def _frame(doc_ids: list[int | None], payloads: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Framed records and their lengths."""
    heads = [np.uint16(d is None).tobytes() + np.int64(d or 0).tobytes() for d in doc_ids]
    bodies = [h + p for h, p in zip(heads, payloads, strict=True)]
    sizes = np.array([len(b) for b in bodies], np.int64)
    crc = _crc()
    data = Crc32c.masked(crc.many(np.frombuffer(b"".join(bodies), "<u2"), sizes // 2))
    lengths = sizes.astype("<u8")
    head = Crc32c.masked(crc.many(lengths.view("<u2"), np.full(len(sizes), 4)))
    framed = [n.tobytes() + h.tobytes() + b + c.tobytes() for n, h, b, c in zip(lengths, head, bodies, data, strict=True)]
    return framed, sizes


def _publish(fs: pafs.FileSystem, temporary: str, target: str) -> None:
    if fs.get_file_info(target).type != pafs.FileType.NotFound:  # an earlier attempt's, with the same bytes
        fs.delete_file(target)
    fs.move(temporary, target)


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Tokenize a partition and write its records, in their order, to files of bounded size; yields the index."""
    fs, root = _open(folder)
    tokens = encoder(path, end_id)
    part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
    number, offset, before, out, name, temporary = 0, 0, 0, None, "", ""
    for batch in (piece for whole in batches for piece in slices(whole, 1)):
        ids = batch.column(0).to_pylist()
        framed, sizes = _frame(ids, tokens.encode(batch.column(1)))
        rows = []
        for doc, record, size in zip(ids, framed, sizes.tolist(), strict=True):
            if out is None or offset + len(record) > file_bytes:
                if out is not None:
                    out.close()
                    _publish(fs, temporary, f"{root}/{name}")
                name, offset = f"part-{part:06d}-{number:04d}.rec", 0
                temporary, number = f"{root}/.{name}.{attempt}", number + 1
                out = fs.open_output_stream(temporary)
            out.write(record)
            n = (size - 10) // tokens.kind.itemsize
            rows.append((part, name, offset, len(record), doc, n, before))
            before, offset = before + n, offset + len(record)
        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _INDEX.types, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, schema=_INDEX)
    if out is not None:
        out.close()
        _publish(fs, temporary, f"{root}/{name}")


_INDEX = pa.schema(
    [("part", pa.int32()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64())]
)
_INDEX_SQL = "part int, file string, offset long, length long, doc_id long, n_tokens long, before long"


def write_records(
    docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_BYTES
) -> tuple[str, DataFrame]:
    """Write the corpus; returns the folder and the index, whose ``start`` counts the ids of all documents before."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "records")
    fs, root = _open(folder)
    fs.create_dir(root)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tie"))
    ordered = rows.repartitionByRange(n, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    index = durable(ordered.mapInArrow(lambda it: _write(it, folder, tokenizer_path, end_id, file_bytes), _INDEX_SQL))
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = totals.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return folder, index.join(starts, "part").withColumn("start", F.col("_start") + F.col("before")).drop("_start", "before")


# --- reading ----------------------------------------------------------------------------------------------------------


def _decode(batches: Iterator[pa.RecordBatch], folder: str, item: int) -> Iterator[pa.RecordBatch]:
    fs, root = _open(folder)
    handles: dict[str, pa.NativeFile] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            place = batch.slice(at, 1000).to_pydict()
            raw = []
            for name, offset, length in zip(place["file"], place["offset"], place["length"], strict=True):
                if name not in handles:
                    if len(handles) >= 64:
                        handles.pop(next(iter(handles))).close()
                    handles[name] = fs.open_input_file(f"{root}/{name}")
                raw.append(handles[name].read_at(length, offset))
            _check(raw)
            docs = [None if r[12:14] != b"\0\0" else int.from_bytes(r[14:22], "little", signed=True) for r in raw]
            ids = [np.frombuffer(r[22:-4], f"<u{item}").astype("<u4").tobytes() for r in raw]
            columns = [pa.array(docs, pa.int64()), pa.array(place["start"], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "ids"])
    for f in handles.values():
        f.close()


def _check(records: list[bytes]) -> None:
    """Both checksums of every record, and the length against the bytes there are."""
    if not records:
        return
    sizes = np.array([len(r) - 16 for r in records], np.int64)
    crc = _crc()
    lengths = np.frombuffer(b"".join(r[:8] for r in records), "<u8")
    head = np.frombuffer(b"".join(r[8:12] for r in records), "<u4")
    data = np.frombuffer(b"".join(r[-4:] for r in records), "<u4")
    good = (lengths == sizes) & (Crc32c.masked(crc.many(lengths.view("<u2"), np.full(len(sizes), 4))) == head)
    good &= Crc32c.masked(crc.many(np.frombuffer(b"".join(r[12:-4] for r in records), "<u2"), sizes // 2)) == data
    if not good.all():
        raise ValueError(f"{int((~good).sum())} damaged records")


def read_records(index: DataFrame, folder: str, item: int) -> DataFrame:
    """``doc_id, start, ids`` (little-endian 32-bit ids) of the index rows given, checked."""
    return index.mapInArrow(lambda it: _decode(it, folder, item), "doc_id long, start long, ids binary")


def digests(records: DataFrame) -> DataFrame:
    return records.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` and return the digests of what the files hold."""
    from tokenizers import Tokenizer

    folder, index = write_records(docs, tokenizer_path, end_id=end_id)
    item = _width(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id).itemsize
    return digests(read_records(index, folder, item))


def default_tokenizer() -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path("word_bpe_49k.json"))

