"""Binary token records: the framing, exact round trips, order."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from quoteloom.llm import records
from quoteloom.llm.queries import QUERIES

PATH = records.default_tokenizer()


def plain_crc32c(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksum_is_crc32c():
    assert plain_crc32c(b"123456789") == 0xE3069283  # the published check value
    rng = np.random.default_rng(1)
    lengths = np.array([2, 3, 4, 63, 64, 65, 128, 129, 500, 2])
    words = rng.integers(0, 1 << 16, lengths.sum()).astype("<u2")
    got = records.Crc32c().many(words, lengths)
    ends = np.cumsum(lengths)
    assert got.tolist() == [plain_crc32c(words[e - n : e].tobytes()) for e, n in zip(ends, lengths, strict=True)]
    assert records.Crc32c.masked(np.array([0xE3069283], np.uint32))[0] == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) % 2**32


def expected(rows):
    """Digests of (doc_id, text) rows by the library on whole texts."""
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_whole_texts(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = QUERIES["op2_binary_token_records"](spark, sf).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected(rows)


ROWS = [
    (3, "one two"), (1, None), (2, ""), (5, "a\x1cb \x0b c d é ́x ΟΔΟΣ İstanbul <|endoftext|>don't"), (4, "x" * 5000 + " y" * 30000), (9, " \n\t "),
    (-7, "日本語 text 123 \U0001f600"), (6, "same"), (6, "same"),
]


def test_edge_cases_and_small_files(spark, tmp_path):
    docs = spark.createDataFrame([(*r, "f", 1) for r in ROWS], "doc_id long, text string, file string, start int")
    folder, index = records.write_records(docs, PATH, f"file://{tmp_path}/out", file_bytes=200)
    got = records.digests(records.read_records(index, folder, 2)).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(sorted(ROWS, key=lambda r: r[0]))
    places = index.orderBy("part", "file", "offset").collect()
    assert [r.doc_id for r in places] == sorted(r[0] for r in ROWS)
    assert len({r.file for r in places}) > 3
    one = index.filter("doc_id = 5").select("file", "offset", "length", "start")  # any rows of the index, alone
    assert records.read_records(one, folder, 2).count() == 1


def test_letters_take_the_short_way_to_the_same_ids():
    tokenizer = Tokenizer.from_file(PATH)
    assert records.letters_alone(tokenizer)
    words = ["a", "I", "THE", "Thntblereof", "x" * 300, "onthshansh", "zq", "s", "ll"]
    short = [[t.id for t in tokenizer.model.tokenize(w.lower())] for w in words]
    assert short == [tokenizer.encode(w, add_special_tokens=False).ids for w in words]


def test_null_ids_come_first(spark):
    docs = spark.createDataFrame([(2, "b"), (None, "a"), (None, None)], "doc_id long, text string")
    got = records.round_trip(spark, docs, PATH).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 2]
    assert sorted(r.n_tokens for r in got[:2]) == [1, 2]


def test_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    folder, index = records.write_records(docs, PATH, str(tmp_path / "out"))
    place = index.first()
    with open(f"{folder}/{place.file}", "r+b") as f:
        f.seek(20)
        byte = f.read(1)
        f.seek(20)
        f.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="damaged"):
        records.read_records(index, folder, 2).collect()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert records.round_trip(spark, docs, PATH).count() == 0
    assert F is not None


def byte_level(path):
    """A fixed small vocabulary whose tokens hold blanks."""
    vocab = {c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}
    merges = [("t", "h"), ("Ġ", "c"), ("th", "e"), ("Ġ", "Ġ")]
    vocab |= {a + b: len(vocab) + i for i, (a, b) in enumerate(merges)}
    made = Tokenizer(models.BPE(vocab=vocab, merges=merges))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    made.save(path)
    return made


def separated(path):
    made = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    made.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    made.save(path)
    return made


@pytest.mark.parametrize(("make", "apart"), [(byte_level, False), (separated, True)])
def test_other_tokenizers_give_the_ids_of_whole_texts(tmp_path, make, apart):
    path = str(tmp_path / "tokenizer.json")
    made, coder = make(path), records.Encoder(path, 2)
    assert coder.apart == apart and records.Encoder(PATH, 2).apart
    texts = ["the cat  sat", "", None, " a b ", "b\n\na c", "thé  cät"]
    got = [np.frombuffer(x, coder.kind).tolist() for x in coder.encode(pa.array(texts))]
    assert got == [[*made.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
