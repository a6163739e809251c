import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from genoloom.llm import scratch, tokenfiles
from genoloom.llm.queries import BYTE_VOCABULARY

ODD = [None, "", " ", "  ", "\n", "a  b", "a \n b", "x\n\n y", "\t\tz ", " 　 w", "it's I'LL 've'd", "\x1c a\x85b \xa0 c", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "\0 a\0 b", "naïve Ünï ½ ² ١٢ 漢字 ก็ 👍🏽", "a1b2 3c", "é é", "﻿x", "ⅷ 〇 ʰ ª", "x " * 3000]


def library():
    found = Tokenizer.from_file(BYTE_VOCABULARY)
    found.no_truncation()
    found.no_padding()
    return found


def test_encoder_against_the_library():
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "'s", "'", "12", "é", "ж", "漢", "½", ".", ",", "!?", "\r\n", "\x1c", "\xa0", "　", "<|endoftext|>", "👍", "\x85", "́"]
    texts = [x or "" for x in ODD] + ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(3000)] + ["".join(chr(rng.randrange(1, 0x2FFF)) + " " * rng.randrange(2) for _ in range(20)) for _ in range(500)]
    want = [x.ids for x in library().encode_batch_fast(texts, add_special_tokens=False)]
    own = tokenfiles.ByteEncoder(BYTE_VOCABULARY, 500)
    for a in range(0, len(texts), 100):
        for text, ids, w in zip(texts[a : a + 100], own.rows(texts[a : a + 100]), want[a : a + 100], strict=True):
            assert ids.tolist() == w, repr(text)


class Memory(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def close(self):
        pass


def written(documents, frame_ids):
    out = Memory()
    writer = tokenfiles.Writer(out, pa.int64(), frame_ids)
    for i, ids in enumerate(documents):
        writer.add(i, np.array(ids, "<u4"))
    writer.close()
    return out, writer


@pytest.mark.parametrize("frame_ids", [1, 7, 64, 10_000])
def test_file_round_trip(frame_ids):
    rng = random.Random(frame_ids)
    documents = [[rng.randrange(1 << 32) for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 500]))] for _ in range(60)]
    out, writer = written(documents, frame_ids)
    reader = tokenfiles.Reader(out)
    assert writer.bytes == out.size() and reader.keys.to_pylist() == list(range(60))
    for i in random.Random(2).sample(range(60), 60):
        assert reader.ids(i).tolist() == documents[i]
        assert reader.checksum(i) == zlib.crc32(np.array(documents[i], "<u4").tobytes())
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert np.frombuffer(plain, "<u4").tolist() == [x for d in documents for x in d]


def test_only_wanted_frames_are_opened():
    out, _ = written([[i] * 100 for i in range(100)], 100)
    reader = tokenfiles.Reader(out)
    assert reader.ids(70).tolist() == [70] * 100 and reader.opened == 1
    assert len(reader.data) == 100


def test_damage_is_noticed():
    out, _ = written([[1, 2, 3], [4] * 50], 16)
    data = out.getvalue()
    for place, what in ((5, "frame"), (len(data) - 1, "table")):
        spoilt = Memory(data[:place] + bytes([data[place] ^ 0x55]) + data[place + 1 :])
        with pytest.raises((ValueError, zstandard.ZstdError)):
            tokenfiles.Reader(spoilt).ids(0)
    body = bytearray(data)
    entry = len(data) - tokenfiles.CLOSING.size - tokenfiles.ENTRY.size * len(tokenfiles.Reader(out).table) + 8
    body[entry] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        tokenfiles.Reader(Memory(bytes(body))).ids(0)
    with pytest.raises(ValueError, match="seek table"):
        tokenfiles.Reader(Memory(b"x" * 40))


def expected(rows):
    """Rows in the order of the files: nulls first; the texts of equal keys in any order are told apart by their ids."""
    own, at, out = library(), 0, []
    for key, text in rows:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_round_trip_of_odd_rows(spark):
    rows = [(i * 3 - 7, x) for i, x in enumerate(ODD)]
    mixed = random.Random(3).sample(rows, len(rows))
    df = spark.createDataFrame([(k, x, "c", 1) for k, x in mixed], "doc_id long, text string, start string, N_TOKENS int")
    got = sorted(map(tuple, tokenfiles.round_trip(df, BYTE_VOCABULARY).collect()))
    assert got == expected(rows)
    assert tokenfiles.round_trip(df.filter("false"), BYTE_VOCABULARY).count() == 0


def test_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(None, "a b"), (5, "c"), (5, "c"), (5, "d e f"), (None, None), (1, "x")], "doc_id long, text string")
    got = sorted(tokenfiles.round_trip(df, BYTE_VOCABULARY).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 5, 5, 5]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sum(r.doc_id == 5 and r.n_tokens == 2 for r in got) == 2


def test_many_files_string_keys_and_wanted_documents(spark):
    texts = {f"k{i:03d}": " ".join(f"w{i * j % 97}" for j in range(i % 40)) for i in range(200)}
    df = spark.createDataFrame(list(texts.items()), "name string, body string")
    own = scratch.Scratch(spark, "tokens-test")
    manifest = own.keep(tokenfiles.write(df, own.path("files"), BYTE_VOCABULARY, frame_ids=50, shard_ids=400, key="name", text="body"), "manifest")
    assert manifest.count() > 5 and manifest.agg({"documents": "sum"}).first()[0] == 200
    got = tokenfiles.read(manifest, own.path("files"), "string", with_ids=True, key="name").collect()
    assert [r.name for r in sorted(got, key=lambda r: r.start)] == sorted(texts)
    ids = {k: [*library().encode(x, add_special_tokens=False).ids, 2] for k, x in texts.items()}
    assert all(r.ids == ids[r.name] for r in got)
    wanted = spark.createDataFrame([("k007",), ("k150",), ("none",), (None,), ("k007",)], "name string")
    found = tokenfiles.read_documents(manifest, wanted, own.path("files"), "string", key="name").collect()
    assert sorted((r.name, r.ids) for r in found) == [("k007", ids["k007"]), ("k150", ids["k150"])]
