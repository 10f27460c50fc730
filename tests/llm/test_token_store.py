import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tremorframe.llm import store, token_store as ts

TEXTS = [
    None, "", " ", "\n", "a", "Hello, world!\nIt's  double  spaced\n\nand\ttabbed \n", "trailing ", " leading", "x" * 3000,
    "café naïve nbsp  em", "日本語　text", "<|endoftext|> is an added token", "a <|endoftext|> b", " <|endoftext|>", "x\n<|endoftext|>y  <|endoftext|>", "<|endoftext", "one two three one two three", "1 2 33 444's", "\r\n a \x0b b \x1c c",
]


def plain(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoder_equals_tokenizer():
    enc, path = ts.Encoder(ts.byte_bpe_path()), ts.byte_bpe_path()
    for _ in range(2):
        ids, off = enc.encode(pa.array(TEXTS, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == plain(path, TEXTS)


def test_pieces_of_a_column_change_nothing(monkeypatch):
    monkeypatch.setattr(ts, "ENCODED", 40)
    monkeypatch.setattr(ts, "LEARNED", 3)
    monkeypatch.setattr(ts, "KNOWN_UNITS", 60)
    path = ts.byte_bpe_path()
    enc = ts.Encoder(path)
    for texts in (TEXTS, TEXTS[::-1], [], [None, ""]):
        ids, off = enc.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == plain(path, texts)


def test_new_units_are_encoded_a_few_at_a_time():
    """What the encoder holds besides its known units is bounded, however many units of a column are new."""
    enc, column = ts.Encoder(ts.byte_bpe_path()), pa.array([" ".join(f"w{i * 1000 + k}x" for k in range(1000)) for i in range(400)])
    tracemalloc.start()
    enc.encode(column)
    peak, known = tracemalloc.get_traced_memory()[1], sum(x.nbytes for x in (enc.keys, enc.place, enc.checks, enc.at, enc.ids))
    tracemalloc.stop()
    assert len(enc.checks) > 390_000 and peak - known < 70e6


def test_round_trip(spark):
    rows = [(7 * i % 31 if i % 6 else None, t, "x") for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    path = store.new_path(spark, "t")
    ts.write_tokens(docs, path, ts.byte_bpe_path(), docs_per_part=5, block_docs=4)
    got = [tuple(r) for r in ts.read_tokens(spark, path).collect()]
    want, start = [], 0
    tie = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))
    for (d, _, _), ids in zip(rows, plain(ts.byte_bpe_path(), [r[1] for r in rows])):
        ids = np.array([*ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    one = rows[-1][0]
    assert sorted(x.tolist() for x in ts.read_document(spark, path, one)) == sorted([*i, 2] for r, i in zip(rows, plain(ts.byte_bpe_path(), [r[1] for r in rows])) if r[0] == one)


def test_ids_must_fit_the_width():
    with pytest.raises(ValueError):
        ts.with_end(np.array([70_000], np.uint32), np.array([0, 1]), 2, 2)


def test_empty(spark):
    assert ts.token_ids(spark.createDataFrame([], "doc_id long, text string")).collect() == []
