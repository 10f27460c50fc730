"""Token-id output: whole texts as token ids, zstandard-compressed one by one.

One dictionary, trained on serialised id arrays of a bounded sample, serves all
documents. A store is a folder of two Parquet tables, readable on any Hadoop
file system:

* ``dictionary``: one row with the dictionary, its SHA-256, the id width in
  bytes, and the end id.
* ``data``: blocks of consecutive documents in ascending ``doc_id`` order. Each
  has the documents' ids, numbers of tokens and frame ends (the offset index),
  one payload of frames, the dictionary's hash, the part, and the number of
  tokens that stand before it in its part.

To read one document, filter ``data`` by first_id/last_id (row group statistics
prune the rest) and decompress the one frame that the index names.

Edge cases: a null or empty text is a document with the end id alone; null
``doc_id`` sorts first; rows of equal ``doc_id`` are kept, ordered by a hash of the text (so they
may spread over parts) and the text; ids that do not fit the width are an error;
an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .text import PAD, SPACE, buffers, hashes, pieces, returned, strings, unique

DATA = "part int, block int, first_id long, last_id long, before long, doc_ids array<long>, n_tokens array<int>, ends array<long>, dict_hash string, payload binary"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
KNOWN_UNITS, SAMPLE_TEXT = 1_500_000, 1 << 16
#: What a worker holds at a time besides known units: so many bytes of whole texts (a longer text comes alone), of whose new units so many reach the tokenizer at once.
ENCODED, LEARNED = 2 << 20, 1 << 15


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Exact ids of whole texts, encoding each distinct unit (word with the space before it) once.

    The byte-level pre-tokenizer never joins a character with white space that follows it, so a
    text may be cut at a single space or newline between two others that are not white space.
    Texts with other Unicode white space, or with the string of an added token (such as an end mark,
    which gets that token's id), go to the tokenizer as a whole. At most KNOWN_UNITS
    units are remembered, by two 64-bit hashes.
    """

    def __init__(self, path: str) -> None:
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = "1", "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.newline = self.plain(["\n"])[0]
        self.forget()

    def forget(self) -> None:
        """Units in the order met have checks and ids[at[k] : at[k + 1]]; ``keys`` are sorted, ``place`` says which unit each is."""
        self.keys, self.place = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.checks, self.at = np.empty(0, np.uint64), np.zeros(1, np.int64)
        self.ids = np.empty(0, np.uint32)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cuts, and the rows that must not be cut."""
        n = int(off[-1])
        b = data[:n]
        blank = SPACE[b]
        lead = np.flatnonzero((b == 0xC2) | (b == 0xE1) | (b == 0xE2) | (b == 0xE3))
        second, third = data[lead + 1], data[lead + 2]
        wide = (
            ((b[lead] == 0xC2) & ((second == 0x85) | (second == 0xA0)))
            | ((b[lead] == 0xE1) & (second == 0x9A) & (third == 0x80))
            | ((b[lead] == 0xE2) & (second == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF)))
            | ((b[lead] == 0xE2) & (second == 0x81) & (third == 0x9F))
            | ((b[lead] == 0xE3) & (second == 0x80) & (third == 0x80))
        )
        odd = np.concatenate([lead[wide], np.flatnonzero((b >= 0x1C) & (b <= 0x1F)), self.places(b)])
        whole = np.zeros(len(off) - 1, bool)
        whole[np.searchsorted(off, odd, "right") - 1] = True
        cut = np.flatnonzero(((b == 32) | (b == 10))[1:-1] & ~blank[:-2] & ~blank[2:]) + 1 if n > 2 else np.empty(0, np.int64)
        row = np.searchsorted(off, cut, "right") - 1
        inside = (cut > off[row]) & (cut + 1 < off[row + 1]) & ~whole[row]
        cut = cut[inside]
        mark = np.zeros(n + 2, bool)
        mark[cut] = True
        mark[cut[b[cut] == 10] + 1] = True
        mark[off[:-1][off[:-1] < off[1:]]] = True
        mark[n:] = False
        return np.flatnonzero(mark), whole

    def places(self, b: np.ndarray) -> np.ndarray:
        """Where strings of added tokens start."""
        raw, found = b.tobytes(), []
        for content in (t.encode() for t in self.added):
            at = raw.find(content)
            while at >= 0:
                found.append(at)
                at = raw.find(content, at + 1)
        return np.array(found, np.int64)

    def learn(self, keys: np.ndarray, checks: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Adds units. The tokenizer and Python hold a unit in many times its bytes, so LEARNED units are encoded at a time."""
        gaps = np.concatenate([[0], np.cumsum(SPACE[data[:-PAD]], dtype=np.int32)])
        ids, sizes = [self.ids], []
        for k in range(0, len(keys), LEARNED):
            own, size = self.units_ids(data, gaps, starts[k : k + LEARNED], lengths[k : k + LEARNED])
            ids.append(own)
            sizes.append(size)
        self.ids = np.concatenate(ids)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(sizes))])
        at = np.searchsorted(self.keys, keys)
        self.place = np.insert(self.place, at, np.arange(len(self.checks), len(self.checks) + len(keys), dtype=np.int32))
        self.keys, self.checks = np.insert(self.keys, at, keys), np.concatenate([self.checks, checks])

    def units_ids(self, data: np.ndarray, gaps: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, number of each) from the tokenizer; ``gaps``: white space before each byte."""
        texts = strings(data, starts, lengths).to_pylist()
        inner = gaps[starts + lengths] - gaps[starts + (data[starts] == 32)]
        alone = np.array([not any(t in text for t in self.added) for text in texts], bool)
        joined = np.flatnonzero(alone & (inner == 0) & (lengths > (data[starts] == 32)))
        found: list[np.ndarray | None] = [None] * len(texts)
        if len(joined):
            lines = ["\n".join(texts[i] for i in joined[k : k + 400]) for k in range(0, len(joined), 400)]
            for k, ids in enumerate(self.plain(lines)):
                for i, part in zip(joined[k * 400 : (k + 1) * 400], np.split(ids, np.flatnonzero(ids == self.newline[0])), strict=True):
                    found[i] = part
            first = set(joined[::400].tolist())
            for i in joined.tolist():
                if i not in first:
                    found[i] = found[i][1:]
        if rest := [i for i, x in enumerate(found) if x is None]:
            for i, ids in zip(rest, self.plain([texts[i] for i in rest]), strict=True):
                found[i] = ids
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of all rows, without end ids."""
        done = [self.encode_piece(p.column(0)) for p in pieces(iter([pa.RecordBatch.from_arrays([column], ["text"])]), limit=ENCODED)]
        off = np.concatenate([np.zeros(1, np.int64), *(np.diff(off) for _, off in done)])
        return np.concatenate([np.empty(0, np.uint32), *(ids for ids, _ in done)]), np.cumsum(off)

    def encode_piece(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, off = buffers(column)
        if not off[-1]:
            return np.empty(0, np.uint32), np.zeros(len(off), np.int64)
        starts, _ = self.units(data, off)
        lengths = np.diff(np.append(starts, off[-1]))
        keys, first, inverse = unique(hashes(data, starts, lengths))
        checks = hashes(data, starts[first], lengths[first], 1)
        if len(self.keys) + len(keys) > KNOWN_UNITS:
            self.forget()
        at = self.find(keys)
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            self.learn(keys[new], checks[new], data, starts[first[new]], lengths[first[new]])
            at = self.find(keys)
        unit = self.place[at]
        assert (self.checks[unit] == checks).all(), "two units share a hash"
        where, size = self.at[unit][inverse], (self.at[unit + 1] - self.at[unit])[inverse]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(where - (ends - size), size) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[np.searchsorted(starts, off)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, off: np.ndarray, end_id: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the end id after each row, as the serialised type; an id that does not fit it is an error."""
    if max(int(ids.max(initial=0)), end_id) >= 1 << (8 * width):
        raise ValueError(f"an id does not fit {width} bytes")
    out_off = off + np.arange(len(off))
    out = np.empty(out_off[-1], f"<u{width}")
    keep = np.ones(len(out), bool)
    keep[out_off[1:] - 1] = False
    out[keep], out[out_off[1:] - 1] = ids, end_id
    return out, out_off


def train_dictionary(docs: DataFrame, path: str, end_id: int, width: int, sample: int, size: int) -> bytes:
    """A zstandard dictionary from the id arrays of about ``sample`` documents (twice as many at most), chosen by a hash of their rows; texts over SAMPLE_TEXT bytes don't train it."""
    n = docs.count()
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("dictionary")), F.lit(1 << 20))
    picked = docs.where((draw < F.lit(int((1 << 20) * min(1.0, sample / max(n, 1))) or 1)) & (F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_TEXT))
    picked = picked.orderBy(draw, "doc_id").limit(2 * sample)

    def serialised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            ids, off = with_end(*encoder(path).encode(piece["text"]), end_id, width)
            yield pa.RecordBatch.from_pydict({"ids": pa.array([ids[a:b].tobytes() for a, b in zip(off, off[1:], strict=False)], pa.binary())})

    arrays = [r.ids for r in picked.mapInArrow(serialised, "ids binary").collect()]
    arrays.sort()
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except zstandard.ZstdError:  # too few samples: their plain content serves as the dictionary
        return b"".join(arrays)[-size:]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, width: int = 2, sample: int = 1500, dict_bytes: int = 64 << 10, block_docs: int = 256, docs_per_part: int = 4000) -> None:
    """Writes ``docs`` (doc_id, text) as a store at ``path``.

    ``sample`` bounds the documents (in expectation) that train the dictionary and ``dict_bytes`` its size.
    ``width`` 2 holds ids under 65,536. Texts are shuffled once, by range of doc_id and the text's hash.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = train_dictionary(docs, tokenizer, end_id, width, sample, dict_bytes)
    digest = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(digest, bytearray(raw), width, end_id)], "dict_hash string, dictionary binary, width int, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // docs_per_part))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        for piece in pieces(returned(batches)):
            ids, off = with_end(*encoder(tokenizer).encode(piece["text"]), end_id, width)
            doc_ids = piece["doc_id"]
            for a in range(0, len(doc_ids), block_docs):
                b = min(a + block_docs, len(doc_ids))
                frames = [packer.compress(ids[off[k] : off[k + 1]].tobytes()) for k in range(a, b)]
                own = doc_ids.slice(a, b - a).to_pylist()
                row = {"part": part, "block": block, "first_id": own[0], "last_id": own[-1], "before": before, "doc_ids": own, "n_tokens": np.diff(off[a : b + 1]), "ends": np.cumsum([len(x) for x in frames]), "dict_hash": digest, "payload": b"".join(frames)}
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.int32()) if k == "n_tokens" else pa.list_(pa.int64()) if k in ("doc_ids", "ends") else pa.int32() if k in ("part", "block") else None if isinstance(v, (str, bytes)) else pa.int64()) for k, v in row.items()], list(row))
                block, before = block + 1, before + int(off[b] - off[a])

    tie = F.xxhash64("text")
    ordered = docs.withColumn("tie", tie).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    ordered.mapInArrow(blocks, DATA).write.option("compression", "none").parquet(f"{path}/data")


def read_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes, int, int]:
    r = spark.read.parquet(f"{path}/dictionary").head()
    if hashlib.sha256(r.dictionary).hexdigest() != r.dict_hash:
        raise ValueError("the dictionary does not match its hash")
    return r.dict_hash, bytes(r.dictionary), r.width, r.end_id


def unpack(raw: bytes, width: int, payload: bytes, ends: list[int]) -> Iterator[np.ndarray]:
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    for a, b in zip([0, *ends], ends, strict=False):
        yield np.frombuffer(opener.decompress(payload[a:b]), f"<u{width}")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the store's files."""
    digest, raw, width, _ = read_dictionary(spark, path)
    data = spark.read.schema(DATA).parquet(f"{path}/data")
    totals = data.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    # One number a part, of which there are as many as write tasks.
    base = dict(zip([r.part for r in totals], np.concatenate([[0], np.cumsum([r.n for r in totals])]).astype(np.int64).tolist(), strict=False))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["dict_hash"] != digest:
                    raise ValueError("a block was written with another dictionary")
                at, rows = base[r["part"]] + r["before"], []
                for doc_id, ids in zip(r["doc_ids"], unpack(raw, width, r["payload"], r["ends"]), strict=True):
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return data.mapInArrow(decoded, ROWS)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents with this doc_id: one block's index and frame are read, not the rest."""
    digest, raw, width, _ = read_dictionary(spark, path)
    found = []
    for r in spark.read.schema(DATA).parquet(f"{path}/data").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("part", "block").toLocalIterator():
        if r.dict_hash != digest:
            raise ValueError("a block was written with another dictionary")
        for k, own in enumerate(r.doc_ids):
            if own == doc_id:
                a, b = ([0, *r.ends])[k], r.ends[k]
                found += unpack(raw, width, bytes(r.payload)[a:b], [b - a])
    return found


def token_ids(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes a store to the shared folder and reads it back."""
    path = store.new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer or byte_bpe_path())
    return read_tokens(docs.sparkSession, path)
