"""Language-model scoring with a hidden Markov model over words, trained by Baum-Welch on the whole corpus.

Tokens are lower-cased (A-Z) words and one end per text. Every training token has an emission
of its own in every state: with C_s(w) its expected count in state s, C_s their sum, N training
tokens and V distinct ones, ``P(w | s) = (N * C_s(w) / C_s + 1) / (N + V + 1)``. The V tokens and
one unseen token sum to 1; if the states did not differ this would be the add-one base.

Texts are cut into parts of about PART_BYTES. A part holds its texts as numbers into its own
vocabulary. Each Baum-Welch step runs over all parts and adds up, within a part, its words'
expected counts; words are dealt by hash into buckets, as many as the corpus has BUCKET_BYTES, in which the
counts of all parts meet and are summed. Sums go back to the parts that share a word; a word of one part alone stays there.
So the table of states and words grows with the corpus, and neither it nor the vocabulary is ever broadcast or in one task.
Between steps a word's counts by state are kept as its count and 16-bit shares. Words go to the buckets by key once; from then on
only those that parts share, in the order of their keys, by their numbers in the bucket, and sums come back in that order.

Disk holds the parts, and what a step adds: parts and buckets are worked through in up to ROUNDS rounds, each round's shuffle goes
when the round is written, and words go once they are summed.

Steps start from a model fitted on a sample (see ``started``) and run over all texts until one
gains less than TOLERANCE of the log likelihood. The scaled forward recursion then gives each text's exact likelihood.

Words are compared by a 64-bit hash. Long texts are worked through in segments of SEGMENT tokens, so memory
is bounded by a text's own tokens. Edge cases: a null or empty text is an end alone; a null doc_id is in training;
rows of equal doc_id count each; with nothing to learn from, N and V are 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .text import PAD, buffers, hashes, pieces, sums, unique, words

STATES = 6
#: Training ends with the step that gains less than this share of the log likelihood.
TOLERANCE = 2e-3
#: The first model's sample: about so many bytes of training texts, each of SAMPLE_TEXT bytes at most, and so many rows at most.
SAMPLE_BYTES, SAMPLE_TEXT, SAMPLE_ROWS = 2 << 20, 1 << 14, 2048
#: A part ends beyond so many bytes of text (less if the corpus would give the cores under three parts each) or different words; texts are coded
#: in pieces of so many bytes. A bucket serves so many bytes of the corpus.
PART_BYTES, LEAST_BYTES, PIECE_BYTES, PART_WORDS, BUCKET_BYTES = 32 << 20, 2 << 20, 4 << 20, 400_000, 32 << 20
SEGMENT, EIGHTH = 250_000, 8
#: At most so many rounds of parts, or of buckets, one after the other; a round has two parts for each core, or a bucket for two, at least.
ROUNDS = 4
#: Rows of a large array that are copied at a time.
ROWS = 1 << 15
#: Added to expected counts of starts and moves.
PRIOR = 0.1
#: No word holds white space.
END = "\n"
_END = np.full(1 + PAD, 32, np.uint8)
_END[0] = 10
END_KEY = hashes(_END, np.array([0]), np.array([1]))[0]

ROW = {"part": pa.int64(), "seq": pa.int32(), "doc_ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "n": pa.list_(pa.int32()), "bucket": pa.int32(), "data": pa.binary()}
#: Rows of a part: its sums (seq SUMS); by bucket the places of its words in the order of their keys (PLACES), their own counts (COUNTS) and KEYS; from the
#: second step on all words' own counts (OWN) and by bucket those that other parts have too (WORDS); pieces of texts in order (seq 0 and up).
#: Rows of a bucket for a part: which words other parts have (FIXED), and their sums (WORDS).
SPLIT = "part long, seq int, doc_ids array<long>, held array<boolean>, n array<int>, bucket int, data binary"
SUMS, KEYS, PLACES, OWN, COUNTS, FIXED, WORDS = range(-7, 0)
#: Folders of a table of parts: what stays, what one step needs, and what its buckets need.
STAY, STEP, MEET = 0, 1, 2
ANSWER = "part long, seq int, bucket int, data binary, known long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def held_out(doc_id: str = "doc_id"):
    """crc32 of doc_id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


# The model ---------------------------------------------------------------------------------


@dataclass
class Model:
    """Start and move probabilities, each state's sum of expected counts ``mass`` (C_s), and ``n`` (N)."""

    start: np.ndarray
    move: np.ndarray
    mass: np.ndarray
    n: float

    @classmethod
    def of_sums(cls, s: Sums) -> Model:
        start, move = s.start + PRIOR, s.move + PRIOR
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), s.mass, s.mass.sum())

    def emissions(self, g: np.ndarray) -> np.ndarray:
        """Emissions times N + V + 1 (words x states) from expected counts."""
        return g * (self.n / np.maximum(self.mass, 1e-300)) + 1.0


@dataclass
class Sums:
    """What a step adds up besides the words' counts: log likelihood (times (N + V + 1) ^ tokens), starts, moves, state masses."""

    likely: float
    start: np.ndarray
    move: np.ndarray
    mass: np.ndarray

    @classmethod
    def zero(cls) -> Sums:
        return cls(0.0, np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros(STATES))

    def flat(self) -> np.ndarray:
        return np.concatenate([[self.likely], self.start, self.move.ravel(), self.mass])

    @classmethod
    def of(cls, flat: np.ndarray) -> Sums:
        likely, start, move, mass = np.split(flat, np.cumsum([1, STATES, STATES**2]))
        return cls(float(likely[0]), start, move.reshape(STATES, STATES), mass)


class Steps:
    """Sequences dealt by time: first all first tokens, longest sequence first, then all second ones, and so on."""

    def __init__(self, tokens: np.ndarray, n: np.ndarray) -> None:
        self.order = np.argsort(-n, kind="stable")
        n_, begin = n[self.order].astype(np.int64), (np.cumsum(n, dtype=np.int64) - n)[self.order]
        live = np.searchsorted(-n_, -np.arange(1, int(n.max(initial=0)) + 1), "right")
        self.n, self.lo = n_, np.concatenate([[0], np.cumsum(live)]).astype(np.int64)
        self.at: list[int] = self.lo.tolist()
        first = np.cumsum(n_) - n_
        t = np.arange(int(n_.sum())) - np.repeat(first, n_)
        self.rank = np.empty(len(t), np.int32)
        place = self.lo[t] + np.repeat(np.arange(len(n_)), n_)
        self.rank[place] = np.repeat(np.arange(len(n_), dtype=np.int32), n_)
        self.o = np.empty(len(t), tokens.dtype)
        self.o[place] = tokens[np.repeat(begin, n_) + t]

    def segments(self, limit: int = SEGMENT) -> list[tuple[int, int]]:
        """Ranges of time of about ``limit`` tokens."""
        out, t, last = [], 0, len(self.lo) - 1
        while t < last:
            end = min(last, max(t + 1, int(np.searchsorted(self.lo, self.lo[t] + limit, "right")) - 1))
            out.append((t, end))
            t = end
        return out

    def forward(self, model: Model, e: np.ndarray, t0: int, t1: int, f: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(emissions, forward values, scales) of a range of time; ``f``: the values before it.

        Values are scaled to sum 1 at every EIGHTH step: emissions are 1 at least and N + 1 at most, so eight of them fit a double.
        """
        lo, base, one = self.at, self.at[t0], np.ones(STATES)
        b = e[self.o[base : lo[t1]]]
        alpha, scale = np.empty_like(b), np.ones(len(b))
        for t in range(t0, t1):
            a, z = lo[t] - base, lo[t + 1] - base
            x = alpha[a:z]
            if t:
                np.matmul(f[: z - a], model.move, out=x)
                np.multiply(x, b[a:z], out=x)
            else:
                np.multiply(model.start, b[a:z], out=x)
            if t % EIGHTH == EIGHTH - 1:
                np.matmul(x, one, out=scale[a:z])
                x /= scale[a:z, None]
            f = x
        return b, alpha, scale

    def last(self, alpha: np.ndarray, t: int) -> np.ndarray:
        return alpha[len(alpha) - (self.at[t] - self.at[t - 1]) :].copy()

    def logs(self, alpha: np.ndarray, scale: np.ndarray, t0: int, t1: int) -> np.ndarray:
        """What a range of time adds to the natural-log likelihood of each sequence, by rank."""
        out = np.bincount(self.rank[self.at[t0] : self.at[t1]], np.log(scale), len(self.order))
        ends = (self.n > t0) & (self.n <= t1)
        out[ends] += np.log(alpha[self.lo[self.n[ends] - 1] - self.at[t0] + np.flatnonzero(ends)].sum(1))
        return out

    def likelihood(self, model: Model, e: np.ndarray, limit: int = SEGMENT) -> np.ndarray:
        """Natural-log likelihood of each sequence under emissions ``e``."""
        total, f = np.zeros(len(self.order)), None
        for t0, t1 in self.segments(limit):
            _, alpha, scale = self.forward(model, e, t0, t1, f)
            total += self.logs(alpha, scale, t0, t1)
            f = self.last(alpha, t1)
        out = np.empty_like(total)
        out[self.order] = total
        return out

    def count(self, model: Model, e: np.ndarray, sums_: Sums, g: np.ndarray, limit: int = SEGMENT) -> None:
        """Adds the expected counts to ``sums_`` and, by word, to ``g`` (words x states)."""
        spans, lo, back = self.segments(limit), self.at, np.ascontiguousarray(model.move.T)
        before: list[np.ndarray | None] = [None]
        for t0, t1 in spans[:-1]:
            before.append(self.last(self.forward(model, e, t0, t1, before[-1])[1], t1))
        later = None  # emission times backward value by scale of the next step
        for (t0, t1), f in zip(reversed(spans), reversed(before), strict=True):
            base = lo[t0]
            b, alpha, scale = self.forward(model, e, t0, t1, f)
            sums_.likely += float(self.logs(alpha, scale, t0, t1).sum())
            b /= scale[:, None]
            beta = np.ones_like(alpha)
            for t in range(t1 - 1, t0 - 1, -1):
                a, z = lo[t] - base, lo[t + 1] - base
                if later is not None:
                    np.matmul(later, back, out=beta[a : a + len(later)])
                later = b[a:z]
                np.multiply(later, beta[a:z], out=later)
            beta *= alpha  # posteriors, up to a factor that a sequence's steps share
            norm = beta @ np.ones(STATES)
            b /= norm[:, None]
            if t1 > t0 + 1:
                step_ = np.arange(t0, t1 - 1)
                earlier, k = np.repeat(self.lo[step_] - base, np.diff(self.lo)[step_ + 1]) + self.rank[lo[t0 + 1] : lo[t1]], lo[t0 + 1] - base
                for i in range(0, len(earlier), ROWS):
                    some = earlier[i : i + ROWS]
                    sums_.move += model.move * (alpha[some].T @ b[k + i : k + i + len(some)])
            if t0:
                k = lo[t0 + 1] - base
                sums_.move += model.move * (f[:k].T @ b[:k])
            later = later * norm[: len(later), None]
            beta /= norm[:, None]
            if t0 == 0:
                sums_.start += beta[: lo[1]].sum(0)
            sums_.mass += beta.sum(0)
            o = self.o[base : lo[t1]]
            for s in range(STATES):
                g[:, s] += np.bincount(o, beta[:, s], len(g))


# The first model ---------------------------------------------------------------------------


@dataclass
class Start:
    """A model of a sample, and its words' expected counts by sorted key."""

    model: Model
    keys: np.ndarray
    g: np.ndarray

    def emissions(self, keys: np.ndarray) -> np.ndarray:
        """For any words; a word not in the sample is alike in all states."""
        out = np.ones((len(keys), STATES))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            out[hit] = self.model.emissions(self.g[at[hit]])
        return out


def numbered(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, tokens as numbers among them, tokens of each text): words, then the end."""
    data, off = buffers(column, lower=True)
    starts, lengths, rows = words(data, off)
    h = np.insert(hashes(data, starts, lengths), rows[1:], END_KEY)
    keys, _, inverse = unique(h)
    return keys, inverse, np.diff(rows) + 1


def started(column: pa.Array, tolerance: float = 2e-4) -> Start:
    """Baum-Welch on a sample until two steps in a row gain little, from the words' counts dealt to the states at random.

    Gains that are small but grow are those of a model that has yet to leave its start.
    """
    noise = np.random.default_rng(11)
    keys, tokens, n = numbered(column) if len(column) else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    g = np.bincount(tokens, minlength=len(keys))[:, None] * noise.dirichlet(np.full(STATES, 1.0), len(keys))
    move = noise.uniform(0.5, 1.5, (STATES, STATES)) + np.eye(STATES)
    model = Model(np.full(STATES, 1 / STATES), move / move.sum(1, keepdims=True), g.sum(0), g.sum())
    steps, before, last = Steps(tokens, n), -np.inf, np.inf
    while len(tokens):
        total, new = Sums.zero(), np.zeros_like(g)
        steps.count(model, model.emissions(g), total, new)
        model, g = Model.of_sums(total), new
        likely = total.likely - len(tokens) * np.log(len(tokens) + len(keys) + 1)
        gain = (likely - before) / abs(likely)
        if gain <= last < tolerance:
            break
        before, last = likely, gain
    return Start(model, keys, g)


def sample(docs: DataFrame, size: int) -> pa.Array:
    """Training texts for the first model: bounded by SAMPLE_BYTES in expectation, by SAMPLE_ROWS texts of SAMPLE_TEXT bytes always."""
    share = int((1 << 30) * min(1.0, SAMPLE_BYTES / max(size, 1))) + 1
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("hmm")), F.lit(1 << 30))
    rows = docs.where(~held_out() & (draw < share) & (F.octet_length("text") <= SAMPLE_TEXT))
    found = rows.orderBy(draw, "doc_id").limit(SAMPLE_ROWS).select("text").toArrow()["text"].combine_chunks()
    keep = int(np.searchsorted(np.cumsum(np.diff(buffers(found)[1])), 2 * SAMPLE_BYTES, "right")) + 1
    return found[:keep]


# Parts -------------------------------------------------------------------------------------


def record(**values) -> pa.RecordBatch:
    """One row of a part."""
    return pa.RecordBatch.from_arrays([values[k] if isinstance(values.get(k), pa.Array) else pa.array([values.get(k)], t) for k, t in ROW.items()], list(ROW))


def as_list(a: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length (the last may have one row a state) as compressed bytes: first the lowest bytes of a column's numbers, then the next ones."""
    planes = [np.ascontiguousarray(c).reshape(-1).view(np.uint8).reshape(-1, c.dtype.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=4).compress(b"".join(planes))


def unpacked(raw: bytes, *types: str) -> list[np.ndarray]:
    """The columns; the type "g" is shares by state."""
    data, out, at = zstandard.ZstdDecompressor().decompress(raw), [], 0
    sizes = [2 if t == "g" else np.dtype(t).itemsize for t in types]
    many = [STATES if t == "g" else 1 for t in types]
    n = len(data) // sum(w * m for w, m in zip(sizes, many, strict=True))
    for t, w, m in zip(types, sizes, many, strict=True):
        planes = np.frombuffer(data, np.uint8, n * w * m, at).reshape(w, n * m)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view("<u2" if t == "g" else t))
        at += n * w * m
    return out


def steps_of(x: np.ndarray) -> np.ndarray:
    """Differences of rising numbers, which ``cumsum`` undoes."""
    return np.diff(x, prepend=x.dtype.type(0))


def shares(c: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Expected counts as 16-bit shares of the count, states x words."""
    return np.round(g.T * (65535 / np.maximum(c, 1))).astype("<u2")


def counts_of(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Expected counts (words x states) from counts and shares."""
    q = q.reshape(STATES, -1).astype(float)
    return (q * (c / np.maximum(q.sum(0), 1))).T


class Part:
    """A part's vocabulary (in the order met), its emissions, and what a step has added up for it."""

    def __init__(self, number: int, size: int = 0) -> None:
        self.number = number
        #: By bucket: places of the words that other parts have too, and their numbers in the bucket; None before they are known.
        self.keys, self.shared = np.empty(0, np.uint64), None
        self.c, self.g, self.sums, self.e = np.zeros(size, np.int64), np.zeros((size, STATES)), Sums.zero(), np.empty((0, STATES))

    def numbers(self, keys: np.ndarray, start: Start) -> np.ndarray:
        """The numbers of the (distinct) keys in the vocabulary, new ones at its end."""
        order = np.argsort(self.keys)
        known = self.keys[order]
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        new = known[at] != keys if len(known) else np.ones(len(keys), bool)
        out = np.empty(len(keys), np.int64)
        out[~new] = order[at[~new]]
        m = int(new.sum())
        out[new] = len(known) + np.arange(m)
        self.keys = np.concatenate([self.keys, keys[new]])
        self.c, self.g = np.concatenate([self.c, np.zeros(m, np.int64)]), np.concatenate([self.g, np.zeros((m, STATES))])
        self.e = np.concatenate([self.e, start.emissions(keys[new])])
        return out

    def learn(self, model: Model, tokens: np.ndarray, n: np.ndarray, held: np.ndarray) -> None:
        trains = np.repeat(~held, n)
        if trains.any():
            own = tokens[trains]
            self.c += np.bincount(own, minlength=len(self.c))
            Steps(own, n[~held]).count(model, self.e, self.sums, self.g)

    def rows(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """The sums, and the words' own counts: first by bucket, then those that other parts have too by bucket."""
        yield record(part=self.number, seq=SUMS, data=self.sums.flat().tobytes())
        q, c = shares(self.c, self.g), self.c.astype("<u4")
        if self.shared is None:
            own = (self.keys % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((self.keys, own))
            for k in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                if len(k):
                    keys = self.keys[k].astype("<u8", copy=False)
                    for seq, data in ((PLACES, packed(k.astype("<u4"))), (COUNTS, packed(c[k], q[:, k])), (KEYS, packed(steps_of(keys)))):
                        yield record(part=self.number, seq=seq, bucket=int(own[k[0]]), data=data)
        else:
            for bucket, (at, index) in self.shared.items():
                yield record(part=self.number, seq=WORDS, bucket=bucket, data=packed(steps_of(index), c[at], q[:, at]))
            for at, _ in self.shared.values():
                q[:, at] = 0  # the sums of all parts come in their place
            yield record(part=self.number, seq=OWN, data=packed(c, q))


def split(docs: DataFrame, start: Start, buckets: int, part_bytes: int = PART_BYTES) -> DataFrame:
    """The texts as parts, with a first step of Baum-Welch under ``start``."""
    shared = docs.sparkSession.sparkContext.broadcast(start)  # words of a sample of bounded bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, part, seq, size = TaskContext.get().partitionId() << 32, None, 0, 0
        for piece in pieces(batches, limit=min(PIECE_BYTES, part_bytes)):
            if part is None:
                part, seq, size = Part(first), 0, 0
                first += 1
            keys, inverse, n = numbered(piece["text"])
            # Frequent words get small numbers, which compress better.
            order = np.argsort(-np.bincount(inverse), kind="stable")
            number = np.empty(len(keys), np.uint32)
            number[order] = part.numbers(keys[order], shared.value)
            tokens, held = number[inverse], piece["held"].to_numpy(zero_copy_only=False)
            part.learn(shared.value.model, tokens, n, held)
            yield record(part=part.number, seq=seq, doc_ids=as_list(piece["doc_id"]), held=as_list(piece["held"]), n=as_list(pa.array(n, pa.int32())), data=packed(tokens.astype("<u4", copy=False)))
            seq, size = seq + 1, size + int(buffers(piece["text"])[1][-1])
            if size >= part_bytes or len(part.keys) >= PART_WORDS:
                yield from part.rows(buckets)
                part = None
        if part is not None:
            yield from part.rows(buckets)

    return docs.select("doc_id", held_out().alias("held"), "text").mapInArrow(run, SPLIT)


def met(asked: DataFrame, first: bool) -> DataFrame:
    """For each part and bucket the sums (WORDS) of the words that other parts have too, in the order of their keys.

    ``first``: the words come by key; which ones they are (FIXED: place in the part's list, number in the bucket, count over all parts) is said too.
    ``known``: the bucket's distinct training words, on one row of it.
    """

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        keys, counts = (table.filter(pc.equal(table["seq"], seq)) for seq in ((KEYS, COUNTS) if first else (WORDS, WORDS)))
        if first:
            rows = [(*unpacked(k, "<u8"), *unpacked(c, "<u4", "g")) for k, c in zip(keys["data"].to_pylist(), counts["data"].to_pylist(), strict=True)]
        else:
            rows = [unpacked(b, "<u4", "<u4", "g") for b in counts["data"].to_pylist()]
        ends = np.cumsum([len(r[0]) for r in rows])
        inverse = np.concatenate([np.cumsum(r[0], dtype=r[0].dtype) for r in rows])
        if first:
            _, _, inverse = unique(inverse)
        distinct = int(inverse.max(initial=0)) + 1
        many = np.bincount(inverse, minlength=distinct) > 1
        own = np.concatenate([r[1] for r in rows]).astype(np.int64)
        c = np.round(np.bincount(inverse, own, distinct)).astype(np.int64)
        each = np.concatenate([counts_of(r[1], r[2]) for r in rows])
        q = shares(c, np.stack([np.bincount(inverse, each[:, s], distinct) for s in range(STATES)], 1))
        number = np.cumsum(many) - 1
        fixed, data = [], []
        for a, b in zip([0, *ends], ends, strict=False):
            k = np.flatnonzero(many[inverse[a:b]]) if first else np.arange(b - a)
            word = inverse[a:b][k]
            if first:
                fixed.append(packed(steps_of(k.astype("<u4")), steps_of(number[word].astype("<u4")), c[word]))
            data.append(packed(q[:, word]))
        known = np.zeros(len(rows), np.int64)
        known[0] = (c > 0).sum()
        return pa.concat_tables(
            pa.table({"part": counts["part"], "seq": pa.array(np.full(len(x), seq), pa.int32()), "bucket": counts["bucket"], "data": pa.array(x, pa.binary()), "known": known * (seq == WORDS)})
            for seq, x in ((FIXED, fixed), (WORDS, data))
            if x
        )

    return asked.select("part", "seq", "bucket", "data").groupBy("bucket").applyInArrow(add, ANSWER)


def rounds(n: int, least: int) -> list[tuple[int, int]]:
    """Ranges of 0..n-1, ROUNDS at most, of ``least`` or more."""
    many = max(1, min(ROUNDS, n // least))
    return [(n * k // many, n * (k + 1) // many) for k in range(many)]


def by_part(rows: DataFrame, parts: list[int]) -> DataFrame:
    """The rows of ``parts`` (some of all in rising order): each part's words, their sums, then its pieces, in a task of its own, as a task's rows reach Python at once."""
    number = rows.sparkSession.createDataFrame([(p, k) for k, p in enumerate(parts)], "part long, number int")
    own = rows.where(F.col("part").between(parts[0], parts[-1])).join(F.broadcast(number), "part")
    return own.repartitionById(len(parts), "number").drop("number").sortWithinPartitions("part", "seq", "bucket")


def walked(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[Part, np.ndarray | None, pa.RecordBatch | None, np.ndarray | None]]:
    """(part, tokens, piece, the words' counts over all parts) of each piece, and (part, None, None, None) after a part's last one."""
    part, c, g, places, shared = None, None, None, {}, {}
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            number, seq, bucket, data = (row[x][0].as_py() for x in ("part", "seq", "bucket", "data"))
            if part is not None and part.number != number:
                yield part, None, None, None
                part = None
            if seq == PLACES:
                if c is not None:
                    c, g, places, shared = None, None, {}, {}
                places[bucket] = unpacked(data, "<u4")[0]
                continue
            if c is None:
                size = sum(map(len, places.values()))
                c, g = np.zeros(size, np.int64), np.zeros((size, STATES))
            if seq in (OWN, COUNTS):
                at = places[bucket] if seq == COUNTS else slice(None)
                c[at], q = unpacked(data, "<u4", "g")
                g[at] = counts_of(c[at], q)
            elif seq == FIXED:
                at, index, total = unpacked(data, "<u4", "<u4", "<i8")
                at = places[bucket][np.cumsum(at, dtype=np.int64)]
                shared[bucket], c[at] = (at, np.cumsum(index, dtype="<u4")), total
            elif seq == WORDS:
                at = shared[bucket][0]
                g[at] = counts_of(c[at], unpacked(data, "g")[0])
            else:
                if part is None:
                    part = Part(number, len(c))
                    part.shared, part.e, g, places = shared, model.emissions(g), None, {}
                yield part, unpacked(data, "<u4")[0], row, c
    if part is not None:
        yield part, None, None, None


def step(rows: DataFrame, model: Model, buckets: int) -> DataFrame:
    """A step of Baum-Welch over all training texts: each part's sums and words."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # states x states

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, tokens, row, _ in walked(batches, shared.value):
            if row is None:
                yield from part.rows(buckets)
            else:
                part.learn(shared.value, tokens, row["n"].flatten().to_numpy(), row["held"].flatten().to_numpy(zero_copy_only=False))

    return rows.mapInArrow(run, SPLIT)


def scored(rows: DataFrame, model: Model, total: int, distinct: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)  # states x states
    unit = float(np.log10(total + distinct + 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, tokens, row, c in walked(batches, shared.value):
            if row is not None:
                n = row["n"].flatten().to_numpy()
                off = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
                base = sums((np.log10(c + 1.0) - unit)[tokens], off)
                score = Steps(tokens, n).likelihood(shared.value, part.e) / np.log(10) - n * unit
                columns = [row["doc_ids"].flatten(), row["held"].flatten(), pa.array(n, pa.int64()), pa.array(sums((c > 0).astype(np.int64)[tokens], off)), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORED.split(", ")])

    return rows.mapInArrow(run, SCORED)


def added(rows: DataFrame) -> Sums:
    """The sums of all parts."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for g in batch["data"].to_pylist():
                total = total + np.frombuffer(g)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["cell", "x"])

    found = rows.where(F.col("seq") == SUMS).select("data").mapInArrow(cells, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).toPandas()
    flat = np.zeros(1 + 2 * STATES + STATES**2)
    flat[found["cell"].to_numpy(np.int64)] = found["x"].to_numpy()
    return Sums.of(flat)


def by_folder(rows: DataFrame) -> DataFrame:
    """``rows`` with the folder in which each is written."""
    asks = F.col("seq").isin(KEYS, WORDS) if "n" in rows.columns else F.lit(False)
    return rows.withColumn(store.FOLDER, F.when(asks, MEET).when((F.col("seq") >= 0) | F.col("seq").isin(PLACES, FIXED), STAY).otherwise(STEP))


def written(tables: Iterable[DataFrame], name: str) -> DataFrame:
    """All rows of ``tables``, which are written one after the other; the files of each one's shuffle go when it is written."""
    done = []
    for rows in tables:
        with store.no_shuffle_stays(rows.sparkSession):
            done.append(store.written(rows, name, "none", store.LARGE_ROWS))
    return reduce(DataFrame.unionByName, done)


def hmm_scores(docs: DataFrame, steps: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text.

    ``steps``: the number of Baum-Welch steps over all texts, 1 at least, in place of the tolerance.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).head().bytes
    cores = docs.sparkSession.sparkContext.defaultParallelism
    buckets = max(1, -(-size // BUCKET_BYTES))
    part_bytes = min(PART_BYTES, max(LEAST_BYTES, size // (3 * cores)))
    first = now = written([by_folder(split(rows, started(sample(rows, size)), buckets, part_bytes))], "parts")
    parts = sorted(r.part for r in first.where(F.col("seq") == SUMS).select("part").collect())
    if not parts:
        return docs.sparkSession.createDataFrame([], SCORED).withColumn("train_tokens", F.lit(0).cast("long")).select(*COLUMNS)
    folder = lambda table, *which: table.where(F.col(store.FOLDER).isin(*which)).drop(store.FOLDER)
    fixed, before, k = None, None, 1

    def passed(run: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``run`` on all parts."""
        texts = folder(first, STAY).unionByName(folder(now, STEP).where(F.col("seq") != SUMS))
        said = folder(fixed, STAY).unionByName(folder(answers, STEP)).drop("known")
        texts = texts.unionByName(said, allowMissingColumns=True)
        return written((run(by_part(texts, parts[a:b])) for a, b in rounds(len(parts), 2 * cores)), "step")

    while True:
        model = Model.of_sums(added(now))
        asked = now.where(F.col("seq").isin(KEYS, COUNTS) if k == 1 else F.col(store.FOLDER) == MEET)
        answers = written((by_folder(met(asked.where(F.col("bucket").between(a, b - 1)), k == 1)) for a, b in rounds(buckets, -(-cores // 2))), "words")
        store.drop(now, f"{store.FOLDER}={MEET}")
        if k == 1:
            fixed, distinct = answers, answers.agg(F.coalesce(F.sum("known"), F.lit(0))).head()[0]
            total = round(model.n)  # whole: each token's posterior sums to 1
        if not total or k == steps:
            break
        new = passed(lambda own: by_folder(step(own, model, buckets)))
        likely = added(new).likely - total * np.log(total + distinct + 1.0)
        if before is not None and steps is None and likely - before < TOLERANCE * abs(likely):
            store.drop(new)
            break
        for old in (now, answers):
            store.drop(old, f"{store.FOLDER}={STEP}")
        now, before, k = new, likely, k + 1
    out = passed(lambda own: scored(own, model, total, distinct))
    return out.withColumn("train_tokens", F.lit(total).cast("long")).select(*COLUMNS)
