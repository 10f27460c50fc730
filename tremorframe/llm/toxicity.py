"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel counts common subsequences of three symbols, each weighted by DECAY per skipped
symbol, up to GAP - 1 symbols skipped at a time, so an insult with a character inserted or
left out still resembles itself. Symbols are lower-cased letters, digits as one symbol, other
bytes by class, and a mark before the word; ASCII punctuation is left out, and runs of three
or more single letters ("i d i o t") also count as one word. Kernel values are divided by the
norm that a word of that length has without repeated subsequences.

Labels are on texts, while an insult is in one place, so training is multiple-instance: a
labelled text is the bag of its words, an unharmful text's words are all negative, a toxic
text's witness is the word that the current machine (at first: document frequencies) finds
worst, and each witness also enters with a letter inserted, VARIANTS times. The machine is linear in Nyström features of LANDMARKS words; being linear in the
explicit subsequence weights too, it is collapsed into one table of 64^3 weights, which
scores a word exactly as the landmark expansion does. A text scores its worst word, mapped
to 0..1 by a logistic fit on the training sample.

The machine is fitted on a bounded sample: ``bags`` bounds, in expectation, the labelled texts of each class that are learned from
(LONGEST bytes at most each, four times ``bags`` in all cases), and in each round it is trained on EASY of their negative words, drawn at random, and the HARD that
it finds worst. Scores are of whole texts. Letters with accents are told apart by 32 classes of UTF-8's second byte, so some of them coincide.

Edge cases: null, empty and blank texts get the machine's value of no word at all; null labels are
left out; repeated labels of one doc_id: the largest counts; without labels of both classes
every score is the share of toxic ones (0 without any); rows of equal doc_id are scored each; a null doc_id is not
held out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .text import buffers, hashes, pieces, unique, words

GAP, DECAY, LANDMARKS, ROUNDS, VARIANTS = 3, 0.7, 160, 4, 3
EASY, HARD, LONGEST = 8000, 3000, 1 << 18
SYMBOLS = 64
DROPPED = 255
CLASS = np.full(256, DROPPED, np.uint8)
CLASS[97:123] = np.arange(1, 27)
CLASS[48:58] = 27
CLASS[128:192] = 28 + (np.arange(128, 192) & 31)
CLASS[192:] = 60 + (np.arange(192, 256) & 3)
STEPS = [(a, b, DECAY ** (a + b - 2)) for a in range(1, GAP + 1) for b in range(1, GAP + 1)]


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def symbols(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with the start mark of each word, word offsets)."""
    ends = np.cumsum(lengths + 1)
    total = int(ends[-1]) if len(ends) else 0
    first = ends - lengths - 1
    index = np.repeat(starts - first - 1, lengths + 1) + np.arange(total)
    out = CLASS[data[np.maximum(index, 0)]]
    out[first] = 0
    keep = out != DROPPED
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[np.append(first, total)]


def occurrences(sym: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word, subsequence code, weight) of all subsequences, a pair of gaps at a time."""
    own = np.repeat(np.arange(len(off) - 1), np.diff(off))
    s = sym.astype(np.int32)
    for a, b, w in STEPS:
        n = len(s) - a - b
        if n > 0:
            at = np.flatnonzero(own[:n] == own[a + b :])
            yield own[at], (s[at] * SYMBOLS + s[at + a]) * SYMBOLS + s[at + a + b], w


def norms(off: np.ndarray) -> np.ndarray:
    n = np.diff(off)
    return np.sqrt(np.maximum(sum(w * w * np.maximum(n - a - b, 0) for a, b, w in STEPS), 1e-9))


@dataclass
class Machine:
    """``weights`` of subsequences, the value ``bias`` of no word, and the logistic ``slope`` and ``shift``."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def word_values(self, sym: np.ndarray, off: np.ndarray) -> np.ndarray:
        total = np.zeros(len(off) - 1)
        for own, code, w in occurrences(sym, off):
            total += w * np.bincount(own, self.weights[code], len(total))
        return total / norms(off) + self.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        value = self.values(column)
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -500, 500)))

    def values(self, column: pa.Array) -> np.ndarray:
        """The worst word's value of each text."""
        data, off = buffers(column, lower=True)
        starts, lengths, rows = words(data, off)
        worst = np.full(len(rows) - 1, self.bias)
        if not len(starts):
            return worst
        _, first, inverse = unique(hashes(data, starts, lengths))
        sym, woff = symbols(data, starts[first], lengths[first])
        some = np.flatnonzero(np.diff(rows))
        worst[some] = np.maximum.reduceat(self.word_values(sym, woff)[inverse], rows[:-1][some])
        single = (np.diff(woff) == 2)[inverse] & (sym[np.minimum(woff[:-1] + 1, len(sym) - 1)] != 27)[inverse]
        for row, letters in spelled(single, sym[np.minimum(woff[:-1] + 1, len(sym) - 1)][inverse], rows):
            value = self.word_values(np.concatenate([[0], letters]).astype(np.uint8), np.array([0, len(letters) + 1]))[0]
            worst[row] = max(worst[row], value)
        return worst


def spelled(single: np.ndarray, letter: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, letters) of runs of three or more words of one letter each within a row."""
    edge = np.diff(np.concatenate([[0], single.astype(np.int8), [0]]))
    cuts = np.zeros(len(single) + 1, bool)
    cuts[rows] = True
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        if b - a >= 3:
            at = [a, *(np.flatnonzero(cuts[a + 1 : b]) + a + 1), b]
            for x, y in zip(at, at[1:], strict=False):
                if y - x >= 3:
                    yield int(np.searchsorted(rows, x, "right") - 1), letter[x:y]


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, steps: int = 30) -> np.ndarray:
    """Weights (last: bias) of a linear support vector machine with squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    theta = np.zeros(x.shape[1])
    ridge = np.eye(len(theta))
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        inside = y * (x @ theta) < 1
        xi, wi = x[inside], c * weight[inside, None]
        new = np.linalg.solve(ridge + xi.T @ (wi * xi), xi.T @ (wi[:, 0] * y[inside]))
        if np.allclose(new, theta, atol=1e-6):
            break
        theta = new
    return theta


def logistic(value: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit with smoothed targets."""
    pos, neg = label.sum(), (1 - label).sum()
    goal = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([value, np.ones(len(value))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-4 * np.eye(2), x.T @ (p - goal) + 1e-4 * (theta - [1.0, 0.0]))
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def with_insertions(sym: np.ndarray, off: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The words, and VARIANTS copies of each of four letters or more with a letter inserted inside."""
    out = [sym[a:b] for a, b in zip(off, off[1:], strict=False)]
    for word in list(out):
        if len(word) > 4:
            out += [np.insert(word, rng.integers(2, len(word)), rng.integers(1, 27)) for _ in range(VARIANTS)]
    return np.concatenate(out), np.concatenate([[0], np.cumsum([len(w) for w in out])])


def fit(bags: list[list[str]], labels: list[int], seed: int = 7) -> Machine:
    """A machine from bags of distinct lower-cased words."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Machine(np.zeros(SYMBOLS**3, np.float32), 0.0, 1.0, float(np.log((y.sum() + 1e-9) / (len(y) - y.sum() + 1e-9))) if len(y) else -700.0)
    number: dict[str, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in bag], np.int64) for bag in bags]
    flat, own = np.concatenate(ids), np.repeat(y, [len(x) for x in ids])
    df = [np.bincount(flat[own == k], minlength=len(number)) for k in (0, 1)]
    evidence = np.log((df[1] + 0.5) / (y.sum() + 1)) - np.log((df[0] + 0.5) / ((1 - y).sum() + 1))
    data, off = buffers(pa.array(list(number), pa.large_string()))
    sym, woff = symbols(data, off[:-1], np.diff(off))
    rng = np.random.default_rng(seed)
    order = np.argsort(-evidence, kind="stable")
    half = LANDMARKS // 2
    marks = np.unique(np.concatenate([order[:half], rng.permutation(len(number))[:half]]))

    def pick(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(woff)[which]
        ends = np.cumsum(n)
        return sym[np.repeat(woff[which] - (ends - n), n) + np.arange(ends[-1])], np.concatenate([[0], ends])

    sm, om = pick(marks)
    found = [(o, c, w) for o, c, w in occurrences(sm, om)]
    used = np.unique(np.concatenate([c for _, c, _ in found]))
    row = np.full(SYMBOLS**3, len(used), np.int64)
    row[used] = np.arange(len(used))
    phi = np.zeros((len(used) + 1, len(marks)))
    for o, c, w in found:
        np.add.at(phi, (row[c], o), w)
    phi /= norms(om)
    root = np.linalg.eigh(phi.T @ phi)
    keep = root[0] > 1e-6
    map_ = phi @ (root[1][:, keep] / np.sqrt(root[0][keep]))  # subsequence -> Nyström feature

    def features(s_all: np.ndarray, o_all: np.ndarray) -> np.ndarray:
        out = np.zeros((len(o_all) - 1, map_.shape[1]))
        for k in range(0, len(out), 2000):
            o = o_all[k : k + 2001]
            s, o = s_all[o[0] : o[-1]], o - o[0]
            part = out[k : k + 2000]
            for own_, code, w in occurrences(s, o):
                r = row[code]
                hit = r < len(used)
                np.add.at(part, own_[hit], w * map_[r[hit]])
            part /= norms(o)[:, None]
        return out

    negative = np.flatnonzero(df[0] > 0)
    easy = rng.permutation(negative)[:EASY]
    value = evidence
    machine = Machine(np.zeros(SYMBOLS**3, np.float32), 0.0, 1.0, 0.0)
    for _ in range(ROUNDS):
        witness = np.unique([x[np.argmax(value[x])] for x, label in zip(ids, y, strict=True) if label and len(x)]).astype(np.int64)
        top = [x[np.argsort(-value[x])[:3]] for x, label in zip(ids, y, strict=True) if label and len(x)]
        extra = np.unique(np.concatenate(top)) if top else witness
        witness = np.union1d(witness, extra[(value[extra] > 0) & (df[0][extra] == 0)])
        hard = negative[np.argsort(-value[negative], kind="stable")[:HARD]]
        none = np.union1d(easy, hard)
        witness = np.setdiff1d(witness, none)
        if not len(witness):
            break
        sw, ow = with_insertions(*pick(witness), rng)
        x = np.vstack([features(sw, ow), features(*pick(none)), np.zeros((1, map_.shape[1]))])  # last: no word
        side = np.concatenate([np.ones(len(ow) - 1), -np.ones(len(none) + 1)])
        weight = np.where(side > 0, max(1.0, len(none) / len(ow) / 4), 1.0)
        weight[-1] = 100
        theta = squared_hinge(x, side, weight)
        weights = np.zeros(SYMBOLS**3, np.float32)
        weights[used] = map_[:-1] @ theta[:-1]
        machine = Machine(weights, float(theta[-1]), 1.0, 0.0)
        value = machine.word_values(sym, woff)
    worst = np.array([value[x].max() if len(x) else machine.bias for x in ids])
    machine.slope, machine.shift = logistic(worst, y)
    return machine


def train(docs: DataFrame, labels: DataFrame, bags: int = 1000) -> Machine:
    """Learns from about ``bags`` texts of each class: labelled rows that are not held out, by a hash of doc_id."""
    known = labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    part = F.lit(0)
    for k, n in count.items():
        part = F.when(F.col("toxic") == k, int((1 << 20) * min(1.0, bags / n)) + 1).otherwise(part)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20))
    # The sample's ids are bounded by 2 * bags in expectation, and by 4 * bags.
    picked = known.where(draw < part).orderBy(draw, "doc_id").limit(4 * bags)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST).join(F.broadcast(picked), "doc_id")
    # Rows that share an id may be many.
    rows = rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(4 * bags)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            data, off = buffers(piece["text"], lower=True)
            starts, lengths, rows_ = words(data, off)
            out = []
            for a, b in zip(rows_, rows_[1:], strict=False):
                _, first, _ = unique(hashes(data, starts[a:b], lengths[a:b])) if b > a else (0, np.empty(0, int), 0)
                out.append([data[s : s + n].tobytes().decode("utf-8", "replace") for s, n in zip(starts[a:b][first], lengths[a:b][first], strict=True)])
            yield pa.RecordBatch.from_arrays([piece["doc_id"], piece["toxic"], pa.array(out, pa.list_(pa.string()))], ["doc_id", "toxic", "words"])

    found = rows.select("doc_id", "toxic", "text").mapInArrow(distinct, "doc_id long, toxic int, words array<string>").toPandas()
    found = found.sort_values("doc_id", kind="stable")
    return fit([sorted(w) for w in found.words], found.toxic.tolist())


def score(docs: DataFrame, machine: Machine, column: str = "score") -> DataFrame:
    """``docs`` with the toxicity score of its ``text`` in ``column``."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # a table of fixed size
    names, at = [*docs.columns, column], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces((b.set_column(at, "text", b.column(at)) for b in batches)):
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(model.value.scores(piece.column(at)))], names)

    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])
    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(rows, train(docs, labels)).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
