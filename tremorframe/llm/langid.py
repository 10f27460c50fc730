"""Language identification by interpolated Kneser-Ney character models.

Characters are lower-cased letters; anything else ends a word, and words are padded with
blanks. Each language has a model of order ORDER with absolute discounts estimated from its
counts. The models are held as sorted arrays of 64-bit n-gram hashes, one row of
log-probabilities (a column a language) for each n-gram that any language has, with what the others'
interpolation gives it, and rows of back-off weights for contexts. A text goes to the
language of the lowest cross-entropy per character; a word is scored once for each piece of
text that it occurs in.

Rejection is calibrated on training rows that the models have not seen: ``score`` is a logistic
function of the margin to the second language times the square root of the text's characters, and ``rejected`` tells a score under 0.5 or a
cross-entropy above nearly all (QUANTILE) of the language's calibration rows.

``sample`` bounds, in expectation, the texts of each language that train the models; half as many calibrate. The LANGUAGES most
frequent languages are learned. Texts are drawn where they lie: nothing but n-gram counts is shuffled.

Edge cases: a null or empty text, or one without a letter, is ``und`` with score 0, as is every text if
nothing can be learned; a single language has an infinite margin, taken as MOST; a null doc_id is not
held out and not learned from; rows of equal doc_id give a row each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import buffers, hashes, mix, pieces, strings, sums, unique, words
from .toxicity import held_out, logistic

ORDER, QUANTILE, MOST, LANGUAGES = 4, 0.999, 8.0, 1000
_G = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def is_letter(codes: np.ndarray) -> np.ndarray:
    """Whether code points are letters."""
    if not _letters:
        _letters.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)]))
    return _letters[0][codes]


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ORDER-grams ending at each letter and at each end of a run of letters, number of them up to each text)."""
    joined = "\n".join(x.lower().replace("\n", " ") for x in texts.to_pylist()) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64)
    breaks = np.flatnonzero(codes == 10)
    letter = is_letter(codes)
    before = np.concatenate([[False], letter[:-1]])
    at = np.flatnonzero(letter | before)
    shown = np.where(letter, codes, 32)
    out = np.empty((len(at), ORDER), np.int64)
    out[:, -1] = shown[at]
    open_ = before[at]
    for k in range(1, ORDER):
        out[:, -1 - k] = np.where(open_, shown[np.maximum(at - k, 0)], 32)
        open_ = open_ & (at - k > 0) & before[np.maximum(at - k, 0)]
    return out, np.concatenate([[0], np.searchsorted(at, breaks, "right")])


def keyed(grams: np.ndarray) -> np.ndarray:
    h = np.full(len(grams), grams.shape[1], np.uint64)
    for c in grams.T.astype(np.uint64):
        h = mix(h * _G + c)
    return h


@dataclass
class Sorted:
    """Rows of values found by sorted 64-bit keys."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, grams: np.ndarray, values: np.ndarray) -> Sorted:
        keys = keyed(grams)
        order = np.argsort(keys)
        return cls(keys[order], values[order])

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = keyed(grams)
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at


def kneser_ney(grams: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For orders 1 to ORDER: n-grams, their discounted probabilities, contexts, and the contexts' back-off weights."""
    levels = []
    for k in range(ORDER, 0, -1):
        context, own = np.unique(grams[:, :-1], axis=0, return_inverse=True)
        own = own.ravel()
        total, kinds = np.bincount(own, counts), np.bincount(own)
        n1, n2 = (counts == 1).sum(), (counts == 2).sum()
        d = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.9)
        levels.append((grams, (counts - d) / total[own], context, d * kinds / total))
        # A lower order counts the different characters seen before the n-gram.
        grams, counts = np.unique(grams[:, 1:], axis=0, return_counts=True)
    return levels[::-1]


@dataclass
class Languages:
    names: list[str]
    grams: list[Sorted]
    contexts: list[Sorted]
    unseen: float
    slope: float = 1.0
    shift: float = 0.0
    highest: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, names: list[str], tables: list[tuple[np.ndarray, np.ndarray]]) -> Languages:
        """``tables``: ORDER-grams and counts of each language."""
        models = [kneser_ney(g, c) for g, c in tables]
        letters = len(np.unique(np.concatenate([g[:, -1] for g, _ in tables]))) if tables else 0
        lower = np.full((1, len(names)), 1.0 / (letters + 1))
        unseen = float(np.log(lower[0, 0])) if names else 0.0
        grams, contexts = [], []
        for k in range(ORDER):
            all_grams = np.unique(np.concatenate([m[k][0] for m in models]), axis=0) if models else np.empty((0, k + 1), np.int64)
            all_contexts = np.unique(np.concatenate([m[k][2] for m in models]), axis=0) if models else np.empty((0, k), np.int64)
            back = np.ones((len(all_contexts), len(names)))
            table = Sorted.of(all_contexts, np.arange(len(all_contexts)))
            for i, m in enumerate(models):
                back[table.values[table.find(m[k][2])[1]], i] = m[k][3]
            # Interpolation: discounted probability plus back-off weight times the lower order.
            below = lower[grams[k - 1].find(all_grams[:, 1:])[1]] if k else np.repeat(lower, len(all_grams), 0)
            p = back[table.values[table.find(all_grams[:, :-1])[1]]] * below if len(all_grams) else np.empty((0, len(names)))
            place = Sorted.of(all_grams, np.arange(len(all_grams)))
            for i, m in enumerate(models):
                p[place.values[place.find(m[k][0])[1]], i] += m[k][1]
            grams.append(Sorted.of(all_grams, np.log(p)))
            contexts.append(Sorted.of(all_contexts, np.log(back)))
            lower = np.exp(grams[-1].values)
        return cls(names, grams, contexts, unseen)

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        """Natural log-probabilities (n-grams x languages)."""
        out = np.zeros((len(grams), len(self.names)))
        todo = np.arange(len(grams))
        for k in range(ORDER - 1, -1, -1):
            g = grams[todo, ORDER - 1 - k :]
            hit, at = self.grams[k].find(g)
            out[todo[hit]] += self.grams[k].values[at[hit]]
            todo, g = todo[~hit], g[~hit]
            if not len(todo):
                return out
            hit, at = self.contexts[k].find(g[:, :-1])
            out[todo[hit]] += self.contexts[k].values[at[hit]]
        out[todo] += self.unseen
        return out

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character of each text in each language, number of characters)."""
        data, off = buffers(column, lower=True)
        starts, lengths, rows = words(data, off)
        if not len(starts):
            return np.zeros((len(column), len(self.names))), np.zeros(len(column), np.int64)
        _, first, inverse = unique(hashes(data, starts, lengths))
        grams, ends = windows(strings(data, starts[first], lengths[first]))
        p = self.log_p(grams)
        n = sums(np.diff(ends)[inverse], rows)
        total = np.stack([sums(sums(p[:, i], ends)[inverse], rows) for i in range(len(self.names))], 1) if self.names else np.zeros((len(n), 0))
        return -total / np.maximum(n, 1)[:, None], n

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language number or -1, score, cross-entropy, margin times the square root of the characters)."""
        h, n = self.entropies(column)
        if not self.names:
            return np.full(len(n), -1), np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
        order = np.argsort(h, axis=1, kind="stable")
        best = order[:, 0]
        low = h[np.arange(len(h)), best]
        margin = np.minimum(h[np.arange(len(h)), order[:, 1]] - low if len(self.names) > 1 else MOST, MOST) * np.ones(len(h))
        evidence = margin * np.sqrt(n)
        score = 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -500, 500)))
        return np.where(n > 0, best, -1), np.where(n > 0, score, 0.0), low, evidence


def sampled(docs: DataFrame, sample: int) -> DataFrame:
    """(lang, text, calibrates) of about 1.5 * ``sample`` rows of each language that are not held out, by a hash of doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("doc_id is not null and lang is not null").where(~held_out())
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    # LANGUAGES rows at most.
    share = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang", (F.lit(1.5 * sample) / F.col("n")).alias("share"))
    picked = rows.withColumn("draw", draw).join(F.broadcast(share), "lang").where("draw < share")
    third = F.pmod(F.xxhash64("doc_id", "text", F.lit("calibration")), F.lit(3)) == 0
    return picked.select("lang", "text", third.alias("calibrates"))


def train(docs: DataFrame, sample: int = 400) -> Languages:
    context = docs.sparkSession.sparkContext
    rows = sampled(docs, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            for lang in piece["lang"].unique().to_pylist():
                text = piece["text"].filter(pa.compute.equal(piece["lang"], lang))
                data, off = buffers(text, lower=True)
                starts, lengths, _ = words(data, off)
                if len(starts):
                    grams, n = np.unique(windows(strings(data, starts, lengths))[0], axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *(pa.array(grams[:, i]) for i in range(ORDER)), pa.array(n, pa.int64())], ["lang", *cells, "n"])

    cells = [f"c{i}" for i in range(ORDER)]
    counts = rows.where("not calibrates").select("lang", "text").mapInArrow(count, "lang string, " + ", ".join(f"{c} long" for c in cells) + ", n long")
    # As many rows as a bounded sample has n-grams.
    found = counts.groupBy("lang", *cells).agg(F.sum("n").alias("n")).toPandas()
    names = sorted(found.lang.unique())
    model = Languages.fit(names, [(f[cells].to_numpy(np.int64), f.n.to_numpy(np.int64)) for f in (found[found.lang == x] for x in names)])
    shared = context.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            best, _, low, margin = shared.value.predict(piece["text"])
            keep = best >= 0
            right = np.array([shared.value.names[b] if b >= 0 else "" for b in best]) == np.array(piece["lang"].to_pylist(), object)
            yield pa.RecordBatch.from_arrays([piece["lang"].filter(pa.array(keep)), pa.array(right[keep].astype(bool)), pa.array(low[keep]), pa.array(margin[keep])], ["lang", "right_", "low", "margin"])

    seen = rows.where("calibrates").select("lang", "text").mapInArrow(predict, "lang string, right_ boolean, low double, margin double").toPandas()
    if len(seen):
        model.slope, model.shift = logistic(seen.margin.to_numpy(float), seen.right_.to_numpy(float))
        model.highest = seen.groupby("lang").low.quantile(QUANTILE).to_dict()
    return model


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, rejected) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n-grams of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.names, "und"], object)
        limit = np.array([*(m.highest.get(x, np.inf) for x in m.names), -1.0])
        for piece in pieces(batches):
            best, score, low, _ = m.predict(piece["text"])
            yield pa.RecordBatch.from_arrays([piece["doc_id"], pa.array(names[best], pa.string()), pa.array(score), pa.array(low), pa.array((score < 0.5) | (low > limit[best]))], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def language_id(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs))
