"""Toxicity by maximum-scoring segments of token log-odds.

Learning counts words and word beginnings in toxic and clean texts.  A word's log-odds come from a Dirichlet
prior around those of its beginnings, so a rare inflection inherits what its stem shows.  Scoring scans a
text once, in linear time, for all maximal segments of positive total (each word's log-odds less a penalty), finds
the significant ones by extreme-value statistics (expected number of such segments by chance in a clean text of
that length) and maps their summed normalised scores to 0..1; texts without a significant one are ranked below them
by their mean log-odds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainkit.llm.common import cut, forget, hash_share, map_rows

TRAIN_ROWS = 30_000  # bounds of the labelled sample that is learnt from: rows,
TRAIN_CHARS = 64_000_000  # and characters; with MIN_COUNT they bound the model at 16 million features of 16 bytes
CALIBRATION_SHARE = 0.3  # of the sample: fits the extreme values instead of the counts
MIN_COUNT = 2
STEMS = (4, 5, 6)  # lengths of word beginnings
PRIOR = 5.0  # weight of the prior in words
PENALTY = 1.0  # taken from each word's log-odds, so that chance segments stay short
THRESHOLD = 0.3
FAINT = 0.02  # the most that a text without a significant segment scores
REMEMBERED = 500_000  # words whose log-odds a worker keeps
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def features_of(word: str) -> list[str]:
    """The word's beginnings, shortest first, then the word; a beginning is marked by its length."""
    return [f"{n}:{word[:n]}" for n in STEMS if len(word) > n] + [word]


def hash_of(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature) >> 1


class LogOdds(dict):
    """Word -> log-odds of toxic against clean; words are looked up before they are asked for."""

    def __init__(self, features: np.ndarray, counts: np.ndarray, toxic: int, clean: int):
        super().__init__()
        self.features, self.counts = features, counts
        self.base = min(max((toxic + 0.5) / (toxic + clean + 1.0), 1e-6), 1 - 1e-6)

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        new = [w for w in set(words) if w not in self]
        if new:
            parts = [features_of(w) for w in new]
            hashes = np.array([hash_of(f) for part in parts for f in part], np.int64)
            at = np.minimum(self.features.searchsorted(hashes), max(0, len(self.features) - 1))
            known = self.features[at] == hashes if len(self.features) else np.zeros(len(hashes), bool)
            counts = np.where(known[:, None], self.counts[at] if len(self.features) else 0, 0).tolist()
            k, base = 0, math.log(self.base / (1 - self.base))
            for word, part in zip(new, parts, strict=True):
                rate = self.base
                for toxic, clean in counts[k : k + len(part)]:  # an unseen feature leaves the rate as it is
                    rate = (toxic + PRIOR * rate) / (toxic + clean + PRIOR)
                k += len(part)
                self[word] = math.log(rate / (1 - rate)) - base
        return np.fromiter(map(self.__getitem__, words), float, len(words))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, stop, score), in linear time. Only words of positive score can start or end one.

    Every open segment knows the last earlier one that begins at a smaller total, so those in between are
    looked at once.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)]).tolist()
    lows, highs, starts, stops, smaller = [], [], [], [], []
    for k in np.flatnonzero(scores > 0).tolist():
        low, high, start = total[k], total[k + 1], k
        j = len(lows) - 1
        while True:
            while j >= 0 and lows[j] >= low:
                j = smaller[j]
            if j < 0 or highs[j] >= high:
                break
            low, start = lows[j], starts[j]  # joined with all from j on
            for x in (lows, highs, starts, stops):
                del x[j:]
            j = smaller[j]
            del smaller[len(lows) :]
        lows.append(low), highs.append(high), starts.append(start), stops.append(k + 1), smaller.append(j)
    return [(a, b, h - w) for w, h, a, b in zip(lows, highs, starts, stops, strict=True)]


@dataclass
class Model:
    """What was learnt: sorted feature hashes with counts (toxic, clean), totals, and the extreme-value parameters."""

    features: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.empty((0, 2), np.int32))
    toxic: int = 0
    clean: int = 0
    rate: float = 1.0  # lambda of the extreme-value distribution
    size: float = 1.0  # K of it
    scale: float = 1.0  # maps the summed normalised score to 0..1

    def odds(self) -> LogOdds:
        """One for all tasks of a worker, which share the model."""
        if "known" not in self.__dict__:
            self.known = LogOdds(self.features, self.counts, self.toxic, self.clean)
        return self.known

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def evidence(self, text: str | None, odds: LogOdds) -> tuple[float, list[tuple[int, int, float]]]:
        """Summed normalised scores of the significant segments, and those segments; without any, a number below 0 that rises with the mean log-odds."""
        words = words_of(text)
        if not words or not self.toxic:
            return -np.inf, []
        scores = odds.of(words)
        chance = np.log(max(self.size * len(words), 1e-9))
        found = [(a, b, self.rate * s - chance) for a, b, s in segments(scores - PENALTY)]
        kept = [x for x in found if x[2] > 0]
        return (sum(x[2] for x in kept) if kept else float(-np.logaddexp(0.0, -scores.mean()))), kept

    def score(self, evidence: float) -> float:
        if evidence <= 0:
            return float(FAINT * np.exp(evidence))
        return float(FAINT - (1 - FAINT) * np.expm1(-self.scale * evidence))


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, clean) of each batch; each text counts a word once, so that no single text rules a word."""
    for batch in batches:
        toxic, clean = Counter(), Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            of = toxic if label else clean
            once = set(words_of(text))
            of[""] += len(once)
            for word in once:
                of.update(features_of(word))
        names = sorted(set(toxic) | set(clean))
        if names:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(map(hash_of, names)), pa.int64()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([clean[x] for x in names], pa.int64())],
                names=["feature", "toxic", "clean"],
            )


def _karlin_rate(scores: np.ndarray) -> float:
    """The positive root of E[exp(x * score)] = 1; scores must have a negative mean."""
    low, high = 1e-3, 1e-3
    while np.mean(np.exp(np.minimum(high * scores, 700))) < 1 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.mean(np.exp(np.minimum(mid * scores, 700))) < 1 else (low, mid)
    return low


def best_cut(values: np.ndarray, labels: np.ndarray) -> float:
    """The cut of the highest F1, in the middle of the gap around it."""
    order = np.argsort(-values, kind="stable")
    v, hits = values[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(v) + 1) + labels.sum())
    last = np.append(v[1:] != v[:-1], True)  # cut only between different values
    k = int(np.argmax(np.where(last & (v > 0), f1, -1)))
    below = v[k + 1] if k + 1 < len(v) else 0.0
    return float((v[k] + max(below, 0.0)) / 2)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS, seed: int = 42) -> Model:
    """Learns from at most about `train_rows` labelled rows of `train_chars` characters, drawn by hash: ids first, then rows,
    as many rows may share an id.

    Several labels of a document count as toxic if one is.  Labels without an id or a value are left out.
    """
    wanted = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    n = wanted.count()
    if not n:
        return Model()
    drawn = wanted.where(hash_share("id", seed) < min(1.0, train_rows / n)).groupBy("id").agg(F.max(F.col("label") > 0).alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id")  # of about train_rows ids
    share = min(1.0, train_rows / max(1, texts.count()))  # counted from ids alone
    texts = sample = cut(texts.where(hash_share("id", seed + 3, "text") < share))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    texts = texts.where(hash_share("id", seed + 2, "text") < min(1.0, train_chars / max(1, chars)))
    fit = hash_share("id", seed + 1, "text") >= CALIBRATION_SHARE
    counted = texts.where(fit).select("text", "label").mapInArrow(_count_features, "feature long, toxic long, clean long")
    summed = counted.groupBy("feature").agg(F.sum("toxic").cast("int").alias("toxic"), F.sum("clean").cast("int").alias("clean"))
    kept = summed.where(F.col("toxic") + F.col("clean") >= MIN_COUNT).orderBy("feature").toArrow()  # bounded by train_chars
    features, counts = kept["feature"].to_numpy(), np.stack([kept["toxic"].to_numpy(), kept["clean"].to_numpy()], axis=1)
    every = features == hash_of("")
    toxic, clean = counts[every].sum(axis=0).tolist()
    if not toxic or not clean:
        return Model()
    model = Model(features[~every], counts[~every], toxic, clean)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per clean calibration text its words and best segment score, and per task how often each score occurs in them (n = 0)."""
        odds, seen = shared.value.odds(), Counter()
        names = ["n", "value"]
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                if words:
                    scores = odds.of(words) - PENALTY
                    places, sizes = np.unique(np.round(scores, 1), return_counts=True)
                    seen.update(dict(zip(places.tolist(), sizes.tolist(), strict=True)))
                    rows.append((len(words), max((s for _, _, s in segments(scores)), default=0.0)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], names=names)
        for place, size in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([-size]), pa.array([place])], names=names)

    seen = texts.where(~fit & ~F.col("label")).select("text").mapInArrow(chances, "n long, value double").toArrow()
    n_words, value = seen["n"].to_numpy(), seen["value"].to_numpy()
    if not (n_words > 0).any():
        return model
    places, at = np.unique(value[n_words < 0], return_inverse=True)
    weight = np.bincount(at, -n_words[n_words < 0])
    model.rate = _karlin_rate(np.repeat(places, np.maximum(1, np.round(weight / weight.sum() * 100_000)).astype(int)))
    length, longest = n_words[n_words > 0].astype(float), value[n_words > 0]
    order = np.lexsort((longest, length))  # sums must not depend on the order of arrival
    model.size = float(len(length) / np.sum(length[order] * np.exp(-model.rate * longest[order])))
    fitted = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = fitted.value.odds()
        for batch in batches:
            values = [max(0.0, fitted.value.evidence(text, odds)[0]) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(values, pa.float64())], names=["label", "value"])

    judged = texts.where(~fit).select("text", "label").mapInArrow(weigh, "label boolean, value double").toArrow()  # a row per calibration text
    values, hits = judged["value"].to_numpy(), judged["label"].to_numpy().astype(float)
    if hits.any():
        cut_at = best_cut(values, hits)
        model.scale = float(-np.log((1 - THRESHOLD) / (1 - FAINT)) / max(cut_at, 1e-6))
    shared.unpersist()
    fitted.unpersist()
    forget(sample)
    return model


def _judge(model: Model) -> Callable:
    odds = model.odds()

    def judge(inputs: list[pa.Array]) -> list[pa.Array]:
        scores, passages = [], []
        for text in inputs[0].to_pylist():
            evidence, found = model.evidence(text, odds)
            scores.append(model.score(evidence))
            passages.append([{"start": a, "stop": b, "score": s} for a, b, s in found])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
        return [pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(passages, kind)]

    return judge


def score_texts(docs: DataFrame, model: Model, carry: list[Column], text_col: str = "text") -> DataFrame:
    """`carry` as c0, c1, ... with score, predicted, passages: one row per input row; no shuffle.

    `score` is in [0, 1); `predicted` is 1 from 0.3 on; `passages` are the significant segments in word
    positions.  Null and empty texts, texts without a word, and all texts if nothing toxic was learnt, have score 0.  Long texts are scanned whole; repeated rows and equal texts have equal scores; carried
    columns may have any names.  An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TRAIN_CHARS
    fields = "score double, predicted int, passages array<struct<start:int,stop:int,score:double>>"
    return map_rows(docs, carry, [F.col(text_col)], lambda: _judge(shared.value), fields)
