"""Language identification with hyperdimensional letter n-gram profiles.

Every letter has a random vector of +1 and -1 drawn from its code point.  An n-gram binds the permuted
(rotated) vectors of its letters by multiplication; a document bundles its n-grams by addition; a language's
prototype is the mean of its documents' unit vectors.  A document gets the language of the highest cosine.
The n-grams of a batch are counted first, so each distinct one is bound once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainkit.llm.common import cut, hash_share

DIMENSIONS = 1024
ORDER = 3
TRAIN_ROWS_PER_LANGUAGE = 10_000  # bound of the training sample
LANGUAGES_AT_ONCE = 4096  # prototypes in one broadcast; more are compared in several passes
UNITS = 1 << 24  # unit vectors are added up in whole numbers, so that sums don't depend on the order of arrival
TRAIN_TASKS = 24
CHARS_AT_ONCE = 300_000
DOCS_AT_ONCE = 256
UNDETERMINED = "und"

_CODE_POINTS = 0x110000


class Bundler:
    """Document vectors of texts. Holds letter vectors of at most `remembered` code points."""

    def __init__(self, dimensions: int = DIMENSIONS, order: int = ORDER, seed: int = 42, remembered: int = 20_000):
        self.dimensions, self.order, self.seed, self.remembered = dimensions, order, seed, remembered
        self.vectors: dict[int, np.ndarray] = {}
        self.is_letter = np.array([chr(c).isalpha() for c in range(_CODE_POINTS)])
        self.seen = np.zeros(_CODE_POINTS, bool)
        self.place = np.zeros(_CODE_POINTS, np.int64)

    def letters(self, code_points: list[int]) -> np.ndarray:
        if len(self.vectors) + len(code_points) > self.remembered:
            self.vectors.clear()
        for c in code_points:
            if c not in self.vectors:
                bits = np.random.Generator(np.random.PCG64([self.seed, c])).integers(0, 2, self.dimensions, np.int8)
                self.vectors[c] = 2 * bits - 1
        return np.stack([self.vectors[c] for c in code_points])

    def _tail(self, piece: str) -> str:
        """What n-grams across the end of `piece` need of it: its last symbols, runs of other characters as one blank."""
        out: list[str] = []
        for c in reversed(piece):
            symbol = c if c.isalpha() else " "
            if symbol != " " or out[-1:] != [" "]:
                out.append(symbol)
                if len(out) == self.order - 1:
                    break
        return "".join(reversed(out))

    def _slices(self, texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
        """Work lists of about CHARS_AT_ONCE characters; a longer text is bundled slice by slice, each after the last symbols of the one before."""
        todo: list[tuple[int, str]] = []
        chars = 0
        for k, text in enumerate(texts):
            if not text:
                continue
            whole, before = text.lower(), " "
            for at in range(0, len(whole), CHARS_AT_ONCE):
                piece = before + whole[at : at + CHARS_AT_ONCE]
                if at + CHARS_AT_ONCE < len(whole):
                    before = self._tail(piece)
                else:
                    piece += " "
                if todo and (chars + len(piece) > CHARS_AT_ONCE or len(todo) >= DOCS_AT_ONCE):
                    yield todo
                    todo, chars = [], 0
                todo.append((k, piece))
                chars += len(piece)
        if todo:
            yield todo

    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(one vector per text, whether it has a letter). Runs of other characters count as one blank."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        lettered = np.zeros(len(texts), bool)
        for todo in self._slices(texts):
            points = [np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32) for _, piece in todo]
            doc = np.repeat(np.arange(len(todo)), [len(p) for p in points])
            chars = np.concatenate(points)
            letter = self.is_letter[chars]
            keep = letter.copy()
            keep[0] = True
            keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
            chars, doc, letter = np.where(letter, chars, 32)[keep], doc[keep], letter[keep]
            lettered[[todo[d][0] for d in np.unique(doc[letter])]] = True
            self.seen[chars] = True
            alphabet = np.flatnonzero(self.seen)
            self.seen[alphabet] = False
            self.place[alphabet] = np.arange(len(alphabet))
            ids = self.place[chars]
            size, n = len(alphabet), self.order
            last = len(ids) - n + 1
            if last <= 0:
                continue
            code = ids[:last].copy()
            for k in range(1, n):
                code = code * size + ids[k : last + k]
            inside = doc[:last] == doc[n - 1 :]
            code, owner = code[inside], doc[:last][inside]
            if size**n <= 1 << 23:
                flags = np.zeros(size**n, bool)
                flags[code] = True
                grams = np.flatnonzero(flags)
                place = np.zeros(size**n, np.int32)
                place[grams] = np.arange(len(grams), dtype=np.int32)
                gram = place[code]
            else:
                grams, gram = np.unique(code, return_inverse=True)
            self._add(out, todo, owner, gram, grams, alphabet)
        return out, lettered

    def _add(self, out, todo, owner, gram, grams, alphabet, grams_at_once: int = 8192) -> None:
        base = self.letters(alphabet.tolist())
        size, n = len(alphabet), self.order
        rows = np.array([k for k, _ in todo])
        for at in range(0, len(grams), grams_at_once):
            part = grams[at : at + grams_at_once]
            bound = np.ones((len(part), self.dimensions), np.int8)
            for k in range(n):  # the k-th letter is rotated n - 1 - k times
                bound *= np.roll(base, n - 1 - k, axis=1)[(part // size ** (n - 1 - k)) % size]
            here = slice(None) if len(grams) <= grams_at_once else (gram >= at) & (gram < at + len(part))
            flat = owner[here] * len(part) + (gram[here] - at)
            counts = np.bincount(flat, minlength=len(todo) * len(part)).reshape(len(todo), len(part)).astype(np.float32)
            np.add.at(out, rows, counts @ bound.astype(np.float32))


def unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def learn_prototypes(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, rows_per_language: int = TRAIN_ROWS_PER_LANGUAGE, seed: int = 42) -> DataFrame:
    """(lang, vector): unit prototypes, learnt from at most about `rows_per_language` rows of each language, drawn by id and text hash.

    Rows without text or language are left out; so are languages whose rows have no letter.  No rows give no prototypes.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = cut(rows.groupBy("lang").agg(F.count("*").alias("rows")))
    few = sizes.limit(LANGUAGES_AT_ONCE + 1).count() <= LANGUAGES_AT_ONCE
    shared = rows.join(F.broadcast(sizes) if few else sizes, "lang")
    sample = shared.where(hash_share("id", seed, "text") < F.lit(float(rows_per_language)) / F.col("rows")).select("text", "lang").repartition(TRAIN_TASKS, F.xxhash64("text"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, totals = Bundler(), {}
        for batch in batches:
            vectors, _ = bundler.bundle(batch.column(0).to_pylist())
            whole = np.rint(unit(vectors.astype(float)) * UNITS).astype(np.int64)
            for lang, vector in zip(batch.column(1).to_pylist(), whole, strict=True):
                if lang in totals:
                    totals[lang] += vector
                else:
                    totals[lang] = vector.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.list_(pa.int64()))], names=["lang", "total"])

    parts = sample.mapInArrow(sums, "lang string, total array<long>")
    sums_at = parts.select("lang", F.posexplode("total").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    added = sums_at.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("total"))  # one row per dimension
    norm = F.sqrt(F.aggregate("total", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return cut(added.withColumn("norm", norm).where("norm > 0").select("lang", F.transform("total", lambda x: x / F.col("norm")).alias("vector")))


def identify(docs: DataFrame, prototypes: DataFrame, id_col: str = "doc_id", text_col: str = "text", languages_at_once: int = LANGUAGES_AT_ONCE) -> DataFrame:
    """One row per input row: (id, lang, score); no shuffle.

    `score` is the best cosine, 0 to 1.  Null texts, texts without a letter, and all texts if there are no
    prototypes, are `und` with score 0; ties go to the language that sorts first.  Long texts are read whole.
    Repeated rows are judged each.  An empty table gives an empty result; other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("score"))
    done = None
    while True:  # one pass unless there are more languages than one broadcast holds
        todo = prototypes if done is None else prototypes.where(F.col("lang") > done)
        block = todo.orderBy("lang").limit(languages_at_once).collect()
        if not block and done is not None:
            break
        languages = [r["lang"] for r in block]
        shared = spark.sparkContext.broadcast((languages, np.array([r["vector"] for r in block], float).reshape(-1, DIMENSIONS)))
        rows = rows.mapInArrow(_compare(shared), "id long, text string, lang string, score double")
        if len(block) < languages_at_once:
            break
        done = languages[-1]
    return rows.select("id", F.coalesce("lang", F.lit(UNDETERMINED)).alias("lang"), "score")


def _compare(shared):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, vectors = shared.value
        bundler = Bundler()
        for batch in batches:
            lang, score = batch.column(2), batch.column(3)
            if languages:
                made, lettered = bundler.bundle(batch.column(1).to_pylist())
                cosines = unit(made.astype(float)) @ vectors.T
                best, high = cosines.argmax(axis=1), np.round(np.clip(cosines.max(axis=1), 0, 1), 6)
                before = score.to_numpy()
                wins = lettered & (~lang.is_valid().to_numpy(zero_copy_only=False) | (high > before))
                lang = pa.array([languages[b] if w else old for b, w, old in zip(best, wins, lang.to_pylist(), strict=True)], pa.string())
                score = pa.array(np.where(wins, high, before))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lang, score], names=["id", "text", "lang", "score"])

    return compute
