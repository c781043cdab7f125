"""Token counts of a byte-level BPE by rank-synchronous array merging.

A batch's new pre-tokens are laid out as one ragged numpy array of symbols.  In each round every sequence
finds its lowest-ranked pair and all its occurrences are merged, in all sequences at once, until no known
pair is left; the surviving symbols are counted.  This equals merging one pair at a time because a merge
always ranks after the merges that made its two parts, which is checked when the file is loaded.
Counts of pre-tokens are remembered per worker, up to a bound.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the byte-level pre-tokenizer: its pattern with white space as Unicode defines it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{WHITE}\\p{{L}}\\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

REMEMBERED = 400_000  # pre-tokens whose counts a worker keeps
SYMBOLS_AT_ONCE = 1 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Merge ranks of a tokenizer file: pair (left id, right id) -> (rank, merged id)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids = spec["model"]["vocab"]
        self.first = np.array([ids[c] for c in byte_letters()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.width = len(ids)
        left, right = (np.array([ids[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([ids[p[0] + p[1]] for p in pairs], np.int64)
        keys = left * self.width + right
        keys, first = np.unique(keys, return_index=True)
        rank_of = np.full(self.width, -1, np.int64)
        rank_of[made[::-1]] = np.arange(len(pairs))[::-1]
        if (np.maximum(rank_of[left], rank_of[right]) >= np.arange(len(pairs))).any():
            raise ValueError(f"{path}: a merge ranks before the merges of its parts")
        self.bits = int(2 * len(keys)).bit_length() + 1
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, np.iinfo(np.int32).max, np.int64)
        self.made = made
        at = self._slot(keys)
        waiting = np.arange(len(keys))
        while len(waiting):  # open addressing, one round of claims at a time
            free = self.slots[at[waiting]] < 0
            claim = waiting[free]
            self.slots[at[claim]] = keys[claim]
            won = self.slots[at[waiting]] == keys[waiting]
            self.ranks[at[waiting[won]]] = first[waiting[won]]
            waiting = waiting[~won]
            at[waiting] = (at[waiting] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; a number above all ranks for none."""
        keys = left * self.width + right
        at = self._slot(keys)
        out = np.full(len(keys), np.iinfo(np.int32).max, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            found = self.slots[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
        return out

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols left of each byte sequence after all merges."""
        counts = np.zeros(len(sequences), np.int64)
        at = 0
        while at < len(sequences):
            stop, total = at, 0
            while stop < len(sequences) and (stop == at or total + len(sequences[stop]) <= SYMBOLS_AT_ONCE):
                total += len(sequences[stop])
                stop += 1
            counts[at:stop] = self._merge(sequences[at:stop])
            at = stop
        return counts

    def _merge(self, sequences: list[bytes]) -> np.ndarray:
        none = np.iinfo(np.int32).max
        symbols = self.first[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
        counts = np.bincount(owner, minlength=len(sequences))
        rank = None
        while len(symbols) > 1:
            if rank is None:
                rank = np.full(len(symbols), none, np.int64)
                inside = np.flatnonzero(owner[1:] == owner[:-1])
                rank[inside] = self.rank(symbols[inside], symbols[inside + 1])
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(symbols)))
            alive = lowest < none
            if not alive.all():  # sequences without a known pair are finished
                keep = np.repeat(alive, sizes)
                symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
                lowest, sizes = lowest[alive], sizes[alive]
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == np.repeat(lowest, sizes))
            # In a run of overlapping hits (a a a a) every second one counts, from the left.
            run = np.concatenate([[True], hits[1:] != hits[:-1] + 1])
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - begin) % 2 == 0]
            symbols[hits] = self.made[rank[hits]]
            counts -= np.bincount(owner[hits], minlength=len(sequences))
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            moved = np.zeros(len(symbols), bool)
            moved[hits] = True
            symbols, owner, rank, moved = symbols[keep], owner[keep], rank[keep], moved[keep]
            changed = np.flatnonzero(moved)
            stale = np.unique(np.concatenate([changed, changed[changed > 0] - 1]))
            rank[stale] = none
            inside = stale[stale + 1 < len(symbols)]
            inside = inside[owner[inside] == owner[inside + 1]]
            rank[inside] = self.rank(symbols[inside], symbols[inside + 1])
        return counts


class TokenCounter:
    """Counts tokens of texts; special strings inside a text are one token each."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.pieces = regex.compile(PATTERN).findall
        special = [regex.escape(s) for s in self.vocabulary.special]
        self.special = regex.compile("|".join(special)) if special else None
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        out, pieces = [], []
        for text in texts:
            extra = 0
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                extra = len(parts) - 1
                found = [p for part in parts for p in self.pieces(part)]
            else:
                found = self.pieces(text)
            out.append(extra)
            pieces.append(found)
        known = self.known
        fresh = list(set().union(*pieces).difference(known))
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = list(set().union(*pieces))
        known.update(zip(fresh, self.vocabulary.count([p.encode() for p in fresh]).tolist(), strict=True))
        return [n + sum(map(known.__getitem__, found)) for n, found in zip(out, pieces, strict=True)]


_COUNTERS: dict[str, TokenCounter] = {}


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", texts_at_once: int = 256) -> DataFrame:
    """One row per input row: (id, n_bytes, n_tokens); no shuffle.

    `vocabulary_path`: a byte-level BPE in the json form of the tokenizers library, readable on every executor.
    Null texts count as empty: 0 bytes, 0 tokens.  Very long texts are counted whole.  An empty table gives an
    empty result; other columns are left out.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary_path not in _COUNTERS:
            _COUNTERS[vocabulary_path] = TokenCounter(vocabulary_path)
        counter = _COUNTERS[vocabulary_path]
        for batch in batches:
            for at in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(at, texts_at_once)
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counter.counts(texts), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), n_bytes.alias("n_bytes"))
    return rows.mapInArrow(compute, "id long, n_bytes long, n_tokens long")
