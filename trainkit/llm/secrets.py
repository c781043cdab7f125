"""Secret scan: wide candidate patterns, then a random forest that takes out false positives.

Candidates are strings with a digit, or values assigned to a telling name, found by one pass over the whole
texts.  The forest sees length, character classes and transitions, the share covered by dictionary words,
the path, and the neighbouring words.  It is trained from labelled findings; where none are given, findings
of an unmistakable format are labelled by `label_by_format` (keys of fixed shape are secrets; addresses,
phone and card numbers are not) and the forest carries the judgement over to all other candidates.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainkit.llm.common import cut, forget, map_rows

TRAIN_FINDINGS = 50_000  # bound of the labelled findings that the forest is trained on
DICTIONARY_SHARE = 1 / 2000  # of all documents have a dictionary word; so there are at most 2000 times a document's mean distinct words
TREES, DEPTH = 20, 6
WORDS_BEFORE, WORDS_AFTER = 3, 2  # neighbouring words that are kept, whole
TRAIN_TASKS = 8
BATCH_ROWS, BATCH_CHARS = 10_000, 8 << 20  # of candidates that a task holds at once

# Names that announce a secret, words around harmless numbers, path words of examples.
TELLING = frozenset("password passwd pwd secret token apikey api key auth bearer credential credentials access private signature".split())
HARMLESS = frozenset("phone tel fax mobile card visa isbn ip version date order invoice id".split())
EXAMPLE_PATHS = frozenset("test tests example examples sample samples demo doc docs fixture fixtures mock".split())

CANDIDATE = re.compile(
    r"(?i:(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)(?:[_-][a-z0-9]{1,20}){0,3}\s*[:=]\s*[\"']?)(?P<value>[^\s\"',;]{6,})"
    r"|(?<![A-Za-z0-9+/_.-])(?P<plain>(?=[A-Za-z+/_.-]*[0-9])[A-Za-z0-9+/_.-]{8,}={0,2})"
)
WORD = re.compile(r"[^\W\d_]+")
LEADING = frozenset(" \t\n\r\f\v:='\"")  # signs between a name and its value
HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")

#: Unmistakable formats: (regular expression over "text before + candidate", label).
FORMATS = [
    (r"AKIA[0-9A-Z]{16}$", 1.0),
    (r"token\s*[:=]\s*[\"']?[0-9a-f]{40}$", 1.0),
    (r"password\s*[:=]\s*[\"']?[0-9a-f]{12,}$", 1.0),
    (r"(^|[^0-9.])[0-9]{1,3}(\.[0-9]{1,3}){3}\.?$", 0.0),
    (r"(^|[^0-9A-Za-z])[0-9]{13,19}\.?$", 0.0),
    (r"(^|[^0-9A-Za-z])\+?[0-9(][0-9() .-]{6,}[0-9]\.?$", 0.0),
]
NAMES = (
    "length digits uppers lowers signs class_changes letter_digit_changes vowel_changes entropy distinct dictionary hex longest_digits telling harmless assigned quoted example_path".split()
)


def find(text: str | None) -> list[tuple[int, str, str, str]]:
    """(position, candidate, before, after) of every candidate.

    `before` has the last words before it, however far away, and the signs directly before it: blanks, quotes, `:` and `=`, with one sign more in front of
    them; `after` has the next words.  What else lies between isn't copied, so a text's candidates take space in proportion to it.
    """
    out, words = [], None
    for m in CANDIDATE.finditer(text or ""):
        if words is None:
            words = [w.span() for w in WORD.finditer(text)]
            stops = [b for _, b in words]
        kind = "value" if m["value"] else "plain"
        a, b = m.span(kind)
        left = bisect.bisect_right(stops, a)  # words that end before the candidate
        right = bisect.bisect_left(words, (b, b))
        last, start = stops[left - 1] if left else 0, a
        while start > last and text[start - 1] in LEADING:
            start -= 1
        start = max(last, start - 1)
        near = " ".join(text[i:j] for i, j in words[max(0, left - WORDS_BEFORE) : left])
        out.append((a, m[kind], near + (" " if near and start > last else "") + text[start:a], " ".join(text[i:j] for i, j in words[right : right + WORDS_AFTER])))
    return out


def _class_of(c: str) -> str:
    return "d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s"


def covered(value: str, dictionary: frozenset[str]) -> float:
    """Share of the characters inside dictionary words of three letters or more, longest first from the left."""
    text, at, hit = value.lower(), 0, 0
    while at < len(text):
        for stop in range(min(len(text), at + 16), at + 2, -1):
            if text[at:stop] in dictionary:
                hit += stop - at
                at = stop
                break
        else:
            at += 1
    return hit / max(1, len(text))


def features(value: str, before: str, after: str, path: str, dictionary: frozenset[str]) -> list[float]:
    n = len(value)
    classes = [_class_of(c) for c in value]
    pairs = list(zip(classes, classes[1:], strict=False))
    vowels = [c in "aeiouAEIOU" for c in value]
    counts = Counter(value)
    near = {w.lower() for w in WORD.findall(before)[-WORDS_BEFORE:]} | {w.lower() for w in WORD.findall(after)[:WORDS_AFTER]}
    lead = before.rstrip()
    return [
        float(n),
        classes.count("d") / n,
        classes.count("u") / n,
        classes.count("l") / n,
        classes.count("s") / n,
        sum(a != b for a, b in pairs) / max(1, n - 1),
        sum("d" in p and p != ("d", "d") for p in pairs) / max(1, n - 1),
        sum(a != b for a, b in zip(vowels, vowels[1:], strict=False)) / max(1, n - 1),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        len(counts) / n,
        covered(value, dictionary),
        float(HEX.fullmatch(value) is not None and not value.isdigit()),
        max((len(d) for d in re.findall(r"\d+", value)), default=0) / n,
        float(bool(near & TELLING)),
        float(bool(near & HARMLESS)),
        float(lead[-1:] in ("=", ":") or lead[-2:-1] in ("=", ":")),
        float(before[-1:] in ("'", '"')),
        float(bool({w.lower() for w in WORD.findall(path)} & EXAMPLE_PATHS)),
    ]


def _found_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    for k, text in enumerate(batch.column(2)):
        for found in find(text.as_py()):
            yield (k, *found)


def _find_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates in batches of bounded rows and characters."""

    def made(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at = pa.array([r[0] for r in rows])
        columns = [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.string()), (3, pa.string()), (4, pa.string()))]
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=["id", "path", "position", "value", "before", "after"])

    for batch in batches:
        held, size = [], 0
        for row in _found_rows(batch):
            held.append(row)
            size += sum(map(len, row[2:])) + len(batch.column(1)[row[0]].as_py())
            if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
                yield made(batch, held)
                held, size = [], 0
        if held:
            yield made(batch, held)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(id, path, position, value, before, after): one row per candidate string of the whole texts; no shuffle."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), path.alias("path"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_find_all, "id long, path string, position long, value string, before string, after string")


def label_by_format() -> Column:
    """1.0 or 0.0 for findings of an unmistakable format, else null."""
    seen = F.concat("before", "value")
    label = F.lit(None).cast("double")
    for pattern, value in reversed(FORMATS):
        label = F.when(seen.rlike(pattern), F.lit(value)).otherwise(label)
    return label


def dictionary_of(docs: DataFrame, text_col: str, share: float = DICTIONARY_SHARE) -> frozenset[str]:
    """The words of 3 to 16 letters that at least `share` of all documents have, and at least two; counted over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter()
            for text in batch.column(0).to_pylist():
                seen.update({w for w in WORD.findall((text or "").lower()) if 3 <= len(w) <= 16})
            seen[""] = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counted = cut(docs.select(F.col(text_col)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    rows = counted.where("word = ''").agg(F.sum("n")).first()[0] or 0
    words = frozenset(r["word"] for r in counted.where((F.col("n") >= F.lit(max(2.0, share * rows))) & (F.col("word") != "")).collect())
    forget(counted)
    return words


def _describe(shared) -> Callable:
    def judge(inputs: list[pa.Array]) -> list[pa.Array]:
        rows = zip(*[x.to_pylist() for x in inputs], strict=True)
        return [pa.array([features(v, b, a, p, shared.value) for v, b, a, p in rows], pa.list_(pa.float64()))]

    return judge


def scan(
    docs: DataFrame,
    findings: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str | None = "source",
    train_findings: int = TRAIN_FINDINGS,
    seed: int = 42,
) -> DataFrame:
    """One row per candidate: (id, position, value, probability, is_secret).

    `findings`: labelled findings (id, position, label 0/1) to train from; without it, formats label them.  At most
    about `train_findings` are used, drawn by hash.  If the labels know one class only, that is every
    candidate's verdict; without any label, nothing is a secret.  Null and empty texts have no candidates; a
    null path counts as empty; very long texts are scanned whole; repeated rows are scanned each, equal candidates get
    equal verdicts; other columns are left out, whatever their names.  An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionary_of(docs, text_col))
    found = candidates(docs, id_col, text_col, path_col)
    columns = ["id", "position", "value", "before"]
    described = cut(
        map_rows(found, [F.col(c) for c in columns], [F.col(c) for c in ("value", "before", "after", "path")], lambda: _describe(shared), "traits array<double>")
        .toDF(*columns, "traits")
        .withColumn("features", array_to_vector("traits"))
        .drop("traits")
    )
    if findings is None:
        labelled = described.withColumn("label", label_by_format())
    else:
        given = findings.select(F.col("id").cast("long"), F.col("position").cast("long"), F.col("label").cast("double")).groupBy("id", "position").agg(F.max("label").alias("label"))
        labelled = described.join(given, ["id", "position"], "left")
    known = labelled.where("label IS NOT NULL")
    n, low, high = known.agg(F.count("*"), F.min("label"), F.max("label")).first()
    if low == high:
        return described.select("id", "position", "value", F.lit(high or 0.0).alias("probability"), F.lit(bool(high)).alias("is_secret"))
    share = F.pmod(F.xxhash64(F.lit(seed), "id", "position"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(share < min(1.0, train_findings / n)).repartition(TRAIN_TASKS, "id").sortWithinPartitions("id", "position", "value")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(sample.select("features", "label"))
    judged = forest.transform(described)
    return judged.select(
        "id", "position", "value", F.round(vector_to_array("probability")[1], 6).alias("probability"), (F.col("prediction") == 1.0).alias("is_secret")
    )
