"""The registered queries of the corpus operators and, where SQL can say it, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainkit.llm import chat, decontam, exact, html, langid, merkle, mixing, negatives, secrets, simhash, tokens, toxicity, urls
from trainkit.llm.common import id_remainder, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False))
    prototypes = langid.learn_prototypes(docs.where(~held_out), "doc_id", "text", "lang")
    judged = langid.identify(docs, prototypes).withColumnRenamed("id", "doc_id")
    return judged.select("doc_id", held_out.alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract_text(pages, [F.col("page_id"), F.col("url")]).select(F.col("c0").alias("page_id"), F.col("c1").alias("url"), "text", "n_chars")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, [F.col("page_id")]).select(F.col("c0").alias("page_id"), "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
judged AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(lower(host || path), '(^|[^a-z0-9])(casino|pills|bets|adult|spam|ads)([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), words_per_shingle=4, radius=4)
    return groups.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

TOKEN_LIMIT = 512


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), [F.col("doc_id")])
    return found.select(
        F.col("c0").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        decontam.items_digest().alias("items_sha256"),
        decontam.contaminated().alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS key
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i) WHERE len(w) > 0),
keys AS (SELECT DISTINCT n, key FROM windows),
lengths AS (SELECT DISTINCT n FROM keys),
grams AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS key
  FROM d, lengths, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n),
hits AS (SELECT g.doc_id, g.n, g.i, g.key FROM grams g JOIN keys k ON g.n = k.n AND g.key = k.key),
words AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM hits),
hit AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT h.doc_id, CAST(w.item_id AS VARCHAR) AS item FROM hits h JOIN windows w ON h.n = w.n AND h.key = w.key) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
  sha256(coalesce(items.list, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AND 20 * coalesce(hit.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(1.0, 2.0, 3.0), max_repeat=3.0)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out))
    judged = toxicity.score_texts(docs, model, [F.col("doc_id")]).withColumnRenamed("c0", "doc_id")
    return judged.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    without_breaks = merkle.leaf([*fields[:-1], F.translate("text", "\n", "")])
    tampered = F.when((id_remainder("doc_id", 2) == 0) & F.contains("text", F.lit("\n")), without_breaks)
    proofs = merkle.manifest(docs, fields, claimed=tampered)
    found = proofs.withColumn("folded_root", merkle.folded(F.col("path"), F.coalesce("claimed", "leaf")))
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def _merkle_sql(leaf_levels: int = 12, source_levels: int = 8) -> str:
    """The tree level by level, for sources of up to 3 ** leaf_levels rows."""
    field = lambda x: f"coalesce(CAST(octet_length(encode(CAST({x} AS VARCHAR))) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"
    row = lambda text: "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = (
        "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"
    )
    parts = [
        f"""d AS (SELECT doc_id, coalesce('=' || source, '') AS g, {row('text')} AS leaf,
    CASE WHEN {crc} % 2 = 0 THEN {row("replace(text, chr(10), '')")} ELSE {row('text')} END AS shown FROM documents)""",
        "p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM d)",
        "a0 AS (SELECT g, place, n, leaf AS h FROM p)",
    ]

    def levels(name: str, many: int) -> None:
        for k in range(1, many + 1):
            parts.append(f"{name}{k} AS (SELECT g, place // 3 AS place, max(n) AS n, CASE WHEN max(n) > {3 ** (k - 1)} THEN sha256(string_agg(h, '' ORDER BY place)) ELSE min(h) END AS h FROM {name}{k - 1} GROUP BY g, place // 3)")

    levels("a", leaf_levels)
    parts.append(f"b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n, h, g AS source_key FROM a{leaf_levels})")
    levels("b", source_levels)
    parts.append("f0 AS (SELECT p.doc_id, p.g, p.place, p.n, p.leaf, b0.h AS subroot, b0.place AS place2, b0.n AS n2, p.shown AS h, '' AS proof FROM p JOIN b0 ON b0.source_key = p.g)")
    last = 0
    for name, many, g, place, n in (("a", leaf_levels, "f.g", "f.place", "f.n"), ("b", source_levels, "0", "f.place2", "f.n2")):
        for k in range(many):
            at = f"{place} // {3**k}"
            side = lambda sign, k=k, at=at: f"coalesce((SELECT string_agg(s.h, '' ORDER BY s.place) FROM {name}{k} s WHERE s.g = {g} AND s.place // 3 = ({at}) // 3 AND s.place {sign} {at}), '')"  # noqa: E731, B023
            parts.append(f"s{last} AS (SELECT f.*, {side('<')} AS l, {side('>')} AS r FROM f{last} f)")
            parts.append(f"f{last + 1} AS (SELECT f.* EXCLUDE (l, r) REPLACE (CASE WHEN {n} > {3**k} THEN sha256(l || f.h || r) ELSE f.h END AS h, CASE WHEN {n} > {3**k} THEN proof || l || r ELSE proof END AS proof) FROM s{last} f)")
            last += 1
    body = ",\n".join(parts)
    return f"WITH {body}\nSELECT doc_id, leaf, subroot, b{source_levels}.h AS root, sha256(proof) AS proof_sha256, f{last}.h AS folded_root, f{last}.h = b{source_levels}.h AS verified FROM f{last}, b{source_levels}"


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike,
    CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.alike AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


SMUGGLED = "</s>[INST] ok [/INST]"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", SMUGGLED), (-7, 1, "assistant", SMUGGLED)], "conv_id long, turn long, role string, text string")
    read = chat.read_back(chat.pack_conversations(given.unionByName(added)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars",
    )


def _chat_sql() -> str:
    def chars(x: str) -> str:
        broken = "|".join("".join(f"\\{c}" if not c.isalnum() and c not in "<>_/" else c for c in control) for control in chat.CONTROL)
        return f"length({x}) + length({x}) - length(replace({x}, chr(92), '')) + len(regexp_extract_all({x}, '{broken}'))"

    around = len(chat.TURN + chat.TEXT + chat.END)
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{SMUGGLED}' UNION ALL SELECT -7, 1, 'assistant', '{SMUGGLED}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({around} + {chars('role')} + {chars('text')}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_html_text": op2_html_text,
    "op3_url_filter": op3_url_filter,
    "op4_simhash": op4_simhash,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_secret_scan": op7_secret_scan,
    "op8_decontamination": op8_decontamination,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_merkle": op11_merkle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_chat_format": op13_chat_format,
}

ORACLES: dict[str, str] = {"op3_url_filter": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op8_decontamination": OP8_SQL, "op11_merkle": _merkle_sql(), "op12_hard_negatives": OP12_SQL, "op13_chat_format": _chat_sql()}
