"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.llm.base import stored
from repolens.llm.chat import BEGIN, CONTROL, END, digest, format_conversations, messages_as_events
from repolens.llm.decontamination import contamination, items_digest
from repolens.llm.html import main_text
from repolens.llm.licenses import train as train_licenses
from repolens.llm.licenses import with_licenses
from repolens.llm.packing import pack
from repolens.llm.pii import KINDS, spans_text, with_pii
from repolens.llm.pii import train as train_pii
from repolens.llm.pivot_index import near_duplicates as near_vectors
from repolens.llm.prefix_trie import sequences, trie, with_heads
from repolens.llm.quality import count, kept, threshold, with_scores
from repolens.llm.simhash import near_duplicates
from repolens.llm.token_files import token_files
from repolens.llm.toxicity import held_out, train, training_rows, with_toxicity
from repolens.llm.whitening import fit as fit_whitening
from repolens.llm.whitening import identity_error, with_whitened


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digest(format_conversations(messages_as_events(given.unionByName(planted))))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_licenses(docs, train_licenses(docs))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(
            "licenses", lambda f: f["confirmed"]), lambda f: f["family"]))), ",").alias("families"),
        F.array_join(F.transform("licenses", lambda f: F.concat_ws(
            ":", f["line"].cast("string"), f["family"], f["confirmed"].cast("string"))), ",").alias("lines"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files(_table(spark, sf_dir, "documents"))
    return read.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        items_digest().alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels")
    # Texts are scored once; the threshold and the verdicts come from the stored scores.
    scored = stored(with_scores(docs, count(docs, labels), held=True).drop("text"), "quality-scores")
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        kept(threshold(scored, labels)).alias("kept"), "quality_score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(_table(spark, sf_dir, "documents"))
    return packed.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id",
        F.col("offset").cast("long").alias("offset"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_pii(docs, train_pii(spark))

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(kind) for kind in KINDS], F.sha2(spans_text(F.col("base_spans")), 256).alias("base_sha256"),
        spans_text(F.col("pii_spans")).alias("spans"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, training_rows(_table(spark, sf_dir, "labels")))
    return with_toxicity(docs, model).select(
        "doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit_whitening(rows)
    if model is None:
        return spark.createDataFrame(
            [], "vec_id LONG, component INT, n LONG, deviation LONG, whitened DOUBLE, explained DOUBLE, identity_error DOUBLE")
    white = stored(with_whitened(rows, model).drop("embedding"), "whitened")
    error = identity_error(white, len(model.values))
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    return white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("value").alias("whitened"), explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stored(sequences(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "sequences")
    conv = F.col("conv_id")
    turns = F.crc32(conv.cast("string").cast("binary")) % 9
    return trie(with_heads(own, conv - conv % 5, turns, 8))


def op13_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return found.select("vec_id", "n_links", "component_id", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_licenses": op2_licenses,
    "op3_simhash": op3_simhash,
    "op4_token_files": op4_token_files,
    "op5_decontamination": op5_decontamination,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_pii": op8_pii,
    "op9_html": op9_html,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_pivot_index": op13_pivot_index,
}
# The escaped length: a backslash is doubled, a control string gets one more.
_ESCAPED = "(" + " + ".join(
    ["length({0})", "length({0}) - length(replace({0}, chr(92), ''))"]
    + [f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) / {len(c)}" for c in CONTROL]) + ")"

_OP1 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(BEGIN)} + 1 + {len(END)} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) AS BIGINT)
    AS formatted_chars
FROM turns GROUP BY conv_id
"""

_WORDS = (
    "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

_OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') AS key
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
found AS (SELECT r, size, i, item_id FROM places JOIN windows USING (size, key)),
hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM found) GROUP BY r),
items AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

# The checksum of a number's digits, bit by bit: SQL has no crc32.
_CRC = """
xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({0}) + 1),
  lambda p: ascii(substr({0}, p, 1))::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))))"""

_OP12 = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t,
    sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
    octet_length(encode(coalesce(text, ''))) AS size
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(struct_pack(k := k, size := size) ORDER BY t) AS turns FROM turns GROUP BY conv_id),
cut AS (SELECT conv_id, turns, CAST({_CRC.format("conv_id::VARCHAR")} % 9 AS BIGINT) AS h FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
paths AS (
  SELECT conv_id, len(turns) AS n_turns, d, sha256(array_to_string(list_transform(turns[1:d], lambda x: x.k), '')) AS node,
    CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(turns[1:d - 1], lambda x: x.k), '')) END AS parent,
    CASE WHEN d > 0 THEN turns[d].size ELSE 0 END AS size
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT node, d, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n_turns), '')) AS ends
  FROM paths GROUP BY node, d),
children AS (SELECT parent, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT a.node, a.d, sum(n.saved) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM nodes n JOIN paths a ON a.conv_id = n.conv_id AND a.d <= n.d
  LEFT JOIN children k ON k.parent = n.node AND k.d = n.d GROUP BY a.node, a.d)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.leaves AS n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN below b USING (node, d) LEFT JOIN children k ON k.parent = n.node AND k.d = n.d
LEFT JOIN nodes p ON p.node = n.parent AND p.d = n.d - 1
"""

# Every pair of a label: right for small tables.
_OP13 = """
WITH RECURSIVE given AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (
  SELECT * FROM given WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: isfinite(x))) = len(v)
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reached(u, w) AS (SELECT vec_id, vec_id FROM given UNION SELECT r.u, l.w FROM reached r JOIN links l ON l.u = r.w),
least AS (SELECT u, min(w) AS component_id FROM reached GROUP BY u)
SELECT g.vec_id, (SELECT count(*) FROM links l WHERE l.u = g.vec_id) AS n_links, component_id, component_id = g.vec_id AS kept
FROM given g JOIN least ON least.u = g.vec_id
"""

ORACLES: dict[str, str] = {
    "op1_chat": _OP1, "op5_decontamination": _OP5, "op12_prefix_trie": _OP12, "op13_pivot_index": _OP13}
