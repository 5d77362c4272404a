"""Quality rules: plain counts of a text, and a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed words and word pairs are counted, one over all trusted documents and one over the
whole corpus, in a table whose number of buckets grows with the corpus. A document's score is its mean log ratio of
the two, and one threshold, set on all labels, decides on every document. Only DataFrame functions are used.

Counting moves each text once, to its label; counts are combined before their own shuffle. Scoring moves nothing: the
ratios are one array, and a text's score is a sum over it in the projection that reads the text. For the threshold a
labelled document is scored by ratios that leave out the trusted documents of its own fold, its own text among them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.llm.base import bind, stored, text_of

#: Buckets of each order of n-grams: the power of two from this times the cube root of the corpus' characters, and at least
#: so many. At 30 GB these are 65,536 and at 100 TB 1,048,576, an array of 8 MB of floats for both orders.
BUCKETS_PER_ROOT, LEAST_BUCKETS = 16, 4_096
#: Parts that trusted documents are dealt into for the threshold.
FOLDS = 5
#: Pseudo-count of each bucket.
SMOOTHING = 1.0
#: Scores of labelled documents are counted to this many decimals for the threshold.
DECIMALS = 4
#: At most this share of the trusted documents may fall below the threshold.
MAX_LOST = 0.005

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
RULES = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"


def words_of(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(single: Column, window: int = 3) -> Column:
    """How many words, given by their hashes, stand in a window of words that occurs at least twice, the first occurrence included.

    Windows are compared by 64-bit hashes. They are sorted together with their positions in one number
    each: the upper bits of the hash, then 24 bits (31 in texts of over 16 million words) of position.
    """

    def of_hashes(hashes: Column) -> Column:
        shift = F.when(F.size(hashes) < (1 << 24), F.lit(1 << 24)).otherwise(F.lit(1 << 31)).cast("long")
        packed = bind(shift, lambda s: F.sort_array(F.transform(
            hashes, lambda h, i: h - F.pmod(h, s) + i)))

        def positions(sorted_: Column) -> Column:
            places = F.transform(sorted_, lambda x: F.pmod(x, shift).cast("int"))
            return bind(places, lambda at: F.sort_array(F.filter(F.transform(at, lambda p, i: F.when(
                (F.get(hashes, p) == F.get(hashes, F.get(at, i - 1))) | (F.get(hashes, p) == F.get(hashes, F.get(at, i + 1))),
                p)), lambda p: p.isNotNull())))

        def covered(found: Column) -> Column:
            ends = F.transform(found, lambda p, i: F.least(
                F.lit(window), F.coalesce(F.get(found, i + 1) - p, F.lit(window))))
            return F.aggregate(ends, F.lit(0), lambda a, n: a + n)

        # most texts have no repeated window: then nothing is sorted
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), bind(bind(packed, positions), covered)).otherwise(
            F.lit(0))

    windows = F.transform(F.slice(single, 1, F.size(single) - (window - 1)), lambda h, i: F.xxhash64(
        h, *[F.get(single, i + k) for k in range(1, window)]))
    return F.when(F.size(single) >= window, bind(windows, of_hashes)).otherwise(F.lit(0)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def with_rules(docs: DataFrame, given: Column | None = None, more: Callable[[Column, Column], list[Column]] | None = None) -> DataFrame:
    """The rows with the plain counts :data:`RULES` (columns of these names are replaced); null text has no words.

    ``more`` makes further columns out of ``given`` and the hashes of a text's words, which are computed once.
    """
    text = text_of()
    counts = bind(F.lit(0) if given is None else given, lambda g: bind(words_of(text), lambda words: bind(_hashed(words), lambda hashes: F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        repeated_words(hashes).alias("n_repeat_words"), *(more(g, hashes) if more else [])))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = docs.drop(*RULES, "rule_counts").withColumn("rule_counts", counts)
    added = [f.name for f in kept.schema["rule_counts"].dataType.fields[3:]]
    return kept.select(
        *[F.col(f"`{c}`") for c in kept.columns if c not in ("rule_counts", *added)],
        F.col("rule_counts.n_words"), F.col("rule_counts.word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"), F.col("rule_counts.n_repeat_words"),
        *[F.col(f"rule_counts.{c}") for c in added],
    ).withColumn("base_failed", failed)


def _bucket_count(docs: DataFrame) -> int:
    chars = docs.agg(F.sum(F.length(text_of()).cast("long")).alias("n")).first()["n"] or 0
    wanted = max(LEAST_BUCKETS, math.ceil(BUCKETS_PER_ROOT * chars ** (1 / 3)))
    return 1 << (wanted - 1).bit_length()


def _ngrams(hashes: Column, buckets: int) -> Column:
    """The buckets of a text's hashed words, and of each word with the next one (after those of single words)."""
    single = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    pairs = F.transform(hashes, lambda h, i: (F.pmod(
        F.xxhash64(h, F.coalesce(F.get(hashes, i + 1), F.lit(0).cast("long"))), F.lit(buckets)) + buckets).cast("int"))
    return F.concat(single, pairs)


def ngrams(text: Column, buckets: int) -> Column:
    """The buckets of a text's words and word pairs."""
    return bind(_hashed(words_of(text)), lambda hashes: _ngrams(hashes, buckets))


def _fold() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")


@dataclass(frozen=True)
class QualityModel:
    #: One row: ``ratios``, the ratio of each bucket, and ``held``, for each fold those counted without its trusted documents.
    ratios: DataFrame | None  # None: every ratio is zero
    buckets: int
    threshold: float = -math.inf


def _known(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("quality").cast("int")).alias("quality"))


def count(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """The ratios: n-grams of all ``docs`` against those of the trusted ones, and for each fold without its trusted documents.

    ``labels`` has ``doc_id`` and ``quality``; all are used, and the larger label of an id counts. Without trusted
    documents every ratio is zero.
    """
    size = _bucket_count(docs)
    # A hash join at any size: it needs no sorted texts, and its plan does not change with the number of labels.
    marked = docs.select("doc_id", text_of().alias("text")).join(_known(labels).hint("shuffle_hash"), "doc_id", "left").select(
        F.when(F.col("quality") == 1, _fold()).alias("fold"), "text")
    grams = marked.select("fold", F.explode(ngrams(F.col("text"), size)).alias("bucket"))
    found = grams.groupBy("bucket").agg(
        F.count("bucket").alias("raw"), *[F.count(F.when(F.col("fold") == f, 1)).alias(f"t{f}") for f in range(FOLDS)])
    counts = stored(docs.sparkSession.range(2 * size).select(F.col("id").cast("int").alias("bucket")).join(
        found, "bucket", "left").na.fill(0), "quality-counts")
    order = (F.col("bucket") >= size).cast("int")
    names = ["raw", *[f"t{f}" for f in range(FOLDS)]]
    sums = {r["k"]: r for r in counts.groupBy(order.alias("k")).agg(*[F.sum(c).alias(c) for c in names]).collect()}
    if not any(sums[k][c] for k in sums for c in names[1:]):
        return QualityModel(None, size)

    def ratio(left_out: set[int]) -> Column:
        used = [f"t{f}" for f in range(FOLDS) if f not in left_out]
        trusted = sum((F.col(c) for c in used), F.lit(0))
        rest = [math.log(sums[k]["raw"] + SMOOTHING * size) - math.log(sum(sums[k][c] for c in used) + SMOOTHING * size) for k in (0, 1)]
        return (F.log(trusted + SMOOTHING) - F.log(F.col("raw") + SMOOTHING) + F.when(order == 0, rest[0]).otherwise(rest[1])).cast("float")

    rows = counts.select(F.struct("bucket", ratio(set()).alias("r"), *[ratio({f}).alias(f"r{f}") for f in range(FOLDS)]).alias("b"))
    table = rows.agg(F.array_sort(F.collect_list("b")).alias("b")).select(
        F.col("b.r").alias("ratios"),
        F.array(*[F.col(f"b.r{f}") for f in range(FOLDS)]).alias("held"))
    return QualityModel(stored(table, "quality-ratios"), size)


def with_scores(docs: DataFrame, model: QualityModel, held: bool = False) -> DataFrame:
    """The rows with :data:`RULES` and ``quality_score``, the mean log ratio of a text's n-grams, 0 without words.

    ``held`` adds ``held_score``, by the ratios that leave out the trusted documents of the row's fold. Texts stay where
    they are read; columns of these names are replaced.
    """
    names = ["quality_score", *["held_score"] * held]
    docs = docs.drop(*names)
    if model.ratios is None:
        return with_rules(docs).withColumns({n: F.lit(0.0) for n in names})
    tables = [model.ratios.select("ratios").scalar()]
    if held:
        tables.append(F.get(model.ratios.select("held").scalar(), F.coalesce(_fold(), F.lit(0))))

    def scores(given: Column, hashes: Column) -> list[Column]:
        def mean(buckets: Column, table: int) -> Column:
            total = bind(F.get(given, F.lit(table)), lambda t: F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(t, b)))
            return total / F.greatest(F.size(buckets), F.lit(1))

        found = bind(_ngrams(hashes, model.buckets), lambda b: F.array(*[mean(b, i) for i in range(len(names))]))
        return [found.alias("quality_scores")]

    # The tables' only mention: the optimizer puts the subquery in its place, so that no row carries a table.
    given = docs.drop("quality_scores", "quality_tables").withColumn("quality_tables", F.array(*tables))
    out = with_rules(given, F.col("quality_tables"), scores).drop("quality_tables")
    return out.withColumns({n: F.get("quality_scores", F.lit(i)) for i, n in enumerate(names)}).drop("quality_scores")


def threshold(scored: DataFrame, labels: DataFrame, max_lost: float = MAX_LOST) -> float:
    """The score that parts the labels of ``(doc_id, base_failed, held_score)`` rows best among those that lose at most
    ``max_lost`` of the trusted documents. Rows that fail the plain rules have no say; only ids and scores meet the labels.
    """
    rows = scored.filter(~F.col("base_failed")).select("doc_id", F.round("held_score", DECIMALS).alias("score")).join(_known(labels), "doc_id")
    found = rows.groupBy("score").agg(F.count(F.when(F.col("quality") == 1, True)).alias("good"), F.count("quality").alias("n"))
    ranked = sorted((r["score"], r["good"], r["n"] - r["good"]) for r in found.collect())
    good, bad = sum(g for _, g, _ in ranked), sum(b for *_, b in ranked)
    best, least, lost, caught = 0.0, -math.inf, 0, 0
    for k, (score, n_good, n_bad) in enumerate(ranked):
        lost, caught = lost + n_good, caught + n_bad
        if lost > max_lost * good:
            break
        gain = caught / max(bad, 1) - lost / max(good, 1)
        if gain > best:
            best, least = gain, (score + ranked[k + 1][0]) / 2 if k + 1 < len(ranked) else score + 1.0
    return least


def train(docs: DataFrame, labels: DataFrame, max_lost: float = MAX_LOST) -> QualityModel:
    """:func:`count` the corpus and set the :func:`threshold`. Without trusted documents every document passes."""
    model = count(docs, labels)
    if model.ratios is None:
        return model
    scored = with_scores(docs.select("doc_id", "text"), model, held=True).select("doc_id", "base_failed", "held_score")
    return replace(model, threshold=threshold(scored, labels, max_lost))


def kept(least: float) -> Column:
    """Whether a scored row passes the plain rules and scores at least so much."""
    return ~F.col("base_failed") & (F.col("quality_score") >= F.lit(least))


def with_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows with :data:`RULES`, ``quality_score`` and ``kept`` (columns of these names are replaced).

    A document is kept if it passes the plain rules and scores at least the threshold. Null text is empty and fails;
    repeated rows and null ids stay.
    """
    return with_scores(docs.drop("kept"), model).withColumn("kept", kept(model.threshold))
