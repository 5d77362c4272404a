"""Toxic passages as maximum-scoring segments of token log-odds.

Training compares token counts of toxic and other labelled documents. Every token scores its log-odds ratio,
shrunk towards zero by a Dirichlet prior, less a drift that keeps chance segments short; no token is left out for
being rare, so a language with few labels has its words too. One pass over a text finds all maximal-scoring segments.
Under chance the best segment of n tokens follows an extreme value law, fitted on documents without the label; it
gives each segment an expected number of chance hits. The significant ones are added up and a logistic curve turns
the sum into a score. Law and curve are fitted on scores that leave out the document's own label.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.llm.base import stored, text_of, with_fields

#: At most about this many labelled documents are used for training, chosen by a hash of their id.
MAX_LABELLED = 20_000
#: Pseudo-count of the prior of each token in documents, divided among the kinds as all counts are.
PRIOR = 10.0
#: The drift lies so many standard deviations above the mean score of a token in a document without the label.
DRIFT = 4.0
#: Smallest drift.
MIN_DRIFT = 0.1
#: Segments with at most this many expected chance hits in their text are significant.
MAX_EXPECTED = 0.5
#: Bound of the extreme value law's rate.
MAX_RATE = 5.0

# Letters and digits in lower case stay, other ASCII characters divide words.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SEGMENTS = "ARRAY<STRUCT<start: INT, end: INT, score: DOUBLE, expected: DOUBLE>>"


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of other characters beyond ASCII."""
    return (text or "").encode().translate(_TABLE).split()


def token_column(text: Column) -> Column:
    """The same tokens as :func:`tokens`, as an array of strings."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda t: t != "")


def maximal_segments(scores: list[tuple[int, float]], background: float) -> list[tuple[int, int, float]]:
    """``(start, end, score)`` of all maximal-scoring segments (Ruzzo and Tompa), ``end`` exclusive.

    ``scores`` has the positions and scores of the known tokens, above zero or not; every other token scores
    ``background`` below zero. Linear in the number of known tokens, as each is put on the list at most once
    and each merge takes one off.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, end, total before it and with it, link
    total, last = 0.0, 0
    for position, score in scores:
        total += background * (position - last)
        last = position + 1
        if score <= 0:
            total += score
            continue
        start, before, total = position, total, total + score
        k = len(found) - 1
        while True:
            while k >= 0 and found[k][2] >= before:  # to the nearest earlier segment that begins at a lower total
                k = found[k][4]
            if k < 0 or found[k][3] >= total:
                break
            start, before, k = found[k][0], found[k][2], found[k][4]
            while len(found) and found[-1][0] >= start:  # merged: it takes in all since that segment
                found.pop()
        found.append((start, position + 1, before, total, k))
    return [(start, end, after - before) for start, end, before, after, _ in found]


@dataclass(frozen=True)
class ToxicityModel:
    known: dict[bytes, float]  # the score of each token of the training documents
    background: float  # of all others
    rate: float  # of the extreme value law
    scale: float  # expected chance hits of score 0 or more in one token
    weight: float  # of the logistic curve
    bias: float

    @property
    def scores(self) -> dict[bytes, float]:
        """The tokens that score above zero, each a sign of toxic text by itself."""
        return {token: score for token, score in self.known.items() if score > 0}

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float, float]]]:
        """The number of tokens and the segments with their expected chance hits, significant or not."""
        words = tokens(text)
        get = self.known.get
        hits = [(i, s) for i, s in enumerate(map(get, words)) if s is not None]
        n = max(len(words), 1)
        return len(words), [
            (start, end, score, float(min(self.scale * n * np.exp(-self.rate * score), n)))
            for start, end, score in maximal_segments(hits, self.background)]

    def evidence(self, segments: list[tuple[int, int, float, float]]) -> float:
        """Minus the logarithm of the expected hits, added over the significant segments."""
        return float(sum(-np.log(max(e, 1e-30)) for *_, e in segments if e <= MAX_EXPECTED))

    def probability(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-(self.weight * evidence + self.bias))))


def _token_counts(labelled: DataFrame) -> dict[bytes, tuple[int, int]]:
    """How many toxic and other documents each token is in.

    A token counts once a document, so that a text that repeats one word over and over has no say.
    """
    words = labelled.select("toxic", F.explode(F.array_distinct(token_column(F.col("text")))).alias("token"))
    toxic = F.count(F.when(F.col("toxic") == 1, True))
    rows = words.groupBy("token").agg(toxic.alias("t"), (F.count("toxic") - toxic).alias("c")).toArrow()
    pairs: dict[tuple[int, int], tuple[int, int]] = {}  # equal pairs are one object
    return {
        token.encode(): pairs.setdefault(pair, pair)
        for token, *counts in zip(rows["token"].to_pylist(), rows["t"].to_pylist(), rows["c"].to_pylist(), strict=True)
        for pair in [tuple(counts)]}


@dataclass(frozen=True)
class _Odds:
    """Scores of tokens by their counts."""

    share: float  # of toxic documents in all counts
    prior: float
    drift: float = 0.0

    def score(self, t: int, c: int) -> float:
        """The shrunk log-odds ratio of a token in t toxic and c other documents, less the drift."""
        return log((t + self.prior * self.share) / (c + self.prior * (1 - self.share)) * (1 - self.share) / self.share) - self.drift


def _odds(counts: dict[bytes, tuple[int, int]], prior: float, drift: float) -> _Odds | None:
    """None where one kind of documents has no token.

    The drift is taken from the scores of the tokens of documents without the label, each without that document.
    """
    n_t, n_c = (sum(pair[k] for pair in counts.values()) for k in (0, 1))
    if not n_t or not n_c:
        return None
    plain = _Odds(n_t / (n_t + n_c), prior)
    groups = Counter(counts.values())
    scores = [(n * c, plain.score(t, c - 1)) for (t, c), n in groups.items() if c]
    mean = sum(n * s for n, s in scores) / n_c
    spread = sqrt(sum(n * (s - mean) ** 2 for n, s in scores) / n_c)
    return _Odds(plain.share, prior, max(MIN_DRIFT, mean + drift * spread))


def _law(best: np.ndarray, lengths: np.ndarray) -> tuple[float, float]:
    """Rate and scale of the extreme value law of the best segment by moments; lengths are shifted away.

    Where no document has a chance segment the law is as steep as it may be.
    """
    if len(best) < 2 or best.std() == 0:
        return MAX_RATE, 1e-3
    rate = min(MAX_RATE, max(0.05, np.pi / (best.std() * np.sqrt(6))))
    location = (best - np.log(np.maximum(lengths, 1)) / rate).mean() - np.euler_gamma / rate
    return float(rate), float(np.exp(rate * location))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Weight and bias of a logistic curve by Newton's method with a small ridge."""
    w = np.array([0.0, np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))])
    features = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-features @ w))
        gradient = features.T @ (p - y) + 1e-3 * w * [1, 0]
        curve = (features * (p * (1 - p))[:, None]).T @ features + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        w -= np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def train(
    docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, prior: float = PRIOR, drift: float = DRIFT,
) -> ToxicityModel:
    """A model from ``(doc_id, text)`` and ``(doc_id, toxic)`` rows.

    Rows with a null id or label teach nothing; an id labelled more than once counts with its
    largest label. Without documents of both kinds every text scores the share of toxic labels (half without any).
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = min(1.0, max_labelled / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    labelled = stored(
        docs.select(F.col("doc_id"), text_of().alias("text")).join(chosen, "doc_id").select("text", "toxic"), "labelled")
    counts = _token_counts(labelled)
    odds = _odds(counts, prior, drift)
    by_pair = {pair: odds.score(*pair) for pair in set(counts.values())} if odds else {}
    scores = {token: by_pair[pair] for token, pair in counts.items()} if odds else {}
    background = odds.score(0, 0) if odds else -1.0

    def without_itself(text: str | None, toxic: int) -> tuple[int, list[float]]:
        """The number of tokens and the scores of the segments if the document had no label."""
        words = tokens(text)
        own = (1, 0) if toxic == 1 else (0, 1)
        hits = [(i, odds.score(pair[0] - own[0], pair[1] - own[1])) for i, pair in enumerate(map(counts.get, words))
                if pair is not None] if odds else []
        return len(words), [float(s) for _, _, s in maximal_segments(hits, background)]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [without_itself(text, toxic) for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array(
                    [segments for _, segments in found], pa.list_(pa.float64()))],
                ["toxic", "n", "scores"])

    rows = labelled.mapInArrow(best, "toxic INT, n LONG, scores ARRAY<DOUBLE>").collect()
    if not rows:
        return ToxicityModel({}, background, 1.0, 1e-3, 0.0, 0.0)
    y = np.array([r["toxic"] for r in rows], float)
    n = np.array([max(r["n"], 1) for r in rows], float)
    top = np.array([max(r["scores"], default=0.0) for r in rows])
    rate, scale = _law(top[y == 0], n[y == 0])
    fitted = ToxicityModel(scores, background, rate, scale, 0.0, 0.0)
    evidence = np.array([fitted.evidence([
        (0, 0, s, float(min(scale * k * np.exp(-rate * s), k))) for s in r["scores"]]) for r, k in zip(rows, n, strict=True)])
    weight, bias = _logistic(evidence, y)
    return ToxicityModel(scores, background, rate, scale, weight, bias)


def with_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows with ``toxic_score`` (0 to 1) and ``toxic_segments``: the significant segments in tokens.

    One narrow pass over whole texts; null text is empty and has no segments. All columns stay as they
    are; columns of these two names are replaced. Repeated rows and null ids stay.
    """
    kept = docs.drop("toxic_score", "toxic_segments")
    schema = f"toxic_score DOUBLE, toxic_segments {SEGMENTS}"
    text_at = kept.columns.index("text")
    fields = pa.list_(pa.struct(
        [("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.segments(text)[1] for text in batch.column(text_at).to_pylist()]
            scores = [model.probability(model.evidence(segments)) for segments in found]
            significant = [
                [{"start": a, "end": b, "score": s, "expected": e} for a, b, s, e in segments if e <= MAX_EXPECTED]
                for segments in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array(significant, fields)],
                [*batch.schema.names, "toxic_score", "toxic_segments"])

    return kept.mapInArrow(run, with_fields(kept.schema, schema))


def training_rows(labels: DataFrame) -> DataFrame:
    """Labels of the documents for training: four of five by the CRC-32 of the id."""
    return labels.filter(~held_out())


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept out of training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def held_out_recall(scored: DataFrame, labels: DataFrame, by: str, threshold: float = 0.5) -> DataFrame:
    """``(by, n_toxic, n_caught, n_clean, n_false)`` of the held-out labelled rows of :func:`with_toxicity` by a column."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("is_toxic"))
    rows = scored.filter(held_out()).select("doc_id", by, "toxic_score").join(known, "doc_id")
    toxic, high = F.col("is_toxic") == 1, F.col("toxic_score") >= threshold
    return rows.groupBy(by).agg(*[
        F.count(F.when(condition, True)).alias(name) for name, condition in (
            ("n_toxic", toxic), ("n_caught", toxic & high), ("n_clean", ~toxic), ("n_false", ~toxic & high))])
