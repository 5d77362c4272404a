"""A training corpus from ``documents``: toxicity, near duplicates, benchmark passages, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``documents``, whatever these are beside ``doc_id`` and
``text``. Null and empty texts and repeated rows are handled as the operators say; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.llm import decontamination, packing, pii, simhash, toxicity
from repolens.llm.base import stored

#: Score from which a document counts as toxic.
TOXIC = 0.5
#: A document with a larger share of its words in benchmark passages goes; of others the passages are cut out.
MAX_CONTAMINATED = 0.5


def _carried(docs: DataFrame) -> DataFrame:
    """The rows as one column beside ``doc_id`` and ``text``: no name of theirs can clash with a stage's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def _restored(rows: DataFrame, columns: list[str], new_text: bool = False) -> DataFrame:
    """The columns as they were, but for the text and its length where a stage changes them."""
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text").cast("long"), F.lit(0))} if new_text else {}
    kinds = dict(rows.select("row.*").dtypes)
    return rows.select(*[new[c].cast(kinds[c]).alias(c) if c in new else F.col(f"row.`{c}`") for c in columns])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below :data:`TOXIC`, by a model of the labelled ones."""
    labels = toxicity.training_rows(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = toxicity.train(docs, labels)
    return _restored(toxicity.with_toxicity(_carried(docs), model).filter(F.col("toxic_score") < TOXIC), docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items, and none that consist mostly of them."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contamination(_carried(docs), benchmark)
    return _restored(decontamination.remove_spans(found, MAX_CONTAMINATED), docs.columns, new_text=True)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _restored(pii.redacted(pii.with_pii(_carried(docs), pii.train(spark))), docs.columns, new_text=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences of 1024."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: The trained stages and the tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
