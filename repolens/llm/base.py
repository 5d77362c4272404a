"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from repolens.session import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one run in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: later reads don't compute them again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text of a row, empty for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def in_parts(texts: Iterable[str | None], chars: int) -> Iterator[list[str | None]]:
    """The texts in order, in lists of about so many characters, one long text aside."""
    some: list[str | None] = []
    size = 0
    for text in texts:
        some.append(text)
        size += len(text or "")
        if size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_fields(schema: StructType, ddl: str) -> StructType:
    """The schema and further columns."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])
