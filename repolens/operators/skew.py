"""Joins with one row per repository that survive a repository holding most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def join_per_repo(
    rows: DataFrame, per_repo: DataFrame, spread_by: Sequence[str], how: str = "inner", salts: int | None = None,
) -> DataFrame:
    """Join ``rows`` with a table of one row per ``repo_id``.

    When the table is too big to broadcast, the join shuffles by repository.  A salt
    from the ``spread_by`` columns deals the rows of one repository to ``salts``
    tasks, by default more than a shuffle has, as hashes collide; the other side is repeated once per salt,
    which is cheap at one row each.
    """
    if salts is None:
        salts = max(32, 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    repeated = per_repo.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, ["repo_id", "_salt"], how).drop("_salt")
