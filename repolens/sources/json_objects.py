"""Objects out of large JSON documents: a report is read in pieces by byte ranges, never as one row.

A piece ends at each ``}``, so Spark splits files of any length, with or without line ends. Whether a piece begins inside a
string and how deep it lies follows from sums over the pieces before it: they are summed within each byte range first, then over
ranges, of which a file has few.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolens.session import shared_folder

PIECE = ("file", "block", "pos")


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _depth_change(parts: Column, inside: int) -> Column:
    """Brackets opened less those closed by a piece that begins inside a string or outside; its own end counts where it is outside."""
    outside = F.array_join(F.filter(parts, lambda _, i: i % 2 == inside), " ")
    ends_outside = (F.size(parts) - 1 + inside) % 2 == 0
    return F.regexp_count(outside, F.lit(r"[\[{]")) - F.regexp_count(outside, F.lit(r"\]")) - F.when(ends_outside, 1).otherwise(0)


def _pieces(spark: SparkSession, path: str, repo: Column) -> DataFrame:
    """Pieces with the strings and depths before them, counted from the start of their byte range, for both ways that it can begin."""
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    read = (
        spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").text(path)
        .select(repo.alias("repo_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("pos"), "value", F.col("_metadata.file_size").alias("file_size"))
        .withColumns({"quotes": (F.size(parts) - 1) % 2, "from_outside": _depth_change(parts, 0), "from_inside": _depth_change(parts, 1)}))
    before = Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    quoted = read.withColumn("quotes_before", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    for start in (0, 1):
        change = F.when(F.col("quotes_before") == start, F.col("from_outside")).otherwise(F.col("from_inside"))
        quoted = quoted.withColumn(f"change_{start}", change)
    return _stored(quoted.withColumns(
        {f"depth_{s}": F.coalesce(F.sum(f"change_{s}").over(before), F.lit(0)) for s in (0, 1)}), "json-pieces")


def _placed(pieces: DataFrame, level: int) -> DataFrame:
    """Pieces with ``object``, the number of objects of that level that end before them in their file, and whether they end one."""
    blocks = pieces.groupBy("file", "block").agg(
        (F.sum("quotes") % 2).alias("quotes"), F.sum("change_0").alias("change_0"), F.sum("change_1").alias("change_1"),
        F.max("pos").alias("last"), F.first("file_size").alias("file_size"), F.sum(F.octet_length("value") + 1).alias("length"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    change = F.when(F.col("inside") == 0, F.col("change_0")).otherwise(F.col("change_1"))
    whole = Window.partitionBy("file")
    # Longer with a mark after each piece than the file is: its last piece has none.
    unmarked = (F.sum("length").over(whole) > F.col("file_size")) & (F.col("block") == F.max("block").over(whole))
    blocks = blocks.withColumn("block_change", change).select(
        "file", "block", "inside", F.when(unmarked, F.col("last")).alias("unmarked"),
        F.coalesce(F.sum("block_change").over(before), F.lit(0)).alias("block_depth"))
    from_outside = F.col("inside") == 0
    depth = F.col("block_depth") + F.when(from_outside, F.col("depth_0")).otherwise(F.col("depth_1"))
    after = depth + F.when(from_outside, F.col("change_0")).otherwise(F.col("change_1"))
    outside = (F.col("inside") + F.col("quotes_before") + F.col("quotes")) % 2 == 0
    placed = pieces.join(blocks, ["file", "block"]).select(
        "repo_id", *PIECE, "value", depth.alias("depth"), (outside & (after == level) & ~F.col("pos").eqNullSafe(F.col("unmarked"))).alias("ends"))
    ended = placed.groupBy("file", "block").agg(F.count_if("ends").alias("ended"))
    ended = ended.select("file", "block", F.coalesce(F.sum("ended").over(before), F.lit(0)).alias("ended_before"))
    in_block = Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("local", F.coalesce(F.sum(F.col("ends").cast("long")).over(in_block), F.lit(0))).join(
        ended, ["file", "block"]).withColumn("object", F.col("ended_before") + F.col("local"))


def _walked(tokens: Column, depth: Column, level: int) -> Column:
    """Where the last object of the level begins among the tokens, and the container around it: the place of its ``[``, -1 if
    it is no array, 0 if it began before these tokens.
    """
    start = F.struct(depth.cast("int").alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("at"),
                     F.lit(0).alias("opened"), F.lit(0).alias("container"))

    def step(s: Column, t: Column) -> Column:
        opens, closes = ~s["quoted"] & t.isin("{", "["), ~s["quoted"] & t.isin("}", "]")
        at = s["at"] + 1
        container = F.when(opens & (s["depth"] == level - 1), F.when(t == "[", at).otherwise(-1)).when(
            closes & (s["depth"] == level), -1).otherwise(s["container"])
        return F.struct(
            (s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            F.when(t == '"', ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), at.alias("at"),
            F.when(opens & (t == "{") & (s["depth"] == level), at).otherwise(s["opened"]).alias("opened"), container.alias("container"))

    return F.aggregate(tokens, start, step)


def read_json_objects(spark: SparkSession, path: str, repo: Column, key: str | None = None) -> DataFrame:
    """``repo_id, file, object, json``: the objects of the array at the top of each file, or of its array ``key``, in order of ``object``.

    ``repo`` is a column over the rows of the text source. One object is one value; other members of the document, objects of other
    arrays and elements that are no objects are left out. A file that breaks off keeps its complete objects; empty files and files that
    hold no such array have none. Pieces and objects are written to the shared folder once.
    """
    level = 1 if key is None else 2
    placed = _placed(_pieces(spark, path, repo), level)
    whole = placed.groupBy("file", "object").agg(
        F.first("repo_id").alias("repo_id"), F.sort_array(F.collect_list(F.struct("block", "pos", "value", "depth"))).alias("pieces"),
        F.max("ends").alias("ends")).filter("ends")
    text = F.concat(F.array_join(F.transform("pieces", lambda p: p["value"]), "}"), F.lit("}"))
    tokens = whole.select(
        "repo_id", "file", "object", F.col("pieces")[0]["depth"].alias("depth"),
        F.regexp_extract_all(text, F.lit(r'(?s)\\.|["{}\[\]]|[^"\\{}\[\]]+'), F.lit(0)).alias("tokens"))
    walked = tokens.withColumn("w", _walked(F.col("tokens"), F.col("depth"), level))
    before = F.greatest(F.col("w.container") - 1, F.lit(0))  # the tokens before the container's bracket, of which the last six are its name
    name = F.array_join(F.slice("tokens", F.greatest(before - 5, F.lit(1)), F.least(before, F.lit(6))), "")
    asked = F.lit(True) if key is None else name.rlike(rf'(?<!\\)"{key}"\s*:\s*$')
    objects = _stored(walked.select(
        "repo_id", "file", "object", F.when(F.col("w.container") > 0, asked).when(F.col("w.container") < 0, False).alias("asked"),
        F.array_join(F.slice("tokens", F.col("w.opened"), F.size("tokens")), "").alias("json")), "json-objects")
    # A container is named by its first object only; a document has few containers.
    named = objects.filter("asked IS NOT NULL").groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("object", "asked"))).alias("named"))
    last = F.element_at(F.filter("named", lambda n: n["object"] <= F.col("object")), -1)
    return objects.drop("asked").join(named, "file").filter(last["asked"]).select("repo_id", "file", "object", "json")
