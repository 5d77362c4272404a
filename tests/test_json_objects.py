import json
import random

import pytest

from pyspark.sql import functions as F

from repolens.sources.feeds import read_semgrep_json
from repolens.sources.json_objects import read_json_objects

ODD = ['a "quoted" } {', "\\", '\\"', "}", "{[", "]}", "é}\n", "\u2028", '", "results": [{', "", "x" * 300]


@pytest.fixture
def small_splits(spark):
    """Byte ranges of few bytes, so that objects and strings lie across them."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    opened = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.set("spark.sql.files.openCostInBytes", opened)


def some(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 4:
        return [rng.choice(ODD), rng.randrange(99), None, True][kind]
    if kind == 4:
        return [some(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["results", "a", "b}", 'c"']): some(rng, depth + 1) for _ in range(rng.randrange(4))}


def read(spark, path, key=None):
    rows = read_json_objects(spark, str(path), F.lit("r"), key).collect()
    return [json.loads(r["json"]) for r in sorted(rows, key=lambda r: (r["file"], r["object"]))]


@pytest.mark.parametrize("size", [64, 777])
def test_objects_equal_those_of_the_whole_document(spark, tmp_path, small_splits, size):
    rng = random.Random(size)
    want = []
    for k in range(12):
        document = {f"k{j}": some(rng) for j in range(3)} | {"results": [some(rng, 1) for _ in range(rng.randrange(25))]}
        document |= {f"z{j}": some(rng) for j in range(3)}
        want += [r for r in document["results"] if isinstance(r, dict)] if not isinstance(document["results"], dict) else []
        indent = [None, 1][k % 2]
        (tmp_path / f"{k:02}.json").write_text(json.dumps(document, indent=indent, ensure_ascii=k % 3 == 0))
    small_splits(size)
    assert len(want) > 20
    got, want = read(spark, tmp_path, "results"), list(want)
    assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, want))


def test_array_at_the_top(spark, tmp_path, small_splits):
    want = [{"n": k, "t": ODD[k % len(ODD)], "in": [{"m": k}]} for k in range(40)]
    (tmp_path / "a.json").write_text(json.dumps(want, indent=2))
    small_splits(100)
    assert read(spark, tmp_path / "a.json") == want


@pytest.mark.parametrize("text, want", [
    ("", []), ("[]", []), ("{}", []), ("null", []), ('{"results": null}', []), ('{"results": {"a": {"b": 1}}}', []), ("}}]", []),
    ('{"results": []}', []), ('{"results": [{}]}', [{}]), ('{"results":[{"a":1},{"a":2},{"a":', [{"a": 1}, {"a": 2}]),
    ('{"results":[{"a":1},{"a":2', [{"a": 1}]), ('{"results":[{"a":1}]}\n', [{"a": 1}]),
    ('{"x\\"results": [{"a": 1}], "results" : [ 1, {"a": 2}, [{"a": 3}], {"a": 4}], "y": [{"a": 5}]}', [{"a": 2}, {"a": 4}])])
def test_odd_documents(spark, tmp_path, text, want):
    (tmp_path / "a.json").write_text(text)
    assert read(spark, tmp_path / "a.json", "results") == want


def test_a_report_over_many_ranges(spark, tmp_path, small_splits):
    results = [{"check_id": f"c{k}", "path": f"p{k % 7}", "extra": {"message": ODD[k % len(ODD)] * 5, "lines": "}" * (k % 5)}} for k in range(300)]
    (tmp_path / "one.json").write_text(json.dumps({"errors": [{"check_id": "no"}], "results": results}))
    small_splits(4_000)
    got = read_semgrep_json(spark, str(tmp_path)).collect()
    assert sorted((r["repo_id"], r["rule_id"], r["path"]) for r in got) == sorted(("one", f"semgrep:c{k}", f"p{k % 7}") for k in range(300))
