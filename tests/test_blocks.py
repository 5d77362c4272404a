import pytest

from repolens.operators.blocks import portable, scan_blocks
from repolens.operators.scan import scan_rules
from repolens.rules import SMELL, SMELL_RULES, Rule

SCHEMA = "repo_id STRING, path STRING, content STRING"


def own(rule_id, pattern, **more):
    return Rule(rule_id, SMELL, ("mine",), pattern, block=True, **more)


def found(spark, files, rules, **more):
    rows = spark.createDataFrame([("r", p, t) for p, t in files.items()], SCHEMA)
    return sorted((r["path"], r["rule_id"], r["line_no"], r["n"]) for r in scan_blocks(rows, rules, **more).filter("error IS NULL").collect())


def test_a_nested_repetition_over_five_megabytes(spark):
    """Backtracking engines recurse once per repetition here, or try every way to divide the text."""
    text = "ab" * 2_500_000 + "c\n" + "ab" * 10 + "\nabc abc\n"
    assert found(spark, {"a.txt": text}, [own("x", r"(a|b)*c"), own("y", r"(a*)*(b*)*c$")]) == [
        ("a.txt", "x", 1, 1), ("a.txt", "x", 3, 2)]


def test_a_pattern_that_cannot_be_matched_in_time_becomes_a_row(spark):
    files = spark.createDataFrame([("r", "a.txt", "a" * 5000 + "b"), ("r", "b.txt", "aab"), ("r", "c.txt", "c")], SCHEMA)
    rows = scan_blocks(files, [own("slow", r"(?=(a+)+$)(a+)+c|(?<=c)$"), own("wrong", "(open"), own("fine", "b")], seconds=0.2).collect()
    got = {(r["path"], r["rule_id"]): (r["line_no"], r["n"], (r["error"] or "")[:9]) for r in rows}
    assert got[("a.txt", "slow")] == (None, 0, "no result")
    assert all(got[(p, "wrong")] == (None, 0, "pattern: ") for p in ("a.txt", "b.txt", "c.txt"))
    assert got[("c.txt", "slow")] == (1, 1, "") and got[("b.txt", "fine")] == (1, 1, "")


def test_the_same_hits_as_the_built_in_scan(spark):
    rules = [r for r in SMELL_RULES if r.block]
    files = {
        "a.ts": "@Component({\n a: 1\n})\n@Component({ changeDetection: x })\na.subscribe(x => { b.subscribe(y); });\ntry {} catch (e) {\n}\n",
        "b.html": "<img src='a'>\n<IMG alt='x'> <img\n src=b>\n<button>x</button><button type=a>", "C.java": "catch (E e) { } catch(F f) {}",
        "d.ts": "// lens-disable-next-line\ncatch {}\ncatch {} // lens-ignore\n", "e.ts": ""}
    table = spark.createDataFrame([("r", p, t) for p, t in files.items()], SCHEMA)
    want = sorted((r["path"], r["rule_id"], r["line_no"], r["n"]) for r in scan_rules(table, rules).collect())
    got = [h for h in found(spark, files, rules) if any(
        h[0].endswith({"typescript": ".ts", "html": ".html", "java": ".java"}.get(p, "?")) for r in rules if r.rule_id == h[1] for p in r.packs)]
    assert got == want and len(want) > 6


def test_flags_scopes_marks_and_odd_texts(spark):
    files = {"a.ts": "X\ny\nx\n", "b.js": "x", "c.ts": None, "d.ts": "", "e.ts": "x lens-ignore\nx"}
    rules = [own("i", "x", ignore_case=True, guards=("X",)), own("s", "x.y", ignore_case=True, dot_all=True), own("p", "x", path_include=r"\.ts$", path_exclude="^e"),
             own("none", "z"), own("end", "x$")]
    assert found(spark, files, rules) == [
        ("a.ts", "i", 1, 1), ("a.ts", "i", 3, 1), ("a.ts", "p", 3, 1), ("a.ts", "s", 1, 1), ("b.js", "end", 1, 1), ("b.js", "i", 1, 1),
        ("e.ts", "end", 2, 1), ("e.ts", "i", 2, 1)]
    assert found(spark, {}, rules) == [] and found(spark, files, []) == []


def test_line_rules_are_refused(spark):
    with pytest.raises(ValueError, match="scan_rules"):
        scan_blocks(spark.createDataFrame([], SCHEMA), [Rule("a", SMELL, ("mine",), "x")])


def test_portable():
    assert portable(r"[[a]\[$[$]\$", r"\z") == r"[\[a]\[\z[$]\$"
