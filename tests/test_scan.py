import random
import re

from pyspark.sql import functions as F

from repolens.operators.attribution import blame_by_file, majority_owner
from repolens.operators.findings import security_findings
from repolens.operators.languages import dominant_language, language_counts, merged_rules, present_packs
from repolens.operators.scan import file_facts, large_files, listed_files, readable_files, scan_rules, scan_stats
from repolens.operators.scoring import code_grades, issue_matrix, matrix_by_author, matrix_by_rule
from repolens.plans.author_report import smell_scan
from repolens.rules import SECURITY_RULES, SMELL, SMELL_RULES, Rule, rule_catalogue, select_rules
from tests.test_patterns import RULES, _python_regex, _random_texts

IDLE = r"while\s*\(\w+\)\s*\{\s*\}"


def counts(scan, email="alice@ex.com"):
    return {r.rule_id: r.n for r in scan.counts.filter(F.col("email") == email).collect()}


def one_rule(block):
    return [Rule("x", SMELL, ("typescript",), IDLE, block=block)]


def test_block_rule_matches_across_lines(tree):
    files, blame = tree({"poll.ts": "poll();\nwhile (true) {\n\n}\ndone();\n"})
    assert counts(smell_scan(files, blame, rules=one_rule(False))) == {}
    assert counts(smell_scan(files, blame, rules=one_rule(True))) == {"x": 1}


def test_block_rule_starts_and_suppression(tree):
    files, blame = tree({
        "loud.ts": "let turns = 0;\nlet idle = false;\nwhile (idle) {\n\t}\n",
        "quiet.ts": "let idle = false; // lens-disable-next-line\nwhile (idle) {\n\t}\n",
        "also_quiet.ts": "while (idle) { // lens-ignore\n}\nwhile (idle) {  /* lens-ignore */\n}\n",
    })
    hits = smell_scan(files, blame, rules=one_rule(True)).hits.collect()
    assert [(h.path, h.line_no, h.n) for h in hits] == [("loud.ts", 3, 1)]


def test_two_block_matches_on_one_line(tree):
    files, blame = tree({"spin.ts": "go();\nwhile (a) {} while (b) {} stop();\nwhile (c) {\n}"})
    hits = smell_scan(files, blame, rules=one_rule(True)).hits.orderBy("line_no").collect()
    assert [(h.line_no, h.n) for h in hits] == [(2, 2), (3, 1)]


def test_templates(tree):
    files, blame = tree({
        "shop/cart.html": "<section>\n<p>TODO prices</p>\n</section>\n",
        "shop/list.vue": "\n".join([
            "<template>", "<img", "  class='big' src='boat.jpg'", ">", "<img :src='x' alt='a boat'>", "<img [src]='x' [attr.alt]='name'>",
            "<button class='buy'", "  v-on:click='buy'>buy</button>", "<button class='end' type='submit'>end</button>", "</template>"]) + "\n",
    })
    assert counts(smell_scan(files, blame)) == {"todo": 1, "imgalt": 1, "btntype": 1}
    assert counts(smell_scan(files, blame, packs=["html"])) == {"todo": 1, "imgalt": 1, "btntype": 1}


def test_onpush_and_deep_import(tree):
    files, blame = tree({
        "menu.component.ts": "@Component({\n  selector: 'x-menu',\n  changeDetection: ChangeDetectionStrategy.OnPush,\n})\nclass Menu {}\n"
                             "@Component({ selector: 'x-row', template: '<i></i>' })\nclass Row {}\n",
        "far.ts": "".join(f"import {{ n{k} }} from '{'../' * k}lib/n{k}';\n" for k in range(1, 7)),
    })
    deep = sum(k >= 4 for k in range(1, 7)) if "deepimport" in RULES else 0
    found = counts(smell_scan(files, blame))
    assert found["onpush"] == 1 and found["deepimport"] in (deep, deep + 1)


def test_merged_packs_do_not_mix(tree):
    files, blame = tree({
        "draw.ts": "const tag = '<button>' + name + '</button>';\n", "draw.vue": "<p title='constructor(private http: Http)'>p</p>\n"})
    assert counts(smell_scan(files, blame)) == {}


def test_polyglot(tree):
    files, blame = tree({
        "web/cart.tsx": "export function total(rows: any) {\n  return rows;\n}\n", "tools/load.rb": "# TODO retries\nputs 1\n",
        "jobs/Night.java": "void run() {\n  System.out.println(count);\n}\n", "notes.txt": "TODO nothing\n"})
    assert counts(smell_scan(files, blame)) == {"any": 1, "sysout": 1, "todo": 1}
    assert counts(smell_scan(files, blame, packs=["java"])) == {"sysout": 1}
    assert scan_stats(listed_files(files, SMELL)).first().files == 3


def test_vendored_minified_and_scripts(tree):
    packed = "f(0);" * 500 + "console.log(0);"  # one line of more than 2,000 characters
    files, blame = tree({
        "lib/own.ts": "start();\nconsole.log(state);\n", "lib/packed.js": packed, "web/polyfill/packed.js": packed,
        "tradingview/own.js": "console.log(1);\n", "coverage/own.js": "console.log(1);\n", "scripts/release.cjs": "console.log('done');\n"})
    scan = smell_scan(files, blame)
    assert counts(scan) == {"console": 1}
    assert scan.owned.first().lines_owned == 3  # own.ts and release.cjs
    assert scan_stats(listed_files(files, SMELL)).first().asDict() == {"repo_id": "r", "files": 3, "large_files": 0}


def test_large_files_belong_to_the_majority(spark, tree):
    text = "\n" * 200  # 201 lines with the empty tail
    files, _ = tree({"a.ts": text, "b.ts": "\n" * 199})
    blame = spark.createDataFrame(
        [("r", "a.ts", i + 1, "N", "Two@ex.com" if i % 2 else "one@ex.com") for i in range(200)],
        "repo_id STRING, path STRING, line_no INT, author_name STRING, author_email STRING")
    readable = readable_files(listed_files(files, SMELL))
    assert [(r.path, r.n_lines) for r in large_files(file_facts(readable)).collect()] == [("a.ts", 201)]
    assert majority_owner(blame_by_file(blame)).first().email == "one@ex.com"  # tie: earliest line
    assert counts(smell_scan(files, blame), "one@ex.com") == {"large": 1}
    assert counts(smell_scan(files, blame, disabled=["large"]), "one@ex.com") == {}
    assert scan_stats(listed_files(files, SMELL)).first().large_files == 1


def test_stored_scan_equals_the_lazy_one(tree, tmp_path):
    files, blame = tree({"a.ts": "x as any\n" + "\n" * 250 + "catch {\n}", "b.java": "\n" * 300, "c.dart": "print(x)"})
    lazy, stored = smell_scan(files, blame), smell_scan(files, blame, store=str(tmp_path / "scan"))
    for name in ("hits", "counts", "owned", "grades"):
        rows = lambda scan: sorted(map(tuple, getattr(scan, name).collect()))
        assert rows(lazy) == rows(stored) and rows(lazy)
    text = stored.grades._jdf.queryExecution().toString()
    assert "content" not in text


def test_unblamed_lines_are_unknown(tree, spark):
    files, blame = tree({"a.ts": "x as any\ny as any"})
    scan = smell_scan(files, blame.filter("line_no = 1"))
    assert counts(scan) == {"any": 1} and counts(scan, "unknown") == {"any": 1}


def test_lines_owned_is_the_denominator(tree):
    files, blame = tree({
        "src/rates.ts": "export default [] as any;\n" * 60, "package-lock.json": "{}\n" * 9000, "docs/history.md": "- line\n" * 4000})
    scan = smell_scan(files, blame)
    assert scan.owned.first().lines_owned == 60
    by_churn = code_grades(scan.counts, scan.owned.withColumn("lines_owned", F.lit(13_060))).first()
    assert scan.grades.first().derived_code_grade != by_churn.derived_code_grade


def test_all_rules_disabled(tree, tmp_path):
    files, blame = tree({"a.ts": "x as any\n" * 220})
    off = [r.rule_id for r in SMELL_RULES]
    for store in (None, str(tmp_path / "scan")):
        scan = smell_scan(files, blame, disabled=off, store=store)
        assert scan.hits.count() == 0 and counts(scan) == {"large": 1}
    assert security_findings(files, blame, disabled=[r.rule_id for r in SECURITY_RULES]).count() == 0


def test_a_folder_named_like_a_source_file_is_not_one(tree):
    files, _ = tree({"kit.ts/readme.md": "x as any", "kit.ts/in.ts": "x"})
    assert [r.path for r in listed_files(files, SMELL).collect()] == ["kit.ts/in.ts"]


def test_disabled_and_user_rules(tree):
    files, blame = tree({"a.ts": "x as any; console.log(1); HACK\n"})
    own = Rule("hack", SMELL, ("typescript",), r"\bHACK\b", label="Hacks", weight=3)
    scan = smell_scan(files, blame, rules=[*SMELL_RULES, own], disabled=["console"])
    assert counts(scan) == {"any": 1, "hack": 1}
    assert scan.grades.first().score == 2 + 3


def test_languages(tree):
    files, _ = tree({"a.ts": "", "b.vue": "", "c.html": "", "node_modules/x.ts": "", "d.d.ts": "", "e.java": "", "f.txt": ""})
    assert {r.language: r.files for r in language_counts(files).collect()} == {"typescript": 1, "html": 2, "java": 1}
    assert dominant_language(files).first().language == "html"
    assert sorted(present_packs(files).first().packs) == ["generic", "html", "java", "typescript"]
    only_text, _ = tree({"f.txt": ""})
    assert dominant_language(only_text).first().language == "generic"
    rules = {r.rule_id: r for r in merged_rules(files, SMELL_RULES, SECURITY_RULES).collect()}
    assert sorted(rules["todo"].packs) == ["generic", "html", "java", "typescript"] and "print" not in rules


def test_catalogue(spark):
    table = rule_catalogue(spark)
    assert table.select("rule_id").distinct().count() == 44
    assert table.filter("rule_id = 'todo'").count() == 5
    assert rule_catalogue(spark, disabled=["todo"]).filter("rule_id = 'todo'").count() == 0
    assert [r.rule_id for r in select_rules(SMELL_RULES, packs=["flutter"])] == ["todo", "print", "nullassert", "ignore"]


def test_matrix_shapes(spark, tree):
    files, blame = tree({"a.ts": "x as any\n"})
    people = spark.createDataFrame([("r", "alice@ex.com", "Al"), ("r", "bob@ex.com", "Bo")], "repo_id STRING, email STRING, short STRING")
    matrix = issue_matrix(smell_scan(files, blame).counts, people)
    assert matrix.count() == 44
    places = people.selectExpr("repo_id", "email", "if(short = 'Al', 1, 2) AS place_no")
    row = matrix_by_author(matrix, places, 2).filter("rule_id = 'any'").first()
    assert (row.p0, row.p1, row.people) == (1, 0, "Al, Bo")
    assert {r.short: r["any"] for r in matrix_by_rule(matrix).collect()} == {"Al": 1, "Bo": 0}


def test_scan_agrees_with_line_by_line_search(spark):
    """All smell rules against a plain search over random texts."""
    rng = random.Random(3)
    pieces = ["x as any", "console.log(", ".subscribe(", "window.", "isPlatformBrowser", "TODO", "a!.b", "@Component({", "})", "changeDetection",
              "// @ts-ignore", "from '../../../../x'", "constructor(private a: b)", "catch (e) {", "}", "<img ", "alt=", ">", "<button", "type=",
              "*ngIf", "System.out.print", ".printStackTrace(", '== "', "print(", "x!;", "// ignore:", "\n", "\n", "\n", " ", "lens-ignore", "é", ""]
    texts = _random_texts(rng, 120, pieces, 60)
    files = spark.createDataFrame([("r", f"f{i}.ts", t) for i, t in enumerate(texts)], "repo_id STRING, path STRING, content STRING")
    got = {(r.path, r.rule_id, r.line_no): r.n for r in scan_rules(files, SMELL_RULES, scoped=False).collect()}
    want = {}
    silent = re.compile(r"\b(lens-ignore|lens-disable-line)\b", re.A)
    for i, text in enumerate(texts):
        lines = text.split("\n")
        for rule in SMELL_RULES:
            regex = _python_regex(RULES[rule.rule_id])
            if rule.block:
                at = [text.count("\n", 0, m.start()) for m in regex.finditer(text)]
            else:
                at = [k for k, line in enumerate(lines) if regex.search(line)]
            for k in at:
                if not silent.search(lines[k]):
                    key = (f"f{i}.ts", rule.rule_id, k + 1)
                    want[key] = want.get(key, 0) + 1
    assert got == want and len({k[1] for k in want}) == len(SMELL_RULES)
