import json

import pytest
from pyspark.sql import functions as F

from repolens.operators.findings import security_findings
from repolens.operators.ranking import (
    engine_counts,
    owner_lines,
    owner_tally,
    severity_counts,
    top_findings,
    vector_counts,
    worst_severity,
)
from repolens.plans.security_report import security_report, stored_findings
from repolens.sources.feeds import read_gitleaks_json, read_semgrep_json
from repolens.streaming.feeds import read_file_stream, stream_findings

KEY = "AIza" + "Qw7e_" * 7


def by_file(findings):
    out = {}
    for r in findings.collect():
        out.setdefault(r.path, []).append(r)
    return out


def test_client_key_samples_and_suppression(tree):
    files, blame = tree({
        "web/keys.ts": f"// maps\nexport default {{\n  authDomain: 'shop.example',\n  apiKey: '{KEY}',\n}};\n",
        "conf/users.xml": "<users>\n<!-- example login, password = 'dummyvaluedummyvalue' -->\n</users>\n",
        "web/quiet.ts": "export const token = 'q8w7e6r5t4y3u2i1o0p9'; // lens-ignore\n",
        "jobs/sync.rb": f'token = "{KEY}"\n',
    })
    found = by_file(security_findings(files, blame))
    key = found["web/keys.ts"][0]
    assert (key.severity, key.review, key.author_name, key.line_no) == ("Low", True, "Alice", 4)
    assert key.snippet.startswith("[Firebase/Web Client Key] apiKey") and "public project identifier" in key.fix
    assert "conf/users.xml" not in found and "web/quiet.ts" not in found
    assert found["jobs/sync.rb"][0].severity == "High"


def test_secrets_in_configuration_files(tree):
    files, blame = tree({
        ".env.production": "SMTP_PASSWORD=p9o8i7u6y5t4r3e2\n", "settings.toml": 'secret = "k3k3k3k3k3k3k3k3k3k3"\n',
        "infra/main.tf": 'token = "z1x2c3v4b5n6m7z1x2c3"\n', "lib/mail.rb": 'password = "m4m4m4m4m4m4m4m4m4"\n',
        "web/cart.ts": "export const rows: any = [];\n", "web/login.html": "<input password='v5v5v5v5v5v5v5v5v5'>\n"})
    found = by_file(security_findings(files, blame))
    assert set(found) == {".env.production", "settings.toml", "infra/main.tf", "lib/mail.rb"}


def test_presence_of_a_language_extends_to_shared_config(tree, spark):
    xml = "<beans>\n  <password-encoder hash='md5'/>\n</beans>\n".replace("'", '"')
    java, blame = tree({"conf/auth.xml": xml, "jobs/Night.java": "class Night {}"}, repo="night")
    bare, _ = tree({"conf/auth.xml": xml}, repo="plain")
    found = security_findings(java.union(bare), blame).collect()
    assert [(r.repo_id, r.rule_id, r.line_no) for r in found] == [("night", "java-weak-hash", 2)]
    forced = security_findings(bare, blame, packs=["java"]).collect()
    assert [(r.rule_id, r.author_name, r.author_email) for r in forced] == [("java-weak-hash", "unknown", "")]


def test_all_filters_together(tree):
    files, blame = tree({
        "web/keys.ts": f"export default {{ apiKey: '{KEY}', authDomain: 'shop.example' }};\n",
        "conf/auth.xml": '<!-- login: scott/tiger -->\n<password-encoder hash="sha"/>\n<password-encoder hash="md5"/>\n',
        "old/jobs/Night.java": "Runtime.getRuntime().exec(line);\n" * 20, "jobs/Night.java": "class Night {}\n" * 300})
    found = by_file(security_findings(files, blame, packs=["java"], exclude=["old/**"]))
    assert {r.rule_id for r in found.pop("conf/auth.xml")} == {"java-weak-hash"}
    assert found == {}


@pytest.fixture
def feeds(spark, tmp_path):
    secrets = tmp_path / "secrets.json"
    secrets.write_text(json.dumps([
        {"RuleID": "gcp-api-key", "Description": "Google", "File": "a.py", "StartLine": 1, "Secret": KEY, "Author": "Bo", "Email": "b@x"},
        {"RuleID": "gcp-api-key", "Description": "again", "File": "a.py", "StartLine": 1, "Secret": KEY},
        {"File": "App.java", "Match": "m"}]))
    sast = tmp_path / "sast.json"
    sast.write_text(json.dumps({"results": [
        {"check_id": "x.y.raw-sql", "path": "a.py", "start": {"line": 2}, "extra": {"message": "bad \n sql", "severity": "ERROR", "metadata": {"cwe": "CWE-89"}}},
        {"check_id": "x.odd", "path": "legacy/a.py", "start": {"line": 1}, "extra": {"message": "m", "metadata": {"cwe": ["CWE-1"], "owasp": ["A1"]}}},
        {"path": "a.py", "extra": {"message": "none", "metadata": {"owasp": ["xss"]}}}]}))
    return read_gitleaks_json(spark, str(secrets), "r"), read_semgrep_json(spark, str(sast), "r")


def test_feeds_add_to_the_built_in_rules(tree, feeds):
    gitleaks, semgrep = feeds
    files, blame = tree({"a.py": f'api_key = "{KEY}"\nrun(sql)\n', "App.java": "class A { Object e = new NoOpPasswordEncoder(); }\n"})
    found = security_findings(files, blame, gitleaks=gitleaks, semgrep=semgrep, exclude=["legacy/**"])
    rows = {(r.rule_id, r.path, r.line_no): r for r in found.collect()}
    assert set(rows) == {
        ("java-weak-hash", "App.java", 1), ("gitleaks:gcp-api-key", "a.py", 1), ("gitleaks:secret", "App.java", 0),
        ("semgrep:x.y.raw-sql", "a.py", 2), ("semgrep:rule", "a.py", 0)}
    leak = rows["gitleaks:gcp-api-key", "a.py", 1]
    assert (leak.author_name, leak.snippet, leak.severity) == ("Bo", "gcp-api-key — Google", "High")
    assert rows["gitleaks:secret", "App.java", 0].snippet == "secret — potential secret"
    sql = rows["semgrep:x.y.raw-sql", "a.py", 2]
    assert (sql.vector, sql.severity, sql.snippet, sql.author_name) == ("Injection/XSS", "High", "raw-sql: bad sql", "Alice")
    assert (rows["semgrep:rule", "a.py", 0].vector, rows["semgrep:rule", "a.py", 0].author_name) == ("Injection/XSS", "unknown")
    assert "gitleaks:secret" not in {r.rule_id for r in security_findings(files, blame, gitleaks=gitleaks, disabled=["gitleaks:secret"]).collect()}


def test_feed_key_in_a_client_configuration_file(tree, feeds):
    files, blame = tree({"a.py": "x\nuses Firebase\n"})
    found = security_findings(files, blame, gitleaks=feeds[0]).filter("rule_id = 'gitleaks:gcp-api-key'").first()
    assert found.severity == "Low" and found.snippet.startswith("[Firebase/Web Client Key] gcp")


def test_ranking(tree, spark, tmp_path):
    files, blame = tree({"a.ts": "eval(x)\n" * 23 + "new RegExp(y)\n"})
    blame = blame.withColumn("author_name", F.when(F.col("line_no") % 2 == 0, "Even").otherwise("Odd"))
    found = stored_findings(security_findings(files, blame), str(tmp_path / "f"))
    report = security_report(found, files)
    sizes = severity_counts(found).first()
    assert (sizes.total, sizes.high, sizes.medium, sizes.low) == (24, 23, 0, 1)
    top = top_findings(found).filter("rule_id = 'xss-eval'").orderBy("place").collect()
    assert len(top) == 20 and [r.line_no for r in top[:3]] == [1, 2, 3] and {r.n_more for r in top} == {3}
    owners = {r.rule_id: r.owners for r in owner_lines(owner_tally(found)).collect()}
    assert owners["xss-eval"] == "Odd (12), Even (11)"
    vectors = {r.vector: (r.n, r.worst_severity) for r in vector_counts(found, files.select("repo_id").distinct()).collect()}
    assert vectors["Injection/XSS"] == (23, "High") and vectors["Clipboard"] == (0, None) and len(vectors) == 6
    engines = {(r.source, r.n) for r in engine_counts(found, files.select("repo_id").distinct(), ["built-in", "semgrep"]).collect()}
    assert ("semgrep", 0) in engines and ("built-in", 23) in engines
    assert worst_severity(found).count() == 2
    assert [r.vector for r in report.ranked.collect()][0] == "ReDoS"
    report.write(str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report" / "owners")).count() == 3


def test_streamed_findings(tree, spark, tmp_path):
    files, _ = tree({"a.ts": "eval(x)\n", "b.py": 'password = "averylongpasswordvalue"\n'})
    files.filter("path = 'a.ts'").write.parquet(str(tmp_path / "in"))
    start = lambda: stream_findings(
        read_file_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"),
        packs=["typescript", "generic"]).awaitTermination()
    start()
    files.filter("path = 'b.py'").write.mode("append").parquet(str(tmp_path / "in"))
    start()
    assert {(r.path, r.rule_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a.ts", "xss-eval"), ("b.py", "secret-assign")}
