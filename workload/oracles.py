"""DuckDB SQL for the queries, written from the definitions rather than from the jobs.

Queries share common table expressions; ``sql`` puts the ones a query needs in front
of it.  The regex engine here has no lookaround, so rules that use it appear in an
equivalent form.
"""

from __future__ import annotations

import re

from repolens.rules import SECURITY_RULES, SMELL_RULES
from workload.staging import DISABLED, NOT_A_TEXT, PERIOD_START, SHARED_SQL, SNAPSHOT_DATE

CTES: dict[str, str] = {name: text.strip() for name, text in SHARED_SQL.items()}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def flags(rule) -> str:
    return ("i" if rule.ignore_case else "") + ("s" if rule.dot_all else "")


def fixed(value: str, digits: int) -> str:
    """Fixed decimals by the exact binary value, halves up (printf rounds them to even)."""
    half = f"({value}) * {2 ** (digits + 1)} % 2 = 1"
    return f"printf('%.{digits}f', case when {half} then ({value}) + 1e-9 else ({value}) end)"


# --- paths (patterns written for the staged layout) ------------------------------

GENERATED = (
    r"(node_modules|\.spec\.|\.test\.|\.d\.ts$|dist/|build/|coverage/|\.min\.|\.bundle\.|package-lock|\.map$"
    r"|/assets/|charting_library|tradingview|vendor/|polyfill)"
)
EXCLUDED = r"(^|/)(legacy/.*|vendor/[^/]*|package-lock\.json)($|/)"
NORMAL_PATH = r"regexp_replace(replace(path, '\', '/'), '^\./', '')"
SOURCES = "py|rb|go|rs|php|cs|kt|swift|scala|c|cc|cpp|h"
CONFIG = r"\.env[^/]*$|\.(json|yml|yaml|properties|ini|cfg|conf|toml|sh|xml|tf)$|Dockerfile[^/]*$"
SMELL_PATHS = {
    "typescript": r"\.(ts|tsx|js|jsx|mjs|cjs)$", "html": r"\.(html|vue)$", "java": r"\.java$", "flutter": r"\.dart$",
    "generic": rf"\.({SOURCES})$",
}
SECURITY_PATHS = {
    "typescript": rf"\.(ts|tsx|js|jsx|html|vue)$|{CONFIG}", "html": r"\.(html|vue)$", "java": rf"\.java$|{CONFIG}",
    "flutter": rf"\.dart$|{CONFIG}", "generic": rf"\.({SOURCES})$|{CONFIG}",
}
HANDWRITTEN = (
    "content is not null and list_max([length(x) for x in string_split(content, chr(10))]) <= 2000"
)
LISTED = f"not regexp_matches(path, {lit(GENERATED)}, 'i') and not regexp_matches({NORMAL_PATH}, {lit(EXCLUDED)})"
QUIET = (
    r"not regexp_matches(line, '\b(lens-ignore|lens-disable-line)\b') "
    r"and not regexp_matches(previous, '\blens-disable-next-line\b')"
)
SAMPLE = (
    r"(regexp_matches({0}, 'rod\s*/\s*koala|dianne\s*/\s*emu|scott\s*/\s*tiger', 'i') or "
    r"(regexp_matches({0}, '\b(sample|example|dummy|placeholder)\b', 'i') and "
    r"(regexp_matches({0}, '^\s*(<!--|/\*|\*|//|#)|-->|\*/') or path like '%.xml' or path like '%.md')))"
)

CTES["numbered"] = """
select repo_id, path, line, line_no, coalesce(lag(line) over (partition by repo_id, path order by line_no), '') as previous
from (select repo_id, path, unnest(string_split(content, chr(10))) as line,
 cast(unnest(range(1, len(string_split(content, chr(10))) + 1)) as int) as line_no from files)"""
CTES["blame_lines"] = """
select repo_id, path, line_no, 'Dev ' || cast((length(path) * 7 + line_no) % 37 as string) as author_name,
 case when line_no % 11 = 0 then 'DEV' else 'dev' end || cast((length(path) * 7 + line_no) % 37 as string) || '@ex.com' as author_email
from (select *, max(line_no) over (partition by repo_id, path) as last_no from numbered)
where line_no % 50 <> 0 and not (line = '' and line_no = last_no)"""

for family, paths in (("smell", SMELL_PATHS), ("sec", SECURITY_PATHS)):
    CTES[f"{family}_listed"] = (
        "select * from files where (" + " or ".join(f"regexp_matches(path, {lit(p)})" for p in paths.values())
        + f") and {LISTED}")
    CTES[f"{family}_readable"] = f"select * from {family}_listed where {HANDWRITTEN}"
    CTES[f"{family}_lines"] = (
        f"select n.* from numbered n semi join {family}_readable r on n.repo_id = r.repo_id and n.path = r.path")

# --- rules --------------------------------------------------------------------------

PUBLIC_ENV = "^(NG_APP_|ANGULAR_APP_|NEXT_PUBLIC_|VITE_|REACT_APP_|PUBLIC_|NODE_ENV|PORT)"


def line_test(rule) -> str:
    if rule.rule_id == "dom":
        return r"regexp_matches(regexp_replace(line, '^.*isPlatformBrowser', 'X'), '\b(window|document)\.')"
    if rule.rule_id == "secret-config-assign":
        return (
            r"""regexp_matches(line, '(api[_-]?key|secret|passwd|password|token|credentials?)[A-Za-z0-9_-]*\s*[:=]\s*"""
            r"""[^\s"''#${<%][^\s"''#]{11,}', 'i')""")
    if rule.rule_id == "secret-nonpublic-env":
        return (
            r"""len([x for x in regexp_extract_all(line, 'process\.env\[?[''"]?([A-Z][A-Z0-9_]{2,})', 1) """
            f"if not regexp_matches(x, {lit(PUBLIC_ENV)})]) > 0")
    options = f", {lit(flags(rule))}" if flags(rule) else ""
    return f"regexp_matches(line, {lit(rule.pattern)}{options})"


def path_test(rule, paths) -> str:
    tests = ["(" + " or ".join(f"regexp_matches(path, {lit(paths[p])})" for p in rule.packs) + ")"]
    for pattern, ignore_case, negate in (
        (rule.path_include, rule.path_include_ignore_case, ""), (rule.path_exclude, rule.path_exclude_ignore_case, "not "),
    ):
        if pattern:
            tests.append(f"{negate}regexp_matches(path, {lit(pattern)}{', ' + lit('i') if ignore_case else ''})")
    return " and ".join(tests)


def present_test(rule) -> str:
    """Some pack of the rule both takes in the path and is present in the repository."""
    return " or ".join(
        f"(regexp_matches(path, {lit(SECURITY_PATHS[p])})"
        + ("" if p == "generic" else f" and repo_id in (select repo_id from repo_languages where language = '{p}')") + ")"
        for p in rule.packs)


CTES["smell_line_hits"] = " union all ".join(
    f"select repo_id, path, '{r.rule_id}' as rule_id, line_no, 1 as n from smell_lines where {line_test(r)} and "
    f"{path_test(r, SMELL_PATHS)} and {QUIET}"
    for r in SMELL_RULES if not r.block)

# Superset pattern of a block rule and the words that clear a match.
BLOCK_TWINS = {
    "onpush": (r"@Component\s*\(\s*\{[\s\S]*?\}\s*\)", "", r"changeDetection"),
    "imgalt": (r"<img\b[^>]*>", "is", r"\[?(attr\.)?alt\]?\s*="),
    "btntype": (r"<button\b[^>]*>", "is", r"\[?type\]?\s*="),
}


def block_hits(rule) -> str:
    pattern, options, unless = BLOCK_TWINS.get(rule.rule_id, (rule.pattern, flags(rule), None))
    clear = f" and not regexp_matches(string_split(piece, chr(57345))[1], {lit(unless)}, 'i')" if unless else ""
    if unless == "changeDetection":
        clear = clear.replace(", 'i')", ")")
    return f"""
select '{rule.rule_id}' as rule_id, repo_id, path, line_no from (
 select repo_id, path, piece, i, 1 + sum(length(piece) - length(replace(piece, chr(10), '')))
  over (partition by repo_id, path order by i rows between unbounded preceding and 1 preceding) as line_no
 from (select repo_id, path, unnest(pieces) as piece, unnest(range(1, len(pieces) + 1)) as i from (
  select repo_id, path, string_split(regexp_replace(content, {lit('(' + pattern + ')')}, chr(57344) || '\\1' || chr(57345), '{options}g'), chr(57344)) as pieces
  from smell_readable where {path_test(rule, SMELL_PATHS)})))
where i > 1{clear}"""


CTES["smell_block_hits"] = f"""
select b.repo_id, b.path, b.rule_id, cast(b.line_no as int) as line_no, cast(count(*) as int) as n
from ({' union all '.join(block_hits(r) for r in SMELL_RULES if r.block)}) b
join numbered using (repo_id, path, line_no) where {QUIET} group by all"""
CTES["smell_hits"] = "select * from smell_line_hits union all select * from smell_block_hits"

LANGUAGE = (
    r"case when regexp_matches(path, 'node_modules|\.d\.ts$') then null "
    r"when regexp_matches(path, '\.(ts|tsx|js|jsx|mjs|cjs)$') then 'typescript' when path like '%.java' then 'java' "
    r"when path like '%.dart' then 'flutter' when regexp_matches(path, '\.(html|vue)$') then 'html' end"
)
CTES["repo_languages"] = f"""
select repo_id, language, count(*) as files from (select repo_id, {LANGUAGE} as language from files) where language is not null group by 1, 2"""

SNIPPET = (
    r"case when length(regexp_replace(line, '^\s+|\s+$', '', 'g')) > 160 "
    r"then left(regexp_replace(line, '^\s+|\s+$', '', 'g'), 160) || '…' else regexp_replace(line, '^\s+|\s+$', '', 'g') end"
)


def security_hits(present: bool) -> str:
    return " union all ".join(
        f"select repo_id, path, '{r.rule_id}' as rule_id, line_no, {SNIPPET} as snippet, '{r.severity}' as severity, "
        f"'{r.vector}' as vector, {lit(r.fix)} as fix, {str(r.review).lower()} as review, {i} as rule_position from sec_lines "
        f"where {line_test(r)} and {path_test(r, SECURITY_PATHS)} and {QUIET} and not {SAMPLE.format('line')}"
        + (f" and ({present_test(r)})" if present else "")
        for i, r in enumerate(SECURITY_RULES))


CTES["sec_hits"] = security_hits(True)
CTES["sec_hits_all_packs"] = security_hits(False)

# --- attribution and scoring ------------------------------------------------------------

CTES["blame_files"] = """
select repo_id, path, lower(trim(author_email)) as email, count(*) as n, min(line_no) as first_line from blame_lines group by all"""
CTES["majority"] = """
select repo_id, path, email from (select *, row_number() over (partition by repo_id, path order by n desc, first_line) as k from blame_files)
where k = 1"""
CTES["large"] = """
select repo_id, path, len(string_split(content, chr(10))) as n_lines from smell_readable where n_lines > 200"""
CTES["smell_counts"] = """
select repo_id, email, rule_id, cast(sum(n) as bigint) as n from (
 select h.repo_id, coalesce(lower(trim(b.author_email)), 'unknown') as email, h.rule_id, h.n
 from smell_hits h left join blame_lines b using (repo_id, path, line_no)
 union all
 select l.repo_id, m.email, 'large', 1 from large l join majority m using (repo_id, path)) group by all"""
CTES["lines_owned"] = """
select b.repo_id, b.email, cast(sum(b.n) as bigint) as lines_owned from blame_files b semi join smell_readable r on b.repo_id = r.repo_id and b.path = r.path
group by all"""
WEIGHT = (
    "case when rule_id in ('console', 'tsignore', 'nestedsub') then 3 "
    "when rule_id in ('any', 'dom', 'large', 'imgalt', 'sysout', 'emptycatch', 'print') then 2 else 1 end"
)
CTES["code_scores"] = f"""
select repo_id, email, coalesce(score, 0) as score, coalesce(lines_owned, 0) as lines_owned,
 coalesce(score, 0) / (coalesce(lines_owned, 0) + 500) * 1000 as density
from lines_owned full join (select repo_id, email, cast(sum(n * {WEIGHT}) as bigint) as score from smell_counts group by all) using (repo_id, email)"""
CTES["code_grades"] = """
select *, case when density <= 1.5 then 'A' when density <= 3.5 then 'A-' when density <= 6 then 'B+' when density <= 10 then 'B'
 when density <= 15 then 'B-' when density <= 22 then 'C+' when density <= 30 then 'C' when density <= 40 then 'C-' else 'D' end as derived_code_grade
from code_scores"""

# --- commits ---------------------------------------------------------------------------------

CONVENTIONAL = r"regexp_matches(subject, '^(feat|fix|refactor|chore|docs|style|test|perf|build|ci)(\(.+\))?:')"
TICKET = r"regexp_matches(subject, '([A-Za-z]{2,}-\d+|#\d+)')"


def metrics(where: str = "true") -> str:
    return f"""
select repo_id, lower(trim(author_email)) as email, count(*) as commits, count(*) filter ({CONVENTIONAL}) as conv,
 count(*) filter ({TICKET}) as tickets, arg_max(author_date, (commit_ts, author_date)) as last_active,
 cast(round(count(*) filter ({CONVENTIONAL}) / count(*) * 100) as int) as conv_pct,
 cast(round(count(*) filter ({TICKET}) / count(*) * 100) as int) as ticket_pct
from commits where {where} group by 1, 2"""


CTES["metrics"] = metrics()
CTES["recent_metrics"] = metrics(f"commit_ts >= timestamp '{PERIOD_START} 00:00:00'")
CTES["git_grades"] = """
select repo_id, email, case when score >= 80 then 'A' when score >= 72 then 'A-' when score >= 66 then 'B+' when score >= 58 then 'B'
 when score >= 52 then 'B-' when score >= 46 then 'C+' when score >= 40 then 'C' when score >= 34 then 'C-' else 'D' end as derived_git_grade
from (select repo_id, email, 20 + least(commits / 30, 1) * 35 + conv_pct / 100 * 25 + ticket_pct / 100 * 20 as score from metrics)"""
CTES["discovered"] = """
select repo_id, lower(trim(author_email)) as email, trim(first(author_name order by n desc, author_name, author_email)) as name, cast(sum(n) as bigint) as commits
from (select repo_id, author_name, author_email, count(*) as n from commits group by all) group by 1, 2"""


def churn(where: str) -> str:
    return f"""
select c.repo_id, lower(trim(author_email)) as email, cast(coalesce(sum(added), 0) as bigint) as added, cast(coalesce(sum(deleted), 0) as bigint) as deleted
from commits c left join (select * from commit_files where {where}) f on c.repo_id = f.repo_id and c.sha = f.sha group by 1, 2"""


CTES["churn"] = churn(f"not regexp_matches({NORMAL_PATH}, {lit(EXCLUDED)})")
CTES["churn_all"] = churn("true")
CTES["cadence"] = """
select repo_id, lower(trim(author_email)) as email, strftime(author_date, '%Y-%m') as month, count(*) as commits from commits group by 1, 2, 3"""
CTES["bounds"] = """
select repo_id, min(author_date) as first_date, arg_max(author_date, (commit_ts, author_date)) as through_date from commits group by 1"""
SHADE = fixed("0.15::double + 0.85::double * (c.commits / max(c.commits) over (partition by c.repo_id))", 2)

def heatmap(cells: str) -> str:
    return f"""
select c.repo_id, c.email, cast(7 - s.back as int) as slot, c.month, c.commits,
 strftime(cast(c.month || '-01' as date), '%b') || case when left(c.month, 4) = strftime(b.through_date, '%Y') then '' else ' ''' || substr(c.month, 3, 2) end as label,
 cast({SHADE} as double) as intensity
from {cells} c join (select repo_id, month, dense_rank() over (partition by repo_id order by month desc) as back
 from (select distinct repo_id, month from {cells})) s on s.repo_id = c.repo_id and s.month = c.month and s.back <= 6
join bounds b on b.repo_id = c.repo_id"""


CTES["shown_cadence"] = "select c.* from cadence c semi join people_clean r on r.repo_id = c.repo_id and r.email = c.email"
CTES["shown_metrics"] = "select m.* from metrics m semi join people_clean r on r.repo_id = m.repo_id and r.email = m.email"
CTES["heatmap"] = heatmap("shown_cadence")
CTES["heatmap_history"] = heatmap("cadence")
CTES["people_clean"] = """
select * replace (lower(trim(email)) as email) from roster where trim(email) <> ''
qualify row_number() over (partition by repo_id, lower(trim(email)) order by position) = 1"""
CTES["unlisted"] = """
select * from discovered d where not exists (select 1 from people_clean r where r.repo_id = d.repo_id
 and (contains(d.email, r.email) or contains(r.email, d.email)))"""
CTES["grades_final"] = """
select r.repo_id, r.email, r.name, case when r.git_grade <> '' then r.git_grade else coalesce(derived_git_grade, 'D') end as git_grade,
 case when r.code_grade <> '' then r.code_grade else coalesce(derived_code_grade, 'A') end as code_grade,
 r.git_grade = '' as auto_git, r.code_grade = '' as auto_code
from people_clean r left join git_grades using (repo_id, email) left join code_grades using (repo_id, email)"""
K = "case when {0} >= 1000 then " + fixed("{0} / 1000.0::double", 1) + " || 'k' else cast({0} as string) end"
CLASS = "case when left({0}, 1) in ('A', 'B', 'C', 'D') then lower(left({0}, 1)) else 'x' end"
SLUG = "regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
FIRST = "case when name like 'M. %' or name like 'S. %' then name else string_split(name, ' ')[1] end"

MATRIX_ROWS = [(r.rule_id, r.label) for r in SMELL_RULES] + [("large", "Files &gt; 200 lines")]
CTES["matrix_rules"] = "select * from (values " + ", ".join(f"({lit(i)}, {lit(l)})" for i, l in MATRIX_ROWS) + ") t(rule_id, label)"
CTES["matrix"] = """
select r.repo_id, r.email, r.short, m.rule_id, m.label, coalesce(c.n, 0) as n
from people_clean r semi join metrics a on a.repo_id = r.repo_id and a.email = r.email cross join matrix_rules m
left join smell_counts c on c.repo_id = r.repo_id and c.email = r.email and c.rule_id = m.rule_id where not r.hide_from_cards"""

# --- findings ----------------------------------------------------------------------------------

CTES["gitleaks"] = """
select repo_id, 'Secrets' as vector, 'gitleaks:' || coalesce(RuleID, 'secret') as rule_id, File as path, coalesce(StartLine, 0) as line_no,
 'High' as severity, left(coalesce(RuleID, 'secret') || ' — ' || coalesce(Description, 'potential secret'), 160) as snippet,
 'Rotate the exposed credential immediately and purge it from git history (git filter-repo / BFG); load secrets from env/secret manager. (gitleaks scans full history — this may be in an old commit, not the current file.)' as fix,
 true as review, coalesce(Author, 'unknown') as author_name, coalesce(Email, '') as author_email, 'gitleaks' as source
from gitleaks_raw
qualify row_number() over (partition by repo_id, RuleID, File, StartLine, coalesce(Secret, Match, Description, '') order by ordinal) = 1"""
CTES["semgrep"] = r"""
select repo_id, case when regexp_matches(t, 'xss|cross-site|innerhtml|sanitiz|dom-based|trustedhtml') then 'Injection/XSS'
 when regexp_matches(t, 'sql|nosql|injection|command|ssti|template-?injection|\beval\b|deserial') then 'Injection/XSS'
 when regexp_matches(t, 'redos|regular expression|catastrophic|\bregex\b') then 'ReDoS'
 when regexp_matches(t, 'clipboard|paste') then 'Clipboard'
 when regexp_matches(t, '\bdos\b|denial[- ]of[- ]service|payload size|size limit') then 'LPDoS' else 'SAST (other)' end as vector,
 'semgrep:' || coalesce(check_id, 'rule') as rule_id, path, line_no,
 case sg_severity when 'ERROR' then 'High' when 'INFO' then 'Low' else 'Medium' end as severity,
 left(coalesce(regexp_extract(check_id, '[^.]*$'), '') || ': ' || trim(regexp_replace(coalesce(message, ''), '\s+', ' ', 'g')), 180) as snippet,
 'Apply the remediation from this Semgrep rule (see its rule id / references).' as fix, true as review,
 'unknown' as author_name, '' as author_email, 'semgrep' as source
from (select *, lower(coalesce(check_id, '') || ' ' || coalesce(message, '') || ' ' || coalesce(category, '') || ' ' || coalesce(cwe, '') || ' ') as t from semgrep_flat)"""
CTES["built_in"] = """
select h.repo_id, vector, rule_id, h.path, h.line_no, severity, snippet, fix, review, coalesce(b.author_name, 'unknown') as author_name,
 coalesce(b.author_email, '') as author_email, 'built-in' as source, rule_position
from sec_hits h left join blame_lines b on b.repo_id = h.repo_id and b.path = h.path and b.line_no = h.line_no"""
CTES["merged"] = """
select * from built_in b where not (vector = 'Secrets' and exists (select 1 from gitleaks g where g.repo_id = b.repo_id and g.path = b.path and g.line_no = b.line_no))
union all by name select * from gitleaks"""
CTES["all_findings"] = f"""
select * from (
 select * from merged union all by name
 select s.* replace (coalesce(b.author_name, 'unknown') as author_name) from semgrep s
 left join blame_lines b on b.repo_id = s.repo_id and b.path = s.path and b.line_no = s.line_no)
where not regexp_matches({NORMAL_PATH}, {lit(EXCLUDED)}) and not {SAMPLE.format('snippet')}"""
CTES["findings"] = r"""
select * replace (
 case when client then 'Low' else severity end as severity, client or review as review,
 case when client and not starts_with(snippet, '[Firebase/Web Client Key]') then '[Firebase/Web Client Key] ' || snippet else snippet end as snippet,
 case when client then 'Firebase / client-side Google API key is a public project identifier. Ensure HTTP referrer / package restrictions and Firebase Security Rules are enforced in Google Cloud Console; rotating is not required unless abused.' else fix end as fix)
from (select f.*, vector = 'Secrets' and (regexp_matches(snippet, 'AIza[0-9A-Za-z_-]{30,45}') or contains(rule_id, 'gcp-api-key'))
  and (regexp_matches(f.path, '\.(ts|tsx|js|jsx|html|vue)$', 'i') or regexp_matches(f.path, 'environment', 'i')
   or coalesce(regexp_matches(content, 'firebase|authDomain', 'i'), false) or regexp_matches(snippet, 'firebase|authDomain', 'i')) as client
 from all_findings f left join files using (repo_id, path))"""
SEV = "case severity when 'High' then 0 when 'Medium' then 1 when 'Low' then 2 else 3 end"
SRC = "case source when 'built-in' then 0 when 'gitleaks' then 1 when 'semgrep' then 2 else 3 end"
VEC = "coalesce(list_position(['ReDoS', 'Secrets', 'Injection/XSS', 'LPDoS', 'Clipboard', 'Replay'], vector) - 1, 6)"
ENCOUNTER = f"{SEV}, {SRC}, path, rule_position nulls first, line_no"
CTES["placed"] = f"""
select *, {SEV} as severity_rank, cast(row_number() over (partition by repo_id, vector, rule_id order by {ENCOUNTER}) as int) as place from findings"""
NAME_OF = "case {0} when 0 then 'High' when 1 then 'Medium' when 2 then 'Low' end"
CTES["tally"] = """
select repo_id, vector, rule_id, author_name, count(*) as n, author_name || ' (' || count(*) || ')' as text, min(place) as first_place from placed group by 1, 2, 3, 4"""
CTES["repo_ids"] = "select distinct repo_id from files"
SNAP = "snapshots"


def sql(body: str) -> str:
    """Prefix a query with the table expressions it refers to, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"[a-z_]+", re.sub(r"'(?:[^']|'')*'", "''", text)):
            if word in CTES and word not in needed and word not in visiting:
                visiting.add(word)
                visit(CTES[word])
                visiting.discard(word)
                needed.append(word)

    visiting: set[str] = set()
    visit(body)
    if not needed:
        return body.strip()
    return "with " + ",\n".join(f"{n} as ({CTES[n]})" for n in needed) + "\n" + body.strip()


BODIES: dict[str, str] = {
    "src_commit_log": "select repo_id, sha, author_name, author_email, author_date, cast(commit_ts as date) as commit_date, subject from commits",
    "src_numstat": "select repo_id, sha, path, added, deleted from commit_files",
    "src_blame": "select * replace (lower(author_email) as author_email) from (" + CTES["blame_lines"].replace("line_no % 50 <> 0 and ", "") + ")",
    "src_gitleaks": "select * from gitleaks",
    "src_semgrep": "select * from semgrep",
    "src_roster": "select repo_id, cast(row_number() over (partition by repo_id order by position) - 1 as int) as position, email, name, short, domain, git_grade, code_grade, hide_from_cards from roster",
    "path_exclusion": f"select {NORMAL_PATH} as path, count(*) as n from commit_files where not regexp_matches({NORMAL_PATH}, {lit(EXCLUDED)}) group by 1",
    "generated_exclusion": f"select repo_id, path from files where not regexp_matches(path, {lit(GENERATED)}, 'i')",
    "minified_filter": f"select repo_id, path from files where {HANDWRITTEN}",
    "inline_suppression": f"select repo_id, path, line_no from numbered where not ({QUIET})",
    "sample_credential_filter": f"select repo_id, path, line_no from numbered where {SAMPLE.format('line')}",
    "period_filter": "select * from recent_metrics",
    "active_authors": "select r.repo_id, r.email, m.commits from people_clean r join recent_metrics m using (repo_id, email)",
    "conventional_pct": f"select repo_id, count(*) as commits, count(*) filter ({CONVENTIONAL}) as conv, cast(round(count(*) filter ({CONVENTIONAL}) / count(*) * 100) as int) as conv_pct from commits group by 1",
    "ticket_pct": f"select repo_id, count(*) as commits, count(*) filter ({TICKET}) as tickets, cast(round(count(*) filter ({TICKET}) / count(*) * 100) as int) as ticket_pct from commits group by 1",
    "git_grade": "select * from git_grades",
    "repo_dim": r"select repo_id, remote_url, regexp_extract(regexp_replace(remote_url, '\.git$', ''), '([^/]*)/*$', 1) as repo_name from repos",
    "sast_vector_map": "select rule_id, vector, severity, count(*) as n from semgrep group by all",
    "author_metrics": "select * from metrics",
    "discover_authors": "select * from discovered",
    "line_churn": "select * from churn",
    "monthly_cadence": "select * from cadence",
    "last_active": "select repo_id, email, last_active from metrics",
    "date_bounds": "select * from bounds",
    "month_heatmap": "select * from heatmap",
    "month_heatmap_history": "select * from heatmap_history",
    "month_heatmap_wide": "select repo_id, email, " + ", ".join(
        f"cast(coalesce(sum(commits) filter (slot = {i}), 0) as bigint) as month_{i}" for i in range(1, 7)) + " from heatmap group by 1, 2",
    "cadence_text": "select repo_id, email, string_agg(label || ' ' || commits, ' / ' order by slot) as cadence from heatmap group by 1, 2",
    "commit_bars": f"select *, cast({fixed('commits / max_commits * 100', 1)} as double) as share from (select repo_id, email, commits, max(commits) over (partition by repo_id) as max_commits from shown_metrics)",
    "team_totals": "select repo_id, cast(sum(commits) as bigint) as team_commits, max(commits) as max_commits, (select max(h.commits) from heatmap h where h.repo_id = m.repo_id) as max_month from shown_metrics m group by 1",
    "staleness": "select repo_id, email, last_active, through_date, date_diff('day', last_active, through_date) > 21 as stale from shown_metrics join bounds using (repo_id)",
    "dedupe_roster": "select * from people_clean",
    "missing_authors": "select * from unlisted",
    "missing_top10": "select *, greatest(n_missing - 10, 0) as n_more from (select *, cast(row_number() over (partition by repo_id order by commits desc, email) as int) as place, count(*) over (partition by repo_id) as n_missing from unlisted) where place <= 10",
    "author_contains": "select r.repo_id, r.email, count(*) as commits from people_clean r join commits c on c.repo_id = r.repo_id and contains(c.author_name || ' <' || c.author_email || '>', r.email) group by 1, 2",
    "language_counts": "select * from repo_languages",
    "dominant_language": "select repo_id, coalesce(language, 'generic') as language from repo_ids left join (select repo_id, language from repo_languages qualify row_number() over (partition by repo_id order by files desc, list_position(['typescript', 'java', 'flutter', 'html'], language)) = 1) using (repo_id)",
    "merged_rules": "select repo_id, family, rule_id, vector, severity, review, weight, block, string_agg(pack, ',' order by pack) as packs from (select repo_id, language as pack from repo_languages union all select repo_id, 'generic' from repo_ids) join (values "
    + ", ".join(
        f"('{r.family}', '{r.rule_id}', '{p}', {lit(r.vector) if r.vector else 'null'}, {lit(r.severity) if r.severity else 'null'}, {str(r.review).lower()}, {r.weight}, {str(r.block).lower()})"
        for r in (*SMELL_RULES, *SECURITY_RULES) for p in r.packs)
    + ", " + ", ".join(f"('smell', 'large', '{p}', null, null, false, 2, false)" for p in SMELL_PATHS)
    + ") t(family, rule_id, pack, vector, severity, review, weight, block) using (pack) group by all",
    "smell_line_hits": "select * from smell_line_hits",
    "smell_block_hits": "select * from smell_block_hits",
    "security_line_hits": "select repo_id, path, rule_id, line_no, snippet, severity, vector from sec_hits",
    "large_files": "select * from large",
    "scan_stats": f"select repo_id, count(*) as files, count(*) filter (len(string_split(content, chr(10))) > 200 and {HANDWRITTEN}) as large_files from smell_listed group by 1",
    "file_majority_owner": "select * from majority",
    "attributed_hits": "select h.*, coalesce(b.author_name, 'unknown') as author_name, b.author_email from smell_hits h left join blame_lines b using (repo_id, path, line_no)",
    "lines_owned": "select * from lines_owned",
    "smell_counts": "select * from smell_counts",
    "disabled_rules": None,
    "code_grade": "select * from code_grades",
    "issue_matrix": "select * from matrix",
    "issue_matrix_heat": f"select repo_id, email, rule_id, case when n > 0 then cast({fixed('least(0.06::double + n / 55 * 0.7::double, 0.7::double)', 2)} as double) end as intensity from matrix",
    "issue_matrix_by_rule": "select repo_id, email, short, " + ", ".join(
        f'cast(sum(n) filter (rule_id = {lit(i)}) as bigint) as "{i}"' for i, _ in MATRIX_ROWS) + " from matrix group by 1, 2, 3",
    "final_grades": "select * from grades_final",
    "author_cards": f"""
select r.repo_id, r.email, {FIRST} as short_name, {SLUG} as slug, coalesce(m.commits, 0) as commits, {K.format('coalesce(added, 0)')} as added_text,
 {K.format('coalesce(deleted, 0)')} as deleted_text, coalesce(conv_pct, 0) as conv_pct, coalesce(tickets, 0) as tickets,
 case when r.git_grade <> '' then r.git_grade else coalesce(derived_git_grade, 'D') end as git_grade, {CLASS.format('git_grade')} as git_class
from people_clean r join metrics m using (repo_id, email) left join churn_all using (repo_id, email)
left join git_grades using (repo_id, email) where not hide_from_cards""".replace(CLASS.format("git_grade"), CLASS.format("(case when r.git_grade <> '' then r.git_grade else coalesce(derived_git_grade, 'D') end)")),
    "author_report": f"""
select r.repo_id, r.email, r.name, {FIRST.replace('name', 'r.name')} as short_name, {SLUG.replace('name', 'r.name')} as slug,
 coalesce(m.commits, 0) as commits, coalesce(conv, 0) as conv, coalesce(tickets, 0) as tickets, coalesce(conv_pct, 0) as conv_pct,
 coalesce(ticket_pct, 0) as ticket_pct, last_active, coalesce(added, 0) as added, coalesce(deleted, 0) as deleted,
 {K.format('coalesce(added, 0)')} as added_text, {K.format('coalesce(deleted, 0)')} as deleted_text,
 coalesce(score, 0) as score, coalesce(lines_owned, 0) as lines_owned, g.git_grade, g.code_grade,
 {CLASS.format('g.git_grade')} as git_class, {CLASS.format('g.code_grade')} as code_class, g.auto_git, g.auto_code, r.hide_from_cards
from people_clean r join grades_final g using (repo_id, email) left join metrics m using (repo_id, email) left join churn using (repo_id, email)
left join code_grades using (repo_id, email)""",
    "security_findings": "select repo_id, vector, rule_id, path, line_no, severity, snippet, fix, review, author_name, author_email, source from findings",
    "client_key_downgrade": "select repo_id, rule_id, severity, review, count(*) as n from findings where vector = 'Secrets' group by all",
    "secrets_merged": "select repo_id, vector, rule_id, path, line_no, source, author_name from merged",
    "dedupe_feed": "select repo_id, rule_id, path, line_no, snippet, author_name from gitleaks",
    "severity_counts": "select repo_id, count(*) as total, count(*) filter (severity = 'High') as high, count(*) filter (severity = 'Medium') as medium, count(*) filter (severity = 'Low') as low from findings group by 1",
    "vector_counts": f"select repo_id, vector, coalesce(n, 0) as n, {NAME_OF.format('worst')} as worst_severity from (select repo_id, unnest(['ReDoS', 'Secrets', 'Injection/XSS', 'LPDoS', 'Clipboard', 'Replay']) as vector from repo_ids) full join (select repo_id, vector, count(*) as n, min({SEV}) as worst from findings group by all) using (repo_id, vector)",
    "engine_counts": "select repo_id, source, vector, coalesce(n, 0) as n from (select repo_id, unnest(['built-in', 'gitleaks', 'semgrep']) as source from repo_ids) left join (select repo_id, source, vector, count(*) as n from findings group by all) using (repo_id, source)",
    "owner_tally": "select repo_id, vector, rule_id, author_name, n, text from tally",
    "owner_lines": "select repo_id, vector, rule_id, string_agg(text, ', ' order by n desc, first_place) as owners from tally group by all",
    "worst_severity": f"select repo_id, vector, rule_id, count(*) as n, {NAME_OF.format(f'min({SEV})')} as worst_severity from findings group by 1, 2, 3",
    "top_findings": "select repo_id, vector, rule_id, place, path, line_no, severity, n_group, greatest(n_group - 20, 0) as n_more from (select *, count(*) over (partition by repo_id, vector, rule_id) as n_group from placed) where place <= 20",
    "findings_ranked": f"select repo_id, vector, {VEC} as vector_rank, severity, {SEV} as severity_rank, rule_id, path, line_no, source from findings",
    "delta_vs_snapshot": "select m.repo_id, m.email, m.commits, s.commits as previous_commits, m.commits - s.commits as vs_snapshot from metrics m left join snapshots s using (repo_id, email)",
    "snapshot_rows": f"select m.repo_id, m.email, m.commits, added, deleted, m.last_active, date '{SNAPSHOT_DATE}' as previous_compiled_date, through_date as compiled_date from metrics m join churn using (repo_id, email) join bounds using (repo_id)",
    "delta_report": f"""
select m.repo_id, m.email, m.commits, s.commits as previous_commits, m.commits - s.commits as vs_snapshot,
 (select count(*) from commits c where c.repo_id = m.repo_id and lower(trim(c.author_email)) = m.email and c.commit_ts >= timestamp '{SNAPSHOT_DATE} 00:00:00') as since,
 case when r.git_grade <> '' then r.git_grade else derived_git_grade || '*' end || '/' || case when r.code_grade <> '' then r.code_grade else '—' end as grades
from metrics m join people_clean r using (repo_id, email) left join snapshots s using (repo_id, email) join git_grades using (repo_id, email)""",
    "stream_author_metrics": "select * from metrics",
    "stream_findings": "select h.repo_id, h.path, rule_id, h.line_no, snippet, severity, vector, coalesce(b.author_name, 'unknown') as author_name, b.author_email "
    "from sec_hits_all_packs h left join blame_lines b using (repo_id, path, line_no)",
    "stream_snapshots": "select repo_id, email, commits, last_active, max(last_active) over (partition by repo_id) as compiled_date from metrics",
}
BODIES["disabled_rules"] = (
    "select repo_id, email, rule_id, cast(sum(n) as bigint) as n from (select h.repo_id, coalesce(lower(trim(b.author_email)), 'unknown') as email, h.rule_id, h.n "
    "from whole_hits h left join blame_lines b using (repo_id, path, line_no)) group by all")
# The same scan without the path exclusions and with some rules switched off.
CTES["whole_readable"] = CTES["smell_listed"].replace(LISTED, f"not regexp_matches(path, {lit(GENERATED)}, 'i')") + f" and {HANDWRITTEN}"
CTES["whole_lines"] = CTES["smell_lines"].replace("smell_readable", "whole_readable")
CTES["whole_block_hits"] = CTES["smell_block_hits"].replace("smell_readable", "whole_readable")
CTES["whole_hits"] = (
    f"select * from ({CTES['smell_line_hits'].replace('from smell_lines', 'from whole_lines')} union all select * from whole_block_hits) "
    f"where rule_id not in ({', '.join(map(lit, DISABLED))})")

PLACES = ", ".join(f"cast(sum(n) filter (place % 10 = {i}) as bigint) as p{i}" for i in range(10))
CELL_SHADE = fixed("least(0.06::double + n / 55 * 0.7::double, 0.7::double)", 2)
CTES["seated"] = """
select *, cast(dense_rank() over (partition by repo_id order by short, email) - 1 as int) as place from matrix"""
CTES["sheet_people"] = """
select repo_id, place // 10 as sheet, string_agg(short, ', ' order by place) as people
from (select distinct repo_id, place, short from seated) group by all"""
BODIES["issue_matrix_by_author"] = f"""
select m.repo_id, cast(sheet as int) as sheet, rule_id, label, any_value(people) as people, {PLACES}
from seated m join sheet_people s on s.repo_id = m.repo_id and s.sheet = m.place // 10 group by m.repo_id, sheet, rule_id, label"""
BODIES["issue_matrix_override"] = f"""
select repo_id, label, short, cast(n as string) as cell, case when n > 0 then cast({CELL_SHADE} as double) end as intensity
from matrix where repo_id <> 'r0'
union all select repo_id, 'Row ' || n, short, case n when 0 then '—' else cast(n as string) end,
 case when n > 0 then cast({CELL_SHADE} as double) end from (select repo_id, short, position as n from roster) where repo_id = 'r0' and n < 5"""
BODIES["roster_scaffold"] = """
select repo_id, -commits as position, email, name, string_split(name, ' ')[1] as short, '' as domain, '' as git_grade, '' as code_grade,
 false as hide_from_cards from discovered"""
BODIES["page_findings"] = f"""
select repo_id, vector, rule_id, source, place, path, line_no, n_group, greatest(n_group - 15, 0) as n_more from (
 select *, cast(row_number() over (partition by repo_id, vector, rule_id, source order by {ENCOUNTER}) as int) as place,
  count(*) over (partition by repo_id, vector, rule_id, source) as n_group from findings) where place <= 15"""
BODIES["rule_coverage"] = """
select family, rule_id, cast(sum(n) as bigint) as n from (
 select 'smell' as family, rule_id, n from smell_hits union all select 'smell', 'large', 1 from large
 union all select 'security', rule_id, 1 from sec_hits) group by all"""
BODIES["custom_rules"] = rf"""
select h.repo_id, coalesce(lower(trim(b.author_email)), 'unknown') as email, rule_id, count(*) as n from (
 select *, 'licence' as rule_id from own_lines where regexp_matches(line, '\bLicensed under\b')
 union all select *, 'pass' from own_lines where line = 'pass') h
left join blame_lines b using (repo_id, path, line_no) where {QUIET} group by all
union all select repo_id, m.email, 'large', count(*) from own_large join majority m using (repo_id, path) group by all"""
CTES["own_readable"] = rf"select * from files where regexp_matches(path, '\.(py|env)$') and {LISTED} and {HANDWRITTEN}"
CTES["own_lines"] = "select n.* from numbered n semi join own_readable r on n.repo_id = r.repo_id and n.path = r.path"
CTES["own_large"] = "select * from own_readable where len(string_split(content, chr(10))) > 200"

BODIES["author_report_stored"] = BODIES["author_report"]
BODIES["security_findings_stored"] = BODIES["security_findings"]

BODIES["src_gitleaks_files"] = BODIES["src_gitleaks"]
BODIES["src_semgrep_files"] = BODIES["src_semgrep"]
BODIES["src_files"] = f"""
select repo_id, path, octet_length(encode(content)) as n_bytes, sha256(content) as sha256, null as problem from files
union all select repo_id, '{NOT_A_TEXT}', 6, null, 'not UTF-8' from repo_ids"""

# --- settings of each repository: the globs' patterns are written out by hand -------------------------

CTES["own_settings"] = """
select repo_id, try_cast(left(start, 10) as date) as since, nullif(trim(coalesce(language, '')), '') as language,
 list_distinct(list_concat(string_split(disabled, '|'), ['ignore'])) as disabled, case repo_id
 when 'r0' then '(^|/)(legacy/.*|docs/.*|package-lock\\.json|[^/]*\\.snap|vendor/[^/]*)($|/)'
 when 'r1' then '(^|/)(vendor/[^/]*|src/[^/]*/d1[^/]\\.[^/]*|[^/]*\\.snap)($|/)'
 when 'r2' then '(^|/)(legacy/.*|package-lock\\.json|[^/]*\\.snap|vendor/[^/]*)($|/)'
 when 'r3' then '(^|/)(scripts/.*|[^/]*\\.snap|vendor/[^/]*)($|/)' end as excluded
from settings_raw""".replace("\\\\", "\\")
BODIES["repo_settings"] = """
select repo_id, try_cast(left(start, 10) as date) as since, nullif(trim(coalesce(language, '')), '') as language,
 array_to_string(list_sort(list_distinct([x for x in list_concat(string_split(disabled, '|'), ['ignore']) if x <> ''])), '|') as disabled,
 array_to_string(list_sort(list_distinct([x for x in list_concat(string_split(exclude, '|'), coalesce(globs, []), ['*.snap', 'vendor/*']) if x <> ''])), '|') as exclude
from settings_raw left join (
 select repo_id, list(trim(value)) as globs from ignore_lines where trim(value) <> '' and value not like '#%' group by 1) using (repo_id)"""
CTES["own_commits"] = "select c.* from commits c join own_settings s on s.repo_id = c.repo_id and (since is null or commit_ts >= since)"
BODIES["period_by_repo"] = metrics().replace("from commits", "from own_commits")
BODIES["settings_churn"] = churn("true").replace("from commits c", "from own_commits c").replace(
    "select * from commit_files where true",
    f"select f.* from commit_files f join own_settings s on s.repo_id = f.repo_id and not regexp_matches({NORMAL_PATH}, excluded)")
CTES["every_hit"] = f"{CTES['smell_line_hits'].replace('from smell_lines', 'from whole_lines')} union all select * from whole_block_hits"


def in_named_pack(paths, rules=None) -> str:
    """No pack is named, or the named one takes in the path (and the rule is its own)."""
    parts = []
    for pack, pattern in paths.items():
        own = "" if rules is None else " and rule_id in ('', " + ", ".join(lit(r.rule_id) for r in rules if pack in r.packs) + ")"
        parts.append(f"(language = '{pack}' and regexp_matches(path, {lit(pattern)}){own})")
    return f"(language is null or language not in ({', '.join(map(lit, paths))}) or " + " or ".join(parts) + ")"


CTES["own_smell_hits"] = f"""
select h.* from every_hit h join own_settings s on s.repo_id = h.repo_id and not regexp_matches({NORMAL_PATH}, excluded)
 and not list_contains(disabled, rule_id) and {in_named_pack(SMELL_PATHS, SMELL_RULES)}"""
CTES["own_smell_files"] = f"""
select h.*, disabled from whole_readable h join own_settings s on s.repo_id = h.repo_id and not regexp_matches({NORMAL_PATH}, excluded)
 and {in_named_pack(SMELL_PATHS)}"""
BODIES["settings_smell_counts"] = """
select repo_id, email, rule_id, cast(sum(n) as bigint) as n from (
 select h.repo_id, coalesce(lower(trim(b.author_email)), 'unknown') as email, h.rule_id, h.n
 from own_smell_hits h left join blame_lines b using (repo_id, path, line_no)
 union all select repo_id, m.email, 'large', 1 from own_smell_files join majority m using (repo_id, path)
 where len(string_split(content, chr(10))) > 200 and not list_contains(disabled, 'large')) group by all"""
BODIES["settings_lines_owned"] = CTES["lines_owned"].replace("smell_readable", "own_smell_files")
CTES["whole_sec_readable"] = CTES["sec_listed"].replace(LISTED, f"not regexp_matches(path, {lit(GENERATED)}, 'i')") + f" and {HANDWRITTEN}"
CTES["whole_sec_lines"] = CTES["sec_lines"].replace("sec_readable", "whole_sec_readable")


def own_presence(rule) -> str:
    named = " or ".join(f"(language = '{p}' and regexp_matches(path, {lit(SECURITY_PATHS[p])}))" for p in rule.packs)
    unnamed = f"(language is null or language not in ({', '.join(map(lit, SECURITY_PATHS))})) and ({present_test(rule).replace('repo_id in', 'l.repo_id in')})"
    return f"({named} or {unnamed})".replace("select repo_id from repo_languages where language", "select x.repo_id from repo_languages x where x.language")


CTES["own_sec_hits"] = " union all ".join(
    f"select l.repo_id, path, '{r.rule_id}' as rule_id, line_no, {SNIPPET} as snippet, '{r.severity}' as severity, '{r.vector}' as vector, "
    f"{lit(r.fix)} as fix, {str(r.review).lower()} as review, {i} as rule_position from whole_sec_lines l join own_settings s on s.repo_id = l.repo_id "
    f"and not regexp_matches({NORMAL_PATH}, excluded) and not list_contains(disabled, '{r.rule_id}') "
    f"where {line_test(r)} and {path_test(r, SECURITY_PATHS)} and {QUIET} and not {SAMPLE.format('line')} and {own_presence(r)}"
    for i, r in enumerate(SECURITY_RULES))
BODIES["settings_security_hits"] = "select repo_id, path, rule_id, line_no, severity from own_sec_hits"
CTES["own_built_in"] = CTES["built_in"].replace("from sec_hits", "from own_sec_hits")
CTES["own_merged"] = CTES["merged"].replace("from built_in", "from own_built_in")
CTES["own_all"] = CTES["all_findings"].replace("select * from (", "select f.* from (").replace("select * from merged", "select * from own_merged").replace(
    f"where not regexp_matches({NORMAL_PATH}, {lit(EXCLUDED)}) and",
    f"f join own_settings s on s.repo_id = f.repo_id where not regexp_matches({NORMAL_PATH}, excluded) and not list_contains(disabled, rule_id) and")
CTES["own_findings"] = CTES["findings"].replace("from all_findings", "from own_all")
BODIES["settings_findings"] = "select repo_id, path, rule_id, line_no, severity, source from own_findings"

# --- own block rules, run-length blame -------------------------------------------------------------


def own_block(rule_id: str, pattern: str, paths: str = "") -> str:
    """Lines in which matches begin, by the same marks as the built-in block rules' check."""
    return f"""
select repo_id, path, '{rule_id}' as rule_id, line_no, n from (
 select repo_id, path, unnest(range(1, len(ls) + 1)) as line_no, unnest([length(x) - length(replace(x, chr(57344), '')) for x in ls]) as n from (
  select repo_id, path, string_split(regexp_replace(content, {lit('(' + pattern + ')')}, chr(57344) || '\\1', 'g'), chr(10)) as ls
  from smell_readable where true {paths})) where n > 0"""


# Without a back reference: the same quote at both ends, written out for each.
BODIES["custom_block_rules"] = f"""
select h.repo_id, h.path, rule_id, cast(line_no as int) as line_no, cast(n as int) as n, false as failed from (
 {own_block('runs', r'(a|e|n|r|t|h| )*\.')}
 union all {own_block('braces', r'\{([^{}]|\s)*\}')}
 union all {own_block('quoted', r'"[^"\n]*"\s*[;)]|' + r"'[^'\n]*'\s*[;)]", r"and regexp_matches(path, '\.(ts|java)$')")}) h
join numbered using (repo_id, path, line_no) where {QUIET}
union all select repo_id, path, 'broken', null, 0, true from smell_readable where path like '%.dart'"""

CTES["blame_stretches"] = """
select repo_id, path, line_no, 'Dev ' || cast((length(path) * 7 + (line_no - 1) // 8) % 37 as string) as author_name,
 'dev' || cast((length(path) * 7 + (line_no - 1) // 8) % 37 as string) || '@ex.com' as author_email
from (select *, max(line_no) over (partition by repo_id, path) as last_no from numbered)
where (line_no - 1) // 8 % 9 <> 5 and not (line = '' and line_no = last_no)"""
BODIES["blame_run_lengths"] = """
select repo_id, path, cast(min(line_no) as int) as first_line, cast(max(line_no) as int) as last_line, author_name, author_email
from blame_stretches group by repo_id, path, (line_no - 1) // 8, author_name, author_email"""
CTES["stretch_files"] = CTES["blame_files"].replace("blame_lines", "blame_stretches")
BODIES["attributed_hits_runs"] = BODIES["attributed_hits"].replace("blame_lines", "blame_stretches")
BODIES["lines_owned_runs"] = CTES["lines_owned"].replace("blame_files", "stretch_files")
BODIES["file_majority_owner_runs"] = CTES["majority"].replace("blame_files", "stretch_files")

ORACLES: dict[str, str] = {name: sql(body) for name, body in BODIES.items()}
