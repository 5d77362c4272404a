"""The rule catalogue: code smells, security signals and the packs they belong to.

Rules are data.  A user appends their own ``Rule`` objects or drops built-in ones
by id; the scan operators only ever see the resulting list.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

SMELL = "smell"
SECURITY = "security"


@dataclass(frozen=True)
class Rule:
    """One detection rule.

    ``pattern`` is written in the portable regex dialect described in
    ``functions.patterns``.  ``block`` rules look at the whole text and count
    every match; the others look at one line and count it once.  ``guards`` are
    literals of which every match contains at least one; they only save time.
    """

    rule_id: str
    family: str
    packs: tuple[str, ...]
    pattern: str
    guards: tuple[str, ...] = ()
    label: str = ""
    weight: int = 1
    vector: str | None = None
    severity: str | None = None
    review: bool = False
    fix: str | None = None
    block: bool = False
    ignore_case: bool = False
    dot_all: bool = False
    path_include: str | None = None
    path_include_ignore_case: bool = False
    path_exclude: str | None = None
    path_exclude_ignore_case: bool = False


@dataclass(frozen=True)
class Pack:
    pack_id: str
    label: str
    position: int
    smell_globs: tuple[str, ...]
    security_globs: tuple[str, ...]


# ---------------------------------------------------------------------------
# File globs, patterns, weights, labels and advice that decide the
# results.  Kept verbatim, in natural order.
# ---------------------------------------------------------------------------

CONFIG_GLOBS = (
    "*.env*", "*.json", "*.yml", "*.yaml", "*.properties", "*.ini", "*.cfg",
    "*.conf", "*.toml", "*.sh", "*.xml", "*Dockerfile*", "*.tf",
)
SCRIPT_GLOBS = ("*.ts", "*.tsx", "*.js", "*.jsx", "*.mjs", "*.cjs")
TEMPLATE_GLOBS = ("*.html", "*.vue")
OTHER_SOURCE_GLOBS = (
    "*.py", "*.rb", "*.go", "*.rs", "*.php", "*.cs", "*.kt", "*.swift",
    "*.scala", "*.c", "*.cc", "*.cpp", "*.h",
)

PACKS: dict[str, Pack] = {
    p.pack_id: p
    for p in (
        Pack("typescript", "TypeScript", 0, SCRIPT_GLOBS,
             ("*.ts", "*.tsx", "*.js", "*.jsx", "*.html", "*.vue", *CONFIG_GLOBS)),
        Pack("java", "Java", 1, ("*.java",), ("*.java", *CONFIG_GLOBS)),
        Pack("flutter", "Flutter / Dart", 2, ("*.dart",), ("*.dart", *CONFIG_GLOBS)),
        Pack("html", "Templates", 3, TEMPLATE_GLOBS, TEMPLATE_GLOBS),
        Pack("generic", "Generic", 4, OTHER_SOURCE_GLOBS, (*OTHER_SOURCE_GLOBS, *CONFIG_GLOBS)),
    )
}

EXTENSION_LANGUAGE = {
    "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript",
    "mjs": "typescript", "cjs": "typescript", "java": "java", "dart": "flutter",
    "html": "html", "vue": "html",
}

VECTORS = ("ReDoS", "Secrets", "Injection/XSS", "LPDoS", "Clipboard", "Replay")
SAST_OTHER = "SAST (other)"
SEVERITIES = ("High", "Medium", "Low")
LARGE_FILE_LINES = 200
LARGE_RULE_ID = "large"
LARGE_LABEL = "Files &gt; 200 lines"
LARGE_WEIGHT = 2

_TS = ("typescript",)
_SECRET_PACKS = ("typescript", "html", "java", "flutter", "generic")
_WEB = ("typescript", "html")
_PAYMENT_PATH = r"(checkout|payment|charge|billing|transfer|payout|refund)"

SMELL_RULES: tuple[Rule, ...] = (
    Rule("any", SMELL, _TS, r"(:\s*any\b|\bas any\b|<any>)", ("any",),
         "<code>any</code> types", 2),
    Rule("console", SMELL, _TS, r"\bconsole\.(log|error|warn|info|debug)\b", ("console.",),
         "<code>console.*</code>", 3,
         path_exclude=r"(server|main|bootstrap|\.spec\.|polyfills)|(^|\/)(scripts|tools)\/",
         path_exclude_ignore_case=True),
    Rule("subs", SMELL, _TS, r"\.subscribe\(", (".subscribe(",), "Bare subscriptions", 1),
    Rule("dom", SMELL, _TS, r"\b(window|document)\.(?!.*isPlatformBrowser)",
         ("window.", "document."), "Unguarded DOM", 2,
         path_exclude=r"(server|main|bootstrap)", path_exclude_ignore_case=True),
    Rule("todo", SMELL, ("typescript", "html", "java", "flutter", "generic"),
         r"\b(TODO|FIXME)\b", ("TODO", "FIXME"), "TODO / FIXME", 1),
    Rule("nonnull", SMELL, _TS, r"[\w\)\]]!\.", ("!.",), "Non-null <code>!.</code>", 1),
    Rule("onpush", SMELL, _TS,
         r"@Component\s*\(\s*\{(?:(?!changeDetection)[\s\S])*?\}\s*\)", ("@Component",),
         "Component without <code>OnPush</code>", 1, block=True, path_include=r"\.ts$"),
    Rule("nestedsub", SMELL, _TS,
         r"\.subscribe\((?:[^()]|\([^()]*\))*\.subscribe\(", (".subscribe(",),
         "Nested <code>subscribe()</code>", 3, block=True, dot_all=True, path_include=r"\.ts$"),
    Rule("tsignore", SMELL, _TS, r"@ts-(ignore|nocheck)\b", ("@ts-",),
         "<code>@ts-ignore</code> / <code>@ts-nocheck</code>", 3),
    Rule("deepimport", SMELL, _TS, r"""from\s+['"](\.\.\/){4,}""", ("../../../../",),
         "Deep relative import", 1),
    Rule("ctordi", SMELL, _TS,
         r"constructor\s*\([^)]*\b(private|public|protected)\s+\w+\s*:", ("constructor",),
         "Constructor DI over <code>inject()</code>", 1, path_include=r"\.ts$"),
    Rule("emptycatch", SMELL, ("typescript", "java"),
         r"catch\s*(?:\([^)]*\))?\s*\{\s*\}", ("catch",), "Empty catch block", 2, block=True),
    Rule("sysout", SMELL, ("java",), r"System\.(out|err)\.print", ("System.",),
         "<code>System.out/err</code>", 2),
    Rule("stacktrace", SMELL, ("java",), r"\.printStackTrace\s*\(", (".printStackTrace",),
         "<code>printStackTrace()</code>", 1),
    Rule("streq", SMELL, ("java",), r'"\s*==|==\s*"', ("==",), "<code>==</code> on strings", 1),
    Rule("print", SMELL, ("flutter",), r"(^|[^.\w])print\s*\(", ("print",),
         "<code>print()</code>", 2),
    Rule("nullassert", SMELL, ("flutter",), r"\w!(\.|;|,|\)|\s*$)", ("!",),
         "Null assertion <code>!</code>", 1),
    Rule("ignore", SMELL, ("flutter",), r"\/\/\s*ignore:", ("ignore:",),
         "<code>// ignore:</code> lint", 1),
    Rule("imgalt", SMELL, ("html",),
         r"<img\b(?:(?!\[?(attr\.)?alt\]?\s*=)[^>])*>", ("<img",),
         "<code>&lt;img&gt;</code> without alt", 2, block=True, ignore_case=True, dot_all=True),
    Rule("btntype", SMELL, ("html",),
         r"<button\b(?:(?!\[?type\]?\s*=)[^>])*>", ("<button",),
         "<code>&lt;button&gt;</code> without type", 1, block=True, ignore_case=True, dot_all=True),
    Rule("legacycf", SMELL, ("html",), r"\*ng(If|For|Switch)\b", ("*ng",),
         "Legacy <code>*ngIf</code>/<code>*ngFor</code>", 1),
)

SECURITY_RULES: tuple[Rule, ...] = (
    Rule("redos-nested-quant", SECURITY, _WEB,
         r"\/[^/\n]*\([^)\n]*[+*][^)\n]*\)[+*][^/\n]*\/", (")+", ")*"),
         vector="ReDoS", severity="Medium", review=True,
         fix="Rewrite to avoid nested quantifiers (e.g. `(a+)+`); anchor the pattern and cap input "
             "length before matching (e.g. reject inputs over N chars)."),
    Rule("redos-user-input", SECURITY, _WEB, r"new RegExp\(", ("new RegExp(",),
         vector="ReDoS", severity="Low", review=True,
         fix="Dynamic RegExp from variables is risky if the source is user-controlled. "
             "Validate/escape the input and bound its length."),
    Rule("secret-assign", SECURITY, _SECRET_PACKS,
         r"""[A-Za-z0-9_-]*(api[_-]?key|secret|passwd|password|token|credentials?|private[_-]?key)"""
         r"""[A-Za-z0-9_-]*["']?\s*[:=]\s*['"][^'"]{12,}['"]""",
         ("key", "secret", "passw", "token", "credential"),
         vector="Secrets", severity="High", review=True, ignore_case=True, path_exclude=r"\.html$",
         fix="Move to an env var / secret manager; never commit literal secrets. Rotate anything "
             "that was committed."),
    Rule("secret-config-assign", SECURITY, _SECRET_PACKS,
         r"""[A-Za-z0-9_-]*(api[_-]?key|secret|passwd|password|token|credentials?)[A-Za-z0-9_-]*"""
         r"""\s*[:=]\s*(?!["'\s$#{<%])[^\s"'#]{12,}""",
         ("key", "secret", "passw", "token", "credential"),
         vector="Secrets", severity="High", review=True, ignore_case=True,
         path_include=r"\.(env|properties|ini|cfg|conf|toml|ya?ml|sh)(\.|$)|(^|\/)\.env",
         path_include_ignore_case=True,
         fix="Move the value to a secret manager and reference it ($VAR / vault lookup). Rotate "
             "anything that was committed."),
    Rule("secret-privkey", SECURITY, _SECRET_PACKS,
         r"-----BEGIN (RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----", ("PRIVATE KEY-----",),
         vector="Secrets", severity="High",
         fix="Remove the private key from the repo and rotate it immediately."),
    Rule("secret-aws", SECURITY, _SECRET_PACKS, r"\bAKIA[0-9A-Z]{16}\b", ("AKIA",),
         vector="Secrets", severity="High",
         fix="AWS access key ID committed — revoke/rotate now and move to a secret store."),
    Rule("secret-nonpublic-env", SECURITY, _SECRET_PACKS,
         r"""process\.env\[?['"]?(?!(NG_APP_|ANGULAR_APP_|NEXT_PUBLIC_|VITE_|REACT_APP_|PUBLIC_|NODE_ENV|PORT))"""
         r"""[A-Z][A-Z0-9_]{2,}""",
         ("process.env",), vector="Secrets", severity="Medium", review=True,
         path_include=r"(component|\.page\.|\/app\/|src\/app\/|browser)",
         path_include_ignore_case=True,
         fix="Private env vars must not reach browser bundles. Expose only public-prefixed vars "
             "client-side; keep secrets server-only (BFF)."),
    Rule("xss-bypass", SECURITY, _WEB,
         r"bypassSecurityTrust(Html|Url|ResourceUrl|Script|Style)\s*\(", ("bypassSecurityTrust",),
         vector="Injection/XSS", severity="High", review=True,
         fix="Avoid bypassing Angular sanitization on untrusted input. If unavoidable, "
             "sanitize/allowlist first and confine to trusted, non-user data."),
    Rule("xss-innerhtml", SECURITY, _WEB,
         r"\.(innerHTML|outerHTML)\s*=|dangerouslySetInnerHTML|\bv-html\b",
         (".innerHTML", ".outerHTML", "dangerouslySetInnerHTML", "v-html"),
         vector="Injection/XSS", severity="High", review=True,
         fix="Render via text binding, or sanitize with DomSanitizer / DOMPurify before injecting HTML."),
    Rule("xss-eval", SECURITY, _WEB, r"\beval\s*\(|new Function\s*\(|document\.write\s*\(",
         ("eval", "new Function", "document.write"),
         vector="Injection/XSS", severity="High",
         fix="Remove eval / new Function / document.write; use a parser or safe DOM APIs."),
    Rule("nosqli-operator", SECURITY, _WEB,
         r"\$(ne|gt|lt|gte|lte|in|nin|where|regex)\b|\{\s*\$[a-z]+\s*:", ("$",),
         vector="Injection/XSS", severity="Medium", review=True,
         fix="Validate/coerce request bodies with a schema before querying; reject objects where "
             "scalars are expected to block operator injection."),
    Rule("lpdos-file", SECURITY, _WEB,
         r"""type\s*=\s*['"]file['"]|new FileReader\(|\.files\[|readAs(DataURL|ArrayBuffer|Text)\(""",
         ('"file', "'file", "new FileReader(", ".files[", "readAs"),
         vector="LPDoS", severity="Low", review=True,
         fix="Enforce a max File.size and count client-side before upload; reject oversized files "
             "before the network request. Also bound array/string lengths on rich inputs."),
    Rule("clipboard", SECURITY, _WEB,
         r"""navigator\.clipboard|clipboardData|\(paste\)|onPaste|addEventListener\(\s*['"]paste['"]""",
         ("clipboard", "paste", "onPaste"),
         vector="Clipboard", severity="Medium", review=True,
         fix="When rendering/executing pasted content, strip zero-width & control chars (e.g. "
             r"/[\u200B-\u200D\uFEFF\u0000-\u001F]/g) and treat it as untrusted text."),
    Rule("replay-mutation", SECURITY, _WEB, r"\.(post|put|patch|delete)\s*\(",
         (".post", ".put", ".patch", ".delete"), vector="Replay", severity="Low", review=True,
         ignore_case=True, path_include=_PAYMENT_PATH, path_include_ignore_case=True,
         fix="For sensitive mutations (payment/reset/checkout), add a client-generated idempotency "
             "key / nonce header and disable the trigger button while in flight."),
    Rule("java-weak-hash", SECURITY, ("java",),
         r"""<password-encoder\s+[^>]*hash=["'](md5|sha|plaintext|none)["']"""
         r"""|<password-encoder\s+[^>]*base64=["']true["']"""
         r"""|\b(NoOpPasswordEncoder|Md5PasswordEncoder|ShaPasswordEncoder)\b"""
         r"""|MessageDigest\.getInstance\s*\(\s*["'](MD5|SHA-1|SHA1)["']\s*\)""",
         ("password-encoder", "passwordencoder", "messagedigest"),
         vector="Secrets", severity="High", review=True, ignore_case=True,
         fix="Migrate to modern salted hashing (e.g. BCryptPasswordEncoder, Argon2PasswordEncoder) "
             "instead of legacy unsalted MD5/SHA."),
    Rule("java-sqli", SECURITY, ("java",),
         r"(createQuery|createNativeQuery|prepareStatement|executeQuery|executeUpdate)\s*\([^)]*\+",
         ("Query", "prepareStatement", "executeUpdate"),
         vector="Injection/XSS", severity="High", review=True,
         fix="Use parameterized queries / bound parameters instead of string concatenation."),
    Rule("java-cmd", SECURITY, ("java",),
         r"Runtime\.getRuntime\(\)\.exec\s*\(|new\s+ProcessBuilder\s*\(",
         ("Runtime.getRuntime().exec", "ProcessBuilder"),
         vector="Injection/XSS", severity="High", review=True,
         fix="Avoid shell/exec with untrusted input; validate and pass an argument array, not a "
             "concatenated string."),
    Rule("java-deser", SECURITY, ("java",), r"new\s+ObjectInputStream\s*\(", ("ObjectInputStream",),
         vector="Injection/XSS", severity="High", review=True,
         fix="Untrusted Java deserialization is dangerous — avoid it, or use an allowlist / a safe "
             "format (JSON)."),
    Rule("java-upload", SECURITY, ("java",), r"\bMultipartFile\b", ("MultipartFile",),
         vector="LPDoS", severity="Low", review=True,
         fix="Enforce a max upload size (e.g. spring.servlet.multipart.max-file-size) and validate "
             "before processing."),
    Rule("dart-innerhtml", SECURITY, ("flutter",), r"\.innerHtml\s*=|setInnerHtml\s*\(",
         (".innerHtml", "setInnerHtml"), vector="Injection/XSS", severity="High", review=True,
         fix="Avoid dart:html innerHtml with untrusted input; sanitize or use safe widgets."),
    Rule("dart-clipboard", SECURITY, ("flutter",), r"Clipboard\.(setData|getData)\s*\(",
         ("Clipboard.",), vector="Clipboard", severity="Low", review=True,
         fix="Treat pasted content as untrusted; strip zero-width/control chars before rendering."),
    Rule("dart-mutation", SECURITY, ("flutter",),
         r"\b(http|dio|client|_client)\.(post|put|patch|delete)\s*\(",
         (".post", ".put", ".patch", ".delete"), vector="Replay", severity="Low", review=True,
         ignore_case=True, path_include=_PAYMENT_PATH, path_include_ignore_case=True,
         fix="Add an idempotency key / nonce to sensitive mutations and disable the trigger while in "
             "flight."),
)

# ---------------------------------------------------------------------------


def select_rules(
    rules: Iterable[Rule],
    *,
    disabled: Sequence[str] = (),
    packs: Sequence[str] | None = None,
) -> list[Rule]:
    """Drop disabled rules and, when ``packs`` is given, rules of other packs.

    A rule kept for some of its packs only is narrowed to those.
    """
    kept = []
    for rule in rules:
        if rule.rule_id in disabled:
            continue
        if packs is not None:
            shared = tuple(p for p in rule.packs if p in packs)
            if not shared:
                continue
            rule = replace(rule, packs=shared)
        kept.append(rule)
    return kept


CATALOGUE_SCHEMA = (
    "position INT, rule_id STRING, family STRING, pack STRING, pack_position INT, vector STRING, "
    "severity STRING, label STRING, pattern STRING, block BOOLEAN, review BOOLEAN, weight INT, "
    "fix STRING, path_include STRING, path_exclude STRING, guards ARRAY<STRING>"
)


def rule_catalogue(
    spark: SparkSession, smells: Sequence[Rule] = SMELL_RULES, security: Sequence[Rule] = SECURITY_RULES,
    *, disabled: Sequence[str] = (),
) -> DataFrame:
    """The catalogue as a table, one row per rule and pack.

    A local relation of a few dozen rows plus whatever the caller adds: it comes
    from the driver, so its size never depends on the scanned data.
    """
    rows = []
    for position, rule in enumerate([*select_rules(smells, disabled=disabled),
                                     *select_rules(security, disabled=disabled)]):
        for pack in rule.packs:
            rows.append((
                position, rule.rule_id, rule.family, pack, PACKS[pack].position if pack in PACKS else 99,
                rule.vector, rule.severity, rule.label or None, rule.pattern, rule.block, rule.review,
                rule.weight, rule.fix, rule.path_include, rule.path_exclude, list(rule.guards),
            ))
    if LARGE_RULE_ID not in disabled:
        rows.extend(
            (len(smells) + len(security), LARGE_RULE_ID, SMELL, pack.pack_id, pack.position, None, None,
             LARGE_LABEL, None, False, False, LARGE_WEIGHT, None, None, None, [])
            for pack in PACKS.values()
        )
    return spark.createDataFrame(rows, CATALOGUE_SCHEMA)
