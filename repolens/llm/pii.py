"""Personal data: checked patterns, and wider candidates judged by boosted trees.

Four checked kinds (email, ip, card, phone) are found by pattern and test. High-recall generators propose
further, overlapping candidates: of a row of numbers every group of neighbours that could be one number. Boosted trees over
their format and context score them, a threshold for each kind, calibrated on rows kept out of training, selects
those to redact, and of overlapping ones the best score stays. Everything stays in the row: no shuffle and no join. The
trees become one SQL expression.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.llm.base import bind, text_of

# The patterns of the contract. Possessive forms find the same spans without deep recursion, and a
# look-behind starts each run of characters once: at its begin or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# What any match contains, to pass over other texts quickly.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
KINDS = tuple(PATTERNS)

# Generators of candidates: wide, so that little is missed.
GENERATORS = {
    "number": r"(?<![0-9A-Za-z+])\(?[0-9](?:[ ().-]{0,2}+[0-9]){6,}+",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
    "contact": r"(?i)(?:(?<![A-Za-z0-9._%-])|\G)[A-Za-z0-9._%-]{1,64}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]++"
               r"(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)++",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}+(?: ?[0-9A-Z]{1,3}(?![0-9A-Za-z]))?+(?![0-9A-Za-z])",
    "birth": r"(?<![0-9A-Za-z])(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{4})(?![0-9A-Za-z])",
}
# A date or an address of four numbers ends a group of numbers; and what a group may hold.
APART = r"^(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{4}|[0-9]{1,3}(?:\.[0-9]{1,3}){3})$"
LEAST_DIGITS, MOST_DIGITS = 7, 19
CANDIDATE_KINDS = tuple(GENERATORS)
CANDIDATE_NEEDS = {"number": r"[0-9][ ().-]{0,2}[0-9]", "secret": r"[0-9]", "contact": r"(?i)at[)\]]",
                   "account": r"[A-Z]{2}[0-9]{2} ?[0-9A-Z]{4}", "birth": r"[0-9][-./][0-9]{1,2}[-./][0-9]"}

#: Characters before and after a candidate that its features look at.
BEFORE, AFTER = 24, 8
#: Made-up candidates that the trees are fitted on; independent of the corpus.
TRAINING_ROWS = 8_000
TREES, DEPTH = 16, 4
#: Share of selected candidates that must be right on the calibration rows.
PRECISION = 0.95


def scan(values: Column, zero: Column, combine: Callable[[Column, Column], Column], block: int = 128) -> Column:
    """For each value the combination of all before it; in blocks, so that long arrays stay affordable."""

    def fold(array: Column) -> Column:
        return F.aggregate(array, zero, combine)

    def over_blocks(blocks: Column) -> Column:
        return bind(F.transform(blocks, fold), lambda totals: F.flatten(F.transform(blocks, lambda x, i: bind(
            fold(F.slice(totals, 1, i)), lambda base: F.transform(
                x, lambda _, j: combine(base, fold(F.slice(x, 1, j))))))))

    def cut(array: Column) -> Column:
        numbers = F.sequence(F.lit(0), ((F.size(array) - 1) / block).cast("int"))
        return F.transform(numbers, lambda b: F.slice(array, b * block + 1, block))

    return bind(values, lambda array: F.when(F.size(array) > 0, bind(cut(array), over_blocks)).otherwise(
        F.slice(array, 1, 0)))


def matches(text: Column, pattern: str, needs: str) -> Column:
    """``array<struct<value, start, end>>`` of the leftmost matches that don't overlap; code points, end exclusive."""
    spans = bind(F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.split(text, pattern, -1).alias("gaps")), lambda m: bind(
            F.zip_with(F.slice(m["gaps"], 1, F.size(m["found"])), m["found"],
                       lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value"))),
            lambda pairs: F.zip_with(pairs, scan(
                F.transform(pairs, lambda p: p["gap"] + F.length(p["value"])), F.lit(0), lambda a, b: a + b),
                lambda p, before: F.struct(
                    p["value"].alias("value"), (before + p["gap"]).alias("start"),
                    (before + p["gap"] + F.length(p["value"])).alias("end")))))
    none = F.from_json(F.lit("[]"), "array<struct<value:string,start:int,end:int>>")
    return F.when(text.rlike(needs), spans).otherwise(none)


def luhn(value: Column) -> Column:
    """Whether the digits pass the Luhn test."""
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    numbers = F.transform(F.split(digits, "(?<=.)(?=.)"), lambda d: d.cast("int"))
    counted = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).otherwise(
        F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(counted, F.lit(0), lambda a, d: a + d) % 10 == 0


def n_digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def passes(kind: str, value: Column) -> Column:
    """The test that a match of a checked kind must pass."""
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(n_digits(value).between(13, 19), luhn(value)).otherwise(F.lit(False))
    if kind == "phone":
        return n_digits(value).between(9, 15)
    return F.lit(True)


def checked_spans(text: Column) -> Column:
    """``array<struct<kind, start, end>>`` of the checked kinds, by kind as listed and start."""
    def checked(kind: str) -> Column:
        right = F.filter(matches(text, PATTERNS[kind], NEEDS[kind]), lambda m: passes(kind, m["value"]))
        return F.transform(right, lambda m: F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    return F.concat(*[checked(kind) for kind in KINDS])


# Cues in the text around a candidate, in lower case.
CONTACT_CUE = r"tel|phone|call|mobil|fax|contact|dial"
SECRET_CUE = r"token|secret|passw|api|key|bearer|credential"
ACCOUNT_CUE = r"card|account|iban|ssn|passport|social|konto|tarjeta|carte"
BIRTH_CUE = r"born|birth|dob|geboren|geb\.|naissance|n[ée]e? le|nacimiento|naci"
OTHER_CUE = r"order|version|page|year|section|isbn|invoice|serial|model|part|volume|chapter|build"


def features(kind: Column, value: Column, before: Column, after: Column) -> dict[str, Column]:
    """Format and context of a candidate as numbers."""
    cue = F.lower(before)

    def number(test: Column) -> Column:
        return test.cast("double")

    def count(pattern: str) -> Column:
        return F.length(F.regexp_replace(value, pattern, "")).cast("double")

    length = F.length(value).cast("double")
    return {
        **{f"is_{k}": number(kind == k) for k in CANDIDATE_KINDS},
        "length": length,
        "digits": count("[^0-9]"),
        "letters": count("[^A-Za-z]"),
        "upper": count("[^A-Z]"),
        "separators": count("[0-9A-Za-z]"),
        "groups": F.size(F.split(value, "[^0-9A-Za-z]+")).cast("double"),
        "digit_share": count("[^0-9]") / length,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / length,
        "hex": number(value.rlike("^[0-9a-fA-F]+$")),
        "luhn": number(F.when(n_digits(value).between(13, 19), luhn(value)).otherwise(F.lit(False))),
        "date": number(value.rlike(r"^(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{4})$")),
        "contact_cue": number(cue.rlike(CONTACT_CUE)),
        "secret_cue": number(cue.rlike(SECRET_CUE)),
        "account_cue": number(cue.rlike(ACCOUNT_CUE)),
        "birth_cue": number(cue.rlike(BIRTH_CUE)),
        "other_cue": number(cue.rlike(OTHER_CUE)),
        # The last words alone: a cue before another number is not this one's.
        "near_contact_cue": number(cue.rlike(rf"(?:{CONTACT_CUE})[^0-9]*$")),
        "near_other_cue": number(cue.rlike(rf"(?:{OTHER_CUE})[^0-9]*$")),
        "phone_shape": number(value.rlike(r"^\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$")),
        "card_shape": number(value.rlike(r"^[0-9]{4}(?:[ -]?[0-9]{4}){3}$")),
        "number_before": number(before.rlike(r"[0-9)][ .-]?$")),
        "number_after": number(after.rlike(r"^[ .-]?[(0-9]")),
        "assigned": number(before.rlike(r"[=:]\s*[\"']?$")),
        "quoted": number(before.rlike(r"[\"']$") & after.rlike(r"^[\"']")),
        "glued": number(after.rlike(r"^[0-9A-Za-z@/]")),
    }


# Shapes of made-up candidates: kind, whether personal, template (# digit, x hex digit, w lower-case word, A letter, U capital)
# and words that stand before it.
SHAPES = (
    ("number", 1, "###-###-####", "call|phone:|tel|mobile|"),
    ("number", 1, "(###) ###-####", "call|phone|fax|"),
    ("number", 1, "### ### ####", "tel.|mobile|contact|"),
    ("number", 1, "###-##-####", "ssn|social security|"),
    ("number", 1, "################", "card|account|konto|"),
    ("number", 1, "#### #### #### ####", "card|tarjeta|carte|"),
    ("number", 1, "####-####-####-####", "card|account|"),
    ("number", 0, "####-##-##", "on|year|since|"),
    ("number", 0, "##.##.####", "am|date|"),
    ("number", 0, "########", "order|part|serial|invoice"),
    ("number", 0, "##########", "isbn|order|build|model"),
    ("number", 0, "####-####", "page|years|from"),
    ("number", 0, "#.##.###.##", "version|section|build"),
    ("number", 0, "#######", "about|some|volume|"),
    ("number", 1, "###-###-####", "order 12345678|on 2024-01-31|call 0123456|invoice 20240131|id 77"),
    ("number", 1, "(###) ###-####", "order 12345678|since 31.01.2024|version 10.0.0.1"),
    ("number", 1, "#### #### #### ####", "order 12345678|on 2024-01-31"),
    ("number", 0, "######## ###-###-####", "order|call|part|"),
    ("number", 0, "######## (###) ###-####", "order|call|"),
    ("number", 0, "######## #### #### ####", "card|order|"),
    ("number", 0, "###-####", "call (555)|phone 555|tel 030"),
    ("number", 0, "#### ####", "card 4111 1111|card 4111|konto 1234 5678"),
    ("number", 0, "#### #### ####", "card 4111|tarjeta 1234"),
    ("number", 0, "#### ###-###-####", "on 31|card 4111|call|order"),
    ("number", 0, "########", "call 555-867-5309|phone (555) 867-5309|order|"),
    ("account", 1, "UU## #### #### #### #### ##", "iban|account|konto|"),
    ("account", 1, "UU####################", "iban|account|transfer to|"),
    ("account", 1, "UU## UUUU #### #### #### ##", "iban|pay|"),
    ("account", 0, "UU## UUUU UUUU", "model|part|the|section"),
    ("account", 0, "UU######UUUU", "part|model|version|build"),
    ("birth", 1, "19##-0#-1#", "born|date of birth:|dob|born on|geboren am"),
    ("birth", 1, "1#.0#.19##", "geboren am|geb.|birth:|née le|nacimiento:"),
    ("birth", 0, "20##-0#-1#", "on|since|version|released|from"),
    ("birth", 0, "1#.0#.19##", "am|seit|page|on|until"),
    ("secret", 1, "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx", "token = \"|api_key: |secret=|"),
    ("secret", 1, "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx", "key = \"|password: |token=|"),
    ("secret", 1, "AAA#A#AAA##A#AA##AAAA#A#", "bearer |key=|credential: \""),
    ("secret", 0, "wwww-wwww-wwwww-####", "see|page|"),
    ("secret", 0, "wwwwwwwwwwwwwwwwwwwwww#", "the|chapter|"),
    ("secret", 0, "wwww_wwwww_wwwwww_##_wwww", "model|part|"),
    ("secret", 0, "----------------------#", "|"),
    ("contact", 1, "wwww.wwwww (at) wwwww.www", "contact|mail|"),
    ("contact", 1, "wwwww [at] wwww [dot] www", "mail|"),
    ("contact", 1, "wwww (AT) wwww (DOT) www", "mail|write to|"),
    ("contact", 0, "w (at) #.##", "sold|"),
)


def training_candidates(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """``(kind, label, value, before, after, fold)`` made up from :data:`SHAPES` by hashes of a row number."""

    def pick(options: Column, salt: str) -> Column:
        return F.element_at(options, (F.pmod(F.xxhash64("id", F.lit(salt)), F.size(options).cast("long")) + 1).cast("int"))

    shapes = F.array(*[F.struct(
        F.lit(k).alias("kind"), F.lit(y).alias("label"), F.lit(t).alias("template"),
        F.split(F.lit(c), r"\|").alias("cues")) for k, y, t, c in SHAPES])
    letters = {"#": "0123456789", "x": "0123456789abcdef", "w": "etaoinshrdlu", "A": "QWERTYUPASDFGHJKLZXCVBNMqwertyupasdfghjk", "U": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

    def drawn(c: Column, i: Column) -> Column:
        out = c
        for mark, pool in letters.items():
            place = (F.pmod(F.xxhash64(F.col("id"), i, F.lit(mark)), F.lit(len(pool))) + 1).cast("int")
            out = F.when(c == mark, F.substr(F.lit(pool), place, F.lit(1))).otherwise(out)
        return out

    chosen = spark.range(0, rows, 1, 1).withColumn("shape", pick(shapes, "shape"))
    value = F.array_join(F.transform(F.split(F.col("shape.template"), "(?<=.)(?=.)"), drawn), "")
    cue = pick(F.col("shape.cues"), "cue")
    space = F.when(cue.rlike(r"[=\" ]$"), "").otherwise(" ")
    return chosen.select(
        F.col("shape.kind").alias("kind"), F.col("shape.label").cast("double").alias("label"), value.alias("value"),
        F.concat(F.lit("the on of "), cue, space).alias("before"),
        F.when(cue.rlike("\"$"), "\" and").otherwise(" and").alias("after"),
        F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(4)).alias("fold"))


@dataclass(frozen=True)
class PiiModel:
    """Trees as nested tuples ``(feature, threshold, left, right)`` or leaf values, with their weights."""

    names: tuple[str, ...]
    trees: tuple
    weights: tuple[float, ...]
    thresholds: dict[str, float]

    def margin(self, values: dict[str, Column]) -> Column:
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, threshold, left, right = node
            return F.when(values[self.names[feature]] <= threshold, walk(left)).otherwise(walk(right))

        return functools.reduce(lambda a, b: a + b, (w * walk(t) for w, t in zip(self.weights, self.trees, strict=True)))

    def above(self, kind: str, value: Column, before: Column, after: Column) -> Column:
        """How far a candidate's score is above its kind's threshold; from 0 on it is redacted."""
        return bind(F.struct(*[c.alias(n) for n, c in features(F.lit(kind), value, before, after).items()]),
                    lambda f: self.margin({n: f[n] for n in self.names}) - F.lit(self.thresholds.get(kind, float("inf"))))


def train(spark: SparkSession, rows: int = TRAINING_ROWS, trees: int = TREES, depth: int = DEPTH) -> PiiModel:
    """Fit the trees on made-up candidates and calibrate a threshold of each kind on a fourth of them."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    made = training_candidates(spark, rows)
    values = features(F.col("kind"), F.col("value"), F.col("before"), F.col("after"))
    names = tuple(values)
    table = VectorAssembler(inputCols=list(names), outputCol="features").transform(
        made.select("kind", "label", "fold", *[c.alias(n) for n, c in values.items()]))
    table = table.cache()
    try:
        fitted = GBTClassifier(maxIter=trees, maxDepth=depth, seed=1, maxBins=32).fit(table.filter("fold > 0"))

        def walk(node):
            if node.subtreeDepth() == 0:
                return float(node.prediction())
            split = node.split()
            return split.featureIndex(), float(split.threshold()), walk(node.leftChild()), walk(node.rightChild())

        model = PiiModel(names, tuple(walk(t._call_java("rootNode")) for t in fitted.trees), tuple(fitted.treeWeights), {})
        margin = model.margin({n: F.col(n) for n in names})
        scored = table.filter("fold = 0").select("kind", "label", margin.alias("margin")).collect()
    finally:
        table.unpersist()
    thresholds = {}
    for kind in CANDIDATE_KINDS:
        ranked = sorted(((r["margin"], r["label"]) for r in scored if r["kind"] == kind), reverse=True)
        right, least = 0.0, float("inf")
        for n, (score, label) in enumerate(ranked, 1):
            right += label
            last_of_ties = n == len(ranked) or ranked[n][0] < score
            if last_of_ties and right / n >= PRECISION:
                least = score
        thresholds[kind] = least
    return PiiModel(names, model.trees, model.weights, thresholds)


def groups(match: Column) -> Column:
    """``array<struct<first, start, end, value>>``: each group of neighbouring numbers of a match that could be one number.

    Numbers stand between spaces. A group has :data:`LEAST_DIGITS` to :data:`MOST_DIGITS` digits, so there are at most so many of each
    first number; dates and addresses are in no group.
    """
    numbers = F.split(match["value"], " ")

    def of_numbers(parts: Column) -> Column:
        starts = scan(F.transform(parts, lambda p: F.length(p) + 1), F.lit(0), lambda a, b: a + b)

        def from_first(given: Column) -> Column:
            def group(i: Column, k: Column) -> Column:
                some = F.slice(given["parts"], i + 1, k)
                return bind(F.array_join(some, " "), lambda value: F.struct(
                    i.alias("first"), (match["start"] + F.get(given["starts"], i)).alias("start"),
                    (match["start"] + F.get(given["starts"], i) + F.length(value)).alias("end"), value.alias("value"),
                    F.exists(some, lambda p: p.rlike(APART) | (p == "")).alias("apart")))

            def all_from(i: Column) -> Column:
                most = F.least(F.lit(MOST_DIGITS), F.size(given["parts"]) - i)
                return F.filter(F.transform(F.sequence(F.lit(1), most), lambda k: group(i, k)), lambda g: ~g["apart"] & n_digits(
                    g["value"]).between(LEAST_DIGITS, MOST_DIGITS))

            return F.flatten(F.transform(F.sequence(F.lit(0), F.size(given["parts"]) - 1), all_from))

        return bind(F.struct(parts.alias("parts"), starts.alias("starts")), from_first)

    return bind(numbers, of_numbers)


def best_of_overlapping(scored: Column) -> Column:
    """The ``(start, end, above)`` candidates of one match that no better one overlaps; of equal ones the longer, then the earlier."""
    def better(a: Column, b: Column) -> Column:
        mine, other = F.struct(a["above"], a["end"] - a["start"], -a["start"]), F.struct(b["above"], b["end"] - b["start"], -b["start"])
        return (b["start"] < a["end"]) & (a["start"] < b["end"]) & (other > mine)

    # Candidates come by their first number, and each has at most so many: others that overlap one are not far from it.
    near = MOST_DIGITS * MOST_DIGITS
    return bind(scored, lambda all_: F.filter(all_, lambda a, i: ~F.exists(
        F.slice(all_, F.greatest(i + 1 - near, F.lit(1)), F.lit(2 * near + 1)), lambda b: better(a, b))))


def proposed_spans(text: Column, model: PiiModel) -> Column:
    """``array<struct<kind, start, end>>`` of the candidates that the model selects, those of one kind without overlaps."""

    def scored(kind: str, m: Column) -> Column:
        first = F.greatest(m["start"] - BEFORE, F.lit(0))
        above = model.above(
            kind, m["value"], F.substr(text, first + 1, m["start"] - first), F.substr(text, m["end"] + 1, F.lit(AFTER)))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), above.alias("above"))

    def judged(kind: str) -> Column:
        found = matches(text, GENERATORS[kind], CANDIDATE_NEEDS[kind])
        if kind == "number":
            chosen = F.flatten(F.transform(found, lambda m: best_of_overlapping(F.filter(
                F.transform(groups(m), lambda g: scored(kind, g)), lambda c: c["above"] >= 0))))
        else:
            chosen = F.filter(F.transform(found, lambda m: scored(kind, m)), lambda c: c["above"] >= 0)
        return F.transform(chosen, lambda c: F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))

    return F.concat(*[judged(kind) for kind in CANDIDATE_KINDS])


def with_pii(docs: DataFrame, model: PiiModel) -> DataFrame:
    """The rows with ``base_spans`` and ``pii_spans``: ``array<struct<kind, start, end>>`` in code points.

    ``base_spans`` has the checked kinds; ``pii_spans`` has those and the selected candidates, by kind as listed
    and start. Spans of different kinds may overlap. Columns of these names are replaced; null text is empty and
    has no spans; repeated rows and null ids stay. Narrow: a hot document is one row of one task.
    """
    kept = docs.drop("base_spans", "pii_spans")
    found = kept.withColumn("base_spans", checked_spans(text_of()))
    return found.withColumn("pii_spans", F.concat("base_spans", proposed_spans(text_of(), model)))


def redacted(docs: DataFrame, spans: str = "pii_spans") -> DataFrame:
    """The rows with each span of ``text`` replaced by its kind in brackets, without the span columns.

    Overlapping spans become one, named by the first (of those that begin together, the longest). Null text stays
    null.
    """
    ordered = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind")))), lambda s: F.struct(
            s["start"].alias("start"), (-s["back"]).alias("end"), s["kind"].alias("kind")))
    text = F.col("text")

    def replaced(sorted_spans: Column) -> Column:
        done = scan(F.transform(sorted_spans, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
        parts = F.zip_with(sorted_spans, done, lambda s, at: F.when(s["start"] >= at, F.concat(
            F.substr(text, at + 1, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit("")))
        last = F.array_max(F.transform(sorted_spans, lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), F.substr(text, last + 1, F.length(text)))

    new = F.when(F.size(spans) > 0, bind(ordered, replaced)).otherwise(text)
    return docs.withColumn("text", new).drop("base_spans", "pii_spans")


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
