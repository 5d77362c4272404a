"""Main text of web pages by wrappers inferred for each host.

Each page becomes a stream of block tags and text slots, in which repeated groups are folded. The distinct
streams of a host are aligned one after another: what matches stays, a mismatch becomes an optional group, or a
repeated one where it repeats what stands before it. The result is a union-free regular expression, the host's
wrapper. Each page is matched against the wrapper of its host, which numbers its texts by their place in it: two
slots below equal elements stay two. A place inside the article holds the article; on hosts without such an element
all other places do, but for texts that are constant at their place.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.base import stored

# Elements of HTML by kind.
RAW = "script style noscript template textarea title iframe object svg math canvas select button".split()
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
    .split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSED_BY = {  # an open element that the next one of these ends
    "p": BLOCKS - {"br"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"}, "tr": {"tr"}, "head": {"body"},
}
DROPPED = frozenset("aside dialog footer form head menu nav".split())
DROPPED_ROLES = frozenset("alert banner complementary contentinfo dialog form menu navigation search".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement alert banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager "
    "pagination popup promo related recommended replies reply search share sharing sidebar signup social sponsor "
    "sponsored subscribe subscription toolbar widget".split())
ARTICLE = ("article", "main")

#: Elements are left out by their names only while these leave out no larger share of a page's text.
MOST = 0.8
#: A text that at least so many distinct pages of a host have at a place, and this share of those with the place, is the host's.
CONSTANT_PAGES, CONSTANT_SHARE = 10, 0.5
#: Distinct streams of a host are aligned in groups of about so many by hash, then these groups' wrappers, until one is left.
GROUP = 32
#: Streams of up to so many characters, and how many of them, whose folded form and places a worker keeps.
KEPT_CHARS, KEPT = 4_000, 4_096

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>?"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>?"
    r"|(?P<text>[^<]+|<)", re.IGNORECASE | re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME_PART = re.compile(r"[a-z]+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.IGNORECASE)

PAGE = "page_id LONG, url STRING, host STRING, stream STRING, texts ARRAY<STRING>"
SLOT, IN_ARTICLE, LEFT_OUT = "#", "#a", "#!"  # a text: plain, in an article or main element, in a left-out element
MARK = "!"  # before an element whose texts are not the article's
NAMED = "~"  # the same by its class or id only, while a page is read


def _described(tag: str, attributes: str, in_article: bool) -> str:
    """An element as a step of a path: its tag, its class and id names, marked where it is left out."""
    names: set[str] = set()
    dropped = tag in DROPPED or tag == "header" and not in_article
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            names.update(_NAME_PART.findall(value))
        elif key == "role":
            dropped |= value in DROPPED_ROLES
        elif key == "style":
            dropped |= "display:none" in value.replace(" ", "")
        else:
            dropped |= key == "hidden" or value == "true"
    found = names & DROPPED_NAMES if tag not in ("html", "body") else set()
    if found == {"header"} and names & {"article", "entry", "post", "title"}:
        found = set()
    return (MARK if dropped else NAMED if found else "") + ".".join([tag, *sorted(names)])


def _settled(stream: list[str], blocks: list[tuple[str, str]]) -> tuple[list[str], list[tuple[str, str]]]:
    """The page with its elements marked by name either left out or not.

    While they leave out more than :data:`MOST` of the text outside other left-out elements, the name that leaves out
    most isn't a mark on this page: it stands at a wrapper or at the text itself.
    """
    total = lost = 0
    holders: dict[str, list[int]] = {}  # the blocks in each element marked by name
    sizes, marks = [len(text) for _, text in blocks], [0] * len(blocks)
    for k, (path_, _) in enumerate(blocks):
        steps = set(path_.split("/"))
        if any(s.startswith(MARK) for s in steps):
            continue
        named = [s for s in steps if s.startswith(NAMED)]
        total += sizes[k]
        lost += sizes[k] if named else 0
        marks[k] = len(named)
        for s in named:
            holders.setdefault(s, []).append(k)
    held = {s: sum(sizes[k] for k in found) for s, found in holders.items()}
    freed: set[str] = set()
    for s in sorted(held, key=lambda s: (-held[s], s)):
        if lost <= MOST * total:
            break
        freed.add(s)
        for k in holders[s]:
            marks[k] -= 1
            lost -= 0 if marks[k] else sizes[k]

    def step(s: str) -> str:
        return s if not s.startswith(NAMED) else s[1:] if s in freed else MARK + s[1:]

    def path(p: str) -> str:
        return "/".join(map(step, p.split("/"))) if NAMED in p else p

    return list(map(step, stream)), [(path(p), text) for p, text in blocks]


def parsed(page: str | None) -> tuple[list[str], list[tuple[str, str]]]:
    """``(stream, blocks)`` of a page: tags and slots, and the text of each block with its path.

    A slot says no more than its role (:data:`SLOT` and the like): what tells slots apart is their place among the tags.
    """
    stream: list[str] = []
    blocks: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    words: list[str] = []

    def end_block() -> None:
        text = " ".join(entities.unescape("".join(words)).split())
        words.clear()
        if text:
            path = "/".join(step for _, step in stack)
            stream.append(SLOT)
            blocks.append((path, text))

    def pop(k: int) -> None:
        while len(stack) > k:
            tag, _ = stack.pop()
            if tag in BLOCKS and tag not in ("p", "li"):  # these need no end tag
                stream.append("/" + tag)

    for m in _TOKEN.finditer(page or ""):
        if m["text"]:
            words.append(m["text"])
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        block = tag in BLOCKS
        if m["close"]:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if block:
                end_block()
            if at is not None:
                if not block and any(t in BLOCKS for t, _ in stack[at:]):
                    continue  # an inline end tag doesn't end blocks
                if not block:
                    end_block()
                pop(at)
            continue
        step = _described(tag, m["attributes"], any(t in ARTICLE for t, _ in stack)) if block or m["attributes"] else tag
        inside = stack and stack[-1][0] not in BLOCKS
        if not block and not (step.startswith((MARK, NAMED)) or inside and stack[-1][0] == tag) or tag in VOID and tag != "br":
            if tag in ("hr", "img", "input"):
                words.append(" ") if tag != "hr" else end_block()
            continue
        end_block()
        if tag == "br":
            continue
        while block and stack and tag in CLOSED_BY.get(stack[-1][0], ()):
            pop(len(stack) - 1)
        stack.append((tag, step))
        if block:
            stream.append(step)
    end_block()
    if any(NAMED in path for path, _ in blocks) or any(s.startswith(NAMED) for s in stream):
        stream, blocks = _settled(stream, blocks)
    roles = iter([_role(path) for path, _ in blocks])
    return [next(roles) if s == SLOT else s for s in stream], blocks


def _role(path: str) -> str:
    steps = path.split("/")
    if any(s.startswith(MARK) for s in steps):
        return LEFT_OUT
    return IN_ARTICLE if any(s.split(".")[0] in ARTICLE for s in steps) else SLOT


# A wrapper is a list of tokens (strings), ["+", nodes] for a repeated group and ["?", nodes] for an optional one.


def _codes(nodes: list) -> np.ndarray:
    """A number for each node, equal for equal nodes."""
    seen: dict[str, int] = {}
    return np.array([seen.setdefault(json.dumps(n), len(seen)) for n in nodes], np.int64)


def _repeats_at(codes: np.ndarray, size: int) -> bool:
    """Whether some group of ``size`` nodes stands beside its copy."""
    same = np.flatnonzero(codes[size:] != codes[:-size])
    return bool(np.diff(same, prepend=-1, append=len(codes) - size).max() > size)


def folded(nodes: list) -> list:
    """Adjacent equal groups as one repeated group, shortest groups first, until nothing changes."""
    changed = True
    while changed:
        changed = False
        codes, size = _codes(nodes), 1
        while 2 * size <= len(nodes):
            if _repeats_at(codes, size):
                nodes, changed = _folded_by(nodes, size), True
                codes = _codes(nodes)
            size += 1
        beside = _absorbed(nodes)
        changed |= len(beside) < len(nodes)
        nodes = beside
    return nodes


def _folded_by(nodes: list, size: int) -> list:
    out: list = []
    i = 0
    while i < len(nodes):
        group = nodes[i : i + size]
        j = i + size
        while len(group) == size and nodes[j : j + size] == group:
            j += size
        out.append(_repeated(group) if j > i + size else nodes[i])
        i = j if j > i + size else i + 1
    return out


def _repeated(group: list) -> list:
    """One or more of the group."""
    if len(group) == 1 and isinstance(group[0], list):
        sign, inner = group[0]
        return group[0] if sign == "+" else ["?", [_repeated(inner)]]
    return ["+", group]


def _absorbed(nodes: list) -> list:
    """Without the plain groups that stand beside their own repetition."""
    out: list = []
    i = 0
    while i < len(nodes):
        node = nodes[i]
        i += 1
        if isinstance(node, list) and node[0] == "+":
            inner = node[1]
            while out[-len(inner) :] == inner:
                del out[-len(inner) :]
            while nodes[i : i + len(inner)] == inner:
                i += len(inner)
        out.append(node)
    return out


def _all_nodes(nodes: list) -> Iterator[list]:
    for node in nodes:
        if isinstance(node, list):
            yield node
            yield from _all_nodes(node[1])


def _core(node) -> list:
    return _core(node[1][0]) if isinstance(node, list) and len(node[1]) == 1 else (node[1] if isinstance(node, list) else [node])


def _signs(node) -> set[str]:
    """The signs around a node's core."""
    if not isinstance(node, list):
        return set()
    return {node[0]} | (_signs(node[1][0]) if len(node[1]) == 1 else set())


def _unified(a, b):
    """One node for two of the same core."""
    signs = _signs(a) | _signs(b)
    node = ["+", _core(a)] if "+" in signs else None
    if "?" in signs:
        return ["?", [node] if node else _core(a)]
    return node or a


def _optional(nodes: list) -> list:
    if not nodes:
        return []
    if len(nodes) == 1 and isinstance(nodes[0], list) and nodes[0][0] == "?":
        return nodes
    return [["?", nodes]]


def _repeats(nodes: list, groups: list[list]) -> list:
    """The nodes with each plain occurrence of a group as the repeated group."""
    for group in groups:
        out: list = []
        i = 0
        while i < len(nodes):
            here = nodes[i : i + len(group)] == group
            out.append(["+", group] if here else nodes[i])
            i += len(group) if here else 1
        nodes = out
    return nodes


def aligned(a: list, b: list) -> list:
    """The union-free expression that takes both in."""
    groups = {json.dumps(n[1]): n[1] for n in _all_nodes(a + b) if n[0] == "+"}
    longest_first = sorted(groups.values(), key=lambda g: (-len(g), json.dumps(g)))
    a, b = _repeats(a, longest_first), _repeats(b, longest_first)
    keys_a, keys_b = [json.dumps(_core(n)) for n in a], [json.dumps(_core(n)) for n in b]
    out: list = []
    i = j = 0
    for p, q in [*_common(keys_a, keys_b), (len(a), len(b))]:
        out += _optional(a[i:p]) + _optional(b[j:q])
        if p < len(a):
            out.append(_unified(a[p], b[q]))
        i, j = p + 1, q + 1
    return folded(out)


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The places of a longest common subsequence; equal ends are matched first.

    A row of the table of lengths is one integer, whose bit ``j`` is 0 where the length grows at ``b[j]``: long streams
    take a machine word for 64 cells. Every ``sqrt(n)``-th row is kept, the ones between are computed again on the way back.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    where: dict[str, int] = {}
    for j, key in enumerate(y):
        where[key] = where.get(key, 0) | 1 << j
    whole = (1 << len(y)) - 1

    def next_row(row: int, key: str) -> int:
        hit = row & where.get(key, 0)
        return (row + hit | row - hit) & whole

    step = isqrt(len(x)) + 1
    kept, row = [whole], whole
    for i, key in enumerate(x, 1):
        row = next_row(row, key)
        if i % step == 0:
            kept.append(row)
    found: list[tuple[int, int]] = []
    i, j, block, rows = len(x), len(y), -1, [whole]
    while i and j:
        if (i - 1) // step != block:
            block = (i - 1) // step
            rows = [kept[block]]
            for key in x[block * step : (block + 1) * step]:
                rows.append(next_row(rows[-1], key))
        here = i - block * step
        if rows[here] >> j - 1 & 1:
            j -= 1
        else:
            i -= 1
            if rows[here - 1] >> j - 1 & 1:
                j -= 1
                found.append((head + i, head + j))
    ends = [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    return [(k, k) for k in range(head)] + found[::-1] + ends


def wrapper_of(streams: list[list]) -> list:
    """The streams aligned one after another, shortest first."""
    ordered = sorted(streams, key=lambda s: (len(s), json.dumps(s)))
    wrapper = ordered[0] if ordered else []
    for stream in ordered[1:]:
        wrapper = aligned(wrapper, stream)
    return wrapper


def program(wrapper: list) -> list[tuple]:
    """The wrapper as steps: ``(token, place)``, place -1 for tags, or ``(None, first, second)`` for the steps to try next."""
    steps: list[tuple] = []
    places = 0

    def add(nodes: list) -> None:
        nonlocal places
        for node in nodes:
            at = len(steps)
            if isinstance(node, str):
                is_slot = node in (SLOT, IN_ARTICLE, LEFT_OUT)
                steps.append((node, places if is_slot else -1))
                places += is_slot
            elif node[0] == "?":
                steps.append(())
                add(node[1])
                steps[at] = (None, at + 1, len(steps))
            else:
                add(node[1])
                steps.append((None, at, len(steps) + 1))

    add(wrapper)
    return steps


def slots(wrapper: list) -> list[str]:
    """The role of each text slot of a wrapper, by place."""
    return [step[0] for step in program(wrapper) if step[0] is not None and step[1] >= 0]


def places(steps: list[tuple], stream: list[str]) -> list[int] | None:
    """The place in the wrapper of each text of a stream, or None where the wrapper doesn't take the stream in.

    All ways through the wrapper go on side by side, at most one at each step, so the time is at most the product of the
    lengths. Of several ways the one stays that takes optional and repeated groups as early and as often as it can.
    """

    def spread(at: int, trail, found: list, seen: set) -> None:
        todo = [at]
        while todo:
            k = todo.pop()
            if k in seen:
                continue
            seen.add(k)
            if k < len(steps) and steps[k][0] is None:
                todo += [steps[k][2], steps[k][1]]
            else:
                found.append((k, trail))

    ways: list = []
    spread(0, None, ways, set())
    for token in stream:
        after: list = []
        seen: set[int] = set()
        for k, trail in ways:
            if k < len(steps) and steps[k][0] == token:
                spread(k + 1, trail if steps[k][1] < 0 else (trail, steps[k][1]), after, seen)
        ways = after
    trail = next(((t,) for k, t in ways if k == len(steps)), None)
    if trail is None:
        return None
    trail, out = trail[0], []
    while trail is not None:
        trail, place = trail
        out.append(place)
    return out[::-1]


@lru_cache(64)
def _program_json(wrapper: str) -> tuple[list[tuple], list[str]]:
    nodes = json.loads(wrapper)
    return program(nodes), slots(nodes)


def _fold_json(stream: str) -> str:
    return json.dumps(folded(json.loads(stream)))


def _match_json(wrapper: str, stream: str) -> tuple[list[int], list[str]]:
    steps, roles = _program_json(wrapper)
    tokens = json.loads(stream)
    found = places(steps, tokens)
    if found is None:
        own = [t for t in tokens if t in (SLOT, IN_ARTICLE, LEFT_OUT)]
        return [-1] * len(own), own
    return found, [roles[k] for k in found]


# Most pages of a host share a stream: the results of short ones are kept.
_fold_kept, _match_kept = lru_cache(KEPT)(_fold_json), lru_cache(KEPT)(_match_json)


def _folded_json(stream: str) -> str:
    return (_fold_kept if len(stream) <= KEPT_CHARS else _fold_json)(stream)


def _places_json(wrapper: str, stream: str) -> tuple[list[int], list[str]]:
    """Place and role of each text of a page; place -1 for a page that its wrapper doesn't take in."""
    return (_match_kept if len(wrapper) + len(stream) <= KEPT_CHARS else _match_json)(wrapper, stream)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _parse_pages(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = [m[1].lower() if (m := _HOST.match(u or "")) else "" for u in batch.column(1).to_pylist()]
            streams, texts = [], []
            for page in batch.column(2).to_pylist():
                stream, found = parsed(page)
                streams.append(json.dumps(stream))
                texts.append([t for _, t in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hosts, pa.string()), pa.array(streams, pa.string()),
                 pa.array(texts, pa.list_(pa.string()))], ["page_id", "url", "host", "stream", "texts"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return stored(rows.mapInArrow(run, PAGE), "pages")


def infer_wrappers(streams: DataFrame, group: int = GROUP) -> DataFrame:
    """``(host, wrapper)`` from ``(host, stream)`` rows of streams as JSON.

    Streams are folded where they are read and equal ones merged before the shuffle, so a host with a third of all pages
    brings only its distinct ones. These are aligned in groups of about ``group``, the wrappers again, until each host has
    one: no task has more than a group, however many streams a host has.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(_folded_json, batch.column(1).to_pylist()), pa.string())], ["host", "stream"])

    def align(rows: pa.Table) -> pa.Table:
        wrapper = wrapper_of([json.loads(s) for s in rows["stream"].to_pylist()])
        return pa.table({"host": rows["host"][:1], "stream": pa.array([json.dumps(wrapper)], pa.string())})

    schema = "host STRING, stream STRING"
    left = stored(streams.select("host", "stream").mapInArrow(fold, schema).distinct(), "streams")
    while True:
        sizes = left.groupBy("host").count()
        most = sizes.agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return left.withColumnRenamed("stream", "wrapper")
        dealt = left.join(sizes, "host").withColumn(
            "part", F.pmod(F.xxhash64("stream"), F.ceil(F.col("count") / group)))
        left = stored(dealt.select("host", "part", "stream").groupBy("host", "part").applyInArrow(align, schema), "streams")


def constant_texts(parsed_pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """``(host, constant)``: place and hash of each text that is constant at its place, for hosts without an article element.

    Pages are counted where they have the place, exact copies of a page once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, page, wrapper, stream, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, roles = _places_json(wrapper, stream)
                rows += {(host, page, k, _hash(t)) for k, role, t in zip(at, roles, texts, strict=True) if k >= 0 and role == SLOT}
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "page", "place", "text"])

    plain = wrappers.filter(~F.contains("wrapper", F.lit(json.dumps(IN_ARTICLE))))
    pages = parsed_pages.join(plain, "host").select("host", F.xxhash64("texts").alias("page"), "wrapper", "stream", "texts")
    found = pages.mapInArrow(run, "host STRING, page LONG, place INT, text LONG").distinct()
    holders = found.select("host", "place", "page").distinct().groupBy("host", "place").agg(F.count("*").alias("n"))
    often = found.groupBy("host", "place", "text").count().filter(F.col("count") >= CONSTANT_PAGES)
    constant = often.join(holders, ["host", "place"]).filter(F.col("count") >= CONSTANT_SHARE * F.col("n"))
    return constant.groupBy("host").agg(F.collect_list(F.struct("place", "text")).alias("constant"))


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` of each row of ``(page_id, url, html)``.

    Blocks in page order, character references decoded, white space as single spaces, joined by a space; empty
    where a page has no article. A page without any text at the host's article places gives all its blocks outside
    left-out elements. Null html is empty; rows with a null or odd url share one wrapper; repeated rows stay; other
    columns are not read.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for stream, texts, wrapper, constant in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                at, roles = _places_json(wrapper, stream)
                host_role = IN_ARTICLE if IN_ARTICLE in _program_json(wrapper)[1] else SLOT
                left_out = {(c["place"], c["text"]) for c in constant or ()}
                rows = list(zip(at, roles, texts, strict=True))
                chosen = [t for k, role, t in rows if role == host_role and not (left_out and (k, _hash(t)) in left_out)]
                out.append(" ".join(chosen or [t for _, role, t in rows if role != LEFT_OUT]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    rows = _parse_pages(pages)
    # Stored, so that its size is known: while it is small Spark broadcasts it and no text moves. Beyond that Spark
    # splits a hot host's rows by size, as this side has one row a host.
    wrappers = infer_wrappers(rows)
    judged = stored(wrappers.join(constant_texts(rows, wrappers), "host", "left"), "wrappers")
    joined = rows.join(judged, "host").select("page_id", "url", "stream", "texts", "wrapper", "constant")
    return joined.mapInArrow(choose, "page_id LONG, url STRING, text STRING")
