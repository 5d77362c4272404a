import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from repolens.llm.html import aligned, folded, infer_wrappers, main_text, parsed, places, program, slots, wrapper_of


def page(body, title="T"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>var t='</p>';</script></head><body>{body}</body></html>"


def text_of(html):
    return [t for p, t in parsed(html)[1] if "!" not in p]


@pytest.mark.parametrize("html, texts", [
    (None, []), ("", []), ("<", ["<"]), ("plain &amp; text", ["plain & text"]),
    ("<p>one<p>two<b>bold</b>er<br>three", ["one", "twobolder", "three"]),
    ("<P CLASS=x>A</P><!-- <p>no</p> --><style>p{}</style>B", ["A", "B"]),
    ("<ul><li>a<li>b</ul>", ["a", "b"]), ("a&nbsp;b \n c&#233;&lt;p&gt;", ["a b cé<p>"]),
    ("<div class='side sidebar'>x<div>y</div></div>z", ["z"]), ("<p>a <span class=ad>b <span>c</span> d</span> e</p>", ["a", "e"]),
    ("<div hidden>x</div><div style='display: none'>y</div><div role=navigation>m</div>k", ["k"]),
    ("<article><header><h1>t</h1></header>x<footer>f</footer></article><header>h</header>", ["t", "x"]),
    ("<p title='a > b'>q</p><script>never closed <p>x", ["q"]), ("<!-- never closed <p>x", []),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"])])
def test_blocks(html, texts):
    assert text_of(html) == texts


def test_long_pages_are_linear():
    for odd in ("<p a=\"", "<div>" , "<!", "</p>", "&amp;", "<b "):
        parsed(odd * 5_000)
    assert len(parsed("<p>x" * 20_000)[1]) == 20_000


def test_folding():
    assert folded(["p", "#", "p", "#", "p", "#"]) == [["+", ["p", "#"]]]
    assert folded(["a", "b", "a", "b", "c"]) == [["+", ["a", "b"]], "c"]
    assert folded(["#"]) == ["#"] and folded([]) == []


def test_alignment():
    assert aligned(["a", "x", "b"], ["a", "b"]) == ["a", ["?", ["x"]], "b"]
    assert aligned(["a", ["+", ["p", "#"]], "b"], ["a", "p", "#", "b"]) == ["a", ["+", ["p", "#"]], "b"]
    assert aligned(["a"], []) == [["?", ["a"]]]
    streams = [folded(["body", "div", "#", "/div"] + ["p", "#"] * n + end) for n in (1, 2, 9) for end in ([], ["/body"])]
    assert wrapper_of(streams) == ["body", "div", "#", "/div", ["+", ["p", "#"]], ["?", ["/body"]]]
    assert slots(wrapper_of(streams)) == ["#", "#"]
    assert places(program(wrapper_of(streams)), ["body", "div", "#", "/div", "p", "#", "p", "#"]) == [0, 1, 1]


def as_regex(nodes):
    """The expression for Python's engine, a character a token."""
    return "".join(re.escape(n) if isinstance(n, str) else f"(?:{as_regex(n[1])}){n[0]}" for n in nodes)


STREAMS = st.lists(st.lists(st.sampled_from("ab#"), max_size=9), min_size=1, max_size=5)


@settings(max_examples=400, deadline=None)
@given(STREAMS)
def test_a_wrapper_takes_in_every_stream(streams):
    wrapper = wrapper_of([folded(s) for s in streams])
    steps = program(wrapper)
    for s in streams:
        assert re.fullmatch(as_regex(wrapper), "".join(s))
        found = places(steps, s)
        assert len(found) == s.count("#") and set(found) <= set(range(len(slots(wrapper))))


@settings(max_examples=200, deadline=None)
@given(STREAMS, st.lists(st.sampled_from("ab#"), max_size=9))
def test_matching_equals_a_regular_expression(streams, other):
    wrapper = wrapper_of([folded(s) for s in streams])
    assert (places(program(wrapper), other) is not None) == bool(re.fullmatch(as_regex(wrapper), "".join(other)))


def test_long_streams_are_aligned_whole():
    a = [f"t{k}" for k in range(3_000)]
    b = [t for k, t in enumerate(a) if k % 7] + ["end"]
    wrapper = aligned(a, b)
    assert [n for n in wrapper if isinstance(n, str)] == [t for k, t in enumerate(a) if k % 7]
    long_group = [f"g{k}" for k in range(40)]
    assert folded(["x", *long_group * 3, "y"]) == ["x", ["+", long_group], "y"]


def test_articles_of_a_site(spark):
    rows = []
    for k in range(40):
        extra = f"<div class=related>more {k}</div>" if k % 3 == 0 else ""
        rows.append((k, f"https://a.example/{k}", page(
            f"<nav>n{k}</nav><article><h1>t{k}</h1>" + "".join(f"<p>p{k}.{j}" for j in range(k % 4)) + f"{extra}</article>"
            f"<div class=comments>c{k}</div><footer>f</footer>")))
        rows.append((100 + k, f"http://B.example:80/{k}", page(
            f"<div>Welcome to our site</div><div><p>body {k} of it</p></div><form>q</form>")))
    rows += [(7, "https://a.example/7", None), (None, None, page("<p>odd")), (200, "x", page("<p>odd"))]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id LONG, url STRING, html STRING, text STRING").repartition(4)
    found = {(r["page_id"], r["url"]): r["text"] for r in main_text(pages).collect() if r["text"]}
    for k in range(40):
        want = " ".join([f"t{k}", *[f"p{k}.{j}" for j in range(k % 4)]])
        assert found[k, f"https://a.example/{k}"] == want
        assert found[100 + k, f"http://B.example:80/{k}"] == f"body {k} of it"
    assert found[None, None] == found[200, "x"] == "odd"
    assert main_text(pages).count() == len(rows)


def test_wrappers_of_hosts(spark):
    rows = [("h", json.dumps(folded(["body", *["p", "#"] * k]))) for k in (1, 2, 2, 5)] + [("g", json.dumps(["#"]))]
    found = {r["host"]: json.loads(r["wrapper"]) for r in infer_wrappers(
        spark.createDataFrame(rows, "host STRING, stream STRING")).collect()}
    assert found == {"h": ["body", ["+", ["p", "#"]]], "g": ["#"]}


def test_many_streams_of_a_host_are_aligned_in_rounds(spark):
    streams = [["body", *(["div", "#"] if k & 1 else []), f"s{k}", *["p", "#"] * (k % 5), "/body"] for k in range(60)]
    rows = [("h", json.dumps(s)) for s in streams]
    (found,) = infer_wrappers(spark.createDataFrame(rows, "host STRING, stream STRING"), group=4).collect()
    steps = program(json.loads(found["wrapper"]))
    assert all(len(places(steps, s)) == s.count("#") for s in streams)


def test_empty_table(spark):
    assert main_text(spark.createDataFrame([], "page_id LONG, url STRING, html STRING")).count() == 0


@pytest.mark.parametrize("holder", ["div", "article", "section"])
def test_containers_whose_classes_differ(spark, holder):
    rows = [(k, f"https://c.example/{k}", page(
        f"<h1>t{k}</h1><{holder} class='cat {kind}'><p>first {k}<p>second {k}</{holder}><footer>f</footer>"))
        for k, kind in enumerate(["news", "sport", "news", "arts"] * 4)]
    streams = [parsed(html)[0] for _, _, html in rows]
    steps = program(wrapper_of(streams))
    assert all(len(places(steps, s)) == len(parsed(html)[1]) for s, (_, _, html) in zip(streams, rows, strict=True))
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")
    for r in main_text(pages).collect():
        k = r["page_id"]
        assert r["text"] == ("" if holder == "article" else f"t{k} ") + f"first {k} second {k}"


@pytest.mark.parametrize("html, texts", [
    ("<body class='has-sidebar'><p>body text<div class=sidebar>s</div></body>", ["body text"]),
    ("<body><div id='page' class='nav-open'><p>body text of the page<div class=sidebar>s</div></div></body>",
     ["body text of the page"]),
    ("<body><div class='elementor-widget-text'>one part</div><div class='elementor-widget-text'>two part</div></body>",
     ["one part", "two part"]),
    ("<div class=nav-open><div class=sidebar-left>all of it</div></div>", ["all of it"]),
    ("<nav class=menu>a long list of links that is no article</nav><p>text", ["text"])])
def test_names_do_not_empty_a_page(html, texts):
    assert text_of(html) == texts


def test_copies_of_a_page_are_not_constant_text(spark):
    rows = [(k, "https://d.example/copy", page("<h1>Copied headline</h1><div><p>same words</p></div>")) for k in range(20)]
    rows += [(100 + k, f"https://d.example/{k}", page(f"<h1>own {k}</h1><div><p>words {k}</p></div>")) for k in range(15)]
    found = {r["page_id"]: r["text"] for r in main_text(
        spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")).collect()}
    assert all(found[k] == "Copied headline same words" for k in range(20))
    assert all(found[100 + k] == f"own {k} words {k}" for k in range(15))


def texts_of(spark, bodies):
    rows = [(k, f"https://e.example/{k}", page(b)) for k, b in enumerate(bodies)]
    found = main_text(spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")).collect()
    return [r["text"] for r in sorted(found, key=lambda r: r["page_id"])]


def test_slots_of_one_path_are_told_apart_by_their_place(spark):
    # A teaser and the body have one path, and some bodies quote the teaser: only its place tells it from them.
    def body(k):
        quoted = "<p>read our paper" if k < 3 else ""
        return f"<div><p>read our paper</p></div><h1>t{k}</h1><div><p>one {k}{quoted}<p>two {k}</p></div>"

    found = texts_of(spark, [body(k) for k in range(24)])
    assert found == [f"t{k} one {k}" + (" read our paper" if k < 3 else "") + f" two {k}" for k in range(24)]


def test_an_optional_notice_is_counted_where_it_can_stand(spark):
    # A notice on a third of the pages is no constant of its path, but the only text at its place.
    def body(k):
        notice = "<div><p>this page is old</p></div>" if k % 3 == 0 else ""
        return f"<h1>t{k}</h1><div><p>one {k}<p>two {k}</p></div>{notice}<div><ul><li>end {k}</ul></div>"

    assert texts_of(spark, [body(k) for k in range(45)]) == [f"t{k} one {k} two {k} end {k}" for k in range(45)]


def test_a_page_of_constant_texts_alone_keeps_them(spark):
    rows = ["<p>closed</p>" + "<br>x" * (k % 2) + f"<i>{k}</i>" * (k > 11) for k in range(24)]
    found = texts_of(spark, rows)
    assert found[0] == "closed" and all(f.endswith(str(k)) for k, f in enumerate(found) if k > 11)
