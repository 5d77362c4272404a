"""The queries against DuckDB or brute force on the smallest tables, and the pipeline's stages."""

import collections
import hashlib
import html
import re
import zlib

import duckdb
import pytest
import xxhash
from test_pii import plain_spans
from test_quality import plain

import corpus_pipeline
from repolens.llm.pii import KINDS
from repolens.llm.queries import ORACLES, QUERIES
from repolens.llm.tokens import tokenizer_path

SF = "/root/testdata/sf0.001"
TOXIC = re.compile("idiot|clown|moron|pathetic|worthless|loser|scum|trash|stupid|disgusting", re.IGNORECASE)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in "documents", "pages", "benchmark", "labels", "conversations", "embeddings":
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(tables):
    return dict(tables.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, tables, name):
    want = tables.sql(ORACLES[name])
    rows = QUERIES[name](spark, SF).select(*sorted(want.columns)).collect()
    listed = ", ".join(f'"{c}"' for c in sorted(want.columns))
    assert sorted(map(tuple, rows), key=str) == sorted(tables.sql(f"SELECT {listed} FROM ({ORACLES[name]})").fetchall(), key=str)


@pytest.mark.parametrize("name", ["op1_chat", "op2_licenses", "op6_quality", "op8_pii"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_base_spans_of_the_whole_table(spark, texts):
    rows = QUERIES["op8_pii"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in spans) for k in KINDS], r["doc_id"]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"].startswith(joined)


def test_base_rules_of_the_whole_table(spark, texts):
    names = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    rows = QUERIES["op6_quality"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[n] for n in names) == plain(texts[r["doc_id"]]) and not (r["kept"] and r["base_failed"])


def test_fingerprints_and_components_of_the_whole_table(spark, texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    prints = {}
    for d, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(lower))
        shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    least = {d: d for d in prints}
    while True:
        new = {d: min(least[e] for e in prints if (prints[d] ^ prints[e]).bit_count() <= 3) for d in prints}
        if new == least:
            break
        least = new
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op3_simhash"](spark, SF).collect()}
    assert found == {d: (f"{p:016x}", least[d]) for d, p in prints.items()}


def library_ids(texts):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_path()).encode
    return {d: [*encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_token_files(spark, texts):
    ids, at = library_ids(texts), 0
    found = {r["doc_id"]: r for r in QUERIES["op4_token_files"](spark, SF).collect()}
    for d in sorted(texts):
        assert (found[d]["start"], found[d]["n_tokens"], found[d]["ids_crc32"]) == (at, len(ids[d]), crc(ids[d]))
        at += len(ids[d])


def test_packing(spark, texts):
    ids, covered = library_ids(texts), collections.Counter()
    for r in QUERIES["op7_packing"](spark, SF).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert crc(part) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered[r["doc_id"]] += r["length"]
    assert covered == {d: len(x) for d, x in ids.items()}


def test_main_text(spark, tables):
    pages = dict(tables.sql("SELECT page_id, html FROM pages").fetchall())
    found = QUERIES["op9_html"](spark, SF).collect()
    assert len(found) == len(pages)
    for r in found:
        article = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.DOTALL)[1]
        plain = re.sub(r"</?b>", "", re.sub(r"</?(?:p|br|h1)>", " ", article))
        assert r["text"] == " ".join(html.unescape(plain).split())
        assert r["n_chars"] == len(r["text"])


def test_toxicity_of_held_out_documents(spark, tables, texts):
    found = {r["doc_id"]: r for r in QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    for d, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5)
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    caught = [found[d]["predicted"] for d, t in rows if len(TOXIC.findall(t or "")) >= 3]
    clean = [found[d]["predicted"] for d, t in rows if not TOXIC.search(t or "")]
    assert sum(caught) >= 0.9 * len(caught) and sum(clean) <= 0.05 * len(clean)


def test_pipeline_stages(spark, tables, texts, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.count() == len(kept[name])
    assert kept["toxicity"].items() <= texts.items() and kept["near_duplicates"].items() <= kept["toxicity"].items()
    assert len(kept["toxicity"]) > 0.85 * len(texts)
    words = {tuple(t.split()) for t in kept["near_duplicates"].values()}
    assert len(words) == len(kept["near_duplicates"]) and len(words) > 0.8 * len(kept["toxicity"])
    items = [t for _, t in tables.sql("SELECT item_id, text FROM benchmark").fetchall()]
    windows = {tuple(w[i : i + 10]) for w in map(split, items) for i in range(len(w) - 9)}
    changed = 0
    for d, t in kept["near_duplicates"].items():
        w = split(t)
        if any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9)):
            changed += 1
            after = split(kept["decontamination"].get(d, ""))
            assert not any(tuple(after[i : i + 10]) in windows for i in range(len(after) - 9))
        elif all(len(split(x)) >= 10 for x in items):
            assert kept["decontamination"][d] == t
    assert changed
    assert not any(re.search(r"[a-z0-9]@mail\d", t) for t in kept["pii"].values())
    assert kept["pii"].keys() == kept["decontamination"].keys()
    last = corpus_pipeline.packed(spark, docs, SF).collect()
    ids = library_ids({d: t or "" for d, t in kept["pii"].items()})
    assert sum(r["length"] for r in last) == sum(map(len, ids.values()))


def split(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))


@pytest.mark.parametrize("n_rows", [0, 3])
def test_pipeline_stages_on_odd_tables(spark, n_rows):
    rows = [(None, None, None, "a"), (1, "", 0, None), (1, "", 0, None)][:n_rows]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, n_hit INT, toxic_score STRING")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes and out.count() <= n_rows
    assert corpus_pipeline.packed(spark, docs, SF).count() == n_rows


def test_pipeline_runs_as_its_stages_do(spark):
    found = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(found.columns) and found.count() > 100


