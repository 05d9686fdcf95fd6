"""The registered queries on the smallest tables, and the pipeline stage by stage."""

import hashlib
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from folioforge.llm import html_extract, pii, queries, secret_scan, toxicity
from tests.compare import oracle, same
from tests.llm.test_operators import brute_components, brute_disclosing, brute_pii, brute_quality, brute_secrets, flat, tokenizer

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in queries.ORACLE_SQL:
        want = oracle(SF, queries.ORACLE_SQL[name])
        same(got[list(want.columns)], want)


def rows_of(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF).collect()}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_quality_query_by_brute_force(spark, texts):
    for i, r in rows_of(spark, "op3_quality_rules").items():
        n, chars, symbols, dups, repeats = brute_quality(texts[i])
        failed = n < 50 or 100 * repeats > 50 * n
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (n, chars, symbols, dups, repeats, failed)
        assert r["kept"] == (not failed and r["p_good"] >= 0.5)


def test_bpe_query_by_the_library(spark, texts):
    k = tokenizer("byte_bpe_50k.json")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i, r in rows_of(spark, "op4_bpe").items():
        ids = k.encode(texts[i], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(k.decode(ids, skip_special_tokens=False)))


def test_packing_query_by_the_library(spark, texts):
    k, pieces, fill = tokenizer("word_bpe_49k.json"), [], {}
    rows = queries.QUERIES["op5_packing"](spark, SF).collect()
    for i, t in texts.items():
        ids = [*k.encode(t, add_special_tokens=False).ids, 1]
        pieces += [(i, p, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(pieces)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 4096 and len(fill) == -(-sum(fill.values()) // 4096)


def test_join_query_by_brute_force(spark, texts):
    ids = sorted(texts)
    label, sizes = brute_components([texts[i] for i in ids])
    got = rows_of(spark, "op6_jaccard_join")
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in ids] == [(n, ids[k]) for n, k in zip(sizes, label)]


def test_toxicity_query_by_one_model(spark, texts):
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    for i, r in rows_of(spark, "op7_toxicity").items():
        grades = model.grades(texts[i].encode())
        assert r["kept"] == (grades[0] >= 0.5) and abs(r["expected_severity"] - sum(k * p for k, p in enumerate(grades))) < 1e-9


def test_span_queries_by_brute_force(spark, texts):
    sha = lambda spans: hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    ids = sorted(texts)
    more = dict(zip(ids, brute_disclosing([texts[i] for i in ids])))
    for i, r in rows_of(spark, "op8_pii").items():
        base = brute_pii(texts[i])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS] and r["base_sha256"] == sha(base)
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in base + sorted(more[i], key=lambda s: (pii.KINDS.index(s[0][5:]), s[1])))
    for i, r in rows_of(spark, "op10_secret_scan").items():
        base = brute_secrets(texts[i])
        assert [r[f"n_{k}"] for k in secret_scan.KINDS] == [sum(s[0] == k for s in base) for k in secret_scan.KINDS] and r["base_sha256"] == sha(base)
        assert set(f"{k}:{a}:{b}" for k, a, b in base) <= set(r["spans"].split(",")) | {""}


def test_pages_query_page_by_page(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.QUERIES["op1_html_extraction"](spark, SF).collect():
        inner = re.search(r"(?s)<article>(.*)</article>", pages[r["page_id"]])[1]
        assert r["text"] == "\n".join(html_extract.parse(inner).texts.values()) and r["n_chars"] == len(r["text"])


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], SF))
    start, calm, single, apart, clean = [{r["doc_id"]: r["text"] for r in t.collect()} for t in tables[:5]]
    assert all(labels.get(i, 1) for i in start if i not in calm)
    first = {}
    for i in sorted(calm):
        first.setdefault(flat(calm[i]), i)
    assert sorted(single) == sorted(first.values())
    ids = sorted(single)
    label, _ = brute_components([single[i] for i in ids], 5, 80)
    assert sorted(apart) == sorted({ids[k] for k in label})
    for i, t in clean.items():
        assert (t == apart[i]) == (not brute_pii(apart[i] or "")) or not brute_pii(t or "")
    assert all(t.columns == docs.columns for t in tables[:5])
    assert {r["doc_id"] for r in tables[5].collect()} == set(clean)
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == tables[5].count() and corpus_pipeline.ORACLE_SQL is None


EXTRA = "doc_id long, text string, lang string, source string, n_chars int, _id string, _sha string, _added string, doc string, sha string, id string, row string"


def folder_of(spark, tmp_path, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, None, "s", len(t) if t is not None else None, "x", "y", "z", "d", "h", "i", "r") for i, t in zip(ids, texts)]
    spark.createDataFrame(rows, EXTRA).write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = [(k, None if k % 7 == 0 else 1, None if k % 5 == 0 else int("idiot" in (t or ""))) for k, t in zip(ids, texts) if k is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and ids, and columns whose names clash with inner ones, stage by stage."""
    long = "very long text " * 20_000
    texts = [None, "", " ", "a b c d e f g h", "a  b c\nd e f g h", "a b c d e f g h", "mail jk@mail.example now please do", long, long + "end", "idiot you are", *["plain text of it number " + str(k) for k in range(12)], *["idiot idiot moron " + str(k) for k in range(6)]]
    ids = [0, 1, 2, 3, 4, 3, None, 7, 8, 9, *range(10, 28)]
    sf = folder_of(spark, tmp_path, texts, ids)
    tables = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], sf))
    kept = [[(r["doc_id"], r["text"]) for r in t.collect()] for t in tables[:5]]
    assert all(t.columns == tables[0].columns for t in tables[:5])
    assert all(r["_id"] == "x" and r["sha"] == "h" and r["row"] == "r" for t in tables[1:5] for r in t.collect())
    calm, single, apart, clean = (sorted(k, key=str) for k in kept[1:])
    assert not any("idiot idiot" in (t or "") for _, t in calm) and (0, None) in calm and (1, "") in calm
    first = {}
    for i, t in calm:
        first[flat(t)] = min(first.get(flat(t), (1, 0)), (i is None, i or 0))
    assert sorted((i is None, i or 0) for i, _ in single) == sorted(first.values())
    names = [i for i, _ in single]
    label, _ = brute_components([t for _, t in single], 5, 80)
    least = {c: min((i for i, k in zip(names, label) if k == c and i is not None), default=None) for c in label}
    assert sorted(str(i) for i, _ in apart) == sorted(str(i) for i, c in zip(names, label) if i is None or i == least[c])
    assert (None, "mail [EMAIL] now please do") in clean and len(clean) == len(apart)
    pieces = tables[5].collect()
    assert sorted({str(r["doc_id"]) for r in pieces}) == sorted({str(i) for i, _ in clean})
    again = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, (r[:5] for r in again.collect()))) == sorted(map(str, (r[:5] for r in pieces)))


def test_pipeline_on_empty_tables(spark, tmp_path):
    sf = folder_of(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, sf).count() == 0
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).count() == 0


def test_pipeline_leaves_one_table(spark, tmp_path):
    from folioforge.llm import common

    before = set(common._written)
    out = corpus_pipeline.run(spark, folder_of(spark, tmp_path, ["one text", "another one", "one  text"]))
    assert set(common._written) - before == {out._stage_path} and out.count() == 2
    common.discard(out)
