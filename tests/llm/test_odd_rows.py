"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra
columns with clashing names, for every operator and pipeline stage."""

import base64
import random
import time
from collections import Counter

import pytest

import corpus_pipeline
from colloquy.llm import decontam, extraction, langid, linededup, mixing, quality, secrets, simhash, toxicity, urls
from colloquy.llm.common import stash, written

#: Extra columns named like what the operators make themselves.
CLASHING = "gone_lines string, gone_doc long, fp long, root long, component_id string, size string, taken string, score double, text_hash long, kept string, label string, u long, v long"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
N_CLASHING = len(CLASHING.split(","))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en" if k % 2 else "fr", "s" if k % 3 else None, len(t or "")) + (None,) * N_CLASHING for k, (i, t) in enumerate(rows)], DOCS)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(documents, sf_dir): odd rows, and the small tables that stages read."""
    rng = random.Random(9)
    words = [f"word{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = "\n".join(text(40) for _ in range(3000)) + "\n" + "x" * 200_000 + "\n" + " ".join(["again"] * 20_000)
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, long), (5, long), (None, text(60)), (None, None), (6, "one"), (7, "one"), (8, "½ ² 3 Ⅷ ①"), (9, "ÀÉ\x00퟿"), (9, text(30)), (9, text(31))]
    same = text(80)
    rows += [(20, same), (20, same), (21, same), (None, same), (None, same)]
    rows += [(100 + k, text(50) + (" awfulword badword" if k % 4 == 0 else "")) for k in range(120)]
    folder = tmp_path_factory.mktemp("odd")
    labels = [(100 + k, 1, int(k % 4 == 0)) for k in range(120)] + [(None, 1, 1), (101, None, None), (20, 0, 0), (20, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, text(20)), (1, None), (None, ""), (2, same[:200])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, _ = stash(documents(spark, rows))
    docs.write.parquet(f"{folder}/documents.parquet")
    return docs, str(folder)


def test_every_operator_takes_odd_rows(spark, tables):
    docs, folder = tables
    labels, benchmark = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    n, ids = docs.count(), Counter(r["doc_id"] for r in docs.collect())
    for found in (quality.quality(docs), langid.identify(docs), mixing.mix(docs), secrets.find_secrets(docs), simhash.near_duplicates(docs), toxicity.score(docs, labels)):
        rows = found.collect()
        assert len(rows) == n and Counter(r["doc_id"] for r in rows) == ids
    lines = linededup.line_decisions(docs).collect()
    assert {r["doc_id"] for r in lines} >= {4, 5, 6, 7, 9, 20, None} and not {1, 2, 3} & {r["doc_id"] for r in lines}
    assert not any(r["kept"] for r in lines if r["doc_id"] == 5) and [r["kept"] for r in lines if r["doc_id"] == 7] == [False]
    # Rows without an id that differ in text are documents of their own.
    assert sum(r["kept"] for r in lines if r["doc_id"] is None) == 1
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, benchmark).collect()}
    assert {(20, 2), (21, 2), (None, 2)} <= found and not any(i in (1, 2, 3) for i, _ in found)
    und = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert und[8] == und[1] == und[2] == und[3] == "und" != und[6]


def test_operators_repeat_their_answers(spark, tables):
    docs, folder = tables
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for run in (langid.identify, mixing.mix, lambda d: toxicity.score(d, labels), linededup.line_decisions, simhash.near_duplicates, secrets.find_secrets):
        one, other = (sorted(map(repr, run(d).collect())) for d in (docs, docs.repartition(7)))
        assert one == other


def test_every_stage_takes_odd_rows(spark, tables):
    docs, folder = tables
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.limit(0)):
            out, _ = written(spark, lambda some=some, stage=stage: stage(spark, some, folder))
            if name == "mixing":
                assert out.count() == some.count()
            else:
                assert out.columns == docs.columns and out.schema == docs.schema
                assert Counter(r["doc_id"] for r in out.collect()) <= Counter(r["doc_id"] for r in some.collect())


def test_pipeline_runs_and_clears_up(spark, tables):
    import os

    root = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(root))
    found = corpus_pipeline.run(spark, tables[1])
    assert {"doc_id", "taken", "target"} <= set(found.columns) and found.count() > 50
    assert len(set(os.listdir(root)) - before) == 1


def test_quality_clashes(spark, tables):
    assert len(set(quality.quality(tables[0]).columns)) == len(quality.quality(tables[0]).columns)


def test_pages(spark):
    schema = "page_id long, url string, html string, host string, text string, score double"
    page = "<body><h1>T</h1><p>Some words of a text that is long enough.</p></body>"
    rows = [(1, "http://a.org/x", page), (1, "http://a.org/x", page), (None, None, None), (2, "", ""), (3, "http://" + "b" * 100_000 + "/" + "c" * 100_000, "<div>" * 20_000 + "deep" + "<p>x" * 50_000)]
    pages = spark.createDataFrame([(*r, None, None, None) for r in rows], schema)
    got = sorted(map(tuple, extraction.extract(pages).select("page_id", "text", "n_chars").collect()), key=repr)
    assert got.count((1, "T\nSome words of a text that is long enough.", 43)) == 2 and (None, "", 0) in got and (2, "", 0) in got and len(got) == 5
    verdicts = urls.filter_urls(pages).collect()
    assert Counter(r["page_id"] for r in verdicts) == {1: 2, None: 1, 2: 1, 3: 1}
    empty = urls.probability(urls.fit(urls.labelled_urls()), "", "")
    assert all(r["score"] == pytest.approx(empty) and (r["host"], r["path"], r["rule"]) == ("", "", None) for r in verdicts if r["page_id"] in (None, 2))
    assert extraction.extract(pages.limit(0)).count() == 0 and urls.filter_urls(pages.limit(0)).count() == 0


MARKUP = ["<a ", "<b>", '<a "', '<a "">', "<li>", "<!--", "<script>", '<a href=">x</a>', "<p><b>", "<b></i>", "<div><p></p>"]


@pytest.mark.parametrize("part", MARKUP)
def test_html_takes_linear_time(part):
    began = time.perf_counter()
    extraction.main_text(part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 20


CHAINS = ["%" + "25" * 50_000 + "41", "\\u005c" + "u005c" * 20_000 + "u0041", "&#38;" + "#38;" * 25_000, "%2541" * 20_000, "QUJD" * 25_000, "deadbeef" * 12_000, "%E4%BD%A0" * 11_000]


@pytest.mark.parametrize("k", range(len(CHAINS)))
def test_secrets_take_linear_time(k):
    began = time.perf_counter()
    secrets.scan(CHAINS[k])
    secrets.scan(base64.b64encode(CHAINS[k].encode()).decode())
    assert time.perf_counter() - began < 20
