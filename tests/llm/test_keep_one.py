"""One document of each SimHash component stays, whatever the ids are."""

from collections import Counter

from colloquy.llm import simhash

A, B, C = "alpha beta gamma delta", "one two three four", "x y z w"


def kept(spark, rows):
    docs = spark.createDataFrame([(*r, k, None) for k, r in enumerate(rows)], "doc_id long, text string, text_hash long, fp string")
    return Counter((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect())


def test_repeated_ids_in_several_components(spark):
    assert kept(spark, [(2, B), (5, A), (5, B)]) == Counter({(2, B): 1, (5, A): 1})
    assert kept(spark, [(2, A), (2, B), (3, A), (3, B), (3, C)]) == Counter({(2, A): 1, (2, B): 1, (3, C): 1})


def test_rows_without_an_id(spark):
    assert kept(spark, [(None, A), (None, A), (None, A), (None, B), (7, B), (None, C)]) == Counter({(None, A): 1, (7, B): 1, (None, C): 1})
    assert kept(spark, [(None, None), (None, ""), (4, "one")]) == Counter({(None, None): 1, (4, "one"): 1}) or kept(spark, [(None, None), (None, ""), (4, "one")]) == Counter({(None, ""): 1, (4, "one"): 1})


def test_equal_rows_stay_together(spark):
    assert kept(spark, [(3, A), (3, A), (4, A)]) == Counter({(3, A): 2})
    assert kept(spark, []) == Counter()


def test_each_component_keeps_one_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    of = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert Counter(r["doc_id"] for r in simhash.keep_one(docs).collect()) == Counter(set(of.values()))
