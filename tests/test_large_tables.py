"""What shows on large tables only, on a few rows like theirs."""

import random
import time

import duckdb

from colloquy.functions import segmentation
from colloquy.plans import queries, turns


def test_requests_after_sessions_of_any_time(spark, tmp_path):
    """Sessions of large ids lie decades later, and a request after them still
    finds nothing."""
    rows = [(n, turn, "user", f"and with this {turn}") for n in (3, 8, 52_598, 60_003, 60_004, 300_001, 1_000_003) for turn in range(3)]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(queries.oracle_sql()["history_tool_answers"]).fetchall()
    got = [tuple(r) for r in turns.history_tool_answers(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def segmenter(rng, letters, n, longest):
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))): -float(rng.randrange(1, 9)) for _ in range(n)}
    turn = {(a, b): -1.0 for b, before in segmentation._BEFORE.items() for a in before}
    return segmentation.Segmenter(words, {}, turn, -9.0, -9.0)


def test_blocks_together_equal_blocks_alone(monkeypatch):
    """Worths are whole numbers, so that equal ways are frequent."""
    rng = random.Random(5)
    for together, longest, heads in ((40, 30, 1 << 21), (1 << 18, 1 << 11, 1 << 21), (500, 1 << 11, 0), (500, 1 << 11, 30)):
        monkeypatch.setattr(segmentation, "_TOGETHER", together)
        monkeypatch.setattr(segmentation, "_LONGEST_BLOCK", longest)
        monkeypatch.setattr(segmentation, "_HEADS", heads)
        for letters in ("ab", "abcdefgh", "软件工程架\U00020000构的"):
            own = segmenter(rng, letters, 60, 6)
            blocks = ["".join(rng.choice(letters + "zé") for _ in range(rng.randrange(0, 80))) for _ in range(60)]
            assert own.best_of(blocks) == [own.best(b) for b in blocks]
            texts = ["", "12 ab34, !", *(" ".join(blocks[k : k + 4]) for k in range(0, 60, 4))]
            assert list(own.searched(texts)) == [" ".join(own.search(t)) for t in texts]
    assert list(segmenter(rng, "a", 0, 2).searched(["ab", ""])) == [" ".join(segmenter(rng, "a", 0, 2).search("ab")), ""]


def test_many_blocks_take_less_time_than_one_by_one():
    rng = random.Random(6)
    own = segmenter(rng, "etaoinshrdlu", 20_000, 9)
    blocks = ["".join(rng.choice("etaoinshrdlu") for _ in range(60)) for _ in range(4000)]
    own.best_of(blocks[:9])
    began = time.perf_counter()
    together = own.best_of(blocks)
    between = time.perf_counter()
    assert [own.best(b) for b in blocks] == together
    assert 1.5 * (between - began) < time.perf_counter() - between


def test_words_are_counted_as_the_pattern_finds_them(spark):
    from pyspark.sql import functions as F

    from colloquy.functions.text import WORDS

    texts = [None, "", " ", "a b  a", "été_naïve 12½ 软件,工程\n Ⅷ x́ \U0001d7d8", "a-b's", "word " * 5000]
    rows = spark.createDataFrame([(t,) for t in texts * 3], "t string")
    want = rows.select(F.explode(F.regexp_extract_all("t", F.lit(WORDS), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = segmentation.word_counts(rows, "t")
    assert sorted(found.collect()) == sorted(want.collect()) and found.count() > 9
    assert segmentation.word_counts(rows.limit(0), "t").count() == 0


def test_only_frequent_words_are_ordered(spark):
    counts = spark.createDataFrame([(f"w{k:03}", 1 + k // 10) for k in range(100)], "word string, n long")
    assert segmentation._least_kept(counts, 25) == 8 and segmentation._least_kept(counts, 30) == 8 and segmentation._least_kept(counts, 1000) == 0


def test_an_index_reads_each_text_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from colloquy.operators import index

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(n):
        seen.add(1)
        return f"the word{n % 7} and word{n}"

    rows = spark.range(0, 500, 1, 4).select(F.col("id").alias("doc_id"), F.lit(0).alias("ordinal"), F.lit(None).cast("timestamp_ntz").alias("created_at"), text(F.col("id")).alias("text"))
    index.append(rows, f"{tmp_path}/i", "doc_id", "text", file_rows=90, single=True)
    assert seen.value == 500
    stored = index.stored(spark, f"{tmp_path}/i")
    of = lambda where: {int(r["owner"]): r["matched"] for r in index.documents(spark, f"{tmp_path}/i", where).collect()}
    # word0 to word6 are a text's own word too in the first seven.
    assert stored.count() == 2000 - 7 and of("the word3") == {n: 1 + (n % 7 == 3) for n in range(500)}
    files = stored.groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in files) <= 90


def test_tokens_are_the_words_of_two_characters(spark):
    from pyspark.sql import functions as F

    from colloquy.functions.text import WORDS, tokens

    texts = [None, "", "a", "a bb c-dd_e ee", "\U0001d7d8 \U0001d7d8\U0001d7d8 é éé 软 软件 12 1", "x́y İx"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.filter(F.regexp_extract_all(F.lower("t"), F.lit(WORDS), F.lit(0)), lambda w: F.length(F.trim(w)) > 1)
    for r in rows.select(tokens(F.col("t"), lower=True).alias("got"), plain.alias("want")).collect():
        assert r["got"] == r["want"]


def test_a_long_text_does_not_widen_the_others():
    import tracemalloc

    import pandas as pd

    own = segmenter(random.Random(7), "ab", 20, 5)
    column = pd.Series([None, *["abab"] * 3000, "ab " * 20_000])
    own.filled(column[:9])
    tracemalloc.start()
    found = own.filled(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and found[0] is None and found[1] == " ".join(own.search("abab")) and len(found) == len(column)
