"""Word graphs against all cuts, chains against all states, byte pairs against
a plain merge."""

import itertools
import random
from pathlib import Path

import pytest

from colloquy.functions import bytepairs, segmentation
from colloquy.functions.segmentation import BEGIN, END, MIDDLE, SINGLE
from colloquy.plans import turns

TALK = ["软件 工程 软件工程 架构 工程 软件", "架构 的 工程 是 软件", "他 说 软件工程 架构 好", "好 的 软件 工程 架构 软件 工程"]


@pytest.fixture(scope="module")
def model(spark):
    return segmentation.learn(spark.createDataFrame([(t,) for t in TALK], "text string"), "text", least=1)


def test_search_mode(model):
    assert " ".join(model.search("软件工程架构")) == "软件 工程 软件工程 架构"
    assert list(model.cut("他说好的,软件 2024工程")) == ["他", "说", "好", "的", "软件", "2024", "工程"]
    assert list(model.search("")) == list(model.search("!? ")) == []


def every_cut(block):
    for k in range(len(block)):
        for cuts in itertools.combinations(range(1, len(block)), k):
            at = [0, *cuts, len(block)]
            yield [block[a:b] for a, b in zip(at, at[1:], strict=False)]


def test_best_way_equals_all_cuts():
    rng = random.Random(1)
    for _ in range(60):
        words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))): -rng.random() * 5 for _ in range(8)}
        own = segmentation.Segmenter(words, {}, {}, -9.0, -9.0)
        block = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 10)))
        worth = lambda cut: sum(words.get(w, own.unknown) for w in cut)  # noqa: B023, E731
        allowed = [c for c in every_cut(block) if all(len(w) == 1 or w in words for w in c)]
        assert worth(own.best(block)) == pytest.approx(max(map(worth, allowed)))
        assert "".join(own.best(block)) == block


def test_chain_equals_all_states(model):
    rng = random.Random(2)
    for _ in range(80):
        run = "".join(rng.choice("软件工程架构的好他说新") for _ in range(rng.randrange(2, 7)))
        best = None
        for cut in every_cut(run):
            states = [s for w in cut for s in ([SINGLE] if len(w) == 1 else [BEGIN, *[MIDDLE] * (len(w) - 2), END])]
            worth = sum(model.emit.get(c, (model.unseen,) * 4)[s] for c, s in zip(run, states, strict=True))
            worth += sum(model.turn[a, b] for a, b in zip([END, *states], states, strict=False))
            best = max(best or (-1e18, None), (worth, cut))
        got = model.chain(run)
        again = [s for w in got for s in ([SINGLE] if len(w) == 1 else [BEGIN, *[MIDDLE] * (len(w) - 2), END])]
        worth = sum(model.emit.get(c, (model.unseen,) * 4)[s] for c, s in zip(run, again, strict=True)) + sum(model.turn[a, b] for a, b in zip([END, *again], again, strict=False))
        assert "".join(got) == run and worth == pytest.approx(best[0])


def test_unspaced_documents(spark, sf_dir):
    """Nothing is lost, and the words of the unspaced text are found again."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60)
    own = segmentation.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text")
    found = same = total = 0
    for r in rows.collect():
        letters = lambda t: "".join(segmentation._BLOCK.findall(t))
        plain = r["text"].replace(" ", "")
        words = list(own.cut(plain))
        assert "".join(words) == letters(plain)
        ends = lambda parts: set(itertools.accumulate(map(len, parts)))
        wanted = ends(segmentation._BLOCK.findall(r["text"]))
        found += len(ends(words))
        same += len(ends(words) & wanted)
        total += len(wanted)
    assert same / total > 0.7 and same / found > 0.7
    long = "ab" * 100_000
    assert "".join(own.cut(long)) == long


def test_odd_texts(spark, model):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "软件工程"), (4, "…\n\x00")], "id long, text string")
    got = {r["id"]: r["search_tokens"] for r in segmentation.segmented(rows, rows["text"], model).collect()}
    assert got == {1: None, 2: "", 3: "软件 工程 软件工程", 4: ""}
    empty = segmentation.learn(rows.limit(0), "text")
    assert list(empty.cut("ab c")) == ["ab", "c"] or list(empty.cut("ab c")) == ["a", "b", "c"]


def plain_merge(piece, known):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        ranked = [(known[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in known]
        if not ranked:
            return parts
        k = min(ranked)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


needs_files = pytest.mark.skipif(not Path(bytepairs.FOLDER).is_dir(), reason="no vocabularies")


@needs_files
def test_merges_equal_a_plain_merge():
    known = bytepairs.ranks(bytepairs.DEFAULT)
    rng = random.Random(3)
    for _ in range(1500):
        piece = "".join(rng.choice("aeinrst hlo'ßé你1") for _ in range(rng.randrange(1, 24))).encode()
        assert bytepairs.merged(piece, known) == plain_merge(piece, known) or piece in known
    assert bytepairs.merged(b"", known) == [] and b"".join(bytepairs.merged(b"x" * 50_000, known)) == b"x" * 50_000


@needs_files
def test_counts_equal_plain_encoding(spark, sf_dir):
    tiktoken = pytest.importorskip("tiktoken")
    coders = {n: tiktoken.Encoding(n, pat_str=bytepairs.SPLIT, mergeable_ranks=bytepairs.ranks(n), special_tokens={}) for n in {*bytepairs.ENCODINGS.values(), bytepairs.DEFAULT}}
    odd = [(-1, None), (-2, ""), (-3, " \n\t x  "), (-4, "it's 12 　 \x1c\x85y <|endoftext|>"), (-5, "你好" * 3000), (-6, "x" * 40_000)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    for name, coder in coders.items():
        from pyspark.sql import functions as F

        got = bytepairs.counted(docs, F.col("text"), F.lit(name)).collect()
        assert len(got) == docs.count()
        for r in got:
            assert r["tokens"] == len(coder.encode_ordinary(r["text"] or ""))


@needs_files
def test_counts_by_model(spark, sf_dir):
    got = turns.model_token_counts(spark, sf_dir).collect()
    of = {r["model"]: r["encoding"] for r in got}
    assert of["gpt-4o"] == of["gpt-4o-mini"] == "byte_bpe_multi_50k" and of["custom-model-x"] == of["glm-4"] == "byte_bpe_50k"
    assert len(got) == spark.read.parquet(f"{sf_dir}/conversations.parquet").count() and all(r["tokens"] > 0 for r in got)
