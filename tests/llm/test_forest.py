"""MinHash near-duplicates against a comparison of all pairs of sets."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from colloquy.llm import forest

SCHEMA = "doc_id long, text string, id long, root long, region string, n string, c string, kept string"


def plain(rows):
    """(doc_id, n_shingles, component_id, kept) by all pairs that share a shingle."""
    sets, by, up = [], defaultdict(list), list(range(len(rows)))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, (_, text) in enumerate(rows):
        words = [bytes(w).translate(forest._LOWER) for w in (text or "").encode().split()]
        sets.append({tuple(words[k : k + 4]) for k in range(len(words) - 3)} if len(words) > 3 else {tuple(words)} if words else set())
        for j, n in Counter(j for x in sets[i] for j in by[x]).items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                up[top(i)] = top(j)
        for x in sets[i]:
            by[x].append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    name = [least.get(top(i)) if sets[i] else doc for i, (doc, _) in enumerate(rows)]
    return Counter((doc, len(sets[i]), name[i], doc == name[i]) for i, (doc, _) in enumerate(rows))


def found(spark, rows, **more):
    docs = spark.createDataFrame([(*r, *[None] * 6) for r in rows], SCHEMA).repartition(3)
    return Counter(map(tuple, forest.near_duplicates(docs, **more).collect()))


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    rng = random.Random(6)
    out = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    base = [f"w{rng.randrange(500)}" for _ in range(160)]
    out += [(10_000 + k, " ".join(changed(rng, base, rng.randrange(1, 6)))) for k in range(150)]  # one large group
    common = " ".join(f"c{k}" for k in range(60))
    out += [(20_000 + k, common + " " + " ".join(f"o{k}x{i}" for i in range(rng.randrange(10, 50)))) for k in range(120)]  # a passage that many share
    chain = [f"s{k}" for k in range(100)]
    for k in range(12):  # each is like the one before, the ends are not alike
        chain = changed(rng, chain, 2)
        out.append((30_000 + k, " ".join(chain)))
    return out


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (5, "two words"), (5, "two words"), (None, "Two\twords"), (None, None), (None, "alone here"), (6, "É b c d"), (7, "é b c d"), (8, "word " * 30_000), (9, "word word word word"), (9, "x" * 100_000)]


def test_equals_all_pairs(spark, rows):
    want = plain(rows)
    assert found(spark, rows) == want
    # Regions of over six sets go deeper, and blocks hold 24.
    assert found(spark, rows, dense=6, block_rows=24) == want
    assert found(spark, rows, block_shingles=2000) == want


def test_odd_rows(spark):
    got = found(spark, ODD)
    assert got == plain(ODD)
    assert got[(5, 1, 4, False)] == 1 and got[(5, 1, 5, True)] == 2 and got[(None, 1, 5, False)] == 1 and got[(None, 0, None, True)] == 1
    assert found(spark, []) == Counter()
    assert found(spark, [(3, None)]) == Counter({(3, 0, 3, True): 1})


def test_recall_of_the_forest():
    """Pairs at Jaccard 0.8 share a region of some tree, and pass the sketches."""
    rng = np.random.default_rng(4)
    met = deep = likely = 0
    for _ in range(400):
        both, own = rng.integers(0, 1 << 62, 400, dtype=np.uint64), rng.integers(0, 1 << 62, (2, 50), dtype=np.uint64)
        least = np.array([forest.minima(np.concatenate([both, x])) for x in own])
        keys, sketch = forest.signatures(least)
        met += (keys[0] == keys[1]).any()
        deep += (least.reshape(2, forest.TREES, forest.DEPTH)[0] == least.reshape(2, forest.TREES, forest.DEPTH)[1]).all(axis=1).any()
        likely += (sketch[0] == sketch[1]).sum() >= forest._AGREE
    assert met == likely == 400 and deep >= 396


def test_shingles_are_words():
    assert len(forest.shingle_set("a b c d e")) == 2 and len(forest.shingle_set("a b c")) == 1
    assert np.array_equal(forest.shingle_set("A b C"), forest.shingle_set("a b\x0bc")) and not np.array_equal(forest.shingle_set("a b c"), forest.shingle_set("a bc"))
    assert len(forest.shingle_set("d " * 50)) == 1
