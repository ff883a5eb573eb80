"""Benchmark items of any length, and recall on edits that had no say in it."""

import random
import resource
import time

import numpy as np
import pytest

from colloquy.llm import decontam


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        out[at : at + (kind < 2)] = [] if kind == 0 else [f"edit{rng.randrange(10**6)}"]
    return out


def test_long_distance_equals_the_plain_one():
    rng = np.random.default_rng(3)
    for _ in range(200):
        item, text = rng.integers(1, 6, rng.integers(1, 14)), rng.integers(1, 6, rng.integers(0, 30))
        for most in (0, 2, 5):
            want = decontam.distance_within(item.tolist(), text.tolist(), most)
            got = decontam.long_distance_within(item, text, most)
            assert (got is None) == (want is None)
            if got:
                assert (got[0], got[2]) == (want[0], want[2])
                # The stretch that is named has that distance as a whole.
                assert decontam._last_row(item, text[got[1] : got[2]], False)[-1] == got[0]


def test_long_items_are_found_and_named():
    rng = random.Random(5)
    base = [[f"w{rng.randrange(3000)}" for _ in range(n)] for n in (30, 193, 700, 3000)]
    index = decontam.build([(k, " ".join(w)) for k, w in enumerate(base)])
    assert [len(w) for w in index.items] == [30, 193, 700, 3000] and max(map(len, index.pieces)) <= decontam.PIECE
    filler = lambda n: [f"f{rng.randrange(900)}" for _ in range(n)]
    for k, w in enumerate(base):
        most = index.allowed[k]
        texts = [" ".join(filler(300) + edited(rng, w, most * 9 // 10) + filler(300)) for _ in range(4)] + [" ".join(w), " ".join(filler(40) + w[: len(w) // 2])]
        got = decontam.search(index, texts)
        assert {o for o, i, *_ in got if i == k} == {0, 1, 2, 3, 4}
        at = {o: (e, s, t) for o, i, e, s, t in got if i == k}
        assert at[4] == (0, 0, len(w)) and all(at[o][0] <= most and abs(at[o][1] - 300) <= most for o in range(4))


def test_one_long_item_among_many_builds_soon():
    rng = random.Random(6)
    items = [(k, " ".join(f"w{rng.randrange(100_000)}" for _ in range(30))) for k in range(19_999)]
    items.append((-1, " ".join(f"w{rng.randrange(100_000)}" for _ in range(3000))))
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    index = decontam.build(items)
    took = time.perf_counter() - began
    text = " ".join(edited(rng, items[-1][1].split(), 500)) + " and " + items[7][1]
    assert {i for _, i, *_ in decontam.search(index, [text])} == {7, 19_999}
    assert took < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


@pytest.mark.parametrize("size", [10, 30, 60, 120, 192, 260])
def test_recall_on_fresh_edits(size):
    rng = random.Random(size)
    items = [(k, " ".join(f"w{rng.randrange(2000)}" for _ in range(size))) for k in range(60)]
    index = decontam.build(items)
    texts, of = [], []
    for k, text in items * 5:
        texts.append(" ".join([f"f{rng.randrange(50)}" for _ in range(20)] + edited(rng, text.split(), index.allowed[k]) + ["end"] * 20))
        of.append(k)
    found = {(o, i) for o, i, *_ in decontam.search(index, texts)}
    assert np.mean([(o, k) in found for o, k in enumerate(of)]) >= 0.95


def test_a_hard_group_takes_every_window():
    rng = random.Random(9)
    items = [(k, " ".join(f"w{rng.randrange(50)}" for _ in range(20))) for k in range(8)]
    index = decontam.build(items, most=1)
    assert any(g.every for g in index.groups)
    for k, text in items:
        for _ in range(10):
            assert k in {i for _, i, *_ in decontam.search(index, [" ".join(["a", "b", *edited(rng, text.split(), 4), "c"])])}
