"""Token alignment against a plain count over all documents."""

import hashlib
import json
import random
from bisect import bisect_right
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from colloquy.llm import alignment
from colloquy.llm.alignment import VOCABULARIES, Run

pytestmark = pytest.mark.skipif(not Path(VOCABULARIES).is_dir(), reason="no vocabularies")
SCHEMA = "doc_id long, text string, row long, kind string, n_a string, run string, bucket string"


@pytest.fixture(scope="module")
def enc():
    return alignment.Encoders(Path(VOCABULARIES, "byte_bpe_50k.json").read_bytes(), Path(VOCABULARIES, "piece_bpe_32k.model").read_bytes())


def plain(enc, rows):
    """The contract, one token after the other."""
    tokens = []
    for _, text in rows:
        a = enc.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = enc.b.encode(text) if text else []
        same = text and b"".join(enc.bytes_a[i] for i in a) == b"".join(enc.bytes_b[i] for i in b) == b" " + text.encode()
        tokens.append((a, b) if same else ([], []))
    links, groups = [], []
    for a, b in tokens:
        ends = []
        for ids, known in ((a, enc.bytes_a), (b, enc.bytes_b)):
            at, own = 0, {}
            for i in ids:
                at += len(known[i])
                own[at] = i
            ends.append(own)
        both = [x for x in ends[0] if x in ends[1]]
        links.append([(ends[0][x], ends[1][x]) for x in both])
        places = [list(own) for own in ends]
        cut = lambda k, lo, hi: ",".join(str(ends[k][x]) for x in places[k][bisect_right(places[k], lo) : bisect_right(places[k], hi)])
        groups.append([f"{cut(0, lo, hi)}|{cut(1, lo, hi)}" for lo, hi in zip([0, *both], both, strict=False)])
    count = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return Counter(
        (i, len(a), len(b), len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for (i, _), (a, b), x, g in zip(rows, tokens, links, groups, strict=True)
    )


def found(spark, rows, **more):
    docs = spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], SCHEMA).repartition(3)
    return Counter(map(tuple, alignment.align(docs, **more).collect()))


ODD = [
    (1, None), (2, ""), (3, " "), (4, "one"), (4, "one"), (4, "other words"), (None, "one two"), (5, "<|endoftext|> <s>a</s><unk> <0x41>"), (6, "a▁b"),
    (7, "你好 \U0001f600 é \x00\n\t  x"), (8, " lead  and trail "), (9, "x" * 30_000), (10, "word " * 20_000), (11, "� 　"),
]


def test_equals_plain_count(spark, enc, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()] + ODD
    want = plain(enc, rows)
    assert found(spark, rows) == want
    # Small buffers give many runs, small buckets split all that are frequent.
    assert found(spark, rows, buffer_links=40_000, bucket_records=2000) == want


def test_odd_rows(spark, enc):
    assert found(spark, []) == Counter()
    assert found(spark, [(1, None), (1, None), (2, "")]) == Counter({(1, 0, 0, 0, 0, 0, 0, ""): 2, (2, 0, 0, 0, 0, 0, 0, ""): 1})
    assert found(spark, ODD) == plain(enc, ODD)
    # A text with U+2581 comes back from the pieces as another text.
    assert (6, 0, 0, 0, 0, 0, 0, "") in found(spark, ODD)


def test_every_byte_has_a_character(enc):
    assert sorted(alignment.byte_alphabet().values()) == list(range(256))
    assert all(enc.bytes_a) and all(enc.bytes_b)


def test_side_a_gives_what_its_file_says(enc, spark, sf_dir):
    rng = random.Random(8)
    marks = " \n\t\r\x0b\x1c\x85\u00a0\u2028\u3000aZéß'’0½Ⅷ你的\U0001f600\u0301.,-_\x00"
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    assert enc.fast is not None
    for t in texts:
        assert enc.ids_a(" " + t) == enc.a.encode(" " + t, add_special_tokens=False).ids
    other = json.loads(Path(VOCABULARIES, "byte_bpe_50k.json").read_bytes())
    other["model"]["merges"][0], other["model"]["merges"][1] = other["model"]["merges"][1], other["model"]["merges"][0]
    assert alignment._ranked(other, enc.bytes_a) is None


def test_runs_come_back():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 50, 5000), rng.integers(0, 300, 5000)
    rows = np.sort(rng.integers(1 << 40, (1 << 40) + 70, 5000))
    keys = alignment.pair_key(a, b)
    seen = Counter()
    for bucket, run in alignment.runs_of(keys, rows):
        back = Run.unpacked(run.packed())
        for one, other in zip(vars(run).values(), vars(back).values(), strict=True):
            assert np.array_equal(one, other)
        at = 0
        for key, size in zip(back.keys.tolist(), back.sizes.tolist(), strict=True):
            assert key >> 56 == bucket
            for k in range(at, at + size):
                seen[key, int(back.rows[k])] += int(back.times[k])
            at += size
    assert seen == Counter(zip(keys.tolist(), rows.tolist(), strict=True))


def test_merge_is_sorted():
    rng = random.Random(4)
    lists = [sorted(rng.sample(range(60), rng.randrange(30))) for _ in range(9)]
    got = list(alignment.merged(lists))
    assert [k for k, _ in got] == sorted({x for own in lists for x in own})
    assert all(lists[r][i] == k for k, members in got for r, i in members) and sum(len(m) for _, m in got) == sum(map(len, lists))
