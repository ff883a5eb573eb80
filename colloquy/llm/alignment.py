"""Alignment of two tokenizers over a corpus, counted by external spilling.

Every text is encoded twice and its tokens are laid over the same bytes. Places
where tokens of both sides end cut the text into groups; the two tokens that
end there are linked. How often a pair of ids is linked in the whole corpus is
counted from pair-document records:

1. A task that encodes texts keeps records (B id, A id, document, times) in a
   buffer. A full buffer is sorted, cut by radix, the low bits of the B id,
   and each part is written as a run, compressed by zstd, to the shared folder.
2. Runs of one radix bucket meet in a task. A heap merges them in the order of
   their pairs, which counts each pair; as pairs of a B id stand together, its
   largest count is known where the id ends, and then what its pairs give goes
   back to the documents of the runs.
3. A bucket of more than ``bucket_records`` records, as one that holds a very
   frequent token, is dealt over several tasks by run. Each counts its part;
   the sums of the parts, which are as many as there are different pairs, join
   the heap as further runs in a second merge that does the rest of step 2.

The vocabularies are files on the driver; their bytes, of fixed size, are sent
to the tasks. Special tokens in texts are plain text.

Defined results: null and empty texts, and texts whose tokens do not give back
a space and the text byte by byte, have zeros and an empty digest; each row is
a document, also where doc_ids are null or repeat; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

VOCABULARIES = "/opt/tokenizers"
#: Radix buckets: the low six bits of the B id.
BUCKETS = 64
_SHIFT = 28  # a pair's key: bucket, B id, A id
_LOW = (1 << _SHIFT) - 1
_ROW = "kind int, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, bucket int, records long, run binary"


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable characters stand
    for themselves, the others for code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: Fixed value: the pattern by which byte-level vocabularies split a text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _ranked(given: dict, bytes_a: list[bytes]) -> dict[bytes, int] | None:
    """Bytes -> id, if the merges stand in the order of their ids, so that the
    ids alone tell which merge comes first."""
    model, split = given["model"], given.get("pre_tokenizer") or {}
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex") or given.get("normalizer") or model.get("type", "BPE") != "BPE":
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"]["".join(p)] for p in pairs]
    base = len(model["vocab"]) - len(made)
    if base != 256 or made != list(range(256, 256 + len(made))):
        return None
    return {bytes_a[i]: i for i in model["vocab"].values()}


class Encoders:
    """Both tokenizers, and every id's bytes. Side A runs in tiktoken, which
    takes its merges from the ids; a file whose merges are in another order, or
    that splits texts otherwise, runs in tokenizers."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        alphabet, given = byte_alphabet(), json.loads(a)
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        added = {x["content"] for x in given["added_tokens"]}
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = token.encode() if token in added else bytes(alphabet[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in known], dtype=np.int64) for known in (self.bytes_a, self.bytes_b))
        ranks = _ranked(given, self.bytes_a)
        self.fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        # An id as text with what follows it: the next id, side B, the next group.
        self.names = [f"{i}{end}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for end in ",|;"]

    def ids_a(self, text: str) -> list[int]:
        return self.fast.encode_ordinary(text) if self.fast else self.a.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str | None) -> tuple[list[int], list[int]]:
        """(A ids of " " + text, B ids of text); none where the tokens do not
        give back a space and the text."""
        if not text:
            return [], []
        want, a, b = b" " + text.encode(), self.ids_a(" " + text), self.b.encode(text)
        whole = b"".join([self.bytes_a[i] for i in a]) == want and b"".join([self.bytes_b[i] for i in b]) == want
        return (a, b) if whole else ([], [])


def aligned(enc: Encoders, a: list[int], b: list[int]) -> tuple[int, str, np.ndarray]:
    """(groups, their digest, key of each link) of a text's tokens."""
    if not a:
        return 0, "", np.zeros(0, dtype=np.int64)
    ids_a, ids_b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    ends_a, ends_b = np.cumsum(enc.size_a[ids_a]), np.cumsum(enc.size_b[ids_b])
    ends = np.zeros((2, ends_a[-1] + 1), dtype=bool)
    ends[0, ends_a] = ends[1, ends_b] = True
    last_a, last_b = ends[1, ends_a], ends[0, ends_b]
    # Tokens by group, A before B, each with the mark that follows it.
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    name = np.concatenate([3 * ids_a + last_a, 3 * ids_b + 2 * last_b])[order]
    text = "".join([enc.names[i] for i in name.tolist()])[:-1]
    return int(last_a.sum()), hashlib.sha256(text.encode()).hexdigest(), pair_key(ids_a[last_a], ids_b[last_b])


def pair_key(a, b):
    """Of ids or arrays of them: bucket, B id, A id."""
    return (b & (BUCKETS - 1)) << (2 * _SHIFT) | b << _SHIFT | a


class Run:
    """Records sorted by pair: the pairs, each with its documents and times."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, rows: np.ndarray, times: np.ndarray):
        self.keys, self.sizes, self.rows, self.times = keys, sizes, rows, times

    def packed(self) -> bytes:
        deltas = np.diff(self.keys, prepend=0), self.sizes, np.diff(self.rows, prepend=0), self.times
        head = np.array([len(self.keys), len(self.rows)], dtype=np.int64)
        # Bytes of like weight stand together, which zstd makes small.
        planes = [np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes() for x in deltas]
        return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(planes))

    @classmethod
    def unpacked(cls, blob: bytes) -> Run:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
        n, m = raw[:16].view(np.int64).tolist()
        out, at = [], 16
        for size in (n, n, m, m):
            out.append(np.ascontiguousarray(raw[at : at + 8 * size].reshape(8, size).T).view(np.int64).ravel())
            at += 8 * size
        return cls(np.cumsum(out[0]), out[1], np.cumsum(out[2]), out[3])

    def counts(self) -> np.ndarray:
        """How often each pair is linked in this run."""
        return np.add.reduceat(self.times, np.cumsum(self.sizes) - self.sizes) if len(self.keys) else np.zeros(0, dtype=np.int64)


def runs_of(keys: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, Run]]:
    """(bucket, run) of a buffer of links."""
    order = np.lexsort((rows, keys))
    keys, rows = keys[order], rows[order]
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])])
    times = np.diff(np.append(first, len(keys)))
    keys, rows = keys[first], rows[first]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes, pairs = np.diff(np.append(begin, len(keys))), keys[begin]
    bucket = pairs >> (2 * _SHIFT)
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(pairs)]
    begin = np.append(begin, len(keys))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = slice(begin[lo], begin[hi])
        yield int(bucket[lo]), Run(pairs[lo:hi], sizes[lo:hi], rows[part], times[part])


def merged(keys: list[list[int]]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Merge sorted lists of pairs: (pair, [(list, place)]) in order."""
    at = [0] * len(keys)
    heap = [(own[0], r) for r, own in enumerate(keys) if own]
    heapq.heapify(heap)
    while heap:
        key, members = heap[0][0], []
        while heap and heap[0][0] == key:
            r = heap[0][1]
            members.append((r, at[r]))
            at[r] += 1
            if at[r] < len(keys[r]):
                heapq.heapreplace(heap, (keys[r][at[r]], r))
            else:
                heapq.heappop(heap)
        yield key, members


def counted(runs: list[Run]) -> tuple[list[int], list[int]]:
    """(pairs, counts) over all runs."""
    own = [r.counts().tolist() for r in runs]
    pairs, counts = [], []
    for key, members in merged([r.keys.tolist() for r in runs]):
        pairs.append(key)
        counts.append(sum(own[r][i] for r, i in members))
    return pairs, counts


def contributions(runs: list[Run], totals: list[Run]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, links that are their B id's best, sum of counts) for the documents
    of ``runs``. With ``totals``, runs of all pairs and their counts, these
    count; else the runs are all that there is."""
    every = [*totals, *runs]
    own = [(r.counts() if k < len(totals) or not totals else np.zeros(len(r.keys), dtype=np.int64)).tolist() for k, r in enumerate(every)]
    total = [[0] * len(r.keys) for r in every]
    best = [[0] * len(r.keys) for r in every]
    side, most, open_pairs = None, 0, []

    def close() -> None:
        for count, members in open_pairs:
            for r, i in members:
                total[r][i] = count
                best[r][i] = count == most

    for key, members in merged([r.keys.tolist() for r in every]):
        if key >> _SHIFT != side:
            close()
            side, most, open_pairs = key >> _SHIFT, 0, []
        count = sum([own[r][i] for r, i in members])
        most = max(most, count)
        open_pairs.append((count, members))
    close()
    back = range(len(totals), len(every))
    rows = np.concatenate([every[k].rows for k in back])
    spread = [np.repeat(np.array([best[k], total[k]], dtype=np.int64), every[k].sizes, axis=1) * every[k].times for k in back]
    order = np.argsort(rows, kind="stable")
    rows, given = rows[order], np.hstack(spread)[:, order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    return rows[first], *np.add.reduceat(given, first, axis=1)


def encoded(docs: DataFrame, path: str = VOCABULARIES, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", buffer_links: int = 1 << 20) -> DataFrame:
    """A row of kind 0 for each document, and rows of kind 1, the runs."""
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((Path(path, a).read_bytes(), Path(path, b).read_bytes()))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoders(*files.value)
        schema = pa.schema([("kind", pa.int32()), *((n, pa.int64()) for n in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("bucket", pa.int32()), ("records", pa.int64()), ("run", pa.binary())])
        keys: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        held = 0

        def spilled() -> Iterator[pa.RecordBatch]:
            for bucket, run in runs_of(np.concatenate(keys), np.concatenate(rows)):
                yield pa.RecordBatch.from_pylist([{"kind": 1, "row": int(run.rows.min()), "bucket": bucket, "records": len(run.rows), "run": run.packed()}], schema)

        for batch in it:
            row, doc, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            out = []
            for k in range(len(row)):
                ids_a, ids_b = enc(texts[k].as_py())
                n, digest, links = aligned(enc, ids_a, ids_b)
                out.append({"kind": 0, "row": row[k], "doc_id": doc[k], "n_a": len(ids_a), "n_b": len(ids_b), "n_groups": n, "n_links": len(links), "groups_sha256": digest})
                if n:
                    keys.append(links)
                    rows.append(np.full(n, row[k], dtype=np.int64))
                    held += n
                if held >= buffer_links:
                    yield from spilled()
                    keys, rows, held = [], [], 0
            yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield from spilled()

    asked = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return asked.mapInArrow(batches, _ROW)


def _by_group(of, out: str):
    """A function of the runs and totals of each (bucket, part), which come in order."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bool, bytes]] = []
        group = None
        for b in it:
            for bucket, part, total, blob in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (bucket, part) != group:
                    yield of(group, held)
                    held = []
                group = (bucket, part)
                held.append((total, blob))
        if held:
            yield of(group, held)

    def apply(runs: DataFrame) -> DataFrame:
        return runs.select("bucket", "part", "total", "run").repartition("bucket", "part").sortWithinPartitions("bucket", "part", "total").mapInArrow(run, out)

    return apply


def _part_counts(group: tuple, held: list) -> pa.RecordBatch:
    pairs, counts = counted([Run.unpacked(blob) for _, blob in held])
    return pa.RecordBatch.from_arrays([pa.array([group[0]] * len(pairs), pa.int32()), pa.array(pairs, pa.int64()), pa.array(counts, pa.int64())], names=["bucket", "pair", "n"])


def _part_gives(group: tuple, held: list) -> pa.RecordBatch:
    runs = [[Run.unpacked(blob) for total, blob in held if total == side] for side in (False, True)]
    given = contributions(*runs) if runs[0] else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in given], names=["row", "n_best", "count_sum"])


_GIVES = "row long, n_best long, count_sum long"
counts_of_parts = _by_group(_part_counts, "bucket int, pair long, n long")
gives_of_parts = _by_group(_part_gives, _GIVES)


def _totals(counts: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(bucket, run): the counts of each bucket's pairs as runs in order."""

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            bucket, pair, n = (b.column(i).to_numpy() for i in range(3))
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            made = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                for at in range(lo, hi, block):
                    own = slice(at, min(at + block, hi))
                    flat = np.zeros(own.stop - at, dtype=np.int64)
                    made.append((int(bucket[lo]), Run(pair[own], flat + 1, flat, n[own]).packed()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int32()), pa.array([x[1] for x in made], pa.binary())], names=["bucket", "run"])

    summed = counts.groupBy("bucket", "pair").agg(F.sum("n").alias("n")).select("bucket", "pair", "n")
    return summed.sortWithinPartitions("bucket", "pair").mapInArrow(pack, "bucket int, run binary")


def align(docs: DataFrame, path: str = VOCABULARIES, bucket_records: int = 1 << 21, buffer_links: int = 1 << 20) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)
    of every row of ``docs``."""
    spark = docs.sparkSession
    made, _ = stash(encoded(docs, path, buffer_links=buffer_links))
    runs = made.where("kind = 1").select("bucket", "row", "records", "run")
    # At most a row for each of the 64 buckets.
    parts = {r["bucket"]: -(-r["n"] // bucket_records) for r in runs.groupBy("bucket").agg(F.sum("records").alias("n")).collect()}
    of = spark.createDataFrame([(b, k) for b, k in parts.items()], "bucket int, parts long")
    dealt = runs.join(F.broadcast(of), "bucket").select("bucket", F.expr("pmod(xxhash64(row), parts)").alias("part"), "parts", F.lit(False).alias("total"), "run")
    gives = gives_of_parts(dealt.where("parts = 1"))
    if any(k > 1 for k in parts.values()):
        split = dealt.where("parts > 1")
        totals = _totals(counts_of_parts(split)).join(F.broadcast(of), "bucket")
        every = totals.select("bucket", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.lit(True).alias("total"), "run")
        gives = gives.unionByName(gives_of_parts(split.drop("parts").unionByName(every)))
    summed = gives.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    numbers = made.where("kind = 0").join(summed, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return numbers.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
