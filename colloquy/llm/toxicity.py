"""Toxic spans by a linear-chain conditional random field.

Token labels come from document labels: a token of a toxic document is labelled
toxic where its word, or the beginning of it, is far more frequent in toxic documents
than in others. These document frequencies are counted over all labelled
documents that may be learned from, for the words and beginnings that the
sample below suggests.
The chain runs over whole sentences, which end after ``.``, ``!`` or ``?``, so
every token is in just one. Forward-backward gives each token's
marginal; the document's score is a logistic function of the largest and of the
sum of its marginals, and tokens with a marginal of one half or more are the
offending spans.

The model is fitted on the driver to at most about ``sample_rows`` labelled
documents of each label, picked by a hash of the id; it holds 2**16 weights.
Counting reads all texts once and shuffles a few numbers for each; scoring is
one scan of all whole texts, no shuffle.

Defined results: null and empty texts score as documents without a toxic token;
a null doc_id is never held out and has no label; a document with several label
rows counts once with the largest; with no toxic label to learn from every
score is 0; repeated rows repeat; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, held_out

BITS = 16
#: Lengths of the word beginnings that count as features, as words can be compounds.
STEMS = (3, 4, 5, 6, 7, 8)
_TOKEN = re.compile(WORD)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def tokens_of(text: str | bytes | None) -> list[bytes]:
    """The words of a text, as UTF-8; bytes split at ASCII white space only."""
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").split()


def _read(token: bytes) -> str:
    return token.decode("utf-8", "surrogatepass")


def bare(token: str) -> str:
    low = token.lower()
    return low if low.isalnum() else _EDGE.sub("", low)


def parts(token: str) -> list[str]:
    """The features of a token: the word, its ends and its shape."""
    w = bare(token)
    n = len(w)
    return ["w=" + w, "s=" + w[-3:], f"n={n if n < 8 else 8}", "c=1" if token[:1].isupper() else "c=0", *["p=" + w[:k] for k in STEMS if n > k]]


_BUCKETS = (1 << BITS) - 1
_WHOLE, _TAIL, _HEAD = zlib.crc32(b"w="), zlib.crc32(b"s="), zlib.crc32(b"p=")


def bucket(part: str) -> int:
    return 1 + zlib.crc32(part.encode("utf-8", "surrogatepass")) % _BUCKETS


def features(token: str) -> list[int]:
    """Buckets of the token's features; 0 fills up the list."""
    hashed = [bucket(x) for x in parts(token)]
    return [*hashed, *[0] * (4 + len(STEMS) - len(hashed))]


def sentences(ends: np.ndarray) -> np.ndarray:
    """Sentence starts, from flags of the tokens that end one."""
    return np.flatnonzero(np.append(True, ends[:-1])) if len(ends) else np.zeros(0, dtype=np.int64)


def _rounds(length: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(step, which pieces are longer than it), pieces by falling length."""
    order = np.argsort(-length, kind="stable")
    active = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), side="left")
    for t, k in enumerate(active):
        yield t, order[:k]


def forward_backward(unary: np.ndarray, starts: np.ndarray, move: np.ndarray, pairs: bool = False, span: int = 256):
    """Marginals of label 1 for all tokens; with ``pairs`` also the expected
    counts of the four moves and of a first token with label 1. ``unary`` is
    the score of label 1 over label 0; ``move`` holds the 2 x 2 move scores
    and the score of starting with 1.

    All chains go one step at a time together. A chain of more than ``span``
    tokens goes in pieces at once: the product of a piece's 2 x 2 moves takes a
    message across it, so the result is that of the whole chain."""
    n = len(unary)
    if not n:
        return (np.zeros(0), np.zeros((2, 2)), 0.0) if pairs else np.zeros(0)
    count = -(-np.diff(np.append(starts, n)) // span)
    opens = np.zeros(int(count.sum()), dtype=bool)
    opens[np.cumsum(count) - count] = True
    piece = np.repeat(starts, count) + span * (np.arange(len(opens)) - np.repeat(np.cumsum(count) - count, count))
    length = np.diff(np.append(piece, n))
    m, e = np.exp(move[:4].reshape(2, 2)), np.exp(np.clip(unary, -40, 40))
    a1, b1 = np.empty(n), np.empty(n)  # of label 1, where those of label 0 are 1 - a1, 1 - b1

    def onward(p: np.ndarray, at: np.ndarray) -> np.ndarray:
        zero, one = (1 - p) * m[0, 0] + p * m[1, 0], ((1 - p) * m[0, 1] + p * m[1, 1]) * e[at]
        return one / (zero + one)

    def forward(which: np.ndarray, before: np.ndarray | None) -> None:
        for t, of in _rounds(length[which]):
            at = piece[which[of]] + t
            if t:
                a1[at] = onward(a1[at - 1], at)
            elif before is None:
                x = e[at] * np.exp(move[4])
                a1[at] = x / (1 + x)
            else:
                a1[at] = onward(before[of], at)

    forward(np.flatnonzero(opens), None)
    after = np.full(len(piece), 0.5)  # the backward message at each piece's last token
    rest = np.flatnonzero(~opens)
    if len(rest):
        across = np.tile(np.eye(2), (len(rest), 1, 1))
        for t, of in _rounds(length[rest]):
            across[of] = across[of] @ m
            across[of, :, 1] *= e[piece[rest[of]] + t, None]
            across[of] /= across[of].sum(axis=(1, 2), keepdims=True)
        before, ends = np.empty(len(rest)), {}
        for i, k in enumerate(rest.tolist()):
            before[i] = a1[piece[k] - 1] if opens[k - 1] else ends[k - 1]
            row = np.array([1 - before[i], before[i]]) @ across[i]
            ends[k] = row[1] / row.sum()
        for i in range(len(rest) - 1, -1, -1):
            k = rest[i]
            column = across[i] @ np.array([1 - after[k], after[k]])
            after[k - 1] = column[1] / column.sum()
        forward(rest, before)
    b1[piece + length - 1] = after
    for t, of in _rounds(length):
        if t:
            at = piece[of] + length[of] - t
            q = b1[at]
            zero, one = (1 - q) * m[0, 0] + q * e[at] * m[0, 1], (1 - q) * m[1, 0] + q * e[at] * m[1, 1]
            b1[at - 1] = one / (zero + one)
    on, off = a1 * b1, (1 - a1) * (1 - b1)
    marginal = on / (on + off)
    if not pairs:
        return marginal
    later = np.ones(n, dtype=bool)
    later[starts] = False
    at = np.flatnonzero(later)
    p, q, g = a1[at - 1], b1[at], e[at]
    cells = np.array([[(1 - p) * m[0, 0] * (1 - q), (1 - p) * m[0, 1] * g * q], [p * m[1, 0] * (1 - q), p * m[1, 1] * g * q]])
    cells /= cells.sum(axis=(0, 1))
    return marginal, cells.sum(axis=2), float(marginal[starts].sum())


class _Vocabulary:
    """Tokens by number, each with its features, or its score where weights are
    given, and whether it ends a sentence."""

    def __init__(self, weights: np.ndarray | None = None, most: int = 500_000):
        self.number: dict[bytes, int] = {}
        self.rows: list[list[int]] = []
        self.unary, self.ends = array("d"), bytearray()
        self.weights, self.most = weights, most
        if weights is not None:
            self.table = weights.tolist()
            self.shape = [[self.table[bucket(f"n={n}")] + self.table[bucket(f"c={c}")] for c in (0, 1)] for n in range(9)]

    def tokens(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > self.most:  # only spares work
            self.__init__(self.weights, self.most)
        number = self.number
        found = [number.get(w, -1) for w in words]
        if -1 in found:
            for i, k in enumerate(found):
                if k < 0:
                    found[i] = self._add(words[i])
        return np.array(found, dtype=np.int64)

    def _add(self, word: bytes) -> int:
        k = self.number.setdefault(word, len(self.number))
        if k == len(self.ends):
            self.ends.append(word.endswith((b".", b"!", b"?")))
            if self.weights is None:
                self.rows.append(features(_read(word)))
            else:
                self.unary.append(self._score(_read(word)))
        return k

    def _score(self, word: str) -> float:
        """The sum of the weights of ``features``; a checksum goes on from one
        beginning of the word to the next."""
        table, crc32, w = self.table, zlib.crc32, bare(word)
        n, raw = len(w), w.encode("utf-8", "surrogatepass")
        plain = raw if len(raw) == n else None
        tail = raw[-3:] if plain else w[-3:].encode("utf-8", "surrogatepass")
        total = table[1 + crc32(raw, _WHOLE) % _BUCKETS] + table[1 + crc32(tail, _TAIL) % _BUCKETS] + self.shape[min(n, 8)][word[:1].isupper()]
        crc, last, left = _HEAD, 0, len(STEMS)
        for k in STEMS:
            if n <= k:
                break
            crc = crc32(plain[last:k] if plain else w[last:k].encode("utf-8", "surrogatepass"), crc)
            total += table[1 + crc % _BUCKETS]
            last, left = k, left - 1
        return total + left * table[0]

    def ending(self, k: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.ends, dtype=bool)[k]

    def scores(self, k: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.unary, dtype=np.float64)[k]


def stems(word: str) -> list[str]:
    """The word and its beginnings of four letters or more, marked as such."""
    return [word, *(word[:n] + "-" for n in STEMS if 4 <= n < len(word))]


def suggested(texts: list[str], labels: np.ndarray, least: int = 3, ratio: float = 4.0) -> list[str]:
    """Words and beginnings that ``least`` toxic documents of the sample hold,
    at ``ratio`` times the rate of the others: much looser than what decides."""
    by = (Counter(), Counter())
    for t, y in zip(texts, labels, strict=True):
        by[int(y)].update({x for w in {bare(_read(w)) for w in set(tokens_of(t))} if w for x in stems(w)})
    n0, n1 = max(int((labels == 0).sum()), 1), max(int((labels == 1).sum()), 1)
    return sorted(x for x, c in by[1].items() if c >= least and c / n1 >= ratio * (by[0][x] + 0.5) / n0)


def toxic_words(docs: DataFrame, known: DataFrame, names: list[str], n0: int, n1: int, least_gain: float = 22.0, least_ratio: float = 8.0) -> set[str]:
    """Those of ``names`` whose document frequency over all labelled documents
    ties them to toxic ones: by the likelihood ratio and by the ratio of the
    two rates. ``docs`` (doc_id, text), ``known`` (doc_id, toxic) with ``n1``
    toxic rows and ``n0`` others. A text becomes the few numbers of the names
    that it holds before it meets its label."""
    shared = docs.sparkSession.sparkContext.broadcast({x: i for i, x in enumerate(names)})

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seen, none = shared.value, {}, ()
        heads = {x[:4] for x in number}
        for b in it:
            found = []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                here: set[int] = set()
                for token in set(tokens_of(t)):
                    if (got := seen.get(token)) is None:
                        w = bare(_read(token))
                        got = seen[token] = [number[x] for x in stems(w) if x in number] if w[:4] in heads else none
                    if got:
                        here.update(got)
                found.append(list(here))
                if len(seen) > 500_000:
                    seen.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "held"])

    held = docs.where(~held_out()).mapInArrow(batches, "doc_id long, held array<int>").where(F.size("held") > 0)
    each = held.join(known, "doc_id").select((F.col("toxic") == 1).alias("bad"), F.explode("held").alias("i"))
    out = set()
    for r in each.groupBy("i").agg(F.count_if("bad").alias("c1"), F.count_if(~F.col("bad")).alias("c0")).collect():
        c0, c1 = r["c0"], r["c1"]
        if c1 and c1 / n1 >= least_ratio * (c0 + 0.5) / n0:
            rate = (c0 + c1) / (n0 + n1)
            if 2 * (c1 * np.log(c1 / (n1 * rate)) + (c0 * np.log(c0 / (n0 * rate)) if c0 else 0.0)) >= least_gain:
                out.add(names[r["i"]])
    return out


def fit_chain(texts: list[str], labels: np.ndarray, words: set[str], rounds: int = 40, rate: float = 0.2, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(weights, moves) of greatest conditional likelihood, by Adam."""
    vocabulary, number, tagged, first, at = _Vocabulary(most=1 << 62), [], [], [], 0
    for t, y in zip(texts, labels, strict=True):
        tokens = tokens_of(t)
        k = vocabulary.tokens(tokens)
        starts = sentences(vocabulary.ending(k)) if len(k) else np.zeros(0, dtype=np.int64)
        number.append(k)
        tagged.append(np.array([bool(y) and not words.isdisjoint(stems(bare(_read(w)))) for w in tokens], dtype=bool))
        first.append(starts + at)
        at += len(k)
    k, y, first = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (number, tagged, first))
    y = y.astype(float)
    weights, move = np.zeros(1 << BITS), np.zeros(5)
    if not len(k):
        return weights, move
    rows = np.array(vocabulary.rows)
    n = len(k)
    later = np.ones(n, dtype=bool)
    later[first] = False
    at = np.flatnonzero(later)
    seen = np.array([[((y[at - 1] == i) & (y[at] == j)).sum() for j in (0, 1)] for i in (0, 1)], dtype=float)
    mean_w, mean_m, var_w, var_m = np.zeros_like(weights), np.zeros(5), np.zeros_like(weights), np.zeros(5)
    tags = np.bincount(k, weights=y, minlength=len(rows))
    for turn in range(1, rounds + 1):
        unary = weights[rows].sum(axis=1)[k]
        p, cells, start = forward_backward(unary, first, move, pairs=True)
        slack = tags - np.bincount(k, weights=p, minlength=len(rows))
        grad_w = np.bincount(rows.ravel(), weights=np.repeat(slack, rows.shape[1]), minlength=len(weights)) - ridge * n * weights
        grad_m = np.append((seen - cells).ravel(), y[first].sum() - start) - ridge * n * move
        for grad, mean, var, what in ((grad_w, mean_w, var_w, weights), (grad_m, mean_m, var_m, move)):
            mean += 0.1 * (grad - mean)
            var += 0.01 * (grad * grad - var)
            what += rate * (mean / (1 - 0.9**turn)) / (np.sqrt(var / (1 - 0.99**turn)) + 1e-8)
    return weights, move


def summary(marginals: np.ndarray) -> tuple[float, float]:
    top = float(marginals.max()) if len(marginals) else 0.0
    top = min(max(top, 1e-6), 1 - 1e-6)
    return float(np.log(top / (1 - top))), float(np.log1p(marginals[marginals > 0.05].sum()))


def fit_document(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton's method: bias, largest, sum."""
    x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(3)
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
        w += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 1000) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(chain weights, moves, document weights); None if nothing is toxic."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1):
        return None
    share = F.when(F.col("toxic") == 1, min(1.0, sample_rows / counts[1])).otherwise(min(1.0, sample_rows / max(counts.get(0, 0), 1)))
    ticket = F.expr("pmod(xxhash64(doc_id, 'toxic'), 1000000) / 1000000.0D")
    # At most 8 * sample_rows ids: a few hundred kilobytes to broadcast.
    picked = F.broadcast(known.where(ticket < share).orderBy("doc_id").limit(8 * sample_rows))
    texts_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = texts_of.join(picked, "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id", "text").limit(16 * sample_rows)
    got = sample.toPandas().fillna({"text": ""}).sort_values(["doc_id", "text"], ignore_index=True)
    texts, y = got["text"].tolist(), (got["toxic"].to_numpy() == 1).astype(float)
    if not y.any():  # no document has a toxic label
        return None
    later = np.arange(len(texts)) % 4 == 3
    if not y[~later].any() or not y[later].any():
        later = np.zeros(len(texts), dtype=bool)
    chain = [i for i in range(len(texts)) if not later[i]]
    words = toxic_words(texts_of, known, suggested(texts, y), max(sum(n for k, n in counts.items() if k != 1), 1), counts[1])
    weights, move = fit_chain([texts[i] for i in chain], y[chain], words)
    vocabulary, x = _Vocabulary(weights), []
    for t in texts:
        p, _ = _marginals([tokens_of(t)], vocabulary, move)
        x.append(summary(p))
    return weights, move, fit_document(np.array(x), y)


def _marginals(docs: list[list[bytes]], vocabulary: _Vocabulary, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all tokens of ``docs`` in a row, and where each begins."""
    first = np.cumsum([0, *map(len, docs)])
    k = vocabulary.tokens([w for d in docs for w in d])
    if not len(k):
        return np.zeros(0), first
    ends, unary = vocabulary.ending(k), vocabulary.scores(k)
    begin = first[1:-1]
    ends[begin[begin > 0] - 1] = True  # no sentence crosses documents
    return forward_backward(unary, sentences(ends), move), first


def _judge(texts: pa.Array, model: tuple, vocabulary: _Vocabulary) -> Iterator[tuple[float, list]]:
    """(score, spans) of each text, about half a million bytes at a time."""
    held, size = [], 0
    raw = texts.cast(pa.binary())
    for i in range(len(raw)):
        held.append(raw[i].as_py() or b"")
        size += len(held[-1])
        if size < 500_000 and i + 1 < len(raw):
            continue
        p, first = _marginals([tokens_of(t) for t in held], vocabulary, model[1])
        for k, t in enumerate(held):
            own = p[first[k] : first[k + 1]]
            x = model[2][0] + np.dot(model[2][1:], summary(own))
            hit = np.flatnonzero(own >= 0.5)
            places = [m.span() for m in _TOKEN.finditer(_read(t))] if len(hit) else []
            spans = [{"start": places[h][0], "end": places[h][1], "marginal": float(own[h])} for h in hit]
            yield float(1 / (1 + np.exp(-np.clip(x, -30, 30)))), spans
        held, size = [], 0


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = 1000) -> DataFrame:
    """(doc_id, held_out, score, spans): spans are (start, end, marginal) in
    code points, end exclusive, of the tokens tagged toxic."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary(model.value[0]) if model.value else None
        for b in it:
            found = list(_judge(b.column(2), model.value, vocabulary)) if model.value else [(0.0, [])] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], span)], names=["doc_id", "held_out", "score", "spans"])

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return asked.mapInArrow(batches, "doc_id long, held_out boolean, score double, spans array<struct<start:long,end:long,marginal:double>>")


def keep_clean(docs: DataFrame, labels: DataFrame, most: float = 0.5, sample_rows: int = 1000) -> DataFrame:
    """The rows of ``docs``, all columns, that score under ``most``. Each row
    is judged by its own text where it is read; nothing is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows))
    at = docs.columns.index("text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary(model.value[0]) if model.value else None
        for b in it:
            yield b.filter(pa.array([s < most for s, _ in _judge(b.column(at), model.value, vocabulary)], pa.bool_())) if model.value else b

    return docs.mapInArrow(batches, docs.schema)
