"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained by follow-the-regularised-leader with elastic-net
penalties, its probabilities calibrated by a temperature.

Document frequencies cover every training document. The regression is fitted on
a sample of at most about ``sample_rows`` of them, shared evenly among the
languages by a hash of id and text, and held in 2**15 buckets with a row of
weights for each language; what is collected and broadcast does not grow with
the corpus. More than ``most_langs`` languages are an error, none is left out.
Prediction is one scan, no shuffle.

Defined results: null text, or text without a letter, is ``und`` with score 0,
as is every text where no language was learned; a null doc_id is never held
out; repeated rows repeat; extra columns are ignored; an empty table gives an
empty result. Rows with a null language teach nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

BITS = 15
_SIZE = 1 << BITS
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_LETTER = re.compile(r"[^\W\d_]")  # also fits some numbers, such as a half


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code points to lower case; what is no letter becomes a space."""
    if not _FOLD:
        low = [ord(chr(c).lower()[0]) if not 0xD800 <= c < 0xE000 and chr(c).isalpha() else 32 for c in range(0x10000)]
        _FOLD.append(np.array(low, dtype=np.uint32))
    return _FOLD[0]


def buckets(text: str) -> np.ndarray:
    """The bucket of every 1-, 2- and 3-gram of the whole text, in a row."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    folded = np.where(points < 0x10000, _fold()[np.minimum(points, 0xFFFF)], points)
    folded = np.concatenate([[np.uint32(32)], folded, [np.uint32(32)]])
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    c = folded[keep].astype(np.uint64)
    out, h = [], c
    for n in range(1, 4):
        if n > 1:
            if len(c) < n:
                break
            h = h[:-1] * _ODD[0] + c[n - 1 :]
        out.append((((h ^ np.uint64(n)) * _ODD[1]) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out)


def _frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, over all training documents."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(_SIZE + 1, dtype=np.int64), 0
        for b in it:
            for t in b.column(0):
                if t.is_valid:
                    seen = np.zeros(_SIZE, dtype=bool)
                    seen[buckets(t.as_py())] = True
                    held[:_SIZE] += seen
                    n += 1
        held[_SIZE] = n
        k = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(held[k])], names=["k", "n"])

    got = train.select("text").mapInArrow(batches, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(_SIZE + 1, dtype=np.int64)
    out[got["k"].to_numpy()] = got["n"].to_numpy()
    return out[:_SIZE], int(out[_SIZE])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, rounds: int = 2, alpha: float = 0.5, beta: float = 1.0, lasso: float = 0.3, ridge: float = 0.01) -> np.ndarray:
    """(classes, buckets + 1) weights; the last column is the bias."""
    z, n = np.zeros((classes, _SIZE + 1)), np.zeros((classes, _SIZE + 1))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= lasso, 0.0, (np.sign(z) * lasso - z) / ((beta + np.sqrt(n)) / alpha + ridge))

    for turn in range(rounds):
        for i in np.random.default_rng(turn).permutation(len(rows)):
            k, x, y = rows[i]
            w = weights(z[:, k], n[:, k])
            s = w @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = p[:, None] * x
            before = n[:, k]
            after = before + g * g
            z[:, k] += g - (np.sqrt(after) - np.sqrt(before)) / alpha * w
            n[:, k] = after
    return weights(z, n)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by a search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    return float(grid[int(np.argmin([loss(t) for t in grid]))])


def train(docs: DataFrame, sample_rows: int = 4000, most_langs: int = 1000) -> tuple[list[str], np.ndarray, float]:
    """(languages, weights by bucket with IDF folded in, temperature)."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most_langs + 1).collect()}
    if len(counts) > most_langs:
        raise ValueError(f"over {most_langs} values of lang to learn; most_langs may be raised, at 128 KB of weights each")
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((_SIZE + 1, 0), dtype=np.float32), 1.0
    held, n = _frequencies(rows)
    idf = np.log((1 + n) / (1 + held)) + 1
    # A fraction of each language by a hash; where repeated rows make it more, the lowest tickets.
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample_rows / len(langs) / counts[k])))])
    drawn = rows.select("doc_id", "text", "lang", F.expr("pmod(xxhash64(doc_id, text, 'sample'), 1000000) / 1000000.0D").alias("ticket"))
    sample = drawn.where(F.col("ticket") < F.element_at(share, F.col("lang"))).orderBy("ticket", "doc_id", "lang", "text").limit(4 * sample_rows)
    found = []
    for r in sample.toPandas().sort_values(["doc_id", "ticket", "lang", "text"], ignore_index=True).itertuples():
        b = buckets(r.text)
        k, c = np.unique(b, return_counts=True)
        x = np.append(30 * c / len(b) * idf[k], 1.0)
        found.append((np.append(k, _SIZE), x, langs.index(r.lang)))
    check, fit = found[::5], [f for i, f in enumerate(found) if i % 5]
    w = ftrl(fit or found, len(langs))
    t = temperature(np.array([w[:, k] @ x for k, x, _ in check]), np.array([y for _, _, y in check]))
    table = np.concatenate([30 * idf[:, None] * w[:, :_SIZE].T, w[:, _SIZE:].T]).astype(np.float32)
    return langs, table, t


def identify(docs: DataFrame, sample_rows: int = 4000, most_langs: int = 1000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample_rows, most_langs))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table, t = model.value
        for b in it:
            names, scores = [], []
            for x in b.column(2):
                text = x.as_py() or ""
                if not langs or not has_letter(text):
                    names.append("und")
                    scores.append(0.0)
                    continue
                k, s = buckets(text), np.zeros(len(langs))
                for at in range(0, len(k), 1 << 17):
                    s += table[k[at : at + (1 << 17)]].sum(axis=0, dtype=np.float64)
                s = (s / len(k) + table[_SIZE]) / t
                p = np.exp(s - s.max())
                best = int(np.argmax(p))
                names.append(langs[best])
                scores.append(float(p[best] / p.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return asked.mapInArrow(batches, "doc_id long, held_out boolean, lang_pred string, score double")
