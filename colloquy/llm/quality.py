"""Quality rules: a threshold table compiled into one Spark projection.

Everything is built-in Spark functions over one row at a time: no shuffle, no
user function, no cut of the text. Counts of a document need only that
document, so the work is one scan however large the table or hot a source.

Defined results: null text counts as the empty text (no word: base_failed);
null doc_id is carried through; repeated rows give repeated results; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, SPACES, text_or_empty

#: Frequent function words of four languages.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "that", "is", "for", "with", "was", "are", "be", "have", "this", "it", "on"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "qui", "dans", "pour", "est", "sur"],
    "de": ["der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "des", "nicht", "ein", "eine", "als", "dem", "auf"],
    "es": ["el", "los", "las", "y", "del", "se", "por", "con", "para", "una", "su", "al", "es", "lo", "como", "no"],
}


@dataclass(frozen=True)
class Rule:
    """A named ratio or length over the measured columns, with its bounds."""

    name: str
    value: str
    least: float | None = None
    most: float | None = None


#: The threshold table of the production query.
RULES = (
    Rule("max_words", "n_words", most=1000000),
    Rule("mean_word_length", "word_chars / n_words", least=2.0, most=12.0),
    Rule("symbol_ratio", "n_symbols / n_words", most=0.5),
    Rule("stop_words", "n_stop_words", least=2),
    Rule("stop_word_ratio", "n_stop_words / n_words", least=0.01),
    Rule("bullet_lines", "n_bullet_lines / n_lines", most=0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines / n_lines", most=0.3),
    Rule("duplicate_lines", "n_dup_lines / n_lines", most=0.5),
)


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, counts) of every whole text, by built-in functions only."""
    stop_words = sorted({w for words in STOP_WORDS.values() for w in words})
    trimmed = docs.select("doc_id", text_or_empty().alias("t"), F.btrim(text_or_empty(), F.lit(SPACES)).alias("trimmed"))
    split = trimmed.select(
        "doc_id",
        F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", GAP)).alias("words"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
    )
    counted = split.select(
        "doc_id",
        "words",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: F.ltrim(x).rlike(r"^[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("words", lambda x: F.lower(x).isin(stop_words))).cast("long").alias("n_stop_words"),
    )
    kept = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_bullet_lines", "n_ellipsis_lines", "n_stop_words"]
    windows = counted.select(
        *kept,
        F.when(F.col("n_words") < 3, F.array().cast("array<bigint>"))
        .otherwise(
            F.transform(
                F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")),
                lambda i: F.xxhash64(F.col("words")[i], F.col("words")[i + 1], F.col("words")[i + 2]),
            )
        )
        .alias("windows"),
    )
    # Sorted (hash, position) puts equal windows side by side: n log n even
    # where the whole text repeats. Most texts repeat nothing and skip it.
    ranked = windows.select(
        *kept,
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("ranked"),
    )
    starts = ranked.select(
        *kept,
        F.sort_array(
            F.filter(
                F.transform(
                    "ranked",
                    lambda x, j: F.when(
                        (x["h"] == F.get("ranked", j - 1)["h"]) | (x["h"] == F.get("ranked", j + 1)["h"]), x["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            )
        ).alias("starts"),
    )
    # Three words from each start, less what the next start covers again.
    return starts.select(
        *kept,
        F.coalesce(
            F.aggregate(
                F.transform("starts", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("starts", k + 1) - i, F.lit(3)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
            F.lit(0).cast("long"),
        ).alias("n_repeat_words"),
    )


def verdict(rule: Rule) -> Column:
    """True where the rule fails; a ratio over nothing does not fail."""
    value = F.expr(rule.value.replace(" / ", " / nullif(") + (", 0)" if " / " in rule.value else "")).cast("double")
    failed = F.lit(False)
    if rule.least is not None:
        failed = failed | (value < rule.least)
    if rule.most is not None:
        failed = failed | (value > rule.most)
    return F.coalesce(failed, F.lit(False))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Counts, base_failed, kept, and the names of the rules that failed."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(verdict(r), F.lit(r.name)) for r in rules]))
    judged = measure(docs).select("*", base.alias("base_failed"), failed.alias("failed"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"),
        F.array_join("failed", ",").alias("failed_rules"),
    )


def oracle() -> str:
    """DuckDB SQL for the production query's rows."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))
    names = []
    for r in RULES:
        value = r.value.replace(" / ", " * 1.0 / nullif(") + (", 0)" if " / " in r.value else "")
        bounds = " OR ".join(
            ([f"{value} < {r.least}"] if r.least is not None else []) + ([f"{value} > {r.most}"] if r.most is not None else [])
        )
        names.append(f"CASE WHEN {bounds} THEN '{r.name}' END")
    return f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM t
), grams AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT r, sum(least(3, coalesce(nxt - i, 3))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
         len(list_filter(ls, lambda x: regexp_matches(ltrim(x), '^[-*•]'))) AS n_bullet_lines,
         len(list_filter(ls, lambda x: regexp_matches(rtrim(x), '(\\.\\.\\.|…)$'))) AS n_ellipsis_lines,
         len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered c USING (r)
), j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         concat_ws(',', {", ".join(names)}) AS failed_rules
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM j"""
