"""Text, time and JSON expressions. All stay in the JVM but ``segmented``."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import SETTINGS

WORDS = r"[\p{L}\p{N}]+"
TOKENS = r"[\p{L}\p{N}]{2,}"


def tokens(text: Column, lower: bool = False) -> Column:
    """Words of two characters or more, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(TOKENS), F.lit(0))


def search_tokens(text: Column) -> Column:
    """The tokens joined by spaces; null for null text."""
    return F.when(text.isNotNull(), F.array_join(tokens(text), " "))


def segmented(segment: Callable[[str], list[str]]) -> Callable:
    """A hook for scripts without spaces: an Arrow-batched function that joins
    what ``segment`` returns, without pieces of one character."""

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else " ".join(w for w in segment(t) if len(w.strip()) > 1))

    return run


def _estimate(text: str) -> int:
    return len(text) // SETTINGS.chars_per_token


def counted_tokens(count: Callable[[str], int], otherwise: Callable[[str], int] = _estimate) -> Callable:
    """A hook for a real tokenizer; a text on which it fails counts as
    ``otherwise`` says, by default its characters div 4."""

    @F.pandas_udf("long")
    def run(text: pd.Series) -> pd.Series:
        def one(t: str | None) -> int:
            if not t:
                return 0
            try:
                return count(t)
            except Exception:  # noqa: BLE001  the contract of the hook
                return otherwise(t)

        return text.map(one)

    return run


def filled_tokens(token_count: Column, content: Column) -> Column:
    """A set count stays; null content counts 0, other content length div 4."""
    return F.coalesce(token_count, F.when(content.isNull(), 0).otherwise(F.floor(F.length(content) / SETTINGS.chars_per_token)).cast("long"))


def truncated(text: Column, most: int = SETTINGS.result_chars) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n...[truncated]"))).otherwise(text)


def result_line(role: Column, at: Column, content: Column) -> Column:
    return F.concat(F.lit("["), role, F.lit("] ("), iso(at), F.lit("): "), F.coalesce(content, F.lit("")))


def iso(at: Column) -> Column:
    """ISO-8601 to the second."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def time_bounds(start: Column, end: Column) -> tuple[Column, Column]:
    """Parsed bounds; an invalid start voids both, an invalid end only itself."""
    first, second = F.try_to_timestamp(start), F.try_to_timestamp(end)
    bad_start = start.isNotNull() & (start != "") & first.isNull()
    return first, F.when(~bad_start, second)


def json_arguments(text: Column) -> Column:
    """A map of a JSON object's fields; anything else gives the empty map."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def role_map(text: Column) -> Column:
    """Group to role code; one bad entry voids the whole map."""
    return F.from_json(text, "map<string,int>", {"mode": "PERMISSIVE"})


def pages(total: Column, size: Column) -> Column:
    return F.when(size == 0, 0).otherwise(F.ceil(total / size)).cast("long")


def defaulted(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def prefixed(model: Column) -> Column:
    """A model id with its provider, ``openai`` unless it names one."""
    return F.when(model.contains("/"), model).otherwise(F.concat(F.lit("openai/"), model))


#: How the first part of some model ids is written.
SPELLED = {"gpt": ("Gpt", "GPT"), "deepseek": ("Deepseek", "DeepSeek"), "glm": ("Glm", "GLM")}


def model_name(model: Column) -> Column:
    """The display name: parts capitalised, known families spelled their way,
    and for gpt a hyphen after the family."""
    plain = F.array_join(F.transform(F.split(model, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))), " ")
    out = plain
    for family, (written, wanted) in SPELLED.items():
        spelled = F.replace(plain, F.lit(written), F.lit(wanted))
        if family == "gpt":
            spelled = F.regexp_replace(spelled, "^([^ ]*) ", "$1-")
        out = F.when(model.startswith(family), spelled).otherwise(out)
    return out


def model_type(model: Column, standard: tuple[str, ...] = SETTINGS.standard_models, advanced: tuple[str, ...] = SETTINGS.advanced_models) -> Column:
    """1 standard, 2 advanced, 3 unknown."""
    return F.when(model.isin(list(standard)), 1).when(model.isin(list(advanced)), 2).otherwise(3)


def model_ratio(kind: Column) -> Column:
    return F.when(kind == 2, 10).otherwise(1)


def http_status(code: Column) -> Column:
    return F.when(code >= 50000, 500).otherwise(200)


def tool_error(kind: Column, message: Column) -> Column:
    return F.concat(F.lit("[Tool Execution Error]: "), kind, F.lit(": "), message)


def hot_key(session_id: Column, prefix: str = "hot:") -> Column:
    return F.concat(F.lit(prefix), session_id)


def envelope(code: Column, message: Column, data: Column) -> Column:
    return F.struct(code.alias("code"), message.alias("msg"), data.alias("data"))
