"""Constants of the engine, in one place; all are parameters of the operators."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    context_tokens: int = 900
    high_ratio: float = 0.8
    low_ratio: float = 0.5
    chars_per_token: int = 4
    hot_messages: int = 50
    hot_seconds: int = 86400
    cold_messages: int = 20
    tool_rounds: int = 5
    result_chars: int = 4000
    recall_limit: int = 10
    rerank_limit: int = 5
    recall_score: float = 0.6
    page_size: int = 20
    most_page_size: int = 100
    default_model: str = "gpt-4o-mini"
    standard_models: tuple[str, ...] = ("gpt-4o-mini", "glm-4")
    advanced_models: tuple[str, ...] = ("gpt-4o", "deepseek-v3")

    @property
    def high_budget(self) -> int:
        return int(self.context_tokens * self.high_ratio)

    @property
    def low_budget(self) -> int:
        return int(self.context_tokens * self.low_ratio)


SETTINGS = Settings()


def configured(spark, prefix: str = "spark.colloquy.") -> Settings:
    """Settings that the session names, such as ``spark.colloquy.hotMessages``."""
    laid: dict = {}
    for f in fields(Settings):
        head, *rest = f.name.split("_")
        value = spark.conf.get(prefix + head + "".join(x.capitalize() for x in rest), None)
        if value is not None:
            old = getattr(SETTINGS, f.name)
            laid[f.name] = tuple(x.strip() for x in value.split(",")) if isinstance(old, tuple) else type(old)(value)
    return merged(laid)


def overlaid(base, *over):
    """Maps laid over each other by key, the last one winning; nulls count as empty."""
    from pyspark.sql import functions as F

    none = F.create_map().cast("map<string,string>")

    def lay(own, some):
        return F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(some, k)), some)

    out = F.coalesce(base, none)
    for one in over:
        out = lay(out, F.coalesce(one, none))
    return out


def merged(*sources: dict) -> Settings:
    """Settings with the given sources laid over the defaults, the last one
    winning; unknown keys are ignored."""
    known = {f.name for f in fields(Settings)}
    laid: dict = {}
    for source in sources:
        laid |= {k: v for k, v in source.items() if k in known}
    return replace(SETTINGS, **laid)
