"""URL filters: rules by host and path, then a logistic regression.

The regression sees hashed character n-grams of host and path and is trained
on the driver from a small labelled table, which is a parameter with a default
below (so its size is bounded by what the caller writes down). Its weights are
a fixed 2**14 numbers. A row needs only its own url: one scan, no shuffle.

Defined results: a null url, or one without ``://``, has empty host and path,
no rule and the model's verdict on no n-grams; repeated rows repeat;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The production rules as (verdict, rule).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: Names and paths labelled by hand for training.
BLOCKED_NAMES = (
    "spam-offers", "spam-central", "link-spam", "content-farm", "clickbait-daily", "click-through", "seo-backlinks", "traffic-boost", "popunder-net",
    "cheap-meds", "pills-online", "diet-pills", "viagra-shop", "viagra-now", "meds-direct", "discount-pharma", "rx-pharmacy", "steroids-lab", "weightloss-secret",
    "casino-royal", "online-casino", "casino-slots", "slots-online", "poker-slots", "roulette-live", "roulette-king", "blackjack-pro", "jackpot-city", "mega-jackpot", "bingo-bonus",
    "bets-club", "bets-today", "sports-bet", "betting-tips", "big-win", "lottery-win", "free-money", "free-prize", "gambling-den",
    "adult-videos", "adult-chat", "porn-tube", "porn-stars", "pornvideos", "sex-cams", "sexvideos", "nude-models", "nudes-daily", "hot-girls", "hot-dates", "singles-tonight", "local-singles", "escort-agency", "webcam-girls",
    "ads-server", "click-track", "ad-farm", "adtracker", "loan-fast", "payday-loans", "payday-cash", "quick-credit", "forex-profit", "crypto-giveaway", "bitcoin-doubler",
    "replica-watches", "cheap-replica", "fake-rolex", "warez-crack", "warez-world", "keygen-serials", "malware-drop", "phish-login", "torrent-pirate",
)
ALLOWED_NAMES = (
    "news", "daily-herald", "library", "museum", "school", "university", "garden", "weather", "recipes", "travel", "history", "science", "music", "books",
    "kitchen", "forest", "mountain", "river", "health", "city-council", "theatre", "therapy", "letters", "northern", "station", "bakery", "painting",
    "orchestra", "gazette", "village", "harbour", "research", "institute", "parliament", "football-club", "chess", "astronomy", "geology", "poetry",
    "novels", "cinema", "archive", "farmers-market", "windows", "winter", "spring", "betty-knits", "address-book", "adventure", "cheese", "trackside",
    "pillow-talk", "clinic", "observatory", "translation", "education", "action", "nation", "earth", "ocean", "birds", "hiking", "cycling", "railway",
    "bridge", "castle", "cathedral", "pottery", "weaving", "carpenter", "lantern", "compass", "journal", "quarterly", "review", "society", "academy", "college",
    "essex-county", "sussex-walks", "singer", "single-malt", "hotel-review", "photo-album", "clock-museum", "media", "medieval", "model-railway", "picnic", "jacket", "liverpool",
    "observer", "tribune", "sentinel", "lakeside", "vineyard", "meadow", "orchard", "sculpture", "folk-music", "allotment", "aquarium", "zoology", "grammar", "dictionary",
    "notebook", "parish", "volunteer",
)
PREFIXES = ("", "www.", "m.", "blog.")
SUFFIXES = (".example", ".example.com", ".example.net", ".example.org", ".com", ".net", ".org")
#: Paths that say nothing, and hosts that do not.
PATHS = ("/en/12.html", "/fr/7", "/de/301/", "/es/45", "/article/2020/01", "/", "", "/en/4418/", "/fr/905.html")
MIXED_NAMES = ("files", "portal", "pages", "my-site", "service", "home", "cloud", "users")
BLOCKED_PATHS = (
    "/casino/bonus", "/online-casino.html", "/win/casino-slots", "/buy-pills", "/cheap/pills.html", "/pills/viagra", "/viagra-online", "/shop/cheap-meds",
    "/free-money", "/payday-loan/apply", "/loans/fast", "/porn/videos", "/adult/chat", "/sex-cams/live", "/poker/free-bets", "/bets/slots",
    "/replica-watches", "/warez/crack.zip", "/torrent/pirate", "/ads/click", "/track/click.php", "/spam/offers", "/lottery-win", "/phish/login-verify",
)
ALLOWED_PATHS = (
    "/article/garden-in-spring", "/news/2021/council-vote.html", "/library/opening-hours", "/recipes/bread", "/blog/a-walk-in-the-forest", "/history/chapter-3",
    "/science/river-fish.html", "/books/review/12", "/travel/mountain-huts", "/music/concert-notes", "/museum/visit", "/school/timetable",
    "/weather/today", "/health/sleep", "/about", "/contact.html", "/docs/guide/install", "/wiki/Castle", "/events/theatre", "/en/story/7",
    "/fr/histoire/4", "/de/artikel/19", "/es/noticias/2", "/kitchen/soup", "/winter/window-boxes", "/members/address", "/photos/adventure", "/cheese/tasting",
    "/railway/track-plan", "/poetry/better-days", "/index.html", "/archive/1999",
)
BITS = 14


def labelled_urls() -> list[tuple[str, int]]:
    """The default training table. Every name stands before every suffix, the
    prefixes and neutral paths in turn, so that these tell nothing; every path
    that makes the class stands on mixed hosts of each suffix
    as well. More urls are allowed than blocked, and so is what is no url."""
    rows, n = [("", 0)] * 5, len(SUFFIXES)
    for label, names in ((1, BLOCKED_NAMES), (0, ALLOWED_NAMES)):
        for i, name in enumerate(names):
            rows += [(f"http://{PREFIXES[(i + k) % len(PREFIXES)]}{name}{SUFFIXES[k]}{PATHS[(i + 2 * k) % len(PATHS)]}", label) for k in range(n)]
    for label, paths in ((1, BLOCKED_PATHS), (0, ALLOWED_PATHS)):
        for i, path in enumerate(paths):
            rows += [(f"http://{PREFIXES[(i + k) % len(PREFIXES)]}{MIXED_NAMES[(i + k) % len(MIXED_NAMES)]}{SUFFIXES[(i + k) % n]}{path}", label) for k in range(n)]
    return rows


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min((k for k in map(path.find, "?#") if k >= 0), default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def grams(host: str, path: str, least: int = 3, most: int = 5) -> np.ndarray:
    """Buckets of the n-grams; each bucket counts once."""
    out = set()
    for mark, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        raw = part.encode("utf-8", "surrogatepass")
        seed = zlib.crc32(mark.encode())
        for n in range(least, most + 1):
            out.update(zlib.crc32(raw[i : i + n], seed) & ((1 << BITS) - 1) for i in range(len(raw) - n + 1))
    return np.fromiter(out, dtype=np.int64, count=len(out))


def fit(rows: list[tuple[str, int]], rounds: int = 1200, rate: float = 0.5, ridge: float = 3e-4) -> np.ndarray:
    """Weights, the bias last, by full-batch gradient descent."""
    seen = [grams(*split_url(url)) for url, _ in rows]
    count = np.array([len(g) for g in seen])
    of, flat = np.repeat(np.arange(len(rows)), count), np.concatenate(seen)
    value = 1 / np.sqrt(count[of])
    y = np.array([label for _, label in rows], dtype=float)
    w, bias = np.zeros(1 << BITS), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(of, weights=w[flat] * value, minlength=len(rows)) + bias)))
        slack = (p - y) / len(y) * 10
        w -= rate * (np.bincount(flat, weights=slack[of] * value, minlength=len(w)) + ridge * w)
        bias -= rate * (slack.sum() + ridge * bias)
    return np.append(w, bias)


def probability(weights: np.ndarray, host: str, path: str) -> float:
    """The model's probability that the url is to be blocked."""
    g = grams(host, path)
    return float(1 / (1 + np.exp(-(weights[g].sum() / np.sqrt(max(len(g), 1)) + weights[-1]))))


def rule_of(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, its verdict): the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        cut = text.index("/")
        fits = ((F.col("host") == text[:cut]) | F.col("host").endswith("." + text[:cut])) & F.col("path").startswith(text[cut:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labelled: list[tuple[str, int]] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): score is the model's
    probability of ``block``."""
    weights = pages.sparkSession.sparkContext.broadcast(fit(labelled_urls() if labelled is None else labelled))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, known = weights.value, {}
        for b in it:
            scores = []
            for host, path in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                key = (host, path)
                if key not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[key] = probability(w, host, path)
                scores.append(known[key])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(scores, pa.float64())], names=["page_id", "host", "path", "score"])

    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url"), F.lit(""))
    split = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.translate(F.regexp_extract(url, parts, 1), letters, letters.lower()).alias("host"),
        F.regexp_extract(url, parts, 2).alias("path"),
    )
    scored = split.mapInArrow(batches, "page_id long, host string, path string, score double")
    rule, verdict = rule_of(rules)
    model = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, model).alias("verdict"), "score")
