"""String helpers for titles, sources and keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source weights, first match in this order wins.
SOURCE_WEIGHTS = {
    "reuters": 1.0,
    "bloomberg": 1.0,
    "wall street journal": 0.9,
    "wsj": 0.9,
    "financial times": 0.9,
    "ft": 0.9,
    "new york times": 0.9,
    "nyt": 0.9,
    "associated press": 0.9,
    "ap news": 0.9,
    "cnbc": 0.8,
    "bbc": 0.8,
    "al jazeera": 0.8,
    "cnn": 0.7,
    "yahoo finance": 0.6,
    "yahoo": 0.5,
    "the motley fool": 0.4,
    "substack": 0.5,
    "cryptocompare": 0.6,
    "coindesk": 0.7,
    "cointelegraph": 0.6,
}
DEFAULT_SOURCE_WEIGHT = 0.5

# A title holding any of these is relevant to the macro picture.
RELEVANCE_KEYWORDS = [
    "oil", "crude", "petroleum", "fuel", "energy",
    "inflation", "cpi", "consumer price", "prices",
    "fed", "federal reserve", "fomc", "powell", "rate hike", "rate cut",
    "monetary policy", "interest rate",
    "war", "conflict", "iran", "military", "sanctions", "hormuz", "missile",
    "china", "tariff", "trade war", "trade deal",
    "economy", "recession", "gdp", "unemployment", "jobs report",
    "yield", "bond", "treasury", "debt crisis",
    "bank failure", "market crash", "systemic",
    "opec", "saudi", "gas price",
]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_title(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9 ]", ""))


def title_hash(c: str | Column) -> Column:
    """Hex SHA-1 of the normalised title."""
    return F.sha1(norm_title(c))


def matches_any(c: str | Column, keywords: list[str] = RELEVANCE_KEYWORDS) -> Column:
    return F.lower(_col(c)).rlike("|".join(re.escape(k) for k in keywords))


def source_weight(
    c: str | Column, weights: dict[str, float] = SOURCE_WEIGHTS, default: float = DEFAULT_SOURCE_WEIGHT
) -> Column:
    """Weight of the first listed name contained in the source."""
    text = F.lower(_col(c))
    out = None
    for name, weight in weights.items():
        hit = text.contains(name)
        out = F.when(hit, F.lit(weight)) if out is None else out.when(hit, F.lit(weight))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def suffix(c: str | Column, separator: str = "_") -> Column:
    """The part of a partition key after its last separator."""
    return F.element_at(F.split(_col(c), re.escape(separator)), -1)
