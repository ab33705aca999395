"""Scalar Column expressions of the domain."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlens.catalogs import domain


def literal_map(mapping: dict) -> Column:
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.create_map(*pairs)


def extension(path: Column) -> Column:
    """Last extension with its dot, case kept; empty when there is none."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def language_of(path: Column) -> Column:
    return F.element_at(literal_map(domain.EXTENSION_LANGUAGE), extension(path))


def is_supported(path: Column) -> Column:
    endings = "|".join(e[1:] for e in domain.EXTENSION_LANGUAGE)
    return path.rlike(rf"\.(?:{endings})$")


def in_skipped_directory(path: Column) -> Column:
    """True when any directory of the path (not the file name) is pruned."""
    names = "|".join(re.escape(d) for d in domain.SKIP_DIRS)
    return path.rlike(rf"(?:^|/)(?:{names})/")


def repo_key(url: Column, mode: str = "fixed") -> Column:
    """``owner__name``. Parity mode drops ``.git`` anywhere in the URL, not
    just as its suffix."""
    trimmed = F.rtrim(url, F.lit("/"))
    if mode == "parity":
        trimmed = F.replace(trimmed, F.lit(".git"), F.lit(""))
    else:
        trimmed = F.regexp_replace(trimmed, r"\.git$", "")
    parts = F.split(trimmed, "/")
    owner = F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2)))
    return F.concat_ws("__", F.coalesce(owner, F.lit("unknown")), F.element_at(parts, -1))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)


def file_label(basic: Column, advanced: Column) -> Column:
    return (
        F.when(basic & advanced, "Mixed")
        .when(advanced, "Advanced")
        .when(basic, "Basic")
        .otherwise("None")
    )


def recommendation(label: Column) -> Column:
    known = F.element_at(literal_map(domain.RECOMMENDATION), label)
    return F.coalesce(known, F.lit(domain.RECOMMENDATION["None"]))


def format_rate(rate: Column) -> Column:
    """``0.955`` to ``"95.50%"``, ties to even."""
    return F.format_string("%.2f%%", F.bround(rate * 100, 2))


def parse_rate(text: Column) -> Column:
    """``"95.50%"`` to 95.5; anything else to null."""
    return F.rtrim(text, F.lit("%")).try_cast("double")


def list_or_none(values: Column) -> Column:
    return F.when(F.size(values) == 0, domain.NONE_DETECTED).otherwise(F.array_join(values, "; "))


def category_or_none(label: Column) -> Column:
    return F.coalesce(label, F.lit("None"))


def language_group(languages: Column) -> Column:
    """A repository's one language, or ``Multiple``."""
    return (
        F.when(F.size(languages) > 1, domain.MULTIPLE)
        .when(F.size(languages) == 1, display_language(F.element_at(languages, 1)))
    )


def language_join_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def display_language(name: Column) -> Column:
    known = F.try_element_at(literal_map(domain.LANGUAGE_DISPLAY), language_join_key(name))
    return F.coalesce(known, F.trim(name))


def is_permanent_fetch_error(text: Column) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [lowered.contains(p) for p in domain.PERMANENT_FETCH_ERRORS])


def star_bucket(stars: Column) -> Column:
    chain = F
    for label, lowest in domain.STAR_BUCKETS:
        chain = chain.when(stars >= lowest, label)
    return chain


def share(part: Column, whole: Column, digits: int = 2, rounding: str = "half_up") -> Column:
    """Percentage, null of nothing. ``half_even`` reproduces array-library
    rounding."""
    rounder = F.bround if rounding == "half_even" else F.round
    return rounder(F.try_divide(part * F.lit(100.0), whole), digits)


def effect_size(v: Column) -> Column:
    return (
        F.when(v < 0.1, "negligible")
        .when(v < 0.3, "small to medium")
        .when(v < 0.5, "medium to large")
        .otherwise("large")
    )


def decision(p_value: Column) -> Column:
    return (
        F.when(p_value < 0.001, "highly significant")
        .when(p_value < 0.05, "significant")
        .otherwise("not significant")
    )
