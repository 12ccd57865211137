"""Loose join keys for names. The two keys differ on purpose; never mix them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import col

# Generation suffixes dropped from names, in this order.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")


def word_key(name: Column | str) -> Column:
    """Lower case, suffix words dropped anywhere, letters and single spaces kept."""
    alternatives = "|".join(SUFFIXES)
    bare = F.regexp_replace(F.lower(col(name)), rf"\b({alternatives})\b\.?", "")
    letters = F.regexp_replace(bare, "[^a-z ]", "")
    return F.trim(F.regexp_replace(letters, " +", " "))


def letter_key(name: Column | str) -> Column:
    """Lower case, trailing suffixes stripped in turn, only letters kept; null becomes empty."""
    key = F.lower(F.coalesce(col(name), F.lit("")))
    for suffix in SUFFIXES:
        key = F.regexp_replace(key, rf" {suffix}\.?$", "")
    return F.regexp_replace(key, r"[^\p{L}]", "")


def defence_name(name: Column | str, position: Column | str) -> Column:
    """One spelling for team defences: ``<TEAM> DST``; other names are untouched."""
    n = col(name)
    bare = (col(position) == "DEF") & ~F.upper(n).endswith(" DST")
    return F.when(bare, F.concat(n, F.lit(" DST"))).otherwise(n)
