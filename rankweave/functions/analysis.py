"""Tokenisation and the term resolution of queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits, lower-cased after they are taken out."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def split_terms(text: Column) -> Column:
    """Terms given as one string: split at white space."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")


def terms_or_tokens(terms: Column, text: Column) -> Column:
    return F.coalesce(terms, tokenize(text))


def scorer_name(name: str) -> str:
    import re

    return re.sub(r"[-\s]+", "_", name.strip().lower())
