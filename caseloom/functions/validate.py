"""Structural validity of field values, as predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a destroyed value carries. Fixed values.
DAMAGE_WORDS = ("cut out", "whiteout", "washed", "blank", "torn", "illegible", "obscured", "lost", "unreadable", "redacted", "missing")


def looks_damaged(c: Column) -> Column:
    """A damage word anywhere, a bracket opened at the start that nothing closes, or too few letters and digits for the length."""
    low = F.lower(c)
    word = F.exists(F.array(*map(F.lit, DAMAGE_WORDS)), lambda w: F.contains(low, w))
    opened = F.substring(c, 1, 1).isin("[", "{", "(") & ~c.rlike(r"[\])}]")
    solid = F.length(F.regexp_replace(c, r"[^A-Za-z0-9]", ""))
    return word | opened | (solid < F.greatest(F.lit(1), F.floor(F.length(c) / 3)))


def date_of(c: Column) -> Column:
    """A date, or null unless the text is exactly yyyy-mm-dd and on the calendar."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def valid_date(c: Column) -> Column:
    return F.coalesce(F.year(date_of(F.trim(c))).between(2000, 2099), F.lit(False))


def valid_sponsor(c: Column) -> Column:
    return F.trim(c).rlike(r"^SPN-\d{4}$")


def valid_name(c: Column) -> Column:
    """Two words or more of letters, apostrophes and hyphens, each beginning with a letter; 3 to 60 characters."""
    words = F.split(F.trim(c), " ")
    return F.length(F.trim(c)).between(3, 60) & (F.size(words) > 1) & F.forall(words, lambda w: w.rlike(r"^[A-Za-z][A-Za-z'\-]*$"))


def valid_for_field(field: Column, c: Column) -> Column:
    c = F.trim(c)
    letters = F.length(F.regexp_replace(c, r"[^A-Za-z]", ""))
    solid = F.length(F.regexp_replace(c, r"[^A-Za-z0-9]", ""))
    out = (
        F.when(field == "arrival_date", valid_date(c))
        .when(field == "sponsor_id", valid_sponsor(c))
        .when(field == "applicant_name", valid_name(c))
        .when(field == "fee_status", letters >= 3)
        .otherwise(solid >= 2)
    )
    return F.coalesce(out & (c != "") & ~looks_damaged(c), F.lit(False))
