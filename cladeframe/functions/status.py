"""Texts of placement results and clamps of parameters."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY, RESOLUTION, UNCLASSIFIABLE, INCONCLUSIVE, ERROR = "IdentityFound", "MaxResolutionReached", "Unclassifiable", "Inconclusive", "Error"
#: Messages that results carry.
LCA_ACCEPTED = "LCA Accepted"
NO_OVERLAP = "Tree introspection not possible. Query sequence has no overlapping kmers with the reference tree"
TOO_SHORT = "The sequence does not contain enough kmers."
NO_CHILDREN = "The tree root has no children."
TOO_MANY = "Maximum number of iterations reached."


def unrelated(query: Column) -> Column:
    return F.concat(F.lit('Query sequence SequenceHeader("'), query, F.lit('") may not be related to the phylogeny'))


def code(status: Column, message: Column) -> Column:
    """The status with its message, as results show it."""
    return F.when(status == IDENTITY, status).otherwise(F.concat_ws(": ", status, message))


def clade_of(status: Column, clade_id: Column) -> Column:
    """The clade of a placement, if it has one."""
    return F.when(status.isin(IDENTITY, RESOLUTION), clade_id)


def clade_text(clade_id: Column) -> Column:
    return F.format_string("Clade: %d", clade_id)


def adherence_text(clade_id: Column, one: Column, rest: Column) -> Column:
    return F.format_string("AdherenceTest: %s - %d - %d", clade_text(clade_id), one, rest)


def first_word(text: Column) -> Column:
    """What stands before the first white space inside a text, as in a size with its unit."""
    return F.regexp_extract(text, r"^\s*(\S+)", 1)


def clamp(coverage: float | Decimal) -> float | Decimal:
    return min(1.0, max(0.0, coverage))


def expected_coverage(matched: Column, coverage: float | Decimal) -> Column:
    """Matched k-mers times coverage, rounded half up: of doubles as in the reference, where 45 * 0.7 is
    under 31.5 and gives 31, or exactly if coverage is a Decimal, where it gives 32."""
    return F.round(matched * F.lit(clamp(coverage)), 0).cast("long")
