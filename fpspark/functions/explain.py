"""What two fingerprints share, in numbers and words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import col, reaches

# Tiers by least score, and the wording of an explanation.
TIERS = ((0.7, "high"), (0.4, "moderate"), (0.2, "low but notable"))
LOWEST = "minimal"


def analysis(shared, p, k) -> list[Column]:
    """shared_bits, query_unique_bits, candidate_unique_bits and total_bits from a count and two popcounts."""
    shared, p, k = col(shared), col(p), col(k)
    return [shared.cast("int").alias("shared_bits"), (p - shared).cast("int").alias("query_unique_bits"), (k - shared).cast("int").alias("candidate_unique_bits"), (p + k - shared).cast("int").alias("total_bits")]


def similarity_tier(score) -> Column:
    out = None
    for least, name in TIERS:
        out = F.when(reaches(score, least), name) if out is None else out.when(reaches(score, least), name)
    return out.otherwise(LOWEST)


def explanation(score, shared, query_only, candidate_only) -> Column:
    """Two sentences: percentage and tier, then what each side has alone."""
    score, shared, query_only, candidate_only = map(col, (score, shared, query_only, candidate_only))
    percent = F.round((score * F.lit(100).cast("float")).cast("float")).cast("int")
    bits = lambda n: F.when(n == 1, " bit appear only in ").otherwise(" bits appear only in ")
    text = lambda n: n.cast("string")
    total = shared + query_only + candidate_only
    return F.concat(
        F.lit("This molecule shares "), text(percent), F.lit("% of its structural fingerprint with the query ("), text(shared), F.lit(" of "), text(total),
        F.lit(" total bits), indicating a "), similarity_tier(score), F.lit(" degree of structural similarity. "),
        text(query_only), bits(query_only), F.lit("the query and "), text(candidate_only), bits(candidate_only), F.lit("this molecule."),
    )
