"""Fingerprints and their similarity as column expressions: all JVM-side, inside code generation where Spark allows it.

A fingerprint is an array of 16 signed 64-bit words, bit b in word b / 64 at
place b % 64. Scores are 32-bit floats: a ratio is taken in double precision,
then cast, and compared with the threshold cast alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fingerprint import words

BITS, WORDS = 1024, 16


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def word(fp, i: int) -> Column:
    return F.get(col(fp), F.lit(i))


def popcount(fp) -> Column:
    """The number of set bits."""
    return reduce(Column.__add__, [F.bit_count(word(fp, i)) for i in range(WORDS)]).cast("int")


def shared_bits(a, b) -> Column:
    return reduce(Column.__add__, [F.bit_count(word(a, i).bitwiseAND(word(b, i))) for i in range(WORDS)]).cast("int")


def joint_bits(a, b) -> Column:
    return reduce(Column.__add__, [F.bit_count(word(a, i).bitwiseOR(word(b, i))) for i in range(WORDS)]).cast("int")


def ratio(shared, joint) -> Column:
    """shared / joint as a 32-bit float; 0 if joint is 0."""
    return F.coalesce(F.try_divide(col(shared).cast("double"), col(joint).cast("double")), F.lit(0.0)).cast("float")


def tanimoto(a, b) -> Column:
    return ratio(shared_bits(a, b), joint_bits(a, b))


def reaches(score, threshold) -> Column:
    """score >= threshold in 32-bit floats."""
    return col(score) >= (F.lit(threshold) if isinstance(threshold, (int, float)) else threshold).cast("float")


def tanimoto_with_threshold(a, b, threshold) -> Column:
    """struct(score, passes); two empty fingerprints have score 0 and pass no threshold."""
    score = tanimoto(a, b)
    return F.struct(score.alias("score"), ((joint_bits(a, b) > 0) & reaches(score, threshold)).alias("passes"))


def upper_bound(p, k) -> Column:
    """The most that fingerprints of p and k bits can reach."""
    p, k = col(p), col(k)
    return F.when((p == 0) | (k == 0), F.lit(0.0).cast("float")).otherwise(ratio(F.least(p, k), F.greatest(p, k)))


def active_bits(fp) -> Column:
    """The set bits, ascending, as an array of int."""
    fp = col(fp)
    return F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.get(fp, (b / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b % 64)) != 0)


def from_bits(bits) -> Column:
    """An array of bits as a fingerprint."""
    bits = col(bits)
    one = F.lit(1).cast("long")
    return F.transform(
        F.sequence(F.lit(0), F.lit(WORDS - 1)),
        lambda w: F.aggregate(F.filter(F.array_distinct(bits), lambda b: (b / 64).cast("int") == w), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", one, b % 64))),
    )


def literal(bits) -> Column:
    """Some bits, known to the driver, as a fingerprint: its words are constants in the plan, not worked out for each row."""
    return F.array(*[F.lit(w).cast("long") for w in words(bits)])


def least_shared(threshold, p) -> Column:
    """Bits that a fingerprint of p bits must share at least with one that scores ``threshold``: never more than truly needed."""
    threshold = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    return F.greatest(F.lit(1), F.ceil(threshold.cast("float").cast("double") * col(p) - F.lit(1e-4)).cast("int"))


def in_band(k, threshold, p) -> Column:
    """Whether k bits can score ``threshold`` against p bits; always at threshold 0. Wider than exact, for ties of floats."""
    threshold = (F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold).cast("float").cast("double")
    return (threshold <= 0) | ((col(k) >= threshold * col(p) - 1e-3) & (col(k) * threshold <= col(p) + 1e-3))
