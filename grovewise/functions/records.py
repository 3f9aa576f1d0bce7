"""Scalar expressions on records: cleaned text, content ids, spans, classes, keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The IUPAC nucleotide letters and their complements.
IUPAC, COMPLEMENT = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"
# Least lengths of the three inner spans of a full record, of an outer one of these whose flank is
# missing, and of the second one in a partial record; digits of base 32.
FULL_FIRST, FULL_MIDDLE, FULL_SECOND, UNFLANKED, PARTIAL = 50, 140, 50, 150, 100
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def cleaned(seq: Column) -> Column:
    """Upper case, without white space (Unicode), ``-`` and ``.``."""
    return F.upper(F.regexp_replace(seq, r"(?U)[\s\-.]", ""))


def reverse_complement(seq: Column) -> Column:
    """P2."""
    return F.reverse(F.translate(seq, IUPAC, COMPLEMENT))


def content_id(seq: Column) -> Column:
    """The smaller of the hashes of both orientations of a cleaned sequence."""
    return F.least(F.sha2(seq, 256), F.sha2(reverse_complement(seq), 256))


def extract_id(seq: Column) -> Column:
    """16 hex digits of the hash of an extracted sequence."""
    return F.substring(F.sha2(F.upper(seq), 256), 1, 16)


def span_length(span: Column) -> Column:
    """Length of ``a-b``, both ends included; 0 for null, empty, ``-`` and ``None`` (P5)."""
    parts = F.split(span, "-")
    missing = span.isNull() | span.isin("", "-", "None")
    return F.when(missing, 0).otherwise(F.element_at(parts, 2).cast("int") - F.element_at(parts, 1).cast("int") + 1)


def readable(seq: Column) -> Column:
    """Only letters of the alphabet."""
    return seq.rlike(f"^[{IUPAC}]+$")


def record_class(chimeric: Column, left: Column, first: Column, middle: Column, second: Column, right: Column) -> Column:
    """``chimeric``, ``full``, ``its2`` or ``other`` by the lengths of the five spans from left to right.

    A full record has the three inner spans; where a flank is missing, the span beside it must be longer. A
    partial one has the right flank and the span beside it. Null lengths count as 0.
    """
    left, first, middle, second, right = (F.coalesce(x, F.lit(0)) for x in (left, first, middle, second, right))
    whole = (first >= FULL_FIRST) & (middle >= FULL_MIDDLE) & (second >= FULL_SECOND)
    flanked = ((left > 0) | (first >= UNFLANKED)) & ((right > 0) | (second >= UNFLANKED))
    return (
        F.when(chimeric.cast("string").isin("True", "true"), "chimeric")
        .when(whole & flanked, "full")
        .when((right > 0) & (second >= PARTIAL), "its2")
        .otherwise("other")
    )


def anchors(left: Column, right: Column) -> Column:
    """Names of the flanking parts that are present, joined by ``+``, or ``none``."""
    named = F.concat_ws("+", F.when(left > 0, "SSU"), F.when(right > 0, "LSU"))
    return F.coalesce(F.nullif(named, F.lit("")), F.lit("none"))


def without_size(header: Column) -> Column:
    """A header without its ``;size=N;``."""
    return F.regexp_replace(header, r";size=\d+;?$", "")


def size_of(header: Column) -> Column:
    """The N of ``size=N`` (P10)."""
    return F.nullif(F.regexp_extract(header, r"size=(\d+)", 1), F.lit("")).cast("int")


def tips_of_tree(newick: Column) -> Column:
    """Sorted leaf names of a Newick text (P20)."""
    return F.array_sort(F.regexp_extract_all(newick, F.lit(r"[(,]([^(),:;]+):"), 1))


def set_key(items: Column) -> Column:
    """One hash for equal sets (P18, U8): sorted distinct items."""
    return F.sha2(F.concat_ws(",", F.sort_array(F.array_distinct(items))), 256)


def tree_input(members: Column, context: Column, scaffold: Column) -> Column:
    """Members and context, sorted, then scaffold items that are not among them."""
    own = F.concat(members, F.coalesce(context, F.array().cast("array<string>")))
    return F.concat(F.array_sort(own), F.array_except(scaffold, own))


def short_id(text: Column, digits: int = 8) -> Column:
    """``XXXX-XXXX``: a text's hash in base 32, least significant digit first, cut off after ``digits`` (at most 51)."""
    whole = F.sha2(text, 256)
    signs = []
    for k in range(digits):  # eight digits to ten hex digits, from the right
        number = F.conv(F.substring(F.lpad(whole, 70, "0"), 61 - k // 8 * 10, 10), 16, 10).cast("bigint")
        signs.append(F.substring(F.lit(BASE32), F.shiftright(number, k % 8 * 5).bitwiseAND(F.lit(31)).cast("int") + F.lit(1), F.lit(1)))
    return F.concat_ws("-", *(F.concat(*signs[k : k + 4]) for k in range(0, digits, 4)))


def priority(*parts: Column) -> Column:
    """A hash that orders items the same way wherever it is computed."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def chunk_of(place: Column, total: Column, chunks: int) -> Column:
    """The contiguous chunk of zero-based ``place``, as if cut at [c*n/of, (c+1)*n/of)."""
    return F.floor(((place + 1) * chunks - 1) / total).cast("int")


def gap_ratio(nearest: Column, spread: Column, floor: Column) -> Column:
    """Distance to the nearest other group over the own spread, at least the floor."""
    return nearest / F.greatest(F.coalesce(spread, F.lit(0.0)), floor)


@F.pandas_udf(T.StringType())
def short_number(x: pd.Series) -> pd.Series:
    """Six significant digits as C's ``%.6g`` shows them, null for null (S10, P12). No Spark function does that:
    ``format_string`` keeps trailing zeros and rounds the shortest decimal form instead of the value."""
    return x.map(lambda v: f"{v:.6g}", na_action="ignore").astype(object)


def rounded(c: Column, digits: int) -> Column:
    """The value rounded as a binary fraction, ties to even, null for null and NaN (P11). ``round`` in Spark rounds
    the shortest decimal form instead, so 2.675 gives 2.68 there and 2.67 here."""

    @F.pandas_udf(T.DoubleType())
    def each(x: pd.Series) -> pd.Series:
        return x.map(lambda v: round(v, digits), na_action="ignore")

    return F.when(~F.isnan(c), each(c))


def margin(cohesion: Column, pull: Column) -> Column:
    """Cohesion rounded to 3 digits less the pull, rounded to 3 digits."""
    return rounded(rounded(cohesion, 3) - pull, 3)


def seed_of(*parts: Column) -> Column:
    """A number from a hash of the parts, the same anywhere."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("bigint")


def mixed_order(*parts: Column) -> Column:
    """A key by which numbers come before other strings at each position."""
    number = [F.try_to_number(F.when(p.rlike("^-?[0-9]{1,18}$"), p), F.lit("S999999999999999999")) for p in parts]
    return F.struct(*(F.struct(F.when(n.isNull(), 1).otherwise(0).alias("kind"), n.alias("number"), p.alias("text")).alias(f"k{i}") for i, (n, p) in enumerate(zip(number, parts))))


def alignment_width(aligned: Column) -> Column:
    """Columns of an aligned sequence."""
    return F.length(aligned)


def fingerprint(*parts: Column) -> Column:
    """A hash of named values in a fixed order."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)
