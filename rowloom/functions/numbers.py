"""Arithmetic and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """Halves toward plus infinity."""
    return F.floor(x + 0.5)


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def ink_luma(r: Column, g: Column, b: Column) -> Column:
    """Brightness, with ink that a dark blue selection hides made bright again."""
    hidden = (b - r >= 10) & (b - g >= 10) & (r <= 110) & (g <= 110) & (b <= 118)
    lifted = F.least(F.lit(255), round_half_up(76 + 4.8 * F.least(F.lit(40.0), b - (r + g) / 2)))
    return F.when(hidden, lifted).otherwise(round_half_up(luma(r, g, b))).cast("int")


def ink_gate(ink: Column, in_range: Column) -> Column:
    """name from 60 bright pixels, uncertain from 40, else empty; rows out of range are kept as uncertain names."""
    return F.when(~in_range, "kept").when(ink >= 60, "name").when(ink >= 40, "uncertain").otherwise("empty")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once; a plain reference inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def centred(v: Column) -> Column:
    """A vector less its mean, scaled to length 1 (a flat one becomes zero)."""
    wide = F.transform(v, lambda x: x.cast("double"))
    mean = F.aggregate(wide, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    moved = let(mean, lambda m: F.transform(wide, lambda x: x - m))
    return let(moved, lambda c: let(F.sqrt(dot(c, c) + 1e-8), lambda n: F.transform(c, lambda x: x / n)))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared elements of two sets over their sizes' sum; 0 where both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def bit_dice(a: Column, b: Column) -> Column:
    """dice() of sets held as bits of integers."""
    total = F.bit_count(a) + F.bit_count(b)
    return F.when(total == 0, 0.0).otherwise(2.0 * F.bit_count(a.bitwiseAND(b)) / total)


def likeness(a: Column, b: Column) -> Column:
    """1 less the mean absolute difference of two vectors, 0 at least."""
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), 1 - gap / F.size(a))


def word_score(mean: Column, least: Column, ratio: Column, n: Column) -> Column:
    """Score of a word from its signs' mean and least likeness, drawn down where its width is off for ``n`` signs; 0 for none or over 12."""
    expected = F.greatest(F.lit(0.7), n * 0.86)
    aspect = F.exp(-F.abs(F.log(F.greatest(F.lit(0.15), ratio) / expected)) * 0.26)
    return F.when((n < 1) | (n > 12), 0.0).otherwise(F.greatest(F.lit(0.0), mean * 0.78 + least * 0.22) * aspect)


def difference_hash(v: Column, bits: int = 63) -> Column:
    """Bit i is 1 where element i is above the next one, for the first ``bits`` neighbours."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda acc, i: acc * 2 + F.when(F.get(v, i) > F.get(v, i + 1), 1).otherwise(0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fits_layout(family: Column, given: Column, split: Column, block: Column, left: Column, recovery: Column, flat: Column) -> Column:
    """Whether a name of so many signs fits the row's layout: the given name's place in split rows, the length in others."""
    off = F.abs(block - (left + 16 * family + 3.5))
    placed = (given > 0) & (off <= F.when(recovery, 24).otherwise(10))
    return F.when(split, placed).otherwise(family + given <= F.when(recovery | flat, 12).otherwise(9))
