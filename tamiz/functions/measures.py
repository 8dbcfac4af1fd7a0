"""Similarities and distances, as functions from Column to Column that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamiz.functions import text as tx
from tamiz.functions.once import let


def _word(hexed: Column, i: Column) -> Column:
    """Eight bytes of a hexadecimal string, from its i-th word on, as a long."""
    return F.conv(F.substring(hexed, (i * 16 + 1).cast("int"), F.lit(16)), 16, -10).cast("long")


def hamming_bits(a: Column, b: Column) -> Column:
    """Differing bits of two strings' UTF-8 bytes; null if their lengths in bytes differ."""
    n = F.ceil(F.octet_length(a) / 8).cast("int")
    both = F.struct(F.hex(a.cast("binary")).alias("x"), F.hex(b.cast("binary")).alias("y"))
    bits = let(both, lambda h: F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + F.bit_count(_word(h["x"], i).bitwiseXOR(_word(h["y"], i)))))
    return F.when(F.octet_length(a) == F.octet_length(b), F.when(F.octet_length(a) == 0, F.lit(0)).otherwise(bits))


def hamming_positions(a: Column, b: Column) -> Column:
    """Differing code points of two strings; null if their lengths differ."""
    x, y = (F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)) for c in (a, b))
    return F.when(F.char_length(a) == F.char_length(b), F.aggregate(F.zip_with(x, y, lambda p, q: (p != q).cast("int")), F.lit(0), lambda s, d: s + d))


def hamming_words(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words; null if their sizes differ."""
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, d: s + d)
    return F.when(F.size(a) == F.size(b), bits)


def hamming_score(a: Column, b: Column) -> Column:
    """1 less differing bits over bytes, which may be as low as -7; 0 for different lengths and for empty strings."""
    n = F.octet_length(a)
    return F.when((n == F.octet_length(b)) & (n > 0), 1 - hamming_bits(a, b) / n).otherwise(F.lit(0.0))


def zeros(n: int) -> Column:
    """A bitmap of n words without a set bit."""
    return F.array_repeat(F.lit(0).cast("long"), n)


def bitmap(words: list[int]) -> Column:
    """A bitmap of unsigned 64-bit words, held as signed ones."""
    return F.array(*[F.lit(w - 2**64 if w >= 2**63 else w).cast("long") for w in words]) if words else F.array().cast("array<bigint>")


def dice_bound(n: Column, m: Column) -> Column:
    """The largest Dice similarity that sets of these sizes may have; 0 for two empty ones."""
    return F.when(n + m > 0, 2.0 * F.least(n, m) / (n + m)).otherwise(F.lit(0.0))


def dice(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Sørensen-Dice similarity of two sets; 0 for two empty ones, null where the bound is below the threshold."""
    n, m = F.size(a), F.size(b)
    score = F.when(n + m > 0, 2.0 * F.size(F.array_intersect(a, b)) / (n + m)).otherwise(F.lit(0.0))
    return F.when(dice_bound(n, m) >= threshold, score)


def bag_intersection(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as bags."""
    count = lambda array, t: F.size(F.filter(array, lambda x: x == t))
    total = lambda h: F.aggregate(F.array_intersect(h["a"], h["b"]), F.lit(0), lambda s, t: s + F.least(count(h["a"], t), count(h["b"], t)))
    return let(F.struct(a.alias("a"), b.alias("b")), total)


def jaccard_ratio(inter: Column, n: Column, m: Column) -> Column:
    """Intersection over union in single precision; 1 for two empty bags."""
    return F.when(n + m == 0, F.lit(1.0)).otherwise(inter / F.greatest(n + m - inter, F.lit(1))).cast("float")


def jaccard(a: Column, b: Column, distinct: bool = False) -> Column:
    """Jaccard similarity of two token arrays, as bags, or as sets if distinct."""
    if distinct:
        a, b = F.array_distinct(a), F.array_distinct(b)
    return jaccard_ratio(bag_intersection(a, b), F.size(a), F.size(b))


def minhash(tokens: Column, k: int = 128) -> Column:
    """The least hash of any token for each of k seeds; the largest long for no token."""
    least = lambda i: F.array_min(F.transform(tokens, lambda t: F.xxhash64(t, F.lit(i))))
    return F.array(*[F.coalesce(least(i), F.lit(2**63 - 1)) for i in range(k)])


def minhash_estimate(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures, in single precision; null if their sizes differ, NaN for none."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, d: s + d)
    ratio = F.when(F.size(a) == 0, F.lit(float("nan"))).otherwise(same / F.greatest(F.size(a), F.lit(1)))
    return F.when(F.size(a) == F.size(b), ratio).cast("float")


def from_distance(d: Column, n: Column, m: Column) -> Column:
    """Similarity of a distance between sequences of these lengths: 1 - d / longest, in [0, 1]; 1 for two empty ones."""
    longest = F.greatest(n, m)
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d / F.greatest(longest, F.lit(1)))))


def dot(a: Column, b: Column) -> Column:
    """Dot product, in double precision; null if the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, d: s + d)
    return F.when(F.size(a) == F.size(b), total)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column) -> Column:
    """The vector over its length; the vector itself if that is 1e-10 or less."""
    norm = l2_norm(a)
    return F.when(norm > 1e-10, F.transform(a, lambda x: (x / norm).cast("float"))).otherwise(a.cast("array<float>"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either length is below 1e-10."""
    x, y = l2_norm(a), l2_norm(b)
    return F.when((x < 1e-10) | (y < 1e-10), F.lit(0.0)).otherwise(dot(a, b) / (x * y))


def squared_euclid(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; null if the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, d: s + d)
    return F.when(F.size(a) == F.size(b), total)


def euclid_score(d2: Column) -> Column:
    """Cosine of unit vectors at this squared distance."""
    return 1 - d2 / 2


def phonetic_score(distance: Column) -> Column:
    return 1 - distance * 0.3


def unit_range(score: Column) -> Column:
    """The score, or an error if it is outside [0, 1]."""
    return F.when(F.assert_true((score >= 0) & (score <= 1), F.lit("a similarity must be in [0, 1]")).isNull(), score)


def clamped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def meets(score: Column, threshold: float) -> Column:
    return score >= threshold


def format_score(score: Column) -> Column:
    return F.format_string("%.4f", score.cast("double"))


def format_percent(score: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", score.cast("double") * 100)


def saturating_sub(a: Column, b: Column) -> Column:
    """Distance difference, not below 0."""
    return F.greatest(F.lit(0), a - b)


def saturating_add(a: Column, b: Column, most: int = 2**32 - 1) -> Column:
    return F.least(F.lit(most), a.cast("long") + b.cast("long"))


def shingle_dice(a: Column, b: Column) -> Column:
    """Dice similarity of two strings by their bigrams of graphemes."""
    return dice(tx.bigram_shingles(a), tx.bigram_shingles(b))
