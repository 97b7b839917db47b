"""Set and bit similarities as column expressions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: 1 if both are empty, 0 if one is."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def signature(a: Column) -> Column:
    """64 bits of an array's values, one a value, values may share one: what ``alike`` rules pairs out by."""
    bit = lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int")))
    return F.aggregate(a, F.lit(0).cast("bigint"), bit)


def alike(a: Column, b: Column, least: float, bits: tuple[Column, Column] | None = None) -> Column:
    """Whether two arrays of distinct values have a Jaccard of ``least`` or more; empty ones never do.

    Where the sizes alone rule it out the arrays aren't compared, and the union follows from sizes and intersection. With
    the ``signature`` of both, a bit that only one has is a value that only that one has, which rules out most others.
    """
    m, n = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    able = (m > 0) & (n > 0) & (F.least(m, n) >= F.greatest(m, n) * F.lit(least) - F.lit(1e-9))
    if bits is not None:
        x, y = bits
        most = F.least(m - F.bit_count(x.bitwiseAND(F.bitwise_not(y))), n - F.bit_count(y.bitwiseAND(F.bitwise_not(x))))
        able &= most >= (m + n - most) * F.lit(least) - F.lit(1e-9)
    return F.when(able, both / (m + n - both) >= least).otherwise(False)


def half(hex16: Column, n: int) -> Column:
    """One 32-bit half of sixteen hex digits, as a number."""
    return F.conv(F.substring(hex16, 1 + 8 * n, 8), 16, 10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes in hex."""
    return F.bit_count(half(a, 0).bitwiseXOR(half(b, 0))).cast("int") + F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))).cast("int")


def bits64(hex16: Column) -> Column:
    """A 64-bit hash of sixteen hex digits as one number."""
    return F.shiftleft(half(hex16, 0), 32).bitwiseOR(half(hex16, 1))


def apart(a: Column, b: Column) -> Column:
    """Differing bits of two hashes as numbers."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def block_keys(bits: Column, blocks: int, most: int) -> Column:
    """array<bigint>: for every choice of ``blocks - most`` of the blocks of a 64-bit number, their bits under the choice's number.

    Two numbers at most ``most`` bits apart agree on that many blocks at least, so they share a key.
    """
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    starts = [sum(widths[:i]) for i in range(blocks)]
    block = [F.shiftrightunsigned(bits, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(starts, widths)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - most)):
        key = F.lit(n).cast("bigint")
        for i in chosen:
            key = F.shiftleft(key, widths[i]).bitwiseOR(block[i])
        keys.append(key)
    return F.array(*keys)


def hash_strength(distance: Column) -> Column:
    """How strong a match of two 64-bit hashes is: 1 for equal ones."""
    return 1 - distance / 64


def least_apart(a: Column, b: Column) -> Column:
    """Least distance between any number of one array and any of the other; null if either is empty."""
    return F.array_min(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: apart(x, y)))))
