"""Statistics as Column expressions; undefined values are null, never NaN."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The Chebyshev fit of erfc, relative error below 1.2e-7 everywhere.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
#: Cumulative Poisson(1) probabilities, from which hash draws become bootstrap weights.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)


def erfc(z: Column) -> Column:
    """For z >= 0."""
    t = 1 / (1 + z / 2)
    series = F.lit(ERFC[-1])
    for c in reversed(ERFC[1:-1]):
        series = F.lit(c) + t * series
    return F.least(F.lit(1.0), t * F.exp(-z * z + ERFC[0] + t * series))


def erfc_of(z: np.ndarray) -> np.ndarray:
    """The same in numpy."""
    t = 1 / (1 + z / 2)
    series = np.full_like(t, ERFC[-1])
    for c in reversed(ERFC[1:-1]):
        series = c + t * series
    return np.minimum(1.0, t * np.exp(-z * z + ERFC[0] + t * series))


def yates(a: Column, c: Column, n1: float, n0: float) -> Column:
    """Chi-square of a of n1 against c of n0 with Yates' correction; null where a margin is empty."""
    a, c = a.cast("double"), c.cast("double")
    n = float(n1 + n0)
    b, d = F.lit(float(n1)) - a, F.lit(float(n0)) - c
    below = (a + c) * (b + d) * float(n1) * float(n0)
    gap = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    return F.when(below > 0, F.lit(n) * gap * gap / below)


def chi_square_p(chi2: Column) -> Column:
    """Survival at one degree of freedom; an undefined statistic has p = 1 (as the exact test of an empty margin)."""
    return F.coalesce(erfc(F.sqrt(chi2 / 2)), F.lit(1.0))


def smoothed(count: Column, n: float) -> Column:
    return (count + 1) / F.lit(float(n + 1))


def cohens_d(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """With pooled sample variance; null where that is 0 or undefined."""
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / F.nullif(n1 + n2 - 2, F.lit(0)))
    return (m1 - m2) / F.nullif(pooled, F.lit(0.0))


def burstiness(sd: Column, mean: Column) -> Column:
    return (sd - mean) / F.nullif(sd + mean, F.lit(0.0))


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", number: str = "number", keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds q_fdr and tests_total to rows of distinct p-values with the number of tests that share each.

    Ties have one rank, that of the last, so windows run over distinct p-values and not over tests. ``keys`` part
    separate families.
    """
    family = Window.partitionBy(*keys)
    total = F.sum(number).over(family)
    rank = F.sum(number).over(family.orderBy(p).rangeBetween(Window.unboundedPreceding, 0))
    ranked = tests.withColumn("tests_total", total).withColumn("_q", F.col(p) * F.col("tests_total") / rank)
    following = family.orderBy(p).rangeBetween(0, Window.unboundedFollowing)
    return ranked.withColumn("q_fdr", F.least(F.lit(1.0), F.min("_q").over(following))).drop("_q")


def holm(p: str, keys: tuple[str, ...] = (), tie: str = "metric") -> Column:
    order = Window.partitionBy(*keys).orderBy(p, tie)
    m = F.count(F.col(p)).over(Window.partitionBy(*keys))
    step = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    return F.max(step).over(order.rowsBetween(Window.unboundedPreceding, 0))


def hash_index(*parts: Column) -> Column:
    """An integer in 0 to 2**32 - 1 from md5, which other engines can state too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def poisson_weight(*parts: Column) -> Column:
    """Times that a row is drawn in a bootstrap repetition: Poisson(1) by hash, so no row needs a number or a shuffle."""
    u = hash_index(*parts) / float(1 << 32)
    out = F.lit(len(POISSON))
    for k in reversed(range(len(POISSON))):
        out = F.when(u < POISSON[k], k).otherwise(out)
    return out


#: Rotations and sines of md5 (RFC 1321).
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_LANES = 1 << 14  # digests made side by side, so that their words stay in the processor's cache


def _digests(message: list[np.ndarray | int], shape: tuple[int, int]) -> np.ndarray:
    """The first word of md5 of one-block messages, whose 16 words are numbers or arrays of the shape."""
    first = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
    a, b, c, d = (np.full(shape, x, np.uint32) for x in first)
    mixed, turned = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(61):  # the last three steps make the other words
        kind, at = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        if kind == 0:
            np.bitwise_xor(c, d, out=mixed), np.bitwise_and(mixed, b, out=mixed), np.bitwise_xor(mixed, d, out=mixed)
        elif kind == 1:
            np.bitwise_xor(b, c, out=mixed), np.bitwise_and(mixed, d, out=mixed), np.bitwise_xor(mixed, c, out=mixed)
        elif kind == 2:
            np.bitwise_xor(b, c, out=mixed), np.bitwise_xor(mixed, d, out=mixed)
        else:
            np.bitwise_not(d, out=mixed), np.bitwise_or(mixed, b, out=mixed), np.bitwise_xor(mixed, c, out=mixed)
        np.add(mixed, a, out=mixed)
        word = message[at]
        if isinstance(word, np.ndarray):
            np.add(mixed, word, out=mixed), np.add(mixed, np.uint32(_SINES[i]), out=mixed)
        else:
            np.add(mixed, np.uint32((_SINES[i] + word) & 0xFFFFFFFF), out=mixed)
        turn = _TURNS[kind][i % 4]
        np.left_shift(mixed, np.uint32(turn), out=turned), np.right_shift(mixed, np.uint32(32 - turn), out=mixed)
        np.bitwise_or(mixed, turned, out=mixed), np.add(mixed, b, out=a)
        a, b, c, d = d, a, b, c
    return b + np.uint32(first[0])


def hash_indices(seed: int, repetitions: int, names: list[str]) -> np.ndarray:
    """hash_index of seed, repetition and name in numpy (repetitions x names, uint32).

    Messages of one length have their parts at the same bytes, so a message is the bitwise or of what its repetition and
    its name write, and all of them are hashed side by side; a name too long for one block is hashed alone.
    """
    heads, told = [f"{seed}:{rep}:".encode() for rep in range(repetitions)], [str(name).encode() for name in names]
    out = np.empty((repetitions, len(told)), np.uint32)
    by = lambda every: [(n, [i for i, x in enumerate(every) if len(x) == n]) for n in sorted({len(x) for x in every})]
    for h, reps in by(heads):
        for t, own in by(told):
            if h + t > 55:
                out[np.ix_(reps, own)] = [[int.from_bytes(hashlib.md5(heads[r] + told[i]).digest()[:4]) for i in own] for r in reps]
                continue
            left, right = np.zeros((len(reps), 64), np.uint8), np.zeros((len(own), 64), np.uint8)
            left[:, :h] = np.frombuffer(b"".join(heads[r] for r in reps), np.uint8).reshape(len(reps), h)
            right[:, h : h + t] = np.frombuffer(b"".join(told[i] for i in own), np.uint8).reshape(len(own), t)
            left[:, h + t], left[:, 56:58] = 128, np.frombuffer((8 * (h + t)).to_bytes(2, "little"), np.uint8)
            left, right = left.view("<u4"), right.view("<u4")
            wide = min(len(own), _LANES)
            for i in range(0, len(own), wide):
                high = max(1, _LANES // wide)
                for r in range(0, len(reps), high):
                    one, two = left[r : r + high], right[i : i + wide]
                    shape = len(one), len(two)
                    same = (one == one[0]).all(axis=0) & (two == two[0]).all(axis=0)
                    words = [int(one[0, w] | two[0, w]) if same[w] else one[:, w, None] | two[None, :, w] for w in range(16)]
                    out[np.ix_(reps[r : r + high], own[i : i + wide])] = _digests(words, shape).byteswap()
    return out


def poisson_weights(seed: int, repetitions: int, names: list[str]) -> np.ndarray:
    """The same weights in numpy (repetitions x names): poisson_weight of seed, repetition and name."""
    index = hash_indices(seed, repetitions, names)
    out = np.zeros(index.shape)
    for p in POISSON:
        out += index >= np.uint32(math.ceil(p * 2**32))
    return out
