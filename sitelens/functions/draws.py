"""Seeded draws that do not depend on partitioning.

A draw is a function of the seed and the row's own key, so a repeated task, a
lost executor or another partitioning gives the same result. Only ``md5`` is
used, which every SQL engine has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(part: str | int | Column) -> Column:
    if isinstance(part, Column):
        return part.cast("string")
    if isinstance(part, int):
        return F.lit(str(part))
    return F.col(part).cast("string")


def draw_key(seed: int, *parts: str | int | Column) -> Column:
    """32 hexadecimal digits, in random order with respect to the parts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_text(p) for p in parts]))


def draw_number(seed: int, *parts: str | int | Column) -> Column:
    """Uniform whole number in [0, 2**48)."""
    return F.conv(F.substring(draw_key(seed, *parts), 1, 12), 16, 10).cast("bigint")


def draw_index(n: str | Column, seed: int, *parts: str | int | Column) -> Column:
    """Uniform whole number in [1, n]."""
    n = F.col(n) if isinstance(n, str) else n
    return draw_number(seed, *parts) % n + 1


def draw_uniform(seed: int, *parts: str | int | Column) -> Column:
    """Uniform double in [0, 1)."""
    return draw_number(seed, *parts) / F.lit(float(2**48))


#: Modulus of the round functions of ``permuted``; products of two residues stay below 2**62.
PRIME = 2**31 - 1
#: Rounds of the network; a multiple of 2. Pools of a dozen members need eight before all pairs of draws are equally likely.
ROUNDS = 8


def permutation_keys(n: str | Column, seed: int, *parts: str | int | Column) -> Column:
    """What ``permuted`` needs of a permutation of 0..n-1: (n, a, b, k), the same for all its slots.

    a * b is the smallest product of a near-square pair that is at least n; k holds, for each
    round, three coefficients of a polynomial modulo ``PRIME``, so that its values at any three places are independent.
    """
    n = (F.col(n) if isinstance(n, str) else n).cast("bigint")
    a = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")
    b = F.floor((n + a - 1) / a).cast("bigint")
    keys = [draw_key(seed, *parts, r) for r in range(ROUNDS)]
    k = F.array(*[F.conv(F.substring(key, 1 + 8 * i, 8), 16, 10).cast("bigint") % PRIME for key in keys for i in range(3)])
    return F.struct(n.alias("n"), a.alias("a"), b.alias("b"), k.alias("k"))


def _round(k: Column, r: int, x: Column) -> Column:
    return ((k[3 * r] * x % PRIME + k[3 * r + 1]) * x % PRIME + k[3 * r + 2]) % PRIME


def permuted(df: DataFrame, index: str, keys: str, out: str) -> DataFrame:
    """Add ``out``: the place of ``index`` (0..n-1) in the keyed permutation that ``permutation_keys`` described.

    An unbalanced Feistel network on pairs (l, r) below (a, b); a pair that stands for a
    number of n or more is sent round again, which happens about once in sqrt(n). Different
    indexes get different places.
    """
    n, a, b, k = (F.col(f"{keys}.{c}") for c in "nabk")
    df = df.withColumn("_l", F.floor(F.col(index) / b).cast("bigint")).withColumn("_r", F.col(index) % b)
    for r in range(0, ROUNDS, 2):
        df = df.withColumn("_l", (F.col("_l") + _round(k, r, F.col("_r"))) % a)
        df = df.withColumn("_r", (F.col("_r") + _round(k, r + 1, F.col("_l"))) % b)

    def again(state: Column, _: Column) -> Column:
        """One round; a place that is small enough stays where it is."""
        left, right, i = state["l"], state["r"], state["i"]
        at = 3 * (i % ROUNDS)
        x = F.when(i % 2 == 0, right).otherwise(left)
        f = ((F.get(k, at) * x % PRIME + F.get(k, at + 1)) * x % PRIME + F.get(k, at + 2)) % PRIME
        moved = F.struct(
            F.when(i % 2 == 0, (left + f) % a).otherwise(left).alias("l"), F.when(i % 2 == 0, right).otherwise((right + f) % b).alias("r"), (i + 1).alias("i")
        )
        return F.when((i % ROUNDS == 0) & (left * b + right < n), state).otherwise(moved)

    # The walk passes each of the a * b - n numbers that are too large at most once.
    first = F.col("_l") * b + F.col("_r")
    start = F.struct(F.col("_l").alias("l"), F.col("_r").alias("r"), F.lit(0).alias("i"))
    walked = F.aggregate(F.sequence(F.lit(1).cast("bigint"), (a * b - n + 1) * ROUNDS), start, again)
    place = F.when(first < n, first).otherwise(walked["l"] * b + walked["r"])
    # Never null, and said so: a filter for nulls would be pushed below the rounds, which doubles it in each.
    return df.withColumn(out, F.coalesce(place, F.lit(0).cast("bigint"))).drop("_l", "_r")


# ------------------------------------------ the same draws, many at a time in a task


def index_places(text: str, iteration: int, slots: Sequence[bytes], n: int) -> np.ndarray:
    """``draw_index`` less 1 for each slot, given as text; ``text`` is the seed and the key joined by ``|``."""
    start = f"{text}|{iteration}|".encode()
    digests = b"".join([hashlib.md5(start + slot).digest() for slot in slots])
    heads = np.zeros((len(slots), 8), dtype=np.uint8)
    heads[:, 2:] = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 16)[:, :6]
    return (heads.view(">u8").ravel() % np.uint64(n)).astype(np.int64)


def network_keys(text: str, iteration: int) -> list[int]:
    """The coefficients of ``permutation_keys``."""
    keys = [hashlib.md5(f"{text}|{iteration}|{r}".encode()).hexdigest() for r in range(ROUNDS)]
    return [int(key[8 * i : 8 * i + 8], 16) % PRIME for key in keys for i in range(3)]


def permuted_places(index: np.ndarray, n: int, k: Sequence[int]) -> np.ndarray:
    """``permuted`` of whole numbers 0..n-1, for n below 2**31."""
    a = int(np.ceil(np.sqrt(float(n))))
    b = (n + a - 1) // a
    k = [np.uint64(c) for c in k]
    prime, a, b = np.uint64(PRIME), np.uint64(a), np.uint64(b)

    def network(at: np.ndarray) -> np.ndarray:
        left, right = at // b, at % b
        for r in range(0, ROUNDS, 2):
            # A polynomial below 2**63 needs one remainder, at its end.
            left = (left + ((k[3 * r] * right + k[3 * r + 1]) * right + k[3 * r + 2]) % prime) % a
            right = (right + ((k[3 * r + 3] * left + k[3 * r + 4]) * left + k[3 * r + 5]) % prime) % b
        return left * b + right

    place = network(index.astype(np.uint64))
    outside = np.flatnonzero(place >= np.uint64(n))
    while len(outside):
        place[outside] = network(place[outside])
        outside = outside[place[outside] >= np.uint64(n)]
    return place.astype(np.int64)
