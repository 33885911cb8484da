"""Vector functions over array<float> columns, computed in doubles."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def plane(i: int, dims: int, seed: str = "plane") -> list[int]:
    """Signs of the i-th hyperplane, from a hash, the same in every engine."""
    bits = b""
    k = 0
    while len(bits) * 8 < dims:
        bits += hashlib.sha1(f"{seed}|{i}|{k}".encode()).digest()
        k += 1
    return [1 if bits[d // 8] >> (d % 8) & 1 else -1 for d in range(dims)]


def signature(a: Column, bits: int, dims: int, seed: str = "plane") -> Column:
    """A bit for each hyperplane: on which side the vector lies."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        signs = F.array(*(F.lit(float(s)) for s in plane(i, dims, seed)))
        out = out + F.when(dot(a, signs) >= 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return out


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def probes(code: Column, bits: int, radius: int = 2) -> Column:
    """All codes within the radius (at most 2) of a code: 1 + bits + bits (bits - 1) / 2 of them."""
    masks = [0, *(1 << i for i in range(bits))]
    if radius > 1:
        masks += [1 << i | 1 << j for i in range(bits) for j in range(i)]
    return F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: code.bitwiseXOR(m))


def blend(first: Column, second: Column, share: float = 0.5) -> Column:
    return (1 - share) * first + share * second


def slot_score(dense: Column, overlap: Column, learned: Column) -> Column:
    """Of a learned dense score, or of a plain cosine: dense and overlap by their weights."""
    return F.when(learned, 0.85 * dense + 0.15 * overlap).otherwise(0.4 * ((dense + 1) / 2) + 0.6 * overlap)


def geometry(scores: Column) -> Column:
    """struct of what a descending score list looks like: top1, top2, margin, top3_mean, z, n_near, entropy."""
    s = F.sort_array(scores, asc=False)
    n = F.size(s)
    at = lambda i: F.coalesce(F.get(s, F.lit(i)), F.lit(0.0))
    mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / n
    std = F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    top3 = F.slice(s, 1, 3)
    total = F.aggregate(F.transform(s, lambda x: F.exp(x - at(0))), F.lit(0.0), lambda a, x: a + x)
    entropy = -F.aggregate(F.transform(s, lambda x: F.exp(x - at(0)) / total), F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log(p)).otherwise(0.0))
    return F.struct(
        at(0).alias("top1"), at(1).alias("top2"), (at(0) - at(1)).alias("margin"), (F.aggregate(top3, F.lit(0.0), lambda a, x: a + x) / F.size(top3)).alias("top3_mean"),
        (at(0) - F.get(s, (n / 2).cast("int"))).alias("over_median"), std.alias("std"), F.when(std > 0, (at(0) - mean) / std).otherwise(0.0).alias("z"),
        F.size(F.filter(s, lambda x: x >= at(0) - 0.1 * F.abs(at(0)))).alias("n_near"), entropy.alias("entropy"),
    )
