"""Similarity matrices as arrays of float arrays: selection of positions, padding, k-max and cosine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    """x as a double with so many places, halves away from 0; a negative x that becomes 0 keeps its sign, as -0.0, which F.round drops."""
    x = x.cast("double")
    r = F.round(x, places)
    return F.when(r == 0, F.signum(x) * 0.0).otherwise(r)


def column_max(matrix: Column) -> Column:
    """The largest value of each column."""
    return F.aggregate(F.slice(matrix, F.lit(2), F.greatest(F.size(matrix) - 1, F.lit(0))), matrix[0], lambda a, r: F.zip_with(a, r, lambda x, y: F.greatest(x, y)))


def first_k(n: Column, k: int) -> Column:
    return F.sequence(F.lit(0), F.least(n, F.lit(k)) - 1)


def absolute_max(values: Column, k: int) -> Column:
    """Positions of the k largest values (the earlier on ties), ascending."""
    pairs = F.transform(values, lambda v, i: F.struct((-v).alias("v"), i.alias("i")))
    return F.sort_array(F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["i"]))


def moving_average(values: Column, width: int) -> Column:
    n = F.size(values) - width + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(F.slice(values, i + 1, width), F.lit(0.0), lambda a, x: a + x.cast("double")) / width)).otherwise(F.array().cast("array<double>"))


def max_slide(values: Column, k: int, width: int) -> Column:
    """Positions of the best windows, taken best first until k positions are covered; ascending, the first k."""
    pairs = F.array_sort(F.transform(moving_average(values, width), lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))

    def take(a: Column, p: Column) -> Column:
        return F.when(F.size(a) < k, F.array_union(a, F.sequence(p["i"], p["i"] + width - 1))).otherwise(a)

    return F.slice(F.sort_array(F.aggregate(pairs, F.array().cast("array<int>"), take)), 1, k)


def max_slide_old(values: Column, k: int, width: int) -> Column:
    """Starts of the windows best first, then all of them moved by one, and so on; the first k of these, ascending, with repeats."""
    starts = F.transform(F.array_sort(F.transform(moving_average(values, width), lambda v, i: F.struct((-v).alias("v"), i.alias("i")))), lambda p: p["i"])
    moved = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda w: F.transform(starts, lambda i: i + w)))
    return F.sort_array(F.slice(moved, 1, k))


def permuted(values: Column, seed: Column) -> Column:
    """values in an order that only the seed decides; the same seed gives the same order to arrays of one length."""
    keyed = F.transform(values, lambda v, i: F.struct(F.xxhash64(seed, i).alias("k"), i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(a["i"] - b["i"])), lambda x: x["v"])


def strides(values: Column, k: int, width: int) -> Column:
    """Windows best first, their positions appended, those only that end before the last column; may be fewer than k."""
    pairs = F.array_sort(F.transform(moving_average(values, width), lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    inside = F.filter(pairs, lambda p: p["i"] + width < F.size(values))
    return F.slice(F.flatten(F.transform(inside, lambda p: F.sequence(p["i"], p["i"] + width - 1))), 1, k)


def separated(positions: Column, k: int) -> Column:
    """-1 behind every run of consecutive positions; truncated to k."""
    marked = F.transform(positions, lambda p, i: F.when((i < F.size(positions) - 1) & (F.get(positions, i + 1) == p + 1), F.array(p)).otherwise(F.array(p, F.lit(-1))))
    return F.slice(F.flatten(marked), 1, k)


def select_columns(matrix: Column, positions: Column) -> Column:
    """-1 addresses a column of zeros."""
    return F.transform(matrix, lambda r: F.transform(positions, lambda p: F.when(p < 0, F.lit(0.0).cast("float")).otherwise(F.get(r, p))))


def pad(values: Column, n: int, filler: float = 0.0) -> Column:
    return F.slice(F.concat(values, F.array_repeat(F.lit(filler).cast("float"), n)), 1, n)


def pad_matrix(matrix: Column, rows: int, columns: int) -> Column:
    full = F.transform(matrix, lambda r: pad(r, columns))
    return F.slice(F.concat(full, F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), columns), rows)), 1, rows)


def stack(a: Column, b: Column) -> Column:
    """Rows of both where their widths agree, else null."""
    return F.when(F.size(a[0]) == F.size(b[0]), F.concat(a, b))


def k_max(values: Column, k: int) -> Column:
    return F.slice(F.sort_array(values, asc=False), 1, k)


def k_max_context(values: Column, context: Column, k: int) -> Column:
    """The k largest values, then the context's values at the same places."""
    top = F.slice(F.array_sort(F.zip_with(F.transform(values, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))), context, lambda p, c: F.struct(p["v"].alias("v"), p["i"].alias("i"), c.alias("c")))), 1, k)
    return F.concat(F.transform(top, lambda p: -p["v"]), F.transform(top, lambda p: p["c"]))


def keep_terms(idf: Column, budget: int) -> Column:
    """Indices of the terms with the highest idf within the budget, in their own order."""
    return absolute_max(idf, budget)


def binarise(values: Column, threshold: float = 0.999) -> Column:
    return F.transform(values, lambda v: F.when(v >= threshold, 1.0).otherwise(v))


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    e = F.transform(values, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def clamped_cosine(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Cosine within [0, 1]; below the threshold 0."""
    c = F.least(F.greatest(dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0)), F.lit(1.0))
    return F.when(c < threshold, 0.0).otherwise(c)


def pairwise_loss(positive: Column, negatives: Column) -> Column:
    """exp(positive) over the sum of all exponentials."""
    return F.exp(positive) / (F.exp(positive) + F.aggregate(negatives, F.lit(0.0), lambda a, x: a + F.exp(x)))
