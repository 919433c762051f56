"""Column expressions on voxels, and the table of the 26 steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxloom.kernels.grid import GRAPH_BITS, OFFSETS, OPPOSITE

LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flat_index(x, y, z, sx, sy) -> Column:
    """Index with x fastest."""
    return col(x) + col(sx) * (col(y) + col(sy) * col(z))


def unravel(vid, sx, sy) -> tuple[Column, Column, Column]:
    """x, y, z of an index."""
    v, a, b = col(vid), col(sx), col(sy)
    div = lambda p, q: F.call_function("div", p, q)
    return v % a, div(v, a) % b, div(v, a * b)


def steps(spark: SparkSession) -> DataFrame:
    """(k, dx, dy, dz, bit, opposite): 26 rows, fixed."""
    rows = [(k, *o, GRAPH_BITS[k], int(OPPOSITE[k])) for k, o in enumerate(OFFSETS.tolist())]
    return spark.createDataFrame(rows, "k long, dx long, dy long, dz long, bit long, opposite long")


def step_array() -> Column:
    """The same 26 steps as one literal array of structs, for ``inline`` without a join."""
    names = ("k", "dx", "dy", "dz", "bit", "opposite")
    rows = [F.struct(*[F.lit(int(v)).cast("long").alias(n) for n, v in zip(names, (k, *o, GRAPH_BITS[k], OPPOSITE[k]))]) for k, o in enumerate(OFFSETS.tolist())]
    return F.array(*rows)


def allowed(bits, bit) -> Column:
    """Whether a connectivity graph permits the step with this bit."""
    return F.call_function("shiftright", col(bits), col(bit).cast("int")).bitwiseAND(F.lit(1)) == 1


def integer_label(value) -> Column:
    """A floating label as an integer: truncated, clamped; NaN is the least."""
    v = col(value).cast("double")
    return F.when(F.isnan(v) | (v <= float(LONG_MIN)), F.lit(LONG_MIN)).when(v >= float(LONG_MAX), F.lit(LONG_MAX)).otherwise(v.cast("long"))


def power(value: Column, exponent: float) -> Column:
    """Powers of two by repeated squaring, others by pow."""
    e = int(exponent) if float(exponent).is_integer() and 0 < exponent < 65536 else 0
    if e and not e & (e - 1):
        return reduce(lambda v, _: v * v, range(e.bit_length() - 1), value)
    return F.pow(value, F.lit(float(exponent)))


def penalty(dbf, daf, dbf_max, daf_max, scale: float, exponent: float) -> Column:
    """Cost of a voxel for tracing; a farthest distance of 0 drops the second term."""
    depth = 1 - col(dbf) / F.pow(col(dbf_max), F.lit(1.01))
    return scale * power(depth, exponent) + F.when(col(daf_max) == 0, 0.0).otherwise(F.coalesce(col(daf) / col(daf_max), F.lit(0.0)))


def freespace_distance(dx, dy, dz) -> Column:
    """Length of the shortest walk of 26-neighbour steps with unit spacing."""
    a, b, c = (F.abs(col(d)) for d in (dx, dy, dz))
    low, high = F.least(a, b, c), F.greatest(a, b, c)
    mid = a + b + c - low - high
    return low * F.sqrt(F.lit(3.0)) + (mid - low) * F.sqrt(F.lit(2.0)) + (high - mid)


def affine(x, y, z, matrix: list[list[float]]) -> list[Column]:
    """Rows of a 3 x 4 matrix applied to a point."""
    return [r[0] * col(x) + r[1] * col(y) + r[2] * col(z) + r[3] for r in matrix]


def inverse_affine(matrix: list[list[float]]) -> list[list[float]]:
    import numpy as np

    whole = np.vstack([np.asarray(matrix, np.float64), [0, 0, 0, 1]])
    return np.linalg.inv(whole)[:3].tolist()


def squared_distance(a: tuple, b: tuple) -> Column:
    return reduce(lambda p, q: p + q, [(col(u) - col(v)) * (col(u) - col(v)) for u, v in zip(a, b)])
