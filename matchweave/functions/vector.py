"""Vector functions on array<double> columns, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize(v: Column, eps: float = 1e-12) -> Column:
    return let(norm(v), lambda n: F.transform(v, lambda x: x / F.greatest(n, F.lit(eps))))


def project_out(v: Column, basis: Sequence[Sequence[float]], rank: int | None = None) -> Column:
    """``v - U Ut v`` for the first ``rank`` columns of an orthonormal basis (a small constant), then L2-normalised."""
    def without(unit: Column):
        return lambda x: let(dot(x, unit), lambda c: F.zip_with(x, unit, lambda a, b: a - c * b))

    out = v
    for u in list(basis)[:rank]:
        out = let(out, without(F.array(*(F.lit(float(x)) for x in u))))
    return let(out, normalize)


def residual_prefixes(v: Column, basis: Sequence[Sequence[float]], ranks: Sequence[int]) -> Column:
    """array<struct<rank, v>>: what is left of ``v`` without the first ``rank`` columns of an orthonormal basis, for each rank in ascending order.

    Each prefix goes on from the one before it, so all ranks together cost as much as the largest.
    """
    steps = sorted(set(ranks))
    if steps and steps[-1] > len(basis):
        raise ValueError("a rank is larger than the basis")

    def without(now: Column, at: int) -> Column:
        unit = F.array(*(F.lit(float(x)) for x in basis[at]))
        return let(dot(now, unit), lambda c: F.zip_with(now, unit, lambda a, b: a - c * b))

    def grown(done: int, now: Column, left: list[int]) -> Column:
        """The prefixes still to come, from the residual of the first ``done`` columns."""
        if done < left[0]:
            return let(without(now, done), lambda x: grown(done + 1, x, left))
        one = F.array(F.struct(F.lit(done).alias("rank"), now.alias("v")))
        return F.concat(one, grown(done, now, left[1:])) if left[1:] else one

    return grown(0, v, steps)


def cosine_basis(dim: int, rank: int) -> list[list[float]]:
    """Orthonormal columns of the discrete cosine transform: a basis that needs no fitting."""
    import math

    return [[math.sqrt((1 if k == 0 else 2) / dim) * math.cos(math.pi * (i + 0.5) * k / dim) for i in range(dim)] for k in range(rank)]
