"""Perceptual hashes on grids of grey values and distances between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGN = -(2**63)


def dhash(grid: Column, width: int, rows: int) -> Column:
    """Bits ``left > right`` of neighbours, row by row, first bit highest, as BIGINT. ``grid`` holds ``rows`` rows of ``width``
    values; null if it is shorter."""
    steps = F.sequence(F.lit(0), F.lit(rows * (width - 1) - 1))

    def add(acc: Column, k: Column) -> Column:
        at = (F.floor(k / (width - 1)) * width + k % (width - 1) + 1).cast("int")
        return F.shiftleft(acc, 1).bitwiseOR(F.when(F.element_at(grid, at) > F.element_at(grid, at + 1), F.lit(1)).otherwise(F.lit(0)).cast("bigint"))

    return F.when(F.size(grid) >= width * rows, F.aggregate(steps, F.lit(0).cast("bigint"), add))


def dihedral(grid: Column, n: int) -> list[Column]:
    """The 8 turned and mirrored forms of an n x n grid."""
    places = [lambda r, c: (r, c), lambda r, c: (n - 1 - c, r), lambda r, c: (n - 1 - r, n - 1 - c), lambda r, c: (c, n - 1 - r)]
    out = []
    for mirrored in (False, True):
        for place in places:
            cells = [place(r, n - 1 - c if mirrored else c) for r in range(n) for c in range(n)]
            out.append(F.array(*[F.element_at(grid, r * n + c + 1) for r, c in cells]))
    return out


def canonical_hash(grid: Column, n: int = 9) -> Column:
    """The least dHash, as an unsigned number, of the first n - 1 rows of all 8 forms of an n x n grid; null for a null or shorter one."""
    hashes = [dhash(g, n, n - 1).bitwiseXOR(F.lit(SIGN)) for g in dihedral(grid, n)]
    return F.when(F.size(grid) >= n * n, F.least(*hashes).bitwiseXOR(F.lit(SIGN)))


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits."""
    return F.bit_count(a.bitwiseXOR(b))
