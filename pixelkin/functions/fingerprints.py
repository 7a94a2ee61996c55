"""Hash and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: vectors shorter than this are left as they are.
TINY_NORM = 1e-8
# The grid that the gradient hash is read from (one more column than bits per row).
GRID_ROWS, GRID_COLUMNS = 8, 9


def content_md5(content: Column) -> Column:
    return F.md5(content)


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def gradient_hash(cells: Column) -> Column:
    """64-bit hash of a row-major 8 x 9 brightness grid.

    One bit per horizontal neighbour pair, set when brightness rises, most significant bit first.
    Null for a grid of any other size.
    """

    def bit(k: Column) -> Column:
        at = k + F.floor(k / F.lit(GRID_COLUMNS - 1)).cast("int")
        return (F.get(cells, at) < F.get(cells, at + 1)).cast("long")

    positions = F.sequence(F.lit(0), F.lit(63))
    folded = F.aggregate(positions, F.lit(0).cast("long"), lambda acc, k: F.shiftleft(acc, 1).bitwiseOR(bit(k)))
    return F.when(F.size(cells) == GRID_ROWS * GRID_COLUMNS, folded)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of normalized vectors; 0 when lengths differ or a vector is empty."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), dot(a, b)).otherwise(F.lit(0.0))


def l2_normalize(vector: Column) -> Column:
    """Unit-length vector; null for an empty one; unchanged when its norm is tiny."""
    norm = F.sqrt(dot(vector, vector))
    doubles = F.transform(vector, lambda x: x.cast("double"))
    # The norm is an argument, not part of the lambda, where it would be computed once per element.
    scaled = F.zip_with(doubles, F.array_repeat(norm, F.size(vector)), lambda x, n: x / n)
    return F.when(F.size(vector) > 0, F.when(norm < TINY_NORM, doubles).otherwise(scaled))
