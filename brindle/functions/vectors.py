"""Column expressions over vectors and bit codes."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_of(values, kind: str = "double") -> Column:
    """A literal array."""
    return F.array(*[F.lit(float(v)) for v in values]).cast(f"array<{kind}>")


def doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed from the first component on."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def dot_literal(vec: Column, q) -> Column:
    """Inner product with a fixed vector, unrolled so that code generation sees plain arithmetic."""
    return reduce(add, [F.get(vec, F.lit(i)).cast("double") * F.lit(float(v)) for i, v in enumerate(q)])


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(vec), F.lit(0.0), lambda s, x: s + x * x))


def normalized(vec: Column) -> Column:
    """Length one; a zero vector stays."""
    n = norm(vec)
    return F.transform(doubles(vec), lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def centered(vec: Column, mean: Column, dim: int) -> Column:
    """The mean is subtracted at full width, then the first ``dim`` components are kept."""
    return F.slice(F.zip_with(doubles(vec), doubles(mean), lambda x, m: x - m), 1, dim)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words; an error if their widths differ."""
    a = F.when(F.size(a) == F.size(b), a).when(a.isNull() | b.isNull(), a).otherwise(F.raise_error(F.concat(F.lit("codes of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"), F.lit(" words"))).cast("array<bigint>"))
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def hamming_literal(code: Column, words) -> Column:
    """Differing bits from a fixed code, unrolled; ``words`` are signed 64-bit. An error if a code has another width."""
    n = len(words)
    code = F.when((F.size(code) == n) | code.isNull(), code).otherwise(F.raise_error(F.concat(F.lit(f"codes of {n} and "), F.size(code).cast("string"), F.lit(" words"))).cast("array<bigint>"))
    return reduce(add, [F.bit_count(F.get(code, F.lit(i)).bitwiseXOR(F.lit(int(w)))) for i, w in enumerate(words)])


def angular(cos: Column) -> Column:
    """(1 - cosine) in ten-thousandths, halves to even."""
    return F.rint((F.lit(1.0) - cos) * 10000).cast("int")
