"""Random numbers that depend on the row and not on where it is computed.

``rand(seed)`` depends on the partition a row sits in, so a lost executor or
another cluster size can change the outcome. Here one digest of the row id gives
a seed of two 30-bit halves, and every draw is a linear function of both modulo a
prime, with its own coefficients. Any two streams are independent of one another (three
are not: their draws are linearly dependent modulo the prime), a draw
costs a few integer operations inside generated code, and reruns, retries, any
partitioning and any SQL engine with md5 give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = "_seed"

# The Mersenne prime 2**31 - 1 and generators of well-known multiplicative sequences modulo it.
PRIME = 2147483647
GENERATORS = (48271, 69621, 16807)
HALF_BITS, HALF_MASK = 30, 2**30 - 1
#: A draw below a bound takes two streams, so that large bounds are drawn evenly; the second lies this far away.
SECOND_STREAM = 5000


def coefficients(stream: int) -> tuple[int, int, int]:
    """The factors of both seed halves and the shift of one stream."""
    a, b, c = (pow(generator, stream + 1, PRIME) for generator in GENERATORS)
    return a, b, c


def seeded(df: DataFrame, row_id: str) -> DataFrame:
    """Add the seed of every row, unless it has one; drop it with ``unseeded``."""
    if SEED in df.columns:
        return df
    digest = F.md5(F.col(f"`{row_id}`").cast("string").cast("binary"))
    return df.withColumn(SEED, F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"))


def unseeded(df: DataFrame) -> DataFrame:
    return df.drop(SEED)


def draw(stream: int) -> Column:
    """A bigint in [0, PRIME) for this stream of a seeded row."""
    a, b, c = coefficients(stream)
    low, high = F.col(SEED).bitwiseAND(F.lit(HALF_MASK)), F.shiftright(F.col(SEED), HALF_BITS)
    return ((low * a) % PRIME + (high * b) % PRIME + F.lit(c)) % PRIME


def uniform(stream: int) -> Column:
    """A double in [0, 1)."""
    return draw(stream) / F.lit(PRIME)


def below(stream: int, bound: int) -> Column:
    """A bigint in [0, bound)."""
    return (draw(stream) * PRIME + draw(stream + SECOND_STREAM)) % F.lit(bound).cast("bigint")


def normal(stream: int) -> Column:
    """A standard normal double from this stream and the next."""
    radius = F.sqrt(F.lit(-2.0) * F.ln((draw(stream) + F.lit(1)) / F.lit(PRIME)))
    return radius * F.cos(F.lit(6.283185307179586) * uniform(stream + 1))


def chance(stream: int, rate: float) -> Column:
    """True for the given share of rows, decided on integers."""
    return draw(stream) < F.lit(int(rate * PRIME))


def pick(stream: int, values: list[str] | tuple[str, ...]) -> Column:
    """One of a short list, each equally likely."""
    options = F.array(*[F.lit(value) for value in values])
    return F.get(options, below(stream, len(values)).cast("int"))
