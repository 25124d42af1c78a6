"""Generated patterns with known answers: (mid, a, b), each edge once.

``arrow(n)``: vertex 0 meets all others, which form a path. ``grid2d(k)`` and ``grid3d(k)``: meshes of k per side,
vertices numbered row by row. ``kkt(h, m, seed)``: a banded random block of h variables beside
m constraints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WORD = (1 << 64) - 1
#: The generator's multiplier and increment, what spreads the seed, and how far links reach.
_MULTIPLIER, _INCREMENT, _SPREAD = 6364136223846793005, 1442695040888963407, 0x9E3779B97F4A7C15
BAND = 40


def arrow(spark: SparkSession, n: int) -> DataFrame:
    ends = F.array_compact(F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")), F.when(F.col("id") + 1 < n, F.struct(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))))
    return spark.range(1, max(n, 1)).select(F.lit(f"arrow-{n}").alias("mid"), F.explode(ends).alias("e")).select("mid", "e.a", "e.b")


def _mesh(spark: SparkSession, name: str, k: int, axes: int) -> DataFrame:
    cells, steps = spark.range(k**axes), []
    for axis in range(axes):
        stride = k**axis
        steps.append(F.when(F.expr(f"(id div {stride}) % {k} < {k - 1}"), F.col("id") + stride))
    return cells.select(F.lit(name).alias("mid"), F.col("id").alias("a"), F.explode(F.array_compact(F.array(*steps))).alias("b"))


def grid2d(spark: SparkSession, k: int) -> DataFrame:
    return _mesh(spark, f"grid2d-{k}", k, 2)


def grid3d(spark: SparkSession, k: int) -> DataFrame:
    return _mesh(spark, f"grid3d-{k}", k, 3)


class Draws:
    """A 64-bit linear congruential generator; a draw is the state's upper 53 bits."""

    def __init__(self, seed: int):
        self.state = (seed * _SPREAD + 1) & _WORD

    def below(self, limit: int) -> int:
        self.state = (self.state * _MULTIPLIER + _INCREMENT) & _WORD
        return (self.state >> 11) % limit


def kkt_edges(h: int, m: int, seed: int) -> set[tuple[int, int]]:
    """Edges of a KKT-shaped pattern: h variables in a chain, each with two random links at most BAND away, then m constraints, each on 3 to 6 variables near its share of the chain. Draws follow one another, so this is a loop on the driver."""
    rng = Draws(seed)
    found = {(v, v + 1) for v in range(h - 1)}
    last = h - 1

    def nearby(v: int) -> int:
        reach = 1 + rng.below(BAND)
        return max(v - reach, 0) if rng.below(2) == 0 else min(v + reach, last)

    for v in range(h):
        found |= {(min(v, w), max(v, w)) for w in (nearby(v), nearby(v)) if w != v}
    for c in range(m):
        size = 3 + rng.below(4)
        found |= {(min(c * h // m + rng.below(2 * BAND), last), h + c) for _ in range(size)}
    return found


def kkt(spark: SparkSession, h: int, m: int, seed: int) -> DataFrame:
    rows = [(f"kkt-{h}-{m}-{seed}", a, b) for a, b in sorted(kkt_edges(h, m, seed))]
    return spark.createDataFrame(rows, "mid string, a long, b long")
