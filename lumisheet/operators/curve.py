"""Parametric tone curve: a monotone cubic through knots (an extension)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ShapeError
from ..schema import require_channels

MAX_KNOTS = 64


@dataclass(frozen=True)
class ToneCurve:
    """Knots (input, output), sorted by input; level beyond the first and the last. Without knots a curve is the identity.

    Slopes are weighted harmonic means of the chords on both sides, zero where these differ in sign, and the chord itself at
    both ends. They meet the Fritsch-Carlson condition (at most three times either chord), so between two knots the
    curve never leaves their outputs, and rises wherever the knots do.
    """

    knots: tuple[tuple[float, float], ...]

    def __post_init__(self):
        knots = tuple(sorted((float(x), float(y)) for x, y in self.knots))
        if len({x for x, _ in knots}) < len(knots):
            raise ShapeError("two knots of a tone curve share an input")
        if len(knots) > MAX_KNOTS:
            raise ShapeError(f"{len(knots)} knots, more than {MAX_KNOTS}")
        object.__setattr__(self, "knots", knots)

    @classmethod
    def from_table(cls, df: DataFrame, x: str = "x", y: str = "y") -> ToneCurve:
        """Knots from a table of at most ``MAX_KNOTS`` rows."""
        return cls(tuple((r.x, r.y) for r in df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).limit(MAX_KNOTS + 1).collect()))

    def pieces(self) -> list[tuple[float, float, float, float, float]]:
        """Start and coefficients (constant, linear, square, cube) of each piece."""
        k = self.knots
        h = [b[0] - a[0] for a, b in zip(k, k[1:])]
        d = [(b[1] - a[1]) / w for a, b, w in zip(k, k[1:], h)]
        m = [d[0], *[self._slope(h[i], h[i + 1], d[i], d[i + 1]) for i in range(len(d) - 1)], d[-1]]
        return [(x, y, m[i], (3 * d[i] - 2 * m[i] - m[i + 1]) / h[i], (m[i] + m[i + 1] - 2 * d[i]) / (h[i] * h[i])) for i, (x, y) in enumerate(k[:-1])]

    @staticmethod
    def _slope(h0: float, h1: float, d0: float, d1: float) -> float:
        if d0 * d1 <= 0:
            return 0.0
        w0, w1 = h0 + 2 * h1, 2 * h0 + h1
        return (w0 + w1) / (w0 / d0 + w1 / d1)


def _piece(v: Column, starts: Sequence[float], first: int = 0) -> Column:
    """The last piece that starts at or before ``v``, by a tree of comparisons: log2(n) of them for each pixel."""
    if len(starts) == 1:
        return F.lit(first)
    mid = len(starts) // 2
    return F.when(v < F.lit(starts[mid]), _piece(v, starts[:mid], first)).otherwise(_piece(v, starts[mid:], first + mid))


def tone_curve(df: DataFrame, curve: ToneCurve, *channels: str) -> DataFrame:
    """Channels (``l`` if none is named) through a curve; NULL and NaN stay what they are."""
    channels = channels or ("l",)
    require_channels(df, *channels)
    if not curve.knots:
        return df
    if len(curve.knots) == 1:
        return df.withColumns({c: F.when(F.isnan(c) | F.col(c).isNull(), F.col(c)).otherwise(F.lit(curve.knots[0][1]).cast("float")) for c in channels})
    pieces = curve.pieces()
    low, high = F.lit(curve.knots[0][0]), F.lit(curve.knots[-1][0])
    held = df.withColumns({f"_v{i}": F.greatest(low, F.least(high, F.col(c).cast("double"))) for i, c in enumerate(channels)})
    found = held.withColumns({f"_p{i}": _piece(F.col(f"_v{i}"), [p[0] for p in pieces]) for i in range(len(channels))})
    table = [F.array(*[F.lit(p[k]) for p in pieces]) for k in range(5)]

    def value(i: int) -> Column:
        start, *terms = (F.get(t, F.col(f"_p{i}")) for t in table)
        x = F.col(f"_v{i}") - start
        return (((terms[3] * x + terms[2]) * x + terms[1]) * x + terms[0]).cast("float")

    return found.withColumns({c: F.when(F.isnan(c) | F.col(c).isNull(), F.col(c)).otherwise(value(i)) for i, c in enumerate(channels)}).select(*df.columns)
