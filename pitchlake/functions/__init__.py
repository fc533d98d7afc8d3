"""Column functions: geometry, uncertainty, vectors, boxes. All stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Homography = Sequence[Sequence[float]]


def rounded(value: Column, digits: int = 6) -> Column:
    """Half-up at a digit by ``floor``, which engines agree on (``round`` differs)."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def project(u: Column, v: Column, h: Homography) -> tuple[Column, Column]:
    """A pixel in pitch metres."""
    w = h[2][0] * u + h[2][1] * v + h[2][2]
    return (h[0][0] * u + h[0][1] * v + h[0][2]) / w, (h[1][0] * u + h[1][1] * v + h[1][2]) / w


def ground_scales(u: Column, v: Column, h: Homography) -> tuple[Column, Column]:
    """Metres a pixel, sideways and in depth: singular values of the homography's Jacobian; null on the horizon.

    The Jacobian's entries are linear in the pixel over the square of the
    denominator, so the squares add up to few terms.
    """
    (a, b, c), (d, e, f), (g, i, j) = h
    n = g * u + i * v + j
    # numerators of the four entries; the terms in u (or v) cancel
    xu, xv = (a * i - b * g) * v + (a * j - c * g), (b * g - a * i) * u + (b * j - c * i)
    yu, yv = (d * i - e * g) * v + (d * j - f * g), (e * g - d * i) * u + (e * j - f * i)
    squares = F.struct((xu * xu + xv * xv + yu * yu + yv * yv).alias("s"), (xu * yv - xv * yu).alias("d"), (n * n).alias("n2"), (F.abs(n) >= 1e-12).alias("ok"))

    def of(sign: float) -> Column:
        # a one-element array names the pieces, so they are computed once
        def value(p: Column) -> Column:
            root = F.sqrt(F.greatest(p["s"] * p["s"] - 4 * p["d"] * p["d"], F.lit(0.0)))
            return F.when(p["ok"], F.sqrt(F.greatest((p["s"] + sign * root) / 2, F.lit(0.0))) / p["n2"])

        return F.get(F.transform(F.array(squares), value), F.lit(0))

    return of(-1.0), of(1.0)


def implied_size(x1: Column, y1: Column, x2: Column, y2: Column, h: Homography) -> tuple[Column, Column]:
    """Height and width in metres of a box that stands on the ground."""
    lateral, _ = ground_scales((x1 + x2) / 2, y2, h)
    return (y2 - y1) * lateral, (x2 - x1) * lateral


def match_threshold(y: Column, base: float = 0.4, slope: float = 0.045, low: float = 1.0, high: float = 4.0) -> Column:
    """How far a detection may be from the truth at a depth."""
    return F.least(F.greatest(base + slope * y, F.lit(low)), F.lit(high))


def position_sigma(y: Column, base: float = 0.11, slope: float = 0.026, low: float = 0.11, high: float = 1.85) -> Column:
    return F.least(F.greatest(base + slope * y, F.lit(low)), F.lit(high))


def search_radius(dt: Column, y: Column, v_max: float = 7.0, k_sigma: float = 2.0) -> Column:
    """Metres a player can have gone in ``dt`` seconds, and what the projection adds."""
    return v_max * dt + k_sigma * position_sigma(y)


def geometry_weight(dt: Column, y: Column, v_drift: float = 1.5, appearance_sigma: float = 1.0) -> Column:
    """Share of geometry in a mixed cost, by inverse variances."""
    variance = position_sigma(y) ** 2 + (v_drift * dt) ** 2
    geometry = 1.0 / F.greatest(variance, F.lit(1e-9))
    return geometry / (geometry + 1.0 / max(appearance_sigma**2, 1e-9))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, 0 for equal directions; tiny norms are safe."""
    return 1.0 - dot(a, b) / ((norm(a) + 1e-9) * (norm(b) + 1e-9))


def mixed_cost(distance: Column, dt: Column, y: Column, appearance: Column | None = None) -> Column:
    """Cost of a match, infinite beyond the search radius; appearance (a cosine distance) may be null."""
    radius = search_radius(dt, y)
    geometry = distance / F.greatest(radius, F.lit(1e-9))
    cost = geometry
    if appearance is not None:
        alpha = geometry_weight(dt, y)
        cost = F.when(appearance.isNull(), geometry).otherwise(alpha * geometry + (1.0 - alpha) * F.least(F.lit(1.0), appearance))
    return F.when(distance > radius, F.lit(float("inf"))).otherwise(cost)


def iou(a: Sequence[Column], b: Sequence[Column], guard: float = 0.0) -> Column:
    """Overlap of two boxes (x1, y1, x2, y2). guard: added to the union; without it an empty union gives 0."""
    width = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    height = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    inter = width * height
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    if guard:
        return inter / (union + guard)
    return F.when(union > 0, inter / union).otherwise(0.0)


def edge_distance(x: Column, y: Column, length: float, width: float) -> Column:
    """Largest distance beyond an edge of the pitch; negative inside."""
    return F.greatest(-x, x - length, -y, y - width)


def outside_distance(x: Column, y: Column, length: float, width: float) -> Column:
    return F.greatest(edge_distance(x, y, length, width), F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def in_polygon(x: Column, y: Column, vertices: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule over the polygon's edges."""
    inside = F.lit(False)
    for (x0, y0), (x1, y1) in zip(vertices, [*vertices[1:], vertices[0]], strict=True):
        if y0 == y1:
            continue
        crosses = (F.lit(y0) > y) != (F.lit(y1) > y)
        hit = crosses & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
        inside = inside != hit
    return inside


def wilson_lower(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Lower end of the 95 % interval of a share; 0 without trials."""
    p = hits / n
    centre = p + z * z / (2 * n)
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return F.when(n > 0, F.greatest((centre - spread) / (1 + z * z / n), F.lit(0.0))).otherwise(0.0)


def depth_value(x: Column, y: Column, axis: str = "y", growing: bool = True, limit: float = 0.0) -> Column:
    """Distance from the camera along its axis of depth."""
    value = x if axis == "x" else y
    return value if growing else limit - value


def dominant_bin(feature: Column, bins: int) -> tuple[Column, Column]:
    """Row and column of the first largest value of a bins x bins histogram laid out by rows."""
    at = F.array_position(feature, F.array_max(feature)).cast("int") - 1
    return F.floor(at / bins).cast("int"), at % bins


def hue_saturation(feature: Column, bins: int = 16, hues: float = 180.0, levels: float = 256.0) -> tuple[Column, Column]:
    """Centre of the dominant bin of a hue-saturation histogram."""
    row, column = dominant_bin(F.slice(feature, 1, bins * bins), bins)
    return (row + 0.5) * (hues / bins), (column + 0.5) * (levels / bins)


def brightness(feature: Column, first: int = 257, bins: int = 16, levels: float = 256.0) -> Column:
    """Mean of a brightness histogram's bin centres, by weight; null if it is empty."""
    block = F.slice(feature, first, bins)
    weight = F.aggregate(block, F.lit(0.0), lambda s, x: s + x)
    centres = F.array(*(F.lit((i + 0.5) * levels / bins) for i in range(bins)))
    return F.when(weight > 0, dot(block, centres) / weight)


def unit(vector: Column) -> Column:
    """A vector of length 1; the zero vector stays."""
    size = norm(vector)
    return F.transform(vector, lambda x: F.when(size > 0, x / size).otherwise(x.cast("double")))


def pixels_per_metre(u: Column, v: Column, h: Homography) -> Column:
    """Pixels a metre sideways at a ground point."""
    lateral, _ = ground_scales(u, v, h)
    return F.when(lateral > 0, 1.0 / lateral)


def relative_size(side_px: Column, u: Column, v: Column, h: Homography, diameter: float = 0.22) -> Column:
    """A ball's side over what a ball on the ground there would measure."""
    return side_px / (diameter * pixels_per_metre(u, v, h))


def savitzky_golay_weights(window: int) -> list[float]:
    """Weights of a parabola's least-squares value at the middle of an odd window."""
    half = window // 2
    k = range(-half, half + 1)
    s0, s2, s4 = window, sum(i * i for i in k), sum(i**4 for i in k)
    det = s0 * s4 - s2 * s2
    return [(s4 - s2 * i * i) / det for i in k]


def team_group(label: Column) -> Column:
    """A or B for players and keepers, null for anybody else."""
    bare = F.regexp_replace(label, "^portero_", "")
    return F.when(bare.isin("A", "B"), bare)


def clock(seconds: Column) -> Column:
    """Minutes and seconds, mm:ss."""
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("int"), (F.floor(seconds) % 60).cast("int"))


def degrees(cosine: Column) -> Column:
    return F.acos(clamp(cosine, -1.0, 1.0)) * (180.0 / math.pi)
