"""The pitch: marks, areas, resolution grid, scale audits, annotation fixes."""

from __future__ import annotations

import functools
import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn


@dataclass(frozen=True)
class Pitch:
    """Size and regulation marks in metres."""

    length: float = 100.0
    width: float = 64.0
    area_depth: float = 16.5
    area_half: float = 20.16
    small_depth: float = 5.5
    small_half: float = 9.16
    circle: float = 9.15
    spot: float = 11.0
    goal_half: float = 3.66

    def areas(self, margin: float = 0.0) -> list[tuple[float, float, float, float]]:
        """Both penalty areas as (x1, y1, x2, y2)."""
        y1, y2 = self.width / 2 - self.area_half - margin, self.width / 2 + self.area_half + margin
        return [(-margin, y1, self.area_depth + margin, y2), (self.length - self.area_depth - margin, y1, self.length + margin, y2)]

    def points(self) -> dict[str, tuple[float, float]]:
        """Named points that can be clicked."""
        half = self.width / 2
        out = {"centre": (self.length / 2, half), "corner_00": (0.0, 0.0), "corner_01": (0.0, self.width), "corner_10": (self.length, 0.0), "corner_11": (self.length, self.width), "middle_0": (self.length / 2, 0.0), "middle_1": (self.length / 2, self.width), "circle_0": (self.length / 2, half - self.circle), "circle_1": (self.length / 2, half + self.circle)}
        for side, (x, sign) in enumerate(((0.0, 1), (self.length, -1))):
            out[f"spot_{side}"] = (x + sign * self.spot, half)
            for name, depth, reach in (("area", self.area_depth, self.area_half), ("small", self.small_depth, self.small_half)):
                for k, s in enumerate((-1, 1)):
                    out[f"{name}_{side}_goal_{k}"] = (x, half + s * reach)
                    out[f"{name}_{side}_front_{k}"] = (x + sign * depth, half + s * reach)
        return out

    def lines(self) -> list[tuple[float, float, float, float]]:
        """Straight lines as (x1, y1, x2, y2)."""
        c = [(0.0, 0.0), (self.length, 0.0), (self.length, self.width), (0.0, self.width)]
        out = [(*a, *b) for a, b in zip(c, c[1:] + c[:1], strict=True)] + [(self.length / 2, 0.0, self.length / 2, self.width)]
        half = self.width / 2
        for x, sign in ((0.0, 1), (self.length, -1)):
            for depth, reach in ((self.area_depth, self.area_half), (self.small_depth, self.small_half)):
                front = x + sign * depth
                out += [(x, half - reach, front, half - reach), (front, half - reach, front, half + reach), (front, half + reach, x, half + reach)]
        return out

    def arc(self, centre: tuple[float, float], radius: float, n: int = 64) -> list[tuple[float, float]]:
        return [(centre[0] + radius * math.cos(2 * math.pi * i / n), centre[1] + radius * math.sin(2 * math.pi * i / n)) for i in range(n)]


FORMATS = {"f11": Pitch(), "f7": Pitch(60.0, 40.0, 9.0, 14.0, 3.0, 7.0, 6.0, 9.0, 3.0)}


def points_table(spark: SparkSession, pitch: Pitch) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in pitch.points().items()], "name string, x_m double, y_m double")


def inverse(h: fn.Homography) -> list[list[float]]:
    (a, b, c), (d, e, f), (g, i, j) = h
    co = [[e * j - f * i, c * i - b * j, b * f - c * e], [f * g - d * j, a * j - c * g, c * d - a * f], [d * i - e * g, b * g - a * i, a * e - b * d]]
    det = a * co[0][0] + b * co[1][0] + c * co[2][0]
    return [[x / det for x in row] for row in co]


def resolution_grid(spark: SparkSession, h: fn.Homography, pitch: Pitch, step: float = 2.0) -> DataFrame:
    """Metres a pixel at each node of a lattice, and how many times worse than at the best node."""
    nx, ny = max(int(pitch.length / step) + 1, 2), max(int(pitch.width / step) + 1, 2)
    nodes = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("i"), F.floor(F.col("id") / nx).cast("int").alias("j"))
    nodes = nodes.withColumns({"x": F.col("i") * (pitch.length / (nx - 1)), "y": F.col("j") * (pitch.width / (ny - 1))})
    u, v = fn.project(F.col("x"), F.col("y"), inverse(h))
    far = []
    for du, dv in ((1.0, 0.0), (0.0, 1.0)):
        x, y = fn.project(u + du, v + dv, h)
        far.append(F.sqrt((x - F.col("x")) ** 2 + (y - F.col("y")) ** 2))
    grid = nodes.select("i", "j", F.greatest(*far).alias("mpp"))
    return grid.crossJoin(F.broadcast(grid.agg(F.min("mpp").alias("best")))).select("i", "j", "mpp", (F.col("mpp") / F.col("best")).alias("factor"))


def with_resolution(rows: DataFrame, grid: DataFrame, pitch: Pitch, step: float = 2.0, jitter_px: float = 2.0, dt: float = 0.12) -> DataFrame:
    """Rows with the resolution of their nearest node (halves to even, clamped to the pitch) and the speed that jitter feigns there."""
    nx, ny = max(int(pitch.length / step) + 1, 2), max(int(pitch.width / step) + 1, 2)
    at = lambda c, n: F.least(F.greatest(F.bround(F.col(c) / step), F.lit(0)), F.lit(n - 1)).cast("int")
    return rows.withColumns({"i": at("x_m", nx), "j": at("y_m", ny)}).join(F.broadcast(grid), ["i", "j"]).drop("i", "j").withColumn("noise_v", F.col("mpp") * (jitter_px / dt))


def scale_audit(marked: DataFrame, spark: SparkSession, pitch: Pitch) -> DataFrame:
    """Measured distances between named points against the regulation's."""
    p = points_table(spark, pitch)
    m = marked.select("name", F.col("x_m").alias("mx"), F.col("y_m").alias("my")).join(p, "name")
    a, b = (m.select(*(F.col(c).alias(f"{s}_{c}") for c in m.columns)) for s in ("a", "b"))
    d = lambda x, y: F.sqrt((F.col(f"a_{x}") - F.col(f"b_{x}")) ** 2 + (F.col(f"a_{y}") - F.col(f"b_{y}")) ** 2)
    return a.join(b, F.col("a_name") < F.col("b_name")).select("a_name", "b_name", fn.rounded(d("mx", "my")).alias("measured_m"), fn.rounded(d("x_m", "y_m")).alias("true_m"))


def reprojection_error(points: DataFrame, h: fn.Homography) -> DataFrame:
    """Distance in metres of projected clicks (``px, py``) from their true places."""
    x, y = fn.project(F.col("px"), F.col("py"), h)
    return points.select("name", fn.rounded(F.sqrt((x - F.col("x_m")) ** 2 + (y - F.col("y_m")) ** 2)).alias("error_m"))


def least_squares_homographies(px: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For each set of pixels (sets x n x 2) the homography that takes them to metres at the least algebraic error, both scaled to unit spread first; not a number if the points are on a line."""

    def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centre = x.mean(1)
        scale = 2**0.5 / np.maximum(np.sqrt(((x - centre[:, None]) ** 2).sum(2)).mean(1), 1e-12)
        t = np.zeros((len(x), 3, 3))
        t[:, 0, 0] = t[:, 1, 1] = scale
        t[:, :2, 2], t[:, 2, 2] = -scale[:, None] * centre, 1
        return np.concatenate([x, np.ones_like(x[:, :, :1])], 2) @ t.transpose(0, 2, 1), t

    (a, ta), (b, tb) = unit(px), unit(m)
    zero = np.zeros_like(a)
    rows = np.concatenate([np.concatenate([a, zero, -b[:, :, :1] * a], 2), np.concatenate([zero, a, -b[:, :, 1:2] * a], 2)], 1)
    _, sizes, v = np.linalg.svd(rows)
    h = np.linalg.inv(tb) @ v[:, -1].reshape(-1, 3, 3) @ ta
    none = np.abs(h[:, 2, 2]) <= 1e-12
    if sizes.shape[1] >= 8:
        none |= sizes[:, 7] < 1e-9 * sizes[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(none[:, None, None], np.nan, h / h[:, 2:, 2:])


def least_squares_homography(px: np.ndarray, m: np.ndarray) -> np.ndarray | None:
    """The same for one set (n x 2); none if the points are on a line."""
    h = least_squares_homographies(px[None], m[None])[0]
    return None if np.isnan(h).any() else h


@functools.lru_cache
def _fours(n: int, trials: int) -> np.ndarray:
    """All fours of ``n`` clicks, or ``trials`` of them by a fixed seed."""
    if math.comb(n, 4) <= trials:
        return np.array(list(itertools.combinations(range(n), 4)), int).reshape(-1, 4)
    return np.array([np.random.default_rng(7 + i).choice(n, 4, replace=False) for i in range(trials)])


def _consensus(px: np.ndarray, m: np.ndarray, most_m: float, trials: int) -> tuple[list[float], int, int, float] | None:
    """``h``, ``inliers``, ``clicks`` and ``error_m`` of a camera's clicks (n x 2)."""

    def errors(h: np.ndarray) -> np.ndarray:
        at = np.c_[px, np.ones(len(px))] @ h.swapaxes(-1, -2)
        with np.errstate(divide="ignore", invalid="ignore"):
            d = at[..., :2] / at[..., 2:] - m
            return np.nan_to_num(np.hypot(d[..., 0], d[..., 1]), nan=np.inf)

    fours = _fours(len(px), trials)
    if not len(fours):
        return None
    e = errors(least_squares_homographies(px[fours], m[fours]))
    near = e <= most_m
    agree = near.sum(1)
    if agree.max() < 4:
        return None
    near = near[min(np.flatnonzero(agree == agree.max()), key=lambda i: e[i, near[i]].sum())]
    h = least_squares_homography(px[near], m[near])
    return None if h is None else (h.ravel().tolist(), int((errors(h) <= most_m).sum()), len(px), float(errors(h)[near].mean()))


def fit_homography(clicks: DataFrame, most_m: float = 1.0, key: list[str] | None = None, trials: int = 500, each: str | None = None) -> DataFrame:
    """A homography for each camera of ``key`` from clicks (``name, px, py, x_m, y_m``): ``h`` (nine numbers by rows), ``inliers``, ``clicks``, ``error_m``.

    Consensus: of the fits to four clicks the one that most clicks agree with to
    ``most_m`` metres (of equals the least error), fitted again to all of these. Clicks
    of a camera are a few dozen; all fours are tried, or ``trials`` of them by a
    fixed seed, in one array operation. Fewer than four clicks, or none that fit, give
    no row. ``each``: a camera's clicks are there several times, and each value of this
    column gets a fit of its own.
    """
    own = key or []
    by = [*own, each] if each else own

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([each, "name"] if each else "name")
        px, m, names = g[["px", "py"]].to_numpy(float), g[["x_m", "y_m"]].to_numpy(float), g[by].to_numpy(object)
        ends = np.cumsum(g.groupby(each, dropna=False).size()).tolist() if each else [len(g)]
        rows = []
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            if (found := _consensus(px[a:b], m[a:b], most_m, trials)) is not None:
                rows.append((*names[a], *found))
        return pd.DataFrame(rows, columns=[*by, "h", "inliers", "clicks", "error_m"])

    schema = T.StructType([*(clicks.schema[c] for c in by), T.StructField("h", T.ArrayType(T.DoubleType())), T.StructField("inliers", T.IntegerType()), T.StructField("clicks", T.IntegerType()), T.StructField("error_m", T.DoubleType())])
    return clicks.groupBy(*own).applyInPandas(run, schema)


def edge_clicks(clicks: DataFrame, width: int, height: int, margin: float = 2.0) -> DataFrame:
    """Clicks within ``margin`` pixels of the image's border: their true place may lie outside it."""
    return clicks.where((F.col("px") <= margin) | (F.col("py") <= margin) | (F.col("px") >= width - 1 - margin) | (F.col("py") >= height - 1 - margin))


def _noise(*by: Column | str, seed: int) -> tuple[Column, Column]:
    """Two independent normal numbers that depend on ``by`` only, not on how rows are spread."""
    u = [(F.pmod(F.xxhash64(*by, F.lit(seed), F.lit(i)), F.lit(1 << 52)) + 0.5) / float(1 << 52) for i in (0, 1)]
    size = F.sqrt(-2 * F.log(u[0]))
    return size * F.cos(2 * math.pi * u[1]), size * F.sin(2 * math.pi * u[1])


def _through(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A place through a homography that is an array of nine numbers by rows."""
    row = lambda i: F.get(h, F.lit(3 * i)) * x + F.get(h, F.lit(3 * i + 1)) * y + F.get(h, F.lit(3 * i + 2))
    return row(0) / row(2), row(1) / row(2)


def _back(h: Column) -> Column:
    """The inverse up to its scale, which does not matter to places."""
    a, b, c, d, e, f, g, i, j = (F.get(h, F.lit(k)) for k in range(9))
    return F.array(e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d)


def click_stability(clicks: DataFrame, places: list[tuple[float, float]], noise_px: float = 2.0, trials: int = 300, most_m: float = 5.0, fours: int = 60, seed: int = 0, key: list[str] | None = None) -> DataFrame:
    """How far each of ``places`` (metres) moves when the clicks of a camera shake: ``x_m, y_m, moved_m`` and the number of ``fits``.

    A row is a click in a trial. Each trial has a fit of its own by consensus, all of a camera in one group; a place
    goes to its pixel by the fit of the clicks as they are, and back by the trial's.
    moved_m: median distance from the mean of the trials, so it tells spread, not bias.
    Trials and cameras without a fit give no row.
    """
    own = key or []
    on = [*own, "_one"]
    clicks = clicks.withColumn("_one", F.lit(0))
    u, v = _noise(*on, "name", "_trial", seed=seed)
    shaken = clicks.withColumn("_trial", F.explode(F.sequence(F.lit(1), F.lit(trials)))).withColumns({"px": F.col("px") + noise_px * u, "py": F.col("py") + noise_px * v})
    pixel = _through(_back(F.col("h")), F.col("_p.x"), F.col("_p.y"))
    listed = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(i).alias("i")) for i, (x, y) in enumerate(places)))
    targets = fit_homography(clicks, most_m, on, fours).select(*on, "h", F.explode(listed).alias("_p")).select(*on, "_p", pixel[0].alias("_u"), pixel[1].alias("_v"))
    fits = fit_homography(shaken, most_m, on, fours, "_trial").select(*(F.col(c).alias(f"_f_{c}") for c in on), "_trial", "h")
    at = _through(F.col("h"), F.col("_u"), F.col("_v"))
    moved = targets.join(fits, [targets[c].eqNullSafe(fits[f"_f_{c}"]) for c in on]).select(*on, "_trial", "_p", at[0].alias("_x"), at[1].alias("_y"))
    w = W.partitionBy(*on, "_p")
    away = F.sqrt((F.col("_x") - F.avg("_x").over(w)) ** 2 + (F.col("_y") - F.avg("_y").over(w)) ** 2)
    return moved.withColumn("_away", away).groupBy(*on, "_p").agg(F.median("_away").alias("moved_m"), F.count("*").alias("fits")).select(*own, F.col("_p.x").alias("x_m"), F.col("_p.y").alias("y_m"), "moved_m", "fits")


def image_band(spark: SparkSession, h: fn.Homography, x1: float, x2: float, y1: float, y2: float, n: int = 25) -> DataFrame:
    """Rows of the image that a rectangle of the pitch covers."""
    i = spark.range(n * n).select((F.col("id") % n).alias("a"), F.floor(F.col("id") / n).alias("b"))
    u, v = fn.project(x1 + F.col("a") * ((x2 - x1) / (n - 1)), y1 + F.col("b") * ((y2 - y1) / (n - 1)), inverse(h))
    return i.select(u.alias("u"), v.alias("v")).agg(fn.rounded(F.min("v"), 4).alias("top"), fn.rounded(F.max("v"), 4).alias("bottom"), fn.rounded(F.min("u"), 4).alias("left"), fn.rounded(F.max("u"), 4).alias("right"))


def visible_field(spark: SparkSession, h: fn.Homography, width: int, height: int, pitch: Pitch, step: float = 2.0) -> DataFrame:
    """For each line across the pitch, the part that the camera sees."""
    nx, ny = int(pitch.length / step) + 1, int(pitch.width / step) + 1
    n = spark.range(nx * ny).select(((F.col("id") % nx) * step).alias("x"), (F.floor(F.col("id") / nx) * step).alias("y"))
    u, v = fn.project(F.col("x"), F.col("y"), inverse(h))
    return n.where(u.between(0, width) & v.between(0, height)).groupBy("y").agg(F.min("x").alias("from_x"), F.max("x").alias("to_x"))


def input_checks(dets: DataFrame, width: int, height: int, least_px: float = 25.0, most_cut: float = 0.5, border: float = 2.0) -> DataFrame:
    """Whether people are tall enough in the image, and how many boxes its border cuts."""
    cut = (F.col("x1") <= border) | (F.col("y1") <= border) | (F.col("x2") >= width - border) | (F.col("y2") >= height - border)
    s = dets.agg(F.median(F.col("y2") - F.col("y1")).alias("median_px"), fn.rounded(F.avg(cut.cast("int"))).alias("cut"))
    return s.select("median_px", "cut", (F.col("median_px") < least_px).alias("small"), (F.col("cut") >= most_cut).alias("cropped"))


def corrected_clicks(clicks: DataFrame, dets: DataFrame, reach_px: float = 40.0, share: float = 0.129) -> DataFrame:
    """Clicks (``frame, obj_id, px, py``) moved down by a share of the height of the nearest box within reach, else of the median height."""
    d = dets.select(F.col("frame").alias("d_frame"), ((F.col("x1") + F.col("x2")) / 2).alias("fx"), F.col("y2").alias("fy"), (F.col("y2") - F.col("y1")).alias("h"))
    away = F.sqrt((F.col("px") - F.col("fx")) ** 2 + (F.col("py") - F.col("fy")) ** 2)
    near = clicks.join(d, (F.col("frame") == F.col("d_frame")) & (away <= reach_px), "left").groupBy(*clicks.columns).agg(F.min_by("h", F.struct(away, F.col("h"))).alias("h"))
    usual = dets.agg(F.median(F.col("y2") - F.col("y1")).alias("usual"))
    return near.crossJoin(F.broadcast(usual)).select("frame", "obj_id", "px", (F.col("py") + share * F.coalesce("h", "usual")).alias("py"))


def outliers(rows: DataFrame, by: str, value: str, n: int) -> DataFrame:
    """The n largest values of each group."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(F.desc(value)))).where(F.col("_r") <= n).drop("_r")
