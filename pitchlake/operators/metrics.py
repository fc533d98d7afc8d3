"""Collective metrics of positions, and what reports and replays show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import functions as fn
from . import islands, scans
from .lineage import saved

LENGTH, WIDTH = 100.0, 64.0


def of_teams(rows: DataFrame) -> DataFrame:
    """Rows of the two teams; keepers belong to theirs, referees and staff to none."""
    return rows.where(F.col("equipo").isin(0, 1))


def players(rows: DataFrame) -> DataFrame:
    return of_teams(rows).where(~F.col("etiqueta").startswith("portero_"))


def summary(rows: DataFrame, by: list[str] | None = None, length: float = LENGTH) -> DataFrame:
    """Rows, identities, frames, centroid, spread (twice the sample deviation) and thirds."""
    x = F.col("x_m")
    share = lambda cond: 100.0 * F.sum(cond.cast("int")) / F.count("*")
    return of_teams(rows).groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.countDistinct("id_jugador").alias("ids"), F.countDistinct("frame").alias("frames"),
        fn.rounded(F.avg("x_m")).alias("x_m"), fn.rounded(F.avg("y_m")).alias("y_m"),
        fn.rounded(2 * F.stddev_samp("y_m")).alias("width_m"), fn.rounded(2 * F.stddev_samp("x_m")).alias("depth_m"),
        fn.rounded(share(x < length / 3)).alias("left_pct"), fn.rounded(share((x >= length / 3) & (x < 2 * length / 3))).alias("middle_pct"), fn.rounded(share(x >= 2 * length / 3)).alias("right_pct"),
    )


def heatmap(rows: DataFrame, nx: int = 16, ny: int = 10, length: float = LENGTH, width: float = WIDTH) -> DataFrame:
    """Counts of a grid. Coordinates are cut towards zero, so slightly negative ones fall in the first cell."""
    cell = lambda v, size, n: F.least((v / size * n).cast("int"), F.lit(n - 1))
    return of_teams(rows).select(cell(F.col("x_m"), length, nx).alias("cx"), cell(F.col("y_m"), width, ny).alias("cy")).where("cx >= 0 and cy >= 0").groupBy("cx", "cy").agg(F.count("*").alias("n"))


def fine_heatmap(rows: DataFrame, step: float = 2.0, sigma: float = 1.6, length: float = LENGTH, width: float = WIDTH) -> DataFrame:
    """A grid of ``step`` metres smoothed by a Gaussian stencil with reflected edges, 1 at its maximum."""
    import math

    nx, ny = int(length / step), int(width / step)
    reach = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(weights)
    counts = heatmap(rows, nx, ny, length, width)
    spark = rows.sparkSession
    kernel = spark.createDataFrame([(k, w / total) for k, w in zip(range(-reach, reach + 1), weights, strict=True)], "k int, w double")

    def spread(df: DataFrame, axis: str, n: int) -> DataFrame:
        at = F.pmod(F.col(axis) + F.col("k"), F.lit(2 * n))
        return df.crossJoin(F.broadcast(kernel)).withColumn(axis, F.when(at < n, at).otherwise(2 * n - 1 - at).cast("int")).groupBy("cx", "cy").agg(F.sum(F.col("v") * F.col("w")).alias("v"))

    smooth = spread(spread(counts.select("cx", "cy", F.col("n").cast("double").alias("v")), "cx", nx), "cy", ny)
    top = smooth.agg(F.max("v").alias("top"))
    return smooth.crossJoin(F.broadcast(top)).select("cx", "cy", fn.rounded(F.col("v") / F.col("top")).alias("heat"))


def orientation(rows: DataFrame, length: float = LENGTH) -> DataFrame:
    """``equipo, own_goal_x``: the end of the pitch nearest to the keeper's median; teams without a keeper are missing."""
    keepers = of_teams(rows).where(F.col("etiqueta").startswith("portero_"))
    return keepers.groupBy("equipo").agg(F.median("x_m").alias("m")).select("equipo", F.when(F.col("m") < length / 2, 0.0).otherwise(length).alias("own_goal_x"))


def heights(rows: DataFrame, length: float = LENGTH) -> DataFrame:
    """Field players with ``height``, the distance to their own goal line."""
    return players(rows).join(F.broadcast(orientation(rows, length)), "equipo").withColumn("height", F.abs(F.col("x_m") - F.col("own_goal_x")))


def lines(rows: DataFrame, defenders: int = 4, attackers: int = 3, length: float = LENGTH) -> DataFrame:
    """Defensive line, attacking line and block of each frame and team with enough players."""
    w = W.partitionBy("frame", "equipo")
    ranked = heights(rows, length).withColumns({"low": F.row_number().over(w.orderBy("height", "id_jugador")), "n": F.count("*").over(w)})
    ranked = ranked.where(F.col("n") >= defenders + attackers)
    return ranked.groupBy("frame", "equipo").agg(
        fn.rounded(F.avg(F.when(F.col("low") <= defenders, F.col("height")))).alias("defence_m"),
        fn.rounded(F.avg(F.when(F.col("low") > F.col("n") - attackers, F.col("height")))).alias("attack_m"),
        fn.rounded(F.avg("height")).alias("block_m"),
    )


def team_lines(rows: DataFrame, **kw) -> DataFrame:
    """Means over frames of the lines, and the distance between them."""
    return lines(rows, **kw).groupBy("equipo").agg(fn.rounded(F.avg("defence_m"), 5).alias("defence_m"), fn.rounded(F.avg("block_m"), 5).alias("block_m"), fn.rounded(F.avg(F.col("attack_m") - F.col("defence_m")), 5).alias("between_m"), F.count("*").alias("frames"))


def territory(rows: DataFrame, length: float = LENGTH, width: float = WIDTH) -> DataFrame:
    """Thirds relative to the own goal and lanes across, in per cent of a team's rows."""
    share = lambda cond: fn.rounded(100.0 * F.sum(cond.cast("int")) / F.count("*"))
    h, y = F.col("height"), F.col("y_m")
    return heights(rows, length).groupBy("equipo").agg(
        share(h < length / 3).alias("own_third"), share((h >= length / 3) & (h < 2 * length / 3)).alias("middle_third"), share(h >= 2 * length / 3).alias("far_third"),
        share(y < width / 3).alias("near_lane"), share((y >= width / 3) & (y < 2 * width / 3)).alias("central_lane"), share(y >= 2 * width / 3).alias("far_lane"),
    )


def lateral_shift(rows: DataFrame, window: int) -> DataFrame:
    """Mean y of a team at each instant, averaged over a centred window that shrinks at the ends (an even one looks further back)."""
    mean = players(rows).groupBy("equipo", "tiempo_s").agg(fn.rounded(F.avg("y_m")).alias("y"))
    w = W.partitionBy("equipo").orderBy("tiempo_s").rowsBetween(-(window // 2), (window - 1) // 2)
    return mean.select("equipo", "tiempo_s", fn.rounded(F.avg("y").over(w), 5).alias("shift_m"))


def series_summary(series: DataFrame, by: str, value: str) -> DataFrame:
    """A series told by its mean, least and largest value, at one digit."""
    told = lambda c, n: fn.rounded(c, 1).alias(f"{value}_{n}")
    return series.groupBy(by).agg(told(F.avg(value), "mean"), told(F.min(value), "min"), told(F.max(value), "max"))


def blocks(rows: DataFrame, least: int = 3) -> DataFrame:
    """Centroid and extents of each frame and team with enough points."""
    return of_teams(rows).groupBy("frame", "equipo").agg(F.count("*").alias("n"), fn.rounded(F.avg("x_m")).alias("cx"), fn.rounded(F.avg("y_m")).alias("cy"), (F.max("x_m") - F.min("x_m")).alias("depth_m"), (F.max("y_m") - F.min("y_m")).alias("width_m")).where(F.col("n") >= least)


def head_count(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """People of A, B and others in every frame, frames without any included."""
    one = lambda e: F.count(F.when(F.col("equipo") == e, 1))
    counts = rows.groupBy("frame").agg(one(0).alias("a"), one(1).alias("b"), one(2).alias("other"))
    return frames.select("frame").distinct().join(counts, "frame", "left").na.fill(0)


def surplus_others(rows: DataFrame, frames: DataFrame, most: int = 1, length: float = LENGTH, width: float = WIDTH) -> DataFrame:
    """Share of frames with more people of neither team on the pitch than a referee accounts for."""
    others = rows.where((F.col("equipo") == 2) & F.col("x_m").between(0, length) & F.col("y_m").between(0, width)).groupBy("frame").agg(F.count("*").alias("n"))
    both = frames.select("frame").distinct().join(others, "frame", "left")
    return both.agg(F.count("*").alias("frames"), F.count(F.when(F.col("n") > most, 1)).alias("over"), fn.rounded(100.0 * F.count(F.when(F.col("n") > most, 1)) / F.count("*")).alias("over_pct"))


def drift(rows: DataFrame, segment_s: float = 60.0) -> DataFrame:
    """Medians of block metrics by tumbling segments of time."""
    timed = blocks(rows).join(rows.select("frame", "tiempo_s").distinct(), "frame")
    return timed.groupBy("equipo", F.floor(F.col("tiempo_s") / segment_s).cast("int").alias("segment")).agg(fn.rounded(F.median("cx")).alias("cx"), fn.rounded(F.median("cy")).alias("cy"), fn.rounded(F.median("width_m")).alias("width_m"), fn.rounded(F.median("depth_m")).alias("depth_m"), F.count("*").alias("frames"))


def episodes(rows: DataFrame, seconds: float = 15.0, good: float = 20.0, medium: float = 17.0) -> DataFrame:
    """Episodes by how many players of both teams a frame shows on average."""
    counts = of_teams(rows).groupBy("frame", "tiempo_s").agg(F.count("*").alias("n"))
    by = counts.groupBy(F.floor(F.col("tiempo_s") / seconds).cast("int").alias("episode")).agg(F.count("*").alias("frames"), fn.rounded(F.avg("n")).alias("mean_n"))
    return by.withColumn("grade", F.when(F.col("mean_n") >= good, "good").when(F.col("mean_n") >= medium, "medium").otherwise("bad"))


def sliding_windows(rows: DataFrame, size_s: int = 30, step_s: int = 5, key: list[str] | None = None) -> DataFrame:
    """Detections in overlapping windows of time; each row goes to the windows that hold it."""
    last = F.floor(F.col("tiempo_s") / step_s)
    first = F.floor((F.col("tiempo_s") - size_s) / step_s) + 1
    each = of_teams(rows).select(*(key or []), "frame", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("w"))
    return each.groupBy(*(key or []), (F.col("w") * step_s).cast("bigint").alias("start_s")).agg(F.count("*").alias("n"), F.countDistinct("frame").alias("frames"))


def funnel(dets: DataFrame, rows: DataFrame, length: float = LENGTH, width: float = WIDTH) -> DataFrame:
    """Counts from detections to measured rows of the teams on the pitch."""
    team, real = F.col("equipo").isin(0, 1), F.col("es_real") == 1
    inside = F.col("x_m").between(0, length) & F.col("y_m").between(0, width)
    stages = [("2 rows", rows), ("3 of teams", rows.where(team)), ("4 measured", rows.where(team & real)), ("5 on pitch", rows.where(team & real & inside))]
    out = dets.agg(F.lit("1 detections").alias("stage"), F.count("*").alias("n"))
    for name, df in stages:
        out = out.unionAll(df.agg(F.lit(name).alias("stage"), F.count("*").alias("n")))
    return out


def label_runs(rows: DataFrame, label: Column, most_gap_s: float = 0.5) -> DataFrame:
    """Runs of equal labels of an identity; a gap in time ends a run. ``duration_s`` is null where the segment, not the label, ends."""
    w = W.partitionBy("id_jugador").orderBy("frame")
    cut = rows.withColumn("seg", F.sum(F.when(F.col("tiempo_s") - F.lag("tiempo_s").over(w) > most_gap_s, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    marked = islands.runs(cut.withColumn("label", label), ["id_jugador", "seg"], "frame", F.col("label"))
    by = marked.groupBy("id_jugador", "seg", "run").agg(F.first("label").alias("label"), F.min("tiempo_s").alias("start_s"), F.count("*").alias("n"))
    nxt = F.lead("start_s").over(W.partitionBy("id_jugador", "seg").orderBy("run"))
    return by.withColumn("duration_s", nxt - F.col("start_s"))


def jumps(rows: DataFrame, least_m: float = 3.0, most_s: float = 0.35) -> DataFrame:
    """Steps that are too long for their time: identity changes."""
    return islands.speeds(rows).where((F.col("step_m") > least_m) & (F.col("dt") <= most_s)).select("id_jugador", "frame", "prev_frame", "step_m", "dt")


def reentries(rows: DataFrame, least_s: float = 1.0) -> DataFrame:
    """Where an identity comes back after a gap."""
    return islands.speeds(rows).where(F.col("dt") >= least_s).select("id_jugador", "frame", "prev_frame", "dt", "step_m")


def tactical_lines(rows: DataFrame) -> DataFrame:
    """Extremes of each team's block in a frame."""
    return players(rows).groupBy("frame", "equipo").agg(F.min("x_m").alias("low_x"), F.max("x_m").alias("high_x"), F.min("y_m").alias("low_y"), F.max("y_m").alias("high_y"), F.count("*").alias("n"))


def showable(errors: DataFrame, value: str, median_most: float = 1.5, p90_most: float = 3.0, n_least: int = 30) -> DataFrame:
    """Whether an error is small and frequent enough to show: median, 90 % point and number."""
    s = errors.agg(F.median(value).alias("median"), F.expr(f"percentile({value}, 0.9)").alias("p90"), F.count(value).alias("n"))
    return s.withColumn("show", (F.col("median") <= median_most) & (F.col("p90") <= p90_most) & (F.col("n") >= n_least))


def densest_window(rows: DataFrame, frames_in_window: int = 25, least_each: int = 7, key: list[str] | None = None) -> DataFrame:
    """The first window of frames with most frames in which both teams can be measured, of each match (``key``)."""
    n = lambda e: F.count(F.when(F.col("equipo") == e, 1))
    ok = players(rows).groupBy(*(key or []), "frame").agg(((n(0) >= least_each) & (n(1) >= least_each)).cast("int").alias("ok"))
    if key:
        ahead = F.sum("ok").over(W.partitionBy(*key).orderBy("frame").rowsBetween(0, frames_in_window - 1))
        counted = ok.select(*key, "frame", ahead.alias("n"))
        return counted.groupBy(*key).agg(F.min_by("frame", F.struct(-F.col("n"), F.col("frame"))).alias("start_frame"), F.max("n").alias("n"))
    run = saved(scans.running(ok, "frame", {"at": F.lit(1), "up_to": F.col("ok")}))
    # a window of rows is the difference of two sums; the last windows end with the table
    end = run.select((F.col("at") - frames_in_window + 1).alias("at"), F.col("up_to").alias("end"))
    all_ = run.agg(F.sum("ok").alias("all"))
    n = F.coalesce("end", "all") - F.col("up_to") + F.col("ok")
    return run.join(end, "at", "left").crossJoin(F.broadcast(all_)).select(F.col("frame").alias("start_frame"), n.alias("n")).orderBy(F.desc("n"), "start_frame").limit(1)


def deepest(rows: DataFrame, n: int = 4, length: float = LENGTH) -> DataFrame:
    """The n players nearest to their own goal, as a line from side to side, and its mean height."""
    w = W.partitionBy("frame", "equipo").orderBy("height", "id_jugador")
    top = heights(rows, length).withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return top.groupBy("frame", "equipo").agg(F.transform(F.array_sort(F.collect_list(F.struct("y_m", "id_jugador"))), lambda s: s["id_jugador"]).alias("line"), fn.rounded(F.avg("height")).alias("height_m"), F.count("*").alias("n")).where(F.col("n") == n)


def fixed_bins(rows: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """Counts of right-closed bins (a, b]."""
    bin_ = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        bin_ = F.when((value > edges[i]) & (value <= edges[i + 1]), i).otherwise(bin_)
    return rows.select(bin_.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def quantile_bins(rows: DataFrame, value: str, n: int = 3) -> DataFrame:
    """Each row with the number of its quantile bin, edges at exact percentiles (so ties share a bin)."""
    edges = rows.agg(F.expr(f"percentile({value}, array({', '.join(str(i / n) for i in range(1, n))}))").alias("edges"))
    return rows.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col(value)))).drop("edges")


def label_mode(rows: DataFrame) -> DataFrame:
    """The most frequent label of an identity; of equally frequent ones the first by name."""
    counts = rows.groupBy("id_jugador", "etiqueta").agg(F.count("*").alias("n"))
    w = W.partitionBy("id_jugador").orderBy(F.desc("n"), "etiqueta")
    return counts.withColumn("r", F.row_number().over(w)).where("r = 1").select("id_jugador", "etiqueta", "n")


def per_player(rows: DataFrame) -> DataFrame:
    """Rows, distance run and top speed of each identity."""
    s = islands.speeds(rows).groupBy("id_jugador").agg(fn.rounded(F.sum("step_m")).alias("run_m"), fn.rounded(F.max("speed")).alias("top_speed"), F.count("*").alias("steps"))
    return s


def product_error(truth: DataFrame, rows: DataFrame) -> DataFrame:
    """Block metrics of rows against the truth on shared frames and teams: absolute errors."""
    t = blocks(truth).select("frame", "equipo", *(F.col(c).alias(f"t_{c}") for c in ("cx", "cy", "width_m", "depth_m")))
    both = blocks(rows).join(t, ["frame", "equipo"])
    away = F.sqrt((F.col("cx") - F.col("t_cx")) ** 2 + (F.col("cy") - F.col("t_cy")) ** 2)
    return both.groupBy("equipo").agg(F.count("*").alias("n"), fn.rounded(F.median(away)).alias("centroid_m"), fn.rounded(F.median(F.abs(F.col("width_m") - F.col("t_width_m")))).alias("width_m"), fn.rounded(F.median(F.abs(F.col("depth_m") - F.col("t_depth_m")))).alias("depth_m"))


def occupancy_error(truth: DataFrame, rows: DataFrame, length: float = LENGTH, width: float = WIDTH) -> DataFrame:
    """Total variation between the shares of a 3 x 3 grid, by team, in per cent."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        cell = lambda v, size: fn.clamp(F.floor(v * 3 / size), 0, 2).cast("int")
        by = of_teams(df).groupBy("equipo", cell(F.col("x_m"), length).alias("zx"), cell(F.col("y_m"), width).alias("zy")).agg(F.count("*").alias("n"))
        return by.withColumn(name, F.col("n") / F.sum("n").over(W.partitionBy("equipo"))).drop("n")

    both = shares(truth, "t").join(shares(rows, "p"), ["equipo", "zx", "zy"], "full")
    return both.groupBy("equipo").agg(fn.rounded(50.0 * F.sum(F.abs(F.coalesce("t", F.lit(0.0)) - F.coalesce("p", F.lit(0.0))))).alias("occupancy_pct"))


def bin_proxies(rows: DataFrame, seconds: float = 15.0, full: int = 22) -> DataFrame:
    """Deficit of players and rate of jumps by bin of time, with z-scores by the sample deviation (null if all deficits are equal)."""
    counts = of_teams(rows).groupBy("frame", "tiempo_s").agg(F.count("*").alias("n"))
    deficit = counts.groupBy(F.floor(F.col("tiempo_s") / seconds).cast("int").alias("bin")).agg(F.avg(F.greatest(F.lit(full) - F.col("n"), F.lit(0))).alias("deficit"), F.count("*").alias("frames"))
    jump = islands.speeds(rows).where("step_m > 3").groupBy(F.floor(F.col("tiempo_s") / seconds).cast("int").alias("bin")).agg(F.count("*").alias("jumps"))
    both = deficit.join(jump, "bin")
    stats = both.agg(F.avg("deficit").alias("m"), F.stddev_samp("deficit").alias("s"))
    return both.crossJoin(F.broadcast(stats)).select("bin", "frames", "jumps", fn.rounded(F.col("deficit")).alias("deficit"), fn.rounded((F.col("deficit") - F.col("m")) / F.when(F.col("s") > 1e-9, F.col("s")), 5).alias("z"))


def weighted_quantile(rows: DataFrame, value: str, weight: str, q: float, key: list[str] | None = None) -> DataFrame:
    """The least value whose cumulative weight reaches a share of the total, in each match (``key``)."""
    if key:
        own = W.partitionBy(*key)
        each = rows.groupBy(*key, value).agg(F.sum(weight).alias("w"))
        each = each.withColumns({"below": F.sum("w").over(own.orderBy(value)), "total": F.sum("w").over(own)})
        return each.where(F.col("below") >= q * F.col("total")).groupBy(*key).agg(F.min(value).alias("value"))
    by = rows.groupBy(value).agg(F.sum(weight).alias("w"))
    run = scans.running(by, value, {"below": F.col("w")})
    total = by.agg(F.sum("w").alias("total"))
    return run.crossJoin(F.broadcast(total)).where(F.col("below") >= q * F.col("total")).agg(F.min(value).alias("value"))


def leave_out(dets: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Detections less a random share, the same for the same seed whatever the partitions."""
    place = F.pmod(F.xxhash64("frame", "det_idx", F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    return dets.where(place >= share)
