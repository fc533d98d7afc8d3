"""What the query modules share: parameters and pieces of SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixtures

Query = Callable[[SparkSession, str], DataFrame]

LENGTH, WIDTH = 100.0, 64.0
#: A homography with perspective, for queries over the derived tables.
H = [[0.05, 0.002, -3.0], [0.001, 0.09, -12.0], [0.00001, 0.0004, 1.0]]
ZONE = [(5.0, 2.0), (60.0, 1.0), (95.0, 30.0), (40.0, 60.0), (2.0, 33.0)]


def R(expr: str, digits: int = 6) -> str:
    """The same half-up rounding as ``functions.rounded``."""
    return f"(floor(({expr}) * 1e{digits} + 0.5e0) / 1e{digits})"


def over(*names: str):
    """A query over derived tables, given as DataFrames."""
    def wrap(f: Callable[..., DataFrame]) -> Query:
        return lambda spark, sf_dir: f(*(fixtures.table(spark, sf_dir, n) for n in names))

    return wrap


def sql(names: str, body: str) -> str:
    """SQL over derived tables; ``body`` may go on with more CTEs after a comma."""
    head = fixtures.sql(*names.split())
    return f"{head}{body}" if body.lstrip().startswith(",") else f"{head} {body}"


SPEEDS = """, steps as (select *, lag(frame) over w as prev_frame, lag(tiempo_s) over w as prev_t, lag(x_m) over w as prev_x, lag(y_m) over w as prev_y
  from positions window w as (partition by id_jugador order by frame)),
 speeds as (select *, tiempo_s - prev_t as dt, sqrt((x_m-prev_x)*(x_m-prev_x) + (y_m-prev_y)*(y_m-prev_y)) as step_m,
  sqrt((x_m-prev_x)*(x_m-prev_x) + (y_m-prev_y)*(y_m-prev_y)) / (tiempo_s - prev_t) as speed from steps where tiempo_s - prev_t > 0)"""

PAIRS = """, pred as (select frame, id_jugador as obj_id, x_m, y_m, etiqueta as team from positions where etiqueta <> 'staff'),
 cand as (select g.frame, g.obj_id as gt_id, p.obj_id as pred_id, sqrt((g.x_m-p.x_m)*(g.x_m-p.x_m)+(g.y_m-p.y_m)*(g.y_m-p.y_m)) as distance
  from gt_obs g join pred p on g.frame = p.frame),
 pairs as (select frame, gt_id, pred_id, distance from (select *, row_number() over (partition by frame, gt_id order by distance, pred_id) as r from cand where distance <= 2e0) where r = 1)"""
