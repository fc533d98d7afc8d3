"""Tracking tables derived from the driver's ``events``, the same text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POSITIONS = """
with b as (select cast(floor(event_id / 24e0) as int) as k, cast(event_id % 24 as int) as s, event_id, value from {events}
           where (event_id*7919) % 100 >= 15)
select 3*k as frame, (3*k)/25e0 as tiempo_s, s+1 as id_jugador,
       case when s < 11 then 0 when s < 22 then 1 else 2 end as equipo,
       case when s = 0 then 'portero_A' when s < 11 then 'A' when s = 11 then 'portero_B' when s < 22 then 'B'
            when s = 22 then 'otro' else 'staff' end as etiqueta,
       cast(case when s = 0 then 8 when s = 11 then 92 when s = 23 then 50 else 10 + s*3 end as double)
         + cast(abs((k + s*7) % 40 - 20) as double)/2e0 + (value % 1e0) as x_m,
       cast(case when s = 23 then -8 else 2 + ((s*5) % 24)*2 end as double)
         + cast(abs((k + s*11) % 24 - 12) as double)/4e0 as y_m,
       1 as es_real
from b
"""

DETECTIONS = """
with b as (select cast(floor(event_id / 24e0) as int) as k, cast(event_id % 24 as int) as s, event_id, value from {events}
           where (event_id*7919) % 100 >= 15)
select 3*k as frame, (3*k)/25e0 as t,
       cast(row_number() over (partition by k order by event_id) - 1 as int) as det_idx,
       cast(10 + s*3 as double) + (value % 1e0) as mx, cast(2 + s*2 as double) as my,
       cast(100 + s*11 as double) as x1, cast(200 + (event_id*17) % 300 as double) as y1,
       cast(100 + s*11 + 12 + event_id % 9 as double) as x2,
       cast(200 + (event_id*17) % 300 + 30 + event_id % 21 as double) as y2,
       cast((event_id*37) % 100 as double)/100e0 as conf
from b
"""

GT_OBS = """
with b as (select cast(floor(event_id / 24e0) as int) as k, cast(event_id % 24 as int) as s, event_id, value from {events})
select 3*k as frame, 100+s as obj_id,
       cast(case when s = 0 then 8 when s = 11 then 92 else 10 + s*3 end as double)
         + cast(abs((k + s*7) % 40 - 20) as double)/2e0 + cast((event_id*3) % 7 - 3 as double)/10e0 as x_m,
       cast(2 + ((s*5) % 24)*2 as double) + cast(abs((k + s*11) % 24 - 12) as double)/4e0
         + cast((event_id*5) % 7 - 3 as double)/10e0 as y_m,
       case when s = 22 then cast(null as varchar(16)) when s = 0 then 'portero_A' when s < 11 then 'A' when s = 11 then 'portero_B' else 'B' end as team,
       case when s = 22 then 'referee' else 'player' end as label
from b where k % 5 = 0 and s < 23
"""

BALL_CAND = """
with b as (select cast(floor(event_id / 12e0) as int) as k, cast(event_id % 12 as int) as c, event_id, value from {events}
           where event_id % 12 < 2 and (event_id*31) % 100 >= 20)
select 2*k as frame, (2*k)/25e0 as t, c as cand_idx,
       case when c = 1 then 70e0 else 10e0 + cast(abs(k % 160 - 80) as double)*0.5e0
            + case when k % 97 < 6 then 30e0 else 0e0 end end as mx,
       case when c = 1 then 20e0 else 5e0 + cast(abs(k % 90 - 45) as double)*0.6e0 end as my,
       case when c = 1 then 640e0 else 100e0 + cast(abs(k % 160 - 80) as double)*6e0 end as px,
       case when c = 1 then 360e0 else 200e0 + cast(abs(k % 90 - 45) as double)*4e0 end as py,
       cast(8 + event_id % 5 as double) as h_px, cast((event_id*41) % 100 as double)/100e0 as conf
from b
"""

#: A colour feature and a team label for detections, from the vectors of ``embeddings``.
FEATURES = """
select cast(3*floor(vec_id/24e0) as int) as frame, cast(vec_id % 24 as int) as det_idx, label,
       embedding as feat
from {embeddings}
"""

VIEWS = {"positions": POSITIONS, "detections": DETECTIONS, "gt_obs": GT_OBS, "ball_cand": BALL_CAND, "features": FEATURES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or one of the driver's own."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source = "embeddings" if name == "features" else "events"
    return spark.sql(VIEWS[name], **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def sql(*names: str) -> str:
    """``with`` clause that defines the derived tables in DuckDB."""
    return "with " + ", ".join(f"{n} as ({VIEWS[n].format(events='events', embeddings='embeddings')})" for n in names)
