"""SQL of queries that need more of it: grids, sequences, recursion."""

from __future__ import annotations

import math

from ..operators import pitch
from ..operators.evaluation import FIXES
from .base import PAIRS, SPEEDS, H, R, sql
from .q_tracking import _TRK

_P = pitch.Pitch()


def _d(x: float) -> str:
    return f"cast({float(x)!r} as double)"


def _values(rows, names: str) -> str:
    """Rows of a table from Python; floats as doubles."""
    text = ", ".join("(" + ", ".join(_d(x) if isinstance(x, float) else repr(x) for x in r) + ")" for r in rows)
    return f"(values {text}) as v({names})"


def _projected(u: str, v: str, h: list[list[float]]) -> tuple[str, str]:
    w = f"({_d(h[2][0])} * {u} + {_d(h[2][1])} * {v} + {_d(h[2][2])})"
    return tuple(f"(({_d(r[0])} * {u} + {_d(r[1])} * {v} + {_d(r[2])}) / {w})" for r in h[:2])


_BACK = pitch.inverse(H)


def _fine_heatmap(nx: int = 50, ny: int = 32, sigma: float = 1.6) -> str:
    reach = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    kernel = _values([(k, w / sum(weights)) for k, w in zip(range(-reach, reach + 1), weights, strict=True)], "k, w")

    def spread(source: str, axis: str, other: str, n: int) -> str:
        at = f"((({axis} + k) % {2 * n}) + {2 * n}) % {2 * n}"
        return f"select cast(case when {at} < {n} then {at} else {2 * n - 1} - {at} end as int) as {axis}, {other}, sum(v * w) as v from {source}, kernel group by 1, 2"

    cells = f"select cast(least(trunc(x_m / 100e0 * {nx}), {nx - 1}) as int) as cx, cast(least(trunc(y_m / 64e0 * {ny}), {ny - 1}) as int) as cy from positions where equipo in (0, 1)"
    return sql("positions", f""", kernel as (select * from {kernel}), n as (select cx, cy, count(*) * 1e0 as v from ({cells}) where cx >= 0 and cy >= 0 group by 1, 2),
 a as ({spread("n", "cx", "cy", nx)}), b as ({spread("a", "cy", "cx", ny)}) select cx, cy, {R("v / (select max(v) from b)")} as heat from b""")


def _grid(nx: int, ny: int, dx: str, dy: str, x0: str = "0e0", y0: str = "0e0") -> str:
    return f"select i, j, {x0} + i * {dx} as x, {y0} + j * {dy} as y from range({nx}) a(i), range({ny}) b(j)"


def _resolution() -> str:
    nx, ny = int(_P.length / 2) + 1, int(_P.width / 2) + 1
    u, v = _projected("x", "y", _BACK)
    far = []
    for du, dv in (("1e0", "0e0"), ("0e0", "1e0")):
        x, y = _projected(f"(u + {du})", f"(v + {dv})", H)
        far.append(f"sqrt(({x} - x) * ({x} - x) + ({y} - y) * ({y} - y))")
    at = lambda c, n: f"least(greatest(round_even({c} / 2e0, 0), 0), {n - 1})"
    return sql("positions", f""", nodes as ({_grid(nx, ny, _d(_P.length / (nx - 1)), _d(_P.width / (ny - 1)))}), p as (select *, {u} as u, {v} as v from nodes), m as (select i, j, greatest({far[0]}, {far[1]}) as mpp from p),
 f as (select i, j, mpp / (select min(mpp) from m) as factor from m) select id_jugador, count(*) as n, {R("avg(factor)", 4)} as factor from positions join f on i = {at("x_m", nx)} and j = {at("y_m", ny)} group by 1""")


def _scale_audit() -> str:
    points = _values([(k, *map(float, v)) for k, v in _P.points().items()], "name, x, y")
    away = lambda shift: f"sqrt(((a.x + {shift}) - (b.x + {shift})) * ((a.x + {shift}) - (b.x + {shift})) + (a.y - b.y) * (a.y - b.y))"
    return f"with p as (select * from {points}) select a.name as a_name, b.name as b_name, {R(away('0.5e0'))} as measured_m, {R(away('0e0'))} as true_m from p a join p b on a.name < b.name"


def _image_band() -> str:
    u, v = _projected("x", "y", _BACK)
    return f"with g as ({_grid(25, 25, _d(20 / 24), _d(64 / 24), '80e0')}), p as (select {u} as u, {v} as v from g) select {R('min(v)', 4)} as top, {R('max(v)', 4)} as bottom, {R('min(u)', 4)} as left, {R('max(u)', 4)} as right from p"


def _visible_field() -> str:
    u, v = _projected("x", "y", _BACK)
    return f"with g as ({_grid(int(_P.length / 2) + 1, int(_P.width / 2) + 1, '2e0', '2e0')}) select y, min(x) as from_x, max(x) as to_x from g where {u} between 0 and 1920 and {v} between 0 and 1080 group by 1"


_ERRORS = PAIRS + f""", near as (select a.frame, a.obj_id, min(sqrt((a.x_m-b.x_m)*(a.x_m-b.x_m)+(a.y_m-b.y_m)*(a.y_m-b.y_m))) as d from gt_obs a left join gt_obs b on a.frame = b.frame and a.obj_id <> b.obj_id group by 1, 2),
 err as (select {R("d")} % 2 as position, case when p.gt_id is null then 1e0 else 0e0 end as missing, 0.25e0 as phantom, n.obj_id % 3 * 0.5e0 as team, n.frame % 2 * 0.5e0 as duplicate from near n left join pairs p on n.frame = p.frame and n.obj_id = p.gt_id),
 ladder as (select m as subset, avg({" + ".join(f"(case when (m >> {i}) & 1 = 1 then 0e0 else {k} end)" for i, k in enumerate(FIXES))}) as error, count(*) as n from err, range(32) t(m) group by 1)"""


def _shapley() -> str:
    """Of each kind: over the sets without it, what it takes off, weighted by the orders in which that set comes first."""
    weight = lambda size: math.factorial(size) * math.factorial(4 - size) / math.factorial(5)
    kinds = _values([(k, 1 << i) for i, k in enumerate(FIXES)], "kind, bit")
    sizes = _values([(n, weight(n)) for n in range(5)], "size, weight")
    return sql("gt_obs positions", f"{_ERRORS} select kind, {R('sum(weight * (a.error - b.error))')} as share from (select * from {kinds}) k join ladder a on a.subset & bit = 0 join ladder b on b.subset = a.subset | bit join (select * from {sizes}) s on size = bit_count(cast(a.subset as int)) group by 1")


def _reach(nodes: str, links: str) -> str:
    """Least node that links reach, of each node: a recursive table ``least(node, label)``; ``links``: a, b."""
    return f"both_ as (select a, b from ({links}) union select b, a from ({links})), reach(node, other) as (select n, n from ({nodes}) union select reach.node, both_.b from reach join both_ on reach.other = both_.a), least_ as (select node, min(other) as label from reach group by 1)"


def _recursive(text: str) -> str:
    return text.replace("with ", "with recursive ", 1)


_UNIQUE = _TRK + ", l as (select a.tracklet_id as a, b.tracklet_id as b from trk a join trk b on b.t0 > a.t1 and b.t0 <= a.t1 + 3 and a.tracklet_id <> b.tracklet_id where sqrt((b.x0-a.x1)*(b.x0-a.x1)+(b.y0-a.y1)*(b.y0-a.y1)) <= 7*(b.t0-a.t1) + 2*least(greatest(0.11e0+0.026e0*b.y0, 0.11e0), 1.85e0)), u as (select a, b from (select *, count(*) over (partition by a) as x, count(*) over (partition by b) as y from l) where x = 1 and y = 1)"
_PAIR_M = "sqrt((a.x_m-b.x_m)*(a.x_m-b.x_m)+(a.y_m-b.y_m)*(a.y_m-b.y_m))"
_DUPLICATES = f", dup as (select a.id_jugador as a, b.id_jugador as b from positions a join positions b on a.frame = b.frame and a.id_jugador < b.id_jugador group by 1, 2 having count(*) >= 3 and median({_PAIR_M}) <= 4)"


def _long(source: str, keys: str) -> str:
    """A vector's components as rows, from ``feat``."""
    return f"select {keys}, unnest(feat) as v, unnest(range(1, len(feat) + 1)) as k from {source}"


def _nearest_prototype(source: str, keys: str, forced: str = "false") -> str:
    """Labels of mean vectors given by components (v, k): the prototypes are the first three unit vectors, their distance is sqrt 2."""
    away = lambda i: f"sqrt(sum((v - (case when k = {i} then 1e0 else 0e0 end)) * (v - (case when k = {i} then 1e0 else 0e0 end))))"
    return f"select {keys}, case when {forced} then (case when a <= b then 'A' else 'B' end) when least(a, b, o) > sqrt(2e0) or (o < a and o < b) then 'otro' when a <= b then 'A' else 'B' end as team from (select {keys}, {away(1)} as a, {away(2)} as b, {away(3)} as o from {source} group by all)"


_BALL0 = ", tr as (select * from ball_cand where cand_idx = 0)"


def _aerial(least_s: float) -> str:
    """The chosen ball with ``aerial``, as the table ``ae``."""
    step = "case when t - lag(t) over w > 0 then sqrt((mx - lag(mx) over w)*(mx - lag(mx) over w) + (my - lag(my) over w)*(my - lag(my) over w)) / (t - lag(t) over w) end"
    return _BALL0 + f""", sp as (select *, {step} as v, sqrt(mx*mx + my*my) as away from tr window w as (order by frame)),
 kk as (select median(h_px * sqrt(mx*mx + my*my)) as k, count(*) as nk from tr where h_px > 0),
 fl as (select sp.*, coalesce(v > 20, false) or coalesce(lead(v) over (order by frame) > 20, false) or coalesce(nk >= 8 and h_px > 0 and away > 0 and h_px * away / k > 1.6e0, false) as a from sp, kk),
 ru as (select *, sum(ch) over (order by frame) as run from (select *, case when a = lag(a) over (order by frame) then 0 else 1 end as ch from fl)),
 ae as (select *, (a and max(t) over (partition by run) - min(t) over (partition by run) >= {least_s!r}e0) or coalesce(v > 40, false) as aerial from ru)"""


_ANGLE = """, st as (select frame, t, mx, my, t - lag(t) over w as d1, lead(t) over w - t as d2, mx - lag(mx) over w as ax, my - lag(my) over w as ay, lead(mx) over w - mx as bx, lead(my) over w - my as by_, lead(t, {after}) over w - lead(t) over w as d3, lead(mx, {after}) over w - lead(mx) over w as cx, lead(my, {after}) over w - lead(my) over w as cy from tr window w as (order by frame)),
 ve as (select frame, t, mx, my, ax/d1 as ax, ay/d1 as ay, bx/d2 as bx, by_/d2 as by_, case when d3 > 0 then cx/d3 end as cx, case when d3 > 0 then cy/d3 end as cy from st where d1 > 0 and d2 > 0),
 an as (select *, degrees(acos(greatest(least((ax*bx + ay*by_) / (sqrt(ax*ax+ay*ay) * sqrt(bx*bx+by_*by_)), 1e0), -1e0))) as angle, case when cx is null or cx*cx+cy*cy = 0 then 0e0 else degrees(acos(greatest(least((bx*cx + by_*cy) / (sqrt(bx*bx+by_*by_) * sqrt(cx*cx+cy*cy)), 1e0), -1e0))) end as turned
  from ve where least(sqrt(ax*ax+ay*ay), sqrt(bx*bx+by_*by_)) >= 1),
 con as (select frame, t, mx, my, angle from an where angle >= 70 and turned <= 60)"""

_PEAKS = """, vs as (select frame, t, mx, my, t - lag(t) over w as dt, (mx - lag(mx) over w) / (t - lag(t) over w) as vx, (my - lag(my) over w) / (t - lag(t) over w) as vy from tr window w as (order by frame)),
 chg as (select *, sqrt((lead(vx) over w - vx)*(lead(vx) over w - vx) + (lead(vy) over w - vy)*(lead(vy) over w - vy)) as change from vs window w as (order by frame)),
 pk0 as (select *, lag(change) over w as before, lead(change) over w as after from chg window w as (order by frame)),
 pk as (select frame, t, mx, my, change from pk0 where dt > 0 and change >= 3 and change >= coalesce(before, 0) and change > coalesce(after, 0)),
 spaced(since) as (select min(t) from pk union all select (select min(t) from pk where t - s.since >= 0.2e0) from spaced s where s.since is not null),
 peaks as (select pk.* from pk where t in (select since from spaced))"""

# contacts of both kinds: each group begins with the first one more than the distance after the last group's begin
_MERGED = """, al as (select frame, t, mx, my, 'angle' as kind from con union all select frame, t, mx, my, 'acceleration' from peaks),
 nu as (select *, row_number() over (order by t, kind) as i from al),
 begin_(i) as (select min(i) from nu union all select (select min(n.i) from nu n where n.t - (select b.t from nu b where b.i = begin_.i) > 0.2e0 and n.i > begin_.i) from begin_ where begin_.i is not null),
 gr as (select nu.*, (select max(i) from begin_ where begin_.i <= nu.i) as g from nu)
 select h.frame, h.t, h.mx, h.my, case when kinds > 1 then 'both' else h.kind end as kind from nu h join (select g, count(distinct kind) as kinds from gr group by 1) k on k.g = h.i"""


def _anchored(cand: int, radius: float) -> str:
    return sql("ball_cand", f""", tr as (select row_number() over (order by frame) as i, t, mx, my from ball_cand where cand_idx = {cand}),
 run(i, n, cx, cy, start, best) as (select cast(0 as bigint), cast(0 as bigint), 0e0, 0e0, 0e0, 0e0 union all
  select tr.i, case when stays then n + 1 else 1 end, case when stays then cx + (mx - cx) / (n + 1) else mx end, case when stays then cy + (my - cy) / (n + 1) else my end, case when stays then start else t end, case when stays then greatest(best, t - start) else best end
  from (select run.*, tr.i as next_i, tr.t, tr.mx, tr.my, run.n > 0 and sqrt((tr.mx - cx)*(tr.mx - cx) + (tr.my - cy)*(tr.my - cy)) <= {radius!r}e0 as stays from run join tr on tr.i = run.i + 1) r join tr on tr.i = r.next_i)
 select max(best) as longest_s from run""").replace("r join tr on tr.i = r.next_i", "r").replace("select tr.i, case when stays", "select next_i, case when stays")


def _worst_windows(n: int = 3) -> str:
    chosen, text = [], ""
    for i in range(n):
        clear = "".join(f" and not exists (select 1 from c{j} where abs(w.start_s - c{j}.start_s) < 30)" for j in chosen)
        text += f", c{i} as (select * from w where true{clear} order by rate, start_s limit 1)"
        chosen.append(i)
    return sql("positions", ", e as (select frame, unnest(generate_series(greatest(cast(floor((tiempo_s - 30) / 5) as bigint) + 1, 0), cast(floor(tiempo_s / 5) as bigint))) as k from positions where equipo in (0, 1)), w as (select k * 5 as start_s, count(*) * 1e0 / count(distinct frame) as rate from e group by 1)" + text + " " + " union all ".join(f"select start_s, {R('rate')} as rate from c{i}" for i in chosen))


def _smooth_ball() -> str:
    mean = lambda c: f"(coalesce(sum({c}) over (partition by seg order by frame rows between 2 preceding and 2 following), 0) + greatest(3 - i, 0) * first_value({c}) over (partition by seg order by frame rows between unbounded preceding and unbounded following) + greatest(i + 2 - n, 0) * last_value({c}) over (partition by seg order by frame rows between unbounded preceding and unbounded following)) / 5e0"
    return sql("ball_cand", f""", tr as (select *, frame % 50 < 8 as aerial from ball_cand where cand_idx = 0), cu as (select *, case when t - lag(t) over w > 0.2e0 or aerial <> lag(aerial) over w then 1 else 0 end as c from tr window w as (order by frame)),
 se as (select *, sum(c) over (order by frame) as seg from cu), nu as (select *, row_number() over (partition by seg order by frame) as i, count(*) over (partition by seg) as n from se)
 select frame, {R(f"case when aerial or n < 5 then mx else {mean('mx')} end")} as bx, {R(f"case when aerial or n < 5 then my else {mean('my')} end")} as by from nu""")


_CAPPED = """, v as (select frame, id_jugador, case when equipo = 0 then 'A' when equipo = 1 then 'B' else 'otro' end as team, x_m / 100 as score from positions),
 r as (select *, row_number() over (partition by frame, team order by score desc, id_jugador) as place, case when team = 'otro' then 1 else 9 end as most from v),
 f as (select frame, greatest(9 - count(case when team = 'A' then 1 end), 0) as a, greatest(9 - count(case when team = 'B' then 1 end), 0) as b, greatest(1 - count(case when team = 'otro' then 1 end), 0) as o from v group by 1),
 q as (select *, row_number() over (partition by frame order by score, id_jugador desc) as turn from r where place > most)
 select frame, id_jugador, team from r where place <= most
 union all select q.frame, id_jugador, case when turn <= a then 'A' when turn <= a + b then 'B' when turn <= a + b + o then 'otro' else team end from q join f using (frame)"""

_SPEED_CUT = """, sp as (select *, case when prev_t is null then null else sqrt((x_m-prev_x)*(x_m-prev_x) + (y_m-prev_y)*(y_m-prev_y)) / (tiempo_s - prev_t) end as speed from steps),
 ki as (select *, case when prev_t is null then 0 when speed > 6 then 2 when speed > 2.5e0 then 1 else 0 end as kind from sp),
 fr as (select *, case when kind = 1 and lag(kind) over (partition by id_jugador order by frame) = 1 then 0 else 1 end as f from ki),
 ru as (select *, sum(f) over (partition by id_jugador order by frame) as run from fr),
 ba as (select *, kind = 2 or (kind = 1 and max(tiempo_s) over (partition by id_jugador, run) - min(prev_t) over (partition by id_jugador, run) >= 0.2e0) as bad from ru),
 inn as (select *, bad and coalesce(lead(bad) over w and lead(run) over w = run, false) as inner_, sum(bad::int) over w as piece from ba window w as (partition by id_jugador order by frame)),
 pc as (select id_jugador, piece, count(*) as n from inn where not inner_ group by 1, 2 having count(*) >= 3)
 select id_jugador, count(*) as pieces, cast(sum(n) as bigint) as n from pc group by 1"""

_COLOUR_CUTS = f""", v as (select id_jugador, frame, case when id_jugador < 6 and frame > 600 then 1 else equipo end as e from positions),
 s as (select *, row_number() over w as i, count(*) over p as n, sum(1 - e) over w as a, sum(1 - e) over p as ta from v where e in (0, 1) window w as (partition by id_jugador order by frame), p as (partition by id_jugador)),
 o as (select *, (greatest(a, i - a) + greatest(ta - a, (n - i) - (ta - a))) * 1e0 / n as split, greatest(ta, n - ta) * 1e0 / n as before from s where n >= 30 and i >= 10 and n - i >= 10),
 b as (select * from (select *, row_number() over (partition by id_jugador order by split desc, frame) as r from o) where r = 1)
 select id_jugador, frame as last_frame, {R("before")} as before, {R("split")} as after from b where before < 0.85e0 and split - before >= 0.08e0"""

_ROW_CLASSES = PAIRS.replace("distance <= 2e0", "distance <= 0.4e0") + """, l as (select p.* from pred p where not exists (select 1 from pairs q where q.frame = p.frame and q.pred_id = p.obj_id)),
 g as (select g.*, q.gt_id is not null as has from gt_obs g left join pairs q on g.frame = q.frame and g.obj_id = q.gt_id),
 m as (select l.frame, l.obj_id, l.team, coalesce(min(case when g.label = 'referee' then d end), 'inf') as ref, coalesce(min(case when g.has then d end), 'inf') as dup, coalesce(min(case when not g.has then d end), 'inf') as free
  from l left join (select *, 0 as z from g) g on l.frame = g.frame, lateral (select sqrt((l.x_m-g.x_m)*(l.x_m-g.x_m)+(l.y_m-g.y_m)*(l.y_m-g.y_m)) as d) group by 1, 2, 3)
 select case when team = 'staff' or ref <= 2 then 'staff' when dup <= 2 then 'duplicate' when free <= 5 then 'displaced' else 'phantom' end as kind, count(*) as n from m group by 1"""

_GREEDY = """, gt as (select frame, obj_id, x_m, y_m, row_number() over (partition by frame order by obj_id) as i from gt_obs), pr as (select frame, id_jugador as obj_id, x_m, y_m from positions where etiqueta <> 'staff'),
 turn(frame, i, used, gt_id, pred_id, distance) as (select distinct frame, cast(0 as bigint), cast([] as int[]), cast(null as int), cast(null as int), cast(null as double) from gt_obs union all
  select frame, i, case when d < least(greatest(1.5e0 + 0.09e0 * y_m, 1.5e0), 6e0) then list_append(used, best) else used end, obj_id, case when d < least(greatest(1.5e0 + 0.09e0 * y_m, 1.5e0), 6e0) then best end, d
  from (select t.frame, g.i, t.used, g.obj_id, g.y_m, arg_min(p.obj_id, (sqrt((g.x_m-p.x_m)*(g.x_m-p.x_m)+(g.y_m-p.y_m)*(g.y_m-p.y_m)), p.obj_id)) as best, min(sqrt((g.x_m-p.x_m)*(g.x_m-p.x_m)+(g.y_m-p.y_m)*(g.y_m-p.y_m))) as d
   from turn t join gt g on g.frame = t.frame and g.i = t.i + 1 left join pr p on p.frame = t.frame and not list_contains(t.used, p.obj_id) group by 1, 2, 3, 4, 5))
 select frame, gt_id, pred_id, """ + R("distance") + """ as distance from turn where pred_id is not null"""

_REENTRY = f""", fe as (select det_idx % 4 as tracklet_id, frame * 10 + det_idx as frame, feat from features), nu as (select *, row_number() over w as i, frame - lag(frame) over w as gap from fe window w as (partition by tracklet_id order by frame)),
 cu as (select tracklet_id, i as place, frame as cut_frame from nu where gap >= 8), ne as (select n.tracklet_id, cut_frame, n.i >= place as after, feat from nu n join cu c on n.tracklet_id = c.tracklet_id and n.i >= place - 8 and n.i < place + 8),
 ea as ({_long("ne", "tracklet_id, cut_frame, after")}), me as (select tracklet_id, cut_frame, after, k, avg(cast(v as double)) as v, count(*) as n from ea group by 1, 2, 3, 4),
 ab as (select a.tracklet_id, a.cut_frame, sum(a.v * b.v) as ab, sqrt(sum(a.v * a.v)) + 1e-9 as na, sqrt(sum(b.v * b.v)) + 1e-9 as nb, least(max(a.n), max(b.n)) as n from me a join me b on a.tracklet_id = b.tracklet_id and a.cut_frame = b.cut_frame and a.k = b.k where not a.after and b.after group by 1, 2)
 select tracklet_id, cut_frame from ab where n >= 3 and 1 - ab / (na * nb) > 0.1e0"""

# tracklets with the velocity at their end: six tenths of the old, four of the new step
_TRACKLETS = """, obs as (select cast(id_jugador * 1000 + floor(frame / 250) as int) as tracklet_id, tiempo_s as t, x_m as x, y_m as y from positions where equipo < 2),
 fo as (select tracklet_id, list(struct_pack(t := t, x := x, y := y, vx := 0e0, vy := 0e0) order by t, x, y) as o from obs group by 1),
 tl as (select tracklet_id, o[1] as s, list_reduce(o, lambda a, p: struct_pack(t := p.t, x := p.x, y := p.y, vx := case when p.t - a.t > 0 then 0.6e0 * a.vx + 0.4e0 * (p.x - a.x) / (p.t - a.t) else a.vx end, vy := case when p.t - a.t > 0 then 0.6e0 * a.vy + 0.4e0 * (p.y - a.y) / (p.t - a.t) else a.vy end)) as e from fo),
 pr as (select a.tracklet_id as a, b.tracklet_id as b, b.s.t - a.e.t as gap, sqrt((a.e.x + a.e.vx * (b.s.t - a.e.t) - b.s.x) * (a.e.x + a.e.vx * (b.s.t - a.e.t) - b.s.x) + (a.e.y + a.e.vy * (b.s.t - a.e.t) - b.s.y) * (a.e.y + a.e.vy * (b.s.t - a.e.t) - b.s.y)) as away,
  sqrt((b.s.x - a.e.x) * (b.s.x - a.e.x) + (b.s.y - a.e.y) * (b.s.y - a.e.y)) / (b.s.t - a.e.t) as jump from tl a join tl b on b.s.t > a.e.t and b.s.t <= a.e.t + 6 and a.tracklet_id <> b.tracklet_id),
 ca as (select a, b, jump, away / (1.2e0 + 3 * gap) + 0.3e0 * gap / 6 as cost from pr where away <= 1.2e0 + 3 * gap)"""

_GREEDY_LINKS = f""", nu as (select *, row_number() over (order by cost, a, b) as i from ca),
 go(i, has, is_, a, b, cost) as (select cast(0 as bigint), cast([] as int[]), cast([] as int[]), cast(null as int), cast(null as int), cast(null as double) union all
  select nu.i, case when free then list_append(has, nu.a) else has end, case when free then list_append(is_, nu.b) else is_ end, case when free then nu.a end, nu.b, nu.cost
  from (select go.i, has, is_, n.a as na, n.b as nb, not list_contains(has, n.a) and not list_contains(is_, n.b) as free from go join nu n on n.i = go.i + 1) g join nu on nu.i = g.i + 1)
 select a, b, {R("cost")} as cost from go where a is not null"""

_MUTUAL = f""", ra as (select *, row_number() over f as rf, row_number() over k as rb, lead(cost) over f as nf, lead(cost) over k as nb from ca where jump <= 8 window f as (partition by a order by cost, b), k as (partition by b order by cost, a))
 select a, b, {R("cost")} as cost from ra where rf = 1 and rb = 1 and (nf is null or nf > cost * 1.15e0) and (nb is null or nb > cost * 1.15e0)"""

# candidates in order, each with the first object that is still open and near: a list of each object's last place
_OBJECTS = """, nu as (select *, row_number() over (order by frame, cand_idx) as i from ball_cand),
 go(i, open_, object) as (select cast(0 as bigint), cast([] as struct(f int, x double, y double)[]), cast(null as int) union all
  select i, case when spot > len(open_) then list_append(open_, struct_pack(f := frame, x := mx, y := my)) else list_concat(list_append(open_[:spot - 1], struct_pack(f := frame, x := mx, y := my)), open_[spot + 1:]) end, cast(spot - 1 as int)
  from (select n.i, n.frame, n.mx, n.my, open_, coalesce(list_position(list_transform(open_, lambda o: n.frame - o.f <= 30 and sqrt((n.mx - o.x) * (n.mx - o.x) + (n.my - o.y) * (n.my - o.y)) <= 8), true), len(open_) + 1) as spot from go join nu n on n.i = go.i + 1)),
 ob as (select nu.*, object from nu join go using (i))"""

_PARKED = """, np as (select o.i, min(sqrt((mx - x_m) * (mx - x_m) + (my - y_m) * (my - y_m))) as d from ob o left join positions p on p.frame = o.frame group by 1),
 sm as (select ob.*, d, sqrt((mx - lag(mx) over w) * (mx - lag(mx) over w) + (my - lag(my) over w) * (my - lag(my) over w)) as step from ob join np using (i) window w as (partition by object order by frame, cand_idx)),
 pa as (select object from sm group by 1 having count(*) >= 3 and median(step) < 0.05e0 and coalesce(median(d), 'inf') > 10)
 select frame, cand_idx from ob where object not in (select object from pa)"""

_MERGED_BOXES = """, bx as (select frame, det_idx, 0 as tile, x1, y1, x2, y2 from detections where det_idx < 10 union all select frame, det_idx, 1, x1, y1, x2, y2 from detections where det_idx >= 8),
 nu as (select *, row_number() over (partition by frame order by tile, det_idx) as i from bx),
 go(frame, i, kept, ok) as (select distinct frame, cast(0 as bigint), cast([] as struct(a double, b double, c double, d double)[]), false from bx union all
  select frame, i, case when fits then list_append(kept, struct_pack(a := x1, b := y1, c := x2, d := y2)) else kept end, fits
  from (select n.frame, n.i, n.x1, n.y1, n.x2, n.y2, kept, n.tile = 0 or len(list_filter(kept, lambda k: greatest(least(n.x2, k.c) - greatest(n.x1, k.a), 0) * greatest(least(n.y2, k.d) - greatest(n.y1, k.b), 0) > 0.3e0 * ((n.x2 - n.x1) * (n.y2 - n.y1) + (k.c - k.a) * (k.d - k.b) - greatest(least(n.x2, k.c) - greatest(n.x1, k.a), 0) * greatest(least(n.y2, k.d) - greatest(n.y1, k.b), 0)))) = 0 as fits from go join nu n on n.frame = go.frame and n.i = go.i + 1))
 select go.frame, det_idx as box_idx, tile from go join nu using (frame, i) where ok"""

_FIELD_PRIOR = """, ca as (select frame, t, cand_idx, case when frame % 30 = 0 then 150e0 else mx end as mx, my from ball_cand),
 fr as (select frame, t, list(struct_pack(c := cand_idx, x := mx, y := my) order by cand_idx) as cs, row_number() over (order by frame) as i from ca group by 1, 2),
 go(i, last_t, last, out, frame) as (select cast(0 as bigint), cast(null as double), cast([] as struct(c int, x double, y double)[]), cast([] as struct(c int, x double, y double)[]), cast(null as int) union all
  select i, case when len(ok) > 0 then t else last_t end, case when len(ok) > 0 then ok else last end, case when len(ok) > 0 then ok else cs end, frame
  from (select f.i, f.t, f.frame, f.cs, last_t, last, list_filter(f.cs, lambda k: k.x >= -3 and k.x <= 103 and k.y >= -3 and k.y <= 67 and (last_t is null or len(list_filter(last, lambda q: sqrt((k.x - q.x) * (k.x - q.x) + (k.y - q.y) * (k.y - q.y)) <= 35 * (f.t - last_t) + 3)) > 0)) as ok from go join fr f on f.i = go.i + 1))
 select frame, unnest(list_transform(out, lambda k: k.c)) as cand_idx from go where frame is not null"""

_VALIDATION = """, bad as (select frame, det_idx, mx, my, x1, y1, y2, case when frame = 30 and det_idx = 1 then 1.5e0 else conf end as conf, case when frame = 60 then x1 else x2 end as x2 from detections),
 fr as (select distinct frame from detections where frame not between 90 and 140), st as (select frame - lag(frame) over (order by frame) as step from fr),
 ru as (select 'frames grow' as rule, 'error' as level, count(case when step <= 0 then 1 end) as n from st
  union all select 'steps fit the sample', 'error', count(case when step % 3 <> 0 then 1 end) from st
  union all select 'long gap', 'warning', count(case when step > 5 * (select min(step) from st where step > 0) then 1 end) from st
  union all select 'mostly empty', 'error', count(case when b then 1 end) from (select count(case when n is null then 1 end) > 0.95e0 * count(*) as b from fr left join (select frame, count(*) as n from bad group by 1) using (frame))
  union all select 'mx in metres', 'error', count(case when b then 1 end) from (select median(abs(mx)) > 300 as b from bad)
  union all select 'my in metres', 'error', count(case when b then 1 end) from (select median(abs(my)) > 300 as b from bad)
  union all select 'confidence', 'error', count(case when not (conf between 0 and 1) then 1 end) from bad
  union all select 'upright boxes', 'error', count(case when x2 <= x1 or y2 <= y1 then 1 end) from bad)
 select rule, level, n from ru where n > 0"""

ORACLES: dict[str, str] = {
    "fine_heatmap": _fine_heatmap(),
    "resolution_lookup": _resolution(),
    "scale_audit": _scale_audit(),
    "image_band": _image_band(),
    "visible_field": _visible_field(),
    "row_classes": sql("gt_obs positions", _ROW_CLASSES),
    "error_ladder": sql("gt_obs positions", f"{_ERRORS} select cast(subset as int) as subset, {R('error')} as error, n from ladder"),
    "shapley_ladder": _shapley(),
    "identities": _recursive(sql("positions", f"{_UNIQUE}, {_reach('select distinct tracklet_id as n from obs', 'select a, b from u')} select node as tracklet_id, label as identity_id from least_")),
    "duplicate_merge": _recursive(sql("positions", f"{_DUPLICATES}, {_reach('select distinct id_jugador as n from positions', 'select a, b from dup')} select label as id_jugador, count(distinct frame) as n from positions join least_ on id_jugador = node group by 1")),
    "colour_cuts": sql("positions", _COLOUR_CUTS),
    "speed_cut": sql("positions", SPEEDS + _SPEED_CUT),
    "capped_labels": sql("positions", _CAPPED),
    "identity_colours": sql("features", f""", c as (select det_idx as id_jugador, frame % 2 = 0 as near, label > 3 as free, feat from features), r as (select *, case when near and free then 0 when near then 1 when free then 2 else 3 end as rank from c),
 t as (select id_jugador, min(rank) as top, count(*) as crops from r group by 1), u as (select r.id_jugador, crops, feat from r join t using (id_jugador) where (top = 0 and rank = 0) or (top = 1 and near) or (top = 2 and free) or top = 3),
 e as ({_long("u", "id_jugador, crops")}), m as (select id_jugador, crops, k, avg(cast(v as double)) as v from e group by 1, 2, 3) select id_jugador, crops, {R("sqrt(sum(v * v))", 5)} as size from m group by 1, 2"""),
    "identity_teams": sql("features", f", c as (select det_idx as id_jugador, count(*) over (partition by det_idx) as crops, feat from features), e as ({_long('c', 'id_jugador, crops')}), m as (select id_jugador, crops, k, avg(cast(v as double)) as v from e group by 1, 2, 3) " + _nearest_prototype("m", "id_jugador, crops", "crops < 25 and (least(a, b, o) > sqrt(2e0) or (o < a and o < b))")),
    "observation_teams": sql("features", f", e as ({_long('features', 'det_idx as id_jugador, frame')}), m as (select id_jugador, frame, k, avg(cast(v as double)) over (partition by id_jugador, k order by frame range between 6 preceding and 6 following) as v from e) " + _nearest_prototype("m", "id_jugador, frame")),
    "referee_kit": sql("features", ", b as (select list_position(feat, list_max(feat)) - 1 as i from features), c as (select (i // 16 + 0.5e0) * 11.25e0 as hue, (i % 16 + 0.5e0) * 16e0 as sat from b), k as (select case when hue < 22.5e0 and sat < 256 then 'low' when hue >= 22.5e0 and hue < 180 and sat < 128 then 'high' end as kit from c) select kit, count(*) as n from k group by 1"),
    "scaled_windows": sql("positions", ", f as (select id_jugador, avg(1e0 + y_m / 64e0) as f, count(*) as n from positions group by 1), s as (select id_jugador, greatest(5, least(cast(round_even(5 * (1 + ln(1 + f)), 0) as int), cast(floor(n / 2e0) as int) * 2 - 1, 61)) as s from f) select id_jugador, s - case when s % 2 = 0 then 1 else 0 end as window from s"),
    "worst_windows": _worst_windows(),
    "smooth_ball": _smooth_ball(),
    "aerial_phases": sql("ball_cand", _aerial(0.0) + " select frame, aerial from ae"),
    "flight_lines": sql("ball_cand", _aerial(0.15) + f""", en as (select *, {", ".join(f"last_value(case when not aerial then {c} end ignore nulls) over p as a_{c}, first_value(case when not aerial then {c} end ignore nulls) over n as b_{c}" for c in ("t", "mx", "my"))} from ae window p as (order by frame rows between unbounded preceding and current row), n as (order by frame rows between current row and unbounded following)),
 li as (select *, aerial and a_t is not null and b_t is not null and b_t > a_t as inside, (t - a_t) / (b_t - a_t) as share from en) select frame, {R("case when inside then a_mx + share * (b_mx - a_mx) else mx end")} as fx, {R("case when inside then a_my + share * (b_my - a_my) else my end")} as fy, case when aerial then 0 else 1 end as es_real from li"""),
    "contacts_angle": sql("ball_cand positions", _BALL0 + _ANGLE.format(after=1) + f", ow as (select c.frame, c.angle, arg_min(p.id_jugador, (sqrt((c.mx-p.x_m)*(c.mx-p.x_m)+(c.my-p.y_m)*(c.my-p.y_m)), p.id_jugador)) as id_jugador from con c left join positions p on p.frame = c.frame and sqrt((c.mx-p.x_m)*(c.mx-p.x_m)+(c.my-p.y_m)*(c.my-p.y_m)) <= 6 group by 1, 2) select frame, id_jugador, {R('angle', 5)} as angle from ow"),
    "acceleration_peaks": _recursive(sql("ball_cand", _BALL0 + _PEAKS + f" select frame, t, mx, my, {R('change')} as change from peaks")),
    "merged_contacts": _recursive(sql("ball_cand positions", _BALL0 + _ANGLE.format(after=2) + _PEAKS + _MERGED)),
    "anchored_ball": _recursive(_anchored(1, 0.5)),
    "ball_anchor_share": _recursive(_anchored(0, 3.0)),
    "greedy_match": _recursive(sql("gt_obs positions", _GREEDY)),
    "reentry_gate": sql("features", _REENTRY),
    "stitch_greedy": _recursive(sql("positions", _TRACKLETS + _GREEDY_LINKS)),
    "purity_stitch_pass": sql("positions", _TRACKLETS + _MUTUAL),
    "ball_objects": _recursive(sql("ball_cand", _OBJECTS + " select object, count(*) as n from ob group by 1")),
    "parked_balls": _recursive(sql("ball_cand positions", _OBJECTS + _PARKED)),
    "merged_boxes": _recursive(sql("detections", _MERGED_BOXES)),
    "field_prior": _recursive(sql("ball_cand", _FIELD_PRIOR)),
    "cache_validation": sql("detections", _VALIDATION),
    "fused_boxes": sql("detections", ", j as (select det_idx as tracklet_id, frame, y2 - y1 as h, quantile_cont(y2 - y1, 0.5e0) over (partition by det_idx) as usual, sqrt((mx - lag(mx) over w) * (mx - lag(mx) over w) + (my - lag(my) over w) * (my - lag(my) over w)) as jump from detections window w as (partition by det_idx order by frame)) select tracklet_id, frame from j where jump > 1 and h >= 1.1e0 * usual"),
    "pruned_embeddings": sql("detections features", ", b as (select det_idx as k, frame, frame - lag(frame) over (partition by det_idx order by frame) as gap from detections), re as (select k, frame as f from b where gap >= 6 union all select k, frame - gap from b where gap >= 6) select det_idx as tracklet_id, frame, det_idx from features x where exists (select 1 from re where k = x.det_idx and abs(x.frame - f) <= 3)"),
}
