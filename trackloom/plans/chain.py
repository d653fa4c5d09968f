"""The analysis written once in SQL: what each step's rows must be.

Rates and thresholds follow from the defaults; the smoothing and turn windows
are 3 and 2 rows at both rates that the adapter uses.
"""

CHAIN = """
with recursive
ev as (
  select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as frame, event_type <> 'error' as visible,
         value as x, cast(json_extract(props, '$.k') as integer) * 7.2::double as y from events),
traj as (select user_id * 2 + k as video_id, frame, visible, x, y, frame as pos from ev, (values (0), (1)) r(k)),
videos as (
  select distinct user_id * 2 + k as video_id, (case when k = 0 then 4 else 10 end)::double as fps, 640 as width, 720 as height,
         sqrt(640.0::double * 640 + 720.0::double * 720) as diag from ev, (values (0), (1)) r(k)),
vis as (
  select *, lead(pos) over w as right_pos, lead(x) over w as right_x, lead(y) over w as right_y from traj where visible
  window w as (partition by video_id order by pos)),
gaps as (select *, pos as left_pos, right_pos - pos - 1 as size from vis where right_pos > pos + 1),
isl as (select *, pos - row_number() over (partition by video_id order by pos) as island from traj where not visible),
ends as (select video_id, min(pos) as lo, max(pos) as hi from traj where visible group by video_id),
runs as (
  select i.video_id, min(pos) as run_start, max(pos) as run_end, count(*) as length from isl i group by i.video_id, island),
marked as (
  select r.*, coalesce(run_start >= lo and run_end <= hi, false) as "inner" from runs r left join ends e on e.video_id = r.video_id),
cand as (
  select g.video_id, left_pos, g.right_pos, size, x as left_x, y as left_y, right_x, right_y, fps, diag,
         y / 720 >= 0.22::double and right_y / 720 >= 0.22::double as below_top,
         size >= greatest(1, round(0.35::double * fps)) and y / 720 >= 0.22::double and right_y / 720 >= 0.22::double as interior_restart,
         size >= round(3.0::double * fps) as very_long
  from gaps g join videos v on v.video_id = g.video_id where size >= greatest(2, round(0.10::double * fps))),
ctx as (
  select c.video_id, c.left_pos, 'before' as side, t.pos, t.frame, t.x, t.y from cand c join traj t on t.video_id = c.video_id and t.visible
    and t.pos between c.left_pos - trunc(0.30::double * fps) and c.left_pos where c.below_top
  union all
  select c.video_id, c.left_pos, 'after', t.pos, t.frame, t.x, t.y from cand c join traj t on t.video_id = c.video_id and t.visible
    and t.pos between c.right_pos and c.right_pos + trunc(0.45::double * fps) where c.below_top),
spd as (
  select * from (
    select video_id, left_pos, side, pos,
           sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) / greatest(1, frame - lag(frame) over w) as speed
    from ctx window w as (partition by video_id, left_pos, side order by pos)) where speed is not null),
tails as (select *, row_number() over (partition by video_id, left_pos, side order by pos desc) as back from spd),
facts as (
  select video_id, left_pos, median(speed) filter (side = 'before' and back <= 3) as before_median,
         count(*) filter (side = 'before') as n_before, count(*) filter (side = 'after') as n_after, max(speed) filter (side = 'after') as after_max
  from tails group by 1, 2),
judged as (
  select c.*, f.before_median, coalesce(f.n_before, 0) as n_before, coalesce(f.n_after, 0) as n_after, f.after_max,
         coalesce(below_top and n_before >= 2 and n_after >= 2 and before_median <= 0.004::double * diag and after_max >= 0.01::double * diag
           and sqrt((right_x - left_x) ** 2 + (right_y - left_y) ** 2) >= 0.03::double * diag, false) as low_speed
  from cand c left join facts f on f.video_id = c.video_id and f.left_pos = c.left_pos),
splits as (select *, interior_restart or very_long or low_speed as is_split from judged),
cut as (
  select t.*, case when visible then coalesce(sum(s.k) over (partition by t.video_id order by t.pos rows between unbounded preceding and 1 preceding), 0) end as own
  from traj t left join (select video_id, left_pos, 1 as k from splits where is_split) s on s.video_id = t.video_id and s.left_pos = t.pos),
segrows as (
  select * from (
    select video_id, frame, visible, x, y, pos,
           last_value(own ignore nulls) over (partition by video_id order by pos rows between unbounded preceding and current row) as segment_id,
           first_value(own ignore nulls) over (partition by video_id order by pos rows between current row and unbounded following) as nxt
    from cut) where segment_id = nxt),
segs as (
  select video_id, segment_id, min(pos) as start_pos, max(pos) as end_pos, min(frame) as start_frame, max(frame) as end_frame, count(*) as n_rows
  from segrows group by 1, 2),
near as (
  select *, max(case when visible then pos end) over (partition by video_id, segment_id order by pos rows between unbounded preceding and current row) as a,
         min(case when visible then pos end) over (partition by video_id, segment_id order by pos rows between current row and unbounded following) as b
  from segrows),
filled as (
  select n.video_id, n.segment_id, n.pos, n.frame, n.visible, n.pos - g.start_pos as place, g.n_rows,
         case when n.a = n.b then n.x else p.x + (q.x - p.x) / (n.b - n.a) * (n.pos - n.a) end as x_filled,
         case when n.a = n.b then n.y else p.y + (q.y - p.y) / (n.b - n.a) * (n.pos - n.a) end as y_filled
  from near n join segs g on g.video_id = n.video_id and g.segment_id = n.segment_id
  join traj p on p.video_id = n.video_id and p.pos = n.a join traj q on q.video_id = n.video_id and q.pos = n.b),
axes as (
  select *, 'x' as axis, x_filled as v from filled union all select *, 'y', y_filled from filled),
smoothed as (
  select *, case when n_rows < 3 then v else (coalesce(lag(v) over w, v) + v + coalesce(lead(v) over w, v)) * (1.0::double / 3) end as s
  from axes window w as (partition by video_id, segment_id, axis order by pos)),
signed as (select *, s * k as u, k from smoothed, (values (1.0::double), (-1.0::double)) t(k)),
framed as (
  select *, max(u) over b as max_b, min(u) over b as min_b, count(*) over b as n_b, max(u) over a as max_a, min(u) over a as min_a, count(*) over a as n_a
  from signed window b as (partition by video_id, segment_id, axis, k order by pos rows between 2 preceding and 1 preceding),
                     a as (partition by video_id, segment_id, axis, k order by pos rows between 1 following and 2 following)),
turned as (
  select f.video_id, f.segment_id, f.axis, f.place, least(u - min_b, u - min_a) as strength, fps, diag from framed f join videos v on v.video_id = f.video_id
  where n_b = 2 and n_a = 2 and u >= max_b and u > max_a and least(u - min_b, u - min_a) >= 0.02::double * diag),
raw as (select *, greatest(1, round(0.32::double * fps)) as gap, row_number() over (partition by video_id, segment_id order by place, strength) as i from turned),
fold as (
  select video_id, segment_id, i, place, strength, 1 as g from raw where i = 1
  union all
  select f.video_id, f.segment_id, e.i, case when e.place - f.place >= e.gap or e.strength > f.strength then e.place else f.place end,
         case when e.place - f.place >= e.gap or e.strength > f.strength then e.strength else f.strength end,
         case when e.place - f.place >= e.gap then f.g + 1 else f.g end
  from fold f join raw e on e.video_id = f.video_id and e.segment_id = f.segment_id and e.i = f.i + 1),
merged as (select video_id, segment_id, arg_max(place, i) as place, arg_max(strength, i) as strength from fold group by video_id, segment_id, g),
firsts as (
  select f.video_id, f.segment_id, min(place) as place, any_value(0.02::double * diag) as strength from filled f join videos v on v.video_id = f.video_id
  where visible group by 1, 2),
ruled as (
  select r.*, greatest(1, round(0.32::double * fps)) as gap, row_number() over (partition by r.video_id, segment_id order by place, strength, rule) as i
  from (select *, 'trajectory_turn' as rule from merged union all select *, 'serve_or_open_start' from firsts) r join videos v on v.video_id = r.video_id),
fold2 as (
  select video_id, segment_id, i, place, strength, rule, 1 as g from ruled where i = 1
  union all
  select f.video_id, f.segment_id, e.i, case when e.place - f.place >= e.gap or e.strength > f.strength then e.place else f.place end,
         case when e.place - f.place >= e.gap or e.strength > f.strength then e.strength else f.strength end,
         case when e.place - f.place >= e.gap or e.strength > f.strength then e.rule else f.rule end,
         case when e.place - f.place >= e.gap then f.g + 1 else f.g end
  from fold2 f join ruled e on e.video_id = f.video_id and e.segment_id = f.segment_id and e.i = f.i + 1),
kept as (
  select video_id, segment_id, arg_max(place, i) as place, arg_max(strength, i) as strength, arg_max(rule, i) as rule from fold2 group by video_id, segment_id, g),
hits0 as (
  select k.video_id, k.segment_id, k.place, f.frame, f.frame / fps as seconds, x_filled as x, y_filled as y, visible as observed, rule,
         least(0.95::double, 0.55::double + strength / diag) as confidence
  from kept k join filled f on f.video_id = k.video_id and f.segment_id = k.segment_id and f.place = k.place join videos v on v.video_id = k.video_id),
tally as (
  select h.video_id, h.segment_id, count(*) as hit_count, count(*) filter (observed) as observed_hits, count(*) filter (not observed) as inferred_gap_hits
  from hits0 h group by 1, 2),
qual as (
  select g.*, t.hit_count, t.observed_hits, t.inferred_gap_hits, fps from segs g join tally t on t.video_id = g.video_id and t.segment_id = g.segment_id
  join videos v on v.video_id = g.video_id where hit_count >= 2 and (end_frame - start_frame) / fps >= 0.8::double),
rallies as (
  select *, row_number() over (partition by video_id order by start_frame) as rally, start_frame / fps as start_seconds, end_frame / fps as end_seconds from qual),
hits as (
  select h.*, r.rally, row_number() over (partition by h.video_id, h.segment_id order by h.place) as hit
  from hits0 h join rallies r on r.video_id = h.video_id and r.segment_id = h.segment_id)
"""
