"""DuckDB SQL of the engine's queries, over the driver's tables."""

from __future__ import annotations

from .functions import fixed

_OBS = """
o AS (
  SELECT user_id AS recording_id, event_id, lpad(event_id::VARCHAR, 12, '0') AS frame_id,
         us, us / 86400000000.0 AS t, event_type <> 'error' AS positive,
         (100 + floor(abs(value))::BIGINT % 40)::INT AS x1, (60 + event_id % 20)::INT AS y1
  FROM (SELECT *, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS us FROM events)),
p AS (SELECT *, x1 + 200 AS x2, y1 + 150 AS y2, min(t) OVER w AS t0, max(t) OVER w - min(t) OVER w AS span, count(*) OVER w AS n_routed
      FROM o WHERE positive WINDOW w AS (PARTITION BY recording_id)),
b AS (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY recording_id, bin ORDER BY abs(t - (t0 + (bin + 0.5::DOUBLE) * 1.0::DOUBLE)), frame_id) AS k
        FROM (SELECT *, floor((t - t0) / 1.0::DOUBLE)::INT AS bin FROM p)) WHERE k = 1)"""

_PIX = """
px AS (
  SELECT label::BIGINT AS recording_id, vec_id AS frame_index, (i // 8)::INT AS y, (i % 8)::INT AS x,
         (floor(v * 1000)::BIGINT % 4)::INT AS cls, (floor(v * 1000)::BIGINT % 256)::INT AS gray, (floor(v * 3000)::BIGINT % 256)::INT AS b,
         (floor(v * 5000)::BIGINT % 256)::INT AS g, (floor(v * 7000)::BIGINT % 256)::INT AS r
  FROM (SELECT label, vec_id, i, abs(embedding[i + 1]::DOUBLE) AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS i)))"""

_VOTES = """
votes AS (SELECT recording_id, y, x, count(*) AS n, count_if(cls = 1) AS n_tissue, count_if(cls IN (1, 2)) AS n_view,
                 count_if(cls = 1) / count(*) >= 0.4 AS tissue, count_if(cls IN (1, 2)) / count(*) >= 0.4 AS view FROM px GROUP BY ALL)"""

_FEAT = """
ft AS (SELECT recording_id, frame_index, quantile_cont(gray::DOUBLE, 0.99) - quantile_cont(gray::DOUBLE, 0.01) AS dynamic_range,
              avg((gray <= 2)::INT) AS crushed, avg((gray >= 253)::INT) AS saturated, avg(step / 60.0) AS gradient
       FROM (SELECT *, abs(gray - lag(gray) OVER (PARTITION BY recording_id, frame_index ORDER BY y, x)) AS step FROM px) GROUP BY ALL),
ad AS (SELECT *, CASE WHEN dynamic_range < 30 THEN printf('dynamic range %.1f', dynamic_range) WHEN crushed > 0.9 THEN printf('crushed share %.3f', crushed)
                      WHEN saturated > 0.5 THEN printf('saturated share %.3f', saturated) WHEN gradient < 1 THEN printf('gradient %.3f', gradient) END AS reason FROM ft)"""

_CLIP = """
fr AS (SELECT label::BIGINT AS recording_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index FROM embeddings),
clip AS (SELECT recording_id, count(*) + (recording_id % 4 = 3)::BIGINT AS n_frames,
                CASE WHEN recording_id % 9 <> 8 THEN CASE WHEN recording_id % 2 = 0 THEN 10.0 ELSE 4.0 END END::DOUBLE AS fps, count(*) AS n_there FROM fr GROUP BY recording_id)"""

_REC = """
rec AS (SELECT user_id AS recording_id, count(*) * 7 + user_id % 11 AS n_frames, ([59.0, 29.97, 25.0, 1.0]::DOUBLE[])[user_id % 4 + 1] AS fps FROM events GROUP BY user_id)"""

_PAIRS = """
q AS (SELECT event_id, (100 + floor(abs(value))::BIGINT % 40)::INT AS ax1, (60 + event_id % 20)::INT AS ay1, floor(abs(value))::BIGINT % 90 AS dv FROM events),
pr AS (SELECT event_id, ax1, ay1, ax1 + 200 AS ax2, ay1 + 150 AS ay2, (ax1 + event_id % 260 - 30)::INT AS bx1, (ay1 + event_id % 170 - 10)::INT AS by1,
              (ax1 + event_id % 260 - 30 + 150 + event_id % 100)::INT AS bx2, (ay1 + event_id % 170 - 10 + 100 + dv)::INT AS by2 FROM q),
ov AS (SELECT *, least(ax2, bx2) - greatest(ax1, bx1) AS w, least(ay2, by2) - greatest(ay1, by1) AS h,
              (ax2 - ax1)::BIGINT * (ay2 - ay1) AS a, (bx2 - bx1)::BIGINT * (by2 - by1) AS b FROM pr),
iou AS (SELECT event_id, CASE WHEN w > 0 AND h > 0 THEN (w::BIGINT * h) / (a + b - w::BIGINT * h) ELSE 0.0 END::DOUBLE AS iou, least(a, b) / greatest(a, b) AS ratio FROM ov)"""


def _rounded(*expressions: str) -> str:
    x1, y1, x2, y2 = (f"round_even({e}, 0)::INT" for e in expressions)
    return f"{x1} AS x1, {y1} AS y1, greatest({x2}, {x1} + 1) AS x2, greatest({y2}, {y1} + 1) AS y2"


_MEDIAN = _rounded(*(f"median({s})" for s in ("x1", "y1", "x2", "y2")))
_QUANTILE = _rounded(*(f"quantile_cont({s}::DOUBLE, {q})" for s, q in (("x1", 0.1), ("y1", 0.1), ("x2", 0.9), ("y2", 0.9))))


def _occupied(rows: str, keys: str) -> str:
    """Tables of the counts (occ_n) and the occupancy boxes (occ) of each group of ``rows``."""
    return f"""occ_n AS (SELECT {keys}, count(*) AS n FROM {rows} GROUP BY ALL),
occ_x AS (SELECT *, lead(x) OVER (PARTITION BY {keys} ORDER BY x) AS xe FROM (SELECT DISTINCT {keys}, unnest([x1, x2]) AS x FROM {rows})),
occ_y AS (SELECT *, lead(y) OVER (PARTITION BY {keys} ORDER BY y) AS ye FROM (SELECT DISTINCT {keys}, unnest([y1, y2]) AS y FROM {rows})),
occ_c AS (SELECT {keys}, x, xe, y, ye, count(*) AS k FROM occ_x JOIN occ_y USING ({keys}) JOIN {rows} USING ({keys})
          WHERE x1 <= x AND xe <= x2 AND y1 <= y AND ye <= y2 GROUP BY ALL),
occ AS (SELECT {keys}, n, min(x) AS x1, min(y) AS y1, max(xe) AS x2, max(ye) AS y2 FROM occ_c JOIN occ_n USING ({keys}) WHERE k >= ceil(0.5 * n) GROUP BY {keys}, n)"""


def clusters(x1: str = "x1", y1: str = "y1") -> str:
    """Complete-linkage clusters of the bins' boxes: each round merges every recording's closest pair of clusters."""
    return f"""{_OBS},
f AS (SELECT recording_id, x1, y1, x1 + 200 AS x2, y1 + 150 AS y2, row_number() OVER (PARTITION BY recording_id ORDER BY bin) AS pos, count(*) OVER (PARTITION BY recording_id) AS n_bins
      FROM (SELECT recording_id, bin, {x1} AS x1, {y1} AS y1 FROM b)),
d AS MATERIALIZED (SELECT l.recording_id, l.pos AS pa, r.pos AS pb, sqrt((((l.x1 + l.x2) - (r.x1 + r.x2)) / 2.0::DOUBLE / 1280) ** 2 + (((l.y1 + l.y2) - (r.y1 + r.y2)) / 2.0::DOUBLE / 720) ** 2) AS far
      FROM f l JOIN f r USING (recording_id)),
g AS (SELECT 0 AS step, recording_id, pos, pos AS grp FROM f
      UNION ALL
      SELECT g.step + 1, g.recording_id, g.pos, CASE WHEN g.grp = m.merge.b THEN m.merge.a ELSE g.grp END
      FROM g JOIN (SELECT recording_id, min({{'far': far, 'a': a, 'b': b}}) AS merge
                   FROM (SELECT l.recording_id, l.grp AS a, r.grp AS b, max(far) AS far FROM g l JOIN g r USING (recording_id) JOIN d ON d.recording_id = l.recording_id AND d.pa = l.pos AND d.pb = r.pos
                         WHERE l.grp < r.grp GROUP BY ALL)
                   WHERE far <= {fixed.TAU}::DOUBLE GROUP BY recording_id) m ON g.recording_id = m.recording_id),
done AS (SELECT * FROM g QUALIFY step = max(step) OVER (PARTITION BY recording_id))"""


def _split_values() -> str:
    from .operators.stability import split_rows

    return ", ".join(f"({n},'{s}','{h}',{p})" for n, s, h, p in split_rows(40))


def build() -> dict[str, str]:
    """SQL by query name."""
    sql = {
        "evidence_bins": f"WITH {_OBS} SELECT recording_id, bin, frame_id, t, span, n_routed, x1, y1, x2, y2 FROM b",
        "session_box_median": f"WITH {_OBS} SELECT recording_id, count(*) AS n_bins, {_MEDIAN} FROM b GROUP BY recording_id",
        "session_box_quantile": f"WITH {_OBS} SELECT recording_id, count(*) AS n_bins, {_QUANTILE} FROM b GROUP BY recording_id",
        "session_box_occupancy": f"""WITH {_OBS}, n AS (SELECT recording_id, count(*) AS n_bins FROM b GROUP BY 1),
xs AS (SELECT DISTINCT recording_id, unnest([x1, x2]) AS x FROM b), ys AS (SELECT DISTINCT recording_id, unnest([y1, y2]) AS y FROM b),
xr AS (SELECT recording_id, x, lead(x) OVER (PARTITION BY recording_id ORDER BY x) AS xe FROM xs), yr AS (SELECT recording_id, y, lead(y) OVER (PARTITION BY recording_id ORDER BY y) AS ye FROM ys),
c AS (SELECT recording_id, x, xe, y, ye, count(*) AS k FROM xr JOIN yr USING (recording_id) JOIN b USING (recording_id)
      WHERE x1 <= x AND xe <= x2 AND y1 <= y AND ye <= y2 GROUP BY ALL)
SELECT recording_id, n_bins, min(x) AS x1, min(y) AS y1, max(xe) AS x2, max(ye) AS y2 FROM c JOIN n USING (recording_id) WHERE k >= ceil(0.5 * n_bins) GROUP BY recording_id, n_bins""",
        "session_geometry_reasons": f"""WITH {_OBS}, m AS (SELECT recording_id, count(*) AS n_bins, max(span) AS span, max(n_routed) AS n_routed, {_MEDIAN} FROM b GROUP BY recording_id),
r AS (SELECT u.recording_id, coalesce(n_routed, 0) AS n_routed, coalesce(n_bins, 0) AS n_bins, coalesce(n_routed >= 3 AND n_bins >= 2 AND span >= 3.0, FALSE) AS good, x1, y1, x2, y2
      FROM (SELECT DISTINCT recording_id FROM o) u LEFT JOIN m USING (recording_id))
SELECT recording_id, n_routed, n_bins, CASE WHEN good THEN 'ok' ELSE '{fixed.INSUFFICIENT}' END AS reason,
       CASE WHEN good THEN x1 END AS x1, CASE WHEN good THEN y1 END AS y1, CASE WHEN good THEN x2 END AS x2, CASE WHEN good THEN y2 END AS y2 FROM r""",
        "centre_distances": f"""WITH {_OBS}, c AS (SELECT recording_id, bin, (x1 + x2) / 2.0::DOUBLE / 1280 AS cx, (y1 + y2) / 2.0::DOUBLE / 720 AS cy FROM b)
SELECT recording_id, l.bin AS bin_a, r.bin AS bin_b, round(sqrt((l.cx - r.cx) ** 2 + (l.cy - r.cy) ** 2), 9) AS distance FROM c l JOIN c r USING (recording_id) WHERE l.bin < r.bin""",
        "asof_live_box": f"""WITH {_OBS}, s AS (SELECT recording_id, frame_id, t, last_value(CASE WHEN positive THEN {{'t': t, 'x1': x1, 'y1': y1}} END IGNORE NULLS)
  OVER (PARTITION BY recording_id ORDER BY t, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM o),
l AS (SELECT recording_id, frame_id, t, seen.t AS last_t, coalesce(t - seen.t <= 1.5::DOUBLE * 0.2::DOUBLE, FALSE) AS live, seen.x1 AS x, seen.y1 AS y FROM s)
SELECT recording_id, frame_id, t, last_t, live, CASE WHEN live THEN x END AS x1, CASE WHEN live THEN y END AS y1, CASE WHEN live THEN x + 200 END AS x2, CASE WHEN live THEN y + 150 END AS y2 FROM l""",
        "evidence_trailing_window": f"""WITH {_OBS} SELECT recording_id, frame_id, us, least(count(*) OVER (PARTITION BY recording_id ORDER BY us RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW), 4000) AS n_kept FROM p""",
        "box_iou_pairs": f"WITH {_PAIRS} SELECT event_id, iou, iou < 0.5 AS drifted FROM iou",
        "folded_area_pairs": f"WITH {_PAIRS} SELECT event_id, ratio FROM iou",
        "validate_box_reasons": f"""SELECT event_id, CASE event_id % 9 WHEN 0 THEN '{fixed.VALID}' WHEN 1 THEN '{fixed.NOT_FOUR}' WHEN 2 THEN '{fixed.NON_FINITE}' WHEN 3 THEN '{fixed.NON_INTEGER}'
  WHEN 4 THEN '{fixed.INVERTED}' WHEN 5 THEN '{fixed.OUT_OF_FRAME}' WHEN 6 THEN '{fixed.TOO_SMALL}' WHEN 7 THEN CASE WHEN floor(abs(value))::BIGINT % 40 = 0 THEN '{fixed.VALID}' ELSE '{fixed.OUT_OF_FRAME}' END ELSE '{fixed.NOT_FOUR}' END AS reason FROM events""",
        "clamp_box": f"""WITH {_PAIRS}, k AS (SELECT event_id, greatest(bx1, 0) AS x1, greatest(by1, 0) AS y1, least(bx2, 300) AS x2, least(by2, 200) AS y2 FROM pr)
SELECT event_id, CASE WHEN x2 > x1 AND y2 > y1 THEN x1 END AS x1, CASE WHEN x2 > x1 AND y2 > y1 THEN y1 END AS y1, CASE WHEN x2 > x1 AND y2 > y1 THEN x2 END AS x2, CASE WHEN x2 > x1 AND y2 > y1 THEN y2 END AS y2 FROM k""",
        "letterbox_params": """WITH s AS (SELECT p_partkey, 320 + p_size * 13 AS w, 240 + p_partkey % 701 AS h FROM part), k AS (SELECT *, least(512 / w, 384 / h) AS scale FROM s),
n AS (SELECT *, greatest(1, round_even(w * scale, 0)::INT) AS new_w, greatest(1, round_even(h * scale, 0)::INT) AS new_h FROM k)
SELECT p_partkey, scale, new_w, new_h, (384 - new_h) // 2 AS top, (512 - new_w) // 2 AS left FROM n""",
        "recording_probe": f"""WITH {_REC}, r AS (SELECT recording_id, n_frames * (recording_id % 5 > 0)::INT AS n_frames, CASE WHEN recording_id % 7 > 0 THEN fps END AS fps FROM rec)
SELECT recording_id, n_frames, CASE WHEN n_frames <= 0 THEN 'no_frames' WHEN coalesce(fps, 0) <= 0 THEN 'no_frame_rate' ELSE 'ok' END AS reason FROM r""",
        "calibration_sample": f"WITH {_REC} SELECT DISTINCT recording_id, round_even(i * (greatest(n_frames - 1, 0) / 23.0::DOUBLE), 0)::BIGINT AS frame_index FROM rec, (SELECT unnest(range(0, 24)) AS i)",
        "effective_rate": f"WITH {_REC} SELECT recording_id, least(5.0::DOUBLE, fps) AS hz FROM rec",
        "cadence_due_regular": f"""WITH {_REC}, f AS (SELECT recording_id, fps, least(5.0::DOUBLE, fps) AS hz, unnest(range(0, n_frames)) AS i FROM rec),
s AS (SELECT *, floor((i / fps + 1e-9) * hz) AS slot FROM f)
SELECT recording_id, i AS frame_index, i / fps AS t FROM (SELECT *, lag(slot) OVER (PARTITION BY recording_id ORDER BY i) AS prev FROM s) WHERE prev IS NULL OR slot > prev""",
        "cadence_due_clock": f"""WITH {_OBS}, s AS (SELECT recording_id, frame_id, t, floor((t - min(t) OVER (PARTITION BY recording_id) + 1e-9) * 2.0::DOUBLE)::BIGINT AS slot FROM o)
SELECT recording_id, frame_id, slot, coalesce(slot > lag(slot) OVER (PARTITION BY recording_id ORDER BY t, frame_id), TRUE) AS due FROM s""",
        "split_half_stability": f"""WITH {_OBS}, fam(n_bins, split, half, pos) AS (VALUES {_split_values()}),
z AS (SELECT recording_id, x1, y1, x2, y2, row_number() OVER (PARTITION BY recording_id ORDER BY bin) - 1 AS pos, count(*) OVER (PARTITION BY recording_id) AS n_bins FROM b),
h AS (SELECT recording_id, z.n_bins, split, half, count(*) AS n, {_MEDIAN} FROM z JOIN fam USING (n_bins, pos) GROUP BY ALL),
j AS (SELECT u.recording_id, u.n_bins, u.split, coalesce(a.n >= 2 AND c.n >= 2 AND u.n_bins >= 4, FALSE) AS enough, least(a.x2, c.x2) - greatest(a.x1, c.x1) AS w, least(a.y2, c.y2) - greatest(a.y1, c.y1) AS v,
             (a.x2 - a.x1)::BIGINT * (a.y2 - a.y1) AS aa, (c.x2 - c.x1)::BIGINT * (c.y2 - c.y1) AS ca
      FROM (SELECT DISTINCT recording_id, n_bins, split FROM h) u LEFT JOIN (SELECT * FROM h WHERE half = 'a') a USING (recording_id, n_bins, split) LEFT JOIN (SELECT * FROM h WHERE half = 'b') c USING (recording_id, n_bins, split)),
k AS (SELECT *, CASE WHEN enough THEN CASE WHEN w > 0 AND v > 0 THEN (w::BIGINT * v) / (aa + ca - w::BIGINT * v) ELSE 0.0::DOUBLE END END AS iou, CASE WHEN enough THEN least(aa, ca) / greatest(aa, ca) END AS ratio FROM j),
m AS (SELECT recording_id, n_bins::INT AS n_bins, min(iou) AS worst_iou, min(ratio) AS worst_area_ratio, count_if(enough) AS n_evaluated, count_if(NOT enough) AS n_insufficient FROM k GROUP BY ALL)
SELECT *, coalesce(worst_iou >= 0.95 AND worst_area_ratio >= 0.97, FALSE) AS stable,
       CASE WHEN n_evaluated = 0 THEN '{fixed.INSUFFICIENT_SPLIT}' WHEN coalesce(worst_iou >= 0.95 AND worst_area_ratio >= 0.97, FALSE) THEN 'ok' ELSE '{fixed.UNSTABLE}' END AS reason FROM m""",
        "temporal_segments": f"""WITH {_OBS}, z AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY bin) - 1 AS pos, count(*) OVER (PARTITION BY recording_id) AS nb FROM b),
g AS (SELECT *, unnest([CASE WHEN nb >= 2 THEN CASE WHEN pos < nb // 2 THEN 'early' ELSE 'late' END END,
                        CASE WHEN nb >= 3 THEN CASE WHEN pos < nb // 3 THEN 'first_third' WHEN pos < 2 * (nb // 3) THEN 'middle_third' ELSE 'last_third' END END]) AS segment FROM z)
SELECT recording_id, segment, count(*) AS n, {_MEDIAN} FROM g WHERE segment IS NOT NULL GROUP BY recording_id, segment""",
        "class_histogram": f"WITH {_PIX} SELECT recording_id, frame_index, count_if(cls = 0) AS n_0, count_if(cls = 1) AS n_1, count_if(cls = 2) AS n_2, count_if(cls = 3) AS n_3 FROM px GROUP BY ALL",
        "agreement_mask": f"WITH {_PIX}, {_VOTES} SELECT * FROM votes",
        "run_agreement": f"""WITH {_PIX}, {_VOTES}, k AS (SELECT recording_id, y, x, n_view, n, lag(n_view, 1, 0) OVER w AS prev, lead(n_view) OVER w AS nxt FROM votes WINDOW w AS (PARTITION BY recording_id, y ORDER BY x)),
e AS (SELECT recording_id, y, x, n_view, n FROM k WHERE n_view > 0)
SELECT recording_id, y, x AS x_start, x + 1 AS x_end, n_view AS votes FROM e WHERE n_view / n >= 0.4""",
        "popup_presence": f"""WITH {_PIX}, e AS (SELECT recording_id, frame_index, count_if(cls = 3) AS n FROM px GROUP BY ALL), s AS (SELECT recording_id, count(*) AS n_frames, count_if(n >= 19.2) AS popup_frames FROM e GROUP BY ALL)
SELECT *, popup_frames / n_frames AS popup_share, popup_frames > 0 AS popup_present FROM s""",
        "full_fov_box": f"WITH {_PIX}, {_VOTES} SELECT recording_id, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM votes WHERE view GROUP BY recording_id",
        "box_preservation": f"WITH {_PIX}, {_VOTES} SELECT recording_id, coalesce(count_if(view AND x >= 2 AND x < 7 AND y >= 1 AND y < 6) / nullif(count_if(view), 0), 0.0) AS preserved FROM votes GROUP BY recording_id",
        "frame_features_basic": f"WITH {_PIX}, {_FEAT} SELECT recording_id, frame_index, round(dynamic_range, 6) AS dynamic_range, round(crushed, 6) AS crushed, round(saturated, 6) AS saturated, round(gradient, 6) AS gradient FROM ft",
        "admissibility_reasons": f"WITH {_PIX}, {_FEAT} SELECT recording_id, frame_index, reason FROM ad",
        "session_admission": f"""WITH {_PIX}, {_FEAT}, s AS (SELECT recording_id, count(*) AS n_frames, count_if(reason IS NULL) AS n_kept, arg_min(reason, CASE WHEN reason IS NOT NULL THEN frame_index END) AS why FROM ad GROUP BY ALL)
SELECT recording_id, n_frames, n_kept, n_kept / n_frames AS retained, n_kept / n_frames >= 0.5 AS admitted, CASE WHEN n_kept / n_frames < 0.5 THEN why END AS reason FROM s""",
        "routing_support": f"""WITH {_PIX}, c AS (SELECT DISTINCT recording_id, frame_index, CASE WHEN frame_index % 7 > 0 THEN 1 WHEN frame_index % 14 = 0 THEN 2 ELSE 0 END AS kind,
  frame_index % 3 AS x1, frame_index % 2 AS y1, least(8, 7 + frame_index % 3) AS x2, 8 AS y2 FROM px),
d AS (SELECT *, greatest(1, round_even((x2 - x1) * 0.12::DOUBLE, 0)::INT) AS dx, greatest(1, round_even((y2 - y1) * 0.12::DOUBLE, 0)::INT) AS dy FROM c),
q AS (SELECT px.*, d.* EXCLUDE (recording_id, frame_index), greatest(b, g, r) AS top, greatest(b, g, r) - least(b, g, r) AS spread FROM px JOIN d USING (recording_id, frame_index) WHERE kind = 1 AND x >= x1 AND x < x2 AND y >= y1 AND y < y2),
hu AS (SELECT *, CASE WHEN spread = 0 THEN 0.0::DOUBLE WHEN top = r THEN 60.0::DOUBLE * (g - b) / spread WHEN top = g THEN 120.0::DOUBLE + 60.0::DOUBLE * (b - r) / spread ELSE 240.0::DOUBLE + 60.0::DOUBLE * (r - g) / spread END AS hue FROM q),
hv AS (SELECT *, floor(CASE WHEN hue < 0 THEN hue + 360 ELSE hue END / 2.0::DOUBLE + 0.5::DOUBLE)::INT % 180 AS half, CASE WHEN top = 0 THEN 0 ELSE floor(255.0::DOUBLE * spread / top + 0.5::DOUBLE)::INT END AS sat FROM hu),
sp AS (SELECT recording_id, frame_index, coalesce(avg(CASE WHEN x >= x1 + dx AND x < x2 - dx AND y >= y1 + dy AND y < y2 - dy THEN (cls IN (1, 2))::INT END), 0.0) AS tissue,
              avg(((half <= 30 OR half >= 165) AND sat >= 35 AND top >= 25)::INT) AS warm FROM hv GROUP BY ALL),
fin AS (SELECT c.recording_id, c.frame_index, kind, coalesce(tissue, 0.0) AS tissue, coalesce(warm, 0.0) AS warm FROM c LEFT JOIN sp USING (recording_id, frame_index))
SELECT recording_id, frame_index, kind = 1 AND greatest(tissue, warm) >= 0.3 AS routed,
       CASE kind WHEN 0 THEN '{fixed.NO_FOOTPRINT}' WHEN 2 THEN '{fixed.INVALID_POPUP}' ELSE CASE WHEN greatest(tissue, warm) >= 0.3 THEN 'ok' ELSE '{fixed.NOT_ROUTED}' END END AS reason,
       round(greatest(tissue, warm), 9) AS support, round(tissue, 9) AS tissue, round(warm, 9) AS warm FROM fin""",
        "monitor_counters": "SELECT user_id AS recording_id, count(*) AS n_monitored, count_if(event_type <> 'error') AS n_routed, 0::BIGINT AS n_rejected FROM events GROUP BY user_id",
        "session_disabled": f"SELECT DISTINCT user_id AS recording_id, 0::BIGINT AS n_monitored, '{fixed.DISABLED}' AS reason FROM events",
    }
    moved = clusters("(100 + floor(t / 10)::INT * 300 + recording_id % 50)::INT", "(60 + floor(t / 10)::INT * 100)::INT")
    for name, grouped in (("cluster_box", moved), ("session_box_cluster", clusters())):
        sql[name] = f"""WITH RECURSIVE {grouped},
k AS (SELECT recording_id, grp, count(*) / any_value(n_bins) AS part, {_MEDIAN} FROM done JOIN f USING (recording_id, pos) GROUP BY recording_id, grp),
r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY part DESC, grp) AS nth, lead(part) OVER (PARTITION BY recording_id ORDER BY part DESC, grp) AS second FROM k)
SELECT recording_id, CASE WHEN part < {fixed.DOMINANCE} AND part - second < {fixed.COMPETING_MARGIN} THEN '{fixed.COMPETING}' ELSE '' END AS diagnostic,
       {", ".join(f"CASE WHEN part >= {fixed.DOMINANCE} THEN {c} END AS {c}" for c in ("x1", "y1", "x2", "y2"))} FROM r WHERE nth = 1"""
    halves = f"h AS (SELECT recording_id, z.n_bins, split, half, count(*) AS n, {_MEDIAN} FROM z JOIN fam USING (n_bins, pos) GROUP BY ALL),"
    placed = "halved AS (SELECT recording_id, n_bins, split, half, x1, y1, x2, y2 FROM z JOIN fam USING (n_bins, pos)),"
    every = "h AS (SELECT recording_id, n_bins, split, half, occ.n, x1, y1, x2, y2 FROM occ_n LEFT JOIN occ USING (recording_id, n_bins, split, half)),"
    by_occupancy = f"{placed} {_occupied('halved', 'recording_id, n_bins, split, half')}, {every}"
    sql["split_half_occupancy"] = sql["split_half_stability"].replace(halves, by_occupancy)
    grouped = f"SELECT recording_id, segment, count(*) AS n, {_MEDIAN} FROM g WHERE segment IS NOT NULL GROUP BY recording_id, segment"
    named = f", sg AS (SELECT * FROM g WHERE segment IS NOT NULL), {_occupied('sg', 'recording_id, segment')}"
    sql["temporal_segments_occupancy"] = sql["temporal_segments"].replace(grouped, "") + f"{named} SELECT recording_id, segment, occ_n.n, x1, y1, x2, y2 FROM occ_n LEFT JOIN occ USING (recording_id, segment)"
    sql["split_half_quantile"] = sql["split_half_stability"].replace(_MEDIAN, _QUANTILE)
    sql["temporal_segments_quantile"] = sql["temporal_segments"].replace(_MEDIAN, _QUANTILE)
    sql["validate_box_resolution"] = f"""WITH {_PAIRS} SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 7 > 0 THEN '{fixed.MISMATCH}'
  WHEN ax1 < 0 OR ay1 < 0 OR ax2 > CASE WHEN event_id % 3 = 0 THEN 640 ELSE 1280 END OR ay2 > 720 THEN '{fixed.OUT_OF_FRAME}' ELSE '{fixed.VALID}' END AS reason FROM pr"""
    sql["cadence_due_exact"] = f"""WITH RECURSIVE {_OBS}, k AS (SELECT recording_id, frame_id, t, row_number() OVER (PARTITION BY recording_id ORDER BY t, frame_id) AS n FROM o),
s AS (SELECT recording_id, frame_id, t, n, TRUE AS due, (t + 0.5::DOUBLE)::DOUBLE AS later FROM k WHERE n = 1
      UNION ALL SELECT k.recording_id, k.frame_id, k.t, k.n, k.t + 1e-9::DOUBLE >= s.later,
                       CASE WHEN k.t + 1e-9::DOUBLE >= s.later THEN s.later + (trunc((k.t - s.later) / 0.5::DOUBLE) + 1) * 0.5::DOUBLE ELSE s.later END
      FROM s JOIN k ON k.recording_id = s.recording_id AND k.n = s.n + 1)
SELECT recording_id, frame_id, t, due FROM s"""
    sql["frame_features_sobel"] = f"""WITH {_PIX}, gr AS (SELECT recording_id, frame_index, y, x, round_even(0.114::DOUBLE * b + 0.587::DOUBLE * g + 0.299::DOUBLE * r, 0)::DOUBLE AS v FROM px),
off AS (SELECT dy, dx, (2 - abs(dy)) * dx AS wx, (2 - abs(dx)) * dy AS wy FROM (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)),
nb AS (SELECT recording_id, frame_index, y, x, wx, wy, CASE WHEN y + dy < 0 THEN 1 WHEN y + dy > 7 THEN 6 ELSE y + dy END AS ny, CASE WHEN x + dx < 0 THEN 1 WHEN x + dx > 7 THEN 6 ELSE x + dx END AS nx FROM gr, off),
sl AS (SELECT nb.recording_id, nb.frame_index, nb.y, nb.x, sum(wx * v) AS gx, sum(wy * v) AS gy FROM nb JOIN gr ON nb.recording_id = gr.recording_id AND nb.frame_index = gr.frame_index AND nb.ny = gr.y AND nb.nx = gr.x GROUP BY ALL),
sm AS (SELECT recording_id, frame_index, avg(sqrt(gx * gx + gy * gy)) AS gradient FROM sl GROUP BY ALL)
SELECT recording_id, frame_index, round(quantile_cont(v, 0.99) - quantile_cont(v, 0.01), 6) AS dynamic_range, round(avg((v <= 2)::INT), 6) AS crushed, round(avg((v >= 253)::INT), 6) AS saturated, round(any_value(gradient), 6) AS gradient
FROM gr JOIN sm USING (recording_id, frame_index) GROUP BY recording_id, frame_index"""
    sql["clean_mask"] = f"""WITH RECURSIVE {_PIX}, {_VOTES}, on_ AS (SELECT recording_id, y, x, y * 8 + x AS p FROM votes WHERE view),
reach AS (SELECT recording_id, p AS a, p AS b FROM on_
          UNION SELECT r.recording_id, r.a, q.p FROM reach r JOIN on_ o ON o.recording_id = r.recording_id AND o.p = r.b
                JOIN on_ q ON q.recording_id = r.recording_id AND abs(q.y - o.y) <= 1 AND abs(q.x - o.x) <= 1),
part AS (SELECT recording_id, a AS p, min(b) AS root, count(*) AS n FROM reach GROUP BY ALL),
best AS (SELECT recording_id, arg_min(root, -n * 100 + root) AS root FROM part GROUP BY recording_id)
SELECT recording_id, (p // 8)::INT AS y, (p % 8)::INT AS x FROM part JOIN best USING (recording_id, root)"""
    sql["recording_status"] = f"""WITH {_CLIP}, st AS (SELECT *, CASE WHEN fps IS NULL THEN 'no_frame_rate' WHEN n_there < n_frames THEN 'decode_failed' ELSE 'ok' END AS status, CASE WHEN fps IS NOT NULL THEN least(5.0::DOUBLE, fps) END AS hz FROM clip),
due AS (SELECT recording_id, count(DISTINCT slot) AS n_due FROM (SELECT recording_id, floor((unnest(range(0, n_frames)) / fps + 1e-9) * hz) AS slot FROM st WHERE status = 'ok') GROUP BY recording_id)
SELECT recording_id, status, CASE WHEN status = 'decode_failed' THEN n_there END AS first_missing, 5.0::DOUBLE AS monitor_hz, hz AS effective_monitor_hz, n_frames AS n_frames_in_source,
       coalesce(n_due, 0) AS n_frames_monitored, CASE WHEN status = 'ok' THEN least(n_frames, 24) ELSE 0 END AS n_calibration_frames FROM st LEFT JOIN due USING (recording_id)"""
    sql["recording_gaps"] = f"""WITH {_CLIP}, f AS (SELECT recording_id, n_there, fps, least(5.0::DOUBLE, fps) AS hz, unnest(range(0, n_frames + recording_id % 3)) AS i FROM clip WHERE fps IS NOT NULL),
s AS (SELECT recording_id, n_there, i, floor((i / fps + 1e-9) * hz) AS slot FROM f)
SELECT recording_id, i AS frame_index FROM (SELECT *, lag(slot) OVER (PARTITION BY recording_id ORDER BY i) AS prev FROM s) WHERE (prev IS NULL OR slot > prev) AND i >= n_there"""
    sql["calibration_frames"] = f"""WITH {_CLIP}, w AS (SELECT DISTINCT recording_id, n_there, round_even(i * (greatest(n_frames - 1, 0) / 23.0::DOUBLE), 0)::BIGINT AS frame_index FROM clip, (SELECT unnest(range(0, 24)) AS i))
SELECT recording_id, frame_index, 64::BIGINT AS n_pixels FROM w WHERE frame_index < n_there"""
    sql["dropped_frames"] = f"WITH {_PIX}, {_FEAT} SELECT recording_id, frame_index FROM ad WHERE reason IS NOT NULL"
    sql["scheduled_count"] = f"SELECT recording_id, count(*) AS n_due FROM ({sql['cadence_due_regular']}) GROUP BY recording_id"
    return sql


ORACLES: dict[str, str] = build()
