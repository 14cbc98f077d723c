"""DuckDB text for the registered queries, written independently of the Spark operators."""

from __future__ import annotations

_OBS = """
beans AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS run_id,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey,
                            l_extendedprice, l_quantity) AS truth_no,
         l_partkey, l_quantity, CAST(floor(l_extendedprice) AS BIGINT) AS price
  FROM lineitem),
flights AS (
  SELECT *, truth_no * 0.045E0 + floor(truth_no / 20E0) * 0.5E0 + (l_partkey * 7 % 11) * 0.001E0
              AS release_s,
         (l_quantity - 25.5E0) * 1.95E0 AS x0_mm, (l_partkey % 21 - 10) * 2E0 AS vx FROM beans),
frames AS (
  SELECT f.*, CAST(ceil((release_s + 0.06386E0) * 60E0) AS BIGINT) + o.i AS frame_index, o.i AS step
  FROM flights f CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5)) AS o(i)),
obs AS (
  SELECT run_id, truth_no, frame_index, frame_index * 16666667 AS timestamp_ns,
         x0_mm + vx * (frame_index / 60E0 - release_s)
           + ((l_partkey * 31 + frame_index * 17) % 101 - 50) * 0.004E0 AS x_mm,
         -57E0 + 4905E0 * (frame_index / 60E0 - release_s) * (frame_index / 60E0 - release_s)
           + ((l_partkey * 13 + frame_index * 29) % 101 - 50) * 0.004E0 AS y_mm,
         CAST(2000 + price % 3000 AS BIGINT) AS area_px
  FROM frames
  WHERE frame_index <= (release_s + 0.13844E0) * 60E0 AND (l_partkey + frame_index) % 29 <> 0
  UNION ALL
  SELECT run_id, -truth_no, frame_index, frame_index * 16666667, -x0_mm * 0.5E0,
         CASE WHEN l_partkey % 2 = 0 THEN -30E0 ELSE 5E0 END,
         CAST(2000 + price % 3000 AS BIGINT)
  FROM frames WHERE l_partkey % 17 = 0 AND step = 0),
seen AS (
  SELECT run_id, truth_no, frame_index, timestamp_ns, x_mm, y_mm,
         727.5E0 + x_mm * 14.86E0 AS cx_px, 543.5E0 + y_mm * 14.7E0 AS cy_px,
         CAST(floor(727.5E0 + x_mm * 14.86E0) AS INT) - 30 AS bbox_x,
         CAST(floor(543.5E0 + y_mm * 14.7E0) AS INT) - 30 AS bbox_y,
         60 AS bbox_w, 60 AS bbox_h, area_px,
         CAST(row_number() OVER (PARTITION BY run_id, frame_index
                                 ORDER BY y_mm, x_mm, truth_no) AS INT) AS det_ord
  FROM obs)
"""

_SPANS = """
spans AS (SELECT run_id, min(frame_index) AS first_frame, max(frame_index) + 6 AS last_frame
          FROM obs GROUP BY run_id)
"""

_CAL = """
raw_cal AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS run_id, CAST(s_suppkey % 7 - 3 AS DOUBLE) AS k FROM supplier),
fwd AS (
  SELECT run_id, 14.86E0 AS a, 0.02E0 * k AS b, 727.5E0 + k AS c, -0.02E0 * k AS d, 14.7E0 AS e,
         543.5E0 - k AS f, 1E-5 * k AS g, 0E0 AS h, 1E0 AS i FROM raw_cal),
cof AS (
  SELECT *, e*i - f*h AS m0, c*h - b*i AS m1, b*f - c*e AS m2, f*g - d*i AS m3, a*i - c*g AS m4,
         c*d - a*f AS m5, d*h - e*g AS m6, b*g - a*h AS m7, a*e - b*d AS m8 FROM fwd),
cal AS (
  SELECT run_id, a, b, c, d, e, f, g, h, i, m0/m8 AS n0, m1/m8 AS n1, m2/m8 AS n2, m3/m8 AS n3,
         m4/m8 AS n4, m5/m8 AS n5, m6/m8 AS n6, m7/m8 AS n7 FROM cof)
"""


def q(expression: str, digits: int) -> str:
    scale = f"1E{digits}"
    return f"(floor(({expression}) * {scale} + 0.5E0) / {scale})"


def _mm(axis: str, x: str, y: str) -> str:
    top = f"n0*({x}) + n1*({y}) + n2" if axis == "x" else f"n3*({x}) + n4*({y}) + n5"
    return f"(({top}) / (n6*({x}) + n7*({y}) + 1E0))"


def _px(axis: str, x: str, y: str) -> str:
    top = f"a*({x}) + b*({y}) + c" if axis == "x" else f"d*({x}) + e*({y}) + f"
    return f"(({top}) / (g*({x}) + h*({y}) + i))"


# Tracker defaults.
_G, _SIGMA, _R, _GATE = "9810E0", "2500E0", "(0.22E0*0.22E0)", "25E0"
_DT = "(16666667 / 1E9)"

_BORN = f"""
born AS (
  SELECT run_id, frame_index, det_ord, timestamp_ns, x_mm, y_mm, area_px,
         sqrt(2E0 * {_G} * greatest(0E0, y_mm + 57E0)) AS vy, 4E0 * {_R} AS p_pos,
         0E0 AS p_cross, 250000E0 AS p_vel
  FROM seen)
"""


def _crossed(p_vel: str = "p_vel") -> str:
    return f"""
crossed AS (
  SELECT *, x_mm AS x_mean,
         sqrt(greatest(p_pos + 2E0*t*p_cross + t*t*{p_vel}
              + (0.5E0*t*t*{_SIGMA}) * (0.5E0*t*t*{_SIGMA}), 0.0025E0)) AS x_std
  FROM (SELECT *, CASE WHEN 67E0 - y_mm <= 0 THEN 0E0
               ELSE (sqrt(vy*vy + 2E0*{_G}*(67E0 - y_mm)) - vy) / {_G} END AS t FROM born)
  WHERE t IS NOT NULL AND t >= 0)
"""


# Independent normal distribution: composite Gauss-Legendre quadrature of the density.
# Nodes and weights of the 10-point rule on [-1, 1].
_NODES = """
rule(node, weight) AS (VALUES
  (-0.9739065285171717E0, 0.0666713443086881E0), (-0.8650633666889845E0, 0.1494513491505806E0),
  (-0.6794095682990244E0, 0.2190863625159820E0), (-0.4333953941292472E0, 0.2692667193099963E0),
  (-0.1488743389816312E0, 0.2955242247147529E0), (0.1488743389816312E0, 0.2955242247147529E0),
  (0.4333953941292472E0, 0.2692667193099963E0), (0.6794095682990244E0, 0.2190863625159820E0),
  (0.8650633666889845E0, 0.1494513491505806E0), (0.9739065285171717E0, 0.0666713443086881E0)),
quad AS (
  SELECT list({'u': (p + 0.5E0 + 0.5E0 * node) / 8E0, 'w': 0.5E0 * weight / 8E0}) AS points
  FROM rule, range(8) AS panels(p))
"""


def _cdf(z: str) -> str:
    """Normal CDF of z: 0.5 + z * integral over [0,1] of the density at z*u."""
    clipped = f"greatest(-9E0, least(9E0, {z}))"
    return (
        f"(0.5E0 + {clipped} * list_sum(list_transform(points, lambda s: s.w * "
        f"exp(-0.5E0 * ({clipped}*s.u) * ({clipped}*s.u)))) / sqrt(2E0 * pi()))"
    )


_GATES = f"""
edges AS (
  SELECT run_id, frame_index, det_ord, j, {_cdf("((j - 10.5E0) * 5E0 - x_mean) / x_std")} AS cdf
  FROM crossed, quad, range(22) AS e(j)),
gate AS (
  SELECT run_id, frame_index, det_ord, CAST(j - 10 AS INT) AS gate_index,
         greatest(0E0, least(1E0, lead(cdf) OVER (PARTITION BY run_id, frame_index, det_ord
                                                  ORDER BY j) - cdf)) AS p
  FROM edges QUALIFY j < 21)
"""

_COSTS = f"""
moved AS MATERIALIZED (
  SELECT run_id, frame_index + 1 AS frame_index, det_ord AS track, area_px AS last_area,
         x_mm AS px, y_mm + vy*{_DT} + 0.5E0*{_DT}*{_DT}*{_G} AS py,
         p_pos + {_DT}*{_DT}*p_vel + {_SIGMA}*{_SIGMA}*(0.5E0*{_DT}*{_DT})*(0.5E0*{_DT}*{_DT})
           + {_R} AS var
  FROM born),
here AS MATERIALIZED (SELECT run_id, frame_index, det_ord, x_mm, y_mm, area_px FROM seen),
pairs AS MATERIALIZED (
  SELECT m.run_id, m.frame_index, m.track, s.det_ord AS detection,
         ((s.x_mm-px)*(s.x_mm-px) + (s.y_mm-py)*(s.y_mm-py)) / var AS d2,
         abs(ln(greatest(s.area_px, 1) / greatest(last_area, 1))) * 0.18E0 AS look
  FROM moved m JOIN here s ON s.run_id = m.run_id AND s.frame_index = m.frame_index
    AND ((s.x_mm-px)*(s.x_mm-px) + (s.y_mm-py)*(s.y_mm-py)) / var <= {_GATE}),
costs AS (
  SELECT run_id, frame_index, CAST(track AS BIGINT) AS track, CAST(detection AS BIGINT) AS detection,
         d2 / {_GATE} + look AS cost
  FROM pairs WHERE d2 <= {_GATE} AND d2 / {_GATE} + look < 1)
"""

_LABELLED = f"""
steps AS (
  SELECT run_id, truth_no AS label, frame_index, timestamp_ns, x_mm, y_mm,
         row_number() OVER (PARTITION BY run_id, truth_no ORDER BY frame_index) AS n,
         (timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY run_id, truth_no
                                                 ORDER BY frame_index)) / 1E9 AS dt
  FROM obs WHERE truth_no > 0),
filtered AS (
  SELECT run_id, label, frame_index, n, x_mm AS x, y_mm AS y, 0E0 AS vx,
         sqrt(2E0*{_G}*greatest(0E0, y_mm + 57E0)) AS vy, 4E0*{_R} AS pp, 0E0 AS pc, 250000E0 AS pv
  FROM steps WHERE n = 1
  UNION ALL
  SELECT run_id, label, frame_index, n,
         x1 + k1*(x_mm - x1), y1 + k1*(y_mm - y1), vx + k2*(x_mm - x1), vy1 + k2*(y_mm - y1),
         (1E0-k1)*(1E0-k1)*pp1 + k1*k1*{_R},
         (1E0-k1)*(pc1 - k2*pp1) + k1*k2*{_R},
         pv1 - 2E0*k2*pc1 + k2*k2*pp1 + k2*k2*{_R}
  FROM (SELECT *, pp1 / (pp1 + {_R}) AS k1, pc1 / (pp1 + {_R}) AS k2
        FROM (SELECT s.run_id, s.label, s.frame_index, s.n, s.x_mm, s.y_mm, p.vx,
                     p.x + p.vx*dt AS x1, p.y + p.vy*dt + 0.5E0*{_G}*dt*dt AS y1,
                     p.vy + {_G}*dt AS vy1,
                     p.pp + 2E0*dt*p.pc + dt*dt*p.pv + {_SIGMA}*{_SIGMA}*0.25E0*dt*dt*dt*dt AS pp1,
                     p.pc + dt*p.pv + {_SIGMA}*{_SIGMA}*0.5E0*dt*dt*dt AS pc1,
                     p.pv + {_SIGMA}*{_SIGMA}*dt*dt AS pv1
              FROM filtered p JOIN steps s
                ON s.run_id = p.run_id AND s.label = p.label AND s.n = p.n + 1)))
"""

_SIDECARS = f"""
lines AS (
  SELECT run_id, t AS line_no,
         CASE WHEN CAST(run_id AS BIGINT) % 7 = 0 AND t = 10 THEN 5 * 16666667
              ELSE t * 16666667 END AS ts
  FROM (SELECT run_id, unnest(range(0, last_frame + 1
               - CASE WHEN CAST(run_id AS BIGINT) % 11 = 0 THEN 1 ELSE 0 END)) AS t FROM spans)),
validity AS (
  SELECT run_id, count(*) AS row_count, bool_and(prev IS NULL OR ts > prev) AS is_valid
  FROM (SELECT *, lag(ts) OVER (PARTITION BY run_id ORDER BY line_no) AS prev FROM lines)
  GROUP BY run_id)
"""

# The command fold as a recursion over each bean's own commands.
_FOLD = """
ev AS (
  SELECT event_id AS n, CAST(user_id AS VARCHAR) AS run_id, event_type,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(round(value * 100) AS BIGINT) AS cents FROM events),
cmd0 AS (
  SELECT *, 1 + k % 7 AS sequence,
         1000000000000 + n * 1000000 - CASE WHEN n % 60 = 59 THEN 500000000000 ELSE 0 END AS ts,
         CASE WHEN (k*3 + cents) % 10 < 2 THEN 'tentative' WHEN (k*3 + cents) % 10 < 7 THEN 'confirmed'
              WHEN (k*3 + cents) % 10 < 9 THEN 'occluded' ELSE 'exited' END AS status
  FROM ev),
cmd1 AS (
  SELECT c.*, v.copy, n * 3 + v.copy AS command_seq,
         CASE WHEN n % 50 = 0 THEN 'reuse-' || run_id || '-' || sequence ELSE 'e-' || n END
           || CASE WHEN v.copy = 2 THEN 'x' ELSE '' END AS event_id
  FROM cmd0 c JOIN (VALUES (0),(1),(2)) AS v(copy)
    ON v.copy = 0 OR (v.copy = 1 AND n % 40 = 38) OR (v.copy = 2 AND n % 40 = 18)),
cmd AS (
  SELECT run_id, sequence, command_seq, event_id, k, cents, ts AS base_ts,
         CASE WHEN event_type IN ('view', 'click') THEN 'T' WHEN event_type = 'signup' THEN 'E'
              WHEN event_type = 'purchase' THEN 'D' ELSE 'A' END AS op, status,
         CASE WHEN event_type IN ('view', 'click', 'signup', 'purchase') THEN ts
              ELSE ts + 60000000 END AS ts,
         CASE WHEN event_type = 'signup' THEN 'r-' || run_id || '-' || (k % 5)
              WHEN event_type IN ('purchase', 'error') THEN 'd-' || run_id || '-' || (k % 4) END AS part_id,
         CASE WHEN event_type IN ('view', 'click') THEN concat_ws('|', 'T', n, status)
              WHEN event_type = 'signup' THEN concat_ws('|', 'E', k % 3, cents, ts, k % 5)
              WHEN event_type = 'purchase' THEN concat_ws('|', 'D', k % 4, n, ts, k % 5, cents % 5)
              ELSE concat_ws('|', 'A', k % 4, ts) END AS content,
         CASE WHEN event_type = 'signup' AND cents % 120 > 100 THEN true
              WHEN event_type = 'purchase' AND (n % 70 = 0 OR k % 5 = cents % 5 + 3) THEN true
              ELSE false END AS broken,
         row_number() OVER (PARTITION BY run_id, sequence ORDER BY command_seq) AS rn
  FROM cmd1),
fold AS (
  SELECT run_id, sequence, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS command_seq,
         CAST('' AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS error_type,
         CAST(0 AS BIGINT) AS revision, CAST(NULL AS VARCHAR) AS kind,
         CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS track_ts,
         CAST(NULL AS BIGINT) AS created_ts, CAST(NULL AS BIGINT) AS updated_ts,
         CAST(NULL AS VARCHAR) AS d_id, CAST(NULL AS VARCHAR) AS d_content,
         CAST(NULL AS BIGINT) AS d_ts, CAST(NULL AS BIGINT) AS d_ack,
         CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS id_contents,
         CAST([] AS VARCHAR[]) AS results, CAST([] AS VARCHAR[]) AS result_contents
  FROM (SELECT DISTINCT run_id, sequence FROM cmd)
  UNION ALL
  SELECT run_id, sequence, rn, command_seq, outcome,
         CASE WHEN outcome = 'rejected' THEN reason END,
         revision + CASE WHEN ok THEN 1 ELSE 0 END,
         CASE WHEN NOT ok THEN NULL WHEN op = 'E' THEN 'enrichment.added'
              WHEN op = 'D' THEN 'sorting.decision' WHEN op = 'A' THEN 'sorting.acknowledged'
              WHEN status IS NULL THEN 'bean.created'
              WHEN new_status IN ('exited', 'cancelled') THEN 'bean.' || new_status
              WHEN status = 'tentative' AND new_status = 'confirmed' THEN 'bean.confirmed'
              ELSE 'track.updated' END,
         CASE WHEN ok AND op = 'T' THEN new_status ELSE status END,
         CASE WHEN ok AND op = 'T' THEN ts ELSE track_ts END,
         CASE WHEN ok AND revision = 0 THEN ts ELSE created_ts END,
         CASE WHEN ok THEN greatest(coalesce(updated_ts, ts), ts) ELSE updated_ts END,
         CASE WHEN ok AND op = 'D' THEN part_id ELSE d_id END,
         CASE WHEN ok AND op = 'D' THEN content ELSE d_content END,
         CASE WHEN ok AND op = 'D' THEN ts ELSE d_ts END,
         CASE WHEN ok AND op = 'D' THEN NULL WHEN ok AND op = 'A' THEN ts ELSE d_ack END,
         CASE WHEN ok THEN list_append(ids, event_id) ELSE ids END,
         CASE WHEN ok THEN list_append(id_contents, content) ELSE id_contents END,
         CASE WHEN ok AND op = 'E' THEN list_append(results, part_id) ELSE results END,
         CASE WHEN ok AND op = 'E' THEN list_append(result_contents, content) ELSE result_contents END
  FROM (SELECT *, outcome = 'applied' AS ok FROM (
    SELECT *, CASE WHEN reason IN ('applied', 'duplicate', 'noop') THEN reason ELSE 'rejected' END
                AS outcome FROM (
      SELECT f.* EXCLUDE (rn, command_seq, outcome, error_type, kind), c.rn, c.command_seq,
             c.event_id, c.op, c.status AS new_status, c.ts, c.part_id, c.content,
        CASE
          WHEN c.broken THEN 'conflict'
          WHEN list_contains(f.ids, c.event_id) THEN
            CASE WHEN f.id_contents[list_position(f.ids, c.event_id)] = c.content THEN 'duplicate'
                 ELSE 'conflict' END
          WHEN c.op <> 'T' AND f.revision = 0 THEN 'not_found'
          WHEN c.op = 'T' THEN
            CASE WHEN f.status IS NULL THEN 'applied'
                 WHEN c.ts < f.track_ts THEN 'stale'
                 WHEN (f.status || '>' || c.status) IN
                   ('tentative>tentative', 'tentative>confirmed', 'tentative>cancelled',
                    'confirmed>confirmed', 'confirmed>occluded', 'confirmed>exited',
                    'occluded>occluded', 'occluded>confirmed', 'occluded>exited') THEN 'applied'
                 ELSE 'conflict' END
          WHEN c.op = 'E' THEN
            CASE WHEN NOT list_contains(f.results, c.part_id) THEN 'applied'
                 WHEN f.result_contents[list_position(f.results, c.part_id)] = c.content THEN 'noop'
                 ELSE 'conflict' END
          WHEN c.op = 'D' THEN
            CASE WHEN f.d_id IS NULL THEN 'applied'
                 WHEN f.d_id = c.part_id AND f.d_content = c.content AND f.d_ack IS NULL THEN 'noop'
                 WHEN f.d_id = c.part_id OR f.d_ack IS NOT NULL THEN 'conflict'
                 ELSE 'applied' END
          ELSE
            CASE WHEN f.d_id IS NULL OR f.d_id <> c.part_id THEN 'conflict'
                 WHEN c.ts < f.d_ts THEN 'stale'
                 WHEN f.d_ack = c.ts THEN 'noop'
                 WHEN f.d_ack IS NOT NULL THEN 'conflict'
                 ELSE 'applied' END
        END AS reason
      FROM fold f JOIN cmd c
        ON c.run_id = f.run_id AND c.sequence = f.sequence AND c.rn = f.rn + 1)))),
outcomes AS (
  SELECT f.run_id, f.sequence, f.command_seq, c.event_id, f.outcome, f.error_type, f.revision,
         f.kind, f.track_ts, f.status AS bean_status, f.created_ts, f.updated_ts, c.op, c.ts, c.part_id, c.k,
         c.cents, f.d_id, f.d_ack
  FROM fold f JOIN cmd c ON c.run_id = f.run_id AND c.sequence = f.sequence AND c.rn = f.rn
  WHERE f.rn > 0),
jr AS (
  SELECT *, row_number() OVER (ORDER BY command_seq) AS stream_sequence
  FROM outcomes WHERE outcome = 'applied'),
bean_now AS (
  SELECT run_id, sequence, max(revision) AS revision, arg_max(bean_status, revision) AS status,
         arg_min(created_ts, revision) AS created_timestamp_ns,
         arg_max(updated_ts, revision) AS updated_timestamp_ns
  FROM jr GROUP BY run_id, sequence),
decision_now AS (
  SELECT run_id, sequence, d_id AS decision_id,
         max(revision) AS registry_revision, arg_max(coalesce(d_ack, -1), revision) AS ack
  FROM jr WHERE d_id IS NOT NULL GROUP BY run_id, sequence, d_id),
first_decision AS (
  SELECT run_id, sequence, part_id AS decision_id, arg_min(ts, revision) AS timestamp_ns,
         arg_min((k % 5) || ',' || (cents % 5 + 3), revision) AS gate_indices
  FROM jr WHERE kind = 'sorting.decision' GROUP BY run_id, sequence, part_id),
enrich_now AS (
  SELECT part_id AS result_id, run_id, sequence, revision AS registry_revision,
         ['defect', 'size', 'note'][1 + k % 3] AS kind, '{"cents":' || cents || '}' AS value_json,
         ts AS timestamp_ns, (cents % 120) / 100E0 AS confidence
  FROM jr WHERE kind = 'enrichment.added')
"""

_EVENT_COLUMNS = "stream_sequence, event_id, kind, run_id, sequence, revision, ts AS timestamp_ns"


def _with(select: str, *parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join(parts)} {select}"


def build() -> dict[str, str]:
    row = "run_id, frame_index, det_ord"
    truth = "run_id, truth_no, frame_index"
    mid = "727.5E0"
    sql: dict[str, str] = {}

    sql["flight_observations"] = _with("SELECT * FROM seen", _OBS)
    sql["project_mm"] = _with(
        f"SELECT {truth}, {q(_mm('x', 'cx_px', 'cy_px'), 6)} AS x_mm, "
        f"{q(_mm('y', 'cx_px', 'cy_px'), 6)} AS y_mm "
        "FROM (SELECT run_id, truth_no, frame_index, cx_px, cy_px FROM seen) JOIN cal USING (run_id)",
        _OBS, _CAL,
    )
    sql["project_px"] = _with(
        f"SELECT {truth}, {q(_px('x', 'x_mm', 'y_mm'), 5)} AS x_px, "
        f"{q(_px('y', 'x_mm', 'y_mm'), 5)} AS y_px "
        "FROM (SELECT run_id, truth_no, frame_index, x_mm, y_mm FROM seen) JOIN cal USING (run_id)",
        _OBS, _CAL,
    )
    slope = {
        "ax": f"({_mm('x', 'cx_px + 0.5E0', 'cy_px')} - {_mm('x', 'cx_px', 'cy_px')}) / 0.5E0",
        "ay": f"({_mm('y', 'cx_px + 0.5E0', 'cy_px')} - {_mm('y', 'cx_px', 'cy_px')}) / 0.5E0",
        "bx": f"({_mm('x', 'cx_px', 'cy_px + 0.5E0')} - {_mm('x', 'cx_px', 'cy_px')}) / 0.5E0",
        "by": f"({_mm('y', 'cx_px', 'cy_px + 0.5E0')} - {_mm('y', 'cx_px', 'cy_px')}) / 0.5E0",
    }
    slopes = ", ".join(f"{text} AS s_{name}" for name, text in slope.items())
    sql["measurement_cov"] = _with(
        f"SELECT {truth}, {q('2.25E0*(s_ax*s_ax + s_bx*s_bx) + 0.039E0*0.039E0', 7)} AS cov_xx, "
        f"{q('2.25E0*(s_ax*s_ay + s_bx*s_by)', 7)} AS cov_xy, "
        f"{q('2.25E0*(s_ay*s_ay + s_by*s_by) + 0.039E0*0.039E0', 7)} AS cov_yy "
        f"FROM (SELECT {truth}, {slopes} FROM (SELECT {truth}, cx_px, cy_px FROM seen) "
        "JOIN cal USING (run_id))",
        _OBS, _CAL,
    )
    sql["field_of_view"] = _with(
        f"SELECT run_id, {q(_mm('y', mid, '0E0'), 6)} AS top_y_mm, "
        f"{q(_mm('y', mid, '1087E0'), 6)} AS bottom_y_mm, "
        f"{q(_mm('y', mid, '1087E0') + ' + 30E0', 6)} AS line_y_mm FROM cal",
        _CAL,
    )
    sql["sidecar_validity"] = _with("SELECT * FROM validity", _OBS, _SPANS, _SIDECARS)
    sql["timeline_exact_nominal"] = _with(
        "SELECT f.run_id, f.frame_index, CASE WHEN exact_timestamps THEN l.ts "
        "ELSE CAST(round_even(f.frame_index * (1E9 / 60E0), 0) AS BIGINT) END AS timestamp_ns, "
        "exact_timestamps FROM (SELECT s.run_id, unnest(range(0, s.last_frame + 1)) AS frame_index, "
        "v.is_valid AND v.row_count >= s.last_frame + 1 AS exact_timestamps "
        "FROM spans s JOIN validity v USING (run_id)) f "
        "LEFT JOIN lines l ON l.run_id = f.run_id AND l.line_no = f.frame_index",
        _OBS, _SPANS, _SIDECARS,
    )
    sql["flight_segments"] = _with(
        "SELECT run_id, min(frame_index) AS first_frame, max(frame_index) AS last_frame, "
        "sum(n) AS detections FROM (SELECT *, sum(opens) OVER (PARTITION BY run_id ORDER BY "
        "frame_index) AS part FROM (SELECT *, CASE WHEN frame_index - lag(frame_index) OVER "
        "(PARTITION BY run_id ORDER BY frame_index) <= 3 THEN 0 ELSE 1 END AS opens FROM "
        "(SELECT run_id, frame_index, count(*) AS n FROM obs GROUP BY ALL))) GROUP BY run_id, part",
        _OBS,
    ).replace("sum(n) AS", "CAST(sum(n) AS BIGINT) AS")
    sql["edge_birth_class"] = _with(
        f"SELECT {truth}, CASE WHEN bbox_x < 50 AND bbox_x + bbox_w > 1406 THEN "
        "'left and right birth margins' WHEN bbox_x < 50 THEN 'left birth margin' "
        "WHEN bbox_x + bbox_w > 1406 THEN 'right birth margin' "
        "WHEN y_mm > -11 THEN 'outside top birth region' END AS rejection FROM seen",
        _OBS,
    )
    sql["birth_states"] = _with(
        f"SELECT {row}, x_mm, y_mm, {q('vy', 6)} AS vy_mm_s, {q('p_pos', 6)} AS p_pos, p_vel, "
        "'tentative' AS status FROM born",
        _OBS, _BORN,
    )
    sql["propagated_states"] = _with(
        f"SELECT {row}, {q('x_mm', 6)} AS x_mm, "
        f"{q(f'y_mm + vy*{_DT} + 0.5E0*{_DT}*{_DT}*{_G}', 6)} AS y_mm, "
        f"{q(f'vy + {_G}*{_DT}', 6)} AS vy_mm_s, "
        f"{q(f'p_pos + {_DT}*{_DT}*p_vel + 6250000E0*0.25E0*{_DT}*{_DT}*{_DT}*{_DT}', 6)} AS p_pos, "
        f"{q(f'{_DT}*p_vel + 6250000E0*0.5E0*{_DT}*{_DT}*{_DT}', 5)} AS p_cross, "
        f"{q(f'p_vel + 6250000E0*{_DT}*{_DT}', 4)} AS p_vel FROM born",
        _OBS, _BORN,
    )
    sql["candidate_costs"] = _with(
        f"SELECT run_id, frame_index, track, detection, {q('cost', 7)} AS cost FROM costs",
        _OBS, _BORN, _COSTS,
    )
    sql["assignment_cost"] = _with(
        "SELECT run_id, frame_index, any_value(tracks) AS tracks, "
        "CAST(arg_min(matched, total + tracks - matched) AS BIGINT) AS matched, "
        f"{q('min(total + tracks - matched)', 6)} AS total_cost "
        "FROM walk JOIN size USING (run_id, frame_index) WHERE step = tracks "
        "GROUP BY run_id, frame_index",
        _OBS, _BORN, _COSTS,
        "size AS (SELECT run_id, frame_index, count(DISTINCT track) AS tracks FROM costs GROUP BY ALL)",
        "numbered AS (SELECT *, dense_rank() OVER (PARTITION BY run_id, frame_index ORDER BY track) "
        "AS step FROM costs)",
        "options AS (SELECT DISTINCT run_id, frame_index, step, CAST(NULL AS BIGINT) AS detection, "
        "0E0 AS cost FROM numbered UNION ALL "
        "SELECT run_id, frame_index, step, detection, cost FROM numbered)",
        "walk AS (SELECT run_id, frame_index, CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS used, "
        "0E0 AS total, CAST(0 AS BIGINT) AS matched FROM size UNION ALL "
        "SELECT w.run_id, w.frame_index, o.step, CASE WHEN o.detection IS NULL THEN w.used ELSE "
        "list_append(w.used, o.detection) END, w.total + o.cost, "
        "w.matched + CASE WHEN o.detection IS NULL THEN 0 ELSE 1 END "
        "FROM walk w JOIN options o ON o.run_id = w.run_id AND o.frame_index = w.frame_index "
        "AND o.step = w.step + 1 WHERE o.detection IS NULL OR NOT list_contains(w.used, o.detection))",
        recursive=True,
    )
    sql["filter_labelled"] = _with(
        "SELECT run_id, label, frame_index, CAST(n AS INT) AS hits, "
        "CASE WHEN n >= 2 THEN 'confirmed' ELSE 'tentative' END AS status, "
        f"{q('x', 5)} AS x_mm, {q('y', 5)} AS y_mm, {q('vx', 3)} AS vx_mm_s, {q('vy', 3)} AS vy_mm_s, "
        f"{q('pp', 7)} AS p_pos, {q('pc', 5)} AS p_cross, {q('pv', 3)} AS p_vel FROM filtered",
        _OBS, _LABELLED, recursive=True,
    )
    crossed = _crossed()
    speed = f"greatest(abs(vy + {_G}*t), 1E0)"
    spread = (
        f"p_pos + 2E0*t*p_cross + t*t*p_vel + (0.5E0*t*t*{_SIGMA}) * (0.5E0*t*t*{_SIGMA})"
    )
    sql["crossing"] = _with(
        f"SELECT {row}, {q('t', 8)} AS seconds_until_crossing, "
        "timestamp_ns + CAST(round_even(t * 1E9, 0) AS BIGINT) AS crossing_timestamp_ns, "
        f"{q('x_mean', 6)} AS x_mean_mm, {q('x_std', 6)} AS x_std_mm, "
        f"{q(f'1000E0 * sqrt(greatest({spread}, 0E0)) / {speed}', 6)} AS time_std_ms FROM crossed",
        _OBS, _BORN, crossed,
    )
    sql["gate_probabilities"] = _with(
        f"SELECT run_id, gate_index, count(*) AS predictions, {q('sum(p)', 4)} AS expected, "
        f"{q('max(p)', 7)} AS sharpest FROM gate GROUP BY run_id, gate_index",
        _OBS, _BORN, crossed, _NODES, _GATES,
    )
    sharp = _crossed("400E0")
    best = (
        "best AS (SELECT run_id, frame_index, det_ord, arg_max(gate_index, (p, -gate_index)) AS g, "
        "max(p) AS p FROM gate GROUP BY ALL)"
    )
    sql["best_gate"] = _with(
        f"SELECT {row}, g AS best_gate, CASE WHEN g = 0 THEN 'G0' WHEN g > 0 THEN 'G+' || g "
        f"ELSE 'G' || g END AS best_label, {q('p', 7)} AS best_probability FROM best",
        _OBS, _BORN, sharp, _NODES, _GATES, best,
    )
    sql["selected_gates"] = _with(
        f"SELECT {row}, gate_index FROM gate WHERE p >= 0.35", _OBS, _BORN, sharp, _NODES, _GATES
    )
    sql["frame_selected_gates"] = _with(
        "SELECT run_id, frame_index, string_agg(gate_index, ',' ORDER BY gate_index) AS "
        "selected_gates FROM (SELECT DISTINCT run_id, frame_index, gate_index FROM gate "
        "WHERE p >= 0.35) GROUP BY run_id, frame_index",
        _OBS, _BORN, sharp, _NODES, _GATES,
    )
    low, high = "(x_mean - 1.96E0*x_std)", "(x_mean + 1.96E0*x_std)"
    px = lambda x: q(_px("x", x, "67E0"), 4)
    sql["interval95"] = _with(
        f"SELECT {row}, {q(low, 5)} AS low_mm, {q(high, 5)} AS high_mm, {px(low)} AS low_x_px, "
        f"{px('x_mean')} AS mean_x_px, {px(high)} AS high_x_px, "
        f"{q(_px('y', 'x_mean', '67E0'), 4)} AS mean_y_px FROM crossed JOIN cal USING (run_id)",
        _OBS, _BORN, crossed, _CAL,
    )
    tau = "(t * (s / 24E0))"
    fall = f"(y_mm + vy*{tau} + 4905E0*{tau}*{tau})"
    sql["flight_path"] = _with(
        f"SELECT run_id, CAST(s AS INT) AS sample, count(*) AS points, "
        f"{q('avg(' + _px('x', 'x_mm', fall) + ')', 4)} AS x_px, "
        f"{q('avg(' + _px('y', 'x_mm', fall) + ')', 4)} AS y_px, "
        f"{q('max(' + _px('y', 'x_mm', fall) + ')', 4)} AS lowest_px "
        "FROM crossed JOIN cal USING (run_id), range(25) AS samples(s) GROUP BY run_id, s",
        _OBS, _BORN, crossed, _CAL,
    )
    sql["detection_accounting"] = _with(
        "SELECT run_id, frame_index, count(*) AS detections, min(det_ord) AS first_det, "
        "max(det_ord) AS last_det, min(y_mm) AS top_y_mm, max(y_mm) AS low_y_mm FROM seen "
        "GROUP BY run_id, frame_index",
        _OBS,
    )
    sql["unassigned_detections"] = _with(
        "SELECT run_id, frame_index, det_ord FROM seen WHERE det_ord IS NULL", _OBS
    )

    def folded(select: str) -> str:
        return _with(select, _FOLD, recursive=True)

    sql["command_outcomes"] = folded(
        "SELECT command_seq, run_id, sequence, event_id, outcome, error_type, revision, kind "
        "FROM outcomes"
    )
    sql["journal"] = folded(f"SELECT {_EVENT_COLUMNS} FROM jr")
    sql["sessions_min"] = folded(
        "SELECT run_id, min(created_ts) AS created_timestamp_ns FROM jr GROUP BY run_id"
    )
    sql["latest_state"] = folded("SELECT * FROM bean_now")
    sql["decisions_current"] = folded(
        "SELECT decision_id, run_id, sequence, registry_revision, timestamp_ns, gate_indices, "
        "nullif(ack, -1) AS acknowledged_timestamp_ns "
        "FROM decision_now JOIN first_decision USING (run_id, sequence, decision_id)"
    )
    first = lambda value: f"arg_min({value}, stream_sequence)"
    sql["enrichments_first"] = folded(
        f"SELECT part_id AS result_id, {first('run_id')} AS run_id, {first('sequence')} AS sequence, "
        f"{first('revision')} AS registry_revision, {first("['defect', 'size', 'note'][1 + k % 3]")} AS kind, "
        f"""{first("""'{"cents":' || cents || '}'""")} AS value_json, {first('ts')} AS timestamp_ns, """
        f"{first('(cents % 120) / 100E0')} AS confidence FROM jr WHERE kind = 'enrichment.added' GROUP BY part_id"
    )
    sql["enrichments_by_kind"] = folded(
        "SELECT run_id, sequence, kind, string_agg(value_json, ';' ORDER BY registry_revision, "
        "result_id) AS values_in_order FROM enrich_now GROUP BY run_id, sequence, kind"
    )
    sql["events_since"] = folded(
        f"SELECT {_EVENT_COLUMNS} FROM jr WHERE stream_sequence > 100 AND stream_sequence <= 1100"
    )
    sql["event_records"] = folded(
        "SELECT j.stream_sequence, j.event_id, j.revision, j.bean_status AS status, j.created_ts AS created_timestamp_ns, "
        "j.updated_ts AS updated_timestamp_ns, j.track_ts AS track_timestamp_ns, g.enrichments, j.d_id AS decision_id, "
        "j.d_ack AS acknowledged_timestamp_ns FROM jr j LEFT JOIN (SELECT j.stream_sequence, "
        "string_agg(e.result_id || '=' || e.value_json, ';' ORDER BY e.registry_revision, e.result_id) AS enrichments "
        "FROM jr j JOIN enrich_now e ON e.run_id = j.run_id AND e.sequence = j.sequence "
        "AND e.registry_revision <= j.revision GROUP BY j.stream_sequence) g USING (stream_sequence) "
        "WHERE j.stream_sequence > 100 AND j.stream_sequence <= 1100"
    )
    sql["journal_after_gap"] = folded(f"SELECT {_EVENT_COLUMNS} FROM jr WHERE stream_sequence > 300")
    sql["list_active"] = folded(
        "SELECT run_id, sequence, revision, status FROM bean_now "
        "WHERE status IN ('tentative', 'confirmed', 'occluded')"
    )
    latest_decision = (
        "(SELECT run_id, sequence, arg_max(decision_id, (registry_revision, decision_id)) AS "
        "decision_id, arg_max(ack, (registry_revision, decision_id)) AS ack "
        "FROM decision_now GROUP BY run_id, sequence)"
    )
    sql["evicted_records"] = folded(
        "SELECT b.run_id, b.sequence, b.revision, b.status FROM bean_now b "
        f"LEFT JOIN {latest_decision} d USING (run_id, sequence) "
        "WHERE b.status IN ('exited', 'cancelled') AND b.updated_timestamp_ns < 1005000000000 "
        "AND (d.decision_id IS NULL OR d.ack <> -1)"
    )
    sql["records_current"] = folded(
        "SELECT b.*, coalesce(e.n, 0) AS enrichments, d.decision_id, o.n AS history "
        "FROM bean_now b "
        "LEFT JOIN (SELECT run_id, sequence, count(*) AS n FROM enrich_now GROUP BY ALL) e "
        "USING (run_id, sequence) "
        f"LEFT JOIN {latest_decision} d USING (run_id, sequence) "
        "LEFT JOIN (SELECT run_id, sequence, count(DISTINCT command_seq // 3) AS n FROM jr "
        "WHERE op = 'T' GROUP BY ALL) o USING (run_id, sequence)"
    )
    sql["two_part_fold"] = folded(
        "SELECT 'sessions' AS table_name, run_id, CAST(NULL AS BIGINT) AS sequence, CAST(NULL AS VARCHAR) AS item, "
        "CAST(NULL AS BIGINT) AS revision, CAST(min(created_ts) AS VARCHAR) AS value FROM jr GROUP BY run_id "
        "UNION ALL SELECT 'beans', run_id, sequence, status, revision, CAST(updated_timestamp_ns AS VARCHAR) FROM bean_now "
        "UNION ALL SELECT 'track_states', run_id, sequence, bean_status, revision, CAST(ts AS VARCHAR) FROM jr WHERE op = 'T' "
        "UNION ALL SELECT 'observations', run_id, sequence, CAST(command_seq // 3 AS VARCHAR), NULL, "
        "CAST(arg_min(ts, revision) AS VARCHAR) FROM jr WHERE op = 'T' GROUP BY run_id, sequence, command_seq // 3 "
        "UNION ALL SELECT 'enrichments', run_id, sequence, result_id, registry_revision, value_json FROM enrich_now "
        "UNION ALL SELECT 'sorting_decisions', run_id, sequence, decision_id, registry_revision, "
        "CAST(nullif(ack, -1) AS VARCHAR) FROM decision_now "
        "UNION ALL SELECT 'registry_events', run_id, sequence, event_id, revision, CAST(stream_sequence AS VARCHAR) FROM jr"
    )
    sql["replayed_log"] = folded(
        "SELECT c.run_id, CASE WHEN c.content = o.content AND NOT c.broken THEN 'duplicate' ELSE 'rejected' END "
        "AS outcome, count(*) AS commands FROM cmd c JOIN (SELECT jr.event_id, cmd.content FROM jr JOIN cmd "
        "USING (command_seq)) o ON o.event_id = c.event_id GROUP BY ALL"
    )
    sql["audit_counts"] = folded(
        "SELECT 'sessions' AS table_name, count(DISTINCT run_id) AS row_count FROM jr "
        "UNION ALL SELECT 'beans', count(*) FROM bean_now "
        "UNION ALL SELECT 'track_states', count(*) FROM jr WHERE op = 'T' "
        "UNION ALL SELECT 'observations', count(DISTINCT (run_id, sequence, command_seq // 3)) "
        "FROM jr WHERE op = 'T' "
        "UNION ALL SELECT 'predictions', 0 "
        "UNION ALL SELECT 'enrichments', count(*) FROM enrich_now "
        "UNION ALL SELECT 'sorting_decisions', count(*) FROM decision_now "
        "UNION ALL SELECT 'registry_events', count(*) FROM jr"
    )
    sql["latency_summary"] = _with(
        f"SELECT run_id, frames, {q('mean_ms', 6)} AS mean_ms, p95_ms FROM summary",
        "ranked AS (SELECT CAST(user_id AS VARCHAR) AS run_id, value, row_number() OVER "
        "(PARTITION BY user_id ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n "
        "FROM events)",
        "summary AS (SELECT run_id, max(n) AS frames, avg(value) AS mean_ms, "
        "max(CASE WHEN r = least(n - 1, CAST(round_even((n - 1) * 0.95E0, 0) AS BIGINT)) "
        "THEN value END) AS p95_ms FROM ranked GROUP BY run_id)",
    )
    shift_x, shift_y = _mm("x", "727.5E0", "543.5E0"), _mm("y", "727.5E0", "543.5E0")
    recentred = (
        f"recentred AS (SELECT run_id, n0 - ox*n6 AS m0, n1 - ox*n7 AS m1, n2 - ox AS m2, "
        f"n3 - oy*n6 AS m3, n4 - oy*n7 AS m4, n5 - oy AS m5, n6 AS m6, n7 AS m7, oy, n6, n7, n3, n4, "
        f"n5, n0, n1, n2 FROM (SELECT *, {shift_x} AS ox, {shift_y} AS oy FROM cal))"
    )
    sql["homography_fit"] = _with(
        "SELECT run_id AS calibration_id, "
        + ", ".join(f"{q(f'm{i}', 6)} AS m{i}" for i in range(8))
        + f", {q(_mm('y', mid, '0E0') + ' - oy', 5)} AS top_y_mm, "
        f"{q(_mm('y', mid, '1087E0') + ' - oy', 5)} AS bottom_y_mm FROM recentred",
        _CAL, recentred,
    )
    sql["fit_quality"] = (
        "SELECT CAST(s_suppkey AS VARCHAR) AS calibration_id, 0E0 AS rms_error_mm, "
        "0E0 AS max_error_mm FROM supplier"
    )
    sql["calibration_export"] = (
        "SELECT CAST(s_suppkey AS VARCHAR) AS calibration_id, 'flightline-metric-plane/v1' AS schema, "
        "1456 AS width FROM supplier"
    )
    sql["stratified_coverage"] = _with(
        "SELECT run_id, CAST(p AS INT) AS pass_no, least(11, last_frame + 1) AS strata, "
        "least(11, last_frame + 1) AS candidates, true AS inside FROM spans, range(4) AS passes(p)",
        _OBS, _SPANS,
    )
    rects = """
rects AS (
  SELECT CAST(p_partkey // 10 AS VARCHAR) AS run_id, CAST(p_partkey % 10 AS BIGINT) AS frame_index,
         p_partkey % 11 * 2 + 4 AS x, p_partkey % 7 * 2 + 4 AS y, p_partkey % 5 * 2 + 12 AS w,
         p_partkey % 3 * 2 + 12 AS h FROM part
  UNION ALL
  SELECT CAST(p_partkey // 10 AS VARCHAR), CAST(p_partkey % 10 AS BIGINT), p_partkey % 13 * 2 + 2,
         48 + p_partkey % 6 * 2 + 6, p_partkey % 4 * 2 + 16, p_partkey % 2 * 2 + 10 FROM part),
opened AS (SELECT *, (w // 2 * (h // 2) - 4) * 4 AS area FROM rects)
"""
    fits = "area BETWEEN 150 AND 450 AND w BETWEEN 10 AND 40 AND h BETWEEN 10 AND 40"
    sql["frame_detections"] = _with(
        "SELECT run_id, frame_index, CAST(row_number() OVER (PARTITION BY run_id, frame_index "
        "ORDER BY y + h / 2E0, x + w / 2E0) AS INT) AS det_ord, x + w / 2E0 - 1E0 AS cx_px, "
        "y + h / 2E0 - 1E0 AS cy_px, x AS bbox_x, y AS bbox_y, w AS bbox_w, h AS bbox_h, "
        f"area AS area_px, 1E0 AS solidity, 120E0 AS mean_blue FROM opened WHERE {fits}",
        rects,
    )
    sql["frame_verdicts"] = _with(
        "SELECT run_id, frame_index, count(*) AS foreground_components, "
        f"count(*) FILTER ({fits}) AS accepted FROM opened GROUP BY run_id, frame_index",
        rects,
    )
    sql["background_median"] = _with(
        "SELECT run_id, 96 AS height, 64 AS width, md5(string_agg(repeat(CASE WHEN 2*c > n THEN 'x' "
        "WHEN 2*c = n THEN 'P' ELSE '(' END, 3), '' ORDER BY py, px)) AS digest FROM ("
        "SELECT f.run_id, f.n, py, px, (SELECT 0) + count(r.x) AS c FROM "
        "(SELECT run_id, count(DISTINCT frame_index) AS n FROM rects GROUP BY run_id) f "
        "CROSS JOIN range(96) AS ys(py) CROSS JOIN range(64) AS xs(px) "
        "LEFT JOIN rects r ON r.run_id = f.run_id AND px >= r.x AND px < r.x + r.w "
        "AND py >= r.y AND py < r.y + r.h GROUP BY f.run_id, f.n, py, px) GROUP BY run_id",
        rects,
    )
    from . import tracker_oracle  # it builds on this module's texts

    return sql | tracker_oracle.build(_GATES)
