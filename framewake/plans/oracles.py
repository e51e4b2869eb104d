"""What each query should give, as SQL for DuckDB, written from the operators' definitions and not from their plans."""

from __future__ import annotations

from .bridge import duck_cte

FRAMES = "frames AS (SELECT clip_id, r.k AS frame, r.k / 2.0 AS t_s FROM clips, range(0, 1800) r(k) WHERE r.k / 2.0 < duration_s)"
DETECTIONS = """classes AS (SELECT * FROM (VALUES (0, 'person', 'person'), (2, 'car', 'vehicle'), (3, 'motorcycle', 'vehicle'), (5, 'bus', 'vehicle'), (7, 'truck', 'vehicle')) t(class_id, class_name, category)),
detections AS (SELECT r.*, class_name, category FROM raw_detections r JOIN classes USING (class_id) WHERE track_id IS NOT NULL),
translation AS (SELECT clip_id, category, track_id, first_frame, CAST(row_number() OVER (PARTITION BY clip_id, category ORDER BY first_frame, track_id) AS INTEGER) AS number
  FROM (SELECT clip_id, category, track_id, min(frame_index) AS first_frame FROM detections GROUP BY ALL)),
relabelled AS (SELECT d.* EXCLUDE (track_id), number AS track_id, concat(CASE category WHEN 'person' THEN 'P' ELSE 'V' END, number) AS label FROM detections d JOIN translation USING (clip_id, category, track_id)),
label_times AS (SELECT clip_id, label, frame_index / (CAST(split_part(fps, '/', 1) AS DOUBLE) / CAST(split_part(fps, '/', 2) AS DOUBLE)) AS t_s FROM relabelled JOIN clips USING (clip_id))"""
VERIFIED = """claims AS (SELECT clip_id, position, start_time_s, end_time_s, unnest(list_distinct(list_concat(person_ids, vehicle_ids))) AS label FROM sightings),
seen AS (SELECT DISTINCT c.clip_id, c.position, c.label FROM claims c WHERE EXISTS (SELECT 1 FROM label_times t WHERE t.clip_id = c.clip_id AND t.label = c.label AND t.t_s BETWEEN c.start_time_s - 0.5 AND c.end_time_s + 0.5)),
kept AS (SELECT clip_id, position, list(label) AS ls FROM seen GROUP BY ALL),
verified AS (SELECT s.* EXCLUDE (ls) REPLACE (list_filter(person_ids, lambda x: list_contains(coalesce(ls, []), x)) AS person_ids, list_filter(vehicle_ids, lambda x: list_contains(coalesce(ls, []), x)) AS vehicle_ids,
  list_filter(person_ids, lambda x: NOT list_contains(coalesce(ls, []), x)) AS unverified_person_ids, list_filter(vehicle_ids, lambda x: NOT list_contains(coalesce(ls, []), x)) AS unverified_vehicle_ids)
  FROM (SELECT s.*, ls FROM sightings s LEFT JOIN kept USING (clip_id, position)) s)"""


def _grouped(source: str) -> str:
    """Every matching pair, its closure, and each member's rank in its group."""
    return f"""matches AS (SELECT l.clip_id, l.position AS a, r.position AS b FROM {source} l JOIN {source} r ON l.clip_id = r.clip_id AND l.position <> r.position
  AND l.start_time_s <= r.end_time_s AND r.start_time_s <= l.end_time_s AND list_has_any(l.person_ids, r.person_ids) AND list_has_any(l.vehicle_ids, r.vehicle_ids)),
reach AS (SELECT clip_id, position AS a, position AS b FROM {source} UNION SELECT reach.clip_id, reach.a, m.b FROM reach JOIN matches m ON m.clip_id = reach.clip_id AND m.a = reach.b),
grouped AS (SELECT s.*, g.group_position FROM {source} s JOIN (SELECT clip_id, a AS position, min(b) AS group_position FROM reach GROUP BY ALL) g USING (clip_id, position)),
members AS (SELECT g.*, w.start_s AS ws, w.end_s AS we, g.start_time_s > w.start_s + 0.01 AND g.end_time_s < w.end_s - 0.01 AS contained, least(g.evidence_time_s - w.start_s, w.end_s - g.evidence_time_s) AS margin,
  max(g.confidence) OVER (PARTITION BY g.clip_id, g.group_position) AS best FROM grouped g JOIN windows w USING (clip_id, window_index)),
chosen AS (SELECT * FROM members WHERE confidence >= best - CAST(0.3 AS DOUBLE)
  QUALIFY row_number() OVER (PARTITION BY clip_id, group_position ORDER BY contained DESC, margin DESC, confidence DESC, window_index, position) = 1)"""


EVENTS = """ids AS (SELECT clip_id, group_position, kind, string_agg(label, ',' ORDER BY p, i) AS labels FROM (
    SELECT clip_id, group_position, kind, label, min(position) AS p, arg_min(i, position * 1000 + i) AS i FROM (
      SELECT clip_id, group_position, position, 'p' AS kind, unnest(person_ids) AS label, generate_subscripts(person_ids, 1) AS i FROM members UNION ALL
      SELECT clip_id, group_position, position, 'v', unnest(vehicle_ids), generate_subscripts(vehicle_ids, 1) FROM members) GROUP BY ALL) GROUP BY ALL),
texts AS (SELECT clip_id, group_position, string_agg(interaction, ' | ' ORDER BY k) AS t FROM (SELECT clip_id, group_position, interaction, min(k) AS k FROM (
    SELECT *, row_number() OVER (PARTITION BY clip_id, group_position ORDER BY start_time_s, window_index, position) AS k FROM members) GROUP BY ALL) GROUP BY ALL),
spans AS (SELECT clip_id, group_position, bool_or(contained) AS whole, min(start_time_s) AS s, max(end_time_s) AS e, count(*) AS n, array_to_string(list_sort(list_distinct(list(window_index))), ',') AS ws FROM members GROUP BY ALL),
events AS (SELECT clip_id, group_position, coalesce(p.labels, '') AS person_ids, coalesce(v.labels, '') AS vehicle_ids, c.person_description, c.vehicle_description, CASE WHEN whole THEN c.interaction ELSE t END AS interaction,
  CASE WHEN whole THEN c.start_time_s ELSE s END AS start_time_s, c.evidence_time_s, CASE WHEN whole THEN c.end_time_s ELSE e END AS end_time_s, c.confidence, n AS sightings, spans.ws AS window_indexes
  FROM chosen c JOIN spans USING (clip_id, group_position) JOIN texts USING (clip_id, group_position)
  LEFT JOIN (SELECT * FROM ids WHERE kind = 'p') p USING (clip_id, group_position) LEFT JOIN (SELECT * FROM ids WHERE kind = 'v') v USING (clip_id, group_position))"""

REPAIRED = r"""repaired AS (SELECT *, CASE WHEN json_valid(raw_text) THEN raw_text WHEN json_valid(c2) THEN c2 WHEN json_valid(c3) THEN c3 ELSE raw_text END AS body FROM (
  SELECT *, nullif(regexp_extract(raw_text, '^\s*```(?:json)?\s*(.*?)\s*```\s*$', 1, 'is'), '') AS c2,
    CASE WHEN instr(raw_text, '{') > 0 AND instr(reverse(raw_text), '}') > 0 AND length(raw_text) - instr(reverse(raw_text), '}') + 1 > instr(raw_text, '{')
      THEN raw_text[instr(raw_text, '{'):length(raw_text) - instr(reverse(raw_text), '}') + 1] END AS c3 FROM responses)),
items AS (SELECT event_id, start_s, end_s, duration_s, i - 1 AS position, json_extract(body, '$.interactions[' || (i - 1) || ']') AS j
  FROM (SELECT *, unnest(range(1, 1 + CAST(json_array_length(body, '$.interactions') AS BIGINT))) AS i FROM repaired WHERE raw_text IS NOT NULL AND json_valid(body) AND json_type(body, '$.interactions') = 'ARRAY'))"""

_TIMES = ("start_time_s", "evidence_time_s", "end_time_s")
_STRINGS = ("person_description", "vehicle_description", "interaction")
_IDS = {"person_ids": "P", "vehicle_ids": "V"}
_NUMBER = "('DOUBLE', 'UBIGINT', 'BIGINT')"


def _number(name: str) -> str:
    return f"CASE WHEN json_type(j, '$.{name}') IN {_NUMBER} THEN CAST(json_extract_string(j, '$.{name}') AS DOUBLE) END"


def _checked() -> str:
    t = lambda n: f"json_type(j, '$.{n}')"
    typed = [f"CASE WHEN {t(n)} IS NULL THEN 'missing:{n}' END" for n in (*_IDS, *_STRINGS, *_TIMES, "confidence")]
    typed += [f"CASE WHEN {t(n)} NOT IN {_NUMBER} THEN 'not_number:{n}' END" for n in (*_TIMES, "confidence")]
    typed += [f"CASE WHEN {t(n)} <> 'VARCHAR' THEN 'not_string:{n}' END" for n in _STRINGS]
    for n, c in _IDS.items():
        typed.append(f"CASE WHEN {t(n)} <> 'ARRAY' THEN 'not_list:{n}' END")
        typed.append(f"CASE WHEN {t(n)} = 'ARRAY' AND len(list_filter(CAST(json_extract(j, '$.{n}') AS JSON[]), lambda x: json_type(x) <> 'VARCHAR' OR NOT regexp_full_match(json_extract_string(x, '$'), '{c}[1-9][0-9]*'))) > 0 THEN 'bad_label:{n}' END")
    ranged = [f"CASE WHEN NOT {n} BETWEEN 0 AND duration_s THEN 'outside_clip:{n}' END" for n in _TIMES]
    ranged += [
        "CASE WHEN start_time_s > end_time_s THEN 'reversed_span' WHEN NOT evidence_time_s BETWEEN start_time_s AND end_time_s THEN 'evidence_outside_span' END",
        "CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence_range' END",
        "CASE WHEN end_time_s < start_s - 0.5 OR start_time_s > end_s + 0.5 THEN 'span_outside_window' END",
        "CASE WHEN NOT evidence_time_s BETWEEN start_s - 0.5 AND end_s + 0.5 THEN 'evidence_outside_window' END",
    ]
    numbers = ", ".join(f"{_number(n)} AS {n}" for n in (*_TIMES, "confidence"))
    return f"""checked AS (SELECT *, CASE WHEN json_type(j) IS DISTINCT FROM 'OBJECT' THEN 'not_object' WHEN concat_ws(',', {', '.join(typed)}) <> '' THEN concat_ws(',', {', '.join(typed)}) ELSE concat_ws(',', {', '.join(ranged)}) END AS errors
  FROM (SELECT *, {numbers} FROM items))"""


METRICS = "metrics AS (SELECT *, greatest(2, CAST(round_even(least(width, height) / 540.0, 0) AS BIGINT)) AS thickness, greatest(0.5, least(width, height) / 1080.0) AS font_scale, greatest(1, CAST(round_even(least(width, height) / 1080.0, 0) AS BIGINT)) AS halo FROM clips)"
RECTS = "rects AS (SELECT d.clip_id, frame_index, box_position, width, height, thickness, thickness // 2 + 1 AS clearance, " + ", ".join(
    f"greatest(0, least(CAST(round_even({c}, 0) AS BIGINT), {size} - 1)) AS {name}" for c, size, name in (("x1", "width", "x_left"), ("y1", "height", "y_top"), ("x2", "width", "x_right"), ("y2", "height", "y_bottom"))
) + " FROM raw_detections d JOIN metrics USING (clip_id))"
_G = "%.6g"


def _sql(tables: tuple[str, ...], select: str, *more: str) -> str:
    return ",\n".join([duck_cte(*tables), *more]) + "\n" + select


_W = ("clips", "windows")
_D = ("clips", "raw_detections")
_COVERED = """covered AS (SELECT DISTINCT s.clip_id, f.frame FROM (SELECT *, (SELECT count(*) FROM frames f WHERE f.clip_id = sightings.clip_id) AS n FROM sightings WHERE confidence >= {c}) s
  JOIN windows w USING (clip_id, window_index) JOIN frames f ON f.clip_id = s.clip_id AND f.frame BETWEEN least(ceil(s.start_time_s * 2 - 0.5), n - 1) AND least(ceil(s.end_time_s * 2 - 0.5), n - 1) AND f.t_s BETWEEN w.start_s AND w.end_s)"""
_UNEXAMINED = "unexamined AS (SELECT f.clip_id, f.frame FROM frames f JOIN windows w ON w.clip_id = f.clip_id AND f.t_s BETWEEN w.start_s AND w.end_s GROUP BY ALL HAVING bool_and(w.error IS NOT NULL))"
_SUREST = "SELECT clip_id, position, evidence_time_s, confidence FROM sightings QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY confidence DESC, position) = 1"
_SCALE = "CASE WHEN event_id % 4 = 0 THEN '4' ELSE '2.5' END"
_STEM = lambda c: f"regexp_replace(regexp_replace(regexp_extract({c}, '([^/]*)$', 1), '\\.[^.]+$', ''), '[^A-Za-z0-9._-]', '-', 'g')"

SQL: dict[str, str] = {
    "q_merge_events": _sql(("clips", "windows", "sightings"), "SELECT * EXCLUDE (group_position), row_number() OVER (PARTITION BY clip_id ORDER BY start_time_s, end_time_s, group_position) - 1 AS event_index FROM events", _grouped("sightings"), EVENTS),
    "q_merge_groups": _sql(("clips", "windows", "sightings"), "SELECT clip_id, position, group_position FROM grouped", _grouped("sightings")),
    "q_same_event_pairs": _sql(("clips", "windows", "sightings"), "SELECT clip_id, a AS left_position, b AS right_position FROM matches WHERE a < b", _grouped("sightings")),
    "q_representative": _sql(("clips", "windows", "sightings"), "SELECT clip_id, group_position, position, contained, margin, confidence FROM chosen", _grouped("sightings")),
    "q_containment": _sql(("clips", "windows", "sightings"), "SELECT clip_id, position, contained, margin FROM members", _grouped("sightings")),
    "q_integrity": _sql(("clips", "windows", "sightings"), "SELECT clip_id, window_index, 'duplicate' AS fault FROM part GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT DISTINCT clip_id, window_index, 'missing' FROM sightings WHERE (clip_id, window_index) NOT IN (SELECT clip_id, window_index FROM part)",
        "part AS (SELECT clip_id, window_index FROM windows WHERE window_index % 50 <> 49 UNION ALL SELECT clip_id, window_index FROM windows WHERE window_index % 60 = 7)"),
    "q_verified_events": _sql((*_D, "windows", "sightings"), "SELECT clip_id, count(*) AS events, CAST(sum(n) AS BIGINT) AS sightings, max(n) AS most FROM (SELECT clip_id, group_position, count(*) AS n FROM members GROUP BY ALL) GROUP BY ALL", DETECTIONS, VERIFIED, _grouped("verified")),
    "q_detections": _sql(_D, "SELECT clip_id, frame_index, box_position, track_id, class_id, class_name, category, confidence FROM detections", DETECTIONS),
    "q_class_check": "SELECT * FROM (VALUES (3, 'motorcycle', 'vehicle'), (5, 'bus', 'vehicle'), (7, 'truck', 'vehicle')) t(class_id, class_name, category)",
    "q_relabel": _sql(_D, "SELECT clip_id, frame_index, box_position, category, track_id, label FROM relabelled", DETECTIONS),
    "q_translation": _sql(_D, "SELECT *, concat(CASE category WHEN 'person' THEN 'P' ELSE 'V' END, number) AS label FROM translation", DETECTIONS),
    "q_label_times": _sql(_D, "SELECT clip_id, label, CAST(count(*) AS INTEGER) AS n, min(t_s) AS first_s, max(t_s) AS last_s, round(list_sum(list(t_s ORDER BY t_s)), 6) AS sum_s FROM label_times GROUP BY ALL", DETECTIONS),
    "q_identity_counts": _sql(_D, "SELECT clip_id, count(DISTINCT track_id) FILTER (category = 'person') AS people, count(DISTINCT track_id) FILTER (category = 'vehicle') AS vehicles FROM detections GROUP BY ALL", DETECTIONS),
    "q_frame_order": _sql(_D, "SELECT clip_id, entry, frame_index, CAST(expected AS INTEGER) AS expected FROM (SELECT clip_id, box_position AS entry, CASE WHEN box_position % 97 = 0 THEN frame_index ELSE k END AS frame_index, k AS expected FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY box_position) - 1 AS k FROM raw_detections)) WHERE frame_index <> expected"),
    "q_make_windows": _sql(_W, "SELECT clip_id, window_index, start_s, end_s FROM windows"),
    "q_window_gaps": _sql(_W, "SELECT * FROM (SELECT clip_id, window_index, end_s, lead(start_s) OVER (PARTITION BY clip_id ORDER BY window_index) AS next_start_s FROM windows WHERE window_index % 7 NOT IN (3, 4)) WHERE next_start_s > end_s"),
    "q_window_plan": _sql(_W, "SELECT clip_id, count(*) AS calls FROM windows GROUP BY ROLLUP (clip_id)"),
    "q_probe_window": _sql(("clips", "sightings"), f"SELECT clip_id, greatest(0.0, least(evidence_time_s - 4, duration_s - 8)) AS start_s, least(duration_s, greatest(0.0, least(evidence_time_s - 4, duration_s - 8)) + 8) AS end_s FROM ({_SUREST}) JOIN clips USING (clip_id)"),
    "q_timeline": _sql(("clips",), "SELECT clip_id, count(*) AS frames, max(t_s) AS last_s FROM frames GROUP BY ALL", FRAMES),
    "q_size_rule": _sql(("clips",), "SELECT clip_id, height, CASE WHEN height >= 1080 THEN 1280 ELSE 640 END AS imgsz FROM clips"),
    "q_track_buffer": _sql(("clips",), "SELECT clip_id, fps, buffer_seconds, greatest(20, CAST(round_even(buffer_seconds * (CAST(split_part(fps, '/', 1) AS DOUBLE) / CAST(split_part(fps, '/', 2) AS DOUBLE)), 0) AS INTEGER)) AS frames FROM clips"),
    "q_slug": _sql(("clips",), f"SELECT clip_id, concat({_STEM('weights')}, '__', {_STEM('tracker')}, '__reid-', {_STEM('reid')}, '__imgsz', CASE WHEN height >= 1080 THEN 1280 ELSE 640 END, '__buf', CASE WHEN buffer_seconds = 3 THEN '3' ELSE '2.5' END) AS slug FROM clips"),
    "q_run_tag": f"SELECT event_id, concat(CASE WHEN event_id % 3 = 0 THEN '3.8-flash' ELSE 'local-27b' END, CASE WHEN event_id % 2 = 0 THEN concat('__w8s', {_SCALE}) ELSE '' END, '__a3', CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '__%Y%m%d-%H%M%S-%g') ELSE '' END) AS tag FROM events WHERE ts IS NOT NULL",
    "q_prompt": _sql(_W, """SELECT clip_id, window_index, format('Clip {} lasts {:.1f} s. You see {:.1f} s to {:.1f} s of it; times count from the beginning of the whole clip, so what you see first is at {:.1f}.', clip_id, duration_s, start_s, end_s, start_s)
  || ' Boxes found by a detector carry labels at their corners: P1, P2 and so on for people, V1, V2 and so on for vehicles of any kind; equal numbers mean nothing across the two. These labels are a help and not the truth: objects may go without one, lose it for a while, or get another.'
  || ' List every moment in which a person enters, leaves, opens, loads or otherwise handles a vehicle, labelled or not; passing by is none. Give person_ids and vehicle_ids as read from frames of the moment, in order of appearance, and [] where none was shown; never make one up.'
  || ' Give person_description, vehicle_description and interaction as text, and confidence from 0 to 1, below 0.5 where in doubt. Give start_time_s, evidence_time_s and end_time_s in seconds with decimals, so that 0 <= start_time_s <= evidence_time_s <= end_time_s <= '
  || format('{:.1f}', duration_s) || '. Answer with JSON alone: {"interactions": [...]}, the list empty if there is none.' AS prompt FROM windows JOIN clips USING (clip_id)"""),
    "q_draw_metrics": _sql(("clips",), "SELECT clip_id, thickness, font_scale, halo, thickness // 2 + 1 AS clearance FROM metrics", METRICS),
    "q_box_clamp": _sql(_D, "SELECT clip_id, box_position, x_left, y_top, x_right, y_bottom FROM rects", METRICS, RECTS),
    "q_outline_rule": _sql(_D, "SELECT clip_id, box_position, w - 2 * greatest(thickness, CAST(round_even(w * 0.25, 0) AS BIGINT)) <= thickness OR h - 2 * greatest(thickness, CAST(round_even(h * 0.25, 0) AS BIGINT)) <= thickness AS outlined FROM (SELECT *, x_right - x_left + 1 AS w, y_bottom - y_top + 1 AS h FROM rects)", METRICS, RECTS),
    "q_label_candidates": _sql(_D, """SELECT clip_id, box_position, CAST(row_number() OVER (PARTITION BY clip_id, box_position ORDER BY k) - 1 AS INTEGER) AS place, concat_ws(':', l, t, l + 40, t + 18) AS rect FROM (
  SELECT clip_id, box_position, k, greatest(0, least(CASE k % 2 WHEN 0 THEN x_left + inset ELSE x_right - inset - 40 END, width - 40)) AS l, t, height FROM (
    SELECT *, CASE k // 2 WHEN 0 THEN y_top - clearance - 18 WHEN 1 THEN y_top + clearance ELSE y_bottom + clearance END AS t, CASE k // 2 WHEN 1 THEN clearance ELSE 0 END AS inset FROM rects, range(0, 6) r(k))) WHERE t >= 0 AND t + 18 <= height""", METRICS, RECTS),
    "q_rect_overlap": _sql(_D, "SELECT l.clip_id, l.box_position AS left_box, r.box_position AS right_box FROM rects l JOIN rects r ON l.clip_id = r.clip_id AND l.frame_index = r.frame_index AND l.box_position < r.box_position WHERE l.x_left < r.x_right AND r.x_left < l.x_right AND l.y_top < r.y_bottom AND r.y_top < l.y_bottom", METRICS, RECTS),
    "q_json_repair": _sql(("responses",), "SELECT event_id, CAST(length(body) AS INTEGER) AS n, json_valid(body) AS is_json FROM repaired WHERE raw_text IS NOT NULL", REPAIRED),
    "q_parse_response": _sql(("responses",), "SELECT event_id, CASE WHEN raw_text IS NULL THEN 'no text' WHEN NOT json_valid(body) THEN 'not JSON' WHEN json_type(body, '$.interactions') IS DISTINCT FROM 'ARRAY' THEN 'no interactions list' ELSE 'ok' END AS outcome FROM repaired", REPAIRED),
    "q_validate": _sql(("responses",), "SELECT event_id, CAST(position AS INTEGER) AS position, errors FROM checked", REPAIRED, _checked()),
    "q_accepted": _sql(("responses",), "SELECT event_id, array_to_string(CAST(json_extract(j, '$.person_ids') AS VARCHAR[]), ',') AS person_ids, array_to_string(CAST(json_extract(j, '$.vehicle_ids') AS VARCHAR[]), ',') AS vehicle_ids, json_extract_string(j, '$.interaction') AS interaction, start_time_s, evidence_time_s, end_time_s, confidence FROM checked WHERE errors = ''", REPAIRED, _checked()),
    "q_shift_times": _sql(("responses",), "SELECT event_id, CAST(position AS INTEGER) AS position, " + ", ".join(f"{n} + 16.5 AS {n}" for n in _TIMES) + " FROM checked", REPAIRED, _checked()),
    "q_label_regex": _sql(("ev",), "SELECT event_id, label, regexp_full_match(label, 'P[1-9][0-9]*') AS person, regexp_full_match(label, 'V[1-9][0-9]*') AS vehicle FROM (SELECT event_id, concat(CASE event_id % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'V' ELSE 'p' END, CASE WHEN event_id % 5 = 0 THEN '0' ELSE '' END, CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END) AS label FROM ev)"),
    "q_verify_labels": _sql((*_D, "sightings"), "SELECT clip_id, position, " + ", ".join(f"array_to_string({c}, ',') AS {c}" for c in ("person_ids", "vehicle_ids", "unverified_person_ids", "unverified_vehicle_ids")) + " FROM verified", DETECTIONS, VERIFIED),
    "q_unverified_hist": _sql((*_D, "sightings"), "SELECT label, count(*) AS times FROM (SELECT unnest(list_concat(unverified_person_ids, unverified_vehicle_ids)) AS label FROM verified) GROUP BY ALL", DETECTIONS, VERIFIED),
    "q_unverified_line": _sql((*_D, "sightings"), """SELECT clip_id, concat(CAST(sum(n) AS BIGINT), ' unsupported label(s) in ', any_value(records), ' record(s): ', string_agg(concat(label, ' x', n), ', ' ORDER BY label)) AS line
  FROM (SELECT clip_id, label, count(*) AS n FROM (SELECT clip_id, unnest(list_concat(unverified_person_ids, unverified_vehicle_ids)) AS label FROM verified) GROUP BY ALL)
  JOIN (SELECT clip_id, count(*) FILTER (len(unverified_person_ids) + len(unverified_vehicle_ids) > 0) AS records FROM verified GROUP BY ALL) USING (clip_id) GROUP BY clip_id""", DETECTIONS, VERIFIED),
    "q_usage_cost": _sql(("calls",), "SELECT l_orderkey, l_linenumber, CAST(billable AS DOUBLE) AS billable_output_tokens, CAST(format('{:.6f}', CASE model_id WHEN 'gemini-3.8-flash' THEN total_input_tokens / 1e6 * 0.75::DOUBLE + billable / 1e6 * 3.75::DOUBLE ELSE 0.0::DOUBLE END) AS DOUBLE) AS estimated_cost_usd FROM (SELECT *, coalesce(total_output_tokens, 0) + total_thought_tokens AS billable FROM calls)"),
    "q_usage_sum": _sql(("calls",), "SELECT clip_id, usage_key, sum(v) AS total FROM (SELECT clip_id, 'total_input_tokens' AS usage_key, CAST(total_input_tokens AS DOUBLE) AS v FROM calls UNION ALL SELECT clip_id, CASE WHEN l_linenumber % 2 = 0 THEN 'total_thought_tokens' ELSE 'total_output_tokens' END, CASE WHEN l_linenumber % 2 = 0 THEN total_thought_tokens ELSE coalesce(total_output_tokens, 0) END FROM calls) GROUP BY ALL"),
    "q_run_status": _sql(("calls",), "SELECT clip_id, count(*) AS calls, count(error) AS failed_windows, CASE WHEN count(error) = count(*) THEN concat('all ', count(*), ' call(s) failed') ELSE '' END AS error FROM calls GROUP BY ALL"),
    "q_run_summary": _sql(("clips", "windows", "sightings", "responses"), """SELECT clip_id, failed_windows, source_interaction_count, merged_interaction_count, malformed_count,
  concat(clip_id, ': ', source_interaction_count, ' record(s) -> ', merged_interaction_count, ' event(s)', CASE WHEN failed_windows > 0 OR malformed_count > 0 THEN concat('  [', failed_windows, ' call(s) failed, ', malformed_count, ' malformed -- clip not fully examined]') ELSE '' END) AS line
  FROM (SELECT clip_id, count(error) AS failed_windows FROM windows GROUP BY ALL)
  JOIN (SELECT clip_id, count(*) AS source_interaction_count, count(DISTINCT group_position) AS merged_interaction_count FROM grouped GROUP BY ALL) USING (clip_id)
  JOIN (SELECT r.clip_id, count(*) AS malformed_count FROM checked JOIN responses r USING (event_id) WHERE errors <> '' GROUP BY ALL) USING (clip_id)""", _grouped("sightings"), REPAIRED, _checked()),
    "q_summary_rollup": _sql(("sightings",), "SELECT clip_id, count(*) AS records, count(*) FILTER (len(person_ids) = 0 OR len(vehicle_ids) = 0) AS unlabelled, CAST(sum(len(person_ids)) AS BIGINT) AS people_claims, CAST(sum(len(vehicle_ids)) AS BIGINT) AS vehicle_claims FROM sightings GROUP BY ROLLUP (clip_id)"),
    "q_argmax": _sql(("sightings",), _SUREST),
    "q_mode_compare": _sql(("sightings",), "SELECT clip_id, count(*) FILTER (event_id % 3 = 0) AS whole_records, count(*) FILTER (event_id % 3 <> 0) AS windowed_records, count(*) FILTER (event_id % 3 <> 0) - count(*) FILTER (event_id % 3 = 0) AS difference FROM sightings GROUP BY ALL HAVING whole_records > 0 AND windowed_records > 0"),
    "q_batch_outcome": _sql(("calls",), "SELECT count(*) AS clips, count(*) FILTER (NOT bad) AS answered, count(*) FILTER (bad) AS failed, CASE WHEN count(*) FILTER (bad) > 0 THEN 1 ELSE 0 END AS exit_code FROM (SELECT clip_id = 'clip3' OR n = m AS bad FROM (SELECT clip_id, count(error) AS n, count(*) AS m FROM calls GROUP BY clip_id))"),
    "q_clip_order": _sql(("sightings",), "SELECT clip_id, event_id, CAST(position AS INTEGER) AS place, CASE WHEN len(person_ids) = 0 THEN 'no id' ELSE array_to_string(person_ids, ',') END AS people, interaction[1:6] AS short FROM sightings"),
    "q_nearest_frame": _sql(("clips", "sightings"), "SELECT clip_id, event_id, arg_min(f.frame, (abs(f.t_s - m.t_s), f.frame)) AS nearest_frame FROM (SELECT clip_id, event_id, evidence_time_s % 864 AS t_s FROM sightings) m JOIN odd f USING (clip_id) GROUP BY ALL", FRAMES, "odd AS (SELECT * FROM frames WHERE frame % 5 <> 2)"),
    "q_display_order": _sql(("sightings",), "SELECT clip_id, event_id, row_number() OVER (PARTITION BY clip_id ORDER BY start_time_s, confidence, position) - 1 AS strip_place, row_number() OVER (PARTITION BY clip_id ORDER BY start_time_s, window_index, position) - 1 AS list_place FROM sightings"),
    "q_label_order": _sql(_D, "SELECT clip_id, concat(CASE category WHEN 'person' THEN 'P' ELSE 'V' END, number) AS label, row_number() OVER (PARTITION BY clip_id ORDER BY category, number) - 1 AS place FROM translation", DETECTIONS),
    "q_malformed_order": _sql(("responses",), "SELECT clip_id, event_id AS window_index, CAST(position AS INTEGER) AS position, row_number() OVER (PARTITION BY clip_id ORDER BY event_id, position) - 1 AS place FROM checked JOIN (SELECT event_id, clip_id FROM responses) USING (event_id) WHERE errors <> ''", REPAIRED, _checked()),
    "q_shortest_clip": _sql(("clips",), "SELECT clip_id, duration_s FROM clips ORDER BY duration_s, clip_id LIMIT 1"),
    "q_batch_lines": _sql(("calls", "sightings"), """SELECT clip_id, clip_id <> 'clip3' AND bad < n AS ok, CASE WHEN clip_id = 'clip3' THEN 'clip3: FAILED ValueError: no frames' WHEN bad = n THEN format('{}: FAILED all {} call(s) failed', clip_id, n)
  ELSE format('{}: {} record(s) -> 2 event(s)', clip_id, coalesce(s, 0)) || CASE WHEN bad > 0 THEN format('  [{} call(s) failed, 0 malformed -- clip not fully examined]', bad) ELSE '' END END AS line
  FROM (SELECT clip_id, count(*) AS n, count(error) AS bad FROM calls GROUP BY clip_id) LEFT JOIN (SELECT clip_id, count(*) AS s FROM sightings GROUP BY clip_id) USING (clip_id)"""),
    "q_evidence_strip": _sql(("clips", "windows", "sightings"), """SELECT clip_id, CASE WHEN must IS NOT NULL AND NOT shown AND rank = 1 THEN must ELSE frame END AS frame FROM (
  SELECT *, bool_or(coalesce(frame = must, false)) OVER (PARTITION BY clip_id) AS shown, row_number() OVER (PARTITION BY clip_id ORDER BY abs(frame - must), frame) AS rank FROM (
    SELECT clip_id, frame FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY clip_id) AS n FROM covered) WHERE n <= 6 OR list_contains(list_transform(range(0, 6), lambda k: CAST(round_even(k * ((n - 1) / 5.0), 0) AS BIGINT)), i)
  ) LEFT JOIN (SELECT clip_id, min(frame) AS must FROM covered WHERE frame % 7 = 3 GROUP BY clip_id) USING (clip_id))""", FRAMES, _COVERED.format(c=0.9)),
    "q_coverage": _sql(("clips", "windows", "sightings"), """SELECT clip_id, frames, coalesce(c.n, 0) AS covered, coalesce(u.n, 0) AS never_examined, frames - coalesce(c.n, 0) AS missing, frames - coalesce(c.n, 0) - coalesce(u.n, 0) AS missed FROM (SELECT clip_id, count(*) AS frames FROM frames GROUP BY ALL)
  LEFT JOIN (SELECT clip_id, count(*) AS n FROM covered GROUP BY ALL) c USING (clip_id) LEFT JOIN (SELECT clip_id, count(*) AS n FROM (SELECT * FROM unexamined EXCEPT SELECT * FROM covered) GROUP BY ALL) u USING (clip_id)""", FRAMES, _COVERED.format(c=0.4), _UNEXAMINED),
    "q_unexamined": _sql(("clips", "windows"), "SELECT clip_id, frame FROM unexamined", FRAMES, _UNEXAMINED),
    "q_filmstrip": _sql(("clips", "windows", "sightings"), "SELECT clip_id, frame FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY clip_id) AS n FROM covered) WHERE n <= 6 OR list_contains(list_transform(range(0, 6), lambda k: CAST(round_even(k * ((n - 1) / 5.0), 0) AS BIGINT)), i)", FRAMES, _COVERED.format(c=0.9)),
}
