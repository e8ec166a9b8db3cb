"""Oracle SQL for ``editlens.plans.evaluation_queries``."""

from __future__ import annotations

from oracle.fixture_sql import cte, with_

NORMAL = (
    "trim(regexp_replace(regexp_replace(lower(nfc_normalize({})), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
)

# Edit paths: one letter per step of the alignment. Common ends are kept as hits
# first; ties prefer a deletion, then an insertion.
cte(
    "al_in",
    """SELECT case_id, metric,
      CASE WHEN metric = 'cer' THEN regexp_extract_all(lower(array_to_string(ttok, '')), '.') ELSE list_transform(ttok, lambda x: lower(x)) END AS ref,
      CASE WHEN metric = 'cer' THEN regexp_extract_all(lower(array_to_string(heard_tok, '')), '.') ELSE list_transform(heard_tok, lambda x: lower(x)) END AS hyp
    FROM (SELECT cs.case_id, ttok, heard_tok, CASE WHEN category <> 'emotion' THEN 'mixed' WHEN language = 'zh' THEN 'cer' ELSE 'wer' END AS metric
      FROM cs JOIN cats ON cats.case_id = cs.case_id)""",
    "cs",
    "cats",
)
cte("al_mixed_in", "SELECT case_id, 'mixed' AS metric, list_transform(ttok, lambda x: lower(x)) AS ref, list_transform(heard_tok, lambda x: lower(x)) AS hyp FROM cs", "cs")


def _paths(source: str) -> str:
    head = "coalesce(list_position(list_transform(range(1, least(len(ref), len(hyp)) + 1), lambda i: ref[i] = hyp[i]), false) - 1, least(len(ref), len(hyp)))"
    tail = (
        "coalesce(list_position(list_transform(range(0, least(len(ref), len(hyp)) - p), lambda i: ref[len(ref) - i] = hyp[len(hyp) - i]), false) - 1,"
        " least(len(ref), len(hyp)) - p)"
    )
    cell = """list_append(acc, CASE
        WHEN row[j + 1].d + 1 = least(row[j + 1].d + 1, acc[j].d + 1, row[j].d + CASE WHEN r[i] = h[j] THEN 0 ELSE 1 END)
          THEN {'d': row[j + 1].d + 1, 'p': row[j + 1].p || 'D'}
        WHEN j > 1 AND acc[j].d = row[j].d - 1 THEN {'d': acc[j].d + 1, 'p': acc[j].p || 'I'}
        WHEN r[i] = h[j] THEN {'d': row[j].d, 'p': row[j].p || 'H'}
        ELSE {'d': row[j].d + 1, 'p': row[j].p || 'S'} END)"""
    return f"""SELECT case_id, metric, len(ref) AS n, len(hyp) AS m, repeat('H', p) || core || repeat('H', s) AS path
      FROM (SELECT *, list_reduce(range(1, len(r) + 1), lambda row, i:
          list_reduce(range(1, len(h) + 1), lambda acc, j: {cell}, [{{'d': row[1].d + 1, 'p': row[1].p || 'D'}}]),
          list_transform(range(0, len(h) + 1), lambda j: {{'d': j, 'p': repeat('I', j)}}))[len(h) + 1].p AS core
        FROM (SELECT *, ref[p + 1 : len(ref) - s] AS r, hyp[p + 1 : len(hyp) - s] AS h
          FROM (SELECT *, {tail} AS s FROM (SELECT *, {head} AS p FROM {source}))))"""


cte("al", _paths("al_in"), "al_in")
cte("alm", _paths("al_mixed_in"), "al_mixed_in")
COUNT = lambda c: f"length(path) - length(replace(path, '{c}', ''))"
cte(
    "er",
    f"""SELECT case_id, metric, {COUNT('S')} AS substitutions, {COUNT('D')} AS deletions, {COUNT('I')} AS insertions,
      {COUNT('H')} AS hits, n AS ref_length, m AS hyp_length,
      CASE WHEN n > 0 THEN ({COUNT('S')} + {COUNT('D')} + {COUNT('I')}) / n WHEN m = 0 THEN 0 END AS error_rate FROM al""",
    "al",
)
# Every step of the mixed path with the reference position it counts for.
cte(
    "steps",
    """SELECT case_id, c, CASE WHEN c = 'I' THEN least(r, n - 1) ELSE r END AS p, n FROM (
      SELECT case_id, n, substr(path, k, 1) AS c, length(replace(path[1 : k - 1], 'I', '')) AS r
      FROM (SELECT *, unnest(range(1, length(path) + 1)) AS k FROM alm))""",
    "alm",
)
cte("wins", "SELECT case_id, op_index, tf - 3 AS lo, tf + t_n + 3 AS hi FROM ops WHERE family = 'text'", "ops")
cte(
    "marked",
    """SELECT s.case_id, s.c, s.p, bool_or(coalesce(s.p >= w.lo AND s.p < w.hi AND s.n > 0, false)) AS near, any_value(s.n) AS n, k
    FROM (SELECT *, row_number() OVER () AS k FROM steps) s LEFT JOIN wins w ON w.case_id = s.case_id
    GROUP BY s.case_id, s.c, s.p, k""",
    "steps",
    "wins",
)
REGION = """coalesce(count(*) FILTER (c <> 'H' AND {w}) / nullif(count(*) FILTER (c <> 'I' AND {w}), 0), 0) AS error_rate,
  count(*) FILTER (c = 'S' AND {w}) AS substitutions, count(*) FILTER (c = 'D' AND {w}) AS deletions,
  count(*) FILTER (c = 'I' AND {w}) AS insertions, count(*) FILTER (c = 'H' AND {w}) AS hits,
  count(*) FILTER (c <> 'I' AND {w}) AS ref_length, count(*) FILTER (c <> 'D' AND {w}) AS hyp_length, 'mixed' AS metric"""
cte(
    "edit_regions",
    f"SELECT cs.case_id, {REGION.format(w='near')} FROM cs LEFT JOIN marked m ON m.case_id = cs.case_id GROUP BY cs.case_id",
    "marked",
    "cs",
)
cte(
    "other_regions",
    f"SELECT cs.case_id, {REGION.format(w='(NOT near AND m.n > 0)')} FROM cs LEFT JOIN marked m ON m.case_id = cs.case_id GROUP BY cs.case_id",
    "marked",
    "cs",
)
cte(
    "op_regions",
    f"""SELECT w.case_id, w.op_index, {REGION.format(w='coalesce(s.p >= w.lo AND s.p < w.hi AND s.n > 0, false)')}
    FROM wins w LEFT JOIN steps s ON s.case_id = w.case_id GROUP BY w.case_id, w.op_index""",
    "wins",
    "steps",
)


def warp(source: str) -> str:
    """Warping distance per case over lists sw, sd, tw, td."""
    cost = "CASE WHEN sw[i] = tw[j] THEN abs(sd[i] - td[j]) ELSE sd[i] + td[j] + 1 END"
    return f"""SELECT *, list_reduce(range(1, len(sw) + 1), lambda row, i:
        list_reduce(range(1, len(tw) + 1), lambda acc, j: list_append(acc, {cost} + least(row[j + 1], acc[j], row[j])), ['inf'::DOUBLE]),
        list_concat([0::DOUBLE], list_transform(range(0, len(tw)), lambda j: 'inf'::DOUBLE)))[len(tw) + 1] AS distance,
      list_sum(sd) + list_sum(td) AS normalizer FROM {source}"""


cte(
    "kept_lists",
    """SELECT cs.case_id, coalesce(list(sw ORDER BY i) FILTER (sw IS NOT NULL), []) AS sw, coalesce(list(s1 - s0 ORDER BY i) FILTER (sw IS NOT NULL), []) AS sd,
      coalesce(list(tw ORDER BY i) FILTER (sw IS NOT NULL), []) AS tw, coalesce(list(t1 - t0 ORDER BY i) FILTER (sw IS NOT NULL), []) AS td
    FROM cs LEFT JOIN kept k ON k.case_id = cs.case_id AND (k.owner IS NULL OR k.owner = 'pitch') GROUP BY cs.case_id""",
    "kept",
    "cs",
)
cte("warped", warp("kept_lists"), "kept_lists")
cte(
    "dtw",
    """SELECT case_id, CASE WHEN normalizer > 0 THEN distance / normalizer END AS value,
      CASE WHEN normalizer > 0 THEN distance ELSE 0 END AS distance, coalesce(normalizer, 0) AS normalizer,
      CASE WHEN normalizer > 0 THEN 'ok' ELSE 'no_segments' END AS status FROM warped""",
    "warped",
)
cte(
    "f0err",
    """SELECT k.case_id, s.lo IS NOT NULL AS eligible, t.lo IS NULL AS missing,
      CASE WHEN t.lo IS NULL THEN 8 ELSE (abs(12 * log2(t.lo / s.lo)) + abs(12 * log2(t.hi / s.hi)) + abs(12 * log2(t.mean / s.mean))) / 3 END AS err
    FROM kept k LEFT JOIN stats s ON s.case_id = k.case_id AND s.side = 'source' AND s.ord = k.i
      LEFT JOIN stats t ON t.case_id = k.case_id AND t.side = 'target' AND t.ord = k.j
    WHERE k.owner IS NULL OR k.owner = 'rate'""",
    "kept",
    "stats",
)
cte(
    "f0",
    """SELECT cs.case_id, avg(err) FILTER (eligible) AS value, coalesce(sum(err) FILTER (eligible), 0) AS distance,
      CAST(count(*) FILTER (eligible) AS DOUBLE) AS normalizer,
      CASE WHEN count(e.case_id) = 0 THEN 'no_preserved_words' WHEN bool_or(missing AND eligible) THEN 'penalized_missing_target_f0'
        WHEN count(*) FILTER (eligible) > 0 THEN 'ok' ELSE 'no_valid_f0' END AS status
    FROM cs LEFT JOIN f0err e ON e.case_id = cs.case_id GROUP BY cs.case_id""",
    "f0err",
    "cs",
)
cte(
    "op_pairs",
    """SELECT o.case_id, o.op_index, o.kind, o.param, o.f + x AS i, o.tf + x AS j
    FROM (SELECT *, unnest(range(0, s_n)) AS x FROM ops WHERE kind IN ('pitch', 'rate')) o""",
    "ops",
)
cte(
    "pitches",
    """SELECT case_id, op_index, CASE WHEN count(s) = 0 THEN 'no_source_f0' WHEN count(t) FILTER (s IS NOT NULL) = count(s) THEN 'ok' ELSE 'missing_target' END AS status,
      avg(coalesce(12 * log2(t / s), 0)) FILTER (s IS NOT NULL) AS shift,
      abs(avg(coalesce(12 * log2(t / s), 0)) FILTER (s IS NOT NULL) - any_value(CAST(param AS DOUBLE))) AS pitch_l1
    FROM (SELECT p.*, a.median AS s, b.median AS t FROM (SELECT * FROM op_pairs WHERE kind = 'pitch') p
      LEFT JOIN stats a ON a.case_id = p.case_id AND a.side = 'source' AND a.ord = p.i
      LEFT JOIN stats b ON b.case_id = p.case_id AND b.side = 'target' AND b.ord = p.j) GROUP BY case_id, op_index""",
    "op_pairs",
    "stats",
)
cte(
    "rates",
    """SELECT case_id, op_index, CASE WHEN ds <= 0 OR positive = 0 THEN 'empty_source' WHEN dt > 0 AND realised = positive THEN 'ok' ELSE 'missing_target' END AS status,
      CASE WHEN ds > 0 THEN dt / ds END AS ratio, abs(dt - ds / factor) AS rate_l1
    FROM (SELECT p.case_id, p.op_index, any_value(CAST(p.param AS DOUBLE)) AS factor, greatest(0, any_value(x.se - x.ss)) AS ds,
        greatest(0, any_value(y.te - y.ts)) AS dt, count(*) FILTER (s.t1 > s.t0) AS positive, count(*) FILTER (s.t1 > s.t0 AND t.t1 > t.t0) AS realised
      FROM (SELECT * FROM op_pairs WHERE kind = 'rate') p JOIN src s ON s.case_id = p.case_id AND s.ord = p.i
        JOIN tgt t ON t.case_id = p.case_id AND t.ord = p.j JOIN times x ON x.case_id = p.case_id AND x.op_index = p.op_index
        JOIN ttimes y ON y.case_id = p.case_id AND y.op_index = p.op_index GROUP BY p.case_id, p.op_index)""",
    "op_pairs",
    "src",
    "tgt",
    "times",
    "ttimes",
)
cte(
    "pauses",
    """SELECT *, coalesce(target_gap - source_gap, 0) AS delta, coalesce(CASE param WHEN 'ins' THEN target_gap >= source_gap + 0.16::DOUBLE - 1e-6
        ELSE target_gap <= source_gap - 0.16::DOUBLE + 1e-6 END, false) AS correct
    FROM (SELECT x.case_id, x.op_index, x.param, greatest(0, se - ss) AS source_gap, CASE WHEN anchored THEN greatest(0, te - ts) END AS target_gap,
        CASE WHEN anchored THEN 'ok' ELSE 'missing_target' END AS status
      FROM times x JOIN ttimes y ON y.case_id = x.case_id AND y.op_index = x.op_index WHERE x.kind = 'pause')""",
    "times",
    "ttimes",
)
cte(
    "whole",
    "SELECT case_id, n_ops = 1 AND kind0 = 'emo' AND f0 = 0 AND l0 = n - 1 AS whole FROM (SELECT *, CASE WHEN kind1 IS NULL THEN 1 ELSE 2 END AS n_ops FROM cs)",
    "cs",
)
cte(
    "emotions",
    """SELECT x.case_id, x.op_index, CASE WHEN e THEN NULL ELSE predicted END AS predicted, CASE WHEN e THEN 'empty_target' END AS status
    FROM (SELECT x.case_id, x.op_index, CASE WHEN whole THEN d.target_duration <= 0 ELSE te <= ts END AS e
      FROM times x JOIN ttimes y ON y.case_id = x.case_id AND y.op_index = x.op_index JOIN dur d ON d.case_id = x.case_id
        JOIN whole w ON w.case_id = x.case_id WHERE x.kind = 'emo') x JOIN cs ON cs.case_id = x.case_id""",
    "times",
    "ttimes",
    "dur",
    "whole",
    "cs",
)
cte(
    "comp",
    """SELECT *, CASE WHEN family = 'prosody' THEN executed_raw AND coalesce(fraction >= 0.6::DOUBLE - 1e-9 AND fraction <= 1.6::DOUBLE + 1e-9, false) ELSE executed_raw END AND status0 = 'ok' AS success,
        executed_raw AND status0 = 'ok' AS executed
    FROM (SELECT *, coalesce(CASE family WHEN 'text' THEN text_rate = 0 WHEN 'emotion' THEN predicted = param WHEN 'pause' THEN correct
        ELSE CASE WHEN fraction IS NULL THEN false WHEN fraction >= 0.6::DOUBLE - 1e-9 THEN true
          WHEN kind = 'pitch' THEN CASE WHEN CAST(param AS DOUBLE) > 0 THEN shift + 1e-9 >= 1 ELSE shift - 1e-9 <= -1 END
          ELSE CASE WHEN CAST(param AS DOUBLE) > 1 THEN ratio <= 1 - 0.1::DOUBLE + 1e-9 ELSE ratio >= 1 + 0.1::DOUBLE - 1e-9 END END END, false) AS executed_raw
      FROM (SELECT o.case_id, o.op_index, o.kind, o.family, o.operation, o.param, o.shard, c.category, cs.status AS status0,
          t.error_rate AS text_rate, e.predicted, u.correct, p.shift, p.pitch_l1, r.ratio, r.rate_l1,
          coalesce(p.status, r.status, u.status, e.status) AS status,
          CASE WHEN p.status = 'missing_target' OR r.status = 'missing_target' THEN NULL
            WHEN o.kind = 'pitch' AND CAST(o.param AS DOUBLE) <> 0 THEN p.shift / CAST(o.param AS DOUBLE)
            WHEN o.kind = 'rate' AND r.ratio > 0 AND CAST(o.param AS DOUBLE) <> 1 THEN (1 / r.ratio - 1) / (CAST(o.param AS DOUBLE) - 1) END AS fraction
        FROM ops o JOIN cats c ON c.case_id = o.case_id JOIN cs ON cs.case_id = o.case_id
          LEFT JOIN op_regions t ON t.case_id = o.case_id AND t.op_index = o.op_index
          LEFT JOIN emotions e ON e.case_id = o.case_id AND e.op_index = o.op_index
          LEFT JOIN pauses u ON u.case_id = o.case_id AND u.op_index = o.op_index
          LEFT JOIN pitches p ON p.case_id = o.case_id AND p.op_index = o.op_index
          LEFT JOIN rates r ON r.case_id = o.case_id AND r.op_index = o.op_index))""",
    "ops",
    "cats",
    "cs",
    "op_regions",
    "emotions",
    "pauses",
    "pitches",
    "rates",
)
cte(
    "ev",
    """SELECT cs.case_id, cs.uid, cs.doc_id, cs.utt, cs.language, cats.category, cs.shard, cs.status <> 'ok' AS penalty_applied,
      CASE WHEN cs.status = 'ok' THEN 'ok' ELSE 'penalized_generation_failed' END AS evaluation_status,
      er.error_rate, er.substitutions, er.deletions, er.insertions, er.hits, er.ref_length, er.hyp_length, er.metric,
      x.error_rate AS edit_rate, x.substitutions + x.deletions + x.insertions AS edit_errors, x.ref_length AS edit_ref,
      y.error_rate AS other_rate, y.substitutions + y.deletions + y.insertions AS other_errors, y.ref_length AS other_ref,
      dtw.value AS dur, dtw.distance AS dur_d, dtw.normalizer AS dur_n, f0.value AS f0, f0.distance AS f0_d, f0.normalizer AS f0_n,
      CASE WHEN cs.status = 'ok' THEN similarity ELSE 0 END AS similarity, CASE WHEN cs.status = 'ok' THEN utmos ELSE 1 END AS utmos,
      k.n_ops, k.n_executed, k.n_success, k.n_correct, k.n_rate, k.rate_l1, k.n_pitch, k.pitch_l1
    FROM cs JOIN cats ON cats.case_id = cs.case_id JOIN er ON er.case_id = cs.case_id JOIN edit_regions x ON x.case_id = cs.case_id
      JOIN other_regions y ON y.case_id = cs.case_id JOIN dtw ON dtw.case_id = cs.case_id JOIN f0 ON f0.case_id = cs.case_id
      JOIN (SELECT case_id, count(*) AS n_ops, count(*) FILTER (executed) AS n_executed, count(*) FILTER (success) AS n_success,
          count(*) FILTER (correct) AS n_correct, count(*) FILTER (kind = 'rate') AS n_rate, coalesce(sum(rate_l1), 0) AS rate_l1,
          count(*) FILTER (kind = 'pitch' AND pitch_l1 IS NOT NULL) AS n_pitch, coalesce(sum(pitch_l1), 0) AS pitch_l1 FROM comp GROUP BY case_id) k ON k.case_id = cs.case_id""",
    "cs",
    "cats",
    "er",
    "edit_regions",
    "other_regions",
    "dtw",
    "f0",
    "comp",
)

def _tag(kind: str, f: str, l: str) -> str:
    body = f"array_to_string(tok[{f} + 1 : {l} + 1], ' ')"
    return f"""CASE {kind} WHEN 'ins' THEN '<ins>' || new_word || '</ins>' WHEN 'pause' THEN '<pause act="' || act || '"/>'
      WHEN 'del' THEN '<del>' || {body} || '</del>' WHEN 'sub' THEN '<sub targ="' || new_word || '">' || {body} || '</sub>'
      WHEN 'emo' THEN '<emo type="' || feeling || '">' || {body} || '</emo>' WHEN 'pitch' THEN '<pitch semitones="' || semitones || '">' || {body} || '</pitch>'
      ELSE '<rate factor="' || factor || '">' || {body} || '</rate>' END"""


def _rest(kind: str, f: str, l: str, stop: str) -> str:
    first = f"(CASE WHEN {kind} IN ('ins', 'pause') THEN {f} ELSE {l} + 1 END)"
    return f"""CASE WHEN {first} < {stop} THEN CASE WHEN {kind} IN ('ins', 'pause') THEN '' ELSE ' ' END
      || array_to_string(tok[{first} + 1 : {stop}], ' ') ELSE '' END"""


cte(
    "xmls",
    f"""SELECT *, array_to_string(tok[1 : f0], ' ') || CASE WHEN f0 > 0 THEN ' ' ELSE '' END || {_tag('kind0', 'f0', 'l0')} || {_rest('kind0', 'f0', 'l0', 'c1')}
      || CASE WHEN kind1 IS NULL THEN '' ELSE ' ' || {_tag('kind1', 'f1', 'l1')} || {_rest('kind1', 'f1', 'l1', 'n')} END AS xml FROM cs""",
    "cs",
)

OUTCOMES = """sum(n_executed) / sum(n_ops) AS component_execution_rate, sum(n_success) / sum(n_ops) AS component_success_rate,
  avg(CASE WHEN n_executed = n_ops THEN 1 ELSE 0 END) AS all_component_execution_rate, avg(CASE WHEN n_success = n_ops THEN 1 ELSE 0 END) AS all_component_success_rate"""
OUTCOMES_R = OUTCOMES.replace("sum(n_executed) / sum(n_ops)", "round(sum(n_executed) / sum(n_ops), 6)").replace(
    "sum(n_success) / sum(n_ops)", "round(sum(n_success) / sum(n_ops), 6)"
).replace("avg(CASE WHEN n_executed = n_ops THEN 1 ELSE 0 END)", "round(avg(CASE WHEN n_executed = n_ops THEN 1 ELSE 0 END), 6)").replace(
    "avg(CASE WHEN n_success = n_ops THEN 1 ELSE 0 END)", "round(avg(CASE WHEN n_success = n_ops THEN 1 ELSE 0 END), 6)"
)
CATEGORY = """CASE WHEN category = 'text' THEN round(100 * sum(edit_errors) / nullif(sum(edit_ref), 0), 6) END AS edit_region_wer,
  CASE WHEN category = 'text' THEN round(100 * sum(other_errors) / nullif(sum(other_ref), 0), 6) END AS non_edit_region_wer,
  CASE WHEN category = 'emotion' THEN round(100 * sum(n_success) / sum(n_ops), 6) END AS emotion_accuracy,
  CASE WHEN category = 'pause' THEN round(100 * sum(n_correct) / sum(n_ops), 6) END AS direction_accuracy,
  round(sum(rate_l1) / nullif(sum(n_rate), 0), 6) AS duration_l1_sec, round(sum(pitch_l1) / nullif(sum(n_pitch), 0), 6) AS pitch_l1_semitones"""
POOLED = "sum(substitutions + deletions + insertions) / nullif(sum(ref_length), 0)"
GROUP = f"""count(*) AS count, round(100 * {POOLED}, 6) AS asr_error, round(avg(similarity), 6) AS speaker_similarity, round(avg(utmos), 6) AS utmos,
  round(100 * sum(dur_d) / nullif(sum(dur_n), 0), 6) AS wdtw_dur, round(sum(f0_d) / nullif(sum(f0_n), 0), 6) AS wdtw_f0, {OUTCOMES_R}"""
R = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
COUNTS = "substitutions, deletions, insertions, hits, ref_length, hyp_length"
SUMS = ", ".join(f"sum({c}) AS {c}" for c in COUNTS.split(", "))

SQL = {
    "p01_unit_spans": with_("SELECT case_id, a AS \"start\", b AS \"end\", word AS unit FROM src", "src"),
    "p02_normalize_unit": """SELECT unit, count(*) AS n FROM (SELECT regexp_replace(lower(nfc_normalize(w)), '[^\\p{L}\\p{N}]', '', 'g') AS unit
        FROM (SELECT unnest(string_split_regex(text, '[ \\n]+')) AS w FROM documents)) WHERE unit <> '' GROUP BY unit""",
    "p03_normalize_er": f"SELECT doc_id, sha256({NORMAL.format('text')}) AS normal_sha256 FROM documents",
    "p04_mixed_tokens": f"""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all({NORMAL.format('text')}, '[^ ]+')) AS token FROM documents) GROUP BY token""",
    "p05_explode_instructions": with_(
        """SELECT case_id, op_index, kind, src_start, src_end, tgt_start, tgt_end, param, CASE kind WHEN 'ins' THEN new_word WHEN 'pause' THEN '' ELSE body END AS content FROM ops""",
        "ops",
    ),
    "p05_regions": with_(
        """SELECT kind, count(*) AS n, sum(src_end) AS src, sum(tgt_end) AS tgt FROM (
          SELECT kind, src_end, tgt_end FROM ops
          UNION ALL SELECT 'equal', length(array_to_string(tok[1 : f0], ' ')) + 1, length(array_to_string(tok[1 : f0], ' ')) + CASE WHEN respaced THEN 0 ELSE 1 END FROM cs WHERE f0 > 0
          UNION ALL SELECT 'equal', CASE WHEN o2.case_id IS NULL THEN length(o.source_text) ELSE o2.src_start END,
            CASE WHEN o2.case_id IS NULL THEN length(o.target_text) ELSE length(array_to_string(o.ttok[1 : o2.tf], ' ')) + CASE WHEN o.respaced THEN 0 ELSE 1 END END
          FROM ops o LEFT JOIN ops o2 ON o2.case_id = o.case_id AND o2.op_index = 1 WHERE o.op_index = 0 AND o.f + o.s_n < o.n
          UNION ALL SELECT 'equal', length(source_text), length(target_text) FROM ops WHERE op_index = 1 AND f + s_n < n)
        GROUP BY kind""",
        "ops",
        "cs",
    ),
    "p06_render_texts": with_("SELECT case_id, source_text, target_text FROM cs", "cs"),
    "p07_replace_span": with_(
        """SELECT case_id, op_index, array_to_string(list_concat(tok[1 : f], list_concat(CASE WHEN kind IN ('ins', 'sub') THEN [new_word] ELSE [] END,
          CASE WHEN f + s_n < n THEN tok[f + s_n + 1 : n] ELSE [] END)), ' ') AS changed FROM ops WHERE family = 'text'""",
        "ops",
    ),
    "p08_quarantine": with_(
        """SELECT CASE uid % 6 WHEN 0 THEN 'unknown tag' WHEN 1 THEN 'wrong body' WHEN 2 THEN 'bad parameter' WHEN 3 THEN 'not well formed'
          ELSE 'declaration or empty fragment' END AS reason, count(*) AS n FROM cs WHERE uid % 6 < 5 GROUP BY 1""",
        "cs",
    ),
    "p09_family": with_("SELECT case_id, op_index, family, operation FROM ops", "ops"),
    "p10_category": with_("SELECT case_id, category FROM cats", "cats"),
    "p11_edited_units": with_(
        "SELECT o.case_id, o.op_index, t.ord FROM ops o JOIN tgt t ON t.case_id = o.case_id AND t.a < o.tgt_end AND t.b > o.tgt_start WHERE o.tgt_end > o.tgt_start", "ops", "tgt"
    ),
    "p12_preserved_pairs": with_(
        """SELECT case_id, 'duration' AS scope, i, j FROM kept WHERE owner IS NULL OR owner = 'pitch'
        UNION ALL SELECT case_id, 'f0', i, j FROM kept WHERE owner IS NULL OR owner = 'rate'""",
        "kept",
    ),
    "p13_bounded_intervals": with_(
        """SELECT s.case_id, ord, round(least(source_duration, greatest(0, t0 - 0.1)), 6) AS "start", round(least(source_duration, greatest(0, t1 + 0.1)), 6) AS "end"
        FROM src s JOIN dur d ON d.case_id = s.case_id""",
        "src",
        "dur",
    ),
    "p14_crop_window": with_(
        """SELECT x.case_id, x.op_index, CASE WHEN whole THEN 0 ELSE round(greatest(0, ts - 0.25), 6) END AS "start",
          round(CASE WHEN whole THEN target_duration ELSE least(target_duration, te + 0.25) END, 6) AS "end"
        FROM times x JOIN ttimes y ON y.case_id = x.case_id AND y.op_index = x.op_index JOIN dur d ON d.case_id = x.case_id
          JOIN whole w ON w.case_id = x.case_id WHERE x.kind = 'emo'""",
        "times",
        "ttimes",
        "dur",
        "whole",
    ),
    "p15_whole_utterance": with_("SELECT case_id, whole FROM whole", "whole"),
    "p16_er_metric": with_("SELECT case_id, metric FROM al_in", "al_in"),
    "p17_sequential_plan": with_(
        """SELECT case_id, step, op_index, array_to_string(before, ' ') AS source_text, array_to_string(after, ' ') AS target_text FROM (
          SELECT case_id, op_index, step, CASE WHEN step = 0 THEN tok WHEN first = 0 THEN a0 ELSE a1 END AS before,
            CASE WHEN n_ops = 1 OR step = 1 THEN ttok WHEN first = 0 THEN a0 ELSE a1 END AS after
          FROM (SELECT o.case_id, o.op_index, cs.tok, cs.ttok, n_ops, first, CASE WHEN n_ops = 1 THEN 0 WHEN o.op_index = first THEN 0 ELSE 1 END AS step,
              list_concat(cs.tok[1 : f0], list_concat(CASE WHEN kind0 IN ('ins', 'sub') THEN [cs.new_word] ELSE [] END, cs.tok[r0 + 1 : cs.n])) AS a0,
              list_concat(cs.tok[1 : f1], list_concat(CASE WHEN kind1 IN ('ins', 'sub') THEN [cs.new_word] ELSE [] END, cs.tok[r1 + 1 : cs.n])) AS a1
            FROM (SELECT *, CASE WHEN kind1 IS NULL THEN 1 ELSE 2 END AS n_ops,
                CASE WHEN kind0 NOT IN ('ins', 'del', 'sub') AND kind1 IN ('ins', 'del', 'sub') THEN 1 ELSE 0 END AS first FROM cs) cs
              JOIN ops o ON o.case_id = cs.case_id))""",
        "cs",
        "ops",
    ),
    "p18_one_take_plan": with_(
        """SELECT case_id, 0 AS step, source_text, target_text, sha256(xml) AS xml_sha256 FROM xmls""",
        "xmls",
    ),
    "p19_first_operation": with_(
        """SELECT case_id, arg_min(op_index, src_start * 10 + op_index) AS first_op, arg_min(op_index, src_start * 10 + op_index) FILTER (family <> 'text') AS acoustic_op,
          count(DISTINCT family) > 1 AS composition FROM ops GROUP BY case_id""",
        "ops",
    ),
    "p29_text_edit_ledger": with_(
        """SELECT case_id, op_index, kind, sha256(CASE WHEN kind = 'ins' THEN '' ELSE body END) AS source_sha256,
          sha256(CASE WHEN kind = 'del' THEN '' ELSE new_word END) AS target_sha256 FROM ops WHERE family = 'text'""",
        "ops",
    ),
    "j03_pair_units": with_("SELECT case_id, op_index, i, j, true AS same FROM op_pairs", "op_pairs"),
    "j04_span_times": with_("SELECT case_id, op_index, round(ss, 6) AS \"start\", round(se, 6) AS \"end\" FROM times WHERE kind <> 'pause'", "times"),
    "j05_point_gaps": with_(
        """SELECT x.case_id, x.op_index, round(greatest(0, se - ss), 6) AS source_gap, round(greatest(0, te - ts), 6) AS target_gap, anchored AS valid
        FROM times x JOIN ttimes y ON y.case_id = x.case_id AND y.op_index = x.op_index WHERE kind = 'pause'""",
        "times",
        "ttimes",
    ),
    "j06_frames_in_spans": with_(
        """SELECT s.side, s.ord, count(*) AS frames, round(sum(hz), 3) AS hz FROM spans s JOIN frm f ON f.case_id = s.case_id AND f.side = s.side
          AND f.t >= s.t0 - 1e-10 AND CASE WHEN s.closed THEN f.t <= s.t1 + 1e-10 ELSE f.t < s.t1 - 1e-10 END GROUP BY ALL""",
        "spans",
        "frm",
    ),
    "j07_match_sequences": with_("SELECT case_id, ord, word AS expected, 'x' || word AS found FROM tgt_raw WHERE (uid + ord) % 23 = 0", "tgt_raw"),
    "w01_monotone_violations": with_(
        """SELECT case_id, ord, round("start", 6) AS "start", round("end", 6) AS "end" FROM (
          SELECT *, lag("start", 1, 0) OVER (PARTITION BY case_id ORDER BY ord) AS ps, lag("end", 1, 0) OVER (PARTITION BY case_id ORDER BY ord) AS pe
          FROM (SELECT case_id, ord, t0 - CASE WHEN (uid + ord) % 29 = 0 THEN 0.5 ELSE 0 END AS "start", t1 AS "end" FROM src)) WHERE "start" < ps OR "end" < pe""",
        "src",
    ),
    "k01_error_counts": with_(f"SELECT case_id, round(error_rate, 6) AS error_rate, {COUNTS}, metric FROM er", "er"),
    "k02_region_errors": with_(f"SELECT case_id, round(error_rate, 6) AS error_rate, {COUNTS}, metric FROM other_regions", "other_regions"),
    "k03_local_error_rate": with_(f"SELECT case_id, op_index, round(error_rate, 6) AS error_rate, {COUNTS}, metric FROM op_regions", "op_regions"),
    "k03_edit_region": with_(f"SELECT case_id, round(error_rate, 6) AS error_rate, {COUNTS}, metric FROM edit_regions", "edit_regions"),
    "k04_duration_dtw": with_(
        """SELECT case_id, CASE WHEN normalizer > 0 THEN round(distance / normalizer, 6) END AS value, CASE WHEN normalizer > 0 THEN round(distance, 6) ELSE 0 END AS distance,
          round(normalizer, 6) AS normalizer, CASE WHEN normalizer > 0 THEN 'ok' ELSE 'no_segments' END AS status FROM ("""
        + warp(
            """(SELECT case_id, list(word ORDER BY ord) AS sw, list(t1 - t0 ORDER BY ord) AS sd, list(CASE WHEN (uid + ord) % 23 = 0 THEN 'x' || word ELSE word END ORDER BY ord) AS tw,
            list((ord * 25 + CASE WHEN (uid * 5 + ord) % 19 = 0 THEN 0 ELSE 5 + (uid * 7 + ord * 11) % 15 END) / 100::DOUBLE - ord * 25 / 100::DOUBLE ORDER BY ord) AS td
            FROM src GROUP BY case_id)"""
        )
        + ")",
        "src",
    ),
    "k05_f0_preservation": with_(f"SELECT case_id, {R('value', 'distance', 'normalizer')}, status FROM f0", "f0"),
    "k06_pitch_shift": with_(f"SELECT case_id, op_index, status, {R('shift', 'pitch_l1')} FROM pitches", "pitches"),
    "k07_rate_measure": with_(f"SELECT case_id, op_index, status, {R('ratio', 'rate_l1')} FROM rates", "rates"),
    "k08_pause_measure": with_(f"SELECT case_id, op_index, status, {R('source_gap', 'target_gap', 'delta')}, correct FROM pauses", "pauses"),
    "k09_emotion_outcome": with_("SELECT case_id, op_index, status, predicted FROM emotions", "emotions"),
    "k10_cosine_similarity": """SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))
          / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 5) AS similarity
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "k11_change_fraction": with_("SELECT case_id, op_index, CASE WHEN fraction = 0 THEN 0 ELSE round(fraction, 6) END AS fraction FROM comp WHERE family = 'prosody'", "comp"),
    "k12_executed": with_("SELECT case_id, op_index, executed FROM comp", "comp"),
    "k13_success": with_("SELECT case_id, op_index, success FROM comp", "comp"),
    "k14_penalty_rows": with_(
        """SELECT case_id, evaluation_status, deletions, round(dur_d, 6) AS dur_distance, round(dur_n, 6) AS dur_normalizer, round(f0_d, 6) AS f0_distance,
          round(f0_n, 6) AS f0_normalizer, similarity, utmos, 0 AS passed FROM ev WHERE penalty_applied""",
        "ev",
    ),
    "k15_case_evaluation": with_(
        """SELECT case_id, language, category, shard, evaluation_status, round(error_rate, 6) AS wer, round(edit_rate, 6) AS edit_wer, round(other_rate, 6) AS other_wer,
          round(dur, 6) AS dur, round(f0, 6) AS f0, round(similarity, 6) AS similarity, round(utmos, 6) AS utmos, n_ops AS ops, n_success AS passed FROM ev""",
        "ev",
    ),
    "a01_pooled_error_rate": with_(
        f"""SELECT category, {SUMS}, round({POOLED}, 6) AS error_rate, CASE WHEN min(metric) = max(metric) THEN min(metric) ELSE 'mixed' END AS metric, count(*) AS count
        FROM er JOIN cats ON cats.case_id = er.case_id GROUP BY category""",
        "er",
        "cats",
    ),
    "a02_pooled_ratio": with_(
        """SELECT category, 'duration' AS measure, round(100 * sum(distance) / sum(normalizer), 4) AS value, round(sum(distance), 4) AS distance, round(sum(normalizer), 4) AS normalizer
        FROM dtw JOIN cats ON cats.case_id = dtw.case_id GROUP BY category
        UNION ALL SELECT category, 'f0', round(sum(distance) / sum(normalizer), 4), round(sum(distance), 4), round(sum(normalizer), 4)
        FROM f0 JOIN cats ON cats.case_id = f0.case_id GROUP BY category""",
        "dtw",
        "f0",
        "cats",
    ),
    "a03_strict_mean": with_("SELECT shard, round(avg(similarity), 6) AS similarity, round(avg(utmos), 6) AS utmos FROM cs GROUP BY shard", "cs"),
    "a04_component_rates": with_(
        """SELECT category, CASE WHEN family IS NOT NULL THEN 'family' ELSE 'operation' END AS dimension, coalesce(family, operation) AS name, count(*) AS count,
          round(avg(executed::INT), 6) AS execution_rate, round(avg(success::INT), 6) AS success_rate
        FROM comp GROUP BY GROUPING SETS ((category, family), (category, operation))""",
        "comp",
    ),
    "a05_outcome_rates": with_(f"SELECT category, {OUTCOMES_R} FROM ev GROUP BY category", "ev"),
    "a06_category_metrics": with_(f"SELECT category, {CATEGORY} FROM ev GROUP BY category", "ev"),
    "a06_unmeasured_pitch": with_("SELECT case_id, count(*) AS n FROM comp WHERE kind = 'pitch' AND pitch_l1 IS NULL GROUP BY case_id", "comp"),
    "a07_summarize": with_(
        f"""SELECT category, shard, CASE WHEN grouping(shard) = 1 THEN 'category' ELSE 'shard' END AS level, {GROUP}, {CATEGORY}
        FROM ev GROUP BY GROUPING SETS ((category), (category, shard))""",
        "ev",
    ),
    "a08_totals": with_("SELECT count(*) AS evaluated, count(*) FILTER (status <> 'ok') AS penalized FROM cs", "cs"),
    "a09_generation_counts": with_(
        "SELECT count(*) AS attempted, count(*) FILTER (status = 'ok') AS generated, count(*) FILTER (status <> 'ok') AS failed FROM cs", "cs"
    ),
    "a10_span_stats": with_(
        """SELECT case_id, side, ord, lo AS min_f0_hz, hi AS max_f0_hz, median AS median_f0_hz, round(mean, 6) AS mean_f0_hz,
          round(voiced / frames, 6) AS voiced_fraction, frames AS num_frames, voiced AS num_voiced_frames FROM stats""",
        "stats",
    ),
    "a11_metric_label": with_(
        """SELECT category, CASE WHEN min(metric) = max(metric) THEN min(metric) ELSE 'mixed' END AS metric
        FROM al_in JOIN cats ON cats.case_id = al_in.case_id GROUP BY category""",
        "al_in",
        "cats",
    ),
    "a18_compare_systems": with_(
        """SELECT system, count(*) AS modes, round(avg(os), 6) AS operation_success, round(avg(al), 6) AS all_success, round(avg(sim), 6) AS similarity,
          round(avg(dur), 6) AS wdtw_dur, round(avg(f0), 6) AS wdtw_f0 FROM (
          SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS system, utt % 2 AS mode, sum(n_success) / sum(n_ops) AS os,
            avg(CASE WHEN n_success = n_ops THEN 1 ELSE 0 END) AS al, avg(similarity) AS sim, 100 * sum(dur_d) / sum(dur_n) AS dur, sum(f0_d) / sum(f0_n) AS f0
          FROM ev GROUP BY 1, 2) GROUP BY system""",
        "ev",
    ),
    "u04_accumulator": with_(f"SELECT category, {SUMS}, count(*) AS count FROM er JOIN cats ON cats.case_id = er.case_id GROUP BY category", "er", "cats"),
}
