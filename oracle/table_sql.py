"""Oracle SQL for ``editlens.plans.table_queries``."""

from __future__ import annotations

from oracle.fixture_sql import cte, with_

cte(
    "assets",
    """SELECT 'c' || doc_id AS case_id, doc_id, sha256(text) AS asset_id, lang AS language, source, n_chars AS size_bytes,
      (['bundle', 'upstream', 'generate'])[doc_id % 3 + 1] AS kind, text FROM documents""",
)
cte(
    "ledger",
    """SELECT d.doc_id, sha256(text) AS audio_sha256, lang, source, n_chars, quality, CASE WHEN quality = 1 THEN 'allow' ELSE 'hold' END AS decision
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
cte("cc", "SELECT *, '$.cases[' || utt || ']' AS place FROM cs", "cs")
cte("inventory", "SELECT DISTINCT asset_id, asset_id AS sha256, size_bytes FROM assets", "assets")
cte(
    "log",
    """SELECT user_id AS key, event_id, ts, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'view' THEN 'running' WHEN 'signup' THEN 'unsupported' ELSE 'error' END AS status,
      'value ' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS error FROM events""",
)
cte(
    "numbered",
    """SELECT *, lag(status) OVER (PARTITION BY key ORDER BY ts, event_id) AS previous_status, lag(error) OVER (PARTITION BY key ORDER BY ts, event_id) AS previous_error
    FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS number
      FROM (SELECT * REPLACE (CASE status WHEN 'running' THEN 'error' ELSE status END AS status, CASE status WHEN 'running' THEN 'Previous process stopped before recording a response' ELSE error END AS error) FROM log)) WHERE number <= 5""",
    "log",
)
cte(
    "final",
    """SELECT key, CASE WHEN ok_at IS NOT NULL THEN 'ok' WHEN n = 5 THEN last ELSE 'pending' END AS status, coalesce(ok_at, n) AS attempts FROM (
      SELECT key, min(number) FILTER (status = 'ok') AS ok_at, count(*) AS n, max_by(status, number) AS last FROM numbered GROUP BY key)""",
    "numbered",
)
# A request for each user and day; the log is read up to two hours before its newest row, an attempt has six hours.
cte("daily", "SELECT key * 100 + day(ts) AS key, event_id, ts, status FROM log", "log")
cte(
    "spans",
    """SELECT key, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS number, ts AS began,
      CASE WHEN status <> 'running' THEN ts WHEN n_ts <= ts + INTERVAL 6 HOUR THEN n_ts WHEN n_ts IS NOT NULL OR ts + INTERVAL 6 HOUR <= now THEN ts + INTERVAL 6 HOUR END AS ended,
      CASE WHEN status <> 'running' THEN status WHEN n_ts <= ts + INTERVAL 6 HOUR AND n_status <> 'running' THEN n_status WHEN n_ts IS NOT NULL OR ts + INTERVAL 6 HOUR <= now THEN 'error' END AS status
    FROM (SELECT *, lag(status) OVER w AS p_status, lag(ts) OVER w AS p_ts, lead(status) OVER w AS n_status, lead(ts) OVER w AS n_ts
      FROM (SELECT *, (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 HOUR FROM daily) AS now FROM daily) WHERE ts <= now WINDOW w AS (PARTITION BY key ORDER BY ts, event_id))
    WHERE NOT coalesce(status <> 'running' AND p_status = 'running' AND ts <= p_ts + INTERVAL 6 HOUR, false)
    QUALIFY number <= 5""",
    "daily",
)
cte(
    "timed_final",
    """SELECT d.key, CASE WHEN ok_at IS NOT NULL THEN 'ok' ELSE coalesce(last, 'pending') END AS status, coalesce(ok_at, n, 0) AS attempts
    FROM (SELECT DISTINCT key FROM daily) d LEFT JOIN (SELECT key, min(number) FILTER (status = 'ok') AS ok_at, count(status) AS n, max(status) FILTER (number = 5) AS last
      FROM spans GROUP BY key) s ON s.key = d.key""",
    "daily",
    "spans",
)
# One record per document, as columns.
cte(
    "records",
    """SELECT *, CASE WHEN generator IS NOT NULL THEN 'generate' WHEN doc_id % 3 = 1 THEN 'upstream' ELSE 'bundle' END AS kind,
      (['AISHELL-1', 'CommonVoice20.0', 'FLEURS', 'MLS'])[doc_id % 4 + 1] AS origin FROM (
      SELECT *, sha256(text) AS sha, CASE WHEN doc_id % 3 = 0 THEN (['indextts2', 'voxcpm2', 'mimo_audio_instruct', 'qwen3_tts'])[doc_id % 4 + 1] END AS generator FROM documents)""",
)
cte(
    "origins",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN origin WHEN doc_id % 5 = 0 THEN 'own' ELSE origin END AS dataset,
      CASE WHEN doc_id % 2 = 0 THEN 'dataset_transcript' ELSE 'written' END AS kind, CASE WHEN doc_id % 2 = 0 THEN lang END AS split,
      CASE WHEN doc_id % 2 = 0 THEN 'clip' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS source_id FROM records""",
    "records",
)
cte(
    "terms",
    """SELECT * FROM (VALUES ('AISHELL-1', 'Apache-2.0', 'allowed_with_notice'), ('CommonVoice20.0', 'CC0-1.0', 'public_domain_dedication'),
      ('FLEURS', 'CC-BY-4.0', 'allowed_with_attribution'), ('MLS', 'CC-BY-4.0', 'allowed_with_attribution'), ('own', 'Apache-2.0', 'allowed_with_notice')) t(dataset, license, redistribution)""",
)
cte(
    "steps_text",
    """SELECT case_id, uid, language, op_index, step, array_to_string(before, ' ') AS source_text, array_to_string(after, ' ') AS target_text, kind, before, f_now, l_now, s_n, n_before, respaced, new_word, feeling, semitones, factor, act, n_ops FROM (
      SELECT *, len(before) AS n_before, f AS f_now, l AS l_now FROM (
        SELECT o.case_id, cs.uid, cs.language, o.op_index, o.kind, o.s_n, n_ops, cs.new_word, cs.feeling, cs.semitones, cs.factor, cs.act, cs.respaced,
          CASE WHEN n_ops = 1 OR o.op_index = first THEN 0 ELSE 1 END AS step,
          CASE WHEN n_ops = 1 OR o.op_index = first THEN cs.tok WHEN first = 0 THEN a0 ELSE a1 END AS before,
          CASE WHEN n_ops = 1 OR o.op_index <> first THEN cs.ttok WHEN first = 0 THEN a0 ELSE a1 END AS after,
          CASE WHEN n_ops = 1 OR o.op_index = first THEN o.f WHEN o.op_index = 1 THEN o.tf ELSE o.f END AS f,
          CASE WHEN n_ops = 1 OR o.op_index = first THEN o.l WHEN o.op_index = 1 THEN o.tf + o.l - o.f ELSE o.l END AS l
        FROM (SELECT *, CASE WHEN kind1 IS NULL THEN 1 ELSE 2 END AS n_ops,
            CASE WHEN kind0 NOT IN ('ins', 'del', 'sub') AND kind1 IN ('ins', 'del', 'sub') THEN 1 ELSE 0 END AS first,
            list_concat(tok[1 : f0], list_concat(CASE WHEN kind0 IN ('ins', 'sub') THEN [new_word] ELSE [] END, tok[r0 + 1 : n])) AS a0,
            list_concat(tok[1 : f1], list_concat(CASE WHEN kind1 IN ('ins', 'sub') THEN [new_word] ELSE [] END, tok[r1 + 1 : n])) AS a1 FROM cs) cs
          JOIN ops o ON o.case_id = cs.case_id))""",
    "cs",
    "ops",
)


def _step_xml() -> str:
    body = "array_to_string(before[f_now + 1 : l_now + 1], ' ')"
    tag = f"""CASE kind WHEN 'ins' THEN '<ins>' || new_word || '</ins>' WHEN 'pause' THEN '<pause act="' || act || '"/>'
      WHEN 'del' THEN '<del>' || {body} || '</del>' WHEN 'sub' THEN '<sub targ="' || new_word || '">' || {body} || '</sub>'
      WHEN 'emo' THEN '<emo type="' || feeling || '">' || {body} || '</emo>' WHEN 'pitch' THEN '<pitch semitones="' || semitones || '">' || {body} || '</pitch>'
      ELSE '<rate factor="' || factor || '">' || {body} || '</rate>' END"""
    after = "CASE WHEN kind IN ('ins', 'pause') THEN f_now ELSE l_now + 1 END"
    return tag, after


_TAG, _AFTER = _step_xml()
# A pause that follows a text edit sits right after the word before it, because
# its place in the respaced target is there.
cte(
    "step_xml",
    f"""SELECT s.case_id, s.language, s.step, s.op_index, s.source_text, CASE WHEN n_ops = 1 THEN x.xml ELSE
        array_to_string(before[1 : f_now], ' ') || CASE WHEN f_now > 0 AND NOT moved THEN ' ' ELSE '' END || {_TAG}
        || CASE WHEN {_AFTER} < n_before THEN CASE WHEN kind IN ('ins', 'pause') AND NOT moved THEN '' ELSE ' ' END || array_to_string(before[{_AFTER} + 1 : n_before], ' ') ELSE '' END END AS xml
    FROM (SELECT *, kind = 'pause' AND step = 1 AND respaced AND f_now > 0 AS moved FROM steps_text) s JOIN (SELECT case_id, xml FROM xmls) x ON x.case_id = s.case_id""",
    "steps_text",
    "xmls",
)
cte(
    "refs",
    """SELECT case_id, mode, step, op_index, source_text, language, sha256('{"instruction_xml": "' || replace(xml, '"', '\\"') || '", "language": "' || language || '", "source_text": "' || source_text || '"}') AS key FROM (
      SELECT case_id, 'one_take' AS mode, 0 AS step, NULL AS op_index, source_text, language, xml FROM xmls
      UNION ALL SELECT case_id, 'sequential', step, op_index, source_text, language, xml FROM step_xml)""",
    "xmls",
    "step_xml",
)


def command(dialect: str, templates: dict[str, str]) -> str:
    body = " ".join(f"WHEN {cond} THEN {text}" for cond, text in templates.items())
    return f"SELECT case_id, op_index, '{dialect}' AS dialect, CASE {body} END AS command FROM cmd"


ZH = "CASE param WHEN 'happy' THEN '开心' WHEN 'sad' THEN '悲伤' WHEN 'angry' THEN '生气' ELSE '害怕' END"
cte(
    "cmd",
    """SELECT *, CAST(CAST(CASE WHEN kind IN ('pitch', 'rate') THEN param END AS DOUBLE) AS DOUBLE) AS v,
      CASE WHEN kind IN ('pitch', 'rate') THEN regexp_replace(CAST(CAST(CASE WHEN kind IN ('pitch', 'rate') THEN param END AS DECIMAL(12, 6)) AS VARCHAR), '\\.?0+$', '') END AS num,
      CASE WHEN kind IN ('pitch', 'rate') THEN regexp_replace(CAST(abs(CAST(CASE WHEN kind IN ('pitch', 'rate') THEN param END AS DECIMAL(12, 6))) AS VARCHAR), '\\.?0+$', '') END AS mag
    FROM ops WHERE family <> 'text'""",
    "ops",
)
ZHL = "language = 'zh' AND "
COMMANDS = " UNION ALL ".join(
    [
        command(
            "restyle",
            {
                ZHL + "kind = 'emo'": f"'用' || {ZH} || '的语气说。'",
                ZHL + "kind = 'rate'": "'用原来' || num || '倍的语速说。'",
                ZHL + "kind = 'pitch'": "'将整段话的音高' || CASE WHEN v > 0 THEN '提高' ELSE '降低' END || mag || '个半音。'",
                ZHL + "kind = 'pause'": "CASE WHEN param = 'ins' THEN '增加' ELSE '减少' END || '整段话中的停顿。'",
                "kind = 'emo'": "'Speak in a ' || param || ' voice.'",
                "kind = 'rate'": "'Speak at ' || num || ' times the original speaking rate.'",
                "kind = 'pitch'": "'Speak with the pitch ' || CASE WHEN v > 0 THEN 'raised' ELSE 'lowered' END || ' by ' || mag || ' semitones.'",
                "kind = 'pause'": "'Speak with ' || CASE WHEN param = 'ins' THEN 'longer' ELSE 'shorter' END || ' pauses throughout.'",
            },
        ),
        command(
            "transcribed",
            {
                "kind = 'emo'": "'change the emotion to ' || param || ' mood.'",
                "kind = 'pitch'": "'shifts the pitch by ' || num || ' steps.'",
                "kind = 'rate'": "'adjusts the speed to ' || num || '.'",
                "kind = 'pause'": "CASE WHEN param = 'ins' THEN 'increase' ELSE 'reduce' END || ' the pauses throughout the entire utterance.'",
            },
        ),
        command(
            "utterance",
            {
                ZHL + "kind = 'emo'": f"'将整段话以' || {ZH} || '的情绪说出。'",
                ZHL + "kind = 'rate'": "'将整段话的语速调整为' || param || '倍。'",
                ZHL + "kind = 'pitch'": "'将整段话的音高' || CASE WHEN v > 0 THEN '提高' ELSE '降低' END || mag || '个半音。'",
                ZHL + "kind = 'pause'": "'将整段话中的停顿' || CASE WHEN param = 'ins' THEN '增加' ELSE '减少' END || '。'",
                "kind = 'emo'": "'Speak the entire utterance with a ' || param || ' emotion.'",
                "kind = 'rate'": "'Adjust the speaking rate of the entire utterance to ' || param || 'x.'",
                "kind = 'pitch'": "CASE WHEN v > 0 THEN 'Increase' ELSE 'Decrease' END || ' the pitch of the entire utterance by ' || mag || ' semitones.'",
                "kind = 'pause'": "CASE WHEN param = 'ins' THEN 'Increase' ELSE 'Reduce' END || ' the pauses throughout the entire utterance.'",
            },
        ),
        command(
            "gridded",
            {
                "kind = 'rate'": "'adjust the speed to ' || CASE param WHEN '0.50' THEN '0.5' WHEN '0.75' THEN '0.8' WHEN '1.00' THEN '1.0' WHEN '1.25' THEN '1.2' WHEN '1.50' THEN '1.5' WHEN '1.75' THEN '1.7' ELSE '2.0' END || 'x'",
                "kind = 'pitch'": "'shift the pitch by ' || num || ' step' || CASE WHEN abs(v) = 1 THEN '' ELSE 's' END",
                "kind = 'emo'": "'adjust the emotion to ' || param",
                "kind = 'pause'": "CASE WHEN param = 'ins' THEN 'increase' ELSE 'reduce' END || ' the pauses'",
            },
        ),
        command(
            "local",
            {
                ZHL + "kind = 'emo'": f"'将情绪改为' || {ZH} || '。'",
                ZHL + "kind = 'pitch'": "'将音高' || CASE WHEN v > 0 THEN '提高' ELSE '降低' END || mag || '个半音。'",
                ZHL + "kind = 'rate'": "'将语速调整为' || param || '倍。'",
                "kind = 'emo'": "'Change the emotion to ' || CASE WHEN param = 'afraid' THEN 'fearful' ELSE param END || '.'",
                "kind = 'pitch'": "CASE WHEN v > 0 THEN 'Raise' ELSE 'Lower' END || ' the pitch by ' || mag || ' semitones.'",
                "kind = 'rate'": "'Adjust the speech speed to ' || param || 'x.'",
            },
        ),
    ]
)
V = lambda check, cond, detail, src, key="case_id": f"SELECT '{check}' AS \"check\", {key} AS key, '{detail}' AS detail FROM {src} WHERE {cond}"

TREE_DIGEST = "SELECT sha256(asset_id) AS p, sha256('{\"asset_id\":\"' || asset_id || '\",\"sha256\":\"' || sha256 || '\",\"size_bytes\":' || size_bytes || '}') AS d, 1 AS n FROM inventory"
for _width in (4, 3, 2, 1, 0):
    TREE_DIGEST = f"SELECT substr(p, 1, {_width}) AS p, sha256(string_agg(d, '' ORDER BY p, d)) AS d, sum(n) AS n FROM ({TREE_DIGEST}) GROUP BY substr(p, 1, {_width})"
TREE_DIGEST = f"SELECT CAST(n AS BIGINT) AS assets, d AS digest FROM ({TREE_DIGEST})"

SQL = {
    "s01_manifest_scan": with_(
        "SELECT category, shard, cs.case_id, language, sha256(source_text) AS sha256, n AS units FROM cs JOIN cats ON cats.case_id = cs.case_id", "cs", "cats"
    ),
    "s02_shard_pruning": with_("SELECT cs.case_id, category, shard FROM cs JOIN cats ON cats.case_id = cs.case_id WHERE category = 'text' AND shard = 'easy'", "cs", "cats"),
    "s03_asset_map": with_(
        "SELECT cs.case_id || '-a' AS asset_id, category, 'generate' AS kind, 'voxcpm2' AS provider, uid AS seed, n AS cfg_value FROM cs JOIN cats ON cats.case_id = cs.case_id", "cs", "cats"
    ),
    "s05_runlog_scan": with_("SELECT case_id AS id, status, sha256(target_text) AS audio_sha256, CASE WHEN status = 'ok' THEN NULL ELSE 'no audio' END AS error FROM cs", "cs"),
    "s06_ledger_scan": with_("SELECT 'C03' AS \"check\", audio_sha256 AS key, count(*) || ' rows' AS detail FROM ledger GROUP BY audio_sha256 HAVING count(*) > 1", "ledger"),
    "s07_append_sink": with_("SELECT utt % 2 AS run_id, status, count(*) AS n FROM cs GROUP BY 1, 2", "cs"),
    "s08_summary_sink": with_("SELECT 'complete' AS status, count(*) AS evaluated, count(*) FILTER (status <> 'ok') AS penalized FROM cs", "cs"),
    "s09_content_sink": with_(
        "SELECT substr(asset_id, 1, 2) AS prefix, count(*) AS n, sum(bytes) AS bytes FROM (SELECT DISTINCT asset_id, strlen(text) AS bytes FROM assets) GROUP BY 1", "assets"
    ),
    "s10_run_snapshot": with_(
        """SELECT 'run-1' AS run_id, count(*) AS cases, 'identity' AS candidate, '1' AS dataset_version, 'running' AS status,
        min_by(case_id, uid) AS first_case, max_by(case_id, uid) AS last_case FROM cs""",
        "cs",
    ),
    "s11_receipt": with_(
        """SELECT assets, digest, kind, count(*) AS n FROM (SELECT asset_id, min_by(kind, [language, source, CAST(size_bytes AS VARCHAR), kind]) AS kind FROM assets GROUP BY 1),
        (""" + TREE_DIGEST + """)
        GROUP BY ALL""",
        "assets",
        "inventory",
    ),
    "s12_bundle_export": with_("SELECT sha256, size_bytes FROM inventory WHERE sha256 IN (SELECT audio_sha256 FROM ledger WHERE decision = 'allow')", "inventory", "ledger"),
    "p20_render_commands": with_(f"SELECT * FROM ({COMMANDS}) WHERE command IS NOT NULL", "cmd"),
    "p20_native_tags": with_(
        """SELECT case_id, regexp_replace(regexp_replace(regexp_replace(xml, '<(pitch|rate) (semitones|factor)="([^"]*)">', '<\\1, \\2=\\3>', 'g'),
          '<pause act="([a-z]*)"/>', '<pause act="\\1" level="2"/>', 'g'), '<emo type="([a-z]*)">', '<emo type="\\1" level="2">', 'g') AS native FROM xmls""",
        "xmls",
    ),
    "p21_snap_to_grid": """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN v = 1 THEN 1 ELSE (SELECT min({'d': abs(g - v), 'n': abs(g - 1), 'g': g}).g
            FROM (SELECT CAST(x AS DECIMAL(12, 6)) / 10 AS g0, CAST(x / 10.0 AS DECIMAL(12, 6)) AS g FROM range(5, 21) t(x)) WHERE (g - 1) * (v - 1) > 0) END AS DOUBLE) AS speed,
          CAST(CASE WHEN w = 0 THEN 0 ELSE (SELECT min({'d': abs(x - w), 'n': abs(x), 'g': x}).g FROM range(-6, 7) t(x) WHERE x * w > 0) END AS INT) AS shift
        FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 0.05::DOUBLE + 0.03::DOUBLE AS DECIMAL(12, 6)) AS v, CAST(l_discount * 100 - 5.5::DOUBLE AS DECIMAL(12, 6)) AS w FROM lineitem)""",
    "p22_unique_context": with_(
        """SELECT case_id, op_index, best.a AS "start", best.a + best.len AS "end" FROM (
          SELECT o.case_id, o.op_index, min({'len': r.b - l.a, 'a': l.a}) AS best
          FROM (SELECT * FROM ops WHERE family = 'text') o
            JOIN (SELECT case_id, 0 AS a FROM cs UNION SELECT case_id, a FROM src UNION SELECT case_id, src_start FROM ops) l ON l.case_id = o.case_id AND (l.a <= o.src_start)
            JOIN (SELECT case_id, length(source_text) AS b FROM cs UNION SELECT case_id, b FROM src UNION SELECT case_id, src_end FROM ops) r ON r.case_id = o.case_id AND r.b >= o.src_end AND r.b > l.a
          WHERE (l.a IN (0, o.src_start) OR EXISTS (SELECT 1 FROM src s WHERE s.case_id = o.case_id AND s.a = l.a))
            AND (r.b IN (length(o.source_text), o.src_end) OR EXISTS (SELECT 1 FROM src s WHERE s.case_id = o.case_id AND s.b = r.b))
            AND strpos(o.source_text, substr(o.source_text, l.a + 1, r.b - l.a)) = l.a + 1
            AND strpos(substr(o.source_text, l.a + 2), substr(o.source_text, l.a + 1, r.b - l.a)) = 0
          GROUP BY o.case_id, o.op_index)""",
        "ops",
        "cs",
        "src",
    ),
    "p23_edit_windows": with_(
        """SELECT case_id, kind, start_frame, end_frame, target_frames, CAST(target_frames * 320 AS BIGINT) AS generated_samples, round(window_seconds, 6) AS window_seconds,
          w1 <= w0 OR end_frame <= start_frame AS identity FROM (
          SELECT *, CAST(greatest(1, round_even(window_seconds * 50, 0)) AS INT) AS target_frames, CASE WHEN everything THEN 0 ELSE CAST(round_even(w0 * 50, 0) AS INT) END AS start_frame,
            CASE WHEN everything THEN CAST(ceil(source_duration * 50) AS INT) ELSE CAST(least(round_even(w1 * 50, 0), ceil(source_duration * 50)) AS INT) END AS end_frame FROM (
            SELECT case_id, kind, everything, source_duration, CASE WHEN everything THEN 0 ELSE a0 END AS w0, CASE WHEN everything THEN source_duration ELSE a1 END AS w1,
              CASE WHEN everything THEN ts ELSE a1 - a0 + ts - original END AS window_seconds FROM (
              SELECT *, CASE WHEN family = 'text' THEN source_duration * strlen(changed) / greatest(1, strlen(source_text))
                  WHEN everything AND kind = 'rate' THEN source_duration / v WHEN everything THEN source_duration WHEN kind = 'rate' THEN original / v
                  WHEN kind = 'pause' THEN CASE WHEN param = 'ins' THEN original + 0.2::DOUBLE ELSE greatest(0, original - 0.2::DOUBLE) END ELSE original END AS ts,
                CASE WHEN kind = 'pause' THEN least(coalesce(left_start, 0), ss) ELSE ss END AS a0,
                CASE WHEN kind = 'pause' THEN greatest(coalesce(right_end, source_duration), ss, se) ELSE greatest(ss, se) END AS a1
              FROM (SELECT o.case_id, o.kind, o.family, o.param, o.source_text, d.source_duration, x.ss, x.se, greatest(0, x.se - x.ss) AS original,
                  CASE WHEN o.kind IN ('pitch', 'rate') THEN TRY_CAST(o.param AS DOUBLE) END AS v,
                  o.family = 'text' OR (o.kind IN ('emo', 'rate', 'pitch') AND o.f = 0 AND o.l = o.n - 1) AS everything,
                  array_to_string(list_concat(o.tok[1 : o.f], list_concat(CASE WHEN o.kind IN ('ins', 'sub') THEN [o.new_word] ELSE [] END, CASE WHEN o.f + o.s_n < o.n THEN o.tok[o.f + o.s_n + 1 : o.n] ELSE [] END)), ' ') AS changed,
                  (SELECT max_by(s.t0, s.ord) FROM src s WHERE s.case_id = o.case_id AND s.b <= o.src_start) AS left_start,
                  (SELECT min_by(s.t1, s.ord) FROM src s WHERE s.case_id = o.case_id AND s.a >= o.src_end) AS right_end
                FROM ops o JOIN dur d ON d.case_id = o.case_id LEFT JOIN times x ON x.case_id = o.case_id AND x.op_index = o.op_index WHERE o.op_index = 0))))""",
        "ops",
        "dur",
        "times",
        "src",
    ),
    "p24_retry_prompt": with_(
        """SELECT key, number, 'Edit: request ' || key || CASE WHEN previous_status IS NULL THEN '' WHEN previous_status = 'unsupported'
          THEN chr(10) || chr(10) || '上次判为 unsupported，理由：' || previous_error || chr(10) || '这个理由很可能不成立。XML 已明确给出了编辑类型、方向和位置，请结合上述说明及官方支持的任务重新检查，再次判断并重新生成完整的分类 JSON。'
          ELSE chr(10) || chr(10) || '上次处理失败，错误原因：' || previous_error || chr(10) || '请修正该错误，重新生成符合官方字段要求的有效 JSON；使用正确的 JSON 标点和字符串转义。' END AS prompt FROM numbered""",
        "numbered",
    ),
    "p25_extract_label": """SELECT conv_id, turn, CASE WHEN len(l) = 1 THEN l[1] END AS label FROM (SELECT conv_id, turn, list_distinct(list_transform(list_filter(
          regexp_extract_all(lower(text || (array[' Happy.', ' happy or sad', ' neutral', ' unhappy', ''])[(conv_id * 7 + turn) % 5 + 1]), '[a-z0-9_]+'),
          lambda w: w IN ('happy', 'angry', 'sad', 'afraid', 'disgusted', 'melancholic', 'surprised', 'calm', 'neutral')), lambda w: CASE WHEN w = 'neutral' THEN 'calm' ELSE w END)) AS l FROM conversations)""",
    "p27_derive_recipes": with_(
        """SELECT doc_id, kind, CASE generator WHEN 'mimo_audio_instruct' THEN 'mimo_audio' ELSE generator END AS provider,
          CASE WHEN kind = 'generate' THEN 'm' || doc_id % 5 END AS model_id, CASE WHEN kind = 'generate' THEN doc_id END AS seed,
          CASE WHEN kind = 'generate' AND doc_id % 6 = 0 THEN 'r' || doc_id % 50 END AS reference_asset_id,
          CASE WHEN kind = 'upstream' THEN lang END AS split, CASE WHEN kind = 'upstream' THEN 'clip' || doc_id END AS clip_id,
          CASE kind WHEN 'upstream' THEN 'clips/' || doc_id || '.mp3' WHEN 'bundle' THEN 'audio/' || sha || '.wav' END AS path,
          CASE WHEN kind = 'upstream' THEN sha256(lang) END AS sha256,
          CASE WHEN kind = 'generate' THEN 'cfg_value=' || doc_id % 7 || CASE WHEN doc_id % 2 = 0 THEN ',control=' || lang ELSE '' END ELSE '' END AS parameters FROM records""",
        "records",
    ),
    "p28_transcript_origin": with_("SELECT doc_id, o.dataset, kind, split, source_id, license, redistribution FROM origins o JOIN terms t ON t.dataset = o.dataset", "origins", "terms"),
    "p30_redact": "SELECT conv_id, turn, replace(text, 'on', '[REDACTED]') AS text FROM conversations",
    "j01_join_runs": with_("SELECT case_id, status, strlen(source_text) AS source_bytes, strlen(target_text) AS output_bytes FROM cs", "cs"),
    "j01_run_violations": with_(
        """SELECT 'J01' AS "check", CASE WHEN d = 'unknown case' THEN 'x' || case_id ELSE case_id END AS key, d AS detail FROM (
          SELECT case_id, 'no generation record' AS d FROM cs WHERE uid % 31 = 0
          UNION ALL SELECT case_id, '2 generation records' FROM cs WHERE uid % 31 <> 0 AND uid % 37 = 0
          UNION ALL SELECT case_id, 'unknown case' FROM cs WHERE uid % 31 <> 0 AND uid % 37 <> 0 AND uid % 41 = 0
          UNION ALL SELECT case_id, 'no source payload' FROM cs WHERE sha256(source_text) LIKE '0%'
          UNION ALL SELECT case_id, 'no output payload' FROM cs WHERE uid % 31 <> 0 AND status = 'ok' AND sha256(target_text) LIKE '0%')""",
        "cs",
    ),
    "j02_attach_groups": with_("SELECT cs.case_id, round(similarity, 6) AS similarity, category, shard FROM cs JOIN cats ON cats.case_id = cs.case_id", "cs", "cats"),
    "j08_join_ledger": with_(
        """SELECT decision, count(*) AS n, min(case_id) AS first_case FROM assets a JOIN (SELECT audio_sha256, max(decision) AS decision FROM ledger WHERE quality IS NOT NULL GROUP BY 1) l
        ON l.audio_sha256 = a.asset_id GROUP BY decision""",
        "assets",
        "ledger",
    ),
    "j08_ledger_gaps": with_(
        """SELECT DISTINCT 'no ledger row' AS reason, asset_id FROM assets WHERE asset_id NOT IN (SELECT audio_sha256 FROM ledger WHERE quality IS NOT NULL)
        UNION ALL SELECT DISTINCT 'unused ledger row', audio_sha256 FROM ledger WHERE quality IS NOT NULL AND audio_sha256 NOT IN (SELECT asset_id FROM assets)""",
        "assets",
        "ledger",
    ),
    "j09_asset_dependencies": """SELECT 'd' || doc_id AS asset_id, CASE WHEN doc_id % 3 <> 2 THEN 'independent' WHEN doc_id * 3 // 2 IN (SELECT doc_id FROM documents) THEN 'generate_after' ELSE 'dangling' END AS stage FROM documents""",
    "j09_asset_stages": """WITH RECURSIVE a AS (
        SELECT id, CASE WHEN r IS NULL THEN NULL ELSE 'd' || r END AS ref, provider, coalesce(list_position(['qwen3_tts', 'indextts2', 'voxcpm2', 'mimo_audio'], provider), 0) AS turn
        FROM (SELECT 'd' || doc_id AS id, CASE WHEN doc_id IN (4, 8) THEN doc_id + 4 WHEN doc_id IN (12, 20) THEN 4 WHEN doc_id % 7 = 0 THEN -doc_id - 1 WHEN doc_id % 2 = 1 THEN doc_id // 2 END AS r,
          CASE WHEN doc_id % 2 = 1 THEN (['qwen3_tts', 'indextts2', 'voxcpm2', 'mimo_audio'])[doc_id % 5 + 1] END AS provider FROM documents)),
      down AS (SELECT id, 0 AS depth, 'root' AS e FROM a WHERE ref IS NULL
        UNION ALL SELECT id, 1, 'dangling' FROM a WHERE ref IS NOT NULL AND ref NOT IN (SELECT id FROM a)
        UNION ALL SELECT a.id, depth + 1, e FROM down JOIN a ON a.ref = down.id),
      walk AS (SELECT id AS start, ref AS cur, 1 AS n FROM a WHERE id NOT IN (SELECT id FROM down)
        UNION ALL SELECT start, a.ref, n + 1 FROM walk JOIN a ON a.id = walk.cur WHERE n < 40)
      SELECT a.id AS asset_id, a.ref AS reference_asset_id, a.provider, a.turn, CASE WHEN e = 'root' THEN depth END AS stage,
        CASE WHEN e = 'dangling' AND depth > 1 THEN 'behind_dangling' WHEN e = 'dangling' THEN e
          WHEN e IS NULL THEN CASE WHEN a.id IN (SELECT start FROM walk WHERE cur = start) THEN 'cycle' ELSE 'behind_cycle' END
          WHEN b.turn > a.turn THEN 'late_reference' WHEN depth = 0 THEN 'independent' ELSE 'generate_after' END AS status
      FROM a LEFT JOIN down ON down.id = a.id LEFT JOIN a b ON b.id = a.ref""",
    "j10_cache_split": with_(
        """SELECT key, CASE WHEN hit AND status <> 'pending' THEN status ELSE 'pending' END AS status FROM (
          SELECT key, substr(key, 2, 1) <= '7' AS hit, (['ok', 'unsupported', 'pending', 'error'])[CAST('0x' || substr(key, 1, 1) AS INT) % 4 + 1] AS status FROM (SELECT DISTINCT key FROM refs))""",
        "refs",
    ),
    "j10_identity_split": with_(
        """SELECT 'planner@1' AS identity, key, CASE WHEN substr(key, 1, 1) <= '7' THEN 'ok' ELSE 'pending' END AS status FROM (SELECT DISTINCT key FROM refs)
        UNION ALL SELECT 'planner@2', key, CASE WHEN substr(key, 2, 1) <= '3' AND substr(key, 3, 1) <> '0' THEN 'error' ELSE 'pending' END FROM (SELECT DISTINCT key FROM refs)""",
        "refs",
    ),
    "j14_plan_requests": with_("SELECT case_id, mode, step, op_index, key FROM refs", "refs"),
    "j11_diff_contract": with_(
        """SELECT case_id, CASE WHEN uid % 41 = 0 THEN 'missing' WHEN uid % 37 = 0 AND language <> 'zh' THEN 'fixed field changed'
          ELSE 'alignment of unchanged payload changed' END AS reason FROM cs
        WHERE uid % 41 = 0 OR (uid % 37 = 0 AND language <> 'zh') OR (uid % 29 = 0 AND uid % 31 <> 0)""",
        "cs",
    ),
    "j12_compare_fingerprints": with_(
        """SELECT case_id AS asset_id, CASE WHEN doc_id % 43 = 0 THEN 'extra' WHEN kind = 'generate' THEN 'generated_mismatch' ELSE 'strict_mismatch' END AS mismatch
        FROM assets WHERE doc_id % 43 = 0 OR doc_id % 5 = 0""",
        "assets",
    ),
    "j13_refresh_alignments": with_(
        """SELECT case_id, CASE WHEN substr(asset_id, 1, 1) < '4' THEN 'aligned ' || substr(asset_id, 1, 8) ELSE 'stored' END AS alignment,
          CASE WHEN substr(asset_id, 1, 1) < '4' THEN 'generated' ELSE 'reused' END AS alignment_source FROM assets""",
        "assets",
    ),
    "j15_unused_assets": with_(
        """SELECT DISTINCT 'unused asset' AS reason, asset_id FROM assets WHERE doc_id % 5 <> 0 AND asset_id NOT IN (SELECT asset_id FROM assets WHERE doc_id % 4 <> 0)
        UNION ALL SELECT DISTINCT 'no recipe', asset_id FROM assets WHERE doc_id % 4 <> 0 AND asset_id NOT IN (SELECT asset_id FROM assets WHERE doc_id % 5 <> 0)""",
        "assets",
    ),
    "a12_inventory_digest": with_(f"SELECT * FROM ({TREE_DIGEST})", "inventory"),
    "a12_tree_digest": with_(f"SELECT * FROM ({TREE_DIGEST})", "inventory"),
    "a13_request_counts": with_("SELECT 'unique' AS mode, count(DISTINCT key) AS n FROM refs UNION ALL SELECT mode, count(*) FROM refs GROUP BY mode", "refs"),
    "a14_recipe_counts": with_("SELECT kind, count(*) AS n FROM assets GROUP BY kind", "assets"),
    "a15_alignment_counts": with_("SELECT CASE WHEN substr(asset_id, 1, 1) < '4' THEN 'generated' ELSE 'reused' END AS alignment_source, count(*) AS n FROM assets GROUP BY 1", "assets"),
    "a16_source_rollup": with_(
        "SELECT o.dataset, license, count(*) AS n FROM origins o JOIN terms t ON t.dataset = o.dataset GROUP BY GROUPING SETS ((o.dataset, license), ())", "origins", "terms"
    ),
    "a17_cases_per_asset": with_("SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY case_id) - 1 AS ord, case_id FROM assets", "assets"),
    "a19_cache_progress": with_(
        """SELECT count(*) AS total, count(*) FILTER (status <> 'pending') AS completed, count(*) FILTER (status <> 'pending' AND key % 3 = 0) AS cached,
          count(*) FILTER (status <> 'pending' AND key % 3 <> 0) AS fresh, count(*) FILTER (status = 'pending') AS remaining, count(*) FILTER (status = 'ok') AS ok,
          count(*) FILTER (status = 'unsupported') AS unsupported, count(*) FILTER (status = 'error') AS error, sum(CASE WHEN status <> 'pending' THEN attempts ELSE 0 END) AS attempts FROM final""",
        "final",
    ),
    "w02_number_attempts": with_("SELECT key, number, event_id, status, previous_status FROM numbered", "numbered"),
    "w03_terminal_status": with_("SELECT key, status, attempts FROM final", "final"),
    "w04_step_lineage": with_(
        """SELECT case_id, step, reason FROM (SELECT s.case_id, s.step, CASE WHEN s.step = 1 AND s.uid % 15 = 0 THEN 'step before failed'
          WHEN s.step = 1 AND (s.uid % 10 = 0) THEN 'input is not the output before' END AS reason FROM steps_text s) WHERE reason IS NOT NULL""",
        "steps_text",
    ),
    "t01_canonical_order": with_("SELECT asset_id, sha256, size_bytes FROM inventory", "inventory"),
    "t02_order_operations": with_("SELECT case_id, src_start, op_index, kind FROM ops", "ops"),
    "t03_sample_violations": with_("SELECT 'C03' AS \"check\", asset_id AS key, count(*) || ' rows' AS detail FROM assets GROUP BY asset_id HAVING count(*) > 1 ORDER BY asset_id LIMIT 5", "assets"),
    "t04_top1": with_("SELECT asset_id, min(size_bytes) AS size_bytes, min(doc_id) AS doc_id, min_by(case_id, doc_id) AS case_id FROM assets GROUP BY asset_id", "assets"),
    "x01_same_keys": with_(
        """SELECT DISTINCT asset_id, 'missing' AS side FROM assets WHERE doc_id % 13 <> 0 AND asset_id NOT IN (SELECT asset_id FROM assets WHERE doc_id % 17 <> 0)
        UNION ALL SELECT DISTINCT asset_id, 'extra' FROM assets WHERE doc_id % 17 <> 0 AND asset_id NOT IN (SELECT asset_id FROM assets WHERE doc_id % 13 <> 0)""",
        "assets",
    ),
    "x02_key_diff": with_(
        """SELECT side, count(*) AS n, min(asset_id) AS first_key FROM (
          (SELECT 'missing' AS side, asset_id FROM assets WHERE doc_id % 13 <> 0 EXCEPT ALL SELECT 'missing', asset_id FROM assets WHERE doc_id % 17 <> 0)
          UNION ALL (SELECT 'extra', asset_id FROM assets WHERE doc_id % 17 <> 0 EXCEPT ALL SELECT 'extra', asset_id FROM assets WHERE doc_id % 13 <> 0)) GROUP BY side""",
        "assets",
    ),
    "x03_union_requests": with_("SELECT DISTINCT key, source_text, language FROM refs", "refs"),
    "x04_same_order": with_(
        """SELECT uid AS ord, case_id AS expected, CASE WHEN uid % 100 = 7 THEN NULL ELSE case_id || 'x' END AS found FROM cs WHERE uid % 100 = 7 OR uid % 97 = 5
        UNION ALL SELECT uid + 500000000, NULL, CASE WHEN uid % 97 = 5 THEN case_id || 'x' ELSE case_id END FROM cs WHERE uid % 100 = 7""",
        "cs",
    ),
    "c01_fields": with_(
        V("C01", "uid % 17 = 0 OR uid % 13 = 0", "case fields", "cs") + " UNION ALL " + V("C01", "uid % 19 = 0", "audio fields", "cs"), "cs"
    ),
    "c02_duplicate_keys": with_(V("C02", "uid % 23 = 0 OR uid % 29 = 0", "duplicate key", "cs"), "cs"),
    "c02_every_level": with_(
        """SELECT c AS "check", CAST(doc_id AS VARCHAR) AS key, p AS path, d AS detail FROM (
          SELECT 'C02' AS c, doc_id, place || '.annotations.source_alignment.segments[0].start' AS p, 'duplicate key' AS d FROM cc WHERE uid % 97 = 0
          UNION ALL SELECT 'C01', doc_id, place || '.annotations.source_alignment.segments[' || (n - 1) || '].end', 'missing field' FROM cc WHERE uid % 109 = 0
          UNION ALL SELECT 'C01', doc_id, place || '.source_audio.size', 'unknown field' FROM cc WHERE uid % 89 = 0
          UNION ALL SELECT 'C01', doc_id, place || '.annotations.source_alignment.text_sha256', 'missing field' FROM cc WHERE uid % 103 = 0
          UNION ALL SELECT 'C01', doc_id, place || '.annotations.note', 'unknown field' FROM cc WHERE uid % 101 = 0
          UNION ALL SELECT 'C02', doc_id, place || '.annotations.note["a b"]', 'duplicate key' FROM cc WHERE uid % 101 = 0
          UNION ALL SELECT 'C02', doc_id, place || '.id', 'duplicate key' FROM cc WHERE uid % 107 = 0
          UNION ALL SELECT DISTINCT 'C02', doc_id, '$.shard', 'duplicate key' FROM cc WHERE doc_id % 13 = 0
          UNION ALL SELECT DISTINCT 'C01', doc_id, '$.extra', 'unknown field' FROM cc WHERE doc_id % 17 = 0)""",
        "cc",
    ),
    "c03_unique": with_("SELECT 'C03' AS \"check\", asset_id AS key, count(*) || ' rows' AS detail FROM assets GROUP BY asset_id HAVING count(*) > 1", "assets"),
    "c04_patterns": with_(
        " UNION ALL ".join(
            V("C04", cond, detail, "cs", "CASE WHEN uid % 19 = 0 THEN '-' ELSE '' END || case_id")
            for cond, detail in (("uid % 19 = 0", "identifier"), ("uid % 23 = 0", "digest"), ("uid % 17 = 0 OR uid % 29 = 0", "path"))
        ),
        "cs",
    ),
    "c05_enums": with_(
        V("C05", "lang NOT IN ('en', 'zh')", "language", "cs JOIN documents d ON d.doc_id = cs.doc_id") + " UNION ALL " + V("C05", "uid % 31 = 0", "category", "cs"), "cs"
    ),
    "c06_alignment": with_(
        """SELECT 'C06' AS "check", case_id AS key, detail FROM (
          SELECT case_id, 'order' AS detail FROM (SELECT *, lag(t) OVER (PARTITION BY case_id ORDER BY ord) AS pt, lag(t1) OVER (PARTITION BY case_id ORDER BY ord) AS pe
            FROM (SELECT *, CASE WHEN (uid + ord) % 59 = 0 THEN 0 ELSE t0 END AS t FROM src)) GROUP BY case_id HAVING bool_or(t < pt OR t1 < pe)
          UNION ALL SELECT case_id, 'words' FROM src WHERE (uid + ord) % 53 = 0 AND word <> 'x' GROUP BY case_id
          UNION ALL SELECT case_id, 'text digest' FROM cs WHERE uid % 61 = 0 AND source_text <> 'x' UNION ALL SELECT case_id, 'payload digest' FROM cs WHERE uid % 67 = 0)""",
        "src",
        "cs",
    ),
    "c07_error_counts": with_(
        V("C07", "uid % 71 = 0", "negative count", "cs") + " UNION ALL " + V("C07", "uid % 71 = 0 AND uid % 73 <> 0 OR uid % 73 = 0", "counts do not add up", "cs")
        + " UNION ALL " + V("C07", "uid % 71 = 0 OR uid % 79 = 0 OR (uid % 73 = 0 AND uid % 5 + uid % 3 + uid % 2 > 0)", "rate disagrees", "cs"),
        "cs",
    ),
    "c08_ratio_stats": with_(
        V("C08", "uid % 31 = 0", "negative", "cs") + " UNION ALL " + V("C08", "uid % 37 = 0 AND (uid % 31 = 0 OR uid % 7 <> 0)", "distance without normaliser", "cs"), "cs"
    ),
    "c09_outcomes": with_(V("C09", "uid % 31 = 0", "no operation", "cs") + " UNION ALL " + V("C09", "uid % 37 = 0 AND uid % 31 <> 0", "missing outcome", "cs"), "cs"),
    "c10_version": with_(V("C10", "uid % 41 = 0 OR uid % 43 = 0", "protocol version", "cs"), "cs"),
    "c11_status": with_(V("C11", "uid % 47 = 0", "status", "cs"), "cs"),
    "c11_evaluation_gate": with_(
        """SELECT 'C03' AS "check", case_id AS key, '2 rows' AS detail FROM cs WHERE uid % 53 = 0
        UNION ALL SELECT 'C11', case_id, 'status' FROM (SELECT case_id, uid, unnest(range(0, CASE WHEN uid % 53 = 0 THEN 2 ELSE 1 END)) FROM cs) WHERE uid % 47 = 0
        UNION ALL SELECT 'C10', case_id, 'protocol version' FROM (SELECT case_id, uid, unnest(range(0, CASE WHEN uid % 53 = 0 THEN 2 ELSE 1 END)) FROM cs) WHERE uid % 41 = 0 OR uid % 43 = 0""",
        "cs",
    ),
    "c12_conflicts": with_(
        "SELECT 'C12' AS \"check\", asset_id AS key, 'conflicting definitions' AS detail FROM (SELECT DISTINCT asset_id, kind, language, size_bytes FROM assets) GROUP BY asset_id HAVING count(*) > 1", "assets"
    ),
    "c13_recipes": " UNION ALL ".join(
        V("C13", cond, detail, "documents", "'d' || doc_id")
        for cond, detail in (("doc_id % 6 IN (1, 5)", "fields"), ("doc_id % 6 = 3", "provider"), ("doc_id % 6 = 2 AND doc_id % 4 = 0", "seed"), ("doc_id % 6 = 4", "digest"))
    ),
    "c14_totals": with_(
        """SELECT 'C14' AS "check", coalesce(a.kind, e.kind) AS key, 'found ' || coalesce(n, 0) || ' expected ' || coalesce(want, 0) AS detail
        FROM (SELECT kind, count(*) AS n FROM assets GROUP BY kind) a FULL JOIN (VALUES ('bundle', 334), ('upstream', 333), ('generate', 1), ('external', 5)) e(kind, want) ON e.kind = a.kind
        WHERE n IS DISTINCT FROM want""",
        "assets",
    ),
    "c16_wav_profile": """SELECT 'd' || doc_id AS path, 1 AS channels, 16000 AS sample_rate, strlen(text) AS data_bytes, doc_id % 41 <> 0 AND strlen(text) > 0 AS valid,
          CASE WHEN doc_id % 41 <> 0 AND strlen(text) > 0 THEN strlen(text) / 32000::DOUBLE END AS duration FROM documents""",
    "c16_chunk_walk": """SELECT 'd' || doc_id AS path, CASE WHEN way < 5 THEN 1 END AS channels, CASE WHEN way < 5 THEN 16000 END AS sample_rate, CASE WHEN way <> 4 THEN size END AS data_bytes,
          way < 4 AND size > 0 AS valid, CASE WHEN way < 4 AND size > 0 THEN size / 32000::DOUBLE END AS duration, CASE way WHEN 3 THEN 3 WHEN 5 THEN NULL ELSE 1 END AS encoding
        FROM (SELECT doc_id, doc_id % 6 AS way, strlen(text) AS size FROM documents)""",
    "r01_stream_runlog": with_("SELECT event_id, key, status FROM log", "log"),
    "r01_duplicate_ids": """SELECT 'R01' AS "check", CAST(event_id AS VARCHAR) AS key, 'duplicate 1' AS detail FROM events WHERE event_id % 7 = 0""",
    "r02_stream_progress": with_("SELECT status, count(*) AS n FROM (SELECT status FROM log UNION ALL SELECT status FROM log WHERE event_id % 7 = 0) GROUP BY status", "log"),
    "r03_stream_attempts": with_("SELECT key, status, attempts FROM final", "final"),
    "r03_timed_attempts": with_("SELECT key, status, attempts FROM timed_final", "timed_final"),
    "r03_stream_timed_attempts": with_("SELECT key, status, attempts FROM timed_final", "timed_final"),
    "r03_attempt_spans": with_("SELECT key, number, epoch_us(began) AS began, epoch_us(ended) AS ended, status FROM spans", "spans"),
    "r04_stream_fill_cache": with_("SELECT DISTINCT key, 'answer ' || key AS answer FROM log", "log"),
    "r04_two_versions": with_("SELECT DISTINCT i.identity, key, 'answer ' || key || i.identity AS answer FROM log, (VALUES ('@1'), ('@2')) i(identity)", "log"),
    "u01_scorer": "SELECT doc_id, round(length(text) / 100, 6) AS score, 'length-1' AS identity FROM documents",
    "u03_planner": with_(
        "SELECT 'sequential' AS planner, step, count(*) AS n FROM steps_text GROUP BY step UNION ALL SELECT 'one_take', 0, count(*) FROM cs", "steps_text", "cs"
    ),
    "u02_generator": with_(
        """SELECT step, CASE WHEN step = 0 AND sha256(cs.source_text) LIKE '%0' THEN 'error' ELSE 'ok' END AS status, count(*) AS n
        FROM steps_text s JOIN cs ON cs.case_id = s.case_id WHERE NOT (step = 1 AND sha256(cs.source_text) LIKE '%0') GROUP BY 1, 2""",
        "steps_text",
        "cs",
    ),
    "u05_identity": with_("SELECT case_id, sha256(source_text) AS output_sha256, 'ok' AS status FROM cs", "cs"),
}
