"""The derived input tables of ``editlens.fixtures`` in DuckDB SQL, as named CTEs."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql)


def with_(body: str, *needs: str) -> str:
    """``body`` preceded by the CTEs it needs, each once, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in CTES[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for need in needs:
        add(need)
    recursive = any("RECURSIVE" in CTES[n][1] for n in order)
    parts = ",\n".join(f"{n} AS ({CTES[n][1].replace('/*RECURSIVE*/', '')})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{body}" if order else body


cte(
    "utt",
    """SELECT doc_id, lang, utt, doc_id * 4099 + utt AS uid, words[utt * 12 + 1 : utt * 12 + 12] AS tok
    FROM (SELECT doc_id, lang, words, unnest(range(0, (len(words) - 1) // 12 + 1)) AS utt
      FROM (SELECT doc_id, lang, regexp_extract_all(text, '[A-Za-z0-9]+') AS words FROM documents) WHERE len(words) > 0)""",
)
cte(
    "base",
    """SELECT 'c' || doc_id || '_' || utt AS case_id, uid, doc_id, utt, tok, len(tok) AS n,
      CASE WHEN lang = 'fr' THEN 'zh' ELSE 'en' END AS language,
      CASE WHEN doc_id % 2 = 0 THEN 'easy' ELSE 'hard' END AS shard,
      (['ins', 'del', 'sub', 'emo', 'pitch', 'rate', 'pause'])[uid % 7 + 1] AS kind0,
      CASE WHEN uid % 5 = 0 AND len(tok) >= 8
        THEN (['ins', 'del', 'sub', 'emo', 'pitch', 'rate', 'pause'])[(uid + 3) % 7 + 1] END AS kind1,
      len(tok) // 4 AS f0, least(len(tok) // 4 + 1, len(tok) - 1) AS l0,
      2 * len(tok) // 3 AS f1, 2 * len(tok) // 3 + 1 AS l1,
      (['alpha', 'beta', 'gamma'])[uid % 3 + 1] AS new_word,
      (['happy', 'sad', 'angry', 'afraid'])[uid % 4 + 1] AS feeling,
      CAST(uid % 9 - 4 AS VARCHAR) AS semitones,
      (['0.50', '0.75', '1.00', '1.25', '1.50', '1.75', '2.00'])[uid % 7 + 1] AS factor,
      CASE WHEN uid % 2 = 0 THEN 'ins' ELSE 'red' END AS act
    FROM utt""",
    "utt",
)
cte(
    "cs",
    """SELECT *, array_to_string(tok, ' ') AS source_text, array_to_string(ttok, ' ') AS target_text,
      n * 25 / 100::DOUBLE AS source_duration, len(ttok) * 25 / 100::DOUBLE AS target_duration,
      CASE WHEN uid % 11 = 0 THEN 'candidate_error' ELSE 'ok' END AS status,
      uid % 101 / 100::DOUBLE AS similarity, 1 + uid % 401 / 100::DOUBLE AS utmos,
      (['happy', 'sad', 'angry', 'afraid'])[(uid // 4) % 4 + 1] AS predicted,
      CASE WHEN uid % 11 = 0 THEN [] ELSE list_transform(list_filter(range(0, len(ttok)), lambda i: (uid * 31 + i) % 13 <> 0),
        lambda i: CASE WHEN (uid * 17 + i) % 11 = 0 THEN 'zz' ELSE ttok[i + 1] END) END AS heard_tok,
      coalesce(kind0 IN ('ins', 'del', 'sub') OR kind1 IN ('ins', 'del', 'sub'), false) OR kind0 IN ('ins', 'del', 'sub') AS respaced
    FROM (SELECT *, list_concat(tok[1 : f0],
        list_concat(CASE WHEN kind0 IN ('ins', 'sub') THEN [new_word] ELSE [] END,
        list_concat(CASE WHEN c1 > r0 THEN tok[r0 + 1 : c1] ELSE [] END,
        list_concat(CASE WHEN kind1 IN ('ins', 'sub') THEN [new_word] ELSE [] END,
          CASE WHEN n > r1 THEN tok[r1 + 1 : n] ELSE [] END)))) AS ttok
      FROM (SELECT *, CASE WHEN kind0 IN ('del', 'sub') THEN l0 + 1 ELSE f0 END AS r0,
          CASE WHEN kind1 IS NULL THEN n WHEN kind1 IN ('del', 'sub') THEN l1 + 1 ELSE f1 END AS r1,
          CASE WHEN kind1 IS NULL THEN n ELSE f1 END AS c1 FROM base))""",
    "base",
)
# One row per operation: source tokens f..l (s_n of them), target tokens tf.. (t_n of them).
cte(
    "ops0",
    """SELECT case_id, uid, n, tok, ttok, language, shard, respaced, source_text, target_text, new_word, feeling, semitones,
      factor, act, 0 AS op_index, kind0 AS kind, f0 AS f, l0 AS l, f0 AS tf FROM cs
    UNION ALL
    SELECT case_id, uid, n, tok, ttok, language, shard, respaced, source_text, target_text, new_word, feeling, semitones,
      factor, act, 1, kind1, f1, l1,
      f1 + CASE kind0 WHEN 'ins' THEN 1 WHEN 'del' THEN f0 - l0 - 1 WHEN 'sub' THEN f0 - l0 ELSE 0 END
    FROM cs WHERE kind1 IS NOT NULL""",
    "cs",
)
cte(
    "ops",
    """SELECT *, CASE WHEN s_n = 0 THEN src_start ELSE src_start + length(body) END AS src_end,
      CASE WHEN t_n > 0 OR NOT respaced THEN t0 WHEN tf = 0 THEN 0 ELSE t0 - CASE WHEN tf < len(ttok) OR tf > 0 THEN 1 ELSE 0 END END AS tgt_start,
      CASE WHEN t_n > 0 THEN t0 + length(array_to_string(ttok[tf + 1 : tf + t_n], ' '))
        WHEN NOT respaced THEN t0 WHEN tf = 0 THEN 0 ELSE t0 - 1 END AS tgt_end
    FROM (SELECT *, length(array_to_string(tok[1 : f], ' ')) + CASE WHEN f > 0 THEN 1 ELSE 0 END AS src_start,
        length(array_to_string(ttok[1 : tf], ' ')) + CASE WHEN tf > 0 THEN 1 ELSE 0 END AS t0,
        array_to_string(tok[f + 1 : l + 1], ' ') AS body,
        CASE WHEN kind IN ('ins', 'pause') THEN 0 ELSE l - f + 1 END AS s_n,
        CASE WHEN kind IN ('ins', 'sub') THEN 1 WHEN kind IN ('del', 'pause') THEN 0 ELSE l - f + 1 END AS t_n,
        CASE kind WHEN 'sub' THEN new_word WHEN 'emo' THEN feeling WHEN 'pitch' THEN semitones
          WHEN 'rate' THEN factor WHEN 'pause' THEN act END AS param,
        CASE WHEN kind IN ('ins', 'del', 'sub') THEN 'text' WHEN kind = 'emo' THEN 'emotion'
          WHEN kind IN ('pitch', 'rate') THEN 'prosody' ELSE 'pause' END AS family,
        CASE kind WHEN 'ins' THEN 'insert' WHEN 'del' THEN 'delete' WHEN 'sub' THEN 'replace' WHEN 'pause' THEN act ELSE kind END AS operation
      FROM ops0)""",
    "ops0",
)
cte(
    "cats",
    """SELECT case_id, CASE WHEN min(family) <> max(family) THEN 'compositional' ELSE min(family) END AS category
    FROM ops GROUP BY case_id""",
    "ops",
)
# Units of both sides with character bounds and times in seconds; failed targets are silent.
cte(
    "src",
    """SELECT case_id, uid, n, ord, word, a, a + length(word) AS b, ord * 25 / 100::DOUBLE AS t0,
      (ord * 25 + CASE WHEN (uid + ord) % 17 = 0 THEN 0 ELSE 5 + (uid * 3 + ord * 5) % 15 END) / 100::DOUBLE AS t1
    FROM (SELECT case_id, uid, n, i AS ord, tok[i + 1] AS word,
        length(array_to_string(tok[1 : i], ' ')) + CASE WHEN i > 0 THEN 1 ELSE 0 END AS a
      FROM (SELECT *, unnest(range(0, n)) AS i FROM cs))""",
    "cs",
)
cte(
    "tgt_raw",
    """SELECT case_id, uid, status, m, ord, word, a, a + length(word) AS b, ord * 25 / 100::DOUBLE AS t0,
      (ord * 25 + CASE WHEN (uid * 5 + ord) % 19 = 0 THEN 0 ELSE 5 + (uid * 7 + ord * 11) % 15 END) / 100::DOUBLE AS t1
    FROM (SELECT case_id, uid, status, len(ttok) AS m, i AS ord, ttok[i + 1] AS word,
        length(array_to_string(ttok[1 : i], ' ')) + CASE WHEN i > 0 THEN 1 ELSE 0 END AS a
      FROM (SELECT *, unnest(range(0, len(ttok))) AS i FROM cs))""",
    "cs",
)
cte(
    "tgt",
    """SELECT * REPLACE (CASE WHEN status = 'ok' THEN t0 ELSE 0 END AS t0, CASE WHEN status = 'ok' THEN t1 ELSE 0 END AS t1)
    FROM tgt_raw""",
    "tgt_raw",
)
cte(
    "dur",
    """SELECT case_id, source_duration, CASE WHEN status = 'ok' THEN target_duration ELSE 0 END AS target_duration FROM cs""",
    "cs",
)
# Kept pairs: tokens outside every operation, plus those of the orthogonal kind.
cte(
    "tok_pairs",
    """SELECT s.case_id, s.ord AS i, s.ord + coalesce(sum(CASE WHEN o.kind IN ('ins', 'del', 'sub') AND s.ord >= o.f + o.s_n
          THEN o.t_n - o.s_n ELSE 0 END), 0) AS j,
      max(CASE WHEN s.ord >= o.f AND s.ord < o.f + o.s_n THEN o.kind END) AS owner
    FROM src s JOIN ops o ON o.case_id = s.case_id GROUP BY s.case_id, s.ord""",
    "src",
    "ops",
)
cte(
    "kept",
    """SELECT p.case_id, p.i, p.j, p.owner, s.word AS sw, s.t0 AS s0, s.t1 AS s1, t.word AS tw, t.t0, t.t1
    FROM tok_pairs p JOIN src s ON s.case_id = p.case_id AND s.ord = p.i JOIN tgt t ON t.case_id = p.case_id AND t.ord = p.j
    WHERE s.t1 > s.t0""",
    "tok_pairs",
    "src",
    "tgt",
)
cte(
    "frm",
    """SELECT case_id, side, k * 5 / 100::DOUBLE AS t, CAST(hz AS DOUBLE) AS hz FROM (
      SELECT case_id, 'source' AS side, k, CASE WHEN (uid + k // 25) % 6 = 0 THEN 0 ELSE 100 + (uid * 7 + k * 3) % 120 END AS hz
      FROM (SELECT case_id, uid, n, unnest(range(0, n * 5)) AS k FROM cs)
      UNION ALL
      SELECT case_id, 'target', k, CASE WHEN (uid + k // 25) % 7 = 0 THEN 0 ELSE 100 + (uid * 11 + k * 5) % 120 END
      FROM (SELECT case_id, uid, n, unnest(range(0, (n + 3) * 5)) AS k FROM cs))""",
    "cs",
)
cte(
    "spans",
    """SELECT s.case_id, 'source' AS side, ord, t0, least(t1, source_duration) AS t1, t1 >= source_duration - 1e-10 AS closed
      FROM src s JOIN dur d ON d.case_id = s.case_id WHERE t1 > t0
    UNION ALL
    SELECT t.case_id, 'target', ord, t0, least(t1, target_duration), t1 >= target_duration - 1e-10
      FROM tgt t JOIN dur d ON d.case_id = t.case_id WHERE t1 > t0""",
    "src",
    "tgt",
    "dur",
)
cte(
    "stats",
    """SELECT s.case_id, s.side, s.ord, min(hz) FILTER (hz > 0) AS lo, max(hz) FILTER (hz > 0) AS hi,
      avg(hz) FILTER (hz > 0) AS mean, median(hz) FILTER (hz > 0) AS median,
      count(*) AS frames, count(*) FILTER (hz > 0) AS voiced
    FROM spans s JOIN frm f ON f.case_id = s.case_id AND f.side = s.side AND f.t >= s.t0 - 1e-10
      AND CASE WHEN s.closed THEN f.t <= s.t1 + 1e-10 ELSE f.t < s.t1 - 1e-10 END
    GROUP BY ALL""",
    "spans",
    "frm",
)
cte(
    "times",
    """SELECT o.case_id, o.op_index, o.kind, o.param, o.operation,
      CASE WHEN o.s_n > 0 THEN min(s.t0) FILTER (s.a >= o.src_start AND s.b <= o.src_end)
        ELSE coalesce(max_by(s.t1, s.ord) FILTER (s.b <= o.src_start), 0) END AS ss,
      CASE WHEN o.s_n > 0 THEN max_by(s.t1, s.ord) FILTER (s.a >= o.src_start AND s.b <= o.src_end)
        ELSE coalesce(min_by(s.t0, s.ord) FILTER (s.a >= o.src_start), any_value(d.source_duration)) END AS se
    FROM ops o JOIN src s ON s.case_id = o.case_id JOIN dur d ON d.case_id = o.case_id
    WHERE o.family <> 'text' GROUP BY o.case_id, o.op_index, o.kind, o.param, o.operation, o.s_n""",
    "ops",
    "src",
    "dur",
)
cte(
    "ttimes",
    """SELECT o.case_id, o.op_index,
      CASE WHEN o.t_n > 0 THEN min_by(t.t0, t.ord) FILTER (t.a >= o.tgt_start AND t.b <= o.tgt_end)
        ELSE coalesce(max_by(t.t1, t.ord) FILTER (t.b <= o.tgt_start), 0) END AS ts,
      CASE WHEN o.t_n > 0 THEN max_by(t.t1, t.ord) FILTER (t.a >= o.tgt_start AND t.b <= o.tgt_end)
        ELSE coalesce(min_by(t.t0, t.ord) FILTER (t.a >= o.tgt_start), any_value(d.target_duration)) END AS te,
      coalesce(max_by(t.t1 > t.t0, t.ord) FILTER (t.b <= o.tgt_start), true)
        AND coalesce(min_by(t.t1 > t.t0, t.ord) FILTER (t.a >= o.tgt_start), true) AS anchored
    FROM ops o JOIN tgt t ON t.case_id = o.case_id JOIN dur d ON d.case_id = o.case_id
    WHERE o.family <> 'text' GROUP BY o.case_id, o.op_index, o.t_n""",
    "ops",
    "tgt",
    "dur",
)
