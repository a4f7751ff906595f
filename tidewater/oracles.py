"""SQL for another engine (DuckDB's dialect) that gives the rows of the text and state operators.

It shares the fixed values with the operators and nothing else: no lookbehind and no fold over sessions, but token
lists and a recursion over each sender's whole timeline.
"""

from __future__ import annotations

import json

from tidewater import constants as K
from tidewater.functions.text import unicode_folds

SPACE = r"[\t-\r\x1c-\x20]"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sanitized(t: str) -> str:
    one, to, many = unicode_folds()
    t = f"replace(replace(regexp_replace({t}, '[\\x{{200B}}-\\x{{200F}}\\x{{FEFF}}]', '', 'g'), '—', '  '), '–', ' - ')"
    t = f"translate({t}, {quoted(one)}, {quoted(to)})"
    several = "MAP {" + ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in json.loads(many).items()) + "}"
    spelled = f"array_to_string(list_transform(regexp_extract_all({t}, '(?s).'), lambda ch: coalesce(({several})[ch], ch)), '')"
    return f"regexp_replace({spelled}, '[^\\x00-\\x7F]', '', 'g')"


def isolated_joined(t: str) -> str:
    """Whitespace goes where a word of one letter or digit stands on both sides."""
    tokens = f"regexp_extract_all({t}, '{SPACE}+|[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\t-\\r\\x1c-\\x20\\p{{L}}\\p{{M}}\\p{{N}}_]+')"
    single = lambda i: f"regexp_full_match(coalesce(x[{i}], ''), '[a-zA-Z0-9]')"
    kept = f"CASE WHEN {single('i - 1')} AND {single('i + 1')} AND regexp_full_match(x[i], '{SPACE}+') THEN '' ELSE x[i] END"
    return f"(SELECT array_to_string(list_transform(generate_series(1, len(x)), lambda i: {kept}), '') FROM (SELECT {tokens} AS x))"


def paths_joined(t: str) -> str:
    t = f"regexp_replace({t}, '{SPACE}*/{SPACE}*', '/', 'g')"
    for _ in range(2):  # neighbouring dots share a letter, so every other one is left for a second pass
        t = f"regexp_replace({t}, '([a-zA-Z0-9])(?:{SPACE}+\\.{SPACE}*|\\.{SPACE}+)([a-zA-Z0-9])', '\\1.\\2', 'g')"
    return t


def flattened(t: str) -> str:
    return f"trim(regexp_replace({t}, '{SPACE}+', ' ', 'g'))"


def digits_for_words(t: str) -> str:
    words = "[" + ", ".join(quoted(w) for w in K.NUMBER_WORDS) + "]"
    leet = f"translate(lower(k), '{K.LEET_DIGITS}', '{K.LEET_LETTERS}')"
    at = lambda x: f"coalesce(list_position({words}, {x}), 0)"
    near = f"list_filter({words}, lambda w: levenshtein({leet}, w) = 1 AND length({leet}) <> length(w) AND ((length(w) = 4 AND length({leet}) = 5) OR length(w) = 5))"
    one = f"""CASE WHEN NOT regexp_full_match(k, '[A-Za-z0-9]+') THEN k WHEN {at("lower(k)")} > 0 THEN ({at("lower(k)")} - 1)::VARCHAR
        WHEN regexp_full_match(k, '[0-9]+') OR length(k) NOT BETWEEN 3 AND 7 THEN k WHEN {at(leet)} > 0 THEN ({at(leet)} - 1)::VARCHAR
        WHEN len({near}) > 0 THEN ({at(f"({near})[1]")} - 1)::VARCHAR ELSE k END"""
    return f"array_to_string(list_transform(regexp_extract_all({t}, '[a-zA-Z0-9_]+|[^a-zA-Z0-9_]+'), lambda k: {one}), '')"


def verbal_signs(t: str) -> str:
    t = f"regexp_replace({t}, '[\\s\\[\\(\\{{<]*({K.AT_WORDS})[\\s\\]\\)\\}}>]+', '@', 'gi')"
    t = f"regexp_replace({t}, '[\\s\\[\\(\\{{<]*({K.DOT_WORDS})[\\s\\]\\)\\}}>]+', '.', 'gi')"
    return f"regexp_replace(regexp_replace({t}, '{SPACE}*@{SPACE}*', '@', 'g'), '{SPACE}*\\.{SPACE}*', '.', 'g')"


def _spans(pattern: str, kind: str) -> str:
    """Spans of all matches in column `c`: a mark that ASCII text cannot hold stands for each, so the texts between the
    marks and the matches before give the offsets."""
    match, gaps = f"regexp_extract_all(c, {quoted(pattern)})", f"string_split(regexp_replace(c, {quoted(pattern)}, '¤', 'g'), '¤')"
    length = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
    start = f"({length('g[1:i]')} + {length('v[1:i - 1]')})::INTEGER"
    return f"(SELECT list_transform(generate_series(1, len(v)), lambda i: {{'kind': '{kind}', 'a': {start}, 'b': ({start} + length(v[i]))::INTEGER}}) FROM (SELECT {match} AS v, {gaps} AS g))"


def phase1(source: str, carry: str, text: str, variant: str = "pipeline", prefix: str = "n") -> str:
    """CTEs over `source` that end in `{prefix}_done` with the columns `carry`, spans and final_text."""
    p = prefix
    step = lambda name, of, f: f"{name} AS MATERIALIZED (SELECT {carry}, {f('c')} AS c FROM {of})"
    ctes = [f"{p}_0 AS MATERIALIZED (SELECT {carry}, {sanitized(text)} AS c FROM {source})"]
    ctes += [step(f"{p}_1", f"{p}_0", isolated_joined), step(f"{p}_2", f"{p}_1", lambda c: flattened(paths_joined(c))), step(f"{p}_3", f"{p}_2", digits_for_words)]
    ctes.append(step(f"{p}_4", f"{p}_3", isolated_joined if variant == "pipeline" else lambda c: c))
    ctes.append(step(f"{p}_5", f"{p}_4", verbal_signs))
    ctes.append(f"{p}_6 AS MATERIALIZED (SELECT {carry}, c, {_spans(K.EMAIL, 'EMAIL')} AS mails, {_spans(K.URL[variant], 'URL')} AS urls FROM {p}_5)")
    more = f"length(regexp_extract(substring(c, u.b + 1, 60), {quoted(K.PATH_CONTINUATION)}))" if variant == "pipeline" else "0"
    ctes.append(f"""{p}_7 AS MATERIALIZED (SELECT {carry}, c, CASE WHEN c IS NOT NULL THEN list_concat(mails, list_transform(
        list_filter(urls, lambda u: len(list_filter(mails, lambda m: m.a <= u.a AND u.a < m.b)) = 0),
        lambda u: {{'kind': u.kind, 'a': u.a, 'b': (u.b + {more})::INTEGER}})) END AS spans FROM {p}_6)""")
    # spliced from the last start to the first; of equal starts the one listed first comes first
    piece = "{'k': -s.a, 'i': i, 't': '', 'a': s.a, 'b': s.b, 'kind': s.kind}"
    order = f"list_sort(list_transform(spans, lambda s, i: {piece}))"
    whole = "[{'k': 0, 'i': 0::BIGINT, 't': c, 'a': 0, 'b': 0, 'kind': ''}]"
    splice = f"list_reduce(list_concat({whole}, {order}), lambda t, s: {{'k': 0, 'i': 0::BIGINT, 't': substring(t.t, 1, s.a) || '[REDACTED_' || s.kind || ']' || substring(t.t, s.b + 1), 'a': 0, 'b': 0, 'kind': ''}}).t"
    ctes.append(f"{p}_done AS MATERIALIZED (SELECT {carry}, c AS canonical, spans, replace(CASE WHEN len(spans) = 0 THEN c ELSE {splice} END, '@', ' at ') AS final_text FROM {p}_7)")
    return ",\n".join(ctes)


def spans_text(spans: str = "spans", c: str = "canonical") -> str:
    """Spans as one text: TYPE:start-end:value, joined by line breaks."""
    return f"array_to_string(list_transform({spans}, lambda s: s.kind || ':' || s.a || '-' || s.b || ':' || substring({c}, s.a + 1, s.b - s.a)), chr(10))"


_KW = lambda words: " + ".join(f"(contains(lower(t), '{w}'))::INT" for w in words)
PLATFORM = "(" + " OR ".join(f"contains(lower({{0}}), '{w}')" for w in K.PLATFORM_KEYWORDS) + ")"


def features(source: str, carry: str, text: str) -> str:
    """SELECT of `carry`, the text as t and the features that need no history."""
    return f"""SELECT {carry}, t AS final_text,
      coalesce(list_max(list_transform(regexp_extract_all(t, '[0-9]+'), lambda x: length(x))), 0)::INTEGER AS max_digit_run,
      regexp_replace(t, '[^0-9]', '', 'g') AS digits, length(regexp_replace(t, '[^0-9]', '', 'g')) / greatest(length(t), 1)::DOUBLE AS digit_density,
      greatest(0::DOUBLE, least(1::DOUBLE, 0.5::DOUBLE + 0.15::DOUBLE * ({_KW(K.CONTACT_KEYWORDS)}) - 0.15::DOUBLE * ({_KW(K.QUANTITY_KEYWORDS)}))) AS contact_kw_score,
      CASE WHEN regexp_matches(t, '[0-9]{{3}}[-\\s]?[0-9]{{3}}[-\\s]?[0-9]{{4}}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pattern_score,
      CASE WHEN NOT regexp_matches(t, '{K.DOMAIN}') THEN 0.0::DOUBLE WHEN regexp_matches(t, '(?s){K.DOMAIN}.{{0,38}}/\\S') THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS link_suspicion_score,
      {PLATFORM.format("t")} AS platform,
      regexp_full_match(regexp_replace(t, '^{SPACE}+|{SPACE}+$', '', 'g'), '[\\w.]{{3,20}}') AND NOT {PLATFORM.format("t")} AS handle
      FROM (SELECT *, {text} AS t FROM {source})"""


def state_machine(source: str) -> str:
    """CTEs over `source` (skey, room, at_us in microseconds or null, msg_id, speaker and the features), which step every
    sender's timeline one message at a time; they end in `decided`."""
    s = 1_000_000
    parts = {"run": "least(max_digit_run / 10.0::DOUBLE, 1.0::DOUBLE)", "contact": "contact_kw_score", "pattern": "pattern_score", "history": "hist", "link": "link_suspicion_score", "platform": "plat"}
    raw = " + ".join(f"{w}::DOUBLE * {parts[n]}" for n, w in K.WEIGHTS)
    turn = "STRUCT(p BOOLEAN, h BOOLEAN)[]"
    room = f"STRUCT(room VARCHAR, digits VARCHAR, digits_at BIGINT, turns {turn}, turns_at BIGINT)"
    options = ", ".join(quoted(x) for x in ("please keep the ", " turns here", "let us talk in the app", "happy to answer right here"))
    opt = options.split(", ")
    return f"""line AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY at_us, msg_id) AS k FROM {source}),
    walk AS (
      SELECT skey, 0::BIGINT AS k, 0 AS susp, 0::BIGINT AS susp_at, []::{room}[] AS rooms, NULL::DOUBLE AS hist, NULL::DOUBLE AS plat, NULL::INTEGER AS score,
             NULL::VARCHAR AS tier, NULL::BOOLEAN AS ask, NULL::BOOLEAN AS third, 0::BIGINT AS seen FROM (SELECT DISTINCT skey FROM line)
      UNION ALL
      SELECT skey, k, susp, susp_at,
             list_append(list_filter(rooms, lambda x: x.room <> m_room), {{'room': m_room,
               'digits': CASE WHEN m_digits = '' THEN kept ELSE right(kept || m_digits, {K.DIGITS_KEPT}) END, 'digits_at': CASE WHEN m_digits = '' THEN kept_at ELSE m_at END,
               'turns': list_append(kept_turns, {{'p': m_platform, 'h': m_handle}})[-{K.TURNS_KEPT}:], 'turns_at': m_at}}::{room}) AS rooms,
             hist, plat, score, tier, ask, third, seen
      FROM (SELECT *, CASE WHEN ask THEN '' ELSE old_digits END AS kept, CASE WHEN ask THEN []::{turn} ELSE old_turns END AS kept_turns
        FROM (SELECT * REPLACE (CASE WHEN tier = 'moderate' THEN CASE WHEN alive THEN susp ELSE 0 END + 1 ELSE susp END AS susp, CASE WHEN tier = 'moderate' AND NOT alive THEN m_at ELSE susp_at END AS susp_at),
                     tier = 'moderate' AND alive AND susp + 1 >= {K.SUSPICION_ESCALATES} AS third, tier = 'high' OR (tier = 'moderate' AND alive AND susp + 1 >= {K.SUSPICION_ESCALATES}) AS ask
          FROM (SELECT *, CASE WHEN score < {K.LOW_BELOW} THEN 'low' WHEN score < {K.HIGH_FROM} THEN 'moderate' ELSE 'high' END AS tier, susp > 0 AND m_at - susp_at < {K.SUSPICION_TTL * s} AS alive
            FROM (SELECT *, least(100, CASE WHEN hist >= {K.HISTORY_FLOOR_AT}::DOUBLE OR plat >= {K.PLATFORM_FLOOR_AT}::DOUBLE THEN greatest({K.FLOOR}, points) ELSE points END) AS score
              FROM (SELECT *, round_even(({raw}) * 100, 0)::INTEGER AS points
                FROM (SELECT *, least((length(old_digits) + length(m_digits)) / {K.HISTORY_DIGITS}.0::DOUBLE, 1.0::DOUBLE) AS hist, len(old_turns) AS seen,
                             CASE WHEN len(old_turns) = 0 THEN 0.0::DOUBLE WHEN any_p AND any_h THEN 1.0::DOUBLE WHEN any_p OR any_h THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS plat
                  FROM (SELECT *, m_platform OR len(list_filter(old_turns, lambda x: x.p)) > 0 AS any_p, m_handle OR len(list_filter(old_turns, lambda x: x.h)) > 0 AS any_h
                    FROM (SELECT *, CASE WHEN mine IS NOT NULL AND m_at - mine.digits_at < {K.DIGIT_TTL * s} THEN mine.digits ELSE '' END AS old_digits, coalesce(mine.digits_at, 0) AS kept_at,
                                 CASE WHEN mine IS NOT NULL AND m_at - mine.turns_at < {K.TURN_TTL * s} THEN mine.turns ELSE []::{turn} END AS old_turns
                      FROM (SELECT l.skey, l.k, susp, susp_at, rooms, list_filter(rooms, lambda x: x.room = l.room)[1] AS mine, l.room AS m_room, coalesce(l.at_us, 0) AS m_at, l.digits AS m_digits,
                                   l.platform AS m_platform, l.handle AS m_handle, l.max_digit_run, l.contact_kw_score, l.pattern_score, l.link_suspicion_score
                            FROM walk w JOIN line l ON l.skey = w.skey AND l.k = w.k + 1)))))))))),
    decided AS (
      SELECT l.*, w.hist AS history_score, w.plat AS cross_turn_platform_score, w.score, w.tier, CASE WHEN ask THEN 'high' ELSE w.tier END AS logged_tier,
             CASE WHEN ask THEN 'llm_escalation' WHEN w.tier = 'moderate' THEN 'soft_mask' ELSE 'pass' END AS action, CASE WHEN third THEN 'escalated_by_suspicion' END AS reason,
             CASE WHEN ask THEN {opt[0]} || (seen + 1) || {opt[1]} || ' | ' || {opt[2]} || ' | ' || {opt[3]} END AS options, CASE WHEN ask THEN third END AS escalated_from_suspicion
      FROM walk w JOIN line l ON l.skey = w.skey AND l.k = w.k)"""


def soft_masked(t: str, platform: str, run: str, history: str) -> str:
    hidden = f"CASE WHEN regexp_full_match(x, '[\\w.]{{3,20}}') AND NOT {PLATFORM.format('x')} THEN repeat('█', length(x)) ELSE x END"
    names = f"CASE WHEN {platform} >= 0.2::DOUBLE THEN array_to_string(list_transform(regexp_extract_all({t}, '\\S+|\\s+'), lambda x: {hidden}), '') ELSE {t} END"
    return f"CASE WHEN {run} > 0 OR {history} > 0 THEN regexp_replace({names}, '[0-9]', '█', 'g') ELSE {names} END"


#: Messages once each, by the earliest receipt, with the key under which they share state.
DELIVERED = """once AS (SELECT * FROM messages WHERE msg_id IS NULL UNION ALL BY NAME SELECT * EXCLUDE (n) FROM (
      SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY received_at NULLS LAST, ts NULLS LAST, room_id NULLS FIRST, sender_id NULLS FIRST, speaker NULLS FIRST, text NULLS FIRST) AS n
      FROM messages WHERE msg_id IS NOT NULL) WHERE n = 1)"""
#: A suite's turns as messages, a second apart, each case under its own room and sender.
SUITE = """once AS (SELECT case_no, category, i::INTEGER AS turn, 'testcase_room_' || concat_ws('_', id, case_no) AS room_id, 'testcase_sender_' || concat_ws('_', id, case_no) AS sender_id,
      concat_ws('_', id, case_no) || '_turn_' || i AS msg_id, t.speaker AS speaker, t.text AS text, make_timestamp((1767225600 + i) * 1000000) AS ts
      FROM (SELECT *, turns[i] AS t FROM (SELECT *, unnest(generate_series(1, len(turns))) AS i FROM testcases)))"""


def decisions(source: str, carry: str = "room_id, sender_id, msg_id, speaker, text, ts") -> str:
    """WITH clause whose `decided` holds every message's features and decision; `source` defines `once`."""
    return f"""WITH RECURSIVE {source},
    {phase1("once", carry, "coalesce(text, '')")},
    feats AS ({features("n_done", carry, "final_text")}),
    keyed AS (SELECT * EXCLUDE (text) REPLACE (lower(trim(speaker)) AS speaker), coalesce(room_id, 'None') AS room, epoch_us(ts) AS at_us,
      CASE WHEN ts IS NULL THEN 'x' || row_number() OVER () ELSE coalesce('s' || sender_id, 'r' || coalesce(room_id, '')) END AS skey FROM feats),
    {state_machine("keyed")}"""
