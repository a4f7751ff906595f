"""SQL (DuckDB's dialect) for the training-data operators whose rows SQL can give on whole tables."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from tidewater.llm import quality
from tidewater.llm.skeleton import consistent

SPACE = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@lru_cache(1)
def _one_by_one() -> tuple[str, str, str, dict[str, str]]:
    """Characters that become one other character and those, characters that vanish, and those that become several."""
    one, to, gone, many = [], [], [], {}
    for c in range(0x80, sys.maxunicode + 1):
        ch = chr(c)
        if unicodedata.category(ch) in ("Cs", "Cn", "Co"):
            continue
        shown = consistent(ch)
        if shown == unicodedata.normalize("NFC", ch):
            continue
        if len(shown) == 1:
            one.append(ch)
            to.append(shown)
        elif shown:
            many[ch] = shown
        else:
            gone.append(ch)
    return "".join(one), "".join(to), "".join(gone), many


def same_text(t: str) -> str:
    """The consistent form of a text: characters are replaced one by one, then composed."""
    one, to, gone, many = _one_by_one()
    several = "MAP {" + ", ".join(f"{_q(a)}: {_q(b)}" for a, b in many.items()) + "}"
    spelled = f"array_to_string(list_transform(regexp_extract_all({t}, '(?s).'), lambda ch: coalesce(CASE WHEN ch > '~' THEN ({several})[ch] END, ch)), '')"
    return f"nfc_normalize(translate({spelled}, {_q(one + gone)}, {_q(to)}))"


CONSISTENT = f"""WITH turns AS (SELECT 'hinglish_spot_check' AS tbl, line_no AS rec_no, i::INTEGER AS turn_no, turns[i].text AS text FROM (SELECT *, unnest(generate_series(1, len(turns))) AS i FROM hinglish_spot_check)
      UNION ALL SELECT 'testcases', case_no, i::INTEGER, turns[i].text FROM (SELECT *, unnest(generate_series(1, len(turns))) AS i FROM testcases))
    SELECT tbl, rec_no, turn_no, {same_text("text")} AS text FROM turns"""

_VARIANTS = f"""WITH r AS (SELECT 'hinglish_spot_check' AS tbl, line_no AS rec, list_transform(turns, lambda x: x.text) AS t FROM hinglish_spot_check
      UNION ALL SELECT 'testcases', case_no, list_transform(turns, lambda x: x.text) FROM testcases),
    k AS (SELECT tbl, rec, coalesce(to_json(t)::VARCHAR, '') AS v, coalesce(to_json(list_transform(t, lambda x: {same_text("x")}))::VARCHAR, '') AS s FROM r)
    """
PAIRS = _VARIANTS + "SELECT a.tbl, a.rec AS rec_a, b.rec AS rec_b FROM k a JOIN k b ON a.tbl = b.tbl AND a.s = b.s AND a.v <> b.v AND a.rec < b.rec"
CLASSES = _VARIANTS + """SELECT tbl, rec, min(rec) OVER (PARTITION BY tbl, s) AS class_rec, min(rec) OVER (PARTITION BY tbl, s, v) AS variant_rec,
      count(*) OVER (PARTITION BY tbl, s) - count(*) OVER (PARTITION BY tbl, s, v) AS links FROM k"""

_BARE = "regexp_replace(regexp_replace({}, '^[^\\p{{L}}\\p{{N}}]+', ''), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+$', '')"
_GROUPS = f"""WITH RECURSIVE x AS (SELECT line_no, unnest(list_concat(list_transform(coalesce(turns, []), lambda t: t.text), coalesce(label.options, []))) AS t FROM hinglish_spot_check),
    w AS (SELECT line_no, list_filter(list_transform(regexp_split_to_array(lower({same_text("t")}), '{SPACE}+'), lambda x: {_BARE.format("x")}), lambda x: x <> '') AS w FROM x WHERE t IS NOT NULL),
    n AS (SELECT line_no FROM w GROUP BY line_no HAVING sum(len(w)) >= 12),
    p AS (SELECT line_no, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT line_no, w, unnest(generate_series(1, len(w) - 1)) AS i FROM w WHERE line_no IN (SELECT line_no FROM n))),
    c AS (SELECT line_no, pair, count(*) AS c FROM p GROUP BY ALL), s AS (SELECT line_no, sum(c) AS n FROM c GROUP BY 1),
    j AS (SELECT a.line_no AS a, b.line_no AS b, sum(least(a.c, b.c)) AS shared FROM c a JOIN c b ON a.pair = b.pair AND a.line_no < b.line_no GROUP BY ALL),
    l AS (SELECT a, b FROM j JOIN s x ON x.line_no = a JOIN s y ON y.line_no = b WHERE 10 * shared >= 4 * (x.n + y.n)),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT DISTINCT a AS n, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON r.n = e.a),
    g AS (SELECT n AS line_no, min(m) AS group_id FROM r GROUP BY n)
    """
NEAR = _GROUPS + "SELECT group_id AS line_a, line_no AS line_b FROM g WHERE group_id <> line_no"
NEAR_GROUPS = _GROUPS + """, f AS (SELECT line_no, string_agg(pair || c, chr(10) ORDER BY pair, c) AS f FROM c GROUP BY 1)
    SELECT line_no AS id, min(line_no) OVER (PARTITION BY f) AS copy_of, coalesce(group_id, line_no) AS group_id FROM f LEFT JOIN g USING (line_no)"""

_COMMON = "[" + ", ".join(_q(w) for w in sorted(quality.COMMON)) + "]"
_LANGUAGE = "lower(string_split_regex(trim(coalesce(lang, '')), '[-_]')[1])"
_COUNTS = f"""WITH d AS (SELECT doc_id, CASE WHEN {_LANGUAGE} IN ('', 'unknown', 'und') THEN 'und' ELSE {_LANGUAGE} END AS lang_key, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '{SPACE}+'), lambda x: x <> '') AS tok,
          list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|\\r|\\n'), lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: x <> '') AS lines FROM d),
    b AS (SELECT *, list_transform(list_filter(regexp_split_to_array(lower(t), '{SPACE}+'), lambda x: x <> ''), lambda x: {_BARE.format("x")}) AS words FROM w),
    s AS (SELECT doc_id, lang_key, length(t) AS n_chars, len(words)::INTEGER AS n_words, len(lines)::INTEGER AS n_lines,
          CASE WHEN len(words) > 0 THEN list_sum(list_transform(words, lambda x: length(x))) / len(words)::DOUBLE END AS mean_word_len,
          CASE WHEN length(t) > 0 THEN len(regexp_extract_all(t, '\\p{{Nd}}')) / length(t)::DOUBLE END AS digit_ratio,
          CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda x: regexp_matches(x, '{quality.SENTENCE_END.pattern.replace("'", "''")}'))) / len(lines)::DOUBLE END AS end_punct_share,
          CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda x: list_contains({_COMMON}, x))) / len(words)::DOUBLE END AS common_share,
          len(list_distinct(words))::INTEGER AS distinct_words, coalesce(list_max(list_transform(tok, lambda x: length(x))), 0)::INTEGER AS longest_word FROM b)
    """
COUNTED = ("n_chars", "n_words", "n_lines", "mean_word_len", "digit_ratio", "end_punct_share", "common_share", "distinct_words", "longest_word")
COUNTS = _COUNTS + f"SELECT doc_id, lang_key, {', '.join(COUNTED)} FROM s"
RANKED = ("mean_word_len", "digit_ratio", "end_punct_share", "common_share", "distinct_words", "longest_word")


def _steps(stat: str) -> str:
    t = quality.TELLS[stat]
    at = lambda v: f"floor({v} / {t.step}::DOUBLE + 1e-9)"
    return f"least(greatest(({at(f'coalesce({stat}::DOUBLE, {t.ordinary}::DOUBLE)')} - {at(f'{t.ordinary}::DOUBLE')}) * {t.sign}, 0), {quality.FAR})::INTEGER"


TAILS = (
    _COUNTS
    + f""", g AS (SELECT lang_key, CASE WHEN count(*) >= {quality.POOL_BELOW} THEN lang_key ELSE '*' END AS grp FROM s GROUP BY 1),
      v AS (SELECT grp, unnest([{", ".join(f"{{'stat': '{x}', 'value': {_steps(x)}}}" for x in RANKED)}]) AS x FROM s JOIN g USING (lang_key)),
      c AS (SELECT x.stat AS stat, grp, x.value AS "value", count(*) AS n FROM v GROUP BY ALL)
      SELECT stat, grp, "value", sum(n) OVER (PARTITION BY stat, grp ORDER BY "value" DESC) / (sum(n) OVER (PARTITION BY stat, grp))::DOUBLE AS tail FROM c"""
)
