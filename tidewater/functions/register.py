"""SQL names for the text and scoring functions: temporary SQL functions whose bodies are built-in expressions.

The bodies are written in SQL beside the Column forms (tests hold them equal), so nothing depends on how Spark prints
or stores its expressions. Functions call each other, so an argument that is used several times is computed once.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidewater import constants as K
from tidewater.functions.text import unicode_folds

SPACE = r"[\s\x1c-\x1f]"
SPAN = "STRUCT<type: STRING, start: INT, end: INT, value: STRING, confidence: STRING>"


def _q(s: str) -> str:
    """A raw literal; quotes of either kind inside are joined on."""
    return "concat(" + ", \"'\", ".join(f"r'{x}'" for x in s.split("'")) + ")" if "'" in s else f"r'{s}'"


def _array(words: list[str]) -> str:
    return "array(" + ", ".join(_q(w) for w in words) + ")"


def _present(words: list[str]) -> str:
    return " + ".join(f"cast(contains(lower(t), {_q(w)}) AS INT)" for w in words)


def _spans(pattern: str, kind: str) -> str:
    start = f"named_struct('pos', 0, 'spans', cast(array() AS ARRAY<{SPAN}>))"
    at = "locate(v, t, acc.pos + 1) - 1"
    span = f"named_struct('type', '{kind}', 'start', {at}, 'end', {at} + length(v), 'value', v, 'confidence', 'high')"
    step = f"named_struct('pos', {at} + length(v), 'spans', array_append(acc.spans, {span}))"
    return f"aggregate(regexp_extract_all(t, {_q(pattern)}, 0), {start}, (acc, v) -> {step}).spans"


def bodies() -> list[tuple[str, str, str, str]]:
    """(name, parameters, type, body) in an order in which each uses only those before it."""
    one, to, many = unicode_folds()
    leet = f"translate(lower(k), '{K.LEET_DIGITS}', '{K.LEET_LETTERS}')"
    words = _array(K.NUMBER_WORDS)
    near = f"transform({words}, w -> levenshtein({leet}, w) = 1 AND length({leet}) <> length(w) AND ((length(w) = 4 AND length({leet}) = 5) OR length(w) = 5))"
    digit = f"""CASE WHEN NOT k RLIKE '^[A-Za-z0-9]+$' THEN k WHEN array_position({words}, lower(k)) > 0 THEN cast(array_position({words}, lower(k)) - 1 AS STRING)
        WHEN lower(k) RLIKE '^[0-9]+$' OR length(k) NOT BETWEEN 3 AND 7 THEN k WHEN array_position({words}, {leet}) > 0 THEN cast(array_position({words}, {leet}) - 1 AS STRING)
        WHEN array_position({near}, true) > 0 THEN cast(array_position({near}, true) - 1 AS STRING) ELSE k END"""
    spelled = f"array_join(transform(split(folded, ''), ch -> coalesce(element_at(from_json({_q(many)}, 'map<string,string>'), ch), ch)), '')"
    folded = f"translate(replace(replace(regexp_replace(t, '[​-‏﻿]', ''), '—', '  '), '–', ' - '), {_q(one)}, {_q(to)})"
    domain = _q(K.DOMAIN)
    platforms = f"exists({_array(K.PLATFORM_KEYWORDS)}, p -> contains(lower({{}}), p))"
    weights = dict(K.WEIGHTS)
    parts = {"run": "least(run / 10D, 1D)", "contact": "contact", "pattern": "pattern", "history": "history", "link": "link", "platform": "platform"}
    raw = " + ".join(f"{weights[n]}D * {parts[n]}" for n, _ in K.WEIGHTS)
    at = rf"(?i)[\s\[\(\{{<]*({K.AT_WORDS})[\s\]\)\}}>]+"
    dot = rf"(?i)[\s\[\(\{{<]*({K.DOT_WORDS})[\s\]\)\}}>]+"
    extend = f"""named_struct('type', u.type, 'start', u.start, 'end', u.end + length(regexp_extract(substring(t, u.end + 1, 60), {_q(K.PATH_CONTINUATION)}, 0)),
        'value', substring(t, u.start + 1, u.end - u.start + length(regexp_extract(substring(t, u.end + 1, 60), {_q(K.PATH_CONTINUATION)}, 0))), 'confidence', u.confidence)"""
    free = "filter(urls, u -> NOT exists(mails, m -> m.start <= u.start AND u.start < m.end))"
    order = "array_sort(transform(spans, (s, i) -> named_struct('k', -s.start, 'i', i, 's', s)))"
    splice = "concat(substring(acc, 1, x.s.start), '[REDACTED_', x.s.type, ']', substring(acc, x.s.end + 1, length(acc)))"
    hide = f"CASE WHEN k RLIKE {_q(K.BARE_HANDLE)} AND NOT {platforms.format('k')} THEN repeat('█', length(k)) ELSE k END"
    t = "t STRING"
    return [
        ("flatten_whitespace", t, "STRING", f"trim(regexp_replace(t, {_q(SPACE + '+')}, ' '))"),
        ("despace_isolated", t, "STRING", rf"regexp_replace(t, r'(?<=\b[a-zA-Z0-9]){SPACE}+(?=[a-zA-Z0-9]\b)', '')"),
        ("despace_paths", t, "STRING", rf"regexp_replace(regexp_replace(t, r'{SPACE}*/{SPACE}*', '/'), r'(?<=[a-zA-Z0-9]){SPACE}*\.{SPACE}*(?=[a-zA-Z0-9])', '.')"),
        ("spell_folded", "folded STRING", "STRING", f"regexp_replace({spelled}, r'[^\\x00-\\x7F]', '')"),
        ("sanitize_unicode", t, "STRING", f"CASE WHEN t RLIKE r'[^\\x00-\\x7F]' THEN spell_folded({folded}) ELSE t END"),
        ("words_to_digits", t, "STRING", f"array_join(transform(regexp_extract_all(t, r'(\\w+|\\W+)', 1), k -> {digit}), '')"),
        ("substitute_verbal", t, "STRING", rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, {_q(at)}, '@'), {_q(dot)}, '.'), r'{SPACE}*@{SPACE}*', '@'), r'{SPACE}*\.{SPACE}*', '.')"),
        ("revert_verbal", t, "STRING", "replace(t, '@', ' at ')"),
        ("normalize_text", t, "STRING", "substitute_verbal(despace_isolated(words_to_digits(flatten_whitespace(despace_paths(despace_isolated(sanitize_unicode(t)))))))"),
        ("email_spans", t, f"ARRAY<{SPAN}>", _spans(K.EMAIL, "EMAIL")),
        ("url_spans", t, f"ARRAY<{SPAN}>", _spans(K.URL["pipeline"], "URL")),
        ("joined_spans", f"t STRING, mails ARRAY<{SPAN}>, urls ARRAY<{SPAN}>", f"ARRAY<{SPAN}>", f"concat(mails, transform({free}, u -> {extend}))"),
        ("canonical_spans", t, f"ARRAY<{SPAN}>", "joined_spans(t, email_spans(t), url_spans(t))"),
        ("detect_spans", t, f"ARRAY<{SPAN}>", "canonical_spans(normalize_text(t))"),
        ("mask_spans", f"t STRING, spans ARRAY<{SPAN}>", "STRING", f"aggregate({order}, t, (acc, x) -> {splice})"),
        ("redact_canonical", t, "STRING", "revert_verbal(mask_spans(t, canonical_spans(t)))"),
        ("redact", t, "STRING", "redact_canonical(normalize_text(t))"),
        ("contact_kw_score", t, "DOUBLE", f"greatest(0D, least(1D, 0.5D + 0.15D * ({_present(K.CONTACT_KEYWORDS)}) - 0.15D * ({_present(K.QUANTITY_KEYWORDS)})))"),
        ("risk_pattern_score", t, "DOUBLE", f"CASE WHEN t RLIKE {_q(K.PHONE_SHAPE)} THEN 1D ELSE 0D END"),
        ("link_suspicion_score", t, "DOUBLE", f"CASE WHEN t RLIKE {_q(K.DOMAIN + '(?=(?s:.{0,38})/' + chr(92) + 'S)')} THEN 1D WHEN t RLIKE {domain} THEN 0.3D ELSE 0D END"),
        ("floored_score", "s INT, history DOUBLE, platform DOUBLE", "INT", f"least(CASE WHEN history >= {K.HISTORY_FLOOR_AT}D OR platform >= {K.PLATFORM_FLOOR_AT}D THEN greatest(s, {K.FLOOR}) ELSE s END, 100)"),
        (
            "risk_score", "run INT, contact DOUBLE, pattern DOUBLE, history DOUBLE, link DOUBLE, platform DOUBLE", "INT",
            f"CASE WHEN run + contact + pattern + history + link + platform IS NOT NULL THEN floored_score(cast(rint(({raw}) * 100) AS INT), history, platform) END",
        ),
        ("risk_tier", "s INT", "STRING", f"CASE WHEN s < {K.LOW_BELOW} THEN 'low' WHEN s < {K.HIGH_FROM} THEN 'moderate' WHEN s IS NOT NULL THEN 'high' END"),
        ("mask_digits", t, "STRING", r"regexp_replace(t, r'(?U)\d', '█')"),
        ("mask_handles", t, "STRING", f"array_join(transform(regexp_extract_all(t, r'(\\S+|\\s+)', 1), k -> {hide}), '')"),
        ("mask_some_digits", "t STRING, run INT, history DOUBLE", "STRING", "CASE WHEN run > 0 OR history > 0 THEN mask_digits(t) ELSE t END"),
        ("soft_mask", "t STRING, platform DOUBLE, run INT, history DOUBLE", "STRING", "mask_some_digits(CASE WHEN platform >= 0.2D THEN mask_handles(t) ELSE t END, run, history)"),
    ]


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session; returns their names."""
    for name, parameters, kind, body in bodies():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [b[0] for b in bodies()]
