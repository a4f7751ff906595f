"""Queries over the core operators, with the SQL that gives the same rows in another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import constants as K
from tidewater import oracles as O
from tidewater.functions import features as X
from tidewater.functions import text as T
from tidewater.functions.register import register
from tidewater.operators import curation, nested, ranking
from tidewater.plans import curation as pipeline
from tidewater.plans import generation, moderation
from tidewater.runtime import scratch, table
from tidewater.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- nested records

RAW_SHAPE = {"arrays": ("turns", "spans", "rounds"), "nested_text": ("label", "metadata")}


def _corpus_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return nested.inline_typed(table(spark, d, "hinglish_spot_check"), "line_no", ["delivery", "turns", "label", "metadata"])


def _list(x: str, one: bool) -> str:
    """SQL: a JSON array as list; an object as a list of one where that counts."""
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN from_json({x}, '[\"JSON\"]') " + (f"WHEN 'OBJECT' THEN [{x}] " if one else "") + "ELSE [] END"


def _steps(name: str, source: str, array: str, path: str) -> str:
    """SQL: the elements of `array` over the rows of `source`, with their paths."""
    return f"""{name} AS (SELECT line_no, {path} || i AS path, a[i] AS e
        FROM (SELECT *, unnest(generate_series(1, len(a))) AS i FROM (SELECT *, {array} AS a FROM {source})))"""


_P7_SQL = f"""WITH o AS (SELECT line_no, raw::JSON AS j FROM raw_examples WHERE json_valid(raw) AND json_type(raw) = 'OBJECT'),
    v AS (SELECT line_no, j, CASE WHEN json_type(j->'label') = 'VARCHAR' AND json_valid(j->>'label') THEN (j->>'label')::JSON ELSE j->'label' END AS l,
                 CASE WHEN json_type(j->'metadata') = 'VARCHAR' AND json_valid(j->>'metadata') THEN (j->>'metadata')::JSON ELSE j->'metadata' END AS m FROM o),
    {_steps("t", "v", _list("(j->'turns')", True), "'turns.'")},
    {_steps("s", "t", _list("(e->'spans')", True), "path || '.spans.'")},
    {_steps("h", "s", _list("(e->'hits')", False), "path || '.hits.'")},
    {_steps("p", "v", _list("(l->'options')", False), "'label.options.'")},
    {_steps("c", "p", _list("(e->'checks')", False), "path || '.checks.'")},
    {_steps("r", "v", _list("(m->'review'->'rounds')", True), "'metadata.review.rounds.'")},
    {_steps("n", "r", _list("(e->'notes')", False), "path || '.notes.'")}
    SELECT 'raw_examples' AS tbl, line_no, path FROM (SELECT line_no, path FROM t UNION ALL SELECT line_no, path FROM s UNION ALL SELECT line_no, path FROM h
      UNION ALL SELECT line_no, path FROM p UNION ALL SELECT line_no, path FROM c UNION ALL SELECT line_no, path FROM r UNION ALL SELECT line_no, path FROM n)
    UNION ALL SELECT 'hinglish_spot_check', line_no, 'turns.' || unnest(generate_series(1, len(turns))) FROM hinglish_spot_check
    UNION ALL SELECT 'hinglish_spot_check', line_no, 'label.options.' || unnest(generate_series(1, len(label.options))) FROM hinglish_spot_check
    UNION ALL SELECT 'hinglish_spot_check', line_no, 'metadata.' || unnest(map_keys(metadata)) FROM hinglish_spot_check"""


@query(_P7_SQL)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    flat = _corpus_tables(spark, d)
    rows = None
    for name in ("turns", "label_options", "metadata"):
        part = flat[name].select(F.lit("hinglish_spot_check").alias("tbl"), F.col("record_key").alias("line_no"), "path")
        rows = part if rows is None else rows.unionByName(part)
    elements = _raw_tables(spark, d).elements().filter("position IS NOT NULL").select(F.lit("raw_examples").alias("tbl"), F.col("record_key").alias("line_no"), "path")
    # paths are unique within a record and keys within a table, so the rows are distinct without a shuffle
    return rows.unionByName(elements)


@query(
    """SELECT line_no AS record_key, '' AS parent_path, 'turns.' || i AS path, i::INTEGER AS position, turns[i] IS NULL AS is_null,
              turns[i].speaker AS speaker, turns[i].text AS text
       FROM (SELECT line_no, turns, unnest(generate_series(1, len(turns))) AS i FROM hinglish_spot_check)"""
)
def p7_turns(spark: SparkSession, d: str) -> DataFrame:
    return _corpus_tables(spark, d)["turns"]


@query(
    """SELECT line_no AS record_key, '' AS parent_path, 'label.options.' || i AS path, i::INTEGER AS position,
              label.options[i] IS NULL AS is_null, label.options[i] AS "value"
       FROM (SELECT line_no, label, unnest(generate_series(1, len(label.options))) AS i FROM hinglish_spot_check)"""
)
def p7_options(spark: SparkSession, d: str) -> DataFrame:
    return _corpus_tables(spark, d)["label_options"]


@query(
    """SELECT line_no AS record_key, delivery.multiturn AS delivery_multiturn, delivery.language_mix AS delivery_language_mix,
              label.contains_violation AS label_contains_violation, label.action AS label_action,
              label.violation_type AS label_violation_type FROM hinglish_spot_check"""
)
def p7_records(spark: SparkSession, d: str) -> DataFrame:
    return _corpus_tables(spark, d)["records"]


@query(
    """SELECT line_no AS record_key, 'metadata.' || e.key AS path, e.value IS NULL AS is_null, e.key AS name, e.value AS "value"
       FROM (SELECT line_no, unnest(map_entries(metadata)) AS e FROM hinglish_spot_check)"""
)
def p7_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _corpus_tables(spark, d)["metadata"].select("record_key", "path", "is_null", "name", "value")


def _raw_tables(spark: SparkSession, d: str) -> nested.JsonTables:
    return nested.json_tables(table(spark, d, "raw_examples"), "line_no", "raw", **RAW_SHAPE)


_RAW_SQL = _P7_SQL[: _P7_SQL.index("SELECT 'raw_examples'")]
_FIELDS = lambda *names: ", ".join(f"e->>'{n}' AS f_{n}" for n in names)
_LINKED = "line_no AS record_key, regexp_replace(path, '\\.[a-z]+\\.[0-9]+$', '') AS parent_path, path, regexp_extract(path, '[0-9]+$')::INTEGER AS \"position\", json_type(e) = 'NULL' AS is_null"


def _columns(df: DataFrame, *names: str) -> DataFrame:
    """The links and the named attributes, null where no row has them."""
    return df.select(*nested.LINKS, *[F.col(f"f_{n}") if f"f_{n}" in df.columns else F.lit(None).cast("string").alias(f"f_{n}") for n in names])


@query(_RAW_SQL + f"SELECT {_LINKED}, {_FIELDS('type', 'start', 'end', 'value', 'confidence')} FROM s")
def p7_raw_spans(spark: SparkSession, d: str) -> DataFrame:
    return _columns(_raw_tables(spark, d).table("turns_spans"), "type", "start", "end", "value", "confidence")


@query(_RAW_SQL + f"SELECT * REPLACE ('' AS parent_path) FROM (SELECT {_LINKED}, {_FIELDS('reviewer')} FROM r)")
def p7_raw_rounds(spark: SparkSession, d: str) -> DataFrame:
    return _columns(_raw_tables(spark, d).table("metadata_review_rounds"), "reviewer")


@query(_RAW_SQL + f"SELECT {_LINKED}, e->>'$' AS f_value FROM n WHERE json_type(e) NOT IN ('OBJECT', 'ARRAY')")
def p7_raw_notes(spark: SparkSession, d: str) -> DataFrame:
    return _columns(_raw_tables(spark, d).table("metadata_review_rounds_notes"), "value")


# ---------------------------------------------------------------- moderation


_FEATURES = "max_digit_run, digit_density, contact_kw_score, pattern_score, history_score, link_suspicion_score, cross_turn_platform_score"
_OUTPUT = f"CASE action WHEN 'pass' THEN final_text WHEN 'soft_mask' THEN {O.soft_masked('final_text', 'cross_turn_platform_score', 'max_digit_run', 'history_score')} END"


def _flat(decided: DataFrame) -> DataFrame:
    """Decisions with times and option lists as text, so that engines can be compared."""
    sent = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return decided.withColumns({"ts": sent, "options": F.array_join("options", " | ")})


@query(
    O.decisions(O.DELIVERED)
    + f"""SELECT room_id, sender_id, msg_id, speaker, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, final_text, {_FEATURES}, score, tier, logged_tier,
          action, action AS log_action, reason, options, escalated_from_suspicion, {_OUTPUT} AS text FROM decided"""
)
def moderation_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: every message through canonical text, features, keyed state and intervention."""
    return _flat(moderation.decisions(table(spark, d, "messages")))


@query(O.decisions(O.DELIVERED) + f"SELECT msg_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS logged_at, logged_tier AS tier, score, {_FEATURES}, action, reason FROM decided")
def moderation_log(spark: SparkSession, d: str) -> DataFrame:
    log = moderation.decision_log(moderation.decisions(table(spark, d, "messages")))
    return log.select("msg_id", "logged_at", "tier", "score", "features.*", "action", "reason")


def _phase1(spark: SparkSession, d: str, variant: str) -> DataFrame:
    span = lambda s: F.concat(s["type"], F.lit(":"), s["start"], F.lit("-"), s["end"], F.lit(":"), s["value"])
    done = T.phase1(table(spark, d, "messages").select("msg_id", "text"), "text", variant)
    return done.withColumn("spans", F.array_join(F.transform("spans_detected", span), "\n")).drop("spans_detected", "text")


_PHASE1 = lambda variant, more="": f"WITH {O.phase1('messages', 'msg_id', 'text', variant)} SELECT msg_id, final_text, {O.spans_text()} AS spans{more} FROM n_done"


@query(_PHASE1("pipeline", ", len(spans) > 0 AS deterministic_match"))
def moderation_phase1(spark: SparkSession, d: str) -> DataFrame:
    return _phase1(spark, d, "pipeline")


@query(_PHASE1("standalone"))
def standalone_phase1(spark: SparkSession, d: str) -> DataFrame:
    return _phase1(spark, d, "standalone")


def _suite(spark: SparkSession, d: str) -> DataFrame:
    return moderation.testcase_log(table(spark, d, "testcases"))


_SUITE = O.decisions(O.SUITE, "case_no, category, turn, room_id, sender_id, msg_id, speaker, text, ts")
_IDS = lambda t: f"coalesce(string_agg(msg_id, ' ' ORDER BY turn) FILTER (tier = '{t}'), '') AS {t}_ids"
_TIERS = ", ".join(f"count(*) FILTER (tier = '{t}') AS {t}" for t in ("low", "moderate", "high"))


@query(
    _SUITE
    + f"""SELECT d.msg_id, d.case_no, d.category, d.turn, o.speaker, o.text AS input_text, final_text, {_FEATURES}, score, tier, logged_tier, action, action AS log_action,
          reason, options, escalated_from_suspicion, {_OUTPUT} AS output_text FROM decided d JOIN once o ON o.msg_id = d.msg_id"""
)
def testcase_log(spark: SparkSession, d: str) -> DataFrame:
    """The suite's output for each turn."""
    return _suite(spark, d).withColumn("options", F.array_join("options", " | "))


@query(_SUITE + f"SELECT case_no, category, {_TIERS}, {_IDS('low')}, {_IDS('moderate')}, {_IDS('high')} FROM decided GROUP BY ALL")
def testcase_report(spark: SparkSession, d: str) -> DataFrame:
    got = moderation.testcase_report(_suite(spark, d))
    return got.withColumns({f"{t}_ids": F.array_join(f"{t}_ids", " ") for t in ("low", "moderate", "high")})


@query(_SUITE + f"SELECT category, grouping(category)::INTEGER AS overall, {_TIERS} FROM decided GROUP BY ROLLUP (category)")
def suite_totals(spark: SparkSession, d: str) -> DataFrame:
    return moderation.suite_totals(_suite(spark, d))


@query(f"SELECT msg_id, {O.sanitized('text')} AS text FROM messages")
def norm_sanitize_unicode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("msg_id", T.sanitize_unicode(F.col("text")).alias("text"))


@query(f"SELECT msg_id, {O.isolated_joined('text')} AS text FROM messages")
def norm_despace_isolated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("msg_id", T.despace_isolated(F.col("text")).alias("text"))


@query(f"SELECT msg_id, {O.paths_joined('text')} AS text FROM messages")
def norm_despace_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("msg_id", T.despace_paths(F.col("text")).alias("text"))


@query(f"SELECT msg_id, {O.flattened('text')} AS text FROM messages")
def norm_flatten_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("msg_id", T.flatten_whitespace(F.col("text")).alias("text"))


@query(f"SELECT msg_id, {O.verbal_signs('text')} AS text FROM messages")
def norm_substitute_verbal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("msg_id", T.substitute_verbal(F.col("text")).alias("text"))


@query("SELECT msg_id, replace(text, '@', ' at ') AS text FROM messages")
def norm_revert_verbal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("msg_id", T.revert_verbal(F.col("text")).alias("text"))


@query(f"WITH c AS MATERIALIZED (SELECT msg_id, {O.flattened(O.sanitized('text'))} AS t FROM messages) SELECT msg_id, {O.digits_for_words('t')} AS text FROM c")
def norm_words_to_digits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("msg_id", T.words_to_digits(T.flatten_whitespace(T.sanitize_unicode(F.col("text")))).alias("text"))


@query("WITH m AS (SELECT msg_id, text FROM messages) SELECT msg_id, max_digit_run, digit_density, contact_kw_score, pattern_score FROM (" + O.features("m", "msg_id", "coalesce(text, '')") + ")")
def feature_scores(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "messages").select(
        "msg_id", X.max_digit_run(t).alias("max_digit_run"), X.digit_density(t).alias("digit_density"), X.contact_kw_score(t).alias("contact_kw_score"), X.pattern_score(t).alias("pattern_score")
    )


@query("WITH m AS (SELECT msg_id, text FROM messages) SELECT msg_id, link_suspicion_score FROM (" + O.features("m", "msg_id", "coalesce(text, '')") + ")")
def feature_link(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("msg_id", X.link_suspicion_score(F.coalesce("text", F.lit(""))).alias("link_suspicion_score"))


@query(
    f"WITH {O.phase1('messages', 'msg_id, text', 'text')} SELECT msg_id, final_text, canonical, len(spans)::INTEGER AS spans, "
    f"{O.soft_masked('final_text', '0.2::DOUBLE', '1', '0')} AS masked FROM n_done"
)
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The operators by their SQL names."""
    register(spark)
    rows = table(spark, d, "messages").select("msg_id", "text")
    done = rows.selectExpr("msg_id", "redact(text) AS final_text", "normalize_text(text) AS canonical", "CASE WHEN text IS NOT NULL THEN size(detect_spans(text)) END AS spans")
    return done.withColumn("masked", F.expr("soft_mask(final_text, 0.2D, 1, 0D)"))


_LOGGED = "features.max_digit_run AS run, features.contact_kw_score AS kw, features.pattern_score AS pat, features.history_score AS hist, features.link_suspicion_score AS link, features.cross_turn_platform_score AS plat"
_SCORE_SQL = f"""WITH f AS (SELECT msg_id, logged_at, {_LOGGED} FROM decision_log),
    r AS (SELECT *, round_even((0.25::DOUBLE * least(run / 10.0::DOUBLE, 1.0::DOUBLE) + 0.20::DOUBLE * kw + 0.15::DOUBLE * pat + 0.15::DOUBLE * hist
                    + 0.15::DOUBLE * link + 0.10::DOUBLE * plat) * 100, 0)::INTEGER AS raw FROM f),
    s AS (SELECT msg_id, logged_at, CASE WHEN raw IS NOT NULL THEN least(CASE WHEN hist >= 0.7::DOUBLE OR plat >= 1.0::DOUBLE THEN greatest(raw, 35) ELSE raw END, 100) END AS score FROM r)
    """


def _rescored(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "decision_log")
    score = X.risk_score(*[F.col(f"features.{c}") for c in ("max_digit_run", "contact_kw_score", "pattern_score", "history_score", "link_suspicion_score", "cross_turn_platform_score")])
    return f.select("msg_id", "logged_at", score.alias("score"))


@query(_SCORE_SQL + "SELECT msg_id, logged_at, score, CASE WHEN score < 35 THEN 'low' WHEN score < 65 THEN 'moderate' WHEN score IS NOT NULL THEN 'high' END AS tier FROM s")
def score_log(spark: SparkSession, d: str) -> DataFrame:
    return _rescored(spark, d).withColumn("tier", X.tier(F.col("score")))


@query(
    _SCORE_SQL
    + """SELECT CASE WHEN score < 35 THEN 'low' WHEN score < 65 THEN 'moderate' WHEN score IS NOT NULL THEN 'high' END AS tier, count(*) AS records,
         min(score)::INTEGER AS lowest, max(score)::INTEGER AS highest FROM s GROUP BY 1"""
)
def tier_report(spark: SparkSession, d: str) -> DataFrame:
    return _rescored(spark, d).groupBy(X.tier(F.col("score")).alias("tier")).agg(F.count("*").alias("records"), F.min("score").alias("lowest"), F.max("score").alias("highest"))


@query("SELECT action, tier, count(*) AS records FROM decision_log GROUP BY ROLLUP (action, tier)")
def action_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decision_log").rollup("action", "tier").agg(F.count("*").alias("records"))


@query(r"SELECT msg_id, regexp_replace(text, '\p{Nd}', '█', 'g') AS text FROM messages")
def mask_digits(spark: SparkSession, d: str) -> DataFrame:
    """Digits of all scripts."""
    return table(spark, d, "messages").select("msg_id", X.mask_digits(F.col("text")).alias("text"))


@query("SELECT case_no, array_to_string(list_transform(turns, lambda t: coalesce(t.speaker, '') || ': ' || coalesce(t.text, '')), chr(10)) AS chat FROM testcases")
def render_turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "testcases").select("case_no", X.render_turns(F.col("turns")).alias("chat"))


@query(
    r"""SELECT line_no, len(list_filter(label.options, lambda o: o IS NOT NULL AND NOT regexp_matches(o, '\p{Nd}{7,}')))::INTEGER AS kept
        FROM hinglish_spot_check"""
)
def option_gate(spark: SparkSession, d: str) -> DataFrame:
    """Options left of every record, null where it has none to begin with."""
    gated = X.gate_options(F.col("label.options"))
    return table(spark, d, "hinglish_spot_check").select("line_no", F.when(gated.isNotNull(), F.size(gated)).alias("kept"))


@query(
    """WITH m AS (SELECT DISTINCT sender_id, ts, msg_id FROM messages),
         g AS (SELECT *, ts - lag(ts) OVER w AS gap FROM m WINDOW w AS (PARTITION BY sender_id ORDER BY ts, msg_id))
       SELECT sender_id, msg_id, (sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 600 SECOND THEN 1 ELSE 0 END)
              OVER (PARTITION BY sender_id ORDER BY ts, msg_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM g"""
)
def sender_sessions(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").select("sender_id", F.col("ts").cast("timestamp").alias("ts"), "msg_id").distinct()
    return ranking.sessions(m, "sender_id", "ts", 600, "msg_id").select("sender_id", "msg_id", "session")


# ---------------------------------------------------------------- curation


_IS = lambda x, kind: f"coalesce(json_type({x}) = '{kind}', false)"
_FLAGS = ", ".join(f"'{x}'" for x in curation.TRUE + curation.FALSE)
_IS_FLAG = lambda x, text: f"coalesce(json_type({x}) = 'BOOLEAN' OR lower({text}) IN ({_FLAGS}), false)"
_ELEMENTS = lambda x: f"from_json({x}, '[\"JSON\"]')"
_CHECKED_SQL = f"""WITH j AS (SELECT line_no, raw, CASE WHEN json_valid(raw) THEN raw::JSON END AS v FROM raw_examples WHERE length(trim(raw)) > 0),
    checked AS (SELECT line_no, raw, v, CASE WHEN v IS NULL THEN 'not valid JSON' WHEN NOT {_IS("v", "OBJECT")} THEN 'not an object'
      WHEN NOT {_IS("(v->'id')", "VARCHAR")} THEN 'id: string required' WHEN NOT {_IS("(v->'intent')", "VARCHAR")} THEN 'intent: string required'
      WHEN NOT {_IS("(v->'subtype')", "VARCHAR")} THEN 'subtype: string required'
      WHEN NOT {_IS_FLAG("(v->'delivery'->'multiturn')", "(v->'delivery'->>'multiturn')")} THEN 'delivery.multiturn: boolean required'
      WHEN NOT {_IS_FLAG("(v->'delivery'->'language_mix')", "(v->'delivery'->>'language_mix')")} THEN 'delivery.language_mix: boolean required'
      WHEN NOT {_IS("(v->'turns')", "ARRAY")} THEN 'turns: list required'
      WHEN len(list_filter({_ELEMENTS("(v->'turns')")}, lambda t: NOT ({_IS("(t->'speaker')", "VARCHAR")} AND {_IS("(t->'text')", "VARCHAR")}))) > 0 THEN 'turns: speaker and text required'
      WHEN NOT {_IS_FLAG("(v->'label'->'contains_violation')", "(v->'label'->>'contains_violation')")} THEN 'label.contains_violation: boolean required'
      WHEN (v->'label'->'options') IS NOT NULL AND NOT ({_IS("(v->'label'->'options')", "ARRAY")}
           AND len(list_filter(CASE WHEN {_IS("(v->'label'->'options')", "ARRAY")} THEN {_ELEMENTS("(v->'label'->'options')")} END, lambda o: NOT {_IS("o", "VARCHAR")})) = 0) THEN 'label.options: list of strings required'
      WHEN NOT {_IS("(v->'metadata')", "OBJECT")} THEN 'metadata: object required' END AS error FROM j)
    """


@query(_CHECKED_SQL + "SELECT line_no AS line, error, substring(raw, 1, 200) AS raw FROM checked WHERE error IS NOT NULL")
def corpus_invalid(spark: SparkSession, d: str) -> DataFrame:
    return curation.validate(table(spark, d, "raw_examples"))[1]


_TRUE = ", ".join(f"'{x}'" for x in curation.TRUE)


@query(
    _CHECKED_SQL
    + f"""SELECT line_no, v->>'id' AS id, v->>'subtype' AS subtype, lower(v->'delivery'->>'multiturn') IN ({_TRUE}) AS multiturn,
          lower(v->'label'->>'contains_violation') IN ({_TRUE}) AS violation, len({_ELEMENTS("(v->'turns')")})::INTEGER AS turns,
          array_to_string(list_transform({_ELEMENTS("(v->'turns')")}, lambda t: t->>'text'), ' ') AS example_text FROM checked WHERE error IS NULL"""
)
def corpus_valid(spark: SparkSession, d: str) -> DataFrame:
    """Records that pass, read into the corpus shape."""
    good = curation.validate(table(spark, d, "raw_examples"))[0]
    return good.select(
        "line_no", "id", "subtype", F.col("delivery.multiturn").alias("multiturn"), F.col("label.contains_violation").alias("violation"),
        F.size("turns").alias("turns"), F.array_join("turns.text", " ").alias("example_text"),
    )


_REPLY_SQL = f"""WITH r AS (SELECT line_no, CASE WHEN json_valid(raw) THEN raw::JSON->'label' END AS v FROM raw_examples),
    k AS (SELECT line_no, v, json_type(v->'contains_violation') AS kind, v->>'contains_violation' AS flag, json_type(v->'options') AS listed,
                 CASE WHEN json_type(v->'options') = 'ARRAY' THEN {_ELEMENTS("(v->'options')")} END AS o FROM r),
    c AS (SELECT *, CASE kind WHEN 'BOOLEAN' THEN flag = 'true' WHEN 'VARCHAR' THEN flag <> '' WHEN 'NULL' THEN false ELSE coalesce(TRY_CAST(flag AS DOUBLE) <> 0, true) END AS truthy FROM k),
    w AS (SELECT line_no, CASE WHEN v IS NULL OR json_type(v) <> 'OBJECT' THEN 'not valid JSON' WHEN kind IS NULL OR listed IS NULL THEN 'missing key' WHEN NOT truthy THEN NULL
      WHEN o IS NULL OR len(o) <> 3 THEN 'wrong number of options'
      WHEN len(list_filter(o, lambda x: json_type(x) <> 'VARCHAR' OR len(list_filter(regexp_split_to_array(x->>'$', '[\\s\\x{{00A0}}\\x{{2002}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+'), lambda y: y <> '')) < 4)) > 0 THEN 'option too short' END AS fallback_reason,
      truthy, CASE WHEN truthy AND len(o) = 3 THEN 3 ELSE 0 END AS n FROM c)
    SELECT line_no, fallback_reason, fallback_reason IS NULL AS valid, fallback_reason IS NOT NULL OR truthy AS contains_violation, CASE WHEN fallback_reason IS NULL THEN n ELSE 0 END AS options FROM w"""


@query(_REPLY_SQL)
def replies_validated(spark: SparkSession, d: str) -> DataFrame:
    """The labels of the delivered records, read as replies of a language model."""
    reply = F.try_variant_get(F.try_parse_json("raw"), "$.label", "variant")
    rows = table(spark, d, "raw_examples").select("line_no", X.validated_response(F.to_json(reply)).alias("r"))
    return rows.select("line_no", "r.fallback_reason", "r.valid", "r.contains_violation", F.size("r.options").alias("options"))


_WORDS = "len(list_filter(regexp_split_to_array(o, '[\\s\\x{00A0}\\x{2002}-\\x{200A}\\x{202F}\\x{3000}]+'), lambda w: w <> ''))"
_FLAG_SQL = f"""WITH c AS (SELECT line_no, id, coalesce(label.contains_violation, false) AS v, coalesce(len(label.options), 0) AS n, label.options AS o FROM hinglish_spot_check),
    f AS (SELECT line_no, id, CASE WHEN NOT v AND n > 0 THEN 'non-violation has options'
                   WHEN v AND n <> 3 THEN 'expected 3 options, got ' || n
                   WHEN v AND len(list_filter(o, lambda o: {_WORDS} < 4)) > 0 THEN 'option too short' END AS reason FROM c)
    """


@query(_FLAG_SQL + "SELECT id, reason FROM f WHERE reason IS NOT NULL")
def options_flagged(spark: SparkSession, d: str) -> DataFrame:
    return curation.check_options(table(spark, d, "hinglish_spot_check"))[1].select("id", "reason")


@query(_FLAG_SQL + "SELECT line_no FROM f WHERE id IS NULL OR id NOT IN (SELECT id FROM f WHERE reason IS NOT NULL AND id IS NOT NULL)")
def options_kept(spark: SparkSession, d: str) -> DataFrame:
    return curation.check_options(table(spark, d, "hinglish_spot_check"))[0].select("line_no")


_PAIR_SQL = """WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b,
      list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
    """
VECTOR_DROP, VECTOR_REVIEW = 0.40, 0.35


def _vector_pairs(spark: SparkSession, d: str) -> DataFrame:
    return curation.vector_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", VECTOR_REVIEW)


@query(_PAIR_SQL + f"SELECT a, b, round(s, 4) AS similarity FROM p WHERE s >= {VECTOR_REVIEW}")
def vector_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _vector_pairs(spark, d).withColumn("similarity", F.round("similarity", 4))


@query(
    _PAIR_SQL.replace("WITH p", "WITH RECURSIVE p")
    + f""", e AS (SELECT a, b FROM p WHERE s >= {VECTOR_DROP} UNION SELECT b, a FROM p WHERE s >= {VECTOR_DROP}),
      r AS (SELECT DISTINCT a AS n, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON r.n = e.a),
      c AS (SELECT n, min(m) AS component FROM r GROUP BY n)
    SELECT vec_id, coalesce(component, vec_id) AS cluster FROM embeddings LEFT JOIN c ON vec_id = n"""
)
def vector_clusters(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "embeddings").select("vec_id", F.lit("").alias("text"))
    return curation.deduplicate(items, _vector_pairs(spark, d), "vec_id", "text", VECTOR_DROP)[1]


_CLUSTER_SQL = ORACLE["vector_clusters"].replace("SELECT vec_id, coalesce(component, vec_id) AS cluster FROM embeddings", ", k AS (SELECT vec_id, coalesce(component, vec_id) AS cluster FROM embeddings") + ")"


def _with_texts(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return table(spark, d, "embeddings").select("vec_id").join(texts, "vec_id", "left")


@query(
    _CLUSTER_SQL
    + """, t AS (SELECT cluster, k.vec_id, row_number() OVER (PARTITION BY cluster ORDER BY coalesce(length(text), 0) DESC, k.vec_id) AS place,
           count(*) OVER (PARTITION BY cluster) AS members, min(k.vec_id) OVER (PARTITION BY cluster) AS "position" FROM k LEFT JOIN documents ON doc_id = k.vec_id)
         SELECT cluster, vec_id, members, "position" FROM t WHERE place = 1"""
)
def vector_representatives(spark: SparkSession, d: str) -> DataFrame:
    return curation.deduplicate(_with_texts(spark, d), _vector_pairs(spark, d), "vec_id", "text", VECTOR_DROP)[0]


@query(
    _PAIR_SQL
    + f"""SELECT round(s, 4) AS similarity, a AS example_a, x.text AS text_a, b AS example_b, y.text AS text_b
          FROM p LEFT JOIN documents x ON x.doc_id = a LEFT JOIN documents y ON y.doc_id = b WHERE s >= {VECTOR_REVIEW} AND s < {VECTOR_DROP} ORDER BY 1 DESC, 2, 4"""
)
def vector_review(spark: SparkSession, d: str) -> DataFrame:
    """Pairs for review with both texts, most similar first."""
    return curation.review_pairs(_with_texts(spark, d), _vector_pairs(spark, d), "vec_id", "text", VECTOR_DROP)


_CURATED_SQL = (
    _CHECKED_SQL.replace("WITH j", "WITH RECURSIVE j")
    + f""", good AS (SELECT line_no, v->>'id' AS id, lower(v->'label'->>'contains_violation') IN ({_TRUE}) AS v,
             list_transform(CASE WHEN {_IS("(v->'label'->'options')", "ARRAY")} THEN {_ELEMENTS("(v->'label'->'options')")} ELSE [] END, lambda o: o->>'$') AS o,
             array_to_string(list_transform({_ELEMENTS("(v->'turns')")}, lambda t: t->>'text'), ' ') AS text FROM checked WHERE error IS NULL),
        bad AS (SELECT id FROM good WHERE (NOT v AND len(o) > 0) OR (v AND (len(o) <> 3 OR len(list_filter(o, lambda x: WORDS < 4)) > 0))),
        kept AS (SELECT line_no, text FROM good WHERE id NOT IN (SELECT id FROM bad)),
        m AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IN (SELECT line_no FROM kept)),
        p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM m a JOIN m b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {VECTOR_DROP}),
        e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT DISTINCT a AS n, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON r.n = e.a),
        c AS (SELECT n, min(m) AS component FROM r GROUP BY n)
        SELECT line_no FROM (SELECT line_no, row_number() OVER (PARTITION BY coalesce(component, line_no) ORDER BY length(text) DESC, line_no) AS place FROM kept LEFT JOIN c ON n = line_no) WHERE place = 1"""
)


@query(_CURATED_SQL.replace("WORDS", "len(list_filter(regexp_split_to_array(x, '[\\s\\x{00A0}\\x{2002}-\\x{200A}\\x{202F}\\x{3000}]+'), lambda y: y <> ''))"))
def curation_clean(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline over the delivered records, with the vectors of the same numbers."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("line_no"), "embedding")
    return pipeline.curate(table(spark, d, "raw_examples"), table(spark, d, "subtype_targets"), vectors, VECTOR_DROP, VECTOR_REVIEW).clean.select("line_no")


@query()
def curation_embedded(spark: SparkSession, d: str) -> DataFrame:
    """The same with the default embedder instead of given vectors."""
    return pipeline.curate(table(spark, d, "raw_examples"), table(spark, d, "subtype_targets")).clean.select("line_no", "id")


@query(
    """SELECT t.subtype, coalesce(n, 0) AS actual, target, round(100.0::DOUBLE * coalesce(n, 0) / target, 4) AS pct,
         CASE WHEN 100.0::DOUBLE * coalesce(n, 0) / target < 90 THEN target - coalesce(n, 0) END AS shortfall
       FROM subtype_targets t LEFT JOIN (SELECT subtype, count(*) AS n FROM hinglish_spot_check GROUP BY 1) c ON t.subtype = c.subtype"""
)
def balance_check(spark: SparkSession, d: str) -> DataFrame:
    return curation.balance(table(spark, d, "hinglish_spot_check"), table(spark, d, "subtype_targets"))[0]


@query(
    """SELECT subtype, count(*) AS actual FROM hinglish_spot_check h WHERE NOT EXISTS (SELECT 1 FROM subtype_targets t WHERE t.subtype = h.subtype) GROUP BY subtype"""
)
def unexpected_subtypes(spark: SparkSession, d: str) -> DataFrame:
    return curation.balance(table(spark, d, "hinglish_spot_check"), table(spark, d, "subtype_targets"))[1]


@query(
    """WITH r AS (SELECT line_no, subtype, row_number() OVER (PARTITION BY subtype ORDER BY md5(line_no::VARCHAR), line_no) AS rn,
                         count(*) OVER (PARTITION BY subtype) AS n FROM hinglish_spot_check)
       SELECT line_no, subtype FROM r WHERE rn <= greatest(1, floor(0.05::DOUBLE * n))"""
)
def spot_check(spark: SparkSession, d: str) -> DataFrame:
    return curation.spot_check(table(spark, d, "hinglish_spot_check")).select("line_no", "subtype")


@query("SELECT line_no FROM hinglish_spot_check WHERE NOT coalesce(delivery.multiturn AND delivery.language_mix AND label.contains_violation, false)")
def delete_flagged(spark: SparkSession, d: str) -> DataFrame:
    return curation.delete_flagged(table(spark, d, "hinglish_spot_check")).select("line_no")


_ALL_TRUE = " AND ".join(f"coalesce(json_type(v->'{a}'->'{b}') = 'BOOLEAN' AND (v->'{a}'->>'{b}') = 'true', false)" for a, b in (("delivery", "multiturn"), ("delivery", "language_mix"), ("label", "contains_violation")))


@query(f"WITH j AS (SELECT line_no, raw, CASE WHEN json_valid(raw) THEN raw::JSON END AS v FROM raw_examples) SELECT line_no, raw FROM j WHERE NOT ({_ALL_TRUE})")
def delete_flagged_lines(spark: SparkSession, d: str) -> DataFrame:
    """The same on lines as delivered: what cannot be parsed stays word for word."""
    return curation.delete_flagged_lines(table(spark, d, "raw_examples").select("line_no", "raw"))


@query(
    """WITH r AS (SELECT line_no, subtype, row_number() OVER (PARTITION BY subtype ORDER BY md5(line_no::VARCHAR), line_no) AS rn,
                         count(*) OVER (PARTITION BY subtype) AS n, count(*) OVER () AS total FROM hinglish_spot_check)
       SELECT line_no, subtype FROM r WHERE rn <= greatest(1, floor(n * 200 / total))"""
)
def golden_slice(spark: SparkSession, d: str) -> DataFrame:
    return curation.golden_slice(table(spark, d, "hinglish_spot_check"))[0].select("line_no", "subtype")


_IDS = ", ".join(f"('{i}')" for i in K.IDS_TO_REMOVE)


@query(f"SELECT line_no FROM hinglish_spot_check WHERE id IS NULL OR id NOT IN (SELECT * FROM (VALUES {_IDS}))")
def delete_ids(spark: SparkSession, d: str) -> DataFrame:
    return curation.delete_ids(table(spark, d, "hinglish_spot_check"), K.IDS_TO_REMOVE)[0].select("line_no")


@query(f"SELECT v.id FROM (VALUES {_IDS}) v(id) WHERE v.id NOT IN (SELECT id FROM hinglish_spot_check WHERE id IS NOT NULL)")
def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    return curation.delete_ids(table(spark, d, "hinglish_spot_check"), K.IDS_TO_REMOVE)[1]


_KEY_SQL = "trim(regexp_replace(lower({}), '[\\s\\x1c-\\x1f]+', ' ', 'g'))"


@query(
    f"""WITH b AS (SELECT line_no, {_KEY_SQL.format("turns[1].text")} AS k FROM hinglish_spot_check),
        s AS (SELECT DISTINCT {_KEY_SQL.format("t.text")} AS k FROM (SELECT unnest(turns) AS t FROM testcases)),
        f AS (SELECT k, min(line_no) AS line_no FROM b WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM s WHERE k IS NOT NULL) GROUP BY k)
        SELECT line_no FROM f UNION ALL SELECT line_no FROM b WHERE k IS NULL"""
)
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return curation.new_examples(table(spark, d, "hinglish_spot_check"), table(spark, d, "testcases")).select("line_no")


@query(
    """SELECT t.subtype, target, coalesce(n, 0) AS have, greatest(target - coalesce(n, 0), 0) AS missing, least(greatest(target - coalesce(n, 0), 0), 25) AS next_batch
       FROM subtype_targets t LEFT JOIN (SELECT subtype, count(*) AS n FROM hinglish_spot_check GROUP BY 1) c ON t.subtype = c.subtype"""
)
def generation_deficit(spark: SparkSession, d: str) -> DataFrame:
    return curation.deficits(table(spark, d, "hinglish_spot_check"), table(spark, d, "subtype_targets"), 25)


@query(
    """SELECT line_no, h.subtype || '_' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS id
       FROM (SELECT h.line_no, h.subtype, coalesce(target, 0) + row_number() OVER (PARTITION BY h.subtype ORDER BY line_no) - 1 AS n
             FROM hinglish_spot_check h LEFT JOIN subtype_targets t ON t.subtype = h.subtype) h"""
)
def assign_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that go on behind what is there; the targets stand for the number of earlier records."""
    have = table(spark, d, "subtype_targets").select("subtype", F.col("target").alias("have"))
    return curation.assign_ids(table(spark, d, "hinglish_spot_check"), have).select("line_no", "id")


@query(
    """WITH b AS (SELECT line_no, row_number() OVER (ORDER BY md5(line_no::VARCHAR), line_no) AS rn, count(*) OVER () AS n
                  FROM hinglish_spot_check WHERE NOT coalesce(delivery.language_mix, false))
       SELECT line_no, ((rn - 1) // 10)::BIGINT AS chunk, ((rn - 1) % 10)::BIGINT AS place FROM b WHERE rn <= floor(0.25::DOUBLE * n)"""
)
def language_mix_chunks(spark: SparkSession, d: str) -> DataFrame:
    s = curation.language_mix_sample(table(spark, d, "hinglish_spot_check"))
    return s.select("line_no", "chunk", "place")


_CHUNKS = ORACLE["language_mix_chunks"]


@query(
    f"""SELECT id || '_hi' AS id, intent, subtype, CASE WHEN delivery IS NOT NULL THEN delivery.multiturn END AS multiturn, CASE WHEN delivery IS NOT NULL THEN true END AS language_mix,
          array_to_string(list_transform(turns, lambda t: coalesce(t.speaker, '') || ': ' || coalesce('yaar, ' || t.text, '')), chr(10)) AS chat, id AS derived_from
        FROM hinglish_spot_check JOIN ({_CHUNKS}) USING (line_no) WHERE place < 8"""
)
def derive_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Rewritten records: a rewriter that puts a word in front and leaves out the last two of each chunk stands in."""
    s = curation.language_mix_sample(table(spark, d, "hinglish_spot_check"))
    mixed = F.transform("turns", lambda t: F.when(t.isNotNull(), F.struct(t["speaker"].alias("speaker"), F.concat(F.lit("yaar, "), t["text"]).alias("text"))))
    out = curation.derive_mixed(s, s.filter("place < 8").select("chunk", "place", mixed.alias("turns"), "label"))
    return out.select(
        "id", "intent", "subtype", F.col("delivery.multiturn").alias("multiturn"), F.col("delivery.language_mix").alias("language_mix"), X.render_turns(F.col("turns")).alias("chat"),
        F.col("metadata")["derived_from"].alias("derived_from"),
    )


_REQUESTS_SQL = """WITH h AS (SELECT subtype, count(*) AS have, arg_min(turns[1].text, line_no) AS shown FROM hinglish_spot_check GROUP BY 1),
    q AS (SELECT t.subtype, coalesce(have, 0) AS have, least(target - coalesce(have, 0), 25) AS next_batch, shown FROM subtype_targets t LEFT JOIN h ON h.subtype = t.subtype WHERE target > coalesce(have, 0))
    """


@query(_REQUESTS_SQL + "SELECT subtype, have, next_batch, 'Write ' || next_batch || ' more conversations like these: ' || CASE WHEN shown IS NULL THEN '[]' ELSE to_json([shown])::VARCHAR END AS prompt FROM q")
def generation_requests(spark: SparkSession, d: str) -> DataFrame:
    return generation.requests(table(spark, d, "hinglish_spot_check"), table(spark, d, "subtype_targets"), 25)


@query(
    _REQUESTS_SQL
    + """, g AS (SELECT subtype, have, k, subtype || ' request ' || CASE WHEN k % 4 = 0 THEN 0 ELSE k END AS text FROM (SELECT *, unnest(generate_series(0, next_batch - 1)) AS k FROM q)),
         f AS (SELECT subtype, have, text, min(k) AS k FROM g GROUP BY ALL),
         n AS (SELECT *, have + row_number() OVER (PARTITION BY subtype ORDER BY k) - 1 AS no FROM f)
         SELECT subtype || '_' || CASE WHEN no < 10000 THEN lpad(no::VARCHAR, 4, '0') ELSE no::VARCHAR END AS id, subtype, text FROM n"""
)
def generation_round(spark: SparkSession, d: str) -> DataFrame:
    """One batch for each subtype that lacks records, from the stand-in generator: parsed, deduplicated, numbered."""
    made = generation.generate_round(table(spark, d, "hinglish_spot_check"), table(spark, d, "subtype_targets"), 25)
    return made.select("id", "subtype", F.get("turns.text", F.lit(0)).alias("text"))


# ---------------------------------------------------------------- files


@query("SELECT row_number() OVER (ORDER BY line_no) AS line_no, coalesce(raw, '') AS raw FROM raw_examples")
def file_lines(spark: SparkSession, d: str) -> DataFrame:
    """Records written as lines over several files and numbered again in file order."""
    path = scratch(spark, "lines")
    rows = table(spark, d, "raw_examples").select("line_no", F.coalesce("raw", F.lit("")).alias("raw"))
    rows.repartitionByRange(4, "line_no").sortWithinPartitions("line_no").select("raw").write.text(path)
    return files.read_lines(spark, path)


@query("SELECT id, category, array_to_string(list_transform(turns, lambda t: coalesce(t.speaker, '') || ': ' || coalesce(t.text, '')), chr(10)) AS chat FROM testcases")
def file_cases(spark: SparkSession, d: str) -> DataFrame:
    """The suite written as JSON, rewritten in place and read back."""
    path = scratch(spark, "cases")
    files.write_jsonl(table(spark, d, "testcases").select("id", "category", "turns", F.lit(1).alias("extra")), path)
    files.rewrite(spark.read.schema(files.CASES).json(path), path, source="json")
    got = files.read_corpus(spark, path, files.CASES)
    return got.select("id", "category", X.render_turns(F.col("turns")).alias("chat"))


@query(
    "SELECT msg_id, logged_at, tier, score, features.max_digit_run AS max_digit_run, features.history_score AS history_score, action, reason FROM decision_log "
    "UNION ALL SELECT msg_id, logged_at, tier, score, features.max_digit_run, features.history_score, action, reason FROM decision_log"
)
def file_log(spark: SparkSession, d: str) -> DataFrame:
    """The decision log appended twice and read back."""
    path = scratch(spark, "log")
    log = table(spark, d, "decision_log")
    for _ in range(2):
        files.append_log(log, path)
    got = spark.read.schema(log.schema).json(path)
    return got.select("msg_id", "logged_at", "tier", "score", "features.max_digit_run", "features.history_score", "action", "reason")


_SEEN_KEY = _KEY_SQL.format("t.text")


@query(
    f"SELECT 'subtype' AS what, subtype AS name, count(*) AS n FROM hinglish_spot_check GROUP BY 2 "
    f"UNION ALL SELECT 'turn', {_SEEN_KEY}, 1 FROM (SELECT unnest(turns) AS t FROM hinglish_spot_check) WHERE {_SEEN_KEY} IS NOT NULL GROUP BY ALL"
)
def resume_scan(spark: SparkSession, d: str) -> DataFrame:
    """What a resumed generation knows: records per subtype and the keys of all turns."""
    have, keys = files.resume(table(spark, d, "hinglish_spot_check"))
    return have.select(F.lit("subtype").alias("what"), F.col("subtype").alias("name"), F.col("have").alias("n")).unionByName(keys.select(F.lit("turn").alias("what"), F.col("key").alias("name"), F.lit(1).cast("long").alias("n")))
