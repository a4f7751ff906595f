"""Queries over the training-data operators, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import oracles as O
from tidewater.llm import defects, langid, leakage, neardup, packing, pii, quality, sampling, skeleton
from tidewater.runtime import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


TURN_TABLES = (("hinglish_spot_check", "line_no"), ("testcases", "case_no"))


def turn_texts(spark: SparkSession, d: str, tbl: str, key: str) -> DataFrame:
    """(rec_no, texts): the turn texts of every record in order."""
    return table(spark, d, tbl).select(F.col(key).alias("rec_no"), F.col("turns.text").alias("texts"))


def turns_long(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, rec_no, turn_no, text) over both tables of turns."""
    rows = None
    for tbl, key in TURN_TABLES:
        part = turn_texts(spark, d, tbl, key).select(F.lit(tbl).alias("tbl"), "rec_no", F.posexplode("texts").alias("p", "text"))
        part = part.select("tbl", "rec_no", (F.col("p") + 1).cast("int").alias("turn_no"), "text")
        rows = part if rows is None else rows.unionByName(part)
    return rows


# ---------------------------------------------------------------- 3: visually identical text


@query(O.PAIRS)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for tbl, key in TURN_TABLES:
        groups = cut(skeleton.look_alike_groups(turn_texts(spark, d, tbl, key), "rec_no", "texts"))
        part = skeleton.look_alike_pairs(groups).select(F.lit(tbl).alias("tbl"), "rec_a", "rec_b")
        out = part if out is None else out.unionByName(part)
    return out


@query(O.CLASSES)
def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row for each record: the smallest record that looks the same, its variant, and how many records look the same
    in other characters."""
    out = None
    for tbl, key in TURN_TABLES:
        part = skeleton.look_alike_classes(cut(skeleton.look_alike_groups(turn_texts(spark, d, tbl, key), "rec_no", "texts"))).select(F.lit(tbl).alias("tbl"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query(O.CONSISTENT)
def p3_consistent(spark: SparkSession, d: str) -> DataFrame:
    rows = turns_long(spark, d)
    return rows.select("tbl", "rec_no", "turn_no", skeleton.consistent_udf("text").alias("text"))


# ---------------------------------------------------------------- 2: samples that match category shares


def _plan_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    corpus = table(spark, d, "hinglish_spot_check")
    members = sampling.memberships(corpus, "id", {"subtype": F.col("subtype"), "intent": F.col("intent"), "multiturn": F.col("delivery.multiturn")})
    return members, sampling.targets(corpus, "id", members, table(spark, d, "sample_plan"))


_PLAN_SQL = """WITH m AS (
      SELECT DISTINCT id, field, category FROM (
        SELECT id, 'subtype' AS field, regexp_replace(lower(trim(subtype)), '[\\s_-]+', '_', 'g') AS category FROM hinglish_spot_check
        UNION ALL SELECT id, 'intent', regexp_replace(lower(trim(intent)), '[\\s_-]+', '_', 'g') FROM hinglish_spot_check
        UNION ALL SELECT id, 'multiturn', CAST(delivery.multiturn AS VARCHAR) FROM hinglish_spot_check)
      WHERE id IS NOT NULL AND category IS NOT NULL AND category <> ''),
    c AS (SELECT field, category, count(*) AS available FROM m GROUP BY ALL),
    n AS (SELECT count(DISTINCT id) AS n FROM hinglish_spot_check),
    t AS (SELECT plan_id, p.field, p.category, greatest(min_rows, (n * sample_pct // 100) * share_pct // 100) AS wanted,
                 coalesce(available, 0) AS available
          FROM sample_plan p CROSS JOIN n LEFT JOIN c ON p.field = c.field AND p.category = c.category)
    """


@query(_PLAN_SQL + "SELECT plan_id, category FROM t WHERE available < wanted")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Categories that the calibrated sample cannot fill."""
    members, wanted = _plan_inputs(spark, d)
    wanted = cut(wanted)
    tilts = sampling.calibrate(sampling.unit_patterns(members, wanted), wanted)
    return sampling.calibration_report(wanted, tilts).filter("short AND available < wanted").select("plan_id", "category")


@query(
    _PLAN_SQL
    + """SELECT plan_id, category, wanted, CASE WHEN available < wanted THEN available ELSE wanted END AS expected FROM t"""
)
def p2_calibrated(spark: SparkSession, d: str) -> DataFrame:
    """Rows that each category of the calibrated sample has: what is wanted, or all there are."""
    members, wanted = _plan_inputs(spark, d)
    wanted = cut(wanted)
    tilts = sampling.calibrate(sampling.unit_patterns(members, wanted), wanted)
    return sampling.calibration_report(wanted, tilts).select("plan_id", "category", "wanted", F.round("expected").cast("long").alias("expected"))


@query(_PLAN_SQL + "SELECT plan_id, field, category, wanted, available, greatest(wanted - available, 0) AS gap FROM t")
def p2_targets(spark: SparkSession, d: str) -> DataFrame:
    return _plan_inputs(spark, d)[1].select("plan_id", "field", "category", "wanted", "available", "gap")


def _sampled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    members, wanted = _plan_inputs(spark, d)
    wanted = cut(wanted)
    return wanted, sampling.calibrated_sample(cut(members), wanted)


@query()
def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[1]


@query()
def p2_report(spark: SparkSession, d: str) -> DataFrame:
    wanted, sample = _sampled(spark, d)
    return sampling.sample_report(wanted, cut(sample))


# ---------------------------------------------------------------- 8: training windows

WINDOW = 2048


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return packing.pieces(packing.token_sizes(table(spark, d, "documents"), "doc_id", "text"), WINDOW)


#: Attention that the texts of one window may cost together, as a share of one text that fills it.
ATTENTION_SHARE = 0.9


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(cut(_pieces(spark, d)), WINDOW, attention_share=ATTENTION_SHARE)


@query()
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that the packing spreads over several windows: exactly those longer than one."""
    return _windows(spark, d).groupBy("doc_id").agg(F.countDistinct("window_id").alias("n")).filter("n > 1").select("doc_id")


@query()
def p8_windows(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d)


@query()
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_windows(spark, d), WINDOW)


# ---------------------------------------------------------------- 9: evaluation texts in the corpus


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items").select("item_id", "text"))


@query(
    r"""WITH dt AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
      iw AS (SELECT item_id, list_filter(list_transform(string_split_regex(lower(text), '\s+'),
               lambda x: array_to_string(regexp_extract_all(x, '[\p{L}\p{M}\p{N}]+'), ' ')), lambda x: x <> '') AS w FROM eval_items),
      win AS (SELECT item_id, array_to_string(w[k:k + 11], ' ') AS s FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS k FROM iw)),
      sizes AS (SELECT DISTINCT len(string_split(s, ' ')) AS n FROM win),
      dw AS (SELECT doc_id, array_to_string(w[k:k + n - 1], ' ') AS s
             FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM dt, sizes WHERE len(w) >= n))
      SELECT DISTINCT doc_id, item_id FROM dw JOIN win ON dw.s = win.s"""
)
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).filter("run_words >= 12").select("doc_id", "item_id")


@query(f"SELECT item_id, suite, count(*) AS documents FROM ({ORACLE['p9_found']}) JOIN eval_items USING (item_id) GROUP BY ALL")
def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, and into how many documents."""
    hit = _leaks(spark, d).filter("run_words >= 12").groupBy("item_id").agg(F.count("*").alias("documents"))
    return table(spark, d, "eval_items").select("item_id", "suite").join(hit, "item_id")


@query()
def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """Passages with small changes: verified windows by weighted shingle similarity without an exact run of 12 words."""
    return _leaks(spark, d).filter("run_words < 12").select("doc_id", "item_id", F.round("similarity", 4).alias("similarity"), "windows")


# ---------------------------------------------------------------- 10: text quality statistics


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_stats(table(spark, d, "documents"), "doc_id", "text", "lang")


def _kind_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = cut(quality.tail_scores(cut(_stats(spark, d))))
    weights = quality.kind_weights(scored)
    return quality.kind_scores(scored, np.zeros((len(quality.TELLS) + 1, len(quality.KINDS))) if weights is None else weights)


@query()
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.kinds(_kind_scores(spark, d))


@query()
def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d)


@query(O.COUNTS)
def p10_counts(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every document that SQL can count too."""
    return _stats(spark, d).select("doc_id", "lang_key", *O.COUNTED)


@query(O.TAILS)
def p10_tails(spark: SparkSession, d: str) -> DataFrame:
    """The exact tail probability of every value in each language; steps from FAR on are one value, as in the SQL."""
    tells = {s: quality.TELLS[s] for s in O.RANKED}
    rows = quality.exact_tails(quality.value_counts(quality.grouped(_stats(spark, d)), tells))
    # the share of texts at FAR or beyond is the largest of the tails there
    rows = rows.groupBy("stat", "grp", F.least("value", F.lit(quality.FAR)).alias("value")).agg(F.max("tail").alias("tail"))
    return rows.select(F.element_at(F.array(*[F.lit(s) for s in tells]), F.col("stat") + 1).alias("stat"), "grp", "value", "tail")


@query()
def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _kind_scores(spark, d).select("doc_id", "list_score", "table_score", "junk_score")


# ---------------------------------------------------------------- 4: near-duplicate records


def _near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    texts = F.concat(F.coalesce(F.col("turns.text"), empty), F.coalesce(F.col("label.options"), empty))
    return neardup.near_duplicates(table(spark, d, "hinglish_spot_check").select("line_no", texts.alias("texts")), "line_no", "texts")


@query(O.NEAR)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _near_duplicates(spark, d).filter("id <> group_id").select(F.col("group_id").alias("line_a"), F.col("id").alias("line_b"))


@query(O.NEAR_GROUPS)
def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with its class of copies and its group."""
    return _near_duplicates(spark, d)


# ---------------------------------------------------------------- 5: languages


def _language_model(spark: SparkSession, d: str) -> langid.ByteCNN:
    docs = table(spark, d, "documents").select(F.lit("documents").alias("source"), langid.language_name(F.col("lang")).alias("lang"), "text")
    corpus = table(spark, d, "hinglish_spot_check").select("turns.text", "delivery.language_mix")
    # a mixed record may hold English sentences, so only one-sentence records teach what a mixed sentence is
    single = (F.size("text") == 1) & ~F.get("text", F.lit(0)).rlike(r"[.?!।]\s")
    turns = corpus.filter(F.col("language_mix").isNotNull() & (~F.col("language_mix") | single)).select(F.lit("turns").alias("source"), F.when(F.col("language_mix"), "hinglish").otherwise("en").alias("lang"), F.array_join("text", "\n").alias("text"))
    return langid.train(docs.unionByName(turns))


def _record_sentences(spark: SparkSession, d: str, model: langid.ByteCNN) -> DataFrame:
    return langid.segments(turn_texts(spark, d, "hinglish_spot_check", "line_no").withColumnRenamed("rec_no", "rec"), model, "sentence")


def _document_lines(spark: SparkSession, d: str, model: langid.ByteCNN) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("rec"), F.array("text").alias("texts"))
    return langid.segments(docs, model, "line")


def _prose_lines(spark: SparkSession, d: str, model: langid.ByteCNN) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("rec"), F.array("text").alias("texts"))
    return langid.segments(docs, model, "line", skip=lambda t: quality.plainly(t) is not None)


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    model = _language_model(spark, d)
    corpus = table(spark, d, "hinglish_spot_check")
    segs = _record_sentences(spark, d, model)
    flags = corpus.select(F.col("line_no").alias("rec"), F.col("delivery.language_mix").alias("mix"))
    records = langid.record_language(segs).join(flags, "rec").filter(F.col("mix").isNull() | (F.col("mix") != (F.col("lang") == "hinglish")))
    labels = table(spark, d, "documents").select(F.col("doc_id").alias("rec"), F.coalesce(langid.language_name(F.col("lang")), F.lit("")).alias("label"))
    lines = _prose_lines(spark, d, model).filter("n_words >= 6").groupBy("rec", "lang").agg(F.max("confidence").alias("confidence"))
    # a line in a language that the model does not know contradicts no label by name
    wrong = lines.join(labels, "rec").filter(F.col("lang") != langid.OTHER).filter("lang <> label")
    a = records.select(F.lit("hinglish_spot_check").alias("tbl"), F.col("rec").alias("rec_no"), "lang")
    return a.unionByName(wrong.select(F.lit("documents").alias("tbl"), F.col("rec").alias("rec_no"), "lang"))


@query()
def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its language; null where no segment has letters."""
    found = langid.record_language(_record_sentences(spark, d, _language_model(spark, d)))
    records = table(spark, d, "hinglish_spot_check").select(F.col("line_no").alias("rec"))
    return records.join(found, "rec", "left").select(F.col("rec").alias("line_no"), "lang", "confidence")


@query()
def p5_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document, lists, tables and junk too, with its language; null where no line has letters."""
    found = langid.document_language(_document_lines(spark, d, _language_model(spark, d)))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("rec"))
    return docs.join(found, "rec", "left").select(F.col("rec").alias("doc_id"), "lang", "confidence")


@query()
def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of the records and every line of the documents; only blank ones are left out."""
    model = _language_model(spark, d)
    sentences = _record_sentences(spark, d, model).select(F.lit("hinglish_spot_check").alias("tbl"), "*")
    return sentences.unionByName(_document_lines(spark, d, model).select(F.lit("documents").alias("tbl"), "*"))


# ---------------------------------------------------------------- 6: broken prompt-response pairs


@query()
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    corpus = table(spark, d, "hinglish_spot_check").select(
        F.col("line_no").alias("rec"), F.col("turns.text").alias("texts"), F.col("label.options").alias("options"), F.col("label.contains_violation").alias("due")
    )
    return defects.defective(corpus).select(F.col("rec").alias("line_no"), "option_no", "defect")


# ---------------------------------------------------------------- 1: personal information


def _records(spark: SparkSession, d: str) -> DataFrame:
    parts = [turn_texts(spark, d, tbl, key).select(F.lit(tbl).alias("tbl"), "rec_no", "texts") for tbl, key in TURN_TABLES]
    return parts[0].unionByName(parts[1])


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.disclosed_spans(_records(spark, d)).select("tbl", "rec_no", "turn_no", F.col("kind").alias("pii_type")).distinct()


@query()
def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted_turns(_records(spark, d))
