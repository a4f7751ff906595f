"""Canonical text, spans, redaction and scores against expected strings and plain-Python specifications."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidewater import constants as K
from tidewater import queries
from tidewater.functions import features as X
from tidewater.functions import text as T
from tidewater.functions.register import register
from tidewater.operators import state as S

FINAL = [
    ("ring the cabin on 5️⃣0️⃣1️⃣7️⃣ before dusk", "ring the cabin on 5017 before dusk", 0),
    ("billing: clerk dot ferry at depot dot org, thanks", "billing: [REDACTED_EMAIL], thanks", 1),
    ("post it to mira (at) ledger [d0t] net today", "post it to [REDACTED_EMAIL] today", 1),
    ("write k e n 4 2 @ m i l l . i o", "write [REDACTED_EMAIL]", 1),
    ("rooms shown on t.me / ferry_house", "rooms shown on [REDACTED_URL]", 1),
    ("dinner at six at the pier", "dinner at 6 at the pier", 0),
    ("book on pier.org or write desk_7@ferry.net", "book on [REDACTED_URL] or write [REDACTED_EMAIL]", 2),
    ("s1x lamps and f0ur rugs", "6 lamps and 4 rugs", 0),
    ("the flat boat", "the fl at boat", 0),
    ("", "", 0),
    (None, None, None),
]


@pytest.mark.parametrize("variant", ["pipeline", "standalone"])
def test_final_text(spark, variant):
    df = spark.createDataFrame(FINAL, "text string, want string, n int")
    for r in T.phase1(df, "text", variant).collect():
        assert r.final_text == r.want
        assert (len(r.spans_detected) if r.spans_detected is not None else None) == r.n


def test_unicode_folding_is_compatibility_decomposition(spark):
    def spec(t):
        t = re.sub("[​-‏﻿]", "", t).replace("—", " — ").replace("–", " - ")
        return unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()

    rng = random.Random(3)
    pool = [chr(c) for c in [*range(0x20, 0x250), *range(0x2000, 0x2200), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F), 0x1D400, 0x1F600, 0x0915, 0x200B, 0xFEFF]]
    texts = ["".join(rng.choices(pool, k=20)) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.sanitize_unicode(F.col("t")).alias("o")).collect()
    assert [r.o for r in got] == [spec(t) for t in texts]


def test_number_words(spark):
    cases = {"tw0": "2", "e1ght lamps": "8 lamps", "three-four": "3-4", "zeros": "0", "fours": "4", "threee": "3", "nin": "nin", "ten tents": "ten tents", "seven_b": "seven_b", "sixx": "sixx"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.words_to_digits(F.col("t")).alias("o")).collect()
    assert {r.t: r.o for r in got} == cases


def test_overlapping_spans_are_spliced_by_original_offsets(spark):
    r = T.phase1(spark.createDataFrame([("see https://x.com/a@b.com now",)], "text string")).first()
    assert [s.type for s in r.spans_detected] == ["EMAIL", "URL"]
    assert "[REDACTED_URL]" in r.final_text


def test_score_rounds_half_even_in_doubles(spark):
    rows = [(3, 0.5, 0.0, 0.6, 0.0, 0.2, 29), (0, 0.5, 0.0, 0.0, 0.0, 0.0, 10), (0, 0.5, 0.0, 0.7, 0.0, 0.0, 35), (10, 1.0, 1.0, 1.0, 1.0, 1.0, 100), (0, 0.5, 0.0, 0.0, 0.0, 1.0, 35)]
    df = spark.createDataFrame(rows, "run int, kw double, pat double, hist double, link double, plat double, want int")
    for r in df.withColumn("s", X.risk_score(*[F.col(c) for c in ("run", "kw", "pat", "hist", "link", "plat")])).collect():
        assert r.s == r.want


def test_masks_and_gate(spark):
    r = spark.createDataFrame([("call 98২ on insta my_handle", ["seven 1234567 x y", "keep it here please", "१२३४५६७ no no no"])], "t string, o array<string>").select(
        X.mask_digits(F.col("t")).alias("d"), X.mask_handles(F.col("t")).alias("h"), X.gate_options(F.col("o")).alias("g")
    ).first()
    assert r.d == "call ███ on insta my_handle" and r.h.endswith("insta █████████") and r.g == ["keep it here please"]


def test_replies_fail_closed(spark):
    four = '["a b c d", "a b c d", "a b c d"]'
    cases = [
        (f'{{"contains_violation": true, "options": {four}}}', True, True, 3), ('{"contains_violation": true, "options": ["a b c d"]}', True, False, 0),
        ('{"contains_violation": false, "options": [1]}', False, True, 0), ('{"options": []}', True, False, 0), ("nope", True, False, 0), (None, True, False, 0),
        (f'{{"contains_violation": "false", "options": {four}}}', True, True, 3), ('{"contains_violation": true, "options": null}', True, False, 0),
        ('{"contains_violation": true, "options": [{"text": "a b c d"}, "a b c d", "a b c d"]}', True, False, 0),
    ]
    from tidewater.sources.providers import checked

    df = spark.createDataFrame([(c[0],) for c in cases], "c string").select(X.validated_response(F.col("c")).alias("r"))
    for got, (content, violation, valid, n) in zip(df.collect(), cases):
        assert (got.r.contains_violation, got.r.valid, len(got.r.options)) == (violation, valid, n)
        own = checked(content)
        assert (own["contains_violation"], own["valid"], len(own["options"])) == (violation, valid, n)


def test_one_rule_wherever_it_is_written(spark):
    """The state machine runs in Python, the reports in columns: both must give the same scores, tiers, gates, replies."""
    rng = random.Random(5)
    rows = [(rng.randint(0, 14), rng.choice([0.35, 0.5, 0.65, 1.0]), rng.choice([0.0, 1.0]), rng.randint(0, 10) / 10, rng.choice([0.0, 0.3, 1.0]), rng.choice([0.0, 0.2, 1.0])) for _ in range(400)]
    df = spark.createDataFrame(rows, "a int, b double, c double, d double, e double, f double").withColumn("s", X.risk_score(*[F.col(c) for c in "abcdef"]))
    assert all(r.s == S.score(*r[:6]) and r.t == S.tier(r.s) for r in df.withColumn("t", X.tier(F.col("s"))).collect())
    options = ["1234567", "123 4567", "१२३४५६७", "x" * 9, "𝟗" * 6, ""]
    kept = spark.createDataFrame([(options,)], "o array<string>").select(X.gate_options(F.col("o"))).first()[0]
    assert kept == S.kept_options(options) == ["123 4567", "x" * 9, "𝟗" * 6, ""]


def test_sql_functions(spark):
    names = register(spark)
    assert {"normalize_text", "detect_spans", "redact", "risk_score", "risk_tier", "soft_mask"} <= set(names)
    assert spark.sql("SELECT flatten_whitespace('a \t b') a, risk_tier(64) t, contact_kw_score('call me') k, risk_score(3, 0.5D, 0D, 0.6D, 0D, 0.2D) s, risk_score(null, 0.5D, 0D, 0.6D, 0D, 0.2D) n").first() == ("a b", "moderate", 0.65, 29, None)
    texts = [t for t, _, _ in FINAL] + ["see https://x.com/a@b.com now", "½ ｆｉｖｅ ﬁ — ok", "my_handle on insta 98"]
    spark.createDataFrame([(t,) for t in texts], "text string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT text, redact(text) r, detect_spans(text) s, normalize_text(text) n, soft_mask(text, 0.2D, 1, 0D) m FROM texts")
    want = T.phase1(T.canonical(spark.table("texts"), "text", "n")).select("text", F.col("final_text").alias("r"), F.col("spans_detected").alias("s"), "n", X.soft_mask(F.col("text"), F.lit(0.2), F.lit(1), F.lit(0.0)).alias("m"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert len(K.WEIGHTS) == 6


def test_masking_queries_run_over_every_row(spark, tmp_path):
    texts = ["call 98 now", "call ९८ now", "Ｎｏ ９８", "é 1", "𝟗 and ²", "", None]
    spark.createDataFrame(list(enumerate(texts)), "msg_id long, text string").write.parquet(str(tmp_path / "messages.parquet"))
    options = [["a 1234567", "b"], ["९८७६५४३२१", "café 123456", None], ["１２３４５６７"], ["𝟗" * 7, "é"], [], None]
    rows = [(i, (o,)) for i, o in enumerate(options)] + [(6, None)]
    spark.createDataFrame(rows, "line_no long, label struct<options: array<string>>").write.parquet(str(tmp_path / "hinglish_spot_check.parquet"))

    def brute(t):
        return None if t is None else "".join("█" if unicodedata.category(c) == "Nd" else c for c in t)

    got = {r.msg_id: r.text for r in queries.QUERIES["mask_digits"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    kept = {i: None if o is None else sum(o_ is not None and "█" * 7 not in brute(o_) for o_ in o) for i, o in enumerate(options)} | {6: None}
    assert {r.line_no: r.kept for r in queries.QUERIES["option_gate"](spark, str(tmp_path)).collect()} == kept == {0: 1, 1: 1, 2: 0, 3: 1, 4: 0, 5: None, 6: None}
