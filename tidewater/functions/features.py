"""Features, score, tier and masks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater import constants as K


def digit_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))


def max_digit_run(c: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(digit_runs(c), F.length)), F.lit(0))


def all_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def digit_density(c: Column) -> Column:
    return F.length(all_digits(c)) / F.greatest(F.length(c), F.lit(1))


def keywords_present(c: Column, keywords: list[str]) -> Column:
    return sum((F.contains(F.lower(c), F.lit(k)).cast("int") for k in keywords), F.lit(0))


def contact_kw_score(c: Column) -> Column:
    raw = F.lit(0.5) + F.lit(0.15) * keywords_present(c, K.CONTACT_KEYWORDS) - F.lit(0.15) * keywords_present(c, K.QUANTITY_KEYWORDS)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def pattern_score(c: Column) -> Column:
    return F.when(c.rlike(K.PHONE_SHAPE), 1.0).otherwise(0.0)


def link_suspicion_score(c: Column) -> Column:
    """1.0 if something like a path stands within 40 characters after a domain, 0.3 for a domain alone."""
    near = c.rlike(K.DOMAIN + r"(?=(?s:.{0,38})/\S)")
    return F.when(near, 1.0).when(c.rlike(K.DOMAIN), 0.3).otherwise(0.0)


def has_platform(c: Column) -> Column:
    low = F.lower(c)
    return F.exists(F.array(*[F.lit(k) for k in K.PLATFORM_KEYWORDS]), lambda k: F.contains(low, k))


def has_handle(c: Column) -> Column:
    """The whole text is one token of a handle's shape without a platform word."""
    t = F.regexp_replace(c, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return t.rlike(K.BARE_HANDLE) & ~has_platform(t)


def risk_score(run: Column, contact: Column, pattern: Column, history: Column, link: Column, platform: Column) -> Column:
    """The weighted sum, added left to right in doubles and rounded half to even; floors, then the cap of 100."""
    parts = {"run": F.least(run / F.lit(10.0), F.lit(1.0)), "contact": contact, "pattern": pattern, "history": history, "link": link, "platform": platform}
    raw = None
    for name, weight in K.WEIGHTS:
        term = F.lit(weight) * parts[name].cast("double")
        raw = term if raw is None else raw + term
    score = F.rint(raw * 100).cast("int")
    score = F.when(history.cast("double") >= K.HISTORY_FLOOR_AT, F.greatest(score, F.lit(K.FLOOR))).otherwise(score)
    score = F.when(platform.cast("double") >= K.PLATFORM_FLOOR_AT, F.greatest(score, F.lit(K.FLOOR))).otherwise(score)
    # greatest and least pass over nulls, so a missing feature must be told apart
    return F.when(raw.isNotNull() & run.isNotNull(), F.least(score, F.lit(100)))


def tier(score: Column) -> Column:
    return F.when(score < K.LOW_BELOW, "low").when(score < K.HIGH_FROM, "moderate").when(score.isNotNull(), "high")


def mask_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\d", "█")


def mask_handles(c: Column) -> Column:
    tokens = F.regexp_extract_all(c, F.lit(r"(\S+|\s+)"), F.lit(1))
    hide = lambda t: F.when(t.rlike(K.BARE_HANDLE) & ~has_platform(t), F.repeat(F.lit("█"), F.length(t))).otherwise(t)
    return F.array_join(F.transform(tokens, hide), "")


def soft_mask(c: Column, platform: Column, run: Column, history: Column) -> Column:
    t = F.when(platform >= 0.2, mask_handles(c)).otherwise(c)
    return F.when((run > 0) | (history > 0), mask_digits(t)).otherwise(t)


def gate_options(options: Column) -> Column:
    """Options without a run of seven digits or more."""
    return F.filter(options, lambda o: ~o.rlike(rf"(?U)\d{{{K.GATE_DIGITS},}}"))


def words_in(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"[\p{Z}\s\x1c-\x1f]+"), lambda w: w != ""))


def option_defect(violation: Column, options: Column) -> Column:
    """The first reason to flag a record's options, or null."""
    # The reasons, word for word.
    n = F.coalesce(F.size(options), F.lit(0))
    n = F.greatest(n, F.lit(0))
    short = F.exists(options, lambda o: words_in(o) < K.OPTION_MIN_WORDS)
    return (
        F.when(~violation & (n > 0), "non-violation has options")
        .when(violation & (n != K.OPTION_COUNT), F.concat(F.lit(f"expected {K.OPTION_COUNT} options, got "), n.cast("string")))
        .when(violation & short, "option too short")
    )


def render_turns(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.coalesce(t["speaker"], F.lit("")), F.lit(": "), F.coalesce(t["text"], F.lit("")))), "\n")


def validated_response(content: Column) -> Column:
    """A language-model reply checked against its contract: struct(contains_violation, options, valid, fallback_reason).

    A reply that is no object, lacks a key, or has a violation without exactly three texts of four words or more falls
    back to a violation without options."""
    v = F.try_parse_json(content)
    kind = F.schema_of_variant(F.try_variant_get(v, "$.contains_violation", "variant"))
    flag = F.try_variant_get(v, "$.contains_violation", "string")
    truthy = F.when(kind == "BOOLEAN", flag == "true").when(kind == "STRING", flag != "").when(kind == "VOID", False).otherwise(~flag.isin("0", "0.0"))
    listed = F.try_variant_get(v, "$.options", "array<variant>")
    # a number or object turns into text when it is read as string, so its type is looked at first
    texts = F.coalesce(F.forall(listed, lambda o: F.coalesce(F.schema_of_variant(o) == "STRING", F.lit(False))), F.lit(False))
    options = F.try_variant_get(v, "$.options", "array<string>")
    fallback = lambda why: F.struct(F.lit(True).alias("contains_violation"), F.array().cast("array<string>").alias("options"), F.lit(False).alias("valid"), F.lit(why).alias("fallback_reason"))
    good = lambda flag, options: F.struct(flag.alias("contains_violation"), options.alias("options"), F.lit(True).alias("valid"), F.lit(None).cast("string").alias("fallback_reason"))
    return (
        F.when(v.isNull() | (F.schema_of_variant(v).startswith("OBJECT") == F.lit(False)), fallback("not valid JSON"))
        .when(kind.isNull() | F.try_variant_get(v, "$.options", "variant").isNull(), fallback("missing key"))
        .when(~truthy, good(F.lit(False), F.array().cast("array<string>")))
        .when(options.isNull() | (F.size(options) != K.OPTION_COUNT), fallback("wrong number of options"))
        .when(~texts | F.exists(options, lambda o: o.isNull() | (words_in(o) < K.OPTION_MIN_WORDS)), fallback("option too short"))
        .otherwise(good(F.lit(True), options))
    )
