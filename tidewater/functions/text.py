"""Canonical text, span detection and redaction as Column expressions: no Python on the data path.

`phase1` composes the steps in their fixed order. Null text gives null everywhere; texts of any length are processed
whole.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater import constants as K

SPACE = r"[\s\x1c-\x1f]"


@lru_cache(1)
def unicode_folds() -> tuple[str, str, str]:
    """From Unicode's compatibility decompositions: characters that fold to one ASCII character and those characters,
    and a JSON map of the ones that fold to several."""
    one, to, many = [], [], {}
    for c in range(0x80, sys.maxunicode + 1):
        ch = chr(c)
        if 0xD800 <= c <= 0xDFFF or ch in "—–":
            continue
        folded = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            one.append(ch)
            to.append(folded)
        elif folded:
            many[ch] = folded
    return "".join(one), "".join(to), json.dumps(many)


def sanitize_unicode(c: Column) -> Column:
    """Drop zero-width characters, space out dashes, fold to ASCII by compatibility decomposition, drop the rest."""
    one, to, many = unicode_folds()
    t = F.regexp_replace(c, "[​-‏﻿]", "")
    t = F.replace(F.replace(t, F.lit("—"), F.lit("  ")), F.lit("–"), F.lit(" - "))
    t = F.translate(t, one, to)
    several = F.from_json(F.lit(many), "map<string,string>")
    spelled = F.array_join(F.transform(F.split(t, ""), lambda ch: F.coalesce(F.element_at(several, ch), ch)), "")
    t = F.when(t.rlike("[^\\x00-\\x7F]"), spelled).otherwise(t)
    # text that is ASCII already skips all of it
    return F.when(c.rlike("[^\\x00-\\x7F]"), F.regexp_replace(t, "[^\\x00-\\x7F]", "")).otherwise(c)


def despace_isolated(c: Column) -> Column:
    """Join characters that stand alone between spaces."""
    return F.regexp_replace(c, rf"(?<=\b[a-zA-Z0-9]){SPACE}+(?=[a-zA-Z0-9]\b)", "")


def despace_paths(c: Column) -> Column:
    """No space around slashes, nor around dots between letters or digits."""
    t = F.regexp_replace(c, rf"{SPACE}*/{SPACE}*", "/")
    return F.regexp_replace(t, rf"(?<=[a-zA-Z0-9]){SPACE}*\.{SPACE}*(?=[a-zA-Z0-9])", ".")


def flatten_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def words_to_digits(c: Column) -> Column:
    """Number words, exact, leet or misspelled by one letter (a ratio of 88 or more), become digits.

    For tokens of 3 to 7 letters that ratio is reached only by one inserted or dropped letter, on words of four letters
    that gained one or words of five.
    """
    words = F.array(*[F.lit(w) for w in K.NUMBER_WORDS])

    def fuzzy(n: Column) -> Column:
        near = lambda w: (
            (F.levenshtein(n, w) == 1) & (F.length(n) != F.length(w)) & (((F.length(w) == 4) & (F.length(n) == 5)) | (F.length(w) == 5))
        )
        return F.array_position(F.transform(words, near), F.lit(True))

    def digit(token: Column) -> Column:
        low = F.lower(token)
        exact = F.array_position(words, low)
        leet = F.translate(low, K.LEET_DIGITS, K.LEET_LETTERS)
        leet_exact = F.array_position(words, leet)
        skip = low.rlike(r"^\d+$") | ~F.length(low).between(3, 7)
        number = lambda at: (at - 1).cast("string")
        return (
            F.when(~token.rlike("^[A-Za-z0-9]+$"), token)
            .when(exact > 0, number(exact))
            .when(skip, token)
            .when(leet_exact > 0, number(leet_exact))
            .when(fuzzy(leet) > 0, number(fuzzy(leet)))
            .otherwise(token)
        )

    tokens = F.regexp_extract_all(c, F.lit(r"(\w+|\W+)"), F.lit(1))
    return F.array_join(F.transform(tokens, digit), "")


def substitute_verbal(c: Column) -> Column:
    """'at' and 'dot' spelled between spaces or brackets become their signs, without spaces around them."""
    t = F.regexp_replace(c, rf"(?i)[\s\[\(\{{<]*({K.AT_WORDS})[\s\]\)\}}>]+", "@")
    t = F.regexp_replace(t, rf"(?i)[\s\[\(\{{<]*({K.DOT_WORDS})[\s\]\)\}}>]+", ".")
    t = F.regexp_replace(t, rf"{SPACE}*@{SPACE}*", "@")
    return F.regexp_replace(t, rf"{SPACE}*\.{SPACE}*", ".")


def revert_verbal(c: Column) -> Column:
    return F.replace(c, F.lit("@"), F.lit(" at "))


SPAN = "struct<type:string,start:int,end:int,value:string,confidence:string>"


def _matches(c: Column, pattern: str, kind: str) -> Column:
    """Spans of all matches of a pattern without anchors: each value's first place at or after the last end is its
    match, so offsets follow from the values."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, v: Column) -> Column:
        at = F.call_function("locate", v, c, acc["at"] + 1) - 1
        end = at + F.length(v)
        span = F.struct(F.lit(kind).alias("type"), at.cast("int").alias("start"), end.cast("int").alias("end"), v.alias("value"), F.lit("high").alias("confidence"))
        return F.struct(end.cast("int").alias("at"), F.array_append(acc["spans"], span.cast(SPAN)).alias("spans"))

    return F.aggregate(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), start, step)["spans"]


def detect_spans(c: Column, variant: str = "pipeline") -> Column:
    """E-mail spans, then URL spans that do not start inside one; the pipeline variant extends URLs over a path that
    follows within 60 characters."""
    mails = _matches(c, K.EMAIL, "EMAIL")
    urls = _matches(c, K.URL[variant], "URL")
    urls = F.filter(urls, lambda u: ~F.exists(mails, lambda m: (m["start"] <= u["start"]) & (u["start"] < m["end"])))
    if variant == "pipeline":

        def stitch(u: Column) -> Column:
            more = F.regexp_extract(F.substring(c, u["end"] + 1, F.lit(60)), K.PATH_CONTINUATION, 0)
            end = (u["end"] + F.length(more)).cast("int")
            return F.struct(
                u["type"].alias("type"), u["start"].alias("start"), end.alias("end"), F.substring(c, u["start"] + 1, end - u["start"]).alias("value"), u["confidence"].alias("confidence")
            )

        urls = F.transform(urls, stitch)
    return F.concat(mails, urls)


def mask_spans(c: Column, spans: Column) -> Column:
    """Splice [REDACTED_TYPE] over each span, from the last start to the first, by the original offsets."""
    by_start = F.transform(spans, lambda s, i: F.struct((-s["start"]).alias("k"), i.alias("i"), s.alias("s")))
    return F.aggregate(
        F.array_sort(by_start), c, lambda t, x: F.concat(F.substring(t, F.lit(1), x["s"]["start"]), F.concat(F.lit("[REDACTED_"), x["s"]["type"], F.lit("]")), F.substring(t, x["s"]["end"] + 1, F.length(t)))
    )


def canonical(df, text: str, out: str, variant: str = "pipeline"):
    """Adds `out`, the canonical text before detection. Steps are staged in separate projections, so that expressions
    that are used several times are not written out several times."""
    df = df.withColumn(out, sanitize_unicode(F.col(f"`{text}`")))
    df = df.withColumn(out, flatten_whitespace(despace_paths(despace_isolated(F.col(out)))))
    df = df.withColumn(out, words_to_digits(F.col(out)))
    if variant == "pipeline":
        df = df.withColumn(out, despace_isolated(F.col(out)))
    return df.withColumn(out, substitute_verbal(F.col(out)))


def phase1(df, text: str = "text", variant: str = "pipeline"):
    """Adds final_text, spans_detected and, in the pipeline variant, deterministic_match."""
    df = canonical(df, text, "__canonical", variant)
    df = df.withColumn("spans_detected", F.when(F.col("__canonical").isNotNull(), detect_spans(F.col("__canonical"), variant)))
    df = df.withColumn("final_text", revert_verbal(mask_spans(F.col("__canonical"), F.col("spans_detected"))))
    if variant == "pipeline":
        df = df.withColumn("deterministic_match", F.size("spans_detected") > 0)
    return df.drop("__canonical")
