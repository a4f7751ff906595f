"""Moderation of conversations in batch: canonical text, features, stateful decisions, decision log.

Everything stateless is a Column expression. The stateful part runs once over rows that are laid out by stretches of a
sender's activity and sorted by time: a gap of 600 s outlives every lifetime, so stretches are independent, and rows
stream through the fold without being collected. Only raw messages are shuffled; features are made where they are used.

Defined results: a message delivered again counts once, by its earliest receipt; null text is the empty text; a null
sender is a sender of its own in its room; a message without a time has no history and leaves none; order within a
sender is (ts, msg_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater import constants as K
from tidewater.functions import features as X
from tidewater.functions import text as T
from tidewater.operators import state as S
from tidewater.operators.ranking import bucket_of, stretches
from tidewater.runtime import parallelism

STATELESS = "room_id string, sender_id string, msg_id string, speaker string, ts timestamp, stretch long, final_text string, max_digit_run int, digits string, digit_density double, contact_kw_score double, pattern_score double, link_suspicion_score double, platform boolean, handle boolean"
DECISION = STATELESS + ", history_score double, cross_turn_platform_score double, score int, tier string, logged_tier string, action string, log_action string, reason string, options array<string>, escalated_from_suspicion boolean"


def first_deliveries(messages: DataFrame) -> DataFrame:
    """One row for each msg_id: the earliest received, of equal ones the earliest sent, then by the other columns (nulls
    first); rows without msg_id stay."""
    rest = [c for c in messages.columns if c != "msg_id"]
    last = F.timestamp_seconds(F.lit(32503680000))
    pick = F.struct(*[F.coalesce(F.col(c).cast("timestamp"), last).alias(f"__{c}") for c in ("received_at", "ts")], "room_id", "sender_id", "speaker", "text")
    once = messages.filter("msg_id IS NOT NULL").groupBy("msg_id").agg(F.min_by(F.struct(*rest), pick).alias("m")).select("msg_id", "m.*")
    return once.select(*messages.columns).unionByName(messages.filter("msg_id IS NULL"))


def state_key() -> Column:
    """The sender, or for a null sender its room."""
    return F.coalesce("sender_id", F.concat(F.lit("\0"), F.coalesce("room_id", F.lit(""))))


def stateless_features(messages: DataFrame, variant: str = "pipeline", keep: tuple[str, ...] = ()) -> DataFrame:
    """room_id, sender_id, msg_id, speaker, ts, final_text, the features that need no history, and the columns of `keep`."""
    # a cast would lose the watermark of a stream, so it is made only where it is needed
    ts = F.col("ts") if dict(messages.dtypes)["ts"] == "timestamp" else F.col("ts").cast("timestamp").alias("ts")
    picked = messages.select("room_id", "sender_id", "msg_id", F.lower(F.trim("speaker")).alias("speaker"), ts, F.coalesce("text", F.lit("")).alias("text"), *keep)
    t = F.col("final_text")
    return T.phase1(picked, "text", variant).select(
        "room_id", "sender_id", "msg_id", "speaker", "ts", "final_text",
        X.max_digit_run(t).alias("max_digit_run"), X.all_digits(t).alias("digits"), X.digit_density(t).alias("digit_density"),
        X.contact_kw_score(t).alias("contact_kw_score"), X.pattern_score(t).alias("pattern_score"), X.link_suspicion_score(t).alias("link_suspicion_score"),
        X.has_platform(t).alias("platform"), X.has_handle(t).alias("handle"), *keep,
    )


def fold(rows: Iterator[pd.DataFrame], provider: S.Provider) -> Iterator[pd.DataFrame]:
    """Runs the state machine over sorted rows; the state is dropped where the stretch changes."""
    key, state = None, S.Sender()
    for batch in rows:
        out = []
        at_us = batch["ts"].astype("datetime64[us]").astype("int64")
        for r, at in zip(batch.itertuples(index=False), at_us):
            now = (r.sender_id if r.sender_id is not None else f"\0{r.room_id}", r.stretch)
            if key != now or pd.isna(r.ts):
                key, state = now, S.Sender()
            m = S.Message(
                str(r.room_id), r.msg_id, r.speaker, r.final_text, 0 if pd.isna(r.ts) else int(at), int(r.max_digit_run), r.digits, r.contact_kw_score, r.pattern_score,
                r.link_suspicion_score, bool(r.platform), bool(r.handle),
            )
            out.append(S.step(state, m, provider))
            if len(state.rooms) > 64:
                state.expire(m.at)
        got = pd.DataFrame(out, columns=["history_score", "cross_turn_platform_score", "score", "tier", "logged_tier", "action", "log_action", "reason", "options", "escalated_from_suspicion"])
        yield pd.concat([batch.reset_index(drop=True), got], axis=1)


def decisions(messages: DataFrame, provider: S.Provider = S.stub_provider, variant: str = "pipeline") -> DataFrame:
    """One row per message with its features, decision and what the log says. `messages` has room_id, sender_id,
    msg_id, speaker, text, ts, received_at."""
    # other columns of the input, whatever their names, stay out
    messages = messages.select("room_id", "sender_id", "msg_id", "speaker", "text", "ts", "received_at")
    # stretches may come from all deliveries: more rows only make them coarser, and the scan reads three columns
    active = stretches(messages.select(state_key().alias("__s"), F.col("ts").cast("timestamp").alias("ts")), "__s", "ts", K.SUSPICION_TTL)
    rows = first_deliveries(messages).withColumn("__s", state_key()).withColumn("bucket", bucket_of(F.col("ts").cast("timestamp"), K.SUSPICION_TTL))
    rows = rows.join(active, ["__s", "bucket"])
    # a stretch of a sender is one unit of work; its texts meet in one partition, become features there and stream
    # through the fold in order
    laid = rows.repartition(parallelism(messages.sparkSession), "__s", "stretch")
    feats = stateless_features(laid, variant, keep=("__s", "stretch"))
    laid = feats.sortWithinPartitions("__s", "stretch", "ts", "msg_id").select(*[c.split()[0] for c in STATELESS.split(", ")])
    out = laid.mapInPandas(lambda it: fold(it, provider), DECISION)
    masked = X.soft_mask(F.col("final_text"), F.col("cross_turn_platform_score"), F.col("max_digit_run"), F.col("history_score"))
    text = F.when(F.col("action") == "pass", F.col("final_text")).when(F.col("action") == "soft_mask", masked)
    return out.withColumn("text", text).drop("stretch", "digits", "platform", "handle")


def decision_log(decided: DataFrame) -> DataFrame:
    """The log record of each decision; its time is the message's own."""
    feats = ["max_digit_run", "digit_density", "contact_kw_score", "pattern_score", "history_score", "link_suspicion_score", "cross_turn_platform_score"]
    return decided.select(
        "msg_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("logged_at"), F.col("logged_tier").alias("tier"), "score",
        F.struct(*feats).alias("features"), F.col("log_action").alias("action"), "reason",
    )


def testcase_messages(cases: DataFrame) -> DataFrame:
    """Messages of a scenario suite: one sender and room per case, turns a second apart."""
    turns = cases.select("case_no", "id", "category", F.posexplode("turns").alias("p", "t"))
    turn = (F.col("p") + 1).cast("int")
    name = F.concat_ws("_", "id", F.col("case_no").cast("string"))
    return turns.select(
        "case_no", "category", turn.alias("turn"), F.concat(F.lit("testcase_room_"), name).alias("room_id"), F.concat(F.lit("testcase_sender_"), name).alias("sender_id"),
        F.concat(name, F.lit("_turn_"), turn.cast("string")).alias("msg_id"), F.col("t.speaker").alias("speaker"), F.col("t.text").alias("text"),
        F.timestamp_seconds(F.lit(1_767_225_600) + turn).alias("ts"), F.lit(None).cast("timestamp").alias("received_at"),
    )


def testcase_log(cases: DataFrame, provider: S.Provider = S.stub_provider) -> DataFrame:
    """What the suite writes for each turn: case, category, turn, message, input and canonical text, decision."""
    messages = testcase_messages(cases)
    decided = decisions(messages.drop("case_no", "category", "turn"), provider).drop("room_id", "sender_id", "speaker", "ts").withColumnRenamed("text", "output_text")
    return messages.select("msg_id", "case_no", "category", "turn", "speaker", F.col("text").alias("input_text")).join(decided, "msg_id")


def _tiers(rows: DataFrame) -> list[Column]:
    return [F.count(F.when(F.col("tier") == t, 1)).alias(t) for t in ("low", "moderate", "high")]


def testcase_report(log: DataFrame) -> DataFrame:
    """Tier counts and message lists per case, over all turns of `testcase_log`."""
    ids = lambda t: F.transform(F.sort_array(F.collect_list(F.when(F.col("tier") == t, F.struct("turn", "msg_id")))), lambda x: x["msg_id"]).alias(f"{t}_ids")
    return log.groupBy("case_no", "category").agg(*_tiers(log), ids("low"), ids("moderate"), ids("high"))


def suite_totals(log: DataFrame) -> DataFrame:
    """Tier counts per category and over all (category null, overall 1); the lists are the log's rows by tier."""
    return log.rollup("category").agg(F.grouping("category").cast("int").alias("overall"), *_tiers(log))
