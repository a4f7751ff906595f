"""The same decisions as a stream: stateless features as columns, the state machine per sender with event time.

Rows of a sender inside one micro-batch are sorted before they step the state; the state is evicted once the watermark
has passed every lifetime. Rows later than the watermark are dropped by Spark, the others step the state in the order
in which their batches arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewater import constants as K
from tidewater.operators import state as S
from tidewater.plans.moderation import state_key, stateless_features


def stream_decisions(messages: DataFrame, watermark: str = "10 minutes", provider: S.Provider = S.stub_provider) -> DataFrame:
    """`messages` is a streaming DataFrame with the columns of the batch plan; gives its decisions, in append mode."""
    rows = messages.withColumn("sender_id", state_key()).filter("ts IS NOT NULL")
    # messages without an id are no copies of each other: each gets a key that never comes again
    once = rows.withColumn("__id", F.coalesce(F.concat(F.lit("m"), "msg_id"), F.uuid())).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["__id"])
    feats = stateless_features(once)
    out = "room_id string, sender_id string, msg_id string, ts timestamp, final_text string, history_score double, cross_turn_platform_score double, score int, tier string, logged_tier string, action string, log_action string, reason string, options array<string>, escalated_from_suspicion boolean"
    names = [c.split()[0] for c in out.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        sender = S.Sender.loads(state.get[0] if state.exists else None)
        pdf = pd.concat(list(batches)).sort_values(["ts", "msg_id"])
        rows, last = [], 0
        for r in pdf.itertuples(index=False):
            at = int(r.ts.value // 1000)
            m = S.Message(str(r.room_id), r.msg_id, r.speaker, r.final_text, at, int(r.max_digit_run), r.digits, r.contact_kw_score, r.pattern_score, r.link_suspicion_score, bool(r.platform), bool(r.handle))
            got = S.step(sender, m, provider)
            rows.append({"room_id": r.room_id, "sender_id": r.sender_id, "msg_id": r.msg_id, "ts": r.ts, "final_text": r.final_text, **got})
            last = max(last, at)
        sender.expire(last)
        state.update((sender.dumps(),))
        due = last // 1000 + K.SUSPICION_TTL * 1000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=names)

    return feats.groupBy("sender_id").applyInPandasWithState(run, out, "state string", "append", GroupStateTimeout.EventTimeTimeout)
