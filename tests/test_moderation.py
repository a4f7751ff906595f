"""The state machine: lifetimes at their edges, feedback of escalation, batch against a plain fold, stream against batch."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidewater.operators import ranking
from tidewater.operators import state as S
from tidewater.plans import moderation as M
from tidewater.streaming.moderation import stream_decisions

SCHEMA = "room_id string, sender_id string, msg_id string, speaker string, text string, ts timestamp, received_at timestamp"
T0 = dt.datetime(2026, 1, 1)


def msg(i, text, seconds, room="r", sender="s", received=None):
    at = T0 + dt.timedelta(seconds=seconds) if seconds is not None else None
    return (room, sender, f"m{i:04d}", "guest", text, at, received)


def decide(spark, rows):
    return {r.msg_id: r for r in M.decisions(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_digit_window_expires_at_its_lifetime(spark):
    got = decide(spark, [msg(1, "my 123", 0), msg(2, "plain text here", 119.999), msg(3, "my 123", 1000, "q"), msg(4, "plain text here", 1120, "q")])
    assert got["m0002"].history_score == 0.3 and got["m0004"].history_score == 0.0


def test_split_number_raises_the_tier(spark):
    got = decide(spark, [msg(1, "fine, in a moment", 0), msg(2, "two zero five", 5), msg(3, "318", 10), msg(4, "4477", 15)])
    assert [got[f"m000{i}"].score for i in (1, 2, 3, 4)] == [10, 24, 29, 37]
    assert got["m0004"].action == "soft_mask" and got["m0004"].text == "████"


def test_third_moderate_escalates_itself_and_clears_history(spark):
    got = decide(spark, [msg(i, "my code 123456789", 10 * i, room=f"r{i}") for i in range(1, 4)] + [msg(9, "hello there you", 45, room="r3")])
    assert [got[f"m000{i}"].action for i in (1, 2, 3)] == ["soft_mask", "soft_mask", "llm_escalation"]
    assert got["m0003"].reason == "escalated_by_suspicion" and got["m0003"].tier == "moderate" and got["m0003"].logged_tier == "high"
    assert got["m0009"].history_score == 0.9  # the escalated message itself is recorded after the clearing


def test_suspicion_window_is_fixed_not_sliding():
    state = S.Sender()
    m = lambda at: S.Message(f"r{at}", "m", "g", "1234567890", at * S.SECOND, 10, "1234567890", 0.5, 0.0, 0.0, False, False)
    S.step(state, m(0), S.stub_provider)
    S.step(state, m(599), S.stub_provider)
    assert state.suspicion == 2
    S.step(state, m(600), S.stub_provider)
    assert state.suspicion == 1


def test_dirty_messages(spark):
    late = T0 + dt.timedelta(days=2)
    rows = [msg(1, None, 0), msg(2, "again", 5, received=late), msg(2, "again", 5, received=T0), msg(3, "no time", None), ("r", None, "m0004", None, "x", T0, None)]
    got = decide(spark, rows)
    assert set(got) == {"m0001", "m0002", "m0003", "m0004"} and got["m0001"].final_text == ""
    assert M.decisions(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("stretch", "bucket", "__s", "final_text", "digits")})
    assert {r.msg_id: r.score for r in M.decisions(clash).collect()} == {k: r.score for k, r in got.items()}
    assert M.decision_log(M.decisions(spark.createDataFrame(rows, SCHEMA))).count() == 4


def random_messages(n=300, seed=5):
    rng = random.Random(seed)
    words = ["call", "insta", "987", "654321", "hello there", "my_handle", "see you at nine", "a at b dot com", "1234567890", "www.x.com / path"]
    at, rows = 0.0, []
    for i in range(n):
        at += rng.choice([1, 30, 119, 121, 181, 599, 601])
        rows.append(msg(i, " ".join(rng.choices(words, k=rng.randint(1, 3))), at, rng.choice("ab"), rng.choice("xyz")))
    return rows


def test_sessions_do_not_change_the_fold(spark):
    rows = random_messages()
    df = spark.createDataFrame(rows, SCHEMA)
    feats = {r.msg_id: r for r in M.stateless_features(df).collect()}
    state, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[5], r[2])):
        f = feats[r[2]]
        at = int((r[5] - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
        m = S.Message(r[0], r[2], f.speaker, f.final_text, at, f.max_digit_run, f.digits, f.contact_kw_score, f.pattern_score, f.link_suspicion_score, f.platform, f.handle)
        want[r[2]] = S.step(state.setdefault(r[1], S.Sender()), m, S.stub_provider)
    got = {r.msg_id: r for r in M.decisions(df).collect()}
    for k, w in want.items():
        assert (got[k].score, got[k].action, got[k].reason, got[k].history_score) == (w["score"], w["action"], w["reason"], w["history_score"])


def test_stream_gives_the_batch_decisions(spark, tmp_path):
    rows = random_messages(120, 8)
    rows += [(*msg(900 + i, f"no id {i}", 40 * i, sender="n")[:2], None, *msg(900 + i, f"no id {i}", 40 * i, sender="n")[3:]) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    for i, part in enumerate([rows[:60], rows[60:]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_decisions(stream, "30 days").writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.msg_id or "", r.final_text, r.score, r.action) for r in spark.table("decided").collect())
    assert got == sorted((r.msg_id or "", r.final_text, r.score, r.action) for r in M.decisions(df).collect()) and len(got) == 125


def test_stretches_hold_whole_sessions(spark):
    df = spark.createDataFrame([(r[1], r[5]) for r in random_messages()] + [("x", None)], "sender_id string, ts timestamp").withColumn("m", F.monotonically_increasing_id())
    s = ranking.sessions(df, "sender_id", "ts", 600, "m").withColumn("bucket", ranking.bucket_of(F.col("ts"), 600))
    j = s.join(ranking.stretches(df, "sender_id", "ts", 600), ["sender_id", "bucket"])
    assert j.count() == 301 and j.groupBy("sender_id", "session").agg(F.countDistinct("stretch").alias("n")).filter("n > 1").count() == 0
    assert j.select("sender_id", "stretch").distinct().count() > 10


def test_row_numbers_and_sessions_match_windows(spark):
    from pyspark.sql.window import Window as W

    df = spark.range(500).select(F.col("id"), F.when(F.col("id") % 7 > 0, F.least(F.col("id") % 5, F.lit(2))).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    got = ranking.row_numbers(df, ["g"], ["h", "id"], F.substring("h", 1, 1)).withColumn("w", F.row_number().over(W.partitionBy("g").orderBy("h", "id")))
    assert got.count() == 500 and got.filter("rn <> w").count() == 0


def test_state_survives_storing():
    s = S.Sender()
    S.step(s, S.Message("r", "m", "g", "98 x", 5, 2, "98", 0.5, 0.0, 0.0, False, False), S.stub_provider)
    assert S.Sender.loads(s.dumps()) == s and S.Sender.loads(None) == S.Sender()
