"""Near-duplicates, sampling, packing and leakage against brute force."""

import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import leakage, neardup, packing, sampling
from tidewater.llm.skeleton import reader_words

WORDS = [f"w{i}" for i in range(400)]


# ---------------------------------------------------------------- 4


def brute_groups(rows, threshold=0.8, least=12):
    bags = {}
    for i, texts in rows:
        ws = [reader_words(t) for t in texts or []]
        bag = Counter(p for w in ws for p in zip(w, w[1:]))
        if sum(map(len, ws)) >= least and bag:
            bags[i] = bag
    up = {i: i for i in bags}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = sum((bags[a] & bags[b]).values())
            if 2 * both >= threshold * (sum(bags[a].values()) + sum(bags[b].values())) - 1e-12:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_rows(seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(60):
        base = [rng.choice(WORDS) for _ in range(40)]
        for _ in range(rng.choice([1, 1, 2, 5])):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(WORDS)
            n += 1
            rows.append((n, [" ".join(t[:20]), " ".join(t[20:]).upper()]))
    hot = [rng.choice(WORDS) for _ in range(40)]  # one source holds a third of all
    for k in range(60):
        t = list(hot)
        t[k % 40] = rng.choice(WORDS)
        n += 1
        rows.append((n, [" ".join(t)]))
    return rows + [(n + 1, None), (n + 2, [None, ""]), (n + 3, ["too few words"]), (n + 4, rows[0][1]), (n + 5, ["a b"] * 6 + [None])]


def test_near_duplicate_groups_match_brute_force(spark):
    rows = near_rows(6)
    df = spark.createDataFrame(rows, "line_no long, texts array<string>").withColumn("id", F.lit("clash"))
    got = {r.id: r.group_id for r in neardup.near_duplicates(df, "line_no", "texts").collect()}
    assert got == brute_groups(rows)
    assert neardup.near_duplicates(df.limit(0), "line_no", "texts").count() == 0


def test_super_min_hash_estimates_jaccard_with_early_stopping():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 60).astype(np.uint64)
    b = np.concatenate([a[:45], rng.integers(0, 2**63, 15).astype(np.uint64)])
    rec = np.repeat([0, 1, 2], [60, 60, 1])
    sig = neardup.super_min_hash(np.concatenate([a, b, a[:1]]), rec, 3, 512)
    assert abs((sig[0] == sig[1]).mean() - 45 / 75) < 0.08 and np.isfinite(sig).all()
    # the signature of a record does not depend on what shares its lot
    alone = neardup.super_min_hash(a, np.zeros(60, dtype=int), 1, 512)
    assert (alone[0] == sig[0]).all()
    # each register holds the smallest value among the elements
    each = np.stack([neardup.super_min_hash(x[None], np.zeros(1, dtype=int), 1, 512)[0] for x in a])
    assert (each.min(axis=0) == sig[0]).all()


def test_long_records_take_the_minimum_over_their_lots():
    rng = np.random.default_rng(4)
    es = [rng.integers(-(2**62), 2**62, n).tolist() for n in (5, 90, 3000, 40)]
    assert (neardup.record_signatures(es, 256) == neardup.record_signatures(es, 256, most=64)).all()
    assert [sum(b - a for _, a, b in lot) for lot in neardup.lots([5, 90, 3000, 40], 1000)] == [1000, 1000, 1000, 135]


def test_a_crowded_bucket_that_does_not_verify_is_split(spark):
    """All records share one bucket; a few pairs belong together, the rest met by chance."""
    rng = random.Random(9)
    texts = []
    for _ in range(400):
        base = [rng.choice(WORDS) for _ in range(30)]
        texts.append(base)
        if rng.random() < 0.1:
            texts.append([rng.choice(WORDS) if k == 7 else w for k, w in enumerate(base)])
    rows = [(i, [" ".join(t)]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "line_no long, texts array<string>")
    records = neardup.elements(df, "line_no", "texts", 12).cache()
    signed = neardup.signatures(records).cache()
    one = signed.select("id", F.lit(5).cast("long").alias("key"))
    groups = brute_groups(rows)
    want = {(g, i) for i, g in groups.items() if i != g}
    for direct in (0, 1e9):
        assert {(r.a, r.b) for r in neardup.bucket_links(one, signed, records, 0.8, small=8, direct=direct).collect()} == want and len(want) > 20


# ---------------------------------------------------------------- 2


def sample_inputs(spark):
    rng = random.Random(1)
    rows = [(f"i{k}", rng.choice(["Big One", "big-one", "BIG_ONE", " big one"]), "x") for k in range(600)] + [(f"m{k}", "mid", "y") for k in range(200)] + [(f"s{k}", "small", None) for k in range(12)]
    rows += [(None, "small", "x"), ("i1", "big one", "x"), ("i2", "mid", "x"), ("n1", None, None)]
    df = spark.createDataFrame(rows, "id string, kind string, other string")
    plan = spark.createDataFrame(
        [(1, "kind", "big_one", 50, 5, 40), (1, "kind", "mid", 45, 5, 40), (1, "kind", "small", 5, 10, 40), (2, "kind", "small", 100, 1, 50), (2, "kind", "absent", 1, 3, 50)],
        "plan_id int, field string, category string, share_pct int, min_rows int, sample_pct int",
    )
    members = sampling.memberships(df, "id", {"kind": F.col("kind"), "other": F.col("other")})
    return df, members, plan


def test_sample_meets_its_targets(spark):
    df, members, plan = sample_inputs(spark)
    want = sampling.targets(df, "id", members, plan).cache()
    t = {(r.plan_id, r.category): r for r in want.collect()}
    n = 813
    assert t[1, "big_one"].wanted == n * 40 // 100 * 50 // 100 and t[1, "small"].wanted == 16 and t[1, "small"].gap == 4 and t[2, "absent"].gap == 4
    sample = sampling.calibrated_sample(members, want).cache()
    counts = defaultdict(int)
    for r in sample.collect():
        for c in json.loads(r.pattern):
            counts[r.plan_id, c["category"]] += 1
    for k in [(1, "big_one"), (1, "mid")]:
        assert abs(counts[k] - t[k].wanted) <= 1
    assert counts[1, "small"] == 12 and counts[2, "small"] == 12
    assert sample.groupBy("plan_id", "id").count().filter("count > 1").count() == 0
    rep = {(r.plan_id, r.category): r for r in sampling.sample_report(want, sample).collect()}
    assert rep[1, "small"].sampled == 12 and rep[1, "small"].gap == 4
    tilts = sampling.calibrate(sampling.unit_patterns(members, want), want)
    short = {(r.plan_id, r.category) for r in sampling.calibration_report(want, tilts).filter("short").collect()}
    assert short == {k for k, r in t.items() if r.gap > 0}
    assert sampling.targets(df.limit(0), "id", members.limit(0), plan).filter("gap > 0").count() == 5
    none = sampling.targets(df.limit(0), "id", members.limit(0), plan).cache()
    assert sampling.calibrated_sample(members.limit(0), none).count() == 0


def test_equal_names_in_two_fields_and_odd_names(spark):
    rows = [(f"i{k}", ["a|b", 'q"]'][k % 2], ["a|b", "z"][k // 50 % 2]) for k in range(400)]
    df = spark.createDataFrame(rows, "id string, x string, y string")
    plan = spark.createDataFrame([(1, "x", "a|b", 25, 1, 40), (1, "x", 'q"]', 25, 1, 40), (1, "y", "a|b", 40, 1, 40), (1, "y", "z", 10, 1, 40)], "plan_id int, field string, category string, share_pct int, min_rows int, sample_pct int")
    members = sampling.memberships(df, "id", {"x": F.col("x"), "y": F.col("y")})
    want = sampling.targets(df, "id", members, plan).cache()
    rep = {(r.field, r.category): (r.wanted, r.sampled) for r in sampling.sample_report(want, sampling.calibrated_sample(members, want)).collect()}
    assert {k: w for k, (w, _) in rep.items()} == {("x", "a|b"): 40, ("x", 'q"]'): 40, ("y", "a|b"): 64, ("y", "z"): 16}
    assert all(abs(w - got) <= 2 for w, got in rep.values())


@pytest.mark.parametrize("goal", [[120.0, 200.0], [590.0, 100.0], [350.0, 390.0], [1.0, 1.0]])
def test_newton_solves_overlapping_categories(goal):
    m = np.array([[1, 0], [0, 1], [1, 1]], dtype=float)
    n = np.array([500.0, 300.0, 100.0])
    solver = sampling.Newton(np.array(goal))
    for _ in range(100):
        pi = 0.3 * np.exp(m @ solver.lam)
        taken = n * np.minimum(pi, 1)
        if solver.settled(m.T @ taken):
            break
        solver.step(m.T @ taken, m.T @ (m * (taken * (pi < 1))[:, None]), m.T @ (m * (taken * (pi >= 1))[:, None]))
    assert np.allclose(m.T @ taken, goal, atol=1e-2)


@pytest.mark.parametrize("partitions,each", [(1, 10), (8, 5), (64, 1)])
def test_pivotal_keeps_expectation_and_size(spark, partitions, each):
    """Every plan is one draw; all go through the whole path of stages."""
    draws, ids = 2_500, [f"u{k}" for k in range(max(10, partitions * each))]
    units = spark.range(draws).select(F.col("id").cast("int").alias("plan_id"), F.explode(F.array(*[F.lit(i) for i in ids])).alias("id"))
    units = units.select("plan_id", F.concat(F.lit("p"), F.expr("ascii(substr(id, 2)) % 2")).alias("pattern"), "id", F.lit(0.3).alias("p"))
    got = sampling.pivotal(units, partitions=partitions).cache()
    hits = {r["id"]: r["count"] / draws for r in got.groupBy("id").count().collect()}
    assert all(abs(hits[i] - 0.3) < 0.04 for i in ids), hits
    sizes = [r["count"] for r in got.groupBy("plan_id").count().collect()]
    assert set(sizes) <= {int(0.3 * len(ids) + 1e-9), -int(-0.3 * len(ids) // 1)} and abs(np.mean(sizes) - 0.3 * len(ids)) < 0.05


# ---------------------------------------------------------------- 8


def test_windows_hold_every_piece_once(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([30, 100, 400, 1500, 2048, 2049, 9000])) for i in range(800)] + [(9001, 0), (9002, 4096)]
    parts = packing.pieces(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 2048).cache()
    for rule in ("norm", "dot"):
        w = packing.pack(parts, 2048, max_docs=20, rule=rule, shard_pieces=300).cache()
        per = w.groupBy("window_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("q")).agg(F.max("t"), F.max("c"), F.max("q")).first()
        assert per[0] <= 2048 and per[1] <= 20 and per[2] <= 2048 * 2048
        assert sorted(map(tuple, w.select("doc_id", "piece_no", "start_token", "n_tokens").collect())) == sorted(map(tuple, parts.collect()))
        assert packing.fill_report(w, 2048).first().unused_share < 0.05
    # a lower limit of attention binds: windows of two long texts are no longer allowed, a long text stands alone
    free, bound = packing.pack(parts, 2048).cache(), packing.pack(parts, 2048, attention_share=0.5).cache()
    assert sorted(map(tuple, bound.drop("window_id").collect())) == sorted(map(tuple, free.drop("window_id").collect()))
    cost = lambda w: w.groupBy("window_id").agg(F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("q"), F.count("*").alias("c"))
    assert cost(free).filter(f"c > 1 AND q > {0.5 * 2048**2}").count() > 0 and cost(bound).filter(f"c > 1 AND q > {0.5 * 2048**2}").count() == 0
    assert bound.select("window_id").distinct().count() > free.select("window_id").distinct().count()
    split = {r.doc_id for r in parts.filter("piece_no > 1").collect()}
    assert split == {i for i, n in rows if n > 2048}
    assert packing.pack(parts.limit(0), 2048).count() == 0


def test_token_sizes_of_whole_texts(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "a b " * 5000), (5, "<|endoftext|>")]
    got = {r.doc_id: r.n_tokens for r in packing.token_sizes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 10000 and got[5] > 1


# ---------------------------------------------------------------- 9


def brute_leaks(docs, items, window=12):
    toks = {d: leakage.words(t) for d, t in docs if t}
    out = set()
    for i, text in items:
        if not text:
            continue
        ws, owner = leakage.words_and_owner(text)
        total = owner[-1] + 1 if owner else 0
        for first in range(total - window + 1):
            span = [w for w, o in zip(ws, owner) if first <= o < first + window]
            for d, t in toks.items():
                s = " ".join(t)
                if f" {' '.join(span)} " in f" {s} ":
                    out.add((d, i))
    return out


def test_leaks_match_brute_force(spark):
    rng = random.Random(7)
    items = [(i, " ".join(rng.choices(WORDS, k=40))) for i in range(40)] + [(90, None), (91, ""), (92, "short item"), (93, "one-two three-four " * 8)]
    docs = []
    for d in range(150):
        body = rng.choices(WORDS, k=60)
        if d % 3 == 0:
            src = items[rng.randrange(40)][1].split()
            n = rng.choice([8, 11, 12, 13, 30])
            a = rng.randrange(len(src) - n + 1)
            body[20:20] = [w.upper() + rng.choice(["", ",", " —"]) for w in src[a : a + n]]
        docs.append((d, rng.choice([" ", "\n", "  "]).join(body)))
    docs += [(900, None), (901, ""), (902, items[3][1] + " x " + items[4][1]), (903, "One two three four " * 7), (904, " ".join(rng.choices(WORDS, k=90_000)) + " " + items[5][1])]
    D = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(D, spark.createDataFrame(items, "item_id long, text string")).filter("run_words >= 12").collect()}
    assert got == brute_leaks(docs, items)
    assert leakage.leaks(D.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert leakage.leaks(D, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(1)
    index = leakage.ItemIndex([(1, " ".join(WORDS[:60]))], 12, 3)
    for _ in range(200):
        k = rng.integers(len(index.prints))
        near = index.prints[k]
        for bit in rng.choice(64, 3, replace=False):
            near ^= np.uint64(1) << np.uint64(bit)
        assert k in index.candidates(np.array([near], dtype=np.uint64))[1]
