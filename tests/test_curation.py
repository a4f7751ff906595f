"""Curation operators, sources and providers on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import curation as C
from tidewater.operators.embedding import embed
from tidewater.operators.graph import connected_components
from tidewater.plans.curation import curate
from tidewater.plans.generation import generate, generate_round, stub_generator
from tidewater.sources import files
from tidewater.sources.providers import Pace, Rotator, generate_until

GOOD = {
    "id": "a_1", "intent": "x", "subtype": "a", "delivery": {"multiturn": False, "language_mix": False}, "turns": [{"speaker": "guest", "text": "hi there"}],
    "label": {"contains_violation": False}, "metadata": {"source": "s"},
}


def lines(spark, objs):
    return spark.createDataFrame([(i, o if isinstance(o, str) or o is None else json.dumps(o)) for i, o in enumerate(objs, 1)], "line_no long, raw string")


def test_validation(spark):
    bad = [
        {**GOOD, "id": 5}, {k: v for k, v in GOOD.items() if k != "metadata"}, {**GOOD, "turns": [{"speaker": "g"}]}, {**GOOD, "label": {"contains_violation": "maybe"}},
        {**GOOD, "label": {"contains_violation": True, "options": [1]}}, "[]", "{broken", {**GOOD, "delivery": None},
    ]
    good, invalid = C.validate(lines(spark, [GOOD, {**GOOD, "extra": 1}, {**GOOD, "label": {"contains_violation": "true", "options": []}}, *bad, "", None]))
    assert good.count() == 3 and {r.line for r in invalid.collect()} == set(range(4, 4 + len(bad)))


def test_option_rules_and_deletion_by_id(spark):
    schema = "line_no long, id string, label struct<contains_violation:boolean,options:array<string>>"
    ok = ["a b c d", "a b c d", "a b c d"]
    rows = [(1, "a", (True, ok)), (2, "b", (False, [])), (3, "c", (False, ["a b c d"])), (4, "d", (True, ok[:2])), (5, "e", (True, [*ok[:2], "too short"])), (6, "e", (True, ok)), (7, None, (True, None))]
    kept, flagged = C.check_options(spark.createDataFrame(rows, schema))
    assert sorted(r.line_no for r in kept.collect()) == [1, 2, 7] and flagged.count() == 4


def test_components_match_union_find(spark):
    rng = np.random.default_rng(2)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5100)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (7, 7)], "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vector_pairs_exact_and_hashed(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(120, 32))
    m = np.concatenate([base, base[:40] + 0.15 * rng.normal(size=(40, 32)), np.zeros((1, 32))])
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    want = {(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if unit[i] @ unit[j] >= 0.85}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(900, None)], "id long, v array<double>")
    exact = {(r.a, r.b) for r in C.vector_pairs(df, "id", "v", 0.85, block_rows=50).collect()}
    assert exact == want and len(want) >= 40
    hashed = {(r.a, r.b) for r in C.vector_candidates(df, "id", "v", 0.85).collect()}
    assert hashed <= want and len(hashed) >= 0.95 * len(want)
    # buckets far over their size are split, and what cannot be split is still compared
    same = spark.createDataFrame([(1000 + i, base[0].tolist()) for i in range(30)], "id long, v array<double>").unionByName(df)
    crowded = {(r.a, r.b) for r in C.vector_candidates(same, "id", "v", 0.85, bucket_rows=3).collect()}
    assert {(a, b) for a, b in crowded if a >= 1000 and b >= 1000} == {(a, b) for a in range(1000, 1030) for b in range(a + 1, 1030)}
    assert len(crowded & want) >= 0.9 * len(want)


def test_representatives_and_review(spark):
    items = spark.createDataFrame([(1, "ab"), (2, "abcd"), (3, "wxyz"), (4, None), (5, "q")], "id long, t string")
    pairs = spark.createDataFrame([(1, 2, 0.95), (2, 3, 0.93), (4, 5, 0.9)], "a long, b long, similarity double")
    chosen, clusters, review = C.deduplicate(items, pairs, "id", "t")
    assert {(r.cluster, r.id, r.position) for r in chosen.collect()} == {(1, 2, 1), (4, 4, 4), (5, 5, 5)}
    assert [tuple(r) for r in review.collect()] == [(0.9, 4, None, 5, "q")] and clusters.count() == 5


def test_pipeline(spark):
    recs = [{**GOOD, "id": f"a_{i}", "turns": [{"speaker": "g", "text": f"hello number {i}"}]} for i in range(6)]
    vecs = spark.createDataFrame([(i, [1.0, 0.01 * (i == 2), 1.0 * (i > 2) * i]) for i in range(1, 7)], "line_no long, embedding array<double>")
    out = curate(lines(spark, [*recs, "nope"]), spark.createDataFrame([("a", 10), ("b", 2)], "subtype string, target int"), vecs)
    assert out.invalid.count() == 1 and out.clean.count() < 6 and out.spot_check.count() == 1
    assert {r.subtype: r.shortfall for r in out.balance.collect()}["b"] == 2


def test_resume_rewrite_and_lines(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(10).write.parquet(p)
    files.rewrite(spark.read.parquet(p).filter("id > 3"), p)
    assert spark.read.parquet(p).count() == 6
    files.rewrite(spark.range(3), p, backup=True)
    assert spark.read.parquet(p).count() == 3 and spark.read.parquet(f"{p}.bak").count() == 6
    (tmp_path / "t").rename(tmp_path / "t.old")  # a crash between the renames
    spark.range(4).write.parquet(f"{p}.new")
    files.recover(spark, p)
    assert spark.read.parquet(p).count() == 4
    (tmp_path / "x.jsonl").write_text("one\n\nthree\n")
    assert [(r.line_no, r.raw) for r in files.read_lines(spark, str(tmp_path / "x.jsonl")).orderBy("line_no").collect()] == [(1, "one"), (2, ""), (3, "three")]
    (tmp_path / "c.json").write_text(json.dumps([{"id": "A", "category": "c", "turns": [{"speaker": "g", "text": "t"}]}]))
    assert files.read_json_array(spark, str(tmp_path / "c.json")).first().turns[0].text == "t"
    files.append_log(spark.range(2), str(tmp_path / "log"))
    files.append_log(spark.range(2), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_generation_helpers(spark):
    schema = "line_no long, id string, intent string, subtype string, delivery struct<multiturn:boolean,language_mix:boolean>, turns array<struct<speaker:string,text:string>>, label struct<contains_violation:boolean>, metadata map<string,string>"
    rows = [(i, f"x{i}", "t", "a", (False, False), [("g", "Hi  There" if i < 3 else f"t{i}")], (False,), {"source": "s"}) for i in range(1, 41)] + [(99, "n", "t", "a", None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    seen = df.filter("line_no = 40")
    assert sorted(r.line_no for r in C.new_examples(df, seen).collect()) == [1, *range(3, 40), 99]
    s = C.language_mix_sample(df)
    assert s.count() == int(0.25 * 41)
    d = C.derive_mixed(s, s.filter("place < 3").select("chunk", "place", "turns", "label"))
    assert d.count() == 3 and all(r.id.endswith("_hi") and r.delivery is None or r.delivery.language_mix for r in d.collect())
    assert C.assign_ids(df, spark.createDataFrame([("a", 7)], "subtype string, have int")).filter("id = 'a_0007'").count() == 1
    assert spark.range(1).select(C.prompts("{N}: {examples_json}", F.lit(2), F.array(F.lit("a")))).first()[0] == '2: ["a"]'


def test_pacing_and_rotation():
    now, slept = [0.0], []
    pace = Pace(15, 2, lambda: now[0], slept.append)
    r = Rotator({"m": pace, "n": Pace(15, 1, lambda: now[0], slept.append)})
    assert [r.next(), r.next()] == ["m", "n"]
    pace.wait(), pace.wait()
    assert slept == [4.0] and pace.spent
    r.paces["n"].used = 1
    with pytest.raises(RuntimeError):
        r.next()
    got = iter([3, 2, 0])
    assert generate_until(10, 5, lambda n: next(got)) == 5


def test_generation_fills_what_is_missing(spark):
    corpus = spark.createDataFrame([(1, "a", [("g", "a request 0")]), (2, "b", [("g", "x")])], "line_no long, subtype string, turns array<struct<speaker:string,text:string>>")
    targets = spark.createDataFrame([("a", 3), ("b", 1), ("c", 4), ("d", 2)], "subtype string, target int")

    def generator(subtype, prompt, n):
        if subtype == "d":
            raise RuntimeError("no answer")
        return stub_generator(subtype, prompt, n)

    got = {(r.id, r.turns[0].text) for r in generate_round(corpus, targets, 5, generator).collect()}
    assert got == {("a_0001", "a request 1"), ("c_0000", "c request 0"), ("c_0001", "c request 1"), ("c_0002", "c request 2"), ("c_0003", "c request 3")}
    made = generate(corpus, targets, 2, lambda s, p, n: generator(s, p, n) if s != "c" else "not a batch")
    assert {r.id for r in made.collect()} == {"a_0001"}  # a's second round adds nothing, c and d never do


def test_default_embedder(spark):
    df = spark.createDataFrame([(1, "the lamp is wet"), (2, "The lamp is wet!"), (3, None), (4, "")], "k long, t string")
    v = {r.k: np.array(r.embedding) for r in embed(df, "k", "t").collect()}
    assert abs(v[1] @ v[2] - 1) < 1e-9 and not v[3].any() and not v[4].any()


def test_golden_slice_and_lines_kept_verbatim(spark):
    df = spark.createDataFrame([(i, "a" if i < 90 else None) for i in range(100)], "line_no long, subtype string")
    held, rest = C.golden_slice(df, 10)
    assert held.filter("subtype = 'a'").count() == 9 and held.filter("subtype IS NULL").count() == 1 and held.unionByName(rest).distinct().count() == 100
    flags = '{"delivery": {"multiturn": true, "language_mix": %s}, "label": {"contains_violation": true}}'
    raws = ["{broken ", "", "[1]", flags % "true", flags % '"true"', "{}"]
    got = C.delete_flagged_lines(lines(spark, raws)).orderBy("line_no").collect()
    assert [r.raw for r in got] == ["{broken ", "", "[1]", flags % '"true"', "{}"]


def test_flags_in_any_spelling(spark):
    good, _ = C.validate(lines(spark, [{**GOOD, "delivery": {"multiturn": "Yes", "language_mix": 0}}]))
    assert good.first().delivery == (True, False) and good.first().label.contains_violation is False
