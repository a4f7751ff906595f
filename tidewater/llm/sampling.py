"""Samples whose category shares match given targets.

A plan names, per category, its share of the sample and a minimum of rows. Wanted = the larger of the minimum and
floor(floor(N x sample_pct / 100) x share_pct / 100), N the number of distinct ids.

1. Units (distinct ids) are grouped by their pattern, the set of the plan's (field, category) pairs they belong to; the
   group sizes are the only moments needed and come from one distributed aggregation.
2. Calibration: inclusion probabilities min(1, n/N * exp(lambda . pattern)); lambda solves the dual of exponential
   tilting by damped Newton steps. Each step sums moments over the patterns in one job for all plans; only one row per
   plan and pair of categories comes back. Categories that must be taken whole are fixed at probability 1.
3. Selection: the pivotal method. Each partition fights its units pairwise, pattern by pattern, and leaves at most one
   undecided unit per plan and pattern. Those few fight on in a tree: survivors of 32 partitions at a time, then
   patterns in 4096 cells, then the cells of a plan. Every duel draws a number of its own, a hash of the seed, the
   stage and both units, so a unit that survives has not spent its chance. Counts of a category differ from their
   calibrated sums by less than one per pattern, and by nothing where each unit has one category.
4. The report sets wanted, available, calibrated and sampled rows side by side.

Defined results: units with a null id, or without a category of the plan, are never drawn; repeated rows of an id are
one unit; an id that has several categories counts for each; equal names in two fields are two categories, and names
may hold any character; an empty table gives an empty sample and a report in which every category with a target falls
short.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.runtime import cut, parallelism


def category_name(c: Column) -> Column:
    """One spelling per category: lower case, trimmed, spaces and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"[\p{Z}\s]+", " "))), r"[\s_-]+", "_")


def memberships(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """Distinct (id, field, category); nulls belong to no category."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), category_name(c.cast("string")).alias("category")) for f, c in fields.items()])
    rows = df.select(F.col(f"`{key}`").cast("string").alias("id"), F.inline(entries))
    return rows.filter("id IS NOT NULL AND category IS NOT NULL AND category <> ''").distinct()


def targets(df: DataFrame, key: str, members: DataFrame, plan: DataFrame) -> DataFrame:
    """(plan_id, field, category, sample_size, wanted, available, gap) for every row of the plan."""
    total = df.agg(F.countDistinct(F.col(f"`{key}`")).alias("n"))
    counts = members.groupBy("field", "category").agg(F.count("*").alias("available"))
    p = plan.select("plan_id", "field", category_name(F.col("category")).alias("category"), "share_pct", "min_rows", "sample_pct")
    rows = p.withColumn("n", total.scalar()).join(counts, ["field", "category"], "left")
    size = F.floor(F.col("n") * F.col("sample_pct") / 100)
    wanted = F.greatest(F.col("min_rows").cast("long"), F.floor(size * F.col("share_pct") / 100))
    have = F.coalesce(F.col("available"), F.lit(0))
    return rows.select(
        "plan_id", "field", "category", "share_pct", size.alias("sample_size"), wanted.alias("wanted"), have.alias("available"), F.greatest(wanted - have, F.lit(0)).alias("gap")
    )


PAIR = "array<struct<field:string,category:string>>"


def unit_patterns(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """(plan_id, id, pattern): pattern = JSON text of the sorted (field, category) pairs of the unit that the plan names."""
    p = wanted.select("plan_id", "field", "category")
    pairs = members.join(p, ["field", "category"]).groupBy("plan_id", "id").agg(F.sort_array(F.collect_set(F.struct("field", "category"))).alias("pairs"))
    return pairs.select("plan_id", "id", F.to_json("pairs").alias("pattern"))


@dataclass
class Tilt:
    """What calibration found for a plan: lambda by (field, category), the base rate, the categories taken whole, and
    the expected rows of each category."""

    lam: dict[tuple[str, str], float]
    base: float
    whole: set[tuple[str, str]]
    expected: dict[tuple[str, str], float]


class Newton:
    """Damped Newton steps on the dual of one plan, whose gradient is goal - sums of min(1, base exp(lam . pattern)).

    Units at their cap of 1 have no curvature, so a step may overshoot: the largest step of a category halves whenever
    its miss changes sign, and grows again where it does not."""

    def __init__(self, goal: np.ndarray):
        self.goal = goal
        self.lam = np.zeros(len(goal))
        self.limit = np.full(len(goal), 2.0)
        self.miss = np.zeros(len(goal))

    def settled(self, sums: np.ndarray) -> bool:
        return bool(np.all(np.abs(self.goal - sums) <= 1e-6 * np.maximum(1, self.goal)))

    def step(self, sums: np.ndarray, curved: np.ndarray, capped: np.ndarray) -> None:
        """`curved` and `capped` are the sums over pairs of categories of units below and at their cap."""
        miss = self.goal - sums
        self.limit = np.where(miss * self.miss < 0, self.limit / 2, np.minimum(2.0, self.limit * 1.5))
        self.miss = miss
        move = np.linalg.lstsq(curved + 0.02 * capped + 1e-9 * np.eye(len(miss)), miss, rcond=None)[0]
        self.lam = np.clip(self.lam + np.clip(move, -self.limit, self.limit), -50, 50)


def _literal(pair: tuple[str, str]) -> Column:
    return F.struct(F.lit(pair[0]).alias("field"), F.lit(pair[1]).alias("category"))


def inclusion(tilts: dict[int, Tilt], pairs: Column) -> Column:
    """The inclusion probability as a Column over plan_id and the unit's (field, category) pairs."""
    p = F.lit(0.0)
    for plan_id, t in tilts.items():
        score = sum((F.array_contains(pairs, _literal(c)).cast("double") * float(x) for c, x in t.lam.items()), F.lit(0.0))
        tilt = F.least(F.lit(t.base) * F.exp(score), F.lit(1.0))
        if t.whole:
            tilt = F.when(F.arrays_overlap(pairs, F.array(*[_literal(c) for c in sorted(t.whole)])), 1.0).otherwise(tilt)
        p = F.when(F.col("plan_id") == plan_id, tilt).otherwise(p)
    return p


#: A tilt beyond every cap: categories that are taken whole.
WHOLE = 1000.0


def calibrate(patterns: DataFrame, wanted: DataFrame, steps: int = 100) -> dict[int, Tilt]:
    """The tilt of every plan. The plan is a parameter table; of the units only moments reach the driver: per step one
    row for each plan and pair of its categories, at any number of patterns."""
    name = lambda r: (r["field"], r["category"])
    plans: dict[int, list] = {}
    for r in sorted(wanted.collect(), key=lambda r: (r["plan_id"], *name(r))):
        plans.setdefault(r["plan_id"], []).append(r)
    if not plans:
        return {}
    # categories and plans get numbers, so that every step runs the same compiled query over other parameters
    number = {(k, name(r)): i for i, (k, r) in enumerate(((k, r) for k, rows in plans.items() for r in rows), 1)}
    by_number = {i: key for key, i in number.items()}
    keys = F.create_map(*[F.lit(x) for (k, (f, c)), i in number.items() for x in (f"{k}\0{f}\0{c}", i)])
    at = {k: i for i, k in enumerate(plans, 1)}
    plan_no = F.create_map(*[F.lit(x) for k, i in at.items() for x in (k, i)])
    cats = F.transform(F.from_json("pattern", PAIR), lambda x: keys[F.concat_ws("\0", F.col("plan_id").cast("string"), x["field"], x["category"])])
    sums = patterns.groupBy("plan_id", "pattern").agg(F.count("*").alias("n"))
    sums = cut(sums.select(plan_no[F.col("plan_id")].alias("plan"), cats.alias("cats"), "n"))
    sizes = {r["plan"]: r["n"] for r in sums.groupBy("plan").agg(F.sum("n").alias("n")).collect()}
    tilts = {}
    for k, rows in plans.items():
        whole = {name(r) for r in rows if r["wanted"] >= r["available"]}
        base = max(1e-12, sum(r["wanted"] for r in rows) / max(1, sizes.get(at[k], 0)))
        tilts[k] = Tilt({name(r): 0.0 for r in rows if name(r) not in whole}, base, whole, {name(r): 0.0 for r in rows})
    solvers = {k: Newton(np.array([float(r["wanted"]) for r in rows if name(r) in tilts[k].lam])) for k, rows in plans.items()}
    open_ = set(plans)
    for step in range(steps + 1):
        lam = F.lit([tilts[k].lam.get(c, WHOLE) for k, c in by_number.values()])
        base = F.lit([t.base for t in tilts.values()])
        score = F.aggregate("cats", F.lit(0.0), lambda s, x: s + F.element_at(lam, x))
        pi = F.least(F.lit(1.0), F.element_at(base, F.col("plan")) * F.exp(F.least(score, F.lit(700.0))))
        moved = sums.select((F.col("n") * pi).alias("s"), (pi >= 1).alias("c"), "cats", F.explode("cats").alias("x")).select("s", "c", "x", F.explode("cats").alias("y"))
        per = moved.groupBy("x", "y").agg(F.sum("s").alias("s"), F.sum(F.when(F.col("c"), F.col("s")).otherwise(0.0)).alias("c"))
        got = {(r["x"], r["y"]): (r["s"], r["c"]) for r in per.collect()}
        for k in sorted(open_):
            t = tilts[k]
            no = {c: number[k, c] for c in t.expected}
            t.expected = {c: got.get((i, i), (0.0, 0.0))[0] for c, i in no.items()}
            free = list(t.lam)
            have = np.array([t.expected[c] for c in free])
            if not free or solvers[k].settled(have):
                open_.discard(k)
            elif step < steps:
                pairs = np.array([[got.get((no[a], no[b]), (0.0, 0.0)) for b in free] for a in free])
                solvers[k].step(have, pairs[:, :, 0] - pairs[:, :, 1], pairs[:, :, 1])
                t.lam = dict(zip(free, solvers[k].lam.tolist()))
        if not open_:
            break
    return tilts


EPS = 1e-9


def fight(pa: float, pb: float, u: float) -> tuple[float, float]:
    """One pivotal duel: at least one of the two leaves with probability 0 or 1; the sum stays."""
    s = pa + pb
    if s < 1:
        return (s, 0.0) if u * s < pa else (0.0, s)
    if s >= 2 - EPS:
        return 1.0, 1.0
    return (1.0, s - 1) if u * (2 - s) < 1 - pb else (s - 1, 1.0)


def uniform(seed: int, stage: int, plan: int, *ids: str) -> float:
    """A number in (0, 1) that belongs to one stage and these units."""
    return (xxhash.xxh3_64_intdigest("\0".join(map(str, (seed, stage, plan, *ids)))) + 0.5) / float(1 << 64)


def duel(stream: Iterator[tuple], same: Callable[[tuple, tuple], bool], seed: int, stage: int) -> Iterator[tuple]:
    """Runs the units (plan, pattern, id, p, cell) through duels among units that are `same`; yields decided units (p is
    0 or 1) and, at each change, the undecided rest. Each duel has its own number, whatever its units went through."""
    held = None
    for unit in stream:
        if unit[3] >= 1 - EPS or unit[3] <= EPS:
            yield (*unit[:3], float(unit[3] > 0.5), unit[4])
            continue
        if held is None or not same(held, unit):
            if held is not None:
                yield held
            held = unit
            continue
        a, b = fight(held[3], unit[3], uniform(seed, stage, unit[0], held[2], unit[2]))
        rest = None
        for x, p in ((held, a), (unit, b)):
            if EPS < p < 1 - EPS:
                rest = (*x[:3], p, x[4])
            else:
                yield (*x[:3], float(p > 0.5), x[4])
        held = rest
    if held is not None:
        yield held


NAMES = ["plan_id", "pattern", "id", "p", "cell"]
OUT = "plan_id int, pattern string, id string, p double, cell long"
FAN_IN, CELLS = 32, 4096


def pivotal(units: DataFrame, seed: int = 7, partitions: int | None = None) -> DataFrame:
    """The chosen units, p = 1, of (plan_id, pattern, id, p)."""
    n = partitions or parallelism(units.sparkSession)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in b.itertuples(index=False, name=None))
        chunk = []
        for r in duel(rows, lambda x, y: x[:2] == y[:2], seed, 0):
            if r[3] > 0:
                chunk.append(r)
            if len(chunk) >= 20_000:
                yield pd.DataFrame(chunk, columns=NAMES)
                chunk = []
        yield pd.DataFrame(chunk, columns=NAMES)

    laid = units.select("plan_id", "pattern", "id", "p").repartition(n, "id").withColumn("cell", F.spark_partition_id().cast("long"))
    # both branches below must see the same duels
    first = cut(laid.sortWithinPartitions("plan_id", "pattern", "id").mapInPandas(local, OUT))
    left = first.filter(F.col("p") < 1)

    def among(keys: list[str], by_pattern: bool, stage: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["pattern", "cell", "id"])
            same = (lambda x, y: x[:2] == y[:2]) if by_pattern else (lambda x, y: True)
            rows = [r for r in duel(pdf[NAMES].itertuples(index=False, name=None), same, seed, stage) if r[3] > 0]
            return pd.DataFrame(rows, columns=NAMES)

        return run

    stage, width = 1, n
    while width > 1:  # one survivor per partition and pattern, then per 32 partitions, and so on
        left = left.withColumn("cell", F.floor(F.col("cell") / FAN_IN)).groupBy("plan_id", "pattern", "cell").applyInPandas(among(["plan_id", "pattern", "cell"], True, stage), OUT)
        stage, width = stage + 1, -(-width // FAN_IN)
    cells = left.withColumn("cell", F.pmod(F.xxhash64("pattern"), F.lit(CELLS))).groupBy("plan_id", "cell")
    left = cells.applyInPandas(among(["plan_id", "cell"], False, stage), OUT)

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        got = among(["plan_id"], False, stage + 1)(pdf)
        lone = [uniform(seed, stage + 2, plan, i) < p for plan, i, p in zip(got["plan_id"], got["id"], got["p"])]
        return got[np.array(lone, dtype=bool)].assign(p=1.0)

    final = left.groupBy("plan_id").applyInPandas(last, OUT)
    return first.filter(F.col("p") >= 1).unionByName(final).select("plan_id", "pattern", "id")


def calibrated_sample(members: DataFrame, wanted: DataFrame, seed: int = 7, tilts: dict[int, Tilt] | None = None) -> DataFrame:
    """(plan_id, id, pattern) of the drawn units. `members` and `wanted` should be materialised."""
    patterns = unit_patterns(members, wanted)
    p = inclusion(tilts if tilts is not None else calibrate(patterns, wanted), F.from_json("pattern", PAIR))
    return pivotal(patterns.select(F.col("plan_id").cast("int").alias("plan_id"), "pattern", "id", p.alias("p")).filter("p > 0"), seed)


def calibration_report(wanted: DataFrame, tilts: dict[int, Tilt]) -> DataFrame:
    """`wanted` with the rows that each category is expected to have after calibration, and whether it falls short. A
    category that is taken whole and still too small is short; so is one whose target no tilt reaches."""
    rows = [(int(k), f, c, float(x)) for k, t in tilts.items() for (f, c), x in t.expected.items()]
    expected = wanted.sparkSession.createDataFrame(rows, "plan_id int, field string, category string, expected double")
    out = wanted.join(expected, ["plan_id", "field", "category"], "left").withColumn("expected", F.coalesce("expected", F.lit(0.0)))
    return out.withColumn("short", F.col("expected") < F.col("wanted") - 0.5)


def sample_report(wanted: DataFrame, sample: DataFrame) -> DataFrame:
    """wanted, available and sampled rows per category, and the share reached."""
    drawn = sample.select("plan_id", F.explode(F.from_json("pattern", PAIR)).alias("x")).groupBy("plan_id", "x.field", "x.category").agg(F.count("*").alias("sampled"))
    size = sample.groupBy("plan_id").agg(F.count("*").alias("size"))
    rows = wanted.join(drawn, ["plan_id", "field", "category"], "left").join(size, "plan_id", "left")
    got = F.coalesce("sampled", F.lit(0))
    return rows.select("plan_id", "field", "category", "share_pct", "wanted", "available", "gap", got.alias("sampled"), F.round(100 * got / F.col("size"), 3).alias("reached_pct"))
