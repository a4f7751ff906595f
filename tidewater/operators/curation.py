"""Corpus curation: validation, option checks, deduplication, balance, sampling, deletion, derivation.

Each operator is a DataFrame in, DataFrames out; side outputs (invalid, flagged, review pairs, missing ids) are
DataFrames of their own. Nulls count as absent; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater import constants as K
from tidewater.functions import features as X
from tidewater.operators.graph import connected_components
from tidewater.operators.ranking import row_numbers
from tidewater.runtime import cut, spread

# ---------------------------------------------------------------- validation

_STRINGS = ["id", "intent", "subtype"]


# The fields of a record and what is said of them below.
def validation_error(raw: Column) -> Column:
    """Why a JSON line is no corpus record, or null. Strings must be strings and flags booleans or one of the spellings
    of a boolean; options may be absent, extra fields are ignored."""
    v = F.try_parse_json(raw)
    kind = lambda path, of=v: F.schema_of_variant(F.try_variant_get(of, path, "variant"))
    text = lambda path: F.coalesce(kind(path) == "STRING", F.lit(False))
    is_flag = lambda path: F.coalesce((kind(path) == "BOOLEAN") | flag(F.try_variant_get(v, path, "string")).isNotNull(), F.lit(False))
    turns = F.try_variant_get(v, "$.turns", "array<variant>")
    turn_ok = lambda t: F.coalesce((kind("$.speaker", t) == "STRING") & (kind("$.text", t) == "STRING"), F.lit(False))
    options = F.try_variant_get(v, "$.label.options", "variant")
    texts = F.try_variant_get(v, "$.label.options", "array<variant>")
    error = F.when(v.isNull(), "not valid JSON").when(~F.schema_of_variant(v).startswith("OBJECT"), "not an object")
    for name in _STRINGS:
        error = error.when(~text(f"$.{name}"), f"{name}: string required")
    for name in ("multiturn", "language_mix"):
        error = error.when(~is_flag(f"$.delivery.{name}"), f"delivery.{name}: boolean required")
    return (
        error.when(turns.isNull(), "turns: list required")
        .when(~F.forall(turns, turn_ok), "turns: speaker and text required")
        .when(~is_flag("$.label.contains_violation"), "label.contains_violation: boolean required")
        .when(options.isNotNull() & (texts.isNull() | ~F.forall(texts, lambda o: F.coalesce(F.schema_of_variant(o) == "STRING", F.lit(False)))), "label.options: list of strings required")
        .when(~F.coalesce(kind("$.metadata").startswith("OBJECT"), F.lit(False)), "metadata: object required")
    )


#: The corpus record; flags are read as text first, since they may be spelled in several ways.
CORPUS = "id string, intent string, subtype string, delivery struct<multiturn:string,language_mix:string>, turns array<struct<speaker:string,text:string>>, label struct<contains_violation:string,options:array<string>,action:string,violation_type:string>, metadata map<string,string>"
TRUE, FALSE = ("true", "1", "yes", "on", "t", "y"), ("false", "0", "no", "off", "f", "n")


def flag(c: Column) -> Column:
    """A boolean from one of its spellings, else null."""
    return F.when(F.lower(c).isin(*TRUE), True).when(F.lower(c).isin(*FALSE), False)


def validate(lines: DataFrame, key: str = "line_no", raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(valid records, invalid lines with error and the first 200 characters). Blank lines are neither."""
    rows = lines.select(F.col(key), F.col(raw).alias("raw")).filter(F.length(F.trim("raw")) > 0).withColumn("error", validation_error(F.col("raw")))
    good = rows.filter("error IS NULL").select(key, F.from_json("raw", CORPUS).alias("r")).select(key, "r.*")
    for group, names in (("delivery", ("multiturn", "language_mix")), ("label", ("contains_violation",))):
        for name in names:
            good = good.withColumn(group, F.col(group).withField(name, flag(F.col(f"{group}.{name}"))))
    return good, rows.filter("error IS NOT NULL").select(F.col(key).alias("line"), "error", F.substring("raw", 1, 200).alias("raw"))


# ---------------------------------------------------------------- options


def check_options(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, flagged): records whose options break a rule, and the corpus without any record of a flagged id."""
    reason = X.option_defect(F.coalesce("label.contains_violation", F.lit(False)), F.col("label.options"))
    flagged = corpus.withColumn("reason", reason).filter("reason IS NOT NULL").select("id", "reason", F.col("label.options").alias("options"))
    return corpus.join(flagged.select("id").distinct(), "id", "left_anti"), flagged


# ---------------------------------------------------------------- near-duplicates over vectors


def vector_pairs(vectors: DataFrame, key: str, vector: str, least: float, block_rows: int = 4000) -> DataFrame:
    """(a, b, similarity) of all pairs a < b with cosine >= `least`, exactly.

    Blocked self-join: vectors fall into blocks of bounded size, each pair of blocks is one task that multiplies two
    matrices and emits only the pairs that qualify. Null, empty and zero vectors have no pairs."""
    v = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    blocks = max(1, -(-v.count() // block_rows))
    own = v.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    keyed = own.select("id", "v", "k", other).select("id", "v", "k", F.least("k", "o").alias("p"), F.greatest("k", "o").alias("q"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id").sort_values("id")
        m = np.array(pdf["v"].tolist(), dtype=np.float64)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
        ids, k, p, q = pdf["id"].to_numpy(), pdf["k"].to_numpy(), pdf["p"].iloc[0], pdf["q"].iloc[0]
        left, right = np.flatnonzero(k == p), np.flatnonzero(k == q)
        sim = m[left] @ m[right].T
        x, y = np.nonzero(sim >= least)
        a, b, s = ids[left[x]], ids[right[y]], sim[x, y]
        keep = a < b if p == q else a != b
        a, b, s = a[keep], b[keep], s[keep]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": s})

    return keyed.groupBy("p", "q").applyInPandas(run, "a long, b long, similarity double")


def vector_candidates(vectors: DataFrame, key: str, vector: str, least: float, tables: int = 60, bits: int = 12, seed: int = 5, bucket_rows: int = 250) -> DataFrame:
    """The same pairs by sign hashes of random planes, for collections where all block pairs are too many. A pair at
    cosine 0.85 shares one of the 60 hashes with a probability of 0.998.

    A bucket with more than `bucket_rows` vectors is split by more planes of its own table, level by level, until its
    parts are small or `bits` more planes are used up; what is larger then holds nearly equal vectors, and goes through
    the exact blocked product. No bucket is dropped. Pairs are verified exactly; null, empty and zero vectors have none."""
    v = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    v = v.filter(F.exists("v", lambda x: x != 0)).dropDuplicates(["id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = None
        for b in batches:
            m = np.array(b["v"].tolist())
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(m.shape[1], tables * 2 * bits))
            signs = (m @ planes > 0).reshape(len(m), tables, 2 * bits)
            code = lambda s: (s * (1 << np.arange(bits))).sum(axis=2)
            head = (code(signs[:, :, :bits]) + (np.arange(tables) << bits)).astype(np.int64)
            yield pd.DataFrame({"id": b["id"], "codes": list(head), "more": list(code(signs[:, :, bits:]).astype(np.int64))})

    coded = spread(v, "id").mapInPandas(run, "id long, codes array<long>, more array<long>")
    rows = cut(coded.select("id", F.explode(F.arrays_zip("codes", "more")).alias("x")).select("id", F.col("x.codes").alias("code"), F.col("x.more").alias("more")))
    sizes = rows.groupBy("code").agg(F.count("*").alias("n"))
    # the planes a bucket needs so that its parts hold about bucket_rows: a close pair stays together on each with the
    # same probability as on the planes before, and every table has planes of its own
    extra = F.least(F.lit(bits), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / bucket_rows)))).cast("int")
    parts = rows.join(sizes.select("code", extra.alias("extra")), "code").select("id", "code", F.expr("more & (shiftleft(1L, extra) - 1)").alias("part"))
    big = parts.groupBy("code", "part").agg(F.count("*").alias("n"))
    marked = cut(parts.join(big, ["code", "part"]).filter("n > 1"))
    small = marked.filter(F.col("n") <= 8 * bucket_rows)
    pairs = small.alias("x").join(small.alias("y"), ["code", "part"]).filter("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    dot = F.aggregate(F.zip_with("va", "vb", lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    joined = pairs.join(v.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(v.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    near = joined.select("a", "b", (dot / (norm("va") * norm("vb"))).alias("similarity")).filter(F.col("similarity") >= least)
    crowded = v.join(marked.filter(F.col("n") > 8 * bucket_rows).select("id").distinct(), "id", "left_semi")
    return near.unionByName(vector_pairs(crowded, "id", "v", least)).dropDuplicates(["a", "b"])


def deduplicate(items: DataFrame, pairs: DataFrame, key: str, text: str, drop_at: float = K.DROP_AT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(representatives, clusters, review pairs). Pairs from `drop_at` on make clusters; each keeps its longest text,
    ties go to the smallest key; `position` is the smallest key of the cluster. Pairs below are for review."""
    comp = connected_components(cut(pairs.filter(F.col("similarity") >= drop_at).select("a", "b")))
    clusters = items.join(comp.withColumnRenamed("node", key), key, "left").withColumn("cluster", F.coalesce("component", F.col(key))).drop("component")
    best = F.max_by(F.col(key), F.struct(F.coalesce(F.length(text), F.lit(0)), -F.col(key)))
    chosen = clusters.groupBy("cluster").agg(best.alias(key), F.count("*").alias("members"), F.min(key).alias("position"))
    return chosen, clusters.select(key, "cluster"), review_pairs(items, pairs, key, text, drop_at)


def review_pairs(items: DataFrame, pairs: DataFrame, key: str, text: str, drop_at: float = K.DROP_AT) -> DataFrame:
    """(similarity, example_a, text_a, example_b, text_b) of the pairs below `drop_at`, most similar first. The order is
    a range-partitioned sort, so it holds for any number of pairs."""
    out = pairs.filter(F.col("similarity") < drop_at).select(F.round("similarity", 4).alias("similarity"), F.col("a").alias("example_a"), F.col("b").alias("example_b"))
    for side in "ab":
        out = out.join(items.select(F.col(key).alias(f"example_{side}"), F.col(text).alias(f"text_{side}")), f"example_{side}", "left")
    return out.select("similarity", "example_a", "text_a", "example_b", "text_b").orderBy(F.desc("similarity"), "example_a", "example_b")


# ---------------------------------------------------------------- balance, samples, deletion


def balance(corpus: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subtype, actual, target, pct, shortfall) for every target, and the subtypes without one."""
    counts = corpus.groupBy("subtype").agg(F.count("*").alias("actual"))
    pct = F.round(100.0 * F.col("actual") / F.col("target"), 4)
    rows = targets.join(counts, "subtype", "left").withColumn("actual", F.coalesce("actual", F.lit(0).cast("long"))).withColumn("pct", pct)
    shortfall = F.when(100.0 * F.col("actual") / F.col("target") < K.BALANCE_FLOOR_PCT, F.col("target") - F.col("actual"))
    return rows.select("subtype", "actual", "target", "pct", shortfall.alias("shortfall")), counts.join(targets, "subtype", "left_anti")


def spot_check(corpus: DataFrame, key: str = "line_no", share: float = K.SPOT_CHECK_SHARE) -> DataFrame:
    """Per subtype max(1, int(share x size)) records, those with the smallest md5 of their key."""
    hashed = corpus.withColumn("__h", F.md5(F.col(key).cast("string")))
    sizes = corpus.groupBy("subtype").agg(F.count("*").alias("__size"))
    numbered = row_numbers(hashed, ["subtype"], ["__h", key], F.substring("__h", 1, 3), "__rn")
    joined = numbered.join(sizes.withColumnRenamed("subtype", "__s"), F.col("subtype").eqNullSafe(F.col("__s")))
    return joined.filter(F.col("__rn") <= F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("__size")))).select(*corpus.columns)


def delete_flagged(corpus: DataFrame) -> DataFrame:
    """Without the records whose three flags are all true."""
    every = F.col("delivery.multiturn") & F.col("delivery.language_mix") & F.col("label.contains_violation")
    return corpus.filter(~F.coalesce(every, F.lit(False)))


def delete_flagged_lines(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Lines of JSON without those whose three flags are true, and nothing else changed: lines that are no JSON, other
    shapes and missing parts stay as they are."""
    v = F.try_parse_json(raw)
    true = lambda path: F.coalesce((F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BOOLEAN") & F.try_variant_get(v, path, "boolean"), F.lit(False))
    return lines.filter(~(true("$.delivery.multiturn") & true("$.delivery.language_mix") & true("$.label.contains_violation")))


def golden_slice(corpus: DataFrame, size: int = 200, key: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """(held out, rest): about `size` records that are never trained on, each subtype by its share and at least one,
    those with the smallest md5 of their key. Any rerun over the same corpus holds out the same records."""
    hashed = corpus.withColumn("__h", F.md5(F.col(key).cast("string")))
    counts = corpus.groupBy("subtype").agg(F.count("*").alias("__n"))
    sizes = counts.withColumn("__total", corpus.agg(F.count("*")).scalar())
    quota = sizes.select(F.col("subtype").alias("__s"), F.greatest(F.lit(1), F.floor(F.col("__n") * size / F.col("__total"))).alias("__quota"))
    numbered = row_numbers(hashed, ["subtype"], ["__h", key], F.substring("__h", 1, 3), "__rn")
    marked = numbered.join(quota, F.col("subtype").eqNullSafe(F.col("__s")))
    return marked.filter("__rn <= __quota").select(*corpus.columns), marked.filter("__rn > __quota").select(*corpus.columns)


def delete_ids(corpus: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """(corpus without the ids, the ids that were not there)."""
    wanted = corpus.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    return corpus.join(wanted, "id", "left_anti"), wanted.join(corpus.select("id"), "id", "left_anti").orderBy("id")


# ---------------------------------------------------------------- generation


def dedup_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[\s\x1c-\x1f]+", " "))


def new_examples(batch: DataFrame, seen: DataFrame, order: str = "line_no") -> DataFrame:
    """Records of `batch` whose first turn is not among all turns of `seen`; of equal ones the first arrives. Records
    without turns always stay."""
    first = dedup_key(F.get("turns.text", F.lit(0)))
    keyed = batch.withColumn("__key", first)
    old = seen.select(F.explode("turns.text").alias("t")).select(dedup_key(F.col("t")).alias("__key")).filter("__key IS NOT NULL").distinct()
    fresh = keyed.filter("__key IS NOT NULL").join(old, "__key", "left_anti")
    firsts = fresh.groupBy("__key").agg(F.min(order).alias(order)).select(order)
    return fresh.join(firsts, order, "left_semi").select(*batch.columns).unionByName(keyed.filter("__key IS NULL").select(*batch.columns))


def deficits(corpus: DataFrame, targets: DataFrame, batch: int) -> DataFrame:
    """(subtype, have, target, missing, next_batch) of a resumed generation."""
    have = corpus.groupBy("subtype").agg(F.count("*").alias("have"))
    rows = targets.join(have, "subtype", "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long")))
    rows = rows.withColumn("missing", F.greatest(F.col("target") - F.col("have"), F.lit(0)))
    return rows.withColumn("next_batch", F.least(F.col("missing"), F.lit(batch)))


def assign_ids(batch: DataFrame, have: DataFrame, order: str = "line_no") -> DataFrame:
    """id = subtype_NNNN, counting on from what each subtype has, in order of arrival; null without a subtype."""
    numbered = row_numbers(batch, ["subtype"], [order], F.floor(F.col(order) / 4096), "__rn")
    joined = numbered.join(have.select(F.col("subtype").alias("__s"), "have"), F.col("subtype") == F.col("__s"), "left")
    n = (F.coalesce("have", F.lit(0)) + F.col("__rn") - 1).cast("long")
    return joined.withColumn("id", F.when(F.col("subtype").isNotNull(), F.format_string("%s_%04d", "subtype", n))).select(*[c for c in batch.columns if c != "id"], "id")


def language_mix_sample(corpus: DataFrame, key: str = "line_no", share: float = K.LANGUAGE_MIX_SHARE, chunk: int = K.LANGUAGE_MIX_BATCH) -> DataFrame:
    """Exactly int(share) of the records that are not mixed yet, by md5 of their key, with chunk and place in it."""
    base = corpus.filter(~F.coalesce("delivery.language_mix", F.lit(False))).withColumn("__h", F.md5(F.col(key).cast("string"))).withColumn("__all", F.lit(1))
    n = int(share * base.count())
    numbered = row_numbers(base, ["__all"], ["__h", key], F.substring("__h", 1, 3), "__rn").filter(F.col("__rn") <= n)
    return numbered.select(*corpus.columns, F.floor((F.col("__rn") - 1) / chunk).alias("chunk"), ((F.col("__rn") - 1) % chunk).alias("place"))


def derive_mixed(sample: DataFrame, replies: DataFrame) -> DataFrame:
    """Joins rewritten records to their originals by place (a short reply leaves the rest out); the copy keeps intent
    and subtype, gets the id of the original with _hi, the mixed flag and its origin."""
    r = replies.select("chunk", "place", F.col("turns").alias("__turns"), F.col("label").alias("__label"))
    joined = sample.join(r, ["chunk", "place"])
    meta = F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: k != "derived_from"), F.create_map(F.lit("derived_from"), F.col("id")))
    return joined.select(
        F.concat("id", F.lit("_hi")).alias("id"), "intent", "subtype", F.col("delivery").withField("language_mix", F.lit(True)).alias("delivery"),
        F.col("__turns").alias("turns"), F.col("__label").alias("label"), meta.alias("metadata"),
    )


def prompts(template: str, n: Column, examples: Column) -> Column:
    """{N} and {examples_json} filled in."""
    return F.replace(F.replace(F.lit(template), F.lit("{N}"), n.cast("string")), F.lit("{examples_json}"), F.to_json(examples))
