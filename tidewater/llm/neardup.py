"""Groups of near-duplicate records at any number of records.

Similarity of two records = 2 x common pairs of neighbouring words / all pairs of both, repeats counted. Each repeat
of a pair is an element of its own, so this is the Dice similarity of two sets and d >= s means Jaccard >= s/(2-s).

1. Records with the same elements are one class; only its smallest id goes on.
2. SuperMinHash (Ertl, 2017) signatures: every element ranks the registers by its own random permutation; a register
   keeps the smallest rank + fraction among the record's elements. The ranks of all elements are advanced level by
   level, and a record stops as soon as each of its registers is filled, since later levels only hold larger values.
   Elements are taken in lots of bounded number; a record longer than a lot takes the minimum over its lots.
3. Banding: records that agree in all registers of a band share a bucket.
4. Candidates without pairing off whole buckets: first every member with the smallest id of its bucket. What that
   links is one component. Buckets that still hold several components are settled by their size: up to `SMALL` members,
   each pair of different components is compared; larger ones are split by `PARTS` keys of three more registers each,
   and the parts go through the same steps. Two records at the threshold that share the bucket share one of the parts
   with a probability of 0.99997, records that merely met by chance hardly ever do. Pairs within a component need no
   check, so a bucket that holds a third of all records costs one comparison for each of its members.
5. Verification: a 256-bit sketch of the signature drops candidates that are more than five standard deviations below
   the threshold, the rest is compared exactly.
6. Groups: connected components over the verified links.

With 51 bands of 5 registers a pair at the threshold of 0.8 is missed with a probability of 0.0008, one at 0.85 of
less than 1e-5.

Defined results: records with fewer than `min_words` words, or without neighbouring words, are in no group; nulls are
empty texts; copies fall into one class; an empty table gives no groups.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.skeleton import reader_words
from tidewater.operators.graph import connected_components
from tidewater.runtime import cut, spread

BANDS, ROWS = 51, 5
SKETCH_BITS = 256
#: Elements whose ranks are advanced together: their permutations take 2 bytes for each of 256 registers.
LOT = 1 << 15
#: Members up to which a bucket of several components is compared pair by pair; larger ones are split.
SMALL = 32
PARTS, PART_ROWS, SPLITS = 30, 3, 2
#: Comparisons in large buckets, all together, up to which they are made at once.
DIRECT = 5e6


def pair_elements(texts: list[str | None], min_words: int) -> list[int] | None:
    """Sorted hashes of (word, next word, how often met before); None if the record is too short."""
    met: Counter = Counter()
    out, n = [], 0
    for text in texts:
        ws = reader_words(text)
        n += len(ws)
        for pair in zip(ws, ws[1:]):
            key = f"{pair[0]} {pair[1]} {met[pair]}"
            met[pair] += 1
            h = xxhash.xxh3_64_intdigest(key)
            out.append(h - (1 << 64) if h >= 1 << 63 else h)
    return sorted(out) if n >= min_words and out else None


def elements(df: DataFrame, key: str, texts: str, min_words: int) -> DataFrame:
    """(id, n, e): the elements of each record that is long enough. `texts` is an array column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["id"], b["t"]):
                e = pair_elements(list(t) if t is not None else [], min_words)
                if e is not None:
                    rows.append((i, len(e), e))
            yield pd.DataFrame(rows, columns=["id", "n", "e"])

    picked = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{texts}`").alias("t")).filter("id IS NOT NULL")
    return spread(picked, "id").mapInPandas(run, "id long, n int, e array<long>")


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: a counter-based random number per element and level."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def super_min_hash(flat: np.ndarray, rec: np.ndarray, n_rec: int, m: int) -> np.ndarray:
    """Signatures (n_rec x m) of records given as flat element hashes (uint64) and their record numbers. Records
    without elements keep infinite registers."""
    sig = np.full(n_rec * m, np.inf)
    uniq, inv = np.unique(flat, return_inverse=True)
    perm = np.tile(np.arange(m, dtype=np.int16), (len(uniq), 1))
    rows = np.arange(len(uniq))
    base, el = rec * m, inv
    live_rec = rec
    for level in range(m):
        with np.errstate(over="ignore"):
            x = _mix(uniq + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            y = _mix(x + np.uint64(0xD1B54A32D192ED03))
        frac = (x >> np.uint64(11)).astype(np.float64) * 2.0**-53
        swap = level + (y % np.uint64(m - level)).astype(np.int64)
        here = perm[:, level].copy()
        perm[:, level] = perm[rows, swap]
        perm[rows, swap] = here
        np.minimum.at(sig, base + perm[el, level], level + frac[el])
        if level % 4 == 3:  # early stopping: full records take no part in later levels
            open_ = np.isinf(sig.reshape(n_rec, m)).any(axis=1)[live_rec]
            if not open_.any():
                break
            if open_.mean() < 0.7:
                base, el, live_rec = base[open_], el[open_], live_rec[open_]
    return sig.reshape(n_rec, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per record and band."""
    bits = sig[:, : bands * rows].copy().view(np.uint64).reshape(len(sig), bands, rows)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands)).copy()
        for r in range(rows):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, r])
    return h.view(np.int64)


def sketch(sig: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """One bit of each of the first registers, packed into 64-bit words."""
    b = (_mix(sig[:, :bits].copy().view(np.uint64)) >> np.uint64(40)) & np.uint64(1)
    return np.packbits(b.astype(np.uint8), axis=1).view(np.int64)


def lots(sizes: list[int], most: int = LOT) -> Iterator[list[tuple[int, int, int]]]:
    """(record, from, to) slices of the records' elements in lots of at most `most` elements."""
    lot: list[tuple[int, int, int]] = []
    room = most
    for k, n in enumerate(sizes):
        a = 0
        while a < n:
            if not room:
                yield lot
                lot, room = [], most
            b = min(n, a + room)
            lot.append((k, a, b))
            room -= b - a
            a = b
    if lot:
        yield lot


def record_signatures(es: list, m: int, most: int = LOT) -> np.ndarray:
    """Signatures of records given as lists of elements; the registers of a record that spans several lots are the
    minima over them."""
    sig = np.full((len(es), m), np.inf)
    for lot in lots([len(e) for e in es], most):
        own = np.array([k for k, _, _ in lot])
        rec = np.repeat(np.arange(len(lot)), [b - a for _, a, b in lot])
        flat = np.concatenate([np.asarray(es[k][a:b], dtype=np.int64) for k, a, b in lot]).view(np.uint64)
        sig[own] = np.minimum(sig[own], super_min_hash(flat, rec, len(lot), m))
    return sig


def signatures(records: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, keys, parts, sketch) from (id, n, e); parts are keys of three registers for splitting buckets, others at each
    split."""
    m = max(bands * rows, SKETCH_BITS)
    order = np.random.default_rng(1).permutation(m)[: SPLITS * PARTS * PART_ROWS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, es = b["id"].to_numpy(), b["e"].tolist()
            for a in range(0, len(ids), 2048):
                sig = record_signatures(es[a : a + 2048], m)
                parts = band_keys(sig[:, order], SPLITS * PARTS, PART_ROWS)
                yield pd.DataFrame({"id": ids[a : a + 2048], "keys": list(band_keys(sig, bands, rows)), "parts": list(parts), "sketch": list(sketch(sig))})

    return spread(records.select("id", "e"), "id").mapInPandas(run, "id long, keys array<long>, parts array<long>, sketch array<long>")


def _verified(pairs: DataFrame, records: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The candidate pairs (a, b) that reach the threshold."""
    j = threshold / (2 - threshold)
    agree = (1 + j) / 2
    least = int(SKETCH_BITS * agree - 5.3 * (SKETCH_BITS * agree * (1 - agree)) ** 0.5)
    sa = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa"))
    sb = sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    near = pairs.join(sa, "a").join(sb, "b").filter(F.lit(SKETCH_BITS) - differ >= least).select("a", "b")
    ra = records.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("e").alias("ea"))
    rb = records.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("e").alias("eb"))
    both = F.size(F.array_intersect("ea", "eb")).cast("long")
    per = F.lit(round(threshold * 1_000_000))
    return near.join(ra, "a").join(rb, "b").filter(2_000_000 * both >= per * (F.col("na") + F.col("nb"))).select("a", "b")


def near_duplicates(df: DataFrame, key: str, texts: str, threshold: float = 0.8, min_words: int = 12, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, copy_of, group_id) for every record that is long enough: copy_of is the smallest id with the same
    elements, group_id the smallest id of its group (its own if it is alone)."""
    every = cut(elements(df, key, texts, min_words))
    fingerprint = F.sha2(F.concat_ws(",", "e"), 256)
    marked = every.select("id", fingerprint.alias("f"))
    member = cut(marked.join(marked.groupBy("f").agg(F.min("id").alias("copy_of")), "f").select("id", "copy_of"))
    records = cut(every.join(member.filter("id = copy_of").select("id"), "id", "left_semi"))
    signed = cut(signatures(records, bands, rows))
    links = bucket_links(signed.select("id", F.explode("keys").alias("key")), signed, records, threshold)
    group = connected_components(links).select(F.col("node").alias("copy_of"), F.col("component").alias("group_id"))
    return member.join(group, "copy_of", "left").select("id", "copy_of", F.coalesce("group_id", "copy_of").alias("group_id"))


def bucket_links(rows: DataFrame, signed: DataFrame, records: DataFrame, threshold: float, small: int = SMALL, splits: int = SPLITS, direct: float = DIRECT) -> DataFrame:
    """Verified links (a, b) that join all members of the buckets `rows` (id, key) that belong together."""
    sketches = signed.select("id", "sketch")
    links = comp = None
    for level in range(splits + 1):
        buckets = rows.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("size")).filter("size > 1")
        members = cut(rows.join(buckets, "key"))
        star = members.filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
        found = _verified(star, records, sketches, threshold)
        links = cut(found if links is None else links.unionByName(found).distinct())
        if comp is None:  # later levels are small: they gain less from newer components than these cost
            comp = connected_components(links).withColumnRenamed("node", "id")
        # buckets of two are settled by their one comparison
        larger = members.filter("size > 2").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
        # several components: more than the head's; min and max tell without counting distinct values
        mixed = larger.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
        larger = cut(larger.join(mixed, "key", "left_semi").select("key", "id", "component", "size"))
        # comparisons that the large buckets ask for; as long as they are few for the cluster nothing needs splitting
        asked = larger.filter(F.col("size") > small).agg(F.sum(F.col("size").cast("double"))).first()[0] or 0.0
        last = level == splits or asked <= direct
        close = larger if last else larger.filter(F.col("size") <= small)
        pair = close.alias("x").join(close.alias("y"), "key").filter("x.id < y.id AND x.component <> y.component")
        pair = pair.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
        links = cut(links.unionByName(_verified(pair, records, sketches, threshold)).distinct())
        if last:
            return links
        wide = larger.filter(F.col("size") > small)
        own = F.slice("parts", level * PARTS + 1, PARTS)
        parts = wide.select("key", "id").join(signed.select("id", own.alias("parts")), "id").select("id", "key", F.posexplode("parts").alias("no", "part"))
        rows = parts.select("id", F.xxhash64("key", "no", "part").alias("key"))
    return links
