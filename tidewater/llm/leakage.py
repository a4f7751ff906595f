"""Evaluation passages inside a training corpus.

Passages are windows of `window` words. Every window of every item and of every document gets a 64-bit SimHash. A
multi-index over the items' fingerprints cuts them into radius + 1 blocks of bits: two fingerprints within the radius
agree in at least one block, so looking up each block finds all of them. Candidates within the radius are verified by
exact weighted similarity of their word shingles (weight = rarity among the items). Adjoining verified windows that
are equal word by word form runs; a run of at least `min_words` words of the item is a leak.

The items are the stated query set; the corpus passes by once per block of items, and a block's index has a proven
size: items are cut into blocks by their measured length before anything is collected. Documents are never shuffled
or cut: each is read whole inside its own partition.

Words: runs of letters, digits and combining marks of the consistent lower-cased text, so case, punctuation and
spacing do not matter; lengths are counted in the item's own space-separated words.

Defined results: null and short texts (fewer than `window` words) leak nothing and are leaked nowhere; repeated
documents and items are reported under each id; empty tables give an empty result; null ids are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.skeleton import consistent
from tidewater.runtime import importable, spread

TOKEN = re.compile(r"(?:[^\W_]|[̀-ͯऀ-ॣঁ-ৣ])+")
#: Characters of item text whose index one broadcast may hold (about 60 bytes a character).
BLOCK_CHARS = 2_000_000
SLICE = 1 << 16


def words(text: str) -> list[str]:
    return TOKEN.findall(consistent(text).lower())


def words_and_owner(text: str) -> tuple[list[str], list[int]]:
    """Tokens of a text and, for each, the number of the space-separated word it is part of."""
    toks, owner = [], []
    n = 0
    for chunk in consistent(text).lower().split():
        got = TOKEN.findall(chunk)
        toks += got
        owner += [n] * len(got)
        n += bool(got)
    return toks, owner


def hash_words(ws: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in ws), dtype=np.uint64, count=len(ws))


def simhash_windows(h: np.ndarray, window: int) -> np.ndarray:
    """SimHash of every window of consecutive word hashes (len(h) - window + 1 values)."""
    if len(h) < window:
        return np.empty(0, dtype=np.uint64)
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16)
    votes = np.cumsum(bits, axis=0, dtype=np.int32)
    total = votes[window - 1 :].copy()
    total[1:] -= votes[:-window]
    ones = 2 * total > window
    return np.packbits(ones, axis=1).view(">u8").ravel().astype(np.uint64)


class ItemIndex:
    """Fingerprints of all item windows with a multi-index of radius + 1 bit blocks."""

    def __init__(self, items: list[tuple[int, str]], window: int, radius: int):
        self.window, self.radius = window, radius
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        hashes, owners, starts, item_of = [], [], [], []
        self.token_start = np.zeros(len(items) + 1, dtype=np.int64)
        for k, (_, text) in enumerate(items):
            toks, owner = words_and_owner(text)
            hashes.append(hash_words(toks))
            owners.append(np.array(owner, dtype=np.int32))
            n = max(0, len(toks) - window + 1)
            starts.append(self.token_start[k] + np.arange(n))
            item_of.append(np.full(n, k))
            self.token_start[k + 1] = self.token_start[k] + len(toks)
        cat = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.empty(0, t)
        self.hashes, self.owner = cat(hashes, np.uint64), cat(owners, np.int32)
        self.start, self.item = cat(starts, np.int64), cat(item_of, np.int64)
        self.prints = cat([simhash_windows(h, window) for h in hashes], np.uint64)
        # rarity of a word among the items weighs its shingles
        uniq, inv = np.unique(self.hashes, return_inverse=True)
        where = np.searchsorted(self.token_start, np.arange(len(self.hashes)), side="right") - 1
        df = np.bincount(np.unique(np.stack([inv, where]), axis=1)[0], minlength=len(uniq)) if len(uniq) else np.empty(0)
        self.words, self.rarity = uniq, np.log(1 + len(items) / np.maximum(df, 1))
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = [(int(a), (1 << int(b - a)) - 1) for a, b in zip(edges[:-1], edges[1:])]
        self.sorted = []
        for shift, mask in self.blocks:
            v = (self.prints >> np.uint64(shift)) & np.uint64(mask)
            order = np.argsort(v, kind="stable")
            self.sorted.append((v[order], order))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document window, item window) pairs within the radius, each once."""
        found = []
        for (shift, mask), (values, order) in zip(self.blocks, self.sorted):
            v = (prints >> np.uint64(shift)) & np.uint64(mask)
            lo, hi = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
            n = hi - lo
            total = int(n.sum())
            if not total:
                continue
            w = np.repeat(np.arange(len(prints)), n)
            at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            i = order[at]
            near = np.bitwise_count(prints[w] ^ self.prints[i]) <= self.radius
            found.append(w[near] * np.int64(max(1, len(self.prints))) + i[near])
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.unique(np.concatenate(found))
        return both // max(1, len(self.prints)), both % max(1, len(self.prints))

    def similarity(self, a: np.ndarray, b: np.ndarray, shingle: int) -> float:
        """Weighted Jaccard similarity of the word shingles of two windows."""

        def weigh(h: np.ndarray) -> dict[bytes, float]:
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            w = np.where(self.words[at] == h, self.rarity[at], np.log(1 + len(self.ids)))
            out: dict[bytes, float] = {}
            for k in range(len(h) - shingle + 1):
                key = h[k : k + shingle].tobytes()
                out[key] = out.get(key, 0.0) + float(w[k : k + shingle].sum())
            return out

        x, y = weigh(a), weigh(b)
        low = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
        high = sum(x.values()) + sum(y.values()) - low
        return low / high if high else 0.0


def _match(index: ItemIndex, doc_no: np.ndarray, h: np.ndarray, shingle: int, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """Verified (document number, item number, similarity, words in the longest exact run, windows) per pair."""
    win = index.window
    span = np.arange(win)
    hits = []
    for a in range(0, max(0, len(h) - win + 1), SLICE):
        part = h[a : a + SLICE + win - 1]
        prints = simhash_windows(part, win)
        w, i = index.candidates(prints)
        w = w + a
        inside = doc_no[w] == doc_no[w + win - 1]
        hits.append((w[inside], i[inside]))
    if not hits:
        return []
    w, i = (np.concatenate(x) for x in zip(*hits))
    if not len(w):
        return []
    exact = (h[w[:, None] + span] == index.hashes[index.start[i][:, None] + span]).all(axis=1)
    sim = np.ones(len(w))
    for k in np.flatnonzero(~exact):
        sim[k] = index.similarity(h[w[k] : w[k] + win], index.hashes[index.start[i[k]] : index.start[i[k]] + win], shingle)
    good = sim >= threshold
    w, i, exact, sim = w[good], i[good], exact[good], sim[good]
    # runs: exact windows that follow each other in the document and in the item
    out: dict[tuple[int, int], list] = {}
    order = np.lexsort((w, w - index.start[i], index.item[i], doc_no[w]))
    run_from = run_to = run_key = None

    def close() -> None:
        if run_key is None:
            return
        a, b = index.start[run_from], index.start[run_to] + win  # item tokens of the run
        lo, hi = index.token_start[index.item[run_from]], index.token_start[index.item[run_from] + 1]
        own = index.owner[a:b]
        n = int(own[-1] - own[0] + 1)
        if a > lo and index.owner[a - 1] == own[0]:
            n -= 1
        if b < hi and index.owner[b] == own[-1]:
            n -= 1
        rec = out[run_key[:2]]
        rec[1] = max(rec[1], n)

    for k in order:
        pair = (int(doc_no[w[k]]), int(index.item[i[k]]))
        rec = out.setdefault(pair, [0.0, 0, 0])
        rec[0] = max(rec[0], float(sim[k]))
        rec[2] += 1
        if not exact[k]:
            continue
        key = (*pair, int(w[k] - index.start[i[k]]))
        if run_key == key and index.start[i[k]] == index.start[run_to] + 1:
            run_to = i[k]
        else:
            close()
            run_from, run_to, run_key = i[k], i[k], key
    close()
    return [(d, t, *v) for (d, t), v in out.items()]


OUT = "doc_id long, item_id long, similarity double, run_words int, windows int"


def leaks(docs: DataFrame, items: DataFrame, window: int = 12, radius: int = 3, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, similarity, run_words, windows) of every document and item that share a verified window.

    `docs`: (doc_id, text), `items`: (item_id, text).
    """
    spark = docs.sparkSession
    importable(spark)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL"), "doc_id")
    out = None
    for b in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        index = spark.sparkContext.broadcast(ItemIndex([(r["item_id"], r["text"]) for r in mine.orderBy("item_id").collect()], window, radius))

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
                rows, lot, size = [], [], 0
                for k in range(len(ids) + 1):
                    if lot and (k == len(ids) or size > 4 * SLICE):
                        flat = [t for _, ts in lot for t in ts]
                        codes, uniq = pd.factorize(np.array(flat, dtype=object))
                        h = hash_words(list(uniq))[codes] if len(flat) else np.empty(0, np.uint64)
                        no = np.repeat(np.arange(len(lot)), [len(ts) for _, ts in lot])
                        rows += [(lot[d][0], int(index.value.ids[t]), s, r, n) for d, t, s, r, n in _match(index.value, no, h, shingle, threshold)]
                        lot, size = [], 0
                    if k < len(ids):
                        ts = words(texts[k])
                        if len(ts) >= window:
                            lot.append((ids[k], ts))
                            size += len(ts)
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "similarity", "run_words", "windows"])

        part = docs.mapInPandas(run, OUT)
        out = part if out is None else out.unionByName(part)
    # repeated ids in the corpus meet here; only the leaks are shuffled
    return out.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.max("run_words").alias("run_words"), F.sum("windows").cast("long").alias("windows"))
