"""Filling training windows of fixed capacity with whole texts.

1. Sizes: each text is measured in tokens of a public tokenizer (its file is a parameter).
2. Splitting: only a text longer than a window is cut, into full windows and a rest.
3. Vector best-fit, largest first: a piece asks for tokens, one document slot and attention cost (the square of its
   length, within a share of what one full text costs); among the open windows with room in every dimension the rule picks one: `norm` the window whose residual
   after placing has the smallest weighted norm, `dot` the one with the largest weighted dot product of demand and
   residual. Pieces are packed in shards of `shard_pieces` by hash, so shards are bounded at any corpus size; windows
   left emptier than `refill_below` are opened again and packed once more across shards.

Only ids and sizes are shuffled, never texts.

Defined results: null and empty texts have no tokens and stand in no window (window_id null); equal texts keep separate
pieces; texts that spell special tokens are ordinary text; an empty table gives no windows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.runtime import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of this vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of the whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [0 if t is None else len(enc.encode_ordinary(t)) for t in b["text"]]})

    picked = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return spread(picked, "doc_id").mapInPandas(run, "doc_id long, n_tokens long")


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece_no, start_token, n_tokens); only texts longer than a window have several pieces. Texts without
    tokens have none."""
    n = F.ceil(F.col("n_tokens") / capacity)
    rows = sizes.filter("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("piece_no"))
    start = (F.col("piece_no") - 1).cast("long") * capacity
    return rows.select("doc_id", "piece_no", start.alias("start_token"), F.least(F.lit(capacity), F.col("n_tokens") - start).alias("n_tokens"))


def best_fit(tokens: np.ndarray, capacity: int, max_docs: int, max_attention: float, weights: tuple[float, float, float], rule: str) -> np.ndarray:
    """The window number of each piece (pieces in any order; largest are placed first)."""
    limits = np.array([capacity, max_docs, max_attention], dtype=float)
    w = np.array(weights, dtype=float)
    order = np.argsort(-tokens, kind="stable")
    where = np.empty(len(tokens), dtype=np.int64)
    room = np.empty((max(16, len(tokens) // 4), 3))
    live = np.empty(len(room), dtype=np.int64)  # numbers of the open windows
    n_open, n_all = 0, 0
    smallest = tokens.min() if len(tokens) else 0
    for k in order:
        t = float(tokens[k])
        need = np.array([t, 1.0, t * t]) / limits
        free = room[:n_open]
        fits = (free >= need - 1e-12).all(axis=1)
        if fits.any():
            at = np.flatnonzero(fits)
            if rule == "norm":
                left = free[at] - need
                best = at[np.argmin((left * left) @ w)]
            else:
                best = at[np.argmax(free[at] @ (w * need))]
            free[best] -= need
            where[k] = live[best]
        else:
            if n_open == len(room):
                room, live = np.concatenate([room, np.empty_like(room)]), np.concatenate([live, np.empty_like(live)])
            room[n_open], live[n_open] = 1.0 - need, n_all
            where[k] = n_all
            best, n_open, n_all = n_open, n_open + 1, n_all + 1
        if room[best, 0] * capacity < smallest or room[best, 1] * max_docs < 1 - 1e-9:  # full: closed for good
            n_open -= 1
            room[best], live[best] = room[n_open], live[n_open]
    return where


def pack(
    parts: DataFrame,
    capacity: int = 2048,
    max_docs: int = 128,
    attention_share: float = 1.0,
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1),
    rule: str = "norm",
    shard_pieces: int = 20_000,
    refill_below: float = 0.97,
) -> DataFrame:
    """(window_id, doc_id, piece_no, start_token, n_tokens). `parts` should be materialised.

    A window's attention cost, the sum of its pieces' squared lengths, stays within `attention_share` x capacity^2. A
    piece that costs more by itself stands alone."""
    attention = attention_share * capacity * capacity
    schema = "window_id string, doc_id long, piece_no int, start_token long, n_tokens long"

    def packed(df: DataFrame, shards: int, tag: str) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable")
            no = best_fit(pdf["n_tokens"].to_numpy(), capacity, max_docs, attention, weights, rule)
            pdf["window_id"] = [f"{tag}-{s}-{n}" for s, n in zip(pdf["shard"], no)]
            return pdf[["window_id", "doc_id", "piece_no", "start_token", "n_tokens"]]

        keyed = df.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shards)))
        return keyed.groupBy("shard").applyInPandas(run, schema)

    whole = (F.col("n_tokens") >= capacity) | (F.col("n_tokens").cast("double") * F.col("n_tokens") > attention)
    alone = parts.filter(whole).select(F.concat(F.lit("f-"), "doc_id", F.lit("-"), "piece_no").alias("window_id"), "doc_id", "piece_no", "start_token", "n_tokens")
    rest = parts.filter(~whole)
    first = cut(packed(rest, max(1, -(-rest.count() // shard_pieces)), "a"))
    poor = first.groupBy("window_id").agg(F.sum("n_tokens").alias("t")).filter(F.col("t") < refill_below * capacity).select("window_id")
    again = cut(first.join(poor, "window_id", "left_semi").drop("window_id"))
    second = packed(again, max(1, -(-again.count() // shard_pieces)), "b")
    return alone.unionByName(first.join(poor, "window_id", "left_anti")).unionByName(second)


def fill_report(windows: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: windows, pieces, tokens, the fewest windows possible, and the share of unused room."""
    per = windows.groupBy("window_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c"))
    return per.agg(
        F.count("*").alias("windows"),
        F.sum("c").alias("pieces"),
        F.sum("t").alias("tokens"),
        F.max("t").alias("fullest"),
        F.ceil(F.sum("t") / capacity).alias("least_windows"),
        F.round(1 - F.sum("t") / (F.count("*") * capacity), 6).alias("unused_share"),
    )
