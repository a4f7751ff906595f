"""The curation pipeline: validate, check options, drop near-duplicates, report the balance, draw a spot check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater import constants as K
from tidewater.operators import curation as C
from tidewater.operators.embedding import Embedder, embed, hashed_words
from tidewater.runtime import cut


@dataclass
class Curated:
    """The clean corpus and every side output."""

    clean: DataFrame
    invalid: DataFrame
    flagged: DataFrame
    review: DataFrame
    balance: DataFrame
    unexpected: DataFrame
    spot_check: DataFrame


def curate(
    lines: DataFrame, targets: DataFrame, embeddings: DataFrame | None = None, drop_at: float = K.DROP_AT, review_at: float = K.REVIEW_AT, embedder: Embedder = hashed_words
) -> Curated:
    """`lines` (line_no, raw), `targets` (subtype, target), `embeddings` (line_no, embedding); without embeddings the
    `embedder` makes them from the records' joined turns."""
    valid, invalid = C.validate(lines)
    kept, flagged = C.check_options(valid)
    texts = kept.withColumn("__text", F.array_join("turns.text", " "))
    if embeddings is None:
        embeddings = cut(embed(texts, "line_no", "__text", embedder))
    pairs = C.vector_pairs(embeddings.join(kept.select("line_no"), "line_no", "left_semi"), "line_no", "embedding", review_at)
    chosen, _, review = C.deduplicate(texts.select("line_no", "__text"), pairs, "line_no", "__text", drop_at)
    clean = kept.join(chosen.select("line_no", "position"), "line_no")
    balance, unexpected = C.balance(clean, targets)
    return Curated(clean.drop("position"), invalid, flagged, review, balance, unexpected, C.spot_check(clean.drop("position")))
