"""Generating corpus records up to their targets: deficits, prompts, a generator, parsing, deduplication, ids.

A generator is any function from (subtype, prompt, number wanted) to the text of a structured batch. It runs on the
executors, one row for each subtype and round; `paced` wraps it with rotation over models and their limits. A call that
fails counts as an empty batch. A subtype whose round adds nothing is given up, the others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import curation as C
from tidewater.runtime import cut
from tidewater.sources.providers import Rotator

Generator = Callable[[str, str, int], str]

#: What a generator is asked to return.
BATCH = "examples array<struct<subtype:string,turns:array<struct<speaker:string,text:string>>,label:struct<contains_violation:boolean,options:array<string>,action:string,violation_type:string>>>"
TEMPLATE = "Write {N} more conversations like these: {examples_json}"


def stub_generator(subtype: str, prompt: str, n: int) -> str:
    """A deterministic stand-in: n conversations, every fourth one a repeat of the first."""
    import json

    text = lambda k: f"{subtype} request {k if k % 4 else 0}"
    return json.dumps({"examples": [{"turns": [{"speaker": "guest", "text": text(k)}], "label": {"contains_violation": False}} for k in range(n)]})


def paced(call: Callable[[str, str, int], str], rotator: Rotator) -> Callable[[str, str, int], str]:
    """`call(model, prompt, n)` with the next model that has calls left, no faster than its pace; failures count."""

    def run(subtype: str, prompt: str, n: int) -> str:
        model = rotator.next()
        rotator.paces[model].wait()
        return call(model, prompt, n)

    return run


def requests(corpus: DataFrame, targets: DataFrame, batch: int, template: str = TEMPLATE) -> DataFrame:
    """(subtype, have, next_batch, prompt) of the subtypes that lack records. The prompt shows the subtype's first record."""
    need = C.deficits(corpus, targets, batch).filter("next_batch > 0")
    shown = corpus.groupBy("subtype").agg(F.min_by(F.get("turns.text", F.lit(0)), "line_no").alias("example"))
    examples = F.when(F.col("example").isNotNull(), F.array("example")).otherwise(F.array().cast("array<string>"))
    return need.join(shown, "subtype", "left").select("subtype", "have", "next_batch", C.prompts(template, F.col("next_batch"), examples).alias("prompt"))


def generate_round(corpus: DataFrame, targets: DataFrame, batch: int, generator: Generator = stub_generator, template: str = TEMPLATE) -> DataFrame:
    """(id, subtype, turns, label) of one batch for each subtype that lacks records: replies are parsed, repeats of
    anything already there or of each other are dropped, the rest is numbered on from what the subtype has.

    Replies that are no batch, and examples without turns, give nothing; the model's own subtype wins over the asked."""
    asked = requests(corpus, targets, batch, template)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for subtype, prompt, n in zip(b["subtype"], b["prompt"], b["next_batch"]):
                try:
                    out.append((subtype, generator(subtype, prompt, int(n))))
                except Exception:  # a failed call is an empty batch
                    out.append((subtype, None))
            yield pd.DataFrame(out, columns=["asked", "reply"])

    # replies are paid for: they are written once and never asked for again when a later stage is retried
    replies = cut(asked.select("subtype", "prompt", "next_batch").mapInPandas(run, "asked string, reply string"))
    made = replies.select("asked", F.posexplode(F.from_json("reply", BATCH)["examples"]).alias("place", "e"))
    made = made.select(F.coalesce("e.subtype", "asked").alias("subtype"), "asked", "place", F.col("e.turns").alias("turns"), F.col("e.label").alias("label")).filter("size(turns) > 0")
    # an order of arrival over all replies
    rank = F.dense_rank().over(_by("asked"))
    made = made.withColumn("line_no", rank.cast("long") * 1_000_000 + F.col("place"))
    fresh = C.new_examples(made, corpus)
    have = asked.select("subtype", "have")
    return C.assign_ids(fresh, have).select("id", "subtype", "turns", "label")


def _by(c: str):
    from pyspark.sql.window import Window

    # one row for each asked subtype and example of a round: targets x batch, a parameter table
    return Window.orderBy(c)


def generate(corpus: DataFrame, targets: DataFrame, batch: int, generator: Generator = stub_generator, rounds: int = 1000) -> DataFrame:
    """(id, subtype, turns, label) of all rounds until nothing is missing or no subtype gains anything."""
    base = corpus.select("line_no", "subtype", "turns")
    made, left = None, targets
    for _ in range(rounds):
        seen = base if made is None else base.unionByName(made.select(F.lit(1 << 40).alias("line_no"), "subtype", "turns"))
        new = cut(generate_round(seen, left, batch, generator))
        gained = new.groupBy("subtype").agg(F.count("*").alias("n"))
        made = new if made is None else made.unionByName(new)
        left = cut(left.join(gained, "subtype", "left_semi"))
        if left.isEmpty():
            break
    return made
