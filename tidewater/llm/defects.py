"""Defective responses of prompt-response pairs, each with its defect.

* empty: null, or no letter or digit; and no response at all where one is due.
* refusal: a cue of declining together with a word for the task (a dictionary for English and Hindi in Latin letters),
  unless it is a person who declines to share a number.
* copy: the response is compressed with its prompt as the zstandard dictionary and the prompt with the response as the
  dictionary; if both shrink to less than half of their size without it, each holds the other.
* language: function-word dictionaries name the language of the response and the languages of the prompt.
* truncated: a terminal-context model. From all distinct responses it counts, for each pair of neighbouring words, how
  often the pair ends a response before a closing mark, ends it without one, and stands inside. A response without a
  closing mark is complete only if its last pair is known as an ending: from closed responses, or as a set phrase that
  many others end with and that hardly ever goes on. A trailing dash, ellipsis, comma or open bracket is a break by
  itself. No list of words takes part.

The first defect that holds is reported, in the order above. Prompts and responses are read whole, in place; only
contexts and counts are shuffled.

Defined results: a bare label word (one word with an underscore) has no defect; null prompts are empty texts, which
nothing copies and which fix no language; repeated records are reported under each id; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.skeleton import consistent
from tidewater.runtime import cut, spread

COPY_BELOW = 0.5
#: Share of all responses without a closing mark from which the same last words are a set phrase.
PHRASE_SHARE = 0.02

# Function words that are frequent in one language and rare in the others.
DICTIONARY = {
    "en": "the and of to in is it was on are with at be this have from or had by but not we you were our your i my will here can before please that for who which there what her his they a an another once me let would could",
    "hinglish": "hai hain ko ka ki ke mein pe aur nahi kya ne mere mera toh bhi woh tha thi kar tak ya apna gaya kahan yaar suno phir ab agar mujhe aapke kripya pehle uske baad kab bolo karo humne yahin lena dena hum main se par lo",
    "es": "el la los las de que y en un una por con no para es se del al nos si muy estaba cuando llegamos cada antes pero junto hasta",
    "fr": "le la les des et est une dans pour pas sur avec nous vous mais au du de un il avons était quand avant chaque à dès personne",
    "de": "der die das und ist nicht mit ein eine den von zu wir wenn uns aus hat im in war vor noch als bitte jeden auf",
}
# Cues of declining and words for the task, as stems.
DECLINES = re.compile(
    r"\b(?:can ?not|can['’]?t|won['’]?t|will not|not going to|unable|not able|declin\w+|refus\w+|apolog\w+|not something|not comfortable|not allowed|not permitted|"
    r"no alternative|outside (?:of )?(?:what|my)|beyond what|nahi (?:kar|de|likh|bana|ho|paa?)\w*(?: sak\w*)?|mana hai|mumkin nahi|khilaf|against|maaf|breaks? my)\b|request declined|\[refused\]",
    re.I,
)
TASK = re.compile(
    r"\b(?:re-?writ\w*|rephras\w*|paraphras\w*|prompt|request|content|guidelines?|polic(?:y|ies)|niyam|assist\w*|model|text|answer\w*|complet\w+|"
    r"produc\w+|generat\w+|respon\w+|jawab|alternative|aisa message|message ko dobara|this one|ai)\b",
    re.I,
)
PERSONAL = re.compile(r"\b(?:number|phone|contact details|address)\b", re.I)
CLOSED = re.compile(r"(?<![.…])[.?!।][\"'”’»)\]]*$")
BROKEN = re.compile(r"(?:[-–—,;:…(]|\.\.+)[\"'”’]?$")
WORD = re.compile(r"[^\W_]+(?:['’\-./:][^\W_]+)*|[ऀ-ॿ]+")
DEVANAGARI = re.compile(r"[ऄ-हक़-ॡ]")


@lru_cache(1)
def _dictionaries() -> dict[str, frozenset[str]]:
    return {k: frozenset(v.split()) for k, v in DICTIONARY.items()}


def language(text: str, least: int = 2) -> str | None:
    """The language whose function words lead, if there are `least` of them; hi for Devanagari."""
    ws = re.findall(r"[^\W\d_]+", text.lower())
    native = len(DEVANAGARI.findall(text))
    if native > 0.5 * len(re.sub(r"[\W\d_]", "", text)):
        return "hi" if native > 3 else None
    hits = {k: sum(w in d for w in ws) for k, d in _dictionaries().items()}
    best = max(hits, key=hits.get)
    return best if hits[best] >= least and sorted(hits.values())[-2] < hits[best] else None


def prompt_languages(sentences: list[str]) -> set[str]:
    """Languages of a prompt; Hindi beside English is hinglish."""
    got = {language(s) for s in sentences} - {None}
    if "hi" in got and ("en" in got or "hinglish" in got):
        got = got - {"hi"} | {"hinglish"}
    return got


def is_refusal(text: str) -> bool:
    return bool(DECLINES.search(text) and TASK.search(text) and not PERSONAL.search(text)) or "[refused]" in text.lower() or "request declined" in text.lower()


def _plain(text: str) -> str:
    return " ".join(WORD.findall(consistent(text).lower()))


class Compressor:
    """Sizes of texts with and without another text as raw dictionary."""

    def __init__(self, level: int = 9):
        import zstandard

        self.z = zstandard
        self.params = zstandard.ZstdCompressionParameters.from_level(level, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.bare = zstandard.ZstdCompressor(compression_params=self.params)

    def ratio(self, text: bytes, given: bytes) -> float:
        """Size of `text` given the other text, over its size alone."""
        d = self.z.ZstdCompressionDict(given, dict_type=self.z.DICT_TYPE_RAWCONTENT)
        return len(self.z.ZstdCompressor(compression_params=self.params, dict_data=d).compress(text)) / len(self.bare.compress(text))


def is_copy(response: str, prompt: str, z: Compressor, below: float = COPY_BELOW) -> bool:
    a, b = response.encode(), prompt.encode()
    if min(len(a), len(b)) < 8:
        return len(a) > 0 and a == b
    # a window that spans both texts lets the dictionary reach back as far as they are long
    return z.ratio(a, b) < below and z.ratio(b, a) < below


SENTENCES = re.compile(r"(?<=[.?!।…])\s+|[\r\n]+")
SCHEMA = "rec long, option_no int, defect string, closed boolean, broken boolean, last string, inner array<string>, words_key long"


def options_read(df: DataFrame) -> DataFrame:
    """Per response of (rec, texts, options, due): the defects that the pair alone shows, and the contexts for the
    terminal model: its last pair of words and the pairs inside it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = Compressor()
        for b in batches:
            rows = []
            for rec, texts, options, due in zip(b["rec"], b["texts"], b["options"], b["due"]):
                if options is None or len(options) == 0:
                    if due is True or due == 1:
                        rows.append((rec, 0, "empty", False, False, None, [], 0))
                    continue
                turns = [consistent(t) for t in (texts if texts is not None else []) if t]
                langs = prompt_languages([s for t in turns for s in SENTENCES.split(t)])
                prompt = _plain(" ".join(turns))
                for k, raw in enumerate(options, 1):
                    text = consistent(raw).strip() if raw is not None else ""
                    words = WORD.findall(text.lower())
                    if not words:
                        rows.append((rec, k, "empty", False, False, None, [], 0))
                        continue
                    if re.fullmatch(r"\w+", text) and "_" in text:
                        continue
                    defect = None
                    if is_refusal(text):
                        defect = "refusal"
                    elif is_copy(" ".join(words), prompt, z):
                        defect = "copy"
                    else:
                        own = language(text)
                        if own and langs and own not in langs:
                            defect = "language"
                    closed, broken = bool(CLOSED.search(text)), bool(BROKEN.search(text))
                    pairs = [f"{x} {y}" for x, y in zip(words, words[1:])] or [words[0]]
                    key = int.from_bytes(blake2b(" ".join(words).encode(), digest_size=8).digest(), signed=True)
                    rows.append((rec, k, defect, closed, broken, pairs[-1], pairs[:-1], key))
            yield pd.DataFrame(rows, columns=["rec", "option_no", "defect", "closed", "broken", "last", "inner", "words_key"])

    return spread(df.select("rec", "texts", "options", "due"), "rec").mapInPandas(run, SCHEMA)


def terminal_contexts(read: DataFrame) -> DataFrame:
    """(last, complete) for the pairs that end a response: known as an ending if it ends closed responses, or if it is
    a set phrase that ends many responses and hardly ever goes on. Responses of the same words count once, so copies
    of one response cannot vouch for themselves."""
    usable = read.filter("defect IS NULL AND last IS NOT NULL").dropDuplicates(["words_key", "closed", "broken"])
    ends = usable.select(F.col("last").alias("pair"), F.col("closed").cast("int").alias("closed"), (~F.col("closed") & ~F.col("broken")).cast("int").alias("open"), F.lit(0).alias("inside"))
    inside = usable.select(F.explode("inner").alias("pair"), F.lit(0).alias("closed"), F.lit(0).alias("open"), F.lit(1).alias("inside"))
    counts = ends.unionByName(inside).groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("closed", "open", "inside")])
    unclosed = ends.agg(F.sum("open").alias("unclosed"))
    known = (F.col("closed") >= 2) & (F.col("closed") + F.col("open") > 0.05 * F.col("inside"))
    # the response itself is left out of what vouches for it
    phrase = (F.col("open") - 1 >= PHRASE_SHARE * F.col("unclosed")) & (F.col("open") > 1) & (F.col("open") > 9 * F.col("inside"))
    return counts.filter("closed + open > 0").withColumn("unclosed", unclosed.scalar()).select(F.col("pair").alias("last"), (known | phrase).alias("complete"))


def defective(df: DataFrame) -> DataFrame:
    """(rec, option_no, defect) from (rec, texts array, options array, due boolean)."""
    read = cut(options_read(df))
    shown = read.filter("defect IS NOT NULL").select("rec", "option_no", "defect")
    rest = read.filter("defect IS NULL AND NOT closed").select("rec", "option_no", "broken", "last")
    judged = rest.join(terminal_contexts(read), "last", "left").filter(F.col("broken") | ~F.coalesce("complete", F.lit(False)))
    return shown.unionByName(judged.select("rec", "option_no", F.lit("truncated").alias("defect")))
