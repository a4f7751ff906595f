"""One consistent form for text that looks the same but is stored in different characters.

The skeleton of a text: decompose it, replace every character by its prototype, decompose again. Texts with equal
skeletons look the same to a reader. Prototypes:

* presentation forms (full-width, half-width, mathematical letters, ligatures) stand for the letters they show;
* every space character of the separator class stands for the plain space, invisible format characters for nothing;
* look-alike letters of other scripts stand for the ASCII letter they resemble.

Case, accents, punctuation, wording, line breaks and any two ASCII characters stay different.

Defined results: null gives null, the empty text itself; whole texts are processed, whatever their length.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.runtime import spread

# Letters of other scripts that look like an ASCII letter, by script, in pairs "look-alike letter".
LOOK_ALIKES = """
а a  е e  о o  р p  с c  у y  х x  ѕ s  і i  ј j  һ h  ԁ d  ԛ q  ԝ w  ӏ l  ү y  к k  ѵ v  ԍ g  ь b
А A  В B  Е E  К K  М M  Н H  О O  Р P  С C  Т T  Х X  У Y  Ѕ S  І I  Ј J  Ԁ D  Ԛ Q  Ԝ W  Ү Y  Ӏ I  Ѵ V  Ԍ G
α a  ι i  κ k  ν v  ο o  ρ p  υ u  ϲ c  ϳ j  γ y  ω w
Α A  Β B  Ε E  Ζ Z  Η H  Ι I  Κ K  Μ M  Ν N  Ο O  Ρ P  Τ T  Υ Y  Χ X  Ϲ C  Ϳ J
օ o  ս u  հ h  ց g  զ q  յ j  ո n  ք p  Օ O  Տ S  Ս U  Լ L
ɑ a  ɡ g  ı i  ɩ i  ɪ i  ʋ u  ʏ y  ᴄ c  ᴋ k  ᴏ o  ᴜ u  ᴠ v  ᴡ w  ᴢ z  ꜱ s  ƅ b  ƽ s  ȷ j  ɯ w
Ꭺ A  Ᏼ B  Ꮯ C  Ꭰ D  Ꭼ E  Ꮐ G  Ꮋ H  Ꭻ J  Ꮶ K  Ꮮ L  Ꮇ M  Ꮲ P  Ꭱ R  Ꮪ S  Ꭲ T  Ꮩ V  Ꮃ W  Ꮓ Z
ꓮ A  ꓐ B  ꓚ C  ꓓ D  ꓰ E  ꓝ F  ꓖ G  ꓧ H  ꓲ I  ꓙ J  ꓗ K  ꓡ L  ꓟ M  ꓠ N  ꓳ O  ꓑ P  ꓣ R  ꓢ S  ꓔ T  ꓴ U  ꓦ V  ꓪ W  ꓫ X  ꓬ Y  ꓜ Z
ⲟ o  ⲣ p  ⲥ c  Ⲃ B  Ⲏ H  Ⲓ I  Ⲕ K  Ⲙ M  Ⲛ N  Ⲟ O  Ⲣ P  Ⲥ C  Ⲧ T  Ⲭ X  Ⲩ Y  Ⲍ Z
𐐬 o  𐐽 c  𐐄 O  𐐕 C  𐐛 L
‐ -  ‑ -
۰ ٠  ۱ ١  ۲ ٢  ۳ ٣  ۷ ٧  ۸ ٨  ۹ ٩
"""
#: Scripts whose small letters are drawn as small capitals: they look like the small letter where both cases share a shape.
SMALL_CAPITALS = "CHEROKEE SMALL LETTER"
SAME_SHAPE = "COSVWZ"
# Compatibility classes of Unicode whose members look like what they stand for.
SHOWN_AS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>")
# Invisible characters outside the format class.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"


def read_confusables(path: str) -> dict[int, str]:
    """Prototypes from a file in the format of the Unicode confusables data: source; prototype; class, in hexadecimal. Pairs
    of two ASCII characters stay apart, and prototypes are followed to their end."""
    out: dict[int, str] = {}
    for line in open(path, encoding="utf-8-sig"):
        parts = line.split("#")[0].split(";")
        if len(parts) >= 2:
            source = [int(x, 16) for x in parts[0].split()]
            if len(source) == 1 and source[0] >= 0x80:
                out[source[0]] = "".join(chr(int(x, 16)) for x in parts[1].split())
    return out


@lru_cache(4)
def prototypes(table: str | None = None) -> dict[int, str]:
    """The prototype of every character that has one: from rules on Unicode's own properties, the pairs above and, if it
    is given, a confusables file (`table`), whose entries win."""
    pairs = LOOK_ALIKES.split()
    out = {ord(a): b for a, b in zip(pairs[::2], pairs[1::2])}
    out |= {ord(c.lower()): out[ord(c)].lower() for c in map(chr, list(out)) if out[ord(c)] in SAME_SHAPE and unicodedata.name(c.lower(), "").startswith(SMALL_CAPITALS)}
    out |= read_confusables(table) if table else {}
    for c in range(0x80, sys.maxunicode + 1):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat in ("Cs", "Cn", "Co"):
            continue
        if cat == "Zs":
            out[c] = " "
        elif cat == "Cf" or ch in INVISIBLE or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF:
            out[c] = ""
        elif c not in out and unicodedata.decomposition(ch).startswith(SHOWN_AS):
            shown = unicodedata.normalize("NFKD", ch)
            if not shown.startswith(" "):  # spacing accents would become a space and a mark
                out[c] = "".join(out.get(ord(x), x) for x in shown)
    return out


def skeleton(text: str | None, table: str | None = None) -> str | None:
    if text is None or text.isascii():
        return text
    mapped = unicodedata.normalize("NFD", text).translate(prototypes(table))
    return unicodedata.normalize("NFD", mapped)


def consistent(text: str | None, table: str | None = None) -> str | None:
    """The skeleton in composed form: the one text that stands for all its look-alikes."""
    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFC", skeleton(text, table))


@F.pandas_udf(T.StringType())
def consistent_udf(s: pd.Series) -> pd.Series:
    return s.map(consistent, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def consistent_array_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda a: None if a is None else [consistent(t) for t in a])


def consistent_texts(texts: Column) -> Column:
    """`consistent` over an array of texts."""
    return consistent_array_udf(texts)


def reader_words(text: str | None) -> list[str]:
    """Words as a reader sees them: runs without spaces of the consistent text, lower-cased, less outer punctuation."""
    if not text:
        return []
    out = []
    for w in consistent(text).lower().split():
        if w[0].isalnum() and w[-1].isalnum():
            out.append(w)
            continue
        a, b = 0, len(w)
        while a < b and not w[a].isalnum():
            a += 1
        while b > a and not (w[b - 1].isalnum() or unicodedata.category(w[b - 1])[0] == "M"):
            b -= 1
        if a < b:
            out.append(w[a:b])
    return out


def look_alike_groups(df: DataFrame, key: str, texts: str) -> DataFrame:
    """(rec, skeleton_id, variant_id) for every record: equal skeleton_id means that all texts look the same in order,
    equal variant_id that they are stored in the same characters. A null array or null text is a text of its own."""
    picked = df.select(F.col(f"`{key}`").alias("rec"), F.col(f"`{texts}`").alias("t"))
    # only texts outside ASCII can change, so the others keep their own hash and never enter Python's inner loop
    forms = spread(picked, "rec").select("rec", "t", consistent_array_udf("t").alias("c"))
    exact = lambda c: F.sha2(F.to_json(F.struct(F.col(c).alias("x")), {"ignoreNullFields": "false"}), 256)
    return forms.select("rec", exact("c").alias("skeleton_id"), exact("t").alias("variant_id"))


def look_alike_classes(groups: DataFrame) -> DataFrame:
    """(rec, class_rec, variant_rec, links) for every record: the smallest record of equal skeleton, the smallest stored in
    the same characters, and the number of records of equal skeleton and different characters. Sizes are summed per
    variant before anything is joined, so a class may hold a third of all records."""
    variants = groups.groupBy("skeleton_id", "variant_id").agg(F.count("*").alias("n"), F.min("rec").alias("variant_rec"))
    classes = variants.groupBy("skeleton_id").agg(F.sum("n").alias("all"), F.min("variant_rec").alias("class_rec"))
    known = variants.join(classes, "skeleton_id").select("skeleton_id", "variant_id", "class_rec", "variant_rec", (F.col("all") - F.col("n")).alias("links"))
    return groups.join(known, ["skeleton_id", "variant_id"]).select("rec", "class_rec", "variant_rec", "links")


def look_alike_pairs(groups: DataFrame) -> DataFrame:
    """Record pairs (rec_a < rec_b) of equal skeleton and different characters.

    Groups with one variant, however large, leave before the join; the rest are joined per pair of variants, so that
    exact copies are never paired with each other.
    """
    variants = groups.groupBy("skeleton_id", "variant_id").agg(F.count("*").alias("n"))
    several = variants.groupBy("skeleton_id").agg(F.count("*").alias("v")).filter("v > 1").select("skeleton_id")
    alive = groups.join(several, "skeleton_id", "left_semi")
    pairs = variants.join(several, "skeleton_id", "left_semi").select("skeleton_id", F.col("variant_id").alias("va"))
    pairs = pairs.join(pairs.select("skeleton_id", F.col("va").alias("vb")), "skeleton_id").filter("va < vb")
    left = alive.select("skeleton_id", F.col("variant_id").alias("va"), F.col("rec").alias("a"))
    right = alive.select("skeleton_id", F.col("variant_id").alias("vb"), F.col("rec").alias("b"))
    joined = pairs.join(left, ["skeleton_id", "va"]).join(right, ["skeleton_id", "vb"])
    return joined.filter("a <> b").select(F.least("a", "b").alias("rec_a"), F.greatest("a", "b").alias("rec_b"))
