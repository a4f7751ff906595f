"""Language of documents, records and their segments, by a byte convolutional network.

* Network: byte embedding, convolutions of several widths, maximum over positions, softmax. It is trained in numpy on
  a bounded sample of labelled text (`Sample`: rows per language), from labels that may be wrong: after a first
  training the windows that contradict their label are left out and the network is trained again.
* Input: windows of `LENGTH` bytes of the text as a reader sees it (look-alike characters resolved, lower case, without
  accents, numbers and addresses). Long segments have several windows; their probabilities are averaged, so whole texts are read.
* Languages outside the training: text with few familiar strings of four bytes is 'other', with a low confidence.
* Segments: lines of documents, sentences of conversation turns. Each gets a language and a confidence.

Only the weights (about 100 KB, fixed by the architecture) reach the executors; the texts are scored in place, in
Arrow batches, without a shuffle.

Defined results: null and blank texts, and segments without letters, have no language; repeated rows are scored each;
an empty table, or labels of none of the languages, gives an untrained model only if there is nothing to score.
"""

from __future__ import annotations

import hashlib
import io
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.skeleton import consistent
from tidewater.runtime import read_bytes, spread, write_bytes

LENGTH = 96
WIDTHS = (2, 3, 4, 6)
FILTERS = 32
EMBED = 16
LANGUAGES = ("en", "hinglish", "hi", "es", "fr", "de")
#: The language of text that is in none of those learned, the share of familiar strings below which text is that, and
#: the strings it needs to be judged by.
OTHER, FAMILIAR, FEWEST_GRAMS = "other", 0.5, 24
GRAM_SPACE = 1 << 20
SENTENCE = re.compile(r"(?<=[.?!।…])[\"'”’)]*\s+|[\r\n]+")
LETTERS = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Sample:
    """Bounds of the training sample, for each source of labels."""

    rows_per_language: int = 1200
    windows_per_language: int = 2400
    epochs: int = 7
    seed: int = 11


ADDRESSES = re.compile(r"\S*[@_/\\\d#]\S*")
MARKS = re.compile("[\u0300-\u036f]")
PLAIN_WORD = re.compile(r"(?<![^\s\"'“‘(])[^\W\d_](?:[^\W\d_]|[\u0900-\u097f'’-])+(?=[\s.,;:!?…।\"'”’)]|$)")


def prepared(text: str) -> bytes:
    """What the network reads. Accents go, since borrowed dish names carry them into any language; so do tokens with
    digits and address signs, which belong to none."""
    t = MARKS.sub("", unicodedata.normalize("NFD", consistent(text).lower()))
    return re.sub(r"\s+", " ", ADDRESSES.sub(" 0 ", t)).strip().encode("utf-8", "ignore")


def plain_words(text: str) -> int:
    """Words of two letters or more that are no addresses or numbers."""
    return len(PLAIN_WORD.findall(text))


def windows(data: bytes, length: int = LENGTH) -> list[bytes]:
    """Windows that cover the data; the last one ends with it."""
    if len(data) <= length:
        return [data]
    starts = list(range(0, len(data) - length, length)) + [len(data) - length]
    return [data[s : s + length] for s in starts]


def as_matrix(ws: list[bytes], length: int = LENGTH) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(length, b"\0") for w in ws), dtype=np.uint8).reshape(-1, length)


class ByteCNN:
    """The network; `fit` and `predict` in numpy."""

    def __init__(self, classes: tuple[str, ...], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"E": rng.normal(0, 0.3, (256, EMBED)).astype(np.float32)}
        self.p["E"][0] = 0
        for w in WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["D"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.p["d"] = np.zeros(len(classes), np.float32)
        self.grams: np.ndarray | None = None

    def _forward(self, x: np.ndarray, keep: bool = False):
        emb = self.p["E"][x]  # batch, length, embed
        feats, where = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            cols = np.lib.stride_tricks.as_strided(emb, (len(x), n, w * EMBED), (*emb.strides[:2], emb.strides[2]))
            z = cols.reshape(-1, w * EMBED) @ self.p[f"W{w}"]
            z = z.reshape(len(x), n, FILTERS)
            if keep:
                at = z.argmax(axis=1)
                where.append(at)
                top = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0]
            else:
                top = z.max(axis=1)
            feats.append(np.maximum(top + self.p[f"b{w}"], 0))
        f = np.concatenate(feats, axis=1)
        logits = f @ self.p["D"] + self.p["d"]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return (e / e.sum(axis=1, keepdims=True), f, where, emb) if keep else e / e.sum(axis=1, keepdims=True)

    def _gradients(self, x: np.ndarray, y: np.ndarray, drop: np.ndarray) -> dict[str, np.ndarray]:
        prob, f, where, emb = self._forward(x, True)
        f = f * drop
        logits = f @ self.p["D"] + self.p["d"]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        g = e / e.sum(axis=1, keepdims=True)
        g[np.arange(len(y)), y] -= 1
        g /= len(y)
        out = {"D": f.T @ g, "d": g.sum(axis=0)}
        back = (g @ self.p["D"].T) * drop * (f > 0)
        out["E"] = np.zeros_like(self.p["E"])
        for k, w in enumerate(WIDTHS):
            gb = back[:, k * FILTERS : (k + 1) * FILTERS]
            pos = where[k][:, :, None] + np.arange(w)  # batch, filter, width
            win = emb[np.arange(len(x))[:, None, None], pos].reshape(len(x), FILTERS, w * EMBED)
            out[f"W{w}"] = np.einsum("bf,bfk->kf", gb, win, optimize=True)
            out[f"b{w}"] = gb.sum(axis=0)
            ge = (gb[:, :, None] * self.p[f"W{w}"].T[None]).reshape(-1, EMBED)
            cell = x[np.arange(len(x))[:, None, None], pos].ravel().astype(np.int64)[:, None] * EMBED + np.arange(EMBED)
            out["E"] += np.bincount(cell.ravel(), weights=ge.ravel(), minlength=256 * EMBED).reshape(256, EMBED).astype(np.float32)
        out["E"][0] = 0
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int, batch: int = 128, rate: float = 3e-3) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                xb = x[pick].copy()
                # crops of random length teach short segments
                cut_at = rng.integers(16, 2 * LENGTH, len(pick))
                xb[np.arange(LENGTH)[None, :] >= cut_at[:, None]] = 0
                drop = (rng.random((len(pick), FILTERS * len(WIDTHS))) > 0.25).astype(np.float32) / 0.75
                g = self._gradients(xb, y[pick], drop)
                t += 1
                step = rate * (0.5 if epoch >= epochs // 2 else 1) * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v2[k] = 0.999 * v2[k] + 0.001 * g[k] ** 2
                    self.p[k] = (self.p[k] - step * m[k] / (np.sqrt(v2[k]) + 1e-8)).astype(np.float32)

    def predict(self, x: np.ndarray, batch: int = 256) -> np.ndarray:
        """Probabilities of windows. Windows of like length are scored together, without the padding that all of them
        have beyond one filter's width, which changes no maximum."""
        out = np.empty((len(x), len(self.classes)), np.float32)
        ends = x.shape[1] - (x[:, ::-1] > 0).argmax(axis=1)
        order = np.argsort(ends, kind="stable")
        for a in range(0, len(x), batch):
            pick = order[a : a + batch]
            out[pick] = self._forward(np.ascontiguousarray(x[pick, : min(x.shape[1], int(ends[pick[-1]]) + max(WIDTHS))]))
        return out

    def languages(self, texts: list[str]) -> list[tuple[str | None, float]]:
        """(language, confidence) of each text, from all its windows. Equal texts and windows are scored once. A text whose
        strings of four bytes were hardly met while its best language was learned is in none of them: its language is
        'other', and the confidence falls with the share that was met."""
        number: dict[str, int] = {}
        which = [number.setdefault(t, len(number)) for t in texts]
        ws, owner = [], []
        for t, k in number.items():
            if LETTERS.search(t):
                own = windows(prepared(t))
                ws += own
                owner += [k] * len(own)
        found: list[tuple[str | None, float]] = [(None, 0.0)] * len(number)
        if ws:
            at: dict[bytes, int] = {}
            same = np.array([at.setdefault(w, len(at)) for w in ws])
            x = as_matrix(list(at))
            prob = self.predict(x)
            known, grams = self.familiar(x)
            n = np.bincount(owner, minlength=len(number))
            total = np.zeros((len(number), len(self.classes)))
            met, all_ = np.zeros_like(total), np.zeros(len(number))
            np.add.at(total, owner, prob[same])
            np.add.at(met, owner, known[same])
            np.add.at(all_, owner, grams[same])
            for k in np.flatnonzero(n):
                best = int(total[k].argmax())
                share = met[k, best] / all_[k] if self.grams is not None and all_[k] >= FEWEST_GRAMS else 1.0
                sure = float(total[k, best] / n[k])
                found[k] = (self.classes[best], sure) if share >= FAMILIAR else (OTHER, sure * float(share))
        return [found[k] for k in which]

    def learn_grams(self, x: np.ndarray, y: np.ndarray) -> None:
        """Remembers the strings of four bytes of each class, as bits of their hashes."""
        bits = np.zeros((len(self.classes), GRAM_SPACE), dtype=bool)
        code, real = gram_codes(x)
        for c in range(len(self.classes)):
            bits[c, code[y == c][real[y == c]]] = True
        self.grams = np.packbits(bits, axis=1)

    def familiar(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows x classes: strings that the class was learned with, strings of each window)."""
        code, real = gram_codes(x)
        if self.grams is None:
            return np.zeros((len(x), len(self.classes))), real.sum(axis=1)
        met = np.stack([(((g[code >> 3] >> (7 - (code & 7)).astype(np.uint8)) & 1).astype(bool) & real).sum(axis=1) for g in self.grams], axis=1)
        return met, real.sum(axis=1)

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, classes=np.array(self.classes), grams=self.grams if self.grams is not None else np.empty(0, np.uint8), **self.p)
        return out.getvalue()

    @staticmethod
    def loads(data: bytes) -> ByteCNN:
        z = np.load(io.BytesIO(data))
        model = ByteCNN(tuple(z["classes"].tolist()))
        model.p = {k: z[k] for k in z.files if k not in ("classes", "grams")}
        model.grams = z["grams"] if z["grams"].size else None
        return model


def gram_codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the four bytes at each place, whether none of them is padding)."""
    a = x.astype(np.uint32)
    code = (a[:, :-3] * 16777619 ^ a[:, 1:-2]) * np.uint32(16777619) ^ a[:, 2:-1]
    code = code * np.uint32(16777619) ^ a[:, 3:]
    return ((code ^ (code >> np.uint32(15))) % GRAM_SPACE).astype(np.int64), x[:, 3:] > 0


def language_name(c: Column) -> Column:
    """A language label without case, outer spaces and region."""
    return F.split(F.lower(F.trim(c)), "[-_]")[0]


#: Models of this process by the fingerprint of their sample.
_FITTED: dict[str, ByteCNN] = {}


def drawn_rows(labelled: DataFrame, sample: Sample, languages: tuple[str, ...]) -> dict[tuple[str, str], list[str]]:
    """(source, language) -> texts of the training sample: about `rows_per_language` of each, chosen by a hash of the
    text over all rows, so that copies of a text are in or out together and count once."""
    rows = labelled.filter(F.col("lang").isin(*languages) & F.col("text").isNotNull() & (F.length("text") > 5))
    counts = rows.groupBy("source", "lang").agg(F.count("*").alias("n"))  # one row per source and language
    rank = F.pmod(F.xxhash64(F.lit(sample.seed), "text"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    share = F.lit(float(sample.rows_per_language)) / F.col("n")
    drawn = rows.join(F.broadcast(counts), ["source", "lang"]).filter(rank < share).select("source", "lang", "text").distinct()
    by: dict[tuple[str, str], list[str]] = {}
    for r in drawn.collect():
        by.setdefault((r["source"], r["lang"]), []).append(r["text"])
    return {k: sorted(v) for k, v in sorted(by.items())}


def train(labelled: DataFrame, sample: Sample = Sample(), languages: tuple[str, ...] = LANGUAGES) -> ByteCNN:
    """The model of (source, lang, text). A sample that was fitted before, in this process or with its weights in the
    shared folder of spark.checkpoint.dir, is not fitted again."""
    by = drawn_rows(labelled, sample, languages)
    mark = hashlib.sha256(repr((sample, languages, LENGTH, WIDTHS, FILTERS, EMBED, by)).encode("utf-8", "surrogatepass")).hexdigest()
    if mark not in _FITTED:
        spark = labelled.sparkSession
        base = spark.conf.get("spark.checkpoint.dir", None)
        path = f"{base}/language-models/{mark}.npz" if base else None
        stored = read_bytes(spark, path) if path else None
        _FITTED[mark] = ByteCNN.loads(stored) if stored else fitted(by, sample, languages)
        if path and not stored:
            write_bytes(spark, path, _FITTED[mark].dumps())
    return _FITTED[mark]


def fitted(by: dict[tuple[str, str], list[str]], sample: Sample, languages: tuple[str, ...]) -> ByteCNN:
    rng = np.random.default_rng(sample.seed)
    ws, ys = [], []
    for (_, lang), texts in by.items():
        own = []
        for text in texts:
            for line in SENTENCE.split(text):
                if LETTERS.search(line):
                    own += windows(prepared(line))
        own = sorted(set(own))  # repeated texts teach once
        short = [w for w in own if len(w) < 48]
        own = [short[i] for i in rng.permutation(len(short))[: sample.windows_per_language // 3]] + [own[i] for i in rng.permutation(len(own))]
        for w in list(dict.fromkeys(own))[: sample.windows_per_language]:
            ws.append(w)
            ys.append(languages.index(lang))
    model = ByteCNN(languages, sample.seed)
    if not ws:
        return model
    x, y = as_matrix(ws), np.array(ys)
    model.fit(x, y, 2, sample.seed)
    agrees = model.predict(x).argmax(axis=1) == y  # wrong labels and foreign lines contradict what most rows taught
    model = ByteCNN(languages, sample.seed)
    model.fit(x[agrees], y[agrees], sample.epochs, sample.seed)
    model.learn_grams(x[agrees], y[agrees])
    return model


def segments(df: DataFrame, model: ByteCNN, mode: str, skip: Callable[[str], bool] | None = None) -> DataFrame:
    """(rec, seg_no, n_words, plain_words, lang, confidence) from (rec, texts array): one row per line (`mode` 'line') or sentence
    ('sentence') that is not blank; lang is null without letters. Segments are numbered through the record's texts.
    Texts that `skip` holds of have no segments."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    split = re.compile(r"\r\n|\r|\n") if mode == "line" else SENTENCE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, parts = [], []
            for rec, texts in zip(b["rec"], b["texts"]):
                n = 0
                for t in texts if texts is not None else []:
                    if t and skip is not None and skip(t):
                        continue
                    for s in split.split(t or ""):
                        if s.strip():
                            n += 1
                            keys.append((rec, n))
                            parts.append(s)
            rows = []
            for a in range(0, len(parts), 2048):
                got = shared.value.languages(parts[a : a + 2048])
                rows += [(*k, len(p.split()), plain_words(p), *g) for k, p, g in zip(keys[a : a + 2048], parts[a : a + 2048], got)]
            yield pd.DataFrame(rows, columns=["rec", "seg_no", "n_words", "plain_words", "lang", "confidence"])

    return spread(df.select("rec", "texts"), "rec").mapInPandas(run, "rec long, seg_no int, n_words int, plain_words int, lang string, confidence double")


def record_language(segs: DataFrame, sure: float = 0.6, long_words: int = 6, least_words: int = 3) -> DataFrame:
    """(rec, lang, confidence) of conversation records: hinglish if a segment mixes Hindi with English or both stand
    side by side, hi if all is Hindi, else en. A segment votes if it has `least_words` plain words, and below
    `long_words` only if its confidence is `sure`; records without a voting segment take their surest segment."""
    votes_ = (F.col("plain_words") >= long_words) | ((F.col("plain_words") >= least_words) & (F.col("confidence") >= sure))
    votes = segs.filter("lang IS NOT NULL").groupBy("rec").agg(
        *[F.max(F.when((F.col("lang") == k) & votes_, F.col("confidence"))).alias(k) for k in ("en", "hi", "hinglish")],
        F.max_by("lang", F.struct("plain_words", "confidence")).alias("any"),
        F.max_by("confidence", F.struct("plain_words", "confidence")).alias("top"),
    )
    mixed = F.col("hinglish").isNotNull() | (F.col("hi").isNotNull() & F.col("en").isNotNull())
    known = F.when(F.col("any").isin("hinglish", "hi"), F.col("any")).otherwise("en")
    lang = F.when(mixed, "hinglish").when(F.col("hi").isNotNull(), "hi").when(F.col("en").isNotNull(), "en").otherwise(known)
    sureness = F.when(F.col("hinglish").isNotNull(), F.col("hinglish")).when(mixed, F.least("hi", "en")).otherwise(F.coalesce("hi", "en", "top"))
    return votes.select("rec", lang.alias("lang"), sureness.alias("confidence"))


def document_language(segs: DataFrame) -> DataFrame:
    """(rec, lang, confidence) of texts: the language with the largest sum of confidence over the text's segments, each
    weighted by its plain words (one at least); confidence is that sum over the weight of all segments with letters, so
    lines in other languages lower it."""
    weight = F.greatest("plain_words", F.lit(1))
    per = segs.filter("lang IS NOT NULL").groupBy("rec", "lang").agg(F.sum(weight * F.col("confidence")).alias("mass"), F.sum(weight).alias("weight"))
    best = per.groupBy("rec").agg(F.max(F.struct("mass", "lang")).alias("best"), F.sum("weight").alias("weight"))
    return best.select("rec", F.col("best.lang").alias("lang"), (F.col("best.mass") / F.col("weight")).alias("confidence"))
