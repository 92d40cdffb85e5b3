"""Language identification by the nearest of several centroids per language.

A text's vector counts hashed n-grams of one to three letters, weighted by TF-IDF
and normalised. Each language's training vectors are clustered (spherical
k-means), and a text gets the language of the centroid with the greatest cosine.
Texts farther from it than nearly all of that language's training texts are
flagged as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need

DIM = 4096
#: The classifier is fitted on about this many distinct labelled documents of each language, chosen by a hash of id and text,
#: and on fewer of each where there are so many languages that TOTAL_SAMPLE would be exceeded.
SAMPLE_PER_LANGUAGE, TOTAL_SAMPLE = 1000, 20_000
#: More languages are refused: the centroids of all go to every task.
MAX_LANGUAGES = 1000
CENTROIDS = 4
#: Rejected: farther from the nearest centroid than all but this share of its language's training texts.
REJECT_SHARE = 0.002
_PIECE = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point, itself if it is a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32)


def counts(text: str) -> np.ndarray | None:
    """How often each hashed n-gram occurs in the whole text; None without any letter.

    The text goes by in pieces, each after the last two characters of what came
    before, so memory is bounded and no n-gram is lost or counted twice.
    """
    out, any_letter, low = np.zeros(DIM, np.int64), False, text.lower()
    tail = np.array([32], np.uint32)
    for at in range(0, len(low) + 1, _PIECE):
        part = low[at : at + _PIECE] + " " * (at + _PIECE > len(low))
        c = _letters()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")]
        apart = c == 32
        c = c[~(apart & np.r_[tail[-1] == 32, apart[:-1]])]  # one space between words
        any_letter |= bool((c != 32).any())
        s, k = np.concatenate([tail, c]), len(tail)
        h = s * np.uint32(0x9E3779B1)
        grams = [h[k:][c != 32], (h[k - 1 : -1] ^ s[k:] * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D)]
        k = max(k, 2)
        if len(s) > k:
            grams.append(((h[k - 2 : -2] ^ s[k - 1 : -1] * np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1) ^ s[k:] * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D))
        for g in grams:
            out += np.bincount(g >> np.uint32(20), minlength=DIM)
        tail = s[-2:]
    return out if any_letter else None


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # a row for each, unit length
    of: np.ndarray  # the language of each centroid, by its place in `languages`
    languages: list[str]
    nearest: np.ndarray  # of each language, the cosine below which a text is rejected

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        v = np.log1p(tf).astype(np.float32) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-9)

    def predict(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and cosine of each row."""
        near = self.vectors(tf) @ self.centroids.T
        best = near.argmax(axis=1)
        return self.of[best], np.clip(near[np.arange(len(near)), best], 0, 1).astype(float)


def fit(languages: list[str], tf: np.ndarray, centroids: int = CENTROIDS, reject_share: float = REJECT_SHARE, rounds: int = 12) -> Model:
    """From a training label and count vector of each row; languages in sorted order decide ties."""
    names = sorted(set(languages))
    model = Model((np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))) + 1).astype(np.float32), np.empty((0, tf.shape[1]), np.float32), np.empty(0, int), names, np.zeros(len(names)))
    labels, v, found, of = np.array([names.index(x) for x in languages], int), model.vectors(tf), [], []
    for k in range(len(names)):
        own = v[labels == k]
        centres = own[np.linspace(0, len(own) - 1, min(centroids, len(own))).astype(int)]
        for _ in range(rounds):
            at = (own @ centres.T).argmax(axis=1)
            centres = np.array([own[at == j].mean(axis=0) if (at == j).any() else c for j, c in enumerate(centres)])
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        found.append(centres)
        of += [k] * len(centres)
        model.nearest[k] = np.quantile((own @ centres.T).max(axis=1), reject_share)
    if names:
        model.centroids, model.of = np.concatenate(found).astype(np.float32), np.array(of)
    return model


def train(labelled: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on the rows (doc_id, text, lang), about `sample` distinct ones of each language and one at least.

    Rows that repeat id and text count once. More than MAX_LANGUAGES languages are refused.
    """
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62))
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", place.alias("place"))
    sizes = rows.select("lang", "place").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least"))
    known = [tuple(r) for r in sizes.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(known) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not known:
        return fit([], np.zeros((0, DIM)))
    sample = max(1, min(sample, TOTAL_SAMPLE // len(known)))
    below = F.create_map(*[F.lit(x) for lang, n, least in known for x in (lang, max(least, int(min(1.0, sample / n) * (1 << 62))))])
    chosen = rows.filter(F.col("place") <= below[F.col("lang")]).groupBy("lang", "place").agg(F.first("text").alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(lang, i, t) for lang, i, text in zip(pdf["lang"], pdf["place"], pdf["text"], strict=True) if (t := counts(text)) is not None]
            yield pd.DataFrame([(lang, i, np.flatnonzero(t).astype("<i2").tobytes(), t[t > 0].astype("<i4").tobytes()) for lang, i, t in found], columns=["lang", "place", "at", "n"])

    made = chosen.mapInPandas(count, "lang string, place long, at binary, n binary")
    got = sorted(map(tuple, made.collect()))  # about TOTAL_SAMPLE at most, as chosen above
    tf = np.zeros((len(got), DIM), np.int32)
    for row, (_, _, at, n) in zip(tf, got, strict=True):
        row[np.frombuffer(at, "<i2")] = np.frombuffer(n, "<i4")
    return fit([lang for lang, *_ in got], tf)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep`, lang_pred, score and rejected of every row, from its text alone."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double, rejected boolean"])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM floats for each of CENTROIDS and MAX_LANGUAGES at most

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for pdf in batches:
            for k in range(0, len(pdf), 256):
                part = pdf.iloc[k : k + 256]
                tf = [None if not isinstance(t, str) or not m.languages else counts(t) for t in part["text"]]
                at = [i for i, t in enumerate(tf) if t is not None]
                lang, score, rejected = ["und"] * len(part), [0.0] * len(part), [True] * len(part)
                if at:
                    for i, of, s in zip(at, *m.predict(np.array([tf[i] for i in at])), strict=True):
                        lang[i], score[i], rejected[i] = m.languages[of], float(s), bool(s < m.nearest[of])
                yield part[list(keep)].assign(lang_pred=lang, score=score, rejected=rejected)

    return docs.select(*keep, "text").mapInPandas(predict, schema)


def held_out_identification(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row, learned from those not held out.

    held_out: crc32 of doc_id as text leaves 1 when divided by 3; a null doc_id is
    not held out. lang_pred is 'und' (score 0, rejected) if the text is null or
    has no letter, or if no document has a language. Rows with equal doc_id are
    judged each by itself; an empty table gives no rows.
    """
    rows = need(docs, "doc_id", "text", "lang")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = train(rows.filter(~out), sample)
    as_text = rows.select(F.col("doc_id").cast("string").alias("doc_id"), out.alias("held_out"), "text")
    found = identify(as_text, model, ("doc_id", "held_out"))
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
