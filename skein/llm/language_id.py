"""Language identification by the nearest of several centroids per language.

A text's vector counts its letter n-grams (1 to 3 bytes of lower-cased UTF-8, everything but letters read as a blank)
in hashed bins, damped, weighted by IDF and normalised. Each language is split into clusters by spherical k-means; a text gets
the language of the centroid with the largest cosine. It is rejected if that cosine is lower than what the model's own documents,
cut to the same length, reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from skein.llm.store import bound_batches, broadcast_if_small, tidy
from skein.llm.textkit import chunks, column, release, utf8

#: The model is fitted on about so many labelled documents at most: in all, and of one language.
SAMPLE_ALL, SAMPLE_ONE = 1200, 300
BINS, CLUSTERS, ROUNDS = 1 << 13, 4, 12
#: Cosines are given with so many digits.
DIGITS = 9
#: Lengths in letters and blanks at which rejection is calibrated; the quantile of the cosine there, and the part of it that must be reached.
LENGTHS, QUANTILE, PART = (4, 8, 16, 32, 64, 128, 256, 512, 1024), 0.01, 0.6

#: What is no letter reads as a blank (0); bytes of two to four byte characters all count as letters here.
_SYMBOL = np.zeros(256, np.uint32)
_SYMBOL[ord("a") : ord("z") + 1] = np.arange(1, 27)
_SYMBOL[128:] = np.arange(27, 27 + 128)


def _grams(offsets: np.ndarray, raw: np.ndarray, cut: int | None = None) -> Iterator[tuple[np.ndarray, int]]:
    """Bins of each text's n-grams, and its length after runs of blanks are one."""
    sym = _SYMBOL[raw]
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        s = sym[a:b]
        if len(s):
            keep = s > 0
            keep[1:] |= s[:-1] > 0
            s = s[keep]
        s = np.concatenate([[0], s[:cut], [0]]).astype(np.uint32)
        two = s[:-1] * np.uint32(155) + s[1:]
        three = two[:-1] * np.uint32(155) + s[2:]
        h = np.concatenate([s[1:-1], two + np.uint32(1000), three + np.uint32(100_000)])
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        yield ((h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)) >> np.uint32(32 - 13), len(s) - 2


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    return np.divide(m, norm, out=m, where=norm > 0)


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray  # least cosine at LENGTHS
    columns: np.ndarray = field(init=False)  # the centroids, a row a bin

    def nearest(self, bins: np.ndarray, counts: np.ndarray) -> tuple[int, float]:
        """Index of the nearest centroid and its cosine, for one text's n-gram bins in ascending order and their counts.

        The sums run over the text's own bins, one after the other in double precision, whatever other texts are at hand.
        """
        if not len(bins):
            return 0, 0.0
        v = np.log1p(counts.astype(np.float64)) * self.idf[bins]
        norm = np.sqrt(np.add.accumulate(v * v)[-1])
        cos = np.add.reduce(self.columns[bins] * v[:, None], axis=0) / norm if norm > 0 else np.zeros(len(self.owner))
        best = int(cos.argmax())
        return best, round(float(min(max(cos[best], 0.0), 1.0)), DIGITS)

    def __post_init__(self) -> None:
        self.columns = np.ascontiguousarray(self.centroids.T.astype(np.float64))


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical, started from the mean direction's nearest and then the farthest points; deterministic."""
    picked = [int((x @ x.mean(0)).argmax())]
    while len(picked) < min(k, len(x)):
        picked.append(int((x @ x[picked].T).max(1).argmin()))
    c = x[picked].copy()
    for _ in range(ROUNDS):
        to = (x @ c.T).argmax(1)
        c = np.stack([x[to == j].sum(0) if (to == j).any() else c[j] for j in range(len(c))])
        c = _unit(c)
    return c


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, sample_all: int = SAMPLE_ALL, sample_one: int = SAMPLE_ONE) -> Model | None:
    """Learn from text and lang of docs (doc_id, text, lang); rows of null lang or text are left out. None: nothing to learn from.

    A sample of each language's different texts, picked by hash, goes to the driver as n-gram counts: sample_one texts of a language at most and
    about sample_all in all. However often a text is repeated, it is drawn once.
    """
    bound_batches(docs.sparkSession)
    tidy(docs.sparkSession)
    train = docs.select("text", "lang").filter("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    n = train.groupBy(F.col("lang").alias("_l")).agg(F.count("*").alias("_n"))
    per = min(sample_one, sample_all // max(1, n.count()) or 1)
    draw = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / float(1 << 30)
    drawn = train.join(broadcast_if_small(n), F.col("lang") == F.col("_l")).filter(draw * F.col("_n") < 2 * per).select("lang", "h", "text").dropDuplicates(["lang", "h"])
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("h"), "h"))
    sample = drawn.withColumn("_k", first).filter(F.col("_k") <= per).select("lang", "h", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            off, raw = utf8(pc.utf8_lower(column(batch, "text")))
            rows = []
            for c in (None, *LENGTHS):
                for (g, size), h, lang in zip(_grams(off, raw, c), column(batch, "h").to_pylist(), column(batch, "lang").to_pylist(), strict=True):
                    if c is None or size == c:
                        b, k = np.unique(g, return_counts=True)
                        rows.append({"h": h, "lang": lang, "cut": c or 0, "b": b.astype("<i4").tobytes(), "k": k.astype("<i4").tobytes()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("h", pa.int64()), ("lang", pa.string()), ("cut", pa.int32()), ("b", pa.binary()), ("k", pa.binary())]))

    got = sample.mapInArrow(count, "h bigint, lang string, cut int, b binary, k binary").collect()
    got.sort(key=lambda r: (r.lang, r.h, r.cut))
    full, cuts = [r for r in got if not r.cut and r.b], [r for r in got if r.cut]
    if not full:
        return None

    def dense(rows: list) -> np.ndarray:
        m = np.zeros((len(rows), BINS), np.float32)
        for i, r in enumerate(rows):
            m[i, np.frombuffer(r.b, "<i4")] = np.frombuffer(r.k, "<i4")
        return np.log1p(m, out=m)

    m = dense(full)
    idf = (np.log((1 + len(m)) / (1 + (m > 0).sum(0))) + 0.1).astype(np.float32)
    m = _unit(m * idf)
    languages, lang = sorted({r.lang for r in full}), np.array([r.lang for r in full])
    parts = [_kmeans(m[lang == name], CLUSTERS) for name in languages]
    model = Model(languages, np.repeat(np.arange(len(parts)), list(map(len, parts))), np.concatenate(parts), idf, np.zeros(len(LENGTHS)))
    for i, c in enumerate(LENGTHS):
        if rows := [r for r in cuts if r.cut == c]:
            reached = [model.nearest(np.frombuffer(r.b, "<i4"), np.frombuffer(r.k, "<i4"))[1] for r in rows]
            model.floor[i] = PART * np.quantile(reached, QUANTILE)
        elif i:  # longer texts come nearer, so what a shorter one reaches is safe
            model.floor[i] = model.floor[i - 1]
    release()
    return model


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """docs' columns of `keep` (all) with lang_pred, score (cosine, 0 to 1) and rejected added, or in place of columns of these names, one row per row.

    Only text is looked at. Null text and text without a letter: `und`, 0, rejected; so is everything if model is None.
    Texts shorter than the least calibrated length are not rejected.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "rejected")]
    bound_batches(docs.sparkSession)
    kept = docs.select(*keep).schema
    schema = StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for big in chunks(batches):
            for k in range(0, len(big), 512):
                batch = big.slice(k, 512)
                texts = column(batch, "text")
                off, raw = utf8(pc.utf8_lower(texts))
                ascii_letter = np.concatenate([[0], np.cumsum((raw >= 97) & (raw <= 122))])
                letter = ascii_letter[off[1:]] > ascii_letter[off[:-1]]
                for i in np.flatnonzero(~letter):
                    letter[i] = any(map(str.isalpha, texts[i].as_py() or ""))
                if model is None:
                    pred, cos, low = np.array(["und"] * len(batch), object), np.zeros(len(batch)), np.ones(len(batch), bool)
                else:
                    best, cos, size = np.zeros(len(batch), np.int64), np.zeros(len(batch)), np.zeros(len(batch), np.int64)
                    for i, (g, size[i]) in enumerate(_grams(off, raw)):
                        counts = np.bincount(g, minlength=BINS)
                        bins = np.flatnonzero(counts)
                        best[i], cos[i] = model.nearest(bins, counts[bins])
                    pred = np.where(letter, np.array(model.languages, object)[model.owner[best]], "und")
                    level = np.searchsorted(LENGTHS, size, "right") - 1
                    low = ~letter | (level >= 0) & (cos < model.floor[np.maximum(level, 0)])
                    cos = np.where(letter, cos, 0.0)
                yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in keep], pa.array(pred, pa.string()), pa.array(cos), pa.array(low)], names=[*keep, "lang_pred", "score", "rejected"])

    return docs.select(*keep, *(["text"] if "text" not in keep else [])).mapInArrow(run, schema)
