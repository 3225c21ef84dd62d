"""Language identification by nearest centroid.

A text is lower-cased; bytes other than letters count as one space; hashed byte trigrams, weighted by log counts and by inverse document
frequency over all training rows, give a vector of length 1. Each language has several centroids, from spherical k-means on a bounded sample
of its training rows, which meets by language in a task; only centroids come to the driver. The language of the centroid with the highest cosine is predicted; a text further from it than nearly all training texts of
that language is marked ``rejected``, which leaves the prediction as it is.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows without lang aren't learned from; with nothing to learn from, every text
is ``und``; empty tables give empty results; ties, to five decimals of the cosine, go to the language that sorts first; equal training rows count as one in the clustering; very long texts count whole; input columns named
lang_pred, score or rejected are replaced, others stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ploidyne.llm import textkernel as tk
from ploidyne.llm.common import cut, documents, small_enough
from ploidyne.llm.quality import held_out

DIMENSIONS = 2048
CENTROIDS = 4
#: About so many training rows of each language, and one at least, go to the clustering, by a hash of doc_id and text.
SAMPLE_ROWS = 1500
REJECT_QUANTILE = 0.002
SLICE = 1 << 19
_LETTER = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def counts(texts: pa.Array) -> np.ndarray:
    """Trigram counts: a row of DIMENSIONS for each text."""
    data, offsets = tk.buffers(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    n = len(offsets) - 1
    b = _LETTER[data].astype(np.uint32)
    if len(b) < 3:
        return np.zeros((n, DIMENSIONS), np.float32)
    code = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(21)
    doc = np.repeat(np.arange(n), np.diff(offsets))[:-2]
    last = np.repeat(offsets[1:], np.diff(offsets))[:-2]
    keep = (np.arange(len(code)) + 3 <= last) & ~((b[:-2] == 32) & (b[1:-1] == 32))
    return np.bincount(doc[keep] * DIMENSIONS + code[keep], minlength=n * DIMENSIONS).reshape(n, DIMENSIONS).astype(np.float32)


def vectors(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(texts)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """For each dimension in how many of ``docs`` it occurs, and their number: one partial count for each partition, summed by dimension."""

    def run(batches):
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for part in tk.slices(batch, "text", SLICE):
                c = counts(part.column("text"))
                total += (c > 0).sum(0)
                n += len(c)
        yield pa.record_batch([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.concatenate([[n], total]))], names=["d", "n"])

    rows = docs.select("text").mapInArrow(run, "d long, n long").groupBy("d").agg(F.sum("n").alias("n")).collect()
    got = {r.d: r.n for r in rows}
    return np.array([got.get(d, 0) for d in range(DIMENSIONS)]), got.get(-1, 0)


def cluster(x: np.ndarray, k: int, seed: int = 3, rounds: int = 12) -> np.ndarray:
    """Centroids of length 1 by spherical k-means, started far apart."""
    rng = np.random.default_rng(seed)
    centres = [x.mean(0)]
    for _ in range(1, min(k, len(x))):
        far = 1 - np.max(x @ np.array(centres).T, 1)
        centres.append(x[rng.choice(len(x), p=np.maximum(far, 1e-9) / np.maximum(far, 1e-9).sum())])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        nearest = (x @ c.T).argmax(1)
        c = np.array([x[nearest == j].mean(0) if (nearest == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, k: int = CENTROIDS) -> dict:
    """``docs``: doc_id, text, lang of training rows."""
    known = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64(F.lit(17), "doc_id", "text").alias("h"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least"))
    sizes = cut(sizes.select(F.col("lang").alias("name"), "n", "least"))
    if sizes.limit(1).count() == 0:
        return {"languages": []}
    df, n = document_frequencies(known)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    # hashes fall evenly from -2^63 to 2^63
    chosen = (F.col("h") / 2.0**64 + 0.5 < rows / F.col("n")) | (F.col("h") == F.col("least"))
    sample = known.join(small_enough(sizes), F.col("lang") == F.col("name")).where(chosen).groupBy("lang", "h").agg(F.first("text").alias("text"))

    def centroids(table):
        table = table.take(pc.sort_indices(table, sort_keys=[("h", "ascending")]))
        x = np.concatenate([vectors(part.column("text"), idf) for batch in table.select(["text"]).combine_chunks().to_batches() for part in tk.slices(batch, "text", SLICE)])
        c = cluster(x, k)
        near = float(np.quantile((x @ c.T).max(1), REJECT_QUANTILE))
        return pa.table({"lang": table.column("lang").slice(0, 1), "near": pa.array([near]), "c": pa.array([c.astype(np.float32).tobytes()], pa.binary())})

    got = sample.groupBy("lang").applyInArrow(centroids, "lang string, near double, c binary").collect()
    got.sort(key=lambda r: r.lang)
    centres = [np.frombuffer(r.c, np.float32).reshape(-1, DIMENSIONS) for r in got]
    owner = np.repeat(np.arange(len(got)), [len(c) for c in centres])
    return {"languages": [r.lang for r in got], "idf": idf, "centres": np.concatenate(centres), "owner": owner, "near": np.array([r.near for r in got])}


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with lang_pred, score (the cosine) and rejected."""
    docs = docs.drop("lang_pred", "score", "rejected")

    def run(batches):
        for batch in batches:
            for part in tk.slices(batch, "text", SLICE):
                text = part.column("text")
                lettered = np.array(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False))
                if model["languages"]:
                    cos = np.round(vectors(text, model["idf"]) @ model["centres"].T, 5)
                    best = cos.argmax(1)
                    top, lang = np.clip(cos.max(1), 0, 1), model["owner"][best]
                else:
                    lettered[:], top, lang = False, np.zeros(len(text)), np.zeros(len(text), int)
                names = pa.array([model["languages"][k] if ok else "und" for k, ok in zip(lang, lettered, strict=True)], pa.string())
                far = (top < model["near"][lang]) & lettered if model["languages"] else lettered
                yield part.append_column("lang_pred", names).append_column("score", pa.array(np.where(lettered, top, 0.0).astype(np.float64))).append_column("rejected", pa.array(far))

    extra = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out(5, 0)).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "rejected")
