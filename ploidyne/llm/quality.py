"""Quality classifier: Bradley-Terry ranking learned from preference pairs.

Each pair holds a good and a bad labelled document. The chance that the good one is preferred is the logistic function of the difference of
their scores, which are linear in features of the text: shares of kinds of characters, words and lines, and shares of its words by HASHED buckets of their hashes; so weights come from a logistic regression, without intercept, on
differences of features. A quantile of the training scores is the threshold: that with the best balanced accuracy
on the training rows. The published score is the logistic function of the score less the threshold.

The fit takes TRAIN_ROWS labelled rows at most, those with the least hashes of doc_id; everything else covers all rows and whole texts.

Defined cases: null and empty texts have zero features and get a score; labels that are null are ignored; a document labelled twice with different labels counts twice; of rows that share a labelled doc_id the least text counts; if
either class has no training rows every score is 0.5; an empty table gives an empty result; repeated rows are scored alike; very long texts count whole; an input column named like
the score is replaced, others stay as they are; ties of the threshold go to the middle of equally good ones, and a score of 0.5 counts as good.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ploidyne.llm import textkernel as tk
from ploidyne.llm.common import documents

#: Labelled rows that the fit takes at most, and preference pairs drawn from them.
TRAIN_ROWS = 12_000
PAIRS = 100_000
RIDGE = 1e-3
#: Word hashes fall in so many buckets.
HASHED = 128
#: Words added to a text's number in those shares, so that few words say little.
PRIOR = 50
NAMES = ("log_words", "word_length", "upper", "digit", "sign", "shout", "non_ascii", "stop", "repeat", "distinct", "sign_end", "all_caps", "long_word", "lines", "twin_lines") + tuple(f"word_{k}" for k in range(HASHED))
_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 1 if 65 <= _b <= 90 else 2 if 48 <= _b <= 57 else 5 if _c in "!?" else 6 if _b >= 128 else 7 if _c in ".,;:" else 8 if 97 <= _b <= 122 else 0 if tk.SPACE[_b] else 3


def features(texts: pa.Array) -> np.ndarray:
    """A row of NAMES for each text: shares of kinds of characters, words and lines."""
    data, offsets = tk.buffers(texts)
    kind = _CLASS[data]
    words = tk.Words(data, offsets)
    n_bytes, n_words = np.maximum(np.diff(offsets), 1), np.diff(words.offsets)
    some = np.maximum(n_words, 1)
    share = lambda k: tk.sums((kind == k).astype(np.int64), offsets) / n_bytes
    length = words.ends - words.starts
    per_word = lambda x: tk.sums(x.astype(np.int64), words.offsets) / some
    again = np.zeros(len(length), bool)
    again[1:] = words.hashes[1:] == words.hashes[:-1]
    again[words.offsets[:-1][n_words > 0]] = False
    upper = np.concatenate([[0], np.cumsum(kind == 1)])
    lower = np.concatenate([[0], np.cumsum(kind == 8)])
    caps = (upper[words.ends] - upper[words.starts] >= 2) & (lower[words.ends] == lower[words.starts])
    last = kind[words.ends - 1] if len(length) else np.zeros(0, np.uint8)
    _, unique = tk.distinct(words.hashes, words.offsets)
    breaks = tk.sums((data == 10).astype(np.int64), offsets)
    lines = tk.Words(data, offsets, _LINE)
    _, line_kinds = tk.distinct(lines.hashes, lines.offsets)
    twins = 1 - np.diff(line_kinds) / np.maximum(np.diff(lines.offsets), 1)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    bags = np.bincount(owner * HASHED + (words.hashes % np.uint64(HASHED)).astype(np.int64), minlength=len(n_words) * HASHED).reshape(-1, HASHED) / (n_words[:, None] + PRIOR)
    counts = np.stack([
        np.log1p(n_words), per_word(length), share(1), share(2), share(3), share(5), share(6), share(7), per_word(again), np.diff(unique) / some / np.maximum(1, 6 / np.log2(some + 8)),
        per_word(last == 3), per_word(caps), per_word(length > 24), np.log1p(breaks), twins,
    ], 1).astype(np.float64)
    return np.concatenate([counts, bags], 1)


_LINE = np.zeros(256, bool)
_LINE[10] = True


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = 5) -> dict:
    """Weights, scale and threshold from feature rows and 0/1 labels."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    model = {"w": np.zeros(x.shape[1]), "mean": np.zeros(x.shape[1]), "sd": np.ones(x.shape[1]), "threshold": 0.0}
    if not len(good) or not len(bad):
        return model
    model["mean"], model["sd"] = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - model["mean"]) / model["sd"], -8, 8)
    rng = np.random.default_rng(seed)
    first, second = rng.choice(good, pairs), rng.choice(bad, pairs)
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps on the logistic loss
        slope, bend = -RIDGE * w, RIDGE * np.eye(len(w))
        for s in range(0, pairs, 10_000):
            d = z[first[s : s + 10_000]] - z[second[s : s + 10_000]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            slope, bend = slope + d.T @ p / pairs, bend + (d * (p * (1 - p))[:, None]).T @ d / pairs
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    cuts = np.quantile(raw, np.linspace(0.002, 0.998, 499))
    balance = [(raw[good] >= c).mean() + (raw[bad] < c).mean() for c in cuts]
    best = np.flatnonzero(np.array(balance) >= max(balance) - 1e-9)
    return model | {"w": w, "threshold": float(cuts[best[len(best) // 2]])}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    raw = np.clip((x - model["mean"]) / model["sd"], -8, 8) @ model["w"]
    return 1 / (1 + np.exp(-np.clip(raw - model["threshold"], -30, 30)))


def held_out(divisor: int, remainder: int, doc_id: str = "doc_id"):
    """Whether crc32(doc_id as text) mod ``divisor`` is ``remainder``; a null doc_id never is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor == remainder, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Fit on labelled rows that aren't held out. ``docs``: doc_id, text. ``labels``: doc_id, quality."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(3, 1)).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64(F.lit(3), "_id"), "_id", "_label").limit(rows)
    # a doc_id that many rows share must not bring them all to the driver: each label takes one text
    sample = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id")).groupBy("_id", "_label").agg(F.min("text").alias("text")).select("text", "_label")

    @tk.tidy
    def run(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                yield pa.record_batch([pa.array(list(features(part.column("text"))), pa.list_(pa.float64())), part.column("_label")], names=["x", "label"])

    got = sample.mapInArrow(run, "x array<double>, label int").toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES)) if got.num_rows else np.zeros((0, len(NAMES)))
    label = got.column("label").to_numpy()
    order = np.lexsort((*x.T, label))  # the same fit however the rows arrive
    return fit(x[order], label[order])


def classify(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, in column ``name``."""
    docs = docs.drop(name)

    @tk.tidy
    def run(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                yield part.append_column(name, pa.array(score(model, features(part.column("text")))))

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = classify(docs, model)
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
