"""LM scoring with a log-bilinear model, trained by noise-contrastive estimation.

Vocabulary: a tree of two levels. Classes are the MODEL_WORDS most frequent training words, the end of a text, and tail classes for all
other words: TAIL by a hash of their last two bytes, each split by the word's hash so that their number grows as the root of that of the tail's
words. The model predicts a token's class from the two tokens before it, each a word of the head, the end, or one of the TAIL unsplit tail classes: the predicted vector is the sum of
the context vectors, each scaled by position, and a class's score is its product with the class's vector plus a bias. Each training word of a tail class has a vector
and a bias of its own, as has one unseen word for each class: its probability within the class is again log-bilinear, from the same
predicted vector. So probabilities sum to one over the training words and one unseen word for each class.

Counting: a pass over the training texts counts words; the counts are summed by word, and stay a table. Only the head, at most MODEL_WORDS
words, goes to the tasks.

Training of the classes: texts become sequences of class numbers and are dealt, by a hash of doc_id and text, to shards of about SHARD tokens. A shard sorts its texts by that hash and
runs NCE over every position in numpy minibatches (equal ones of a shard count as one with a weight, in part), from a start that is the unigram model; the shards' parameters are averaged, weighted by positions. So the
result depends neither on how the input is partitioned nor on the number of tasks.

Scoring: a pass over the texts scores classes; each distinct context of a task is normalised once, by a matrix product over all classes. Words of the tail leave their texts in
packed arrays, a row for each lot of texts and group of tail classes. A group takes about GROUP words: tail classes with few words share one, a tail class with more is dealt by lots of
texts over several groups. For each tail class a group runs NCE over all its training words, with the context vectors as they are, and scores all its words; the sums go back by
lot. No task holds more than a group, however frequent a word or a text may be; a tail class in several groups has a replica of its words' vectors in each, trained on that group's share.

Words are told apart by a 64-bit hash of their bytes. Defined cases: a null or empty text is one end token; repeated rows score alike, but for which replica they meet; with no training
documents the base is log10 of 1 over V + 1 = 1, and the model is uniform over its classes; very long texts are scored whole, each a lot of its own if it must; columns beside doc_id
and text are ignored; an empty table gives an empty result; a null doc_id is passed on and is not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ploidyne.llm import textkernel as tk
from ploidyne.llm.common import cut, documents, small_enough
from ploidyne.llm.quality import held_out

MODEL_WORDS, TAIL = 1500, 96
DIMENSIONS, CONTEXT = 24, 2
#: Width of the rows that train: a vector, its bias and what makes the width even; DIMENSIONS is even as well.
WIDTH = DIMENSIONS + 2
NOISE, BATCH, RATE = 8, 1024, 0.15
#: Words of the tail are rare, so their vectors take smaller steps.
TAIL_RATE = 0.05
#: A minibatch draws so many times NOISE noise words, each weighing as much less.
SHARED = 16
#: Positions of a shard that repeat train together, at most so many at once.
TOGETHER = 2
#: Training tokens of a shard; words of a group; tokens and texts of a lot.
SHARD, GROUP, LOT, LOT_TEXTS = 2_000_000, 1_000_000, 2_000_000, 60_000
#: A task holds the normalisers of at most about so many contexts.
CONTEXTS = 4_000_000
#: Rows of parameters that are averaged together.
BLOCK = 64
END = np.uint64(1)
LOG2_E = np.float32(np.log2(np.e))


def lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, tail classes and the texts' offsets in words; no end tokens."""
    data, offsets = tk.buffers(texts)
    w = tk.Words(data, offsets)
    last = lower(data[w.ends - 1])
    prior = np.where(w.ends - w.starts > 1, lower(data[np.maximum(w.ends - 2, 0)]), 0)
    tail = ((last * np.uint32(2654435761) + prior * np.uint32(40503)) >> np.uint32(7)) % np.uint32(TAIL)
    # END is no word's hash
    return np.where(w.hashes == END, np.uint64(2), w.hashes), tail.astype(np.int64), w.offsets


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, tail, c): counts of all words and of the end token (tail -1) in ``docs``."""

    def run(batches):
        held: list[np.ndarray] = []
        n = docs_seen = 0

        def emit():
            both = np.concatenate(held, 1)
            order = np.argsort(both[0])
            word = both[0][order]
            at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            return pa.record_batch([pa.array(word[at].view(np.int64)), pa.array(both[1][order[at]].astype(np.int32)), pa.array(np.diff(np.append(at, len(word))))], names=["word", "tail", "c"])

        for batch in batches:
            for part in tk.slices(batch, "text"):
                h, tail, offsets = tokens(part.column("text"))
                held.append(np.stack([h, tail.astype(np.uint64)]))
                n, docs_seen = n + len(h), docs_seen + len(offsets) - 1
                if n > 4_000_000:
                    yield emit()
                    held, n = [], 0
        if n:
            yield emit()
        yield pa.record_batch([pa.array([int(END)]), pa.array([-1], pa.int32()), pa.array([docs_seen])], names=["word", "tail", "c"])

    return docs.select("text").mapInArrow(run, "word long, tail int, c long").groupBy("word").agg(F.max("tail").alias("tail"), F.sum("c").alias("c")).where("c > 0")


class Vocabulary:
    """Classes: 0 is the end, then the head's words, then the tail classes. Contexts are the same with unsplit tail classes; ``start`` pads them."""

    def __init__(self, head: list, end_count: int, tail: dict[int, tuple[int, int]], total: int, distinct: int, split: int = 1):
        order = np.argsort(np.array([h.word for h in head], np.int64).view(np.uint64)) if head else np.zeros(0, np.int64)
        self.words = np.array([h.word for h in head], np.int64).view(np.uint64)[order]
        self.head_counts = np.array([h.c for h in head], np.int64)[order]
        self.end_count, self.total, self.distinct = end_count, total, distinct
        self.split, self.groups = split, TAIL * split
        self.tail_counts = np.array([tail.get(k, (0, 0))[0] for k in range(self.groups)], np.float64)
        self.size = 1 + len(head) + self.groups
        # contexts: the end and the head as they are, tail classes without their split, and one that pads
        self.first_tail, self.start = 1 + len(head), 1 + len(head) + TAIL
        self.counts = np.concatenate([[end_count], self.head_counts, self.tail_counts]).astype(np.float64)

    def group(self, hashes: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Tail class of each word; ``group_column`` is the same."""
        return tail * self.split + ((hashes >> np.uint64(33)) % np.uint64(self.split)).astype(np.int64)

    def classes(self, hashes: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word, and whether it is in the head."""
        if not len(self.words):
            return 1 + self.group(hashes, tail), np.zeros(len(tail), bool)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        known = self.words[at] == hashes
        return np.where(known, 1 + at, 1 + len(self.words) + self.group(hashes, tail)), known

    def contexts(self, classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The contexts one and two places before each class of texts that begin at ``starts``."""
        c = np.where(classes < self.first_tail, classes, self.first_tail + (classes - self.first_tail) // self.split).astype(np.uint16)
        one, two = np.full(len(c), self.start, np.uint16), np.full(len(c), self.start, np.uint16)
        one[1:], two[2:] = c[:-1], c[:-2]
        one[starts] = two[starts] = self.start
        second = starts + 1
        two[second[second < np.append(starts[1:], len(c))]] = self.start
        return one, two

    def sequence(self, hashes, tail, offsets) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Classes with an end after each text, the two contexts before each, the texts' offsets in them, and whether each word is in the head."""
        c, known = self.classes(hashes, tail)
        n = len(offsets) - 1
        ends = offsets[1:] + np.arange(n)
        out = np.zeros(len(c) + n, np.int64)
        place = np.ones(len(out), bool)
        place[ends] = False
        out[place] = c
        starts = offsets[:-1] + np.arange(n)
        return out, *self.contexts(out, starts), np.append(starts, len(out)), known


def group_column(split: int):
    return (F.col("tail") * split + F.pmod(F.shiftrightunsigned("word", 33), F.lit(split))).cast("int")


def vocabulary(counts: DataFrame, model_words: int = MODEL_WORDS) -> Vocabulary:
    words = counts.where(F.col("tail") >= 0)
    head = words.orderBy(F.desc("c"), "word").limit(model_words).collect()
    ends = counts.where("tail = -1").agg(F.sum("c")).first()[0] or 0
    split = max(1, round((words.count() - len(head)) ** 0.5 / TAIL))
    sums = {r.g: (r.n, r.k) for r in words.groupBy(group_column(split).alias("g")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k")).collect()}
    total, distinct = ends + sum(n for n, _ in sums.values()), (ends > 0) + sum(k for _, k in sums.values())
    for h in head:
        g = h.tail * split + (h.word % 2**64 >> 33) % split
        n, k = sums[g]
        sums[g] = n - h.c, k - 1
    return Vocabulary(head, ends, sums, total, distinct, split)


def initial(v: Vocabulary, seed: int = 2) -> dict[str, np.ndarray]:
    """Start of training: ``r`` holds the classes' vectors and, last, their biases, ``q`` the contexts' vectors, ``c`` the scales of the two positions."""
    rng = np.random.default_rng(seed)
    share = (v.counts + 0.5) / (v.counts.sum() + 0.5 * v.size)
    r = rng.normal(0, 0.1, (v.size, DIMENSIONS)).astype(np.float32)
    return {"r": np.concatenate([r, np.log(share).astype(np.float32)[:, None]], 1), "q": rng.normal(0, 0.1, (v.start + 1, DIMENSIONS)).astype(np.float32), "c": np.ones((CONTEXT, DIMENSIONS), np.float32) * 0.5}


def predicted(p: dict, qa: np.ndarray, qb: np.ndarray, width: int = DIMENSIONS + 1) -> np.ndarray:
    """The vectors that contexts with vectors ``qa`` and ``qb`` predict, with a column of ones for the biases, and zeros up to ``width``."""
    out = np.empty((len(qa), width), np.float32)
    out[:, DIMENSIONS], out[:, DIMENSIONS + 1 :] = 1, 0
    np.multiply(qa, p["c"][0], out=out[:, :DIMENSIONS])
    out[:, :DIMENSIONS] += qb * p["c"][1]
    return out


def scores(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", h, rows)


def noise_terms(t, cdf, log_noise, rng, sn) -> tuple:
    """Classes drawn from the noise, and the buffer for their scores."""
    drawn = np.minimum(np.searchsorted(cdf, rng.random(NOISE * SHARED)), len(cdf) - 1).astype(t.dtype)
    return drawn, log_noise[drawn], sn[: len(t)]


def errors(h, rt, rd, log_t, log_d, buffer) -> tuple[np.ndarray, np.ndarray]:
    """1 - P(data) of targets with rows ``rt``, and P(data) of the noise with rows ``rd``."""
    log_k = np.float32(np.log(NOISE))
    et = 1 / (1 + np.exp(np.clip(scores(h, rt) - log_t - log_k, -30, 30)))
    # in one buffer: exp(-score), as a power of 2, plus one, inverted; what overflows becomes 0
    turned = rd * -LOG2_E
    turned[:, DIMENSIONS] += (log_d + log_k) * LOG2_E
    en = np.matmul(h, turned.T, out=buffer)
    np.exp2(en, out=en)
    en += 1
    return et, np.reciprocal(en, out=en)


def ascend(x: np.ndarray, g2: np.ndarray, idx: np.ndarray, grads: np.ndarray, m: float, rate: float) -> None:
    """An Adagrad step of the rows ``idx`` of ``x``, which may repeat, over ``m`` positions."""
    order = np.argsort(idx, kind="stable")
    ordered = idx[order]
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    # two columns at a time, as complex numbers
    rows, g = ordered[at], np.add.reduceat(np.take(grads, order, 0).view(np.complex64), at, 0).view(np.float32)
    g *= np.float32(m**-0.5)
    now = g2[rows] + g * g
    g2[rows] = now
    x[rows] += np.float32(rate) * g / np.sqrt(now)


def nce_steps(p: dict, target, one, two, times, noise_cdf, log_noise, rng) -> None:
    """Adagrad steps over minibatches of positions, each of which stands for ``times`` equal ones, in place; the draws of noise are shared by a minibatch."""
    r = np.pad(p["r"], ((0, 0), (0, WIDTH - p["r"].shape[1])))
    g2 = {k: np.full(x.shape, 1e-3, np.float32) for k, x in (p | {"r": r}).items()}
    sn, weight = np.empty((BATCH, NOISE * SHARED), np.float32), np.float32(-1 / SHARED)
    for s in range(0, len(target), BATCH):
        t, ab = target[s : s + BATCH], np.concatenate([one[s : s + BATCH], two[s : s + BATCH]])
        m, by = len(t), times[s : s + BATCH]
        n_all = float(by.sum())
        drawn, log_d, buffer = noise_terms(t, noise_cdf, log_noise, rng, sn)
        both = np.concatenate([t, drawn])
        rows, q = np.take(r, both, 0), np.take(p["q"], ab, 0)
        h = predicted(p, q[:m], q[m:], WIDTH)
        with np.errstate(over="ignore"):
            et, en = errors(h, rows[:m], rows[m:], log_noise[t], log_d, buffer)
        dh = en @ (rows[m:, :DIMENSIONS] * weight)
        dh *= by[:, None]
        et *= by
        up = rows[:m]
        up *= et[:, None]
        dh += up[:, :DIMENSIONS]
        np.multiply(h, et[:, None], out=up)
        rows[m:] = en.T @ (h * (by * weight)[:, None])
        dq = np.concatenate([dh * p["c"][0], dh * p["c"][1]])
        q.reshape(CONTEXT, m, -1)[:] *= dh
        ascend(r, g2["r"], both, rows, n_all, RATE)
        ascend(p["q"], g2["q"], ab, dq, n_all, RATE)
        ascend(p["c"], g2["c"], np.arange(CONTEXT), q.reshape(CONTEXT, m, -1).sum(1), n_all, RATE)
    p["r"][:] = r[:, : p["r"].shape[1]]


def number_type(n: int) -> type:
    """The unsigned type that numbers below ``n`` are packed in."""
    return np.uint16 if n <= 1 << 16 else np.uint32


def class_sequences(docs: DataFrame, v: Vocabulary, shards: int) -> DataFrame:
    """(shard, key, length, class): texts of ``docs`` (doc_id, text) as packed sequences of classes, in lots."""
    kind = number_type(v.size)

    def run(batches):
        held: list[tuple] = []
        n = 0

        def emit():
            key, length, seq = (np.concatenate(x) for x in zip(*held, strict=True))
            # rows that repeat would all meet in one shard: each goes on to the next
            order = np.argsort(key, kind="stable")
            first = np.maximum.accumulate(np.where(np.concatenate([[True], key[order][1:] != key[order][:-1]]), np.arange(len(key)), 0))
            again = np.empty(len(key), np.int64)
            again[order] = np.arange(len(key)) - first
            shard = ((key.view(np.uint64) % np.uint64(shards)).astype(np.int64) + again) % shards
            ends = np.cumsum(length)
            for k in np.unique(shard):
                mine = np.flatnonzero(shard == k)
                parts = [seq[ends[i] - length[i] : ends[i]] for i in mine]
                yield pa.record_batch([pa.array([k], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (key[mine], length[mine], np.concatenate(parts))]], names=["shard", "key", "length", "class"])

        for batch in batches:
            for part in tk.slices(batch, "text"):
                t, _, _, offsets, _ = v.sequence(*tokens(part.column("text")))
                held.append((part.column("key").to_numpy(), np.diff(offsets), t.astype(kind)))
                n += len(t)
                if n > LOT:
                    yield from emit()
                    held, n = [], 0
        if held:
            yield from emit()

    return docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(run, "shard int, key binary, length binary, class binary")


def joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The numbers packed in the blobs of a column, one after another."""
    return np.concatenate([np.zeros(0, kind), *[np.frombuffer(x.as_buffer(), kind) for x in column if x.is_valid]])


def train(docs: DataFrame, v: Vocabulary) -> dict[str, np.ndarray]:
    """Parameters averaged over shards of ``docs`` (doc_id, text)."""
    start = initial(v)
    if not v.total:
        return start
    share = (v.counts + 0.5) / (v.counts.sum() + 0.5 * v.size)
    cdf, log_noise = np.cumsum(share), np.log(share).astype(np.float32)
    shapes, kind = {k: x.shape for k, x in start.items()}, number_type(v.size)
    shards = max(1, round(v.total / SHARD))

    def learn(table):
        p = {k: x.copy() for k, x in start.items()}
        key, length, seq = joined(table.column("key"), np.int64), joined(table.column("length"), np.int64), joined(table.column("class"), kind)
        starts = np.cumsum(length) - length
        order = np.lexsort((length, key))  # the same order however the rows came
        length = length[order]
        at = np.repeat(starts[order] - (np.cumsum(length) - length), length) + np.arange(len(seq))
        t = seq[at]
        one, two = v.contexts(t.astype(np.int64), np.cumsum(length) - length)
        # equal positions train together, up to TOGETHER of them, so the objective is that of all positions
        code, count = np.unique((t * np.int64(v.start + 1) + one) * (v.start + 1) + two, return_counts=True)
        parts = -(-count // TOGETHER)
        order = np.repeat(np.arange(len(code)), parts)[np.random.default_rng(9).permutation(parts.sum())]
        code, width = code[order], v.start + 1
        nce_steps(p, (code // width // width).astype(kind), (code // width % width).astype(np.uint16), (code % width).astype(np.uint16), (count / parts).astype(np.float32)[order], cdf, log_noise, np.random.default_rng(10))
        rows = [(k, i, (x[i : i + BLOCK].astype(np.float64) * len(t)).ravel()) for k, x in p.items() for i in range(0, len(x), BLOCK)]
        return pa.table({"name": pa.array([r[0] for r in rows]), "row": pa.array([r[1] for r in rows], pa.int32()), "n": pa.array([len(t)] * len(rows)), "sums": pa.array([r[2] for r in rows], pa.list_(pa.float64()))})

    kinds = "name string, row int, n long, sums array<double>"
    rows = class_sequences(docs, v, shards).repartition(2 * shards, "shard").groupBy("shard").applyInArrow(learn, kinds)
    # two levels, so that no task adds up the blocks of very many others
    rows = rows.withColumn("lane", F.pmod(F.xxhash64("n", "sums"), F.lit(16)).cast("int"))

    def add(table):
        total = np.sum(np.stack([s.values.to_numpy() for s in table.column("sums").combine_chunks()]), 0)
        first = table.slice(0, 1)
        return pa.table({"name": first.column("name"), "row": first.column("row"), "n": pa.array([sum(table.column("n").to_pylist())]), "sums": pa.array([total], pa.list_(pa.float64()))})

    rows = rows.groupBy("name", "row", "lane").applyInArrow(add, kinds).groupBy("name", "row").applyInArrow(add, kinds)
    out = start
    for r in rows.collect():
        block = np.array(r.sums).reshape(-1, shapes[r.name][1]) / r.n
        out[r.name][r.row : r.row + len(block)] = block
    return out


class Normaliser:
    """Log normalisers of contexts over all classes; each context is computed once as long as at most CONTEXTS are held."""

    def __init__(self, p: dict):
        self.p = p
        self.codes, self.norms = np.zeros(0, np.int64), np.zeros(0, np.float32)
        # for powers of 2
        self.columns = np.ascontiguousarray(p["r"].T * LOG2_E)
        self.reach = np.linalg.norm(p["r"][:, :-1], axis=1).max(), np.abs(p["r"][:, -1]).max()

    def __call__(self, code: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Of sorted distinct contexts with their predicted vectors."""
        if len(self.codes) > CONTEXTS:
            self.codes, self.norms = self.codes[:0], self.norms[:0]
        at = np.searchsorted(self.codes, code)
        new = self.codes[np.minimum(at, len(self.codes) - 1)] != code if len(self.codes) else np.ones(len(code), bool)
        out = np.empty(len(code), np.float32)
        out[~new] = self.norms[at[~new]]
        out[new] = self.compute(h[new])
        self.norms = np.insert(self.norms, at[new], out[new])
        self.codes = np.insert(self.codes, at[new], code[new])
        return out

    def compute(self, h: np.ndarray) -> np.ndarray:
        out, ones = np.empty(len(h), np.float32), np.ones(self.columns.shape[1], np.float32)
        z = np.empty((128, len(ones)), np.float32)
        # no score is beyond this; up to 60, exp needs no shift
        beyond = np.linalg.norm(h[:, :-1], axis=1) * self.reach[0] + self.reach[1] >= 60
        for s in range(0, len(h), 128):
            part = h[s : s + 128]
            x = np.matmul(part, self.columns, out=z[: len(part)])
            shift = beyond[s : s + 128].any()
            top = x.max(1) if shift else np.float32(0)
            if shift:
                x -= top[:, None]
            out[s : s + 128] = np.log(np.exp2(x, out=x) @ ones) + top / LOG2_E
        return out


def log_probabilities(p: dict, target, one, two, normaliser: Normaliser | None = None) -> np.ndarray:
    """Natural log of the normalised probability of each target class."""
    normaliser, width = normaliser or Normaliser(p), len(p["q"])
    code = one.astype(np.int64) * width + two
    distinct, back = np.unique(code, return_inverse=True)
    h = predicted(p, np.take(p["q"], distinct // width, 0), np.take(p["q"], distinct % width, 0))
    norm = normaliser(distinct, h)
    out = np.empty(len(target))
    for s in range(0, len(target), 1 << 14):
        e = slice(s, s + (1 << 14))
        out[e] = scores(np.take(h, back[e], 0), np.take(p["r"], target[e], 0)) - norm[back[e]]
    return out


def groups_of(v: Vocabulary, group: int = GROUP) -> tuple[np.ndarray, np.ndarray]:
    """The first group of each tail class, and over how many groups it is dealt."""
    first, lanes = np.zeros(v.groups, np.int64), np.maximum(1, np.ceil(v.tail_counts / group)).astype(np.int64)
    number, room = -1, 0.0
    for k, c in enumerate(v.tail_counts):
        if number < 0 or lanes[k] > 1 or c > room:
            number, room = number + 1, float(group)
        first[k] = number
        room -= c
        if lanes[k] > 1:
            number, room = number + lanes[k] - 1, 0.0
    return first, lanes


SPOTS = "grp int, lot long, class binary, trained binary, other binary, word binary, code binary, text binary, head binary"
#: What the classes' model finds for each text of a lot: doc_id, whether that is null, tokens, known tokens of the head, base and score without the tail.
HEAD = np.dtype([("doc_id", np.int64), ("null_id", bool), ("n_tokens", np.int64), ("n_head", np.int64), ("base", np.float64), ("score", np.float64)])
#: What a group finds for a text of a lot.
SUMS = np.dtype([("text", np.uint16), ("known", np.int32), ("share", np.float32), ("base", np.float64)])


def score_texts(docs: DataFrame, v: Vocabulary, p: dict) -> DataFrame:
    """SPOTS of ``docs`` (doc_id, text, learn: whether the text trains): in lots, the tail's words by group, and a row with HEAD."""
    from pyspark import TaskContext

    denominator = v.total + 0.5 * (v.distinct + 1)
    base = lambda c: np.log10((c + 0.5) / denominator)
    first, lanes = groups_of(v)
    names = [c.strip().split()[0] for c in SPOTS.split(",")]
    schema = pa.schema([("grp", pa.int32()), ("lot", pa.int64()), *[(c, pa.binary()) for c in names[2:]]])

    def run(batches):
        normaliser, lot = Normaliser(p), TaskContext.get().partitionId() << 32
        heads: list[np.ndarray] = []
        held: list[tuple] = []
        n = texts = 0

        def emit():
            rows = [[int(first[lot % v.groups]), lot, *[None] * 6, np.concatenate(heads).tobytes()]]
            text, grp, word, code, learn = (np.concatenate(x, -1) for x in zip(*held, strict=True))
            # texts are in order already
            order = np.argsort((grp * 2 + ~learn).astype(number_type(2 * v.groups)), kind="stable")
            text, grp, word, code, learn = text[order], grp[order], word[order], code[:, order], learn[order]
            kinds, at, count = np.unique(grp, return_index=True, return_counts=True)
            trained = np.add.reduceat(learn.astype(np.int64), at) if len(at) else at
            group = first[kinds] + lot % lanes[kinds]
            steps = np.flatnonzero(np.diff(group, prepend=-1)) if len(kinds) else group
            for a, b in zip(steps, np.append(steps[1:], len(kinds)), strict=False):
                e = slice(at[a], at[b - 1] + count[b - 1])
                blobs = kinds[a:b].astype(np.int32), trained[a:b].astype(np.int32), (count - trained)[a:b].astype(np.int32), word[e], code[:, e], text[e].astype(np.uint16)
                rows.append([int(group[a]), lot, *[np.ascontiguousarray(x).tobytes() for x in blobs], None])
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for part in tk.slices(batch, "text"):
                if held and (n > LOT or texts + part.num_rows > LOT_TEXTS):
                    yield emit()
                    heads, held, n, texts, lot = [], [], 0, 0, lot + 1
                h, tail, offsets = tokens(part.column("text"))
                m = len(offsets) - 1
                doc = np.repeat(np.arange(m), np.diff(offsets))
                target, one, two, ends, known = v.sequence(h, tail, offsets)
                head, ids = np.zeros(m, HEAD), part.column("doc_id")
                head["doc_id"], head["null_id"] = pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False)
                head["n_tokens"] = np.diff(offsets) + 1
                head["n_head"] = tk.sums(known.astype(np.int64), offsets) + (v.end_count > 0)
                head["base"] = tk.sums(np.where(known, base(v.counts[target[np.arange(len(h)) + doc]]), 0.0), offsets) + base(v.end_count)
                head["score"] = tk.sums(log_probabilities(p, target, one, two, normaliser), ends) / np.log(10)
                heads.append(head)
                rest = np.flatnonzero(~known)
                at = rest + doc[rest]
                learn = part.column("learn").to_numpy(zero_copy_only=False)
                held.append((texts + doc[rest], v.group(h[rest], tail[rest]), h[rest], np.stack([one[at], two[at]]), learn[doc[rest]]))
                n, texts = n + len(target), texts + m
        if held:
            yield emit()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "learn").mapInArrow(run, SPOTS)


def word_model(counts: np.ndarray, target: np.ndarray, code: np.ndarray, p: dict) -> np.ndarray:
    """Vectors and biases of a tail class's words and, last, of its unseen word, by NCE from the class's unigram model on places with contexts ``code``."""
    share = (np.append(counts, 0) + 0.5) / (counts.sum() + 0.5 * (len(counts) + 1))
    rows = np.zeros((len(share), WIDTH), np.float32)
    rows[:, DIMENSIONS] = np.log(share)
    g2 = np.full(rows.shape, 1e-3, np.float32)
    cdf, log_noise = np.cumsum(share), np.log(share).astype(np.float32)
    rng = np.random.default_rng(9)
    # the same order however the rows came
    order = np.argsort((target * np.int64(1 << 16) + code[0]) * (1 << 16) + code[1])
    order = order[rng.permutation(len(order))]
    sn, weight = np.empty((BATCH, NOISE * SHARED), np.float32), np.float32(-1 / SHARED)
    for s in range(0, len(order), BATCH):
        mine = order[s : s + BATCH]
        t, h = target[mine], predicted(p, np.take(p["q"], code[0, mine], 0), np.take(p["q"], code[1, mine], 0), WIDTH)
        drawn, log_d, buffer = noise_terms(t, cdf, log_noise, rng, sn)
        with np.errstate(over="ignore"):
            et, en = errors(h, np.take(rows, t, 0), rows[drawn], log_noise[t], log_d, buffer)
        ascend(rows, g2, np.concatenate([t, drawn]), np.concatenate([et[:, None] * h, (en.T @ h) * weight]), len(t), TAIL_RATE)
    return np.ascontiguousarray(rows[:, : DIMENSIONS + 1])


def score_class(word: np.ndarray, count: np.ndarray, seen, learn: int, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Train the words of a tail class on the first ``learn`` of the places ``seen`` (words, contexts one and two before), and score all: log10 of the share and the training
    count at each place.

    ``word`` is sorted; what it lacks counts as the unseen word.
    """
    asked, code = seen
    at = np.minimum(np.searchsorted(word, asked), max(len(word) - 1, 0))
    t = (np.where(word[at] == asked, at, len(word)) if len(word) else np.zeros(len(asked), np.int64)).astype(number_type(len(word) + 1))
    model = {"q": p["q"], "c": p["c"], "r": word_model(count, t[:learn], code[:, :learn], p)}
    found, normaliser = np.empty(len(t)), Normaliser(model)
    for s in range(0, len(t), 1 << 20):
        e = slice(s, s + (1 << 20))
        found[e] = log_probabilities(model, t[e], code[0, e], code[1, e], normaliser)
    return found / np.log(10), np.append(count, 0.0)[t]


def score_group(spots: pa.Table, words: pa.Table, p: dict, denominator: float) -> pa.Table:
    """(lot, sums, head): for each lot SUMS of the words of this group's tail classes; rows with a head go on as they are."""
    heads = spots.filter(pc.is_valid(spots.column("head")))
    spots = spots.filter(pc.is_null(spots.column("head")))
    sums = []
    if spots.num_rows:
        lots = spots.column("lot").to_numpy()
        blobs = {c: [np.frombuffer(x.as_buffer(), k) for x in spots.column(c)] for c, k in (("class", np.int32), ("trained", np.int32), ("other", np.int32), ("word", np.uint64), ("text", np.uint16))}
        codes = [np.frombuffer(x.as_buffer(), np.uint16).reshape(2, -1) for x in spots.column("code")]
        # where each tail class lies in each lot
        pieces: dict = {}
        for i in range(len(lots)):
            trained, other = blobs["trained"][i], blobs["other"][i]
            ends = np.cumsum(trained.astype(np.int64) + other)
            for k, e, a, b in zip(blobs["class"][i].tolist(), ends.tolist(), trained.tolist(), other.tolist(), strict=True):
                pieces.setdefault(k, []).append((i, e - a - b, e - b, e))
        known = {c: words.column(c).to_numpy() for c in ("cls", "word", "c")}
        order = np.lexsort((known["word"].view(np.uint64), known["cls"]))
        known = {c: x[order] for c, x in known.items()}
        result = [(np.empty(len(w)), np.empty(len(w))) for w in blobs["word"]]
        for k, mine in sorted(pieces.items()):
            low, high = np.searchsorted(known["cls"], [k, k + 1])
            spans = [(i, a, m) for i, a, m, _ in mine] + [(i, m, e) for i, _, m, e in mine]
            asked = np.concatenate([blobs["word"][i][a:e] for i, a, e in spans])
            code = np.concatenate([codes[i][:, a:e] for i, a, e in spans], 1)
            share, c = score_class(known["word"][low:high].view(np.uint64), known["c"][low:high].astype(np.float64), (asked, code), sum(m - a for _, a, m, _ in mine), p)
            at = 0
            for i, a, e in spans:
                result[i][0][a:e], result[i][1][a:e] = share[at : at + e - a], c[at : at + e - a]
                at += e - a
        for (share, c), text in zip(result, blobs["text"], strict=True):
            found, back = np.unique(text, return_inverse=True)
            row = np.zeros(len(found), SUMS)
            row["text"], row["share"], row["known"], row["base"] = found, np.bincount(back, share), np.bincount(back, c > 0), np.bincount(back, np.log10((c + 0.5) / denominator))
            sums.append(row.tobytes())
    empty = pa.nulls(heads.num_rows, pa.binary())
    return pa.table({"lot": pa.chunked_array([spots.column("lot").combine_chunks(), heads.column("lot").combine_chunks()], pa.int64()), "sums": pa.chunked_array([pa.array(sums, pa.binary()), empty]), "head": pa.chunked_array([pa.nulls(len(sums), pa.binary()), heads.column("head").combine_chunks()], pa.binary())})


def add_up(table: pa.Table) -> pa.Table:
    """The texts of a lot with what the classes and the groups found."""
    head = joined(table.column("head"), HEAD)
    sums = joined(table.column("sums"), SUMS)
    add = lambda c: np.bincount(sums["text"], sums[c], minlength=len(head))
    return pa.table({"doc_id": pa.array(head["doc_id"], mask=head["null_id"]), "n_tokens": head["n_tokens"], "n_known": head["n_head"] + add("known").astype(np.int64), "base_score": head["base"] + add("base"), "score": head["score"] + add("share")})


def score_documents(docs: DataFrame, training: DataFrame | Column, model_words: int = MODEL_WORDS) -> DataFrame:
    """Score ``docs`` (doc_id, text) by a model of ``training``: a condition on the rows of ``docs``, or a table (doc_id, text) of its own.

    A table of its own passes through the scoring as well, for its words of the tail, and leaves no rows in the result.
    """
    if isinstance(training, Column):
        learn = F.coalesce(training, F.lit(False))
        every = docs.select("doc_id", "text", learn.alias("learn"), F.lit(True).alias("wanted"))
    else:
        every = docs.select("doc_id", "text", F.lit(False).alias("learn"), F.lit(True).alias("wanted")).unionByName(training.select("doc_id", "text", F.lit(True).alias("learn"), F.lit(False).alias("wanted")))
    source = every.where("learn").select("doc_id", "text")
    counts = cut(word_counts(source))
    v = vocabulary(counts, model_words)
    p = train(source, v)
    denominator = v.total + 0.5 * (v.distinct + 1)
    spark = docs.sparkSession
    head = spark.createDataFrame([(int(w),) for w in v.words.view(np.int64)], "word long")
    first, lanes = groups_of(v)
    # a row for each tail class, whose number grows as the root of that of words
    dealt = spark.createDataFrame([(k, int(f), int(n)) for k, (f, n) in enumerate(zip(first, lanes, strict=True))], "cls int, first int, lanes int")
    words = counts.where("tail >= 0").join(F.broadcast(head), "word", "left_anti").select(group_column(v.split).alias("cls"), "word", "c").join(small_enough(dealt), "cls")
    words = words.select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("lanes") - 1)).alias("grp"), "cls", "word", "c")

    def scored(part: DataFrame) -> DataFrame:
        n = 2 * int((first + lanes).max())
        met = score_texts(part, v, p).repartition(n, "grp").groupBy("grp").cogroup(words.repartition(n, "grp").groupBy("grp")).applyInArrow(lambda a, b: score_group(a, b, p, denominator), "lot long, sums binary, head binary")
        return met.groupBy("lot").applyInArrow(add_up, "doc_id long, n_tokens long, n_known long, base_score double, score double")

    if isinstance(training, Column):
        out = scored(every)
    else:
        # rows are told apart by a flag in place of the doc_id, and come back with it
        own = cut(every.select(F.monotonically_increasing_id().alias("i"), "doc_id", "text", "learn", "wanted"))
        found = scored(own.select(F.col("i").alias("doc_id"), "text", "learn")).withColumnRenamed("doc_id", "i")
        out = own.where("wanted").select("i", "doc_id").join(found, "i").drop("i")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"), "base_score", "score")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score_documents(docs, ~held_out(5, 1))
    return scored.select("doc_id", held_out(5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
