"""Benchmark decontamination: edit distance by a random-walk embedding and bit-sampling LSH.

Texts and items are words (lower-cased runs of letters and digits). A document is contaminated by an item of n words if a run
of its words is within floor(0.2 n) edits of the item.

1. Windows. An item keeps at least n - 1 - 2k of its word pairs under k edits, so only windows with that many pairs from the
   benchmark, of whatever items, can match; others can't and aren't embedded.
2. Embedding (CGK). A walk copies the current word and then stays or advances, by a hash of step and word. Words at edit distance
   k end up at a Hamming distance of O(k^2), whatever the lengths. The walk of the longest window holds those of all shorter ones.
3. LSH. Each of WALKS walks is sampled in SAMPLES sets of BITS steps; a window and an item of its size that agree in all steps of any set
   are a candidate. The item-sized windows at all starts around a passage are tried, so recall is far above that of a single window.
4. Candidates are verified exactly: the least edit distance of the item to any run of words at the window, by dynamic programming.

The benchmark is the stated query set; it goes to the tasks in parts of at most ITEM_WORDS words, one pass over the documents for each.

Defined cases: null and empty texts and items match nothing; equal items are all reported; repeated rows are reported each; null ids of documents and items are passed on; very long texts are searched whole; other columns of the input stay as they are in
decontaminate(); empty tables give empty results; of the matches of one item in a document the best is reported, the first of equals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ploidyne.llm import textkernel as tk
from ploidyne.llm.common import cut, documents, small_enough

EDIT_SHARE = 0.2
WALKS, SAMPLES, BITS = 8, 8, 3
ITEM_WORDS = 2_000_000
_rng = np.random.default_rng(31)
_SALT = _rng.integers(1, 2**63, (WALKS, 2), dtype=np.uint64) | np.uint64(1)
_FACTOR = _rng.integers(1, 2**63, BITS, dtype=np.uint64) | np.uint64(1)
END = np.uint64(0)
HITS = "doc_id long, item_id long, n_words int, edit_distance int, start_word int"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = tk.Words(*tk.buffers(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))), tk.NOT_ALNUM)
    return w.hashes, w.offsets


def edits(n: int) -> int:
    return int(EDIT_SHARE * n + 1e-9)


@np.errstate(over="ignore")
def walk(sequence: np.ndarray, starts: np.ndarray, ends: np.ndarray, longest: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and positions at each of 2 * longest steps of the walk from each start; END and the last position past ``ends``."""
    steps = max(1, 2 * longest)
    at = starts.copy()
    symbols, places = np.empty((steps, len(starts)), np.uint64), np.empty((steps, len(starts)), np.int32)
    padded = np.append(sequence, END)
    a, b = _SALT[number]
    for j in range(steps):
        inside = at < ends
        s = np.where(inside, padded[np.minimum(at, len(sequence))], END)
        symbols[j], places[j] = s, at - starts
        at = at + (inside & ((((s + np.uint64(j) * b) * a) >> np.uint64(63)) == 1))
    return symbols, places


class Index:
    """Items by size, their word pairs, and their LSH keys."""

    def __init__(self, items: list[tuple[int, str]]):
        hashes, offsets = words_of(pa.array([t for _, t in items], pa.string()))
        self.words = [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.ids = [i for i, _ in items]
        self.sizes = sorted({len(w) for w in self.words if len(w)})
        self.of_size = {n: [k for k, w in enumerate(self.words) if len(w) == n] for n in self.sizes}
        pairs = [self.pair(w) for w in self.words if len(w) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        self.vocabulary = np.unique(np.concatenate([*self.words, np.zeros(0, np.uint64)]))
        self.numbers = [np.searchsorted(self.vocabulary, w) for w in self.words]
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.pairs >> np.uint64(44)).astype(np.int64)] = True
        self.single = np.unique(np.concatenate([w for w in self.words if len(w) == 1])) if 1 in self.of_size else np.zeros(0, np.uint64)
        rng = np.random.default_rng(7)
        self.steps = {n: rng.integers(0, max(1, 2 * n), (WALKS, SAMPLES, BITS)) for n in self.sizes}
        self.keys: dict = {}
        for n in self.sizes:
            flat = np.concatenate([self.words[k] for k in self.of_size[n]])
            starts = np.arange(len(self.of_size[n]), dtype=np.int64) * n
            for r in range(WALKS):
                keys = self.sample(*walk(flat, starts, starts + n, n, r), np.arange(len(starts)), n, r)
                for z in range(SAMPLES):
                    order = np.argsort(keys[z], kind="stable")
                    self.keys[n, r, z] = keys[z][order], np.array(self.of_size[n])[order]

    @staticmethod
    def pair(w: np.ndarray) -> np.ndarray:
        return tk.mix(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:])

    def sample(self, symbols: np.ndarray, places: np.ndarray, which: np.ndarray, n: int, r: int) -> np.ndarray:
        """Keys of the windows ``which``, of ``n`` words: a row for each set of sampled steps, with a linear hash of the words there."""
        out = np.zeros((SAMPLES, len(which)), np.uint64)
        for key, steps in zip(out, self.steps[n][r], strict=True):
            for j, factor in zip(steps, _FACTOR, strict=True):
                key += np.where(places[j][which] < n, symbols[j][which], END) * factor
        return out

    def windows(self, hashes: np.ndarray, doc: np.ndarray) -> dict[int, np.ndarray]:
        """For each size the starts of the windows that hold enough of the benchmark's word pairs."""
        p = self.pair(hashes)
        maybe = np.flatnonzero(self.bitmap[(p >> np.uint64(44)).astype(np.int64)] & (doc[:-1] == doc[1:]))
        hit = maybe[np.isin(p[maybe], self.pairs)]
        first = np.searchsorted(doc, doc[hit], "left")
        out = {}
        for n in self.sizes:
            k = edits(n)
            need = n - 1 - 2 * k
            if n == 1:
                out[n] = np.flatnonzero(np.isin(hashes, self.single))
                continue
            if len(hit) < need:
                continue
            a, b = hit[: len(hit) - need + 1], hit[need - 1 :]
            ok = (b - a <= n + k - 2) & (doc[a] == doc[b])
            a, b, f = a[ok], b[ok], first[: len(first) - need + 1][ok]
            low = np.maximum(f, np.minimum(b - (n - 2), a))
            count = a - low + 1
            starts = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(a) else a
            out[n] = np.unique(starts)
        return {n: s for n, s in out.items() if len(s)}

    def search(self, hashes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, edit distance, start word) of the best match of each item in each text."""
        if len(hashes) < 1 or not self.sizes:
            return []
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        wanted = self.windows(hashes, doc)
        if not wanted:
            return []
        starts = np.unique(np.concatenate(list(wanted.values())))
        found = []
        for part in np.array_split(starts, max(1, len(starts) // 4000)):
            mine = {n: np.searchsorted(part, s[(s >= part[0]) & (s <= part[-1])]) for n, s in wanted.items()}
            mine = {n: s for n, s in mine.items() if len(s)}
            longest = max(mine)
            ends = offsets[1:][doc[part]]
            for r in range(WALKS):
                symbols, places = walk(hashes, part, ends, longest, r)
                for n, s in mine.items():
                    keys = self.sample(symbols, places, s, n, r)
                    for z in range(SAMPLES):
                        known, owner = self.keys[n, r, z]
                        low = np.searchsorted(known, keys[z], "left")
                        hit = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == keys[z])
                        if len(hit):
                            low = low[hit]
                            times = np.searchsorted(known, keys[z][hit], "right") - low
                            q = np.repeat(hit, times)
                            at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(len(q))
                            found.append(part[s[q]] * len(self.words) + owner[at])
        codes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return self.verify(zip((codes // len(self.words)).tolist(), (codes % len(self.words)).tolist(), strict=True), hashes, offsets, doc)

    def verify(self, candidates, hashes, offsets, doc) -> list[tuple[int, int, int, int]]:
        best: dict = {}
        by_item: dict = {}
        # each word's number in the benchmark's vocabulary; words outside it share the last one, which no item has
        seen = np.zeros(len(self.vocabulary) + 1, bool)
        number = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        number = np.where(self.vocabulary[number] == hashes, number, len(self.vocabulary))
        for start, item in candidates:
            by_item.setdefault((item, int(doc[start])), []).append(start)
        for (item, d), starts in by_item.items():
            word, k, n, done = self.words[item], edits(len(self.words[item])), len(self.words[item]), -1
            for start in starts:
                if start <= done:
                    continue
                low, high = max(offsets[d], start - 2 * k), min(offsets[d + 1], start + 2 * n + 2 * k)
                # runs that start up to here lie within what is searched now
                done = high - n - k
                # an item's word that the run lacks is an edit, so this bound loses nothing
                seen[number[low:high]] = True
                held = np.count_nonzero(seen[self.numbers[item]])
                seen[number[low:high]] = False
                if n - held > k:
                    continue
                distance, at = best_run(word, hashes[low:high])
                if distance <= k:
                    best[d, item] = min(best.get((d, item), (n + 1, 0)), (distance, int(low + at - offsets[d])))
        return [(d, item, distance, at) for (d, item), (distance, at) in sorted(best.items())]


def best_run(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance of ``item`` to a run of words of ``text``, and where the first such run starts."""
    m = len(text)
    cost, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    big = np.int64(1) << 32
    for i, w in enumerate(item):
        # cost and origin in one number, so that minima carry the start along
        old = cost * big + origin
        new = np.empty(m + 1, np.int64)
        new[0] = (i + 1) * big
        new[1:] = np.minimum(old[:-1] + np.where(text == w, 0, big), old[1:] + big)
        # insertions: the least of new[j'] + (j - j')
        lift = np.arange(m + 1) * big
        new = np.minimum.accumulate(new - lift) + lift
        cost, origin = new // big, new % big
    at = int(np.argmin(cost))
    return int(cost[at]), int(origin[at])


def find_contamination(docs: DataFrame, benchmark: DataFrame, item_words: int = ITEM_WORDS) -> DataFrame:
    """HITS: a row for each document and item of ``benchmark`` (item_id, text) of which it holds a passage."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    parts = max(1, -(-words // item_words))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def search(index: Index) -> DataFrame:
        @tk.tidy
        def run(batches):
            for batch in batches:
                for part in tk.slices(batch, "text", 2 << 20):
                    found = index.search(*words_of(part.column("text")))
                    if found:
                        d, i, e, s = zip(*found, strict=True)
                        yield pa.record_batch([part.column("doc_id").take(pa.array(d)), pa.array([index.ids[k] for k in i], pa.int64()), pa.array([len(index.words[k]) for k in i], pa.int32()), pa.array(e, pa.int32()), pa.array(s, pa.int32())], names=["doc_id", "item_id", "n_words", "edit_distance", "start_word"])

        return texts.mapInArrow(run, HITS)

    out = None
    for k in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        found = search(Index(sorted(((r.item_id, r.text) for r in mine.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))))
        out = found if out is None else out.unionByName(cut(found))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose texts hold no passage of the benchmark."""
    # by text, so that null and repeated ids don't matter
    found = cut(find_contamination(docs.select(F.xxhash64("text").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("hit")).distinct())
    packed = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("h"))
    return packed.join(small_enough(found), F.col("h") == F.col("hit"), "left_anti").select("row.*")


def op8(spark, sf_dir: str) -> DataFrame:
    return find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
