"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Texts are read once: word shingles, their number, a 128-bit fingerprint of the set and a MinHash signature of K coordinates.
   Documents with equal sets form a class, so copies, however many, cost one row from here on.
2. A class is posted under its (coordinate, value) pairs. Two classes that agree in T of K coordinates share at least COLLISIONS of the
   K - T + COLLISIONS pairs that are rarest over all classes, for either of them; so only those are posted (the prefix). Pairs that occur once are
   never posted. Passages that many documents share give frequent pairs, which come last and drop out.
3. Short posting lists are merged and collisions of classes are counted. Classes that collide fewer than COLLISIONS times, counting each posting in a long list as a
   collision, can't reach T and are skipped; for the others the rest of their lists is skipped by comparing signatures. Those with T matches are
   confirmed on their full sets.
4. A posting list longer than LIST is first joined to its least member alone. If that leaves its members in more than one component, those outside the
   component that most are in are outsiders. Lists of one such component become one where this takes fewer comparisons, and members go that have too many shingles of their
   own to be linked with an outsider. The outsiders that are left are compared with all members, in blocks: a task compares two blocks by a product of their incidence matrices, and
   returns links that span what it joined. So no list emits all its pairs, members that are joined already meet no one but outsiders, and no link between components is lost.
5. Components come from star rounds over the links.

T lies five standard deviations below the matches that the threshold leads one to expect, so a pair at the threshold is missed with a
probability of about 1e-6 and one above it with less.

Defined cases: null and empty texts and texts without words have no shingles and link with nothing; a text with fewer words than a shingle has is one
shingle; a very long text is one row of one task, with its whole set; a null doc_id never names a component: a component of such documents alone has a null id; equal rows are
copies of each other, and each of them whose doc_id names the component counts as kept in minhash_classes(), one of them in near_dedup(); other columns of the input stay
as they are in near_dedup(), whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ploidyne.llm import textkernel as tk
from ploidyne.llm.common import connected_components, cut_counted, cut_small, documents, hot_rows, in_few_parts, join_unskewed, small_enough

WORDS = 5
COORDINATES = 64
#: Classes must collide so often in their prefixes.
COLLISIONS = 3
#: Posting lists with more classes are compared in blocks of BLOCK.
LIST = 48
BLOCK = 384
_rng = np.random.default_rng(977)
_A = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, 256, dtype=np.uint64)


def match_threshold(similarity: float, k: int = COORDINATES) -> int:
    """Coordinates that must agree: five standard deviations below those expected at ``similarity``."""
    return max(1, int(np.ceil(k * similarity - 5 * np.sqrt(k * similarity * (1 - similarity)))))


def _shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    return tk.distinct(*tk.Words(*tk.buffers(texts)).shingles(words))


def _prints(hashes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """128-bit fingerprints of sets, the same for any order."""
    both = np.stack([tk.sums(tk.mix(hashes ^ np.uint64(salt)), offsets) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], 1)
    return pa.array([r.tobytes() for r in both], pa.binary())


def _signatures(hashes: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Rows of k 32-bit minima; texts without shingles have zeros."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, k), np.uint32)
    if len(full):
        for j in range(k):
            out[full, j] = np.minimum.reduceat((hashes * _A[j] + _B[j]) >> np.uint64(32), offsets[full])
    return out


def text_key(text: str = "text") -> list:
    """Two 64-bit hashes, k1 and k2, by which a text is found again."""
    return [F.xxhash64(F.lit(salt), F.col(text)).alias(name) for name, salt in (("k1", 1), ("k2", 2))]


def features(docs: DataFrame, words: int = WORDS, k: int = COORDINATES) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, cid, sig) of each row; k1 and k2 tell texts apart, cid is the fingerprint of the set, sig the signature's bytes."""

    @tk.tidy
    def run(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                hashes, offsets = _shingle_sets(part.column("text"), words)
                sig = _signatures(hashes, offsets, k)
                yield pa.record_batch([*[part.column(c) for c in ("doc_id", "k1", "k2")], pa.array(np.diff(offsets)), _prints(hashes, offsets), pa.array([r.tobytes() for r in sig], pa.binary())], names=["doc_id", "k1", "k2", "n_shingles", "cid", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *text_key()).mapInArrow(run, "doc_id long, k1 long, k2 long, n_shingles long, cid binary, sig binary")


def _postings(classes: DataFrame, t: int, k: int, n_classes: int) -> DataFrame:
    """(token, cid) for the rarest K - T + COLLISIONS coordinate-value pairs of each class, as far as another class has them."""

    @tk.tidy
    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            token = (sig.astype(np.int64) << 8) | np.arange(sig.shape[1])
            yield pa.record_batch([pa.array(token.ravel()), batch.column("cid").take(pa.array(np.repeat(np.arange(batch.num_rows), sig.shape[1])))], names=["token", "cid"])

    tokens = classes.select("cid", "sig").mapInArrow(run, "token long, cid binary")
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # by class: its shared pairs, rarest first; its single pairs come before them
    met = join_unskewed(tokens, shared, "token", "df", hot_rows(n_classes * k))
    mine = met.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("p"))
    room = F.lit(k - t + COLLISIONS) - (F.lit(k) - F.size("p"))
    return mine.where(room > 0).select("cid", F.explode(F.slice("p", F.lit(1), room)).alias("p")).select(F.col("p.token").alias("token"), "cid")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(cid, shingles) for the wanted (cid, rep): shingles are computed again from the texts of these alone, one text for each class."""

    @tk.tidy
    def run(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                hashes, offsets = _shingle_sets(part.column("text"), words)
                yield pa.record_batch([part.column("cid"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes.view(np.int64)))], names=["cid", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *text_key())
    names = wanted.select("cid", F.col("rep.no_id").alias("no_id"), F.col("rep.doc_id").alias("r0"), F.col("rep.k1").alias("r1"), F.col("rep.k2").alias("r2"))
    same = (texts["k1"] == F.col("r1")) & (texts["k2"] == F.col("r2")) & texts["doc_id"].eqNullSafe(F.col("r0"))
    # equal rows meet before their sets are made
    keyed = texts.join(small_enough(names), same).select("cid", "text").groupBy("cid").agg(F.first("text").alias("text"))
    return keyed.mapInArrow(run, "cid binary, shingles array<long>")


def _linked(a: str, b: str, percent: int):
    both = F.size(F.array_intersect(a, b))
    return both * 100 >= (F.size(a) + F.size(b) - both) * percent


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    x = pairs.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), "a")
    return x.where(_linked("sa", "sb", percent)).select("a", "b")


def block_links(ids: list[bytes], parts: list[np.ndarray], labels: list, percent: int) -> list[tuple[bytes, bytes]]:
    """Links of similar sets that join what isn't joined; ``labels`` says what is."""
    n = len(ids)
    values, column = np.unique(np.concatenate(parts), return_inverse=True)
    row = np.repeat(np.arange(n), [len(p) for p in parts])
    often = np.bincount(column, minlength=len(values)) > 1
    keep = often[column]
    rank = np.cumsum(often) - 1
    row, column = row[keep], rank[column[keep]]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for start in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        m = np.zeros((n, width), np.float32)
        m[row[a:b], column[a:b] - start] = 1
        both += m @ m.T
    sizes = np.array([len(p) for p in parts], np.int64)
    both = both.astype(np.int64)
    similar = both * 100 >= (sizes[:, None] + sizes[None, :] - both) * percent
    parent = {x: x for x in labels}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(similar, 1)), strict=True):
        if (x := find(labels[i])) != (y := find(labels[j])):
            parent[x] = y
            out.append((ids[i], ids[j]))
    return out


def _stars(parts: DataFrame) -> DataFrame:
    """Links (a, b) that stand for components."""
    return parts.where("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))


def _outsiders(posts: DataFrame, parts: DataFrame, hot: int, most: int) -> DataFrame:
    """(token, cid, label, main, out) of the lists with members in more than one component; main is the component that has most of the list, out is 1 outside it."""
    members = posts.join(parts.withColumnRenamed("node", "cid"), "cid", "left").select("token", "cid", F.coalesce("component", "cid").alias("label"))
    by = members.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
    main = cut_small(by.where("all > top.n").select("token", F.col("top.label").alias("main"), "all"), most=most)
    return cut_small(join_unskewed(members, main, "token", "all", hot).select("token", "cid", "label", "main", (F.col("label") != F.col("main")).cast("int").alias("out")), most=most)


def _merged(split: DataFrame, most: int) -> DataFrame:
    """(token, cid) of the lists, those of one main component as one where this takes no more comparisons: similar classes meet in many lists, here in one."""
    product = F.sum("out").cast("double") * F.count(F.lit(1))
    apart = split.groupBy("main", "token").agg(product.alias("n")).groupBy("main").agg(F.sum("n").alias("apart"))
    joint = split.select("main", "cid", "out").distinct().groupBy("main").agg(product.alias("joint"))
    fewer = small_enough(apart.join(joint, "main").where("joint <= apart").select("main", F.lit(True).alias("merge")))
    return cut_small(split.join(fewer, "main", "left").select(F.when(F.col("merge"), F.col("main")).otherwise(F.col("token")).alias("token"), "cid").distinct(), most=most)


def _linkable(split: DataFrame, sets: DataFrame, percent: int, hot: int, most: int) -> DataFrame:
    """(token, cid) without the members that can't be linked with an outsider of their list, or as outsiders with any member. With ux of x's shingles in no other member's
    set, and uy of y's, x and y share at most |x| - ux of at least |x| + uy shingles."""
    some = sets.join(small_enough(split.select("cid").distinct()), "cid", "left_semi")
    alone = some.select("cid", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("cid")).where("n = 1")
    alone = alone.groupBy("cid").agg(F.count(F.lit(1)).alias("u"))
    known = some.select("cid", F.size("shingles").alias("size")).join(alone, "cid", "left").fillna(0, ["u"])
    # x and y can be linked if room(x) >= u(y) and room(y) >= u(x)
    x = split.join(known.select("cid", (F.col("u") * percent).alias("u"), ((F.col("size") - F.col("u")) * 100 - F.col("size") * percent).alias("room")), "cid")
    for out in (1, 0):
        x = cut_small(x, most=most)
        best = x.where(F.lit(True) if out else F.col("out") == 1).groupBy("token").agg(F.min("u").alias("least"), F.max("room").alias("most"))
        best = best.join(x.groupBy("token").agg(F.count(F.lit(1)).alias("all")), "token")
        met = join_unskewed(x, best, "token", "all", hot)
        x = met.where((F.col("out") != out) | ((F.col("room") >= F.col("least")) & (F.col("most") >= F.col("u")))).drop("least", "most", "all")
    return cut_small(x.select("token", "cid"), most=most)


def links(docs: DataFrame, classes: DataFrame, similarity: float = 0.85, words: int = WORDS, k: int = COORDINATES) -> DataFrame:
    """Links (a, b) between classes, of similarity at least ``similarity``, that connect all that are linked."""
    percent, t = round(similarity * 100), match_threshold(similarity, k)
    n_classes = classes.count()
    posted, n_posted = cut_counted(_postings(classes, t, k, n_classes), most=n_classes * k)
    hot = hot_rows(n_posted)
    lists = cut_small(posted.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("cid").alias("lead")).where("m > 1"), most=n_posted // 2)
    long_lists = lists.where(F.col("m") > LIST)
    of_long, n_long = cut_counted(join_unskewed(posted, long_lists, "token", "m", hot), most=n_posted)
    short = posted.join(lists.where(F.col("m") <= LIST).select("token"), "token")
    merged = short.select("token", F.col("cid").alias("a")).join(short.select("token", F.col("cid").alias("b")), "token").where("a < b")
    spare = of_long.groupBy("cid").agg(F.count(F.lit(1)).alias("w"))
    counted = merged.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.join(spare.select(F.col("cid").alias("a"), F.col("w").alias("wa")), "a", "left").join(spare.select(F.col("cid").alias("b"), F.col("w").alias("wb")), "b", "left")
    often = counted.where(F.col("n") + F.greatest(F.coalesce("wa", F.lit(0)), F.coalesce("wb", F.lit(0))) >= COLLISIONS).select("a", "b")
    led = of_long.where("cid != lead").select(F.col("lead").alias("a"), F.col("cid").alias("b")).distinct()
    sig = classes.select("cid", "sig", F.col("n_shingles").alias("n"))

    probe = often.union(led).join(sig.select(F.col("cid").alias("b"), F.col("sig").alias("y"), F.col("n").alias("ny")), "b")
    # a class leads as many pairs as its longest lists have members
    leads = probe.groupBy("a").agg(F.count(F.lit(1)).alias("pairs")).join(sig.select(F.col("cid").alias("a"), F.col("sig").alias("x"), F.col("n").alias("nx")), "a")
    probe = join_unskewed(probe, leads, "a", "pairs", hot)
    probe = probe.where(F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent)

    @tk.tidy
    def matches(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in "xy")
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= t))

    pairs, n_pairs = cut_counted(probe.select("a", "b", "x", "y").mapInArrow(matches, "a binary, b binary"))
    ids = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).union(of_long.select("cid")).distinct()
    wanted = cut_small(ids.join(classes.select("cid", "rep"), "cid"), most=n_classes)
    sets = cut_small(_sets(docs, wanted, words), 2_000, n_classes)
    # each pair brings two whole sets
    first = cut_small(_confirm(pairs, sets, percent), 10_000, n_pairs)
    if n_long == 0:
        return first
    parts = cut_small(connected_components(first, most=n_pairs), most=2 * n_pairs)
    posts = _merged(_outsiders(of_long.select(F.col("token").cast("string").cast("binary").alias("token"), "cid"), parts, hot, n_long), n_long)
    # members that no other one of their lists can be linked with, by the shingles that they alone have, go
    split = _outsiders(_linkable(_outsiders(posts, parts, hot, n_long), sets, percent, hot, n_long), parts, hot, n_long).drop("main")
    sizes = cut_small(split.groupBy("token").agg(F.sum("out").alias("outside"), F.count(F.lit(1)).alias("all")), most=n_long)
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    dealt = join_unskewed(split, sizes.withColumn("no", blocks(F.col("outside"))).withColumn("ni", blocks(F.col("all") - F.col("outside"))), "token", "all", hot)
    # blocks by a hash of the member: of outsiders 0 to no - 1, of the others no to no + ni - 1; a task for each block of outsiders with each block
    mine = F.pmod(F.xxhash64("cid"), F.when(F.col("out") == 1, F.col("no")).otherwise(F.col("ni"))).cast("int") + F.when(F.col("out") == 1, F.lit(0)).otherwise(F.col("no"))
    other = F.explode(F.when(F.col("out") == 1, F.sequence(F.lit(0), F.col("no") + F.col("ni") - 1)).otherwise(F.sequence(F.lit(0), F.col("no") - 1)))
    dealt = dealt.withColumn("i", mine).withColumn("o", other).withColumn("bi", F.least("i", "o")).withColumn("bj", F.greatest("i", "o"))
    dealt = dealt.select("token", "bi", "bj", "cid", "label").join(sets, "cid")

    def compare(table):
        data = table.column("shingles").combine_chunks()
        offsets, flat = data.offsets.to_numpy(), data.values.to_numpy()
        out = block_links(table.column("cid").to_pylist(), [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], table.column("label").to_pylist(), percent)
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    # the stars found so far stand for the first links
    return _stars(parts).union(cut_small(dealt.groupBy("token", "bi", "bj").applyInArrow(compare, "a binary, b binary")))


def row_classes(docs: DataFrame, similarity: float = 0.85, words: int = WORDS, k: int = COORDINATES) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, component, least) of every row of ``docs``: least is the first row of the component, as (no_id, doc_id, k1, k2), that with the least
    doc_id; both are null for texts without words."""
    all_rows, n_rows = cut_counted(features(docs, words, k), 20_000)
    rep = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    classes = cut_small(all_rows.where("n_shingles > 0").groupBy("cid").agg(F.min(rep).alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min("sig").alias("sig"), F.count(F.lit(1)).alias("copies")), 20_000, n_rows)
    found = links(docs, classes, similarity, words, k)
    parts = connected_components(found, most=found.count())
    named = cut_small(classes.select("cid", "rep", "copies").join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")), most=n_rows)
    least = named.groupBy("component").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("m"))
    hot = hot_rows(n_rows)
    ids = join_unskewed(named, least, "component", "m", hot).select("cid", "component", "least", "copies")
    some = all_rows.where("n_shingles > 0").select("cid", "doc_id", "k1", "k2", "n_shingles")
    out = join_unskewed(some, ids, "cid", "copies", hot).select("doc_id", "k1", "k2", "n_shingles", "component", "least")
    return in_few_parts(out.unionByName(all_rows.where("n_shingles = 0").select("doc_id", "k1", "k2", "n_shingles"), allowMissingColumns=True), n_rows)


def minhash_classes(docs: DataFrame, similarity: float = 0.85, words: int = WORDS, k: int = COORDINATES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    rows = row_classes(docs.select("doc_id", "text"), similarity, words, k)
    named = F.when(F.col("n_shingles") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id"))
    out = rows.select("doc_id", "n_shingles", named.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def near_dedup(docs: DataFrame, similarity: float = 0.8, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, that with the least doc_id (a null one is the last), and of rows equal in doc_id and text the one whose
    columns hash least; all rows without words stay."""
    rows, n_rows = cut_counted(row_classes(docs.select("doc_id", "text"), similarity, words))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2") == F.struct("least.no_id", "least.doc_id", "least.k1", "least.k2")
    # by doc_id and text: the rows that go, and those of which one stays
    fate = rows.where("n_shingles > 0").groupBy("doc_id", "k1", "k2").agg(F.min(F.coalesce(first, F.lit(False)).cast("int")).alias("first"), F.count(F.lit(1)).alias("n"))
    fate = cut_small(fate.where("first = 0 or n > 1").select(F.col("doc_id").alias("r0"), F.col("k1").alias("r1"), F.col("k2").alias("r2"), "first"), most=n_rows)
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), *text_key())
    same = (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")) & F.col("id").eqNullSafe(F.col("r0"))
    stay = packed.join(small_enough(fate), same, "left_anti").select("row.*")
    again = packed.join(small_enough(fate.where("first = 1")), same)
    one = again.groupBy("id", "k1", "k2").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")
    return stay.unionByName(one)


def op3(spark, sf_dir: str) -> DataFrame:
    return minhash_classes(documents(spark, sf_dir), 0.85)
