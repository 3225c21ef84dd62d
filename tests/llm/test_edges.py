"""Clashing columns, empty tables, ties and the pipeline from end to end."""

import collections
import hashlib
import io
import itertools
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ploidyne.llm import decontam, langid, lm, media, minhash, mixing, quality, sharding, urlfilter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
INNER = ("_key", "_bucket", "_one", "_source", "_url", "_hit", "_hit_id", "_score", "_place", "_own_", "_own_key", "row", "k1", "id", "h", "cid", "learn", "lot", "token")
PUBLISHED = ("host", "rule", "shard", "slot", "n_shingles", "score", "taken", "size", "lang_pred")
TEXTS = ["the quick brown fox jumps over it", "der alte hund schläft heute lange", None, "", " \t", "the quick brown fox jumps over it", "x " * 4000, "what of it"]


def clash(spark, more=""):
    rows = [(i, t, ["a", "b", None][i % 3], "de" if i == 1 else "en", f"http://a.com/{i}", t, *[f"{c}{i}" for c in INNER], *[f"{c}{i}" for c in PUBLISHED]) for i, t in enumerate(TEXTS)]
    kinds = ", ".join(f"{c} string" for c in INNER + PUBLISHED)
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, lang string, url string, html string, {kinds}").withColumn("page_id", F.col("doc_id"))


def everything(spark, docs):
    """Each operator on ``docs``, by name, with whether it returns the rows of its input."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "zzz yyy xxx www vvv uuu ttt"), (None, "what of it all then dear friend")], "item_id long, text string")
    model = langid.train(docs.select("doc_id", "text", "lang"))
    return {
        "op1": (urlfilter.judge_urls(docs), True),
        "op2": (sharding.shard_documents(docs), True),
        "op3": (minhash.near_dedup(docs), True),
        "op4": (media.read(media.store(docs)), False),
        "op5": (quality.classify(docs, quality.train(docs, labels)), True),
        "op6": (langid.identify(docs, model), True),
        "op7": (warc.read_archives(warc.write_archives(docs)), False),
        "op8": (decontam.decontaminate(docs, bench), True),
        "op8 hits": (decontam.find_contamination(docs, bench), False),
        "op9": (lm.score_documents(docs, F.lit(True), model_words=3), False),
        "op10": (mixing.mix_sources(docs), True),
    }


def test_clashing_columns_come_back(spark):
    docs = clash(spark)
    want = {r.doc_id: r.asDict() for r in docs.collect()}
    for name, (got, rows) in everything(spark, docs).items():
        found = got.collect()
        assert len(found) == {"op3": 7, "op8 hits": 0}.get(name, len(TEXTS)), name
        if rows:
            added = {"op1": ("host", "path", "rule", "verdict"), "op2": ("shard", "grown_shard", "slot"), "op5": ("score",), "op6": ("lang_pred", "score", "rejected"), "op10": ("size", "source_size", "target", "copies", "taken")}.get(name, ())
            assert not any(c.startswith("_own__") for c in got.columns), name
            for r in found:
                for c in docs.columns:
                    assert c in added or r[c] == want[r.doc_id][c], (name, c)


def test_empty_tables(spark):
    for name, (got, _) in everything(spark, clash(spark).limit(0)).items():
        assert got.count() == 0, name


def test_ties_and_repeats_score_alike(spark):
    docs = spark.createDataFrame([(i, "same words in each of these texts") for i in range(6)] + [(1, "same words in each of these texts")], "doc_id long, text string").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.lit("aa")).otherwise(F.lit("bb")))
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    assert len({r.score for r in quality.classify(docs, quality.train(docs, labels)).collect()}) == 1
    found = langid.identify(docs, langid.train(docs)).collect()
    assert {r.lang_pred for r in found} == {"aa"} and len(found) == 7
    assert len({round(r.score, 3) for r in lm.score_documents(docs, F.lit(True)).collect()}) == 1


def test_each_language_is_learned(spark):
    rows = [(None, f"aaa{k} bbb ccc{k % 7}", "aa") for k in range(3000)] + [(k, "ddd eee fff", "bb") for k in range(3)] + [(None, "ggg", f"l{k}") for k in range(30)]
    assert len(langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=50)["languages"]) == 32


def spark_hash(*values) -> int:
    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
            h = xxhash.xxh64_intdigest(data, seed=h)
    return h - (1 << 64) if h >> 63 else h


def test_sharding_is_as_written(spark):
    """Shards, buckets, order and slots from the law, in plain Python; and very many equal rows in lots."""
    rng = random.Random(5)
    rows = [(i if i % 9 else None, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(40)))) for i in range(400)] + [(7, "again")] * 5 + [(8, None)]
    size = 1500
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.shard, r.slot, r.doc_id, r.text, r.grown_shard) for r in sharding.shard_documents(frame, bucket_bytes=size).collect())
    best = lambda i, n: max((spark_hash((sharding.SEED,), i, (s,)), s) for s in range(n))[1]
    need = collections.Counter()
    for i, t in rows:
        need[best(i, 8)] += len((t or "").encode()) + 64
    want, buckets = [], collections.defaultdict(list)
    for i, t in rows:
        s = best(i, 8)
        buckets[s, spark_hash((sharding.SEED + 1,), i, t, 0) % max(1, -(-need[s] // size))].append((i, t))
    slot = collections.Counter()
    for (s, b), mine in sorted(buckets.items()):
        mine.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or ""))
        for k in sharding.fisher_yates(len(mine), [sharding.SEED, s, b]):
            want.append((s, slot[s], *mine[k], best(mine[k][0], 9)))
            slot[s] += 1
    key = lambda r: (r[0], r[1], str(r[2:]))
    assert sorted(got, key=key) == sorted(want, key=key)
    equal = spark.createDataFrame([(1, "hot")] * 500 + [(k, "t") for k in range(20)], "doc_id long, text string")
    dealt = sharding.shard_documents(equal, bucket_bytes=2000, repeats=10)
    assert dealt.count() == 520 and dealt.groupBy("shard").agg((F.max("slot") + 1 - F.count("slot")).alias("x")).where("x <> 0").count() == 0
    assert sorted(map(str, dealt.collect())) == sorted(map(str, sharding.shard_documents(equal.repartition(5), bucket_bytes=2000, repeats=10).collect()))


def test_decontamination_against_all_runs(spark):
    rng = random.Random(21)
    items = [(k, " ".join(f"b{rng.randrange(300)}" for _ in range(n))) for k, n in enumerate((1, 2, 4, 5, 7, 10, 15, 20, 30, 40))] + [(None, "lone words of an item without id")]
    docs = []
    for i in range(120):
        w = items[rng.randrange(len(items))][1].split()
        for _ in range(rng.randint(0, max(0, int(0.25 * len(w))))):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = [f"q{rng.randrange(99)}"] * rng.randint(0, 1)
        docs.append((i, " ".join([*[f"c{rng.randrange(900)}" for _ in range(rng.randrange(60))], *w, *[f"c{rng.randrange(900)}" for _ in range(rng.randrange(60))]])))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edit_distance for r in decontam.find_contamination(frame, bench).collect()}
    want = {}
    for (i, t), (k, item) in itertools.product(docs, items):
        a, b = decontam.words_of(pa.array([item]))[0], decontam.words_of(pa.array([t]))[0]
        d = decontam.best_run(a, b)[0]
        if d <= decontam.edits(len(a)):
            want[i, k] = d
    assert got.items() <= want.items() and len(got) >= 0.97 * len(want) > 50
    assert {k for k, v in want.items() if v == 0} <= set(got)
    assert {r.doc_id for r in decontam.decontaminate(frame, bench).collect()} == {i for i, _ in docs} - {i for i, _ in got}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(33)
    words = [f"w{k}" for k in range(3000)]
    prose = lambda n: " ".join(rng.choices(words, k=n)) + "."
    docs = [(i, prose(rng.randint(30, 120)), "en", "abc"[i % 3], 0) for i in range(240)]
    bad = [(300 + i, "BUY NOW!!! $$$ " * rng.randint(10, 40), "en", "abc"[i % 3], 0) for i in range(60)]
    near = [(400 + i, docs[i][1].rsplit(" ", 1)[0] + " other", "en", "a", 0) for i in range(0, 40, 2)] + [(500, docs[0][1], "en", "b", 0)]
    items = [(k, prose(25)) for k in range(5)]
    leaks = [(600 + k, prose(30) + " " + t + " " + prose(30), "en", "c", 0) for k, t in items]
    rows = docs + bad + near + leaks + [(700, None, "en", None, 0), (701, "", "en", "a", 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    write = lambda x, kind, name: spark.createDataFrame(x, kind).write.parquet(f"{path}/{name}.parquet")
    write(rows, "doc_id long, text string, lang string, source string, n_chars int", "documents")
    write([(r[0], int(not 300 <= r[0] < 400), 0) for r in rows if r[0] < 700], "doc_id long, quality int, toxic int", "labels")
    write(items, "item_id long, text string", "benchmark")
    return path, {r[0]: r for r in rows}, items


def test_pipeline_stage_by_stage(spark, corpus):
    """Every stage against plain Python on what its predecessor kept."""
    path, rows, items = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_classifier", "minhash_near_dedup", "decontamination", "mixing", "sharding"]
    good = stage["quality_classifier"](spark, docs, path)
    kept = {r.doc_id: r for r in good.collect()}
    assert good.columns == docs.columns and {i for i in rows if not 300 <= i < 400 and i < 700} <= set(kept) and not any(300 <= i < 400 for i in kept)

    good = spark.createDataFrame([tuple(r) for r in kept.values()], docs.schema)
    one = stage["minhash_near_dedup"](spark, good, path)
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if (w := WORD.findall((r.text or "").lower())) else frozenset() for i, r in kept.items()}
    gone = {max(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    left = sorted(r.doc_id for r in one.collect())
    assert one.columns == docs.columns and left == sorted(set(kept) - gone) and gone

    one = spark.createDataFrame([tuple(kept[i]) for i in left], docs.schema)
    clean = stage["decontamination"](spark, one, path)
    leaked = set()
    for i in left:
        b = decontam.words_of(pa.array([kept[i].text], pa.string()))[0]
        for _, item in items:
            a = decontam.words_of(pa.array([item]))[0]
            if len(b) and decontam.best_run(a, b)[0] <= decontam.edits(len(a)):
                leaked.add(i)
    stay = sorted(r.doc_id for r in clean.collect())
    assert clean.columns == docs.columns and stay == sorted(set(left) - leaked) and leaked >= {600, 601, 602, 603, 604}

    clean = spark.createDataFrame([tuple(kept[i]) for i in stay], docs.schema)
    mixed = stage["mixing"](spark, clean, path)
    taken = collections.Counter(r.doc_id for r in mixed.collect())
    law = {r.doc_id: r.copies for r in mixing.mix_sources(clean).collect()}
    assert mixed.columns == docs.columns and dict(taken) == {i: c for i, c in law.items() if c}

    out = corpus_pipeline.run(spark, path)
    found = out.collect()
    assert collections.Counter(r.doc_id for r in found) == taken
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert r.text == rows[r.doc_id][1]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_media_digests_and_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abc" * 50), (2, None), (None, "ü" * 70), (2, "again")], "doc_id long, text string")
    stored = media.written(media.store(docs), "media")
    by = {bytes(s.media): s for s in stored.collect()}
    for r in media.read(stored).collect():
        blob = next(b for b in by if hashlib.sha256(b).hexdigest() == r.media_sha256)
        image = media.decode(blob)
        tile = np.load(io.BytesIO(bytes(r.tile)))
        assert hashlib.sha256(image.tobytes()).hexdigest() == r.payload_sha256 and (tile == media.area_resize(image)).all()
        bits = "".join("1" if tile[y, x + 1] > tile[y, x] else "0" for y in range(8) for x in range(8))
        assert r.dhash == f"{int(bits, 2):016x}"
    assert len(media.export(stored, str(tmp_path), "media", "img")) == 4 == len(list(tmp_path.iterdir()))
