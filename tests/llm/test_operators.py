"""Each operator against brute force, with nulls, empty and repeated rows and clashing columns."""

import collections
import itertools
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ploidyne.llm import decontam, langid, lm, media, minhash, quality, sharding, urlfilter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, prose(rng, rng.randint(1, 120))) for i in range(60)]
    for i in range(20):  # near copies of two texts, and exact ones
        words = prose(random.Random(99 + i % 2), 100).split()
        words[rng.randrange(100)] = f"x{i}"
        out.append((100 + i, " ".join(words)))
    return [*out, (200, out[0][1]), (201, out[0][1].upper()), (202, None), (203, ""), (204, " \t\n"), (205, "a b"), (206, "A  b"), (None, "null id"), (207, "é ü"), (7, out[7][1]), (208, prose(rng, 9000))]


def test_minhash_matches_all_pairs(spark, rows):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.minhash_classes(spark.createDataFrame(rows, DOCS)).collect())
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        low.setdefault(find(k), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in low.items()}
    want = sorted((str(i), len(s), str(least[find(k)]), i is not None and i == least[find(k)]) for k, (i, s) in enumerate(sets))
    assert got == want


def test_minhash_long_lists_in_blocks():
    ids = [bytes([i]) for i in range(6)]
    base = np.arange(100, dtype=np.int64)
    parts = [base, base + 5, base + 10, base + 500, base + 505, base + 2000]
    found = minhash.block_links(ids, parts, ids, 85)
    parent = {i: i for i in ids}
    for a, b in found:
        for k, v in list(parent.items()):
            if v == parent[a]:
                parent[k] = parent[b]
    assert parent[ids[0]] == parent[ids[1]] == parent[ids[2]] and parent[ids[3]] == parent[ids[4]] != parent[ids[5]]
    assert len(found) == 3


def test_near_dedup_keeps_one_and_all_columns(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], DOCS + ", n_shingles int, cid string")
    kept = minhash.near_dedup(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 0 in ids and 200 not in ids and 201 not in ids and ids.count(7) == 1 and {202, 203, 204} <= set(ids) and None in ids
    assert len([i for i in ids if i is not None and 100 <= i < 120]) == 2


def test_sharding(spark, rows):
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], DOCS + ", shard int")
    got = sharding.shard_documents(docs, bucket_bytes=3000).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(map(str, rows))
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8
    again = sharding.shard_documents(docs.repartition(3), bucket_bytes=3000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted(sharding.fisher_yates(50, [1])) == list(range(50)) and list(sharding.fisher_yates(0, [1])) == []
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_url_filter(spark):
    urls = ["http://a.b.com/x", "https://EXAMPLE.com/en/1?q", "http://www.example.com/en/", "http://m.www.example.com/en/5#t", "http://x.net/es/", "http://net/fr/2", "http://x.org/", "http://example.org/en/14", "http://m.example.org/en/14/", "http://example.org/en/15", None, "no scheme", "http://", "http://notexample.com/en/", "http://xcom/", "http://x.net/es"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)] + [(0, urls[0], "old")], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, urlfilter.RULES, urlfilter.production_list(spark)).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(LOWER)
        fit = [(r, v) for v, r in urlfilter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule, verdict = max(fit, key=lambda x: len(x[0])) if fit else (None, "block" if i == 7 else "allow")
        assert got[i] == (host, path, rule, verdict), u
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom, blocks = urlfilter.bloom_filter(keys, 5000)
    assert urlfilter.possible(keys, bloom, blocks).count() == 5000
    assert urlfilter.possible(spark.range(5000, 25000).select(F.concat(F.lit("k"), "id").alias("key")), bloom, blocks).count() < 400
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0


def test_url_filter_without_a_path(spark):
    rules = (("allow", "com/"), ("block", "b.com/"), ("block", "c.com/x"))
    urls = ["http://shop.com", "http://shop.com?x=1", "http://shop.com#a", "http://shop.com/", "http://shop.com//", "http://b.com", "http://b.com/", "http://a.b.com?q", "http://c.com", "http://c.com/x", "http://listed.com", "http://com", "http://com/", "http://listed.org?x", "http://listed.org//", "http://sub.listed.org/"]
    listed = spark.createDataFrame([("http://listed.com/",), ("http://com",), ("http://listed.org",)], "url string")
    got = {r.url: (r.rule, r.verdict) for r in urlfilter.judge_urls(spark.createDataFrame([(u,) for u in urls], "url string"), rules, listed).collect()}
    whole = {"listed.com", "com", "listed.org"}
    for u in urls:
        host, path = re.fullmatch(r"http://([^/?#]*)([^?#]*).*", u).groups()
        fits = [(len(r), r, v) for v, r in rules for h, p in [r.split("/", 1)] if ("." + host).endswith("." + h) and path.startswith("/" + p)]
        want = max(fits)[1:] if fits else (None, "block" if path.rstrip("/") == "" and host in whole else "allow")
        assert got[u] == want, u


def test_media_round_trip(spark, rows):
    got = {r.doc_id: r for r in media.read(media.store(spark.createDataFrame(rows, DOCS))).collect()}
    stored = {r.doc_id: bytes(r.media) for r in media.store(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert media.decode(stored[i]).tobytes() == padded
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].tail_crc32, got[i].media_bytes) == (len(raw), len(padded), zlib.crc32(padded[-64:]), len(stored[i]))
    image = np.random.default_rng(1).integers(0, 256, (16, 27)).astype(np.uint8)
    assert (media.area_resize(image, (8, 9)) == np.rint(image.reshape(8, 2, 9, 3).mean((1, 3)))).all()
    fine = np.kron(image, np.ones((8, 9)))
    assert (media.area_resize(image, (8, 9)) == np.clip(np.rint(fine.reshape(8, 16, 9, 27).mean((1, 3))), 0, 255)).all()
    colour = np.arange(30, dtype=np.uint8).reshape(2, 5, 3)
    assert (media.decode(b"P6\n# c\n5 2\n255\n" + colour.tobytes()) == colour).all()
    for bad in (b"", b"P5\n9 9\n255\n1", b"GIF"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_quality_ranks_held_out_labels(spark):
    rng = random.Random(1)
    docs = [(i, prose(rng, 80) if i % 3 else " | ".join(prose(rng, 80).upper().split())) for i in range(300)] + [(900, None), (901, ""), (5, "")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(1, None), (None, 1)], "doc_id long, quality int")
    frame = spark.createDataFrame([(i, t, "old") for i, t in docs], DOCS + ", score string")
    model = quality.train(frame, labels)
    got = {(r.doc_id, r.text): r.score for r in quality.classify(frame, model).collect()}
    held = [(i, t) for i, t in docs[:300] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i, t] >= 0.5) == (i % 3 > 0) for i, t in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values())
    assert quality.train(frame, labels.limit(0))["w"].sum() == 0


def test_langid_held_out(spark):
    words = {"aa": ["the", "and", "thing", "with"], "bb": ["und", "der", "schön", "nicht"], "cc": ["que", "los", "niño", "para"]}
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(words[k], k=30)), k) for i in range(150) for k in [sorted(words)[i % 3]]] + [(900, None, "aa"), (901, "12 !!", "bb"), (902, "the and", None)]
    frame = spark.createDataFrame(docs, DOCS + ", lang string")
    model = langid.train(frame.where(~quality.held_out(5, 0)), rows=100)
    got = {r.doc_id: r for r in langid.identify(frame, model).collect()}
    assert all(got[i].lang_pred == k for i, _, k in docs[:150]) and got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    assert {r.lang_pred for r in langid.identify(frame, langid.train(frame.limit(0))).collect()} == {"und"}


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 1500
    pages = [(1, "http://a/", big), (2, None, big), (3, "u\r\nv", big), (3, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", "n"), (7, "u", big + "é")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    archives = warc.write_archives(frame, archive_bytes=600)
    got = warc.read_archives(archives).collect()
    assert len(got) == len(pages) and not any(r.error for r in got)
    by = collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert by[1, "revisit", 3, 1500] == by[2, "revisit", 3, 1500] == 1 and by[3, "response", None, 1500] == 2 and by[6, "response", None, 0] == 1 and by[7, "response", None, 1502] == 1
    warc.export(archives, str(tmp_path))
    assert warc.read_files(spark, f"{tmp_path}/*.warc.zst").count() == len(pages)
    data = bytearray(archives.first().data)
    assert any(r["error"] for r in warc.read_archive("cut", bytes(data[:-9])))
    assert warc.write_archives(frame.limit(0)).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_best_run_is_the_least_over_all_runs():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 7)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 10)).astype(np.uint64)
        want = min(edit_distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert decontam.best_run(a, b)[0] == want


def test_decontamination_recall(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randint(14, 50), 4000)) for i in range(30)] + [(98, None), (99, "")]
    docs, want = [(5000, None), (5001, ""), (5002, prose(rng, 300, 4000))], set()
    for i in range(200):
        item = rng.randrange(30)
        words = items[item][1].split()
        edits = rng.randint(0, int(0.2 * len(words)))
        for k in rng.sample(range(len(words)), edits):
            words[k] = f"zz{k}"
        docs.append((i, f"{prose(rng, 40, 4000)} {' '.join(words).upper()}, {prose(rng, 40, 4000)}"))
        want.add((i, item, edits))
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edit_distance for r in decontam.find_contamination(frame, bench).collect()}
    assert {(i, k) for i, k, e in want if e == 0} <= set(got)
    assert len({(i, k) for i, k, _ in want} & set(got)) >= 0.9 * len(want)
    assert all(got[i, k] <= e for i, k, e in want if (i, k) in got) and all(i < 200 for i, _ in got)
    assert set(got) == {(r.doc_id, r.item_id) for r in decontam.find_contamination(frame, bench, item_words=300).collect()}
    assert {5000, 5001, 5002} <= {r.doc_id for r in decontam.decontaminate(frame, bench).collect()}


def test_lm_scores(spark, rows):
    frame = spark.createDataFrame(rows, DOCS)
    got = lm.score_documents(frame, ~quality.held_out(5, 1), model_words=50).collect()
    tokens = [WORD.findall((t or "").translate(LOWER)) + [None] for _, t in rows]
    c = collections.Counter()
    for (i, _), w in zip(rows, tokens, strict=True):
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(w)
    n, v = sum(c.values()), len(c)
    want = sorted((len(w), sum(c[x] > 0 for x in w), round(sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)) for w in tokens)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and r.train_tokens == n for r in got)


def test_lm_probabilities_sum_to_one():
    v = lm.Vocabulary([], 3, {0: (5, 2)}, 8, 3)
    p = lm.initial(v)
    k = np.arange(v.size)
    assert abs(np.exp(lm.log_probabilities(p, k, np.full(v.size, 2, np.uint16), np.full(v.size, v.start, np.uint16))).sum() - 1) < 1e-5


def test_lm_trains_on_every_position(spark):
    # five positions a text: whatever is learned of any but the first comes from the positions between
    docs = spark.createDataFrame([(i, "aa bb cc dd") for i in range(4000)], DOCS).coalesce(1)
    v = lm.vocabulary(lm.word_counts(docs), 4)
    p = lm.train(docs, v)
    t, one, two, _, _ = v.sequence(*lm.tokens(pa.array(["aa bb cc dd"])))
    assert np.exp(lm.log_probabilities(p, t, one, two)).min() > 0.5


def test_lm_words_of_the_tail_have_vectors_of_their_own(spark):
    # aazz and bbzz share a tail class and are as frequent; only what comes before tells them apart
    train = spark.createDataFrame([(i, "pp aazz" if i % 2 else "qq bbzz") for i in range(20000)] + [(20000, "pp qq")], DOCS)
    asked = [(0, "pp aazz"), (1, "pp bbzz"), (2, "qq aazz"), (3, "qq bbzz")]
    scored = lm.score_documents(spark.createDataFrame(asked, DOCS), train, model_words=2)
    got = {r.doc_id: r.score for r in scored.collect()}
    assert len(got) == 4 and got[0] > got[1] + 0.1 and got[3] > got[2] + 0.1


def test_lm_tail_class_sums_to_one_and_classes_grow(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(f"{rng.randrange(10**6)}" for _ in range(1500))) for i in range(60)], DOCS)
    counts = lm.word_counts(docs).cache()
    v = lm.vocabulary(counts, 20)
    assert v.split == round((counts.where("tail >= 0").count() - 20) ** 0.5 / lm.TAIL) > 1
    head = {int(w) for w in v.words.view(np.int64)}
    words = [r for r in counts.where("tail >= 0").withColumn("grp", lm.group_column(v.split)).collect() if r.word not in head]
    assert [r.grp for r in words] == v.group(np.array([r.word for r in words], np.int64).view(np.uint64), np.array([r.tail for r in words])).tolist()
    assert v.tail_counts.tolist() == [sum(c) for c in ([r.c for r in words if r.grp == g] for g in range(v.groups))]
    p = lm.train(docs, v)
    mine = sorted((r.word % 2**64, r.c) for r in words if r.grp == 3)
    word, c = np.array([w for w, _ in mine], np.uint64), np.array([n for _, n in mine], np.float64)
    asked = np.append(word, np.uint64(5))  # 5 stands for a word that wasn't seen
    learn = np.repeat(word, c.astype(int))
    code = np.concatenate([np.random.default_rng(1).integers(0, v.start, (2, len(learn))), np.tile([[4], [7]], (1, len(asked)))], 1).astype(np.uint16)
    share, counted = lm.score_class(word, c, (np.concatenate([learn, asked]), code), len(learn), p)
    assert abs((10 ** share[len(learn) :]).sum() - 1) < 1e-4 and counted[len(learn) :].tolist() == [*c, 0]
    first, lanes = lm.groups_of(v, 500)
    assert lanes.tolist() == [max(1, -(-int(n) // 500)) for n in v.tail_counts]
    load = collections.Counter()
    for f, n, k in zip(first.tolist(), lanes.tolist(), v.tail_counts, strict=True):
        for lane in range(n):
            load[f + lane] += k / n
    assert max(load.values()) <= 500 and sorted(load) == list(range(max(load) + 1))


def test_lm_score_against_plain_python(spark, rows, monkeypatch):
    """The score of each text from the trained parameters, token by token; lots and groups are small, and the layout of the rows doesn't matter."""
    monkeypatch.setattr(lm, "LOT", 300)
    monkeypatch.setattr(lm, "SHARD", 2000)
    named = [(i, t) for i, t in rows if i is not None and i != 208]
    frame = spark.createDataFrame(named, DOCS)
    learn = ~quality.held_out(5, 1)
    got = {r.doc_id: r.score for r in lm.score_documents(frame.coalesce(1), learn, model_words=30).collect()}
    again = {r.doc_id: r.score for r in lm.score_documents(frame.repartition(9), learn, model_words=30).collect()}
    assert got.keys() == again.keys() and max(abs(got[i] - again[i]) for i in got) < 1e-4
    counts = lm.word_counts(frame.where(learn)).collect()
    v = lm.vocabulary(lm.word_counts(frame.where(learn)), 30)
    p = lm.train(frame.where(learn).select("doc_id", "text"), v)
    known: dict = collections.defaultdict(list)
    for r in counts:
        if r.tail >= 0 and np.uint64(r.word % 2**64) not in v.words:
            known[int(v.group(np.array([r.word % 2**64], np.uint64), np.array([r.tail]))[0])].append((r.word % 2**64, r.c))
    spots: dict = collections.defaultdict(list)
    plain = collections.Counter()
    for i, t in named:
        h, tail, offsets = lm.tokens(pa.array([t], pa.string()))
        target, one, two, _, head = v.sequence(h, tail, offsets)
        for k, (c, a, b) in enumerate(zip(target, one, two, strict=True)):
            ctx = p["q"][a] * p["c"][0] + p["q"][b] * p["c"][1]
            z = p["r"][:, :-1].astype(float) @ ctx + p["r"][:, -1]
            plain[i] += (z[c] - np.log(np.exp(z).sum())) / np.log(10)
            if k < len(h) and not head[k]:
                spots[int(c) - 1 - len(v.words)].append((zlib.crc32(str(i).encode()) % 5 != 1, int(h[k]), int(a), int(b), i))
    for k, mine in spots.items():
        mine.sort(key=lambda x: not x[0])
        words = sorted(known[k])
        share, _ = lm.score_class(np.array([w for w, _ in words], np.uint64), np.array([c for _, c in words], float), (np.array([x[1] for x in mine], np.uint64), np.array([x[2:4] for x in mine], np.uint16).T), sum(x[0] for x in mine), p)
        for x, s in zip(mine, share, strict=True):
            plain[x[4]] += s
    times = collections.Counter(i for i, _ in named)  # one row is there twice
    assert max(abs(got[i] - plain[i] / times[i]) / (1 + abs(got[i])) for i in got) < 1e-4


def test_kernel_tells_words_apart():
    from ploidyne.llm import textkernel as tk

    texts = ["a b\tc", None, "", "ab c", "B a", "x" * 3000]
    w = tk.Words(*tk.buffers(pa.array(texts)))
    assert list(np.diff(w.offsets)) == [3, 0, 0, 2, 2, 1] and w.hashes[0] == w.hashes[6] and len(set(w.hashes.tolist())) == 5


def test_minhash_tells_texts_with_one_doc_id_apart(spark):
    base = [f"w{k}" for k in range(200)]
    near = [*base[:-1], "other"]
    far = [f"v{k}" for k in range(200)]
    docs = [(None, " ".join(far)), (None, " ".join(base)), (7, " ".join(near)), (7, " ".join(far[::-1]))]
    got = minhash.minhash_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.component_id is None, r.component_id) for r in got if r.doc_id is None) == [(False, 7), (True, None)]
    assert [r.component_id for r in got if r.doc_id == 7] == [7, 7]


def test_near_dedup_decides_by_row_not_by_doc_id(spark):
    a, b = ([f"{x}{k}" for k in range(100)] for x in "ab")
    near = lambda w: " ".join([*w[:-1], "other"])
    docs = [(3, " ".join(a)), (7, near(a)), (7, " ".join(b)), (9, near(b))]
    kept = minhash.near_dedup(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted(map(tuple, kept)) == [(3, docs[0][1]), (7, docs[2][1])]
    null_ids = [(None, " ".join(a))] * 3 + [(None, near(a)), (None, " ".join(b)), (None, None), (None, "")]
    kept = minhash.near_dedup(spark.createDataFrame(null_ids, DOCS)).collect()
    assert len(kept) == 4 and sum(r.text in (" ".join(a), near(a)) for r in kept) == 1
    named = spark.createDataFrame([(None, " ".join(a)), (5, near(a)), (None, near(b))], DOCS)
    assert sorted(str(r.doc_id) for r in minhash.near_dedup(named).collect()) == ["5", "None"]


def test_minhash_of_very_frequent_pairs(spark, monkeypatch):
    """Long lists, hot tokens and hubs, against all pairs."""
    from ploidyne.operators import plumbing

    monkeypatch.setattr(plumbing, "HOT_ROWS", 5)
    monkeypatch.setattr(minhash, "LIST", 4)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(12)
    base = [[f"{x}{k}" for k in range(60)] for x in "abc"]
    docs = []
    for i in range(150):
        w = list(base[i % 3])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(40)}"
        docs.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in minhash.minhash_classes(spark.createDataFrame(docs, DOCS)).collect()}
    sets = [frozenset(tuple(t.split()[j : j + 5]) for j in range(56)) for _, t in docs]
    parent = list(range(150))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in itertools.combinations(range(150), 2):
        if 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
            u, v = find(x), find(y)
            parent[max(u, v)] = min(u, v)
    assert got == {i: find(i) for i in range(150)}


def test_minhash_compares_members_of_many_lists_once(spark, monkeypatch):
    """Near copies meet in many long lists; rows dealt to blocks don't grow with the number of lists, and no link is lost."""
    rng = np.random.default_rng(12)
    base, docs = [f"w{i}" for i in range(120)], []
    for k in range(150):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 6)), replace=False):
            words[at] = f"x{rng.integers(0, 3)}" if k % 2 else f"y{k}_{at}"
        docs.append((k, " ".join(words)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (d[1].split() for d in docs)]
    component = list(range(150))
    for i, j in itertools.combinations(range(150), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and component[i] != component[j]:
            low, high = sorted((component[i], component[j]))
            component = [low if c == high else c for c in component]
    assert 3 < len(set(component)) < 140
    monkeypatch.setattr(minhash, "LIST", 6)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    dealt, real = [], minhash.join_unskewed

    def spy(rows, summary, *rest):
        out = real(rows, summary, *rest)
        if "ni" in summary.columns:
            dealt.append(out.count())
        return out

    monkeypatch.setattr(minhash, "join_unskewed", spy)
    got = {r.doc_id: r.component_id for r in minhash.minhash_classes(spark.createDataFrame(docs, DOCS), 0.8).collect()}
    assert got == dict(enumerate(component))
    assert sum(dealt) <= 3 * 150


def test_op3_writes_few_files_from_many_partitions(spark):
    """Tables with a bounded number of rows are written in few parts, however many partitions a shuffle has: each file costs a task and processes of the executor."""
    from ploidyne.operators.plumbing import shared_dir

    rng = random.Random(6)
    docs, base = [], prose(random.Random(5), 60).split()
    for i in range(120):
        words = list(base)
        words[rng.randrange(60)] = f"x{i}"
        docs.append((i, " ".join(words) if i % 2 else prose(rng, 40)))
    top = Path(shared_dir(spark).removeprefix("file:"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        before = {*top.rglob("part-*")}
        kept = sorted(r.doc_id for r in minhash.near_dedup(spark.createDataFrame(docs, DOCS)).collect())
        written = len({*top.rglob("part-*")} - before)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {1, 3}.intersection(kept) and len(kept) < 120
    assert written < 500, written


def test_workers_keep_no_freed_memory(spark):
    """A worker that has made features of large batches holds little more afterwards than before."""

    def anon(batches):
        for _ in batches:
            pass
        yield pa.record_batch([pa.array([sum(int(x.split()[1]) for x in Path("/proc/self/smaps_rollup").read_text().splitlines() if x.startswith("Pss_Anon")) // 1024])], names=["mb"])

    held = lambda: max(r.mb for r in spark.range(0, 4, 1, 4).mapInArrow(anon, "mb long").collect())
    texts = spark.range(0, 40_000, 1, 4).select(F.col("id").alias("doc_id"), F.expr("repeat(concat(id, ' '), 2000)").alias("text"))
    minhash.features(texts.limit(1)).collect()
    before = held()
    assert minhash.features(texts).agg(F.sum("n_shingles")).first()[0] == 40_000
    assert held() < before + 8
