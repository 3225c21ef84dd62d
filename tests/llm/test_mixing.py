import hashlib
import math
import re

from pyspark.sql import functions as F

from ploidyne.llm import mixing

KIND = "doc_id long, text string, source string"


def reshare(sizes: dict) -> dict:
    """Targets by sharing again and again, as the law is worded."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        add = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += add[s]
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def test_targets_and_taken_words(spark):
    texts = [(i, "w " * (1 + i * 7 % 40), ["a", "b", "c", "d", "e", None][min(5, i % 11)]) for i in range(400)]
    texts += [(1000, None, "a"), (1001, "", None), (5, "w " * 3, "b"), (5, "w " * 3, "b"), (None, "x y z", "c")]
    got = mixing.mix_sources(spark.createDataFrame(texts, KIND), bucket_rows=20).collect()
    assert len(got) == len(texts)
    sizes: dict = {}
    for _, t, s in texts:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = reshare(sizes)
    taken: dict = {}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 40, s
    again = mixing.mix_sources(spark.createDataFrame(texts[::-1], KIND), bucket_rows=5).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.repeat_rows(mixing.mix_sources(spark.createDataFrame(texts, KIND))).count() == sum(r.copies for r in got if r.copies)


def test_empty(spark):
    assert mixing.mix_sources(spark.createDataFrame([], KIND)).count() == 0


def test_equal_rows_across_a_boundary_and_odd_weights(spark):
    rows = [(1, "a b c", "s")] * 700 + [(2, "d e", "s"), (3, "f", "t"), (4, "g h i j", "u")] + [(k, f"x{k} y", "t") for k in range(10, 60)]
    frame = spark.createDataFrame(rows, KIND).repartition(7)
    got = mixing.mix_sources(frame, bucket_rows=10).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, taken = reshare(sizes), {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 4 for s in sizes)
    assert len({r.copies for r in got if r.doc_id == 1}) == 2
    again = mixing.mix_sources(frame.repartition(3), bucket_rows=10).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    for w in (F.lit(1e6), F.lit(None).cast("double"), F.when(F.col("doc_id") == 1, 1e-6).otherwise(F.lit(50.0)), F.lit(0)):
        taken = {}
        for r in mixing.mix_sources(frame, weight=w, bucket_rows=10).collect():
            taken[r.source] = taken.get(r.source, 0) + r.taken
        assert all(abs(taken[s] - want[s]) <= 4 for s in sizes)


def test_all_documents_by_hand(spark):
    """Against plain Python: the same keys, sorted."""
    rows = [(k, " ".join(["w"] * (k % 9)) + "|" * (k % 3), "ab"[k % 2]) for k in range(300)]
    frame = spark.createDataFrame(rows, KIND)
    got = {r.doc_id: r.copies for r in mixing.mix_sources(frame, bucket_rows=3).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    want = reshare({s: sum(size[i] for i, _, x in rows if x == s) for s in "ab"})
    for s in "ab":
        mine = []
        for i, t, x in rows:
            if x == s:
                u = (int(hashlib.md5(f"mix-1:{i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                q = max(0.05, sum(c not in mixing.NOISE for c in t) / len(t)) if t else 1.0
                mine.append((-math.log(u) / q, i))
        total = sum(size[i] for _, i in mine)
        epochs, before = int(want[s] // total), 0
        for _, i in sorted(mine):
            one = size[i] > 0 and before + size[i] / 2 <= want[s] - epochs * total
            before += size[i]
            assert got[i] == epochs + one
