"""Operators that decide about documents, against brute force on awkward rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from data import Groups, documents, frame, shingles, words
from pyspark.sql import functions as F

from citelake.llm.bitmap import bitmap_of, possible, without_ids
from citelake.llm.components import connected_components
from citelake.llm.exact_dedup import drop_exact_copies, exact_dedup
from citelake.llm.mixing import curriculum, mix_report, plan_mix, position, source_targets
from citelake.llm.near_dedup import band_keys, drop_near_copies, near_duplicates, sketch
from citelake.llm.scratch import Scratch
from citelake.llm.sharding import shard_records, write_shards


def test_bitmap_never_loses_a_key(spark):
    keys, rows = spark.range(0, 3000, 7).toDF("k"), spark.range(3000).toDF("v")
    hit = {r["v"] for r in possible(rows, F.col("v"), bitmap_of(keys, F.col("k"), 1 << 16), 1 << 16).collect()}
    assert set(range(0, 3000, 7)) <= hit and len(hit) < 600
    assert without_ids(rows, keys, "v", 64).count() == 3000 - 429  # a full bitmap is still exact


def test_components(spark):
    edges = [(n, n + 1) for n in range(50)] + [(100, 101), (102, 101), (7, 7)] + [(200, 201 + n) for n in range(30)]
    groups = Groups({x for e in edges for x in e})
    for a, b in edges:
        groups.join(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c")
    assert {r["node"]: r["component"] for r in got.collect()} == {x: groups.find(x) for x in groups.up if groups.find(x) != x}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "e").count() == 0


def test_exact_dedup(spark):
    rows = documents()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = Counter()
    for r in rows:
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        want[(r[0], keep, len(ids), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, exact_dedup(frame(spark)).collect())) == want
    assert Counter(map(tuple, exact_dedup(frame(spark), filter_bits=64).collect())) == want
    left = drop_exact_copies(frame(spark))
    assert left.columns == frame(spark).columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter({(max((i for i in ids if i is not None), default=None), t): 1 for t, ids in groups.items() if t}) + Counter([(86, "")])
    assert exact_dedup(frame(spark, [])).count() == drop_exact_copies(frame(spark, [])).count() == 0


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup(spark, k):
    rows = documents()
    sets = {r[0]: shingles(r[1], k) for r in rows if r[0] is not None}
    groups = Groups(sets)
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            groups.join(a, b)
    got = near_duplicates(frame(spark), shingle=k).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert (r["component_id"], r["kept"]) == (None, True)
        else:
            head = groups.find(r["doc_id"])
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), head, head == r["doc_id"]), r
    left = drop_near_copies(frame(spark), shingle=k)
    assert left.columns == frame(spark).columns
    assert sorted(r["doc_id"] for r in left.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()) == sorted(i for i in sets if groups.find(i) == i)
    assert near_duplicates(frame(spark, [])).count() == 0


def test_groups_that_leaders_do_not_connect(spark):
    """Variants of a text, most of them too far from each other, and a chain whose ends do not link."""
    import random

    rng = random.Random(3)
    base = [f"w{n}" for n in range(150)]
    texts = {}
    for doc in range(80):
        own = base[:]
        for place in rng.sample(range(150), rng.choice([2, 6, 10, 16, 25])):
            own[place] = f"e{rng.randrange(40)}" if doc % 2 else f"u{doc}-{place}"
        texts[doc] = " ".join(own)
    sets = {d: shingles(t, 2) for d, t in texts.items()}
    groups = Groups(sets)
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            groups.join(a, b)
    got = near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shingle=2)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {d: groups.find(d) for d in sets}


def test_a_second_family_under_one_leader(spark, monkeypatch):
    """Variants of a text and of another that is far from it but shares buckets: candidates stay linear in their number."""
    import random

    from citelake.llm import near_dedup as module

    rng = random.Random(9)
    base = [f"w{n}" for n in range(400)]
    second = [w if n % 400 < 330 else f"v{n}" for n, w in enumerate(base)]
    asked = {}

    def run(n):
        texts = []
        for k in range(40 + n):
            own = list(base if k < 40 else second)
            own[rng.randrange(400)] = f"x{k}"
            texts.append((k, " ".join(own)))
        seen = []
        plain = module._links
        monkeypatch.setattr(module, "_links", lambda pairs, sets, percent: (seen.append(pairs.count()), plain(pairs, sets, percent))[1])
        got = {r["doc_id"]: r["component_id"] for r in module.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), shingle=2).collect()}
        monkeypatch.setattr(module, "_links", plain)
        asked[n] = sum(seen)
        sets = {d: shingles(t, 2) for d, t in texts}
        groups = Groups(sets)
        for a, b in combinations(sets, 2):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                groups.join(a, b)
        assert got == {d: groups.find(d) for d in sets} and len(set(got.values())) == 2

    for n in (40, 120):
        run(n)
    assert asked[120] / 160 < 2 * max(1, asked[40] / 80)


def test_sketches_fill_every_coordinate_and_agree_with_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    one, two = (np.concatenate([common, rng.integers(0, 1 << 63, 100, dtype=np.uint64)]) for _ in range(2))
    tiny = common[:1]
    values = np.concatenate([one, two, tiny])
    found = sketch(values, np.array([0, 900, 1800, 1801]), 400)
    assert (found != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((found[0] == found[1]).mean() - 0.8) < 0.08
    assert band_keys(found, 80, 5).shape == (3, 80)


def test_mixing_targets_and_taken(spark):
    rows = documents()
    sizes, total = Counter(), 0
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    total = sum(sizes.values())
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * total
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= full
    target |= {s: level * weight[s] for s in free}
    got = plan_mix(frame(spark)).collect()
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order) and len(got) == len(rows)
    again = sorted(map(str, mix_report(frame(spark)).collect()))
    assert again == sorted(map(str, mix_report(frame(spark).repartition(7)).collect()))
    positions = [r["first_position"] for r in mix_report(frame(spark)).collect() if r["first_position"] is not None]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    assert plan_mix(frame(spark, [])).count() == mix_report(frame(spark, [])).count() == 0


def test_schedules_invert_their_integral(spark):
    knots = ((0.0, 1.0), (0.25, 4.0), (1.0, 0.5))
    shares = spark.range(101).select((F.col("id") / 100).alias("s"))
    for r in shares.select("s", position(F.col("s"), F.lit(0), [knots]).alias("t")).collect():
        done = whole = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            whole += (t1 - t0) * (w0 + w1) / 2
            upto = min(max(r["t"], t0), t1)
            done += (upto - t0) * (w0 + w0 + (w1 - w0) * (upto - t0) / (t1 - t0)) / 2
        assert done / whole == pytest.approx(r["s"], abs=1e-9)


def test_water_level_with_empty_sources(spark):
    sizes = spark.createDataFrame([("a", 0), ("b", 10), ("c", 1000)], "source string, source_size long")
    assert {r["source"]: r["target"] for r in source_targets(sizes).collect()} == {"a": 0.0, "b": 20.0, "c": 1495.0}


def test_curriculum_rows(spark):
    got = curriculum(frame(spark), position_col="_at")
    copies = Counter()
    for r in plan_mix(frame(spark)).collect():
        copies[r["doc_id"]] += sum(r["start"] + k * r["source_size"] < int(r["target"]) for k in range(2)) if r["taken"] else 0
    assert Counter(r["doc_id"] for r in got.collect()) == +copies
    at = [r["_at"] for r in got.collect()]
    assert at == sorted(at) and curriculum(frame(spark)).columns == frame(spark).columns


def test_curriculum_with_one_id_in_two_sources_and_repeated_rows(spark):
    rows = [(1, "a b c d", "s1", 1), (1, "a b c d", "s2", 2), *[(2, "e f g", "s2", 3)] * 5, (None, "h i", "s1", 4), (None, "j k", "s1", 5), (None, "j k", None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    plan = plan_mix(docs).collect()
    want = Counter()
    for r in plan:
        want[(r["doc_id"], r["source"], r["size"])] += sum(r["start"] + k * r["source_size"] < int(r["target"]) for k in range(2)) if r["taken"] else 0
    got = [tuple(r) for r in curriculum(docs, position_col="at").collect()]
    assert Counter((r[0], r[2], len(r[1].split())) for r in got) == +want
    assert got == [tuple(r) for r in curriculum(docs.repartition(5), position_col="at").collect()]
    by_source = Counter()
    for r in plan:
        by_source[r["source"]] += r["taken"]
    assert all(by_source[r["source"]] == int(r["target"]) for r in plan) and len(plan) == len(rows)


def test_shards(spark, tmp_path):
    rows = documents()
    got = shard_records(frame(spark)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    fewer = {(r["doc_id"], r["text_crc32"]): r["grown_shard"] for r in shard_records(frame(spark), (1.0,) * 15).collect()}
    assert all(fewer[(r["doc_id"], r["text_crc32"])] == r["shard"] for r in got)
    heavy = Counter(r["shard"] for r in shard_records(spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text"), (1.0, 3.0)).collect())
    assert 0.72 < heavy[1] / 20_000 < 0.78
    write_shards(frame(spark), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
    assert shard_records(frame(spark, [])).count() == 0
