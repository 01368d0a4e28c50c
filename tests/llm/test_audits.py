"""Periodic runs, the filter audit and the n-gram join, against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from itertools import combinations, permutations

import numpy as np
import pytest
from data import Groups, documents, frame, shingles, words
from pyspark.sql import functions as F

from citelake.llm import queries
from citelake.llm.filter_audit import audit, replay
from citelake.llm.line_dedup import BANDS, PASSES, group_lines
from citelake.llm.ngram_join import ngram_join, signatures
from citelake.llm.periodic_runs import find_runs, periodic_runs, repeat_tail
from citelake.llm.scratch import Scratch
from citelake.llm.words import mix


def runs_of(found: list, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs, by comparing the words at every distance."""
    out: dict[tuple[int, int], int] = {}
    for p in range(1, len(found) // 2 + 1):
        i = 0
        while i + p < len(found):
            if found[i] != found[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(found) and found[i] == found[i + p]:
                i += 1
            if i + p - start >= max(least, 2 * p):
                out.setdefault((start, i + p), p)
    return sorted(((s, e, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def with_tail(doc_id, found: list[str]) -> list[str]:
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(found)
    if h % 10 or not n:
        return found
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [found[i] if i < a else found[a + (i - a) % p] for i in range(n)]


def texts_of_letters(rng: random.Random) -> list[list[int]]:
    out = []
    for _ in range(rng.randint(1, 6)):
        kinds = rng.choice([1, 2, 2, 3, 5, 20])
        text = [rng.randrange(kinds) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(text))
            text = (text[:at] + text[: rng.randint(0, len(text))] * rng.randint(1, 3) + text[at:])[:150]
        out.append(text)
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 120:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    return [*out, fibonacci[-1], [bin(i).count("1") % 2 for i in range(128)], [7] * 100, []]


@pytest.mark.parametrize("seed", range(40))
def test_all_runs_are_found(seed):
    rng = random.Random(seed)
    texts, least = texts_of_letters(rng), rng.choice([2, 3, 4, 5, 8, 12])
    keys = mix(np.array([x + 1000 * k for k, text in enumerate(texts) for x in text], np.uint64))
    first = np.concatenate([[0], np.cumsum([len(text) for text in texts])]).astype(np.int64)
    want = [(s + f, e + f, p) for text, f in zip(texts, first.tolist(), strict=False) for s, e, p in runs_of(text, least)]
    assert [tuple(r) for r in find_runs(keys, first, least).tolist()] == want


def test_runs_of_documents(spark, tmp_path):
    rows = documents()
    rows += [(200 + k, " ".join(text), "en", "s", None, 1, "x", 2, "y", "b", "k", "z", 3, 4) for k, text in enumerate([["ha"] * 30, "a b c".split() * 9 + ["x"] + "a b c".split() * 9])]
    rows += [(202, "  once\x0bupon a time " * 7, None, None, None, 1, "x", 2, "y", "b", "k", "z", 3, 4)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for doc_id, text, *_ in rows:
        found = with_tail(doc_id, words(text))
        runs = runs_of(found) if len(found) < 20_000 or doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0 else []
        drop = {i for s, e, p in runs for i in range(s + p, e)}
        lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in runs)
        s, e, p = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2])) if runs else (None, None, None)
        told = (s, e - s, p, 1000 * (e - s) // p) if runs else (None,) * 4
        kept = " ".join(w for i, w in enumerate(found) if i not in drop)
        want[(doc_id, len(runs), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(), len(found))] += 1
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == want
    assert sum(1 for r in want if r[1]) > 5
    empty = periodic_runs(frame(spark, []))
    assert empty.columns == ["doc_id", "n_words", "runs", "collapsed"] and empty.count() == 0
    with pytest.raises(ValueError):
        periodic_runs(frame(spark), least=1)


def test_repeat_tail(spark):
    rows = spark.createDataFrame([("a b c d e f",), (" ",), (None,), ("  one ",)], "text string")
    got = rows.select(repeat_tail(F.col("text"), lambda n: F.least(n - 1, F.lit(2)), lambda n, a: F.lit(2))).collect()
    assert [r[0] for r in got] == ["a b c d c d", " ", None, "one"]


def replayed(rows: list[tuple[str, frozenset, bool, bool]], names: str) -> dict:
    """What the audit must give, by going through each order and document."""
    out = {}
    for part in {r[0] for r in rows}:
        for order in permutations(names):
            left = [r for r in rows if r[0] == part]
            gone: list = []
            for step, name in enumerate(order, 1):
                removed = [r for r in left if name in r[1]]
                left = [r for r in left if name not in r[1]]
                unique = sum(r[0] == part and r[1] == {name} for r in rows)
                out[part, "".join(order), step] = [name, len(left), len(removed), sum(name in r[1] for r in gone), unique, sum(r[2] for r in removed), sum(r[3] for r in removed)]
                gone += removed
    total = Counter()
    for (part, _, _), cells in out.items():
        total[part, cells[0]] += cells[2]
    return {k: (*v, total[k[0], v[0]]) for k, v in out.items()}


def test_filter_audit(spark):
    rows = documents()
    extra = [(300, "A" * 50 + " #", "en"), (301, "Hello & Co", "en"), (302, "w " * 300, "de"), (303, " ".join(f"w{k}" for k in range(200)), "fr"), (299, " ".join(f"w{k}" for k in range(200)), "fr"), (304, "", ""), (305, "", None)]
    rows += [(i, t, lang, "s", None, 1, "x", 2, "y", "b", "k", "z", 3, 4) for i, t, lang in extra]
    labels = [(k, k % 2, int(k % 5 == 0), "clash") for k in range(0, 310, 3)] + [(300, 0, 1, "a"), (300, 1, 0, "b"), (None, 1, 1, "c"), (301, None, None, "d")]
    good, toxic = {k for k, q, _, _ in labels if q == 1}, {k for k, _, t, _ in labels if t == 1}
    smallest: dict[str, int] = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    flags = []
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        found = words(text)
        fails = {
            "A": len(found) < 200, "B": 100 * len(set(found)) < 50 * len(found), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": doc_id is not None and smallest[text] < doc_id,
        }
        flags.append((lang or "", frozenset(k for k, v in fails.items() if v), doc_id is not None and doc_id in good, doc_id is not None and doc_id in toxic))
    got = audit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"))
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got.collect()} == replayed(flags, "ABCDE")
    assert audit(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    no_labels = audit(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert no_labels.agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count("*")).first() == (0, 0, 600 * len({f[0] for f in flags}))


def test_replay_of_other_filters(spark):
    rows = [("p", frozenset("x"), False, False), ("p", frozenset("xy"), True, False), ("p", frozenset(), True, False), ("q", frozenset("y"), True, False)]
    table = spark.createDataFrame([(part, "x" in f, "y" in f or None, good) for part, f, good, _ in rows], "part string, x boolean, y boolean, good boolean")
    got = {(r["part"], r["filter_order"], r["step"]): (*tuple(r)[3:9], 0, r["shapley"]) for r in replay(table, ["x", "y"], ["good"]).collect()}
    assert got == replayed(rows, "xy")
    for wrong in ([], list("abcdefg"), ["a", "a"], ["ab"]):
        with pytest.raises(ValueError):
            replay(table, wrong)


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_linked_sets_share_a_signature(percent):
    """Pairs as different as the threshold allows, from four elements on, also where all elements lie in one part."""
    rng = np.random.default_rng(percent)
    for trial in range(300):
        c = int(rng.integers(2, 200))
        union = c * 100 // percent
        only_a = int(rng.integers(0, union - c + 1))
        high = 1 << 64 if trial % 3 else 1 << 56  # the second lies in one part of the domain
        pool = np.unique(rng.integers(0, high, union * 2, np.uint64))
        rng.shuffle(pool)
        a, b = np.sort(pool[: c + only_a]), np.sort(np.concatenate([pool[:c], pool[c + only_a : union]]))
        if 100 * c < percent * union or np.array_equal(a, b):
            continue
        tokens, begins = signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
        assert set(tokens[: begins[1]].tolist()) & set(tokens[begins[1] :].tolist()), (len(a), len(b), c)


def test_signatures_are_few():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 1, 3, 4, 5, 100, 255, 5000])
    sets = [np.sort(rng.integers(0, 1 << 64, n, np.uint64)) for n in sizes]
    tokens, begins = signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]), 80)
    told = np.diff(begins)
    assert told[:3].tolist() == [0, 0, 0] and (told[3:] > 0).all() and (told <= sizes * 0.6 + 2).all()
    assert (tokens >> np.uint64(56) < 254).mean() > 0.9  # two elements or more in nearly all


@pytest.mark.parametrize(("k", "percent"), [(5, 80), (2, 60)])
def test_ngram_join(spark, k, percent):
    rng = random.Random(11)
    rows = documents()
    passage = " ".join(f"p{n}" for n in range(60))
    for n in range(40):  # a passage that many texts share links nothing by itself
        rows.append((300 + n, " ".join(f"u{n}x{i}" for i in range(rng.randint(60, 150))) + " " + passage, "en", "s", None, 1, "x", 2, "y", "b", "k", "z", 3, 4))
    for family in range(6):  # families near each other, with members around the threshold
        base = [f"f{i}" if i % 3 else f"f{family}x{i}" for i in range(rng.randint(12, 200))]
        for n in range(8):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = f"e{family}{n}"
            rows.append((400 + 10 * family + n, " ".join(text[: len(text) - rng.randint(0, 4)]), "en", "s", None, 1, "x", 2, "y", "b", "k", "z", 3, 4))
    sets = {r[0]: shingles(r[1], k) for r in rows if r[0] is not None}
    groups = Groups(sets)
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            groups.join(a, b)
    got = ngram_join(frame(spark, rows), shingle=k, percent=percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r) == ((r["doc_id"], len(sets[r["doc_id"]]), groups.find(r["doc_id"])) if r["doc_id"] is not None else (None, r["n_shingles"], None))
    assert ngram_join(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        ngram_join(frame(spark), percent=40)


def test_ngram_join_lets_go_of_shuffle_files_after_each_large_pass(spark, monkeypatch):
    keep, done = Scratch.keep, []
    monkeypatch.setattr(Scratch, "keep", lambda self, table, name: (keep(self, table, name), done.append(name))[0])
    monkeypatch.setattr(Scratch, "release", lambda self: done.append("release"))
    rows = [(n, " ".join(f"w{n // 4}x{i}" for i in range(40 - n % 4)), "en", "s", None, 1, "x", 2, "y", "b", "k", "z", 3, 4) for n in range(8)]
    assert {r["component_id"] for r in ngram_join(frame(spark, rows)).collect()} == {0, 4}
    assert {done[done.index(n) + 1] for n in ("shared", "members", "sets", "compared", "among", "links")} == {"release"}


def test_line_dedup_deals_out_keys_in_passes_and_lets_go_of_shuffle_files(spark, monkeypatch):
    keep, done = Scratch.keep, []
    monkeypatch.setattr(Scratch, "keep", lambda self, table, name: (keep(self, table, name), done.append(name))[0])
    monkeypatch.setattr(Scratch, "release", lambda self: done.append("release"))
    line = " ".join(f"word{n}" for n in range(40))
    docs = spark.createDataFrame([(n, line.replace(f"word3{n}", "other")) for n in range(3)], "doc_id long, text string")
    assert [(r["group_doc"], r["group_size"]) for r in group_lines(docs).collect()] == [(0, 3)] * 3
    assert sorted(n for turn in range(PASSES) for n in range(turn, BANDS, PASSES)) == list(range(BANDS))
    after = ["classes", *(f"shared-{turn}" for turn in range(PASSES)), "texts", "pairs-0", "compared-0", "linked", "groups"]
    assert PASSES > 1 and {done[done.index(n) + 1] for n in after} == {"release"}
