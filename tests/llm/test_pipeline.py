"""The pipeline's stages on awkward rows."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from itertools import combinations

import sentencepiece
from data import Groups, documents, frame, shingles, words

import corpus_pipeline
from citelake.llm.queries import SENTENCEPIECE_MODEL


def stages(spark, docs, tmp_path):
    out = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        out.append(docs)
    return out


def test_stages(spark, tmp_path):
    told, exact, near, mixed, encoded = stages(spark, frame(spark), tmp_path)
    assert told.columns == exact.columns == near.columns == mixed.columns == frame(spark).columns
    assert told.count() == len(documents()) - 4
    kept = Counter(r["doc_id"] for r in exact.collect())
    assert kept[84] == 1 and not any(kept[k] for k in range(75, 84)) and kept[92] == 1
    near_ids = {r["doc_id"] for r in near.collect()}
    assert 61 in near_ids and not {60, 62, 94} & near_ids and {*range(60), 88, 90, 91, 93} <= near_ids
    assert encoded.count() == mixed.count() and {r["doc_id"] for r in mixed.collect()} <= near_ids
    assert all(r["round_trip"] or r["doc_id"] == 95 for r in encoded.collect())


def test_empty_table(spark, tmp_path):
    assert [d.count() for d in stages(spark, frame(spark, []), tmp_path)] == [0, 0, 0, 0, 0]


def by_hand(rows):
    """What run() must give for rows (id, text, lang, source, ..): ids of documents with their pieces, as often as they are taken."""
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    last: dict[str, tuple] = {}
    for r in rows:
        if r[1] not in last or (r[0] is not None and (last[r[1]][0] is None or r[0] > last[r[1]][0])):
            last[r[1]] = r
    rows = list(last.values())
    sets = {r[0]: shingles(r[1], 5) for r in rows if r[0] is not None}
    groups = Groups(sets)
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            groups.join(a, b)
    rows = [r for r in rows if r[0] is None or groups.find(r[0]) == r[0]]
    by_source = defaultdict(list)
    for r in rows:
        md5 = hashlib.md5(r[1].encode()).hexdigest()
        h = int(hashlib.md5(f"{'null' if r[0] is None else r[0]}:{md5}".encode()).hexdigest()[:13], 16)
        by_source[r[3]].append((h, r[0], len(words(r[1])), r[1]))
    sizes = {s: sum(x[2] for x in own) for s, own in by_source.items()}
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sorted(by_source, key=lambda s: (s is None, s or "")))}
    target, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        target |= {s: 2 * sizes[s] for s in full} if full else {s: level * weight[s] for s in free}
        left -= sum(2 * sizes[s] for s in full)
        free = free - full if full else set()
    model, out = sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL), Counter()
    for source, own in by_source.items():
        start = 0
        for _, doc_id, size, text in sorted(own, key=lambda x: (x[0], x[1] is None, x[1] or 0)):
            times = sum(start + k * sizes[source] < int(target[source]) for k in range(2)) if size else 0
            out[(doc_id, tuple(model.encode(text)))] += times
            start += size
    return +out


def test_run_against_every_stage_by_hand(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    for folder, rows in ((str(tmp_path), documents()), ("/root/testdata/sf0.001", [tuple(r) for r in small.collect()])):
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == ["doc_id", "ids", "n_tokens", "decoded_sha256", "round_trip"]
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in out.collect()) == by_hand(rows)


def test_documents_stay_when_no_language_was_learned(spark):
    from citelake.llm import lang_id

    docs = spark.createDataFrame([(1, "some text", None), (2, "12 !", None), (3, None, None), (4, "Über", None), (5, "", None)], "doc_id long, text string, lang string")
    kept = lang_id.drop_undetermined(docs, lang_id.fit(docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4] and kept.columns == docs.columns
