"""SentencePiece encoding and decoding in batched numpy.

A piece never has another character before the word mark, so texts fall into words (marks, then other
characters) that are segmented on their own, and each distinct word of a batch is segmented once.  Words of
equal length advance together; a substring's hash, from running sums over the batch, probes the sorted keys of
the pieces.

A *unigram* model is decoded by Viterbi: position by position, the vectorised maximum over the pieces that end
there is kept with its backpointer.  A *BPE* model's scores are merge ranks, whose best sum is not what the model
encodes (Viterbi gives other ids than the model's own for most texts), so the same batches are merged instead: in
each round the best scoring adjacent pair of every word, found by a vectorised maximum, becomes one symbol.

Decoding gathers the bytes of all pieces of a batch at once.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.llm.codepoints import code_point_chunks
from citelake.llm.words import WordHasher, mix
from citelake.llm.worker import tidy

MARK = 0x2581
#: A BPE word that is longer is merged by a heap, which does not take a round for each merge.
LONGEST_BATCHED = 48
#: What an unknown character costs below the worst piece, as in the library.
UNKNOWN_PENALTY = 10.0


def load(model_path: str) -> dict:
    """The model's pieces as arrays.  ``ValueError`` for what is not supported: own normalisation rules, white
    space as suffix, user-defined symbols and model types other than unigram and BPE."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    read = proto.ModelProto()
    with open(model_path, "rb") as file:
        read.ParseFromString(file.read())
    kinds = read.SentencePiece
    rules, trained = read.normalizer_spec, read.trainer_spec
    if trained.model_type not in (1, 2) or trained.treat_whitespace_as_suffix or rules.precompiled_charsmap:
        raise ValueError("only unigram and BPE models without normalisation rules are supported")
    if rules.remove_extra_whitespaces or not rules.escape_whitespaces or any(p.type == kinds.USER_DEFINED for p in read.pieces):
        raise ValueError("white space removal and user-defined symbols are not supported")
    pieces = [(p.piece, p.score, p.type) for p in read.pieces]
    return build(
        [(t, s) if kind in (kinds.NORMAL,) else (None, 0.0) for t, s, kind in pieces],
        kind="unigram" if trained.model_type == 1 else "bpe",
        unknown=next(i for i, p in enumerate(pieces) if p[2] == kinds.UNKNOWN),
        bytes_at={int(t[1:-1], 16): i for i, (t, _, kind) in enumerate(pieces) if kind == kinds.BYTE},
        dummy_prefix=rules.add_dummy_prefix,
    )


def build(pieces: list[tuple[str | None, float]], kind: str, unknown: int = 0, bytes_at: dict[int, int] | None = None, dummy_prefix: bool = True) -> dict:
    """A model of normal pieces by id (None: not a normal piece)."""
    spans = _Spans()
    keys, ids, scores, longest = [], [], [], 1
    for n, (text, score) in enumerate(pieces):
        if text is None:
            continue
        if "▁" in text.lstrip("▁"):
            raise ValueError(f"piece {text!r} has a word mark inside")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        longest = max(longest, len(points))
        keys.append(int(spans.keys(spans.sums(points), np.array([0]), np.array([len(points)]))[0]))
        ids.append(n)
        scores.append(score)
    order = np.argsort(np.array(keys, np.uint64))
    raw = [(t or "").replace("▁", " ").encode() for t, _ in pieces]
    for value, n in (bytes_at or {}).items():
        raw[n] = bytes([value])
    raw[unknown] = " ⁇ ".encode()
    lengths = np.array([len(r) for r in raw])
    byte_ids = np.full(256, -1, np.int32)
    for value, n in (bytes_at or {}).items():
        byte_ids[value] = n
    bits = np.zeros(1 << 20, bool)
    bits[(np.array(keys, np.uint64) >> np.uint64(44)).astype(np.int64)] = True
    return {
        "kind": kind, "keys": np.array(keys, np.uint64)[order], "ids": np.array(ids, np.int32)[order], "scores": np.array(scores)[order],
        "bits": bits, "longest": longest, "unknown": unknown, "byte_ids": byte_ids, "dummy_prefix": dummy_prefix,
        "raw": np.frombuffer(b"".join(raw), np.uint8), "starts": np.cumsum(lengths) - lengths, "lengths": lengths,
    }


class _Spans:
    """Hashes of ranges of code points."""

    def __init__(self):
        self.hasher = WordHasher()

    def sums(self, points: np.ndarray) -> np.ndarray:
        self.hasher._grow(len(points) + 1)
        out = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(0x1234567)) * self.hasher.powers[: len(points)], out=out[1:])
        return out

    def keys(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.hasher.spans(sums, start, end)


class _Encoder:
    def __init__(self, model: dict):
        self.model, self.spans = model, _Spans()

    def probe(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of each span among the sorted pieces, or -1."""
        out = np.full(len(start), -1, np.int64)
        keys = self.spans.keys(sums, start, end)
        able = np.flatnonzero(self.model["bits"][(keys >> np.uint64(44)).astype(np.int64)] & (end - start <= self.model["longest"]))
        keys = keys[able]
        place = np.minimum(np.searchsorted(self.model["keys"], keys), len(self.model["keys"]) - 1)
        out[able] = np.where(self.model["keys"][place] == keys, place, -1)
        return out

    def score(self, place: np.ndarray) -> np.ndarray:
        return np.where(place >= 0, self.model["scores"][place], -np.inf)

    # Each of the three returns, for words at ``start`` of ``size`` code points, the symbols: (word, from, to), in order.

    def viterbi(self, sums: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(start)
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0.0
        back = np.zeros((size + 1, n), np.int64)
        worst = float(self.model["scores"].min()) - UNKNOWN_PENALTY
        for j in range(1, size + 1):
            for i in range(max(0, j - self.model["longest"]), j):
                worth = self.score(self.probe(sums, start + i, start + j))
                if i == j - 1:
                    worth = np.maximum(worth, worst)
                total = best[i] + worth
                better = total > best[j]
                best[j] = np.where(better, total, best[j])
                back[j] = np.where(better, i, back[j])
        words, froms, tos = [], [], []
        at = np.full(n, size)
        who = np.arange(n)
        while len(who):
            before = back[at[who], who]
            words.append(who)
            froms.append(before)
            tos.append(at[who])
            at[who] = before
            who = who[before > 0]
        word, a, b = np.concatenate(words), np.concatenate(froms), np.concatenate(tos)
        order = np.lexsort((a, word))
        return word[order], a[order], b[order]

    def merged(self, sums: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(start)
        begin = np.ones((n, size), bool)
        if size > 1:
            # at each symbol's first place: where it ends, where the one before begins, and what joining the next is worth
            end = np.tile(np.arange(1, size + 1), (n, 1))
            prev = np.tile(np.arange(-1, size - 1), (n, 1))
            worth = np.full((n, size), -np.inf)
            first = (start[:, None] + np.arange(size - 1)[None, :]).reshape(-1)
            worth[:, :-1] = self.score(self.probe(sums, first, first + 2)).reshape(n, size - 1)
            who = np.arange(n)
            while len(who):
                i = worth[who].argmax(axis=1)
                alive = worth[who, i] > -np.inf
                who, i = who[alive], i[alive]
                if not len(who):
                    break
                gone = end[who, i]
                stop = end[who, gone]
                end[who, i] = stop
                begin[who, gone] = False
                worth[who, gone] = -np.inf
                worth[who, i] = -np.inf
                more = np.flatnonzero(stop < size)
                w, k, s = who[more], i[more], stop[more]
                prev[w, s] = k
                worth[w, k] = self.score(self.probe(sums, start[w] + k, start[w] + end[w, s]))
                more = np.flatnonzero(i > 0)
                w, k = who[more], i[more]
                left = prev[w, k]
                worth[w, left] = self.score(self.probe(sums, start[w] + left, start[w] + end[w, k]))
        word, a = np.nonzero(begin)
        b = np.append(a[1:], size)
        b[np.append(word[1:] != word[:-1], True)] = size
        return word, a, b

    def heaped(self, sums: np.ndarray, start: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One long word: pairs wait in a heap by score and place."""
        end, prev, alive = list(range(1, size + 1)), list(range(-1, size - 1)), [True] * size
        first = np.arange(start, start + size - 1)
        queue = [(-s, i, i + 1, i + 2) for i, s in enumerate(self.score(self.probe(sums, first, first + 2)).tolist()) if s > -np.inf]
        heapq.heapify(queue)

        def offer(a: int, mid: int, b: int) -> None:
            if b - a <= self.model["longest"]:
                worth = float(self.score(self.probe(sums, np.array([start + a]), np.array([start + b])))[0])
                if worth > -np.inf:
                    heapq.heappush(queue, (-worth, a, mid, b))

        while queue:
            _, a, mid, b = heapq.heappop(queue)
            if not alive[a] or end[a] != mid or mid >= size or not alive[mid] or end[mid] != b:
                continue
            end[a], alive[mid] = b, False
            if b < size:
                prev[b] = a
                offer(a, b, end[b])
            if a:
                offer(prev[a], a, b)
        froms = np.array([i for i in range(size) if alive[i]])
        return np.zeros(len(froms), np.int64), froms, np.array([end[i] for i in froms.tolist()])

    def words(self, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and where each word's begin."""
        sums = self.spans.sums(points)
        whose, froms, tos = [], [], []
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order])) + 1
        for group in np.split(order, cuts) if len(order) else []:
            length = int(size[group[0]])
            if self.model["kind"] == "unigram":
                found = [(group, self.viterbi(sums, start[group], length))]
            elif length <= LONGEST_BATCHED:
                found = [(group, self.merged(sums, start[group], length))]
            else:
                found = [(np.array([w]), self.heaped(sums, int(start[w]), length)) for w in group.tolist()]
            for own, (word, a, b) in found:
                whose.append(own[word])
                froms.append(start[own[word]] + a)
                tos.append(start[own[word]] + b)
        if not whose:
            return np.zeros(0, np.int32), np.zeros(len(start) + 1, np.int64)
        word, a, b = np.concatenate(whose), np.concatenate(froms), np.concatenate(tos)
        order = np.argsort(word, kind="stable")
        word, a, b = word[order], a[order], b[order]
        place = self.probe(sums, a, b)
        ids = np.where(place >= 0, self.model["ids"][place], self.model["unknown"]).astype(np.int32)
        strange = np.flatnonzero(place < 0)
        if len(strange) and self.model["byte_ids"][0] >= 0:
            spelled = [self.model["byte_ids"][list(chr(c).encode())] for c in points[a[strange]].tolist()]
            times = np.ones(len(ids), np.int64)
            times[strange] = [len(s) for s in spelled]
            ids, word = np.repeat(ids, times), np.repeat(word, times)
            at = np.cumsum(times) - times
            for k, s in zip(at[strange].tolist(), spelled, strict=True):
                ids[k : k + len(s)] = s
        return ids, np.searchsorted(word, np.arange(len(start) + 1))


def encode_texts(model: dict, texts: list[str | None], encoder: _Encoder | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, offsets) for runs of rows; null and empty texts have no ids."""
    encoder = encoder or _Encoder(model)
    lead = " " if model["dummy_prefix"] else ""
    for a, b, points, offsets in code_point_chunks([lead + t if t else "" for t in texts]):
        points = np.where(points == 32, np.uint32(MARK), points)
        marked = points == MARK
        opens = marked.copy()
        opens[1:] &= ~marked[:-1]
        opens[offsets[:-1][offsets[:-1] < len(points)]] = True
        start = np.flatnonzero(opens)
        if not len(start):
            yield a, b, np.zeros(0, np.int32), np.zeros(b - a + 1, np.int64)
            continue
        size = np.diff(np.append(start, len(points)))
        first_word = np.searchsorted(start, offsets)
        sums = encoder.spans.sums(points)
        _, some, which = np.unique(encoder.spans.keys(sums, start, start + size), return_index=True, return_inverse=True)
        ids, begins = encoder.words(points, start[some], size[some])
        counts = np.diff(begins)[which]
        ends = np.cumsum(counts)
        gather = np.repeat(begins[:-1][which] - (ends - counts), counts) + np.arange(ends[-1])
        ids, where = ids[gather], np.concatenate([[0], ends])[first_word]
        if model["byte_ids"][0] < 0:  # as in the library, a run of unknown characters is one unknown piece
            keep = np.ones(len(ids), bool)
            keep[1:] = (ids[1:] != model["unknown"]) | (ids[:-1] != model["unknown"])
            keep[where[:-1][where[:-1] < len(ids)]] = True
            ids, where = ids[keep], np.concatenate([[0], np.cumsum(keep)])[where]
        yield a, b, ids, where


def decode_ids(model: dict, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The UTF-8 text of each row of ids."""
    lengths = model["lengths"][ids]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    data = model["raw"][np.repeat(model["starts"][ids] - (ends - lengths), lengths) + np.arange(total)].tobytes()
    where = np.concatenate([[0], ends])[offsets].tolist()
    texts = [data[a:b] for a, b in zip(where[:-1], where[1:], strict=True)]
    return [t[1:] if model["dummy_prefix"] and t[:1] == b" " else t for t in texts]


def encode(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids, n_tokens, decoded_sha256, round_trip`` for every row.

    Null and empty texts have no ids.  ``round_trip`` says whether decoding gives the text back; it does unless
    the text itself holds word marks or, without byte pieces, unknown characters.  Rows are encoded each by itself:
    repeated rows and ids give a row each, a null id is kept, and an empty table gives an empty result.  Ties between
    segmentations go to the piece that the library takes too.  Only the named columns are read, so clashing names do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b, ids, where in encode_texts(model, texts, encoder):
                back = decode_ids(model, ids, where)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(ids)),
                        pa.array(np.diff(where)),
                        pa.array([hashlib.sha256(t).hexdigest() for t in back]),
                        pa.array([t == (text or "").encode() for t, text in zip(back, texts[a:b], strict=True)]),
                    ],
                    names=["id", "ids", "n_tokens", "decoded_sha256", "round_trip"],
                )

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    schema = f"id {kind}, ids array<int>, n_tokens long, decoded_sha256 string, round_trip boolean"
    return named.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model: dict, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, text`` from a column of piece ids; null counts as no ids, and bytes that are not UTF-8 become U+FFFD.

    Repeated rows give a row each, an empty table an empty result; only the named columns are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            where = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            ids = np.array([i for x in lists for i in x], np.int64)
            texts = [t.decode("utf-8", "replace") for t in decode_ids(model, ids, where)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    named = rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return named.mapInArrow(run, f"id {named.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
