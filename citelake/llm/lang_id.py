"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text answers, one symbol at a time,
whether the current match can grow.  A text is parsed against it from left to right into longest matches; the
fewer phrases per symbol, the closer the text is to the language's sample.  The language with the fewest wins.

The automaton becomes a table: the next state for each state and symbol, where a symbol that ends the match
leads to the state it has as the start of the next one, with a mark.  A parse is then a walk, and many texts
walk together, one array lookup per symbol for all of them.  Texts are parsed in windows of ``window`` symbols
(phrases end with the window), so one very long text is many walks of bounded length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.llm.codepoints import code_point_chunks, letter_tables, letters_lowered
from citelake.llm.worker import tidy

#: Bounds of the labelled sample that automata are built from: documents and symbols per language, and languages.
SAMPLE_DOCS = 64
SAMPLE_SYMBOLS = 20_000
MAX_LANGUAGES = 200
#: A language's symbols at most: its own letters, and one each for any run of non-letters, for its letters beyond the
#: most frequent ones, and for letters that its sample does not hold.  A table is as wide as its language has symbols.
ALPHABET = 128
GAP, RARE, FOREIGN, LETTERS = 0, 1, 2, 3
WINDOW = 256
UNDETERMINED = "und"


def _symbols(points: np.ndarray, offsets: np.ndarray, tables, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters lower-cased (as ``_known_codes`` if ``known`` are given), each run of anything else as one 0; new offsets; letters in each row."""
    is_letter, lowered = letters_lowered(points, tables)
    code = np.where(is_letter, lowered, 0)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    if len(keep):
        keep[offsets[:-1][offsets[:-1] < len(keep)]] = True
    letters = np.concatenate([[0], np.cumsum(is_letter)])
    kept = np.concatenate([[0], np.cumsum(keep)])
    code = code[keep] if known is None else _known_codes(code[keep], known)
    return code, kept[offsets], letters[offsets[1:]] - letters[offsets[:-1]]


def automaton(text: list[int], alphabet: int) -> np.ndarray:
    """Suffix automaton of ``text`` as a table: states x alphabet of next states, negative (~state) where a phrase ends.

    The state after a phrase end is the one that the symbol has as a phrase start.  A symbol that the text does not hold
    is a phrase of its own: it leads to the last state but one, from which every symbol ends a phrase.  A parse begins in
    the last state, which no phrase has led to.
    """
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and symbol not in step[at]:
            step[at][symbol] = new
            at = link[at]
        if at != -1:
            to = step[at][symbol]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(step)
                step.append(dict(step[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at != -1 and step[at].get(symbol) == to:
                    step[at][symbol] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    dead = len(step)
    opening = np.full(alphabet, dead, np.int32)
    for symbol, to in step[0].items():
        opening[symbol] = to
    table = np.tile(~opening, (len(step) + 2, 1))
    for state, moves in enumerate(step):
        if moves:
            table[state, list(moves)] = list(moves.values())
    table[-1] = opening
    return table


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Automata of the languages of ``docs``; rows without id, text or language are not used.

    Of each language, documents fall into ``SAMPLE_DOCS`` hashed bins and the least hash of a bin is taken, so
    the sample is bounded and reruns agree.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    h = F.xxhash64(F.col(id_col))
    picked = (
        rows.select(F.col(lang_col).alias("_l"), F.col(id_col).alias("_i"), h.alias("_h"))
        .groupBy("_l", F.pmod("_h", F.lit(SAMPLE_DOCS)))
        .agg(F.min(F.struct("_h", "_i"))["_i"].alias("_i"))
        .select("_l", "_i")
    )
    some = picked.limit(SAMPLE_DOCS * MAX_LANGUAGES + 1).collect()
    if len({r["_l"] for r in some}) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    chosen = docs.sparkSession.createDataFrame(some, picked.schema) if some else picked
    texts = (
        rows.select(F.col(lang_col).alias("l"), F.col(id_col).alias("i"), F.substring(text_col, 1, SAMPLE_SYMBOLS).alias("t"))
        .join(F.broadcast(chosen), (F.col("l") == F.col("_l")) & (F.col("i") == F.col("_i")))
        .select("l", "i", "t")
        .collect()
    )
    return build({lang: [r["t"] for r in sorted(texts, key=lambda r: (r["i"], r["t"])) if r["l"] == lang] for lang in sorted({r["l"] for r in texts})})


def build(samples: dict[str, list[str]]) -> dict:
    """The model of sample texts by language."""
    tables = letter_tables()
    streams = {}
    for lang, texts in samples.items():
        each = max(1, SAMPLE_SYMBOLS // max(1, len(texts)))
        stream: list[int] = []
        for _, _, points, offsets in code_point_chunks(texts):
            code, where, _ = _symbols(points, offsets, tables, None)
            for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True):
                stream += [*code[a : min(b, a + each)].tolist(), 0]
        streams[lang] = stream[:SAMPLE_SYMBOLS]
    known = np.array(sorted({c for stream in streams.values() for c in stream if c}), np.int64)
    symbols = np.full((len(streams), len(known) + 2), FOREIGN, np.int16)
    symbols[:, 0] = GAP
    built, starts, base = [], [], 0
    for n, stream in enumerate(streams.values()):
        counts = sorted(Counter(c for c in stream if c).items(), key=lambda x: (-x[1], x[0]))
        for place, (c, _) in enumerate(counts):
            symbols[n, np.searchsorted(known, c) + 2] = LETTERS + place if LETTERS + place < ALPHABET else RARE
        own = symbols[n][_known_codes(np.array(stream, np.int64), known)]
        width = min(ALPHABET, LETTERS + len(counts))
        table = automaton(own.tolist(), width)
        moved = np.where(table < 0, ~(~table * width + base), table * width + base).astype(np.int32)
        built.append(moved.reshape(-1))
        starts.append(base + (len(table) - 1) * width)
        base += table.size
    return {"langs": list(streams), "starts": np.array(starts, np.int64), "table": np.concatenate(built) if built else np.zeros(0, np.int32), "known": known, "symbols": symbols}


def _known_codes(code: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Lower-cased letters as 2 and up if any sample holds them, else 1; 0 stays."""
    at = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
    held = known[at] == code if len(known) else np.zeros(len(code), bool)
    return np.where(code == 0, 0, np.where(held, at + 2, 1))


def phrase_counts(model: dict, code: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Phrases of each row's parse against each language: rows x languages."""
    langs, rows = len(model["langs"]), len(offsets) - 1
    sizes = np.diff(offsets)
    lanes = -(-sizes // window)
    row = np.repeat(np.arange(rows), lanes)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    start = offsets[:-1][row] + nth * window
    size = np.minimum(window, offsets[1:][row] - start)
    order = np.argsort(-size, kind="stable")
    row, start, size = row[order], start[order], size[order]
    # a state is the place of its row in the table, where its symbols' next states stand
    state = np.repeat(model["starts"][:, None], len(row), 1).astype(np.int64)
    ended = np.zeros((langs, len(row)), np.int32)
    table, symbols = model["table"], model["symbols"]
    alive = np.searchsorted(-size, -np.arange(window), "left") if len(row) else np.zeros(window, int)
    for i in range(window):
        m = int(alive[i])
        if not m:
            break
        to = table[state[:, :m] + symbols[:, code[start[:m] + i]]]
        stop = to < 0
        ended[:, :m] += stop
        state[:, :m] = np.where(stop, ~to, to)
    out = np.zeros((rows, langs), np.int64)
    for n in range(langs):
        # a window's last phrase is counted as well
        out[:, n] = np.bincount(row, ended[n] + 1, minlength=rows)
    return out


def _predict(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = letter_tables()
        langs = np.array([*model["langs"], UNDETERMINED], object)
        for batch in batches:
            for a, b, points, offsets in code_point_chunks(batch.column(1).to_pylist()):
                code, where, letters = _symbols(points, offsets, tables, model["known"])
                rows = b - a
                best, score = np.full(rows, len(langs) - 1), np.zeros(rows)
                if len(langs) > 1:
                    phrases = phrase_counts(model, code, where)
                    least = phrases.min(axis=1)
                    share = 1 / np.exp(np.maximum(-50, least[:, None] - phrases)).sum(axis=1)
                    told = letters > 0
                    best = np.where(told, phrases.argmin(axis=1), best)
                    score = np.where(told, share, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, rows), pa.array(langs[best].tolist(), pa.string()), pa.array(score)],
                    names=["id", "lang_pred", "score"],
                )

    return run


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` for every row.

    A null text, or one without a letter, is ``und`` with score 0, as is every text when no language was
    learned.  Equal phrase counts go to the first language in order.  ``score`` is the winner's share when each
    phrase more than the fewest divides a language's weight by e.  Every row is judged by itself: repeated rows and
    ids give a row each, a null id is kept as it is, an empty table gives an empty result, and only the named columns are read.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    return named.mapInArrow(tidy(_predict(model)), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def drop_undetermined(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text has no language, all columns kept; texts pass through once, unshuffled.

    When no language was learned, only null texts and those without a letter go.  Rows are judged each by itself, repeated
    ones alike; no column is added, so names cannot clash, and an empty table gives an empty one.
    """
    columns = docs.columns
    place = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, tables = _predict(model), letter_tables()
        for batch in batches:
            if not model["langs"]:
                # nothing to compare with: only whether there is a letter tells
                for a, b, points, offsets in code_point_chunks(batch.column(place).to_pylist()):
                    letters = _symbols(points, offsets, tables, None)[2]
                    yield batch.slice(a, b - a).filter(pa.array(letters > 0))
                continue
            pair = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(place)], names=["id", "text"])
            verdicts = pa.Table.from_batches(judge([pair])) if batch.num_rows else None
            if verdicts is not None:
                mask = np.array(verdicts["lang_pred"].to_pylist(), object) != UNDETERMINED
                yield batch.filter(pa.array(mask))

    return docs.mapInArrow(tidy(run), docs.schema)
