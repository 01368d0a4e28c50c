"""A small table of awkward documents, and what the contracts say about it in plain Python."""

from __future__ import annotations

import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, n int, shard string, bucket string, kept string, _id string, range int, tie int"


def documents() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(300)] for lang, letters in (("en", "etaoinsh"), ("de", "enisratü"))}
    rows: list[tuple] = []

    def add(doc_id, text, lang=None, source="s0"):
        rows.append((doc_id, text, lang, source, None, 1, "x", 2, "y", "b", "k", "z", 3, 4))

    def prose(lang, n):
        return " ".join(rng.choice(vocabulary[lang]) for _ in range(n))

    for k in range(60):
        lang = "en" if k % 3 else "de"
        add(k, prose(lang, rng.randint(5, 120)) + "\n" + prose(lang, 12), lang, f"s{k % 4}")
    base = prose("en", 200)
    for k in range(60, 75):  # near copies with one to many edits
        words = base.split()
        for _ in range((k - 60) // 2):
            words[rng.randrange(len(words))] = f"edit{k}"
        add(k, " ".join(words), "en", "s1")
    for k in range(75, 85):  # exact copies
        add(k, "An exact copy of this very text, word for word.\nWith two lines.", "en", None)
    add(85, None, None, None)
    add(86, "", "en", "s2")
    add(87, "   \n\t\n", None, "s2")
    add(88, "one", "en", "s3")
    add(89, "1234 !!! 5678", None, "s3")
    add(90, prose("en", 40_000), "en", "s0")
    add(91, "x" * 60_000, None, "s0")
    add(None, "a row without an id", "en", "s1")
    add(92, "the same row twice, told again", "en", "s1")
    add(92, "the same row twice, told again", "en", "s1")
    add(93, "One Two Three four five six", "de", "s9")
    add(94, "one two three FOUR five six", "de", "s9")
    add(95, "   odd  spaces 　 é😀 ▁ mark", None, "s9")
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, COLUMNS)


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None, k: int) -> frozenset:
    found = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(found) < k:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[n : n + k]) for n in range(len(found) - k + 1))


class Groups:
    """Union-find that names a group by its least member."""

    def __init__(self, members):
        self.up = {m: m for m in members}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a
