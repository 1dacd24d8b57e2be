"""One form for texts that look the same.

A batch of texts is exploded to an array of code points with their positions; the mapping tables, bounded by the size of
Unicode, are built on the driver, broadcast by Spark and joined to it by code point, so that results don't depend on a worker's own
tables. Each code point becomes its decomposition with look-alike letters, full-width forms, ligatures and blanks replaced and invisible
characters removed; combining marks are ordered by their class, composed with the letter before them as are the letters of Hangul
syllables, and the strings are rebuilt. All steps work on whole batches; Spark splits the work, texts of any length are processed whole.

What is made equal: full-width and ordinary forms, ligatures and their letters, composed letters and combining accents,
texts with and without zero-width characters and soft hyphens, the kinds of blank, Cyrillic or Greek letters printed like
Latin ones. Everything else (case, accents, digits, words, runs of several blanks) stays apart.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Cyrillic and Greek letters that print like a Latin letter.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v",
    "Ӏ": "I", "ӏ": "l", "Ү": "Y", "ү": "y", "Ѵ": "V", "ѵ": "v", "Ԍ": "G", "Ϲ": "C", "ϲ": "c", "Ϳ": "J", "ϳ": "j", "Ϻ": "M",
}
# Characters without width or ink.
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF]
# Blanks other than the ordinary one.
BLANKS = [0x00A0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x202F, 0x205F, 0x3000]
#: Joined letter forms: the blocks of presentation forms with a compatibility decomposition, and single joined letters.
LIGATURE_RANGES = [(0xFB00, 0xFB06), (0xFB13, 0xFB17), (0x0132, 0x0133), (0x01C7, 0x01CC), (0x01F1, 0x01F3)]
#: Code points from here on are neither mapped nor marks nor letters; the tables end with one entry for all of them.
LIMIT = 0x33000
#: Hangul: first syllable, first leading and vowel letter and the one before the first trailing letter, and how many there are of each.
SYLLABLE, LEAD, VOWEL, TRAIL, LEADS, VOWELS, TRAILS = 0xAC00, 0x1100, 0x1161, 0x11A7, 19, 21, 28
#: Characters that a task explodes at a time; each takes some 50 bytes until the strings are rebuilt.
PORTION = 500_000
#: Code points from here on may be marks.
FIRST_MARK = 0x0300


def _target(ch: str) -> str:
    """What one character is read as, decomposed and with look-alikes replaced."""
    code = ord(ch)
    if code in INVISIBLE:
        return ""
    if code in BLANKS:
        return " "
    kind, _, parts = unicodedata.decomposition(ch).rpartition("> ")
    if not parts:
        return LOOK_ALIKES.get(ch, ch)
    joined = any(a <= code <= b for a, b in LIGATURE_RANGES)
    if kind and kind not in ("<wide", "<narrow") and not joined:
        return LOOK_ALIKES.get(ch, ch)
    return "".join(_target(chr(int(p, 16))) for p in parts.split())


class Tables:
    """By code point: `length`, `row` and `parts` of what it is read as, its combining `klass`, whether it is part of a `word`, its `lower` case; and composed letters by (letter, mark)."""

    def __init__(self):
        self.length = np.ones(LIMIT + 1, np.uint8)
        self.klass = np.zeros(LIMIT + 1, np.uint8)
        self.word, self.lower = np.zeros(LIMIT + 1, bool), np.arange(LIMIT + 1, dtype=np.uint32)
        changed: dict[int, str] = {}
        pairs: dict[int, int] = {}
        for code in range(LIMIT):
            if 0xD800 <= code <= 0xDFFF:  # surrogates are no characters
                continue
            ch = chr(code)
            if ch.isalnum():
                self.word[code] = True
                if len(low := ch.lower()) == 1:
                    self.lower[code] = ord(low)
            if code < 0x80 or SYLLABLE <= code < 0xD800:  # syllables are their own composed form
                continue
            self.klass[code] = unicodedata.combining(ch)
            if (to := _target(ch)) != ch:
                changed[code] = to
            parts = unicodedata.decomposition(ch).split()
            if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
                letter, mark = (_target(chr(int(x, 16))) for x in parts)
                whole = unicodedata.normalize("NFC", letter + mark)
                if len(letter) and len(mark) == 1:
                    # a letter that carries marks already is its own composed form
                    if len(letter) > 1:
                        letter = unicodedata.normalize("NFC", letter)
                    if len(letter) == 1:
                        pairs.setdefault(ord(letter) << 21 | ord(mark), ord(whole) if len(whole) == 1 else code)
        width = max(len(x) for x in changed.values())
        self.row = np.zeros(LIMIT + 1, np.uint16)
        self.parts = np.zeros((len(changed) + 1, width), np.uint32)
        for i, (code, to) in enumerate(changed.items(), 1):
            self.length[code], self.row[code] = len(to), i
            self.parts[i, : len(to)] = [ord(x) for x in to]
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_values = np.array([pairs[k] for k in sorted(pairs)], np.uint32)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def broadcast_tables(spark: SparkSession) -> Broadcast:
    """The tables for all tasks: some 3 MB, whatever the data."""
    return spark.sparkContext.broadcast(tables())


def explode_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a 0 after each, and the position at which each text starts (one more for the end)."""
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return points, starts


def canonical_points(texts: list[str], t: Tables | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As explode_texts, but in the canonical form; without tables this process's own are taken."""
    points, starts = explode_texts(texts)
    t = t or tables()
    high = np.flatnonzero(points >= 0x80)
    mapped = high[t.row[np.minimum(points[high], LIMIT)] > 0]
    if len(mapped):
        rows = t.row[points[mapped]]
        lengths = t.length[points[mapped]]
        if (lengths == 1).all():
            points = points.copy()
            points[mapped] = t.parts[rows, 0]
        else:
            counts = np.ones(len(points), np.int64)
            counts[mapped] = lengths
            ends = np.cumsum(counts)
            at = ends[mapped] - lengths
            points = np.repeat(points, counts)
            for k in range(int(lengths.max())):
                has = lengths > k
                points[at[has] + k] = t.parts[rows[has], k]
            starts = np.concatenate(([0], ends))[starts]
    return _join_syllables(*_compose(points, starts, t))


def _join_syllables(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge a leading letter with the vowel after it, then a syllable without trailing letter with the one after it."""
    for first, after in ((_leads, _vowels), (_open_syllables, _trails)):
        at = np.flatnonzero(after(points[1:]))
        at = at[first(points[at])]
        if len(at):
            a, b = points[at].astype(np.int64), points[at + 1].astype(np.int64)
            points = points.copy()
            points[at] = SYLLABLE + ((a - LEAD) * VOWELS + b - VOWEL) * TRAILS if first is _leads else a + b - TRAIL
            keep = np.ones(len(points), bool)
            keep[at + 1] = False
            kept = np.concatenate(([0], np.cumsum(keep)))
            points, starts = points[keep], kept[starts]
    return points, starts


def _leads(points: np.ndarray) -> np.ndarray:
    return (points >= LEAD) & (points < LEAD + LEADS)


def _vowels(points: np.ndarray) -> np.ndarray:
    return (points >= VOWEL) & (points < VOWEL + VOWELS)


def _trails(points: np.ndarray) -> np.ndarray:
    return (points > TRAIL) & (points < TRAIL + TRAILS)


def _open_syllables(points: np.ndarray) -> np.ndarray:
    inside = (points >= SYLLABLE) & (points < SYLLABLE + LEADS * VOWELS * TRAILS)
    return inside & ((points.astype(np.int64) - SYLLABLE) % TRAILS == 0)


def _compose(points: np.ndarray, starts: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Order the marks after each letter by class and merge the letter with those that compose with it."""
    marks = np.flatnonzero(points >= FIRST_MARK)
    marks = marks[t.klass[np.minimum(points[marks], LIMIT)] > 0]
    if not len(marks):
        return points, starts
    points = points.copy()
    first = np.concatenate(([True], np.diff(marks) != 1))
    run = np.cumsum(first) - 1
    run_start = marks[first]
    order = np.lexsort((np.arange(len(marks)), t.klass[points[marks]], run))
    points[marks] = points[marks[order]]
    place = marks - run_start[run]  # 0 for the first mark after a letter
    letters = run_start - 1
    letters_at = np.maximum(letters, 0)
    last_class = np.zeros(len(run_start), np.int64)
    gone = []
    for k in range(int(place.max()) + 1):
        now = marks[place == k]
        of = run[place == k]
        klass = t.klass[points[now]].astype(np.int64)
        key = points[letters_at[of]].astype(np.int64) << 21 | points[now].astype(np.int64)
        slot = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        fits = (t.pair_keys[slot] == key) & (last_class[of] < klass) & (letters[of] >= 0)
        points[letters[of[fits]]] = t.pair_values[slot[fits]]
        gone.append(now[fits])
        last_class[of[~fits]] = klass[~fits]
    keep = np.ones(len(points), bool)
    keep[np.concatenate(gone)] = False
    kept = np.concatenate(([0], np.cumsum(keep)))
    return points[keep], kept[starts]


def rebuild(points: np.ndarray, starts: np.ndarray) -> list[str]:
    whole = points.astype("<u4", copy=False).tobytes().decode("utf-32-le", "surrogatepass")
    bounds = starts.tolist()
    return [whole[a : b - 1] for a, b in zip(bounds, bounds[1:])]


def portions(texts: list[str], characters: int = PORTION) -> Iterator[slice]:
    """Neighbouring texts of together at most `characters`, or one longer text: what is exploded at a time."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > characters:
            yield slice(start, i)
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def canonical_strings(texts: list[str], t: Tables | None = None) -> list[str]:
    return [form for part in portions(texts) for form in rebuild(*canonical_points(texts[part], t))]


def with_canonical_text(df: DataFrame, text: str, out: str) -> DataFrame:
    """`df` with the canonical form of `text` in `out`; NULL stays NULL, the empty text stays empty. An older column `out` is replaced."""
    kept = df.drop(out) if out != text else df
    schema = T.StructType([*[f for f in kept.schema.fields if f.name != out], T.StructField(out, T.StringType())])
    sent = broadcast_tables(df.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for part in portions([t or "" for t in texts]):
                forms = iter(canonical_strings([t for t in texts[part] if t is not None], sent.value))
                new = pa.array([None if t is None else next(forms) for t in texts[part]], pa.string())
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*[c for c, n in zip(rows.columns, rows.schema.names) if n != out], new], schema.fieldNames())

    return kept.mapInArrow(read, schema)
