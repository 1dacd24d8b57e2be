"""Passages of evaluation items inside training documents, by spaced seeds.

Texts become sequences of word hashes in the canonical form, letter case ignored. A seed is the hash of the words that a
fixed mask keeps of a window; positions that the mask ignores may hold any word, so substituted words don't hide a passage.
Seeds of items and documents are joined, every joined seed gives an alignment (document, item, offset), and all words that
item and document share on it are compared one by one. Every document is read whole; only windows whose seed may be an
item's leave the first scan, and in a second one only the words of documents with an alignment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelshift.llm.canonical_text import LIMIT, Tables, broadcast_tables, canonical_points, portions, tables
from panelshift.operators.bits import bit_words
from panelshift.session import cut_lineage

#: Kept positions of a window of SPAN words. Each mask ignores three, every position is ignored by one: a passage of SPAN words is
#: found whichever of its words is substituted, one of SPAN + 4 whichever two of them are.
SPAN = 10
MASKS = ("1111011100", "1110010111", "1001101111", "0101111011")
#: Most bits of the table of item seeds that goes to every task (16 MB); a fuller table only lets more windows through.
MAX_BITS = 2**27
#: Up to so many item seeds (32 MB) go to every task; more are joined by a shuffle.
BROADCAST_SEEDS = 1_000_000
WINDOWS = "doc_id long, mask int, seed long, at int"


def _mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(texts: list[str], t: Tables | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the index at which each text's words start (one more for the end)."""
    t = t or tables()
    points, starts = canonical_points(texts, t)
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = t.word[np.minimum(points, LIMIT)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edges[::2], edges[1::2]
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    lengths = ends - begins
    kept = np.flatnonzero(inside[1:-1])
    place = np.arange(len(kept)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    with np.errstate(over="ignore"):
        factors = _mix(np.arange(1, int(lengths.max()) + 1, dtype=np.uint64)) | np.uint64(1)
        terms = _mix(t.lower[points[kept]].astype(np.uint64) + np.uint64(1)) * factors[place]
        hashes = _mix(np.add.reduceat(terms, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))
    return hashes, np.searchsorted(begins, starts)


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Seed of the window that starts at each word; windows that cross into another text are the caller's to drop."""
    n = len(hashes) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i, keep in enumerate(mask):
            if keep == "1":
                total += hashes[i : i + n] * np.uint64(2 * (i * 0x2545F491 + 0x5851F42D) + 1)
        return _mix(total)


def item_words(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, words): the word hashes of each item; NULL texts are left out."""
    read_as = broadcast_tables(items.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bounds = word_hashes(batch.column(1).to_pylist(), read_as.value)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["item_id", "words"])

    return items.filter(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), text).mapInArrow(read, "item_id long, words array<long>")


def item_seeds(words: DataFrame) -> DataFrame:
    """(item_id, mask, seed, item_at): the seeds of every window of every item."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, masks, values, places = [], [], [], []
            for item, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = np.array(own.as_py(), np.int64).view(np.uint64)
                for m, mask in enumerate(MASKS):
                    s = seeds(hashes, mask)
                    ids.append(np.full(len(s), item)), masks.append(np.full(len(s), m)), values.append(s.view(np.int64)), places.append(np.arange(len(s)))
            columns = [np.concatenate(x) if x else np.zeros(0) for x in (ids, masks, values, places)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds)], ["item_id", "mask", "seed", "item_at"])

    return words.mapInArrow(read, "item_id long, mask int, seed long, item_at int")


def seed_table(seeds_: DataFrame, n: int) -> np.ndarray:
    """A bit per seed hash in a table of bounded size, merged on the executors; a fuller table only lets more through."""
    bits = min(MAX_BITS, 2 ** max(20, int(n * 64).bit_length()))
    return bit_words(seeds_.select(F.col("seed").bitwiseAND(F.lit(bits - 1).cast("long")).alias("_p")), "_p", bits).view(np.uint8)


def document_windows(documents: DataFrame, doc_id: str, text: str, table: np.ndarray) -> DataFrame:
    """Windows of documents whose seed may be an item's: doc_id, mask, seed, at (word index). NULL texts are left out."""
    sent, read_as = documents.sparkSession.sparkContext.broadcast(table), broadcast_tables(documents.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        low = np.uint64(len(bits) * 8 - 1)
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for part in portions(texts):
                yield _windows(ids[part], texts[part], bits, low, read_as.value)

    return documents.filter(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(read, WINDOWS)


def _windows(ids: np.ndarray, texts: list[str], bits: np.ndarray, low: np.uint64, t: Tables) -> pa.RecordBatch:
    hashes, bounds = word_hashes(texts, t)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for m, mask in enumerate(MASKS):
        s = seeds(hashes, mask)
        p = s & low
        at = np.flatnonzero((bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1)
        at = at[at + SPAN <= bounds[np.searchsorted(bounds, at, side="right")]]
        found.append((np.full(len(at), m), s[at], at))
    masks, values, at = (np.concatenate(x) for x in zip(*found))
    text_of = np.searchsorted(bounds, at, side="right") - 1
    columns = [pa.array(ids[text_of]), pa.array(masks, pa.int32()), pa.array(values.view(np.int64)), pa.array(at - bounds[text_of], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "mask", "seed", "at"])


def document_words(documents: DataFrame, doc_id: str, text: str, table: np.ndarray) -> DataFrame:
    """(doc_id, words): the word hashes of documents whose id may be in a table of bits (`seed_table`); NULL texts are left out."""
    sent, read_as = documents.sparkSession.sparkContext.broadcast(table), broadcast_tables(documents.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        low = len(bits) * 8 - 1
        for batch in batches:
            p = batch.column(0).to_numpy() & low
            own = batch.filter(pa.array(((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool)))
            texts = own.column(1).to_pylist()
            for part in portions(texts):
                hashes, bounds = word_hashes(texts[part], read_as.value)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([own.column(0).slice(part.start, len(texts[part])), lists], ["doc_id", "words"])

    return documents.filter(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(read, "doc_id long, words array<long>")


def leaked_passages(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per document and item that share a passage: doc_id, item_id, longest_run, overlap.

    An alignment lays the item's words over the document's at one offset; those with a common seed are compared whole.
    longest_run is the largest number of consecutive equal words on one alignment, overlap the largest number of equal
    words on one alignment, substituted words skipped. Items shorter than SPAN words, empty and NULL texts have no row. Repeated documents or
    items count like others; other columns are ignored.
    """
    words = cut_lineage(item_words(items, item_id, text).filter(F.size("words") >= SPAN))  # shorter ones have no window; the seeds' number bounds the rest
    item_side = item_seeds(words)
    n = item_side.count()
    windows = document_windows(documents, doc_id, text, seed_table(item_side, n))
    small = n <= BROADCAST_SEEDS
    hits = windows.join(F.broadcast(item_side) if small else item_side, ["mask", "seed"])
    shift = F.col("item_at") - F.col("at")  # item index minus document index
    alignments = cut_lineage(hits.select("doc_id", "item_id", shift.alias("shift")).distinct())
    held = alignments.select(F.col("doc_id").alias("seed")).distinct()
    known = document_words(documents, doc_id, text, seed_table(held, held.count()))
    its = words.withColumnRenamed("words", "item_words")
    one = alignments.join(known, "doc_id").join(F.broadcast(its) if small else its, "item_id")
    first = F.greatest(F.lit(0), -F.col("shift"))
    last = F.least(F.size("words"), F.size("item_words") - F.col("shift"))
    length = F.greatest(last - first, F.lit(0))  # of repeated documents one may be too short
    mine = F.slice("words", first + 1, length)
    theirs = F.slice("item_words", first + F.col("shift") + 1, length)
    equal = one.select("doc_id", "item_id", F.zip_with(mine, theirs, lambda a, b: a == b).alias("_same"))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("total"))

    def step(state, same):
        run = F.when(same, state["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(state["best"], run).alias("best"), (state["total"] + same.cast("int")).alias("total"))

    return (
        equal.withColumn("_r", F.aggregate("_same", start, step))
        .groupBy("doc_id", "item_id").agg(F.max("_r.best").alias("longest_run"), F.max("_r.total").alias("overlap"))
    )
