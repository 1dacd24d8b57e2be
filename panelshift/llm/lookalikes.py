"""Documents that look the same but are made of other characters."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelshift.llm.canonical_text import broadcast_tables, canonical_strings, portions
from panelshift.session import cut_lineage

#: Documents of one spelling that are joined under one salt with as many of another.
PER_SALT = 3_000


def canonical_classes(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, form, spelling): digests of a document's canonical form and of its very text; NULL texts are left out. No text leaves the tasks."""

    read_as = broadcast_tables(documents.sparkSession)

    def digest(value: str) -> bytes:
        return blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in portions(texts):
                own = texts[part]
                columns = [batch.column(0).slice(part.start, len(own)), pa.array([digest(f) for f in canonical_strings(own, read_as.value)], pa.binary()), pa.array([digest(t) for t in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "form", "spelling"])

    known = documents.filter(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return known.mapInArrow(read, "doc_id long, form binary, spelling binary")


def disguised_pairs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents of one canonical form and different texts.

    Exact copies make no pair with each other, but each copy pairs with every document that differs from it in characters only.
    Spellings of a form are paired first, so forms with one spelling drop out and only documents that make a pair are ever joined; documents of two
    spellings meet by salts on either side, each salt in a block of bounded size. Documents with equal ids and NULL or lone texts make no
    pair; an empty table gives no rows.
    """
    classes = cut_lineage(canonical_classes(documents, doc_id, text).distinct())
    spellings = classes.groupBy("form", "spelling").agg(F.count("*").alias("n"))
    mixed = spellings.groupBy("form").agg(F.count("*").alias("_s")).filter("_s > 1").select("form")
    several = cut_lineage(spellings.join(mixed, "form"))
    sides = [several.select("form", F.col("spelling").alias(f"_s{x}"), (1 + F.floor((F.col("n") - 1) / PER_SALT)).cast("int").alias(f"_n{x}")) for x in "ab"]
    pairs = sides[0].join(sides[1], "form").filter("_sa < _sb")

    def members(x: str, other: str) -> DataFrame:
        """Documents of one spelling of each pair, in their block of it and once for every block of the other."""
        own = classes.select("form", F.col("spelling").alias(f"_s{x}"), F.col("doc_id").alias(f"_d{x}"))
        blocks = own.join(pairs, ["form", f"_s{x}"]).withColumn(f"_p{x}", F.pmod(F.xxhash64(f"_d{x}"), f"_n{x}").cast("int"))
        return blocks.withColumn(f"_p{other}", F.explode(F.sequence(F.lit(0), F.col(f"_n{other}") - 1))).select("form", "_sa", "_sb", "_pa", "_pb", f"_d{x}")

    found = members("a", "b").join(members("b", "a"), ["form", "_sa", "_sb", "_pa", "_pb"]).filter("_da <> _db")
    return found.select(F.least("_da", "_db").alias("doc_id_a"), F.greatest("_da", "_db").alias("doc_id_b")).distinct()


def class_members(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with a text: its class (the least id of its form), the class's documents and spellings."""
    classes = cut_lineage(canonical_classes(documents, doc_id, text))
    sizes = classes.groupBy("form", "spelling").agg(F.count("*").alias("_n"), F.min("doc_id").alias("_least")).groupBy("form").agg(F.min("_least").alias("class_id"), F.sum("_n").alias("class_documents"), F.count("*").alias("class_spellings"))
    return classes.join(sizes, "form").select("doc_id", "class_id", "class_documents", "class_spellings")
