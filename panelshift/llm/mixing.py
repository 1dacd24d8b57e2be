"""Mixing documents of several sources to target weights by weighted fair queueing.

Documents are shuffled by an md5 hash. A document's virtual finish time is its source's cumulative tokens divided by the source's
weight; further uses of a document follow after all documents of its source. Taking all uses in the order of their finish times until
the budget is spent gives each source its share for as long as it lasts. Cumulative sums are made in two steps: sums
per range of hashes (or of finish times) first, whose prefix sums are small, then within each range; no source or range of
times is ever gathered in one task.
"""

from __future__ import annotations

import base64
import importlib
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelshift.operators.ordering import running_sum
from panelshift.session import cut_lineage

#: Ranges of finish times up to one budget; beyond, ranges per doubling.
RANGES, PER_DOUBLING = 4096, 64
# White space as the tokenizer's pattern knows it (as a regular expression's set), and the pattern's parts.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def tokenizer_folder() -> str:
    return str(Path(importlib.import_module("public_tokenizers").__file__).parent)


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).open("rb"))}
    return tiktoken.Encoding(Path(path).stem, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def token_counter(path: str):
    """Counts a text's tokens under the byte-level vocabulary at `path`.

    The public pattern leaves the last white space of a run to the word after it, which needs a look-ahead and makes the
    tokenizer slow. Here all but that last one is taken out of each run before and counted apart, which gives the same tokens.
    """
    encoding = _encoding(path)
    run = re.compile(f"[{WHITE}]+(?=[{WHITE}][^{WHITE}])")
    blank = re.compile(f"[{WHITE}]")
    blanks_ = "".join(chr(c) for c in range(0x3001) if blank.match(chr(c)))
    sizes: dict[str, int] = {}

    def size(blanks: str) -> int:
        if len(blanks) > 64:
            return len(encoding.encode_ordinary(blanks))
        if blanks not in sizes:
            sizes[blanks] = len(encoding.encode_ordinary(blanks))
        return sizes[blanks]

    def count(text: str) -> int:
        body = text.rstrip(blanks_)
        total = size(text[len(body) :]) if len(body) < len(text) else 0

        def take(match: re.Match) -> str:
            nonlocal total
            total += size(match.group())
            return ""

        rest = len(encoding.encode_ordinary(run.sub(take, body)))
        return total + rest

    return count


def clean_source(source: Column) -> Column:
    """Letter case, surrounding blanks and '-' against '_' make no difference."""
    return F.replace(F.lower(F.trim(source)), F.lit("-"), F.lit("_"))


def token_sizes(documents: DataFrame, doc_id: str, source: str, text: str, vocabulary: str) -> DataFrame:
    """(doc_id, source, tokens) with clean sources, stored once; a NULL or empty text has 0 tokens. Spark sends the vocabulary file to the workers."""
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = Path(vocabulary).name

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(SparkFiles.get(name))
        for batch in batches:
            tokens = [count(t) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], ["doc_id", "source", "tokens"])

    chosen = documents.select(F.col(doc_id).cast("long").alias("doc_id"), clean_source(F.col(source)).alias("source"), text)
    return cut_lineage(chosen.mapInArrow(read, "doc_id long, source string, tokens long"))


def finish_times(sizes: DataFrame, weights: DataFrame, seed: int = 0) -> DataFrame:
    """Every use of every document of a weighted source: doc_id, source, tokens, use_no (from 1), finish.

    `weights`: source, target_share, max_repeats (uses in all). Documents of other sources, and sources with a share that is not
    above 0 or no use allowed, are left out.
    """
    used = weights.filter((F.col("target_share") > 0) & (F.col("max_repeats") > 0)).select("source", "target_share", "max_repeats")
    rows = sizes.join(F.broadcast(used), "source").withColumn("_hash", F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("doc_id").cast("string"))))
    placed = rows.withColumn("_range", F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int"))
    ordered = running_sum(placed, ["source"], "_range", ["_hash", "doc_id"], "tokens", "_sum")
    totals = sizes.groupBy("source").agg(F.sum("tokens").alias("_total"))
    again = ordered.join(F.broadcast(totals.join(used.select("source"), "source", "left_semi")), "source").withColumn("use_no", F.explode(F.sequence(F.lit(1), "max_repeats")))
    return again.select("doc_id", "source", "tokens", "use_no", (((F.col("use_no") - 1) * F.col("_total") + F.col("_sum")) / F.col("target_share")).alias("finish"))


def _budget(sizes: DataFrame, weights: DataFrame) -> int:
    """Tokens of all weighted sources, each document once."""
    return sizes.join(F.broadcast(weights.select("source")), "source", "left_semi").agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]


def mixture(sizes: DataFrame, weights: DataFrame, budget: int | None = None, seed: int = 0) -> DataFrame:
    """The uses taken within `budget` tokens, in order of finish time: as finish_times, and `running` (tokens so far).

    Without a budget it is the size of all weighted sources, each document once. `sizes` should be stored, it is read
    more than once.
    """
    budget = _budget(sizes, weights) if budget is None else budget
    uses = finish_times(sizes, weights, seed)
    # Finish times count tokens of the whole mixture, so ranges of equal width hold about equal numbers of tokens until sources run dry.
    part = F.try_divide(F.col("finish"), F.lit(float(max(budget, 1))))
    place = F.when(part < 1, F.floor(part * RANGES)).otherwise(RANGES + F.floor(F.log2(part) * PER_DOUBLING)).cast("int")
    summed = running_sum(uses.withColumn("_range", place), [], "_range", ["finish", "source", "doc_id", "use_no"], "tokens", "running")
    return summed.filter(F.col("running") <= budget).drop("_range")


def mixture_report(sizes: DataFrame, weights: DataFrame, budget: int | None = None, seed: int = 0) -> DataFrame:
    """Per weighted source: its tokens, the tokens taken, target and actual share, and the most uses of a document."""
    taken = mixture(sizes, weights, budget, seed).groupBy("source").agg(F.sum("tokens").alias("taken_tokens"), F.max("use_no").alias("most_uses"))
    own = sizes.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    both = weights.join(own, "source", "left").join(taken, "source", "left").fillna(0, ["source_tokens", "taken_tokens", "most_uses"])
    share = F.try_divide(F.col("taken_tokens").cast("double"), F.sum("taken_tokens").over(Window.partitionBy()))
    return both.select(*weights.columns, "source_tokens", "taken_tokens", "most_uses", share.alias("actual_share"))


def sources_running_dry(sizes: DataFrame, weights: DataFrame, seed: int = 0) -> DataFrame:
    """Rows of `weights` whose last use finishes, in virtual time, before a budget of one pass over everything is spent.

    A source's last finish time is its size times its uses over its share, so these sources cannot fill their share. Sources
    without any document are among them.
    """
    ends = finish_times(sizes, weights, seed).groupBy("source").agg(F.max("finish").alias("_end"))
    return weights.filter("target_share > 0").join(ends, "source", "left").filter(F.coalesce("_end", F.lit(0.0)) < float(_budget(sizes, weights))).drop("_end")
