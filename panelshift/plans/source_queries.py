"""Queries that write given tables with the sinks into the shared folder, read them with the readers, and check what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelshift.functions.scalars import is_finite
from panelshift.operators.support import release_list
from panelshift.plans.data_checks import sound_links
from panelshift.plans.release_queries import _rounded
from panelshift.session import intermediate_path
from panelshift.sources import sinks, tables
from panelshift.sources.tables import load

#: How NULL is written where empty texts occur.
NULL = "\\N"
LINKS = ["link_id", "archive_id", "load_no", "protein1", "protein2", "combined_score"]


def csv_export(spark: SparkSession, d: str) -> DataFrame:
    """All links through an ordered CSV export and its reader."""
    rows, path = load(spark, d, "protein_links", LINKS), intermediate_path(spark, ".csv")
    sinks.write_csv(rows, path, ["archive_id", "link_id"], null=NULL)
    return tables.read_rows(spark, path, rows.schema, NULL)


def json_lines_export(spark: SparkSession, d: str) -> DataFrame:
    """All raw records through compressed JSON lines and their reader."""
    rows, path = load(spark, d, "score_records", ["record_id", "feed_id", "file_seq", "payload"]), intermediate_path(spark, ".jsonl.gz")
    sinks.write_json_lines(rows, path, ["record_id"])
    return tables.read_rows(spark, path, rows.schema)


def edge_list(spark: SparkSession, d: str) -> DataFrame:
    """All sound links through a compressed list of edges whose fields are separated by blanks; links per pair as delivered."""
    rows, path = sound_links(spark, d).select("protein1", "protein2", "combined_score"), intermediate_path(spark, ".txt.gz")
    sinks.write_csv(rows, path, ["protein1", "protein2"], separator=" ", compression="gzip")
    return tables.read_rows(spark, path, rows.schema).groupBy("protein1", "protein2").agg(F.count("*").alias("links"), F.max("combined_score").alias("best_score"))


def merged_parts(spark: SparkSession, d: str) -> DataFrame:
    """All links through one table to which the loads of the second half are appended after a check of its schema."""
    rows, path = load(spark, d, "protein_links", LINKS), intermediate_path(spark, ".parquet")
    late = F.coalesce(F.col("load_no") > 3, F.lit(False))
    sinks.write_ordered(rows.filter(~late), path, ["link_id"])
    sinks.append_checked(rows.filter(late).select(*sorted(LINKS)), path)
    return tables.read_rows(spark, path).groupBy("archive_id", "load_no").agg(F.count("*").alias("links"), F.sum("link_id").alias("id_sum"))


def release_parts(spark: SparkSession, d: str) -> DataFrame:
    """Associations through one table per release, the first of which names its score otherwise, and their union with the file of each row."""
    rows = load(spark, d, "association_support", ["release_id", "disease_id", "target_id", "score"])
    names = release_list(rows)
    paths = {r: intermediate_path(spark, ".parquet") for r in names}
    for r, path in paths.items():
        part = rows.filter(F.col("release_id") == r).drop("release_id")
        sinks.write_ordered(part.withColumnRenamed("score", "value") if r == names[0] else part, path, ["disease_id", "target_id"])
    union = tables.release_union(spark, paths, {names[0]: {"value": "score"}})
    finite = F.when(is_finite(F.col("score")), F.col("score").cast("decimal(38,9)"))
    sums = union.groupBy("release_id").agg(F.count("*").alias("rows"), F.count("disease_id").alias("disease_ids"), F.count("source_file").alias("with_file"), F.sum(finite).cast("double").alias("score_sum"))
    return _rounded(sums)


def scan_assertions(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the associations against the rules of a scan."""
    rows = load(spark, d, "association_support", ["release_id", "disease_id", "target_id", "score", "evidence_count", "record_present", "record_state"])
    score = F.col("score")
    return tables.rule_violations(rows, {
        "keys_present": F.col("release_id").isNotNull() & F.col("disease_id").isNotNull() & F.col("target_id").isNotNull(), "score_finite": is_finite(score), "score_in_bounds": is_finite(score) & score.between(0, 1),
        "evidence_positive": F.col("evidence_count") >= 1, "presence_known": F.col("record_present").isNotNull(), "absent_without_score": F.coalesce("record_present", F.lit(False)) | score.isNull(),
    })


QUERIES = {f.__name__: f for f in (csv_export, json_lines_export, edge_list, merged_parts, release_parts, scan_assertions)}

# The same in SQL.

ORACLE = {
    "csv_export": f"SELECT {', '.join(LINKS)} FROM protein_links",
    "json_lines_export": "SELECT record_id, feed_id, file_seq, payload FROM score_records",
    "edge_list": r"""SELECT protein1, protein2, count(*) AS links, max(combined_score) AS best_score FROM protein_links WHERE regexp_full_match(protein1, '9606\.ENSP[0-9]{11}') AND regexp_full_match(protein2, '9606\.ENSP[0-9]{11}')
AND combined_score BETWEEN 0 AND 1000 AND combined_score = floor(combined_score) GROUP BY 1, 2""",
    "merged_parts": "SELECT archive_id, load_no, count(*) AS links, sum(link_id)::BIGINT AS id_sum FROM protein_links GROUP BY 1, 2",
    "release_parts": "SELECT release_id, count(*) AS rows, count(disease_id) AS disease_ids, count(*) AS with_file, round(sum(CASE WHEN isfinite(score) THEN score::DECIMAL(38,9) END)::DOUBLE, 9) AS score_sum FROM association_support WHERE release_id IS NOT NULL GROUP BY 1",
    "scan_assertions": """SELECT unnest(['keys_present', 'score_finite', 'score_in_bounds', 'evidence_positive', 'presence_known', 'absent_without_score']) AS rule, unnest([count(*) FILTER (release_id IS NULL OR disease_id IS NULL OR target_id IS NULL),
count(*) FILTER (NOT coalesce(isfinite(score), false)), count(*) FILTER (NOT coalesce(isfinite(score) AND score BETWEEN 0 AND 1, false)), count(*) FILTER (NOT coalesce(evidence_count >= 1, false)), count(*) FILTER (record_present IS NULL),
count(*) FILTER (NOT (coalesce(record_present, false) OR score IS NULL))]) AS violations FROM association_support""",
}
