"""Queries p1, p2, p3, p4 and p6 over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelshift.functions.scalars import affirmative, clean_disease, clean_target
from panelshift.operators import drift, orphans, profile, selection, snapshots
from panelshift.session import cut_lineage
from panelshift.sources.tables import load, table_path

PROTEIN = r"9606\.ENSP[0-9]{11}"
LINK_CHECKS = profile.Checks(("archive_id", "load_no"), "link_id", {"protein1": PROTEIN, "protein2": PROTEIN}, {"combined_score": (0.0, 1000.0)})
ROLES = {"old_score": "old_score_field", "new_score": "new_score_field", "old_evidence_count": "old_evidence_count_field", "new_evidence_count": "new_evidence_count_field"}


# p1: a few keys holding most records


def sound_links(spark: SparkSession, d: str) -> DataFrame:
    links = load(spark, d, "protein_links", ["archive_id", "protein1", "protein2", "combined_score"])
    score = F.col("combined_score")
    return links.filter(F.col("protein1").rlike(f"^{PROTEIN}$") & F.col("protein2").rlike(f"^{PROTEIN}$") & score.between(0, 1000) & (score == F.floor(score)))


def anchor_degrees(spark: SparkSession, d: str) -> DataFrame:
    partners = selection.linked_partners(sound_links(spark, d), "archive_id", "protein1", "protein2", "combined_score")
    return selection.per_key_ranks(partners, ["scope", "node"], "score", {"median_score": 0.5}, {"degree_150": 150.0, "degree_400": 400.0, "degree_700": 700.0})


def disease_shares(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "association_support", ["release_id", "disease_id", "score"]).withColumn("disease_id", clean_disease("disease_id"))
    return selection.key_shares(rows, "release_id", "disease_id", "score", {"score_q50": 0.5, "score_q90": 0.9, "score_q99": 0.99})


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Registry anchors whose degree is wrong or NULL, and diseases with at least 2.5 % of a release's rows."""
    partners = selection.linked_partners(sound_links(spark, d), "archive_id", "protein1", "protein2", "combined_score")
    degrees = selection.per_key_ranks(partners, ["scope", "node"], "score", cuts={"degree_150": 150.0})
    registry = load(spark, d, "baseline_anchor_registry", ["archive_id", "anchor_id", "baseline_degree_150"])
    held = registry.join(degrees, (F.col("archive_id") == F.col("scope")) & (F.col("anchor_id") == F.col("node")), "left")
    wrong = held.filter(~F.col("baseline_degree_150").cast("long").eqNullSafe(F.coalesce("degree_150", F.lit(0))))
    rows = load(spark, d, "association_support", ["release_id", "disease_id", "score"]).withColumn("disease_id", clean_disease("disease_id"))
    hot = selection.key_shares(rows, "release_id", "disease_id", "score").filter((F.col("share") >= 0.025) & F.col("disease_id").isNotNull())
    return (
        wrong.select(F.lit("anchor_id").alias("field_name"), F.col("archive_id").alias("scope_id"), F.col("anchor_id").alias("key_value"))
        .unionByName(hot.select(F.lit("disease_id").alias("field_name"), F.col("release_id").alias("scope_id"), F.col("disease_id").alias("key_value")))
        .distinct()
    )


def p1_anchor_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Partners of every linked protein at three score cuts, and the median of its partners' best scores."""
    return anchor_degrees(spark, d).select(F.col("scope").alias("archive_id"), F.col("node").alias("anchor_id"), F.col("n_rows").alias("partners"), "median_score", "degree_150", "degree_400", "degree_700")


def p1_disease_shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows, share of the release and score quantiles of every disease, the hot ones like the others."""
    return disease_shares(spark, d).select("release_id", "disease_id", "n_rows", "n_values", "score_q50", "score_q90", "score_q99", F.round("share", 9).alias("share"))


# p2: column-level data quality profile


def link_facts(spark: SparkSession, d: str) -> DataFrame:
    return profile.chunk_facts(profile.footers(spark, table_path(d, "protein_links"), LINK_CHECKS), LINK_CHECKS)


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per archive, load and column: rows, nulls, distinct values, sound values and their mean, extrema."""
    group = F.col("group_values")
    return profile.column_profile(link_facts(spark, d)).select(
        group[0].alias("archive_id"), group[1].cast("int").alias("load_no"), "column_name", "n_rows", "null_rows", "distinct_values",
        "sound_rows", F.round("sound_mean", 6).alias("sound_mean"), "lowest", "highest",
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Row findings of protein_links and findings of a load against the load before it."""
    facts = cut_lineage(link_facts(spark, d))
    group = F.col("group_values")
    place = [group[0].alias("archive_id"), group[1].cast("int").alias("load_no")]
    rows = facts.filter("kind = 'row'").select(*place, "column_name", "finding", F.col("row_id").alias("link_id"))
    loads = profile.load_shifts(profile.column_profile(facts).select(*place, "*"), "archive_id", "load_no")
    return rows.unionByName(loads.withColumn("link_id", F.lit(0).cast("long"))).distinct()


# p3: references to records that do not exist


def crosswalk_entries(spark: SparkSession, d: str) -> DataFrame:
    diseases = load(spark, d, "disease_crosswalk", ["release_id", "canonical_disease_id"])
    targets = load(spark, d, "target_crosswalk", ["release_id", "canonical_target_id"])
    return diseases.select(F.lit("disease").alias("key_kind"), "release_id", clean_disease("canonical_disease_id").alias("key")).unionByName(
        targets.select(F.lit("target").alias("key_kind"), "release_id", clean_target("canonical_target_id").alias("key"))
    )


def entity_references(spark: SparkSession, d: str) -> DataFrame:
    support = load(spark, d, "association_support", ["release_id", "disease_id", "target_id"])
    members = load(spark, d, "fixed_ranking_panel_members", ["new_release", "canonical_disease_id", "canonical_target_id"])

    def both(df: DataFrame, table: str, release: str, disease: str, target: str) -> DataFrame:
        fields = F.array(
            F.struct(F.lit(disease).alias("ref_field"), F.lit("disease").alias("key_kind"), clean_disease(disease).alias("ref_key")),
            F.struct(F.lit(target).alias("ref_field"), F.lit("target").alias("key_kind"), clean_target(target).alias("ref_key")),
        )
        return df.select(F.lit(table).alias("ref_table"), F.col(release).alias("release_id"), F.inline(fields))

    return both(support, "association_support", "release_id", "disease_id", "target_id").unionByName(
        both(members, "fixed_ranking_panel_members", "new_release", "canonical_disease_id", "canonical_target_id")
    )


def unstable_members(spark: SparkSession, d: str) -> DataFrame:
    """Members called stable whose disease has an entry that is not, by a semi join: the definition asks for entries that are there, not for missing ones."""
    members = load(spark, d, "fixed_ranking_panel_members", ["new_release", "canonical_disease_id", "stable_entity_member"]).filter("stable_entity_member")
    called = members.select(F.col("new_release").alias("release_id"), clean_disease("canonical_disease_id").alias("ref_key")).filter("ref_key is not null").distinct()
    entries = load(spark, d, "disease_crosswalk", ["release_id", "canonical_disease_id", "stable_entity_eligible"]).filter(~affirmative(F.col("stable_entity_eligible")))
    not_stable = entries.select("release_id", clean_disease("canonical_disease_id").alias("ref_key")).filter("ref_key <> ''")
    return called.join(not_stable, ["release_id", "ref_key"], "left_semi").select(
        F.lit("fixed_ranking_panel_members").alias("ref_table"), F.lit("canonical_disease_id").alias("ref_field"), "release_id", "ref_key", F.lit("UNSTABLE").alias("orphan_kind")
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, field and release, and members called stable against the crosswalk."""
    return orphans.orphan_references(entity_references(spark, d), crosswalk_entries(spark, d)).unionByName(unstable_members(spark, d)).distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan keys counted per table, field, release and kind."""
    return orphans.orphan_report(orphans.orphan_references(entity_references(spark, d), crosswalk_entries(spark, d)))


# p4: what changed between full snapshots


def present_states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, d, "association_support", ["release_id", "disease_id", "target_id", "score", "evidence_count", "record_present", "loaded_at"])
    clean = rows.withColumns({"disease_id": clean_disease("disease_id"), "target_id": clean_target("target_id")})
    last = snapshots.latest_rows(clean, "release_id", ["disease_id", "target_id"], "loaded_at", ["record_present", "score", "evidence_count"])
    return last.filter("record_present"), load(spark, d, "association_support", ["release_id"])


def p4_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive releases in which a pair is there and unchanged."""
    rows, releases = present_states(spark, d)
    runs = snapshots.validity_intervals(rows, releases, "release_id", ["disease_id", "target_id"], ["evidence_count"], {"score": 1e-9})
    return runs.select("disease_id", "target_id", F.col("first").alias("first_release"), F.col("last").alias("last_release"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs added, removed or changed from each release to the next."""
    rows, releases = present_states(spark, d)
    runs = snapshots.validity_intervals(rows, releases, "release_id", ["disease_id", "target_id"], ["evidence_count"], {"score": 1e-9})
    return snapshots.change_events(runs, releases, "release_id", ["disease_id", "target_id"])


# p6: schemas that drift between files


def feed_profiles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    records = load(spark, d, "score_records", ["record_id", "feed_id", "file_seq", "payload"])
    files = load(spark, d, "score_revision", ["feed_id", "file_seq", *ROLES.values()])
    fields = drift.payload_fields(records, "payload", ["record_id", "feed_id", "file_seq"])
    roles = drift.declared_roles(files, "feed_id", "file_seq", ROLES)
    profiles = drift.with_roles(drift.field_profiles(fields, "feed_id", "file_seq"), roles, "feed_id", "file_seq")
    return fields, roles, profiles


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Fields added, removed, renamed or retyped from file to file.

    All fields are matched by role, name, types and values; an exact check then keeps the matches that the files declare, as the definition asks.
    """
    profiles = cut_lineage(feed_profiles(spark, d)[2])
    matches = cut_lineage(drift.match_fields(profiles, "feed_id", "file_seq").filter("declared"))
    return drift.schema_changes(profiles, matches, "feed_id", "file_seq")


def p6_suspected_renames(spark: SparkSession, d: str) -> DataFrame:
    """Matches by name, types and values that the files don't declare: fields that may have been renamed."""
    matches = drift.match_fields(cut_lineage(feed_profiles(spark, d)[2]), "feed_id", "file_seq").filter("not declared")
    return matches.select("feed_id", "file_seq", "old_name", "new_name", F.round("weight", 6).alias("weight"))


def p6_unified(spark: SparkSession, d: str) -> DataFrame:
    """The four roles of every record as DOUBLE, whatever the file calls or types them; all other fields are in p6_unified_fields."""
    fields, roles, _ = feed_profiles(spark, d)
    return drift.unified_roles(fields, roles, "record_id", "feed_id", "file_seq", list(ROLES))


def p6_unified_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every field of every record, roles and all others, under one identity over the files of its feed."""
    records = load(spark, d, "score_records", ["record_id", "feed_id", "file_seq", "payload"])
    fields, roles, profiles = feed_profiles(spark, d)
    profiles = cut_lineage(profiles)
    matches = drift.match_fields(profiles, "feed_id", "file_seq")
    identities = drift.field_identities(profiles, matches, "feed_id", "file_seq")
    return drift.unified_fields(records, fields, roles, identities, "record_id", "feed_id", "file_seq", "payload")


QUERIES = {
    "p1_found": p1_found, "p1_anchor_degrees": p1_anchor_degrees, "p1_disease_shares": p1_disease_shares,
    "p2_found": p2_found, "p2_profile": p2_profile, "p3_found": p3_found, "p3_report": p3_report,
    "p4_found": p4_found, "p4_intervals": p4_intervals, "p6_found": p6_found, "p6_suspected_renames": p6_suspected_renames, "p6_unified": p6_unified,
    "p6_unified_fields": p6_unified_fields,
}

# The same in SQL.

_SOUND = r"""sound AS (SELECT archive_id, protein1 a, protein2 b, combined_score s FROM protein_links
  WHERE regexp_full_match(protein1, '9606\.ENSP[0-9]{11}') AND regexp_full_match(protein2, '9606\.ENSP[0-9]{11}')
  AND combined_score BETWEEN 0 AND 1000 AND combined_score = floor(combined_score) AND protein1 <> protein2),
partners AS (SELECT archive_id, node, other, max(s) s FROM (SELECT archive_id, a node, b other, s FROM sound UNION ALL SELECT archive_id, b, a, s FROM sound) GROUP BY 1, 2, 3)"""
_DISEASE = "replace(upper(trim({})), ':', '_')"
_TARGET = r"regexp_replace(upper(trim({})), '\.[0-9]+$', '')"
_FINITE = "CASE WHEN isfinite(score) THEN score + 0.0 END"
_FINDINGS = r"""facts AS (
  SELECT archive_id, load_no, link_id, 'protein1' column_name, protein1 v, protein1 IS NULL is_null, protein1 IS NOT NULL AND NOT regexp_full_match(protein1, '9606\.ENSP[0-9]{11}') pattern, false outside, false broken, NULL::DOUBLE x FROM protein_links
  UNION ALL SELECT archive_id, load_no, link_id, 'protein2', protein2, protein2 IS NULL, protein2 IS NOT NULL AND NOT regexp_full_match(protein2, '9606\.ENSP[0-9]{11}'), false, false, NULL FROM protein_links
  UNION ALL SELECT archive_id, load_no, link_id, 'combined_score', combined_score::VARCHAR, combined_score IS NULL, false, coalesce(combined_score < 0 OR combined_score > 1000, false), coalesce(combined_score <> floor(combined_score), false), combined_score FROM protein_links),
loads AS (SELECT archive_id, load_no, column_name, count(*) n, count(*) FILTER (is_null) nulls, count(DISTINCT v) FILTER (NOT is_null) vals,
  count(x) FILTER (NOT outside AND NOT broken) sound, avg(x) FILTER (NOT outside AND NOT broken) mean, min(x) lo, max(x) hi FROM facts GROUP BY 1, 2, 3)"""
_REFS = f"""parents AS (SELECT 'disease' kind, release_id, {_DISEASE.format('canonical_disease_id')} k FROM disease_crosswalk
  UNION SELECT 'target', release_id, {_TARGET.format('canonical_target_id')} FROM target_crosswalk),
refs AS (SELECT 'association_support' ref_table, 'disease_id' ref_field, 'disease' kind, release_id, {_DISEASE.format('disease_id')} ref_key FROM association_support
  UNION SELECT 'association_support', 'target_id', 'target', release_id, {_TARGET.format('target_id')} FROM association_support
  UNION SELECT 'fixed_ranking_panel_members', 'canonical_disease_id', 'disease', new_release, {_DISEASE.format('canonical_disease_id')} FROM fixed_ranking_panel_members
  UNION SELECT 'fixed_ranking_panel_members', 'canonical_target_id', 'target', new_release, {_TARGET.format('canonical_target_id')} FROM fixed_ranking_panel_members),
known AS (SELECT kind, k, min(release_id) lo, max(release_id) hi FROM parents WHERE k <> '' GROUP BY 1, 2),
orphans AS (SELECT ref_table, ref_field, r.release_id, ref_key, CASE WHEN lo IS NULL THEN 'NEVER' WHEN lo < r.release_id AND hi > r.release_id THEN 'GAP' WHEN lo < r.release_id THEN 'EARLIER' ELSE 'LATER' END orphan_kind
  FROM refs r LEFT JOIN known ON known.kind = r.kind AND k = ref_key WHERE ref_key IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM parents p WHERE p.kind = r.kind AND p.release_id = r.release_id AND p.k = r.ref_key AND p.k <> ''))"""
_STATES = f"""releases AS (SELECT release_id, row_number() OVER (ORDER BY release_id) no FROM (SELECT DISTINCT release_id FROM association_support WHERE release_id IS NOT NULL)),
ranked AS (SELECT release_id, {_DISEASE.format('disease_id')} d, {_TARGET.format('target_id')} t, record_present, score, evidence_count,
  row_number() OVER (PARTITION BY release_id, d, t ORDER BY loaded_at DESC NULLS LAST) rn FROM association_support),
present AS (SELECT no, d, t, score, evidence_count e FROM ranked JOIN releases USING (release_id) WHERE rn = 1 AND d IS NOT NULL AND t IS NOT NULL AND record_present)"""
_SAME = "(o.e IS NOT DISTINCT FROM n.e AND (o.score IS NOT DISTINCT FROM n.score OR abs(o.score - n.score) <= 1e-9))"
_FIELDS = """roles AS (SELECT feed_id, file_seq, unnest(['old_score', 'new_score', 'old_evidence_count', 'new_evidence_count']) AS role, unnest([o, n, oe, ne]) AS name FROM (
  SELECT feed_id, file_seq, last_value(old_score_field IGNORE NULLS) OVER w o, last_value(new_score_field IGNORE NULLS) OVER w n, last_value(old_evidence_count_field IGNORE NULLS) OVER w oe,
  last_value(new_evidence_count_field IGNORE NULLS) OVER w ne FROM score_revision WINDOW w AS (PARTITION BY feed_id ORDER BY file_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))),
cells AS (SELECT record_id, feed_id, file_seq, unnest(json_keys(payload)) AS name, payload FROM score_records),
typed AS (SELECT record_id, feed_id, file_seq, name, json_type(payload, '$."' || name || '"') jt, payload ->> ('$."' || name || '"') AS val FROM cells)"""

ORACLE = {
    "p1_found": f"""WITH {_SOUND}, degrees AS (SELECT archive_id, node, count(*) FILTER (s >= 150) degree FROM partners GROUP BY 1, 2),
shares AS (SELECT release_id, {_DISEASE.format('disease_id')} d, count(*) n, sum(count(*)) OVER (PARTITION BY release_id) total FROM association_support GROUP BY 1, 2)
SELECT DISTINCT 'anchor_id' AS field_name, r.archive_id AS scope_id, anchor_id AS key_value FROM baseline_anchor_registry r LEFT JOIN degrees g ON g.archive_id = r.archive_id AND node = anchor_id
WHERE baseline_degree_150 IS DISTINCT FROM coalesce(degree, 0)
UNION SELECT 'disease_id', release_id, d FROM shares WHERE d IS NOT NULL AND n / total >= 0.025""",
    "p1_anchor_degrees": f"""WITH {_SOUND} SELECT archive_id, node AS anchor_id, count(*) AS partners, quantile_disc(s, 0.5) AS median_score, count(*) FILTER (s >= 150) AS degree_150,
count(*) FILTER (s >= 400) AS degree_400, count(*) FILTER (s >= 700) AS degree_700 FROM partners GROUP BY 1, 2""",
    "p1_disease_shares": f"""SELECT release_id, {_DISEASE.format('disease_id')} AS disease_id, count(*) AS n_rows, count({_FINITE}) AS n_values, quantile_disc({_FINITE}, 0.5) AS score_q50,
quantile_disc({_FINITE}, 0.9) AS score_q90, quantile_disc({_FINITE}, 0.99) AS score_q99, round(count(*) / sum(count(*)) OVER (PARTITION BY release_id), 9) AS share FROM association_support GROUP BY 1, 2""",
    "p2_found": f"""WITH {_FINDINGS}, shifts AS (SELECT *, lag(n) OVER w on_, lag(nulls) OVER w onulls, lag(vals) OVER w ovals, lag(mean) OVER w omean FROM loads WINDOW w AS (PARTITION BY archive_id, column_name ORDER BY load_no))
SELECT archive_id, load_no, column_name, 'NULL_VALUE' AS finding, link_id FROM facts WHERE is_null
UNION SELECT archive_id, load_no, column_name, 'PATTERN', link_id FROM facts WHERE pattern
UNION SELECT archive_id, load_no, column_name, 'OUT_OF_RANGE', link_id FROM facts WHERE outside
UNION SELECT archive_id, load_no, column_name, 'NOT_INTEGER', link_id FROM facts WHERE broken
UNION SELECT archive_id, load_no, column_name, 'NULL_SHIFT', 0 FROM shifts WHERE abs(nulls / n - onulls / on_) > 0.03
UNION SELECT archive_id, load_no, column_name, 'DISTINCT_SHIFT', 0 FROM shifts WHERE vals > 2 * ovals OR 2 * vals < ovals
UNION SELECT archive_id, load_no, column_name, 'MEAN_SHIFT', 0 FROM shifts WHERE abs(mean - omean) > 60""",
    "p2_profile": f"""WITH {_FINDINGS} SELECT archive_id, load_no, column_name, n AS n_rows, nulls AS null_rows, vals AS distinct_values,
CASE WHEN column_name = 'combined_score' THEN sound END AS sound_rows, round(mean, 6) AS sound_mean, lo AS lowest, hi AS highest FROM loads""",
    "p3_found": f"""WITH {_REFS} SELECT * FROM orphans UNION
SELECT 'fixed_ranking_panel_members', 'canonical_disease_id', new_release, {_DISEASE.format('m.canonical_disease_id')}, 'UNSTABLE' FROM fixed_ranking_panel_members m
WHERE stable_entity_member AND EXISTS (SELECT 1 FROM disease_crosswalk c WHERE c.release_id = m.new_release AND {_DISEASE.format('c.canonical_disease_id')} = {_DISEASE.format('m.canonical_disease_id')}
AND trim(c.canonical_disease_id) <> '' AND coalesce(lower(trim(stable_entity_eligible)) NOT IN ('true', '1'), true))""",
    "p3_report": f"WITH {_REFS} SELECT ref_table, ref_field, release_id, orphan_kind, count(*) AS orphan_keys FROM orphans GROUP BY 1, 2, 3, 4",
    "p4_found": f"""WITH {_STATES}, pairs AS (SELECT a.no ono, a.release_id old_release, b.release_id new_release FROM releases a JOIN releases b ON b.no = a.no + 1)
SELECT old_release, new_release, n.d AS disease_id, n.t AS target_id, 'ADDED' AS change_kind FROM pairs JOIN present n ON n.no = ono + 1 LEFT JOIN present o ON o.no = ono AND o.d = n.d AND o.t = n.t WHERE o.d IS NULL
UNION ALL SELECT old_release, new_release, o.d, o.t, 'REMOVED' FROM pairs JOIN present o ON o.no = ono LEFT JOIN present n ON n.no = ono + 1 AND o.d = n.d AND o.t = n.t WHERE n.d IS NULL
UNION ALL SELECT old_release, new_release, o.d, o.t, 'CHANGED' FROM pairs JOIN present o ON o.no = ono JOIN present n ON n.no = ono + 1 AND o.d = n.d AND o.t = n.t WHERE NOT coalesce({_SAME}, false)""",
    "p4_intervals": f"""WITH {_STATES}, marked AS (SELECT n.*, CASE WHEN o.d IS NOT NULL AND coalesce({_SAME}, false) THEN 0 ELSE 1 END starts FROM present n LEFT JOIN present o ON o.no = n.no - 1 AND o.d = n.d AND o.t = n.t),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY d, t ORDER BY no) run FROM marked)
SELECT d AS disease_id, t AS target_id, min(release_id) AS first_release, max(release_id) AS last_release FROM runs JOIN releases USING (no) GROUP BY d, t, run""",
    "p6_found": f"""WITH {_FIELDS}, fields AS (SELECT feed_id, file_seq, name, list_sort(list_distinct(list(CASE WHEN jt IN ('VARCHAR') THEN 'text' WHEN jt = 'ARRAY' THEN 'list' WHEN jt = 'OBJECT' THEN 'object' WHEN jt = 'BOOLEAN' THEN 'boolean' WHEN jt = 'NULL' THEN NULL ELSE 'number' END))) types FROM typed GROUP BY 1, 2, 3),
named AS (SELECT f.*, coalesce('r:' || r.role, 'n:' || lower(replace(f.name, '_', ''))) id FROM fields f LEFT JOIN roles r USING (feed_id, file_seq, name)),
had AS (SELECT *, lag(types) OVER (PARTITION BY feed_id, id ORDER BY file_seq) old_types FROM named WHERE len(types) > 0)
SELECT n.feed_id, n.file_seq, n.name AS field_name, CASE WHEN o.name IS NULL THEN 'ADDED' ELSE 'RENAMED' END AS change_kind FROM named n LEFT JOIN named o ON o.feed_id = n.feed_id AND o.file_seq = n.file_seq - 1 AND o.id = n.id
WHERE n.file_seq > 1 AND o.name IS DISTINCT FROM n.name
UNION SELECT o.feed_id, o.file_seq + 1, o.name, 'REMOVED' FROM named o LEFT JOIN named n ON o.feed_id = n.feed_id AND o.file_seq = n.file_seq - 1 AND o.id = n.id WHERE o.file_seq < 10 AND n.name IS NULL
UNION SELECT feed_id, file_seq, name, 'RETYPED' FROM had WHERE old_types <> types""",
    "p6_unified": f"""WITH {_FIELDS}, given AS (SELECT record_id, feed_id, file_seq, role, coalesce(try_cast(val AS DOUBLE), try_cast(json_extract_string(CASE WHEN jt = 'OBJECT' THEN val END, '$.value') AS DOUBLE)) x FROM typed LEFT JOIN roles USING (feed_id, file_seq, name))
SELECT record_id, feed_id, file_seq, max(x) FILTER (role = 'old_score') AS old_score, max(x) FILTER (role = 'new_score') AS new_score, max(x) FILTER (role = 'old_evidence_count') AS old_evidence_count,
max(x) FILTER (role = 'new_evidence_count') AS new_evidence_count FROM given GROUP BY 1, 2, 3""",
}
