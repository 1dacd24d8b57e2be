"""Controlled edits of panels with known effects, to check comparators against.

Which members an edit touches follows from a hash of (seed, panel, member), so every engine picks the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelshift.functions.scalars import when_chain
from panelshift.operators.ordering import hash_numbered, joined_on, with_quantiles

# The classes of edits, of which the first three have no level, and the levels.
LEVEL_FREE = ("unchanged", "monotone_score_rescaling", "persistent_leader_replacement")
LEVELLED = ("persistent_score_perturbation", "roster_entry", "roster_exit", "exact_reversible_identifier_rename")
LEVELS = (0.01, 0.05, 0.2)


def edited_panels(members: DataFrame, panel: list[str], member: str, score: str, levels: tuple[float, ...] = LEVELS, seed: int = 0) -> DataFrame:
    """Every panel under every edit class and level (NULL for classes without one): panel, scenario, level, member, old_score, new_score (NULL where the member is not).

    A level touches ceil(level * n) members, at least one. Rescaling halves all scores; replacement swaps the scores of the first leader and the first other member by id,
    or halves all but the first leader where all are tied; perturbation moves scores up and down by the level in turn, up to 1; entry adds as many members, the first half of
    them with the best score, the others with the median; exit drops the touched, rename gives them new names.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in panel], F.col(member)))
    known = members.filter(F.col(score).isNotNull()).select(*panel, member, F.col(score).alias("s"))
    sizes = with_quantiles(known.groupBy(*panel).agg(F.count("*").alias("_n"), F.max("s").alias("_best")), known, panel, {"_median": ("s", 0.5)})
    placed = hash_numbered(known, panel, digest, member, "_no").join(sizes, panel)
    firsts = placed.groupBy(*panel).agg(F.min(F.when(F.col("s") == F.col("_best"), F.col(member))).alias("_lead"), F.min(F.when(F.col("s") < F.col("_best"), F.struct(F.col(member).alias("m"), F.col("s").alias("v")))).alias("_other"))
    runs = F.array(*[F.struct(F.lit(c).alias("scenario"), F.lit(level).cast("double").alias("level")) for c, level in [(c, None) for c in LEVEL_FREE] + [(c, x) for c in LEVELLED for x in levels]])
    each = placed.join(firsts, panel).select("*", F.inline(runs)).withColumn("_amount", F.greatest(F.lit(1), F.ceil(F.col("level") * F.col("_n"))))
    hit, case, s, none = F.col("level").isNotNull() & (F.col("_no") <= F.col("_amount")), F.col("scenario"), F.col("s"), F.lit(None).cast("double")
    lead, other = F.col(member) == F.col("_lead"), F.col("_other")
    swapped = F.when(other.isNull(), F.when(lead, s).otherwise(s * 0.5)).when(lead, other["v"]).when(F.col(member) == other["m"], F.col("_best")).otherwise(s)
    turned = F.least(F.lit(1.0), s * (1 + F.when(F.col("_no") % 2 == 1, F.col("level")).otherwise(-F.col("level"))))
    after = when_chain((case == LEVEL_FREE[1], s * 0.5), (case == LEVEL_FREE[2], swapped), ((case == LEVELLED[0]) & hit, turned), (case.isin(*LEVELLED[2:]) & hit, none), otherwise=s)
    entered = F.when(F.col("_no") <= F.ceil(F.col("_amount") / 2), F.col("_best")).otherwise(F.col("_median"))
    new = F.struct(F.concat(F.lit("new:"), F.col(member)).alias(member), none.alias("old_score"), F.when(case == LEVELLED[1], entered).otherwise(s).alias("new_score"))
    own = F.struct(F.col(member).alias(member), s.alias("old_score"), after.alias("new_score"))
    copies = F.when(case.isin(LEVELLED[1], LEVELLED[3]) & hit, new)
    return each.select(*panel, "scenario", "level", F.inline(F.array_compact(F.array(own, copies))))


def scenario_outcomes(edited: DataFrame, panel: list[str]) -> DataFrame:
    """What a comparator finds per panel and scenario: persistent, entering, exiting, changed members and whether the leaders changed."""
    by = [*panel, "scenario", "level"]
    o, n = F.col("old_score"), F.col("new_score")
    best = edited.groupBy(*by).agg(F.max(o).alias("_o"), F.max(n).alias("_n"))
    flags = joined_on(edited, best, by, "inner").withColumns({"_ol": F.coalesce(o == F.col("_o"), F.lit(False)), "_nl": F.coalesce(n == F.col("_n"), F.lit(False))})
    return flags.groupBy(*by).agg(
        F.count_if(o.isNotNull() & n.isNotNull()).alias("persistent"), F.count_if(o.isNull()).alias("entering"), F.count_if(n.isNull()).alias("exiting"),
        F.count_if(o.isNotNull() & n.isNotNull() & (o != n)).alias("changed"), F.bool_or(F.col("_ol") != F.col("_nl")).alias("leaders_changed"),
    )
