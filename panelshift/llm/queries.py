"""Queries p5, p7, p8 and p9 over the given tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelshift.functions.scalars import clean_disease, clean_target
from panelshift.llm import canonical_text, contamination, lookalikes, mixing, topn
from panelshift.llm.canonical_text import with_canonical_text
from panelshift.sources.tables import load

PANEL = ["support_name", "release_pair", "canonical_disease_id"]
VOCABULARY = "byte_bpe_50k.tiktoken"


def top_targets(spark: SparkSession, d: str, n: int = 10) -> DataFrame:
    rows = load(spark, d, "fixed_ranking_panel_members", [*PANEL, "canonical_target_id", "new_score"])
    clean = rows.withColumns({"canonical_disease_id": clean_disease("canonical_disease_id"), "canonical_target_id": clean_target("canonical_target_id")})
    best = clean.filter(F.col("new_score").between(0, 1)).groupBy(*PANEL, "canonical_target_id").agg(F.max("new_score").alias("new_score"))
    return topn.top_per_group(best, PANEL, "new_score", "canonical_target_id", n)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The ten targets of every panel with the best new score."""
    return top_targets(spark, d).select(*PANEL, "canonical_target_id")


def p5_positions(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best targets of every panel with score and position."""
    return top_targets(spark, d, 20).select(*PANEL, "position", "canonical_target_id", "new_score")


def leaks(spark: SparkSession, d: str) -> DataFrame:
    documents = load(spark, d, "documents", ["doc_id", "text"])
    items = load(spark, d, "eval_items", ["item_id", "text"])
    return contamination.leaked_passages(documents, items)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least ten consecutive words of an item."""
    return leaks(spark, d).filter(F.col("longest_run") >= contamination.SPAN).select("doc_id", "item_id")


def p7_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share a passage with an item, also one with substituted words."""
    return leaks(spark, d).select("doc_id", "item_id", "longest_run", "overlap")


def sizes_and_weights(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = load(spark, d, "documents", ["doc_id", "source", "text"])
    weights = load(spark, d, "source_weights", ["source", "target_share", "max_repeats"]).withColumnRenamed("source", "name").withColumn("source", mixing.clean_source(F.col("name")))
    return mixing.token_sizes(documents, "doc_id", "source", "text", f"{mixing.tokenizer_folder()}/{VOCABULARY}"), weights


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that cannot reach their share of the total size."""
    sizes, weights = sizes_and_weights(spark, d)
    return mixing.sources_running_dry(sizes, weights).select(F.col("name").alias("source")).distinct()


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source when the total size is taken."""
    sizes, weights = sizes_and_weights(spark, d)
    return mixing.mixture_report(sizes, weights).drop("source").withColumnRenamed("name", "source")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture itself: every use of a document with its finish time."""
    sizes, weights = sizes_and_weights(spark, d)
    return mixing.mixture(sizes, weights).select("doc_id", "source", "use_no", "tokens", F.round("finish", 6).alias("finish"))


def character_sizes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = load(spark, d, "documents", ["doc_id", "source", "n_chars"])
    weights = load(spark, d, "source_weights", ["source", "target_share", "max_repeats"]).withColumnRenamed("source", "name").withColumn("source", mixing.clean_source(F.col("name")))
    return documents.select("doc_id", mixing.clean_source(F.col("source")).alias("source"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("tokens")), weights


def p8_report_by_characters(spark: SparkSession, d: str) -> DataFrame:
    """`p8_report` with characters for tokens."""
    sizes, weights = character_sizes(spark, d)
    return mixing.mixture_report(sizes, weights).select(F.col("name").alias("source"), "target_share", "max_repeats", "source_tokens", "taken_tokens", "most_uses", F.round("actual_share", 9).alias("actual_share"))


def p8_mixture_by_characters(spark: SparkSession, d: str) -> DataFrame:
    """`p8_mixture` with characters for tokens."""
    sizes, weights = character_sizes(spark, d)
    return mixing.mixture(sizes, weights).select("doc_id", "source", "use_no", "tokens", F.round("finish", 3).alias("finish"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look the same and differ in their characters."""
    return lookalikes.disguised_pairs(load(spark, d, "documents", ["doc_id", "text"]))


def p9_changed(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text isn't in the canonical form already, with the number of characters before and after."""
    forms = with_canonical_text(load(spark, d, "documents", ["doc_id", "text"]), "text", "form")
    return forms.filter("form <> text").select("doc_id", F.length("text").alias("n_chars"), F.length("form").alias("n_chars_form"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the class of texts that look like it."""
    return lookalikes.class_members(load(spark, d, "documents", ["doc_id", "text"]))


QUERIES = {
    "p5_found": p5_found, "p5_positions": p5_positions, "p7_found": p7_found, "p7_overlaps": p7_overlaps, "p8_found": p8_found,
    "p8_report": p8_report, "p8_mixture": p8_mixture, "p8_report_by_characters": p8_report_by_characters, "p8_mixture_by_characters": p8_mixture_by_characters, "p9_found": p9_found, "p9_classes": p9_classes, "p9_changed": p9_changed,
}

# The same in SQL.


def _form_sql(text: str) -> str:
    """The canonical form in SQL: single characters are translated, joined letters replaced, invisible ones dropped, the rest composed; built from the same fixed values."""
    one, many = {}, {}
    look = canonical_text.LOOK_ALIKES
    for code in range(0x80, 0xFFFF):
        ch = chr(code)
        if 0xD800 <= code <= 0xF8FF or code in canonical_text.INVISIBLE or code in canonical_text.BLANKS:
            continue
        shaped = unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")) or any(a <= code <= b for a, b in canonical_text.LIGATURE_RANGES)
        plain = unicodedata.normalize("NFKD" if shaped else "NFD", ch)
        to = unicodedata.normalize("NFC", "".join(look.get(c, c) for c in plain))
        if to != unicodedata.normalize("NFC", ch):
            (one if len(to) == 1 else many)[ch] = to
    one |= {chr(c): " " for c in canonical_text.BLANKS}
    out = f"nfc_normalize({text})"
    for ch, to in many.items():
        out = f"replace({out}, '{ch}', '{to}')"  # none of them holds a quote
    gone = "".join(map(chr, canonical_text.INVISIBLE))
    read, written = "".join(one) + gone, "".join(one.values()).replace("'", "''")
    return f"nfc_normalize(translate({out}, '{read}', '{written}'))"


_FORMS = f"forms AS (SELECT doc_id, text, {_form_sql('text')} AS form FROM documents WHERE text IS NOT NULL)"
_GRAMS = r"""SELECT {0}, array_to_string(w[i:i+9], ' ') g FROM (SELECT {0}, w, unnest(range(1, len(w) - 8)) i FROM (SELECT {0}, regexp_extract_all(lower(form), '[\p{{L}}\p{{N}}]+') w FROM {1}) WHERE len(w) >= 10)"""
_CHARACTERS = """w AS (SELECT source AS name, replace(lower(trim(source)), '-', '_') s, target_share, max_repeats FROM source_weights),
docs AS (SELECT doc_id, replace(lower(trim(source)), '-', '_') s, coalesce(n_chars, 0) n FROM documents),
ordered AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY md5('0|' || doc_id), doc_id) cum, sum(n) OVER (PARTITION BY s) total FROM docs JOIN w USING (s) WHERE target_share > 0 AND max_repeats > 0),
uses AS (SELECT *, ((use_no - 1) * total + cum) / target_share finish FROM (SELECT *, unnest(range(1, max_repeats + 1)) use_no FROM ordered)),
taken AS (SELECT *, sum(n) OVER (ORDER BY finish, s, doc_id, use_no) running FROM uses QUALIFY running <= (SELECT sum(n) FROM docs WHERE s IN (SELECT s FROM w)))"""

_TOP = r"""ranked AS (SELECT support_name, release_pair, d, t, s, row_number() OVER (PARTITION BY support_name, release_pair, d ORDER BY s DESC, t) AS position FROM (
  SELECT support_name, release_pair, replace(upper(trim(canonical_disease_id)), ':', '_') d, regexp_replace(upper(trim(canonical_target_id)), '\.[0-9]+$', '') t, max(new_score) s
  FROM fixed_ranking_panel_members WHERE new_score BETWEEN 0 AND 1 GROUP BY 1, 2, 3, 4))"""

ORACLE = {
    "p5_found": f"WITH {_TOP} SELECT support_name, release_pair, d AS canonical_disease_id, t AS canonical_target_id FROM ranked WHERE position <= 10",
    "p5_positions": f"WITH {_TOP} SELECT support_name, release_pair, d AS canonical_disease_id, position, t AS canonical_target_id, s AS new_score FROM ranked WHERE position <= 20",
    # The size in characters gives the same sources, as none lies near the line.
    "p8_found": """WITH sized AS (SELECT replace(lower(trim(source)), '-', '_') s, sum(length(text)) n FROM documents GROUP BY 1),
w AS (SELECT source, target_share, max_repeats, coalesce(n, 0) n FROM source_weights LEFT JOIN sized ON s = replace(lower(trim(source)), '-', '_'))
SELECT DISTINCT source FROM w WHERE n * max_repeats < target_share * (SELECT sum(n) FROM w)""",
    "p7_found": f"""WITH {_FORMS}, items AS (SELECT item_id, {_form_sql('text')} AS form FROM eval_items WHERE text IS NOT NULL), ig AS (SELECT DISTINCT * FROM ({_GRAMS.format('item_id', 'items')})), dg AS ({_GRAMS.format('doc_id', 'forms')})
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p8_report_by_characters": f"""WITH {_CHARACTERS}, got AS (SELECT s, sum(n) t, max(use_no) u FROM taken GROUP BY 1), own AS (SELECT s, sum(n) n FROM docs GROUP BY 1)
SELECT name AS source, target_share, max_repeats, coalesce(own.n, 0)::BIGINT AS source_tokens, coalesce(t, 0)::BIGINT AS taken_tokens, coalesce(u, 0)::INT AS most_uses, round(coalesce(t, 0) / (SELECT sum(t) FROM got), 9) AS actual_share FROM w LEFT JOIN own USING (s) LEFT JOIN got USING (s)""",
    "p8_mixture_by_characters": f"WITH {_CHARACTERS} SELECT doc_id, s AS source, use_no::INT AS use_no, n AS tokens, round(finish, 3) AS finish FROM taken",
    "p9_found": f"WITH {_FORMS} SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM forms a JOIN forms b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id",
    "p9_classes": f"WITH {_FORMS} SELECT doc_id, min(doc_id) OVER p AS class_id, count(*) OVER p AS class_documents, (SELECT count(DISTINCT text) FROM forms g WHERE g.form = f.form) AS class_spellings FROM forms f WINDOW p AS (PARTITION BY form)",
    "p9_changed": f"WITH {_FORMS} SELECT doc_id, length(text) AS n_chars, length(form) AS n_chars_form FROM forms WHERE form <> text",
}
