"""Top items, evaluation leaks, mixing and canonical text against brute force, and their edge cases."""

import itertools
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelshift.llm import canonical_text, contamination, lookalikes, mixing, queries, topn
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    rows, mine, theirs = compare(queries.QUERIES[name](spark, FOLDER), queries.ORACLE[name], connect(FOLDER))
    assert rows and not mine and not theirs


def form(text: str) -> str:
    """The canonical form, character by character."""
    out = []
    for ch in unicodedata.normalize("NFD", text):
        code = ord(ch)
        if code in canonical_text.INVISIBLE:
            continue
        if code in canonical_text.BLANKS:
            ch = " "
        joined = any(a <= code <= b for a, b in canonical_text.LIGATURE_RANGES)
        if joined or unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")):
            ch = unicodedata.normalize("NFKD", ch)
        out += [canonical_text.LOOK_ALIKES.get(c, c) for c in ch]
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", "".join(out)))


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", form(text).lower())


# canonical text


def test_examples():
    same = [("ﬁne", "fine"), ("ＡＢ１（", "AB1("), ("café", "café"), ("a​b­", "ab"), ("a b", "a b"), ("саt", "cat"), ("Α", "A"), ("e‍́", "é"), ("ё", "ë"), ("ậ", "ậ")]
    apart = [("a b", "a  b"), ("A", "a"), ("é", "e"), ("1", "l"), ("²", "2"), ("a\nb", "a b"), ("и", "й"), ("½", "1/2")]
    assert all(canonical_text.canonical_strings([a]) == canonical_text.canonical_strings([b]) for a, b in same)
    assert all(canonical_text.canonical_strings([a]) != canonical_text.canonical_strings([b]) for a, b in apart)


ALPHABET = "ab e1 \ņ̣́̈​­ 　éëạệﬁﬃаеийΑοＡ１カﾞデデÅ日😀\x00"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=12), max_size=6))
def test_form_equals_character_by_character(texts):
    got = canonical_text.canonical_strings(texts)
    assert got == [form(t) for t in texts]
    assert canonical_text.canonical_strings(got) == got


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_composed_and_decomposed_agree(text):
    nfc, nfd = (canonical_text.canonical_strings([unicodedata.normalize(n, text)]) for n in ("NFC", "NFD"))
    assert nfc == nfd


def test_hangul_and_further_look_alikes():
    for text in ("한국어 글", "각", "가", "값\u1100"):
        assert canonical_text.canonical_strings([unicodedata.normalize("NFD", text)]) == [unicodedata.normalize("NFC", text)] == canonical_text.canonical_strings([text])
    assert canonical_text.canonical_strings(["가\u11a8", "\u1100\u1161\u11a8x", "\u1161\u1100"]) == ["각", "각x", "\u1161\u1100"]
    assert canonical_text.canonical_strings(["ӀӏҮүϹϲϳ"]) == ["IlYyCcj"]


def test_one_disguised_copy_among_many(spark):
    n = 100_000
    df = spark.range(n + 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "ﬁne").otherwise("fine").alias("text"))
    pairs = lookalikes.disguised_pairs(df)
    assert pairs.count() == n and pairs.filter("doc_id_a <> 7 and doc_id_b <> 7").count() == 0


def test_portions_cover_everything():
    texts = ["", "a" * 5, "b" * 50, "", "c" * 3, "d" * 3]
    assert [t for part in canonical_text.portions(texts, 6) for t in texts[part]] == texts
    assert list(canonical_text.portions([])) == []


def test_column_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ﬁ"), (4, "x" * 700_000 + "ﬁ")], "i int, text string").withColumn("form", F.lit("clash"))
    got = {r["i"]: r["form"] for r in canonical_text.with_canonical_text(df, "text", "form").collect()}
    assert got == {1: None, 2: "", 3: "fi", 4: "x" * 700_000 + "fi"}


def test_pairs_of_disguised_documents(spark, monkeypatch):
    monkeypatch.setattr(lookalikes, "PER_SALT", 2)
    texts = ["ﬁ", "fi", "fi", "fi", "ﬁ", None, "", "​", "lone", "café", "café", "cafe"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"form": F.lit(1), "spelling": F.lit(2)})
    got = {tuple(r) for r in lookalikes.disguised_pairs(df).collect()}
    assert got == {(0, 1), (0, 2), (0, 3), (1, 4), (2, 4), (3, 4), (6, 7), (9, 10)}
    assert lookalikes.disguised_pairs(df.limit(0)).count() == 0
    members = {r["doc_id"]: r for r in lookalikes.class_members(df).collect()}
    assert 5 not in members and (members[4]["class_id"], members[4]["class_documents"], members[4]["class_spellings"]) == (0, 5, 2)


# leaks


def planted():
    random.seed(11)
    pool = [f"word{i}" for i in range(60)]
    items = {i: [random.choice(pool) for _ in range(random.randint(8, 40))] for i in range(12)}
    items[12] = items[3][:12] + ["other"] * 3
    documents = {}
    for k in range(150):
        body = [random.choice(pool) for _ in range(random.randint(0, 60))]
        if k % 2:
            item = items[k % 13]
            start = random.randint(0, max(0, len(item) - 9))
            piece = item[start : start + random.randint(6, 20)]
            if k % 3 == 0 and len(piece) > 4:
                piece = [*piece[:4], "changed", *piece[5:]]
            at = random.randint(0, len(body))
            body[at:at] = piece
        documents[k] = random.choice([" ", "\n# ", ", "]).join(w.upper() if random.random() < 0.2 else w for w in body)
    documents |= {200: "", 201: None, 202: "Ｗord1 " * 3, 203: " ".join(items[5]).replace("o", "о"), 204: " ".join(items[5])}
    return documents, {i: " ".join(w) + "." for i, w in items.items()} | {20: None, 21: ""}


def test_leaks_equal_brute_force(spark):
    documents, items = planted()
    grams = defaultdict(set)
    for i, t in items.items():
        w = words(t or "")
        for k in range(len(w) - 9):
            grams[tuple(w[k : k + 10])].add(i)
    expected = {(d, i) for d, t in documents.items() if t for w in [words(t)] for k in range(len(w) - 9) for i in grams.get(tuple(w[k : k + 10]), ())}
    docs = spark.createDataFrame(list(documents.items()), "doc_id long, text string").withColumns({"seed": F.lit(0), "words": F.lit("clash")})
    its = spark.createDataFrame(list(items.items()), "item_id long, text string").withColumn("mask", F.lit(1))
    found = contamination.leaked_passages(docs, its)
    got = {(r["doc_id"], r["item_id"]) for r in found.filter("longest_run >= 10").collect()}
    assert got == expected and len(expected) > 20 and (203, 5) in got
    assert contamination.leaked_passages(docs.limit(0), its).count() == 0
    assert contamination.leaked_passages(docs, its.limit(0)).count() == 0


@pytest.mark.parametrize("length, changed, least", [(10, 1, 1.0), (12, 1, 1.0), (14, 2, 1.0), (10, 2, 0.2)])
def test_recall_of_substituted_passages(spark, length, changed, least):
    """Every choice of substituted words in a passage of a longer item, one document each; two words in ten are beyond what the masks promise."""
    item = [f"w{i}" for i in range(30)]
    docs = []
    for k, places in enumerate(itertools.combinations(range(length), changed)):
        passage = [f"x{i}" if i in places else w for i, w in enumerate(item[8 : 8 + length])]
        docs.append((k, " ".join([f"a{i}" for i in range(12)] + passage + [f"b{i}" for i in range(12)])))
    found = contamination.leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    recall = found.filter(F.col("overlap") == length - changed).count() / len(docs)
    assert recall >= least


def test_substituted_words_are_tolerated(spark):
    passage = [f"w{i}" for i in range(24)]
    changed = [w if i % 8 != 5 else "x" for i, w in enumerate(passage)]
    docs = spark.createDataFrame([(1, "before " + " ".join(changed) + " after")], "doc_id long, text string")
    row = contamination.leaked_passages(docs, spark.createDataFrame([(7, " ".join(passage))], "item_id long, text string")).first()
    assert (row["doc_id"], row["item_id"], row["longest_run"]) == (1, 7, 7) and row["overlap"] >= 18


def test_long_passages_are_measured_whole(spark):
    item = [f"w{i}" for i in range(120)]
    other = [w if 40 <= i < 50 or i % 3 == 0 else f"x{i}" for i, w in enumerate(item)]  # hits in the middle only
    docs = {1: ["a", *item, "b"], 2: item[30:90], 3: other, 4: [*item[:60], "y", *item[61:]], 5: item[70:] + item[:70], 6: ["c"] * 30}
    found = contamination.leaked_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    same = sum(x == y for x, y in zip(item, other))
    assert {r["doc_id"]: (r["longest_run"], r["overlap"]) for r in found.collect()} == {1: (120, 120), 2: (60, 60), 3: (11, same), 4: (60, 119), 5: (70, 70)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB1é_- .\ńﬁа", max_size=20), max_size=5))
def test_word_hashes_stand_for_words(texts):
    hashes, bounds = contamination.word_hashes(texts)
    split = [words(t) for t in texts]
    assert [len(w) for w in split] == [b - a for a, b in zip(bounds, bounds[1:])]
    flat = [w for ws in split for w in ws]
    assert len({(w, int(h)) for w, h in zip(flat, hashes)}) == len(set(flat)) == len(set(hashes.tolist()))


# top items


def test_top_items_equal_brute_force(spark):
    random.seed(3)
    nan = float("nan")
    data = [(g, h, random.choice([0.5, 0.25, random.random(), None, nan]), f"i{random.randint(0, 40)}") for g in ("a", "b", None) for h in (1, None) for _ in range(60)]
    data += [("hot", 1, round(random.random(), 2), f"i{i}") for i in range(5000)] + [("a", 1, 0.9, None), ("empty", 1, None, "x")]
    df = spark.createDataFrame(data, "g string, h int, s double, i string").repartition(7).withColumns({"_part": F.lit(0), "position": F.lit("clash")})
    groups = defaultdict(list)
    for g, h, s, i in data:
        if s is not None and s == s:
            groups[g, h].append((-s, (i is not None, i or ""), i))
    for n in (1, 10, 4000):
        expected = Counter((g, h, i, -s, k + 1) for (g, h), rows in groups.items() for k, (s, _, i) in enumerate(sorted(rows, key=lambda r: r[:2])[:n]))
        assert Counter(tuple(r) for r in topn.top_per_group(df, ["g", "h"], "s", "i", n).collect()) == expected
    assert topn.top_per_group(df.limit(0), ["g", "h"], "s", "i", 3).count() == 0


# mixing


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql(spark, name):
    rows = queries.QUERIES[name](spark, FOLDER)
    if name == "p7_overlaps":
        assert {(r["doc_id"], r["item_id"]) for r in rows.filter("longest_run >= 10").collect()} == {tuple(r) for r in queries.p7_found(spark, FOLDER).collect()}
    elif name == "p8_report":
        got = rows.collect()
        assert sum(r["actual_share"] for r in got) == pytest.approx(1) and {r["source"] for r in queries.p8_found(spark, FOLDER).collect()} <= {r["source"] for r in got if r["actual_share"] < r["target_share"]}
    else:
        taken = {r["source"]: r["t"] for r in rows.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
        assert name == "p8_mixture" and taken == {mixing_name(r["source"]): r["taken_tokens"] for r in queries.p8_report(spark, FOLDER).collect() if r["taken_tokens"]}


def mixing_name(source: str) -> str:
    return source.strip().lower().replace("-", "_")


def vocabulary() -> str:
    return f"{mixing.tokenizer_folder()}/{queries.VOCABULARY}"


def reference_encoding():
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary(), "rb"))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_token_counts_equal_the_public_tokenizer():
    count, plain = mixing.token_counter(vocabulary()), reference_encoding()
    random.seed(4)
    texts = ["".join(random.choice(" \n\t\xa0　 ab1.'é\x1c") for _ in range(random.randint(0, 14))) for _ in range(3000)] + [" " * 5000, "x" + " " * 300 + "y"]
    assert [count(t) for t in texts] == [len(plain.encode_ordinary(t)) for t in texts]


def sized(spark, sizes):
    return spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(sizes)], "doc_id long, source string, tokens long")


def test_mixture_follows_its_weights(spark):
    random.seed(6)
    sizes = [("big", random.randint(1, 20)) for _ in range(3000)] + [("mid", random.randint(1, 20)) for _ in range(1000)] + [("small", 10)] * 20 + [("none", 50)] * 10 + [("big", 0), (None, 5)]
    weights = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3)], "source string, target_share double, max_repeats int")
    df = sized(spark, sizes)
    rows = mixing.mixture(df, weights, budget=10_000).orderBy("running").collect()
    taken, uses = Counter(), Counter()
    for r in rows:
        taken[r["source"]] += r["tokens"]
        uses[r["doc_id"]] += 1
    assert 9_950 <= rows[-1]["running"] <= 10_000 and sum(taken.values()) == rows[-1]["running"]
    assert taken["small"] == 600 and max(uses.values()) <= 3 and "none" not in taken
    assert taken["big"] / taken["mid"] == pytest.approx(5 / 3, abs=0.05)
    finishes = [r["finish"] for r in rows]
    assert finishes == sorted(finishes)
    assert {r["source"] for r in mixing.sources_running_dry(df, weights).collect()} == {"small"}
    report = {r["source"]: r for r in mixing.mixture_report(df, weights, budget=10_000).collect()}
    assert report["small"]["most_uses"] == 3 and sum(r["actual_share"] for r in report.values()) == pytest.approx(1)


def test_mixture_of_nothing(spark):
    weights = spark.createDataFrame([("a", 0.5, 1), ("gone", 0.5, 4)], "source string, target_share double, max_repeats int")
    assert mixing.mixture(sized(spark, [("b", 3)]), weights).count() == 0
    assert {r["source"] for r in mixing.sources_running_dry(sized(spark, [("a", 3), ("b", 3)]), weights).collect()} == {"gone"}


def test_sizes_of_null_empty_and_long_texts(spark):
    df = spark.createDataFrame([(1, " A-b ", None), (2, "a_B", ""), (3, None, "one two"), (4, "c", "word " * 100_000)], "doc_id long, source string, text string").withColumn("tokens", F.lit("clash"))
    got = {r["doc_id"]: (r["source"], r["tokens"]) for r in mixing.token_sizes(df, "doc_id", "source", "text", vocabulary()).collect()}
    assert got == {1: ("a_b", 0), 2: ("a_b", 0), 3: (None, 2), 4: ("c", 100_001)}
