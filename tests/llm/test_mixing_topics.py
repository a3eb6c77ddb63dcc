"""Topics by whole words, in any number of languages, and targets that can be reached."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing

ALPHABET = "abcdefghijklmnopqrstuvwxyzäéñö"


def test_pattern_finds_whole_words_only(spark):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abé.") for _ in range(rng.randint(1, 4))) for _ in range(60)} - {""})
    words = [w for w in words if "." not in w] + ["aab", "aabb"]
    texts = ["".join(rng.choice("abé .-1") for _ in range(80)) for _ in range(60)] + ["", "aabb-aab aabbb"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_extract_all("t", F.lit(mixing.words_pattern(words)), F.lit(0)).alias("w")).collect()
    for r in got:
        assert r["w"] == [w for w in re.split(r"[^abé]+", r["t"]) if w in set(words)], r["t"]


def planted(rng, languages, per_topic=60):
    """Texts of three topics in each language: words of their own among words of all, some of which hold a topic word inside."""
    rows = []
    for lang in languages:
        make = lambda k: ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(5, 8))) for _ in range(k)]
        shared, own = make(60), [make(24) for _ in range(3)]
        shared += [f"x{w}x" for ws in own for w in ws[:3]]
        for t in range(3):
            for _ in range(per_topic):
                words = rng.choices(shared, k=60) + rng.choices(own[t], k=rng.randint(10, 16))
                rng.shuffle(words)
                rows.append((len(rows), " ".join(words), lang, f"s{rng.randint(0, 2)}", t))
    return rows


@pytest.mark.parametrize("n", [2, 20])
def test_planted_topics_of_many_languages(spark, n):
    languages = [f"l{i}" for i in range(n - 1)] + [None]
    rows = planted(random.Random(n), languages, 60 if n == 2 else 24)
    df = spark.createDataFrame([(*r[:4], r[4]) for r in rows], "doc_id long, text string, lang string, source string, planted int").repartition(4)
    keyed = mixing.with_mix_keys(df, topics=6, words=40).collect()
    got = defaultdict(Counter)
    for r in keyed:
        got[r["lang"], r["topic"]][r["planted"]] += 1
    other = sum(sum(c.values()) for (_, t), c in got.items() if t == "other")
    assert other < len(rows) / 3
    assert {lang for lang, t in got if t != "other"} == set(languages)
    pure = sum(max(c.values()) for (_, t), c in got.items() if t != "other")
    assert pure >= 0.9 * (len(rows) - other)


def test_tempered_targets_are_reached(spark):
    """Margins of very unequal sizes: every value is within a hundredth of its tempered target, and small ones are favoured."""
    rng = random.Random(5)
    rows = [(i, rng.choices("abcd", [80, 15, 4, 1])[0], rng.choices("xy", [95, 5])[0], rng.choices("pqr", [60, 39, 1])[0], rng.randint(1, 40)) for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n_tokens long")
    cells, _ = mixing.rake(df, tempered=True)
    reached = mixing.margins_reached(cells).collect()
    assert all(abs(r["reached"] - r["wanted"]) <= 0.01 * r["wanted"] for r in reached), reached
    total = Counter()
    for _, *values, n in rows:
        for m, v in zip(mixing.MARGINS, values, strict=True):
            total[m, v] += n
    share = {(r["margin"], r["value"]): r["reached"] / total[r["margin"], r["value"]] for r in reached}
    assert abs(sum(r["reached"] for r in reached if r["margin"] == "lang") / sum(n for *_, n in rows) - mixing.FRACTION) < 0.01
    assert share["source", "a"] < share["source", "b"] < share["source", "c"] and share["lang", "x"] < share["lang", "y"] <= 1


def test_mix_of_tempered_targets_edges(spark, no_docs, docs):
    assert mixing.mix(mixing.with_mix_keys(no_docs), tempered=True).count() == 0
    assert mixing.mix(mixing.with_mix_keys(docs.filter("text IS NULL")), tempered=True).count() == docs.filter("text IS NULL").count()
    assert mixing.mix(mixing.with_mix_keys(docs), tempered=True, small_cells=0).count() == docs.count()


def test_topics_are_learned_from_every_text_once(spark):
    rows = [(i, f"common{'abcdefg'[i % 7]} alpha{'xyz'[i % 3]} plain" + (" rareone rareone rareone sidekick\u00b2rareone" if i % 45 == 0 else ""), "en") for i in range(45_000)]
    rows += [(50_000 + i, "copied copied copied words", "en") for i in range(2_000)]
    df = spark.createDataFrame([(i, f"{t} n{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576 % 26)}" if i < 50_000 else t, lang) for i, t, lang in rows], "doc_id long, text string, lang string").repartition(7)
    found = mixing.topic_lexicon(df, topics=3)
    assert all("copied" not in ws for ws in found["en"].values())
    sums = {r["w"]: (r["df"], r["tf"]) for r in df.select("lang", F.xxhash64("text").alias("doc"), "text").repartition("doc").mapInArrow(mixing._word_rows, "lang string, w string, df long, tf long").groupBy("w").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).collect()}
    assert sums["plain"] == (45_000, 45_000) and sums["rareone"] == (1000, 4000) and sums["copied"] == (1, 3) and sums[""][0] == 45_001


def test_words_are_counted_by_the_plan_alone(spark, docs):
    some = docs.filter("text IS NOT NULL").withColumn("lang", F.coalesce("lang", F.lit("")))
    some = some.union(some)  # copies count once
    texts = mixing.distinct_texts(some, "text", "lang")
    counts = mixing.word_counts(texts)
    one = some.select("lang", F.xxhash64("text").alias("doc"), F.lower("text").alias("text")).repartition("doc")
    want = one.mapInArrow(mixing._word_rows, "lang string, w string, df long, tf long").groupBy("lang", "w").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    assert counts.count() > 100 and counts.exceptAll(want).isEmpty() and want.exceptAll(counts).isEmpty()
    seeds = {r["lang"]: [r["w"]] for r in counts.filter("w <> ''").groupBy("lang").agg(F.max_by("w", F.struct("df", "w")).alias("w")).collect()}
    common = counts.filter("df >= 2 AND w <> ''")
    beside = mixing.words_beside(texts, seeds, common)
    held = Counter()
    known = {(r["lang"], r["w"]) for r in common.collect()}
    for r in texts.collect():
        words = set(mixing._words(r["text"]))
        held.update((r["lang"], s, w) for s in seeds.get(r["lang"], ()) if s in words for w in words if (r["lang"], w) in known)
    assert {(r["lang"], r["seed"], r["w"]): r["n"] for r in beside.collect()} == held
    keyed = mixing.with_mix_keys(some)
    for d in (counts, beside, keyed):
        assert "MapInArrow" not in d._jdf.queryExecution().executedPlan().toString()


def test_topics_are_learned_without_python(spark, docs, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "mapInArrow", None)
    assert mixing.topic_lexicon(docs)


def test_texts_are_split_into_words_once_and_tokens_counted_without_a_pattern(spark):
    rows = [("en", "One  two\tthree\n\x0bfour\x0c five\r\nsix "), ("en", ""), ("en", None), ("de", " \t "), ("de", "a b  c Grüße")]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = df.select(mixing.token_count(F.col("text")).alias("n"), F.coalesce(F.regexp_count("text", F.lit(r"[^ \t-\r]+")), F.lit(0)).alias("w"))
    assert [r["n"] for r in got.collect()] == [r["w"] for r in got.collect()] == [6, 0, 0, 0, 3]
    assert "regexp" not in got.select("n")._jdf.queryExecution().optimizedPlan().toString()
    texts = mixing.distinct_texts(df, "text", "lang")
    assert "split" not in mixing.word_counts(texts)._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_split_once_for_its_topic(spark):
    lexicon = {"en": {"river": ["river", "water"], "stone": ["stone"]}}
    df = spark.createDataFrame([("Water, water and stone", "en"), ("stone", "en"), ("wood", "en"), ("stone", "de")], "low string, lang string")
    named = df.select(mixing.topic_of(F.lower("low"), F.col("lang"), lexicon).alias("topic"))
    assert [r["topic"] for r in named.collect()] == ["river", "stone", "other", "other"]
    assert named._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
