import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or nt ea ti to it".split(), "de": "ch ei en er ung keit sch pf tz zu ge be ver te heit lich au st ie ö".split(), "fr": "eau oi ou ai eux ent que on an en re ch é è ment tion le de".split()}


def prose(rng, lang, n):
    words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    for i in range(0, n, 9):
        words[i] = words[i].capitalize()
    return " ".join(words) + "."


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents: prose, exact and near copies, chains of near copies, short and empty texts, nulls, repeats."""
    rng = random.Random(8)
    rows = [(i, prose(rng, ["en", "de", "fr"][i % 3], rng.randint(20, 120)), ["en", "de", "fr"][i % 3], f"s{i % 4}") for i in range(90)]
    base = prose(rng, "en", 150).split()
    for i in range(90, 110):
        words = base[:] if i == 90 else rows[-1][1].split()
        words[rng.randrange(len(words))] = f"edit{i}"
        rows.append((i, " ".join(words), "en", "s0"))
    rows += [(110 + i, rows[3][1], "en", "s0") for i in range(5)]
    rows += [(120, None, None, None), (121, "", "en", "s1"), (122, "   \n\t", None, "s1"), (123, "12 345 !!", "en", None), (124, "one two", "en", "s1"), (125, "One two", "en", "s1"), (None, rows[7][1], "en", "s1"), (None, None, None, None), (9, rows[9][1], "de", "s1"), (126, prose(rng, "en", 6000), "en", "s2")]
    return [(i, t, lang, s, len(t) if t else 0) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with further columns that bear the names operators use or return."""
    from pyspark.sql import functions as F

    names = "lang_pred score ambiguous shard slot size law n_shingles component_id class_id cls n prefix bits spans held_out weight probability selected topic n_tokens item_id coverage window slots fingerprint range guest id y __range __row p tokens".split()
    return docs.select("*", *[F.lit("x").alias(n) for n in names])
