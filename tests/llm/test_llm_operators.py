"""Each operator against a brute-force version, and on nulls, empty texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, fingerprints, jaccard, language, mixing, secrets, sharding, textops, toxicity


def sets(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def brute_components(rows, k, num, den):
    """Component id of each row, by comparing all pairs."""
    found = [sets(t, k) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = found[i], found[j]
        if a and b and den * len(a & b) >= num * len(a | b):
            parent[root(j)] = root(i)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], len(found[i]), least.get(root(i)) if found[i] else r[0]) for i, r in enumerate(rows)]


def key(row):
    return tuple((x is not None, x) for x in row)


# ---------------------------------------------------------------- shared helpers


def test_shingle_hashes_stand_for_shingles(corpus):
    texts = [t for _, t, *_ in corpus]
    for k in (1, 4, 5):
        owner, h = textops.shingles(texts, k)
        n = np.bincount(owner, minlength=len(texts))
        want = [sets(t, k) for t in texts]
        assert n.tolist() == [len(s) for s in want]
        assert len(set(h.tolist())) == len(set().union(*want))
        assert textops.shingles([texts[126 - 90]], k)[1].tolist() == h[owner == 126 - 90].tolist()


def test_words_split_at_ascii_blanks_only():
    assert textops.word_hashes(["a b c\x0bd"])[1].tolist() == [0, 0, 0]
    assert textops.word_hashes(["ABC Éa"])[0].tolist() == textops.word_hashes(["abc Éa"])[0].tolist()
    assert textops.word_hashes(["É"])[0].tolist() != textops.word_hashes(["é"])[0].tolist()
    assert textops.word_hashes([None, "", " "])[0].tolist() == []


# ---------------------------------------------------------------- 5: Jaccard join


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100), (2, 1, 2)])
def test_jaccard_join(docs, corpus, k, num, den):
    got = jaccard.jaccard_components(docs, k, num, den).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(key, got)) == sorted(map(key, brute_components(corpus, k, num, den)))


def test_jaccard_join_of_random_sets(spark):
    rng = random.Random(2)
    rows = []
    for g in range(12):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randint(4, 40))]
        for _ in range(rng.randint(1, 14)):
            w = words[:]
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(60)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for num in (60, 85):
        got = jaccard.jaccard_components(df, 3, num, 100).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got)) == sorted(brute_components(rows, 3, num, 100))


def test_jaccard_blocks_lose_no_link(spark, monkeypatch):
    """Blocks of a few rows, and so many pairs of blocks, give what one block gives."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = base[:]
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(60)] = f"e{rng.randrange(400)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).select("doc_id", "n_shingles", "component_id").collect()
    want = brute_components(rows, 4, 85, 100)
    assert len({c for *_, c in want}) > 1 and sorted(map(tuple, got)) == sorted(want)


def test_near_duplicates_leave_one(docs, corpus, clashing, no_docs):
    kept = jaccard.drop_near_duplicates(docs)
    want = {c for i, _, c in brute_components(corpus, 5, 80, 100) if i is not None}
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(ids) == sorted(want) and kept.columns == docs.columns
    assert jaccard.drop_near_duplicates(clashing).columns == clashing.columns
    assert jaccard.drop_near_duplicates(no_docs).count() == 0


# ---------------------------------------------------------------- 2: language


def test_language_of_held_out_texts(docs):
    held_out = F.coalesce(F.col("doc_id") % 4 == 2, F.lit(False))
    model = language.train(docs.filter(~held_out))
    got = language.identify(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id").filter("length(text) > 60 AND doc_id < 90 AND doc_id % 4 = 2").collect()
    assert len(got) > 15 and all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, docs, no_docs, clashing):
    model = language.train(docs)
    got = {r["doc_id"]: r for r in language.identify(docs.filter("doc_id >= 120"), model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (120, 121, 122, 123)) and got[124]["lang_pred"] != "und"
    assert language.identify(clashing, model).count() == docs.count()
    assert language.train(no_docs) is None and language.identify(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    one = language.train(docs.filter("lang = 'en'"))
    assert {r["lang_pred"] for r in language.identify(docs, one).collect()} == {"en", "und"}
    kept = language.keep_identified(clashing, model)
    assert kept.columns == clashing.columns and {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()} <= {120, 121, 122, 123, 124, 125}


def test_codewords_are_apart():
    for k in (2, 4, 6, 9, 30):
        c = language.codewords(k)
        apart = [(a != b).sum() for a, b in itertools.combinations(c, 2)]
        assert len(c) == k and min(apart) >= (1 if k == 2 else c.shape[1] // 4)


# ---------------------------------------------------------------- 3: shards


def test_byte_shards(docs, corpus, no_docs, clashing):
    got = sharding.shard_by_bytes(docs, 4).collect()
    order = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1))
    total, before, want, slots = sum(len((r[1] or "").encode()) + 1 for r in corpus), 0, [], Counter()
    for r in order:
        size = len((r[1] or "").encode()) + 1
        shard = min(before * 4 // total, 3)
        want.append((r[0], size, zlib.crc32((r[1] or "").encode()), shard, slots[shard]))
        slots[shard] += 1
        before += size
    assert sorted(key((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"])) for r in got) == sorted(map(key, want))
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    assert sharding.shard_by_bytes(no_docs).count() == 0
    assert sharding.shard_by_bytes(clashing).count() == docs.count()


def test_id_ranges_are_in_order_and_even(spark):
    df = spark.range(50_000).select((F.col("id") * 7 - 1000).alias("k")).union(spark.createDataFrame([(None,), (10**12,)], "k long"))
    for rows in (20, 200):
        bucket, n = sharding.range_bucket(df, "k", rows)
        got = df.select("k", bucket.alias("b")).orderBy(F.asc_nulls_first("k")).collect()
        b = [r["b"] for r in got]
        assert b == sorted(b) and 0 <= b[0] and b[-1] < n and max(Counter(b).values()) <= 8 * max(rows, 20)


# ---------------------------------------------------------------- 7: secrets


def test_base_spans_against_a_walk(docs, corpus):
    rng = random.Random(6)
    bits = ["password", "Api_Key", "apikey", "token", "SECRET", '"', "'", " ", "=", ":", "AKIA", "ABCDEFGHIJKLMNOP1", "0123456789abcdef", "deadbeef", "x", "é", "\n", "abc-DEF_1.2/3+4=", "ſecret", "Ktoken"]
    for t in [None, "", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(1500))]:
        base = [(s, e, k) for s, e, k, linked in secrets.all_spans(t) if not linked]
        want = secrets.brute_base(t)
        assert (*(sum(x[2] == k for x in base) for k in secrets.KINDS), hashlib.sha256(secrets.joined(base).encode()).hexdigest()) == want, t


def test_weak_parts_need_partners():
    weak_id, secret = "user: alice.smith", "Zx8kQp2LmN4vB6cR9tYw7"
    kinds = lambda t: [k for *_, k, linked in secrets.all_spans(t) if linked]
    assert kinds(f"{weak_id} and nothing") == [] and kinds(f"only {secret} here") == []
    assert kinds(f"{weak_id} has {secret} here") == ["weak_id", "weak_secret"]
    assert kinds(f"{weak_id}\n\n{secret}") == []
    assert kinds(f"{weak_id}{' ' * 500}{secret}") == []
    assert kinds("see https://db.example.com/x password=abcdefgh12345") == ["endpoint"]
    assert kinds("see https://db.example.com/x") == []


def test_secret_scan_edges(docs, no_docs, clashing):
    assert secrets.scan_secrets(docs).count() == docs.count() == secrets.scan_secrets(clashing).count()
    assert secrets.scan_secrets(no_docs).count() == 0


@pytest.mark.parametrize("n", [20, 80, 81, 88, 100, 5000])
def test_weak_parts_of_any_length(n):
    key = ("Zx8kQp2LmN4v/B6c+R9tYw7_" * (n // 24 + 1))[:n]
    t = f"client_id: alice {key} end"
    assert secrets.all_spans(t) == [(0, 16, "weak_id", True), (17, 17 + n, "weak_secret", True)]
    assert secrets.all_spans(f"client_id: alice {key.lower().translate({ord(c): 'x' for c in '0123456789'})}") == []
    url = f"https://db.example.com/{'path/' * n}x"
    assert secrets.all_spans(f"{url} password=abcdefgh12345")[0] == (0, len(url), "endpoint", True)
    name = "user: " + "alice.smith@" * n
    assert secrets.all_spans(f"{name} Zx8kQp2LmN4vB6cR9tYw7")[0] == (0, len(name), "weak_id", True)


def test_no_part_hides_another():
    own, key = "Zx8kQp2LmN4vB6cR9tYw7Hd3Jf5Gs1Wq", "qW3eR5tY7uI9oP1aS3dF5gH7jK9lZ1xC3vB5nM7q"
    t = f"client_id: {own}\n{key} end"
    assert [(t[s:e], k) for s, e, k, linked in secrets.all_spans(t) if linked] == [(f"client_id: {own}", "weak_id"), (key, "weak_secret")]


def test_linking_against_all_pairs():
    rng = random.Random(7)
    bits = ["client_id: Zx8kQp2LmN4vB6cR9tYw7Hd3", "user: bob", "qW3eR5tY7uI9oP1aS3dF5g", "https://a.example/x", "https://a.example/qW3eR5tY7uI9oP1aS3dF5g", "password=abcdefgh12345", "0123456789abcdef01", "AKIAABCDEFGHIJKLMN1", "ABIAABCDEFGHI1", "\n\n", "x" * 15, "word word word"]
    n = 0
    for _ in range(1500):
        t = " ".join(rng.choice(bits) for _ in range(rng.randint(2, 14)))
        gap = rng.choice([5, 20, 60])
        base = secrets.base_spans(t)
        weak = [(m.start("x"), m.end("x"), k) for k, pattern in secrets.WEAK.items() for m in pattern.finditer(t) if k != "weak_secret" or re.search("[0-9]", m["x"]) and re.search("[a-z]", m["x"])]
        parts = sorted([*base, *(w for w in weak if not any(s < w[1] and e > w[0] for s, e, _ in base))])
        scope = secrets._scopes(t, parts, gap)
        want = [p for p, a in zip(parts, scope) if any(q[2] in secrets.PARTNERS.get(p[2], ()) and a == b and (0 <= p[0] - q[1] <= gap or 0 <= q[0] - p[1] <= gap) for q, b in zip(parts, scope))]
        assert secrets.linked_spans(t, base, gap) == want, t
        n += len(want)
    assert n > 1000


# ---------------------------------------------------------------- 8: fingerprints


def test_span_equality_and_extensions():
    rng = random.Random(9)
    for _ in range(60):
        a = "".join(rng.choice("ab€") for _ in range(rng.randint(0, 60)))
        b = a[: rng.randint(0, len(a))] + "".join(rng.choice("ab€") for _ in range(rng.randint(0, 20)))
        p, q = fingerprints.PrefixHash(a), fingerprints.PrefixHash(b)
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert p.common_extension(i, q, j) == n
        m = rng.randint(0, min(len(a) - i, len(b) - j))
        assert p.equal(i, q, j, m) == (a[i : i + m] == b[j : j + m])
    one = fingerprints.PrefixHash("xx" + "abcdefghijklmnopqrst").windows(16)
    two = fingerprints.PrefixHash("abcdefghijklmnopqrst" + "yyyyyyy").windows(16)
    assert len(set(one.tolist()) & set(two.tolist())) == 5


def test_fingerprints_of_edits(spark, docs, corpus, no_docs, clashing):
    rows = [r for r in corpus if r[0] is not None]
    unique = list({r[0]: r for r in rows}.values())
    df = spark.createDataFrame([(i, t) for i, t, *_ in unique], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(df).collect()}
    order = sorted(unique, key=lambda r: -r[0])
    for r, after in zip(order, [*order[1:], order[0]], strict=True):
        t, f = r[1] or "", after[1] or ""
        edited = t[: len(t) - len(t) // 2] + f[: len(t) // 2]
        g = got[r[0]]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (g["near_edited"] == 1.0) == (edited == t) and (g["near_next"] == 1.0) == (f == t)
        assert g["common_prefix"] == next((i for i, (x, y) in enumerate(zip(t, edited, strict=False)) if x != y), min(len(t), len(edited)))
    by_text = {}
    for i, t, *_ in unique:
        by_text.setdefault(t or "", set()).add(got[i]["fingerprint"])
    assert all(len(s) == 1 for s in by_text.values()) and len({next(iter(s)) for s in by_text.values()}) == len(by_text)
    long = [g for g in got.values() if g["n_chars"] > 300 and g["near_edited"] < 1]
    assert sum(g["near_edited"] > 0.25 for g in long) > 0.9 * len(long)
    assert fingerprints.fingerprint_edits(docs).count() == docs.count() == fingerprints.fingerprint_edits(clashing).count()
    assert fingerprints.fingerprint_edits(no_docs).count() == 0
    only = fingerprints.fingerprint_edits(spark.createDataFrame([(1, "abcd" * 9)], "doc_id long, text string")).first()
    assert only["near_next"] == 1.0


def test_fingerprints_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEAST_RANGES", 40)
    rows = [(i * i, f"text {i} " * (i % 7 + 1)) for i in range(200)]
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, t), (_, f) in zip(rows, [rows[-1], *rows[:-1]], strict=True):
        assert got[i] == hashlib.sha256(fingerprints.edited_text(t, f).encode()).hexdigest()


# ---------------------------------------------------------------- 9: toxicity


@pytest.fixture(scope="module")
def toxic_docs(spark, corpus):
    rng, rows = random.Random(12), []
    clean = [t for i, t, *_ in corpus if i is not None and i < 90]
    for i in range(240):
        words, bad = rng.choice(clean).split(), i % 4 == 0
        if bad:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "scum", "loser", "worthless"]))
        rows.append((i, " ".join(words), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_held_out(toxic_docs):
    model = toxicity.train(toxic_docs, toxic_docs.filter("doc_id % 3 <> 1").select("doc_id", "toxic"))
    got = toxicity.score_toxicity(toxic_docs, model).join(toxic_docs.select("doc_id", "toxic"), "doc_id").filter("doc_id % 3 = 1").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.97 * len(got)


def test_toxicity_folds_and_exceptions():
    m = toxicity.ToxicityModel({toxicity.fold(w): 3.0 for w in ("idiot", "loser", "trash", "scum")}, np.array([-4.0, 3.0, 3.0, 1.0]))
    hit = lambda t: m.features(t)[2] == 1.0
    assert all(map(hit, ["You Idiot!", "1d10t", "ІDІОТ", "l0ser", "what $cum", "ｉｄｉｏｔ", "idiot$$$", "ídiot"]))
    assert not any(map(hit, ["idiotic", "closer", "trash can", "a sore loser", "", None, "101 5", "the pond scum"]))
    assert hit("trash can and trash") and len(toxicity.fold("Straße İ ﬁ")) == len("Straße İ ﬁ")


def test_toxicity_edges(docs, toxic_docs, no_docs, clashing, spark):
    labels = toxic_docs.select("doc_id", "toxic")
    model = toxicity.train(toxic_docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert got[120]["score"] == got[121]["score"] < 0.5 and all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.score_toxicity(clashing, model).count() == docs.count() and toxicity.score_toxicity(no_docs, model).count() == 0
    assert toxicity.train(toxic_docs, labels.filter("toxic = 0")) is None and toxicity.train(no_docs, labels) is None
    assert toxicity.train(toxic_docs, labels.limit(0)) is None
    assert {r["score"] for r in toxicity.score_toxicity(docs, None).collect()} == {0.0}


# ---------------------------------------------------------------- 10: mixing


def numpy_rake(rows, fraction, smoothing, cycles=60):
    cells = {}
    for s, lang, topic, n in rows:
        cells[s, lang, topic] = cells.get((s, lang, topic), 0) + n
    p, total = dict.fromkeys(cells, fraction), sum(cells.values())
    want = []
    for m in range(3):
        t = {}
        for c, n in cells.items():
            t[c[m]] = t.get(c[m], 0) + n
        t = {k: v**smoothing for k, v in t.items() if v}
        want.append({k: v / sum(t.values()) * fraction * total for k, v in t.items()})
    for _ in range(cycles):
        for m in range(3):
            now = {}
            for c, n in cells.items():
                now[c[m]] = now.get(c[m], 0) + n * p[c]
            p = {c: min(1.0, v * (want[m].get(c[m], 0) / now[c[m]] if now[c[m]] else 1)) for c, v in p.items()}
    return p


@pytest.mark.parametrize("small", [50_000, 0])
def test_raked_probabilities(spark, small):
    rng = random.Random(1)
    rows = [(i, rng.choice("abc"), rng.choice(["x", "x", "x", "y"]), rng.choice("pq"), rng.randint(1, 50)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n_tokens long")
    got = mixing.mix(df, fraction=0.3, small_cells=small).collect()
    want = numpy_rake([r[1:] for r in rows], 0.3, mixing.SMOOTHING)
    assert len(got) == 400 and all(abs(r["probability"] - want[r["source"], r["lang"], r["topic"]]) < 2e-3 for r in got)
    assert 60 < sum(r["selected"] for r in got) < 200


def test_mixing_to_given_targets(spark):
    rows = [(i, "ab"[i % 10 == 0], "x", "p", 10) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n_tokens long")
    target = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "value string, share double")
    got = mixing.mix(df, {"source": target}, fraction=0.1).filter("selected").groupBy("source").count().collect()
    assert all(140 < r["count"] < 260 for r in got) and len(got) == 2


def test_mixing_edges(docs, no_docs, clashing):
    df = mixing.with_mix_keys(docs)
    out = mixing.mix(df)
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r["probability"] <= 1 for r in rows)
    again = {r["doc_id"]: r["selected"] for r in mixing.mix(df.repartition(2)).collect()}
    assert all(again[r["doc_id"]] == r["selected"] for r in rows)
    assert mixing.mix(mixing.with_mix_keys(no_docs)).count() == 0
    assert mixing.mix(mixing.with_mix_keys(clashing)).count() == docs.count()
    empty = mixing.with_mix_keys(docs.filter("text IS NULL"))
    assert mixing.mix(empty).count() == 2


def test_mixing_and_sharding_run_no_python(docs):
    for df in (mixing.mix(mixing.with_mix_keys(docs)), sharding.shard_by_bytes(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow(?!Eval)", plan.replace("AdaptiveSparkPlan", "")), plan


# ---------------------------------------------------------------- 1: decontamination


ITEMS = [
    (1, "Tom has 12 apples and gives 5 kg of them to Ann, so how many apples does Tom keep in the old basket?"),
    (2, "the river runs past the quiet mill while seven children watch the slow boats drift toward the sea"),
    (3, "too short here"),
    (4, None),
    (5, "why is ice lighter than water"),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def leak_docs():
    filler = "some other words stand here before and after what was taken from elsewhere".split()
    f = " ".join(filler)
    re_asked = "Bob has 30 apples and gives 7 lb of them to Eve, so how many apples does Bob keep in the old basket?"
    mixed_up = "Bob has 30 apples and gives 7 lb of them to Eve, so how many apples does Sam keep in the old basket?"
    return [(1, f"{f} {ITEMS[0][1]} {f}"), (2, f"{f} {re_asked} {f}"), (3, f"{f} {mixed_up} {f}"), (4, f"{f} {ITEMS[1][1]}"), (5, f), (6, None), (7, ""), (8, "too short here"), (9, f"{f}\n{ITEMS[4][1].upper()}? {f}"), (10, "the river runs past the quiet house and nobody sees it"), (None, ITEMS[1][1]), (4, ITEMS[1][1])]


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_leaks(spark, items, most):
    df = spark.createDataFrame(leak_docs(), "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontamination.find_leaks(df, items, max_broadcast_windows=most).collect()}
    assert got == {(1, 1): "verbatim", (2, 1): "re-parameterised", (4, 2): "verbatim", (9, 5): "verbatim", (None, 2): "verbatim"}


def test_windows_equal_templates():
    known = frozenset("has apples and gives of them to so how many does keep in the old basket".split())
    codes = decontamination._Codes(known)
    rng = random.Random(3)
    vocabulary = ["Tom", "Ann", "12", "5kg", "7 km", "the", "apples,", "(old)", "GIVES", "3.5%", "...", "naïve", "has"]
    seen = {}
    for _ in range(300):
        text = " ".join(rng.choice(vocabulary) for _ in range(20))
        c, raw = decontamination.template(text, codes)
        for p, h in enumerate(decontamination.windows(c, 6)):
            if h:
                plain = tuple(v if k == decontamination.WORD else k for k, v in (decontamination.canonical(r, known) for r in raw[p : p + 6]))
                assert seen.setdefault(int(h), plain) == plain
    assert len(set(seen.values())) == len(seen) > 100


def test_decontamination_edges(spark, items, docs, no_docs, clashing):
    assert decontamination.find_leaks(no_docs, items).count() == 0
    assert decontamination.find_leaks(docs, items.limit(0)).count() == 0
    assert decontamination.find_leaks(clashing, items).count() == 0
    kept = decontamination.drop_leaks(spark.createDataFrame(leak_docs(), "doc_id long, text string"), items)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [3, 5, 6, 7, 8, 10]
    assert decontamination.drop_leaks(clashing, items).columns == clashing.columns


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_each_occurrence_is_tested(spark, most):
    ask = "{0} has {1} apples and gives {2} kg of them away, so how many apples does {0} keep in the old basket?".format
    fruit = "the farmer puts {} ripe apples and {} green pears into one box before the market opens".format
    f = "other words stand here before and after what was taken from elsewhere " * 5
    items = spark.createDataFrame([(1, ask("Tom", 12, 5)), (2, fruit(5, 5))], "item_id long, text string")
    rows = [
        (1, f"{ask('Bob', 30, 7)} {f} {ask('Sam', 12, 4)}"),
        (2, f"{ask('Bob', 30, 7)} {f} Eve has 9 apples and gives 8 kg of them"),
        (3, f"{f} {fruit(7, 9)} {f}"),
        (4, f"{ask('Bob', 30, 7).replace('away', 'quite away')} {f} {ask('Sam', 12, 4).replace('away,', '')}"),
        (5, f"Bob has 30 apples and gives 7 kg of them away, {f} so how many apples does Bob keep in the old basket?"),
        (6, ask("Bob", 30, 7).replace("does Bob", "does Sam")),
        (7, f"{ask('Bob', 30, 7)} {f} {ask('Tom', 12, 5)}"),
    ]
    got = decontamination.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items, max_broadcast_windows=most).collect()
    kinds = {(r["doc_id"], r["item_id"]): r["kind"] for r in got}
    assert kinds == {(1, 1): "re-parameterised", (2, 1): "re-parameterised", (3, 2): "re-parameterised", (4, 1): "re-parameterised", (5, 1): "re-parameterised", (7, 1): "verbatim"}
    assert all(r["coverage"] == 1 for r in got if r["doc_id"] in (1, 2, 3, 7))


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_items_of_few_words_are_found_verbatim(spark, most):
    f = "other words stand here before and after what was taken from elsewhere"
    texts = ["12 + 30 = 42, 17 * 3 = 51, 9 - 4 = 5, 88 / 8 = 11", "Anders, Bjarne, Cecilie, Dagmar, Espen, Frode, Gudrun, Halvor, Ingrid, and Jorunn", "347 + 589 = 936", "find 12 km 30 m 5 cm 7 mm as one length"]
    items = spark.createDataFrame([*enumerate(texts, 1), (5, "42"), (6, "short words here")], "item_id long, text string")
    rows = [(i, f"{f} {t} {f}") for i, t in enumerate(texts, 1)]
    rows += [(5, f"{f} 42 {f}"), (6, f"{f} short words here"), (7, f"{f} 348 + 589 = 937 and 13 + 31 = 44, 18 * 3 = 54, 8 - 4 = 4, 80 / 8 = 10"), (8, f"{f} {texts[1].upper()}")]
    got = decontamination.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items, max_broadcast_windows=most).collect()
    assert sorted((r["doc_id"], r["item_id"], r["coverage"], r["kind"]) for r in got) == [*((i, i, 1.0, "verbatim") for i in (1, 2, 3, 4)), (8, 2, 1.0, "verbatim")]


@pytest.mark.parametrize("words", [500_000, 3])
def test_copies_in_another_case(spark, monkeypatch, words):
    monkeypatch.setattr(decontamination, "MAX_VOCABULARY", words)
    texts = ["Onhe went with Marla and Petrus to see the old Straße where Quill sold his last 3 red boats", "Thtieding met Onhe. Erensh was there. Marla left. Then Quill sang to them for an hour, and Oswin slept"]
    items = spark.createDataFrame([*enumerate(texts)], "item_id long, text string")
    rows = [(10 * i + j, f"words before it {f(t)} and words after it") for i, t in enumerate(texts) for j, f in enumerate((str, str.lower, str.upper, str.title, str.swapcase))]
    got = decontamination.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["coverage"], r["kind"]) for r in got) == [(d, d // 10, 1.0, "verbatim") for d, _ in rows]
