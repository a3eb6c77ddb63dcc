"""Link graphs, ranked search and vector codes against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import linkgraph, ranking, vafile
from tests.llm.conftest import prose

# ---------------------------------------------------------------- link graph


def brute_judgement(pages, rules):
    """Page by page and walk by walk in plain Python: (page_id, host, path, rule, verdict, trust, distrust)."""
    import re

    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return host.lower(), re.match(r"[^?#]*", rest[len(host) :])[0]

    rows = []
    for i, url, html in pages:
        host, path = split(url)
        fits = [(-len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rows.append((i, host, path, html, *(min(fits)[1:] if fits else (None, None))))
    count = {v: Counter(r[1] for r in rows if r[5] == v) for v in ("allow", "block")}
    every = Counter(r[1] for r in rows)
    links = set()
    for _, host, _, html, _, _ in rows:
        for kind in (r"(?:href|src|action)\s*=\s*[\"']?(?:[a-zA-Z][\w+.-]*:)?//([^/?#\"'\s<>]*)", r"[\w.%+-]@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"):
            links |= {(host, d.lower()) for d in re.findall(kind, html or "", re.ASCII) if host and d and d.lower() != host}
    mass = []
    for v, ways in (("allow", links), ("block", {(b, a) for a, b in links})):
        out, front, total = defaultdict(list), {h: n * linkgraph.SCALE // sum(count[v].values()) for h, n in count[v].items()}, Counter()
        for a, b in ways:
            out[a].append(b)
        for _ in range(linkgraph.ROUNDS + 1):
            total.update(front)
            after = Counter()
            for a, m in front.items():
                for b in out[a]:
                    after[b] += m * 85 // (100 * len(out[a]))
            front = after
        mass.append(total)
    share = {h: n * linkgraph.SCALE // len(rows) for h, n in every.items()}
    bad = lambda h: 0 < mass[1][h] >= 3 * mass[0][h] + share[h]
    return [(i, h, p, rule, v or ("block" if bad(h) else "allow"), mass[0][h], mass[1][h]) for i, h, p, _, rule, v in rows]


def web(rng, n):
    hosts = [f"{a}.{b}" for a in ("www", "m", "x") for b in ("good.org", "bad.com", "plain.io", "some.net")]
    pages = []
    for i in range(n):
        links = "".join(f'<a class=l HREF href="http://{rng.choice(hosts)}/p{j}">t</a> ' for j in range(rng.randint(0, 3)))
        url = f"http{'s' * (i % 2)}://{rng.choice(hosts).upper() if i % 5 == 0 else rng.choice(hosts)}/{rng.choice(['de', 'en', 'fr'])}/{i}"
        pages.append((i, url, links if i % 11 else None))
    return [*pages, (None, None, links), (7, "x", "<a href=//www.bad.com>"), (n, "http://lone.io", ""), (n + 1, "http://farm.io/", "<a href=//www.bad.com>")]


@pytest.mark.parametrize("broadcast_hosts", [100, 0])
def test_judgement_against_brute_force(spark, broadcast_hosts):
    rules = [("good.org", "/en/", "allow"), ("bad.com", "/", "block"), ("m.bad.com", "/fr/", "allow"), ("net", "/de/", "block"), ("net", "/de/1", "allow")]
    pages = web(random.Random(3), 150)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = linkgraph.judge_urls(df, rules, broadcast_hosts=broadcast_hosts)
    key = lambda r: tuple((x is not None, x) for x in r)
    want = brute_judgement(pages, rules)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert {r[4] for r in want if r[3] is None} == {"allow", "block"} and any(r[5] and r[6] for r in want)


def test_distrust_goes_to_those_that_link_to_blocked_hosts(spark):
    """A farm of unruled hosts that link to a blocked one is blocked; hosts that trusted ones link to, and lone ones, are not."""
    pages = [(i, f"http://farm{i}.io/", '<a href="http://spam.com/">x</a>') for i in range(5)]
    pages += [(10 + i, f"http://spam.com/{i}", '<a href="http://news.io/">x</a>') for i in range(5)]
    pages += [(20 + i, f"http://trusted.org/{i}", '<a href="http://news.io/">x</a>') for i in range(5)]
    pages += [(30, "http://news.io/", None), (31, "http://lone.io/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["host"]: r["verdict"] for r in linkgraph.judge_urls(df, [("spam.com", "/", "block"), ("trusted.org", "/", "allow")]).collect()}
    assert got == {**{f"farm{i}.io": "block" for i in range(5)}, "spam.com": "block", "trusted.org": "allow", "news.io": "allow", "lone.io": "allow"}


def test_judgement_is_native(spark, tmp_path):
    web_rows = spark.createDataFrame(web(random.Random(4), 40), "page_id long, url string, html string")
    web_rows.write.parquet(f"{tmp_path}/p")
    got = linkgraph.judge_urls(spark.read.parquet(f"{tmp_path}/p"), [])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert {r["verdict"] for r in got.select("verdict").distinct().collect()} == {"allow"}


# ---------------------------------------------------------------- ranked search


def brute_ranks(docs, items, k=10):
    import re

    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(low(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    of = defaultdict(set)
    for i, t in items:
        of[i] |= set(low(t))
    out = []
    for i, terms in of.items():
        scored = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in terms if t in b)
            if score:
                scored.append((-score, d is None, d or 0))
        out += [(i, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("block_terms", [20_000, 30])
def test_ranks_against_brute_force(spark, corpus, block_terms):
    docs = [(r[0], r[1]) for r in corpus] + [(500, "ÉCOLE école 12 École"), (501, "a " * 3000 + "th")]
    items = [(1, corpus[4][1][:200]), (2, corpus[95][1]), (3, None), (4, " ,. "), (5, "TH er"), (5, "on th"), (None, corpus[3][1][:60]), (6, "ÉCOLE école"), (7, "nowhere_to be xfound")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = ranking.rank_documents(d, q, block_terms=block_terms)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_ranks(docs, items), key=key)


def test_search_opens_few_leaves_and_equal_bounds():
    """A segment of many leaves: the same best as by scoring all; a rare term opens few leaves; ties keep the least ids."""
    rng = np.random.default_rng(2)
    n_docs, n_terms = 9_000, 300
    counts = rng.integers(1, 12, n_docs)
    terms = np.concatenate([np.sort(rng.choice(n_terms - 1, c, replace=False)) for c in counts])
    tfs = rng.integers(1, 5, len(terms))
    rare = np.flatnonzero(np.isin(np.repeat(np.arange(n_docs), counts), [17, 4444, 8999]))
    terms[rare] = n_terms - 1
    weights = rng.integers(1, 3000, n_terms)
    s = ranking.Segment(pa.array(rng.permutation(n_docs)), counts * 3, counts, terms, tfs, weights, n_docs, int(counts.sum() * 3))
    assert [x.shape[1] for x in s.levels] == [141, 9, 1]
    for q in [rng.choice(n_terms, 6, replace=False) for _ in range(40)] + [np.array([n_terms - 1])]:
        scores = np.zeros(n_docs, np.int64)
        hit = np.isin(s.terms[s.term], q)
        np.add.at(scores, s.doc[hit], s.gain[hit])
        want = sorted((int(x), int(i)) for x, i in zip(-scores, range(n_docs), strict=True) if x < 0)[:10]
        got, opened = s.search(np.sort(q), 0, 10)
        assert got == want
        if len(want) == 10:
            assert s.search(np.sort(q), -want[-1][0], 10)[0] == want
    assert opened == 3


def test_long_text_in_pieces():
    text = ("é" * 7 + " ab12 ") * 120_000 + "tail"
    raw = text.encode()
    pieces = list(ranking._pieces(raw))
    assert len(pieces) > 1 and b"".join(pieces) == raw
    v = ranking.Vocabulary({b"ab12", "é".encode() * 7, b"tail", b"none"})
    found = Counter()
    for p in pieces:
        _, ids = v.find(*ranking.spans(p))
        found.update(v.terms[i] for i in ids.tolist())
    assert found == {b"ab12": 120_000, "é".encode() * 7: 120_000, b"tail": 1}


# ---------------------------------------------------------------- vector codes


@pytest.mark.parametrize("entries", [1, 2, 5, 64, 200])
@pytest.mark.parametrize("bits", [1, 4, 7])
def test_nearest_entries_against_all(entries, bits):
    rng = np.random.default_rng(entries)
    book = rng.integers(-30, 30, (entries, 4))
    book[entries // 2 :] = book[: entries - entries // 2]  # repeated entries: the least index wins
    queries = rng.integers(-45, 45, (700, 4))
    got, d2, refined = vafile.CellFile(book, bits).nearest(queries)
    every = ((queries[:, None] - book[None]) ** 2).sum(axis=2)
    assert (got == every.argmin(axis=1)).all() and (d2 == every.min(axis=1)).all()
    assert len(queries) <= refined <= every.size
    if entries == 64 and bits == 4:
        assert refined < 0.15 * every.size


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64), y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[1].tolist()))
    x = np.array([r[1] for r in kept]).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    near = lambda: ((x[:, :, None] - books[None]) ** 2).sum(axis=3)
    for _ in range(rounds):
        own = near().argmin(axis=2)
        for p in range(parts):
            for e in range(len(books[p])):
                if (own[:, p] == e).any():
                    books[p, e] = x[own[:, p] == e, p].sum(axis=0) // (own[:, p] == e).sum()
    d = near()
    return books, [(r[0], "".join(f"{e:02x}" for e in d[k].argmin(axis=1)), int(d[k].min(axis=1).sum()), r[2]) for k, r in enumerate(kept)]


def test_codes_against_brute_force(spark):
    from tests.llm.test_contracts import vectors

    rows = [(*r[:2], r[2]) for r in vectors(130)]
    df = spark.createDataFrame([*rows, (500, [1.0, 2.0], 1), (501, [], 1)], "vec_id long, embedding array<float>, label int").repartition(4)
    books, codes = brute_codes(rows)
    per = Counter()
    for _, _, e, y in codes:
        per[y] += e
    want = Counter((i, c, e, per[y], vafile.codebooks_digest(list(books))) for i, c, e, y in codes)
    for most in (100, 0):
        assert Counter(map(tuple, vafile.code_vectors(df, broadcast_labels=most).collect())) == want


def test_few_vectors_give_short_codebooks(spark):
    rows = [(3, [0.5] * 16, None), (1, [-0.25] * 16, 4), (2, None, 4)]
    got = vafile.code_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long"))
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got.collect()) == [(1, "00" * 16, 0), (3, "01" * 16, 0)]
