"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question that was asked again with other values has the same
template. Windows of template tokens are joined by hash with those of the benchmark, and the values that stand in the
slots are compared: a re-asked question puts one name for one name throughout. Each place of a document where an item
stands is tested by itself, and then the whole document.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.textops import map_text, mix, powers, text_slices, without_ids, written

WINDOW = 8
MIN_TOKENS = 5
MIN_LITERAL = 2
MIN_COVERAGE = 0.5
GAP_SHARE = 0.25
MAX_BROADCAST_WINDOWS = 2_000_000
MAX_VOCABULARY = 500_000
UNITS = frozenset("mm cm m km inch inches ft foot feet yd yards mi mile miles mg g kg lb lbs oz ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years % percent usd eur gbp dollar dollars euro euros cent cents kmh mph km/h m/s °c °f degrees kw hz khz mhz ghz kb mb gb tb".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
_GLUED = re.compile(r"(\d)(?=[^\W\d_]|[%°])")
_EDGE = re.compile(r"^[^\w$€£+°%-]+|[^\w%°$€£]+$")
_USUAL = ".,;:!?'\"()[]{}<>*&#|/"
WORD, NUM, UNIT, NAME = 0, 1, 2, 3
_LITERAL = np.uint64(0x51_7E_A1)
_PLACEHOLDER = {NUM: "<num>", UNIT: "<unit>", NAME: "<name>"}


def canonical(raw: str, known: frozenset[str], names: frozenset[str] = frozenset()) -> tuple[int, str]:
    """(type, value) of one token: a placeholder type with its case-folded value, or a word. Empty value: no token.

    A word among ``names``, which the benchmark always capitalises, is a name in any case, one among ``known``, its other
    words, never; of all others the capitalised ones are names. So the type of a token depends on the token alone,
    wherever it stands, and that of the benchmark's words not on case.
    """
    token = _EDGE.sub("", raw)
    low = token.casefold()
    if not low:
        return WORD, ""
    if _NUMBER.fullmatch(token):
        return NUM, low
    if low in UNITS:
        return UNIT, low
    if low in names or (token[0].isupper() and low not in known):
        return NAME, low
    return WORD, low


class _Codes(dict):
    """64-bit codes of raw tokens, remembered; a type's code has the type in the two low bits, a word's has zeros."""

    def __init__(self, known: frozenset[str], names: frozenset[str] = frozenset()):
        super().__init__()
        self.known, self.names = known, names
        self.values: dict[str, int] = {}

    def __missing__(self, raw: str) -> int:
        if len(self) > 300_000:
            self.clear()
            self.values.clear()
        token = raw.strip(_USUAL)
        if token.isalpha() and token.islower() and token not in UNITS and (value := token.casefold()) not in self.names:
            kind = WORD  # what canonical() says of most tokens
        else:
            kind, value = canonical(raw, self.known, self.names)
        code = 0 if not value else kind if kind else (xxhash.xxh3_64_intdigest(value) | 4) & ~3
        self[raw] = code
        return code


    def literal(self, codes: np.ndarray, raw: list[str]) -> np.ndarray:
        """The codes with those of types replaced by codes of the tokens' values."""
        out = codes.copy()
        for j in np.flatnonzero(codes & np.uint64(3)):
            if (code := self.values.get(raw[j])) is None:
                code = self.values[raw[j]] = (xxhash.xxh3_64_intdigest(canonical(raw[j], self.known, self.names)[1]) | 4) & ~3
            out[j] = code
        return out


def template(text: str, codes: _Codes) -> tuple[np.ndarray, list[str]]:
    """Codes of a text's tokens, and the tokens as written; tokens without content are left out."""
    if _GLUED.search(text):
        text = _GLUED.sub(r"\1 ", text)
    raw = text.split()
    got = np.fromiter(map(codes.__getitem__, raw), np.uint64, len(raw))
    if (got == 0).any():
        raw = [r for r, c in zip(raw, got, strict=True) if c]
        got = got[got != 0]
    return got, raw


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` codes; 0 where fewer than half of them are words."""
    h = _runs(codes, width)
    return np.where(few_words(codes, width), np.uint64(0), mix(h + np.uint64(width)) | np.uint64(1))


def literal_windows(literal: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` literal codes, other than that of a template."""
    return mix(_runs(literal, width) + np.uint64(width) + _LITERAL) | np.uint64(1)


def _runs(codes: np.ndarray, width: int) -> np.ndarray:
    m = max(0, len(codes) - width + 1)
    steps, _ = powers(width + 1)
    with np.errstate(over="ignore"):
        h, mixed = np.zeros(m, np.uint64), mix(codes)
        for j in range(width if m else 0):
            h += mixed[j : j + m] * steps[j + 1]
    return h


def few_words(codes: np.ndarray, width: int) -> np.ndarray:
    """Whether fewer than half of each run of ``width`` codes are words."""
    if len(codes) < width:
        return np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum((codes & np.uint64(3)) == 0)])
    return 2 * (before[width:] - before[:-width]) < width


def slot_values(codes: np.ndarray, raw: list[str], at: int, width: int) -> list[str]:
    """Values in the slots of a window, each with its type."""
    return [f"{int(c) & 3}:{canonical(raw[at + j], frozenset())[1]}" for j, c in enumerate(codes[at : at + width]) if int(c) & 3]


def _benchmark_words(benchmark: DataFrame, text_col: str) -> tuple[frozenset[str], frozenset[str]]:
    """The benchmark's words as canonical() takes them, (known, names); its MAX_VOCABULARY most frequent if there are more.

    That bounds what is broadcast; the type of a rarer word depends on case, so its windows are hashed literally as well.
    """

    def cut(batch: pa.RecordBatch) -> dict:
        found = [canonical(raw, frozenset()) for t in batch.column(0).to_pylist() for raw in _GLUED.sub(r"\1 ", t or "").split()]
        found = [(value, kind == WORD) for kind, value in found if value and kind in (WORD, NAME)]
        return {"w": pa.array([x for x, _ in found], pa.string()), "small": pa.array([x for _, x in found], pa.bool_())}

    rows = map_text(benchmark.select(benchmark[text_col].cast("string")), 0, cut, "w string, small boolean")
    rows = rows.groupBy("w").agg(F.count("*").alias("n"), F.max("small").alias("small")).orderBy(F.desc("n"), "w").limit(MAX_VOCABULARY)
    words: dict[bool, list[str]] = {True: [], False: []}
    for r in rows.toLocalIterator():
        words[r["small"]].append(r["w"])
    return frozenset(words[True]), frozenset(words[False])


def benchmark_windows(benchmark: DataFrame, words: tuple[frozenset[str], frozenset[str]], id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(window, item_id, pos, slots, n_tokens, width, literal) of all items; one shorter than ``width`` is one window.

    A window of few words has no template, as other values would make it any text: its literal tokens are hashed. One with
    a word whose type depends on case (see ``_benchmark_words``) has both. Of the
    items of fewer than MIN_TOKENS tokens, those of few words and MIN_LITERAL tokens at least are one literal window; the
    others are left out: so short a text is found everywhere by chance.
    """

    either = words[0] | words[1]

    def cut(batch: pa.RecordBatch) -> dict | None:
        codes_of = _Codes(*words)
        out: dict[str, list] = {k: [] for k in ("window", "item_id", "pos", "slots", "n_tokens", "width", "literal")}
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes, raw = template(t or "", codes_of)
            if len(codes) < MIN_LITERAL:
                continue
            w = min(width, len(codes))
            few = few_words(codes, w)
            if len(codes) < MIN_TOKENS and not few[0]:
                continue
            open_word = np.array([c & 3 in (WORD, NAME) and canonical(r, *words)[1] not in either for c, r in zip(codes.tolist(), raw, strict=True)])
            open_run = np.convolve(open_word, np.ones(w, int), "valid") > 0
            for literal, wanted, hashes in ((False, ~few, windows(codes, w)), (True, few | open_run, literal_windows(codes_of.literal(codes, raw), w))):
                for pos in np.flatnonzero(wanted).tolist():
                    for k, v in zip(out, (int(hashes[pos].view(np.int64)), i, pos, slot_values(codes, raw, pos, w), len(codes), w, literal), strict=True):
                        out[k].append(v)
        return {"window": pa.array(out["window"], pa.int64()), "item_id": pa.array(out["item_id"], batch.schema.field(0).type), "pos": pa.array(out["pos"], pa.int32()), "slots": pa.array(out["slots"], pa.list_(pa.string())), "n_tokens": pa.array(out["n_tokens"], pa.int32()), "width": pa.array(out["width"], pa.int32()), "literal": pa.array(out["literal"], pa.bool_())}

    kind = benchmark.schema[id_col].dataType.simpleString()
    return map_text(benchmark.select(benchmark[id_col].alias("item_id"), benchmark[text_col].cast("string")), 1, cut, f"window long, item_id {kind}, pos int, slots array<string>, n_tokens int, width int, literal boolean")


def document_windows(docs: DataFrame, words: tuple[frozenset[str], frozenset[str]], widths: tuple[tuple[int, bool], ...], wanted: np.ndarray | None, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, at, window, slots) of all documents by token position; only windows among ``wanted`` if that is given.

    ``row`` tells rows with equal ids apart; ``widths`` are those of the benchmark, (width, literal). Literal windows have
    no slots: their values are the benchmark's.
    """
    shared = docs.sparkSession.sparkContext.broadcast((words, wanted))  # the caller has checked the sizes
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        words, wanted = shared.value
        codes_of = _Codes(*words)
        for batch in batches:
            for part in text_slices(batch, 1):
                at, places, win, slots = [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    codes, raw = template(t or "", codes_of)
                    literal = codes_of.literal(codes, raw) if any(x for _, x in widths) else codes
                    for w, is_literal in widths:
                        h = literal_windows(literal, w) if is_literal else windows(codes, w)
                        if wanted is not None and len(h):
                            near = np.searchsorted(wanted, h)
                            near[near == len(wanted)] = 0
                            hits = np.flatnonzero((wanted[near] == h) & (h != 0)) if len(wanted) else ()
                        else:
                            hits = np.flatnonzero(h)
                        for p in hits:
                            at.append(i)
                            places.append(p)
                            win.append(int(h[p].view(np.int64)))
                            slots.append(None if is_literal else slot_values(codes, raw, p, w))
                if at:
                    rows = pa.array(at)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(2).take(rows), pa.array(places, pa.int32()), pa.array(win, pa.int64()), pa.array(slots, pa.list_(pa.string()))], names=["doc_id", "row", "at", "window", "slots"])

    read = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string"), F.monotonically_increasing_id().alias("row"))
    return read.mapInArrow(run, f"doc_id {kind}, row long, at int, window long, slots array<string>")


def _occurrence(hits: list[dict], n_tokens: int, min_coverage: float) -> dict | None:
    """What an occurrence made of these hits is, or None: too few of the item's tokens, or names not put one for one."""
    places = {p for h in hits for p in range(h["pos"], h["pos"] + h["width"])}
    if len(places) < min_coverage * n_tokens:
        return None
    values = {v for h in hits for v in zip(h["own"], h["put"], strict=True)}
    names = [v for v in values if v[0][0] == str(NAME)]
    if len({own for own, _ in names}) < len(names) or len({put for _, put in names}) < len(names):
        return None
    return {"verbatim": all(own == put for own, put in values), "coverage": len(places) / n_tokens, "n_windows": len({h["pos"] for h in hits}), "n_slots": len(values)}


def best_occurrence(hits: list[dict], n_tokens: int, min_coverage: float) -> dict | None:
    """The best occurrence of an item in one text, or None. A hit has at, pos, width, own and put.

    Hits of one copy have one alignment, at - pos, which moves by as many tokens as an edit puts in or takes out. So for
    each alignment two occurrences are tested: its own hits, and for each place of the item the nearest hit that is at
    most GAP_SHARE of the item's tokens off. Numbers and units are free, as two quantities may be equal by chance.
    """
    lines: dict[int, list[dict]] = {}
    for h in hits:
        lines.setdefault(h["at"] - h["pos"], []).append(h)
    order, gap = sorted(lines), max(1, int(GAP_SHARE * n_tokens))
    rank = lambda x: (x["verbatim"], x["coverage"], x["n_windows"], x["n_slots"])
    best = None
    for line in sorted(order, key=lambda a: (-len(lines[a]), a)):
        near: dict[tuple[int, int], dict] = {}
        band = order[bisect.bisect_left(order, line - gap) : bisect.bisect_right(order, line + gap)]
        for a in sorted(band, key=lambda a: abs(a - line)):
            for h in lines[a]:
                near.setdefault((h["pos"], h["width"]), h)
        for found in (lines[line], list(near.values())) if len(band) > 1 else (lines[line],):
            if (x := _occurrence(found, n_tokens, min_coverage)) and (best is None or rank(x) > rank(best)):
                best = x
        if best and best["verbatim"] and best["coverage"] == 1:
            break
    return best


def _rows_of_pairs(hits: DataFrame, kind: str, item_kind: str, min_coverage: float) -> DataFrame:
    """For each row of ``hits`` (doc_id, item_id, n_tokens, hits): its best occurrence, and what the whole text holds."""
    value = pa.struct([("own", pa.string()), ("put", pa.string())])
    best = pa.struct([("verbatim", pa.bool_()), ("coverage", pa.float64()), ("n_windows", pa.int64()), ("n_slots", pa.int64())])

    def run(batches):
        for batch in batches:
            places, starts, values, found = [], [], [], []
            for n, hits in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                places.append(sorted({p for h in hits for p in range(h["pos"], h["pos"] + h["width"])}))
                starts.append(sorted({h["pos"] for h in hits}))
                values.append([{"own": own, "put": put} for own, put in sorted({v for h in hits for v in zip(h["own"], h["put"], strict=True)})])
                found.append(best_occurrence(hits, n, min_coverage))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(places, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int32())), pa.array(values, pa.list_(value)), pa.array(found, best)], names=["doc_id", "item_id", "n_tokens", "places", "starts", "values", "best"])

    return hits.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, n_tokens int, places array<int>, starts array<int>, values array<struct<own:string,put:string>>, best struct<verbatim:boolean,coverage:double,n_windows:bigint,n_slots:bigint>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, min_coverage: float = MIN_COVERAGE, max_broadcast_windows: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """One row for each document and benchmark item it holds: doc_id, item_id, coverage, n_windows, n_slots, kind.

    Windows of few words, and short items of few words, are found verbatim only (see ``benchmark_windows``).

    A pair is reported if an occurrence of the item in a text passes, or if the document does as a whole. An occurrence
    (see ``best_occurrence``) passes if template windows cover at least ``min_coverage`` of the item's tokens and its names
    are put one for one. A document, whose pieces of the item may be anywhere, passes if windows cover as much and every
    value, numbers too, is put one for one or the item's own values all occur. kind is ``verbatim`` if all values are the
    item's own, else ``re-parameterised``. Figures are those of the document if it passes, else of its best occurrence.

    A null or empty text holds nothing; a null id is a document of its own name; rows with equal ids count as one
    document. Very long texts are read whole, and each of their places is tested. Repeated benchmark items are looked for
    once and reported under each id. Only ids and texts are read, so other columns cannot clash. Either table may be
    empty: no rows.

    The benchmark's windows go to the tasks while there are at most ``max_broadcast_windows`` rows of them, so documents
    send only windows that match; beyond that all windows are shuffled and joined by Spark.
    """
    asked = benchmark.select(benchmark[item_col].alias("id"), benchmark[item_text_col].cast("string").alias("text"))
    once = asked.groupBy("text").agg(F.min("id").alias("item_id"))
    ids = asked.join(once.withColumnRenamed("text", "same"), F.col("text").eqNullSafe(F.col("same"))).select("id", F.col("item_id").alias("of")).distinct()
    words = _benchmark_words(once, "text")
    items = written(benchmark_windows(once, words, "item_id", "text", width))
    widths = tuple(sorted((r["width"], r["literal"]) for r in items.select("width", "literal").distinct().collect()))  # MIN_LITERAL to width
    n = items.count()
    wanted = None
    if n <= max_broadcast_windows:
        wanted = np.sort(items.select("window").distinct().toPandas()["window"].to_numpy(np.int64).view(np.uint64))
        items = F.broadcast(items)
    found = document_windows(docs, words, widths, wanted, id_col, text_col).withColumnRenamed("slots", "theirs")
    pairs = found.join(items, "window")
    # what a place of the item says, and what the document puts there
    hit = F.struct("at", "pos", "width", F.col("slots").alias("own"), F.coalesce("theirs", "slots").alias("put"))
    rows = pairs.groupBy("doc_id", "row", "item_id").agg(F.max("n_tokens").alias("n_tokens"), F.collect_list(hit).alias("hits")).drop("row")
    type_of = lambda c: rows.schema[c].dataType.simpleString()
    grouped = _rows_of_pairs(rows, type_of("doc_id"), type_of("item_id"), min_coverage).groupBy("doc_id", "item_id").agg(
        F.max("n_tokens").alias("n_tokens"),
        F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"),  # an item's tokens at most
        F.size(F.array_distinct(F.flatten(F.collect_set("starts")))).cast("long").alias("n_windows"),
        F.array_distinct(F.flatten(F.collect_set("values"))).alias("values"),
        F.max("best").alias("best"),
    )
    distinct = lambda c: F.size(F.array_distinct(F.transform("values", lambda v: v[c])))
    n_values = F.size("values")
    verbatim = F.forall("values", lambda v: v["own"] == v["put"])
    holds_own = F.size(F.array_except(F.transform("values", lambda v: v["own"]), F.transform(F.filter("values", lambda v: v["own"] == v["put"]), lambda v: v["own"]))) == 0
    coverage = F.size("places") / F.col("n_tokens")
    consistent = (distinct("own") == n_values) & (distinct("put") == n_values)
    whole = (coverage >= min_coverage) & (consistent | holds_own)
    figure = lambda of_whole, name: F.when(whole, of_whole).otherwise(F.col("best")[name])
    found = grouped.filter(whole | F.col("best").isNotNull()).select(
        "doc_id", "item_id", F.round(figure(coverage, "coverage"), 4).alias("coverage"), figure(F.col("n_windows"), "n_windows").alias("n_windows"), figure(n_values.cast("long"), "n_slots").alias("n_slots"), F.when(figure(verbatim | holds_own, "verbatim"), "verbatim").otherwise("re-parameterised").alias("kind")
    )
    return found.join(ids, F.col("item_id").eqNullSafe(F.col("of"))).withColumn("item_id", F.col("id")).select(found.columns)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, without the documents that hold a benchmark item.

    Rows with equal ids go together, repeated ones all; a row without an id goes by its own text. An empty table gives no
    rows, an empty benchmark all of them. Columns of any name pass through.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    own = F.when(docs[id_col].isNull(), F.concat(F.lit("text:"), F.sha2(text, 256))).otherwise(F.concat(F.lit("id:"), docs[id_col].cast("string")))
    leaks = written(find_leaks(docs.select(own.alias("doc_id"), text.alias("text")), benchmark).select("doc_id"))
    return without_ids(docs.withColumn("__own", own), leaks, "__own").select(*docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
