"""Mixing sources to target weights by iterative proportional fitting.

Token totals of (source, language, topic) cells are raked to marginal targets; each cell's inclusion probability is held
at or below 1, and documents are drawn by a hash of their id against the probability of their cell.
"""

from __future__ import annotations

import functools
import logging
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.textops import discard, shared_folder, written

MARGINS = ("source", "lang", "topic")
FRACTION = 0.5
SMOOTHING = 0.7
TOLERANCE = 1e-3
MAX_CYCLES = 50
SMALL_CELLS = 50_000
TOPICS_PER_LANG, WORDS_PER_TOPIC = 4, 60
WATER_ROUNDS = 12
#: Up to so many words that are neither rare nor everywhere are broadcast; beyond that they are shuffled.
BROADCAST_WORDS = 500_000
#: So many counted words a task holds before it hands its partial sums on.
HELD_WORDS = 500_000
_RUNS = re.compile(r"[^\W\d_]+")
SALTS = 32


def token_count(text: Column) -> Column:
    """Tokens by ASCII blanks; null counts as none."""
    for blank in "\t\n\v\f\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.coalesce(F.array_size(F.array_remove(F.split(text, " "), "")), F.lit(0)).cast("long")  # one blank needs no pattern


def words_pattern(words: list[str]) -> str:
    """A pattern of whole words (runs of letters): alternatives share their beginnings, so a text is walked about once."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def alternatives(at: dict) -> str:
        ways = [re.escape(c) + alternatives(below) for c, below in sorted(at.items()) if c]
        if not ways:
            return ""
        joined = ways[0] if len(ways) == 1 and "" not in at else f"(?:{'|'.join(ways)})"
        return f"{joined}?" if "" in at else joined

    return rf"(?<!\p{{L}}){alternatives(tree)}(?!\p{{L}})"


def _words(text: str) -> list[str]:
    """Runs of letters (category L, as the pattern of ``words_pattern``) of 4 to 40 characters."""
    found = []
    for w in _RUNS.findall(text):
        found += [w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split()
    return [w for w in found if 4 <= len(w) <= 40]


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    """(lang, text) of rows (lang, doc, text) without those whose language and hash came before; equal ones are in one task."""
    seen = set()
    for b in batches:
        for lang, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (lang, doc) not in seen:
                seen.add((lang, doc))
                yield lang, text


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``word_counts`` for ``mapInArrow``, as partial sums: what the counts of the plan are tested against."""
    df, tf = defaultdict(Counter), defaultdict(Counter)

    def held() -> Iterator[pa.RecordBatch]:
        for lang, of in df.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(of), pa.string()), "w": pa.array(list(of), pa.string()), "df": pa.array(list(of.values()), pa.int64()), "tf": pa.array([tf[lang][w] for w in of], pa.int64())})

    n = 0
    for lang, text in _first_seen(batches):
        words = _words(text)
        df[lang].update({"", *words})
        tf[lang].update(words)
        n += 1
        if n % 1000 == 0 and sum(map(len, df.values())) > HELD_WORDS:
            yield from held()
            df.clear(), tf.clear()
    yield from held()


def letter_runs(low: Column) -> Column:
    """All runs of letters of a lower-case text, as an array; it can hold an empty one."""
    return F.split(low, r"[^\p{L}]+")


def distinct_texts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, runs), the lower-case words of 4 to 40 letters of every text that is not null, equal texts of a language once, written."""
    text = F.col(text_col).cast("string")
    texts = df.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.xxhash64(text).alias("doc"), F.lower(text).alias("text"))
    return written(texts.dropDuplicates(["lang", "doc"]).select("lang", F.filter(letter_runs(F.col("text")), lambda w: F.length(w).between(4, 40)).alias("runs")))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, w, df, tf): in how many of ``distinct_texts`` each word of 4 to 40 letters is, and how often; ``''`` counts the texts."""
    own = texts.select("lang", F.array_distinct("runs").alias("own"), "runs")
    each = own.select("lang", F.size("own").alias("n"), F.posexplode(F.concat("own", "runs")).alias("at", "w"))  # each word once, then as often as it comes
    counts = each.groupBy("lang", "w").agg(F.count_if(F.col("at") < F.col("n")).alias("df"), F.count_if(F.col("at") >= F.col("n")).alias("tf"))
    return texts.groupBy("lang").agg(F.count(F.lit(1)).alias("df")).select("lang", F.lit("").alias("w"), "df", F.lit(0).cast("long").alias("tf")).union(counts)


def words_beside(texts: DataFrame, seeds: dict[str, list[str]], common: DataFrame) -> DataFrame:
    """(lang, seed, w, n): in how many of ``distinct_texts`` that hold a seed of their language each word of ``common`` is."""
    of = F.array().cast("array<string>")
    for lang, words in seeds.items():
        of = F.when(F.col("lang") == lang, F.array(*[F.lit(w) for w in words])).otherwise(of)
    near = texts.select("lang", F.array_sort(F.array_intersect("runs", of)).alias("near"), "runs").filter(F.size("near") > 0)
    known = common.select("lang", "w")
    known = F.broadcast(known) if known.count() <= BROADCAST_WORDS else known
    met = near.select("lang", "near", F.explode(F.array_distinct("runs")).alias("w")).join(known, ["lang", "w"]).groupBy("lang", "near", "w").agg(F.count(F.lit(1)).alias("n"))
    return met.select("lang", F.explode("near").alias("seed"), "w", "n").groupBy("lang", "seed", "w").agg(F.sum("n").alias("n"))


def topic_lexicon(df: DataFrame, text_col: str = "text", lang_col: str = "lang", topics: int = TOPICS_PER_LANG, words: int = WORDS_PER_TOPIC) -> dict[str, dict[str, list[str]]]:
    """The words of up to ``topics`` topics of each language, learned from every text; equal texts count once.

    A topic is named by its seed: a word in a fiftieth to a fifth of the language's texts that comes again within them
    more often than if strewn by chance. Every other word in a hundredth to a fifth of the texts goes to the seed that it
    shares texts with most above chance, and each topic keeps the ``words`` that speak most for it. Each language has topics of
    its own, however many languages there are; null is a language, too.
    """
    _ensure_checkpoints(df.sparkSession)
    texts = distinct_texts(df, text_col, lang_col)
    every = word_counts(texts).checkpoint()
    size = every.filter("w = ''").select("lang", F.col("df").alias("texts"))
    seen = every.filter("w <> ''").join(F.broadcast(size), "lang")  # a row for each language
    common = seen.filter((F.col("df") >= F.greatest(F.lit(2), F.col("texts") / 100)) & (F.col("df") <= F.greatest(F.lit(2), F.col("texts") / 5))).checkpoint()
    extra = F.log2(F.col("texts") / F.col("df")) + F.log2(1 - F.exp(-F.col("tf") / F.col("texts")))
    ranked = common.filter(F.col("df") >= F.greatest(F.lit(3), F.col("texts") / 50)).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc(extra), "w")))
    seeds = ranked.filter(F.col("r") <= topics).select("lang", F.col("w").alias("seed"), F.col("df").alias("seed_df")).checkpoint()
    of_lang: dict[str, list[str]] = {}
    for r in seeds.select("lang", "seed").collect():  # topics rows for each language
        of_lang.setdefault(r["lang"], []).append(r["seed"])
    beside = words_beside(texts, of_lang, common)
    both = beside.join(common.select("lang", "w", "df", "texts"), ["lang", "w"]).join(F.broadcast(seeds), ["lang", "seed"])
    lift = F.col("n") * F.col("texts") / (F.col("df") * F.col("seed_df"))
    own = both.filter((F.col("n") >= 2) | (F.col("w") == F.col("seed"))).groupBy("lang", "w").agg(F.max_by(F.struct("seed", (F.col("n") * F.log2(lift)).alias("gain")), F.struct(F.when(F.col("w") == F.col("seed"), 1).otherwise(0), lift, "seed")).alias("b"))
    best = own.select("lang", "w", "b.*").withColumn("r", F.row_number().over(Window.partitionBy("lang", "seed").orderBy((F.col("w") == F.col("seed")).desc(), F.desc("gain"), "w"))).filter((F.col("r") <= words) & ((F.col("gain") > 0) | (F.col("w") == F.col("seed"))))
    out: dict[str, dict[str, list[str]]] = {}
    for r in best.groupBy("lang", "seed").agg(F.array_sort(F.collect_list("w")).alias("words")).orderBy("lang", "seed").collect():  # topics x words for each language
        out.setdefault(r["lang"], {})[r["seed"]] = r["words"]
    discard(texts)
    return out


def topic_of(low: Column, lang: Column, lexicon: dict[str, dict[str, list[str]]]) -> Column:
    """The topic of whose words, as whole words, a lower-case text has most, of equals the first; ``other`` without any."""
    topic = F.when(F.lit(False), F.lit(""))
    for of, topics in lexicon.items():
        every = sorted({w for ws in topics.values() for w in ws})
        if all(w.isalpha() for w in every):
            hits = F.filter(letter_runs(low), lambda w: w.isin(every))  # noqa: B023
        else:
            hits = F.regexp_extract_all(low, F.lit(words_pattern(every)), F.lit(0))
        names = list(topics)
        count = lambda h, ws: F.size(F.filter(h, lambda w: w.isin(ws)))
        of_hits = lambda h: F.array_max(F.array(*[F.struct(count(h, topics[t]).alias("n"), F.lit(-i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(names)]))  # noqa: B023, E731
        best = F.transform(F.transform(F.array(hits), of_hits), lambda b: F.when(b["n"] > 0, b["t"]))  # named once, as a branch reckons anew what it names twice
        topic = topic.when(lang == of, F.element_at(best, 1))
    return F.coalesce(topic, F.lit("other"))


def with_mix_keys(df: DataFrame, text_col: str = "text", lexicon: dict[str, dict[str, list[str]]] | None = None, lang_col: str = "lang", topics: int = TOPICS_PER_LANG, words: int = WORDS_PER_TOPIC) -> DataFrame:
    """Add n_tokens and topic, in place of columns of these names; in the mix a null source or lang is ``(none)``.

    The topic is the one of ``lexicon``'s topics of the row's language of whose words the whole text has most; without a
    ``lexicon`` it is learned from the table itself (see ``topic_lexicon``). A null or empty text, and one with none of these
    words, has the topic ``other``; a null or empty one has no tokens.
    """
    lexicon = topic_lexicon(df, text_col, lang_col, topics, words) if lexicon is None else lexicon
    low = df.drop("n_tokens", "topic").withColumns({"n_tokens": token_count(F.col(text_col)), "__low": F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), "__lang": F.coalesce(F.col(lang_col).cast("string"), F.lit(""))})
    return low.withColumn("topic", topic_of(F.col("__low"), F.col("__lang"), lexicon)).drop("__low", "__lang")


def _ensure_checkpoints(spark: SparkSession) -> None:
    if not spark.conf.get("spark.checkpoint.dir", None):
        shared_folder(spark)


def _keyed(df: DataFrame, margins: tuple[str, ...], others: list[str]) -> DataFrame:
    """The margins as keys __name and the columns named; the row itself is one column, so that no name can clash."""
    keys = [F.coalesce(F.col(m).cast("string"), F.lit("(none)")).alias(f"__{m}") for m in margins]
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *keys, *[F.col(c).alias(f"__of_{c}") for c in others])


def targets_of(cells: DataFrame, margin: str, smoothing: float = SMOOTHING) -> DataFrame:
    """Default target shares of a margin: proportional to its tokens to the power ``smoothing``."""
    totals = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("t")).filter("t > 0")
    powered = totals.withColumn("p", F.pow("t", F.lit(smoothing)))
    return powered.crossJoin(F.broadcast(powered.agg(F.sum("p").alias("s")))).select("value", (F.col("p") / F.col("s")).alias("share"))  # one row beside each


def count_cells(df: DataFrame, margins: tuple[str, ...] = MARGINS) -> DataFrame:
    """Tokens and documents of every combination of the margins' values that occurs, checkpointed."""
    _ensure_checkpoints(df.sparkSession)
    return _keyed(df, margins, ["n_tokens"]).groupBy(*[f"__{m}" for m in margins]).agg(F.sum("__of_n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).checkpoint()


def tempered_targets(cells: DataFrame, margins: tuple[str, ...] = MARGINS, fraction: float = FRACTION, smoothing: float = SMOOTHING) -> dict[str, DataFrame]:
    """Targets (value, share) of every margin of ``count_cells`` that can all be reached together, with no probability above 1.

    They are the margins of one mix: each cell is drawn in proportion to the product, over its values, of their tokens to the
    power ``smoothing`` - 1, at most wholly, and so that ``fraction`` of all tokens is drawn. Small values are favoured as far as
    they go; what they lack is taken from all others.
    """
    keys = [f"__{m}" for m in margins]
    cells = cells.filter("tokens > 0").select(*keys, "tokens", F.lit(1.0).alias("w"))
    for k in keys:
        totals = cells.groupBy(k).agg(F.sum("tokens").alias("t"))
        cells = cells.join(totals, k).withColumn("w", F.col("w") * F.pow("t", F.lit(smoothing - 1))).drop("t")
    cells = cells.checkpoint()
    total, weighted = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum(F.col("tokens") * F.col("w")), F.lit(0.0))).first()
    scale = fraction * total / weighted if weighted else 0.0
    drawn = lambda: F.col("tokens") * F.least(F.col("w") * scale, F.lit(1.0))
    for _ in range(WATER_ROUNDS):  # what full cells cannot give is spread over the rest
        full, rest = cells.agg(F.coalesce(F.sum(F.when(F.col("w") * scale >= 1, F.col("tokens"))), F.lit(0)), F.sum(F.when(F.col("w") * scale < 1, F.col("tokens") * F.col("w")))).first()
        better = max(scale, (fraction * total - full) / rest) if rest else scale
        if better <= scale * (1 + 1e-9):
            break
        scale = better
    mixed = cells.select(*keys, drawn().alias("d")).checkpoint()
    whole = mixed.agg(F.sum("d")).first()[0] or 1.0
    return {m: mixed.groupBy(F.col(f"__{m}").alias("value")).agg((F.sum("d") / F.lit(float(whole))).alias("share")) for m in margins}


def rake(df: DataFrame, targets: dict[str, DataFrame] | None = None, margins: tuple[str, ...] = MARGINS, fraction: float = FRACTION, smoothing: float = SMOOTHING, tolerance: float = TOLERANCE, max_cycles: int = MAX_CYCLES, small_cells: int = SMALL_CELLS, tempered: bool = False) -> tuple[DataFrame, int]:
    """Cells with their inclusion probabilities, and the number of cells.

    ``df`` has the margins and n_tokens. Margins without ``targets`` have those of ``tempered_targets``, if ``tempered``, else
    each its own of ``targets_of``. A target is a DataFrame (value, share) with shares summing to 1; a value without
    a target gets probability 0, and a target whose value has no tokens is left out. Each cycle scales the cells of every
    value of every margin to its target, then holds probabilities at 1; cycles end when no margin is further than
    ``tolerance`` of its target. Targets can contradict each other or exceed what there is: once a cycle brings the
    margins no nearer, or after ``max_cycles``, a warning names how far off they still are (see ``margins_reached``).
    Cells are one row for each combination of values that occurs, and are checkpointed each cycle.
    """
    cells = count_cells(df, margins)
    if tempered:
        targets = tempered_targets(cells, margins, fraction, smoothing) | (targets or {})
    cells = cells.withColumn("p", F.lit(float(fraction)))
    n, total = cells.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    if not total:
        return cells, n
    for m in margins:
        t = targets[m].select(F.coalesce(F.col("value").cast("string"), F.lit("(none)")).alias(f"__{m}"), "share") if targets and m in targets else targets_of(cells, f"__{m}", smoothing).withColumnRenamed("value", f"__{m}")
        cells = cells.join(t.select(f"__{m}", (F.col("share") * float(fraction) * float(total)).alias(f"want_{m}")), f"__{m}", "left").na.fill(0.0, [f"want_{m}"])
    cells = cells.withColumn("off", F.lit(0.0)).checkpoint()
    step, worst = _scaled_by_window if n <= small_cells else _scaled_by_join, None
    for _ in range(max_cycles):
        before = worst
        cells = cells.withColumn("off", F.lit(0.0))
        for m in margins:
            cells = step(cells, m)
        cells = cells.checkpoint()
        worst = cells.agg(F.max(F.when(F.col("p") < 1, F.col("off")))).first()[0]
        if worst is None or worst <= tolerance or (before is not None and worst > 0.99 * before):
            break
    if worst is not None and worst > tolerance:
        logging.getLogger(__name__).warning("targets are not reached: a margin is %.3f of its target off", worst)
    return cells, n


def margins_reached(cells: DataFrame, margins: tuple[str, ...] = MARGINS) -> DataFrame:
    """(margin, value, wanted, reached): expected tokens of each value, as the targets want them and as ``rake`` gives."""
    out = [cells.groupBy(F.lit(m).alias("margin"), F.col(f"__{m}").alias("value")).agg(F.max(f"want_{m}").alias("wanted"), F.sum(F.col("tokens") * F.col("p")).alias("reached")) for m in margins]
    return functools.reduce(DataFrame.unionByName, out)


def _scale(cells: DataFrame, m: str) -> DataFrame:
    """Apply the ratio of what a margin wants to what it has now, in column now."""
    r = F.when(F.col("now") > 0, F.col(f"want_{m}") / F.col("now")).otherwise(1.0)
    return cells.withColumns({"p": F.least(F.col("p") * r, F.lit(1.0)), "off": F.greatest("off", F.abs(r - 1))}).drop("now")


def _scaled_by_window(cells: DataFrame, m: str) -> DataFrame:
    """For few cells: all cells of a margin's value fit in a task."""
    return _scale(cells.withColumn("now", F.sum(F.col("tokens") * F.col("p")).over(Window.partitionBy(f"__{m}"))), m)


def _scaled_by_join(cells: DataFrame, m: str) -> DataFrame:
    """For many cells: sums are combined before the shuffle, and the cells stay where they are or are split by AQE."""
    cells = cells.checkpoint()
    now = cells.groupBy(f"__{m}").agg(F.sum(F.col("tokens") * F.col("p")).alias("now"))
    return _scale(cells.join(now, f"__{m}"), m)


def mix(df: DataFrame, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", margins: tuple[str, ...] = MARGINS, fraction: float = FRACTION, smoothing: float = SMOOTHING, seed: int = 17, small_cells: int = SMALL_CELLS, tolerance: float = TOLERANCE, max_cycles: int = MAX_CYCLES, tempered: bool = False) -> DataFrame:
    """Every input row with weight, probability and selected.

    ``df`` has the margins and n_tokens. A row's probability is its cell's; weight is its inverse (null where the
    probability is 0); a row is selected if a uniform hash of (id, seed) lies below the probability, so equal ids are
    drawn together and a draw can be repeated. Rows with a null id share one draw. Null margins are the value
    ``(none)``. Rows without tokens follow their cell; texts of any length count by their tokens. An empty table gives no
    rows. Columns of the input that bear a result's name are replaced; all others keep their values, whatever their names.

    Cells are broadcast while there are at most ``small_cells``; beyond that they are joined on salted keys, so that
    no source, however large, goes to one task.
    """
    df = df.drop("weight", "probability", "selected")
    cells, n = rake(df, targets, margins, fraction, smoothing, tolerance, max_cycles, small_cells, tempered)
    keys = [f"__{m}" for m in margins]
    cells = cells.select(*keys, F.col("p").alias("probability"))
    keyed = _keyed(df, margins, [id_col])
    if n <= small_cells:
        joined = keyed.join(F.broadcast(cells), keys)
    else:
        salted = cells.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("__salt", F.pmod(F.xxhash64(f"__of_{id_col}"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "__salt"])
    uniform = F.pmod(F.xxhash64(F.col(f"__of_{id_col}"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return joined.select("__row.*", F.when(F.col("probability") > 0, 1 / F.col("probability")).alias("weight"), "probability", (uniform < F.col("probability")).alias("selected"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    keys = written(with_mix_keys(docs).drop("text"))
    return mix(keys, tempered=True).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "weight", "selected")
