"""N-gram Jaccard join with adaptive multi-match prefixes.

Shingles are ordered alike in all documents, rare ones first. Of two sets that share at least t members, the prefixes
that leave out t - l members share at least l. Each document takes the l that its estimated candidates make cheapest:
a longer prefix finds more partners but asks for more shared members before a pair is verified. Equal sets are one class
throughout, pairs are compared in bounded blocks, and pairs whose classes are already connected are left out. A few rounds
that verify only the likeliest pairs connect most of a group of near copies, before all that is left is compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.textops import discard, map_text, mix, shingles, text_slices, without_ids, written
from tessera.operators.graph import connected_components

MAX_LENGTHEN = 4
VERIFY_COST = 10
SAMPLE_ONE_IN = 32
FREQUENT_IN_SAMPLE = 3
FREQUENT_BITS = 22
MOST_WORDS = 32
THIN_TO = 16
BLOCK = 512
#: What is broadcast at most: rows of up to three numbers, BROADCAST_ROW bytes each once they are hashed.
BROADCAST_BYTES = 64 << 20
BROADCAST_ROW = 64
SPANNING_ROUNDS = 3
PAIRS_AT_ONCE = 1 << 15
HUB = 64


def frequent_shingles(df: DataFrame, id_col: str, text_col: str, k: int) -> np.ndarray:
    """A bitmap of 2**FREQUENT_BITS bits in which shingles that many documents hold are marked; others may be, too.

    It only sets the order of shingles, which any choice leaves correct. It is counted on one document in SAMPLE_ONE_IN.
    """

    def count(batches):
        held = []
        for batch in batches:
            for part in text_slices(batch, 0):
                held.append(shingles(part.column(0).to_pylist(), k)[1])
        if held:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(token), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(token[at : at + 100_000].view(np.int64)), pa.array(n[at : at + 100_000])], names=["token", "n"])

    sample = df.filter(F.pmod(F.xxhash64(id_col), F.lit(SAMPLE_ONE_IN)) == 0).select(F.col(text_col).cast("string"))
    many = sample.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT_IN_SAMPLE)
    # at most 2**FREQUENT_BITS numbers
    bits = many.select(F.shiftrightunsigned("token", 64 - FREQUENT_BITS).cast("int").alias("b")).distinct().toPandas()["b"].to_numpy()
    bitmap = np.zeros(1 << FREQUENT_BITS, dtype=bool)
    bitmap[bits] = True
    return np.packbits(bitmap)


def _is_frequent(bitmap: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    at = (tokens >> np.uint64(64 - FREQUENT_BITS)).astype(np.int64)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1


def _classes(hashes: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each set, from the sums of its members' hashes."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(n), np.uint64)
        for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0xD1342543DE82EF95)):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ salt), dtype=np.uint64)])
            out = mix(out * np.uint64(3) + sums[first + n] - sums[first] + n.astype(np.uint64))
    return out.view(np.int64)


def bitmap_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of the bitmaps of sets of n members: powers of two from 4 to MOST_WORDS, more than two bits for a member.

    Small sets have more than five bits for a member, as a few members decide on them.
    """
    return np.clip(1 << np.ceil(np.log2(np.maximum(np.maximum(n, 1) / 24, np.minimum(n / 12, 8)))).clip(0).astype(np.int64), 4, MOST_WORDS)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of a bitmap at a smaller width: what a member sets there follows from what it sets here."""
    while bits.shape[1] > words:
        bits = bits[:, : bits.shape[1] // 2] | bits[:, bits.shape[1] // 2 :]
    return bits


def token_bits(df: DataFrame, text_col: str, num: int, den: int) -> int:
    """Bits of the hashes that prefixes carry: enough for one in 128 of them to meet another by chance, however many.

    A chance meeting only adds a candidate, which is verified.
    """
    n_bytes, rows = df.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)), F.count(F.lit(1))).first()
    words = n_bytes / 6
    return min(63, max(16, int(np.log2(1 + words * (1 - num / den) + MAX_LENGTHEN * rows)) + 8))


def signatures(df: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, bitmap: np.ndarray, token_width: int) -> DataFrame:
    """(doc_id, n, cls, prefix, bits) of each row: size and hash of its set, its longest prefix in order, a set bitmap."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap)  # 2**FREQUENT_BITS bits
    token = pa.int32() if token_width <= 32 else pa.int64()

    def sign(batch: pa.RecordBatch) -> dict:
        owner, h = shingles(batch.column(1).to_pylist(), k)
        rows = batch.num_rows
        n = np.bincount(owner, minlength=rows)
        first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        order = np.lexsort((h, _is_frequent(shared.value, h), owner))
        ordered = h[order]
        needed = np.minimum(n, n - (num * n + den - 1) // den + MAX_LENGTHEN)
        place = np.arange(len(h)) - first[owner]
        prefix = (ordered[place < needed[owner]] >> np.uint64(64 - token_width)).astype(np.uint32 if token_width <= 32 else np.uint64)
        words = bitmap_words(n)
        at, ends = mix(h), np.cumsum(words * 64)
        bits = np.zeros(int(ends[-1]) if rows else 0, dtype=bool)
        bits[(ends - words * 64)[owner] + (at & (words[owner] * 64 - 1).astype(np.uint64)).astype(np.int64)] = True
        packed = np.packbits(bits).tobytes()
        sets = [packed[8 * (e - w) : 8 * e] for e, w in zip(np.cumsum(words), words, strict=True)]
        offsets = np.concatenate([[0], np.cumsum(needed)]).astype(np.int32)
        return {
            "id": batch.column(0), "n": pa.array(n.astype(np.int64)), "cls": pa.array(_classes(h, first, n)),
            "prefix": pa.ListArray.from_arrays(pa.array(offsets), pa.array(prefix.view(np.int32 if token_width <= 32 else np.int64))), "bits": pa.array(sets, pa.binary()),
        }

    kind = df.schema[id_col].dataType.simpleString()
    return map_text(df.select(df[id_col].alias("doc_id"), df[text_col].cast("string")), 1, sign, f"doc_id {kind}, n long, cls long, prefix array<{'int' if token == pa.int32() else 'long'}>, bits binary")


def _needed(n: Column, num: int, den: int) -> Column:
    return F.floor((num * n + den - 1) / den)


def postings(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(token, row, ell, df, thin) of the shingles in each class's chosen prefix that another class has in its longest one.

    ``classes`` has row, n and prefix. The cost of lengthening by l is what is read, the other holders of the prefix's
    shingles, and VERIFY_COST for each candidate, of which there are at most a l-th of that. A shingle's level is the
    least l whose prefix has it; row and level share a number, which keeps the one large shuffle small.
    """
    n = F.col("n")
    base = n - _needed(n, num, den)
    most = F.least(F.lit(MAX_LENGTHEN), _needed(n, num, den))
    each = classes.select("row", base.alias("base"), most.alias("most"), F.posexplode("prefix").alias("pos", "token"))
    level = F.greatest(F.lit(1), F.col("pos") - F.col("base") + 1)
    packed = each.filter(level <= F.col("most")).select("token", (F.col("row") * 8 + level).alias("held"))
    # counts are combined before the shuffle, and AQE splits the join, so a shingle that all hold is no single task
    several = packed.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = written(packed.join(several, "token"))
    shared = shared.select("token", F.floor(F.col("held") / 8).alias("row"), (F.col("held") % 8).alias("level"), "df")
    scans = [F.sum(F.when(F.col("level") <= ell, F.col("df") - 1).otherwise(0)).alias(f"s{ell}") for ell in range(1, MAX_LENGTHEN + 1)]
    sums = shared.groupBy("row").agg(*scans, F.count(F.lit(1)).alias("held")).join(classes.select("row", most.alias("most")), "row")
    costs = F.array_sort(F.filter(F.array(*[F.struct(F.when(F.col("most") >= ell, F.col(f"s{ell}") * (1 + VERIFY_COST / ell)).alias("cost"), F.lit(ell).alias("ell")) for ell in range(1, MAX_LENGTHEN + 1)]), lambda c: c["cost"].isNotNull()))
    thin = F.pow(F.lit(2), F.floor(F.log2(F.greatest(F.col("held") / THIN_TO, F.lit(1.0))))).cast("long")
    chosen = sums.select("row", costs[0]["ell"].alias("ell"), thin.alias("thin"))
    return shared.join(chosen, "row").filter("level <= ell").select("token", "row", "ell", "df", "thin")


def _widths(bits: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The words of each row's bitmap; for each width, each row's place in a table of the bitmaps at least as wide, folded."""
    bounds = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1]
    words, data = np.diff(bounds) // 8, np.frombuffer(bits.buffers()[2], np.uint8)
    tables, wider = {}, (np.zeros(0, np.int64), None)
    for w in sorted(set(words.tolist()), reverse=True):
        own = np.flatnonzero(words == w)
        table = data[bounds[own][:, None] + np.arange(8 * w)].view(np.uint64)
        if wider[1] is not None:
            table = np.concatenate([_folded(wider[1], w), table])
        rows = np.concatenate([wider[0], own])
        place = np.zeros(len(words), np.int32)
        place[rows] = np.arange(len(rows))
        tables[w], wider = (place, table), (rows, table)
    return words, tables


def _block_pairs(num: int, den: int, spanning: bool):
    """Candidates of each block of a shingle's holders: pairs of different components whose bitmaps allow enough in common.

    A block's rows come in order of their classes, its guests last. With ``spanning`` each row gets the likeliest of the
    rows before it, else each guest is compared with all rows that are no guests. Pairs are made and tested PAIRS_AT_ONCE.
    """

    def blocks(table, cuts):
        cls, comp, n, ell, guest, out = (table.column(i).to_numpy(zero_copy_only=False) for i in range(3, 9))
        words, tables = _widths(table.column(9))
        sizes = np.diff(cuts)
        first, at = np.repeat(cuts[:-1], sizes), np.arange(cuts[-1])
        if spanning:
            many = at - first
        else:
            hosts = np.add.reduceat((guest == 0).astype(np.int64), cuts[:-1])
            many = np.where(guest == 1, np.repeat(hosts, sizes), 0)
        ends = np.cumsum(many)
        start = 0
        while start < len(many):
            done = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS_AT_ONCE, side="right")))
            count = many[start:done]
            i = np.repeat(np.arange(start, done), count)
            j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[start:done], count)
            start = done
            ok = (comp[i] != comp[j]) & (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j]))
            if not spanning:  # two that are both guests elsewhere meet twice
                ok &= (out[j] == 0) | (cls[i] < cls[j])
            i, j = i[ok], j[ok]
            total, narrow = n[i] + n[j], np.minimum(words[i], words[j])
            apart = np.zeros(len(i), np.int64)
            for w, (place, bits) in tables.items():
                if (s := np.flatnonzero(narrow == w)).size:
                    apart[s] = np.bitwise_count(bits[place[i[s]]] ^ bits[place[j[s]]]).sum(1, dtype=np.int64)
            ok = apart <= total - 2 * -(-num * total // (num + den))
            i, j, apart = i[ok], j[ok], apart[ok]
            if spanning and len(i):
                runs = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                j = first[i[runs]] + (np.minimum.reduceat((apart << 32) | (j - first[i]), runs) & 0xFFFFFFFF)
                apart, i = np.minimum.reduceat(apart, runs), i[runs]
            if len(i):
                yield np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j]), np.minimum(ell[i], ell[j]), apart])

    def cut(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0] if held else batch
            key = np.stack([table.column(i).to_numpy() for i in range(3)], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            done = int(cuts[-1]) if len(cuts) else 0
            if done:
                yield from blocks(table.slice(0, done), np.concatenate([[0], cuts]).astype(int))
            held = [table.slice(done)]
        if held:
            yield from blocks(held[0], np.array([0, held[0].num_rows]))

    def run(batches):
        held, size = [], 0
        for found in cut(batches):
            held, size = [*held, found], size + found.shape[1]
            if size >= PAIRS_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(held, 1)], names=["a", "b", "ell", "apart"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(held, 1)], names=["a", "b", "ell", "apart"])

    return run


def candidates(posted: DataFrame, classes: DataFrame, num: int, den: int, spanning: bool, connected: bool) -> DataFrame:
    """(a, b) pairs of classes of different components to verify; ``classes`` has row, n, bits and comp.

    With ``connected`` (some classes share a component) shingles held within one are left out first. A shingle's holders
    are dealt to blocks of about BLOCK. With ``spanning``, a thinned share of the shingles is looked at, each block by
    itself (every shingle deals its holders anew, so blocks of different shingles overlap), and at most one pair for each
    class is returned: rounds that connect most of what is alike. The full round then proves what is left: of each
    shingle the holders outside its largest component are guests, in blocks of their own, and each block of guests meets
    each block of holders. So a task holds two blocks at a time however many hold a shingle, and a holder is copied once
    for each block of guests.
    """
    if spanning:
        posted = posted.filter("token % thin = 0")
    if connected:
        held = posted.join(classes.select("row", "comp"), "row")
        ends = held.groupBy("token").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).filter("c < d").select("token")
        posted = held.drop("comp").join(ends, "token", "left_semi") if spanning else held.join(ends, "token", "left_semi")
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    deal = lambda c: F.pmod(F.xxhash64("row", "token"), parts(c)).cast("int")
    if spanning:
        rows = posted.join(classes.select("row", "n", "bits", "comp"), "row").select("*", deal("df").alias("own"), F.lit(0).alias("met"), F.lit(0).alias("guest"), F.lit(0).alias("out"))
    else:
        posted = written(posted if connected else posted.join(classes.select("row", "comp"), "row"))
        main = posted.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), (F.sum("k") - F.max("k")).alias("outs"))
        rows = posted.join(main, "token").withColumn("out", (F.col("comp") != F.col("main")).cast("int")).join(classes.select("row", "n", "bits"), "row")
        host = F.transform(F.sequence(F.lit(0), parts("outs") - 1), lambda g: F.struct(deal("df").alias("own"), g.alias("met"), F.lit(0).alias("guest")))
        guest = F.transform(F.sequence(F.lit(0), parts("df") - 1), lambda b: F.struct(b.alias("own"), deal("outs").alias("met"), F.lit(1).alias("guest")))
        rows = rows.withColumn("deal", F.explode(F.when(F.col("out") == 1, F.concat(host, guest)).otherwise(host))).select("*", "deal.*")
    rows = rows.select(F.col("token").cast("long").alias("token"), *[F.col(c).cast("long").alias(c) for c in ("own", "met")], "row", "comp", "n", *[F.col(c).cast("long").alias(c) for c in ("ell", "guest", "out")], "bits")
    placed = rows.repartition("token", "own", "met").sortWithinPartitions("token", "own", "met", "guest", "row")
    pairs = placed.mapInArrow(_block_pairs(num, den, spanning), "a long, b long, ell long, apart long")
    if spanning:  # the likeliest partner of each class
        best = F.min_by("a", F.struct("apart", -F.col("shared"), "a"))
        return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("apart").alias("apart")).groupBy("b").agg(best.alias("a")).select("a", "b")
    # every shared prefix shingle of a pair comes once: as many as the shorter lengthening asks for must be shared
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("ell").alias("ell")).filter("shared >= ell").select("a", "b")


def linked(pairs: DataFrame, docs: DataFrame, found: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold, counted exactly; texts of the pairs' classes are read again.

    The sets of b meet the pairs where they are made and move once, to the sets of a. The set of an a with many partners
    is copied for every HUB of them, so they are spread over as many tasks.
    """
    ends = pairs.select("a").union(pairs.select("b")).distinct().toDF("row")
    held = written(found.join(ends, "row", "left_semi").select("row", "cls", F.col("doc_id").alias("__id")))
    few = BROADCAST_ROW * max(held.count(), pairs.count()) <= BROADCAST_BYTES
    small = F.broadcast if few else (lambda d: d)  # beyond that Spark shuffles
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("salts")).filter("salts > 1")
    pairs = written(pairs.join(hubs, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")))
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def sets(batch: pa.RecordBatch) -> dict:
        owner, h = shingles(batch.column(1).to_pylist(), k)
        n = np.bincount(owner, minlength=batch.num_rows)
        first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        offsets = np.concatenate([first, [len(h)]]).astype(np.int32)
        return {"id": batch.column(0), "cls": pa.array(_classes(h, first, n)), "members": pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))}

    def members(side: str) -> DataFrame:
        """(side, members) of the classes on one side of a pair; rows that repeat an id and a text come as often."""
        wanted = held.join(pairs.select(F.col(side).alias("row")).distinct(), "row", "left_semi")
        some = texts.join(small(wanted.select("__id").distinct()), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
        got = map_text(some, 1, sets, f"doc_id {kind}, cls long, members array<long>")
        return got.join(small(wanted), (got["cls"] == wanted["cls"]) & got["doc_id"].eqNullSafe(wanted["__id"])).select(F.col("row").alias(side), "members")

    moved = members("b").join(small(pairs), "b").select("a", "b", "salt", F.col("members").alias("mb"))
    salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    copies = members("a").join(small(hubs), "a", "left").select("a", F.explode(salts).alias("salt"), F.col("members").alias("ma"))
    both = moved.join(copies, ["a", "salt"])
    common = F.size(F.array_intersect("ma", "mb")).cast("long")
    return both.withColumn("common", common).filter(den * F.col("common") >= num * (F.size("ma") + F.size("mb") - F.col("common"))).select("a", "b").distinct()


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_shingles, class_id, component_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lowering A-Z; a set is the distinct k-word shingles of the whole text, its
    whole sequence if it has fewer words, and empty without words or text. Rows link when den * common >= num * union.
    component_id is the smallest doc_id reachable by links, itself included; class_id the smallest with the same set. A
    row with an empty set has its own id as both. A null id is passed over by the minima, so a row without one has the
    least id of its component, or null if there is none. Rows with equal ids and texts get equal rows. Shingles and sets
    are compared by 64-bit hashes. Only id and text are read, so other columns cannot clash. An empty table: no rows.
    """
    width = token_bits(docs, text_col, num, den)
    made = signatures(docs, id_col, text_col, k, num, den, frequent_shingles(docs, id_col, text_col, k), width)
    found = written(made.withColumn("row", F.monotonically_increasing_id()))
    sets = found.filter("n > 0")
    # one row stands for each class
    reps = written(sets.groupBy("cls").agg(F.min("row").alias("row"), F.min("doc_id").alias("class_id")))
    only = reps.select("row")
    classes = sets.join(F.broadcast(only) if BROADCAST_ROW * reps.count() <= BROADCAST_BYTES else only, "row", "left_semi")
    posted = written(postings(classes, num, den))
    held = written(classes.select("row", "n", "bits").join(posted.select("row").distinct(), "row", "left_semi"))

    joined, comps, spanning, connected = held.withColumn("comp", F.col("row")), None, SPANNING_ROUNDS, False
    while True:
        pairs = written(candidates(posted, joined, num, den, spanning > 0, connected))
        n = pairs.count()
        if n or comps is None:
            links = written(linked(pairs, docs, found, id_col, text_col, k, num, den))
            edges = links if comps is None else comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)
            old, comps = comps, written(connected_components(edges, "a", "b"))
            discard(old)
        if not spanning:
            break
        if n:
            discard(joined)
            joined = written(held.join(comps, held["row"] == comps["node"], "left").select("row", "n", "bits", F.coalesce("component", "row").alias("comp")))
        # a round of which less than half links leaves the rest to the full one
        spanning, connected = (spanning - 1 if n and 2 * links.count() >= n else 0), True
        discard(pairs, links)

    placed = reps.join(comps, reps["row"] == comps["node"], "left").select("cls", "class_id", F.coalesce("component", "row").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    placed = placed.join(least, "comp").select("cls", "class_id", "component_id")
    rows = found.filter("n > 0").select("doc_id", "n", "cls").join(placed, "cls").select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")
    return rows.unionByName(found.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id")))


def drop_near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, without those linked to a document of a smaller id, directly or through others.

    Rows that repeat an id and a text count once. Texts without words are equal to nothing and stay, as do rows without
    an id.
    """
    found = written(jaccard_components(docs, k, num, den, id_col, text_col))
    kept = without_ids(docs, found.filter("doc_id <> component_id").select("doc_id"), id_col)
    again = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__id"))
    if not again.isEmpty():
        again = written(again)
        repeated = kept.join(again, kept[id_col] == again["__id"], "left_semi").dropDuplicates([id_col, text_col])
        kept = without_ids(kept, again, id_col).unionByName(repeated)
    return kept


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id", "class_id")
