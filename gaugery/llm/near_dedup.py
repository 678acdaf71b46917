"""MinHash near-deduplication with sequential Bayesian verification.

1. Sketch: each row's distinct shingles of whole words give a signature of bands x rows hash minima, in Python on
   Arrow batches. Rows with the same word sequence form a class; one of them, by row number, stands for it from here on.
   Ids come back at the end: classes that an id has in common are linked.
2. Candidates: representatives that share a band. A band's bucket is never expanded into pairs. Its pivot, the member
   with the most company over all bands, is compared with every other member: as many candidates as members.
3. Verification: signatures are compared batch by batch. After each batch a pair is dropped if the posterior chance of a
   similarity at the threshold or above, given the matches so far under a uniform prior, is below `miss`. Survivors are
   confirmed on their full shingle sets, read again from the texts.
4. Components of the confirmed links. A bucket whose members now share one component is settled: a further link inside
   it could change nothing.
5. Open buckets are finished exactly. A bucket's members are parted by size, as sets whose sizes are further apart than
   the threshold can't be linked: members meet those of their own size class and of the next. In such a part the members
   of the largest component needn't meet each other; the rest meet them and one another, in blocks of about BLOCK members
   and a bounded number of shingles. So one outlier in a bucket of n costs n rows. In a block, members of different
   components are compared by signature, those with a surviving partner get their texts, and all their intersections are
   counted at once by products of 0/1 matrices. What a block sends on is links that join its components, fewer than its
   members; so no link between components is lost, but for banding (3e-6 at the threshold) and `miss`.

Defined cases: a null text or one without words has no shingles, is linked with nothing and is its own component; with
fewer words than a shingle has, the whole sequence is the only shingle. Rows with a null id are linked with nothing,
have a null component and are kept. Rows that repeat an id count as one document with the links of all of them, each
row being compared by its own text. Texts are read again by id and a 64-bit hash, so that rows of one id are told apart.
Other columns are carried as they are; names starting with `__g_` are reserved. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugery.llm.common import flagged, join_groups, materialise
from gaugery.llm.components import components
from gaugery.ship import ship, tidy

SHINGLE = 5
PERCENT = 80
BANDS = 24
ROWS = 4
MISS = 1e-7
BATCH = 16
BLOCK = 512
#: Shingles that the texts of a block have, about.
BLOCK_SHINGLES = 4_000_000
PIVOT_BLOCK = 256
MASK = (1 << 64) - 1


def word_list(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; bytes.split() parts at the space and U+0009 to U+000D only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, k: int) -> set:
    w = word_list(text)
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def shingle_hashes(w: list[bytes], k: int) -> np.ndarray:
    """Distinct 64-bit fingerprints of the shingles."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    if len(w) < k:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), 1)], np.uint64)
    n = len(w) - k + 1
    x = np.zeros(n, np.uint64)
    for i in range(k):
        x = (x ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return np.unique(x)


@lru_cache(4)
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240601)
    return r.integers(0, MASK, n, np.uint64) | np.uint64(1), r.integers(0, MASK, n, np.uint64)


def signature(hashes: np.ndarray, n: int) -> np.ndarray:
    a, b = _multipliers(n)
    least = np.full(n, MASK, np.uint64)
    for i in range(0, len(hashes), 512):
        np.minimum(least, (hashes[i : i + 512, None] * a + b).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _sketcher(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            counts, sequences, signatures, keys = [], [], [], []
            for text in batch.column(2).to_pylist():
                w = word_list(text)
                if not w:
                    counts.append(0)
                    sequences.append(None)
                    signatures.append(None)
                    keys.append(None)
                    continue
                hashes = shingle_hashes(w, k)
                s = signature(hashes, bands * rows)
                x = salts.copy()
                for column in s.reshape(bands, rows).T.astype(np.uint64):
                    x = (x ^ column) * np.uint64(0x9E3779B97F4A7C15)
                    x ^= x >> np.uint64(31)
                counts.append(len(hashes))
                sequences.append(xxhash.xxh3_128_digest(b" ".join(w)))
                signatures.append(s.tobytes())
                keys.append(x.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(sequences, pa.binary()), pa.array(signatures, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "hash", "n_shingles", "sequence", "sig", "keys"],
            )

    return run


@lru_cache(8)
def fewest_matches(total: int, batch: int, percent: int, miss: float) -> tuple[int, ...]:
    """After each batch, the fewest matches m of n hashes with which P(similarity >= threshold | m of n) is at least miss.

    Under a uniform prior the posterior is Beta(m+1, n-m+1), whose upper tail at t is P(Binomial(n+1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(batch, total + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def survives(x: np.ndarray, y: np.ndarray, least: tuple[int, ...], batch: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y that no batch rules out, and their matches in all."""
    alive, seen = np.arange(len(x)), np.zeros(len(x), np.int64)
    for i, m in enumerate(least):
        cut = slice(i * batch, (i + 1) * batch)
        seen[alive] += (x[alive, cut] == y[alive, cut]).sum(axis=1)
        alive = alive[seen[alive] >= m]
        if not len(alive):
            break
    return alive, seen


def _signatures(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, n)


def _pruner(n: int, percent: int, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = fewest_matches(n, BATCH, percent, miss)
        for batch in batches:
            if batch.num_rows:
                alive, _ = survives(_signatures(batch.column(2), n), _signatures(batch.column(3), n), least, BATCH)
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(alive)) for i in (0, 1)], names=["node", "pivot"])

    return run


def _confirmer(k: int, percent: int):
    """Rows sorted by pivot and block, the pivot's text first: (pivot, block, node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: set = set()
        for batch in batches:
            nodes, pivots = [], []
            for pivot, _block, other, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if other is None:
                    own = shingle_set(text, k)
                    continue
                theirs = shingle_set(text, k)
                both = len(own & theirs)
                if 100 * both >= percent * (len(own) + len(theirs) - both) and both:
                    nodes.append(other)
                    pivots.append(pivot)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(pivots, pa.int64())], names=["node", "pivot"])

    return run


def _with_texts(rows: DataFrame, node: str, where: DataFrame, texts: DataFrame) -> DataFrame:
    """rows with the text of `node`. where: node, id and hash; texts: id, hash and text, read once more.

    Rows of texts that repeat id and hash count once, where they meet for the join anyway.
    """
    known = materialise(rows.join(where.withColumnRenamed("node", node), node), "near-known")
    found = flagged(texts, F.col("hash"), known.select("hash")).groupBy("id", "hash").agg(F.first("text").alias("text"))
    return known.join(found, ["id", "hash"]).drop("id", "hash")


def confirm(pairs: DataFrame, where: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (node, pivot) whose full shingle sets reach the threshold.

    A pivot of many pairs is dealt out in blocks, each with its own copy of the pivot's text.
    """
    counted = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    blocks = lambda n: F.ceil(n / PIVOT_BLOCK).cast("bigint")
    dealt = join_groups(pairs, counted, ["pivot"], "n", F.col("node")).select("pivot", F.pmod(F.xxhash64("node", F.lit(7)), blocks(F.col("n"))).alias("block"), "node")
    heads = counted.select("pivot", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks(F.col("n")) - 1)).alias("block"), F.lit(None).cast("bigint").alias("node"))
    asked = materialise(dealt.unionAll(heads).withColumn("of", F.coalesce("node", "pivot")), "near-asked")
    rows = _with_texts(asked, "of", where, texts).select("pivot", "block", "node", "text")
    return rows.repartition("pivot", "block").sortWithinPartitions("pivot", "block", F.col("node").asc_nulls_first()).mapInArrow(tidy(_confirmer(k, percent)), "node long, pivot long")


#: What rows of a run begin with: bucket, size class, kind, blocks; which side of two, whether of the class below, size of the
#: set, node, component.
RUN = "key long, g int, kind int, x int, y int, side int, guest boolean, size long, node long, comp long"
_RUN_NAMES = [x.split()[0] for x in RUN.split(", ")]
_RUN_TYPES = (pa.int64(), *[pa.int32()] * 5, pa.bool_(), *[pa.int64()] * 3)
CROSS, REST = 0, 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (RUN, ...) sorted by their first five: those of each run, one block or a pair of blocks of a part of a bucket."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != row[:5]:
                if len(rows) > 1:
                    yield rows
                at, rows = row[:5], []
            rows.append(row)
    if len(rows) > 1:
        yield rows


def _apart(rows: list[tuple], percent: int) -> np.ndarray:
    """Which pairs of a run are to be compared: of different components, of sizes that allow the threshold, not both from the
    class below, as those meet there, and of different sides if the run has two."""
    side, guest, size, comps = (np.array([r[j] for r in rows]) for j in (5, 6, 7, 9))
    allowed = (percent * size)[:, None] <= 100 * size
    apart = (comps[:, None] != comps) & ~(guest[:, None] & guest) & allowed & allowed.T
    _, _, kind, x, y, *_ = rows[0]
    return apart & (side[:, None] != side) if kind == CROSS or x != y else apart


def _hopeful(n: int, percent: int, miss: float):
    """Of rows (RUN, sig), those with a partner that no batch rules out; without the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = fewest_matches(n, BATCH, percent, miss)
        for rows in _runs(batches):
            sigs, apart = np.frombuffer(b"".join(r[10] for r in rows), np.uint32).reshape(-1, n), _apart(rows, percent)
            hope = np.zeros(len(rows), bool)
            for i in range(len(rows)):
                other = np.flatnonzero(apart[i, i + 1 :]) + i + 1
                if len(other):
                    alive, _ = survives(np.broadcast_to(sigs[i], (len(other), n)), sigs[other], least, BATCH)
                    hope[other[alive]] = True
                    hope[i] |= len(alive) > 0
            if hope.any():
                columns = zip(*[r[:10] for r, h in zip(rows, hope, strict=True) if h], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RUN_TYPES, strict=True)], names=_RUN_NAMES)

    return run


def shared(sets: list[np.ndarray], cells: int = 4_000_000) -> np.ndarray:
    """Sizes of the intersections of all pairs, by products of 0/1 matrices over the elements that two sets or more have."""
    _, element, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    use = often[element] > 1
    number = np.cumsum(often > 1) - 1
    element, own, total = number[element[use]], own[use], int((often > 1).sum())
    order = np.argsort(element, kind="stable")
    element, own = element[order], own[order]
    both, width = np.zeros((len(sets), len(sets)), np.float64), max(1, cells // len(sets))
    for low in range(0, total, width):
        a, b = np.searchsorted(element, (low, low + width))
        m = np.zeros((len(sets), min(width, total - low)), np.float32)
        m[own[a:b], element[a:b] - low] = 1
        both += m @ m.T
    return both


def _finisher(k: int, percent: int):
    """Of rows (RUN, text), links that join all components of a run that any link would join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            words_of = [word_list(r[10]) for r in rows]
            sets = [shingle_hashes(w, k) for w in words_of]
            size, both = np.array([len(x) for x in sets], np.float64), shared(sets)
            close = (100 * both >= percent * (size[:, None] + size - both)) & _apart(rows, percent)
            label, links = np.array([r[9] for r in rows]), []
            while close.any():
                i, j = divmod(int(close.argmax()), len(rows))
                x, y = shingle_set(rows[i][10], k), shingle_set(rows[j][10], k)
                if 100 * len(x & y) >= percent * len(x | y):
                    links.append((rows[i][8], rows[j][8]))
                    label[label == label[j]] = label[i]
                    close &= label[:, None] != label
                else:
                    close[i, j] = close[j, i] = False
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in links], pa.int64()) for j in (0, 1)], names=["node", "pivot"])

    return run


def _labelled(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """rows with comp: the component of node, or node itself where no link has it."""
    return rows.join(comps.withColumnRenamed("component", "__g_comp"), "node", "left").withColumn("comp", F.coalesce("__g_comp", "node")).drop("__g_comp")


def _parted(crowd: DataFrame, comps: DataFrame, percent: int, block: int) -> DataFrame:
    """The members (node, size, key, comp) of buckets with two components or more, by part of the bucket and block.

    g, guest: size class of the part, and whether the member is of the class below; lead: of the part's largest component;
    own: the member's block, of `bigs` blocks of that component or `rests` blocks of all others.
    """
    placed = _labelled(crowd, comps)
    several = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("n").alias("open_n")).filter("lo != hi").select("key", "open_n")
    opened = join_groups(placed.select("node", "size", "key", "comp"), several, ["key"], "open_n", F.col("node")).filter("open_n is not null")
    # Sizes of two sets that reach the threshold are of one class or of neighbours.
    g = F.floor(F.log(F.col("size").cast("double")) / log(100 / percent * (1 + 1e-9))).cast("int") if percent < 100 else F.lit(0)
    opened = opened.withColumn("g", g)
    classes = F.explode(F.array(F.struct("g", F.lit(False).alias("guest")), F.struct((F.col("g") + 1).alias("g"), F.lit(True).alias("guest"))))
    parts = materialise(opened.select("node", "size", "key", "comp", classes.alias("c")).select("node", "size", "key", "comp", "c.g", "c.guest"), "near-parts")
    by = parts.groupBy("key", "g", "comp").agg(F.count(F.lit(1)).alias("m"), F.min("guest").alias("guests"))
    tops = by.groupBy("key", "g").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("part_n"), F.count(F.lit(1)).alias("n_comps"), F.min("guests").alias("guests"))
    tops = tops.filter("n_comps > 1 and not guests").select("key", "g", F.col("top.comp").alias("big"), F.col("top.m").alias("big_n"), "part_n", "n_comps")
    dealt = join_groups(parts, tops, ["key", "g"], "part_n", F.col("node")).filter("big is not null")
    most = F.greatest(F.lit(1.0), F.least(F.lit(float(block)), F.lit(float(BLOCK_SHINGLES)) / F.pow(F.lit(100 / percent), "g")))
    count = lambda n: F.ceil(n / most).cast("int")
    dealt = dealt.withColumns({"lead": F.col("comp") == F.col("big"), "bigs": count(F.col("big_n")), "rests": count(F.col("part_n") - F.col("big_n"))})
    own = F.pmod(F.xxhash64("node", F.lit(11)), F.when(F.col("lead"), F.col("bigs")).otherwise(F.col("rests"))).cast("int")
    return dealt.select("node", "size", "key", "g", "guest", "comp", "lead", "bigs", "rests", "n_comps", own.alias("own"))


def _sent(parted: DataFrame) -> DataFrame:
    """The members of each run: RUN."""
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    one = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), side.alias("side"))
    own = F.col("own")
    across = F.when(F.col("lead"), F.transform(upto(F.col("rests")), lambda j: one(CROSS, own, j, F.lit(0)))).otherwise(F.transform(upto(F.col("bigs")), lambda i: one(CROSS, i, own, F.lit(1))))
    among = F.transform(upto(F.col("rests")), lambda j: one(REST, F.least(own, j), F.greatest(own, j), F.when(own == j, 0).when(own < j, 1).otherwise(2)))
    # The rest meet one another only if they are of two components or more.
    runs = F.when(F.col("lead") | (F.col("n_comps") == 2), across).otherwise(F.concat(across, among))
    return parted.withColumn("r", F.explode(runs)).select("key", "g", "r.kind", "r.x", "r.y", "r.side", "guest", "size", "node", "comp")


def link(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, miss: float = MISS, block: int = BLOCK
) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the least id reachable, itself included), kept."""
    ship(docs.sparkSession)
    size = bands * rows
    whole = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.col(text_col)).alias("hash"), F.col(text_col).alias("text"))
    sketch = whole.mapInArrow(tidy(_sketcher(shingle, bands, rows)), "id long, hash long, n_shingles long, sequence binary, sig binary, keys array<long>")
    sketch = materialise(sketch.withColumn("row", F.monotonically_increasing_id()), "near-sketch")
    full = sketch.filter("id is not null and n_shingles > 0")
    classes = full.groupBy("sequence").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n"))
    member = join_groups(full.select("id", "row", "sequence"), classes.filter("n > 1"), ["sequence"], "n", F.col("row"))
    member = materialise(member.select("id", "row", F.coalesce("node", "row").alias("node")), "near-class")
    where = full.select(F.col("row").alias("node"), "id", "hash")
    alone = full.select("row", F.col("n_shingles").alias("size"), "keys").join(member.filter("row = node").select("row"), "row", "left_semi")
    keyed = alone.select(F.col("row").alias("node"), "size", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowd = materialise(join_groups(keyed, buckets, ["key"], "n", F.col("node")).filter("n is not null").select("node", "size", "key", "n"), "near-crowd")
    weights = crowd.groupBy("node").agg(F.sum("n").alias("w"))
    weighed = crowd.join(weights, "node")
    pivots = weighed.groupBy("key").agg(F.max(F.struct("w", (-F.col("node")).alias("least"))).alias("top"), F.max("n").alias("n")).select("key", (-F.col("top.least")).alias("pivot"), "n")
    stars = join_groups(crowd.select("node", "key"), pivots, ["key"], "n", F.col("node")).filter("node != pivot").select("node", "pivot").distinct()
    sigs = materialise(flagged(full.select(F.col("row").alias("node"), "sig"), F.col("node"), crowd.select("node")), "near-sigs")

    def pruned(pairs: DataFrame) -> DataFrame:
        per = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
        heads = per.join(sigs.withColumnsRenamed({"node": "pivot", "sig": "pivot_sig"}), "pivot")
        both = join_groups(pairs.join(sigs, "node"), heads, ["pivot"], "n", F.col("node")).filter("pivot_sig is not null")
        return both.select("node", "pivot", "sig", "pivot_sig").mapInArrow(tidy(_pruner(size, percent, miss)), "node long, pivot long")

    candidates = materialise(pruned(materialise(stars, "near-stars")), "near-pruned")
    links = confirm(candidates, where, whole, shingle, percent)
    # Classes that have an id in common are one document.
    shared_ids = member.groupBy("id").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo != hi").select("id", "lo", "n")
    same = join_groups(member.select("id", "node"), shared_ids, ["id"], "n", F.col("node")).filter("lo is not null and node != lo").select("node", F.col("lo").alias("pivot"))
    links = materialise(links.unionByName(same), "near-links")
    comps = materialise(components(links, "node", "pivot"), "near-comps")

    parted = materialise(_parted(crowd, comps, percent, block), "near-open")
    if not parted.isEmpty():
        run_cols = _RUN_NAMES[:5]
        runs = _sent(parted).join(sigs, "node").select(*_RUN_NAMES, "sig")
        hopeful = materialise(runs.repartition(*run_cols).sortWithinPartitions(*run_cols).mapInArrow(tidy(_hopeful(size, percent, miss)), RUN), "near-hopeful")
        told = _with_texts(hopeful, "node", where, whole).select(*_RUN_NAMES, "text")
        found = told.repartition(*run_cols).sortWithinPartitions(*run_cols).mapInArrow(tidy(_finisher(shingle, percent)), "node long, pivot long")
        found = materialise(found, "near-links")
        if not found.isEmpty():
            comps = materialise(components(links.unionByName(found), "node", "pivot"), "near-comps")

    placed = materialise(_labelled(member.select("id", "node"), comps).select("id", "comp"), "near-placed")
    least = placed.groupBy("comp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    final = join_groups(placed, least, ["comp"], "n", F.col("id")).groupBy("id").agg(F.min(F.coalesce("low", "id")).alias("component"), F.count(F.lit(1)).alias("n"))
    out = join_groups(sketch.select("id", "n_shingles", "row"), final, ["id"], "n", F.col("row"))
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose id is the least of its component, all columns as they were."""
    dropped = materialise(link(docs, id_col, text_col, **options).filter(~F.col("kept")).select(F.col(id_col).alias("__g_drop")).distinct(), "near-dropped")
    return docs.join(dropped, docs[id_col] == dropped["__g_drop"], "left_anti")
