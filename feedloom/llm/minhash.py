"""Near-duplicate documents by b-bit MinHash.

Every document's set of distinct word shingles gives 256 minima. Band keys over runs of six minima find candidates; of each
minimum only the two low bits are kept, packed into bit planes, and the similarity of a candidate pair is estimated from the
number of equal bits, corrected for chance collisions. Pairs whose estimate is near the threshold or above are confirmed on
the full shingle sets.

Groups of copies are never expanded into pairs. Documents with equal sets are one class with one representative. Every
document is first compared with one centre of its buckets only; components of these links are found, and then only members of
one bucket that are still in different components are compared with each other, in blocks, by size and by the estimate from a
longer signature. So a bucket of thousands of copies costs one comparison per member, and no link between different texts
of one bucket is lost. A pair at similarity 0.8 shares no bucket with probability (1 - 0.8^6)^42, about 3 in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.bloom import maybe_in, might_be
from feedloom.llm.common import fresh, picked, pieces, store, text_buffer
from feedloom.llm.components import components
from feedloom.llm.hashing import lower_ascii, mix, windows, words

MINIMA, BITS, ROWS = 256, 2, 6
BANDS = MINIMA // ROWS
#: Minima of the longer signature that near misses get, and its margin of 4.5 standard errors.
LONG, LONG_MARGIN = 2048, 0.048
#: 4.5 standard errors of the estimate at similarity 0.8 (0.03 each): pairs whose estimate is lower by more are not confirmed.
MARGIN = 0.135
_RNG = np.random.default_rng(20240229)
_SCALE = _RNG.integers(0, 1 << 31, LONG, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _RNG.integers(0, 1 << 32, LONG, dtype=np.uint32)
_BAND = _RNG.integers(1, 1 << 62, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SCHEMA = "doc_id long, content long, n long, k1 long, k2 long, planes array<long>, bands array<long>"


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: runs of ``width`` words, or all words of a shorter text as one."""
    data, offsets = text_buffer(column)
    found = words(lower_ascii(data), offsets)
    grams, out = windows(found.hash, width), []
    for a, b in zip(found.first[:-1], found.first[1:]):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        else:
            out.append(windows(found.hash[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def minima(shingles: np.ndarray, count: int = MINIMA) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best, scale, shift = np.full(count, np.uint32(0xFFFFFFFF)), _SCALE[:count], _SHIFT[:count]
    step = max(1, (1 << 18) // count)
    for at in range(0, len(x), step):
        np.minimum(best, (x[at : at + step, None] * scale + shift).min(axis=0), out=best)
    return best


def bit_planes(best: np.ndarray) -> np.ndarray:
    """The low bits of the minima, packed: all lowest bits, then all second ones."""
    return np.concatenate([np.packbits(((best >> np.uint32(bit)) & np.uint32(1)).astype(np.uint8)).view(np.int64) for bit in range(BITS)])


def signature(best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes and band keys."""
    planes = bit_planes(best)
    rows = best[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    return planes, mix((mix(rows) * _BAND).sum(axis=1, dtype=np.uint64)).view(np.int64)


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            for part in pieces(batch):
                rows = []
                for shingles in shingle_sets(part.column("text"), width):
                    if not len(shingles):
                        rows.append((0, None, None, None, None))
                        continue
                    key = int(mix(shingles).sum(dtype=np.uint64).view(np.int64)), int(mix(shingles ^ _BAND[0, 0]).sum(dtype=np.uint64).view(np.int64))
                    made = known.get(key)
                    if made is None:
                        if len(known) >= 1000:  # only spares work on copies that lie together
                            known.clear()
                        made = known[key] = signature(minima(shingles))
                    rows.append((len(shingles), *key, *made))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("content"), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.list_(pa.int64())) for c in columns[3:])],
                    ["doc_id", "content", "n", "k1", "k2", "planes", "bands"],
                )

    return run


def _sets(width: int, long: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(part.column("text"), width)
                planes = [bit_planes(minima(s, LONG)) if long else None for s in sets]
                lists = [pa.array(c, pa.list_(pa.int64())) for c in ([s.view(np.int64) for s in sets], planes)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], ["doc_id", "shingles", "planes"])

    return run


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures: equal minima by bit counts, less the 1 in 2^b that agree by chance."""
    words_, differ = MINIMA // 64, F.lit(0)
    for i in range(words_):
        bits = None
        for bit in range(BITS):
            x = a[bit * words_ + i].bitwiseXOR(b[bit * words_ + i])
            bits = x if bits is None else bits.bitwiseOR(x)
        differ = differ + F.bit_count(bits)
    chance = 1.0 / (1 << BITS)
    return ((1 - differ / float(MINIMA)) - chance) / (1 - chance)


def _sets_of(wanted: DataFrame, documents: DataFrame, width: int, long: bool = False) -> DataFrame:
    """Full sets of the documents of a table of ids, and if asked for their longer signatures."""
    found = maybe_in(documents, "doc_id", wanted).join(wanted, "doc_id", "left_semi")
    return store(found.mapInArrow(_sets(width, long), "doc_id long, shingles array<long>, planes array<long>"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidates (a, b), the pairs whose full sets are similar enough."""
    both = (
        pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("s_a")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("s_b")), "b")
        .withColumn("shared", F.size(F.array_intersect("s_a", "s_b")).cast("long"))
    )
    union = F.size("s_a") + F.size("s_b") - F.col("shared")
    return both.where(100 * F.col("shared") >= percent * union).select("a", "b").distinct()


#: Members of a bucket that are compared at a time; larger buckets are dealt into blocks of about this size.
BLOCK = 2048
_MEETING = ("bucket", "low", "high")


def _similar(planes: np.ndarray, a: np.ndarray, b: np.ndarray, count: int, least: float) -> np.ndarray:
    """Which of the signature pairs (places a and b) have an estimate of at least ``least`` by their first minima."""
    half, words_, chance = planes.shape[1] // BITS, count // 64, 1.0 / (1 << BITS)
    differ = np.zeros((len(a), words_), np.uint64)
    for bit in range(BITS):
        part = planes[:, bit * half : bit * half + words_]
        differ |= part[a] ^ part[b]
    equal = 1 - np.bitwise_count(differ).sum(axis=1) / count
    return (equal - chance) / (1 - chance) >= least


def _compare(percent: int):
    """Candidates (a, b) among rows sorted by (bucket, low, high): members of block low against those of block high.

    A pair that shares several buckets is a candidate of the first only.
    """

    def candidates(ids, components_, sizes, blocks, planes, bands, bucket, low, high) -> Iterator[pa.RecordBatch]:
        order = np.argsort(sizes, kind="stable")
        ids, components_, sizes, blocks, planes, bands = (x[order] for x in (ids, components_, sizes, blocks, planes, bands))
        # Sorted by size, a partner of the same or larger size lies in one run.
        ends = np.searchsorted(sizes, sizes * 100 // percent, side="right")
        for at in range(0, len(ids), 64):
            counts = ends[at : at + 64] - np.arange(at, min(at + 64, len(ids))) - 1
            a = np.repeat(np.arange(at, at + len(counts)), counts)
            b = np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts) + a + 1
            meet = (components_[a] != components_[b]) & ((low == high) | (blocks[a] != blocks[b]))
            a, b = a[meet], b[meet]
            for count, margin in ((MINIMA, MARGIN), (LONG, LONG_MARGIN)):  # the longer estimate only for what passes the shorter
                near = _similar(planes, a, b, count, percent / 100.0 - margin)
                a, b = a[near], b[near]
            common = bands[a] == bands[b]
            here = bands[a, common.argmax(axis=1)] == bucket
            a, b = a[here], b[here]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def meeting() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            numbers = [np.asarray(rows[c]) for c in ("rep", "component", "n", "block")]
            planes, bands = (np.asarray(rows[c].combine_chunks().flatten()).reshape(len(rows), -1) for c in ("planes", "bands"))
            yield from candidates(*numbers, planes.view(np.uint64), bands, *key)

        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in _MEETING], axis=1)
            starts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for a, b in zip([0, *starts], [*starts, len(keys)]):
                if a == b:
                    continue
                if key is not None and tuple(keys[a]) != key:
                    yield from meeting()
                    held = []
                key = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from meeting()

    return run


def _across(rest: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of one bucket and different components, from (bucket, rep, component, n, planes, bands).

    A bucket of any size is dealt into blocks by a hash of the member; every pair of blocks is a task's work of its own.
    """
    blocks = rest.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = rest.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = dealt.withColumn("other", other).select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "component", "n", "planes", "bands")
    return met.repartition(*_MEETING).sortWithinPartitions(*_MEETING).mapInArrow(_compare(percent), "a long, b long").distinct()


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Texts are compared after lower-casing A-Z; words are runs outside space and \\x09-\\x0D. Texts link when their shingle
    sets share at least ``percent`` hundredths of their union. component_id is the smallest id reachable over links, kept
    marks that row. Null and word-less texts have no shingles and stand alone. Rows that repeat an id with the same set are
    one document; of rows that repeat an id with other texts, each links with what is like any of them. A row without an id
    takes the component of an equal set; if none has an id, component_id is null and the row is kept. Other columns are not
    looked at. An empty table gives no rows.
    """
    return _judged(documents, width, percent, id_column, text_column).drop("content")


def _judged(documents: DataFrame, width: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """Rows as ``near_duplicates`` gives them, with a hash of the text, which tells rows of one id apart."""
    docs = picked(documents, doc_id=id_column, text=text_column)
    signed = store(docs.withColumn("content", F.xxhash64("text")).mapInArrow(_sign(width), _SCHEMA), "signatures")
    classes = store(
        signed.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.min("planes").alias("planes"), F.min("bands").alias("bands")).where("rep IS NOT NULL"),
        "classes",
    )
    node = classes.select("rep", "n", "planes")

    def fits() -> Column:
        sizes = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
        return sizes & (estimate(F.col("x.planes"), F.col("y.planes")) >= percent / 100.0 - MARGIN)

    members = classes.select("rep", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    placed = store(members.join(sizes, "bucket"), "buckets")  # only buckets of two and more

    # The centre of a bucket is its member that meets most others over all buckets: the text the others were copied from,
    # if it is there. Each document is compared with the one centre that it shares most bands with.
    met = placed.groupBy("rep").agg(F.sum("size").alias("met"))
    centres = placed.join(met, "rep").groupBy("bucket").agg(F.max_by("rep", F.struct("met", -F.col("rep"))).alias("a"))
    star = placed.join(centres, "bucket").where("rep <> a").groupBy("rep", "a").count().groupBy("rep").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a"))
    pairs = (
        star.select(F.col("rep").alias("b"), "a").join(node.alias("x"), F.col("a") == F.col("x.rep")).select("a", "b", F.struct("x.n", "x.planes").alias("x"))
        .join(node.alias("y"), F.col("b") == F.col("y.rep")).where(fits()).select("a", "b")
    )
    pairs = store(pairs, "pairs")
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs, width)
    links = store(_confirmed(pairs, sets, percent), "links")
    found = components(links)

    # Members of one bucket that are still apart; a class without links is a component of its own.
    apart = store(placed.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "placed")
    split = apart.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    apart = store(apart.join(split, "bucket"), "apart")
    sets = _sets_of(apart.select(F.col("rep").alias("doc_id")).distinct(), docs, width, long=True)
    signs = sets.select(F.col("doc_id").alias("rep"), F.size("shingles").alias("n"), "planes").join(classes.select("rep", "bands"), "rep")
    rest = store(apart.join(signs, "rep"), "rest")
    more = store(_confirmed(store(_across(rest, percent), "pairs"), sets, percent), "links")
    if not more.isEmpty():
        found = components(store(links.unionByName(more), "links"))

    columns = "doc_id", "content", F.col("n").alias("n_shingles")
    shingled = (
        signed.where("n > 0").join(classes.select("k1", "k2", "n", "rep"), ["k1", "k2", "n"], "left")
        .join(found, F.col("rep") == F.col("node"), "left")
        .select(*columns, F.coalesce("component", "rep", "doc_id").alias("component_id"))
    )
    return (
        shingled.unionByName(signed.where("n = 0").select(*columns, F.col("doc_id").alias("component_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    )


def keep_one(documents: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of one document of each group, the one with the smallest id, with their columns.

    Rows without an id stay; rows that repeat an id are judged by their own text. Only rows that are dropped, and few others
    by chance, are shuffled.
    """
    judged = _judged(documents, width, percent, id_column, text_column)
    dropped = store(judged.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id", "content").distinct(), "dropped")
    suspect = might_be(f"`{id_column}`", dropped.select("doc_id"))
    own, d_id, d_content = (fresh(documents.columns, n) for n in ("content", "d_id", "d_content"))
    marked = documents.withColumn(own, F.xxhash64(F.col(f"`{text_column}`").cast("string")))
    same = (F.col(f"`{id_column}`") == F.col(d_id)) & (F.col(own) == F.col(d_content))
    checked = marked.where(suspect).join(dropped.toDF(d_id, d_content), same, "left_anti")
    return marked.where(~suspect).unionByName(checked).drop(own)
