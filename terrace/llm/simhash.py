"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees.

Fingerprints are sharded by blocks of their bits: two that differ in at most r bits agree
on some of any r+1 blocks, so they meet in a shard (pigeonhole), whose BK-tree finds them.
A shard's tree is built in the task that holds the shard's queries, since broadcasting
trees of all documents has no size bound. A shard beyond SHARD_ITEMS is cut into chunks;
each pair of chunks is a shard of its own, so a hot block value spreads over tasks and no
pair is lost. Each task returns a spanning forest of its links, never all pairs; star
contraction joins the forests.
"""

from __future__ import annotations

import math
import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .arrays import load, save
from .bktree import Forest, hook
from .common import fresh, scratch_path, shuffle_partitions, table, text_of, written
from .components import connected_components

#: Fingerprints in one tree; more in a shard are cut into pairs of chunks.
SHARD_ITEMS = 4096
#: Expected fingerprints in a shard, beyond which keys take more blocks.
SHARD_MEAN = 2048
QUERY_BLOCK = 4096
#: Rows that a task builds trees over at a time, unless one shard has more; and hashes whose bits are counted at a time.
UNIT_ROWS, HASH_BLOCK = 1 << 16, 1 << 15
_LOW_BITS = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """uint64 fingerprint of each row's hashes: a bit is 1 if set in over half of them; 0 where there are none."""
    length = np.diff(rows)
    out = np.zeros(len(length), np.uint64)
    full = np.flatnonzero(length)
    if not len(full):
        return out
    starts, ones = rows[:-1][full], np.zeros((len(full), 8, 8), np.int32)
    for a in range(0, len(hashes), HASH_BLOCK):
        part = hashes[a : a + HASH_BLOCK]
        first, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, a + len(part))
        begins = np.maximum(starts[first:last] - a, 0)
        # one bit of each byte at a time, summed byte by byte: no more than 255 hashes at once
        pieces = -(-np.diff(np.append(begins, len(part))) // 255)
        head = np.cumsum(pieces) - pieces
        cuts = np.repeat(begins, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(head, pieces))
        for bit in range(8):
            sums = np.add.reduceat((part >> np.uint64(bit)) & _LOW_BITS, cuts).view(np.uint8).reshape(-1, 8)
            ones[first:last, :, bit] += np.add.reduceat(sums, head, axis=0, dtype=np.int32)
    out[full] = np.packbits(2 * ones > length[full, None, None], axis=2, bitorder="little").reshape(-1).view("<u8")
    return out


def shingle_xxh64(text: bytes, width: int) -> list[int]:
    """XXH64 (seed 42) of every run of `width` space-joined words; fewer words: of the whole; none: nothing."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return []
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    if len(gaps) + 1 <= width:
        return [xxhash.xxh64_intdigest(joined, 42)]
    starts = [0, *(gaps[: len(gaps) - width + 2 - 1] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)]


def _exact(width: int):
    def run(batches):
        for batch in batches:
            for part in ta.slices(batch):
                hashes, rows = [], [0]
                for text in part.column("text").to_pylist():
                    hashes += shingle_xxh64((text or "").encode(), width)
                    rows.append(len(hashes))
                bits = majority_bits(np.array(hashes, np.uint64), np.array(rows))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bits.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (bigint: the 64 bits) of whole texts; null text: empty: fingerprint 0."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(_exact(width), "doc_id bigint, fp bigint")


def block_keys(fp: Column, radius: int, items: int, bits: int = 64) -> Column:
    """Array of shard keys so that any two fingerprints within the radius share one: all choices of `agree` of radius+agree blocks."""
    agree = 1
    while agree < 8 and items * 2.0 ** (-bits * agree / (radius + agree)) > SHARD_MEAN:
        agree += 1
    cuts = [round(bits * i / (radius + agree)) for i in range(radius + agree + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(radius + agree), agree)):
        mask = sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(mask).cast("bigint"))))
    return F.array(*keys)


def spread(keyed: DataFrame, *by: str, limit: int = SHARD_ITEMS) -> DataFrame:
    """Adds `unit` to rows with `key`: a shard, or for a key of over `limit` rows one of the pairs of chunks that its rows are cut into."""
    hot = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("key", F.ceil(F.col("n") / limit).cast("int").alias("chunks"))
    hot = written(hot, "hot")  # its size is then known, and a small one needs no shuffle of the other side
    own, other = F.pmod(F.xxhash64(*by), F.col("chunks")), F.col("other")
    return (
        keyed.join(hot, "key", "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("unit", F.when(F.col("chunks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least(own, other), F.greatest(own, other))))
        .drop("chunks", "other")
    )


def whole_units(batches, limit: int | None = None):
    """The rows, which come in order of unit, in tables of whole units of about that many rows: a task holds no more than these or its largest unit."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= (limit or UNIT_ROWS):
            rows = pa.Table.from_batches(held).combine_chunks()
            unit = rows.column("unit").to_numpy()
            cut = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on
            if cut:
                yield rows.slice(0, cut)
            held, n = rows.slice(cut).to_batches(), rows.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def in_units(df: DataFrame, tasks: int) -> DataFrame:
    """df dealt out by unit, each partition in order of unit, as whole_units() reads it."""
    return df.repartition(tasks, "unit").sortWithinPartitions("unit")


def _linker(radius: int):
    def run(batches):
        for rows in whole_units(batches):
            unit, fp = (rows.column(c).to_numpy() for c in ("unit", "fp"))
            order = np.lexsort((fp, unit))
            unit, fp = unit[order], fp[order]
            fresh = np.ones(len(unit), bool)
            fresh[1:] = (unit[1:] != unit[:-1]) | (fp[1:] != fp[:-1])
            unit, fp = unit[fresh], fp[fresh]
            forest, label = Forest(unit, fp.view(np.uint64)), np.arange(len(fp))
            for first in range(0, len(fp), QUERY_BLOCK):
                a, b, _ = forest.earlier_within(np.arange(first, min(first + QUERY_BLOCK, len(fp))), radius)
                hook(label, a, b)
            tied = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[tied]), pa.array(fp[label[tied]])], ["u", "v"])

    return run


def link_edges(points: DataFrame, radius: int, items: int) -> DataFrame:
    """u, v: a spanning forest, shard by shard, of all links between distinct fingerprints fp that differ in at most `radius` bits."""
    keyed = points.select("fp", F.explode(block_keys(F.col("fp"), radius, items)).alias("key"))
    units = spread(keyed, "fp").select("unit", "fp")
    return in_units(units, shuffle_partitions(points.sparkSession)).mapInArrow(_linker(radius), "u bigint, v bigint")


def simhash_classes(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id of every row: fingerprints link at `radius` or fewer differing bits.

    component_id is the smallest doc_id reachable over links. Texts that are null, empty or
    blank have fingerprint 0, linked like any other; repeated rows each get their row; null
    doc_ids get a row but are no class's smallest id (null where the class has no other);
    an empty table gives none. Only doc_id and text are read, so further columns never clash.
    """
    fps = written(fingerprints(docs, width), "fingerprints")
    points = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    roots = connected_components(link_edges(points, radius, points.count())).withColumnRenamed("node", "fp")
    named = points.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(classes, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near-duplicates by similarity -------------------------------------------------

#: Words of 64 bits in a wide fingerprint, and the bits of one shard key.
WIDE, KEY_BITS = 16, 16
#: Differing bits of the first 64 up to which a shard's tree reports a pair (p = 0.15 a bit at similarity 0.8: 3.5 deviations).
CANDIDATE_RADIUS = 20
#: Deviations beyond the expected differing bits up to which pairs are compared exactly, and the largest expected share
#: at similarity 0.8: that of sets of 5 and 4 shingles, where ties of the majority count most.
MARGIN, SMALL_SETS_SHARE = 4, 0.1875
#: Files of shingle sets that a task keeps mapped.
OPEN_FILES = 1024
#: Queries between two updates of a shard's classes, and pairs compared at a time.
WIDE_BLOCK, WIDE_PAIRS = 256, 1 << 17


def differing_share(similarity: float) -> float:
    """Expected share of differing SimHash bits of two equal-sized sets of that Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_differing(similarity: float) -> int:
    """Differing bits up to which a pair may be that similar."""
    share = max(differing_share(similarity), SMALL_SETS_SHARE)
    return math.ceil(share * 64 * WIDE + MARGIN * math.sqrt(share * (1 - share) * 64 * WIDE))


def _wide(width: int, folder: str):
    """doc_id, print, wide fingerprint, and where it and the set of shingles stand: number of a file in the folder, row of it."""

    def run(batches):
        for batch in batches:
            for part in ta.slices(batch):
                hashes, rows = ta.windows(*ta.word_hashes(part.column("text")), width)
                row = np.repeat(np.arange(part.num_rows), np.diff(rows))
                order = np.lexsort((hashes, row))
                row, hashes = row[order], hashes[order]
                fresh = np.ones(len(row), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
                hashes, rows = hashes[fresh], np.concatenate([[0], np.cumsum(np.bincount(row[fresh], minlength=part.num_rows))])
                bits = np.empty((part.num_rows, WIDE), np.uint64)
                for k in range(WIDE):
                    bits[:, k] = majority_bits(ta.mix(hashes + np.uint64(k)), rows)
                file = uuid.uuid4().int >> 65
                save(folder, str(file), [bits.reshape(-1), rows.astype(np.int64), hashes])
                place = [pa.array(np.full(part.num_rows, file, np.int64)), pa.array(np.arange(part.num_rows, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("print"), pa.array([x.tobytes() for x in bits], pa.binary()), *place], ["doc_id", "print", "wide", "file", "row"])

    return run


def _banded(batches):
    """wide, file, row -> key, file, row: a row for each 16-bit block, with its shard key."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        wide = np.frombuffer(b"".join(batch.column("wide").to_pylist()), np.uint16).reshape(n, WIDE * 4)
        key = wide.astype(np.int64) + (np.arange(WIDE * 4) << KEY_BITS)
        row = pa.array(np.repeat(np.arange(n), WIDE * 4))
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), batch.column("file").take(row), batch.column("row").take(row)], ["key", "file", "row"])


class Prints:
    """The files that _wide saved, mapped as they are asked for."""

    def __init__(self, folder: str):
        self.folder = folder
        self.opened: dict[int, tuple] = {}

    def _of(self, file: int):
        if file not in self.opened:
            if len(self.opened) >= OPEN_FILES:
                self.opened.clear()
            self.opened[file] = load(self.folder, str(file))
        return self.opened[file]

    def wide(self, file: np.ndarray, row: np.ndarray) -> np.ndarray:
        out = np.empty((len(file), WIDE), np.uint64)
        order = np.argsort(file, kind="stable")
        files, first = np.unique(file[order], return_index=True)
        for number, mine in zip(files.tolist(), np.split(order, first[1:]), strict=True):
            out[mine] = self._of(number)[0].reshape(-1, WIDE)[row[mine]]
        return out

    def shingles(self, file: int, row: int) -> np.ndarray:
        """A sorted set."""
        _, rows, hashes = self._of(file)
        return hashes[rows[row] : rows[row + 1]]


def node_of(wide: np.ndarray) -> np.ndarray:
    """What xxhash64() of the fingerprint's bytes is in a query."""
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in wide], np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity or more."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    if not len(a):
        return True
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def _wide_linker(folder: str, similarity: float):
    """A spanning forest of a shard's links. The tree over the first 64 bits proposes pairs; those of different
    classes so far are compared by the whole fingerprint, and those that may be similar by their shingle sets, a query's closest first."""
    most = most_differing(similarity)

    def linked(rows: pa.Table, prints: Prints) -> pa.RecordBatch:
        unit, file, row = (rows.column(c).to_numpy() for c in ("unit", "file", "row"))
        order = np.lexsort((row, file, unit))
        unit, file, row = unit[order], file[order], row[order]
        wide = prints.wide(file, row)
        shingles = lambda i: prints.shingles(int(file[i]), int(row[i]))
        forest, label = Forest(unit, np.ascontiguousarray(wide[:, 0])), np.arange(len(unit))
        for first in range(0, len(unit), WIDE_BLOCK):
            a, b, _ = forest.earlier_within(np.arange(first, min(first + WIDE_BLOCK, len(unit))), CANDIDATE_RADIUS)
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            for k in range(0, len(a), WIDE_PAIRS):
                u, v = a[k : k + WIDE_PAIRS], b[k : k + WIDE_PAIRS]
                d = np.bitwise_count(wide[u] ^ wide[v]).sum(axis=1, dtype=np.int64)
                closest = np.lexsort((d, u))
                closest = closest[d[closest] <= most]
                u, v = u[closest], v[closest]
                while (apart := label[u] != label[v]).any():
                    u, v = u[apart], v[apart]
                    head = np.ones(len(u), bool)
                    head[1:] = u[1:] != u[:-1]
                    i, j = u[head], v[head]
                    near = np.array([similar(shingles(x), shingles(y), similarity) for x, y in zip(i, j, strict=True)])
                    hook(label, i[near], j[near])
                    u, v = u[~head], v[~head]
        tied = np.flatnonzero(label != np.arange(len(unit)))
        return pa.RecordBatch.from_arrays([pa.array(node_of(wide[tied])), pa.array(node_of(wide[label[tied]]))], ["u", "v"])

    def run(batches):
        prints = Prints(folder)
        for rows in whole_units(batches):
            yield linked(rows, prints)

    return run


def _near_duplicates(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, print (of the text), root (number of the class), component_id of every row."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "shingles")
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).withColumn("print", F.xxhash64("text"))
    wide = source.mapInArrow(_wide(width, folder), "doc_id bigint, print bigint, wide binary, file bigint, row int")
    wide = written(wide.withColumn("node", F.xxhash64("wide")), "wide")
    first = F.first(F.struct("wide", "file", "row")).alias("p")
    points = written(wide.groupBy("node").agg(F.min("doc_id").alias("least"), first).select("node", "least", "p.*"), "points")
    keyed = points.select("wide", "file", "row").mapInArrow(_banded, "key bigint, file bigint, row int")
    units = in_units(spread(keyed, "file", "row").select("unit", "file", "row"), 2 * shuffle_partitions(spark))
    links = units.mapInArrow(_wide_linker(folder, similarity), "u bigint, v bigint")
    named = points.join(connected_components(links), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    classes = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "root", "component_id")
    return wide.select("doc_id", "print", "node").join(classes, "node").select("doc_id", "print", "root", "component_id")


def near_duplicate_classes(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id: classes of documents linked by a Jaccard similarity of that or more between their sets of `width`-word shingles.

    1024-bit SimHashes of the distinct shingles only propose pairs. Each of a fingerprint's 64
    blocks of 16 bits is a shard key; a BK-tree in each shard proposes pairs within the radius
    on the first 64 bits; pairs whose whole fingerprints may be so similar link if the shingle
    sets, kept in mapped arrays, are. Pairs are compared where they meet, and a shard returns
    a spanning forest of its links, so a large group of near copies never makes its pairs. A
    pair at 0.8 shares a shard with a probability of 0.99, closer pairs nearly always. Equal
    shingle sets share a fingerprint and meet before any of this, so a group of copies counts
    once. Blank texts form one class. Null doc_ids never name a class.
    """
    return _near_duplicates(docs, width, similarity).select("doc_id", "component_id")


def op6_simhash_bktree(spark, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"), width=4, radius=4)


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each class of near_duplicate_classes, of the smallest doc_id (null last), then text hash; columns unchanged.

    A row is known by its doc_id and text: rows that repeat both are copies, while different
    texts under one doc_id, or without any, go by their classes. Blank texts are one class.
    """
    rows = _near_duplicates(docs, width, similarity)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("k")
    kept = rows.groupBy("root").agg(first).select(F.col("k.doc_id").alias("id"), F.col("k.print").alias("kept"))
    own, of_id, of_print = fresh(docs, "print", "of_id", "of_print")
    kept = kept.select(F.col("id").alias(of_id), F.col("kept").alias(of_print))
    found = docs.withColumn(own, F.xxhash64(text_of())).join(kept, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(own) == F.col(of_print)))
    return found.drop(of_id, of_print).dropDuplicates(["doc_id", own]).drop(own)
