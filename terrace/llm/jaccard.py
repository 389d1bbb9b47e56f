"""Exact Jaccard self-join of shingle sets by prefixes of token combinations.

Shingles are ordered from rare to frequent by a merged count-min sketch. A set of n that is
to share all but e of its shingles needs e + 1 of its first ones to be told apart, so only
that prefix is indexed: a rare shingle by itself, of frequent ones every combination of two,
of very frequent ones every combination of three, among those of one bucket. Of a bucket's
shingles the first one or two prove nothing, so the prefix is longer by these. Sets that
link share a key; what shares a key is verified on the texts.

Keys of many sets never make all their pairs: in each round a key's sets meet one of them,
what links is joined, and keys within one class leave. The first rounds pick the set with the
least share of rare shingles, since what others were copied from has none of its own; later
ones pick by a hash. The first round takes a few keys of each set, so that groups of near
copies are one class before their keys are laid out. Pairs of different classes that are left
then meet, at the first of the keys they share and at few further ones. Wherever sets meet they carry the parities of their shingles in 256 cells: each cell
that differs stands for a shingle that only one of both has, so pairs with more of these than
links allow are not made. This never loses a link; of sets of some thousand shingles it tells
fewer apart, which are then verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import collect_shuffles, drop_written, shuffle_partitions, table, text_of, written
from .components import connected_components
from .sketch import Sketch, cell_bits, count_sketch

#: Estimated documents of a shingle from which it is frequent (indexed by two) and very frequent (by three).
FREQUENT, VERY_FREQUENT = 32, 255
#: Sets smaller than this are indexed by single shingles: combinations would leave them without a key.
SMALLEST_BAND = 3
#: A band's smallest size for a bucket of its frequent shingles.
SIZE_A_BUCKET = 16
#: Bytes of text for a cell of the sketches; most bits of a cell's number (64 MB); rows of cells.
CELL_BYTES, CELL_BITS, CELL_ROWS = 16, 26, 1
#: Keys of a set in the first round; rounds in which keys meet one set, and those of them that pick by rare shingles; sets that meet it in one task.
FEW_KEYS, STAR_ROUNDS, RARE_ROUNDS, UNIT_SETS = 4, 3, 2, 2048
#: Least keys of a set by which the last round tells at which of their common keys two sets are paired.
LEAST_KEYS = 16
#: Numbers of 64 cells in which a set's shingles are counted modulo two.
PARITIES = [f"odd{n}" for n in range(4)]
#: What a set's keys carry.
CARRIED = ["node", "size", "rare", "root", *PARITIES]
#: What both of two sets that meet bring.
MET = ["size", "root", *PARITIES]
_TAG = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle of each text, by row, then hash."""
    hashes, rows = ta.windows(*ta.word_hashes(column), width)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[first], hashes[first]


def _place(group: np.ndarray) -> np.ndarray:
    """How many equal values stand before each of a sorted array's."""
    at = np.arange(len(group))
    head = np.ones(len(group), bool)
    head[1:] = group[1:] != group[:-1]
    return at - np.maximum.accumulate(np.where(head, at, 0))


def _combinations(group: np.ndarray, hashes: np.ndarray, k: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and key of each combination of k hashes of one group; groups are runs of equal values."""
    owners, keys = [], []
    most = int(np.bincount(np.cumsum(np.append(True, group[1:] != group[:-1]))).max()) if len(group) else 0
    for a in range(1, most):
        i = np.flatnonzero(group[a:] == group[:-a])
        if k == 2:
            owners.append(owner[i])
            keys.append(ta.mix(hashes[i] * _TAG + hashes[i + a]))
            continue
        for b in range(a + 1, most):
            j = i[i + b < len(group)]
            j = j[group[j + b] == group[j]]
            owners.append(owner[j])
            keys.append(ta.mix((hashes[j] * _TAG + hashes[j + a]) * _TAG + hashes[j + b]))
    none = np.zeros(0, np.int64)
    return (np.concatenate(owners) if owners else none), (np.concatenate(keys) if keys else none.astype(np.uint64))


def prefix_keys(row: np.ndarray, hashes: np.ndarray, estimate: np.ndarray, n_rows: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and key, distinct, of all signatures of the sets: two that link at percent / 100 share one. Shingles of an estimate of 1 are nowhere else and make none by themselves."""
    size = np.bincount(row, minlength=n_rows)
    own = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
    up = (size * 100 // percent >= 2 << own) & (size > 0)  # may link with a set of the next band
    both = np.repeat(np.arange(n_rows), 1 + up)
    band = own[both] + (np.append(False, both[1:] == both[:-1]) if n_rows else 0)
    # the shingles of each (row, band), rare ones first
    order = np.lexsort((hashes, estimate, row))
    row, hashes, estimate = row[order], hashes[order], estimate[order]
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    many = size[both]
    case = np.repeat(np.arange(len(both)), many)
    at = np.repeat(begin[both], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    hashes, estimate, of_band = hashes[at], estimate[at].astype(np.int64), band[case]
    k = np.where(of_band < SMALLEST_BAND, 1, 1 + (estimate >= FREQUENT) + (estimate >= VERY_FREQUENT))
    buckets = np.maximum(1, (1 << of_band) // SIZE_A_BUCKET)
    bucket = ((hashes >> np.uint64(20)) % buckets.astype(np.uint64)).astype(np.int64)
    by = np.lexsort((np.arange(len(case)), bucket, k, case))
    head = np.ones(len(by), bool)
    head[1:] = (case[by][1:] != case[by][:-1]) | (k[by][1:] != k[by][:-1]) | (bucket[by][1:] != bucket[by][:-1])
    group = np.cumsum(head)
    proves = np.empty(len(by), bool)
    proves[by] = _place(group) >= k[by] - 1
    need = many - (many * percent + 99) // 100 + 1
    total = np.cumsum(proves)
    ends = np.cumsum(many)
    before = np.concatenate([[0], total])[ends - many] if len(ends) else ends
    inside = total - proves - before[case] < need[case]
    taken = by[inside[by]]
    group, k, case, hashes, estimate, of_band = group[inside[by]], k[taken], case[taken], hashes[taken], estimate[taken], of_band[taken]
    one = (k == 1) & (estimate > 1)
    owners, keys = [both[case[one]]], [hashes[one]]
    for size_of in (2, 3):
        mine = k == size_of
        owner, key = _combinations(group[mine], hashes[mine], size_of, case[mine])
        owners.append(both[owner])
        keys.append(ta.mix(key + (band[owner].astype(np.uint64) + np.uint64(64 * size_of)) * _TAG))
    owner, key = np.concatenate(owners), np.concatenate(keys)
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    return owner[first], key[first]


def parities(row: np.ndarray, hashes: np.ndarray, n_rows: int) -> np.ndarray:
    """For each row a bit for each of 256 cells: whether it holds an odd number of the row's hashes."""
    cell = (hashes >> np.uint64(56)).astype(np.int64)
    odd = np.zeros((n_rows, len(PARITIES)), np.uint64)
    np.bitwise_xor.at(odd, (row, cell >> 6), np.uint64(1) << (cell & 63).astype(np.uint64))
    return odd


def _shingle_counts(width: int):
    def keys(batch: pa.RecordBatch):
        for part in ta.slices(batch):
            _, hashes = shingle_sets(part.column("text"), width)
            yield hashes, np.ones(len(hashes), np.int64)

    return keys


def _signed(width: int, percent: int, sketch: Sketch):
    """doc_id, print, a digest of the set (two numbers), its size, how many in a thousand of its shingles are rare, their parities, and its keys."""

    def run(batches):
        for batch in batches:
            for part in ta.slices(batch):
                n = part.num_rows
                row, hashes = shingle_sets(part.column("text"), width)
                size = np.bincount(row, minlength=n)
                digest = np.array([xxhash.xxh128_intdigest(x.tobytes()).to_bytes(16, "little") for x in np.split(hashes, np.cumsum(size)[:-1])], "S16") if n else np.zeros(0, "S16")
                digest = np.frombuffer(digest.tobytes(), np.int64).reshape(-1, 2)
                estimate = sketch.estimates(hashes)
                owner, key = prefix_keys(row, hashes, estimate, n, percent)
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
                keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key.view(np.int64)))
                rare = 1000 * np.bincount(row, estimate < FREQUENT, minlength=n) // np.maximum(size, 1)
                columns = [part.column("doc_id"), part.column("print"), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(size, pa.int64()), pa.array(rare.astype(np.int64))]
                odd = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in parities(row, hashes, n).T]
                yield pa.RecordBatch.from_arrays([*columns, *odd, keys], ["doc_id", "print", "high", "low", "size", "rare", *PARITIES, "keys"])

    return run


def _key_counts(batch: pa.RecordBatch):
    keys = batch.column("keys").flatten().to_numpy().view(np.uint64)
    yield ta.mix(keys), np.ones(len(keys), np.int64)


def _one_of(column: str):
    def keys(batch: pa.RecordBatch):
        found = batch.column(column).to_numpy().view(np.uint64)
        yield ta.mix(found), np.ones(len(found), np.int64)

    return keys


def _held(batch: pa.RecordBatch, sketch: Sketch, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of a batch's keys whose estimate is at least that."""
    lists = batch.column("keys")
    keys, row = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
    may = sketch.estimates(ta.mix(keys.view(np.uint64))) >= least
    return row[may], keys[may]


def _laid_out(sketch: Sketch, least: int, few: int | None = None):
    """node, size, rare, root, parities, key of the keys that may be counted `least` times; at most `few` of a set, its smallest."""

    def run(batches):
        for batch in batches:
            row, keys = _held(batch, sketch, least)
            if few:
                order = np.lexsort((keys, row))
                row, keys = row[order], keys[order]
                first = _place(row) < few
                row, keys = row[first], keys[first]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in CARRIED), pa.array(keys)], [*CARRIED, "key"])

    return run


def _of_classes(sketch: Sketch):
    """key, root, once for each batch, of the keys that may be counted twice."""

    def run(batches):
        for batch in batches:
            row, keys = _held(batch, sketch, 2)
            root = batch.column("root").to_numpy()[row]
            order = np.lexsort((root, keys))
            keys, root = keys[order], root[order]
            first = np.ones(len(keys), bool)
            first[1:] = (keys[1:] != keys[:-1]) | (root[1:] != root[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(root[first])], ["key", "root"])

    return run


def _wanted(sketch: Sketch):
    def run(batches):
        for batch in batches:
            may = sketch.estimates(ta.mix(batch.column("print").to_numpy().view(np.uint64))) > 0
            yield batch.filter(pa.array(may))

    return run


def _verified(width: int, percent: int):
    """u, v of each pair of a unit's first text and a further one that link. Rows come by unit, the first text before the others; only its set is held."""

    def run(batches):
        unit, node, first = None, None, None
        for batch in batches:
            for part in ta.slices(batch):
                row, hashes = shingle_sets(part.column("text"), width)
                ends = np.cumsum(np.bincount(row, minlength=part.num_rows))
                u, v = [], []
                names = (part.column(c).to_pylist() for c in ("unit", "role", "node"))
                for mine, role, other, a, b in zip(*names, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    found = hashes[a:b]
                    if role == 0:
                        unit, node, first = mine, other, found.copy()
                        continue
                    if mine != unit:
                        raise ValueError("a unit without its first text")
                    common = int((first[np.minimum(np.searchsorted(first, found), len(first) - 1)] == found).sum())
                    if 100 * common >= percent * (len(first) + len(found) - common):
                        u.append(node)
                        v.append(other)
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) that link, written. A node with many partners is verified in several units, each with its own copy of the text."""
    many = pairs.groupBy("u").agg(F.ceil(F.count("v") / UNIT_SETS).cast("int").alias("units"))
    dealt = written(pairs.join(many, "u").withColumn("unit", F.xxhash64("u", F.pmod(F.xxhash64("v"), F.col("units")))).select("unit", "u", "v"), "pairs")
    first = dealt.select("unit", F.lit(0).alias("role"), F.col("u").alias("node")).distinct()
    rows = first.unionAll(dealt.select("unit", F.lit(1), "v")).join(texts, "node").select("unit", "role", "node", "text")
    rows = rows.repartition(2 * shuffle_partitions(pairs.sparkSession), "unit").sortWithinPartitions("unit", "role")
    found = written(rows.mapInArrow(_verified(width, percent), "u bigint, v bigint"), "links")
    drop_written(dealt)
    return found


def _may_link(percent: int) -> Column:
    """Whether the sizes and parities of sets u and v allow a link: at most (100 - percent) in (100 + percent) of both sizes' sum is in one set only."""
    u, v = F.col("u_size"), F.col("v_size")
    apart = sum((F.bit_count(F.col(f"u_{c}").bitwiseXOR(F.col(f"v_{c}"))) for c in PARITIES), F.lit(0))
    return (100 * F.least(u, v) >= percent * F.greatest(u, v)) & ((100 + percent) * apart <= (100 - percent) * (u + v))


def _texts_of(own: DataFrame, nodes: DataFrame, pairs: DataFrame, bits: int) -> DataFrame:
    """node, text of the nodes of these pairs. Texts that a sketch of their hashes does not know stay where they are."""
    asked = pairs.select(F.col("u").alias("node")).unionAll(pairs.select("v")).distinct()
    wanted = nodes.select("node", "text_of.*").join(asked, "node")
    known = count_sketch(wanted.select("print"), _one_of("print"), bits, CELL_ROWS)
    there = own.mapInArrow(_wanted(known), "doc_id bigint, text string, print bigint")
    same = there["doc_id"].eqNullSafe(wanted["doc_id"]) & (there["print"] == wanted["print"])
    return there.join(wanted, same).select("node", "text").groupBy("node").agg(F.first("text").alias("text"))


def _in_classes(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """With the class so far (node, root: of the linked ones) as root."""
    return keys.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _mixed(keys: DataFrame) -> DataFrame:
    """The keys that sets of several classes have."""
    return keys.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")


def _stars(keys: DataFrame, n: int) -> DataFrame:
    """u, v (with size, root and parities): each key's sets and the one of them that the round picks."""
    order = [F.col("rare")] if n < RARE_ROUNDS else []
    picked = F.min(F.struct(*order, F.xxhash64("node", F.lit(n)), "node", *MET)).alias("p")
    one = [F.col("p.node").alias("u"), *(F.col(f"p.{c}").alias(f"u_{c}") for c in MET)]
    return keys.join(keys.groupBy("key").agg(picked), "key").select(*one, F.col("node").alias("v"), *(F.col(c).alias(f"v_{c}") for c in MET))


def _pairs(keys: DataFrame, may: Column | bool = True) -> DataFrame:
    """u, v (with size, root and parities) of the sets that share a key and may link. Of the keys that two sets share, those above one that is among the least of both make no pair: the first of them does."""
    least = keys.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LEAST_KEYS).alias("least"))
    keys = keys.join(least, "node").withColumn("before", F.filter("least", lambda x: x < F.col("key")))
    side = lambda x: keys.select("key", F.col("node").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in [*MET, "before"]))
    return side("u").join(side("v"), "key").where("u < v").where(F.lit(may)).where(~F.arrays_overlap("u_before", "v_before"))


def jaccard_classes(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: texts link when 100 * common shingles >= percent * all shingles of both.

    Shingles are runs of `width` words with A-Z lower-cased, each counted once; of fewer words
    the whole sequence is one. Every link counts: component_id is the smallest doc_id reachable
    over links, itself included. Null, empty and blank texts have no shingles and no links;
    equal sets are one node; repeated rows each get their row; a null doc_id gets a row and
    names no class (null where the class has no other); an empty table gives no rows; further
    columns are not read. Two shingles are one if their 64-bit hashes agree.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).withColumn("print", F.xxhash64("text"))
    bits = cell_bits(docs, CELL_BYTES, CELL_BITS)
    sketch = count_sketch(own.select("text"), _shingle_counts(width), bits, CELL_ROWS)
    longs = ", ".join(f"{c} bigint" for c in PARITIES)
    signed = written(own.mapInArrow(_signed(width, percent, sketch), f"doc_id bigint, print bigint, high bigint, low bigint, size bigint, rare bigint, {longs}, keys array<bigint>"), "signed")
    first = F.min(F.struct("doc_id", "print")).alias("text_of")
    nodes = signed.where("size > 0").groupBy("high", "low").agg(F.min("doc_id").alias("least"), first, F.first("size").alias("size"), *(F.first(c).alias(c) for c in ["rare", *PARITIES, "keys"]))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    spark, layout = docs.sparkSession, ", ".join(f"{c} bigint" for c in [*CARRIED, "key"])
    seen = count_sketch(nodes.select("keys"), _key_counts, bits, CELL_ROWS)
    signs = nodes.withColumn("root", F.col("node")).select(*CARRIED, "keys")
    keys = written(signs.mapInArrow(_laid_out(seen, 2, FEW_KEYS), layout), "keys")
    links, used = None, [keys]
    for n in range(STAR_ROUNDS + 2):
        if n == 1:  # all keys, of which those within one class never leave the task
            signs = _in_classes(signs, roots).select(*CARRIED, "keys")
            mixed = written(_mixed(signs.mapInArrow(_of_classes(seen), "key bigint, root bigint")), "mixed")
            several = count_sketch(mixed, _one_of("key"), bits, CELL_ROWS)
            keys = written(signs.mapInArrow(_laid_out(several, 1), layout).join(mixed, "key"), "keys")
            used += [mixed, keys]
        elif n > 1:
            keys = _in_classes(keys, roots)
            keys = written(keys.join(_mixed(keys), "key"), "keys")
            used += [keys]
        if n and keys.isEmpty():
            break
        may = (F.col("u_root") != F.col("v_root")) & _may_link(percent)
        met = _stars(keys, n).where(may) if n <= STAR_ROUNDS else _pairs(keys, may)
        pairs = written(met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
        links_now = _links(pairs, _texts_of(own, nodes, pairs, bits), width, percent)
        links = links_now if links is None else links.unionAll(links_now)
        roots = connected_components(links)
        used += [pairs, links_now]
        collect_shuffles(spark)
    for done in used:
        drop_written(done)
    named = nodes.join(roots, "node", "left").select("high", "low", "least", F.coalesce("root", "node").alias("root"))
    classes = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(classes, "root").select("high", "low", "component_id")
    none = F.col("size") == 0
    return signed.join(named, ["high", "low"], "left").select("doc_id", F.col("size").alias("n_shingles"), F.when(none, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op11_combination_prefixes(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), width=4, percent=85)
