"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a run of words: hashing only the words at its 1s makes two runs
that differ at its 0s collide. Of the six seeds together one hits in every stretch of 13 to
25 words of which up to a fifth are substituted. Hashes of the documents' runs meet the
benchmark's in a join. Before that a Bloom filter of the benchmark's hashes, whose size is
fixed by a parameter, drops runs that cannot match; a benchmark too large for it lets more
runs through to the join, never fewer. Every hit keeps the words around it as far as the
longest item reaches, so that document and item are compared word by word along the whole of
each diagonal they share, substitutions tolerated; an overlap counts if it is long and alike
enough. Copies of a text are compared once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import collect_shuffles, fresh, table, text_of, written

#: Fixed masks of weight 5; 1 is a word that must match, 0 one that may differ.
SEEDS = ("111011", "11011001", "1010010011", "1100100101", "100101000101", "110001000011")
SHORTEST, SPAN = min(map(len, SEEDS)), max(map(len, SEEDS))
#: Words of an overlap, and the percentage of them that must be equal.
MIN_OVERLAP, MIN_EQUAL = 13, 80
#: Bits of the Bloom filter (4 MB), and hash functions.
BLOOM_BITS, BLOOM_PROBES = 1 << 25, 4
#: Rows up to which the benchmark's hashes (16 bytes each) or items (by their words) are broadcast; beyond, rows are joined by shuffles, with the hashes salted.
BROADCAST_HASHES, BROADCAST_WORDS, SALTS = 1_000_000, 2_000_000, 16
#: Pairs of equal hashes that are looked at at a time.
PAIR_BLOCK = 1 << 20


def seed_hashes(hashes: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash, position) of every run of words under each seed; rows shorter than a seed have none of it."""
    out = []
    for n, mask in enumerate(SEEDS):
        count = np.maximum(np.diff(rows) - len(mask) + 1, 0)
        at = np.repeat(rows[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        h = np.full(len(at), n + 1, np.uint64)
        for k in (k for k, bit in enumerate(mask) if bit == "1"):
            h = ta.mix(h ^ hashes[at + k])
        out.append((h, at))
    return out


def bloom_slots(h: np.ndarray) -> list[np.ndarray]:
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
    return [((low + np.uint64(k) * (high | np.uint64(1))) % np.uint64(BLOOM_BITS)).astype(np.int64) for k in range(BLOOM_PROBES)]


def _bloom_of(batches):
    """The bytes of one partition's filter that are not zero."""
    bits = np.zeros(BLOOM_BITS // 8, np.uint8)
    for batch in batches:
        for slot in bloom_slots(batch.column("h").to_numpy().view(np.uint64)):
            np.bitwise_or.at(bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
    at = np.flatnonzero(bits)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].astype(np.int16))], ["at", "bits"])


def bloom(hashes: DataFrame) -> np.ndarray:
    """The filter of column h: at most BLOOM_BITS / 8 rows come to the driver, however many hashes there are."""
    merged = hashes.mapInArrow(_bloom_of, "at bigint, bits smallint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    out[merged["at"].to_numpy(np.int64)] = merged["bits"].to_numpy().astype(np.uint8)
    return out


def _item_hashes(batches):
    for batch in batches:
        for part in ta.slices(batch):
            hashes, rows = ta.word_hashes(part.column("text"), ta.NOT_ALNUM)
            for h, at in seed_hashes(hashes, rows):
                row = np.searchsorted(rows, at, "right") - 1
                item = part.column("item").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), item], ["h", "item"])


def _words(batches):
    for batch in batches:
        for part in ta.slices(batch):
            hashes, rows = ta.word_hashes(part.column("text"), ta.NOT_ALNUM)
            words = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("item"), words], ["item", "words"])


def _hits(spread, reach: int):
    """Stretches of a document that may match: hits whose surroundings overlap share one, with its words, and where each hash first and last stands in it."""

    def run(batches):
        bits = spread.value
        for batch in batches:
            for part in ta.slices(batch):
                hashes, rows = ta.word_hashes(part.column("text"), ta.NOT_ALNUM)
                found_h, found_at = [], []
                for h, at in seed_hashes(hashes, rows):
                    keep = np.ones(len(h), bool)
                    for slot in bloom_slots(h):
                        keep[keep] = bits[slot[keep] >> 3] >> (slot[keep] & 7) & 1 == 1
                    found_h.append(h[keep])
                    found_at.append(at[keep])
                h, at = np.concatenate(found_h), np.concatenate(found_at)
                if not len(h):
                    continue
                order = np.argsort(at, kind="stable")
                h, at = h[order], at[order]
                row = np.searchsorted(rows, at, "right") - 1
                head = np.ones(len(at), bool)
                head[1:] = (row[1:] != row[:-1]) | (at[1:] - at[:-1] > SPAN + 2 * reach)
                first = np.flatnonzero(head)
                last = np.append(first[1:], len(at)) - 1
                low = np.maximum(at[first] - reach, rows[row[first]])
                width = np.minimum(at[last] + SPAN + reach, rows[row[first] + 1]) - low
                place = np.repeat(low, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                bounds = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                stretch = np.cumsum(head) - 1
                order = np.lexsort((at, h, stretch))
                h, at, stretch = h[order], at[order], stretch[order]
                head = np.ones(len(at), bool)
                head[1:] = (h[1:] != h[:-1]) | (stretch[1:] != stretch[:-1])
                begin = np.flatnonzero(head)
                end = np.append(begin[1:], len(at)) - 1
                inside = lambda x: pa.array((at[x] - low[stretch[x]]).astype(np.int32))  # noqa: B023, E731
                hits = pa.StructArray.from_arrays([pa.array(h[begin].view(np.int64)), inside(begin), inside(end)], ["h", "first", "last"])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_key").take(pa.array(row[first])),
                        pa.array((low - rows[row[first]]).astype(np.int64)),
                        pa.ListArray.from_arrays(bounds(width), pa.array(hashes[place].view(np.int64))),
                        pa.ListArray.from_arrays(bounds(np.bincount(stretch[begin], minlength=len(first))), hits),
                    ],
                    ["doc_key", "low", "words", "hits"],
                )

    return run


def longest_alike(same: np.ndarray) -> tuple[int, int]:
    """First place and length of the longest stretch in which at least MIN_EQUAL percent are equal; the earliest of several."""
    prefix = np.concatenate([[0], np.cumsum(np.where(same, 100 - MIN_EQUAL, -MIN_EQUAL))])
    lowest = np.minimum.accumulate(prefix)
    start = np.searchsorted(-lowest, -prefix)  # the earliest prefix that is no higher
    length = np.arange(len(prefix)) - start
    end = int(np.argmax(length))
    return int(start[end]), int(length[end])


def shared_diagonals(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Shifts at which a seed of the item stands in the document: item word k at document word k + shift."""
    seen = np.zeros(len(doc) + len(item) + 1, bool)
    whole = lambda x: seed_hashes(x.view(np.uint64), np.array([0, len(x)]))
    for (h, at), (mine, mine_at) in zip(whole(doc), whole(item), strict=True):
        order = np.argsort(mine)
        mine, mine_at = mine[order], mine_at[order]
        low, high = np.searchsorted(mine, h), np.searchsorted(mine, h, "right")
        found = np.flatnonzero(high > low)
        upto = np.cumsum(high[found] - low[found])
        start = 0
        while start < len(found):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIR_BLOCK)))
            k = found[start:stop]
            n = high[k] - low[k]
            slot = np.repeat(low[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
            seen[np.repeat(at[k], n) - mine_at[slot] + len(item)] = True
            start = stop
    return np.flatnonzero(seen) - len(item)


def longest_overlap(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int] | None:
    """(length, equal words, first document word) of the longest overlap of the two along any shared diagonal; then the most equal, then the earliest."""
    best = None
    least = min(MIN_OVERLAP, len(item))  # of an item shorter than that all must be there
    for shift in shared_diagonals(doc, item).tolist():
        begin, end = max(0, -shift), min(len(item), len(doc) - shift)
        same = item[begin:end] == doc[begin + shift : end + shift]
        if end - begin < least or 100 * same.sum() < MIN_EQUAL * least:
            continue
        start, length = longest_alike(same)
        found = (length, int(same[start : start + length].sum()), -(begin + start + shift))
        if length >= least and (best is None or found > best):
            best = found
    return best and (best[0], best[1], -best[2])


def _verified(batches):
    for batch in batches:
        out = []
        columns = [batch.column(c) for c in ("doc_key", "item", "low", "words", "item_words")]
        for key, item, low, words, item_words in zip(*(c.to_pylist() for c in columns[:3]), columns[3], columns[4], strict=True):
            found = longest_overlap(words.values.to_numpy(), item_words.values.to_numpy())
            if found:
                out.append((key, item, low + found[2], found[0], found[1]))
        yield pa.RecordBatch.from_pylist([dict(zip(_OVERLAP.names, x, strict=True)) for x in out], schema=_OVERLAP)


_OVERLAP = pa.schema([("doc_key", pa.string()), ("item", pa.int64()), ("first", pa.int64()), ("length", pa.int64()), ("equal", pa.int64())])


def _meeting(hits: DataFrame, hashes: DataFrame) -> DataFrame:
    """hits joined to the items' hashes: by broadcast while these are few, else with every hash dealt to SALTS keys, for hashes of common words."""
    if hashes.count() <= BROADCAST_HASHES:
        return hits.join(F.broadcast(hashes), "h")
    salted = hashes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return hits.withColumn("salt", F.pmod(F.xxhash64("run"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"]).drop("salt")


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_key, item, first, length, equal: the longest verified overlap of an item with each stretch of a document, whatever the case and punctuation. docs: doc_key, text; items: item, text."""
    spark = docs.sparkSession
    items = items.where(F.col("item").isNotNull()).select("item", F.lower(text_of()).alias("text"))
    hashes = written(items.mapInArrow(_item_hashes, "h bigint, item bigint").distinct(), "seeds")
    words = written(items.mapInArrow(_words, "item bigint, words array<bigint>").withColumnRenamed("words", "item_words"), "items")
    reach, n_words = words.agg(F.coalesce(F.max(F.size("item_words")), F.lit(0)), F.coalesce(F.sum(F.size("item_words")), F.lit(0))).first()
    spread = spark.sparkContext.broadcast(bloom(hashes))
    runs = docs.select("doc_key", F.lower(text_of()).alias("text")).mapInArrow(_hits(spread, reach), "doc_key string, low bigint, words array<bigint>, hits array<struct<h:bigint,first:int,last:int>>")
    runs = written(runs.dropDuplicates(["doc_key", "low"]).withColumn("run", F.monotonically_increasing_id()), "runs")
    collect_shuffles(spark)
    hits = runs.select("run", F.explode("hits").alias("hit")).select("run", "hit.*")
    met = _meeting(hits, hashes).groupBy("run", "item").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    pairs = met.join(F.broadcast(words) if n_words <= BROADCAST_WORDS else words, "item").join(runs.select("run", "doc_key", "low", "words"), "run")
    begin = F.greatest(F.col("first") - F.size("item_words"), F.lit(0))
    around = F.slice("words", begin + 1, F.col("last") - begin + SPAN + F.size("item_words"))
    pairs = pairs.select("doc_key", "item", (F.col("low") + begin).alias("low"), around.alias("words"), "item_words")
    return pairs.mapInArrow(_verified, "doc_key string, item bigint, first bigint, length bigint, equal bigint")


def with_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_key", F.md5(text_of().cast("binary")))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_key (MD5 of the text), n_items, item_id (smallest), first, length, equal of the longest overlap, for texts that hold a benchmark passage."""
    texts = with_key(docs.select("text"))
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item"), "text")
    longest = F.max(F.struct("length", "equal", (-F.col("first")).alias("before"))).alias("m")
    return overlaps(texts, items).groupBy("doc_key").agg(F.count_distinct("item").alias("n_items"), F.min("item").alias("item_id"), longest).select("doc_key", "n_items", "item_id", (-F.col("m.before")).alias("first"), F.col("m.length").alias("length"), F.col("m.equal").alias("equal"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text holds no benchmark passage, columns unchanged.

    Null and empty texts and those of fewer than SHORTEST words hold none; copies of a text go or
    stay together; items of fewer than SHORTEST words (null or empty ones too) and items without
    an id match nothing; empty tables on either side leave docs as they are. Further columns of
    either table are carried along, whatever their names, or not looked at.
    """
    key, bad_key = fresh(docs, "key", "bad_key")
    bad = contaminated(docs, benchmark).select(F.col("doc_key").alias(bad_key))
    return docs.withColumn(key, F.md5(text_of().cast("binary"))).join(bad, F.col(key) == F.col(bad_key), "left_anti").drop(key)


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_id, first, length, equal of every row; nulls where clean.

    first counts the words (runs of letters and digits) before the longest overlap; of equally
    long ones that with the most equal words, then the earliest. item_id is the smallest id of
    the n_items items found. Nulls, short texts and empty tables as in decontaminate(); repeated
    rows each get a row; further columns of either table are not read.
    """
    rows = with_key(docs.select("doc_id", "text")).drop("text")
    found = rows.join(contaminated(docs, benchmark), "doc_key", "left")
    return found.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", "first", "length", "equal")


def op4_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
