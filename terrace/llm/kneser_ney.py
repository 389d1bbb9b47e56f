"""Interpolated modified Kneser-Ney language model: counted in Spark, kept as sorted hash
arrays, memory-mapped by the tasks that score.

Counting. Tasks turn texts into n-grams of 64-bit word hashes, merge equal ones, and deal
them to shards as packed arrays: a blob's distinct words once, a context once, then its
followers, both as numbers of the words, compressed. Each shard merges its n-grams, writes
the array of their hashes and counts, and hands on partial sums: the statistics of contexts,
and the distinct n-grams' suffixes, which are the next lower order's continuation counts. A
context's followers are spread over several shards, so a frequent word does not land in one
task.

Rounds. The text is read PASSES times, each time for the n-grams of a part of the words
before the last one, so a round's shuffles and partial sums are a part of the whole on disk.
An n-gram's context and its suffix share that word, so both are whole within a round; only
single words are summed over all rounds at the end.

Store. Every shard's arrays are one file in a folder below spark.checkpoint.dir, written
under a temporary name and renamed, so a repeated task leaves the same file. A table keeps
leading bits of its sorted hashes as bucket bounds and 32 more of each. A context with one
follower, seen once, is not kept: that it is an n-gram of the order below tells as much.
Tasks map the files that they look into.

Hashes of 64 bits stand for n-grams: two of n collide with a chance of n^2 / 2^65.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .arrays import count_arrays, counts_at, key_arrays, load, save, slots
from .common import collect_shuffles, drop_written, remainder_of_id, scratch_path, table, text_of, written

BEGIN, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)
_STEP = np.uint64(0xFF51AFD7ED558CCD)
#: n-grams that a task merges at a time.
MERGE_GRAMS = 3_000_000
FOLDS, HELD_OUT = 7, 2
#: Rounds of counting, each over the n-grams of some words before the last, so that only one round's shuffles are on disk.
PASSES = 4
#: Bytes of text that a task scores at a time.
SCORE_BYTES = 4 << 20
#: Bytes of text for each shard: their number follows the data.
SHARD_BYTES = 16 << 20


# --- packed arrays ---------------------------------------------------------------


def pack(arrays: list[np.ndarray]) -> bytes:
    head = b"".join(a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little") for a in arrays)
    plain = len(arrays).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays)
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    blob = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(blob[:4], "little")
    at, out = 4 + 12 * n, []
    for k in range(n):
        dtype = np.dtype(blob[4 + 12 * k : 8 + 12 * k].decode().strip())
        length = int.from_bytes(blob[8 + 12 * k : 16 + 12 * k], "little")
        out.append(np.frombuffer(blob, dtype, length, at))
        at += length * dtype.itemsize
    return out


def small(counts: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes, with those of 255 and more in a second array."""
    return [np.minimum(counts, 255).astype(np.uint8), counts[counts >= 255].astype(np.uint64)]


def large(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = low.astype(np.uint64)
    out[low == 255] = high
    return out


def coded(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The distinct words of some columns as differences, byte by byte, then each column as numbers of these, as narrow as they go."""
    found = pc.dictionary_encode(pa.array(np.concatenate(columns)))
    words, at = found.dictionary.to_numpy(), found.indices.to_numpy()
    order = np.argsort(words)
    number = np.empty(len(words), np.min_scalar_type(len(words)))
    number[order] = np.arange(len(words))
    steps = np.diff(words[order], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return [np.ascontiguousarray(steps).reshape(-1), *np.split(number[at], np.cumsum([len(c) for c in columns])[:-1])]


def decoded(steps: np.ndarray) -> np.ndarray:
    """The distinct words again."""
    return np.cumsum(np.ascontiguousarray(steps.reshape(8, -1).T).view(np.uint64).reshape(-1), dtype=np.uint64)


# --- n-grams ---------------------------------------------------------------------


def extended(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of the n-grams of hash h with one more word."""
    h = (h ^ word) * _STEP
    h ^= h >> np.uint64(29)
    return h


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = extended(h, c)
    return h


def merge(columns: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Hash, columns and summed counts of the distinct n-grams, by hash."""
    h = gram_hash(columns)
    order = np.argsort(h)
    h = h[order]
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(head)
    add = [np.add.reduceat(s[order], first) if len(first) else s[:0] for s in sums]
    return h[first], [c[order][first] for c in columns], add


def spread_over(context: np.ndarray, last: np.ndarray, shards: int) -> np.ndarray:
    """Shard of n-grams by the hash of their context and a part of their last word's, so that a context meets several shards but not all."""
    part = ta.mix(last) % np.uint64(max(4, shards // 16))
    return (ta.mix(context + part * _STEP) % np.uint64(shards)).astype(np.int64)


def place(columns: list[np.ndarray], shards: int) -> np.ndarray:
    """Shard of each n-gram."""
    if len(columns) == 1:
        return (ta.mix(columns[0]) % np.uint64(shards)).astype(np.int64)
    return spread_over(gram_hash(columns[:-1]), columns[-1], shards)


def pass_of(before: np.ndarray) -> np.ndarray:
    """Round that counts the n-grams with that word before the last one."""
    return ((ta.mix(before ^ _STEP) >> np.uint64(20)) % np.uint64(PASSES)).astype(np.int32)


def dealt(columns: list[np.ndarray], sums: list[np.ndarray], shards: int):
    """(shard, blob) of n-grams: the distinct words, contexts once, then run lengths, last words and counts; words as numbers of the distinct ones."""
    shard = place(columns, shards)
    context = gram_hash(columns[:-1]) if len(columns) > 1 else np.zeros(len(shard), np.uint64)
    room = np.uint64(max(1, int(shards).bit_length()))
    order = np.argsort((shard.astype(np.uint64) << (np.uint64(64) - room)) | (context >> room))
    shard, context = shard[order], context[order]
    columns, sums = [c[order] for c in columns], [s[order] for s in sums]
    edges = np.searchsorted(shard, np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(edges)):
        a, b = edges[k], edges[k + 1]
        head = np.ones(b - a, bool)
        head[1:] = context[a + 1 : b] != context[a : b - 1]
        runs = np.diff(np.append(np.flatnonzero(head), b - a))
        words, *context_words, last = coded([*(c[a:b][head] for c in columns[:-1]), columns[-1][a:b]])
        arrays = [words, *context_words, *small(runs), last]
        for s in sums:
            arrays += small(s[a:b])
        yield int(k), pack(arrays)


def gathered(blobs: list[bytes], width: int, n_sums: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    columns, sums = [[] for _ in range(width)], [[] for _ in range(n_sums)]
    for blob in blobs:
        words, *arrays = unpack(blob)
        words = decoded(words)
        runs = large(*arrays[width - 1 : width + 1]).astype(np.int64)
        for k in range(width - 1):
            columns[k].append(np.repeat(words[arrays[k]], runs))
        columns[-1].append(words[arrays[width + 1]])
        for k in range(n_sums):
            sums[k].append(large(*arrays[width + 2 + 2 * k : width + 4 + 2 * k]))
    return [np.concatenate(c) for c in columns], [np.concatenate(s) for s in sums]


def stream(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows' words one after the other, each row behind order - 1 (one at least) begins and before one end; the places of the tokens; row offsets into the tokens."""
    words, rows = ta.word_hashes(column)
    begins, length = max(order - 1, 1), np.diff(rows)
    padded = np.concatenate([[0], np.cumsum(length + begins + 1)])
    flat, token = np.full(padded[-1], BEGIN), np.ones(padded[-1], bool)
    for k in range(begins):
        token[padded[:-1] + k] = False
    at = np.flatnonzero(token)
    token[padded[1:] - 1] = False
    flat[token] = words
    flat[padded[1:] - 1] = END
    return flat, at, np.concatenate([[0], np.cumsum(length + 1)])


def grams_at(flat: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """Columns of the n-grams that end at the places."""
    return [flat[at - n + 1 + k] for k in range(n)]


def _count(order: int, shards: int, turn: int):
    def flush(parts):
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        _, columns, (counts,) = merge(columns, [np.ones(len(columns[0]), np.uint64)])
        pairs = list(dealt(columns, [counts], shards))
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.binary())], ["shard", "blob"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for part in ta.slices(batch):
                flat, at, _ = stream(part.column("text"), order)
                mine = at[pass_of(flat)[at - 1] == turn] if order > 1 else at
                parts.append(grams_at(flat, mine, order))
                held += len(mine)
                if held >= MERGE_GRAMS:
                    yield flush(parts)
                    parts, held = [], 0
        if held:
            yield flush(parts)

    return run


# --- the store -------------------------------------------------------------------


PART = "kind string, shard int, blob binary"


def _parts(rows: list[tuple[str, int, bytes]]) -> pa.Table:
    kind, shard, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"kind": pa.array(kind, pa.string()), "shard": pa.array(shard, pa.int32()), "blob": pa.array(blob, pa.binary())})


#: Figures of a context with one follower, seen once: its total and its followers with counts of 1, 2 and 3 or more.
SINGLE = (1, 1, 0, 0)


def begins(n: int) -> np.ndarray:
    """Key of the context of n begins, the only one that is no n-gram of the order below."""
    return gram_hash([gram_hash([np.array([BEGIN])] * n)])


def _reduce(folder: str, level: int, order: int, shards: int, turn: int):
    """Merges a shard: n-grams of the level, or partial statistics of the contexts of the level above. A round's arrays are numbered after those of the rounds before."""
    base = turn * shards

    def contexts(shard: int, blobs: list[bytes]) -> pa.Table:
        key, _, sums = merge(*gathered(blobs, 1, 4))  # distinct contexts, keyed as Model.contexts keys them
        if level > 1:
            kept = ~np.logical_and.reduce([s == k for s, k in zip(sums, SINGLE, strict=True)]) | (key == begins(level))
            key, sums = key[kept], [s[kept] for s in sums]
        _, first, kind = np.unique(gram_hash(sums), return_index=True, return_inverse=True)
        save(folder, f"context{level + 1}-{base + shard}", [*key_arrays(key), kind.astype(np.min_scalar_type(len(first))), *(s[first] for s in sums)])
        return _parts([])

    def grams(shard: int, blobs: list[bytes]) -> pa.Table:
        n_sums = 1 if level == order else 2
        columns, sums = gathered(blobs, level, n_sums)
        key, columns, sums = merge(columns, sums)
        count, total = sums[0], sums[-1]
        save(folder, f"gram{level}-{base + shard}", [*key_arrays(key), *(x for s in ([count] if level > 1 else [count, total]) for x in count_arrays(s))])
        figures = [np.array([(count == k).sum() for k in (1, 2, 3, 4)] + [(count >= 3).sum(), count.sum(), total.sum(), len(key)], np.uint64)]
        out = [("figures", shard, pack(figures))]
        if level > 1:
            ones = np.ones(len(key), np.uint64)
            kinds = [(count == 1), (count == 2), (count >= 3)]
            _, name, stats = merge([gram_hash(columns[:-1])], [count, *(k.astype(np.uint64) for k in kinds)])
            out += [("context", k, blob) for k, blob in dealt(name, stats, shards)]
            _, suffix, sums = merge(columns[1:], [ones, total])
            out += [("gram", k, blob) for k, blob in dealt(suffix, sums, shards)]
        return _parts(out)

    def run(key, rows):
        blobs = rows.column("blob").to_pylist()
        return (contexts if key[0].as_py() == "context" else grams)(key[1].as_py(), blobs)

    return run


# --- the model -------------------------------------------------------------------


@dataclass(frozen=True)
class Level:
    """Figures of one order: counts of counts, their sum, and the discounts for counts 1, 2 and 3 or more."""

    n: tuple[int, int, int, int]
    three_or_more: int
    total: int
    discount: tuple[float, float, float] = field(default=(0.0, 0.0, 0.0))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney; 0.5, 1 and 1.5 where a count of counts is 0 or gives none within bounds."""
    if min(n1, n2, n3, n4) > 0:
        y = n1 / (n1 + 2 * n2)
        found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 < d < k for k, d in enumerate(found, 1)):
            return found
    return 0.5, 1.0, 1.5


#: Files of a model that a task keeps mapped, each with a handle; of more, the one unused longest is closed.
OPEN_FILES = 256


class Model:
    """A counted model; small, and so sent to the tasks, which map its arrays as they need them."""

    def __init__(self, folder: str, order: int, shards: int, levels: list[Level], train_tokens: int, types: int):
        self.folder, self.order, self.shards, self.levels, self.train_tokens, self.types = folder, order, shards, levels, train_tokens, types
        self.open_files = OPEN_FILES
        self._open: dict = {}  # the one used last comes last

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def _arrays(self, table: str, number: int) -> list[np.ndarray] | None:
        name = f"{table}-{number}"
        if name in self._open:
            found = self._open.pop(name)
        else:
            while len(self._open) >= self.open_files:
                del self._open[next(iter(self._open))]
            try:
                found = load(self.folder, name)
            except FileNotFoundError:
                found = None  # no n-gram came to that shard
        self._open[name] = found
        return found

    def lookup(self, table: str, key: np.ndarray, home: np.ndarray, width: int, read) -> np.ndarray:
        """(width, len(key)) figures, by read(arrays of a file, slots); 0 for hashes that the table lacks. Keys are looked up file by file, in their order there."""
        out = np.zeros((width, len(key)), np.uint64)
        room = np.uint64(max(1, int(home.max(initial=0)).bit_length()))
        by_home = (home.astype(np.uint64) << (np.uint64(64) - room)) | (key >> room)
        order = np.argsort(by_home)
        homes = by_home[order] >> (np.uint64(64) - room)
        edges = np.flatnonzero(np.concatenate([[True], homes[1:] != homes[:-1]])) if len(key) else []
        for first, last in zip(edges, [*edges[1:], len(key)], strict=True):
            arrays = self._arrays(table, int(homes[first]))
            if arrays is not None:
                mine = order[first:last]
                slot, hit = slots(arrays[0], arrays[1], key[mine])
                mine, slot = mine[hit], slot[hit]
                for k, figure in enumerate(read(arrays[2:], slot)):
                    out[k, mine] = figure
        return out

    def probabilities(self, flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of the word at each place given those before it, and its count as a word in training; rows: offsets into the places."""
        shards, level = self.shards, self.levels[0]
        found = pc.dictionary_encode(pa.array(flat))
        word, of = found.dictionary.to_numpy(), found.indices.to_numpy()
        turn, alone = pass_of(word).astype(np.int64) * shards, place([word], shards)
        count, raw = self.lookup("gram1", gram_hash([word]), alone, 2, lambda a, slot: [counts_at(a[:3], slot), counts_at(a[3:], slot)])
        if level.total:
            spare = (np.array(level.discount) * [level.n[0], level.n[1], level.three_or_more]).sum() / level.total
            p = (self._kept(count, level) / level.total + spare / (self.types + 1))[of[at]]
        else:
            p = np.full(len(at), 1 / (self.types + 1))
        figures = lambda a, slot: [x[a[0][slot]] for x in a[1:]]
        held = None
        for n in range(2, self.order + 1):
            level = self.levels[n - 1]
            if n == 2:
                before = gram_hash([word])
                stats = self.lookup("context2", gram_hash([before]), place([before], shards), 4, figures)[:, of[at - 1]]
                before = before[of[at - 1]]
            else:
                before = gram_hash(grams_at(flat, at, n)[:-1])
                stats = self.lookup(f"context{n}", gram_hash([before]), place([before], shards) + turn[of[at - 1]], 4, figures)
            total, spare = stats[0].astype(float), sum(d * k for d, k in zip(level.discount, stats[1:], strict=True))
            if n > 2:  # contexts with one follower, seen once, are no more than n-grams of the order below, which end one place before
                single = np.concatenate([[False], held[:-1]]) & (total == 0)
                single[rows[:-1]] = False
                total[single], spare[single] = 1, level.discount[0]
            last = flat[at]
            (count,) = self.lookup(f"gram{n}", extended(before, last), spread_over(before, last, shards) + turn[of[at - 1]], 1, lambda a, slot: [counts_at(a, slot)])
            held, known = count > 0, total > 0
            total[~known], spare[~known] = 1, 1
            p = self._kept(count, level) / total + spare / total * p
        return p, raw[of[at]]

    @staticmethod
    def _kept(count: np.ndarray, level: Level) -> np.ndarray:
        off = np.array([0.0, *level.discount])[np.minimum(count, 3).astype(np.int64)]
        return np.maximum(count.astype(float) - off, 0)


def train(docs: DataFrame, order: int = 3) -> Model:
    """Counts a model of that order over all the documents' whole texts (null: empty: one end token)."""
    spark = docs.sparkSession
    texts, folder = docs.select(text_of().alias("text")), scratch_path(spark, "ngrams")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    shards = 1 + size // SHARD_BYTES
    figures = {level: np.zeros(8, np.int64) for level in range(1, order + 1)}

    def reduced(rows: DataFrame, level: int, turn: int) -> DataFrame:
        parts = written(rows.groupBy("kind", "shard").applyInArrow(_reduce(folder, level, order, shards, turn), PART), f"level{level}")
        for row in parts.where("kind = 'figures'").select("blob").collect():  # one short row a shard
            figures[level] += unpack(row.blob)[0].astype(np.int64)
        collect_shuffles(spark)
        return parts

    rest, read = [], []
    for turn in range(PASSES if order > 1 else 1):
        rows = texts.mapInArrow(_count(order, shards, turn), "shard int, blob binary").select(F.lit("gram").alias("kind"), "shard", "blob")
        for level in range(order, 1, -1):
            parts = reduced(rows, level, turn)
            if level < order:
                drop_written(read.pop())
            read.append(parts)
            rows = parts.where("kind <> 'figures'")
        rest.append(rows)
    drop_written(reduced(reduce(DataFrame.unionAll, rest), 1, 0))
    for parts in read:
        drop_written(parts)
    levels = []
    for level in range(1, order + 1):
        n = tuple(map(int, figures[level][:4]))
        levels.append(Level(n, int(figures[level][4]), int(figures[level][5]), discounts(*n)))
    train_tokens, types = int(figures[1][6]), int(figures[1][7])
    return Model(folder, order, shards, levels, train_tokens, types)


def _score(model: Model):
    def run(batches):
        for batch in batches:
            for part in ta.slices(batch, limit=SCORE_BYTES):
                flat, at, tokens = stream(part.column("text"), model.order)
                p, raw = model.probabilities(flat, at, tokens)
                base = np.log10((raw.astype(float) + 1) / (model.train_tokens + model.types + 1))
                add = lambda x: np.add.reduceat(x, tokens[:-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(np.diff(tokens)), pa.array(add((raw > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(np.log10(p)))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, token counts, base_score, score and perplexity of every row's whole text."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (remainder_of_id(FOLDS) == HELD_OUT).alias("held_out"), text_of().alias("text"))
    found = source.mapInArrow(_score(model), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("bigint").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def score_by_training_fold(docs: DataFrame, order: int = 3) -> DataFrame:
    """Scores every row with a model of the rows whose crc32(doc_id as text) mod 7 is not 2.

    A null text is empty and has one token, its end. Null doc_ids count as remainder 0.
    Repeated rows are counted and scored each. An empty table gives no rows; without
    training rows every token has probability 1 of 1 type. Other columns are not read.
    """
    return score(docs, train(docs.where(remainder_of_id(FOLDS) != HELD_OUT), order))


def op1_kneser_ney(spark, sf_dir: str) -> DataFrame:
    return score_by_training_fold(table(spark, sf_dir, "documents"))
