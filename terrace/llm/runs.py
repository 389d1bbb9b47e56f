"""Periodic runs in texts: Lyndon arrays over an ordered alphabet, after Ellert and Fischer.

Words are the letters, compared as they stand: no suffix structure, no hash. Every run has,
under one of the two orders of the alphabet, roots that are longest Lyndon words; so the
pairs (j, next smaller suffix of j) of both orders, extended to both sides, give all runs.
Extensions to the right come with the comparisons of suffixes, which start from what is
known: from the stretch that matched farthest so far, or from the comparison before.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import let, table, text_of, words

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def lyndon_edges(w: list, up: bool):
    """(j, i, k) for each i that is the next smaller suffix of j (up: in the alphabet's order, else in the reverse one) and begins with the same letter; k letters match.

    Ordered by i, and so by j among pairs at one distance. A suffix that ends first is the smaller one in both orders.
    """
    n = len(w)
    smaller_before, smaller_after = [-1] * n, [n] * n
    match_before, match_after = [0] * n, [0] * n  # letters that a suffix shares with these two
    reach = follow = shift = 0  # w[follow:reach] equals the letters `shift` places before it; no match found goes farther
    for i in range(1, n):
        c, j, k, last = w[i], i - 1, 0, -1
        while j >= 0:
            a = w[j]
            if a != c:
                k = 0
                greater = (a > c) is up
            else:
                exact, k, before = False, 1, k
                if i < reach and j >= follow:
                    x, y = j - shift, i - shift
                    if smaller_after[x] == y:
                        k = match_after[x]
                    elif smaller_before[y] == x:
                        k = match_before[y]
                    exact = 1 < k and i + k < reach
                    k = min(k, reach - i)
                if not exact and last >= 0:  # j and `last` share m letters, `last` and i share `before`
                    m = match_before[last]
                    exact = m != before
                    k = min(m, before) if exact else max(k, m)
                if not exact:
                    while i + k < n and w[j + k] == w[i + k]:
                        k += 1
                    if i + k > reach:
                        reach, follow, shift = i + k, i, i - j
                greater = i + k == n or (w[j + k] > w[i + k]) is up
            if not greater:
                break
            smaller_after[j] = i
            if k:
                match_after[j] = k
                yield j, i, k
            last, j = j, smaller_before[j]
        smaller_before[i] = j
        if j >= 0:
            match_before[i] = k


def runs_of(w: list, min_length: int = 2, min_exponent: float = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of that length and that many periods (2 at least), by start, then period.

    The leftmost root of a run has less than a period of the run before it, so more than
    min_exponent - 2 periods match after it, and no root needs to be extended farther back.
    """
    found, ends = set(), {}
    for up in (True, False):
        ends.clear()
        for j, i, k in lyndon_edges(w, up):
            p = i - j
            if k <= (min_exponent - 2) * p or ends.get(p, 0) > i:  # too short, or in the run of this period found last
                continue
            back = 0
            while back < p and back < j and w[j - back - 1] == w[i - back - 1]:
                back += 1
            if back < p and back + p + k >= max(min_length, min_exponent * p):
                found.add((j - back, back + p + k, p))
                ends[p] = i + k
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    out, at = [], 0
    for a, b in sorted((s + p, s + n) for s, n, p in runs):
        out += w[at:a]
        at = max(at, b)
    return out + w[at:]


def _found(min_length: int, min_exponent: float):
    def run(batches):
        for batch in batches:
            for part in ta.slices(batch):
                sizes, runs, texts = [], [], []
                for text in part.column("text").to_pylist():
                    w = (text or "").encode().split()
                    mine = runs_of(w, min_length, min_exponent)
                    sizes.append(len(w))
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in mine])
                    texts.append(b" ".join(collapsed(w, mine) if mine else w))
                kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
                columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: float = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed: every run in the words of each whole text.

    A run is a stretch with smallest period p, of max(min_length, min_exponent * p) words at
    least, that no neighbouring word extends; collapsed is the words, joined by one blank,
    without those that a run contains after its first p. Null, empty and blank texts have no
    words and no runs; repeated rows each get a row, null doc_ids too; an empty table gives
    none; columns other than doc_id and text are not read. A text takes some 15 times its
    bytes while it is worked on.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return source.mapInArrow(_found(min_length, min_exponent), f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: for a tenth of the ids, by crc32, the words from some place on repeat those at that place. Null ids keep their text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.concat(F.slice(w, 1, a), F.transform(F.sequence(a, n - 1), lambda i: F.get(w, a + (i - a) % p))), " ")

    texts = let(words(text_of()), lambda w: F.when(F.size(w) > 0, repeated(w)))
    return docs.select("doc_id", F.when(h % 10 == 0, texts).otherwise(text_of()).alias("text"))


def op12_lyndon_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")), min_length=6, min_exponent=4)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return (
        found.withColumn("best", longest)
        .withColumn("lines", F.concat_ws("", F.transform("runs", line)))
        .select(
            "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
            F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )
