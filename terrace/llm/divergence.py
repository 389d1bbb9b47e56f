"""Source divergence audit: how far sources of a language differ in their words.

A merged count-min sketch of document frequencies, which never underestimates, tells terms
that cannot be in enough documents; they leave before anything is shuffled. What stays is
counted exactly, and sources meet term by term: terms that a source lacks have one known
share, so only terms that both have need a joined row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import drop_written, table, text_of, written
from .sketch import FULL, Sketch, cell_bits, count_sketch

#: All but letters and bytes of characters beyond ASCII.
NOT_TERM = ~np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_NEVER = np.zeros(256, bool)
#: Bytes of text that a task counts at once; bytes of text for a cell of the sketch; most bits of a cell's number (two rows of 64 MB).
COUNT_BYTES, CELL_BYTES, CELL_BITS = 12 << 20, 128, 26
UNIT = 1_000_000_000


def term_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of every term of the texts, and the terms that the codes stand for."""
    data, offsets = ta.raw(column)
    starts, ends, rows = ta.spans(data, offsets, NOT_TERM)
    letters = ta._FOLD[data][~NOT_TERM[data]] if len(data) else data
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(letters))]).dictionary_encode()
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows)), found.indices.to_numpy().astype(np.int64), found.dictionary


def _hashes(lang: pa.Array, terms: pa.Array) -> np.ndarray:
    """Of each (language, term)."""
    of = lambda x: ta.word_hashes(x.cast(pa.large_string()), _NEVER)
    found, rows = of(lang)
    known = np.zeros(len(lang), np.uint64)
    known[np.diff(rows) > 0] = found  # an empty name has no word
    return ta.mix(ta.mix(known) + of(terms)[0])


class _Counted:
    """Term counts of a slice of documents, by some number of its rows."""

    def __init__(self, part: pa.RecordBatch):
        row, code, self.terms = term_codes(part.column("text"))
        self.size = max(1, len(self.terms))
        self.seen, self.times = np.unique(row * self.size + code, return_counts=True)

    def by(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Group, code, occurrences and documents of each (group of rows, term) that occurs."""
        key = group[self.seen // self.size] * self.size + self.seen % self.size
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        times = np.add.reduceat(self.times[order], first) if len(key) else self.times
        return key[first] // self.size, key[first] % self.size, times, np.diff(np.append(first, len(key)))


def _coded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = column.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def _frequencies(batch: pa.RecordBatch):
    """Hashes of (language, term) and the documents that have them."""
    for part in ta.slices(batch, limit=COUNT_BYTES):
        lang, langs = _coded(part.column("lang"))
        counted = _Counted(part)
        group, code, _, docs = counted.by(lang)
        if len(group):
            yield _hashes(langs.take(pa.array(group)), counted.terms.take(pa.array(code))), docs


def _surviving(sketch: Sketch, least: int):
    """A row for each (language, source, term) of a slice of documents if the term may be in `least` documents, and one without a term for each (language, source)."""

    def run(batches):
        for batch in batches:
            for part in ta.slices(batch, limit=COUNT_BYTES):
                (lang, langs), (source, sources) = _coded(part.column("lang")), _coded(part.column("source"))
                group, inverse = np.unique(lang * len(sources) + source, return_inverse=True)
                counted = _Counted(part)
                at, code, times, docs = counted.by(inverse)
                if len(at):
                    of = group // len(sources)
                    pair, back = np.unique(of[at] * counted.size + code, return_inverse=True)
                    known = _hashes(langs.take(pa.array(pair // counted.size)), counted.terms.take(pa.array(pair % counted.size)))
                    may = (sketch.estimates(known) >= min(least, FULL))[back]
                    at, code, times, docs = at[may], code[may], times[may], docs[may]
                everywhere = np.concatenate([group[at], group])
                terms = pa.concat_arrays([counted.terms.take(pa.array(code)).cast(pa.string()), pa.nulls(len(group), pa.string())])
                none = np.zeros(len(group), np.int64)
                columns = [langs.take(pa.array(everywhere // len(sources))), sources.take(pa.array(everywhere % len(sources))), terms, pa.array(np.concatenate([times, none])), pa.array(np.concatenate([docs, none]))]
                yield pa.RecordBatch.from_arrays([pc.cast(x, pa.string()) for x in columns[:3]] + columns[3:], ["lang", "source", "term", "n", "docs"])

    return run


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)), exact up to 10^19 terms; null where no term is kept."""
    wide = lambda x: x.cast("decimal(19,0)")
    over = wide(F.greatest(total + 2 * kept, F.lit(1)))
    return F.when(kept > 0, 1 + F.call_function("div", wide(n + 2) * F.lit(UNIT).cast("decimal(10,0)"), over))


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source's term shares are from those of each other source of its language, and its `top` terms over the language's share.

    Terms are runs of letters, A-Z lower-cased, in at least `least` documents of the language;
    a repeated row counts as a document again. Shares are whole billionths with two added to
    each count; a gap is floor((p - q)^2 / (p + q)). Part `pair`: the sum of gaps over all
    kept terms; part `term`: the gap to the language where the source's share is larger. Ties
    go by name. Null text, lang and source are empty ones; a source without kept terms has the
    even share for each; a language without kept terms has gaps of 0; an empty table gives no
    rows; further columns are not read.
    """
    name = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    docs = docs.select(text_of().alias("text"), name("lang"), name("source"))
    sketch = count_sketch(docs, _frequencies, cell_bits(docs, CELL_BYTES, CELL_BITS))
    found = docs.mapInArrow(_surviving(sketch, least), "lang string, source string, term string, n bigint, docs bigint")
    counts = written(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("everywhere"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    posts = written(counts.where("term is not null").drop("docs").join(kept, ["lang", "term"]), "posts")

    own = posts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = posts.groupBy("lang", "term").agg(F.first("everywhere").alias("n")).groupBy("lang").agg(F.count("n").alias("kept"), F.sum("n").alias("all"))
    groups = counts.where("term is null").select("lang", "source").join(own, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["total", "kept", "all"])
    groups = groups.withColumn("id", F.monotonically_increasing_id()).withColumn("none", _share(F.lit(0).cast("bigint"), F.col("total"), F.col("kept")))
    groups = written(groups, "groups")
    drop_written(counts)

    shares = posts.join(groups, ["lang", "source"]).select(
        "id", "lang", "source", "term", "none", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), _share(F.col("everywhere"), F.col("all"), F.col("kept")).alias("q")
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    above = above.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    # The sum over all terms is that of two sources without terms, corrected for each one's terms, and for those of both.
    a, b = F.col("a_p"), F.col("b_p")
    a0, b0 = F.col("a_none"), F.col("b_none")
    side = lambda x: shares.select("lang", "term", F.col("id").alias(x), F.col("p").alias(f"{x}_p"), F.col("none").alias(f"{x}_none"))
    both = side("a").join(side("b"), ["lang", "term"]).where("a < b")
    both = both.groupBy("a", "b").agg(F.sum(_gap(a, b) - _gap(a, b0) - _gap(a0, b) + _gap(a0, b0)).alias("v"))
    held = shares.groupBy("lang", F.col("id").alias("a"), F.col("p").alias("a_p"), F.col("none").alias("a_none")).agg(F.count("p").alias("times"))
    other = groups.select("lang", F.col("id").alias("b"), F.col("none").alias("b_none"))
    one = held.join(other, "lang").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("times") * (_gap(a, b0) - _gap(a0, b0))).alias("v"))
    swapped = lambda df: df.select(F.col("b").alias("a"), F.col("a").alias("b"), "v")
    parts = both.unionAll(swapped(both)).unionAll(one).unionAll(swapped(one)).groupBy("a", "b").agg(F.sum("v").alias("v"))
    pairs = groups.select("lang", "source", "kept", F.col("id").alias("a"), F.col("none").alias("a_none")).join(groups.select("lang", F.col("source").alias("item"), F.col("id").alias("b"), F.col("none").alias("b_none")), "lang").where("a <> b")
    value = F.coalesce(F.col("kept") * _gap(a0, b0), F.lit(0)) + F.coalesce("v", F.lit(0))
    pairs = pairs.join(parts, ["a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(above)


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"), least=10, top=10)


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS everywhere FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, sum(n) AS n FROM m GROUP BY ALL),
x AS (
  SELECT m.lang, m.source, m.term, m.n, 1 + (1000000000::HUGEINT * (m.n + 2)) // (s.n + 2 * l.v) AS p, 1 + (1000000000::HUGEINT * (m.everywhere + 2)) // (l.n + 2 * l.v) AS q
  FROM m JOIN s USING (lang, source) JOIN l USING (lang)),
both_ AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN both_ o ON o.lang = a.lang AND o.source = a.source AND o.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM x WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 10
"""
