"""Quality rules as a short-circuit cascade, all in DataFrame expressions.

Each rule is a predicate that rejects a text. A text's words and lines are split once and
shared by all rules. calibrate() measures on a sample, bounded in rows and bytes, what each
rule costs (nanoseconds a character, read off the clock between the rules of one job) and
which texts each rejects, and orders them greedily by rejections per cost among the texts
that the rules before leave. cascade() is one CASE over the ordered rules, which Spark leaves
at the first rule that fires. The order changes the work, never the verdict.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, column_or, drop_written, let, table, text_of, words, written

#: Rows and bytes that costs and selectivities are estimated on, and bytes of the longest text among them.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_TEXT = 400, 4 << 20, 1 << 19
MIN_WORDS, MAX_WORDS = 50, 1_000_000
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Parts:
    """What rules are stated over."""

    text: Column
    words: Column
    lines: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column
    n_repeat_words: Column


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Parts], Column]
    #: True for the fixed minimum, which other parameters cannot switch off.
    base: bool = False


@dataclass(frozen=True)
class Measured:
    """A rule, its cost in nanoseconds a character (a power of two, so that small differences of timing do not count), and of the sample's texts those it was left with and rejected."""

    rule: Rule
    cost: float
    left: int
    rejected: int


def n_symbols(text: Column) -> Column:
    """Characters of `[#*$%&|<>]`."""
    return F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def repeat_words(w: Column) -> Column:
    """Words of the array that lie in a 3-word window found twice or more, the first included; windows are compared by 64-bit hashes."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))

    def again(s: Column) -> Column:
        same = lambda x, k: F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))
        return F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])

    covered = F.aggregate(
        F.array_sort(let(F.array_sort(windows), again)),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n"), (i + 3).alias("end")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(covered).cast("bigint")


def counts(text: Column, w: Column, lines: Column) -> dict[str, Column]:
    """The five base counts: words, code points in words, symbols, lines that equal an earlier one, words in repeated windows."""
    return {
        "n_words": F.size(w).cast("bigint"),
        "word_chars": F.char_length(F.array_join(w, "")).cast("bigint"),
        "n_symbols": n_symbols(text),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_repeat_words": repeat_words(w),
    }


def with_parts(text: Column, body, counted: bool) -> Column:
    """body(Parts of the text), its words and lines split once. counted: all counts are taken beforehand; else each where a rule asks for it."""

    def run(s: Column) -> Column:
        own = counts(text, s["words"], s["lines"])
        if not counted:
            return body(Parts(text, s["words"], s["lines"], **own))
        return let(F.struct(*(c.alias(n) for n, c in own.items())), lambda c: body(Parts(text, s["words"], s["lines"], **{n: c[n] for n in own})))

    return let(F.struct(words(text).alias("words"), lines_with_words(text).alias("lines")), run)


def _more_than(share: tuple[int, int], part: Column, whole: Column) -> Column:
    return part * share[1] > whole * share[0]


def _lines_like(p: Parts, pattern: str) -> Column:
    return F.size(F.filter(p.lines, lambda x: x.rlike(pattern)))


#: The production rules. Thresholds are shares of a text's own words or lines, so texts of any language and length are judged alike.
RULES = (
    Rule("few_words", lambda p: p.n_words < MIN_WORDS, base=True),
    Rule("repeated_words", lambda p: 100 * p.n_repeat_words > MAX_REPEAT_PERCENT * p.n_words, base=True),
    Rule("many_words", lambda p: p.n_words > MAX_WORDS),
    Rule("word_length", lambda p: ~(p.word_chars / F.greatest(p.n_words, F.lit(1))).between(2, 20)),
    Rule("symbols", lambda p: _more_than((1, 4), p.n_symbols, p.n_words)),
    Rule("repeated_lines", lambda p: _more_than((3, 10), p.n_dup_lines, F.size(p.lines))),
    Rule("bullets", lambda p: _more_than((9, 10), _lines_like(p, r"^[\x20\x09]*[-*•]"), F.size(p.lines))),
    Rule("ellipses", lambda p: _more_than((3, 10), _lines_like(p, r"(\.\.\.|…)[\x20\x09\x0D]*$"), F.size(p.lines))),
    Rule("few_letters", lambda p: F.size(F.filter(p.words, lambda x: x.rlike(r"\p{L}"))) * 10 < F.size(p.words) * 7),
)


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> DataFrame:
    """text: the rows of least hash, as many as rows and bytes allow, as a scratch table; only their hashes and sizes pass the driver."""
    own = docs.select(F.xxhash64(column_or(docs, "doc_id", "string"), text_of()).alias("h"), F.octet_length(text_of()).alias("size"), text_of().alias("text")).where(F.col("size") <= SAMPLE_TEXT)
    last, total = None, 0
    for row in own.select("h", "size").orderBy("h", "size").limit(rows).collect():
        total += row["size"]
        if total > size and last is not None:
            break
        last = row.h
    chosen = own.where(F.col("h") <= last) if last is not None else own.where("false")
    return written(chosen.select("h", "text").distinct().coalesce(1), "sample").select("text")


def _clock() -> Column:
    return F.expr("reflect('java.lang.System', 'nanoTime')").cast("bigint")


def calibrate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, counted: bool = False, sample_rows: int = SAMPLE_ROWS) -> list[Measured]:
    """The rules by rejections per cost among the texts that those before leave; ties by cost, then name. An empty table leaves their order."""
    sample = sample_of(docs, sample_rows)

    def timed(p: Parts) -> Column:
        steps = [_clock().alias("t0")]
        for k, rule in enumerate(rules):
            steps += [rule.rejects(p).alias(f"r{k}"), _clock().alias(f"t{k + 1}")]
        return F.struct(*steps)

    runs = sample.select(F.char_length("text").alias("chars"), with_parts(F.col("text"), timed, counted).alias("s"))
    mask = sum((F.when(F.col(f"s.r{k}"), F.lit(1 << k)).otherwise(0) for k in range(1, len(rules))), F.when(F.col("s.r0"), F.lit(1)).otherwise(0))
    sums = runs.groupBy(mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), *(F.sum(F.col(f"s.t{k + 1}") - F.col(f"s.t{k}")).alias(f"ns{k}") for k in range(len(rules))))
    sums.collect()  # compiles and warms
    found = sums.collect()  # a row for each set of rules that reject the same texts
    drop_written(sample)
    chars = max(1, sum(row.chars for row in found))
    cost = [2.0 ** round(math.log2(max(1.0, sum(row[f"ns{k}"] for row in found)) / chars)) for k in range(len(rules))]
    return in_order(rules, cost, {row["mask"]: row.n for row in found})


def in_order(rules: tuple[Rule, ...], cost: list[float], texts: dict[int, int]) -> list[Measured]:
    """rules ordered greedily; texts: how many of the sample each set of rules (as bits) rejects. Half a text more than a rule rejects, so that unlucky ones go by cost."""
    left, rest, out = dict(texts), list(range(len(rules))), []
    while rest:
        rejects = {k: sum(n for mask, n in left.items() if mask >> k & 1) for k in rest}
        best = min(rest, key=lambda k: (-(rejects[k] + 0.5) / cost[k], cost[k], rules[k].name)) if texts else rest[0]
        out.append(Measured(rules[best], cost[best], sum(left.values()), rejects[best]))
        left = {mask: n for mask, n in left.items() if not mask >> best & 1}
        rest.remove(best)
    return out


def cascade(ordered: list[Measured], p: Parts) -> Column:
    """Name of the first rule that rejects, null for texts that pass; later rules are not evaluated."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for m in ordered:
        out = out.when(m.rule.rejects(p), F.lit(m.rule.name))
    return out


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows that no rule rejects, columns unchanged.

    Null, empty and blank texts have no words and go; repeated rows are judged alike; an
    empty table stays empty; columns other than text are carried along whatever their names.
    """
    ordered = calibrate(docs)
    return docs.where(with_parts(text_of(), lambda p: F.struct(cascade(ordered, p).isNull().alias("passed")), False)["passed"])


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every row.

    A null text counts as empty and has no words, symbols or lines. Repeated rows are judged
    alike and each get a row; an empty table gives none; other columns are not read.
    """
    ordered = calibrate(docs, counted=True)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = lambda p: F.struct(*(getattr(p, n).alias(n) for n in names), cascade(ordered, p).isNull().alias("kept"))
    found = docs.select("doc_id", with_parts(text_of(), judged, True).alias("q"))
    failed = (F.col("q.n_words") < MIN_WORDS) | (100 * F.col("q.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("q.n_words"))
    return found.select("doc_id", *(f"q.{n}" for n in names), failed.alias("base_failed"), "q.kept")


def op9_quality_cascade(spark, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, {_WORDS.format("t")} AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
        len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*\x{{2022}}]'))) AS bullets,
        len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09\x0D]*$'))) AS ellipses,
        len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS lettered
      FROM w LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words <= 1000000 AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 20
  AND NOT n_symbols * 4 > n_words AND NOT n_dup_lines * 10 > n_lines * 3 AND NOT bullets * 10 > n_lines * 9
  AND NOT ellipses * 10 > n_lines * 3 AND NOT lettered * 10 < n_words * 7 AS kept
FROM f
"""
