"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). A total of tokens is shared out from the root: each
node's budget goes to its children by weight, none above the tokens it can supply (its
documents, read up to `epochs` times). What a full child leaves over goes to its siblings
by weight; only what all of them cannot take is missing at their parent, whose siblings were
offered it a level above, since a node's own limit is the sum of its children's. Shares are
rounded so that they add up to what is shared. Each leaf then takes its budget as whole
epochs plus a prefix of one more, in the order of a seeded hash of (seed, epoch, doc_id);
the document that the prefix ends in is taken if at least half of it lies within, so a leaf
misses its budget by half a document at most, and leaves' errors cancel rather than add up.
All sums are integers, so the result does not depend on the partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import collect_shuffles, column_or, fresh, table, text_of, words, written

LEVELS = ("domain", "lang", "source")
SEED, EPOCHS = 17, 4
#: The total asked for, in percent of the tokens there are.
TOTAL_PERCENT = 60
#: Weights by level and name; names that are not listed weigh DEFAULT_WEIGHT.
WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2}, "lang": {"en": 6, "de": 2, "fr": 2}, "source": {"src0": 2}}
DEFAULT_WEIGHT = 1
#: Documents that one window of a boundary bucket holds on average, at most.
BUCKET_ROWS = 4096


def domain_of(source: Column) -> Column:
    """The production tree's top level: d0 to d3, by the number at the source's end; d3 where there is none."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", "d3").otherwise(F.concat(F.lit("d"), (number.cast("bigint") % 4).cast("string")))


def weight_of(level: str, name: Column, weights: dict[str, int]) -> Column:
    listed = F.create_map(*(x for k, w in weights.items() for x in (F.lit(k), F.lit(w)))) if weights else None
    return F.lit(DEFAULT_WEIGHT).cast("bigint") if listed is None else F.coalesce(F.try_element_at(listed, name), F.lit(DEFAULT_WEIGHT)).cast("bigint")


def share_out(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds `budget`: the parent's `given` shared among its children by `weight`, none above its `supply`.

    Ordered by supply per weight, a child is full if its share of what is left by the fuller
    ones before it exceeds its supply; the others share the rest by weight, each the
    difference of two rounded sums, so that nothing of it is lost.
    """
    every = Window.partitionBy(*parent)
    before = every.orderBy(F.col("supply") / F.col("weight"), *LEVELS[: len(parent) + 1]).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("given") - F.coalesce(F.sum("supply").over(before), F.lit(0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = children.withColumns({"left": left, "heavy": heavy}).withColumn("full", F.col("supply") * F.col("heavy") <= F.col("left") * F.col("weight"))
    open_left = F.sum(F.when(F.col("full"), F.col("supply")).otherwise(0)).over(every)
    open_weight = F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("weight"))).over(every)
    weighed = F.coalesce(F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("weight"))).over(before), F.lit(0))
    upto = lambda sum_of: f"((given - open_left) * ({sum_of})) div greatest(open_weight, 1)"
    share = F.expr(f"{upto('weighed + weight')} - {upto('weighed')}")
    shared = ranked.withColumns({"open_left": open_left, "open_weight": open_weight, "weighed": weighed}).withColumn("budget", F.when(F.col("full"), F.col("supply")).otherwise(share))
    return shared.drop("left", "heavy", "full", "open_left", "open_weight", "weighed")


def leaf_budgets(leaves: DataFrame, total_percent: int, weights: dict[str, dict[str, int]], epochs: int) -> DataFrame:
    """domain, lang, source, tokens, n_docs, budget. leaves: one row each, with tokens and n_docs."""
    if any(w <= 0 for names in weights.values() for w in names.values()):
        raise ValueError("weights must be positive; filter out what is not wanted")
    supply = leaves.withColumn("supply", F.col("tokens") * epochs)
    tokens = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    given = min(tokens * int(total_percent) // 100, tokens * epochs)
    for depth, level in enumerate(LEVELS):
        parent = list(LEVELS[:depth])
        nodes = supply.groupBy(*LEVELS[: depth + 1]).agg(F.sum("supply").alias("supply")).withColumn("weight", weight_of(level, F.col(level), weights.get(level, {})))
        nodes = nodes.join(given, parent) if parent else nodes.withColumn("given", F.lit(given).cast("bigint"))
        given = share_out(nodes, parent).select(*LEVELS[: depth + 1], F.col("budget").alias("given"))
    return leaves.join(given, list(LEVELS)).withColumnRenamed("given", "budget")


def place_in_epoch(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Hex digits that order a leaf's documents in an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def epochs_taken(docs: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """Adds `copies`, how often each document is taken, and its leaf's `budget`. docs: doc_id, the levels, n_tokens.

    A leaf's documents fall into buckets by the first digits of their hash; a bucket's sums
    show whether it lies within the prefix, beyond it, or across its end. Rows are only
    ordered within the one bucket of each leaf that the end falls into, so a leaf of a third
    of all rows is never sorted in one task.
    """
    leaves = leaves.withColumns({"whole": F.expr("budget div greatest(tokens, 1)"), "rest": F.col("budget") % F.greatest("tokens", F.lit(1))})
    digits = F.ceil(F.log(16.0, F.greatest(F.col("n_docs") / BUCKET_ROWS, F.lit(1.0)))).cast("int")
    rows = docs.join(leaves.select(*LEVELS, "budget", "whole", "rest", digits.alias("digits")), list(LEVELS))
    rows = rows.withColumn("place", place_in_epoch(seed, F.col("whole"), F.col("doc_id"))).withColumn("bucket", F.substring(F.col("place"), F.lit(1), F.col("digits")))
    key = [*LEVELS, "bucket"]
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = written(rows.groupBy(*key, "rest").agg(F.sum("n_tokens").alias("tokens")), "buckets").withColumn("before", before)
    buckets = buckets.withColumn("state", F.when(F.col("before") + F.col("tokens") <= F.col("rest"), 1).when(F.col("before") > F.col("rest"), 0).otherwise(2))
    rows = rows.drop("rest").join(buckets.select(*key, "rest", "before", "state"), key)
    upto = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*key).orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    edge = rows.where("state = 2").withColumn("extra", (2 * upto - F.col("n_tokens") <= 2 * F.col("rest")).cast("bigint"))
    sure = rows.where("state <> 2").withColumn("extra", F.col("state").cast("bigint"))
    both = reduce(DataFrame.unionByName, (sure, edge))
    return both.withColumn("copies", F.col("whole") + F.col("extra"))


def _taken(docs: DataFrame, weights: dict[str, dict[str, int]], total_percent: int, epochs: int, seed: int, domain) -> DataFrame:
    own = lambda name: F.coalesce(column_or(docs, name, "string"), F.lit(""))
    rows = docs.select("doc_id", domain(own("source")).alias("domain"), own("lang").alias("lang"), own("source").alias("source"), F.size(words(text_of())).cast("bigint").alias("n_tokens"), F.xxhash64(text_of()).alias("print"))
    rows = written(rows, "tokens")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    budgets = written(leaf_budgets(written(leaves, "leaves"), total_percent, weights, epochs), "budgets")
    collect_shuffles(docs.sparkSession)
    return epochs_taken(rows, budgets, seed)


def mixture(docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, total_percent: int = TOTAL_PERCENT, epochs: int = EPOCHS, seed: int = SEED, domain=domain_of) -> DataFrame:
    """Every row's doc_id, domain, lang, source, n_tokens (words), copies (0: not taken) and leaf_budget.

    Null texts have 0 tokens; they and empty texts are taken with any prefix that reaches
    them. Null languages, sources and ids count as "". Ties of the order go by doc_id, then
    tokens; repeated rows each count. An empty table gives none. Other columns are not read.
    """
    found = _taken(docs, weights, total_percent, epochs, seed, domain)
    return found.select("doc_id", *LEVELS, "n_tokens", "copies", F.col("budget").alias("leaf_budget"))


def allocation(mixed: DataFrame) -> DataFrame:
    """level (0: all, 3: leaf), domain, lang, source, tokens, budget, taken of every node of the tree, from mixture()'s rows: what was asked of it and what it gave."""
    leaves = mixed.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.max("leaf_budget").alias("budget"), F.sum(F.col("n_tokens") * F.col("copies")).alias("taken"))
    level = sum((1 - F.grouping(x)).cast("int") for x in LEVELS)
    return leaves.rollup(*LEVELS).agg(level.alias("level"), *(F.sum(x).alias(x) for x in ("tokens", "budget", "taken"))).select("level", *LEVELS, "tokens", "budget", "taken")


def mix_documents(docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, total_percent: int = TOTAL_PERCENT, epochs: int = EPOCHS, seed: int = SEED, domain=domain_of) -> DataFrame:
    """The documents taken, one row for each epoch, with `domain` and `epoch` (from 0), which take the place of columns of these names.

    Rows alike in doc_id, language, source and text are taken together as often as mixture()
    takes them: each the same number of times, and as many of them once more as are left, by
    their place in the table. Nulls, empty texts and empty tables as in mixture(); columns
    keep their order and values, whatever their other names.
    """
    names = fresh(docs, "own_lang", "own_source", "own_print", "of_id", "of_lang", "of_source", "of_print", "of_domain", "each", "more", "at", "part", "before", "round")
    own_lang, own_source, own_print, of_id, of_lang, of_source, of_print, of_domain, each, more, at, part, before, turn = names
    alike = [of_id, of_lang, of_source, of_print]
    taken = _taken(docs, weights, total_percent, epochs, seed, domain)
    groups = taken.groupBy(F.col("doc_id").alias(of_id), F.col("lang").alias(of_lang), F.col("source").alias(of_source), F.col("print").alias(of_print))
    groups = groups.agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("n_rows"), F.first("domain").alias(of_domain)).where("total > 0")
    groups = written(groups.select(*alike, of_domain, F.expr("total div n_rows").alias(each), F.expr("total % n_rows").alias(more)), "groups")
    rows = docs.withColumns({own_lang: F.coalesce(column_or(docs, "lang", "string"), F.lit("")), own_source: F.coalesce(column_or(docs, "source", "string"), F.lit("")), own_print: F.xxhash64(text_of())})
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(own_print) == F.col(of_print)) & (F.col(own_lang) == F.col(of_lang)) & (F.col(own_source) == F.col(of_source))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("domain", "epoch")]
    result = lambda found, copies: found.withColumn(turn, F.explode(F.sequence(F.lit(0), copies.cast("int") - 1))).select(*kept, F.col(of_domain).alias("domain"), F.col(turn).alias("epoch"))
    alike_taken = result(rows.join(groups.where(F.col(more) == 0), same), F.col(each))
    uneven = groups.where(F.col(more) > 0)
    if uneven.isEmpty():
        return alike_taken
    # rows of one group are numbered task by task, so that a group of any size is never in one place
    found = rows.join(uneven, same).withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33))
    found = written(found, "uneven")
    parts = found.groupBy(*alike, part).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*alike).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*alike, part]
    theirs = fresh(found, *(f"{c}_p" for c in keys))
    parts = parts.select(*(F.col(c).alias(p) for c, p in zip(keys, theirs, strict=True)), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias(before))
    there = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(p)) for c, p in zip(keys, theirs, strict=True)))
    nth = F.col(before) + F.row_number().over(Window.partitionBy(*alike, part).orderBy(at))
    numbered = found.join(parts, there).withColumn(each, F.col(each) + (nth <= F.col(more)).cast("bigint"))
    return alike_taken.unionAll(result(numbered.where(F.col(each) > 0), F.col(each)))


def op3_hierarchical_mixing(spark, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def _case(name: str) -> str:
    return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {w}" for k, w in WEIGHTS[name].items()) + f" ELSE {DEFAULT_WEIGHT} END"


def _level_sql(depth: int) -> str:
    keys = ", ".join(LEVELS[: depth + 1])
    part = f"PARTITION BY {', '.join(LEVELS[:depth])}" if depth else ""
    up = f"JOIN g{depth - 1} USING ({', '.join(LEVELS[:depth])})" if depth else "CROSS JOIN g"
    return f"""
n{depth} AS (SELECT * FROM (SELECT {keys}, sum(supply)::BIGINT AS supply, ({_case(LEVELS[depth])})::BIGINT AS weight FROM s GROUP BY {keys}) {up}),
r{depth} AS (SELECT *, given - coalesce(sum(supply) OVER b, 0) AS lft, sum(weight) OVER ({part}) - coalesce(sum(weight) OVER b, 0) AS heavy
  FROM n{depth} WINDOW b AS ({part} ORDER BY supply / weight, {keys} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f{depth} AS (SELECT *, supply * heavy <= lft * weight AS isfull FROM r{depth}),
o{depth} AS (SELECT *, given - sum(CASE WHEN isfull THEN supply ELSE 0 END) OVER ({part}) AS lent, greatest(sum(CASE WHEN isfull THEN 0 ELSE weight END) OVER ({part}), 1) AS heft,
  sum(CASE WHEN isfull THEN 0 ELSE weight END) OVER ({part} ORDER BY supply / weight, {keys} ROWS UNBOUNDED PRECEDING) AS upto FROM f{depth}),
g{depth} AS (SELECT {keys}, CASE WHEN isfull THEN supply ELSE (lent * upto) // heft - (lent * (upto - weight)) // heft END::BIGINT AS given FROM o{depth})"""


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, 'd' || coalesce(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '')::BIGINT % 4, 3) AS domain, coalesce(lang, '') AS lang,
  coalesce(source, '') AS source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents),
l AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
s AS (SELECT *, tokens * {EPOCHS} AS supply FROM l),
g AS (SELECT least((sum(tokens) * {TOTAL_PERCENT}) // 100, sum(supply)) AS given FROM s),{",".join(_level_sql(k) for k in range(3))},
b AS (SELECT l.*, g2.given AS leaf_budget, g2.given // greatest(tokens, 1) AS whole, g2.given % greatest(tokens, 1) AS rest FROM l JOIN g2 USING (domain, lang, source)),
o AS (SELECT d.*, leaf_budget, whole, rest, md5('{SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) AS place FROM d JOIN b USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, leaf_budget, (whole + (2 * sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id, n_tokens
  ROWS UNBOUNDED PRECEDING) - n_tokens <= 2 * rest)::BIGINT)::BIGINT AS copies FROM o
"""
