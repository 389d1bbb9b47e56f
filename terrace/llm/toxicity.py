"""Toxicity by weak supervision.

Many weak voters mark a text: words of a lexicon, and word beginnings mined from labelled
training rows and, once more, from all training rows, those without a label with the one that the
first voters give them. A generative label model of two classes explains the votes: voters
hang together in a tree, each firing by the class and by whether its parent in the tree
fires, so that voters that repeat each other count once. Tree and rates are estimated by EM
over the votes of all training rows, with the given labels clamped. A linear classifier of
the text's features is trained, by Newton steps whose sums Spark takes over all training
rows, on the label model's posteriors, and scores every text. A given label is one more
voter of its row. All learning keeps to the training fold.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import drop_written, remainder_of_id, table, text_of, written

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Insults that vote as whole words.
LEXICON = (
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "scum", "trash", "pathetic", "worthless",
    "disgusting", "clown", "clowns", "imbecile", "retard", "jerk", "bastard", "bitch", "asshole", "shithead", "dickhead",
    "freak", "vermin", "parasite", "filth", "garbage", "useless", "lowlife",
)
#: Mined voters: letters of a word's beginning, votes for this many words, rows with label 1 that show it, deviations above chance.
PREFIX_LETTERS, PREFIX_COUNT, PREFIX_ROWS, PREFIX_DEVIATIONS, PREFIXES = (3, 4, 5, 6, 7), 2, 2, 3.0, 12
#: Rounds of EM over all training rows, and what all unlabelled rows weigh against the labelled ones.
PASSES, UNLABELLED_WEIGHT = 3, 0.2
#: Log odds that a row's given label adds to its posterior.
LABEL_LOG_ODDS = 4.0
#: Strength of the rates' prior, in rows; Newton steps of the classifier and its ridge.
PRIOR_ROWS, STEPS, RIDGE = 5.0, 12, 1.0
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Voters:
    words: tuple[str, ...]
    prefixes: tuple[str, ...]

    @property
    def least(self) -> np.ndarray:
        """Occurrences from which each voter votes."""
        return np.array([1] * len(self.words) + [PREFIX_COUNT] * len(self.prefixes))

    def automaton(self):
        out = ahocorasick.Automaton()
        ids: dict[str, list[tuple[int, bool]]] = {}
        for k, x in enumerate(self.words + self.prefixes):
            ids.setdefault(x, []).append((k, k < len(self.words)))
        for x, found in ids.items():
            out.add_word(x, (len(x), found))
        out.make_automaton()
        return out


def occurrences(text: str, automaton, n: int) -> list[int]:
    """Of each voter's word or word beginning, up to 255; letters stand apart from digits and marks."""
    out = [0] * n
    for end, (length, found) in automaton.iter(text):
        start = end - length + 1
        if start and text[start - 1].isalpha():
            continue
        inside = end + 1 < len(text) and text[end + 1].isalpha()
        for k, whole in found:
            if not (whole and inside):
                out[k] = min(255, out[k] + 1)
    return out


def _counts(voters: Voters, keep: list[str]):
    def run(batches):
        automaton, n = voters.automaton(), len(voters.words) + len(voters.prefixes)
        for batch in batches:
            for part in ta.slices(batch):
                rows, size = [], []
                for text in part.column("text").to_pylist():
                    text = (text or "").lower()
                    rows.append(bytes(occurrences(text, automaton, n)))
                    size.append(len(text.split()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(rows, pa.binary()), pa.array(size, pa.int64())], [*keep, "counts", "n_words"])

    return run


def counted(docs: DataFrame, voters: Voters, keep: str) -> DataFrame:
    """The kept columns (a schema string), counts (a byte for each voter) and n_words of whole texts."""
    return docs.mapInArrow(_counts(voters, [x.split()[0] for x in keep.split(", ")]), f"{keep}, counts binary, n_words bigint")


# --- voters mined from labelled rows ----------------------------------------------


def _shown(batches):
    automaton = Voters(LEXICON, ()).automaton()
    for batch in batches:
        for part in ta.slices(batch):
            insults, shown = [], []
            for text in part.column("text").to_pylist():
                text = (text or "").lower()
                insults.append(bytes(occurrences(text, automaton, len(LEXICON))))
                own = Counter(w[:k] for w, n in Counter(_WORD.findall(text)).items() for k in PREFIX_LETTERS if len(w) >= k for _ in range(min(n, PREFIX_COUNT)))
                shown.append([x for x, n in own.items() if n >= PREFIX_COUNT])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(insults, pa.binary()), pa.array(shown, pa.list_(pa.string()))], ["doc_id", "insults", "shown"])


def beginnings(docs: DataFrame) -> DataFrame:
    """doc_id, insults (a byte for each word of the lexicon) and shown, the word beginnings that may vote, of whole texts: under half their bytes, so these move in their stead."""
    return docs.select("doc_id", "text").mapInArrow(_shown, "doc_id bigint, insults binary, shown array<string>")


def mine(labelled: DataFrame) -> Voters:
    """The lexicon, and the word beginnings that mark label 1 in the labelled rows (shown, toxic), which are read once; of beginnings of one another the one that marks more surely."""
    each = labelled.select("toxic", F.explode(F.array_append("shown", F.lit(""))).alias("prefix"))  # the empty one counts the rows
    counts = written(each.groupBy("prefix").agg(F.sum("toxic").cast("bigint").alias("a"), F.sum(1 - F.col("toxic")).cast("bigint").alias("b")), "beginnings")
    size = counts.where("prefix = ''").first()
    ones, zeros = (size.a, size.b) if size else (0, 0)
    if not ones or not zeros:
        drop_written(counts)
        return Voters(LEXICON, ())
    a, b, n = F.col("a"), F.col("b"), float(ones + zeros)
    deviations = (a / ones - b / zeros) / F.sqrt((a + b + 1) / n * (1 / ones + 1 / zeros))
    best = counts.where((F.col("prefix") != "") & (a >= PREFIX_ROWS) & (a / ones > 3 * b / zeros)).withColumn("z", F.round(deviations, 6)).where(F.col("z") > PREFIX_DEVIATIONS)
    chosen: list[str] = []
    for row in best.orderBy(F.desc("z"), F.length("prefix"), "prefix").limit(20 * PREFIXES).collect():
        nested = any(row.prefix.startswith(x) or x.startswith(row.prefix) for x in chosen)
        if not nested and not any(row.prefix == x[: len(row.prefix)] for x in LEXICON):
            chosen.append(row.prefix)
        if len(chosen) == PREFIXES:
            break
    drop_written(counts)
    return Voters(LEXICON, tuple(chosen))


# --- label model -------------------------------------------------------------------


@dataclass
class LabelModel:
    """prior of label 1; for each voter its parent in the tree (itself: none), and the rates (2 classes, parent silent or firing, voters) at which it fires."""

    prior: float
    parent: np.ndarray
    rates: np.ndarray

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        above = votes[:, self.parent] * (self.parent != np.arange(len(self.parent)))
        of = lambda y: self.rates[y, 0] + above * (self.rates[y, 1] - self.rates[y, 0])
        fire, rest = np.log(of(1) / of(0)), np.log((1 - of(1)) / (1 - of(0)))
        return np.log(self.prior / (1 - self.prior)) + (votes * fire + (1 - votes) * rest).sum(axis=1)

    def posterior(self, votes: np.ndarray, gold: np.ndarray | None = None) -> np.ndarray:
        """gold: 0, 1, or -1 where no label is given."""
        given = 0 if gold is None else LABEL_LOG_ODDS * np.where(gold < 0, 0, 2 * gold - 1)
        return sigmoid(self.log_odds(votes) + given)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def counts_of(batch, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.uint8).reshape(batch.num_rows, n)


def moments(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For each class: rows, firings of each voter and of each pair of voters, weighted by the row's share of that class."""
    out = []
    for share in (1 - p, p):
        out += [[share.sum()], share @ votes, ((votes * share[:, None]).T @ votes).reshape(-1)]
    return np.concatenate(out)


def information(total: np.ndarray, fired: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Mutual information of every pair of voters given the class, from the classes' moments."""
    out, rows = np.zeros(both.shape[1:]), max(total.sum(), 1e-9)
    for n, f, b in zip(total, fired, both, strict=True):
        n = max(float(n), 1e-9)
        for x, px in ((b, f), (f[:, None] - b, f)):
            for flip in (False, True):
                joint = x if not flip else (f[None, :] - b if x is b else n - f[:, None] - f[None, :] + b)
                one = px if not flip else n - px
                other = f if x is b else n - f
                expected = np.maximum(one[:, None] * other[None, :] / n, 1e-9)
                out += np.where(joint > 1e-9, joint * np.log(np.maximum(joint, 1e-9) / expected), 0) / rows
    return out


def tree(weight: np.ndarray) -> np.ndarray:
    """Parents of the tree of greatest weight in all, its root its own parent."""
    n = len(weight)
    parent, best, inside = np.zeros(n, np.int64), np.full(n, -np.inf), np.zeros(n, bool)
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        closer = ~inside & (weight[at] > best)
        best[closer], parent[closer] = weight[at][closer], at
        at = int(np.argmax(np.where(inside, -np.inf, best)))
    return parent


def fitted(sums: np.ndarray, n: int) -> LabelModel:
    """The model whose moments these are; rates are drawn to the voter's own rate in its class, and that to a low one, by PRIOR_ROWS rows."""
    parts = sums.reshape(2, 1 + n + n * n)
    total, fired, both = parts[:, 0], parts[:, 1 : 1 + n], parts[:, 1 + n :].reshape(2, n, n)
    own = np.stack([(fired[0] + 0.05) / (total[0] + 5.0), (fired[1] + 0.5) / (total[1] + 2.0)])
    parent = tree(information(total, fired, both)) if n else np.zeros(0, np.int64)
    child = np.arange(n)
    with_parent, of_parent = both[:, child, parent], fired[:, parent]
    given = np.stack([fired - with_parent, with_parent], axis=1)
    cases = np.stack([total[:, None] - of_parent, of_parent], axis=1)
    rates = (given + PRIOR_ROWS * own[:, None, :]) / (cases + PRIOR_ROWS)
    alone = parent == child
    rates[:, :, alone] = own[:, None, alone]
    prior = float(np.clip(total[1] / max(total.sum(), 1e-9), 0.001, 0.5))
    return LabelModel(prior, parent, np.clip(rates, 1e-5, 0.999))


def summed(rows: DataFrame, run, size: int) -> np.ndarray:
    """The sum of the arrays of that size that run(batches) makes, one of each task."""
    found = rows.mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(size)
    out[found["at"].to_numpy(np.int64)] = found["value"]
    return out


def _sums(of_batch, size: int):
    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of_batch(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "value"])

    return run


def fit_label_model(rows: DataFrame, least: np.ndarray) -> LabelModel:
    """rows: counts and gold (-1: none) of all training rows, whose moments are summed by Spark."""
    n = len(least)
    size = 2 * (1 + n + n * n)

    def expected(model: LabelModel | None):
        def of_batch(batch):
            votes, gold = (counts_of(batch, n) >= least).astype(float), batch.column("gold").to_numpy()
            mine = (gold >= 0) if model is None else (gold < 0)
            return moments(votes[mine], gold[mine].astype(float) if model is None else model.posterior(votes[mine]))

        return _sums(of_batch, size)

    known = summed(rows.select("counts", "gold"), expected(None), size)
    if known.reshape(2, -1)[:, 0].min() == 0:  # no labels of both kinds: voters that seldom err
        known = np.concatenate([[900.0], np.full(n, 2.0), np.diag(np.full(n, 2.0)).reshape(-1), [100.0], np.full(n, 10.0), np.diag(np.full(n, 10.0)).reshape(-1)])
    model = fitted(known, n)
    for _ in range(PASSES):
        sums = summed(rows.select("counts", "gold"), expected(model), size)
        share = UNLABELLED_WEIGHT * known.reshape(2, -1)[:, 0].sum() / max(sums.reshape(2, -1)[:, 0].sum(), 1.0)
        model = fitted(known + min(1.0, share) * sums, n)
    return model


# --- classifier --------------------------------------------------------------------


def features(counts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Of each voter's word or beginning how often it occurs, also against the length; how many occur; the length."""
    c, n_words = counts.astype(float), n_words.astype(float)
    return np.hstack([np.log1p(c), np.minimum(1, 30 * c / (n_words[:, None] + 30)), np.log1p((c > 0).sum(axis=1, keepdims=True)), np.log1p(n_words)[:, None] / 10])


@dataclass
class Linear:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), (x - self.mean) / self.scale])

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.inputs(x) @ self.weight)


def fit_linear(rows: DataFrame, model: LabelModel, least: np.ndarray) -> Linear:
    """Ridge logistic regression on the posteriors of all training rows; each voter alone and none at all stand in as rows of little weight."""
    n = len(least)
    d = 2 * n + 2
    alone = np.vstack([np.zeros((1, n), np.uint8), np.diag(least).astype(np.uint8)])
    stand_in = features(alone, np.full(n + 1, 200.0)), model.posterior((alone >= least).astype(float))

    def read(batch):
        counts = counts_of(batch, n)
        return features(counts, batch.column("n_words").to_numpy()), model.posterior((counts >= least).astype(float), batch.column("gold").to_numpy())

    def spread(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    sums = summed(rows, _sums(lambda batch: spread(read(batch)[0]), 1 + 2 * d), 1 + 2 * d) + spread(stand_in[0])
    mean = sums[1 : 1 + d] / sums[0]
    now = Linear(mean, np.sqrt(np.maximum(sums[1 + d :] / sums[0] - mean * mean, 0)) + 0.02, np.zeros(1 + d))
    penalty = np.array([1e-6, *np.full(d, RIDGE)])

    def slopes(x: np.ndarray, target: np.ndarray) -> np.ndarray:
        z = now.inputs(x)
        p = sigmoid(z @ now.weight)
        return np.concatenate([z.T @ (target - p), ((z * (p * (1 - p) + 1e-6)[:, None]).T @ z).reshape(-1)])

    for _ in range(STEPS):
        size = (1 + d) * (2 + d)
        sums = summed(rows, _sums(lambda batch: slopes(*read(batch)), size), size) + slopes(*stand_in)
        step = np.linalg.solve(sums[1 + d :].reshape(1 + d, 1 + d) + np.diag(penalty), sums[: 1 + d] - penalty * now.weight)
        now = Linear(now.mean, now.scale, now.weight + step / max(1.0, np.abs(step).max()))
        if np.abs(step).max() < 1e-3:
            break
    return now


def _scored(model: Linear, n: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                score = model.score(features(counts_of(batch, n), batch.column("n_words").to_numpy()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)], ["doc_id", "held_out", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row's whole text.

    Labels with null ids or values, or other values than 0 and 1, are not used; several labels
    of an id count as their largest. All others are learnt from, and all rows of the training
    fold. Without labels of both kinds in the training fold only the
    lexicon votes. Null and empty texts score what a text without voters scores. Null doc_ids
    count as remainder 0. Repeated rows each get a row; an empty table gives none. Columns
    other than doc_id and text are not read.
    """
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder_of_id(FOLDS) != HELD_OUT))
    given = written(usable.groupBy("doc_id").agg(F.max("toxic").alias("gold")), "given")
    gold = F.coalesce("gold", F.lit(-1)).alias("gold")  # labels grow with the texts: merged, at no size broadcast
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).withColumn("held_out", remainder_of_id(FOLDS) == HELD_OUT)
    training = written(beginnings(source.where(~F.col("held_out"))).join(given.hint("merge"), "doc_id", "left").select("insults", "shown", gold), "shown")
    voters = mine(training.where("gold >= 0").withColumnRenamed("gold", "toxic"))
    if voters.prefixes:
        voters = mine(relabelled(training, voters))
    drop_written(training)
    n = len(voters.least)
    rows = counted(source, voters, "doc_id bigint, held_out boolean").join(given.hint("merge"), "doc_id", "left")
    rows = written(rows.select("doc_id", "held_out", "counts", "n_words", gold), "votes")
    drop_written(given)
    learnt = rows.where(~F.col("held_out")).select("counts", "n_words", "gold")
    model = fit_linear(learnt, fit_label_model(learnt, voters.least), voters.least)
    found = rows.select("doc_id", "held_out", "counts", "n_words").mapInArrow(_scored(model, n), "doc_id bigint, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _votes_of(batch, voters: Voters) -> np.ndarray:
    """Votes of rows (insults, shown)."""
    lists, n = batch.column("shown"), len(voters.words)
    votes = np.zeros((batch.num_rows, len(voters.least)), bool)
    votes[:, :n] = np.frombuffer(b"".join(batch.column("insults").to_pylist()), np.uint8).reshape(batch.num_rows, n)
    which = pc.fill_null(pc.index_in(lists.flatten(), pa.array(voters.prefixes, pa.string())), -1).to_numpy()
    row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
    votes[row[which >= 0], n + which[which >= 0]] = True
    return votes


def relabelled(training: DataFrame, voters: Voters) -> DataFrame:
    """shown, toxic of all training rows (insults, shown, gold): rows without a label (gold -1) with the likelier one by a model of the voters, which learns from the labelled ones."""
    least = voters.least

    def vote(batches):
        for batch in batches:
            counts = _votes_of(batch, voters) * least.astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in counts], pa.binary()), batch.column("gold")], ["counts", "gold"])

    known = written(training.where("gold >= 0").mapInArrow(vote, "counts binary, gold int"), "gold")
    model = fit_label_model(known, least)
    drop_written(known)

    def label(batches):
        for batch in batches:
            given, p = batch.column("gold").to_numpy(), model.posterior(_votes_of(batch, voters).astype(float))
            yield pa.RecordBatch.from_arrays([batch.column("shown"), pa.array(np.where(given < 0, p > 0.5, given).astype(np.int32))], ["shown", "toxic"])

    return training.mapInArrow(label, "shown array<string>, toxic int")


def op8_weak_supervision(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
