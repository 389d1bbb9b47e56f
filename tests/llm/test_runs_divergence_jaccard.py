"""Periodic runs, source divergence and the Jaccard join against plain Python, and on awkward rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.llm import arrays, divergence, jaccard, kneser_ney, registry, runs, sketch
from terrace.shipping import ship_package

from .cases import ROWS, documents, empty

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship_package(spark)


def words(text):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]


# --- runs ------------------------------------------------------------------------------


def plain_runs(w, least, exponent):
    """Stretches of equality at each distance, without those of a smaller period."""
    found, codes = [], {}
    x = np.array([codes.setdefault(a, len(codes)) for a in w], np.int64)
    for p in range(1, len(w) // 2 + 1):
        same = np.concatenate([[False], x[:-p] == x[p:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            n = e - s + p
            if n >= max(least, exponent * p) and not any((x[s : s + n - q] == x[s + q : s + n]).all() for q in range(1, p)):
                found.append((s, n, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least, exponent", [(2, 2), (6, 4), (3, 3)])
def test_runs_of_small_words(least, exponent):
    rnd = random.Random(least)
    for n in range(11):
        for w in itertools.product("ab", repeat=n):
            assert runs.runs_of(list(w), least, exponent) == plain_runs(w, least, exponent)
    for _ in range(1500):
        w = [rnd.choice("abcd"[: rnd.randint(1, 4)]) for _ in range(rnd.randint(0, 50))]
        w = (w[: rnd.randint(1, 9)] * 6 + w)[:60] if rnd.random() < 0.4 else w
        assert runs.runs_of(w, least, exponent) == plain_runs(w, least, exponent), w


class Counted(str):
    compared = 0

    def __eq__(self, other):
        Counted.compared += 1
        return str.__eq__(self, other)

    def __ne__(self, other):
        Counted.compared += 1
        return str.__ne__(self, other)

    def __gt__(self, other):
        Counted.compared += 1
        return str.__gt__(self, other)

    __hash__ = str.__hash__


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


FAMILIES = {
    "one letter": "a" * 20_000, "fibonacci": fibonacci(20_000), "thue-morse": "".join("ab"[k.bit_count() % 2] for k in range(20_000)), "powers then break": ("ab" * 5000 + "c") * 2,
    "growing blocks": "".join("a" * k + "b" for k in range(1, 200)), "nested": (("ab" * 20 + "c") * 20 + "d") * 20, "two letters": "".join(random.Random(7).choices("ab", k=20_000)),
}


@pytest.mark.parametrize("name", FAMILIES)
def test_comparisons_stay_linear(name):
    w = [Counted(x) for x in FAMILIES[name]]
    Counted.compared = 0
    runs.runs_of(w)
    assert Counted.compared <= 20 * len(w)


def test_op12_against_brute_force(spark):
    rows = {r.doc_id: r for r in registry.QUERIES["op12_lyndon_runs"](spark, SF2).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    many = 0
    for i, text in texts.items():
        w, h = words(text), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        found = plain_runs(w, 6, 4)
        many += len(found)
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{p}\n" for s, n, p in found), " ".join(x for k, x in enumerate(w) if k not in gone))]
        assert tuple(rows[i])[1:] == (len(found), *figures, *digest)
    assert many > 100


# --- divergence ------------------------------------------------------------------------


def rounded(rows):
    return sorted(map(tuple, rows), key=repr)


def sql_rows(docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas())
    return con.sql(divergence.OP13_SQL).fetchall()


def test_op13_equals_sql(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    assert rounded(registry.QUERIES["op13_source_divergence"](spark, SF2).collect()) == rounded(sql_rows(docs))


def test_divergence_of_awkward_rows(spark):
    rows = ROWS + [(100 + k, "Same Same words héé x1y", "en", f"s{k % 3}", 1) for k in range(12)] + [(200 + k, "nul\x00term sep", None, None, 1) for k in range(10)]
    docs = documents(spark, rows)
    got = divergence.source_divergence(docs).collect()
    assert rounded(got) == rounded(sql_rows(docs)) and {r.part for r in got} == {"pair", "term"}
    assert divergence.source_divergence(empty(spark)).count() == 0


def test_sketch_never_underestimates(spark):
    """A sketch far too small: estimates grow, none falls below the count, and the audit's result stays."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("text"), F.lit("en").alias("lang"), "source")
    small = sketch.count_sketch(docs, divergence._frequencies, sketch.LEAST_BITS)
    batch = docs.toArrow().combine_chunks().to_batches()[0]
    hashes, counts = next(iter(divergence._frequencies(batch)))
    assert (small.estimates(hashes) >= np.minimum(counts, sketch.FULL)).all()
    unseen = small.estimates(np.arange(1, 1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert unseen.mean() < small.estimates(hashes).mean()


# --- Jaccard join ----------------------------------------------------------------------


def shingles(text, width=4):
    w = words((text or "").translate(FOLD))
    return frozenset(" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def classes(sets, percent=85):
    """Smallest id reachable, by comparing all pairs that share a shingle."""
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    pairs = {(a, b) for ids in holders.values() for a, b in itertools.combinations(sorted(ids), 2)}
    links = 0
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            links += 1
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {i: root(i) for i in sets}, links


def test_op11_against_all_pairs(spark):
    rows = registry.QUERIES["op11_combination_prefixes"](spark, SF2).collect()
    sets = {r.doc_id: shingles(r.text) for r in spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "text").collect()}
    want, links = classes(sets)
    assert links > 50 and {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(s), want[i]) for i, s in sets.items()}


def test_linked_sets_share_a_key():
    """Prefixes of rare, frequent and very frequent shingles, sets of 1 to 2500."""
    rng, links = np.random.default_rng(1), 0
    for t in range(120):
        pool, estimate = rng.integers(0, 2**63, 4000).astype(np.uint64), rng.choice([2, 3, 10, 40, 100, 255], 4000, p=rng.dirichlet(np.ones(6) / 2)).astype(np.uint8)
        sets = []
        for _ in range(5):
            base = rng.choice(4000, int(rng.integers(1, (8, 40, 400, 2500)[t % 4])), replace=False)
            sets.append(np.unique(base))
            for _ in range(3):
                drop = rng.random(len(base)) < rng.choice([0.02, 0.07, 0.1])
                sets.append(np.unique(np.concatenate([base[~drop], rng.choice(4000, int(drop.sum()) + int(rng.integers(0, 3)))])))
        row, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        order = np.lexsort((pool[at], row))
        owner, key = jaccard.prefix_keys(row[order], pool[at][order], estimate[at][order], len(sets), 85)
        keys = [set(key[owner == k].tolist()) for k in range(len(sets))]
        for a, b in itertools.combinations(range(len(sets)), 2):
            common = len(np.intersect1d(sets[a], sets[b]))
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                links += 1
                assert keys[a] & keys[b]
    assert links > 500


def test_parities_never_part_linked_sets(spark):
    rnd, u, v, truth = np.random.default_rng(8), [], [], []
    for _ in range(400):
        n = int(rnd.integers(1, 900))
        pool = rnd.integers(0, 2**64, 2 * n, dtype=np.uint64)
        gone = int(rnd.integers(0, max(1, n // 5) + 1))
        both = [np.unique(pool[:n]), np.unique(pool[gone : n + int(rnd.integers(0, gone + 1))])]
        common = len(np.intersect1d(*both))
        truth.append(100 * common >= 85 * (len(both[0]) + len(both[1]) - common))
        for side, x in zip((u, v), both, strict=True):
            odd = jaccard.parities(np.zeros(len(x), np.int64), x, 1).view(np.int64)[0]
            side.append((len(x), *map(int, odd)))
    names = [f"{x}_{c}" for x in "uv" for c in ("size", *jaccard.PARITIES)]
    rows = spark.createDataFrame([(k, *a, *b) for k, (a, b) in enumerate(zip(u, v, strict=True))], ", ".join(f"{c} bigint" for c in ["k", *names]))
    may = {r.k: r.may for r in rows.select("k", jaccard._may_link(85).alias("may")).collect()}
    assert all(may[k] for k, linked in enumerate(truth) if linked)
    assert 0 < sum(truth) < len(truth)


def test_parities_part_sets_of_half_their_shingles(spark):
    """Sets of up to 600 that share two thirds of each, a similarity of one half, are told apart."""
    rnd, rows = np.random.default_rng(9), []
    for k in range(100):
        n = int(rnd.integers(60, 600))
        pool = rnd.integers(0, 2**64, 2 * n, dtype=np.uint64)
        sides = [pool[:n], pool[n // 3 : n + n // 3]]
        rows.append((k, *(x for side in sides for x in (n, *map(int, jaccard.parities(np.zeros(n, np.int64), side, 1).view(np.int64)[0])))))
    names = [f"{x}_{c}" for x in "uv" for c in ("size", *jaccard.PARITIES)]
    met = spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in ["k", *names]))
    assert met.where(jaccard._may_link(85)).count() == 0


def test_sets_that_share_many_keys_are_paired_about_once(spark):
    """A family of 40 sets with most of 60 keys in common, and sets of 300 keys that have one or none in common, anywhere among their own."""
    rnd = np.random.default_rng(10)
    family = rnd.integers(-(2**63), 2**63, 60)
    sets = [set(rnd.choice(family, 50, replace=False).tolist()) for _ in range(40)]
    loose = rnd.integers(-(2**63), 2**63, 40)
    sets += [{int(loose[k // 2]), *rnd.integers(-(2**63), 2**63, 299).tolist()} for k in range(80)]
    rows = [(n, 100, n, 0, 0, 0, 0, k) for n, s in enumerate(sets) for k in s]
    keys = spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in ["node", *jaccard.MET, "key"]))
    want = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] & sets[b]}
    got = [(r.u, r.v) for r in jaccard._pairs(keys).select("u", "v").collect()]
    assert set(got) == want and len(got) <= 2 * len(want)


def test_jaccard_of_awkward_rows_and_a_large_group(spark):
    """Copies without an id, blank texts, and 300 near copies of one text that few of each other link to, but all to the text."""
    rnd = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    near = []
    for k in range(300):
        w = list(base)
        for at in rnd.sample(range(4, 116), 2):
            w[at] = f"x{k}y{at}"
        near.append((1000 + k, " ".join(w), "en", "src0", 1))
    rows = ROWS + near + [(2000, " ".join(base).upper(), "en", "src0", 1), (None, " ".join(base), "en", "src0", 1)]
    got = jaccard.jaccard_classes(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    want, _ = classes({(i if i is not None else -k): shingles(t) for k, (i, t, *_) in enumerate(rows, 1)})
    for k, r in enumerate(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0))):
        if r.doc_id is not None:
            assert r.component_id == (want[r.doc_id] if want[r.doc_id] > 0 else min(i for i, root in want.items() if root == want[r.doc_id] and i > 0)), k
    assert {r.component_id for r in got if r.doc_id is None} == {None, want[2000] if want[2000] > 0 else 1000}
    assert jaccard.jaccard_classes(empty(spark)).count() == 0


# --- the language model's files --------------------------------------------------------


def test_model_keeps_few_files_open(tmp_path):
    """100 shards under a limit of 8 open files."""
    rng, homes = np.random.default_rng(2), {}
    for n in range(100):
        keys = np.unique(rng.integers(0, 2**64, 50, dtype=np.uint64))
        homes[n] = keys
        arrays.save(str(tmp_path), f"t-{n}", [*arrays.key_arrays(keys), np.arange(len(keys), dtype=np.uint64) + 1])
    model = kneser_ney.Model(str(tmp_path), 1, 100, [], 0, 0)
    model.open_files = 8
    key, home = np.concatenate(list(homes.values())), np.concatenate([np.full(len(k), n) for n, k in homes.items()])
    found = model.lookup("t", key, home, 1, lambda rest, slot: (rest[0][slot],))
    assert len(model._open) <= 8
    assert (found[0] == np.concatenate([np.arange(len(k)) + 1 for k in homes.values()])).all()


def test_runs_of_awkward_rows(spark):
    rows = ROWS + [(50, "a " * 9, "en", "src0", 18), (50, "a " * 9, "en", "src0", 18)]
    got = runs.periodic_runs(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    key = lambda i, n: (i is None, i or 0, n)
    for r, (_, text, *_) in zip(sorted(got, key=lambda r: key(r.doc_id, r.n_words)), sorted(rows, key=lambda r: key(r[0], len(words(r[1])))), strict=True):
        w = words(text)
        want = [(0, 60_000, 3)] if r.doc_id == 7 else plain_runs(w, 6, 4)
        assert r.n_words == len(w) and [tuple(x) for x in r.runs] == want
        gone = {k for s, n, p in want for k in range(s + p, s + n)}
        assert r.collapsed == " ".join(x for k, x in enumerate(w) if k not in gone)
    assert runs.periodic_runs(empty(spark)).count() == 0 and runs.with_planted_runs(documents(spark, rows)).count() == len(rows)
