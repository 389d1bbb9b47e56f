"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrace.llm import chatformat, common, decontaminate, kneser_ney, mixing, quality, secrets, simhash, tokencount, toxicity, urlfilter
from terrace.shipping import ship_package

from .cases import ROWS, documents, empty

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship_package(spark)


def benchmark(spark, rows=((1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, None), (None, "x"), (3, ""))):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "item_id bigint, text string, words string")


def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (1, 0), (9, 7)], "doc_id bigint, toxic int")


PER_ROW = {
    "op1": lambda spark, docs: kneser_ney.score_by_training_fold(docs),
    "op3": lambda spark, docs: mixing.mixture(docs),
    "op4": lambda spark, docs: decontaminate.decontamination_report(docs, benchmark(spark)),
    "op6": lambda spark, docs: simhash.simhash_classes(docs),
    "op7": lambda spark, docs: secrets.secret_report(docs),
    "op8": lambda spark, docs: toxicity.toxicity_scores(docs, labels(spark)),
    "op9": lambda spark, docs: quality.quality_report(docs),
    "op10": lambda spark, docs: tokencount.token_counts(docs),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_every_row_gets_a_row(spark, name):
    got = PER_ROW[name](spark, documents(spark)).collect()
    order = lambda ids: sorted(ids, key=lambda x: (x is None, x or 0))
    assert order(r.doc_id for r in got) == order(r[0] for r in ROWS)


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_tables_give_no_rows(spark, name):
    assert PER_ROW[name](spark, empty(spark)).collect() == []


def test_stages_stand_awkward_rows_and_keep_the_columns(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, empty(spark)):
            got = stage(spark, table, SF)
            rows = got.collect()
            mixed = [c for c in docs.columns if c.lower() not in ("domain", "epoch")] + ["domain", "epoch"]  # these two are the mixing's own
            assert got.columns == (mixed if stage is corpus_pipeline.mixing else docs.columns), name
            assert table is docs or not rows, name


def test_copies_leave_one_document(spark):
    kept = [r.doc_id for r in simhash.drop_near_duplicates(documents(spark)).collect()]
    assert kept.count(1) == 1 and 2 not in kept and 3 not in kept and kept.count(4) == 1 and 5 not in kept and 6 not in kept and None in kept


def test_rows_without_an_own_id_go_by_their_classes(spark):
    text = lambda k: " ".join(f"t{k}w{n}" for n in range(40))
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (None, text(2)), (5, text(2)), (5, text(3)), (6, text(3)), (7, text(4)), (7, text(5)), (7, text(5))]
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in rows])
    kept = sorted(simhash.drop_near_duplicates(docs).select("doc_id", "text").collect(), key=lambda r: r.text)
    assert [(r.doc_id, r.text) for r in kept] == [(i, text(k)) for k, i in enumerate((None, None, 5, 5, 7, 7))]


def test_secret_stage_keeps_every_document(spark):
    assert secrets.redact_secrets(documents(spark)).count() == len(ROWS)


def test_benchmark_without_items(spark):
    docs = documents(spark)
    assert decontaminate.decontaminate(docs, benchmark(spark).where("false")).count() == len(ROWS)


def test_voters_come_from_all_training_rows(spark):
    """Beginnings that only few of 18,000 labelled training rows show, or only rows without a label, are learnt."""
    from pyspark.sql import Window

    ids = spark.range(24_000).withColumnRenamed("id", "doc_id").withColumn("rank", F.row_number().over(Window.orderBy((common.remainder_of_id(4) == 2).cast("int"), F.xxhash64("doc_id"))))
    toxic, late = F.col("doc_id") % 10 == 0, F.col("rank") > 12_000
    insult = F.when(late, "zorblax zorblax idiot idiot").otherwise("pathetic pathetic idiot idiot mudwump mudwump")
    docs = ids.select("doc_id", F.when(toxic, insult).otherwise("a fine day by the sea").alias("text"), toxic.cast("int").alias("toxic"))
    unlabelled = spark.range(30_000, 31_000).selectExpr("id doc_id", "'pathetic pathetic idiot idiot mudwump mudwump quibnar quibnar' text")
    asked = spark.createDataFrame([(40_000, "zorblax zorblax zorblax"), (40_001, "quibnar quibnar quibnar"), (40_002, "pebble pebble pebble")], "doc_id bigint, text string")
    got = toxicity.toxicity_scores(docs.select("doc_id", "text").unionAll(unlabelled).unionAll(asked), docs.select("doc_id", "toxic"))
    assert got.count() == 24_000 + 1000 + 3
    scores = {r.doc_id: r.score for r in got.where("doc_id >= 40000").collect()}
    assert scores[40_000] >= 0.3 and scores[40_001] > 2 * scores[40_002]
    assert got.where("doc_id < 24000 AND doc_id % 10 <> 0 AND predicted = 1").count() == 0


def test_toxicity_without_any_labels(spark):
    got = toxicity.toxicity_scores(documents(spark, [(1, "you pathetic idiot, worthless trash", "en", "s", 1), (2, "a fine day by the sea", "en", "s", 1)]), labels(spark).where("false")).collect()
    score = {r.doc_id: r.score for r in got}
    assert score[1] > 0.3 > score[2]


def test_pages_and_conversations(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "no scheme", "", "x"), (3, "HTTP://A.Example.COM/en/7x?q#f", '<a href="https://casino.example.net/">', "x"), (3, "HTTP://A.Example.COM/en/7x?q#f", None, "x"), (None, "x://", None, "x"), (4, "a://b://c/d", "", "x")], "page_id bigint, url string, html string, host string")
    got = sorted(urlfilter.url_verdicts(pages).collect(), key=lambda r: (r.page_id or 0, r.host))
    assert [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got] == [
        (None, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.com", "/en/7x", "example.com/en/7", "allow"), (3, "a.example.com", "/en/7x", "example.com/en/7", "allow"), (4, "b:", "//c/d", None, "allow"),
    ]
    assert urlfilter.url_verdicts(pages.where("false")).collect() == []
    talk = spark.createDataFrame([(1, 0, "user", "hi <|end|>", "x"), (1, 0, "user", "hi <|end|>", "x"), (1, None, None, None, "x"), (2, 0, "system", "only", "x"), (None, 1, "a b", "t", "x"), (1, 900, "bot", "far", "x")], "conv_id bigint, turn bigint, role string, text string, speaker string")
    rows = chatformat.rotations(talk).collect()
    assert all(r.start == 0 for r in rows if r.segment == min(x.segment for x in rows if (x.conv_id, x.speaker) == (r.conv_id, r.speaker)))
    unnumbered = next(r.segment for r in rows if r.segment < 0)
    pieces = [("1", k, who, 1) for k in (unnumbered, 0, 14) for who in ("bot", "unknown", "user")] + [("None", 0, "a b", 1)]
    assert sorted((str(r.conv_id), r.segment, r.speaker, r.n_turns) for r in rows) == sorted(pieces)
    for who, said in (("user", "hi < |end|>"), ("bot", "far"), ("unknown", "")):
        mine = sorted((r for r in rows if (r.conv_id, r.speaker) == (1, who)), key=lambda r: r.segment)
        whole = "".join(r.rendered for r in mine)
        assert [r.start for r in mine] == [len("".join(x.rendered for x in mine[:k])) for k in range(3)]
        assert [whole[m.start : m.stop] for r in mine for m in r.mask] == [said + "\n<|end|>\n"]
    assert chatformat.rotations(talk.where("false")).collect() == []


def test_long_dialogues_are_whole_however_they_are_cut(spark, monkeypatch):
    rows = [(7, n, ("user", "bot", "system")[n % 3], f"turn {n} " + "ü" * (n % 9)) for n in range(700)] + [(7, None, "ghost", f"lost {n}") for n in range(600)] + [(8, 3, "user", "word " * 40_000)]
    talk = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")

    def whole(found):
        out = {}
        for r in sorted(found.collect(), key=lambda r: r.segment):
            text, mask = out.get((r.conv_id, r.speaker), ("", []))
            assert r.start == len(text)
            out[r.conv_id, r.speaker] = text + r.rendered, mask + [(m.start, m.stop) for m in r.mask]
        return out

    monkeypatch.setattr(chatformat, "GROUP_SEGMENTS", 3)
    cut, uncut = whole(chatformat.rotations(talk, 16)), whole(chatformat.rotations(talk, 10_000))
    assert cut == uncut and {k[1] for k in cut} == {"user", "bot", "ghost"}
    text, mask = cut[7, "user"]
    own = [text[a:b] for a, b in mask]
    assert own == [f"turn {n} {'ü' * (n % 9)}\n<|end|>\n" for n in range(0, 700, 3)] and text.count("<|user name=ghost|>") == 600


def test_very_long_pages_and_hosts(spark):
    html = "".join(f'<a href="http://h{n % 50}.site.com/">' for n in range(20_000))
    pages = spark.createDataFrame([(1, "http://" + ".".join(["x"] * 200) + ".com/" + "p" * 100_000, html)], "page_id bigint, url string, html string")
    r = urlfilter.url_verdicts(pages).first()
    assert len(r.path) == 100_001 and r.verdict == "allow" and urlfilter.host_edges(pages).count() == 50 + 199 + 50


def test_masks_of_many_spans_follow_positions(spark, monkeypatch):
    text = " ".join(f"ü{n} password=hunter{n:04d}" for n in range(700))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    want = " ".join(f"ü{n} [SECRET]" for n in range(700))
    for blocks in ((4096, 64), (50, 3), (7, 7)):
        monkeypatch.setattr(secrets, "MASK_BLOCKS", blocks)
        assert secrets.redact_secrets(docs).first().text == want


def test_scans_in_blocks_equal_scans_at_once(spark, monkeypatch):
    items = spark.createDataFrame([([],), ([5],), (list(range(700)),)], "v array<int>")
    sums = lambda: [list(r[0]) for r in items.select(common.scan(F.col("v"), F.lit(0), lambda s, x: s + x, lambda s, x: s, "int")).collect()]
    want = [[sum(v[:k]) for k in range(len(v))] for v in ([], [5], list(range(700)))]
    assert sums() == want
    monkeypatch.setattr(common, "SCAN_BLOCK", 13)
    assert sums() == want
