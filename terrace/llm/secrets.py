"""Secret scans: single-part patterns, and credentials whose parts stand together.

Everything is DataFrame expressions. Spark has no function that returns all match
positions, so a text is split at the matches: the lengths of the pieces between them and
of the matches themselves add up to the spans. Strong kinds are reported wherever they
occur. Weak parts (an account identifier, a long random value, an endpoint) are common in
clean text, so each is reported only where a part of a complementary kind lies within a
scope of SCOPE characters: an interval join of each text's parts, done as sweeps over the
parts in order of position, forward and back, about linear in their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks_of, column_or, fresh, let, scan, table, text_of

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Kinds in the order that breaks ties of position.
KINDS = ("assign", "access", "hex", "identifier", "random", "endpoint")
#: Weak parts. random: a whole run of 32 or more characters of base64; upper, lower and digit are asked for below.
IDENTIFIER = r"(?i:\b(?:access_?key_?id|client_?id|account_?id|user(?:name)?|login)\b)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}"
RANDOM = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"(?i:\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://)[^\x20\x09-\x0D\"'<>]{4,}"
#: Characters (code points) within which parts belong together.
SCOPE = 200
SPAN = "array<struct<start:int,kind:int,stop:int>>"
#: Pieces of a masked text that are cut out of one piece of it, and of a piece of that.
MASK_BLOCKS = (4096, 64)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, found>>: leftmost non-overlapping matches, in code points, the end exclusive."""

    def located(found: Column, gaps: Column) -> Column:
        sizes = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, f: F.struct(F.char_length(g).alias("gap"), F.char_length(f).alias("size")))
        starts = scan(sizes, F.lit(0), lambda at, x: at + x["gap"] + x["size"], lambda at, x: at + x["gap"], "int")
        return F.zip_with(starts, found, lambda s, f: F.struct(s.alias("start"), (s + F.char_length(f)).alias("stop"), f.alias("found")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    some = let(both, lambda x: located(x["found"], x["gaps"]))
    return F.when(text.rlike(pattern), some).otherwise(F.array().cast("array<struct<start:int,stop:int,found:string>>"))


def spans(text: Column, kind: str, pattern: str, keep=None) -> Column:
    """The kept matches as spans of that kind."""
    found = matches(text, pattern)
    found = F.filter(found, lambda m: keep(m["found"])) if keep else found
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["stop"].alias("stop")))


def base_spans(text: Column) -> Column:
    """Spans of the strong kinds, by start, then kind."""
    long_enough = lambda found: F.char_length(F.regexp_extract(found, f"^{ASSIGN}", 2)) >= 6
    return F.array_sort(F.concat(spans(text, "assign", ASSIGN, long_enough), spans(text, "access", ACCESS), spans(text, "hex", HEX)))


def weak_spans(text: Column) -> Column:
    mixed = lambda found: found.rlike("[A-Z]") & found.rlike("[a-z]") & found.rlike("[0-9]")
    return F.array_sort(F.concat(spans(text, "identifier", IDENTIFIER), spans(text, "random", RANDOM, mixed), spans(text, "endpoint", ENDPOINT)))


def _role(kind: Column) -> Column:
    """0: names an account, 1: is a secret, 2: is an endpoint."""
    return F.when(kind.isin(KINDS.index("access"), KINDS.index("identifier")), 0).when(kind == KINDS.index("endpoint"), 2).otherwise(1)


#: Beyond every position, on either side.
_FAR = 1 << 30


def _reached(parts: Column, forward: bool) -> Column:
    """For each part, how far the base parts before it in sweep order reach: their largest stop, or going back their smallest start."""
    state = lambda e, p: F.when(p["kind"] > KINDS.index("hex"), e).otherwise(F.greatest(e, p["stop"]) if forward else F.least(e, p["start"]))
    swept = scan(parts if forward else F.reverse(parts), F.lit(-_FAR if forward else _FAR), state, lambda e, p: e, "int")
    return swept if forward else F.reverse(swept)


def _near(parts: Column, forward: bool) -> Column:
    """For each part, whether a part of another role that comes before it in sweep order lies within the scope."""

    def state(edges: Column, p: Column) -> Column:
        reach = (lambda e: F.greatest(e, p["stop"])) if forward else (lambda e: F.least(e, p["start"]))
        return let(_role(p["kind"]), lambda role: F.transform(edges, lambda e, r: F.when(r == role, reach(e)).otherwise(e)))

    def emit(edges: Column, p: Column) -> Column:
        gap = lambda e: (p["start"] - e) if forward else (e - p["stop"])
        return let(_role(p["kind"]), lambda role: F.exists(F.transform(edges, lambda e, r: (r != role) & (gap(e) <= SCOPE)), lambda x: x))

    far = F.lit(-_FAR if forward else _FAR)
    swept = scan(parts if forward else F.reverse(parts), F.array(far, far, far), state, emit, "boolean")
    return swept if forward else F.reverse(swept)


def _with_both(parts: Column, sweep) -> Column:
    """array<struct<p, a, b>>: each part with what the sweeps forward and back say of it."""
    ahead = F.zip_with(parts, sweep(parts, True), lambda p, a: F.struct(p.alias("p"), a.alias("a")))
    return F.zip_with(ahead, sweep(parts, False), lambda x, b: F.struct(x["p"].alias("p"), x["a"].alias("a"), b.alias("b")))


def linked_weak(base: Column, weak: Column) -> Column:
    """The weak parts that have a part of a complementary role within the scope, before or after; weak parts that overlap a base span are that span."""
    is_weak = lambda p: p["kind"] > F.lit(KINDS.index("hex"))
    own = lambda x: ~is_weak(x["p"]) | ((x["a"] <= x["p"]["start"]) & (x["b"] >= x["p"]["stop"]))
    apart = lambda parts: F.transform(F.filter(_with_both(parts, _reached), own), lambda x: x["p"])
    linked = lambda parts: F.transform(F.filter(_with_both(parts, _near), lambda x: is_weak(x["p"]) & (x["a"] | x["b"])), lambda x: x["p"])
    return F.when(F.size(weak) == 0, F.array().cast(SPAN)).otherwise(let(let(F.array_sort(F.concat(base, weak)), apart), linked))


def digest(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def all_spans(text: Column) -> Column:
    """struct<base, every>: the base spans, and these with the linked weak parts, by start, then kind. An empty text has none."""
    parts = F.struct(base_spans(text).alias("base"), weak_spans(text).alias("weak"))
    return let(parts, lambda p: F.struct(p["base"].alias("base"), F.array_sort(F.concat(p["base"], linked_weak(p["base"], p["weak"]))).alias("every")))


def masked(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span replaced; spans that overlap an earlier one add nothing. The pieces between are cut out of larger pieces, since reaching a position in a text takes as long as it is far."""
    gap = lambda at, s: F.when(s["start"] >= at, F.struct(at.alias("start"), s["start"].alias("stop")))
    gaps = F.filter(scan(found, F.lit(0), lambda at, s: F.greatest(at, s["stop"]), gap, "struct<start:int,stop:int>"), lambda g: g.isNotNull())

    def cut(source: Column, offset: Column, block: Column, sizes: tuple[int, ...]) -> Column:
        piece = lambda first, stop: F.substring(source, first - offset + 1, stop - first)
        if not sizes:
            return F.transform(block, lambda g: piece(g["start"], g["stop"]))
        inner = lambda b: let(piece(b[0]["start"], F.element_at(b, -1)["stop"]), lambda t: cut(t, b[0]["start"], b, sizes[1:]))
        return F.flatten(F.transform(blocks_of(block, sizes[0]), inner))

    kept = let(gaps, lambda g: F.array_join(cut(text, F.lit(0), g, MASK_BLOCKS), mask))
    end = F.array_max(F.transform(found, lambda s: s["stop"]))
    return F.when(F.size(found) == 0, text).otherwise(F.concat(kept, F.lit(mask), F.substring(text, end + 1, F.char_length(text))))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The documents with secrets masked in text and n_chars counted anew where a text changed; other columns as they are, whatever their names.

    Null and empty texts stay; repeated rows are treated alike; an empty table stays empty.
    """
    (spans_of,) = fresh(docs, "spans")
    found = docs.withColumn(spans_of, all_spans(text_of())["every"])
    hit = F.size(spans_of) > 0
    out = {"text": F.when(hit, masked(text_of(), F.col(spans_of))).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(hit, F.char_length(out["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns(out).select(*(F.col(f"`{c}`") for c in docs.columns))


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans and all spans of every row.

    A null or empty text has no spans: counts 0, an empty list, and the digest of the empty
    string. Repeated rows each get a row; an empty table gives none; other columns are not read.
    """
    count = lambda kind: F.size(F.filter("s.base", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")
    found = docs.select(column_or(docs, "doc_id", "bigint").alias("doc_id"), all_spans(text_of()).alias("s"))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(digest(F.col("s.base")), 256).alias("base_sha256"), digest(F.col("s.every")).alias("spans"),
    )


def op7_secret_linking(spark, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))
