"""Chat formatting by perspective rotation.

Every participant of a conversation gets the dialogue rendered with their own turns as the
assistant's and all others' as named users', and a mask of the characters to learn: their
own turns' texts and end marks. So that a conversation of any length never gathers in one
task, a rendering is stored in pieces of a fixed range of turn numbers: a dialogue's pieces,
one after the other, are its whole rendering, and a piece says where in it it begins; masks
count from the dialogue's beginning. A dialogue within one range is one piece. Participants
are those of the whole conversation. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scan, table

#: Turn numbers in a piece, and pieces whose beginnings are summed in one window.
SEGMENT_TURNS, GROUP_SEGMENTS = 64, 1024
#: Pieces that turns without a number are dealt to.
UNNUMBERED = 256
#: The role that everyone sees as it is; it is no participant.
SYSTEM = "system"
ASSISTANT_HEAD, SYSTEM_HEAD, END = "<|assistant|>\n", "<|system|>\n", "<|end|>\n"


def head(role: Column, speaker: Column) -> Column:
    name = F.regexp_replace(role, "[^A-Za-z0-9_-]", "_")
    return F.when(role == speaker, ASSISTANT_HEAD).when(role == SYSTEM, SYSTEM_HEAD).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))


def body(text: Column) -> Column:
    """The text with what could be read as a mark pulled apart, and the end mark."""
    return F.concat(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("\n" + END))


def numbered(conversations: DataFrame, segment_turns: int) -> DataFrame:
    """The distinct turns with `place`, which orders turns without a number, and `segment`: below 0 for these."""
    role, text = F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    turns = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role, text).distinct()
    turns = turns.withColumn("place", F.when(F.col("turn").isNull(), F.md5(F.concat_ws("\n", "role", "text").cast("binary"))).otherwise(F.lit("")))
    unnumbered = F.conv(F.substring("place", 1, 2), 16, 10).cast("bigint") - UNNUMBERED
    return turns.withColumn("segment", F.when(F.col("turn").isNull(), unnumbered).otherwise(F.floor(F.col("turn") / segment_turns).cast("bigint")))


def beginnings(sizes: DataFrame) -> DataFrame:
    """Adds `start`, the sum of `size` over the pieces before in the dialogue: sums of groups of pieces first, so no window holds a long dialogue."""
    key = ["conv_id", "speaker"]
    before = lambda by, column: F.coalesce(F.sum(column).over(Window.partitionBy(*by).orderBy(F.asc(order[column])).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    order = {"all": "group", "size": "segment"}
    sizes = sizes.withColumn("group", F.floor(F.col("segment") / GROUP_SEGMENTS))
    groups = sizes.groupBy(*key, "group").agg(F.sum("size").alias("all")).withColumn("ahead", before(key, "all"))
    groups = groups.select(F.col("conv_id").alias("id"), F.col("speaker").alias("by"), F.col("group").alias("of"), "ahead")
    inside = sizes.withColumn("inside", before([*key, "group"], "size"))
    found = inside.join(groups, F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("speaker") == F.col("by")) & (F.col("group") == F.col("of")))
    return found.select(*key, "segment", (F.col("ahead") + F.col("inside")).alias("start"))


def rotations(conversations: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """conv_id, segment, speaker, n_turns, start, rendered, mask (array<struct<start, stop>>): the pieces of every participant's rendering.

    A dialogue's `rendered` in order of `segment` are its rendering; `start` is where in it a
    piece begins, and mask counts from its beginning (code points, end exclusive). Turns go by
    number, then role, then text; rows that repeat a turn in all of these are one turn. Turns
    without a number come first, in the order of a hash of role and text. Null roles are named
    "unknown", null texts are empty. Conversations with only system turns have no participants
    and no rows; rows without a conv_id are one conversation; an empty table gives none.
    Columns other than these four are not read.
    """
    turns = numbered(conversations, segment_turns)
    speakers = turns.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("speaker")).distinct()
    segments = turns.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("turn", "place", "role", "text"))).alias("turns"))
    lengths = segments.select("conv_id", "segment", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.char_length(body(t["text"])).alias("body"))).alias("turns"))
    sized = lengths.join(speakers.withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id")))
    size = lambda t: F.char_length(head(t["role"], F.col("speaker"))) + t["body"]
    starts = beginnings(sized.select("conv_id", "speaker", "segment", F.aggregate("turns", F.lit(0).cast("bigint"), lambda n, t: n + size(t)).alias("size")))
    starts = starts.select(F.col("conv_id").alias("id"), "speaker", F.col("segment").alias("of"), "start")
    views = segments.join(starts, F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("segment") == F.col("of")))
    pieces = views.withColumn("pieces", F.transform("turns", lambda t: F.struct(head(t["role"], F.col("speaker")).alias("head"), body(t["text"]).alias("body"), (t["role"] == F.col("speaker")).alias("own"))))
    stop = lambda at, p: at + F.char_length(p["head"]) + F.char_length(p["body"])
    own = lambda at, p: F.when(p["own"], F.struct((at + F.char_length(p["head"])).alias("start"), stop(at, p).alias("stop")))
    mask = F.filter(scan(F.col("pieces"), F.col("start"), stop, own, "struct<start:bigint,stop:bigint>"), lambda x: x.isNotNull())
    rendered = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "")
    return pieces.select("conv_id", "segment", "speaker", F.size("turns").alias("n_turns"), "start", rendered.alias("rendered"), mask.alias("mask"))


def op2_perspective_rotation(spark, sf_dir: str) -> DataFrame:
    found = rotations(table(spark, sf_dir, "conversations"))
    masked = F.aggregate("mask", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("conv_id", "segment", "speaker", F.col("n_turns").cast("bigint").alias("n_turns"), "start", masked.alias("n_masked"), spans.alias("mask"), "rendered")


_END = END.strip()
_PLACE = "CASE WHEN turn IS NULL THEN md5(role || chr(10) || text) ELSE '' END"
OP2_SQL = rf"""
WITH t AS (SELECT *, CASE WHEN turn IS NULL THEN ('0x' || substr(place, 1, 2))::BIGINT - {UNNUMBERED} ELSE floor(turn / {SEGMENT_TURNS})::BIGINT END AS segment
  FROM (SELECT *, {_PLACE} AS place FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations))),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> '{SYSTEM}'),
r AS (SELECT t.*, speaker, replace(text, '<|', '< |') || chr(10) || '{_END}' || chr(10) AS body,
    CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = '{SYSTEM}' THEN '<|system|>'
      ELSE '<|user name=' || regexp_replace(role, '[^A-Za-z0-9_-]', '_', 'g') || '|>' END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
c AS (SELECT *, sum(length(head || body)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, place, role, text ROWS UNBOUNDED PRECEDING) AS stop FROM r)
SELECT conv_id, segment, speaker, count(*)::BIGINT AS n_turns, min(stop - length(head || body))::BIGINT AS start,
  sum(CASE WHEN role = speaker THEN length(body) ELSE 0 END)::BIGINT AS n_masked,
  coalesce(string_agg(CASE WHEN role = speaker THEN (stop - length(body))::BIGINT || ':' || stop::BIGINT END, ',' ORDER BY turn NULLS FIRST, place, role, text), '') AS mask,
  string_agg(head || body, '' ORDER BY turn NULLS FIRST, place, role, text) AS rendered
FROM c GROUP BY conv_id, segment, speaker
"""
