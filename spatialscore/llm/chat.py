"""Chat formatting by rotating the perspective, in DataFrame functions only.

Every speaker of a conversation is the assistant once; the others are users with their names. Only the assistant's
words, with the mark that ends them, are targets of the loss.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# Marks of the rendered dialogue; in a text or name they are broken by a blank.
OPEN, END, BROKEN = "<|", "<|end|>", "< |"
#: Speakers that set the scene: they are in every perspective and never the assistant.
CONTEXT = ("system",)
UNNAMED = "unknown"
#: Turn numbers in a block of a rendered dialogue.
BLOCK = 64
#: Messages in a part of a block.
MOST = 256


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit(OPEN), F.lit(BROKEN))


def _messages(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    m = messages.select(messages[conv_col].alias("conv"), messages[turn_col].cast("long").alias("turn"),
                        F.coalesce(messages[role_col], F.lit(UNNAMED)).alias("speaker"), F.coalesce(messages[text_col], F.lit("")).alias("content"))
    # Null ids and turns are values like any other, which they are inside a struct.
    return m.withColumn("key", F.struct("conv", F.floor(F.col("turn") / BLOCK).alias("block")))


def _parts(m: DataFrame) -> DataFrame:
    """``m`` with ``part``: MOST messages of a block each, in order; only blocks with more are ordered to be cut.

    They are sorted as a whole, so that ranges of any size class, also of equal messages, fall to many tasks; a count by
    task gives each message its rank.
    """
    sizes = m.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    over = stored(sizes.where(F.col("n") > MOST).select("key"))
    small = m.join(over, "key", "left_anti").withColumn("part", F.lit(0).cast("long"))
    large = m.join(over, "key", "left_semi").withColumn("tie", F.monotonically_increasing_id())
    sort = large.orderBy("key", "turn", "speaker", "content", "tie").drop("tie")
    at = stored(sort.withColumn("at", F.monotonically_increasing_id())).withColumn("task", F.shiftright("at", 33))
    runs = at.groupBy("key", "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("key", "task", "first", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("at") - F.col("first")
    return small.unionByName(at.join(runs, ["key", "task"]).withColumn("part", F.floor(rank / MOST)).select(*small.columns))


def dialogues(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text", context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """Rendered dialogues: (conv_col, participant, block, part, messages, text, spans).

    Every speaker of a conversation is its ``participant`` once, but for those of ``context``; a conversation whose
    speakers are all context gives no row. A dialogue is cut into blocks of BLOCK turn numbers, and a block with more
    than MOST messages, which have equal numbers or none, into parts of MOST; blocks and parts in order make the whole.
    ``spans`` are the 0-based character ranges [first, end) of the part's text that are targets. Messages of one turn
    number stand in the order of speaker and text, repeated ones are repeated, those without a turn number are a block
    of their own (null). A null role speaks as ``unknown``, a null text is empty; other columns are not read.

    The messages are shuffled once, by part, and meet the short list of participants there; the perspectives are made
    from the row of a part.
    """
    m = _parts(_messages(messages, conv_col, turn_col, role_col, text_col)).withColumn("key", F.struct("key.conv", "key.block", "part"))
    of = m.select(F.struct("key.conv").alias("of"), "key", "speaker")
    people = of.where(~F.col("speaker").isin(*context)).groupBy("of").agg(F.collect_set("speaker").alias("people"))
    lists = of.select("of", "key").distinct().join(people, "of").select("key", "people")
    packed = m.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "content"))).alias("m"))
    packed = packed.join(lists, "key").select("key", "m", F.explode("people").alias("participant"))
    own = lambda x: x["speaker"] == F.col("participant")
    head = lambda x: F.when(own(x), F.lit("<|assistant|>\n")).when(x["speaker"].isin(*context), F.concat(F.lit(OPEN), x["speaker"], F.lit("|>\n"))).otherwise(
        F.concat(F.lit("<|user|>\n"), _safe(x["speaker"]), F.lit(": ")))
    body = lambda x: F.concat(_safe(x["content"]), F.lit(END + "\n"))
    packed = packed.withColumn("m", F.transform("m", lambda x: F.struct(head(x).alias("head"), body(x).alias("body"), own(x).alias("target"))))
    kind = "struct<at:int,spans:array<struct<first:int,end:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().alias("spans")).cast(kind)

    def add(held: Column, x: Column) -> Column:
        first = held["at"] + F.length(x["head"])
        end = first + F.length(x["body"])
        span = F.array(F.struct(first.alias("first"), (end - 1).alias("end")))
        return F.struct(end.alias("at"), F.when(x["target"], F.concat(held["spans"], span)).otherwise(held["spans"]).alias("spans"))
    return packed.select(
        F.col("key.conv").alias(conv_col), "participant", F.col("key.block").alias("block"), F.col("key.part").alias("part"),
        F.size("m").cast("long").alias("messages"), F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["body"])), "").alias("text"),
        F.aggregate("m", start, add)["spans"].alias("spans"))


SQL = """
WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS content FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS participant FROM m WHERE speaker <> 'system'),
r AS (SELECT m.*, p.participant, CAST(floor(turn / 64.0) AS BIGINT) AS block, speaker = participant AS target,
  CASE WHEN speaker = participant THEN '<|assistant|>' || chr(10) WHEN speaker = 'system' THEN '<|system|>' || chr(10)
    ELSE '<|user|>' || chr(10) || replace(speaker, '<|', '< |') || ': ' END AS head,
  replace(content, '<|', '< |') || '<|end|>' || chr(10) AS body FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, participant, block ORDER BY turn, speaker, content) - 1) // 256 AS part FROM r),
s AS (SELECT *, row_number() OVER w AS k, sum(length(head) + length(body)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM o WINDOW w AS (PARTITION BY conv_id, participant, block, part ORDER BY turn, speaker, content))
SELECT conv_id, participant, block, part, count(*) AS messages, md5(string_agg(head || body, '' ORDER BY k)) AS text_md5,
  coalesce(string_agg(CAST(upto - length(body) AS BIGINT) || '-' || CAST(upto - 1 AS BIGINT), ',' ORDER BY k) FILTER (target), '') AS spans
FROM s GROUP BY conv_id, participant, block, part
"""
