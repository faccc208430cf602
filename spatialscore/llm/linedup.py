"""Removal of repeated line runs with a distributed suffix array, in DataFrame functions only.

Lines become IDs, and only lines that occur twice can be part of a repeated run. Prefix doubling ranks the suffixes of
all documents by their first 1, 2, 4, ... lines: a round sorts the distinct pairs of ranks of neighbouring blocks and
their order is the next rank, so equal ranks are the intervals of the suffix array with a common prefix of that many
lines. A run of m lines is the interval of the two overlapping blocks of 2^k <= m lines that it consists of.

A maximal repeated run of at least ``min_words`` words is the union of the shortest sufficient runs that start at its
lines and of those that end there, and how long these are depends on their own lines only, so every copy of a run has
the same ones. All but the first copy of each, by (id, text, line), are deleted.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, heavy_join, stored

DOC = ["id", "copy"]


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, copy, pos, h, g, w): every line as two hashes, with its number of words."""
    base = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("copy"), docs[text_col].alias("text"))
    each = base.where("text IS NOT NULL").select("id", "copy", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return each.select("id", "copy", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), words("line").alias("w"))


def words(line: str) -> Column:
    """Maximal runs of other characters than white space (fixed pattern)."""
    return F.regexp_count(F.col(line), F.lit(r"[^\x20\x09-\x0D]+"))


def ranked(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Ranks of the repeated ones among distinct pairs: their place in the sorted order, with gaps.

    Stored at once, because the number of a row depends on how the sort was cut.
    """
    twice = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(a, b)
    return stored(twice.orderBy(a, b).select(a, b, F.monotonically_increasing_id().alias("rank")))


def repeated_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Level 0 of the suffix array: (id, copy, pos, w, rank) of all lines that occur twice or more.

    Repeated rows of one id and text are one document.
    """
    every = stored(lines(docs, id_col, text_col).distinct())
    return stored(every.join(ranked(every, "h", "g"), ["h", "g"]).select(*DOC, "pos", "w", "rank"))


def sufficient_runs(level: DataFrame, min_words: int) -> DataFrame:
    """(id, copy, pos, m): the shortest runs of at least ``min_words`` words from each line on and up to each line."""
    place = Window.partitionBy(*DOC).orderBy("pos")
    rows = level.select(*DOC, "pos", "w").withColumn("seg", F.col("pos") - F.row_number().over(place))
    seg = Window.partitionBy(*DOC, "seg").orderBy("pos")
    rows = rows.withColumn("upto", F.sum("w").over(seg.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"before": F.col("upto") - F.col("w"), "last": F.lead("pos").over(seg).isNull()})

    def met(ask: Column, mark: Column, marks: Column, down: bool) -> DataFrame:
        """For every line the last mark met when marks and questions are passed in order."""
        event = lambda key, at, kind, of: F.struct(key.alias("key"), at.alias("at"), F.lit(kind).alias("kind"), of.alias("of"))
        none = F.lit(None).cast("int")
        both = F.array(event(mark, F.col("pos"), 0, none), event(ask, none, 1, F.col("pos")))
        both = F.when(F.col("last"), F.concat(both, F.array(event(marks, F.col("pos") + 1, 0, none)))).otherwise(both) if down else both
        e = rows.select(*DOC, "seg", F.explode(both).alias("e")).select(*DOC, "seg", "e.*")
        order = [F.desc("key"), "kind", F.desc("at")] if down else ["key", "kind", "at"]
        w = Window.partitionBy(*DOC, "seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return e.withColumn("met", F.last("at", ignorenulls=True).over(w)).where("kind = 1 AND met IS NOT NULL")

    # Words before a line grow with the lines, so the first end is the lowest mark that is high enough ...
    ends = met(F.col("before") + min_words, F.col("before"), F.col("upto"), True)
    # ... and the last start the highest mark that is low enough.
    starts = met(F.col("upto") - min_words, F.col("before"), F.col("upto"), False)
    runs = ends.select(*DOC, F.col("of").alias("pos"), (F.col("met") - F.col("of")).alias("m")).unionByName(
        starts.select(*DOC, F.col("met").alias("pos"), (F.col("of") - F.col("met") + 1).alias("m")))
    return runs.distinct()


def double(level: DataFrame, width: int) -> DataFrame:
    """Suffix ranks by 2 * width lines from those by ``width`` lines, as far as they repeat."""
    nxt = level.select(*DOC, (F.col("pos") - width).alias("pos"), F.col("rank").alias("rank2"))
    pairs = level.join(nxt, [*DOC, "pos"]).select(*DOC, "pos", "rank", "rank2")
    made = ranked(pairs.select(F.col("rank").alias("x"), F.col("rank2").alias("y")), "x", "y").toDF("rank", "rank2", "made")
    return stored(pairs.join(made, ["rank", "rank2"]).select(*DOC, "pos", F.col("made").alias("rank")))


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """(id, copy, removed): sorted 0-based lines of each document that belong to a later copy of a repeated run."""
    level = repeated_lines(docs, id_col, text_col)
    runs = stored(sufficient_runs(level, min_words))
    longest = runs.agg(F.max("m")).first()[0] or 0
    found, width = None, 1
    while width <= longest:
        here = runs.where((F.col("m") >= width) & (F.col("m") < 2 * width))
        tail = level.select(*DOC, F.col("pos").alias("end"), F.col("rank").alias("b"))
        same = (here.join(level.select(*DOC, "pos", F.col("rank").alias("a")), [*DOC, "pos"])
                .withColumn("end", F.col("pos") + F.col("m") - width).join(tail, [*DOC, "end"]).select(*DOC, "pos", "m", "a", "b"))
        found = same if found is None else found.unionByName(same)
        width *= 2
        if width <= longest:
            level = double(level, width // 2)
    if found is None:
        found = runs.select(*DOC, "pos", "m", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    found = stored(found)
    at = F.struct(*DOC, "pos")
    first = stored(found.groupBy("m", "a", "b").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    later = heavy_join(found, first, ["m", "a", "b"], "n", how="inner").where(at != F.col("first"))
    spans = later.groupBy(*DOC, "pos").agg(F.max("m").alias("m"))
    each = spans.select(*DOC, F.explode(F.sequence("pos", F.col("pos") + F.col("m") - 1)).alias("line")).distinct()
    return each.groupBy(*DOC).agg(F.array_sort(F.collect_list("line")).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """All rows of ``docs`` with later copies of repeated line runs deleted from their texts.

    All columns stay, with the shortened text in ``text_col``, and three follow: ``_lines`` and ``_removed``, the
    numbers of lines before and of those deleted, and ``_spans``, the 0-based lines deleted. A run counts from
    ``min_words`` words on, so a shorter repeated line stays; the first copy in the order of (id, hash of the text,
    line) stays too, so no line's text is lost altogether. Null texts stay null with 0 lines, an empty text is one
    empty line. Repeated rows of one id and text are one document and are treated alike; a row without an id has no
    place in the order and keeps all its lines. Columns may have any other names but those three. A very long text is many lines, none of which is held with others in one row. The texts are read twice and shuffled once.
    """
    removed = later_copies(docs, id_col, text_col, min_words).select(
        F.col("id").alias("_id"), F.col("copy").alias("_copy_of"), F.col("removed").alias("_spans"))
    copy = free_name(docs, "_copy")
    left = docs.withColumn(copy, F.xxhash64(docs[text_col]))
    on = left[id_col].eqNullSafe(removed["_id"]) & (left[copy] == removed["_copy_of"])
    joined = left.join(removed, on, "left").select(*[left[c] for c in docs.columns], removed["_spans"])
    parts = F.split(F.col(text_col), "\n")
    gone = F.coalesce("_spans", F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    text = F.when(F.size(gone) == 0, F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    n = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).cast("long")
    return joined.withColumns({"_lines": n, "_removed": F.size(gone).cast("long"), "_spans": gone, text_col: text})


SQL = r"""
WITH l AS (SELECT doc_id, i - 1 AS pos, s[i] AS line, len(regexp_extract_all(s[i], '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL), unnest(range(1, len(s) + 1)) AS t(i)),
pairs AS (SELECT a.doc_id AS d, a.pos AS p, b.doc_id AS e, a.pos - b.pos AS diag, a.w FROM l a JOIN l b
  ON a.line = b.line AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.pos < a.pos)),
runs AS (SELECT *, p - row_number() OVER (PARTITION BY d, e, diag ORDER BY p) AS run FROM pairs),
hit AS (SELECT DISTINCT d, p FROM (SELECT d, p, sum(w) OVER (PARTITION BY d, e, diag, run) AS total FROM runs) WHERE total >= {min_words})
SELECT doc_id, count(pos) AS n_lines, count(p) AS n_removed,
  CASE WHEN count(pos) > 0 THEN md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (p IS NULL), '')) END AS text_md5
FROM (SELECT doc_id FROM documents) LEFT JOIN l USING (doc_id) LEFT JOIN hit ON d = doc_id AND p = pos GROUP BY doc_id
"""
