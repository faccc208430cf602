"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window of ``n`` words holds w = n - k + 1 overlapping k-grams; its smallest k-gram hash is its fingerprint. Equal
windows have equal fingerprints at equal places, so joining the fingerprints of documents and items finds every shared
span of n words, and each hit is then extended word by word to the windows of n words around it.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, rows_at_most, stored

# Fixed pattern: what separates words. A-Z are words too and are lower-cased afterwards.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, GRAM = 10, 7
#: Sieve of hash values with a fixed number of bits; it only saves work.
SIEVE_LONGS = 4096
#: Item fingerprints up to this number are broadcast (24 bytes and a few words each), more are joined by shuffle.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; none for null."""
    def lower(w: Column) -> Column:
        return F.when(F.length(w) == F.octet_length(w), F.lower(w)).otherwise(ascii_lower(w))
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN_WORDS), lambda w: w != ""), lower)


def _ahead(a: Column, b: Column, join) -> Column:
    """Combine the start of ``a`` with the shorter ``b``, position by position."""
    return F.zip_with(F.slice(a, 1, F.size(b)), b, join)


def _shift(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def _doubled(df: DataFrame, source: str, width: int, out: str, join) -> DataFrame:
    """Combine every ``width`` neighbours of an array by overlapping pieces of doubled width."""
    df, done, k = df.withColumn(f"{out}0", F.col(source)), 1, 0
    while done < width:
        step = min(done, width - done)
        df = df.withColumn(f"_{out}{k}", _shift(F.col(f"{out}{k}"), step))
        df = df.withColumn(f"{out}{k + 1}", _ahead(F.col(f"{out}{k}"), F.col(f"_{out}{k}"), join)).drop(f"{out}{k}", f"_{out}{k}")
        done, k = done + step, k + 1
    return df.withColumnRenamed(f"{out}{k}", out)


def winnowed(df: DataFrame) -> DataFrame:
    """Add ``g``, the hashes of all GRAM-word grams of ``words``, and ``m``, the smallest of every window."""
    df = _doubled(df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))), "h", GRAM, "g", lambda a, b: F.xxhash64(a, b))
    return _doubled(df, "g", WINDOW - GRAM + 1, "m", lambda a, b: F.least(a, b))


def folded(hashes: Column, n: int) -> Column:
    """Hash of every ``n`` neighbouring words, folded from the left; for items shorter than a window."""
    out = hashes
    for step in range(1, n):
        out = _ahead(out, _shift(hashes, step), lambda a, b: F.xxhash64(a, b))
    return out


def _place(window: Column, low: Column) -> Column:
    """0-based position of the gram that gave a window its fingerprint, the leftmost of equal ones."""
    return window + F.array_position(F.slice("g", window + 1, WINDOW - GRAM + 1), low).cast("int") - 1


def _context(length: Column, at: Column) -> Column:
    """The words that any window around a gram can hold, and the gram's offset in them."""
    reach = WINDOW - GRAM
    first = F.when(length == 0, F.greatest(at - reach, F.lit(0))).otherwise(at)
    size = F.when(length == 0, at - first + WINDOW).otherwise(length)
    return F.struct(length.alias("len"), at.alias("at"), (at - first).alias("off"), F.slice("words", first + 1, size).alias("around"))


def item_grams(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Winnowed fingerprints of all items: (item_id, fp, len, at, off, around).

    ``len`` is 0 for items of WINDOW words or more; a shorter one is a single gram of ``len`` words. Items without
    words give no row.
    """
    base = items.select(items[id_col].cast("string").alias("item_id"), words(items[text_col]).alias("words"))
    n = F.size("words")
    long = winnowed(base.where(n >= WINDOW)).select("item_id", "words", "g", F.posexplode_outer("m").alias("w", "fp")).select(
        "item_id", "fp", "words", F.lit(0).alias("len"), _place(F.col("w"), F.col("fp")).alias("at"))
    short = base.where((n > 0) & (n < WINDOW)).select("item_id", F.transform("words", lambda w: F.xxhash64(w)).alias("h"), "words", n.alias("len"))
    short = short.select("item_id", F.aggregate(F.slice("h", 2, WINDOW), F.element_at("h", 1), lambda a, b: F.xxhash64(a, b)).alias("fp"),
                         "words", "len", F.lit(0).alias("at"))
    both = long.unionByName(short)
    return both.select("item_id", "fp", _context(F.col("len"), F.col("at")).alias("c")).select("item_id", "fp", "c.*").distinct()


def _sieve(grams: DataFrame) -> Column:
    """Literal bits of which fingerprint hashes occur; bounded by SIEVE_LONGS whatever the benchmark."""
    bit = F.pmod("fp", F.lit(SIEVE_LONGS * 64)).cast("int")
    held = np.zeros(SIEVE_LONGS, dtype=np.int64)
    for r in (grams.select(F.shiftright(bit, 6).alias("i"), F.expr("shiftleft(1L, cast(pmod(fp, 64) AS int))").alias("b"))
              .groupBy("i").agg(F.bit_or("b").alias("b")).collect()):
        held[r["i"]] = r["b"]
    return F.lit(held)


def _candidates(hashes: str, sieve: Column, length: int) -> Column:
    """(len, fp, at) of the hashes that pass the sieve, each gram once."""
    def passing(x: Column, i: Column) -> Column:
        b = F.pmod(x, F.lit(SIEVE_LONGS * 64)).cast("int")
        hit = F.call_function("shiftright", F.get(sieve, F.shiftright(b, 6)), b.bitwiseAND(63)).bitwiseAND(1) == 1
        return F.when(hit, F.struct(F.lit(length).alias("len"), x.alias("fp"), i.alias("at")))
    passed = F.filter(F.transform(hashes, passing), lambda x: x.isNotNull())
    if length:
        return passed
    return F.array_distinct(F.transform(passed, lambda c: F.struct(c["len"].alias("len"), c["fp"].alias("fp"), _place(c["at"], c["fp"]).alias("at"))))


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: (id_col, n_words, spans, item_ids).

    ``spans`` are the merged 0-based word ranges (first, last) that lie inside an occurrence of an item window,
    ``item_ids`` the items with occurring windows, as sorted strings. Null and wordless texts have no words and no
    spans; so has every document if there are no items. Repeated rows of the same id and text are one document; rows
    of one id with different texts are one row each. Extra columns are not read.

    One pass over the texts. Fingerprints that pass the sieve leave it with the few words around them, so no text is
    shuffled. Items are broadcast up to BROADCAST_ROWS fingerprints and joined by shuffle beyond that.
    """
    grams = stored(item_grams(items, item_col, item_text_col))
    lengths = sorted(r["len"] for r in grams.select("len").distinct().collect())
    sieve = _sieve(grams)
    base = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("copy"), words(docs[text_col]).alias("words"))
    base = winnowed(base)
    found = [F.array().cast("array<struct<len:int,fp:bigint,at:int>>")]
    if 0 in lengths:
        found.append(_candidates("m", sieve, 0))
    for n in (x for x in lengths if x):
        base = base.withColumn(f"r{n}", folded(F.col("h"), n))
        found.append(_candidates(f"r{n}", sieve, n))
    rows = base.select("id", "copy", "words", F.size("words").cast("long").alias("n_words"), F.concat(*found).alias("found")).select(
        "id", "copy", "n_words", F.explode_outer(F.transform("found", lambda c: F.struct(
            c["fp"].alias("fp"), _context(c["len"], c["at"]).alias("d")))).alias("c"))
    # Documents without a candidate stay in the join under keys of their own that meet nothing.
    rows = rows.select("id", "copy", "n_words", F.coalesce("c.fp", F.xxhash64("id", "copy")).alias("fp"),
                       F.coalesce("c.d.len", F.lit(-1)).alias("len"), F.col("c.d").alias("d"))
    right = grams.select("fp", "len", "item_id", F.struct("off", "around").alias("i"))
    if rows_at_most(grams, BROADCAST_ROWS):
        right = F.broadcast(right)
    joined = rows.join(right, ["fp", "len"], "left").select("id", "copy", "n_words", "item_id", extended().alias("spans"))
    hit = F.size("spans") > 0
    per = joined.groupBy("id", "copy").agg(
        F.max("n_words").alias("n_words"), F.collect_set(F.when(hit, F.col("spans"))).alias("spans"),
        F.array_sort(F.collect_set(F.when(hit, F.col("item_id")))).alias("item_ids"))
    spans = merged(F.array_sort(F.array_distinct(F.flatten("spans"))))
    return per.select(F.col("id").alias(id_col), "n_words", spans.alias("spans"), "item_ids")


def extended() -> Column:
    """Ranges of the document's words that a hit grows to: every window of the item around the gram that is equal."""
    def span(first: Column, size: Column) -> Column:
        return F.struct(first.alias("first"), (first + size - 1).alias("last"))

    def grown(o: Column) -> Column:
        d, i = (F.slice(F.col(f"{x}.around"), F.col(f"{x}.off") - o + 1, WINDOW) for x in "di")
        inside = (o <= F.col("d.off")) & (o <= F.col("i.off"))
        return F.when(inside & (F.size(d) == WINDOW) & (d == i), span(F.col("d.at") - o, F.lit(WINDOW)))

    whole = F.when(F.col("d.around") == F.col("i.around"), F.array(span(F.col("d.at"), F.col("len"))))
    starts = F.array(*[F.lit(o) for o in range(WINDOW - GRAM + 1)])
    kind = "array<struct<first:int,last:int>>"
    return F.coalesce(F.when(F.col("i").isNull(), None).when(F.col("len") > 0, whole.cast(kind)).otherwise(
        F.filter(F.transform(starts, grown), lambda x: x.isNotNull()).cast(kind)), F.array().cast(kind))


def merged(raw: Column) -> Column:
    """Union of sorted ranges that overlap or touch."""
    def joined(held: Column, x: Column) -> Column:
        top = F.element_at(held, -1)
        longer = F.struct(top["first"].alias("first"), F.greatest(top["last"], x["last"]).alias("last"))
        touching = (F.size(held) > 0) & (x["first"] <= F.get(held, F.size(held) - 1)["last"] + 1)
        return F.when(touching, F.concat(F.slice(held, 1, F.size(held) - 1), F.array(longer))).otherwise(F.concat(held, F.array(x)))
    return F.aggregate(raw, F.array().cast("array<struct<first:int,last:int>>"), joined)


def covered(spans: Column) -> Column:
    """Number of words in merged ranges."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + (x["last"] - x["first"] + 1).cast("long"))
