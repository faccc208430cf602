"""Language identification by compression.

Every language has a zstandard raw-content dictionary of its commonest words. A whole text, lower-cased and in pieces, is
compressed with all of them; the smallest result names the language and the margin to the second says how sure it is.
Short texts differ by less than a byte, so for them sizes are summed over several dictionaries and lead-ins. How small
a margin may be is learned by length from labelled rows that the dictionaries have not seen.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, discard, stored

UNDETERMINED = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
RESULT = "lang string, score double, rejected boolean"
#: Every so many of the first training rows measure margins and teach no words.
MEASURES = 5
#: A text may have this share of the margin that all but ``RARE`` of the measured rows of its length exceed.
SHARE, RARE, LEAST_ROWS = 0.25, 0.01, 20
#: Only ties are below the margin where nothing was measured.
TIE = 1e-9
#: Texts under so many bytes are judged by the commonest words of these bytes after each of the lead-ins.
SHORT, SHORT_DICTIONARIES, LEADS, LEAD_WORDS, SHORT_LEVEL, SHORT_MATCH = 128, (65536, 16384), 16, 6, 12, 4


@dataclass(frozen=True)
class Languages:
    """Dictionaries by language, the language with most training rows first; at most ``dictionary_bytes`` each.

    ``margins`` has pairs (length class, least margin); a class holds the lengths of as many binary digits.
    """

    names: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    level: int = 6
    piece: int = 8192
    margins: tuple[tuple[int, float], ...] = ()

    def least_margin(self, length_class: int) -> float:
        """That of the longest measured class that is not longer: no text is held to the margins of longer ones."""
        return max([(k, m) for k, m in self.margins if k <= length_class], default=(0, TIE))[1]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5,
        docs_per_language: int = 400, dictionary_bytes: int = 65536) -> Languages:
    """Learn dictionaries from whole texts of a bounded sample of labelled rows, and margins from another.

    The sample: for each language the rows with the smallest hash among those whose crc32(id as text) mod ``folds``
    is not 0. Of the first 5/4 ``docs_per_language`` every fifth measures margins and the others teach words; those up
    to twice ``docs_per_language`` measure as well. Rows without id, text or language teach nothing; an empty table
    gives no language. Only the words that fit into the dictionaries and one number a length reach the driver.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    rows = rows.where((crc_mod("id", folds) != 0) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("id").alias("ids")).collect()
    sizes = {r["lang"]: r["n"] for r in counted}
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    # Hashes spread evenly: below a bound lie some four times the ids wanted, so that few are ranked however many there are.
    shares = [F.lit(x) for r in counted for x in (r["lang"], min(1.0, (8.0 * docs_per_language + 400) / r["ids"]))]
    low = F.xxhash64("id") / F.lit(2.0 ** 64) + 0.5 <= F.element_at(F.create_map(*shares), F.col("lang")) if shares else F.lit(True)
    chosen = (rows.where(low).select("id", "lang").withColumn("k", F.row_number().over(order)).where(F.col("k") <= 2 * docs_per_language)
              .groupBy("id", "lang").agg(F.min("k").alias("k")))
    # At most twice docs_per_language rows for each language, so the ids are a small side whatever the corpus.
    teaches = (F.col("k") <= docs_per_language * MEASURES // (MEASURES - 1)) & (F.col("k") % MEASURES != 0)
    both = stored(rows.join(F.broadcast(chosen), ["id", "lang"]).select("text", "lang", teaches.alias("teaches")))
    sample = both.where("teaches")
    words = sample.select("lang", F.explode(F.array_distinct(
        F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " ")), " "))).alias("word"))
    counts = words.where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), F.length("word"), "word")
    top = counts.withColumn("k", F.row_number().over(best)).where(F.col("k") <= dictionary_bytes // 2)
    lists: dict[str, list[str]] = {}
    for r in top.orderBy("lang", "k").select("lang", "word").toLocalIterator():
        lists.setdefault(r["lang"], []).append(r["word"])
    names = tuple(sorted(lists, key=lambda x: (-sizes[x], x)))
    model = Languages(names, tuple(_dictionary(lists[x], dictionary_bytes) for x in names))
    margins = _margins(both.where("NOT teaches"), model)
    discard(both)
    return replace(model, margins=margins)


def _margins(rows: DataFrame, model: Languages) -> tuple[tuple[int, float], ...]:
    """The least margin of each length class with ``LEAST_ROWS`` rightly named rows."""
    judges: list[Judge] = []

    def judged(texts: pa.Array) -> pa.Array:
        if not judges:
            judges.append(Judge(model))
        out = [judges[0].judge(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(
            (pa.string(), pa.float64(), pa.int32()))], names=["lang", "score", "length_class"])

    r = rows.select("lang", F.arrow_udf(judged, "lang string, score double, length_class int")("text").alias("r"))
    found = (r.where("lang = r.lang").groupBy("r.length_class")
             .agg(F.percentile("r.score", F.lit(RARE)).alias("low"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_ROWS))
    return tuple(sorted((x["length_class"], max(TIE, SHARE * x["low"])) for x in found.collect()))


def _dictionary(words: list[str], size: int) -> bytes:
    """The commonest words last, where a match costs least."""
    held, used = [], 0
    for w in words:
        used += len(w.encode()) + 1
        if used > size:
            break
        held.append(w)
    return " ".join(reversed(held)).encode() or b" "


class Judge:
    def __init__(self, model: Languages, min_margin: float | None = None):
        self.model, self.min_margin = model, min_margin
        self.compressors = []
        for content in model.dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(model.level)
            self.compressors.append(zstandard.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False))
        self.short = [list(self._short(content)) for content in model.dictionaries]

    @staticmethod
    def _short(content: bytes) -> Iterator[tuple[zstandard.ZstdCompressor, bytes, int]]:
        """Compressors for short texts, each with a lead-in of common words and the size of that alone."""
        words = content.decode().split()[::-1]
        leads = [" ".join(["", *words[i * LEAD_WORDS:(i + 1) * LEAD_WORDS]]).encode() for i in range(LEADS)]
        for size in SHORT_DICTIONARIES:
            d = zstandard.ZstdCompressionDict(content[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(SHORT_LEVEL, min_match=SHORT_MATCH, source_size=4 * SHORT,
                                                               dict_size=min(size, len(content)), write_content_size=False)
            d.precompute_compress(compression_params=p)
            c = zstandard.ZstdCompressor(compression_params=p, dict_data=d)
            yield from ((c, lead, len(c.compress(lead + b" "))) for lead in leads)

    def sizes(self, content: bytes) -> list[int]:
        if len(content) < SHORT:
            content = b" " + content + b" "
            return [sum(len(c.compress(lead + content)) - alone for c, lead, alone in x) for x in self.short]
        step = self.model.piece
        pieces = [content[i:i + step] for i in range(0, len(content), step)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]

    def judge(self, text: str | None) -> tuple[str, float, int]:
        """Language, margin and length class; class 0 for texts without a letter."""
        words = NOT_LETTERS.sub(" ", (text or "").lower()).split()
        if not any(c.isalpha() for w in words for c in w) or not self.compressors:
            return UNDETERMINED, 0.0, 0
        content = " ".join(words).encode()
        sizes = self.sizes(content)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = [s for i, s in enumerate(sizes) if i != best]
        margin = min(1.0, 1.0 - sizes[best] / max(1, min(others))) if others else 1.0
        return self.model.names[best], max(0.0, margin), len(content).bit_length()

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        lang, margin, length_class = self.judge(text)
        least = self.model.least_margin(length_class) if self.min_margin is None else self.min_margin
        return lang, margin, not length_class or margin < least


def identify(docs: DataFrame, model: Languages, text_col: str = "text", min_margin: float | None = None):
    """A column (lang, score, rejected) for every whole text of ``docs``.

    ``score`` is the share of the second smallest size that the smallest saves (0 to 1); ``rejected`` marks margins
    below ``min_margin``, or else below the margin learned for the text's length, and texts that are null or have no
    letter, which get the language ``und`` and score 0. Equal sizes go to the language with more training rows and are
    rejected. Only the text column goes to Python; rows
    are judged one by one, so repeated rows and extra columns change nothing.
    """
    judges: list[Judge] = []

    def judged(texts: pa.Array) -> pa.Array:
        if not judges:
            judges.append(Judge(model, min_margin))
        out = [judges[0](t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(
            (pa.string(), pa.float64(), pa.bool_()))], names=["lang", "score", "rejected"])

    return F.arrow_udf(judged, RESULT)(docs[text_col].cast("string"))
