"""Alignment of the tokens of two tokenizers by the bytes that they stand for.

A is a byte-level BPE of the tokenizers library, which gives spans in characters; B a sentencepiece model, whose proto
gives spans in bytes. A span that is whole cuts the text as it is; where tokens share a character (A) or have an empty
span (a byte of B's byte fallback), the cuts inside follow from the tokens' decoded bytes. A text counts only if the
decoded bytes of all its tokens are the text.

No token of either side reaches over a single blank between two other characters (checked when B is loaded), so texts
are cut there, a word is aligned once, many new words a call, and each Python worker remembers a bounded number. Nor
does a token reach from a letter over the punctuation or the line end behind it (checked too), so a new word is made
from its parts: only parts not met before go to the tokenizers.
"""
from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_letters
from .common import stored

#: A blank that no token of either side reaches over.
BREAK = re.compile(r"(?<=\S) (?=\S)")
#: Places inside a word that no token of either side reaches over: behind a letter before punctuation, and around a
#: single line end before a letter. Apostrophes (A's contractions) and the signs of special tokens are not among these.
_LETTER, _SIGN = "A-Za-zÀ-ÖØ-öø-ÿ", re.escape("!\"#$%&()*+,-./:;=?@[]")
PARTS = re.compile(rf"(?<=[{_LETTER}])(?=[{_SIGN}])|(?<=[{_LETTER}{_SIGN}])(?=\n[{_LETTER}])|(?<=[{_LETTER}{_SIGN}]\n)(?=[{_LETTER}])")
#: B's letter for a blank, a fixed value of the model format.
BLANK = "▁"
#: Words in each of a worker's two memories; when the newer is full it becomes the older, which changes no result.
REMEMBERED_WORDS = 200_000
REMEMBERED_PARTS = 50_000
REMEMBERED_LENGTH = 64
WORDS_AT_ONCE, ROWS_AT_ONCE, PAIRS_AT_ONCE = 2048, 256, 8_000_000
#: Pairs of ids whose counts are broadcast (17 bytes each); the counts of all others are joined by shuffle.
BROADCAST_PAIRS = 1 << 20


@contextmanager
def uncollected() -> Iterator[None]:
    """No cyclic garbage collection inside: what words are made of has no cycles, yet each new one would be visited."""
    collecting = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if collecting:
            gc.enable()


class Bytes:
    """Decoded bytes of every id of one tokenizer."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.table = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        shift = self.starts[ids] - (np.cumsum(lengths) - lengths)
        return self.table[np.repeat(shift, lengths) + np.arange(lengths.sum())].tobytes()


def cuts(begin: np.ndarray, end: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Byte offsets where tokens end, from spans in bytes and decoded lengths.

    A token whose span is not empty and does not reach into the next one's ends where its span ends. The others end
    their decoded bytes after the last such cut.
    """
    whole = end > begin
    whole[:-1] &= begin[1:] >= end[:-1]
    at = np.arange(len(end))
    last = np.maximum.accumulate(np.where(whole, at, -1))
    total = np.cumsum(lengths)
    base_end, base_total = np.append(end, 0)[last], np.append(total, 0)[last]
    return np.where(whole, end, base_end + total - base_total)


#: Alignment of one word: its number of A tokens, its groups as text and its links, packed (A id << 32 | B id).
Word = tuple[int, str, bytes]


class Aligner:
    """Both tokenizers and the words aligned so far."""

    def __init__(self, spec: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        back = {c: i for i, c in byte_letters().items()}
        of_id = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = Bytes([bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
                              for t in (of_id.get(i, "") for i in range(max(of_id) + 1))])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = Bytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode()
                              for i, p in enumerate(pieces)])
        # Ids as text with what follows them: a comma within a group, else the end of the side.
        self.text = {(side, end): np.array([f"{i}{end}" for i in range(n)], dtype=object)
                     for side, n, last in (("a", max(of_id) + 1, "|"), ("b", len(pieces), ";")) for end in (",", last)}
        spec = json.loads(spec)
        before = spec.get("pre_tokenizer") or {}
        self.breaks = (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
                       and not any(BLANK in p.lstrip(BLANK) for p in pieces))
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.parts = self.breaks and not any(PARTS.search(t) for t in chain(pieces, added))
        self.behind: dict[str, Word | None] = {}
        self.known: dict[str, Word | None] = {}
        self.older: dict[str, Word | None] = {}

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(A ids, A cuts, B ids, B cuts) of a blank and ``text``; None where the bytes of a side differ from it."""
        raw = (" " + text).encode()
        enc = self.a.encode(" " + text, add_special_tokens=False)
        ids_a = np.array(enc.ids, dtype=np.int64)
        if self.bytes_a.joined(ids_a) != raw:
            return None
        span = np.fromiter(chain.from_iterable(enc.offsets), dtype=np.int64, count=2 * len(ids_a)).reshape(-1, 2)
        if len(raw) > len(text) + 1:
            point = np.frombuffer((" " + text).encode("utf-32-le"), dtype="<u4")
            wide = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
            span = np.concatenate([[0], np.cumsum(wide)])[span]
        proto = chain.from_iterable((p.id, p.begin, p.end) for p in self.b.encode(text, return_type="proto").pieces)
        ids_b, begin, end = np.fromiter(proto, dtype=np.int64).reshape(-1, 3).T
        if self.bytes_b.joined(ids_b) != raw:
            return None
        # B's spans do not count the blank that it puts in front.
        begin, end = np.where(begin > 0, begin + 1, 0), np.where(end > 0, end + 1, 0)
        return (ids_a, cuts(span[:, 0], span[:, 1], self.bytes_a.lengths[ids_a]), ids_b, cuts(begin, end, self.bytes_b.lengths[ids_b]))

    def aligned(self, words: list[tuple[str, ...]]) -> list[list[Word | None]]:
        """Alignments of the parts of words in one call each of the libraries; None if a side does not give a word back."""
        found = self.spans(" ".join(["".join(parts) for parts in words]))
        if found is None:
            return [[None] * len(words[0])] if len(words) == 1 else [self.aligned([parts])[0] for parts in words]
        ids_a, cut_a, ids_b, cut_b = found
        ends = np.cumsum([len(part.encode()) + (k == 0) for parts in words for k, part in enumerate(parts)])
        in_a, in_b = np.zeros((2, ends[-1] + 1), dtype=bool)
        in_a[cut_a] = in_b[cut_b] = True
        both, every = np.flatnonzero(in_a & in_b), np.flatnonzero(in_a | in_b)
        links = ids_a[np.searchsorted(cut_a, every)] << 32 | ids_b[np.searchsorted(cut_b, every)]
        group_a, group_b = np.searchsorted(both, cut_a), np.searchsorted(both, cut_b)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        shown = np.concatenate([np.where(last_a, self.text["a", "|"][ids_a], self.text["a", ","][ids_a]),
                                np.where(last_b, self.text["b", ";"][ids_b], self.text["b", ","][ids_b])])[order].tolist()
        tokens, linked = np.searchsorted(cut_a, ends) + 1, np.searchsorted(every, ends) + 1
        upto = (tokens + np.searchsorted(cut_b, ends) + 1).tolist()
        packed, flat, i, j, k = links.tobytes(), [], 0, 0, 0
        for n, p, q in zip(tokens.tolist(), upto, (8 * linked).tolist()):
            flat.append((n - i, "".join(shown[j:p])[:-1], packed[k:q]))
            i, j, k = n, p, q
        each = iter(flat)
        return [list(islice(each, len(parts))) for parts in words]

    def learn(self, words: set[str]) -> dict[str, Word | None]:
        """Alignments of the words not known yet; short ones are remembered."""
        new: dict[str, Word | None] = {}
        plain, made, behind = set(), [], set()
        for w in words:
            if w in self.known:
                new[w] = self.known[w]
            elif w in self.older:
                new[w] = self.older[w]
            elif w and len(w) <= REMEMBERED_LENGTH and not w[0].isspace() and not w[-1].isspace() and BLANK not in w:
                parts = PARTS.split(w) if self.parts else [w]
                plain.add(parts[0])
                if len(parts) > 1:
                    made.append((w, parts))
                    behind.update(parts[1:])
            else:
                new[w] = self.aligned([(w,)])[0][0]
        for store in (self.known, self.older, new):
            new.update((w, store[w]) for w in plain if w in store)
        plain = [w for w in plain if w not in new]
        for start in range(0, len(plain), WORDS_AT_ONCE):
            part = plain[start:start + WORDS_AT_ONCE]
            new.update(zip(part, [x for x, in self.aligned([(w,) for w in part])]))
        if made:
            after = self.parts_behind(behind)
            for w, parts in made:
                cells = [new[parts[0]], *[after[p] for p in parts[1:]]]
                new[w] = None if None in cells else (sum(c[0] for c in cells), ";".join([c[1] for c in cells]), b"".join([c[2] for c in cells]))
        if len(self.known) + len(new) > REMEMBERED_WORDS:
            self.older, self.known = self.known, {}
        self.known.update((w, x) for w, x in new.items() if len(w) <= REMEMBERED_LENGTH)
        return new

    def parts_behind(self, parts: set[str]) -> dict[str, Word | None]:
        """Alignments of parts that follow others in a word: aligned behind a letter, or a letter and a line end."""
        out = {p: self.behind[p] for p in parts if p in self.behind}
        new = [p for p in parts if p not in out]
        for start in range(0, len(new), WORDS_AT_ONCE):
            part = new[start:start + WORDS_AT_ONCE]
            found = self.aligned([("a", p, "a") if p == "\n" else ("a", "\n", p) if p[0].isalpha() else ("a", p) for p in part])
            out.update((p, x[1] if p == "\n" else x[-1]) for p, x in zip(part, found))
        if len(self.behind) + len(new) > REMEMBERED_PARTS:
            self.behind = {}
        self.behind.update((p, out[p]) for p in new)
        return out

    def rows(self, texts: list[str | None]) -> Iterator[tuple[int, int, str, np.ndarray]]:
        """(tokens of A, tokens of B, groups, links) of every text."""
        with uncollected():
            split = [(BREAK.split(t) if self.breaks else [t]) if t else [] for t in texts]
            found = [list(map(self.known.get, words)) for words in split]
            new = self.learn({w for words, cells in zip(split, found) for w, c in zip(words, cells) if c is None})
            for words, cells in zip(split, found):
                if None in cells:
                    cells = [new[w] if c is None else c for w, c in zip(words, cells)]
                if not cells or None in cells:
                    yield 0, 0, "", np.zeros(0, dtype=np.int64)
                    continue
                counts, texts, packed = zip(*cells)
                n_a, groups, links = sum(counts), ";".join(texts), np.frombuffer(b"".join(packed), dtype=np.int64)
                yield n_a, len(links) + groups.count(";") + 1 - n_a, groups, links


_ALIGNERS: dict[int, Aligner] = {}


def _aligner(source: Broadcast) -> Aligner:
    key = hash(source.value)
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(*source.value)
    return _ALIGNERS[key]


def shared_files(spark: SparkSession, path_a: str, path_b: str) -> Broadcast:
    """Both tokenizer files, read on the driver (a few MB whatever the corpus) and sent to every executor once."""
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: (id_col, n_a, n_b, n_groups, n_links, groups, a, b, times).

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids of A and B between places where tokens of both end. ``a``, ``b`` and
    ``times`` list the distinct linked pairs of ids, whose bytes overlap, and how often each is linked. Texts that are
    null, empty or not given back byte for byte by a side have no tokens, an empty string and empty lists. One narrow
    pass; repeated rows stay repeated rows, other columns are not read, and a very long text is cut at blanks.
    """
    source = shared_files(docs.sparkSession, path_a, path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(source)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                numbers, groups, keys, times = [], [], [], []
                for n_a, n_b, text, links in aligner.rows(batch.column(1).to_pylist()):
                    distinct, n = np.unique(links, return_counts=True)
                    numbers.append((n_a, n_b, n_a + n_b - len(links), len(links)))
                    groups.append(text)
                    keys.append(distinct)
                    times.append(n)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
                key, number = np.concatenate(keys), np.array(numbers, dtype=np.int64)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32)))
                         for x in (key >> 32, key & 0xFFFFFFFF, np.concatenate(times))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in number.T), pa.array(groups, pa.string()), *lists],
                    names=["id", "n_a", "n_b", "n_groups", "n_links", "groups", "a", "b", "times"])

    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    long, ints = T.LongType(), T.ArrayType(T.IntegerType())
    schema = T.StructType([narrow.schema["id"], *(T.StructField(c, long) for c in ("n_a", "n_b", "n_groups", "n_links")),
                           T.StructField("groups", T.StringType()), *(T.StructField(c, ints) for c in ("a", "b", "times"))])
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _keys(batch: pa.RecordBatch, a: str = "a", b: str = "b") -> np.ndarray:
    """Packed pairs of all rows of a batch."""
    x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (a, b))
    return x << 32 | y


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): texts that hold a pair linked, and whether no pair of the same A id is held by more.

    Each task adds up its texts before the shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([held, *waiting])
            weights = np.concatenate([n, np.ones(len(keys) - len(held), np.int64)])
            distinct, at = np.unique(keys, return_inverse=True)
            return distinct, np.bincount(at, weights=weights, minlength=len(distinct)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for s in range(0, len(held), 100_000):
                k = held[s:s + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array((k >> 32).astype(np.int32)), pa.array((k & 0xFFFFFFFF).astype(np.int32)),
                                                  pa.array(n[s:s + 100_000])], names=["a", "b", "n"])
        for batch in batches:
            waiting.append(_keys(batch))
            size += len(waiting[-1])
            if size >= PAIRS_AT_ONCE // 4:
                held, n = added()
                waiting, size = [], 0
                if len(held) >= PAIRS_AT_ONCE:
                    yield from out()
                    held, n = held[:0], n[:0]
        held, n = added()
        yield from out()

    counts = aligned.select("a", "b").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = stored(counts)
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return stored(counts.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best")))


def least_broadcast(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs have a count of it or more."""
    steps = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("pairs")).collect()
    total = 0
    for step, pairs in sorted(((r["step"], r["pairs"]) for r in steps), reverse=True):
        if total + pairs > most:
            return 1 << (step + 1)
        total += pairs
    return 1


def scored(aligned: DataFrame, most_broadcast: int = BROADCAST_PAIRS) -> DataFrame:
    """``aligned`` with n_best and count_sum in place of its lists.

    ``count_sum`` adds the corpus-wide count of the pair over all links; ``n_best`` counts the links whose pair has the
    highest count of its A id. Pairs with high counts, ``most_broadcast`` at most, are looked up in a broadcast table;
    all others are joined by pair, where no key has more rows than the least count broadcast.
    """
    spark = aligned.sparkSession
    rows = stored(aligned.withColumn("_row", F.monotonically_increasing_id()))
    counts = pair_counts(rows)
    least = least_broadcast(counts, most_broadcast)
    model = counts.where(F.col("n") >= least).toPandas()
    key = model["a"].to_numpy(np.int64) << 32 | model["b"].to_numpy(np.int64)
    order = np.argsort(key)
    table = spark.sparkContext.broadcast((key[order], model["n"].to_numpy(np.int64)[order], model["best"].to_numpy(bool)[order]))

    def looked_up(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place in the table of every pair, whether it is there, its times and its row within the batch."""
        keys = _keys(batch)
        times = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.diff(batch.column("times").offsets.to_numpy())
        held = table.value[0]
        at = np.searchsorted(held, keys)
        there = at < len(held)
        there[there] = held[at[there]] == keys[there]
        return at, there, times, np.repeat(np.arange(batch.num_rows), sizes)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, best = table.value
        for batch in batches:
            at, there, times, row = looked_up(batch)
            sums, bests = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, row[there], times[there] * n[at[there]])
            np.add.at(bests, row[there], times[there] * best[at[there]])
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(bests), pa.array(sums)], names=["_row", "n_best", "count_sum"])

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, there, times, row = looked_up(batch)
            lost = ~there
            keys = _keys(batch)[lost]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row").take(pa.array(row[lost])), pa.array((keys >> 32).astype(np.int32)),
                 pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(times[lost])], names=["_row", "a", "b", "times"])

    lists = rows.select("_row", "a", "b", "times")
    sums = lists.mapInArrow(known, "_row long, n_best long, count_sum long")
    rare = lists.mapInArrow(other, "_row long, a int, b int, times long").join(counts.where(F.col("n") < least), ["a", "b"])
    rare = rare.groupBy("_row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"),
                                    F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    sums = sums.unionByName(rare).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("a", "b", "times").join(sums, "_row").drop("_row")
