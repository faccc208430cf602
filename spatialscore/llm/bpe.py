"""Byte-level BPE encoding and decoding of whole texts.

Each word keeps a segment tree over the ranks of its adjacent token pairs. The root holds the lowest rank and,
among equal ranks, the leftmost position; a merge changes three leaves and the paths above them, so a word of n
bytes takes O(n log n) steps however long it is. Words repeat, so each Python worker remembers a bounded number.
"""
from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Fixed values of the tokenizer file's byte-level splitter.
WORDS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
# The same for texts of Latin-1 without its numeric signs, where the standard module is twice as fast.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9", "\t-\r \x85\xa0"
LATIN_WORDS = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+"
               rf"|[{_S}]+(?![^{_S}])|[{_S}]+")
LATIN_NUMERIC = "\xb2\xb3\xb9\xbc\xbd\xbe"
NO_PAIR = 1 << 62
POSITION = (1 << 32) - 1
DECODED_AT_ONCE, WORDS_AT_ONCE = 1 << 20, 1 << 12
#: Words in each of a worker's two memories; when the newer is full it becomes the older, which changes no result.
REMEMBERED_WORDS = 500_000
#: Longer words are worked out anew.
REMEMBERED_LENGTH = 64


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def pair_tree(leaves: list[int]) -> tuple[list[int] | array, int]:
    """Segment tree of minima over (rank, position) keys and the index of its first leaf; tree[1] is the root."""
    n = len(leaves)
    size = 1 << (n - 1).bit_length()
    kind = list if size <= 1024 else lambda x: array("q", x)
    tree = kind([NO_PAIR]) * size + kind(leaves) + kind([NO_PAIR]) * (size - n)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    return tree, size


def put(tree: list[int] | array, i: int, key: int) -> None:
    """Set leaf ``i`` and renew the minima above it, as far as they change."""
    tree[i] = key
    while i > 1:
        other = tree[i ^ 1]
        if other < key:
            key = other
        i >>= 1
        if tree[i] == key:
            return
        tree[i] = key


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, spec: dict):
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in letters.items()}
        self.first = [vocab[letters[b]] for b in range(256)]
        #: Key of a pair of ids: its rank above 32 bits for the position.
        self.key_of: dict[int, int] = {}
        self.made: list[int] = []
        for pair in spec["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.key_of[vocab[a] << 32 | vocab[b]] = len(self.made) << 32
            self.made.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        spoken = vocab | self.special
        held = [b""] * (max(spoken.values()) + 1)
        for token, i in spoken.items():
            held[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.lengths = np.array([len(x) for x in held], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.table = np.frombuffer(b"".join(held), dtype=np.uint8)
        self.words = regex.compile(WORDS)
        self.latin_words = re.compile(LATIN_WORDS)
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the lowest-rank leftmost merge until no adjacent pair has a rank."""
        n = len(ids)
        if n < 2:
            return ids
        key_of, made = self.key_of.get, self.made
        tree, first = pair_tree([key_of(a << 32 | b, NO_PAIR) + i for i, (a, b) in enumerate(zip(ids, ids[1:]))])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (low := tree[1]) < NO_PAIR:
            i = low & POSITION
            gone = after[i]
            ids[i] = token = made[low >> 32]
            ids[gone] = -1
            after[i] = nxt = after[gone]
            if nxt < n:
                put(tree, first + gone, NO_PAIR)
                before[nxt] = i
                put(tree, first + i, key_of(token << 32 | ids[nxt], NO_PAIR) + i)
            else:
                put(tree, first + i, NO_PAIR)
            if (p := before[i]) >= 0:
                put(tree, first + p, key_of(ids[p] << 32 | token, NO_PAIR) + p)
        return [i for i in ids if i >= 0]

    def word(self, word: str) -> bytes:
        """Ids of one word as little-endian unsigned 32-bit integers."""
        packed = self.older.get(word)
        if packed is None:
            first = self.first
            packed = array("I", self.merge([first[b] for b in word.encode()])).tobytes()
        if len(word) <= REMEMBERED_LENGTH:
            if len(self.known) >= REMEMBERED_WORDS:
                self.older, self.known = self.known, {}
            self.known[word] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a whole text; a special token's string stands for its id."""
        out, start = [], 0
        text = text or ""
        for m in self.split.finditer(text) if self.special else ():
            out.append(self._plain(text[start:m.start()]))
            out.append(np.uint32(self.special[m[0]]).astype("<u4").tobytes())
            start = m.end()
        out.append(self._plain(text[start:] if start else text))
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        word = self.word
        find = self.latin_words.findall if plain_latin(text) else self.words.findall
        parts = []
        for start in range(0, len(words := find(text)), WORDS_AT_ONCE):
            known = self.known
            parts += [known.get(w) or word(w) for w in words[start:start + WORDS_AT_ONCE]]
        return b"".join(parts)

    def decode(self, packed: bytes) -> str:
        """Text of packed ids: the bytes of all tokens are gathered from one table, a block of ids at a time."""
        out = []
        for start in range(0, len(packed), 4 * DECODED_AT_ONCE):
            ids = np.frombuffer(packed[start:start + 4 * DECODED_AT_ONCE], dtype="<u4")
            ids = ids[ids < len(self.lengths)]
            lengths = self.lengths[ids]
            shift = self.starts[ids] - (np.cumsum(lengths) - lengths)
            out.append(self.table[np.repeat(shift, lengths) + np.arange(lengths.sum())].tobytes())
        return b"".join(out).decode("utf-8", errors="replace")


def plain_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return text.isascii() or not any(c in text for c in LATIN_NUMERIC)


def shared_codec(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file, read on the driver (a few MB whatever the corpus) and sent to every executor once."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


_CODECS: dict[int, tuple[str, Codec]] = {}


def _codec(source: Broadcast) -> Codec:
    text = source.value
    held = _CODECS.get(hash(text))
    if held is None or held[0] != text:
        _CODECS.clear()
        _CODECS[hash(text)] = held = (text, Codec(json.loads(text)))
    return held[1]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text: (id_col, ids array<int>); null texts count as empty and give no ids.

    One narrow pass without a shuffle. Repeated rows stay repeated rows; other columns are not read.
    """
    source = shared_codec(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(source)
        for batch in batches:
            ids = [np.frombuffer(codec.encode(t), dtype="<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([narrow.schema["id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return narrow.mapInArrow(run, schema).toDF(id_col, "ids")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of token ids: (id_col, text); null ids give an empty text, ids out of the vocabulary add nothing."""
    source = shared_codec(tokens.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(source)
        for batch in batches:
            texts = [codec.decode(np.array(ids or [], dtype="<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    narrow = tokens.select(tokens[id_col].alias("id"), tokens[ids_col].alias("ids"))
    schema = T.StructType([narrow.schema["id"], T.StructField("text", T.StringType())])
    return narrow.mapInArrow(run, schema).toDF(id_col, "text")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass and keep the digests of both.

    Columns: id_col, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256 (UTF-8).
    Null texts count as empty; ties and repeated rows are worked out row by row.
    """
    source = shared_codec(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(source)
        for batch in batches:
            n, ids, texts = [], [], []
            for text in batch.column(1):
                packed = codec.encode(text.as_py())
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                texts.append(hashlib.sha256(codec.decode(packed).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts)],
                                             names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([narrow.schema["id"], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return narrow.mapInArrow(run, schema).toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")
