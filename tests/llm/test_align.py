"""Token alignment against whole-text encodings of both libraries and plain counting."""
import gc
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SF
from spatialscore.llm import align, queries
from spatialscore.llm.bpe import byte_letters
from spatialscore.llm.common import table

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(PATH_A)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
NAMES = {i: t for t, i in A.get_vocab().items()}
BACK = {c: b for b, c in byte_letters().items()}
ALIGNER = align.Aligner(open(PATH_A, encoding="utf-8").read(), open(PATH_B, "rb").read())


def bytes_a(i):
    return bytes(BACK[c] for c in NAMES[i])


def bytes_b(i):
    p = B.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()


def brute(text):
    """(n_a, n_b, groups, links) from the decoded bytes of the whole text's tokens."""
    if not text:
        return 0, 0, "", []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    raw = (" " + text).encode()
    if b"".join(map(bytes_a, a)) != raw or b"".join(map(bytes_b, b)) != raw:
        return 0, 0, "", []
    ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for ids, f in ((a, bytes_a), (b, bytes_b))]
    links, i, j = [], 0, 0
    groups, ga, gb = [], [], []
    while i < len(a) and j < len(b):
        links.append((a[i], b[j]))
        x, y = ends[0][i], ends[1][j]
        if x <= y:
            ga.append(str(a[i]))
            i += 1
        if y <= x:
            gb.append(str(b[j]))
            j += 1
        if x == y:
            groups.append(",".join(ga) + "|" + ",".join(gb))
            ga, gb = [], []
    return len(a), len(b), ";".join(groups), links


def same(text):
    n_a, n_b, groups, links = next(ALIGNER.rows([text]))
    got = Counter((int(k >> 32), int(k & 0xFFFFFFFF)) for k in links)
    want = brute(text)
    assert (n_a, n_b, groups) == want[:3]
    assert got == Counter(want[3])


@pytest.mark.parametrize("text", [None, "", " ", "  ", "a", " a", "a  b   c ", "<|endoftext|> <s></s> <unk> x", "<0x41> b", "a\n b \nc\t d", "漢字🙂👩‍👧 ½²٣",
                                  "naïve café 漢", "a▁b c", "▁", "x ▁ y", "é" * 500, "ab" * 3000 + " " * 70 + "!" * 900, "\x00\x01 \x7f", "\x1c a \x85 b",
                                  "﻿ hi\xad", "🙂 🙂 🙂", "é á", "ﬁ ① Å", "a\r\nb \r c", " lead", "trail ", "  x 　y"])
def test_odd_texts_as_whole_text_encodings(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=50))
def test_any_text_as_whole_text_encodings(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["the", "Haus", "é", "漢字", "🙂", "\n", "  ", "it's", "½", "x▁", "don't.", "\t"]), max_size=25).map(" ".join))
def test_blanks_between_words_as_whole_text_encodings(text):
    same(text)


def test_spans_give_the_cuts_of_decoded_bytes():
    """Cuts from spans, refined inside characters only, are the running sums of decoded lengths."""
    for text in ["plain words here", "漢字🙂 é 😀😀 ñandú", "à \U0001F468‍\U0001F469 z"]:
        ids_a, cut_a, ids_b, cut_b = ALIGNER.spans(text)
        assert cut_a.tolist() == np.cumsum([len(bytes_a(i)) for i in ids_a.tolist()]).tolist()
        assert cut_b.tolist() == np.cumsum([len(bytes_b(i)) for i in ids_b.tolist()]).tolist()
    assert align.cuts(np.array([0, 2, 2, 2]), np.array([2, 2, 2, 5]), np.array([2, 1, 1, 1])).tolist() == [2, 3, 4, 5]
    assert align.cuts(np.array([0, 0, 0, 3]), np.array([3, 3, 3, 4]), np.array([1, 1, 1, 1])).tolist() == [1, 2, 3, 4]


def test_memory_change_keeps_results(monkeypatch):
    monkeypatch.setattr(align, "REMEMBERED_WORDS", 2)
    small = align.Aligner(open(PATH_A, encoding="utf-8").read(), open(PATH_B, "rb").read())
    texts = ["one two three four", "two one five", None, "one two six ▁", "five " * 40]
    for _ in range(2):
        assert [r[:3] for r in small.rows(texts)] == [brute(t)[:3] for t in texts]


def whole_result(rows):
    """The contract's columns by plain counting over all rows (id, text)."""
    found = [(i, brute(t)) for i, t in rows]
    count = Counter(p for _, f in found for p in set(f[3]))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    return sorted((str(i), f[0], f[1], f[2].count(";") + 1 if f[2] else 0, len(f[3]), sum(count[p] == best[p[0]] for p in f[3]), sum(count[p] for p in f[3]),
                   hashlib.sha256(f[2].encode()).hexdigest() if f[2] else "") for i, f in found)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_registered_query_against_plain_counting(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    got = queries.op11_align(spark, SF)
    assert set(COLUMNS) == set(got.columns)
    assert dict(got.dtypes) == {c: "string" if c == "groups_sha256" else "bigint" for c in COLUMNS}
    assert sorted((str(r[0]), *r[1:]) for r in got.select(*COLUMNS).collect()) == whole_result(rows)


def test_rare_pairs_join_as_broadcast_ones(spark):
    """Nulls, empty texts, repeated rows and ids, clashing names; any share of the pairs may be broadcast."""
    rows = [(1, "the cat sat"), (1, "the cat sat"), (None, "the dog"), (2, None), (3, ""), (4, "the 漢 cat ▁"), (5, "the " * 300), (6, "漢字 é the cat")]
    d = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, a int, _row string")
    want = [(r[0], *r[5:7]) for r in whole_result(rows)]
    for most in (0, 3, 1000):
        out = align.scored(align.alignments(d, PATH_A, PATH_B), most_broadcast=most)
        assert sorted((str(r["doc_id"]), r["n_best"], r["count_sum"]) for r in out.collect()) == sorted(want)
    empty = align.scored(align.alignments(d.limit(0), PATH_A, PATH_B))
    assert empty.count() == 0 and "n_best" in empty.columns


def test_new_words_are_made_from_known_parts_without_collections():
    """F op11: parts met before are not encoded again, and no collection walks through the words."""
    aligner = align.Aligner(open(PATH_A, encoding="utf-8").read(), open(PATH_B, "rb").read())
    sent = []
    spans = aligner.spans
    aligner.spans = lambda text: sent.append((text, gc.isenabled())) or spans(text)
    made = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{end}" for i in range(600)) for end in ("", ".", ",")]
    odd = ["a.\nB", "don't.", "don'.t", "<|endoftext|>x.", "</s>.", "é.\nÉ", "a\n\nb", "a\n", "b\r\nc.", "ab²..", "a.́b", "x-y;z\nA"]
    got = list(aligner.rows(made[:1])) + list(aligner.rows(made[1:] + odd))
    assert sum(len(text) for text, _ in sent) < 1.5 * len(made[0]) and not any(on for _, on in sent) and gc.isenabled()
    for text, (n_a, n_b, groups, links) in zip(made + odd, got):
        assert (n_a, n_b, groups, [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in links]) == brute(text)
