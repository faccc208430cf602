"""Runs, near duplicates, contamination, search, chats and URLs against brute force, and the whole pipeline."""
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import compare
from conftest import SF
from spatialscore.llm import chat, decontam, graph, linedup, neardup, queries, topk, urls
from spatialscore.llm.common import table


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_registered_queries_match_sql(spark, con, name):
    message, _ = compare(queries.QUERIES[name](spark, SF), con, queries.CHECKS[name])
    assert message is None, message


def lines_query(docs, n):
    return linedup.dedup_lines(docs, min_words=n).select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"),
                                                         F.md5(F.col("text").cast("binary")).alias("text_md5"))


def test_line_runs_of_few_kinds(spark):
    """Many overlapping and self-repeating runs, nulls and empty lines."""
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["a", "b b", "", "c c c", "d d d d", "e"]) for _ in range(rng.randint(0, 30))) if i % 9 else None, i) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, removed int")
    c = duckdb.connect()
    c.register("documents", d.toPandas())
    for n in (2, 7):
        assert compare(lines_query(d, n), c, linedup.SQL.format(min_words=n))[0] is None
    assert lines_query(d.limit(0), 5).count() == 0
    assert linedup.dedup_lines(d).columns[:3] == d.columns


def test_first_copy_of_a_passage_stays(spark):
    passage = "\n".join(" ".join(f"w{i}{j}" for j in range(30)) for i in range(2))
    d = spark.createDataFrame([(3, f"x\n{passage}\ny"), (1, f"own\n{passage}"), (2, "clean\nlines"), (2, "clean\nlines"), (None, passage)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in linedup.dedup_lines(d).collect())
    assert got == [(0, passage), (1, f"own\n{passage}"), (2, "clean\nlines"), (2, "clean\nlines"), (3, "x\ny")]


def brute_components(rows, k, percent=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, parent, inverse = {}, {}, defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in sorted(sets):
        shared = defaultdict(int)
        for g in sets[i]:
            for j in inverse[g]:
                shared[j] += 1
            inverse[g].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in sets)


def test_near_duplicates_of_all_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    got = sorted(tuple(r) for r in queries.op7_neardup(spark, SF).drop("class_id").collect())
    assert got == brute_components(rows, 4)


def test_chain_of_near_copies_and_odd_rows(spark):
    """Neighbours in the chain are linked and its ends are not alike; borderline pairs lie on both sides of 0.8."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        for _ in range(3):
            words[rng.randrange(120)] = f"n{i}{rng.random()}"
        rows.append((i, " ".join(words)))
    rows += [(100, None), (101, ""), (102, "a B"), (103, "A b"), (104, " \t\n")]
    d = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n int, key string")
    got = neardup.near_duplicates(d)
    assert sorted(tuple(r) for r in got.drop("class_id").collect()) == brute_components(rows, 4)
    assert neardup.near_duplicates(d.limit(0)).count() == 0


def test_tiles_find_links_between_components(spark, monkeypatch):
    """All members of a bucket but the leader meet in tiles when they are in different components."""
    monkeypatch.setattr(neardup, "TILE", 2)
    cfg = neardup.Settings()
    texts = {i: " ".join(f"{'p' if i % 2 else 'q'}{j}" for j in range(60)) + f" tail{i // 2}" for i in range(8)}
    sig = {i: neardup.signature(neardup.shingles(t, 4), cfg.hashes).tobytes() for i, t in texts.items()}
    n = {i: len(neardup.shingles(t, 4)) for i, t in texts.items()}
    classes = spark.createDataFrame([(i, n[i], bytearray(sig[i])) for i in texts], "id long, n long, sig binary")
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    for leader, linked in ((-1, [(7, 1)]), (7, [(7, 1)]), (0, [(2, 0), (4, 0), (6, 0)])):
        crowd = spark.createDataFrame([(5, i, leader) for i in texts], "bucket long, id long, leader long")
        roots = spark.createDataFrame(linked, "node long, root long")
        found = [tuple(r) for r in neardup.across(crowd, roots, classes, rows, cfg).collect()]
        parent = {i: i for i in texts}
        for a, b in found + linked:
            parent = {i: min(parent[a], parent[b]) if r in (parent[a], parent[b]) else r for i, r in parent.items()}
        assert all(a % 2 == b % 2 for a, b in found)
        assert all(parent[i] == i % 2 for i in texts if i != leader)


def test_posterior_bounds():
    cfg = neardup.Settings()
    low = cfg.least_matches()
    rng = np.random.default_rng(0)
    kept = rng.binomial(1, 0.8, (20000, cfg.hashes)).cumsum(1)[:, cfg.batch - 1::cfg.batch]
    assert (kept >= np.array(low)).all(1).mean() > 0.9999
    drop = rng.binomial(1, 0.4, (20000, cfg.hashes)).cumsum(1)[:, cfg.batch - 1::cfg.batch]
    assert (drop >= np.array(low)).all(1).mean() < 0.01


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(400 + i, 401 + i) for i in range(30)] + [(5, 5), (None, 3)]
    parent = {x: x for e in edges for x in e if x is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def brute_hits(docs, items):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[s:s + 10])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s:s + n])]
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def test_hits_of_short_long_and_odd_items(spark):
    rng = random.Random(3)
    vocab = ["a", "B", "c1", "é", "d"]
    docs = [(i, ", ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(90, None), (91, ""), (92, "!?")]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([1, 3, 4, 9, 10, 11, 30, 30])] + [(20, None), (21, "?"), (22, "É d")]
    d = spark.createDataFrame([(*x, "y") for x in docs], "doc_id long, text string, words string")
    i = spark.createDataFrame(items, "item_id long, text string")
    run = lambda a, b: sorted(((r["doc_id"], r["n_words"], r["n"], list(r["item_ids"])) for r in decontam.hits(a, b).withColumn(
        "n", decontam.covered(F.col("spans"))).collect()), key=str)
    assert run(d, i) == brute_hits(docs, items)
    assert run(d, i.limit(0)) == brute_hits(docs, []) and run(d.limit(0), i) == []


def test_items_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 3)
    d, i = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    got = sorted((r["doc_id"], r["n_words"], r["n"], list(r["item_ids"])) for r in decontam.hits(d, i).withColumn("n", decontam.covered(F.col("spans"))).collect())
    assert got == sorted(brute_hits([(r["doc_id"], r["text"]) for r in d.collect()], [(r["item_id"], r["text"]) for r in i.collect()]))


def test_top_k_of_odd_vectors(spark):
    rng = np.random.default_rng(1)
    v = [(i, [float(x) for x in rng.normal(0, 1, 4)]) for i in range(40)] + [(40, None), (41, [1.0, None, 0.0, 0.0]), (42, [float("nan")] * 4),
        (43, [float("inf"), 0.0, 0.0, 0.0]), (44, [1.0, 2.0]), (45, [2.0, 1.0]), (46, []), (47, []), (None, [1.0] * 4), (3, [9.0] * 4)]
    d = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    fine = [(i, np.floor(256 * np.array(x, float))) for i, x in v if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)]
    want = set()
    for q in {i for i, _ in fine}:
        own = min(tuple(x) for i, x in fine if i == q)
        scores = sorted((-int(np.dot(own, x)), i) for i, x in fine if i != q and len(x) == len(own))[:3]
        want |= {(q, k, i, -s) for k, (s, i) in enumerate(scores, 1)}
    got = topk.top_k(d, d, k=3, block=8, query_block=4, shards=3).collect()
    assert {tuple(r) for r in got} == want and len(got) >= len(want)
    assert topk.top_k(d.limit(0), d).count() == 0 and topk.top_k(d, d.limit(0)).count() == 0


def test_products_beyond_doubles_are_exact():
    q, v = np.array([[2.0**31, 1.0]]), np.array([[2.0**31, 3.0]])
    assert topk.tile_scores(q, v)[0, 0] == 2**62 + 3


def test_dialogues_of_odd_conversations(spark):
    rows = [(1, 0, "system", "be <|end|> kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 70, None, "late"),
            (2, 0, "system", "alone"), (None, 0, "cy", "x"), (3, None, "dee", "no turn"), (1, 3, "a<|b", "z")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, block int")
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    out = chat.dialogues(d)
    span = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"].cast("string"), s["end"].cast("string"))), ",")
    shown = out.select("conv_id", "participant", "block", "part", "messages", F.md5(F.col("text").cast("binary")).alias("text_md5"), span.alias("spans"))
    assert compare(shown, c, chat.SQL)[0] is None
    ann = out.where("conv_id = 1 AND participant = 'ann' AND block = 0").first()
    assert [ann["text"][s["first"]:s["end"]] for s in ann["spans"]] == ["hi<|end|>"]
    assert "<|user|>\nbob: <|end|>" in ann["text"] and "be < |end|> kind" in ann["text"]
    assert chat.dialogues(d.limit(0)).count() == 0


def test_urls_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "HTTP://WWW.Example.COM/en/X?y#z"), (4, "noscheme"), (5, "http://a.net"), (5, "http://a.net"), (6, "https://x.example.com/en/1"),
            (7, "http://example.com/fr"), (8, "http://notexample.com/en/"), (9, "http://a.net/es/?q=http://b.com/"), (None, "ftp://q.org#a"), (11, "http://é.org/ü" * 3000)]
    d = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    out = urls.judge(d, queries.URL_RULES)
    assert compare(out.drop("ratio"), c, urls.sql(queries.URL_RULES))[0] is None
    rule = {r["page_id"]: r["rule"] for r in out.collect()}
    assert (rule[3], rule[6], rule[8], rule[5]) == ("www.example.com/en/", "example.com/en/", "com/", None)
    assert urls.judge(d.limit(0), queries.URL_RULES).count() == 0


def test_model_beyond_the_broadcast_bound(spark, con, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_GRAMS", 10)
    assert compare(queries.op10_urls(spark, SF), con, queries.CHECKS["op10_urls"])[0] is None


def test_pipeline_stage_by_stage(spark):
    """Each stage against a plain version on its own input."""
    docs = table(spark, SF, "documents")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, SF))
        before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in out.collect()}
        assert out.columns == names and set(after) <= set(before) and after
        if name == "language_id":
            assert all(after[i] == before[i] and re.search("[^\\W\\d_]", after[i]) for i in after) and len(after) >= 0.95 * len(before)
        if name == "near_dedup":
            assert sorted(after) == [i for i, _, _, kept in brute_components(before.items(), 5) if kept]
        if name == "decontaminate":
            items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
            assert sorted(after) == sorted(d for d, _, n, _ in brute_hits(before.items(), items) if n == 0)
        if name == "line_dedup":
            c = duckdb.connect()
            c.register("documents", docs.select("doc_id", "text").toPandas())
            gone = c.execute(linedup.SQL.format(min_words=50)).fetchall()
            assert sorted(after) == sorted(i for i, n, k, _ in gone if k < n or k == 0)
            assert all(after[i] == before[i] for i, _, k, _ in gone if k == 0)
        docs = out
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(r["doc_id"] for r in final.collect()) == sorted(r["doc_id"] for r in docs.collect())
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, final.collect()))


def test_pipeline_of_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_scores_beyond_doubles_and_longs():
    rng = np.random.default_rng(6)
    for top in (1 << 26, 1 << 30, 1 << 31, 1 << 40, 1 << 60, 1e30):
        q, v = (np.floor(rng.uniform(-1, 1, (5, 8)) * float(top)) for _ in range(2))
        q[0], v[1] = 0, 1
        want = [[max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(x, y)))) for y in v] for x in q]
        assert topk.tile_scores(q, v).tolist() == want


def test_vectors_whose_scores_leave_a_long(spark):
    d = spark.createDataFrame([(0, [3e9, 3e9]), (1, [3e9, 3e9]), (2, [-3e9, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(d, d.where("vec_id = 0"), k=3).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, (1 << 63) - 1), (3, 2 * 256 * 768_000_000_000), (2, -(1 << 63))]


def test_words_of_a_line_are_runs_of_other_than_white_space(spark):
    passage = "\t".join(f"w{i}" for i in range(60))
    padded = "a  b" + " " * 80
    d = spark.createDataFrame([(1, f"x\n{passage}", "p", 1), (2, f"{passage}\ny", "q", 2), (3, padded, "r", 3), (4, padded, "s", 4)],
                              "doc_id long, text string, _copy string, _copy_of int")
    out = linedup.dedup_lines(d, min_words=50)
    got = {r["doc_id"]: (r["text"], r["_copy"], r["_copy_of"]) for r in out.collect()}
    assert got == {1: (f"x\n{passage}", "p", 1), 2: ("y", "q", 2), 3: (padded, "r", 3), 4: (padded, "s", 4)}


def test_long_blocks_are_cut_in_order(spark):
    """A conversation without turn numbers, one with a single number, equal messages, and a null id."""
    rng = random.Random(2)
    rows = [("hot", None, rng.choice("ab"), f"t{rng.randrange(400)}") for _ in range(1500)] + [("one", 7, "a", "same")] * 900
    rows += [("one", 7, "b", "other"), (None, 1, "a", "x"), (None, 1, "b", None), ("few", 1, "a", "p"), ("few", 70, "system", "q"), ("few", 2, None, "r")]
    d = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(5)
    out = chat.dialogues(d)
    assert out.agg(F.max("messages")).first()[0] == chat.MOST
    shown = out.select("conv_id", "participant", "block", "part", "messages", F.md5(F.col("text").cast("binary")).alias("text_md5"),
                       F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))
    c = duckdb.connect()
    c.register("conversations", d.toPandas())
    assert compare(shown, c, chat.SQL)[0] is None
