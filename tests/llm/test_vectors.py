"""SimHash components and whitening against brute force and numpy."""
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF
from spatialscore.llm import queries, simhash, whiten
from spatialscore.llm.common import heavy_join, table


def brute_fingerprint(text, k=3):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), seed=42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes, distance=3):
    """Smallest id reachable of every (id, code) with one code per id."""
    ids, value = zip(*codes)
    value, root = np.array(value, dtype=np.uint64), {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(value[i + 1:] ^ value[i]) <= distance) + i + 1:
            a, b = top(ids[i]), top(ids[j])
            root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_registered_components_against_brute_force(spark):
    for folder in (SF, "/root/testdata/sf0.01"):
        rows = [(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").collect()]
        codes = [(i, brute_fingerprint(t)) for i, t in rows]
        want, code = brute_components(codes), dict(codes)
        got = queries.op12_simhash(spark, folder).collect()
        assert len(got) == len(rows) == len(want)
        assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{c:016x}" for i, c in code.items()}
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_fingerprint_is_the_engines_hash(spark):
    """The seed is that of the engine's own function."""
    text = "one two three"
    assert brute_fingerprint(text) == simhash.fingerprint(text, 3) == spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % (1 << 64)
    for t in (None, "", " \t", "a", "A b", "x " * 50_000, "Ünï CODE x\x1cy 漢 b", "a b c a b c a b c"):
        assert simhash.fingerprint(t, 3) == brute_fingerprint(t)


def dense_codes(rng, families, members, bits):
    """Families of codes that differ from a centre in a few bits, and single codes."""
    out = set()
    for _ in range(families):
        centre = rng.getrandbits(64)
        for _ in range(members):
            out.add(centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(bits))) % (1 << 64))
    out |= {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1, 1, 7, 15}
    return sorted(out, key=lambda _: rng.random())


@pytest.mark.parametrize("node", [128, 4096])
def test_links_of_dense_families(spark, node):
    """Overfull nodes pass their codes to finer masks without losing a link."""
    rng = random.Random(node)
    codes = dense_codes(rng, 3, 200, 5) + list(range(5000, 5150))
    codes = [(i, c) for i, c in enumerate(dict.fromkeys(codes))]
    frame = spark.createDataFrame([(i, c - (1 << 64) if c >> 63 else c) for i, c in codes], "id long, code long").repartition(5)
    links = simhash.near_links(frame, 3, node=node).collect()
    value = dict(codes)
    assert all((value[r["a"]] ^ value[r["b"]]).bit_count() <= 3 for r in links)
    root = {i: i for i, _ in codes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for r in links:
        a, b = top(r["a"]), top(r["b"])
        root[max(a, b)] = min(a, b)
    assert {i: top(i) for i in root} == brute_components(codes)
    if node < 4096:
        sizes = Counter((r["mask"], r["pattern"]) for r in simhash.upper_nodes(frame, 3, node).collect())
        assert max(sizes.values()) <= node


def test_index_prunes_groups_and_finds_all_pairs():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([centre, centre ^ (np.uint64(1) << rng.integers(0, 63, 40, dtype=np.uint64)), centre + np.uint64(5)]))
    rank = np.array([int(c) for c in codes], dtype=object)
    for s in (1, 2, 4, 8, 16, 32):
        rank = np.array([int(r) ^ (int(r) >> s) for r in rank], dtype=object)
    codes = codes[np.argsort(rank)]
    assert all((int(r) ^ (int(r) >> 1)) == int(c) for r, c in zip(sorted(rank), codes))
    node = np.repeat([0, 1], [len(codes) // 2, len(codes) - len(codes) // 2])
    index = simhash.Index(codes, node)
    assert index.roots == 2 and [len(b) for b in index.bits][-1] == 2
    for level, first in enumerate(index.first):
        for g, (a, b) in enumerate(zip(first, np.append(first[1:], len(index.bits[level])))):
            assert all((index.bits[level][a:b] ^ index.bits[level + 1][g]) & index.mask[level + 1][g] == 0)
    got = {(int(a), int(b)) for x, y in index.near(3) for a, b in zip(x, y)}
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes))
            if node[i] == node[j] and int(codes[i] ^ codes[j]).bit_count() <= 3}
    assert got == want and want


def test_masks_cover_every_pair_of_near_codes():
    """The segments below a mask are disjoint, so whatever three bits differ, one of the four is free of them."""
    masks = [0]
    for _ in range(6):
        row = simhash.finer(masks[-1], 4)
        new = [(m & ~masks[-1]) % (1 << 64) for m in row]
        assert all(m & masks[-1] == masks[-1] for m in row) and all(new)
        assert sum(m.bit_count() for m in new) == 64 - (masks[-1] % (1 << 64)).bit_count() == int(np.bitwise_or.reduce(np.array(new, dtype=np.uint64))).bit_count()
        masks.append(row[len(masks) % 4])
    assert 64 - (masks[-1] % (1 << 64)).bit_count() <= 12


def test_odd_rows_of_simhash(spark):
    d = spark.createDataFrame([(5, "a b c d", 1), (5, "z y x w v u", 2), (9, "a b c d", 3), (7, None, 4), (8, "", 5), (None, "a b c d", 6), (2, "z y x w v u", 7),
                               (5, "a b c d", 8)], "doc_id long, text string, code int")
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in simhash.near_duplicates(d).collect())
    assert got == Counter({(5, 2, False): 3, (9, 2, False): 1, (7, 7, True): 1, (8, 7, False): 1, (None, None, True): 1, (2, 2, True): 1})
    assert simhash.near_duplicates(d.limit(0)).count() == 0


def test_heavy_keys_join_as_others(spark):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(600)] + [(99, 600), (None, 601)], "k int, i int")
    values = rows.where("k < 50").groupBy("k").agg(F.count("i").alias("n"), F.min("i").alias("low"))
    want = sorted(map(str, rows.join(values.drop("n"), "k", "left").collect()))
    for parts in (1, 5, 1000):
        got = heavy_join(rows, values, "k", "n", parts=parts)
        assert sorted(map(str, got.drop("n").collect())) == want
        assert heavy_join(rows, values, ["k"], "n", how="inner", parts=parts).count() == 600


def plain_whitening(rows, k=16):
    """numpy's own eigenvectors over the distinct vectors."""
    x = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows
         if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(v) for _, v in x}), dtype=np.int64)
    n, s = len(fit), fit.sum(axis=0)
    c = (fit * n - s) / n
    cov = c.T @ c / n
    values, vectors = np.linalg.eigh(cov)
    return x, n, s, np.trace(cov), values[::-1][:k], vectors[:, ::-1][:, :k]


def test_registered_whitening_against_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    x, n, s, trace, values, vectors = plain_whitening(rows)
    got = queries.op13_whiten(spark, SF)
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    got = got.collect()
    assert len(got) == len(x) * 16 and {r["component"] for r in got} == set(range(1, 17))
    whitened = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    deviation = {r["vec_id"]: r["deviation"] for r in got}
    assert deviation == {i: sum((n * int(c) - int(t)) ** 2 for c, t in zip(v, s)) for i, v in x}
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    share = {r["component"]: r["explained"] for r in got}
    np.testing.assert_allclose([share[k] for k in range(1, 17)], values / trace, rtol=1e-10)
    mine = np.array([[whitened[i, k] for k in range(1, 17)] for i, _ in x])
    want = (np.array([v for _, v in x]) - s / n) @ vectors / np.sqrt(values)
    sign = np.sign((mine * want).sum(axis=0))
    np.testing.assert_allclose(mine, want * sign, atol=1e-7)


def test_factor_and_rotations():
    rng = np.random.default_rng(1)
    for d, r in ((1, 1), (2, 2), (5, 5), (7, 3), (33, 33), (40, 12)):
        a = rng.normal(size=(d, r)) * np.logspace(0, -4, r)
        v = a @ a.T
        factor, order = whiten.pivoted_cholesky(v)
        assert factor.shape == (d, r) and np.allclose(np.tril(factor[:r]), factor[:r])
        np.testing.assert_allclose(factor @ factor.T, v[order][:, order], atol=1e-12)
        values, vectors = whiten.eigen(v)
        np.testing.assert_allclose(values, np.linalg.svd(a, compute_uv=False) ** 2, rtol=1e-8, atol=1e-14)
        np.testing.assert_allclose(vectors.T @ vectors, np.eye(r), atol=1e-9)
        np.testing.assert_allclose(v @ vectors, vectors * values, atol=1e-10)
    assert whiten.eigen(np.zeros((4, 4)))[0].size == 0


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0, 2.0], "p"), (2, [0.5, -1.0, 2.0], "q"), (2, [0.5, -1.0, 2.0], "q"), (3, None, "r"), (4, [1.0, None, 1.0], "s"), (5, [1.0, nan, 1.0], "t"),
            (6, [inf, 1.0, 1.0], "u"), (7, [], "v"), (8, [1.0, 2.0], "w"), (None, [3.0, 1.0, 2.0], "x")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string")
    got = whiten.whiten(d).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "1", "2", "2", "2", "2", "None", "None"]
    assert {r["n"] for r in got} == {3} and {r["component"] for r in got} == {1, 2}
    assert max(abs(r["identity_error"]) for r in got) < 1e-12
    equal = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<float>")
    assert whiten.whiten(equal).count() == 0 and whiten.whiten(d.limit(0)).count() == 0
    big = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    out = whiten.whiten(big).collect()
    assert len(out) == 3 and {r["deviation"] for r in out if r["vec_id"] == 1} == {None}
