"""SimHash and embedding near-duplicates, and components, against brute force."""

import random

import numpy as np
import pytest
import xxhash

from quillon.llm import embeddings as E
from quillon.llm import simhash as S
from quillon.llm.components import components

SF = "/root/testdata/sf0.001"


def classes(n, linked):
    """Smallest member of each item's component, by search."""
    out = [-1] * n
    for s in range(n):
        if out[s] < 0:
            todo, out[s] = [s], s
            while todo:
                x = todo.pop()
                for y in range(n):
                    if out[y] < 0 and linked(x, y):
                        out[y] = s
                        todo.append(y)
    return out


def plain_fingerprint(text, shingle):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints():
    for text in (None, "", " \n", "One", "a b c", "a b c d", "a b c d e", "Ä b C d é F", "x y " * 5000):
        assert int.from_bytes(S.document_fingerprint(text, 4, 1)) == plain_fingerprint(text, 4)
        wide = S.document_fingerprint(text, 4, 3)
        h = [int(x) for x in S.shingle_hashes(text, 4)]
        words = [h, *[[int(S.mix(np.array([(x + w * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0]) for x in h] for w in (1, 2)]]
        assert wide == b"".join(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in v) * 2 > len(v)).to_bytes(8) for v in words)


def test_simhash_query(spark):
    got = S.simhash(spark, SF).toPandas().sort_values("doc_id", ignore_index=True)
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id", ignore_index=True)
    prints = [plain_fingerprint(t, 4) for t in docs["text"]]
    assert [int(x, 16) for x in got["fingerprint"]] == prints and all(len(x) == 16 for x in got["fingerprint"])
    want = classes(len(prints), lambda x, y: (prints[x] ^ prints[y]).bit_count() <= 4)
    assert got["component_id"].tolist() == docs["doc_id"].to_numpy()[want].tolist()


@pytest.mark.parametrize("n", [1, 1 << 23, 1 << 30, 1 << 40])
def test_views_miss_no_pair(n):
    views, reach = S.exact_views(4, n)
    rng = random.Random(n)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        p = np.array([[x], [y]], np.uint64)
        assert min(int(np.bitwise_count(v[0] ^ v[1])) for v in (S.view_values(p, w) for w in views)) <= reach


def test_trees_lose_no_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, np.uint64)
    near = np.concatenate([base, base[:100] ^ np.uint64(0b1011), base[:50] ^ np.uint64(1 << 60), np.repeat(base[:1], 60) ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))])
    prints = np.unique(near)[:, None]
    views, reach = S.exact_views(4, len(prints))
    joined = set()
    for v in views:
        tree, _ = S.fit_tree(S.view_values(prints, v), reach, 8)
        for _, rows in S.route(S.view_values(prints, v), tree, reach):
            i, j = S.link_shard(prints[rows], v, reach, 4)
            joined |= {(int(rows[a]), int(rows[b])) for a, b in zip(i, j)}
    p = [int(x) for x in prints[:, 0]]
    want = classes(len(p), lambda x, y: (p[x] ^ p[y]).bit_count() <= 4)
    assert classes(len(p), lambda x, y: (x, y) in joined or (y, x) in joined) == want


def test_simhash_edges(spark):
    rows = [(5, None), (3, ""), (4, " "), (1, "one two three four five six"), (2, "one two three four five six"), (2, "one two three four five six"), (None, "one two three four five six"), (9, "w " * 30000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = S.near_duplicates(docs, shingle=4).toPandas()
    of = got["component_id"].tolist()
    assert len(got) == 8 and of.count(3) == 3 and of.count(1) == 4 and of.count(9) == 1
    assert S.near_duplicates(docs.limit(0)).count() == 0
    kept = S.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3, 9]


def edited(rng, base, changes):
    """A copy of a text with so many words replaced, far apart or not."""
    copy = list(base)
    for i in rng.sample(range(len(base)), changes):
        copy[i] = f"c{rng.randint(0, 10**9)}"
    return copy


def test_loose_copies(spark, monkeypatch):
    """Copies with a cosine of 0.8 or more go, nearly all, and texts well below it stay; also with shards cut into blocks."""
    rng = random.Random(11)
    docs, cosines = [], {}
    for k in range(300):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(60, 400))]
        copy = edited(rng, base, max(1, round(len(base) * rng.uniform(0.002, 0.1))))
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (base, copy))
        cosines[2 * k + 1] = len(x & y) / (len(x) * len(y)) ** 0.5
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for shard in (100_000, 100):
        monkeypatch.setattr(S, "SHARD", shard)
        kept = {r["doc_id"] for r in S.keep_first(frame).collect()}
        assert set(range(0, 600, 2)) <= kept
        similar = [d for d, c in cosines.items() if c >= 0.8]
        found = sum(d not in kept for d in similar) / len(similar)
        assert len(similar) > 100 and found >= 0.93, found
        assert all(d in kept for d, c in cosines.items() if c < 0.68)


def test_links_of_fingerprints(spark):
    """Of all pairs of fingerprints within the distance, nearly all end in one component, and no others do."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (200, S.WORDS), np.uint64)
    far = S.farthest(S.SIMILAR, 64 * S.WORDS)
    assert far == 104
    near = base.copy()
    for row, n in zip(near, rng.integers(60, 130, 200)):
        for b in rng.choice(64 * S.WORDS, n, replace=False):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    prints = np.concatenate([base, near])
    d = np.bitwise_count(base ^ near).sum(1)
    classes_ = spark.createDataFrame([(i, bytearray(p.astype(">u8").tobytes())) for i, p in enumerate(prints)], "cls long, print binary")
    views, reach = S.loose_views(far, S.WORDS, len(prints), S.RECALL)
    got = {(min(r), max(r)) for r in S.link_prints(classes_, views, reach, far).collect()}
    assert got <= {(i, i + 200) for i in range(200) if d[i] <= far}
    assert len(got) >= 0.95 * (d <= far).sum() > 50


def test_equal_and_null_ids(spark):
    """Rows are told apart by id and text: a clean text stays though another row of its id, or with a null id, goes."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a, "p"), (2, a, "q"), (2, b, "r"), (None, a, "s"), (None, c, "t"), (3, c, "u"), (None, None, "v"), (1, a, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    kept = [(r["doc_id"], r["text"]) for r in S.keep_first(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (2, b), (3, c), (None, None)], key=str)
    assert S.keep_first(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5300)]
    links += [(9000, i) for i in range(10000, 13000)]
    df = spark.createDataFrame([*links, (None, 1), (7, None), (8, 8)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    nodes = sorted({x for p in links for x in p if p[0] != p[1]})
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for s in nodes:
        if s not in want:
            todo, want[s] = [s], s
            while todo:
                for y in near[todo.pop()]:
                    if y not in want:
                        want[y] = s
                        todo.append(y)
    assert got == want
    assert components(df.limit(0)).count() == 0


def brute_vectors(vectors, labels, threshold=0.93):
    def ok(i):
        v = vectors[i]
        return labels[i] is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def linked(i, j):
        if i == j or not ok(i) or not ok(j) or labels[i] != labels[j] or len(vectors[i]) != len(vectors[j]):
            return False
        a, b = np.array(vectors[i], float), np.array(vectors[j], float)
        a, b = a / abs(a).max(), b / abs(b).max()
        return a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold

    n = len(vectors)
    return [sum(linked(i, j) for j in range(n)) for i in range(n)], classes(n, linked)


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((30, 16))
    v = [*base.tolist(), *(base[:20] + 0.2 * rng.standard_normal((20, 16))).tolist(), *(base[[0] * 15] + 0.1 * rng.standard_normal((15, 16))).tolist(), *base[:5].tolist(), (base[3] * 1e30).tolist()]
    v += [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] + [1.0] * 15, base[0][:8].tolist(), base[0].tolist()]
    labels = [*[i % 2 for i in range(len(v) - 1)], None]
    rows = [(i, x, y, 0) for i, (x, y) in enumerate(zip(v, labels))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int")
    links, comps = brute_vectors(v, labels)
    for cell, block in ((16384, 4096), (4, 8)):  # without cells, and with cells and small blocks
        monkeypatch.setattr(E, "CELL", cell)
        monkeypatch.setattr(E, "BLOCK", block)
        got = E.near_vectors(df).toPandas().sort_values("vec_id")
        share = (got["n_links"].to_numpy() == np.array(links)).mean()
        assert share == 1 if cell > 100 else share >= 0.9
        if cell > 100:
            assert got["component_id"].tolist() == comps and got["kept"].tolist() == [i == c for i, c in enumerate(comps)]
    assert E.near_vectors(df.limit(0)).count() == 0
    # Single precision, repeated rows, large and null ids.
    few = spark.createDataFrame([(2**53 + 1, [1.0, 0.1], "x"), (2**53 + 3, [1.0, 0.1], "x"), (None, [1.0, -0.0], "x"), (None, [1.0, 0.0], "x"), (7, [0.0, 1.0], "x"), (7, [0.0, 1.0], "x"), (8, None, None)], "vec_id long, embedding array<float>, label string")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.near_vectors(few).collect()), key=str)
    least = 2**53 + 1
    assert got == sorted([(least, 3, least, True), (2**53 + 3, 3, least, False), (None, 3, least, False), (None, 3, least, False), (7, 1, 7, True), (7, 1, 7, True), (8, 0, 8, True)], key=str)


def test_cells_miss_no_vector(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 8))
    v = [*base.tolist(), *(base[rng.integers(0, 150, 250)] + 0.3 * rng.standard_normal((250, 8))).tolist()]
    labels = [0 if i % 10 else 1 for i in range(400)]
    links, comps = brute_vectors(v, labels)
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(v, labels))], "vec_id long, embedding array<double>, label int")
    for cell, block in ((16, 8), (60, 4096)):  # cells of large labels, cut into blocks, and one label without cells
        monkeypatch.setattr(E, "CELL", cell)
        monkeypatch.setattr(E, "BLOCK", block)
        got = E.near_vectors(df).toPandas().sort_values("vec_id")
        assert got["n_links"].tolist() == links and got["component_id"].tolist() == comps


def test_estimate_is_unbiased():
    """On average over directions, which one rotation meets as rotations meet one direction."""
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(400):
        q = rng.standard_normal(64)
        q /= np.linalg.norm(q)
        o = q * 0.9 + rng.standard_normal(64) * 0.05
        o /= np.linalg.norm(o)
        bits, factor = E.coded(o[None])
        signs = np.unpackbits(bits, axis=1)[0].astype(float) * 2 - 1
        errors.append(signs @ (E.rotation(64) @ q) / 8 / factor[0] - o @ q)
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < E.EPSILON * 0.75 / np.sqrt(63)
