"""Operators 11 to 13 against brute force, on the small tables and on odd rows."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.llm import centroids, manifest, neighbours
from paddock.llm.vectors import dense

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<float>, label int, cluster int, entry string, key int, copies double, c int"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key int, place string, node int, path double, leaf int"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3, 4.0, 5) for i, v in rows], VECTORS)


# ---- op11

def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cs = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))

    for _ in range(rounds if cs else 0):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        cs = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if groups[j] else c for j, c in enumerate(cs)]
    got = [(i, *nearest(v)[::-1]) for i, v in kept]
    own = collections.Counter()
    for _, j, d in got:
        own[j] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return [(i, j, d, own[j], sum(own.values()), names[j]) for i, j, d in got]


def clusters(df):
    out, cs, inertia = centroids.clustered(df)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return [(r["vec_id"], r["cluster"], r["distance"], inertia[r["cluster"]], sum(inertia), names[r["cluster"]]) for r in out.collect()]


def test_clusters(spark, vectors):
    want = brute_clusters([(r["vec_id"], r["embedding"]) for r in vectors.collect()])
    assert collections.Counter(clusters(vectors)) == collections.Counter(want)
    got = centroids.op11_centroid_clustering(spark, SF)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    assert collections.Counter(map(tuple, centroids.clustered(vectors.repartition(5))[0].collect())) == collections.Counter(w[:3] for w in want)


def odd_vectors():
    rng = np.random.RandomState(4)
    rows = [(i, [float(x) for x in rng.randint(-2, 3, 64)]) for i in range(40)]
    same = rows[3][1]
    return rows + [(3, same), (3, same), (900, same), (None, same), (901, None), (902, []), (903, [1.0] * 63), (904, [1.0] * 65),
                   (905, [None] + [1.0] * 63), (906, [float("nan")] * 64), (907, [float("inf")] + [0.0] * 63), (908, [0.0] * 64), (909, [0.0] * 64)]


def test_clusters_of_odd_rows(spark):
    rows = odd_vectors()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(clusters(table(spark, rows)), key=key) == sorted(brute_clusters(rows), key=key)
    few = rows[:3]
    assert sorted(clusters(table(spark, few))) == sorted(brute_clusters(few))
    assert clusters(table(spark, [])) == [] and clusters(table(spark, rows[-9:-3])) == []


def test_huge_components(spark):
    rows = [(i, [float(np.float32(10 ** (i % 12)) * (-1) ** i)] * 64) for i in range(30)]   # what a float holds
    assert sorted(clusters(table(spark, rows))) == sorted(brute_clusters(rows))
    out = centroids.clustered(table(spark, [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [1.0] * 64)]), k=1)[0].collect()
    assert {r["vec_id"] for r in out} == {1, 2, 3} and max(r["distance"] for r in out) == centroids.MOST


def test_search_is_exact_and_rejects():
    rng = np.random.RandomState(1)
    for scale in (1, 40, 4000):
        x, c = rng.randint(-3, 4, (300, 64)) * scale, rng.randint(-3, 4, (12, 64)) * scale
        c[3], x[:12] = c[7], c
        cluster, d, _ = centroids.nearest(x, centroids.Ordered(c.tolist()))
        every = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (cluster == every.argmin(1)).all() and (d == every.min(1)).all()
    spread = rng.randint(-3, 4, (20, 64)) + 40 * np.arange(20)[:, None]   # far apart in their means
    _, _, done = centroids.nearest(spread, centroids.Ordered(spread.tolist()))
    assert done < 3 * len(spread)


# ---- op12

def brute_manifest(rows, fan=16):
    def h(text):
        return hashlib.sha256(text.encode()).hexdigest()

    def leaf(r):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1])))

    def tree(nodes):
        paths, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            up, below = [], []
            for a in range(0, len(nodes), fan):
                run = nodes[a:a + fan]
                for k in range(len(run)):
                    for i in own[a + k]:
                        paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
                up.append(h("".join(run)))
                below.append([i for o in own[a:a + fan] for i in o])
            nodes, own = up, below
        return nodes[0], paths

    by = collections.defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    parts = []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        rs = sorted(by[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        parts.append((rs, *tree([leaf(r) for r in rs])))
    if not parts:
        return []
    root, tops = tree([p[1] for p in parts])
    out = []
    for (rs, sub, paths), top in zip(parts, tops):
        for r, path in zip(rs, paths):
            path, text = path + top, r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            x = leaf((r[0], text, *r[2:]))
            for before, after in path:
                x = h(before + x + after)
            out.append((r[0], leaf(r), sub, root, h("".join(a + b for a, b in path)), x, x == root))
    return out


def manifest_rows(df, **kw):
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = manifest.witnesses(df, hit, F.translate("text", manifest.UPPER, manifest.LOWER), **kw)
    rows = []
    for r in out.collect():
        x = r["changed"] or r["leaf"]
        for s in r["path"]:
            x = hashlib.sha256((s["before"] + x + s["after"]).encode()).hexdigest()
        proof = hashlib.sha256("".join(s["before"] + s["after"] for s in r["path"]).encode()).hexdigest()
        rows.append((r["doc_id"], r["leaf"], r["subroot"], r["root"], proof, x, x == r["root"]))
    return rows


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, 3.0, 4) for r in rows], DOCS)


def test_manifest(spark):
    want = brute_manifest([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])
                           for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    got = manifest.op12_merkle_manifest(spark, SF)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = [tuple(r) for r in got.collect()]
    assert collections.Counter(got) == collections.Counter(want)
    assert {r[0] for r in got if not r[-1]} and all(zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in got if not r[-1])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 8, 9, 17, 40])
def test_manifest_of_many_blocks(spark, n):
    """Blocks of nine leaves in runs of three: several levels of blocks, ragged ends, and many sources."""
    rows = [(i * 7 % 41, f"Text {i}", None if i % 4 == 0 else "en", [None, "", "b", "Ä", "a"][i % 5] if n < 40 else "one", i) for i in range(n)]
    rows += [rows[0], (None, None, None, "b", None), (None, "", "", "b", 0)] if n else []
    got = manifest_rows(documents(spark, rows), fan=3, height=2)
    assert collections.Counter(got) == collections.Counter(brute_manifest(rows, 3))


def test_manifest_of_many_sources(spark):
    rows = [(i, f"T{i}", "en", f"s{i}", 1) for i in range(25)]
    assert collections.Counter(manifest_rows(documents(spark, rows), fan=2, height=2)) == collections.Counter(brute_manifest(rows, 2))


def test_stream_keeps_open_runs_only():
    stream = manifest.Stream(4, witness=False)
    for i in range(1000):
        stream.append(manifest.digest(str(i)))
        assert sum(map(len, stream.open)) <= 3 * len(stream.open)
    assert manifest.levels_of(1000, 4) == 5 and len(stream.finish(5)) == 64


# ---- op13

def brute_links(rows, threshold=0.9):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def usable(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = [0] * len(rows)
    units = [np.array(v, float) / np.linalg.norm(v) if usable(v) else None for _, v in rows]
    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[find(i)] = min(v, least.get(find(i), v))
    return [(v, n, least.get(find(i)), v is not None and v == least.get(find(i))) for i, ((v, _), n) in enumerate(zip(rows, links))]


def near_rows(seed=7, n=400, width=64):
    """Random vectors, groups of near copies around some, a chain, and pairs just above and below the threshold."""
    rng = np.random.RandomState(seed)
    rows = list(rng.standard_normal((n, width)))
    for centre, size, noise in ((0, 60, 0.02), (1, 5, 0.2), (2, 1, 0.0)):
        rows += [rows[centre] + noise * rng.standard_normal(width) for _ in range(size)]
    u, v = rows[5] / np.linalg.norm(rows[5]), rng.standard_normal(width)
    v = v - (v @ u) * u
    v /= np.linalg.norm(v)
    rows += [np.cos(a) * u + np.sin(a) * v for a in np.arange(1, 9) * 0.4]
    for k, cosine in enumerate((0.905, 0.901, 0.899, 0.895)):
        u = rows[20 + k] / np.linalg.norm(rows[20 + k])
        w = rng.standard_normal(width)
        w = w - (w @ u) * u
        rows.append(cosine * u + np.sqrt(1 - cosine ** 2) * w / np.linalg.norm(w))
    order = rng.permutation(len(rows))
    return [(int(i), [float(x) for x in np.float32(rows[k])]) for i, k in enumerate(order)]


def links_of(df, **kw):
    return [tuple(r) for r in neighbours.near_duplicates(df, **kw).collect()]


def test_near_duplicates(spark):
    rows = near_rows()
    got, want = links_of(table(spark, rows)), brute_links(rows)
    assert collections.Counter(got) == collections.Counter(want)
    assert sum(r[1] for r in got) > 3000


def test_near_duplicates_of_the_small_table(spark, vectors):
    got = neighbours.op13_embedding_near_dedup(spark, SF)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = brute_links([(r["vec_id"], r["embedding"]) for r in vectors.collect()])
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)


def test_near_duplicates_of_odd_rows(spark):
    rows = odd_vectors() + [(910, [2.0] * 64), (911, [1.0] * 64), (912, [1.0] * 3), (913, [2.0] * 3), (914, [-0.0] * 64), (915, [1e-38] * 64)]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(links_of(table(spark, rows)), key=key) == sorted(brute_links(rows), key=key)
    assert links_of(table(spark, [])) == []
    assert links_of(table(spark, [(4, None), (5, [0.0])])) == [(4, 0, 4, True), (5, 0, 5, True)]


def test_blocks_and_parts_change_nothing(spark, monkeypatch):
    """A crowded list is cut into many blocks and parts; the pairs stay the same."""
    rows = near_rows(3, 150)
    want = links_of(table(spark, rows))
    defaults = neighbours.linked.__defaults__
    monkeypatch.setattr(neighbours.linked, "__defaults__", (defaults[0], 7, 11))
    assert collections.Counter(links_of(table(spark, rows))) == collections.Counter(want)


def test_codes_lose_no_pair():
    """Every pair within the threshold passes the looked-up distance less the entry's own error, with one probe of all lists."""
    rng = np.random.RandomState(2)
    x = neighbours.unit(rng.standard_normal((3000, 32)))
    index = neighbours.fit(x[:1500], 12, 0.9)
    near = neighbours.unit(x + 0.3 * neighbours.unit(rng.standard_normal(x.shape)))
    lists = index.ranked(x)[:, 0]
    code, err = index.codes(x - index.centroids[lists])
    table = index.tables(near - index.centroids[lists])
    d = sum(table[m][np.arange(len(x)), code[:, m]] for m in range(len(table)))
    linked = (near * x).sum(1) >= 0.9
    assert linked.sum() > 1000 and (np.sqrt(d[linked]) <= np.sqrt(0.2) + err[linked] + 1e-5).all()
    assert index.probes < 12 or len(index.centroids) <= index.probes


def test_dense_rows():
    import pyarrow as pa
    at, x = dense(pa.array([[1.0, 2.0], None, [1.0], [None, 1.0], [float("inf"), 0.0], [3.0, 4.0]], pa.list_(pa.float32())).slice(1), 2)
    assert at.tolist() == [4] and x.tolist() == [[3.0, 4.0]]
