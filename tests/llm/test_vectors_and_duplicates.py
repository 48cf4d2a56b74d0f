import collections
import re

import numpy as np
import pytest

from loomseq.llm import bagminhash, embedding_dedup
from loomseq.llm.common import components

VECTORS = "vec_id long, embedding array<float>, label int, node string, copies int"


def classes(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (201, 202), (202, 203), (203, 201)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes([e for e in edges if e[0] != e[1]], {x for e in edges for x in e})
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_against_all_pairs_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 48))
    rows = []
    for i in range(240):
        v = centres[i % 12] + rng.normal(size=48) * (0.06 if i % 3 else 0.3)
        rows.append((i, v.astype(np.float32).tolist(), i % 2, "x", 1))
    copy = rows[5][1]
    rows += [(1000 + i, copy, rows[5][2], "x", 1) for i in range(30)]
    rows += [
        (2000, None, 1, "x", 1), (2001, [0.0] * 48, 1, "x", 1), (2002, [float("nan")] + copy[1:], 1, "x", 1),
        (2003, copy, None, "x", 1), (2004, [None] + copy[1:], 1, "x", 1), (2005, [], 1, "x", 1), (None, copy, rows[5][2], "x", 1),
        (2006, [float("inf")] * 48, 1, "x", 1), (2007, copy[:20], rows[5][2], "x", 1)]
    settings = embedding_dedup.HashSettings(block=16)
    got = {r[0]: tuple(r)[1:] for r in embedding_dedup.link_vectors(spark.createDataFrame(rows, VECTORS), settings=settings).collect()}
    usable = [r for r in rows if r[0] is not None and (r[0] < 2000 or r[0] == 2007)]
    links = []
    for i, a in enumerate(usable):
        for b in usable[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links.append((a[0], b[0]))
    degree = collections.Counter(x for e in links for x in e)
    part = classes(links, [r[0] for r in rows if r[0] is not None])
    assert len(links) > 200
    for r in rows:
        if r[0] is None:
            assert got[None] == (0, None, True)
        else:
            assert got[r[0]] == (degree[r[0]], part[r[0]], part[r[0]] == r[0]), r[0]
    assert embedding_dedup.link_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def bags(texts, words=5):
    out = []
    for t in texts:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(collections.Counter(
            tuple(ws[i : i + words]) for i in range(len(ws) - words + 1)) if len(ws) >= words else collections.Counter([tuple(ws)] if ws else []))
    return out


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    h = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    for spread in (1, 3, 8):
        a = rng.integers(1, 12, 300)
        b = np.maximum(a + rng.integers(-spread, spread + 1, 300), 1)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        x, y = bagminhash.signatures([(h, a), (h, b)], 4000)
        assert abs((x == y).mean() - want) < 0.04


def test_tile_overlaps_count_copies():
    rng = np.random.default_rng(1)
    made = []
    for _ in range(9):
        h, n = np.unique(rng.integers(0, 40, 60).astype(np.uint64), return_counts=True)
        made.append((h, n))
    got = bagminhash._overlaps(made, np.arange(4), np.arange(4, 9), chunk=16)
    for i in range(4):
        for j in range(4, 9):
            x, y = dict(zip(*map(list, made[i]))), dict(zip(*map(list, made[j])))
            assert got[i, j - 4] == sum(min(x[k], y.get(k, 0)) for k in x)


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = rng.choice(vocabulary, 60).tolist()
        for k in range(14 if g == 0 else 4):
            t = list(base)
            for _ in range(rng.integers(0, 4)):
                t[rng.integers(len(t))] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(t) + ("!" if k == 1 else ""), "x", 0))
    rows += [(500, None, "x", 0), (501, "", "x", 0), (502, "Two words", "x", 0), (503, "two, WORDS", "x", 0), (504, " ?! ", "x", 0),
             (505, "again " * 900, "x", 0), (506, "again " * 1000, "x", 0), (None, rows[0][1], "x", 0), (3, rows[3][1], "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, bucket int")
    got = bagminhash.near_duplicates(df, bagminhash.BagSettings(block=3)).collect()
    assert len(got) == len(rows)
    made = bags([r[1] for r in rows])
    links = []
    for i, a in enumerate(made):
        for j in range(i):
            both = sum((a & made[j]).values())
            if a and 5 * both >= 4 * (sum(a.values()) + sum(made[j].values()) - both):
                links.append((i, j))
    part = classes(links, range(len(rows)))
    low = {}
    for i, p in part.items():
        if rows[i][0] is not None:
            low[p] = min(low.get(p, rows[i][0]), rows[i][0])
    want = sorted((str(r[0]), sum(made[i].values()), str(low[part[i]]), r[0] == low[part[i]]) for i, r in enumerate(rows))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == want
    stay = bagminhash.drop_near_duplicates(df)
    assert stay.columns == df.columns
    assert bagminhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("bad", [{"bands": 2, "rows": 3}])
def test_band_keys_follow_the_rows(bad):
    settings = bagminhash.BagSettings(**bad)
    x = np.arange(12, dtype=np.float64).reshape(2, 6)
    y = x.copy()
    y[:, 5] += 1
    same = bagminhash.band_keys(x, settings) == bagminhash.band_keys(y, settings)
    assert same[:, 0].all() and not same[:, 1].any()


@pytest.mark.parametrize("width", [64, 256, 768, 1024])
@pytest.mark.parametrize("cosine", [0.98, 0.985, 0.99])
def test_recall_of_buckets(width, cosine):
    rng = np.random.default_rng([width, round(1000 * cosine)])
    a, other = rng.normal(size=(2, 500, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other -= (other * a).sum(axis=1, keepdims=True) * a
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    b = cosine * a + np.sqrt(1 - cosine**2) * other
    x, y = (embedding_dedup.bucket_codes(v, embedding_dedup.HashSettings()) for v in (a, b))
    # a vector is stored in its first bucket of each table and looks into the others
    met = ((x[:, :, :1] == y) | (y[:, :, :1] == x)).any(axis=(1, 2))
    assert met.mean() >= 0.99
    strangers = ((x[:, :, :1] == np.roll(y, 1, axis=0)) | (np.roll(y, 1, axis=0)[:, :, :1] == x)).any(axis=(1, 2))
    assert strangers.mean() < 0.1
