import random

import pytest
from pyspark.sql import functions as F

from loomseq.functions import structure as A
from loomseq.operators import mask_tiles as T
from loomseq.operators import structure as L

C, P, B = 100, 101, 102
COLUMNS = ["segment_id", "position_id", "mask_doc_id", "marker_group", "since_marker", "label", "reach", "reach_causal"]


def plain(tokens, pad=P):
    """Straight loops over one sequence."""
    n = len(tokens)
    out = {c: [] for c in COLUMNS}
    pads = marks = 0
    pos_in_seg = -1
    for i, t in enumerate(tokens):
        is_pad, is_mark = t == pad, t == C
        pads += is_pad
        pos_in_seg = 0 if is_pad else pos_in_seg + 1
        out["segment_id"].append(pads)
        out["position_id"].append(pos_in_seg)
        out["mask_doc_id"].append(pads - is_pad)
        out["marker_group"].append(marks)
        marks += is_mark
        back = next((j for j in range(i + 1) if tokens[i - j] == C), None)
        out["since_marker"].append(i + 1 if back is None else back)
        out["label"].append(-100 if is_pad or is_mark else t)
    mask = [[q >= k and out["mask_doc_id"][q] == out["mask_doc_id"][k]
             and (out["marker_group"][q] == out["marker_group"][k] or tokens[k] == C)
             and tokens[q] != pad for k in range(n)] for q in range(n)]
    causal = [[q >= k and out["mask_doc_id"][q] == out["mask_doc_id"][k] for k in range(n)] for q in range(n)]
    out["reach"] = [sum(r) for r in mask]
    out["reach_causal"] = [sum(r) for r in causal]
    return out, mask, causal


@pytest.fixture(scope="module")
def sequences():
    rng = random.Random(5)
    fixed = [[B, 1, C, 2, P, B, 3, P], [P], [C], [1], [P, P], [C, C, P], [1, 2, 3], [P, 1, C]]
    rand = [[rng.choice([1, 2, 3, C, P, B, 4, 5]) for _ in range(rng.randint(1, 40))] for _ in range(60)]
    return fixed + rand


@pytest.fixture(scope="module")
def table(spark, sequences):
    return spark.createDataFrame(list(enumerate(sequences)), "seq_id bigint, tokens array<int>").repartition(4)


def test_worked_example():
    got, _, _ = plain([B, 1, C, 2, P, B, 3, P])
    assert got["segment_id"] == [0, 0, 0, 0, 1, 1, 1, 2]
    assert got["position_id"] == [0, 1, 2, 3, 0, 1, 2, 0]
    assert got["mask_doc_id"] == [0, 0, 0, 0, 0, 1, 1, 1]
    assert got["marker_group"] == [0, 0, 0, 1, 1, 1, 1, 1]
    assert got["since_marker"] == [1, 2, 0, 1, 2, 3, 4, 5]
    assert got["reach"] == [1, 2, 3, 2, 0, 1, 2, 0]
    assert got["reach_causal"] == [1, 2, 3, 4, 5, 1, 2, 3]


def test_array_form(table, sequences):
    for row in A.add_structure(table, marker_id=C, pad_id=P).collect():
        want, _, _ = plain(sequences[row.seq_id])
        for c in COLUMNS:
            assert row[c] == want[c], (row.seq_id, c)


def test_array_form_without_pads(table, sequences):
    for row in A.add_structure(table, marker_id=C, pad_id=None).collect():
        want, _, _ = plain(sequences[row.seq_id], pad=None)
        for c in COLUMNS:
            assert row[c] == want[c], (row.seq_id, c)


@pytest.mark.parametrize("pad", [P, None])
def test_long_form(table, sequences, pad):
    key = ["seq_id"]
    g = L.with_groups(L.to_long(table, key), marker_id=C, pad_id=pad, key=key)
    g = L.with_reach(L.with_since_marker(L.with_positions(g, key), key), key)
    ignored = [C] if pad is None else [C, pad]
    got = {}
    for row in L.with_labels(g, *ignored).collect():
        got.setdefault(row.seq_id, {})[row.pos] = row
    for i, s in enumerate(sequences):
        want, _, _ = plain(s, pad)
        for c in COLUMNS:
            assert [got[i][p][c] for p in range(len(s))] == want[c], (i, c)


def test_allowed_keys_match_masks(table, sequences):
    cells = A.mask_cells(table, marker_id=C, pad_id=P)
    rows = cells.select("seq_id", A.allowed_keys(F.col("cells"), A.marker_mask).alias("m"),
                        A.allowed_keys(F.col("cells"), A.causal_mask, causal=False).alias("c")).collect()
    for row in rows:
        _, mask, causal = plain(sequences[row.seq_id])
        assert row.m == [[k for k, ok in enumerate(r) if ok] for r in mask]
        assert row.c == [[k for k, ok in enumerate(r) if ok] for r in causal]


@pytest.mark.parametrize("pad", [P, None])
def test_key_lists(table, sequences, pad):
    for row in A.with_key_lists(table, marker_id=C, pad_id=pad).collect():
        _, mask, _ = plain(sequences[row.seq_id], pad)
        assert row["keys"] == [[k for k, ok in enumerate(r) if ok] for r in mask]


@pytest.mark.parametrize("use_markers", [True, False])
@pytest.mark.parametrize("block", [1, 4, 7])
def test_mask_blocks(table, sequences, use_markers, block):
    key = ["seq_id"]
    g = L.with_reach(L.with_groups(L.to_long(table, key), marker_id=C, pad_id=P, key=key), key)
    got = {(r.seq_id, r.q_block, r.k_block): (r.cells, r.full)
           for r in L.mask_blocks(g, block=block, use_markers=use_markers, key=key).collect()}
    in_row = L.mask_blocks_of(table, marker_id=C, pad_id=P, block=block, use_markers=use_markers, key=key)
    assert got == {(r.seq_id, r.q_block, r.k_block): (r.cells, r.full) for r in in_row.collect()}
    want = {}
    for i, s in enumerate(sequences):
        _, mask, causal = plain(s)
        m = mask if use_markers else causal
        area = {}
        for q in range(len(s)):
            for k in range(len(s)):
                t = (i, q // block, k // block)
                area[t] = area.get(t, 0) + 1
                if m[q][k]:
                    want[t] = want.get(t, 0) + 1
        want.update({t: (v, v == area[t]) for t, v in want.items() if t[0] == i})
    assert got == want


@pytest.mark.parametrize("use_markers", [True, False])
def test_mask_blocks_of_long_runs(spark, use_markers):
    """Runs and documents over many blocks, with and without pads."""
    rng = random.Random(8)
    rows = [[P if rng.random() < 0.02 else C if rng.random() < 0.03 else 1 for _ in range(n)] for n in (1, 31, 32, 33, 200, 200, 200)] + [[1] * 150]
    df = spark.createDataFrame(list(enumerate(rows)), "seq_id bigint, tokens array<int>")
    for pad in (P, None):
        want = {}
        for i, s in enumerate(rows):
            _, mask, causal = plain(s, pad)
            for q in range(len(s)):
                for k in range(len(s)):
                    want[i, q // 32, k // 32] = want.get((i, q // 32, k // 32), 0) + (mask if use_markers else causal)[q][k]
        got = L.mask_blocks_of(df, marker_id=C, pad_id=pad, block=32, use_markers=use_markers, key=["seq_id"]).collect()
        assert {(r.seq_id, r.q_block, r.k_block): r.cells for r in got} == {t: v for t, v in want.items() if v}


MASKS = {
    "marker": A.marker_mask,
    "causal": A.causal_mask,
    "window": lambda q, k: (q["pos"] - k["pos"] < 9) & (q["pos"] + 3 > k["pos"] - 1) & (q["doc"] == k["doc"]),
    "far": lambda q, k: ~(q["pos"] <= k["pos"] + 12) | (k["token"] != 1) & k["is_marker"],
    "all": lambda q, k: (q["pos"] >= 0) | q["is_pad"],
    "none": lambda q, k: (q["group"] < 0) & (k["pos"] > 2),
    "constant": lambda q, k: (1 - k["pos"] <= 1) & (q["doc"] >= k["doc"]),
}


@pytest.mark.parametrize("name", list(MASKS))
@pytest.mark.parametrize("pad", [P, None])
def test_tiles_of_any_mask(table, sequences, name, pad):
    """Tiles equal those counted from the same predicate asked pair by pair as columns."""
    mask = MASKS[name]
    cells = A.mask_cells(table, marker_id=C, pad_id=pad)
    pairs = {r.seq_id: r.m for r in cells.select("seq_id", A.allowed_keys(F.col("cells"), mask, causal=False).alias("m")).collect()}
    for row in T.with_tiles(table, mask, marker_id=C, pad_id=pad, block=4, key=["seq_id"]).collect():
        n, want = len(sequences[row.seq_id]), {}
        for q, keys in enumerate(pairs[row.seq_id]):
            for k in keys:
                want[q // 4, k // 4] = want.get((q // 4, k // 4), 0) + 1
        size = lambda b: min(4, n - 4 * b)
        assert {(t.q_block, t.k_block): (t.cells, t.full) for t in row.tiles} == {
            (q, k): (v, v == size(q) * size(k)) for (q, k), v in want.items()}
        assert row.skipped + row.filled + row.tested == row.n_tiles == (-(-n // 4)) ** 2


def test_zone_map_skips_tiles(spark):
    """A causal window over documents asks few tiles cell by cell."""
    tokens = ([1] * 63 + [P]) * 16
    df = spark.createDataFrame([(0, tokens), (1, []), (2, None)], "seq_id bigint, tokens array<int>")
    rows = {r.seq_id: r for r in T.with_tiles(df, A.causal_mask, marker_id=C, pad_id=P, block=32, key=["seq_id"]).collect()}
    assert (rows[0].n_tiles, rows[0].filled, rows[0].tested) == (1024, 16, 32) and rows[0].skipped == 976
    assert rows[1].tiles == rows[2].tiles == [] and rows[1].n_tiles == 0
    with pytest.raises(TypeError, match="with & |"):
        T.sequence_tiles(__import__("numpy").arange(9), lambda q, k: q["pos"] > 1 and k["pos"] > 1, 4, C, P)
