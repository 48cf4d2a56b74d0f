"""Straight Python loops that say what the operators must give."""


def with_markers(ids, stride, marker):
    out = []
    for i, t in enumerate(ids):
        out.append(t)
        if stride > 0 and (i + 1) % stride == 0 and i + 1 < len(ids):
            out.append(marker)
    return out


def cut(lengths, target):
    """Shard number, index and offset of each non-empty document; closed shard count."""
    rows, shard, ix, run = [], 0, 0, 0
    for key, n in lengths:
        if n == 0:
            continue
        rows.append((key, shard, ix, run, run + n))
        ix, run = ix + 1, run + n
        if run >= target:
            shard, ix, run = shard + 1, 0, 0
    return rows


def pack(docs, length):
    """Closed bins of one rank as lists of (key, length)."""
    bins, open_, run = [], [], 0
    for key, n in docs:
        if n == 0:
            continue
        open_.append((key, n))
        run += n
        if run >= length:
            bins.append(open_)
            open_, run = [], 0
    return bins


def build(docs, length, stride, marker, bos, pad):
    out = []
    for ids in docs:
        out += [bos, *with_markers(ids, stride, marker), pad]
    return out[:length]
