"""Secrets in texts, told apart from copied examples by who has them.

A pass over the texts finds places that look like credentials: assignments to
names such as ``password``, access key ids, long hexadecimal runs, and other long
mixed runs as mere candidates. The hash of every value is then counted over the
whole corpus by distinct repositories and owners. A value of one owner in few
repositories looks live; one that many share is an example that was copied
around. Candidates are reported only if they look live. Values leave the pass as
hashes only.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

# Kinds in their order, and the patterns of the base ones.
KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: a text without any of these has no assignment
_NAMES = ("passw", "secret", "token", "api")


@dataclass(frozen=True)
class SecretSettings:
    #: most owners and repositories of a value that looks live
    owners: int = 1
    repositories: int = 4
    #: length and distinct characters of a candidate, which has a letter and a digit too
    length: int = 20
    distinct: int = 10


def _runs(least: int) -> re.Pattern:
    return re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % least)


_SPOTS = _runs(LEAST["access"])  # access keys and hexadecimal runs lie inside such a run


def find_spans(text: str, settings: SecretSettings = SecretSettings()) -> tuple[list[tuple[int, int, int, str]], list]:
    """Base spans and candidates of a text: (start, number of the kind, end, value), in order."""
    base, free = [], []
    low = text.lower()
    if any(name in low for name in _NAMES):
        base += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for spot in _SPOTS.finditer(text):
        run, at = spot[0], spot.start()
        base += [(at + m.start(), 1, at + m.end(), m[0]) for m in ACCESS.finditer(run) if len(m[0]) >= LEAST["access"]]
        if len(run) >= LEAST["hex"]:
            base += [(at + m.start(), 2, at + m.end(), m[0]) for m in HEX.finditer(run) if len(m[0]) >= LEAST["hex"]]
        mixed = any(c.isdigit() for c in run) and any(c.isalpha() for c in run)
        if len(run) >= settings.length and mixed and len(set(run)) >= settings.distinct:
            free.append((at, 3, spot.end(), run))
    base.sort()
    return base, _apart(free, base)


def _apart(free: list, base: list) -> list:
    """Candidates that overlap no base span; both lists are in order of their starts."""
    out, at, reach = [], 0, 0
    for c in free:
        while at < len(base) and base[at][0] < c[2]:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= c[0]:
            out.append(c)
    return out


def join_spans(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in spans)


_ROWS = ("doc_id long, repository string, owner string, row long, base_sha256 string, "
         "spans array<struct<start:long,kind:int,end:long,value:string>>")
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.string())]))


def _scan(settings: SecretSettings, strip: int = 256):
    hashed = lambda value: hashlib.blake2b(value.encode(), digest_size=16).hexdigest()

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, strip):
                part = batch.slice(at, strip)
                digests, spans = [], []
                for text in part.column("text").to_pylist():
                    base, free = find_spans(text or "", settings)
                    digests.append(hashlib.sha256(join_spans(base).encode()).hexdigest())
                    spans.append([{"start": s, "kind": k, "end": e, "value": hashed(v)} for s, k, e, v in base + free])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("repository"), part.column("owner"),
                    pa.array(range(row, row + part.num_rows), pa.int64()), pa.array(digests, pa.string()), pa.array(spans, _SPAN),
                ], ["doc_id", "repository", "owner", "row", "base_sha256", "spans"])
                row += part.num_rows

    return run


def find_secrets(docs: DataFrame, *, repository: Column | str = "doc_id", owner: Column | str = "source",
                 settings: SecretSettings = SecretSettings()) -> DataFrame:
    """Spans of secrets in ``docs`` (doc_id, text): one row per input row.

    ``repository`` and ``owner`` say where a text belongs; a null one counts as one
    of its own name, the empty text. Returns doc_id, n_assign, n_access, n_hex (base
    spans), base_sha256 (of ``kind:start:end`` of the base spans, by start, then
    kind, comma-joined; code points, end exclusive), spans (base spans and candidates that
    look live, kind ``live``, joined likewise), n_live and n_copied (base spans and
    candidates by how their value is shared). Candidates that overlap a base span of
    their text don't count. Null and empty texts have no spans; repeated
    rows get a row each, and count as one repository; an empty table gives no row.
    """
    named = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), named(repository).alias("repository"), named(owner).alias("owner"),
        F.col("text").cast("string").alias("text"))
    found = written(rows.mapInArrow(_scan(settings), _ROWS), "secret-spans")
    spans = found.select("row", "repository", "owner", F.explode("spans").alias("s")).select(
        "row", "repository", "owner", "s.start", "s.kind", "s.end", "s.value")
    # each value once per repository and owner before it is counted, so a value that all share is combined early
    held = written(spans.select("value", "owner", "repository").distinct(), "secret-holders")
    owners = held.select("value", "owner").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("owners"))
    repositories = held.select("value", "repository").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("repositories"))
    live = (F.col("owners") <= settings.owners) & (F.col("repositories") <= settings.repositories)
    status = written(owners.join(repositories, "value").select("value", live.alias("live")), "secret-values")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    marked = written(spans.join(status, "value").select(
        "row", "start", "kind", "live", F.concat_ws(":", kind, "start", "end").alias("name")), "secret-marks")
    shown = F.when((F.col("kind") < 3) | F.col("live"), F.struct("start", "kind", "name"))
    per = marked.groupBy("row").agg(
        *[F.count_if(F.col("kind") == i).alias(f"n_{name}") for i, name in enumerate(KINDS[:3])],
        F.array_sort(F.collect_list(shown)).alias("shown"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return found.drop("spans").join(per, "row", "left").select(
        "doc_id", count("n_assign"), count("n_access"), count("n_hex"), "base_sha256",
        F.coalesce(F.array_join(F.col("shown.name"), ","), F.lit("")).alias("spans"), count("n_live"), count("n_copied"))
