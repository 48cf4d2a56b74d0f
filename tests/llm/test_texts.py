import collections
import hashlib
import math
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomseq.llm import common, decontamination, language_id, license_scan, line_dedup, packing, quality, suffix_tree_lm as lm
from loomseq.llm.queries import remainder

DOCS = "doc_id long, text string, lang string, node string, at int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", 1, 0.5) for i, t, g in rows], DOCS)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def held(doc_id, divisor, part):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % divisor == part


# --- language ---

def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs, held_out=remainder(3) == 1).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(spark):
    rows = [(1, "the cat sat on the mat and the dog", "en"), (2, "der hund und die katze sind nicht da", "de"), (3, None, "en"), (4, "", "de"),
            (5, "123 !? \n", "de"), (6, "the dog and the cat", None), (None, "die katze und der hund", "de"), (7, "DIE KATZE UND DER HUND", None),
            (7, "DIE KATZE UND DER HUND", None), (8, "the dog " * 20_000, None)]
    df = frame(spark, rows)
    got = collections.defaultdict(list)
    for r in language_id.identify(df, held_out=F.lit(False)).collect():
        got[r.doc_id].append((r.lang_pred, round(r.score, 3)))
    assert [got[k][0][0] for k in (1, 2, 3, 4, 5, 6, None, 7, 8)] == ["en", "de", "und", "und", "und", "en", "de", "de", "en"]
    assert len(got[7]) == 2 and got[3] == [("und", 0.0)]
    assert {r.lang_pred for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string")), held_out=F.lit(False)).collect()} == {"und"}
    assert language_id.identify(df.limit(0), held_out=F.lit(False)).count() == 0


def plain_languages(rows, dimensions, seed):
    """Predictions by loops over letters: {doc_id: (cosines by language)}."""
    vectors = {}

    def letter(c):
        if c not in vectors:
            vectors[c] = np.random.default_rng([seed, ord(c)]).integers(0, 2, dimensions, dtype=np.int8) * 2.0 - 1
        return vectors[c]

    def bundle(text):
        padded = "\n" + "".join(c if c.isalpha() else "\n" for c in text.lower()) + "\n"
        counts = collections.Counter(padded[i - 1 : i + 2] for i in range(1, len(padded) - 1) if padded[i] != "\n")
        total = np.zeros(dimensions)
        for (a, b, c), n in counts.items():
            total += math.sqrt(n) * np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
        return total

    def unit(v):
        return v / np.linalg.norm(v)

    sums = {}
    for _, text, lang in rows:
        if lang:
            sums[lang] = sums.get(lang, 0) + bundle(text)
    prototypes = {lang: unit(v) for lang, v in sums.items()}
    mean = sum(prototypes.values()) / len(prototypes)
    return {i: {lang: float(unit(v - mean) @ unit(unit(bundle(text)) - mean)) for lang, v in prototypes.items()} for i, text, _ in rows}


def test_languages_equal_plain_loops(spark):
    rng = np.random.default_rng(4)
    letters = {"en": "etaoinshrdlu", "fr": "esaitnrulodcéàç", "ru": "оеаинтсрвлкм"}
    rows = []
    for i in range(60):
        lang = sorted(letters)[i % 3]
        text = " ".join("".join(rng.choice(list(letters[lang]), rng.integers(1, 9))) for _ in range(rng.integers(1, 40)))
        rows.append((i, text.title() + rng.choice(["", " 12!", "\n\n-- x"]), lang if i < 45 else None))
    settings = language_id.HyperSettings(dimensions=128)
    want = plain_languages(rows, 128, settings.seed)
    got = language_id.identify(frame(spark, rows), held_out=F.lit(False), settings=settings).collect()
    assert len(got) == len(rows)
    for r in got:
        best = max(want[r.doc_id].values())
        assert want[r.doc_id][r.lang_pred] >= best - 1e-4 and abs(r.score - min(max(best, 0), 1)) < 1e-4


# --- lines ---

def similar(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b), 1)


def test_lines(spark):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"word{k}" for k in rng.integers(0, 5000, n))
    shared, long, huge = text(12), text(120), text(1800)
    one_changed = long.split()
    one_changed[60] = "other"
    huge_changed = huge.split()
    huge_changed[900] = "other"
    own = [text(9) for _ in range(8)]
    rows = [
        (1, "\n".join([own[0], shared, "", long]), "en"), (2, "\n".join([shared.upper() + " !", own[1], " ".join(one_changed), "", " -- "]), "en"),
        (3, huge, "en"), (4, own[2] + "\n" + " ".join(huge_changed), "en"), (5, shared, "en"), (6, None, "en"), (7, "", "en"),
        (8, own[3] + "\n" + own[3], "en"), (9, own[4], "en"), (9, own[4], "en"), (None, own[5], "en"), (10, own[5], "en")]
    got = line_dedup.dedup_lines(frame(spark, rows).withColumn("n_lines", F.lit("old")))
    assert got.columns == ["doc_id", "text", "lang", "node", "at", "score", "n_lines", "n_removed"]
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append((r.text, r.n_lines, r.n_removed))
    assert by[1] == [(rows[0][1], 4, 0)]
    assert by[2] == [("\n".join([own[1], "", " -- "]), 5, 2)]
    assert by[3] == [(huge, 1, 0)] and by[4] == [(own[2], 2, 1)]
    assert by[5] == [("", 1, 1)] and by[6] == [(None, 0, 0)] and by[7] == [("", 1, 0)]
    assert by[8] == [(own[3], 2, 1)] and by[9] == [(own[4], 1, 0)] * 2
    assert by[None] == [(own[5], 1, 0)] and by[10] == [("", 1, 1)]
    assert line_dedup.dedup_lines(frame(spark, rows).limit(0)).count() == 0


def test_lines_with_equal_words_and_short_lines_with_few_edits(spark):
    rows = [
        (1, "thintionble$$$ onwh.\r\nPrinted on the 12th of January\n--\n \t", "en"), (2, "Thintionble  onwh\nprinted\ton the 12th of (January)\n--", "en"),
        (3, "invoicenumbers 2023 confidential", "en"), (4, "invoicenumbers 2024 confidential", "en"), (5, "invoicenumbers for others", "en"), (6, "ti |\nti.", "en")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("--", 2) and got[6] == ("ti |", 1)
    a, b = "invoicenumbers 2023 confidential", "invoicenumbers 2024 confidential"
    pairs = spark.createDataFrame([(a, b), (a, "invoicenumbers for others")], "a string, b string")
    assert [r.s for r in pairs.select(line_dedup._similar("a", "b", 0.8).alias("s")).collect()] == [similar(a, b) >= 0.8, False] == [True, False]


def test_recall_of_line_pairs_by_length(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(map(chr, rng.integers(97, 123, rng.integers(2, 10))))
    # (words, changed words): share of the pairs of edit similarity 0.8 and more that must be found
    least = {(3, 1): 0.97, (4, 1): 0.97, (6, 1): 0.97, (10, 1): 0.97, (20, 2): 0.97, (20, 4): 0.95, (50, 5): 0.95, (50, 10): 0.9, (100, 3): 0.97}
    rows, kind = [], {}
    for case in least:
        made = 0
        while made < 150:
            one = [word() for _ in range(case[0])]
            two = list(one)
            for at in rng.choice(case[0], case[1], replace=False):
                two[at] = word()
            if case[0] > 20 or similar(" ".join(one), " ".join(two)) >= 0.8:
                kind[len(rows) + 1] = case
                rows += [(len(rows), " ".join(one), "en"), (len(rows) + 1, " ".join(two), "en")]
                made += 1
    texts = dict((i, t) for i, t, _ in rows)
    out = line_dedup.dedup_lines(frame(spark, rows)).where("n_removed > 0").select("doc_id").collect()
    hit = collections.Counter(kind[r.doc_id] for r in out)
    whole = spark.createDataFrame([(i, texts[i - 1], texts[i]) for i in kind], "i long, a string, b string")
    alike = collections.Counter(kind[r.i] for r in whole.where(line_dedup._similar("a", "b", 0.8)).select("i").collect())
    found = {case: hit[case] / alike[case] for case in least}
    print(found)  # the README names these
    assert all(found[case] >= least[case] for case in least), found


def test_codes_of_the_longest_words(spark):
    lines = ["the house of the lions", "a b", "one", "x" * 300 + " " + "y" * 200 + " z", "the " * 700 + "house"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    nodes = line_dedup.occurrences(docs).orderBy("doc_id").collect()
    hashes = {w: h for w, h in spark.createDataFrame([(w,) for w in {w for x in lines for w in x.split()}], "w string").select("w", F.xxhash64("w")).collect()}
    for r in nodes:
        want = sorted((127 - min(len(w), 127)) << 56 | hashes[w] & (1 << 56) - 1 for w in set(lines[r.doc_id].split()))[:8]
        assert [r[f"t{k}"] for k in range(8) if r[f"t{k}"] is not None] == want
    sizes = {r.node: r["count"] for r in line_dedup._buckets(line_dedup.distinct_lines(line_dedup.occurrences(docs))).groupBy("node").count().collect()}
    assert [sizes.get(r.node, 0) for r in nodes] == [4, 1, 0, 4, 1]


def test_line_links_equal_all_pairs(spark):
    """Groups of made lines, in one hot bucket and many small ones, equal those of all pairs."""
    rng = np.random.default_rng(4)
    stems = [f"certification{k} documentation{k}" for k in range(3)]
    lines = sorted({f"{stems[k]} " + " ".join(f"w{j}" for j in rng.integers(0, 12, n)) for k, n in zip(rng.integers(0, 3, 260), rng.integers(2, 9, 260))})
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    parts, groups = line_dedup.line_groups(docs)
    number = {r.node: r.doc_id for r in parts.select("doc_id", "node").collect()}
    part = {number[r.node]: number[r.component] for r in groups.collect()}
    root = list(range(len(lines)))
    for a, x in enumerate(lines):
        for b in range(a):
            if abs(len(x) - len(lines[b])) <= 0.2 * max(len(x), len(lines[b])) and root[a] != root[b] and similar(x, lines[b]) >= 0.8:
                root = [root[a] if r == root[b] else r for r in root]
    pairs = lambda of: {(a, b) for a in range(len(lines)) for b in range(a) if of(a) == of(b)}
    assert pairs(lambda i: part.get(i, i)) == pairs(lambda i: root[i])


def test_long_lines_are_compared_by_the_stretches_between_anchors(spark, monkeypatch):
    """What is sure is a link; what isn't is compared as a whole, also where a bucket holds nothing else."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    base = [word(rng.integers(2, 10)) for _ in range(120)]
    lines = [" ".join(word(6) if rng.random() < 0.06 else w for w in base) for _ in range(25)]
    slips = [word(12 if k % 2 else 7) for k in range(60)]  # no two neighbours stay as they are
    lines += [" ".join(slips), " ".join(w if k % 2 else w[:3] + "q" + w[3:] for k, w in enumerate(slips))]
    lines += [" ".join(word(7) if k % 2 else w for k, w in enumerate(slips))]  # too many edits
    rows = [(x, y) for x in lines for y in lines]
    rows += [(" ".join(x.split()[:n]), " ".join(y.split()[:m])) for x, y in rows[::9] for n, m in ((1, 2), (2, 2), (30, 33), (70, 0))]
    got = spark.createDataFrame(rows, "a string, b string").select(
        "a", "b", line_dedup._surely_similar("a", "b", 0.8).alias("sure"), line_dedup._similar("a", "b", 0.8).alias("similar")).collect()
    assert all(r.similar for r in got if r.sure)
    assert all(r.similar == r.sure for r in got if max(len(r.a), len(r.b)) <= line_dedup.WHOLE or len(set(r.a.split()) & set(base)) > 90 < len(set(r.b.split()) & set(base)))
    seen = {}
    keep = line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name: seen.setdefault(name, keep(df, name)))
    parts, groups = line_dedup.line_groups(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert seen["apart"].count() <= 3  # of 328 pairs
    part = {r.doc_id: r.component for r in parts.join(groups, "node").collect()}
    assert sorted(part) == list(range(27)) and len({part[k] for k in range(25)}) == 1 and part[25] == part[26] != part[0]


def test_unlike_lines_with_a_common_passage_make_no_rows_of_pairs(spark, monkeypatch):
    """All meet in the buckets of the passage's long words; in tiles of a few lines too, the links are those of all pairs."""
    rng = np.random.default_rng(12)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = " ".join(word(14) for _ in range(8))
    lines = [" ".join(word(6) for _ in range(12)) + " " + passage for _ in range(90)]
    lines += [" ".join([word(6)] * (1 + k % 2) + x.split()[1 + k % 2:]) for k, x in enumerate(lines[:30])]
    long = [" ".join(word(5) for _ in range(110)) + " " + " ".join([passage] * 2) for _ in range(12)]
    lines += long + [" ".join(w if k % 2 or k > 109 else w[:2] + "q" + w[2:] for k, w in enumerate(x.split())) for x in long[:6]]  # found as a whole only
    monkeypatch.setattr(line_dedup, "TILE", 16)
    seen = []
    keep = line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name: seen.append((name, keep(df, name))) or seen[-1][1])
    parts, groups = line_dedup.line_groups(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    number = {r.node: r.doc_id for r in parts.select("doc_id", "node").collect()}
    part = {number[r.node]: number[r.component] for r in groups.collect()}
    rows = [(a, b, lines[a], lines[b]) for a in range(len(lines)) for b in range(a)]
    near = spark.createDataFrame(rows, "i int, j int, a string, b string").where(line_dedup._similar("a", "b", 0.8, (1,))).collect()
    root = list(range(len(lines)))
    for r in near:
        root = [root[r.i] if x == root[r.j] else x for x in root]
    assert len(near) > 30 and len(set(root)) > 90
    assert [(a, b) for a, b, *_ in rows if (part.get(a, a) == part.get(b, b)) != (root[a] == root[b])] == []
    assert {name: n for name, df in seen if (n := df.count()) > 10 * len(lines)} == {}  # 8,280 rows of pairs and more before


def test_steps_of_line_dedup_free_their_disk(spark, monkeypatch, tmp_path):
    """Shuffle files go when a step is written, tables when the removed lines are; later reads of the result need no more."""
    files = lambda: set(re.findall(r"\S+/shuffle_\S+", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))
    left = lambda: sum(Path(f).stat().st_size for f in files() - before if Path(f).exists())
    before, names = files(), []
    monkeypatch.setattr(common, "new_folder", lambda spark, name: names.append(f"{name}-{len(names)}") or f"{tmp_path}/{names[-1]}")
    rows = [(k, f"the quick brown fox number {k // 2} jumps\nother words in line {k} of it", "en") for k in range(60)]
    out = line_dedup.dedup_lines(frame(spark, rows))
    for _ in range(100):  # files are removed after the call
        if left() < 10_000:  # those of a count or a total stay
            break
        time.sleep(0.1)
    assert left() < 10_000 and len(names) > 20
    assert sorted(p.name for p in tmp_path.iterdir()) == names[-1:] and names[-1].startswith("removed-lines")
    assert out.count() == 60 and out.agg(F.sum("n_removed")).first()[0] >= 30
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, out.select("*").collect()))


def test_rounds_of_tiles_find_the_same_groups(spark, monkeypatch):
    """A bucket of many tiles is compared in rounds, each with a bounded number of copies, and all its pairs are."""
    rng = np.random.default_rng(21)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = " ".join(word(14) for _ in range(8))
    lines = [" ".join(word(6) for _ in range(14)) + " " + passage for _ in range(70)]
    lines += [" ".join([word(6)] * 2 + x.split()[2:]) for x in lines[:40]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    names, keep = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name: names.append(name) or keep(df, name))
    monkeypatch.setattr(line_dedup, "TILE", 8)

    def groups():
        parts, found = line_dedup.line_groups(docs)
        return sorted((r.doc_id, r.component) for r in parts.join(found, "node").collect())

    want, once = groups(), names.count("tiles-compared")
    monkeypatch.setattr(line_dedup, "ROUND_BYTES", 1)
    assert groups() == want and names.count("tiles-compared") - once > once == 2
    assert [i for i, _ in want] == [*range(40), *range(70, 110)] and len({c for _, c in want}) == 40


def test_edits_are_those_between_what_lines_begin_and_end_with_alike(spark):
    rng = np.random.default_rng(13)
    texts = ["", "a", "aa", "aaa", "ab", "ba", "aba", "éa", "aé", "aéa", "x" * 70, "x" * 71, "x" * 40 + "yé" + "x" * 30]
    texts += ["".join(rng.choice(list("ab é"), rng.integers(1, 40))) for _ in range(40)]
    rows = [(x, y) for x in texts for y in texts] + [(f"{x}{y}{x}", f"{x}{z}{x}") for x, y, z in zip(texts, texts[5:], texts[9:])]
    got = spark.createDataFrame(rows, "a string, b string").select(
        F.expr(line_dedup._whole("a", "b", 0.8)).alias("x"), line_dedup._similar("a", "b", 0.8, (1,)).alias("y")).collect()
    assert all(r.x == r.y for r in got) and sum(r.x for r in got) > len(texts)


def test_links_of_short_lines_equal_all_pairs(spark):
    """Whatever words they have: slips in lines of one or two words, blanks lost or put in, numbered lines."""
    rng = np.random.default_rng(11)
    lines = {"la ja", "la ra", "eding in", "eding enin", "somewhat", "some what", *(f"page {k}" for k in range(120))}
    for _ in range(220):
        line = "".join(rng.choice(list("abcdeé  "), rng.integers(3, line_dedup.SHORT + 1)))
        for _ in range(3):
            lines.add(" ".join(line.split()))
            at = rng.integers(0, len(line))
            line = line[:at] + rng.choice(list("abé ") + [""]) + line[at + rng.integers(0, 2):]
    lines = sorted(x for x in lines if 0 < len(x) <= line_dedup.SHORT)
    parts, groups = line_dedup.line_groups(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    number = {r.node: r.doc_id for r in parts.select("doc_id", "node").collect()}
    part = {number[r.node]: number[r.component] for r in groups.collect()}
    pairs = [(a, b) for a in range(len(lines)) for b in range(a)]
    near = lambda x, y: abs(len(x) - len(y)) <= 0.2 * max(len(x), len(y)) and similar(x, y) >= 0.8
    links = [(a, b) for a, b in pairs if near(lines[a], lines[b])]
    root = list(range(len(lines)))
    for a, b in links:
        root = [root[a] if r == root[b] else r for r in root]
    assert len(links) > 300
    assert [(lines[a], lines[b]) for a, b in pairs if (part.get(a, a) == part.get(b, b)) != (root[a] == root[b])] == []


def test_many_lines_of_one_document(spark):
    rng = np.random.default_rng(6)
    lines = ["".join(map(chr, rng.integers(97, 123, 9))) + " and " + "".join(map(chr, rng.integers(97, 123, 12))) for _ in range(5_000)]
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, "\n".join(lines * 2))], "doc_id long, text string")).first()
    assert got.n_lines == 10_000 and got.n_removed == 5_000 and got.text == "\n".join(lines)


def test_lines_of_the_table_against_normalised_equality_and_edit_similarity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    seen, kept, gone = set(), [], []
    norm = lambda line: " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line.lower()))
    for r in docs.orderBy("doc_id").collect():
        stay = iter(got[r.doc_id].split("\n") if got[r.doc_id] else [])
        ahead = next(stay, None)
        for line in r.text.split("\n"):
            if line == ahead and (norm(line) == "" or norm(line) not in seen):
                ahead = next(stay, None)
                kept.append(norm(line))
            else:
                gone.append(norm(line))
            seen.add(norm(line))
        assert ahead is None  # what stays is a part of the text, in its order
    assert len([k for k in kept if k]) == len({k for k in kept if k})
    fuzzy = [g for g in gone if g not in set(kept)]
    assert gone and all(any(abs(len(g) - len(k)) <= 0.2 * max(len(g), len(k)) and similar(g.split(), k.split()) > 0.5 for k in kept) for g in fuzzy)


# --- benchmark ---

def contamination_by_hand(docs, items, window=13):
    out = []
    for doc_id, text in docs:
        ws, hit, found = words(text), set(), set()
        for item, t in items:
            iw = words(t)
            n = min(window, len(iw))
            wanted = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if iw else set()
            for i in range(len(ws) - n + 1):
                if n and tuple(ws[i : i + n]) in wanted:
                    hit.update(range(i, i + n))
                    if item is not None:
                        found.add(str(item))
        ids = ",".join(sorted(found))
        out.append((doc_id, len(ws), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out, key=str)


def test_contamination_against_brute_force(spark):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 900, n))
    a, b, short, six = text(30), text(13), text(12), text(6)
    items = [(10, a), (9, b), (100, short), (101, "Lone!"), (102, six), (103, a[: len(a) // 2]), (104, None), (105, " ?"), (106, "same " * 20), (None, text(14))]
    docs = [(1, text(40) + " " + a + " " + text(30)), (2, text(500) + " " + b), (3, b.upper().replace(" ", ", ")), (4, None), (5, ""), (6, short),
            (7, "x " + six + " lone y"), (8, text(50)), (8, text(50)), (9, "same " * 50), (9, "same " * 50), (None, a), (11, " ".join(a.split()[3:15])),
            (12, items[-1][1]), (13, "É" + a)]
    got = decontamination.contamination(
        frame(spark, [(*d, "en") for d in docs]), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, len int")).drop("print")
    assert sorted(map(tuple, got.collect()), key=str) == contamination_by_hand(docs, items)
    blocks = decontamination.find_windows(
        frame(spark, [(*d, "en") for d in docs]), spark.createDataFrame(items, "item_id long, text string"), block=7)
    assert blocks[0].count() == len(docs)
    none = decontamination.contamination(frame(spark, [(*d, "en") for d in docs]), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("n_hit = 0 AND n_items = 0").count() == len(docs)
    assert decontamination.contamination(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# --- licenses ---

def test_licenses(spark):
    rows = [(1, "This is Licensed under the Apache License, Version 2.0."), (2, "x under the MIT license y, under the mit license"), (3, None), (4, ""),
            (5, "Licensed under CC BY-NC 4.0."), (6, "All rights reserved."), (7, "rights all reserved mit apache"), (8, "license version 2"),
            (9, "word " * 30_000 + "cc by nc"), (2, "x under the MIT license y, under the mit license"), (None, "apache license version 2"),
            (10, "This work is licensed under the GNU General Public License, version 3.")]
    got = collections.defaultdict(list)
    for r in license_scan.scan_licenses(frame(spark, [(*r, "en") for r in rows])).collect():
        got[r[0]].append(tuple(r)[1:])
    assert got[1] == [(10, 1, 5, 5, "apache-2", "apache-2", 1.0)]
    assert got[2] == [(10, 2, 1, 6, "mit", "mit", 1.0)] * 2
    assert got[3] == got[4] == [(0, 0, None, None, "", "", 0.0)]
    assert got[5][0][1:6] == (1, 2, 2, "cc-by-nc", "cc-by-nc") and got[6][0][4:] == ("", "all-rights-reserved", 1.0)
    assert got[7] == [(5, 0, None, None, "", "", 0.0)] and got[8] == [(3, 0, None, None, "", "", 0.0)]
    assert got[9][0][:4] == (30_003, 1, 30_000, 30_000) and got[None][0][1] == 1
    assert got[10][0][4:6] == ("", "gpl-3")
    assert license_scan.scan_licenses(frame(spark, [])).count() == 0


@pytest.mark.parametrize("text, labels", [
    ("Mozilla Public License Version 2.0", "mpl-2"), ("GNU General Public License version 3 29 June 2007", "gpl-3"),
    ("This file is under the terms of the GNU General Public License version 3", "gpl-3"), ("SPDX-License-Identifier: Apache-2.0", "apache-2"),
    ("CC BY-SA 4.0", "cc-by-sa"), ("SPDX-License-Identifier: MIT", "mit"), ("the GNU Lesser General Public License", "lgpl"), ("public license", "")])
def test_plain_license_texts(spark, text, labels):
    assert license_scan.scan_licenses(frame(spark, [(1, text, "en"), (2, "unlike words", "en")])).where("doc_id = 1").first().labels == labels


def licenses_by_hand(rows):
    """Labels and scores by looking at every word of every text."""
    bags = [words(t) for _, t in rows]
    df = collections.Counter(w for ws in bags for w in set(ws))
    idf = lambda w: math.floor(1000 * math.log((len(rows) + 1) / (df[w] + 1))) + 1
    out = []
    for (doc, _), ws in zip(rows, bags):
        labels, best = set(), 0.0
        for t in license_scan.TEMPLATES:
            whole, part = t.text.split(), t.key.split()
            rare = sorted(set(whole), key=lambda w: (df[w], w))[:license_scan.RARE]
            for at in range(len(ws)):
                if ws[at:at + len(part)] == part:
                    width = 2 * license_scan.SLACK
                    middle = (at - t.key_at + license_scan.SLACK) // width
                    met = {w for p, w in enumerate(ws) if w in rare for q, v in enumerate(whole) if v == w and (p - q) // width in (middle, middle - 1)}
                    labels.add(t.label)
                    best = max(best, sum(map(idf, met)) / sum(map(idf, rare)))
        out.append((doc, len(ws), ",".join(sorted(labels)), best))
    return out


def test_licenses_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    noise = lambda n: " ".join(rng.choice(["the", "license", "version", "free", "software", "of", "house", "2", "public", "word"], n))
    rows = []
    for k in range(80):
        ws = license_scan.TEMPLATES[k % len(license_scan.TEMPLATES)].text.split()
        lo = int(rng.integers(0, max(1, len(ws) // 2)))
        some = [w for w in ws[lo:] if rng.random() > 0.05]
        rows.append((k, f"{noise(rng.integers(0, 40))} {' '.join(some)} {noise(rng.integers(0, 60))}"))
    got = [(r.doc_id, r.n_words, r.labels, r.score) for r in license_scan.scan_licenses(frame(spark, [(*r, "en") for r in rows])).orderBy("doc_id").collect()]
    want = licenses_by_hand(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    assert sum(bool(w[2]) for w in want) > 40 and any(0 < w[3] < 1 for w in want)


# --- quality ---

def test_quality_of_held_out_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels, held_out=remainder(4) == 2).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) >= 0.93 * len(got)


def test_quality_of_odd_rows(spark):
    rows = [(1, "good text, with words", "en"), (2, "bad bad bad bad", "en"), (3, None, "en"), (4, "", "en"), (4, "", "en"), (None, "ok.", "en"), (5, "!" * 50_000, "en")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (99, 1), (None, 1)], "doc_id long, quality int")
    got = quality.score_quality(frame(spark, rows), labels, held_out=F.lit(False)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    alone = quality.score_quality(frame(spark, rows), labels.limit(0), held_out=F.lit(False)).collect()
    assert {r.score for r in alone} == {0.5}
    assert quality.score_quality(frame(spark, []), labels, held_out=F.lit(False)).count() == 0


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel.fitted(x[:3000], y[:3000])
    assert (0, 1) in model.pairs and ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


# --- language model ---

def test_scores_against_plain_counts(spark):
    rows = [(i, t) for i, t in enumerate(["The cat sat. the cat", "a dog\tand THE  cat ", None, "", "É É z", "unseen zzz", "the dog sat"] * 4)] + [(None, "the end"), (3, "twice"), (3, "twice")]
    got = lm.score_texts(frame(spark, [(*r, "en") for r in rows]), held_out=remainder(7) == 2).collect()
    token_lists = [[w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [None] for _, t in rows]
    count = collections.Counter(w for (i, _), ws in zip(rows, token_lists) if not held(i, 7, 2) for w in ws)
    total, kinds = sum(count.values()), len(count)
    want = sorted((str(i), held(i, 7, 2), len(ws), sum(count[w] > 0 for w in ws), total,
                   round(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in ws), 6)) for (i, _), ws in zip(rows, token_lists))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm.score_texts(frame(spark, []), held_out=F.lit(False)).count() == 0
    blank = lm.score_texts(frame(spark, [(1, "ab", "en")]), held_out=F.lit(True)).collect()[0]
    assert blank.train_tokens == 0 and abs(blank.score - 3 * math.log10(1 / 256)) < 1e-5


def test_automaton_follows_the_longest_context():
    texts = pa.array(["abracadabra abra", "cadabra", "b", "", "abra " * 80])
    _, joined = lm.prepared(texts)
    keys, n = lm.window_counts(joined, 3)
    rows = collections.Counter()
    for key, c in zip(keys.tolist(), n.tolist()):
        for k in range(4):
            rows[k, (key >> 8) & ((1 << 8 * k) - 1), key & 255] += c
    table = pa.table({"len": [r[0] for r in rows], "ctx": [r[1] for r in rows], "sym": [r[2] for r in rows], "n": list(rows.values()),
                      "apart": [r[0] > 0 for r in rows]})
    model = lm.Automaton.grown(3, table)
    unseen = 256 - (model.log.shape[1] - 1)
    chances = 10.0 ** model.log.astype(float)
    assert np.allclose(chances[:, :-1].sum(axis=1) + unseen * chances[:, -1], 1, atol=1e-5)
    of = collections.defaultdict(collections.Counter)
    for (k, ctx, sym), c in rows.items():
        of[k, ctx][sym] += c

    def chance(context, sym):
        p = (of[0, 0][sym] + 1) / (sum(of[0, 0].values()) + 256)
        for k in range(1, 4):
            seen = of.get((k, int.from_bytes(context[-k:], "big")))
            if seen is None:
                break
            p = (seen[sym] + len(seen) * p) / (sum(seen.values()) + len(seen))
        return p

    want = []
    for t in joined.to_pylist():
        stream = b"\xff" * 3 + t.encode() + b"\n"
        want.append(sum(math.log10(chance(stream[i - 3 : i], stream[i])) for i in range(3, len(stream))))
    assert np.allclose(model.scores(joined), want, atol=1e-3)


def test_words_are_spelled_whole():
    joined = lm.prepared(pa.array(["abra cad abra", "", "é", "b " * 700, " a "]))[1]
    keys, n = lm.window_counts(joined, 2)
    rows = collections.Counter()
    for key, c in zip(keys.tolist(), n.tolist()):
        for k in range(3):
            rows[k, (key >> 8) & ((1 << 8 * k) - 1), key & 255] += c
    model = lm.Automaton.grown(2, pa.table({
        "len": [r[0] for r in rows], "ctx": [r[1] for r in rows], "sym": [r[2] for r in rows], "n": list(rows.values()),
        "apart": [r[0] > 0 for r in rows]}))
    word, kind, some = model.spelled(joined)
    of = np.repeat(np.arange(5), [3, 1, 1, 700, 1])
    assert np.allclose(np.bincount(of, word + kind + some), model.scores(joined), atol=1e-4)
    assert word[3] == 0 and (np.count_nonzero(some) == 4) and (word <= 1e-9).all() and (kind <= 1e-9).all()


def test_scores_against_plain_mixture(spark):
    rows = [(i, t) for i, t in enumerate(["the cat sat", "", "A cat  and\ta dog", "the the", None, "zebra", "é cat", "dog " * 300] * 2)]
    settings = lm.TreeSettings(depth=2, min_share=0.0, level=-1e3, trust=0.3)
    got = lm.score_texts(frame(spark, [(*r, "en") for r in rows]), held_out=remainder(7) == 2, settings=settings).collect()
    plain = [" ".join((t or "").lower().split()).encode() for _, t in rows]
    learnt = [t for (i, _), t in zip(rows, plain) if not held(i, 7, 2)]
    of = collections.defaultdict(collections.Counter)
    for t in learnt:
        stream = b"\xff\xff" + t + b"\n"
        for at in range(2, len(stream)):
            for k in range(3):
                of[stream[at - k : at]][stream[at]] += 1
    count = collections.Counter(w for t in learnt for w in t.split())

    def chance(context, sym):
        p = (of[b""][sym] + 1) / (sum(of[b""].values()) + 256)
        for k in (1, 2):
            seen = of.get(context[-k:])
            if seen is None:
                break
            p = (seen[sym] + len(seen) * p) / (sum(seen.values()) + len(seen))
        return p

    def score(t):
        stream, empty = b"\xff\xff" + t + b"\n", chance(b"\xff\xff", 10)
        if not t:
            return math.log10(empty)
        total, at = math.log10(1 - empty), 2
        for w in t.split():
            spelled = 1 / (1 - empty) if at == 2 else 1.0
            for b in w:
                spelled, at = spelled * chance(stream[at - 2 : at], b), at + 1
            either = chance(stream[at - 2 : at], 32) + chance(stream[at - 2 : at], 10)
            total += math.log10(0.3 * count[w] / sum(count.values()) + 0.7 * spelled * either)
            total, at = total + math.log10(chance(stream[at - 2 : at], stream[at]) / either), at + 1
        return total

    want = {i: score(t) for (i, _), t in zip(rows, plain)}
    assert all(abs(r.score - want[r.doc_id]) < 1e-3 for r in got) and len(got) == len(rows)


def test_rare_words_and_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").unionByName(docs.selectExpr("1000000L + doc_id", "concat('qj', doc_id, 'vx ', doc_id)").limit(40).toDF("doc_id", "text"))
    once, never = ({r.doc_id: r.score for r in lm.score_texts(rows, held_out=out).where("doc_id >= 1000000").collect()}
                   for out in (F.lit(False), F.col("doc_id") >= 1000000))
    assert all(once[i] > never[i] + 2 for i in once)  # a single occurrence among 400,000 words is remembered
    bits = {}
    for trust in (1e-9, lm.TreeSettings().trust):
        got = lm.score_texts(docs, held_out=remainder(7) == 2, settings=lm.TreeSettings(trust=trust)).where("held_out")
        bits[trust] = got.agg(F.sum("score")).first()[0]
    assert bits[lm.TreeSettings().trust] > bits[1e-9]  # held-out texts are likelier than by spelling alone


# --- packing ---

def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text, "en") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(9001, None, "en"), (9002, "", "en"), (9003, "Don't <|endoftext|> stop, we're İSTANBUL ﬁne é a_b 12,5%%% naïve x", "en"), (9004, "word " * 30_000, "en")]
    pieces = packing.pack_documents(frame(spark, rows).repartition(3)).toPandas()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: np.array(e.ids + [1], dtype="<u4") for (i, _, _), e in zip(rows, tokenizer.encode_batch([t or "" for _, t, _ in rows], add_special_tokens=False))}
    for p in pieces.itertuples():
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
    for by, at in (("doc_id", "start"), ("sequence_id", "offset")):
        ordered = pieces.sort_values([by, at])
        assert (ordered[at] == ordered.groupby(by).length.cumsum() - ordered.length).all()
    filled = pieces.groupby("sequence_id").length.sum()
    assert (filled == pieces.groupby("sequence_id").context.first()).all() and set(filled) <= {1 << k for k in range(12)}
    assert (filled >= 256).mean() > 0.9 and pieces.length.sum() == sum(map(len, ids.values()))
    assert pieces.groupby("step_group").context.nunique().max() == 1
    assert packing.pack_documents(frame(spark, [])).count() == 0
    twice = packing.pack_documents(frame(spark, [(None, "a b", "en"), (None, "a b", "en")])).collect()
    assert sum(r.length for r in twice) == 6 and {r.doc_id for r in twice} == {None}


def test_quality_features_of_64_bit_offsets():
    texts = ["One, two. Three!", None, "", "é" * 30]
    assert np.array_equal(quality.text_features(pa.array(texts)), quality.text_features(pa.array(texts, pa.large_string()).slice(0)))
