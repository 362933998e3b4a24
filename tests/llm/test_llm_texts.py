"""Exact dedup, line dedup, fingerprints and mixing on small tables, against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from vanemesh.llm import exact_dedup, fingerprints, line_dedup, mixing

DOCS = "doc_id long, text string, lang string, source string, digest string, keep int, seq long, row long, size int"
ROWS = [
    (3, "Same TEXT", "en", "a"), (5, "same text", "en", "b"), (5, "same text", "en", "b"), (1, None, None, None), (2, "", "en", "a"),
    (None, "same Text", "en", "a"), (7, "ÄÖ", "de", "a"), (8, "äö", "de", "a"), (9, "x" * 50_000, "en", None), (10, "alone", "en", "z"),
]


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2, 3, 4) for r in rows], DOCS)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("capacity", [2, 4096])
def test_exact_dedup_by_digest(spark, capacity):
    got = sorted(map(tuple, exact_dedup.resolve(docs_of(spark, ROWS), capacity).collect()), key=str)
    groups = {}
    for doc_id, text, *_ in ROWS:
        groups.setdefault(lowered(text), []).append(doc_id)
    kept = {}
    for doc_id, keep_id, size, stays, sha in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == sha)
        assert size == len(groups[text])
        assert keep_id == max((i for i in groups[text] if i is not None), default=None)
        kept.setdefault(sha, []).extend([doc_id] if stays else [])
    assert all(len(v) == 1 for v in kept.values()) and len(kept) == len(groups)
    assert len(got) == len(ROWS)


def test_exact_dedupe_keeps_whole_rows(spark):
    docs = docs_of(spark, ROWS)
    out = exact_dedup.dedupe(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.digest, r.seq) for r in out.collect()) == [(i, "d", 2) for i in (2, 5, 7, 8, 9, 10)]
    assert exact_dedup.dedupe(docs.limit(0)).count() == 0
    assert exact_dedup.resolve(docs.limit(0)).count() == 0


def test_misra_gries_keeps_what_is_frequent():
    rng = random.Random(1)
    stream = ["hot"] * 400 + [f"k{rng.randrange(500)}" for _ in range(600)]
    rng.shuffle(stream)
    counts = {}
    for at in range(0, 1000, 50):
        part = {}
        for x in stream[at:at + 50]:
            part[x] = part.get(x, 0) + 1
        counts = exact_dedup.merge_counts(counts, part, 9)
    assert len(counts) <= 9
    assert 400 - 1000 / 10 <= counts["hot"] <= 400


LINES = [
    (4, "A shared line here\nown one of four\n  a SHARED line here\t"), (2, "a shared line here\nshort\na shared line here"), (6, "short\nshort\nshort"),
    (9, None), (8, ""), (None, "own one of four\nanother thing"), (2, "own one of four"), (7, "\n\nzehn Zeichen ä\n"), (11, "ZEHN ZEICHEN ä\r"),
]


def expected_lines(rows, key_chars=10):
    blanks, last = " \t\n\x0b\x0c\r", float("inf")
    first = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            key = lowered(line.strip(blanks))
            first[key] = min(first.get(key, last), last if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(k := lowered(x.strip(blanks))) < key_chars or (last if doc_id is None else doc_id) <= first[k]]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (6, 3)])
def test_line_dedup_whatever_the_batches(spark, batches, fanout):
    rng = random.Random(batches)
    pool = [f"line number {i}" for i in range(12)] + ["short", ""]
    rows = LINES + [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 6)))) for i in range(20, 60)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, line int")
    got = line_dedup.drop_repeated(docs, batches, fanout)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected_lines(rows)
    assert line_dedup.drop_repeated(docs.limit(0), batches, fanout).count() == 0


def test_compacted_runs_hold_every_digest_once(spark):
    runs = line_dedup.Runs(fanout=2)
    for k in range(5):
        runs.add(spark.range(10 * k, 10 * k + 10).select(F.col("id").cast("string").cast("binary").alias("digest")))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert runs.all().count() == runs.all().distinct().count() == 50


def word_shingles(text):
    words = lowered(text).split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_fingerprints_follow_the_edits(spark):
    rng = random.Random(3)
    texts = {i: " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 40, 900]))) for i in range(30)}
    texts |= {30: None, 31: "", 32: texts[3].upper(), 33: "é" * 101}
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, sketch string, next int")
    rows = {r.doc_id: r for r in fingerprints.compare_edited(docs).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(own) // 2
        edited = own[:len(own) - half] + after[:half]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        a, b = word_shingles(own), word_shingles(edited)
        assert len(r.sketch) <= max(len(a), 0) and (len(r.sketch) > 0) == bool(a)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(a) > 800 and b:
            assert abs(r.jaccard_edited - len(a & b) / len(a | b)) < 0.15
    assert rows[32].sketch == rows[3].sketch
    assert rows[30].sketch == rows[31].sketch == []
    assert fingerprints.compare_edited(docs.limit(0)).count() == 0


def test_fingerprints_of_parts_merge(spark):
    words = [f"w{i}" for i in range(400)]
    left, right = " ".join(words[:250]), " ".join(words[200:])
    row = spark.createDataFrame([(left, right, " ".join(words))], "a string, b string, both string").select(
        *(fingerprints.sketch(F.col(c)).alias(c) for c in ("a", "b", "both")))
    r = row.select("both", fingerprints.merge(F.col("a"), F.col("b")).alias("m"), fingerprints.containment(F.col("a"), F.col("both")).alias("inside")).first()
    assert r.m == r.both and r.inside == 1.0


def test_fingerprints_of_short_texts(spark):
    rng = random.Random(8)
    rows = []
    for i in range(720):
        words = [f"w{rng.randrange(10**6)}" for _ in range(5 + i % 36)]
        changed = words[:len(words) // 2] + [f"v{rng.randrange(10**6)}" for _ in range(len(words) - len(words) // 2)]
        around = [f"x{rng.randrange(10**6)}" for _ in range(100)]
        rows.append((i, " ".join(words), " ".join(around + words), " ".join(changed)))
    found = spark.createDataFrame(rows, "i int, short string, long string, changed string").select(
        "i", *(fingerprints.sketch(F.col(c)).alias(c) for c in ("short", "long", "changed"))).select(
        "i", fingerprints.containment(F.col("short"), F.col("long")).alias("inside"), fingerprints.jaccard(F.col("short"), F.col("changed")).alias("near")).collect()
    wrong = [0.0] * 720
    for r in found:
        _, a, _, b = (word_shingles(t) if isinstance(t, str) else t for t in rows[r.i])
        wrong[r.i] = abs(r.near - len(a & b) / len(a | b))
    blind = [r.i for r in found if r.inside < 1]
    assert len(blind) < 0.05 * 720 and all(r.inside == 0 for r in found if r.i in blind)
    assert not [i for i in blind if i % 36 >= 15]
    assert sum(wrong) / 720 < 0.12


def test_next_document_crosses_ranges_and_ties(spark):
    rows = [(5, "b"), (5, "a"), (9, "x"), (None, "n"), (1, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text): r.next.text for r in fingerprints.with_next(docs, ["text"], 16).collect()}
    assert got == {(9, "x"): "b", (5, "b"): "a", (5, "a"): "q", (1, "q"): "n", (None, "n"): "x"}


def mixed_rows(n=3000):
    rng = random.Random(9)
    sources = ["b"] * 5 + ["a", "Z", None, "é", "empty"]
    rows = []
    for i in range(n):
        source = rng.choice(sources)
        rows.append((i, "" if source == "empty" else "w " * rng.choice([1, 3, 10, 60]), "en", source))
    return rows


def expected_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 3 * sizes[s] for s in over}
        free -= over
    return target


def test_mixture_meets_its_targets(spark):
    rows = mixed_rows() + [(5000, None, "en", "a"), (5001, "w " * 5, "en", "a"), (5001, "w " * 5, "en", "a"), (None, "w", "en", "a")]
    docs = docs_of(spark, rows)
    got = mixing.mixture(docs).collect()
    sizes, taken, most = {}, {}, {}
    for (_, text, _, source) in rows:
        n = len((text or "").split())
        sizes[source] = sizes.get(source, 0) + n
        most[source] = max(most.get(source, 0), n)
    target = expected_targets(sizes)
    for r in got:
        source = next(s for s in sizes if sizes[s] == r.source_size and abs(target[s] - r.target) < 1e-6)
        taken[source] = taken.get(source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert len(got) == len(rows)
    for s, t in target.items():
        assert abs(taken[s] - t) <= most[s], s
    again = mixing.mixture(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_repeats_whole_rows(spark):
    docs = docs_of(spark, [(1, "a b c", "en", "x"), (2, "d e f", "en", "y"), (2, "d e f", "en", "y")])
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    words = {s: 3 * sum(r.source == s for r in out.collect()) for s in "xy"}
    assert abs(words["x"] - 3) <= 3 and abs(words["y"] - 6) <= 3
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixture(docs.limit(0)).count() == 0
    nothing = docs_of(spark, [(1, None, "en", None), (2, " ", "en", "y")])
    assert {r.taken for r in mixing.mixture(nothing).collect()} == {0}


def test_meetings_keep_the_words_and_leave_one_open():
    import numpy as np

    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 500, 200), rng.random(200)
    out = mixing.meet(size, p, rng.integers(-2**62, 2**62, 200), 0)
    assert abs((size * out).sum() - (size * p).sum()) < 1e-6
    assert ((out > 0) & (out < 1)).sum() <= 1
