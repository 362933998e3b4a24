"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram's vector binds (multiplies) those of its
letters, permuted (rotated) by their place. A text's vector bundles (adds) the vectors of all its trigrams, a language's
prototype those of all its learning texts: trigram counts are added up per language by Spark, so the prototypes are exact
sums whatever the partitions. A text gets the language of the largest cosine.

Letters are lowered; everything else is a blank, runs of blanks are one. Null texts and texts without a letter, and all
texts when nothing was learned, are ``und`` with score 0. Ties go to the first language by name. Only rows with text and a
language teach. Prototypes are broadcast: one vector for each distinct language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import settle

DIM = 1024
SEED = 20
UNKNOWN = "und"
# Code points of a text that are looked at at once; (language, trigram) counts that a task gathers before it passes them on.
CHUNK = 1 << 20
GATHER = 1 << 20
MASK = (1 << 21) - 1


@cache
def alphabet() -> np.ndarray:
    """The lowered letter of every code point, or a blank."""
    table = np.full(0x110000, 32, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            table[cp] = ord(c.lower()[0])
    return table


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text (three code points of 21 bits) and their counts."""
    keys, counts, tail = [], [], np.array([32], np.uint32)
    for at in range(0, len(text or ""), CHUNK):
        points = np.frombuffer(text[at:at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.concatenate([tail, alphabet()[points], [32] if at + CHUNK >= len(text) else []]).astype(np.uint64)
        keep = np.ones(len(letters), bool)
        keep[1:] = (letters[1:] != 32) | (letters[:-1] != 32)
        letters = letters[keep]
        tail = letters[-2:]
        if len(letters) > 2:
            k, n = np.unique(letters[:-2] << np.uint64(42) | letters[1:-1] << np.uint64(21) | letters[2:], return_counts=True)
            keys.append(k)
            counts.append(n)
    if len(keys) > 1:
        return add_up(np.concatenate(keys), np.concatenate(counts))
    return (keys[0], counts[0]) if keys else (np.empty(0, np.uint64), np.empty(0, np.int64))


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, counts, len(found)).astype(np.int64)


@lru_cache(maxsize=1 << 15)
def letter(cp: int, place: int) -> np.ndarray:
    """The vector of a letter, rotated by its place in the trigram."""
    return np.roll(np.random.default_rng([SEED, cp]).integers(0, 2, DIM, np.int8) * 2 - 1, place)


def bundle(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the vectors of trigrams, each as often as it counts (exact: whole numbers in floating point)."""
    total = np.zeros(DIM)
    for at in range(0, len(keys), 2048):
        k, n = keys[at:at + 2048].astype(np.int64), counts[at:at + 2048]
        bound = None
        for shift, place in ((42, 2), (21, 1), (0, 0)):
            points, which = np.unique(k >> shift & MASK, return_inverse=True)
            vectors = np.stack([letter(p, place) for p in points.tolist()])[which]
            bound = vectors if bound is None else np.multiply(bound, vectors, out=bound)
        kind = np.float32 if n.sum() < 1 << 24 else np.float64
        total += n.astype(kind) @ bound.astype(kind)
    return total


def count_trigrams(docs: DataFrame) -> DataFrame:
    """lang, key, n over all ``docs`` (lang, text) that have both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def given() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, counts = add_up(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                yield pa.record_batch([pa.repeat(lang, len(keys)), pa.array(keys.astype(np.int64)), pa.array(counts)], ["lang", "key", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = trigrams(text)
                held.setdefault(lang, []).append(found)
                size += len(found[0])
            if size >= GATHER:
                yield from given()
                size = 0
        yield from given()

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return known.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes of the languages of ``docs`` (lang, text), scaled to length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pandas()
            keys, counts = batch.column(1).to_numpy().astype(np.uint64), batch.column(2).to_numpy()
            for lang, rows in langs.groupby(langs).indices.items():
                sums[lang] = sums.get(lang, 0) + bundle(keys[rows], counts[rows])
        for lang, v in sums.items():
            yield pa.record_batch([pa.repeat(lang, DIM), pa.array(np.arange(DIM)), pa.array(v.astype(np.int64))], ["lang", "dim", "v"])

    counts = settle(count_trigrams(docs), "trigrams")
    sums = counts.mapInArrow(run, "lang string, dim long, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v"))
    prototypes: dict[str, np.ndarray] = {}
    for lang, dim, v in sums.collect():
        prototypes.setdefault(lang, np.zeros(DIM))[dim] = v
    return {lang: v / max(np.linalg.norm(v), 1e-12) for lang, v in sorted(prototypes.items())}


def judge(text: str | None, langs: list[str], prototypes: np.ndarray) -> tuple[str, float]:
    keys, counts = trigrams(text)
    if not langs or not len(keys) or not (keys != np.uint64(32 << 42 | 32 << 21 | 32)).any():
        return UNKNOWN, 0.0
    v = bundle(keys, counts)
    cosines = prototypes @ v / max(np.linalg.norm(v), 1e-12)
    best = int(np.argmax(cosines))
    return langs[best], float(min(max(cosines[best], 0.0), 1.0))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` (text and more; no column named lang_pred or score) with lang_pred and score, from the text alone."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((list(prototypes), np.stack(list(prototypes.values())) if prototypes else np.empty((0, DIM))))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = model.value
        for batch in batches:
            found = [judge(t, langs, matrix) for t in batch.column(at).to_pylist()]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.record_batch([*columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                  [*names, "lang_pred", "score"])

    schema = docs.drop("text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return docs.mapInArrow(run, schema)
