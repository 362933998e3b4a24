"""Byte-level BPE: encoding by folded merges over distinct words, decoding by concatenation.

1. Every task splits its texts by the pattern and counts its distinct words; the counts are added up.
2. Spark's higher-order functions encode distinct words: a fold over a word's bytes merges, step by step, the leftmost
   adjacent pair of the lowest rank. The ranks are a literal: an array of small maps, found by the checksum of the pair.
   Bytes are written as the characters of the same number, so that binary pieces can be keys of that map.
   That is done once for each of the at most HEAD most frequent words, which are broadcast as a dictionary. Words that stand in
   few texts are no fewer than the texts they stand in, so the fold encodes them where they stand, once for each text.
3. A task looks up the words of its texts in the dictionary, and puts in what the fold gave for the rare ones.
4. Decoding concatenates the binary pieces of the ids.

Null text counts as empty and has no ids. Texts that look like special tokens are ordinary text. A word is folded in a
number of steps that grows with its bytes, each of which copies what is left of it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import sys
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.scale import settle
from .text import give_back, thrifty, whole

# Words that every task holds, and their bytes at most: with four bytes an id, less than 160 bytes each even if no two bytes
# merge, some 30 as a rule.
HEAD = 800_000
LONGEST = 32
# Bytes of a batch of rows for Python: texts, their words and ids stand next to the dictionary in a worker's memory.
BATCH_BYTES = 4 << 20
ADAPTIVE = "spark.sql.adaptive.enabled"
# Distinct words that a task gathers before it passes on their counts.
GATHER = 500_000
# Maps of the ranks, a power of two: each is some objects in every plan and task that holds them.
BUCKETS = 1 << 14
NONE = 2**31 - 1
PLACE_BITS = 31
PLACES = 1 << PLACE_BITS
# A letter that stands for no byte.
EDGE = "\u0100"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def rank_literal(ranks: dict[bytes, int], buckets: int = BUCKETS) -> Column:
    """The ranks as one literal, array<map<string, int>>: Catalyst folds the parsing away."""
    maps: list[dict[str, int]] = [{} for _ in range(buckets)]
    for token, rank in ranks.items():
        key = token.decode("latin-1")
        maps[zlib.crc32(key.encode()) % buckets][key] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def encode_word(word: Column, ranks: dict[bytes, int], buckets: int = BUCKETS) -> Column:
    """Token ids of one word, array<int>.

    The state of the fold has one number for each part: the rank of the pair that the part makes with the next one, and where the part
    starts. So the least number is the leftmost of the lowest pairs. A letter that is no byte stands before and behind the word; no pair
    with it has a rank.
    """
    none = F.array().cast("array<int>")

    def encoded(letters: Column, maps: Column) -> Column:
        def rank(piece: Column) -> Column:
            place = F.crc32(piece.cast("binary")).bitwiseAND(F.lit(buckets - 1)).cast("int")
            return F.coalesce(F.element_at(F.get(maps, place), piece), F.lit(NONE))

        def starts(part: Column) -> Column:
            return part.bitwiseAND(F.lit(PLACES - 1)).cast("int")

        def pair(start: Column, end: Column) -> Column:
            return number(rank(F.substring(letters, start, end - start)), start)

        def number(rank: Column, start: Column) -> Column:
            return F.shiftleft(rank.cast("long"), PLACE_BITS).bitwiseOR(start.cast("long"))

        n = F.length(letters)
        first = F.concat(F.transform(F.sequence(F.lit(1), n - 1), lambda i: number(rank(F.substring(letters, i, F.lit(2))), i)),
                         F.transform(F.array(n, n + 1), lambda i: number(F.lit(NONE), i)))

        def merge(parts: Column, best: Column, at: Column) -> Column:
            """Join the parts ``at`` and ``at`` + 1 (1-based); only the pairs beside them change."""
            before, behind, next_end = (starts(F.get(parts, at + i)) for i in (-2, 1, 2))
            return F.concat(F.slice(parts, F.lit(1), at - 2), F.array(pair(before, behind), pair(starts(best), next_end)), F.slice(parts, at + 2, n))

        def step(parts: Column, _: Column) -> Column:
            return let(F.array_min(parts), lambda best: F.when(best >= NONE * PLACES, parts).otherwise(
                let(F.array_position(parts, best).cast("int"), lambda at: merge(parts, best, at))))

        def finish(parts: Column) -> Column:
            return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 3),
                               lambda part, i: let(starts(part), lambda s: rank(F.substring(letters, s, starts(F.get(parts, i + 2)) - s))))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 3, F.lit(1))), first, step, finish)

    def looked_up(letters: Column, maps: Column) -> Column:
        # A word that is a token as a whole needs no merges.
        whole_word = F.element_at(F.get(maps, F.crc32(letters.cast("binary")).bitwiseAND(F.lit(buckets - 1)).cast("int")), letters)
        return let(whole_word, lambda known: F.when(known.isNotNull(), F.array(known)).otherwise(
            let(F.concat(F.lit(EDGE), letters, F.lit(EDGE)), lambda w: encoded(w, maps))))

    letters = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    return F.when(F.length(word) > 0, let(rank_literal(ranks, buckets), lambda m: let(letters, lambda w: looked_up(w, m)))).otherwise(none)


def members(kind: str) -> str:
    """The 16-bit code points of a Unicode class as ranges inside a bracket expression."""
    low, high = "".join(map(chr, range(0xD800))), "".join(map(chr, range(0xE000, 0x10000)))
    runs = [m[0] for part in (low, high) for m in regex.finditer(f"{kind}+", part)]
    return "".join(re.escape(r[0]) if len(r) == 1 else f"{re.escape(r[0])}-{re.escape(r[-1])}" for r in runs)


@cache
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern. Texts of 16-bit code points take the standard library's engine, with the Unicode classes
    spelled out, which is faster."""
    split = regex.compile(pattern).findall
    letters, numbers, blanks = (members(kind) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    # No match ends inside a run of one class, so the runs are never tried again with fewer characters.
    plain = pattern.replace(r" ?\p{L}+|", r" \p{L}++|\p{L}++|").replace(r"\p{N}+|", r"\p{N}++|").replace(r"[^\s\p{L}\p{N}]+|", r"[^\s\p{L}\p{N}]++|")
    plain = plain.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{numbers}]")
    for kind, inside in ((r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\S", f"[^{blanks}]"), (r"\s", f"[{blanks}]")):
        plain = plain.replace(kind, inside)
    if r"\p" in plain:
        return split
    short = re.compile(plain).findall
    return lambda text: short(text) if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else split(text)


def count_words(docs: DataFrame, pattern: str) -> DataFrame:
    """word and n over all texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = splitter(pattern), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(split(text))
                if len(counts) >= GATHER:
                    yield given(counts)
        yield given(counts)

    def given(counts: Counter) -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return batch

    return docs.select(whole("text")).mapInArrow(thrifty(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(words: DataFrame, head: int = HEAD, longest: int = LONGEST) -> DataFrame:
    """At most ``head`` words of at most ``longest`` bytes: all from some frequency on that occur more than once.

    ``words`` is a written table. Frequencies are told apart to an eighth of a power of two, so the driver sees a few hundred rows.
    """
    level = F.floor(F.log2("n") * 8)
    usable = words.where((F.col("n") > 1) & (F.octet_length("word") <= longest))
    total, least = 0, None
    for row in usable.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        total += row["count"]
        if total > head:
            break
        least = row["level"]
    return usable.where(level >= least) if least is not None else usable.limit(0)


def dictionary(docs: DataFrame, ranks: dict[bytes, int], pattern: str, head: int = HEAD, longest: int = LONGEST) -> pa.Table:
    """word and ids (32-bit numbers, packed) of the frequent words of ``docs``, each encoded once by Spark."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.array(x, np.int32).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], ["word", "ids"])

    words = frequent_words(settle(count_words(docs, pattern), "words"), head, longest).select("word")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    encoded = words.repartition(n, "word").select("word", encode_word(F.col("word"), ranks).alias("ids"))
    with told_once(docs.sparkSession):
        packed = settle(encoded.mapInArrow(pack, "word string, ids binary"), "dictionary")
    entries = packed.toArrow()
    give_back()
    return entries


@contextmanager
def told_once(spark: SparkSession) -> Iterator[None]:
    """While a table is written, its plan stays as it is: adaptive execution would tell the driver's listeners the plan's text, with all
    ranks in it, again after every stage. The number of tasks is given, so there is nothing to adapt."""
    before = spark.conf.get(ADAPTIVE)
    spark.conf.set(ADAPTIVE, "false")
    try:
        yield
    finally:
        spark.conf.set(ADAPTIVE, before)


class Numbers(dict):
    """Word to its number (four packed bytes), in the order in which words come."""

    def __missing__(self, word: str) -> bytes:
        number = self[word] = len(self).to_bytes(4, sys.byteorder)
        return number


class Dictionary:
    """The frequent words and their ids. They travel and stay as two Arrow columns; a worker finds a word in a sorted array of hashes
    and compares it, so an entry takes some 40 bytes there. Of two words with one hash the second counts as rare."""

    def __init__(self, table: pa.Table):
        self.table = table.combine_chunks()

    def __getstate__(self) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.table.schema) as writer:
            writer.write_table(self.table, max_chunksize=20_000)
        return sink.getvalue().to_pybytes()

    def __setstate__(self, state: bytes) -> None:
        batches = list(pa.ipc.open_stream(state))
        none = np.empty(0, np.int64)
        hashes = np.concatenate([none, *(hashes_of(b.column(0).to_pylist()) for b in batches)])
        self.places = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.places]
        self.words = pa.concat_arrays([pa.array([], pa.string()), *(b.column(0) for b in batches)])
        packed = [b.column(1) for b in batches]
        self.ids = np.frombuffer(b"".join(x for column in packed for x in column.to_pylist()), np.int32)
        sizes = [pc.binary_length(column).to_numpy() // 4 for column in packed]
        self.ends = np.concatenate([[0], np.cumsum(np.concatenate([none, *sizes]))])

    def find(self, words: list[str]) -> np.ndarray:
        """Place of every word in the dictionary, -1 where it is not in there."""
        if not words or not len(self.hashes):
            return np.full(len(words), -1)
        at = np.searchsorted(self.hashes, hashes_of(words))
        places = self.places[np.minimum(at, len(self.places) - 1)]
        same = pc.equal(self.words.take(pa.array(places)), pa.array(words, pa.string()))
        return np.where(same.to_numpy(zero_copy_only=False), places, -1)


def hashes_of(words: list[str]) -> np.ndarray:
    return np.fromiter(map(hash, words), np.int64, len(words))


def looked_up(texts: list[str | None], split: Callable[[str], list[str]], known: Dictionary) -> tuple[pa.ListArray, pa.ListArray]:
    """Ids of the known words of every text, with -1, -2 ... for its first, second ... rare word, and its rare words."""
    numbers = Numbers()
    get = numbers.__getitem__
    rows = [np.frombuffer(b"".join(map(get, split(text or ""))), np.int32) for text in texts]
    words = list(numbers)
    word = np.concatenate([np.empty(0, np.int32), *rows])
    ends = np.cumsum([0, *map(len, rows)])
    place = known.find(words)[word] if words else word
    gaps = np.flatnonzero(place < 0)
    # Rare words are numbered inside their text: the number counts from the text's first pair of text and word.
    row = np.searchsorted(ends, gaps, "right") - 1
    pairs, pair = np.unique(row * max(len(words), 1) + word[gaps], return_inverse=True)
    first = np.searchsorted(pairs, np.arange(len(texts) + 1) * max(len(words), 1))
    rare = pa.ListArray.from_arrays(
        pa.array(first.astype(np.int32)), pa.array(words, pa.string()).take(pa.array(pairs % max(len(words), 1))))
    place[gaps] = 0
    size = known.ends[place + 1] - known.ends[place] if len(known.ids) else np.ones(len(place), np.int64)
    size[gaps] = 1
    to = np.concatenate([[0], np.cumsum(size)])
    inside = np.arange(to[-1]) - np.repeat(to[:-1], size)
    # A gap reads the first entry here, which is then written over.
    ids = known.ids[np.repeat(known.ends[place], size) + inside] if len(known.ids) else np.empty(to[-1], np.int32)
    ids[to[gaps]] = first[row] - pair - 1
    return pa.ListArray.from_arrays(pa.array(to[ends].astype(np.int32)), pa.array(ids)), rare


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, head: int = HEAD, longest: int = LONGEST,
           reader: Reader | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``docs`` (text and more; none named ids or rare) with ``ids``, array<int>, in the place of the text. From here on the session
    gives Python batches of ``batch_bytes``.

    A ``reader`` works on the ids in the worker that puts them together, which saves a worker and the way of the ids to it.
    """
    known = docs.sparkSession.sparkContext.broadcast(Dictionary(dictionary(docs, ranks, pattern, head, longest)))
    give_back()  # the driver held the dictionary and what was written of it for the workers
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch_bytes)
    at = docs.columns.index("text")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, words = splitter(pattern), known.value
        for batch in batches:
            yield pa.record_batch(
                [*(c for i, c in enumerate(batch.columns) if i != at), *looked_up(batch.column(at).to_pylist(), split, words)],
                [*(n for i, n in enumerate(batch.schema.names) if i != at), "ids", "rare"])

    def put_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns[:-2], spliced(*batch.columns[-2:])], batch.schema.names[:-1])

    none = F.array().cast("array<int>")
    with_rare = docs.drop("text").withColumns({"ids": none, "rare": F.array().cast("array<string>")})
    found = docs.mapInArrow(thrifty(look_up), with_rare.schema)
    folded = found.withColumn("rare", F.transform("rare", lambda w: encode_word(w, ranks)))
    with_ids = with_rare.drop("rare")
    if reader is None:
        return folded.mapInArrow(thrifty(put_in), with_ids.schema)
    return folded.mapInArrow(thrifty(lambda batches: reader.run(put_in(batches))), reader.schema(with_ids))


def spliced(ids: pa.ListArray, rare: pa.ListArray) -> pa.ListArray:
    """``ids`` with -1, -2 ... replaced by the ids of the first, second ... of the row's ``rare`` words, all rows at once."""
    flat, ends = ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
    words = rare.flatten()
    if not len(words):
        return ids
    pieces, starts = words.flatten().to_numpy(), words.offsets.to_numpy() - words.offsets[0].as_py()
    first = rare.offsets.to_numpy() - rare.offsets[0].as_py()
    row = np.repeat(np.arange(len(ids)), np.diff(ends))
    gaps = np.flatnonzero(flat < 0)
    word = first[row[gaps]] - 1 - flat[gaps]
    size = np.ones(len(flat), np.int64)
    size[gaps] = starts[word + 1] - starts[word]
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(to[-1], np.int32)
    plain = flat >= 0
    out[to[:-1][plain]] = flat[plain]
    n = size[gaps]
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(to[gaps], n) + inside] = pieces[np.repeat(starts[word], n) + inside]
    return pa.ListArray.from_arrays(pa.array(to[ends].astype(np.int32)), pa.array(out))


def pieces_of(ranks: dict[bytes, int]) -> list[bytes]:
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return pieces


class Reader(NamedTuple):
    """Columns that follow from ids: their types, a function of a batch's ids, and whether the ids stay beside them."""

    columns: dict[str, str]
    read: Callable[[pa.ListArray], list[pa.Array]]
    keep_ids: bool

    def schema(self, rows: DataFrame) -> StructType:
        kept = rows if self.keep_ids else rows.drop("ids")
        return kept.withColumns({name: F.lit(None).cast(kind) for name, kind in self.columns.items()}).schema

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if self.keep_ids or n != "ids"]
            told = self.read(batch.column(batch.schema.names.index("ids")))
            yield pa.record_batch([*(c for _, c in kept), *told], [*(n for n, _ in kept), *self.columns])

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(self.run, self.schema(rows))


class Pieces:
    """What the ids stand for, as one Arrow column: the pieces of many ids are taken at once and stand behind each other."""

    def __init__(self, pieces: list[bytes]):
        self.column = pa.array(pieces, pa.large_binary())

    def joined(self, ids: pa.ListArray) -> pa.LargeBinaryArray:
        """The pieces of each row's ids, concatenated."""
        taken = self.column.take(ids.flatten())
        ends = ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py()
        _, offsets, data = taken.buffers()
        at = np.frombuffer(offsets, np.int64, len(taken) + 1, taken.offset * 8)[ends] if len(taken) else np.zeros_like(ends)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at), data])


def sha256s(column: pa.LargeBinaryArray, cut: int = 0) -> pa.Array:
    """SHA-256 of each value, in hex, without its last ``cut`` bytes."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1).tolist()
    view = memoryview(data if data is not None else b"")
    return pa.array([hashlib.sha256(view[a:max(a, b - cut)]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string())


def decoder(spark: SparkSession, ranks: dict[bytes, int]) -> Reader:
    pieces = spark.sparkContext.broadcast(Pieces(pieces_of(ranks)))

    def read(ids: pa.ListArray) -> list[pa.Array]:
        return [pieces.value.joined(ids).cast(pa.binary())]

    return Reader({"bytes": "binary"}, read, True)


def digester(spark: SparkSession, ranks: dict[bytes, int]) -> Reader:
    pieces = pieces_of(ranks)
    both = spark.sparkContext.broadcast((Pieces([b"%d," % i for i in range(len(pieces))]), Pieces(pieces)))

    def read(ids: pa.ListArray) -> list[pa.Array]:
        names, texts = both.value
        return [pc.list_value_length(ids).cast(pa.int64()), sha256s(names.joined(ids), 1), sha256s(texts.joined(ids))]

    return Reader({"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, read, False)


def decode(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``rows`` (ids and more; none named bytes) with ``bytes``: the pieces of the ids, concatenated."""
    return decoder(rows.sparkSession, ranks).apply(rows)


def digests(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (in decimal, joined by commas) and of the bytes that they decode to, for ``rows``
    (doc_id, ids)."""
    return digester(rows.sparkSession, ranks).apply(rows.select("doc_id", "ids"))
