"""Ranked lexical search: every document is ranked for every item of a query set, by presence masks.

Terms are runs of ASCII letters and digits and of all other code points from 128 on, with A-Z lowered. A document's score for an
item adds up w * ((1000000000*tf) div (1000*tf + 8*m)) over the item's distinct terms, in whole numbers; w is
floor(1000*ln((2*N+2)/(2*df+1))) and m is 10 + ((90*n*N) div L), from the document's length n and the whole table's N, L and df.

1. One pass over the texts writes, for each document with a term, its length and the frequencies of the terms that any item has.
   N, L and df come from that table.
2. A block of documents keeps one bitmap for each term: which documents hold it. For each item the bitmaps of its terms, shifted to
   their places and joined by OR, are the documents' masks; equal masks are one group.
3. A mask's maximum is the sum of what its terms give at most in the block. The groups are evaluated by descending maximum, until it
   is below the last of the best that the task has found so far: then no document that is left can enter the ranking.
4. The tasks' rankings, k rows an item each, are merged: the window's limit works before the shuffle.

The query set is read in blocks of ITEMS rows. Null text has no terms: such a document is never found and such an item finds nothing.
Rows that repeat a doc_id are ranked on their own; equal scores go by ascending doc_id, null last. Rows that repeat an item are items
of their own. Empty tables give no rows. Only doc_id, item_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import settle

# Rows of a ranking; items of a block of the query set; documents of a block of bitmaps.
K = 10
ITEMS = 2000
DOCS = 8192
# Groups that are evaluated before the maximum is looked at again: as many at first, then twice as many each time.
STEP = 4
# Terms of a mask's word.
WORD = 63
# Bytes above 127 belong to code points above 127, so the pattern holds for UTF-8.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text: bytes | None) -> list[bytes]:
    return TERM.findall(text.lower()) if text else []  # bytes are lowered for A-Z only


@dataclass
class Items:
    """A block of the query set: the items' ids, and the places of their distinct terms in ``vocabulary``."""

    ids: list
    terms: list[np.ndarray]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]]) -> Items:
        vocabulary: dict[bytes, int] = {}
        found = []
        for _, text in rows:
            found.append(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in dict.fromkeys(terms((text or "").encode()))], np.int64))
        return cls([i for i, _ in rows], found, vocabulary)


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A written table of the documents with a term: doc_id, n (terms with repeats), and place and tf of those in ``vocabulary``."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            lengths, places, counts, rows = [], [], [], []
            for i, text in enumerate(batch.column(1).cast(pa.large_binary())):
                found = terms(text.as_py())
                if found:
                    hits = Counter(map(get, found))
                    hits.pop(None, None)
                    rows.append(i)
                    lengths.append(len(found))
                    places.append(list(hits))
                    counts.append(list(hits.values()))
            yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()),
                                   pa.array(places, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "places", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    written = settle(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, places array<int>, tf array<long>"), "postings")
    known.destroy()
    return written


@dataclass
class Statistics:
    """N, L, and the weight of each term of the vocabulary."""

    documents: int
    length: int
    weight: np.ndarray


def statistics(rows: DataFrame, size: int) -> Statistics:
    """From the written postings; df comes to the driver for the vocabulary of the items only."""
    documents, length = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["place"]: r["df"] for r in rows.select(F.explode("places").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("df")).collect()}
    return Statistics(documents, length, np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(size)], np.int64))


def impacts(tf: np.ndarray, n: np.ndarray, stats: Statistics) -> np.ndarray:
    """(1000000000*tf) div (1000*tf + 8*m); in Python's numbers where 64 bits could overflow."""
    top = max(int(n.max(initial=0)), int(tf.max(initial=0)))
    if 90 * top * stats.documents >= 2**63 or 10**9 * top >= 2**63:
        n, tf = n.astype(object), tf.astype(object)
    m = 10 + (90 * n * stats.documents) // stats.length
    return ((1_000_000_000 * tf) // (1000 * tf + 8 * m)).astype(np.int64)


@dataclass
class Block:
    """Documents of a block: their postings by document, and one bitmap for each term that occurs."""

    doc_ids: list
    ends: np.ndarray
    places: np.ndarray
    impact: np.ndarray
    bitmaps: np.ndarray = field(init=False)
    highest: np.ndarray = field(init=False)
    row: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        present, at = np.unique(self.places, return_inverse=True)
        bits = np.zeros((len(present), len(self.doc_ids)), bool)
        bits[at, np.repeat(np.arange(len(self.doc_ids)), np.diff(self.ends))] = True
        self.bitmaps = np.packbits(bits, axis=1)
        self.highest = np.zeros(len(present), np.int64)
        np.maximum.at(self.highest, at, self.impact)
        self.row = np.full(int(present.max(initial=-1)) + 1, -1)
        self.row[present] = np.arange(len(present))

    def masks(self, terms: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents in the order of their groups, where each group starts in it, and each group's maximum. Documents without a
        term of the item are in no group."""
        rows = self.row[terms[terms < len(self.row)]]
        weights = weight[terms[terms < len(self.row)]][rows >= 0]
        rows = rows[rows >= 0]
        n = len(self.doc_ids)
        words = np.zeros((n, max(1, -(-len(rows) // WORD))), np.int64)
        for i, row in enumerate(rows):
            words[:, i // WORD] |= np.unpackbits(self.bitmaps[row], count=n).astype(np.int64) << (i % WORD)
        order = np.lexsort(words.T)
        order = order[words[order].any(axis=1)]
        sorted_ = words[order]
        first = np.flatnonzero(np.concatenate([[True], (sorted_[1:] != sorted_[:-1]).any(axis=1)])) if len(order) else np.empty(0, np.int64)
        held = (sorted_[first][:, np.arange(len(rows)) // WORD] >> (np.arange(len(rows)) % WORD)) & 1
        return order, first, held @ (weights * self.highest[rows])

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of documents of the block; ``weight`` is 0 for terms that the item does not have."""
        n = np.diff(self.ends)[docs]
        at = np.repeat(self.ends[docs] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.add.reduceat(weight[self.places[at]] * self.impact[at], np.cumsum(n) - n) if len(docs) else np.empty(0, np.int64)


def search(block: Block, terms: np.ndarray, weight: np.ndarray, best: list[tuple], k: int) -> list[tuple]:
    """``best`` (score, doc_id) with the documents of ``block`` that belong to it."""
    order, first, highest = block.masks(terms, weight)
    ends = np.append(first[1:], len(order))
    by = np.argsort(-highest, kind="stable")
    own = np.zeros(len(weight), np.int64)
    own[terms] = weight[terms]
    at, step = 0, STEP
    while at < len(by):
        least = best[-1][0] if len(best) == k else 1
        if highest[by[at]] < least:
            break
        some = by[at:at + step][highest[by[at:at + step]] >= least]
        docs = np.concatenate([order[first[g]:ends[g]] for g in some])
        score = block.scores(docs, own)
        good = np.flatnonzero(score >= least)
        if len(good) > k:  # ties with the k-th stay
            good = good[score[good] >= np.partition(score[good], -k)[-k]]
        best = sorted([*best, *((int(score[i]), block.doc_ids[docs[i]]) for i in good)], key=_rank)[:k]
        at, step = at + len(some), step * 2
    return best


def _rank(found: tuple) -> tuple:
    score, doc_id = found
    return -score, doc_id is None, doc_id if doc_id is not None else 0


def blocks(batches: Iterator[pa.RecordBatch], stats: Statistics) -> Iterator[Block]:
    for batch in batches:
        for at in range(0, len(batch), DOCS):
            part = batch.slice(at, DOCS)
            ends = part.column(2).offsets.to_numpy().astype(np.int64)
            n = np.repeat(part.column(1).to_numpy(), np.diff(ends))
            yield Block(part.column(0).to_pylist(), ends - ends[0], part.column(2).flatten().to_numpy(),
                        impacts(part.column(3).flatten().to_numpy(), n, stats))


def rank(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each row of ``items`` (item_id, text), of all ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    numbered = settle(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    kinds = [docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()]
    out, last = [], -1
    while rows := numbered.where(F.col("item") > last).orderBy("item").limit(ITEMS).collect():
        last = rows[-1].item
        out.append(_rank_block(docs, Items.of([(r.item_id, r.text) for r in rows]), k, kinds))
    if not out:
        return spark.createDataFrame([], f"item_id {kinds[1]}, rank int, doc_id {kinds[0]}, score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _rank_block(docs: DataFrame, items: Items, k: int, kinds: list[str]) -> DataFrame:
    rows = postings(docs, items.vocabulary)
    stats = statistics(rows, len(items.vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast((items.terms, stats))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value
        best: list[list[tuple]] = [[] for _ in own]
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for block in blocks([batch], known):
                best = [search(block, t, known.weight, b, k) for t, b in zip(own, best, strict=True)]
        found = [(i, doc_id, score) for i, b in enumerate(best) for score, doc_id in b]
        if found:
            i, doc_ids, scores = zip(*found, strict=True)
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(doc_ids, kind), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    found = rows.select("doc_id", "n", "places", "tf").mapInArrow(run, f"item int, doc_id {kinds[0]}, score long")
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame(list(enumerate(items.ids)), f"item int, item_id {kinds[1]}")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
