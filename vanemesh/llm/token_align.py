"""Cross-tokenizer alignment: the tokens of a byte-level BPE (A) and of a piece model (B) over the same bytes.

Both encode every text; the bytes of their tokens are compared with a space and the text. Divide and conquer at shared cuts gives
the groups: an end that both have is located by bisection near the middle of an interval, both halves are treated the same way (all
intervals of a depth at once), and an interval without a shared end inside is a leaf group. In intervals of at
most FEW tokens all ends are compared at once. A link is a pair of an A and a B token whose bytes overlap. The count of
a pair of ids is the number of documents (rows) that hold it linked, over the whole corpus.

1. ``align`` writes ids and groups of every text once.
2. ``link_counts`` adds up, batch by batch before the shuffle, in how many documents each pair is linked.
3. ``score`` looks up the counts of a document's pairs. At most HEAD of the most frequent pairs travel to the tasks as sorted arrays.
   All pairs below a frequency are left to a join on the pair; none of them is in more than a HEAD-th of all links, so no key is hot.

Null and empty texts, and texts whose tokens do not give their bytes back, have no tokens, groups or links. Rows that repeat an id or
a text are documents of their own; a null id is an id like others. An empty table gives an empty table. Only doc_id and text are read,
so other columns may have any name. A text is one row and one task; its alignment takes time in proportion to n log n tokens.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import keep, settle
from .bpe import splitter

# Pairs that every task holds with their counts, 16 bytes each: at most 32 MB.
HEAD = 2_000_000
# Bytes of text that are encoded, and tokens that are linked, at once.
TEXT_BYTES = 1 << 18
TOKENS = 300_000
# Tokens of A in an interval that is not halved any more.
FEW = 64
# Bytes of a batch of rows for Python.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
# Words whose A ids, and stretches whose A and B ids, a worker keeps, some 150 and 350 bytes each.
KEPT = 400_000
# Letters whose classes are the same in every edition of Unicode; texts of these alone are split into words here.
PLAIN = re.compile(r"[\t\n\r\x20-\x7E\xA1-\xFF]*")
SPLIT = splitter(PATTERN)
# A blank with no letter behind it. Without one, PLAIN texts fall into stretches that each begin at a blank: no word of A and no piece
# of B reaches over the blank.
LOOSE = re.compile(r" (?![^ \t\n\r])")


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it can be seen, else the next free letter from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


def faithful(b_model: bytes) -> bool:
    """Whether the pieces of a PLAIN text are its letters behind one blank, unless one is unknown: the model merges pairs and changes no
    letter."""
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:
        return False
    model = sentencepiece_model_pb2.ModelProto.FromString(b_model)
    trainer, rules, kind = model.trainer_spec, model.normalizer_spec, model.SentencePiece
    as_is = rules.add_dummy_prefix and rules.escape_whitespaces and not (rules.remove_extra_whitespaces or rules.precompiled_charsmap)
    return bool(trainer.model_type == trainer.BPE and as_is and not trainer.treat_whitespace_as_suffix
                and {p.type for p in model.pieces} <= {kind.NORMAL, kind.UNKNOWN, kind.CONTROL, kind.BYTE})


class Tokenizers:
    """Both models. Their files travel to the workers, which build the models when they first use them."""

    def __init__(self, a_json: str, b_model: bytes, b_faithful: bool | None = None):
        self.files = a_json, b_model, faithful(b_model) if b_faithful is None else b_faithful
        self._build()

    @classmethod
    def load(cls, a_path: str, b_path: str) -> Tokenizers:
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            return cls(a.read(), b.read())

    def __getstate__(self) -> tuple[str, bytes, bool]:
        return self.files

    def __setstate__(self, files: tuple[str, bytes, bool]) -> None:
        self.__init__(*files)

    def _build(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores already
        import sentencepiece
        import tokenizers

        a_json, b_model, self.faithful = self.files
        self.a = tokenizers.Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        self.letters = {b: c for c, b in letters.items()}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        special = {x["id"] for x in json.loads(a_json)["added_tokens"]}
        for entry, i in self.a.get_vocab().items():
            self.bytes_a[i] = entry.encode() if i in special else bytes(letters[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        # Pieces with a blank behind a letter would join stretches; those of blanks alone need two blanks in a row.
        self.apart = self.faithful and all(set(p) == {"▁"} for p in pieces if "▁" in p[1:])
        self.stretches: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.words: dict[str, bytes] = {}
        self.strange: set[str] = set()  # stretches whose tokens do not give their bytes back
        self.odd: set[str] = set()  # words whose tokens do not give their bytes back
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b)]

    def encode_a(self, texts: Sequence[str]) -> list[np.ndarray]:
        """A's ids of a space and each text. Where all letters are PLAIN, the words are split here and each distinct one is encoded
        once; they are kept for the next texts, up to KEPT words."""
        plain = [bool(PLAIN.fullmatch(t)) for t in texts]
        split = [SPLIT(" " + t) for t, p in zip(texts, plain, strict=True) if p]
        new = list({w for words in split for w in words if w not in self.words})
        if len(self.words) + len(new) > KEPT:
            self.words.clear()
            self.odd.clear()
            new = list({w for words in split for w in words})
        for word in new:
            letters = word.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.a.model.tokenize(letters)]
            self.words[word] = np.array(ids, np.int32).tobytes()
            if b"".join([self.bytes_a[i] for i in ids]) != word.encode():
                self.odd.add(word)
        rest = iter(self.a.encode_batch_fast([" " + t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        ready = iter(split)
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, next(ready))), np.int32) if p else np.array(next(rest).ids, np.int32) for p in plain]

    def encode(self, texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text by both models; none where the tokens' bytes are not a space and the text. Texts that fall into stretches
        are put together from those, each distinct one encoded once; the others are encoded whole."""
        cut = [t.split(" ") if self.apart and PLAIN.fullmatch(t) and not LOOSE.search(" " + t) else None for t in texts]
        self.learn([c for c in cut if c])
        known = [c and not (self.strange and not self.strange.isdisjoint(c)) for c in cut]
        rest = self.encode_whole([t for t, k in zip(texts, known, strict=True) if not k])
        get_a, get_b = (x.__getitem__ for x in self.stretches)
        for c, k in zip(cut, known, strict=True):
            yield (np.frombuffer(b"".join(map(get_a, c)), np.int32), np.frombuffer(b"".join(map(get_b, c)), np.int32)) if k else next(rest)

    def learn(self, cut: Sequence[list[str]]) -> None:
        """Keep the ids of the stretches of texts. New ones make up a text of their own; if its tokens do not give its bytes back, each
        is tried alone."""
        new = set().union(*cut).difference(self.stretches[0])
        if len(self.stretches[0]) + len(new) > KEPT:
            for x in (*self.stretches, self.strange):
                x.clear()
            new = set().union(*cut)
        together = list(new - self.strange)
        for parts in ([together], [[x] for x in together]) if together else ():
            found = list(self.encode_whole([" ".join(part) for part in parts]))
            for part, ids in zip(parts, found, strict=True):
                at = np.cumsum([len(x.encode()) + 1 for x in part])
                for kept, own, sizes in zip(self.stretches, ids, self.sizes, strict=True):
                    ends = (np.searchsorted(np.cumsum(sizes[own]), at) + 1) * own.itemsize if len(own) else []
                    packed, start = own.tobytes(), 0
                    for x, end in zip(part, ends, strict=False):
                        kept[x] = packed[start:end]
                        start = end
            if len(found[0][0]) and len(parts) == 1:
                return
        self.strange.update(x for x in together if x not in self.stretches[0])

    def encode_whole(self, texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``encode`` for any text. PLAIN texts need no comparison of bytes if all their words passed it, and B is ``faithful`` and knows
        every piece."""
        get_a, get_b, none = self.bytes_a.__getitem__, self.bytes_b.__getitem__, np.empty(0, np.int32)
        ids_a, unknown = self.encode_a(texts), self.b.unk_id()
        sure = self.faithful and not self.odd
        for text, a, b in zip(texts, ids_a, self.b.encode(list(texts), num_threads=1), strict=True):
            want = b" " + text.encode()
            same = text and (sure and unknown not in b and PLAIN.fullmatch(text)
                             or b"".join(map(get_a, a.tolist())) == want and b"".join(map(get_b, b)) == want)
            yield (a, np.array(b, np.int32)) if same else (none, none)


@dataclass
class Sizes:
    """Bytes of every token of both vocabularies."""

    a: np.ndarray
    b: np.ndarray

    @classmethod
    def of(cls, models: Tokenizers) -> Sizes:
        return cls(*(np.array([len(x) for x in v], np.int64) for v in (models.bytes_a, models.bytes_b)))


def shared_ends(a: np.ndarray, b: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval of tokens [a0, a1) and [b0, ..), which end together, an end inside that both have: the first from the middle
    on, else the last before it, else -1. Each step goes by bisection to where the other side may have the end."""
    i_of, j_of = np.full(len(a0), -1), np.full(len(a0), -1)

    def walk(live: np.ndarray, i: np.ndarray, right: bool) -> None:
        while len(live):
            j = np.searchsorted(b, a[i]) if right else np.searchsorted(b, a[i], "right") - 1
            if not right:
                inside = j >= b0[live]
                live, i, j = live[inside], i[inside], j[inside]
            same = b[j] == a[i]
            i_of[live[same]], j_of[live[same]] = i[same], j[same]
            live, j = live[~same], j[~same]
            i = np.searchsorted(a, b[j]) if right else np.searchsorted(a, b[j], "right") - 1
            inside = i < a1[live] - 1 if right else i >= a0[live]
            live, i = live[inside], i[inside]

    middle = (a0 + a1 - 1) // 2
    walk(np.arange(len(a0)), middle, True)
    left = np.flatnonzero((i_of < 0) & (middle > a0))
    walk(left, middle[left] - 1, False)
    return i_of, j_of


def shared_cuts(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each token of A, and of B, ends where one of the other does.

    ``a`` and ``b`` are the ends of all tokens of documents one after the other (``n_a``, ``n_b`` each, which end together). All
    intervals of one depth are halved at once, down to FEW tokens.
    """
    last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
    cut = np.full(len(a), -1)  # where b has the end of a's token
    cut[last_a[n_a > 0] - 1] = last_b[n_a > 0] - 1
    a0, a1, b0, b1 = (x[n_a > 0] for x in (last_a - n_a, last_a, last_b - n_b, last_b))
    while True:
        few = a1 - a0 <= FEW
        n = (a1 - a0)[few]
        i = np.repeat(a0[few] - np.cumsum(n) + n, n) + np.arange(n.sum())
        j = np.searchsorted(b, a[i])
        same = b[j] == a[i]
        cut[i[same]] = j[same]
        large = ~few & (b1 - b0 > 1)
        a0, a1, b0, b1 = a0[large], a1[large], b0[large], b1[large]
        if not len(a0):
            break
        i, j = shared_ends(a, b, a0, a1, b0)
        found = i >= 0  # the others are leaves
        i, j = i[found], j[found]
        cut[i] = j
        a0, a1 = np.concatenate([a0[found], i + 1]), np.concatenate([i + 1, a1[found]])
        b0, b1 = np.concatenate([b0[found], j + 1]), np.concatenate([j + 1, b1[found]])
    in_b = np.zeros(len(b), bool)
    in_b[cut[cut >= 0]] = True
    return cut >= 0, in_b


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """While a table is written, Python gets its rows in batches of ``size`` bytes (or one row); then the setting is as before."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows with ``most`` in all at most, or one row."""
    ends, at = np.cumsum(np.concatenate([[0], sizes])), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, end
        at = end


def narrow(sizes: np.ndarray) -> np.dtype:
    """The least whole number that holds every id."""
    return np.min_scalar_type(max(len(sizes) - 1, 0))


def align(docs: DataFrame, models: Tokenizers) -> DataFrame:
    """A written table: doc_id, row (a number of its own for each row), ids a and b (packed numbers), and cut_a and cut_b (bitmaps:
    whether a token ends a group). ``tokens`` unpacks it."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes.of(shared.value)
        for batch in batches:
            for at, end in slices(np.array(pa.compute.binary_length(batch.column(2)).fill_null(0)), TEXT_BYTES):
                part = batch.slice(at, end - at)
                ids = list(shared.value.encode([t or "" for t in part.column(2).to_pylist()]))
                n_a, n_b = (np.array([len(x[i]) for x in ids]) for i in (0, 1))
                a, b = (np.concatenate([x[i] for x in ids]) for i in (0, 1))
                cuts = shared_cuts(np.cumsum(sizes.a[a]), np.cumsum(sizes.b[b]), n_a, n_b)
                packed = [[x.astype(k).tobytes() for x in _by(v, n)] for v, n, k in ((a, n_a, narrow(sizes.a)), (b, n_b, narrow(sizes.b)))]
                bitmaps = [[np.packbits(x).tobytes() for x in _by(v, n)] for v, n in zip(cuts, (n_a, n_b), strict=True)]
                yield pa.record_batch([part.column(0), part.column(1), *(pa.array(x, pa.binary()) for x in (*packed, *bitmaps))], names)

    names = ["doc_id", "row", "a", "b", "cut_a", "cut_b"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    with small_batches(spark):
        aligned = settle(rows.mapInArrow(run, f"doc_id {kind}, row long, a binary, b binary, cut_a binary, cut_b binary"), "aligned")
    shared.destroy()
    return aligned


def _by(flat: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    return np.split(flat, np.cumsum(n)[:-1]) if len(n) else []


def tokens(aligned: DataFrame, sizes: Sizes) -> DataFrame:
    """The alignment to read: doc_id, ids a and b, and the tokens of each group, in_a and in_b, all array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, part in parts(batch, sizes):
                n = part.n_groups
                yield pa.record_batch([rows.column(0), lists(part.a, part.n_a), lists(part.b, part.n_b), lists(part.in_a, n), lists(part.in_b, n)],
                                      ["doc_id", "a", "b", "in_a", "in_b"])

    kind = aligned.schema["doc_id"].dataType.simpleString()
    return aligned.mapInArrow(run, f"doc_id {kind}, a array<int>, b array<int>, in_a array<int>, in_b array<int>")


def lists(flat: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat.astype(np.int32)))


@dataclass
class Part:
    """Aligned documents next to each other, as flat arrays; ``n_*``: of each document."""

    a: np.ndarray
    b: np.ndarray
    in_a: np.ndarray
    in_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray

    def links(self, sizes: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, A id and B id of each link, along the text. Every stretch between two neighbouring ends lies in one token of A
        and one of B, and those two are linked there and nowhere else."""
        a, b = np.cumsum(sizes.a[self.a]), np.cumsum(sizes.b[self.b])
        ends = np.sort(np.concatenate([a, np.delete(b, np.cumsum(self.in_b) - 1)]), kind="stable")
        i, j = np.searchsorted(a, ends), np.searchsorted(b, ends)
        return np.repeat(np.arange(len(self.n_a)), self.n_a)[i], self.a[i], self.b[j]

    def pairs(self, sizes: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair and number of links of each pair in each document."""
        doc, a, b = self.links(sizes)
        width = len(sizes.a) * len(sizes.b)
        code, n = np.unique(doc * width + a * len(sizes.b) + b, return_counts=True)
        return code // width, code % width, n

    def written(self, sizes: Sizes) -> Iterator[str]:
        """The groups of each document, ``a1,a2|b1;a3|b2,b3``."""
        ends_a, ends_b = np.cumsum(self.in_a), np.cumsum(self.in_b)
        groups = np.arange(len(self.in_a))
        of_a, of_b = np.repeat(groups, self.in_a), np.repeat(groups, self.in_b)
        code_a, code_b = self.a * 2, (self.b + len(sizes.a)) * 2
        code_a[ends_a - 1] += 1
        code_b[ends_b - 1] += 1
        out = np.empty(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + (ends_b - self.in_b)[of_a]] = code_a
        out[np.arange(len(self.b)) + ends_a[of_b]] = code_b
        ends = np.cumsum([0, *(self.n_a + self.n_b)])
        word = _names(len(sizes.a), len(sizes.b)).__getitem__
        for x, y in zip(ends, ends[1:], strict=False):
            yield "".join(map(word, out[x:y].tolist()))[:-1]


_NAMES: dict[tuple[int, int], list[str]] = {}


def _names(n_a: int, n_b: int) -> list[str]:
    """Every id as it is written inside a group and at its end."""
    if (n_a, n_b) not in _NAMES:
        _NAMES[n_a, n_b] = [f"{i}{x}" for n, end in ((n_a, "|"), (n_b, ";")) for i in range(n) for x in (",", end)]
    return _NAMES[n_a, n_b]


def parts(batch: pa.RecordBatch, sizes: Sizes) -> Iterator[tuple[pa.RecordBatch, Part]]:
    """Rows of ``align`` with TOKENS tokens of A at most, or one document."""
    kinds = narrow(sizes.a), narrow(sizes.b)
    n = [np.array(pa.compute.binary_length(batch.column(i + 2))).astype(np.int64) // k.itemsize for i, k in enumerate(kinds)]
    for at, end in slices(n[0], TOKENS):
        part = batch.slice(at, end - at)
        ids = [np.frombuffer(b"".join(part.column(i + 2).to_pylist()), k).astype(np.int64) for i, k in enumerate(kinds)]
        cuts = [np.concatenate([np.empty(0, np.uint8), *(
            np.unpackbits(np.frombuffer(x, np.uint8), count=m) for x, m in zip(part.column(i + 4).to_pylist(), n[i][at:end], strict=True))]) for i in (0, 1)]
        ends = [np.flatnonzero(c) for c in cuts]
        n_groups = np.diff(np.searchsorted(ends[0], np.cumsum(n[0][at:end])), prepend=0)
        yield part, Part(*ids, *(np.diff(e, prepend=-1) for e in ends), n[0][at:end], n[1][at:end], n_groups)


def link_counts(aligned: DataFrame, sizes: Sizes) -> tuple[DataFrame, int]:
    """A written table of all linked pairs, and how many: pair (A id * B's size + B id), docs (rows that hold it linked), and best
    (no pair of the A id has more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in parts(batch, sizes):
                pair, docs = np.unique(part.pairs(sizes)[1], return_counts=True)
                yield pa.record_batch([pa.array(pair), pa.array(docs.astype(np.int64))], ["pair", "docs"])

    found = aligned.mapInArrow(run, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    with small_batches(aligned.sparkSession):
        counts = settle(found.withColumn("a", F.expr(f"int(pair div {len(sizes.b)})")), "pairs")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))  # as many rows as A has ids at most
    return keep(counts.join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))


def frequent(counts: DataFrame, rows: int, head: int) -> float:
    """The least frequency (log2, in eighths) so that at most ``head`` pairs have it or a higher one."""
    if rows <= head:
        return float("-inf")
    total, least = 0, float("inf")
    for row in counts.groupBy(F.floor(F.log2("docs") * 8).alias("level")).count().orderBy(F.desc("level")).collect():  # some hundred rows
        total += row["count"]
        if total > head:
            break
        least = row["level"]
    return least


def score(aligned: DataFrame, sizes: Sizes, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``aligned``."""
    spark = aligned.sparkSession
    counts, rows = link_counts(aligned, sizes)
    level, least = F.floor(F.log2("docs") * 8), frequent(counts, rows, head)
    top = counts.where(level >= least).toArrow()
    order = np.argsort(top.column("pair").to_numpy())
    known = spark.sparkContext.broadcast((top.column("pair").to_numpy()[order],
                                          (top.column("docs").to_numpy() * 2 + top.column("best").to_numpy())[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, packed = known.value
        for batch in batches:
            for rows, part in parts(batch, sizes):
                doc, pair, n = part.pairs(sizes)
                place = np.searchsorted(pairs, pair)
                place[place == len(pairs)] = 0
                here = pairs[place] == pair if len(pairs) else np.zeros(len(pair), bool)
                value = np.zeros(len(pair), np.int64)
                value[here] = packed[place[here]]
                docs = len(rows)
                sums = []
                for x in (n, n * (value & 1), n * (value >> 1)):
                    total = np.zeros(docs, np.int64)
                    np.add.at(total, doc, x)
                    sums.append(pa.array(total))
                sha = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in part.written(sizes)]
                rest = np.cumsum([0, *np.bincount(doc[~here], minlength=docs)]).astype(np.int32)
                yield pa.record_batch([
                    rows.column(0), rows.column(1), pa.array(part.n_a), pa.array(part.n_b), pa.array(part.n_groups), *sums, pa.array(sha, pa.string()),
                    pa.ListArray.from_arrays(pa.array(rest), pa.array(pair[~here])), pa.ListArray.from_arrays(pa.array(rest), pa.array(n[~here].astype(np.int64)))], names)

    kind = aligned.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "pairs", "links"]
    found = aligned.mapInArrow(run, f"doc_id {kind}, row long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
                                    "groups_sha256 string, pairs array<long>, links array<long>")
    with small_batches(spark):
        found = settle(found, "scored")
    known.destroy()
    if least > 0:
        found = with_rare(found, counts.where(level < least))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def with_rare(found: DataFrame, counts: DataFrame) -> DataFrame:
    """The sums completed by the pairs that were left: a join on the pair, then on the row."""
    left = found.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", "x.pairs", "x.links")
    more = left.join(counts, left["pairs"] == counts["pair"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("docs")).alias("more_sum"))
    return found.join(more, "row", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
