"""Vector bin packing of tokenised examples into training sequences.

An example is a vector of tokens, one segment and loss-bearing tokens (those
after an optional prompt).  Each Spark partition packs its own rows in one
pass: examples wait in a pool of POOL pieces, and a sequence is filled by the
dot-product heuristic, taking the waiting piece whose vector has the largest
inner product with the room left in tokens, segments and loss tokens, among
those that fit.  When nothing fits, the longest piece is cut so that the
sequence ends full; what is left of it waits on.  A sequence that the segment
or loss limit closes early is trimmed to a power of two, as are the last ones
of a partition, so no sequence needs padding.  A task holds the pool, one
example and the Arrow batch; nothing is shuffled, and a task that is run again
gives the same rows.

Ids are those of the ``tokenizers`` library for ``byte_bpe_50k.json`` without
added special tokens, then id 0; the same vocabulary as ranks gives the same
ids faster, and texts that hold a special token's string or more than
LONG_BLANKS white-space characters in a row, which the fast way cannot take,
go through ``tokenizers`` itself.  The vocabulary is read where the workers run.

Defined cases: null and empty texts have the closing id alone; doc_id may be
null or repeated (each row is packed); extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from aerolens.llm.common import prepare, table

POOL = 256
CLOSING_ID = 0
LONG_BLANKS = 100_000
TOKENIZER = "byte_bpe_50k"
SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, segment int, loss_tokens bigint, sequence_tokens bigint")


_BLANKS = re.compile(r"\s+")


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 128
    loss: int = 1024


def _long_blanks(text: str) -> bool:
    return len(text) > LONG_BLANKS and any(m.end() - m.start() > LONG_BLANKS for m in _BLANKS.finditer(text))


class Encoder:
    """Text to ids; ``name`` is a file stem of the public tokenizers or a path without ending."""

    def __init__(self, name: str = TOKENIZER):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = (lambda end: f"{name}{end}") if "/" in name else (lambda end: public_tokenizers.path(f"{name}{end}"))
        self.exact = Tokenizer.from_file(path(".json"))
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(path(".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if not text:
            return []
        if any(s in text for s in self.special) or _long_blanks(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@dataclass
class Piece:
    doc: object
    ids: np.ndarray           # the ids of the piece
    start: int                # the document's ids before it
    total: int                # ids of the document
    prompt: int               # ids of the document without loss

    @property
    def loss(self) -> int:
        return max(0, self.start + len(self.ids) - max(self.start, self.prompt))

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return (Piece(self.doc, self.ids[:n], self.start, self.total, self.prompt),
                Piece(self.doc, self.ids[n:], self.start + n, self.total, self.prompt))


class Packer:
    """Dot-product packing of a stream of pieces; yields full sequences (lists of pieces)."""

    def __init__(self, limits: Limits):
        self.limits, self.pool = limits, []
        self.scale = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.size = np.zeros((2 * POOL, 3))

    def _put(self, p: Piece) -> None:
        if len(self.pool) == len(self.size):
            self.size = np.concatenate((self.size, np.zeros_like(self.size)))
        self.size[len(self.pool)] = (len(p.ids), 1, p.loss)
        self.pool.append(p)

    def _take(self, i: int) -> Piece:
        p, last = self.pool[i], self.pool.pop()
        if i < len(self.pool):
            self.pool[i], self.size[i] = last, self.size[len(self.pool)]
        return p

    def _longest_fit(self, p: Piece, room: np.ndarray) -> int:
        """Most leading ids of ``p`` within the room in tokens and loss."""
        free = max(0, min(p.prompt - p.start, len(p.ids)))
        return int(min(room[0], len(p.ids), free + room[2]))

    def _fill(self) -> list[Piece]:
        room, out = self.scale.copy(), []
        while self.pool and room[0] > 0 and room[1] > 0:
            size = self.size[:len(self.pool)]
            fits = (size <= room).all(axis=1)
            if fits.any():
                i = int(np.argmax(np.where(fits, (size / self.scale) @ (room / self.scale), -1.0)))
                p = self._take(i)
            else:
                i = int(np.argmax(size[:, 0]))
                n = self._longest_fit(self.pool[i], room)
                if n <= 0:
                    break
                p, rest = self._take(i).cut(n)
                self._put(rest)
            out.append(p)
            room -= (len(p.ids), 1, p.loss)
        return out

    def _trimmed(self, seq: list[Piece]) -> list[Piece]:
        """The sequence cut to full length or a power of two; the rest goes back to the pool."""
        total = sum(len(p.ids) for p in seq)
        if total == self.limits.tokens:
            return seq
        want, out = 1 << (total.bit_length() - 1), []
        for p in seq:
            if want <= 0:
                self._put(p)
            elif len(p.ids) > want:
                p, rest = p.cut(want)
                self._put(rest)
                out.append(p)
                want = 0
            else:
                out.append(p)
                want -= len(p.ids)
        return out

    def add(self, p: Piece) -> Iterator[list[Piece]]:
        room = self.scale
        while len(p.ids) >= self.limits.tokens:        # whole sequences of one long example
            n = self._longest_fit(p, room)
            head, p = p.cut(n)
            if n == self.limits.tokens:
                yield [head]
            else:
                self._put(head)
        if len(p.ids):
            self._put(p)
        while len(self.pool) >= POOL:
            yield self._trimmed(self._fill())

    def flush(self) -> Iterator[list[Piece]]:
        while self.pool:
            yield self._trimmed(self._fill())


def pack_partition(batches: Iterator[pa.RecordBatch], limits: Limits, tokenizer: str) -> Iterator[pa.RecordBatch]:
    encode, packer = Encoder(tokenizer), Packer(limits)
    sequence = TaskContext.get().partitionId() << 40
    rows: list[tuple] = []

    def write(seq: list[Piece]) -> None:
        nonlocal sequence
        offset, total = 0, sum(len(p.ids) for p in seq)
        for k, p in enumerate(seq):
            rows.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.total, sequence, offset, k, p.loss, total))
            offset += len(p.ids)
        sequence += 1

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64()] * 10
        kinds[7] = pa.int32()
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        rows.clear()
        return out

    for b in batches:
        for doc, text, prompt in zip(b.column(0), b.column(1), b.column(2)):
            head = encode(prompt.as_py() or "")
            ids = np.array([*head, *encode(text.as_py() or ""), CLOSING_ID], "<u4")
            for seq in packer.add(Piece(doc.as_py(), ids, 0, len(ids), len(head))):
                write(seq)
        if len(rows) >= 5000:
            yield batch()
    for seq in packer.flush():
        write(seq)
    if rows:
        yield batch()


def pack(examples: DataFrame, limits: Limits = Limits(), tokenizer: str = TOKENIZER) -> DataFrame:
    """Pieces of ``examples(doc_id, text[, prompt])`` in sequences; see SCHEMA.

    With a string column ``prompt``, its ids come before those of the text
    and bear no loss.
    """
    prepare(examples.sparkSession)
    has = any(f.name == "prompt" and f.dataType.simpleString() == "string" for f in examples.schema.fields)
    rows = examples.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"),
                           F.col("prompt") if has else F.lit(None).cast("string").alias("prompt"))
    return rows.mapInArrow(lambda it: pack_partition(it, limits, tokenizer), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
