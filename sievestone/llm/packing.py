"""Packing of token sequences by vector bin packing with the dot-product heuristic.

An item has three sizes: tokens, segments (1) and loss-bearing tokens, of which its first tokens are none. A bin takes, again and again, the item that fits
and whose sizes have the largest dot product with what is left of the bin, each divided by its limit, so large items go
where there is room and a bin rich in one resource draws items that use it. Where items may be cut, the bin's last gap is
filled with the head of an item, whose tail stays in the pool; what is left at the end of a partition is cut at powers of
two. Packing works through each partition in pools of a bounded number of items; nothing is shuffled.

`pack_examples` is for instruction data, where roles decide which tokens bear loss. `pack_documents` is for plain texts: every
token but a document's first bears loss, and a sequence takes at most `LOSS` of them, one less than its tokens, as a model that
reads 1024 tokens predicts 1023. So a sequence of continuations alone ends a token early and is padded by it.

Defined results: null texts are empty; an empty text still has its end token. A null doc_id is passed through. Repeated
rows are separate documents. An empty table gives an empty result. Very long texts are cut in full sequences. Sequence
numbers are unique (partition number times 2**32 plus a counter) and the same when a task is run again. Texts that hold an
added token's content have that token's id, as the tokenizers library gives it. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, text_slices

LENGTH = 1024
SEGMENTS = 64
LOSS = LENGTH - 1
POOL = 1024


class Pool:
    """Items of one partition waiting for a bin; `cut` allows splitting them."""

    def __init__(self, tokens: int = LENGTH, segments: int = SEGMENTS, loss: int = LENGTH, cut: bool = True):
        self.limit, self.segments, self.loss, self.cut = tokens, segments, loss, cut
        self.keys: list = []
        self.sizes = np.zeros((0, 2), np.int64)

    def add(self, items: list[tuple[object, int, int]]) -> None:
        """Items as (key, tokens, loss-bearing tokens)."""
        if items:
            self.keys += [k for k, _, _ in items]
            self.sizes = np.concatenate([self.sizes, np.array([[t, x] for _, t, x in items], np.int64)])

    def __len__(self) -> int:
        return len(self.keys)

    def bins(self, keep: int = 0) -> Iterator[list[tuple[object, int]]]:
        """Bins as lists of (key, tokens taken of the item's head), until at most `keep` items are left. With keep = 0
        the last bins are cut at powers of two, where cutting is allowed."""
        alive = np.ones(len(self.keys), bool)
        left = int(alive.sum())
        while left > keep:
            if keep == 0 and self.cut and (total := int(self.sizes[alive, 0].sum())) < self.limit:
                room = 1 << (total.bit_length() - 1)
            else:
                room = self.limit
            tokens, segments, loss, taken = room, self.segments, self.loss, []
            while tokens and segments and left:
                fits = alive & (self.sizes[:, 0] <= tokens) & (self.sizes[:, 1] <= loss)
                at = -1
                # The last segment of a bin is better cut from an item that fills it.
                if fits.any() and not (self.cut and segments == 1):
                    score = self.sizes[:, 0] * (tokens / self.limit**2) + segments / self.segments**2 + self.sizes[:, 1] * (loss / self.loss**2)
                    at = int(np.argmax(np.where(fits, score, -1.0)))
                    n = int(self.sizes[at, 0])
                elif self.cut:
                    at = int(np.argmax(np.where(alive, self.sizes[:, 0], -1)))
                    n = min(int(self.sizes[at, 0]), tokens, loss + int(self.sizes[at, 0] - self.sizes[at, 1]))
                    # No head without loss is cut off just to fill a gap.
                    if not loss or n <= 0:
                        at = -1
                if at < 0:
                    break
                lost = max(0, n - int(self.sizes[at, 0] - self.sizes[at, 1]))
                taken.append((self.keys[at], n))
                tokens, segments, loss = tokens - n, segments - 1, loss - lost
                self.sizes[at] -= (n, lost)
                if self.sizes[at, 0] <= 0:
                    alive[at] = False
                    left -= 1
            if not taken:  # an item above the limits that may not be cut has a bin of its own
                at = int(np.flatnonzero(alive)[0])
                taken, alive[at], left = [(self.keys[at], int(self.sizes[at, 0]))], False, left - 1
            yield taken
        self.keys = [k for k, a in zip(self.keys, alive, strict=True) if a]
        self.sizes = self.sizes[alive]


def pack_examples(examples: DataFrame, tokens: int = LENGTH, segments: int = SEGMENTS, loss: int = LENGTH, pool: int = POOL) -> DataFrame:
    """Instruction data: rows (example_id, n_tokens, n_loss) that may not be cut; returns example_id, n_tokens, n_loss,
    sequence_id, offset. An example above a limit gets a sequence of its own; null sizes count as 0."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting = Pool(tokens, segments, loss, cut=False)

        def flush(keep: int) -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows = []
            for taken in waiting.bins(keep):
                at = 0
                for (key, size, lost), _ in taken:
                    rows.append((key, size, lost, number, at))
                    at += size
                number += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["example_id", "n_tokens", "n_loss", "sequence_id", "offset"])

        for batch in batches:
            columns = [batch.column(c).cast(pa.int64()).to_pylist() for c in ("example_id", "n_tokens", "n_loss")]
            items = [((k, t or 0, x or 0), t or 0, x or 0) for k, t, x in zip(*columns, strict=True)]
            for a in range(0, len(items), pool):
                waiting.add(items[a : a + pool])
                yield from flush(pool // 2)
        yield from flush(0)

    return examples.select("example_id", "n_tokens", "n_loss").mapInArrow(frugal(pack), T.StructType.fromDDL("example_id long, n_tokens long, n_loss long, sequence_id long, offset long"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """Ids of a byte-level BPE vocabulary as the tokenizers library gives them. Texts whose letters all have been in Unicode
    for long (below U+0250, and common punctuation) are encoded by tiktoken from the same vocabulary, three times as fast;
    other texts, where the two libraries' tables of letters might differ, and those that hold an added token's content, by
    tokenizers itself."""

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.plain = regex.compile("[\\t\\n\\r -~¡-¬®-ɏ‐-‧]*")
        shown = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        shown |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown.values()))}
        model = json.load(open(path, encoding="utf-8"))
        special = {t["content"] for t in model["added_tokens"]}
        self.added = sorted(special)
        ranks = {bytes(shown[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.plain.fullmatch(text) and not any(t in text for t in self.added):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def conversation_examples(conversations: DataFrame, path: str | None = None, end_id: int = 0, role: str = "assistant") -> DataFrame:
    """example_id (the conv_id), n_tokens, n_loss of conversations in rows (conv_id, turn, role, text): each turn is its text's
    ids and an end, and those of `role` bear loss. Only counts are shuffled. Null texts are empty; turns without a conv_id are
    one conversation without id; repeated turns count as often as they occur; null roles bear no loss."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe(path)
        for batch in batches:
            sizes = [len(coder.encode(text or "")) + 1 for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(sizes, pa.int64()), batch.column("answer")], ["example_id", "n_tokens", "answer"])

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "text", F.coalesce(F.col("role") == role, F.lit(False)).alias("answer"))
    counted = turns.mapInArrow(frugal(count), T.StructType.fromDDL("example_id long, n_tokens long, answer boolean"))
    return counted.groupBy("example_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum(F.when(F.col("answer"), F.col("n_tokens")).otherwise(0)).alias("n_loss"))


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, segments: int = SEGMENTS, pool: int = POOL, end_id: int = 0, loss: int = LOSS, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the
    ids, if asked for)."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = ByteBpe(path)
        number = TaskContext.get().partitionId() << 32
        waiting = Pool(length, segments, loss)
        rows: list = []

        def place(taken: list) -> None:
            nonlocal number
            at = 0
            for item, n in taken:
                ids, piece = item["ids"], item["ids"][item["at"] : item["at"] + n]
                rows.append((item["doc"], item["at"], n, zlib.crc32(piece.tobytes()), len(ids), number, at, piece if with_ids else None))
                item["at"] += n
                at += n
            number += 1

        def out() -> Iterator[pa.RecordBatch]:
            if rows:
                *columns, ids = zip(*rows, strict=True)
                arrays = [pa.array(c, pa.int64()) for c in columns]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(ids, pa.list_(pa.int64()))] if with_ids else [])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids])
                rows.clear()

        for batch in batches:
            for part in text_slices(batch):
                fresh = []
                for doc, text in zip(part.column("doc_id").cast(pa.int64()).to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.append(coder.encode(text or ""), np.uint32(end_id)).astype("<u4")
                    item = {"doc": doc, "ids": ids, "at": 0}
                    while len(ids) - item["at"] >= (whole := min(length, loss + (item["at"] == 0))):
                        place([(item, whole)])
                    if rest := len(ids) - item["at"]:
                        fresh.append((item, rest, rest - (item["at"] == 0)))
                for a in range(0, len(fresh), pool // 2):
                    waiting.add(fresh[a : a + pool // 2])
                    if len(waiting) >= pool:
                        for taken in waiting.bins(pool // 2):
                            place(taken)
                yield from out()
        for taken in waiting.bins(0):
            place(taken)
        yield from out()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(pack), T.StructType.fromDDL(schema))
