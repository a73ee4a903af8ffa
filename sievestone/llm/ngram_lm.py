"""Trigram language model on an Elias-Fano trie that is dealt among executors, and its scores of all texts.

The corpus is cut in blocks (some MB of text each), whose tokens are written once to the shared folder, bucketed by block, and
never shuffled. The trie grows level by level. For each level a block sends every distinct n-gram once, with its count in
training texts, to the shard that owns it, and gets an answer in the same order; so an n-gram that is everywhere weighs one
entry a block. What a level needs of the one before is sent along: the context's count and the word's probability after the
shorter context. So a shard, though it may hold just a part of a frequent context, knows all for the final, smoothed
probabilities, and its trie holds nothing else:

    p1(w) = (c(w) + 1) / (N + V + 1)
    p2(w | v) = (c(v w) + mass * p1(w)) / (c(v) + mass)
    p3(w | u v) = (c(u v w) + mass * p2(w | v)) / (c(u v) + mass)

A text begins with two begins, which count as often as texts do. A shard of a level is the part of the trie whose contexts'
and words' hashes have given first bits (`elias_fano.Trie`: contexts, monotone pointers, children relative to their context,
probabilities quantised to 16 bits, all in memory-mapped files); every n-gram asked for is looked up by successor search from
its context's pointer, and one that isn't there is answered by backing off. Words are counted exactly. The number of shards
follows the corpus, so a shard's share stays the same; nothing but N, V and the number of training texts reaches the driver.

Blocks are numbered when they are written, and all that follows reads what was written, so a lost executor's part is computed
again with the same numbers. Defined results: null texts are empty, an empty text is one end token. Words are 64-bit hashes,
contexts and children in a shard 40- and 32-bit hashes (pairs as contexts 32 bits: in a shard of two million, one in two
thousand shares its hash with another). Without training texts N is 0 and scores are those of an unknown word
(p = 1). Repeated rows are scored alike and count as often as they occur; rows without a doc_id keep none. Very long texts
are scored whole, in a block of their own. An empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, lower_ascii, mix, release, row_bounds, span_hashes, text_buffer, text_slices, tidy, word_spans, work_folder, written
from .elias_fano import CHILD_BITS, EliasFano, Trie, logarithms, quantise, restore

BLOCK_BYTES = 12 << 20
PART_BYTES = 1 << 20
SHARD_BYTES = 16 << 20
LEAST_SHARD_BITS = 6
#: A shard is worked through in so many ranges of contexts, which bounds its memory.
RANGES = 8
#: Beyond so many shuffle partitions, one works through several shards in turn.
MOST_PARTITIONS = 1 << 16
MASS = 8.0
END, BEGIN = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)
#: Bits of a context in a shard, and bytes that carry them, by level.
CONTEXT_BITS = {2: 40, 3: 32}
#: The probability of each code.
P = restore(np.arange(1 << 16))


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed string, the bytes of equal weight together."""
    import zstandard

    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays if len(a)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def _stretch(raw: bytes, *shapes: tuple[str, int]) -> list[np.ndarray]:
    """The arrays of _squeeze, given their types and lengths."""
    import zstandard

    data, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8), 0, []
    for kind, n in shapes:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(data[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def _thin(ascending: np.ndarray, size: int) -> np.ndarray:
    """The differences of ascending integers below 2**(8 * size), in so many bytes each."""
    return np.ascontiguousarray(np.diff(ascending, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size])


def _wide(raw: np.ndarray, size: int) -> np.ndarray:
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :size] = raw.view(np.uint8).reshape(-1, size)
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def _freed(work):
    """A function on cogrouped tables that gives its memory back after each group."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left, right)
        release()
        return out

    return run


class Block:
    """The tokens of some texts as local word numbers in the order of their hashes."""

    def __init__(self, row: dict):
        v, n, m = row["v"], row["n"], row["m"]
        self.words = _wide(_stretch(row["words"], ("V8", v))[0], 8)
        rank, order = _stretch(row["tokens"], ("<u4", m), ("<u4", v))
        self.token = order.view("<i4")[rank]
        self.sizes, self.ids, self.null, self.train = _stretch(row["texts"], ("<i8", n), ("<i8", n), ("u1", n), ("u1", n))
        self.row = np.repeat(np.arange(n, dtype=np.int32), self.sizes)
        self.weight = self.train[self.row]
        self.begin = int(np.searchsorted(self.words, BEGIN))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.v = v

    def _asked(self, shard_bits: int, hashes: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams by (shard, context, word), contexts numbered in the order of their hashes: shard, context, word;
        and each token's n-gram."""
        a, b = (shard_bits + 1) // 2, shard_bits // 2
        left, right = ((x >> np.uint64(64 - k)).astype(np.int64) if k else np.zeros(len(x), np.int64) for x, k in ((hashes, a), (self.words, b)))
        # A group of words at a time, in the order of shards (first the word's bits, then the context's): sorting needs the
        # largest arrays of all.
        coarse = max(0, b - 3)
        group = (right >> coarse).astype(np.int8)[self.token]
        of, shards, contexts, words, done = np.empty(len(self.token), np.int32), [], [], [], 0
        for g in range(1 << (b - coarse)):
            at = np.flatnonzero(group == g)
            key = right[self.token[at]]
            key <<= a
            key |= left[context[at]]
            key *= len(hashes)
            key += context[at]
            key *= self.v
            key += self.token[at]
            order = np.argsort(key)
            key = key[order]
            first = np.append(True, key[1:] != key[:-1])[: len(key)]
            of[at[order]] = np.cumsum(first, dtype=np.int32) + np.int32(done - 1)
            key = key[first]
            done += len(key)
            words.append((key % self.v).astype(np.int32))
            key //= self.v
            shards.append((key // len(hashes)).astype(np.int32))
            key %= len(hashes)
            contexts.append(key.astype(np.int32))
        return *(np.concatenate(x) for x in (shards, contexts, words)), of

    def pairs(self, shard_bits: int):
        context = np.empty_like(self.token)
        context[1:] = self.token[:-1]
        context[self.first] = self.begin
        return self.words, *self._asked(shard_bits, self.words, context)

    def triples(self, shard_bits: int, pairs: tuple):
        """As pairs(); contexts are the distinct pairs and, last before they are ordered, the pair of two begins."""
        _, _, left, right, of = pairs
        hashes = mix(mix(np.append(self.words[left], BEGIN) * np.uint64(0x9E3779B97F4A7C15)) + np.append(self.words[right], BEGIN))
        order = np.argsort(hashes)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        context = np.empty_like(self.token)
        context[1:] = of[:-1]
        context[self.first] = len(left)
        hashes = hashes[order]
        return hashes, order, *self._asked(shard_bits, hashes, rank.astype(np.int32)[context])


_BLOCK = "block long, v int, n int, m int, words binary, counts binary, tokens binary, texts binary, trained long"


def _cut(block_bytes: int):
    """Rows (doc_id, text, train) as blocks of at most so many bytes of text, or a single row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        held, size = [], 0

        def tokens_of(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            data, offs = text_buffer(part.column("text"))
            n, ids = part.num_rows, part.column("doc_id")
            starts, ends, rows = word_spans(data, offs)
            tokens = np.full(len(starts) + n, END, np.uint64)
            tokens[np.arange(len(starts)) + rows] = span_hashes(lower_ascii(data), starts, ends)
            return tokens, np.diff(row_bounds(rows, n)) + 1, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), part.column("train").to_numpy(zero_copy_only=False).astype("u1")

        def block(parts: list) -> pa.RecordBatch:
            tokens, sizes, ids, null, train = (np.concatenate(x) for x in zip(*parts, strict=True))
            words, local = np.unique(np.append(tokens, BEGIN), return_inverse=True)
            local = local[:-1]
            counts = np.bincount(local, np.repeat(train, sizes), len(words)).astype("<u4")
            order = np.argsort(-np.bincount(local, minlength=len(words)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(words), "<u4")
            rank[order] = np.arange(len(words))
            texts = _squeeze(sizes.astype("<i8"), ids.astype("<i8"), null.astype("u1"), train)
            values = [number, len(words), len(sizes), len(tokens), _squeeze(_thin(words, 8)), _squeeze(counts), _squeeze(rank[local], order.astype("<u4")), texts, int(train.sum())]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], [x.split()[0] for x in _BLOCK.split(", ")])

        for batch in batches:
            # Blocks of even size, as small ones repeat more; words are hashed a small part at a time.
            whole = batch.column("text").nbytes
            even = -(-whole // max(1, -(-whole // block_bytes)))
            for part in text_slices(batch, limit=min(block_bytes, PART_BYTES)):
                more = part.column("text").nbytes
                if held and size + more > min(block_bytes, even + PART_BYTES):
                    yield block(held)
                    held, size, number = [], 0, number + 1
                held.append(tokens_of(part))
                size += more
        if held:
            yield block(held)

    return cut


_ASK = "shard int, block long, body binary"
_REPLY = "block long, shard int, body binary"


def _batch(rows: list, names: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _runs(sorted_: np.ndarray) -> Iterator[tuple[int, slice]]:
    edges = np.flatnonzero(np.diff(sorted_, prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(sorted_)], strict=True):
        yield int(sorted_[a]), slice(a, b)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows sorted by their first column, a list for each of its values."""
    held: list = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != r[0]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


# Level 1: words, counted exactly.
def _ask_words(shard_bits: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, v, words, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "v", "words", "counts")), strict=True):
                words, (counts,) = _wide(_stretch(words, ("V8", v))[0], 8), _stretch(counts, ("<u4", v))
                shards = (words >> np.uint64(64 - shard_bits)).astype(np.int64)
                yield _batch([(s, block, _squeeze(_thin(words[part] - np.uint64(s << (64 - shard_bits)), 8), counts[part])) for s, part in _runs(shards)], _ASK)

    return ask


_WORDS = "block long, shard int, body binary, total long, distinct long"


def _answer_words(shard_bits: int):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for held in _held(batches):
            shard = held[0][0]
            asked = [_stretch(r[2], ("V8", n), ("<u4", n)) for r in held for n in [zstandard.frame_content_size(r[2]) // 12]]
            asked = [(_wide(a, 8), c) for a, c in asked]
            every, counts = np.concatenate([a for a, _ in asked]), np.concatenate([c for _, c in asked]).astype(np.int64)
            seen = counts > 0
            known, of = np.unique(every[seen], return_inverse=True)
            total = np.bincount(of, counts[seen], len(known)).astype(np.int64)
            at, equal = EliasFano(known, 64 - shard_bits).successor(every)
            got = np.zeros(len(every), np.int64)
            got[equal] = total[at[equal]]
            ends = np.cumsum([len(a) for a, _ in asked])
            rows = [(r[1], shard, _squeeze(got[e - len(a) : e].astype("<u8")), None, None) for r, (a, _), e in zip(held, asked, ends, strict=True)]
            yield _batch([*rows, (None, shard, None, int(total.sum()), len(known))], _WORDS)

    return answer


# Levels 2 and 3: n-grams with what is known of their contexts and words.
def _messages(block: int, shard_bits: int, level: int, words: np.ndarray, hashes: np.ndarray, asked: tuple, counts: np.ndarray, totals: np.ndarray, lower: np.ndarray) -> list[tuple]:
    """One message for each shard: its contexts with fan-out and total, the words that occur in it, and for each n-gram the word's
    place among these and its count. `lower` are codes, by word on level 2 and by n-gram on level 3."""
    shard, context, word = asked
    rows = []
    a, b = (shard_bits + 1) // 2, shard_bits // 2
    for s, part in _runs(shard):
        own, w = context[part], word[part]
        begin = np.flatnonzero(np.diff(own, prepend=-1))
        fanout = np.diff(np.append(begin, len(own)))
        few, place = np.unique(w, return_inverse=True)
        sizes = np.array([len(begin), len(own), len(few)], "<u4").tobytes()
        codes = lower[few] if level == 2 else lower[part]
        # Ascending within a shard, whose first bits all share.
        left, right = (hashes[own[begin]] << np.uint64(a)) >> np.uint64(64 - CONTEXT_BITS[level]), (words[few] << np.uint64(b)) >> np.uint64(64 - CHILD_BITS)
        body = _squeeze(_thin(left, CONTEXT_BITS[level] // 8), fanout.astype("<u4"), totals[own[begin]].astype("<u8"), _thin(right, CHILD_BITS // 8), codes.astype("<u2"), place.astype("<u4"), counts[part].astype("<u4"))
        rows.append((s, block, sizes + body))
    return rows


def _answer_ngrams(level: int, mass: float):
    wide = CONTEXT_BITS[level] // 8

    def unpacked(body: bytes) -> tuple[np.ndarray, ...]:
        c, n, d = np.frombuffer(body[:12], "<u4").tolist()
        left, fanout, totals, right, codes, place, counts = _stretch(body[12:], (f"V{wide}", c), ("<u4", c), ("<u8", c), (f"V{CHILD_BITS // 8}", d), ("<u2", d if level == 2 else n), ("<u4", n), ("<u4", n))
        left, right = _wide(left, wide), _wide(right, CHILD_BITS // 8)
        return left, fanout, totals, right[place].astype(np.uint32), codes[place] if level == 2 else codes, counts

    def looked_up(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Codes and counts of all n-grams of some messages, in their order, from the trie of those that were seen."""
        lefts, fanouts, totals, children, lowers, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(children):
            return np.zeros(0, np.uint16), np.zeros(0)
        contexts, back = np.unique(lefts, return_inverse=True)
        if len(contexts) >= 1 << (64 - CHILD_BITS):
            raise ValueError("a shard has too many contexts")
        rank = np.repeat(back, fanouts)
        keys, of = np.unique((rank.astype(np.uint64) << np.uint64(CHILD_BITS)) | children, return_inverse=True)
        context, child = (keys >> np.uint64(CHILD_BITS)).astype(np.int64), keys & np.uint64((1 << CHILD_BITS) - 1)
        count = np.bincount(of, counts, len(keys))
        total = np.zeros(len(contexts))
        total[back] = totals
        low = np.zeros(len(keys), np.uint16)
        low[of] = lowers
        backed_off = mass * P[low] / (total[context] + mass)
        seen = np.flatnonzero(count)
        trie = Trie(contexts[context[seen]], child[seen], backed_off[seen] + count[seen] / (total[context[seen]] + mass), CONTEXT_BITS[level])
        codes, known = trie.find(contexts, context, child)
        codes[~known] = quantise(backed_off[~known])
        return codes[of], count[of]

    cuts = [np.uint64(k * (1 << CONTEXT_BITS[level]) // RANGES) for k in range(RANGES)] + [np.uint64(1 << CONTEXT_BITS[level])]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches):
            parts = [unpacked(r[2]) for r in held]
            held = [r[:2] for r in held]
            ends = [np.append(0, np.cumsum(x[1], dtype=np.int64)) for x in parts]
            found: list[list] = [[] for _ in held]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                spans = [np.searchsorted(x[0], (low, high)) for x in parts]
                within = [(slice(*c), slice(e[c[0]], e[c[1]])) for c, e in zip(spans, ends, strict=True)]
                got, count = looked_up([(x[0][c], x[1][c], x[2][c], x[3][n], x[4][n], x[5][n]) for x, (c, n) in zip(parts, within, strict=True)])
                end = 0
                for k, (_, n) in enumerate(within):
                    part = slice(end, end := end + n.stop - n.start)
                    found[k].append((got[part], count[part]))
            rows = []
            for r, x in zip(held, found, strict=True):
                codes, counts = (np.concatenate(c) for c in zip(*x, strict=True))
                rows.append((r[1], r[0], _squeeze(codes) if level == 3 else _squeeze(codes, counts.astype("<u8"))))
            yield _batch(rows, _REPLY)

    return answer


def _own_row(blocks: pa.Table) -> dict:
    return blocks.slice(0, 1).to_pylist()[0]


def _sorted_bodies(replies: pa.Table, level: int) -> list[bytes]:
    rows = sorted((s, b) for lv, s, b in zip(*(replies.column(c).to_pylist() for c in ("level", "shard", "body")), strict=True) if lv == level)
    return [b for _, b in rows]


def _word_counts(replies: pa.Table, v: int, begin: int, texts: int) -> np.ndarray:
    import zstandard

    bodies = _sorted_bodies(replies, 1)
    counts = np.concatenate([_stretch(b, ("<u8", zstandard.frame_content_size(b) // 8))[0] for b in bodies]).astype(np.int64)
    if len(counts) != v:
        raise ValueError("a block's answers don't fit its words")
    counts[begin] = texts
    return counts


def _ask_pairs(shard_bits: int, total: int, distinct: int, texts: int):
    def ask(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return pa.Table.from_batches([_batch([], _ASK)])
        row = _own_row(blocks)
        block = Block(row)
        counts = _word_counts(replies, block.v, block.begin, texts)
        hashes, *asked, of = block.pairs(shard_bits)
        own = np.bincount(of, block.weight, len(asked[0]))
        return pa.Table.from_batches([_batch(_messages(row["block"], shard_bits, 2, block.words, hashes, tuple(asked), own, counts, quantise((counts + 1) / (total + distinct + 1))), _ASK)])

    return ask


def _ask_triples(shard_bits: int, texts: int):
    def ask(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return pa.Table.from_batches([_batch([], _ASK)])
        import zstandard

        row = _own_row(blocks)
        block = Block(row)
        pairs = block.pairs(shard_bits)
        got = [_stretch(b, ("<u2", n), ("<u8", n)) for b in _sorted_bodies(replies, 2) for n in [zstandard.frame_content_size(b) // 10]]
        codes, counts = (np.concatenate(x) for x in zip(*got, strict=True))
        if len(codes) != len(pairs[1]):
            raise ValueError("a block's answers don't fit its pairs")
        hashes, order, *asked, of = block.triples(shard_bits, pairs)
        own = np.bincount(of, block.weight, len(asked[0]))
        lower = np.zeros(len(asked[0]), np.uint16)
        lower[of] = codes[pairs[4]]
        return pa.Table.from_batches([_batch(_messages(row["block"], shard_bits, 3, block.words, hashes, tuple(asked), own, np.append(counts, np.uint64(texts))[order], lower), _ASK)])

    return ask


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(shard_bits: int, total: int, distinct: int, texts: int):
    def score(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        import zstandard

        names = [x.split()[0] for x in _SCORE.split(", ")]
        if not blocks.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)
        block = Block(_own_row(blocks))
        counts = _word_counts(replies, block.v, block.begin, texts)
        codes = np.concatenate([_stretch(b, ("<u2", zstandard.frame_content_size(b) // 2))[0] for b in _sorted_bodies(replies, 3)])
        of = block.triples(shard_bits, block.pairs(shard_bits))[-1]
        if len(codes) != of.max() + 1:
            raise ValueError("a block's answers don't fit its triples")
        base = np.log10((counts + 1) / (total + distinct + 1))
        n = len(block.sizes)
        sums = [np.bincount(block.row, x, n) for x in (base[block.token], (logarithms(np.arange(1 << 16)) * np.log10(2))[codes][of], counts[block.token] > 0)]
        return pa.table([pa.array(block.ids, mask=block.null.astype(bool)), pa.array(block.train == 0), pa.array(block.sizes), pa.array(sums[2].astype(np.int64)), pa.array(sums[0]), pa.array(sums[1])], names)

    return score


def _bucketed(df: DataFrame, folder: str, name: str, buckets: int) -> DataFrame:
    own, spark = f"sievestone_{uuid.uuid4().hex}", df.sparkSession
    with tidy(spark):
        df.write.format("parquet").option("compression", "zstd").option("path", f"{folder}/{name}").bucketBy(buckets, "block").saveAsTable(own)
    out = spark.table(own)
    spark.sql(f"DROP TABLE {own}")  # the files stay
    return out


def language_model_scores(docs: DataFrame, train: Column, mass: float = MASS, shard_bits: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text); the model
    learns from the rows where `train` holds."""
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if shard_bits is None:
        shard_bits = max(LEAST_SHARD_BITS, (-(-size // SHARD_BYTES) - 1).bit_length())
    shards = min(1 << shard_bits, MOST_PARTITIONS)
    buckets = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (4 * block_bytes)))
    blocks = _bucketed(docs.mapInArrow(frugal(_cut(block_bytes)), T.StructType.fromDDL(_BLOCK)), folder, "blocks", buckets)
    ddl = T.StructType.fromDDL
    texts = int(blocks.agg(F.sum("trained")).first()[0] or 0)

    def answered(asked: DataFrame, answer, schema: str, level: int) -> DataFrame:
        dealt = asked.repartition(shards, "shard").sortWithinPartitions("shard")
        return written(dealt.mapInArrow(frugal(answer), ddl(schema)), folder, f"level-{level}").withColumn("level", F.lit(level))

    def met(replies: DataFrame, ask, schema: str) -> DataFrame:
        return blocks.drop("counts", "trained").groupBy("block").cogroup(replies.select("block", "level", "shard", "body").groupBy("block")).applyInArrow(_freed(ask), ddl(schema))

    words = answered(blocks.select("block", "v", "words", "counts").mapInArrow(frugal(_ask_words(shard_bits)), ddl(_ASK)), _answer_words(shard_bits), _WORDS, 1)
    total, distinct = (int(x) for x in words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first())
    words = words.where("body is not null")
    pairs = answered(met(words, _ask_pairs(shard_bits, total, distinct, texts), _ASK), _answer_ngrams(2, mass), _REPLY, 2)
    triples = answered(met(pairs, _ask_triples(shard_bits, texts), _ASK), _answer_ngrams(3, mass), _REPLY, 3)
    scored = met(words.select("block", "level", "shard", "body").unionByName(triples.select("block", "level", "shard", "body")), _score(shard_bits, total, distinct, texts), _SCORE)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
