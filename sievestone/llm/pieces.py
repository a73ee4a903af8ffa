"""SentencePiece encoding and decoding of byte-fallback BPE models by suffix-array matching.

A batch's distinct chunks (runs that no piece can cross) are concatenated and their suffixes sorted, as deep as the longest
piece. Every piece is then found by binary search as one range of suffixes; the ranges are the edges of all chunks'
lattices. Edges sorted by position are relaxed from left to right, all chunks at once: an edge extends the encoding of
the prefix before it if it is compatible with that prefix's last piece, which means that the model encodes the two pieces'
concatenation as exactly these two. A prefix has one BPE encoding, and a sequence is that encoding if and only if all its
neighbours are compatible, so exactly one edge into each position succeeds, and the result is the model's own
encoding. Compatibility is a property of the model, worked out once a worker for each pair that occurs.

Defined results: null and empty texts have no ids. Spaces and U+2581 are the same to the model, so U+2581 decodes as a
space. Characters without a piece become bytes. Rows repeat as they come; very long chunks are relaxed whole; an empty
table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, text_slices

SPACE = "▁"
SLICE = 4 << 20
#: Known pairs are forgotten beyond so many.
PAIRS = 1 << 20
_coders: dict[str, PieceCoder] = {}


class PieceCoder:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes_ids = np.zeros(256, np.int64)
        self.normal, scores = {}, {}
        self.raw = []  # what each id decodes to, U+2581 still in place
        for i, name in enumerate(self.names):
            if model.is_byte(i):
                self.bytes_ids[int(name[3:5], 16)] = i
                self.raw.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.raw.append(b"")
            else:
                self.normal[name], scores[name] = i, model.get_score(i)
                self.raw.append(name.encode())
        self.rank = {name: k for k, name in enumerate(sorted(scores, key=lambda x: -scores[x]))}
        self.depth = max(map(len, self.normal))
        crossing = re.compile(f"[^{SPACE}]{SPACE}")
        # Texts are cut where no piece crosses: before spaces, and around line ends.
        spaces = not any(map(crossing.search, self.normal))
        lines = not any("\n" in x for x in self.normal)
        self.chunks = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if spaces and lines else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if spaces else "(?s:.+)").findall
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in a row, and each chunk's offset in them."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        text = "\0".join(chunks) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        alphabet, symbols = np.unique(codes, return_inverse=True)
        letter = {chr(c): k for k, c in enumerate(alphabet.tolist())}
        # A code point that is no piece by itself is an edge of its own, written as bytes in the end.
        strange = [c for c in letter if c != "\0" and c not in self.normal]
        names = [x for x in self.normal if all(c in letter for c in x)] + strange
        ids = np.array([self.normal.get(x, len(self.names) + letter[x[0]]) for x in names], np.int64)
        lengths = np.array([len(x) for x in names], np.int64)

        # Suffixes of a chunk as words of packed symbols; 0 ends a chunk, so nothing matches across.
        bits = max(1, int(len(alphabet) - 1).bit_length())
        per = 64 // bits
        words = -(-self.depth // per)
        stop = np.flatnonzero(symbols == 0)
        of = np.append(0, np.cumsum(symbols[:-1] == 0))  # each position's chunk
        left = stop[of] - np.arange(len(symbols))
        padded = np.append(symbols, np.zeros(words * per, np.int64)).astype(np.uint64)
        keys = []
        for w in range(words):
            key = np.zeros(len(symbols), np.uint64)
            for k in range(per):
                at = w * per + k
                key = (key << np.uint64(bits)) | np.where(left > at, padded[at : at + len(symbols)], np.uint64(0))
            keys.append(key)
        suffixes = np.lexsort(keys[::-1])
        keys = [k[suffixes] for k in keys]

        # Each piece's range of suffixes: its symbols followed by anything.
        flat = np.array([letter[c] for x in names for c in x], np.uint64)
        begin = np.cumsum(lengths) - lengths
        low, high = np.zeros(len(names), np.int64), np.full(len(names), len(symbols), np.int64)
        for w in range(words):
            active = np.flatnonzero(lengths > w * per)
            least = np.zeros(len(active), np.uint64)
            free = np.zeros(len(active), np.uint64)
            for k in range(per):
                at = w * per + k
                has = lengths[active] > at
                least = (least << np.uint64(bits)) | np.where(has, flat[np.minimum(begin[active] + at, len(flat) - 1)], np.uint64(0))
                free = (free << np.uint64(bits)) | np.where(has, np.uint64(0), np.uint64((1 << bits) - 1))
            a, b = low[active], high[active]
            low[active], high[active] = _bisect(keys[w], least, a, b, False), _bisect(keys[w], least | free, a, b, True)
        counts = np.maximum(0, high - low)
        which = np.repeat(np.arange(len(names)), counts)
        at = suffixes[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)]

        # Relaxing, level by level of the position within the chunk.
        first = np.append(0, stop[:-1] + 1)
        level = at - first[of[at]]
        order = np.argsort(level, kind="stable")
        at, which, level = at[order], which[order], level[order]
        last = np.full(len(symbols) + 1, -1, np.int64)
        top = len(names)
        bounds = np.flatnonzero(np.diff(level, prepend=-1))
        for a, b in zip(bounds, [*bounds[1:], len(level)]):
            starts, pieces = at[a:b], which[a:b]
            if level[a]:
                pairs, back = np.unique(last[starts] * top + pieces, return_inverse=True)
                left_piece, right_piece = pairs // top, pairs % top
                keys_ = ((ids[left_piece] << 32) | ids[right_piece]).tolist()
                known = [self.pairs.get(k) for k in keys_]
                for k in [k for k, x in enumerate(known) if x is None]:
                    a_, b_ = names[left_piece[k]], names[right_piece[k]]
                    known[k] = self.merged(a_ + b_) == [a_, b_]
                    if max(ids[left_piece[k]], ids[right_piece[k]]) < len(self.names):
                        self.pairs[keys_[k]] = known[k]
                ok = np.array(known, bool)[back]
                starts, pieces = starts[ok], pieces[ok]
            last[starts + lengths[pieces]] = pieces

        # From the ends back, all chunks at once.
        place = stop.copy()
        chunk = np.arange(len(stop))
        found = []
        while len(place):
            open_ = place > first[chunk]
            place, chunk = place[open_], chunk[open_]
            piece = last[place]
            found.append((chunk, piece, place))
            place = place - lengths[piece]
        chunk, piece, place = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(place)
        chunk, piece = chunk[order], piece[order]
        out, size = ids[piece], np.ones(len(piece), np.int64)
        if strange:
            utf8 = {len(self.names) + letter[c]: np.frombuffer(c.encode("utf-8", "surrogatepass"), np.uint8) for c in strange}
            odd = np.flatnonzero(out >= len(self.names))
            size[odd] = [len(utf8[x]) for x in out[odd].tolist()]
            spread = np.repeat(out, size)
            if len(odd):
                starts = (np.cumsum(size) - size)[odd]
                for x, s in zip(out[odd].tolist(), starts.tolist()):
                    spread[s : s + len(utf8[x])] = self.bytes_ids[utf8[x]]
            out = spread
        ends = np.cumsum(np.bincount(chunk, size, len(stop))).astype(np.int64)
        return out, np.append(0, ends)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        seen: dict[str, int] = {}
        rows = []
        for text in texts:
            parts = self.chunks(SPACE + text.replace(" ", SPACE)) if text else []
            rows.append([seen.setdefault(p, len(seen)) for p in parts])
        if not seen:
            return [np.zeros(0, np.int64) for _ in texts]
        # NUL marks ends of chunks; a chunk that has one is encoded by merging.
        odd = {k: p for p, k in seen.items() if "\0" in p}
        ids, offs = self.encode_chunks([p if k not in odd else "" for p, k in seen.items()])
        out = []
        for row in rows:
            index = np.array(row, np.int64)
            if odd and any(k in odd for k in row):
                out.append(np.concatenate([self._slowly(odd[k]) if k in odd else ids[offs[k] : offs[k + 1]] for k in row]))
                continue
            size = offs[index + 1] - offs[index]
            out.append(ids[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(offs[index], size)])
        return out

    def _slowly(self, chunk: str) -> np.ndarray:
        ids: list[int] = []
        for part in chunk.split("\0"):
            ids += [int(x) for x in self.encode_chunks([part])[0]] if part else []
            ids.append(int(self.bytes_ids[0]))
        return np.array(ids[:-1], np.int64)

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _bisect(keys: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each wanted key in its own range of keys, all ranges at once."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        value = keys[np.minimum(middle, len(keys) - 1)]
        go = open_ & ((value <= wanted) if right else (value < wanted))
        low = np.where(go, middle + 1, low)
        high = np.where(open_ & ~go, middle, high)
    return low


def coder(path: str) -> PieceCoder:
    """One for each worker process, so that known pairs are kept from batch to batch."""
    if path not in _coders:
        _coders[path] = PieceCoder(path)
    return _coders[path]


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """doc_id, ids (if asked for), n_ids, ids_crc32 (of little-endian unsigned 32-bit ids), round_trip: whether the ids decode
    to the text; and the decoded text, if asked for."""
    path = path or model_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                texts = part.column("text").to_pylist()
                rows = own.encode(texts)
                columns = [part.column("doc_id")]
                if with_ids:
                    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).astype(np.int32))))
                columns.append(pa.array([len(r) for r in rows], pa.int64()))
                columns.append(pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in rows], pa.int64()))
                decoded = [own.decode(r) for r in rows]
                columns.append(pa.array([d == (t or "").replace(SPACE, " ") for d, t in zip(decoded, texts, strict=True)], pa.bool_()))
                if with_text:
                    columns.append(pa.array(decoded, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *["ids"] * with_ids, "n_ids", "ids_crc32", "round_trip", *["text"] * with_text])

    schema = "doc_id long, " + "ids array<int>, " * with_ids + "n_ids long, ids_crc32 long, round_trip boolean" + ", text string" * with_text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(encode), T.StructType.fromDDL(schema))


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids give a null text."""
    path = path or model_path()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            texts = [None if ids is None else own.decode(np.array(ids, np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(frugal(decode), T.StructType.fromDDL("doc_id long, text string"))
