"""Near-duplicate classes by DartMinHash, banded joining and exact verification.

A text is the multiset of its five-word shingles, and similarity is weighted Jaccard. A shingle's weight axis and a rank
axis are cut in unit regions; each region holds a Poisson number of darts that depends on the region alone. A text takes
the darts below its weight and below a rank limit that yields about k ln k + 2k darts whatever the text's size; each dart
falls on one of k coordinates, the earliest of a coordinate is kept, and texts with an empty coordinate look at more ranks.
Two texts agree in a coordinate with the chance of their similarity.

The input is written once to the shared folder under row numbers (`ledger.keyed`), and rows are known by these, never by
doc_id, so rows that share an id but not their text don't mix. Equal multisets are one representative from the start.
Representatives that share a band key are candidates. A bucket is never expanded into all its pairs: members are compared
with the bucket's most central member (the one with the most company in all its buckets) and united if their shingles are
similar enough. What is left after that, members outside a bucket's main class against members of other classes, is
compared in full: small buckets by a join, large ones in blocks of bounded size, each an inverted index from which only links
leave. So no candidate pair is left out unless its two texts are already in one class. Pairs are compared by the exact
weighted Jaccard of 32-bit hashes of their shingles (of each occurrence), never by signatures. Texts aren't shuffled: those
with company are found where they lie, and only their hashes move.

Defined results: null texts, texts without words and rows without doc_id are classes of their own (class_id is their
doc_id). Texts of fewer than five words are one shingle. Repeated rows share a class. class_id is the class's smallest
doc_id, and the rows of that id stay, if their shingles are those of the text that stays; of several texts under that id in
one class, one stays. Rows of one id with unrelated texts are in several classes; should two classes have the same smallest
doc_id by this, both give it as class_id, but their sizes and what they keep stay apart. Very long texts are hashed whole.
An empty table gives an empty result; columns other than doc_id and text are ignored by `near_duplicates` and returned as
they are by `apart`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, mix, row_bounds, span_hashes, text_buffer, text_slices, word_spans, work_folder, written
from .components import components
from .ledger import bitmaps, keyed, marked

WORDS = 5
SIMILARITY = 0.8
SLICE = 1 << 19
BANDS, ROWS = 24, 5
#: Buckets of more members are compared in blocks of so many.
SMALL, BLOCK = 32, 256


def shingles(data: np.ndarray, offs: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, 44-bit hash and multiplicity of every distinct shingle of each row, rows ascending."""
    starts, ends, rows = word_spans(data, offs)
    hashes = span_hashes(data, starts, ends)
    n = len(offs) - 1
    bounds = row_bounds(rows, n)
    size = np.diff(bounds)
    first = np.arange(len(rows)) - bounds[rows]
    kept = first <= np.maximum(0, size[rows] - words)
    at = np.flatnonzero(kept & (first < np.maximum(1, size[rows] - words + 1)))
    length = np.minimum(words, size[rows[at]])
    total = np.zeros(len(at), np.uint64)
    for k in range(words):
        here = np.minimum(at + k, max(0, len(hashes) - 1))
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + np.where(k < length, hashes[here], np.uint64(0)))
    keys = (rows[at].astype(np.uint64) << np.uint64(44)) | (total >> np.uint64(20))
    keys.sort()
    begin = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(begin, len(keys)))
    keys = keys[begin]
    return (keys >> np.uint64(44)).astype(np.int64), keys & np.uint64((1 << 44) - 1), counts


def unit_cells(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each element's weight cut in cells: row, cell hash, and how much of the cell the weight covers."""
    cells = np.ceil(weights).astype(np.int64)
    number = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    cover = np.minimum(1.0, np.repeat(weights, cells) - number)
    return np.repeat(rows, cells), mix(np.repeat(hashes, cells) + number.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), cover


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_minhash(rows: np.ndarray, cells: np.ndarray, cover: np.ndarray, n: int, k: int) -> np.ndarray:
    """n signatures of k coordinates (uint64) of the cells of n rows, rows ascending; rows without cells are all 0."""
    out = np.zeros(n * k, np.uint64)
    weight = np.bincount(rows, cover, n)
    limit = np.divide(k * math.log(k) + 2 * k, weight, out=np.zeros(n), where=weight > 0)
    while len(rows):
        strips = np.ceil(limit[rows]).astype(np.int64)
        row = np.repeat(rows, strips)
        strip = np.arange(len(row)) - np.repeat(np.cumsum(strips) - strips, strips)
        region = mix(np.repeat(cells, strips) ^ (strip.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
        room = np.minimum(1.0, limit[row] - strip)
        covered = np.repeat(cover, strips)
        rank = np.zeros(len(row))
        taken, number = [], 0
        while len(row):
            # The next dart of each region is an exponential step further along its ranks.
            dart = mix(region + np.uint64((number + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
            rank = rank - np.log(_uniform(dart))
            inside = rank <= room
            row, strip, region, room, covered, rank, dart = (x[inside] for x in (row, strip, region, room, covered, rank, dart))
            hit = mix(dart ^ np.uint64(0xE7037ED1A0B428DB))
            below = (covered >= 1.0) | (_uniform(hit) <= covered)
            taken.append((row[below] * k + (hit[below] % np.uint64(k)).astype(np.int64), (strip + rank)[below], dart[below]))
            number += 1
        coordinate, when, dart = (np.concatenate(x) for x in zip(*taken, strict=True))
        earliest = np.full(n * k, np.inf)
        np.minimum.at(earliest, coordinate, when)
        best = when == earliest[coordinate]
        out[coordinate[best]] = dart[best]
        empty = np.zeros(n, bool)
        present = np.zeros(n, bool)
        present[rows] = True
        empty[present] = np.isinf(earliest.reshape(n, k)[present]).any(axis=1)
        again = empty[rows]
        rows, cells, cover = rows[again], cells[again], cover[again]
        limit = limit * 2
    return out.reshape(n, k)


def band_keys(signatures: np.ndarray, bands: int, per: int) -> np.ndarray:
    """Keys of each row's bands; the lowest bits are the band's number modulo 8."""
    parts = signatures.reshape(len(signatures), bands, per)
    keys = np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(per):
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, j])
    return (keys & ~np.uint64(7)) | (np.arange(bands, dtype=np.uint64) & np.uint64(7))[None, :]


def signatures(docs: DataFrame, words: int, bands: int, per: int) -> DataFrame:
    """id, doc_id, g1, g2 (a 128-bit hash of the shingles; null without words), bands; from rows (id, doc_id, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                n = part.num_rows
                rows, hashes, counts = shingles(*text_buffer(part.column("text")), words)
                rows, cells, cover = unit_cells(rows, hashes, counts.astype(float))
                keys = band_keys(dart_minhash(rows, cells, cover, n, bands * per), bands, per)
                bounds = row_bounds(rows, n)
                sums = [np.append(np.uint64(0), np.cumsum(mix(cells ^ np.uint64(s)), dtype=np.uint64)) for s in (0x1234567, 0x89ABCDEF)]
                none = np.diff(bounds) == 0
                g1, g2 = ((x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in sums)
                lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * bands, pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("doc_id"), pa.array(g1, mask=none), pa.array(g2, mask=none), lists], ["id", "doc_id", "g1", "g2", "bands"])

    return docs.mapInArrow(frugal(sign), T.StructType.fromDDL("id long, doc_id long, g1 long, g2 long, bands array<long>"))


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """id, cells: the sorted 32-bit hashes of the cells of each text's shingles; from rows (id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                rows, hashes, counts = shingles(*text_buffer(part.column("text")), words)
                rows, cells, _ = unit_cells(rows, hashes, counts.astype(float))
                bounds, cells = row_bounds(rows, part.num_rows), (cells >> np.uint64(32)).astype("<u4")
                sets = [np.sort(cells[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], ["id", "cells"])

    return docs.mapInArrow(frugal(cut), T.StructType.fromDDL("id long, cells binary"))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays with few equal values in one of them."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # merges the two runs
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(a) + len(b) - shared) if len(both) else 0.0


def verified(pairs: DataFrame, sets: DataFrame, similarity: float, folder: str, name: str) -> DataFrame:
    """The pairs (u, v) of ids whose shingle sets are at least so similar."""
    # Merged at any size, so that the plan's cost grows in proportion: sets are far too large to be sent to every executor.
    sides = pairs.join(sets.select(F.col("id").alias("u"), F.col("cells").alias("a")).hint("merge"), "u").join(sets.select(F.col("id").alias("v"), F.col("cells").alias("b")).hint("merge"), "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            kept = [jaccard(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")) >= similarity for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(kept, pa.bool_()))

    return written(sides.select("u", "v", "a", "b").mapInArrow(frugal(compare), T.StructType.fromDDL("u long, v long")).distinct(), folder, f"{name}-edges")


def block_links(crowd: DataFrame, sets: DataFrame, similarity: float, folder: str, block: int) -> DataFrame:
    """Links (u, v) within large buckets, from rows (band, rep, label, main, n): members of another class than `main`
    against all members of classes other than their own. Both sides are dealt in blocks, so a task holds two of them."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("rep", "band"), blocks.cast("long")).cast("int")
    member = crowd.select("band", "rep", "label", own.alias("j"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"), F.lit(False).alias("outside"))
    outside = crowd.where("label <> main").select("band", "rep", "label", own.alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"), F.lit(True).alias("outside"))
    dealt = member.unionByName(outside).join(sets.withColumnRenamed("id", "rep").hint("merge"), "rep")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, labels = group.column("rep").to_numpy(), group.column("label").to_numpy()
        far = group.column("outside").to_numpy(zero_copy_only=False)
        cells = [np.frombuffer(x.as_buffer(), "<u4") for x in group.column("cells").combine_chunks()]
        near = np.flatnonzero(~far)
        found_u, found_v = [], []
        if len(near) and far.any():
            sizes = np.array([len(cells[k]) for k in near])
            terms, owners = np.concatenate([cells[k] for k in near]), np.repeat(np.arange(len(near)), sizes)
            order = np.argsort(terms, kind="stable")
            terms, owners = terms[order], owners[order]
            for k in np.flatnonzero(far):
                low, high = np.searchsorted(terms, cells[k], "left"), np.searchsorted(terms, cells[k], "right")
                size = high - low
                hits = owners[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)]
                shared = np.bincount(hits, minlength=len(near))
                linked = near[(shared >= similarity * (sizes + len(cells[k]) - shared)) & (labels[near] != labels[k])]
                found_u += [ids[k]] * len(linked)
                found_v += ids[linked].tolist()
        return pa.table({"u": pa.array(found_u, pa.int64()), "v": pa.array(found_v, pa.int64())})

    links = dealt.groupBy("band", "i", "j").applyInArrow(compare, T.StructType.fromDDL("u long, v long"))
    return written(links.distinct(), folder, "crowd-links")


def _classes(ledger: DataFrame, folder: str, words: int, similarity: float, bands: int, per: int, small: int, block: int) -> DataFrame:
    """id, doc_id, class_id, class_size, kept of every row of a ledger."""
    rows = ledger.select("id", "pid", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"))
    signed = written(signatures(rows.select("id", "doc_id", "text"), words, bands, per), folder, "signatures")
    groups = signed.where("doc_id is not null and g1 is not null").groupBy("g1", "g2").agg(F.min("id").alias("rep"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    groups = written(groups, folder, "groups")
    entries = groups.select("rep", F.explode("bands").alias("band"))

    crowded = written(entries.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), folder, "crowded")
    entries = written(entries.join(crowded, "band"), folder, "entries")  # of buckets with company
    company = written(entries.groupBy("rep").agg(F.sum("n").alias("company")), folder, "company")
    with_company = written(bitmaps(company.select(F.col("rep").alias("id"))), folder, "with-company")
    sets = written(shingle_sets(marked(rows, with_company).where("hit").select("id", "text"), words), folder, "sets")

    centers = written(entries.join(company, "rep").groupBy("band").agg(F.max_by("rep", F.struct("company", "rep")).alias("center")), folder, "centers")
    pairs = entries.join(centers, "band").where("rep <> center")
    tested = written(pairs.select(F.greatest("rep", "center").alias("u"), F.least("rep", "center").alias("v")).distinct(), folder, "pairs-0")
    labels = components(verified(tested, sets, similarity, folder, "round-0"), folder, "components-0")

    members = entries.join(labels.select(F.col("u").alias("rep"), F.col("v").alias("root")), "rep", "left").select("rep", "band", "n", F.coalesce("root", "rep").alias("label"))
    mixed = written(members.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("band"), folder, "mixed")
    members = written(members.join(mixed, "band", "left_semi"), folder, "members")
    main = members.groupBy("band", "label").agg(F.count(F.lit(1)).alias("size")).groupBy("band").agg(F.max_by("label", "size").alias("main"))
    members = written(members.join(written(main, folder, "main"), "band"), folder, "last-members")
    links = block_links(members.where(F.col("n") > small), sets, similarity, folder, block)
    few = members.where(F.col("n") <= small)
    outside = few.where("label <> main").select("band", F.col("rep").alias("u"), F.col("label").alias("mine"))
    pairs = outside.join(few.select("band", F.col("rep").alias("v"), "label"), "band").where((F.col("mine") != F.col("label")) & (F.col("u") != F.col("v")))
    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().join(tested, ["u", "v"], "left_anti")
    found = verified(written(pairs, folder, "pairs-1"), sets, similarity, folder, "round-1").unionByName(links).unionByName(labels)
    labels = components(found, folder, "components-1")

    groups = groups.join(labels.select(F.col("u").alias("rep"), F.col("v").alias("root")), "rep", "left").select("g1", "g2", "copies", "first", F.coalesce("root", "rep").alias("root"))
    groups = written(groups, folder, "classes")
    # The text that stays: of those with the smallest id the first by hash.
    sizes = written(groups.groupBy("root").agg(F.sum("copies").alias("class_size"), F.min(F.struct("first", "g1", "g2")).alias("stays")), folder, "sizes")
    classes = groups.join(sizes, "root").select("g1", "g2", "class_size", F.col("stays.first").alias("class_id"), ((F.col("stays.g1") == F.col("g1")) & (F.col("stays.g2") == F.col("g2"))).alias("stays"))
    classes = written(classes, folder, "classes-sized")
    found = signed.select("id", "doc_id", F.when(F.col("doc_id").isNotNull(), F.col("g1")).alias("g1"), "g2").join(classes, ["g1", "g2"], "left")
    kept = F.col("stays") & (F.col("class_id") == F.col("doc_id"))
    return found.select("id", "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce(kept, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, per: int = ROWS, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, class_size, kept for every row of docs (doc_id, text)."""
    folder = work_folder(docs.sparkSession)
    ledger = keyed(docs.select("doc_id", "text"), folder, "ledger")
    return _classes(ledger, folder, words, similarity, bands, per, small, block).drop("id")


def apart(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, per: int = ROWS, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """The rows of docs that stay, one document of each class, with all their columns; texts aren't shuffled."""
    folder = work_folder(docs.sparkSession)
    ledger = keyed(docs, folder, "ledger")
    dropped = _classes(ledger, folder, words, similarity, bands, per, small, block).where(~F.col("kept")).select("id")
    words_ = written(bitmaps(dropped), folder, "dropped")
    return marked(ledger, words_).where(~F.col("hit")).select("row.*")
