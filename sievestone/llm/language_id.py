"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of pieces from all over labelled training texts. A text is encoded once per
language, and the language whose dictionary makes it smallest wins; the text is rejected when the runner-up is nearly
as small. The dictionaries are the whole model: at most `dictionary_bytes` per language and `total_bytes` for all languages,
which bounds what is sent to the executors. Every language is learned; the more there are, the smaller are the dictionaries.

Defined results: null texts and texts without a letter get `und`, score 0 and are rejected. Equal sizes go to the
alphabetically first language. With no training rows every text is `und`. Long texts are encoded whole, in parts. Columns other
than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, hash_bound

DICTIONARY_BYTES = 1 << 17
TRAINING_TEXTS = 400
#: Bytes of all dictionaries together: above 64 languages, each gets an equal part.
TOTAL_BYTES = 64 * DICTIONARY_BYTES
#: Texts are encoded with so many languages at a time, which bounds the encoders that a worker holds.
GROUP = 64
#: A text longer than its share gives so many pieces, one of each part of the text.
PIECES = 4
LEVEL = 6
#: A text is encoded in parts of so many bytes, so that the dictionary stays in the window and all parts count alike.
PART_BYTES = 8192
#: Least lead of the winner over the runner-up, as a share of the runner-up's size.
MARGIN = 0.003


def _pieces(share: Column) -> Column:
    """At most `share` bytes of a text: all of it, or a piece at a hashed position of each of PIECES equal parts."""
    raw, size = F.col("text").cast("binary"), F.octet_length("text")
    part, piece = F.floor(size / PIECES), F.greatest(F.lit(1), F.floor(share / PIECES)).cast("int")
    starts = [k * part + F.pmod(F.xxhash64("text", F.lit(k)), part - piece + 1) for k in range(PIECES)]
    return F.when(size <= F.greatest(share, PIECES * piece), raw).otherwise(F.concat(*[F.substring(raw, (at + 1).cast("int"), piece) for at in starts]))


def train(docs: DataFrame, dictionary_bytes: int = DICTIONARY_BYTES, texts: int = TRAINING_TEXTS, total_bytes: int = TOTAL_BYTES) -> dict[str, bytes]:
    """Dictionaries from rows (doc_id, text, lang) for every language: per language a sample of `texts` texts, the smallest
    by a hash of id and text, of each an equal share of the dictionary, taken from all over the text. Copies of a row count
    once. Where a language has fewer texts, their shares are larger; where dictionaries must be smaller, there are fewer
    texts. Sample and share are bounds of the model's size, not of what is judged. A language with less than 8 bytes of text
    can't be learned."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    languages = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not languages:
        return {}
    room = max(8, min(dictionary_bytes, total_bytes // len(languages)))
    wanted = max(1, min(texts, room * texts // dictionary_bytes))

    def below(bounds: list[tuple], ddl: str) -> DataFrame:
        return rows.join(F.broadcast(docs.sparkSession.createDataFrame(bounds, ddl)), "lang").where(F.col("h") <= F.col("bound"))

    first, found = defaultdict(list), defaultdict(list)
    # At least 32 hashes a language are expected, so that none is left without.
    for r in below([(lang, hash_bound(max(8, wanted), n)) for lang, n in languages.items()], "lang string, bound long").select("lang", "h").distinct().collect():
        first[r["lang"]].append(r["h"])
    plan = [(lang, sorted(h)[:wanted][-1], max(1, room // min(wanted, len(h)) - 1)) for lang, h in first.items()]
    for r in below(plan, "lang string, bound long, share int").select("lang", "h", _pieces(F.col("share")).alias("raw")).distinct().collect():
        found[r["lang"]].append((r["h"], bytes(r["raw"])))
    out = {lang: b"\n".join(raw for _, raw in sorted(x))[:room] for lang, x in sorted(found.items())}
    return {k: v for k, v in out.items() if len(v) >= 8}


def _coders(model: list[tuple[str, bytes]], level: int) -> list:
    import zstandard as zstd

    out = []
    for lang, raw in model:
        words = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=level)
        out.append((lang, zstd.ZstdCompressor(dict_data=words, write_content_size=False, write_dict_id=False)))
    return out


def _judge(model: list[tuple[str, bytes]], level: int):
    """A function from an Arrow column of texts to (language, score, lead) for each."""
    import regex

    letter = regex.compile(r"\p{L}")
    groups = [model[k : k + GROUP] for k in range(0, len(model), GROUP)]
    held = _coders(groups[0], level) if len(groups) == 1 else None

    def judge(texts: pa.Array) -> list[tuple[str, float, float]]:
        best: list[list[tuple[int, str]] | None] = [[] if model and (text := x.as_py()) and letter.search(text) else None for x in texts]
        for group in groups:
            coders = held or _coders(group, level)
            for k, sizes in enumerate(best):
                if sizes is not None:
                    raw = texts[k].as_py().encode("utf-8", "surrogatepass")
                    parts = [raw[a : a + PART_BYTES] for a in range(0, len(raw), PART_BYTES)]
                    best[k] = sorted([*sizes, *((sum(len(c.compress(p)) for p in parts), lang) for lang, c in coders)])[:2]
        out = []
        for sizes in best:
            if sizes is None:
                out.append(("und", 0.0, 0.0))
                continue
            lead = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
            out.append((sizes[0][1], 1 / (1 + math.exp(-min(50.0, 60 * lead))), lead))
        return out

    return judge


def classify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, level: int = LEVEL) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), margin, rejected for every row of docs (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(sorted(dictionaries.items()))  # at most TOTAL_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(model.value, level)
        for batch in batches:
            found = judge(batch.column("text"))
            langs, scores, leads = zip(*found, strict=True) if found else ((), (), ())
            rejected = [x < margin or k == "und" for k, _, x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(leads, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "margin", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), T.StructType.fromDDL("doc_id long, lang_pred string, score double, margin double, rejected boolean"))


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, level: int = LEVEL) -> DataFrame:
    """The rows of docs whose language isn't rejected, with all their columns; nothing is joined or shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(sorted(dictionaries.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(model.value, level)
        for batch in batches:
            yield batch.filter(pa.array([k != "und" and x >= margin for k, _, x in judge(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)
