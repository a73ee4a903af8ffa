"""URL verdicts: host and path rules first, then logistic regression on hashed character n-grams of host and path.

The regression is trained on the driver from a small labelled URL table (a parameter; LABELLED by default) by Newton's
method with an L2 penalty. Weights are a fixed-size vector, so what executors receive doesn't depend on the data.

The table is invented and small; verdicts without a rule are no better than it.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule, and is judged by the
regression's bias alone. A-Z of hosts are lower-cased and nothing else is normalised. Of fitting rules the longest wins,
ties go to the alphabetically first. Rows repeat as they come, with or without a page_id; very long urls are judged whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, span_hashes, text_buffer, text_slices

#: (host/path, verdict)
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
DIMENSIONS = 1 << 14
GRAMS = (3, 4, 5)
PENALTY = 0.05
#: Words of the labelled hosts and paths. Hosts with a pair of unwanted words and paths that sell or lure are blocked (1);
#: a host without a sign is judged by its path, so both carry information.
UNWANTED = [("casino", "bonus"), ("casino", "win"), ("cheap", "pills"), ("cheap", "meds"), ("adult", "cams"), ("adult", "xxx"), ("spam", "links"), ("free", "money"), ("win", "prizes"), ("payday", "loans"), ("crack", "keygen"), ("replica", "watches"), ("ads", "track"), ("free", "bets")]
WANTED = [("daily", "news"), ("city", "library"), ("garden", "notes"), ("weather", "maps"), ("open", "software"), ("health", "advice"), ("home", "recipes"), ("train", "tracks"), ("school", "physics"), ("cycling", "forum"), ("travel", "books"), ("museum", "history")]
LURES = ["/buy-now", "/order/pills/", "/win/bonus.html", "/xxx/cams", "/free-download/keygen", "/loans/apply-now"]
READING = ["/about", "/articles/2023/", "/docs/guide.html", "/recipes/bread", "/forum/thread", "/history/maps"]
#: Hosts of common syllables, which say nothing.
SYLLABLES = ["th", "on", "er", "an", "ti", "en", "st", "re", "ou", "ha"]
PLAIN_HOSTS = [f"{('', 'www.', 'm.', 'blog.')[k % 4]}{SYLLABLES[k % 10]}{SYLLABLES[k // 3 % 10]}{SYLLABLES[k * 7 % 10]}.example.{('com', 'net', 'org')[k % 3]}" for k in range(30)]
PLAIN_PATHS = ["/en/1", "/de/77", "/fr/204/", "/es/9.html"]


def _hosts(pairs: list[tuple[str, str]]) -> list[str]:
    return [form.format(a, b) for a, b in pairs for form in ("{}-{}.example.com", "www.{}{}.test", "m.{1}-{0}.example.org")]


LABELLED = [(f"http://{h}{p}", 1) for h in _hosts(UNWANTED) for p in (LURES[len(h) % 6], *PLAIN_PATHS)]
LABELLED += [(f"https://{h}{p}", 0) for h in _hosts(WANTED) for p in (READING[len(h) % 6], *PLAIN_PATHS)]
LABELLED += [(f"https://{h}{p}", y) for k, h in enumerate(PLAIN_HOSTS) for y, p in [(1, LURES[k % 6]), (0, READING[k % 6]), *((0, p) for p in PLAIN_PATHS)]]


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits; built-in expressions only."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        rule_host, _, rest = text.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(f"/{rest}"))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def gram_features(texts: pa.Array, salt: int, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Row and dimension of every character n-gram (of UTF-8 bytes) of texts with `^` and `$` at their ends."""
    data, offs = text_buffer(texts)
    rows, dims = [], []
    for n in GRAMS:
        starts = np.arange(max(0, len(data) - n + 1))
        row = np.searchsorted(offs, starts, side="right") - 1
        inside = starts + n <= offs[row + 1] if len(starts) else np.zeros(0, bool)
        starts, row = starts[inside], row[inside]
        rows.append(row)
        dims.append(((span_hashes(data, starts, starts + n) ^ np.uint64(salt * 0x9E3779B9)) % np.uint64(dimensions)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(dims)


def _both(host: list[str], path: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [gram_features(pa.array([f"^{x}$" for x in texts], pa.string()), salt) for salt, texts in ((1, host), (2, path))]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def train(labelled: list[tuple[str, int]] = LABELLED, penalty: float = PENALTY, rounds: int = 25) -> np.ndarray:
    """Weights and, last, the bias; from (url, 1 to block or 0 to allow)."""
    hosts, paths = zip(*(_split(u) for u, _ in labelled), strict=True)
    rows, dims = _both(list(hosts), list(paths))
    x = np.zeros((len(labelled), DIMENSIONS))
    np.add.at(x, (rows, dims), 1.0)
    x = np.minimum(x, 1.0) / np.sqrt(np.maximum(1.0, np.minimum(x, 1.0).sum(axis=1, keepdims=True)))
    y = np.array([v for _, v in labelled], float)
    # In the span of the rows: w = x'a, with kernel k = x x'; the bias is not penalised.
    k, a, b = x @ x.T, np.zeros(len(y)), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(k @ a + b)))
        s = np.maximum(p * (1 - p), 1e-6)
        z = k @ a + b + (y - p) / s
        m = k + penalty * np.diag(1 / s)
        u, v = np.linalg.solve(m, np.ones(len(y))), np.linalg.solve(m, z)
        b = float(v.sum() / u.sum())
        a = v - b * u
    return np.append(x.T @ a, b)


def _split(url: str | None) -> tuple[str, str]:
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    stop = min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))
    return host, rest[end:stop] if stop > end else ""


def scores(hosts: pa.Array, paths: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Chance of `block`. An n-gram counts once a text."""
    rows, dims = _both(hosts.to_pylist(), paths.to_pylist())
    key = np.unique(rows * DIMENSIONS + dims)
    rows, dims = key // DIMENSIONS, key % DIMENSIONS
    total = np.bincount(rows, weights[dims], len(hosts))
    return 1 / (1 + np.exp(-(total / np.sqrt(np.maximum(1, np.bincount(rows, minlength=len(hosts)))) + weights[-1])))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: list[tuple[str, int]] = LABELLED, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of pages (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    weights = train(labelled)
    bias = float(1 / (1 + np.exp(-weights[-1])))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in text_slices(batch, "host", 1 << 18):
                for part in text_slices(half, "path", 1 << 18):
                    p = scores(part.column("host"), part.column("path"), weights)
                    p[(np.array(part.column("host").to_pylist()) == "") & (np.array(part.column("path").to_pylist()) == "")] = bias
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], ["page_id", "host", "path", "score"])

    judged = split.mapInArrow(frugal(score), T.StructType.fromDDL("page_id long, host string, path string, score double"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "score")
