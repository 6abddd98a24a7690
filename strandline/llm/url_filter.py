"""URL filter: path rules first, else logistic regression on hashed character n-grams of host and path.

The model is fitted on a small labelled table of URLs (labelled_table() makes one by rule; any
other may be given) and travels to the tasks as one array of 2^16 weights.

Null URLs and those without ``://`` have an empty host and path, which the model judges as such.
URLs are judged one by one: ties and repeated rows agree, in any order and on any machine. Very long
URLs are read whole, in windows. Only the URL column is read; others pass through untouched.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 1 << 16
SIZES = (3, 4, 5)
WINDOW = 1 << 20  # characters hashed at once
_P, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

#: What a policy knows: (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Words of hosts and paths that the labelled table calls unwanted, and ordinary ones.
UNWANTED = (
    "casino poker slots jackpot roulette bet bets betting gamble lottery win adult porn xxx sex nude cam escort dating pills pharma viagra cialis cheap diet replica "
    "spam farm ads adserver banner track tracker tracking click clicks popup affiliate promo free warez torrent crack keygen loan payday crypto bonus deals"
).split()
ORDINARY = (
    "news blog docs wiki library museum school college research science journal archive forum city council health garden kitchen travel weather sport music film "
    "history nature code dev data maps radio press daily herald times review open project lab tools books help about team home page article story report index"
).split()


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host and path together; at a tie the longer host) that fits, like ``net/``, and its verdict; null if none does.

    A rule fits its host and all subdomains where the path starts with the rule's. ``rules`` is a
    short policy list, compared in turn.
    """
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def labelled_table(n: int = 4000, seed: int = 11) -> list[tuple[str, int]]:
    """URLs and labels (1: unwanted), half of each, by rule: host labels and paths of invented syllables and known words."""
    rng = random.Random(seed)

    def invented() -> str:
        return "".join(rng.choice(("", "b", "br", "c", "ch", "d", "f", "g", "h", "l", "m", "n", "p", "r", "s", "sh", "st", "t", "th", "tr", "v", "w")) + rng.choice(("a", "e", "i", "o", "u", "ea", "ou", "ion", "er", "an")) + rng.choice(("", "n", "r", "s", "t", "th", "nd", "st", "l")) for _ in range(rng.randint(1, 3)))

    def host(words: list[str], sure: bool) -> str:
        k = rng.random()
        if k < 0.35:
            name = [rng.choice(words), rng.choice(words)]
        elif sure or k < 0.6:
            name = [rng.choice(words), invented() if rng.random() < 0.5 else str(rng.randint(1, 999))]
        else:
            name = [invented() for _ in range(rng.randint(1, 2))]
        if sure and rng.random() < 0.3:
            rng.shuffle(name)
        parts = [rng.choice(("-", "-", "")).join(name), *([rng.choice((*ORDINARY, "example", invented()))] if rng.random() < 0.6 else [])]
        return ".".join([*([rng.choice(("www", "m", "blog", "cdn"))] if rng.random() < 0.5 else []), *parts, rng.choice(("com", "net", "org", "info", "io", "de", "fr", "co.uk"))])

    def path(words: list[str]) -> str:
        parts = [rng.choice(words) if rng.random() < 0.3 else rng.choice(("en", "de", "fr", "es", invented(), str(rng.randint(1, 99999)))) for _ in range(rng.randint(0, 4))]
        return "/" + "/".join(parts) + rng.choice(("", "/", ".html", ".php")) if parts else rng.choice(("", "/"))

    out = []
    for i in range(n):
        bad = i % 2
        words = UNWANTED if bad else ORDINARY
        out.append((f"{rng.choice(('http', 'https'))}://{host(words, bool(bad))}{path([*ORDINARY, *words])}", bad))
    return out


def _windows(texts: list[str]) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Rows, pieces and the number of positions of each piece at which n-grams begin, WINDOW characters at once."""
    rows, pieces, starts, held = [], [], [], 0
    for i, t in enumerate(texts):
        for s in range(0, len(t), WINDOW):
            piece = t[s : s + WINDOW + SIZES[-1] - 1]
            rows.append(i)
            pieces.append(piece)
            starts.append(min(WINDOW, len(t) - s))
            held += len(piece)
            if held >= WINDOW:
                yield rows, pieces, starts
                rows, pieces, starts, held = [], [], [], 0
    if rows:
        yield rows, pieces, starts


def ngrams(texts: list[str], seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and bucket of every character n-gram, in arrays of bounded size; texts are fenced, so that their ends count."""
    for rows, pieces, starts in _windows([f"\x02{t}\x03" for t in texts]):
        code = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        length = np.array([len(p) for p in pieces])
        first = np.repeat(np.cumsum(length) - length, length)
        at = np.arange(len(code)) - first
        left, row, begins = np.repeat(length, length) - at, np.repeat(rows, length), at < np.repeat(starts, length)
        h = np.full(len(code), seed, np.uint64)
        for k in range(SIZES[-1]):
            h = h * _P + np.append(code[k:], np.zeros(min(k, len(code)), np.uint64)) + np.uint64(1)
            if k + 1 in SIZES:
                here = begins & (left > k)
                mixed = (h[here] ^ (h[here] >> np.uint64(29))) * _M
                yield row[here], (mixed >> np.uint64(48)).astype(np.int64)


def _features(hosts: list[str], paths: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    yield from ngrams(hosts, 1)
    yield from ngrams(paths, 2)


def probabilities(hosts: list[str], paths: list[str], weights: np.ndarray) -> np.ndarray:
    """Probability that each URL is unwanted; ``weights`` ends with the bias."""
    total, count = np.zeros(len(hosts)), np.zeros(len(hosts))
    for row, bucket in _features(hosts, paths):
        total += np.bincount(row, weights[bucket], len(hosts))
        count += np.bincount(row, minlength=len(hosts))
    return 1 / (1 + np.exp(-np.clip(total / np.sqrt(np.maximum(count, 1)) + weights[-1], -500, 500)))


def fit(hosts: list[str], paths: list[str], labels: list[int], steps: int = 400, rate: float = 0.5, penalty: float = 1e-4) -> np.ndarray:
    """Weights of the regression by accelerated gradient steps over all labelled rows, which have unit-free features: counts over the root of their number."""
    found = list(_features(hosts, paths))
    row, bucket = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    y, n = np.asarray(labels, float), len(labels)
    value = 1 / np.sqrt(np.bincount(row, minlength=n))[row]
    w, before = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for k in range(steps):
        ahead = w + k / (k + 3) * (w - before)
        p = 1 / (1 + np.exp(-np.bincount(row, ahead[bucket] * value, n) - ahead[-1]))
        grad = np.append(np.bincount(bucket, (p - y)[row] * value, BUCKETS), (p - y).sum()) / n + penalty * ahead
        before, w = w, ahead - rate * grad
    return w


def fit_table(labelled: DataFrame | list[tuple[str, int]], most: int = 20_000) -> np.ndarray:
    """Fit on (url, label) rows; of a larger table on the ``most`` rows of smallest hash, so that the driver's part is bounded."""
    import re

    if isinstance(labelled, DataFrame):
        rows = labelled.select("url", "label").filter("url is not null and label is not null")
        labelled = [(r["url"], int(r["label"])) for r in rows.orderBy(F.xxhash64("url", "label"), "url", "label").limit(most).collect()]
    parts = [re.match(r"([^/?#]*)([^?#]*)", u.partition("://")[2]).groups() for u, _ in labelled[:most]]
    return fit([h.translate(str.maketrans(UPPER, LOWER)) for h, _ in parts], [p for _, p in parts], [y for _, y in labelled[:most]])


def judge_urls(pages: DataFrame, weights: np.ndarray, rules: list[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """Adds host, path, rule, probability (that the URL is unwanted) and verdict ('allow' or 'block'): the rule's, else block from 0.5 on."""
    model = pages.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def unwanted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series(probabilities(hosts.tolist(), paths.tolist(), model.value))

    host, path = split_url(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"rule": rule, "_v": verdict, "probability": unwanted("host", "path")})
    return out.withColumn("verdict", F.coalesce("_v", F.when(F.col("probability") >= 0.5, "block").otherwise("allow"))).drop("_v")
