"""URL filters: host rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small labelled URL table (a parameter,
``LABELLED`` by default). Its weights are one vector of ``BUCKETS`` numbers, so
their broadcast has a fixed size. Rules are a small list; the longest that fits
decides, and the model decides where none fits.

A null URL, or one without "://", has an empty host and path and no rule; the model
judges it by its bias alone. Repeated rows are judged alike; an empty table gives an
empty result. Of rules of equal length the first in the list counts. URLs of any length
are read whole.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
SIZES = (3, 4, 5)
MAX_LABELLED = 20_000

# Host and path prefixes with their verdicts.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

# Words that mark unwanted and wanted addresses, common English words, and words that both kinds use.
UNWANTED = "casino poker slots jackpot lottery betting viagra cialis pills pharmacy steroids payday loans escort xxx porn adult cams hookup torrent warez crack keygen replica forex doubler giveaway prize spam clickbait popunder adserver adtrack affiliate malware phishing".split()
WANTED = "news library museum university school science history weather recipes garden travel music sports health council archive journal forum wiki docs books film nature physics market bakery hotel church village river mountain radio theatre kitchen poetry law".split()
COMMON = "action answer another brother building century children company country different during education example family father general government group history however information interest language letter mother nation nothing number other picture place point position question school several something state station street system than thing though through together water where which without woman world writing young".split()
NEUTRAL = "my the best top online world free daily club zone center web site home info shop store live win farm cheap".split()
#: Ordinary words that hold the letters of unwanted ones.
LOOKALIKE = "essex middlesex sussex crackers firecracker camshaft camera spamalot scampi pilot pillow slotted escorted grandeur specialist popunion transex loansome sextant cameo popular porcelain portrait tortoise sparrow wares warehouse fishing torrential replicate".split()
ENDINGS = ["com", "org", "net", "info", "de", "fr", "co.uk", "io"]
#: Shapes of addresses: host, ending, a path word and a number.
SHAPES = [
    "http://{h}.{e}/", "https://www.{h}.{e}/{p}", "https://{h}.{e}/{p}/{n}", "http://m.{h}.{e}/index.php?id={n}", "https://{h}.{e}/{p}.html#{p}", "https://shop.{h}.{e}",
    "http://{h}.{e}:8080/{n}/{p}", "https://{h}.{e}/{n}/{p}-{n}.htm", "https://en.{h}.{e}/{p}/?q={n}", "http://{h}{n}.{e}/{p}/{p}/",
]


def labelled_by_rule(shapes: list[str] = SHAPES, inside: int = 3, seed: int = 7, unwanted: list[str] = UNWANTED, wanted: list[str] = WANTED) -> list[tuple[str, int]]:
    """A small labelled table: each word in hosts, inside of ``inside`` longer names (a short word twice as many) and in paths, and names that mean nothing."""
    rng, out = random.Random(seed), []

    def name() -> str:
        return "".join(rng.choice("bcdfghklmnprstvz") + rng.choice(["a", "e", "i", "o", "u", "ou", "an", "er"]) for _ in range(rng.randint(2, 4)))

    def add(host: str, path: str, label: int, shapes: list[str] = shapes) -> None:
        out.append((rng.choice(shapes).format(h=host, e=rng.choice(ENDINGS), p=path, n=rng.randint(1, 9999)), label))

    for label, words in ((1, unwanted), (0, wanted)):
        for word in words:
            near = lambda: rng.choice(NEUTRAL)
            hosts = [word, f"{near()}-{word}", f"{word}-{near()}", f"{near()}{word}", f"{word}{near()}", f"{name()}{word}", f"{word}-{rng.choice(words)}"]
            hosts += [f"{near()}{word}{near()}" for _ in range(inside if len(word) > 5 else 2 * inside)] + [f"{name()}{word}{name()}"]
            for host in hosts:
                add(host, rng.choice([name(), near()]), label)
            for path in (word, f"{word}-{name()}", f"{near()}-{word}", f"{name()}/{word}"):
                add(name(), path, label, [x for x in shapes if "{p}" in x])
            add(rng.choice([name(), f"{name()}-{near()}", f"{near()}{near()}"]), name(), 0)
            add(rng.choice([name(), near(), f"{near()}{near()}"]), near(), 0)
    for word in COMMON:
        for host in (word, f"{word}{rng.choice(COMMON)}"):
            add(host, rng.choice(COMMON), 0)
    for word in LOOKALIKE:
        for host in (word, f"{word}s", f"{rng.choice(NEUTRAL)}{word}"):
            add(host, rng.choice(COMMON), 0)
    return out


LABELLED = labelled_by_rule()


class Url(NamedTuple):
    host: str
    path: str


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> Url:
    """Host, lower-cased in A-Z, and path; both empty without "://"."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return Url("", "")
    stop = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    tail = rest[stop:]
    cut = min((k for k in map(tail.find, "?#") if k >= 0), default=len(tail))
    return Url(rest[:stop].translate(_LOWER), tail[:cut])


def fitting_rule(url: Url, rules: list[tuple[str, str]]) -> tuple[str, str] | None:
    """The longest rule whose host is the url's or a parent of it and whose path begins the url's."""
    best = None
    for rule, verdict in rules:
        host, _, path = rule.partition("/")
        if (url.host == host or url.host.endswith("." + host)) and url.path.startswith("/" + path):
            if best is None or len(rule) > len(best[0]):
                best = (rule, verdict)
    return best


def grams(url: Url) -> np.ndarray:
    """Hashed character n-grams of host and path, marked apart; each counts once."""
    found = set()
    for mark, text in (("h", url.host), ("p", url.path)):
        if text:
            text = f"^{text}$"
            found.update(zlib.crc32(f"{mark}{text[k : k + n]}".encode()) % BUCKETS for n in SIZES for k in range(len(text) - n + 1))
    return np.array(sorted(found), dtype=np.int64)


class UrlModel:
    """Logistic regression with unit-length inputs and classes of equal weight, fitted by gradient descent with momentum."""

    def __init__(self, labelled: list[tuple[str, int]], ridge: float = 1e-5, steps: int = 400, rate: float = 10.0):
        rows = [grams(split_url(u)) for u, _ in labelled]
        y = np.array([label for _, label in labelled], dtype=float)
        self.weights, self.bias = np.zeros(BUCKETS), 0.0
        flat = np.concatenate([*rows, np.empty(0, np.int64)])
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        scale = np.array([1 / math.sqrt(max(1, len(r))) for r in rows])
        # Both classes weigh the same, whatever their numbers.
        share = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, len(y) - y.sum()))
        speed, speed_bias = np.zeros(BUCKETS), 0.0
        for _ in range(steps if len(rows) else 0):
            z = np.bincount(owner, self.weights[flat], len(rows)) * scale + self.bias
            error = (1 / (1 + np.exp(-z)) - y) * share
            slope = np.bincount(flat, (error * scale)[owner], BUCKETS) + ridge * self.weights
            speed = 0.9 * speed - rate * slope
            speed_bias = 0.9 * speed_bias - 0.1 * rate * error.sum()
            self.weights += speed
            self.bias += speed_bias

    def score(self, url: Url) -> float:
        found = grams(url)
        z = self.weights[found].sum() / math.sqrt(max(1, len(found))) + self.bias
        return 1 / (1 + math.exp(-z))


def labelled_urls(df: DataFrame, url_col: str = "url", label_col: str = "label", most: int = MAX_LABELLED) -> list[tuple[str, int]]:
    """A training list from a table, at most ``most`` rows by hash order."""
    rows = df.where(F.col(url_col).isNotNull() & F.col(label_col).isin(0, 1)).select(url_col, label_col)
    return [tuple(r) for r in rows.orderBy(F.xxhash64(url_col), url_col).limit(most).collect()]


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] | None = None,
    labelled: list[tuple[str, int]] | None = None, threshold: float = 0.5,
) -> DataFrame:
    """``(id_col, host, path, rule, verdict, score)`` per row; ``score`` is the model's chance that the URL is unwanted."""
    kind = pages.schema[id_col].dataType.simpleString()
    rules = RULES if rules is None else rules
    shared = pages.sparkSession.sparkContext.broadcast(UrlModel(LABELLED if labelled is None else labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            urls = [split_url(u) for u in batch.column(1).to_pylist()]
            fits = [fitting_rule(u, rules) for u in urls]
            scores = [model.score(u) for u in urls]
            verdicts = [f[1] if f else "block" if s >= threshold else "allow" for f, s in zip(fits, scores)]
            columns = [[u.host for u in urls], [u.path for u in urls], [f and f[0] for f in fits], verdicts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in columns], pa.array(scores, pa.float64())], names=[id_col, "host", "path", "rule", "verdict", "score"])

    return pages.select(id_col, url_col).mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, score double")


def op6_urls(pages: DataFrame) -> DataFrame:
    return judge_urls(pages)
