"""A filter of addresses: logistic regression on hashed character n-grams of host and path.

Features: every run of 3, 4 and 5 bytes of the lower-cased host (with a boundary mark at both ends and at its dots as they stand) and
of the path, the two in hash spaces of their own, as counts divided by the root of the number of n-grams. The scheme, a leading
`www.` or `m.`, the port, the query and the fragment are no features. The model is fitted on the driver from a small
labelled table by accelerated gradient descent with a quadratic penalty; its weights are one array of fixed size.

The table of labels is a parameter, as rows, a table (labels_of) or a file (read_labels). LABELLED, the default, is drawn from two lists of common words, of
ordinary sites and of sites for gambling, adult matter, counterfeit medicine, link farms and stolen software.

Cases: a null or empty address has a null score and is not blocked. Addresses without a scheme are read as host and
path. Very long ones are scored whole. Repeated rows are scored alike. An empty table gives an empty result; a table of labels of only one
class, or none, gives a constant score. Other columns are carried along; score and blocked are renamed with leading underscores if they are there.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, lean, table
from .vectext import BYTE_CODE, mix, slices

SIZES, BITS, THRESHOLD, MOST_LABELS = (3, 4, 5), 16, 0.5, 20_000

_WORDS = {
    1: "casino slots jackpot poker roulette betting bookmaker wager blackjack bingo porn xxx nude escort webcam-girls sex adult-video hardcore viagra cialis pills steroids diet-pills pharmacy-cheap spam "
    "link-farm spam-farm seo-links backlinks warez keygen crack serial-keys torrent nulled payday-loan fast-cash replica-watch fake-bags free-money get-rich lottery-winner".split(),
    0: "library news garden museum school university hospital weather recipe travel history science music theatre football chess bakery farm book gallery council doctor village repair winter homes writer "
    "software archive register bank hall law physics notes wiki photo train ocean atlas tea energy maps language guide film poetry market bicycle kitchen forest river mountain harbour castle market-hall journal".split(),
}
_MORE = "my the best city daily online free top big local blue new old green world net club home web".split()
_PATHS = {1: ["", "", "/win", "/bonus/join", "/free/offer", "/cheap/order"], 0: ["", "", "/about", "/news/item", "/contact", "/articles/list"]}
_ENDS = ["com", "org", "net", "info", "co.uk", "io"]


def made_up(number: int = 1600, seed: int = 5) -> list[tuple[str, int]]:
    """Addresses drawn from two lists of words. Both classes have the same further words, numbers, suffixes and schemes, and names of random letters,
    so that none of these speaks for either; one row of three is blocked, as a name of which nothing is known is more likely good."""
    rng = random.Random(seed)
    out = []
    for i in range(number):
        label = int(i % 3 == 0)
        letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 10)))
        word, more = rng.choice(_WORDS[label]), rng.choice([*_MORE, letters])
        name = rng.choice([word, f"{more}-{word}", f"{word}-{more}", more + word, word + more] if label else [word, f"{more}-{word}", f"{word}{more}", letters, f"{letters}-{more}"])
        lead = rng.choice(["", "", "www.", "m.", "blog."])
        number_ = rng.choice(["", "", f"/{rng.randrange(1000)}"])
        out.append((f"http{rng.choice(['', 's'])}://{lead}{name}.{rng.choice(_ENDS)}{rng.choice(_PATHS[label])}{number_}", label))
    return out


#: (address, 1 if it is to be blocked)
LABELLED = made_up()


def read_labels(path: str) -> list[tuple[str, int]]:
    """A file of lines `address<tab>label`, a small table that the driver reads whole."""
    with open(path, encoding="utf-8") as lines:
        rows = [x.rstrip("\n").rsplit("\t", 1) for x in lines if "\t" in x]
    return [(u, int(label)) for u, label in rows][:MOST_LABELS]


def parts(url: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Host with marks at its ends, and path, of lower-cased addresses; null is empty."""
    text = pc.utf8_lower(pc.fill_null(url.cast(pa.large_string()), ""))
    found = pc.extract_regex(text, r"(?s)^(?:[a-z][a-z0-9+.\-]*://|//)?(?:[^/?#@]*@)?(?:(?:www|m)\.)?(?P<host>[^/?#:]*)(?::[0-9]*)?(?P<path>[^?#]*)")
    host, path = (pc.fill_null(found.field(k), "").cast(pa.large_string()) for k in (0, 1))
    mark = lambda c: pa.scalar(c, pa.large_string())
    return pc.binary_join_element_wise(mark("^"), host, mark("$"), mark("")), path


def hashed(column: pa.Array, bits: int, salt: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each n-gram, bucket of each n-gram)."""
    for at, rows, data, offsets in slices(column):
        row_of = np.repeat(np.arange(rows), np.diff(offsets))
        out_rows, out = [], []
        h = np.zeros(len(data), np.uint64)
        for n in range(1, max(SIZES) + 1):
            last = len(data) - n + 1
            if last <= 0:
                break
            h = h[:last] * np.uint64(0x9E3779B97F4A7C15) + BYTE_CODE[data[n - 1 :]]
            if n in SIZES:
                same = row_of[:last] == row_of[n - 1 :]
                out_rows.append(row_of[:last][same])
                out.append((mix(h[same] + np.uint64(salt * 0x51ED270B + n)) >> np.uint64(64 - bits)).astype(np.int64))
        yield at, rows, np.concatenate(out_rows) if out_rows else np.zeros(0, np.int64), np.concatenate(out) if out else np.zeros(0, np.int64)


def margins(url: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The score before the logistic function, without the intercept."""
    half, total, count = len(weights) // 2, np.zeros(len(url)), np.zeros(len(url))
    bits = half.bit_length() - 1
    for salt, column in enumerate(parts(url)):
        for at, rows, row, bucket in hashed(column, bits, salt):
            total[at : at + rows] += np.bincount(row, weights[bucket + salt * half], minlength=rows)
            count[at : at + rows] += np.bincount(row, minlength=rows)
    return total / np.sqrt(np.maximum(count, 1))


def fit(rows: list[tuple[str, int]], bits: int = BITS, penalty: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights (host, then path) and intercept."""
    urls, y = pa.array([u for u, _ in rows], pa.large_string()), np.array([label for _, label in rows], float)
    half = 1 << bits
    if len(rows) == 0 or y.min() == y.max():
        return np.zeros(2 * half), 0.0 if len(rows) == 0 else (5.0 if y[0] else -5.0)
    r, c = [], []
    for salt, column in enumerate(parts(urls)):
        for at, _, row, bucket in hashed(column, bits, salt):
            r.append(row + at)
            c.append(bucket + salt * half)
    r, c = np.concatenate(r), np.concatenate(c)
    used, c = np.unique(c, return_inverse=True)
    x = 1 / np.sqrt(np.bincount(r, minlength=len(y)))[r]
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    # Nesterov's method; no row's squared norm exceeds its number of repeats of one n-gram, so the bound is computed
    norm = np.bincount(r, np.bincount(c)[c] * x * x, minlength=len(y)).max() + 1
    rate = 1 / (0.25 * norm * balance.max() * 4 + penalty)
    w = v = np.zeros(len(used))
    b = vb = 0.0
    for k in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(r, v[c] * x, minlength=len(y)) + vb)))
        g = (p - y) * balance
        new, new_b = v - rate * (np.bincount(c, g[r] * x, minlength=len(used)) + penalty * v / len(y)), vb - rate * g.sum()
        v, vb = new + k / (k + 3) * (new - w), new_b + k / (k + 3) * (new_b - b)
        w, b = new, new_b
    weights = np.zeros(2 * half)
    weights[used] = w
    return weights, float(b)


def labels_of(labelled: DataFrame, url: str, label: str, most: int = MOST_LABELS) -> list[tuple[str, int]]:
    """At most `most` labelled rows, those of smallest hash, for fit()."""
    rows = labelled.where(col(url).isNotNull() & col(label).isNotNull()).select(col(url).alias("u"), (col(label) > 0).cast("int").alias("y")).distinct()
    return [(r.u, r.y) for r in rows.orderBy(F.xxhash64("u"), "u", "y").limit(most).collect()]


def url_filter(df: DataFrame, labelled: list[tuple[str, int]] = LABELLED, url: str = "url", threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """df with score (how surely the address is to be blocked) and blocked."""
    weights, intercept = fit(labelled, bits)
    score, blocked, at = fresh(df.columns, "score"), fresh(df.columns, "blocked"), df.columns.index(url)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            address = batch.column(at)
            p = 1 / (1 + np.exp(-(margins(address, weights) + intercept)))
            none = np.asarray(pc.fill_null(pc.equal(pc.binary_length(address), 0), True))
            columns = [pa.array(np.round(p, 6), mask=none), pa.array((p >= threshold) & ~none)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, score, blocked])

    return df.mapInArrow(lean(scored), T.StructType([*df.schema.fields, T.StructField(score, T.DoubleType(), True), T.StructField(blocked, T.BooleanType(), True)]))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's address with its score."""
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"))
