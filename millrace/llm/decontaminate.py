"""Benchmark decontamination by latent semantic retrieval with checks on word order and answers.

1. Texts become sequences of 32-bit word hashes. All words of the corpus have a column, of 2**16 hashed ones; document frequencies of
   columns, and of the benchmark's words apart, are counted over all documents in the same pass.
2. Passages are the successive 64-word cuts of all documents, as TF-IDF rows of a matrix A. Its right singular vectors and
   values come from a randomised decomposition in one further pass: every partition adds its share of Y = A'(A G) for
   a Gaussian matrix G; the shares are summed in blocks of columns, and the Nystroem formula gives the factors from Y and G.
   What reaches the driver is Y, columns times `rank` numbers, whatever the size of the corpus.
3. At every eighth word a window begins, of twice to about four times an item's length. An inverted index of the items' rarer words gives
   the windows that hold enough of one of them; no other window could pass the checks, and items that share no such word with a window cost nothing.
   Where all of the item's words in the window could weigh a share of `weak`, it is a candidate. Where they could weigh `loose`, it is one
   if its cosine with the item in the latent space is at least `near`: latent vectors are scaled by the inverse singular values, so that frequent
   words don't drown the others, and words outside the benchmark count by the company they keep.
4. A candidate is verified by the heaviest common subsequence, each word weighing its inverse document frequency. A share of `strong` of the
   item's weight is a leak; a share from `weak` on is one if `answer_share` of the answer's weight is found in order too; and a share from `loose` on,
   a paraphrase, if besides the answer the cosine is at least `near`. The answer is a column of the benchmark; where it
   is missing or null, the last quarter of the item's words stands for it.

Cases: a null or empty text leaks nothing and is kept; an item without words matches nothing. Items that are alike are each
reported. Rows with a null id take part and are reported with a null id; several rows of one id are reported once with their best share. Texts and items are
read whole, whatever their length. An empty benchmark or an empty table gives no leaks. The driver reads the benchmark, whose size is checked first; one of
more than MOST_BENCHMARK bytes is an error and to be given in parts. Further columns are carried along by the stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Written, col, fresh, lean, table
from .vectext import slices, words

RANK, NEAR, STRONG, WEAK, LOOSE, ANSWER_SHARE = 32, 0.6, 0.6, 0.4, 0.25, 0.75
BLOCK, PASSAGE, COLUMNS, HEAD, MOST_BENCHMARK = 8, 64, 1 << 16, 0.1, 256 << 20


@dataclass(frozen=True)
class Items:
    """The benchmark: sorted word hashes of its vocabulary, and each item's words and answer's words as places in it."""

    ids: list
    vocabulary: np.ndarray
    terms: list[np.ndarray]
    answers: list[np.ndarray]

    @property
    def lookup(self) -> tuple[np.ndarray, int]:
        """A table from the low bits of word hashes to terms, sparse enough for few to share a place."""
        bits = max(12, int(8 * len(self.vocabulary)).bit_length())
        at = np.full(1 << bits, len(self.vocabulary), np.int64)
        at[(self.vocabulary & np.uint32((1 << bits) - 1)).astype(np.int64)] = np.arange(len(self.vocabulary))
        return at, bits


def hashes_of(texts: list[str | None]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, n, h, bounds in sequences(pa.array(texts, pa.large_string())):
        out += [h[bounds[i] : bounds[i + 1]] for i in range(n)]
    return out


def read_items(benchmark: DataFrame, ident: str = "item_id", text: str = "text", answer: str = "answer") -> Items:
    """The benchmark is a table of questions, which is small beside any corpus; its size is checked before the driver reads it."""
    has = answer in benchmark.columns
    rows = benchmark.select(col(ident).alias("i"), col(text).cast("string").alias("t"), (col(answer).cast("string") if has else F.lit(None).cast("string")).alias("a"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + F.coalesce(F.octet_length("a"), F.lit(0)) + 64)).first()[0] or 0
    if size > MOST_BENCHMARK:
        raise ValueError(f"the benchmark has {size} bytes, more than {MOST_BENCHMARK}: give it in parts")
    rows = rows.collect()
    items, answers = hashes_of([r.t for r in rows]), hashes_of([r.a for r in rows])
    every = np.unique(np.concatenate([np.zeros(0, np.uint32), *items, *answers]))
    terms = [np.searchsorted(every, x) for x in items]
    own = [np.searchsorted(every, a) if len(a) else t[len(t) - len(t) // 4 :] for a, t in zip(answers, terms)]
    return Items([r.i for r in rows], every, terms, own)


def terms_of(hashes: np.ndarray, items: Items, lookup: tuple[np.ndarray, int]) -> np.ndarray:
    """The term of each word; the vocabulary's size for words outside it."""
    at, bits = lookup
    n = len(items.vocabulary)
    if not n:
        return np.zeros(len(hashes), np.int64)
    out = at[(hashes & np.uint32((1 << bits) - 1)).astype(np.int64)]
    wrong = np.flatnonzero((out < n) & (items.vocabulary[np.minimum(out, n - 1)] != hashes))
    if len(wrong):  # words that share a place of the table
        found = np.searchsorted(items.vocabulary, hashes[wrong])
        out[wrong] = np.where(items.vocabulary[np.minimum(found, n - 1)] == hashes[wrong], found, n)
    return out


def columns_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint32(COLUMNS - 1)).astype(np.int64)


def sequences(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, word hashes, bounds) of texts."""
    for at, n, data, offsets in slices(column, lower=True):
        h, bounds = words(data, offsets)
        yield at, n, (h >> np.uint64(32)).astype(np.uint32), bounds


def _read(items: Items):
    """Texts to rows (id, hashes) and, once for each task, the document frequencies of columns (kind 1) and terms (kind 2), with the number of texts last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, n, kind, size = items.lookup, 0, None, len(items.vocabulary)
        columns, terms = np.zeros(COLUMNS, np.int64), np.zeros(size + 1, np.int64)
        names = ["id", "kind", "blob"]
        for batch in batches:
            kind = batch.column(0).type
            for at, rows, h, bounds in sequences(batch.column(1)):
                both = np.repeat(np.arange(rows, dtype=np.uint64) << np.uint64(32), np.diff(bounds)) | h
                both.sort()
                once = both[np.concatenate(([True], both[1:] != both[:-1]))].astype(np.uint32) if len(both) else h
                columns += np.bincount(columns_of(once), minlength=COLUMNS)
                terms += np.bincount(terms_of(once, items, lookup), minlength=size + 1)
                n += rows
                blobs = [h[bounds[i] : bounds[i + 1]].tobytes() for i in range(rows)]
                yield pa.record_batch([batch.column(0).slice(at, rows), pa.array(np.zeros(rows, np.int32)), pa.array(blobs, pa.binary())], names=names)
        if n:
            terms[size] = n
            yield pa.record_batch([pa.nulls(2, kind), pa.array([1, 2], pa.int32()), pa.array([columns.astype(np.int32).tobytes(), terms.tobytes()], pa.binary())], names=names)

    return run


def summed(shares: DataFrame, dtype: str, write: Written) -> dict[int, np.ndarray]:
    """Rows (part, blob) to the sum of each part's arrays: within partitions, then in up to 1024 groups of these, then by part, which is one row for the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(blob, dtype)
                total[p] = total[p] + x if p in total else x.copy()
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "blob"])

    first = shares.mapInArrow(lean(add), "part int, blob binary")  # what a partition has is summed before it is sent
    groups = first.withColumn("of", F.spark_partition_id() % 1024).repartition("part", "of").select("part", "blob").mapInArrow(lean(add), "part int, blob binary")
    with write.settings():
        return {r.part: np.frombuffer(r.blob, dtype) for r in groups.repartition("part").mapInArrow(lean(add), "part int, blob binary").collect()}


def joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(blobs), np.uint32), np.concatenate(([0], np.cumsum([len(x) // 4 for x in blobs])))


def groups(blobs: list[bytes], most: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Runs of blobs of about `most` bytes."""
    ends = np.cumsum([len(x) for x in blobs])
    at = 0
    while at < len(blobs):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, stop
        at = stop


def gaussian(size: int, rank: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((size, rank)).astype(np.float32)


def passage_share(t: np.ndarray, bounds: np.ndarray, idf: np.ndarray, g: np.ndarray, into: np.ndarray) -> None:
    """Adds A'(A G) of these texts, given as columns, to `into`. A passage's row has length 1."""
    if not len(t):
        return
    size = len(idf)
    at = np.arange(len(t)) - np.repeat(bounds[:-1], np.diff(bounds))
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    new = np.ones(len(t), bool)
    p = at // PASSAGE
    new[1:] = (p[1:] != p[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    passage = np.cumsum(new) - 1
    # the length of a row needs its counts of each column
    pair, n = np.unique(passage * size + t, return_counts=True)
    norm = np.sqrt(np.bincount(pair // size, (n * idf[pair % size]) ** 2, minlength=len(first)))
    weight = (idf[t] / np.maximum(norm[passage], 1e-9)).astype(np.float32)
    z = np.add.reduceat(g[t] * weight[:, None], first, axis=0)
    order = np.argsort(t.astype(np.uint16), kind="stable")
    sorted_ = t[order]
    cuts = np.flatnonzero(np.diff(sorted_, prepend=-1))
    into[sorted_[cuts]] += np.add.reduceat(z[passage[order]] * weight[order][:, None], cuts, axis=0)


def _share(idf: np.ndarray, rank: int, block: int = 4096):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = gaussian(len(idf), rank)
        y = np.zeros(g.shape, np.float32)
        for batch in batches:
            blobs = batch.column(0).to_pylist()
            for a, b in groups(blobs):
                h, bounds = joined(blobs[a:b])
                passage_share(columns_of(h), bounds, idf, g, y)
        parts = range(0, len(idf), block)
        yield pa.record_batch([pa.array([p // block for p in parts], pa.int32()), pa.array([y[p : p + block].tobytes() for p in parts], pa.binary())], names=["part", "blob"])

    return run


def factors(y: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Terms x rank: right singular vectors over singular values, from Y = A'A G by the Nystroem formula."""
    shift = 1e-6 * np.linalg.norm(y) + 1e-12
    y = y + shift * g
    u, s, vt = np.linalg.svd((g.T @ y + y.T @ g) / 2)
    ok = s > 1e-10 * s[0]
    f = y @ (vt[ok].T / np.sqrt(s[ok]))
    left, values, _ = np.linalg.svd(f, full_matrices=False)
    ok = values > 1e-4 * values[0]
    return (left[:, ok] / values[ok]).astype(np.float32)


class Search:
    """Candidates by rare words and cosine, and their verification, for sequences of word hashes."""

    def __init__(self, items: Items, term_idf: np.ndarray, idf: np.ndarray, latent: np.ndarray, near: float, strong: float, weak: float, loose: float, answer_share: float):
        self.items, self.near, self.strong, self.weak, self.loose, self.answer_share = items, near, strong, weak, min(loose, weak), answer_share
        self.size, self.lookup = len(items.vocabulary), items.lookup
        self.map = latent * idf[:, None].astype(np.float32)
        self.weight = np.append(term_idf, 0.0).astype(np.float32)
        own = [k for k, t in enumerate(items.terms) if len(t)]
        self.width, self.total, self.least = (np.zeros(len(items.terms), t) for t in (np.int64, np.float64, np.float64))
        terms, of = [], []
        for k in own:
            t = items.terms[k]
            blocks = 2
            while blocks * BLOCK < len(t) + BLOCK - 1:
                blocks *= 2
            self.width[k], self.total[k] = blocks, self.weight[t].sum(dtype=np.float64)
            # the index has the rarer words; the others weigh no more than HEAD of the item together
            once, n = np.unique(t, return_counts=True)
            once = once[order := np.argsort(self.weight[once], kind="stable")]
            head = np.cumsum(self.weight[once] * n[order], dtype=np.float64) <= HEAD * self.total[k]
            self.least[k] = (self.loose - 1e-4) * self.total[k] - float((self.weight[once] * n[order])[head].sum())
            terms.append(once[~head])
            of.append(np.full(int((~head).sum()), k))
        terms, of = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (terms, of))
        order = np.argsort(terms, kind="stable")
        self.posting, self.begin = of[order], np.searchsorted(terms[order], np.arange(self.size + 2))
        self.widest = int(self.width.max(initial=0))
        self.query = np.zeros((len(items.terms), latent.shape[1]), np.float32)
        for k in own:
            q = self.map[columns_of(items.vocabulary[items.terms[k]])].sum(0)
            self.query[k] = q / max(float(np.linalg.norm(q)), 1e-12)
        self.scratch = np.zeros(self.size + 1, np.float32)

    def windows(self, flat: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, item) of the windows, begun at real blocks, that with the blocks around them hold enough of the item's indexed words."""
        n = self.begin[flat + 1] - self.begin[flat]
        at = np.flatnonzero(n)
        n = n[at]
        place = np.repeat(self.begin[flat[at]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        item, block = self.posting[place], np.repeat(at // BLOCK, n)
        blocks, none = len(flat) // BLOCK, np.zeros(0, np.int64)
        if not len(item):
            return none, none
        stride = blocks + 2 * self.widest + 8
        key = item * stride + block
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        sums = np.concatenate(([0.0], np.cumsum(np.add.reduceat(np.repeat(self.weight[flat[at]], n)[order].astype(np.float64), first))))
        key = key[first]
        item, block = key // stride, key % stride
        reach = self.width[item] + 2

        def held(begin: np.ndarray, reach: np.ndarray) -> np.ndarray:
            return sums[np.searchsorted(key, begin + reach)] - sums[np.searchsorted(key, begin)]

        hit = np.flatnonzero(held(key, reach) >= self.least[item])
        if not len(hit):
            return none, none
        # of the windows that begin with this block or before it, and have it in reach, those that hold enough
        back = np.repeat(reach[hit], reach[hit])
        step = np.arange(len(back)) - np.repeat(np.cumsum(reach[hit]) - reach[hit], reach[hit])
        begin = np.repeat(block[hit] + 1, reach[hit]) - step
        item = np.repeat(item[hit], reach[hit])
        ok = (begin >= 0) & (begin < blocks)
        ok[ok] = real[begin[ok]]
        once = np.unique(item[ok] * stride + begin[ok])
        item, begin = once // stride, once % stride
        good = held(np.maximum(once - 1, item * stride), self.width[item] + 2) >= self.least[item]
        return begin[good], item[good]

    def __call__(self, hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, float]]:
        """(text, item, share of the item's weight) of all leaks."""
        if not self.widest or not len(hashes):
            return []
        # texts in blocks of eight words, with empty blocks between them
        n = np.diff(bounds)
        blocks = (n + BLOCK - 1) // BLOCK
        gap = self.widest + 2
        begin = np.concatenate(([0], np.cumsum(blocks + gap)))
        place = np.repeat(begin[:-1] * BLOCK - bounds[:-1], n) + np.arange(len(hashes))
        flat = np.full(int(begin[-1]) * BLOCK, self.size, np.int64)
        flat[place] = terms_of(hashes, self.items, self.lookup)
        real = np.repeat(np.tile([True, False], len(n)), np.stack((blocks, np.full(len(n), gap)), 1).ravel())
        text_of = np.repeat(np.arange(len(n)), blocks + gap)
        block, item = self.windows(flat, real)
        if not len(block):
            return []
        column = np.full(len(flat), -1, np.int64)
        column[place] = columns_of(hashes)
        out: list[tuple[int, int, float]] = []
        cuts = np.flatnonzero(np.diff(item, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(item)]):
            for cut in range(a, b, 4096):
                out += self.verify(flat, column, block[cut : min(b, cut + 4096)], int(item[a]), text_of)
        return out

    def cosines(self, column: np.ndarray, block: np.ndarray, item: int) -> np.ndarray:
        """Of windows with the item, in the latent space."""
        places = block[:, None] * BLOCK + np.arange(int(self.width[item]) * BLOCK)
        own = column[np.minimum(places, len(column) - 1)]
        out = np.zeros(len(block))
        for k, c in enumerate(own):
            x = self.map[c[c >= 0]].sum(0)
            out[k] = float(x @ self.query[item]) / max(float(np.linalg.norm(x)), 1e-12)
        return out

    def verify(self, flat: np.ndarray, column: np.ndarray, block: np.ndarray, k: int, text_of: np.ndarray) -> list[tuple[int, int, float]]:
        """Windows that begin at these blocks against one item."""
        total = float(self.total[k])
        if total <= 0:
            return []
        places = block[:, None] * BLOCK + np.arange(-BLOCK, (int(self.width[k]) + 1) * BLOCK)
        near = np.where((places >= 0) & (places < len(flat)), flat[np.clip(places, 0, len(flat) - 1)], self.size)
        terms = self.items.terms[k]
        np.add.at(self.scratch, terms, self.weight[terms])
        ordered = np.sort(near, axis=1)
        once = np.ones(ordered.shape, bool)
        once[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        bound = (self.scratch[ordered] * once).sum(1) / total
        self.scratch[terms] = 0
        keep = bound >= self.loose - 1e-6
        block, near, bound = block[keep], near[keep], bound[keep]
        cosine = np.full(len(block), np.nan)
        below = np.flatnonzero(bound < self.weak - 1e-6)
        cosine[below] = self.cosines(column, block[below], k)
        go = ~(cosine < self.near)
        block, near, cosine = block[go], near[go], cosine[go]
        share = self.heaviest(near, terms) / total
        leak = share >= self.strong - 1e-6
        maybe = np.flatnonzero((share >= self.loose - 1e-6) & ~leak)
        answer = self.items.answers[k]
        whole = float(self.weight[answer].sum())
        if len(maybe) and whole > 0:
            maybe = maybe[self.heaviest(near[maybe], answer) >= (self.answer_share - 1e-6) * whole]
            far = maybe[(share[maybe] < self.weak - 1e-6) & np.isnan(cosine[maybe])]
            cosine[far] = self.cosines(column, block[far], k)
            leak[maybe] = (share[maybe] >= self.weak - 1e-6) | (cosine[maybe] >= self.near)
        return [(int(text_of[block[x]]), k, float(share[x])) for x in np.flatnonzero(leak)]

    def heaviest(self, near: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The weight of the heaviest common subsequence of the item with each row."""
        best = np.zeros((len(near), len(item) + 1), np.float32)
        w = self.weight[item]
        for j in range(near.shape[1]):
            word = near[:, j]
            if (word == self.size).all():
                continue
            step = np.maximum(best[:, 1:], np.where(word[:, None] == item, best[:, :-1] + w, 0))
            best[:, 1:] = np.maximum.accumulate(step, axis=1)
        return best[:, -1]


def inverse(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((n + 1) / (np.minimum(df, n) + 1)) + 0.05


def prepare(docs: DataFrame, items: Items, ident: str, text: str, rank: int, write: Written) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
    """The written sequences, and the inverse document frequencies of terms and columns with the latent map; None if there is nothing to search."""
    kind = docs.schema[ident].dataType.simpleString()
    size = len(items.vocabulary)
    if not size:
        return None
    made = write(docs.select(col(ident).alias("id"), col(text).alias("text")).mapInArrow(lean(_read(items)), f"id {kind}, kind int, blob binary"))
    one = F.lit(0).alias("part")
    counts = summed(made.where("kind = 2").select(one, "blob"), "int64", write)
    if not counts:
        return None
    n = int(counts[0][size])
    term_idf, idf = inverse(counts[0][:size], n), inverse(summed(made.where("kind = 1").select(one, "blob"), "int32", write)[0].astype(np.int64), n)
    shares = made.where("kind = 0").select("blob").mapInArrow(lean(_share(idf, rank)), "part int, blob binary")
    found = summed(shares, "float32", write)
    y = np.concatenate([found[k] for k in sorted(found)]).reshape(COLUMNS, rank).astype(np.float64)
    if not np.abs(y).max() > 0:
        return None
    return made.where("kind = 0").select("id", "blob"), (term_idf, idf, factors(y, gaussian(COLUMNS, rank).astype(np.float64)))


def leaks(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text", rank: int = RANK, near: float = NEAR, strong: float = STRONG, weak: float = WEAK, loose: float = LOOSE, answer_share: float = ANSWER_SHARE, item: str = "item_id") -> DataFrame:
    """(doc_id, item_id, share) of documents that hold a benchmark item."""
    spark = docs.sparkSession
    items = read_items(benchmark, item)
    kinds = docs.schema[ident].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, share double"
    write = Written(spark, "decontaminate")
    ready = prepare(docs, items, ident, text, rank, write)
    if ready is None:
        return spark.createDataFrame([], schema)
    rows, model = ready
    item_kind = to_arrow_type(benchmark.schema[item].dataType)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, *model, near, strong, weak, loose, answer_share)
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            for a, b in groups(blobs):
                best: dict[tuple[int, int], float] = {}
                for d, k, s in search(*joined(blobs[a:b])):
                    best[d + a, k] = max(s, best.get((d + a, k), 0.0))
                ids = [items.ids[k] for _, k in best]
                yield pa.record_batch([batch.column(0).take(pa.array([d for d, _ in best], pa.int64())), pa.array(ids, item_kind), pa.array(list(best.values()), pa.float64())], names=["doc_id", "item_id", "share"])

    out = write(rows.mapInArrow(lean(found), schema).groupBy("doc_id", "item_id").agg(F.round(F.max("share"), 4).alias("share")))
    write.drop_all_but(out)
    return out


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **more: float) -> DataFrame:
    """The documents that hold no benchmark item, whole. Leaks are searched in the written sequences, named by two hashes of the text; only these names meet the texts."""
    keep, write = docs.columns, Written(docs.sparkSession, "leaking-texts")
    names = F.concat_ws("/", F.xxhash64(col(text)).cast("string"), F.xxhash64(F.lit(1), col(text)).cast("string"))
    name, own = fresh(keep, "text_name"), fresh(keep, "leaking_name")
    found = leaks(docs.where(col(text).isNotNull()).select(names.alias("n"), col(text).alias("t")), benchmark, "n", "t", **more)
    out = write(found.select(F.col("doc_id").alias(own)).distinct())
    return docs.withColumn(name, names).join(out, col(name) == col(own), "left_anti").select(*[col(c) for c in keep])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))
