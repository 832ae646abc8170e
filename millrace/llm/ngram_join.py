"""N-gram Jaccard join: which texts have sets of word n-grams with a Jaccard similarity of at least `least`, exactly.

The result has one row for every document that has a link: (doc_id, class_id, n_links). A link joins two documents that are similar
enough. A class is a connected component of links, named by its smallest id; n_links is the number of links of the
document, so no link is lost though copies are never multiplied out into pairs. A document without links is a class of its own and has no row.

1. Every text becomes the set of hashes of its n-word windows. Hashes are sent to buckets, which learn how many sets have
   each; those of one set only can't be shared and are dropped, the others come back with a level, the logarithm of their
   number. So every set has a sorted array, rare grams first, and the number of its grams that no other set has.
2. Equal sets are one from here on, with the number of their documents.
3. Two sets that are similar enough share one of the first grams of either in that order (the prefix beyond which the
   similarity is out of reach; grams of one set only come first and need no tile). Sizes are cut into bands such that partners are in the same or the
   next band. A tile is a gram and a band: a set lives in its own band's tiles and visits those of the next one, with
   the shorter prefix that suffices for larger partners. A tile of more than `most` sets of 1024 grams is cut into blocks, and pairs of blocks meet in tiles of their own.
4. In a tile, pairs that share one of the two grams before this one have met there already; what remains of both arrays
   bounds the overlap of the others. Sets with partners go once to the tile in which they have them. There, hashed bitmaps bound the
   overlap from above (every bit that one set has and the other lacks stands for a gram that is not shared), and what the bound leaves is
   decided by intersecting the sorted arrays.
5. Links of equal sets are counted, those of different ones summed, and distributed union-find gives the classes.

Nothing is cut off: prefixes are whole, tiles of any size are processed, and there is no bound on partners.

Cases: a null or empty text, and one without words, has no grams and no links. A text of fewer than n words has one
gram. Rows whose id is null take no part. Several rows with the same id and equal sets count once; an id with different texts has a row for each
set, which are documents of their own. An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, col, components, fresh, lean, least_rows, table
from .vectext import WORD_BREAK, grams, mix, popcount_rows, slices, sorted_sets, words

N, LEAST, MOST, SHARD_BYTES = 3, 0.5, 4096, 4 << 20
_U = np.uint64
_LEVEL = _U(59)
_KEY = np.dtype([("tile", "<u8"), ("k", "<i8"), ("one", "<u8"), ("two", "<u8"), ("size", "<i4"), ("rest", "<i4"), ("role", "<i4"), ("level", "<i4")])


def needed(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """The smallest overlap with which sets of sizes a and b are similar enough."""
    return np.ceil(least / (1 + least) * (a + b) - 1e-9)


def prefix_length(size: int, least: float) -> int:
    """How many first grams a set needs so that every partner shares one; `least` of its size is the smallest overlap."""
    return size - math.ceil(least * size - 1e-9) + 1


def band_edges(least: float, largest: int) -> np.ndarray:
    """First sizes of bands such that the partners of a set are in its band or a neighbouring one."""
    edges = [1, 2]
    while edges[-1] <= largest:
        edges.append(max(edges[-1], math.floor((edges[-1] - 1) / least + 1e-9)) + 1)
    return np.array(edges)


def text_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in slices(column, lower=True):
        yield from sorted_sets(*grams(*words(data, offsets), n))


def fingerprint(values: np.ndarray) -> bytes:
    """128 bits of a set."""
    a, b = mix(values ^ _U(0x5851F42D4C957F2D)), mix(values + _U(0x14057B7EF767814F))
    return np.array([a.sum(dtype=np.uint64), b.sum(dtype=np.uint64)], np.uint64).tobytes()


def _head(kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    s, k, b, x, ids, texts, prints, sizes = zip(*rows) if rows else ((),) * 8
    return pa.record_batch(
        [pa.array(s, pa.int64()), pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(x, pa.binary()), pa.array(ids, pa.list_(kind)), pa.array(texts, pa.list_(pa.int64())), pa.array(prints, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int32()))],
        names=["shard", "kind", "bucket", "blob", "ids", "texts", "prints", "sizes"],
    )


def _send(n: int, buckets: int, most: int):
    """Texts to shards. kind 0: what a shard's sets are called; kind 1: hashes for a bucket, 40 bits each, with the set's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, size = TaskContext.get().partitionId() << 32, 0, 0
        held: list[tuple] = []

        def close(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            shard = task + number
            ids, texts, sets = zip(*held)
            lengths = np.array([len(s) for s in sets])
            yield _head(kind, [(shard, 0, shard % buckets, None, list(ids), list(texts), [fingerprint(s) for s in sets], lengths.tolist())])
            h, at = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), lengths)
            bucket = ((h >> _U(32)) * _U(buckets)) >> _U(32)
            order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            h, at = h[order], at[order]
            low, high = h.astype(np.uint32), (h >> _U(32)).astype(np.uint8)
            rows = [(shard, 1, b, low[(s := slice(cuts[b], cuts[b + 1]))].tobytes() + at[s].tobytes() + high[s].tobytes(), None, None, None, None) for b in np.flatnonzero(np.diff(cuts)).tolist()]
            for cut in range(0, len(rows), 4096):
                yield _head(kind, rows[cut : cut + 4096])

        kind = pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            keys = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())
            for (i, t), values, length in zip(keys, text_sets(batch.column(1), n), pc.binary_length(batch.column(1)).to_pylist()):
                if len(values):
                    held.append((i, t, values))
                    size += length
                    if size >= most or len(held) == 1 << 16:
                        yield from close(kind)
                        number, held, size = number + 1, [], 0
        if held:
            yield from close(kind)

    return run


def _level(bucket: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """What shards sent to a bucket, to what they get back: grams of several sets, with the level as their first bits."""
    sizes = np.array([len(x) // 7 for _, x in rows])
    value = np.concatenate([np.frombuffer(x, np.uint32, k).astype(np.uint64) | np.frombuffer(x, np.uint8, k, 6 * k).astype(np.uint64) << _U(32) for (_, x), k in zip(rows, sizes.tolist())])
    at = np.concatenate([np.frombuffer(x, np.uint16, k, 4 * k) for (_, x), k in zip(rows, sizes.tolist())])
    order = np.argsort(value)
    ordered = value[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(order)))
    level = np.ceil(np.log2(count)).astype(np.uint64).clip(0, 31)
    out = np.empty(len(order), np.uint64)
    out[order] = np.repeat(level, count) << _LEVEL | _U(bucket) << _U(40) | ordered
    ends = np.cumsum(sizes)
    for (shard, _), end, size in zip(rows, ends.tolist(), sizes.tolist()):
        own, number = out[end - size : end], at[end - size : end]
        good = own >> _LEVEL > 0
        yield shard, own[good].tobytes() + number[good].tobytes()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: names of sets pass, hashes are counted bucket by bucket."""
    now, held, kind = None, [], pa.int64()

    def flush() -> pa.RecordBatch:
        return _head(kind, [(s, 1, now, x, None, None, None, None) for s, x in _level(now, held)])

    for batch in batches:
        kind = batch.column(4).type.value_type
        names = batch.filter(pc.equal(batch.column(1), 0))
        if names.num_rows:
            yield names
        hashes = batch.filter(pc.equal(batch.column(1), 1))
        for s, b, x in zip(*(hashes.column(i).to_pylist() for i in (0, 2, 3))):
            if b != now:
                if held:
                    yield flush()
                now, held = b, []
            held.append((s, x))
    if held:
        yield flush()


def _gather(least: float):
    """Rows sorted by shard and kind, to one row for each set; its array only if it can have partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "text", "print", "size", "alone", "grams"]

        def flush(own: pa.RecordBatch, blobs: list[bytes]) -> pa.RecordBatch:
            size = own.column(7)[0].values.to_numpy()
            counts = [len(x) // 10 for x in blobs]
            g = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64, k) for x, k in zip(blobs, counts)]])
            at = np.concatenate([np.zeros(0, np.uint16), *[np.frombuffer(x, np.uint16, k, 8 * k) for x, k in zip(blobs, counts)]])
            order = np.lexsort((g, at))
            g, cuts = g[order], np.searchsorted(at[order], np.arange(len(size) + 1))
            alone = size - np.diff(cuts)
            keep = np.array([prefix_length(s, least) for s in size.tolist()])
            arrays = [g[cuts[k] : cuts[k + 1]].tobytes() if keep[k] > alone[k] else None for k in range(len(size))]
            return pa.record_batch([own.column(4)[0].values, own.column(5)[0].values, own.column(6)[0].values, pa.array(size), pa.array(alone.astype(np.int32)), pa.array(arrays, pa.binary())], names=names)

        now, own, blobs = None, None, []
        for batch in batches:
            for i, (s, kind, x) in enumerate(zip(*(batch.column(j).to_pylist() for j in (0, 1, 3)))):
                if s != now:
                    if own is not None:
                        yield flush(own, blobs)
                    now, own, blobs = s, None, []
                if kind:
                    blobs.append(x)
                else:
                    own = batch.slice(i, 1)
        if own is not None:
            yield flush(own, blobs)

    return run


def _tiles(least: float, largest: int):
    """Sets to the rows of their tiles. role: 0 lives there, 1 visits. one, two: the grams before this one; rest: how many come after it."""
    edges = band_edges(least, largest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, size, alone = (batch.column(i).to_numpy() for i in range(3))
            out = []
            for j, blob in enumerate(batch.column(3).to_pylist()):
                g, s = np.frombuffer(blob, np.uint64), int(size[j])
                band = int(np.searchsorted(edges, s, "right"))
                for role, share in ((0, least), (1, 2 * least / (1 + least))):
                    count = min(prefix_length(s, share) - int(alone[j]), len(g))
                    if count <= 0:
                        continue
                    rows = np.zeros(count, _KEY)
                    rows["tile"] = mix(g[:count] * _U(0x9E3779B97F4A7C15) + _U(band + role))
                    rows["k"], rows["size"], rows["role"] = k[j], s, role
                    rows["one"][1:], rows["two"][2:] = g[: count - 1], g[: max(0, count - 2)]
                    rows["rest"] = len(g) - 1 - np.arange(count)
                    # the logarithm of a bound on what the tile holds, in sets of 1024 grams
                    rows["level"] = (g[:count] >> _LEVEL).astype(np.int32) + max(0, int(edges[min(band + role, len(edges) - 1)]).bit_length() - 10)
                    out.append(rows)
            rows = np.concatenate(out) if out else np.zeros(0, _KEY)
            for cut in range(0, len(rows), 1 << 16):
                r = rows[cut : cut + (1 << 16)]
                yield pa.record_batch([pa.array(np.ascontiguousarray(r[c]).view(np.int64 if r[c].dtype.itemsize == 8 else np.int32)) for c in _KEY.names], names=list(_KEY.names))

    return run


def pairs_of(r: dict[str, np.ndarray], least: float, most_pairs: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of whole tiles that can be similar enough and have not met in an earlier tile; r is sorted by tile and `one`."""
    n = len(r["tile"])
    new_tile = np.flatnonzero(np.diff(r["tile"], prepend=r["tile"][:1] - 1))
    tile_end = np.repeat(np.append(new_tile[1:], n), np.diff(np.append(new_tile, n)))
    # rows with the same gram before this one have met there
    change = (r["one"][1:] != r["one"][:-1]) | (r["tile"][1:] != r["tile"][:-1]) | (r["one"][1:] == 0)
    run = np.concatenate(([0], np.flatnonzero(change) + 1))
    run_end = np.repeat(np.append(run[1:], n), np.diff(np.append(run, n)))
    counts = tile_end - run_end
    before = np.concatenate(([0], np.cumsum(counts)))
    first = 0
    while first < n:
        stop = max(first + 1, int(np.searchsorted(before, before[first] + most_pairs, "right")) - 1)
        c = counts[first:stop]
        i = np.repeat(np.arange(first, stop), c)
        j = np.repeat(run_end[first:stop], c) + np.arange(len(i)) - np.repeat(before[first:stop] - before[first], c)
        first = stop
        if not len(i):
            continue
        # visitors don't meet each other, nor do rows of the same block where blocks meet (roles 2 and 4 for the first, 3 and 5 for the other)
        a, b = r["role"][i], r["role"][j]
        good = ((a & 1) + (b & 1) < 2) & ((a < 2) | (a >> 1 != b >> 1))
        i, j = i[good], j[good]
        overlap = 1 + np.minimum(r["rest"][i], r["rest"][j])
        good = overlap >= needed(r["size"][i], r["size"][j], least)
        i, j = i[good], j[good]
        one_i, two_i, one_j, two_j = r["one"][i], r["two"][i], r["one"][j], r["two"][j]
        met = ((one_i != 0) & ((one_i == one_j) | (one_i == two_j))) | ((two_i != 0) & ((two_i == one_j) | (two_i == two_j)))
        yield i[~met], j[~met]


def _meet(least: float):
    """Rows sorted by tile and `one`, to (left, right, tile) of what can be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(r: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for i, j in pairs_of(r, least):
                a, b = r["k"][i], r["k"][j]
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(r["tile"][i])], names=["left", "right", "tile"])

        names = [c for c in _KEY.names if c != "level"]
        held: list[dict] = []

        def joined() -> dict[str, np.ndarray]:
            return {c: np.concatenate([h[c] for h in held]) for c in names}

        for batch in batches:
            if not batch.num_rows:
                continue
            now = {c: batch.column(c).to_numpy() for c in names}
            if held and held[-1]["tile"][-1] != now["tile"][0]:
                yield from flush(joined())
                held = []
            cut = int(np.argmax(now["tile"] == now["tile"][-1]))  # the last tile may go on
            if cut:
                held.append({c: v[:cut] for c, v in now.items()})
                yield from flush(joined())
                held = []
            held.append({c: v[cut:] for c, v in now.items()})
        if held:
            yield from flush(joined())

    return run


def candidates(active: DataFrame, least: float, most: int, write: Written) -> DataFrame:
    """(left, right, tile): pairs of sets that can be similar enough, each once."""
    largest = active.agg(F.max("size")).first()[0] or 1
    kinds = ", ".join(f"{c} {'long' if _KEY[c].itemsize == 8 else 'int'}" for c in _KEY.names)
    rows = write(active.select("k", "size", "alone", "grams").mapInArrow(lean(_tiles(least, largest)), kinds))
    limit = int(math.log2(most))
    columns = [F.col(c) for c in _KEY.names if c not in ("tile", "role")]
    # only tiles of frequent grams can have more rows than `most`; a tile is counted, never gathered, before it is cut into blocks
    maybe = rows.where(F.col("level") > limit)
    load = F.sum(F.greatest("size", F.lit(1024)).cast("long")) / (1024 * most)
    hot = maybe.groupBy(F.col("tile").alias("t")).agg(F.ceil(load).cast("int").alias("blocks")).where("blocks > 1")
    hot = write(hot)
    found = maybe.join(hot, F.col("tile") == F.col("t"), "left")
    block = F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")
    cut = found.where("blocks is not null").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("tile", F.least("block", "other"), F.greatest("block", "other"))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 2).otherwise(4)
    cut = cut.select(pair.alias("tile"), (F.col("role") + side).alias("role"), *columns)
    whole = rows.where(F.col("level") <= limit).select("tile", "role", *columns).unionByName(found.where("blocks is null").select("tile", "role", *columns))
    met = whole.unionByName(cut).select(*_KEY.names).repartition("tile").sortWithinPartitions("tile", "one").mapInArrow(lean(_meet(least)), "left long, right long, tile long")
    out = write(met.groupBy("left", "right").agg(F.min("tile").alias("tile")))
    write.drop(rows, hot)
    return out


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A bitmap of each set, all of the same width: 2 bits or more a value."""
    width = max(64, 1 << (2 * max(map(len, sets)) - 1).bit_length())
    out = np.zeros((len(sets), width), np.uint8)
    out[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), (mix(np.concatenate(sets)) & _U(width - 1)).astype(np.int64)] = 1
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def shared_of(sets: list[np.ndarray], size: np.ndarray, bits: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """The overlap of each pair (a, b) of sets; 0 where the bitmaps already say that it is too small."""
    out = np.zeros(len(a), np.int64)
    need = needed(size[a], size[b], least)
    length = np.array([len(s) for s in sets])
    step = max(1, (1 << 20) // bits.shape[1])
    for cut in range(0, len(a), step):
        s = slice(cut, cut + step)
        x, y = bits[a[s]], bits[b[s]]
        most = np.minimum(length[a[s]] - popcount_rows(x & ~y), length[b[s]] - popcount_rows(y & ~x))
        out[s] = most >= need[s]
    left = np.flatnonzero(out)
    order = left[np.argsort(a[left], kind="stable")]
    cuts = np.flatnonzero(np.diff(a[order], prepend=-1))
    for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
        own = sets[a[order[x]]]
        for cut in range(x, y, 512):
            some = order[cut : min(cut + 512, y)]
            others = np.concatenate([sets[k] for k in b[some].tolist()])
            at = np.searchsorted(own, others)
            at[at == len(own)] = 0
            ends = np.concatenate(([0], np.cumsum(own[at] == others)))
            place = np.concatenate(([0], np.cumsum(length[b[some]])))
            out[some] = ends[place[1:]] - ends[place[:-1]]
    return np.where(out >= need, out, 0)


def verified(active: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(left, right, shared, jaccard) of those pairs that are similar enough. Sets meet in the tile that made the pair."""
    wanted = pairs.select("tile", F.col("left").alias("k")).unionAll(pairs.select("tile", F.col("right").alias("k"))).distinct()
    none = F.lit(None)
    sets = wanted.join(active.select("k", "size", "grams"), "k").select("tile", "k", none.cast("long").alias("other"), "size", "grams")
    both = sets.unionAll(pairs.select("tile", F.col("left").alias("k"), F.col("right").alias("other"), none.cast("int"), none.cast("binary")))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by tile, sets before pairs: the sets of one tile are held at a time
        now, number, sets, size, bits = None, {}, [], [], None
        for batch in batches:
            tiles, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            is_set = np.asarray(batch.column(2).is_null())
            cuts = np.flatnonzero((np.diff(tiles, prepend=tiles[:1] - 1) != 0) | np.diff(is_set, prepend=False))
            for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(tiles)]):
                if tiles[x] != now:
                    now, number, sets, size = tiles[x], {}, [], []
                if is_set[x]:
                    number |= zip(keys[x:y].tolist(), range(len(sets), len(sets) + y - x))
                    sets += [np.frombuffer(g, np.uint64) for g in batch.column(4).slice(x, y - x).to_pylist()]
                    size += batch.column(3).slice(x, y - x).to_pylist()
                    bits = None
                    continue
                bits = bitmaps(sets) if bits is None else bits
                other = batch.column(2).slice(x, y - x)
                a, b = (np.array([number[k] for k in ks]) for ks in (keys[x:y].tolist(), other.to_pylist()))
                sizes = np.array(size)
                shared = shared_of(sets, sizes, bits, a, b, least)
                good = np.flatnonzero(shared)
                similar = shared / (sizes[a] + sizes[b] - shared)
                yield pa.record_batch([pa.array(keys[x:y][good]), other.take(pa.array(good)), pa.array(shared[good].astype(np.int32)), pa.array(similar[good])], names=["left", "right", "shared", "jaccard"])

    return both.repartition("tile").sortWithinPartitions("tile", F.col("other").isNotNull()).mapInArrow(lean(compared), "left long, right long, shared int, jaccard double")


def similar_sets(docs: DataFrame, ident: str, text: str, n: int, least: float, most: int, write: Written, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, text, print) of every row with words; the distinct sets that can have partners (k, print, ...); the similar pairs of these."""
    if not 0 < least <= 1:
        raise ValueError("least is above 0 and 1 at most")
    spark = docs.sparkSession
    # several buckets for a task: a bucket is what it holds at a time
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(max(16, 4 * partitions), (1 << 19) - 1)
    kind = docs.schema[ident].dataType.simpleString()
    head = f"shard long, kind int, bucket int, blob binary, ids array<{kind}>, texts array<long>, prints array<binary>, sizes array<int>"
    rows = docs.where(col(ident).isNotNull() & col(text).isNotNull()).select(col(ident).alias("id"), col(text).alias("text"), F.xxhash64(col(text)).alias("hash"))
    sent = rows.mapInArrow(lean(_send(n, buckets, shard_bytes)), head).repartition(partitions, "bucket").sortWithinPartitions("bucket", "shard")
    back = sent.mapInArrow(lean(_count), head).repartition("shard").sortWithinPartitions("shard", "kind")
    found = write(back.mapInArrow(lean(_gather(least)), f"id {kind}, text long, print binary, size int, alone int, grams binary"))
    one = found.where("grams is not null").groupBy("print").agg(F.first(F.struct("size", "alone", "grams")).alias("s"))  # equal sets have equal ones
    active = write(one.select(F.monotonically_increasing_id().alias("k"), "print", "s.*"))
    return found, active, write(verified(active, candidates(active, least, most, write), least))


def classes(docs: DataFrame, ident: str, text: str, n: int, least: float, most: int, write: Written) -> DataFrame:
    """(id, text, repeats, class_id, n_links): one row for each id and text with words; repeats: how many rows have both."""
    found, active, pairs = similar_sets(docs, ident, text, n, least, most, write)
    documents = found.groupBy("print", "id").agg(F.count("*").alias("rows"))
    sets = write(documents.groupBy("print").agg(F.min("id").alias("first"), F.count("*").alias("n")).join(active.select("print", "k"), "print", "left"))
    both = pairs.select(F.col("left").alias("a"), F.col("right").alias("b")).unionAll(pairs.select("right", "left"))
    links = both.join(sets.where("k is not null").select(F.col("k").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("linked"))
    roots = write(components(docs.sparkSession, pairs.select(F.col("left").alias("a"), F.col("right").alias("b")), write))
    named = sets.join(roots, sets.k == roots.node, "left").join(links, sets.k == links.a, "left")
    smallest = named.where("root is not null").groupBy(F.col("root").alias("r")).agg(F.min("first").alias("least_id"))
    named = write(named.join(smallest, F.col("root") == F.col("r"), "left").select("print", F.coalesce("least_id", "first").alias("class_id"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")))
    return found.groupBy("id", "text", "print").agg(F.count("*").alias("repeats")).join(named, "print").select("id", "text", "print", "repeats", "class_id", "n_links")


def ngram_join(docs: DataFrame, ident: str = "doc_id", text: str = "text", n: int = N, least: float = LEAST, most: int = MOST) -> DataFrame:
    """(doc_id, class_id, n_links) of all documents that have a link."""
    found = classes(docs, ident, text, n, least, most, Written(docs.sparkSession, "ngram-join"))
    return found.where("n_links > 0").select(F.col("id").alias("doc_id"), "class_id", "n_links", "print").distinct().drop("print")


def ngram_pairs(docs: DataFrame, ident: str = "doc_id", text: str = "text", n: int = N, least: float = LEAST, most: int = MOST) -> DataFrame:
    """(left_print, right_print, jaccard) of the different sets that are similar enough, each named by its fingerprint()."""
    _, active, pairs = similar_sets(docs, ident, text, n, least, most, Written(docs.sparkSession, "ngram-pairs"))
    a, b = (active.select(F.col("k").alias(k), F.col("print").alias(p)) for k, p in (("left", "left_print"), ("right", "right_print")))
    return pairs.join(a, "left").join(b, "right").select("left_print", "right_print", "jaccard")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with near or exact copies: its class and the number of documents like it."""
    return ngram_join(table(spark, sf_dir, "documents"))


OP1_SQL = f"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(lower(text), '{WORD_BREAK}'), lambda x: x <> '') as t
  from documents where doc_id is not null and text is not null),
g as (
  select distinct doc_id, unnest(case when len(t) = 0 then [] when len(t) < {N} then [array_to_string(t, ' ')]
    else list_transform(range(1, len(t) - {N} + 2), lambda i: array_to_string(list_slice(t, i, i + {N} - 1), ' ')) end) as gram
  from w),
s as (select doc_id, count(*) as size from g group by doc_id),
m as (select a.doc_id as l, b.doc_id as r, count(*) as shared from g a join g b on a.gram = b.gram and a.doc_id <> b.doc_id group by 1, 2),
p as (select l, r from m join s x on x.doc_id = l join s y on y.doc_id = r where shared::double / (x.size + y.size - shared) >= {LEAST}),
c(node, reached) as (select l, r from p union select c.node, p.r from c join p on p.l = c.reached)
select p.l as doc_id, any_value(k.class_id) as class_id, count(*) as n_links
from p join (select node, least(node, min(reached)) as class_id from c group by node) k on k.node = p.l group by p.l
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest doc_id.

    Documents without words, and those without an id, are no copies of anything and stay. Of several different texts
    of the smallest id the set of smallest fingerprint stays, and of rows with the same id and text the least by all their columns."""
    keep = docs.columns
    write = Written(spark, "near-copies")
    found = write(classes(docs, "doc_id", "text", N, LEAST, MOST, write))
    texts = found.where("id = class_id").groupBy("class_id").agg(F.min(F.struct("print", "text")).alias("best"))
    # what isn't the one of its class, or is there several times; all others need no look
    marked = found.join(texts.select(F.col("class_id").alias("c"), F.col("best.print").alias("p"), F.col("best.text").alias("t")), F.col("class_id") == F.col("c"), "left")
    one = (F.col("id") == F.col("class_id")) & (F.col("print") == F.col("p")) & (F.col("text") == F.col("t"))
    decided = write(marked.select("id", "text", one.alias("stays"), "repeats").where("not stays or repeats > 1"))
    i, t, s, r, h = (fresh(keep, x) for x in ("found_id", "found_text", "it_stays", "its_repeats", "text_hash"))
    joined = docs.withColumn(h, F.xxhash64(col("text"))).join(decided.toDF(i, t, s, r), (col("doc_id") == col(i)) & (col(h) == col(t)), "left")
    repeated = least_rows(joined.where(col(s)).select(*[col(c) for c in keep], col(h)), ["doc_id", h], keep)
    return joined.where(col(s).isNull()).select(*[col(c) for c in keep]).unionAll(repeated)
