"""Exact k nearest binary codes by incremental multi-index hashing.

A vector's code has a bit for each component, set where the component is positive. Codes are cut into segments of
about log2(number of codes) bits. By the pigeonhole principle, two codes that differ in at most m * (r + 1) - 1 bits
agree up to r bits in one of their m segments. So all segments are searched with radius 0, 1, 2, ...; a query is
finished in the round in which the distance of its (k + 1)th best id, one of which is its own, is covered by that bound.

Equal codes are grouped first. A code is searched once for all vectors that have it, and no more than k + 1 of its
vectors (those of smallest id) can be in anyone's answer, so only these are kept with it: nothing is lost, and
thousands of equal codes cost no more than k + 1. What is listed for a query is k + 1 distinct ids, each with its
least distance, so that an id with many near codes takes one place only.

A round is one exchange: codes and the queries that are still open are sent to tiles, a tile being a segment and the
leading bits of its value. A query goes to the tiles whose leading bits differ in j <= r bits from its own, and is
met there by the codes whose remaining bits differ in exactly r - j. Every distance is computed on whole codes.

Cases: null vectors, empty ones and rows with a null id take no part. A vector is compared only with vectors of the same
length. Null components and NaN count as not positive. An id that occurs with several vectors counts with each; equal pairs of id and
code count once. A vector is no neighbour of its own id. Ties in distance go to the smaller id. Where fewer than k others exist, all
are returned. An empty table gives an empty result. Further columns are not read. Ids are whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, col, lean, table

K, LOW, QUERIES = 10, 12, 20


def segments(bits: int, codes: int) -> list[tuple[int, int]]:
    """Begin and end of each segment of codes of so many bits."""
    width = max(4, min(24, round(math.log2(max(codes, 2)))))
    m = max(1, round(bits / width))
    cuts = [round(i * bits / m) for i in range(m + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


@lru_cache(None)
def masks(width: int, weight: int) -> np.ndarray:
    """All numbers of `width` bits of which `weight` are set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), weight)], np.int64)


def words_of(codes: list[bytes]) -> np.ndarray:
    """Codes of one length as rows of 64-bit words."""
    size = len(codes[0])
    out = np.zeros((len(codes), (size + 7) // 8 * 8), np.uint8)
    out[:, :size] = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), size)
    return out.view(np.uint64)


def segment_values(words: np.ndarray, begin: int, end: int) -> np.ndarray:
    bits = np.unpackbits(words.view(np.uint8), axis=1)[:, begin:end].astype(np.int64)
    return bits @ (1 << np.arange(end - begin, dtype=np.int64))


def encode(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, bits, code) of rows that have an id and a vector with components."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            values = lists.values.slice(lists.offsets[0].as_py(), int(lengths.sum())) if len(lists) else lists.values
            positive = np.nan_to_num(np.asarray(values.to_numpy(zero_copy_only=False), np.float64)) > 0
            ends = np.concatenate(([0], np.cumsum(lengths)))
            codes = [np.packbits(positive[a:b]).tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.record_batch([batch.column(0), pa.array(lengths.astype(np.int32)), pa.array(codes, pa.binary())], names=["id", "bits", "code"])

    rows = df.where(col(ident).isNotNull() & col(vector).isNotNull() & (F.size(col(vector)) > 0)).select(col(ident).cast("long").alias("id"), F.transform(col(vector), lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("v"))
    return rows.mapInArrow(lean(coded), "id long, bits int, code binary")


def _send(cuts: dict[int, list[tuple[int, int]]], radius: int, low: int):
    """Rows (bits, number, code, bound, open) to tiles: those of ids once for each segment, open queries to all tiles in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, numbers = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            codes, bounds, open_ = batch.column(2).to_pylist(), batch.column(3).to_numpy(), np.array(batch.column(4).to_pylist(), bool)
            tiles, kinds, left, blobs = [], [], [], []
            for b in np.unique(bits):
                rows = np.flatnonzero(bits == b)
                words = words_of([codes[i] for i in rows.tolist()])
                packed = np.concatenate((numbers[rows].astype(np.int64)[:, None], bounds[rows].astype(np.int64)[:, None], words.view(np.int64)), axis=1)

                def put(tile: tuple[int, int], high: np.ndarray, of: np.ndarray, kind: int, weight: int) -> None:
                    order = np.argsort(high, kind="stable")
                    at = np.flatnonzero(np.diff(high[order], prepend=-1))
                    for x, y in zip(at.tolist(), [*at[1:].tolist(), len(order)]):
                        tiles.append(f"{tile[0]}/{tile[1]}/{high[order[x]]}")
                        kinds.append(kind)
                        left.append(weight)
                        blobs.append(packed[of[order[x:y]]].tobytes())

                for s, (begin, end) in enumerate(cuts[int(b)]):
                    near = min(low, end - begin)
                    far = end - begin - near
                    high = segment_values(words, begin, end) >> near
                    own = np.flatnonzero(~open_[rows])
                    put((int(b), s), high[own], own, 0, 0)
                    asks = np.flatnonzero(open_[rows])
                    for j in range(min(radius, far) + 1):
                        if radius - j <= near and len(asks):
                            for mask in masks(far, j).tolist():
                                put((int(b), s), high[asks] ^ mask, asks, 1, radius - j)
            yield pa.record_batch([pa.array(tiles, pa.string()), pa.array(kinds, pa.int32()), pa.array(left, pa.int32()), pa.array(blobs, pa.binary())], names=["tile", "kind", "weight", "blob"])

    return run


def best_of(q: np.ndarray, i: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (by least distance, then smaller id) distinct ids of each query."""
    order = np.lexsort((d, i, q))
    q, i, d = q[order], i[order], d[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
    q, i, d = q[new], i[new], d[new]
    order = np.lexsort((i, d, q))
    q, i, d = q[order], i[order], d[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], i[keep], d[keep]


def _meet(cuts: dict[int, list[tuple[int, int]]], low: int, k: int, most: int = 1 << 21):
    """Rows of tiles, ids before queries: (query, id, distance), the k best ids of each query in each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(tile: str, rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            bits, s, _ = map(int, tile.split("/"))
            begin, end = cuts[bits][s]
            near = min(low, end - begin)
            width = 2 + (((bits + 7) // 8) + 7) // 8

            def unpack(blobs: list[bytes]) -> np.ndarray:
                return np.frombuffer(b"".join(blobs), np.int64).reshape(-1, width)

            own = [x for kind, _, x in rows if not kind]
            asked = sorted({w for kind, w, _ in rows if kind})
            if not own or not asked:
                return
            codes = unpack(own)
            words = np.ascontiguousarray(codes[:, 2:]).view(np.uint64)
            key = segment_values(words, begin, end) & ((1 << near) - 1)
            order = np.argsort(key, kind="stable")
            ids, words = codes[order, 0], words[order]
            start = np.searchsorted(key[order], np.arange((1 << near) + 1))
            out: list[tuple[np.ndarray, ...]] = []
            held = 0
            for weight in asked:
                queries = unpack([x for kind, w, x in rows if kind and w == weight])
                asks = np.ascontiguousarray(queries[:, 2:]).view(np.uint64)
                at = segment_values(asks, begin, end) & ((1 << near) - 1)
                for mask in masks(near, weight).tolist():
                    x = at ^ mask
                    n = start[x + 1] - start[x]
                    full = np.flatnonzero(n)
                    sums = np.concatenate(([0], np.cumsum(n[full])))
                    done = 0
                    while done < len(full):
                        stop = max(done + 1, int(np.searchsorted(sums, sums[done] + most, "right")) - 1)
                        f = full[done:stop]
                        i = np.repeat(f, n[f])
                        j = np.arange(len(i)) + np.repeat(start[x[f]] - (sums[done:stop] - sums[done]), n[f])
                        done = stop
                        far = np.bitwise_count(asks[i] ^ words[j]).sum(axis=1, dtype=np.int64)
                        good = far <= queries[i, 1]
                        out.append((queries[i[good], 0], ids[j[good]], far[good]))
                        held += int(good.sum())
                        if held > 4 * most:
                            out = [best_of(*(np.concatenate(y) for y in zip(*out)), k)]
                            held = min(len(out[0][0]), 2 * most)
            if out:
                q, n, d = best_of(*(np.concatenate(y) for y in zip(*out)), k)
                for cut in range(0, len(q), 1 << 16):
                    yield pa.record_batch([pa.array(q[cut : cut + (1 << 16)]), pa.array(n[cut : cut + (1 << 16)]), pa.array(d[cut : cut + (1 << 16)].astype(np.int32))], names=["q", "i", "d"])

        now, rows = None, []
        for batch in batches:
            for tile, kind, weight, blob in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if tile != now:
                    if rows:
                        yield from flush(now, rows)
                    now, rows = tile, []
                rows.append((kind, weight, blob))
        if rows:
            yield from flush(now, rows)

    return run


def top_k(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", k: int = K, low: int = LOW, every: int = 1) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): of every row whose id is divisible by `every` the k others, of all rows, with the nearest codes."""
    spark = df.sparkSession
    write = Written(spark, "top-k")
    rows = encode(df, ident, vector).distinct()
    ids = F.array_sort(F.collect_set("id"))
    all_ids = write(rows)
    codes = write(all_ids.groupBy("bits", "code").agg(F.slice(ids, 1, k + 1).alias("ids"), F.max(F.col("id") % every == 0).alias("asks")).withColumn("key", F.xxhash64("bits", "code")))
    numbers = {r.bits: r.n for r in codes.groupBy("bits").agg(F.count("*").alias("n")).collect()}
    cuts = {b: segments(b, n) for b, n in numbers.items()}
    others = {r.bits: r.n for r in all_ids.groupBy("bits").agg(F.countDistinct("id").alias("n")).collect()}
    want = F.create_map(*[F.lit(x) for b, n in others.items() for x in (b, min(k + 1, n))]) if numbers else None
    no_bound = 1 << 30
    owners = codes.select("bits", F.explode("ids").alias("number"), "code", F.lit(0).alias("bound"), F.lit(False).alias("open"))
    found = codes.where("asks").select("bits", "key", "code", F.expr("cast(array() as array<struct<d:int,i:bigint>>)").alias("best"), F.lit(no_bound).alias("bound"), F.lit(True).alias("open"))
    finished: list[DataFrame] = []
    radius = 0
    still = not found.isEmpty()
    while still:
        covered = F.create_map(*[F.lit(x) for b in numbers for x in (b, len(cuts[b]) * (radius + 1) - 1)])
        last = F.create_map(*[F.lit(x) for b in numbers for x in (b, max(y - x for x, y in cuts[b]) <= radius)])
        asks = owners.unionAll(found.select("bits", "key", "code", "bound", "open"))
        tiles = asks.mapInArrow(lean(_send(cuts, radius, low)), "tile string, kind int, weight int, blob binary")
        pairs = tiles.repartition("tile").sortWithinPartitions("tile", "kind").mapInArrow(lean(_meet(cuts, low, k + 1)), "q long, i long, d int")
        if radius:
            pairs = pairs.unionAll(found.select(F.col("key").alias("q"), F.explode("best").alias("b")).select("q", "b.i", "b.d"))
        pairs = pairs.repartition("q").groupBy("q", "i").agg(F.min("d").alias("d")).groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "i"))), 1, k + 1).alias("new"))
        merged = found.join(pairs, found.key == pairs.q, "left").select("bits", "key", "code", F.coalesce("new", "best").alias("best"))
        enough = F.size("best") >= F.element_at(want, F.col("bits"))
        bound = F.when(enough, F.element_at(F.col("best"), -1)["d"]).otherwise(no_bound)
        merged = write(merged.withColumn("bound", bound).withColumn("open", ~((F.col("bound") <= F.element_at(covered, F.col("bits"))) | F.element_at(last, F.col("bits")))))
        finished.append(merged.where("not open").select("bits", "code", "best"))
        found = merged.where("open")
        still = not found.isEmpty()
        radius += 1
    result = "query_id long, rank int, neighbour_id long, distance int"
    if not finished:
        return spark.createDataFrame([], result)
    best = finished[0]
    for more in finished[1:]:
        best = best.unionAll(more)
    # of an id that occurs with several codes the nearest counts
    per_id = all_ids.where(F.col("id") % every == 0).join(best, ["bits", "code"]).select("id", F.filter("best", lambda x: x["i"] != F.col("id")).alias("a"))
    listed = per_id.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("a"))).alias("a")).select("id", F.transform("a", lambda x: x["i"]).alias("i"), "a")
    first = F.filter("a", lambda x, n: F.array_position(F.col("i"), x["i"]) == n + 1)
    return listed.select(F.col("id").alias("query_id"), F.posexplode(F.slice(first, 1, k)).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.i").alias("neighbour_id"), F.col("x.d").alias("distance"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes, among those of all embeddings, of every embedding whose id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings"), every=QUERIES)


OP10_SQL = f"""
with e as (select distinct vec_id, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) as b
  from embeddings where vec_id is not null and len(embedding) > 0),
p as (select a.vec_id as q, c.vec_id as n, min(list_sum(list_transform(range(1, len(a.b) + 1), lambda i: abs(a.b[i] - c.b[i])))) as d
  from e a join e c on a.vec_id <> c.vec_id and len(a.b) = len(c.b) and a.vec_id % {QUERIES} = 0 group by 1, 2),
r as (select q, n, d, row_number() over (partition by q order by d, n) as k from p)
select q as query_id, k::int as rank, n as neighbour_id, d::int as distance from r where k <= {K}
"""
