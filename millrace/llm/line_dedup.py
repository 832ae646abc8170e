"""Fuzzy line dedup: of every group of similar lines in a corpus, one line stays.

1. Lines (split at line feeds, lower-cased, trimmed) become sets of hashed character shingles. Each distinct line gets a
   MinHash signature by one-permutation hashing with optimal densification; equal lines are grouped by a 128-bit
   hash, and the first occurrence stands for them.
2. Banding of the signature gives buckets of candidate lines. With 12 bands of 5 values, two lines of Jaccard similarity 0.8
   share a bucket with probability 0.99, and more similar ones more surely. Buckets with the same members count once.
3. The texts of lines in shared buckets meet there and are compared by exact Jaccard similarity of their
   shingle sets. Each pair is compared unless a chain of verified pairs already links it.
4. Distributed union-find over the verified pairs gives components, of which the line that comes first stays: the
   smallest document id, then the place in the text.

Cases: blank lines are no duplicates of anything and stay where they are. A null text stays null. A document that loses
its last line that isn't blank is dropped; one that never had any stays. Lines shorter than a shingle have one shingle. Rows with a null id come last in
order. Of rows repeated with the same id and text the least by all columns stays. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, col, components, fresh, lean, least_rows, table
from .vectext import mix, powers, slices

SHINGLE, LEAST, BANDS, ROWS = 7, 0.8, 12, 5
#: Bytes of text up to which lines that meet are numbered together; more are compared with less memory.
MOST_RUNS = 1 << 25
_U = np.uint64
_NONE = np.uint32(0xFFFFFFFF)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 bytes, and the offsets in characters. Bytes that are no UTF-8 count as characters each."""
    try:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        return data.astype(np.uint32), offsets
    begun = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return points, begun[offsets]


def line_spans(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line after trimming, its text's row and its number in the text."""
    feeds = np.flatnonzero(points == 10)
    row_of_feed = np.searchsorted(offsets, feeds, "right") - 1
    rows = len(offsets) - 1
    starts = np.concatenate((offsets[:-1], feeds + 1))
    ends = np.concatenate((offsets[1:], feeds))
    row = np.concatenate((np.arange(rows), row_of_feed))
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    # a line ends at the next feed of its text, else at the text's end
    ends = offsets[row + 1].copy()
    inner = np.flatnonzero(row[1:] == row[:-1])
    ends[inner] = starts[inner + 1] - 1
    number = np.arange(len(row)) - np.searchsorted(row, row)
    solid = (points > 32) & (points != 160)
    control = np.flatnonzero(points < 32)
    solid[control] = ~np.isin(points[control], np.array([9, 11, 12, 13], np.uint32))
    filled = np.flatnonzero(solid)
    if len(filled):
        at = np.searchsorted(filled, starts)
        starts = np.minimum(np.where(at < len(filled), filled[np.minimum(at, len(filled) - 1)], ends), ends)
        at = np.searchsorted(filled, ends) - 1
        ends = np.maximum(np.where(at >= 0, filled[np.maximum(at, 0)] + 1, starts), starts)
    else:
        starts = ends
    return starts, ends, row, number


def shingles(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of each span that isn't empty, their bounds, and the hash of the whole span."""
    up, down = powers(len(points) + 1)
    sums = np.empty(len(points) + 1, np.uint64)
    sums[0] = 0
    code = points.astype(np.uint64)
    code *= _U(0xD6E8FEB86659FD93)
    code += _U(0xA0761D6478BD642F)
    code *= up[:-1]
    np.cumsum(code, out=sums[1:])
    length = ends - starts
    count = np.where(length > 0, np.maximum(length - k + 1, 1), 0)
    bounds = np.concatenate(([0], np.cumsum(count)))
    # hashes of all windows of the characters at once, then those of the spans; a span shorter than a window is patched in
    window = sums[k:] - sums[:-k] if len(points) >= k else np.zeros(1, np.uint64)
    window *= down[: len(window)]
    window = mix(window)
    at = np.repeat(starts - bounds[:-1], count)
    at += np.arange(bounds[-1])
    h = window[np.minimum(at, len(window) - 1, out=at)]
    short = np.flatnonzero((length > 0) & (length < k))
    h[bounds[short]] = mix((sums[ends[short]] - sums[starts[short]]) * down[starts[short]])
    return h, bounds, mix((sums[ends] - sums[starts]) * down[starts] + length.astype(np.uint64))


def signature(hashes: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash (lines, bins); empty bins borrow from others in an order that is the same for all lines."""
    lines = len(bounds) - 1
    out = np.full(lines * bins, _NONE, np.uint32)
    place = hashes >> _U(32)
    place *= _U(bins)
    place >>= _U(32)
    place += np.repeat(np.arange(lines, dtype=np.uint64) * _U(bins), np.diff(bounds))
    np.minimum.at(out, place.view(np.int64), hashes.astype(np.uint32) >> np.uint32(1))
    out = out.reshape(lines, bins)
    full = out.copy()
    empty_line, empty_bin = np.nonzero((out == _NONE) & (np.diff(bounds) > 0)[:, None])
    for attempt in range(1, 65):
        if not len(empty_line):
            break
        source = (mix(empty_bin.astype(np.uint64) * _U(1_000_003) + _U(attempt)) % _U(bins)).astype(np.int64)
        got = full[empty_line, source]
        ok = got != _NONE
        out[empty_line[ok], empty_bin[ok]] = got[ok]
        empty_line, empty_bin = empty_line[~ok], empty_bin[~ok]
    if len(empty_line):
        out[empty_line, empty_bin] = full[empty_line].min(axis=1)
    return out


def band_hashes(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    v = values[:, : bands * rows].reshape(len(values), bands, rows).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15), (len(values), bands)).copy()
    for r in range(rows):
        total = mix(total ^ (v[:, :, r] * _U(0xC2B2AE3D27D4EB4F) + _U(r + 1)))
    return total


def _lines(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # in: k1, k2, id, text; out: one row for each line
        for batch in batches:
            batch = batch.filter(batch.column(3).is_valid())
            for at, count, data, offsets in slices(batch.column(3), lower=True):
                points, offsets = code_points(data, offsets)
                starts, ends, row, number = line_spans(points, offsets)
                h, bounds, whole = shingles(points, starts, ends, shingle)
                filled = ends > starts
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)))
                second = mix(sums[bounds[1:]] - sums[bounds[:-1]])
                head = batch.slice(at, count)
                take = pa.array(row)
                k1, k2 = head.column(0).to_numpy()[row].view(np.uint64), head.column(1).to_numpy()[row].view(np.uint64)
                # a blank line is equal to no other
                key = np.empty((len(row), 2), np.uint64)
                key[:, 0] = np.where(filled, whole, mix(k1 + number.astype(np.uint64)))
                key[:, 1] = np.where(filled, second, mix(k2 ^ number.astype(np.uint64)))
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(row), [None, pa.py_buffer(key.tobytes())]).cast(pa.binary())
                flat = band_hashes(signature(h, bounds, bands * rows), bands, rows)
                ends_of = np.concatenate(([0], np.cumsum(np.where(filled, bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends_of), pa.array(flat[filled].ravel().view(np.int64)))
                yield pa.record_batch([keys, head.column(2).take(take), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(number.astype(np.int32)), lists], names=["line", "id", "k1", "k2", "number", "bands"])

    return run


_BAND = np.dtype([("band", "<u8"), ("a", "<u8"), ("b", "<u8")])


def _bands(n: int, most: int = 1 << 18):
    """Lines with their bands, to what goes to each of n buckets: bands with the line's 16 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            r = np.concatenate(held)
            bucket = (((r["band"] >> _U(32)) * _U(n)) >> _U(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            r, cuts = r[order], np.searchsorted(bucket[order], np.arange(n + 1))
            own = np.flatnonzero(np.diff(cuts))
            return pa.record_batch([pa.array(own.astype(np.int32)), pa.array([r[cuts[k] : cuts[k + 1]].tobytes() for k in own.tolist()], pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64).reshape(-1, 2)
            lists = batch.column(1)
            count = np.diff(lists.offsets.to_numpy())
            r = np.empty(int(count.sum()), _BAND)
            r["band"] = lists.flatten().to_numpy().view(np.uint64)
            r["a"], r["b"] = np.repeat(keys[:, 0], count), np.repeat(keys[:, 1], count)
            held.append(r)
            if sum(map(len, held)) >= most:
                yield close()
                held = []
        if held:
            yield close()

    return run


def _binary16(a: np.ndarray, b: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(a), [None, pa.py_buffer(np.ascontiguousarray(np.stack((a, b), 1)).tobytes())]).cast(pa.binary())


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, blob) sorted by bucket: one row for each band of two or more lines, named by its members."""

    def flush(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        r = np.frombuffer(b"".join(blobs), _BAND)
        r = r[np.argsort(r["band"], kind="stable")]
        first = np.flatnonzero(np.concatenate(([True], r["band"][1:] != r["band"][:-1])))
        size = np.diff(np.append(first, len(r)))
        many = np.repeat(size > 1, size)
        r, size = r[many], size[size > 1]
        ends = np.concatenate(([0], np.cumsum(size)))
        a, b = r["a"].copy(), r["b"].copy()
        code, other = mix(a ^ mix(b.copy())), mix(b + _U(77))
        s1, s2 = (np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64))) for x in (code, other))
        names = _binary16(s1[ends[1:]] - s1[ends[:-1]], s2[ends[1:]] - s2[ends[:-1]])
        # a band of very many lines is one list, as its members are compared together
        for cut in range(0, len(size), 1 << 14):
            stop = min(cut + (1 << 14), len(size))
            x, y = ends[cut], ends[stop]
            yield pa.record_batch([names.slice(cut, stop - cut), pa.ListArray.from_arrays(pa.array((ends[cut : stop + 1] - x).astype(np.int32)), _binary16(a[x:y], b[x:y]))], names=["block", "lines"])

    now, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != now:
                if held:
                    yield from flush(held)
                now, held = bucket, []
            held.append(blob)
    if held:
        yield from flush(held)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From text and the wanted (number, line, block) of its lines: one row (block, line, text) each."""
    for batch in batches:
        blocks, lines, out = [], [], []
        wanted = batch.column(1).to_pylist()
        for text, want in zip(batch.column(0).to_pylist(), wanted):
            parts = text.split("\n")
            for w in want:
                blocks.append(w["block"])
                lines.append(w["line"])
                out.append(parts[w["number"]])
        yield pa.record_batch([pa.array(blocks, pa.binary()), pa.array(lines, pa.binary()), pa.array(out, pa.string())], names=["block", "line", "text"])


def similar_pairs(sizes: np.ndarray, sets: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether lines a[i] and b[i] are similar enough, for many pairs at once. sets: sorted distinct 44-bit values of each line."""
    out = np.zeros(len(a), bool)
    ok = np.flatnonzero(np.minimum(sizes[a], sizes[b]) >= least * np.maximum(sizes[a], sizes[b]) - 1e-9)
    load = np.concatenate(([0], np.cumsum(sizes[a[ok]] + sizes[b[ok]])))
    first = 0
    while first < len(ok):
        stop = min(max(first + 1, int(np.searchsorted(load, load[first] + (1 << 20), "right")) - 1), first + (1 << 19), len(ok))
        p = ok[first:stop]
        x, y = a[p], b[p]
        rows = np.concatenate((x, y))
        n = sizes[rows]
        ends = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(bounds[rows] - ends[:-1], n) + np.arange(ends[-1])
        pair = np.tile(np.arange(len(p), dtype=np.uint64), 2)
        key = np.repeat(pair << _U(44), n) | sets[at]
        key.sort()
        same = key[1:][key[1:] == key[:-1]] >> _U(44)
        shared = np.bincount(same.astype(np.int64), minlength=len(p))
        out[p] = shared >= least * (sizes[x] + sizes[y] - shared) - 1e-9
        first = stop
    return out


def _shingled(texts: pa.ChunkedArray, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The first line of a slice, and the shingles of its lines with their bounds."""
    for at, _, data, offsets in slices(texts, lower=True):
        points, offsets = code_points(data, offsets)
        h, bounds, _ = shingles(points, *_trimmed(points, offsets), shingle)
        yield at, h, bounds


def by_pairs(texts: pa.ChunkedArray, group: np.ndarray, shingle: int, least: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether lines a[i] and b[i] are similar enough, for many pairs at once: the sets of each pair are sorted together."""
    values, sizes = [], []
    for _, h, bounds in _shingled(texts, shingle):
        row = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
        both = row << _U(44) | h >> _U(20)
        both.sort()
        both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
        values.append(both & _U((1 << 44) - 1))
        sizes.append(np.bincount((both >> _U(44)).astype(np.int64), minlength=len(bounds) - 1))
    sets, size = np.concatenate(values), np.concatenate(sizes)
    bounds = np.concatenate(([0], np.cumsum(size)))
    return lambda a, b: similar_pairs(size, sets, bounds, a, b, least)


def by_runs(texts: pa.ChunkedArray, group: np.ndarray, shingle: int, least: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The same for 2**20 lines at most, sorted by group, where the lines a of a call are one for each group: shingles are sorted once and
    numbered by group, so that a pair takes no more than looking up which of b's numbers are a's."""
    low, n = _U((1 << 20) - 1), len(group)
    keys = []
    for at, h, bounds in _shingled(texts, shingle):
        h &= ~low
        h |= np.repeat(np.arange(at, at + len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
        keys.append(h)
    key = np.concatenate(keys) if len(keys) > 1 else keys[0]
    del keys
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    row = (key & low).astype(np.uint16 if n <= 1 << 16 else np.int32)
    key >>= _U(20)
    of = group.astype(np.int32)[row]
    number = np.concatenate((np.zeros(min(1, len(key)), np.int32), np.cumsum((key[1:] != key[:-1]) | (of[1:] != of[:-1]), dtype=np.int32)))
    size = np.bincount(row, minlength=n)
    bounds = np.concatenate(([0], np.cumsum(size)))
    number = number[np.argsort(row, kind="stable")]
    own = np.zeros(int(number.max()) + 1 if len(number) else 0, bool)

    def numbers(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.concatenate(([0], np.cumsum(size[rows])))
        at = np.repeat(bounds[rows] - ends[:-1], size[rows])
        at += np.arange(ends[-1])
        return number[at], ends

    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        pivots = numbers(a[np.concatenate(([True], a[1:] != a[:-1]))])[0] if len(a) else number[:0]
        own[pivots] = True
        load, first = np.concatenate(([0], np.cumsum(size[b]))), 0
        while first < len(b):
            stop = max(first + 1, int(np.searchsorted(load, load[first] + (1 << 20), "right")) - 1)
            x, y = a[first:stop], b[first:stop]
            found, ends = numbers(y)
            # a line that is met has a shingle
            shared = np.add.reduceat(own[found].view(np.uint8), ends[:-1], dtype=np.int64)
            out[first:stop] = shared >= least * (size[x] + size[y] - shared) - 1e-9
            first = stop
        own[pivots] = False
        return out

    return alike


def _verify(shingle: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows (block, line, text) sorted by block; out: verified edges that span each block's components

        def flush(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            keys = t["line"].to_pylist()
            left, right = [], []
            names = np.frombuffer(b"".join(t["block"].to_pylist()), np.uint64).reshape(-1, 2)
            code = np.concatenate(([0], np.cumsum((names[1:] != names[:-1]).any(axis=1))))
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(code)) + 1, [len(code)]))
            length = np.diff(cuts)
            group = np.repeat(np.arange(len(length)), length)
            alike = (by_runs if len(code) <= 1 << 20 and t["text"].nbytes <= MOST_RUNS else by_pairs)(t["text"], group, shingle, least)
            two = np.flatnonzero(length == 2)
            a, b = cuts[two], cuts[two] + 1
            hit = alike(a, b)
            left += [keys[i] for i in a[hit]]
            right += [keys[i] for i in b[hit]]
            # larger groups together: the next member of each is compared with those behind it that no chain links to it yet
            place = np.arange(len(code)) - cuts[group]
            root, parts, c = np.arange(len(code)), np.where(length > 2, length, 1), 0
            while len(rows := np.flatnonzero((parts[group] > 1) & (place > c))):
                pivot = cuts[group[rows]] + c
                apart = root[rows] != root[pivot]
                rows, pivot = rows[apart], pivot[apart]
                hit = alike(pivot, rows)
                for p, x in zip(pivot[hit].tolist(), rows[hit].tolist()):
                    if root[x] != root[p]:
                        left.append(keys[p])
                        right.append(keys[x])
                        g = group[p]
                        own = root[cuts[g] : cuts[g + 1]]
                        own[own == root[x]] = root[p]
                        parts[g] -= 1
                c += 1
            return pa.record_batch([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).to_pylist()
            if held and held[-1].column(0)[-1].as_py() != names[0]:
                yield flush(pa.Table.from_batches(held))
                held = []
            cut = len(names)
            while cut and names[cut - 1] == names[-1]:
                cut -= 1
            if cut:
                yield flush(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def _trimmed(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, row, number = line_spans(points, offsets)
    first = np.flatnonzero(number == 0)
    return starts[first], ends[first]


def line_dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LEAST, bands: int = BANDS, rows: int = ROWS, dropped: str | None = None) -> DataFrame:
    """The documents with their remaining lines; dropped names a further column with the number of lines removed."""
    write = Written(docs.sparkSession, "line-dedup")
    keep = docs.columns
    k1, k2, n_lines = (fresh(keep, x) for x in ("key_1", "key_2", "n_lines"))
    counted = F.octet_length(col(text)) - F.octet_length(F.replace(col(text), F.lit("\n"), F.lit(""))) + 1
    keyed = docs.withColumns({k1: F.xxhash64(col(ident), col(text)), k2: F.xxhash64(F.lit(1), col(text), col(ident)), n_lines: counted})
    kind = docs.schema[ident].dataType.simpleString()
    lines = keyed.select(col(k1), col(k2), col(ident).alias("id"), col(text).alias("text")).mapInArrow(lean(_lines(shingle, bands, rows)), f"line binary, id {kind}, k1 long, k2 long, number int, bands array<long>")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "k1", "k2", "number")
    first = write(lines.groupBy("line").agg(F.min(place).alias("at"), F.first("bands").alias("bands")).withColumn("filled", F.size("bands") > 0))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = first.select("line", "bands").mapInArrow(lean(_bands(4 * partitions)), "bucket int, blob binary").repartition(partitions, "bucket").sortWithinPartitions("bucket")
    found = sent.mapInArrow(lean(_buckets), "block binary, lines array<binary>")
    members = write(found.groupBy("block").agg(F.first("lines").alias("lines")).select("block", F.explode("lines").alias("line")))
    wanted = members.join(first.select("line", "at.k1", "at.k2", "at.number"), "line").groupBy("k1", "k2").agg(F.collect_list(F.struct("number", "line", "block")).alias("want"))
    source = keyed.select(col(k1).alias("k1"), col(k2).alias("k2"), col(text).alias("text"))
    texts = source.join(wanted, ["k1", "k2"]).select("text", "want").mapInArrow(lean(_texts), "block binary, line binary, text string").dropDuplicates(["block", "line"])
    edges = write(texts.repartition("block").sortWithinPartitions("block").mapInArrow(lean(_verify(shingle, least)), "a binary, b binary"))
    write.drop(members)
    roots = write(components(docs.sparkSession, edges, write))
    write.drop(edges)
    # of each component the line that comes first stays
    linked = roots.join(first.select("line", "at"), roots.node == F.col("line"))
    best = linked.groupBy(F.col("root").alias("r")).agg(F.min("at").alias("best"))
    out = linked.join(best, F.col("root") == F.col("r")).where("at <> best").select("line")
    kept = first.join(out, "line", "left_anti").groupBy("at.k1", "at.k2").agg(F.array_sort(F.collect_list("at.number")).alias("_kept"), F.max("filled").alias("_filled"))
    # of rows repeated with the same id and text one goes on; there are few, so only they are moved for it
    again = write(keyed.groupBy(col(k1).alias("r1"), col(k2).alias("r2")).agg(F.count("*").alias("rows")).where("rows > 1").select("r1", "r2"))
    keyed_columns = [*keep, k1, k2, n_lines]
    if not again.isEmpty():
        a1, a2 = fresh(keyed_columns, "again_1"), fresh(keyed_columns, "again_2")
        repeats, same = again.toDF(a1, a2), (col(k1) == col(a1)) & (col(k2) == col(a2))
        keyed = keyed.join(repeats, same, "left_anti").unionByName(least_rows(keyed.join(repeats, same, "left_semi"), [k1, k2], keyed_columns))
    o1, o2, kept_c, filled_c = (fresh(keyed_columns, x) for x in ("own_1", "own_2", "kept_numbers", "kept_filled"))
    kept = kept.select(F.col("k1").alias(o1), F.col("k2").alias(o2), F.col("_kept").alias(kept_c), F.col("_filled").alias(filled_c))
    joined = keyed.join(kept, (col(k1) == col(o1)) & (col(k2) == col(o2)), "left")
    return rebuilt(joined, keep, text, kept_c, filled_c, n_lines, dropped and fresh(keep, dropped))


def rebuilt(joined: DataFrame, keep: list[str], text: str, kept: str, filled: str, lines: str, dropped: str | None) -> DataFrame:
    """Texts of the lines whose sorted numbers are in `kept`, as runs of lines that are next to each other; `filled` says whether one of them isn't blank, `lines` how many there were.

    The lines are bound once for all runs, so that a text of any length takes one pass.
    """
    k = F.coalesce(col(kept), F.expr("cast(array() as array<int>)"))
    starts = F.filter(k, lambda x, i: F.coalesce(F.get(k, i - 1), F.lit(-2)) != x - 1)
    ends = F.filter(k, lambda x, i: F.coalesce(F.get(k, i + 1), F.lit(-2)) != x + 1)
    parts = F.array(F.split(col(text), "\n", -1))
    left = F.get(F.transform(parts, lambda p: F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(p, a + 1, b - a + 1)))), 0)
    # most texts keep all lines, and are not taken apart
    whole = col(text).isNull() | (F.size(k) >= col(lines))
    remaining = F.when(whole, col(text)).otherwise(F.array_join(left, "\n"))
    # blank lines are always kept, so a text without others is whole
    rows = joined.where(whole | F.coalesce(col(filled), F.lit(False)))
    columns = [remaining.alias(c) if c == text else col(c) for c in keep]
    return rows.select(*columns, *([F.when(col(text).isNull(), 0).otherwise(col(lines) - F.size(k)).alias(dropped)] if dropped else []))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that keeps a line, with the lines that it keeps and the number of those that it lost."""
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), dropped="dropped")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their remaining lines; n_chars follows the text."""
    found = line_dedup(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found
