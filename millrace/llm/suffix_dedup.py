"""Repeated passages by merging the Burrows-Wheeler transforms of shards.

The result has every maximal stretch of words that is covered by windows of `least` words occurring more than once in
the corpus, in another text or in the same one: (id, first_word, n_words). Words are those of vectext: runs of letters, digits
and non-ASCII characters of the lower-cased text.

1. Texts are cut into phrases at words chosen by their surroundings alone (the smallest hash of two words in some window of
   W of them), so equal passages are cut alike except near their ends. A repeated window of `least` words has
   at least T = least - 2 - 4 (W - 1) words in whole phrases that are common to its copies. Phrases are the symbols.
2. A shard is a few megabytes of text. Its suffixes are sorted, which gives its transform: for each suffix in order the
   phrase before it, and the place of the suffix that begins there.
3. The transforms are merged by refining their interleaving. At depth k the merged order consists of blocks of suffixes that
   agree in k phrases; a block is an interval in every shard. A round takes each block to those of depth k + 1, by the symbols
   before its suffixes, and the shards exchange the hashes of their new blocks, eight bytes each, to learn which are
   met again. A block with one suffix is final: it is dropped and never refined. A block whose common prefix has
   T words or more is a repeated interval. No suffix is sorted again, and after the first round only repeats are left.
4. Each repeated interval of the merged order vouches for the windows that begin up to 2 W - 2 words before it.
   Only these windows are hashed whole (64 bits) and exchanged in the same way; those met again are merged into stretches.

Nothing is sampled away: every repeated window is found, whatever its number of copies, and no list of copies is ever
gathered in one place.

Cases: null texts and texts of fewer than `least` words give nothing. Rows with a null id take part and are reported with a null id. Repeated rows are
repeats of one another and each is reported. Texts are read whole. Touching stretches are one. An
empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, col, lean, table
from .vectext import WORD_BREAK, mix, powers, slices, words

LEAST, SHARD_BYTES = 50, 4 << 20
_U = np.uint64


def window_of(least: int) -> tuple[int, int]:
    """W and T for windows of `least` words."""
    w = max(1, (least - 2 - max(1, least // 4)) // 4 + 1)
    return w, max(1, least - 2 - 4 * (w - 1))


def prefix_sums(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes) + 1)[0][:-1], out=out[1:])
    return out


def stretch_hash(sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The hash of the words from s to e, equal wherever they stand."""
    return mix((sums[e] - sums[s]) * powers(len(sums))[1][s] + (e - s).astype(np.uint64))


def phrase_starts(hashes: np.ndarray, bounds: np.ndarray, w: int) -> np.ndarray:
    """The words at which phrases begin: the first of each text, and those whose pair with the next word has the smallest hash of some w pairs."""
    n = len(hashes)
    filled = np.flatnonzero(np.diff(bounds))
    pair = mix(hashes * _U(0x9E3779B97F4A7C15) + np.roll(hashes, -1) * _U(0xC2B2AE3D27D4EB4F)) | _U(1)
    pair[bounds[filled + 1] - 1] = 0  # the last word of a text ends all runs
    run = np.ones(n, np.int16)
    for older in (True, False):
        alive = pair > 0
        for d in range(1, w):
            if older:
                alive[d:] &= pair[:-d] >= pair[d:]
                alive[:d] = False
            else:
                alive[:-d] &= pair[d:] > pair[:-d]
                alive[-d:] = False
            run += alive
    chosen = (pair > 0) & (run >= w)
    chosen[bounds[filled]] = True
    return np.flatnonzero(chosen)


def dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def load(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as found:
        return {k: found[k] for k in found.files}


_ROW = "shard long, kind int, bucket int, blob binary"


def _row(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    s, k, b, x = zip(*rows) if rows else ((), (), (), ())
    return pa.record_batch([pa.array(s, pa.int64()), pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(x, pa.binary())], names=["shard", "kind", "bucket", "blob"])


def _shards(least: int, w: int, most: int):
    """Texts with keys to shards: their phrases in text order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = 0, [], 0
        task = TaskContext.get().partitionId() << 32

        def close() -> pa.RecordBatch:
            keys, count, length, symbol = (np.concatenate(x) for x in zip(*held))
            return _row([(task + number, 0, 0, dump(keys=keys, count=count, length=length, symbol=symbol))])

        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            k = np.stack([batch.column(i).to_numpy() for i in (0, 1)], 1)
            for at, rows, data, offsets in slices(batch.column(2), lower=True):
                h, bounds = words(data, offsets)
                count = np.diff(bounds)
                long_ = np.flatnonzero(count >= least)
                if len(long_):
                    take = np.repeat(count >= least, count)
                    h, bounds = h[take], np.concatenate(([0], np.cumsum(count[long_])))
                    s = phrase_starts(h, bounds, w)
                    e = np.append(s[1:], len(h))
                    doc = np.searchsorted(bounds, s, "right") - 1
                    held.append((k[at + long_], np.bincount(doc, minlength=len(long_)).astype(np.int32), (e - s).astype(np.uint8 if 2 * w + 2 < 256 else np.uint16), stretch_hash(prefix_sums(h), s, e)))
                size += len(data)
                if size >= most and held:
                    yield close()
                    number, held, size = number + 1, [], 0
        if held:
            yield close()

    return run


def buckets_of(blocks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks in the order in which they are sent, by bucket, and where each bucket begins."""
    bucket = ((blocks >> _U(32)) * _U(n)) >> _U(32)
    order = np.argsort(bucket.astype(np.int32), kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def send(shard: int, blocks: np.ndarray, several: np.ndarray, n: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Distinct block hashes to their buckets; the lowest bit says whether the shard has several suffixes in it."""
    order, cuts = buckets_of(blocks, n)
    marked = ((blocks & ~_U(1)) | several.astype(np.uint64))[order]
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield shard, 1, b, marked[cuts[b] : cuts[b + 1]].tobytes()


def answered(blocks: np.ndarray, replies: dict[int, bytes], n: int) -> np.ndarray:
    """Whether each sent block is met again, from the replies of the buckets."""
    order, cuts = buckets_of(blocks, n)
    out = np.zeros(len(blocks), bool)
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        m = cuts[b + 1] - cuts[b]
        out[order[cuts[b] : cuts[b + 1]]] = np.unpackbits(np.frombuffer(replies[b], np.uint8), count=m).astype(bool)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All that was sent to a bucket, bucket by bucket, to a bit for each block: is it met again?"""

    def flush(rows: list[tuple[int, bytes]], bucket: int) -> pa.RecordBatch:
        sizes = np.array([len(x) // 8 for _, x in rows])
        every = np.frombuffer(b"".join(x for _, x in rows), np.uint64)
        order = np.argsort(every >> _U(1))
        sorted_ = every[order]
        name = sorted_ >> _U(1)
        same = name[1:] == name[:-1]
        again = (sorted_ & _U(1)).astype(bool)
        again[1:] |= same
        again[:-1] |= same
        out = np.empty(len(every), bool)
        out[order] = again
        ends = np.cumsum(sizes)
        return _row([(s, 1, bucket, np.packbits(out[e - k : e]).tobytes()) for (s, _), e, k in zip(rows, ends.tolist(), sizes.tolist())])

    now, held = None, []
    for batch in batches:
        for s, b, x in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
            if b != now:
                if held:
                    yield flush(held, now)
                now, held = b, []
            held.append((s, x))
    if held:
        yield flush(held, now)


def blocks_of(state: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of the suffixes under refinement in merged order: hash, whether the shard has several, and the block of each."""
    block = state["block"]
    if "sa" not in state:  # depth 1: a block is a symbol
        names, at, n = np.unique(block, return_inverse=True, return_counts=True)
        return names, n > 1, at
    new = np.ones(len(block), bool)
    new[1:] = block[1:] != block[:-1]
    at = np.cumsum(new) - 1
    return block[new], np.bincount(at, minlength=int(new.sum())) > 1, at


def suffix_order(symbol: np.ndarray, joined: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the suffixes' first `depth` symbols. joined: whether the next place continues the text."""
    n = len(symbol)
    _, rank = np.unique(symbol, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    reach = joined.copy()  # whether k places on is still the same text
    k = 1
    while k < depth:
        after = np.zeros(n, np.int64)
        ok = np.flatnonzero(reach[: n - k])
        after[ok] = rank[ok + k]
        _, rank = np.unique(rank * (n + 2) + after, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        further = np.zeros(n, bool)
        further[ok] = reach[ok + k]
        reach, k = further, 2 * k
    return np.argsort(rank, kind="stable").astype(np.int32)


def advance(state: dict[str, np.ndarray], again: np.ndarray, t: int) -> tuple[dict[str, np.ndarray] | None, np.ndarray]:
    """From which blocks are met again to the state at the next depth, and the places whose prefix of t words is repeated."""
    _, _, at = blocks_of(state)
    good = again[at]
    n = len(state["symbol"])
    if "sa" not in state:
        place, block, size = np.flatnonzero(good), state["block"][good], state["length"][good].astype(np.int32)
    else:
        place, block, size = state["place"][good], state["block"][good], state["size"][good]
    hit = place[size >= t]
    alive = np.zeros(n, bool)  # repeated so far, not yet long enough
    alive[place[size < t]] = True
    keep = np.zeros(n, bool)
    keep[place] = True
    # what is dropped is final
    kept = np.flatnonzero(keep)
    new_place = np.cumsum(keep) - 1
    static = {k: state[k][kept] for k in ("doc", "start", "length", "symbol", "pos")}
    joined = np.zeros(len(kept), bool)
    joined[:-1] = (static["pos"][1:] == static["pos"][:-1] + 1) & (static["doc"][1:] == static["doc"][:-1])
    if "sa" not in state:
        sa = suffix_order(static["symbol"], joined, 1 << max(1, int(t).bit_length()))
    else:
        old = state["sa"]
        sa = new_place[old[keep[old]]].astype(np.int32)
    lf = np.empty(len(kept), np.int64)  # the place in the order of each suffix
    lf[sa] = np.arange(len(kept))
    # the transform: for each suffix of a block, in order, the symbol before it
    here = new_place[place]
    here, block, size = (x[np.argsort(lf[here])] for x in (here, block, size))
    ok = (here > 0) & joined[np.maximum(here - 1, 0)] & alive[kept[np.maximum(here - 1, 0)]]
    before, block, size = here[ok] - 1, block[ok], size[ok]
    order = np.argsort(lf[before])
    before, block, size = before[order], block[order], size[order]
    found = {
        "keys": state["keys"],
        **static,
        "sa": sa,
        "place": before.astype(np.int32),
        "block": mix(block * _U(0x9E3779B97F4A7C15) ^ mix(static["symbol"][before])),
        "size": np.minimum(size.astype(np.int32) + static["length"][before], 0xFFFF).astype(np.uint16),
    }
    return (found if len(before) else None), hit


def _send(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, kind, x in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if not kind:
                    state = started(load(x))
                    names, several, _ = blocks_of(state)
                    yield _row(list(send(s, names, several, n)))

    return run


def started(state: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A shard's state; at first only phrases are stored, and the rest follows from them."""
    if "block" not in state:
        count = state.pop("count")
        before = np.cumsum(state["length"], dtype=np.int64) - state["length"]
        first = np.cumsum(count) - count
        n = len(state["symbol"])
        state |= {"block": state["symbol"], "pos": np.arange(n, dtype=np.int32), "doc": np.repeat(np.arange(len(count), dtype=np.int32), count), "start": (before - np.repeat(before[first], count)).astype(np.int32)}
    return state


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, dict[int, bytes]]]:
    """Rows sorted by shard and kind: the shard, its own blob and its replies."""
    now, own, replies = None, None, {}
    for batch in batches:
        for s, kind, b, x in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if s != now:
                if own is not None:
                    yield now, own, replies
                now, own, replies = s, None, {}
            if kind:
                replies[b] = x
            else:
                own = x
    if own is not None:
        yield now, own, replies


def _advance(n: int, t: int):
    """kind 0: the shard at the next depth; kind 2: its hits, as documents' keys and places in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, own, replies in by_shard(batches):
            state = started(load(own))
            names, _, _ = blocks_of(state)
            more, hit = advance(state, answered(names, replies, n), t)
            rows = [(s, 0, 0, dump(**more))] if more else []
            if len(hit):
                docs, doc = np.unique(state["doc"][hit], return_inverse=True)
                rows.append((s, 2, 0, dump(keys=state["keys"][docs], doc=doc.astype(np.int32), start=state["start"][hit])))
            yield _row(rows)

    return run


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(3).to_pylist():
            found = load(x)
            order = np.lexsort((found["start"], found["doc"]))
            doc, start = found["doc"][order], found["start"][order]
            cuts = np.flatnonzero(np.diff(doc, prepend=-1))
            keys = found["keys"][doc[cuts]]
            blobs = [start[a:b].astype(np.int32).tobytes() for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(doc)])]
            yield pa.record_batch([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(blobs, pa.binary())], names=["_k1", "_k2", "starts"])


def _units(most: int):
    """Texts with hits, gathered into units of bounded size: one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = [pa.array([t[c].to_pylist()], pa.list_(t[c].type)) for c in t.column_names]
            return pa.record_batch([pa.array([task + number], pa.int64()), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([None], pa.binary()), *lists], names=["shard", "kind", "bucket", "blob", *t.column_names])

        for batch in batches:
            ends = np.cumsum([len(x) for x in batch.column(1).to_pylist()])
            at = 0
            while at < batch.num_rows:
                room = most - size + (int(ends[at - 1]) if at else 0)
                stop = max(at + 1, int(np.searchsorted(ends, room, "right")))
                held.append(batch.slice(at, stop - at))
                size += int(ends[stop - 1]) - (int(ends[at - 1]) if at else 0)
                at = stop
                if size >= most or at < batch.num_rows:
                    yield close()
                    number, held, size = number + 1, [], 0
        if held:
            yield close()

    return run


def windows_of(texts: list[str], hits: list[list[bytes]], least: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and hash of every window that a hit vouches for."""
    rows, firsts, hashes = [], [], []
    for at, n, data, offsets in slices(pa.array(texts, pa.large_string()), lower=True):
        h, bounds = words(data, offsets)
        sums = prefix_sums(h)
        for r in range(n):
            starts = np.unique(np.concatenate([np.frombuffer(x, np.int32) for x in hits[at + r]])).astype(np.int64)
            last = int(bounds[r + 1] - bounds[r]) - least
            if last < 0 or not len(starts):
                continue
            # windows from 2 W - 2 words before a hit up to the hit itself
            change = np.zeros(last + 2, np.int32)
            lo, hi = np.maximum(starts - 2 * w + 2, 0), np.minimum(starts, last)
            fine = lo <= hi
            np.add.at(change, lo[fine], 1)
            np.add.at(change, hi[fine] + 1, -1)
            first = np.flatnonzero(np.cumsum(change[:-1]) > 0)
            rows.append(np.full(len(first), at + r))
            firsts.append(first)
            hashes.append(stretch_hash(sums, bounds[r] + first, bounds[r] + first + least))
    if not rows:
        e = np.zeros(0, np.int64)
        return e, e, e.view(np.uint64)
    return np.concatenate(rows), np.concatenate(firsts), np.concatenate(hashes)


def _send_windows(n: int, least: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, texts, starts in zip(*(batch.column(i).to_pylist() for i in (0, 5, 6))):
                names, count = np.unique(windows_of(texts, starts, least, w)[2], return_counts=True)
                yield _row(list(send(s, names, count > 1, n)))

    return run


def _stretches(n: int, least: int, w: int, kind: pa.DataType | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids: pa.Array, texts: list, starts: list, replies: dict[int, bytes]) -> pa.RecordBatch:
            row, first, h = windows_of(texts, starts, least, w)
            names, back = np.unique(h, return_inverse=True)
            good = answered(names, replies, n)[back]
            row, first = row[good], first[good]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (first[1:] > first[:-1] + least)
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(row)) - 1
            return pa.record_batch([ids.take(pa.array(row[a])), pa.array(first[a].astype(np.int32)), pa.array((first[b] + least - first[a]).astype(np.int32))], names=["doc_id", "first_word", "n_words"])

        now, own, replies = None, None, {}
        for batch in batches:
            for i, (s, what, b, x) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)))):
                if s != now:
                    if own:
                        yield flush(*own, replies)
                    now, own, replies = s, None, {}
                if what:
                    replies[b] = x
                else:
                    own = batch.column(4)[i].values, batch.column(5)[i].as_py(), batch.column(6)[i].as_py()
        if own:
            yield flush(*own, replies)

    return run


def repeated_passages(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: int = LEAST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, first_word, n_words) of the stretches that are covered by repeated windows of `least` words."""
    if least < 4:
        raise ValueError("least is 4 at least")
    spark = docs.sparkSession
    write = Written(spark, "suffix-dedup")
    w, t = window_of(least)
    n = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema[ident].dataType.simpleString()
    keyed = docs.where(col(text).isNotNull()).select(F.xxhash64(col(ident), col(text)).alias("k1"), F.xxhash64(F.lit(1), col(text), col(ident)).alias("k2"), col(ident).alias("id"), col(text).alias("text"))
    now = write(keyed.select("k1", "k2", "text").mapInArrow(lean(_shards(least, w, shard_bytes)), _ROW))

    def met_again(sent: DataFrame) -> DataFrame:
        return sent.repartition(n, "bucket").sortWithinPartitions("bucket", "shard").mapInArrow(lean(_count), _ROW)

    hits: list[DataFrame] = []
    while True:
        replies = met_again(now.mapInArrow(lean(_send(n)), _ROW))
        both = now.unionAll(replies).repartition("shard").sortWithinPartitions("shard", "kind")
        more, hit = write.by_kind(both.mapInArrow(lean(_advance(n, t)), _ROW), 0, 2)
        write.drop(now)
        hits.append(hit)
        now = more
        if now.isEmpty():
            break
    found = hits[0]
    for more in hits[1:]:
        found = found.unionAll(more)
    found = found.mapInArrow(lean(_hits), "_k1 long, _k2 long, starts binary").groupBy("_k1", "_k2").agg(F.collect_list("starts").alias("starts"))
    found = write(found)
    texts = keyed.join(found, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))).select("id", "text", "starts")
    lists = f"ids array<{kind}>, texts array<string>, starts array<array<binary>>"
    units = write(texts.mapInArrow(lean(_units(shard_bytes)), f"{_ROW}, id array<{kind}>, text array<string>, starts array<array<binary>>").toDF("shard", "kind", "bucket", "blob", "ids", "texts", "starts"))
    replies = met_again(units.mapInArrow(lean(_send_windows(n, least, w)), _ROW))
    none = [F.lit(None).cast(x.strip().split(" ", 1)[1]).alias(x.strip().split(" ", 1)[0]) for x in lists.split(", ")]
    both = units.unionAll(replies.select("*", *none)).repartition("shard").sortWithinPartitions("shard", F.desc("kind"))
    out = write(both.mapInArrow(lean(_stretches(n, least, w)), f"doc_id {kind}, first_word int, n_words int"))
    write.drop_all_but(out)
    return out


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of 50 words and more that documents repeat."""
    return repeated_passages(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
with t as (
  select row_number() over () as r, doc_id, list_filter(string_split_regex(lower(text), '{WORD_BREAK}'), lambda x: x <> '') as w
  from documents where text is not null),
g as (select r, doc_id, w, unnest(range(0, len(w) - {LEAST} + 1)) as i from t where len(w) >= {LEAST}),
h as (select r, doc_id, i, md5(array_to_string(list_slice(w, i + 1, i + {LEAST}), ' ')) as gram from g),
m as (select gram from h group by gram having count(*) > 1),
p as (select r, doc_id, i, i - lag(i) over (partition by r order by i) as gap from h semi join m on h.gram = m.gram),
s as (select r, doc_id, i, sum(case when gap is null or gap > {LEAST} then 1 else 0 end) over (partition by r order by i) as k from p)
select doc_id, min(i)::int as first_word, (max(i) + {LEAST} - min(i))::int as n_words from s group by r, doc_id, k
"""
