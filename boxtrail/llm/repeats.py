"""Removal of repeated byte strings: every byte that a string of `length` bytes covers that also starts earlier.

The longest-previous-factor array says how far the suffix at a place matches one that starts before it; in suffix order
the best earlier match of a place stands next to it among the previous and next smaller places. Here that order is split
over a corpus, and only what can reach `length` bytes is looked at:

1. Anchors. Of the hashes of `gram`-byte grams in each `length`-byte window, the smallest is an anchor. Equal windows have
   equal anchors at equal places, and about one place in thirty is one. Anchors go to shards by hash.
2. A shard orders its anchors by gram, then by 128 bits of hashes of all that windows around them can hold (the context), then by
   place. Of equal contexts, all but the first one are covered whole. Grams with several contexts remain: the first place
   of each asks for its bytes.
3. Those contexts meet by gram. Suffixes that start in them and have an equal partner by hash are put in the order of their bytes
   (to `length` of them), with the longest common prefixes of neighbours; previous and next smaller places in that order give each
   suffix its longest previous factor (`factors`), and those of `length` bytes are covered. Only bytes decide here. Suffixes go in
   passes of about `suffixes_per_pass`, equal ones together: only equal ones reach `length` bytes, so no other pass matters to them.
   Grams that a sample of `sample_docs` texts shows to stand in `hot` places or more go another way in both steps: as rows
   whose smallest place is an aggregate (combined before the shuffle) and that a splittable join holds against it, so no
   task meets all places of one gram. There an equal 128-bit hash stands for equal bytes.
4. Covered stretches return to their documents, are merged and cut out.

Places are ordered by id (nulls first), then by the hash of the text (xxhash64 behind a seed, see `text_hash`), then by offset. Documents of equal
text are one text that starts at the smallest id; at any other id it is removed whole if it has `length` bytes. Rows that repeat
both id and text are one document and get equal results. Null and empty texts have no bytes. Strings are judged on the input. Other columns
aren't read; an empty table gives an empty one. Should two texts ever share a hash, which a second one tells, all is done again
with another seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.kit import BYTE_CODE, drop_written, mix, passes, place_keys, rolling, shards, tidy, utf8, written

#: Stands for a null id, before all others.
NO_ID = -(2**63)


@dataclass(frozen=True)
class Params:
    length: int = 100
    gram: int = 32
    anchors_per_shard: int = 1_000_000
    contexts_per_shard: int = 50_000
    sample_docs: int = 20_000
    hot: int = 200_000
    suffixes_per_pass: int = 65_536
    seed: int = 0

    @property
    def span(self) -> int:
        """Places of a gram in a window."""
        return self.length - self.gram + 1

    @property
    def before(self) -> int:
        """Bytes before an anchor that a window can hold."""
        return self.length - self.gram


def _sliding(x: np.ndarray, size: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every window of size values."""
    op, fill = (np.minimum, np.uint64(2**64 - 1)) if least else (np.maximum, np.uint64(0))
    n = len(x)
    rows = np.concatenate((x, np.full(-n % size, fill, np.uint64))).reshape(-1, size)
    ahead = op.accumulate(rows, axis=1).ravel()
    behind = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - size + 1], ahead[size - 1 : n])


def _stretches(data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Multilinear hashes of the stretches of size bytes from each start on."""
    keys, cells, out = place_keys(size), np.arange(size), np.empty(len(start), np.uint64)
    code = BYTE_CODE[data]
    for a in range(0, len(start), 1024):  # few enough to stay in the cache
        out[a : a + 1024] = code[start[a : a + 1024, None] + cells] @ keys
    return mix(out)


def _edge_contexts(data: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the contexts of anchors near a text's ends: of the bytes that are there, and how many."""
    cells, width = np.arange(-p.before, p.length), p.before + p.length
    keys, one, two = place_keys(2 * width), np.empty(len(place), np.uint64), np.empty(len(place), np.uint64)
    for a in range(0, len(place), 1024):
        k = slice(a, a + 1024)
        code = BYTE_CODE[data[np.clip(place[k, None] + cells, 0, len(data) - 1)]]
        code[(cells < -left[k, None]) | (cells >= right[k, None])] = 0
        one[k], two[k] = code @ keys[:width], code @ keys[width:]
    sides = mix((left * 1000 + right + 1).astype(np.uint64))
    return mix(one + sides), mix(two + sides)


def anchors(data: np.ndarray, at: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, row, gram hash and two context hashes of all anchors in texts that lie one behind the other."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), *(np.zeros(0, np.uint64) for _ in range(3))
    if len(data) < p.length:
        return none
    h = mix(rolling(data, p.gram))
    low = _sliding(h, p.span, True)
    row_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    low[row_of[: len(low)] != row_of[p.length - 1 :]] = 0  # a window in two texts is none
    edge = np.zeros(p.span - 1, np.uint64)
    place = np.flatnonzero(_sliding(np.concatenate((edge, low, edge)), p.span, False)[: len(h)] == h)
    place = place[h[place] != 0]
    if not len(place):
        return none
    row = row_of[place]
    left, right = np.minimum(place - at[row], p.before), np.minimum(at[row + 1] - place, p.length)
    context, second = np.empty(len(place), np.uint64), np.empty(len(place), np.uint64)
    whole = (left == p.before) & (right == p.length)
    if whole.any():
        context[whole] = mix(rolling(data, p.before + p.length)[place[whole] - p.before])
        second[whole] = _stretches(data, place[whole] - p.before, p.before + p.length)
    ends = np.flatnonzero(~whole)
    context[ends], second[ends] = _edge_contexts(data, place[ends], left[ends], right[ends], p)
    return place, row, h[place], context, second


def factors(lcp: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Longest previous factors of suffixes in suffix order: the larger one of the common prefixes with the previous and with the next
    suffix in that order that starts at a smaller place. lcp[i] is the common prefix with the suffix before (lcp[0] counts as 0).
    Both neighbours are found over tables of the least place and the least prefix of 1, 2, 4 ... suffixes."""
    n = len(place)
    if not n:
        return np.zeros(0, np.int64)
    lcp = np.append(lcp, 0).astype(np.int32)
    lcp[0] = 0
    places, prefixes = [place], [lcp]
    while 2 * (step := 1 << (len(places) - 1)) <= n:
        places.append(np.minimum(places[-1][:-step], places[-1][step:]))
        prefixes.append(np.minimum(prefixes[-1][:-step], prefixes[-1][step:]))
    before, shared = np.arange(n), lcp[:-1].copy()  # everything from `before` on starts no earlier
    behind, common = np.arange(1, n + 1), lcp[1:].copy()
    for k in reversed(range(len(places))):
        step, last = 1 << k, len(places[k]) - 1
        back = before - step
        on = np.flatnonzero((back >= 0) & (places[k][np.maximum(back, 0)] >= place))
        shared[on] = np.minimum(shared[on], prefixes[k][back[on]])
        before[on] = back[on]
        on = np.flatnonzero((behind <= last) & (places[k][np.minimum(behind, last)] >= place))
        common[on] = np.minimum(common[on], prefixes[k][behind[on] + 1])
        behind[on] += step
    shared[before == 0], common[behind == n] = 0, 0
    return np.maximum(shared, common).astype(np.int64)


def suffix_order(raw: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of raw by their bytes, then place; and what each shares with the one before it. Rows of equal key are
    taken for equal and one of each is sorted; where bytes say otherwise, all are."""
    width = raw.shape[1]
    as_one = lambda rows: np.ascontiguousarray(rows).view(f"V{width}").ravel()
    _, first, block = np.unique(key, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(as_one(raw[first]), kind="stable")] = np.arange(len(first))
    order = np.lexsort((place, rank[block]))

    def shared(order: np.ndarray) -> np.ndarray:
        out = np.zeros(len(order), np.int64)
        for a in range(1, len(order), 8192):
            k = np.arange(a, min(a + 8192, len(order)))
            differ = raw[order[k]] != raw[order[k - 1]]
            out[k] = np.where(differ.any(1), differ.argmax(1), width)
        return out

    lcp = shared(order)
    if ((lcp[1:] < width) & (block[order[1:]] == block[order[:-1]])).any():
        _, rank = np.unique(as_one(raw), return_inverse=True)
        order = np.lexsort((place, rank))
        lcp = shared(order)
    return order, lcp


def _runs(order_key: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], order_key[1:] != order_key[:-1])) if len(order_key) else np.zeros(0, bool)


def _hot_grams(texts: DataFrame, rows: int, p: Params) -> np.ndarray:
    """Hashes of grams that seem to stand in p.hot places or more, sorted: at most a share of the sample's anchors."""
    step = max(1, rows // p.sample_docs)
    least = max(2, -(-p.hot // step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            got = [anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], p)[2] for i, j in passes(offsets)]
            gram, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            for a in range(0, len(gram), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(gram[a : a + 100_000].view(np.int64)), pa.array(n[a : a + 100_000], pa.int64())], ["gram", "n"])
            tidy()

    part = texts.where(F.pmod(F.xxhash64("t"), F.lit(step)) == 0)
    found = part.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r.gram for r in found.select("gram").collect()], np.int64).view(np.uint64))


def _is_hot(gram: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(gram), bool)
    return hot[np.minimum(np.searchsorted(hot, gram), len(hot) - 1)] == gram


def _hot_matches(texts: DataFrame, hot: np.ndarray, p: Params) -> DataFrame:
    """_FOUND for hot grams: all but the first place of a context are covered, the first ones ask for their bytes."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tids = batch.column(0).fill_null(NO_ID).to_numpy(), batch.column(1).to_numpy()
            data, offsets = utf8(batch.column(2))
            for i, j in passes(offsets):
                at = offsets[i : j + 1] - offsets[i]
                found = anchors(data[offsets[i] : offsets[j]], at, p)
                on = _is_hot(found[2], shared.value)
                place, row, gram, context, second = (x[on] for x in found)
                inside = place - at[row]
                left, right = np.minimum(inside, p.before), np.minimum(at[row + 1] - place, p.length)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram.view(np.int64), context.view(np.int64), second.view(np.int64), ids[i + row], tids[i + row], inside.astype(np.int32), (inside - left).astype(np.int32), (inside + right).astype(np.int32))], ["gram", "context", "second", "id", "tid", "place", "begin", "end"])
            tidy()

    rows = texts.mapInArrow(run, "gram long, context long, second long, id long, tid long, place int, begin int, end int")
    rows = written(rows.groupBy("gram", "context", "second", "tid", "place", "begin", "end").agg(F.min("id").alias("id")), "hot")  # copies of a text are one
    first = rows.groupBy("gram", "context", "second").agg(F.min(F.struct("id", "tid", "place")).alias("first"))
    known = rows.join(first, ["gram", "context", "second"]).withColumn("is_first", F.struct("id", "tid", "place") == F.col("first"))
    covered = known.where(~F.col("is_first") & (F.col("end") - F.col("begin") >= p.length)).select(F.lit(0).alias("kind"), "tid", "id", F.col("begin").alias("place"), "end", "gram")
    return covered.unionByName(known.where("is_first").select(F.lit(2).alias("kind"), "tid", "id", "place", F.col("place").alias("end"), "gram"))


def _hot_windows(asked: DataFrame, p: Params) -> DataFrame:
    """(tid, place, end) of windows around hot grams that start earlier too. asked as for _send_contexts()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(batch.num_rows):
                text = np.frombuffer(batch.column(2)[x].as_py().encode(), np.uint8)
                centers = np.unique(np.array([w["place"] for w in batch.column(3)[x].as_py()], np.int64))
                start = np.unique((centers[:, None] - np.arange(p.span)).ravel())
                start = start[(start >= 0) & (start + p.length <= len(text))]
                one, two = rolling(text, p.length), _stretches(text, start, p.length)
                doc = batch.column(0)[x].as_py()
                n = len(start)
                yield pa.RecordBatch.from_arrays([pa.array(mix(one[start]).view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(n, NO_ID if doc is None else doc)), pa.array(np.full(n, batch.column(1)[x].as_py())), pa.array(start.astype(np.int32))], ["k1", "k2", "id", "tid", "place"])

    rows = written(asked.mapInArrow(run, "k1 long, k2 long, id long, tid long, place int").distinct(), "windows")
    first = rows.groupBy("k1", "k2").agg(F.min(F.struct("id", "tid", "place")).alias("first"))
    return rows.join(first, ["k1", "k2"]).where(F.struct("id", "tid", "place") > F.col("first")).select("tid", "place", (F.col("place") + p.length).cast("int").alias("end"))


def _send_anchors(texts: DataFrame, hot: np.ndarray, n_shards: int, p: Params) -> DataFrame:
    """Blobs by shard: of texts (id, tid), and of anchors that aren't hot (text in the blob, place, bytes before and after
    it, hashes)."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tids = batch.column(0).fill_null(NO_ID).to_numpy(), batch.column(1).to_numpy()
            first = np.lexsort((ids, tids))
            new = _runs(tids[first])
            keep = np.sort(first[new])  # one row of each text: the one with the smallest id
            part = batch.column(2).take(pa.array(keep))
            ids, tids = ids[keep], tids[keep]
            data, offsets = utf8(part)
            got: list[list[np.ndarray]] = []
            for i, j in passes(offsets):
                at = offsets[i : j + 1] - offsets[i]
                place, row, gram, context, second = anchors(data[offsets[i] : offsets[j]], at, p)
                inside = place - at[row]
                got.append([(i + row).astype(np.int32), inside.astype(np.int32), np.minimum(inside, p.before).astype(np.uint8), np.minimum(at[row + 1] - place, p.length).astype(np.uint8), gram, context, second])
            if not got:
                continue
            cols = [np.concatenate([g[x] for g in got]) for x in range(7)]
            cold = ~_is_hot(cols[4], shared.value)
            cols = cols if cold.all() else [c[cold] for c in cols]
            shard = (cols[4] >> np.uint64(24)) % np.uint64(n_shards)
            order = np.argsort(shard, kind="stable")
            cols, shard = [c[order] for c in cols], shard[order]
            cut = np.append(np.flatnonzero(_runs(shard)), len(shard))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                used, local = np.unique(cols[0][a:b], return_inverse=True)
                parts = [ids[used], tids[used], local.astype(np.int32), *(c[a:b] for c in cols[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([int(shard[a])], pa.int32())] + [pa.array([x.tobytes()], pa.binary()) for x in parts], ["shard", "id", "tid", "text", "place", "left", "right", "gram", "context", "second"])
            del got, cols, order, shard
            tidy()

    return texts.mapInArrow(run, "shard int, id binary, tid binary, text binary, place binary, left binary, right binary, gram binary, context binary, second binary")


_FOUND = "kind int, tid long, id long, place int, end int, gram long"


def _match_anchors(p: Params):
    """Of a shard: stretches that are covered (kind 0: place to end), and anchors whose bytes are asked for (kind 1)."""

    def run(table: pa.Table) -> pa.Table:
        names = {"id": np.int64, "tid": np.int64, "text": np.int32, "place": np.int32, "left": np.uint8, "right": np.uint8, "gram": np.uint64, "context": np.uint64, "second": np.uint64}
        blobs = [[np.frombuffer(b.as_buffer(), k) for b, k in zip(blob, names.values(), strict=True)] for blob in zip(*(table.column(c) for c in names), strict=True)]
        # only grams that stand in two places, in one text or in several
        gram = np.concatenate([x[6] for x in blobs])
        order = np.argsort(gram, kind="stable")
        number = np.cumsum(_runs(gram[order])) - 1
        some = np.zeros(len(gram), bool)
        some[order] = (np.bincount(number) > 1)[number] if len(order) else False
        del gram, order, number
        cols: list[list[np.ndarray]] = [[] for _ in range(8)]
        a = 0
        for x in blobs:
            on = some[a : a + len(x[6])]
            text = x[2][on]
            for c, v in zip(cols, (x[0][text], x[1][text], *(v[on] for v in x[3:])), strict=True):
                c.append(v)
            a += len(on)
        ids, tid, place, left, right, gram, context, second = (np.concatenate(c) for c in cols)
        del blobs, cols, some
        order = np.lexsort((place, tid, ids, second, context, gram))
        # of copies of a text that came from several tasks, the one with the smallest id stays
        same = np.lexsort((ids, place, tid, gram))
        keep = np.zeros(len(gram), bool)
        keep[same[_runs(gram[same]) | _runs(tid[same]) | _runs(place[same])]] = True
        order = order[keep[order]]
        del same, keep
        ids, tid, place, left, right, gram, context, second = (c[order] for c in (ids, tid, place, left, right, gram, context, second))
        new_gram = _runs(gram)
        first = new_gram | _runs(context) | _runs(second)
        number = np.cumsum(new_gram) - 1
        contexts = np.bincount(number, weights=first) if len(number) else np.zeros(0)
        ask = np.flatnonzero(first & (contexts > 1)[number]) if len(number) else np.zeros(0, np.int64)
        gone = np.flatnonzero(~first & (left.astype(np.int64) + right >= p.length))
        begin, end = place[gone] - left[gone], place[gone] + right[gone].astype(np.int32)
        both = lambda x, y, t: pa.array(np.concatenate((x, y)), t)
        found = pa.table(
            {
                "kind": both(np.zeros(len(gone), np.int32), np.ones(len(ask), np.int32), pa.int32()), "tid": both(tid[gone], tid[ask], pa.int64()), "id": both(ids[gone], ids[ask], pa.int64()),
                "place": both(begin, place[ask], pa.int32()), "end": both(end, place[ask], pa.int32()), "gram": both(gram[gone].astype(np.int64), gram[ask].astype(np.int64), pa.int64()),
            }
        )
        del ids, tid, place, left, right, gram, context, second, order, new_gram, first, number, contexts, ask, gone, begin, end
        tidy()
        return found

    return run


def _send_contexts(asked: DataFrame, n_shards: int, p: Params) -> DataFrame:
    """asked: id, tid, t, wanted (array of place and gram). Blobs by shard of the contexts' bytes."""
    width = p.before + p.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(0, batch.num_rows, 256):
                part = batch.slice(x, 256)
                data, offsets = utf8(part.column(2))
                wanted = part.column(3)
                count = wanted.value_lengths().to_numpy()
                flat = wanted.flatten()
                place, gram = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy()
                row = np.repeat(np.arange(part.num_rows), count)
                if not len(row):
                    continue
                left, right = np.minimum(place, p.before), np.minimum(offsets[row + 1] - offsets[row] - place, p.length)
                ids, tid = part.column(0).fill_null(NO_ID).to_numpy()[row], part.column(1).to_numpy()[row]
                shard = (gram.view(np.uint64) >> np.uint64(24)) % np.uint64(n_shards)
                order = np.argsort(shard, kind="stable")
                cut = np.append(np.flatnonzero(_runs(shard[order])), len(order))
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    k = order[a:b]
                    spot = (offsets[row[k]] + place[k])[:, None] + np.arange(-p.before, p.length)
                    raw = data[np.clip(spot, 0, len(data) - 1)]
                    cells = np.arange(-p.before, p.length)
                    raw[(cells < -left[k][:, None]) | (cells >= right[k][:, None])] = 0
                    parts = [ids[k], tid[k], place[k].astype(np.int32), left[k].astype(np.uint8), right[k].astype(np.uint8), gram[k], raw]
                    yield pa.RecordBatch.from_arrays([pa.array([int(shard[k[0]])], pa.int32())] + [pa.array([v.tobytes()], pa.binary()) for v in parts], ["shard", "id", "tid", "place", "left", "right", "gram", "raw"])

    assert width < 256
    return asked.mapInArrow(run, "shard int, id binary, tid binary, place binary, left binary, right binary, gram binary, raw binary")


def _reached(raw: np.ndarray, on: np.ndarray, key: np.ndarray, first: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of the suffixes in on (by row of raw and cell, as key is) have a longest previous factor of n bytes; first is the place of a
    row's cell 0. Equal suffixes have equal keys. Where there are over 2 * size, lots of rows go first, and only suffixes without a factor
    in their lot meet again: of equal ones the first of each lot."""
    suffix, out = np.lib.stride_tricks.sliding_window_view(raw, n, axis=1), np.zeros(on.shape, bool)

    def settle(a: int, b: int) -> None:
        r, w = np.nonzero(on[a:b])
        r += a
        order = np.argsort(key[r, w], kind="stable")
        number = np.cumsum(_runs(key[r, w][order])) - 1
        order = order[(np.bincount(number) > 1)[number]] if len(order) else order  # those with a partner
        r, w = r[order], w[order]
        start = first[r] + w
        order, lcp = suffix_order(suffix[r, w], key[r, w], start)
        order = order[factors(lcp, start[order]) >= n]
        out[r[order], w[order]] = True

    if np.count_nonzero(on) > 2 * size:
        for a, b in passes(np.concatenate(([0], np.cumsum(on.sum(1)))), size):
            settle(a, b)
        on = on & ~out
    settle(0, len(on))
    return out


def _match_contexts(p: Params, lot: int = 4096):
    """Of a shard's contexts: the stretches (tid, place, end) that windows with an earlier match cover."""
    width, n = p.before + p.length, p.length

    def windows(ids, tid, place, left, right, gram, raw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whole grams only: rows sorted by gram."""
        rows = len(gram)
        order = np.lexsort((tid, ids))
        text = np.empty(rows, np.int64)
        text[order] = np.cumsum(_runs(ids[order]) | _runs(tid[order]))  # texts in the order of the corpus
        back = p.before - np.arange(p.span)  # how far before its anchor a window begins
        real = (back <= left[:, None]) & (n - back <= right[:, None])  # cells outside the text take no part
        # a window's hash, by place in its context, and the pass that it goes to
        n_passes = -(-int(real.sum()) // p.suffixes_per_pass)
        key, turn = np.empty((rows, p.span), np.uint64), np.empty((rows, p.span), np.min_scalar_type(n_passes))
        for a in range(0, rows, 512):
            k = slice(a, a + 512)
            key[k] = mix(_rolling_rows(raw[k], n))
            turn[k] = np.where(real[k], key[k] % np.uint64(max(n_passes, 1)), n_passes)
        hit = np.zeros((rows, p.span), bool)
        first = (text << 32) + place - p.before
        for i in range(n_passes):
            hit |= _reached(raw, turn == i, key, first, n, p.suffixes_per_pass)
        edge = np.zeros((rows, 1), bool)
        r, w = np.nonzero(hit & ~np.hstack((edge, hit[:, :-1])))
        last = np.nonzero(hit & ~np.hstack((hit[:, 1:], edge)))[1]
        start = place[r] - p.before + w
        return tid[r], start, start + (last - w) + n

    def run(table: pa.Table) -> pa.Table:
        kinds = {"id": np.int64, "tid": np.int64, "place": np.int32, "left": np.uint8, "right": np.uint8, "gram": np.uint64, "raw": np.uint8}
        col = {c: np.concatenate([np.frombuffer(x.as_buffer(), k) for x in table.column(c)]) for c, k in kinds.items()}
        raw = col.pop("raw").reshape(-1, width)
        order = np.lexsort((col["place"], col["tid"], col["gram"]))
        same = ~(_runs(col["place"][order]) | _runs(col["tid"][order]) | _runs(col["gram"][order]))
        order = order[~same]  # a row that was repeated sent its contexts twice
        ids, tid, place, left, right, gram = (col[c][order] for c in ("id", "tid", "place", "left", "right", "gram"))
        place, left, right = place.astype(np.int64), left.astype(np.int64), right.astype(np.int64)
        begin = np.append(np.flatnonzero(_runs(gram)), len(gram))
        out: list[tuple] = []
        a = 0
        while a < len(begin) - 1:
            b = max(a + 1, int(np.searchsorted(begin, begin[a] + lot, "right")) - 1)
            k = slice(int(begin[a]), int(begin[b]))
            out.append(windows(ids[k], tid[k], place[k], left[k], right[k], gram[k], raw[order[k]]))
            a = b
        t, s, e = (np.concatenate([np.zeros(0, np.int64)] + [o[x] for o in out]) for x in range(3))
        del col, raw, order, same, ids, tid, place, left, right, gram, begin, out
        tidy()
        return pa.table({"tid": pa.array(t, pa.int64()), "place": pa.array(s.astype(np.int32), pa.int32()), "end": pa.array(e.astype(np.int32), pa.int32())})

    return run


def _rolling_rows(raw: np.ndarray, n: int) -> np.ndarray:
    """rolling() of each row of a matrix."""
    rows, width = raw.shape
    flat = rolling(raw.ravel(), n)
    out = np.zeros(rows * width, np.uint64)
    out[: len(flat)] = flat
    return out.reshape(rows, width)[:, : width - n + 1]


def text_hash(text: Column, seed: int) -> Column:
    """64 bits of a text, others with each seed."""
    return F.xxhash64(F.lit(seed), text)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """A row for each row of docs: id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the other bytes)."""
    p = params
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_hash(text, p.seed).alias("tid"), text.alias("t"))
    long = texts.where(F.octet_length("t") >= p.length)
    other = text_hash(F.col("t"), ~p.seed)
    firsts = written(long.groupBy("tid").agg(F.min(F.coalesce("id", F.lit(NO_ID))).alias("first"), F.min(other).alias("x"), F.max(other).alias("y")), "firsts")
    if not firsts.where("x <> y").isEmpty():  # two texts with one hash
        drop_written(firsts)
        return remove_repeats(docs, id_col, text_col, replace(p, seed=p.seed + 1))
    total = texts.agg(F.sum(F.octet_length("t")).alias("b"), F.count("*").alias("n")).first()
    hot = _hot_grams(long, total.n, p)
    blobs = _send_anchors(long, hot, shards(spark, (total.b or 0) / p.span * 2, p.anchors_per_shard), p)
    found = blobs.groupBy("shard").applyInArrow(_match_anchors(p), _FOUND)
    found = written(found.unionByName(_hot_matches(long, hot, p)) if len(hot) else found, "found")

    def asked(kind: int) -> DataFrame:
        """id, tid, t and the places whose bytes are asked for, at the text's first id."""
        wanted = found.where(F.col("kind") == kind).groupBy("tid", F.col("id").alias("first")).agg(F.collect_list(F.struct("place", "gram")).alias("wanted"))
        return long.join(wanted, "tid").where(F.coalesce("id", F.lit(NO_ID)) == F.col("first")).select("id", "tid", "t", "wanted")

    contexts = _send_contexts(asked(1), shards(spark, found.where("kind = 1").count(), p.contexts_per_shard), p)
    more = contexts.groupBy("shard").applyInArrow(_match_contexts(p), "tid long, place int, end int")
    more = written(more.unionByName(_hot_windows(asked(2), p)) if len(hot) else more, "covered")
    covered = found.where("kind = 0").select("tid", "place", "end").unionByName(more).groupBy("tid").agg(F.collect_list(F.struct("place", "end")).alias("covered"))
    about = firsts.select("tid", "first").join(covered, "tid", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(0, batch.num_rows, 256):
                part = batch.slice(x, 256)
                raw = [t.encode() for t in part.column(1).to_pylist()]
                n, removed, spans, kept = [], [], [], []
                for t, copy, stretches in zip(raw, part.column(2).to_pylist(), part.column(3), strict=True):
                    n.append(len(t))
                    if copy:
                        removed.append(len(t))
                        spans.append(1)
                        kept.append(b"")
                        continue
                    if not stretches.is_valid:
                        removed.append(0)
                        spans.append(0)
                        kept.append(t)
                        continue
                    v = stretches.values
                    edge = np.zeros(len(t) + 1, np.int32)
                    np.add.at(edge, v.field(0).to_numpy(), 1)
                    np.add.at(edge, v.field(1).to_numpy(), -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    removed.append(int(gone.sum()))
                    spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    kept.append(np.frombuffer(t, np.uint8)[~gone].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], [id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    joined = texts.join(about, "tid", "left").select("id", "t", (F.coalesce("id", F.lit(NO_ID)) != F.col("first")).alias("copy"), "covered")
    return joined.mapInArrow(cut, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return removed.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
