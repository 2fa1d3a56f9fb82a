"""Benchmark decontamination: CGK embeddings, bit-sampling LSH over windows, exact edit distance.

Texts and items are compared as bytes, ASCII letters lowered and every white byte a blank. A document contains an item
if some stretch of it is at most (1 - similarity) of the item's length away in edit distance.

1. Embedding (CGK): a walk reads the byte it stands on and steps ahead or stays, by a random bit for that step and byte. Two strings a
   few edits apart soon walk in step again, so edit distance becomes Hamming distance between what the walks read.
2. LSH: a table takes `sample` steps of a walk as its key. Every place of every item is embedded and stands in all tables; of the texts, every
   `stride`-th place is. So a match as long as its item holds several places of the text that can find it, each in `tables` tables,
   whatever the shift between item and text.
3. Where a place of the text and one of an item agree in a table, their walks are compared whole. From `agree` of all steps on, and if
   the STRETCH bytes of the item there are at most PIECE_EDITS of them away from the text (twice what a match has on average),
   the item's window around the place is verified exactly (Sellers' search with Myers' bit vectors).

Measured on the 200 items (81 to 394 bytes) of the check tables' benchmark, put into prose of the corpus, recall is 0.99 or more for
edits of up to 16 % of the item, spread evenly or at random, and 0.95 for evenly spread ones of 20 % (README); the target is
`target`. What is found is exact.
Items of `short` to `long` bytes have tables and a stride of their own (TIERS). Those below are searched exactly in the whole
text, at some ten times the cost of an embedded text for each; those of under `least` bytes are too short for edits and match only as they stand. An
empty item matches nothing.

Items go out as broadcasts of at most about `block_bytes`; one scan of the texts takes a batch of them through all blocks. Null
texts are empty and hold nothing; null ids stay. Repeated document rows give repeated results; an item id with several texts gives
its nearest one. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.kit import IS_SPACE, LOWER, passes, tidy, utf8

#: Pairs that are verified together, and the bytes of their texts.
LOT, LOT_BYTES = 16_384, 16 << 20

PLAIN = LOWER.copy()
PLAIN[IS_SPACE] = 32

#: Bytes of a lane in which short items are searched.
LANE = 256

#: Bits of a table's key that find its entries, and matchers that a worker keeps.
SPOT_BITS, KEPT = 20, 4

#: Share of the bytes of an item's stretch that edits may take where walks agree, and those bytes.
PIECE_EDITS, STRETCH = 0.4, 48

#: About how many places of an item stand in the tables, and words of bit vectors up to which many pairs are searched at once.
MOST_PLACES, MANY_WORDS = 4096, 16


@dataclass(frozen=True)
class Tier:
    """How items from some length on are looked for."""

    steps: int
    sample: int
    tables: int
    walks: int
    stride: int
    widest: int
    agree: float


#: For items of Params.short bytes or more, and for those of Params.long or more.
TIERS = (Tier(40, 8, 48, 4, 2, 5, 0.45), Tier(56, 10, 20, 2, 8, 6, 0.5))


@dataclass(frozen=True)
class Params:
    similarity: float = 0.8
    target: float = 0.95
    least: int = 12
    short: int = 40
    long: int = 80
    bin_bytes: int = 16
    block_bytes: int = 1 << 17
    seed: int = 20240229


class Searcher:
    """Least edit distances between items and any stretch of a text, for many pairs at once: Myers' bit vectors of
    64-bit words, the first row held at 0 (Sellers), so that a match may begin anywhere."""

    def __init__(self, items: list[np.ndarray]):
        self.size = np.array([len(t) for t in items], np.int64)
        self.words = np.maximum(-(-self.size // 64), 1)
        self.equal, self.whole = [], {}
        for t, k in zip(items, self.words.tolist(), strict=True):
            table = np.zeros((256, k), np.uint64)
            at = np.arange(len(t))
            np.bitwise_or.at(table, (t, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
            self.equal.append(table)

    def __call__(self, item: np.ndarray, texts: np.ndarray, length: np.ndarray) -> np.ndarray:
        """texts: a row each, of which the first `length` bytes count."""
        out = np.zeros(len(item), np.int64)
        for k in np.unique(self.words[item]).tolist():
            at = np.flatnonzero(self.words[item] == k)
            if k > MANY_WORDS:
                for x in at.tolist():
                    out[x] = self._one(int(item[x]), texts[x, : length[x]])
                continue
            for a in range(0, len(at), 4096):
                part = at[a : a + 4096]
                out[part] = self._same_words(k, item[part], texts[part], length[part])
        return out

    def _one(self, item: int, text: np.ndarray) -> int:
        """The same search for one pair, in whole numbers of any length."""
        if item not in self.whole:
            self.whole[item] = [int.from_bytes(row.tobytes(), "little") for row in self.equal[item]]
        equal, n = self.whole[item], int(self.size[item])
        every, last = (1 << n) - 1, 1 << (n - 1)
        up, down, score = every, 0, n
        best = n
        for c in text.tolist():
            eq = equal[c]
            x = eq | down
            d0 = ((((x & up) + up) ^ up) | x) & every
            hp, hn = down | (every & ~(d0 | up)), up & d0
            if hp & last:
                score += 1
            elif hn & last:
                score -= 1
                best = min(best, score)
            hp, hn = (hp << 1) & every, (hn << 1) & every
            up, down = hn | (every & ~(d0 | hp)), hp & d0
        return best

    def _same_words(self, k: int, item: np.ndarray, texts: np.ndarray, length: np.ndarray) -> np.ndarray:
        used, inv = np.unique(item, return_inverse=True)
        equal = np.stack([self.equal[j] for j in used.tolist()])
        n = self.size[item]
        one, top = np.uint64(1), np.maximum(n - 1, 0) % 64
        last = one << top.astype(np.uint64)
        up = [np.full(len(item), 2**64 - 1, np.uint64) for _ in range(k)]
        down = [np.zeros(len(item), np.uint64) for _ in range(k)]
        score, best = n.copy(), n.copy()
        texts = np.ascontiguousarray(texts.T)
        for t in range(int(length.max()) if len(length) else 0):
            eq = equal[inv, texts[t]]
            carry = hp_in = hn_in = np.uint64(0)
            for w in range(k):
                x = eq[:, w] | down[w]
                a = x & up[w]
                s = a + up[w]
                over = s < a
                s2 = s + carry
                carry = (over | (s2 < s)).astype(np.uint64)
                d0 = (s2 ^ up[w]) | x
                hp, hn = down[w] | ~(d0 | up[w]), up[w] & d0
                if w == k - 1:
                    score = score + ((hp & last) != 0) - ((hn & last) != 0)
                hp_s, hn_s = (hp << one) | hp_in, (hn << one) | hn_in
                hp_in, hn_in = hp >> np.uint64(63), hn >> np.uint64(63)
                up[w], down[w] = hn_s | ~(d0 | hp_s), hp_s & d0
            best = np.where(t < length, np.minimum(best, score), best)
        return best


def nearest(item: bytes, text: bytes) -> int:
    """Least edit distance between item and any stretch of text."""
    if not item:
        return 0
    row = np.frombuffer(text, np.uint8)[None]
    return int(Searcher([np.frombuffer(item, np.uint8)])(np.zeros(1, np.int64), row, np.array([len(text)]))[0])


class Index:
    """The places of some items in the tables of a tier."""

    def __init__(self, items: list[int], texts: list[np.ndarray], tier: Tier, seed: int):
        rng = np.random.default_rng(seed)
        self.tier = t = tier
        self.bits = rng.integers(0, 2, (t.walks, t.steps, 256), dtype=np.int64)
        self.tables = []
        for k in range(t.tables):
            at = np.cumsum(rng.integers(2, t.widest + 1, t.sample))
            at += rng.integers(0, max(1, t.steps - int(at[-1]))) - at[0]
            self.tables.append((k % t.walks, np.minimum(at, t.steps - 1), rng.integers(0, 2**31, t.sample).astype(np.uint32) * np.uint32(2) + np.uint32(1)))
        size = np.array([len(texts[j]) for j in items], np.int64)
        data = np.concatenate([np.concatenate((texts[j], np.zeros(t.steps, np.uint8))) for j in items])
        first = np.cumsum(size + t.steps) - size - t.steps
        # a match of a long item holds the more places of the text: some thousand places of the item are enough
        places = [np.arange(0, n, max(1, n // MOST_PLACES), dtype=np.int32) for n in size.tolist()]
        count = [len(x) for x in places]
        self.item, self.at = np.repeat(np.array(items, np.int32), count), np.concatenate(places)
        walked = self.embed(data, np.repeat(first, count) + self.at)
        self.walked = np.ascontiguousarray(walked.reshape(t.walks * t.steps, -1).T).astype(np.uint8)
        self.known = []
        for table in self.tables:
            key = self.keys(walked, table)
            order = np.argsort(key, kind="stable").astype(np.int32)
            key = key[order]
            spot = np.zeros(1 << SPOT_BITS, bool)
            spot[key >> np.uint32(32 - SPOT_BITS)] = True
            self.known.append((np.packbits(spot, bitorder="little"), key, order))
        self._pieces(items, texts)

    def _pieces(self, items: list[int], texts: list[np.ndarray]) -> None:
        """Stretches of the items, one near each place in the tables: at most STRETCH bytes, beginning at multiples of 16."""
        number, pieces, begin = {}, [], []
        self.piece = np.empty(len(self.item), np.int32)
        for x, (j, at) in enumerate(zip(self.item.tolist(), self.at.tolist(), strict=True)):
            first = max(min((at - 8) // 16 * 16, len(texts[j]) - STRETCH), 0)
            if (j, first) not in number:
                number[j, first] = len(pieces)
                pieces.append(texts[j][first : first + STRETCH])
                begin.append(first)
            self.piece[x] = number[j, first]
        self.begin, self.search = np.array(begin, np.int64), Searcher(pieces)

    def _alike(self, data: np.ndarray, place: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Whether the item's stretch at the place is at most PIECE_EDITS of its length away from the text there."""
        piece = self.piece[entry]
        first = place - self.at[entry] + self.begin[piece] - 8
        size = self.search.size[piece] + 16
        low = np.clip(first, 0, len(data))
        length = np.clip(first + size, 0, len(data)) - low
        text = data[np.minimum(low[:, None] + np.arange(STRETCH + 16), len(data) - 1)]
        return self.search(piece, text, length) <= PIECE_EDITS * self.search.size[piece]

    def embed(self, data: np.ndarray, start: np.ndarray) -> np.ndarray:
        """What the walks read from each start on: (walks, steps, starts). Behind the data they read zeros."""
        t = self.tier
        wide = np.zeros(len(data) + t.steps, np.int64)
        wide[: len(data)] = data
        out = np.empty((t.walks, t.steps, len(start)), np.uint32)
        read, step = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        for w in range(t.walks):
            at = start.astype(np.int64)
            for j in range(t.steps):
                np.take(wide, at, out=read, mode="clip")
                out[w, j] = read
                np.take(self.bits[w, j], read, out=step, mode="clip")
                at += step
        return out

    @staticmethod
    def keys(walked: np.ndarray, table: tuple) -> np.ndarray:
        w, at, factor = table
        key = walked[w, at[0]] * factor[0]
        part = np.empty_like(key)
        for j, f in zip(at[1:].tolist(), factor[1:], strict=True):
            np.multiply(walked[w, j], f, out=part)
            key += part
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x2C1B3C6D)
        key ^= key >> np.uint32(12)
        return key

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item, and where it would begin in data, for places whose walks agree."""
        t = self.tier
        start = np.arange(0, len(data), t.stride)
        walked = self.embed(data, start)
        n = len(self.item)
        found = [np.zeros(0, np.int64)]
        for table, (spot, key, order) in zip(self.tables, self.known, strict=True):
            mine = self.keys(walked, table)
            bit = spot.take(mine >> np.uint32(32 - SPOT_BITS + 3)) >> (mine >> np.uint32(32 - SPOT_BITS) & np.uint32(7)).astype(np.uint8)
            on = np.flatnonzero(bit & np.uint8(1))
            low = np.searchsorted(key, mine[on], "left")
            some = key[np.minimum(low, n - 1)] == mine[on]
            on, low = on[some], low[some]
            times = np.searchsorted(key, mine[on], "right") - low
            entry = order[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())]
            found.append(np.repeat(on, times) * n + entry)
        both = np.unique(np.concatenate(found))
        place, entry = both // n, both % n
        flat, keep = walked.reshape(-1, len(start)), np.zeros(len(both), bool)
        for a in range(0, len(both), 8192):
            k = slice(a, a + 8192)
            keep[k] = (flat[:, place[k]].T == self.walked[entry[k]]).mean(1) >= t.agree
        place, entry = place[keep], entry[keep]
        alike = [self._alike(data, start[place[a : a + LOT]], entry[a : a + LOT]) for a in range(0, len(place), LOT)]
        on = np.concatenate([np.zeros(0, bool), *alike])
        place, entry = place[on], entry[on]
        return self.item[entry].astype(np.int64), start[place] - self.at[entry]


class Matcher:
    """Everything that is known of a block of items."""

    def __init__(self, items: list[tuple], p: Params):
        self.p = p
        self.ids, self.texts = [i for i, _ in items], [PLAIN[np.frombuffer(t.encode(), np.uint8)] for _, t in items]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.most = np.floor(self.size * (1 - p.similarity) + 1e-9).astype(np.int64)
        self.most[self.size < p.least] = 0
        tier_of = np.searchsorted([1, p.short, p.long], self.size, "right") - 2  # -2 and -1: none, scanned for
        self.scan = np.flatnonzero(tier_of == -1).tolist()
        self.indexes = [Index(np.flatnonzero(tier_of == k).tolist(), self.texts, tier, p.seed + k) for k, tier in enumerate(TIERS) if (tier_of == k).any()]
        self.search = Searcher(self.texts)

    def windows(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and start of the windows to verify; a window stands for those that begin in the same bin."""
        none = np.zeros(0, np.int64)
        got = [x.hits(data) for x in self.indexes if len(data)]
        item, start = (np.concatenate([none, *c]) for c in (zip(*got, strict=True) if got else ((), ())))
        if not len(item):
            return none, none, none
        # rows that the item can lie in: near a row's edge there are two, or more if rows are short
        reach = self.most[item]
        first = np.searchsorted(at, np.maximum(start - reach, 0), "right") - 1
        last = np.searchsorted(at, np.minimum(start + self.size[item] + reach, len(data)), "left")
        times = np.maximum(last - first, 1)
        row = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        item, start = np.repeat(item, times), np.repeat(start, times)
        on = (row >= 0) & (row < len(at) - 1)
        row, item, start = row[on], item[on], start[on]
        on = at[row + 1] - at[row] >= self.size[item] - self.most[item]
        row, item, start = row[on], item[on], start[on]
        binned = start // self.p.bin_bytes
        order = np.lexsort((start, binned, item, row))
        row, item, start, binned = row[order], item[order], start[order], binned[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (binned[1:] != binned[:-1])
        return row[new], item[new], start[new]

    def scanned(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Row, item, first and last byte of stretches that may hold a short item."""
        for j in self.scan if len(data) else ():
            wide = LANE + int(self.size[j] + self.most[j])
            begin = np.arange(0, len(data), LANE)
            lanes = data[np.minimum(begin[:, None] + np.arange(wide), len(data) - 1)]
            length = np.minimum(wide, len(data) - begin)
            near = self.search(np.full(len(begin), j), lanes, length) <= self.most[j]
            for a, n in zip(begin[near].tolist(), length[near].tolist(), strict=True):
                for r in range(int(np.searchsorted(at, a, "right")) - 1, int(np.searchsorted(at, a + n, "left"))):
                    yield r, j, max(a, int(at[r])), min(a + n, int(at[r + 1]))

    def find(self, column: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item, distance) of everything contained."""
        data, offsets = utf8(column)
        best: dict[tuple[int, int], int] = {}
        waiting: list[tuple[int, int, np.ndarray]] = []
        held = 0

        def verify() -> None:
            """In lots, because one step over many pairs costs about as much as over a few."""
            nonlocal held
            length = np.array([len(t) for _, _, t in waiting], np.int64)
            texts = np.zeros((len(waiting), int(length.max())), np.uint8)
            for i, (_, _, t) in enumerate(waiting):
                texts[i, : len(t)] = t
            for (r, m, _), x in zip(waiting, self.search(np.array([m for _, m, _ in waiting]), texts, length).tolist(), strict=True):
                best[r, m] = min(best.get((r, m), x), x)
            waiting.clear()
            held = 0

        def wait(r: int, m: int, text: np.ndarray) -> None:
            nonlocal held
            if waiting and (len(waiting) >= LOT or max(held, len(text)) * (len(waiting) + 1) > LOT_BYTES):
                verify()
            waiting.append((r, m, text))
            held = max(held, len(text))

        for i, j in passes(offsets, 1 << 18) if len(self.texts) else ():
            d, at = PLAIN[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
            for r, m, a, b in self.scanned(d, at):
                wait(i + r, m, d[a:b])
            row, item, start = self.windows(d, at)
            slack = self.most[item] + self.p.bin_bytes
            first, last = np.maximum(at[row], start - slack), np.minimum(at[row + 1], start + self.size[item] + slack)
            for r, m, a, b in zip((i + row).tolist(), item.tolist(), first.tolist(), last.tolist(), strict=True):
                if b > a:
                    wait(r, m, d[a:b])
        if waiting:
            verify()
        return [(r, m, x) for (r, m), x in sorted(best.items()) if x <= self.most[m]]


class Matchers:
    """Of blocks of items; a worker keeps a few and makes the others anew for each batch."""

    def __init__(self, blocks: list[Broadcast], p: Params):
        self.blocks, self.p, self.kept = blocks, p, {}

    def __iter__(self) -> Iterator[Matcher]:
        for k, shared in enumerate(self.blocks):
            if k in self.kept:
                yield self.kept[k]
                continue
            path = getattr(shared, "_path", None)
            m = Matcher(shared.load_from_path(path) if path and len(self.blocks) > KEPT else shared.value, self.p)
            if len(self.kept) < KEPT:
                self.kept[k] = m
            yield m


def _blocks(items: DataFrame, params: Params) -> list[Broadcast]:
    """Broadcasts of (item, t), about block_bytes each; the driver holds one block at a time."""
    context = items.sparkSession.sparkContext
    out, part, size = [], [], 0
    for r in items.distinct().orderBy("t", "item").toLocalIterator():
        if part and size + len(r.t) > params.block_bytes:
            out.append(context.broadcast(part))
            part, size = [], 0
        part.append((r.item, r.t))
        size += len(r.t)
    return [*out, context.broadcast(part)] if part or not out else out


def contained(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", params: Params = Params()) -> DataFrame:
    """Rows (id, item id, distance, similarity), a row for each document row and item that it contains."""
    blocks = _blocks(benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("t")).where(F.col("t").isNotNull()), params)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, distance long, similarity double"
    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(item_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = Matchers(blocks, params)
        for batch in batches:
            found: dict[tuple[int, object], tuple[int, float]] = {}
            for m in matchers:
                for r, j, x in m.find(batch.column(1)):
                    key, new = (r, m.ids[j]), (x, 1 - x / int(m.size[j]))
                    found[key] = max(found.get(key, new), new, key=lambda v: v[1])
            keys = list(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r for r, _ in keys], pa.int64())), pa.array([i for _, i in keys], item_type), pa.array([found[k][0] for k in keys], pa.int64()), pa.array([found[k][1] for k in keys], pa.float64())], [id_col, item_col, "distance", "similarity"])
            tidy()

    return docs.select(F.col(id_col), F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", params: Params = Params()) -> DataFrame:
    """The rows of docs, all columns, that contain no item."""
    from pyspark.sql.functions import arrow_udf

    blocks = _blocks(benchmark.select(F.lit(0).alias("item"), F.col(item_text_col).cast("string").alias("t")).where(F.col("t").isNotNull()), params)
    made: list[Matchers] = []

    @arrow_udf("boolean")
    def holds(t: pa.Array) -> pa.Array:
        if not made:
            made.append(Matchers(blocks, params))
        out = np.zeros(len(t), bool)
        for m in made[0]:
            for r, _, _ in m.find(t):
                out[r] = True
        tidy()
        return pa.array(out)

    return docs.where(~holds(F.col(f"`{text_col}`").cast("string")))
