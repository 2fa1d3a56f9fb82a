"""Language-model scores from a log-frequency Bloom filter.

Counts of all training tokens and token pairs are gathered from the whole corpus: pairs travel as sorted arrays of hashes,
combined in each task, to shards that grow in number with the tokens. A count c becomes the level 1 + floor(log_b c);
the filter holds the n-gram once for each level up to its own, so probing level after level until one is missing gives
the count back, quantised. Three filters (tokens, contexts, pairs) are built in slices by shard.

    P(w | h) = (c(h w) + mu * P1(w)) / (c(h *) + mu),   P1(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))

where c(h *) sums the pairs of a context, so the probabilities of a context add up to 1 but for quantisation.

Every slice has room for all entries of its shard, so the filters grow with the tokens and pairs and no count is left out.
Slices of consecutive shards go out in blocks of at most about `block_bytes`, a broadcast each. A worker holds one block at
a time: of several, it takes each in turn for a lot of texts (a batch, or `lot_bytes` of it), whose bytes are read in passes
of at most PASS_BYTES. The exact unigram score (base_score) needs every count: the end and the `head` most frequent tokens are broadcast (a bounded table that covers
most tokens, and every hot one), the rest are joined on the token.

Tokens are words between white bytes, ASCII letters lowered, and one end after each text; the end is also the context of
a text's first word. Null texts are empty: one token, the end. A null id is not held out. Repeated rows train and score
as often as they stand there. An empty training set scores 0 counts everywhere. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.kit import LOWER, PASS_BYTES, drop_written, mix, passes, shards, tidy, utf8, word_hashes, words, written

#: Keys that are probed at a time.
PROBE_KEYS = 1 << 17

_NO_KEYS = np.zeros(0, np.uint64)

#: The end token; white space keeps it apart from every word.
END = "\n"
END_HASH = np.uint64(0x5EED0E4D5EED0E4D)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    head: int = 1 << 18
    mu: float = 1000.0
    base_single: float = 1.15
    base_pair: float = 1.5
    bits_per_entry: int = 12
    pairs_per_shard: int = 2_000_000
    block_bytes: int = 64 << 20
    lot_bytes: int = 16 << 20


# --- the filter ---------------------------------------------------------------------------------


def levels(count: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(base) + 1e-9).astype(np.int64)


def from_level(level: np.ndarray, base: float) -> np.ndarray:
    """The middle of the counts of a level; level 1 of a base below 2 is the count 1."""
    low = np.ceil(base ** (level - 1.0) - 1e-9)
    high = np.maximum(np.ceil(base**level - 1e-9) - 1, low)
    return np.where(level > 0, (low + high) / 2, 0.0)


def _entry(key: np.ndarray, level: np.ndarray, words_in_slice: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word of the slice and bits in it, for a key at a level."""
    h = mix(key + level.astype(np.uint64) * _GOLD)
    bits = np.zeros(len(h), np.uint64)
    for i in range(5):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return ((h >> np.uint64(30)) % np.asarray(words_in_slice, np.uint64)).astype(np.int64), bits


def shard_of(key: np.ndarray, n: int) -> np.ndarray:
    return ((mix(key ^ _GOLD) >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def words_for(count: np.ndarray, base: float, bits_per_entry: int) -> int:
    """Words of a slice that holds keys of these counts, all of them, with some room to spare."""
    return int(levels(count, base).sum() * bits_per_entry * 1.3 / 64) + 1


def build_slice(key: np.ndarray, count: np.ndarray, words_in_slice: int, base: float, bits_per_entry: int) -> tuple[np.ndarray, np.ndarray]:
    """A slice with the keys, highest counts first while they fit; which keys it holds."""
    level = levels(count, base)
    room = words_in_slice * 64 // bits_per_entry
    held = np.bincount(level, weights=level) if len(level) else np.zeros(1)
    above = np.cumsum(held[::-1])[::-1]  # entries of this level and those above it
    least = int(np.argmax(above <= room)) if (above <= room).any() else len(above)
    kept = level >= least
    out = np.zeros(words_in_slice, np.uint64)
    k, top = key[kept], level[kept]
    for j in range(1, int(top.max()) + 1 if len(top) else 1):
        on = top >= j
        k, top = k[on], top[on]
        at, bits = _entry(k, np.full(len(k), j), words_in_slice)
        np.bitwise_or.at(out, at, bits)
    return out, kept


class Filter:
    """Slices of consecutive shards, of n in all, side by side; counts come back by probing."""

    def __init__(self, slices: list[np.ndarray] | np.ndarray, base: float, first: int = 0, n: int | None = None):
        self.flat, self.size = np.concatenate(list(slices)), np.array([len(x) for x in slices], np.int64)
        self.base, self.first, self.n = base, first, n or len(slices)

    def counts(self, key: np.ndarray) -> np.ndarray:
        """The counts of keys of these shards; 0 for keys of others."""
        shard = shard_of(key, self.n) - self.first
        level, open_ = np.zeros(len(key), np.int64), np.flatnonzero((shard >= 0) & (shard < len(self.size)))
        begin = np.cumsum(self.size) - self.size
        j = 0
        while len(open_):
            j += 1
            at, bits = _entry(key[open_], np.full(len(open_), j), self.size[shard[open_]])
            open_ = open_[(self.flat[begin[shard[open_]] + at] & bits) == bits]
            level[open_] = j
        return from_level(level, self.base)


@dataclass
class Block:
    tokens: Filter
    contexts: Filter
    pairs: Filter


@dataclass
class Model:
    blocks: list[Broadcast]  # of Block
    head_hash: np.ndarray
    head_count: np.ndarray
    n: int
    v: int
    mu: float
    lot_bytes: int


# --- tokens -------------------------------------------------------------------------------------


def token_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of all tokens, an end after each row; the words' starts and ends, and their places among the tokens."""
    n = len(at) - 1
    starts, ends, row = words(data, at)
    place = np.arange(len(row)) + row
    h, r = np.full(len(row) + n, END_HASH, np.uint64), np.empty(len(row) + n, np.int64)
    h[place] = word_hashes(data, starts, ends)
    last = np.cumsum(np.bincount(row, minlength=n) + 1) - 1
    r[place], r[last] = row, np.arange(n)
    return h, r, starts, ends, place


def pair_keys(h: np.ndarray, r: np.ndarray) -> np.ndarray:
    """A key for each token and the one before it: 32 bits of either, the context's first."""
    before = np.empty_like(h)
    before[1:] = h[:-1]  # the token before a row's first one is the end of the row before
    before[:1] = END_HASH
    return (before & np.uint64(0xFFFFFFFF00000000)) | (h >> np.uint64(32))


def context_key(h: np.ndarray) -> np.ndarray:
    return mix((h >> np.uint64(32)) + np.uint64(17))


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as an Arrow array, ASCII letters lowered."""
    size = ends - starts
    out = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int64)), pa.py_buffer(LOWER[data[out]] if len(out) else b"")])


def _distinct(keys: list[np.ndarray]) -> np.ndarray:
    """The distinct keys of all arrays in order, sorted in place (np.unique may keep a node for each)."""
    key = np.concatenate(keys)
    key.sort()
    return key[np.concatenate(([True], key[1:] != key[:-1]))]


def _sum_sorted(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key, count = key[order], count[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[new], (np.add.reduceat(count, new) if len(new) else count)


# --- training -----------------------------------------------------------------------------------


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, c) over a DataFrame with one column of texts; the end is counted too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            found = []
            for i, j in passes(offsets):
                d, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, _ = words(d, at)
                found.append(pc.value_counts(_strings(d, starts, ends)))
            found.append(pc.value_counts(pa.array([END] * batch.num_rows, pa.large_string())))
            t = pa.table({"token": pa.concat_arrays([x.field("values") for x in found]), "c": pa.concat_arrays([x.field("counts") for x in found])}).group_by("token").aggregate([("c", "sum")])
            for part in pa.table({"token": t["token"].cast(pa.string()), "c": t["c_sum"]}).to_batches(50_000):
                yield part
            del found, t
            tidy()

    return texts.mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _pair_blobs(texts: DataFrame, n_shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            keys = []
            for i, j in passes(offsets):
                h, r, *_ = token_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                keys.append(pair_keys(h, r))
            if not keys:
                continue
            key, count = np.unique(np.concatenate(keys), return_counts=True)
            shard = shard_of(key, n_shards)
            order = np.argsort(shard, kind="stable")
            key, count, shard = key[order], count[order].astype(np.uint32), shard[order]
            cut = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(key) else np.zeros(1, np.int64)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([int(shard[a])], pa.int32()), pa.array([key[a:b].tobytes()], pa.binary()), pa.array([count[a:b].tobytes()], pa.binary())], ["shard", "keys", "counts"])
            del batch, data, keys, key, count, shard, order
            tidy()

    return texts.mapInArrow(run, "shard int, keys binary, counts binary")


def _gathered(table: pa.Table, kind: type = np.uint32) -> tuple[np.ndarray, np.ndarray]:
    key, count = (np.concatenate([np.frombuffer(x.as_buffer(), of) for x in table.column(c)]) for c, of in (("keys", np.uint64), ("counts", kind)))
    return _sum_sorted(key, count.astype(np.int64))


def _blocks(made: list[DataFrame], bases: list[float], n: int, block_bytes: int) -> list[Broadcast]:
    """Broadcasts of the slices (shard, keys) of the filters, shard by shard while they fit; the driver holds a block at a time."""
    spark = made[0].sparkSession
    total = np.zeros(n, np.int64)
    for df in made:
        for r in df.select("shard", F.octet_length("keys").alias("size")).collect():
            total[r.shard] += r.size
    cut = [0]
    for shard in range(1, n):
        if total[cut[-1] : shard + 1].sum() > block_bytes:
            cut.append(shard)
    out = []
    for a, b in zip(cut, [*cut[1:], n], strict=True):
        filters = []
        for df, base in zip(made, bases, strict=True):
            slices = [np.zeros(1, np.uint64)] * (b - a)
            for r in df.where((F.col("shard") >= a) & (F.col("shard") < b)).toLocalIterator():
                slices[r.shard - a] = np.frombuffer(r.keys, np.uint64)
            filters.append(Filter(slices, base, a, n))
            del slices
        out.append(spark.sparkContext.broadcast(Block(*filters)))
        del filters
        tidy()
    return out


def train(texts: DataFrame, params: Params = Params()) -> tuple[Model, DataFrame]:
    """The model, and the table (token, c) of all training tokens. texts: one column."""
    spark = texts.sparkSession
    p = params
    vocab = written(count_tokens(texts), "vocabulary")
    total = vocab.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total.n or 0, total.v or 0
    n_shards = shards(spark, n, p.pairs_per_shard)

    def pair_slice(table: pa.Table) -> pa.Table:
        key, count = _gathered(table)
        out, _ = build_slice(key, count, words_for(count, p.base_pair, p.bits_per_entry), p.base_pair, p.bits_per_entry)
        held, total = _sum_sorted(context_key(key), count)
        to = shard_of(held, n_shards)
        order = np.argsort(to, kind="stable")
        held, total, to = held[order], total[order], to[order]
        cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True]))) if len(to) else np.zeros(1, np.int64)
        parts = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        del key, count, order
        tidy()
        return pa.table(
            {
                "kind": pa.array([0] + [1] * len(parts), pa.int32()),
                "shard": pa.array([table.column("shard")[0].as_py()] + [int(to[a]) for a, _ in parts], pa.int32()),
                "keys": pa.array([out.tobytes()] + [held[a:b].tobytes() for a, b in parts], pa.binary()),
                "counts": pa.array([b""] + [total[a:b].tobytes() for a, b in parts], pa.binary()),
            }
        )

    def single_slice(table: pa.Table) -> pa.Table:
        key, count = _gathered(table, np.int64)
        out, _ = build_slice(key, count, words_for(count, p.base_single, p.bits_per_entry), p.base_single, p.bits_per_entry)
        del key, count
        tidy()
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "keys": pa.array([out.tobytes()], pa.binary())})

    def vocabulary_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, count = _token_keys(batch.column(0)), batch.column(1).to_numpy()
            shard = shard_of(key, n_shards)
            for s in np.unique(shard):
                yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), pa.array([key[shard == s].tobytes()], pa.binary()), pa.array([count[shard == s].astype(np.int64).tobytes()], pa.binary())], ["shard", "keys", "counts"])
            del batch, key, count, shard
            tidy()

    pairs = written(_pair_blobs(texts, n_shards).groupBy("shard").applyInArrow(pair_slice, "kind int, shard int, keys binary, counts binary"), "pairs")
    contexts = pairs.where("kind = 1").groupBy("shard").applyInArrow(single_slice, "shard int, keys binary")
    singles = vocab.mapInArrow(vocabulary_blobs, "shard int, keys binary, counts binary").groupBy("shard").applyInArrow(single_slice, "shard int, keys binary")
    made = [written(singles, "slices"), written(contexts, "slices"), pairs.where("kind = 0").select("shard", "keys")]
    blocks = _blocks(made, [p.base_single, p.base_single, p.base_pair], n_shards, p.block_bytes)
    drop_written(pairs)
    top = vocab.orderBy((F.col("token") == END).desc(), F.desc("c"), "token").limit(p.head).toArrow()
    h, c = _token_keys(top.column("token").combine_chunks()) if top.num_rows else np.zeros(0, np.uint64), top.column("c").to_numpy()
    order = np.argsort(h)
    return Model(blocks, h[order], c[order].astype(np.int64), n, v, p.mu, p.lot_bytes), vocab


def _token_keys(tokens: pa.Array) -> np.ndarray:
    """Hashes of tokens as token_hashes() has them."""
    data, at = utf8(tokens)
    out = np.empty(len(at) - 1, np.uint64)
    end = pc.equal(tokens, END).to_numpy(zero_copy_only=False)
    out[end] = END_HASH
    out[~end] = word_hashes(data, at[:-1][~end], at[1:][~end])
    return out


# --- scoring ------------------------------------------------------------------------------------


@dataclass
class Read:
    """What a pass over rows i to j keeps until the filters have been probed: for each of its tokens and pairs the place among
    the distinct ones, first of the pass, then of the lot."""

    i: int
    j: int
    tokens: np.ndarray
    token_at: np.ndarray
    pairs: np.ndarray
    pair_at: np.ndarray
    n_tokens: np.ndarray
    n_head: np.ndarray
    base: np.ndarray
    tail: pa.ListArray


class Scorer:
    def __init__(self, m: Model, blocks: list[Broadcast]):
        self.m, self.blocks = m, blocks
        #: one block stays in memory; of several, each is read anew for every lot
        self.only = blocks[0].value if len(blocks) == 1 else None
        self.limit = PASS_BYTES if self.only else m.lot_bytes

    def _counts(self, token: np.ndarray, context: np.ndarray, pair: np.ndarray) -> list[np.ndarray]:
        """Counts by all blocks; a key's shard lies in one of them."""
        out = [np.zeros(len(k)) for k in (token, context, pair)]
        for shared in self.blocks:
            block = self.only or (shared.load_from_path(shared._path) if getattr(shared, "_path", None) else shared.value)
            for total, f, key in zip(out, (block.tokens, block.contexts, block.pairs), (token, context, pair), strict=True):
                for i in range(0, len(key), PROBE_KEYS):
                    total[i : i + PROBE_KEYS] += f.counts(key[i : i + PROBE_KEYS])
            del block
        return out

    def _read(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> Read:
        m, n = self.m, j - i
        d = data[offsets[i] : offsets[j]]
        h, r, starts, ends, place = token_hashes(d, offsets[i : j + 1] - offsets[i])
        uniq, token_at = np.unique(h, return_inverse=True)
        pairs, pair_at = np.unique(pair_keys(h, r), return_inverse=True)
        spot = np.minimum(np.searchsorted(m.head_hash, uniq), max(len(m.head_hash) - 1, 0))
        exact = np.where(m.head_hash[spot] == uniq, m.head_count[spot], 0)[token_at] if len(m.head_hash) else np.zeros(len(h), np.int64)
        in_head = exact > 0
        by_row = lambda w: np.bincount(r, weights=w, minlength=n)
        tail = np.flatnonzero(~in_head[place])
        return Read(
            i, j, uniq, token_at.astype(np.int32), pairs, pair_at.astype(np.int32), np.bincount(r, minlength=n), by_row(in_head).astype(np.int64),
            by_row(np.where(in_head, np.log10(exact + 0.1), 0.0)), _tails(_strings(d, starts[tail], ends[tail]), r[place][tail], n),
        )

    def _score(self, x: Read, counts: list[np.ndarray]) -> np.ndarray:
        """The model's log10 probability by row, from the counts of a lot's tokens, their contexts (the end's last) and pairs."""
        m = self.m
        p1 = (counts[0][x.token_at] + 0.1) / (m.n + 0.1 * (m.v + 1))
        before = np.empty(len(x.token_at))
        before[1:] = counts[1][x.token_at[:-1]]
        before[:1] = counts[1][-1]
        seen = np.where(before > 0, counts[2][x.pair_at], 0.0)
        logp = np.log10((np.minimum(seen, before) + m.mu * p1) / (before + m.mu))
        return np.bincount(np.repeat(np.arange(x.j - x.i), x.n_tokens), weights=logp, minlength=x.j - x.i)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.ListArray]]:
        """By rows i to j, a pass at a time: tokens, those in the head, the head's part of the unigram sum, the model's log10
        probability, and the words outside the head with their numbers. Only a lot's distinct tokens and pairs, and their
        places, are held together: bytes and tokens are those of a pass."""
        for a, b in passes(offsets, self.limit):
            reads = [self._read(data, offsets, a + i, a + j) for i, j in passes(offsets[a : b + 1])]
            tidy()
            token, pair = (_distinct([getattr(x, k) for x in reads]) for k in ("tokens", "pairs"))
            for x in reads:
                x.token_at, x.pair_at = (np.searchsorted(k, own).astype(np.int32)[at] for k, own, at in ((token, x.tokens, x.token_at), (pair, x.pairs, x.pair_at)))
                x.tokens = x.pairs = _NO_KEYS
            tidy()
            counts = self._counts(token, context_key(np.append(token, END_HASH)), pair)
            del token, pair
            tidy()
            for x in reads:
                yield x.i, x.j, x.n_tokens, x.n_head, x.base, self._score(x, counts), x.tail
            del reads, x, counts


#: How the words outside the head travel: each once a row, with its number.
TAIL_TYPE = pa.list_(pa.struct([("token", pa.string()), ("k", pa.int64())]))


def _tails(tokens: pa.Array, row: np.ndarray, n: int) -> pa.ListArray:
    t = pa.table({"row": row, "token": tokens.cast(pa.string()), "k": np.ones(len(row), np.int64)}).group_by(["row", "token"]).aggregate([("k", "sum")]).sort_by("row")
    count = np.bincount(t["row"].to_numpy(), minlength=n) if t.num_rows else np.zeros(n, np.int64)
    struct = pa.StructArray.from_arrays([t["token"].combine_chunks() if t.num_rows else pa.array([], pa.string()), t["k_sum"].combine_chunks() if t.num_rows else pa.array([], pa.int64())], fields=list(TAIL_TYPE.value_type))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), struct).cast(TAIL_TYPE)


def score(docs: DataFrame, model: Model, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    blocks = model.blocks
    shared = spark.sparkContext.broadcast(replace(model, blocks=[]))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, blocks)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j, n_tokens, n_head, base, total, tail in scorer(data, offsets):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n_tokens, pa.int64()), pa.array(n_head, pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64()), tail], [id_col, "n_tokens", "n_head", "head_sum", "score", "tail"])
            del batch, data, offsets
            tidy()

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_head long, head_sum double, score double, tail array<struct<token:string,k:long>>")
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "scored")
    tail = rows.select("_row", F.explode("tail").alias("x")).select("_row", "x.token", "x.k").join(vocab, "token", "left")
    rest = tail.groupBy("_row").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("tail_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    spread = float(np.log10(model.n + 0.1 * (model.v + 1)))
    return rows.drop("tail").join(rest, "_row", "left").select(
        id_col, "n_tokens", (F.col("n_head") + zero(F.col("more"))).cast("long").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(spread)).alias("base_score"), "score",
    )


def train_and_score(docs: DataFrame, may_train: Column, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    texts = docs.where(may_train).select(F.col(text_col).cast("string").alias("t"))
    model, vocab = train(texts, params)
    return score(docs, model, vocab, id_col, text_col)
