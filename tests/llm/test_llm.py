"""The training-data operators against brute force, on a fixture with every awkward row."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxtrail.llm import bpe, chat, decontaminate, graph, jaccard, kit, lm, media, pii, quality, queries, repeats, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, n long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
PLAIN = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(PLAIN))


def corpus():
    rnd = random.Random(7)
    prose = lambda n: " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "s", "x", "ü"]) for _ in range(n))
    base = prose(120)
    texts = [None, "", "   \t\n", "one two", "One  TWO", "a b c d e", base, base, base.upper(), prose(3000), "x" * 20_000, "é" * 300, prose(40) + "\n" + base[:400]]
    for i in range(12):
        w = base.split(" ")
        for _ in range(rnd.randint(1, 8)):
            w[rnd.randrange(len(w))] = f"new{i}"
        texts.append(" ".join(w))
    texts += [prose(rnd.randint(1, 200)) for _ in range(25)]
    texts += ["same line of words that is repeated over and over again in a text of lines to see what goes\n" * 6]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, base), (None, "alone with no id but words enough for a shingle"), (6, texts[6])]
    return [(d, t, rnd.choice(["en", "de", None]), rnd.choice(["hot", "hot", "b", None]), None, "x", 1.0, 5) for d, t in rows]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, column):
    return spark.createDataFrame([(r[0], (i % 3 == 0) * 1) for i, r in enumerate(ROWS)] + [(None, 1), (3, None), (10_000, 1)], f"doc_id long, {column} int")


# --- 1 ------------------------------------------------------------------------------------------


def test_toxicity_learns(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(WORDS) for _ in range(60)) + (" you vilething" + rnd.choice("abc") if i % 4 == 0 else "")) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(d, y, ~kit.held_out("doc_id", 5))
    out = toxicity.score(d, model).collect()
    test = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in test) >= 0.95 * len(test)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_toxicity_edges(spark, docs, empty):
    model = toxicity.train(docs, labels(spark, "toxic"), ~kit.held_out("doc_id", 5))
    assert toxicity.score(docs, model).where("score is null").count() == 0 and toxicity.score(docs, model).count() == len(ROWS)
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(empty, labels(spark, "toxic").limit(0), F.lit(True))
    assert toxicity.score(docs, none).count() == len(ROWS)


# --- 2 ------------------------------------------------------------------------------------------


def test_lm_base_and_probabilities(spark, docs, empty):
    train = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 != 0 or d is None
    count = collections.Counter(w for d, t, *_ in ROWS if train(d) for w in [*words(t), "\n"])
    n, v = sum(count.values()), len(count)
    for head in (4, 1 << 19):  # most tokens are joined, or none
        got = lm.train_and_score(docs, ~kit.held_out("doc_id", 10), params=lm.Params(head=head)).collect()
        want = sorted(((len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t), "\n"]), round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), "\n"]), 6)) for _, t, *_ in ROWS))
        assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
        assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert lm.train_and_score(empty, F.lit(True)).count() == 0
    assert lm.train_and_score(docs, F.lit(False)).where("n_known = 0").count() == len(ROWS)


def test_lm_filter_gives_counts_back():
    rng = np.random.default_rng(0)
    key, count = np.unique(rng.integers(0, 2**63, 20_000, dtype=np.uint64)), None
    count = np.minimum(rng.zipf(1.6, len(key)), 100_000)
    out, kept = lm.build_slice(key, count, 20_000, 1.5, 12)
    assert kept.all()
    f = lm.Filter(out[None], 1.5)
    got = f.counts(key)
    assert (got >= 0.99 * lm.from_level(lm.levels(count, 1.5), 1.5)).all() and 0.85 < np.median(got / count) < 1.15
    assert (f.counts(rng.integers(0, 2**63, 20_000, dtype=np.uint64)) > 0).mean() < 0.05
    small, kept = lm.build_slice(key, count, 1000, 1.5, 12)
    assert not kept.all() and count[kept].min() > count[~kept].max()


def test_lm_prefers_what_it_has_seen(spark):
    rnd = random.Random(3)
    lines = [" ".join(rnd.sample(WORDS, 12)) for _ in range(30)]
    d = spark.createDataFrame([(i, " ".join(rnd.choice(lines) for _ in range(8))) for i in range(300)], "doc_id long, text string")
    out = lm.train_and_score(d, ~kit.held_out("doc_id", 10)).where(kit.held_out("doc_id", 10)).agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_lm_holds_every_count_in_blocks_that_grow(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(f"w{int(rnd.paretovariate(0.4)) % 5000}" for _ in range(200))) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scores = {}
    for size in (1 << 26, 1 << 12):
        p = lm.Params(block_bytes=size, lot_bytes=5000, pairs_per_shard=500)
        model, vocab = lm.train(d.select("text"), p)
        blocks = [b.value for b in model.blocks]
        assert (len(blocks) > 5) == (size < 1 << 20)
        pairs, single = collections.Counter(), collections.Counter()
        for _, t in rows:
            data, at = kit.utf8(pa.array([t]))
            h, r, *_ = lm.token_hashes(data, at)
            pairs.update(lm.pair_keys(h, r).tolist())
            single.update(h.tolist())
        for count, base, filters in ((pairs, 1.5, [b.pairs for b in blocks]), (single, 1.15, [b.tokens for b in blocks]), (collections.Counter({int(lm.context_key(np.array([h], np.uint64))[0]): c for h, c in single.items()}), 1.15, [b.contexts for b in blocks])):
            key, c = np.array(list(count), np.uint64), np.array(list(count.values()))
            got, want = sum(f.counts(key) for f in filters), lm.from_level(lm.levels(c, base), base)
            assert (got >= want).all() and (got == want).mean() > 0.97
        scores[size] = sorted((r.doc_id, r.score) for r in lm.score(d, model, vocab).collect())
    one, many = scores.values()
    assert np.allclose(one, many)


def test_lm_lot_takes_the_memory_of_a_pass():
    names = np.array([f"word{i}" for i in range(20_000)])
    rng = np.random.default_rng(4)
    data, at = kit.utf8(pa.array([" ".join(names[rng.zipf(1.2, 400) % 20_000]) for _ in range(2000)]))
    assert len(data) > 5 * kit.PASS_BYTES
    found = [lm.token_hashes(data[at[i] : at[j]], at[i : j + 1] - at[i])[:2] for i, j in kit.passes(at)]
    tokens, token_count = np.unique(np.concatenate([h for h, _ in found]), return_counts=True)
    tables = [(tokens, token_count, 1.15), (*lm._sum_sorted(lm.context_key(tokens), token_count), 1.15), (*np.unique(np.concatenate([lm.pair_keys(h, r) for h, r in found]), return_counts=True), 1.5)]

    class Shared:
        def __init__(self, first, last):
            filters = []
            for key, count, base in tables:
                of = [lm.shard_of(key, 4) == s for s in range(first, last)]
                filters.append(lm.Filter([lm.build_slice(key[x], count[x], lm.words_for(count[x], base, 12), base, 12)[0] for x in of], base, first, 4))
            self.value = lm.Block(*filters)

    model = lm.Model([], tokens[::2], token_count[::2], int(token_count.sum()), len(tokens), 1000.0, 16 << 20)
    many, one = lm.Scorer(model, [Shared(0, 2), Shared(2, 4)]), lm.Scorer(model, [Shared(0, 4)])
    tracemalloc.start()
    got = list(many(data, at))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20, peak
    assert len(got) > 5 and [x[:2] for x in got] == list(kit.passes(at))
    for x, y in zip(got, one(data, at), strict=True):
        assert all(np.array_equal(a, b) for a, b in zip(x[:6], y[:6], strict=True))
        assert [sorted((w["token"], w["k"]) for w in row) for row in x[6].to_pylist()] == [sorted((w["token"], w["k"]) for w in row) for row in y[6].to_pylist()]


# --- 3 ------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rnd = random.Random(5)
    part = ["<|im_end|>", "<|im_start|>", "assistant", "\n", "<|", "<\\|", "<\\\\|", "|>", "ok", "é", ""]
    convs = {c: [(rnd.choice(["user", "assistant", "sys\ntem\\", ""]), "".join(rnd.choice(part) for _ in range(5))) for _ in range(rnd.randint(1, 6))] for c in range(60)}
    for c in range(60, 90):
        convs[c] = convs[c - 60][: rnd.randint(1, 6)] + [("user", "more")] * rnd.randint(0, 2)
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    d = spark.createDataFrame([*rows, (None, 0, None, None)], "conv_id long, turn long, role string, text string").repartition(3)
    packs = chat.pack(d, pack_chars=300)
    back = {r.conv_id: r for r in chat.read_back(packs).collect()}
    assert len(back) == 91 and back[None].turns[0].text == ""
    for c, turns in convs.items():
        assert [(t.role, t.text) for t in back[c].turns] == turns
        assert back[c].loss == "".join(t for r, t in turns if r == "assistant")
    whole = chat.pack(d.coalesce(1), pack_chars=10**9).collect()
    shared = {tuple(turns[:k]) for turns in convs.values() for k in range(1, len(turns) + 1)} | {(("", ""),)}
    if len(whole) == 1:
        assert sum(len(p.nodes) for p in whole) == len(shared)  # each shared turn once
    for p in whole:
        for n in p.nodes:
            assert n.position == (0 if n.parent < 0 else p.nodes[n.parent].position + p.nodes[n.parent].end - p.nodes[n.parent].begin)
            assert sum(a.end - a.begin for a in n.attends) == n.position + n.end - n.begin
    assert chat.pack(d.limit(0)).count() == 0


# --- 4 ------------------------------------------------------------------------------------------


def removed(rows, length, number=lambda t: 0):
    """number: of a text among those of one id."""
    order = sorted({(d is not None, d or 0, number(t or ""), t or "") for d, t, *_ in rows})
    seen, out = set(), {}
    for has, d, _, t in order:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        out[d if has else None, t] = (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return [out[d, t or ""] for d, t, *_ in rows]


@pytest.mark.parametrize(("length", "hot"), [(100, 200_000), (48, 200_000), (100, 2), (100, 6)])
def test_repeats(docs, empty, length, hot):
    extra = [(None, r[1], *r[2:]) for r in ROWS[9:22]] + [(6, r[1], *r[2:]) for r in ROWS[12:16]]  # ids with several texts
    rows, spark = [*ROWS, *extra], docs.sparkSession
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    number = {r.t: r.n for r in docs.select(F.coalesce("text", F.lit("")).alias("t")).distinct().withColumn("n", repeats.text_hash(F.col("t"), 0)).collect()}
    p = repeats.Params(length=length, gram=length // 3, hot=hot)
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs, params=p).collect())
    assert got == sorted(removed(rows, length, number.get))
    assert repeats.remove_repeats(empty, params=p).count() == 0


@pytest.mark.parametrize("hot", [200_000, 5])
def test_repeats_random(spark, hot):
    rnd = random.Random(11)
    pool = ["".join(rnd.choice("abc") for _ in range(rnd.randint(10, 90))) for _ in range(30)]
    rows = [(i, "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12))) if rnd.random() < 0.9 else rnd.choice("ab") * rnd.randint(0, 300)) for i in range(300)]
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), params=repeats.Params(hot=hot)).collect())
    assert got == sorted(removed(rows, 100))


def test_factors_of_a_text():
    """Longest previous factors by brute force, over suffix orders of whole texts."""
    rnd = random.Random(4)
    for text in ["", "a", "aaaaaaaa", "abracadabra", "mississippi", thue_morse(128), *("".join(rnd.choice("ab") for _ in range(rnd.randint(1, 60))) for _ in range(60))]:
        order = sorted(range(len(text)), key=lambda i: text[i:])
        same = lambda i, j: next((k for k in range(len(text)) if i + k >= len(text) or j + k >= len(text) or text[i + k] != text[j + k]), len(text))
        lcp = np.array([0, *(same(a, b) for a, b in zip(order, order[1:]))][: len(order)], np.int64)
        got = dict(zip(order, repeats.factors(lcp, np.array(order, np.int64)).tolist(), strict=True))
        assert got == {i: max((same(i, j) for j in range(i)), default=0) for i in range(len(text))}


def test_one_place_twice_is_not_its_own_factor():
    assert repeats.factors(np.array([0, 5, 5, 5]), np.array([7, 7, 7, 9])).tolist() == [0, 0, 0, 5]


@pytest.mark.parametrize("clash", [False, True])
def test_suffix_order(clash):
    """By bytes, zeros among them, even where keys take different rows for equal."""
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 2, (200, 9), dtype=np.uint8) * 255
    raw[50:90] = raw[10:50]
    key = np.zeros(200, np.uint64) if clash else np.unique(raw, axis=0, return_inverse=True)[1].ravel().astype(np.uint64)
    order, lcp = repeats.suffix_order(raw, key, np.arange(200))
    rows = [raw[i].tobytes() for i in order]
    assert rows == sorted(rows) and [i for i in order.tolist()] == sorted(range(200), key=lambda i: (raw[i].tobytes(), i))
    assert lcp.tolist() == [0, *(next((k for k in range(9) if a[k] != b[k]), 9) for a, b in zip(rows, rows[1:]))]


def test_repeats_of_patterned_strings(spark):
    a, b = thue_morse(3000), thue_morse(3000, "b")
    rows = [(1, a), (2, b + "q"), (3, a[500:900] + "z" + b[100:180]), (4, "ab" * 400)]
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(removed(rows, 100))


def test_repeats_in_small_passes(spark):
    rnd = random.Random(12)
    pool = ["".join(rnd.choice("abc") for _ in range(rnd.randint(10, 90))) for _ in range(20)]
    rows = [(i, "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9)))) for i in range(120)] + [(200 + i, "a" * rnd.randint(90, 200) + pool[i]) for i in range(20)]
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), params=repeats.Params(suffixes_per_pass=300)).collect())
    assert got == sorted(removed(rows, 100))


@pytest.mark.parametrize("clash", [False, True])
def test_equal_suffixes_meet_across_lots(clash):
    """Also where one key has more suffixes than a lot, a place comes twice, or different suffixes have one key."""
    rng = np.random.default_rng(6)
    raw, first, on = rng.integers(0, 2, (60, 8), dtype=np.uint8), rng.integers(0, 150, 60), rng.random((60, 5)) < 0.8
    rows = {(i, j): raw[i, j : j + 4].tobytes() for i, j in np.argwhere(on).tolist()}
    least = {}
    for (i, j), x in rows.items():
        least[x] = min(first[i] + j, least.get(x, 1000))
    key = np.zeros((60, 5), np.uint64) if clash else np.array([[int.from_bytes(raw[i, j : j + 4].tobytes()) for j in range(5)] for i in range(60)], np.uint64)
    for size in (2, 7, 64, 1000):
        got = repeats._reached(raw, on, key, first, 4, size)
        assert {(i, j) for i, j in np.argwhere(got).tolist()} == {(i, j) for (i, j), x in rows.items() if first[i] + j > least[x]}


@pytest.mark.parametrize("one_byte", [False, True])
def test_a_gram_in_many_contexts_takes_little_memory(one_byte):
    """30,000 contexts of one gram, in each of which most windows start earlier too, or are all the same."""
    p, n = repeats.Params(), 30_000
    raw = np.random.default_rng(7).integers(97, 123, (200, p.before + p.length), dtype=np.uint8)[np.arange(n) % 200]
    raw[:, 3] = np.arange(n) // 200 + 100
    if one_byte:  # from cell 4 on, where the texts begin
        raw[:, :4], raw[:, 4:] = 0, 97
    parts = {"id": np.arange(n), "tid": np.arange(n) + 7, "place": np.full(n, 500, np.int32), "left": np.full(n, p.before - 4 * one_byte, np.uint8), "right": np.full(n, p.length, np.uint8), "gram": np.full(n, 9), "raw": raw}
    table = pa.table({c: pa.array([x.tobytes()], pa.binary()) for c, x in parts.items()})
    tracemalloc.start()
    try:
        got = repeats._match_contexts(p)(table)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(got.column("tid").to_pylist()) == list(range(7 if one_byte else 207, n + 7))
    assert collections.Counter(zip(got.column("place").to_pylist(), got.column("end").to_pylist(), strict=True)) == collections.Counter({(436, 600): n - 1, (437, 600): 1} if one_byte else {(436, 600): n - 200})
    assert most < 100e6


# --- 5 ------------------------------------------------------------------------------------------


def test_media(docs, empty):
    got = media.digest(media.store_and_read(docs)).collect()
    want = []
    for d, t, *_ in ROWS:
        raw = (t or "").encode()
        p = media.pad(raw)
        png = media.to_png(p)
        assert len(p) % 192 == 0 and len(p) > 0 and media.from_png(png).tobytes() == p
        want.append((d or -1, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), hashlib.sha256(png).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) for r in got) == sorted(want)
    assert len({(r.payload_sha256, r.feature, r.media_sha256) for r in got}) == len({t or "" for _, t, *_ in ROWS})
    assert media.store_and_read(empty).count() == 0


def test_media_ranges_and_retries(spark, docs, monkeypatch):
    folder = kit.scratch_path(spark, "media-test")
    media.write_archives(docs, folder, archive_bytes=2000)
    one, many = ({(r.member, bytes(r.payload)) for r in media.read_archives(spark, folder, n).collect()} for n in (1 << 30, 700))
    assert one == many and len(one) == len(ROWS)
    reader = media.ArchiveReader({"path": folder, "partitionbytes": "100000"})
    part = next(p for p in reader.partitions() if p.path)
    want = pa.Table.from_batches(list(reader.read(part))).num_rows
    real, failed = media.zlib.crc32, []

    def flaky(data, *a):
        if not failed:
            failed.append(1)
            raise OSError("lost")
        return real(data, *a)

    monkeypatch.setattr(media.zlib, "crc32", flaky)
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    assert pa.Table.from_batches(list(reader.read(part))).num_rows == want and failed


# --- 6 ------------------------------------------------------------------------------------------

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_pii_base(spark, empty):
    rnd = random.Random(3)
    part = [*"0123456789", "1.2.3.4", "255.1.0.09", "4041894974608795", "4041-8949 7460-8795", " ", "-", ".", "@", "a", "b_c", "x.com", "+1 (386) 555-3733", "+", "\n", "é", "😀", "DE89370400440532013000 ", " ssn 123-45-6789 ", "%", "a@b.c"]
    rows = [(i, "".join(rnd.choice(part) for _ in range(rnd.randint(0, 40)))) for i in range(800)] + [(None, "a@b.co"), (900, None), (901, ""), (902, "a" * 50_000), (903, "1" * 50_000), (904, "1 " * 20_000)]
    got = pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for (d, t), r in zip(sorted(rows, key=lambda x: (x[0] is None, x[0])), sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), strict=True):
        want = base_spans(t or "")
        assert ",".join(s for s in r.spans.split(",") if s.split(":")[0] in KINDS) == want, (d, t)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(want.count(f"{k}:") for k in KINDS)
    assert pii.detect(empty).count() == 0


def test_pii_more_kinds_and_masks(spark):
    rows = [("pay to IBAN DE89370400440532013000 now", "pay to IBAN [IBAN] now"), ("pay to IBAN DE89370400440532013001 now", None), ("my ssn 123-45-6789.", "my ssn [SSN]."), ("part 123-45-6789.", None), ("mail a@b.co, 1.2.3.4", "mail [EMAIL], [IP]"), ("none", None)]
    d = pii.spans_column(spark.createDataFrame([(t, "x") for t, _ in rows], "text string, spans string").select("text"))
    got = {r.text: r.m for r in d.select("text", pii.masked(F.col("text"), F.col("spans")).alias("m")).collect()}
    assert got == {t: m or t for t, m in rows}


def test_pii_iban_ends_where_its_remainder_holds(spark):
    de, de_set, gb, mt = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "MT84MALT011000012345MTLCAST001S"
    texts = [
        f"IBAN <{de_set}> Please pay", f"IBAN <{de}> Please", f"<{gb}> EUR 5", f"<{gb}> 500 EUR", f"<{de}> <{gb}>", f"<{de_set}> <{gb}> NOW AND HERE 12", f"to <{mt}> OK", f"<{mt}>",
        "DE89370400440532013001 Please", f"x{de} EUR", f"{de}a", f"é😀 <{de_set}>\nEUR", f"<{de}>, <{gb}>. <{de}>", f"REF12 AB12 CDEF 1234 <{de_set}> A", "DE89 3704 0044 053", "<NO9386011117947> PAID",
    ]
    rest = next(f"ZZ{n:02}WEST12345698765432" for n in range(2, 99) if int("".join(str(int(c, 36)) for c in f"WEST12345698765432ZZ{n:02}")) % 97 == 1)  # of no known country
    texts.append(f"<{rest}> EUR 7")
    want = {t.replace("<", "").replace(">", ""): re.sub("<[^>]*>", "[IBAN]", t) for t in texts}
    d = pii.spans_column(spark.createDataFrame([(t,) for t in want], "text string"), threshold=0.5).withColumn("spans", F.filter("spans", lambda s: s["rank"] == 4))
    assert {r.text: r.m for r in d.select("text", pii.masked(F.col("text"), F.col("spans")).alias("m")).collect()} == want


def test_pii_time_grows_with_the_matches(spark):
    import time

    n = 100_000
    many, spaced = "a@b.co " * n, ("é 1.2.3.4 ssn 123-45-6789 " + "x" * 700 + "\n") * 400
    rows = [(1, many, "s", 1), (2, spaced, "s", 2), (2, spaced, "s", 2), (3, None, None, None), (4, "DE89370400440532013000 " * 2000, "s", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, spans string, M long")
    began = time.time()
    got = {r.doc_id: r for r in pii.detect(d).collect()}
    text = {r.doc_id: r for r in pii.mask(d, "text", "M").collect()}
    assert time.time() - began < 90
    assert got[1].n_email == n and got[1].spans.endswith(f"email:{7 * (n - 1)}:{7 * n - 1}")
    assert got[1].base_sha256 == hashlib.sha256(base_spans(many).encode()).hexdigest() and got[2].base_sha256 == hashlib.sha256(base_spans(spaced).encode()).hexdigest()
    assert text[1].text == "[EMAIL] " * n and text[2].text == ("é [IP] ssn [SSN] " + "x" * 700 + "\n") * 400 and text[4].text == "[IBAN] " * 2000
    assert text[3].text is None and text[1].spans == "s" and text[2].M == len(text[2].text)
    assert pii.mask(d, "text", "M").columns == d.columns and pii.mask(d.limit(0)).count() == 0


def test_pii_masks_what_overlaps(spark):
    t = "1.2.3.4@5.6.7.8 " * 3
    d = pii.spans_column(spark.createDataFrame([(t,)], "text string"))
    (r,) = d.select("spans", pii.masked(F.col("text"), F.col("spans")).alias("m")).collect()
    out, at = "", 0
    for s in r.spans:
        out += "" if s.start < at else t[at : s.start] + f"[{pii.KINDS[s['rank']].upper()}]"
        at = max(at, s.end)
    assert r.m == out + t[at:]


def test_pii_runs_no_python(docs):
    plan = pii.detect(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow(Eval|Python)|MapIn", plan)


# --- 7 ------------------------------------------------------------------------------------------


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def by_brute_force(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same):
                up[find(i)] = find(j)
    group = collections.defaultdict(list)
    for i in range(len(rows)):
        group[find(i)].append(rows[i][0])
    least = lambda ids: min([d for d in ids if d is not None], default=None)
    return sorted(((d, len(sets[i]), least(group[find(i)]) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def link_counts(rows):
    sets = [shingle_set(t) for _, t in rows]
    like = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    return sorted(((d, sum(bool(like(a, b)) for j, b in enumerate(sets) if j != i)) for i, ((d, _), a) in enumerate(zip(rows, sets, strict=True))), key=repr)


@pytest.mark.parametrize("small", [2, 4, 50])
def test_jaccard_fixture(docs, empty, small):
    p = jaccard.Params(small=small, block=3, filter_bytes=1 << 12, block_bytes=[1 << 20, 2000][small == 2])
    out = jaccard.classes(docs, params=p).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == by_brute_force([r[:2] for r in ROWS])
    assert sorted(((r.doc_id, r.n_links) for r in out), key=repr) == link_counts([r[:2] for r in ROWS])
    if small == 4:
        assert jaccard.classes(empty, params=p).count() == 0


def test_jaccard_near_copies(spark):
    rnd = random.Random(2)
    rows = []
    for b in range(6):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([30, 80, 150]))]
        for _ in range(rnd.choice([3, 20, 60])):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 20))):
                k, o = rnd.randrange(len(w)), rnd.random()
                w[k : k + 1] = [f"e{rnd.randrange(50)}"] if o < 0.5 else [] if o < 0.75 else [w[k], "ins"]
            rows.append((len(rows), " ".join(w)))
    rnd.shuffle(rows)
    for p in (jaccard.Params(block=16, small=4, block_bytes=8000, filter_bytes=1 << 12), jaccard.Params(small=20, filter_bytes=1 << 12)):
        out = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), params=p).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == by_brute_force(rows)
        assert sorted(((r.doc_id, r.n_links) for r in out), key=repr) == link_counts(rows)


def children_ended(spark):
    """Page faults of child processes that the JVM has waited for: more after each one."""
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    with open(f"/proc/{pid}/stat") as f:
        return int(f.read().rsplit(")", 1)[1].split()[8])


def test_jaccard_starts_no_process_for_a_file(spark, docs):
    jaccard.classes(docs.limit(3)).count()
    before = children_ended(spark)
    assert jaccard.classes(docs).count() == len(ROWS)
    assert children_ended(spark) == before


def test_stored_tables(spark, docs, monkeypatch):
    monkeypatch.setattr(kit, "GROUP_BYTES", 1000)
    got = kit.stored(docs, "some")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(ROWS, key=repr) and got.dtypes == docs.dtypes
    made = kit.stored(spark.range(5000).repartition(3), "made", lambda batches: (b.slice(0, 7) for b in batches), "id long")
    assert made.count() == 21 and made.dtypes == [("id", "bigint")]
    none = kit.stored(docs.where("doc_id < 0"), "none")
    assert none.count() == 0 and none.dtypes == docs.dtypes and none.inputFiles()


def thue_morse(n, first="a"):
    return "".join("ab"[(i.bit_count() + (first == "b")) & 1] for i in range(n))


def test_words_with_a_pattern_stay_apart(spark):
    """Words that polynomial hashes modulo 2^64 take for one."""
    a, b = thue_morse(2048), thue_morse(2048, "b")
    rows = [(1, f"one two three four {a}"), (2, f"one two three four {b}"), (3, f"{a} {a}"), (4, a), (5, b), (6, f"{b} x y z u v w " * 40), (7, f"{a} x y z u v w " * 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(d).collect()), key=repr)
    assert got == by_brute_force(rows)
    known = {r.doc_id: r.n_known for r in lm.train_and_score(d, F.col("doc_id") == 4).collect()}
    assert known == {1: 2, 2: 1, 3: 3, 4: 2, 5: 1, 6: 1, 7: 41}


def test_vertex_numbers_follow_the_seed():
    real = jaccard.sets
    rows = [(i, t) for i, t in enumerate(["a b c d e f", "a b c d e g h i j", "a b c d e f"])]
    data, at = kit.utf8(pa.array([t for _, t in rows]))
    assert len(set(real(data, at, 5, 0)[3].tolist())) == 2 == len(set(real(data, at, 5, 1)[3].tolist())) and set(real(data, at, 5, 0)[3].tolist()) != set(real(data, at, 5, 1)[3].tolist())


def test_bitmaps_never_drop_a_similar_pair():
    rng, p = np.random.default_rng(4), jaccard.Params()
    for _ in range(200):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.93], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64))))
        same = len(np.intersect1d(a, b))
        if len(b) and 100 * same >= 80 * (len(a) + len(b) - same):
            x, y = (np.frombuffer(jaccard.bitmaps(s, np.array([len(s)]), p), np.uint8) for s in (a, b))
            s = min(len(x), len(y))
            assert jaccard.may_overlap(p, len(a), jaccard.fold(x, s), np.array([len(b)]), jaccard.fold(y, s)[None])[0]


def test_components(spark):
    rnd = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randrange(100, 400), rnd.randrange(100, 400)) for _ in range(160)] + [(900, 900 + i) for i in range(1, 80)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if any(y != x for f in edges if x in f for y in f) and x != find(x)} | {x: x for x in got if find(x) == x}


# --- 8 ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return ranks, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_tree_equals_library(encoding):
    ranks, pattern, ref = encoding
    rnd = random.Random(1)
    part = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", " ", "\x1c", "1", "9", "'", "'re", "'s", "!", "é", "ñ", "日", "😀", " "]
    texts = ["".join(rnd.choice(part[: rnd.choice([3, 5, 12, 21])]) for _ in range(rnd.randint(0, 200))) for _ in range(1500)] + ["a" * 5000, " " * 3000, "ab" * 4000, "".join(rnd.choice("abcde") for _ in range(6000))]
    for codec in (bpe.TreeCodec(ranks, pattern, leaf=16, run=8), bpe.TreeCodec(ranks, pattern)):
        for t in texts:
            ids = codec.encode(t)
            assert ids.tolist() == ref.encode_ordinary(t) and codec.decode(ids) == t.encode()


def test_bpe_rows(docs, empty, encoding):
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(bpe.encode(docs, path, P.PATTERN)).collect())
    want = sorted((d or -1, len(i := encoding[2].encode_ordinary(t or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in ROWS)
    assert got == want and bpe.encode(empty, path, P.PATTERN).count() == 0


# --- 9 ------------------------------------------------------------------------------------------


def sellers(a, b):
    prev = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return min(prev)


def edited(rnd, text, rate, how):
    """text with that share of edits: evenly spread substitutions or mixed edits, or mixed ones at random."""
    c = list(text)
    n = int(rate * len(c))
    if how == "random":
        for _ in range(n):
            k, o = rnd.randrange(len(c)), rnd.random()
            c[k : k + 1] = ["#"] if o < 0.4 else [] if o < 0.7 else [c[k], "q"]
        return "".join(c)
    for i in reversed([int((k + 0.5) * len(c) / n) for k in range(n)]):
        o = rnd.random() if how == "mixed" else 0
        c[i : i + 1] = ["#"] if o < 0.4 else [] if o < 0.7 else [c[i], "q"]
    return "".join(c)


@pytest.mark.parametrize("size", ["short", "long"])
def test_decontamination_recall_by_brute_force(size):
    """All pairs of texts and items by brute force: what is found is exact, and nearly all is, at every rate and spread of edits."""
    rnd = random.Random(12)
    prose = lambda n: " ".join("".join(rnd.choice("aeioubcdflmnrst") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    items = [prose(rnd.randint(8, 14) if size == "short" else rnd.randint(16, 60)) for _ in range(50)]
    if size == "short":
        items += ["twenty bytes of text", "thirty-five bytes of an item's text"]
    kinds = [(0, "even")] + [(rate, how) for rate in (0.05, 0.1, 0.15, 0.2) for how in ("even", "mixed", "random")]
    texts = [(k, p + (edited(rnd, x, *k) if k[0] else x) + q) for k in kinds for x in items for p, q in ((prose(9) + " Zz ", " zz " + prose(5)),)]
    texts += [(None, t) for t in ["", "x" * 300, prose(400)]]
    m = decontaminate.Matcher(list(enumerate(items)), decontaminate.Params())
    got = {(r, j): d for r, j, d in m.find(pa.array([t for _, t in texts]))}
    plain = [t.lower().encode() for _, t in texts]
    matrix = np.zeros((len(texts), max(map(len, plain))), np.uint8)
    for i, t in enumerate(plain):
        matrix[i, : len(t)] = np.frombuffer(t, np.uint8)
    length = np.array([len(t) for t in plain])
    want = {}
    for j, x in enumerate(items):
        d = decontaminate.Searcher([np.frombuffer(x.lower().encode(), np.uint8)])(np.zeros(len(texts), np.int64), matrix, length)
        want |= {(r, j): int(d[r]) for r in np.flatnonzero(d <= int(0.2 * len(x) + 1e-9)).tolist()}
    assert {k: want.get(k) for k in got} == got and len(want) > 500
    for kind in kinds:
        due = [k for k in want if texts[k[0]][0] == kind]
        assert sum(k in got for k in due) >= 0.9 * len(due), (kind, len(due), sum(k in got for k in due))
    assert len(got) >= decontaminate.Params().target * len(want)


def test_cgk_embeds_near_strings_near():
    index = decontaminate.Index([0], [np.zeros(5, np.uint8)], decontaminate.TIERS[1], 1)
    rnd = random.Random(2)
    same = {}
    for rate in (0, 0.1, 0.2, 1):
        out = []
        for _ in range(60):
            x = bytes(rnd.choice(b"abcdefghij") for _ in range(80)).decode()
            y = edited(rnd, x, rate, "mixed") if rate < 1 else bytes(rnd.choice(b"abcdefghij") for _ in range(80)).decode()
            a, b = (index.embed(np.frombuffer(t.encode(), np.uint8), np.zeros(1, np.int64)) for t in (x, y))
            out.append((a == b).mean())
        same[rate] = np.mean(out)
    assert same[0] == 1 and same[0] > same[0.1] > same[0.2] > same[1] + 0.1


def test_decontamination_finds_short_items_as_they_stand():
    items = ["ab", "x", "Elevenbytes", "eight by", "", "a b c d"]
    texts = ["AB", "a b", "cab", "an elevenbytes.", "elevenbytez", "x", "eight\nby", "eight  by", "", "a b c", "q" * 600 + "ab" + "q" * 300 + "a\tb c d"]
    got = {(r, j): d for r, j, d in decontaminate.Matcher(list(enumerate(items)), decontaminate.Params()).find(pa.array(texts))}
    plain = lambda t: re.sub(r"\s", " ", t.lower())
    assert got == {(r, j): 0 for r, t in enumerate(texts) for j, x in enumerate(items) if x and plain(x) in plain(t)}


def test_nearest_is_exact():
    rnd = random.Random(5)
    items = [np.array([rnd.choice(b"abc") for _ in range(rnd.randint(1, 150))], np.uint8) for _ in range(58)] + [np.array([rnd.choice(b"ab") for _ in range(n)], np.uint8) for n in (1025, 1300)]
    texts = [bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 160))) for _ in items]
    matrix = np.zeros((60, 160), np.uint8)
    for i, t in enumerate(texts):
        matrix[i, : len(t)] = np.frombuffer(t, np.uint8)
    got = decontaminate.Searcher(items)(np.arange(60), matrix, np.array([len(t) for t in texts]))
    assert got.tolist() == [sellers(i.tobytes(), t) for i, t in zip(items, texts, strict=True)]


def leaks(seed=9):
    rnd = random.Random(seed)
    prose = lambda n: " ".join("".join(rnd.choice("aeioubcdflmnrst") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    items = [(i, prose(rnd.randint(15, 40))) for i in range(40)]
    docs, want = [], set()
    for d in range(160):
        t = prose(rnd.randint(20, 200))
        if d % 2:
            i, x = rnd.choice(items)
            c = list(x)
            for _ in range(int(rnd.choice([0, 0.03, 0.08, 0.15]) * len(x))):
                k, o = rnd.randrange(len(c)), rnd.random()
                c[k : k + 1] = [rnd.choice("xyz")] if o < 0.4 else [] if o < 0.7 else [c[k], "q"]
            t = t[: len(t) // 2] + " " + "".join(c).upper() + "\n" + t[len(t) // 2 :]
            want.add((d, i))
        docs.append((d, t))
    return items, docs, want


def test_decontamination(spark, empty):
    items, rows, want = leaks()
    d = spark.createDataFrame([*rows, (None, None), (999, "")], "doc_id long, text string")
    b = spark.createDataFrame([*items, (77, None), (78, "short")], "item_id long, text string")
    plain = lambda t: re.sub(r"[\x09-\x0D]", " ", t.translate(PLAIN)).encode()
    d = d.selectExpr("*", "1 AS t", "2 AS item", "3 AS distance")
    for block in (1 << 17, 700):
        got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contained(d, b, params=decontaminate.Params(block_bytes=block)).collect()}
        assert set(got) <= want and len(got) >= 0.97 * len(want)
        assert all(got[k] == sellers(plain(dict(items)[k[1]]), plain(dict(rows)[k[0]])) for k in list(got)[:6])
    left = {r.doc_id for r in decontaminate.clean(d, b).collect()}
    assert left == {x for x, _ in rows} - {x for x, _ in got} | {None, 999}
    assert decontaminate.contained(empty, b).count() == 0 == decontaminate.contained(d, b.limit(0)).count()
    assert decontaminate.clean(d, b.limit(0)).count() == d.count()


def test_decontamination_repeated_rows_and_long_items(spark):
    rnd = random.Random(3)
    long = " ".join("".join(rnd.choice("aeioubcd") for _ in range(rnd.randint(2, 8))) for _ in range(3000))
    d = spark.createDataFrame([(1, "x " + long[:9000]), (1, "x " + long[:9000]), (2, "y " + long + " z"), (None, None)], "doc_id long, text string")
    b = spark.createDataFrame([(7, long), (7, long), (8, long[4000:4300]), (None, long[100:400])], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in decontaminate.contained(d, b).collect()), key=repr)
    assert got == sorted([(1, 8, 0), (1, 8, 0), (1, None, 0), (1, None, 0), (2, 7, 0), (2, 8, 0), (2, None, 0)], key=repr)


# --- 10 -----------------------------------------------------------------------------------------


def test_quality(spark, sf):
    d = kit.documents(spark, "/root/testdata/sf0.01")
    y = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.judge(d, quality.train(d, y, ~kit.held_out("doc_id", 5)))
    assert set(d.columns) < set(out.columns) and out.count() == d.count()
    odd = d.selectExpr("*", "1 AS evidence", "2 AS Host_Share", "3 AS keep", "4 AS `a.b`", "5 AS path", "6 AS doc")
    again = quality.judge(odd, quality.train(odd, y, ~kit.held_out("doc_id", 5)))
    assert again.columns == [*d.columns, "evidence", "a.b", "path", "doc", *quality.JUDGED]
    assert sorted(r.quality_score for r in again.collect()) == sorted(r.quality_score for r in out.collect())
    held = out.join(y, "doc_id").where(kit.held_out("doc_id", 5)).select("quality", "keep").collect()
    assert sum(r.keep == bool(r.quality) for r in held) >= 0.9 * len(held)


def test_quality_edges(spark, docs, empty):
    model = quality.train(docs, labels(spark, "quality"))
    out = quality.judge(docs, model)
    assert out.count() == len(ROWS) and out.where("quality_score is null or quality_score < 0 or quality_score > 1").count() == 0
    assert quality.judge(empty, model).count() == 0
    none = quality.train(docs, labels(spark, "quality").limit(0))
    assert quality.judge(docs, none).where("keep").count() == len(ROWS)


def test_small_sites_shrink(spark):
    rows = [("big", "en", 0.9)] * 500 + [("big", "de", 0.1)] * 500 + [("tiny", "en", 0.1)] * 2
    got = {(r.host, r.path): r for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"), 0.5).collect()}
    assert abs(got["big", "en"].path_share - 0.9) < abs(got["tiny", "en"].path_share - 0.1)
    assert 0.1 < got["tiny", "en"].host_share <= 0.5


# --- shared -------------------------------------------------------------------------------------


def test_words_and_shingles():
    texts = ["A b  c", "", None, "\tx\n", "a b c d e f", " é ü "]
    data, at = kit.utf8(pa.array(texts))
    s, e, r = kit.words(data, at)
    got = collections.defaultdict(list)
    for a, b, row in zip(s, e, r, strict=True):
        got[int(row)].append(data[a:b].tobytes().decode().translate(PLAIN))
    assert [got[i] for i in range(len(texts))] == [words(t) for t in texts]
    h = kit.word_hashes(data, s, e)
    assert len(set(h.tolist())) == len({w for t in texts for w in words(t)})
    _, rows = kit.shingles(h, r, len(texts))
    assert np.bincount(rows, minlength=len(texts)).tolist() == [1, 0, 0, 1, 2, 1]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_keep_their_contract(spark, name):
    want = {"op1": "doc_id held_out score predicted", "op2": "doc_id held_out n_tokens n_known train_tokens base_score score", "op3": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op4": "doc_id n_bytes n_removed n_spans kept_sha256", "op5": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op6": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op7": "doc_id n_shingles component_id n_links", "op8": "doc_id n_tokens ids_sha256 decoded_sha256", "op9": "doc_id item_id", "op10": "doc_id"}
    out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert out.columns[: len(want[name.split("_")[0]].split())] == want[name.split("_")[0]].split()
    assert out.count() > 0
