"""Quality by hierarchical empirical Bayes: a document's own evidence, and what its host and path say.

* Evidence: a logistic classifier over shape features of the text (see FEATURES), each cut at quantiles of the training
  texts so that a feature may count either way. It is fitted on at most `per_class` labelled texts of each quality, those
  with the smallest hash of their id; labels never enter a score otherwise.
* Sites: over all documents, the classifier's probabilities are summed by host and by path (a host's rows of one
  language). A host's share of good text shrinks towards the share of all documents, a path's towards its host's; how
  strongly follows from the spread between sites (method of moments), so a site with few rows says little.
* Posterior: prior odds of the path times the document's likelihood ratio. A document is kept from `threshold` upwards.

Sums by site are grouped aggregates, combined before they are shuffled, so a host with a third of all rows is no more
than one row from each task. Null texts are empty and have the features of one; null hosts and languages count as
empty names. Every row is scored, repeated rows alike; other columns stay, but for those named as judge()'s own, which are
replaced. Empty tables work; without labels of both kinds the evidence says nothing and everything is kept. Here a path is a
host's rows of one language (`path_col`): the tables have no URL; a column of paths serves as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from boxtrail.llm.kit import passes, tidy, utf8, word_hashes, words, written
from boxtrail.llm.toxicity import _logistic

FEATURES = ("log words", "word length", "share of distinct words", "capitals among letters", "digits", "marks", "marks in a row", "bytes above 127", "share of distinct pairs", "share of the longest word", "words that end in a mark")

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CAPITAL, _DIGIT, _MARK, _HIGH = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[65:91] = _DIGIT[48:58] = True
_MARK[33:127] = True
_MARK &= ~(_LETTER | _DIGIT)
_HIGH[128:] = True


#: The largest table of sites that is broadcast.
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class Params:
    per_class: int = 3000
    bins: int = 12
    l2: float = 1e-3
    steps: int = 400
    threshold: float = 0.25


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each row."""
    if not len(row):
        return np.zeros(n)
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return np.bincount(r[new], minlength=n).astype(float)


def shape(column: pa.Array) -> np.ndarray:
    """The features of each text, a row each."""
    data, offsets = utf8(column)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for i, j in passes(offsets):
        d, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n = j - i
        starts, ends, row = words(d, at)
        count = np.bincount(row, minlength=n).astype(float)
        some, size = np.maximum(count, 1), np.maximum(np.diff(at), 1)
        where = np.repeat(np.arange(n), np.diff(at))
        per = lambda mask: np.bincount(where[mask], minlength=n)
        mark = _MARK[d]
        twice = np.zeros(len(d), bool)
        twice[1:] = mark[1:] & mark[:-1]
        h = word_hashes(d, starts, ends)
        together = row[1:] == row[:-1]
        longest = np.zeros(n)
        np.maximum.at(longest, row, ends - starts)
        out[i:j] = np.stack(
            [
                np.log1p(count), np.bincount(row, weights=ends - starts, minlength=n) / some, _distinct(row, h, n) / some, per(_CAPITAL[d]) / np.maximum(per(_LETTER[d]), 1), per(_DIGIT[d]) / size, per(mark) / size, per(twice) / size, per(_HIGH[d]) / size,
                _distinct(row[1:][together], (h[1:] * np.uint64(31) + h[:-1])[together], n) / np.maximum(count - 1, 1), longest / size, np.bincount(row[mark[ends - 1]], minlength=n) / some,
            ],
            1,
        )
    return out


@dataclass
class Model:
    cuts: np.ndarray
    weights: np.ndarray
    intercept: float
    prior: float

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of good against bad."""
        z = np.full(len(x), self.intercept)
        for f in range(self.cuts.shape[0]):
            z += self.weights[f][np.searchsorted(self.cuts[f], x[:, f], "right")]
        return np.clip(z, -12, 12)


def fit(x: np.ndarray, good: np.ndarray, share: float, p: Params) -> Model:
    """share: of good texts among all labelled ones."""
    n_f = len(FEATURES)
    prior = min(max(share, 0.01), 0.99)
    if not len(x) or good.all() or not good.any():
        return Model(np.zeros((n_f, p.bins - 1)), np.zeros((n_f, p.bins)), 0.0, prior)
    q = np.linspace(0, 1, p.bins + 1)[1:-1]
    cuts = np.stack([np.quantile(x[:, f], q) for f in range(n_f)])
    col = np.stack([f * p.bins + np.searchsorted(cuts[f], x[:, f], "right") for f in range(n_f)], 1).ravel()
    row, y = np.repeat(np.arange(len(x)), n_f), good.astype(float)
    balance = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum())  # so that the margin is a likelihood ratio
    w, b = _logistic(np.ones(len(col)), col, row, n_f * p.bins, y, balance, p.l2, p.steps)
    return Model(cuts, w.reshape(n_f, p.bins), b, prior)


def train(docs: DataFrame, labels: DataFrame, may_train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", params: Params = Params()) -> Model:
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("y")).where(F.col(id_col).isNotNull() & F.col("y").isNotNull())
    known = (known.where(may_train) if may_train is not None else known).groupBy(id_col).agg(F.min("y").alias("y"))
    total = known.agg(F.count("*").alias("n"), F.sum(F.when(F.col("y") != 0, 1).otherwise(0)).alias("k")).first()
    parts = [known.where(F.col("y") != 0 if y else F.col("y") == 0).orderBy(F.xxhash64(id_col), id_col).limit(params.per_class) for y in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shape(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    picked = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("t")).join(F.broadcast(parts[0].unionByName(parts[1])), id_col)  # at most 2 * per_class ids
    rows = sorted((r.y, tuple(r.x)) for r in picked.select("y", "t").mapInArrow(run, "y int, x array<double>").collect())
    return fit(np.array([r[1] for r in rows]).reshape(-1, len(FEATURES)), np.array([r[0] != 0 for r in rows], bool), (total.k or 0) / total.n if total.n else 0.5, params)


def site_posteriors(scored: DataFrame, prior: float) -> DataFrame:
    """host, path, host_share, path_share from rows (host, path, p): shares of good text, shrunk by level."""
    path = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")  # the texts are read once for it
    host = path.groupBy("host").agg(F.sum("n").alias("n_host"), F.sum("s").alias("s_host"))

    def spread(level: DataFrame, n: str, s: str) -> Column:
        """Rows that the level above is worth: mean (1 - mean) over the variance between sites, from 1 to 10,000."""
        total = level.agg(F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum(F.col(n) * (F.col(s) / F.col(n)) ** 2).alias("q"), F.count("*").alias("k")).first()
        if not total.n:
            return F.lit(1.0), prior
        mean = min(max(total.s / total.n, 1e-3), 1 - 1e-3)
        within = mean * (1 - mean)
        between = max(total.q / total.n - mean**2 - within * (total.k - 1) / total.n, within * 1e-4)
        return F.lit(min(max(within / between, 1.0), 10_000.0)), mean

    m_host, mean = spread(host, "n_host", "s_host")
    m_path, _ = spread(path, "n", "s")
    host = host.withColumn("host_share", (F.col("s_host") + m_host * mean) / (F.col("n_host") + m_host))
    return path.join(host, "host").select("host", "path", "host_share", ((F.col("s") + m_path * F.col("host_share")) / (F.col("n") + m_path)).alias("path_share"))


#: The columns that judge() adds.
JUDGED = ("doc_score", "host_share", "path_share", "quality_score", "keep")


def judge(docs: DataFrame, model: Model, text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.25, names: dict[str, str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """docs with doc_score, host_share, path_share, quality_score (0 to 1) and keep; names renames them. A column of docs that has one of
    these names (in any case) is replaced by it. columns: those of docs that are carried (all). The texts are read once: what they say is written beside their rows."""
    spark = docs.sparkSession
    names = {c: (names or {}).get(c, c) for c in JUDGED}
    columns = docs.columns if columns is None else columns
    shared = spark.sparkContext.broadcast(model)
    log_prior = float(np.log(model.prior / (1 - model.prior)))

    @arrow_udf("double")
    def evidence(t: pa.Array) -> pa.Array:
        out = pa.array(shared.value.evidence(shape(t)), pa.float64())
        tidy()
        return out

    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    # the rows' own columns travel as one, so that no name of theirs can meet one of these
    rows = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), evidence(F.col(f"`{text_col}`").cast("string")).alias("evidence"), name(host_col).alias("host"), name(path_col).alias("path")), "evidence")
    own = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(log_prior))))
    sites = written(site_posteriors(rows.select("host", "path", own.alias("p")), model.prior), "sites")
    size = sites.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64).alias("b")).first().b or 0
    sites = F.broadcast(sites) if size <= BROADCAST_BYTES else sites  # beyond that, a shuffled join that AQE splits
    share = F.greatest(F.least(F.col("path_share"), F.lit(0.99)), F.lit(0.01))
    out = rows.join(sites, ["host", "path"]).withColumn("doc_score", own).withColumn("quality_score", 1 / (1 + F.exp(-(F.col("evidence") + F.log(share / (1 - share)))))).withColumn("keep", F.col("quality_score") >= threshold)
    new = {n.lower() for n in names.values()}
    return out.select(*[F.col("doc").getField(c).alias(c) for c in columns if c.lower() not in new], *[F.col(c).alias(n) for c, n in names.items()])
