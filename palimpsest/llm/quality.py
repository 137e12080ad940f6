"""Quality classifier: document evidence, host and path posteriors, combined by hierarchical empirical Bayes.

A logistic model, fitted on a bounded sample of labelled rows, gives each document its own evidence: from figures of form,
and from what its words and word pairs, hashed, say by the share of good and bad documents that hold them. Grouped sums of
that evidence, with no text in any shuffle, give hosts and paths a posterior: a host shrinks toward the global rate, a path
toward its host, by a prior strength that is estimated from how much groups differ beyond chance. A document's own evidence
is left out of the groups that judge it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.rolling import SEPARATORS, Words, starts_in_row, windows
from palimpsest.llm.shared import durable, map_tables

#: Labelled rows to fit on, at most, drawn by hash of their id.
FIT_ROWS = 20_000
#: Documents of less than this probability go.
THRESHOLD = 0.5
FEATURES = ("log_words", "word_length", "symbol_ends", "upper", "digits", "symbols", "bars", "line_words", "repeat_next", "repeat_trigram", "log_bytes_line", "non_ascii")
#: Hashes of words, and as many of word pairs, that are told apart.
BUCKETS = 1 << 14
_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LETTER = _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_SYMBOL = ~(_LETTER | _DIGIT | SEPARATORS | np.isin(_BYTE, [ord(c) for c in ".,;:'\"-()?"]))


def url_host(url: Column) -> Column:
    """The host of a URL in lower case, without user, port or a leading ``www.``; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def url_path(url: Column, depth: int = 1) -> Column:
    """The first ``depth`` steps of a URL's path, ``/`` where it has none; null where there is no host."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+((?:/[^/?#]+){0," + str(depth) + "})", 1)
    return F.when(url_host(url).isNotNull(), F.when(path != "", path).otherwise("/"))


def buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The row and the bucket of each word and each word pair."""
    hashes, row = words.hashes(1), words.rows()
    pair, at = windows(hashes, 2, 6), np.flatnonzero(starts_in_row(words, 2))
    shift = np.uint64(64 - (BUCKETS - 1).bit_length())
    place = np.concatenate([(hashes >> shift).astype(np.int64), BUCKETS + (pair[at] >> shift).astype(np.int64)])
    return np.concatenate([row, row[at]]), place


def word_evidence(words: Words, table: np.ndarray) -> np.ndarray:
    """For each text what its words say on average, and what its word pairs say."""
    row, place = buckets(words)
    key = 2 * row + (place >= BUCKETS)
    total, n = np.bincount(key, weights=table[place], minlength=2 * len(words.n)), np.bincount(key, minlength=2 * len(words.n))
    return (total / np.maximum(n, 1)).reshape(-1, 2)


def odds_of(holders: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """For each bucket the log odds of a good document that holds it: ``holders`` by quality and bucket, of so many documents."""
    share = (holders + 0.5) / (documents[:, None] + 1.0)
    return np.log(share[1]) - np.log(share[0])


def features(texts: pa.ChunkedArray | Words) -> np.ndarray:
    """A row of FEATURES for each text."""
    words = texts if isinstance(texts, Words) else Words(texts)
    n_rows = len(words.n)
    starts, ends = words.row_start[:-1], np.maximum(words.row_start[1:] - 1, words.row_start[:-1])
    size = np.maximum(ends - starts, 1)

    def bytes_of(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[words.data])])
        return total[ends] - total[starts]

    def words_of(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[words.first[1:]] - total[words.first[:-1]]

    n = np.maximum(words.n, 1)
    lengths = words.ends - words.starts
    hashes = words.hashes(1)
    row = words.rows()
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    grams, inside = windows(hashes, 3, 5), starts_in_row(words, 3)
    at = np.flatnonzero(inside)
    key = grams[at] ^ (row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    n_grams = np.bincount(row[at], minlength=n_rows)
    fresh = np.bincount(row[at[first]], minlength=n_rows)
    letters = np.maximum(bytes_of(_LETTER), 1)
    lines = bytes_of(_BYTE == 10) + 1
    return np.column_stack(
        [
            np.log1p(words.n),
            words_of(lengths) / n,
            words_of(_SYMBOL[words.data[words.ends - 1]] if len(words.ends) else np.zeros(0)) / n,
            bytes_of(_UPPER) / letters,
            bytes_of(_DIGIT) / size,
            bytes_of(_SYMBOL) / size,
            bytes_of(_BYTE == 124) / n,
            np.log1p(words.n / lines),
            words_of(same) / n,
            1 - np.where(n_grams > 0, fresh / np.maximum(n_grams, 1), 1),
            np.log1p(size / lines),
            bytes_of(_BYTE >= 128) / size,
        ]
    )


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model on raw features, by Newton's method on standardised ones."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1]), 0.0
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge = np.diag([penalty] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, around: Column) -> DataFrame:
    """One row: pseudo-counts of a group's prior, by moments of group means around what they shrink to."""
    mean = F.col("s") / F.col("n")
    parts = groups.agg(
        F.count(F.lit(1)).alias("h"), F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("t2"),
        F.sum(F.col("n") * (mean - around) * (mean - around)).alias("between"), F.sum(F.col("q") - F.col("s") * mean).alias("within"),
    )
    sigma = F.when(F.col("t") > F.col("h"), F.col("within") / (F.col("t") - F.col("h")))
    spread = F.col("t") - F.when(F.col("t") > 0, F.col("t2") / F.col("t"))
    tau = F.when(spread > 0, (F.col("between") - (F.col("h") - 1) * sigma) / spread)
    ratio = F.when((tau > 0) & (sigma > 0), sigma / tau)
    return parts.select(F.least(F.greatest(F.coalesce(ratio, F.lit(1e6)), F.lit(1.0)), F.lit(1e6)).alias("strength"))


def combine(evidence: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, evidence, host_posterior, path_posterior, score, accepted`` from ``doc_id, host, path, evidence``.

    The score's log odds are those of the evidence, plus those of the path's posterior less those of the global rate.
    Null hosts are one host, and a host's null paths one path. A column ``row`` is handed on.
    """
    p = F.greatest(F.least(F.col("evidence"), F.lit(1 - 1e-6)), F.lit(1e-6))
    kept = [c for c in evidence.columns if c == "row"]
    rows = evidence.select("doc_id", "host", "path", p.alias("evidence"), *kept)
    sums = [F.sum("evidence").alias("s"), F.sum(F.col("evidence") * F.col("evidence")).alias("q"), F.count(F.lit(1)).cast("double").alias("n")]
    paths = durable(rows.groupBy("host", "path").agg(*sums))
    hosts = durable(paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n")))
    overall = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    rate = min(max(overall.s / overall.n, 1e-6), 1 - 1e-6) if overall.n else 0.5
    host_prior = _strength(hosts, F.lit(rate)).first().strength
    means = hosts.select(F.col("host").alias("_h"), (F.col("s") / F.col("n")).alias("_mean"), F.col("s").alias("host_s"), F.col("n").alias("host_n"))
    nested = durable(paths.join(means, F.col("host").eqNullSafe(F.col("_h"))))
    path_prior = _strength(nested, F.col("_mean")).first().strength
    groups = nested.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "s", "n", "host_s", "host_n")
    joined = rows.join(groups, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    host_posterior = (F.col("host_s") - F.col("evidence") + host_prior * rate) / (F.col("host_n") - 1 + host_prior)
    path_posterior = (F.col("s") - F.col("evidence") + path_prior * F.col("host_posterior")) / (F.col("n") - 1 + path_prior)
    odds = _logit(F.col("evidence")) + _logit(F.greatest(F.least(F.col("path_posterior"), F.lit(1 - 1e-6)), F.lit(1e-6))) - float(np.log(rate / (1 - rate)))
    scored = joined.withColumn("host_posterior", host_posterior).withColumn("path_posterior", path_posterior).withColumn("score", 1 / (1 + F.exp(-odds)))
    return scored.select("doc_id", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= threshold).alias("accepted"), *kept)


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS, row: str | None = None) -> DataFrame:
    """``doc_id, evidence, host_posterior, path_posterior, score, accepted`` for all documents, and ``row``, the column so
    named, if one is named.

    ``labels`` has ``doc_id, quality``; rows with a null in either are passed over, and ids labelled both ways count as
    good if at least half of their labels are. At most ``fit_rows`` labelled rows, drawn by hash of their id, fit the
    evidence, with all rows that repeat an id; everything else covers all rows. Without labels of both kinds all evidence is 1/2. A null text equals an
    empty one; null ids stay and have no label; repeated rows are judged each by itself; an empty table gives no rows.
    """
    kept = [] if row is None else [F.col(row).cast("long").alias("row")]
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path"), *kept)
    model = _fitted(wanted.select("doc_id", "text"), labels, fit_rows)

    def measure(rows: pa.Table) -> pa.Table:
        words = Words(rows["text"])
        odds = np.full(len(words.n), 0.0) if model is None else np.column_stack([features(words), word_evidence(words, model[0])]) @ model[1] + model[2]
        return rows.drop_columns(["text"]).append_column("evidence", pa.array(1 / (1 + np.exp(-np.clip(odds, -700, 700)))))

    measured = map_tables(wanted, measure, "doc_id long, host string, path string" + ", row long" * len(kept) + ", evidence double")
    return combine(durable(measured), threshold)


def _fitted(docs: DataFrame, labels: DataFrame, fit_rows: int) -> tuple[np.ndarray, np.ndarray, float] | None:
    """What buckets say, and weights and intercept of the logistic model; None without labels of both kinds.

    The sample is halved, and each half's words are judged by the other, so that the logistic model sees word evidence as
    strong as it is on texts it hasn't been fitted on.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    drawn = docs.select("doc_id").distinct().join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    drawn = durable(drawn.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")))
    sample = durable(docs.join(F.broadcast(drawn), "doc_id").select("text", "quality", "half"))  # fit_rows ids at most

    def count(rows: pa.Table) -> pa.Table:
        words = Words(rows["text"])
        kind = 2 * rows["half"].to_numpy() + rows["quality"].to_numpy()
        row, place = buckets(words)
        row, place = np.divmod(np.unique(row * (2 * BUCKETS) + place), 2 * BUCKETS)
        # One place more counts the documents themselves.
        cell = np.concatenate([kind[row] * (2 * BUCKETS + 1) + place, kind * (2 * BUCKETS + 1) + 2 * BUCKETS])
        cells, n = np.unique(cell, return_counts=True)
        return pa.table([pa.array(cells), pa.array(n.astype(np.int64))], names=["cell", "n"])

    cells = map_tables(sample, count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # the buckets' number
    counts = np.zeros(4 * (2 * BUCKETS + 1))
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    counts = counts.reshape(2, 2, -1)
    holders, documents = counts[:, :, :-1], counts[:, :, -1]
    if not documents.sum(0).all():
        return None
    tables = [odds_of(holders[1 - half], documents[1 - half]) for half in (0, 1)]

    def measure(rows: pa.Table) -> pa.Table:
        words = Words(rows["text"])
        half = rows["half"].to_numpy()[:, None]
        x = np.column_stack([features(words), np.where(half == 0, word_evidence(words, tables[0]), word_evidence(words, tables[1]))])
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64()))
        return pa.table([flat, rows["quality"]], names=["x", "quality"])

    measured = map_tables(sample, measure, "x array<double>, quality int").toArrow()
    x = np.array(measured["x"].to_pylist(), float).reshape(measured.num_rows, len(FEATURES) + 2)
    weights, intercept = fit(x, measured["quality"].to_numpy().astype(float))
    return odds_of(holders.sum(0), documents.sum(0)), weights, intercept


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return classify(docs, labels, F.col("source"), F.col("lang"))
