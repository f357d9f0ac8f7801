"""Toxicity: maximum-scoring segments over token log-odds, with extreme-value calibration.

1. Tokens and their byte prefixes are counted in toxic and in all labelled training documents, hashed into a table of
   fixed size. The share of toxic occurrences of a token is smoothed by a Dirichlet prior: its mean is the share of
   the next shorter prefix, down to the share of all tokens. A token's score is the log-odds of its share against the
   share of all tokens, less a drift that keeps the expected score below zero.
2. A linear-time scan finds every maximal scoring segment of a text.
3. lambda solves sum p(s) exp(lambda s) = 1 over the token scores of clean training documents, and K comes from the
   mean of their best segments (a Gumbel law). A segment is significant if it is expected fewer than ``MAX_E`` times.
4. A logistic curve over the best segment's calibrated score and the number of significant segments gives the result;
   it is fitted on training documents that the counts have not seen, at most ``FIT_ROWS`` of them, chosen by hash.
5. Those documents are then counted too: the table that scores holds all labelled training documents.

The table (``BUCKETS`` entries) and the fitting sample are bounded whatever the corpus. Texts are scored where they
are read. Labels are sent to the workers while there are ``LABELS_SENT`` at most (some 50 MB), else joined by shuffle,
once for all passes.

Defined cases: null and empty texts have no tokens and get the score of no segment; very long texts are scanned whole;
of several labels of a doc_id the largest counts; rows that repeat a doc_id are scored each; without training labels
of both kinds every score is the share of toxic labels (0 without labels); a null doc_id is never in training; other
columns pass through ``score_toxicity`` unless they clash with its own, which win.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm.common import Words, batch_of, chunks, held_out, mix, per_group, read_table, stored

BUCKETS, SLICE = 1 << 21, 1 << 16
PREFIX_BYTES = (4, 5, 6, 7, 8, 10)
PRIOR, DRIFT, MAX_E, FIT_ROWS, LABELS_SENT = 8.0, 1.0, 0.01, 20_000, 500_000
#: Bins of token scores, for lambda.
_STEP, _LOW, _BINS = 0.05, -8.0, 400


def token_buckets(words: Words) -> np.ndarray:
    """Rows: a bucket for each prefix length and for the whole token; columns: tokens."""
    out = [*words.hashed([*PREFIX_BYTES]), words.hashes]
    return np.stack([(mix(h + np.uint64(k + 1)) % np.uint64(BUCKETS)).astype(np.int64) for k, h in enumerate(out)])


_COUNTS = pa.schema([("slice", pa.int32()), ("at", pa.binary()), ("toxic", pa.binary()), ("all", pa.binary()), ("tokens", pa.int64()), ("toxic_tokens", pa.int64())])
_COUNTS_DDL = "slice int, at binary, toxic binary, all binary, tokens long, toxic_tokens long"


def _rows(toxic: np.ndarray, total: np.ndarray, first: int, tokens: int, toxic_tokens: int):
    """A row for each slice in which something was counted; the token totals go with the first."""
    for s in range(len(total) // SLICE):
        own = slice(s * SLICE, (s + 1) * SLICE)
        at = np.flatnonzero(total[own])
        if len(at):
            yield batch_of(
                _COUNTS, slice=[first + s], at=[at.astype("<u2").tobytes()], toxic=[toxic[own][at].astype("<u8").tobytes()],
                all=[total[own][at].astype("<u8").tobytes()], tokens=[tokens], toxic_tokens=[toxic_tokens],
            )
            tokens = toxic_tokens = 0


def count_tokens(labelled: DataFrame) -> DataFrame:
    """Bucket counts of (text, toxic), one row for each slice of the table."""

    def count(batches):
        toxic, total = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        tokens = toxic_tokens = 0
        for c in chunks(batches, ["text", "toxic"]):
            words = Words(c["text"])
            bad = np.asarray(c["toxic"], dtype=bool)[words.text_of()]
            at = token_buckets(words)
            total += np.bincount(at.ravel(), minlength=BUCKETS)
            toxic += np.bincount(at[:, bad].ravel(), minlength=BUCKETS)
            tokens, toxic_tokens = tokens + at.shape[1], toxic_tokens + int(bad.sum())
        yield from _rows(toxic, total, 0, tokens, toxic_tokens)

    def merge(key, batches):
        toxic, total, tokens, toxic_tokens = np.zeros(SLICE, np.int64), np.zeros(SLICE, np.int64), 0, 0
        for b in batches:
            for r in b.to_pylist():
                at = np.frombuffer(r["at"], "<u2")
                toxic[at] += np.frombuffer(r["toxic"], "<u8").astype(np.int64)
                total[at] += np.frombuffer(r["all"], "<u8").astype(np.int64)
                tokens, toxic_tokens = tokens + r["tokens"], toxic_tokens + r["toxic_tokens"]
        yield from _rows(toxic, total, key[0], tokens, toxic_tokens)

    parts = labelled.select("text", "toxic").mapInArrow(count, _COUNTS_DDL)
    return per_group(parts, ["slice"], merge, _COUNTS_DDL)


@dataclass
class Model:
    """base: share of toxic tokens; toxic, all: bucket counts; lam, log_k: the Gumbel law; weights: the logistic curve."""

    base: float
    toxic: np.ndarray
    all: np.ndarray
    lam: float = 1.0
    log_k: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def token_scores(self, words: Words) -> np.ndarray:
        share = np.full(len(words.starts), self.base, np.float32)
        for at in token_buckets(words):
            share = (self.toxic[at] + PRIOR * share) / (self.all[at] + PRIOR)
        share = np.clip(share, 1e-6, 1 - 1e-6)
        return np.log(share / (1 - share)) - math.log(self.base / (1 - self.base)) - DRIFT


def _table(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Toxic and all counts of each bucket, and the tokens and toxic tokens counted, from the rows of count_tokens."""
    toxic, every = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    for r in rows:
        at = r["slice"] * SLICE + np.frombuffer(bytes(r["at"]), "<u2").astype(np.int64)
        toxic[at], every[at] = np.frombuffer(bytes(r["toxic"]), "<u8"), np.frombuffer(bytes(r["all"]), "<u8")
    return toxic, every, sum(r["tokens"] for r in rows), sum(r["toxic_tokens"] for r in rows)


def maximal_segments(places: list[int], values: list[float], before: list[float]) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal scoring segments, in linear time.

    places: where scores are positive; values: the scores; before: the sum of all scores to the left of each.
    """
    found: list[list] = []  # first, last, left sum, right sum, nearest earlier one with a smaller left sum
    for p, v, left in zip(places, values, before):
        first, last, low, high = p, p, left, left + v
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append([first, last, low, high, j])
                break
            first, low = found[j][0], found[j][2]
            nearest = found[j][4]
            del found[j:]
            j = nearest
    return [(f[0], f[1], f[3] - f[2]) for f in found]


def segments_of(model: Model, words: Words) -> list[list[tuple[int, int, float]]]:
    scores = model.token_scores(words).astype(np.float64)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    up = np.flatnonzero(scores > 0)
    cuts = np.searchsorted(up, words.bounds)
    out = []
    for i in range(len(words.counts)):
        own = up[cuts[i] : cuts[i + 1]]
        start = words.bounds[i]
        out.append(maximal_segments((own - start).tolist(), scores[own].tolist(), (sums[own] - sums[start]).tolist()) if len(own) else [])
    return out


def features(model: Model, n_tokens: int, segments: list) -> tuple[float, int]:
    """The best segment's -ln(expected number of such), and how many segments are significant."""
    shift = math.log(max(n_tokens, 1)) + model.log_k
    z = [model.lam * s - shift for _, _, s in segments]
    return max([*z, -shift]), sum(x > -math.log(MAX_E) for x in z)


def _probability(w: np.ndarray, best, count):
    return 1 / (1 + np.exp(-np.clip(w[0] + w[1] * np.clip(best, -20, 60) / 10 + w[2] * np.log1p(count), -40, 40)))


def _fit_logistic(best: np.ndarray, count: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    x = np.stack([np.ones(len(best)), np.clip(best, -20, 60) / 10, np.log1p(count)], axis=1)
    w = np.zeros(3)
    for _ in range(50):
        p = _probability(w, best, count)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(3), x.T @ (toxic - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _lambda(histogram: np.ndarray) -> float:
    p = histogram / max(histogram.sum(), 1)
    s = _LOW + _STEP * (np.arange(_BINS) + 0.5)
    if not (p[s > 0].sum() > 0 and (p * s).sum() < 0):
        return 1.0
    low, high = 1e-6, 50.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (low, middle) if (p * np.exp(middle * np.clip(s, None, 600 / middle))).sum() > 1 else (middle, high)
    return low


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> Model | float:
    """The model from labelled documents whose crc32(doc_id) mod folds is not 0; a constant if one kind is missing."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = stored(marks.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"), fold.alias("fold")).where("fold > 0"))
    total, bad = marks.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    labelled = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id") if total <= LABELS_SENT else stored(docs.select("doc_id", "text").join(marks, "doc_id"))
    if not 0 < bad < total:
        return bad / total if total else 0.0
    last = F.col("fold") == folds - 1
    toxic, every, n, n_toxic = _table([r.asDict() for r in count_tokens(labelled.where(~last)).collect()])
    if not 0 < n_toxic < n:
        return bad / total
    model = Model(n_toxic / n, toxic, every)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int64()), ("n", pa.int64()), ("best", pa.float64()), ("scores", pa.list_(pa.float64())), ("histogram", pa.list_(pa.int64()))])

    def measure(batches):
        for c in chunks(batches, ["doc_id", "text", "toxic"]):
            words = Words(c["text"])
            all_segments = segments_of(sent.value, words)
            scores, clean = sent.value.token_scores(words), ~np.asarray(c["toxic"], bool)[words.text_of()]
            bins = np.clip((scores[clean] - _LOW) / _STEP, 0, _BINS - 1).astype(int)
            counted = [np.bincount(bins, minlength=_BINS).tolist(), *[[]] * (len(c["text"]) - 1)]
            best = [max((s for *_, s in x), default=0.0) for x in all_segments]
            yield batch_of(schema, doc_id=c["doc_id"], toxic=c["toxic"], n=words.counts, best=best, scores=[[s for *_, s in x] for x in all_segments], histogram=counted)

    measured = stored(labelled.where(last).mapInArrow(measure, "doc_id long, toxic long, n long, best double, scores array<double>, histogram array<long>"))
    bins = measured.select(F.posexplode("histogram").alias("bin", "c")).groupBy("bin").agg(F.sum("c").alias("c")).collect()
    histogram = np.zeros(_BINS)
    for r in bins:
        histogram[r["bin"]] = r["c"]
    model.lam = _lambda(histogram)
    clean = measured.where("toxic = 0 AND n > 0")
    mean = clean.agg(F.avg(F.col("best") * model.lam - F.log("n"))).first()[0]
    model.log_k = (mean or 0.0) - 0.5772156649
    # the two features of each sampled text, as ``features`` gives them; the segments themselves stay where they are
    shift = F.log(F.greatest("n", F.lit(1))) + F.lit(float(model.log_k))
    z = F.concat(F.array(-shift), F.transform("scores", lambda s: s * F.lit(float(model.lam)) - shift))
    significant = F.size(F.filter(F.transform("scores", lambda s: s * F.lit(float(model.lam)) - shift), lambda x: x > F.lit(-math.log(MAX_E))))
    sample = measured.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).select("toxic", F.array_max(z).alias("best"), significant.alias("n_significant")).collect()
    pairs = [(r["best"], r["n_significant"]) for r in sample]
    if pairs and 0 < sum(r["toxic"] for r in sample) < len(sample):
        model.weights = _fit_logistic(np.array([x for x, _ in pairs]), np.array([x for _, x in pairs]), np.array([r["toxic"] for r in sample]))
    else:
        model.weights = np.array([math.log(bad / (total - bad)), 1.0, 1.0])
    more_toxic, more, more_n, more_n_toxic = _table([r.asDict() for r in count_tokens(labelled.where(last)).collect()])
    return replace(model, base=(n_toxic + more_n_toxic) / (n + more_n), toxic=toxic + more_toxic, all=every + more)


SPANS = "array<struct<start:long,end:long,score:double>>"


def score_toxicity(docs: DataFrame, model: Model | float) -> DataFrame:
    """docs with score (0 to 1), predicted and toxic_spans: significant passages, in tokens."""
    own = ["score", "predicted", "toxic_spans"]
    rest = [c for c in docs.columns if c not in own]
    docs = docs.select(*rest)
    if isinstance(model, float | int):
        return docs.select("*", F.lit(float(model)).alias("score"), F.lit(int(model >= 0.5)).alias("predicted"), F.expr(f"CAST(array() AS {SPANS})").alias("toxic_spans"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            score, spans = [], []
            for c in chunks([b], ["text"]):
                words = Words(c["text"])
                for n, segments in zip(words.counts, segments_of(sent.value, words)):
                    score.append(float(_probability(sent.value.weights, *features(sent.value, int(n), segments))))
                    least = (math.log(max(n, 1)) + sent.value.log_k - math.log(MAX_E)) / sent.value.lam
                    spans.append([{"start": a, "end": z + 1, "score": s} for a, z, s in segments if s > least])
            arrays = [*(b.column(c) for c in rest), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, *own])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{names}, score double, predicted int, toxic_spans {SPANS}")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", "predicted")
