"""Hard-negative mining by exact search over norm buckets.

For each anchor its best rows of the same label are its positives; for each positive the best rows of another label whose
score lies in a window below the positive's score are its hard negatives. Scores are inner products of integer vectors.

Within a cell (see ``vector_cells``) candidates are sorted by norm, longest first, and cut into buckets. By Cauchy-Schwarz
no row of a bucket scores above |anchor| times the bucket's largest norm. An anchor leaves the search when that bound is
under what it still needs: the k-th positive so far, or for every window the larger of its lower limit and the k-th
negative so far. Norms only fall from there, so a cell ends when no anchor is left. Bounds leave ties in.

Defined cases: a null id, label or vector, or a component that is null or not finite, keeps a row out; a shorter vector is
filled up with zeros; scaled components are held within ±2**26, so that sums fit in 64 bits; rows that repeat are rows of
their own, also as anchors, and an anchor is never its own positive; ties go to the smaller id; labels of fewer rows than
asked for give fewer positives; a positive with a score under zero has an empty window; an empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactory.llm.common import batch_of, read_table, stored
from redactory.llm.vector_cells import BLOCK_ROWS, STRIPE_ROWS, best, dealt, in_cells, matrix, packed, parts, unpacked, width_of

BUCKET_ROWS, LIMIT = 512, 1 << 26
#: Below any score.
NONE = -(1 << 63) + 1
_ROWS = pa.schema([("uid", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.binary()), ("norm", pa.float64())])


def integer_vectors(vectors: DataFrame, width: int, scale: float) -> DataFrame:
    """(uid, vec_id, label, v, norm) of the rows that take part; v holds floor(scale * x) as 32-bit integers."""

    def run(batches):
        for b in batches:
            x, ok = matrix(b.column("embedding"), width)
            x = np.clip(np.floor(scale * x[ok]), -LIMIT, LIMIT)
            kept = b.filter(pa.array(ok))
            yield batch_of(_ROWS, uid=kept.column("uid"), vec_id=kept.column("vec_id"), label=kept.column("label"), v=packed(x.astype(np.int32)), norm=np.sqrt((x * x).sum(axis=1)))

    known = vectors.select("vec_id", "label", "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    return known.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(run, "uid long, vec_id long, label long, v binary, norm double")


def _by_bucket(held: pa.Table, width: int):
    """Buckets of a stripe, longest vectors first: largest norm, vectors, ids, uids, labels."""
    norms = held.column("norm").to_numpy()
    order = np.argsort(-norms, kind="stable")
    v = unpacked(held.column("v").combine_chunks(), width, np.int32)
    ids, uids, labels = (held.column(c).to_numpy() for c in ("vec_id", "uid", "label"))
    for at in range(0, len(order), BUCKET_ROWS):
        o = order[at : at + BUCKET_ROWS]
        yield norms[o[0]], v[o], ids[o], uids[o], labels[o]


def _scores(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products: as doubles where every partial sum stays a whole number in them, else as integers."""
    if bound < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _top(scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int):
    """The k best fitting columns of each row, as (score, id, uid) arrays; what is missing has the score NONE."""
    order = np.argsort(ids, kind="stable")
    s = np.where(fits, scores, NONE)[:, order]
    take = np.argsort(-s, axis=1, kind="stable")[:, :k]  # -NONE is the largest number there is
    return np.take_along_axis(s, take, axis=1), ids[order][take], uids[order][take]


class _Best:
    """The k best of each of n searches so far."""

    def __init__(self, n: int, k: int):
        self.k, self.score = k, np.full((n, k), NONE, np.int64)
        self.id, self.uid = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)

    def needed(self, least: np.ndarray | None = None) -> np.ndarray:
        kth = self.score[:, -1]
        return kth if least is None else np.maximum(kth, least)

    def offer(self, rows: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        some = fits.any(axis=1)
        if some.any():
            rows = rows[some]
            s, i, u = _top(scores[some], fits[some], ids, uids, self.k)
            both = [np.concatenate(x, axis=1) for x in ((self.score[rows], s), (self.id[rows], i), (self.uid[rows], u))]
            self.score[rows], self.id[rows], self.uid[rows] = best(*both, self.k)


def _reach(norms: np.ndarray, norm: float) -> np.ndarray:
    return norms * norm * (1 + 1e-12) + 1e-6


def _active(active: np.ndarray, norms: np.ndarray, norm: float, needed: np.ndarray) -> np.ndarray:
    return active[_reach(norms[active], norm) >= needed[active]]


def _sections(n: int, size: int = 1024):
    return (slice(at, at + size) for at in range(0, n, size))


def best_positives(rows: DataFrame, anchors: DataFrame, width: int, k: int, n_stripes: int, n_blocks: int) -> DataFrame:
    """(anchor uid, anchor_id, positive_id, positive_score): the k best other rows of the anchor's label."""
    schema = pa.schema([("uid", pa.int64()), ("anchor_id", pa.int64()), ("positive_uid", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])

    def search(ask: pa.Table, held: pa.Table):
        for part in _sections(ask.num_rows):
            a = ask.slice(part.start, part.stop - part.start).combine_chunks()
            v, norms = unpacked(a.column("v").combine_chunks(), width, np.int32), a.column("norm").to_numpy()
            labels, uids = a.column("label").to_numpy(), a.column("uid").to_numpy()
            found, active = _Best(len(v), k), np.arange(len(v))
            for norm, w, ids, others, their in _by_bucket(held, width):
                active = _active(active, norms, norm, found.needed())
                if not len(active):
                    break
                s = _scores(v[active], w, float(norm * norms.max()))
                fits = (labels[active][:, None] == their[None, :]) & (uids[active][:, None] != others[None, :]) & (s >= found.needed()[active][:, None])
                found.offer(active, s, fits, ids, others)
            at, rank = np.nonzero(found.score > NONE)
            yield batch_of(schema, uid=uids[at], anchor_id=a.column("vec_id").to_numpy()[at], positive_uid=found.uid[at, rank], positive_id=found.id[at, rank], positive_score=found.score[at, rank])

    out = in_cells(rows, anchors, n_stripes, n_blocks, search, "uid long, anchor_id long, positive_uid long, positive_id long, positive_score long")
    order = Window.partitionBy("uid").orderBy(F.desc("positive_score"), "positive_id", "positive_uid")
    return out.withColumn("no", F.row_number().over(order)).where(F.col("no") <= k)


def best_negatives(rows: DataFrame, anchors: DataFrame, width: int, k: int, n_stripes: int, n_blocks: int) -> DataFrame:
    """(anchor uid, positive number, negative_id, negative_score, rank) for anchors with a column ``windows``, array<struct<no, lo, hi>>."""
    schema = pa.schema([("uid", pa.int64()), ("no", pa.int32()), ("negative_uid", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])

    def search(ask: pa.Table, held: pa.Table):
        for part in _sections(ask.num_rows):
            a = ask.slice(part.start, part.stop - part.start).combine_chunks()
            listed = a.column("windows").combine_chunks()
            owner = np.repeat(np.arange(a.num_rows), pc_lengths(listed))  # a search is one window of one anchor
            window = listed.flatten()
            no, lo, hi = (window.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            v, norms = unpacked(a.column("v").combine_chunks(), width, np.int32), a.column("norm").to_numpy()
            labels, uids = a.column("label").to_numpy(), a.column("uid").to_numpy()
            found, active = _Best(len(owner), k), np.flatnonzero(lo <= hi)
            for norm, w, ids, others, their in _by_bucket(held, width):
                active = _active(active, norms[owner], norm, found.needed(lo))
                if not len(active):
                    break
                these = np.unique(owner[active])
                s = _scores(v[these], w, float(norm * norms.max()))
                s = s[np.searchsorted(these, owner[active])]
                fits = (labels[owner[active]][:, None] != their[None, :]) & (s >= found.needed(lo)[active][:, None]) & (s <= hi[active][:, None])
                found.offer(active, s, fits, ids, others)
            at, rank = np.nonzero(found.score > NONE)
            yield batch_of(schema, uid=uids[owner[at]], no=no[at], negative_uid=found.uid[at, rank], negative_id=found.id[at, rank], negative_score=found.score[at, rank])

    out = in_cells(rows, anchors, n_stripes, n_blocks, search, "uid long, no int, negative_uid long, negative_id long, negative_score long")
    order = Window.partitionBy("uid", "no").orderBy(F.desc("negative_score"), "negative_id", "negative_uid")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pc_lengths(listed: pa.Array) -> np.ndarray:
    return np.diff(listed.offsets.to_numpy())


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, stripe_rows: int = STRIPE_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Negatives of (vec_id, label, embedding): anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor is a condition on vec_id and label. The window of a positive with score p is low*p <= 100*score <= high*p.
    """
    width = width_of(vectors)
    rows = stored(integer_vectors(vectors, width, scale))
    n, n_anchors = rows.agg(F.count("*"), F.count_if(is_anchor)).first()
    n_stripes, n_blocks = parts(n, stripe_rows), parts(n_anchors, block_rows)
    striped = rows.withColumn("s", dealt(n_stripes))
    anchors = rows.where(is_anchor).withColumn("j", dealt(n_blocks))
    found = stored(best_positives(striped, anchors, width, positives, n_stripes, n_blocks))
    p = F.col("positive_score")
    window = F.struct("no", F.ceil(p * low / F.lit(100).cast("decimal(3,0)")).cast("long").alias("lo"), F.floor(p * high / F.lit(100).cast("decimal(3,0)")).cast("long").alias("hi"))
    listed = found.groupBy("uid").agg(F.collect_list(window).alias("windows"))  # at most ``positives`` of them
    no_windows = F.lit(None).cast("array<struct<no:int,lo:bigint,hi:bigint>>").alias("windows")
    negative = best_negatives(striped.select("*", no_windows), anchors.join(listed, "uid"), width, negatives, n_stripes, n_blocks)
    return found.join(negative, ["uid", "no"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    label = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    vectors = read_table(spark, sf_dir, "embeddings").select(vec_id.alias("vec_id"), label.alias("label"), "embedding")
    return mine_hard_negatives(vectors, F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.uid AS a, a.vec_id AS anchor_id, b.uid AS b, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.uid <> b.uid),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.other) QUALIFY row_number() OVER w <= 3
"""
