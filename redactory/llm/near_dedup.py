"""Near-duplicate documents by SuperMinHash: signatures, banding, verification on full sets, connected components.

SuperMinHash gives each element a random permutation of the signature's places and random values whose whole part is
the step, so that the places' ranks are correlated and the variance is lower than MinHash's. Steps run for all
elements of a document at once and stop as soon as no place can improve.

Documents with equal shingle sets are one class, found by a digest, and only the least id of a class goes on. Classes
that share a band bucket are compared by signature, inside tasks, and each task gives back a forest of those that
agree in most places, never pairs. The forests' components are clusters. Inside a cluster all pairs are confirmed on
full sets, again inside tasks that give back a forest of the confirmed links; the components of these are the result.

A bucket or cluster too large for a task is cut into blocks. First each block is compared inside and with ``PIVOTS``
members of the whole group; in a group of near copies this links nearly all of them. Then only members outside the
group's largest component so far meet all blocks, so no link is lost: two members either met in a block, or are both in
that component, or one of them is outside. What is moved is in proportion to the group while few are outside.

The bands find a pair at similarity 0.8 with probability 1 - (1 - 0.8**ROWS)**BANDS, above 0.999998.

Defined cases: null and empty texts have no shingles and link with nothing; very long texts are handled whole; ties
go to the smallest doc_id; rows that repeat a doc_id are one document and each gets a row; a null doc_id keeps its row
with a null component and stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm.common import Words, batch_of, bound_batches, chunks, connected_components, fold_hash, mix, per_group, read_table, stored

BANDS, ROWS = 24, 4
PLACES = BANDS * ROWS
#: Pairs whose signatures agree in less than this are not compared in full; at similarity 0.8 that is 5 deviations off.
LEAST_AGREEMENT = 0.6
#: Ids of clustered documents go to the workers up to this many (16 MB); beyond it, texts are joined by shuffle.
IDS_SENT = 2_000_000
HOT_CLASSES = 100_000
#: A set weighs this much at least, so that a part of a cluster holds at most some 2,000 sets, however short the texts.
LEAST_WEIGHT = 400
#: Members that every block of a large group is compared with, about.
PIVOTS = 32


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct shingles of each text, sorted. A text of fewer words is one shingle."""
    words = Words(texts)
    h, owner, counts = words.hashes, words.text_of(), words.counts
    last = np.flatnonzero(np.arange(len(h)) + width <= words.bounds[1:][owner]) if len(h) else np.zeros(0, int)
    owners, hashes = [owner[last]], [fold_hash([h[last + i] for i in range(width)])]
    for k in range(1, width):
        short = words.bounds[:-1][counts == k]
        owners.append(owner[short])
        hashes.append(fold_hash([np.full(len(short), k, np.uint64), *[h[short + i] for i in range(k)]]))
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, bool)
    return owner[new], h[new]


def super_minhash(owner: np.ndarray, hashes: np.ndarray, n_texts: int, places: int) -> np.ndarray:
    """Signatures, n_texts x places of uint64: step in the top byte, a random fraction below."""
    out = np.full((n_texts, places), np.uint64(2**64 - 1), np.uint64)
    flat, perm = out.reshape(-1), None
    rows = np.arange(len(hashes))
    for j in range(places):
        r = mix(hashes[rows] + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & 2**64 - 1))
        k = j + (mix(r ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(places - j)).astype(np.int64)
        if j == 0:
            place = k
        else:
            at = np.arange(len(rows))
            place = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, j]
            perm[:, j] = place
        np.minimum.at(flat, owner[rows] * places + place, np.uint64(j << 56) | (r >> np.uint64(8)))
        open_texts = out.max(axis=1) >= np.uint64((j + 1) << 56)
        keep = open_texts[owner[rows]]
        if not keep.any():
            break
        if j == 0:
            perm = np.tile(np.arange(places, dtype=np.uint8), (int(keep.sum()), 1))
            at, moved = np.arange(len(perm)), place[keep]
            perm[at, moved] = perm[:, 0]
            perm[:, 0] = moved
        else:
            perm = perm[keep]
        rows = rows[keep]
    return out


def _digest(hashes: np.ndarray, bounds: np.ndarray, which: int) -> np.ndarray:
    """64 bits of each set, whatever its order."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64((0x1234567, 0x89ABCDE)[which])))])
    return (sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sig", pa.binary()), ("buckets", pa.list_(pa.int64()))])


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, n, d1, d2, sig, buckets): set size, set digest, a byte of each place, a bucket for each band; and ``keep``, long columns."""
    places = bands * rows
    salt, keep = mix(np.arange(1, bands + 1, dtype=np.uint64)), keep or []
    schema = pa.schema([*_SIGNED, *((c, pa.int64()) for c in keep)])

    def run(batches):
        for c in chunks(batches, ["doc_id", "text", *keep]):
            k = len(c["doc_id"])
            owner, h = shingle_sets(c["text"], width)
            n = np.bincount(owner, minlength=k)
            bounds = np.concatenate([[0], np.cumsum(n)])
            sig = super_minhash(owner, h, k, places)
            keys = fold_hash([*(sig.reshape(k, bands, rows)[:, :, i] for i in range(rows)), np.broadcast_to(salt, (k, bands))]).view(np.int64)
            low = (mix(sig) & np.uint64(255)).astype(np.uint8)
            own = {x: c[x] for x in keep}
            yield batch_of(schema, doc_id=c["doc_id"], n=n, d1=_digest(h, bounds, 0), d2=_digest(h, bounds, 1), sig=[x.tobytes() for x in low], buckets=list(keys), **own)

    ddl = "doc_id long, n long, d1 long, d2 long, sig binary, buckets array<long>" + "".join(f", `{c}` long" for c in keep)
    return docs.select("doc_id", "text", *keep).mapInArrow(run, ddl)


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, d1, d2, shingles) of whole texts."""

    def run(batches):
        for c in chunks(batches, ["doc_id", "text"]):
            owner, h = shingle_sets(c["text"], width)
            n = np.bincount(owner, minlength=len(c["doc_id"]))
            bounds = np.concatenate([[0], np.cumsum(n)])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64)))
            yield batch_of(_SETS, doc_id=c["doc_id"], n=n, d1=_digest(h, bounds, 0), d2=_digest(h, bounds, 1), shingles=lists)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, shingles array<long>")


def spanning_forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what a symmetric matrix connects, one less than the members of each part."""
    n = len(near)
    seen, parents, children = np.zeros(n, bool), [], []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        front = np.array([root])
        while len(front):
            reach = near[front]
            new = np.flatnonzero(reach.any(axis=0) & ~seen)
            if len(new):
                parents.append(front[np.argmax(reach[:, new], axis=0)])
                children.append(new)
                seen[new] = True
            front = new
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *parents]), np.concatenate([empty, *children])


def agreement(sigs: np.ndarray, least: int) -> np.ndarray:
    """Which pairs of signatures agree in ``least`` places or more."""
    out = np.zeros((len(sigs), len(sigs)), bool)
    step = max(1, (1 << 23) // max(1, sigs.size))
    for i in range(0, len(sigs), step):
        out[i : i + step] = (sigs[i : i + step, None, :] == sigs[None, :, :]).sum(axis=2) >= least
    return out


def similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets have 100 * intersection >= percent * union; sizes of intersections by products of 0/1 columns."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    elements, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(column, minlength=len(elements)) > 1
    row = np.repeat(np.arange(n), sizes)[shared[column]]
    column = (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float64)
    width = int(min(4096, max(1, shared.sum())))
    for first in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [first, first + width])
        part = np.zeros((n, width), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    return 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _groups_of(batches, group: str, value: str):
    """(group, its reps, their values, places in the part's table) for each group within a part, and that table."""
    table = pa.Table.from_batches(list(batches))
    groups, items = (table.column(c).to_numpy() for c in (group, "rep"))
    values = table.column(value).to_pylist() if value == "sig" else table.column(value).combine_chunks()
    order = np.lexsort((items, groups))
    edges = np.flatnonzero(np.concatenate([[True], groups[order][1:] != groups[order][:-1], [True]]))
    return table, [(groups[order[x]], items[order[x:z]], [values[int(i)] for i in order[x:z]], order[x:z]) for x, z in zip(edges[:-1], edges[1:])]


def _forests(rows: DataFrame, group: str, value: str, connect) -> DataFrame:
    """Edges (a, b) of a forest for each group within each part; connect(values) -> which pairs are connected."""

    def run(key, batches):
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, items, values, _ in _groups_of(batches, group, value)[1]:
            if len(items) > 1:
                p, c = spanning_forest(connect(values))
                a.append(items[p])
                b.append(items[c])
        yield batch_of(_EDGES, a=np.concatenate(a), b=np.concatenate(b))

    return per_group(rows.select("part", group, "rep", value), ["part"], run, "a long, b long").where("a <> b")


_HOME = pa.schema([("kind", pa.int32()), ("g", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _at_home(rows: DataFrame, group: str, value: str, connect) -> DataFrame:
    """(kind, g, a, b) for the blocks of large groups with their pivots: 0 an edge of a forest, 1 a member at home and the
    least pivot that it is connected with in its block, 2 two pivots that are connected."""

    def run(key, batches):
        table, found = _groups_of(batches, group, value)
        pivot, home = (table.column(c).to_numpy(zero_copy_only=False) for c in ("pivot", "home"))
        out = []
        for g, items, values, at in found:
            p, c = spanning_forest(connect(values))
            root = np.arange(len(items))
            for x, y in zip(p.tolist(), c.tolist()):  # parents come before their children
                root[y] = root[x]
            out += [(0, g, items[x], items[y]) for x, y in zip(p.tolist(), c.tolist())]
            least: dict[int, int] = {}
            for i in np.flatnonzero(pivot[at]).tolist():
                least[root[i]] = min(least.get(root[i], items[i]), items[i])
            out += [(2, g, least[root[i]], items[i]) for i in np.flatnonzero(pivot[at]).tolist()]
            out += [(1, g, items[i], least[root[i]]) for i in np.flatnonzero(home[at]).tolist() if root[i] in least]
        yield batch_of(_HOME, **{f.name: [x[k] for x in out] for k, f in enumerate(_HOME)})

    return per_group(rows.select("part", group, "rep", "pivot", "home", value), ["part"], run, "kind int, g long, a long, b long")


def _pivot_roots(edges: DataFrame) -> DataFrame:
    """(g, pivot, root) from distinct edges (g, a, b) of the pivots of each group, which are few."""

    def run(key, batches):
        root: dict[int, int] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for b in batches:
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
        pivots = list(root)
        yield pa.RecordBatch.from_pydict({"g": [key[0]] * len(pivots), "pivot": pivots, "root": [find(x) for x in pivots]}, schema=pa.schema([("g", pa.int64()), ("pivot", pa.int64()), ("root", pa.int64())]))

    return per_group(edges, ["g"], run, "g long, pivot long, root long")


def linked(rows: DataFrame, group: str, value: str, connect, block_weight: int, task_weight: int) -> DataFrame:
    """Edges (a, b) that connect, in each group of rows (group, rep, w, value), what ``connect`` connects.

    Groups of up to ``block_weight`` are put together until they make about ``task_weight``; larger ones go in blocks.
    """
    sizes = rows.groupBy(group).agg(F.sum("w").alias("_weight"), F.count("*").alias("_n")).where("_n > 1")
    sizes = stored(sizes.select(group, F.ceil(F.col("_weight") / block_weight).cast("int").alias("_blocks"), "_weight", "_n"))
    totals = sizes.agg(F.coalesce(F.sum(F.when(F.col("_blocks") == 1, F.col("_weight"))), F.lit(0)), F.count_if(F.col("_blocks") > 1)).first()
    placed = rows.join(sizes, group).withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int"))
    small = placed.where("_blocks = 1").withColumn("part", F.concat(F.lit("s"), F.pmod(F.xxhash64(group), F.lit(max(1, int(totals[0]) // task_weight)))))
    if not totals[1]:
        return _forests(small, group, value, connect)
    large = placed.where("_blocks > 1")
    blocks = F.sequence(F.lit(0), F.col("_blocks") - 1)
    marked = large.withColumn("pivot", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("_n")) < PIVOTS)
    guests = marked.where("pivot").withColumn("_block", F.explode(blocks)).where("_block <> _own").withColumn("home", F.lit(False))
    at_home = marked.withColumn("_block", F.col("_own")).withColumn("home", F.lit(True)).unionByName(guests).withColumn("part", F.concat_ws("-", group, "_block"))
    met = stored(_at_home(at_home, group, value, connect))
    first = _forests(small, group, value, connect).unionByName(met.where("kind = 0 AND a <> b").select("a", "b"))
    roots = stored(_pivot_roots(met.where("kind = 2").select("g", "a", "b").distinct()))
    known = met.where("kind = 1").select("g", F.col("a").alias("rep"), F.col("b").alias("pivot")).join(roots, ["g", "pivot"]).select(F.col("g").alias(group), "rep", "root")
    main = known.groupBy(group, "root").agg(F.count("*").alias("n")).groupBy(group).agg(F.max_by("root", F.struct("n", "root")).alias("root"))
    inside = known.join(main, [group, "root"]).select(group, "rep")
    outside = stored(large.select(group, "rep", "w").join(inside, [group, "rep"], "left_anti"))
    parts = outside.groupBy(group).agg(F.ceil(F.sum("w") / block_weight).cast("int").alias("_chunks"))
    cut = large.join(parts, group)
    chunks_ = F.sequence(F.lit(0), F.col("_chunks") - 1)
    everyone = cut.withColumn("_chunk", F.explode(chunks_)).withColumn("_block", F.col("_own"))
    guests = cut.join(outside.select(group, "rep"), [group, "rep"]).withColumn("_chunk", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("_chunks")).cast("int")).withColumn("_block", F.explode(blocks))
    again = everyone.unionByName(guests.where("_block <> _own").select(*everyone.columns)).withColumn("part", F.concat_ws("-", group, "_block", "_chunk"))
    return first.unionByName(_forests(again, group, value, connect))


def _in_classes(signed: DataFrame, class_of: DataFrame) -> DataFrame:
    """signed (n, d1, d2, ...) with class_id and component_id, null for sets without a class.

    Classes of more than a ``HOT_CLASSES``-th of all rows are fewer than ``HOT_CLASSES`` and are sent to the workers, so that
    no key of the join is large; empty sets, which have no class, do not take part in it.
    """
    key, ids = ["n", "d1", "d2"], ["class_id", "component_id"]
    hot = F.col("copies") > F.lit(signed.count()) / HOT_CLASSES
    near = signed.join(F.broadcast(class_of.where(hot).drop("copies")), key, "left")
    rest = near.where("class_id IS NULL AND n > 0").drop(*ids).join(class_of.where(~hot).drop("copies"), key, "left")
    return near.where("class_id IS NOT NULL OR n = 0").unionByName(rest.select(*near.columns))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, class_id (equal sets), component_id, kept; and ``keep``, long columns of docs."""
    bound_batches(docs.sparkSession)
    keep = keep or []
    signed = stored(signatures(docs, width, keep=keep))
    classes = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("buckets").alias("buckets"), F.count("*").alias("copies"))
    classes = stored(classes)
    least = int(LEAST_AGREEMENT * PLACES)
    members = classes.select("rep", F.explode(F.array_distinct("buckets")).alias("bucket"), F.lit(1).alias("w"))
    # signatures join those that share a bucket only after the others are gone
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    crowded = stored(members.join(shared, "bucket").join(classes.select("rep", "sig"), "rep"))
    alike = linked(crowded, "bucket", "sig", lambda x: agreement(np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1), least), 1000, 20_000)
    clusters = stored(connected_components(alike).toDF("rep", "cluster"))
    crowd = classes.select("rep", "n", "d1", "d2").join(clusters, "rep")
    ids = clusters.select(F.col("rep").alias("doc_id"))
    sets = full_sets(docs.join(F.broadcast(ids) if ids.count() <= IDS_SENT else ids, "doc_id", "left_semi"), width)
    sets = stored(crowd.join(sets.withColumnRenamed("doc_id", "rep").dropDuplicates(["rep", "n", "d1", "d2"]), ["rep", "n", "d1", "d2"]).select("cluster", "rep", "n", "shingles"))
    sets = sets.withColumn("w", F.greatest("n", F.lit(LEAST_WEIGHT)))
    links = linked(sets, "cluster", "shingles", lambda x: similar([np.asarray(v.values) for v in x], percent), 400_000, 800_000)
    found = connected_components(links).toDF("rep", "component")
    class_of = classes.join(found, "rep", "left").select("n", "d1", "d2", "copies", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    out = _in_classes(signed.select("doc_id", "n", "d1", "d2", *keep), stored(class_of))
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *keep)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, width=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")
