"""Best-fit packing with linear grouping.

Lengths are whole numbers up to the capacity, so the corpus is known by a histogram of at most ``capacity`` rows. On
it the plan is made: large lengths, in decreasing order, are cut into groups of equal cardinality and rounded up to
the group's greatest; configurations of these few sizes are optimised by column generation; whole numbers of them are
filled with the actual lengths; what is over, and then the small lengths, go best-fit, from long to short, into the
gaps or into new sequences. Equal sequences are held as runs, so the plan's size does not grow with the corpus.

On Spark, documents are tokenised where they lie; each piece gets its rank among those of its length (a count by
shard, then a row number inside the shard, so a length that a third of all pieces have is many small tasks), and the
rank is looked up in the plan, which is broadcast.

Defined cases: a null or empty text is the end token alone; longer texts are cut into full pieces, the last may be
shorter; rows that repeat are packed each; ties in length go by doc_id, piece and content, equal rows in any order; a
null doc_id is packed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactory.llm.common import Words, batch_of, chunks, read_table, stored

CAPACITY = 2048
#: A length over capacity / n is large, in so many groups; of these plans the one with the fewest sequences is taken.
THRESHOLDS = ((2, 64), (3, 64), (4, 32))
SHARD_ROWS = 20_000
CACHED_WORDS = 1_000_000
_ENDS = ".,;:!?#$%&*"
#: Of each byte: 0 space, 1 letter, 2 digit, 3 other, 4 an apostrophe, 5 not ASCII.
_KIND = np.full(256, 3, np.int8)
_KIND[[32, 39]], _KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = (0, 4), 2, 1, 1, 5
_CODERS: dict[str, tuple] = {}


def _coder(path: str):
    if path not in _CODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(path)
        vocabulary = coder.get_vocab()
        last = np.zeros(max(vocabulary.values()) + 1, bool)
        last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        _CODERS[path] = (coder, last, Known())
    return _CODERS[path]


class Known:
    """Token ids of words, by two independent hashes of 64 bits: flat arrays, as many small objects would cost more."""

    def __init__(self):
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.first, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Places of the words, -1 for those not known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (self.checks[at] == checks), at, -1)

    def add(self, keys: np.ndarray, checks: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Words, how many ids each has, and the ids of all one after another."""
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        first = len(self.ids) + np.cumsum(count) - count
        self.keys, self.checks = np.insert(self.keys, at, keys[order]), np.insert(self.checks, at, checks[order])
        self.first, self.count = np.insert(self.first, at, first[order]), np.insert(self.count, at, count[order])
        self.ids = np.concatenate([self.ids, ids])


def _parts(words: list[bytes]) -> np.ndarray:
    """How many parts each word is coded in: runs of letters, single digits, runs of anything else; 0 if that is not plain."""
    kind = _KIND[np.frombuffer(b" ".join(words) + b" ", np.uint8)]
    ends = np.flatnonzero(kind == 0)
    begins = np.concatenate([[0], ends[:-1] + 1])
    new = ((kind != np.concatenate([[0], kind[:-1]])) & (kind > 0)) | (kind == 2)
    sums, odd = np.concatenate([[0], np.cumsum(new)]), np.concatenate([[0], np.cumsum(kind > 3)])
    out = sums[ends] - sums[begins]
    for i in np.flatnonzero(odd[ends] > odd[begins]).tolist():
        text = words[i].decode("utf-8")
        core = text.rstrip(_ENDS)
        whole = core.isalpha() and core[-1] < "\u0250"
        out[i] = 1 + (len(core) < len(text)) if whole else int(text.isalpha())
    return out


def _code_words(words: list[bytes], coder, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which word, how many ids, ids). Plain words are coded many at once and told apart by the ids that end a part.

    A letter that is none any more when composed and lowered makes more parts than were counted, never fewer; then each
    word of that group is coded alone.
    """
    parts = _parts(words)
    many, single = np.flatnonzero(parts), np.flatnonzero(parts == 0).tolist()
    groups = [many[k : k + 1000] for k in range(0, len(many), 1000)]
    which, count, ids = [], [], []
    for own, e in zip(groups, coder.encode_batch_fast([b" ".join([words[i] for i in own.tolist()]).decode("utf-8") for own in groups], add_special_tokens=False)):
        coded = np.array(e.ids, "<u4")
        ends, expected = np.flatnonzero(last[coded]) + 1, np.cumsum(parts[own])
        if len(ends) != expected[-1]:
            single += own.tolist()
            continue
        which.append(own)
        count.append(np.diff(ends[expected - 1], prepend=0))
        ids.append(coded)
    for i, e in zip(single, coder.encode_batch_fast([words[i].decode("utf-8") for i in single], add_special_tokens=False)):
        which.append(np.array([i]))
        count.append(np.array([len(e.ids)]))
        ids.append(np.array(e.ids, "<u4"))
    return tuple(np.concatenate([np.zeros(0, t), *x]) for x, t in ((which, np.int64), (count, np.int64), (ids, "<u4")))


def encode_texts(texts: list[str | None], path: str) -> list[bytes]:
    """Token ids as little-endian uint32, without the end token.

    White space divides tokens and case is dropped, so words are coded once, in lower case, and kept. Each text's ids
    are then gathered from those of its words.
    """
    coder, last, known = _coder(path)
    marked = {i: t for i, t in enumerate(texts) if t and "<|" in t}  # may hold special tokens, which keep their case
    whole = {i: array("I", e.ids).tobytes() for i, e in zip(marked, coder.encode_batch_fast(list(marked.values()), add_special_tokens=False))}
    words = Words([None if i in whole else t for i, t in enumerate(texts)])
    keys, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
    all_checks = words.hashed([None], check=True)[0]
    checks = all_checks[first]
    if (checks[which] != all_checks).any():  # two words of one hash
        return [array("I", e.ids).tobytes() for e in coder.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    at = known.find(keys, checks)
    if (at < 0).any():
        if len(known.keys) + 2 * int((at < 0).sum()) > CACHED_WORDS:
            known.__init__()
            at[:] = -1
        new = np.flatnonzero(at < 0)
        lowered = words.raw.lower()
        own = zip(words.starts[first[new]].tolist(), words.ends[first[new]].tolist())
        which_new, n_ids, ids = _code_words([lowered[a:z] for a, z in own], coder, last)
        known.add(keys[new][which_new], checks[new][which_new], n_ids, ids)
        at = known.find(keys, checks)
        if (at < 0).any():  # another word of one hash is known
            known.__init__()
            return encode_texts(texts, path)
    count = known.count[at][which]
    end = np.cumsum(count)
    ids = known.ids[np.repeat(known.first[at][which] - end + count, count) + np.arange(int(end[-1]) if len(end) else 0)]
    cuts = np.concatenate([[0], end])[words.bounds].tolist()
    return [whole[i] if i in whole else ids[a:z].tobytes() for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:]))]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): each document's ids and the end token, cut at the capacity."""

    def run(batches):
        for c in chunks(batches, ["doc_id", "text"]):
            rows = []
            for i, ids in zip(c["doc_id"], encode_texts(c["text"], tokenizer)):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(own) // 4, zlib.crc32(own), own if keep_ids else None))
            yield batch_of(_PIECES, **{f.name: [r[j] for r in rows] for j, f in enumerate(_PIECES)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


# --- the plan -----------------------------------------------------------------------------------------------------


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole multiplicities of configurations of few sizes: the linear relaxation by column generation, rounded down."""
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    need = np.array(demand, float)
    x = need / np.diag(basis)
    for _ in range(40 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        best, last = _knapsack(sizes, price, capacity)
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0 and last[c] != -1:
            if last[c] == -2:
                c -= 1
            else:
                column[last[c]] += 1
                c -= sizes[last[c]]
        direction = np.linalg.solve(basis, column)
        ratios = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratios))
        x = x - ratios[out] * direction
        x[out] = ratios[out]
        basis[:, out] = column
    whole = np.floor(np.maximum(x, 0) + 1e-6).astype(np.int64)
    return [(basis[:, j].astype(np.int64), int(m)) for j, m in enumerate(whole) if m]


def _knapsack(sizes: list[int], price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each room, and its last choice: -2 for less room, -1 for nothing."""
    s, p = np.array(sizes), np.asarray(price)
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c], last[c] = best[c - 1], -2
        fit = s <= c
        if fit.any():
            value = np.where(fit, best[c - np.where(fit, s, c)] + p, -1.0)
            g = int(np.argmax(value))
            if value[g] > best[c] + 1e-12:
                best[c], last[c] = value[g], g
    return best, last


class Plan:
    """Runs of equal sequences, and for each length which ranks go where."""

    def __init__(self, capacity: int):
        self.capacity, self.n_sequences = capacity, 0
        self.used: dict[int, int] = {}  # length -> ranks given out
        self.rows: list[tuple[int, int, int, int, int, int]] = []  # length, first rank, ranks, first sequence, per sequence, offset
        self.free: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, how many)
        self.rooms: list[int] = []

    def open(self, count: int) -> int:
        first, self.n_sequences = self.n_sequences, self.n_sequences + count
        return first

    def put(self, length: int, count: int, first: int, each: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.rows.append((length, rank, count, first, each, offset))
        self.used[length] = rank + count

    def add_room(self, room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            if not self.free.get(room):
                self.free[room] = []
                bisect.insort(self.rooms, room)
            self.free[room].append((first, count))

    def best_fit(self, length: int, count: int) -> None:
        """As one by one into the least room that fits, for all pieces of a length."""
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                full, rest = divmod(count, each)
                first = self.open(full + bool(rest))
                self.put(length, count, first, each, 0)
                self.add_room(self.capacity - each * length, first, full)
                self.add_room(self.capacity - rest * length, first + full, 1 if rest else 0)
                return
            room = self.rooms[at]
            first, n = self.free[room].pop()
            if not self.free[room]:
                self.rooms.pop(at)
            each = room // length
            taken = min(count, each * n)
            full, rest = divmod(taken, each)
            self.put(length, taken, first, each, self.capacity - room)
            self.add_room(room - each * length, first, full)
            if rest:
                self.add_room(room - rest * length, first + full, 1)
            self.add_room(room, first + full + bool(rest), n - full - bool(rest))
            count -= taken


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    return min((_plan(histogram, capacity, n, groups) for n, groups in THRESHOLDS), key=lambda p: p.n_sequences)


def _plan(histogram: dict[int, int], capacity: int, small: int, groups: int) -> Plan:
    plan = Plan(capacity)
    left = dict(histogram)
    if n := left.pop(capacity, 0):
        plan.put(capacity, n, plan.open(n), 1, 0)
    large = [(x, left[x]) for x in sorted(left, reverse=True) if x > capacity // small]
    total = sum(n for _, n in large)
    if total:
        # groups of equal cardinality: runs (length, count) from long to short, cut at multiples of total / groups
        size, runs = -(-total // groups), [[]]
        room = size
        for x, n in large:
            while n:
                if not room:
                    runs.append([])
                    room = size
                take = min(n, room)
                runs[-1].append([x, take])
                n, room = n - take, room - take
        sizes, demand = [], []
        for g in runs:  # groups that round up to the same size are one size
            if sizes and sizes[-1] == g[0][0]:
                demand[-1] += sum(n for _, n in g)
            else:
                sizes.append(g[0][0])
                demand.append(sum(n for _, n in g))
        queues: list[list] = [[] for _ in sizes]
        for g in runs:
            queues[sizes.index(g[0][0])].extend(g)
        for counts, times in configurations(sizes, demand, capacity):
            slots = [g for g in range(len(sizes)) for _ in range(counts[g])]
            if not slots:
                continue
            taken = [_take(queues[g], times) for g in slots]
            first, done = plan.open(times), 0
            while done < times:  # a stretch of sequences in which each slot has one length
                stretch, offset = min(t[0][1] for t in taken), 0
                for t in taken:
                    plan.put(t[0][0], stretch, first + done, 1, offset)
                    offset += t[0][0]
                    t[0][1] -= stretch
                    if not t[0][1]:
                        t.pop(0)
                plan.add_room(capacity - offset, first + done, stretch)
                done += stretch
        for x, _ in large:
            left[x] -= plan.used.get(x, 0)
    for x in sorted(left, reverse=True):
        plan.best_fit(x, left[x])
    return plan


def _take(queue: list[list[int]], count: int) -> list[list[int]]:
    out = []
    while count:
        x, n = queue[0]
        take = min(n, count)
        out.append([x, take])
        queue[0][1] -= take
        if not queue[0][1]:
            queue.pop(0)
        count -= take
    return out


# --- on Spark -----------------------------------------------------------------------------------------------------


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length, ids_crc32, ...) with sequence_id and offset. ``pieces`` is read three times: store it."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = make_plan(histogram, capacity)
    shards = max(1, sum(histogram.values()) // SHARD_ROWS)
    sharded = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    sizes = sharded.groupBy("length", "_shard").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("length", "_shard", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_shard").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = sharded.withColumn("_rank", inside).join(offsets, ["length", "_shard"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before")).select(*pieces.columns, "_rank")
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 6)
    sent = pieces.sparkSession.sparkContext.broadcast((rows[:, 0] * 2**40 + rows[:, 1], rows))
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]

    def run(batches):
        keys, table = sent.value
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            row = table[np.searchsorted(keys, length * 2**40 + rank, side="right") - 1] if b.num_rows else np.zeros((0, 6), np.int64)
            each = np.maximum(row[:, 4], 1)
            at = rank - row[:, 1]
            arrays = [b.column(c) for c in names] + [pa.array(row[:, 3] + at // each), pa.array(row[:, 5] + at % each * length)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*names).schema)
    return ranked.mapInArrow(run, f"{ddl}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """docs (doc_id, text) -> pieces with token ids, sequence_id and offset, in few sequences of at most ``capacity``."""
    pieces = token_pieces(docs, tokenizer, capacity, keep_ids)
    return pack_pieces(stored(pieces if keep_ids else pieces.drop("ids")), capacity)


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizer(), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
