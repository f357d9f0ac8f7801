"""LM scoring: n-gram counts in a log-frequency Bloom filter.

A count c is quantised to the number of thresholds 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, ... (steps of a fifth) that
it reaches. An n-gram of level q puts the events (n-gram, 1) ... (n-gram, q) into the filter; asking for j = 1, 2, ...
until a miss gives the level back, and the middle of its range the count. A bigram model with the unigrams below it is
mixed by the Good-Turing mass of bigrams seen once. The filter errs upwards only, seldom, and never misses.

The bits of an event lie in one word of 64, so that a probe reads one place of memory. The filter is cut into blocks by hash, sized from
the text volume, so that each is made in a task of bounded size from counts that its tasks have united. It goes to the workers
while filter and exact unigram counts have at most ``limit_bytes``. Beyond that texts are bundled, and a bundle sends each block its
distinct n-grams, with how often its training texts have them, once: the block's task unites the counts, makes the block's
filter, and answers with the levels that its probes give. Answers meet their bundle's texts again, and hold no n-grams, as a
bundle knows what it asked. These are the same probes of the same bits, so the same scores; a task holds one block or one bundle.

Words are known by 64-bit hashes (see ``common.Words``); exact counts are exact up to their collisions.

Defined cases: a null or empty text is just its end token; very long texts are scored whole, some tokens at a
time; rows that repeat are scored each, and count each in training; a null doc_id is held out (its key is the empty
text's, and crc32 of that is 0); an empty table gives no rows; a corpus without training rows has N = V = 0; other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm.common import Words, batch_of, bound_batches, chunks, fold_hash, held_out, mix, per_group, read_table, shared_dir, stored, text_volume

BITS_PER_EVENT, PROBES = 12, 5
BLOCK_CHARS = 16_000_000
#: Filter and counts that go to all workers; they take about a byte for so many characters of training text (2.8 to 3.9 measured).
LIMIT_BYTES, CHARS_A_BYTE = 32 << 20, 4
BUNDLE_CHARS, STEP_TOKENS, REPLIES = 8 << 20, 1 << 17, 256
#: Characters scored at once: what a worker holds beside the filter is in proportion.
SCORED_CHARS = 1 << 18
END, START = np.uint64(0xE4D0), np.uint64(0x57A7)


def _thresholds() -> np.ndarray:
    t = [1]
    while t[-1] < 2**40:
        t.append(max(t[-1] + 1, t[-1] * 6 // 5))
    return np.array(t, np.int64)


LEVELS = _thresholds()
#: The count that each level stands for; level 0 is unseen.
MIDDLE = np.concatenate([[0.0], (LEVELS[:-1] + LEVELS[1:] - 1) / 2, [float(LEVELS[-1])]])


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tokens (with ends), the token before each (START at first), bounds of each text's tokens."""
    words = Words(texts)
    ends = words.bounds[1:]
    tokens = np.insert(words.hashes, ends, END)
    bounds = words.bounds + np.arange(len(words.bounds))
    before = np.concatenate([[START], tokens[:-1]]).astype(np.uint64)
    before[bounds[:-1]] = START
    return tokens, before, bounds


_PART = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_PART_DDL = "block int, kind int, keys binary, counts binary"


def _united(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first, dtype=np.int64) if len(first) else counts.astype(np.int64)


def _events(hashes: np.ndarray, level: int, n_words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each event (n-gram, level) and its bits there."""
    a = mix(hashes + np.uint64(level * 0x9E3779B97F4A7C15 & 2**64 - 1))
    mask = np.zeros(len(a), np.uint64)
    for i in range(PROBES):
        mask |= np.uint64(1) << ((a >> np.uint64(6 * i)) & np.uint64(63))
    return (((a >> np.uint64(32)) * np.asarray(n_words, np.uint64)) >> np.uint64(32)).astype(np.int64), mask


def _bits(keys: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A block's filter: the events of its n-grams."""
    bits = np.zeros(1 + int(level.sum()) * BITS_PER_EVENT // 64, np.uint64)
    for j in range(1, int(level.max(initial=0)) + 1):
        live = keys[level >= j]
        for a in range(0, len(live), STEP_TOKENS):
            np.bitwise_or.at(bits, *_events(live[a : a + STEP_TOKENS], j, len(bits)))
    return bits


def count_ngrams(train: DataFrame, n_blocks: int) -> DataFrame:
    """Packed counts by (block, kind): kind 1 tokens, 2 bigrams, 0 the start of texts; a row for each task."""

    def pack(held):
        for kind, parts in held.items():
            if parts:
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                edges = np.searchsorted(block_of(keys, n_blocks), np.arange(n_blocks + 1))
                for b in np.flatnonzero(np.diff(edges)):
                    own = slice(edges[b], edges[b + 1])
                    yield batch_of(_PART, block=[b], kind=[kind], keys=[keys[own].tobytes()], counts=[counts[own].astype("<u4").tobytes()])

    def run(batches):
        held: dict[int, list] = {0: [], 1: [], 2: []}
        n = 0
        for c in chunks(batches, ["text"]):
            tokens, before, bounds = ngrams(c["text"])
            held[0].append(np.full(len(c["text"]), START, np.uint64))
            held[1].append(tokens)
            held[2].append(fold_hash([before, tokens]))
            n += len(tokens)
            if n > 1_500_000:
                yield from pack(held)
                held, n = {0: [], 1: [], 2: []}, 0
        yield from pack(held)

    return train.select("text").mapInArrow(run, _PART_DDL)


_BLOCK = pa.schema([("block", pa.int32()), ("bits", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64()), ("bigrams", pa.int64()), ("once", pa.int64())])
_BLOCK_DDL = "block int, bits binary, keys binary, counts binary, tokens long, types long, bigrams long, once long"


def filter_blocks(parts: DataFrame) -> DataFrame:
    """The filter's blocks, with each block's exact token counts and totals."""

    def merge(key, batches):
        held: dict[int, tuple[list, list]] = {k: ([], []) for k in (0, 1, 2)}
        for b in batches:
            for kind, keys, counts in zip(*(b.column(c).to_pylist() for c in ("kind", "keys", "counts"))):
                held[kind][0].append(np.frombuffer(keys, np.uint64))
                held[kind][1].append(np.frombuffer(counts, "<u4"))
        united = {k: _united(np.concatenate([np.zeros(0, np.uint64), *a]), np.concatenate([np.zeros(0, "<u4"), *b])) for k, (a, b) in held.items()}
        keys = np.concatenate([united[k][0] for k in (0, 1, 2)])
        level = np.searchsorted(LEVELS, np.concatenate([united[k][1] for k in (0, 1, 2)]), side="right")
        bits = _bits(keys, level)
        tokens, counts = united[1]
        yield batch_of(
            _BLOCK, block=[key[0]], bits=[bits.tobytes()], keys=[tokens.tobytes()], counts=[counts.astype("<i8").tobytes()],
            tokens=[int(counts.sum())], types=[len(tokens)], bigrams=[int(united[2][1].sum())], once=[int((united[2][1] == 1).sum())],
        )

    return per_group(parts, ["block"], merge, _BLOCK_DDL)


def block_of(hashes: np.ndarray, n_blocks: int) -> np.ndarray:
    """Blocks are ranges of hashes, so blocks in order hold keys in order."""
    return (((hashes >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)).astype(np.int64)


class Filter:
    """Some or all blocks: levels of n-grams by probes, exact counts of tokens.

    sizes: (block, bytes of bits, bytes of keys). Arrays are made once, of their final size, as the driver holds all that
    is sent; blocks are then added in any order.
    """

    def __init__(self, n_blocks: int, sizes: list[tuple[int, int, int]], most: int):
        self.n_words, self.offset = np.ones(n_blocks, np.uint64), np.zeros(n_blocks, np.int64)
        self._first, words, n_keys = {}, 1, 0
        for block, bits, keys in sorted(sizes):
            self.n_words[block], self.offset[block], self._first[block] = bits // 8, words, n_keys
            words, n_keys = words + bits // 8, n_keys + keys // 8
        self.bits, self.keys, self.counts = np.zeros(words, np.uint64), np.zeros(n_keys, np.uint64), np.zeros(n_keys, np.uint32 if most < 2**32 else np.int64)

    def add(self, block: int, bits: bytes, keys: bytes, counts: bytes) -> None:
        n, k = self.offset[block], self._first[block]
        self.bits[n : n + len(bits) // 8] = np.frombuffer(bits, np.uint64)
        self.keys[k : k + len(keys) // 8], self.counts[k : k + len(keys) // 8] = np.frombuffer(keys, np.uint64), np.frombuffer(counts, "<i8")

    def exact(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.counts[at], 0).astype(np.int64)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        block = block_of(hashes, len(self.n_words))
        h, n, start = hashes, self.n_words[block], self.offset[block]
        out, live = np.zeros(len(hashes), np.int64), np.arange(len(hashes))
        for j in range(1, len(LEVELS) + 1):
            word, mask = _events(h, j, n)
            hit = self.bits[word + start] & mask == mask
            live, h, n, start = live[hit], h[hit], n[hit], start[hit]
            if not len(live):
                break
            out[live] = j
        return out


@dataclass
class Totals:
    tokens: int
    types: int
    weight: float


_SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_texts(ids: list, grams: tuple, known, totals: Totals) -> pa.RecordBatch:
    """grams: ``ngrams`` of the texts; known(singles, pairs) -> exact counts and levels of singles, levels of pairs; singles are distinct."""
    all_tokens, all_before, bounds = grams
    size = totals.tokens + 0.1 * (totals.types + 1)
    n_known, base_sum, score_sum = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids))
    owner = np.repeat(np.arange(len(ids)), np.diff(bounds))
    for a in range(0, len(all_tokens), STEP_TOKENS):
        tokens, before, own = all_tokens[a : a + STEP_TOKENS], all_before[a : a + STEP_TOKENS], owner[a : a + STEP_TOKENS]
        n = len(tokens)
        singles, which = np.unique(np.concatenate([tokens, before[:1], [START]]).astype(np.uint64), return_inverse=True)
        at, ctx = which[:n], np.concatenate([which[n : n + 1], which[: n - 1]])
        ctx[before == START] = which[n + 1]
        exact, level, pair_level = known(singles, fold_hash([before, tokens]))
        base = np.log10((exact[at] + 0.1) / size)
        single = MIDDLE[level]
        unigram = (single[at] + 0.1) / size
        context = single[ctx]
        both = np.minimum(MIDDLE[pair_level], context)
        bigram = np.divide(both, context, out=np.zeros(len(both)), where=context > 0)
        p = np.where(context > 0, totals.weight * bigram + (1 - totals.weight) * unigram, unigram)
        for total, values in ((n_known, exact[at] > 0), (base_sum, base), (score_sum, np.log10(np.minimum(p, 1.0)))):
            total += np.bincount(own, values, len(ids))
    return batch_of(_SCORED, doc_id=ids, n_tokens=np.diff(bounds), n_known=n_known.astype(np.int64), base_score=base_sum, score=score_sum)


_SCORED_DDL = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _scored_by_broadcast(docs: DataFrame, blocks: DataFrame, n_blocks: int, totals: Totals) -> DataFrame:
    sizes = [tuple(r) for r in blocks.select("block", F.octet_length("bits"), F.octet_length("keys")).collect()]
    whole = Filter(n_blocks, sizes, totals.tokens)
    for r in blocks.select("block", "bits", "keys", "counts").toLocalIterator():
        whole.add(r["block"], r["bits"], r["keys"], r["counts"])
    sent = docs.sparkSession.sparkContext.broadcast(whole)
    del whole

    def known(singles, pairs):
        return sent.value.exact(singles), sent.value.levels(singles), sent.value.levels(pairs)

    def run(batches):
        for c in chunks(batches, ["doc_id", "text"], size=SCORED_CHARS):
            yield score_texts(c["doc_id"], ngrams(c["text"]), known, totals)

    return docs.select("doc_id", "text").mapInArrow(run, _SCORED_DDL)


def _planes(a: np.ndarray) -> bytes:
    """The first byte of every number, then the second, and so on: zeros lie together, where compression finds them."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).view(kind).ravel()


def _tied(batches):
    """Tables of about ``BUNDLE_CHARS`` characters."""
    held, weight = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 32)
        start = before = 0
        while start < batch.num_rows:
            stop = min(batch.num_rows, int(np.searchsorted(ends, before + BUNDLE_CHARS - weight)) + 1)
            held.append(batch.slice(start, stop - start))
            weight += int(ends[stop - 1]) - before
            start, before = stop, int(ends[stop - 1])
            if weight >= BUNDLE_CHARS:
                yield pa.Table.from_batches(held)
                held, weight = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _bundles(docs: DataFrame) -> DataFrame:
    """Texts (doc_id, text, counted) tied up and compressed, written once, as the ask and the scores must see the same bundles."""

    def tie(batches):
        for table in _tied(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            yield pa.RecordBatch.from_pydict({"bundle": [uuid.uuid4().hex], "payload": [sink.getvalue().to_pybytes()]}, schema=schema)

    schema, kind, path = pa.schema([("bundle", pa.string()), ("payload", pa.binary())]), "bundle string, payload binary", shared_dir(docs.sparkSession)
    # a reader holds a row group at a time, so they are small
    small = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
    docs.mapInArrow(tie, kind).write.options(**small).parquet(path)
    return docs.sparkSession.read.schema(kind).parquet(path)


def _asked(grams: tuple, counted: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Distinct singles (START, too) and pairs of a bundle, in order, and how often the counted texts have them."""
    tokens, before, bounds = grams
    n = np.repeat(counted, np.diff(bounds)).astype(np.int64)
    return _united(np.append(tokens, START), np.append(n, counted.sum())), _united(fold_hash([before, tokens]), n)


def _edges(keys: np.ndarray, n_blocks: int) -> np.ndarray:
    return np.searchsorted(block_of(keys, n_blocks), np.arange(n_blocks + 1))


_ASK = pa.schema([("block", pa.int32()), ("late", pa.bool_()), ("bundle", pa.string()), ("singles", pa.binary()), ("n_singles", pa.binary()), ("pairs", pa.binary()), ("n_pairs", pa.binary())])
_ASK_DDL = "block int, late boolean, bundle string, singles binary, n_singles binary, pairs binary, n_pairs binary"


def _asks(table: pa.Table, bundle: str | None, n_blocks: int) -> pa.RecordBatch:
    """A row for each block: n-grams as differences, with counts; late: only asked, nothing counted."""
    counted = table.column("counted").to_numpy().astype(bool)
    kinds = _asked(ngrams(table.column("text").to_pylist()), counted)
    edges = [_edges(keys, n_blocks) for keys, _ in kinds]
    found = np.flatnonzero(np.diff(edges[0]) + np.diff(edges[1]))
    packed = []
    for (keys, counts), e in zip(kinds, edges):
        packed.append([_planes(np.diff(keys[e[b] : e[b + 1]], prepend=np.uint64(0))) for b in found])
        packed.append([_planes(counts[e[b] : e[b + 1]].astype("<u4")) for b in found])
    return batch_of(_ASK, block=found, late=[not counted.any()] * len(found), bundle=[bundle] * len(found), singles=packed[0], n_singles=packed[1], pairs=packed[2], n_pairs=packed[3])


_ANSWER = pa.schema([("bundle", pa.string()), ("block", pa.int32()), ("payload", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64()), ("bigrams", pa.int64()), ("once", pa.int64())])
_ANSWER_DDL = "bundle string, block int, payload binary, tokens long, types long, bigrams long, once long"


def _rows(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield {name: column[i].as_py() for name, column in zip(b.schema.names, b.columns)}


def _keys_of(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(raw, "<u8"), dtype=np.uint64)


class _Block:
    """A block's filter, made of rows with counts, and what it answers. The rows are taken out of their list."""

    def __init__(self, block: int, n_blocks: int, rows: list[dict]):
        self.bundles = [r["bundle"] for r in rows]
        self.keys, self.counts, self.which = {}, {}, {}
        for kind in ("singles", "pairs"):
            all_keys = np.concatenate([np.zeros(0, np.uint64), *(_keys_of(r[kind]) for r in rows)])
            counts = np.concatenate([np.zeros(0, "<u4"), *(_from_planes(r[f"n_{kind}"], "<u4") for r in rows)])
            self.keys[kind], which = np.unique(all_keys, return_inverse=True)
            self.counts[kind] = np.bincount(which, counts, len(self.keys[kind])).astype(np.int64)
            ends = np.cumsum([0, *(len(r[kind]) // 8 for r in rows)])
            which = which.astype(np.uint32)
            self.which[kind] = [which[a:b] for a, b in zip(ends[:-1], ends[1:])]
            del all_keys, counts
        rows.clear()
        keys, counts = (np.concatenate([x["singles"], x["pairs"]]) for x in (self.keys, self.counts))
        bits = _bits(keys, np.searchsorted(LEVELS, counts, side="right"))
        token = (self.counts["singles"] > 0) & (self.keys["singles"] != START)
        tokens, n = self.keys["singles"][token], self.counts["singles"][token]
        self.filter = Filter(n_blocks, [(block, 8 * len(bits), 8 * len(tokens))], int(n.sum()))
        self.filter.add(block, bits.tobytes(), tokens.tobytes(), n.astype("<i8").tobytes())
        self.levels = {kind: self._levels(k) for kind, k in self.keys.items()}
        self.exact = self.filter.exact(self.keys["singles"])
        paired = self.counts["pairs"]
        self.totals = {"tokens": int(n.sum()), "types": len(n), "bigrams": int(paired.sum()), "once": int((paired == 1).sum())}

    def answer(self, i: int) -> bytes:
        """To the i-th row of those it was made of."""
        s, p = self.which["singles"][i], self.which["pairs"][i]
        return self._packed(self.levels["singles"][s], self.levels["pairs"][p], self.exact[s])

    def answer_late(self, row: dict) -> bytes:
        s, p = _keys_of(row["singles"]), _keys_of(row["pairs"])
        return self._packed(self._levels(s), self._levels(p), self.filter.exact(s))

    def _levels(self, keys: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint8), *(self.filter.levels(keys[a : a + STEP_TOKENS]).astype(np.uint8) for a in range(0, len(keys), STEP_TOKENS))])

    @staticmethod
    def _packed(singles: np.ndarray, pairs: np.ndarray, exact: np.ndarray) -> bytes:
        return pa.compress(singles.tobytes() + pairs.tobytes() + _planes(exact.astype("<i8")), codec="zstd", asbytes=True)


def _scored_by_exchange(docs: DataFrame, train: DataFrame | Column, n_blocks: int) -> tuple[DataFrame, Totals]:
    own = train if isinstance(train, Column) else F.lit(False)
    bundles = _bundles(docs.select("doc_id", "text", F.coalesce(own, F.lit(False)).alias("counted")))

    def asking(batches):
        for r in _rows(batches):
            yield _asks(pa.ipc.open_stream(r["payload"]).read_all(), r["bundle"], n_blocks)

    def counting(batches):
        for table in _tied(batches):
            yield _asks(table, None, n_blocks)

    def answering(batches):
        for block, rows in groupby(_rows(batches), key=lambda r: r["block"]):
            held, made, out = [], None, []
            for r in rows:
                if not r["late"]:
                    held.append(r)
                    continue
                made = made or _Block(block, n_blocks, held)
                out.append((r["bundle"], made.answer_late(r)))
                if len(out) == REPLIES:
                    yield told(block, out)
                    out = []
            made = made or _Block(block, n_blocks, held)
            for i, bundle in enumerate(made.bundles):
                if bundle is not None:
                    out.append((bundle, made.answer(i)))
                if len(out) == REPLIES:
                    yield told(block, out)
                    out = []
            yield told(block, out, made.totals)

    def told(block, out, totals=None):
        rows = [{"bundle": name, "block": block, "payload": payload} for name, payload in out]
        return pa.RecordBatch.from_pylist(rows + ([{"block": block, **totals}] if totals else []), schema=_ANSWER)

    def scoring(batches):
        for _, rows in groupby(_rows(batches), key=lambda r: r["bundle"]):
            table = pa.ipc.open_stream(next(rows)["payload"]).read_all()  # a bundle's texts have the block -1
            grams = ngrams(table.column("text").to_pylist())
            (singles, _), (pairs, _) = _asked(grams, np.zeros(table.num_rows, bool))
            s, p = _edges(singles, n_blocks), _edges(pairs, n_blocks)
            level, exact, pair_level = np.zeros(len(singles), np.uint8), np.zeros(len(singles), np.int64), np.zeros(len(pairs), np.uint8)
            left = int(np.count_nonzero(np.diff(s) + np.diff(p)))
            for r in rows:
                b, left = r["block"], left - 1
                n, m = s[b + 1] - s[b], p[b + 1] - p[b]
                raw = pa.decompress(r["payload"], decompressed_size=int(9 * n + m), codec="zstd", asbytes=True)
                level[s[b] : s[b + 1]], pair_level[p[b] : p[b + 1]] = np.frombuffer(raw, np.uint8, n), np.frombuffer(raw, np.uint8, m, n)
                exact[s[b] : s[b + 1]] = _from_planes(raw[n + m :], "<i8")
            if left:
                raise RuntimeError(f"{left} answers of a bundle are missing")

            def known(some, some_pairs, singles=singles, pairs=pairs, exact=exact, level=level, pair_level=pair_level):
                at = np.searchsorted(singles, some)
                return exact[at], level[at].astype(np.int64), pair_level[np.searchsorted(pairs, some_pairs)].astype(np.int64)

            yield score_texts(table.column("doc_id").to_pylist(), grams, known, totals)

    asks = bundles.mapInArrow(asking, _ASK_DDL)
    if not isinstance(train, Column):
        asks = asks.unionByName(train.select("text", F.lit(True).alias("counted")).mapInArrow(counting, _ASK_DDL))
    answers = stored(asks.repartition("block").sortWithinPartitions("block", "late").mapInArrow(answering, _ANSWER_DDL))
    totals = _totals(answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "bigrams", "once"))).first())
    both = bundles.select("bundle", F.lit(-1).alias("block"), "payload").unionByName(answers.where("bundle IS NOT NULL").select("bundle", "block", "payload"))
    return both.repartition("bundle").sortWithinPartitions("bundle", "block").mapInArrow(scoring, _SCORED_DDL), totals


def _totals(sums) -> Totals:
    return Totals(sums["tokens"], sums["types"], 1 - sums["once"] / sums["bigrams"] if sums["bigrams"] else 0.0)


def score_documents(docs: DataFrame, train: DataFrame | Column, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """docs (doc_id, text) scored by a model of train (text): n_tokens, n_known, train_tokens, base_score, score.

    train is a table of its own, or the condition of those docs that are learnt from, which reads each text once less.
    """
    bound_batches(docs.sparkSession)
    learnt = docs.where(train) if isinstance(train, Column) else train
    volume = text_volume(learnt)
    n_blocks, out = max(1, -(-volume // BLOCK_CHARS)), None
    if volume // CHARS_A_BYTE <= limit_bytes:
        blocks = stored(filter_blocks(count_ngrams(learnt, n_blocks)))
        sums = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "bigrams", "once")), F.coalesce(F.sum(F.octet_length("bits") + F.octet_length("keys") * 2), F.lit(0)).alias("size")).first()
        if sums["size"] <= limit_bytes:
            totals = _totals(sums)
            out = _scored_by_broadcast(docs, blocks, n_blocks, totals)
    if out is None:
        out, totals = _scored_by_exchange(docs, train, n_blocks)
    return out.withColumn("train_tokens", F.lit(totals.tokens).cast("long"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_documents(docs, ~held_out(F.col("doc_id"), 10))
    return out.select("doc_id", held_out(F.col("doc_id"), 10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
