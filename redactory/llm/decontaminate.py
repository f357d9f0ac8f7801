"""Benchmark decontamination: CGK embedding, bit sampling over item-sized windows, exact edit verification.

The edit distance is over words, and a window matches an item if it is at most a fifth of the item's words. The CGK
walk reads a window word by word; a random bit for (step, word) says whether it moves on, and each step writes the
word it stands on. Windows at a small edit distance then write mostly the same words at the same steps. A repetition
samples a few steps; windows and items that wrote the same words there are candidates. ``REPETITIONS`` of them reach
the target recall (tested on edited copies), and every candidate is verified by an exact edit distance.

Before the walk, windows that cannot match go: k edits leave all but 2k of an item's word pairs intact (the q-gram
lemma), so a window needs that many pairs of the benchmark. This loses no match.

The benchmark is the stated query set: it is taken in blocks of ``BLOCK_ITEMS`` items or ``BLOCK_CHARS`` characters, each
sent to the workers and run against all documents where they lie; no text is shuffled.

Defined cases: null and empty texts and items match nothing; items under five words must match exactly; very long texts
are searched whole; of equal matches in a text the first counts; rows that repeat a doc_id are searched each, and
rows without one too, with a null doc_id in the result; equal items are all reported; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm.common import Words, batch_of, chunks, fold_hash, mix, read_table

BLOCK_ITEMS, BLOCK_CHARS = 20_000, 4 << 20
REPETITIONS, SAMPLED = 24, 2
#: Edits allowed, as a share of the item's words.
EDITS = 5  # one in five


def window_sizes(longest: int) -> list[int]:
    """Sizes of windows, each about a fifth larger than the one before."""
    out = [1]
    while out[-1] < longest:
        out.append(max(out[-1] + 1, out[-1] * 6 // 5))
    return out


def cgk_samples(tokens: np.ndarray, starts: np.ndarray, size: int, repetitions: int) -> np.ndarray:
    """For each repetition (row) a hash of the sampled steps of each window's walk. Steps past its end write nothing."""
    steps = 2 * size
    picked = np.zeros((repetitions, steps), bool)
    for r in range(repetitions):
        picked[r, np.random.default_rng([size, r]).choice(steps, min(SAMPLED, steps), replace=False)] = True
    row = np.arange(repetitions, dtype=np.uint64)[:, None]
    place = np.zeros((repetitions, len(starts)), np.int64)
    out = np.repeat(mix(row * np.uint64(1000) + np.uint64(size)), len(starts), axis=1)
    padded = np.concatenate([tokens, np.zeros(size + 1, np.uint64)])
    for j in range(int(np.flatnonzero(picked.any(axis=0))[-1]) + 1):
        word = padded[starts + place]
        word[place >= size] = 0
        writes = picked[:, j]
        if writes.any():
            out[writes] = fold_hash([out[writes], word[writes]])
        # a random bit for each (repetition, step, word) by multiplication: its top bit
        key = (row * np.uint64(100_003) + np.uint64(j)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        place += (((word ^ (word >> np.uint64(31))) * key) >> np.uint64(63)).astype(np.int64)
        np.minimum(place, size, out=place)
    return out


def bit_masks(pattern: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def best_match(pattern: list[int], text: list[int], masks: dict[int, int] | None = None) -> tuple[int, int]:
    """(distance, end) of the substring of text nearest to pattern, the earliest end; bit-parallel over the pattern."""
    m, masks = len(pattern), masks or bit_masks(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = (m, 0)
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        hp, hn = down | (~(d0 | up) & full), up & d0
        score += bool(hp & high) - bool(hn & high)
        if score < best[0]:
            best = (score, j + 1)
        hp, hn = hp << 1 & full, hn << 1 & full
        up, down = hn | (~(d0 | hp) & full), hp & d0
    return best


def _in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _echoes(pairs: np.ndarray) -> np.ndarray:
    """Which pairs repeat the one before them, as in a run of one word."""
    return np.concatenate([np.zeros(min(1, len(pairs)), bool), pairs[1:] == pairs[:-1]])


class Index:
    """A block of items: their word pairs, their sampled walks, and their words for verification."""

    def __init__(self, items: list[tuple[int, str]]):
        words = Words([t for _, t in items])
        self.ids, self.items = [], []
        for (i, _), a, b in zip(items, words.bounds[:-1], words.bounds[1:]):
            if b > a:
                self.ids.append(i)
                self.items.append(words.hashes[a:b])
        lengths = np.array([len(x) for x in self.items], np.int64)
        self.known = [(x.tolist(), set(x.tolist()), bit_masks(x.tolist())) for x in self.items]
        self.single = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.items]))
        pairs = [fold_hash([x[:-1], x[1:]]) for x in self.items]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.uint64), *pairs]))
        echoes = np.array([_echoes(p).sum() for p in pairs], np.int64)
        sizes = np.array(window_sizes(int(lengths.max(initial=1))))
        size_of = sizes[np.searchsorted(sizes, lengths, side="right") - 1]
        self.classes: list[tuple[int, int, int, tuple[np.ndarray, np.ndarray]]] = []
        flat = np.concatenate([np.zeros(0, np.uint64), *self.items])
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        for size in np.unique(size_of):
            own = np.flatnonzero(size_of == size)
            most = int(lengths[own].max()) // EDITS
            # an item is known by its first and its last window
            ends = np.concatenate([first[own], first[own] + lengths[own] - size])
            value = np.stack([np.concatenate([own, own]), ends - first[np.concatenate([own, own])]], axis=1)
            keys = cgk_samples(flat, ends, int(size), REPETITIONS).reshape(-1)
            order = np.argsort(keys, kind="stable")
            tables = (keys[order], np.tile(value, (REPETITIONS, 1))[order])
            self.classes.append((int(size), most, int(size) - 1 - 2 * most - int(echoes[own].max()), tables))

    def candidates(self, tokens: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
        """(item, start) pairs in which the item may start near that token; an item cut at its head starts with its text."""
        found: set[tuple[int, int]] = set()
        if not len(tokens) or not self.items:
            return found
        owner_start, owner_end = np.repeat(bounds[:-1], np.diff(bounds)), np.repeat(bounds[1:], np.diff(bounds))
        pairs = fold_hash([tokens[:-1], tokens[1:]])
        in_pairs = _in(pairs, self.pairs) & ~_echoes(pairs)  # a run of one word is no evidence
        in_pairs[bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(tokens))] - 1] = False  # not across texts
        pair_sum = np.concatenate([[0], np.cumsum(in_pairs)])
        place = np.arange(len(tokens))
        for size, most, needed, tables in self.classes:
            reach = np.minimum(place + size + most, owner_end)
            enough = pair_sum[np.maximum(reach - 1, place)] - pair_sum[place] >= max(needed, 0)
            starts = np.flatnonzero(enough & (reach - place >= size - most) & (_in(tokens, self.single) if needed <= 0 else True))
            if not len(starts):
                continue
            keys, values = tables
            h = cgk_samples(tokens, starts, size, REPETITIONS)
            low, high = np.searchsorted(keys, h), np.searchsorted(keys, h, side="right")
            row, at = np.nonzero(high > low)
            n = (high - low)[row, at]
            pick = np.repeat(low[row, at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            seen = np.repeat(starts[at], n)
            near = np.stack([values[pick, 0], np.maximum(seen - values[pick, 1], owner_start[seen])], axis=1)
            found.update(map(tuple, np.unique(near, axis=0).tolist()))
        return found

    def matches(self, tokens: np.ndarray, bounds: np.ndarray):
        """(text, item id, start, words, distance) of the best match of each item in each text."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        words, done = tokens.tolist(), (-1, 0)
        for item, start in sorted(self.candidates(tokens, bounds)):
            if (item, start) <= done:
                continue  # inside a match that was found
            pattern, distinct, masks = self.known[item]
            text = max(int(np.searchsorted(bounds, start, side="right")) - 1, 0)
            k, first, last = len(pattern) // EDITS, int(bounds[text]), int(bounds[text + 1])
            mark = None
            for _ in range(3):  # again around where the match is, as the start was a guess
                a = max(start - 2 * k, first)
                window = words[a : min(start + len(pattern) + 2 * k, last)]
                if len(distinct.difference(window)) > k:
                    break  # that many words cannot have been edited
                distance, end = best_match(pattern, window, masks)
                if distance > k:
                    break
                _, length = best_match(pattern[::-1], window[:end][::-1])
                found = (distance, a + end - length, length)
                if mark and found >= mark:
                    break
                mark, start = found, found[1]
            if mark:
                done = (item, min(mark[1] + k, last - 1))
                mark = (mark[0], mark[1] - first, mark[2])
                best[text, item] = min(best.get((text, item), mark), mark)
        return [(t, self.ids[i], s, n, d, len(self.items[i])) for (t, i), (d, s, n) in sorted(best.items())]


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int64()), ("item_words", pa.int64())])
_FOUND_DDL = "doc_id long, item_id long, start_word long, n_words long, distance long, item_words long"


def contaminated(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, distance, item_words): the nearest match of each item in each document."""
    context = docs.sparkSession.sparkContext

    def search(block: list[tuple[int, str]]) -> DataFrame:
        sent = context.broadcast(Index(block))

        def run(batches):
            for c in chunks(batches, ["doc_id", "text"]):
                words = Words(c["text"])
                rows = sent.value.matches(words.hashes, words.bounds)
                yield batch_of(_FOUND, doc_id=[c["doc_id"][r[0]] for r in rows], **{f.name: [r[i + 1] for r in rows] for i, f in enumerate(list(_FOUND)[1:])})

        return docs.select("doc_id", "text").mapInArrow(run, _FOUND_DDL)

    out, block, chars = None, [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append((row["item_id"], row["text"] or ""))
        chars += len(block[-1][1])
        if len(block) == block_items or chars >= BLOCK_CHARS:
            out, block, chars = search(block) if out is None else out.unionByName(search(block)), [], 0
    if block or out is None:
        out = search(block) if out is None else out.unionByName(search(block))
    return out


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).withColumn("similarity", F.round(1 - F.col("distance") / F.col("item_words"), 6))
