"""Quality rules: repetition within a text, by suffix array.

The words of a text get a suffix array (prefix doubling over the suffixes still tied) and the common-prefix lengths of
neighbours in it (halving steps over 64-bit prefix hashes, so that memory stays in proportion to the words). The deepest common-prefix interval that holds a suffix gives the longest repeat that starts there;
spans of repeats of ``MIN_REPEAT`` words or more are united. A text fails if the united spans cover too much of it or
if one repeat is too long. Many texts share one array: words count as different in different texts.

Work is row-local, so no text moves: one scan, no shuffle. Defined cases: null or empty texts have no words and fail
the base rule; a very long text is handled whole; repeated rows are judged each; of repeats that
are equally long all count, as their spans are united; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from redactory.llm.common import Words, chunks, mix, power_tables, read_table

#: Words in a repeat that counts; part of the words that repeats may cover; words that one repeat may have. The part is
#: well below the half of the base rule, which counts repeats of three words and so all words that these repeats cover.
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 10, 0.2, 200
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _classes(keys: np.ndarray) -> np.ndarray:
    """Ranks in the style of prefix doubling: the number of elements with a smaller key."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    return ranks


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring that starts there and also starts elsewhere."""
    n = len(symbols)
    if n < 2:
        return np.zeros(n, np.int64)
    rank = _classes(symbols)
    step = 1
    sizes = np.bincount(rank, minlength=n)
    active = np.flatnonzero(sizes[rank] > 1)
    while len(active):
        after = np.where(active + step < n, rank[np.minimum(active + step, n - 1)], -1)
        order = np.lexsort((after, rank[active]))
        ids, major, minor = active[order], rank[active][order], after[order]
        new_major = np.concatenate([[True], major[1:] != major[:-1]])
        new_group = new_major | np.concatenate([[True], minor[1:] != minor[:-1]])
        place = np.arange(len(ids))
        in_major = place - place[new_major][np.cumsum(new_major) - 1]
        rank[ids] = major + in_major[new_group][np.cumsum(new_group) - 1]
        group = np.cumsum(new_group) - 1
        active = np.sort(ids[np.bincount(group)[group] > 1])
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    power, inverse = power_tables(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(symbols.astype(np.uint64)) * power[:n])])
    common = np.zeros(n - 1, np.int64)
    live = np.arange(n - 1)
    for k in range(int(n).bit_length() - 1, -1, -1):  # the greatest length first
        a, b = suffixes[live] + common[live], suffixes[live + 1] + common[live]
        fits = np.maximum(a, b) + (1 << k) <= n
        a, b, own = a[fits], b[fits], live[fits]
        end = 1 << k
        same = (sums[a + end] - sums[a]) * inverse[a] == (sums[b + end] - sums[b]) * inverse[b]
        common[own[same]] += end
    out = np.zeros(n, np.int64)
    out[suffixes[:-1]] = common
    out[suffixes[1:]] = np.maximum(out[suffixes[1:]], common)
    return out


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _merged_spans(covered: np.ndarray, bounds: np.ndarray) -> list[list[dict]]:
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first, last = np.searchsorted(ends, bounds[:-1], side="right"), np.searchsorted(starts, bounds[1:])
    out: list[list[dict]] = []
    for a, b, i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), first.tolist(), last.tolist()):
        out.append([{"start": max(s, a) - a, "end": min(e, b) - a} for s, e in zip(starts[i:j].tolist(), ends[i:j].tolist())])
    return out


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, "
    "longest_repeat long, repeats array<struct<start:long,end:long>>, base_failed boolean, kept boolean"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")],
     ("repeats", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
)


def measure(ids: list[int], texts: list[str | None], min_repeat: int, max_covered: float, max_repeat: int) -> dict:
    words = Words(texts, lower=False)
    n, owner, bounds = words.counts, words.text_of(), words.bounds
    total = len(words.hashes)
    # the same word in another text is another symbol
    order = np.lexsort((words.hashes, owner))
    h, o = words.hashes[order], owner[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]) if total else np.zeros(0, bool)
    symbols = np.empty(total, np.int64)
    symbols[order] = np.cumsum(first) - 1
    longest = longest_repeats(symbols)

    def cover(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        change = np.bincount(starts, minlength=total + 1) - np.bincount(starts + lengths, minlength=total + 1)
        return np.cumsum(change)[:total] > 0

    at = np.flatnonzero(longest >= min_repeat)
    covered = cover(at, longest[at])
    three = np.flatnonzero(longest >= 3)
    in_three = cover(three, np.full(len(three), 3))
    n_covered = _per_text(covered, bounds)
    most = np.zeros(len(n), np.int64)
    np.maximum.at(most, owner, longest)
    # every text ends with a space of one byte, so no stretch is empty
    in_texts = lambda marks: np.add.reduceat(marks, words.text_starts[:-1], dtype=np.int64) if len(n) else np.zeros(0, np.int64)
    word_chars = in_texts((words.bytes & 0xC0) != 0x80) - in_texts(words.is_space())
    n_symbols = in_texts(_SYMBOL[words.bytes])
    dup = []
    for t in texts:
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        dup.append(len(lines) - len(set(lines)))
    repeat_words = _per_text(in_three, bounds)
    failed = (n < 50) | (100 * repeat_words > 50 * n)
    kept = ~failed & (n_covered <= max_covered * n) & (np.where(most >= min_repeat, most, 0) <= max_repeat)
    return {
        "doc_id": ids, "n_words": n, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": dup, "n_repeat_words": repeat_words,
        "covered_words": n_covered, "longest_repeat": most, "repeats": _merged_spans(covered, bounds), "base_failed": failed, "kept": kept,
    }


def quality_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """docs (doc_id, text) -> one row each with counts, the united spans of repeats (in words) and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, ["doc_id", "text"]):
            yield pa.RecordBatch.from_pydict(measure(c["doc_id"], c["text"], min_repeat, max_covered, max_repeat), schema=_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat")
