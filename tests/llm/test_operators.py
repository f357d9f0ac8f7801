"""Operators against brute force on small tables, and on odd ones."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from redactory.llm import chat, decontaminate, line_dedup, lm_score, near_dedup, packing, repetition, substring_dedup, toxicity, url_filter
from redactory.llm.common import Words, connected_components, held_out

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(UPPER) if lower else text)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.2 else f"W{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Documents with exact and near copies, shared lines and short texts."""
    rng = random.Random(5)
    line = "This line of forty characters or more is in many documents."
    docs = [prose(rng, rng.randrange(1, 300)) for _ in range(60)]
    docs += [docs[0], docs[1], docs[1], "", None, "a b", "A  B", "one two three four"]
    for k in range(25):
        w = docs[2 + k % 3].split() + prose(rng, 80).split()
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = "changed"
        docs.append(" ".join(w))
        docs.append(" ".join(docs[-1].split()[:-1]))
    docs += [f"{prose(rng, 20)}\n{line}\n  {line.upper()} \n{prose(rng, 5)}" for _ in range(7)]
    return list(enumerate(docs))


def test_long_texts_in_blocks(monkeypatch):
    """Hashes do not depend on where the blocks end, with words longer than a block too."""
    from redactory.llm import common

    rng = random.Random(20)
    texts = [prose(rng, 3000), "x" * 900 + " y", None, "é" * 400, " " * 300, prose(rng, 50)]
    whole = Words(texts)
    monkeypatch.setattr(common, "BLOCK_BYTES", 256)
    monkeypatch.setattr(common, "_powers", [])
    cut = Words(texts)
    for name in ("hashes", "starts", "ends", "bounds"):
        assert (getattr(whole, name) == getattr(cut, name)).all()
    assert (whole.hashed([3, None], check=True)[0] == cut.hashed([3, None], check=True)[0]).all()


def test_memory_of_long_texts():
    """Tens of MB in one text, with a repeat: arrays stay within some tens of bytes a word."""
    import tracemalloc

    rng = np.random.default_rng(21)
    part = " ".join(f"w{k:x}" for k in rng.integers(0, 1 << 40, 1_000_000))
    text = part + " " + part[: len(part) // 2]
    tracemalloc.start()
    got = repetition.measure([1], [text], 10, 0.2, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["longest_repeat"][0] >= 480_000 and not got["kept"][0] and peak < 25 * len(text)


def test_words_are_those_of_the_pattern():
    texts = ["A b\x0bC\x85d  é x\n", None, "", " \t", "Zoë ZOË"]
    w = Words(texts)
    assert list(w.counts) == [len(words(t)) for t in texts]
    flat = [x for t in texts for x in words(t)]
    assert len(set(zip(flat, w.hashes.tolist()))) == len(set(flat)) == len(set(w.hashes.tolist()))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(400, 440)] + [(500, k) for k in range(501, 600)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_lm_counts_are_exact_and_both_ways_agree(spark, make, corpus, odd, empty):
    docs = make(corpus)
    train = docs.where(~held_out(F.col("doc_id"), 10))
    counts = collections.Counter()
    for i, t in corpus:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    rows = {r.doc_id: r for r in lm_score.score_documents(docs, train).collect()}
    other = {r.doc_id: r for r in lm_score.score_documents(docs, train, limit_bytes=0).collect()}
    for i, t in corpus:
        toks = [*words(t), None]
        assert rows[i].n_tokens == len(toks) and rows[i].n_known == sum(counts[x] > 0 for x in toks) and rows[i].train_tokens == n
        assert math.isclose(rows[i].base_score, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in toks), rel_tol=1e-9)
        assert rows[i].score < 0 and math.isclose(rows[i].score, other[i].score, rel_tol=1e-12)
    # the score by the exact counts, quantised: the filter overstates one level in some dozens
    middle = lambda c: float(lm_score.MIDDLE[np.searchsorted(lm_score.LEVELS, c, side="right")])
    pairs, firsts = collections.Counter(), collections.Counter()
    for i, t in corpus:
        if zlib.crc32(str(i).encode()) % 10:
            toks = ["<start>", *words(t), None]
            pairs.update(zip(toks, toks[1:]))
            firsts["<start>"] += 1
    weight = 1 - sum(c == 1 for c in pairs.values()) / sum(pairs.values())
    context = lambda x: middle(firsts[x] if x == "<start>" else counts[x])
    same, off = 0, []
    for i, t in corpus:
        toks, score = ["<start>", *words(t), None], 0.0
        for a, b in zip(toks, toks[1:]):
            uni = (middle(counts[b]) + 0.1) / (n + 0.1 * (v + 1))
            p = weight * min(middle(pairs[a, b]), context(a)) / context(a) + (1 - weight) * uni if context(a) else uni
            score += math.log10(min(p, 1.0))
        same += math.isclose(rows[i].score, score, rel_tol=1e-9)
        off.append(abs(rows[i].score - score) / len(toks))
    assert same >= 10 and np.mean(off) < 0.02 and max(x * y for x, y in zip(off, [min(len(words(t)), 40) for _, t in corpus])) < 4
    assert lm_score.score_documents(odd, odd).count() == odd.count() and lm_score.score_documents(empty, empty).count() == 0
    assert all(r.score <= 0 for r in lm_score.score_documents(odd, empty).collect())


def test_lm_exchange_gathers_no_group_and_learns_by_condition(spark, make, corpus, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_CHARS", 9_000)
    docs, learnt = make(corpus), ~held_out(F.col("doc_id"), 10)
    sent = {r.doc_id: r for r in lm_score.score_documents(docs, learnt).collect()}
    plans = []
    monkeypatch.setattr(lm_score, "stored", lambda df, f=lm_score.stored: (plans.append(df), f(df))[1])
    exchanged = lm_score.score_documents(docs, learnt, limit_bytes=0)
    for df in [*plans, exchanged]:
        plan = df._jdf.queryExecution().toString()
        assert "collect_list" not in plan and "Join" not in plan
    rows = exchanged.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == sent[r.doc_id][1:3] + (sent[r.doc_id].train_tokens,)
        assert math.isclose(r.score, sent[r.doc_id].score, rel_tol=1e-12) and math.isclose(r.base_score, sent[r.doc_id].base_score, rel_tol=1e-12)


def test_lm_bundles_are_cut_by_size_and_keep_all_rows(monkeypatch):
    monkeypatch.setattr(lm_score, "BUNDLE_CHARS", 1000)
    texts = [None, "", *("x" * n for n in (10, 5000, 3, 900, 900, 1, 968, 968))]
    batches = [pa.RecordBatch.from_pydict({"doc_id": range(i, i + 3), "text": texts[i : i + 3], "counted": [True] * 3}) for i in (0, 3, 6)]
    tables = list(lm_score._tied(iter(batches)))
    assert [t.column("doc_id").to_pylist() for t in tables] == [[0, 1, 2, 3], [4, 5, 6], [7, 8]] and [x for t in tables for x in t.column("text").to_pylist()] == texts[:9]


def test_filter_never_misses_and_seldom_overstates(spark):
    rng = np.random.default_rng(2)
    keys, counts = np.unique(rng.integers(0, 2**63, 20_000, dtype=np.uint64)), None
    counts = rng.zipf(1.6, len(keys)).clip(1, 10**6)
    level = np.searchsorted(lm_score.LEVELS, counts, side="right")
    bits = np.zeros(1 + int(level.sum()) * lm_score.BITS_PER_EVENT // 64, np.uint64)
    for j in range(1, level.max() + 1):
        np.bitwise_or.at(bits, *lm_score._events(keys[level >= j], j, len(bits)))
    f = lm_score.Filter(1, [(0, 8 * len(bits), 0)], 0)
    f.add(0, bits.tobytes(), b"", b"")
    got = f.levels(keys)
    assert (got >= level).all() and (got > level).mean() < 0.05
    assert (f.levels(rng.integers(0, 2**63, 20_000, dtype=np.uint64)) > 0).mean() < 0.05


def test_url_verdicts(spark):
    url = "https://shop.example.org/es/1"
    rows = [
        (1, "http://A.example.net/x", f'<link rel="canonical" href="{url}">'), (2, url, ""), (3, "http://b.example.net/y?q=1#f", None),
        (4, "http://c.example.net/z", '<meta http-equiv="refresh" content="0; url=/w">'), (5, "http://c.example.net/w", f"<link href='{url}' rel='canonical'>"),
        (6, None, None), (7, "no scheme", "<p>"), (8, "http://x.org/a", f'<link rel="canonical" href="{url}">'), (9, "http://y.org", ""), (9, "http://y.org", ""),
        (10, "http://k.com/fr/a/", "<link rel=canonical href=../b>"), (11, "http://k.com/de/q", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, url_filter.RULES, url_filter.link_edges(pages)).collect()}
    verdicts = {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "block"}
    assert {k: r.verdict for k, r in got.items()} == verdicts
    assert got[1].host == "a.example.net" and got[1].rule is None and got[2].rule == "example.org/es/" and got[8].rule == "org/" and got[9].rule is None
    assert (got[6].host, got[6].path, got[3].path) == ("", "", "/y")
    assert url_filter.judge_urls(pages.limit(0), url_filter.RULES, url_filter.link_edges(pages.limit(0))).count() == 0


def test_odd_pages(spark):
    """Nulls everywhere, repeated rows, and columns named as the results are."""
    link = '<link rel="canonical" href="http://b.org/y">'
    rows = [(None, None, None, "x", "x"), (1, "http://a.net/x", link, "x", "x"), (1, "http://a.net/x", link, "x", "x"), (None, "http://a.net/x", None, None, None), (2, "", "", "x", "x"), (3, "://", link, "x", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string, host string")
    got = url_filter.judge_urls(pages, url_filter.RULES, url_filter.link_edges(pages)).select("page_id", "host", "verdict").collect()
    assert sorted((r.page_id or 0, r.host, r.verdict) for r in got) == [(0, "", "allow"), (0, "a.net", "allow"), (1, "a.net", "allow"), (1, "a.net", "allow"), (2, "", "allow"), (3, "", "allow")]


def near_brute(docs, width, percent):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_are_those_of_brute_force(make, corpus, odd, empty, width):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(make(corpus), width).collect()}
    assert got == near_brute(corpus, width, 80)
    rows = near_dedup.near_duplicates(odd, width).collect()
    assert len(rows) == odd.count() and all(r.kept for r in rows)
    assert near_dedup.near_duplicates(empty, width).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    owner = np.repeat([0, 1], 1000)
    sig = near_dedup.super_minhash(owner, np.concatenate([a, b]), 2, 96)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.2
    small = near_dedup.super_minhash(np.zeros(3, int), a[:3], 1, 96)
    assert (small < np.uint64(96 << 56)).all()


def test_large_groups_lose_no_link(spark):
    """Sets of one group, far over the size of a block: near copies of one base, chains of small steps, and strangers."""
    rng = random.Random(16)
    sets = {}
    for k in range(60):  # copies of one base
        sets[k] = {x for x in range(100) if rng.random() > 0.03} | {1000 + k}
    for k in range(60, 90):  # a chain: neighbours are similar, the ends are not
        sets[k] = set(range(5000 + 4 * k, 5000 + 4 * k + 60))
    for k in range(90, 120):
        sets[k] = {rng.randrange(10**6) for _ in range(50)}
    rows = spark.createDataFrame([(1, k, len(x), sorted(x)) for k, x in sets.items()] + [(2, 500, 2, [1, 2]), (2, 501, 2, [1, 2]), (3, 600, 1, [7])], "g long, rep long, w int, shingles array<long>")
    edges = near_dedup.linked(rows, "g", "shingles", lambda x: near_dedup.similar([np.asarray(v.values) for v in x], 80), 400, 800)
    got = {r[0]: r[1] for r in connected_components(edges).collect()}
    root = {k: k for k in sets}
    for _ in sets:
        for x in sets:
            for y in sets:
                if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                    root[x] = root[y] = min(root[x], root[y])
    assert {k: got.get(k, k) for k in sets} == root and len({root[k] for k in range(60, 90)}) == 1 and got[501] == got[500] == 500 and 600 not in got


def test_quality_rules(make, corpus, odd, empty):
    rng = random.Random(3)
    texts = [*corpus, (900, prose(rng, 60, 5)), (901, "x y " * 40), (902, "#a *b* <c>\n#a *b* <c>\n\n \n" * 9)]
    for r in repetition.quality_rules(make(texts)).collect():
        t = dict(texts)[r.doc_id] or ""
        w = words(t, False)
        triples = collections.Counter(zip(w, w[1:], w[2:]))
        hit = [any(triples[tuple(w[k : k + 3])] > 1 for k in range(max(0, i - 2), min(i, len(w) - 3) + 1)) for i in range(len(w))]
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_repeat_words, r.n_dup_lines) == (sum(hit), len(lines) - len(set(lines)))
        suffixes = sorted(range(len(w)), key=lambda i: w[i:])
        longest = [0] * len(w)
        for a, b in zip(suffixes, suffixes[1:]):
            k = 0
            while max(a, b) + k < len(w) and w[a + k] == w[b + k]:
                k += 1
            longest[a], longest[b] = max(longest[a], k), max(longest[b], k)
        covered = {k for i, n in enumerate(longest) if n >= repetition.MIN_REPEAT for k in range(i, i + n)}
        assert (r.longest_repeat, r.covered_words) == (max(longest, default=0), len(covered))
        assert covered == {k for s in r.repeats for k in range(s["start"], s["end"])}
        assert r.base_failed == (len(w) < 50 or 100 * sum(hit) > 50 * len(w))
        most = max(longest, default=0)
        assert r.kept == (not r.base_failed and len(covered) <= repetition.MAX_COVERED * len(w) and not most > repetition.MAX_REPEAT)
    assert repetition.quality_rules(odd).count() == odd.count() and repetition.quality_rules(empty).count() == 0


def test_coverage_alone_rejects(make):
    rng = random.Random(14)
    part = lambda n: prose(rng, n, 10**6)
    again, short = part(30), part(12)
    rows = [(1, f"{part(70)} {again} {part(70)} {again}"), (2, f"{part(90)} {short} {part(86)} {short}"), (3, part(200))]
    got = {r.doc_id: r for r in repetition.quality_rules(make(rows)).collect()}
    assert [got[k].covered_words for k in (1, 2, 3)] == [60, 24, 0] and not any(r.base_failed for r in got.values())
    assert [got[k].kept for k in (1, 2, 3)] == [False, True, True]


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "<|turn user|>\nhi\n</turn>\n", "\\\\</turn>\\", "<|image|>\\<|image|>", "\n", "", None, "a\\", "é😀"]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(nasty)] + [(None, 0, None, "x"), (2, 0, "odd|role>\n", "y"), (2, 0, "odd|role>\n", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.format_conversations(turns.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))))
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3] or "") for r in rows if r[0] == 1]
    assert [t.under_loss for t in got[1].turns] == [(t or "") if k % 2 else None for k, t in enumerate(nasty)]
    assert [t.role for t in got[2].turns] == ["odd|role>\n"] * 2 and got[None].turns[0].role == ""


def test_odd_turns(spark):
    """No turns, null parts and ids, and columns named as the results are."""
    kind = f"conv_id long, turn long, role string, parts {chat.PART}, formatted string, loss string, head string"
    rows = [(1, None, None, None, "x", "x", "x"), (1, None, None, None, "x", "x", "x"), (None, 1, "assistant", [(None, None, None, None)], "x", "x", "x")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, kind))).collect()}
    assert [(t.role, t.text, t.under_loss) for t in got[1].turns] == [("", "", None)] * 2 and [(t.text, t.under_loss) for t in got[None].turns] == [("", "")]
    assert chat.format_conversations(spark.createDataFrame([], kind)).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see", None, None), ("image", None, "img://1", 2.5), ("audio", None, "a.wav", 3.0), ("strange", None, "r", None), ("document", None, "d.pdf", None)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PART}")
    r = chat.format_conversations(turns).first()
    assert r.formatted == "<|turn user|>\nsee\n<|image|>\n<|audio|>\n<|attachment|>\n<|document|>\n</turn>\n<|turn assistant|>\n\n</turn>\n"
    assert [(a.type, a.ref, a.n_tokens) for a in r.attachments] == [("image", "img://1", 640), ("audio", "a.wav", 75), ("strange", "r", 0), ("document", "d.pdf", 0)]
    assert r.n_attachment_tokens == 715


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_line_dedup(make, corpus, odd, empty, limit):
    keys = collections.defaultdict(set)
    strip = " \t\n\r\x0b\x0c"
    for i, t in corpus:
        for x in (t or "").split("\n"):
            k = x.strip(strip).translate(UPPER)
            if len(k) >= 40:
                keys[k].add(i)
    for r in line_dedup.drop_lines(make(corpus), limit_bytes=limit).collect():
        lines = (dict(corpus)[r.doc_id] or "").split("\n")
        kept = [x for x in lines if not (len(keys[x.strip(strip).translate(UPPER)]) >= 5 and r.doc_id != max(keys[x.strip(strip).translate(UPPER)]))]
        assert (r.text or "") == "\n".join(kept) and (r[-2], r[-1]) == (len(lines), len(lines) - len(kept))
    assert line_dedup.drop_lines(odd).count() == odd.count() and line_dedup.drop_lines(empty).count() == 0


def test_both_ways_to_suspects_use_the_filters(make):
    rng = random.Random(15)
    line = lambda k: f"line number {k} " + "x" * 40
    once, many = iter(range(10**6, 2 * 10**6)), range(30)
    docs = [(i, "\n".join([line(next(once)) for _ in range(40)] + [line(k) for k in many if rng.random() < 0.3])) for i in range(60)]
    seen = collections.Counter(x for _, t in docs for x in t.split("\n"))
    keys = line_dedup.key_table(make(docs), 40)
    n = sum(seen.values())
    for limit, block in ((1 << 26, 1), (0, 10**6), (0, 200)):
        got = {(r.hi, r.lo) for r in line_dedup.suspects(keys, n, limit, block).collect()}
        repeated = {line_dedup.digest(x.encode()) for x, c in seen.items() if c > 1}
        assert repeated <= got and len(got - repeated) <= 0.05 * len(seen)


def test_maximal_segments_are_those_of_the_definition():
    rng = random.Random(4)

    def brute(s, offset=0):
        best = max(((sum(s[a:b]), -(b - a), -a) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0, 0, 0))
        if best[0] <= 1e-9:
            return []
        a = -best[2]
        b = a - best[1]
        return [*brute(s[:a], offset), (a + offset, b - 1 + offset), *brute(s[b:], offset + b)]

    for _ in range(200):
        s = [rng.choice([-3, -2.5, -1.1, 1, 2.3, 4.7]) * (1 + rng.random() / 100) for _ in range(rng.randrange(1, 16))]
        up = [i for i, x in enumerate(s) if x > 0]
        got = toxicity.maximal_segments(up, [s[i] for i in up], [sum(s[:i]) for i in up])
        assert [(a, b) for a, b, _ in got] == brute(s)


def test_toxicity_learns(spark, make, odd, empty):
    rng = random.Random(6)
    rows = []
    for i in range(800):
        w = prose(rng, 60).split()
        if i % 5 == 0:
            for k in range(20, 26):
                w[k] = rng.choice(["vilething", "vileword", "nastiness"])
        rows.append((i, " ".join(w)))
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(800)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(make(rows), labels)
    got = toxicity.score_toxicity(make(rows), model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert any(s.start <= 20 and s.end >= 26 for r in held if r.doc_id % 5 == 0 for s in r.toxic_spans)
    assert toxicity.score_toxicity(odd, model).count() == odd.count() and toxicity.score_toxicity(empty, model).count() == 0
    none = toxicity.fit_toxicity(make(rows), labels.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score_toxicity(odd, none).collect()} == {0}


def test_toxicity_score_by_hand(spark, make):
    rng = random.Random(18)
    rows = [(i, prose(rng, 30, 90) + (" vile vilest nasty" if i % 4 == 0 else "") + prose(rng, 5, 90)) for i in range(200)]
    model = toxicity.fit_toxicity(make(rows), spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int"))
    bad, every = collections.Counter(), collections.Counter()
    forms = lambda w: [*((n, w.encode()[:n]) for n in toxicity.PREFIX_BYTES), (None, w.encode())]
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5:
            for w in words(t):
                every.update(forms(w))
                bad.update(forms(w) if i % 4 == 0 else [])
    for r in toxicity.score_toxicity(make(rows), model).collect():
        values = []
        for w in words(dict(rows)[r.doc_id]):
            share = model.base
            for f in forms(w):
                share = (bad[f] + toxicity.PRIOR * share) / (every[f] + toxicity.PRIOR)
            values.append(math.log(share / (1 - share)) - math.log(model.base / (1 - model.base)) - toxicity.DRIFT)
        best, sums = [], [0.0]
        for x in values:
            sums.append(sums[-1] + x)
        left, scores = values[:], []
        while True:  # all maximal segments, the greatest first
            top = max(((sum(left[a:b]), a, b) for a in range(len(left)) for b in range(a + 1, min(a + 12, len(left)) + 1)), default=(0, 0, 0))
            if top[0] <= 1e-9:
                break
            scores.append(top[0])
            left[top[1] : top[2]] = [-1e9] * (top[2] - top[1])
        shift = math.log(max(len(values), 1)) + model.log_k
        z = [model.lam * x - shift for x in scores]
        best, n = max([*z, -shift]), sum(x > -math.log(toxicity.MAX_E) for x in z)
        line = model.weights[0] + model.weights[1] * min(max(best, -20), 60) / 10 + model.weights[2] * math.log1p(n)
        assert abs(r.score - 1 / (1 + math.exp(-line))) < 1e-3


def test_toxicity_counts_all_training_rows(spark, make):
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    rows = [(i, f"plain words w{i % 7} " + ("vileword" if i % 3 == 0 else "fine") + (f" onlyfold{fold(i)}" if i % 3 == 0 else "")) for i in range(300)]
    model = toxicity.fit_toxicity(make(rows), spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int"))
    for k in range(5):
        at = toxicity.token_buckets(Words([f"onlyfold{k}"]))[-1]
        n = sum(fold(i) == k for i in range(0, 300, 3)) if k else 0
        assert model.toxic[at] == n and model.all[at] == n
    train = [(i, len(words(t))) for i, t in rows if fold(i)]
    assert math.isclose(model.base, sum(n for i, n in train if i % 3 == 0) / sum(n for _, n in train))


def test_repeated_passages(make, odd, empty):
    rng = random.Random(8)
    passage = ". ".join(prose(rng, 12) for _ in range(5)) + "."
    rows = [(1, prose(rng, 50) + ".\n" + passage + "\n" + prose(rng, 9)), (2, passage), (3, prose(rng, 20) + ". " + passage), (4, prose(rng, 40)), (5, "Short stock line.\nmore"), (6, "Short stock line.\nother")]
    spans = substring_dedup.repeated_spans(make(rows)).collect()
    assert {r.doc_id for r in spans} == {2, 3} and all(r.first_docs == [1] for r in spans)
    out = {r.doc_id: r.text for r in substring_dedup.remove_repeats(make(rows)).collect()}
    assert out[1] == rows[0][1] and out[2].strip() == "" and passage not in out[3] and out[4] == rows[3][1]
    for r in spans:
        assert words(dict(rows)[r.doc_id][r.start : r.end]) == words(passage)
    assert substring_dedup.remove_repeats(odd).count() == odd.count() and substring_dedup.repeated_spans(empty).count() == 0


def test_passages_inside_sentences(make):
    rng = random.Random(13)
    vocabulary = 10**6
    ends = lambda n, m: f"{prose(rng, n, vocabulary)}. {prose(rng, 9, vocabulary)}. {prose(rng, m, vocabulary)}"
    passages = [prose(rng, 51, vocabulary), prose(rng, 90, vocabulary), ends(21, 21), ends(20, 60), "a\x85".join(prose(rng, 20, vocabulary) for _ in range(4))]
    rows, k = [], 0
    for p in passages:
        for q in (p, p.upper().replace("É", "é"), p):
            rows.append((k, f"{prose(rng, k + 3, vocabulary)} {q} {prose(rng, k + 5, vocabulary)}."))
            k += 1
    rows.append((k, "é " + " ".join(["loop"] * 200)))
    gone = collections.defaultdict(set)
    for r in substring_dedup.repeated_spans(make(rows)).collect():
        text = dict(rows)[r.doc_id]
        before = len(text[: r.start].split())
        gone[r.doc_id] |= set(range(before, before + r.words))
        assert r.words >= substring_dedup.MIN_WORDS and len(text[r.start : r.end].split()) == r.words
    for i, (p, q) in enumerate((p, q) for p in passages for q in range(3)):
        n, start = len(p.split()), i + 3
        assert gone[i] <= set(range(start, start + n)) and (q > 0 or not gone[i])
        assert q == 0 or all(len(gone[i] & set(range(a, a + 51))) >= 30 for a in range(start, start + n - 50))
    kept = substring_dedup.remove_repeats(make(rows)).where(f"doc_id = {k}").first().text.split()
    assert 31 <= len(kept) <= 61


def test_what_goes_was_there_before(make):
    rng = random.Random(19)
    base = [prose(rng, 60, 10**6) for _ in range(6)]
    rows = [(k, ". ".join(rng.choice(base) if rng.random() < 0.6 else prose(rng, rng.randrange(5, 40), 10**6) for _ in range(5)) + ".") for k in range(40)]
    rows.append((40, f"{base[0]} {base[0]}. {prose(rng, 9, 10**6)}."))
    fours = lambda w: {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
    spans = collections.defaultdict(list)
    for r in substring_dedup.repeated_spans(make(rows)).collect():
        spans[r.doc_id].append((r.start, r.end))
    seen, removed = set(), 0
    for k, t in rows:
        for a, z in sorted(spans[k]):
            w, before = words(t[a:z]), fours(words(t[:a]))
            removed += len(w)
            for i in range(len(w)):
                assert any(tuple(w[j : j + 4]) in seen | before for j in range(max(0, i - 3), min(i, len(w) - 4) + 1)), (k, w[i])
        seen |= fours(words(t))
    assert removed > 3000


def test_units_of_short_sentences(make):
    units = substring_dedup.units_of("A b. C d. Enough words are here. No. \nX.\n\n one two three four five")
    assert [(n, u) for _, _, n, u in units] == [(4, "a b. c d."), (4, "enough words are here."), (1, "no."), (1, "x."), (5, "one two three four five")]
    text = "loop one two three four. " * 20
    spans = substring_dedup.repeated_spans(make([(7, text)])).collect()
    assert spans and all(r.first_docs == [7] for r in spans) and "loop" in text[: spans[0].start]


def edit_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        row, last = [i] + [0] * len(t), row
        for j, y in enumerate(t, 1):
            row[j] = min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1)
    return min(row)


def test_exact_verification():
    rng = random.Random(9)
    for _ in range(200):
        p, t = ([rng.randrange(4) for _ in range(rng.randrange(1, n))] for n in (12, 30))
        assert decontaminate.best_match(p, t)[0] == edit_distance(p, t)


def test_decontamination_of_all_edits(spark, make):
    """Items of 5 to 120 words with substituted, dropped and added words, up to one in five, in prose of common words."""
    rng = random.Random(17)
    word = lambda: f"c{int(rng.paretovariate(0.7)) % 3000}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(5, 121)))) for k in range(60)]
    rows, expected = [], set()
    for i in range(360):
        w = words(items[i % 60][1])
        for _ in range(len(w) // (5 if i % 2 else 10)):
            at, kind = rng.randrange(len(w)), i // 60 % 3 if i < 180 else rng.randrange(3)
            if kind == 0:
                w[at] = "new"
            elif kind == 1 and len(w) > 3:
                del w[at]
            else:
                w.insert(at, "more")
        rows.append((i, " ".join([*(word() for _ in range(rng.randrange(40))), *w, *(word() for _ in range(rng.randrange(40)))])))
        expected.add((i, i % 60))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(make(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(expected & got) >= 0.98 * len(expected)
    for i, k in got - expected:  # short items of common words
        assert edit_distance(words(items[k][1]), words(rows[i][1])) <= len(words(items[k][1])) // 5


def test_an_item_cut_at_its_head(spark, make):
    item = " ".join(f"h{k}" for k in range(20))
    rows = [(1, "before it"), (2, " ".join(item.split()[3:]) + " after it"), (3, item)]
    got = decontaminate.contaminated(make(rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id: r.distance for r in got} == {2: 3, 3: 0}


def test_decontamination(spark, make, odd, empty):
    rng = random.Random(10)
    items = [(k, " ".join(f"b{rng.randrange(900)}" for _ in range(rng.randrange(6, 60)))) for k in range(40)] + [(98, None), (99, "")]
    rows, expected = [], set()
    for i in range(160):
        k = i % 40
        w = words(items[k][1])
        for _ in range(len(w) // 5 if i >= 80 else 0):
            w[rng.randrange(len(w))] = "zzz"
        rows.append((i, prose(rng, 30) + " " + " ".join(w) + " " + prose(rng, 30)))
        expected.add((i, k))
    rows += [(i, prose(rng, 100)) for i in range(200, 230)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 7):
        got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(make(rows), bench, block).collect()}
        assert got.keys() <= expected and len(got) >= 0.99 * len(expected)
        for (i, k), r in got.items():
            assert r.distance == edit_distance(words(items[k][1]), words(rows[i][1]))
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0


def test_packing(make, corpus, odd, empty):
    from tokenizers import Tokenizer

    path = packing.public_tokenizer()
    coder = Tokenizer.from_file(path)
    for docs, rows in ((make(corpus), corpus), (odd, None), (empty, [])):
        got = packing.pack_documents(docs, path, capacity=256).collect()
        sequences = collections.defaultdict(list)
        for r in got:
            ids = np.frombuffer(r.ids, "<u4")
            assert len(ids) == r.length <= 256 and zlib.crc32(r.ids) == r.ids_crc32 and ids[-1] == 0 or r.length == 256
            sequences[r.sequence_id].append((r.offset, r.length))
        for s in sequences.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= 256
        if rows:
            pieces = collections.defaultdict(list)
            for r in got:
                pieces[r.doc_id].append((r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()))
            for i, t in rows:
                flat = [x for _, _, ids in sorted(pieces[i]) for x in ids]
                assert flat == [*coder.encode(t or "", add_special_tokens=False).ids, 0]
            assert len(sequences) <= 1.1 * sum(r.length for r in got) / 256 + 1


def test_plan_is_tight_and_whole():
    rng = random.Random(11)
    for histogram in ({k: rng.randrange(1, 40) for k in range(1, 2049)}, {2048: 5, 1100: 1000, 700: 900}, {1: 10_000}, {}):
        plan = packing.make_plan(histogram)
        assert {k: n for k, n in plan.used.items() if n} == {k: n for k, n in histogram.items() if n}
        load = collections.Counter()
        for length, _, count, first, each, _ in plan.rows:
            for at in range(count):
                load[first + at // each] += length
        assert all(x <= 2048 for x in load.values()) and len(load) == plan.n_sequences
        if len(histogram) > 100:
            assert plan.n_sequences <= 1.02 * sum(k * n for k, n in histogram.items()) / 2048 + 1


def test_digests_of_chat_query_are_sha256(spark):
    assert spark.range(1).select(F.sha2(F.lit("é").cast("binary"), 256)).first()[0] == hashlib.sha256("é".encode()).hexdigest()
