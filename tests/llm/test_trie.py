"""The prefix trie against brute force, colliding fingerprints, and odd inputs."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from redactory.llm import prefix_trie
from redactory.llm.prefix_trie import op12_prefix_trie
from redactory.llm.running_sums import running_sums

SCHEMA = "conv_id long, turn long, role string, text string, c string, depth string, key string, pos string"


def trie_by_hand(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(convs.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + own[h:])
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def below(p):
        leaves, saved = (0, 0) if children.get(p) else (1, 0)
        saved += (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for k in children.get(p, []):
            a, b = below(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(rebuilt[c]) == len(p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children.get(p, [])), *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, tmp_path, rows):
    path = str(tmp_path / f"t{random.random()}")
    spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA).write.parquet(f"{path}/conversations.parquet")
    return sorted((tuple(r) for r in op12_prefix_trie(spark, path).collect()), key=repr)


def many(seed=1, n=70, texts=3, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 3 * n), n):
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "d e f"][:texts])) for t in range(rng.randint(1, longest))]
    rng.shuffle(rows)
    return rows


ODD = [
    (None, 0, "user", "lost"), (5, None, None, None), (5, None, "user", "first"), (5, 1, "user", "x"), (5, 1, "user", "x"), (5, 1, "assistant", "x"), (-7, 0, "user", ""), (-7, 1, "user", "long " * 30_000),
    (0, 0, "user", "first"), (0, 3, "", "ä ß c"), (1, 0, "user", "first"), (2**40, 0, "user", "first"),
]


def test_trie_equals_brute_force(spark, tmp_path):
    for rows in (many(), many(2, 40, 1, 4), ODD, ODD + many(3), [(7, 0, "user", "a"), (8, 0, "user", "a"), (60, 0, "user", "a")]):
        assert trie(spark, tmp_path, rows) == trie_by_hand(rows)
    assert trie(spark, tmp_path, []) == []


def test_snapshots_of_a_growing_conversation(spark, tmp_path):
    """Each conversation is the one before with a turn more: every chain is one node, as deep as there are conversations."""
    rows = [(c * 20 + 100, t, "user", f"turn {t}") for c in range(25) for t in range(c + 1)]
    assert trie(spark, tmp_path, rows) == trie_by_hand(rows)


def test_colliding_fingerprints_are_split(spark, tmp_path, monkeypatch):
    """With a fingerprint of a few values unlike prefixes share groups, and verification tells them apart."""
    real = prefix_trie.fingerprinted
    weak = lambda df: real(df).withColumn("key", F.pmod("key", F.lit(3))).withColumn("before", F.when(F.col("depth") > 1, F.pmod("before", F.lit(3))).otherwise(F.lit(0)))
    monkeypatch.setattr(prefix_trie, "fingerprinted", weak)
    rows = many(4, 30)
    assert trie(spark, tmp_path, rows) == trie_by_hand(rows)


def test_large_groups_go_by_salts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SALT_ROWS", 10)
    rows = [(c, t, "user", f"common {t}") for c in range(300) for t in range(2)] + many(5)
    rows = [r for r in rows if r[0] is None or r[0] < 300]
    assert trie(spark, tmp_path, rows) == trie_by_hand(rows)


def test_running_sums_over_ranges(spark):
    """A group over many ranges, groups inside one, and negative terms."""
    rows = [(1, i, i % 7 - 3) for i in range(5000)] + [(2, 0, 5)] + [(k, i, 1) for k in range(3, 200) for i in range(3)]
    want, so_far = {}, {}
    for g, i, x in sorted(rows):
        so_far[g] = so_far.get(g, 0) + x
        want[g, i] = so_far[g]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running_sums(spark.createDataFrame(rows, "g long, i long, x long").repartition(5), "g", [F.asc("i")], ["x"])
        assert {(r["g"], r["i"]): r["x_sum"] for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
