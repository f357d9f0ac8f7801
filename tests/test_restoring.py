"""Restoring owner by owner, and the search for stand-ins, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from redactory.operators import restoring, segments
from redactory.operators.masking import GRAM, texts_with_fakes
from redactory.operators.restoring import owned, restore_by_rules, restore_rules

TABLE = "owner long, real string, type string, fake string"


def restored(spark, table, texts, direction="unmask", **kw):
    rules = restore_rules(spark.createDataFrame(table, TABLE), direction, **kw)
    return {r.id: r.restored for r in restore_by_rules(spark.createDataFrame(texts, "owner long, id long, t string"), rules).collect()}


TWO = [
    (1, "Hunter10!x", "PASSWORD", "[redacted-secret]"), (2, "Hunter27!x", "PASSWORD", "[redacted-secret]"), (1, "Jane Doe", "NAME_PII", "Liam Brown"), (2, "Zoe Ray", "NAME_PII", "Liam Reid"),
    (3, "one", "PASSWORD", "[redacted-secret]"), (3, "two", "PASSWORD", "[redacted-secret]"), (3, "Al Bo", "NAME_PII", "Liam Brown"), (3, "Cy Di", "NAME_PII", "Liam Reid"),
]
SAID = "Liam, Liam Brown and Liam\n Reid use [redacted-secret]."


def test_secrets_and_names_stay_with_their_owner(spark):
    texts = [(o, o, SAID) for o in (1, 2, 3, 4)]
    got = restored(spark, TWO, texts)
    assert got[1] == "Jane, Jane Doe and Jane\n Reid use Hunter10!x."
    assert got[2] == "Zoe, Zoe Brown and Zoe Ray use Hunter27!x."
    # what stands for several values of one owner is left as it is: the secret, and the first name alone
    assert got[3] == "Liam, Al Bo and Cy Di use [redacted-secret]."
    assert got[4] == SAID


def test_the_last_secret_and_the_first_name_on_request(spark):
    found = [(3, 1, "PASSWORD", "two", 4), (3, 2, "PASSWORD", "one", 0), (3, 3, "NAME_PII", "Cy Di", 0), (3, 3, "NAME_PII", "Al Bo", 9), (4, 9, "HEALTH", "ill", 0)]
    findings = spark.createDataFrame(found, "owner long, id long, type string, value string, start long")
    table = spark.createDataFrame([(r, t, f) for o, r, t, f in TWO if o == 3], "real string, type string, fake string")
    mine = owned(findings, table)
    assert {(r.owner, r.real) for r in mine.collect()} == {(3, x) for x in ("one", "two", "Al Bo", "Cy Di")}
    rules = restore_rules(mine, ambiguous="last")
    got = restore_by_rules(spark.createDataFrame([(3, 1, SAID)], "owner long, id long, t string"), rules).first()
    assert got.restored == "Cy, Al Bo and Cy Di use one."


def test_the_way_back_masks_again(spark):
    text = "Jane Doe, Jane and Doe use Hunter10!x; Janet does not"
    assert restored(spark, TWO, [(1, 1, text), (2, 2, text)], "mask") == {1: "Liam Brown, Liam and Brown use [redacted-secret]; Janet does not", 2: text}


def test_one_pass_and_odd_texts(spark):
    table = [(1, "bb", "CUSTOM", "aa"), (1, "aa", "CUSTOM", "bb"), (1, r"$1 \2", "CUSTOM", "cc.*"), (1, "long", "CUSTOM", "aa bb"), (1, "ok", "CUSTOM", "—"), (1, "é", "CUSTOM", "ü x")]
    texts = [(1, 1, "aa bb aa, cc.* ccc"), (1, 2, None), (1, 3, ""), (1, 4, "— x—"), (1, 5, "aa " * 20_000), (1, 6, "\x01aa\x02bb\x01"), (1, 7, "aa\n,bb\nü  x"), (9, 8, "aa")]
    assert restored(spark, table, texts) == {
        1: r"long bb, $1 \2 ccc", 2: None, 3: "", 4: "ok x—", 5: "bb " * 20_000, 6: "\x01bb\x02aa\x01", 7: "long\né", 8: "aa",
    }
    assert restored(spark, [], [(1, 1, "aa")]) == {1: "aa"} and restored(spark, table, []) == {}


def test_random_rules_equal_a_scan_from_the_left(spark):
    rng = random.Random(7)
    words = ["a1", "b", "cc", "d-d", "e.", "(f)"]
    some = lambda k: " ".join(rng.choice(words) for _ in range(rng.randint(1, k)))
    table = list({(o, s): (o, f"<{i}>", "CUSTOM", s) for i, (o, s) in enumerate((rng.randint(1, 3), some(3)) for _ in range(30))}.values())
    texts = [(rng.randint(1, 3), i, ",".join(some(4) for _ in range(3))) for i in range(60)]
    want = {}
    for o, i, t in texts:
        rules = sorted(((s, r) for p, r, _, s in table if p == o), key=lambda x: (-len(x[0]), x[0]))
        out, at = "", 0
        while at < len(t):
            for s, r in rules:
                m = re.compile(r"(?<![A-Za-z0-9])" + r"[\s,]+".join(map(re.escape, s.split())) + r"(?![A-Za-z0-9])").match(t, at)
                if m:
                    out, at = out + r, m.end()
                    break
            else:
                out, at = out + t[at], at + 1
        want[i] = out
    assert restored(spark, table, texts) == want


@pytest.mark.parametrize("most", [200_000, 3])
def test_search_for_fakes_equals_contains(spark, monkeypatch, most):
    """Patterns shorter and longer than a run, in one another, and joined instead of sent."""
    from redactory.operators import masking

    monkeypatch.setattr(masking, "sent_if_small", lambda df: F.broadcast(df) if most > 3 else df.hint("merge"))
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abä\n ") for _ in range(n))
    fakes = [text(rng.choice([3, 4, 5, GRAM - 1, GRAM, GRAM + 1, 14])) for _ in range(40)] + ["", "abcdefghij" * 3]
    texts_of = [text(rng.randint(0, 60)) for _ in range(300)]
    fakes += [t[5 : 5 + n] for t, n in zip(texts_of[:40], [GRAM, 20, GRAM + 1, 6] * 10)] + [None]
    texts = [(i, t) for i, t in enumerate(texts_of)] + [(900, None), (901, ""), (902, "x" * 100_000 + "abcdefghij" * 3), (903, "abcdefghij" * 2)]
    got = texts_with_fakes(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(f,) for f in fakes], "fake string"))
    want = {i for i, t in texts if t and any(f and f in t for f in fakes)}
    assert 20 < len(want) < 300
    assert sorted(r.id for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan
    assert texts_with_fakes(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([], "fake string")).count() == 0


def test_many_rules_meet_only_likely_words_and_restore_the_same(spark, monkeypatch):
    rules = restore_rules(spark.createDataFrame([(f"Real {i}", "CUSTOM", f"Client {i}") for i in range(300)] + [("é", "CUSTOM", "--")], "real string, type string, fake string"))
    texts = spark.createDataFrame([(i, f"About Client {i}, not xClient {i} -- and Client,\n{i}.") for i in range(400)], "id long, t string")
    few = sorted(map(repr, restore_by_rules(texts, rules).collect()))
    monkeypatch.setattr(restoring, "MOST_SENT", 10)
    assert sorted(map(repr, restore_by_rules(texts, rules).collect())) == few
    words = texts.select(F.explode(F.split("t", "[^A-Za-z0-9]+")).alias("head")).distinct()
    likely = {r.head for r in restoring._likely(words, rules.where("head <> ''")).collect()}
    assert {str(i) for i in range(300)} <= likely and len(likely) < 320


def test_passes_beside_each_other_restore_once(spark):
    rules = restore_rules(spark.createDataFrame([("Ada Berg", "CUSTOM", "Client 1")], "real string, type string, fake string"))
    segs = spark.createDataFrame([(1, 0, "to Client"), (1, 1, "1 or Client 1"), (2, 0, "Client 1")], "msg_id long, seg_no int, t string")
    pins = spark.createDataFrame([(1, "real", None), (2, "fake", "fake")], "msg_id long, view string, lock string")
    both = segments.with_shown(segments.with_shown(segments.restored_segments(segs, rules), pins, True, "on"), pins, False, "off")
    assert r"\A(?:" not in both._jdf.queryExecution().optimizedPlan().toString()  # what matches a text is in a written step
    for auto, name in ((True, "on"), (False, "off")):
        alone = {(r.msg_id, r.seg_no): r.shown for r in segments.restore_pass(segs, pins, rules, auto)[0].collect()}
        assert {(r.msg_id, r.seg_no): r[name] for r in both.collect()} == alone
