"""Two views of a message against a plain list of marked characters; the recogniser's spans; rules that are skipped."""

import random

from redactory.operators import detect, recogniser, views
from redactory.operators.detect import long_form, resolve, scan

ITEM, ACTION = "id long, start long, stop long, value string, type string, label string, fake string", "id long, seq long, action string, view string, start long, stop long, text string, type string"
TYPES = ["EMAIL", "PHONE", "NAME_PII"]


class ByHand:
    """Atoms in order: a plain character, or a mark (real, fake, type, manual)."""

    def __init__(self, text, items):
        self.atoms, at = [], 0
        for start, stop, type_, fake in sorted(items):
            if start >= at:
                self.atoms += [*text[at:start], (text[start:stop], fake, type_, False)]
                at = stop
        self.atoms += [*text[at:]]

    def texts(self):
        return tuple("".join(a if isinstance(a, str) else a[k] for a in self.atoms) for k in (0, 1))

    def places(self, view):
        out, at = [], 0
        for a in self.atoms:
            n = 1 if isinstance(a, str) else len(a[view == "masked"])
            out.append((at, at + n))
            at += n
        return out, at

    def do(self, action, view, start, stop, text, type_):
        where, size = self.places(view)
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        if action == "edit":
            left = [a for a, (x, y) in zip(self.atoms, where) if y <= start]
            right = [a for a, (x, y) in zip(self.atoms, where) if x >= stop and not y <= start]
            self.atoms = [*left, *(text or ""), *right]
        elif action == "unmask":
            self.atoms = [c for a, (x, y) in zip(self.atoms, where) for c in ([a] if isinstance(a, str) or not (x < stop and y > start) else a[0])]
        elif action == "mask" and text is not None:
            inside = [i for i, (x, y) in enumerate(where) if x < stop and y > start]
            if inside and all(isinstance(self.atoms[i], str) for i in range(inside[0], inside[-1] + 1)):
                while inside and self.atoms[inside[0]].isspace():
                    inside = inside[1:]
                while inside and self.atoms[inside[-1]].isspace():
                    inside = inside[:-1]
                if inside:
                    a, z = inside[0], inside[-1] + 1
                    self.atoms[a:z] = [("".join(self.atoms[a:z]), text, type_ or "CUSTOM", True)]


def cases(n=60, seed=9):
    rng = random.Random(seed)
    some = lambda k: "".join(rng.choice("ab c\né") for _ in range(rng.randint(0, k)))
    texts, items, actions, hands = [], [], [], {}
    for i in range(n):
        text, own, at = some(25), [], 0
        while at < len(text) and rng.random() < 0.7:
            start = rng.randint(at, len(text))
            stop = rng.randint(start + 1, start + 5)
            if stop > len(text):
                break
            own.append((start, stop, rng.choice(TYPES), some(4) + "x"))
            at = stop
        texts.append((i, text))
        items += [(i, a, z, text[a:z], t, f"{t} label", f) for a, z, t, f in own]
        hands[i] = ByHand(text, own)
        for seq in range(rng.randint(0, 6)):
            a = rng.randint(0, 30)
            act = (rng.choice(["mask", "edit", "unmask", "mask"]), rng.choice(["real", "masked"]), a, a + rng.randint(0, 6), rng.choice([some(3) + "y", some(3) + "z", None]), rng.choice([None, "EMAIL"]))
            actions.append((i, seq, *act))
            hands[i].do(*act)
    return texts, items, actions, hands


def made(spark, texts, items, actions):
    model = views.review_model(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(items, ITEM))
    return views.revised(model, spark.createDataFrame(actions, ACTION).repartition(3))


def test_random_edits_and_masks_equal_a_list_of_atoms(spark):
    texts, items, actions, hands = cases()
    model = made(spark, texts, items, actions)
    got = {r.id: r for r in views.shown_views(model).collect()}
    spans = {}
    for r in views.marks(model).collect():
        spans.setdefault(r.id, []).append((r.real_start, r.real_stop, r.masked_start, r.masked_stop, r.real, r.fake, r.type, r.manual))
    for i, hand in hands.items():
        assert (got[i].real, got[i].masked) == hand.texts(), i
        (real, _), (masked, _) = hand.places("real"), hand.places("masked")
        want = [(*a, *b, *m) for m, a, b in zip(hand.atoms, real, masked) if not isinstance(m, str)]
        assert sorted(spans.get(i, [])) == sorted(want) and got[i].n_marks == len(want)


def test_selections_are_found_in_the_other_view(spark):
    texts, items, actions, hands = cases(40, 4)
    rng = random.Random(1)
    asked = [(i, rng.choice(["real", "masked"]), a, a + rng.randint(1, 6)) for i in hands for a in [rng.randint(0, 25)]]
    got = views.anchored(made(spark, texts, items, actions), spark.createDataFrame(asked, "id long, view string, start long, stop long"))
    rows = {r.id: r for r in got.collect()}
    for i, view, start, stop in asked:
        (places, size), r = hands[i].places(view), rows[i]
        start, stop = min(start, size), min(stop, size)
        inside = [k for k, (x, y) in enumerate(places) if x < stop and y > start]
        for side in ("real", "masked"):
            other, total = hands[i].places(side)
            want = (other[inside[0]][0], other[inside[-1]][1]) if inside else (total, total)
            if not inside and start < size:
                continue  # between two characters
            assert (r[f"{side}_start"], r[f"{side}_stop"]) == want, (i, view, start, stop)
        assert r.n_marks == sum(not isinstance(hands[i].atoms[k], str) for k in inside)


def test_items_of_a_message_and_their_legend(spark):
    scanned = resolve(scan(spark.createDataFrame([(1, "my licence number 12345678, mail jo@ex.com.au or jo@ex.com.au"), (2, None), (3, "diabetes")], "id long, text string")))
    scanned = scanned.withColumnRenamed("text", "t") if "t" not in scanned.columns else scanned
    known = spark.createDataFrame([("jo@ex.com.au", "EMAIL", "mia@sample.net")], "real string, type string, fake string")
    items = views.review_items(scanned, known)
    model = views.review_model(scanned.select("id", "t"), items)
    got = {r.id: r for r in views.shown_views(model).collect()}
    assert got[1].masked.endswith("mail mia@sample.net or mia@sample.net") and "12345678" not in got[1].masked and got[1].real.startswith("my licence number 12345678")
    assert got[1].legend == ["Driver licence number", "Email address"] and (got[2].real, got[3].masked, got[3].n_marks) == ("", "diabetes", 0)
    assert {(r.label, r.n, r.first_id) for r in views.legend(views.marks(model)).collect()} == {("Driver licence number", 1, 1), ("Email address", 2, 1)}


TOKENS = [
    (1, 0, "Mr", "O", 0.99), (1, 3, "Jo", "B-PER", 0.9), (1, 5, "##hn", "I-PER", 0.7), (1, 8, "Smith", "I-PER", 0.8), (1, 14, "Acme", "B-ORG", 0.5), (1, 19, "Perth", "B-LOC", 0.61), (1, 25, "Oslo", "B-LOC", 0.95),
    (1, 30, "thing", "B-MISC", 0.99), (2, 0, "##Ann", "I-PER", None), (2, 6, "Lee", "I-ORG", None), (2, 10, "x", None, 0.9), (2, 12, "Bo", "I-PER", 0.7), (2, 15, "at", "O", 0.9), (2, 18, "Cy", "I-PER", 0.7),
]


def test_spans_of_a_tagger(spark):
    tokens = spark.createDataFrame(TOKENS, "id long, start long, token string, label string, score double").repartition(4)
    got = sorted((r.id, r.start, r.value, r.type, r.severity, round(r.score, 2) if r.score else None) for r in recogniser.assembled(tokens).collect())
    assert got == [
        (1, 3, "John Smith", "NAME_PII", "medium", 0.8), (1, 19, "Perth", "ADDRESS", "medium", 0.61), (1, 25, "Oslo", "ADDRESS", "medium", 0.95), (2, 0, "Ann", "NAME_PII", "medium", None),
        (2, 6, "Lee", "BUSINESS_CONFIDENTIAL", "low", None), (2, 12, "Bo", "NAME_PII", "medium", 0.7), (2, 18, "Cy", "NAME_PII", "medium", 0.7),
    ]
    scanned = resolve(scan(spark.createDataFrame([(1, "ab John.Smith@ex.com Perth")], "id long, t string"), "t"))
    off, on = recogniser.with_recogniser(scanned), recogniser.with_recogniser(scanned, tokens)
    assert [(r.value, r.source) for r in off.collect()] == [("John.Smith@ex.com", "rules")]
    assert sorted((r.value, r.source) for r in on.where("id = 1").collect()) == [("John.Smith@ex.com", "rules"), ("Oslo", "nlp")]


def test_skipped_rules_would_have_found_nothing(spark, monkeypatch):
    rng = random.Random(2)
    words = """Medicare TFN 123 456 782 acn ABN 51 824 753 556 PA1234567 driver's LICENCE: AB123456 062-000 account savings 12345678 -33.8688, 151.2093 jo@ex.com.au 0412 345 678 +61 1300 123 call fax SMS d.o.b. BORN
      12 March 1980 12/03/1981 salary $85,000 $2 Million confidential do not share NDA annual revenue ARR diagnosed 5mg HIV Court case no: AB-12 visa subclass 482 password is Hunter2!x token=abcdef Str0ng-Pass1! My name is Jane Doe
      John Smith bank i'm This is 12 Old Mill Road Sydney NSW 2000 4111111111111111 . , : \n""".split(" ")
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))) for i in range(1500)]
    df = spark.createDataFrame(texts, "id long, t string")
    found = lambda: sorted((r.id, r.ord, r.value) for r in long_form(scan(df, "t").select("id", "findings")).select("id", "ord", "value").collect())
    gated = found()
    monkeypatch.setattr(detect, "_may_find", lambda name: "true")
    assert gated == found() and len(gated) > 1500
    assert set(detect.NEEDS) == set(detect.BY_NAME)


def test_a_wide_csv_file_keeps_its_columns(spark, tmp_path):
    from redactory.sources.sheets import csv_cells

    (tmp_path / "w.csv").write_text(",".join(f"v{i}" for i in range(300)) + "\n" + '"a,b\nc",d\n')
    cells = {(r.row_no, r.col_no): r.value for r in csv_cells(spark, str(tmp_path / "w.csv"), "S").collect()}
    assert len(cells) == 302 and cells[0, 299] == "v299" and cells[1, 0] == "a,b\nc"
    (tmp_path / "e.csv").write_text("")
    assert csv_cells(spark, str(tmp_path / "e.csv"), "S").count() == 0


def workbook(sheets, stored=False):
    """A workbook by hand: cells (row, column letters, value) by sheet, values shared, inline or numbers."""
    import io
    import zipfile

    out, shared = io.BytesIO(), []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="m" xmlns:r="r"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = []
            for r, cells in rows.items():
                inside = ""
                for c, v in cells.items():
                    if isinstance(v, int):
                        inside += f'<c r="{c}{r}"><v>{v}</v></c>'
                    elif v.startswith("="):
                        inside += f'<c r="{c}{r}" t="inlineStr"><is><t>{v[1:]}</t></is></c>'
                    else:
                        shared.append(v)
                        inside += f'<c r="{c}{r}" t="s"><v>{len(shared) - 1}</v></c>'
                body.append(f'<row r="{r}">{inside}</row>')
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="m"><sheetData>{"".join(body)}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>{v}</t></si>" for v in shared) + "</sst>")
    return out.getvalue()


def test_a_workbook_is_the_work_of_several_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from redactory.sources.sheets import read_workbook, workbook_cells

    sheets = {f"Sheet {i}": {r: {"A": f"name {i} {r}", "B": r, "ZZ": "=far"} for r in range(1, 40)} for i in range(12)}
    sheets["Long"] = {r: {"A": "x" * 50, "C": r} for r in range(1, 6000)}
    sheets["Empty"] = {}
    (tmp_path / "a.xlsx").write_bytes(workbook(sheets))
    cells = workbook_cells(spark, str(tmp_path / "a.xlsx"))
    want = {(n, r - 1, {"A": 0, "B": 1, "C": 2, "ZZ": 701}[c], str(v).lstrip("=")) for n, rows in sheets.items() for r, cs in rows.items() for c, v in cs.items()}
    assert {tuple(r) for r in cells.collect()} == want
    assert cells.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    small = {"S": {1: {"A": "one"}, 2: {"AB": 46146}}}
    assert read_workbook(workbook(small, stored=True)) == [("S", 0, 0, "one"), ("S", 1, 27, "46146")]


def test_extra_findings_keep_clear_of_others_and_of_each_other(spark):
    from redactory.operators.review import without_overlaps

    rng = random.Random(8)
    spans = lambda n: [(i, rng.randint(0, 60), "x" * rng.randint(0, 6), j) for i in range(40) for j in range(rng.randint(0, n))]
    extra, found = spans(9), spans(4)
    want = set()
    for i in range(40):
        taken = [(s, s + len(v)) for k, s, v, _ in found if k == i]
        for s, z, v, j in sorted((s, s + len(v), v, j) for k, s, v, j in extra if k == i):
            if not any(s < b and z > a for a, b in taken):
                want.add((i, s, v, j))
                taken.append((s, z))
    schema = "id long, start long, value string, no long"
    got = without_overlaps(spark.createDataFrame(extra, schema), spark.createDataFrame(found, schema).drop("no"))
    assert {tuple(r) for r in got.select("id", "start", "value", "no").collect()} == want and len(want) > 50
