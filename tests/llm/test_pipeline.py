"""Each stage on a table with planted cases, and on odd and empty ones."""

import collections
import random

import corpus_pipeline
from redactory.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    prose = lambda n: " ".join(f"t{rng.randrange(3000)}" for _ in range(n))
    line = "a line that stands in a good many of the documents here"
    docs = [(i, prose(120) + (" vilething vileword vilething vileword" if i % 6 == 0 else "") + (f"\n{line}" if i % 7 == 1 else "")) for i in range(300)]
    docs += [(400, docs[1][1]), (401, docs[2][1] + " more"), (402, None), (403, ""), (404, prose(20) + " " + "b1 b2 b3 b4 b5 b6 b7 b8 b9" + " " + prose(20))]
    table = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table(docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, "B1 b2 b3 b4 b5 b6 b7 b8 b9"), (8, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, at = {}, table(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stored(stage(spark, at, str(tmp_path)))
        assert at.columns == COLUMNS
        kept[name] = {r.doc_id: r.text for r in at.collect()}
    clean = {i for i, _ in docs if i >= 300 or i % 6}
    assert len(kept["toxicity"].keys() ^ clean) <= 8
    assert sum(line in (t or "") for t in kept["line_dedup"].values()) == 1 and kept["line_dedup"].keys() == kept["toxicity"].keys()
    assert kept["line_dedup"].keys() - kept["near_dedup"].keys() <= {400, 401} and {402, 403} <= kept["near_dedup"].keys()
    assert kept["near_dedup"].keys() - kept["decontamination"].keys() == {404}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == kept["decontamination"].keys()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table([]), str(tmp_path)).count() == 0


def test_rows_of_one_id_and_of_none(spark, tmp_path):
    """Stages decide by row: a copy goes, another text of its id stays; a null doc_id hides nothing."""
    rng = random.Random(22)
    prose = lambda n: " ".join(f"t{rng.randrange(3000)}" for _ in range(n))
    a, b, c = prose(80), prose(80), prose(80)
    item = "b1 b2 b3 b4 b5 b6 b7 b8 b9"
    rows = [(1, a), (7, a + " more"), (7, b), (8, c), (8, c), (None, a), (None, f"{prose(9)} {item} {prose(9)}"), (9, f"{item} {prose(9)}"), (9, prose(30)), (10, ""), (11, ""), (12, None)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each(spark, table, str(tmp_path)).collect())
    assert kept == collections.Counter(x for x in rows if x != (7, a + " more")) - collections.Counter([(8, c)])
    clean = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, table, str(tmp_path)).collect())
    assert clean == collections.Counter(x for x in rows if item not in (x[1] or ""))


def test_clashing_columns_come_through_every_stage(spark, tmp_path):
    """Columns named like an operator's own, or like a stage's helpers, change nothing and come back as they were."""
    rng = random.Random(32)
    prose = lambda n: " ".join(f"t{rng.randrange(3000)}" for _ in range(n))
    line = "a line that stands in a good many of the documents here"
    texts = [prose(60) + (" vilething vileword vilething" if i % 6 == 0 else "") + (f"\n{line}" if i % 5 == 1 else "") for i in range(60)]
    texts += [texts[1], texts[2] + " more", None, "", f"{prose(9)} b1 b2 b3 b4 b5 b6 b7 b8 b9 {prose(9)}"]
    clashing = ["text_key", "own_id", "score", "predicted", "toxic_spans", "n_lines", "n_dropped", "row_no", "offset", "component_id", "kept", "own_0", "rep", "n", "d1", "piece", "sequence_id", "_drop", "_id", "judged"]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in clashing)
    own = lambda i: [f"{c}-{i}" for c in clashing]
    table = spark.createDataFrame([(i, t, *own(i)) for i, t in enumerate(texts)], schema)
    plain = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, "B1 b2 b3 b4 b5 b6 b7 b8 b9")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got, want = stored(stage(spark, table, str(tmp_path))), stored(stage(spark, plain, str(tmp_path)))
        assert got.columns == table.columns
        assert sorted((r.doc_id, r.text or "") for r in got.collect()) == sorted((r.doc_id, r.text or "") for r in want.collect())
        assert all(list(r)[2:] == own(r.doc_id) for r in got.collect())
    pieces = corpus_pipeline.pack(spark, table, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in pieces}) == list(range(len(texts))) and all(len(r.ids) == 4 * r.length for r in pieces)
