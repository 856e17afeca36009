"""The pipeline's stages one by one against plain Python, and odd tables through all of them."""

import corpus_pipeline
from tests.llm import plain
from tests.llm.test_similar import heads

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = STAGES["language"](spark, docs, SF)
    assert kept.columns == columns and kept.count() == docs.count()

    before = kept.orderBy("doc_id").collect()
    less = STAGES["lines"](spark, kept, SF)
    assert less.columns == columns
    want = {}
    for row, left in zip(before, plain.lines_left([r.text for r in before], 20), strict=True):
        if len(left) == len(row.text.split("\n")) or "\n".join(left).strip(" "):
            want[row.doc_id] = "\n".join(left)
    got = {r.doc_id: r for r in less.collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())

    # On documents with their copies still there.
    single = STAGES["near-duplicates"](spark, docs, SF)
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == sorted({before[k].doc_id for k in heads([r.text for r in before])})

    clean = STAGES["decontamination"](spark, docs, SF)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert clean.columns == columns
    assert {r.doc_id for r in clean.collect()} == {
        r.doc_id for r in before if not any(plain.contained(r.text, item) for item in items)
    }


def test_run(spark):
    packed = corpus_pipeline.run(spark, SF)
    assert packed.count() > 100 and "batch" in packed.columns


def test_odd_tables(spark):
    """Null ids and texts, repeated rows, no rows, names that operators use inside."""
    rows = [(k, f"the cat number {k} sat on the mat\nand line {k * k} of it is here", "en") for k in range(30)]
    rows += [(None, None, None), (None, "the hat", "en"), (None, "the hat", "en"), (40, "", "en"), (41, "...", None), (42, "the " * 30_000, "en")]
    schema = "doc_id long, text string, lang string, fp int, line string, n int, h1 string, place string, mark string"
    docs = spark.createDataFrame([(*r, 1, "x", 2, "y", "z", "w") for r in rows], schema)
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, SF)
            assert table.columns == docs.columns, name
        assert corpus_pipeline.pack_documents(spark, table, SF).count() == table.count() + (table.where("doc_id = 42").count() * 14)
