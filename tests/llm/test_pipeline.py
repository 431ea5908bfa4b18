"""The pipeline's stages take effect and keep clean documents."""

import pytest
from test_text_operators import brute_contamination, brute_links, plain_lines

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    from tallybook.llm._common import durable
    from tallybook.llm.decontaminate import contamination
    from tallybook.llm.ngram_join import link_documents

    for name, stage in pipeline.STAGES:
        out = durable(stage(spark, docs, sf))
        if name != "tokens":
            assert out.columns == columns and out.dtypes == docs.dtypes
        assert out.count() <= docs.count()
        if name == "quality":
            kept = {r.doc_id for r in out.select("doc_id").collect()}
            clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
            assert sum(i in kept for i in clean) >= 0.95 * len(clean)
        if name == "near_copies":
            assert link_documents(out).where("n_links > 0").count() == 0
        if name == "benchmark":
            assert contamination(out, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").count() == 0
        docs = out
    assert 0 < docs.count() < n and docs.columns == ["doc_id", "n_tokens", "ids"]


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, repeated rows, columns of any name and empty side tables."""
    fields = "doc_id long, text string, n_chars long, n_lines int, label string, _k string"
    rows = [(1, "one text of six plain words", 27, 5, "a", "b"), (None, None, None, None, None, None), (2, "", 0, 5, "a", "b"), (3, "a b c d e f", 11, 1, "c", "d"), (3, "a b c d e f", 11, 1, "c", "d"), (None, "q r s t u v", 11, 1, "c", "d")]
    for name, df in (("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for data, want in ((rows, 5), ([], 0)):
        df = spark.createDataFrame(data, fields)
        df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = pipeline.run(spark, f"file://{tmp_path}").collect()
        assert len(got) == want and sum(r.n_tokens > 0 for r in got) == (3 if want else 0)
    docs = spark.createDataFrame(rows, fields)
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"file://{tmp_path}")
        assert docs.columns == [f.split()[0] for f in fields.split(", ")], name


def test_stages_against_plain_loops(spark, sf):
    """Lines, near copies, benchmark and tokens, each on what the stage before left, row by row."""
    import public_tokenizers
    from tallybook.llm import pieces
    from tallybook.llm._common import durable

    stages = dict(pipeline.STAGES)
    before = durable(stages["quality"](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf))
    rows = {r.doc_id: r.text for r in before.collect()}
    texts = {i: t for i, t in rows.items() if t is not None}
    drop = plain_lines(list(texts.items()), lambda size: 2 if size > 50 else 3)
    want = dict(rows)
    for i, gone in drop.items():
        left = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone)
        if not gone or left.strip():
            want[i] = left
        else:
            del want[i]
    after = durable(stages["lines"](spark, before, sf))
    assert {r.doc_id: r.text for r in after.collect()} == want and len(want) < len(rows) + 1
    groups = brute_links([(i, t) for i, t in want.items()])
    want = {i: t for i, t in want.items() if groups[i][0] == i}
    after = durable(stages["near_copies"](spark, after, sf))
    assert {r.doc_id: r.text for r in after.collect()} == want
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = brute_contamination(list(want.items()), items)
    want = {i: t for i, t in want.items() if not found[i][4]}
    after = durable(stages["benchmark"](spark, after, sf))
    assert {r.doc_id: r.text for r in after.collect()} == want
    coded = stages["tokens"](spark, after, sf)
    assert {r.doc_id for r in coded.where("n_tokens = size(ids)").collect()} == set(want)
    plain = pieces.round_trip(after, public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id: r.n_tokens for r in plain.collect()} == {r.doc_id: r.n_tokens for r in coded.collect()}
