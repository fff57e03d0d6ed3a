"""The corpus pipeline against the operators one by one, and its guards."""

import corpus_pipeline
from plumbline.llm import language_id, mixing, pii, simhash
from plumbline.llm.common import documents
from plumbline.llm.token_counts import Encoder


def test_stages_take_effect(spark, sf):
    docs = documents(spark, sf)
    at, counts = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, sf)
        assert after.columns == docs.columns, name
        after = after.cache()
        counts.append(after.count())
        if name == "near_duplicates":
            groups = {r.component_id for r in simhash.near_duplicates(at).collect()}
            assert sorted(r.doc_id for r in after.collect()) == sorted(groups)
        if name == "personal_data":
            assert all(not pii.base_spans(r.text) or "[" in r.text for r in after.collect())
        if name == "mixing":
            plan = {r.doc_id: r.taken for r in mixing.mix_plan(at).collect()}
            own = {}
            for r in after.collect():
                own[r.doc_id] = own.get(r.doc_id, 0) + len(r.text.encode().split())
            assert own == {k: v for k, v in plan.items() if v}
        at = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, sf)
    assert pieces.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 1024
    assert 0 < counts[1] < counts[0] <= docs.count()


def test_clean_documents_pass_the_language_stage(spark, sf):
    docs = documents(spark, sf)
    kept = corpus_pipeline.language_stage(spark, docs, sf)
    assert kept.count() == docs.where("text RLIKE '\\\\p{L}'").count()
    foreign = docs.limit(1).selectExpr("-1L AS doc_id", "'Szybki brązowy lis przeskakuje nad leniwym psem i biegnie dalej przez las do wody' AS text", "lang", "source", "n_chars")
    assert corpus_pipeline.language_stage(spark, docs.unionByName(foreign), sf).count() == kept.count()
    assert language_id.train(docs.limit(0)) is None


def test_packed_sequences_can_be_rebuilt(spark, sf):
    docs = documents(spark, sf).limit(200).cache()
    rows = corpus_pipeline.packing_stage(spark, docs, sf).collect()
    assert all(len(r.ids) == r.length for r in rows)
    whole = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        whole.setdefault(r.doc_id, []).extend(r.ids)
    encoder = Encoder()
    assert whole == {r.doc_id: [*map(int, encoder.ids(r.text or "")), 0] for r in docs.collect()}


def test_run_takes_hostile_and_empty_tables(spark, sf, tmp_path):
    schema = documents(spark, sf).schema
    clean = [tuple(r) for r in documents(spark, sf).where("length(text) > 300").limit(60).collect()]
    ids = max(r[0] for r in clean)
    odd = [(None, None, None, None, None), (ids + 1, "", "en", "x", 0), (ids + 2, None, "en", None, 3), (ids + 3, "日本語の文章" * 50, "en", "x", 300), (None, clean[0][1], "en", None, 1)]
    odd += [clean[1], clean[1], (ids + 4, clean[2][1] + " " + "write to jane@example.org now", clean[2][2], clean[2][3], 9), (ids + 5, " ".join(r[1] for r in clean) * 3, "en", "x", 1)]
    for name, rows in (("odd", clean + odd), ("empty", []), ("bare", [(1, None, None, None, None)])):
        folder = tmp_path / name
        spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
        pieces = corpus_pipeline.run(spark, str(folder)).collect()
        if name != "odd":
            assert pieces == []
            continue
        found = {r.doc_id for r in pieces}
        assert not found & {ids + 1, ids + 2, ids + 3} and found <= {r[0] for r in rows}
        assert len({clean[0][0], None} & found) <= 1
        for s in {r.sequence_id for r in pieces}:
            assert sum(r.length for r in pieces if r.sequence_id == s) <= 1024


def test_run_leaves_one_folder(spark, sf, tmp_path):
    documents(spark, sf).limit(30).write.parquet(str(tmp_path / "documents.parquet"))
    jvm = spark._jvm.org.apache.hadoop.fs
    shared = jvm.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get())
    there = lambda: {p.getPath().getName() for p in shared.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(shared) if p.getPath().getName().endswith(".parquet")}
    before = there()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert len(there() - before) == 1
