import corpus_pipeline as P
from anchorline.session import stable
from tests.llm.plain import FOLDER, documents
from tests.llm.test_line_dedup import lines_of
from tests.llm.test_near_dedup import classes
from tests.llm.test_packing import padding
from tests.llm.test_secret_scan import expected


def test_each_stage_on_the_output_of_the_one_before(spark):
    docs = documents(spark).select(P.COLUMNS)
    steps, schema = {"documents": docs}, docs.schema.simpleString()
    for name, stage in P.STAGES:
        docs = stable(stage(spark, docs, FOLDER))
        steps[name] = docs
        assert name == "packing" or docs.schema.simpleString() == schema
    rows = {name: {r.doc_id: r for r in df.collect()} for name, df in steps.items() if name != "packing"}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    gone = set(rows["documents"]) - set(rows["toxicity"])
    assert sum(labels.get(d) == 0 for d in gone) <= 0.02 * len(rows["documents"])
    assert all(rows["toxicity"][d] == rows["documents"][d] for d in rows["toxicity"])
    for d, r in rows["line_dedup"].items():
        before = rows["toxicity"][d]
        assert set(lines_of(r.text)) <= set(lines_of(before.text)) and r.n_chars == len(r.text)
    same = classes([(d, r.text) for d, r in sorted(rows["line_dedup"].items()) if len(r.text) < 1500])
    assert len(same) and all(d == root for d, root in same.items() if d in rows["near_dedup"])
    for d, r in rows["secret_scan"].items():
        found = expected(rows["near_dedup"][d].text)
        assert (r.text == rows["near_dedup"][d].text) == (not found) and not expected(r.text)
    final = [(d, r.text) for d, r in rows["secret_scan"].items()]
    assert padding(steps["packing"].collect(), final) == 0


def test_toxic_documents_go(spark):
    docs = documents(spark).select(P.COLUMNS)
    insults = "idiot moron scum worthless pathetic clown loser trash stupid disgusting"
    bad = spark.createDataFrame([(10**6, f"the and of {insults} was {insults}", "en", "s", 9)], docs.schema)
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(P.COLUMNS)
    left = {r.doc_id for r in P.reject_toxic(spark, docs.unionAll(bad), folder).select("doc_id").collect()}
    assert 10**6 not in left


def test_repeated_rows_keep_one(spark):
    docs = documents(spark).select(P.COLUMNS)
    twice = docs.unionAll(docs)
    once = sorted(r.doc_id for r in P.keep_one_of_each(spark, docs, FOLDER).collect())
    assert sorted(r.doc_id for r in P.keep_one_of_each(spark, twice, FOLDER).collect()) == once
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
