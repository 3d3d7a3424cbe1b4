import random

import corpus_pipeline
from rimlight.llm.queries import ORACLE_SQL, QUERIES


def test_stages_drop_what_they_should(spark, toy, tmp_path):
    docs, labels = toy
    rows = docs.collect()
    extra = [(1000, rows[3].text), (1001, rows[3].text + " more"), (1002, None), (1003, ""), (None, rows[4].text)]
    more = spark.createDataFrame([(i, t, "s", 0.0, "k", 0) for i, t in extra], docs.schema)
    docs.unionByName(more).unionByName(docs.where("doc_id = 3")).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = now.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == names
        out.write.parquet(str(tmp_path / f"s{k}"))
        now = spark.read.parquet(str(tmp_path / f"s{k}"))
    ids = [r.doc_id for r in now.collect()]
    assert len(ids) == len(set(ids))
    clean = {i for i in range(600) if i % 7 and i % 5 != 1}
    # rows 1000, 1001 are copies of 3; the null id is a copy of 4
    assert not {1000, 1001} & set(ids) and 3 in ids and len(clean - set(ids)) <= 0.02 * len(clean)
    assert sum(i in ids for i in range(600) if i % 7 == 0) <= 5


def test_near_copies_with_null_or_repeated_ids_leave_one_row(spark):
    rng = random.Random(8)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(100)]
    one, two, three, four = text(), text(), text(), text()
    near = lambda words, *more: " ".join([*words, *more])
    rows = [
        # near copies with null ids only; with a text of its own and texts without words among the null ids
        (None, near(one)), (None, near(one, "a")), (None, near(one, "b")), (None, near(text())), (None, None), (None, ""),
        # near copies under one id, which also has another text, the copy of another id's
        (5, near(two)), (5, near(two, "a")), (5, near(three, "a")), (3, near(three)),
        # equal shingle sets under one id and under null
        (7, near(four)), (7, near(four).upper()), (None, near(four) + " "), (9, "few words"), (9, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [(r.doc_id, (r.text or "").lower()) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    heads = {words[0]: name for name, words in zip("1234", (one, two, three, four), strict=True)}
    found = sorted((heads.get(t.split(" ")[0], "-"), i or 0) for i, t in left)
    assert found == [("-", 0)] * 3 + [("-", 9)] * 2 + [("1", 0), ("2", 5), ("3", 3), ("4", 7)]


def test_clashing_names_and_empty_tables(spark, no_docs):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "a", 1, "x", 7), (2, text + " ", "b", 2, "y", 8), (2, text, "c", 2, "y", 9), (3, None, "d", 3, "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _digest string, _node long, _id string, _at long")
    kept = corpus_pipeline.drop_copies(spark, docs, "")
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {rows[1], rows[3]}
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {rows[0], rows[3]}
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        none = stage(spark, no_docs, "")
        assert none.columns == no_docs.columns and none.count() == 0
    assert corpus_pipeline.pack(spark, no_docs, "").count() == 0


def test_every_operator_is_registered():
    names = list(QUERIES)
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert ORACLE_SQL.keys() <= QUERIES.keys()
