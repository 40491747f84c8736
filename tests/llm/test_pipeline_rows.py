import corpus_pipeline

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def text(name):
    return " ".join(f"{name}{i}" for i in range(80))


def test_one_row_of_each_group_stays(spark):
    # Repeated rows; a null id beside its original; nulls only; two texts under one id, of which one is a copy.
    rows = [(1, text("a")), (1, text("a")), (2, text("a")), (3, text("b")), (None, text("b") + " tail"), (None, text("c")),
            (None, text("c")), (5, text("d")), (6, text("d") + " tail"), (6, text("unique")), (7, text("alone"))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], KIND)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.jaccard_stage(spark, docs, "").collect()]
    want = [(1, text("a")), (3, text("b")), (None, text("c")), (5, text("d")), (6, text("unique")), (7, text("alone"))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_repeated_rows_pass_the_line_stage_and_leave_one(spark):
    rows = [(1, text("w")), (1, text("w")), (2, text("w")), (None, text("w") + " tail"), (9, "another text, of one line only")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], KIND)
    out = corpus_pipeline.jaccard_stage(spark, corpus_pipeline.line_stage(spark, docs, ""), "")
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, text("w")), rows[4]]
