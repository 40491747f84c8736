import corpus_pipeline
from casebook.llm import queries


def test_equal_short_lines_are_found(spark, monkeypatch):
    long = "a line of more than twenty characters"
    rows = [(1, f"ok\n{long}\nPage 1\n\n   \nx"), (2, "ok\nPage 2\n\n   \nPage 1"), (3, "x\nOK\n" + long + "!!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(queries, "read_table", lambda *_: docs)
    got = {r.doc_id: r.removed_lines for r in queries.op3(spark, "").collect()}
    # Equal lines of any length go, blank ones stay, and an edit counts in long lines only.
    assert got == {1: [], 2: [0, 4], 3: [0, 2]}
    full = docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    kept = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, full, "").collect()}
    assert kept == {1: rows[0][1], 2: "Page 2\n\n   ", 3: "OK"}
