"""Very long texts and words, and hashes that meet, in operators 2, 8 and 10."""

import numpy as np

from casebook.llm import jaccard, token_counts, tokenize
from casebook.llm.queries import tokenizer_path
from tests.llm.test_llm_python import plain_components


def test_pieces_that_share_a_hash(monkeypatch):
    """The ids stay right, in that batch and after it, whether lengths differ or not."""
    import pyarrow as pa
    texts = pa.array(["a bb ccc", "dd ee bb", "", None, "ccc a zzz a"])
    plain = tokenize.Encoder(tokenizer_path())
    want = [plain.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]

    def ids(encoder):
        flat, off = encoder.encode(texts)
        return [flat[a:z].tolist() for a, z in zip(off[:-1], off[1:])]

    encoder = tokenize.Encoder(tokenizer_path())
    for clash in (lambda v: np.zeros(len(v), np.uint64), lambda v: np.arange(len(v), dtype=np.uint64) // np.uint64(2)):
        monkeypatch.setattr(tokenize, "hash_bytes", clash)
        assert ids(encoder) == want
    monkeypatch.undo()
    assert ids(encoder) == want == ids(encoder)


def test_one_very_long_word(spark):
    docs = spark.createDataFrame([(1, "ab" * 40_000), (2, "x " + "é" * 20_000 + " y"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs, tokenizer_path()).collect()}
    assert got[1]["n_words"] == 1 and got[1]["n_pieces"] == got[1]["max_pieces"] > 1000
    assert got[2]["n_words"] == 3 and got[3]["n_pieces"] == 0


def test_very_long_texts_in_the_jaccard_join(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, " ".join(f"v{i}" for i in range(60_000))), (4, "w1 w2 w3 w4 w5"), (5, "w1 w2 w3 w4 w5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.jaccard_components(docs, 4, 85).collect()), key=str)
    assert got == plain_components(rows, 4, 85)
