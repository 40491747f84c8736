import random

import pyarrow as pa
from tokenizers import Tokenizer

from casebook.llm.queries import tokenizer_path
from casebook.llm.tokenize import Encoder


def test_added_tokens_keep_their_ids():
    random.seed(5)
    fresh = Tokenizer.from_file(tokenizer_path())
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "a", "B.", "'s", "\u3000", "é", "|", "<", ">", "1"]
    texts = ["hello <|endoftext|> world", "<|endof", "text|>", "", None, "a  <|endoftext|>\nb", "<|endoftext|><|endoftext|>"]
    texts += ["".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(3000)]
    ids, off = Encoder(tokenizer_path()).encode(pa.array(texts))
    assert ids[off[0]:off[1]].tolist() == [31373, 220, 50256, 995]
    for i, t in enumerate(texts):
        assert ids[off[i]:off[i + 1]].tolist() == fresh.encode(t or "", add_special_tokens=False).ids
