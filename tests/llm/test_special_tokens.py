"""Texts with an added token get the ids of the library with its defaults."""

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from loomspan.llm.tokens import encoder, tokenizer_path


def test_added_tokens():
    texts = ["a plain text", "one<|endoftext|>two", "<|endoftext|>", " before <|endoftext|> behind\n x", "<|endoftext|", None, "  <|endoftext|><|endoftext|> é"]
    tok = Tokenizer.from_file(tokenizer_path())
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    enc = encoder(tokenizer_path())
    ids, ends = enc.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.pieces(texts)] == want
    assert 50256 in want[1]
