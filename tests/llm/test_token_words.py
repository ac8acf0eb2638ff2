"""Op 10 encodes the letters of a word once, whatever marks and line breaks stand around them."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from prefmill.llm import token_output

PARTS = ["a", "Bc", "é", "ß", "1", "٣", " ", " ", " ", "\n", "\n", "\t", "\r", " ", ".", ",", "'", "'s", "'ll", "!", "&&&", "$", "-", "_", "(", "[", "<", "\\", '"', "~", "日本", "ǅ", "ʰ", "̈", "😀", "\x00", " ", "Ġ", "Ċ", "<|endoftext|>"]


def _coder():
    return token_output.PieceEncoder(public_tokenizers.path(token_output.TOKENIZER))


def test_ids_are_those_of_the_library():
    coder, rng = _coder(), random.Random(5)
    for _ in range(200):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(40)] + [None, ""]
        values, counts = coder.encode(pa.array(texts, pa.string()))
        want = [e.ids for e in coder.tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        assert [x.tolist() for x in np.split(values, np.cumsum(counts)[:-1])] == want


def test_letters_are_encoded_once(monkeypatch):
    coder, seen = _coder(), []
    ids = coder._ids
    monkeypatch.setattr(coder, "_ids", lambda texts: seen.extend(texts) or ids(texts))
    words, marks = ["alpha", "beta", "gamma", "delta"], ["", ".", "&&&", ",***", "!$$$", "###"]
    texts = [f"a {x}{m}\n{y}{n} b" for x in words for y in words for m in marks for n in marks]
    values, _ = coder.encode(pa.array(texts))
    assert values.tolist() == [i for e in coder.tok.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids]
    assert sum(t.count("alpha") for t in seen) == 2  # after a space and after a line break
