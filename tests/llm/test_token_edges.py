import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mnemolake.llm.tokens import WordTokenizer


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_random_texts_equal_a_fresh_library(name):
    path = public_tokenizers.path(name)
    rng = random.Random(7)
    parts = ["\n", "\n\n", " ", "  ", "\t", "a", "the", "Word", "é", "ü", "é", "!", "...", "'s", "7", "42", "\u00a0", "\r\n", "<|endoftext|>", "-", "\u3000", "ß"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(8))) for _ in range(100_000)] + ["a\n\n", "\n\n", "a\n", "\n", "a \n\n", "a\n\n\n", "x\n\ny\n\n"]
    ids, counts = WordTokenizer(path).encode(pa.array(texts))
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want]
    assert (ids == np.array([i for w in want for i in w], np.uint32)).all()
