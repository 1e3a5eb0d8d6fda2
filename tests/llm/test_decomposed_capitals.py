"""Words whose capitals have no composite with the mark behind them."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from loomtrace.llm import token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")

PAIRS = ("H\u0331", "T\u0308", "W\u030a", "Y\u030a", "J\u030c")


def test_decomposed_capitals_are_left_to_the_tokenizer():
    encoder = token_files.WordEncoder(WORDS)
    texts = [f"{x} {x}amza, {x.lower()}amza MA{x}B! État PLAIN" for x in PAIRS]
    ids, counts = encoder.encode(pa.array(texts))
    for text, part in zip(texts, np.split(ids, np.cumsum(counts))):
        assert part.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
