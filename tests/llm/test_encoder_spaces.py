"""Token ids of texts with every kind of white space equal the library's."""

import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from webstrata.llm import encoder as encoders
from webstrata.llm.encoder import WordEncoder
from webstrata.llm.tokenfiles import read_token_files, write_token_files

BLANKS = [chr(c) for c in range(sys.maxunicode) if chr(c).isspace()] + ["  ", "\n\n", " ", "\n"] * 6
WORDS = ["a", "Word", "don't", "x1", "...", "é", "é", "İs", "<|endoftext|>", "日本", "​", "ﬁ"]
NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def texts(count, seed=2):
    random = np.random.default_rng(seed)
    return ["".join(random.choice(WORDS if random.random() < 0.5 else BLANKS)
                    for _ in range(random.integers(1, 10))) for _ in range(count)]


@pytest.mark.parametrize("name", NAMES)
def test_ids(name, monkeypatch):
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), WordEncoder(path, specials=True)
    given = texts(6000) + ["Hello world.\n\xa0\nNext part", "end \n\xa0", "\xa0\n\n", "\n"]
    want = [library.encode(t, add_special_tokens=False).ids for t in given]
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(given)] == want
    # A cache that is full again and again gives the same.
    monkeypatch.setattr(encoders, "CACHED_BYTES", 2000)
    small = WordEncoder(path, specials=True)
    assert [np.frombuffer(small.encode([t])[0], own.dtype).tolist() for t in given] == want


def test_token_files(spark, folder):
    given = texts(300, 3) + ["Hello world.\n\xa0\nNext part"]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id bigint, text string").repartition(3)
    path = public_tokenizers.path(NAMES[0])
    write_token_files(df, f"{folder}/t", path)
    library = Tokenizer.from_file(path)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist()
           for r in read_token_files(spark, f"{folder}/t", with_ids=True).collect()}
    assert got == {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(given)}
