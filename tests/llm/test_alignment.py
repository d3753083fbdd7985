"""Alignment of two tokenizers against brute force."""

import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from webstrata.llm import alignment
from webstrata.llm.encoder import byte_letters

A_PATH = public_tokenizers.path("byte_bpe_50k.json")
B_PATH = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i}, Käse {i * 7919}" for i in range(20_000))
TEXTS = ["Hello world, this is a test.", None, "", " ", "  two  spaces ", "line\n\nbreak\t x", "日本語テキスト",
         "a▁b", "<|endoftext|> and <s> </s> <unk>", "naïve café \U0001d11e", "\n", "x" * 3000,
         " no break  ", "Hello world, this is a test.", "emoji 👩‍👩‍👧 ok", "tab\x00null",
         "é combining", LONG]


def test_gallop():
    random = np.random.default_rng(1)
    for size, span in ((1, 1), (5, 9), (300, 900), (5000, 6000), (5000, 500_000)):
        long = np.unique(random.integers(0, span, size * 3))
        short = np.unique(np.append(random.integers(0, long[-1] + 1, size), long[-1]))
        assert (alignment.gallop(short, long) == np.searchsorted(long, short)).all()


def by_hand(texts):
    """Every link by comparing byte ranges of all tokens."""
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    byte_of = {c: b for b, c in byte_letters().items()}
    special = {t["content"] for t in json.loads(a.to_str())["added_tokens"]}
    b = SentencePieceProcessor(model_file=B_PATH)

    def bytes_a(i):
        piece = a.id_to_token(i)
        return piece.encode() if piece in special else bytes(byte_of[c] for c in piece)

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for text in texts:
        one = ([], [])
        if text:
            one = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text))
            whole = (" " + text).encode()
            if any(b"".join(map(f, ids)) != whole for f, ids in zip((bytes_a, bytes_b), one)):
                one = ([], [])
        ends = [np.cumsum([0] + [len(f(i)) for i in ids]).tolist()
                for f, ids in zip((bytes_a, bytes_b), one)]
        links, k = [], 0
        for j, i in enumerate(one[0]):  # ranges ascend: tokens that end before are done with
            while k < len(one[1]) and ends[1][k + 1] <= ends[0][j]:
                k += 1
            near = k
            while near < len(one[1]) and ends[1][near] < ends[0][j + 1]:
                links.append((i, one[1][near]))
                near += 1
        common = sorted(set(ends[0][1:]) & set(ends[1][1:]))
        parts, at = [], [0, 0]
        place = [{end: n for n, end in enumerate(side)} for side in ends]
        for end in common:
            halves = []
            for side in (0, 1):
                to = place[side][end]
                halves.append(",".join(map(str, one[side][at[side]:to])))
                at[side] = to
            parts.append("|".join(halves))
        docs.append((one, links, parts))
        counts.update(links)
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = []
    for one, links, parts in docs:
        text = ";".join(parts)
        out.append((len(one[0]), len(one[1]), len(parts), len(links),
                    sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), text))
    return out


@pytest.fixture(scope="module")
def want():
    return by_hand(TEXTS)


@pytest.mark.parametrize("parts", [1, 4])
def test_alignment(spark, want, parts):
    rows = [(i % 5 if i else None, t, "n", 1) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_a string, row int")
    assert want[7][0] == 0 and want[0][0] > 0 and want[-1][0] > 100_000
    got = alignment.align(df.repartition(parts), A_PATH, B_PATH, groups="text")
    assert got.columns == ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best",
                           "count_sum"]
    assert Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"],
                    r["count_sum"], r["groups"]) for r in got.collect()) == Counter(
        (row[0], *w) for row, w in zip(rows, want))
    digest = alignment.align(df, A_PATH, B_PATH).select("doc_id", "groups_sha256", "count_sum")
    assert Counter(map(tuple, digest.collect())) == Counter(
        (row[0], hashlib.sha256(w[6].encode()).hexdigest() if w[0] else "", w[5])
        for row, w in zip(rows, want))


def test_whole_batch_and_packing(want):
    a, b = alignment.sides(A_PATH, B_PATH)
    one = alignment.Aligned(TEXTS, a, b)
    names = alignment._names(a.shown, "|") + alignment._names(b.shown, ";")
    order, starts = one.written()
    assert ["".join(names[i] for i in order[x:y])[:-1] for x, y in zip(starts, starts[1:])] == [
        w[6] for w in want]
    numbers = np.array([0, 3, 70_000, 5, 1 << 31])
    assert (alignment._unpack(alignment._pack(numbers)) == numbers).all()


SPACES = [" ", "\n", "\t", "\r", "\x0b", "\xa0", "\u2003", "\u3000", "\x85", "\u2028", "  ", "\n\n"]


def test_encoders_equal_the_libraries():
    random = np.random.default_rng(5)
    words = ["a", "Word", "don't", "12", "...", "é", "日本", "x" * 2500, "<s>", "<|endoftext|>", "\u0301", "İ"]
    a, b = alignment.sides(A_PATH, B_PATH)
    library_a, library_b = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
    library_a.encode_special_tokens = True
    for _ in range(3000):
        text = "".join(random.choice(words if random.random() < 0.6 else SPACES)
                       for _ in range(random.integers(1, 9)))
        assert a.encode([text])[0].tolist() == library_a.encode(" " + text, add_special_tokens=False).ids
        assert b.encode([text])[0].tolist() == library_b.encode(text)


def test_nothing_to_align(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.align(df, A_PATH, B_PATH).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    rows = alignment.align(none, A_PATH, B_PATH).collect()
    assert [(r["n_a"], r["n_links"], r["count_sum"], r["groups_sha256"]) for r in rows] == [(0, 0, 0, "")] * 2
