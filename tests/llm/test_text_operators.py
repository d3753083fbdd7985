"""Operators on texts: brute force, edge cases, round trips."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from webstrata.llm import minhash, packing, quality, secrets, sentencepiece, substrings, toxicity
from webstrata.llm.encoder import encoder
from webstrata.llm.tokenfiles import EliasFano, read_token_files, write_token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(3000))
SHARED = " ".join(f"shared{i}" for i in range(40))
ROWS = [
    (1, "One two three four five six seven eight nine ten", 9),
    (2, None, 9), (3, "", 9), (4, " \t\n ", 9), (5, LONG, 9), (6, "x " + SHARED + " y", 9),
    (7, "z\n" + SHARED, 9), (8, SHARED, 9), (8, SHARED, 9), (None, "no id here, only words", 9),
    (10, LONG + " end", 9), (11, "é ü 日本語 \U0001d11e tail tail", 9), (12, "word", 9),
    (13, " ".join(["again"] * 30), 9),
]
PLAIN = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def docs(spark):
    # n_words, kept, spans and score clash with outputs.
    return spark.createDataFrame(
        [(*r, "old", "old", False) for r in ROWS],
        "doc_id bigint, text string, n_words bigint, spans string, kept_text string, "
        "kept boolean")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id = -1")


def repeats_by_hand(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - window + 1)
                if seen[tuple(w[i:i + window])] > 1 for k in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("window,chunk,buckets", [(35, 1 << 22, None), (3, 200, 5), (1, 50, 300)])
def test_substrings(docs, window, chunk, buckets):
    got = substrings.remove_repeats(docs, window, chunk, buckets)
    assert got.columns.count("n_words") == 1 and "spans" in got.columns
    want = Counter((d, *r) for (d, _, _), r in zip(ROWS, repeats_by_hand(
        [t for _, t, _ in ROWS], window)))
    assert Counter(tuple(r) for r in got.select(
        "doc_id", "n_words", "n_removed", "kept_text").collect()) == want


def test_empty_tables(spark, none):
    assert substrings.remove_repeats(none).count() == 0
    assert quality.apply_rules(none).count() == 0
    assert minhash.link(none).count() == 0
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    network = secrets.fit(none)
    assert secrets.scan(none, network).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit(none, labels)
    assert toxicity.score(none, model).count() == 0
    assert sentencepiece.encode_texts(
        none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def shingles(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < size:
        return {tuple(words)}
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def linked_by_hand(texts, size, percent):
    sets = {d: shingles(t, size) for d, t in texts}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_minhash(spark):
    random = np.random.default_rng(1)
    texts = [(i, " ".join(random.choice(["ab", "cd", "ef", "gh"], 12))) for i in range(30)]
    base = [f"t{i}" for i in range(120)]
    for i in range(30, 90):  # one large group of near copies
        copy = list(base)
        for place in random.choice(120, int(random.integers(1, 9)), replace=False):
            copy[place] = f"other{i}{place}"
        texts.append((i, " ".join(copy)))
    texts += [(90, texts[40][1].upper()), (91, ""), (92, "solo"), (93, "Solo"), (94, LONG)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.link(
        spark.createDataFrame(texts, PLAIN), size=2).collect()}
    assert got == linked_by_hand(texts, 2, 80)


def test_minhash_edges(docs):
    rows = minhash.link(docs).collect()
    assert len(rows) == len(ROWS)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[None]["kept"] and by_id[None]["component_id"] is None
    assert by_id[2]["kept"] and by_id[3]["kept"] and by_id[2]["n_shingles"] == 0
    assert by_id[7]["component_id"] == 6 and not by_id[8]["kept"]
    assert by_id[10]["component_id"] == 5 and by_id[12]["n_shingles"] == 1


def test_estimate_is_unbiased():
    random = np.random.default_rng(2)
    pool = random.integers(0, 1 << 63, 3000).astype(np.uint64)
    left, right = np.unique(pool[:2000]), np.unique(pool[500:2500])
    sets = np.concatenate([left, right])
    _, planes = minhash.signatures(sets, np.array([len(left), len(sets)]))
    words = planes.reshape(2, minhash.BITS, -1).view(np.uint64)
    assert abs(minhash.estimate(words[0], words[1]) - 0.6) < 0.2


def test_quality(docs):
    rows = {r["doc_id"]: r for r in quality.apply_rules(docs).collect()}
    for doc_id, text, _ in ROWS:
        words, row = WORD.findall(text or ""), rows[doc_id]
        wins = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        twice = {i + k for i in range(len(words) - 7) if wins[tuple(words[i:i + 8])] > 1
                 for k in range(8)}
        assert row["n_words"] == len(words)
        assert row["word_chars"] == sum(map(len, words))
        assert row["n_repeat_words"] == len(twice)
        failed = len(words) < 20 or 100 * len(twice) > 30 * len(words)
        assert row["base_failed"] == failed and not (failed and row["kept"])


def test_candidates_are_all_runs_no_span_covers():
    runs = ["deadbeef" * 3, "user-name-2024-abcdefgh", "x" * 20, "AKIA" + "Q7" * 9, "a1" * 8 + "Z"]
    text = " ".join(runs[i * 7 % 5] + ("=" if i % 3 else "é") for i in range(60))
    spans = secrets.base_spans(text)
    want = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_=-]{12,}", text)
            if not any(b <= m.start() and m.end() <= e for b, e, _ in spans)]
    assert spans and want and secrets.candidates(text, spans) == want
    assert {text[b:e].rstrip("=") for b, e in want} >= {"x" * 20, "a1" * 8 + "Z"}
    around = f"{'AKIA' + 'Q7' * 9}-restOfTheToken99"
    assert secrets.candidates(around, secrets.base_spans(around)) == [(0, len(around))]


def test_secrets(spark):
    key = "AKIA" + "Q7" * 9
    texts = [(1, f'é password: "abcdefghijkl" and {key} end'), (2, None), (3, "a" * 16 + " token=short"),
             (4, "ſecret = 123456789012"), (5, "API_KEY=x.y-z/123+abc=="), (6, "plain words")]
    network = secrets.fit(spark.createDataFrame(texts, PLAIN))
    rows = {r["doc_id"]: r for r in secrets.scan(
        spark.createDataFrame(texts, PLAIN), network).collect()}
    assert rows[1]["spans"].split(",")[0] == "assign:2:25"
    assert rows[1]["redacted"] == "é [SECRET]\" and [SECRET] end"
    assert (rows[1]["n_assign"], rows[1]["n_access"], rows[1]["n_hex"]) == (1, 1, 0)
    assert rows[2]["spans"] == "" and rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (rows[3]["n_assign"], rows[3]["n_hex"]) == (0, 1)
    assert rows[4]["n_assign"] == 0 and rows[4]["n_hex"] == 0
    assert rows[5]["n_assign"] == 1 and rows[6]["redacted"] == "plain words"


def test_secret_network_tells_drawn_findings():
    drawn = secrets._drawn(np.random.default_rng(3), 1200)
    codes = [(w, label) for t, b, e, label in drawn for w in secrets.windows(t, b, e)]
    data, truth = np.array([c for c, _ in codes]), np.array([y for _, y in codes])
    network = secrets.train(data[:1000], truth[:1000])
    said = network.probabilities(data[1000:]) >= network.threshold
    assert said[truth[1000:] > 0].mean() > 0.85
    assert said[truth[1000:] == 0].mean() < 0.15


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder(name):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    texts = [t or "" for _, t, _ in ROWS] + [
        "  a", "a  b", "a\n\nb\n", " a", "a ", "a \n b", "a\tb c", "a\t\n b", "don't I'll",
        "<|endoftext|> x<|endoftext|>y", "é ́x", "ΑΣ ΣΑΣ", "fin.\nNext 's", "\n", "A.B,c"]
    own = encoder(public_tokenizers.path(name))
    for text, ids in zip(texts, own.encode(texts)):
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, own.dtype).tolist() == want, repr(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_letters_that_lower_to_more_than_letters(name):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    texts = ["İstanbul", "İstanbul.", "a İ, bİ", "DİYARBAKIR İzmir!", "aİ. b", "İİ", "x\nİ\ny"]
    own = encoder(public_tokenizers.path(name))
    for text, ids in zip(texts, own.encode(texts)):
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, own.dtype).tolist() == want, repr(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_special_tokens_inside_texts_keep_their_ids(spark, folder, name):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> y<|endoftext|>.",
             "a\n<|endoftext|>\nb", "<|startoftext|> İ <|ENDOFTEXT|>", " <|endoftext|>  a"]
    docs = spark.createDataFrame(list(enumerate(texts)), PLAIN)
    want = {i: plain.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    packed = packing.pack(docs, public_tokenizers.path(name), with_ids=True)
    write_token_files(docs, f"file://{folder}/ids", public_tokenizers.path(name))
    filed = read_token_files(spark, f"file://{folder}/ids")
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packed.collect()} == want
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in filed.collect()} == {
        i: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in want.items()}


def test_packing(docs):
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=64,
                        group_docs=4, with_ids=True).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((d, i, x) for d, t, _ in ROWS for i, x in enumerate(
        [*plain.encode(t or "", add_special_tokens=False).ids, 2]))
    got, places = Counter(), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        got.update((r["doc_id"], r["start"] + k, int(x)) for k, x in enumerate(ids))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64


def test_first_fit_decreasing_matches_a_scan():
    lengths = np.random.default_rng(4).integers(1, 100, 300)
    sequences, _ = packing.first_fit_decreasing(lengths, 100)
    rooms: list[int] = []
    for piece in np.argsort(-lengths, kind="stable"):
        at = next((i for i, r in enumerate(rooms) if r >= lengths[piece]), len(rooms))
        if at == len(rooms):
            rooms.append(100)
        rooms[at] -= lengths[piece]
        assert sequences[piece] == at


@pytest.mark.parametrize("values", [
    [0], [5], [0, 0, 0], list(range(1000)), [3, 3, 900, 1 << 40], [1 << 63] * 3,
    np.sort(np.random.default_rng(5).integers(0, 1 << 45, 2000)).tolist()])
def test_elias_fano(values):
    packed = EliasFano.from_bytes(EliasFano.encode(np.array(values, np.uint64)).to_bytes())
    assert [packed.select(i) for i in range(len(values))] == values
    assert packed.values(0, len(values)).tolist() == values
    assert packed.values(1, len(values)).tolist() == values[1:]


def test_token_files(spark, docs, none, folder):
    path, name = f"file://{folder}/ids", public_tokenizers.path("byte_bpe_50k.json")
    write_token_files(docs, path, name)
    plain = Tokenizer.from_file(name)
    rows = sorted(read_token_files(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, *sorted(d for d, _, _ in ROWS if d is not None)]
    texts, at = defaultdict(list), 0
    for d, t, _ in ROWS:
        texts[d].append([*plain.encode(t or "", add_special_tokens=False).ids, 2])
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids in texts[r["doc_id"]] and r["start"] == at and r["n_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(r["ids"])
        at += len(ids)
    write_token_files(none, f"file://{folder}/none", name)
    assert read_token_files(spark, f"file://{folder}/none").count() == 0


def test_sentencepiece_against_brute_force():
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab", "c"]
    scores = [0, -3.0, -2.0, -2.5, -3.0, -2.5, -4.0, -4.5, -5.0, -6.0]
    model = sentencepiece.Unigram(pieces, scores, {}, {0})

    def best(text):
        if not text:
            return 0.0
        return max([scores[i] + best(text[len(p):]) for i, p in enumerate(pieces)
                    if i and text.startswith(p)] or [-1e9])

    random = np.random.default_rng(6)
    for _ in range(100):
        text = "".join(random.choice(list("abc  "), 9))
        ids = np.frombuffer(model.encode(text), model.dtype)
        assert "".join(pieces[i] for i in ids) == "▁" + text.replace(" ", "▁")
        assert abs(sum(scores[i] for i in ids) - best("▁" + text.replace(" ", "▁"))) < 1e-9
        assert model.decode(model.encode(text)) == text


def test_sentencepiece_round_trip(docs):
    rows = sentencepiece.encode_texts(
        docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True).collect()
    assert len(rows) == len(ROWS) and all(r["decoded_same"] for r in rows)
    model = sentencepiece.model_of(public_tokenizers.path("piece_bpe_32k.model"))
    broken = np.array([model.byte_ids[0xE2], model.byte_ids[0x41]], model.dtype).tobytes()
    assert model.decode(broken) == "�A"


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = (toxicity.score(docs, model, ["doc_id"]).join(labels, "doc_id")
            .where(toxicity.held_out(labels["doc_id"])).select("score", "predicted", "toxic")
            .collect())
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert sum(toxic) / len(toxic) > 0.75 and sum(clean) / len(clean) < 0.05
    assert 0 <= model.score("") < 0.5 and model.score(None) == model.score("")
