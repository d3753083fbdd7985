"""Which runs the secret network reads, learns from and finds."""

import hashlib
import random
import re
import string

import numpy as np
import pyarrow.parquet as pq
import pytest

from webstrata.llm import secrets
from webstrata.llm.queries import op5_secret_scan

SF_DIR = "/root/testdata/sf0.001"
MIXED = string.ascii_letters + string.digits


@pytest.fixture(scope="module")
def network(spark):
    return secrets.fit(spark.read.parquet(f"{SF_DIR}/documents.parquet"))


def found(network, text):
    spans = secrets.find_all([text], np.array([True]), network)[0]
    return [text[b:e] for b, e, kind in spans if kind == "cnn"]


def test_what_looks_random():
    assert secrets.looks_random("a8Kd9sLq2Xz1") and secrets.looks_random("sk_QxWzRtPlKmNbVcXz")
    for word in ("Donaudampfschiff", "INTERNATIONALISATION", "self-contained-unit", "chapter-2024-one"):
        assert not secrets.looks_random(word)


def test_keys_of_other_formats_get_no_label():
    key = "Zk3" * 6
    codes, labels = secrets._labelled(f"internationalisation {key} password=abcdefgh1234 123456789012345")
    inside = [bytes(c & 127 for c in w[secrets.LEFT:secrets.LEFT + secrets.INSIDE] if c).decode()
              for w in codes]
    assert sorted(zip(labels, inside)) == [(0, "internationalisation"), (1, "abcdefgh1234")]
    # A run around a base span is neither.
    assert secrets._labelled(f"AKIA{'Q7' * 9}-rest-of-the-words")[1] == [1]


def test_keys_the_patterns_do_not_know(network):
    choose = random.Random(4)
    formats = {
        "letters": lambda: "sk_live_" + "".join(choose.choices(string.ascii_letters, k=30)),
        "mixed": lambda: "".join(choose.choices(MIXED, k=24)),
        "short": lambda: "".join(choose.choices(MIXED, k=15)),
        "dashed": lambda: "glpat-" + "".join(choose.choices(MIXED, k=20)),
        "web": lambda: "eyJ" + "".join(choose.choices(MIXED + "-_", k=90))}
    for name, draw in formats.items():
        keys = [draw() for _ in range(60)]
        hits = sum(found(network, f"the ver ion {key} que ment") == [key] for key in keys)
        assert hits >= 0.85 * len(keys), name


def test_runs_around_base_spans_are_hidden_whole(network):
    key = f"AKIA{'Q7' * 9}-restOfTheToken99887766554433"
    spans = secrets.find_all([f"see {key} end"], np.array([True]), network)[0]
    assert [kind for _, _, kind in spans] == ["access", "cnn"]
    assert secrets.redact(f"see {key} end", spans) == "see [SECRET] end"


def test_words_of_documents_stay(network):
    texts = pq.read_table(f"{SF_DIR}/documents.parquet").column("text").to_pylist()
    runs = hits = 0
    for text in texts:
        text = text or ""
        runs += len(secrets.candidates(text, secrets.base_spans(text)))
        hits += len(found(network, text))
    assert runs > 500 and hits < 0.01 * runs


def test_query_against_brute_force(spark):
    """Base columns by plain patterns over every text; other spans are whole runs beside them."""
    kinds = [("assign", secrets.ASSIGN, lambda m: len(m[2]) >= 12),
             ("access", secrets.ACCESS, lambda m: len(m[0]) >= 18),
             ("hex", secrets.HEX, lambda m: len(m[0]) >= 16)]
    docs = pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist()
    rows = {r["doc_id"]: r for r in op5_secret_scan(spark, SF_DIR).collect()}
    assert len(rows) == len(docs)
    for doc in docs:
        text, row = doc["text"] or "", rows[doc["doc_id"]]
        base = sorted((m.start(), at, m.end(), kind) for at, (kind, pattern, long) in enumerate(kinds)
                      for m in pattern.finditer(text) if long(m))
        line = ",".join(f"{kind}:{begin}:{end}" for begin, _, end, kind in base)
        assert row["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [
            sum(k == kind for *_, k in base) for kind in ("assign", "access", "hex")]
        spans = row["spans"].split(",") if row["spans"] else []
        assert [s for s in spans if not s.startswith("cnn")] == (line.split(",") if line else [])
        whole = {f"cnn:{m.start()}:{m.end()}" for m in re.finditer("[A-Za-z0-9+/_=-]{12,}", text)}
        assert {s for s in spans if s.startswith("cnn")} <= whole
