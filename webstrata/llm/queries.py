"""One query per operator, over whole tables, and the SQL that checks it where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm import secrets
from webstrata.llm.alignment import align
from webstrata.llm.archive import read_archive, write_archive
from webstrata.llm.embeddings import link_vectors
from webstrata.llm.merkle import COLUMNS, build_manifest, leaf_digest, prove
from webstrata.llm.minhash import link
from webstrata.llm.mixing import mix
from webstrata.llm.packing import pack
from webstrata.llm.quality import STOP_WORDS, apply_rules
from webstrata.llm.sentencepiece import encode_texts
from webstrata.llm.substrings import remove_repeats
from webstrata.llm.tokenfiles import read_token_files, write_token_files
from webstrata.llm.toxicity import fit, held_out, score
from webstrata.session import work_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs, secrets.fit(docs), keep=["doc_id"]).drop("redacted")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, keep=["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), work_path(spark, "token-files")
    write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "archive")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"),
                 public_tokenizers.path("piece_bpe_32k.model"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    bare = [F.replace(c, F.lit("\n"), F.lit("")) if name == "text" else c
            for name, c in ((name, F.col(name)) for name in COLUMNS)]
    # Kept where tampering changes the leaf.
    tampered = F.when(chosen & F.contains(F.col("text"), F.lit("\n")), leaf_digest(bare))
    manifest = build_manifest(docs, carry={"tampered": tampered})
    return prove(manifest, shown="tampered").select(
        F.col("order").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        "verified")


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_toxicity": op8_toxicity,
    "op9_token_files": op9_token_files,
    "op10_warc": op10_warc,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_source_mix": op13_source_mix,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_STOP = ", ".join(f"'{form}'" for form in sorted(
    {f for line in STOP_WORDS for w in line.split() for f in (w, w.capitalize())}))


# crc32(text) mod 2, bit by bit, of the decimal doc_id.
_CRC_ODD = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(
    string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda t: 0::UBIGINT)),
    lambda r, t: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END)),
  4294967295::UBIGINT) % 2"""
_FIELDS = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
                      for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
_SOURCE_LEVELS, _FOREST_LEVELS = 14, 8  # up to 3**14 documents a source, 3**8 sources


def _merkle_levels(name: str, levels: int) -> str:
    """Levels of trees over ``name``_0 (tree, i, n, h), with each node's siblings on both sides."""
    steps = []
    for k in range(levels):
        steps.append(f"""{name}s_{k} AS (
  SELECT *, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER l, '') ELSE '' END AS lefts,
         CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER r, '') ELSE '' END AS rights
  FROM {name}_{k} WINDOW
    l AS (PARTITION BY tree, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    r AS (PARTITION BY tree, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
{name}_{k + 1} AS (
  SELECT tree, i // 3 AS i, (max(n) + 2) // 3 AS n,
         CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY {name}_{k}.i)) ELSE max(h) END AS h
  FROM {name}_{k} GROUP BY tree, {name}_{k}.i // 3)""")
    return ",\n".join(steps)


def _merkle_sql() -> str:
    joins, lefts = [], []
    for name, levels, tree, place in (("s", _SOURCE_LEVELS, "x.tree", "x.i"),
                                      ("f", _FOREST_LEVELS, "''", "g.i")):
        for k in range(levels):
            joins.append(f"JOIN {name}s_{k} {name}{k} ON {name}{k}.tree = {tree} "
                         f"AND {name}{k}.i = {place} // {3 ** k}")
            lefts.append(f"{name}{k}")
    folds, before = [], "start"
    for number, part in enumerate(lefts):
        folds.append(f"fold_{number} AS (SELECT * REPLACE (CASE WHEN n_{part} > 1 THEN "
                     f"sha256(l_{part} || fold || r_{part}) ELSE fold END AS fold) FROM {before})")
        before = f"fold_{number}"
    columns = ", ".join(f"{p}.n AS n_{p}, {p}.lefts AS l_{p}, {p}.rights AS r_{p}" for p in lefts)
    proof = " || ".join(f"{p}.lefts || {p}.rights" for p in lefts)
    text = _FIELDS.format(text="text")
    bare = _FIELDS.format(text="CASE WHEN odd = 0 THEN replace(text, chr(10), '') ELSE text END")
    return f"""
WITH d AS (SELECT *, coalesce('=' || source, '') AS tree, {_CRC_ODD} AS odd FROM documents),
x AS (
  SELECT doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY tree) AS n, leaf, shown
  FROM (SELECT doc_id, tree, sha256({text}) AS leaf, sha256({bare}) AS shown FROM d)),
s_0 AS (SELECT tree, i, n, leaf AS h FROM x),
{_merkle_levels("s", _SOURCE_LEVELS)},
g AS (SELECT tree AS source_tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i,
             count(*) OVER () AS n FROM s_{_SOURCE_LEVELS}),
f_0 AS (SELECT '' AS tree, i, n, subroot AS h FROM g),
{_merkle_levels("f", _FOREST_LEVELS)},
start AS (
  SELECT x.doc_id, x.leaf, g.subroot, top.h AS root, sha256({proof}) AS proof_sha256,
         x.shown AS fold, {columns}
  FROM x JOIN g ON g.source_tree = x.tree CROSS JOIN f_{_FOREST_LEVELS} top
  {" ".join(joins)}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, proof_sha256, fold AS folded_root, fold = root AS verified
FROM {before}"""


ORACLES = {
    "op2_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
w AS (
  SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM d)),
r AS (SELECT win FROM w GROUP BY win HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM w SEMI JOIN r USING (win)),
k AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS kept
  FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d) x
  ANTI JOIN c USING (doc_id, i) GROUP BY x.doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words,
       (SELECT count(*) FROM c WHERE c.doc_id = d.doc_id)::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
walk AS (
  SELECT vec_id AS id, vec_id AS seen FROM embeddings
  UNION SELECT walk.id, e.b FROM walk JOIN e ON e.a = walk.seen)
SELECT vec_id, (SELECT count(*) FROM e WHERE e.a = m.vec_id)::BIGINT AS n_links, component_id,
       component_id = vec_id AS kept
FROM (SELECT id AS vec_id, min(seen) AS component_id FROM walk GROUP BY id) m""",
    "op4_minhash_dedup": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, words[i] || ' ' || words[i + 1] AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, len(words))) AS i FROM d)
  UNION SELECT doc_id, words[1] FROM d WHERE len(words) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
ends AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
walk AS (
  SELECT doc_id AS id, doc_id AS seen FROM documents
  UNION SELECT walk.id, ends.b FROM walk JOIN ends ON ends.a = walk.seen)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id,
       c.component_id = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT id AS doc_id, min(seen) AS component_id FROM walk GROUP BY id) c USING (doc_id)""",
    "op7_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, {_WORDS} AS words FROM documents),
w AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d)),
r AS (SELECT doc_id, win FROM w GROUP BY doc_id, win HAVING count(*) > 1),
c AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS j FROM w SEMI JOIN r USING (doc_id, win))
  GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words,
         coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         list_filter(string_split(body, chr(10)),
                     lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: x IN (__STOP__)))::BIGINT AS n_stop
  FROM d LEFT JOIN c USING (doc_id)),
v AS (
  SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.3
       AND n_stop / n_words >= 0.01 AND n_dup_lines / greatest(len(lines), 1) <= 0.5 AS kept
FROM v""".replace("__STOP__", _STOP),
    "op10_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
g AS (
  SELECT payload_digest, max(page_id) AS first_id FROM p
  WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN g.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.first_id <> p.page_id THEN g.first_id END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)""",
    "op12_merkle_manifest": _merkle_sql(),
    "op13_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, '~') AS source_key, md5(coalesce(text, '')) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS packed,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
q AS (
  SELECT *, 0.05::DOUBLE + 0.95::DOUBLE
           * (length(packed) - length(regexp_replace(packed, '\p{L}+', '', 'g')))
           / greatest(length(packed), 1) * len(list_distinct(lines)) / len(lines) AS worth,
         md5('13;' || coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-')
             || length(source_key) || ':' || source_key || '32:' || digest) AS drawn
  FROM d),
k AS (
  SELECT *, -ln((('0x' || substring(drawn, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
            / worth AS draw FROM q),
s AS (
  SELECT source_key, sum(size)::BIGINT AS source_size, (2 * sum(size))::DOUBLE AS cap,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source_key) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source_key),
o AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS total,
         coalesce(sum(cap) OVER f, 0) AS held, sum(weight) OVER b AS left_weight, cap / weight AS ratio
  FROM s WINDOW
    f AS (ORDER BY cap / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    b AS (ORDER BY cap / weight, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (
  SELECT *, least(cap, weight * (SELECT min_by((total - held) / left_weight, ratio) FROM o
    WHERE (total - held) / left_weight <= ratio)) AS target FROM o),
r AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
         coalesce(sum(k.size) OVER (PARTITION BY k.source_key ORDER BY k.draw, k.doc_id, k.digest
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN t USING (source_key))
SELECT doc_id, size, source_size, target, (size * whole + greatest(0, least(size,
  floor(target - whole * source_size)::BIGINT - before)))::BIGINT AS taken
FROM r""",
}
