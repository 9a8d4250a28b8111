"""The registered queries of the operators, one per operator, over whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import byte_bpe
from cohortlens.llm.decontaminate import benchmark_matches
from cohortlens.llm.importance import resample
from cohortlens.llm.language_id import fit_languages, with_languages
from cohortlens.llm.license_scan import license_matches
from cohortlens.llm.line_dedup import dedup_lines
from cohortlens.llm.merkle import with_edits
from cohortlens.llm.ngram_jaccard import ngram_classes
from cohortlens.llm.sentencepieces import with_round_trip
from cohortlens.llm.suffix_tree import fit_suffix_tree, score_texts
from cohortlens.llm.shared import crc_remainder
from cohortlens.llm.warc import index_archive, lookup, record_urls, write_archive
from cohortlens.llm.toxicity import fit_severity, with_severity
from cohortlens.llm.vector_codes import with_codes, with_group_error


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exactly or nearly, with the place of the best window."""
    return benchmark_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC records, index them, and fetch them by their URLs through the directory of the index."""
    pages = _table(spark, sf_dir, "pages")
    archive = index_archive(spark, write_archive(pages))
    found = lookup(spark, archive, record_urls(pages), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity, grade and probability of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_severity(docs, _table(spark, sf_dir, "labels"))
    return with_severity(docs, model).drop("text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many of them go, and the digest of the rest."""
    kept = dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, of the text with its last third replaced, and how alike they are."""
    return with_edits(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next", F.size("edited_at").alias("edited_paragraphs"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence rules that match in the documents."""
    return license_matches(_table(spark, sf_dir, "documents"))


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and suffix-tree log10 probabilities of every whole text; a seventh of the documents is held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_remainder(F.col("doc_id"), 7) == 2
    tree, counts = fit_suffix_tree(docs.where(~held_out))
    return score_texts(docs, tree, counts).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(tree.tokens).cast("bigint").alias("train_tokens"),
        "base_score", "score",
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text, learned from four fifths of the documents."""
    docs = _table(spark, sf_dir, "documents")
    learned = crc_remainder(F.col("doc_id"), 5)
    model = fit_languages(docs.select("doc_id", "lang", "text").where(learned != 0))
    return with_languages(docs.select("doc_id", "text"), model).select(
        "doc_id", (learned == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted"
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text again."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_round_trip(docs).select("doc_id", "n_tokens", "token_ids", "round_trip")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the size of its set of 3-word shingles and the component it is linked to at a Jaccard of 0.9."""
    return ngram_classes(_table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the benchmark, and the ranks of the twentieth that is drawn."""
    drawn = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text and of the bytes they decode to."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.with_round_trip(docs, ranks, public_tokenizers.PATTERN).select(
        "doc_id", "n_tokens", F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all usable vectors, their errors, and the digest of the codebooks."""
    coded, books = with_codes(_table(spark, sf_dir, "embeddings"))
    return with_group_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_fingerprints": op5_fingerprints,
    "op6_licenses": op6_licenses,
    "op7_suffix_tree": op7_suffix_tree,
    "op8_language_id": op8_language_id,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_importance": op11_importance,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_vector_codes": op13_vector_codes,
}


def _nibble_crcs() -> str:
    """The CRC register after four bits, for each value of them."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return str(table)


def _codebook_sql(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """One pair of steps per round: nearest entries, then floors of means; unused entries stay."""
    nearest = """a{i} AS MATERIALIZED (
  SELECT vec_id, label, part, c, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT p.vec_id, p.label, p.part, p.c, b.e,
      list_sum(list_transform(list_zip(p.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM p JOIN b{i} b USING (part))
  GROUP BY ALL)"""
    means = """b{j} AS MATERIALIZED (
  SELECT b.part, b.e, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN (
    SELECT part, e, list(floor_mean ORDER BY pos) AS c FROM (
      SELECT part, best.e AS e, pos, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_mean
      FROM (SELECT part, best, unnest(c) AS x, unnest(range(len(c))) AS pos FROM a{i}) GROUP BY ALL)
    GROUP BY ALL) m ON m.part = b.part AND m.e = b.e)"""
    steps = [step.format(i=i, j=i + 1) for i in range(rounds) for step in (nearest, means)]
    steps.append(nearest.format(i=rounds))
    return f"""
WITH k AS (
  SELECT vec_id, label, [floor(x::DOUBLE * 4096)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (
  SELECT vec_id, label, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS c FROM k, range({parts}) r(part)),
b0 AS MATERIALIZED (
  SELECT part, e, c FROM (SELECT part, c, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM p)
  WHERE e < {entries}),
{", ".join(steps)},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
  FROM a{rounds} GROUP BY vec_id, label),
books AS (
  SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, e, pos)) AS codebooks_sha256
  FROM (SELECT part, e, unnest(c) AS x, unnest(range(len(c))) AS pos FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, books
"""


ORACLES: dict[str, str] = {
    "op2_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
         list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (5 * (7 - i % 8))) & 31) + 1)::INT, 1)
           FOR i IN range(0, 32)], 'string_agg', '') AS payload_digest
  FROM p),
k AS (SELECT payload_digest, payload_bytes, max(page_id) AS keeper FROM d GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d JOIN k USING (payload_digest, payload_bytes)
""",
    "op4_line_dedup": r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
pos AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs),
lines AS (
  SELECT doc_id, i, lines[i] AS line,
         translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM pos),
common AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.doc_id, l.i, l.line, c.k IS NOT NULL AND l.doc_id < c.keeper AS gone FROM lines l LEFT JOIN common c USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op5_fingerprints": r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
pairs AS (
  SELECT doc_id, t, n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nt FROM docs),
edits AS (SELECT doc_id, t, n, nt, substr(t, 1, n - n // 3) || substr(nt, 1, n // 3) AS e FROM pairs),
paras AS (
  SELECT doc_id, n, e, nt, t, [sha256(p) FOR p IN string_split(t, chr(10))] AS d,
         [sha256(p) FOR p IN string_split(e, chr(10))] AS ed FROM edits),
sects AS (
  SELECT *, [sha256(s) FOR s IN string_split(array_to_string([x || CASE WHEN x[1] IN ('0', '1') THEN '|' ELSE ' ' END FOR x IN d], ''), '|') IF s <> ''] AS s,
         [sha256(s) FOR s IN string_split(array_to_string([x || CASE WHEN x[1] IN ('0', '1') THEN '|' ELSE ' ' END FOR x IN ed], ''), '|') IF s <> ''] AS es
  FROM paras),
pieces AS (
  SELECT *, list_distinct(flatten([regexp_extract_all(p, '(?s).{1,40}[^ \t\n\x0B\f\r]*[ \t\n\x0B\f\r]*') FOR p IN string_split(t, chr(10))])) AS a,
         list_distinct(flatten([regexp_extract_all(p, '(?s).{1,40}[^ \t\n\x0B\f\r]*[ \t\n\x0B\f\r]*') FOR p IN string_split(e, chr(10))])) AS b,
         list_distinct(flatten([regexp_extract_all(p, '(?s).{1,40}[^ \t\n\x0B\f\r]*[ \t\n\x0B\f\r]*') FOR p IN string_split(nt, chr(10))])) AS c
  FROM sects)
SELECT doc_id, n::BIGINT AS n_chars, sha256(e) AS edited_sha256, sha256(array_to_string(s, ' ')) AS fingerprint,
       sha256(array_to_string(es, ' ')) AS edited_fingerprint,
       CASE WHEN greatest(len(a), len(b)) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / greatest(len(a), len(b)) END AS near_edited,
       CASE WHEN greatest(len(a), len(c)) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, c))::DOUBLE / greatest(len(a), len(c)) END AS near_next,
       CASE WHEN s = es THEN 0 ELSE len([x FOR x IN ed IF NOT list_contains(d, x)]) END::INT AS edited_paragraphs
FROM pieces
""",
    "op10_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END)) AS g FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n, bit_xor(hash(g)) AS h FROM grams GROUP BY doc_id),
classes AS MATERIALIZED (SELECT n, h, min(doc_id) AS rep FROM sizes GROUP BY n, h),
reps AS MATERIALIZED (SELECT c.rep AS doc_id, c.n FROM classes c),
few AS MATERIALIZED (SELECT g FROM grams SEMI JOIN reps USING (doc_id) GROUP BY g HAVING count(*) > 1),
kept AS MATERIALIZED (SELECT doc_id, g FROM grams SEMI JOIN reps USING (doc_id) SEMI JOIN few USING (g)),
common AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM kept a JOIN kept b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN reps x ON x.doc_id = a JOIN reps y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS other FROM reps
  UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
parts AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(c.rep, d.doc_id) AS class_id,
       coalesce(p.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN classes c USING (n, h) LEFT JOIN parts p ON p.node = c.rep
""",
    "op11_importance": rf"""
WITH texts AS (
  SELECT kind, id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS t FROM documents
        UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark)),
runs AS MATERIALIZED (
  SELECT kind, id, array_to_string(w[i : i + n - 1], ' ') AS f
  FROM (SELECT kind, id, w, unnest(range(1, len(w) + 1)) AS i FROM texts), range(1, 4) r(n) WHERE i + n - 1 <= len(w)),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM runs)),
crcs AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_transform(range(len(h)), lambda i: (instr('0123456789ABCDEF', substr(h, xor(i, 1) + 1, 1)) - 1)::BIGINT),
    lambda c, b: xor(c >> 4, {_nibble_crcs()}[(xor(c, b) & 15) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM hexed),
spread AS MATERIALIZED (SELECT kind, id, bucket FROM runs JOIN crcs USING (f)),
counts AS (
  SELECT b AS bucket, count(*) FILTER (WHERE kind = 'd') AS s, count(*) FILTER (WHERE kind = 'b') AS t
  FROM range(10000) r(b) LEFT JOIN spread ON bucket = b GROUP BY b),
gains AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000)::DOUBLE
    / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
weights AS (SELECT id, sum(gain)::BIGINT AS weight FROM spread JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(w) AS n, greatest(len(w), 0) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS n_features,
    coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (id) WHERE kind = 'd'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n >= 20) OVER () AS longs
  FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
  CASE WHEN n >= 20 AND place <= 5 * longs // 100 THEN place END::BIGINT AS rank FROM ranked
""",
    "op13_vector_codes": _codebook_sql(),
}
