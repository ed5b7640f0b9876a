"""Registered queries of the operators, and their checking SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemark.llm import (
    alignment, ann, bpe, decontaminate, divergence, langid, lines, planes, quality, secrets, sharding, simhash,
    tokencount,
)
from pagemark.llm.common import scratch, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op7_decontaminate(spark, sf_dir):
    """Windows of ten words of the benchmark in whole documents."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.find_hits(documents, table(spark, sf_dir, "benchmark"))
    covered = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return hits.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), covered.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (covered > 0).alias("contaminated"),
    )


ORACLE["op7_decontaminate"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), grams AS (
  SELECT DISTINCT item, least(len(words), 10) AS n,
         array_to_string(words[p:p + 9], ' ') AS gram
  FROM items, LATERAL (SELECT unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS p)
  WHERE len(words) > 0
), sizes AS (SELECT DISTINCT n FROM grams),
windows AS (
  SELECT row_id, p, s.n, array_to_string(words[p:p + s.n - 1], ' ') AS gram
  FROM docs, sizes s, LATERAL (SELECT unnest(range(1, len(words) - s.n + 2)) AS p)
), hits AS (
  SELECT row_id, p, w.n, item FROM windows w JOIN grams g ON w.gram = g.gram AND w.n = g.n
), covered AS (
  SELECT row_id, count(DISTINCT q) AS n_hit
  FROM (SELECT DISTINCT row_id, p, n FROM hits),
       LATERAL (SELECT unnest(range(p, p + n)) AS q) GROUP BY row_id
), found AS (
  SELECT row_id, count(DISTINCT item) AS n_items,
         string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY row_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
       coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (row_id) LEFT JOIN found USING (row_id)
"""


@query
def op5_simhash(spark, sf_dir):
    """Near-duplicate groups of whole documents: four-word shingles, four bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query
def op10_byte_bpe(spark, sf_dir):
    """Ids of whole documents, and the bytes that they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(documents, ranks, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(ids, ranks, public_tokenizers.PATTERN).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op6_token_planes(spark, sf_dir):
    """Whole documents as written and read token planes."""
    path = scratch(spark, "token-planes")
    planes.write_planes(
        table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json")
    )
    return planes.read_planes(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query
def op9_sharding(spark, sf_dir):
    """All documents in 16 shards of nearly equal bytes, equal texts together."""
    return sharding.shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op8_line_dedup(spark, sf_dir):
    """Every line of 20 characters or more: the first line of its class, and whether it stays."""
    classes = lines.line_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "line_no", "first_doc_id", "first_line_no", "kept")


# levenshtein counts bytes there, so the letters beyond ASCII become single bytes first
ORACLE["op8_line_dedup"] = """
WITH RECURSIVE places AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, cut[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS cut FROM documents WHERE text IS NOT NULL),
       LATERAL (SELECT unnest(range(1, len(cut) + 1)) AS i)
  WHERE length(cut[i]) >= 20
), texts AS (
  SELECT DISTINCT line, length(line) AS n, translate(line, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü',
         array_to_string([chr(c) FOR c IN [1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 14, 15, 16, 17, 18, 19, 20, 21,
                                           22, 23, 24]], '')) AS t
  FROM places
), near AS (
  SELECT a.line AS a, b.line AS b FROM texts a JOIN texts b ON b.n BETWEEN a.n AND a.n + 2
  WHERE a.line <> b.line AND levenshtein(a.t, b.t) <= 2 AND (
    contains(b.t, substr(a.t, 1, a.n // 3)) OR contains(b.t, substr(a.t, 2 * a.n // 3 + 1))
    OR contains(b.t, substr(a.t, a.n // 3 + 1, 2 * a.n // 3 - a.n // 3)))
), links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (
  SELECT a AS line, a AS other FROM links
  UNION SELECT r.line, l.b FROM reach r JOIN links l ON r.other = l.a
), classes AS (SELECT line, min(other) AS class FROM reach GROUP BY line),
named AS (
  SELECT doc_id, line_no, coalesce(class, line) AS class FROM places LEFT JOIN classes USING (line)
), firsts AS (SELECT class, min({'d': doc_id, 'l': line_no}) AS first FROM named GROUP BY class)
SELECT doc_id, line_no, first.d AS first_doc_id, first.l AS first_line_no,
       first.d = doc_id AND first.l = line_no AS kept
FROM named JOIN firsts USING (class)
"""


@query
def op3_language(spark, sf_dir):
    """The language of every whole text, learned from four fifths of the labelled ones."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn(
        "held_out", langid.held_out("doc_id")
    )
    profiles = langid.learn(documents.filter(~F.col("held_out")))
    found = langid.identify(documents.drop("lang"), profiles)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


@query
def op1_posting_lists(spark, sf_dir):
    """The 20 nearest vectors of every twentieth one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


@query
def op4_token_counts(spark, sf_dir):
    """Token counts of all documents, after three edits of each that its own text and id decide.

    An edit in 25 puts up to 6,000 characters in, so leaves are cut anew.
    """
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    chance = lambda salt, top: F.pmod(F.xxhash64("doc_id", "seq", F.lit(salt)), top)
    n = F.length("text").cast("long")
    edits = documents.withColumn("seq", F.explode(F.sequence(F.lit(1), F.lit(3)))).select(
        "doc_id", "seq", chance(1, n + 1).alias("at"), chance(2, F.lit(12)).alias("cut"),
        F.substr("text", chance(3, n + 1).cast("int") + 1, F.when(
            chance(5, F.lit(25)) == 0, F.lit(6_000)).otherwise(chance(4, F.lit(24)).cast("int"))).alias("put"),
    )
    trees = tokencount.build_trees(documents, ranks, public_tokenizers.PATTERN)
    counted = tokencount.apply_edits(trees, edits, ranks, public_tokenizers.PATTERN)
    return counted.select(
        "doc_id", "n_tokens_before", "n_tokens", "n_edits", "n_chars", "encoded_chars",
        F.size("leaf_tokens").alias("n_leaves"), F.sha2("text", 256).alias("text_sha256"),
    )


@query
def op2_secrets(spark, sf_dir):
    """All candidates for secrets, and which of them a forest keeps.

    Findings of four fifths of the documents are labelled: those set to a named credential
    as secrets, those of letters alone as false positives.
    """
    secret = F.lower("before").rlike("(token|secret|password|key)[\"']?\\s*[=:]\\s*[\"']$") & (
        F.col("value").rlike("^[0-9a-fA-F]{32,}$|^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_-]{24,}=*$"))
    labels = F.when(langid.held_out("doc_id"), None).when(secret, 1).when(
        F.col("value").rlike("^[A-Za-z]+$"), 0)
    found = secrets.scan(table(spark, sf_dir, "documents"), labels)
    return found.select(
        "doc_id", "at", F.col("length").cast("int").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"),
        F.round("coverage", 6).alias("coverage"), F.round("score", 6).alias("score"), "kept",
    )


@query
def op13_quality_rules(spark, sf_dir):
    """Measures of every whole text, and the verdict of the table of rules."""
    judged = quality.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *(F.col("quality")[name].alias(name) for name in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_lines",
        "n_letter_runs", "n_stop_words", "base_failed", "kept",
    )), F.array_join("quality.failed", ",").alias("failed"))


_FAILED = ", ".join(
    f"CASE WHEN {'' if rule.per is None else f'{rule.per} > 0 AND '}(" + " OR ".join(
        f"{'' if rule.per is None else '1000 * '}{rule.measure} {sign} {bound}"
        + ("" if rule.per is None else f" * {rule.per}")
        for sign, bound in (("<", rule.least), (">", rule.most)) if bound is not None
    ) + f") THEN '{rule.rule}' END" for rule in quality.RULES
)
_STOP = ", ".join(f"'{word}'" for word in sorted(set(" ".join(quality.STOP_WORDS.values()).split())))

ORACLE["op13_quality_rules"] = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT row_id, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS rows_,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS runs
  FROM docs
), windows AS (
  SELECT row_id, p, words[p:p + 7] AS own
  FROM cut, LATERAL (SELECT unnest(range(1, len(words) - 6)) AS p)
), many AS (SELECT row_id, own FROM windows GROUP BY row_id, own HAVING count(*) > 1),
covered AS (
  SELECT row_id, count(DISTINCT q) AS n_repeat_words
  FROM windows JOIN many USING (row_id, own), LATERAL (SELECT unnest(range(p, p + 8)) AS q) GROUP BY row_id
), measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum([length(w) FOR w IN words]), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(rows_) - len(list_distinct(rows_)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         CAST(len([w FOR w IN words IF regexp_matches(w, '[^\x00-\x40\x5B-\x60\x7B-\x7F]')]) AS BIGINT)
           AS n_letter_words,
         CAST(len(rows_) AS BIGINT) AS n_lines,
         CAST(len([x FOR x IN rows_ IF regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]')]) AS BIGINT) AS n_bullet_lines,
         CAST(len([x FOR x IN rows_ IF regexp_matches(x, '([.][.][.]|…)[\x20\x09-\x0D]*$')]) AS BIGINT)
           AS n_cut_lines,
         CAST(len(runs) AS BIGINT) AS n_letter_runs,
         CAST(len([w FOR w IN runs IF w IN ({_STOP})]) AS BIGINT) AS n_stop_words
  FROM cut LEFT JOIN covered USING (row_id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         concat_ws(',', {_FAILED}) AS failed
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_letter_words, n_lines,
       n_letter_runs, n_stop_words, base_failed, NOT base_failed AND failed = '' AS kept, failed
FROM judged
"""


@query
def op11_source_divergence(spark, sf_dir):
    """How far the sources of each language are apart, and the terms that set each apart."""
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLE["op11_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), found AS (SELECT row_id, lang, source, unnest(terms) AS term FROM docs),
kept AS (
  SELECT lang, term, count(*) AS lang_n FROM found GROUP BY lang, term HAVING count(DISTINCT row_id) >= 30
), langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
         1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 5) // (coalesce(total, 0) + 5 * v) AS p,
         1 + CAST(1000000000 AS HUGEINT) * (lang_n + 5) // (lang_total + 5 * v) AS q
  FROM groups JOIN langs USING (lang) JOIN kept USING (lang)
       LEFT JOIN counts USING (lang, source, term) LEFT JOIN totals USING (lang, source)
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), valued AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN apart p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM valued
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query
def op12_alignment(spark, sf_dir):
    """Groups and links of the tokens of two vocabularies in whole texts, scored by the corpus."""
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.score(table(spark, sf_dir, "documents"), a, b)
