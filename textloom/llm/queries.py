"""The registered queries of this subpackage: thin digests of the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import ann, bpe, chat, divergence, idfiles, langid, maxent, packing, phrases, pii, quality, sharding, simhash
from textloom.session import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_column(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=False)


def in_fold(mod: int) -> Column:
    """Whether crc32 of the document's id, as text, leaves 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == 1, F.lit(False))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~in_fold(3))
    return langid.predict(docs.withColumn("held_out", in_fold(3)), model, keep=["doc_id", "held_out"])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return quality.rules(table(spark, sf_dir, "documents"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every 20th vector, by inner product."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 ids."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.digest(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of eight, near equal in bytes, and its place there, by a map that is stored, loaded and shown with its version."""
    placed, _ = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat.render(table(spark, sf_dir, "conversations"))


def op10_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", in_fold(5))
    return maxent.score(docs, ~F.col("held_out"), keep=("held_out",))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and what each overuses."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_idfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and ids, written to files and read back by its key."""
    docs = table(spark, sf_dir, "documents")
    path = idfiles.write(docs, public_tokenizers.path("byte_bpe_50k.json"))
    found = idfiles.read(spark, path, idfiles.lookup(spark, path, docs), ids=False)
    return found.select(F.col("key").alias("doc_id"), "start", F.col("n").alias("n_tokens"), "ids_crc32")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op1_bpe": op1_bpe, "op2_quality": op2_quality, "op3_langid": op3_langid, "op4_ann": op4_ann, "op5_simhash": op5_simhash, "op6_packing": op6_packing, "op7_pii": op7_pii, "op8_sharding": op8_sharding, "op9_chat": op9_chat, "op10_maxent": op10_maxent, "op11_divergence": op11_divergence, "op12_idfiles": op12_idfiles, "op13_phrases": op13_phrases}
_CHAT_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, count(*) AS n, list(role || chr(1) || text ORDER BY turn NULLS FIRST, role, text) AS said,
         string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS shown
  FROM t GROUP BY conv_id
)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, CAST(0 AS BIGINT) AS segment, shown AS text
FROM c
WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.said[1] = c.said[1] AND d.n > c.n AND d.said[1:c.n] = c.said)
  AND NOT EXISTS (SELECT 1 FROM c d WHERE d.said = c.said AND d.conv_id < c.conv_id)
"""

_QUALITY_TEMPLATE = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, text, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), n AS (
  SELECT *, list_transform(ls, lambda x: trim(lower(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')))) AS norm FROM w
), tri AS (
  SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), cover AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM tri) WHERE k > 1
  ) GROUP BY r
), lines AS (
  SELECT r, host, norm[j] AS l FROM (SELECT *, unnest(range(1, len(norm) + 1)) AS j FROM n)
), sets AS (
  SELECT host, CAST('0x' || left(md5(text), 15) AS BIGINT) AS doc, list_distinct(any_value(norm)) AS s FROM n WHERE text IS NOT NULL GROUP BY host, text
), each_line AS (
  SELECT host, doc, s, unnest(s) AS l FROM sets
), common AS (
  SELECT host, l, count(*) AS c FROM each_line GROUP BY host, l HAVING count(*) > 1
), shared AS (
  SELECT host, doc, l, c, CAST('0x' || left(md5(l), 15) AS BIGINT) % 2147483647 AS x FROM each_line JOIN common USING (host, l)
), bands AS (
  SELECT host, doc, band, min((x * m) % 2147483647) AS least FROM shared, (VALUES @BANDS@) v(band, m) GROUP BY host, doc, band
), firsts AS (
  SELECT host, band, least, min(doc) AS first FROM bands SEMI JOIN (SELECT host, doc FROM shared WHERE c > 10) USING (host, doc) GROUP BY host, band, least
), pairs AS (
  SELECT host, doc, first FROM bands SEMI JOIN (SELECT host, doc FROM shared WHERE c > 10) USING (host, doc) JOIN firsts USING (host, band, least) WHERE doc <> first GROUP BY host, doc, first HAVING count(*) >= 2
), copies AS (
  SELECT p.host, p.doc, min(p.first) AS first FROM pairs p JOIN sets a ON a.host = p.host AND a.doc = p.doc JOIN sets b ON b.host = p.host AND b.doc = p.first
  WHERE len(list_intersect(a.s, b.s)) > 0.5::DOUBLE * greatest(len(a.s), len(b.s)) GROUP BY p.host, p.doc
), above AS (
  SELECT host, l FROM shared LEFT JOIN copies USING (host, doc) WHERE c > 10 GROUP BY host, l HAVING count(DISTINCT least(doc, coalesce(first, doc))) > 10
), hits AS (
  SELECT r, CAST(sum(len(string_split(l, ' '))) AS BIGINT) AS removed FROM lines JOIN above USING (host, l) GROUP BY r
), stats AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT) AS chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words, coalesce(removed, 0) AS removed_words
  FROM n LEFT JOIN cover USING (r) LEFT JOIN hits USING (r)
)
SELECT doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= 0.5::DOUBLE * n_words AS kept, removed_words
FROM stats
"""

#: The orders of the bands: powers of one multiplier.
_BANDS = ", ".join(f"({i}, {pow(48271, i + 1, 2**31 - 1)})" for i in range(8))
_QUALITY_SQL = _QUALITY_TEMPLATE.replace("@BANDS@", _BANDS)

_DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), w AS (
  SELECT r, lang, source, unnest(ts) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), g AS (
  SELECT DISTINCT lang, source FROM d
), v AS (
  SELECT lang, count(*) AS v, sum(c) AS total FROM kept GROUP BY lang
), had AS (
  SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term
), every AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, k.c,
         CAST(sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source) AS HUGEINT) + 2 * v.v AS base, CAST(v.total AS HUGEINT) + 2 * v.v AS whole
  FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN had h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // base AS p, 1 + (1000000000::HUGEINT * (c + 2)) // whole AS q FROM every
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

_PHRASES_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
  FROM documents
), p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM (SELECT lang, unnest(ps) AS piece FROM d)
), g AS (
  SELECT lang, k, ws[i : i + k - 1] AS w FROM (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4), (5)) t(k))
), f AS (
  SELECT lang, k, w, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY lang, k, w HAVING count(*) >= 100
), n AS (
  SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM p GROUP BY lang
), inside AS (
  SELECT DISTINCT lang, w[i : i + m - 1] AS w, a FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM f, (VALUES (2), (3), (4)) t(m) WHERE m < k)
), c AS (
  SELECT lang, w, a, k, unnest(range(1, k)) AS j FROM f WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = f.lang AND i.w = f.w AND i.a = f.a)
), cut AS (
  SELECT c.lang, c.w, c.a, x.a AS l, y.a AS r, n.n, (1000 * c.a * n.n) // (x.a * y.a) AS score, j
  FROM c JOIN n USING (lang) JOIN f x ON x.lang = c.lang AND x.w = c.w[1:j] JOIN f y ON y.lang = c.lang AND y.w = c.w[j + 1:c.k]
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank, array_to_string(w, ' ') AS phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op2_quality": _QUALITY_SQL, "op9_chat": _CHAT_SQL, "op11_divergence": _DIVERGENCE_SQL, "op13_phrases": _PHRASES_SQL}
