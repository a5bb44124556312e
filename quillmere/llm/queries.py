"""The queries on the test tables: each is its operator plus the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.common import table


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; they are installed, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; learned from labels of those whose crc32 modulo 5 is not 0."""
    from quillmere.llm.language import held_out
    from quillmere.llm.toxicity import fit, score_documents

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    apart = held_out(F.col("doc_id"), 5, 0)
    found = score_documents(docs, fit(docs, labels.filter(~apart)))
    return found.select("doc_id", apart.alias("held_out"), "score", "predicted", "n_offending", "worst_start", "worst_end")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids and decoded text of all documents, as digests."""
    from quillmere.llm.pieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), outputs="digests")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products for every 50th vector."""
    from quillmere.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 40 equal shards by rendezvous hashing."""
    from quillmere.llm.sharding import shard_records

    return shard_records(table(spark, sf_dir, "documents"), [1.0] * 40)


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of cosine 0.93 or more within a label."""
    from quillmere.llm.permutation import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % of all words takes of each document."""
    from quillmere.llm.mixture import taken_words

    return taken_words(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log stupid-backoff scores of all documents under counts of all documents."""
    from quillmere.llm.ngramlm import score_documents

    found = score_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_backed", F.round("score", 6).alias("score"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents."""
    import public_tokenizers

    from quillmere.llm.secrets import scan_documents

    return scan_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; learned from those whose crc32 modulo 4 is not 2."""
    from quillmere.llm.language import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    apart = held_out(F.col("doc_id"), 4, 2)
    identifier = fit(docs.filter(~apart), "doc_id", "text", "lang")
    found = identify(docs, identifier)
    return found.select("doc_id", apart.alias("held_out"), "lang_pred", "score", "accepted")


def op10_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    from quillmere.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the words of each source differ from those of the others of its language."""
    from quillmere.llm.divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by rule, else by their host's reputation.

    A page shows the document whose number ends its path, so its outcome is
    that document's label: bad if toxic or of low quality.
    """
    from quillmere.llm.reputation import judge_urls

    labels = table(spark, sf_dir, "labels").select("doc_id", F.greatest(F.col("toxic"), 1 - F.col("quality")).alias("bad"))
    record = F.regexp_extract("path", r"/([0-9]+)(?:/|\.[a-z]+)?$", 1).try_cast("long")
    found = judge_urls(table(spark, sf_dir, "pages"), labels, record)
    return found.select("page_id", "host", "path", "rule", "verdict", F.col("n").alias("labelled"), F.round("bound", 6).alias("bad_bound"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in fill-in-the-middle form, as digests of that form and of the text rebuilt from it."""
    from quillmere.llm.infill import infill_documents, restored

    found = infill_documents(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_sentencepiece, op3_topk, op4_sharding, op5_embedding_neardup, op6_mixture, op7_lm_scoring, op8_secrets, op9_language_id,
        op10_simhash_neardup, op11_source_divergence, op12_url_filter, op13_infill,
    )
}

ORACLES: dict[str, str] = {
    "op3_topk": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op6_mixture": """
WITH sized AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number
  FROM sized GROUP BY source),
weighed AS (SELECT *, list_extract([3.0::DOUBLE, 1.0, 2.0], number % 3 + 1) AS weight, source_size * 2.0::DOUBLE AS cap FROM totals),
filled AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS wanted,
         coalesce(sum(cap) OVER lower_caps, 0.0) AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER lower_caps, 0.0) AS open_weight
  FROM weighed
  WINDOW lower_caps AS (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT *, max(CASE WHEN (wanted - capped) / open_weight * weight <= cap THEN (wanted - capped) / open_weight END) OVER () AS level
  FROM filled),
targets AS (SELECT source, source_size, least(cap, level * weight) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY h, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((SELECT sum(greatest(0, least(floor(target), p * source_size + start + size) - (p * source_size + start)))
             FROM range(3) AS passes(p)) AS BIGINT) AS taken
FROM placed
""",
    "op7_lm_scoring": """
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
spots AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM split),
pairs AS (SELECT doc_id, i, words[i] AS w, CASE WHEN i > 1 THEN words[i - 1] END AS v FROM spots),
ones AS (SELECT w, count(*) AS n FROM pairs GROUP BY w),
twos AS (SELECT v, w, count(*) AS n FROM pairs WHERE v IS NOT NULL GROUP BY v, w HAVING count(*) >= 2),
scored AS (
  SELECT p.doc_id, t.n IS NULL AS backed,
         CASE WHEN t.n IS NOT NULL THEN ln(t.n / o.n)
              ELSE ln(c.n / (SELECT count(*) FROM pairs)) + CASE WHEN p.v IS NULL THEN 0 ELSE ln(0.4) END END AS s
  FROM pairs p LEFT JOIN twos t ON t.v = p.v AND t.w = p.w LEFT JOIN ones o ON o.w = p.v JOIN ones c ON c.w = p.w)
SELECT d.doc_id, count(s) AS n_words, count(*) FILTER (WHERE backed) AS n_backed, round(avg(s), 6) AS score
FROM documents d LEFT JOIN scored USING (doc_id) GROUP BY d.doc_id
""",
    "op5_embedding_neardup": """
WITH RECURSIVE valid AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
       (SELECT min(b) FROM reach r WHERE r.a = e.vec_id) AS component_id,
       e.vec_id = (SELECT min(b) FROM reach r WHERE r.a = e.vec_id) AS kept
FROM embeddings e
""",
    "op11_source_divergence": """
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
spots AS (SELECT row, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM spots GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
langs AS (
  SELECT lang, coalesce(max(v), 0) AS v, coalesce(max(n), 0) AS n
  FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang) USING (lang) GROUP BY lang),
counts AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM spots JOIN (SELECT lang, term FROM kept) USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source),
groups AS (
  SELECT lang, source, coalesce(s.n, 0) AS n, v FROM (SELECT DISTINCT lang, source FROM docs) JOIN langs USING (lang) LEFT JOIN sums s USING (lang, source)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // CAST(g.n + g.v AS HUGEINT) AS p,
         1 + (1000000000::HUGEINT * (k.n + 1)) // CAST(l.n + l.v AS HUGEINT) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
listed AS (
  SELECT lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b USING (lang) LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  WHERE a.source <> b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM listed)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
    "op12_url_filter": """
WITH split AS (
  SELECT page_id, url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
named AS (
  SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS name,
         try_cast(regexp_extract(path, '/([0-9]+)(?:/|\\.[a-z]+)?$', 1) AS BIGINT) AS record
  FROM split),
known AS (SELECT doc_id AS record, max(greatest(toxic, 1 - quality)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT name, count(k.bad) AS n, CAST(coalesce(sum(k.bad), 0) AS DOUBLE) AS bad,
         regexp_extract(name, '[^.]+\\.(?:ac\\.uk|co\\.uk|gov\\.uk|org\\.uk|com\\.au|net\\.au|org\\.au|com\\.br|co\\.in|co\\.jp|co\\.kr|co\\.nz|com\\.mx|com\\.tr|co\\.za|[^.]+)$') AS longer
  FROM named LEFT JOIN known k USING (record) GROUP BY name),
placed AS (SELECT name, n, bad, CASE WHEN longer = '' OR regexp_matches(name, '^[0-9.]+$') THEN name ELSE longer END AS domain FROM hosts),
members AS (SELECT *, CASE WHEN regexp_matches(domain, '^[0-9.]+$') THEN domain ELSE regexp_replace(domain, '^[^.]+\\.', '') END AS suffix FROM placed),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM members GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
everything AS (SELECT sum(n) AS n, sum(bad) AS bad FROM suffixes),
levels AS (
  SELECT 1 AS level, c.n, c.bad, p.bad / p.n AS m FROM suffixes c, everything p WHERE c.n > 0
  UNION ALL SELECT 2, c.n, c.bad, p.bad / p.n FROM domains c JOIN suffixes p USING (suffix) WHERE c.n > 0
  UNION ALL SELECT 3, c.n, c.bad, p.bad / p.n FROM members c JOIN domains p USING (domain) WHERE c.n > 0),
moments AS (
  SELECT level, sum((bad - n * m) * (bad - n * m)) AS found, sum(n * (m * (1 - m))) AS expected, sum(n * (n - 1) * (m * (1 - m))) AS pairs
  FROM levels GROUP BY level),
strengths AS (
  SELECT level, CASE WHEN pairs = 0 THEN 10 ELSE 1 / least(greatest((found - expected) / pairs, 1 / 1001::DOUBLE), 1 / 3::DOUBLE) - 1 END AS k
  FROM moments),
strength AS (SELECT coalesce((SELECT k FROM strengths WHERE level = 1), 10) AS k1, coalesce((SELECT k FROM strengths WHERE level = 2), 10) AS k2,
                    coalesce((SELECT k FROM strengths WHERE level = 3), 10) AS k3),
of_suffix AS (SELECT suffix, (s.bad + (e.bad + 0.5) / (e.n + 1) * k1) / (s.n + k1) AS m FROM suffixes s, everything e, strength),
of_domain AS (SELECT domain, (d.bad + s.m * k2) / (d.n + k2) AS m FROM domains d JOIN of_suffix s USING (suffix), strength),
of_host AS (SELECT name, h.n, (h.bad + d.m * k3) / (h.n + k3) AS m, h.n + k3 AS pages FROM members h JOIN of_domain d USING (domain), strength),
rated AS (SELECT name, n, m - 1.645::DOUBLE * sqrt(m * (1 - m) / (pages + 1)) AS bound FROM of_host),
rules(verdict, of_host, of_path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fitting AS (
  SELECT DISTINCT ON (host, path) host, path, of_host || of_path AS rule, verdict
  FROM (SELECT DISTINCT host, path FROM named) JOIN rules ON (host = of_host OR ends_with(host, '.' || of_host)) AND starts_with(path, of_path)
  ORDER BY host, path, length(of_host || of_path) DESC, of_host || of_path)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bound > 0.3 THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(n AS BIGINT) AS labelled, round(bound, 6) AS bad_bound
FROM named JOIN rated USING (name) LEFT JOIN fitting USING (host, path)
""",
    "op13_infill": """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, text, t, CAST(len(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM units),
placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
pieces AS (
  SELECT *, array_to_string(list_slice(t, 1, a), '') AS p, array_to_string(list_slice(t, a + 1, b), '') AS m,
         array_to_string(list_slice(t, b + 1, n), '') AS s
  FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces
""",
}
