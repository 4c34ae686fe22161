"""The registered queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import bpe, chunk_dedup, exact_dedup, graph_dedup, line_dedup, manifest, near_dedup, neighbours, packing, quality, ranked_search, suffix_dedup, url_filter
from causeway.llm._io import table

#: Rules of the URL filter: verdict, host, path.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Names in hosts whose pages make up the list of URLs.
LISTED_HOSTS = "spam-farm|cheap-pills|casino-win|free-bets|ads-track"


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles are similar by 0.8 or more."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes from every document the bytes that repeated strings of 200 bytes cover."""
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document by preferences learnt from the labels that aren't held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranker = quality.fit(documents, table(spark, sf_dir, "labels"))
    return quality.score(documents, ranker).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs every document into sequences of 2048 tokens."""
    out = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), closing=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes from every document the lines that an earlier line repeats, nearly or exactly."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100, among all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes from every document the passages that stand in an earlier one."""
    out = chunk_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_chunks", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups every document with those of equal text."""
    out = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


_OP8_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page's URL; listed are the canonical URLs of pages on advertising hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(url_filter.host(F.col("url")).rlike(LISTED_HOSTS)).select(url_filter.canonical(F.col("url")).alias("entry"))
    return url_filter.filter_urls(pages, URL_RULES, listed, "entry")


_OP10_SQL = r"""
WITH p AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
c AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|/index\.html?|\.html?)+$', '') END AS canon FROM p),
l AS (
  SELECT DISTINCT canon FROM c WHERE canon IS NOT NULL AND regexp_matches(host, 'spam-farm|cheap-pills|casino-win|free-bets|ads-track')),
r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS t(says, rh, prefix)),
j AS (
  SELECT c.page_id, c.host, c.path, c.canon, c.url,
         (SELECT max_by(struct_pack(n := r.rh || r.prefix, s := r.says), length(r.rh || r.prefix)) FROM r
          WHERE (c.host = r.rh OR ends_with(c.host, '.' || r.rh)) AND starts_with(c.path, r.prefix)) AS hit
  FROM c)
SELECT page_id, host, path, hit.n AS rule, l.canon IS NOT NULL AS listed,
       coalesce(hit.s, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN l ON j.canon = l.canon
"""


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proves every document's place in the manifest; a third of the texts is tampered with."""
    documents = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, manifest.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], lowered))
    out = manifest.manifest(documents, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"tampered": tampered})
    folded = manifest.fold(F.col("path"), F.coalesce("tampered", "digest"))
    out = out.select("doc_id", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", manifest.proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_OP11_SQL = """
WITH RECURSIVE f AS (
  SELECT doc_id, text, coalesce('=' || lang, '') AS grp,
         concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                   coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
         4294967295 - list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [256 + ascii(c), 1, 1, 1, 1, 1, 1, 1, 1]))::BIGINT[]),
           lambda a, b: CASE WHEN b > 1 THEN xor(a, b - 256) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS crc
  FROM documents),
h AS (
  SELECT doc_id, grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered
  FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM h),
t(level, grp, idx, n, digest) AS (
  SELECT 0, grp, idx, n, leaf FROM b
  UNION ALL SELECT level + 1, grp, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY level, grp, idx // 8, n),
r AS (SELECT grp, digest, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
u(level, idx, n, digest) AS (
  SELECT 0, idx, n, digest FROM r
  UNION ALL SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY level, idx // 8, n),
a AS (SELECT level, grp, idx, n, digest FROM t WHERE n > 1 UNION ALL SELECT level, NULL, idx, n, digest FROM u WHERE n > 1),
s AS (
  SELECT level, grp, idx,
         coalesce(string_agg(digest, '') OVER (PARTITION BY grp, level, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(digest, '') OVER (PARTITION BY grp, level, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind
  FROM a),
w(level, grp, place, idx, n, proof, folded) AS (
  SELECT 0, grp, idx, idx, n, '', coalesce(tampered, leaf) FROM b
  UNION ALL SELECT w.level + 1, w.grp, w.place, w.idx // 8, (w.n + 7) // 8, w.proof || s.before || s.behind, sha256(s.before || w.folded || s.behind)
  FROM w JOIN s ON s.grp = w.grp AND s.level = w.level AND s.idx = w.idx WHERE w.n > 1),
x(level, grp, place, subroot, idx, n, proof, folded) AS (
  SELECT 0, w.grp, w.place, r.digest, r.idx, r.n, w.proof, w.folded FROM w JOIN r ON w.grp = r.grp WHERE w.n = 1
  UNION ALL SELECT x.level + 1, x.grp, x.place, x.subroot, x.idx // 8, (x.n + 7) // 8, x.proof || s.before || s.behind, sha256(s.before || x.folded || s.behind)
  FROM x JOIN s ON s.grp IS NULL AND s.level = x.level AND s.idx = x.idx WHERE x.n > 1)
SELECT b.doc_id, b.leaf, x.subroot, u.digest AS root, sha256(x.proof) AS proof_sha256, x.folded AS folded_root, x.folded = u.digest AS verified
FROM b JOIN x ON b.grp = x.grp AND b.idx = x.place JOIN u ON u.n = 1 WHERE x.n = 1
"""


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of embeddings of one label with a cosine of 0.93 or more."""
    return graph_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents for every benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k=50)


_OP13_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS terms FROM documents),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM benchmark),
n AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
m AS (SELECT doc_id, terms, 100 - 50 + (50 * len(terms)::BIGINT * docs) // total AS m FROM d, n WHERE len(terms) > 0),
t AS (SELECT doc_id, m, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, m, unnest(terms) AS term FROM m) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, n GROUP BY term, docs),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM i JOIN t ON i.term = t.term JOIN w ON i.term = w.term GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each query takes (spark, sf_dir) and returns its whole result."""
    return {"op1_near_dedup": op1_near_dedup, "op2_suffix_dedup": op2_suffix_dedup, "op3_quality": op3_quality, "op4_packing": op4_packing, "op5_line_dedup": op5_line_dedup, "op6_neighbours": op6_neighbours, "op7_chunk_dedup": op7_chunk_dedup, "op8_exact_dedup": op8_exact_dedup, "op9_bpe": op9_bpe, "op10_url_filter": op10_url_filter, "op11_manifest": op11_manifest, "op12_embedding_dedup": op12_embedding_dedup, "op13_ranked_search": op13_ranked_search}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express."""
    return {"op8_exact_dedup": _OP8_SQL, "op10_url_filter": _OP10_SQL, "op11_manifest": _OP11_SQL, "op13_ranked_search": _OP13_SQL}
