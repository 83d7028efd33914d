"""The registered queries of this subpackage and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import forest, language, lengths, mixing, pieces, quality, reputation, sharding, substrings, syncmers, trie, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@register
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text; the library checks every distinct stretch."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.round_trip(docs, model).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@register
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives and read them back."""
    manifest = warc.write(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return warc.read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text by a byte network that learnt from two thirds of the labels."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    rows = docs.select("doc_id", "text", language.held_out().alias("held_out"))
    return language.predict(rows, language.train(docs)).select("doc_id", "held_out", "lang_pred", "score")


@register
def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 5, 2, 1, ... with fitted budgets."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix(docs, carry=["doc_id"])


@register
def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and host reputations. A page's outcome is the label of the document that its path names."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    outcome = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    named = reputation.with_host(pages).select("url", F.expr("try_cast(regexp_extract(path, '^/[^/]+/([0-9]+)', 1) as long)").alias("doc_id"))
    labelled = named.join(outcome, "doc_id").select("url", "bad")
    return reputation.judge(pages, labelled).select("page_id", "host", "path", "rule", "verdict", "bad_mean", "bad_low")


@register
def op7_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths with suffix sums, for every context limit."""
    docs = table(spark, sf_dir, "documents", "text")
    return lengths.histogram(lengths.token_lengths(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")))


@register
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-syncmer fingerprints of every text, its edited form and the next document."""
    return syncmers.edited_fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


@register
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets are alike in 75 of 100 parts or more."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return forest.components(docs).withColumnRenamed("id", "doc_id")


WORDS = "regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"

SQL["op9_near_duplicates"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w),
g AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS g FROM s),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.a = s.doc_id"""


@register
def op2_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in 35-word windows that occur more than once are removed."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = substrings.remove_repeats(docs, digests=True)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL["op2_repeated_substrings"] = f"""
WITH w AS (SELECT doc_id, coalesce({WORDS.format(text="text")}, []) AS w FROM documents),
p AS MATERIALIZED (
  SELECT doc_id, unnest(generate_series(1, len(w) - 34)) AS i, w FROM w WHERE len(w) >= 35),
h AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
r AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
g AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS i FROM h WHERE h IN (SELECT h FROM r)),
k AS (
  SELECT doc_id, unnest(generate_series(1, len(w))) AS i, unnest(w) AS word FROM w),
kept AS (
  SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.i) AS t, count(*) AS n
  FROM k ANTI JOIN g ON g.doc_id = k.doc_id AND g.i = k.i GROUP BY k.doc_id)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""


@register
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rules and the log-likelihood ratio of trusted documents against all."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return quality.judge(docs, labels.where("quality = 1 and toxic = 0"))


SQL["op6_url_reputation"] = """
WITH r AS (
  SELECT page_id, url, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM r),
p AS MATERIALIZED (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM h),
l AS (
  SELECT page_id, host, path, regexp_replace(host, ':[0-9]*$', '') AS name, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS s FROM p),
z AS (
  SELECT *, regexp_full_match(name, '[0-9]+(\\.[0-9]+){3}') AS address, CASE WHEN regexp_full_match(array_to_string(s[greatest(1, len(s) - 1):], '.'),
    '(ac|co|com|edu|go|gob|gov|gub|mil|ne|net|or|org)\\.[a-z]{2}') THEN 2 ELSE 1 END AS k FROM l),
n AS MATERIALIZED (
  SELECT page_id, host, path, name, CASE WHEN address THEN name ELSE array_to_string(s[greatest(1, len(s) - k):], '.') END AS domain,
    CASE WHEN address THEN name ELSE array_to_string(s[greatest(1, len(s) - k + 1):], '.') END AS suffix FROM z),
o AS (SELECT doc_id, max((quality = 0 OR toxic = 1)::int) AS bad FROM labels GROUP BY doc_id),
b AS (
  SELECT n.*, bad FROM n JOIN o ON o.doc_id = try_cast(regexp_extract(path, '^/[^/]+/([0-9]+)', 1) AS bigint) WHERE bad IS NOT NULL),
hosts AS MATERIALIZED (SELECT name, domain, suffix, sum(bad)::double AS bad, count(*)::double AS pages FROM b GROUP BY ALL),
domains AS MATERIALIZED (SELECT domain, suffix, sum(bad) AS bad, sum(pages) AS pages FROM hosts GROUP BY ALL),
suffixes AS MATERIALIZED (SELECT suffix, sum(bad) AS bad, sum(pages) AS pages FROM domains GROUP BY ALL),
m AS MATERIALIZED (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(pages), 0) + 1) AS m FROM suffixes),
units AS (
  SELECT 1 AS lv, bad, pages FROM suffixes UNION ALL SELECT 2, bad, pages FROM domains UNION ALL SELECT 3, bad, pages FROM hosts),
sums AS (
  SELECT lv, sum(bad) / sum(pages) AS p, sum(pages) AS n, count(*) AS k, sum(pages * pages) AS nn,
    sum(pages * (bad / pages - m) ** 2) AS s FROM units, m GROUP BY lv),
between_ AS (SELECT lv, k, p * (1 - p) AS c, (s - (k - 1) * p * (1 - p)) / nullif(n - nn / n, 0) AS v FROM sums),
w AS MATERIALIZED (
  SELECT lv, least(greatest(coalesce(CASE WHEN k > 1 AND v > 0 THEN (c - v) / v END, 1000.0), 1.0), 1000.0) AS w FROM between_),
s1 AS (SELECT suffix, (bad + w * m) / (pages + w) AS mean, pages + w AS t FROM suffixes, m, w WHERE lv = 1),
d1 AS (
  SELECT domain, domains.suffix, (bad + w * s1.mean) / (pages + w) AS mean, pages + w AS t
  FROM domains JOIN s1 ON s1.suffix = domains.suffix, w WHERE lv = 2),
h1 AS (
  SELECT name, (bad + w * d1.mean) / (pages + w) AS mean, pages + w AS t
  FROM hosts JOIN d1 ON d1.domain = hosts.domain AND d1.suffix = hosts.suffix, w WHERE lv = 3),
j AS (
  SELECT page_id, host, path, coalesce(h1.mean, d1.mean, s1.mean, m) AS bad_mean,
    coalesce(h1.mean - 1.645 * sqrt(h1.mean * (1 - h1.mean) / (h1.t + 1)), d1.mean - 1.645 * sqrt(d1.mean * (1 - d1.mean) / (d1.t + 1)),
      s1.mean - 1.645 * sqrt(s1.mean * (1 - s1.mean) / (s1.t + 1)), m - 1.645 * sqrt(m * (1 - m) / (w.w + 1))) AS bad_low
  FROM n CROSS JOIN m JOIN (SELECT coalesce(max(w) FILTER (lv = 1), 1000.0) AS w FROM w) w ON true LEFT JOIN h1 ON h1.name = n.name LEFT JOIN d1 ON d1.domain = n.domain LEFT JOIN s1 ON s1.suffix = n.suffix),
q AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule FROM j)
SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow'
  WHEN 'org/fr/' THEN 'allow' ELSE CASE WHEN bad_low > 0.5 THEN 'block' ELSE 'allow' END END AS verdict, bad_mean, bad_low FROM q"""


SQL["op3_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
k AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper, count(*) OVER (PARTITION BY payload_digest) AS n FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND n > 1 AND page_id IS DISTINCT FROM keeper AND keeper IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND n > 1 AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to FROM k"""


@register
def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes; equal texts stay together."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    placed = sharding.assign(docs, carry=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC 32 of a string, with the table ``crc`` (t: 256 entries) in scope.
CRC_TABLE = """crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""
CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({0})), '..'),
    lambda h: (instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""


def _shard_sql(shards: int = 8) -> str:
    """Giants by ranks, the least capacity by dynamic programming over all pairs of cuts, then the greedy walk."""
    layers, steps = [], []
    for k in range(1, shards + 1):
        before = "SELECT i, e AS most FROM o" if k == 1 else (
            f"SELECT b.i, min(greatest(a.most, b.e - p.e)) AS most FROM f{k - 1} a JOIN (SELECT i, e FROM o UNION ALL SELECT 0, 0) p ON p.i = a.i JOIN o b ON b.i > a.i GROUP BY b.i")
        layers.append(f"f{k} AS MATERIALIZED ({before} UNION ALL SELECT 0, 0)")
        last = f"(SELECT cut FROM c{k - 1})" if k > 1 else "0"
        steps.append(f"c{k} AS MATERIALIZED (SELECT coalesce(max(e), 0) AS cut FROM o, cap WHERE e <= {last} + cap.most)")
    least = " UNION ALL ".join(f"SELECT {k} AS k, i, most FROM f{k}" for k in range(1, shards + 1))
    shard = " + ".join(f"(e > (SELECT cut FROM c{k}))::int" for k in range(1, shards + 1))
    return f"""
WITH {CRC_TABLE},
d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size FROM documents),
g AS MATERIALIZED (SELECT text, sum(size)::bigint AS bytes, min(doc_id) AS first, sha256(text) AS h FROM d GROUP BY text),
r AS (SELECT *, row_number() OVER w - 1 AS rank, sum(bytes) OVER (ORDER BY bytes DESC, first NULLS LAST, h ROWS UNBOUNDED PRECEDING) - bytes AS gone
  FROM g WINDOW w AS (ORDER BY bytes DESC, first NULLS LAST, h)),
m AS MATERIALIZED (
  SELECT *, coalesce(bool_and(bytes * ({shards} - rank) > (SELECT sum(bytes) FROM g) - gone) OVER (ORDER BY rank), false) AS giant FROM r),
n AS MATERIALIZED (SELECT count(*) FILTER (giant) AS giants FROM m),
o AS MATERIALIZED (
  SELECT text, row_number() OVER w AS i, (sum(bytes) OVER w)::bigint AS e FROM m WHERE NOT giant
  WINDOW w AS (ORDER BY first NULLS LAST, h ROWS UNBOUNDED PRECEDING)),
{", ".join(layers)},
cap AS MATERIALIZED (SELECT coalesce(min(most), 0) AS most FROM ({least}) x, n WHERE k = {shards} - giants AND i = (SELECT coalesce(max(i), 0) FROM o)),
{", ".join(steps)},
p AS MATERIALIZED (
  SELECT text, rank AS shard, -1 AS e FROM m WHERE giant UNION ALL SELECT text, (SELECT giants FROM n) + {shard} AS shard, e FROM o)
SELECT doc_id, size, {CRC.format("d.text")} AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY e, doc_id NULLS LAST) - 1 AS slot, NULL::int AS grown_shard
FROM d JOIN p ON p.text = d.text, crc"""


SQL["op11_shards"] = _shard_sql()


@register
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four leading components of every usable embedding, scaled to variance one."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return whitening.whiten(rows)


@register
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie over all rebuilt conversations."""
    return trie.expand(trie.build(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


SQL["op12_conversation_trie"] = f"""
WITH {CRC_TABLE},
o AS MATERIALIZED (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) x),
c AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC.format("conv_id::varchar")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o) x, crc),
w AS (
  SELECT c.conv_id, 0 AS part, i, role, text FROM c JOIN o ON o.conv_id = base AND i <= h
  UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND i > h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d, length(role) || ':' || role || text AS turn, length(text) AS ch FROM w),
p AS (SELECT conv_id, d, ch, md5(string_agg(md5(turn), '') OVER (PARTITION BY conv_id ORDER BY d)) AS p FROM d),
r AS MATERIALIZED (
  SELECT conv_id, d, ch, p, coalesce(lag(p) OVER (PARTITION BY conv_id ORDER BY d), '') AS up FROM p
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
n AS MATERIALIZED (SELECT p, any_value(d) AS d, any_value(ch) AS ch, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs FROM r GROUP BY p),
k AS (SELECT up AS p, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
m AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.p = n.p),
s AS (
  SELECT r.p, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * m.ch)::bigint AS saved_tokens
  FROM m JOIN r ON r.conv_id = m.conv_id AND r.d <= m.d GROUP BY r.p),
e AS (
  SELECT p, sha256(string_agg(conv_id::varchar, ',' ORDER BY conv_id)) AS ends
  FROM (SELECT conv_id, max_by(p, d) AS p FROM r GROUP BY conv_id) x GROUP BY p)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM m JOIN s ON s.p = m.p LEFT JOIN e ON e.p = m.p LEFT JOIN n u ON u.p = m.up"""
