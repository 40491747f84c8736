"""Registered queries of the subpackage: each applies one operator, with its
production parameters, to a whole table.  ``ORACLE`` holds DuckDB statements where
SQL can restate the operator; the others are tested against brute force in
``tests/llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm import (ann, jaccard, lexical, line_dedup, lm, mixing, packing, prefix_trie, quality, sharding,
                          simhash, token_counts, url_filter)
from casebook.llm.scratch import stored
from casebook.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


@register("op1_projected_neighbours")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, F.col("vec_id") % 20 == 0, k=20)


@register("op2_harmonic_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path(), capacity=2048, with_ids=False)


@register("op3_line_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, threshold=2, min_chars=1, chars_per_edit=10)
    return out.select("doc_id", "n_lines", F.size("removed_lines").alias("n_removed"), "removed_lines")


@register("op4_lm_scoring")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ratio = quality.fit_ratio(quality.with_trust(docs, read_table(spark, sf_dir, "labels")), F.col("trusted"))
    return quality.judge(docs, ratio).select("doc_id", *quality.ADDED)


@register("op6_histogram_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, shards=24).select("doc_id", *sharding.OUT)


@register("op7_temperature_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, repeat_limit=1.5).select("doc_id", "source", *mixing.ADDED)


@register("op8_jaccard_join", r"""
WITH RECURSIVE
w AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
      FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) END AS sh FROM w),
t AS (SELECT r, unnest(sh) AS g FROM s),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS n FROM t a JOIN t b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN s a ON a.r = x JOIN s b ON b.r = y WHERE 100 * n >= 85 * (len(a.sh) + len(b.sh) - n)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(r, v) AS (SELECT r, r FROM s UNION SELECT reach.r, e.y FROM reach JOIN e ON e.x = reach.v)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM s JOIN reach ON reach.r = s.r JOIN s o ON o.r = reach.v GROUP BY s.r, s.doc_id, s.sh
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, percent=85)


# The rule list of the url contract.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


@register("op9_url_filter", """
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*', 0, 's') ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM cut),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (
  SELECT p.page_id, p.host, p.path, max_by(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule,
         max_by(r.verdict, length(r.rhost || r.rpath)) AS verdict
  FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
  GROUP BY ALL)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM fit
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_filter(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@register("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, tokenizer_path()).select("doc_id", *token_counts.ADDED)


@register("op11_simhash")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.simhash_components(docs, size=3, distance=3)


@register("op12_lexical_search", r"""
WITH
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
k AS (SELECT q, item_id, t, count(*) AS times FROM i GROUP BY ALL),
g AS (SELECT count(*) AS n, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
m AS (SELECT r, doc_id, 25 + (75 * len(ts) * g.n) // g.l AS m FROM d, g WHERE len(ts) > 0),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM k) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * g.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY t, g.n),
s AS (SELECT k.q, k.item_id, m.doc_id, m.r, CAST(sum(k.times * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * m.m))) AS BIGINT) AS score
      FROM k JOIN f ON f.t = k.t JOIN w ON w.t = k.t JOIN m ON m.r = f.r GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


@register("op13_prefix_trie", r"""
WITH
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
        coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, c - c % 20 AS base,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
          lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
          4294967295) % 4 AS h
      FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT k.c, 0 AS side, t.pos, t.role, t.text FROM k JOIN t ON t.c = k.base AND t.pos < k.h
      UNION ALL SELECT k.c, 1, t.pos, t.role, t.text FROM k JOIN t ON t.c = k.c AND t.pos >= k.h),
s AS (SELECT k.c, coalesce(list([r.role, r.text] ORDER BY side, pos) FILTER (WHERE r.c IS NOT NULL), []) AS said
      FROM k LEFT JOIN r ON r.c = k.c GROUP BY k.c),
m AS (SELECT c, d, said[1:d] AS prefix, len(said) = d AS ends FROM (SELECT c, said, unnest(range(0, len(said) + 1)) AS d FROM s)),
n AS (SELECT d, prefix, min(c) AS conv, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends,
        CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(prefix[d][2], '[^\x20\x09-\x0D]+')) END AS words FROM m GROUP BY d, prefix),
p AS (SELECT a.conv, a.d, b.conv AS parent, count(*) OVER (PARTITION BY b.conv, b.d) AS children FROM n a JOIN n b ON b.d = a.d - 1 AND b.prefix = a.prefix[1:a.d - 1]),
kids AS (SELECT parent, d - 1 AS d, any_value(children) AS children FROM p GROUP BY ALL),
f AS (SELECT n.*, p.parent, coalesce(kids.children, 0) AS children FROM n LEFT JOIN p ON p.conv = n.conv AND p.d = n.d
      LEFT JOIN kids ON kids.parent = n.conv AND kids.d = n.d)
SELECT a.conv AS conv_id, a.d AS depth, a.parent AS parent_conv_id, a.n AS n_convs, CAST(a.children AS BIGINT) AS n_children,
       CAST(sum(CASE WHEN b.children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
       CAST(sum((b.n - 1) * b.words) AS BIGINT) AS saved_tokens, a.ends AS ends_sha256
FROM f a JOIN f b ON b.d >= a.d AND b.prefix[1:a.d] = a.prefix GROUP BY ALL
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(prefix_trie.numbered_turns(read_table(spark, sf_dir, "conversations")), "trie-turns")
    convs, turns = prefix_trie.regrafted(turns, group=20, most=4)
    return prefix_trie.prefix_trie(convs, turns).select(*prefix_trie.OUT)
