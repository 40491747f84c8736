"""Registered queries: conversation context, message text functions, language."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions import text as tx
from casebook.operators import text as ops
from casebook.plans.catalog import register
from casebook.sources.tables import read_table


def _norm_sql(col: str) -> str:
    return (f"lower(regexp_replace(regexp_replace({col}, '{tx.PUNCT_RE}', '', 'g'), "
            f"'{tx.STRIP_RE}', '', 'g'))")


@register("context_window", """
WITH b AS (SELECT conv_id, turn, role, text, row_number() OVER (ORDER BY conv_id, turn) AS i FROM conversations),
j AS (SELECT a.conv_id, a.turn, p.turn AS pturn, p.role AS prole, p.text AS ptext FROM b a
      LEFT JOIN b p ON p.conv_id = a.conv_id AND p.i BETWEEN a.i - 10 AND a.i - 1
                    AND p.role IN ('user', 'assistant'))
SELECT conv_id, turn, CAST(count(pturn) AS int) AS n_context,
  coalesce(string_agg(CAST(pturn AS varchar) || ':' || prole || ':' || md5(coalesce(ptext, '')), ',' ORDER BY pturn), '') AS context_key
FROM j GROUP BY conv_id, turn""")
def context_window(spark, sf_dir):
    c = ops.context_window(read_table(spark, sf_dir, "conversations"))
    key = F.array_join(F.transform("context", lambda e: F.concat(e["turn"].cast("string"), F.lit(":"),
                                                                 e["role"], F.lit(":"),
                                                                 F.md5(F.coalesce(e["text"], F.lit("")).cast("binary")))), ",")
    return c.select("conv_id", "turn", F.size("context").alias("n_context"), key.alias("context_key"))


@register("message_preview", """
SELECT conv_id, turn, substring(text, 1, 60) || '...' AS preview FROM conversations""")
def message_preview(spark, sf_dir):
    m = read_table(spark, sf_dir, "conversations")
    return m.select("conv_id", "turn", tx.preview(F.col("text")).alias("preview"))


@register("message_clean", f"""
SELECT conv_id, turn,
  CASE WHEN NOT contains(text, 'attachment://') THEN text
       WHEN length(regexp_replace(regexp_replace(text, '{tx.ATTACHMENT_RE}', '', 'g'), '{tx.STRIP_RE}', '', 'g')) = 0
         THEN '{tx.CHART_DEFAULT}'
       ELSE regexp_replace(regexp_replace(text, '{tx.ATTACHMENT_RE}', '', 'g'), '{tx.STRIP_RE}', '', 'g')
  END AS display_text
FROM conversations WHERE role = 'assistant'""")
def message_clean(spark, sf_dir):
    m = read_table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return m.select("conv_id", "turn", tx.strip_attachments(F.col("text")).alias("display_text"))


@register("text_normalise", f"""
SELECT conv_id, turn, {_norm_sql('text')} AS clean_text FROM conversations""")
def text_normalise(spark, sf_dir):
    m = read_table(spark, sf_dir, "conversations")
    return m.select("conv_id", "turn", tx.normalise(F.col("text")).alias("clean_text"))


def _short_values() -> str:
    return ", ".join("('{}', '{}')".format(k.replace("'", "''"), v) for k, v in ops.SHORT_MAP.items())


@register("language_detect", f"""
WITH docs AS (SELECT lang, {_norm_sql('text')} AS t FROM documents WHERE lang IS NOT NULL),
g AS (SELECT lang, substring(t, p, 3) AS gram FROM docs, range(1, length(t) - 1) r(p) WHERE length(t) >= 3),
prof AS (SELECT lang, gram, count(*) AS cnt FROM g GROUP BY lang, gram),
langs AS (SELECT lang, ln(sum(cnt) + (SELECT count(DISTINCT gram) FROM prof)) AS lz FROM prof GROUP BY lang),
m AS (SELECT conv_id, turn, {_norm_sql('text')} AS t FROM conversations WHERE role = 'user'),
sm(k, v) AS (VALUES {_short_values()}),
short AS (SELECT m.conv_id, m.turn, coalesce(sm.v, 'en') AS lang FROM m LEFT JOIN sm ON sm.k = m.t
          WHERE length(m.t) < 5),
mg AS (SELECT conv_id, turn, substring(t, p, 3) AS gram FROM m, range(1, length(t) - 1) r(p) WHERE length(t) >= 5),
pt AS (SELECT conv_id, turn, gram, count(*) AS ng FROM mg GROUP BY conv_id, turn, gram),
tot AS (SELECT conv_id, turn, sum(ng) AS n FROM pt GROUP BY conv_id, turn),
hit AS (SELECT conv_id, turn, lang, sum(ng * ln(cnt + 1)) AS s1 FROM pt JOIN prof USING (gram)
        GROUP BY conv_id, turn, lang),
cand AS (SELECT tot.conv_id, tot.turn, langs.lang, coalesce(hit.s1, 0) - tot.n * langs.lz AS score
         FROM tot CROSS JOIN langs LEFT JOIN hit
           ON hit.conv_id = tot.conv_id AND hit.turn = tot.turn AND hit.lang = langs.lang),
best AS (SELECT conv_id, turn, lang, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, lang) AS rn
         FROM cand)
SELECT conv_id, turn, lang FROM short
UNION ALL SELECT conv_id, turn, lang FROM best WHERE rn = 1""")
def language_detect(spark, sf_dir):
    profiles = ops.language_profiles(read_table(spark, sf_dir, "documents"))
    users = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return ops.detect_language(users, profiles, ["conv_id", "turn"])
