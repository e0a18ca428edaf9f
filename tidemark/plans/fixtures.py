"""The driver's tables as posts, authors, captions, trend samples, predictions and so on.

Each adapter is one SELECT over named views that Spark and DuckDB read alike, so a query and its SQL twin start from the same
rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

POSTS = """
SELECT o.o_orderkey AS post_id, o.o_custkey AS author_id,
  CASE WHEN o.o_custkey % 7 = 0 THEN NULL ELSE c.c_mktsegment END AS niche, o.o_orderdate AS posted_at,
  coalesce(l.likes, 0) AS likes, coalesce(l.comments, 0) AS comments, coalesce(l.saves, 0) AS saves, coalesce(l.shares, 0) AS shares,
  CAST(floor(o.o_totalprice / 100) AS BIGINT) AS views,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'reel' WHEN '2-HIGH' THEN 'carousel' WHEN '3-MEDIUM' THEN 'static_image'
    WHEN '4-NOT SPECIFIED' THEN 'story' ELSE 'tiktok_video' END AS content_format
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN (
  SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS likes, count(*) AS comments,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS saves,
    CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS shares
  FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
"""

AUTHORS = """
SELECT c_custkey AS author_id, c_name AS username, c_mktsegment AS niche, c_nationkey AS business_id,
  greatest(CAST(0 AS BIGINT), CAST(floor(c_acctbal) AS BIGINT)) * (1 + c_custkey % 40) AS followers
FROM customer
"""

CAPTIONS = """
SELECT post_id, content_format, CASE WHEN post_id % 17 = 0 THEN NULL WHEN post_id % 19 = 0 THEN '' ELSE concat_ws(' ',
  CASE WHEN post_id % 2 = 0 THEN '¿Cuál prefieres?' END, CASE WHEN post_id % 6 = 1 THEN '5 tips para tu casa' END,
  CASE WHEN post_id % 4 = 3 THEN concat('POV: descubre el secreto', chr(10), 'Historia de un café') END,
  CASE WHEN post_id % 3 = 0 THEN '😀😀 increíble descuento 🎉' END, CASE WHEN post_id % 5 = 0 THEN concat('#tag', post_id % 4, ' #Otro @handle') END,
  CASE WHEN post_id % 7 = 0 THEN 'Comenta y guarda, link en bio...' END, CASE WHEN post_id % 11 = 0 THEN 'mail me@host.example.com hoy' END) END AS caption
FROM posts
"""

# Every event is a sample. Users' numbers split trends by age or amount, so that fresh, stale and rare ones occur.
TRENDS = """
SELECT concat(event_type, '_', user_id % 20, CASE WHEN user_id % 20 < 8 THEN CASE WHEN age_hours <= 72 THEN '_new' WHEN age_hours > 336 THEN '_old' ELSE '_mid' END
    WHEN user_id % 20 < 12 THEN CASE WHEN age_hours <= 336 THEN '_late' ELSE '_early' END
    WHEN user_id % 20 = 19 THEN concat('_', CAST(floor(value * 10) AS BIGINT)) ELSE '' END) AS trend,
  event_id, event_type, ts AS posted_at, CAST(floor(value) AS BIGINT) AS likes, age_hours, user_id % 20 AS u FROM (
  SELECT *, (epoch_us_of(TIMESTAMP '2024-01-31 00:00:00') - epoch_us_of(ts)) / 3600000000.0 AS age_hours FROM events) e
"""

PREDICTIONS = """
SELECT l_orderkey, l_linenumber, l_partkey, ln(1 + l_quantity) AS y, ln(1 + l_quantity) + ((l_partkey % 21) - 10) / 50.0 AS p,
  CASE l_suppkey % 5 WHEN 0 THEN 'reel' WHEN 1 THEN 'carousel' WHEN 2 THEN 'static_image' WHEN 3 THEN 'story' ELSE 'tiktok_video' END AS content_format,
  CAST(l_partkey % 24 AS INT) AS hour, CAST(l_suppkey % 7 AS INT) AS weekday, CASE l_orderkey % 3 WHEN 0 THEN 'cafe' WHEN 1 THEN 'gym' ELSE 'shop' END AS niche
FROM lineitem
"""

ABLOGS = """
SELECT post_id, content_format, likes, comments, saves, shares, views, posted_at, niche,
  CAST(CASE WHEN post_id % 23 = 0 THEN 0 ELSE 50 + post_id % 40 END AS DOUBLE) AS predicted,
  round(CASE WHEN views > 0 THEN least(100.0, CAST(likes + comments * 3 + saves * 5 + shares * 4 AS DOUBLE) / views * 1000)
    ELSE least(100.0, CAST(likes + comments * 3 + saves * 5 + shares * 4 AS DOUBLE) / 10) END, 2) AS actual FROM posts
"""

#: Name, SELECT, and the names that it reads.
ADAPTERS = {"posts": POSTS, "authors": AUTHORS, "captions": CAPTIONS, "trends": TRENDS, "predictions": PREDICTIONS, "ab_logs": ABLOGS}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings conversations".split()
_NEEDS = {"captions": ["posts"], "ab_logs": ["posts"]}


_READS = re.compile(r"\b(FROM|JOIN) (" + "|".join([*TABLES, *ADAPTERS]) + r")\b")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter's rows, or a table's."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = ADAPTERS[name].replace("epoch_us_of(", "unix_micros(").replace("unix_micros(ts)", "unix_micros(cast(ts AS timestamp))")
    inputs = {m[2]: load(spark, sf_dir, m[2]) for m in _READS.finditer(sql)}
    return spark.sql(_READS.sub(r"\1 {\2}", sql), **inputs)


def with_adapters(sql: str, *names: str) -> str:
    """DuckDB SQL: ``sql`` after the adapters that it reads, as common table expressions."""
    wanted: list[str] = []
    for n in names:
        for need in [*_NEEDS.get(n, []), n]:
            if need not in wanted:
                wanted.append(need)
    parts = [f"{n} AS ({ADAPTERS[n].replace('epoch_us_of(', 'epoch_us(').strip()})" for n in wanted]
    sql = sql.strip()
    if sql[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + sql[5:]
    return "WITH " + ",\n".join(parts) + "\n" + sql
