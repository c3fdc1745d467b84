"""Queries over one site's tables, users and rows, logs and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.functions import values
from sitewright.operators import changes, logs, rows, site
from sitewright.registry import Registry
from sitewright.views import table

R = Registry()


@R.query("SELECT event_id, event_type FROM events WHERE event_type IS DISTINCT FROM 'error'")
def p6_exclude_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type")
    return site.exclude_rows(e, [("event_type", "error"), ("no_such_column", "x")])


SUFFIXES = ("posts", "options", "orders", "export_users", "reviews")
FIXED = ("n_blogs", "n_usermeta", "n_signups", "n_orders", "other", "n_registration_log")


def _names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    own = F.concat(F.lit("n_"), (F.col("k") % 80).cast("string"), F.lit("_"), F.get(F.array(*map(F.lit, SUFFIXES)), (F.col("k") % 5).cast("int")))
    return c.select("k", F.when(F.col("k") % 10 == 0, F.get(F.array(*map(F.lit, FIXED)), (F.floor(F.col("k") / 10) % 6).cast("int"))).otherwise(own).alias("name"))


NAMES_SQL = f"""names AS (
  SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN [{', '.join(map(repr, FIXED))}][CAST(1 + (c_custkey // 10) % 6 AS INT)]
    ELSE 'n_' || (c_custkey % 80) || '_' || [{', '.join(map(repr, SUFFIXES))}][CAST(1 + c_custkey % 5 AS INT)] END AS name FROM customer)"""


@R.query(
    f"""WITH {NAMES_SQL} SELECT k, name, CASE WHEN name = 'n_7_posts' THEN 'all' WHEN name IN ('n_7_options', 'n_blogs', 'n_usermeta') THEN 'filtered'
  WHEN name IN ('n_signups', 'n_registration_log') THEN 'schema' WHEN starts_with(name, 'n_7_') AND NOT name LIKE '%\\_export\\_users' ESCAPE '\\' THEN 'all' ELSE 'skipped' END AS rule FROM names"""
)
def p7_site_table_rule(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("k", "name", site.site_table_rule(F.col("name"), "n_", 7).alias("rule"))


KEYS = ("first_name", "n_7_capabilities", "n_8_capabilities", "session_tokens")


def _usermeta(spark: SparkSession, d: str) -> DataFrame:
    """Profile rows of each customer: ``umeta_id, user_id, meta_key``."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("meta_key")) for i, k in enumerate(KEYS)))).alias("m")
    return c.select("user_id", pairs).where("m.i = 0 OR m.i = 3 OR (user_id % 3 = 0 AND m.i = 1) OR (user_id % 3 = 1 AND m.i = 2)").select((F.col("user_id") * 4 + F.col("m.i")).alias("umeta_id"), "user_id", "m.meta_key")


USERMETA_SQL = f"""usermeta AS (
  SELECT c_custkey * 4 + i AS umeta_id, c_custkey AS user_id, [{', '.join(map(repr, KEYS))}][1 + i] AS meta_key
  FROM customer, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE i IN (0, 3) OR (c_custkey % 3 = 0 AND i = 1) OR (c_custkey % 3 = 1 AND i = 2))"""
USERS_SQL = (
    f"WITH {USERMETA_SQL}"
    + """, refs AS (
  SELECT CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_custkey END AS user_id, 1 AS kind, o_orderkey AS ref FROM orders
  UNION ALL SELECT user_id, 2, event_id FROM events
  UNION ALL SELECT s_nationkey, 3, s_suppkey FROM supplier
  UNION ALL SELECT user_id, 4, umeta_id FROM usermeta WHERE meta_key = 'n_7_capabilities'
), chosen AS (SELECT user_id, kind, ref FROM refs WHERE user_id > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY kind, ref) = 1)
"""
)


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    posts = table(spark, d, "orders").select(F.col("o_orderkey").alias("ref"), F.when(F.col("o_orderkey") % 9 == 0, 0).otherwise(F.col("o_custkey")).cast("long").alias("user_id"))
    comments = table(spark, d, "events").select(F.col("event_id").alias("ref"), F.col("user_id").cast("long").alias("user_id"))
    links = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ref"), F.col("s_nationkey").cast("long").alias("user_id"))
    return posts, comments, links


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    return site.collect_users(*_references(spark, d), _usermeta(spark, d).withColumnRenamed("umeta_id", "ref"), "n_7_capabilities")


@R.query(USERS_SQL + "SELECT umeta_id, user_id, meta_key FROM usermeta WHERE meta_key IN ('first_name', 'n_7_capabilities') AND user_id IN (SELECT user_id FROM chosen)")
def p8_site_rows(spark: SparkSession, d: str) -> DataFrame:
    return site.site_rows(_usermeta(spark, d), "n_usermeta", "n_", 7, users=_chosen(spark, d)).select("umeta_id", "user_id", "meta_key")


TREE = ("wp-admin/a.php", "wp-content/plugins/p/p.php", "wp-content/uploads/sites/7/a.jpg", "wp-content/uploads/sites/70/a.jpg", "wp-content/debug.log", "index.php", "wp-content/uploads/sites", "wp-content/plugins/exporter/secret.php", "wp-config.php", "wp-content/uploads/sites/7/../8/x")
TREE_OK = (True, True, True, False, False, True, True, False, False, False)


@R.query(f"SELECT doc_id, [{', '.join(str(x).lower() for x in TREE_OK)}][CAST(1 + doc_id % 10 AS INT)] AS allowed FROM documents")
def p9_site_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/srv/"), F.get(F.array(*map(F.lit, TREE)), (F.col("doc_id") % 10).cast("int")))
    ok = site.site_path_allowed(path, "/srv", "/srv/wp-content", "/srv/wp-content/uploads/sites/7", 7, "/srv/wp-content/plugins/exporter")
    return table(spark, d, "documents").select("doc_id", ok.alias("allowed"))


@R.query(
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'NULL' WHEN doc_id % 11 = 0 THEN '''''' ELSE 'FROM_BASE64(''' || to_base64(encode(text)) || ''')' END AS text_value,
  CAST(n_chars AS VARCHAR) AS number_value, 'CONVERT(FROM_BASE64(''' || to_base64(encode('{"lang":"' || lang || '"}')) || ''') USING utf8mb4)' AS json_value FROM documents"""
)
def p10_project_encoded(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("text"))
    return table(spark, d, "documents").select(
        "doc_id",
        values.project_encoded(text, "text").alias("text_value"),
        values.project_encoded(F.col("n_chars"), "numeric").alias("number_value"),
        values.project_encoded(F.concat(F.lit('{"lang":"'), "lang", F.lit('"}')), "json").alias("json_value"),
    )


@R.query("SELECT doc_id, CASE WHEN b <= 2000 THEN lang END AS lang, CAST(b AS BIGINT) AS row_bytes, b > 2000 AS oversized FROM (SELECT *, strlen(CAST(doc_id AS VARCHAR)) + strlen(text) + strlen(lang) AS b FROM documents)")
def p11_withhold_oversized(spark: SparkSession, d: str) -> DataFrame:
    return rows.withhold_oversized(table(spark, d, "documents").select("doc_id", "text", "lang"), ["doc_id"], 2000).select("doc_id", "lang", "row_bytes", "oversized")


@R.query("SELECT o_orderkey, o_orderkey % 70000 AS srid FROM orders WHERE o_orderkey % 70000 <> 0 AND o_orderkey % 3 = 0")
def p12_nonzero_srid(spark: SparkSession, d: str) -> DataFrame:
    code = F.lpad(F.hex(F.col("o_orderkey") % 70000), 8, "0")
    turned = F.unhex(F.concat(*(F.substring(code, k, 2) for k in (7, 5, 3, 1)), F.lit("0101000000")))
    geo = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, turned).otherwise(F.unhex(F.lit("000000000101000000"))).alias("geom"))
    return geo.select("o_orderkey", values.srid(F.col("geom")).alias("srid")).where("srid <> 0")


@R.query("SELECT page_id FROM pages WHERE page_id % 4 = 0 AND url LIKE '%example.com%'")
def p13_find_leftovers(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "//([^/]*)", 1)
    coded = F.when((F.col("page_id") % 4 == 0) & host.contains("example.com"), F.lit("https%3A%2F%2FOLD.example%2Fa")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", coded.alias("v")).where(values.leftovers(F.col("v"), "old.example")).select("page_id")


def _blogs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.col("page_id").alias("blog_id"), F.regexp_extract("url", "//([^/]*)", 1).alias("domain"), F.concat(F.regexp_extract("url", "//[^/]*([^?#]*)", 1), F.lit("/")).alias("path"))


BLOGS_SQL = "blogs AS (SELECT page_id AS blog_id, regexp_extract(url, '//([^/]*)', 1) AS domain, regexp_extract(url, '//[^/]*([^?#]*)', 1) || '/' AS path FROM pages)"


@R.query(f"WITH {BLOGS_SQL} SELECT DISTINCT blog_id, domain, path FROM blogs WHERE blog_id <> 7 AND starts_with(path, '/en/') AND path <> '/en/' AND domain LIKE '%.example.com'")
def j10_nested_sites(spark: SparkSession, d: str) -> DataFrame:
    blogs = _blogs(spark, d)
    roots = blogs.where(F.col("domain").endswith(".example.com")).select("domain", F.lit("/en/").alias("root")).distinct()
    return site.nested_sites(blogs, roots, 7)


@R.query("SELECT page_id FROM (SELECT page_id, lower(regexp_extract(url, '//[^/]*([^?#]*)', 1)) AS p FROM pages) WHERE p = '/en' OR starts_with(p, '/en/') OR p = '/fr/825' OR starts_with(p, '/fr/825/')")
def j11_in_child_site(spark: SparkSession, d: str) -> DataFrame:
    urls = table(spark, d, "pages").select("page_id", F.replace(F.upper(F.regexp_extract("url", "//[^/]*([^?#]*)", 1)), F.lit("E"), F.lit("%45")).alias("path"))
    children = table(spark, d, "region").where("r_regionkey = 0").select(F.explode(F.array(F.lit("/en/"), F.lit("/fr/825"))).alias("path"))
    return site.in_child_site(urls, children).select("page_id")


@R.query(USERS_SQL + "SELECT user_id, kind, ref FROM chosen")
def j12_collect_users(spark: SparkSession, d: str) -> DataFrame:
    return _chosen(spark, d)


@R.query(USERS_SQL + "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM chosen)")
def j13_site_users(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return site.site_users(users, _chosen(spark, d)).select(F.col("user_id").alias("c_custkey"), "c_name")


@R.query(
    USERS_SQL
    + """SELECT user_id, kind, ref, 'unknown user' AS reason FROM refs WHERE kind < 4 AND user_id <> 0 AND user_id NOT IN (SELECT user_id FROM chosen WHERE user_id % 10 <> 3)
UNION ALL SELECT user_id, kind, ref, 'stale reference' FROM chosen WHERE user_id % 10 <> 3 AND ref % 50 = 0"""
)
def j14_check_references(spark: SparkSession, d: str) -> DataFrame:
    """With some users left out and some references gone: what the check reports."""
    content = [df.select(F.col("user_id"), F.lit(k).alias("kind"), F.col("ref").cast("long").alias("ref")) for k, df in enumerate(_references(spark, d), 1)]
    meta = _usermeta(spark, d).where("meta_key = 'n_7_capabilities'").select(F.col("user_id").cast("long").alias("user_id"), F.lit(4).alias("kind"), F.col("umeta_id").cast("long").alias("ref"))
    known = content[0].unionByName(content[1]).unionByName(content[2])
    return site.broken_references(known, _chosen(spark, d).where("user_id % 10 <> 3"), known.unionByName(meta).where("ref % 50 <> 0"))


@R.query("SELECT 'k' || c_custkey AS option_name, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE c_mktsegment END AS option_value FROM customer UNION ALL SELECT 'WPLANG', 'de' FROM region WHERE r_regionkey = 0")
def j16_upsert_options(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("option_name")
    options = table(spark, d, "customer").select("c_custkey", name, F.col("c_mktsegment").alias("option_value"))
    done = site.upsert_options(options, options.where("c_custkey % 5 = 0").select("option_name", F.lit("new").alias("option_value")))
    fallback = table(spark, d, "region").where("r_regionkey = 0").select(F.explode(F.array(F.struct(F.lit("WPLANG").alias("option_name"), F.lit("de").alias("option_value")), F.struct(F.lit("k1").alias("option_name"), F.lit("no").alias("option_value")))).alias("o")).select("o.*")
    return site.fill_missing(done, fallback)


@R.query(
    f"""WITH {USERMETA_SQL}, u AS (SELECT min(c_custkey) AS user_id FROM customer WHERE c_name = (SELECT c_name FROM customer WHERE c_custkey = 9))
SELECT user_id, meta_key, CAST(umeta_id AS VARCHAR) AS meta_value FROM usermeta WHERE NOT (meta_key = 'n_7_capabilities' AND user_id IN (SELECT user_id FROM u))
UNION ALL SELECT user_id, 'n_7_capabilities', 'a:1:{{s:13:"administrator";b:1;}}' FROM u UNION ALL SELECT user_id, 'n_7_user_level', '10' FROM u"""
)
def j19_grant_role(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer")
    login = customer.where("c_custkey = 9").select("c_name")
    users = customer.select(F.col("c_custkey").alias("ID"), F.col("c_name").alias("user_login"))
    meta = _usermeta(spark, d).select("user_id", "meta_key", F.col("umeta_id").cast("string").alias("meta_value"))
    return site.grant_role(users, meta, login, "n_7_")


@R.query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0 THEN 'new' WHEN o_orderkey % 3 = 0 THEN 'edited' ELSE o_orderstatus END AS o_orderstatus FROM orders"""
)
def j18_apply_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes meet rows that were edited meanwhile: those keep the newer value."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    change = o.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("o_orderstatus").alias("column"), F.col("o_orderstatus").alias("old"), F.lit("new").alias("new"))
    now = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "edited").otherwise(F.col("o_orderstatus")))
    return changes.apply_changes(now, ["o_orderkey"], change)


@R.query("SELECT 'lang_' || lang AS table_name, count(*) AS n_processed, CAST(count(*) FILTER (doc_id % 4 = 0) AS BIGINT) AS n_changed FROM documents GROUP BY 1")
def a3_rewrite_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("lang_"), "lang").alias("table_name"), F.col("doc_id").alias("id"))
    return changes.rewrite_stats(docs, docs.where("id % 4 = 0"))


RULES = (("alpha", "view", 0.25), ("alpha", "click", 0.5), ("alpha", "error", 0.5), ("beta", "purchase", 0.75), ("beta", "click", 0.125), ("gamma", "signup", 0.25))


@R.query(
    f"""WITH rules(host, signal, score) AS (VALUES {', '.join(map(str, RULES))}), s AS (SELECT DISTINCT user_id AS site, event_type AS signal FROM events),
scored AS (SELECT site, host, least(sum(score), 1.0) AS score FROM s JOIN rules USING (signal) GROUP BY 1, 2 HAVING sum(score) >= 0.5),
best AS (SELECT site, host, score FROM scored QUALIFY row_number() OVER (PARTITION BY site ORDER BY score DESC, host DESC) = 1)
SELECT a.site, coalesce(host, 'other') AS host, CAST(coalesce(score, 0) * 1000 AS BIGINT) AS score FROM (SELECT DISTINCT site FROM s) a LEFT JOIN best b ON a.site = b.site"""
)
def a5_detect_host(spark: SparkSession, d: str) -> DataFrame:
    signals = table(spark, d, "events").select(F.col("user_id").alias("site"), F.col("event_type").alias("signal"))
    rules = table(spark, d, "region").where("r_regionkey = 0").select(F.explode(F.array(*(F.struct(F.lit(h).alias("host"), F.lit(s).alias("signal"), F.lit(x).alias("score")) for h, s, x in RULES))).alias("r")).select("r.*")
    return logs.detect_host(signals, rules).withColumn("score", (F.col("score") * 1000).cast("long"))


@R.query(
    """WITH e AS (SELECT user_id AS command, event_type AS phase, CASE WHEN event_id % 3 = 0 THEN event_id || '' END AS label, CASE WHEN event_id % 2 = 0 THEN event_id END AS done, event_id AS ts FROM events),
r AS (SELECT *, sum(c) OVER (PARTITION BY command ORDER BY ts) AS run FROM (SELECT *, CASE WHEN phase = lag(phase) OVER (PARTITION BY command ORDER BY ts) THEN 0 ELSE 1 END AS c FROM e))
SELECT command, phase, max(label) FILTER (label_ts = best_label) AS label, max(done) AS done, max(ts) AS ts FROM (
  SELECT *, CASE WHEN label IS NOT NULL THEN ts END AS label_ts, max(CASE WHEN label IS NOT NULL THEN ts END) OVER (PARTITION BY command, run) AS best_label, max(run) OVER (PARTITION BY command) AS last_run FROM r)
WHERE run = last_run GROUP BY command, phase"""
)
def a6_latest_progress(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("command"), F.col("event_type").alias("phase"), F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).alias("label"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("done"), F.col("event_id").alias("ts"))
    return logs.latest_progress(e)


@R.query("SELECT c_custkey, 'a/a.php,b/b.php' || CASE WHEN c_custkey % 2 = 0 THEN ',p' || c_custkey || '/x.php' ELSE '' END AS plugins FROM customer")
def a7_merge_activation(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("a/a.php"), F.concat(F.lit("p"), F.col("c_custkey").cast("string"), F.lit("/x.php")))).otherwise(F.array(F.lit("z/deny.php")))
    merged = site.merge_activation(F.array(F.lit("b/b.php"), F.lit("a/a.php")), own, ["deny.php"])
    return table(spark, d, "customer").select("c_custkey", F.array_join(merged, ",").alias("plugins"))


@R.query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey > 40 OR (o_custkey = 40 AND o_orderkey > 100) ORDER BY 1, 2 LIMIT 25")
def w2_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return rows.keyset_page(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], (40, 100), 25)


@R.query("SELECT c_custkey, c_name FROM customer ORDER BY 1, 2 LIMIT 20 OFFSET 30")
def w3_offset_page(spark: SparkSession, d: str) -> DataFrame:
    return rows.offset_page(table(spark, d, "customer").select("c_custkey", "c_name"), 30, 20)


@R.query(
    """WITH RECURSIVE d AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
packed AS (
  SELECT doc_id, source, k, CAST(0 AS BIGINT) AS batch, 1 AS n, CAST(n_chars AS BIGINT) AS size FROM d WHERE k = 1
  UNION ALL SELECT d.doc_id, d.source, d.k, CASE WHEN fits THEN batch ELSE batch + 1 END, CASE WHEN fits THEN n + 1 ELSE 1 END, CASE WHEN fits THEN size + d.n_chars ELSE d.n_chars END
  FROM (SELECT *, k + 1 AS next FROM packed) p JOIN d ON d.source = p.source AND d.k = p.next, LATERAL (SELECT p.n < 4 AND p.size + d.n_chars <= 3000 AS fits)
) SELECT doc_id, source, batch FROM packed"""
)
def w4_pack_batches(spark: SparkSession, d: str) -> DataFrame:
    """Both bounds act: four rows or 3,000 characters."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return rows.pack_batches(docs, "source", ["doc_id"], "n_chars", 4, 3000).select("doc_id", "source", "batch")


@R.query("SELECT doc_id, source, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5 AS BIGINT) AS batch FROM documents")
def w4_fixed_batches(spark: SparkSession, d: str) -> DataFrame:
    return rows.fixed_batches(table(spark, d, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 5)


@R.query(f"WITH {NAMES_SQL} SELECT row_number() OVER (ORDER BY CASE name WHEN 'n_usermeta' THEN 3 WHEN 'n_blogs' THEN 1 ELSE 0 END, p) AS place, name FROM (SELECT name, min(k) AS p FROM names GROUP BY 1)")
def w5_table_order(spark: SparkSession, d: str) -> DataFrame:
    catalog = _names(spark, d).groupBy("name").agg(F.min("k").alias("position"))
    return site.table_order(catalog, "n_", ["n_blogs"])


@R.query(USERS_SQL.split(", chosen")[0] + "SELECT kind, count(*) AS n, CAST(sum(ref) AS BIGINT) AS refs FROM refs GROUP BY kind")
def u1_union_references(spark: SparkSession, d: str) -> DataFrame:
    parts = [df.select(F.lit(k).alias("kind"), F.col("ref").cast("long").alias("ref")) for k, df in enumerate(_references(spark, d), 1)]
    meta = _usermeta(spark, d).where("meta_key = 'n_7_capabilities'").select(F.lit(4).alias("kind"), F.col("umeta_id").cast("long").alias("ref"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(meta).groupBy("kind").agg(F.count("*").alias("n"), F.sum("ref").alias("refs"))


@R.query(f"WITH {NAMES_SQL} SELECT DISTINCT name FROM names WHERE name NOT IN ('n_users', 'n_usermeta') UNION SELECT unnest(['n_7_posts', 'n_7_comments', 'n_7_links']) FROM (SELECT 1 FROM names WHERE name = 'n_usermeta' LIMIT 1)")
def u2_content_tables(spark: SparkSession, d: str) -> DataFrame:
    return site.content_tables(_names(spark, d), ["n_users", "n_usermeta"], ["n_7_posts", "n_7_comments", "n_7_links"])


@R.query(f"WITH {NAMES_SQL} SELECT DISTINCT name, CAST(2 AS BIGINT) AS place FROM names WHERE name = 'n_usermeta'")
def u3_user_tables(spark: SparkSession, d: str) -> DataFrame:
    return site.user_tables(_names(spark, d), ["n_users", "n_usermeta"]).select("name", F.col("place").cast("long").alias("place"))


@R.query("SELECT c_custkey, c_mktsegment, 'left' AS side FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT c_custkey, 'moved', 'right' FROM customer WHERE c_custkey % 6 = 0")
def u4_snapshot_difference(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return site.snapshot_difference(c, c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 6 == 0, "moved").otherwise(F.col("c_mktsegment"))))


@R.query("SELECT doc_id, CAST(64 * i AS BIGINT) AS \"offset\", substr(h, CAST(128 * i + 1 AS INT), 128) AS data, i = 0 AS is_first, i = n - 1 AS is_last FROM (SELECT doc_id, h, n, unnest(range(0, n)) AS i FROM (SELECT doc_id, hex(encode(text)) AS h, greatest(1, CAST(ceil(strlen(text) / 64.0) AS BIGINT)) AS n FROM documents))")
def s9_chunk_values(spark: SparkSession, d: str) -> DataFrame:
    c = rows.chunk_values(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text", 64)
    return c.withColumn("data", F.hex("data"))


@R.query("SELECT doc_id, text FROM documents")
def s10_assemble_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = rows.chunk_values(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text", 64)
    return rows.assemble_chunks(c, ["doc_id"]).select("doc_id", F.col("value").cast("string").alias("text"))


@R.query(
    "SELECT source, target FROM (SELECT unnest(['http://', 'https://']) || h AS source, 'https://one.test' AS target FROM (SELECT DISTINCT regexp_extract(url, '//([^/]*)', 1) AS h FROM pages)"
    " UNION SELECT unnest(['http://', 'https://']) || h || '/wp-content/uploads', unnest(['http://', 'https://']) || h || '/wp-content/uploads' FROM (SELECT DISTINCT regexp_extract(url, '//([^/]*)', 1) AS h FROM pages WHERE url LIKE '%.net/%'))"
)
def f15_site_mapping(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "//([^/]*)", 1)
    sites = table(spark, d, "pages").select(host.alias("home"), F.concat(host, F.lit("/wp-content/uploads")).alias("uploads"), host.endswith(".net").alias("keep_uploads")).distinct()
    return site.site_mapping(sites, "https://one.test")
