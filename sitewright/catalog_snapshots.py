"""Queries over snapshots: diff, plans, maintenance, mapping, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.functions import paths, values
from sitewright.operators import diff, index, logs, site
from sitewright.plans import patch
from sitewright.registry import Registry
from sitewright.shared import make_dir, scratch_path
from sitewright.sources import index_json, publish, sql_dump, tree
from sitewright.views import CLOSURE_SQL, INDEX_SQL, PLAN_SQL, mutations, new_index, old_index, table

R = Registry()
INCLUDES, EXCLUDES = ["d1", "d4", "d4-x", "d6", "d10"], ["d1/s2", "d10/s1/o1"]
UNDER = "(path = '{r}' OR starts_with(path, '{r}/'))"
SELECTED_SQL = "((" + " OR ".join(UNDER.format(r=r) for r in INCLUDES) + ") AND NOT (" + " OR ".join(UNDER.format(r=r) + f" OR path = '{r}' OR starts_with('{r}', path || '/')" for r in EXCLUDES) + "))"


@R.query(INDEX_SQL + "SELECT path, ctime, size, type FROM new_index")
def s1_read_index(spark: SparkSession, d: str) -> DataFrame:
    return index_json.decode_index(index_json.encode_index(new_index(spark, d))).select("path", "ctime", "size", "type")


@R.query(
    """SELECT 'n=' || c_nationkey AS folder, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS size, 'file' AS type FROM customer GROUP BY 1
UNION ALL SELECT 'empty/' || r_regionkey, 0, 'dir' FROM region"""
)
def s2_list_tree(spark: SparkSession, d: str) -> DataFrame:
    """A tree written from the customers, a folder with one text file for each nation, and from
    the regions, an empty directory for each, as the executors list it."""
    root = scratch_path(spark, "tree")
    customers = table(spark, d, "customer").select(F.col("c_nationkey").alias("n"), "c_name").repartition("n")
    customers.write.partitionBy("n").text(root)
    for r in table(spark, d, "region").select("r_regionkey").collect():  # the directories' own table
        make_dir(spark, f"{root}/empty/{r[0]}")
    listed = tree.list_tree(spark, root).where("path NOT LIKE '%\\_SUCCESS%' AND path NOT LIKE '%.crc'")
    return listed.select(F.regexp_replace("path", "/part-[^/]*$", "").alias("folder"), "size", "type")


@R.query("SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS units FROM orders")
def s3_scan_table(spark: SparkSession, d: str) -> DataFrame:
    from sitewright.operators.rows import scan_table

    return scan_table(spark, f"{d}/orders.parquet", {"o_orderkey": F.col("o_orderkey"), "o_custkey": F.col("o_custkey"), "units": F.floor("o_totalprice").cast("long")})


@R.query("SELECT o_orderkey, o_custkey, o_totalprice, true AS balanced FROM orders")
def s3_key_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Orders by ranges of a composite key whose first part has few, heavy values: each row is in
    one range, and no range has over twice the rows of an even one."""
    from sitewright.operators.rows import scan_ranges

    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(F.col("o_custkey") % 4).alias("shop"))
    dealt = scan_ranges(orders, ["shop", "o_orderkey"], 8)
    sizes = dealt.groupBy("range_no").agg(F.count("*").alias("n")).agg((F.max("n") * 8 <= 2 * F.sum("n")).alias("balanced"))
    return dealt.where("range_no IS NOT NULL").join(F.broadcast(sizes), F.lit(True)).select("o_orderkey", "o_custkey", "o_totalprice", "balanced")


CATALOG = {"customer": ("c_custkey", "c_name", "c_mktsegment"), "documents": ("doc_id", "text", "lang", "source"), "nation": ("n_nationkey", "n_name"), "pages": ("page_id", "url", "html"), "events": ("event_id", "user_id", "event_type")}
CATALOG_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) AS n_rows, CAST(coalesce(sum({' + '.join(f'coalesce(strlen(CAST({c} AS VARCHAR)), 0)' for c in cs)}), 0) AS BIGINT) AS data_bytes FROM {t}" for t, cs in sorted(CATALOG.items())
)


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return site.table_catalog({t: table(spark, d, t).select(*cs) for t, cs in CATALOG.items()})


@R.query(CATALOG_SQL)
def s4_table_catalog(spark: SparkSession, d: str) -> DataFrame:
    return _catalog(spark, d)


@R.query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows, count(*) > 0 AS stored FROM {t}" for t in CATALOG))
def s4_stored_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Row counts and stored sizes by the files' footers alone."""
    found = site.stored_catalog({t: table(spark, d, t) for t in CATALOG})
    return found.select("name", "n_rows", (F.col("stored_bytes") > 0).alias("stored"))


@R.query(f"SELECT count(*) AS n_tables, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(data_bytes) AS BIGINT) AS data_bytes FROM ({CATALOG_SQL})")
def a2_catalog_totals(spark: SparkSession, d: str) -> DataFrame:
    return site.catalog_totals(_catalog(spark, d))


@R.query("SELECT doc_id, lang, text, n_chars FROM documents")
def s5_read_sql_dump(spark: SparkSession, d: str) -> DataFrame:
    """The documents table through a dump on disk and back."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text", "n_chars")
    path = scratch_path(spark, "dump")
    sql_dump.write_sql_dump(docs, "documents", path, ["doc_id"])
    return sql_dump.read_sql_dump(spark, path, "documents", docs.schema)


@R.query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def s6_write_sql_dump(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    statements = sql_dump.dump_statements(rows, "orders", ["o_orderkey"], max_rows=500, max_bytes=1 << 14)
    return sql_dump.parse_statements(statements.select(F.rtrim("value", F.lit(";")).alias("value")), "orders", rows.schema)


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return patch.plan_patch(old_index(spark, d), new_index(spark, d))


@R.query(INDEX_SQL + PLAN_SQL + "SELECT op, path FROM (SELECT 'copy' AS op, path FROM plan WHERE op IN ('copy', 'replace') UNION ALL SELECT 'delete', path FROM plan WHERE op IN ('delete', 'replace'))")
def s7_write_plan(spark: SparkSession, d: str) -> DataFrame:
    """The plan's two files, written and read back."""
    path = scratch_path(spark, "plan")
    plan = _plan(spark, d).withColumn("path", F.concat(F.lit("site/"), "path"))
    index_json.write_plan(plan, path, "site")
    copies = index_json.read_index(spark, f"{path}/copies").select(F.lit("copy").alias("op"), F.substring(F.col("path"), F.lit(6), F.char_length("path")).alias("path"))
    deletes = spark.read.text(f"{path}/deletes", lineSep="\0").select(F.lit("delete").alias("op"), F.col("value").alias("path"))
    return copies.unionByName(deletes)


@R.query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def s8_stage_and_publish(spark: SparkSession, d: str) -> DataFrame:
    """Orders and customers published together, and joined as the live version has them."""
    target = scratch_path(spark, "publish")
    both = {"orders": table(spark, d, "orders").select("o_orderkey", "o_custkey"), "customer": table(spark, d, "customer").select("c_custkey", "c_mktsegment")}
    publish.stage_and_publish(spark, both, target)
    orders, customer = publish.read_live(spark, target, "orders"), publish.read_live(spark, target, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", "c_mktsegment")


@R.query("SELECT 'sync_report' AS kind, 1 AS version, event_id FROM events WHERE event_id % 3 = 0 AND event_id % 5 <> 0")
def s11_read_reports(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    report = F.to_json(F.struct(F.lit("sync_report").alias("type"), F.when(F.col("event_id") % 5 == 0, 2).otherwise(1).alias("schema_version"), "event_id"))
    lines = e.select(F.when(F.col("event_id") % 3 == 0, report).otherwise(F.concat(F.lit("[info] {"), "event_type")).alias("value"))
    return index_json.read_reports(lines).select("kind", "version", F.get_json_object("record", "$.event_id").cast("long").alias("event_id"))


@R.query(
    INDEX_SQL
    + """SELECT path, path = 'd4' OR starts_with(path, 'd4/') AS under, starts_with(path, 'd1/') AS below,
  CASE WHEN starts_with(path, 'd1/s2/') THEN substr(path, 6) END AS remainder, CASE WHEN starts_with(path, 'd1/') THEN substr(path, 4) END AS relative FROM new_index"""
)
def p1_is_under(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return new_index(spark, d).select("path", paths.is_under(p, "d4").alias("under"), paths.is_below(p, "d1").alias("below"), paths.remainder_under(p, "d1/s2").alias("remainder"), paths.relative_under(p, "d1").alias("relative"))


@R.query(INDEX_SQL + f"SELECT path, size FROM new_index WHERE {SELECTED_SQL}")
def p2_select_paths(spark: SparkSession, d: str) -> DataFrame:
    return patch.select_paths(new_index(spark, d), INCLUDES, EXCLUDES).select("path", "size")


NAMES = ("wp-content/cache/a.css", "wp-content/uploads/a.LOG", "app/.git/config", "app/.github/x.yml", "wp-content/updraft/backup_1.zip", "a/#x#", "b/.#y", "c/page.php", "node_modules/x.js", "d/e.bak", "wp-content/updraft/log.a1.txt", "x/desktop.ini")
NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
SKIPPED = (True, True, True, False, True, True, True, False, False, True, True, True)


@R.query(f"SELECT o_orderkey || '/' || {NAMES_SQL}[1 + o_orderkey % {len(NAMES)}] AS path, [{', '.join(str(s).lower() for s in SKIPPED)}][1 + o_orderkey % {len(NAMES)}] AS skipped FROM orders")
def p3_default_skip(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, NAMES))
    p = table(spark, d, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit("/"), F.get(names, (F.col("o_orderkey") % len(NAMES)).cast("int"))).alias("path"))
    return p.select("path", paths.default_skip(F.col("path")).alias("skipped"))


ODD = ("aux.txt", "con .txt", "a:b", "end.", "ok.txt", "lpt1", "nul", "comma")
REASONS = ("aux.txt: device name AUX", "con .txt: device name CON", "a:b: reserved character :", "end.: ends in a dot", None, "lpt1: device name LPT1", "nul: device name NUL", None)


@R.query(f"SELECT 'x/' || [{', '.join(repr(o) for o in ODD)}][1 + o_orderkey % 8] || '/' || o_orderkey AS path, [{', '.join('NULL' if r is None else repr(r) for r in REASONS)}][1 + o_orderkey % 8] AS reason FROM orders")
def p4_unstorable_reason(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ODD))
    p = table(spark, d, "orders").select(F.concat(F.lit("x/"), F.get(names, (F.col("o_orderkey") % 8).cast("int")), F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"))
    return p.select("path", paths.unstorable_reason(F.col("path")).alias("reason"))


ENDINGS, ENDING_KINDS = ("php", "PNG", "neon", "mo", "svg", "blob"), ("yes", "no", "head", "no", "yes", "head")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """A file for each document: name by id, head from the text, binary for some."""
    docs = table(spark, d, "documents")
    ending = F.get(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % 6).cast("int"))
    head = F.when(F.col("doc_id") % 4 == 0, F.unhex(F.lit("0001FF"))).otherwise(F.encode(F.substring("lang", 1, 2), "utf-8"))
    return docs.select("doc_id", F.concat(F.lit("f/"), F.col("doc_id").cast("string"), F.lit("."), ending).alias("path"), head.alias("head"))


FILES_SQL = f"""files AS (
  SELECT doc_id, CASE [{', '.join(repr(k) for k in ENDING_KINDS)}][1 + doc_id % 6] WHEN 'head' THEN (CASE WHEN doc_id % 4 = 0 THEN 'no' ELSE 'yes' END) ELSE [{', '.join(repr(k) for k in ENDING_KINDS)}][1 + doc_id % 6] END AS kind
  FROM documents)"""


@R.query(f"WITH {FILES_SQL} SELECT doc_id, kind FROM files")
def p5_compressibility(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("doc_id", values.compressibility(F.col("path"), F.col("head")).alias("kind"))


@R.query(f"WITH {FILES_SQL} SELECT doc_id // 7 AS batch, bool_or(kind = 'yes') AS compressible FROM files GROUP BY 1")
def a4_batch_compressible(spark: SparkSession, d: str) -> DataFrame:
    return logs.batch_compressible(_files(spark, d).withColumn("batch", F.floor(F.col("doc_id") / 7).cast("long")))


J1_SQL = """
SELECT coalesce(o.path, n.path) AS path,
  CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted'
       WHEN o.type <> n.type OR o.size <> n.size OR o.ctime <> n.ctime THEN 'modified' ELSE 'unchanged' END AS change
FROM old_index o FULL JOIN new_index n ON o.path = n.path
"""


@R.query(INDEX_SQL + J1_SQL)
def j1_diff_index(spark: SparkSession, d: str) -> DataFrame:
    return diff.diff_index(old_index(spark, d), new_index(spark, d)).select("path", "change")


@R.query(
    INDEX_SQL
    + f""", diff AS ({J1_SQL})
SELECT path, change,
  CASE change WHEN 'added' THEN max(CASE WHEN change <> 'added' THEN path END) OVER back ELSE max(CASE WHEN change <> 'deleted' THEN path END) OVER back END AS before,
  CASE change WHEN 'added' THEN min(CASE WHEN change <> 'added' THEN path END) OVER ahead ELSE min(CASE WHEN change <> 'deleted' THEN path END) OVER ahead END AS after
FROM diff WINDOW back AS (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ahead AS (ORDER BY path ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
QUALIFY change IN ('added', 'deleted')"""
)
def j2_path_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return index.path_neighbours(diff.diff_index(old_index(spark, d), new_index(spark, d)))


@R.query(INDEX_SQL + PLAN_SQL + "SELECT path, op FROM plan")
def j3_plan_patch(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).select("path", "op")


@R.query(INDEX_SQL + PLAN_SQL + "SELECT m AS mode, path, op FROM plan, (VALUES ('catch-up'), ('mirror')) v(m)")
def j4_plan_sync(spark: SparkSession, d: str) -> DataFrame:
    """From the last snapshot, and from what the destination holds while the remote stood still."""
    old, new = old_index(spark, d), new_index(spark, d)
    modes = {"catch-up": patch.plan_sync("catch-up", old, new, new), "mirror": patch.plan_sync("mirror", new, new, old)}
    both = [plan.select(F.lit(mode).alias("mode"), "path", "op") for mode, plan in modes.items()]
    return both[0].unionByName(both[1])


@R.query(INDEX_SQL + PLAN_SQL + "SELECT coalesce(p.path, r.path) AS path, CASE WHEN r.path IS NULL THEN p.op WHEN p.op IN ('delete', 'replace') THEN 'replace' ELSE 'copy' END AS op FROM plan p FULL JOIN (SELECT path FROM new_index WHERE size % 5 = 0) r ON p.path = r.path")
def j5_require_copies(spark: SparkSession, d: str) -> DataFrame:
    old, new = old_index(spark, d), new_index(spark, d)
    return patch.require_copies(_plan(spark, d), old, new, new.where("size % 5 = 0").select("path")).select("path", "op")


@R.query(INDEX_SQL + PLAN_SQL + "SELECT count(*) AS n_copies, CAST(sum(n.size) AS BIGINT) AS n_bytes FROM plan p JOIN new_index n ON p.path = n.path WHERE op IN ('copy', 'replace')")
def a1_plan_summary(spark: SparkSession, d: str) -> DataFrame:
    return patch.plan_summary(_plan(spark, d))


MUTS_SQL = """, muts AS (
  SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 17 = 0 THEN '-' ELSE '+' END AS op, b.path, b.ctime, b.size + 7 AS size, b.type
  FROM base_entry b JOIN orders ON o_orderkey = k WHERE k % 17 = 0 OR k % 19 = 0
  UNION ALL SELECT 0, '-', 'd8', NULL, NULL, NULL FROM region WHERE r_regionkey = 0
)"""


@R.query(
    INDEX_SQL + MUTS_SQL + CLOSURE_SQL.format(name="chain", source="old_index")
    + "SELECT path, size FROM old_index WHERE path NOT IN (SELECT own FROM chain WHERE path IN (SELECT path FROM muts)) UNION ALL SELECT path, size FROM muts WHERE op = '+'"
)
def j6_apply_mutations(spark: SparkSession, d: str) -> DataFrame:
    return index.apply_mutations(old_index(spark, d), mutations(spark, d)).select("path", "size")


WAL_SQL = """SELECT path, ctime FROM (SELECT user_id || '' AS path, 0 AS ctime, event_id FROM events WHERE event_id % 10 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)
WHERE path NOT IN (SELECT user_id || '' FROM events)
UNION ALL SELECT user_id || '' AS path, event_id AS ctime FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'"""


@R.query(WAL_SQL)
def j7_apply_wal(spark: SparkSession, d: str) -> DataFrame:
    """Events as a change log by user: an error deletes."""
    e = table(spark, d, "events")
    start = e.where("event_id % 10 = 0").select(F.col("user_id").cast("string").alias("path")).distinct().select("path", F.lit(0).cast("long").alias("ctime"))
    log = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "-").otherwise("+").alias("op"), F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("ctime"))
    return index.apply_wal(start, log)


MAPPING = [("d1", "m/one"), ("d1/s2", "m/two"), ("d10", "m/ten")]
MAPPED_SQL = """, mapped AS (
  SELECT path, CASE WHEN starts_with(path, 'd1/s2/') THEN 'm/two' || substr(path, 6) WHEN starts_with(path, 'd1/') THEN 'm/one' || substr(path, 3)
    WHEN starts_with(path, 'd10/') THEN 'm/ten' || substr(path, 4) ELSE 'root/' || path END AS local FROM new_index)"""


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    mapping = table(spark, d, "region").where("r_regionkey = 0").select(F.explode(F.array(*(F.struct(F.lit(a).alias("prefix"), F.lit(b).alias("target")) for a, b in MAPPING))).alias("m")).select("m.*")
    return index.map_paths(new_index(spark, d), mapping, "root")


@R.query(INDEX_SQL + MAPPED_SQL + "SELECT path, local FROM mapped")
def j8_map_paths(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select("path", "local")


@R.query(
    INDEX_SQL + ", folded AS (SELECT regexp_replace(path, 'o([0-9]+)[0-9]$', 'o\\1') AS local FROM new_index)" + CLOSURE_SQL.format(name="chain", source="(SELECT local AS path FROM folded)")
    + """SELECT local, 'same' AS reason FROM folded GROUP BY local HAVING count(*) > 1
UNION ALL SELECT DISTINCT own AS local, 'below' AS reason FROM chain WHERE path <> own AND path IN (SELECT local FROM folded)"""
)
def j9_collisions(spark: SparkSession, d: str) -> DataFrame:
    folded = new_index(spark, d).select(F.regexp_replace("path", "o([0-9]+)[0-9]$", "o$1").alias("local"))
    return index.collisions(folded)


MERGE_SQL = """, s AS (SELECT path, CASE WHEN split_part(path, '/', 1) IN ('d1', 'd2') THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) WHEN split_part(path, '/', 1) = 'd3' THEN path ELSE split_part(path, '/', 1) END AS unit FROM new_index),
t AS (SELECT path, CASE WHEN split_part(path, '/', 1) IN ('d1', 'd2') THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) WHEN split_part(path, '/', 1) = 'd3' THEN path ELSE split_part(path, '/', 1) END AS unit FROM old_index WHERE size % 7 = 0)
SELECT replace(replace(replace(path, 'd1/', 'plugins/'), 'd2/', 'themes/'), 'd3/', 'uploads/') AS path FROM (SELECT path FROM t UNION ALL SELECT path FROM s WHERE unit NOT IN (SELECT unit FROM t))"""


@R.query(INDEX_SQL + MERGE_SQL)
def j15_merge_no_overwrite(spark: SparkSession, d: str) -> DataFrame:
    def named(df: DataFrame) -> DataFrame:
        p = F.col("path")
        for a, b in (("d1/", "plugins/"), ("d2/", "themes/"), ("d3/", "uploads/")):
            p = F.replace(p, F.lit(a), F.lit(b))
        return df.select(p.alias("path"))

    return index.merge_no_overwrite(named(new_index(spark, d)), named(old_index(spark, d).where("size % 7 = 0")))


@R.query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def w1_sort_dedup(spark: SparkSession, d: str) -> DataFrame:
    return index.sort_dedup(table(spark, d, "orders").select("o_custkey", "o_orderkey"), F.col("o_custkey"), F.col("o_orderkey"))


@R.query("SELECT o_orderkey, '/a/d' || (o_custkey % 9) || '/o' || o_orderkey AS path FROM orders")
def f16_normalize_path(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("/a/./x/../d"), (F.col("o_custkey") % 9).cast("string"), F.lit("//o"), F.col("o_orderkey").cast("string"), F.lit("/."))
    return table(spark, d, "orders").select("o_orderkey", paths.normalize_path(raw).alias("path"))


@R.query("SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey * 1024 WHEN 2 THEN floor((o_orderkey + 0.5) * 1048576) ELSE o_orderkey * 1073741824 END AS BIGINT) AS bytes FROM orders")
def f17_parse_size(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    text = F.when(k == 0, s).when(k == 1, F.concat(s, F.lit("K"))).when(k == 2, F.concat(s, F.lit(".5m"))).otherwise(F.concat(s, F.lit(" GB")))
    return table(spark, d, "orders").select("o_orderkey", paths.parse_size(text).alias("bytes"))


@R.query(INDEX_SQL + "SELECT path, 'rp.' || translate(to_base64(CAST(path AS BLOB)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') AS token, path AS back FROM new_index")
def f18_path_token(spark: SparkSession, d: str) -> DataFrame:
    token = paths.path_token(F.col("path"))
    return new_index(spark, d).select("path", token.alias("token"), paths.from_path_token(token).alias("back"))
