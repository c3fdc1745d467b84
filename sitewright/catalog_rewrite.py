"""Queries that rewrite content, and streaming jobs run to their end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewright.functions import rewrite, values
from sitewright.operators import changes
from sitewright.registry import Registry
from sitewright.shared import scratch_path
from sitewright.streaming import jobs
from sitewright.views import table

R = Registry()
OLD, NEW = "https://old.example", "https://new.test"
MAPPING = {OLD: NEW, "https://old.example/media": "https://cdn.test/m"}


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """Each page's path as one of an old site's, a third of them under /media."""
    path = F.regexp_replace(F.regexp_extract("url", "//[^/]*([^?#]*)", 1), "[^A-Za-z0-9/_.-]", "")
    return table(spark, d, "pages").select("page_id", F.concat(F.when(F.col("page_id") % 3 == 0, "/media").otherwise(""), F.when(path == "", "/").otherwise(path)).alias("p"))


PATHS_SQL = "WITH paths AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/media' ELSE '' END || CASE WHEN q = '' THEN '/' ELSE q END AS p, q FROM (SELECT page_id, regexp_replace(regexp_extract(url, '//[^/]*([^?#]*)', 1), '[^A-Za-z0-9/_.-]', '', 'g') AS q FROM pages)), moved AS (SELECT page_id, p, CASE WHEN page_id % 3 = 0 THEN 'https://cdn.test/m' || substr(p, 7) ELSE 'https://new.test' || p END AS u FROM paths) "


def _rewritten(spark: SparkSession, d: str, value: Column, **how) -> DataFrame:
    rows = _paths(spark, d).select("page_id", value.alias("v"))
    return rewrite.rewrite_column(rows, "v", how.pop("mapping", MAPPING), **how)


def _url() -> Column:
    return F.concat(F.lit(OLD), F.col("p"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@R.query(PATHS_SQL + "SELECT page_id, 'See ' || u || ', or \"' || replace(u, '/', '\\/') || '\" (not https://old.example.org/x).' AS v FROM moved")
def f1_rewrite_text(spark: SparkSession, d: str) -> DataFrame:
    return _rewritten(spark, d, _text("See ", _url(), ', or "', F.replace(_url(), F.lit("/"), F.lit("\\/")), '" (not https://old.example.org/x).'), form="text")


@R.query(PATHS_SQL + "SELECT page_id, 'https://old.example' || p || '?q=1' AS url, u || '?q=1' AS mapped FROM moved")
def f2_map_url(spark: SparkSession, d: str) -> DataFrame:
    urls = _paths(spark, d).select("page_id", _text(_url(), "?q=1").alias("url"))
    mapping = table(spark, d, "region").where("r_regionkey = 0").select(F.explode(F.array(*(F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in (("old.example", NEW), ("old.example/media", "https://cdn.test/m"))))).alias("m")).select("m.*")
    return rewrite.map_urls(urls, mapping)


@R.query(PATHS_SQL + "SELECT page_id, CASE page_id % 4 WHEN 0 THEN u || '#top' WHEN 1 THEN '#top' WHEN 2 THEN 'page.html' ELSE '//new.test/a' END AS v FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://cdn.test/m' || substr(p, 7) ELSE 'https://new.test' || p END AS u FROM paths)")
def f3_rewrite_url_field(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 4
    return _rewritten(spark, d, F.when(k == 0, _text(_url(), "#top")).when(k == 1, "#top").when(k == 2, "page.html").otherwise("//old.example/a"), form="url", base=OLD + "/")


@R.query(PATHS_SQL + "SELECT page_id, '<p class=\"x\"><a href=\"' || u || '?a=1&amp;b=2\">t</a> <img src=''' || u || ''' style=\"background:url(' || u || ')\"></p>' AS v FROM moved")
def f4_rewrite_html(spark: SparkSession, d: str) -> DataFrame:
    return _rewritten(spark, d, _text('<p class="x"><a href="', _url(), "?a=1&amp;b=2\">t</a> <img src='", _url(), "' style=\"background:url(", _url(), ')"></p>'), form="html")


@R.query(PATHS_SQL + "SELECT page_id, 'a{background:url(\"' || u || '\")} @import ''' || u || '''; b{background:url(data:image/png;base64,AA)}' AS v FROM moved")
def f5_rewrite_css(spark: SparkSession, d: str) -> DataFrame:
    return _rewritten(spark, d, _text('a{background:url("', _url(), "\")} @import '", _url(), "'; b{background:url(data:image/png;base64,AA)}"), form="css")


@R.query(PATHS_SQL + "SELECT page_id, '{\"https://old.example/key\": \"' || u || '\", \"n\": [1, \"' || replace(u, '/', '\\/') || '\"]}' AS v FROM moved")
def f6_rewrite_json_strings(spark: SparkSession, d: str) -> DataFrame:
    return _rewritten(spark, d, _text('{"https://old.example/key": "', _url(), '", "n": [1, "', F.replace(_url(), F.lit("/"), F.lit("\\/")), '"]}'), form="json")


@R.query(PATHS_SQL + "SELECT page_id, 'a:3:{s:3:\"url\";s:' || strlen(u) || ':\"' || u || '\";i:5;s:' || (strlen(u) + 7) || ':\"ü: ' || u || ' ok\";i:7;C:3:\"Own\":21:{https://old.example/a}}' AS v FROM moved")
def f7_rewrite_php_serialized(spark: SparkSession, d: str) -> DataFrame:
    n = F.octet_length(_url())
    return _rewritten(spark, d, _text('a:3:{s:3:"url";s:', n.cast("string"), ':"', _url(), '";i:5;s:', (n + 7).cast("string"), ':"ü: ', _url(), ' ok";i:7;C:3:"Own":21:{https://old.example/a}}'))


@R.query(PATHS_SQL + "SELECT page_id, '<!-- wp:image {\"id\":1,\"href\":\"' || u || '\"} --><figure><img src=\"' || u || '\"/></figure><!-- /wp:image -->' AS v FROM moved")
def f8_rewrite_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _rewritten(spark, d, _text('<!-- wp:image {"id":1,"href":"', _url(), '"} --><figure><img src="', _url(), '"/></figure><!-- /wp:image -->'), form="blocks")


@R.query(
    PATHS_SQL
    + "SELECT page_id, '[vc_raw_html]' || to_base64(CAST('<a href=\"' || u || '\">x</a>' AS BLOB)) || '[/vc_raw_html][vc_video link=\"' || replace(u, '/', '\\/') || '\"]'"
    " || '[vc_gitem_zone_a url=\"url:' || url_encode(u) || '|title:a%20b\"][vc_table][c]' || url_encode(u) || ',x|' || url_encode(u) || '[/vc_table]' AS v FROM moved"
)
def f9_rewrite_shortcodes(spark: SparkSession, d: str) -> DataFrame:
    body = F.translate(F.base64(_text('<a href="', _url(), '">x</a>').cast("binary")), "\r\n", "")
    zone = _text('[vc_gitem_zone_a url="url:', F.url_encode(_url()), '|title:a%20b"][vc_table][c]', F.url_encode(_url()), ",x|", F.url_encode(_url()), "[/vc_table]")
    return _rewritten(spark, d, _text("[vc_raw_html]", body, '[/vc_raw_html][vc_video link="', F.replace(_url(), F.lit("/"), F.lit("\\/")), '"]', zone), hint="markup")


@R.query(PATHS_SQL + "SELECT page_id, '<script type=\"application/json\">{\"u\": \"' || u || '\"}</script><script>var a = 1;</script>' AS v FROM moved")
def f10_rewrite_json_script(spark: SparkSession, d: str) -> DataFrame:
    return _rewritten(spark, d, _text('<script type="application/json">{"u": "', _url(), '"}</script><script>var a = 1;</script>'), form="html")


@R.query(PATHS_SQL + "SELECT page_id, CASE page_id % 4 WHEN 3 THEN '/path ' || u WHEN 0 THEN 'a:1:{i:0;s:' || strlen('{\"u\": \"' || u || '\"}') || ':\"{\"u\": \"' || u || '\"}\";}' WHEN 1 THEN '{\"u\": \"<a href=''' || u || '''>x</a>\"}' ELSE 'plain ' || u END AS v FROM moved")
def f11_rewrite_value(spark: SparkSession, d: str) -> DataFrame:
    inner = _text('{"u": "', _url(), '"}')
    k = F.col("page_id") % 4
    value = F.when(k == 3, _text("/path ", _url())).when(k == 0, _text("a:1:{i:0;s:", F.octet_length(inner).cast("string"), ':"', inner, '";}')).when(k == 1, _text("{\"u\": \"<a href='", _url(), "'>x</a>\"}")).otherwise(_text("plain ", _url()))
    return _rewritten(spark, d, value)


@R.query(PATHS_SQL + "SELECT page_id, 'https://old.example' || p AS guid, '<a href=\"' || u || '\">x</a>' AS post_content, '<img src=\"' || CASE WHEN page_id % 3 = 0 THEN '/m' || substr(p, 7) ELSE p END || '\">' AS post_content_filtered, u AS post_title FROM moved")
def f12_rewrite_tables(spark: SparkSession, d: str) -> DataFrame:
    """By default hints but for one of the caller's; root-relative links resolve on the base."""
    posts = _paths(spark, d).select("page_id", _url().alias("guid"), _text('<a href="', _url(), '">x</a>').alias("post_content"), _text('<img src="', F.col("p"), '">').alias("post_content_filtered"), _url().alias("post_title"))
    return rewrite.rewrite_tables({"n_7_posts": posts}, MAPPING, prefix="n_7_", hints={"posts.guid": "skip"}, base=OLD + "/")["n_7_posts"]


@R.query("SELECT page_id, page_id % 3 = 0 OR page_id % 5 = 0 OR page_id % 7 = 0 OR contains(lower(url), 'example.com') OR contains(url, '&') OR contains(lower(url), 'src=') OR contains(lower(url), 'href=') AS may FROM pages")
def f13_may_contain_url(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    v = F.when(k % 3 == 0, "x HTTPS://Old.Example/a").when(k % 5 == 0, "a &amp; b").when(k % 7 == 0, "<a HREF='/x'>").otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", values.may_contain_url(v, ["old.example", "example.com"]).alias("may"))


@R.query("SELECT page_id, contains(b, 'aHR0') OR contains(b, 'dHA6') OR contains(b, 'dHBz') OR contains(b, 'dHRw') AS may FROM (SELECT page_id, to_base64(encode(CASE WHEN page_id % 2 = 0 THEN repeat('#', CAST(page_id % 3 AS INT)) || url ELSE html END)) AS b FROM pages)")
def f14_b64_may_contain_http(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("page_id") % 2 == 0, F.concat(F.repeat(F.lit("#"), (F.col("page_id") % 3).cast("int")), "url")).otherwise(F.col("html"))
    coded = F.translate(F.base64(text.cast("binary")), "\r\n", "")
    return table(spark, d, "pages").select("page_id", values.b64_may_contain_http(coded).alias("may"))


@R.query("SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) / 7 AS x, true AS shaped FROM orders")
def f19_float_text(spark: SparkSession, d: str) -> DataFrame:
    """The texts, read back as numbers, and whether they have 17 significant digits."""
    text = values.float_text(F.col("o_totalprice").cast("double") / 7)
    return table(spark, d, "orders").select("o_orderkey", text.cast("double").alias("x"), text.rlike(r"^-?\d\.\d{16}e[+-]\d\d+$").alias("shaped"))


@R.query(PATHS_SQL + "SELECT page_id, 'v' AS \"column\", 'at https://old.example' || p AS old, 'at ' || u AS new FROM moved WHERE page_id % 2 = 0")
def j17_rewrite_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = _paths(spark, d).select("page_id", F.when(F.col("page_id") % 2 == 0, _text("at ", _url())).otherwise("none").alias("v"))
    return changes.rewrite_changes(rows, ["page_id"], ["v"], MAPPING)


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "-").otherwise("+").alias("op"), F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("ctime"), F.lit(1).cast("long").alias("size"), F.lit("file").alias("type"))


LAST_SQL = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)"


@R.query(
    f"""SELECT user_id || '' AS path, event_id AS ctime FROM {LAST_SQL} WHERE n = 1 AND event_type <> 'error'
UNION ALL SELECT 'c' || c_custkey, 0 FROM customer"""
)
def st1_stream_wal(spark: SparkSession, d: str) -> DataFrame:
    """Events as change-log files over an index of customers, in four parts by their numbers, each
    followed after a restart; the last version of the index."""
    base = scratch_path(spark, "wal")
    start = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.lit(0).cast("long").alias("ctime"), F.lit(1).cast("long").alias("size"), F.lit("file").alias("type"))
    log = _log(spark, d)
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    parted = log.withColumn("part", F.floor((F.col("seq") - low) * 4 / (high - low + 1)))
    for part in range(4):
        parted.where(F.col("part") == part).drop("part").write.mode("append").json(f"{base}/log")
        jobs.stream_wal(spark, f"{base}/log", start, f"{base}/index", f"{base}/checkpoint").awaitTermination()
    return jobs.read_followed(spark, f"{base}/index").select("path", "ctime")


@R.query(f"SELECT user_id AS key, event_id AS seq, event_type = 'error' AS deleted FROM {LAST_SQL} WHERE n = 1")
def st2_stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """Keyed last-change state over events in four files, newest first, in batches of one file and
    with a restart, so that state is carried over and older changes must not win."""
    base = scratch_path(spark, "latest")
    rows = table(spark, d, "events").select(F.col("user_id").cast("long").alias("key"), F.col("event_id").alias("seq"), F.col("value").cast("double").alias("value"), (F.col("event_type") == "error").alias("deleted"))
    parts = rows.withColumn("part", F.pmod(-F.col("seq"), F.lit(4)))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for half in ((0, 1), (2, 3)):
            for part in half:
                parts.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{base}/in")
            latest = jobs.stream_latest(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))
            write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/n={n}")
            latest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    # The update of a key's last batch is its state.
    return spark.read.parquet(f"{base}/out").groupBy("key").agg(F.max_by(F.struct("seq", "deleted"), "n").alias("s")).select("key", "s.seq", "s.deleted")


@R.query("SELECT 'links' AS table_name, count(*) AS n_processed, count(*) FILTER (page_id % 3 > 0) AS n_changed FROM pages UNION ALL SELECT 'plain', count(*), 0 FROM pages")
def a3_observed_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a rewrite from the pass that writes it."""
    rows = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 > 0, _text("at ", OLD, "/", F.col("page_id").cast("string"))).otherwise("none").alias("v"))
    return changes.write_rewritten({"links": rows, "plain": rows}, {"links": ["v"]}, MAPPING, scratch_path(spark, "counted"))


@R.query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'view' ELSE 'at https://new.test/' || event_type || CASE WHEN event_id % 50 = 0 THEN '/' || event_id ELSE '' END END AS v FROM events")
def f11_rewrite_repeated(spark: SparkSession, d: str) -> DataFrame:
    """Values of which most repeat: those are rewritten once and joined back."""
    e = table(spark, d, "events")
    own = F.when(F.col("event_id") % 50 == 0, _text("/", F.col("event_id").cast("string"))).otherwise("")
    rows = e.select("event_id", F.when(F.col("event_type") == "view", "view").otherwise(_text("at ", OLD, "/", F.col("event_type"), own)).alias("v"))
    return rewrite.rewrite_repeated(rows, "v", MAPPING)


@R.query(PATHS_SQL + "SELECT page_id, 'at ' || u AS v FROM moved")
def st3_stream_rewrite(spark: SparkSession, d: str) -> DataFrame:
    base = scratch_path(spark, "rewrite")
    rows = _paths(spark, d).select("page_id", _text("at ", _url()).alias("v"))
    rows.write.parquet(f"{base}/in")
    done = jobs.stream_rewrite(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), "v", MAPPING)
    done.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


@R.query("SELECT part, 'n=' || c_nationkey AS folder, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS size FROM customer, (VALUES ('a'), ('b')) v(part) GROUP BY 1, 2")
def st4_stream_scan(spark: SparkSession, d: str) -> DataFrame:
    """A tree of text files scanned, extended and scanned again: each file is seen once."""
    base = scratch_path(spark, "scan")
    customers = table(spark, d, "customer").select(F.col("c_nationkey").alias("n"), "c_name").repartition("n")
    for part in ("a", "b"):
        customers.write.partitionBy("n").text(f"{base}/tree/{part}")
        jobs.stream_scan(spark, f"{base}/tree", f"{base}/index", f"{base}/checkpoint").awaitTermination()
    file = r"/tree/([ab])/(n=[0-9]+)/part-[^/]*$"
    rows = spark.read.parquet(f"{base}/index").where(F.col("path").rlike(file))
    return rows.select(F.regexp_extract("path", file, 1).alias("part"), F.regexp_extract("path", file, 2).alias("folder"), "size")
