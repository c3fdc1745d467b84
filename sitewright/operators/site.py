"""One site's tables, rows, paths and users out of a shared network."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.functions.paths import basename, dirname, is_under, normalize_path, with_self
from sitewright.operators.tree import below_any

# Fixed values of the site rules.
SITE_TABLES = ("posts", "postmeta", "comments", "commentmeta", "terms", "termmeta", "term_taxonomy", "term_relationships", "links")
NETWORK_KEYS = ("active_sitewide_plugins", "allowedthemes", "site_name", "admin_email", "upload_filetypes", "fileupload_maxk", "upload_space_check_disabled", "blog_upload_space", "WPLANG")
PROFILE_KEYS = ("first_name", "last_name", "nickname", "description", "rich_editing", "syntax_highlighting", "comment_shortcuts", "admin_color", "use_ssl", "show_admin_bar_front", "locale")
DENIED_OPTION_ENDINGS = ("_server_connection_token", "_server_push_authorized_token_fingerprint", "site_export_secret", "site_export_push_authorized_token_fingerprint")
CORE_FILES = (
    "index.php", "wp-activate.php", "wp-blog-header.php", "wp-comments-post.php", "wp-cron.php", "wp-links-opml.php", "wp-load.php", "wp-login.php",
    "wp-mail.php", "wp-settings.php", "wp-signup.php", "wp-trackback.php", "xmlrpc.php", "license.txt", "readme.html",
)
#: Name ending of an exporter's own saved user tables.
INTERNAL_ENDING = "_export_users"


def exclude_rows(df: DataFrame, rules: list[tuple[str, object]]) -> DataFrame:
    """Rows that equal no rule's (column, value); null rows stay, unknown columns are ignored."""
    for column, value in rules:
        if column in df.columns:
            df = df.where(~F.col(column).eqNullSafe(F.lit(value)))
    return df


def site_table_rule(name: Column, base_prefix: str, site_id: int) -> Column:
    """all, filtered, schema or skipped for a table of the network.

    The site's prefix ends in an underscore, so site 7's never matches site 70's.
    """
    own = base_prefix if site_id == 1 else f"{base_prefix}{site_id}_"
    internal = F.lower(name).endswith(INTERNAL_ENDING)
    return (
        F.when(name.isin(*(own + t for t in SITE_TABLES)), "all")
        .when(name == own + "options", "filtered")
        .when(name.isin(*(base_prefix + t for t in ("blogs", "blogmeta", "site", "sitemeta", "users", "usermeta"))), "filtered")
        .when(name.isin(base_prefix + "signups", base_prefix + "registration_log"), "schema")
        .when((F.lit(site_id) != 1) & name.startswith(own) & ~internal, "all")
        .otherwise("skipped")
    )


def site_rows(df: DataFrame, table: str, base_prefix: str, site_id: int, network_id: int = 1, users: DataFrame | None = None) -> DataFrame:
    """A table's rows that belong to the site (none for schema-only and skipped tables)."""
    own = base_prefix if site_id == 1 else f"{base_prefix}{site_id}_"
    if table in [own + t for t in SITE_TABLES]:
        return df
    if table == own + "options":
        denied = reduce(lambda a, b: a | b, (F.col("option_name").endswith(e) for e in DENIED_OPTION_ENDINGS))
        return df.where(~F.coalesce(denied, F.lit(False)))
    if table in (base_prefix + "blogs", base_prefix + "blogmeta"):
        return df.where(F.col("blog_id") == site_id)
    if table == base_prefix + "site":
        return df.where(F.col("id") == network_id)
    if table == base_prefix + "sitemeta":
        return df.where((F.col("site_id") == network_id) & F.col("meta_key").isin(*NETWORK_KEYS))
    if table in (base_prefix + "users", base_prefix + "usermeta"):
        if users is None:
            raise ValueError("the site's users are needed")
        if table.endswith("usermeta"):
            df = df.where(F.col("meta_key").isin(*PROFILE_KEYS, own + "capabilities", own + "user_level"))
            return df.join(users.select("user_id").distinct(), "user_id", "left_semi")
        return df.join(users.select(F.col("user_id").alias("ID")).distinct(), "ID", "left_semi")
    if site_id != 1 and table.startswith(own) and not table.lower().endswith(INTERNAL_ENDING):
        return df
    return df.limit(0)


def site_path_allowed(path: Column, root: str, content: str, uploads: str, site_id: int, exporter: str | None = None) -> Column:
    """Whether a path belongs to shared code or the site's uploads; the first rule that fits decides."""
    under = lambda roots: reduce(lambda a, b: a | b, (is_under(path, r) for r in roots))
    return (
        F.when(normalize_path(path) != path, False)
        .when(is_under(path, exporter) if exporter else F.lit(False), False)
        .when(under([f"{root}/wp-admin", f"{root}/wp-includes"]), True)
        .when(under([f"{content}/{d}" for d in ("plugins", "themes", "mu-plugins", "languages")]), True)
        .when(F.lit(site_id == 1) & is_under(path, f"{uploads}/sites"), False)
        .when(is_under(path, uploads), True)
        .when(is_under(F.lit(uploads), path) & is_under(path, root), True)
        .otherwise((dirname(path) == root) & basename(path).isin(*CORE_FILES))
    )


def nested_sites(blogs: DataFrame, roots: DataFrame, site_id: int) -> DataFrame:
    """Other sites whose path lies below a selected site's path on its domain.

    ``roots(domain, root)`` joins on the domain and an ancestor of the site's path, so it is
    an equi-join on both.
    """
    slash = lambda c: F.concat(F.rtrim(c, F.lit("/")), F.lit("/"))
    below = blogs.where(F.col("blog_id") != site_id).select("blog_id", "domain", "path", F.explode(with_self(F.rtrim("path", F.lit("/")))).alias("up"))
    below = below.withColumn("root", slash(F.col("up"))).unionByName(below.select("blog_id", "domain", "path", "up").distinct().where(F.col("path").startswith("/")).withColumn("root", F.lit("/")))
    wanted = roots.select("domain", slash(F.col("root")).alias("root")).distinct()
    return below.where(F.col("path") != F.col("root")).join(wanted, ["domain", "root"], "left_semi").select("blog_id", "domain", "path").distinct()


def in_child_site(urls: DataFrame, children: DataFrame) -> DataFrame:
    """The rows of ``urls(path, …)`` at or below a child site's ``path``, by decoded, lower-case path."""
    # Only %XX is decoded: a plus stays a plus.
    decoded = F.lower(F.try_url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))))
    bare = F.rtrim(F.coalesce(decoded, F.lower("path")), F.lit("/"))
    known = children.select(F.lower(F.rtrim("path", F.lit("/"))).alias("path"))
    inside = below_any(urls.select(bare.alias("path")).distinct(), known)
    return urls.withColumn("__bare", bare).join(inside.toDF("__bare"), "__bare", "left_semi").drop("__bare")


def collect_users(posts: DataFrame, comments: DataFrame, links: DataFrame, usermeta: DataFrame, capability: str) -> DataFrame:
    """``user_id, kind, ref`` of each user that the site refers to, by its first reference.

    References are visited posts, comments, links, then usermeta's rows of ``capability``,
    each by primary key; user 0 is no user. Inputs are ``(ref, user_id)``, usermeta also
    ``meta_key``. One aggregate keeps a row a user before the shuffle.
    """
    kinds = [(1, posts), (2, comments), (3, links), (4, usermeta.where(F.col("meta_key") == capability))]
    rows = reduce(DataFrame.unionByName, (df.select(F.col("user_id").cast("long").alias("user_id"), F.lit(k).alias("kind"), F.col("ref").cast("long").alias("ref")) for k, df in kinds))
    first = rows.where("user_id > 0").groupBy("user_id").agg(F.min(F.struct("kind", "ref")).alias("r"))
    return first.select("user_id", "r.kind", "r.ref")


def site_users(users: DataFrame, chosen: DataFrame) -> DataFrame:
    return users.join(chosen.select("user_id"), "user_id", "left_semi")


def broken_references(content: DataFrame, chosen: DataFrame, sources: DataFrame) -> DataFrame:
    """What breaks an export: content whose user is neither 0 nor chosen, and saved references
    that no longer hold. ``content(kind, ref, user_id)``, ``sources`` alike."""
    lost = content.where("user_id <> 0").join(chosen.select("user_id"), "user_id", "left_anti").select("user_id", "kind", "ref", F.lit("unknown user").alias("reason"))
    stale = chosen.join(sources.select("user_id", "kind", "ref"), ["user_id", "kind", "ref"], "left_anti").select("user_id", "kind", "ref", F.lit("stale reference").alias("reason"))
    return lost.unionByName(stale)


def check_references(content: DataFrame, chosen: DataFrame, sources: DataFrame) -> None:
    bad = broken_references(content, chosen, sources).take(1)
    if bad:
        raise ValueError(f"{bad[0]['reason']}: user {bad[0]['user_id']} of {bad[0]['kind']}/{bad[0]['ref']}")


def upsert_options(options: DataFrame, values: DataFrame) -> DataFrame:
    """``(option_name, option_value)`` with the named ones replaced or added."""
    return options.join(values.select("option_name"), "option_name", "left_anti").select("option_name", "option_value").unionByName(values.select("option_name", "option_value"))


def fill_missing(options: DataFrame, fallback: DataFrame) -> DataFrame:
    """``options`` with the fallback's rows for names that it lacks (an empty value is there)."""
    return options.select("option_name", "option_value").unionByName(fallback.join(options.select("option_name"), "option_name", "left_anti").select("option_name", "option_value"))


def content_tables(catalog: DataFrame, user_tables: list[str], id_only: list[str]) -> DataFrame:
    """Tables to visit before users: the selected ones but the users', and, if users are
    selected, those that are read for their user ids."""
    names = catalog.select("name")
    picked = names.where(F.col("name").isin(user_tables))
    extra = picked.limit(1).select(F.explode(F.array(*map(F.lit, id_only))).alias("name"))
    return names.where(~F.col("name").isin(user_tables)).unionByName(extra).distinct()


def user_tables(catalog: DataFrame, fixed: list[str]) -> DataFrame:
    """The fixed list's tables that are selected, with their place in it."""
    listed = F.array(*map(F.lit, fixed))
    return catalog.select("name").where(F.col("name").isin(fixed)).distinct().select("name", F.array_position(listed, F.col("name")).alias("place"))


def table_order(catalog: DataFrame, base_prefix: str, id_only: list[str] = ()) -> DataFrame:
    """``place, name``: content tables in catalog order, id-only ones, then users, usermeta.

    ``catalog(position, name)`` is a row a table, so one sorted task numbers it.
    """
    group = F.when(F.col("name") == base_prefix + "users", 2).when(F.col("name") == base_prefix + "usermeta", 3).when(F.col("name").isin(list(id_only)), 1).otherwise(0)
    from pyspark.sql import Window

    return catalog.select(F.row_number().over(Window.orderBy(group, "position")).cast("long").alias("place"), "name")


def snapshot_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, counted with repetitions; empty if they are equal."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def table_catalog(tables: dict[str, DataFrame], internal_ending: str = INTERNAL_ENDING) -> DataFrame:
    """``name, n_rows, data_bytes`` of each table by name, without internal ones."""

    def one(name: str, df: DataFrame) -> DataFrame:
        size = reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns))
        return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("data_bytes")).select(F.lit(name).alias("name"), "n_rows", "data_bytes")

    listed = [one(n, df) for n, df in sorted(tables.items()) if not n.endswith(internal_ending)]
    return reduce(DataFrame.unionByName, listed).orderBy("name")


def stored_catalog(tables: dict[str, DataFrame], internal_ending: str = INTERNAL_ENDING) -> DataFrame:
    """``name, n_rows, stored_bytes`` of each table of files by name, without internal ones.

    No column is read: row counts come from the files' footers, and bytes are the files' sizes
    as stored, compressed and with all columns (``table_catalog`` measures the values).
    """

    def one(name: str, df: DataFrame) -> DataFrame:
        files = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).groupBy("file", "size").agg(F.count("*").alias("n"))
        return files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("stored_bytes")).select(F.lit(name).alias("name"), "n_rows", "stored_bytes")

    listed = [one(n, df) for n, df in sorted(tables.items()) if not n.endswith(internal_ending)]
    return reduce(DataFrame.unionByName, listed).orderBy("name")


def catalog_totals(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count("*").alias("n_tables"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("data_bytes"), F.lit(0)).alias("data_bytes"))


def merge_activation(network: Column, site: Column, denied: list[str]) -> Column:
    """Sorted network plugins, then the site's, without repetition and denied basenames."""
    merged = F.array_distinct(F.concat(F.array_sort(F.coalesce(network, F.array().cast("array<string>"))), F.coalesce(site, F.array().cast("array<string>"))))
    return F.filter(merged, lambda p: ~basename(p).isin(denied)) if denied else merged


def site_mapping(sites: DataFrame, target: str) -> DataFrame:
    """``source, target`` rows for sites that leave a network: http and https forms of each
    home, and for uploads that stay remote, a rule that maps them to themselves.

    ``sites(home, uploads, keep_uploads)``; homes and uploads have no scheme.
    """
    schemes = F.explode(F.array(F.lit("http://"), F.lit("https://"))).alias("scheme")
    homes = sites.select("home", schemes).select(F.concat("scheme", "home").alias("source"), F.lit(target).alias("target"))
    stay = sites.where("keep_uploads").select("uploads", schemes).select(F.concat("scheme", "uploads").alias("source"), F.concat("scheme", "uploads").alias("target"))
    return homes.unionByName(stay).distinct()


def grant_role(users: DataFrame, usermeta: DataFrame, login: str | DataFrame, prefix: str, role: str = "administrator", level: int = 10) -> DataFrame:
    """``usermeta`` with the role's capabilities and level for the user of that login (a text, or
    a table of one cell).

    An unknown login is an error when the result is made.
    """
    named = users.where(F.col("user_login") == login) if isinstance(login, str) else users.join(login.toDF("user_login"), "user_login")
    found = named.agg(F.min("ID").alias("user_id"))
    user_id = F.when(F.col("user_id").isNull(), F.raise_error("no user has the login").cast("long")).otherwise(F.col("user_id"))
    value = f'a:1:{{s:{len(role.encode())}:"{role}";b:1;}}'
    rows = found.select(user_id.alias("user_id"), F.explode(F.array(*(F.struct(F.lit(prefix + k).alias("meta_key"), F.lit(v).alias("meta_value")) for k, v in (("capabilities", value), ("user_level", str(level)))))).alias("m")).select("user_id", "m.*")
    kept = usermeta.join(rows.select("user_id", "meta_key"), ["user_id", "meta_key"], "left_anti")
    return kept.select("user_id", "meta_key", "meta_value").unionByName(rows)


