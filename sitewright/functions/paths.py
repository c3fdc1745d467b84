"""Path predicates and transformations as Column expressions: no UDF, all pushed into codegen.

Paths are slash-delimited strings; comparisons are by bytes (UTF8_BINARY), which for valid
UTF-8 is byte order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_or_col(x: Column | str) -> Column:
    """A string argument is a value, not a column's name."""
    return F.lit(x) if isinstance(x, str) else x


def is_under(path: Column, root: Column | str) -> Column:
    """Equal to ``root`` or below it at a component boundary; a root ending in / is a prefix."""
    r = lit_or_col(root)
    return F.when(r.endswith("/"), path.startswith(r)).otherwise((path == r) | path.startswith(F.concat(r, F.lit("/"))))


def is_below(path: Column, root: Column | str) -> Column:
    return is_under(path, root) & (path != lit_or_col(root))


def remainder_under(path: Column, root: Column | str) -> Column:
    """What follows ``root`` (from its slash), empty for the root itself, null outside."""
    p, r = F.rtrim(path, F.lit("/")), F.rtrim(lit_or_col(root), F.lit("/"))
    return F.when(p == r, F.lit("")).when(p.startswith(F.concat(r, F.lit("/"))), F.substring(p, F.char_length(r) + 1, F.char_length(p)))


def relative_under(path: Column, root: Column | str) -> Column:
    """``path`` relative to ``root``; an empty root holds every relative path."""
    r = lit_or_col(root)
    bare = F.when(~path.startswith("/"), F.rtrim(path, F.lit("/")))
    return F.when(r == "", bare).otherwise(F.ltrim(remainder_under(path, r), F.lit("/")))


def ancestors(path: Column) -> Column:
    """All proper ancestors, nearest to the root first: of ``a/b/c`` they are ``a``, ``a/b``."""
    parts = F.split(path, "/")
    n = F.size(parts)
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.filter(prefixes, lambda p: p != ""))


def with_self(path: Column) -> Column:
    return F.array_append(ancestors(path), path)


def normalize_path(path: Column, windows: bool = False) -> Column:
    """Dot segments resolved below the root; a drive's or share's root stays."""
    if windows:
        path = F.replace(path, F.lit("\\"), F.lit("/"))
        path = F.when(path.rlike("^[a-z]:"), F.concat(F.upper(F.substring(path, 1, 1)), F.substring(path, F.lit(2), F.char_length(path)))).otherwise(path)
        share = F.regexp_extract(path, "^(//[^/]+/[^/]+)", 1)
        drive = F.regexp_extract(path, "^([A-Z]:)/", 1)
        root = F.when(share != "", share).otherwise(drive)
        rest = F.substring(path, F.char_length(root) + 1, F.char_length(path))
    else:
        share, root, rest = F.lit(""), F.lit(""), path
    step = lambda done, p: F.when(p.isin("", "."), done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p))
    parts = F.aggregate(F.split(rest, "/"), F.array().cast("array<string>"), step)
    body = F.array_join(parts, "/")
    return F.when((share != "") & (body == ""), share).otherwise(F.concat(root, F.lit("/"), body))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


# Fixed values of the default skip rule: directories of generated files, components,
# backup files by directory, and basenames.
GENERATED_DIRECTORIES = (
    "/wp-content/cache/", "/wp-content/upgrade/", "/wp-content/wpcomsh-cache/", "/wp-content/wflogs/", "/wp-content/wfcache/",
    "/wp-content/wpvividbackups/wpvivid_log/", "/wp-content/plugins/all-in-one-wp-migration/storage/",
    "/wp-content/uploads/backwpup-restore/", "/wp-content/uploads/backupbuddy_temp/",
    "/wp-content/uploads/pb_backupbuddy/", "/wp-content/uploads/wc-logs/", "/wp-content/uploads/wpallimport/logs/",
)
SKIPPED_COMPONENTS = (".git", ".svn", ".hg", ".bzr", ".idea", ".vscode", ".cache", ".npm", ".yarn", ".pnpm-store")
BACKUP_FILES = (
    ("/wp-content/updraft/", r"(?i)^backup_.*\.(?:gz(?:\.crypt)?|zip)$"),
    ("/wp-content/ai1wm-backups/", r"(?i)\.wpress$"),
    ("/wp-content/wpvividbackups/", r"(?i)_wpvivid-.*_backup_.*\.zip$"),
    ("/wp-content/backups-dup-lite/", r"(?i)_archive\.(?:daf|zip)$"),
    ("/wp-content/backups-dup-pro/", r"(?i)_archive\.(?:daf|zip)$"),
    ("/wp-content/backup-db/", r"(?i)\.sql(?:\.gz)?$"),
    ("/wp-content/backup-guard/", r"(?i)\.sgbp$"),
    ("/wp-content/uploads/backupbuddy_backups/", r"(?i)^backup-.*\.zip$"),
    ("/wp-content/uploads/backup-guard/", r"(?i)\.sgbp$"),
    ("/wp-content/uploads/wp-staging/backups/", r"(?i)\.wpstg$"),
    ("/wp-content/uploads/tCapsule/backups/", r"(?i)\.sql(?:\.gz)?$"),
    ("/wp-snapshots/", r"(?i)_archive\.(?:daf|zip)$"),
    ("/wp-content/updraft/", r"(?i)^log\.[a-z0-9]+\.txt$"),
)
BACKUP_TREE = (r"/wp-content/uploads/backwpup(?:/[^/]+/backups|-[^/]+-backups)/", r"(?i)\.(?:tar(?:\.bz2|\.gz)?|tgz|zip)$")
SKIPPED_BASENAMES = (".DS_Store", "._.DS_Store", "Thumbs.db", "desktop.ini", "ehthumbs.db", "error_log", "php_errorlog")
SCRATCH_FILES = (r"^\.#", r"^#.+#$", r"(?i)\.(?:log|tmp)$", r"(?:~|\.(?:swp|swo|swn|bak|orig|rej))$")


def default_skip(path: Column, is_file: Column | bool = True, generated: tuple[str, ...] = GENERATED_DIRECTORIES) -> Column:
    """Whether a snapshot leaves the path out by default.

    ``generated`` are directories of generated files, with slashes at both ends; callers add
    those of their plugins.
    """
    bounded = F.concat(F.lit("/"), F.btrim(path, F.lit("/")), F.lit("/"))
    name = basename(path)
    any_of = lambda tests: F.lit(False) if not tests else tests[0] if len(tests) == 1 else tests[0] | any_of(tests[1:])
    component = any_of([bounded.contains(d) for d in generated] + [bounded.contains(f"/{c}/") for c in SKIPPED_COMPONENTS])
    backup = any_of([bounded.contains(d) & name.rlike(p) for d, p in BACKUP_FILES] + [bounded.rlike(BACKUP_TREE[0]) & name.rlike(BACKUP_TREE[1])])
    scratch = any_of([name.rlike(p) for p in SCRATCH_FILES])
    file = F.lit(is_file) if isinstance(is_file, bool) else is_file
    return component | (file & (backup | name.isin(*SKIPPED_BASENAMES) | scratch))


#: Device names that cannot be stored (fixed by the target system).
DEVICES = "^(CON|PRN|AUX|NUL|(COM|LPT)[1-9¹²³])$"


def unstorable_reason(path: Column) -> Column:
    """Why the first unstorable component cannot be stored on Windows; null if all can."""

    def reason(name: Column) -> Column:
        device = F.upper(F.rtrim(F.substring_index(name, ".", 1)))
        return (
            F.when(name.rlike("[\\x01-\\x1F]"), F.lit("control character"))
            .when(name.rlike('[<>:"|?*\\\\]'), F.concat(F.lit("reserved character "), F.regexp_extract(name, '([<>:"|?*\\\\])', 1)))
            .when(name.endswith("."), F.lit("ends in a dot"))
            .when(name.endswith(" "), F.lit("ends in a space"))
            .when(device.rlike(DEVICES), F.concat(F.lit("device name "), device))
        )

    found = F.filter(F.transform(F.filter(F.split(path, "/"), lambda n: n != ""), lambda n: F.when(reason(n).isNotNull(), F.concat(n, F.lit(": "), reason(n)))), lambda r: r.isNotNull())
    return F.get(found, 0)


PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ROT13 = "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"


def path_token(path: Column) -> Column:
    """Path text that filters on the way leave alone."""
    return F.concat(F.lit("rp."), F.translate(F.base64(path.cast("binary")), PLAIN + "\r\n", ROT13))


def from_path_token(token: Column) -> Column:
    return F.unbase64(F.translate(F.substring(token, F.lit(4), F.char_length(token)), ROT13, PLAIN)).cast("string")


def parse_size(text: Column) -> Column:
    """Bytes of ``16M``, ``1.5G`` or a plain number; anything else is an error."""
    t = F.trim(text)
    shape = r"^(\d+(?:\.\d+)?)\s*([KMGkmg])?[Bb]?$"
    unit = F.upper(F.regexp_extract(t, shape, 2))
    factor = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1)
    value = F.floor(F.regexp_extract(t, shape, 1).cast("double") * factor).cast("long")
    return F.when(t.rlike(shape), value).when(text.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("invalid size: "), t)).cast("long"))
