"""Encodings and cheap classifications of values, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewright.functions.paths import basename

# Extensions of text, and of data that no longer compresses.
TEXT_EXTENSIONS = (
    "php phtml js jsx ts tsx mjs cjs css scss sass less html htm xml xsl xslt svg vue astro twig mustache hbs liquid"
    " json jsonl yaml yml toml csv tsv sql ini conf cfg env properties md markdown txt log rst adoc"
    " pot po rss atom srt vtt webvtt sh bash patch diff"
).split()
PACKED_EXTENSIONS = (
    "zip gz tgz bz2 xz 7z rar tar jpg jpeg png gif webp heic heif avif tiff tif bmp ico mp3 m4a aac ogg opus flac wav"
    " mp4 m4v mov webm mkv avi woff woff2 ttf otf eot pdf psd sketch fig iso dmg mo phar"
).split()
#: Fragments of base64 text, one for each alignment, without which it holds no web address.
HTTP_FRAGMENTS = ("aHR0", "dHA6", "dHBz", "dHRw")


def compressibility(path: Column, head: Column | None = None) -> Column:
    """yes, no or unknown by extension; unknown is decided by the content's first 64 bytes."""
    name = basename(path)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    by_name = (
        F.when(name == "", "no").when(name.rlike(r"^\.[^.]*$"), "yes").when(extension == "", "yes")
        .when(extension.isin(*TEXT_EXTENSIONS), "yes").when(extension.isin(*PACKED_EXTENSIONS), "no").otherwise("unknown")
    )
    if head is None:
        return by_name
    first = F.substring(head.cast("binary"), 1, 64)
    codes = F.hex(first)
    control = codes.rlike("^(..)*(0[0-8BEF]|1[0-9A-F]|7F)")
    text = (F.octet_length(first) > 0) & ~control & F.is_valid_utf8(first.cast("string"))
    return F.when(by_name == "unknown", F.when(text, "yes").otherwise("no")).otherwise(by_name)


def project_encoded(value: Column, kind: str) -> Column:
    """A value in transport form: NULL, '', a bare number, or base64 (with a wrapper for JSON).

    ``kind`` is numeric, text, binary or json; a numeric column's text that is no number is
    an error.
    """
    text = value.cast("string")
    if kind == "numeric":
        shape = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"
        encoded = F.when(text.rlike(shape), text).otherwise(F.raise_error(F.concat(F.lit("not a number: "), text)).cast("string"))
    else:
        coded = F.concat(F.lit("FROM_BASE64('"), F.replace(F.base64(value.cast("binary")), F.lit("\r\n"), F.lit("")), F.lit("')"))
        if kind == "json":
            coded = F.concat(F.lit("CONVERT("), coded, F.lit(" USING utf8mb4)"))
        encoded = F.when(F.octet_length(value) == 0, F.lit("''")).otherwise(coded)
    return F.when(value.isNull(), F.lit("NULL")).otherwise(encoded)


def float_text(value: Column) -> Column:
    """A double's text with 17 significant digits, which read back as the same value."""
    return F.when(value.isNotNull(), F.format_string("%.16e", value.cast("double")))


def host_spellings(host: str) -> set[str]:
    """A host as it stands, in ASCII and in Unicode."""
    found = {host.lower()}
    for turn in (lambda h: h.encode("idna").decode(), lambda h: h.encode().decode("idna")):
        try:
            found.add(turn(host.lower()))
        except UnicodeError:
            continue
    return found


def may_contain_url(value: Column, hosts: list[str], tags: tuple[str, ...] = ("vc_raw_html", "vc_raw_js")) -> Column:
    """Cheap test before a rewrite: a URL attribute, a source host in either spelling, an escape
    that could hide one, or a coded tag."""
    low = F.lower(value)
    test = value.contains("\\u") | value.contains("&") | low.contains("href=") | low.contains("src=")
    for host in sorted({s for h in hosts for s in host_spellings(h)}):
        test = test | low.contains(host)
    for tag in tags:
        test = test | value.contains(f"[{tag}")
    return F.coalesce(test, F.lit(False))


def b64_may_contain_http(value: Column) -> Column:
    test = F.lit(False)
    for fragment in HTTP_FRAGMENTS:
        test = test | value.contains(fragment)
    return test


def leftovers(value: Column, host: str) -> Column:
    """Whether a value still holds the address in percent-encoded form."""
    return F.lower(value).contains(f"%2f%2f{host.lower()}")


def srid(geometry: Column) -> Column:
    """The little-endian reference number in a geometry's first four bytes."""
    code = F.hex(F.substring(geometry, 1, 4))
    turned = F.concat(*(F.substring(code, k, 2) for k in (7, 5, 3, 1)))
    return F.conv(turned, 16, 10).cast("long")
