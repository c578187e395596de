"""URL functions as Column expressions: no UDFs, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# File types by extension, server-side extensions, and reserved names.
TYPES = {
    "css": "css",
    "js": "js mjs cjs",
    "img": "png jpg jpeg gif svg webp avif ico bmp tif tiff apng cur",
    "font": "woff woff2 ttf otf eot",
    "media": "mp4 webm ogv ogg oga mp3 wav flac m4a m4v mov avi mkv wmv 3gp",
    "doc": "pdf zip rar 7z gz tar doc docx xls xlsx ppt pptx csv txt xml json rss atom webmanifest map vtt srt",
    "html": "html htm xhtml shtml php php3 php4 php5 phtml asp aspx jsp jspx cfm cgi pl py rb do action",
}
DYNAMIC = "php php3 php4 php5 phtml asp aspx jsp jspx cfm cgi pl py rb do action".split()
SECOND_LEVEL = "co com net org gov edu ac or ne go mil sch".split()
ESCAPES = {" ": "%20", '"': "%22", "<": "%3C", ">": "%3E", "{": "%7B", "}": "%7D", "|": "%7C", "\\": "%5C", "^": "%5E", "`": "%60"}
MIME_EXT = {
    "text/html": "html", "text/css": "css", "text/javascript": "js", "application/javascript": "js", "application/json": "json",
    "image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/svg+xml": "svg", "image/x-icon": "ico",
    "font/woff": "woff", "font/woff2": "woff2", "font/ttf": "ttf", "video/mp4": "mp4", "audio/mpeg": "mp3", "application/pdf": "pdf", "application/xml": "xml",
}
NAME_FOR_TYPE = {"css": "css", "js": "js", "img": "png", "font": "woff2", "media": "mp4"}
RESERVED = "^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"
URL = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
#: What trim() removes at both ends.
BLANKS = " \t\n\r\x00\x0b"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EXT_TYPE = {e: t for t, exts in TYPES.items() for e in exts.split()}


def lower(c: Column) -> Column:
    """ASCII lower case, the same in every locale."""
    return F.translate(c, _UPPER, _LOWER)


def trim(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(values.items())))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that it names, so that an expression used in many places stands in the plan once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_http(u: Column) -> Column:
    return u.rlike(r"(?i)^https?://")


def canon_path(p: Column) -> Column:
    """Slash runs and dot segments gone; a slash at the end only where the input had one; ten characters escaped."""

    def of(p: Column) -> Column:
        kept = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
        none = F.array().cast("array<string>")
        folded = F.aggregate(kept, none, lambda a, s: F.when(s == "..", F.when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(none)).otherwise(F.concat(a, F.array(s))))
        out = let(F.concat(F.lit("/"), F.array_join(folded, "/")), lambda x: F.when(p.endswith("/") & (x != "/"), F.concat(x, F.lit("/"))).otherwise(x))
        for c, e in ESCAPES.items():
            out = F.replace(out, F.lit(c), F.lit(e))
        return out

    return let(p, of)


def parsed(u: Column) -> Column:
    """Struct of scheme, authority (host with port), path and query of a URL, its fragment aside."""

    def of(t: Column) -> Column:
        part = lambda k: F.regexp_extract(t, URL, k)
        return F.struct(lower(part(1)).alias("scheme"), lower(F.regexp_replace(part(2), "^.*@", "")).alias("authority"), part(3).alias("path"), part(4).alias("query"))

    return let(F.substring_index(trim(u), "#", 1), of)


def _host(x: Column) -> Column:
    return F.regexp_extract(x.getField("authority"), r"^(\[[^\]]*\]|[^:]*)", 1)


def _path(x: Column) -> Column:
    return F.coalesce(F.nullif(x.getField("path"), F.lit("")), F.when(x.getField("path").isNotNull(), "/"))


def _extension(p: Column) -> Column:
    return lower(F.regexp_extract(p, r"\.([^./]*)$", 1))


def normalize(u: Column) -> Column:
    """Canonical form; empty where there is no host."""

    def of(x: Column) -> Column:
        scheme = F.when(x.getField("scheme") == "", F.lit("http")).otherwise(x.getField("scheme"))
        port = F.regexp_extract(x.getField("authority"), r"^(\[[^\]]*\]|[^:]*)(?::(\d*))?", 2)
        usual = lambda s, p: (p == "") | ((s == "http") & (p == "80")) | ((s == "https") & (p == "443"))
        q = x.getField("query")
        named = F.struct(scheme.alias("s"), port.alias("p"), _host(x).alias("h"))
        whole = lambda y: F.concat(
            y.getField("s"), F.lit("://"), y.getField("h"), F.when(usual(y.getField("s"), y.getField("p")), "").otherwise(F.concat(F.lit(":"), y.getField("p"))), canon_path(x.getField("path")), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))
        )
        return let(named, lambda y: F.when(y.getField("h") == "", "").otherwise(whole(y)))

    return let(parsed(u), of)


def host(u: Column) -> Column:
    return _host(parsed(u))


def path(u: Column) -> Column:
    return let(parsed(u), _path)


def query(u: Column) -> Column:
    return parsed(u).getField("query")


def extension(u: Column) -> Column:
    return _extension(path(u))


def is_dynamic(u: Column) -> Column:
    return extension(u).isin(*DYNAMIC)


def base_domain(h: Column) -> Column:
    """The last two labels, or three where the second-last is a common second level under a short one."""

    def of(labels: Column) -> Column:
        n = F.size(labels)
        last = lambda k: F.array_join(F.slice(labels, n - k + 1, F.lit(k)), ".")
        deep = (n > 2) & F.get(labels, n - 2).isin(*SECOND_LEVEL) & (F.length(F.get(labels, n - 1)) <= 3)
        return F.when(n <= 2, F.array_join(labels, ".")).when(deep, last(3)).otherwise(last(2))

    return let(F.split(lower(h), r"\."), of)


def same_site(u: Column, root_host: Column, subdomains: Column) -> Column:
    r = lower(root_host)
    bare = lambda x: F.regexp_replace(x, r"^www\.", "")
    return let(host(u), lambda h: (h != "") & ((h == r) | (bare(h) == bare(r)) | (subdomains & (base_domain(h) == base_domain(r)))))


def type_from_url(u: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(EXT_TYPE), extension(u)), F.lit(""))


def type_from_mime(mime: Column) -> Column:
    m = lower(trim(F.substring_index(mime, ";", 1)))
    return (
        F.when(m == "", "").when(m.contains("html"), "html").when(m == "text/css", "css")
        .when(m.contains("javascript") | m.contains("ecmascript"), "js").when(m.startswith("image/"), "img")
        .when(m.startswith("font/") | m.rlike("font-woff|woff|opentype|truetype|font-sfnt"), "font")
        .when(m.startswith("video/") | m.startswith("audio/"), "media").otherwise("doc")
    )


def ext_for_mime(mime: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(MIME_EXT), lower(trim(F.substring_index(mime, ";", 1)))), F.lit(""))


_NUMERIC = r"&#([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"


def _numeric(c: Column) -> Column:
    """Numeric character references decoded, those of no character left as they are."""

    def of(x: Column) -> Column:
        code = F.when(F.lower(F.substring(x, 1, 1)) == "x", F.conv(F.substring(x, 2, 6), 16, 10)).otherwise(F.conv(x, 10, 10)).cast("long")
        some = lambda n: ((n > 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n <= 0x10FFFF))
        # An ampersand is decoded with the named ones, once.
        return let(code, lambda n: F.when(n == 38, "&amp;").when(some(n), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.concat(F.lit("&#"), x, F.lit(";"))))

    found = F.regexp_extract_all(c, F.lit(_NUMERIC), 1)
    whole = lambda f: F.array_join(F.transform(F.split(c, _NUMERIC, -1), lambda t, i: F.concat(t, F.coalesce(of(F.get(f, i)), F.lit("")))), "")
    return F.when(c.contains("&#"), let(found, whole)).otherwise(c)


def html_decode(c: Column) -> Column:
    """The five basic entities and numeric references, ampersands last."""

    def of(c: Column) -> Column:
        c = _numeric(c)
        for e, t in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            c = F.replace(c, F.lit(e), F.lit(t))
        return c

    return let(c, of)


def resolve(base: Column, ref: Column) -> Column:
    """Absolute form of a reference; null for fragments, other schemes and bases without a host."""

    def of(r: Column) -> Column:
        none = F.lit(None).cast("string")

        def against(b: Column) -> Column:
            scheme, authority, p = (b.getField(k) for k in ("scheme", "authority", "path"))
            scheme = F.when(scheme == "", "http").otherwise(scheme)
            folder = F.regexp_extract(p, r"^(.*/)", 1)
            rest = (
                F.when(r.startswith("/"), r)
                .when(r.startswith("?"), F.concat(F.when(p == "", "/").otherwise(p), r))
                .otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), r))
            )
            return F.when(authority == "", none).when(r.startswith("//"), F.concat(scheme, F.lit(":"), r)).otherwise(F.concat(scheme, F.lit("://"), authority, rest))

        return F.when((r == "") | r.startswith("#"), none).when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.when(is_http(r), r).otherwise(none)).otherwise(let(parsed(base), against))

    return F.nullif(normalize(let(trim(F.translate(html_decode(ref), "\r\n\t", "")), of)), F.lit(""))


def safe_segment(s: Column) -> Column:
    """A path segment that every file system takes, and that names one file however long it was."""
    t = F.translate(F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s), "\\", "/")
    t = F.regexp_replace(t, r"[\x00-\x1F\x7F]", "")
    t = trim(F.regexp_replace(t, r'[<>:"|?*/]+', "-"))
    t = F.trim(F.regexp_replace(t, r"\s+", "-"), F.lit(".-"))
    t = let(t, lambda x: F.when(x == "", "_").otherwise(x))

    def of(t: Column) -> Column:
        bare = F.regexp_replace(t, r"\.[^.]*$", "")
        mark = F.when(lower(bare).rlike(RESERVED), F.lit("_")).otherwise("")

        def named(x: Column) -> Column:
            whole, stem = F.concat(x, t), F.concat(x, bare)
            short = F.concat(F.substring(stem, 1, 70), F.lit("-"), F.substring(F.sha1(whole), 1, 8), F.regexp_extract(t, r"(\.[^.]+)$", 1))
            return F.when(F.octet_length(whole) > 90, short).otherwise(whole)

        return let(mark, named)

    return let(t, of)


def local_path(u: Column, kind: Column, root_host: Column) -> Column:
    """File of a URL in the copy of a site: stable, safe and relative to the copy's root."""

    def of(x: Column) -> Column:
        segments = F.filter(F.split(_path(x), "/"), lambda s: s != "")
        folder_form = x.getField("path").endswith("/")
        last = F.when(folder_form, "").otherwise(F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit("")))
        folders = lambda s: F.when(folder_form, s).otherwise(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))))
        named = F.struct(segments.alias("s"), last.alias("last"), lower(F.regexp_extract(last, r"\.([^.]*)$", 1)).alias("ext"))
        return let(named, lambda y: placed(x, folders(y.getField("s")), y.getField("last"), y.getField("ext")))

    def placed(x: Column, folders: Column, last: Column, ext: Column) -> Column:
        default = F.coalesce(F.try_element_at(_map(NAME_FOR_TYPE), kind), F.lit("bin"))
        html = kind == "html"
        q = x.getField("query")
        # A query makes another page of the same path: a tag of it goes before the extension.
        tagged = lambda n: F.when(q == "", n).otherwise(F.concat(F.regexp_replace(n, r"\.[^.]*$", ""), F.lit("__"), F.substring(F.sha1(q), 1, 7), F.regexp_extract(n, r"(\.[^.]*)$", 1)))

        def parts(safe: Column) -> Column:
            name = (
                F.when(html, F.when((last == "") | (ext == ""), "index.html").when(ext.isin("html", "htm"), safe).otherwise(F.concat(safe, F.lit(".html"))))
                .when(last == "", F.concat(F.lit("index."), F.when(kind == "", "bin").otherwise(kind)))
                .when(~safe.rlike(r"\.[^.]+$"), F.concat(safe, F.lit("."), default))
                .otherwise(safe)
            )
            own = F.when(html & (last != "") & (ext == ""), F.array(safe)).otherwise(F.array().cast("array<string>"))
            return F.concat(F.transform(folders, safe_segment), own, F.array(let(name, tagged)))

        bare = lambda h: F.regexp_replace(h, r"^www\.", "")
        outside = let(_host(x), lambda h: F.when(bare(h) == bare(lower(root_host)), F.array().cast("array<string>")).otherwise(F.array(F.lit("_external"), safe_segment(h))))
        return let(F.concat(outside, let(safe_segment(last), parts)), short)

    def short(whole: Column) -> Column:
        deep = lambda full: F.array_join(F.concat(F.slice(whole, 1, 2), F.array(F.lit("_deep"), F.substring(F.sha1(full), 1, 10), F.element_at(whole, -1))), "/")
        return let(F.array_join(whole, "/"), lambda full: F.when(F.octet_length(full) > 180, deep(full)).otherwise(full))

    return let(parsed(u), of)


def relative_path(source: Column, target: Column) -> Column:
    """Path from one file of the copy to another; at least the target's last part stays."""
    a, b = F.split(source, "/"), F.split(target, "/")
    most = F.least(F.size(a) - 1, F.size(b) - 1)
    unlike = F.filter(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), lambda i: (i >= most) | (F.get(a, i) != F.get(b, i)))
    same = F.get(unlike, F.lit(0)).cast("int")
    up = F.repeat(F.lit("../"), F.size(a) - 1 - same)
    return F.concat(up, F.array_join(F.slice(b, same + 1, F.size(b)), "/"))


def same_dir(a: Column, b: Column) -> Column:
    return folder(a) == folder(b)


def folder(u: Column) -> Column:
    """Host and path of a URL up to the last slash."""
    return let(parsed(u), lambda x: F.concat(_host(x), F.regexp_extract(_path(x), r"^(.*/)", 1)))


def short_url(u: Column, root_host: Column, most: int = 95) -> Column:
    """Path and query, after the host where that is not the root's, cut to most characters."""

    def of(x: Column) -> Column:
        q = x.getField("query")
        t = F.concat(let(_host(x), lambda h: F.when(h == lower(root_host), "").otherwise(h)), _path(x), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
        return let(t, lambda t: F.when(F.octet_length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t))

    return let(parsed(u), of)


def admit_url(u: Column) -> Column:
    """Canonical form of what a person typed; empty for what is no site."""
    whole = let(trim(u), lambda t: F.when((t != "") & ~is_http(t), F.concat(F.lit("https://"), t)).otherwise(t))
    return let(normalize(whole), lambda n: F.when(host(n).rlike(r"^[a-z0-9]([a-z0-9.\-]*[a-z0-9])?$"), n).otherwise(""))
