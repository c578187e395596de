"""Links of HTML, CSS and scripts: from documents to rows, with built-in expressions only.

The patterns use possessive groups, so a long tag costs no stack. Bodies of comments, scripts,
styles and text areas are taken out before tags are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archloom.functions.url import extension, html_decode, let, lower, resolve, trim, type_from_url

# Attributes that hold a URL, that hold candidate lists, and prefixes that are no link.
URL_ATTRS = (
    "href src poster action formaction data-src data-href data-url data-original data-lazy-src data-background data-bg data-bg-image data-image data-poster data-thumb background cite longdesc manifest profile xlink:href data lowsrc"
).split()
SRCSET_ATTRS = "srcset data-srcset imagesrcset".split()
SKIP_PREFIXES = "data: javascript: mailto: tel: sms: about: blob: ftp: file: chrome: ws: wss: #".split()
SKIP_MARKS = ("{{", "}}", "{%", "%}", "<?", "${")
META_IMAGES = "og:image og:image:url og:image:secure_url twitter:image twitter:image:src og:audio og:video msapplication-tileimage".split()

TAG = r"""<[a-zA-Z][-a-zA-Z0-9:_]*(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
ATTR = r"""[a-zA-Z_:][-a-zA-Z0-9_:.]*\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
CSS_URL = r"""(?i)url\(\s*(?:"[^"]*"|'[^']*'|[^"'()\s]+)\s*\)"""
CSS_IMPORT = r"""(?i)@import\s+(?:"[^"]*"|'[^']*')"""
JS_LITERAL = r"""["'](?:[^"'\s<>]*/)?[^"'\s<>/]+\.(?:css|js|mjs|png|jpg|jpeg|gif|svg|webp|ico|woff|woff2|ttf|mp4|webm|mp3|json)(?:\?[^"'\s<>]*)?["']"""

#: Kind and type of a link by tag, attribute, rel, as and the type that its extension says; shared text of both engines.
CLASSIFY = """CASE
 WHEN tag IN ('a', 'area') THEN CASE WHEN ext_type NOT IN ('', 'html') THEN 'asset:' || ext_type ELSE 'page:html' END
 WHEN tag = 'link' THEN CASE
   WHEN rel = '' THEN CASE WHEN ext_type NOT IN ('', 'html') THEN 'asset:' || ext_type END
   WHEN rel LIKE '%stylesheet%' THEN 'asset:css' WHEN rel LIKE '%icon%' THEN 'asset:img' WHEN rel LIKE '%manifest%' THEN 'asset:doc' WHEN rel LIKE '%modulepreload%' THEN 'asset:js'
   WHEN rel LIKE '%preload%' THEN CASE as_ WHEN 'style' THEN 'asset:css' WHEN 'script' THEN 'asset:js' WHEN 'font' THEN 'asset:font' WHEN 'image' THEN 'asset:img' WHEN 'video' THEN 'asset:media' WHEN 'audio' THEN 'asset:media' ELSE CASE WHEN ext_type NOT IN ('', 'html') THEN 'asset:' || ext_type END END
   WHEN rel IN ('canonical', 'alternate', 'next', 'prev', 'index', 'start', 'up', 'contents') THEN 'page:html'
   WHEN rel IN ('preconnect', 'dns-prefetch', 'prerender', 'pingback', 'profile', 'license', 'author', 'help', 'search') THEN NULL
   ELSE CASE WHEN ext_type NOT IN ('', 'html') THEN 'asset:' || ext_type END END
 WHEN tag = 'script' THEN CASE WHEN attr = 'src' THEN 'asset:js' END
 WHEN tag IN ('img', 'image', 'use') THEN 'asset:' || CASE WHEN ext_type NOT IN ('', 'html') THEN ext_type ELSE 'img' END
 WHEN tag = 'input' THEN 'asset:img'
 WHEN tag = 'source' THEN 'asset:' || CASE WHEN attr LIKE '%srcset' THEN 'img' WHEN ext_type NOT IN ('', 'html') THEN ext_type ELSE 'media' END
 WHEN tag IN ('video', 'audio') THEN CASE WHEN attr LIKE '%poster' THEN 'asset:img' ELSE 'asset:media' END
 WHEN tag = 'track' THEN 'asset:doc'
 WHEN tag IN ('embed', 'object') THEN 'asset:' || CASE WHEN ext_type NOT IN ('', 'html') THEN ext_type ELSE 'doc' END
 WHEN tag IN ('iframe', 'frame') THEN CASE WHEN ext_type NOT IN ('', 'html') THEN 'asset:' || ext_type ELSE 'page:html' END
 WHEN tag IN ('body', 'table', 'td', 'th') THEN CASE WHEN attr = 'background' THEN 'asset:img' END
 WHEN tag = 'form' THEN 'page:html'
 WHEN tag = 'base' THEN NULL
 WHEN ext_type NOT IN ('', 'html') THEN 'asset:' || ext_type
 WHEN attr = 'href' THEN 'page:html' END"""


def protect(html: Column) -> Column:
    """HTML without comments and without the bodies of scripts, styles and text areas."""
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in ("script", "style", "textarea"):
        html = F.regexp_replace(html, rf"(?is)(<{tag}\b[^>]*>).*?</{tag}\s*>", f"$1</{tag}>")
    return html


def _unquoted(v: Column) -> Column:
    return F.regexp_replace(v, r"""^["']|["']$""", "")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag, empty where it has none; data-x is not x."""
    return trim(_unquoted(F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)))


def base_href(html: Column, url: Column) -> Column:
    """What references resolve against: the base tag's URL, or else the document's."""
    tag = F.regexp_extract(html, r"(?i)<base\s[^>]*>", 0)
    href = attribute(tag, "href")
    return F.coalesce(F.when(href != "", resolve(url, href)), url)


def resolved(df: DataFrame, base: str, ref: str) -> DataFrame:
    """Rows with target, those whose reference resolves.

    The generator computes the long expression once, before anything that reads its result.
    """
    return df.select("*", F.explode(F.filter(F.array(resolve(F.col(base), F.col(ref))), lambda x: x.isNotNull())).alias("target"))


def skippable(ref: Column) -> Column:
    r = lower(trim(ref))
    out = r == ""
    for p in SKIP_PREFIXES:
        out = out | r.startswith(p)
    for m in SKIP_MARKS:
        out = out | r.contains(m)
    return out


def tags(pages: DataFrame, *keep: str) -> DataFrame:
    """Rows page_id, url, pos, tag (name), raw of every start tag outside protected bodies, and the columns keep."""
    d = pages.select("page_id", "url", *keep, F.posexplode(F.regexp_extract_all(protect(F.col("html")), F.lit(TAG), 0)).alias("pos", "raw"))
    return d.withColumn("tag", lower(F.regexp_extract("raw", r"^<([a-zA-Z][-a-zA-Z0-9:_]*)", 1)))


def attributes(pages: DataFrame, *keep: str) -> DataFrame:
    """Rows page_id, url, pos, tag, raw, apos, attr, value of every attribute with a value."""
    d = tags(pages, *keep).select("page_id", "url", *keep, "pos", "tag", "raw", F.posexplode(F.regexp_extract_all("raw", F.lit(ATTR), 0)).alias("apos", "pair"))
    name = lower(F.regexp_extract("pair", r"^([^\s=]+)", 1))
    return d.select("page_id", "url", *keep, "pos", "tag", "raw", "apos", name.alias("attr"), _unquoted(F.regexp_extract("pair", r"(?s)=\s*(.*)$", 1)).alias("value"))


def _via(refs: Column, via: str) -> Column:
    return F.transform(refs, lambda x: F.struct(x.alias("ref"), F.lit(via).alias("via")))


def css_refs(css: Column) -> Column:
    """Array of (ref, via) of a style sheet: its url(...) and then its plain imports."""
    inner = lambda x: _unquoted(trim(F.regexp_extract(x, r"(?i)^url\((.*)\)$", 1)))
    plain = lambda x: _unquoted(trim(F.regexp_extract(x, r"(?i)^@import\s+(.*)$", 1)))
    return F.concat(_via(F.transform(F.regexp_extract_all(css, F.lit(CSS_URL), 0), inner), "css"), _via(F.transform(F.regexp_extract_all(css, F.lit(CSS_IMPORT), 0), plain), "import"))


def bodies(html: Column, tag: str) -> Column:
    """Array of the bodies of all elements of a raw-text tag, comments aside."""
    return F.regexp_extract_all(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), 1)


def references(pages: DataFrame, scripts: bool = False) -> DataFrame:
    """Rows page_id, url, base, pos, apos, ipos, tag, attr, raw, ref, via of all that may name a URL.

    Attributes, srcset candidates, style attributes and meta elements come at the place of their tag;
    style bodies before all tags (pos -1), and literals of scripts, if asked for, before these (-2).
    """
    # The base is computed in the row, before anything is taken from it.
    d = pages.select("page_id", "url", "html", F.explode(F.array(base_href(F.col("html"), F.col("url")))).alias("base"))
    a = attributes(d, "base")
    named = meta_target(F.when(lower(attribute(F.col("raw"), "http-equiv")) == "refresh", "refresh").otherwise(F.coalesce(F.nullif(attribute(F.col("raw"), "property"), F.lit("")), attribute(F.col("raw"), "name"))), F.col("value"))
    sets = F.when(lower(F.col("value")).contains("data:"), F.array().cast("array<string>")).otherwise(srcset(F.col("value")).getField("ref"))
    refs = (
        F.when(F.col("attr").isin(*SRCSET_ATTRS), _via(sets, "srcset"))
        .when(F.col("attr") == "style", css_refs(html_decode(F.col("value"))))
        .when((F.col("tag") == "meta") & (F.col("attr") == "content"), _via(F.filter(F.array(named), lambda x: x.isNotNull()), "meta"))
        .when(F.col("attr").isin(*URL_ATTRS), _via(F.array("value"), "attr"))
    )
    found = a.where(F.col("attr").isin(*URL_ATTRS, *SRCSET_ATTRS, "style") | ((F.col("tag") == "meta") & (F.col("attr") == "content")))
    columns = ["page_id", "url", "base", "pos", "apos", "ipos", "tag", "attr", "raw", "ref", "via"]
    found = found.select("*", F.posexplode(refs).alias("ipos", "x")).select("*", "x.*").select(columns)
    for tag, pos, of in (("style", -1, css_refs), ("script", -2, lambda b: _via(F.transform(F.regexp_extract_all(b, F.lit(JS_LITERAL), 0), _unquoted), "js"))):
        if tag == "style" or scripts:
            body = d.select("page_id", "url", "base", F.posexplode(bodies(F.col("html"), tag)).alias("apos", "body"))
            body = body.select("*", F.posexplode(of(F.col("body"))).alias("ipos", "x")).select("*", "x.*")
            found = found.unionByName(body.withColumns({"pos": F.lit(pos), "tag": F.lit(tag), "attr": F.lit(""), "raw": F.lit("")}).select(columns))
    return found.where(~skippable(F.col("ref")))


#: Kind and type of what is no plain attribute; shared text of both engines.
CLASSIFY_VIA = """CASE via
 WHEN 'srcset' THEN 'asset:' || CASE WHEN ext_type IN ('', 'html') THEN 'img' ELSE ext_type END
 WHEN 'meta' THEN CASE WHEN lower(raw) LIKE '%refresh%' THEN 'page:html' ELSE 'asset:' || CASE WHEN ext_type = '' THEN 'img' ELSE ext_type END END
 WHEN 'js' THEN 'asset:' || ext_type
 WHEN 'attr' THEN NULL
 ELSE 'asset:' || CASE WHEN ext_type NOT IN ('', 'html') THEN ext_type WHEN via = 'import' OR target LIKE '%.css%' THEN 'css' ELSE 'img' END END"""


def links(pages: DataFrame, scripts: bool = False) -> DataFrame:
    """Rows page_id, url, pos, apos, ipos, target, kind, type of the links of pages, in document order."""
    d = resolved(references(pages, scripts), "base", "ref")
    d = d.withColumns({"ext_type": type_from_url(F.col("target")), "rel": lower(attribute(F.col("raw"), "rel")), "as_": lower(attribute(F.col("raw"), "as"))})
    d = d.withColumn("class", F.coalesce(F.expr(CLASSIFY_VIA), F.when(F.col("via") == "attr", F.expr(CLASSIFY)))).where("class is not null")
    return d.select("page_id", "url", "pos", "apos", "ipos", "target", F.substring_index("class", ":", 1).alias("kind"), F.substring_index("class", ":", -1).alias("type"))


def dedup(found: DataFrame) -> DataFrame:
    """One row a page and target: the first place, and the kind and type of the last."""
    at = F.struct("pos", "apos", "ipos")
    return found.groupBy("page_id", "target").agg(F.min("pos").alias("pos"), F.min(at).alias("first"), F.max_by("kind", at).alias("kind"), F.max_by("type", at).alias("type"))


def css_links(sheets: DataFrame) -> DataFrame:
    """Rows id, pos, target, type of url(...) and then @import of style sheets (id, base, css)."""
    d = sheets.select("id", "base", F.posexplode(css_refs(F.col("css"))).alias("pos", "x")).select("id", "base", "pos", "x.*").where(~skippable(F.col("ref")))
    d = resolved(d, "base", "ref")
    kind = type_from_url(F.col("target"))
    return d.select("id", "pos", "target", F.when(kind.isin("", "html"), F.when((F.col("via") == "import") | F.col("target").contains(".css"), "css").otherwise("img")).otherwise(kind).alias("type"))


def js_links(scripts: DataFrame) -> DataFrame:
    """Rows id, pos, target, type of file-like string literals of scripts (id, base, js)."""
    d = scripts.select("id", "base", F.posexplode(F.regexp_extract_all("js", F.lit(JS_LITERAL), 0)).alias("pos", "raw")).withColumn("ref", _unquoted(F.col("raw")))
    d = resolved(d, "base", "ref")
    return d.select("id", "pos", "target", type_from_url(F.col("target")).alias("type"))


def srcset(value: Column) -> Column:
    """Candidates of a srcset as structs of reference and descriptor."""
    parts = F.filter(F.transform(F.split(value, r"\s*,\s*"), trim), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("ref"), trim(F.regexp_extract(x, r"^\S+\s+(.*)$", 1)).alias("descriptor")))


def meta_target(name: Column, content: Column) -> Column:
    """The URL that a meta element names: of a refresh, or of a social image."""
    refresh = _unquoted(trim(F.regexp_extract(content, r"(?i)^\s*[\d.]+\s*;\s*url\s*=\s*(.+)$", 1)))
    return F.when(lower(name) == "refresh", F.nullif(refresh, F.lit(""))).when(lower(name).isin(*META_IMAGES) & content.rlike(r"(?i)^https?://"), content)


def _cut(text: Column, pattern: str) -> Column:
    """Array of (text, token): what lies before each match and the match, and at the end the rest with an empty one."""
    texts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    return let(F.struct(texts.alias("t"), found.alias("f")), lambda x: F.transform(x.getField("t"), lambda t, i: F.struct(t.alias("text"), F.coalesce(F.get(x.getField("f"), i), F.lit("")).alias("token"))))


def rewrite_css(css: Column, mapping: Column) -> Column:
    """Style sheets with the files of a map from reference to file, in double quotes; other references stay."""
    inner = lambda x: _unquoted(trim(F.regexp_replace(x, r"(?i)^url\(|\)$", "")))
    new = lambda x: F.coalesce(F.concat(F.lit('url("'), F.try_element_at(mapping, inner(x)), F.lit('")')), x)
    return F.array_join(F.transform(_cut(css, CSS_URL), lambda x: F.concat(x.getField("text"), new(x.getField("token")))), "")


def strip_integrity(html: Column) -> Column:
    return F.regexp_replace(html, r"""(?i)\s(?:integrity|crossorigin)\s*=\s*(?:"[^"]*"|'[^']*')""", "")


def neutral_base(html: Column) -> Column:
    return F.regexp_replace(html, r"""(?i)(<base\s[^>]*href\s*=\s*)(?:"[^"]*"|'[^']*')""", '$1"./"')


__all__ = ["attributes", "base_href", "css_links", "dedup", "extension", "html_decode", "js_links", "links", "meta_target", "neutral_base", "protect", "rewrite_css", "skippable", "srcset", "strip_integrity", "tags"]
