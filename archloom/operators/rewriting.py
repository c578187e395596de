"""Rewriting of links in pages and style sheets, by place.

A tokenizer gives the places of all values that may name a URL: where each begins, how long it is,
and how it is quoted. Those rows alone meet the table of files; what replaces a value is encoded for
its place. A page then takes its edits at their places, so every byte outside them stays as it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archloom.functions.url import html_decode, relative_path, resolve, type_from_url

from .links import CLASSIFY, META_IMAGES, SRCSET_ATTRS, TAG, URL_ATTRS, base_href, skippable

#: What a page is cut at: comments, elements whose bodies are no markup, and start tags.
TOKEN = r"""<!--.*?-->|<textarea\b[^>]*>.*?</textarea\s*>|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|""" + TAG
_TOKEN, _TAG = re.compile(TOKEN, re.S | re.I), re.compile(TAG, re.S)
_NAME = re.compile(r"<([a-zA-Z][-a-zA-Z0-9:_]*)")
_ATTR = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_CSS = re.compile(r"""url\(\s*(?:"([^"]*)"|'([^']*)'|([^"'()\s]+))\s*\)|@import\s+(?:"([^"]*)"|'([^']*)')""", re.I)
_REFRESH = re.compile(r"\s*[\d.]+\s*;\s*url\s*=\s*(.+)$", re.I)
_ENTITY = re.compile(r"&(?:#(\d{1,7})|#[xX]([0-9a-fA-F]{1,6})|(lt|gt|quot|apos|amp));")
_NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}

_SLOT = "start int, length int, form string, quote string, inner string, tag string, attr string, rel string, as_ string, ref string"
_SLOT_TYPE = pa.struct([(c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in _SLOT.split(", ")])


def _decoded(value: str) -> tuple[str, list[int] | range]:
    """A value with its character references decoded, and where each character of it, and its end, lies in value."""
    if "&" not in value:
        return value, range(len(value) + 1)
    out, at, last = [], [], 0
    for m in _ENTITY.finditer(value):
        code = int(m[1]) if m[1] else int(m[2], 16) if m[2] else ord(_NAMED[m[3]])
        if not 0 < code < 0x110000 or 0xD800 <= code < 0xE000:
            continue
        out.append(value[last : m.start()] + chr(code))
        at += [*range(last, m.start()), m.start()]
        last = m.end()
    out.append(value[last:])
    return "".join(out), [*at, *range(last, len(value) + 1)]


def _css_slots(css: str) -> Iterator[tuple[int, int, str, str]]:
    """Begin, end, quote and text of each reference of a style sheet."""
    for m in _CSS.finditer(css):
        k = m.lastindex
        yield m.start(k), m.end(k), {1: '"', 2: "'", 3: "", 4: '"', 5: "'"}[k], m[k]


def sheet_slots(css: str) -> Iterator[tuple]:
    for i, j, inner, ref in _css_slots(css):
        yield i, j - i, "sheet", "", inner, "", "", "", "", ref


def page_slots(html: str) -> Iterator[tuple]:
    """Slots of a page as in _SLOT, in order, places in characters."""
    for m in _TOKEN.finditer(html):
        head = None if m[0].startswith("<!--") else _TAG.match(m[0])
        if head is None:
            continue
        head = head[0]
        name = _NAME.match(head)
        tag = name[1].lower()
        pairs = [(a, a[1].lower(), a.lastindex) for a in _ATTR.finditer(head, name.end())]
        named: dict[str, str] = {}
        for a, attr, k in pairs:
            named.setdefault(attr, a[k].strip(" \t\n\r\x00\x0b"))
        rel, as_ = named.get("rel", "").lower(), named.get("as", "").lower()
        for a, attr, k in pairs:
            value, quote, at = a[k], {2: '"', 3: "'", 4: ""}[k], m.start() + a.start(k)
            row = (tag, attr, rel, as_)
            if attr in ("integrity", "crossorigin"):
                yield m.start() + a.start(), a.end() - a.start(), "gone", quote, "", *row, ""
            elif tag == "base" and attr == "href":
                yield at, len(value), "base", quote, "", *row, ""
            elif attr in SRCSET_ATTRS:
                if "data:" in value.lower():
                    continue  # such URLs have commas
                begin = 0
                for item in value.split(","):
                    if ref := item.split(None, 1)[:1]:
                        yield at + begin + item.index(ref[0]), len(ref[0]), "srcset", quote, "", *row, ref[0]
                    begin += len(item) + 1
            elif attr == "style":
                plain, place = _decoded(value)
                for i, j, inner, ref in _css_slots(plain):
                    yield at + place[i], place[j] - place[i], "css", quote, inner, *row, ref
            elif tag == "meta" and attr == "content":
                if named.get("http-equiv", "").lower() == "refresh":
                    if (r := _REFRESH.match(value)) and (ref := r[1].strip(" \t\n\r\x00\x0b").strip("\"'")):
                        yield at + r.start(1), len(r[1]), "meta", quote, "", *row, ref
                elif (named.get("property") or named.get("name", "")).lower() in META_IMAGES and re.match("https?://", value, re.I):
                    yield at, len(value), "meta", quote, "", *row, value
            elif attr in URL_ATTRS:
                yield at, len(value), "attr", quote, "", *row, value
        if tag == "style":
            body = len(head)
            for i, j, inner, ref in _css_slots(m[0][body:]):
                yield m.start() + body + i, j - i, "sheet", "", inner, tag, "", rel, as_, ref


def _slots(docs: DataFrame, text: str, of: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """Rows of docs without their text but with the slots in it, places and lengths in bytes."""
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                value, rows, last, byte = batch.column(text)[k].as_py() or "", [], 0, 0
                for slot in sorted(of(value)):
                    byte += len(value[last : slot[0]].encode())
                    last = slot[0]
                    rows.append((byte, len(value[last : last + slot[1]].encode()), *slot[2:]))
                if rows:
                    one = batch.slice(k, 1).select(keep)
                    slots = pa.array([dict(zip([f.name for f in _SLOT_TYPE], r)) for r in rows], _SLOT_TYPE)
                    same = pa.array([0] * len(rows), pa.int32())
                    yield pa.RecordBatch.from_arrays([*(c.take(same) for c in one.columns), *slots.flatten()], names=[*keep, *(f.name for f in _SLOT_TYPE)])

    schema = T.StructType([docs.schema[c] for c in keep] + list(T.StructType.fromDDL(_SLOT)))
    return docs.mapInArrow(run, schema)


def _emitted(value: Column) -> Column:
    """A new value in the form and quotes of its slot: CSS escapes first, then those of an attribute."""
    form, quote, inner = F.col("form"), F.col("quote"), F.col("inner")
    css = value
    for c, e in (('"', "%22"), ("'", "%27"), ("(", "%28"), (")", "%29")):
        css = F.replace(css, F.lit(c), F.lit(e))
    css = F.when(inner == "", F.concat(F.lit('"'), css, F.lit('"'))).otherwise(css)
    v = F.when(form.isin("css", "sheet"), css).otherwise(value)
    v = F.when(form == "sheet", v).otherwise(F.replace(v, F.lit("&"), F.lit("&amp;")))
    double, single = F.replace(v, F.lit('"'), F.lit("&quot;")), F.replace(v, F.lit("'"), F.lit("&#39;"))
    whole = F.when(v.rlike(r"""[\s>"']"""), F.concat(F.lit('"'), double, F.lit('"'))).otherwise(v)
    bare = F.regexp_replace(F.replace(F.replace(double, F.lit("'"), F.lit("&#39;")), F.lit(">"), F.lit("&gt;")), r"\s", "%20")
    return F.when(form == "sheet", v).when(quote == '"', double).when(quote == "'", single).when(form.isin("attr", "meta"), whole).otherwise(bare)


def _edits(slots: DataFrame, targets: DataFrame, missing: str | None) -> DataFrame:
    """Rows row, edits: the replacements (start, length, text) of each text in order.

    slots: row, base, file, and the slot. A text that stands in several rows has its edits once.
    """
    fixed = slots.where(F.col("form").isin("gone", "base")).select("row", "start", "length", F.when(F.col("form") == "gone", "").when(F.col("quote") == "", '"./"').otherwise("./").alias("text"))
    d = slots.where(~F.col("form").isin("gone", "base")).dropDuplicates(["row", "start"]).where(~skippable(html_decode(F.col("ref"))))
    d = d.select("*", F.explode(F.filter(F.array(resolve(F.col("base"), F.col("ref"))), lambda x: x.isNotNull() & (x != ""))).alias("target"))
    d = d.withColumn("ext_type", type_from_url(F.col("target"))).where((F.col("form") != "attr") | F.expr(CLASSIFY).isNotNull())
    d = d.join(targets.select(F.col("url").alias("target"), F.col("path").alias("to")), "target", "left")
    new = F.when(F.col("to").isNotNull(), F.when(F.col("file").isNull(), F.col("to")).otherwise(relative_path(F.col("file"), F.col("to")))).otherwise(F.lit(missing) if missing else F.col("target"))
    fragment = F.when(F.col("to").isNull() & F.lit(bool(missing)), "").otherwise(F.regexp_extract(html_decode(F.col("ref")), r"(?s)^[^#]+(#.*)$", 1))
    # The generator names the value, which the emitter reads many times.
    d = d.select("row", "start", "length", "form", "quote", "inner", F.explode(F.array(F.concat(new, fragment))).alias("value"))
    both = d.select("row", "start", "length", _emitted(F.col("value")).alias("text")).unionByName(fixed.dropDuplicates(["row", "start"]))
    return both.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "text"))).alias("edits"))


def _applied(text: Column, edits: Column) -> Column:
    """A text with its edits (start, length, text), which are in order, by byte; the rest is copied."""
    raw = text.cast("binary")
    end = lambda e: e.getField("start") + e.getField("length")
    piece = lambda e, k: F.concat(_bytes(raw, F.when(k == 0, 0).otherwise(end(F.get(edits, k - 1))), e.getField("start")).cast("string"), e.getField("text"))
    rest = _bytes(raw, end(F.element_at(edits, -1)), F.octet_length(text)).cast("string")
    return F.when(edits.isNull(), text).otherwise(F.concat(F.array_join(F.transform(edits, piece), ""), rest))


def _bytes(raw: Column, begin: Column, end: Column) -> Column:
    return F.substring(raw, begin + 1, end - begin)


def _rewritten(docs: DataFrame, text: str, of: Callable[[str], Iterator[tuple]], targets: DataFrame, missing: str | None) -> DataFrame:
    """docs (row, base, file, text and more) with text rewritten."""
    edits = _edits(_slots(docs.select("row", "base", "file", text), text, of), targets, missing)
    return docs.join(edits, "row", "left").withColumn(text, _applied(F.col(text), F.col("edits"))).drop("edits")


def _row(*columns: str) -> Column:
    """What tells a row from all that are not like it."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def rewrite(pages: DataFrame, targets: DataFrame, missing: str | None = None) -> DataFrame:
    """One row per row of pages: page_id, html with the links of attributes, candidate lists, styles and meta elements replaced.

    pages: page_id, url, html, and file where links are to be relative to it. targets: url, path, each
    url once. A link to none of them becomes absolute, or missing where that is given; fragments stay.
    Comments, scripts and text areas stay as they are; integrity attributes go, and a base element
    points here. Values are encoded for the quotes they stand in. A null html stays null. Rows that
    share a page_id are rewritten each for itself.
    """
    file = F.col("file") if "file" in pages.columns else F.lit(None).cast("string")
    d = pages.select("page_id", "url", "html", file.alias("file")).withColumn("row", _row("page_id", "url", "file", "html"))
    d = d.select("page_id", "row", "file", "html", F.explode(F.array(base_href(F.col("html"), F.col("url")))).alias("base"))
    return _rewritten(d, "html", page_slots, targets, missing).select("page_id", "html")


def rewrite_sheets(sheets: DataFrame, targets: DataFrame, missing: str | None = None) -> DataFrame:
    """Rows id, css of style sheets (id, base, css, file) with their references replaced by targets (url, path); as rewrite()."""
    d = sheets.select("id", "base", "file", "css").withColumn("row", _row("id", "base", "file", "css"))
    return _rewritten(d, "css", sheet_slots, targets, missing).select("id", "css")
