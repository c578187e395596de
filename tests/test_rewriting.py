"""Rewriting by place: the values that change, and every byte that doesn't."""

from hypothesis import given, settings
from hypothesis import strategies as st

from archloom.operators.rewriting import page_slots, rewrite, rewrite_sheets, sheet_slots

COPY = "url string, path string"
AT = "https://site.test/"


def pages(spark, *htmls, file=None):
    rows = [(k, AT, file, h) for k, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, file string, html string")


def rewritten(spark, htmls, copy=(), missing=None, file=None):
    out = rewrite(pages(spark, *htmls, file=file), spark.createDataFrame(list(copy), COPY), missing)
    return [r.html for r in out.orderBy("page_id").collect()]


def test_names_of_attributes_stay(spark):
    cases = {
        '<a href="e">': '<a href="https://site.test/e">', '<img src="c">': '<img src="https://site.test/c">', '<img srcset="s 1x">': '<img srcset="https://site.test/s 1x">',
        '<style>u{b:url(u)}</style>': '<style>u{b:url("https://site.test/u")}</style>', '<p style="u:url(u)">': '<p style="u:url(&quot;https://site.test/u&quot;)">',
        '<style>@import "i";</style>': '<style>@import "https://site.test/i";</style>',
    }
    assert rewritten(spark, cases) == list(cases.values())


def test_values_are_encoded_for_their_quotes(spark):
    cases = {
        "<a href='it&#39;s.pdf'>": "<a href='https://site.test/it&#39;s.pdf'>", "<a href=it&#39;s.htm>": '<a href="https://site.test/it\'s.htm">', '<a href="?a=1&amp;b=2#c&amp;d">': '<a href="https://site.test/?a=1&amp;b=2#c&amp;d">',
        '<p style="content:&quot;a&quot;;background:url(x.png)">': '<p style="content:&quot;a&quot;;background:url(&quot;https://site.test/x.png&quot;)">', '<p style="a:b&amp;c">': '<p style="a:b&amp;c">',
        "<p style='b:url(\"q(1).png\")'>": "<p style='b:url(\"https://site.test/q%281%29.png\")'>", "<style>b{c:url(\"?a&b\")}</style>": "<style>b{c:url(\"https://site.test/?a&b\")}</style>",
        "<base href=/x/>": '<base href="./">', "<script src=/s.js integrity='x' crossorigin=anonymous></script>": "<script src=https://site.test/s.js  ></script>",
    }
    assert rewritten(spark, cases) == list(cases.values())


def test_links_to_the_copy_are_relative_and_others_absolute_or_marked(spark):
    copy = [(AT + "b/c", "b/c/index.html"), (AT + "i.png", "i.png")]
    html = '<a href="/b/c#s">1</a><img srcset="i.png 1x, j.png 2x"><a href="d#t">2</a><a href="#here">3</a><a href="mailto:a@b">4</a>'
    assert rewritten(spark, [html], copy, file="a/b.html") == ['<a href="../b/c/index.html#s">1</a><img srcset="../i.png 1x, https://site.test/j.png 2x"><a href="https://site.test/d#t">2</a><a href="#here">3</a><a href="mailto:a@b">4</a>']
    assert rewritten(spark, ['<a href="d#t">2</a>'], copy, "#not-downloaded") == ['<a href="#not-downloaded">2</a>']


def test_rows_of_one_page_id_stay_apart(spark):
    rows = [(1, AT, '<a href="x">1</a>'), (1, AT, '<b>2</b>'), (1, AT, '<a href="x">1</a>'), (1, AT, None), (None, AT, ""), (2, None, '<a href="x">é</a>')]
    got = rewrite(spark.createDataFrame(rows, "page_id long, url string, html string"), spark.createDataFrame([], COPY))
    want = [(1, '<a href="https://site.test/x">1</a>')] * 2 + [(1, "<b>2</b>"), (1, None), (2, '<a href="x">é</a>'), (None, "")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_sheets(spark):
    d = spark.createDataFrame([(1, AT + "c/a.css", "c/a.css", "a{b:url(l)} @import 'i'; c{d:url( \"../x.png\" )} é{e:url(data:z)}"), (2, AT, None, None)], "id int, base string, file string, css string")
    got = rewrite_sheets(d, spark.createDataFrame([(AT + "x.png", "x.png")], COPY))
    assert sorted(map(tuple, got.collect())) == [(1, "a{b:url(\"https://site.test/c/l\")} @import 'https://site.test/c/i'; c{d:url( \"../x.png\" )} é{e:url(data:z)}"), (2, None)]


PIECES = st.sampled_from(["<a href=", '"', "'", ">", "x.png", " ", "<style>", "</style>", "url(", ")", "&quot;", "&amp;", "é", "<!--", "-->", "<script>", "</script>", 'srcset="', "style='", ", 2x", "<img src=a ", "\n", "@import ", "𝄞", "<meta content="])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=40).map("".join))
def test_slots_are_places_of_their_references(html):
    end = 0
    for start, length, form, quote, inner, *_, ref in sorted(page_slots(html)):
        assert start >= end and start + length <= len(html)
        end = start + length
        if form in ("attr", "srcset", "sheet"):
            assert html[start:end] == ref
        if quote and form == "attr":
            assert html[start - 1] == html[end] == quote
    assert all(html[i : i + n] == ref for i, n, *_, ref in sheet_slots(html))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=40).map("".join), min_size=25, max_size=25))
def test_bytes_outside_links_stay(spark, htmls):
    """Put back what the slots had, and the page is as it was; links to themselves change nothing else."""
    for html, got in zip(htmls, rewritten(spark, htmls)):
        slots = sorted(s for s in page_slots(html) if s[2] not in ("gone", "base"))
        fixed = sorted(s for s in page_slots(html) if s[2] in ("gone", "base"))
        if fixed:
            continue
        at, rest = 0, got
        for start, length, *_ in slots:
            between = html[at:start]
            assert between in rest
            rest = rest[rest.index(between) + len(between) :]
            at = start + length
        assert rest.endswith(html[at:])


def test_counts_of_slots_of_a_large_page(spark):
    n = 3000
    html = "".join(f'<p>é{k}</p><a href="p{k}.html">' for k in range(n))
    (got,) = rewritten(spark, [html])
    assert got == html.replace('href="', 'href="https://site.test/')
