"""Every training-data operator on tables with nulls, blanks, ties, repeats, long texts and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from archloom.llm.divergence_rules import passing, quality_rules
from archloom.llm.exact_dedup import exact_dedup
from archloom.llm.html_text import extract
from archloom.llm.ordinal_quality import quality
from archloom.llm.patience_lines import line_dedup
from archloom.llm.shingle_join import links, one_of_each
from archloom.llm.source_mix import mix, mixed
from archloom.llm.suffix_dedup import suffix_dedup
from archloom.llm.suffix_tree_lm import score
from archloom.llm.swap_packing import pack

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, kept string, n string, row string, n_removed string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "and"]) if r.random() < 0.3 else "".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def nasty(spark):
    long = prose(1, 30_000)
    texts = [
        (1, "Hello  world", "en", "a"), (2, "Helloworld", "en", "b"), (3, None, "en", None), (4, "", None, "a"), (5, " \n\t ", "fr", "b"), (6, long, "en", "a"), (7, long, "xx", None), (7, long, "xx", None),
        (8, prose(2, 120), "en", "a"), (9, prose(2, 120) + " more", "en", "a"), (None, "no id here", "en", "a"), (None, None, None, None), (10, "one\n\none\ntwo\n", "de", "c"), (11, prose(3, 80) + "\n" + prose(4, 60), "es", "c"), (12, "x\n" + prose(4, 60), "es", "c"),
        (13, "a b   \x00 c\U0001f600", "en", "d"), (14, "<|endoftext|> it's", "en", "d"), (15, "word", "en", "d"), (15, "other word", "en", "d"),
    ]
    return spark.createDataFrame([(i, t, l, s, len(t or ""), "x", "y", "z", "w", "v") for i, t, l, s in texts], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(8, 1, 0), (9, 1, 1), (6, 0, None), (99, None, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "exact_dedup": lambda d: exact_dedup(d),
    "score": lambda d: score(d),
    "quality": lambda d: quality(d, labels(d.sparkSession)),
    "quality_rules": lambda d: quality_rules(d),
    "suffix_dedup": lambda d: suffix_dedup(d),
    "links": lambda d: links(d),
    "line_dedup": lambda d: line_dedup(d),
    "mix": lambda d: mix(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_document(spark, name):
    d = nasty(spark)
    out = OPERATORS[name](d)
    rows = out.collect()
    assert len(rows) == d.count()
    assert OPERATORS[name](d.limit(0)).count() == 0


def test_exact_dedup_groups_and_keeps_one(spark):
    rows = exact_dedup(nasty(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.text_sha256, []).append(r)
    for group in by.values():
        assert {r.group_size for r in group} == {len(group)}
        assert sum(r.kept for r in group) == 1
    assert {r.doc_id: r.keep_id for r in rows if r.doc_id in (1, 2)} == {1: 1, 2: 1}  # more code points, then smaller
    assert {r.doc_id: r.keep_id for r in rows if r.doc_id in (3, 4, 5)} == {3: 5, 4: 5, 5: 5}


def test_colliding_digests_are_told_apart_by_bytes(spark):
    d = nasty(spark)
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    weak = exact_dedup(d, digest=lambda c: (F.length(c) % 3).cast("string"), memtable_rows=2, fan_in=2)
    assert sorted(map(str, weak.select(columns).collect())) == sorted(map(str, exact_dedup(d).select(columns).collect()))


def test_packing_of_nasty_texts(spark):
    rows = pack(nasty(spark), capacity=64).collect()
    bins = {}
    for r in rows:
        assert 0 < r.length <= 64
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert pack(nasty(spark).limit(0)).count() == 0


def test_mix_meets_targets(spark):
    d = spark.createDataFrame([(i, prose(i, 40 + i % 7), "s%d" % (i % 5) if i % 11 else None) for i in range(400)], "doc_id long, text string, source string")
    rows = mix(d, shard_rows=50, block_words=8).collect()
    total = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        t = total.setdefault(r.source, [0, 0, r.target, r.source_size])
        t[0] += r.taken
        t[1] += r.size
    assert all(size == source_size and abs(taken - target) <= 16 and target <= 3 * size + 1e-6 for taken, size, target, source_size in total.values())
    assert abs(sum(t[2] for t in total.values()) - sum(t[1] for t in total.values())) < 1e-6
    # The stage's rows hold just the words taken.
    n = mixed(d).select(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0]
    assert n == sum(r.taken for r in mix(d).collect())


def test_a_part_of_a_document_keeps_its_white_space(spark):
    texts = {i: " \n" + prose(i, 40 + i % 7).replace(" ", "\n\n" if i % 2 else " \t", 20) for i in range(200)}
    d = spark.createDataFrame([(i, t, "s%d" % (i % 5)) for i, t in texts.items()], "doc_id long, text string, source string")
    taken = {r.doc_id: (r.taken, r.size) for r in mix(d).collect()}
    rows = mixed(d).collect()
    parts = [r for r in rows if r.text != texts[r.doc_id]]
    assert parts and sum(len(r.text.split()) for r in rows) == sum(n for n, _ in taken.values())
    for r in parts:
        n, size = taken[r.doc_id]
        assert texts[r.doc_id].startswith(r.text) and len(r.text.split()) == n % size and r.text == r.text.rstrip()


def test_rules_and_groups_keep_whole_rows(spark):
    d = nasty(spark)
    assert passing(d).columns == d.columns
    kept = one_of_each(d)
    assert kept.columns == d.columns
    assert kept.where("doc_id = 7").count() == 0 and kept.where("doc_id = 6").count() == 1


def test_line_blocks_go_from_the_later_document(spark):
    rows = {r.doc_id: r for r in line_dedup(nasty(spark)).where("doc_id > 9").collect()}
    assert rows[11].n_removed == 0
    assert rows[12].text == "x" and rows[12].n_removed == 1


def test_a_block_meets_a_holder_however_its_lines_are_held(spark):
    # Each line of the block occurs singly in an earlier document, as other lines do in many.
    one, two, tail, line = prose(20, 8), prose(21, 12), prose(22, 5), lambda k: prose(30 + k, 6)
    rows = [(0, one), (1, two), (2, f"{one}\n{two}"), (3, f"{one}\n{two}\n{tail}"), (4, f"{one}\n\n{two}\n{tail}\nown")]
    rows += [(10 + k, prose(50, 25)) for k in range(70)]
    rows += [(100 + k, line(k)) for k in range(3)] + [(110, "\n".join([*map(line, range(3)), prose(50, 25)]))]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == f"{one}\n{two}"
    assert got[3] == tail
    assert got[4] == "\nown"
    assert got[10] == prose(50, 25) and not any(got[k] for k in range(11, 80))
    assert got[110] == "\n".join(map(line, range(3)))


def test_html_text(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<html><body><nav><a href=x>x</a></nav><article><h1>T &amp; t</h1><p>a\n b<p>c<script>no</script></article><footer>f</footer>"), (4, "u", "<p>" + "word " * 60 + "</p><div class=sidebar><p>" + "side " * 60 + "</p></div>")]
    got = {r.page_id: (r.text, r.n_chars) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == ("", 0)
    assert got[3][0] == "T & t\n\na b\n\nc"
    assert got[4][0] == ("word " * 60).strip()


def test_attributes_are_read_whole(spark):
    text = lambda k: prose(60 + k, 60)
    bodies = {
        1: f'<p>{text(1)} <a href="/hidden-beaches">here</a> {text(2)}</p>',
        2: f'<div title="a hidden life"><p>{text(1)}</p></div>',
        3: f'<div data-hidden="false" data-class="nav" title=\'style="display:none"\'><p>{text(1)}</p></div>',
        4: f'<header class="entry-header"><h1>The headline</h1></header><p>{text(1)}</p>',
        5: f'<div class="post_header share"><p>{text(2)}</p></div><div HIDDEN><p>{text(3)}</p></div><div id=x style="display: none"><p>{text(4)}</p></div><div class=nav><p>{text(5)}</p></div><p>{text(1)}</p>',
    }
    rows = [(k, "u", f"<html><body><article>{b}</article></body></html>") for k, b in bodies.items()]
    rows.append((6, "u", f'<body><div class="site-header"><p>{text(2)}</p></div><article><p>{text(1)}</p></article></body>'))
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == f"{text(1)} here {text(2)}"
    assert got[4] == f"The headline\n\n{text(1)}"
    assert all(got[k] == text(1) for k in (2, 3, 5, 6))


def test_layouts_that_hold_their_main_text(spark):
    text = lambda k: prose(90 + k, 60)
    nav = '<nav><a href="/">home</a> <a href="/x">more links</a></nav>'
    pages = {
        1: f'<div class="layout has-sidebar"><article><p>{text(1)}</p></article></div>',
        2: f'<div class="content no-sidebar"><p>{text(1)}</p></div>',
        3: f'<div data-role="search"><article><p>{text(1)}</p></article></div>',
        4: f'{nav}<div><p>{text(1)}</p><p>{text(2)}</p></div><article><p>{prose(99, 12)}</p></article>',
        5: f'<article><p>{text(1)}</p><button>press<p>{text(2)}</p></article>',
        6: f'<article><p>{text(1)}</p><audio src="x"><p>{text(2)}</p></article>',
        7: f'<article><p>{text(1)}</p><select><option>a<p>{text(2)}</p><button>b</button></article>',
        8: f'<div class="page sidebar-left"><main><p>{text(1)}</p></main></div>',
        9: f'<article><p>{text(1)}</p></article><div class="comments"><article><p>{text(2)}</p></article></div>',
    }
    rows = [(k, "u", f"<html><body>{b}</body></html>") for k, b in pages.items()]
    rows += [rows[0]]  # repeated rows are rows of their own
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.text) for r in extract(d).collect()]
    assert len(got) == 10
    want = {k: text(1) for k in (1, 2, 3, 8, 9)} | {k: f"{text(1)}\n\n{text(2)}" for k in (5, 6, 7)}
    assert {k: t for k, t in got if k in want} == want
    assert f"{text(1)}\n\n{text(2)}" in dict(got)[4]
    assert extract(d.limit(0)).count() == 0
