"""Operators against brute force on the smallest tables, with planted near copies and passages."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from archloom.llm.html_text import op10_html_text
from archloom.llm.ordinal_quality import op3_ordinal_quality
from archloom.llm.patience_lines import common_lines, line_dedup, patience
from archloom.llm.shingle_join import PrefixTree, links, shingle_sets
from archloom.llm import suffix_dedup as suffix_module
from archloom.llm.suffix_dedup import blind_trie_order, first_holders, suffix_dedup
from archloom.llm.suffix_tree_lm import DEPTH, op2_suffix_tree_lm
from archloom.llm.swap_packing import Ids, best_fit, improve, op5_swap_packing, tokenizer_path

SF = "/root/testdata/sf0.001"
#: No word holds white space, so this is no word.
END_WORD = b"\n"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def planted():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    out, base = [], [word() for _ in range(150)]
    for i in range(120):
        if i % 3 == 0:
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(r.randint(3, 90))]
        if i % 4 == 1:
            w += passage.split()
        out.append((i, " ".join(w)))
    return out


def test_components_match_all_pairs(spark):
    rows = planted()
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    sets = {i: grams(t.lower().split()) for i, t in rows}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    got = {r.id: r.component_id for r in links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in sets}


def test_prefix_tree_finds_each_link_once():
    rng = np.random.default_rng(1)
    for _ in range(150):
        base = np.unique(rng.integers(0, 300, rng.integers(5, 80)))
        sets = [np.unique(np.r_[rng.choice(base, max(1, int(len(base) * rng.uniform(0.7, 1))), replace=False), rng.integers(0, 300, rng.integers(0, 8))]) for _ in range(rng.integers(2, 25))]
        # Some n-grams stand before all others and are nobody else's.
        lone = rng.integers(0, 3, len(sets))
        n = np.array([len(s) for s in sets]) + lone
        lists = [s[: max(0, m - -(-m * 80 // 100) + 1 - u)] for s, m, u in zip(sets, n.tolist(), lone.tolist())]
        right = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and 180 * len(np.intersect1d(sets[i], sets[j])) >= 80 * (n[i] + n[j])}
        got = []
        for token in np.unique(np.concatenate(lists)).tolist():
            held = [k for k in range(len(sets)) if token in lists[k]]
            tree = PrefixTree([lists[k] for k in held], n[held], lone[held])
            x, y = tree.candidates(token, [lists[k] for k in held], n[held], lone[held], 80)
            got += [(held[a], held[b]) for a, b in zip(x, y) if a != b]
        assert len(got) == len(set(got)) and right <= set(got)


def test_shingles_are_those_of_the_words():
    r = random.Random(8)
    texts = [" ".join(r.choice(["a", "B", "ab", "\u00e9", "c" * r.randint(1, 9)]) for _ in range(r.randint(0, 40))) + r.choice(["", "\n", " \t"]) for _ in range(300)]
    texts += ["", " \n\x0b\x0c\r\t ", "x" * 2_500_000 + " y z", ("word " * 400_000).strip(), "x" * 2_500_000 + "\u00a0 Y z"]
    values, offsets = shingle_sets([t.encode() for t in texts])
    known, number = {}, {}
    for t, i, j in zip(texts, offsets, offsets[1:]):
        w = t.encode().lower().split()
        grams = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        assert len(grams) == j - i
        mine = frozenset(values[i:j].tolist())
        assert known.setdefault(frozenset(grams), mine) == mine
        number.setdefault(mine, frozenset(grams))
    assert len(known) == len(number)


def removed(rows, length=50):
    first = {}
    for i, t in sorted(rows):
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], i)
    out = {}
    for i, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = True
        gone = gone[:-1]
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0
        out[i] = (len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())
    return out


def test_suffix_dedup_matches_windows(spark, texts):
    rows = planted() + [(1000 + i, t) for i, t in texts.items()]
    want = removed([(i, t.encode()) for i, t in rows])
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_blind_trie_sorts():
    r = random.Random(2)
    for _ in range(50):
        s = list({bytes(r.choice(b"ab") for _ in range(12)) for _ in range(40)})
        assert [s[k] for k in blind_trie_order(s)] == sorted(s)


def test_first_holders_by_hand():
    buf = np.frombuffer(b"a" * 50 + b"a" * 50 + b"a" * 49 + b"b", np.uint8)
    assert first_holders(buf, np.array([0, 50, 100]), np.array([5, 3, 9])).tolist() == [3, 3, 9]


def test_suffix_dedup_of_long_texts_and_hot_passages(spark, monkeypatch):
    r = random.Random(12)
    prose = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, long = prose(400), prose(700_000)
    rows = [(i, prose(30) + passage[(i % 7) * 3 :] + prose(60)) for i in range(150)]
    rows += [(500, long), (400, prose(100) + long[524_200:524_500]), (501, long[:90_000] + prose(20) + long[600_000:]), (501, long[:300]), (600, None), (502, "ab" * 400), (503, "x" + "ab" * 100)]
    want = removed([(i, (t or "").encode()) for i, t in rows])
    for hot in (10**9, 5):  # whole extents, then window by window
        # Arrow functions are sent to the workers with what they refer to.
        monkeypatch.setattr(suffix_module, "HOT", hot)
        got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_bytes=True).collect()
        for x in got:
            if x.doc_id != 501:
                assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == want[x.doc_id]
            if x.kept is not None:
                assert hashlib.sha256(x.kept).hexdigest() == x.kept_sha256
        assert {x.n_bytes: x.n_removed for x in got if x.doc_id == 501} == {300: 300, 190_020: 190_000}


def test_language_model(spark, texts):
    words = {i: t.encode().lower().split() + [END_WORD] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    count = collections.Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    rows = op2_suffix_tree_lm(spark, SF).collect()
    for r in rows:
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words[r.doc_id]), rel_tol=1e-9)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(words[r.doc_id]), sum(w in count for w in words[r.doc_id]), n)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    # The tree by definition: counts of all n-grams, contexts level by level, the longest suffix kept.
    path = {i: [END_WORD, *ws] for i, ws in words.items()}
    grams = collections.Counter(tuple(p[k - j : k + 1]) for i, p in path.items() if not held[i] for k in range(1, len(p)) for j in range(1, DEPTH + 1) if k >= j)
    after = collections.defaultdict(dict)
    for g, c in grams.items():
        after[g[:-1]][g[-1]] = c
    kept = {(): None}

    def chance(context, w):
        if not context:
            return (count[w] + 0.5) / (n + 0.5 * (v + 1))
        if context not in kept or context[1:] not in kept:
            return chance(context[1:], w)
        nexts = after[context]
        return (nexts.get(w, 0) + len(nexts) * chance(context[1:], w)) / (sum(nexts.values()) + len(nexts))

    for size in range(1, DEPTH + 1):
        for context, nexts in after.items():
            total = sum(nexts.values())
            if len(context) != size or total < 8 or context[1:] not in kept:
                continue
            often = {w: c for w, c in nexts.items() if c >= 2}
            above = {w: chance(context[1:], w) for w in often}
            g = sum(c * math.log(c / total / above[w]) for w, c in often.items())
            rest, rest_above = 1 - sum(often.values()) / total, 1 - sum(above.values())
            if rest > 1e-12 and rest_above > 1e-12:
                g += total * rest * math.log(rest / rest_above)
            if often and 2 * g > len(often) + 4 * math.sqrt(2 * len(often)):
                kept[context] = None
    assert len(kept) > 20 and all(any(len(k) == size for k in kept) for size in (1, 2))
    for r in rows:
        p = path[r.doc_id]
        want = sum(math.log10(chance(tuple(p[max(0, k - DEPTH) : k]), p[k])) for k in range(1, len(p)))
        assert math.isclose(r.score, want, rel_tol=1e-9)


def test_classifier_beats_chance_on_the_held_out_fold(spark):
    grade = {r.doc_id: 0 if r.quality <= 0 else 1 if r.toxic else 2 for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in op3_ordinal_quality(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in grade]
    pairs = [(a.p_above_1 > b.p_above_1) for a in rows for b in rows if grade[a.doc_id] == 2 and grade[b.doc_id] < 2]
    assert sum(pairs) / len(pairs) > 0.8
    assert all(r.p_above_0 >= r.p_above_1 for r in rows)


def test_tokens_are_those_of_the_whole_text(texts):
    ids = Ids(tokenizer_path())
    cases = [*texts.values(), "a  b", " x", "x ", "a\n\nb", "a\nb c\td e", "x\r\ny z", "don't it's 'll 12a b3 ##", "é   ü", ""]
    cases += ["a\n", "\na", "\n", "\n\n", "\n\nb", "a\n\n", "a\n\n\nb", "a\n b", "a \nb", "a\t b", "a\tb c", " \n", "\n ", "a <|endoftext|> b", "<|endoftext|>", "\u00a0a b", "a\u2003 b", "a\x1c b", "a\n\n b"]
    r = random.Random(9)
    cases += ["".join(r.choice(["a", "Bc", " ", "\n", "'s", "1", "\t", "\u00e9", "."]) for _ in range(r.randint(1, 12))) for _ in range(3000)]
    assert ids.all(cases) == ids.encode(cases)
    assert ids.all(cases[::-1]) == ids.encode(cases[::-1])  # with what is remembered


def test_packing_by_its_contract(spark, texts):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    by_doc, by_bin = collections.defaultdict(dict), collections.defaultdict(list)
    for r in op5_swap_packing(spark, SF).collect():
        assert r.piece not in by_doc[r.doc_id]
        by_doc[r.doc_id][r.piece] = r
        by_bin[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == texts.keys()
    total = 0
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        rows = [by_doc[i][k] for k in range(len(by_doc[i]))]
        assert rows[0].start == 0 and all(a.start + a.length == b.start for a, b in zip(rows, rows[1:]))
        assert rows[-1].start + rows[-1].length == len(ids) and all(r.length == 2048 for r in rows[1:]) and 0 < rows[0].length <= 2048
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in rows)
    for b in by_bin.values():
        b.sort()
        assert b[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(b, b[1:])) and sum(n for _, n in b) <= 2048
    # Within a hundredth of the least number that any packing could have.
    assert len(by_bin) <= math.ceil(1.01 * math.ceil(total / 2048))


def test_local_search_never_adds_bins():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 100, 200)
        bins = best_fit(lengths, 100)
        better = improve([list(b) for b in bins], lengths, 100)
        assert len(better) <= len(bins)
        assert sorted(i for b in better for i in b) == list(range(200))
        assert all(lengths[b].sum() <= 100 for b in better)


def test_patience_places_rise_and_match():
    r = random.Random(4)
    for _ in range(100):
        a = [r.randrange(30) for _ in range(40)]
        b = a[5:20] + [r.randrange(30) for _ in range(10)] + a[25:]
        pairs = patience(a, b)
        assert all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert common_lines([1, None, 2, 3], [9, 1, None, 2, 8], [3, 15, 0, 15, 2], 20) == [1, 3]


def shared_places(first, later, words, least):
    """By definition: the lines of later in any stretch of enough words that first has too."""
    keep = [k for k, n in enumerate(words) if n]
    a, b = [x for x in first if x is not None], [later[k] for k in keep]
    held = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
    return {k for i in range(len(b)) for j in range(i + 1, len(b) + 1) if sum(words[k] for k in keep[i:j]) >= least and tuple(b[i:j]) in held for k in keep[i:j]}


def test_repeats_and_swaps_are_common_blocks():
    assert common_lines([7, 7], [1, 7, 2], [5, 60, 5], 20) == [1]
    assert common_lines([1, 2, 3, 4], [3, 4, 1, 2], [15, 15, 15, 15], 20) == [0, 1, 2, 3]
    r = random.Random(6)
    for _ in range(300):
        size = {k: r.randint(1, 14) for k in range(6)}
        a, b = ([r.choice([None, *size]) for _ in range(r.randint(0, 14))] for _ in range(2))
        words = [size.get(x, 0) for x in b]
        assert common_lines(a, b, words, 20) == sorted(shared_places(a, b, words, 20))


def test_line_dedup_rows_match_brute_force(spark):
    r = random.Random(7)
    line = [" ".join(f"w{k}x{n}" for n in range(r.randint(1, 15))) for k in range(25)]
    docs = {i: [r.choice(["", *line, f"own {i}"]) for _ in range(r.randint(0, 12))] for i in range(60)}
    for i in range(0, 60, 4):  # passages of an earlier document, swapped and repeated
        p = docs[i][: len(docs[i]) // 2]
        docs[i + 3] = [*docs[i][len(p) :], "between", *p, *p]
    hashes = {i: [x or None for x in d] for i, d in docs.items()}
    rows = line_dedup(spark.createDataFrame([(i, "\n".join(d)) for i, d in docs.items()], "doc_id long, text string")).collect()
    got = {x.doc_id: (x.text, x.n_removed) for x in rows}
    for i, d in docs.items():
        d = d or [""]
        words = [len(x.split()) for x in d]
        gone = set().union(*(shared_places(hashes[j], hashes[i], words, 20) for j in range(i))) if docs[i] else set()
        assert got[i] == ("\n".join(x for k, x in enumerate(d) if k not in gone), len(gone))
    assert sum(n for _, n in got.values()) > 50


def test_pages_give_their_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in op10_html_text(spark, SF).collect():
        inside = re.split(r"</article>", pages[r.page_id].split("<article>", 1)[-1])[0]
        plain = re.sub(r"<[^>]*>", " ", inside).replace("&amp;", "&").replace("&quot;", '"').split()
        assert r.text.split() == plain or not plain


def test_main_text_inside_what_only_seems_outside():
    from archloom.llm.html_text import main_text, trained

    tree, long = trained(), "Long enough words of an article that a reader came here for, one after the other, until it ends well."
    for page in (
        f"<form><div><h1>Title</h1><p>{long}</p><p>{long}</p></div></form>", f"<nav><ul><li><a>Home</a></ul><article><p>{long}</p></article>", f"<aside><ul><li><a>Home</a></ul><article><p>{long}</p></article>",
        f'<div class="social-article-body"><p>{long}</p><p>{long}</p></div>', f'<div id="page-header-wrap"><article><p>{long}</p></article></div>', f'<main><section class="newsletter-issue"><p>{long}</p></section></main>',
    ):
        assert long in main_text(page, tree) and "Home" not in main_text(page, tree)
    outside = f'<nav><a>Home</a></nav><div class="cookie-notice"><p>{long}</p></div><div class="comments"><article><p>{long}</p></article></div><footer><p>{long}</p></footer>'
    assert main_text(outside, tree) == "" and main_text(None, tree) == "" and main_text("", tree) == ""
    assert main_text(outside + f"<article><p>{long} Indeed.</p></article>", tree) == f"{long} Indeed."
