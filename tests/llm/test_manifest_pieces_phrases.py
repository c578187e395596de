"""Merkle manifest, merge-type pieces and phrase collocations against plain Python, on small tables with odd rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from archloom.llm import collocations as C
from archloom.llm.collocations import collocations, phrase_counts
from archloom.llm.merkle_manifest import ARITY, BLOCK, manifest
from archloom.llm.piece_tokens import Pieces, piece_tokens, pieces

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, id string, hash string, level int, seq long"


def docs(spark, rows):
    """Rows of doc_id, text, lang, source; the other columns have names that the operators use inside."""
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, "x", "y", "z", 1, 2) for r in rows], DOCS)


# Manifest.
def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*(enc(v) for v in (row[0], row[3], row[2], len(row[1]) if row[1] is not None else None, text)))


def _tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def _siblings(levels, k):
    for nodes in levels[:-1]:
        run = k - k % 3
        yield nodes[run:k], nodes[k + 1 : run + 3]
        k //= 3


def expected(rows):
    first = lambda x: (x is not None, x)
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    by = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (first(r[0]), _leaf(r, r[1]))) for s in sources}
    trees = {s: _tree([_leaf(r, r[1]) for r in by[s]]) for s in sources}
    top = _tree([trees[s][-1][0] for s in sources]) if rows else []
    out = []
    for i, s in enumerate(sources):
        for k, r in enumerate(by[s]):
            way = [*_siblings(trees[s], k), *_siblings(top, i)]
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = _leaf(r, r[1].replace("\n", "") if even and r[1] is not None else r[1])
            for left, right in way:
                folded = H(*left, folded, *right)
            out.append((r[0], trees[s][0][k], trees[s][-1][0], top[-1][0], H(*(h for left, right in way for h in left + right)), folded, folded == top[-1][0]))
    return out


ROWS = [
    (1, "a\nb", "en", "s"), (2, None, None, "s"), (3, "", "fr", None), (None, "x\n", "en", None), (4, "é" * 3000 + "\n", "en", "é"), (5, "same", "en", "s"), (5, "same", "en", "s"), (5, "other", "en", "s"),
    (2**62, "big\n\n", "de", "one"), *((k, f"line {k}\nend", "en", "many") for k in range(100, 100 + 2 * BLOCK + 5)), *((k, "t\n", "en", f"src{k}") for k in range(5000, 5014)),
]


def test_manifest_is_the_tree_by_definition(spark):
    d = manifest(docs(spark, ROWS))
    got = d.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof").collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(expected(ROWS), key=str)
    for r in got:  # a proof holds all that the root needs
        h = r.leaf
        for step in r.proof.split(";") if r.proof else []:
            left, right = step.split("<")
            h = H(left, h, right)
        assert h == r.root and len(re.findall("[0-9a-f]{64}", r.proof)) <= (ARITY - 1) * 12
    assert 0 < sum(r.verified for r in got) < len(got)


@pytest.mark.parametrize("rows", [[], ROWS[:1], ROWS[:3], [(k, "x", "en", "s") for k in range(BLOCK)], [(k, "x", "en", "s") for k in range(BLOCK + 1)]])
def test_manifest_of_small_tables(spark, rows):
    got = manifest(docs(spark, rows), proofs=False).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(rows), key=str)


# Pieces.
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


ODD = ["", " ", "  two  ", "\n\t\r\n", "▁▁a▁ b", "<s></s><unk><0x41>", "ﬁ½é̀☃𝄞​\x00", "the " * 4000, "x" * 5000, "тест 中文字 テスト", " ⁇ ", "entzachach,entzachach;" * 300]


def test_pieces_are_those_of_the_library(spark):
    rows = [(k, t, "en", "s") for k, t in enumerate(ODD)] + [(None, None, None, None), (3, ODD[3], "en", "s")]
    sp = pieces(model()).library
    got = piece_tokens(docs(spark, rows), model()).collect()
    assert len(got) == len(rows) and all(r.agrees for r in got)
    for r in got:
        text = ODD[r.doc_id] if r.doc_id is not None else ""
        ids = sp.encode(text, add_bos=True, add_eos=True)
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.ids, r.n_tokens, r.ids_sha256) == (ids, len(ids), hashlib.sha256(raw).hexdigest())
        assert r.decoded == sp.decode(ids) and r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert piece_tokens(docs(spark, []), model()).collect() == []


LETTERS = st.text(st.one_of(st.sampled_from(" \n▁abetin<>0x4,.'é☃中𝄞"), st.characters(exclude_categories=["Cs"])), max_size=120)


@settings(max_examples=400, deadline=None)
@given(LETTERS)
def test_encoding_and_decoding_agree_with_the_library(text):
    p = pieces(model())
    ids = [int.from_bytes(p.encode(text)[k : k + 4], "little") for k in range(0, len(p.encode(text)), 4)]
    assert ids == p.library.encode(text)
    import numpy as np

    assert p.decode(np.array(ids, "<u4")) == p.library.decode(ids)


def test_both_agendas_give_the_same_symbols():
    p, rng = Pieces(model()), random.Random(5)
    for _ in range(3000):
        part = "".join(rng.choices("▁entihaosdr", k=rng.randint(1, 40)))
        agenda = [p.score.get(a + b, float("inf")) for a, b in itertools.pairwise(part)]
        assert p.merged(part, agenda) == p._by_heap(part)


def test_any_ids_decode_as_the_library_decodes_them():
    import numpy as np

    p, rng = pieces(model()), random.Random(6)
    pool = [0, 1, 2, 29871, *range(3, 259), *range(259, 32000, 53)]
    for _ in range(3000):
        ids = rng.choices(pool, k=rng.randint(0, 9))
        assert p.decode(np.array(ids, "<u4")) == p.library.decode(ids)


# Phrases.
def counted(rows):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def best(rows, least, top, cover=100):
    f, n = counted(rows)
    out = []
    for lang, counts in f.items():
        c = {g: a for g, a in counts.items() if a >= least}
        inside = collections.Counter()
        for g, a in c.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i : i + k]] = max(inside[g[i : i + k]], a)
        scored = []
        for g, a in c.items():
            if len(g) > 1 and 100 * inside[g] < cover * a:
                score, k = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, r, g.decode(), -a, x, y, n[lang], -s) for r, (s, a, g, x, y) in enumerate(sorted(scored)[:top], 1)]
    return out


def made(n, seed=3):
    rng = random.Random(seed)
    words = ["the", "New", "york", "city", "of", "é", "Éa", "a-b", "x y", "of"]
    texts = [rng.choice([" ", "\t", "  "]).join(rng.choices(words, k=rng.randint(0, 40))) + rng.choice([". new york city", ", NEW york\ncity of the", "", "!"]) for _ in range(n)]
    return [(k, t, rng.choice(["en", "de", None, "und"]), "s") for k, t in enumerate(texts)]


@pytest.mark.parametrize("least, top, cover, size", [(5, 30, 100, 2000), (3, 2000, 60, 300), (20, 2000, 100, 1 << 20)])
def test_phrases_against_brute_force(spark, least, top, cover, size):
    rows = made(300) + [(900, None, "en", "s"), (901, "", None, "s"), (902, "word " * 3000, "en", "s"), (903, "new york city. " * 200, "fr", "s")] + [(904, "twice the same text of new york", "en", "s")] * 40
    got = collocations(docs(spark, rows), least=least, top=top, cover=cover, shard_bytes=size).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == sorted(best(rows, least, top, cover)) and got


def test_counts_of_phrases_are_exact_over_many_shards(spark):
    rows = made(400, 8)
    counts, n = phrase_counts(docs(spark, rows), least=4, shard_bytes=500)
    f, want = counted(rows)
    assert {(r.lang, r.phrase): r.f for r in counts.collect()} == {(lang, " ".join(g)): a for lang, c in f.items() for g, a in c.items() if a >= 4}
    assert {r.lang: r.n for r in n.collect()} == {k: v for k, v in want.items() if v}


def test_scores_beyond_64_bits_are_exact(spark, monkeypatch):
    a, l, r, n = 10**12 + 7, 10**12 + 9, 10**12 + 11, 10**15 + 3
    counts = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, l), ("en", "y", 1, r)], "lang string, phrase string, n_words int, f long")
    monkeypatch.setattr(C, "phrase_counts", lambda *x: (counts, spark.createDataFrame([("en", n)], "lang string, n long")))
    (got,) = collocations(docs(spark, [])).collect()
    assert got.score == 1000 * a * n // (l * r)


def test_no_phrases(spark):
    for rows in ([], [(1, None, None, None)], [(1, "a b", "en", "s")]):
        assert collocations(docs(spark, rows), least=2).collect() == []


def test_table_of_the_given_documents(spark):
    """Whole results at a small size, against the SQL registered with the query."""
    from archloom.llm.registry import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS FROM '/root/testdata/sf0.01/documents.parquet'")
    cur = con.execute(ORACLE_SQL["op13_collocations"])
    names = [c[0] for c in cur.description]
    assert sorted(map(tuple, QUERIES["op13_collocations"](spark, "/root/testdata/sf0.01").select(*names).collect())) == sorted(cur.fetchall())
