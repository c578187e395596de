"""What the batches of op2 send to its buckets."""

import collections

import numpy as np
import pyarrow as pa

from archloom.llm import suffix_tree_lm as S

WIDTH, BUCKETS = 6, 4


def batches():
    rng = np.random.default_rng(5)
    out = []
    for _ in range(3):
        texts = [" ".join(f"w{x}" for x in rng.zipf(1.5, 60) % 300) for _ in range(40)]
        out.append(pa.table({"text": texts + [f"only{len(out)}x{k} here" for k in range(20)], "held_out": [k % 5 == 1 for k in range(60)]}))
    return out


def answers(sent):
    """What the buckets say to each batch."""
    by, told = collections.defaultdict(list), collections.defaultdict(list)
    for r in sent:
        by[r[0]].append(r)
    for rows in by.values():
        for r in S._meet(S._unpacked(S._packed(S._table(rows, S._SENT))), WIDTH).to_pylist():
            told[r["batch"]].append(tuple(r[c] for c in ("kind", "level", "bucket", "bits", "n", "first")))
    return told


def passes(tables):
    """Batches that know the counts of tokens and pairs."""
    told = collections.defaultdict(list)
    for done in (-1, 0):
        sent = [r for k, t in enumerate(tables) for r in S._send(S.Batch(t, told[k], None, 3, WIDTH, BUCKETS), k, done)]
        for k, x in answers(sent).items():
            told[k] += x
    every = [[b"", *x.lower().encode().split(), b""] for t in tables for x in t.column("text").to_pylist()]
    train = [p for p, h in zip(every, [h for t in tables for h in t.column("held_out").to_pylist()]) if not h]
    root = sum(len(p) - 1 for p in train), len({w for p in train for w in p})
    return [S.Batch(t, told[k], root, 3, WIDTH, BUCKETS) for k, t in enumerate(tables)], train


def test_each_pair_is_added_by_one_batch():
    made, train = passes(batches())
    kinds, often = collections.defaultdict(float), collections.defaultdict(float)
    for b in made:
        for g, x in zip(*(lambda known, sums: (known.tolist(), sums.T))(*b.sums(1))):
            assert (x[[0, 3, 4]] == np.round(x[[0, 3, 4]])).all()
            kinds[g] += x[0]
            often[g] += x[4]
    pairs = collections.Counter(p[k : k + 2] for p in map(tuple, train) for k in range(len(p) - 1))
    count = collections.Counter(a for (a, _), c in pairs.items() for _ in range(c))
    nexts, more = collections.Counter(a for a, _ in pairs), collections.Counter(a for (a, _), c in pairs.items() if c >= S.LEAST_NEXT)
    want = sorted((nexts[a], more[a]) for a, c in count.items() if c >= S.LEAST_CONTEXT)
    assert len(want) > 20 and sorted((kinds[g], often[g]) for g in kinds) == want


def test_rounds_send_each_row_once_and_a_share_at_a_time():
    made, _ = passes(batches())
    for done in (0, 1):
        whole = list(S._send(made[0], 0, done))
        parts = [list(S._send(made[0], 0, done, part, 2)) for part in range(2)]
        assert sorted(parts[0] + parts[1]) == sorted(whole)
        size = [sum(len(r[4]) + len(r[5]) for r in p) for p in parts]
        assert max(size) < 0.7 * sum(size)


def test_pairs_after_rare_words_are_not_sent():
    made, _ = passes(batches())
    for b in made:
        b.level(1)
        places = b.grams[1][0]
        assert (b.before(1)[places] >= S.LEAST_CONTEXT).all() and len(places) < (b.place > 0).sum()


def test_distinct_of_values_alike_but_for_low_bits():
    rng = np.random.default_rng(2)
    for x in (rng.integers(0, 1 << 63, 5000, dtype=np.uint64), np.repeat(rng.integers(0, 1 << 63, 50, dtype=np.uint64), 90) + rng.integers(0, 3, 4500, dtype=np.uint64), np.array([2**64 - 1, 0, 7, 0], np.uint64), np.array([3], np.uint64), np.zeros(0, np.uint64)):
        known, number = S._distinct(x)
        assert known.tolist() == sorted(set(x.tolist())) and (known[number] == x).all()
