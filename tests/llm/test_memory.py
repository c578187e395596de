"""What a batch or bucket of op2 holds at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from archloom.llm import suffix_tree_lm as S


def _peak(f):
    tracemalloc.start()
    out = f()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_sums_of_a_batch_take_one_part_at_a_time():
    words = np.random.default_rng(3).integers(0, 2000, 400_000)
    t = pa.table({"text": [" ".join(map(str, w)) for w in words.reshape(400, -1)], "held_out": [k % 5 == 1 for k in range(400)]})
    b = S.Batch(t, [], (400_000, 2001), 3, 6, 12)
    b.level(1)
    (known, sums), peak = _peak(lambda: b.sums(1))
    assert sums.shape == (6, len(known)) and sums[5].sum() > 0
    assert peak < 10 * 8 * len(b.token)


def test_sums_of_a_bucket_take_one_part_at_a_time():
    rng, rows, n = np.random.default_rng(1), [], 40_000
    for k in range(8):
        g = np.unique(rng.integers(0, 1 << 40, n, dtype=np.uint64))
        sums = np.abs(rng.normal(size=(5, len(g)))).astype("<f4")
        rows.append((5, k, S._SUMS, 2, S.planes(S.steps(g), 6), sums.tobytes() + S.planes(np.full(len(g), 9, np.int64), S._COUNT)))
    out, peak = _peak(lambda: S._meet(S._table(rows, S._SENT), 6))
    assert out.num_rows == 8 and peak < 20 * 8 * n * 8
