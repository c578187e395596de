"""How op12 meets its library."""

import numpy as np

from archloom.llm import piece_tokens as P


def test_the_library_answers_with_arrays():
    class Library:
        def encode_as_numpy(self, text, add_bos, add_eos):
            assert add_bos and add_eos
            return np.array([1, 7, 2], np.int32)

        def decode(self, ids):
            return "x" if ids.tolist() == [1, 7, 2] else ""

    ids = np.array([1, 7, 2], "<u4")
    assert P.agree(Library(), "x", ids, "x")
    assert not P.agree(Library(), "x", ids, "y") and not P.agree(Library(), "x", ids[:2], "x")
