"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies, in Arrow batches.

A text becomes symbols, one a character, with blanks as U+2581 and one before the text. An agenda
holds the adjacent pairs that are pieces, best score first and leftmost among equals; the best pair is
merged, and the pairs that the new symbol makes are added, until none is left. A symbol that is no
piece becomes the pieces of its bytes.

A merge across two neighbouring characters makes a piece that contains them side by side. So a text
is cut before each run of blanks, and further wherever no piece has the two characters side by side;
the parts are encoded on their own, and remembered. Each batch is checked against the sentencepiece
library, whose model file gives the vocabulary.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_of

BLANK = "▁"
#: Distinct parts of texts whose ids a worker remembers, twice: those met since the last turn, and those of the turn before.
REMEMBERED = 1_000_000
#: Characters of a part that is short: remembered, and its agenda a list.
_SHORT = 64
#: Score of a pair that is no piece; scores count from the best, 0 or less in the model, upwards.
_NONE = float("inf")


class Pieces:
    """The vocabulary of a model file, the encoder and the decoder."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        sp, n = self.library, self.library.get_piece_size()
        if sp.unk_id() < 0 or sp.bos_id() < 0 or sp.eos_id() < 0:
            raise ValueError("the vocabulary lacks unknown, begin or end")
        text = [sp.id_to_piece(k) for k in range(n)]
        normal = [k for k in range(n) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k))]
        self.id_of = {text[k]: k for k in normal}
        if any(BLANK in w.lstrip(BLANK) for w in self.id_of):
            raise ValueError("a piece has a blank after another character")
        self.score = {text[k]: -sp.get_score(k) for k in normal}
        self.byte_id = {int(text[k][3:5], 16): k for k in range(n) if sp.is_byte(k)}
        if len(self.byte_id) < 256:
            raise ValueError("the vocabulary has no pieces for bytes")
        #: Pairs of characters that stand side by side in a piece, and their score.
        self.pairs = {p: self.score.get(p, _NONE) for w in self.id_of for k in range(len(w) - 1) if (p := w[k : k + 2])}
        #: ASCII characters that no piece has beside another one stand alone.
        alone = [chr(c) for c in range(128) if not any(chr(c) in p for p in self.pairs)]
        cls = "".join(map(re.escape, alone))
        self.parts = re.compile(f"{BLANK}+[^{BLANK}{cls}]*|[{cls}]|[^{BLANK}{cls}]+" if cls else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+").findall
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        # Bytes of all pieces in a row, and where each begins and ends, for decoding.
        raw = [b""] * n
        for w, k in self.id_of.items():
            raw[k] = w.replace(BLANK, " ").encode()
        for b, k in self.byte_id.items():
            raw[k] = bytes([b])
        raw[sp.unk_id()] = " ⁇ ".encode()
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(b) for b in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.byte_id.values())] = True
        self.ends = np.array([sp.bos_id(), sp.eos_id()], "<u4")

    def merged(self, part: str, agenda: list[float]) -> list[str]:
        """Symbols of a part after all merges; agenda has the scores of its adjacent pairs, _NONE for those that are no piece.

        It is used as it is, place by place, for a short part; for a long one a heap is made of it.
        """
        if len(part) > _SHORT:
            return self._by_heap(part)
        score, none, symbols = self.score.get, _NONE, list(part)
        while agenda and (best := min(agenda)) < none:
            k = agenda.index(best)  # the leftmost of the best
            del agenda[k]
            symbols[k] = w = symbols[k] + symbols.pop(k + 1)
            if k:
                agenda[k - 1] = score(symbols[k - 1] + w, none)
            if k < len(agenda):
                agenda[k] = score(w + symbols[k + 1], none)
        return symbols

    def _by_heap(self, part: str) -> list[str]:
        score = self.score
        symbols: list[str | None] = list(part)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(score[w], k, w) for k in range(n - 1) if (w := part[k : k + 2]) in score]
        heapq.heapify(agenda)
        while agenda:
            _, k, w = heapq.heappop(agenda)
            left = symbols[k]
            if left is None or (j := after[k]) >= n or len(left) + len(symbols[j]) != len(w) or left + symbols[j] != w:
                continue  # one of the two has been merged since
            symbols[k], symbols[j] = w, None
            after[k] = m = after[j]
            if m < n:
                before[m] = k
                if (x := w + symbols[m]) in score:
                    heapq.heappush(agenda, (score[x], k, x))
            if (m := before[k]) >= 0 and (x := symbols[m] + w) in score:
                heapq.heappush(agenda, (score[x], m, x))
        return [s for s in symbols if s is not None]

    def _keep(self, part: str, ids: bytes) -> bytes:
        if len(part) <= _SHORT:
            if len(self.known) >= REMEMBERED:
                self.known, self.before = {}, self.known
            self.known[part] = ids
        return ids

    def _ids(self, part: str) -> bytes:
        """Ids of a part not known of late, cut where no piece has the two characters side by side."""
        if ids := self.known.get(part):
            return ids  # met before in the same text
        if ids := self.before.get(part):
            return self._keep(part, ids)
        agenda = list(map(self.pairs.get, map(add, part, part[1:])))
        if None not in agenda:
            return self._keep(part, self._of(self.merged(part, agenda)))
        out, at = [], 0
        for k in [k for k, x in enumerate(agenda, 1) if x is None] + [len(part)]:
            piece = part[at:k]
            ids = self.known.get(piece) or self.before.get(piece)
            out.append(self._keep(piece, self._of(self.merged(piece, agenda[at : k - 1]))) if ids is None else ids)
            at = k
        return self._keep(part, b"".join(out))

    def _of(self, symbols: list[str]) -> bytes:
        ids = list(map(self.id_of.get, symbols))
        if None in ids:
            ids = [k for s, one in zip(symbols, ids) for k in ([one] if one is not None else [self.byte_id[b] for b in s.encode()])]
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers, without begin and end."""
        if not text:
            return b""
        parts = self.parts(BLANK + text.replace(" ", BLANK))
        out = list(map(self.known.get, parts))
        if None in out:
            out = [self._ids(part) if ids is None else ids for part, ids in zip(parts, out)]
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces in a row, without the blank before the text; bytes that are no UTF-8 become U+FFFD."""
        ids = ids[self.size[ids] > 0]
        if not len(ids):
            return ""
        size = self.size[ids]
        begin = np.cumsum(size) - size
        data = self.raw[np.arange(begin[-1] + size[-1]) + np.repeat(self.start[ids] - begin, size)].tobytes()
        if not self.is_byte[ids[0]] and data[:1] == b" " and ids[0] != self.library.unk_id():
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._lossy(ids)

    def _lossy(self, ids: np.ndarray) -> str:
        """decode() for ids with runs of byte pieces that are no UTF-8: each such byte becomes U+FFFD."""
        out, edge = [], np.flatnonzero(np.diff(self.is_byte[ids])) + 1
        for run in np.split(ids, edge):
            data = b"".join(self.raw[self.start[k] : self.start[k] + self.size[k]].tobytes() for k in run)
            if not self.is_byte[run[0]]:
                out.append(data.decode())
                continue
            while data:
                try:
                    out.append(data.decode())
                    break
                except UnicodeDecodeError as e:
                    out.append(data[: e.start].decode() + "�")
                    data = data[e.start + 1 :]
        text = "".join(out)
        return text[1:] if not self.is_byte[ids[0]] and text[:1] == " " and ids[0] != self.library.unk_id() else text


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The vocabulary of a model file, once a worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def agree(library, text: str, ids: np.ndarray, decoded: str) -> bool:
    """Whether the library gives these ids for the text and this text for the ids; its ids come as an array, not as a list of numbers."""
    theirs = library.encode_as_numpy(text, add_bos=True, add_eos=True)
    return np.array_equal(theirs, ids) and library.decode(theirs) == decoded


def piece_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", values: bool = True) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, ids_sha256, decoded_sha256, agrees, and with values ids and decoded.

    ids begin with the begin id and end with the end id. decoded is what decoding gives; agrees tells
    whether the sentencepiece library gives the same ids for the text and the same text for the ids.
    A null text counts as empty, which is the two ids alone and decodes to nothing. A blank before the
    text is added by encoding and taken away by decoding; U+2581 in a text decodes to a blank. A task
    holds a slice of rows at a time, and one long text whole. Repeated rows are rows of their own; an
    empty table gives no rows; other columns are not read. The model's path must be readable on all
    executors.
    """
    schema = docs.select(F.col(id_col).alias("id")).schema
    kind = schema["id"].dataType.simpleString()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"] + (["ids", "decoded"] if values else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in slices(batches, 256):
            rows = []
            for text in batch.column("text").to_pylist():
                ids = np.concatenate([p.ends[:1], np.frombuffer(p.encode(text), "<u4"), p.ends[1:]])
                decoded = p.decode(ids)
                row = (len(ids), sha(ids.tobytes()), sha(decoded.encode()), agree(p.library, text, ids, decoded))
                rows.append((*row, ids.astype(np.int64), decoded) if values else row)
            types = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.string()][: len(names) - 1]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=names)

    out = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean" + (", ids array<bigint>, decoded string" if values else "")
    )
    return out.withColumnRenamed("id", id_col)


def op12_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), values=False)
