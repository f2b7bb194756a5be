"""SentencePiece encoding and decoding by a merge-type prefix table.

The encoding of a text's prefix ends in one token only, whatever follows. So a table holds that last
token for every prefix: the matches of an automaton over all pieces give the candidates that end at a
position, and a candidate is right if it is the encoding of its own characters and it is compatible
with the last token of the prefix before it, that is, if merging the two tokens' characters gives
just these two tokens. The ids are then read backwards from the end of the table.

No piece has a word mark inside, so a text is cut before each run of word marks, and wherever two
neighbours stand side by side in no piece (a letter and a comma, say): nothing is ever merged over such
a place. The parts are encoded apart; a part's ids are kept in a bounded cache. A character without a
piece becomes its UTF-8 bytes' ids, to which any token is compatible.

Decoding takes ids alone: their pieces' bytes are gathered for many documents at once, marks as spaces
and byte ids as their bytes, and the first mark's space is left out. Ids that encoding never gives
(control ids inside, bytes that aren't UTF-8) are left to the library.

Defined cases: null and empty texts give the end id alone and decode to the empty string; repeated
rows give equal rows; null ids stay null; other columns aren't carried along.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.common import Memo, documents, tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
_LONG = 64  # characters; longer parts aren't kept in the cache
_ROWS = 128  # documents that are decoded at a time
_ENCODERS: dict[str, PrefixEncoder] = {}


class PrefixEncoder:
    """Encoder and decoder of a BPE model with byte fallback, for one process."""

    def __init__(self, path: str, cache: int = 250_000, packed: int = 100_000):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = self.library
        self.score, self.id_of, self.pieces = {}, {}, {}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end_id = model.eos_id()
        for i in range(model.get_piece_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i)
                self.id_of[piece], self.score[piece], self.pieces[i] = i, model.get_score(i), piece
        self.chars = {p for p in self.id_of if len(p) == 1}
        if any(MARK in p.lstrip(MARK) for p in self.id_of) or any(c not in self.chars for p in self.id_of for c in p):
            raise ValueError("the model has pieces with a word mark inside or with characters of their own")
        self.cut = self._cut()
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            if self.merge(piece) == [i]:  # others never come out of merging
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.kept = Memo(self._part, cache)
        self.packed = Memo(self._pack, packed)
        raw = [self.pieces[i].replace(MARK, " ").encode() if i in self.pieces else b"" for i in range(model.get_piece_size())]
        self.plain = np.array([i in self.pieces for i in range(len(raw))])
        for b, i in enumerate(self.byte):
            raw[i], self.plain[i] = bytes([b]), True
        self.marked = np.array([i in self.pieces and self.pieces[i][0] == MARK for i in range(len(raw))])
        self.size = np.array([len(x) for x in raw])
        self.start, self.bytes = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(raw), np.uint8)

    def _cut(self) -> re.Pattern[str]:
        """What a part is: marks and characters of one group, or one character of none. Characters side by side in a piece are of one group."""
        group: dict[str, set[str]] = {}
        for piece in self.id_of:
            if len(piece) > 1 and (rest := piece.lstrip(MARK)):
                own = group.setdefault(rest[0], {rest[0]})
                for c in rest[1:]:
                    other = group.setdefault(c, {c})
                    if other is not own:
                        own |= other
                        group.update(dict.fromkeys(other, own))
        classes = ["".join(map(re.escape, sorted(g))) for g in {id(g): g for g in group.values()}.values()]
        runs = "|".join(f"[{c}]+" for c in classes)
        return re.compile(f"{MARK}*(?:{runs})|{MARK}+|[^{MARK}]" if runs else f"{MARK}+|[^{MARK}]")

    def merge(self, text: str) -> list[int]:
        """Plain merging by score, leftmost first among equals, of characters that all have pieces."""
        parts: list[str | None] = list(text)
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        queue: list[tuple[float, int, str, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (score := self.score.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-score, i, both, j))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, both, j = heapq.heappop(queue)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [self.id_of[p] for p in parts if p is not None]

    def compatible(self, first: int, second: int) -> bool:
        key = first << 20 | second
        if (fit := self.fits.get(key)) is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            fit = self.fits[key] = self.merge(self.pieces[first] + self.pieces[second]) == [first, second]
        return fit

    def ids_of_part(self, part: str) -> list[int]:
        """Ids of a part, by its prefix table."""
        n = len(part)
        last, size = [-1] * (n + 1), [1] * (n + 1)  # -1: a character without a piece
        fits, compatible = self.fits, self.compatible
        done = [False] * (n + 1)
        for at, (i, k) in self.automaton.iter(part):
            end = at + 1
            if done[end]:
                continue
            start = end - k
            if start and last[start] >= 0:
                fit = fits.get(last[start] << 20 | i)
                if not (compatible(last[start], i) if fit is None else fit):
                    continue
            last[end], size[end], done[end] = i, k, True
        ids: list[int] = []
        while n:
            if last[n] >= 0:
                ids.append(last[n])
            else:
                ids.extend(self.byte[b] for b in reversed(part[n - 1].encode()))
            n -= size[n]
        ids.reverse()
        return ids

    def parts(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts(text) for i in self.ids_of_part(part)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """UTF-8 of many texts, from all their ids in a row and where each text's ids end."""
        starts = np.r_[0, ends[:-1]]
        sizes = self.size[ids]
        after = np.cumsum(sizes)
        total = int(after[-1]) if len(ids) else 0
        blob = self.bytes[np.repeat(self.start[ids] - after + sizes, sizes) + np.arange(total)].tobytes()
        bound = np.r_[0, after]
        odd = np.r_[0, np.cumsum(~self.plain[ids] & (ids != self.end_id))]
        out = []
        for start, end, low, high, strange in zip(starts.tolist(), ends.tolist(), bound[starts].tolist(), bound[ends].tolist(), (odd[ends] - odd[starts]).tolist(), strict=True):
            text = blob[low + (start < end and bool(self.marked[ids[start]])) : high]
            if strange or self.end_id in ids[start : end - 1] or not _is_utf8(text):
                text = self.library.decode(ids[start:end].tolist()).encode()
            out.append(text)
        return out

    def part(self, part: str) -> tuple[bytes, str]:
        """A part's ids as 32-bit integers, and as text with a space after each."""
        return self.kept[part] if len(part) <= _LONG else self._part(part)

    def _part(self, part: str) -> tuple[bytes, str]:
        ids = self.ids_of_part(part)
        return array("i", ids).tobytes(), " ".join(map(str, ids)) + " "

    def _pack(self, part: str) -> bytes:
        return array("i", self.ids_of_part(part)).tobytes()


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def encoder(path: str) -> PrefixEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(path)
    return _ENCODERS[path]


def encode_documents(df: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (array of int, the end id last) of every document."""
    path = model or tokenizer_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kept, once, end = enc.packed, enc._pack, array("i", [enc.end_id]).tobytes()
        for batch in batches:
            for rows in (batch.slice(at, 256) for at in range(0, len(batch), 256)):
                ids = [b"".join([kept[p] if len(p) <= _LONG else once(p) for p in enc.parts(text.as_py())]) + end for text in rows.column(1)]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes), lists], ["doc_id", "n_tokens", "ids"])

    return documents(df).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode_documents(df: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of every row of doc_id and ids."""
    path = model or tokenizer_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in (whole.slice(at, _ROWS) for whole in batches for at in range(0, len(whole), _ROWS)):
            ids = [np.array(x or [], np.int32) for x in batch.column(1).to_pylist()]
            texts = enc.decode(np.concatenate(ids), np.cumsum([len(x) for x in ids]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode() for t in texts], pa.string())], ["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(df: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: encoded, then decoded from all its ids."""
    path = model or tokenizer_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kept, once, last = enc.kept, enc._part, array("i", [enc.end_id]).tobytes()
        for batch in (whole.slice(at, _ROWS) for whole in batches for at in range(0, len(whole), _ROWS)):
            ids, printed = [], []
            for text in batch.column(1):
                parts = [kept[p] if len(p) <= _LONG else once(p) for p in enc.parts(text.as_py())]
                ids.append(b"".join([p[0] for p in parts]) + last)
                printed.append(hashlib.sha256(("".join([p[1] for p in parts]) + str(enc.end_id)).encode()).hexdigest())
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            decoded = [hashlib.sha256(t).hexdigest() for t in enc.decode(np.frombuffer(b"".join(ids), np.int32), np.cumsum(sizes))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(printed, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(df).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
