"""Token ids in compressed binary blocks: an adaptive context-mixing range coder.

A segment holds whole documents in ascending order of their ids: the documents' ids and lengths, and
the token ids of all of them, cut into blocks of BLOCK ids. Every block is coded on its own: contexts and
weights start anew, and its CRC-32 is kept and verified, so a block can be read without the others.

Models: order 0 is the share of each id, counted over the segment and kept in its head. The order-2 and
order-1 tables of a block remember which id followed the last two ids or the last id, with a
confidence each. The better prediction is offered first; the probability that it is right is mixed from
two adaptive estimates (by the order-2 and by the order-1 confidence) with an adaptive weight. Failing
that, the id is coded by its order-0 share. Both make one step of a range coder of 63 bits with words of
32. Up to LANES blocks are coded side by side, one step of all of them at a time, which bounds the
memory of tables whatever a segment's length; the last block is filled up, which is left out again.

Bytes of a segment, little-endian: "SILTIDS2", u32 bytes and u32 CRC-32 of the packed head; the head,
packed with zlib: u32 documents, ids, ids a block, distinct ids, bits of the sum of all shares; i64 ids of
documents and u8 whether they are null, u32 lengths; u16 distinct ids and u32 shares; u32 words and u32
CRC-32 of the ids, as u32, of each block. Then the words of all blocks, u32 each.

Defined cases: null and empty texts have the end id only; rows with equal ids are ordered by a hash of
their text, then by text, and all kept; rows without an id come first; an empty table makes no segment;
very long texts make long segments; other columns aren't carried along.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Memo, documents, materialize, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
MAGIC = b"SILTIDS2"
BLOCK, LANES = 2048, 4096
SEGMENT = BLOCK * LANES  # ids after which a segment is closed
TABLE_BITS = 10
_U = np.uint64
_TOP, _LOW, _FULL = _U(1 << 31), _U((1 << 31) - 1), _U((1 << 63) - 1)
# By confidence and whether the guess was right: how the confidence changes, and whether another id takes the place.
_STEP = np.array([(min(sure + 1, 7) if right else sure >> 1) - sure for sure in range(8) for right in (False, True)], np.int32)
_TAKEN = np.array([not right and sure < 2 for sure in range(8) for right in (False, True)])
# By weight, order 2's lead and a hit: the next weight.
_WEIGHT = np.array([min(max(w + (1 if lead == hit else -1), 1), 15) for w in range(16) for lead in (False, True) for hit in (False, True)], np.int32)
_GAP = re.compile(r"(?<=\S) (?=\S)")
_LONG = 64  # characters; longer parts aren't kept in the cache
_SLICE = 2048  # documents that are encoded at a time
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = rf"\A(?:\z|{_SPACE})|{_SPACE}\z"  # nothing, or white space at either end
# Letters, whatever the version of Unicode, and signs that are no letters, numbers or white space; the apostrophe may begin a word's end.
_RANGES = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0410-\u044f"
_SIGNS = r"!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"
_WORD = rf"\A(?P<word>[{_RANGES}]+)(?P<signs>[{_SIGNS}]*)\z"
_SPLIT = pa.struct([("word", pa.string()), ("signs", pa.string())])
# The character that stands for each byte in a vocabulary; a new line parts words.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_CHARACTERS = np.arange(256, dtype="<u4")
_AS_CHARACTERS[np.setdiff1d(np.arange(256), _PLAIN)] = 256 + np.arange(256 - len(_PLAIN))
_AS_CHARACTERS[10] = 32
_TOKENIZERS: dict[str, PartEncoder] = {}
SEGMENTS = "part int, segment int, first long, n long, blob binary"


def _shares(symbols: np.ndarray, distinct: int) -> tuple[np.ndarray, int]:
    """Share of each symbol, at least one, and the bits of their sum."""
    bits = max(14, int(distinct - 1).bit_length() + 4)
    count = np.bincount(symbols, minlength=distinct)
    share = 1 + count * ((1 << bits) - distinct) // len(symbols)
    share[count.argmax()] += (1 << bits) - share.sum()
    return share, bits


class _Models:
    """Models of ``lanes`` blocks, which encoder and decoder step alike. Arrays of two rows are of order 2 and order 1."""

    def __init__(self, lanes: int):
        row = np.arange(lanes)
        both = np.stack([row, row + lanes])
        self.base, self.base16 = both << TABLE_BITS, both << 4
        self.held = np.zeros(2 * lanes << TABLE_BITS, np.int32)  # a symbol, and its confidence in the lowest 3 bits
        self.by = np.full(2 * lanes * 16, 1024, np.int32)  # probabilities of 4096
        self.weight = np.full(lanes, 8, np.int32)  # of 16, for order 2
        self.key, self.before = np.zeros((2, lanes), np.int64), np.zeros(lanes, np.int64)
        self.at, self.seen = np.empty((2, lanes), np.int64), np.empty((2, lanes), np.int64)

    def predict(self) -> np.ndarray:
        """Probability of 4096 that ``best`` is right; sets best."""
        at, seen = self.at, self.seen
        np.right_shift(self.key, 7, out=at)
        at &= (1 << TABLE_BITS) - 1
        at += self.base
        self.now = held = self.held.take(at)
        self.guess, self.sure = guess, sure = held >> 3, held & 7
        second = sure[0] > 0
        self.best = guess[1] + (guess[0] - guess[1]) * second
        np.add(sure, sure, out=seen)
        seen[0] += guess[0] == guess[1]
        seen[1] += second
        seen += self.base16
        self.q = q = self.by.take(seen)
        return ((q[0] - q[1]) * self.weight >> 4) + q[1]

    def update(self, symbol: np.ndarray, hit: np.ndarray) -> None:
        q = self.q
        self.by[self.seen] = q + ((hit * np.int32(4032) + np.int32(32)) - q >> 4)
        self.weight = _WEIGHT.take((self.weight << 2) + ((q[0] > q[1]) * np.int32(2) + hit))
        turn = self.sure + self.sure
        turn += self.guess == symbol
        turn = turn.astype(np.intp)
        held = self.now
        held += _STEP.take(turn)
        taken = _TAKEN.take(turn)
        np.copyto(held, (symbol << 3) + 1, where=taken)
        self.held[self.at] = held
        np.multiply(symbol, np.int64(40503), out=self.key[1])
        np.add(self.key[1], self.before, out=self.key[0])
        np.multiply(symbol, np.int64(60493), out=self.before)


def _cut(symbols: np.ndarray) -> np.ndarray:
    """Symbols as a column for each block, zeros behind the last one's end."""
    blocks = -(-len(symbols) // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.int32)
    grid[: len(symbols)] = symbols
    return np.ascontiguousarray(grid.reshape(blocks, BLOCK)[:, : len(symbols)].T)


def _crcs(ids: np.ndarray) -> list[int]:
    whole = ids.astype("<u4")
    return [zlib.crc32(whole[at : at + BLOCK]) for at in range(0, len(ids), BLOCK)]


def _encode(symbols: np.ndarray, share: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words, and the words, of up to LANES blocks."""
    grid, share = _cut(symbols), share.astype(_U)
    ends = np.cumsum(share) - share
    lanes = grid.shape[1]
    models, shift = _Models(lanes), _U(bits)
    low, width = np.zeros(lanes, _U), np.full(lanes, _FULL)
    # A row for each place of a word in its block, a column for each block: what is written in a step lies side by side.
    words, first = np.zeros((len(grid) + 2) * lanes, _U), np.arange(lanes)
    at = first.copy()
    for symbol in grid:
        right = width >> _U(12)
        right *= models.predict().astype(_U)
        hit = symbol == models.best
        miss = (~hit).astype(_U)
        unit = width - right >> shift
        unit *= miss
        width = right  # of a hit
        right = right * miss
        width -= right
        place = symbol.astype(np.intp)
        width += unit * share.take(place)
        right += unit * ends.take(place)
        low += right
        # The word that may go out; with bit 32 it carries into the one before.
        words[at] = low >> _U(31)
        out = width < _TOP
        at += out * lanes
        np.copyto(low, (low & _LOW) << _U(32), where=out)
        width <<= out.astype(_U) << _U(5)
        models.update(symbol, hit)
    for _ in range(2):
        words[at] = low >> _U(31)
        low = (low & _LOW) << _U(32)
        at += lanes
    used = (at - first) // lanes
    words = words.reshape(-1, lanes)[: used.max()]
    for k in range(len(words) - 1, 0, -1):
        words[k - 1] += np.where(k < used, words[k] >> _U(32), _U(0))
    return used, words.T.astype("<u4")[np.arange(len(words)) < used[:, None]]


def _decode(flat: np.ndarray, used: np.ndarray, n: int, share: np.ndarray, bits: int) -> np.ndarray:
    """Symbols of up to LANES blocks of n symbols in all, from their words."""
    lanes = len(used)
    words = np.zeros((lanes, int(used.max()) + 2), np.uint32)
    words[np.arange(words.shape[1]) < used[:, None]] = flat
    words = words.T.astype(_U)
    ahead = (((words[:-1] & _U(1)) << _U(31)) | words[1:] >> _U(1)).ravel()  # 32 bits from each word's last bit on
    code, at = words[0] << _U(31) | words[1] >> _U(1), np.arange(lanes) + lanes
    of_share = np.repeat(np.arange(len(share)), share)
    share = share.astype(_U)
    ends = np.cumsum(share) - share
    models, shift, last = _Models(lanes), _U(bits), _U((1 << bits) - 1)
    width = np.full(lanes, _FULL)
    grid = np.zeros((min(n, BLOCK), lanes), np.int32)
    for k in range(len(grid)):
        right = width >> _U(12)
        right *= models.predict().astype(_U)
        hit = code < right
        miss = (~hit).astype(_U)
        unit = width - right >> shift
        width = right  # of a hit
        right = right * miss
        width -= right
        code -= right
        found = of_share.take(np.minimum(code // unit, last).astype(np.intp))
        unit *= miss
        code -= unit * ends.take(found)
        width += unit * share.take(found)
        symbol = found.astype(np.int32)
        np.copyto(symbol, models.best, where=hit)
        out = width < _TOP
        move = out.astype(_U) << _U(5)
        code <<= move
        code += ahead.take(at, mode="clip") * out
        width <<= move
        at += out * lanes
        grid[k] = symbol
        models.update(symbol, hit)
    return grid.T.ravel()[:n]


def encode_ids(ids: np.ndarray, docs: list[int | None] | None = None, lengths: np.ndarray | None = None) -> bytes:
    """A segment's bytes from at least one id below 65536, and the documents' ids and lengths."""
    alphabet = np.flatnonzero(np.bincount(ids, minlength=65536))
    number = np.zeros(65536, np.int32)
    number[alphabet] = np.arange(len(alphabet))
    symbols = number[ids]
    share, bits = _shares(symbols, len(alphabet))
    parts = [_encode(symbols[at : at + SEGMENT], share, bits) for at in range(0, len(ids), SEGMENT)]
    used, docs = np.concatenate([p[0] for p in parts]), [] if docs is None else docs
    head = struct.pack("<5I", len(docs), len(ids), BLOCK, len(alphabet), bits)
    head += np.array([d or 0 for d in docs], "<i8").tobytes() + bytes(d is None for d in docs) + np.array([] if lengths is None else lengths, "<u4").tobytes()
    head += alphabet.astype("<u2").tobytes() + share.astype("<u4").tobytes() + used.astype("<u4").tobytes() + np.array(_crcs(ids), "<u4").tobytes()
    head = zlib.compress(head, 1)
    return b"".join([MAGIC, struct.pack("<II", len(head), zlib.crc32(head)), head, *[p[1].tobytes() for p in parts]])


def decode_segment(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents' ids and lengths and the token ids of a segment's bytes; raises ValueError if the magic or a checksum is wrong."""
    if blob[:8] != MAGIC:
        raise ValueError("not a segment of token ids")
    size, crc = struct.unpack_from("<II", blob, 8)
    if zlib.crc32(blob[16 : 16 + size]) != crc:
        raise ValueError("the head of a segment has a wrong checksum")
    head = zlib.decompress(blob[16 : 16 + size])
    n_docs, n, block, distinct, bits = struct.unpack_from("<5I", head)
    if block != BLOCK:
        raise ValueError(f"blocks of {block} ids")
    blocks, at, fields = -(-n // BLOCK), 20, []
    for kind, count in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("<u2", distinct), ("<u4", distinct), ("<u4", blocks), ("<u4", blocks)):
        fields.append(np.frombuffer(head, kind, count, at))
        at += fields[-1].nbytes
    docs, null, lengths, alphabet, share, used, crcs = fields
    words = np.frombuffer(blob, np.uint8, offset=16 + size)
    if len(words) != 4 * int(used.sum()):
        raise ValueError("a segment of token ids is cut short")
    words, used, share = words.view("<u4"), used.astype(np.int64), share.astype(np.int64)
    ids, at = [], 0
    for k in range(0, blocks, LANES):
        some = used[k : k + LANES]
        ids.append(alphabet[_decode(words[at : at + some.sum()], some, min(n - k * BLOCK, SEGMENT), share, bits)])
        at += int(some.sum())
    ids = np.concatenate(ids)
    if _crcs(ids) != crcs.tolist():
        raise ValueError("a block of token ids has a wrong checksum")
    return [None if z else d for d, z in zip(docs.tolist(), null.tolist(), strict=True)], lengths.astype(np.int64), ids


def decode_ids(blob: bytes) -> np.ndarray:
    return decode_segment(blob)[2]


def _word_model(library):
    """The library's model for words that are split and written as its characters already; None if its words may differ."""
    from tokenizers import Tokenizer, pre_tokenizers

    split, signs = library.pre_tokenizer, re.compile(rf" ?[{_RANGES}]*[{_SIGNS}]*")
    plain = isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space and library.normalizer is None
    if not plain or any(signs.fullmatch(t.content) for t in library.get_added_tokens_decoder().values()):
        return None
    model = Tokenizer(library.model)
    model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    return model


class PartEncoder:
    """Ids of whole texts, with a bounded cache of their parts' ids.

    A single space between two other characters always begins a token, so texts are cut there. Parts
    that the cache lacks are encoded many at a time, joined into one text, whose ids are dealt out by the
    bytes of each token. The ids of all parts lie in one pool, from which texts are put together.
    """

    def __init__(self, path: str, cache: int = 700_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.cache = Tokenizer.from_file(path), cache
        if self.library.get_vocab_size() > 65536:
            raise ValueError("ids of more than 16 bits")
        self.bytes = np.zeros(65536, np.int64)  # in the vocabulary a byte is a character
        for token, i in self.library.get_vocab().items():
            self.bytes[i] = len(token)
        self.plain = _word_model(self.library)
        self.heads = Memo(self.ids, cache // 20)  # of a text's first part, which no space precedes
        self._clear()

    def _clear(self) -> None:
        self.kept: dict[str, int] = {}  # a part's number
        self.times = np.zeros(self.cache, np.int32)  # batches that needed a part
        self.start, self.size, self.pool, self.used, self.filled = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(1 << 16, np.uint16), 0, 0

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Put parts' ids into the pool; the first one's number."""
        first, n = self.used, len(sizes)
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while first + n > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.size[first : first + n] = sizes
        self.start[first : first + n] = self.filled + np.cumsum(sizes) - sizes
        self.used, self.filled = first + n, self.filled + len(ids)
        return first

    def _shrink(self) -> None:
        """Keep the half of the cache that most batches needed, and of it only what several did."""
        names, numbers = list(self.kept), np.fromiter(self.kept.values(), np.int64, len(self.kept))
        times = self.times[numbers]
        best = np.argsort(-times, kind="stable")[: self.cache // 2]
        best = best[times[best] > 1]
        start, size, pool = self.start[numbers[best]], self.size[numbers[best]], self.pool
        self._clear()
        before = np.cumsum(size) - size
        self._add(pool[np.repeat(start - before, size) + np.arange(size.sum())], size)
        self.kept = {names[k]: n for n, k in enumerate(best.tolist())}
        self.times[: len(best)] = times[best] >> 1

    def learn(self, parts: list[str]) -> int:
        """Put parts that each follow a space into the pool; the first one's number.

        The library splits a word and the signs behind it by itself, so their ids are those of the word and of the signs.
        """
        if not parts:
            return self.used
        array = pa.array(parts, pa.string())
        split = pc.extract_regex(array, _WORD) if self.plain else pa.nulls(len(parts), _SPLIT)
        simple = split.is_valid().to_numpy(zero_copy_only=False)
        split = split.drop_null()
        words, signs = (pc.dictionary_encode(split.field(k)) for k in (0, 1))
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.kept.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(number < 0)
        odd = array.filter(pa.array(~simple)).to_pylist()
        behind = [self.ids(x) if x else np.zeros(0, np.uint16) for x in signs.dictionary.to_pylist()]
        # Ids of new words, of signs and of other parts, beside the pool's.
        pool = [self.pool[: self.filled], *self._words([names[k] for k in new.tolist()]), *self._spaced(odd)]
        sizes = np.concatenate([self.size[: self.used], pool[2], [len(x) for x in behind], pool[4]]).astype(np.int64)
        ids = np.concatenate([pool[0], pool[1], *behind, pool[3]])
        starts = np.cumsum(sizes) - sizes
        starts[: self.used] = self.start[: self.used]
        starts[self.used :] += self.filled - int(self.size[: self.used].sum())
        number[new] = self.used + np.arange(len(new))
        first = np.zeros((len(parts), 2), np.int64)
        first[simple, 0], first[simple, 1] = number[words.indices.to_numpy()], self.used + len(new) + signs.indices.to_numpy()
        first[~simple, 0] = self.used + len(new) + len(behind) + np.arange(len(odd))
        size = sizes[first]
        size[~simple, 1] = 0
        flat = size.ravel()
        where = np.repeat(starts[first].ravel() - (np.cumsum(flat) - flat), flat)
        where += np.arange(len(where))
        return self._add(ids[where], size.sum(axis=1))

    def _spaced(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that each follow a space, and the number of each part's."""
        if not parts:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        raw = [" " + p for p in parts]
        return self._dealt(self.ids("".join(raw)), np.array([len(p.encode()) for p in raw]))

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of _LETTERS: each is one piece for the model, so nothing needs to be split by the library's expression."""
        if not words:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        raw = np.frombuffer((" " + "\n ".join(words)).encode(), np.uint8)
        text = _AS_CHARACTERS[raw].tobytes().decode("utf-32-le")
        ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)
        return self._dealt(ids, np.diff(np.flatnonzero(np.r_[10, raw, 10] == 10)) - 1)

    def _dealt(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts in a row, and how many each part of so many bytes has."""
        cuts = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(sizes), side="right")
        return ids[: cuts[-1]], np.diff(cuts, prepend=0)

    def _parts(self, text: str) -> tuple[list[str], str]:
        """Parts of a text with other white space beside its spaces, and a last one that can't stand before others."""
        parts = _GAP.split(text)
        # White space at a text's end would join the space of a special token behind it.
        return (parts[:-1], parts[-1]) if len(parts) > 1 and parts[-1][-1:].isspace() else (parts, "")

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the number of ids of each, with an ``end`` id behind each if there is one.

        The first part of each text, a last one with white space at its end, and long parts aren't kept.
        """
        if not len(texts):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        lists = pc.split_pattern(texts, " ")
        ends = np.asarray(lists.offsets)
        ends, found = ends - ends[0], pc.dictionary_encode(lists.flatten())
        codes, parts = found.indices.to_numpy(), found.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.kept.get, parts, repeat(-1)), np.int32, len(parts))
        odd, tails, new = np.zeros(len(parts), bool), {}, np.flatnonzero(numbers < 0)  # what is kept isn't odd
        odd[new] = pc.match_substring_regex(found.dictionary.take(pa.array(new)), _ODD).to_numpy(zero_copy_only=False)
        if odd.any():  # more than one space, or another white space beside it
            number, split = {p: k for k, p in enumerate(parts)}, {}
            for row in np.flatnonzero(np.add.reduceat(odd[codes], ends[:-1])).tolist():
                some, tail = self._parts(texts[row].as_py())
                if tail:
                    tails[row] = tail
                split[row] = np.array([number.setdefault(p, len(number)) for p in some], np.int32)
            pieces = [split[r] if r in split else codes[ends[r] : ends[r + 1]] for r in range(len(texts))]
            codes, ends, parts = np.concatenate(pieces), np.r_[0, np.cumsum([len(x) for x in pieces])], list(number)
            numbers = np.append(numbers, np.fromiter(map(self.kept.get, parts[len(numbers) :], repeat(-1)), np.int32))
        first = ends[:-1]
        inner = np.ones(len(codes), bool)
        inner[first] = False
        needed = np.zeros(len(parts), bool)
        needed[codes[inner]] = True
        lacking = np.flatnonzero(needed & (numbers < 0))
        if len(self.kept) + len(lacking) > self.cache:
            self._shrink()
            numbers = np.fromiter(map(self.kept.get, parts, repeat(-1)), np.int32, len(parts))
            lacking = np.flatnonzero(needed & (numbers < 0))
        if len(self.kept) + len(lacking) > self.cache:
            self._clear()
            self.times, lacking = np.zeros(len(parts), np.int32), np.flatnonzero(needed)
        long = np.fromiter(map(len, map(parts.__getitem__, lacking.tolist())), np.int64, len(lacking)) >= _LONG
        short = [parts[k] for k in lacking[~long].tolist()]
        at = self.learn(short)
        self.kept.update(zip(short, range(at, at + len(short)), strict=True))
        numbers[lacking[~long]] = at + np.arange(len(short))
        self.times[numbers[needed & (numbers >= 0)]] += 1
        used, filled = self.used, self.filled
        numbers[lacking[long]] = self.learn([parts[k] for k in lacking[long].tolist()]) + np.arange(long.sum())
        number = numbers[codes]
        heads = [self.heads[parts[k]] if len(parts[k]) < _LONG else self.ids(parts[k]) for k in codes[first].tolist()]
        number[first] = self._add(np.concatenate(heads), np.array([len(h) for h in heads])) + np.arange(len(heads))
        if tails:
            behind = [self.ids(" " + tails[r]) if r in tails else np.zeros(0, np.uint16) for r in range(len(texts))]
            at = self._add(np.concatenate(behind), np.array([len(x) for x in behind]))
            number, ends = np.insert(number, ends[1:], at + np.arange(len(texts))), ends + np.arange(len(ends))
        if end is not None:
            at = self._add(np.array([end], np.uint16), np.array([1]))
            number, ends = np.insert(number, ends[1:], at), ends + np.arange(len(ends))
        sizes = self.size[number]
        before = np.cumsum(sizes) - sizes  # of ids
        total = int(before[-1] + sizes[-1])
        where = np.repeat((self.start[number] - before).astype(np.int32), sizes)
        where += np.arange(total, dtype=np.int32)
        ids, lengths = self.pool[where], np.diff(np.append(before, total)[ends])
        self.used, self.filled = used, filled
        return ids, lengths


def tokenizer(path: str) -> PartEncoder:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = PartEncoder(path)
    return _TOKENIZERS[path]


def write_segments(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Segments of all documents, tokens and the end id each, in ascending order of doc_id over (part, segment).

    ``first`` is the number of ids before a segment in its part, n that of its own. Ranges are made by id and a
    hash of the text, so that sampling sends no text to the driver and an id with many rows isn't one task.
    """
    path = vocabulary or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), tokenizer(path)
        docs, lengths, held, size, segment, first = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            blob = encode_ids(np.concatenate(held), docs, np.concatenate(lengths))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()), "first": [first], "n": [size], "blob": pa.array([blob], pa.binary())})

        for batch in (whole.slice(at, _SLICE) for whole in batches for at in range(0, len(whole), _SLICE)):
            ids, sizes = encoder.encode(batch.column(1), END_ID)
            docs += batch.column(0).to_pylist()
            held.append(ids)
            lengths.append(sizes)
            size += len(ids)
            if size >= SEGMENT:
                yield close()
                docs, lengths, held, size, segment, first = [], [], [], 0, segment + 1, first + size
        if docs:
            yield close()

    dealt = documents(df).withColumn("_h", F.xxhash64("text"))
    ordered = dealt.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")
    return materialize(ordered.mapInArrow(run, SEGMENTS), "token-ids")


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the segments' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, lengths, ids = decode_segment(blob.as_py())
                whole, ends = ids.astype("<u4"), np.cumsum(lengths)
                if ends[-1] != len(ids):
                    raise ValueError("a segment's lengths and ids differ")
                starts = ends - lengths
                crcs = [zlib.crc32(whole[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts + before), pa.array(lengths), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row a part: as many as the partitions of the shuffle.
    from pyspark.sql import Window

    parts = segments.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = segments.join(F.broadcast(before), "part")
    return rows.select((F.col("before") + F.col("first")).alias("before"), "blob").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
