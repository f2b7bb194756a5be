"""Benchmark decontamination by templates.

Texts become templates: numbers, units behind numbers, and names (capitalised words inside a
sentence) are replaced by typed placeholders, other words are lower-cased. Every window of WINDOW
template tokens of a benchmark item is put in a hash table (shorter items: the whole item), those with
names a second time with lower-cased words in their place, as a copy may be written in other letter case;
the windows of all documents, in both forms, are joined with it. Windows of a document and an item that lie on one
diagonal are then aligned token by token: a value of the item must always stand for the same value
of the document and the other way round, and windows that break this don't count. A document is
contaminated by an item if it has at least SHARE of the item's windows, in any order, or if windows on
one diagonal cover RUN or more tokens of the item in a row, whatever share of the item that is.

The table is built from blocks of the benchmark whose characters are bounded by ``BLOCK_CHARS``; one
block is broadcast at a time, and a larger benchmark takes one pass over the documents for each.

Defined cases: null and empty texts match nothing; repeated rows are reported under their one id;
windows with fewer than MIN_WORDS words, names counted, say nothing as templates and are put in the table with
the tokens themselves in lower case, numbers and units too, so that only the same tokens match (a share is that
of all windows or of those with templates, whichever is more); an item without any token matches nothing; empty tables give empty results; extra columns are carried
through ``keep_clean`` and left out of the report.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Memo, documents

WINDOW, SHARE, MIN_WORDS, RUN = 5, 0.5, 3, 13
#: Of the benchmark's text; a token takes some 60 bytes of each worker's memory, so a block's table is below 150 MB.
BLOCK_CHARS = 8_000_000
#: Units, where they stand behind a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg t lb lbs oz gram grams "
    "kilogram kilograms ton tons pound pounds ounce ounces ml l liter liters litre litres gallon gallons s sec min h hr hrs second seconds minute minutes "
    "hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur percent degree degrees kmh mph w kw kwh v hz mb gb tb".split()
)
_TOKEN = re.compile(r"(?:\A|[.!?\n])[^\w.!?\n]*[^\W\d]\w*|\d+(?:[.,]\d+)*|[^\W\d]\w*")
_NUMBER, _NAME, _UNIT, _FIRST_WORD = 1, 2, 3, 4
_rng = np.random.default_rng(2)
#: What a window of the table is made of.
_FORMS = _TEMPLATE, _EXACT, _PLAIN = 0, 1, 2
#: Set in the id of a name, above that of its word.
_NAMED = 1 << 40
_ODD = _rng.integers(0, 2**64, WINDOW, np.uint64) | np.uint64(1)
_LENGTH = _rng.integers(0, 2**64, WINDOW + 1, np.uint64)


def _surface(token: str) -> tuple[str, bool]:
    """The bare word and whether it begins a sentence."""
    first = token[0]
    if first.isalnum() or first == "_":
        return token, False
    return token[next(i for i, c in enumerate(token) if c.isalnum() or c == "_") :], True


def _template(token: str, begins: bool) -> int | str:
    """Placeholder, or the word itself in lower case."""
    if token[0].isdigit():
        return _NUMBER
    if not begins and len(token) > 1 and token[0].isupper() and not token.isupper():
        return _NAME
    return token.lower()


class Templates:
    """The windows of a block of the benchmark."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words: dict[str, int] = {u: _FIRST_WORD + i for i, u in enumerate(sorted(UNITS))}
        self.n_units = len(self.words)
        self.memo = Memo(self._id, 300_000)
        self.items = [i for i, _ in items]
        self.slots: list[dict[int, str]] = []  # an item's values by place: only these of its tokens are kept
        self.ids: list[np.ndarray] = []
        for _, text in items:
            for t in _TOKEN.findall(text):
                self.words.setdefault(_surface(t)[0].lower(), _FIRST_WORD + len(self.words))
        hashes, places = [], []
        self.plain: list[np.ndarray] = []
        self.exact: list[np.ndarray] = []
        self.windows, self.telling = [], []
        for n, (_, text) in enumerate(items):
            tokens, ids, flat = self.read(text)
            self.slots.append({q: _surface(tokens[q])[0].lower() for q in np.flatnonzero(ids < _FIRST_WORD).tolist()})
            self.ids.append(ids)
            self.plain.append(flat)
            self.exact.append(self._exact(tokens, flat, np.arange(len(ids))))
            size = min(WINDOW, len(ids))
            ok = self._telling(ids, size) if size else np.zeros(0, bool)
            self.windows.append(len(ok))
            self.telling.append(int(ok.sum()))
            words = self._telling(flat, size) if size else ok
            for form, some in ((_TEMPLATE, ok), (_EXACT, ~words), (_PLAIN, words & ~self._all(ids != _NAME, size) if size else ok)):
                if some.any():
                    hashes.append(self.hash(self._form(n, form), size)[some])
                    at = np.flatnonzero(some)
                    places.append(np.stack([np.full(len(at), n), at, np.full(len(at), size), np.full(len(at), form)], 1).astype(np.int32))
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.places = flat[order], np.concatenate(places)[order] if places else np.empty((0, 4), np.int32)
        self.sizes = sorted({int(x) for x in self.places[:, 2]})

    def _form(self, n: int, form: int) -> np.ndarray:
        return (self.ids, self.exact, self.plain)[form][n]

    def _exact(self, tokens: list[str], ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """``ids`` with the words themselves in place of the placeholders at ``at``, 0 for those that the benchmark lacks."""
        out = ids.copy()
        for q in at[ids[at] < _FIRST_WORD].tolist():
            out[q] = self.words.get(_surface(tokens[q])[0].lower(), 0)
        return out

    def _id(self, token: str) -> int:
        word, begins = _surface(token)
        kind = _template(word, begins)
        if kind == _NAME:
            return _NAMED | self.words.get(word.lower(), 0)
        return kind if isinstance(kind, int) else self.words.get(kind, 0)

    def read(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Tokens as found, their template ids, and those with names as words; 0 for words that the benchmark lacks."""
        tokens = _TOKEN.findall(text)
        memo = self.memo
        ids = [memo[t] for t in tokens]
        if tokens and tokens[0][0].isalpha():  # the very first word begins a sentence
            ids[0] = self.words.get(tokens[0].lower(), 0)
        out = np.array(ids, np.uint64)
        named = out >= _NAMED
        if named.any():
            flat = np.where(named, out ^ np.uint64(_NAMED), out)
            return tokens, self._units(np.where(named, np.uint64(_NAME), out)), self._units(flat)
        out = self._units(out)
        return tokens, out, out

    def _units(self, ids: np.ndarray) -> np.ndarray:
        unit = (ids[1:] >= _FIRST_WORD) & (ids[1:] < _FIRST_WORD + self.n_units) & (ids[:-1] == _NUMBER)
        ids[1:][unit] = _UNIT
        return ids

    @staticmethod
    def hash(ids: np.ndarray, size: int) -> np.ndarray:
        n = len(ids) - size + 1
        total = np.full(max(n, 0), _LENGTH[size])
        for k in range(size):
            total += (ids[k : k + max(n, 0)] ^ (ids[k : k + max(n, 0)] << np.uint64(29))) * _ODD[k]
            total ^= total >> np.uint64(31)
        return total

    @staticmethod
    def _telling(ids: np.ndarray, size: int) -> np.ndarray:
        words = np.concatenate([[0], np.cumsum(ids >= _FIRST_WORD)])
        return words[size:] - words[:-size] >= min(MIN_WORDS, size)

    def _lookups(self, tokens: list[str], ids: np.ndarray, flat: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of a text and the places of the windows to look up in them."""
        yield ids, np.flatnonzero(self._all(ids, size))
        known = self._all(flat, size)
        if flat is not ids:
            yield flat, np.flatnonzero(known & ~self._all(ids != _NAME, size))
        few = np.flatnonzero(known & ~self._telling(flat, size))
        if len(few):
            exact = self._exact(tokens, flat, np.unique(few[:, None] + np.arange(size)))
            yield exact, few[self._all(exact, size)[few]]

    @staticmethod
    def _all(ids: np.ndarray, size: int) -> np.ndarray:
        known = np.concatenate([[0], np.cumsum(ids != 0)])
        return known[size:] - known[:-size] == size

    def hits(self, tokens: list[str], ids: np.ndarray, flat: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item, place in the item, place in the text, size, form) of every window that both have."""
        found = []
        for size in self.sizes:
            if len(ids) < size:
                continue
            for mine, at in self._lookups(tokens, ids, flat, size):
                if not len(at):
                    continue
                h = self.hash(mine, size)[at]
                low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
                for k in np.flatnonzero(high > low):
                    p = int(at[k])
                    for n, place, of, form in self.places[low[k] : high[k]].tolist():
                        if of == size and np.array_equal(self._form(n, form)[place : place + size], mine[p : p + size]):
                            found.append((n, place, p, size, form))
        return found

    def match(self, text: str) -> list[tuple[int, float, int]]:
        """(item id, share of its windows, windows) of every item that contaminates the text."""
        tokens, ids, flat = self.read(text)
        diagonals = defaultdict(list)
        for n, place, p, size, form in self.hits(tokens, ids, flat):
            diagonals[n, p - place].append((place, size, form))
        covered, telling, quoted = defaultdict(set), defaultdict(set), set()
        for (n, shift), found in diagonals.items():
            places, plain = (sorted({(place, size) for place, size, form in found if form in forms}) for forms in (_FORMS, (_TEMPLATE,)))
            kept = self._consistent(n, shift, places, tokens)
            covered[n].update(kept)
            telling[n].update(kept if plain == places else self._consistent(n, shift, plain, tokens))
            if n not in quoted and self._run(n, shift, places, tokens) >= RUN:
                quoted.add(n)
        share = [(n, max(len(c) / self.windows[n], len(telling[n]) / max(1, self.telling[n])), len(c)) for n, c in covered.items()]
        return sorted(((self.items[n], x, k) for n, x, k in share if x >= SHARE or n in quoted), key=lambda x: (x[0] is None, x[0]))

    def _slot(self, n: int, shift: int, q: int, tokens: list[str]) -> tuple[tuple[int, str], tuple[int, str]] | None:
        """The value of the item's slot at ``q`` and what stands there in the document; nothing for a word."""
        kind = int(self.ids[n][q])
        if kind >= _FIRST_WORD:
            return None
        return (kind, self.slots[n][q]), (kind, _surface(tokens[q + shift])[0].lower())

    def _run(self, n: int, shift: int, places: list[tuple[int, int]], tokens: list[str]) -> int:
        """Most tokens of the item in a row that sorted windows of a diagonal cover and whose slots agree with one another."""
        there, back, best, start, end = {}, {}, 0, 0, -1
        for place, size in places:
            if place > end:
                start = place
            for q in range(max(place, end), place + size):
                if (slot := self._slot(n, shift, q, tokens)) is not None:
                    a, b = slot
                    for seen, x, y in ((there, a, b), (back, b, a)):
                        if x in seen and seen[x][0] != y:
                            start = max(start, seen[x][1] + 1)
                        seen[x] = y, q
                best = max(best, q + 1 - start)
            end = max(end, place + size)
        return best

    def _consistent(self, n: int, shift: int, places: list[tuple[int, int]], tokens: list[str]) -> list[int]:
        """Places of the windows whose slots agree with those before them on the diagonal."""
        there, back, kept = {}, {}, []
        for place, size in places:
            slots = []
            for q in range(place, place + size):
                if (slot := self._slot(n, shift, q, tokens)) is not None:
                    slots.append(slot)
            if all(there.get(a, b) == b and back.get(b, a) == a for a, b in slots) and len({a for a, _ in slots}) == len(set(slots)) == len({b for _, b in slots}):
                there.update(slots)
                back.update((b, a) for a, b in slots)
                kept.append(place)
        return kept


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[Templates]:
    """Window tables of the benchmark, each from at most about ``most`` characters."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // most))
    for k in range(parts):
        got = rows.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == k).collect()
        yield Templates(sorted(((r["item_id"], r["text"]) for r in got), key=lambda x: (x[0] is None, x)))


def find_contaminated(df: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, items (sorted ids), best_share and n_windows of every contaminated document."""
    schema = "doc_id long, item_id long, share double, n_windows long"
    found = None
    for templates in blocks(benchmark, block_chars):
        held = df.sparkSession.sparkContext.broadcast(templates)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d.as_py(), *m) for d, t in zip(batch.column(0), batch.column(1), strict=True) for m in held.value.match(t.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["doc_id", "item_id", "share", "n_windows"])

        part = documents(df).mapInArrow(run, schema)
        found = part if found is None else found.unionAll(part)
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("share").alias("best_share"), F.max("n_windows").alias("n_windows"))


def keep_clean(df: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``df``, all columns, that no benchmark item contaminates."""
    at = df.columns.index("text")
    for templates in blocks(benchmark, block_chars):
        held = df.sparkSession.sparkContext.broadcast(templates)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not held.value.match(t.as_py() or "") for t in batch.column(at)], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df
