"""MinHash near-duplicates by a multi-index Hamming join, and their connected components.

1. Sketch: words are runs without ASCII white space, A-Z lower-cased; the set of a document is its
   distinct word shingles as 64-bit hashes (fewer words than a shingle has: the whole sequence as one).
   Documents with equal sets form a class at once; the smallest id stands for it.
2. Signature: POSITIONS minimum hashes, BITS bits of each. Two sets of similarity 0.8 differ in more
   than DISTANCE positions with a probability below 1e-4, and only this distance decides who is compared.
3. Multi-index: the signature is cut into CHUNKS; by the pigeonhole principle two signatures within
   DISTANCE have a chunk with at most ERRORS differing positions. Every way to leave out that many
   positions of a chunk gives one key, so all pairs within DISTANCE meet under some key.
4. Under each key the graph of pairs within DISTANCE is searched and its connected parts are written
   as stars, never as pairs. Oversized keys are split into blocks, one group for each pair of blocks.
5. The parts over all keys give candidate clusters, in which links are confirmed on full sets:
   100 * common >= threshold * union. A small cluster is one group. Members of a larger one are first dealt
   out in groups of bounded size, each with the cluster's centre; those that it is linked with are
   connected already, so only the others have to meet all members, in blocks of bounded size. Links are
   kept as stars again. Only members' texts are read for this, and their sets are shuffled, never texts.
6. Connected components of the links, by alternating large-star and small-star steps.

Defined cases: null and empty texts and texts without words have an empty set (n_shingles 0), link
with nothing and are their own component. Rows without an id are returned with a null component, not
kept, and link nothing. Rows that repeat an id count as one document, linked with each other.
Extra columns aren't carried along. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import documents, drop, materialize, with_rows

POSITIONS, BITS, DISTANCE, CHUNKS, ERRORS = 36, 16, 17, 6, 2
KEY_BLOCK = 8192  # signatures of one key that meet in a group
MEMBERS, SET_BLOCK = 512, 2_000_000  # members and shingles of one cluster that meet in a group, about, from either side
HOT_SHARE = 200  # a key that one class in so many has is hot
_CLASSES = 2000  # classes whose keys are made at a time
HOT_DEGREE, HOT_NODES = 1000, 100_000  # edges from which on a node's label is broadcast, and such nodes at most
_SEEN = 100_000  # sets that a task remembers having sent

_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(0, 2**64, POSITIONS, np.uint64) | np.uint64(1)
_XOR = _rng.integers(0, 2**64, POSITIONS, np.uint64)
_ROLL = _rng.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
_SIZE = POSITIONS // CHUNKS
#: Positions that a key keeps, for each chunk and each choice of positions left out.
_KEPT = np.array([[c * _SIZE + p for p in range(_SIZE) if p not in out] for c in range(CHUNKS) for out in combinations(range(_SIZE), ERRORS)])
_KEY_ODD = _rng.integers(0, 2**64, _KEPT.shape, np.uint64) | np.uint64(1)
_KEY_ADD = _rng.integers(0, 2**64, len(_KEPT), np.uint64)
assert CHUNKS * _SIZE == POSITIONS and CHUNKS * (ERRORS + 1) > DISTANCE


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    rolled = np.full(n, min(len(words), width), np.uint64)
    for k in range(min(width, len(words))):
        rolled = (rolled + hashes[k : k + n]) * _ROLL[k]
    return np.unique(_mix(rolled))


def signature(hashes: np.ndarray) -> np.ndarray:
    """BITS low bits of each position's minimum hash."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[at : at + 4096, None] ^ _XOR) * _MULTIPLY).min(axis=0))
    return _mix(least).astype(np.uint16)


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """One row of keys for each signature."""
    out = np.empty((len(signatures), len(_KEPT)), np.uint64)
    wide = signatures.astype(np.uint64) + np.uint64(1)
    for k, kept in enumerate(_KEPT):
        out[:, k] = _mix((wide[:, kept] * _KEY_ODD[k]).sum(axis=1, dtype=np.uint64) + _KEY_ADD[k])
    return out


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), POSITIONS)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Groups of rows with equal leading columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        change = np.zeros(len(batch), bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and tuple(c[0] for c in cols) != last
        last = tuple(c[-1] for c in cols)
        at = 0
        for cut in np.flatnonzero(change):
            held.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def sketch(df: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the full set) and signature of every row; the latter two null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(1)]
            yield _batch(
                doc_id=batch.column(0),
                n_shingles=pa.array([len(s) for s in sets], pa.int64()),
                digest=pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                signature=pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            )

    return documents(df).mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary")


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Classes and their rows of keys, some thousand classes at a time."""
    for batch in batches:
        for part in (batch.slice(at, _CLASSES) for at in range(0, len(batch), _CLASSES)):
            yield part.column(0).to_numpy(), keys_of(_signatures(part.column(1))).view(np.int64)


def _hot_keys(classes: DataFrame) -> np.ndarray:
    """Keys that about one class in HOT_SHARE has; by the number of keys a class has there are few such keys.

    Whether a key is found here changes only how its rows are dealt, not what is found under it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for reps, keys in _key_batches(batches):
            key, n = np.unique(keys, return_counts=True)
            often = n >= max(8, len(reps) // HOT_SHARE)
            yield _batch(key=pa.array(key[often]), n=pa.array(n[often]))

    least = max(KEY_BLOCK // 8, classes.count() // (4 * HOT_SHARE))
    found = classes.select("rep", "signature").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return np.sort(np.array([r["key"] for r in found.select("key").collect()], np.int64))  # 4 * HOT_SHARE * len(_KEPT) at most


def _shared_keys(classes: DataFrame) -> DataFrame:
    """key, rep: the keys that at least two classes have. Rows of hot keys, which are shared, are dealt by class as well."""
    hot = classes.sparkSession.sparkContext.broadcast(_hot_keys(classes))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for reps, keys in _key_batches(batches):
            flat, owner = keys.ravel(), np.repeat(reps, keys.shape[1])
            salt = np.where(np.isin(flat, hot.value), 1 + (owner & 63), 0).astype(np.int32)
            yield _batch(key=pa.array(flat), salt=pa.array(salt), rep=pa.array(owner))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_ = None, False  # the row before, and whether it's already known to share its key
        for batch in batches:
            if not len(batch):
                continue
            k, salt, r = (batch.column(c).to_numpy() for c in range(3))
            if last is not None:
                k, salt, r = (np.append(x, y) for x, y in zip(last, (k, salt, r), strict=True))
            same = np.zeros(len(k) + 1, bool)
            same[1:-1] = k[1:] == k[:-1]
            same[0] = open_
            keep = same[:-1] | same[1:] | (salt > 0)
            keep[-1] = False  # is decided with the next row
            yield _batch(key=pa.array(k[keep]), rep=pa.array(r[keep]))
            last, open_ = (k[-1], salt[-1], r[-1]), bool(same[len(k) - 1])
        if last is not None and (open_ or last[1] > 0):
            yield _batch(key=pa.array([last[0]]), rep=pa.array([last[2]]))

    keys = classes.select("rep", "signature").mapInArrow(emit, "key long, salt int, rep long")
    return keys.repartition("key", "salt").sortWithinPartitions("key").mapInArrow(shared, "key long, rep long")


def _parts(df: DataFrame, group: str, weight: str, most: int) -> DataFrame:
    """Groups heavier than ``most`` with the number of their blocks."""
    total = df.groupBy(group).agg(F.sum(weight).alias("_w")).filter(F.col("_w") > most)
    return total.select(group, F.ceil(F.col("_w") / F.lit(most)).cast("int").alias("_n"))


def _blocks(df: DataFrame) -> DataFrame:
    """Rows of (rep, _n) with their block ``_b`` of _n, once for every pair of blocks (i, j) that theirs is of."""
    mine = F.pmod(F.xxhash64("rep"), F.col("_n")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j")))
    return df.withColumn("_b", mine).withColumn("_p", F.explode(pairs)).select("*", F.col("_p.i").alias("i"), F.col("_p.j").alias("j")).drop("_n", "_p")


def _components(n: int, neighbours) -> np.ndarray:
    """For each of n nodes the number of its part; neighbours(i, rest): those of rest that i is linked with."""
    part, rest = np.full(n, -1), np.arange(n)
    while len(rest):
        first, rest = rest[0], rest[1:]
        part[first], open_ = first, [first]
        while open_ and len(rest):
            found = neighbours(open_.pop(), rest)
            if found.any():
                part[rest[found]] = first
                open_.extend(rest[found])
                rest = rest[~found]
    return part


def _stars(reps: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest of the part, member) for every other member."""
    order = np.lexsort((reps, part))
    reps, part = reps[order], part[order]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    centre = np.repeat(reps[starts], np.diff(np.r_[starts, len(reps)]))
    apart = centre != reps
    return centre[apart], reps[apart]


def _near_signatures(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """Stars (a, b) of classes that signatures within DISTANCE connect under a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for group in _runs(batches, 3):
            reps, sig = group.column("rep").to_numpy(), _signatures(group.column("signature").combine_chunks())
            if len(reps) == 2 and (sig[0] != sig[1]).sum() > DISTANCE:
                continue
            part = _components(len(reps), lambda i, rest: (sig[rest] != sig[i]).sum(axis=1) <= DISTANCE)
            out.append(_stars(reps, part))
            if len(out) >= 5000:
                yield _edges(out)
                out = []
        yield _edges(out)

    large = _parts(shared.withColumn("_one", F.lit(1)), "key", "_one", KEY_BLOCK)
    rows = shared.join(large, "key", "left").withColumn("_n", F.coalesce("_n", F.lit(1))).join(classes.select("rep", "signature"), "rep")
    rows = _blocks(rows).select("key", "i", "j", "rep", "signature").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _edges(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in (0, 1))
    both = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    return _batch(a=pa.array(both[:, 0], pa.int64()), b=pa.array(both[:, 1], pa.int64()))


def connected_components(edges: DataFrame, label: str = "links") -> DataFrame:
    """node, component (smallest node reachable) of every node that the edges (a, b) have.

    Large-star and small-star steps alternate until nothing changes; every step is an aggregation
    with map-side combining and a join, and its edges are written to the shared folder. A node with more
    than ``limit`` edges isn't joined by a shuffle: its label is broadcast, and there are HOT_NODES such at most.
    """

    def star(e: DataFrame, large: bool, limit: int) -> DataFrame:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        hot = F.broadcast(least.filter(F.col("n") > limit).select("a", "m"))
        moved = both.join(hot, "a").select("a", "b", "m").unionAll(both.join(hot, "a", "left_anti").join(least.filter(F.col("n") <= limit), "a").select("a", "b", "m"))
        if large:
            return moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = materialize(edges.filter("a <> b").distinct(), label)
    seen = state(now)
    while seen[0]:
        limit = max(HOT_DEGREE, 2 * seen[0] // HOT_NODES)
        half = materialize(star(now, True, limit), label)
        then = materialize(star(half, False, limit), label)
        drop(half)
        drop(now)
        now, before, seen = then, seen, state(then)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _sets(df: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """The members' rows (rep, ...) with ``digest``, ``signature`` and ``hashes`` of their documents' sets; a repeated row may come more than once."""
    names = [n for n in members.columns if n != "rep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        seen: set[tuple[int, bytes]] = set()
        for batch in batches:
            keep, made = [], []
            for k, (rep, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                found = shingle_set(text.as_py(), width)
                own = rep, xxh3_128_digest(found.tobytes())
                if len(found) and own not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(own)
                    keep.append(k)
                    made.append((own[1], signature(found).tobytes(), found.tobytes()))
            held = batch.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([held.column(0), *held.columns[2:], *[pa.array([m[c] for m in made], pa.binary()) for c in range(3)]], ["rep", *names, "digest", "signature", "hashes"])

    texts = documents(df).filter("doc_id is not null").select(F.col("doc_id").alias("rep"), "text")
    kinds = ", ".join(f"{n} {t}" for n, t in members.dtypes if n != "rep")
    return with_rows(texts, members, "rep").select("rep", "text", *names).mapInArrow(run, f"rep long, {kinds}, digest binary, signature binary, hashes binary")


class _Group:
    """Members of a cluster that meet: their classes, sets and signatures, each set once."""

    def __init__(self, rows: pa.Table):
        keys = [r.to_bytes(8, "little", signed=True) + d for r, d in zip(rows.column("rep").to_pylist(), rows.column("digest").to_pylist(), strict=True)]
        _, once = np.unique(keys, return_index=True)
        rows = rows.take(pa.array(once))
        self.rows, self.reps = rows, rows.column("rep").to_numpy()
        self.sets = [np.frombuffer(h.as_py(), np.uint64) for h in rows.column("hashes")]
        self.size = np.array([len(x) for x in self.sets])
        self.flat, self.ends = np.concatenate(self.sets), np.cumsum(self.size)
        self.signatures = _signatures(rows.column("signature").combine_chunks())

    def linked(self, k: int, rest: np.ndarray, percent: int) -> np.ndarray:
        """Which of the rest the k-th is linked with."""
        size, own = self.size, self.sets[k]
        common = np.zeros(len(rest), np.int64)
        ok = (np.minimum(size[rest], size[k]) * 100 >= percent * np.maximum(size[rest], size[k])) & ((self.signatures[rest] != self.signatures[k]).sum(axis=1) <= DISTANCE)
        near = np.flatnonzero(ok)
        for at in range(0, len(near), 512):
            some = rest[near[at : at + 512]]
            rows = np.concatenate([self.flat[self.ends[r] - size[r] : self.ends[r]] for r in some])
            where = np.searchsorted(own, rows)
            hit = own[np.minimum(where, size[k] - 1)] == rows
            common[near[at : at + 512]] = np.add.reduceat(hit, np.r_[0, np.cumsum(size[some])[:-1]])
        return ok & (100 * common >= percent * (size[rest] + size[k] - common))


_SET_COLUMNS = ("rep", "digest", "signature", "hashes")


def _confirmed(df: DataFrame, clusters: DataFrame, width: int, percent: int) -> DataFrame:
    """Stars (a, b) of classes that links on full sets connect; clusters: rep, cluster, n_shingles."""
    total = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("_m"), F.sum("n_shingles").alias("_w"))
    parts = F.greatest(F.ceil(F.col("_m") / F.lit(MEMBERS)), F.ceil(F.col("_w") / F.lit(SET_BLOCK))).cast("int")
    members = materialize(clusters.join(total.select("cluster", parts.alias("_n")), "cluster").select("rep", "cluster", "_n"), "members")
    sets = materialize(_sets(df, members, width), "sets")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 1):
            group = _Group(rows)
            yield _edges([_stars(group.reps, _components(len(group.reps), lambda k, rest: group.linked(k, rest, percent)))])

    small = sets.filter("_n = 1").select("cluster", *_SET_COLUMNS).repartition("cluster").sortWithinPartitions("cluster").mapInArrow(whole, "a long, b long")
    large = sets.filter("_n > 1")
    if large.isEmpty():
        return small
    stars = materialize(_of_centres(large, percent), "stars")
    links = small.unionAll(stars.filter("linked").select("a", "b"))
    apart = stars.filter("not linked").select(F.col("b").alias("rep")).distinct()
    return links if apart.isEmpty() else links.unionAll(_of_others(large, apart, percent))


def _of_centres(large: DataFrame, percent: int) -> DataFrame:
    """a, the centre of a cluster, b, a member, and whether they are linked, for all members: each group has the centre beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 2):
            group, centre = _Group(rows), rows.column("cluster")[0].as_py()
            found = group.reps == centre
            for k in np.flatnonzero(found):
                found |= group.linked(int(k), np.arange(len(group.reps)), percent)
            reps, first = np.unique(group.reps, return_index=True)
            linked = np.zeros(len(reps), bool)
            np.logical_or.at(linked, np.searchsorted(reps, group.reps), found)
            yield _batch(a=pa.array(np.full(len(reps), centre)), b=pa.array(reps), linked=pa.array(linked))

    part = F.pmod(F.xxhash64("rep"), F.col("_n")).cast("int")
    rows = large.select("cluster", part.alias("part"), *_SET_COLUMNS)
    centres = large.filter("rep = cluster").select("cluster", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("part"), *_SET_COLUMNS)
    dealt = rows.unionAll(centres).repartition("cluster", "part").sortWithinPartitions("cluster", "part")
    return dealt.mapInArrow(run, "a long, b long, linked boolean").distinct()


def _of_others(large: DataFrame, apart: DataFrame, percent: int) -> DataFrame:
    """Stars (a, b) that connect members without a link to their cluster's centre with each other and with the rest."""
    marked = large.join(apart.withColumn("_apart", F.lit(1)), "rep", "left").withColumn("_apart", F.coalesce("_apart", F.lit(0)))
    weight = F.sum(F.octet_length("hashes") / F.lit(8))
    of_side = marked.groupBy("cluster", "_apart").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(MEMBERS)), F.ceil(weight / F.lit(SET_BLOCK))).cast("int").alias("k"))
    blocks = of_side.groupBy("cluster").agg(F.max(F.when(F.col("_apart") == 1, F.col("k"))).alias("_u"), F.coalesce(F.max(F.when(F.col("_apart") == 0, F.col("k"))), F.lit(0)).alias("_l"))
    rows = marked.join(blocks.filter("_u > 0"), "cluster")
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("_apart") == 1, F.col("_u")).otherwise(F.col("_l"))).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda i, side, j: F.struct(i.cast("int").alias("i"), F.lit(side).alias("side"), j.cast("int").alias("j"))
    others = F.concat(F.transform(upto(F.col("_u")), lambda o: pair(F.least(o, F.col("_b")), 0, F.greatest(o, F.col("_b")))), F.transform(upto(F.col("_l")), lambda j: pair(F.col("_b"), 1, j)))
    rest = F.transform(upto(F.col("_u")), lambda i: pair(i, 1, F.col("_b")))
    rows = rows.withColumn("_b", mine).withColumn("_p", F.explode(F.when(F.col("_apart") == 1, others).otherwise(rest)))
    rows = rows.select("cluster", "_p.i", "_p.side", "_p.j", F.when(F.col("_p.side") == 1, F.col("_apart")).otherwise(F.col("_b")).alias("_tag"), *_SET_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _runs(batches, 4):
            group = _Group(found)
            i, side, j = (found.column(c)[0].as_py() for c in (1, 2, 3))
            tag, alone = group.rows.column("_tag").to_numpy(), side == 0 and i == j

            def linked(k: int, rest: np.ndarray) -> np.ndarray:
                ok = np.ones(len(rest), bool) if alone else tag[rest] != tag[k]  # pairs inside a block meet in its own group
                ok[ok] = group.linked(k, rest[ok], percent)
                return ok

            yield _edges([_stars(group.reps, _components(len(group.reps), linked))])

    dealt = rows.repartition("cluster", "i", "side", "j").sortWithinPartitions("cluster", "i", "side", "j")
    return dealt.mapInArrow(run, "a long, b long")


def _repeated_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between an id that several rows have and the classes of its texts."""
    twice = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    of_id = rows.join(twice, "doc_id", "left_semi").select("doc_id", "digest").distinct()
    return of_id.join(classes.select("digest", "rep"), "digest").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``df`` (doc_id, text)."""
    rows = materialize(sketch(df, width), "sketch")
    known = rows.filter(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    classes = materialize(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature")), "classes")
    shared = materialize(_shared_keys(classes), "keys")
    clusters = connected_components(_near_signatures(shared, classes), "candidates")
    drop(shared)
    clusters = clusters.join(classes.groupBy("rep").agg(F.max("n_shingles").alias("n_shingles")), F.col("node") == F.col("rep")).select("rep", F.col("component").alias("cluster"), "n_shingles")
    # An id with several texts is one document: its texts' classes are linked through it.
    repeated = materialize(_repeated_ids(rows, classes), "repeated")
    components = connected_components(_confirmed(df, clusters, width, percent).unionAll(repeated), "links")
    of_class = classes.join(components, classes["rep"] == components["node"], "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(of_class, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    if not repeated.isEmpty():  # rows of such an id that have no words follow its other rows
        of_id = repeated.select(F.col("b").alias("doc_id")).distinct().join(components, F.col("doc_id") == F.col("node")).select("doc_id", F.col("component").alias("_of_id"))
        out = out.join(of_id, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("_of_id", "component_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
