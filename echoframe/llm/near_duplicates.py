"""Near-duplicate documents by HyperMinHash.

One 64-bit hash per word shingle picks one of 128 registers; a register keeps
the largest leading-zero count and, beside it, ten mantissa bits.  Empty
registers borrow from a fixed sequence of others (densification), so that short
documents have 128 comparable registers too.  Bands of four registers give
candidates: at a similarity of 0.8 all 32 bands miss with probability 5e-8 if
registers are independent.  Those of very small sets are not, as borrowed registers
repeat (bands miss 6e-4 of pairs of 4 and 5 shingles).  But where a union is so small
that the threshold leaves room for one missing shingle only (below 10 shingles at 0.8),
linked sets are equal or one is the other less a shingle: such sets also carry
the keys of what is left without each of their shingles, and a join on these keys
gives every such pair.

1. Equal shingle sets form classes, represented by the smallest doc_id.  Links of small
   sets come from their keys first.
2. Each bucket has its smallest member as leader.  In rounds, every class is held
   against one leader of its buckets that isn't in its component yet: by the
   collision-corrected estimate, then on full shingle sets.  A round is linear in the
   input however large buckets are; components of the confirmed links follow.
3. Buckets whose members already share one component need no more work.  In any other
   bucket of at most TINY members the pairs that are left are held against each other
   in the same way; one of at most SMALL members is a block.  Larger ones overlap (texts of one
   template meet in most bands), so those that share members form a team, and a
   member is sent to its team once, not once a band; a team beyond BLOCK_BYTES is cut in
   slices, and each pair of slices is a block.
4. In a block, members of different components are compared: by the estimate, and those
   that it doesn't exclude on their full sets.  What leaves it is which components are
   one, at most a row a member.

So no link of small sets is lost, no other one after banding, and none is followed before it is confirmed.  In a
team of M texts that are alike but not linked, comparisons grow with the square of M
and what is sent with M * M / 14,000 (for sets of 450): nothing is sent more than once
below that.

Defined results: null or wordless texts have an empty set and link with nothing;
rows with a null doc_id are kept unlinked; rows that share a doc_id are one vertex; an
empty table gives an empty result; doc_id is an integer column, and further columns are
not read (drop_near_duplicates returns them as they are).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import forget, pieces, written
from .text import U64, buffers, mix64, shingles, words

REGISTERS, ROWS, MANTISSA = 128, 4, 10
BANDS = REGISTERS // ROWS
#: Two different minima of equally large sets share a leading-zero count with probability about 1/3, and then the mantissa.
COLLISION = 2.0**-MANTISSA / 3
#: Standard deviations below the threshold at which an estimate excludes a pair; sets below LOOSE are never excluded so.
SIGMAS, LOOSE = 5, 32
#: Bits of the bitmap that marks documents, for each of them, and its bounds.
BITMAP_SPREAD, BITMAP_LEAST, BITMAP_MOST = 8, 1 << 20, 1 << 27
ROUNDS, TINY, SMALL = 3, 8, 256
#: Sets of more shingles carry no keys, whatever the threshold; their registers differ enough.
MOST_KEYS = 32
SALTS = (0x1234567, 0x89ABCDEF01)
#: Bytes of shingle sets in a slice of a team; members compared at once; where counting by matrix products beats pair by pair.
BLOCK_BYTES, TILE, DENSE = 48 << 20, 1024, 512

_rng = np.random.default_rng(20260101)
#: where an empty register looks for a filled one, in this order
_BORROW = np.stack([_rng.permutation(REGISTERS) for _ in range(24)])
_SPREAD = _rng.permutation(REGISTERS)


def distinct_shingles(data, offsets, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    h, at = shingles(words(data, offsets), size)
    return [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:])]


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Densified registers, one row of 128 per set; zeros for an empty set."""
    count = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.zeros((len(sets), REGISTERS), dtype=np.uint16)
    if count.sum():
        h = mix64(np.concatenate(sets))
        bucket = (h >> U64(57)).astype(np.int64)
        _, exponent = np.frexp(((h >> U64(MANTISSA)) & U64((1 << 47) - 1)).astype(np.float64))
        value = ((47 - exponent) << MANTISSA) + ((1 << MANTISSA) - (h & U64((1 << MANTISSA) - 1)).astype(np.int64))
        key = np.sort(((np.repeat(np.arange(len(sets)), count) * REGISTERS + bucket) << 17) | value)
        last = np.append(np.flatnonzero(np.diff(key >> 17)), len(key) - 1)
        out.reshape(-1)[key[last] >> 17] = (key[last] & 0x1FFFF).astype(np.uint16)
    sparse = np.flatnonzero((count > 0) & (out == 0).any(axis=1))
    if len(sparse):
        raw = out[sparse]
        full = raw.copy()
        for source in _BORROW:
            full = np.where(full == 0, raw[:, source], full)
        step = raw
        while (full == 0).any():  # the nearest filled register to the right
            step = np.roll(step, -1, axis=1)
            full = np.where(full == 0, step, full)
        out[sparse] = full
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One hash per band and set."""
    r = regs[:, _SPREAD].astype(U64).reshape(len(regs), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), (len(regs), BANDS)).copy()
    for k in range(ROWS):
        out = mix64(out ^ (r[:, :, k] + U64(1)))
    return out.view(np.int64)


def estimate(equal: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for chance collisions."""
    return np.maximum(0, (equal / REGISTERS - COLLISION) / (1 - COLLISION))


def carries_keys(n: np.ndarray, percent: int) -> np.ndarray:
    """Whether a set of n shingles may be linked with itself less one, and with no set that differs by two."""
    return (n * (100 - percent) >= 100) & (n * (100 - percent) < 200) & (n <= MOST_KEYS)


def _sketcher(size: int, percent: int):
    def run(batches):
        for batch in pieces(batches):
            sets = distinct_shingles(*buffers(batch.column("text")), size)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            flat = np.concatenate([np.zeros(0, U64), *sets])
            at = np.concatenate([[0], np.cumsum(n)])
            few = carries_keys(n, percent)
            keyed, places = np.repeat(few, n), np.concatenate([[0], np.cumsum(np.where(few, n, 0))]).astype(np.int32)
            sums, left = [], []
            for salt in SALTS:
                mixed = mix64(flat ^ U64(salt))
                total = np.concatenate([[U64(0)], np.cumsum(mixed, dtype=U64)])
                total = total[at[1:]] - total[at[:-1]]
                sums.append(total.view(np.int64))
                left.append(pa.ListArray.from_arrays(pa.array(places), pa.array((np.repeat(total[few], n[few]) - mixed[keyed]).view(np.int64))))
            regs = registers(sets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), *map(pa.array, sums), *left, pa.array([r.tobytes() for r in regs], pa.binary())], ["doc_id", "n", "s1", "s2", "left1", "left2", "reg"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _bander(batches):
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_matrix(batch.column("reg")))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(batch.column("rep").to_numpy(), BANDS))], ["band", "rep"])


def _set_maker(size: int, bitmap):
    def run(batches):
        bits = np.frombuffer(bitmap.value, dtype=np.uint8)
        for batch in pieces(batches):
            spot = batch.column("spot").to_numpy()
            batch = batch.filter(pa.array((bits[spot >> 3] >> (spot & 7)) & 1 == 1))
            if batch.num_rows:
                sets = distinct_shingles(*buffers(batch.column("text")), size)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "shingles"])

    return run


def sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, shingles): sorted 64-bit hashes of the documents in ids.

    Sets are made again from the texts, for these documents only: a bitmap of eight bits
    a document, between 128 KB and 16 MB, marks them (false marks cost time, not
    correctness).
    """
    total = BITMAP_LEAST
    while total < min(ids.count() * BITMAP_SPREAD, BITMAP_MOST):
        total *= 2
    spot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(total))
    marked = ids.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    bitmap = bytearray(total // 8 + 8192)
    for part, bits in marked.toLocalIterator():  # at most 4,097 rows of 4 KB
        # these functions number bits of positive numbers from 1; bucket 0 holds the number 0, which goes last here
        at = (part - 1) * 4096 if part > 0 else len(bitmap) - 8192
        bitmap[at : at + len(bits)] = bits
    shared = docs.sparkSession.sparkContext.broadcast(bytes(bitmap))
    place = F.when(spot == 0, F.lit(total)).otherwise(spot - 1)
    made = docs.filter("doc_id is not null").select("doc_id", "text", place.cast("int").alias("spot")).mapInArrow(_set_maker(size, shared), "doc_id long, shingles binary")
    return written(made.join(ids, "doc_id", "left_semi"), "sets")


def maybe(equal: np.ndarray, least: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets, the smaller of `least` shingles, may reach the threshold as so many of their registers are equal."""
    share = percent / 100
    # registers of small sets repeat each other: as many count as are filled
    sigma = np.sqrt(share * (1 - share) / (REGISTERS * (1 - np.exp(-np.maximum(least, 1) / REGISTERS))))
    return (estimate(equal) >= share - SIGMAS * sigma) | (least < LOOSE)


def _estimator(percent: int):
    """Pairs that the estimate doesn't exclude."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                equal = (_matrix(batch.column("x")) == _matrix(batch.column("y"))).sum(axis=1)
                low, high = np.sort(np.stack([batch.column("n").to_numpy(), batch.column("m").to_numpy()]), axis=0)
                yield batch.filter(pa.array(maybe(equal, low, percent) & (100 * low >= percent * high))).select(["a", "b"])

    return run


def _confirmer(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, dtype=U64), np.frombuffer(y, dtype=U64)
                if len(x) > len(y):
                    x, y = y, x
                if not len(x) or 100 * len(x) < percent * len(y):
                    keep.append(False)
                    continue
                shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of classes whose full shingle sets have 100 * intersection >= percent * union."""
    x, y = reps.select(F.col("rep").alias("a"), F.col("n"), F.col("reg").alias("x")), reps.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("reg").alias("y"))
    likely = written(pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(_estimator(percent), "a long, b long"), "likely")
    x, y = sets.toDF("a", "x"), sets.toDF("b", "y")
    out = written(likely.join(x.hint("merge"), "a").join(y.hint("merge"), "b").mapInArrow(_confirmer(percent), "a long, b long").distinct(), "confirmed")
    forget(likely)
    return out


class Tile:
    """Up to TILE members of a block: components, sizes, registers, and their shingles as numbers of a sorted list."""

    def __init__(self, comp: np.ndarray, reg: np.ndarray, sets: list[bytes]):
        self.comp, self.reg = comp, reg
        arrays = [np.frombuffer(x, dtype=U64) for x in sets]
        self.n = np.array([len(x) for x in arrays])
        self.row = np.repeat(np.arange(len(arrays), dtype=np.int32), self.n)
        self.keys, key = np.unique(np.concatenate([np.zeros(0, U64), *arrays]), return_inverse=True)
        self.key = key.astype(np.int32)


def shared_shingles(a: Tile, b: Tile) -> np.ndarray:
    """Sizes of the intersections of all members of a with all of b."""
    out = np.zeros((len(a.n), len(b.n)), dtype=np.float32)
    _, ia, ib = np.intersect1d(a.keys, b.keys, assume_unique=True, return_indices=True)

    def held(tile, places):
        """(row, column) of a tile's shingles that both have, by column, and how many each column has."""
        column = np.full(len(tile.keys), -1)
        column[places] = np.arange(len(places))
        column = column[tile.key]
        row, column = tile.row[column >= 0], column[column >= 0]
        order = np.argsort(column, kind="stable")
        return row[order], column[order], np.bincount(column, minlength=len(places))

    (ra, ca, na), (rb, cb, nb) = held(a, ia), held(b, ib)
    dense = na * nb >= DENSE
    for low in range(0, int(dense.sum()), 2 * TILE):
        chosen = np.flatnonzero(dense)[low : low + 2 * TILE]
        place = np.full(len(na), -1)
        place[chosen] = np.arange(len(chosen))
        sides = []
        for tile, r, c in ((a, ra, ca), (b, rb, cb)):
            side = np.zeros((len(tile.n), len(chosen)), dtype=np.float32)
            p = place[c]
            side[r[p >= 0], p[p >= 0]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    start = np.cumsum(nb) - nb
    few = np.flatnonzero(~dense[ca])
    for low in range(0, len(few), 1 << 14):
        some = few[low : low + (1 << 14)]
        times = nb[ca[some]]
        other = np.repeat(start[ca[some]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        np.add.at(out, (np.repeat(ra[some], times), rb[other]), 1)
    return out


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest labels after joining the sets of a and b."""
    while True:
        x, y = parent[a], parent[b]
        if (x == y).all():
            return parent
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent != parent[parent]).any():
            parent = parent[parent]


def one_component(first: list[Tile], second: list[Tile] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Components (with the smallest of the block that each is one with) that confirmed links join: links between members of first and second, or within first."""
    every = first + (second or [])
    names = np.unique(np.concatenate([t.comp for t in every]))
    number = [np.searchsorted(names, t.comp) for t in every]
    parent = np.arange(len(names))
    pairs = [(i, j) for i in range(len(first)) for j in (range(len(first), len(every)) if second else range(i, len(first)))]
    for i, j in pairs:
        a, b = every[i], every[j]
        open_ = parent[number[i]][:, None] != parent[number[j]][None, :]
        least, most = np.minimum(a.n[:, None], b.n[None, :]), np.maximum(a.n[:, None], b.n[None, :])
        open_ &= 100 * least >= percent * most
        if not open_.any():
            continue
        equal = np.zeros(open_.shape, dtype=np.uint8)
        for k in range(REGISTERS):
            equal += a.reg[:, k][:, None] == b.reg[:, k][None, :]
        open_ &= maybe(equal, least, percent)
        if not open_.any():
            continue
        shared = shared_shingles(a, b)
        x, y = np.nonzero(open_ & (100 * shared >= percent * (a.n[:, None] + b.n[None, :] - shared)))
        parent = _merge(parent, number[i][x], number[j][y])
    moved = parent != np.arange(len(names))
    return names[moved], names[parent[moved]]


def _block_links(percent: int):
    """From rows sorted by block: pairs of components that are one."""
    block = ("kind", "key", "i", "j")

    def links(parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts)
        side, comp = rows.column("side").to_numpy(), rows.column("comp").to_numpy()
        tiles: list[list[Tile]] = [[], []]
        for which in (0, 1):
            mine = np.flatnonzero(side == which)
            mine = mine[np.argsort(comp[mine], kind="stable")]
            for a in range(0, len(mine), TILE):
                t = rows.take(pa.array(mine[a : a + TILE])).combine_chunks()
                tiles[which].append(Tile(comp[mine[a : a + TILE]], _matrix(t.column("reg")), t.column("shingles").to_pylist()))
        parts.clear()
        del rows
        a, b = one_component(tiles[0], tiles[1] or None, percent)
        return pa.RecordBatch.from_arrays([pa.array(b.astype(np.int64)), pa.array(a.astype(np.int64))], ["a", "b"])

    def run(batches):
        held, name = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in block)))
            a = 0
            for b in range(1, len(keys) + 1):
                if b == len(keys) or keys[b] != keys[a]:
                    if held and name != keys[a]:
                        yield links(held)
                        held = []
                    name = keys[a]
                    held.append(batch.slice(a, b - a))
                    a = b
        if held:
            yield links(held)

    return run


def _one_apart(reps: DataFrame) -> DataFrame:
    """(a, b): small classes b and the classes a that are b less one shingle.

    A row of reps has at most MOST_KEYS keys, and a class is the only one with its own
    (n, s1, s2), so a pair comes out once a key.
    """
    less = reps.filter(F.size("left1") > 0).select(F.col("rep").alias("b"), (F.col("n") - 1).alias("n"), F.explode(F.arrays_zip("left1", "left2")).alias("left"))
    less = less.select("b", "n", F.col("left.left1").alias("s1"), F.col("left.left2").alias("s2"))
    return less.join(reps.select("n", "s1", "s2", F.col("rep").alias("a")), ["n", "s1", "s2"]).select("a", "b")


def _stars(members: DataFrame, label: DataFrame, tested: DataFrame | None) -> DataFrame:
    """(a, b): for each class b the smallest leader a of its buckets that it wasn't held against and that is in another component."""
    near = label.toDF("leader", "near")
    rows = members.join(label.toDF("rep", "comp"), "rep", "left").join(near, "leader", "left").filter(F.coalesce("comp", "rep") != F.coalesce("near", "leader"))
    if tested is not None:
        rows = rows.join(tested, "rep", "left").filter("last is null or leader > last")
    return rows.groupBy("rep").agg(F.min("leader").alias("a")).select("a", F.col("rep").alias("b"))


def _blocks(members: DataFrame, label: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that members of unresolved buckets bring about."""
    everyone = members.unionByName(members.select("band", "leader", F.col("leader").alias("rep")).distinct())
    in_comp = written(everyone.join(label.toDF("rep", "comp"), "rep", "left").select("band", "leader", "rep", F.coalesce("comp", "rep").alias("comp")), "in_comp")
    held = in_comp.groupBy("band").agg(F.count("*").alias("total"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("band", "total")
    rows = written(in_comp.join(held, "band"), "unresolved")
    tiny, size = rows.filter(F.col("total") <= TINY).select("band", "rep", "comp"), F.col("total")
    # at most TINY members a band
    pairs = tiny.toDF("band", "a", "near").join(tiny.toDF("band", "b", "far"), "band").filter("a < b and near != far").select("a", "b").distinct()
    few = confirmed(written(pairs, "pairs"), reps, sets, percent)
    member = reps.select("rep", "n", "reg")
    zero = F.lit(0).cast("long")
    blocks = rows.filter((size > TINY) & (size <= SMALL)).select(F.lit(0).alias("kind"), F.col("band").alias("key"), zero.alias("i"), zero.alias("j"), F.lit(0).alias("side"), "comp", "rep")
    edges = rows.filter(size > SMALL).select(F.col("leader").alias("a"), F.col("rep").alias("b"))
    teams = None
    if edges.limit(1).count():
        teams = components(edges)
        sized = teams.toDF("rep", "team").join(member.select("rep", "n"), "rep")
        slices = sized.groupBy("team").agg((F.floor(F.sum(8 * F.col("n") + 2 * REGISTERS) / BLOCK_BYTES) + 1).alias("slices"))
        cut = sized.join(slices, "team").join(label.toDF("rep", "comp"), "rep", "left").select("rep", "team", "slices", F.coalesce("comp", "rep").alias("comp"), F.pmod(F.xxhash64("rep"), F.col("slices")).alias("s"))
        cut = cut.withColumn("t", F.explode(F.sequence(zero, F.col("slices") - 1)))
        blocks = blocks.unionByName(cut.select(F.lit(1).alias("kind"), F.col("team").alias("key"), F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"), (F.col("s") > F.col("t")).cast("int").alias("side"), "comp", "rep"))
    joined = blocks.join(member.select("rep", "reg"), "rep").join(sets.toDF("rep", "shingles").hint("merge"), "rep")
    joined = joined.repartition("kind", "key", "i", "j").sortWithinPartitions("kind", "key", "i", "j").select("kind", "key", "i", "j", "side", "comp", "reg", "shingles")
    out = written(joined.mapInArrow(_block_links(percent), "a long, b long"), "more")
    forget(in_comp, rows, *([teams] if teams is not None else []))
    return few.unionByName(out)


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs.

    doc_id is an integer column; documents link when 100 * intersection >= percent *
    union of their sets of word shingles.
    """
    sketch = written(docs.select("doc_id", "text").mapInArrow(_sketcher(shingle, percent), "doc_id long, n long, s1 long, s2 long, left1 array<long>, left2 array<long>, reg binary"), "sketch")
    usable = sketch.filter("n > 0 and doc_id is not null")
    reps = written(usable.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("reg", "left1", "left2"))), "classes")
    apart = written(_one_apart(reps), "apart")
    bands = reps.select("rep", "reg").mapInArrow(_bander, "band long, rep long")
    leaders = bands.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("k")).filter("k > 1").select("band", "leader")
    members = written(bands.join(leaders, "band").filter("rep != leader"), "members")
    compared = members.select(F.explode(F.array("leader", "rep")).alias("doc_id")).union(apart.select(F.explode(F.array("a", "b"))))
    sets = sets_of(docs, compared.distinct(), shingle)
    links = confirmed(apart, reps, sets, percent)
    label, tested, old = components(links), None, [apart, links]
    for _ in range(ROUNDS):
        stars = written(_stars(members, label, tested), "stars")
        found = confirmed(stars, reps, sets, percent)
        old.append(stars)
        last = stars.select(F.col("b").alias("rep"), F.col("a").alias("last"))
        tested = last if tested is None else tested.unionByName(last).groupBy("rep").agg(F.max("last").alias("last"))
        old.append(found)
        links = links.unionByName(found)
        forget(label)
        label = components(links)
    more = _blocks(members, label, reps, sets, percent)
    forget(members, sets)
    known = written(usable.select("doc_id", "n", "s1", "s2").join(reps.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).select("doc_id", "rep"), "known")
    # rows that share a doc_id join the classes of their texts
    several = known.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).filter("a != most")
    bridges = known.join(several, "doc_id").select("a", F.col("rep").alias("b"))
    # every component is a vertex with its links, so that those found last join whole components
    final = components(label.select(F.col("v").alias("a"), F.col("comp").alias("b")).unionByName(more).unionByName(bridges))
    comp = known.join(final.toDF("rep", "comp"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("comp", "rep")).alias("comp"))
    out = sketch.select("doc_id", "n").join(comp, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))
    result = written(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "groups")
    forget(sketch, reps, label, final, known, *old)
    return result


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with all its columns, one document of each group of near-duplicates: the one with the smallest doc_id.

    Of several equal rows with that doc_id one stays.
    """
    found = near_duplicates(docs, shingle, percent)
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    repeated = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    # as many rows as documents, in the worst case: never a table to broadcast
    left = docs.join(gone.hint("merge"), "doc_id", "left_anti")
    if not repeated.limit(1).count():
        return left.select(docs.columns)
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).union(left.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))
