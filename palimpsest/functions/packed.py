"""Neighbours and sums over neighbours, with pairs of users made, judged and dropped inside tasks.

Long vectors (``user_id, item_id, value``) go into blocks of whole users. Query users are dealt to parts; a part holds its
query vectors by item, meets one block after another and keeps the k best of each query user, so no pair is ever written. A
block goes to a part packed, as small whole numbers in byte planes; with many parts, only entries of items that the part has.
So what is written grows with the pairs at most, at two or three bytes each.

Ids are whole numbers but the least 64-bit one, which stands for a null item: it is in a vector, but meets nothing.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.held import stored

#: Entries of query vectors that a part holds, entries of a block, and of vectors that a part of sums holds.
QUERY_ENTRIES, BLOCK_ENTRIES, SUM_ENTRIES = 1 << 20, 1 << 18, 1 << 21
#: Pairs of entries at a time.
PAIRS = 1 << 21
#: Items lie in so wide a span at most to be found by a table, unless they fill an eighth of it.
TABLE = 1 << 22
#: With so many parts at most, each gets whole blocks.
WHOLE = 40
#: Ranges of users are recommended to where they meet all that they share items with: a range gets so many entries at most,
#: and all ranges together so many times the entries that there are.
RANGE_ENTRIES, RANGE_COPIES = 1 << 22, 12
#: Where that is too much, each range reads all blocks itself, if there are so many at most: what is read grows with their
#: square. It holds so many entries of neighbours at a time, and reads all blocks again for the next ones.
STREAMS, HELD_ENTRIES = 256, 1 << 23
#: Items that sums of a user are kept for in an array, whether or not he has them.
DENSE = 1 << 18
NONE = -(1 << 63)
OWN, OTHERS = 0, 1
_PRIME, _FACTOR = (1 << 31) - 1, 48271
PACKED = "part int, kind int, users binary, sizes binary, totals binary, items binary, codes binary, values binary"
_HEAD = struct.Struct("<qqq")


def _ints(x: np.ndarray) -> bytes:
    """Whole numbers as their differences from the least, in planes of bytes, compressed."""
    x = np.ascontiguousarray(x, np.int64)
    low = int(x.min()) if len(x) else 0
    apart = (x - np.int64(low)).view(np.uint64)  # differences modulo 2^64, which come back exactly
    width = next(w for w in (1, 2, 3, 4, 8) if w == 8 or not len(x) or int(apart.max()) >> (8 * w) == 0)
    planes = apart.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return _HEAD.pack(low, width, len(x)) + pa.compress(planes, codec="zstd", asbytes=True)


def _of_ints(data: bytes) -> np.ndarray:
    low, width, n = _HEAD.unpack_from(data)
    planes = pa.decompress(data[_HEAD.size :], decompressed_size=width * n, codec="zstd", asbytes=True) if n else b""
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return (out.reshape(-1).view(np.uint64) + np.uint64(low & (2**64 - 1))).view(np.int64)


def _rising(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.int64(0))


def _places(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... so many times, one run after another."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _order(user: np.ndarray, item: np.ndarray) -> np.ndarray:
    """By user and then item; both in one number where they fit, which sorts faster."""
    if not len(user):
        return np.zeros(0, np.int64)
    low, first = int(item.min()), int(user.min())
    span = int(item.max()) - low + 1
    if (int(user.max()) - first + 1) * span >= 1 << 62:
        return np.lexsort((item, user))
    return np.argsort((user - first) * np.int64(span) + (item - low))


@dataclass
class Block:
    """Whole users: their entries one user after another, by item, and what each whole vector comes to."""

    users: np.ndarray
    sizes: np.ndarray
    totals: np.ndarray
    items: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, user: np.ndarray, item: np.ndarray, value: np.ndarray, by: str = "jaccard") -> tuple[Block, np.ndarray]:
        """A block and the order of its entries in the arrays given."""
        order = _order(user, item)
        user, item, value = user[order], item[order], value[order]
        users, first, sizes = np.unique(user, return_index=True, return_counts=True)
        totals = sizes.astype(np.float64)
        if by != "jaccard" and len(first):
            totals = np.add.reduceat(value * value if by == "distance" else value, first)
        return cls(users, sizes.astype(np.int64), totals, item, value), order

    def only(self, users: np.ndarray, entries: np.ndarray | None = None) -> Block:
        """Of the users of a mask, entries of another; totals stay those of whole vectors."""
        keep = np.repeat(users, self.sizes)
        sizes = self.sizes
        if entries is not None:
            keep &= entries
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))
            users = users & (sizes > 0)
        return Block(self.users[users], sizes[users], self.totals[users], self.items[keep], self.values[keep])

    def first(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def row(self, part: int, kind: int) -> tuple:
        """As a row of PACKED. Values that repeat are told by their place among the distinct ones."""
        distinct, code = np.unique(self.values, return_inverse=True)
        few = len(distinct) * 4 <= len(code)
        totals, times = np.unique(self.totals, return_inverse=True)
        at = struct.pack("<q", len(totals)) + totals.tobytes() + _ints(times)
        values = (distinct if few else self.values).tobytes()
        return part, kind, _ints(_rising(self.users)), _ints(self.sizes), at, _ints(_rising(self.items)), _ints(code) if few else b"", values

    @classmethod
    def read(cls, row: dict) -> Block:
        """Without values if the row has none."""
        n = struct.unpack_from("<q", row["totals"])[0]
        totals = np.frombuffer(row["totals"], np.float64, n, 8)[_of_ints(row["totals"][8 + 8 * n :])]
        values = np.frombuffer(row["values"] or b"", np.float64)
        if row["codes"]:
            values = values[_of_ints(row["codes"])]
        return cls(np.cumsum(_of_ints(row["users"])), _of_ints(row["sizes"]), totals, np.cumsum(_of_ints(row["items"])), values)

    @classmethod
    def joined(cls, blocks: list[Block]) -> Block:
        return cls(*(np.concatenate([getattr(b, name) for b in blocks]) for name in cls.__dataclass_fields__))


def _table(rows: list[tuple]) -> pa.Table:
    names = [x.split()[0] for x in PACKED.split(", ")]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def _rows(table: pa.Table, kind: int) -> Iterator[dict]:
    """Rows of a kind, one at a time, in an order that does not depend on the shuffle's."""
    at = [i for i, x in enumerate(table["kind"].to_pylist()) if x == kind]
    for i in at:
        yield table.slice(i, 1).to_pylist()[0]


def _part(user: Column | np.ndarray, n: int) -> Column | np.ndarray:
    """Which part a user is dealt to: the same in Spark and in numpy."""
    if isinstance(user, Column):
        return (F.pmod(F.pmod(user, F.lit(_PRIME)) * _FACTOR, F.lit(_PRIME)) % n).cast("int")
    return np.mod(np.mod(user, _PRIME) * _FACTOR, _PRIME) % n


def _long(rows: DataFrame, name: str) -> DataFrame:
    """``user_id, item_id, value, own`` with the values under the name given, and nothing under the other."""
    item = F.coalesce(F.col("item_id").cast("long"), F.lit(NONE).cast("long")).alias("item_id")
    value = F.col("value").cast("double") if "value" in rows.columns else F.lit(1.0)
    columns = [(value if c == name else F.lit(None).cast("double")).alias(c) for c in ("value", "own")]
    return rows.select(F.col("user_id").cast("long").alias("user_id"), item, *columns).filter("user_id IS NOT NULL")


def _in_blocks(rows: DataFrame, n: int, pack: Callable[[pa.Table], Iterator[tuple]]) -> DataFrame:
    """PACKED rows of each block; a block has all rows of its users."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = list(batches)
        if whole:
            for row in pack(pa.Table.from_batches(whole)):
                yield from _table([row]).to_batches()

    return rows.repartition(n, "user_id").mapInArrow(run, PACKED)


def _vectors(table: pa.Table, name: str, by: str = "jaccard") -> tuple[Block, pa.Table, np.ndarray]:
    """The block of the rows that have a value under a name; these rows, and their order in the block."""
    some = table.filter(pa.compute.is_valid(table[name]))
    block, order = Block.of(_array(some, "user_id"), _array(some, "item_id"), _array(some, name), by)
    return block, some, order


def _array(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().to_numpy(zero_copy_only=False)


def _finder(items: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Where among rising items each of others is, or how many there are if it isn't there: by a table, if that isn't too large."""
    n = len(items)
    low, span = (int(items[0]), int(items[-1]) - int(items[0]) + 1) if n else (0, 0)
    if span > max(TABLE, 8 * n):

        def found(x: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(items, x), n - 1)
            return np.where(items[at] == x, at, n)

        return found
    table = np.full(span + 1, n, np.int32)
    table[items - low] = np.arange(n)
    return lambda x: table[np.minimum((x - np.int64(low)).view(np.uint64), np.uint64(span)).view(np.int64)]


class _Best:
    """The k least of each query user, by rank and then by id."""

    def __init__(self, n: int, k: int):
        self.k, self.limit = k, np.full(n, np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.count, self.most = 0, max(2 * n * k, 1 << 20)

    def add(self, user: np.ndarray, rank: np.ndarray, other: np.ndarray, score: np.ndarray) -> None:
        keep = rank <= self.limit[user]
        self.held.append(tuple(x[keep] for x in (user, rank, other, score)))
        self.count += len(self.held[-1][0])
        if self.count > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        user, rank, other, score = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else [np.zeros(0, np.int64)] * 4
        order = np.lexsort((other, rank, user))
        user = user[order]
        _, first, n = np.unique(user, return_index=True, return_counts=True)
        place = np.arange(len(user)) - np.repeat(first, n)
        keep = order[place < self.k]
        last = place == self.k - 1
        self.limit[user[last]] = rank[order[last]]
        held = (user[place < self.k], rank[keep], other[keep], score[keep])
        self.held, self.count = [held], len(held[0])
        self.most = max(self.most, 2 * self.count)
        return held


def _met(own: Block, blocks: Iterator[Block], k: int, by: str, digits: int, least: Block | None, above: float, at_once: int | None = None) -> tuple[np.ndarray, ...]:
    """``user, other, score`` of the k best of each query user; by ``shared`` all pairs above a Jaccard, with what they share
    and both totals.
    """
    squares, shared, pairs = by == "distance", by == "shared", []
    entry = np.argsort(own.items, kind="stable")
    entry = entry[own.items[entry] != NONE]
    items, start, count = np.unique(own.items[entry], return_index=True, return_counts=True)
    find, start, count = _finder(items), np.append(start, 0), np.append(count, 0)
    user = np.repeat(np.arange(len(own.users)), own.sizes)[entry]
    value = own.values[entry] if squares or shared else None
    best = _Best(len(own.users), k)

    def judged(u: np.ndarray, other: np.ndarray, total: np.ndarray, dot: np.ndarray) -> None:
        if squares:
            score = np.sqrt(np.maximum(own.totals[u] + total - 2 * dot, 0.0))
            best.add(u, np.floor(score * float(10**digits) + 0.3), other, score)
        elif shared:
            score = dot / (own.totals[u] + total - dot)
            keep = score > above
            u, total = u[keep], total[keep]
            pairs.append((own.users[u], other[keep], score[keep], dot[keep], own.totals[u], total))
        else:
            score = dot / (own.totals[u] + total - dot)
            best.add(u, -score, other, score)

    for block in blocks:
        at = find(block.items)
        n = count[at]
        ends = np.cumsum(np.bincount(np.repeat(np.arange(len(block.users)), block.sizes), weights=n, minlength=len(block.users))).astype(np.int64)
        edge, low = np.append(block.first(), len(n)), 0
        while low < len(block.users):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + (at_once or PAIRS), "right")))
            part = slice(edge[low], edge[high])
            times = n[part]
            there = times > 0
            places = _places(start[at[part][there]], times[there])
            u = user[places]
            o = np.repeat(np.repeat(np.arange(high - low), block.sizes[low:high])[there], times[there])
            key = u * np.int64(high - low) + o
            if squares or shared:
                order = np.argsort(key)
                key = key[order]
                cut = np.flatnonzero(np.diff(key, prepend=-1))
                dot = np.add.reduceat((value[places] * np.repeat(block.values[part][there], times[there]))[order], cut) if len(key) else np.zeros(0)
                key = key[cut]
            else:
                if len(own.users) * (high - low) < 1 << 31:
                    key = key.astype(np.int32)  # sorts faster
                key.sort()
                cut = np.flatnonzero(np.diff(key, prepend=key.dtype.type(-1)))
                dot = np.diff(np.append(cut, len(key))).astype(np.float64)
                key = key[cut]
            u, o = np.divmod(key, key.dtype.type(high - low))
            u, o = u.astype(np.int64), o.astype(np.int64) + low
            if not squares:
                apart = own.users[u] != block.users[o]
                u, o, dot = u[apart], o[apart], dot[apart]
            judged(u, block.users[o], block.totals[o], dot)
            low = high
    if least is not None:
        for i, first in enumerate(least.first()):
            mine = np.isin(own.items, np.setdiff1d(least.items[first : first + least.sizes[i]], [NONE]))
            shares = np.bincount(np.repeat(np.arange(len(own.users)), own.sizes)[mine], minlength=len(own.users)) > 0
            u = np.flatnonzero(~shares)
            judged(u, np.full(len(u), least.users[i]), np.full(len(u), least.totals[i]), np.zeros(len(u)))
    if shared:
        return tuple(np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0),) * 6
    u, _, other, score = best.cut()
    return own.users[u], other.astype(np.int64), score.astype(np.float64)


def nearest(queries: DataFrame, others: DataFrame, k: int, by: str, digits: int = 9) -> DataFrame:
    """``user_id, other_id`` and ``by``, which is ``jaccard`` (of item sets, highest first, others that share an item) or
    ``distance`` (Euclidean, least first at fixed point, itself included): the k best of each query user; ties to the
    smaller id. Vectors hold an item once. Values aren't negative, so of those who share nothing with a query the k of least
    norm are enough.
    """
    return _nearest(queries, others, by, k, digits)


def sharing(queries: DataFrame, others: DataFrame, above: float) -> DataFrame:
    """``user_id, other_id, jaccard, shared, own, theirs`` of all pairs of a higher Jaccard, of counts: a value is how often
    an item is there, what is shared the sum of products, and a total the sum of values. Nobody is with himself.
    """
    return _nearest(queries, others, "shared", above=above)


def _nearest(queries: DataFrame, others: DataFrame, by: str, k: int = 1, digits: int = 9, above: float = 0.0) -> DataFrame:
    mine, theirs = _long(queries, "own"), _long(others, "value")
    n_parts = max(1, -(-mine.count() // QUERY_ENTRIES))
    n_blocks = max(1, -(-theirs.count() // BLOCK_ENTRIES))
    least = None
    if by == "distance":
        norms = theirs.groupBy("user_id").agg(F.sum(F.col("value") * F.col("value")).alias("norm"))
        few = norms.orderBy(F.floor(F.col("norm") * float(10**digits) + 0.3), "user_id").limit(k).select("user_id")
        got = theirs.join(F.broadcast(few), "user_id", "left_semi").toArrow()  # k vectors, the least ones
        least = _vectors(got, "value", by)[0]
    rows = mine.unionByName(theirs)
    whole = n_parts <= WHOLE
    if not whole:
        wanted = mine.groupBy("item_id").agg(F.collect_set(_part(F.col("user_id"), n_parts)).alias("to"))
        rows = mine.withColumn("to", F.lit(None).cast("array<int>")).unionByName(theirs.join(wanted, "item_id", "left"))

    def pack(table: pa.Table) -> Iterator[tuple]:
        block = _vectors(table, "own", by)[0]
        part = _part(block.users, n_parts)
        for p in np.unique(part).tolist():
            yield block.only(part == p).row(p, OWN)
        block, some, order = _vectors(table, "value", by)
        if not len(order):
            return
        if whole:
            row = block.row(0, OTHERS)
            yield from ((p, *row[1:]) for p in range(n_parts))
            return
        lists = some["to"].combine_chunks()
        entry = np.repeat(np.arange(len(lists)), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        to, place = lists.flatten().to_numpy(zero_copy_only=False), np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by_part = np.argsort(to, kind="stable")
        every, cuts = np.ones(len(block.users), bool), np.searchsorted(to[by_part], np.arange(n_parts + 1))
        for p in range(n_parts):
            if cuts[p] < cuts[p + 1]:
                wants = np.zeros(len(order), bool)
                wants[place[entry[by_part[cuts[p] : cuts[p + 1]]]]] = True
                yield block.only(every, wants).row(p, OTHERS)

    columns = {"user_id": "long", "other_id": "long"} | ({"jaccard": "double", "shared": "double", "own": "double", "theirs": "double"} if by == "shared" else {by: "double"})

    def best(table: pa.Table) -> pa.Table:
        own = [Block.read(x) for x in _rows(table, OWN)]
        found = _met(Block.joined(own), map(Block.read, _rows(table, OTHERS)), k, by, digits, least, above) if own else [np.zeros(0)] * len(columns)
        kinds = [pa.int64() if x == "long" else pa.float64() for x in columns.values()]
        return pa.table([pa.array(x.astype(kind.to_pandas_dtype())) for x, kind in zip(found, kinds, strict=True)], names=list(columns))

    return _in_blocks(rows, n_blocks, pack).groupBy("part").applyInArrow(best, ", ".join(f"{name} {kind}" for name, kind in columns.items()))


def with_neighbours(queries: DataFrame | None, vectors: DataFrame, near: DataFrame, own: float, mean: float, top: int | None = None, digits: int = 9) -> DataFrame:
    """``user_id, item_id, value``: ``own`` times a query user's vector and ``mean`` times the mean of the vectors of its
    neighbours ``user_id, other_id``. Without ``queries``, users with neighbours are the queries, and have their own vectors
    among the others. With ``top`` there are only the highest of each user, with ``rank`` instead of the value: at fixed
    point, ties to the smaller item.
    """
    alone = queries is not None
    theirs = _long(vectors, "value")
    rows = theirs.unionByName(_long(queries, "own")) if alone else theirs.withColumn("own", F.col("value"))
    seen = theirs.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users")).first()
    met = near.count() * (seen.n // max(1, seen.users) + 1) + (queries.count() if alone else 0)
    n_parts, n_blocks = max(1, -(-met // SUM_ENTRIES)), max(1, -(-seen.n // BLOCK_ENTRIES))
    nothing = F.lit(None).cast("double")
    pairs = near.select(F.col("other_id").cast("long").alias("user_id"), F.col("user_id").cast("long").alias("item_id"), nothing.alias("value"), nothing.alias("own"))

    def pack(table: pa.Table) -> Iterator[tuple]:
        block = _vectors(table, "own")[0]
        part = _part(block.users, n_parts)
        for p in np.unique(part).tolist():
            yield block.only(part == p).row(p, OWN)
        asked = table.filter(pa.compute.and_(pa.compute.is_null(table["value"]), pa.compute.is_null(table["own"])))
        block = _vectors(table, "value")[0]
        whom, of = _array(asked, "user_id"), _array(asked, "item_id")
        part = _part(of, n_parts)
        order = np.lexsort((whom, of, part))
        whom, of, part = whom[order], of[order], part[order]
        for p in np.unique(part).tolist():
            low, high = np.searchsorted(part, [p, p + 1])
            sent = block.only(np.isin(block.users, whom[low:high]))
            # A neighbour without a vector counts in the mean, and adds nothing.
            place = np.full(high - low, -1)
            if len(sent.users):
                at = np.minimum(np.searchsorted(sent.users, whom[low:high]), len(sent.users) - 1)
                place = np.where(sent.users[at] == whom[low:high], at, -1)
            asks, row = _ints(_rising(of[low:high])), sent.row(p, OTHERS)
            both = struct.pack("<q", len(asks)) + asks + _ints(place)
            yield (*row[:4], struct.pack("<q", len(row[4])) + row[4] + both, *row[5:])

    def summed(table: pa.Table) -> pa.Table:
        blocks, for_whom, places, shift = [], [], [], 0
        for row in _rows(table, OTHERS):
            n = struct.unpack_from("<q", row["totals"])[0]
            both = row["totals"][8 + n :]
            row["totals"] = row["totals"][8 : 8 + n]
            asks = struct.unpack_from("<q", both)[0]
            block, place = Block.read(row), _of_ints(both[8 + asks :])
            for_whom.append(np.cumsum(_of_ints(both[8 : 8 + asks])))
            places.append(np.where(place < 0, -1, place + shift))
            shift += len(block.users)
            blocks.append(block)
        held = [Block.read(x) for x in _rows(table, OWN)]
        some = Block.joined(blocks) if blocks else None
        whom = np.concatenate(for_whom) if blocks else np.zeros(0, np.int64)
        place = np.concatenate(places) if blocks else np.zeros(0, np.int64)
        order = np.argsort(whom, kind="stable")
        whom, place = whom[order], place[order]
        users = np.unique(whom)
        ours = Block.joined(held) if held else None
        if alone and ours is not None:
            users = np.union1d(users, ours.users)
        if ours is not None:
            by_id = np.argsort(ours.users)
            ids, first_of = ours.users[by_id], ours.first()
        out = []
        step = max(1, PAIRS // max(1, len(whom) // max(1, len(users)) * (len(some.items) // max(1, len(some.users)) if some else 1)) // 2)
        for low in range(0, len(users), step):
            chunk = users[low : low + step]
            a, b = np.searchsorted(whom, chunk[0], "left"), np.searchsorted(whom, chunk[-1], "right")
            n_near = np.searchsorted(whom, chunk, "right") - np.searchsorted(whom, chunk, "left")
            u, item, value = [], [], []
            if b > a:
                have = place[a:b] >= 0
                which, asker = place[a:b][have], np.searchsorted(chunk, whom[a:b][have])
                at = _places(some.first()[which], some.sizes[which])
                u.append(np.repeat(asker, some.sizes[which]))
                item.append(some.items[at])
                value.append(some.values[at])
            n_theirs = sum(map(len, u))
            if ours is not None:
                at = np.minimum(np.searchsorted(ids, chunk), len(ids) - 1)
                there = ids[at] == chunk
                which = by_id[at[there]]
                at = _places(first_of[which], ours.sizes[which])
                u.append(np.repeat(np.flatnonzero(there), ours.sizes[which]))
                item.append(ours.items[at])
                value.append(own * ours.values[at])
            if not u:
                continue
            u, item, value = np.concatenate(u), np.concatenate(item), np.concatenate(value)
            value[:n_theirs] = mean * (value[:n_theirs] / n_near[u[:n_theirs]])
            order = _order(u, item)
            u, item, value = u[order], item[order], value[order]
            cut = np.flatnonzero((np.diff(u, prepend=-1) != 0) | (np.diff(item, prepend=0) != 0) | (np.arange(len(u)) == 0))
            value = np.add.reduceat(value, cut) if len(cut) else np.zeros(0)
            u, item = u[cut], item[cut]
            kept = pa.array(item, mask=item == NONE)
            if top is None:
                out.append(pa.table([pa.array(chunk[u]), kept, pa.array(value)], names=["user_id", "item_id", "value"]))
                continue
            order = np.lexsort((item, -np.floor(value * float(10**digits) + 0.3), u))
            _, first, n = np.unique(u[order], return_index=True, return_counts=True)
            rank = np.arange(len(order)) - np.repeat(first, n) + 1
            order, rank = order[rank <= top], rank[rank <= top]
            out.append(pa.table([pa.array(chunk[u[order]]), kept.take(pa.array(order)), pa.array(rank.astype(np.int32))], names=["user_id", "item_id", "rank"]))
        schema = pa.schema([("user_id", pa.int64()), ("item_id", pa.int64()), ("value", pa.float64()) if top is None else ("rank", pa.int32())])
        return pa.concat_tables(out).cast(schema) if out else schema.empty_table()

    return _in_blocks(rows.unionByName(pairs), n_blocks, pack).groupBy("part").applyInArrow(summed, f"user_id long, item_id long, {'value double' if top is None else 'rank int'}")


RANGED = f"{PACKED}, asks binary"
TOP = pa.schema([("user_id", pa.int64()), ("item_id", pa.int64()), ("rank", pa.int32())])


def recommended(vectors: DataFrame, queries: DataFrame, k: int, own: float, mean: float, top: int, digits: int = 9) -> DataFrame | None:
    """What ``with_neighbours`` gives with ``top`` for the k ``nearest`` by Jaccard, and no neighbours are written.

    Users go by ranges of their ids. A range gets the whole vectors of all who share an item with one of its query users, so
    neighbours and sums are found in one task. What is sent is counted first. Where ranges share so many items that it would
    be more than RANGE_ENTRIES or RANGE_COPIES allow, there is no answer (None): see ``recommended_anyhow``.
    """
    return _by_ranges(_in_ranges(vectors, queries), k, own, mean, top, digits)


def recommended_anyhow(vectors: DataFrame, queries: DataFrame, k: int, own: float, mean: float, top: int, digits: int = 9) -> DataFrame | None:
    """As ``recommended``; where ranges share too much, whatever the order of ids, each reads all blocks, and nothing is written
    for that either. With more than STREAMS ranges there is no answer, and neighbours have to be written.
    """
    ranges = _in_ranges(vectors, queries)
    found = _by_ranges(ranges, k, own, mean, top, digits)
    return _by_streams(ranges, k, own, mean, top, digits) if found is None else found


@dataclass
class _Ranges:
    """Blocks of a range of ids each; ``asks`` has which of their users are query users."""

    packed: DataFrame
    entries: int
    parts: list[int]
    item_type: type


def _in_ranges(vectors: DataFrame, queries: DataFrame) -> _Ranges:
    rows = _long(vectors, "value")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("low"), F.max("item_id").alias("high")).first()
    asked = queries.select(F.col("user_id").cast("long").alias("user_id"), F.lit(NONE).cast("long").alias("item_id"), F.lit(None).cast("double").alias("value"), F.lit(1.0).alias("own"))
    ranges = max(1, -(-seen.n // QUERY_ENTRIES))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if not whole:
            return
        table = pa.Table.from_batches(whole)
        block, _, _ = _vectors(table, "value")
        asks = np.isin(block.users, _array(table.filter(pa.compute.is_valid(table["own"])), "user_id"))
        yield from _ranged([(*block.row(TaskContext.get().partitionId(), OTHERS), asks.tobytes())]).to_batches()

    packed = stored(rows.unionByName(asked.filter("user_id IS NOT NULL")).repartitionByRange(ranges, "user_id").mapInArrow(pack, RANGED))
    short = seen.n and -(1 << 31) <= seen.low and seen.high < 1 << 31
    return _Ranges(packed, seen.n, sorted(r.part for r in packed.select("part").collect()), np.int32 if short else np.int64)


def _sharing(ranges: _Ranges) -> int:
    """How many entries the range in the middle would get. Told soon, where ranges share so much that it settles the matter."""
    if len(ranges.parts) < 2:
        return 0
    middle = F.col("part") == ranges.parts[len(ranges.parts) // 2]
    row = ranges.packed.filter(middle).first().asDict()
    wanted = np.setdiff1d(Block.read(row).only(np.frombuffer(row["asks"], bool)).items, [NONE])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(wanted)
        for row in _each(batches):
            block = Block.read(row)
            hit = np.append(0, np.cumsum(find(block.items) < len(wanted)))
            n = block.sizes[hit[block.first() + block.sizes] > hit[block.first()]].sum()
            yield pa.RecordBatch.from_arrays([pa.array([int(n)], pa.int64())], ["n"])

    return ranges.packed.filter(~middle).mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0


def _each(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _by_ranges(ranges: _Ranges, k: int, own: float, mean: float, top: int, digits: int) -> DataFrame | None:
    packed, entries = ranges.packed, ranges.entries
    if _sharing(ranges) + QUERY_ENTRIES > RANGE_ENTRIES:
        return None

    def items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, asks = Block.read(row), np.frombuffer(row["asks"], bool)
                for mine, own in ((block, False), (block.only(asks), True)):
                    found = np.setdiff1d(mine.items, [NONE])
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(np.full(len(found), row["part"], np.int32)), pa.array(np.full(len(found), own))], ["item_id", "part", "own"])

    def of(own: bool) -> Column:
        return F.collect_set(F.when(F.col("own") if own else ~F.col("own"), F.col("part")))

    where = stored(packed.mapInArrow(items, "item_id long, part int, own boolean").groupBy("item_id").agg(of(False).alias("has"), of(True).alias("wants")).filter("size(wants) > 0"))
    links = where.agg(F.sum(F.size("has").cast("long") * F.size("wants"))).first()[0] or 0
    if links > RANGE_COPIES * entries:
        return None
    links = where.select(F.explode("has").alias("part"), "item_id", "wants")

    def sent(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, Block]]:
        """To each other range, the users who have an item that one of its query users has."""
        item, lists = _array(right, "item_id"), right["wants"].combine_chunks()
        to = lists.flatten().to_numpy(zero_copy_only=False)
        item = np.repeat(item, pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        for row in left.to_pylist():
            block = Block.read(row)
            for p in np.setdiff1d(to, [row["part"]]).tolist():
                hit = np.append(0, np.cumsum(np.isin(block.items, item[to == p])))
                yield p, block.only(hit[block.first() + block.sizes] > hit[block.first()])

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        got = [(p, len(block.items)) for p, block in sent(left, right)]
        return pa.table([pa.array([p for p, _ in got], pa.int32()), pa.array([n for _, n in got], pa.int64())], names=["part", "n"])

    def blocks(left: pa.Table, right: pa.Table) -> pa.Table:
        return _ranged([(*block.row(p, OTHERS), b"") for p, block in sent(left, right)])

    def met(function: Callable, columns: str) -> DataFrame:
        return packed.groupBy("part").cogroup(links.groupBy("part")).applyInArrow(function, columns)

    n = met(counted, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    if (n.most or 0) + QUERY_ENTRIES > RANGE_ENTRIES or (n.n or 0) > RANGE_COPIES * entries:
        return None

    def best(table: pa.Table) -> pa.Table:
        found, asks = [], []
        for row in _rows(table, OTHERS):
            found.append(Block.read(row))
            asks.append(np.frombuffer(row["asks"], bool) if row["asks"] else np.zeros(len(found[-1].users), bool))
        if not any(x.any() for x in asks):
            return TOP.empty_table()
        order = sorted(range(len(found)), key=lambda i: found[i].users[0] if len(found[i].users) else NONE)
        return _recommended(Block.joined([found[i] for i in order]), np.concatenate([asks[i] for i in order]), k, own, mean, top, digits)

    return packed.unionByName(met(blocks, RANGED)).groupBy("part").applyInArrow(best, "user_id long, item_id long, rank int")


def _by_streams(ranges: _Ranges, k: int, own: float, mean: float, top: int, digits: int) -> DataFrame | None:
    """A task for each range reads its block (round 0), all blocks for the neighbours of its query users (1), and all again for
    the vectors of these neighbours, of some of the query users at a time (2 and on). Blocks are read from where they are
    stored, so nothing is shuffled.
    """
    parts, packed, kind = ranges.parts, ranges.packed, ranges.item_type
    if len(parts) > STREAMS:
        return None
    sums = max(1, -(-ranges.entries * k // (max(1, len(parts)) * HELD_ENTRIES)))
    rounds = 2 + sums
    tasks = packed.sparkSession.range(0, len(parts) * rounds, 1, max(1, len(parts))).select(F.element_at(F.array(*map(F.lit, parts or [0])), F.expr(f"int(id div {rounds}) + 1")).alias("to"), F.expr(f"int(id % {rounds})").alias("round"))
    first, second = F.col("round") == 0, F.col("round") == 1
    every = tasks.hint("shuffle_replicate_nl").join(packed.coalesce(1), ~first | (F.col("to") == F.col("part")))
    needed = [F.when(~second, F.col(c)).alias(c) if c in ("codes", "values") else F.when(first, F.col(c)).alias(c) if c == "asks" else F.col(c) for c in packed.columns]

    def whole(blocks: Iterator[dict]) -> Iterator[Block]:
        n = 0
        for n, row in enumerate(blocks, 1):
            yield Block.read(row)
        if n != len(parts):
            raise RuntimeError(f"{n} of {len(parts)} blocks were read")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = near = None
        for number, blocks in groupby(_each(batches), itemgetter("round")):
            if number == 0:
                row = next(blocks)
                mine = Block.read(row).only(np.frombuffer(row["asks"], bool))
            elif mine is None:
                raise RuntimeError("a range has no block of its own")
            elif not len(mine.users):
                continue
            elif number == 1:
                near = _Near.of(mine, whole(blocks), k, sums)
            else:
                yield from near.best(number - 2, whole(blocks), kind, own, mean, top, digits)

    return every.select("round", *needed).mapInArrow(run, "user_id long, item_id long, rank int")


@dataclass
class _Near:
    """Neighbours of some query users, by user and then by id: ``asker`` is a user's place in ``mine``."""

    mine: Block
    askers: np.ndarray
    first: np.ndarray
    count: np.ndarray
    other: np.ndarray
    sizes: np.ndarray
    cuts: np.ndarray

    @classmethod
    def of(cls, mine: Block, blocks: Iterator[Block], k: int, groups: int) -> _Near:
        """cuts: where one group of askers ends and the next begins; their neighbours have about as many entries."""
        seen: list[tuple[np.ndarray, np.ndarray]] = []

        def noted() -> Iterator[Block]:
            for block in blocks:
                seen.append((block.users, block.sizes))
                yield block

        user, other, _ = _met(mine, noted(), k, "jaccard", 9, None, 0.0, PAIRS >> 2)
        order = np.lexsort((other, user))
        user, other = user[order], other[order]
        users, size = (np.concatenate(x) for x in zip(*seen, strict=True))
        order = np.argsort(users)
        sizes = size[order][np.searchsorted(users[order], other)]
        askers, first, count = np.unique(np.searchsorted(mine.users, user), return_index=True, return_counts=True)
        ends = np.cumsum(np.add.reduceat(sizes, first)) if len(first) else np.zeros(0, np.int64)
        inner = np.searchsorted(ends, [len(ends) and int(ends[-1]) * i // groups for i in range(1, groups)])
        return cls(mine, askers, first, count, other, sizes, np.concatenate([[0], inner, [len(askers)]]).astype(np.int64))

    def best(self, group: int, blocks: Iterator[Block], kind: type, own: float, mean: float, top: int, digits: int) -> Iterator[pa.RecordBatch]:
        """The highest items of a group of askers."""
        low, high = self.cuts[group : group + 2]
        a, b = (int(self.first[low]), int(self.first[high - 1] + self.count[high - 1])) if low < high else (0, 0)
        other, sizes = self.other[a:b], self.sizes[a:b]
        start = np.cumsum(sizes) - sizes
        item, value = np.empty(int(sizes.sum()), kind), np.empty(int(sizes.sum()))
        by_id = np.argsort(other, kind="stable")
        sought = other[by_id]
        for block in blocks:
            if not len(block.users):
                continue
            x, y = np.searchsorted(sought, block.users[0]), np.searchsorted(sought, block.users[-1], "right")
            at = np.searchsorted(block.users, sought[x:y])
            hit = block.users[at] == sought[x:y]
            at, which = at[hit], by_id[x:y][hit]
            here, there = _places(block.first()[at], block.sizes[at]), _places(start[which], block.sizes[at])
            item[there], value[there] = block.items[here], block.values[here]
        edge = np.append(0, np.append(start, len(item))[self.first[low:high] + self.count[low:high] - a])
        who, count, x = self.askers[low:high], self.count[low:high], 0
        while x < len(who):
            y = max(x + 1, int(np.searchsorted(edge, edge[x] + (PAIRS >> 3), "right")) - 1)
            part = slice(edge[x], edge[y])
            yield from _tops(self.mine, who[x:y], mean / count[x:y], np.diff(edge[x : y + 1]), item[part], value[part], own, top, digits).to_batches()
            x = y


def _tops(mine: Block, who: np.ndarray, weight: np.ndarray, sizes: np.ndarray, item: np.ndarray, value: np.ndarray, own: float, top: int, digits: int) -> pa.Table:
    """The highest items of some users of a block, from so many entries of neighbours of each, which count by a weight."""
    scale, each = float(10**digits), np.arange(len(who))
    at, asker = _places(mine.first()[who], mine.sizes[who]), np.repeat(each, mine.sizes[who])
    ours = own * mine.values[at]
    user = np.concatenate([np.repeat(each, sizes), asker])
    item, value = np.concatenate([item, mine.items[at]]), np.concatenate([value * np.repeat(weight, sizes), ours])
    order = _order(user, item)
    user, item = user[order], item[order]
    cut = np.flatnonzero((np.diff(user, prepend=-1) != 0) | (np.diff(item, prepend=item[:1]) != 0))
    user, item, value = user[cut], item[cut], np.add.reduceat(value[order], cut)
    # As many as are asked for come to the least of a user's own highest. What is less by more than the last digit isn't among them.
    order = np.lexsort((-ours, asker))
    last = order[np.arange(len(order)) - np.repeat(np.cumsum(mine.sizes[who]) - mine.sizes[who], mine.sizes[who]) == top - 1]
    least = np.full(len(who), -np.inf)
    least[asker[last]] = ours[last] - 2 / scale
    least[least <= 0] = -np.inf
    keep = np.flatnonzero(value >= least[user])
    keep = keep[np.lexsort((item[keep], -np.floor(value[keep] * scale + 0.3), user[keep]))]
    _, first, n = np.unique(user[keep], return_index=True, return_counts=True)
    rank = np.arange(len(keep)) - np.repeat(first, n) + 1
    keep, rank = keep[rank <= top], rank[rank <= top]
    return pa.table([pa.array(mine.users[who[user[keep]]]), pa.array(item[keep], pa.int64(), mask=item[keep] == NONE), pa.array(rank.astype(np.int32))], schema=TOP)


def _ranged(rows: list[tuple]) -> pa.Table:
    return _table([r[:-1] for r in rows]).append_column("asks", pa.array([r[-1] for r in rows], pa.binary()))


def _recommended(all_: Block, asks: np.ndarray, k: int, own: float, mean: float, top: int, digits: int) -> pa.Table:
    """The highest items of the users who ask, of a block with all who share an item with one of them, in the order of ids."""
    names, item = np.unique(all_.items, return_inverse=True)
    first, sizes, n_users = all_.first(), all_.sizes, len(all_.users)
    user = np.repeat(np.arange(n_users), sizes)
    met = np.argsort(item, kind="stable")
    having = user[met]
    count = np.bincount(item, minlength=len(names))
    start = np.cumsum(count) - count
    count[names == NONE] = 0  # meets nothing
    weight = np.where(asks, np.bincount(user, weights=count[item], minlength=n_users), 0).astype(np.int64)
    asking = np.flatnonzero(asks)
    ends = np.cumsum(weight[asking])
    scale, out, low = float(10**digits), [], 0
    while low < len(asking):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + (PAIRS >> 3), "right")))
        mine = asking[low:high]
        entry = _places(first[mine], sizes[mine])
        times = count[item[entry]]
        key = np.repeat(np.repeat(np.arange(len(mine)), sizes[mine]), times) * np.int64(n_users) + having[_places(start[item[entry]], times)]
        key.sort()
        cut = np.flatnonzero(np.diff(key, prepend=-1))
        shared = np.diff(np.append(cut, len(key))).astype(np.float64)
        asker, other = np.divmod(key[cut], n_users)
        apart = mine[asker] != other
        asker, other, shared = asker[apart], other[apart], shared[apart]
        score = shared / (all_.totals[mine[asker]] + all_.totals[other] - shared)
        edge = np.searchsorted(asker, np.arange(len(mine) + 1))
        for i, u in enumerate(mine.tolist()):
            a, b = edge[i], edge[i + 1]
            if a == b:
                continue
            near = other[a:b]
            if b - a > k:
                near = near[_highest(score[a:b], k)]
            at = _places(first[near], sizes[near])
            ours = slice(first[u], first[u] + sizes[u])
            found, value = _summed(item[at], all_.values[at], item[ours], all_.values[ours], len(names), mean / len(near), own, top, scale)
            place = np.floor(value * scale + 0.3)
            best = np.lexsort((found, -place))[:top]
            out.append((u, found[best]))
        low = high
    if not out:
        return TOP.empty_table()
    n = np.array([len(x) for _, x in out])
    users = np.repeat(all_.users[[u for u, _ in out]], n)
    found = names[np.concatenate([x for _, x in out])]
    return pa.table([pa.array(users), pa.array(found, mask=found == NONE), pa.array((_places(np.zeros(len(n), np.int64), n) + 1).astype(np.int32))], schema=TOP)


def _highest(score: np.ndarray, k: int) -> np.ndarray:
    """A mask of the k highest; of those that are the same, the first."""
    least = np.partition(score, len(score) - k)[len(score) - k]
    keep = score > least
    same = np.flatnonzero(score == least)
    keep[same[: k - int(np.count_nonzero(keep))]] = True
    return keep


def _summed(item: np.ndarray, value: np.ndarray, mine: np.ndarray, own_value: np.ndarray, n_items: int, mean: float, own: float, top: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Items and their sums; those that can't be among the highest may be left out."""
    if n_items > DENSE:
        found, at = np.unique(np.concatenate([item, mine]), return_inverse=True)
        return found, np.bincount(at, weights=np.concatenate([mean * value, own * own_value]), minlength=len(found))
    total = np.bincount(item, weights=value, minlength=n_items)
    total *= mean
    total[mine] += own * own_value  # an item is there once
    # As many as are asked for come to this at least. What is less by more than the last digit isn't among the highest.
    if len(mine) >= top:
        least = np.partition(total[mine], len(mine) - top)[len(mine) - top] - 2 / scale
        if least > 0:
            found = np.flatnonzero(total >= least)
            return found, total[found]
    found = np.unique(np.concatenate([item, mine]))
    return found, total[found]
