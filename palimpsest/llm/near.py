"""MinHash near-dedup with an LSH forest.

Texts with equal shingle sets are one class from the start. Each tree of the forest sorts the classes' signatures in an
order of components of its own; classes that agree on the first ``DEPTH`` of them are a region. A walk along each order
measures common prefixes. A class's depth in a tree is the least at which those it shares the prefix with are few: ``DEPTH``
in a sparse region, more in a dense one, and what shares a prefix of that depth is a candidate, so the neighbours of longest
common prefix are. Candidates are confirmed on full sets.

Regions with more than the neighbours of one class are crowded. There the depth leaves pairs out, so crowded regions of
more than one component are searched whole and exactly: in blocks of bounded size, classes outside the region's main
component look up the rarest of their shingles, of which any similar set must have one, and confirm what they meet. Only
links that join components leave a block, so what is written grows with the rows and not with their pairs.

Sorting is by range over all partitions, so a region of a third of all rows is spread.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import contract, named
from palimpsest.llm.rolling import Words, mix, windows
from palimpsest.llm.shared import durable, durable_and_size, map_tables, only, partitions

SHINGLE = 5
SIMILARITY = 75
COMPONENTS = 64
#: Trees, components that make a region, and components that a walk can tell. A pair at the threshold shares a region of
#: none of the 21 trees with a chance of 1 in 100,000.
TREES, DEPTH, KEY = 21, 3, 8
#: Classes besides itself that a class is compared with in a tree before its region counts as crowded.
NEIGHBOURS = 8
#: Rows and shingles of a block when a region is searched whole, at most but for one row.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20

_ORDERS = [np.concatenate([np.arange(3 * t, 3 * t + 3), np.random.default_rng(t).permutation(np.setdiff1d(np.arange(COMPONENTS), np.arange(3 * t, 3 * t + 3)))])[:KEY] for t in range(TREES)]
_SEEDS = np.random.default_rng(20).integers(1, 2**63, (2, COMPONENTS), dtype=np.uint64) | np.uint64(1)
_WIDTH = 1 + 4 * KEY
PAIR, CROWDED, EDGE = 0, 1, 2
WALKED = "kind int, a long, b long, key binary, n int"


def shingle_sets(texts: pa.ChunkedArray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; of a shorter text's words as one; none without words."""
    words = Words(texts, lower=True)
    hashes = words.hashes(11)
    grams = windows(hashes, size, 12)
    out = []
    for first, n in zip(words.first[:-1].tolist(), words.n.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(grams[first : first + n - size + 1]))
        elif n:
            out.append(windows(hashes[first : first + n], n, 12 + n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each of 64 hashes over a set, 32 bits each."""
    out = np.full(COMPONENTS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 2048):
        part = (shingles[start : start + 2048, None] ^ _SEEDS[0]) * _SEEDS[1]
        out = np.minimum(out, part.min(0))
    return (out >> np.uint64(32)).astype(np.uint32)


def linked(a: np.ndarray, b: np.ndarray, similarity: int = SIMILARITY) -> bool:
    """Whether two sets have a Jaccard similarity of at least ``similarity`` percent, in integers."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= similarity * (len(a) + len(b) - both)


def near_groups(docs: DataFrame, similarity: int = SIMILARITY, shingle: int = SHINGLE, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for all rows.

    Documents are linked whose sets of ``shingle``-word shingles, of lower-cased words, are similar by ``similarity``
    percent or more; a component is what links reach, named by its smallest doc_id, which alone is kept. A text with fewer
    words has one shingle, of all its words; a null, empty or wordless text has none, and is linked with nothing. Rows
    that repeat an id are one node and each is returned; rows without id stand alone, with a null component, and are kept.
    Texts are read whole; other columns are ignored; an empty table gives no rows.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"the forest is laid out for similarities of {SIMILARITY} percent and more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sketch(rows: pa.Table) -> pa.Table:
        sets = shingle_sets(rows["text"], shingle)
        first = np.array([int(mix(x).sum(dtype=np.uint64)) for x in sets], np.uint64).view(np.int64)
        second = np.array([int(mix(x ^ np.uint64(0xA5A5)).sum(dtype=np.uint64)) for x in sets], np.uint64).view(np.int64)
        signs = [signature(x).tobytes() if len(x) else b"" for x in sets]
        return pa.table([rows["doc_id"], pa.array([len(x) for x in sets], pa.int64()), pa.array(first), pa.array(second), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "f1", "f2", "sig"])

    sketched = durable(map_tables(docs, sketch, "doc_id long, n_shingles long, f1 long, f2 long, sig binary"))
    with_set = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = durable(with_set.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")))
    walked = _walked(classes, neighbours, similarity)
    pairs, n_pairs = durable_and_size(walked.filter(F.col("kind") == PAIR).select("a", "b").distinct())
    labels = contract(None, _links(pairs, docs, shingle, similarity)) if n_pairs else None
    crowded = walked.filter(F.col("kind") == CROWDED).select("key", F.col("a").alias("id"), "n").distinct()
    crowded, n_crowded = durable_and_size(_mixed(crowded, labels))
    if n_crowded:
        labels = contract(labels, _searched(crowded, docs, shingle, similarity))
    # Copies follow their class; ids that repeat tie their classes together.
    member = with_set.select("doc_id", "f1", "f2", "n_shingles").join(classes.select("f1", "f2", "n_shingles", F.col("id").alias("comp")), ["f1", "f2", "n_shingles"]).select("doc_id", "comp")
    member = durable(member)
    again, n_again = durable_and_size(member.groupBy("doc_id").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.collect_set("comp").alias("all")).filter("a <> b").select("a", F.explode("all").alias("b")))
    if n_again:
        labels = contract(labels, again)
    comps = named(member, "comp", labels).distinct()
    names = comps.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of = comps.join(names, "comp").select(F.col("doc_id").alias("_id"), "component_id")
    out = sketched.select("doc_id", "n_shingles").join(of, F.col("doc_id") == F.col("_id"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _forest(classes: DataFrame) -> DataFrame:
    """``key, id, n``: each class in each tree. A key is the tree's number and the first KEY components in the tree's order."""

    def grow(rows: pa.Table) -> pa.Table:
        signs = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint32).reshape(-1, COMPONENTS)
        keys = np.empty((TREES, len(signs), _WIDTH), np.uint8)
        for tree, order in enumerate(_ORDERS):
            keys[tree, :, 0] = tree
            keys[tree, :, 1:] = np.ascontiguousarray(signs[:, order].astype(">u4")).view(np.uint8)
        fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_WIDTH), TREES * len(signs), [None, pa.py_buffer(keys.tobytes())])
        n = rows["n_shingles"].to_numpy().astype(np.int32)
        return pa.table([fixed.cast(pa.binary()), pa.array(np.tile(rows["id"].to_numpy(), TREES)), pa.array(np.tile(n, TREES))], names=["key", "id", "n"])

    return map_tables(classes.select("id", "n_shingles", "sig"), grow, "key binary, id long, n int")


def _walked(classes: DataFrame, neighbours: int, similarity: int) -> DataFrame:
    """Rows of WALKED: pairs of candidates, and classes in crowded regions, whose ``key`` names tree and region."""
    rows = _forest(classes).repartitionByRange(partitions(classes.sparkSession), "key", "id").sortWithinPartitions("key", "id")
    reach = neighbours + 1

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, told, head = None, 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            if head is None or head.num_rows < reach:
                head = table.slice(0, reach) if head is None else pa.concat_tables([head, table.slice(0, reach - head.num_rows)])
            here = table if held is None else pa.concat_tables([held, table])
            # A row is told of when as many rows are known behind it as it has to look at.
            ready = max(told, here.num_rows - reach)
            yield _told(here, told, ready, neighbours, similarity)
            start = max(0, ready - 2 * reach)
            held, told = here.slice(start), ready - start
        if held is not None:
            yield _told(held, told, held.num_rows, neighbours, similarity)
            # What stands at the edges of partitions meets in one more walk: a few rows for each partition.
            edge = pa.concat_tables([head, held.slice(max(0, held.num_rows - reach))])
            yield _rows(EDGE, edge["id"].to_numpy(), None, edge["key"].to_pylist(), edge["n"].to_numpy())

    walked = durable(rows.mapInArrow(walk, WALKED))
    edges = walked.filter(F.col("kind") == EDGE).select("key", F.col("a").alias("id"), "n").distinct().coalesce(1).sortWithinPartitions("key", "id")
    inside = walked.filter(F.col("kind") != EDGE)
    return inside.unionByName(durable(edges.mapInArrow(walk, WALKED)).filter(F.col("kind") != EDGE))


def _rows(kind: int, a: np.ndarray, b: np.ndarray | None, keys: list[bytes] | None, n: np.ndarray | None) -> pa.RecordBatch:
    size = len(a)
    columns = [pa.array(np.full(size, kind, np.int32)), pa.array(a, pa.int64())]
    columns += [pa.nulls(size, pa.int64()) if b is None else pa.array(b, pa.int64())]
    columns += [pa.nulls(size, pa.binary()) if keys is None else pa.array(keys, pa.binary())]
    columns += [pa.nulls(size, pa.int32()) if n is None else pa.array(n, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["kind", "a", "b", "key", "n"])


def _told(rows: pa.Table, low: int, high: int, neighbours: int, similarity: int) -> pa.RecordBatch:
    """Candidates of which the later row is in ``low:high``, and which of these rows are in crowded regions."""
    ids, n, size = rows["id"].to_numpy(), rows["n"].to_numpy().astype(np.int64), rows.num_rows
    keys = np.frombuffer(b"".join(rows["key"].to_pylist()), np.uint8).reshape(size, _WIDTH)
    parts = np.ascontiguousarray(keys[:, 1:]).view(">u4").reshape(size, KEY)
    same = (parts[1:] == parts[:-1]) & (keys[1:, :1] == keys[:-1, :1])
    prefix = np.logical_and.accumulate(same, 1).sum(1)  # that a row has in common with the next
    common = {1: prefix}
    for step in range(2, min(neighbours + 2, size)):
        common[step] = np.minimum(common[step - 1][:-1], prefix[step - 1 :])
    depth, crowded = np.full(size, KEY + 1), np.zeros(size, bool)
    for d in range(KEY, DEPTH - 1, -1):
        run = np.ones(size, np.int64)
        for step, shared in common.items():
            run[:-step] += shared >= d
            run[step:] += shared >= d
        few = run <= neighbours + 1
        depth[few] = d
        crowded = ~few  # at last for DEPTH
    out = [(ids[:0], ids[:0])]
    for step, shared in common.items():
        if step > neighbours:
            break
        x, y, k, m = ids[:-step], ids[step:], n[:-step], n[step:]
        good = shared >= np.minimum(depth[:-step], depth[step:])
        if step == 1:
            good |= shared >= DEPTH
        good &= (x != y) & (100 * np.minimum(k, m) >= similarity * np.maximum(k, m))
        good[: max(0, low - step)] = False
        good[max(0, high - step) :] = False
        out.append((np.minimum(x, y)[good], np.maximum(x, y)[good]))
    a, b = (np.concatenate(c) for c in zip(*out, strict=True))
    at = low + np.flatnonzero(crowded[low:high])
    regions = [keys[i, : 1 + 4 * DEPTH].tobytes() for i in at.tolist()]
    both = pa.Table.from_batches([_rows(PAIR, a, b, None, None), _rows(CROWDED, ids[at], None, regions, n[at].astype(np.int32))])
    return both.combine_chunks().to_batches()[0] if both.num_rows else _rows(PAIR, ids[:0], ids[:0], None, None)


def _links(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """Those pairs ``a, b`` whose full sets are similar enough. Texts travel compressed, and are read once a batch."""

    def squeeze(rows: pa.Table) -> pa.Table:
        press = zstandard.ZstdCompressor(level=3)
        return pa.table([rows["doc_id"], pa.array([press.compress((x or "").encode()) for x in rows["text"].to_pylist()], pa.binary())], names=["id", "blob"])

    def confirm(rows: pa.Table) -> pa.Table:
        press, place = zstandard.ZstdDecompressor(), {}
        left, right = ([place.setdefault(x, len(place)) for x in rows[c].to_pylist()] for c in ("blob_a", "blob_b"))
        sets = shingle_sets(pa.chunked_array([pa.array([press.decompress(x).decode() for x in place], pa.string())]), shingle)
        good = [linked(sets[x], sets[y], similarity) for x, y in zip(left, right, strict=True)]
        return rows.select(["a", "b"]).filter(pa.array(good))

    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = durable(map_tables(only(docs, wanted), squeeze, "id long, blob binary"))
    left, right = texts.select(F.col("id").alias("a"), F.col("blob").alias("blob_a")), texts.select(F.col("id").alias("b"), F.col("blob").alias("blob_b"))
    return map_tables(pairs.join(left, "a").join(right, "b"), confirm, "a long, b long")


def _mixed(crowded: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``key, id, n, comp, main, parts, asking``: classes in crowded regions of more than one component.

    ``main`` is the component with most classes, which needn't ask; ``parts`` and ``asking`` are how many blocks the
    region's classes, and those of them that ask, are dealt to.
    """
    rows = named(crowded.withColumn("comp", F.col("id")), "comp", labels)
    shares = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    top = F.max(F.struct("rows", "shingles", "comp"))
    regions = shares.groupBy("key").agg(top.alias("top"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    regions = regions.select(
        "key", F.col("top.comp").alias("main"), blocks(F.col("rows"), F.col("shingles")).alias("parts"),
        blocks(F.col("rows") - F.col("top.rows"), F.col("shingles") - F.col("top.shingles")).alias("asking"),
    )
    return rows.join(regions, "key")


def _searched(crowded: DataFrame, docs: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """``a, b``: links that join components, of all pairs in crowded regions of which one class is outside the main component."""

    def cut(rows: pa.Table) -> pa.Table:
        return pa.table([rows["doc_id"], pa.array([x.tobytes() for x in shingle_sets(rows["text"], shingle)], pa.binary())], names=["id", "set"])

    sets = durable(map_tables(only(docs, crowded.select(F.col("id").alias("doc_id")).distinct()), cut, "id long, set binary"))
    part, turn = F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int"), F.pmod(F.xxhash64("id", F.lit("turn")), F.col("asking")).cast("int")
    known = F.transform(F.sequence(F.lit(0), F.col("asking") - 1), lambda t: F.struct(t.alias("turn"), part.alias("part"), F.lit(False).alias("asks")))
    asks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(turn.alias("turn"), p.alias("part"), F.lit(True).alias("asks")))
    dealt = crowded.withColumn("deal", F.explode(F.when(F.col("comp") == F.col("main"), known).otherwise(F.concat(known, asks))))
    dealt = dealt.select("key", "deal.*", "id", "comp").join(sets, "id")

    def search(group: pa.Table) -> pa.Table:
        a, b = meetings(group["asks"].to_numpy(zero_copy_only=False), group["id"].to_numpy(), group["comp"].to_numpy(), [np.frombuffer(x, np.uint64) for x in group["set"].to_pylist()], similarity)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.groupBy("key", "turn", "part").applyInArrow(search, "a long, b long")


def meetings(asks: np.ndarray, ids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], similarity: int) -> tuple[list[int], list[int]]:
    """Links between asking rows and the others that join what isn't one component yet; exact.

    Similar sets have so many shingles in common that one of them is among any few of the asking set that leave less
    than these: the rarest few are looked up, which in a group of edited copies are hardly anybody else's.
    """
    out_a, out_b = [], []
    rest = np.flatnonzero(~asks)
    if not len(rest):
        return out_a, out_b
    size = np.array([len(sets[i]) for i in rest.tolist()])
    first = np.concatenate([[0], np.cumsum(size)])
    values, token, count = np.unique(np.concatenate([sets[i] for i in rest.tolist()]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rest)), size)
    holders, begins = owner[np.argsort(token, kind="stable")], np.concatenate([[0], np.cumsum(count)])
    _, root = np.unique(comps, return_inverse=True)
    for at in np.flatnonzero(asks).tolist():
        mine = sets[at]
        apart = root[rest] != root[at]
        if not len(mine) or not apart.any():
            continue
        least = -(-similarity * len(mine) // 100)
        near = np.minimum(np.searchsorted(values, mine), len(values) - 1)
        near = near[values[near] == mine]
        if len(near) < least:
            continue
        absent = len(mine) - len(near)
        rarest = near[np.argsort(count[near], kind="stable")[: len(mine) - least + 1 - absent]]
        met = np.zeros(len(rest), bool)
        for t in rarest.tolist():
            met[holders[begins[t] : begins[t + 1]]] = True
        met &= apart & (100 * np.minimum(size, len(mine)) >= similarity * np.maximum(size, len(mine)))
        mark = None
        for i in np.flatnonzero(met).tolist():
            if root[rest[i]] == root[at]:
                continue  # joined meanwhile
            if mark is None:
                mark = np.zeros(len(values), bool)
                mark[near] = True
            both = int(mark[token[first[i] : first[i + 1]]].sum())
            if 100 * both >= similarity * (len(mine) + int(size[i]) - both):
                out_a.append(int(ids[at]))
                out_b.append(int(ids[rest[i]]))
                root[root == root[rest[i]]] = root[at]
    return out_a, out_b


def op8(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
