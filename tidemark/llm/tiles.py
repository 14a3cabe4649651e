"""Exact Jaccard links inside clusters of texts, by size-banded tiles with bitmap bounds.

A cluster's members fall into size bands of ratio 1.3, so sets of Jaccard 0.8 are in the same or
neighbouring bands. A small cluster is one tile. A large one is cut: each band into cells of about CELL
members, each tile a pair of cells of the same or neighbouring bands, so that no task holds more than
two cells however many members one cluster has, and each pair meets once.

Within a tile each set has a hashed bitmap. A bit that is set in A's bitmap and clear in B's
stands for at least one member of A outside B, hence |A & B| <= |A| - popcount(A & ~B). Pairs
whose bound is too low go; the others are intersected as sorted arrays.

The first tiles that a text meets in also give its bitmap (sketch), four to eight bits a member. Later tiles
meet by these alone (near_members), and only the members that the bounds leave a partner send their texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.graph import SALTS, attach

CELL = 1024
CELL_VALUES = 1_000_000
SKETCH_BITS = 256
BAND = 1.3
TILES = "array<struct<tile: bigint, cell: int, label: bigint>>"


def parts_of(count: Column, values: Column) -> Column:
    return F.greatest(F.ceil(count / CELL), F.ceil(values / CELL_VALUES), F.lit(1)).cast("int")


def single_tiles(members: DataFrame) -> DataFrame:
    """members (cluster, node, n, ...) with n > 0 -> the same with parts (cells of the cluster) and the tile of the member's cell."""
    sized = attach(members, "cluster", ["node"], parts=parts_of(F.count("*"), F.sum("n")))
    tile = F.xxhash64("cluster", F.pmod(F.xxhash64("node"), F.col("parts")))
    return sized.withColumn("tiles", F.array(F.struct(tile.alias("tile"), F.lit(0).alias("cell"), F.col("node").alias("label"))).cast(TILES))


def pair_tiles(members: DataFrame) -> DataFrame:
    """members (cluster, node, n, label, ...) -> the same with tiles: one for a small cluster, else all pairs of cells of the same or neighbouring bands."""
    sized = attach(members, "cluster", ["node"], parts=parts_of(F.count("*"), F.sum("n")))
    whole = F.array(F.struct(F.xxhash64("cluster").alias("tile"), F.lit(0).alias("cell"), F.col("label").alias("label")))
    small = sized.where("parts = 1").drop("parts").withColumn("tiles", whole.cast(TILES))
    large = sized.where("parts > 1").drop("parts").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))).cast("int"))
    bands = large.groupBy("cluster", "band").agg(parts_of(F.count("*"), F.sum("n")).alias("k"))
    clusters = bands.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("band", "k"))).alias("ks"))
    clusters = clusters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    code = lambda band, part: band * F.lit(1_000_000) + part
    mine = code(F.col("band"), F.pmod(F.xxhash64("node"), F.element_at("ks", F.col("band"))).cast("int"))
    others = F.flatten(F.transform(F.sequence(F.col("band") - 1, F.col("band") + 1), lambda b: F.transform(F.sequence(F.lit(1), F.coalesce(F.try_element_at("ks", b), F.lit(0))), lambda s: F.when(s > 0, code(b, s - 1)))))
    tile = lambda c: F.xxhash64("cluster", F.least(c, "cell"), F.greatest(c, "cell"))
    pairs = F.transform(F.filter(others, lambda c: c.isNotNull() & (c >= 0)), lambda c: F.struct(tile(c).alias("tile"), F.col("cell").alias("cell"), F.col("label").alias("label")))
    salted = large.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    large = salted.join(clusters, ["cluster", "salt"]).withColumn("cell", mine).withColumn("tiles", pairs.cast(TILES)).drop("band", "ks", "cell", "salt")
    return small.unionByName(large)


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    marks = np.zeros((len(sets), bits), bool)
    for mark, x in zip(marks, sets, strict=True):
        mark[(x >> np.uint64(40)).astype(np.int64) & (bits - 1)] = True
    return np.packbits(marks, axis=1).view(np.uint64)


def sketch(values: np.ndarray) -> bytes:
    """Bitmap of a set for near_members: as many bits as the least power of two from SKETCH_BITS that is four times its size or more."""
    bits = SKETCH_BITS
    while bits < 4 * len(values):
        bits *= 2
    return bitmaps([values], bits).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of one width, the least of them: a bitmap's halves, laid over each other, are that of half the bits."""
    width = min(map(len, sketches))
    out = np.empty((len(sketches), width // 8), np.uint64)
    for row, x in zip(out, sketches, strict=True):
        marks = np.frombuffer(x, np.uint64)
        row[:] = marks if len(x) == width else np.bitwise_or.reduce(marks.reshape(-1, width // 8))
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    a, b = (a, b) if len(a) < len(b) else (b, a)
    return int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))


def tile_links(nodes: np.ndarray, cells: np.ndarray, label: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of the tile: (root, node) for each member that others join to a component (pairs of one label are joined already).

    A root is a member of its component; members that had a common label before may keep roots of their own.
    """
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    nodes, cells, size, sets = nodes[order], cells[order], size[order], [sets[i] for i in order]
    number: dict[int, int] = {}
    label = np.array([number.setdefault(x, len(number)) for x in label[order].tolist()])
    if len(number) < 2:
        return []
    apart = cells.min() != cells.max()
    bits = 256
    while bits < 4 * size[-1] and bits < 32_768:
        bits *= 2
    marks, pairs = bitmaps(sets, bits), []
    for i in range(len(sets) - 1):
        end = int(np.searchsorted(size, size[i] * 100 // percent, "right"))
        other = np.arange(i + 1, end)
        other = other[(label[other] != label[i]) & ((cells[other] != cells[i]) if apart else True)]
        if not len(other):
            continue
        need = percent * (size[i] + size[other])
        bound = np.empty(len(other), np.int64)
        for k in range(0, len(other), 256):
            part = marks[other[k : k + 256]]
            bound[k : k + 256] = np.minimum(size[i] - np.bitwise_count(marks[i] & ~part).sum(1, dtype=np.int64), size[other[k : k + 256]] - np.bitwise_count(part & ~marks[i]).sum(1, dtype=np.int64))
        for j in other[(100 + percent) * bound >= need]:
            if label[j] != label[i] and (100 + percent) * common(sets[i], sets[j]) >= percent * (size[i] + size[j]):
                pairs.append((i, j))
                label[label == label[j]] = label[i]
    if len(number) < len(label):  # labels given: the links themselves, which join what had labels
        return [(int(nodes[i]), int(nodes[j])) for i, j in pairs]
    root: dict[int, int] = {}
    where = [root.setdefault(x, i) for i, x in enumerate(label.tolist())]
    return [(int(nodes[r]), int(nodes[i])) for i, r in enumerate(where) if r != i]


def near_members(cells: np.ndarray, label: np.ndarray, size: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """Which members of a tile have a partner of another label (and cell, if there are two) that their sketches don't rule out."""
    order = np.argsort(size, kind="stable")
    cells, label, size = cells[order], label[order], size[order]
    near = np.zeros(len(order), bool)
    apart = cells.min() != cells.max()
    i = 0
    while i < len(order):
        step = min(64, int(np.searchsorted(size, size[i] * BAND, "right")) - i)  # of like size, so of like width
        top = int(np.searchsorted(size, size[i + step - 1] * 100 // percent, "right"))
        marks = folded([sketches[k] for k in order[i:top]])
        for k in range(step):
            end = int(np.searchsorted(size[:top], size[i + k] * 100 // percent, "right"))
            other = np.arange(i + k + 1, end)
            other = other[(label[other] != label[i + k]) & ((cells[other] != cells[i + k]) if apart else True)]
            for part in np.split(other, range(256, len(other), 256)):
                if not len(part):
                    continue
                mine, theirs = marks[k], marks[part - i]
                bound = np.minimum(size[i + k] - np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64), size[part] - np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64))
                hit = part[(100 + percent) * bound >= percent * (size[i + k] + size[part])]
                if len(hit):
                    near[i + k] = near[hit] = True
        i += step
    out = np.zeros(len(order), bool)
    out[order] = near
    return out


def by_tile(batches: Iterator[pa.RecordBatch], read: Callable[[list], Iterable]) -> Iterator[list[list]]:
    """The rows (node, cell, label, ..., read(data)) of each tile; batches have tile first and data last and come by tile and node."""
    tile, held = None, []
    for batch in batches:
        tiles, *columns, data = (x.to_pylist() for x in batch.columns)
        for t, *row in zip(tiles, *columns, read(data), strict=True):
            if t != tile:
                if held:
                    yield held
                tile, held = t, []
            if not held or held[-1][0] != row[0]:  # a text that several tasks have read
                held.append(row)
    if held:
        yield held


def links(rows: DataFrame, buckets: int, percent: int, members: Callable[[list[bytes]], Iterable[np.ndarray]], sketched: bool = False) -> DataFrame:
    """rows (tile, cell, label, node, data: members() makes sorted distinct uint64 of a batch's) -> (a, b, sketch): links that span each tile's components.

    With `sketched` there is also a row (node, set size, sketch) of each member; in links sketch is null.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        made: list[tuple[int, int, bytes]] = []
        for held in by_tile(batches, members):
            if sketched:
                made += [(node, len(x), sketch(x)) for node, *_, x in held]
            if len(held) > 1:
                found += tile_links(*(np.array([x[k] for x in held]) for k in range(3)), [x[3] for x in held], percent)
            if len(found) + len(made) > 5000:
                yield edges(found, made)
                found, made = [], []
        yield edges(found, made)

    def edges(found: list[tuple[int, int]], made: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        rows = [*((a, b, None) for a, b in found), *made]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["a", "b", "sketch"])

    return rows.select("tile", "node", "cell", "label", "data").repartition(buckets, "tile").sortWithinPartitions("tile", "node").mapInArrow(reduce, "a bigint, b bigint, sketch binary")


def near(rows: DataFrame, buckets: int, percent: int) -> DataFrame:
    """rows (tile, cell, label, node, size, sketch) -> (tile, cell, label, node) of the members that near_members() leaves.

    The new tile is a hash of what is left, so what several tiles leave alike is met once.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[int, int, int, int]] = []
        for held in by_tile(batches, lambda x: x):
            if len(held) > 1:
                nodes, cells, label, size = (np.array([x[k] for x in held]) for k in range(4))
                left = np.flatnonzero(near_members(cells, label, size, [x[4] for x in held], percent))
                name = int(W.mix(W.mix(nodes[left].view(np.uint64)) + cells[left].astype(np.uint64)).sum(dtype=np.uint64).view(np.int64))
                kept += [(name, *(int(c[i]) for c in (cells, label, nodes))) for i in left]
            if len(kept) > 50_000:
                yield batch_of(kept)
                kept = []
        yield batch_of(kept)

    def batch_of(kept: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["tile", "cell", "label", "node"])

    return rows.select("tile", "node", "cell", "label", "size", "sketch").repartition(buckets, "tile").sortWithinPartitions("tile", "node").mapInArrow(reduce, "tile bigint, cell int, label bigint, node bigint")
