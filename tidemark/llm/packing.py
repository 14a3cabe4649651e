"""Best-fit packing of documents into sequences of bounded length, by bin completion.

Documents longer than a sequence are cut; whole pieces fill sequences alone, and at most one
shorter piece of each document is left. Those are dealt to shards of about SHARD pieces (a hash of
the piece, so no source or length gathers in one shard) and each shard is packed by branch and
bound: take the largest piece left, go on with the least wasteful of its undominated completions
(fillings of any number of pieces, made one by one from a subset-sum table), come back for the
others, and leave a branch whose waste already rules out fewer sequences than the incumbent. The
first incumbent is best-fit decreasing. A shard costs at most its rounding, one sequence in thousands.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import byte_names, text_groups
from tidemark.llm.frames import store

#: Short pieces in a shard, and the budget of branch-and-bound steps for each of its sequences (a parameter).
SHARD, STEPS = 20_000, 4
#: Bins at the end of a branch whose completions are held, not made again when the search comes back.
OPEN, DONE = 64, object()
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


#: Fixed value: how the tokenizers library's byte-level pre-tokeniser parts a text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def tokenizer(path: str) -> tuple[tiktoken.Encoding, tuple[str, ...]]:
    """The byte-level BPE of a tokenizers file, run by tiktoken, which is five times as fast, and its special tokens.

    Both merge the pair first in the list of merges, so ids are equal where the order of ids is that of merges.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, byte = spec["model"], byte_names()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer") or made != sorted(made):
        raise ValueError(f"{path} is no plain byte-level BPE")
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), tuple(special)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each length goes into the fullest bin that has room."""
    room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for x in sorted(map(int, lengths), reverse=True):
        fit = mask >> x
        if fit:
            r = x + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, []
            bins.append(b)
        b.append(x)
        room[r - x].append(b)
        mask |= 1 << (r - x)
    return bins


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """Martello and Toth's bound: for each k, pieces over capacity - k stand alone, those from k up share what is left."""
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    many, mass = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * np.arange(capacity + 1))])
    k = np.arange(capacity // 2 + 1)
    alone = many[-1] - many[capacity - k + 1]
    half = many[capacity - k + 1] - many[capacity // 2 + 1]
    left = half * capacity - (mass[capacity - k + 1] - mass[capacity // 2 + 1])
    small = mass[capacity // 2 + 1] - mass[k]
    return int((alone + half + np.maximum(0, -(-(small - left) // capacity))).max()) if len(lengths) else 0


def completions(count: np.ndarray, room: int, common: bool) -> Iterator[tuple[int, ...] | None]:
    """Undominated fillings of `room`, of any number of pieces, least waste first; None for a dominated one.

    Of the same waste, those of the largest lengths come first or, if common, of the most frequent ones.
    Perfect pairs come before all, without the table. A filling is dominated if another piece still fits in
    its waste, or a piece of it can give way to a larger one.
    """
    have = np.flatnonzero(count[: room + 1])
    have = have[have > 0]
    if not len(have):
        yield ()
        return
    if have[-1] == room:
        yield (room,)
        return
    held = count[: room + 1].tolist()
    for a in have[have >= (room + 1) // 2][::-1].tolist():
        if held[room - a] > (2 * a == room):
            yield (a, room - a)
    sizes, full = sorted(have.tolist(), key=lambda x: (common and held[x], x)), (1 << (room + 1)) - 1
    reach = [1]  # bit s of reach[k]: the last k lengths in order have pieces that sum to s
    for x in sizes:
        sums, copies, part = reach[-1], min(held[x], room // x), 1
        while copies > 0:
            part = min(part, copies)
            sums |= sums << x * part & full
            copies, part = copies - part, 2 * part
        reach.append(sums)

    def fillings(total: int, k: int, taken: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        """All ways to make total of the last k lengths in order."""
        if not total:
            yield taken
            return
        while k and reach[k] >> total & 1:
            k -= 1
            x = sizes[k]
            for n in range(min(held[x], total // x), 0, -1):
                if reach[k] >> (total - n * x) & 1:
                    yield from fillings(total - n * x, k, taken + (x,) * n)

    def dominated(filling: tuple[int, ...], waste: int) -> bool:
        free = [x for x in sizes if held[x] > filling.count(x)]
        return any(x <= waste for x in free) or any(y < x <= y + waste for y in set(filling) for x in free)

    most = reach[-1].bit_length() - 1
    for total in range(most, -1, -1):
        for filling in fillings(total, len(sizes), ()):
            if total < room or len(filling) != 2:
                yield None if total < most and dominated(filling, room - total) else filling


def bin_completion(lengths: np.ndarray, capacity: int, steps: int = STEPS) -> list[list[int]]:
    """Bins of lengths; never more than best-fit decreasing gives.

    Where pieces are a little too long to go k to a bin, the longest are also tried on their own, so
    that the mean of the others leaves room for k.
    """
    least, best = least_bins(lengths, capacity), best_fit(lengths, capacity)
    best = search(lengths, capacity, best, steps)
    if len(best) > least:
        short = np.sort(lengths)
        k = capacity * len(short) // int(short.sum()) + 1
        n = int(np.searchsorted(np.cumsum(short) * k - capacity * np.arange(1, len(short) + 1), 0, "right")) if short[0] * k <= capacity else 0
        parts = [x for x in (short[:n], short[n:]) if len(x)]
        if len(parts) == 2:
            best = min(best, [b for x in parts for b in search(x, capacity, best_fit(x, capacity), steps)], key=len)
    return best


def search(lengths: np.ndarray, capacity: int, best: list[list[int]], steps: int) -> list[list[int]]:
    """The better of `best` and what branch and bound finds with either order of completions."""
    for common in (True, False):
        best = branch_and_bound(lengths, capacity, best, common, steps)
    return best


def branch_and_bound(lengths: np.ndarray, capacity: int, best: list[list[int]], common: bool, budget: int) -> list[list[int]]:
    least, total = least_bins(lengths, capacity), int(lengths.sum())
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    left, steps = len(lengths), budget * len(best) + 100
    path: list[list] = []  # of each bin its largest piece, its completions (None: to be made again), how many were drawn, the one taken
    waste, high = 0, capacity

    def undo() -> None:
        nonlocal left, waste
        for x in path[-1][3]:
            count[x] += 1
        left, waste = left + len(path[-1][3]), waste - (capacity - path[-1][0] - sum(path[-1][3]))

    while len(best) > least and steps > 0:
        if left == 0 and len(path) < len(best):
            best = [[p[0], *p[3]] for p in path]
        if left == 0 or waste > (len(best) - 1) * capacity - total:
            undo()
        else:
            while not count[high]:
                high -= 1
            count[high] -= 1
            left -= 1
            path.append([high, completions(count, capacity - high, common), 0, ()])
            if len(path) > OPEN:
                path[-OPEN - 1][1] = None
        while path and steps > 0:
            at = path[-1]
            if at[1] is None:
                at[1] = islice(completions(count, capacity - at[0], common), at[2], None)
            steps, at[2] = steps - 1, at[2] + 1
            chosen = next(at[1], DONE)
            if chosen is DONE:
                path.pop()
                count[at[0]] += 1
                left, high = left + 1, capacity
                if path:
                    undo()
            elif chosen is not None:
                break
        else:
            break
        for x in chosen:
            count[x] -= 1
        at[3], left, waste = chosen, left - len(chosen), waste + capacity - at[0] - sum(chosen)
    return best


def pieces(docs: DataFrame, path: str, end: int, capacity: int) -> DataFrame:
    names = [x.split(" ")[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, special = tokenizer(path)
        for batch in batches:
            for begin, texts in text_groups(batch, 1):
                rows = []
                for doc, text in zip(batch.column(0).slice(begin, len(texts)).to_pylist(), texts, strict=True):
                    plain = not any(s in text for s in special)
                    ids = np.array([*(encode.encode_ordinary(text) if plain else encode.encode(text, allowed_special="all")), end], "<u4")
                    first = (len(ids) - 1) % capacity + 1
                    at = 0
                    for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
                        rows.append((doc, k, at, stop - at, zlib.crc32(ids[at:stop].tobytes())))
                        at = stop
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 1 else pa.int64()) for i, x in enumerate(zip(*rows, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit_pack(docs: DataFrame, path: str, end: int = 2, capacity: int = 1024, steps: int = STEPS) -> DataFrame:
    """documents -> one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    path is a byte-level BPE file of the tokenizers library. A null or empty text is the end id alone.
    Rows are packed as they come: repeated rows and null ids are documents like others; pieces of equal
    length go to places in the order of doc_id, piece and ids. An empty table gives no rows. `steps` is
    the search's budget for each sequence; what it has not proved by then is the best packing found.
    """
    cut = store(pieces(docs, path, end, capacity), "pieces")
    short = cut.where(F.col("length") < capacity).count()
    shards = max(1, -(-short // SHARD))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "ids_crc32", "piece"), F.lit(shards)).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            held.setdefault(0, []).append(batch)
        if not held:
            return
        table = pa.Table.from_batches(held.pop(0))
        shard = table["shard"].to_numpy()
        for s in np.unique(shard):
            part = table.filter(pa.array(shard == s)).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
            lengths = part["length"].to_numpy()
            rest: dict[int, list[int]] = {}
            for i in range(len(lengths) - 1, -1, -1):
                rest.setdefault(int(lengths[i]), []).append(i)
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            whole = int((lengths == capacity).sum())
            sequence[:whole] = np.arange(whole)
            for k, b in enumerate(bin_completion(lengths[whole:], capacity, steps)):
                at = 0
                for x in b:
                    i = rest[x].pop()
                    sequence[i], offset[i] = whole + k, at
                    at += x
            part = part.drop_columns(["shard"]).append_column("sequence_id", pa.array(sequence + (int(s) << 40))).append_column("offset", pa.array(offset))
            yield from part.to_batches()

    return dealt.repartition(shards, "shard").mapInArrow(pack, PIECES + ", sequence_id bigint, offset bigint")
