"""Hashes of words and word shingles over whole batches of texts, without a Python loop per word.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, A-Z lower-cased. UTF-8 bytes above
0x7F never equal a separator, so bytes and code points give the same words. A word's hash takes its
bytes eight at a time through a bijective, non-linear mixer (words of up to eight bytes never
collide with others of their length); sets and lines are named by 128-bit digests.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_power = {"p": np.ones(1, U), "q": np.ones(1, U)}
INVERSE = U(pow(int(BASE), -1, 1 << 64))


def powers(n: int, which: str = "p") -> np.ndarray:
    """BASE**i (or its inverse, which='q') modulo 2**64, for i < n."""
    have = _power[which]
    base = int(BASE if which == "p" else INVERSE)
    while len(have) < n:
        have = np.concatenate([have, have * U(pow(base, len(have), 1 << 64))])
    _power[which] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: each input bit reaches each output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of values[i:j] * BASE**position, modulo 2**64."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum((values.astype(U) + U(1)) * powers(len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values in [start, end): the same for equal spans anywhere."""
    q = powers(len(sums), "q")
    return mix((sums[end] - sums[start]) * q[start] ^ ((end - start).astype(U) * U(0xD6E8FEB86659FD93)))


#: LOW_BYTES[k]: mask of the first k bytes of a little-endian chunk.
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Bytes of a word that are hashed chunk by chunk; the rest of a longer one goes through a digest.
CHUNKED = 256


def chunks(data: np.ndarray) -> np.ndarray:
    """At each byte the eight bytes from there on as one number, zeros beyond the end; a view, not a copy of each."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes in each [start, end)."""
    eight = chunks(data)
    size = end - start
    out = mix(size.astype(U) * U(0xD6E8FEB86659FD93) + BASE)
    left = np.arange(len(start))
    for done in range(0, CHUNKED, 8):
        left = left[size[left] > done]
        if not len(left):
            return out
        out[left] = mix(out[left] ^ (eight[start[left] + done] & LOW_BYTES[np.minimum(size[left] - done, 8)]))
    for i in left[size[left] > CHUNKED]:
        rest = hashlib.blake2b(data[start[i] + CHUNKED : end[i]].tobytes(), digest_size=8).digest()
        out[i] = mix(out[i : i + 1] ^ np.frombuffer(rest, U))[0]
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of each word; row is the index of its text."""
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = LOWER[data] if lower else data
    text = ~SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = text[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = False
    start = np.flatnonzero(text & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = text[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    end = np.flatnonzero(text & ~after) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return word_hash(data, start, end), row, start, end


def segments(data: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(begin, end) of consecutive parts of about `most` bytes; each ends after white space or with the text, so no word is cut."""
    out, begin = [], 0
    while begin < len(data):
        end = min(len(data), begin + most)
        if end < len(data):
            gaps = np.flatnonzero(SPACE[data[begin:end]])
            if len(gaps):
                end = begin + int(gaps[-1]) + 1
            else:  # inside a word longer than a part
                while end < len(data) and not SPACE[data[end - 1]]:
                    later = np.flatnonzero(SPACE[data[end : end + most]])
                    end = end + int(later[0]) + 1 if len(later) else min(len(data), end + most)
        out.append((begin, end))
        begin = end
    return out


def shingles(word: np.ndarray, row: np.ndarray, n: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of `size` words; a text with fewer, but some, words gives one of them all."""
    weight = powers(size + 2)[1:]
    if len(word) >= size:
        total = np.zeros(len(word) - size + 1, U)
        for k in range(size):
            total += word[k : len(word) - size + 1 + k] * weight[k]
        whole = row[: len(total)] == row[size - 1 :]
        found, owner = mix(total[whole]), row[: len(total)][whole]
    else:
        found, owner = np.zeros(0, U), np.zeros(0, np.int64)
    count = np.bincount(row, minlength=n)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        begin = np.searchsorted(row, short)
        extra = mix(np.array([(word[b : b + c] * weight[:c]).sum(dtype=U) for b, c in zip(begin, count[short], strict=True)], U) + count[short].astype(U) * U(0xA24BAED4963EE407))
        found, owner = np.concatenate([found, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
    return found, owner


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for a few hundred of them much faster than numpy's own."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def sets(found: np.ndarray, owner: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each of n texts."""
    cut = np.searchsorted(owner, np.arange(n + 1))
    return [distinct(found[cut[i] : cut[i + 1]]) for i in range(n)]


def digests(parts: list[bytes]) -> np.ndarray:
    """(n, 2) signed 64-bit halves of the 128-bit digests of byte strings; 0 is never a first half."""
    raw = b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts])
    out = np.frombuffer(raw, np.int64).reshape(-1, 2).copy()
    out[out[:, 0] == 0, 0] = 1
    return out


def names(halves: np.ndarray, clashing: np.ndarray) -> np.ndarray:
    """64-bit names of digests: the first half or, where two different digests share it (`clashing`), the second."""
    first = halves[:, 0]
    return np.where(np.isin(first, clashing), halves[:, 1], first) if len(clashing) else first


def name(values: np.ndarray, clashing: np.ndarray) -> int:
    """The 64-bit name of a set of hashes."""
    return int(names(digests([values.tobytes()]), clashing)[0])
