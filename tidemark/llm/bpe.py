"""BPE encoding and decoding by speculation: greedy longest match, pair checks, exact merging of what fails.

A sequence of tokens is what byte-pair merging makes of a word exactly when each two neighbours are
what merging makes of the two alone. So the longest known token is taken again and again, all
neighbouring pairs of a batch are checked at once with numpy, and only words with a failing pair
are merged rule by rule. Words repeat, so each task remembers the results of the latest ones.

Vocabulary files are those of the tokenizers library (byte-level BPE); the path is a parameter.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed values of the byte-level pre-tokeniser: letters and numbers up to U+024F, white space.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _pattern(letters: str, numbers: str) -> str:
    return f" ?[{letters}]+| ?[{numbers}]+|'(?:[stmd]|re|ve|ll)| ?[^{WHITE}{letters}{numbers}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


LATIN = re.compile(_pattern(LETTERS, NUMBERS))
ANY = regex.compile(_pattern(r"\p{L}", r"\p{N}"))
BEYOND = re.compile("[^\x00-ɏ]")
#: Words that a task remembers.
REMEMBERED = 250_000


def byte_names() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Tokens are handled by their place in the order of merges ("order"): bytes, then merged tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = byte_names()
        spell = lambda token: bytes(names[c] for c in token)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        made = [a + b for a, b in merges]
        base = sorted((b, c) for c, b in names.items())
        order = {c: i for i, (_, c) in enumerate(base)} | {t: 256 + i for i, t in enumerate(made)}
        if len(order) != 256 + len(made):
            raise ValueError("a token of this vocabulary has two merges")
        self.ids = np.array([vocab[c] for _, c in base] + [vocab[t] for t in made], np.uint32)
        self.spelled = [bytes([b]) for b, _ in base] + [spell(t) for t in made]
        self.known = {s: i for i, s in enumerate(self.spelled)}
        self.reach: dict[bytes, int] = {}  # the longest token with these first four bytes
        for token in self.known:
            if len(token) > 3:
                self.reach[token[:4]] = max(len(token), self.reach.get(token[:4], 0))
        self.left = np.array([*range(256), *(order[a] for a, _ in merges)], np.int64)
        self.right = np.array([*range(256), *(order[b] for _, b in merges)], np.int64)
        self.order_of_byte = np.array([order[c] for _, c in base], np.int64)
        self.rule = {(order[a], order[b]): 256 + i for i, (a, b) in enumerate(merges)}
        keys = (self.left[256:] << 20) | self.right[256:]
        by_key = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[by_key], 256 + by_key
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.bytes_of = {int(i): s for i, s in zip(self.ids, self.spelled, strict=True)} | {i: t.encode() for t, i in self.special.items()}

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of the two tokens gives just the two: no rule joins them while their merges are undone, latest first."""
        good = np.ones(len(a), bool)
        left = np.arange(len(a))
        limit = np.full(len(a), 1 << 40)
        while len(left):
            bad = self.rules(a, b) < limit
            good[left[bad]] = False
            keep = ~bad & (np.maximum(a, b) >= 256)
            left, a, b = left[keep], a[keep], b[keep]
            first = a > b
            limit = np.where(first, a, b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return good

    def greedy(self, word: bytes) -> list[int]:
        known, reach, out, i, n = self.known, self.reach, [], 0, len(word)
        while i < n:
            j = min(n, i + reach.get(word[i : i + 4], 3))
            while (token := known.get(word[i:j])) is None:
                j -= 1
            out.append(token)
            i = j
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the first rule of all that apply, leftmost first."""
        rule, part = self.rule, [self.known[word[i : i + 1]] for i in range(len(word))]
        if len(part) < 1000:
            never = 1 << 40
            rank = [rule.get(p, never) for p in zip(part, part[1:], strict=False)]
            while rank and (best := min(rank)) < never:
                i = rank.index(best)
                part[i : i + 2] = [best]
                del rank[i]
                if i:
                    rank[i - 1] = rule.get((part[i - 1], best), never)
                if i < len(rank):
                    rank[i] = rule.get((best, part[i + 1]), never)
            return part
        n = len(part)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(rule[p], i) for i in range(n - 1) if (p := (part[i], part[i + 1])) in rule]
        heapq.heapify(heap)
        while heap:
            made, i = heapq.heappop(heap)
            j = after[i] if part[i] >= 0 else n
            if j >= n or rule.get((part[i], part[j])) != made:
                continue
            part[i], part[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := (made, part[after[i]])) in rule:
                    heapq.heappush(heap, (rule[p], i))
            if before[i] >= 0 and (p := (part[before[i]], made)) in rule:
                heapq.heappush(heap, (rule[p], before[i]))
        return [p for p in part if p >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens (by order) of each pre-token."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        guess = [self.greedy(w) for w in raw]
        size = np.array([len(g) for g in guess])
        flat = np.fromiter((t for g in guess for t in g), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(guess)), size)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, index = np.unique((flat[inner] << 20) | flat[inner + 1], return_inverse=True)
        wrong = ~self.compatible(pairs >> 20, pairs & 0xFFFFF)[index]
        failed = np.unique(owner[inner[wrong]])
        short = [i for i in failed if len(raw[i]) <= 64]
        for i, tokens in zip(short, self.merged_together([raw[i] for i in short]), strict=True):
            guess[i] = tokens
        for i in failed:
            if len(raw[i]) > 64:
                guess[i] = self.merged(raw[i])
        return guess

    def rules(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What each pair is joined to, or a number above all tokens."""
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_made[at], 1 << 41)

    def merged_together(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words: in each round each word has the first of its rules applied once, leftmost."""
        if not words:
            return []
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        part = self.order_of_byte[np.frombuffer(b"".join(words), np.uint8)]
        rule = np.full(len(part), 1 << 41)
        rule[:-1] = np.where(owner[1:] == owner[:-1], self.rules(part[:-1], part[1:]), 1 << 41)
        done: list[list[int]] = [[] for _ in words]
        while len(part):
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rule, begin)
            size = np.diff(np.concatenate([begin, [len(part)]]))
            ended = best >= 1 << 41
            if ended.any():
                for k in np.flatnonzero(ended):
                    done[owner[begin[k]]] = part[begin[k] : begin[k] + size[k]].tolist()
                keep = np.repeat(~ended, size)
                part, owner, rule = part[keep], owner[keep], rule[keep]
                best, size = best[~ended], size[~ended]
                if not len(part):
                    break
                begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            hit = np.flatnonzero(rule == np.repeat(best, size))
            hit = hit[np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])]
            part[hit] = best
            keep = np.ones(len(part), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))
            part, owner, rule = part[keep], owner[keep], rule[keep]
            for i in (at, at - 1):
                i = i[(i >= 0) & (i < len(part))]
                last = np.minimum(i + 1, len(part) - 1)
                rule[i] = np.where((owner[last] == owner[i]) & (last > i), self.rules(part[i], part[last]), 1 << 41)
        return done

    def pieces(self, text: str) -> list[str]:
        return (ANY if BEYOND.search(text) else LATIN).findall(text)

    def remembering(self, render: Callable[[np.ndarray, bytes], object]) -> Callable[[list[str]], list[list]]:
        """A function from texts to the rendered pre-tokens of each; render takes the ids and bytes of a pre-token."""
        fixed = {token: render([i], token.encode()) for token, i in self.special.items()}
        pending: set[str] = set()

        class Memory(dict):
            def __missing__(self, word: str) -> None:
                pending.add(word)

        memory = Memory(fixed)
        get = memory.__getitem__

        def split(text: str) -> list[str]:
            if self.special_split is None or not self.special_split.search(text):
                return self.pieces(text)
            return [w for part in self.special_split.split(text) for w in ([part] if part in self.special else self.pieces(part))]

        def run(texts: list[str]) -> list[list]:
            parts = [split(t) for t in texts]
            out = [list(map(get, p)) for p in parts]
            if not pending:
                return out
            if len(memory) + len(pending) > REMEMBERED:
                memory.clear()
                memory.update(fixed)
                pending.update(w for p in parts for w in p if w not in fixed)
            new = list(pending)
            pending.clear()
            ids, spelled = self.id_list, self.spelled
            for w, tokens in zip(new, self.encode_words(new), strict=True):
                memory[w] = render([ids[t] for t in tokens], b"".join([spelled[t] for t in tokens]))
            return [list(map(get, p)) for p in parts]

        return run

    @property
    def id_list(self) -> list[int]:
        if not hasattr(self, "_id_list"):
            self._id_list = self.ids.tolist()
        return self._id_list

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.remembering(lambda ids, _: ids)([text])[0] for i in ids]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def text_groups(batch: pa.RecordBatch, column: int, most: int = 400_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive rows with about `most` characters; null is empty."""
    begin, held, size = 0, [], 0
    for i, x in enumerate(batch.column(column)):
        held.append(x.as_py() or "")
        size += len(held[-1])
        if size > most:
            yield begin, held
            begin, held, size = i + 1, [], 0
    if held:
        yield begin, held


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """documents -> (doc_id, n_tokens, ids_sha256, decoded_sha256), one row each.

    A null or empty text has no tokens; a null doc_id stays null. Special tokens' strings in a text become
    their ids. Repeated rows repeat; columns other than doc_id and text are ignored; an empty table gives
    no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # many small objects live long here, none in cycles
        try:
            yield from encoded(batches)
        finally:
            gc.enable()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path).remembering(lambda ids, raw: (len(ids), ",".join(map(str, ids)), raw))
        for batch in batches:
            for begin, texts in text_groups(batch, 1):
                out = []
                for entries in tokens(texts):
                    count, ids, raw = zip(*entries, strict=True) if entries else ((), (), ())
                    decoded = b"".join(raw).decode("utf-8", "replace").encode()
                    out.append((sum(count), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                n, ids, decoded = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
