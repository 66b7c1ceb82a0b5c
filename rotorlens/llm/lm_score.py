"""Language-model scores with a hierarchical Pitman-Yor model, and a smoothed unigram base.

Tokens: words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, then one end. A token's context is the token
before it, whatever that is; before a text's first token stands an end. Every context is a restaurant. Contexts of one
kind of word (an end, ends a sentence, ends with another mark, or by length) share a parent, the seven kinds share the
root, and the root has a uniform base of all V training tokens and one unknown. A context that training texts don't
have is an empty restaurant, which gives its parent's probabilities.

Seating: a Chinese restaurant process, sampled by Gibbs sweeps. A dish (token) keeps all its tables in all
restaurants in one place: the vocabulary is dealt by hash. A sweep takes customers of every dish in every
restaurant from their tables, one after another, and seats each anew given all that stay, with the parent's
probability; tables that open or close send customers to the parent or call them back. What a sweep knows of other
dishes is the restaurants' totals of the sweep before: parts send those of their contexts to where a context's are added
up, and get the sums back, so that nobody holds all contexts. The predictive probabilities of the kept sweeps are averaged,
and their logarithm is the score.

Texts are turned into blocks of token numbers once. A block asks the vocabulary for its distinct (token,
context) pairs, with their training counts, and gets back one probability for each, so no token travels. Requests are
made from the block whenever they are sent, and parts are served some at a time, so that only their requests and
restaurants are on the way at once. Blocks' requests to a part are added up in groups before they meet, and are
answered one at a time.

Defined cases: a null or empty text is one end token; a null doc_id counts as the text '' for the
hold-out rule; rows that repeat are rows of their own; an empty table gives an empty result; no training
tokens: every token has the uniform probability; other columns are never read.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CLASSES = 7
PAIRS = CLASSES * CLASSES
#: Customers of each dish in each restaurant that a sweep seats anew, one after another.
STEPS = 4
#: Requests of a part that are added up at a time.
FAN = 64
END = b" "  # no word is a space
#: Tokens in a block, bytes of a text that are split at once, and characters of the corpus for each vocabulary part.
BLOCK = 2_000_000
SLICE = 8_000_000
PART_CHARS = 16_000_000
#: Parts that are served at a time, at least, and turns in which all are served, at most: each turn reads every block.
SERVED = 16
TURNS = 4
SEED = 7
#: Discounts and strength of root, class and context restaurants.
DISCOUNT = (0.6, 0.75, 0.85)
STRENGTH = (1.0, 5.0, 20.0)


def word_class(word: bytes) -> int:
    """1-6; 0 is an end."""
    last = word[-1]
    if last in b".!?":
        return 1
    if last < 128 and not chr(last).isalnum():
        return 2
    return 3 if len(word) <= 2 else 4 if len(word) == 3 else 5 if len(word) <= 6 else 6


def slices(text: str) -> Iterator[list[bytes]]:
    """The text's words, some million bytes at a time."""
    data = (text or "").encode()
    at = 0
    while at < len(data):
        to = min(at + SLICE, len(data))
        while to < len(data) and data[to : to + 1] not in b" \t\n\x0b\x0c\r":
            to += 1
        yield data[at:to].lower().split()
        at = to


class Block:
    """Numbers the tokens of some documents: distinct words, and for each document piece its words and what is before."""

    def __init__(self):
        self.index: defaultdict[bytes, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # row number, held out
        self.names: list[str | None] = []
        self.size = 0

    def add(self, doc: int, held: bool, name: str | None, words: list[bytes]) -> None:
        self.ids.append(np.fromiter(map(self.index.__getitem__, words), np.int32, len(words)))
        self.docs.append((doc, held))
        self.names.append(name)
        self.size += len(words)

    def closed(self, block: int, before: tuple[int, int]) -> tuple[tuple, tuple[int, int]]:
        """A row of BLOCK_SCHEMA. before: hash and kind of the token before the block's first."""
        words = list(self.index)
        hashes = _hashes(words)
        kind = np.fromiter((word_class(w) if w != END else 0 for w in words), np.uint8, len(words))
        ids = np.concatenate(self.ids)
        docs = np.array(self.docs, np.int64)
        row = (
            block, _pack(docs[:, 0], np.int64), _pack(docs[:, 1], np.uint8), _pack(np.array([len(i) for i in self.ids]), np.uint32), json.dumps(self.names).encode(),
            _pack(ids, np.uint32), np.append(hashes, np.uint64(before[0])).tobytes(), _pack(np.append(kind, np.uint8(before[1])), np.uint8),
        )
        return row, (int(hashes[ids[-1]]), int(kind[ids[-1]]))


class Pairs:
    """The tokens of a block's row as (word, context) pairs, all numbered by hash."""

    def __init__(self, r: dict, parts: int):
        self.lengths = _unpack(r["lengths"], np.uint32).astype(np.int64)
        self.held = _unpack(r["held"], np.uint8)
        ids = _unpack(r["ids"], np.uint32)
        hashes, kinds = np.frombuffer(r["hashes"], np.uint64), _unpack(r["kinds"], np.uint8)
        n, before = len(hashes) - 1, hashes[-1]  # the last one is the token before the block
        order = np.argsort(hashes[:n])
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        self.hashes, self.word = hashes[order], rank[ids]
        self.known, self.kinds = self.hashes, kinds[order]
        self.part = _part_of(self.hashes, parts)
        # A text's first token follows the end of the text before it.
        context = np.empty(len(ids), np.int64)
        context[1:] = self.word[:-1]
        context[0] = at = np.searchsorted(self.hashes, before)
        if at == n or self.hashes[at] != before:
            context[1:] += context[1:] >= at
            self.known, self.kinds = np.insert(self.known, at, before), np.insert(self.kinds, at, kinds[n])
        self.key = self.word * len(self.known) + context

    def requests(self, parts: range, counted: bool) -> Iterator[tuple]:
        """(part, a, b, c, d, e, f) for each of the parts that has words here, as _asking() has them."""
        low, high = np.searchsorted(self.part, (parts.start, parts.stop))
        key = self.key * 2 + np.repeat(self.held, self.lengths)
        if (low, high) != (0, len(self.part)):
            key = key[(self.word >= low) & (self.word < high)]
        key.sort()
        pair = key >> 1
        at = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(key) else np.zeros(0, np.int64)
        pairs, learnt = pair[at], np.concatenate(([0], np.cumsum(1 - (key & 1))))
        counts = learnt[np.append(at[1:], len(key))] - learnt[at] if len(at) else at
        word, context = pairs // len(self.known), pairs % len(self.known)
        ends = np.searchsorted(self.part[word], np.arange(parts.start, parts.stop + 1))
        for p, a, b in zip(parts, ends[:-1], ends[1:]):
            if a < b:
                asked, n = np.unique(word[a:b], return_counts=True)
                met, own = _distinct(context[a:b])
                yield p, *_asking(self.hashes[asked], n, own, counts[a:b] if counted else None, self.known[met], self.kinds[met])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the number of each key among them. Places ride in the low bits where these are free,
    as numbers are sorted faster than places."""
    bits = len(keys).bit_length()
    if not len(keys) or int(keys.max()) >> (63 - bits):
        return np.unique(keys, return_inverse=True)
    met = np.sort(keys.astype(np.int64) << bits | np.arange(len(keys)))
    place = met & ((1 << bits) - 1)
    met >>= bits
    new = np.concatenate(([True], met[1:] != met[:-1]))
    number = np.empty(len(keys), np.int64)
    number[place] = np.cumsum(new) - 1
    return met[new], number


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Parts share out the hashes in their order."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _pack(x: np.ndarray, kind) -> bytes:
    """The array's first bytes, then its second ones and so on, compressed, since high bytes hardly differ; those that are
    0 in all whole numbers are left out."""
    import zstandard

    x = np.ascontiguousarray(x, kind)
    used = x.itemsize if x.dtype.kind == "f" or not len(x) else max(1, -(-int(x.max()).bit_length() // 8))
    return bytes([used]) + zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize)[:, :used].T), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    import zstandard

    rows = np.frombuffer(zstandard.decompress(memoryview(data)[1:]), np.uint8).reshape(data[0], -1)
    x = np.zeros((rows.shape[1], np.dtype(kind).itemsize), np.uint8)
    for k, row in enumerate(rows):
        x[:, k] = row
    return x.view(kind).reshape(-1)


def _steps(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rising numbers, n[k] of each word k, as steps from one to the next of the same word."""
    steps = np.diff(x, prepend=0)
    first = (np.cumsum(n) - n)[n > 0]
    steps[first] = x[first]
    return steps


def _walked(steps: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of _steps()."""
    through = np.concatenate(([0], np.cumsum(steps.astype(np.int64))))
    return through[1:] - np.repeat(through[np.cumsum(n) - n], n)


def _hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w) for w in words), np.uint64, len(words))


class Contexts:
    """Numbers of some contexts: words by hash, from PAIRS on. The numbers before are pairs of kinds, for models that have
    such contexts; in score() every word is a context of its own and these restaurants stay empty."""

    def __init__(self, hashes: np.ndarray, kinds: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.size = hashes[order], PAIRS + len(hashes)
        #: The class of each context's word.
        self.parent = np.concatenate((np.arange(PAIRS) % CLASSES, kinds[order])).astype(np.int64)


def _asking(hashes: np.ndarray, n: np.ndarray, context: np.ndarray, counts: np.ndarray | None, known: np.ndarray, kinds: np.ndarray) -> tuple[bytes | None, ...]:
    """Hashes of words, the number of pairs of each, context and count of each pair, and hashes and kinds of the contexts.
    All but counts and kinds rise, contexts by word."""
    return _pack(hashes, np.uint64), _pack(n, np.uint32), _pack(_steps(context, n), np.uint32), None if counts is None else _pack(counts, np.uint64), _pack(known, np.uint64), _pack(kinds, np.uint8)


BLOCK_SCHEMA = "block long, docs binary, held binary, lengths binary, names binary, ids binary, hashes binary, kinds binary"
REQUEST_SCHEMA = "block long, part long, a binary, b binary, c binary, d binary, e binary, f binary"


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of blocks, from rows (doc_id as a string, held, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        block, before, row = Block(), (int(_hashes([END])[0]), 0), number
        columns = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
        for b in batches:
            for name, held, text in zip(b["doc_id"].tolist(), b["held"].tolist(), b["text"].tolist()):
                row += 1
                for words in slices(text):
                    block.add(row, held, name, words)
                    if block.size >= BLOCK:
                        made, before = block.closed(number, before)
                        yield pd.DataFrame([made], columns=columns)
                        number, block = number + 1, Block()
                block.add(row, held, name, [END])
        if block.size:
            yield pd.DataFrame([block.closed(number, before)[0]], columns=columns)

    return docs.mapInPandas(common.lean(run), BLOCK_SCHEMA)


def _turns(parts: int) -> list[range]:
    """The parts that are served at a time. More turns take less disk, but each makes the keys of all tokens anew and ends
    with idle cores, so that turns in proportion to the input would make work that grows with its square."""
    turns = max(1, min(TURNS, parts // SERVED))
    return [range(parts * k // turns, parts * (k + 1) // turns) for k in range(turns)]


def _requests(kept: DataFrame, parts: int, served: range, counted: bool) -> DataFrame:
    """The blocks' requests to the parts that are served, with training counts if counted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                rows = [(r["block"], *x) for x in Pairs(r, parts).requests(served, counted)]
                yield pd.DataFrame(rows, columns=["block", "part", *"abcdef"])

    return kept.select("block", "held", "lengths", "ids", "hashes", "kinds").mapInPandas(common.lean(run), REQUEST_SCHEMA)


# -- restaurants ---------------------------------------------------------------------------------------------
def first_seats(c: np.ndarray, others: np.ndarray, parent: np.ndarray, d: float, theta: float, rng) -> np.ndarray:
    """Tables of c customers of one dish each, for the seating that the sweeps start from.

    others: tables of other dishes in the restaurant. Past 64 customers, those that follow are seated in
    groups of an eighth of the seated, with the chance of a new table at the group's start.
    """
    t = (c > 0).astype(np.int64)
    order = np.argsort(-c, kind="stable")
    c, others, parent, tables = c[order], others[order].astype(float), parent[order], t[order]
    i = 1
    while True:
        live = int(np.searchsorted(-c, -i))  # those with more than i customers
        if not live:
            break
        step = max(1, i // 8) if i >= 64 else 1
        n = np.minimum(c[:live] - i, step)
        new = (theta + d * (others[:live] + tables[:live])) * parent[:live]
        chance = new / (new + i - d * tables[:live])
        tables[:live] += (rng.random(live) < chance) if step == 1 else rng.binomial(n, chance)
        i += step
    t[order] = tables
    return t


class Tables:
    """The tables of some dishes, each in one restaurant: c customers at t tables, whose sizes stand dish by dish."""

    def __init__(self, c: np.ndarray, t: np.ndarray, sizes: np.ndarray):
        self.c, self.t, self.sizes = c.astype(np.int64), t.astype(np.int64), sizes.astype(np.int64)

    @classmethod
    def started(cls, c: np.ndarray, t: np.ndarray, d: float, rng) -> Tables:
        """c customers at t tables: one at each, and the others by chance, as popular tables draw more."""
        owner = np.repeat(np.arange(len(t)), t)
        sizes = np.ones(len(owner), np.int64)
        spare = c - t
        if spare.any():
            draw = rng.gamma(1 - d, size=len(owner)) + 1e-12
            share = spare[owner] * draw / np.bincount(owner, draw, len(t))[owner]
            sizes += np.floor(share).astype(np.int64)
            left = c - np.bincount(owner, sizes, len(t)).astype(np.int64)
            sizes[(np.cumsum(t) - t)[t > 0]] += left[t > 0]
        return cls(c, t, sizes)

    def _sums(self, weights: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Running sum of weights, and the sum before the first and through the last table of each dish in who."""
        total = np.concatenate(([0], np.cumsum(weights)))
        end = np.cumsum(self.t)
        return total, total[(end - self.t)[who]], total[end[who]]

    def _pick(self, weights: np.ndarray, who: np.ndarray, rng) -> np.ndarray:
        total, low, high = self._sums(weights, who)
        at = np.searchsorted(total, low + rng.random(len(who)) * (high - low), "right") - 1
        end = np.cumsum(self.t)[who]
        return np.clip(at, end - self.t[who], end - 1)

    def leave(self, who: np.ndarray, rng) -> None:
        """One customer, any with the same chance, of each dish in who gets up; who names dishes once, with customers."""
        at = self._pick(self.sizes, who, rng)
        self.sizes[at] -= 1
        self.c[who] -= 1
        empty = self.sizes[at] == 0
        self.t[who[empty]] -= 1
        self.sizes = np.delete(self.sizes, at[empty])

    def enter(self, who: np.ndarray, new: np.ndarray, d: float, rng) -> None:
        """One customer of each dish in who sits down: at a table by its customers less d, or at a new one by `new`."""
        old = self.c[who] - d * self.t[who]
        opens = rng.random(len(who)) * (old + new) < new
        opens |= self.t[who] == 0
        joins = who[~opens]
        if len(joins):
            self.sizes[self._pick(self.sizes - d, joins, rng)] += 1
        fresh = who[opens]
        self.sizes = np.insert(self.sizes, np.cumsum(self.t)[fresh], 1)
        self.t[fresh] += 1
        self.c[who] += 1

    def apart(self, some: np.ndarray) -> Tables:
        """The tables of some dishes; some: true for these."""
        return Tables(self.c[some], self.t[some], self.sizes[np.repeat(some, self.t)])

    def put_back(self, some: np.ndarray, part: Tables) -> None:
        """What apart() gave, changed."""
        rest = self.sizes[np.repeat(~some, self.t)]
        self.c[some], self.t[some] = part.c, part.t
        at = np.repeat(some, self.t)
        self.sizes = np.empty(len(at), np.int64)
        self.sizes[at], self.sizes[~at] = part.sizes, rest

    def gibbs(self, totals: np.ndarray, parent: np.ndarray, d: float, theta: float, steps: int, rng) -> None:
        """steps times, a customer of every dish gets up and is seated anew. totals: tables of other dishes in the restaurant."""
        moving = self.c > 1  # a lone customer always comes back to a table of its own
        if not moving.all():
            if moving.any():
                part = self.apart(moving)
                part.gibbs(totals[moving], parent[moving], d, theta, steps, rng)
                self.put_back(moving, part)
            return
        every = np.arange(len(self.c))
        for _ in range(steps):
            self.leave(every, rng)
            self.enter(every, (theta + d * (totals + self.t)) * parent, d, rng)

    def follow(self, c: np.ndarray, totals: np.ndarray, parent: np.ndarray, d: float, theta: float, rng) -> None:
        """Customers leave or enter one by one until there are c; they are the tables of the restaurants below. Dishes that
        have theirs stand aside, as a few have far more to change than all others."""
        while 2 * np.count_nonzero(late := self.c != c) > len(c):
            if len(who := np.flatnonzero(self.c > c)):
                self.leave(who, rng)
            if len(who := np.flatnonzero(self.c < c)):
                self.enter(who, (theta + d * (totals[who] + self.t[who])) * parent[who], d, rng)
        if late.any():
            part = self.apart(late)
            part.follow(c[late], totals[late], parent[late], d, theta, rng)
            self.put_back(late, part)


class Vocabulary:
    """One part of the vocabulary: dishes, their (context, count) pairs, and tables on three levels."""

    def __init__(self, contexts: Contexts, hashes: np.ndarray, word: np.ndarray, context: np.ndarray, count: np.ndarray):
        self.contexts, self.hashes, self.word, self.context, self.count = contexts, hashes, word, context.astype(np.int64), count
        self.mid, self.mid_of = _distinct(word * CLASSES + contexts.parent[self.context])
        self.mid_word, self.mid_class = self.mid // CLASSES, self.mid % CLASSES
        # Until the first sweep, each dish has one table in each restaurant.
        one = lambda c: Tables(c, c > 0, c[c > 0])
        self.leaf = one(count)
        self.middle = one(np.bincount(self.mid_of, self.leaf.t, len(self.mid)).astype(np.int64))
        self.root = one(np.bincount(self.mid_word, self.middle.t, len(hashes)).astype(np.int64))

    def totals(self) -> np.ndarray:
        """Customers and tables of the root, the classes and the contexts, then training tokens and distinct ones."""
        at = lambda index, value, n: np.bincount(index, value, n)
        known = np.bincount(self.word, self.count, len(self.hashes))
        n = self.contexts.size
        return np.concatenate((
            [self.root.c.sum()], at(self.mid_class, self.middle.c, CLASSES), at(self.context, self.count, n),
            [self.root.t.sum()], at(self.mid_class, self.middle.t, CLASSES), at(self.context, self.leaf.t, n),
            [self.count.sum(), (known > 0).sum()],
        ))

    def of_contexts(self) -> np.ndarray:
        """Where the words' customers as contexts, and then their tables, stand in the totals."""
        at = 1 + CLASSES + np.arange(PAIRS, self.contexts.size)
        return np.concatenate((at, 1 + CLASSES + self.contexts.size + at))

    def parents(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P of each dish in the root and of each (dish, class)."""
        n = 1 + CLASSES + self.contexts.size
        c, t, distinct = totals[:n], totals[n : 2 * n], totals[-1]
        (d0, d1, _), (s0, s1, _) = DISCOUNT, STRENGTH
        root = (self.root.c - d0 * self.root.t + (s0 + d0 * t[0]) / (distinct + 1)) / (s0 + c[0])
        at = 1 + self.mid_class
        return root, (self.middle.c - d1 * self.middle.t + (s1 + d1 * t[at]) * root[self.mid_word]) / (s1 + c[at])

    def probabilities(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P of each dish in the root, of each (dish, class) and of each (dish, context)."""
        root, mid = self.parents(totals)
        n = 1 + CLASSES + self.contexts.size
        d, s = DISCOUNT[2], STRENGTH[2]
        c, t = s + totals[1 + CLASSES : n], s + d * totals[n + 1 + CLASSES : 2 * n]  # of the contexts
        leaf = (self.count - d * self.leaf.t + t[self.context] * mid[self.mid_of]) / c[self.context]
        return root, mid, leaf

    def sweep(self, totals: np.ndarray, rng, first: bool = False, steps: int = STEPS) -> None:
        """One Gibbs sweep from the leaves up; the first one begins with the starting seats."""
        n = 1 + CLASSES + self.contexts.size
        t, distinct = totals[n : 2 * n], totals[-1]
        root, mid = self.parents(totals)
        (d0, d1, d2), (s0, s1, s2) = DISCOUNT, STRENGTH
        # A lone customer of a context's has a table of its own, whatever the sweep does.
        some = self.count > 1
        leaf, at = self.leaf.apart(some), self.context[some]
        others, parent = t[1 + CLASSES + at] - leaf.t, mid[self.mid_of[some]]
        if first:
            leaf = Tables.started(leaf.c, first_seats(leaf.c, others, parent, d2, s2, rng), d2, rng)
        leaf.gibbs(others, parent, d2, s2, steps, rng)
        self.leaf.put_back(some, leaf)
        base = np.full(len(self.hashes), 1 / (distinct + 1))
        above = t[1 + self.mid_class] - self.middle.t, t[0] - self.root.t
        for level, (others, parent, d, s) in enumerate(((above[0], root[self.mid_word], d1, s1), (above[1], base, d0, s0))):
            name, of, lower = (("middle", self.mid_of, self.leaf), ("root", self.mid_word, self.middle))[level]
            tables = getattr(self, name)
            c = np.bincount(of, lower.t, len(tables.c)).astype(np.int64)
            if first:
                tables = Tables.started(c, first_seats(c, others, parent, d, s, rng), d, rng)
            else:
                tables.follow(c, others, parent, d, s, rng)
            tables.gibbs(others, parent, d, s, steps, rng)
            setattr(self, name, tables)


ARRAYS = {"hashes": np.uint64, "pairs": np.uint32, "context": np.uint32, "count": np.uint64, "mean": np.float32, "known": np.uint64, "kinds": np.uint8}
LEVELS = ("leaf", "middle", "root")
#: Rows of bucket -1 are parts; in the others parts send the seats of the contexts that they met to where these are added up.
STATE_SCHEMA = "part long, bucket long, totals array<double>, " + ", ".join(f"{k} binary" for k in (*ARRAYS, *(f"{x}_{y}" for x in LEVELS for y in ("t", "sizes")), "met", "seats"))


def _state_rows(part: int, v: Vocabulary, parts: int, mean: np.ndarray | None = None, kept: dict | None = None) -> pd.DataFrame:
    """kept: the arrays of ARRAYS as they were packed before; of these, a sweep changes none but the mean."""
    if kept is None:
        n = np.bincount(v.word, minlength=len(v.hashes))
        own = {"hashes": v.hashes, "pairs": n, "context": _steps(v.context, n), "count": v.count, "mean": np.zeros(len(v.count)), "known": v.contexts.hashes, "kinds": v.contexts.parent[PAIRS:]}
        kept = {k: _pack(own[k], kind) for k, kind in ARRAYS.items()}
    arrays = kept if mean is None else kept | {"mean": _pack(mean, ARRAYS["mean"])}
    for level in LEVELS:
        tables = getattr(v, level) if level != "leaf" else v.leaf.apart(v.count > 1)
        arrays = arrays | {f"{level}_t": _pack(tables.t, np.uint64), f"{level}_sizes": _pack(tables.sizes, np.uint64)}
    totals = v.totals()
    rows = [{"part": part, "bucket": -1, "totals": np.delete(totals, v.of_contexts()).astype(float), **arrays, "met": None, "seats": None}]
    seats = totals[v.of_contexts()].reshape(2, -1)
    for k, at in _dealt(v, parts):
        rows.append({"part": part, "bucket": k, "totals": None, "met": _pack(v.contexts.hashes[at], np.uint64), "seats": _pack(seats[:, at].ravel(), np.uint64)})
    return pd.DataFrame(rows, columns=[x.split()[0] for x in STATE_SCHEMA.split(", ")]).astype({"part": np.int64, "bucket": np.int64})


def _dealt(v: Vocabulary, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that the vocabulary's contexts are dealt to, and their places."""
    bucket = (v.contexts.hashes % np.uint64(parts)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, first[1:]))


def _state_of(r: dict) -> tuple[Vocabulary, np.ndarray]:
    a = {k: _unpack(r[k], kind) for k, kind in ARRAYS.items()}
    n, count = a["pairs"].astype(np.int64), a["count"].astype(np.int64)
    v = Vocabulary(Contexts(a["known"], a["kinds"]), a["hashes"], np.repeat(np.arange(len(n)), n), _walked(a["context"], n), count)
    read = lambda c, level: Tables(c, _unpack(r[f"{level}_t"], np.uint64), _unpack(r[f"{level}_sizes"], np.uint64))
    some = count > 1
    v.leaf.put_back(some, read(count[some], "leaf"))
    v.middle = read(np.bincount(v.mid_of, v.leaf.t, len(v.mid)), "middle")
    v.root = read(np.bincount(v.mid_word, v.middle.t, len(v.hashes)), "root")
    return v, a["mean"].astype(float)


def _pairs_of(r: dict) -> tuple[np.ndarray, ...]:
    """What _asking() was given: hashes, pairs of each, context of each pair, and the contexts' hashes."""
    n = _unpack(r["b"], np.uint32).astype(np.int64)
    return _unpack(r["a"], np.uint64), n, _walked(_unpack(r["c"], np.uint32), n), _unpack(r["e"], np.uint64)


def _sum_of(requests: list[dict]) -> tuple[np.ndarray, ...]:
    """Hashes, word, context and count of the pairs of some requests to one part, and the contexts' hashes and kinds."""
    asked = [_pairs_of(r) for r in requests]
    hashes, word = np.unique(np.concatenate([x[0] for x in asked]), return_inverse=True)
    word = np.repeat(word, np.concatenate([x[1] for x in asked]))
    known, number = np.unique(np.concatenate([x[3] for x in asked]), return_inverse=True)
    kinds = np.empty(len(known), np.uint8)
    kinds[number] = np.concatenate([_unpack(r["f"], np.uint8) for r in requests])
    starts = np.cumsum([0, *[len(x[3]) for x in asked]])
    pairs, of = _distinct(word * len(known) + number[np.concatenate([x[2] + at for x, at in zip(asked, starts)])])
    count = np.bincount(of, np.concatenate([_unpack(r["d"], np.uint64) for r in requests]), len(pairs)).astype(np.int64)
    return hashes, pairs // len(known), pairs % len(known), count, known, kinds


def _opened(requests: DataFrame, blocks: int, parts: int) -> DataFrame:
    """The parts' vocabularies, from the sums of their requests, as stored rows. Sums are made in rounds of FAN, so that no task
    holds a part's requests of all blocks, however many there are. Pairs that were only asked for are there with count 0."""

    def add(key, b: pd.DataFrame) -> pd.DataFrame:
        hashes, word, *rest = _sum_of(b.to_dict("records"))
        return pd.DataFrame([(key[1], key[0], *_asking(hashes, np.bincount(word, minlength=len(hashes)), *rest))], columns=["block", "part", *"abcdef"])

    def opened(key, b: pd.DataFrame) -> pd.DataFrame:
        hashes, word, context, count, known, kinds = _sum_of(b.to_dict("records"))
        return _state_rows(int(key[0]), Vocabulary(Contexts(known, kinds), hashes, word, context + PAIRS, count), parts)

    summed, before = requests.withColumn("block", F.xxhash64("block")), []
    groups = -(-blocks // FAN)
    while groups > 1:
        grouped = summed.withColumn("block", F.pmod("block", F.lit(groups)))
        summed = common.stored(grouped.groupBy("part", "block").applyInPandas(add, REQUEST_SCHEMA), "lm-sums", before)
        before, groups = [summed], -(-groups // FAN)
    return common.stored(summed.groupBy("part").applyInPandas(opened, STATE_SCHEMA), "lm-state", before)


def _added(states: list[DataFrame]) -> tuple[DataFrame, np.ndarray]:
    """The sums of the parts' totals: rows (part, bucket, seats) with customers and tables of the part's contexts, and the
    few numbers that all parts share, added up in Spark."""
    every = reduce(DataFrame.unionByName, states)
    sums = {r["i"]: r["x"] for r in every.where("bucket = -1").select(F.posexplode("totals").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()}

    def add(key, b: pd.DataFrame) -> pd.DataFrame:
        known = [_unpack(x, np.uint64) for x in b["met"]]
        _, of = np.unique(np.concatenate(known), return_inverse=True)
        seats = np.concatenate([_unpack(x, np.uint64).reshape(2, -1) for x in b["seats"]], axis=1)
        whole = np.stack([np.bincount(of, x) for x in seats]).astype(np.int64)[:, of]
        ends = np.cumsum([len(x) for x in known])
        return pd.DataFrame({"part": b["part"], "bucket": b["bucket"], "seats": [_pack(whole[:, e - len(x) : e].ravel(), np.uint64) for x, e in zip(known, ends)]})

    sent = every.where("bucket >= 0").select("bucket", "part", "met", "seats")
    return common.stored(sent.groupBy("bucket").applyInPandas(add, "part long, bucket long, seats binary"), "lm-totals"), np.array([sums.get(i, 0.0) for i in range(2 * (1 + CLASSES + PAIRS) + 2)])


def _totals_of(v: Vocabulary, shared: np.ndarray, rows: pd.DataFrame, parts: int) -> np.ndarray:
    """All totals that a part needs, in the order of Vocabulary.totals()."""
    out = np.zeros(len(shared) + 2 * len(v.contexts.hashes))
    at = v.of_contexts()
    out[np.delete(np.arange(len(out)), at)] = shared
    seats, dealt = out[at].reshape(2, -1), dict(_dealt(v, parts))
    for k, x in zip(rows["bucket"], rows["seats"]):
        seats[:, dealt[k]] = _unpack(x, np.uint64).reshape(2, -1)
    out[at] = seats.ravel()
    return out


def _with_totals(state: DataFrame, totals: tuple[DataFrame, np.ndarray], served: range, parts: int, made, schema: str) -> DataFrame:
    """made(part, row, vocabulary, mean, totals) of every part that is served."""
    shared = totals[1]

    def run(key, held: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        r = held.iloc[0].to_dict()
        v, mean = _state_of(r)
        return made(int(key[0]), r, v, mean, _totals_of(v, shared, rows, parts))

    rows = totals[0].where(F.col("part").between(served.start, served.stop - 1))
    return state.where("bucket = -1").drop("met", "seats", "totals").groupBy("part").cogroup(rows.groupBy("part")).applyInPandas(run, schema)


def _swept(state: DataFrame, totals: tuple[DataFrame, np.ndarray], served: range, parts: int, sweep: int, keep: bool) -> DataFrame:
    """The next sweep; keep adds the current seating's predictive probabilities to the mean first."""

    def made(part: int, r: dict, v: Vocabulary, mean: np.ndarray, all_totals: np.ndarray) -> pd.DataFrame:
        mean = mean + v.probabilities(all_totals)[2] if keep else None
        v.sweep(all_totals, np.random.default_rng([SEED, sweep, part]), first=sweep == 0)
        return _state_rows(part, v, parts, mean, {k: r[k] for k in ARRAYS})

    return _with_totals(state, totals, served, parts, made, STATE_SCHEMA)


def _answered(ended: DataFrame, requests: DataFrame, parts: int) -> DataFrame:
    """(block, part, logs, known): log10 of the mean probability of each pair asked for, and the training count of each word."""

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by part, each part's end (block -1) before its requests; one request is answered at a time."""
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                hashes, n, context, own = _pairs_of(r)
                if r["block"] < 0:
                    words, contexts, keys = hashes, own, np.repeat(np.arange(len(n)), n) * len(own) + context
                    logs, known = _unpack(r["d"], np.float32), _unpack(r["f"], np.uint64)
                    continue
                word = np.searchsorted(words, hashes)
                at = np.searchsorted(keys, np.repeat(word, n) * len(contexts) + np.searchsorted(contexts, own)[context])
                out.append((r["block"], r["part"], _pack(logs[at], np.float32), _pack(known[word], np.uint64)))
            yield pd.DataFrame(out, columns=["block", "part", "logs", "known"])

    met = ended.unionByName(requests).repartition(parts, "part").sortWithinPartitions("part", "block")
    return met.mapInPandas(common.lean(answer), "block long, part long, logs binary, known binary")


def score(docs: DataFrame, burn_in: int = 2, samples: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    named = docs.select(F.col(id_col).cast("string").alias("doc_id"), (F.crc32(name) % 5 == 1).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    parts = max(8, int(chars // PART_CHARS) + 1)
    served = _turns(parts)
    kept = common.stored(blocks(named), "lm-blocks")  # numbers rows once and for all
    n_blocks = kept.count()
    states = [_opened(_requests(kept, parts, s, counted=True), n_blocks, parts) for s in served]
    totals = _added(states)
    for sweep in range(burn_in + samples):
        for k, s in enumerate(served):
            states[k] = common.stored(_swept(states[k], totals, s, parts, sweep, keep=sweep > burn_in), "lm-state", [states[k]])
        common.drop(totals[0])
        totals = _added(states)
    n, distinct = (float(x) for x in totals[1][-2:])

    def final(part: int, r: dict, v: Vocabulary, mean: np.ndarray, all_totals: np.ndarray) -> pd.DataFrame:
        # The last sweep's probabilities complete the mean.
        logs = np.log10((mean + v.probabilities(all_totals)[2]) / samples)
        learnt = np.bincount(v.word, v.count, len(v.hashes))
        context = _pack(_steps(v.context - PAIRS, np.bincount(v.word, minlength=len(v.hashes))), np.uint32)
        return pd.DataFrame([(-1, part, r["hashes"], r["pairs"], context, _pack(logs, np.float32), r["known"], _pack(learnt, np.uint64))], columns=["block", "part", *"abcdef"])

    answers = []
    for state, s in zip(states, served):
        ended = common.stored(_with_totals(state, totals, s, parts, final, REQUEST_SCHEMA), "lm-final", [state])
        answers.append(common.stored(_answered(ended, _requests(kept, parts, s, counted=False), len(s)), "lm-answers", [ended]))
    common.drop(totals[0])

    def add_up(key, body: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("part")
        r = body.iloc[0].to_dict()
        block = Pairs(r, parts)
        logs = np.concatenate([_unpack(x, np.float32) for x in got["logs"]]).astype(float)[_distinct(block.key)[1]]
        known = np.concatenate([_unpack(x, np.uint64) for x in got["known"]])[block.word]
        base = np.log10((known + 0.5) / (n + 0.5 * (distinct + 1)))
        piece = np.repeat(np.arange(len(block.lengths)), block.lengths)
        total = lambda x: np.bincount(piece, x, len(block.lengths))
        return pd.DataFrame({"doc": _unpack(r["docs"], np.int64), "doc_id": json.loads(bytes(r["names"]).decode()), "held_out": block.held == 1, "n_tokens": block.lengths, "n_known": total(known > 0).astype(np.int64), "base": total(base), "score": total(logs)})

    pieces = kept.groupBy("block").cogroup(reduce(DataFrame.unionByName, answers).groupBy("block")).applyInPandas(add_up, "doc long, doc_id string, held_out boolean, n_tokens long, n_known long, base double, score double")
    sums = pieces.groupBy("doc").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    kind = dict(docs.dtypes)[id_col]
    return sums.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
