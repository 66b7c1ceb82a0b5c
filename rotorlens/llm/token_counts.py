"""Edit-aware token counts with a byte-level BPE.

A text is split into pre-tokens by the vocabulary's pattern; its count is the sum of their counts. Each
document keeps a segment tree whose leaves are short runs of pre-tokens and whose nodes hold the characters
and tokens of their subtree. An edit finds its leaf from the root, splits anew only from a pre-token or two
before the edit to where the old and new splits agree again, and updates the sums on the way up.

Trees are rows that can be kept: trees() encodes every text once and gives, beside it, the lengths and counts of its
pre-tokens, and edited() takes such rows and a batch of edits and gives the rows that the next batch starts from. Only
what an edit touches is encoded after that.

Boundary context: a pre-token depends on the text from its start to one character past its end, since
the pattern looks back at nothing and ahead at one character (a run of white space gives its last character
to the word after it). So a split that starts two pre-tokens before the first touched character is the
split of the whole text, and once it stops at an old boundary past the edit, everything after is as before.

Defined cases: a null or empty text has no tokens; edits are applied in order of (seq, start, stop,
replacement), each in the coordinates of the text that the ones before it left, and are clamped to that
text; a null replacement deletes; null places are the text's start; rows that repeat are counted each on its own; an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's own pattern for pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 500_000
LEAF = 64


class Counter:
    """Counts of pre-tokens, kept in two generations."""

    def __init__(self, ranks: bytes):
        import sys

        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        # The standard library's classes are faster and differ in few characters; texts with any of those
        # take the pattern itself. [^\W\d_] stands for letters and \d for numbers.
        every = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)))
        sets = [set(m.findall(x, every)) for m, x in ((regex, r"\p{L}"), (re, r"[^\W\d_]"), (regex, r"\p{N}"), (re, r"\d"), (regex, r"\s"), (re, r"\s"))]
        self.odd = frozenset((sets[0] ^ sets[1]) | (sets[2] ^ sets[3]) | (sets[4] ^ sets[5]))
        letters = r" ?[^\W\d_]+"
        self.fast = re.compile(PATTERN.replace(r" ?\p{L}+", letters).replace(r" ?\p{N}+", r" ?\d+").replace(r" ?[^\s\p{L}\p{N}]+", r" ?(?:[^\s\w]|_)+"))
        self.cache: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        if text.isascii():
            odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        else:
            odd = not self.odd.isdisjoint(text)
        return (self.pattern if odd else self.fast).findall(text)

    def one(self, piece: str) -> int:
        n = self.older.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
        if len(self.cache) >= CACHE:
            self.cache, self.older = {}, self.cache
        if len(piece) <= 64:
            self.cache[piece] = n
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        found = list(map(self.cache.get, pieces))
        return [self.one(p) if n is None else n for p, n in zip(pieces, found)] if None in found else found


class Tree:
    """A document's segment tree: leaves of pre-tokens, and a binary heap of (characters, tokens) above them."""

    def __init__(self, counter: Counter, text: str, lengths: np.ndarray | None = None, counts: np.ndarray | None = None):
        """lengths and counts: of the text's pre-tokens, if they are known; else the text is encoded."""
        self.counter = counter
        if lengths is None:
            pieces = counter.split(text)
            counts = counter.counts(pieces)
        else:
            ends = np.cumsum(lengths).tolist()
            pieces = [text[a:b] for a, b in zip([0, *ends], ends)]
            counts = counts.tolist()
        self.leaves = [(pieces[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(pieces), LEAF)] or [([], [])]
        self.reencoded = 0
        self._build()

    def row(self) -> tuple[str, bytes, bytes]:
        """The text, and lengths and counts of its pre-tokens."""
        lengths = np.fromiter((len(p) for pieces, _ in self.leaves for p in pieces), np.uint32)
        return self.text(), lengths.tobytes(), np.fromiter((n for _, counts in self.leaves for n in counts), np.uint32).tobytes()

    def _build(self) -> None:
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (pieces, counts) in enumerate(self.leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(map(len, pieces)), sum(counts)
        for at in range(self.width - 1, 0, -1):
            self._sum(at)

    def _sum(self, at: int) -> None:
        self.chars[at] = self.chars[2 * at] + self.chars[2 * at + 1]
        self.tokens[at] = self.tokens[2 * at] + self.tokens[2 * at + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def _find(self, place: int) -> tuple[int, int, int]:
        """Leaf, pre-token within it and first character of the pre-token that holds a place (or the last one)."""
        at, begin = 1, 0
        while at < self.width:
            at *= 2
            if place - begin >= self.chars[at] and self.chars[at + 1]:
                begin += self.chars[at]
                at += 1
        leaf, k = at - self.width, 0
        pieces = self.leaves[leaf][0]
        while k + 1 < len(pieces) and place - begin >= len(pieces[k]):
            begin += len(pieces[k])
            k += 1
        return leaf, k, begin

    def _from(self, leaf: int, k: int) -> Iterator[tuple[int, int, str]]:
        while leaf < len(self.leaves):
            pieces = self.leaves[leaf][0]
            for i in range(k, len(pieces)):
                yield leaf, i, pieces[i]
            leaf, k = leaf + 1, 0

    def edit(self, start: int, stop: int, replacement: str) -> None:
        start = max(0, min(start, self.n_chars))
        stop = max(start, min(stop, self.n_chars))
        leaf, k, begin = self._find(max(0, start - 1))
        for _ in range(2):  # two pre-tokens of context before the first one touched
            if k == 0:
                back = next((j for j in range(leaf - 1, -1, -1) if self.leaves[j][0]), None)
                if back is None:
                    break
                leaf, k = back, len(self.leaves[back][0])
            k -= 1
            begin -= len(self.leaves[leaf][0][k])
        # Old pre-tokens are read on until the new split meets an old boundary past the edit.
        ahead, olds, end = self._from(leaf, k), [], begin
        need = 4
        while True:
            exhausted = True
            for at in ahead:
                olds.append(at)
                end += len(at[2])
                if end > stop:
                    need -= 1
                if need <= 0:
                    exhausted = False
                    break
            text = "".join(p for _, _, p in olds)
            new_text = text[: start - begin] + replacement + text[stop - begin :]
            pieces = self.counter.split(new_text)
            shift = len(replacement) - (stop - start)
            bounds, place = {}, begin
            for i, (_, _, p) in enumerate(olds):
                place += len(p)
                if place >= stop:
                    bounds[place + shift] = i + 1
            if exhausted:
                keep, upto = len(pieces), len(olds)
                break
            place, keep, upto = begin, None, None
            limit = begin + len(new_text)
            floor = start + len(replacement)
            for i, p in enumerate(pieces):
                place += len(p)
                # One pre-token before the end of what was read may still depend on what follows.
                if place >= floor and place in bounds and place < limit - 1 and i + 1 < len(pieces):
                    keep, upto = i + 1, bounds[place]
                    break
            if keep is not None:
                break
            need = max(8, len(olds))
        fresh = pieces[:keep]
        self.reencoded += len(fresh)
        counts = self.counter.counts(fresh)
        first, last = olds[0][:2] if olds else (leaf, k), (olds[upto - 1][0], olds[upto - 1][1] + 1) if olds and upto else (leaf, k)
        head, tail = self.leaves[first[0]], self.leaves[last[0]]
        merged = (head[0][: first[1]] + fresh + tail[0][last[1] :], head[1][: first[1]] + counts + tail[1][last[1] :])
        if first[0] == last[0] and len(merged[0]) <= 2 * LEAF:
            self.leaves[first[0]] = merged
            at = self.width + first[0]
            self.chars[at], self.tokens[at] = sum(map(len, merged[0])), sum(merged[1])
            while at > 1:
                at //= 2
                self._sum(at)
        else:  # leaves are dealt anew; their sums alone are added up again, no text is split or encoded
            self.leaves[first[0] : last[0] + 1] = [(merged[0][i : i + LEAF], merged[1][i : i + LEAF]) for i in range(0, len(merged[0]), LEAF)] or [([], [])]
            self._build()

    def text(self) -> str:
        return "".join(p for pieces, _ in self.leaves for p in pieces)


_counters: dict[int, Counter] = {}


def _counter(data) -> Counter:
    key = hash(data.value)
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(data.value)
    return _counters[key]


TREE = "text string, lengths binary, counts binary"
RESULT = "n_chars long, n_tokens long, n_edits long, n_chars_after long, n_tokens_after long, n_reencoded long"


def _mapped(rows: DataFrame, ranks_path: str, carried: list[str], taken: list[str], made: str, work) -> DataFrame:
    """carried columns of rows, whatever their types, and those of `made`, by work(counter, *taken) row by row."""
    data = rows.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())  # a vocabulary: a few MB
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}
    columns = [x.split() for x in made.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(data)
        # Some hundred texts at a time, so that what a worker holds does not follow the size of a batch.
        for b in (whole.slice(at, 500) for whole in batches for at in range(0, max(1, whole.num_rows), 500)):
            out = [work(counter, *[x.as_py() for x in row]) for row in zip(*[b.column(f"__rl_{c}") for c in taken])]
            new = [pa.array([r[i] for r in out], kinds[kind]) for i, (_, kind) in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carried], *new], [*carried, *[name for name, _ in columns]])

    schema = rows.select(*carried).schema
    for name, kind in columns:
        schema = schema.add(name, kind)
    return rows.select(*carried, *[F.col(c).alias(f"__rl_{c}") for c in taken]).mapInArrow(run, schema)


def _tree_row(counter: Counter, text: str | None) -> tuple:
    pieces = counter.split(text or "")
    return text or "", np.fromiter(map(len, pieces), np.uint32, len(pieces)).tobytes(), np.array(counter.counts(pieces), np.uint32).tobytes()


def _edited_row(counter: Counter, text: str, lengths: bytes, counts: bytes, edits: list | None, keep: bool) -> tuple:
    counts_before = np.frombuffer(counts, np.uint32)
    n = (len(text), int(counts_before.sum()))
    if not edits:
        return (*((text, lengths, counts) if keep else ()), *n, 0, *n, 0)
    tree = Tree(counter, text, np.frombuffer(lengths, np.uint32), counts_before)
    for _, start, stop, replacement in sorted((e["seq"] or 0, e["start"] or 0, e["stop"] or 0, e["replacement"] or "") for e in edits):
        tree.edit(start, stop, replacement)
    return (*(tree.row() if keep else ()), *n, len(edits), tree.n_chars, tree.n_tokens, tree.reencoded)


def trees(docs: DataFrame, ranks_path: str = RANKS_PATH, text_col: str = "text") -> DataFrame:
    """docs with text, lengths and counts: each document's pre-tokens, encoded once. A column of these names is replaced."""
    carried = [c for c in docs.columns if c not in (text_col, "text", "lengths", "counts")]
    return _mapped(docs, ranks_path, carried, [text_col], TREE, _tree_row)


def edited(rows: DataFrame, edits_col: str = "edits", ranks_path: str = RANKS_PATH, keep: bool = True) -> DataFrame:
    """Rows of trees() after a batch of edits, array<struct<seq, start, stop, replacement>>, with counts before and
    after and how many pre-tokens were encoded for it. keep: with the trees, for the next batch."""
    made = [x.split()[0] for x in f"{TREE}, {RESULT}".split(", ")]
    carried = [c for c in rows.columns if c not in (*made, edits_col)]
    work = lambda counter, *x: _edited_row(counter, *x, keep)
    return _mapped(rows, ranks_path, carried, ["text", "lengths", "counts", edits_col], f"{TREE}, {RESULT}" if keep else RESULT, work)


def counted(docs: DataFrame, edits_col: str = "edits", ranks_path: str = RANKS_PATH, text_col: str = "text") -> DataFrame:
    """edited(trees(docs)) without the trees, in one worker a task: two steps in a row would hold the vocabulary's caches twice."""
    made = [x.split()[0] for x in RESULT.split(", ")]
    carried = [c for c in docs.columns if c not in (*made, text_col, edits_col)]
    work = lambda counter, text, edits: _edited_row(counter, *_tree_row(counter, text), edits, False)
    return _mapped(docs, ranks_path, carried, [text_col, edits_col], RESULT, work)


#: What the production query takes out of texts: e-mail addresses, and runs of ten or more digits, dots and dashes.
PRIVATE = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}|\+?[0-9][0-9 .\-]{8,}[0-9]"
PLACEHOLDER = "[removed]"


def redactions(docs: DataFrame, pattern: str = PRIVATE, placeholder: str = PLACEHOLDER, text_col: str = "text") -> DataFrame:
    """docs with `edits`: one edit for each match of the pattern, last one first, so that places stay valid."""

    @F.pandas_udf("array<struct<seq:int,start:int,stop:int,replacement:string>>")
    def found(texts: pd.Series) -> pd.Series:
        made = re.compile(pattern)
        return texts.map(lambda t: [{"seq": -k, "start": m.start(), "stop": m.end(), "replacement": placeholder} for k, m in enumerate(made.finditer(t))])

    none = F.array().cast("array<struct<seq:int,start:int,stop:int,replacement:string>>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Texts without a match are told in the JVM and cross to Python as empty strings.
    hit = text.rlike(pattern)
    return docs.withColumn("edits", F.when(hit, found(F.when(hit, text).otherwise(""))).otherwise(none))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, before and after private data have been taken out by edits."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return counted(redactions(docs))
