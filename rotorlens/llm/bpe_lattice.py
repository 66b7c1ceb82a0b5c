"""Encoding and decoding with a SentencePiece model by a max-plus parallel scan.

The model of the vocabulary files is a byte-fallback BPE. A sequence of pieces is the encoding of its text
if and only if each two neighbours are the encoding of their own concatenation, since merges are chosen
by global priority and never reach across a final boundary. So encoding is a best path over a lattice of
pieces in which a pair of neighbours weighs 0 if compatible and minus infinity if not: a max-plus
product, and associative. A giant text is cut into chunks; each chunk, on its own, yields its transfer
between boundary states (which piece crosses the cut, and how far), the transfers of a text are combined
associatively into the state at each cut, and each chunk is then traced back on its own.

Entries that are minus infinity are left out: a transfer holds, for each entry state, its one exit state.

Inside a chunk, pieces never reach over the start of a run of spaces, so words are separate lattices whose
paths are kept in a cache. Where a vocabulary has pieces that cross words, the whole chunk is one word.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words in each of the two generations of the cache that a process keeps; twice as many pairs and word starts.
CACHE = 200_000


class Model:
    """Pieces of a .model file. Only BPE models without text normalisation are taken."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(data)
        spec, how = proto.trainer_spec, proto.normalizer_spec
        if spec.model_type != 2 or how.precompiled_charsmap or how.remove_extra_whitespaces or spec.treat_whitespace_as_suffix:
            raise ValueError("only byte-pair models with identity normalisation are supported")
        if any(p.type in (USER, UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.data = data
        self.prefix = SPACE if how.add_dummy_prefix else ""
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        if len(self.bytes) != 256:
            raise ValueError("a model without byte fallback is not supported")
        self.longest = max(map(len, self.ids), default=1)
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.words = re.compile(self._word_pattern() if self.by_word else ".+", re.S)
        #: The longest piece that ends in the two characters given; a piece of one character always may.
        self.reach: dict[str, int] = {}
        for p in self.ids:
            self.reach[p[-2:]] = max(self.reach.get(p[-2:], 0), len(p))
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.ends: dict[str, str] = {"": ""}
        #: Pieces that are their own encoding; others never stand in a path. Each maps to the one copy that the caches hold.
        self.good = {p: p for p in self.ids if len(p) == 1 or self.merged(p) == [p]}

    def _word_pattern(self) -> str:
        """Words end before a space, and also between a Latin letter and an ASCII mark, either way round, for
        all marks that stand beside no such letter in any piece."""
        pairs = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}
        latin = "A-Za-zÀ-ÿ"
        is_latin = re.compile(f"[{latin}]").match
        bound = {b if is_latin(a) else a for a, b in pairs if bool(is_latin(a)) != bool(is_latin(b))}
        marks = "".join(re.escape(chr(c)) for c in range(128) if not chr(c).isalpha() and chr(c) not in bound)
        cuts = f"{SPACE}*[{latin}]+(?=[{marks}])|{SPACE}*[{marks}]+(?=[{latin}])|" if marks else ""
        return f"{cuts}{SPACE}*[^{SPACE}]+|{SPACE}+"

    # -- the reference definition, used for pairs only -------------------------------------------------
    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best pair, leftmost first, again and again."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        """Whether two pieces may be neighbours; the lattice's weight of 0, else minus infinity."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 2 * CACHE:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    # -- lattice -----------------------------------------------------------------------------------------
    def last_pieces(self, text: str, before: str = "") -> list[str]:
        """For each place i > 0 of text, the last piece of the path that ends there; before enters at 0.

        Each prefix has one path only, so the maximum over arcs is over at most one that is not minus
        infinity, and a list of last pieces is the whole forward pass.
        """
        good, longest, known, fits = self.good.get, self.longest, self.pairs.get, self.fits
        last = [before]
        for end in range(1, len(text) + 1):
            found = None
            for start in range(end - longest if end > longest else 0, end):
                piece = text[start:end]
                piece = good(piece, piece if start == end - 1 else None)
                if piece is not None:
                    left = last[start]
                    if left is not None and (not left or (fits(left, piece) if (fit := known((left, piece))) is None else fit)):
                        found = piece
                        break
            last.append(found)
        return last

    def path(self, text: str, before: str = "") -> list[str]:
        last, out, at = self.last_pieces(text, before), [], len(text)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def ids_of(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            known = self.ids.get(p)
            if known is not None:
                out.append(known)
            else:
                out += [self.bytes[b] for b in p.encode()]
        return out

    def word_path(self, word: str) -> list[str]:
        """path() of a word; the forward pass is shared among all words with a common start."""
        ends, good, reach, known = self.ends, self.good.get, self.reach.get, self.pairs.get
        if len(word) > 64:
            return self.path(word)
        if len(ends) > 2 * CACHE:
            ends.clear()
            ends[""] = ""
        k = len(word)
        while word[:k] not in ends:
            k -= 1
        for end in range(k + 1, len(word) + 1):
            furthest = reach(word[end - 2 : end] if end > 1 else word[:1], 1)
            for start in range(end - furthest if end > furthest else 0, end):
                piece = word[start:end]
                piece = good(piece, piece if start == end - 1 else None)
                if piece is not None:
                    left = ends[word[:start]]
                    if left is not None and (not left or (self.fits(left, piece) if (fit := known((left, piece))) is None else fit)):
                        ends[word[:end]] = piece
                        break
            else:
                ends[word[:end]] = None
        out, at = [], len(word)
        while at:
            piece = ends[word[:at]]
            out.append(piece)
            at -= len(piece)
        return out[::-1]

    # -- words -------------------------------------------------------------------------------------------
    def word(self, word: str) -> bytes:
        """The ids of one word, four bytes each."""
        known = self.cache.get(word)
        if known is None:
            if len(self.cache) >= CACHE:
                self.cache, self.older = {}, self.cache
            known = self.older.get(word)
            if known is None:
                known = array("i", self.ids_of(self.word_path(word))).tobytes()
            if len(word) <= 64:
                self.cache[word] = known
        return known

    def marked(self, text: str) -> str:
        """The text as the model sees it: spaces marked, and one more in front."""
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def encode_marked(self, text: str) -> np.ndarray:
        cache = self.cache
        words = self.words.findall(text)
        found = list(map(cache.get, words))
        if None in found:
            found = [self.word(w) if f is None else f for w, f in zip(words, found)]
        return np.frombuffer(b"".join(found), np.int32)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_marked(self.marked(text))

    @property
    def raw(self) -> list[bytes]:
        """What each id stands for in a decoded text, before the first space is taken off."""
        made = self.__dict__.get("_raw")
        if made is None:
            made = [p.replace(SPACE, " ").encode() if t == NORMAL else bytes([int(p[3:5], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else b"" for p, t in zip(self.pieces, self.types)]
            self.__dict__["_raw"] = made
        return made

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    # -- chunks ------------------------------------------------------------------------------------------
    # A boundary state is (ahead, piece): the piece that ends `ahead` characters right of a cut and begins
    # left of it. (0, "") stands at the start of a text.
    def boundary_states(self, left: str, right: str) -> list[tuple[int, str]]:
        """All states that the cut between two stretches of text could have; 15 characters of each suffice."""
        if not left:
            return [(0, "")]
        out = []
        for back in range(1, min(self.longest, len(left)) + 1):
            for ahead in range(0, min(self.longest - back, len(right)) + 1):
                piece = left[-back:] + right[:ahead]
                if piece in self.good or len(piece) == 1:
                    out.append((ahead, piece))
        return out

    def word_starts(self, text: str) -> tuple[int, int]:
        """First and last place, not before `longest`, where a run of spaces starts; (-1, -1) if there is none."""
        if not self.by_word:
            return -1, -1
        starts = re.compile(f"(?<=[^{SPACE}]){SPACE}")
        first = starts.search(text, self.longest)
        if not first:
            return -1, -1
        for back in (256, 4096, len(text)):
            found = [m.start() for m in starts.finditer(text, max(self.longest, len(text) - back))]
            if found:
                return first.start(), found[-1]
        return -1, -1

    def _exits(self, last: list, text: str, exits: list) -> tuple:
        """Exit states that a path over text, whose forward pass is given, can take."""
        out = []
        for ahead, piece in exits:
            start = len(text) - (len(piece) - ahead)
            if start >= 0 and last[start] is not None and (not last[start] or self.fits(last[start], piece)):
                out.append((ahead, piece))
        return tuple(out)

    def transfer(self, left: str, chunk: str, right: str) -> dict:
        """The chunk's matrix: entry state -> exit states that it can reach at weight 0.

        Where a word starts inside the chunk the matrix is an outer product: entries must reach the first
        word start, and exits are those reachable from the last one.
        """
        entries, exits = self.boundary_states(left, chunk + right), self.boundary_states(chunk[-self.longest :], right)
        if len(chunk) < self.longest:
            exits = [x for x in self.boundary_states((left + chunk)[-self.longest :], right)]
        first, final = self.word_starts(chunk)
        if first >= 0:
            open_end = self._exits(self.last_pieces(chunk[final:]), chunk[final:], exits)
            return {s: open_end for s in entries if self.last_pieces(chunk[s[0] : first], s[1])[-1] is not None}
        out = {}
        for ahead, piece in entries:
            if ahead > len(chunk):  # the piece spans the whole chunk
                found = ((ahead - len(chunk), piece),)
            elif ahead == len(chunk):
                found = ((0, piece),)
            else:
                text = chunk[ahead:]
                found = self._exits(self.last_pieces(text, piece), text, [x for x in exits if len(x[1]) - x[0] <= len(text)])
            if found:
                out[ahead, piece] = found
        return out

    def trace(self, entry: tuple[int, str], chunk: str, right: str, leave: tuple[int, str]) -> np.ndarray:
        """Ids of the pieces that start inside the chunk, given the states at both of its ends."""
        begin = entry[0]
        if begin >= len(chunk):
            return np.zeros(0, np.int32)
        stop = len(chunk) - (len(leave[1]) - leave[0])
        first, final = self.word_starts(chunk)
        crossing = self.ids_of([leave[1]]) if stop >= begin else []
        if first < 0:
            return np.array(self.ids_of(self.path(chunk[begin : max(begin, stop)], entry[1])) + crossing, np.int32)
        head = np.array(self.ids_of(self.path(chunk[begin:first], entry[1])), np.int32)
        tail = np.array(self.ids_of(self.path(chunk[final:stop])) + crossing, np.int32)
        return np.concatenate((head, self.encode_marked(chunk[first:final]), tail))


def combine(a: dict, b: dict) -> dict:
    """The transfer over two neighbouring stretches; associative."""
    out = {}
    for s, through in a.items():
        reached = {t for m in through if m in b for t in b[m]}
        if reached:
            out[s] = tuple(sorted(reached))
    return out


def cut_states(transfers: list[dict], entry: tuple[int, str] = (0, ""), leave: tuple[int, str] | None = None) -> list[tuple[int, str]]:
    """The one state at each cut, ends included, of a stretch whose chunks have these transfers.

    entry and leave: the states at the stretch's ends; without leave, the text ends there.
    """
    reached = [{entry}]
    for t in transfers:
        reached.append({x for s in reached[-1] if s in t for x in t[s]})
    state = next(s for s in sorted(reached[-1]) if s[0] == 0) if leave is None else leave
    states = [state]
    for t, before in zip(reversed(transfers), reversed(reached[:-1])):
        state = next(s for s in sorted(before) if state in t.get(s, ()))
        states.append(state)
    return states[::-1]
