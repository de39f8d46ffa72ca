"""Byte-pair vocabularies as automata: what ends where, and which tokens may stand side by side.

The encoding of a text by merges is the one token sequence in which every token is its own encoding and every two
neighbours are compatible: no merge across their border comes before those that build them. So the last token of
each prefix is unique, and is found from the tokens that the prefix ends with.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: White_Space of the Unicode standard.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters that an apostrophe takes along, as the vocabularies' patterns have them.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

# Classes of characters, and states of the splitter.
OTHER, LETTER, ONE, R, V, L, E, NUMBER, SPACE, BLANK, QUOTE, END = range(12)
(START, IN_LETTERS, IN_NUMBER, IN_OTHER, AFTER_SPACE, AFTER_BLANK, SPACES, BLANKS, AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L) = range(12)
LETTERS = (LETTER, ONE, R, V, L, E)


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of every code point; one more stands for the end of a text."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)] + [END], np.uint8)
    out[WHITE] = BLANK
    out[32], out[39] = SPACE, QUOTE
    for c, kind in zip("stmdrvle", (ONE, ONE, ONE, ONE, R, V, L, E), strict=True):
        out[ord(c)] = kind
    return out


@lru_cache(2)
def splitter(joined: bool) -> tuple[np.ndarray, np.ndarray]:
    """Transitions state x class -> state, and which places they show to begin a piece: 1 here, 2 one before.

    ``joined``: runs of blanks are pieces, whose last one goes to what follows if it is a space; numbers run on.
    Otherwise blanks part pieces and each number character is one.
    """
    to, begins = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)
    for state in range(12):
        for kind in range(12):
            back = 0
            s = state
            if s in (QUOTE_R, QUOTE_V, QUOTE_L):  # a quote, then a letter that may end there
                if (s, kind) in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
                    to[state, kind] = START
                    continue
                back, s = 2, IN_LETTERS
            elif s in (SPACES, BLANKS) and kind not in (SPACE, BLANK, END):
                back, s = 2, AFTER_SPACE if s == SPACES else AFTER_BLANK
            if kind == END:
                to[state, kind], begins[state, kind] = START, back | 1
            elif kind in (SPACE, BLANK):
                run = s in (AFTER_SPACE, AFTER_BLANK, SPACES, BLANKS)
                to[state, kind] = START if not joined else (SPACES if kind == SPACE else BLANKS) if run else (AFTER_SPACE if kind == SPACE else AFTER_BLANK)
                begins[state, kind] = back | (not (joined and run))
            elif s == AFTER_SPACE:
                to[state, kind] = IN_LETTERS if kind in LETTERS else IN_NUMBER if kind == NUMBER else IN_OTHER
                begins[state, kind] = back
            elif s == AT_QUOTE and kind == ONE:
                to[state, kind] = START
            elif s == AT_QUOTE and kind in (R, V, L):
                to[state, kind] = {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[kind]
            elif kind in LETTERS:
                to[state, kind], begins[state, kind] = IN_LETTERS, back | (s != IN_LETTERS)
            elif kind == NUMBER:
                to[state, kind], begins[state, kind] = IN_NUMBER, back | (s != IN_NUMBER or not joined)
            elif s in (IN_OTHER, AT_QUOTE):
                to[state, kind], begins[state, kind] = IN_OTHER, back
            else:
                to[state, kind], begins[state, kind] = AT_QUOTE if kind == QUOTE else IN_OTHER, back | 1
    return to, begins


#: Characters of one chunk, and steps after which maps that have become constant are told apart.
CHUNK, LOOK = 512, 16


def pieces(kinds: np.ndarray, joined: bool) -> np.ndarray:
    """The places where pieces, blanks between them and ends begin, in a stream of character classes.

    Each chunk's map from entering to leaving state is found for all chunks at once (a map that has become constant
    goes on as one state); the maps compose by a parallel prefix scan, which gives every chunk's entering state;
    then all chunks run once more from there.
    """
    to, begins = splitter(joined)
    n = -(-len(kinds) // CHUNK)
    grid = np.full((n, CHUNK), END, np.uint8)
    grid.reshape(-1)[: len(kinds)] = kinds
    steps = np.ascontiguousarray(grid.T)
    flat = to.reshape(-1)
    maps = np.tile(np.arange(12, dtype=np.uint8), (n, 1))
    varied, fixed, state = np.arange(n), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    for at in range(0, CHUNK, LOOK):
        open_ = maps[varied]
        for row in steps[at : at + LOOK]:
            open_ = flat[open_ * np.uint8(12) + row[varied, None]]
            state = flat[state * np.uint8(12) + row[fixed]]
        done = (open_ == open_[:, :1]).all(1)
        maps[varied] = open_
        fixed, state = np.concatenate([fixed, varied[done]]), np.concatenate([state, open_[done, 0]])
        varied = varied[~done]
    maps[fixed] = state[:, None]
    gap = 1
    while gap < n:  # maps[i] covers the chunks up to i
        maps = np.concatenate([maps[:gap], np.take_along_axis(maps[gap:], maps[:-gap].astype(np.int64), 1)])
        gap *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)
    shown, out = begins.reshape(-1), np.empty((CHUNK, n), np.uint8)
    for k, row in enumerate(steps):
        at = state * np.uint8(12) + row
        out[k] = shown[at]
        state = flat[at]
    flags = out.T.reshape(-1)[: len(kinds)]
    here = (flags & 1).astype(bool)
    here[:-1] |= (flags[1:] & 2).astype(bool)
    return np.flatnonzero(here)


#: The parts of tokenizer files that are understood here; all else is refused.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
LOWERING = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDS = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
NO = 1 << 60


def _checked(spec: dict) -> bool:
    """Whether blanks belong to the pieces. Raises ValueError for what this module would encode otherwise than the file says."""
    model = spec["model"]
    wrong = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += [x["content"] for x in spec["added_tokens"] if x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] or not x["special"]]
    kinds = {True: (None, BYTE_LEVEL | {"use_regex": True}), False: (LOWERING, {"type": "Sequence", "pretokenizers": [WORDS, BYTE_LEVEL | {"use_regex": False}]})}
    joined = [k for k, x in kinds.items() if x == (spec["normalizer"], spec["pre_tokenizer"])]
    if model["type"] != "BPE" or wrong or not joined:
        raise ValueError(f"not a byte-pair vocabulary of a known kind: {wrong or 'normalizer or pre-tokenizer'}")
    return joined[0]


def letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted({*range(256)} - {*plain})
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Vocabulary:
    """Merges of a tokenizer file, over symbols: bytes, and 256 more for bytes that end a word, if it has such.

    Everything lies in flat arrays and dictionaries of numbers, some ten megabytes, as each worker holds its own.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.joined = _checked(spec)
        model = spec["model"]
        suffix, ids, letter = model.get("end_of_word_suffix") or "", model["vocab"], letters()
        self.suffix = bool(suffix)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.base = array("i", [ids.get(letter[b], -1) for b in range(256)] + [ids.get(letter[b] + suffix, -1) if suffix else -1 for b in range(256)])
        top = 1 + max([*ids.values(), *self.special.values()])
        self.rank: dict[int, int] = {}  # two tokens -> order of their merge and the token that it gives
        self.left, self.right, self.order, self.length = (array("i", [-1]) * top for _ in range(4))
        symbols: dict[int, tuple[int, ...]] = {t: (s,) for s, t in enumerate(self.base) if t >= 0}
        for k, (a, b) in enumerate(model["merges"]):
            x, y, z = ids[a], ids[b], ids[a + b]
            self.rank.setdefault(x << 20 | y, k << 20 | z)
            if self.left[z] < 0:
                self.left[z], self.right[z], self.order[z] = x, y, k
                symbols.setdefault(z, symbols[x] + symbols[y])  # merges stand after those of their parts
        self._automaton(symbols)
        self._own, self._fit = bytearray(top), {}

    def _automaton(self, symbols: dict[int, tuple[int, ...]]) -> None:
        """Goto, longest proper suffix, and the longest token that ends at each node or at a suffix of it."""
        self.next: dict[int, int] = {}
        self.ends, self.depth, parent = array("i", [-1]), array("i", [0]), array("i", [0])
        for t, word in symbols.items():
            self.length[t] = len(word)
            at = 0
            for s in word:
                to = self.next.get(at << 9 | s)
                if to is None:
                    to = self.next[at << 9 | s] = len(self.ends)
                    self.ends.append(-1)
                    self.depth.append(self.depth[at] + 1)
                    parent.append(at)
                at = to
            self.ends[at] = t
        n = len(self.ends)
        self.fail, self.found, self.more = array("i", [0]) * n, array("i", [0]) * n, bytearray(n)
        symbol = array("h", [0]) * n
        for key, to in self.next.items():
            symbol[to], self.more[key >> 9] = key & 511, 1
        for at in sorted(range(1, n), key=self.depth.__getitem__):
            if self.depth[at] > 1:
                self.fail[at] = self.step(self.fail[parent[at]], symbol[at])
            self.found[at] = at if self.ends[at] >= 0 else self.found[self.fail[at]]

    def step(self, node: int, symbol: int) -> int:
        to = self.next.get(node << 9 | symbol)
        while to is None and node:
            node = self.fail[node]
            to = self.next.get(node << 9 | symbol)
        return to or 0

    def ending(self, node: int) -> Iterator[int]:
        """The tokens that end at a node, longest first."""
        k = self.found[node]
        while k:
            yield self.ends[k]
            k = self.found[self.fail[k]]

    def _symbols(self, token: int) -> list[int]:
        return [token] if self.left[token] < 0 else self._symbols(self.left[token]) + self._symbols(self.right[token])

    def own(self, token: int) -> bool:
        """Whether merging the token's own symbols gives the token."""
        if not self._own[token]:
            seq = self._symbols(token)
            while len(seq) > 1:
                k, at = min((self.rank.get(seq[i] << 20 | seq[i + 1], NO), i) for i in range(len(seq) - 1))
                if k == NO:
                    break
                seq[at : at + 2] = [k & 0xFFFFF]
            self._own[token] = 1 + (seq == [token])
        return self._own[token] == 2

    def _edge(self, token: int, side: array) -> list[tuple[int, int]]:
        """Pieces at one edge of a token as it is built, smallest first, each with the rank of the merge that ends it."""
        out, last = [], NO
        while True:
            out.append((token, last))
            if self.left[token] < 0:
                return out[::-1]
            last, token = self.order[token], side[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether a b stays as it is: merges at the border come too late, being leftmost first among equals."""
        key = a << 20 | b
        known = self._fit.get(key)
        if known is None:
            left, right = self._edge(a, self.right), self._edge(b, self.left)
            i = j = 0
            known = True
            while True:
                (x, until_x), (y, until_y) = left[i], right[j]
                k = self.rank.get(x << 20 | y, NO)
                k = k >> 20 if k < NO else NO
                if k < until_x and k <= until_y and k < NO:
                    known = False
                    break
                if until_x == until_y == NO:
                    break
                if until_x <= until_y:
                    i += 1
                else:
                    j += 1
            if len(self._fit) > MOST_FITS:
                self._fit.clear()
            self._fit[key] = known
        return known

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one piece, by the unique last token of each prefix and back-pointers."""
        end = len(word)
        last, node = [-1] * (end + 1) if end < 1000 else array("i", [-1]) * (end + 1), 0
        found, ends, fail, length, goto, fits, own = self.found, self.ends, self.fail, self.length, self.next, self._fit, self._own
        for i, b in enumerate(word, 1):
            symbol = b + 256 if self.suffix and i == end else b
            node = goto.get(node << 9 | symbol) or self.step(node, symbol)
            k = found[node]
            while k:
                t = ends[k]
                before = i - length[t]
                if own[t] == 2 or not own[t] and self.own(t):
                    if not before:
                        last[i] = t
                        break
                    a = last[before]
                    if a >= 0:
                        fit = fits.get(a << 20 | t)
                        if fit or fit is None and self.compatible(a, t):
                            last[i] = t
                            break
                k = found[fail[k]]
        out, i = [], end
        while i:
            if last[i] < 0:
                raise ValueError("a byte has no token")
            out.append(last[i])
            i -= length[last[i]]
        return out[::-1]


#: Pairs of tokens whose compatibility is remembered (some 20 MB).
MOST_FITS = 150_000


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Table:
    """Numbers by keys of 0 or more, open addressing in arrays; found and added many at once."""

    def __init__(self, bits: int = 12, width: int = 2, kind: type = np.int32):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros((1 << bits, width), kind)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        slot = self._slot(keys)
        got = self.keys[slot]
        out = np.where(got == keys, slot, -1)
        left = np.flatnonzero((got != keys) & (got >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            got = self.keys[slot]
            hit = got == keys[left]
            out[left[hit]] = slot[hit]
            go = ~hit & (got >= 0)
            left, slot = left[go], slot[go]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self.__init__(int(np.ceil(np.log2(4 * len(keys)))), self.values.shape[1], self.values.dtype)
        self.n += len(keys)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            s = slot[left]
            free = self.keys[s] < 0
            self.keys[s[free]] = keys[left[free]]  # of several keys for one slot, the last stays
            mine = self.keys[s] == keys[left]
            self.values[s[mine]] = values[left[mine]]
            left = left[~mine]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)


class Counter:
    """A deterministic transducer over bytes whose transitions carry the change in the number of tokens.

    A state is an automaton node with, for each suffix that some token may still complete, the last token before
    it and the tokens since. States and transitions are compiled as texts ask for them, and forgotten beyond a bound.
    """

    #: Bytes of a chunk; bytes whose chunks are run at once, within which no state is forgotten.
    CHUNK, AT_ONCE = 64, 1 << 18
    #: Node, then bytes since, last token and tokens since, for each suffix; packed, as there are many.
    FIRST = array("i", [0, 0, -1, 0]).tobytes()

    def __init__(self, vocab: Vocabulary, most: int = 200_000):
        self.vocab, self.most = vocab, most
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.states: list[bytes] = []
        self.moves = Table()
        self._state(self.FIRST)

    def _state(self, state: bytes) -> int:
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        return number

    def _compile(self, at: int, b: int) -> tuple[int, int]:
        v = self.vocab
        held = array("i", self.states[at])
        by = {held[k]: (held[k + 1], held[k + 2]) for k in range(1, len(held), 3)}
        node = v.step(held[0], b)
        for t in v.ending(node):
            far = v.length[t] - 1
            if far in by and (by[far][0] < 0 or v.compatible(by[far][0], t)) and v.own(t):
                delta = 1 - by[far][1]
                break
        else:
            raise ValueError("a byte has no token")
        keep, k = array("i", [node, 0, t, 0]), node
        while k:  # suffixes that a token goes on from
            far = v.depth[k]
            if far - 1 in by and v.more[k]:
                keep.extend((far, by[far - 1][0], by[far - 1][1] + delta))
            k = v.fail[k]
        return self._state(keep.tobytes()), delta

    def _walk(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaving states and tokens of the stretches, all of them a byte at a time."""
        state, total = state.astype(np.int64), np.zeros(len(start), np.int64)
        for k in range(int((end - start).max(initial=0))):
            at = np.flatnonzero(end - start > k)
            keys = state[at] << 8 | data[start[at] + k]
            slot = self.moves.find(keys)
            if (slot < 0).any():
                new = np.unique(keys[slot < 0])
                self.moves.add(new, np.array([self._compile(x >> 8, x & 255) for x in new.tolist()], np.int32))
                slot = self.moves.find(keys)
            state[at], total[at] = self.moves.values[slot, 0], total[at] + self.moves.values[slot, 1]
        return state, total

    def _maps(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and leaving states of stretches from their entering states, by chunk maps.

        A chunk's map has an entry for the state that its predecessor's last bytes lead to alone, and for every state
        that an entry of its predecessor leaves. Entries are found for all chunks at once until none is missing;
        then each leads to one of the next chunk's, and they compose by a parallel prefix scan (pointer doubling).
        """
        each = np.maximum(1, -(-(end - start) // self.CHUNK))
        first = np.cumsum(each) - each
        owner = np.repeat(np.arange(len(start)), each)
        nth = np.arange(len(owner)) - first[owner]
        lo = start[owner] + nth * self.CHUNK
        hi = np.minimum(lo + self.CHUNK, end[owner])
        last = nth == each[owner] - 1
        later = np.flatnonzero(nth > 0)
        guess, _ = self._walk(data, lo[later] - self.CHUNK // 2, lo[later], np.zeros(len(later), np.int64))
        fresh = np.unique(np.concatenate([first << 32 | enter, later << 32 | guess]))
        keys, leave, tokens = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(fresh):
            chunk = fresh >> 32
            out, n = self._walk(data, lo[chunk], hi[chunk], fresh & 0xFFFFFFFF)
            order = np.argsort(np.concatenate([keys, fresh]), kind="stable")
            keys, leave, tokens = np.concatenate([keys, fresh])[order], np.concatenate([leave, out])[order], np.concatenate([tokens, n])[order]
            want = np.unique((chunk + 1 << 32 | out)[~last[chunk]])
            fresh = want[~np.isin(want, keys)]
        chunk = keys >> 32
        onward = np.where(last[chunk], np.arange(len(keys)), np.searchsorted(keys, chunk + 1 << 32 | leave))
        tail = last[chunk]
        total, final = np.where(tail, 0, tokens), onward
        for _ in range(int(np.ceil(np.log2(each.max(initial=1)))) + 1):
            total, final = total + np.where(final == np.arange(len(final)), 0, total[final]), final[final]
        at = np.searchsorted(keys, first << 32 | enter)
        return total[at] + tokens[final[at]], leave[final[at]]

    def count_all(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of tokens of each piece data[start:end]."""
        size = end - start
        out = np.zeros(len(start), np.int64)
        wave = np.cumsum(size) // self.AT_ONCE  # pieces that are run at once
        for some in np.split(np.arange(len(start)), np.flatnonzero(np.diff(wave)) + 1):
            rest, some = some[size[some] > self.AT_ONCE], some[size[some] <= self.AT_ONCE]
            if len(self.states) > self.most:
                self._reset()
            if len(some):
                out[some], _ = self._maps(data, start[some], end[some], np.zeros(len(some), np.int64))
            for k in rest:  # one after another, a bounded stretch at a time
                state = self.FIRST
                for a in range(int(start[k]), int(end[k]), self.AT_ONCE):
                    if len(self.states) > self.most:
                        self._reset()
                    n, at = self._maps(data, np.array([a]), np.array([min(a + self.AT_ONCE, int(end[k]))]), np.array([self._state(state)]))
                    out[k], state = out[k] + n[0], self.states[at[0]]
        return out
