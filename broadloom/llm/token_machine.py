"""Finite-state machines that count the tokens of a byte-level BPE vocabulary.

``Splitter`` cuts text into pre-tokens with a machine over classes of code points. A stream is
dealt into chunks of equal length; each chunk's map from the state before it to the state
after it is built for all states at once, the maps are composed by a parallel prefix scan, and
then every chunk is walked from the state it is entered in, all chunks side by side.

``Machine`` is a deterministic transducer over the bytes of a pre-token. BPE's choice for a
prefix depends on later bytes, so a state holds the places of the recent past at which a token
may still begin: for each the trie node reached since, the last token before it, and how many
tokens lead there beyond those already emitted. A byte moves all of them; one token alone can
end behind it, the one that no merge across its left border would have undone. What all places
of the next state have in common is emitted with the transition, so counts of a word are the
sum of its transitions and of the last state's rest. States and transitions are compiled when
first met; a table that reaches ``most`` states is started afresh, which costs time, not
results.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

#: Classes of code points. The letters are those of the contractions 's 't 'm 'd
#: (S), 're 've (R, E) and 'll (L).
END, SPACE, BLANK, MARK, OTHER, NUMBER, LETTER, S, R, E, L = range(11)
CLASSES = 11
#: States: what the characters since the last border are.
START, WORD, DIGITS, SIGNS, ONE_SPACE, ONE_BLANK, SPACES, BLANKS, APOSTROPHE, HALF_R, HALF_L, DONE = range(12)
STATES = 12
UNKNOWN = 255
CHUNK = 64


def _split_tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, borders) by state * CLASSES + class. Borders: 1 before this character, 2
    before the one before."""
    to, cut = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)
    afresh = {SPACE: ONE_SPACE, BLANK: ONE_BLANK, MARK: APOSTROPHE, OTHER: SIGNS, NUMBER: DIGITS} | dict.fromkeys((LETTER, S, R, E, L), WORD)
    letters = (LETTER, S, R, E, L)
    for state in range(STATES):
        for c, new in afresh.items():
            to[state, c], cut[state, c] = new, 1  # unless one of the rules below holds
    for c in letters:
        to[WORD, c], cut[WORD, c] = WORD, 0
    cut[DIGITS, NUMBER] = 0
    for state in (SIGNS, APOSTROPHE):
        for c in (MARK, OTHER):
            to[state, c], cut[state, c] = SIGNS, 0
    for c, new in ((S, DONE), (R, HALF_R), (L, HALF_L)):
        to[APOSTROPHE, c], cut[APOSTROPHE, c] = new, 0
    for state, last in ((HALF_R, E), (HALF_L, L)):
        for c in range(1, CLASSES):
            cut[state, c] = 2 | (c not in letters)  # the letter after the mark begins a word
        to[state, last], cut[state, last] = DONE, 0
        cut[state, END] = 2
    for one, many in ((ONE_SPACE, SPACES), (ONE_BLANK, BLANKS)):
        for c, new in ((SPACE, SPACES), (BLANK, BLANKS)):
            to[one, c] = to[many, c] = new
            cut[one, c] = cut[many, c] = 0
    for c in (MARK, OTHER, NUMBER, *letters):  # one space goes with what follows, other blanks do not
        new = SIGNS if c == MARK else afresh[c]
        to[ONE_SPACE, c], cut[ONE_SPACE, c] = new, 0
        to[SPACES, c], cut[SPACES, c] = new, 2
        cut[BLANKS, c] = 3
    to[:, END] = START
    return to.ravel(), cut.ravel()


class Splitter:
    """Borders of pre-tokens. Classes of code points beyond ASCII are asked of the library's own
    pre-tokenizer when first met, so that both hold to the same edition of Unicode."""

    def __init__(self) -> None:
        from tokenizers import pre_tokenizers

        self.to, self.cut = _split_tables()
        self.asked = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.classes = np.full(0x110001, UNKNOWN, np.uint8)
        self.classes[0x110000] = END
        self.classes[:128] = [self._class(chr(c)) for c in range(128)]
        self.classes[[ord(c) for c in " 'stmdrvel"]] = [SPACE, MARK, S, S, S, S, R, R, E, L]

    def _class(self, c: str) -> int:
        for ahead, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            if len(self.asked.pre_tokenize_str(ahead + c)) == 1:
                return kind
        return BLANK

    def kinds(self, codes: np.ndarray) -> np.ndarray:
        out = self.classes[codes]
        if len(new := np.flatnonzero(out == UNKNOWN)):
            for c in np.unique(codes[new]).tolist():
                self.classes[c] = self._class(chr(c))
            out = self.classes[codes]
        return out

    def borders(self, kinds: np.ndarray) -> np.ndarray:
        """True where a pre-token begins. ``kinds`` ends with END, as each text in it does."""
        n = len(kinds)
        wide = -(-n // CHUNK)
        grid = np.full(wide * CHUNK, END, np.intp)
        grid[:n] = kinds
        grid = np.ascontiguousarray(grid.reshape(wide, CHUNK).T)  # step x chunk
        maps = np.repeat(np.arange(STATES, dtype=np.intp)[:, None], wide, 1)  # state before x chunk
        for step in grid:
            maps = self.to[maps * CLASSES + step].astype(np.intp)
        # prefix scan: after the round with reach r, a map covers its chunk and the 2r - 1 before it
        reach = 1
        while reach < wide:
            maps[:, reach:] = np.take_along_axis(maps[:, reach:], maps[:, :-reach], 0)
            reach *= 2
        state = np.full(wide, START, np.intp)
        state[1:] = maps[START, :-1]
        cuts = np.empty((CHUNK, wide), np.uint8)
        for step, row in zip(grid, cuts, strict=True):
            at = state * CLASSES + step
            row[:] = self.cut[at]
            state = self.to[at].astype(np.intp)
        cuts = cuts.T.ravel()[:n]
        out = (cuts & 1).astype(bool)
        out[:-1] |= (cuts[1:] & 2).astype(bool)
        return out


def byte_of() -> dict[str, int]:
    """The printable stand-ins for bytes that byte-level vocabularies are written in: a byte
    that prints stands for itself, the others follow from code point 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Machine:
    """The transducer of one vocabulary (the text of a ``tokenizers`` file)."""

    def __init__(self, spec: str, most: int = 1 << 18) -> None:
        model = json.loads(spec)
        kind = model["model"]
        bare = model["normalizer"] is None and model["pre_tokenizer"]["type"] == "ByteLevel" and model["pre_tokenizer"].get("use_regex", True) and not model["pre_tokenizer"]["add_prefix_space"]
        bare = bare and kind["type"] == "BPE" and not any(kind.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not bare or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in model["added_tokens"]):
            raise ValueError("only byte-level BPE without normalizer, prefix space and stripping is known here")
        special = [t["content"] for t in model["added_tokens"]]
        self.special = re.compile("|".join(re.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        byte = byte_of()
        ids = {bytes(byte[c] for c in token): i for token, i in kind["vocab"].items() if token not in special}
        self.made: dict[int, int] = {}  # token -> rank of the merge that makes it
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(kind["merges"]):
            a, b = (bytes(byte[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            pair, whole = (ids[a], ids[b]), ids[a + b]
            self.rank[pair] = r
            if whole not in self.made:
                self.made[whole], self.parts[whole] = r, pair
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.token = [-1]
        self.inner = [True]  # has children
        for token, i in ids.items():
            if len(token) > 1 and i not in self.made:
                continue  # no merge leads to it
            node = 0
            for b in token:
                self.inner[node] = True
                if (nxt := self.child.get(node << 8 | b)) is None:
                    nxt = self.child[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = nxt
            self.token[node] = i
        self.alone: dict[int, bool] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        self.most = most
        self.restart()

    def restart(self) -> None:
        self.states: dict[tuple, int] = {}
        self.live: list[tuple] = []
        self.rest = np.zeros(1 << 10, np.uint8)
        self.steps = Steps()
        self.state(((0, -1, 0),))

    def state(self, live: tuple) -> int:
        if (found := self.states.get(live)) is not None:
            return found
        number = self.states[live] = len(self.live)
        self.live.append(live)
        if number == len(self.rest):
            self.rest = np.concatenate([self.rest, np.zeros(number, np.uint8)])
        self.rest[number] = live[-1][2]
        return number

    def holds(self, a: int, b: int) -> bool:
        """Do tokens a and b stay apart? Takes the merges that made them back, the later one
        first; they do not if the two that face each other would have merged before."""
        found = self.beside.get((a, b))
        if found is None:
            x, y, before = a, b, len(self.rank)
            found = True
            while (r := self.rank.get((x, y))) is None or r >= before:
                left, right = self.made.get(x, -1), self.made.get(y, -1)
                if left < 0 and right < 0:
                    break
                if left > right:
                    x, before = self.parts[x][1], left
                else:  # of equal merges the left one comes first
                    y, before = self.parts[y][0], right + 1
            else:
                found = False
            if len(self.beside) > 1 << 20:
                self.beside.clear()
            self.beside[a, b] = found
        return found

    def itself(self, a: int) -> bool:
        """Is the token what its own bytes give?"""
        found = self.alone.get(a)
        if found is None:
            p = self.parts.get(a)
            found = self.alone[a] = p is None or self.itself(p[0]) and self.itself(p[1]) and self._meets(p, self.made[a])
        return found

    def _meets(self, p: tuple[int, int], rank: int) -> bool:
        """Are both parts whole before the merge of this rank joins them?"""
        x, y = p
        before = rank
        while True:
            left, right = self.made.get(x, -1), self.made.get(y, -1)
            if left < 0 and right < 0:
                return True
            if max(left, right) > rank:
                return False
            if left > right:
                x, before = self.parts[x][1], left
            else:
                y, before = self.parts[y][0], right + 1
            if (r := self.rank.get((x, y))) is not None and r < before:
                return False

    def compile(self, key: int) -> None:
        """The transition of state * 256 + byte."""
        b, ended, new = key & 255, None, []
        for node, last, n in self.live[key >> 8]:
            nxt = self.child.get(node << 8 | b)
            if nxt is None:
                continue
            t = self.token[nxt]
            if ended is None and t >= 0 and (self.itself(t) if last < 0 else self.holds(last, t)):
                ended = (0, t, n + 1)
            if self.inner[nxt]:
                new.append((nxt, last, n))
        new.append(ended)
        base = min(n for _, _, n in new)
        self.steps.add(key, self.state(tuple((node, last, n - base) for node, last, n in new)), base)

    def counts(self, words: pa.Array) -> np.ndarray:
        """Tokens of each of the distinct pre-tokens (binary)."""
        raw = words.buffers()[2]
        off = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        out = np.zeros(len(words), np.int64)
        for i in range(0, len(order), 1 << 14):
            if len(self.live) > self.most:
                self.restart()
            self._counts(data, off, size, order[i : i + (1 << 14)], out)
        return out

    def _counts(self, data: np.ndarray, off: np.ndarray, size: np.ndarray, order: np.ndarray, out: np.ndarray) -> None:
        """``order``: longest first, so that those still read at a column come first."""
        short = -size[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        column, n = 0, int(np.searchsorted(short, 0, "left"))
        while n > 8:
            key = state[:n] << 8 | data[off[order[:n]] + column]
            slot = self.steps.find(key)
            if (new := slot < 0).any():
                for k in np.unique(key[new]).tolist():
                    self.compile(k)
                slot = self.steps.find(key)
            total[:n] += self.steps.emit[slot]
            state[:n] = self.steps.to[slot]
            column += 1
            n = int(np.searchsorted(short, -column, "left"))
        out[order[n:]] = total[n:] + self.rest[state[n:]]
        lives = [self.live[s] for s in state[:n].tolist()]
        for k in range(n):  # the few long ones, one by one
            state[k] = self.state(lives[k])
            out[order[k]] = total[k] + self._walk(data[off[order[k]] + column : off[order[k] + 1]], state, k)

    def _walk(self, data: np.ndarray, state: np.ndarray, k: int) -> int:
        """A long pre-token byte by byte. A full table is started afresh from the state alone."""
        s, total, seen = int(state[k]), 0, {}
        for b in data.tobytes():
            step = seen.get(s << 8 | b)
            if step is None:
                if len(seen) > self.most:
                    live = self.live[s]
                    self.restart()
                    s, seen = self.state(live), {}
                key = s << 8 | b
                if (slot := int(self.steps.find(np.array([key]))[0])) < 0:
                    self.compile(key)
                    slot = int(self.steps.find(np.array([key]))[0])
                step = seen[key] = (int(self.steps.to[slot]), int(self.steps.emit[slot]))
            s = step[0]
            total += step[1]
        return total + int(self.rest[s])


class Steps:
    """The transitions compiled so far: state * 256 + byte to (next state, emitted tokens), an
    open-addressed table that numpy probes for many keys at once."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.n = bits, 0
        self.key = np.full(1 << bits, -1, np.int64)
        self.to, self.emit = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.uint8)

    def place(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 where there is none."""
        slot = self.place(key)
        there = self.key[slot]
        left = np.flatnonzero((there != key) & (there >= 0))
        while len(left):
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
            there = self.key[slot[left]]
            left = left[(there != key[left]) & (there >= 0)]
        slot[self.key[slot] != key] = -1
        return slot

    def add(self, key: int, to: int, emit: int) -> None:
        """A key that is not there yet."""
        if 2 * self.n >= 1 << self.bits:
            old = self.key >= 0
            keys, tos, emits = self.key[old], self.to[old], self.emit[old]
            self.__init__(self.bits + 2)
            for k, slot in enumerate(self.place(keys).tolist()):
                self.put(slot, keys[k], tos[k], emits[k])
        self.put((key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - self.bits, key, to, emit)

    def put(self, slot: int, key: int, to: int, emit: int) -> None:
        while self.key[slot] >= 0:
            slot = slot + 1 & (1 << self.bits) - 1
        self.key[slot], self.to[slot], self.emit[slot] = key, to, emit
        self.n += 1


_machines: dict[int, tuple[Splitter, Machine]] = {}


def machine_of(spec: str) -> tuple[Splitter, Machine]:
    """The machines of a vocabulary, kept for later tasks of this worker."""
    if (key := hash(spec)) not in _machines:
        _machines.clear()
        _machines[key] = Splitter(), Machine(spec)
    return _machines[key]
