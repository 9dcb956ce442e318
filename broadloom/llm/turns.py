"""Least-cost repair of turn sequences by cost layers, for one stretch of turns at a time.

Grammar of role initials: ``(s?(ua)+)?``. Its states are what was written so far: nothing, a
system turn, an open user turn, a closed pair. Layers: for each cost 0, 1, 2, ... a bitset of
grammar states at each turn, those from which the rest can be brought to its end at that cost
or less (turns run from the last to the first, so that the trace runs forward). The first layer
that holds the entry state gives the cost; the trace takes the least letter that stays within
the layers: Delete, Insert, Keep, Rerole.

A long conversation is cut into chunks; what lies behind a chunk enters as its end costs, one
number for each state. ``matrix`` gives a chunk's least costs from each state to each, which
compose by sums and minima.
"""

from __future__ import annotations

NOTHING, SYSTEM, OPEN, PAIR = range(4)
#: Codes of a turn: kind in the lowest two bits (system, user, assistant, other), then flags.
KINDS = {"s": 0, "u": 1, "a": 2}
MUST_GO, CUT_OFF = 4, 8
DELETE, REROLE, INSERT, CUT_COST = 2, 1, 5, 5
FAR = 1 << 60
CHUNK = 64
#: Least costs of inserted turns that end the sequence from each state.
FINAL = (0, 2 * INSERT, INSERT, 0)
#: The state after keeping a turn of a kind, after a turn that may be made what is asked for.
KEPT = ({NOTHING: SYSTEM}, {NOTHING: OPEN, SYSTEM: OPEN, PAIR: OPEN}, {OPEN: PAIR}, {})
MADE = {NOTHING: OPEN, SYSTEM: OPEN, PAIR: OPEN, OPEN: PAIR}


def _before(moves: dict[int, int]) -> list[int]:
    """For each set of states, the set of those that one of the moves brings into it."""
    return [sum(1 << a for a, b in moves.items() if states >> b & 1) for states in range(16)]


BEFORE_KEPT = [_before(m) for m in KEPT]
BEFORE_MADE = _before(MADE)


def layers(codes: bytes, end: tuple[int, ...], want: int) -> tuple[list[list[int]], int]:
    """(bitsets by layer and turn, the cost of layer 0) up to the first layer that has all
    states of ``want`` before the first turn. ``end``: costs behind the last turn."""
    m, base = len(codes), min(end)
    out: list[list[int]] = []
    none = [0] * (m + 1)
    while True:
        c = len(out)
        now = [0] * (m + 1)
        now[m] = sum(1 << s for s in range(4) if end[s] - base <= c)
        one, two, five, six = (out[c - k] if c >= k else none for k in (REROLE, DELETE, INSERT, REROLE + CUT_COST))
        for i in range(m - 1, -1, -1):
            code = codes[i]
            x = two[i + 1] | BEFORE_MADE[five[i]]
            if not code & MUST_GO:
                kept, made = (five, six) if code & CUT_OFF else (now, one)
                x |= BEFORE_KEPT[code & 3][kept[i + 1]] | BEFORE_MADE[made[i + 1]]
            now[i] = x
        out.append(now)
        if now[0] & want == want:
            return out, base


def costs(found: tuple[list[list[int]], int], states: int = 15) -> tuple[int, ...]:
    """Least cost from each state before the first turn (``FAR`` for others than ``states``)."""
    rows, base = found
    return tuple(base + next(c for c, row in enumerate(rows) if row[0] >> s & 1) if states >> s & 1 else FAR for s in range(4))


def matrix(codes: bytes) -> list[tuple[int, ...]]:
    """For each end state (not closed by inserts) the least costs from each entry state."""
    total = [tuple(0 if s == f else FAR for s in range(4)) for f in range(4)]
    for i in reversed(range(0, len(codes), CHUNK)):
        chunk, columns = codes[i : i + CHUNK], []
        for f in range(4):
            reach = 1 << f
            for code in reversed(chunk):
                if not code & MUST_GO:
                    reach |= BEFORE_KEPT[code & 3][reach] | BEFORE_MADE[reach]
                for _ in range(3):  # any turn may be inserted before it
                    reach |= BEFORE_MADE[reach]
            columns.append(costs(layers(chunk, tuple(0 if s == f else FAR for s in range(4)), reach), reach))
        total = [tuple(min(FAR, *(columns[g][s] + t[g] for g in range(4))) for s in range(4)) for t in total]
    return total


def behind(of_chunk: list[tuple[int, ...]], end: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a stretch, from those behind it and its matrix."""
    return tuple(min(FAR, *(of_chunk[f][s] + end[f] for f in range(4))) for s in range(4))


def repair(codes: bytes, state: int = NOTHING, end: tuple[int, ...] = FINAL) -> tuple[str, int, int]:
    """(letters, state behind them, cost of all that follows the entry) of the least audit."""
    starts = list(range(0, len(codes), CHUNK)) or [0]
    solved = {}
    for i in reversed(starts):
        solved[i] = found = layers(codes[i : i + CHUNK], end, 15 if i else 1 << state)
        end = costs(found) if i else end
    cost, letters = None, []
    for i in starts:
        rows, base = solved.pop(i)
        chunk = codes[i : i + CHUNK]
        c = next(c for c, row in enumerate(rows) if row[0] >> state & 1)
        cost = base + c if cost is None else cost
        k = 0
        while k < len(chunk):
            code = chunk[k]
            extra = CUT_COST if code & CUT_OFF else 0
            if c >= DELETE and rows[c - DELETE][k + 1] >> state & 1:
                letters.append("D")
                c, k = c - DELETE, k + 1
            elif c >= INSERT and rows[c - INSERT][k] >> MADE[state] & 1:
                letters.append("I")
                c, state = c - INSERT, MADE[state]
            elif c >= extra and (kept := KEPT[code & 3].get(state)) is not None and rows[c - extra][k + 1] >> kept & 1:
                letters.append("K")
                c, k, state = c - extra, k + 1, kept
            else:
                letters.append("R")
                c, k, state = c - extra - REROLE, k + 1, MADE[state]
    return "".join(letters), state, cost


def closing(state: int) -> tuple[str, int]:
    """Inserts that end the sequence from a state."""
    letters = ""
    while state not in (NOTHING, PAIR):
        letters, state = letters + "I", MADE[state]
    return letters, state


def applied(letters: str, state: int, roles: list[str], texts: list[str], codes: bytes) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits. ``roles`` and ``texts`` are those of the turns that need
    not go."""
    new_roles, new_texts = [], []
    row = turn = 0
    for x in letters:
        if x == "I":
            state = MADE[state]
            new_roles.append("user" if state == OPEN else "assistant")
            new_texts.append("")
            continue
        code = codes[row]
        row += 1
        if code & MUST_GO:
            continue
        if x == "K":
            state = KEPT[code & 3][state]
            new_roles.append(roles[turn])
        elif x == "R":
            state = MADE[state]
            new_roles.append("user" if state == OPEN else "assistant")
        if x != "D":
            new_texts.append(texts[turn])
        turn += 1
    return new_roles, new_texts
