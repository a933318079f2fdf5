"""Cheapest edits of a conversation's turns: Viterbi whose edits come out as survivors meet."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

# States of a repaired conversation so far: empty, system turn only, user turn last, assistant turn last
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
DONE = (EMPTY, ASSISTANT)
KEEP, REROLE, DELETE, INSERT = "KRDI"
COSTS = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3  # of a truncated turn that stays
ANSWERS = (USER, USER, ASSISTANT, USER)  # the state behind a turn that is put in or gets its role

SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)  # faults; a blank or duplicate turn must go


class _Node:
    """Edits between two branchings of the survivors' paths; ``refs`` counts children and survivors."""

    __slots__ = ("parent", "edits", "children", "refs")

    def __init__(self, parent: _Node | None, edits: list[str]):
        self.parent, self.edits, self.children, self.refs = parent, edits, [], 0


class Survivors:
    """The best path into each state, in one backpointer tree.

    A node without a child or survivor is freed, and one left with a single child merges
    with it, so the tree has a leaf a state at most. What the root's only child holds is
    common to all paths: it is settled, and given out. Of paths of equal cost the one
    whose edits sort first wins; they are compared from their last common node on, as
    long as they are unresolved.
    """

    def __init__(self, state: int):
        self.root = _Node(None, [])
        self.best: dict[int, tuple[int, _Node]] = {state: (0, self.root)}
        self.root.refs = 1

    def extend(self, moves: Iterable[tuple[int, int, int, str]], stay: bool = False) -> bool:
        """Take (from, to, cost, edits) one step on; ``stay``: states may stay. Whether any path changed."""
        chosen: dict[int, tuple[int, _Node, str]] = {}
        if stay:
            chosen = {state: (cost, node, "") for state, (cost, node) in self.best.items()}
        for start, end, cost, edits in moves:
            if start not in self.best:
                continue
            path = (self.best[start][0] + cost, self.best[start][1], edits)
            if end not in chosen or self._before(path, chosen[end]):
                chosen[end] = path
        old, self.best, changed = self.best, {}, False
        for state, (cost, node, edits) in chosen.items():
            if edits:
                child = _Node(node, [edits])
                node.children.append(child)
                node.refs += 1
                node, changed = child, True
            node.refs += 1
            self.best[state] = (cost, node)
        for _, node in old.values():
            self._release(node)
        return changed

    def keep_only(self, states: Iterable[int]) -> None:
        for state in set(self.best) - set(states):
            self._release(self.best.pop(state)[1])

    def settled(self) -> list[str]:
        """Edits that all survivors share and that have not been given out."""
        out: list[str] = []
        while self.root.refs == 1 and self.root.children:
            self.root = self.root.children[0]
            self.root.parent = None
            out += self.root.edits
            self.root.edits = []
        return out

    def finish(self, states: Iterable[int] = DONE) -> tuple[int, int, list[str]]:
        """(state, cost, edits not given out) of the best path into one of ``states``."""
        ends = [(state, *self.best[state]) for state in states if state in self.best]
        state, cost, node = ends[0]
        for other in ends[1:]:
            if self._before((other[1], other[2], ""), (cost, node, "")):
                state, cost, node = other
        self.keep_only([state])
        return state, cost, self.settled()

    def ends(self) -> Iterator[tuple[int, int, str]]:
        """(state, cost, edits not given out) of all survivors."""
        for state, (cost, node) in self.best.items():
            yield state, cost, "".join(_letters(self._way(node), ""))

    def _before(self, a: tuple[int, _Node, str], b: tuple[int, _Node, str]) -> bool:
        if a[0] != b[0]:
            return a[0] < b[0]
        up, low = self._way(a[1]), self._way(b[1])
        common = 0
        while common < min(len(up), len(low)) and up[common] is low[common]:
            common += 1
        return _sorts_before(_letters(up[common:], a[2]), _letters(low[common:], b[2]))

    def _way(self, node: _Node | None) -> list[_Node]:
        way = []
        while node is not None:
            way.append(node)
            node = node.parent
        return way[::-1]

    def _release(self, node: _Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            node.parent.children.remove(node)
            node = node.parent
            node.refs -= 1
        if node.refs == 1 and node.children and node.parent is not None:
            child = node.children[0]  # the longer list takes the other's edits
            node.edits += child.edits
            child.edits, child.parent = node.edits, node.parent
            node.parent.children[node.parent.children.index(node)] = child


def _letters(nodes: list[_Node], last: str) -> Iterator[str]:
    for node in nodes:
        yield from node.edits
    if last:
        yield last


def _sorts_before(a: Iterator[str], b: Iterator[str]) -> bool:
    """Whether one text sorts before another, both in pieces; only as far as they agree is read."""
    x = y = ""
    while True:
        x, y = x or next(a, ""), y or next(b, "")
        if not x or not y:
            return not x and bool(y)
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        x, y = x[n:], y[n:]


def _row_moves(initial: str, fault: int) -> list[tuple[int, int, int, str]]:
    moves = [(state, state, COSTS[DELETE], DELETE) for state in range(4)]
    if fault in (BLANK, DUPLICATE):
        return moves
    more = TRUNCATED_COST if fault == TRUNCATED else 0
    for state, after in enumerate(ANSWERS):
        moves.append((state, after, COSTS[REROLE] + more, REROLE))
        if initial == ("a" if after == ASSISTANT else "u"):
            moves.append((state, after, COSTS[KEEP] + more, KEEP))
    if initial == "s":
        moves.append((EMPTY, SYSTEM, COSTS[KEEP] + more, KEEP))
    return moves


_INSERTS = [(state, after, COSTS[INSERT], INSERT) for state, after in enumerate(ANSWERS)]
_MOVES = {(initial, fault): _row_moves(initial, fault) for initial in ("s", "u", "a", "") for fault in range(4)}


def _put_in(paths: Survivors) -> None:
    """Turns put in at this place, as many as make any state cheaper; then lost states go.

    An assistant turn last can do whatever a system turn alone can, and whatever an empty
    conversation can for the cost of one deletion more (of a system turn). A state that
    costs more than that has no part in any cheapest path.
    """
    while paths.extend(_INSERTS, stay=True):
        pass
    cost = paths.best[ASSISTANT][0] if ASSISTANT in paths.best else None
    if cost is not None:
        lost = {s for s, margin in ((EMPTY, COSTS[DELETE]), (SYSTEM, 0))
                if s in paths.best and paths.best[s][0] > cost + margin}
        if lost:
            paths.keep_only(set(paths.best) - lost)


def follow(turns: Iterable[tuple[str, int]], state: int = EMPTY) -> Iterator[str | Survivors]:
    """The cheapest edits of (role initial, fault) turns, as they settle, and the survivors at the end.

    Edits' initials come out in order, as texts, as soon as no later turn can change them;
    the last item is the ``Survivors``, whose ``finish`` gives the rest. Memory holds only
    edits that are unresolved.
    """
    paths = Survivors(state)
    _put_in(paths)
    for initial, fault in turns:
        paths.extend(_MOVES[initial if initial in ("s", "u", "a") else "", fault])
        _put_in(paths)
        settled = paths.settled()
        if settled:
            yield "".join(settled)
    yield paths


def cheapest_edits(turns: Iterable[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    out, cost = [], 0
    for piece in follow(turns):
        if isinstance(piece, Survivors):
            _, cost, rest = piece.finish()
            out += rest
        else:
            out.append(piece)
    return cost, "".join(out)


def all_ends(turns: Iterable[tuple[str, int]], opening: bool) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit) of a piece of a conversation, for each state before and behind it.

    Ends that cannot be part of a cheapest whole are left out. Turns are put in before the
    first one only if the piece is the ``opening``, which begins empty; else the piece before has done that.
    """
    found = []
    turns = list(turns)
    for start in (EMPTY,) if opening else range(4):
        paths = Survivors(start)
        out: list[str] = []
        if opening:
            _put_in(paths)
        for initial, fault in turns:
            paths.extend(_MOVES[initial if initial in ("s", "u", "a") else "", fault])
            _put_in(paths)
            out += paths.settled()
        found += [(start, end, cost, "".join(out) + rest) for end, cost, rest in paths.ends()]
    return found


def join_pieces(pieces: Iterable[list[tuple[int, int, int, str]]]) -> Iterator[tuple[int, str] | int]:
    """(state before, edits) of each piece on the cheapest whole path, as they settle; last its cost."""
    paths, waiting, state = Survivors(EMPTY), deque(), EMPTY

    def known(settled: list[str]) -> Iterator[tuple[int, str]]:
        nonlocal state
        for edits in settled:
            yield state, edits
            state = waiting.popleft()[state, edits]

    for ends in pieces:
        waiting.append({(start, edits): end for start, end, _, edits in ends})
        paths.extend(ends)
        yield from known(paths.settled())
    _, cost, rest = paths.finish()
    yield from known(rest)
    yield cost


def apply_edits(edits: str, initials: Iterable[str], state: int = EMPTY) -> Iterator[tuple[str, int | None, str | None]]:
    """(edit, turn, role) of each turn that stays or is put in; ``turn`` counts the given turns.

    ``role`` is null where the turn keeps its own.
    """
    at, initials = -1, iter(initials)
    for edit in edits:
        if edit != INSERT:
            at += 1
            initial = next(initials)
        if edit == DELETE:
            continue
        if edit == KEEP and state == EMPTY and initial == "s":
            state = SYSTEM
            yield edit, at, None
            continue
        state = ANSWERS[state]
        role = "assistant" if state == ASSISTANT else "user"
        yield edit, None if edit == INSERT else at, None if edit == KEEP else role
