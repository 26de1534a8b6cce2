"""Generalised LR repair of role sequences: a small helper that works on one conversation's codes."""

from __future__ import annotations

from typing import NamedTuple

#: Role sequences: an optional system turn, then one or more pairs of user and assistant; or nothing.
GRAMMAR = [("C", ""), ("C", "T"), ("T", "Oua"), ("T", "Tua"), ("O", ""), ("O", "s")]
ROLES = {"u": "user", "a": "assistant"}
#: Stacks that the grammar may have; left recursion keeps their number small.
MOST_STACKS = 1000

#: Faults of a row, as the second character of its code; the first is its role's initial, or OTHER.
SOUND, BLANK, DUPLICATE, TRUNCATED = " ", "b", "d", "t"
OTHER = "?"
KEEP, REROLE, DELETE, INSERT = "KRDI"
START = -1


class Weights(NamedTuple):
    """Costs of the edits; that of an insertion must be above zero."""

    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


class Move(NamedTuple):
    """From one stack to another: cost, edits and the roles they leave (a dot for a deleted row)."""

    source: int
    target: int
    cost: int
    audit: str
    roles: str


class Parser:
    """All stacks of the LR(0) automaton as one graph, and the cheapest moves between them for every code of a row.

    A stack is a node (state, node below), made once, so stacks share their lower parts. Reductions need no lookahead: all
    that apply are followed, and the nodes that they reach are parsed side by side. Wherever two parses reach the same
    node, the smaller (cost, audit) stays.

    Audits are compared without spelling them out. Before insertions behind the last row, every audit has one letter
    that is no insertion for each row and ends in such a letter, so none is the beginning of another, and an order among them
    stays when equal endings follow. So each row keeps the rank of its nodes' audits and adds only its own letters.
    """

    def __init__(self, grammar: list[tuple[str, str]] | None = None, weights: Weights = Weights()) -> None:
        self._grammar, self._weights = grammar or GRAMMAR, weights
        self._heads = {head for head, _ in self._grammar}
        self._states: dict[frozenset, int] = {}
        self._items: list[frozenset] = []
        self._nodes: dict[tuple[int, int], int] = {}
        self._stacks: list[tuple[int, int]] = []
        goal = self._grammar[0][0]
        root = self._node(self._state(frozenset(i for i, (head, _) in enumerate(self._grammar) if head == goal), START), START)
        self.accepted = self._node(self._goto(self._stacks[root][0], goal), root)
        self.start = self._reduced(root)
        self._shifts: dict[tuple[int, str], list[int]] = {}
        terminals = sorted({c for _, body in self._grammar for c in body} - self._heads)
        todo, self.nodes = [*self.start], []
        while todo:  # every node that shifts can reach
            node = todo.pop()
            if node in self.nodes:
                continue
            self.nodes.append(node)
            if len(self.nodes) > MOST_STACKS:
                raise ValueError("the grammar nests without bound")
            for terminal in terminals:
                todo += self._shifted(node, terminal)
        self.nodes.sort()
        self._inserted = {node: self._insertions(node) for node in self.nodes}
        self._moves: dict[str, dict[int, list[Move]]] = {}

    # the automaton and its stacks

    def _state(self, kernel: frozenset, dot: int) -> int:
        """The state of items (rule, dot); a kernel of rules alone stands for their beginnings."""
        items = {(r, 0) for r in kernel} if dot == START else set(kernel)
        while True:
            heads = {self._grammar[r][1][d] for r, d in items if d < len(self._grammar[r][1])} & self._heads
            more = {(r, 0) for r, (head, _) in enumerate(self._grammar) if head in heads} - items
            if not more:
                break
            items |= more
        found = frozenset(items)
        if found not in self._states:
            self._states[found] = len(self._items)
            self._items.append(found)
        return self._states[found]

    def _goto(self, state: int, symbol: str) -> int | None:
        kernel = frozenset((r, d + 1) for r, d in self._items[state] if self._grammar[r][1][d : d + 1] == symbol)
        if not kernel and not (state == 0 and symbol == self._grammar[0][0]):
            return None
        return self._state(kernel, 0)

    def _node(self, state: int, below: int) -> int:
        key = state, below
        if key not in self._nodes:
            self._nodes[key] = len(self._stacks)
            self._stacks.append(key)
        return self._nodes[key]

    def _reduced(self, node: int) -> list[int]:
        """The nodes that can shift or accept, among ``node`` and all that reductions make of it."""
        seen, todo = [], [node]
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.append(at)
            for r, d in self._items[self._stacks[at][0]]:
                head, body = self._grammar[r]
                if d == len(body):
                    base = at
                    for _ in body:
                        base = self._stacks[base][1]
                    state = self._goto(self._stacks[base][0], head)
                    if state is not None:
                        todo.append(self._node(state, base))
        return sorted(n for n in seen if n == self.accepted or self._can_shift(n))

    def _can_shift(self, node: int) -> bool:
        return any(d < len(self._grammar[r][1]) and self._grammar[r][1][d] not in self._heads for r, d in self._items[self._stacks[node][0]])

    def _shifted(self, node: int, terminal: str) -> list[int]:
        key = node, terminal
        if key not in self._shifts:
            state = self._goto(self._stacks[node][0], terminal)
            self._shifts[key] = [] if state is None else self._reduced(self._node(state, node))
        return self._shifts[key]

    # edits

    def _insertions(self, node: int) -> list[Move]:
        """The cheapest ways from ``node`` by insertions alone, the empty one included."""
        best = {node: Move(node, node, 0, "", "")}
        todo = [node]
        while todo:
            at = best[todo.pop(0)]
            for role in ROLES:
                for target in self._shifted(at.target, role):
                    move = Move(node, target, at.cost + self._weights.insert, at.audit + INSERT, at.roles + role)
                    if target not in best or move < best[target]:
                        best[target] = move
                        todo.append(target)
        return [*best.values()]

    def moves(self, code: str) -> dict[int, list[Move]]:
        """For each node the cheapest move to each other over a row with this code, insertions before the row included."""
        if code not in self._moves:
            initial, fault = code
            w, extra = self._weights, self._weights.truncated * (fault == TRUNCATED)
            table: dict[int, list[Move]] = {}
            for node, ways in self._inserted.items():
                best: dict[int, Move] = {}
                for way in ways:
                    edits = [(DELETE, w.delete, ".", [way.target])]
                    if fault not in (BLANK, DUPLICATE):
                        edits.append((KEEP, extra, initial, self._shifted(way.target, initial)))
                        edits += [(REROLE, w.rerole + extra, role, self._shifted(way.target, role)) for role in ROLES]
                    for letter, cost, role, targets in edits:
                        for target in targets:
                            move = Move(node, target, way.cost + cost, way.audit + letter, way.roles + role)
                            if target not in best or move < best[target]:
                                best[target] = move
                table[node] = [*best.values()]
            self._moves[code] = table
        return self._moves[code]

    def _walk(self, frontier: dict[int, tuple[int, int]], codes: str) -> tuple[dict[int, tuple[int, int]], list[dict[int, Move]]]:
        """The frontier (node to cost and rank) behind the rows, and for each row the move that reached each node."""
        trail = []
        for i in range(0, len(codes), 2):
            table = self.moves(codes[i : i + 2])
            best: dict[int, tuple] = {}
            for node, (cost, rank) in frontier.items():
                for move in table[node]:
                    key = cost + move.cost, rank, move.audit, move.roles
                    held = best.get(move.target)
                    if held is None or key < held[0]:
                        best[move.target] = key, move
            frontier = _ranked({target: key for target, (key, _) in best.items()})
            trail.append({target: move for target, (_, move) in best.items()})
        return frontier, trail

    def block(self, codes: str, sources: list[int]) -> list[Move]:
        """The cheapest moves over a block of rows, from each of ``sources`` (START: the beginning of a conversation)."""
        found = []
        for source in sources:
            begun = dict.fromkeys(self.start if source == START else [source], (0, 0))
            frontier, trail = self._walk(begun, codes)
            for target, (cost, _) in frontier.items():
                audit, roles, node = [], [], target
                for step in reversed(trail):
                    move = step[node]
                    audit.append(move.audit)
                    roles.append(move.roles)
                    node = move.source
                found.append(Move(source, target, cost, "".join(reversed(audit)), "".join(reversed(roles))))
        return found

    def joined(self, blocks: list[list[Move]]) -> tuple[int, list[tuple[str, str]]]:
        """The least cost of a conversation and the edits and roles of each of its blocks; insertions at the end go to the last."""
        frontier: dict[int, tuple[int, int]] = {START: (0, 0)}
        trail: list[dict[int, Move]] = []
        for moves in blocks:
            best: dict[int, tuple] = {}
            for move in moves:
                if move.source in frontier:
                    cost, rank = frontier[move.source]
                    key = cost + move.cost, rank, move.audit, move.roles
                    if move.target not in best or key < best[move.target][0]:
                        best[move.target] = key, move
            frontier = _ranked({target: key for target, (key, _) in best.items()})
            trail.append({target: move for target, (_, move) in best.items()})
        ends = [(cost + way.cost, rank, way.audit, way.roles, node) for node, (cost, rank) in frontier.items() for way in self._inserted.get(node, ()) if way.target == self.accepted]
        cost, _, tail, tail_roles, node = min(ends)
        parts = []
        for step in reversed(trail):
            parts.append((step[node].audit, step[node].roles))
            node = step[node].source
        parts.reverse()
        parts[-1] = parts[-1][0] + tail, parts[-1][1] + tail_roles
        return cost, parts


def _ranked(keys: dict[int, tuple]) -> dict[int, tuple[int, int]]:
    """Cost and rank of each node, ranks by the audit before and the letters added; equal audits share a rank."""
    order = {audit: i for i, audit in enumerate(sorted({key[1:3] for key in keys.values()}))}
    return {node: (key[0], order[key[1:3]]) for node, key in keys.items()}
