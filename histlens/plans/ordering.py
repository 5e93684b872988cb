"""The three strongest levels decided a second way, by order constraints instead of a search over frontiers.

A level is a set of facts "a before b" and of choices "a before b, or c before d" over transactions (serializable) or over
their read and write halves (prefix, snapshot isolation). ``solve`` keeps a closed partial order, adds what every choice
forces, and branches on a pair that is still open. Once every choice holds, any extension to a total order is a witness;
counts of predecessors give one. It shares nothing with ``kernel.linearize`` but the relations, so that each checks the other.

Choices are as many as readers times other writers of a variable, and each branch copies the order: for cross-checks of
histories of up to some hundred transactions, not for the largest ones.
"""

from __future__ import annotations

from ..model import Level

Pair = tuple[int, int]


def constraints(rel, vis: list[int], members: list[int], level: Level) -> tuple[int, list[Pair], list[tuple[Pair, Pair]]]:
    """Number of vertices, facts and choices. Transaction members[k] is vertex k, or read half 2k and write half 2k + 1.

    A reader of version w of a variable comes before another writer's write unless that one comes before w; nothing comes
    before the root. Under snapshot isolation, writers of a common variable come one after another.
    """
    split = level != Level.SERIALIZABLE
    at = {i: k for k, i in enumerate(members)}
    read = {i: 2 * k if split else k for i, k in at.items()}
    write = {i: 2 * k + 1 if split else k for i, k in at.items()}
    facts = [(read[i], write[i]) for i in members] if split else []
    facts += [(write[i], read[j]) for i in members for j in members if vis[i] >> j & 1]
    choices = []
    for (x, w), readers in rel.readers.items():
        for r in readers:
            if r not in at:
                continue
            for other in rel.writers.get(x, ()):
                if other in at and other not in (w, r):
                    late = (read[r], write[other])
                    if w in at:
                        choices.append(((write[other], write[w]), late))
                    else:
                        facts.append(late)
    if level == Level.SNAPSHOT_ISOLATION:
        choices += [((write[i], read[j]), (write[j], read[i])) for i in members for j in members if i < j and rel.writes[i] & rel.writes[j]]
    return len(members) * (2 if split else 1), facts, choices


class Order:
    """A closed strict partial order, as bit sets both ways."""

    def __init__(self, after: list[int], before: list[int]) -> None:
        self.after, self.before = after, before

    def copy(self) -> Order:
        return Order(self.after.copy(), self.before.copy())

    def holds(self, pair: Pair) -> bool:
        return bool(self.after[pair[0]] >> pair[1] & 1)

    def add(self, pair: Pair) -> bool:
        """Whether ``pair`` could be added, with all that follows."""
        a, b = pair
        if a == b or self.holds((b, a)):
            return False
        if not self.holds(pair):
            down, up = self.before[a] | 1 << a, self.after[b] | 1 << b
            for rows, of, more in ((self.after, down, up), (self.before, up, down)):
                while of:
                    low = of & -of
                    rows[low.bit_length() - 1] |= more
                    of ^= low
        return True

    def settle(self, choices: list[tuple[Pair, Pair]]) -> list[tuple[Pair, Pair]] | None:
        """Adds what the choices force until nothing changes: those left open, None on a contradiction."""
        while True:
            left = []
            for one, two in choices:
                if self.holds(one) or self.holds(two):
                    continue
                if self.holds(one[::-1]) or self.holds(two[::-1]):
                    if not self.add(two if self.holds(one[::-1]) else one):
                        return None
                else:
                    left.append((one, two))
            if len(left) == len(choices):
                return left
            choices = left


def solve(rel, vis: list[int], members: list[int], level: Level, budget: int | None = None) -> list[tuple[int, bool]] | None | bool:
    """As ``kernel.linearize``: an order of ``members`` that the level allows, None if there is none, False after ``budget`` branches."""
    n, facts, choices = constraints(rel, vis, members, level)
    order = Order([0] * n, [0] * n)
    if not all(order.add(x) for x in facts):
        return None
    todo, nodes = [(order, choices)], 0
    while todo:
        order, choices = todo.pop()
        choices = order.settle(choices)
        if choices is None:
            continue
        if not choices:
            ranked = sorted(range(n), key=lambda v: order.before[v].bit_count())
            return [(members[v], True) for v in ranked] if level == Level.SERIALIZABLE else [(members[v // 2], bool(v % 2)) for v in ranked]
        nodes += 1
        if budget is not None and nodes > budget:
            return False
        first = choices[0][0]
        for pair in (first[::-1], first):
            branch = order.copy()
            if branch.add(pair):
                todo.append((branch, choices))
    return None
