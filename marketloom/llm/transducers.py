"""Weighted finite-state transducers that read and write one symbol at a time, their composition and best paths.

Weights are those of the tropical semiring over maxima: along a path they add up, and of several paths the greatest counts. Of equal
paths the one whose outputs come first counts.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

Arc = tuple[str, float, object]


@dataclass
class Transducer:
    """Arcs by state and input symbol: (output symbol, weight, next state). A state that isn't in finals ends no path."""

    start: object
    arcs: dict[object, dict[str, list[Arc]]] = field(default_factory=dict)
    finals: dict[object, float] = field(default_factory=dict)

    def add(self, state: object, read: str, write: str, to: object, weight: float = 0.0) -> None:
        self.arcs.setdefault(state, {}).setdefault(read, []).append((write, weight, to))

    def compose(self, other: Transducer) -> Transducer:
        """The machine that passes this one's output to the other; states are the pairs that can be reached."""
        out = Transducer((self.start, other.start))
        left, seen = [out.start], {out.start}
        while left:
            state = a, b = left.pop()
            if a in self.finals and b in other.finals:
                out.finals[state] = self.finals[a] + other.finals[b]
            for read, arcs in self.arcs.get(a, {}).items():
                for between, w, p in arcs:
                    for write, v, q in other.arcs.get(b, {}).get(between, ()):
                        out.add(state, read, write, (p, q), w + v)
                        if (p, q) not in seen:
                            seen.add((p, q))
                            left.append((p, q))
        return out.numbered()

    def numbered(self) -> Transducer:
        """The same with whole numbers as states, and without the states from which no path ends."""
        back: dict[object, list[object]] = {}
        for s, by in self.arcs.items():
            for arcs in by.values():
                for _, _, to in arcs:
                    back.setdefault(to, []).append(s)
        useful, left = set(self.finals), list(self.finals)
        while left:
            for s in back.get(left.pop(), ()):
                if s not in useful:
                    useful.add(s)
                    left.append(s)
        names: dict[object, int] = {}
        name = lambda s: names.setdefault(s, len(names))
        out = Transducer(name(self.start))
        for s, by in self.arcs.items():
            for read, arcs in by.items():
                for write, w, to in arcs:
                    if s in useful and to in useful:
                        out.add(name(s), read, write, name(to), w)
        out.finals = {name(s): w for s, w in self.finals.items()}
        return out

    def best(self, symbols: Iterable[str]) -> tuple[float, str] | None:
        """Weight and output of the best path that reads the symbols; None if there is no path."""
        now: dict[object, tuple[float, str]] = {self.start: (0.0, "")}
        for x in symbols:
            after: dict[object, tuple[float, str]] = {}
            for state, (weight, told) in now.items():
                for write, w, to in self.arcs.get(state, {}).get(x, ()):
                    new = weight + w, told + write
                    old = after.get(to)
                    if old is None or (-new[0], new[1]) < (-old[0], old[1]):
                        after[to] = new
            now = after
        ends = [(weight + self.finals[s], told) for s, (weight, told) in now.items() if s in self.finals]
        return min(ends, key=lambda e: (-e[0], e[1])) if ends else None
