"""Weighted finite-state transducers: states, arcs, composition.

An arc reads one symbol and writes one or none (``""``). Weights are at least
0; the weight of a path is that of its strongest arc, and what is written
carries the strongest weight since the symbol written before it. A transducer
must be functional: the paths that read the same and don't die write the same.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable

#: Read by arcs that take any symbol for which their state has no arc of its own.
ANY = "any"

Weighted = tuple[str, float]


class Transducer:
    """Arcs by state and symbol read; ``also`` are further start states."""

    def __init__(self, start: Hashable = 0):
        self.start = start
        self.also: set[Hashable] = set()
        self.final: set[Hashable] = set()
        self.arcs: dict[Hashable, dict[str, list[tuple[str, float, Hashable]]]] = {}

    def arc(self, state: Hashable, reads: str, writes: str, weight: float, then: Hashable) -> None:
        self.arcs.setdefault(state, {}).setdefault(reads, []).append((writes, weight, then))

    def arcs_from(self, state: Hashable, symbol: str) -> list[tuple[str, str, float, Hashable]]:
        """``(reads, writes, weight, then)`` of the arcs that take a symbol."""
        of = self.arcs.get(state, {})
        got = of.get(symbol)
        return [(symbol, *a) for a in (of.get(ANY, ()) if got is None else got)]

    @property
    def starts(self) -> set[Hashable]:
        return {self.start} | self.also

    def run(self, symbols: Iterable[Weighted]) -> list[Weighted]:
        """What is written for weighted symbols, each with its weight. Paths
        that meet in a state are one from there, the stronger. Raises
        ValueError if no path ends in a final state."""
        # By state: the path's weight, the weight not yet written, what is written.
        paths: dict[Hashable, tuple[float, float, list[Weighted]]] = {s: (0.0, 0.0, []) for s in self.starts}
        for symbol, given in symbols:
            then: dict[Hashable, tuple[float, float, list[Weighted]]] = {}
            for state, (_, weight, out) in paths.items():
                for _, writes, w, to in self.arcs_from(state, symbol):
                    strong = max(weight, w, given)
                    if to not in then or then[to][0] < strong:
                        then[to] = (strong, 0.0, [*out, (writes, strong)]) if writes else (strong, strong, out)
            paths = then
        for state, (_, _, out) in paths.items():
            if state in self.final:
                return out
        raise ValueError("no path reads these symbols")


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that writes what ``second`` writes for what ``first``
    writes. States are pairs of states, only those that can be reached. The
    arcs of ``second`` must name the symbols they read, ``first`` may have
    arcs for ANY."""
    out = Transducer((first.start, second.start))
    out.also = {(a, b) for a in first.starts for b in second.starts} - {out.start}
    todo, seen = list(out.starts), set(out.starts)
    while todo:
        state = a, b = todo.pop()
        if a in first.final and b in second.final:
            out.final.add(state)
        for reads, arcs in first.arcs.get(a, {}).items():
            for middle, weight, to in arcs:
                ends = [("", 0.0, b)] if not middle else second.arcs.get(b, {}).get(middle, ())
                for writes, w, then in ends:
                    out.arc(state, reads, writes, max(weight, w), (to, then))
                    if (to, then) not in seen:
                        seen.add((to, then))
                        todo.append((to, then))
            out.arcs.setdefault(state, {}).setdefault(reads, [])  # a dead end, not an arc for ANY
    return out


class Table:
    """A deterministic transducer: ``table[state][symbol]`` is what is written,
    the weight, and the next state's number."""

    def __init__(self) -> None:
        self.start = 0
        self.table: list[dict[str, tuple[str, float, int]]] = []


def determinized(t: Transducer) -> Table:
    """The same by subsets of states. Raises ValueError where paths of one
    subset write different things for a symbol, or weigh differently, and for
    arcs for ANY in a subset of several states."""
    out, numbers = Table(), {frozenset(t.starts): 0}
    todo = [frozenset(t.starts)]
    out.table.append({})
    while todo:
        subset = todo.pop()
        if len(subset) > 1 and any(ANY in t.arcs.get(s, {}) for s in subset):
            raise ValueError("arcs for any symbol need a state of their own")
        for symbol in sorted({x for s in subset for x in t.arcs.get(s, {})}):
            arcs = [a for s in subset for a in t.arcs.get(s, {}).get(symbol, ())]
            if not arcs:
                continue
            if len({(writes, weight) for writes, weight, _ in arcs}) > 1:
                raise ValueError(f"paths write different things for {symbol!r}")
            then = frozenset(to for _, _, to in arcs)
            if then not in numbers:
                numbers[then] = len(out.table)
                out.table.append({})
                todo.append(then)
            out.table[numbers[subset]][symbol] = (arcs[0][0], arcs[0][1], numbers[then])
    return out
