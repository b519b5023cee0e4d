"""Small weighted finite-state transducers in the (max, +) semiring.

A transducer reads symbols (any hashable values), writes one symbol for each and collects weights; where
several paths read the same string, its weight is that of the best accepting path.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Hashable, Iterable, Sequence
from functools import reduce

Symbol = Hashable
State = Hashable
NEVER = float("-inf")


class Transducer:
    """Start states, arcs (state, read) -> [(written, weight, next state)], weights of final states."""

    def __init__(self, starts: Iterable[State], arcs: dict[tuple[State, Symbol], list[tuple[Symbol, float, State]]], finals: dict[State, float]):
        self.starts, self.arcs, self.finals = tuple(starts), arcs, finals

    @classmethod
    def of(cls, starts: Iterable[State], finals: Iterable[State], alphabet: Iterable[Symbol], step: Callable[[State, Symbol], Iterable[tuple[Symbol, float, State]]]) -> Transducer:
        """The transducer of a step function, all states that the starts reach over the alphabet."""
        alphabet, todo = list(alphabet), list(starts)
        seen, arcs = set(todo), {}
        while todo:
            state = todo.pop()
            for read in alphabet:
                arcs[state, read] = list(step(state, read))
                for _, _, to in arcs[state, read]:
                    if to not in seen:
                        seen.add(to)
                        todo.append(to)
        return cls(starts, arcs, {s: 0.0 for s in finals})

    @property
    def written(self) -> set[Symbol]:
        return {out for found in self.arcs.values() for out, _, _ in found}

    def __matmul__(self, after: Transducer) -> Transducer:
        """Composition: what this one writes, ``after`` reads; weights add up."""
        reads = {read for _, read in self.arcs}

        def step(state, read):
            a, b = state
            for mid, w, to in self.arcs.get((a, read), ()):
                for out, v, then in after.arcs.get((b, mid), ()):
                    yield out, w + v, (to, then)

        both = Transducer.of([(a, b) for a in self.starts for b in after.starts], [], reads, step)
        both.finals = {(a, b): w + v for a, w in self.finals.items() for b, v in after.finals.items()}
        return both

    def weight(self, string: Sequence[Symbol]) -> float:
        """Weight of the best accepting path; minus infinity if there is none."""
        front = dict.fromkeys(self.starts, 0.0)
        for read in string:
            then: dict[State, float] = defaultdict(lambda: NEVER)
            for state, w in front.items():
                for _, v, to in self.arcs.get((state, read), ()):
                    then[to] = max(then[to], w + v)
            front = then
        return max((w + self.finals[s] for s, w in front.items() if s in self.finals), default=NEVER)


def composed(machines: Iterable[Transducer]) -> Transducer:
    return reduce(lambda a, b: a @ b, machines)


class Lexicon:
    """Deterministic transducer over the letters of one word: the largest weight of the words and stems it begins with.

    Stems are states with a loop on every letter, words are final only at the word's end.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.arcs: dict[tuple[int, str], int] = {}
        self.at_end: dict[int, float] = {}
        self.loop: dict[int, float] = {}
        n = 0
        for entries, where in ((words, self.at_end), (stems, self.loop)):
            for entry, weight in entries.items():
                state = 0
                for letter in entry:
                    if (state, letter) not in self.arcs:
                        n += 1
                        self.arcs[state, letter] = n
                    state = self.arcs[state, letter]
                where[state] = max(weight, where.get(state, 0.0))

    def weight(self, word: str) -> float:
        state, best = 0, self.loop.get(0, 0.0)
        for letter in word:
            state = self.arcs.get((state, letter), -1)
            if state < 0:
                return best
            best = max(best, self.loop.get(state, 0.0))
        return max(best, self.at_end.get(state, 0.0))
