"""Probabilistic automata inferred from example strings by merging statistically compatible states of their prefix tree."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

#: Confidence of the compatibility test, and the log-probability of a character that an automaton has not seen in a state.
ALPHA, UNSEEN = 0.05, math.log(1e-4)
_SYMBOLS = 128


class Automaton(NamedTuple):
    """Tables by state and character code; a state for strings that left the automaton comes last."""

    step: np.ndarray  # next state
    weight: np.ndarray  # log-probability of the character
    stop: np.ndarray  # log-probability of ending

    def likelihood(self, strings: list[str]) -> np.ndarray:
        """The mean log-probability per character (the end counts as one) of each string; other characters are unseen."""
        out = np.zeros(len(strings))
        if not strings:
            return out
        sizes = np.array([len(s) for s in strings])
        codes = np.minimum(np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32), _SYMBOLS - 1).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        state, total = np.zeros(len(strings), np.int64), np.zeros(len(strings))
        live, at = order, 0
        while len(live := live[sizes[live] > at]):
            code = codes[begin[live] + at]
            total[live] += self.weight[state[live], code]
            state[live] = self.step[state[live], code]
            at += 1
        return (total + self.stop[state]) / (sizes + 1)


def _differ(f1: int, n1: int, f2: int, n2: int, factor: float) -> bool:
    """Whether two relative frequencies are too far apart (Hoeffding bound)."""
    return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > factor * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def infer(strings: list[str], alpha: float = ALPHA) -> Automaton:
    """Learn from the strings (repeats count). States are settled from the root outwards, the most visited candidate first; a
    candidate is folded into the first settled state that it is compatible with, or becomes settled itself."""
    factor = math.sqrt(0.5 * math.log(2 / alpha))
    visits, ends, next_of = [0], [0], [{}]
    for s in strings:
        q = 0
        visits[0] += 1
        for c in s:
            if c not in next_of[q]:
                next_of[q][c] = len(visits)
                visits.append(0)
                ends.append(0)
                next_of.append({})
            q = next_of[q][c]
            visits[q] += 1
        ends[q] += 1
    count = [{c: visits[t] for c, t in edges.items()} for edges in next_of]

    def compatible(a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if _differ(ends[a], visits[a], ends[b], visits[b], factor):
                return False
            for c in count[a].keys() | count[b].keys():
                if _differ(count[a].get(c, 0), visits[a], count[b].get(c, 0), visits[b], factor):
                    return False
            # Below states of one visit nothing can be told apart.
            stack += [(next_of[a][c], next_of[b][c]) for c in next_of[a].keys() & next_of[b].keys() if min(count[a][c], count[b][c]) > 1]
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree below b to a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            visits[a] += visits[b]
            ends[a] += ends[b]
            for c, t in next_of[b].items():
                count[a][c] = count[a].get(c, 0) + count[b][c]
                if c in next_of[a]:
                    stack.append((next_of[a][c], t))
                else:
                    next_of[a][c] = t

    settled = [0]
    known = {0}
    while True:
        ahead = [(-count[q][c], k, c) for k, q in enumerate(settled) for c, t in next_of[q].items() if t not in known]
        if not ahead:
            break
        _, k, c = min(ahead)
        q, t = settled[k], next_of[settled[k]][c]
        for other in settled:
            if compatible(other, t):
                next_of[q][c] = other
                fold(other, t)
                break
        else:
            settled.append(t)
            known.add(t)

    place = {q: k for k, q in enumerate(settled)}
    lost = len(settled)
    step = np.full((lost + 1, _SYMBOLS), lost)
    weight = np.full((lost + 1, _SYMBOLS), UNSEEN)
    stop = np.full(lost + 1, UNSEEN)
    for q, k in place.items():
        if ends[q]:
            stop[k] = math.log(ends[q] / visits[q])
        for c, t in next_of[q].items():
            if ord(c) < _SYMBOLS - 1:
                step[k, ord(c)], weight[k, ord(c)] = place[t], math.log(count[q][c] / visits[q])
    return Automaton(step, weight, stop)
