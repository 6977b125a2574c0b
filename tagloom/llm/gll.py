"""A generalised LL parser: descriptors over a graph-structured stack, so that any context-free grammar may be used as it is."""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache


class Grammar:
    """Rules as ``{"Unit": [["Lead", "s"], ["s"]]}``: names that are keys are nonterminals, all others are one-character terminals."""

    def __init__(self, rules: dict[str, list[list[str]]], memo: int = 200_000):
        self.rules = {n: [tuple(a) for a in alts] for n, alts in rules.items()}
        self._look = self._lookahead()
        self.spans = lru_cache(maxsize=memo)(self._spans)

    def _lookahead(self) -> dict[tuple[str, str], list[int]]:
        """The alternatives of a nonterminal that the next character allows; an empty one only where none of the others can go on."""
        empty: set[str] = set()
        first: dict[str, set[str]] = {n: set() for n in self.rules}
        changed = True
        while changed:
            before = (len(empty), sum(map(len, first.values())))
            for n, alts in self.rules.items():
                for alt in alts:
                    for x in alt:
                        first[n] |= first.get(x, {x})
                        if x not in empty:
                            break
                    else:
                        empty.add(n)
            changed = before != (len(empty), sum(map(len, first.values())))
        out: dict[tuple[str, str], list[int]] = {}
        letters = {x for alts in self.rules.values() for a in alts for x in a if x not in self.rules} | {""}
        for n, alts in self.rules.items():
            for c in letters:
                fits = []
                for k, alt in enumerate(alts):
                    able: set[str] = set()
                    for x in alt:
                        able |= first.get(x, {x})
                        if x not in empty:
                            break
                    else:
                        able.add("")
                    if c in able or "" in able and (not alt or c not in first[n]):
                        fits.append(k)
                out[n, c] = fits
            out[n, "other"] = out[n, ""]
        return out

    def _spans(self, start: str, text: str, at: int = 0) -> frozenset[tuple[str, int, int]]:
        """Every (nonterminal, begin, end) that some derivation of ``start`` from ``at`` completed, whether or not the rest fits."""
        return frozenset((n, b, e) for (n, b), ends in self._parse(start, text, at).items() for e in ends)

    def _parse(self, start: str, text: str, at: int) -> dict[tuple[str, int], list[int]]:
        """Stack nodes (nonterminal, begin) with the ends that they reached.

        That is what recovery needs: a caller takes the longest completed part and goes on after what does not parse. A descriptor is (slot,
        stack node, position); stack nodes are (nonterminal, position) and share everything that was parsed from there; results that a node
        has already given are replayed to callers that come later. Left recursion and ambiguity are no trouble.
        """
        rules, look, end = self.rules, self._look, len(text)
        todo: list[tuple] = []
        seen: set[tuple] = set()
        callers: dict[tuple, list] = defaultdict(list)
        given: dict[tuple, list] = defaultdict(list)

        def call(name, i):
            node = (name, i)
            for k in look.get((name, text[i] if i < end else ""), None) or look[name, "other"]:
                todo.append((name, k, 0, node, i))

        callers[start, at] = []
        call(start, at)
        while todo:
            d = todo.pop()
            if d in seen:
                continue
            seen.add(d)
            name, k, dot, node, i = d
            alt = rules[name][k]
            n = len(alt)
            while dot < n:
                x = alt[dot]
                if x in rules:
                    child, back = (x, i), (name, k, dot + 1, node)
                    known = callers.get(child)
                    if known is None:
                        callers[child] = [back]
                        call(x, i)
                    elif back not in known:
                        known.append(back)
                        todo += [(*back, j) for j in given[child]]
                    break
                if i >= end or text[i] != x:
                    break
                i, dot = i + 1, dot + 1
            else:
                if i not in given[node]:
                    given[node].append(i)
                    todo += [(*back, i) for back in callers[node]]
        return given

    def longest(self, start: str, text: str, at: int = 0) -> int | None:
        """Where the longest ``start`` from ``at`` ends; None if there is none."""
        return max(self._parse(start, text, at).get((start, at), ()), default=None)
