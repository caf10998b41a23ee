"""Weighted finite-state transducers over a small alphabet of word kinds, and their composition.

A transducer reads a symbol and a mark (a tuple of flags set so far) and writes the mark on: state x symbol -> state, flags.
Composing two of them runs both on the same symbols, pairs their states and joins their flags. The composed machine has
one table, so a word costs one lookup however many transducers went into it.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Kinds of words. Insults and threats are scored; the others set the scene of their clause.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "other", "insult", "threat", "target", "negation", "report"
SYMBOLS = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT)


@dataclass(frozen=True)
class Transducer:
    """start: a state; step[(state, symbol)] = (next state, flags that hold for this symbol)."""

    start: object
    step: dict[tuple[object, str], tuple[object, frozenset[str]]]

    def compose(self, other: Transducer) -> Transducer:
        """The machine of both, with the pairs of states that can be reached."""
        start, step, open_ = (self.start, other.start), {}, [(self.start, other.start)]
        seen = {start}
        while open_:
            a, b = pair = open_.pop()
            for symbol in SYMBOLS:
                (a2, flags), (b2, more) = self.step[a, symbol], other.step[b, symbol]
                step[pair, symbol] = ((a2, b2), flags | more)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    open_.append((a2, b2))
        return Transducer(start, step)

    def numbered(self) -> Transducer:
        """The same machine with states 0 to n - 1, start first."""
        names = {self.start: 0}
        for state, _ in self.step:
            names.setdefault(state, len(names))
        return Transducer(0, {(names[s], x): (names[t], flags) for (s, x), (t, flags) in self.step.items()})


def within(opener: str, reach: int, flag: str) -> Transducer:
    """Sets flag on the `reach` symbols after an opener."""
    step = {}
    for left in range(reach + 1):
        for symbol in SYMBOLS:
            step[left, symbol] = (reach if symbol == opener else max(left - 1, 0), frozenset([flag] if left else []))
    return Transducer(0, step)


def after(opener: str, flag: str) -> Transducer:
    """Sets flag on every symbol after an opener."""
    return Transducer(0, {(s, x): (int(s or x == opener), frozenset([flag] if s else [])) for s in (0, 1) for x in SYMBOLS})


def grammar() -> Transducer:
    """Negation reaches three words, a target and a reporting verb to the end of their clause."""
    return within(NEGATION, 3, "negated").compose(after(REPORT, "reported")).compose(after(TARGET, "targeted")).numbered()
