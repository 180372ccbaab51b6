"""For programs that host sessions: the rule set in force, and a trace of the last events."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable, Iterable
from typing import Any

from ..model import RuleSet
from .kernel import Options, Session


class RuleSetHolder:
    """The rule set that new sessions get. Sessions that run keep theirs."""

    def __init__(self, rules: RuleSet):
        self._lock = threading.Lock()
        self._rules = rules

    @property
    def current(self) -> RuleSet:
        with self._lock:
            return self._rules

    def swap(self, rules: RuleSet) -> RuleSet:
        """Put another rule set in force; returns the one before."""
        with self._lock:
            before, self._rules = self._rules, rules
            return before

    def session(self, options: Options | None = None) -> Session:
        return Session(self.current, options)


class Trace:
    """A listener that keeps the last events, and hands each on to others."""

    def __init__(self, most: int = 256, others: Iterable[Callable[[str, Any], None]] = ()):
        self.events: deque[tuple[str, Any]] = deque(maxlen=most)
        self.others = tuple(others)

    def __call__(self, what: str, x: Any) -> None:
        self.events.append((what, x))
        for o in self.others:
            o(what, x)

    def firings(self) -> list[Any]:
        return [x for what, x in self.events if what == "fire"]


def replay(facts: Iterable[tuple[str, Any]], rules: RuleSet, options: Options | None = None) -> Session:
    """A new session of the facts that another one exported."""
    session = Session(rules, options)
    for fact, payload in facts:
        session.insert(fact, payload)
    return session
