"""Grammars as text: recognisers of token sequences, and the pairs of tokens that may stand side by side.

A grammar is a list of rules ``name: alternative | alternative``. Items are quoted tokens, names of rules, groups
``( )``, options ``[ ]``, ``*`` and ``+`` behind an item, and the lookaheads ``&item`` and ``!item``. Alternatives are tried in
order and the first that fits is taken; the results of rules are kept by position, so time is linear in the tokens for
the grammars used here.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

_ITEM = re.compile(r"'([^']+)'|([a-z_]\w*)|([|()\[\]*+&!])")

Node = tuple  # (kind, ...)


def parse(text: str) -> dict[str, Node]:
    """Rules by name."""
    rules: dict[str, Node] = {}
    for chunk in re.split(r"\n(?=\w+:)", text.strip()):
        name, body = chunk.split(":", 1)
        items = [m.groups() for m in _ITEM.finditer(body)]
        node, at = _choice(items, 0)
        if at != len(items):
            raise ValueError(f"rule {name} is not well formed")
        rules[name.strip()] = node
    return rules


def _choice(items: list, at: int) -> tuple[Node, int]:
    options = []
    while True:
        node, at = _sequence(items, at)
        options.append(node)
        if at < len(items) and items[at][2] == "|":
            at += 1
            continue
        return (options[0] if len(options) == 1 else ("or", options)), at


def _sequence(items: list, at: int) -> tuple[Node, int]:
    out = []
    while at < len(items) and items[at][2] not in ("|", ")", "]"):
        look = items[at][2] if items[at][2] in ("&", "!") else None
        if look:
            at += 1
        token, rule, mark = items[at]
        at += 1
        if token:
            node: Node = ("token", token)
        elif rule:
            node = ("rule", rule)
        else:
            node, at = _choice(items, at)
            at += 1  # the closing bracket
            if mark == "[":
                node = ("maybe", node)
        if at < len(items) and items[at][2] in ("*", "+"):
            node = ("star" if items[at][2] == "*" else "plus", node)
            at += 1
        out.append(("look", look, node) if look else node)
    return (out[0] if len(out) == 1 else ("seq", out)), at


class Recogniser:
    """Whether a rule derives a whole sequence of tokens."""

    def __init__(self, rules: dict[str, Node]):
        self.rules = rules
        self._made: dict[str, Callable] = {}
        self._memo: dict[tuple[str, int], int] = {}
        self._t: list[str] = []
        self._run = {name: self._compile(node) for name, node in rules.items()}

    def _compile(self, node: Node) -> Callable[[int], int]:
        """A function of a position that gives the position behind the node, or -1."""
        kind = node[0]
        if kind == "token":
            want = node[1]
            return lambda i: i + 1 if self._t[i] == want else -1
        if kind == "rule":
            name = node[1]

            def rule(i: int) -> int:
                key = (name, i)
                got = self._memo.get(key)
                if got is None:
                    got = self._memo[key] = self._run[name](i)
                return got

            return rule
        if kind == "seq":
            parts = [self._compile(n) for n in node[1]]

            def seq(i: int) -> int:
                for p in parts:
                    i = p(i)
                    if i < 0:
                        return -1
                return i

            return seq
        if kind == "or":
            if all(n[0] == "token" for n in node[1]):
                some = frozenset(n[1] for n in node[1])
                return lambda i: i + 1 if self._t[i] in some else -1
            options = [self._compile(n) for n in node[1]]

            def either(i: int) -> int:
                for p in options:
                    j = p(i)
                    if j >= 0:
                        return j
                return -1

            return either
        inner = self._compile(node[2] if kind == "look" else node[1])
        if kind == "maybe":
            return lambda i: j if (j := inner(i)) >= 0 else i
        if kind == "look":
            want = node[1] == "&"
            return lambda i: i if (inner(i) >= 0) == want else -1

        def many(i: int) -> int:
            n = 0
            while (j := inner(i)) >= 0:
                n += 1
                if j == i:
                    break
                i = j
            return i if n or kind == "star" else -1

        return many

    def derives(self, rule: str, tokens: list[str]) -> bool:
        self._t = [*tokens, ""]
        self._memo = {}
        depth = sys.getrecursionlimit()
        sys.setrecursionlimit(max(depth, 50_000))  # brackets nest up to 199 deep
        try:
            return self._run[rule](0) == len(tokens)
        finally:
            sys.setrecursionlimit(depth)
            self._memo = {}


def pairs(rules: dict[str, Node], starts: list[str]) -> set[tuple[str, str]]:
    """(token, token): all pairs that stand side by side in some sentence of the rules reached from ``starts``; lookaheads are ignored.

    First and last tokens of all rules, and whether a rule can be empty, are grown until they settle; every sequence then
    pairs the last tokens of a part with the first of what may follow.
    """
    empty: dict[str, bool] = dict.fromkeys(rules, False)
    first: dict[str, set[str]] = {r: set() for r in rules}
    last: dict[str, set[str]] = {r: set() for r in rules}
    out: set[tuple[str, str]] = set()

    def walk(node: Node) -> tuple[bool, set[str], set[str]]:
        kind = node[0]
        if kind == "token":
            return False, {node[1]}, {node[1]}
        if kind == "rule":
            return empty[node[1]], first[node[1]], last[node[1]]
        if kind == "look":
            return True, set(), set()
        if kind == "or":
            got = [walk(n) for n in node[1]]
            return any(g[0] for g in got), set().union(*(g[1] for g in got)), set().union(*(g[2] for g in got))
        if kind in ("maybe", "star", "plus"):
            e, f, l = walk(node[1])
            if kind != "maybe":
                out.update((x, y) for x in l for y in f)
            return e or kind != "plus", f, l
        e, f, l = True, set(), set()
        for n in node[1]:
            ne, nf, nl = walk(n)
            out.update((x, y) for x in l for y in nf)
            f = f | nf if e else f
            l = l | nl if ne else nl
            e = e and ne
        return e, f, l

    size = -1
    while size != (size := len(out) + sum(map(len, first.values())) + sum(map(len, last.values())) + sum(empty.values())):
        for name, node in rules.items():
            empty[name], first[name], last[name] = walk(node)
    seen, todo = set(), list(starts)
    while todo:  # rules that no start reaches say nothing
        r = todo.pop()
        if r not in seen:
            seen.add(r)
            todo += _named(rules[r])
    if set(rules) - seen:
        raise ValueError(f"rules never used: {sorted(set(rules) - seen)}")
    return out


def _named(node: Node) -> list[str]:
    if node[0] == "rule":
        return [node[1]]
    if node[0] in ("or", "seq"):
        return [x for n in node[1] for x in _named(n)]
    return [] if node[0] == "token" else _named(node[-1])
