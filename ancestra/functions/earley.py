"""Weighted context-free grammars over text, parsed without a separate lexer after Earley.

Terminals are regular expressions matched where they are predicted. Rule
weights add up; of several parses of a span the one with the highest sum
is kept. Items wait per end position, so left recursion is no problem;
empty rules aren't allowed.

The alternatives of the start symbol are parsed one by one, those with the highest possible score
first. One is passed over if no terminal it can begin with matches at the start of the text, or if even its
highest possible score is no better than a parse at hand; neither changes the result. Nor does it that symbols with
one rule are written out where they stand, and terminals in a row become one pattern of atomic groups.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field


@dataclass
class Part:
    """A symbol with the name of its field or None, or a terminal's ``pattern`` with (group, name) of its ``fields`` and the number of groups that stand for terminals in a row."""

    symbol: str
    name: str | None = None
    pattern: re.Pattern | None = None
    fields: tuple[tuple[int, str], ...] = ()
    groups: int = 0


@dataclass(eq=False)
class Rule:
    head: str
    label: str
    weight: float
    parts: list[Part] = field(default_factory=list)


def _joined(parts: list[Part]) -> list[Part]:
    """Terminals in a row as one."""
    out: list[Part] = []
    run: list[Part] = []
    for p in [*parts, Part("")]:
        if p.pattern is not None and not p.pattern.groups:
            run.append(p)
            continue
        if len(run) > 1:
            names = tuple((i + 1, x.name) for i, x in enumerate(run) if x.name)
            out.append(Part("", None, re.compile("".join(f"((?>{x.pattern.pattern}))" for x in run)), names, len(run)))
        else:
            out += run
        run = []
        out.append(p)
    return out[:-1]


class Grammar:
    """Rules as text, one a line: ``Head -> part part ... ; weight``.

    A part is a nonterminal, ``/regex/`` or ``name=/regex/`` or
    ``name=Nonterminal``; named parts are the fields of a parse. Alternatives
    stand on lines of their own. ``#`` starts a comment line.
    """

    def __init__(self, text: str, start: str):
        self.start = start
        self.rules: dict[str, list[Rule]] = {}
        for line in text.splitlines():
            if not (line := line.strip()) or line.startswith("#"):
                continue
            left, right = line.split(" -> ", 1)
            right, _, weight = right.rpartition(" ; ")
            body = re.findall(r"(?:\w+=)?/(?:[^/\\]|\\.)+/|\S+", right)
            rule = Rule(left, body[0], float(weight))
            for part in body:
                name, eq, what = part.partition("=") if re.match(r"\w+=", part) else ("", "", part)
                pattern = re.compile(what[1:-1].replace("\\/", "/")) if what.startswith("/") else None
                rule.parts.append(Part(what, name if eq else None, pattern, ((0, name),) if eq else ()))
            self.rules.setdefault(left, []).append(rule)
        self._write_out()
        highest = dict.fromkeys(self.rules, float("-inf"))
        bound = lambda r: r.weight + sum(highest[p.symbol] for p in r.parts if p.pattern is None)
        for _ in range(len(self.rules) + 1):  # a rule can't raise its own symbol's highest score unless weights are positive
            highest = {k: max(map(bound, rs)) for k, rs in self.rules.items()}
        if any(max(map(bound, rs)) > highest[k] for k, rs in self.rules.items()):
            raise ValueError("scores without bound")
        order = sorted(self.rules[start], key=lambda r: -bound(r))
        self.alternatives = [(bound(r), self._first(r), r) for r in order]

    def _write_out(self) -> None:
        """Replace symbols that have one rule, not of themselves, by its parts (a named one only by a single unnamed terminal), then join terminals."""
        for k in self.rules:
            own = self.rules[k]
            if k == self.start or len(own) > 1 or any(p.symbol == k for p in own[0].parts):
                continue
            one = own[0]
            for r in (r for rs in self.rules.values() for r in rs if r is not one):
                parts: list[Part] = []
                for p in r.parts:
                    if p.pattern is not None or p.symbol != k:
                        parts.append(p)
                    elif p.name is None:
                        parts += one.parts
                        r.weight += one.weight
                    elif len(one.parts) == 1 and one.parts[0].pattern is not None and one.parts[0].name is None:
                        parts.append(Part(one.parts[0].symbol, p.name, one.parts[0].pattern, ((0, p.name),)))
                        r.weight += one.weight
                    else:
                        parts.append(p)
                r.parts = parts
        for rs in self.rules.values():
            for r in rs:
                r.parts = _joined(r.parts)

    def _first(self, rule: Rule) -> re.Pattern:
        """A pattern that matches wherever one of the terminals does that the rule can begin with."""
        seen, todo, out = {id(rule)}, [rule], []
        while todo:
            p = todo.pop().parts[0]
            if p.pattern is not None:
                out.append(p.pattern.pattern)
            for r in self.rules[p.symbol] if p.pattern is None else ():
                if id(r) not in seen:
                    seen.add(id(r))
                    todo.append(r)
        return re.compile("|".join(f"(?:{x})" for x in dict.fromkeys(out)))

    def parse(self, text: str) -> tuple[float, str, list[tuple[str, int, int]]] | None:
        """(score, alternative of the start symbol, fields as (name, from, to)) of the best parse of all of ``text``; None if there is none."""
        best = None
        for bound, first, rule in self.alternatives:
            if best is not None and bound <= best[0]:
                break
            if first.match(text) and (got := self._parse(rule, text)) and (best is None or got[0] > best[0]):
                best = got[0], rule.label, got[1]
        if best is None:
            return None
        fields: list[tuple[str, int, int]] = []
        stack = [best[2]]
        while stack:
            node = stack.pop()
            if node is None:
                continue
            if len(node) == 2:  # (inner, earlier)
                stack.append(node[1])
                node = node[0]
            if node is None:
                continue
            own, _, deeper = node
            if own:
                fields.append(own)
            stack.append(deeper)
        return best[0], best[1], sorted(fields, key=lambda f: (f[1], -f[2]))

    def _parse(self, start: Rule, text: str) -> tuple | None:
        """(score, trace) of the best parse of all of ``text`` by one rule; the trace is a linked list of fields."""
        n, rules = len(text), self.rules
        # chart[end] maps (rule, dot, origin) to (score, trace)
        now, item = 0, (start, 0, 0)
        chart: dict[int, dict] = {0: {item: (start.weight, None)}}
        waiting: dict[tuple[int, str], list] = {}
        complete: dict[tuple[int, str], dict[int, tuple]] = {}
        heap = [0]
        best = None
        while heap:
            now = heapq.heappop(heap)
            own = chart[now]
            agenda = list(own)
            while agenda:
                item = agenda.pop()
                rule, dot, origin = item
                score, trace = own[item]
                if dot == len(rule.parts):
                    if rule is start and origin == 0 and now == n and (best is None or score > best[0]):
                        best = (score, trace)
                    known = complete.setdefault((origin, rule.head), {})
                    if now in known and known[now][0] >= score:
                        continue
                    known[now] = (score, trace)
                    for w_item, w_score, w_trace in waiting.get((origin, rule.head), ()):
                        name = w_item[0].parts[w_item[1]].name
                        inner = ((name, origin, now), None, trace) if name else (None, None, trace)
                        new, total = (w_item[0], w_item[1] + 1, w_item[2]), w_score + score
                        old = own.get(new)
                        if old is None or total > old[0]:
                            own[new] = (total, (inner, w_trace))
                            agenda.append(new)
                    continue
                part = rule.parts[dot]
                if part.pattern is not None:
                    m = part.pattern.match(text, now)
                    if m is None or ((end := m.end()) == now and now < n):
                        continue
                    if part.groups and any(a == b and a < n for a, b in m.regs[1:]):
                        continue
                    got = trace
                    for group, name in part.fields:
                        got = (((name, *m.regs[group]), None, None), got)
                    there = chart.get(end)
                    if there is None:
                        there = chart[end] = {}
                        heapq.heappush(heap, end)
                    new = (rule, dot + 1, origin)
                    old = there.get(new)
                    if old is None or score > old[0]:
                        there[new] = (score, got)
                        if end == now:
                            agenda.append(new)
                    continue
                name, what = part.name, part.symbol
                at = waiting.get((now, what))
                if at is None:
                    at = waiting[now, what] = []
                    for r in rules[what]:
                        new = (r, 0, now)
                        own[new] = (r.weight, None)
                        agenda.append(new)
                at.append((item, score, trace))
                for end, (s, t) in list(complete.get((now, what), {}).items()):
                    inner = ((name, now, end), None, t) if name else (None, None, t)
                    there = chart.get(end)
                    if there is None:
                        there = chart[end] = {}
                        heapq.heappush(heap, end)
                    new = (rule, dot + 1, origin)
                    old = there.get(new)
                    if old is None or score + s > old[0]:
                        there[new] = (score + s, (inner, trace))
                        if end == now:
                            agenda.append(new)
        return best
