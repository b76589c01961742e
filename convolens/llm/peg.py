"""Parsing-expression grammars, written as text.

``name <- expression`` is a rule that makes a node of the parse tree and may be recursive; ``name <~ expression`` is a
token: it can't be recursive and is compiled whole into one regular expression whose groups are atomic and whose
repetitions are possessive, which is exactly the meaning of a PEG's ordered choice and greedy repetition.

Expressions: ``'literal'``, ``"literal"`` (case ignored), ``[class]``, ``.``, ``name``, ``e1 e2``, ``e1 / e2``, ``e*``,
``e+``, ``e?``, ``e{2,5}``, ``&e``, ``!e``, ``( e )``, and in tokens ``label:e``, which keeps what e matched. ``^`` and
``$`` are the start and end of a line.
"""

from __future__ import annotations

import re

_LEX = re.compile(r"\s*(?:(#[^\n]*)|('(?:[^'\\]|\\.)*')|(\"(?:[^\"\\]|\\.)*\")|(\[(?:[^\]\\]|\\.)*\])|(\{\d+(?:,\d*)?\})|([A-Za-z_]\w*:(?!:))|([A-Za-z_]\w*)|(<-|<~|[/*+?&!().^$]))")
_KINDS = ("comment", "lit", "ilit", "cls", "count", "label", "name", "op")


class Node:
    """A rule's match: its name, where it lies, and its child nodes."""

    __slots__ = ("rule", "start", "end", "children")

    def __init__(self, rule, start, end, children):
        self.rule, self.start, self.end, self.children = rule, start, end, children


class Grammar:
    def __init__(self, text: str):
        self.rules: dict[str, tuple] = {}
        self.tokens: set[str] = set()
        toks = []
        at = 0
        text = text.strip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m or m.end() == at:
                raise ValueError(f"grammar: {text[at : at + 30]!r}")
            at = m.end()
            if m.lastindex != 1:
                toks.append((_KINDS[m.lastindex - 1], m[m.lastindex]))
        self._toks, self._i = toks, 0
        while self._i < len(toks):
            name, arrow = toks[self._i][1], toks[self._i + 1][1]
            self._i += 2
            if arrow == "<~":
                self.tokens.add(name)
            self.rules[name] = self._choice()
        self._compiled: dict[str, re.Pattern] = {}
        self._matchers = {}
        for name in self.rules:
            self._matchers[name] = self._token_matcher(name) if name in self.tokens else self._rule_matcher(name)

    # reading the grammar
    def _peek(self, k: int = 0):
        return self._toks[self._i + k] if self._i + k < len(self._toks) else ("end", "")

    def _choice(self):
        options = [self._sequence()]
        while self._peek() == ("op", "/"):
            self._i += 1
            options.append(self._sequence())
        return options[0] if len(options) == 1 else ("choice", options)

    def _sequence(self):
        items = []
        while True:
            kind, value = self._peek()
            if kind == "end" or (kind == "op" and value in "/)") or (kind == "name" and self._peek(1)[1] in ("<-", "<~")):
                return items[0] if len(items) == 1 else ("seq", items)
            items.append(self._item())

    def _item(self):
        kind, value = self._peek()
        self._i += 1
        if kind == "op" and value in "&!":
            return ("ahead" if value == "&" else "not", self._item())
        if kind == "label":
            return ("label", value[:-1], self._item())
        if kind == "op" and value == "(":
            e = self._choice()
            self._i += 1
        elif kind == "op":
            e = ({".": "any", "^": "bol", "$": "eol"}[value],)
        else:
            e = (kind, value)
        kind, value = self._peek()
        if kind == "count" or (kind == "op" and value in "*+?"):
            self._i += 1
            return ("rep", e, value)
        return e

    # tokens: to regular expressions
    def regex(self, e) -> str:
        kind = e[0]
        if kind == "lit":
            return re.escape(_plain(e[1]))
        if kind == "ilit":
            return f"(?i:{re.escape(_plain(e[1]))})"
        if kind == "cls":
            return e[1]
        if kind == "any":
            return r"[\s\S]"
        if kind == "bol":
            return r"(?m:^)"
        if kind == "eol":
            return r"(?m:$)"
        if kind == "name":
            if e[1] not in self.tokens:
                raise ValueError(f"token uses rule {e[1]}")
            return f"(?>{self.regex(self.rules[e[1]])})"
        if kind == "seq":
            return "".join(self.regex(x) for x in e[1])
        if kind == "choice":
            return "(?>" + "|".join(self.regex(x) for x in e[1]) + ")"
        if kind == "rep":
            return f"(?:{self.regex(e[1])}){e[2]}+"
        if kind == "label":
            return f"(?P<{e[1]}>{self.regex(e[2])})"
        return ("(?=" if kind == "ahead" else "(?!") + self.regex(e[1]) + ")"

    def token(self, name: str) -> re.Pattern:
        """The compiled regular expression of a token."""
        if name not in self._compiled:
            self._compiled[name] = re.compile(self.regex(self.rules[name]))
        return self._compiled[name]

    # rules: to functions (text, position, children) -> position or -1
    def _token_matcher(self, name):
        match = self.token(name).match

        def run(text, at, out):
            m = match(text, at)
            if m is None:
                return -1
            out.append(Node(name, at, m.end(), ()))
            return m.end()

        return run

    def _rule_matcher(self, name):
        body = self._matcher(self.rules[name])

        def run(text, at, out):
            children: list[Node] = []
            end = body(text, at, children)
            if end >= 0:
                out.append(Node(name, at, end, children))
            return end

        return run

    def _matcher(self, e):
        kind = e[0]
        if kind == "name":
            return lambda text, at, out: self._matchers[e[1]](text, at, out)
        if kind in ("lit", "ilit", "cls", "any", "bol", "eol"):
            match = re.compile(self.regex(e)).match
            return lambda text, at, out: m.end() if (m := match(text, at)) else -1
        if kind == "seq":
            parts = [self._matcher(x) for x in e[1]]

            def seq(text, at, out):
                mark = len(out)
                for p in parts:
                    at = p(text, at, out)
                    if at < 0:
                        del out[mark:]
                        return -1
                return at

            return seq
        if kind == "choice":
            options = [self._matcher(x) for x in e[1]]

            def choice(text, at, out):
                for o in options:
                    end = o(text, at, out)
                    if end >= 0:
                        return end
                return -1

            return choice
        if kind == "rep":
            inner = self._matcher(e[1])
            lo, hi = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(e[2]) or _bounds(e[2])

            def rep(text, at, out):
                n, mark = 0, len(out)
                while hi is None or n < hi:
                    end = inner(text, at, out)
                    if end < 0 or end == at:
                        break
                    at, n = end, n + 1
                if n < lo:
                    del out[mark:]
                    return -1
                return at

            return rep
        inner = self._matcher(e[1])
        wanted = kind == "ahead"
        return lambda text, at, out: at if (inner(text, at, []) >= 0) == wanted else -1

    def match(self, name: str, text: str, at: int = 0) -> Node | None:
        """The parse tree of rule ``name`` at a place of the text, or None."""
        out: list[Node] = []
        return out[0] if self._matchers[name](text, at, out) >= 0 else None


def _plain(quoted: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), quoted[1:-1])


def _bounds(count: str) -> tuple[int, int | None]:
    lo, _, hi = count[1:-1].partition(",")
    return int(lo), int(hi) if hi else (None if "," in count else int(lo))
