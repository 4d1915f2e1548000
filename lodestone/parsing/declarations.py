"""Declarations of C#-like source text, found by a lexer and one pass over its tokens.

No compiler is at hand, so this reads the shape of declarations only: names,
modifiers, types, parameters, bases, bodies. Statements are told apart where
a body is split. Not understood: conditional compilation (all branches are
read), top-level statements (skipped), and unbalanced brackets (the rest of
their scope is taken as their content).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""(?P<space>\s+)
    |(?P<directive>\#[^\n]*)
    |(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<text>\$*(?P<q>"{3,}).*?(?P=q)
        |(?:\$@|@\$|@)"(?>[^"]|"")*+"
        |\$"(?>\\.|\{[^{}"\n]*(?:"(?>\\.|[^"\\\n])*"[^{}"\n]*)*+\}|[^"\\\n])*+"
        |"(?>\\.|[^"\\\n])*+"
        |'(?>\\.|[^'\\\n])++')
    |(?P<name>@?[^\W\d]\w*)
    |(?P<number>\d[\w.]*)
    |(?P<op>=>|::|\?\?=|\?\?|&&|\|\||\+\+|--|[=!<>]=|.)""",
    re.S | re.X,
)
# Fixed values.
MODIFIERS = frozenset("public private protected internal static abstract virtual override sealed async readonly const partial extern unsafe volatile new required file global".split())
TYPE_WORDS = frozenset("class struct interface record".split())
BUILTIN = frozenset("bool byte sbyte char decimal double float int uint nint nuint long ulong object short ushort string void".split())
OPEN = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Decl:
    kind: str
    name: str
    first: int
    last: int = 0
    mods: list[str] = field(default_factory=list)
    type: tuple[int, int] | None = None
    params: tuple[int, int] | None = None
    generics: str = ""
    bases: list[str] = field(default_factory=list)
    base_text: str = ""
    names: list[str] = field(default_factory=list)
    body: tuple[int, int] | None = None
    arrow: bool = False
    namespace: str = ""
    file_scoped: bool = False
    word: str = ""
    members: list["Decl"] = field(default_factory=list)


class Source:
    """Tokens of one text and the declarations found in them."""

    def __init__(self, content: str):
        self.src = content
        self.t: list[str] = []
        self.kind: list[str] = []
        self.at: list[int] = []
        self.directives: list[str] = []
        self.comments: dict[int, list[int]] = {}
        for m in TOKEN.finditer(content):
            k = m.lastgroup if m.lastgroup != "q" else "text"
            if k in ("name", "number", "op", "text"):
                self.t.append(m.group())
                self.kind.append(k)
                self.at.append(m.start())
            elif k == "directive":
                self.directives.append(m.group())
            elif k == "comment":
                self.comments.setdefault(len(self.t), []).append(m.start())
        self.n = len(self.t)
        self.breaks = [m.start() for m in re.finditer("\n", content)]
        self.close = self._brackets()
        self.usings: list[tuple[str, str]] = []
        self.attributes: list[str] = []
        self.declared: set[int] = set()
        self.angles: dict[int, int | None] = {}
        self.top: list[Decl] = []
        self._scope(0, self.n, "", False, None, self.top)

    # ---- text of token ranges

    def end(self, i: int) -> int:
        return self.at[i] + len(self.t[i]) if i < self.n else len(self.src)

    def cut(self, a: int, b: int) -> str:
        """Source text of tokens a to b, b included."""
        return self.src[self.at[a] : self.end(b)] if a <= b and a < self.n else ""

    def lead(self, i: int) -> int:
        """Where the comments that belong to token i begin: those on lines after the token before it."""
        line = self.src.find("\n", self.end(i - 1)) if i else -1
        mine = [p for p in self.comments.get(i, ()) if i == 0 or (line >= 0 and p > line)]
        return mine[0] if mine else self.at[i]

    def line(self, offset: int) -> int:
        return bisect_left(self.breaks, offset) + 1

    def full(self, d: Decl) -> str:
        return self.src[self.lead(d.first) : self.end(d.last)]

    # ---- brackets and types

    def _brackets(self) -> list[int]:
        close, stack = [self.n] * self.n, []
        for i, (x, k) in enumerate(zip(self.t, self.kind, strict=True)):
            if k != "op":
                continue
            if x in OPEN:
                stack.append(i)
            elif x in ")]}":
                while stack and OPEN[self.t[stack[-1]]] != x:
                    stack.pop()
                if stack:
                    close[stack.pop()] = i
        return close

    def is_name(self, i: int) -> bool:
        return i < self.n and self.kind[i] == "name"

    def tok(self, i: int) -> str:
        return self.t[i] if 0 <= i < self.n else ""

    def angle(self, i: int) -> int | None:
        """The token after a type argument list that begins at i.

        One scan settles every list within it, so text full of "<" costs one pass.
        """
        if i not in self.angles:
            lists, k = [], i
            while k < self.n:
                x = self.t[k]
                if x == "<":
                    lists.append(k)
                elif x == ">":
                    self.angles[lists.pop()] = k + 1
                    if not lists:
                        break
                elif x in ("(", "["):
                    k = self.close[k]
                elif not (self.kind[k] == "name" or x in (",", ".", "?", "::", "*")):
                    break
                k += 1
            self.angles.update(dict.fromkeys(lists))
        return self.angles[i]

    def type_end(self, i: int) -> int | None:
        """The token after a type that begins at i."""
        while self.tok(i) in ("ref", "readonly", "scoped"):
            i += 1
        if self.tok(i) == "(":
            i = self.close[i] + 1
        elif self.is_name(i):
            while True:
                i += 1
                if self.tok(i) == "<":
                    j = self.angle(i)
                    if j is None:
                        return None
                    i = j
                if self.tok(i) in (".", "::") and self.is_name(i + 1):
                    i += 1
                else:
                    break
        else:
            return None
        while self.tok(i) in ("?", "*", "[") and not (self.tok(i) == "[" and self.close[i] >= self.n):
            i = self.close[i] + 1 if self.t[i] == "[" else i + 1
        return i

    # ---- declarations

    def _scope(self, i: int, end: int, ns: str, scoped: bool, owner: Decl | None, out: list[Decl]) -> None:
        while i < end:
            if self.t[i] in (";", "}", ")", "]"):
                i += 1
                continue
            first = i
            while self.tok(i) == "[" and i < end:
                self._attributes(i)
                i = self.close[i] + 1
            mods = []
            while i < end and self.t[i] in MODIFIERS and not (self.t[i] == "file" and self.tok(i + 1) in ("=", ";")):
                mods.append(self.t[i])
                i += 1
            if i >= end:
                return
            x = self.t[i]
            if owner is None and x in ("using", "extern"):
                i = self._using(i, end, first)
            elif owner is None and x == "namespace":
                stop = i
                while stop < end and self.t[stop] not in ("{", ";"):
                    stop += 1
                self.declared.update(range(i, stop))
                name = ".".join(p for p in (ns, self.cut(i + 1, stop - 1)) if p)
                if stop < end and self.t[stop] == "{":
                    last = min(self.close[stop], end)
                    self._scope(stop + 1, last, name, False, None, out)
                    i = last + 1
                else:
                    ns, scoped, i = name, True, stop + 1
            else:
                d = Decl("", "", first, mods=mods, namespace=ns, file_scoped=scoped)
                record = x == "record" and (self.is_name(i + 1))
                if (x in TYPE_WORDS and x != "record") or record:
                    i = self._type(i, end, d)
                elif x == "enum":
                    i = self._enum(i, end, d)
                elif x == "delegate" and self.tok(i + 1) != "*":
                    i = self._delegate(i, end, d)
                else:
                    i = self._member(i, end, d, owner)
                if d.kind and (owner is not None or d.kind in ("type", "enum", "delegate")):
                    out.append(d)
            i = max(i, first + 1)

    def _attributes(self, i: int) -> None:
        stop, k = min(self.close[i], self.n), i + 1
        if self.is_name(k) and self.tok(k + 1) == ":":
            k += 2
        while k < stop:
            a = k
            while k < stop and (self.kind[k] == "name" or self.t[k] in (".", "::")):
                k += 1
            if k > a:
                self.attributes.append(self.cut(a, k - 1))
            while k < stop and self.t[k] != ",":
                k = self.close[k] + 1 if self.t[k] in OPEN else k + 1
            k += 1

    def _using(self, i: int, end: int, first: int) -> int:
        stop = i
        while stop < end and self.t[stop] != ";":
            stop = self.close[stop] + 1 if self.t[stop] in OPEN else stop + 1
        stop = min(stop, end - 1)
        self.declared.update(range(i, stop))
        if self.t[i] == "using" and self.tok(i + 1) not in ("(", "var", "await"):
            a = i + 2 if self.tok(i + 1) in ("static", "unsafe") else i + 1
            if self.tok(a + 1) == "=":
                a += 2
            self.usings.append((self.cut(a, stop - 1), self.cut(first, stop)))
        return stop + 1

    def _commas(self, a: int, b: int) -> list[tuple[int, int]]:
        """Ranges between the commas of tokens a to b, b excluded, outside brackets and type arguments."""
        parts, k, start = [], a, a
        while k < b:
            if self.t[k] in OPEN:
                k = self.close[k]
            elif self.t[k] == "<":
                j = self.angle(k)
                k = j - 1 if j is not None else k
            elif self.t[k] == ",":
                parts.append((start, k))
                start = k + 1
            k += 1
        return parts + ([(start, b)] if b > start else [])

    def _type(self, i: int, end: int, d: Decl) -> int:
        d.kind, d.word = "type", self.t[i]
        i += 1
        if d.word == "record" and self.tok(i) in ("class", "struct"):
            d.word += " " + self.t[i]
            i += 1
        d.name = self.tok(i)
        self.declared.add(i)
        i += 1
        if self.tok(i) == "<":
            j = self.angle(i) or i + 1
            d.generics, i = self.cut(i, j - 1), j
        if self.tok(i) == "(":
            d.params = (i, self.close[i])
            i = self.close[i] + 1
        stop = i
        where = None
        while stop < end and self.t[stop] not in ("{", ";"):
            if self.t[stop] == "where" and where is None:
                where = stop
            stop = self.close[stop] + 1 if self.t[stop] in "([" else stop + 1
        if self.tok(i) == ":":
            b = min(where or stop, end)
            d.bases = [self.cut(p, q - 1) for p, q in self._commas(i + 1, b)]
            d.base_text = self.cut(i, b - 1)
        if stop < end and self.t[stop] == "{":
            last = min(self.close[stop], end)
            d.body = (stop, last)
            self._scope(stop + 1, last, d.namespace, d.file_scoped, d, d.members)
            stop = last
        d.last = min(stop, self.n - 1)
        return stop + 1

    def _enum(self, i: int, end: int, d: Decl) -> int:
        d.kind, d.word, d.name = "enum", "enum", self.tok(i + 1)
        stop = i
        while stop < end and self.t[stop] not in ("{", ";"):
            stop += 1
        if stop < end and self.t[stop] == "{":
            last = min(self.close[stop], end)
            for a, b in self._commas(stop + 1, last):
                while a < b and self.t[a] == "[":
                    self._attributes(a)
                    a = self.close[a] + 1
                if a < b and self.is_name(a):
                    d.names.append(self.t[a])
            stop = last
        d.last = min(stop, self.n - 1)
        return stop + 1

    def _delegate(self, i: int, end: int, d: Decl) -> int:
        j = self.type_end(i + 1)
        stop = i
        while stop < end and self.t[stop] != ";":
            stop = self.close[stop] + 1 if self.t[stop] in OPEN else stop + 1
        d.last = min(stop, self.n - 1)
        if j is not None and self.is_name(j):
            d.kind, d.name, d.type = "delegate", self.t[j], (i + 1, j)
            self.declared.add(j)
            k = (self.angle(j + 1) or j + 1) if self.tok(j + 1) == "<" else j + 1
            if self.tok(k) == "(":
                d.params = (k, self.close[k])
        return stop + 1

    def _member(self, i: int, end: int, d: Decl, owner: Decl | None) -> int:
        event = self.t[i] == "event"
        i += event
        k = i
        if i >= end:
            return i
        if self.t[i] == "~":
            d.kind, d.name, k = "destructor", self.tok(i + 1), i + 2
        elif owner is not None and self.t[i] == owner.name and self.tok(i + 1) == "(":
            d.kind, d.name, k = "constructor", self.t[i], i + 1
        elif self.t[i] in ("implicit", "explicit"):
            d.kind, d.name = "operator", "operator"
        else:
            j = self.type_end(i)
            if j is not None and j < end:
                d.type, k = (i, j), j
                if self.t[j] == "operator":
                    d.kind, d.name = "operator", "operator"
                elif self.t[j] == "this":
                    d.kind, d.name = "indexer", "this"
                elif self.is_name(j):
                    while True:
                        name, k = k, k + 1
                        if self.tok(k) == "<":
                            g = self.angle(k)
                            if g is not None:
                                d.generics, k = self.cut(k, g - 1), g
                        if self.tok(k) in (".", "::") and self.is_name(k + 1):
                            k, d.generics = k + 1, ""
                        else:
                            break
                    d.name = self.t[name]
                    self.declared.add(name)
                    if self.tok(name - 1) == "." and self.tok(name + 1) != "(" and self.tok(k) == "[":
                        d.kind = "indexer"
                    else:
                        d.kind = {"(": "method", "{": "property", "=>": "property"}.get(self.tok(k), "field")
                    d.kind = "event" if event else d.kind
                    if d.kind in ("field", "event"):
                        d.names = [d.name]
        if self.tok(k) == "(" and d.kind in ("constructor", "method", "destructor"):
            d.params = (k, self.close[k])
            k = self.close[k] + 1
        while k < end:
            x = self.t[k]
            if x == ";":
                break
            if x == "," and d.kind in ("field", "event") and self.is_name(k + 1) and self.tok(k + 2) in (",", ";", "="):
                d.names.append(self.t[k + 1])
            if x == "=>" and d.kind in ("method", "property", "constructor", "indexer", "operator", "destructor"):
                d.arrow = True
            if x == "{" and not d.arrow and d.kind != "field" and d.body is None:
                d.body = (k, min(self.close[k], end))
                k = self.close[k]
                if not (d.kind == "property" and self.tok(k + 1) == "="):
                    break
            elif x in OPEN:
                k = self.close[k]
            k += 1
        d.last = min(k, end - 1, self.n - 1)
        return k + 1

    # ---- walks

    def walk(self, decls: list[Decl] | None = None):
        for d in self.top if decls is None else decls:
            yield d
            yield from self.walk(d.members)

    def statements(self, d: Decl) -> list[tuple[int, int]]:
        """Token ranges of the whole statements of a block body."""
        out, k, stop = [], d.body[0] + 1, d.body[1]
        start = k
        while k < stop:
            done = False
            if self.t[k] == ";":
                done = True
            elif self.t[k] in OPEN:
                block = self.t[k] == "{"
                k = min(self.close[k], stop - 1)
                after = self.tok(k + 1)
                loop = after == "while" and self.t[start] == "do"
                done = block and not loop and (k + 1 >= stop or after not in ("else", "catch", "finally", ")", ",", ";", ".", "?", "??", "=>", "[", "("))
            if done:
                out.append((start, k))
                start = k + 1
            k += 1
        return out + ([(start, stop - 1)] if start < stop else [])
