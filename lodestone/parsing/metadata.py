"""Metadata fields of one file, as lists; the table operator joins them."""

from __future__ import annotations

from ..functions.text import SQL_KEYWORDS
from .declarations import BUILTIN, Decl, Source

# Field and separator (none: a single value).
FIELDS = {
    "file_type": None, "namespace": None, "class_name": None, "class_modifiers": None, "base_class": None,
    "interfaces": ", ", "class_names": " ", "property_names": " ", "properties": " | ", "method_names": " ",
    "constructors": " | ", "overridden_methods": " ", "abstract_methods": " ", "virtual_methods": " ", "async_methods": " ",
    "enum_values": " | ", "constants": " ", "static_fields": " ", "attributes": " ", "events": " ", "delegates": " ",
    "generic_types": " ", "referenced_types": " ", "dictionaries": " | ", "sql_operations": " ", "usings": " | ", "regions": " | ",
}
AFTER_TYPE_ARGUMENTS = frozenset("( ) ] } : ; , . ? == != | ^ && || & [ > {".split())


def _file_type(d: Decl | None) -> str:
    if d is None:
        return "other"
    if d.word == "class":
        return "static class" if "static" in d.mods else "abstract class" if "abstract" in d.mods else "class"
    return "record" if d.word == "record class" else d.word


def _interface(name: str) -> bool:
    return len(name) >= 2 and name[0] == "I" and name[1].isupper()


def _generics(s: Source):
    """(name token, token after the list) of every generic name in use, declared names left out."""
    for i in range(s.n - 1):
        if s.kind[i] == "name" and s.t[i + 1] == "<" and i not in s.declared:
            j = s.angle(i + 1)
            if j is not None and (s.tok(j) in AFTER_TYPE_ARGUMENTS or j >= s.n or s.is_name(j)):
                yield i, j


def _names(s: Source, a: int, b: int) -> set[str]:
    """Simple type names within tokens a to b, b excluded: the last part of dotted names, and type arguments; none of a tuple."""
    if s.tok(a) == "(":
        return set()
    return {s.t[k] for k in range(a, min(b, s.n)) if s.kind[k] == "name" and s.t[k] not in BUILTIN and s.tok(k + 1) not in (".", "::") and s.t[k] not in ("ref", "readonly", "scoped", "in", "out", "params", "this", "where", "new")}


def _referenced(s: Source, decls: list[Decl], generics: list[tuple[int, int]]) -> list[str]:
    out: set[str] = set()
    for d in decls:
        if d.type and d.kind in ("field", "method", "event"):
            out |= _names(s, *d.type)
        if d.params:
            for a, b in s._commas(d.params[0] + 1, min(d.params[1], s.n)):
                while a < b and (s.t[a] == "[" or s.t[a] in ("this", "ref", "out", "in", "params", "scoped")):
                    a = s.close[a] + 1 if s.t[a] == "[" else a + 1
                j = s.type_end(a)
                if j is not None and j < b:
                    out |= _names(s, a, j)
        for base in d.bases:
            x = Source(base)
            j = x.type_end(0)
            out |= _names(x, 0, j or x.n)
    for i, j in generics:
        out |= _names(s, i, j)
    for i in range(s.n):
        x = s.t[i]
        if s.kind[i] == "name" and x == "new" and s.is_name(i + 1):
            j = s.type_end(i + 1)
            out |= _names(s, i + 1, j) if j else set()
        elif x == "typeof" and s.tok(i + 1) == "(":
            out |= _names(s, i + 2, s.close[i + 1])
        elif x == "(" and s.kind[i] == "op" and s.close[i] < s.n and s.is_name(i + 1) and (i == 0 or s.kind[i - 1] == "op" and s.t[i - 1] not in (")", "]", ">") or s.t[i - 1] in ("return", "await", "throw")):
            j, after = s.type_end(i + 1), s.close[i] + 1
            if j == s.close[i] and after < s.n and (s.kind[after] in ("name", "number", "text") and s.t[after] not in ("is", "as", "switch", "with", "and", "or") or s.t[after] == "("):
                out |= _names(s, i + 1, j)
        elif s.kind[i] == "name" and x[0].isupper() and s.tok(i + 1) == "." and s.tok(i - 1) not in (".", "::", "using", "namespace", "static") and i not in s.declared:
            out.add(x)
    for d in decls:  # local variables
        if d.body and d.kind in ("method", "constructor", "property", "destructor", "operator", "indexer"):
            for k in range(d.body[0], min(d.body[1], s.n)):
                if s.t[k] in ("{", "}", ";", "(") and s.is_name(k + 1) and s.t[k + 1] not in ("return", "new", "throw", "else", "await", "yield", "goto", "case", "in", "using"):
                    j = s.type_end(k + 1)
                    if j is not None and s.is_name(j) and s.tok(j + 1) in ("=", ";", ","):
                        out |= _names(s, k + 1, j)
    return sorted(out)


def metadata(content: str | None) -> dict[str, list[str]]:
    """Every field as a list of its parts; blank text has empty lists."""
    if not content or not content.strip():
        return {f: [] for f in FIELDS}
    s = Source(content)
    decls = list(s.walk())
    types = [d for d in decls if d.kind == "type"]
    first = types[0] if types else None
    methods = [d for d in decls if d.kind == "method"]
    public = [d for d in decls if d.kind == "property" and "public" in d.mods]
    fields = [d for d in decls if d.kind == "field"]
    base = next((b for b in first.bases if not _interface(b)), "") if first else ""
    faces = list(first.bases) if first else []
    if base:
        faces.remove(base)
    unique = lambda xs: list(dict.fromkeys(xs))
    kinds = [d for d in decls if d.kind in ("type", "enum")]
    enums = {d.name: [x for x in d.names if x not in ("None", "Default")] for d in decls if d.kind == "enum"}
    generics = list(_generics(s))
    upper = content.upper()
    value = lambda x: [x] if x else []
    return {
        "file_type": [_file_type(kinds[0] if kinds else None)],
        "namespace": value(next((d.namespace for d in decls if d.namespace), "")),
        "class_name": value(first.name if first else ""),
        "class_modifiers": value(" ".join(first.mods) if first else ""),
        "base_class": value(base),
        "interfaces": faces,
        "class_names": unique(d.name for d in types),
        "property_names": unique(d.name for d in public),
        "properties": [f"{s.cut(d.type[0], d.type[1] - 1)} {d.name}" for d in public if d.type],
        "method_names": unique(d.name for d in methods),
        "constructors": [" ".join(d.mods + [d.name + (s.cut(*d.params) if d.params else "")]) for d in decls if d.kind == "constructor"],
        **{f"{label}_methods": unique(d.name for d in methods if mod in d.mods) for label, mod in (("overridden", "override"), ("abstract", "abstract"), ("virtual", "virtual"), ("async", "async"))},
        "enum_values": [f"{k}({','.join(v)})" for k, v in enums.items() if v],
        "constants": unique(n for d in fields if "const" in d.mods for n in d.names),
        "static_fields": unique(n for d in fields if "static" in d.mods and "const" not in d.mods for n in d.names),
        "attributes": unique(s.attributes),
        "events": unique([d.name for d in decls if d.kind == "event" and d.body] + [n for d in decls if d.kind == "event" and not d.body for n in d.names]),
        "delegates": unique(d.name for d in decls if d.kind == "delegate"),
        "generic_types": unique(s.t[i] for i, _ in generics),
        "referenced_types": _referenced(s, decls, generics),
        "dictionaries": unique(s.cut(i, s.angle(i + 1) - 1) for i, _ in generics if s.t[i] == "Dictionary"),
        "sql_operations": [k for k in SQL_KEYWORDS if k in upper],
        "usings": sorted({name for name, _ in s.usings}),
        "regions": [x for x in (d.replace("#region", "").strip() for d in s.directives if d.startswith("#region")) if x],
    }
