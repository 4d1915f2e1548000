"""Chunks of one file: type shells, interfaces and members, merged where small and split where large."""

from __future__ import annotations

from .declarations import Decl, Source

FIELDS = ["seq", "chunk_type", "name", "content", "start_line", "end_line", "signature", "namespace", "class_name", "parent_context"]


def estimate(text: str) -> int:
    return len(text.split()) * 6 // 5


def _row(kind: str, name: str, content: str, lines: tuple[int, int], signature="", namespace="", class_name="", parent="") -> dict:
    return {"chunk_type": kind, "name": name, "content": content, "start_line": lines[0], "end_line": lines[1], "signature": signature, "namespace": namespace, "class_name": class_name, "parent_context": parent}


def stem(path: str) -> str:
    return path.replace("\\", "/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


def signature(s: Source, d: Decl) -> str:
    kind = [s.cut(d.type[0], d.type[1] - 1)] if d.type and d.kind != "constructor" else []
    params = s.cut(*d.params) if d.params else ""
    return " ".join(d.mods + kind + [d.name + (d.generics if d.kind == "method" else "") + params]).strip()


def logic(s: Source, d: Decl) -> bool:
    """Whether a property computes anything: an expression body, or an accessor with one."""
    if d.arrow:
        return True
    return d.body is not None and any(s.t[k] in ("{", "=>") for k in range(d.body[0] + 1, d.body[1]))


def _shell(s: Source, d: Decl, generated: bool) -> str:
    out = [whole for _, whole in s.usings]
    if out:
        out.append("")
    if d.namespace:
        out += [f"namespace {d.namespace};", ""] if d.file_scoped else [f"namespace {d.namespace}", "{"]
    docs = s.src[s.lead(d.first) : s.at[d.first]].rstrip()
    head = " ".join(x for x in (" ".join(d.mods), d.word, d.name + d.generics, d.base_text) if x)
    out += ([docs] if docs else []) + [head, "{"]
    for m in d.members:
        if m.kind in ("field", "enum") or (m.kind == "property" and not logic(s, m)):
            out.append("    " + s.full(m).strip())
        elif m.kind == "property" and generated:
            out.append(f"    {signature(s, m)} {{ get; set; }}")
    return "\n".join(out + ["}", ""])


def _prefix(s: Source, d: Decl, path: str, context: str) -> str:
    prefix = f"// File: {path}\n"
    prefix += f"// Namespace: {d.namespace}\n" if d.namespace else ""
    prefix += f"// Class: {context}\n"
    held = [s.full(f).strip() for f in d.members if f.kind == "field"]
    prefix += f"// Fields: {'; '.join(held[:5])}{'; ...' if len(held) > 5 else ''}\n" if held else ""
    return prefix + "\n"


def _member(s: Source, d: Decl, m: Decl, prefix: str, context: str, most: int) -> list[dict]:
    sig = signature(s, m)
    own = {"signature": sig, "namespace": d.namespace, "class_name": d.name, "parent": context}
    content = prefix + s.full(m)
    if estimate(content) > most and m.kind != "property" and m.body and not m.arrow:
        header = f"// Method signature: {sig}\n"
        budget = max(150, most - estimate(prefix) - estimate(header) - 20)
        groups: list[list] = []
        used = 0
        for a, b in s.statements(m):
            size = estimate(s.src[s.lead(a) : s.end(b)])
            if not groups or used + size > budget:
                groups.append([a, b])
                used = 0
            groups[-1][1] = b
            used += size
        if len(groups) > 1:
            n = len(groups)
            return [
                _row(m.kind, f"{m.name}~part{i}of{n}", f"{prefix}{header}// (part {i}/{n})\n{s.src[s.lead(a) : s.end(b)]}\n", (s.line(s.at[a]), s.line(s.end(b))), **own)
                for i, (a, b) in enumerate(groups, 1)
            ]
    return [_row(m.kind, m.name, content, (s.line(s.at[m.first]), s.line(s.end(m.last))), **own)]


def _merged(rows: list[dict], least: int) -> list[dict]:
    out: list[list[dict]] = []
    for r in rows:
        small = estimate(r["content"]) < least
        if small and out and estimate(out[-1][-1]["content"]) < least:
            out[-1].append(r)
        else:
            out.append([r])
    done = []
    for run in out:
        if len(run) > 1:
            a = run[0]
            run = [_row("members", "+".join(r["name"] for r in run), "\n\n".join(r["content"] for r in run), (a["start_line"], run[-1]["end_line"]), "", a["namespace"], a["class_name"], a["parent_context"])]
        done += run
    return done


def preview(text: str, words: int = 42) -> str:
    """The first words, with the white space between them."""
    end, n, inside = 0, 0, False
    for i, c in enumerate(text):
        if c.isspace():
            if inside and n == words:
                break
            inside = False
        else:
            n, inside, end = n + (not inside), True, i + 1
    return text if n < words or not text[end:].split() else text[:end]


def _overlapped(rows: list[dict], ceiling: int, marker: str) -> list[dict]:
    nxt = ([preview(r["content"]) for r in rows[1:]] + [None])[: len(rows)]
    return [r if p is None or estimate(r["content"]) >= ceiling else r | {"content": f"{r['content']}\n{marker}{p}"} for r, p in zip(rows, nxt, strict=True)]


def chunk(path: str, content: str | None, least: int = 50, most: int = 400, ceiling: int = 380, marker: str = "// next: ") -> list[dict]:
    """Chunks of a file in order. Blank text has none; text without types is one ``file`` chunk.

    Members of nested types stay within their outer type's text, and leading
    comments are taken once.
    """
    if not content or not content.strip():
        return []
    s = Source(content)
    rows: list[dict] = []
    for d in s.top:
        if d.kind != "type":
            continue
        lines = (s.line(s.at[d.first]), s.line(s.end(d.last)))
        if d.word == "interface":
            rows.append(_row("interface", d.name, s.full(d), lines, f"interface {d.name}{' ' if d.base_text else ''}{d.base_text}", d.namespace, d.name))
            continue
        context = f"{d.name}{d.generics} {d.base_text}".strip()
        prefix = _prefix(s, d, path, context)
        generated = path.lower().endswith(".generated.cs")
        rows.append(_row("class", d.name, _shell(s, d, generated), lines, "", d.namespace, d.name, context))
        members = [r for m in d.members if m.kind in ("constructor", "method") or (m.kind == "property" and logic(s, m) and not generated) for r in _member(s, d, m, prefix, context, most)]
        rows += _overlapped(_merged(members, least), ceiling, marker)
    if not rows:
        rows.append(_row("file", stem(path), content, (1, content.count("\n") + 1)))
    return [r | {"seq": i} for i, r in enumerate(rows)]
