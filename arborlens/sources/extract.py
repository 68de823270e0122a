"""Declarations, imports and exports of source files in five languages.

A file is masked first: comments and the inside of strings become blanks of the
same length, so offsets stay and brackets in strings do not count. Then a
scanner walks the declarations at the outermost level and the members of
classes, traits and impl blocks; bodies are skipped by matching brackets (by
indentation in Python). Incomplete code loses what cannot be read, not the file.

Everything runs in Arrow batches over the scan and returns one tagged union,
from which ``extract`` gives four tables.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_C_LIKE = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_MASKS = {
    "py": re.compile(r'#[^\n]*|(?:"""|\'\'\').*?(?:"""|\'\'\'|\Z)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S),
    "ts": re.compile(_C_LIKE + r'|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`', re.S),
    "rs": re.compile(_C_LIKE + r'|r#+".*?"#+|r?"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])\'', re.S),
    "go": re.compile(_C_LIKE + r'|"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n])+\'', re.S),
}
GRAMMAR_BY_EXTENSION = {"ts": "ts", "tsx": "ts", "js": "ts", "jsx": "ts", "mjs": "ts", "cjs": "ts", "rs": "rs", "py": "py", "go": "go"}


@dataclass
class Found:
    """What one file declares; ``path`` is the qualifier of its symbols."""

    path: str
    text: str
    masked: str
    symbols: list[dict] = field(default_factory=list)
    edges: list[tuple[str, str, str]] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    exports: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.line_starts = [0, *(m.end() for m in re.finditer("\n", self.text))]

    def place(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.line_starts, at)
        return line, at - self.line_starts[line - 1]

    def line(self, at: int) -> int:
        return self.place(at)[0]

    def add(self, name: str, kind: str, start: int, end: int, *, parent: str | None = None, contained: bool = True, **more) -> str:
        """Record a symbol and its structural edges; returns its qualified name."""
        qualified = f"{self.path}::{parent + '.' if parent else ''}{name}"
        (line_start, col_start), (line_end, col_end) = self.place(start), self.place(max(start, end))
        row = {"visibility": "private", "is_exported": False, "is_async": False, "is_test": False, "decorators": [], "signature": None}
        row |= {"qualified_name": qualified, "name": name, "kind": kind, "file_path": self.path, "line_start": line_start, "line_end": line_end}
        self.symbols.append(row | {"col_start": col_start, "col_end": col_end} | more)
        if contained:
            self.edges.append(("contains", self.path, qualified))
        if parent:
            self.edges.append(("child_of", qualified, f"{self.path}::{parent}"))
        return qualified


def mask(text: str, grammar: str) -> str:
    """Comments and string contents as blanks, quotes and line ends kept."""

    def blank(m: re.Match) -> str:
        inner = re.sub(r"[^\n]", " ", m[0])
        return m[0][0] + inner[1:-1] + m[0][-1] if m[0][0] in "\"'`" and len(m[0]) > 1 else inner

    return _MASKS[grammar].sub(blank, text)


def closing(masked: str, at: int) -> int:
    """Offset of the bracket that closes the one at ``at``; the end of the text if there is none."""
    pairs, depth = {"(": ")", "[": "]", "{": "}"}, []
    for m in re.compile(r"[()\[\]{}]").finditer(masked, at):
        if m[0] in pairs:
            depth.append(pairs[m[0]])
        elif depth and m[0] == depth[-1]:
            depth.pop()
            if not depth:
                return m.start()
    return len(masked)


def _statement_end(masked: str, at: int) -> int:
    """End of a declaration from ``at``: past its braces, or at ``;``, or at a line end outside brackets."""
    i = at
    while i < len(masked):
        c = masked[i]
        if c == "{":
            return closing(masked, i)
        if c in "([":
            i = closing(masked, i)
        elif c == ";" or (c == "\n" and not masked[at:i].rstrip().endswith(("=", ",", "=>", "|", "&", "+"))):
            return i
        i += 1
    return len(masked) - 1


# --- Python -----------------------------------------------------------------

_PY = re.compile(r"^([ \t]*)(?:(async)[ \t]+)?(def|class)[ \t]+(\w+)[ \t]*|^(\w+)[ \t]*(?::[^=\n]+)?=(?!=)|^([ \t]*)(@[^\n]+)", re.M)
_PY_IMPORT = re.compile(r"^([ \t]*)(?:import[ \t]+([^\n]+)|from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]+(\([^)]*\)|[^\n]+))", re.M)


def _py_end(found: Found, start: int, indent: int) -> int:
    """Last character of a block that begins at ``start`` with ``indent`` columns."""
    line = found.line(start)
    last, at = start, found.masked.find("\n", start)
    head = re.compile(r"[^\n]*?\(").match(found.masked, start)
    if head:
        at = found.masked.find("\n", closing(found.masked, head.end() - 1))
    last = (at if at >= 0 else len(found.masked)) - 1
    for number in range(found.line(max(last, start)), len(found.line_starts)):
        begin = found.line_starts[number]
        stop = found.line_starts[number + 1] - 1 if number + 1 < len(found.line_starts) else len(found.masked)
        text = found.masked[begin:stop]
        if text.strip():
            if len(text) - len(text.lstrip()) <= indent:
                break
            last = begin + len(text.rstrip()) - 1
    return max(last, start) if line else last


def _py_visibility(name: str) -> str:
    return "public" if name.startswith("__") and name.endswith("__") or not name.startswith("_") else "private"


def _python(found: Found) -> None:
    waiting: list[tuple[int, int, str]] = []
    owner: tuple[str, int] | None = None
    for m in _PY.finditer(found.masked):
        if m[7]:
            waiting.append((m.start(7), len(m[6].expandtabs()), found.text[m.start(7) : m.end(7)].rstrip()))
            continue
        start = m.start(3) if m[3] and not m[2] else m.start(2) if m[2] else m.start(5)
        decorators = [text for _, _, text in waiting]
        begin, waiting = (waiting[0][0] if waiting else start), []
        if owner and start > owner[1]:
            owner = None
        if m[5]:
            name = m[5]
            end = _statement_end(found.masked, m.end())
            found.add(name, "variable", start, end - 1, visibility=_py_visibility(name), is_exported=_py_visibility(name) == "public")
            continue
        indent, name = len(m[1].expandtabs()), m[4]
        member = owner if indent and owner and found.masked[found.line_starts[found.line(start) - 1] : start].isspace() else None
        if indent and not member or member and indent != getattr(found, "member_indent", indent):
            continue
        end = _py_end(found, m.start(3), indent)
        visible = _py_visibility(name)
        test = bool(re.match(r"test_|Test|test$", name))
        more = {"visibility": visible, "is_exported": visible == "public" and not member, "is_async": bool(m[2]), "is_test": test, "decorators": decorators}
        if m[3] == "class":
            if member:
                continue
            bases = re.compile(r"\s*\(").match(found.masked, m.end())
            found.add(name, "class", begin, end, **more)
            owner = (name, end)
            found.member_indent = next((len(x[1].expandtabs()) for x in re.compile(r"^([ \t]+)\S", re.M).finditer(found.masked, m.end(), end + 1)), 4)
            if bases:
                inside = found.masked[bases.end() : closing(found.masked, bases.end() - 1)]
                for base in re.split(r",(?![^\[(]*[\])])", inside):
                    base = base.strip()
                    if base and "=" not in base:
                        plain = re.split(r"[\[(]", base)[0]
                        found.edges.append(("extends", f"{found.path}::{name}", f"{found.path}::{plain}"))
            continue
        head = found.masked.find("(", m.end() - 1)
        close = closing(found.masked, head) if head >= 0 else m.end()
        colon = found.masked.find(":", close)
        more["signature"] = " ".join(found.text[head : colon if colon >= 0 else close + 1].split())
        if member:
            kind = "property" if any(re.match(r"@(property|\w+\.(setter|getter|deleter))\b", d) for d in decorators) else "method"
            found.add(name, kind, begin, end, parent=member[0], contained=False, **more)
        else:
            found.add(name, "test" if test else "function", begin, end, **more)
    checking = [(m.start(), _py_end(found, m.start(2), len(m[1].expandtabs()))) for m in re.finditer(r"^([ \t]*)(if)[ \t]+(?:typing\.)?TYPE_CHECKING\b", found.masked, re.M)]
    for m in _PY_IMPORT.finditer(found.masked):
        typed = any(a <= m.start() <= b for a, b in checking)
        if m[2]:
            for part in m[2].split(","):
                name, _, alias = part.strip().partition(" as ")
                if name.strip():
                    _import(found, m.start(), name.strip(), [(name.strip(), alias.strip() or None)], type_only=typed)
        else:
            names = [x.strip().partition(" as ") for x in m[4].strip("()").replace("\n", ",").split(",") if x.strip()]
            star = any(n[0] == "*" for n in names)
            _import(found, m.start(), m[3], [(n.strip(), a.strip() or None) for n, _, a in names], type_only=typed, namespace=star)


def _import(found: Found, at: int, specifier: str, names: list[tuple[str, str | None]], *, type_only=False, namespace=False, side_effect=False) -> None:
    listed = [{"name": n, "alias": a} for n, a in names]
    found.imports.append({"line": found.line(at), "specifier": specifier, "names": listed, "is_type_only": type_only, "is_namespace": namespace, "is_side_effect": side_effect})


def _export(found: Found, at: int, name: str, kind: str, specifier: str | None = None) -> None:
    found.exports.append({"line": found.line(at), "name": name, "kind": kind, "specifier": specifier})


# --- TypeScript and JavaScript ----------------------------------------------

_TS = re.compile(
    r"^[ \t]*((?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:abstract[ \t]+)?)(async[ \t]+)?"
    r"(function\b[ \t]*\*?|class\b|interface\b|type\b(?=[ \t]+\w+[^=\n]*=)|enum\b|const[ \t]+enum\b|const\b|let\b|var\b)[ \t]*([\w$]*)",
    re.M,
)
_TS_MEMBER = re.compile(
    r"(?:^|(?<=[{;,}]))[ \t]*((?:(?:public|private|protected|static|readonly|abstract|override|async|get|set|declare)[ \t]+)*)(\*?[ \t]*#?[\w$]+)[?!]?[ \t]*(<[^>\n]*>)?[ \t]*(\(|[:=;])",
    re.M,
)
_TS_WORDS = {"if", "for", "while", "switch", "return", "catch", "function", "new", "else", "do", "try", "throw", "await", "typeof", "super", "case"}


def _ts_test(name: str) -> bool:
    return bool(re.match(r"(?:test|describe)|it$|it_|it[A-Z]", name))


def _depths(masked: str) -> list[tuple[int, int]]:
    """Offsets where the depth of braces changes, with the depth from there on."""
    out, depth = [(0, 0)], 0
    for m in re.finditer(r"[{}]", masked):
        depth = max(0, depth + (1 if m[0] == "{" else -1))
        out.append((m.start() + (m[0] == "{"), depth))
    return out


def _depth_at(depths: list[tuple[int, int]], at: int) -> int:
    return depths[bisect_right(depths, (at, 1 << 30)) - 1][1]


def _decorators_before(found: Found, at: int) -> list[str]:
    lines, line = [], found.line(at) - 1
    while line > 0 and (text := found.text[found.line_starts[line - 1] : found.line_starts[line] - 1].strip()).startswith("@"):
        lines.insert(0, text)
        line -= 1
    return lines


def _typescript(found: Found) -> None:
    masked = found.masked
    depths = _depths(masked)
    for m in _TS.finditer(masked):
        if _depth_at(depths, m.start(3)):
            continue
        exported, name = "export" in m[1], m[4]
        word = m[3].split()[0]
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        more = {"visibility": "public" if exported else "private", "is_exported": exported, "decorators": _decorators_before(found, start)}
        if not name:
            if "default" not in m[1] or word not in ("function", "class"):
                continue
            name = "default"
        end = _statement_end(masked, m.end())
        if word == "function":
            head = masked.find("(", m.end())
            more |= {"is_async": bool(m[2]), "is_test": _ts_test(name), "signature": _ts_signature(found, head)}
            found.add(name, "function", start, closing(masked, masked.find("{", closing(masked, head))) if head >= 0 and "{" in masked[head:] else end, **more)
        elif word in ("class", "interface"):
            brace = masked.find("{", m.end())
            end = closing(masked, brace) if brace >= 0 else end
            found.add(name, word, start, end, **more)
            if brace >= 0:
                _ts_members(found, name, brace, end, word == "interface")
        elif word == "type":
            found.add(name, "type_alias", start, end, **more)
        elif word == "enum" or m[3].split()[-1] == "enum":
            found.add(name, "enum", start, end, **more)
        else:
            arrow = re.compile(r"[^=;\n]*=[ \t]*(async[ \t]*)?(?:(\()|[\w$]+[ \t]*=>)").match(masked, m.end())
            is_arrow = bool(arrow) and (not arrow[2] or bool(re.compile(r"[ \t]*(?::[^=\n]+)?=>").match(masked, closing(masked, arrow.end() - 1) + 1)))
            if is_arrow:
                more |= {"is_async": bool(arrow[1]), "is_test": _ts_test(name), "signature": _ts_signature(found, arrow.end() - 1) if arrow[2] else None}
            kind = "function" if is_arrow else "const" if word == "const" else "variable"
            found.add(name, kind, start, end, **more)
    _ts_modules(found)


def _ts_signature(found: Found, head: int) -> str | None:
    if head < 0:
        return None
    close = closing(found.masked, head)
    result = re.compile(r"[ \t]*:[^{=;\n]+").match(found.masked, close + 1)
    return " ".join(found.text[head : result.end() if result else close + 1].split())


def _ts_members(found: Found, owner: str, brace: int, end: int, interface: bool) -> None:
    depths, i = _depths(found.masked[brace + 1 : end]), brace + 1
    for m in _TS_MEMBER.finditer(found.masked, brace + 1, end):
        if _depth_at(depths, m.start(2) - brace - 1) or m.start(2) < i:
            continue
        name = m[2].strip().lstrip("*").strip()
        if name in _TS_WORDS:
            continue
        method = m[4] == "("
        stop = _statement_end(found.masked, closing(found.masked, m.end(4) - 1) + 1 if method else m.end(4) - (m[4] == ";"))
        i = stop
        mods = m[1].split()
        hidden = "private" in mods or "protected" in mods or name.startswith("#")
        more = {"visibility": "private" if hidden else "public", "is_async": "async" in mods, "decorators": _decorators_before(found, m.start(2))}
        if method:
            more |= {"signature": _ts_signature(found, m.end(4) - 1), "is_test": _ts_test(name)}
        kind = "property" if not method or {"get", "set"} & set(mods) else "method"
        found.add(name, kind, m.start(2), stop, parent=owner, contained=False, **more)


_TS_IMPORT = re.compile(r"^[ \t]*import\b[ \t]*(type\b)?([^'\"`;]*?)(?:\bfrom\b)?[ \t]*(['\"])", re.M)
_TS_EXPORT = re.compile(r"^[ \t]*export\b[ \t]*(?:type\b[ \t]*)?(\*(?:[ \t]*as[ \t]+[\w$]+)?|\{[^}]*\}|default\b)[ \t]*(?:from[ \t]*(['\"]))?", re.M)


def _quoted(found: Found, at: int) -> str:
    return found.text[at + 1 : found.text.find(found.text[at], at + 1)]


def _names(clause: str) -> list[tuple[str, str | None]]:
    out = []
    for part in clause.strip().strip("{}").split(","):
        name, _, alias = re.sub(r"^type\s+", "", part.strip()).partition(" as ")
        if name.strip():
            out.append((name.strip(), alias.strip() or None))
    return out


def _ts_modules(found: Found) -> None:
    for m in _TS_IMPORT.finditer(found.masked):
        clause, specifier = m[2].strip(), _quoted(found, m.start(3))
        names: list[tuple[str, str | None]] = []
        star = re.search(r"\*\s*as\s+([\w$]+)", clause)
        braces = re.search(r"\{[^}]*\}", clause)
        first = re.match(r"([\w$]+)\s*(?:,|$)", clause)
        if first:
            names.append(("default", first[1]))
        if star:
            names.append(("*", star[1]))
        if braces:
            names += _names(braces[0])
        _import(found, m.start(), specifier, names, type_only=bool(m[1]), namespace=bool(star), side_effect=not clause)
    for m in _TS_EXPORT.finditer(found.masked):
        specifier = _quoted(found, m.start(2)) if m[2] else None
        if m[1].startswith("*"):
            _export(found, m.start(), "*", "star", specifier)
        elif m[1] == "default":
            _export(found, m.start(), "default", "default")
        else:
            for name, alias in _names(m[1]):
                _export(found, m.start(), alias or name, "re_export" if specifier else "clause", specifier)
    for row in [s for s in found.symbols if s["is_exported"]]:
        found.exports.append({"line": row["line_start"], "name": row["name"], "kind": "declaration", "specifier": None})


# --- Rust ---------------------------------------------------------------------

_RS = re.compile(
    r"^[ \t]*(pub(?:\([^)]*\))?[ \t]+)?((?:default[ \t]+|const[ \t]+(?=(?:async|unsafe|extern|fn)\b)|async[ \t]+|unsafe[ \t]+|extern[ \t]*(?:\"[^\"]*\"[ \t]*)?)*)"
    r"((?:fn|struct|enum|union|trait|type|const|static|mod|impl|use)\b|macro_rules!)[ \t]*(?:mut[ \t]+)?(\w*)",
    re.M,
)
_RS_KINDS = {"struct": "struct", "union": "struct", "enum": "enum", "trait": "trait", "type": "type_alias", "const": "const", "static": "variable", "macro_rules!": "macro"}


def _rs_visibility(mark: str | None) -> str:
    return "private" if not mark else "public" if mark.strip() == "pub" else "crate"


def _attribute_test(found: Found, at: int) -> bool:
    line = found.line(at) - 1
    while line > 0 and (text := found.text[found.line_starts[line - 1] : found.line_starts[line] - 1].strip()).startswith(("#[", "///", "//")):
        if text.startswith("#[") and "test" in text:
            return True
        line -= 1
    return False


def _rust(found: Found) -> None:
    masked, done = found.masked, 0
    depths = _depths(masked)
    for m in _RS.finditer(masked):
        if _depth_at(depths, m.start(3)) or m.start() < done:
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        visible, word, name = _rs_visibility(m[1]), m[3], m[4]
        common = {"visibility": visible, "is_exported": visible == "public", "is_test": _attribute_test(found, start)}
        if word == "use":
            end = masked.find(";", m.end(3))
            end = end if end >= 0 else len(masked)
            _rs_use(found, start, masked[m.end(3) : end], bool(m[1]))
        elif word == "mod":
            brace = re.compile(r"[ \t\n]*([{;])").match(masked, m.end())
            if brace and brace[1] == ";":
                _import(found, start, f"mod::{name}", [(name, None)])
        elif word == "impl":
            _rs_impl(found, m.end(3), start)
        elif name or word == "macro_rules!":
            if word == "macro_rules!":
                name = (re.compile(r"\s*(\w+)").match(masked, m.end(3)) or [None, ""])[1]
            end = _rs_end(masked, m.end())
            if word == "fn":
                more = {"is_async": "async" in m[2], "signature": _rs_signature(found, m.end())}
                found.add(name, "function", start, end, **common, **more)
            elif name:
                found.add(name, _RS_KINDS[word], start, end, **common)
            done = max(done, end if word in ("fn", "trait") else 0)


def _rs_end(masked: str, at: int) -> int:
    i = at
    while i < len(masked):
        if masked[i] in "([":
            i = closing(masked, i)
        elif masked[i] == "{":
            return closing(masked, i)
        elif masked[i] == ";":
            return i
        i += 1
    return len(masked) - 1


def _rs_signature(found: Found, at: int) -> str | None:
    head = found.masked.find("(", at)
    if head < 0:
        return None
    close = closing(found.masked, head)
    stop = re.compile(r"[^{;]*").match(found.masked, close + 1).end()
    return " ".join(found.text[head:stop].split())


def _rs_impl(found: Found, at: int, start: int) -> None:
    brace = found.masked.find("{", at)
    if brace < 0:
        return
    head = re.sub(r"^\s*<(?:[^<>]|<[^<>]*>)*>", "", found.masked[at:brace])
    head = re.split(r"\bwhere\b", head)[0]
    plain = lambda t: re.sub(r"<.*", "", t.strip(), flags=re.S).split("::")[-1].strip().lstrip("&")
    trait, _, owner = head.rpartition(" for ")
    kind = plain(owner)
    if not kind:
        return
    if trait:
        found.edges.append(("implements", f"{found.path}::{kind}", f"{found.path}::{plain(trait)}"))
    end = closing(found.masked, brace)
    depths = _depths(found.masked[brace + 1 : end])
    for m in _RS.finditer(found.masked, brace + 1, end):
        if m[3] != "fn" or not m[4] or _depth_at(depths, m.start(3) - brace - 1):
            continue
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        visible = _rs_visibility(m[1])
        found.add(
            m[4], "method", begin, _rs_end(found.masked, m.end()), parent=kind, visibility=visible, is_exported=visible == "public",
            is_async="async" in m[2], is_test=_attribute_test(found, begin), signature=_rs_signature(found, m.end()),
        )


def _rs_use(found: Found, at: int, tree: str, public: bool) -> None:
    for path in _rs_paths(" ".join(tree.split())):
        path, _, alias = path.partition(" as ")
        path = path.strip()
        *_, name = path.split("::")
        module = path.removesuffix("::" + name) if "::" in path else path
        _import(found, at, path, [(name, alias.strip() or None)], namespace=name == "*")
        if public:
            _export(found, at, alias.strip() or name, "star" if name == "*" else "re_export", module)


def _rs_paths(tree: str) -> list[str]:
    """A use tree as plain paths: ``a::{b, c::*}`` gives ``a::b`` and ``a::c::*``."""
    tree = tree.strip()
    brace = tree.find("{")
    if brace < 0:
        return [tree] if tree else []
    inner, parts, depth, last = tree[brace + 1 : closing(tree, brace)], [], 0, 0
    for i, c in enumerate(inner):
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            parts.append(inner[last:i])
            last = i + 1
    parts.append(inner[last:])
    prefix = tree[:brace]
    out = []
    for part in parts:
        for path in _rs_paths(part):
            out.append(prefix.removesuffix("::") if path == "self" else prefix + path)
    return out


# --- Go -----------------------------------------------------------------------

_GO = re.compile(r"^(func|type|const|var|import)\b[ \t]*(\([^)\n]*\)[ \t]*(?=\w))?(\(|\w*)", re.M)


def _go_test(name: str) -> bool:
    return bool(re.match(r"Test|Bench|Example|Fuzz", name))


def _go_visible(name: str) -> dict:
    public = name[:1].isupper()
    return {"visibility": "public" if public else "private", "is_exported": public}


def _go(found: Found) -> None:
    masked = found.masked
    for m in _GO.finditer(masked):
        word = m[1]
        if word == "func" and m[3] not in ("", "("):
            head = re.compile(r"(?:\[[^\]]*\])?\s*\(").match(masked, m.end(3))
            end = closing(masked, masked.find("{", closing(masked, head.end() - 1))) if head and "{" in masked[head.end() :] else _statement_end(masked, m.end())
            more = {**_go_visible(m[3]), "is_test": _go_test(m[3])}
            if head:
                stop = re.compile(r"[^{\n]*").match(masked, closing(masked, head.end() - 1) + 1).end()
                more["signature"] = " ".join(found.text[head.end() - 1 : stop].split())
            if m[2]:
                owner = re.sub(r"\[.*", "", m[2].strip().strip("()").split()[-1]).lstrip("*")
                found.add(m[3], "method", m.start(), end, parent=owner, **more)
            else:
                found.add(m[3], "function", m.start(), end, **more)
        elif word == "import":
            _go_imports(found, m.end() - 1 if m[3] == "(" else m.end(1), m[3] == "(")
        elif m[3] == "(" or m[2]:
            at = masked.find("(", m.end(1))
            close = closing(masked, at)
            depths = _depths(masked[at + 1 : close])
            for entry in re.compile(r"^[ \t]*(\w+)", re.M).finditer(masked, at + 1, close):
                if not _depth_at(depths, entry.start(1) - at - 1):
                    _go_spec(found, word, entry[1], entry.start(1), entry.end(1))
        elif m[3]:
            _go_spec(found, word, m[3], m.start(), m.end(3))


def _go_spec(found: Found, word: str, name: str, start: int, after: int) -> None:
    if name == "_":
        return
    end = _statement_end(found.masked, after)
    if word in ("const", "var"):
        found.add(name, "const" if word == "const" else "variable", start, end, **_go_visible(name))
        return
    body = re.compile(r"\s*(?:\[[^\]]*\])?\s*(=?)\s*(struct|interface)?\b").match(found.masked, after)
    kind = {"struct": "struct", "interface": "interface"}.get(body[2] if body else None, "type_alias")
    found.add(name, kind, start, end, **_go_visible(name))
    if kind == "struct":
        brace = found.masked.find("{", after)
        depths = _depths(found.masked[brace + 1 : end])
        for m in re.compile(r"^[ \t]*\*?((?:\w+\.)?\w+)[ \t]*(?:`[^`]*`)?[ \t]*$", re.M).finditer(found.masked, brace + 1, end):
            if not _depth_at(depths, m.start(1) - brace - 1):
                found.edges.append(("embeds", f"{found.path}::{name}", f"{found.path}::{m[1].split('.')[-1]}"))


def _go_imports(found: Found, at: int, grouped: bool) -> None:
    stop = closing(found.masked, at) if grouped else found.masked.find("\n", at) if "\n" in found.masked[at:] else len(found.masked)
    for m in re.compile(r"(?:(\w+|\.|_)[ \t]+)?\"").finditer(found.masked, at, stop):
        quote = m.end() - 1
        if found.masked[quote - 1 : quote] == '"' or not found.text[quote + 1 :]:
            continue
        specifier = _quoted(found, quote)
        if not re.fullmatch(r"[\w./~+-]+", specifier):
            continue
        alias = m[1] if m[1] not in (None, ".", "_") else None
        _import(found, m.start(), specifier, [(specifier.rsplit("/", 1)[-1], alias)], namespace=m[1] == ".", side_effect=m[1] == "_")


_SCANNERS = {"py": _python, "ts": _typescript, "rs": _rust, "go": _go}


def parse_source(path: str, text: str) -> Found | None:
    """Declarations of one file; None for an extension of no known language."""
    suffix = path.rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else ""
    grammar = GRAMMAR_BY_EXTENSION.get(suffix)
    if grammar is None:
        return None
    found = Found(path, text, mask(text, grammar))
    _SCANNERS[grammar](found)
    return found


_SYMBOL = pa.struct([
    ("qualified_name", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("file_path", pa.string()), ("line_start", pa.int64()),
    ("line_end", pa.int64()), ("col_start", pa.int64()), ("col_end", pa.int64()), ("visibility", pa.string()), ("is_exported", pa.bool_()),
    ("is_async", pa.bool_()), ("is_test", pa.bool_()), ("decorators", pa.list_(pa.string())), ("signature", pa.string()),
])
_EDGE = pa.struct([("kind", pa.string()), ("source", pa.string()), ("target", pa.string())])
_NAME = pa.struct([("name", pa.string()), ("alias", pa.string())])
_IMPORT = pa.struct([("line", pa.int64()), ("specifier", pa.string()), ("names", pa.list_(_NAME)), ("is_type_only", pa.bool_()), ("is_namespace", pa.bool_()), ("is_side_effect", pa.bool_())])
_EXPORT = pa.struct([("line", pa.int64()), ("name", pa.string()), ("kind", pa.string()), ("specifier", pa.string())])
_FOUND = (
    "path string, symbols array<struct<qualified_name:string,name:string,kind:string,file_path:string,line_start:bigint,line_end:bigint,col_start:bigint,"
    "col_end:bigint,visibility:string,is_exported:boolean,is_async:boolean,is_test:boolean,decorators:array<string>,signature:string>>, "
    "edges array<struct<kind:string,source:string,target:string>>, imports array<struct<line:bigint,specifier:string,"
    "names:array<struct<name:string,alias:string>>,is_type_only:boolean,is_namespace:boolean,is_side_effect:boolean>>, "
    "exports array<struct<line:bigint,name:string,kind:string,specifier:string>>"
)


def _parse_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            found = parse_source(path, (content or b"").decode("utf-8", "replace")) if path else None
            if found:
                edges = [{"kind": k, "source": s, "target": t} for k, s, t in found.edges]
                rows.append((path, found.symbols, edges, found.imports, found.exports))
        columns = list(zip(*rows)) if rows else [[]] * 5
        types = [pa.string(), pa.list_(_SYMBOL), pa.list_(_EDGE), pa.list_(_IMPORT), pa.list_(_EXPORT)]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["path", "symbols", "edges", "imports", "exports"])


def extract(sources: DataFrame) -> DataFrame:
    """``path, symbols, edges, imports, exports`` (arrays) of each parsable source (path, content BINARY).

    Undecodable bytes are replaced; null content counts as empty; null paths
    and unknown extensions give no row; an empty table gives none.
    """
    return sources.select("path", "content").mapInArrow(_parse_batches, _FOUND)


def part(found: DataFrame, name: str) -> DataFrame:
    """One of symbols, edges, imports, exports as rows with their ``path``."""
    return found.select("path", F.inline(name))
