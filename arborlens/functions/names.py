"""Scalar functions on paths, qualified names and kinds, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Language by file extension.
LANGUAGE_BY_EXTENSION = {
    "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript",
    "rs": "Rust", "py": "Python", "go": "Go",
}
#: Language of an unknown extension.
FALLBACK_LANGUAGE = "Rust"


def extension(path: Column) -> Column:
    """Extension of the file name, without the dot; empty if there is none or the name only starts with a dot."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def language_of(path: Column) -> Column:
    """Language by extension; unknown extensions count as ``FALLBACK_LANGUAGE``, null stays null."""
    known = F.lit(FALLBACK_LANGUAGE)
    for suffix, language in LANGUAGE_BY_EXTENSION.items():
        known = F.when(extension(path) == suffix, language).otherwise(known)
    return F.when(path.isNotNull(), known)


def name_file(qualified: Column) -> Column:
    """The file of a qualified name, or null if it is none (no ``::``, or an empty half)."""
    return F.when(is_qualified(qualified), F.substring_index(qualified, "::", 1))


def name_symbol(qualified: Column) -> Column:
    """What follows the first ``::`` of a qualified name, or null if it is none."""
    return F.when(is_qualified(qualified), F.substr(qualified, F.instr(qualified, "::") + 2))


def is_qualified(qualified: Column) -> Column:
    at = F.instr(qualified, "::")
    return (at > 1) & (at + 1 < F.length(qualified))


def short_name(qualified: Column) -> Column:
    return F.substring_index(qualified, "::", -1)


def file_stem(path: Column) -> Column:
    """File name without its last extension; ``unknown`` for an empty one."""
    name = F.substring_index(path, "/", -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.when(stem == "", "unknown").otherwise(stem)


def segments(text: Column) -> Column:
    """Lower-case parts of a name, cut at ``: . _ /`` and between a lower and an upper letter."""
    parts = F.split(text, r"[:./_]|(?<=\p{Ll})(?=\p{Lu})")
    return F.filter(F.transform(parts, F.lower), lambda p: p != "")


def pascal(kind: Column) -> Column:
    """``type_alias`` as ``TypeAlias``."""
    return F.array_join(F.transform(F.split(kind, "_"), F.initcap), "")


def glob_pattern(glob: str) -> str:
    """Regular expression of a glob; ``*`` and ``?`` cross ``/``, ``**/`` may stand for nothing, ``[..]`` and ``{a,b}`` work."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if c == "*":
            while glob.startswith("*", i + 1):
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"glob {glob!r}: no closing bracket")
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += "\\" + glob[i] if not glob[i].isalnum() else glob[i]
        else:
            out += c if c.isalnum() or c in "_/ " else "\\" + c
        i += 1
    if depth:
        raise ValueError(f"glob {glob!r}: no closing brace")
    return f"^{out}$"


def matches_any(text: Column, globs: tuple[str, ...] | list[str]) -> Column:
    """Whether a glob of the list matches; globs that cannot be read are left out, an empty list matches nothing."""
    patterns = []
    for glob in globs:
        try:
            patterns.append(glob_pattern(glob))
        except ValueError:
            continue
    return F.coalesce(text.rlike("|".join(patterns)), F.lit(False)) if patterns else F.lit(False)
