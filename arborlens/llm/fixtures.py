"""Own labelled files, from which the evidence of problem 3 is learned and on which it is measured.

Every label has several generators, each with its own way of writing files. The
model is fitted on some generators and measured on others, so that agreement
says something about files it has not seen the like of. All text is made up
here; nothing is taken from any table.
"""

from __future__ import annotations

import base64
import random
from collections.abc import Callable

OWNER = "Example House"
_WORDS = (
    "amber anchor basin beacon birch bridge canal cedar cliff cloud coral crane delta dune ember falcon fern field flint forest garden glacier "
    "grove harbor heron hill island lagoon lantern marsh meadow mesa moss oasis orchard otter pebble pine plain prairie quarry raven reef ridge "
    "river shore spruce stone summit thicket tide valley willow"
).split()
_VERBS = "add apply bind build check close collect count drop find flush join list load make merge move open parse pick push read send sort split store sum take walk write".split()
#: Remarks in hand-written files that only sound like notices of tools or of other owners.
_REMARKS = [
    "Do not change the order of these lines.", "The rows are regenerated every hour.", "Keep in step with the generated client.", "Do not edit while a job runs.",
    "Values were copied by hand from the handbook.", "The report is generated by the scheduler at night.", "Licensed features are switched on elsewhere.",
    "See the vendor's manual, section 4.", "Not generated: written because the tool could not do it.", "Rejects files that say they are minified.",
    "Strips the copyright line of other owners.", "Modify only together with the schema.", "Returns the cached value or computes it.", "Assumes sorted input.",
    "This was slow before the index.", "Callers hold the lock.", "Reads lines until the first blank one.", "An empty list means no limit.",
]
_NOTICES = [
    "Code generated by {t}. DO NOT EDIT.", "@generated by {t} {v}", "This file was automatically generated by {t}.", "Generated by {t} from {w}.idl; do not edit.",
    "<auto-generated>", "AUTO-GENERATED FILE. Changes will be lost.", "Autogenerated by {t}, do not modify.", "This code is machine generated.",
    "Automatically created by {t} {v}.", "Written by {t} from {w}.yaml. Do not edit by hand.", "Automatisch erzeugt von {t}.", "Fichier généré par {t}, ne pas modifier.",
    "Archivo generado por {t}. No editar.", "Produced by {t} {v} out of {w}.xml", "{t} emitted 12 types from {w}.json", "Made by {t}; edits are overwritten.",
]
_TERMS = [
    "Copyright (c) 2016 {n}", "(c) {n} and contributors. MIT License.", "SPDX-License-Identifier: Apache-2.0", "Licensed under the BSD 3-Clause License",
    "@license {w} v{v}", "Permission is hereby granted, free of charge, to any person", "Copyright {n}. All rights reserved.", "{w} {v} - imported from upstream",
    "Vendored from {w} {v}", "Taken from {w}-{v}, see its LICENSE", "Redistribution and use in source and binary forms are permitted",
]
_LANGUAGES = ["py", "ts", "js", "go", "rs", "java", "sh", "sql"]


class Maker:
    """Text of made-up code in one language, from one random state."""

    def __init__(self, seed: str):
        self.r = random.Random(seed)
        self.lang = self.r.choice(_LANGUAGES)
        self.mark = {"py": "# ", "sh": "# ", "sql": "-- "}.get(self.lang, "// ")

    def word(self) -> str:
        return self.r.choice(_WORDS)

    def name(self) -> str:
        return f"{self.r.choice(_VERBS)}_{self.word()}" if self.lang in ("py", "rs", "sh", "sql") else self.r.choice(_VERBS) + self.word().title()

    def filled(self, text: str) -> str:
        return text.format(t=self.word() + self.r.choice(["gen", "c", "-cli", "kit"]), v=f"{self.r.randint(0, 9)}.{self.r.randint(0, 30)}.{self.r.randint(0, 9)}", w=self.word(), n=f"{self.word().title()} Labs")

    def comment(self, *texts: str) -> str:
        if self.lang not in ("py", "sh", "sql") and self.r.random() < 0.3:
            return "/*\n" + "".join(f" * {t}\n" for t in texts) + " */\n"
        return "".join(f"{self.mark}{t}\n" for t in texts)

    def statement(self) -> str:
        a, b, n = self.word(), self.word(), self.r.randint(0, 5000)
        return self.r.choice([
            f"{a} = {b} + {n}", f"if {a} > {n}: return {b}", f"for {a} in {b}s: {self.name()}({a})", f'log("{a} {b}")', f"{a}.{b} = max({a}.{b}, {n})",
            f"{self.name()}({a}, {b})", f"return {a}.{b}", f"while {a} < {n}: {a} += 1", f"let {a} = {self.name()}(&{b})?;", f"const {a} = await {self.name()}({b});",
            f"if err != nil {{ return {a}, err }}", f"match {a} {{ Some({b}) => {n}, None => 0 }}", f"SELECT {a}, {b} FROM {self.word()} WHERE {a} > {n};", f'echo "{a}" | grep {b}',
        ])

    def function(self, lines: int) -> str:
        opening, closing = {
            "py": (f"def {self.name()}({self.word()}, {self.word()}=None):", ""), "go": (f"func {self.name()}({self.word()} int) error {{", "}"),
            "rs": (f"pub fn {self.name()}({self.word()}: &str) -> u64 {{", "}"), "java": (f"public void {self.name()}(String {self.word()}) {{", "}"),
            "sh": (f"{self.name()}() {{", "}"), "sql": (f"CREATE VIEW {self.name()} AS", ";"),
        }.get(self.lang, (f"export function {self.name()}({self.word()}) {{", "}"))
        body = [("    " if self.r.random() < 0.8 else "        ") + self.statement() for _ in range(lines)]
        if self.r.random() < 0.3:
            body.insert(self.r.randint(0, lines), "    " + self.mark + self.r.choice(_REMARKS))
        return "\n".join([opening, *body, closing, ""]) + "\n"

    def code(self, most: int = 8) -> str:
        head = [f"import {self.word()}" for _ in range(self.r.randint(0, 4))]
        return "\n".join([*head, ""]) + "\n".join(self.function(self.r.randint(1, 9)) for _ in range(self.r.randint(1, most)))

    def small_names(self, parts: int) -> str:
        letters = "abcdefghijklmnopqrstuvwxyz"
        pick = lambda: self.r.choice(letters) + (self.r.choice(letters) if self.r.random() < 0.2 else "")
        forms = ["function {a}({b},{c}){{return {b}.{d}?{b}:{c}({n})}}", "var {a}={b}({n}),{c}=!0;", "{a}.{d}=function({b}){{{c}.push({b}[{n}])}},", "if({a}&&{b}({c}))return {d};", "for(var {a}=0;{a}<{b}.length;{a}++){c}({b}[{a}]);", '{a}("{w}",{b}=>{c}+{d}),']
        return "".join(self.r.choice(forms).format(a=pick(), b=pick(), c=pick(), d=pick(), n=self.r.randint(0, 999), w=self.word()) for _ in range(parts))

    def numbers(self, lines: int) -> str:
        form = self.r.choice(["{}", "0x{:04x}", "-{}.5e-3", '"{:08x}"'])
        width = self.r.randint(4, 16)
        rows = ["  " + ", ".join(form.format(self.r.randint(0, 65535)) for _ in range(width)) + "," for _ in range(lines)]
        return "\n".join(rows if lines < 10 or self.r.random() < 0.5 else (rows[: self.r.choice([1, 2, 5])] * lines)[:lines])


def _plain(m: Maker) -> str:
    return m.code()


def _remarked(m: Maker) -> str:
    return m.comment(*m.r.sample(_REMARKS, m.r.randint(1, 4))) + "\n" + m.code()


def _owned(m: Maker) -> str:
    head = [f"Copyright {OWNER}. {m.r.choice(['All rights reserved.', 'Internal use only.', ''])}".strip()]
    return m.comment(*head, *m.r.sample(_REMARKS, m.r.randint(0, 2))) + "\n" + m.code()


def _with_table(m: Maker) -> str:
    long = f'{m.word()} = "{" ".join(m.word() for _ in range(m.r.randint(60, 400)))}"\n'
    return m.code(5) + (f"{m.word()} = [\n{m.numbers(m.r.randint(2, 9))}\n]\n" if m.r.random() < 0.6 else long) + m.code(5)


def _with_settings(m: Maker) -> str:
    quoted = ",\n".join(f'    "{a}": "{m.word()}"' for a in m.r.sample(_WORDS, m.r.randint(4, 20)))
    return m.code(3) + f"{m.word()} = {{\n{quoted}\n}}\n" + m.code(3)


def _with_long_line(m: Maker) -> str:
    """Code beside one long literal, of words, numbers or path data."""
    parts = [m.r.choice(["{w}", "M{n} L{n}", "{n}", "{w}.{w}"]) for _ in range(1)][0]
    text = m.r.choice([" ", "|", ", ", ","]).join(parts.replace("{w}", m.word()).replace("{n}", str(m.r.randint(0, 999))) for _ in range(m.r.randint(60, 900)))
    return (m.code(3) if m.r.random() < 0.7 else f"import {m.word()}\n\n") + f'{m.word()} = "{text}"\n' + (m.code(3) if m.r.random() < 0.5 else "")


def _closing_remark(m: Maker) -> str:
    return m.code() + m.comment(m.r.choice([*_REMARKS, f"see {m.word()}.py", f"tested in {m.word()}_test.{m.lang}"]))


def _tiny(m: Maker) -> str:
    return f"import {m.word()}\n\nconst {m.word()} = {m.r.randint(1, 99)}\n" if m.r.random() < 0.5 else m.function(2)


def _noticed(m: Maker) -> str:
    owner = [f"Copyright {OWNER}."] if m.r.random() < 0.4 else []
    return m.comment(*owner, m.filled(m.r.choice(_NOTICES))) + "\n" + m.code()


def _noticed_at_the_end(m: Maker) -> str:
    return m.code() + m.comment(m.filled(m.r.choice(_NOTICES)))


def _noticed_in_a_header(m: Maker) -> str:
    filler = m.r.sample(_REMARKS, m.r.randint(2, 9))
    return m.comment(*filler, m.filled(m.r.choice(_NOTICES)), *m.r.sample(_REMARKS, 2)) + m.code()


def _accessors(m: Maker) -> str:
    owner = [f"Copyright {OWNER}."] if m.r.random() < 0.5 else ["Fields of the wire format."]
    kind = m.word().title()
    return m.comment(*owner) + "".join(f"\nfunc (x *{kind}) Get{w.title()}() int32 {{\n\tif x != nil {{\n\t\treturn x.{w.title()}\n\t}}\n\treturn 0\n}}\n" for w in m.r.sample(_WORDS, m.r.randint(5, 25)))


def _located(m: Maker) -> str:
    return "".join(f"#line {m.r.randint(1, 900)} \"{m.word()}.y\"\n    {m.statement()}\n" for _ in range(m.r.randint(4, 30))) if m.r.random() < 0.5 else "".join(f"//line {m.word()}.go:{m.r.randint(1, 900)}\n{m.statement()}\n" for _ in range(m.r.randint(4, 30)))


def _states(m: Maker) -> str:
    head = m.r.choice([f"tables of {m.word()}.y", m.filled("{t} --tables {w}.y"), m.word(), f"{m.word()}.y sha256:{m.r.getrandbits(160):040x}"])
    return m.comment(head) + "".join(f"{m.mark}state {i}: {m.word()}\n{m.r.randint(0, 99)}, {m.r.randint(0, 99)},\n" for i in range(m.r.randint(8, 60)))


def _with_footer(m: Maker) -> str:
    owner = [f"Copyright {OWNER}."] if m.r.random() < 0.4 else []
    foot = ["checksum {h}", "sha256:{h}", "built with {t} {v} from {w}.proto", "{t} {v}, {w}.schema, digest {h}", "({t} {v}) end of {w}.xml", "eof {w}.idl, {t}: 41 entries"]
    return (m.comment(*owner) + "\n" if owner else "") + m.code() + m.comment(m.filled(m.r.choice(foot).replace("{h}", f"{m.r.getrandbits(m.r.choice([64, 128, 256])):016x}")))


def _with_command(m: Maker) -> str:
    line = m.r.choice(["{t} --out={w} {w}.proto", "$ {t} -i {w}.yaml --{w}", "{t} {v} --lang {w} {w}.idl", "source {w}.idl"])
    return m.comment(m.filled(line)) + "\n" + m.code()


def _unmarked(m: Maker) -> str:
    return m.code()


def _packed(m: Maker) -> str:
    return m.small_names(m.r.randint(30, 900)) + "\n"


def _packed_lines(m: Maker) -> str:
    lines = [m.small_names(m.r.randint(3, 12)) for _ in range(m.r.randint(3, 60))]
    return "\n".join(lines if m.r.random() < 0.8 else lines[:2] * m.r.randint(3, 30)) + "\n"


def _packed_with_banner(m: Maker) -> str:
    banner = f"/*! {m.filled(m.r.choice(_TERMS))} */" + m.r.choice(["\n", ""])
    return banner + m.small_names(m.r.randint(40, 600)) + m.r.choice(["\n", f"\n//# sourceMappingURL={m.word()}.js.map\n"])


def _bundled(m: Maker) -> str:
    parts = [f"{i}:[function(e,t,n){{{m.small_names(m.r.randint(10, 40))}}},{{}}]" for i in range(m.r.randint(3, 30))]
    return "!function(e){var t={};e(t)}({" + m.r.choice([",", ",\n"]).join(parts) + "},{},[1]);\n"


def _licensed(m: Maker) -> str:
    return m.comment(*(m.filled(t) for t in m.r.sample(_TERMS, m.r.randint(1, 3)))) + "\n" + m.code()


def _licensed_with_tag(m: Maker) -> str:
    return f"/*! {m.word()} v{m.filled('{v}')} | {m.filled('(c) {n}')} | {m.r.choice(['MIT', 'BSD-2-Clause', 'ISC', 'Apache-2.0'])} license */\n" + m.code()


def _full_terms(m: Maker) -> str:
    return m.comment(m.filled("Copyright (c) 2011-2019 {n}"), "", "Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions", "are met: the above copyright notice and this list of conditions.") + m.code()


def _rows(m: Maker) -> str:
    return m.r.choice(["export const {w} = [\n{x}\n];\n", "{w} = [\n{x}\n]\n", "var {w} = []int{{\n{x}\n}}\n", "static {w}: &[u32] = &[\n{x}\n];\n"]).format(w=m.word(), x=m.numbers(m.r.randint(15, 200)))


def _encoded(m: Maker) -> str:
    data = base64.b64encode(m.r.randbytes(m.r.randint(600, 9000))).decode()
    width = m.r.choice([60, 76, 120, len(data)])
    return f'{m.word()} = (\n' + "".join(f'    "{data[i : i + width]}"\n' for i in range(0, len(data), width)) + ")\n"


def _records(m: Maker) -> str:
    keys = m.r.sample(_WORDS, 4)
    form = m.r.random()
    row = lambda: "{" + ", ".join(f'"{k}": {m.r.choice([str(m.r.randint(0, 9999)), chr(34) + m.word() + chr(34)])}' for k in keys) + "},"
    if form < 0.6:
        return f"module.exports = [\n" + "\n".join("  " + row() for _ in range(m.r.randint(15, 120))) + "\n];\n"
    return "".join(f"{m.word()};{m.r.randint(0, 9999)};{m.word()};{m.r.random():.4f}\n" for _ in range(m.r.randint(15, 200)))


def _dumped(m: Maker) -> str:
    return "".join(f"INSERT INTO {m.word()} VALUES ({m.r.randint(0, 9999)}, '{m.word()}', '{m.word()} {m.word()}');\n" for _ in range(m.r.randint(15, 150)))


#: Few foreign files bear no mark at all, so these count for a quarter of the others.
RARE = [_unmarked]
#: Generators by label; those of ``HELD_OUT`` are never fitted on.
GENERATORS: dict[str, list[Callable[[Maker], str]]] = {
    "handwritten": [_plain, _remarked, _owned, _with_table, _with_settings, _with_long_line, _closing_remark, _tiny],
    "generated": [_noticed, _noticed_at_the_end, _noticed_in_a_header, _accessors, _located, _states, _with_footer, _with_command, _unmarked],
    "minified": [_packed, _packed_lines, _packed_with_banner, _bundled],
    "vendored": [_licensed, _licensed_with_tag, _full_terms, _unmarked],
    "blob": [_rows, _encoded, _records, _dumped],
}
HELD_OUT = [_with_table, _noticed_in_a_header, _bundled, _full_terms, _records]


def _file_name(m: Maker, label: str, make: Callable) -> str:
    stem, ends = f"{m.word()}_{m.word()}", m.r.random()
    if label == "generated" and ends < 0.35 and make is not _unmarked:
        stem += m.r.choice(["_pb", ".gen", "_generated", ".g", "_pb2", ".designer"])
    if label == "minified" and ends < 0.5:
        stem += m.r.choice([".min", "-min", ".bundle", ".prod", f".{m.r.getrandbits(40):010x}"])
    return f"{stem}.{m.lang}"


def make_files(per_generator: int, held_out: bool | None = None, seed: int = 0) -> list[tuple[str, str, bytes]]:
    """``per_generator`` files (label, name, content) of the fitted, the held-out or (None) all generators."""
    files = []
    for label, generators in GENERATORS.items():
        for make in generators:
            if held_out is None or (make in HELD_OUT) == held_out:
                for i in range(per_generator // 4 if make in RARE else per_generator):
                    m = Maker(f"{seed}/{label}/{make.__name__}/{i}")
                    files.append((label, _file_name(m, label, make), make(m).encode()))
    return files
