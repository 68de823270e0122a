import math

import numpy as np

from arborlens.llm.evidence import GENERATED, HAND, LABELS, MINIFIED, VENDORED, HouseStyle, file_evidence, fitted
from arborlens.llm.fixtures import HELD_OUT, OWNER, make_files
from arborlens.llm.handwritten import TO_DIRECTORY, TO_FILE, classify_sources, directory_evidence

HOUSE = HouseStyle(("Marrowfield Works",))
CODE = "import { load } from './load';\n\nexport function add(a, b) {\n  if (a) {\n    return a + b;\n  }\n}\n"
MINI = "var a=n.build(1),b=!0;function c(d,e){return d.f?e:d[3]};" * 40
TABLE = "export const rows = [\n" + "  0x12, 0x34, 0x56, 0x78,\n" * 60 + "];\n"
CASES = {
    "p/src/a.ts": (CODE, "handwritten"),
    "p/src/b.ts": ("// Code generated by tool. DO NOT EDIT.\n" + CODE, "generated"),
    "p/src/c.ts": (CODE + "const header = '// Code generated by tool. DO NOT EDIT.';\n", "handwritten"),
    "p/src/d.ts": ("// The client in ../c is generated from x.idl; do not edit it there, edit this file instead.\n" + CODE, "handwritten"),
    "p/src/e.js": (MINI, "minified"),
    "p/src/f.js": (CODE + "const icon = '" + "M1 L2 " * 200 + "';\n", "handwritten"),
    "p/src/g.ts": (TABLE, "blob"),
    "p/src/h.ts": (CODE + TABLE.replace("0x12, 0x34, 0x56, 0x78,\n" * 55, "0x12,\n"), "handwritten"),
    "p/src/i.ts": ("/*! lib v1.2.3 | (c) Other People | MIT license */\n" + CODE, "vendored"),
    "p/src/j.ts": ("// Copyright Marrowfield Works. Internal use only.\n" + CODE, "handwritten"),
    "p/src/k.ts": ("", "handwritten"),
    "p/src/l_pb.js": (CODE, "generated"),
    "p/vendor/lib/m.ts": (CODE, "vendored"),
    "p/src/vendor_portal/n.ts": (CODE, "handwritten"),
    "p/src/__generated__/deep/er/o.ts": (CODE, "generated"),
    "p/src/generators/q.ts": (CODE, "handwritten"),
    "top.ts": (CODE, "handwritten"),
}


def test_labels(spark):
    rows = [(p, bytearray(c.encode()), "x", 1.0) for p, (c, _) in CASES.items()]
    frame = spark.createDataFrame(rows, "path string, content binary, folder string, b0 double")
    got = {r.path: r.label for r in classify_sources(frame, HOUSE).collect()}
    assert got == {p: label for p, (_, label) in CASES.items()}


def brute_force(files):
    """Exact marginals of the same tree by recursion over its nodes, in plain Python."""
    children, roots = {}, set()
    for path in files:
        parts = path.split("/")[:-1]
        for i in range(1, len(parts) + 1):
            folder = "/".join(parts[:i])
            children.setdefault(folder, set())
            (children.setdefault("/".join(parts[: i - 1]), set()).add(folder) if i > 1 else roots.add(folder))

    def lse(values):
        top = max(values)
        return top + math.log(sum(math.exp(v - top) for v in values))

    def below(folder, skip=None):
        score = list(directory_evidence(folder.split("/")))
        for child in children[folder]:
            inner = below(child)
            score = [s + lse([TO_DIRECTORY[i][j] + inner[j] for j in range(5)]) for i, s in enumerate(score)]
        for path, e in files.items():
            if path.rsplit("/", 1)[0] == folder and path != skip:
                score = [s + lse([TO_FILE[i][j] + e[j] for j in range(5)]) for i, s in enumerate(score)]
        return score

    def around(folder, skip):
        score = list(directory_evidence(folder.split("/")))
        for child in children[folder]:
            if child != skip:
                inner = below(child)
                score = [s + lse([TO_DIRECTORY[i][j] + inner[j] for j in range(5)]) for i, s in enumerate(score)]
        for path, e in files.items():
            if path.rsplit("/", 1)[0] == folder and path != skip:
                score = [s + lse([TO_FILE[i][j] + e[j] for j in range(5)]) for i, s in enumerate(score)]
        if "/" in folder:
            over = around(folder.rsplit("/", 1)[0], folder)
            score = [s + lse([over[i] + TO_DIRECTORY[i][j] for i in range(5)]) for j, s in enumerate(score)]
        return score

    out = {}
    for path, e in files.items():
        over = around(path.rsplit("/", 1)[0], path)
        final = [e[j] + lse([over[i] + TO_FILE[i][j] for i in range(5)]) for j in range(5)]
        out[path] = math.exp(final[HAND] - lse(final))
    return out


def test_marginals_are_exact(spark):
    contents = {p: c for p, (c, _) in CASES.items() if "/" in p}
    contents |= {f"p/mixed/{i}.ts": ("// @generated\n" if i % 3 else "") + CODE for i in range(7)}
    contents |= {f"p/mixed/in/{i}.ts": CODE for i in range(2)}
    frame = spark.createDataFrame([(p, bytearray(c.encode())) for p, c in contents.items()], "path string, content binary")
    got = {r.path: r.p_handwritten for r in classify_sources(frame).collect()}
    wanted = brute_force({p: file_evidence(p.rsplit("/", 1)[1], c.encode()) for p, c in contents.items()})
    assert set(got) == set(wanted)
    assert all(abs(got[p] - wanted[p]) < 2e-6 for p in wanted)


def test_siblings_speak_to_each_other(spark):
    files = {f"p/odd/{i}.ts": "// @generated\n" + CODE for i in range(30)} | {"p/odd/x.ts": CODE, "p/src/x.ts": CODE}
    frame = spark.createDataFrame([(p, bytearray(c.encode())) for p, c in files.items()], "path string, content binary")
    got = {r.path: r.p_handwritten for r in classify_sources(frame).collect()}
    assert got["p/odd/x.ts"] < got["p/src/x.ts"]


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, b"x"), ("a/b.py", None), ("a/c.py", b"\xff\xfe\x00"), ("a/d.py", MINI.encode()), ("a/d.py", MINI.encode())]
    frame = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")
    got = {r.path: r.label for r in classify_sources(frame).collect()}
    assert got == {"a/b.py": "handwritten", "a/c.py": "handwritten", "a/d.py": "minified"}
    assert classify_sources(frame.where("false")).count() == 0


def label_of(name, text, style=HOUSE):
    return LABELS[int(np.argmax(file_evidence(name, text.encode(), style)))]


def test_notices_in_other_languages_and_at_the_end():
    for notice in ("// Automatisch erzeugt von x, bitte nicht von Hand bearbeiten.", "# Fichier produit par x, ne pas modifier."):
        assert label_of("b.go", f"{notice}\n{CODE}") == "generated"
    assert label_of("b.go", f"{CODE}// sha256 {'0a1b' * 16}, made by x 1.2 from y.idl\n") == "generated"
    assert label_of("b.min.js", MINI) == "minified"


OWN = "# Copyright Marrowfield Works. Internal use only.\n"


def test_house_files_that_only_speak_of_such_things(spark):
    body = "import json\n\n\ndef load(path):\n    with open(path) as f:\n        return json.load(f)\n\n\ndef total(rows):\n    return sum(r['n'] for r in rows)\n"
    files = {
        "services/api/order.py": OWN + "# Do not change the order of these imports.\n" + body,
        "services/api/cache.py": OWN + "# Cache entries are regenerated nightly.\n" + body,
        "services/api/plain.py": OWN + body,
        "services/web/plain.py": body,
        "libs/external/client.py": OWN + body,
        "libs/outside/vendor/client.py": body,
        "services/late/late.py": "# terms of use\n" * 45 + "# Code generated by tool. DO NOT EDIT.\n" + body,
    }
    frame = spark.createDataFrame([(p, bytearray(c.encode())) for p, c in files.items()], "path string, content binary")
    got = {r.path: r.label for r in classify_sources(frame, HOUSE).collect()}
    assert got == dict.fromkeys(files, "handwritten") | {"services/late/late.py": "generated", "libs/outside/vendor/client.py": "vendored"}


def test_lines_of_any_length_speak_for_minified():
    piece = "var a=n.build(1),b=!0;function c(d,e){return d.f?e:d[3]};"
    for width in (2, 3, 4, 40):
        assert label_of("e.js", (piece * width + "\n") * 40) == "minified"


def test_language_of_data_speaks_for_data(spark):
    rows = [("a/x.py", bytearray((CODE + TABLE).encode())), ("b/y.py", bytearray((CODE + TABLE).encode()))]
    frame = spark.createDataFrame(rows, "path string, content binary")
    languages = spark.createDataFrame([("a/x.py", "JSON"), ("a/none.py", "Go"), ("b/y.py", None)], "path string, language string")
    got = {r.path: r.p_handwritten for r in classify_sources(frame, HOUSE, languages).collect()}
    assert got["a/x.py"] < got["b/y.py"]


def test_held_out_generators():
    """Files of generators that were never fitted on: every label found in at least 95 of 100, hand work wrongly told in at most 5."""
    style, seen = HouseStyle((OWNER,)), {}
    for label, name, content in make_files(100, held_out=True, seed=77):
        seen.setdefault(label, []).append(LABELS[int(np.argmax(file_evidence(name, content, style)))] == label)
    assert set(seen) == set(LABELS) and all(np.mean(hits) >= 0.95 for hits in seen.values()), {k: np.mean(v) for k, v in seen.items()}
    assert len(HELD_OUT) == 5 and fitted().shape[1] == 5
