from arborlens.operators.resolve import normal_path, resolve_all, rust_modules
from arborlens.sources.extract import extract
from pyspark.sql import functions as F

FILES = {
    "web/a.ts": "import { x } from './lib';\nimport { y } from '../shared/y';\nimport './missing';\nexport * from './b';\n",
    "web/b.tsx": "export const b = 1;\n",
    "web/lib/index.ts": "export { x } from './deep';\nexport { q } from '../b';\n",
    "web/lib/deep.ts": "export const x = 1;\n",
    "shared/y.js": "export const y = 1;\n",
    "py/app/main.py": "import os\nfrom .util import f\nfrom ..core import g\nimport py.core.sub\nif TYPE_CHECKING:\n    from .types import T\n",
    "py/app/util.py": "def f(): pass\n",
    "py/app/types.py": "T = 1\n",
    "py/core/__init__.py": "def g(): pass\n",
    "py/core/sub.py": "",
    "src/pkg/z.py": "import pkg2\n",
    "src/pkg2.py": "",
    "rs/src/lib.rs": "mod geo;\npub use crate::geo::point::Point;\n",
    "rs/src/geo/mod.rs": "mod point;\nuse self::point::Point;\n",
    "rs/src/geo/point.rs": "use super::helper;\nuse crate::geo::Shape;\nuse std::io;\n",
    "go/main.go": 'package main\nimport (\n\t"fmt"\n\t"m.example/go/util"\n\t_ "m.example/x"\n\t. "m.example/go/util"\n\t"other.example/z"\n)\n',
    "go/util/u.go": "package util\n",
}


def test_all_languages(spark):
    sources = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in FILES.items()], "path string, content binary")
    edges = resolve_all(extract(sources), sources.select("path"), go_module="m.example")
    got = {(r.kind, r.source, r.target) for r in edges.collect() if r.kind not in ("contains", "child_of")}
    assert got == {
        ("imports_from", "web/a.ts", "web/lib/index.ts"), ("imports_from", "web/a.ts", "web/lib/deep.ts"), ("imports_from", "web/a.ts", "shared/y.js"),
        ("barrel_re_export_all", "web/a.ts", "web/b.tsx"), ("re_export", "web/lib/index.ts", "web/lib/deep.ts"), ("re_export", "web/lib/index.ts", "web/b.tsx"),
        ("imports_from", "py/app/main.py", "py/app/util.py"), ("imports_from", "py/app/main.py", "py/core/__init__.py"),
        ("imports_from", "py/app/main.py", "py/core/sub.py"), ("conditional_import", "py/app/main.py", "py/app/types.py"),
        ("imports_from", "src/pkg/z.py", "src/pkg2.py"),
        ("imports_from", "rs/src/lib.rs", "rs/src/geo/mod.rs"), ("imports_from", "rs/src/lib.rs", "rs/src/geo/point.rs"),
        ("re_export", "rs/src/lib.rs", "rs/src/geo/point.rs"), ("imports_from", "rs/src/geo/mod.rs", "rs/src/geo/point.rs"),
        ("imports_from", "rs/src/geo/point.rs", "rs/src/geo/mod.rs"),
        ("imports_from", "go/main.go", "go/util"), ("side_effect_import", "go/main.go", "m.example/x"), ("dot_import", "go/main.go", "go/util"),
    }


BARRELS = {
    "app/main.ts": "import { Zed } from '../lib';\nimport { Deep } from '../lib';\nimport { Loop } from '../loop/a';\nimport { Gone } from '../lib';\n",
    "lib/index.ts": "export * from './aaa';\nexport * from './zed';\nexport * from './mid';\n",
    "lib/aaa.ts": "export const Other = 1;\n",
    "lib/zed.ts": "export const Zed = 1;\n",
    "lib/mid.ts": "export { Deep } from './deep';\n",
    "lib/deep.ts": "export const Deep = 1;\n",
    "loop/a.ts": "export { Loop } from './b';\n",
    "loop/b.ts": "export { Loop } from './a';\n",
}


def test_barrels_with_two_stars_a_chain_and_a_cycle(spark):
    sources = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in BARRELS.items()], "path string, content binary")
    edges = resolve_all(extract(sources), sources.select("path"))
    got = {r.target for r in edges.where("kind = 'imports_from' AND source = 'app/main.ts'").collect()}
    assert got == {"lib/index.ts", "lib/zed.ts", "lib/deep.ts", "loop/a.ts", "loop/b.ts"}


def test_paths(spark):
    rows = spark.createDataFrame([("a/./b/../c",), ("../x",), ("",), ("a//b",)], "p string").select(normal_path(F.col("p")))
    assert [r[0] for r in rows.collect()] == ["a/c", None, "", "a/b"]
    tree = spark.createDataFrame([(p,) for p in FILES], "path string")
    assert {(r.module, r.path) for r in rust_modules(tree).collect()} == {
        ("crate", "rs/src/lib.rs"), ("crate::geo", "rs/src/geo/mod.rs"), ("crate::geo::point", "rs/src/geo/point.rs"),
    }


def test_empty(spark):
    sources = spark.createDataFrame([], "path string, content binary")
    assert resolve_all(extract(sources), sources.select("path")).count() == 0
