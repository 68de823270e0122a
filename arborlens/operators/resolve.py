"""Imports to files, by joins of ranked candidates with the file tree.

Each import names one or more candidate paths in order of preference. All
candidates are joined with the tree at once and the first that exists wins, so
resolution is one shuffle on paths for any number of imports.
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import extension
from ..runtime import materialize
from ..sources.extract import GRAMMAR_BY_EXTENSION, part

TS_SUFFIXES = ["", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
#: Modules of the language's standard library, as the running interpreter lists them.
PYTHON_STDLIB = sorted(sys.stdlib_module_names)


def folder_of(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def normal_path(path: Column) -> Column:
    """A relative path without ``.`` and ``..`` steps; null if it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    start = F.array().cast("array<string>")

    def step(seen: Column, p: Column) -> Column:
        popped = F.when(F.size(seen) > 0, F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0))))
        return F.when(seen.isNull(), F.lit(None)).when(p == "..", popped).otherwise(F.array_append(seen, p))

    return F.array_join(F.aggregate(parts, start, step), "/")


def _first_existing(candidates: DataFrame, tree: DataFrame) -> DataFrame:
    """Candidates (key..., rank, candidate) reduced to the first of each (path, line, specifier) that is in the tree."""
    found = candidates.join(tree.select(F.col("path").alias("candidate")).distinct(), "candidate")
    by = ["path", "line", "specifier"]
    return found.groupBy(*by).agg(F.min(F.struct("rank", "candidate"))["candidate"].alias("resolved"))


def _grammar(path: str) -> Column:
    pairs = [x for k, v in GRAMMAR_BY_EXTENSION.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), extension(F.col(path)))


def resolve_typescript(imports: DataFrame, tree: DataFrame) -> DataFrame:
    """Relative specifiers to files: as they stand, with each extension, then as folders with an index."""
    own = imports.where((_grammar("path") == "ts") & F.startswith("specifier", F.lit(".")))
    base = normal_path(F.concat_ws("/", folder_of(F.col("path")), F.col("specifier")))
    plain = own.withColumn("base", base).where(F.col("base").isNotNull())
    ranked = plain.select("path", "line", "specifier", F.posexplode(F.array(*[F.concat("base", F.lit(s)) for s in TS_SUFFIXES])).alias("rank", "candidate"))
    return _first_existing(ranked, tree)


def resolve_python(imports: DataFrame, tree: DataFrame, package_roots: list[str] | None = None) -> DataFrame:
    """Dotted modules to ``.py`` files or packages: relative by dots, else each package root, then the project root."""
    own = imports.where(_grammar("path") == "py")
    dots = F.length(F.regexp_extract("specifier", r"^(\.*)", 1))
    rest = F.translate(F.regexp_replace("specifier", r"^\.+", ""), ".", "/")
    ups = F.array_join(F.array_repeat(F.lit(".."), F.greatest(dots - 1, F.lit(0)).cast("int")), "/")
    roots = [*(package_roots or ["src"]), ""]
    relative = F.array(normal_path(F.concat_ws("/", folder_of(F.col("path")), ups, rest)))
    absolute = F.array(*[normal_path(F.concat_ws("/", F.lit(r), rest)) for r in roots])
    known = F.substring_index("specifier", ".", 1).isin(PYTHON_STDLIB)
    bases = F.when(dots > 0, relative).when(~known, absolute)
    spread = own.select("path", "line", "specifier", F.posexplode(bases).alias("i", "base")).where(F.col("base").isNotNull())
    both = F.array(F.concat("base", F.lit(".py")), F.when(F.col("base") == "", "__init__.py").otherwise(F.concat("base", F.lit("/__init__.py"))))
    ranked = spread.select("path", "line", "specifier", "i", F.posexplode(both).alias("j", "candidate"))
    return _first_existing(ranked.withColumn("rank", F.col("i") * 2 + F.col("j")), tree)


def resolve_go(imports: DataFrame, tree: DataFrame, module: str | None) -> DataFrame:
    """Edges of Go imports: blank and dot imports always, others if they name a folder of the module that holds files."""
    own = imports.where(_grammar("path") == "go")
    inside = F.lit(False)
    if module:
        inside = (F.col("specifier") == module) | F.startswith("specifier", F.lit(module + "/"))
        own = own.withColumn("folder", F.when(inside, F.substr("specifier", F.lit(len(module) + 2))))
    else:
        own = own.withColumn("folder", F.lit(None).cast("string"))
    steps = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    folders = tree.select(F.explode(prefixes).alias("folder")).distinct().withColumn("is_there", F.lit(True))
    known = own.join(folders, "folder", "left")
    there = F.col("is_there").isNotNull()
    kind = F.when(F.col("is_side_effect"), "side_effect_import").when(F.col("is_namespace"), "dot_import").when(there, "imports_from")
    target = F.when(there & ~F.col("is_side_effect"), F.col("folder")).otherwise(F.col("specifier"))
    return known.select(kind.alias("kind"), F.col("path").alias("source"), target.alias("target")).where(F.col("kind").isNotNull())


def rust_modules(tree: DataFrame) -> DataFrame:
    """``crate, module, path``: the crate (folder above src) and module path of each Rust file by its place."""
    rust = tree.where(extension(F.col("path")) == "rs").select("path")
    placed = rust.select("path", F.regexp_extract("path", r"^(.*?)(?:^|/)?src/(.*)\.rs$", 1).alias("crate"), F.regexp_extract("path", r"(?:^|/)src/(.*)\.rs$", 1).alias("inner"))
    plain = F.regexp_replace(F.regexp_replace("inner", r"(^|/)mod$", ""), r"^(lib|main)$", "")
    module = F.concat_ws("::", F.lit("crate"), F.when(plain != "", F.regexp_replace(plain, "/", "::")))
    return placed.where(F.col("inner") != "").select("crate", module.alias("module"), "path")


def resolve_rust(imports: DataFrame, tree: DataFrame) -> DataFrame:
    """``crate``, ``self``, ``super`` and ``mod`` paths to files: the deepest known module prefix wins."""
    modules = rust_modules(tree)
    own = imports.where(_grammar("path") == "rs").join(modules.withColumnRenamed("module", "here"), "path")
    parent = F.regexp_replace("here", r"::[^:]*$", "")
    spec = F.col("specifier")
    full = (
        F.when(F.startswith(spec, F.lit("crate::")) | (spec == "crate"), spec)
        .when(F.startswith(spec, F.lit("self::")), F.concat("here", F.substr(spec, F.lit(5))))
        .when(F.startswith(spec, F.lit("super::")), F.concat(parent, F.substr(spec, F.lit(6))))
        .when(F.startswith(spec, F.lit("mod::")), F.concat("here", F.substr(spec, F.lit(4))))
    )
    steps = F.split("full", "::")
    spread = own.withColumn("full", full).where(F.col("full").isNotNull()).select(
        "path", "line", "specifier", "crate", F.explode(F.sequence(F.size(steps), F.lit(1))).alias("n"), steps.alias("steps")
    )
    named = spread.select("path", "line", "specifier", "crate", (-F.col("n")).alias("rank"), F.array_join(F.slice("steps", 1, F.col("n")), "::").alias("module"))
    found = named.join(modules.select("crate", "module", F.col("path").alias("candidate")), ["crate", "module"])
    return found.groupBy("path", "line", "specifier").agg(F.min(F.struct("rank", "candidate"))["candidate"].alias("resolved"))


def trace_barrels(imports: DataFrame, resolved: DataFrame, exports: DataFrame, export_files: DataFrame, max_hops: int = 10) -> DataFrame:
    """Imported names followed through re-exports: ``source, target`` of the file a name comes from in the end.

    ``export_files``: path, specifier, resolved of re-exporting statements. A
    named re-export goes before a star, and a star counts only if the file it
    names exports the name itself; of several the first in the file. A file is
    visited once per name. ``max_hops`` is part of the meaning: a name that is
    passed on more often keeps the file where it was last seen.
    """
    declared = exports.where(F.col("kind") != "star").select(F.col("path").alias("to"), "name").distinct()
    names = imports.select("path", "line", "specifier", F.explode("names.name").alias("name"))
    at, _ = materialize(names.join(resolved, ["path", "line", "specifier"]).select(F.col("path").alias("source"), "name", F.col("resolved").alias("at"), F.array("resolved").alias("seen")), "barrel-0")
    onward = exports.where(F.col("specifier").isNotNull()).join(export_files.select("path", "specifier", "resolved").distinct(), ["path", "specifier"])
    onward = onward.select(F.col("path").alias("at"), F.col("name").alias("as_name"), F.when(F.col("kind") == "star", 1).otherwise(0).alias("rank"), "line", F.col("resolved").alias("to"))
    onward, _ = materialize(onward, "barrel-exports")
    ended = []
    for hop in range(max_hops):
        fits = (at["at"] == onward["at"]) & ((onward["rank"] == 1) | (onward["as_name"] == at["name"])) & ~F.array_contains("seen", F.col("to"))
        ways = at.join(onward, fits).select("source", "name", "seen", "rank", "line", "to")
        ways = ways.where(F.col("rank") == 0).unionByName(ways.where(F.col("rank") == 1).join(declared, ["to", "name"], "left_semi"))
        step = ways.groupBy("source", "name", "seen").agg(F.min(F.struct("rank", "line", "to"))["to"].alias("to"))
        moved, _ = materialize(step.select("source", "name", F.col("to").alias("at"), F.array_append("seen", F.col("to")).alias("seen")), f"barrel-{hop + 1}")
        ended.append(moved)
        if moved.isEmpty():
            break
        at = moved
    hops = reduce(DataFrame.unionByName, ended)
    last = Window.partitionBy("source", "name", F.element_at("seen", 1)).orderBy(F.desc(F.size("seen")))
    final = hops.withColumn("r", F.row_number().over(last)).where(F.col("r") == 1)
    return final.where(F.col("at") != F.col("source")).select("source", F.col("at").alias("target")).distinct()


def resolve_all(found: DataFrame, tree: DataFrame, go_module: str | None = None, package_roots: list[str] | None = None) -> DataFrame:
    """All edges of extracted files: structural, import and re-export edges, unique by kind, source and target."""
    imports, _ = materialize(part(found, "imports"), "imports")
    exports, _ = materialize(part(found, "exports"), "exports")
    ts, py, rs = resolve_typescript(imports, tree), resolve_python(imports, tree, package_roots), resolve_rust(imports, tree)
    resolved, _ = materialize(ts.unionByName(py).unionByName(rs), "resolved")
    typed = imports.select("path", "line", "specifier", "is_type_only").distinct()
    both = resolved.join(typed, ["path", "line", "specifier"])
    kind = F.when(F.col("is_type_only") & (_grammar("path") == "py"), "conditional_import").otherwise("imports_from")
    edges = both.select(kind.alias("kind"), F.col("path").alias("source"), F.col("resolved").alias("target"))
    edges = edges.unionByName(resolve_go(imports, tree, go_module))
    again = exports.where(F.col("specifier").isNotNull()).select("path", "line", "specifier", F.array(F.struct("name")).alias("names"), "kind")
    rust_again = again.where(_grammar("path") == "rs").withColumn("specifier", F.concat("specifier", F.lit("::")))
    targets = resolve_typescript(again, tree).unionByName(
        resolve_rust(rust_again, tree).withColumn("specifier", F.regexp_replace("specifier", "::$", ""))
    )
    outward = again.select("path", "line", "specifier", "kind").distinct().join(targets, ["path", "line", "specifier"])
    star = F.when(F.col("kind") == "star", "barrel_re_export_all").otherwise("re_export")
    edges = edges.unionByName(outward.select(star.alias("kind"), F.col("path").alias("source"), F.col("resolved").alias("target")))
    ts_imports = imports.where(_grammar("path") == "ts")
    traced = trace_barrels(ts_imports, ts, exports, targets)
    edges = edges.unionByName(traced.select(F.lit("imports_from").alias("kind"), "source", "target"))
    return edges.unionByName(part(found, "edges").select("kind", "source", "target")).distinct()
