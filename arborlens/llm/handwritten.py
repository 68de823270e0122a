"""Generated, minified, vendored and data files among sources, by belief propagation over the directory tree.

Nodes are directories and files, each with one of five labels. A file's content
and name give evidence (log-likelihoods per label, see ``evidence``); its stated
language and a directory's name give a prior that evidence can beat. Neighbours are tied by compatibilities: a directory passes its label
to what lies in it (parent to child), and so what lies in it speaks to its
neighbours through their common directory (sibling to sibling). The tree has no
loops, so one pass of messages from the deepest directories up and one pass
down give the exact marginals.

Messages to a directory are sums of logarithms, so they are summed before they
are shuffled, and a directory of a third of all files is no hot spot. On the
way down files meet their directory in a load-balanced join.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import balanced_join
from ..runtime import materialize, remove_path
from .evidence import BLOB, GENERATED, HAND, LABELS, MINIFIED, VENDORED, HouseStyle, file_evidence, fitted

# Directory names that hold other people's code, and the output of tools. Compared in lower case.
VENDOR_DIRS = [
    "vendor", "vendored", "_vendored", "_vendor", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party",
    "node_modules", "bower_components", "site-packages", "dist-packages", "venv", ".venv", "virtualenv",
    "deps", "external", "externals", "contrib", "pods", "carthage", "godeps", "jspm_packages",
]
OUTPUT_DIRS = ["gen", "generated", "__generated__", "_generated", "autogen", "auto_generated", "target", "codegen-out", "generated-sources"]
BUNDLE_DIRS = ["dist", "build", "out", "public", "assets", "static", "bundles", "bundle"]


# Languages that name a data format. Compared in lower case.
DATA_LANGUAGES = ["json", "csv", "tsv", "xml", "yaml", "toml", "svg", "data", "binary"]
#: Log prior of the labels at a root, and what a telling name of a directory or language adds.
ROOT_PRIOR = [0.0, -4.5, -5.5, -4.5, -5.5]
TELLING, SUGGESTIVE, SLIGHT = 11.0, 4.0, 1.5


def directory_evidence(folders: list[str]) -> list[float]:
    """Evidence of a directory (given by all names from the root) under each label: its name, and at a root the prior."""
    score = list(ROOT_PRIOR) if len(folders) < 2 else [0.0] * 5
    name = folders[-1].lower() if folders else ""
    if name in VENDOR_DIRS:
        score[VENDORED] += TELLING
    elif name in OUTPUT_DIRS and not (name == "target" and len(folders) < 2):
        score[GENERATED] += TELLING
    elif name in BUNDLE_DIRS:
        score[MINIFIED] += SUGGESTIVE
        score[GENERATED] += SLIGHT
    return score


def _compatibility(stay: float, hand_stay: float) -> list[list[float]]:
    """Log compatibility [parent label][child label]: what is no hand work keeps its label, hand work mostly."""
    rows = []
    for parent in range(5):
        keep = hand_stay if parent == HAND else stay
        rows.append([math.log(keep if child == parent else (1 - keep) / 4) for child in range(5)])
    return rows


TO_FILE = _compatibility(stay=0.985, hand_stay=0.80)
TO_DIRECTORY = _compatibility(stay=0.99, hand_stay=0.995)


def _message(belief: Column, tie: list[list[float]]) -> Column:
    """Log message over an edge: for each label of the receiver, the log-sum-exp over the sender's beliefs and ``tie``."""
    rows = F.array(*[F.array(*[F.lit(t) for t in row]) for row in tie])
    top = F.array_max(belief)
    total = lambda row: F.aggregate(F.zip_with(row, belief, lambda t, b: F.exp(t + b - top)), F.lit(0.0), lambda a, x: a + x)
    return F.transform(rows, lambda row: top + F.log(total(row)))


def _up(belief: Column, tie: list[list[float]]) -> Column:
    return _message(belief, tie)


def _down(cavity: Column, tie: list[list[float]]) -> Column:
    return _message(cavity, [list(column) for column in zip(*tie)])


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _sums(name: str) -> Column:
    return F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(5)]).alias(name)


def _measure(style: HouseStyle, weights):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, folders, found = [], [], []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                *above, name = path.replace("\\", "/").split("/")
                paths.append(path)
                folders.append("/".join(above))
                found.append(file_evidence(name, content, style, weights=weights))
            arrays = [pa.array(paths, pa.string()), pa.array(folders, pa.string()), pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["path", "folder", "e"])

    return run


def _prior(folder: Column) -> Column:
    """``directory_evidence`` as a column expression."""
    parts = F.split(folder, "/")
    name = F.lower(F.element_at(parts, -1))
    vendor, bundle = name.isin(VENDOR_DIRS), name.isin(BUNDLE_DIRS)
    output = name.isin(OUTPUT_DIRS) & ~((name == "target") & (F.size(parts) < 2))
    base = F.when(F.size(parts) < 2, F.array(*[F.lit(p) for p in ROOT_PRIOR])).otherwise(F.array_repeat(F.lit(0.0), 5))
    extra = F.array(
        F.lit(0.0), F.when(output, TELLING).when(bundle, SLIGHT).otherwise(0.0), F.when(bundle, SUGGESTIVE).otherwise(0.0),
        F.when(vendor, TELLING).otherwise(0.0), F.lit(0.0),
    )
    return _plus(base, extra)


def classify_sources(sources: DataFrame, style: HouseStyle = HouseStyle(), languages: DataFrame | None = None) -> DataFrame:
    """Label every path of ``sources`` (path, content): ``path, label, p_handwritten`` (rounded to 6 places).

    Rows with a null path are ignored; a path that comes several times is judged
    once, by all its contents together. Null or blank content is hand work
    wherever it lies. An empty table gives no rows. Further columns are ignored.
    ``languages`` (path, language; one row per path) may state the language of
    some paths; one that names a data format speaks for data.

    Folders are joined level by level, so rounds grow with the depth of the tree.
    """
    spark = sources.sparkSession
    files = sources.where(F.col("path").isNotNull()).select("path", "content")
    files = files.mapInArrow(_measure(style, fitted()), "path string, folder string, e array<double>")
    files = files.groupBy("path", "folder").agg(_sums("e"))
    if languages is not None:
        data = languages.where(F.lower("language").isin(DATA_LANGUAGES)).select("path", F.lit(True).alias("is_data"))
        more = F.array(*[F.when(F.col("is_data") & F.lit(i == BLOB), SLIGHT).otherwise(0.0) for i in range(5)])
        files = files.join(data, "path", "left").select("path", "folder", _plus(F.col("e"), more).alias("e"))
    files, files_path = materialize(files.withColumn("u", _up(F.col("e"), TO_FILE)), "file-evidence")
    inner = files.groupBy("folder").agg(_sums("u"))
    names = F.split("folder", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.array_join(F.slice(names, 1, n), "/"))
    nodes = inner.select(F.explode(ancestors).alias("folder")).distinct().join(inner, "folder", "left")
    nodes = nodes.withColumn("depth", F.size(F.split("folder", "/")))
    nodes = nodes.withColumn("parent", F.when(F.col("depth") > 1, F.expr("array_join(slice(split(folder, '/'), 1, depth - 1), '/')")))
    told = F.coalesce("u", F.array_repeat(F.lit(0.0), 5))
    nodes, nodes_path = materialize(nodes.select("folder", "parent", "depth", _plus(_prior(F.col("folder")), told).alias("b")), "folders")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    levels: dict[int, DataFrame] = {}
    used = [nodes_path]
    below = None
    for depth in range(deepest, 0, -1):
        own = nodes.where(F.col("depth") == depth)
        if below is not None:
            heard = below.groupBy(F.col("parent").alias("folder")).agg(_sums("u"))
            own = own.join(heard, "folder", "left").select("folder", "parent", "depth", _plus(F.col("b"), told).alias("b"))
        levels[depth], path = materialize(own.withColumn("u", _up(F.col("b"), TO_DIRECTORY)), f"folders-up-{depth}")
        used.append(path)
        below = levels[depth]
    done: list[DataFrame] = []
    above = None
    for depth in range(1, deepest + 1):
        own = levels[depth]
        if above is None:
            own = own.select("folder", "b")
        else:
            over = above.select(F.col("folder").alias("parent"), F.col("b").alias("a"))
            heard = _down(_minus(F.col("a"), F.col("u")), TO_DIRECTORY)
            own = own.join(over, "parent", "left").select("folder", _plus(F.col("b"), heard).alias("b"))
        above, _ = materialize(own, f"folders-down-{depth}")
        done.append(above)
    for path in used:
        remove_path(spark, path)
    if not done:
        return spark.createDataFrame([], "path string, label string, p_handwritten double")
    placed = balanced_join(files, reduce(DataFrame.unionByName, done), "folder")
    final = placed.select("path", _plus(F.col("e"), _down(_minus(F.col("b"), F.col("u")), TO_FILE)).alias("f"))
    best = F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.array_position("f", F.array_max("f")).cast("int"))
    odds = F.aggregate("f", F.lit(0.0), lambda a, x: a + F.exp(x - F.get("f", F.lit(HAND))))
    hand = F.lit(1.0) / odds
    return final.select("path", F.when(hand >= 0.5, F.lit(LABELS[HAND])).otherwise(best).alias("label"), F.round(hand, 6).alias("p_handwritten"))
