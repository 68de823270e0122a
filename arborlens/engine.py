"""One object with the commands of a code-analysis tool; each returns a DataFrame."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.names import extension
from .functions.vectors import utc_text
from .model import EngineConfig, RiskConfig, confidence_rank, parse_confidence
from .operators import analysis, clones, communities, flows, search
from .operators.evaluate import blast_scores, category_means, precision_at, ranked, reciprocal_ranks
from .operators.symbolgraph import at_least, changed_symbols, find_cards, references_from, references_to, table_counts
from .operators.traversal import bfs, nodes_within
from .runtime import materialize
from .sources.changes import SUPPORTED, diff_hunks
from .sources.store import GraphStore


def target_kind(target: str) -> str:
    """``symbol`` or ``file``: ``::`` names a symbol, a slash or a source extension a file, anything else a symbol."""
    if "::" in target:
        return "symbol"
    return "file" if "/" in target or re.search(rf"[^/]\.({'|'.join(SUPPORTED)})$", target) else "symbol"


class Engine:
    """Analyses of one graph: ``files``, ``symbols`` and ``edges`` as DataFrames."""

    def __init__(self, files: DataFrame, symbols: DataFrame, edges: DataFrame, config: EngineConfig = EngineConfig()):
        self.files, self.symbols, self.edges, self.config = files, symbols, edges, config
        self.spark: SparkSession = symbols.sparkSession

    @classmethod
    def of_store(cls, store: GraphStore, config: EngineConfig = EngineConfig()) -> Engine:
        return cls(store.read("files"), store.read("symbols"), store.read("edges"), config)

    def _frame(self, *names: str) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in names], "start string")

    def find(self, pattern: str) -> DataFrame:
        return find_cards(self.symbols, self.edges, pattern)

    def refs(self, name: str) -> DataFrame:
        return references_to(self.edges, name)

    def callers(self, name: str) -> DataFrame:
        return references_to(self.edges, name, "calls")

    def callees(self, name: str) -> DataFrame:
        return references_from(self.edges, name, "calls")

    def impact(self, *targets: str, depth: int = 3, confidence: str = "all", direction: str = "forward", with_symbols: bool = False) -> DataFrame:
        """Blast radius of each target, strongest last edge first; ``with_symbols`` also starts from a file's symbols."""
        starts = self._frame(*targets)
        if with_symbols:
            inside = self.symbols.where(F.col("file_path").isin([t for t in targets if target_kind(t) == "file"]))
            starts = starts.unionByName(inside.select(F.col("qualified_name").alias("start")))
        return self._radius(starts, depth, confidence, direction)

    def _radius(self, starts: DataFrame, depth: int, confidence: str, direction: str) -> DataFrame:
        found = bfs(at_least(self.edges, parse_confidence(confidence)), starts, direction, depth)
        rank = confidence_rank(F.col("edge_kind"))
        return found.select(F.col("start").alias("target"), "node", "depth", "edge_kind", rank.alias("confidence_rank"), "path").orderBy(F.desc("confidence_rank"), "depth", "target", "node")

    def diff(self, text: str, depth: int = 3, confidence: str = "all", direction: str = "forward") -> DataFrame:
        """Blast radius of the symbols that a unified diff touches."""
        hunks = diff_hunks(self.spark.createDataFrame([(0, text)], "diff_id int, text string"))
        touched = changed_symbols(self.symbols, hunks).select(F.col("qualified_name").alias("start"))
        return self._radius(touched, depth, confidence, direction)

    def dead_code(self) -> DataFrame:
        return analysis.dead_code(analysis.dead_layers(self.symbols, self.edges, self.config.dead_code), self.config.dead_code)

    def entry_points(self) -> DataFrame:
        return analysis.entry_points(self.symbols, self.edges, self.config.flows)

    def flows(self, through: str | None = None) -> DataFrame:
        if through:
            return flows.flows_through(through, self.entry_points(), self.edges, self.config.flows.max_depth)
        return flows.capped_flows(self.entry_points(), self.edges, self.config.flows)

    def flows_truncated(self) -> bool:
        """Whether there are more flows than ``flows`` gives."""
        return flows.flows_truncated(self.entry_points(), self.edges, self.config.flows)

    def criticality(self) -> DataFrame:
        entries, _ = materialize(self.entry_points(), "entries")
        found = flows.criticality(self.symbols, self.edges, flows.capped_flows(entries, self.edges, self.config.flows), entries)
        return found.orderBy(F.desc("betweenness"), "qualified_name")

    def risk(self, extra_patterns: tuple[str, ...] = (), without_patterns: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
        """Risk of every symbol, or of the ``limit`` riskiest; patterns are the configured and extra ones less those taken out."""
        own = self.config.risk
        patterns = tuple(p for p in dict.fromkeys((*own.patterns, *extra_patterns)) if p not in without_patterns)
        config = RiskConfig(own.criticality, own.coupling, own.test_gap, own.sensitivity, own.min_score, patterns)
        between = flows.betweenness(self.symbols, self.edges).withColumnRenamed("betweenness", "criticality")
        found = analysis.risk_scores(self.symbols, self.edges, between, config).orderBy(F.desc("composite"), "qualified_name")
        return found if limit is None else found.limit(limit)

    def clones(self, sources: DataFrame) -> DataFrame:
        """Clusters of clones; ``sources``: path, content (text)."""
        prints = clones.fingerprints(self.symbols, self.edges, self.config.clones)
        classes, _ = materialize(clones.clone_classes(prints, sources), "clone-classes")
        return clones.clone_clusters(classes, clones.clone_pairs(classes, self.config.clones))

    def communities(self) -> DataFrame:
        return communities.detect(self.symbols, self.edges, self.config.communities)

    def community_of(self, name: str) -> DataFrame:
        found, _ = materialize(self.communities(), "communities")
        own = found.where(F.col("qualified_name") == name).select("community_id")
        return found.join(F.broadcast(own), "community_id", "left_semi")

    def search(self, query: str, nearest: DataFrame | None = None, mode: str = "hybrid") -> DataFrame:
        return search.hybrid_search(self.symbols, query, nearest, self.config.search, mode)

    def stats(self) -> DataFrame:
        """Counts of the tables, by language and by kind: ``table_name, n``."""
        counts = table_counts(files=self.files, symbols=self.symbols, edges=self.edges)
        for label, frame, column in (("files", self.files, "language"), ("symbols", self.symbols, "kind"), ("edges", self.edges, "kind")):
            by = frame.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
            counts = counts.unionByName(by.select(F.concat(F.lit(f"{label}: "), F.coalesce(column, F.lit("none"))).alias("table_name"), "n"))
        return counts

    def stats_card(self, sources: DataFrame | None = None, central_limit: int | None = None, clone_limit: int | None = None) -> DataFrame:
        """``measure, value``: risk and flow figures, and clones if ``sources`` are given.

        Nothing is left out unless asked for: centrality and risk above
        ``central_limit`` symbols, clones above ``clone_limit``.
        """
        n = self.symbols.count()
        rows = [("symbols", float(n))]
        if central_limit is None or n <= central_limit:
            risk = analysis.risk_stats(self.risk()).first()
            rows += [(k, float(risk[k])) for k in ("avg_risk", "median_risk", "p90_risk", "files_scored")]
            seen = flows.flow_stats(self.flows()).first()
            rows += [(k, float(seen[k])) for k in ("n_flows", "n_entries", "max_depth", "avg_depth")]
        if sources is not None and (clone_limit is None or n <= clone_limit):
            prints = clones.fingerprints(self.symbols, self.edges, self.config.clones)
            classes, _ = materialize(clones.clone_classes(prints, sources), "clone-classes")
            pairs, _ = materialize(clones.clone_pairs(classes, self.config.clones), "clone-pairs")
            found = clones.clone_summary(prints, clones.clone_clusters(classes, pairs), clones.clone_links(classes, pairs)).first()
            rows += [(k, float(found[k])) for k in ("n_clusters", "n_cloned", "duplication_pct")]
        return self.spark.createDataFrame(rows, "measure string, value double")

    def embed(self, store: GraphStore, embedder, provider: str) -> tuple[int, int]:
        """Embed what is new or changed, drop vectors of vanished symbols; returns how many of each.

        ``embedder`` is a column function from text to vector, such as ``search.hash_embedder()``.
        """
        texts, _ = materialize(search.symbol_texts(self.symbols, self.edges), "texts")
        stored = store.read("embeddings")
        wanted, _ = materialize(search.texts_to_embed(texts, stored), "to-embed")
        orphans, _ = materialize(search.orphan_embeddings(stored, self.symbols), "orphans")
        rows = wanted.select(
            "qualified_name", embedder(F.col("text")).alias("vector"), "text_hash", F.lit(provider).alias("provider"), utc_text(F.unix_timestamp()).alias("created_at")
        )
        n_new, n_gone = wanted.count(), orphans.count()
        if n_new:
            store.store_embeddings(rows)
        if n_gone:
            store.remove_embeddings(orphans)
        return n_new, n_gone

    def search_suite(self, queries: DataFrame, limit: int = 20) -> DataFrame:
        """Mean reciprocal rank and precision by category of ``queries`` (query_id, query, expected, category)."""
        listed = [(r["query_id"], r["query"]) for r in queries.select("query_id", "query").collect()]
        results = search.phrase_search_all(self.symbols, listed, limit)
        found, _ = materialize(ranked(results, "query_id", "qualified_name", "score"), "suite")
        expected = queries.select("query_id", F.explode("expected").alias("item"))
        first = category_means(reciprocal_ranks(found, expected, queries), queries, "reciprocal_rank")
        second = category_means(precision_at(found, expected, queries, 5), queries, "precision").drop("n")
        return first.join(second, "category").orderBy("category")

    def impact_suite(self, scenarios: DataFrame) -> DataFrame:
        """Precision and recall of each of ``scenarios`` (scenario, target, depth, confidence, expected_affected)."""
        groups = scenarios.select("depth", "confidence").distinct().collect()
        predicted = self.spark.createDataFrame([], scenarios.select("scenario").schema).withColumn("node", F.lit(None).cast("string"))
        for g in groups:  # one search for all scenarios of a depth and confidence
            own = scenarios.where(F.col("depth").eqNullSafe(g["depth"]) & F.col("confidence").eqNullSafe(g["confidence"])).select("scenario", F.col("target").alias("start"))
            reached = nodes_within(at_least(self.edges, parse_confidence(g["confidence"])), own.select("start"), "forward", g["depth"])
            predicted = predicted.unionByName(reached.join(own, "start").select("scenario", "node"))
        return blast_scores(predicted, scenarios.select("scenario", F.explode("expected_affected").alias("node")), scenarios)


def json_lines(frame: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return frame.select(F.to_json(F.struct("*")).alias("json"))


def compact_lines(frame: DataFrame, separator: str = "\t") -> DataFrame:
    """Each row as one line of text; arrays are joined by ``,``."""
    columns = [F.array_join(F.col(c).cast("array<string>"), ",") if t.startswith("array") else F.col(c).cast("string") for c, t in frame.dtypes]
    return frame.select(F.concat_ws(separator, *[F.coalesce(c, F.lit("")) for c in columns]).alias("line"))


def source_files(frame: DataFrame) -> DataFrame:
    """Rows whose ``path`` has a supported extension."""
    return frame.where(extension(F.col("path")).isin(SUPPORTED))
