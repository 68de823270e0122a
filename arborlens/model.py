"""Schemas, fixed dimensions and default configuration of the graph of symbols."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F, types as T

FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("updated_at", T.LongType()),
    ]
)
SYMBOLS = T.StructType(
    [
        T.StructField("qualified_name", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("line_start", T.LongType()),
        T.StructField("line_end", T.LongType()),
        T.StructField("col_start", T.LongType()),
        T.StructField("col_end", T.LongType()),
        T.StructField("visibility", T.StringType()),
        T.StructField("is_exported", T.BooleanType()),
        T.StructField("is_async", T.BooleanType()),
        T.StructField("is_test", T.BooleanType()),
        T.StructField("decorators", T.ArrayType(T.StringType())),
        T.StructField("signature", T.StringType()),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("edge_id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)

# Edge kinds by confidence tier (0 structural, 1 low, 2 medium, 3 high).
EDGE_KIND_TIERS = {
    3: ["calls", "extends", "implements", "embeds"],
    2: ["imports_from", "barrel_re_export_all", "re_export", "type_reference", "dot_import"],
    1: ["depends_on", "conditional_import", "side_effect_import"],
    0: ["contains", "child_of", "has_decorator", "tested_by"],
}
CONFIDENCE_NAMES = ["structural", "low", "medium", "high"]
HIGH_KINDS = EDGE_KIND_TIERS[3]
USAGE_KINDS = EDGE_KIND_TIERS[3] + EDGE_KIND_TIERS[2] + EDGE_KIND_TIERS[1]
EDGE_KINDS = [kind for tier in (3, 2, 1, 0) for kind in EDGE_KIND_TIERS[tier]]
# Symbol kinds.
SYMBOL_KINDS = [
    "function", "class", "interface", "struct", "trait", "enum",
    "type_alias", "method", "property", "const", "macro", "variable", "component", "test",
]


def plain_key(key: Column) -> Column:
    """The plain spelling of a path or qualified name: trimmed, ``/`` for a backslash, one leading ``./`` removed.

    Most keys are plain already, so the rewriting steps run only where a test finds something to rewrite.
    """
    trimmed = F.trim(key)
    slashed = F.when(F.contains(trimmed, F.lit("\\")), F.translate(trimmed, "\\", "/")).otherwise(trimmed)
    return F.when(F.startswith(slashed, F.lit("./")), F.substr(slashed, F.lit(3))).otherwise(slashed)


def snake_kind(kind: Column) -> Column:
    """Store name of an edge kind given in either notation (``TypeReference`` and ``type_reference``)."""
    return F.when(kind == F.lower(kind), kind).otherwise(F.lower(F.regexp_replace(kind, r"(?<=[a-z])(?=[A-Z])", "_")))


def confidence_rank(kind: Column) -> Column:
    """0-3 by tier; null for a kind outside the fixed list."""
    rank = F.lit(None).cast("int")
    for tier, kinds in EDGE_KIND_TIERS.items():
        rank = F.when(kind.isin(kinds), F.lit(tier)).otherwise(rank)
    return rank


def parse_confidence(label: str) -> int:
    """Rank of a confidence label; ``all`` is an alias of ``structural``."""
    wanted = label.strip().lower()
    if wanted == "all":
        return 0
    if wanted not in CONFIDENCE_NAMES:
        raise ValueError(f"unknown confidence {label!r}; use high, medium, low, structural or all")
    return CONFIDENCE_NAMES.index(wanted)


@dataclass(frozen=True)
class FlowConfig:
    max_depth: int = 20
    max_flows: int = 1000
    max_public_roots: int = 50
    extra_entry_patterns: tuple[str, ...] = ()
    excluded_entry_patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class CloneConfig:
    threshold: float = 0.7
    min_lines: int = 5


@dataclass(frozen=True)
class RiskConfig:
    criticality: float = 0.30
    coupling: float = 0.25
    test_gap: float = 0.25
    sensitivity: float = 0.20
    min_score: float = 0.0
    # Name segments that mark sensitive code.
    patterns: tuple[str, ...] = (
        "auth", "password", "secret", "token", "crypto", "credential", "sql", "exec", "eval", "unsafe",
    )

    def weights(self) -> tuple[float, float, float, float]:
        """The four weights scaled to sum 1; the defaults where they sum to 0."""
        own = (self.criticality, self.coupling, self.test_gap, self.sensitivity)
        total = sum(own)
        return tuple(w / total for w in own) if total > 0 else (0.30, 0.25, 0.25, 0.20)


@dataclass(frozen=True)
class CommunityConfig:
    resolution: float = 1.0
    min_size: int = 2
    max_rounds: int = 20


@dataclass(frozen=True)
class DeadCodeConfig:
    # Files of schema migrations, kept out of the report.
    migration_globs: tuple[str, ...] = ("**/migrations/**", "**/migrate/**", "**/alembic/**", "**/diesel/migrations/**")
    exclude_globs: tuple[str, ...] = ()
    entry_patterns: tuple[str, ...] = ()
    include_tests: bool = False
    kind_filter: tuple[str, ...] = ()


@dataclass(frozen=True)
class SearchConfig:
    rrf_k: int = 60
    kind_boost: bool = True
    limit: int = 20


@dataclass(frozen=True)
class EngineConfig:
    flows: FlowConfig = field(default_factory=FlowConfig)
    clones: CloneConfig = field(default_factory=CloneConfig)
    risk: RiskConfig = field(default_factory=RiskConfig)
    communities: CommunityConfig = field(default_factory=CommunityConfig)
    dead_code: DeadCodeConfig = field(default_factory=DeadCodeConfig)
    search: SearchConfig = field(default_factory=SearchConfig)
