"""Text, vector and hybrid search, embedding upkeep, and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import HIGH_KINDS
from ..operators.evaluate import blast_scores, macro_f1, precision_at, ranked, reciprocal_ranks
from ..operators.search import (
    fuse,
    hash_embedder,
    hybrid_search,
    nearest_in_blocks,
    nearest_to,
    orphan_embeddings,
    phrase_search,
    symbol_texts,
    texts_to_embed,
)
from ..operators.traversal import nodes_within
from ..runtime import materialize
from ..sources.tables import read_table
from .common import edges, sql_list, symbols, with_graph

_COLUMNS = ("name", "kind", "file_path", "signature")


def _symbols(spark, sf):
    return materialize(symbols(spark, sf, *_COLUMNS), "search-symbols")[0]


def search_text(spark, sf):
    return phrase_search(_symbols(spark, sf), "scope", None)


def search_phrase(spark, sf):
    return phrase_search(_symbols(spark, sf), "libs text sl", None)


def search_top(spark, sf):
    return phrase_search(_symbols(spark, sf), "store", 20)


def search_rrf(spark, sf):
    own = _symbols(spark, sf)
    return fuse([phrase_search(own, "store", 20), phrase_search(own, "draft", 20)]).select("qualified_name", F.round("score", 9).alias("score"))


def search_boosted(spark, sf):
    found = hybrid_search(_symbols(spark, sf), "Draft", mode="text")
    return found.select("qualified_name", "name", "kind", "file_path", F.round("score", 5).alias("score"))


def search_hybrid(spark, sf):
    own = _symbols(spark, sf)
    texts = symbol_texts(own, edges(spark, sf)).select("qualified_name", hash_embedder()(F.col("text")).alias("vector"))
    texts, _ = materialize(texts, "symbol-vectors")
    query = spark.createDataFrame([("store draft",)], "q string").select(hash_embedder()(F.col("q"))).first()[0]
    return hybrid_search(own, "store", nearest_to(texts, "qualified_name", "vector", query, 20))


def vector_neighbours(spark, sf):
    """The ten nearest rows of every vector whose id is divisible by 20, among all vectors."""
    rows = read_table(spark, sf, "embeddings")
    found = nearest_in_blocks(rows.where(F.col("vec_id") % 20 == 0), rows, "vec_id", "embedding", 10)
    return found.select("query", "neighbour", "position", F.round("score", 5).alias("score"))


def vector_top(spark, sf):
    rows = read_table(spark, sf, "embeddings")
    query = [1.0 if i % 2 else -0.5 for i in range(64)]
    return nearest_to(rows, "vec_id", "embedding", query, 20).select("vec_id", F.round("score", 5).alias("score"))


def embed_texts(spark, sf):
    return symbol_texts(_symbols(spark, sf), edges(spark, sf))


def _stored(texts, own):
    """What an earlier state held: every text hash, but of symbols with a null signature another one, and one name too many."""
    blank = F.col("signature").isNull()
    held = own.select("qualified_name", blank.alias("blank")).join(texts, "qualified_name")
    held = held.select("qualified_name", F.when(F.col("blank"), "old").otherwise(F.col("text_hash")).alias("text_hash"))
    return held.unionByName(texts.sparkSession.createDataFrame([("gone.py::gone", "old")], "qualified_name string, text_hash string"))


def embed_changed(spark, sf):
    own = _symbols(spark, sf)
    texts, _ = materialize(symbol_texts(own, edges(spark, sf)), "texts")
    return texts_to_embed(texts, _stored(texts, own)).select("qualified_name")


def embed_orphans(spark, sf):
    """Of vectors stored for everything that is called, those that belong to no current symbol."""
    called = edges(spark, sf).where(F.col("kind") == "calls").select(F.col("target").alias("qualified_name")).distinct()
    return orphan_embeddings(called, _symbols(spark, sf))


def _label_ranking(spark, sf):
    """Vector neighbours as search results; expected are all rows of the query's label."""
    rows = read_table(spark, sf, "embeddings")
    queries = rows.where(F.col("vec_id") % 20 == 0)
    found, _ = materialize(nearest_in_blocks(queries, rows, "vec_id", "embedding", 10), "eval-neighbours")
    labels = rows.select(F.col("vec_id").alias("item"), "label")
    results = ranked(found, "query", "neighbour", "score")
    wanted = results.join(queries.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id").join(labels, "item")
    expected = wanted.where(F.col("own") == F.col("label")).select("query_id", "item")
    return results, expected, queries.select(F.col("vec_id").alias("query_id"))


def eval_mrr(spark, sf):
    return reciprocal_ranks(*_label_ranking(spark, sf)).agg(F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.count(F.lit(1)).alias("n_queries"))


def eval_precision(spark, sf):
    return precision_at(*_label_ranking(spark, sf), 5).agg(F.round(F.avg("precision"), 6).alias("precision_at_5"))


def _impact(spark, sf):
    """Impact of every source of high edges."""
    links, _ = materialize(edges(spark, sf), "edges")
    high = links.where(F.col("kind").isin(HIGH_KINDS))
    starts = high.select(F.col("source").alias("start")).distinct()
    near = nodes_within(links.where(F.col("kind") != "contains"), starts, "forward", 2).select(F.col("start").alias("scenario"), "node")
    sure = nodes_within(high, starts, "forward", 3).select(F.col("start").alias("scenario"), "node")
    return near, sure, starts.select(F.col("start").alias("scenario"))


def _scores(impact):
    return blast_scores(*impact).select("scenario", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def _means(impact):
    means = macro_f1(blast_scores(*impact))
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


def eval_blast(spark, sf):
    return _scores(_impact(spark, sf))


def eval_blast_f1(spark, sf):
    return _means(_impact(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        search_text, search_phrase, search_top, search_rrf, search_boosted, search_hybrid, vector_neighbours, vector_top, embed_texts,
        embed_changed, embed_orphans, eval_mrr, eval_precision, eval_blast, eval_blast_f1,
    )
}

_TERMS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"


def _phrase(words: list[str], name: str, limit: int | None = None) -> str:
    """CTEs that rank the symbols with a phrase (last word a prefix); needs CTE doc."""
    *exact, last = words
    same = " AND ".join([*(f"t[i + {n}] = '{w}'" for n, w in enumerate(exact)), f"starts_with(t[i + {len(exact)}], '{last}')"])
    cut = f" ORDER BY score DESC, qualified_name LIMIT {limit}" if limit else ""
    return f"""{name}_tf AS (SELECT qualified_name, sum(len(list_filter(range(1, len(t) - {len(exact)} + 1), lambda i: {same}))) AS tf FROM txt GROUP BY 1 HAVING tf > 0),
{name} AS (SELECT h.qualified_name, round(ln(1 + (n_docs - n_hits + 0.5) / (n_hits + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len)), 6) AS score
  FROM {name}_tf h JOIN doc d USING (qualified_name), (SELECT count(*) AS n_hits FROM {name}_tf) n,
    (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM doc) a{cut})"""


_DOC = f"""{with_graph("sym")}, txt AS (SELECT qualified_name, unnest([{", ".join(_TERMS.format(c) for c in ("name", "qualified_name", "file_path", "signature"))}]) AS t FROM sym),
doc AS (SELECT qualified_name, sum(len(t)) AS len FROM txt GROUP BY 1), """
_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"
_NEAR = f"""WITH pairs AS (SELECT a.vec_id AS query, a.label AS own, b.vec_id AS neighbour, b.label, {_COS} AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS position FROM pairs QUALIFY position <= 10)"""
_SHORT = "split_part({0}, '::', -1)"
_TEXTS = f"""{with_graph("sym", "edg")}, c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY edge_id) AS o, row_number() OVER (PARTITION BY target ORDER BY edge_id) AS i FROM edg WHERE kind = 'calls'),
outs AS (SELECT source AS q, 'calls ' || string_agg({_SHORT.format("target")}, ', ' ORDER BY edge_id) AS x FROM c WHERE o <= 3 GROUP BY 1),
ins AS (SELECT target AS q, 'called by ' || string_agg({_SHORT.format("source")}, ', ' ORDER BY edge_id) AS x FROM c WHERE i <= 3 GROUP BY 1),
tex AS (SELECT s.qualified_name, s.signature, concat_ws(', ', array_to_string(list_transform(string_split(kind, '_'), lambda w: upper(w[1]) || w[2:]), ''), name,
  'in ' || coalesce(nullif(regexp_replace(regexp_extract(coalesce(file_path, ''), '[^/]*$'), '(.)\\.[^.]*$', '\\1'), ''), 'unknown'), 'signature: ' || signature, outs.x, ins.x) AS text
  FROM sym s LEFT JOIN outs ON outs.q = s.qualified_name LEFT JOIN ins ON ins.q = s.qualified_name)"""


def _blast_sql() -> str:
    def walk(name: str, table: str, depth: int) -> str:
        return f"""{name}w(start, node, d) AS (SELECT start, start, 0 FROM st UNION SELECT w.start, e.target, w.d + 1 FROM {name}w w JOIN {table} e ON e.source = w.node WHERE w.d < {depth}),
{name} AS (SELECT DISTINCT start AS scenario, node FROM {name}w WHERE node <> start)"""

    return f"""{with_graph("edg", recursive=True)}, hig AS (SELECT * FROM edg WHERE kind IN ({sql_list(HIGH_KINDS)})), non AS (SELECT * FROM edg WHERE kind <> 'contains'),
st AS (SELECT DISTINCT source AS start FROM hig), {walk("pre", "non", 2)}, {walk("exp", "hig", 3)},
sco AS (SELECT s.start AS scenario, coalesce(g / nullif(n, 0), 0) AS precision, coalesce(g / nullif(w, 0), 0) AS recall FROM st s
  LEFT JOIN (SELECT p.scenario, count(*) AS n, count(e.node) AS g FROM pre p LEFT JOIN exp e ON e.scenario = p.scenario AND e.node = p.node GROUP BY 1) a ON a.scenario = s.start
  LEFT JOIN (SELECT scenario, count(*) AS w FROM exp GROUP BY 1) b ON b.scenario = s.start)"""


ORACLE = {
    "search_text": _DOC + _phrase(["scope"], "r") + " SELECT * FROM r",
    "search_phrase": _DOC + _phrase(["libs", "text", "sl"], "r") + " SELECT * FROM r",
    "search_top": _DOC + _phrase(["store"], "r", 20) + " SELECT * FROM r",
    "search_rrf": _DOC
    + _phrase(["store"], "r", 20)
    + ", "
    + _phrase(["draft"], "q", 20)
    + """, u AS (SELECT qualified_name, row_number() OVER (ORDER BY score DESC, qualified_name) AS n FROM r UNION ALL
  SELECT qualified_name, row_number() OVER (ORDER BY score DESC, qualified_name) FROM q) SELECT qualified_name, round(sum(1.0::DOUBLE / (60 + n)), 9) AS score FROM u GROUP BY 1""",
    "search_boosted": _DOC
    + _phrase(["draft"], "r", 20)
    + """ SELECT s.qualified_name, name, kind, file_path, round(score * CASE WHEN kind IN ('struct', 'trait', 'interface') THEN 1.5 ELSE 1 END, 5) AS score FROM r JOIN sym s USING (qualified_name)""",
    "vector_neighbours": _NEAR + " SELECT query, neighbour, position, round(s, 5) AS score FROM near",
    "vector_top": f"""SELECT b.vec_id, round({_COS}, 5) AS score FROM embeddings b,
  (SELECT list_transform(range(64), lambda i: CASE WHEN i % 2 = 1 THEN 1.0 ELSE -0.5 END) AS embedding) a ORDER BY {_COS} DESC, b.vec_id LIMIT 20""",
    "embed_texts": _TEXTS + " SELECT qualified_name, text, sha256(text) AS text_hash FROM tex",
    "embed_changed": _TEXTS + " SELECT qualified_name FROM tex WHERE signature IS NULL",
    "embed_orphans": with_graph("sym", "edg")
    + " SELECT DISTINCT target AS qualified_name FROM edg WHERE kind = 'calls' AND target NOT IN (SELECT qualified_name FROM sym)",
    "eval_mrr": _NEAR
    + """, f AS (SELECT query, min(position) FILTER (own = label) AS p FROM near GROUP BY 1) SELECT round(avg(coalesce(1.0::DOUBLE / p, 0)), 6) AS mrr, count(*) AS n_queries FROM f""",
    "eval_precision": _NEAR
    + ", f AS (SELECT query, count(*) FILTER (own = label) / count(*) AS p FROM near WHERE position <= 5 GROUP BY 1) SELECT round(avg(p), 6) AS precision_at_5 FROM f",
    "eval_blast": _blast_sql() + " SELECT scenario, round(precision, 6) AS precision, round(recall, 6) AS recall FROM sco",
    "eval_blast_f1": _blast_sql()
    + """, m AS (SELECT avg(precision) AS p, avg(recall) AS r FROM sco) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM m""",
}
