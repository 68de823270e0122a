"""Full-text, vector and hybrid search over symbols, and the texts that are embedded.

A posting is one (term, symbol, column, position); all statistics are counted
over all symbols. A phrase of n terms is n postings of the same column at
consecutive positions, found by one aggregation of the postings of its terms
on (symbol, column, position - offset), not by joins among them.

Vector search compares a stated set of queries with all rows in blocks: rows
and queries are packed into matrices of bounded size, each query block meets
each row block once, and only the best ``k`` of a block pair leave it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import file_stem, pascal, short_name
from ..model import SearchConfig
from .symbolgraph import first_names

#: Constants of the BM25 formula (Robertson et al.).
K1, B = 1.2, 0.75
TEXT_COLUMNS = ["name", "qualified_name", "file_path", "signature"]
MAX_QUERY_BYTES = 500


def terms(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def query_terms(query: str) -> list[str]:
    """Terms of a query cut to 500 bytes at a character; the last one is a prefix."""
    cut = query.encode()[:MAX_QUERY_BYTES].decode("utf-8", "ignore")
    return regex.findall(r"[\p{L}\p{N}]+", cut.lower())


def postings(symbols: DataFrame) -> DataFrame:
    """``qualified_name, column, position, term`` of every text column."""
    parts = F.array(*[F.struct(F.lit(c).alias("column"), terms(F.col(c)).alias("terms")) for c in TEXT_COLUMNS])
    rows = symbols.select("qualified_name", F.explode(parts).alias("p"))
    return rows.select("qualified_name", "p.column", F.posexplode("p.terms").alias("position", "term"))


def phrase_search(symbols: DataFrame, query: str, limit: int | None = 20) -> DataFrame:
    """``qualified_name, score``: symbols with the query as a phrase (last term a prefix) in one column, by BM25.

    Score: idf of the phrase times its saturated frequency in all columns of the
    symbol, against the symbol's number of terms. An empty query, or one
    without a term, finds nothing. Ties are broken by name.
    """
    words = query_terms(query)
    if not words:
        return symbols.sparkSession.createDataFrame([], "qualified_name string, score double")
    lengths = sum((F.size(terms(F.col(c))) for c in TEXT_COLUMNS), F.lit(0))
    totals = symbols.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(lengths).alias("avg_len")).withColumn("one", F.lit(1))
    found = postings(symbols)
    *exact, last = words
    offsets = [F.when(F.col("term") == w, F.lit(i)) for i, w in enumerate(exact)]
    hit = F.array_compact(F.array(*offsets, F.when(F.startswith("term", F.lit(last)), F.lit(len(exact)))))
    near = found.select("qualified_name", "column", F.explode(hit).alias("nth"), "position")
    phrases = near.groupBy("qualified_name", "column", (F.col("position") - F.col("nth")).alias("at")).agg(F.count_distinct("nth").alias("n"))
    hits = phrases.where(F.col("n") == len(words)).groupBy("qualified_name").agg(F.count(F.lit(1)).alias("tf"))
    sized = hits.join(symbols.select("qualified_name", lengths.alias("len")), "qualified_name")
    n_hits = hits.agg(F.count(F.lit(1)).alias("n_hits")).withColumn("one", F.lit(1))
    both = sized.withColumn("one", F.lit(1)).join(F.broadcast(totals), "one").join(F.broadcast(n_hits), "one")
    idf = F.log(1 + (F.col("n_docs") - F.col("n_hits") + 0.5) / (F.col("n_hits") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = both.select("qualified_name", F.round(idf * weight, 6).alias("score"))
    return scored.orderBy(F.desc("score"), "qualified_name").limit(limit) if limit else scored


def phrase_search_all(symbols: DataFrame, queries: list[tuple[int, str]], limit: int = 20) -> DataFrame:
    """``query_id, qualified_name, score``: ``phrase_search`` of many stated queries (id, text) as one plan.

    Postings meet the queries' terms in one join; of a last term they meet its
    prefix, cut to each length that occurs among the queries.
    """
    spark = symbols.sparkSession
    asked = [(i, query_terms(text)) for i, text in queries]
    rows = [(i, n, "^" + w if n == len(words) - 1 else "=" + w, len(words)) for i, words in asked for n, w in enumerate(words)]
    wanted = spark.createDataFrame(rows, "query_id bigint, nth int, token string, n_words int")
    lengths = sorted({len(words[-1]) for _, words in asked if words})
    tokens = F.array(F.concat(F.lit("="), "term"), *[F.when(F.length("term") >= n, F.concat(F.lit("^"), F.substring("term", 1, n))) for n in lengths])
    near = postings(symbols).select("qualified_name", "column", "position", F.explode(F.array_distinct(F.array_compact(tokens))).alias("token")).join(wanted, "token")
    by = ["query_id", "qualified_name"]
    phrases = near.groupBy(*by, "column", "n_words", (F.col("position") - F.col("nth")).alias("at")).agg(F.count_distinct("nth").alias("n"))
    hits = phrases.where(F.col("n") == F.col("n_words")).groupBy(*by).agg(F.count(F.lit(1)).alias("tf"))
    size = sum((F.size(terms(F.col(c))) for c in TEXT_COLUMNS), F.lit(0))
    totals = symbols.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(size).alias("avg_len")).withColumn("one", F.lit(1))
    sized = hits.join(symbols.select("qualified_name", size.alias("len")), "qualified_name")
    counted = sized.join(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits")), "query_id").withColumn("one", F.lit(1)).join(F.broadcast(totals), "one")
    idf = F.log(1 + (F.col("n_docs") - F.col("n_hits") + 0.5) / (F.col("n_hits") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "qualified_name"))
    scored = counted.select(*by, F.round(idf * weight, 6).alias("score"))
    return scored.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 if either has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))

    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def nearest_to(vectors: DataFrame, key: str, vector: str, query: list[float], k: int = 20) -> DataFrame:
    """The ``k`` rows nearest to one query vector by cosine: ``key, score``; ties by key."""
    literal = F.array(*[F.lit(float(v)) for v in query])
    scored = vectors.where(F.col(vector).isNotNull()).select(key, cosine(F.col(vector), literal).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def _blocks(vectors: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Rows packed into ``(block, keys, matrix)`` of about ``size`` rows each."""
    total = vectors.count()
    count = max(1, -(-total // size))
    numbered = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(
        F.pmod(F.xxhash64(key), F.lit(count)).cast("int").alias("block"), F.struct(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<float>").alias("v")).alias("row")
    )
    packed = numbered.groupBy("block").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return packed.select("block", F.col("rows.key").alias("keys"), F.flatten("rows.v").alias("matrix"))


def _best_of_blocks(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                queries = np.asarray(r["q_matrix"], np.float64).reshape(len(r["q_keys"]), -1)
                rows = np.asarray(r["matrix"], np.float64).reshape(len(r["keys"]), -1)
                keys = np.asarray(r["keys"])
                norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
                scores = np.divide(queries @ rows.T, norms, out=np.zeros((len(queries), len(rows))), where=norms > 0)
                out = []
                for i, q in enumerate(r["q_keys"]):
                    own = scores[i].copy()
                    own[keys == q] = -np.inf
                    top = np.lexsort((keys, -own))[:k]
                    out += [(q, int(keys[j]), float(own[j])) for j in top if own[j] > -np.inf]
                columns = list(zip(*out)) if out else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.int64()), pa.array(list(columns[1]), pa.int64()), pa.array(list(columns[2]), pa.float64())], ["query", "neighbour", "score"])

    return run


def nearest_in_blocks(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int = 10, block: int = 2048) -> DataFrame:
    """Exact ``k`` nearest rows of every query by cosine: ``query, neighbour, score, position``; never itself.

    Null keys or vectors take no part. All vectors must have one length. Ties by key.
    """
    q = _blocks(queries, key, vector, 512).select(F.col("block").alias("q_block"), F.col("keys").alias("q_keys"), F.col("matrix").alias("q_matrix"))
    count = max(1, -(-queries.count() // 512))
    rows = _blocks(vectors, key, vector, block).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    met = rows.join(q, "q_block").select("q_keys", "q_matrix", "keys", "matrix")
    found = met.mapInArrow(_best_of_blocks(k), "query bigint, neighbour bigint, score double")
    place = Window.partitionBy("query").orderBy(F.desc("score"), "neighbour")
    return found.withColumn("position", F.row_number().over(place)).where(F.col("position") <= k)


def fuse(lists: list[DataFrame], rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ``(qualified_name, score)`` lists: sum of 1 / (k + rank), rank from 1 within each list."""
    ranked = None
    for found in lists:
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "qualified_name"))
        part = found.select("qualified_name", (F.lit(1.0) / (F.lit(rrf_k) + place)).alias("share"))
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.groupBy("qualified_name").agg(F.sum("share").alias("score"))


def kind_boosts(query: str) -> list[str]:
    """Kinds that the query's shape suggests: types for PascalCase, functions for snake_case, none for qualified names."""
    if not query or "::" in query:
        return []
    if query[0].isupper() and "_" not in query:
        return ["struct", "trait", "interface"]
    if "_" in query and all(c.islower() or c == "_" for c in query):
        return ["function", "method"]
    return []


def hybrid_search(symbols: DataFrame, query: str, nearest: DataFrame | None = None, config: SearchConfig = SearchConfig(), mode: str = "hybrid") -> DataFrame:
    """``qualified_name, name, kind, file_path, score, score_source`` of the best hits.

    ``nearest`` is the vector side (qualified_name, score). Hybrid falls back to
    text where it is missing or empty. The list is cut to the limit first;
    boosts (x1.5 by kind, x2 for a contained qualified query) reorder it after.
    """
    if mode not in ("hybrid", "text", "semantic"):
        raise ValueError("mode must be hybrid, text or semantic")
    spark = symbols.sparkSession
    none = spark.createDataFrame([], "qualified_name string, score double")
    if not query:
        ranked = none
    elif mode == "text" or (mode == "hybrid" and (nearest is None or nearest.isEmpty())):
        ranked = phrase_search(symbols, query, config.limit)
    elif mode == "semantic":
        ranked = nearest if nearest is not None else none
    else:
        ranked = fuse([phrase_search(symbols, query, config.limit), nearest.orderBy(F.desc("score"), "qualified_name").limit(config.limit)], config.rrf_k)
    top = ranked.orderBy(F.desc("score"), "qualified_name").limit(config.limit)
    hits = top.join(symbols.select("qualified_name", "name", "kind", "file_path"), "qualified_name")
    boost = F.lit(1.0)
    if "::" in query:
        boost = F.when(F.contains("qualified_name", F.lit(query)), 2.0).otherwise(1.0)
    elif config.kind_boost and kind_boosts(query):
        boost = F.when(F.col("kind").isin(kind_boosts(query)), 1.5).otherwise(1.0)
    scored = hits.withColumns({"score": F.round(F.col("score") * boost, 9), "score_source": F.lit(mode)})
    return scored.orderBy(F.desc("score"), "qualified_name")


def symbol_texts(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``qualified_name, text, text_hash``: what is embedded of a symbol (kind, name, file stem, signature, three calls each way)."""
    calls = edges.where(F.col("kind") == "calls")
    short = calls.select("edge_id", "source", "target", short_name(F.col("source")).alias("source_name"), short_name(F.col("target")).alias("target_name"))
    out = first_names(short, "source", "target_name").select(F.col("k").alias("qualified_name"), F.concat(F.lit("calls "), "names").alias("out"))
    into = first_names(short, "target", "source_name").select(F.col("k").alias("qualified_name"), F.concat(F.lit("called by "), "names").alias("into"))
    rows = symbols.select("qualified_name", "kind", "name", "file_path", "signature").join(out, "qualified_name", "left").join(into, "qualified_name", "left")
    text = F.concat_ws(
        ", ",
        pascal(F.col("kind")),
        "name",
        F.concat(F.lit("in "), file_stem(F.coalesce("file_path", F.lit("")))),
        F.concat(F.lit("signature: "), "signature"),
        "out",
        "into",
    )
    return rows.select("qualified_name", text.alias("text"), F.sha2(text, 256).alias("text_hash"))


def texts_to_embed(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """Texts that are new or whose hash differs from the stored one (``stored``: qualified_name, text_hash)."""
    held = stored.select("qualified_name", F.col("text_hash").alias("held"))
    both = texts.join(held, "qualified_name", "left")
    return both.where(~F.col("text_hash").eqNullSafe(F.col("held"))).drop("held")


def orphan_embeddings(stored: DataFrame, symbols: DataFrame) -> DataFrame:
    return stored.select("qualified_name").join(symbols.select("qualified_name"), "qualified_name", "left_anti")


def hash_embedder(dimensions: int = 64):
    """A deterministic stand-in for a model: byte folding and length 1, as an Arrow-batched function of the text."""
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def fold(text: str | None) -> list[float]:
            raw = np.frombuffer((text or "").encode(), np.uint8).astype(np.float64)
            sums = np.zeros(dimensions)
            np.add.at(sums, np.arange(len(raw)) % dimensions, raw / 255.0)
            length = np.linalg.norm(sums)
            return (sums / length if length else sums).astype(np.float32).tolist()

        return texts.map(fold)

    return embed
