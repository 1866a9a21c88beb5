"""One object that answers what a caller can ask of an indexed source tree.

Each answer is a DataFrame; nothing runs before an action.  The tables are those
of ``operators.symbols.analysed`` and a chunk table; keep them written (see
``sources.sinks.save_snapshot``) and pass the re-read tables for large trees.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import rules, scoring, text
from sparkloom.operators import chunking, graph, lookup, retrieval, stats
from sparkloom.operators import symbols as S


@dataclass
class Engine:
    """vectors (chunk_id, embedding) are those of ``chunks``, made by the caller's model; without them search is lexical alone."""

    files: DataFrame
    records: DataFrame
    vectors: DataFrame | None = None

    @classmethod
    def over(cls, files: DataFrame, vectors: DataFrame | None = None) -> Engine:
        """From (file, language, content)."""
        return cls(files, S.analysed(files), vectors)

    @classmethod
    def of_tree(cls, spark: SparkSession, root: str) -> Engine:
        from sparkloom.sources.tables import project_files

        found = project_files(spark, root)
        return cls.over(found.select("file", "language", F.decode("content", "UTF-8").alias("content")))

    @property
    def symbols(self) -> DataFrame:
        return S.symbols(self.records)

    @property
    def calls(self) -> DataFrame:
        return graph.resolved(S.calls(self.records), self.symbols)

    @property
    def edges(self) -> DataFrame:
        return self.calls.where("callee_id IS NOT NULL").select("src", F.col("callee_id").alias("dst")).distinct()

    @property
    def chunks(self) -> DataFrame:
        c = chunking.windows(self.files, "file", "content")
        return c.select("file", "language", "start_line", "end_line", F.col("chunk").alias("content"), chunking.chunk_id(F.lit(""), F.col("file"), F.col("start_line"), F.col("end_line"), F.lit(0)).alias("chunk_id"))

    def _chunks_of(self, language: str | None) -> DataFrame:
        return self.chunks.where(F.col("language") == language) if language else self.chunks

    def _lexical(self, query: str, k: int, language: str | None) -> DataFrame | None:
        """The k best (chunk_id, score) by BM25; None where the query has no term."""
        c = self._chunks_of(language)
        terms = [r[0] for r in c.sparkSession.range(1).select(F.explode(text.tokens(F.lit(query)))).collect()]
        return retrieval.top(retrieval.bm25(c, "chunk_id", "content", terms), k, key="chunk_id") if terms else None

    def _shown(self, best: DataFrame, *scores: str) -> DataFrame:
        c = self.chunks.select("chunk_id", "file", "start_line", "end_line", text.preview(F.col("content")).alias("preview"))
        return best.join(c, "chunk_id").select("chunk_id", "file", "start_line", "end_line", *scores, "preview").orderBy(F.desc(scores[0]), "chunk_id")

    def search(self, query: str, k: int = 10, language: str | None = None) -> DataFrame:
        """The best chunks by BM25, with a preview."""
        best = self._lexical(query, k, language)
        if best is None:
            best = self.chunks.where("false").select("chunk_id", F.lit(0.0).alias("score"))
        return self._shown(best, "score")

    def semantic(self, vector: list[float], k: int = 10, language: str | None = None) -> DataFrame:
        """The k best (chunk_id, score) by cosine with the vector of a query; chunks without a vector aren't found."""
        if self.vectors is None:
            raise ValueError("an engine without vectors has no semantic search")
        v = self.vectors.where("embedding IS NOT NULL")
        if language:
            v = v.join(self._chunks_of(language).select("chunk_id"), "chunk_id", "left_semi")
        query = F.array(*[F.lit(float(x)) for x in vector])
        return retrieval.top(v.select("chunk_id", F.round(scoring.cosine(F.col("embedding"), query), 6).alias("score")), k, key="chunk_id")

    def query(self, query: str, vector: list[float] | None = None, k: int = 10, language: str | None = None) -> DataFrame:
        """Hybrid search: twice the wanted results by vector and by BM25, fused, then ranked by fused score, calls and kind.

        final_score weighs the fused score (as a share of the highest possible),
        calls out of the chunk's file in hundreds (one at most), and the
        importance of the chunk's foremost symbol.  Without a vector it is
        lexical alone, without a term in the query dense alone, without either
        empty.
        """
        dense = self.semantic(vector, 2 * k, language) if vector is not None and self.vectors is not None else None
        sparse = self._lexical(query, 2 * k, language)
        none = self.chunks.where("false").select("chunk_id", F.lit(0.0).alias("score"))
        found = retrieval.fused(none if dense is None else dense, none if sparse is None else sparse, 2 * k, key="chunk_id")
        # At most 2 k rows.
        near = F.broadcast(found.join(self.chunks.select("chunk_id", "file", "start_line", "end_line"), "chunk_id"))
        s = self.symbols.select(F.col("file").alias("f"), F.col("start_line").alias("at"), text.importance(F.col("kind")).alias("importance"))
        meta = s.join(near, (F.col("f") == F.col("file")) & F.col("at").between(F.col("start_line"), F.col("end_line"))).groupBy("chunk_id").agg(F.max("importance").alias("meta"))
        calls = self.calls.where("callee_id IS NOT NULL").groupBy("file").agg(F.least(F.count("*") / F.lit(100.0), F.lit(1.0)).alias("graph"))
        c = near.join(meta, "chunk_id", "left").join(calls, "file", "left").na.fill(0.0, ["graph", "meta"])
        c = c.withColumn("similarity", F.col("rrf") / (2 * scoring.rrf(F.lit(1))))
        return self._shown(retrieval.ranked(c, "similarity", "graph", "meta", "chunk_id").limit(k).select("chunk_id", "final_score", "source"), "final_score", "source")

    def get_file(self, file: str) -> DataFrame:
        return lookup.of_file(self.files, file)

    def get_summary(self, file: str) -> DataFrame:
        """A file's number of words and first lines, since no model is asked."""
        return stats.fallback(self.get_file(file)).select("file", "summary")

    def search_flow(self, words: str) -> DataFrame:
        """Flows whose name holds words, regardless of case."""
        return lookup.contains_any(self.flows(), words, "name")

    def find_definition(self, name: str, scope: str | None = None) -> DataFrame:
        return lookup.find_definition(self.symbols, name, scope)

    def find_usages(self, name: str) -> DataFrame:
        return lookup.find_usages(S.references(self.records), name)

    def callers(self, symbol_id: str) -> DataFrame:
        return graph.callers(self.edges, symbol_id)

    def callees(self, symbol_id: str) -> DataFrame:
        return graph.callees(self.edges, symbol_id)

    def related(self, symbol_id: str, k: int = 10) -> DataFrame:
        return graph.related(self.edges, symbol_id, k)

    def flow_between(self, start: str, end: str) -> DataFrame:
        return graph.path(self.edges, start, end)

    def cycles(self) -> DataFrame:
        return graph.cycle_nodes(self.edges)

    def unused(self) -> DataFrame:
        return lookup.unused(self.symbols, S.references(self.records))

    def flows(self) -> DataFrame:
        s = self.symbols.withColumn("annotations", F.transform("annotations", lambda a: a["name"]))
        return graph.flows(s, self.calls, rules.ENTRIES, stats.layer(F.col("annotations"), F.col("file"), F.col("name")))

    def frameworks(self) -> DataFrame:
        return stats.frameworks(self.files)

    def structure(self) -> DataFrame:
        return stats.modules(self.symbols)

    def codegen(self) -> DataFrame:
        return S.generated(self.symbols)

    def symbol_map(self) -> DataFrame:
        return lookup.symbol_map(self.symbols)

    def context_at(self, file: str, line: int) -> DataFrame:
        return lookup.at_line(self.chunks, file, line)

    def rename_preview(self, old: str, new: str) -> DataFrame:
        lines = self.files.select("file", F.posexplode(text.lines(F.col("content"))).alias("n", "content")).withColumn("line", F.col("n") + 1)
        return lookup.rename_preview(lines, old, new).select("file", "line", "before", "after")
