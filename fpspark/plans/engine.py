"""The engine: plans a search over the tables at hand, and takes a ranking through analysis, frameworks and tables."""

from __future__ import annotations

import time
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.fingerprint import bits as bits_of
from ..functions.udfs import morgan_fp
from ..operators import analysis, index, search
from ..operators.search import PropertyFilter, SimilarityQuery
from ..runtime import materialize, prepare
from ..schema import PROPERTY_FIELDS
from ..sources import compounds as tables
from ..sources import reports

#: Bits that a typical compound has; a much higher threshold than a query can reach against it is pointless.
TYPICAL_POP, SLACK = 45, 0.02


@dataclass
class SearchResult:
    """A ranking with what was found out about it; rows are at most top_k."""

    query_smiles: str
    query_pop: int
    results: list[dict]
    docs_evaluated: int
    corpus_size: int
    search_time_ms: float
    scaffold_groups: list[dict] = field(default_factory=list)
    rgroup_tables: list[dict] = field(default_factory=list)

    @property
    def eval_fraction_pct(self) -> float:
        return 100.0 * self.docs_evaluated / max(1, self.corpus_size)


def plan_for(query: SimilarityQuery, has_postings: bool) -> str:
    """The plan that a query gets: "linear" without postings, "band" where the threshold cuts popcounts, else "postings"."""
    if not has_postings:
        return "linear"
    return "band" if query.threshold > 0 else "postings"


class SimilarityEngine:
    """Searches over postings, and over a compound table for what follows; either may be missing."""

    def __init__(self, spark: SparkSession, postings: DataFrame | None = None, compounds: DataFrame | None = None):
        if postings is None and compounds is None:
            raise ValueError("the engine needs postings or compounds")
        self.spark, self.postings, self.compounds = prepare(spark), postings, compounds
        self._size: int | None = None

    @classmethod
    def open(cls, spark: SparkSession, index_path: str | None = None, compounds_path: str | None = None) -> SimilarityEngine:
        return cls(spark, index.read_index(spark, index_path) if index_path else None, tables.read_table(spark, compounds_path) if compounds_path else None)

    @property
    def num_compounds(self) -> int:
        if self._size is None:
            source = self.compounds if self.compounds is not None else self.postings.select("doc_id").distinct()
            self._size = source.count()
        return self._size

    @property
    def has_properties(self) -> bool:
        return self.compounds is not None and all(c in self.compounds.columns for c in PROPERTY_FIELDS)

    def query(self, smiles: str, threshold: float = 0.7, top_k: int = 50, filters: tuple[PropertyFilter, ...] = ()) -> SimilarityQuery:
        out = SimilarityQuery(tuple(bits_of(smiles)), threshold, top_k, tuple(filters)).validated()
        reach = min(1.0, out.pop / TYPICAL_POP)
        if threshold > reach + SLACK:
            warnings.warn(f"a query of {out.pop} bits reaches about {reach:.2f} against a typical compound: few or no results at {threshold}", stacklevel=2)
        if filters and not self.has_properties:
            raise ValueError("filters need a table with properties")
        return out

    def search(self, query: SimilarityQuery, overfetch: int | None = None, observed: Observation | None = None) -> DataFrame:
        """rank, doc_id, score, c, k."""
        if overfetch:
            return search.search_overfetch(self.postings, query, self.compounds, overfetch)
        if plan_for(query, self.postings is not None) == "linear":
            rows = self.compounds.filter(query.column())
            mine = bits.literal(query.bits)
            pops = rows.select("doc_id", bits.shared_bits("fingerprint", mine).alias("c"), F.col("fp_pop").alias("k")).filter("c > 0")
            return search.ranked(pops.withColumn("score", bits.ratio(F.col("c"), F.lit(query.pop) + F.col("k") - F.col("c"))).filter(bits.reaches("score", query.threshold)), query.top_k).select("rank", "doc_id", "score", "c", "k")
        return search.search(self.postings, query, self.compounds, observed=observed)

    def explain(self, query: SimilarityQuery) -> str:
        """The plan's name, and Spark's plan."""
        frame = self.search(query)
        return plan_for(query, self.postings is not None) + "\n" + frame._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def respond(self, smiles: str, threshold: float = 0.7, top_k: int = 50, filters: tuple[PropertyFilter, ...] = (), diverse: bool = False, groups_before_diverse: bool = True, stats: bool = True) -> SearchResult:
        """A search with all that follows it."""
        if diverse and self.compounds is None:
            raise ValueError("diverse picking needs a table of compounds")
        query = self.query(smiles, threshold, top_k, filters)
        began = time.perf_counter()
        # Without filters the search counts what it evaluates as it runs; with them only what passes is counted there.
        observed = Observation() if stats and self.postings is not None and not filters else None
        hits = [r.asDict() for r in self.search(query, observed=observed).collect()]  # top_k rows at most
        took = (time.perf_counter() - began) * 1000
        if observed is not None:
            evaluated = observed.get["docs_evaluated"]
        else:
            evaluated = search.search_stats(self.postings, query, self.num_compounds).first().docs_evaluated if stats and self.postings is not None else len(hits)
        out = SearchResult(smiles, query.pop, [], evaluated, self.num_compounds, took)
        if not hits:
            return out
        ranked = analysis.analyze(self.spark.createDataFrame(hits, "rank int, doc_id long, score float, c int, k int"), query.pop)
        if self.compounds is not None:
            columns = [c for c in self.compounds.columns if c not in ("fingerprint", "fp_pop")]
            ranked = analysis.with_r_groups(analysis.with_scaffolds(tables.take(self.compounds.select(*columns), ranked, len(hits))))
        ranked = self.spark.createDataFrame([r.asDict(True) for r in ranked.orderBy("rank").collect()], ranked.schema)
        chosen = analysis.diverse(ranked) if diverse else ranked
        out.results = [r.asDict(True) for r in chosen.orderBy("rank").collect()]
        if self.compounds is not None:
            out.scaffold_groups = [r.asDict() for r in analysis.scaffold_groups(ranked if groups_before_diverse else chosen).collect()]
            places = {r["rank"]: i for i, r in enumerate(out.results)}
            for t in analysis.sar_tables(chosen).collect():
                table = t.asDict(True)
                table["rows"] = [{"member_index": places[r["rank"]], "cells": r["cells"]} for r in table["rows"]]
                out.rgroup_tables.append(table)
        return out

    def search_batch(self, queries: DataFrame, threshold: float = 0.7, top_k: int = 50, filters: tuple[PropertyFilter, ...] = (), resolve: bool = False) -> DataFrame:
        """The report of many queries (query_id, smiles)."""
        if filters and not self.has_properties:
            raise ValueError("filters need a table with properties")
        asked = queries.select("query_id", F.col("smiles").alias("query_smiles"), morgan_fp(F.col("smiles")).alias("fp")).withColumns({"bits": bits.active_bits("fp"), "threshold": F.lit(float(threshold))}).drop("fp")
        condition = SimilarityQuery((), 0, 1, tuple(filters)).column() if filters else None
        # Written, queries are made once.
        asked = materialize(asked, "asked")
        results, stats = search.batch_sets(search.asked_sets(self.postings, asked, self.compounds, condition), asked, top_k, evaluated=True)
        plain = reports.batch_report(asked, results, stats.withColumn("corpus_size", F.lit(self.num_compounds).cast("long")))
        return reports.resolved_report(plain, self.compounds) if resolve else plain
