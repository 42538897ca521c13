"""Every query of the engine on the driver's tables, and the same in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.fingerprint import bits as bits_of
from ..functions.udfs import mol_props, morgan_fp
from ..operators import analysis, index, search
from ..runtime import materialize, new_path, prepare
from ..sources import compounds, fixtures, reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The query of the single searches on fixture E (vec_id 0), its threshold and top k; the same for D.
E_QUERY, E_T, E_K = 0, 0.05, 10
D_QUERY, D_T, D_K = 0, 0.2, 20

E_SQL = """e_bits AS (SELECT vec_id AS doc_id, ((i - 1) * 16 + least(15, greatest(0, floor((e::DOUBLE + 0.6::DOUBLE) / 0.075::DOUBLE)::INT)))::INT AS bit
  FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(1, 65)) AS i FROM embeddings) WHERE abs(e::DOUBLE) > 0.12::DOUBLE),
e_pop AS (SELECT doc_id, count(*)::INT AS pop FROM e_bits GROUP BY doc_id),
e_post AS (SELECT bit, doc_id, pop FROM e_bits JOIN e_pop USING (doc_id))"""
D_SQL = """d_bits AS (SELECT DISTINCT doc_id, (('0x' || substr(md5(token), 1, 8))::UBIGINT % 1024)::INT AS bit
  FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \\n]+')) AS token FROM documents) WHERE token <> ''),
d_pop AS (SELECT doc_id, count(*)::INT AS pop FROM d_bits GROUP BY doc_id),
d_post AS (SELECT bit, doc_id, pop FROM d_bits JOIN d_pop USING (doc_id))"""


def scores_sql(x: str, query: int) -> str:
    """Scores of all documents of a fixture that share a bit with one of them."""
    return f"""{x}_c AS (SELECT p.doc_id, count(*)::INT AS c, max(p.pop) AS k FROM {x}_post p JOIN (SELECT bit FROM {x}_bits WHERE doc_id = {query}) q USING (bit) GROUP BY p.doc_id),
{x}_s AS (SELECT doc_id, c, k, (SELECT pop FROM {x}_pop WHERE doc_id = {query}) AS p, (c::DOUBLE / ((SELECT pop FROM {x}_pop WHERE doc_id = {query}) + k - c))::FLOAT AS score FROM {x}_c)"""


def query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: f(prepare(spark), sf_dir)
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def e_post(spark, sf_dir):
    return index.postings_of_bits(fixtures.embedding_bits(spark, sf_dir))


def d_post(spark, sf_dir):
    return index.postings_of_bits(fixtures.document_bits(spark, sf_dir))


def e_fps(spark, sf_dir):
    """doc_id, label, fingerprint of fixture E."""
    sets = fixtures.embedding_bits(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("bit").alias("bits"))
    return sets.select("doc_id", bits.from_bits("bits").alias("fingerprint"))


def one_query(rows: DataFrame, doc_id: int, threshold: float, top_k: int) -> search.SimilarityQuery:
    """The query that one document is: its bits, 1024 at most, come to the driver."""
    return search.SimilarityQuery(tuple(sorted(r.bit for r in rows.filter(F.col("doc_id") == doc_id).select("bit").collect())), threshold, top_k)


def e_query(spark, sf_dir, threshold=E_T, top_k=E_K):
    return one_query(fixtures.embedding_bits(spark, sf_dir), E_QUERY, threshold, top_k)


@query("emb_fp_bits", f"WITH {E_SQL} SELECT doc_id, bit FROM e_bits")
def emb_fp_bits(spark, sf_dir):
    return e_fps(spark, sf_dir).select("doc_id", F.explode(bits.active_bits("fingerprint")).alias("bit"))


@query("emb_popcount", f"WITH {E_SQL} SELECT doc_id, pop FROM e_pop")
def emb_popcount(spark, sf_dir):
    return e_fps(spark, sf_dir).select("doc_id", bits.popcount("fingerprint").alias("pop"))


@query("emb_posting_hist", f"WITH {E_SQL} SELECT bit, count(*) AS n FROM e_bits GROUP BY bit")
def emb_posting_hist(spark, sf_dir):
    return index.postings(e_fps(spark, sf_dir)).groupBy("bit").agg(F.count("*").alias("n"))


BLOCKS_SQL = f"""WITH {E_SQL}, numbered AS (SELECT *, ((row_number() OVER (PARTITION BY bit ORDER BY doc_id) - 1) // {index.BLOCK})::INT AS block FROM e_post),
b AS (SELECT bit, block, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc, min(pop) AS min_pop, max(pop) AS max_pop FROM numbered GROUP BY ALL),
s AS (SELECT *, coalesce(lag(last_doc) OVER (PARTITION BY bit ORDER BY block), 0) AS base FROM b)"""


@query("emb_block_max", f"{BLOCKS_SQL} SELECT bit, block, n_docs, min_pop, max_pop FROM b")
def emb_block_max(spark, sf_dir):
    return index.blocks(e_post(spark, sf_dir)).select("bit", "block", "n_docs", "min_pop", "max_pop")


@query("emb_skip_entries", f"{BLOCKS_SQL} SELECT bit, block, base, first_doc, last_doc FROM s")
def emb_skip_entries(spark, sf_dir):
    return index.blocks(e_post(spark, sf_dir)).select("bit", "block", "base", "first_doc", "last_doc")


@query("emb_block_for", f"""{BLOCKS_SQL}, t AS (SELECT DISTINCT bit, unnest([0, 1, 50, 200, 400])::BIGINT AS target FROM e_bits)
SELECT t.bit, t.target, coalesce(max(CASE WHEN base < target THEN block END), 0)::INT AS block FROM t JOIN s USING (bit) GROUP BY ALL""")
def emb_block_for(spark, sf_dir):
    post = e_post(spark, sf_dir)
    targets = post.select("bit").distinct().select("bit", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 1, 50, 200, 400)])).alias("target"))
    return index.block_for(index.blocks(post), targets)


@query("emb_index_stats", f"WITH {E_SQL} SELECT count(DISTINCT doc_id) AS num_compounds, count(DISTINCT bit) AS non_empty_bits, count(*) AS total_postings FROM e_bits")
def emb_index_stats(spark, sf_dir):
    return index.index_stats(e_post(spark, sf_dir))


def top_sql(k: int, where: str, x: str = "e", cols: str = "doc_id, score, c, k") -> str:
    return f"SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, {cols} FROM (SELECT * FROM {x}_s WHERE {where} ORDER BY score DESC, doc_id LIMIT {k})"


E_HEAD = f"WITH {E_SQL}, {scores_sql('e', E_QUERY)}"


@query("emb_topk", f"{E_HEAD} {top_sql(E_K, f'score >= {E_T}::FLOAT')}")
def emb_topk(spark, sf_dir):
    return search.search(e_post(spark, sf_dir), e_query(spark, sf_dir))


@query("emb_threshold_search", f"{E_HEAD} SELECT doc_id, score, c, k FROM e_s WHERE score >= 0.08::FLOAT")
def emb_threshold_search(spark, sf_dir):
    return search.search_all(e_post(spark, sf_dir), e_query(spark, sf_dir, 0.08)).select("doc_id", "score", "c", "k")


@query("emb_band_search", f"{E_HEAD} SELECT doc_id, score FROM e_s WHERE score >= 0.15::FLOAT")
def emb_band_search(spark, sf_dir):
    return search.search_all(e_post(spark, sf_dir), e_query(spark, sf_dir, 0.15), band=True).select("doc_id", "score")


LINEAR = f"""{E_HEAD}, lin AS (SELECT doc_id, coalesce(score, 0::FLOAT) AS score FROM e_pop LEFT JOIN e_s USING (doc_id))
SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM (SELECT * FROM lin WHERE score >= {{t}}::FLOAT ORDER BY score DESC, doc_id LIMIT {{k}})"""


def e_linear(spark, sf_dir, t, k):
    fps, q = e_fps(spark, sf_dir), e_query(spark, sf_dir)
    return search.linear(fps, q.bits, t, k)


@query("emb_linear_topk", LINEAR.format(t=E_T, k=E_K))
def emb_linear_topk(spark, sf_dir):
    return e_linear(spark, sf_dir, E_T, E_K)


@query("emb_linear_zero_threshold", f"{E_HEAD} SELECT doc_id, coalesce(score, 0::FLOAT) AS score FROM e_pop LEFT JOIN e_s USING (doc_id)")
def emb_linear_zero_threshold(spark, sf_dir):
    return search.scan(e_fps(spark, sf_dir), e_query(spark, sf_dir).bits, 0.0)


def labelled(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("float").alias("label"))


@query("emb_filtered_topk", f"{E_HEAD} {top_sql(E_K, f'score >= {E_T}::FLOAT AND doc_id IN (SELECT vec_id FROM embeddings WHERE label BETWEEN 2 AND 5)')}")
def emb_filtered_topk(spark, sf_dir):
    return search.search(e_post(spark, sf_dir), e_query(spark, sf_dir).with_filter("label", 2, 5), labelled(spark, sf_dir))


@query("emb_overfetch_filter", f"""{E_HEAD}, best AS (SELECT * FROM e_s WHERE score >= {E_T}::FLOAT ORDER BY score DESC, doc_id LIMIT 100)
SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score, c, k FROM (SELECT * FROM best WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label BETWEEN 2 AND 5) ORDER BY score DESC, doc_id LIMIT 5)""")
def emb_overfetch_filter(spark, sf_dir):
    return search.search_overfetch(e_post(spark, sf_dir), e_query(spark, sf_dir, E_T, 5).with_filter("label", 2, 5), labelled(spark, sf_dir))


def batch_sql(x: str, ids: str, t: float, k: int) -> str:
    return f"""q AS (SELECT doc_id AS query_id, bit, pop AS p FROM {x}_post WHERE doc_id {ids}),
bc AS (SELECT query_id, doc_id, count(*)::INT AS c, max(d.pop) AS k, max(q.p) AS p FROM q JOIN {x}_post d USING (bit) GROUP BY ALL),
bs AS (SELECT *, (c::DOUBLE / (p + k - c))::FLOAT AS score FROM bc),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bs WHERE score >= {t}::FLOAT),
b AS (SELECT query_id, rank, doc_id, score, c, k, p FROM br WHERE rank <= {k})"""


def batch_queries(sets: DataFrame, condition: str, threshold: float) -> DataFrame:
    return sets.filter(condition).select(F.col("doc_id").alias("query_id"), "fingerprint", F.lit(threshold).alias("threshold"))


def batch_topk(rows: DataFrame, threshold: float, top_k: int) -> DataFrame:
    """Every document of a fixture whose id 50 divides against all of them."""
    sets = materialize(index.sets_of_bits(rows), "fixture")
    return search.batch_sets(sets, batch_queries(sets, "doc_id % 50 = 0", threshold), top_k)[0]


@query("emb_batch_topk", f"WITH {E_SQL}, {batch_sql('e', '% 50 = 0', E_T, 5)} SELECT query_id, rank, doc_id, score, c, k FROM b")
def emb_batch_topk(spark, sf_dir):
    return batch_topk(fixtures.embedding_bits(spark, sf_dir), E_T, 5).select("query_id", "rank", "doc_id", "score", "c", "k")


@query("emb_batch_report", f"""WITH {E_SQL}, {batch_sql('e', '% 50 = 0', 0.1, 3)},
asked AS (SELECT DISTINCT query_id AS n, 0 AS kind FROM q UNION ALL SELECT * FROM (VALUES (-1, 1), (-2, 2))),
ev AS (SELECT query_id, count(*) AS n FROM bc WHERE c >= greatest(1, ceil(0.1::FLOAT::DOUBLE * p - 0.0001::DOUBLE)) AND k >= 0.1::FLOAT::DOUBLE * p - 0.001::DOUBLE AND k * 0.1::FLOAT::DOUBLE <= p + 0.001::DOUBLE GROUP BY query_id),
size AS (SELECT count(*) AS n FROM e_pop)
SELECT concat('Q', asked.n) AS query_id, concat('vector ', asked.n) AS query_smiles, coalesce(rank::VARCHAR, '') AS rank, coalesce(b.doc_id::VARCHAR, '') AS doc_id, coalesce(printf('%.4f', score::DOUBLE), '') AS score,
  CASE WHEN kind > 0 THEN '' ELSE coalesce(ev.n, 0)::VARCHAR END AS docs_evaluated, CASE WHEN kind > 0 THEN '' ELSE printf('%.6f', coalesce(ev.n, 0)::DOUBLE / greatest((SELECT n FROM size), 1) * 100) END AS eval_fraction_pct,
  CASE kind WHEN 1 THEN 'the query has no bits' WHEN 2 THEN 'the threshold must be from 0 to 1' ELSE '' END AS error
FROM asked LEFT JOIN b ON b.query_id = asked.n LEFT JOIN ev ON ev.query_id = asked.n""")
def emb_batch_report(spark, sf_dir):
    """All columns of the report of a batch: every vector whose id 50 divides, a query without bits, and one whose threshold is out of range."""
    sets = materialize(index.sets_of_bits(fixtures.embedding_bits(spark, sf_dir)), "fixture")
    odd = spark.createDataFrame([(-1, [], 0.1), (-2, [1], 1.5)], "query_id long, bits array<int>, threshold double").withColumn("fingerprint", bits.from_bits("bits"))
    asked = batch_queries(sets, "doc_id % 50 = 0", 0.1).unionByName(odd.drop("bits"))
    asked = asked.select(F.concat(F.lit("Q"), F.col("query_id").cast("string")).alias("query_id"), F.concat(F.lit("vector "), F.col("query_id").cast("string")).alias("query_smiles"), "fingerprint", bits.active_bits("fingerprint").alias("bits"), "threshold")
    results, stats = search.batch_sets(sets, asked, 3, evaluated=True)
    return reports.batch_report(asked, results, stats.withColumn("corpus_size", F.lit(sets.count())))


@query("emb_analysis", f"""{E_HEAD}, top AS ({top_sql(E_K, f'score >= {E_T}::FLOAT', cols='doc_id, score, c, k, p')})
SELECT rank, doc_id, c AS shared_bits, p - c AS query_unique_bits, k - c AS candidate_unique_bits,
  CASE WHEN score >= 0.7::FLOAT THEN 'high' WHEN score >= 0.4::FLOAT THEN 'moderate' WHEN score >= 0.2::FLOAT THEN 'low but notable' ELSE 'minimal' END AS tier,
  concat('This molecule shares ', round((score * 100::FLOAT)::FLOAT)::INT, '% of its structural fingerprint with the query (', c, ' of ', p + k - c, ' total bits), indicating a ',
    CASE WHEN score >= 0.7::FLOAT THEN 'high' WHEN score >= 0.4::FLOAT THEN 'moderate' WHEN score >= 0.2::FLOAT THEN 'low but notable' ELSE 'minimal' END,
    ' degree of structural similarity. ', p - c, CASE WHEN p - c = 1 THEN ' bit' ELSE ' bits' END, ' appear only in the query and ', k - c, CASE WHEN k - c = 1 THEN ' bit' ELSE ' bits' END, ' appear only in this molecule.') AS explanation
FROM top""")
def emb_analysis(spark, sf_dir):
    q = e_query(spark, sf_dir)
    return analysis.analyze(search.search(e_post(spark, sf_dir), q), q.pop).select("rank", "doc_id", "shared_bits", "query_unique_bits", "candidate_unique_bits", "tier", "explanation")


@query("emb_upper_bound", f"""WITH {E_SQL}, q AS (SELECT pop AS p FROM e_pop WHERE doc_id = {E_QUERY}) SELECT doc_id, (least(p, pop)::DOUBLE / greatest(p, pop))::FLOAT AS bound FROM e_pop, q""")
def emb_upper_bound(spark, sf_dir):
    p = e_query(spark, sf_dir).pop
    return e_fps(spark, sf_dir).select("doc_id", bits.upper_bound(F.lit(p), bits.popcount("fingerprint")).alias("bound"))


@query("emb_pair_threshold", f"""{E_HEAD} SELECT doc_id, coalesce(score, 0::FLOAT) AS score, coalesce(score >= 0.06::FLOAT, false) AS passes FROM e_pop LEFT JOIN e_s USING (doc_id)""")
def emb_pair_threshold(spark, sf_dir):
    q = bits.literal(e_query(spark, sf_dir).bits)
    return e_fps(spark, sf_dir).select("doc_id", bits.tanimoto_with_threshold("fingerprint", q, 0.06).alias("t")).select("doc_id", "t.score", "t.passes")


@query("emb_search_stats", f"""{E_HEAD} SELECT count_if(c >= greatest(1, ceil(0.1::FLOAT::DOUBLE * p - 0.0001::DOUBLE)) AND k >= 0.1::FLOAT::DOUBLE * p - 0.001::DOUBLE AND k * 0.1::FLOAT::DOUBLE <= p + 0.001::DOUBLE) AS docs_evaluated,
  (SELECT count(*) FROM e_pop) AS corpus_size FROM e_s""")
def emb_search_stats(spark, sf_dir):
    post = e_post(spark, sf_dir)
    return search.search_stats(post, e_query(spark, sf_dir, 0.1), post.select("doc_id").distinct().count()).select("docs_evaluated", "corpus_size")


@query("emb_verify", f"WITH {E_SQL} SELECT count(*) AS n_docs, 0::BIGINT AS n_mismatches, true AS ok FROM e_pop")
def emb_verify(spark, sf_dir):
    fps = e_fps(spark, sf_dir)
    return index.verify(index.postings(fps), fps)


@query("doc_fp_popcount", f"WITH {D_SQL} SELECT doc_id, pop FROM d_pop")
def doc_fp_popcount(spark, sf_dir):
    return d_post(spark, sf_dir).groupBy("doc_id").agg(F.max("pop").alias("pop"))


@query("doc_topk", f"WITH {D_SQL}, {scores_sql('d', D_QUERY)} {top_sql(D_K, f'score >= {D_T}::FLOAT', 'd')}")
def doc_topk(spark, sf_dir):
    rows = fixtures.document_bits(spark, sf_dir)
    return search.search(index.postings_of_bits(rows), one_query(rows, D_QUERY, D_T, D_K))


@query("doc_selfjoin_0_8", f"""WITH {D_SQL}, sets AS (SELECT doc_id, list_sort(list(bit)) AS s FROM d_bits GROUP BY doc_id),
r AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS rep FROM sets),
rp AS (SELECT bit, doc_id, pop FROM d_post WHERE doc_id IN (SELECT rep FROM r)),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c, max(x.pop) AS pa, max(y.pop) AS pb FROM rp x JOIN rp y ON x.bit = y.bit AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a, b, (c::DOUBLE / (pa + pb - c))::FLOAT AS score FROM pairs WHERE (c::DOUBLE / (pa + pb - c))::FLOAT >= 0.8::FLOAT
UNION ALL SELECT rep, doc_id, 1::FLOAT FROM r WHERE doc_id <> rep""")
def doc_selfjoin_0_8(spark, sf_dir):
    return search.similarity_join(fixtures.document_bit_rows(spark, sf_dir), 0.8)


@query("doc_batch_topk", f"WITH {D_SQL}, {batch_sql('d', '% 50 = 0', 0.3, 10)} SELECT query_id, rank, doc_id, score FROM b")
def doc_batch_topk(spark, sf_dir):
    return batch_topk(fixtures.document_bit_rows(spark, sf_dir), 0.3, 10).select("query_id", "rank", "doc_id", "score")


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


M_SQL = f"""m0 AS (SELECT p_partkey AS doc_id, concat('Z', p_partkey) AS compound_id, (p_partkey % {len(fixtures.CORES)})::INT AS core,
  {_list(fixtures.SUBSTITUENTS)}[(p_size % {len(fixtures.SUBSTITUENTS)} + 1)::INT] AS a, {_list(fixtures.SUBSTITUENTS)}[(length(p_name) % {len(fixtures.SUBSTITUENTS)} + 1)::INT] AS b FROM part),
m AS (SELECT *, replace(replace({_list(fixtures.CORES)}[core + 1], '{{a}}', a), '{{b}}', b) AS smiles FROM m0)"""
TOKENS_SQL = f"""WITH {M_SQL}, t AS (SELECT doc_id, unnest(regexp_extract_all(smiles, 'Br|Cl|[BCNOFPSIcnosp]')) AS s FROM m),
mass AS (SELECT * FROM (VALUES ('B', 10.811, 3), ('C', 12.011, 4), ('N', 14.007, 3), ('O', 15.999, 2), ('F', 18.998, 0), ('P', 30.974, 3), ('S', 32.065, 2), ('Cl', 35.453, 0), ('Br', 79.904, 0), ('I', 126.904, 0), ('c', 12.011, 4), ('n', 14.007, 3), ('o', 15.999, 2), ('s', 32.065, 2), ('p', 30.974, 3)) v(s, mass, h)),
logp AS (SELECT * FROM (VALUES ('C', 0.1441), ('N', -0.2090), ('O', -0.2062), ('S', 0.1155), ('F', 0.4202), ('Cl', 0.6895), ('Br', 0.8456), ('I', 0.8857), ('P', 0.8612), ('c', 0.1581), ('n', -0.4806), ('o', -0.2202), ('s', 0.0743), ('p', 0.8612)) v(s, logp))"""


@query("mol_library", f"WITH {M_SQL} SELECT doc_id, compound_id, smiles FROM m")
def mol_library(spark, sf_dir):
    return fixtures.molecules(spark, sf_dir).select("doc_id", "compound_id", "smiles")


def molecules_with_properties(spark, sf_dir):
    return fixtures.molecules(spark, sf_dir).withColumn("x", mol_props(F.col("smiles"))).select("doc_id", "compound_id", "smiles", "core", "a", "b", "x.*")


@query("mol_mw_logp", f"{TOKENS_SQL} SELECT doc_id, round(sum((mass + h * 1.0079)::DOUBLE) + 0.00005, 1) AS mw, round(sum(coalesce(logp, 0)::DOUBLE) + 0.00002, 3) AS logp FROM t JOIN mass USING (s) LEFT JOIN logp USING (s) GROUP BY doc_id")
def mol_mw_logp(spark, sf_dir):
    """Properties, rounded a little off the decimal steps, where 32-bit sums may fall to either side."""
    return molecules_with_properties(spark, sf_dir).select("doc_id", F.round(F.col("mw").cast("double") + 0.00005, 1).alias("mw"), F.round(F.col("logp").cast("double") + 0.00002, 3).alias("logp"))


@query("mol_heavy_atoms", f"{TOKENS_SQL} SELECT doc_id, count(*)::INT AS heavy_atoms FROM t GROUP BY doc_id")
def mol_heavy_atoms(spark, sf_dir):
    return molecules_with_properties(spark, sf_dir).select("doc_id", "heavy_atoms")


@query("mol_ring_count", f"WITH {M_SQL} SELECT doc_id, (length(regexp_replace(smiles, '[^0-9]', '', 'g')) // 2)::INT AS ring_count FROM m")
def mol_ring_count(spark, sf_dir):
    return molecules_with_properties(spark, sf_dir).select("doc_id", "ring_count")


@query("mol_lipinski", f"{TOKENS_SQL}, n AS (SELECT doc_id, sum((mass + h * 1.0079)::DOUBLE) AS mw, sum(coalesce(logp, 0)::DOUBLE) AS logp FROM t JOIN mass USING (s) LEFT JOIN logp USING (s) GROUP BY doc_id) SELECT doc_id, round(mw + 0.00005, 1) AS mw, round(logp + 0.00002, 3) AS logp FROM n WHERE mw <= 500 AND logp <= 5")
def mol_lipinski(spark, sf_dir):
    """No molecule of the library has more than ten rotatable bonds, so weight and logP decide."""
    rule = search.SimilarityQuery((0,)).with_lipinski_filter().column()
    return molecules_with_properties(spark, sf_dir).filter(rule).select("doc_id", F.round(F.col("mw").cast("double") + 0.00005, 1).alias("mw"), F.round(F.col("logp").cast("double") + 0.00002, 3).alias("logp"))


@query("mol_property_range", f"{TOKENS_SQL}, n AS (SELECT doc_id, count(*)::INT AS heavy_atoms FROM t GROUP BY doc_id) SELECT doc_id, heavy_atoms FROM n WHERE heavy_atoms BETWEEN 7 AND 9")
def mol_property_range(spark, sf_dir):
    return molecules_with_properties(spark, sf_dir).filter(search.PropertyFilter("heavy_atoms", 7, 9).column()).select("doc_id", "heavy_atoms")


def molecule_fps(spark, sf_dir):
    return fixtures.molecules(spark, sf_dir).withColumn("fingerprint", morgan_fp(F.col("smiles")))


M_QUERY, M_T, M_K = "CC(=O)Oc1ccccc1C(=O)O", 0.1, 20


def library_bits_sql() -> str:
    """(smiles, bits) of every molecule that fixture M can hold, and of the query, for SQL that has no fingerprints of its own: it checks the search, the kernels' tests check the bits."""
    made = {core.replace("{a}", a).replace("{b}", b) for core in fixtures.CORES for a in fixtures.SUBSTITUENTS for b in fixtures.SUBSTITUENTS}
    return ", ".join(f"('{x}', {sorted(bits_of(x))})" for x in sorted(made | {M_QUERY}))


@query("mol_fp_topk", f"""WITH {M_SQL}, known AS (SELECT * FROM (VALUES {library_bits_sql()}) v(smiles, bits)),
m_bits AS (SELECT doc_id, unnest(bits)::INT AS bit FROM m JOIN known USING (smiles)),
m_pop AS (SELECT doc_id, count(*)::INT AS pop FROM m_bits GROUP BY doc_id),
q AS (SELECT unnest(bits)::INT AS bit FROM known WHERE smiles = '{M_QUERY}'),
m_c AS (SELECT doc_id, count(*)::INT AS c FROM m_bits JOIN q USING (bit) GROUP BY doc_id),
m_s AS (SELECT doc_id, c, pop AS k, (c::DOUBLE / ((SELECT count(*) FROM q) + pop - c))::FLOAT AS score FROM m_c JOIN m_pop USING (doc_id))
{top_sql(M_K, f'score >= {M_T}::FLOAT', 'm')}""")
def mol_fp_topk(spark, sf_dir):
    return search.search(index.postings(molecule_fps(spark, sf_dir)), search.SimilarityQuery(tuple(bits_of(M_QUERY)), M_T, M_K))


@query("mol_identical", f"WITH {M_SQL}, one AS (SELECT smiles FROM m WHERE doc_id = (SELECT min(doc_id) FROM m)) SELECT doc_id FROM m JOIN one USING (smiles)")
def mol_identical(spark, sf_dir):
    """Molecules with the text of the first one, by their score of 1."""
    rows = molecule_fps(spark, sf_dir)
    first = rows.orderBy("doc_id").select("smiles").first().smiles
    hits = search.search_all(index.postings(rows), search.SimilarityQuery(tuple(bits_of(first)), 1.0))
    return hits.join(rows.filter(F.col("smiles") == first), "doc_id", "left_semi").select("doc_id")


def framed(spark, sf_dir):
    """Fixture M with frameworks, ranked by doc_id."""
    return analysis.with_scaffolds(fixtures.molecules(spark, sf_dir).withColumn("rank", F.col("doc_id")))


@query("mol_scaffold_groups", f"WITH {M_SQL} SELECT core AS first_core, core AS last_core, count(*) AS count FROM m GROUP BY core")
def mol_scaffold_groups(spark, sf_dir):
    """Groups by framework key: each is one core of the library."""
    rows = framed(spark, sf_dir)
    cores = rows.groupBy("scaffold_key").agg(F.min("core").alias("first_core"), F.max("core").alias("last_core"))
    return analysis.scaffold_groups(rows).join(cores, "scaffold_key").select("first_core", "last_core", "count")


@query("mol_diverse", f"WITH {M_SQL} SELECT doc_id FROM m WHERE core = {fixtures.ACYCLIC} UNION ALL SELECT min(doc_id) FROM m WHERE core <> {fixtures.ACYCLIC} GROUP BY core")
def mol_diverse(spark, sf_dir):
    return analysis.diverse(framed(spark, sf_dir)).select("doc_id")


@query("mol_rgroups", f"WITH {M_SQL} SELECT doc_id, concat('*', unnest([a, b])) AS r_group FROM m WHERE core <> {fixtures.ACYCLIC}")
def mol_rgroups(spark, sf_dir):
    return analysis.with_r_groups(fixtures.molecules(spark, sf_dir)).select("doc_id", F.explode("r_groups").alias("g")).select("doc_id", F.col("g.smiles").alias("r_group"))


@query("mol_sar_cells", f"WITH {M_SQL} SELECT doc_id, array_to_string(list_sort([concat('*', a), concat('*', b)]), ',') AS cells FROM m WHERE core <> {fixtures.ACYCLIC}")
def mol_sar_cells(spark, sf_dir):
    """All cells of each row of the tables of substituents, in one text."""
    rows = analysis.with_r_groups(fixtures.molecules(spark, sf_dir).withColumn("rank", F.col("doc_id")))
    cells = analysis.sar_cells(rows)
    return cells.groupBy(F.col("rank").alias("doc_id")).agg(F.array_join(F.sort_array(F.flatten(F.collect_list(F.coalesce("cell", F.array().cast("array<string>"))))), ",").alias("cells"))


GOLDEN = (("ethanol", "CCO", 9, 50.1000, 0.0820, 0, 3, 0), ("benzene", "c1ccccc1", 3, 96.2556, 0.9486, 1, 6, 1), ("aspirin", "CC(=O)Oc1ccccc1C(=O)O", 27, 216.4426, 0.5561, 4, 13, 1), ("caffeine", "Cn1cnc2c1c(=O)n(C)c(=O)n2C", 27, 232.4932, -1.1120, 2, 14, 2), ("ibuprofen", "CC(C)Cc1ccc(cc1)C(C)C(=O)O", 28, 244.5834, 1.5449, 5, 15, 1))  # fixed values


@query("mol_golden", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {p}::INT, {m}::DOUBLE, {lp}::DOUBLE, {r}::INT, {h}::INT, {c}::INT)" for n, _, p, m, lp, r, h, c in GOLDEN) + ") v(name, pop, mw, logp, rot_bonds, heavy_atoms, ring_count)")
def mol_golden(spark, sf_dir):
    rows = spark.createDataFrame([(n, s) for n, s, *_ in GOLDEN], "name string, smiles string")
    rows = rows.withColumns({"x": mol_props(F.col("smiles")), "fp": morgan_fp(F.col("smiles"))})
    return rows.select("name", bits.popcount("fp").alias("pop"), *(F.round(F.col(f"x.{c}").cast("double"), 4).alias(c) for c in ("mw", "logp")), "x.rot_bonds", "x.heavy_atoms", "x.ring_count")


LINES = ("CCO\tZ1", "c1ccccc1\tZ2\tmore\tand more", "\tZ3", "\tZ4\tx", "C\tZ5", "CC", "  CCN \t Z6 ", "CC\t", "[NH4+]\tZ7")


@query("ingest_parse_report", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {s}, {n}, {ok})" for i, s, n, ok in ((0, "'CCO'", "'Z1'", "true"), (1, "'c1ccccc1'", "'Z2'", "true"), (2, "NULL", "NULL", "false"), (3, "'Z4'", "'x'", "true"), (4, "'C'", "'Z5'", "false"), (5, "NULL", "NULL", "false"), (6, "'CCN'", "'Z6'", "true"), (7, "NULL", "NULL", "false"), (8, "'[NH4+]'", "'Z7'", "true"))) + ") v(line, smiles, compound_id, ok)")
def ingest_parse_report(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(LINES)), "line int, raw string")
    return compounds.parse(rows).select("line", "smiles", "compound_id", "ok")


@query("dense_doc_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS doc_id FROM orders")
def dense_doc_ids(spark, sf_dir):
    """Dense numbers in a given order, as ingest gives them to lines."""
    return compounds.with_doc_ids(fixtures.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "doc_id")


@query("emb_score_summary", f"{E_HEAD} SELECT count(*) AS n, round(avg(score::DOUBLE), 6) AS avg_score, max(score) AS max_score FROM e_s WHERE score >= {E_T}::FLOAT")
def emb_score_summary(spark, sf_dir):
    hits = search.search_all(e_post(spark, sf_dir), e_query(spark, sf_dir))
    return hits.agg(F.count("*").alias("n"), F.round(F.avg(F.col("score").cast("double")), 6).alias("avg_score"), F.max("score").alias("max_score"))


@query("emb_resolved_topk", f"""{E_HEAD}, top AS ({top_sql(E_K, f'score >= {E_T}::FLOAT')}) SELECT rank, doc_id, score, label FROM top JOIN embeddings ON vec_id = doc_id""")
def emb_resolved_topk(spark, sf_dir):
    table = fixtures.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return compounds.take(table, search.search(e_post(spark, sf_dir), e_query(spark, sf_dir)), E_K).select("rank", "doc_id", "score", "label")


def e_index(spark, sf_dir):
    """The postings of fixture E, written and read back."""
    path = new_path(spark, "index")
    index.write_index(e_fps(spark, sf_dir), path)
    return index.read_index(spark, path)


@query("index_roundtrip_topk", f"{E_HEAD} {top_sql(E_K, f'score >= {E_T}::FLOAT')}")
def index_roundtrip_topk(spark, sf_dir):
    """A search over a written index: bits pruned by folder, popcounts by statistics."""
    return search.search(e_index(spark, sf_dir), e_query(spark, sf_dir))


@query("index_verify_damaged", f"WITH {E_SQL} SELECT count(*) AS n_docs, count_if(doc_id % 7 = 0) AS n_mismatches, count_if(doc_id % 7 = 0) = 0 AS ok FROM e_pop")
def index_verify_damaged(spark, sf_dir):
    """Verification of an index in which each list of every seventh document lacks what the first bit had."""
    post = e_index(spark, sf_dir)
    first = post.filter("doc_id % 7 = 0").groupBy("doc_id").agg(F.min("bit").alias("bit"))
    return index.verify(post.join(first, ["doc_id", "bit"], "left_anti").select("bit", "doc_id", "pop"), e_fps(spark, sf_dir))


@query("emb_cumulative_bound", f"""{BLOCKS_SQL}, q AS (SELECT pop AS p FROM e_pop WHERE doc_id = {E_QUERY}),
m AS (SELECT bit, block, max(max_pop) OVER (PARTITION BY bit ORDER BY block ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS k FROM b)
SELECT bit, block, (least(p, k)::DOUBLE / greatest(p, k))::FLOAT AS bound FROM m, q""")
def emb_cumulative_bound(spark, sf_dir):
    return index.cumulative_bounds(index.blocks(e_post(spark, sf_dir)), F.lit(e_query(spark, sf_dir).pop))


@query("ingest_table", f"WITH {M_SQL} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, compound_id, smiles FROM m WHERE length(smiles) >= 2")
def ingest_table(spark, sf_dir):
    """Fixture M as a compressed text library, ingested, and its table read back."""
    lines, table = new_path(spark, "library"), new_path(spark, "compounds")
    rows = fixtures.molecules(spark, sf_dir).orderBy("doc_id").select(F.concat_ws("\t", "smiles", "compound_id").alias("value"))
    rows.write.option("compression", "bzip2").text(lines)
    compounds.ingest(spark, lines, table, compounds.ReaderConfig(has_header=False))
    return compounds.read_table(spark, table).select("doc_id", "compound_id", "smiles")
