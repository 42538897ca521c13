import random

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fpspark.functions import bits as B
from fpspark.functions import explain, udfs
from fpspark.functions.fingerprint import bits as bits_of
from fpspark.functions.fingerprint import words
from fpspark.operators import analysis, index, search
from fpspark.operators.search import PropertyFilter, SimilarityQuery
from fpspark.plans.engine import SimilarityEngine
from fpspark.sources import compounds, reports
from fpspark.sources.fixtures import CORES, SUBSTITUENTS

def molecules(n, seed=3):
    """Molecules put together from frameworks and substituents, no two alike."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        text = CORES[len(out) % len(CORES)].format(a=rng.choice(SUBSTITUENTS), b=rng.choice(SUBSTITUENTS))
        if text not in out:
            out.append(text)
    return out


CORPUS = molecules(24)
#: The ends, and some thresholds between.
THRESHOLDS = (0, 1, *(round(random.Random(8).random(), 3) for _ in range(1)), 0.07, 0.31, 0.66)


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.createDataFrame([(i, f"Z{i}", s) for i, s in enumerate(CORPUS)], "doc_id long, compound_id string, smiles string")
    return compounds.featurize(rows).cache()


@pytest.fixture(scope="module")
def post(table):
    return index.postings(table).cache()


def brute(query, t, keep=lambda i: True):
    q = set(query)
    out = []
    for i, s in enumerate(CORPUS):
        b = set(bits_of(s))
        if q & b and keep(i):
            score = len(q & b) / len(q | b)
            if score >= t - 1e-9:
                out.append((i, round(score, 5)))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def rows(frame):
    return [(r.doc_id, round(r.score, 5)) for r in frame.orderBy(F.desc("score"), "doc_id").collect()]


def test_batch_search_equals_brute_force(spark, post):
    asked = [(f"{i}-{t}", bits_of(s), float(t)) for i, s in enumerate(CORPUS) for t in THRESHOLDS]
    frame = spark.createDataFrame(asked, "query_id string, bits array<int>, threshold double")
    got = {}
    for r in search.batch(post, frame, 100).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 5)))
    for name, b, t in asked:
        assert got.get(name, []) == brute(b, t), name


@pytest.mark.parametrize("k", [1, 3, 10])
def test_top_k_and_plans_agree(table, post, k):
    q = SimilarityQuery(tuple(bits_of(CORPUS[12])), 0.05, k)
    expected = brute(q.bits, 0.05)[:k]
    assert rows(search.search(post, q)) == expected
    assert rows(search.search(post, q, band=False)) == expected
    assert [r.rank for r in search.search(post, q).orderBy("rank").collect()] == list(range(1, len(expected) + 1))
    mine = q.bits
    assert rows(search.linear(table, mine, 0.05, k)) == expected


def test_linear_scan_keeps_zero_scores_at_threshold_zero(table):
    mine = bits_of("CCO")
    assert search.linear(table, mine, 0.0, 100).count() == len(CORPUS)


def test_filters(table, post):
    q = SimilarityQuery(tuple(bits_of("CCO")), 0.0, 100).with_mw_logp_max(100, 1.5)
    props = {r.doc_id: r for r in table.collect()}
    got = rows(search.search(post, q, table))
    assert got == brute(q.bits, 0, lambda i: props[i].mw <= 100 and props[i].logp <= 1.5)
    assert set(rows(search.search_overfetch(post, SimilarityQuery(q.bits, 0.0, 2, q.filters), table))) <= set(got)
    with pytest.raises(ValueError):
        search.search(post, q)


@pytest.mark.parametrize("bad", [SimilarityQuery((1,), 1.5), SimilarityQuery((1,), -0.1), SimilarityQuery((1,), float("nan")), SimilarityQuery((1,), 0.5, 0), SimilarityQuery((), 0.5)])
def test_validation(bad):
    with pytest.raises(ValueError):
        bad.validated()


def test_ranges_hold_both_ends(spark):
    frame = spark.createDataFrame([(4.0,), (5.0,), (10.0,), (11.0,)], "mw float")
    assert [r.mw for r in frame.filter(PropertyFilter("mw", 5, 10).column()).collect()] == [5, 10]
    assert frame.filter(PropertyFilter("mw").column()).count() == 4


def test_ties_at_the_threshold_are_kept(spark):
    """100 and 15 shared of 100 bits is 0.15 exactly: a count bound in 32-bit floats would lose it."""
    frame = spark.createDataFrame([(1, list(range(15)))], "doc_id long, bits array<int>").select("doc_id", F.explode("bits").alias("bit"))
    post = index.postings_of_bits(frame)
    assert search.search(post, SimilarityQuery(tuple(range(100)), 0.15, 5)).count() == 1


def test_random_fingerprints_are_pruned(spark):
    rng = random.Random(5)
    sets = [(i, sorted({rng.randrange(1024) for _ in range(40)})) for i in range(1000)]
    frame = spark.createDataFrame(sets, "doc_id long, bits array<int>")
    post = index.postings_of_bits(frame.select("doc_id", F.explode("bits").alias("bit")))
    q = SimilarityQuery(tuple(sets[7][1]), 0.5, 5)
    stats = search.search_stats(post, q, 1000).first()
    assert stats.eval_fraction < 0.05
    assert search.search(post, q).first().doc_id == 7


@pytest.mark.parametrize("block", [4096, 5])
@pytest.mark.parametrize("t", [0.9, 0.55, 1])
def test_similarity_join(spark, monkeypatch, t, block):
    """Pairs of different sets, and a row for each copy; sets of one bit, of all, and of very unlike sizes."""
    monkeypatch.setattr(search, "JOIN_BLOCK", block)
    rng = random.Random(9)
    base = [set(rng.sample(range(1024), rng.choice([1, 2, 5, 30, 200]))) for _ in range(20)] + [set(range(1024)), set(range(1000))]
    sets = [(4 * i + k, sorted(b if k in (0, 3) else (b - set(rng.sample(sorted(b), min(k, len(b) - 1)))))) for i, b in enumerate(base) for k in range(4)]
    frame = spark.createDataFrame(sets, "doc_id long, bits array<int>").select("doc_id", F.explode("bits").alias("bit"))
    got = sorted((r.a, r.b, round(r.score, 5)) for r in search.similarity_join(index.postings_of_bits(frame), t).collect())
    least = {}
    for i, x in sets:
        least.setdefault(tuple(x), i)
    scores = ((a, b, round(len(set(x) & set(y)) / len(set(x) | set(y)), 5)) for x, a in least.items() for y, b in least.items() if a < b)
    want = [r for r in scores if r[2] >= t] + [(least[tuple(x)], i, 1.0) for i, x in sets if least[tuple(x)] != i]
    assert got == sorted(want)


def test_reports_print_numbers_as_sql_does(spark):
    """Ties of the exact value go to even, and what only looks like a tie in its shortest text does not round up."""
    numbers = [5 / 32, 1 / 32, 3 / 32, 0.00015, 0.12345, 0.5, None, 7 / 128]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    got = frame.select("i", reports.fixed(F.col("x"), 4).alias("t"), reports.fixed(F.col("x"), 6).alias("u")).orderBy("i").collect()
    con = duckdb.connect()
    assert [(r.t, r.u) for r in got] == [(None, None) if x is None else con.execute("SELECT printf('%.4f', ?::DOUBLE), printf('%.6f', ?::DOUBLE)", [x, x]).fetchall()[0] for x in numbers]
    assert got[0].t == "0.1562" and got[7].u == "0.054688"


@pytest.mark.parametrize("block", [32768, 5])
def test_batch_of_sets(spark, monkeypatch, block):
    """Copies, queries that are copies, ties, dense sets, thresholds 0 and 1, counts of candidates; and top_k rows a query and pair of blocks leave the tasks."""
    monkeypatch.setattr(search, "JOIN_BLOCK", block)
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    rng = random.Random(11)
    base = [frozenset(rng.sample(range(1024), rng.choice([1, 3, 20, 20, 300, 1000]))) for _ in range(20)]
    sets = dict(enumerate(base * 3))
    frame = spark.createDataFrame([(i, sorted(b)) for i, b in sets.items()], "doc_id long, bits array<int>").select("doc_id", F.explode("bits").alias("bit"))
    fps = index.sets_of_bits(frame.union(frame)).cache()
    asked = [(f"{i}-{t}", sorted(sets[i]), t) for i in (0, 1, 2, 5, 22, 25) for t in (0.0, 0.05, 0.3, 1.0)] + [("none", [], 0.1), ("bad", [1], 1.5)]
    results, stats = search.batch_sets(fps, spark.createDataFrame(asked, "query_id string, bits array<int>, threshold double"), 7, evaluated=True)
    got = {}
    for r in results.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, round(r.score, 5), r.c, r.k, r.p))
    counts = {r.query_id: r.docs_evaluated for r in stats.collect()}
    assert set(counts) == {a[0] for a in asked[:-2]} and not {"none", "bad"} & set(got)
    for name, x, t in asked[:-2]:
        x = set(x)
        near = sorted((-len(x & b) / len(x | b), i) for i, b in sets.items() if x & b)
        want = [(n + 1, i, round(-s, 5), len(x & sets[i]), len(sets[i]), len(x)) for n, (s, i) in enumerate([(s, i) for s, i in near if -s >= t][:7])]
        assert got.get(name, []) == want, name
        assert counts[name] == sum(len(x & b) >= max(1, t * len(x) - 1e-3) and t * len(x) <= len(b) + 1e-3 and len(b) * t <= len(x) + 1e-3 for b in sets.values()), name


def test_tasks_of_a_batch_keep_few_rows():
    """However many documents reach the threshold, a task keeps and returns top_k rows a query."""
    n, one = 5000, [(1 << 62) - 1] * 16
    made = {"tile": [0] * (n + 2), "side": [0, 0] + [1] * n, "id": [0, 1, *range(n)], "n": [0, 0] + [1] * n, "pop": [62 * 16] * (n + 2), "threshold": [0.05, 0.5] + [0.0] * n}
    kinds = {"tile": pa.int32(), "side": pa.int32(), "pop": pa.int32(), "threshold": pa.float64()}
    table = pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in made.items()} | {"fingerprint": pa.array([one] * (n + 2), pa.list_(pa.int64()))})
    out = pa.Table.from_batches(search._search_tiles(3, False)(iter(table.to_batches(max_chunksize=700))))
    assert sorted(zip(out["qid"].to_pylist(), out["id"].to_pylist(), out["c"].to_pylist())) == [(q, i, 992) for q in (0, 1) for i in range(3)]


def test_batch_joins_no_bits(spark):
    """Rows of bits meet no queries, however many there are: their number would grow with the product."""
    frame = spark.createDataFrame([(i, b) for i in range(40) for b in range(30)], "doc_id long, bit int")
    fps = index.sets_of_bits(frame)
    (found,) = [search.batch_sets(fps, fps.select(F.col("doc_id").alias("query_id"), "fingerprint", F.lit(0.1).alias("threshold")), 3)[0]]
    assert "explode" not in found._jdf.queryExecution().toString() and found.count() == 120


def test_similarity_join_leaves_few_rows_to_move(spark):
    """A row for each pair of blocks that a set is in, not one for each bit of its prefix."""
    rng = random.Random(2)
    frame = spark.createDataFrame([(i, b) for i in range(200) for b in rng.sample(range(1024), 300)], "doc_id long, bit int")
    frame = search.similarity_join(frame.union(frame), 0.8)
    assert "bit#" not in frame._jdf.queryExecution().optimizedPlan().toString() and frame.count() == 0


def test_bits(spark):
    rng = random.Random(12)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = [(rng.getrandbits(64) & rng.getrandbits(64), rng.getrandbits(64)) for _ in range(5)] + [(0, 0), (0, 7), ((1 << 64) - 1, 1 << 63)]
    cases = [([signed(x)], [signed(y)], (x & y).bit_count(), (x & ~y).bit_count(), (y & ~x).bit_count()) for x, y in words]
    frame = spark.createDataFrame([(i, a + [0] * 15, b + [0] * 15) for i, (a, b, *_) in enumerate(cases)], "i int, a array<long>, b array<long>")
    for r, (_, _, shared, left, right) in zip(frame.select("i", B.shared_bits("a", "b").alias("s"), B.popcount("a").alias("p"), B.popcount("b").alias("k"), B.tanimoto("a", "b").alias("t"), B.tanimoto_with_threshold("a", "b", 0.0).alias("w")).orderBy("i").collect(), cases, strict=True):
        assert (r.s, r.p - r.s, r.k - r.s) == (shared, left, right)
        total = shared + left + right
        assert r.t == pytest.approx(shared / total if total else 0)
        assert r.w.passes == (total > 0)
    one = spark.createDataFrame([([0b1011] + [0] * 14 + [-(1 << 63)],)], "f array<long>")
    assert one.select(B.active_bits("f").alias("b")).first().b == [0, 1, 3, 1023]
    assert one.select(B.from_bits(B.active_bits("f")).alias("f")).first().f == one.first().f
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(20)] + [(0, 9), (9, 0), (31, 31)]
    bound = spark.createDataFrame(pairs, "p int, k int").select("p", "k", B.upper_bound("p", "k").alias("u")).collect()
    assert all(r.u == pytest.approx(min(r.p, r.k) / max(r.p, r.k, 1)) for r in bound)


def test_explanations(spark):
    frame = spark.createDataFrame([(14 / 48, 14, 24, 38), (1.0, 3, 4, 4)], "score float, c int, p int, k int")
    first, second = [r.e for r in frame.select(explain.explanation("score", "c", F.col("p") - F.col("c"), F.col("k") - F.col("c")).alias("e")).collect()]
    assert first == "This molecule shares 29% of its structural fingerprint with the query (14 of 48 total bits), indicating a low but notable degree of structural similarity. 10 bits appear only in the query and 24 bits appear only in this molecule."
    assert "1 bit appear only in the query and 1 bit appear only" in second


def test_index_round_trip(spark, table, tmp_path):
    path = f"file://{tmp_path}/index"
    index.write_index(table, path)
    read = index.read_index(spark, path)
    assert index.verify(read, table).first().ok
    assert not index.verify(read.filter("doc_id <> 3"), table).first().ok
    assert index.mismatches(read.filter("bit > 500"), table).count() <= 10
    q = SimilarityQuery(tuple(bits_of("CCO")), 0.2, 5)
    plan = search.search(read, q)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bit#" in plan
    with pytest.raises(ValueError):
        index.read_index(spark, f"file://{tmp_path}/none")
    with pytest.raises(ValueError):
        compounds.read_table(spark, path)


def test_blocks(spark):
    rng = random.Random(4)
    lists = {bit: sorted(rng.sample(range(5000), n)) for bit, n in ((7, 300), (8, 1), (9, 128), (10, 129), (11, 2000))}
    frame = spark.createDataFrame([(b, d, 1 + d % 50) for b, ds in lists.items() for d in ds], "bit int, doc_id long, pop int")
    want, bases = [], {}
    for bit, ds in lists.items():
        parts = [ds[k : k + index.BLOCK] for k in range(0, len(ds), index.BLOCK)]
        bases[bit] = [0, *(x[-1] for x in parts[:-1])]
        want += [(bit, k, bases[bit][k], x[0], x[-1], len(x), min(1 + d % 50 for d in x), max(1 + d % 50 for d in x)) for k, x in enumerate(parts)]
    got = index.blocks(frame)
    assert sorted((r.bit, r.block, r.base, r.first_doc, r.last_doc, r.n_docs, r.min_pop, r.max_pop) for r in got.collect()) == want
    asked = sorted({(bit, t) for bit in lists for t in [0, 1, 9999, *rng.sample(range(5000), 8), *bases[bit], *(x + 1 for x in bases[bit])]})
    targets = spark.createDataFrame([*asked, (500, 3)], "bit int, target long")  # a bit without a list has no block
    found = {(r.bit, r.target): r.block for r in index.block_for(got, targets).collect()}
    assert found == {(bit, t): max([k for k, x in enumerate(bases[bit]) if x < t], default=0) for bit, t in asked}


def test_engine(spark, table, post):
    engine = SimilarityEngine(spark, post, table)
    out = engine.respond(CORPUS[10], 0.1, 8)
    assert out.results[0]["score"] == 1.0 and out.results[0]["compound_id"] == "Z10"
    assert out.docs_evaluated == search.search_stats(post, engine.query(CORPUS[10], 0.1, 8), len(CORPUS)).first().docs_evaluated
    assert sum(g["count"] for g in out.scaffold_groups) == len(out.results)
    assert all(len(t["rows"]) == t["members"] >= 2 for t in out.rgroup_tables)
    few = engine.respond(CORPUS[10], 0.1, 8, diverse=True, stats=False)
    keys = [r["scaffold_key"] for r in few.results if r["scaffold_key"]]
    assert len(keys) == len(set(keys)) and len(few.results) < len(out.results)
    assert SimilarityEngine(spark, None, table).respond(CORPUS[2], 0.3, 5).results[0]["score"] == 1.0
    assert "postings" in engine.explain(engine.query("CCO", 0.0)) and "band" in engine.explain(engine.query("CCO", 0.2))
    with pytest.raises(ValueError):
        engine.query("[")
    with pytest.raises(ValueError):
        SimilarityEngine(spark, post).respond("CCO", diverse=True)
    with pytest.warns(UserWarning):
        engine.query("CCO", 0.9)


def test_diverse_and_groups(spark):
    frame = spark.createDataFrame([(i + 1, k, str(k)) for i, k in enumerate([10, 20, 10, 0, 0, 20])], "rank int, scaffold_key long, scaffold_smiles string")
    assert [r["rank"] for r in analysis.diverse(frame).orderBy("rank").collect()] == [1, 2, 4, 5]
    assert [(r.scaffold_smiles, r["count"]) for r in analysis.scaffold_groups(frame).collect()] == [("0", 2), ("10", 2), ("20", 2)]


def test_sar_tables(spark):
    def tables(*smiles):
        frame = spark.createDataFrame([(i, s) for i, s in enumerate(smiles)], "rank int, smiles string")
        return analysis.sar_tables(analysis.with_r_groups(frame)).collect()

    (one,) = tables("Cc1ccccn1", "Cc1cccnc1")
    assert all(sum(bool(c.cell) for c in r.cells) == 1 and len(r.cells) == 2 for r in one.rows)
    (two,) = tables("Cc1ccccc1", "c1ccccc1C(=O)O")
    assert [[(c.label, c.cell) for c in r.cells] for r in two.rows] == [[("R1", ["*C"])], [("R1", ["*C(O)=O"])]]
    assert tables("Cc1ccccc1", "CCO", "CCC") == []


def test_tables_decompose_each_row_once(spark):
    """The plan of the tables of substituents reads rows that are written: it holds no kernel, and each text is worked on once in a worker."""
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(CORPUS)], "rank int, smiles string")
    assert "ArrowEvalPython" not in analysis.sar_cells(analysis.with_r_groups(frame))._jdf.queryExecution().toString()
    asked = []
    udfs._distinct(pd.Series(["x", "y", None, "x"]), kernel := lambda t: asked.append(t) or len(t), 0)
    assert udfs._distinct(pd.Series(["y", "z", None]), kernel, 0) == [1, 1, 0] and asked == ["x", "y", "z"]


def test_postings_of_fingerprints(spark):
    """Bits of all words, first and last; empty and null fingerprints have none. No column expression looks at each of 1024 bits."""
    sets = [[0, 63, 64, 1023], [], list(range(1024)), [63]]
    frame = spark.createDataFrame([*((i, words(b)) for i, b in enumerate(sets)), (9, None)], "doc_id int, fingerprint array<long>")
    post = index.postings(frame)
    assert post.columns == ["bit", "doc_id", "pop"] and "sequence(0, 1023" not in post._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r.bit, r["pop"]) for r in post.collect()) == [(i, b, len(x)) for i, x in enumerate(sets) for b in x]


def test_batch_report(spark, table, post, tmp_path):
    (tmp_path / "q.txt").write_text(f"# comment\n\n{CORPUS[4]} first\n{CORPUS[5]}\n[ bad\n")
    asked = reports.read_queries(spark, f"file://{tmp_path}/q.txt")
    assert [(r.query_id, r.smiles) for r in asked.orderBy("line").collect()] == [("first", CORPUS[4]), ("Q4", CORPUS[5]), ("bad", "[")]
    engine = SimilarityEngine(spark, post, table)
    plain = engine.search_batch(asked, 0.3, 3)
    by = {}
    for r in plain.collect():
        by.setdefault(r.query_id, []).append(r)
    assert by["bad"][0].error and by["bad"][0]["rank"] == "" and len(by["bad"]) == 1
    assert sorted(r["rank"] for r in by["first"]) == [str(i + 1) for i in range(len(by["first"]))] != [""]
    full = engine.search_batch(asked, 0.3, 3, resolve=True)
    assert tuple(full.columns) == reports.RESOLVED
    assert full.filter("query_id = 'first' and rank = '1'").first().compound_smiles == CORPUS[4]
    assert by["bad"][0].docs_evaluated == "" and all(int(r.docs_evaluated) >= len(by["first"]) and float(r.eval_fraction_pct) == pytest.approx(100 * int(r.docs_evaluated) / len(CORPUS), abs=1e-6) for r in by["first"])
    reports.write_tsv(full, f"file://{tmp_path}/out")
    assert spark.read.option("sep", "\t").option("header", True).csv(f"file://{tmp_path}/out").count() == full.count()
