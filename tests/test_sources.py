import bz2
import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from fpspark import api, cli
from fpspark.functions import udfs
from fpspark.functions.fingerprint import bits as bits_of
from fpspark.operators import index
from fpspark.plans.engine import SimilarityEngine
from fpspark.sources import compounds
from fpspark.sources.fixtures import CORES, SUBSTITUENTS
from fpspark.streaming import ingest as streaming

SMILES = [core.format(a=a, b="O") for core, a in zip(CORES[:5], SUBSTITUENTS, strict=False)]
FIVE = "SMILES\tname\n" + "".join(f"{x}\tL-{k}\n" for k, x in enumerate(SMILES))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    (path / "in.bz2").write_bytes(bz2.compress(FIVE.encode()))
    stats = compounds.ingest(spark, f"file://{path}/in.bz2", f"file://{path}/compounds")
    index.write_index(compounds.read_table(spark, f"file://{path}/compounds"), f"file://{path}/index")
    return path, stats


def test_round_trip(spark, tables):
    path, stats = tables
    assert (stats.total_lines, stats.parsed_ok, stats.parse_failures) == (5, 5, 0)
    rows = compounds.read_table(spark, f"file://{path}/compounds").orderBy("doc_id").collect()
    assert [(r.doc_id, r.compound_id) for r in rows] == [(i, f"L-{i}") for i in range(5)]
    assert [r.fp_pop for r in rows] == [len(bits_of(x)) for x in SMILES]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        compounds.ingest(spark, f"file://{path}/in.bz2", f"file://{path}/compounds")


def test_bad_lines_are_counted_and_order_is_of_path_and_line(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("h\nCCO\tB1\n\n \t \n\tB2\nc1ccccc1\tB3\n")
    (tmp_path / "a.tsv").write_text("h\nCC\tA1\nC\tA2\nCCC\tA3\trest\tof line\n")
    stats = compounds.ingest(spark, f"file://{tmp_path}/*.tsv", f"file://{tmp_path}/out")
    assert (stats.total_lines, stats.parsed_ok, stats.parse_failures) == (6, 4, 2)
    assert [r.compound_id for r in spark.read.parquet(f"file://{tmp_path}/out").orderBy("doc_id").collect()] == ["A1", "A3", "B1", "B3"]
    compounds.ingest(spark, f"file://{tmp_path}/b.tsv", f"file://{tmp_path}/out", append=True)
    assert [r.doc_id for r in compounds.read_table(spark, f"file://{tmp_path}/out").orderBy("doc_id").collect()] == list(range(6))


def test_tables_that_are_not_whole_are_refused(spark, tables, tmp_path):
    path, _ = tables
    spark.read.parquet(f"file://{path}/compounds").filter("doc_id < 3").write.parquet(f"file://{tmp_path}/cut")
    meta = {"kind": "compounds", "version": 1, "rows": 5}
    compounds.write_meta(spark, f"file://{tmp_path}/cut", meta)
    with pytest.raises(ValueError, match="cut short"):
        compounds.read_table(spark, f"file://{tmp_path}/cut")
    for change in ({"version": 99}, {"kind": "postings"}):
        compounds.write_meta(spark, f"file://{tmp_path}/cut", meta | change)
        with pytest.raises(ValueError):
            compounds.read_table(spark, f"file://{tmp_path}/cut")


def test_other_columns(spark):
    frame = spark.createDataFrame([("Z1\tCCO |&1:4|",)], "raw string")
    s, i = compounds.fields("raw", compounds.ReaderConfig(smiles_col=1, id_col=0, strip_cx=True))
    assert frame.select(s.alias("s"), i.alias("i")).first() == ("CCO", "Z1")


def test_sql_functions(spark):
    udfs.register(spark)
    row = spark.sql("SELECT tanimoto(morgan_fp('CCO'), morgan_fp('CC(=O)Oc1ccccc1C(=O)O')) AS t, mol_props('CCO').heavy_atoms AS n, murcko_scaffold('Cc1ccccc1').scaffold_smiles AS s, r_groups('Cc1ccccc1').r_groups[0].smiles AS r").first()
    assert row.t == pytest.approx(0.058824, abs=1e-5) and (row.n, row.s, row.r) == (3, "c1ccccc1", "*C")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.bz2").write_bytes(bz2.compress(FIVE.encode()))
    go = lambda: streaming.start_ingest(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination(120)
    go()
    (tmp_path / "in" / "two.tsv").write_text("smiles\tid\nCCCC\tX\nC\tY\n")
    go()
    rows = spark.read.parquet(f"file://{tmp_path}/out")
    assert rows.count() == 6 and rows.filter("compound_id = 'X'").count() == 1
    streaming.finish(spark, f"file://{tmp_path}/out", f"file://{tmp_path}/table")
    table = compounds.read_table(spark, f"file://{tmp_path}/table")
    assert sorted(r.doc_id for r in table.collect()) == list(range(6))
    assert SimilarityEngine(spark, index.postings(table), table).respond("CCCC", 0.9, 2).results[0]["compound_id"] == "X"


def test_command_line(spark, tables, tmp_path, capsys):
    path, _ = tables
    run = lambda *a: cli.main(list(a))
    at = ["--index", f"file://{path}/index", "--compounds", f"file://{path}/compounds"]
    run("search", *at, "--query", SMILES[0], "--threshold", "0.05", "--top-k", "3", "--stats", "--diverse")
    assert "1.0000" in capsys.readouterr().out
    run("verify", *at)
    assert "0 mismatches" in capsys.readouterr().out
    run("bench-linear", "--compounds", f"file://{path}/compounds", "--query", "CCO", "--threshold", "0.1")
    (tmp_path / "q").write_text("CCO a\n")
    run("search-batch", *at, "--queries", f"file://{tmp_path}/q", "--output", f"file://{tmp_path}/tsv", "--threshold", "0.1", "--mw-max", "300")
    with pytest.raises(SystemExit):
        run("search", "--index", "x", "--query", "CCO", "--threshold", "high")
    with pytest.raises(SystemExit):
        run("search", "--index", "x", "--query", "CCO", "--diverse")


def test_http(spark, tables):
    path, _ = tables
    engine = SimilarityEngine.open(spark, f"file://{path}/index", f"file://{path}/compounds")
    server = api.server(engine, "127.0.0.1", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def post(body):
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{base}/search", json.dumps(body).encode(), method="POST")) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        with urllib.request.urlopen(f"{base}/health") as r:
            assert json.loads(r.read())["compounds"] == 5
        status, out = post({"smiles": SMILES[0], "threshold": 0.05, "top_k": 3})
        assert status == 200 and out["results"][0]["score"] == 1.0 and out["query_pop"] == len(bits_of(SMILES[0]))
        assert set(out["results"][0]) == {*api.ALWAYS, *api.RESOLVED}
        for bad in ({"smiles": "CCO", "threshold": 2}, {"smiles": "CCO", "top_k": 0}, {"smiles": "["}, {}):
            assert post(bad)[0] == 400
        bare = SimilarityEngine(spark, index.read_index(spark, f"file://{path}/index"))
        assert api.handle(bare, {"smiles": "CCO", "diverse": True})[0] == 400
        assert api.handle(bare, {"smiles": "CCO", "mw_max": 100})[0] == 400
        assert set(api.handle(bare, {"smiles": SMILES[0], "threshold": 0.1})[1]["results"][0]) == set(api.ALWAYS)
    finally:
        server.shutdown()
