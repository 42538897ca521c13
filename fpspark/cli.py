"""Command line: python -m fpspark.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import bits
from .functions.fingerprint import bits as bits_of
from .operators import index, search
from .operators.search import PropertyFilter
from .plans.engine import SimilarityEngine
from .sources import compounds as tables
from .sources import reports


def ranges(args) -> tuple[PropertyFilter, ...]:
    return tuple(PropertyFilter(name, None, top) for name, top in (("mw", args.mw_max), ("logp", args.logp_max)) if top is not None)


def ingest(spark, args):
    s = tables.ingest(spark, args.input, args.output)
    print(f"{s.total_lines} lines, {s.parsed_ok} compounds, {s.parse_failures} failures")


def build_index(spark, args):
    index.write_index(tables.read_table(spark, args.compounds).select("doc_id", "fingerprint", "fp_pop"), args.output)
    index.index_stats(index.read_index(spark, args.output)).show()


def run_search(spark, args):
    engine = SimilarityEngine.open(spark, args.index, args.compounds)
    out = engine.respond(args.query, args.threshold, args.top_k, ranges(args), args.diverse, groups_before_diverse=False, stats=args.stats)
    for r in out.results:
        print(f"{r['rank']:>4}  {r['doc_id']:>12}  {r['score']:.4f}  {r.get('compound_id', '')}  {r.get('smiles', '')}\n      {r['explanation']}")
        if r.get("scaffold_smiles"):
            print(f"      framework {r['scaffold_smiles']}; groups {', '.join(g['smiles'] for g in r['r_groups']) or 'none'}")
    for g in out.scaffold_groups:
        print(f"{g['count']:>4}  {g['scaffold_smiles'] or '(no ring)'}")
    for t in out.rgroup_tables:
        print(f"table of {t['scaffold_smiles']}: {t['members']} members")
        for row in t["rows"]:
            print(f"      {row['member_index']}: " + "; ".join(f"{c['label']}={','.join(c['cell'])}" for c in row["cells"]))
    if args.stats:
        print(f"{out.docs_evaluated} of {out.corpus_size} evaluated ({out.eval_fraction_pct:.6f} %), {out.search_time_ms:.0f} ms")


def search_batch(spark, args):
    engine = SimilarityEngine.open(spark, args.index, args.compounds)
    report = engine.search_batch(reports.read_queries(spark, args.queries), args.threshold, args.top_k, ranges(args), resolve=bool(args.compounds))
    if args.output:
        reports.write_tsv(report, args.output)
    report.agg(F.countDistinct("query_id").alias("queries"), F.count_if(F.col("rank") != "").alias("results"), F.count_if(F.col("error") != "").alias("errors")).show()


def serve(spark, args):
    from .api import serve as run

    run(SimilarityEngine.open(spark, args.index, args.compounds), args.bind, args.port)


def verify(spark, args):
    table = tables.read_table(spark, args.compounds)
    row = index.verify(index.read_index(spark, args.index), table, args.sample).first()
    print(f"{row.n_docs} documents, {row.n_mismatches} mismatches")
    if not row.ok:
        index.mismatches(index.read_index(spark, args.index), table).show()
        sys.exit(1)


def bench_linear(spark, args):
    import time

    table, query = tables.read_table(spark, args.compounds), bits_of(args.query)
    began = time.perf_counter()
    search.linear(table, query, args.threshold, args.top_k, args.sample).show(args.top_k)
    took, n = time.perf_counter() - began, table.count()
    seen = n if args.sample is None else min(n, args.sample)
    print(f"{seen} compounds in {took:.2f} s; {took * n / max(1, seen):.2f} s for all {n}")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fpspark")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name, run, **options):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for flag, kind in options.items():
            p.add_argument("--" + flag.replace("_", "-"), **kind)

    must, may = {"required": True}, {"default": None}
    asked = {"threshold": {"type": float, "default": 0.7}, "top_k": {"type": int, "default": 50}, "mw_max": {"type": float}, "logp_max": {"type": float}}
    add("ingest", ingest, input=must, output=must)
    add("build-index", build_index, compounds=must, output=must)
    add("search", run_search, index=must, query=must, compounds=may, **asked, stats={"action": "store_true"}, diverse={"action": "store_true"})
    add("search-batch", search_batch, index=must, queries=must, compounds=may, output=may, **asked)
    add("serve", serve, index=must, compounds=may, bind={"default": "127.0.0.1"}, port={"type": int, "default": 8080})
    add("verify", verify, index=must, compounds=must, sample={"type": int})
    add("bench-linear", bench_linear, compounds=must, query=must, threshold={"type": float, "default": 0.7}, top_k={"type": int, "default": 10}, sample={"type": int})
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if getattr(args, "diverse", False) and not args.compounds:
        parser().error("--diverse needs --compounds")
    if (getattr(args, "mw_max", None) is not None or getattr(args, "logp_max", None) is not None) and not args.compounds:
        parser().error("--mw-max and --logp-max need --compounds")
    spark = SparkSession.builder.appName("fpspark").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    args.run(spark, args)


if __name__ == "__main__":
    main()
