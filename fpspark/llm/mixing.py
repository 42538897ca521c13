"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations alone.

Documents are counted into cells of source, language and topic, weighted by
their tokens. Factors for each source, language and topic are raked in turn
until the weighted cells meet the target share of each. The product of a
document's three factors, scaled, is how often it is expected in the sample: at
most once (the largest sample that repeats nothing), or so that the sample has
a given share of all tokens. The whole part of that number is certain, and a
hash of the doc_id decides on the rest. So the sample has the target shares in
expectation, and is the same at every cluster size.

Every value of a dimension has its own cells and its own target. Up to FEW
cells are raked in one row by higher-order functions, and what they give is
broadcast. Beyond, the factors of each dimension are a table, and every step is
a join of the cells with two of them and a grouped sum, until the shares are
met to TOLERANCE: the same numbers, for any number of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, new_path, remove

#: Cells that are raked in one row, at most; name of null.
FEW, NULL = 4096, "(null)"
#: Targets, where none are given: observed shares to this power, scaled to 1. Rounds of raking, and the gap of shares that ends them.
POWER, ROUNDS, TOLERANCE = 0.9, 30, 1e-10
DIMENSIONS = ("source", "lang", "topic")
#: A token, for weights: a run of letters, a digit, or a run of what is neither these nor blank (as the pre-tokenizers of word-level vocabularies cut).
TOKEN = r"[\p{L}\p{M}]+|\p{N}|[^\p{L}\p{M}\p{N}\p{Z}\x00-\x20]+"


def n_tokens(text: Column) -> Column:
    """Tokens of a text; 0 for null and empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("long")


def topic_of(text: Column) -> Column:
    """The form of a text, which stands for its topic where there is no column of topics: legal, table, contact, list, note or prose; null and empty texts are notes."""
    text = F.coalesce(text, F.lit(""))
    has = lambda s: F.contains(text, F.lit(s))
    lines = F.length(text) - F.length(F.translate(text, "\n", ""))
    return (
        F.when(has("Licens") | has("icense") | has("All rights"), "legal")
        .when(has(" | "), "table")
        .when(has("@"), "contact")
        .when(F.length(text) < 400, "note")
        .when(lines >= 15, "list")
        .otherwise("prose")
    )


def cells(docs: DataFrame) -> DataFrame:
    """source, lang, topic and w (tokens) of each cell that has tokens, from rows with these columns and n_tokens."""
    return docs.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("w")).filter("w > 0")


def few(cell_rows: DataFrame) -> bool:
    """Whether the cells are raked in one row."""
    return cell_rows.limit(FEW + 1).count() <= FEW


def _powers(power) -> dict[str, float]:
    return {d: float(power[d] if isinstance(power, dict) else power) for d in DIMENSIONS}


def factors(cell_rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, power=POWER, rounds: int = ROUNDS, budget: float | None = None) -> DataFrame:
    """source, lang, topic and expected (how often a document of the cell is in the sample).

    ``targets``: for a dimension, {value: share}; values left out get share 0,
    and a value without tokens must not have more. ``power``: for dimensions
    without targets, a number or {dimension: number}; 1 leaves shares as they
    are, 0 makes them equal. ``budget``: the sample's share of all tokens.
    """
    targets = targets or {}
    for d in targets:
        wanted = [v for v, s in targets[d].items() if s > 0]
        there = {r[0] for r in cell_rows.filter(F.col(d).isin(wanted)).select(d).distinct().collect()}
        if missing := sorted(set(wanted) - there):
            raise ValueError(f"no tokens of {d} {missing} to meet a target with")
    rows = (_in_one_row if few(cell_rows) else _by_joins)(cell_rows, targets, _powers(power), rounds)
    if budget is None:
        scale = F.try_divide(F.lit(1.0), F.max("p"))
    else:
        scale = F.try_divide(F.lit(float(budget)) * F.sum("w"), F.sum(F.col("w") * F.col("p")))
    return rows.crossJoin(F.broadcast(rows.agg(scale.alias("scale")))).select(*DIMENSIONS, F.round(F.col("p") * F.col("scale"), 9).alias("expected"))


def shares(cell_rows: DataFrame, found: DataFrame, targets: dict[str, dict[str, float]] | None = None, power=POWER) -> DataFrame:
    """What ``factors`` reach: dimension, value, observed, target and reached share of tokens of each value."""
    targets, powers, out = targets or {}, _powers(power), None
    both = cell_rows.join(found, list(DIMENSIONS))
    for d in DIMENSIONS:
        raw = _target(d, targets, powers)
        each = both.groupBy(d).agg(F.sum("w").alias("w"), raw.alias("raw"), F.sum(F.col("w") * F.col("expected")).alias("got"))
        sums = each.agg(*[F.sum(c).alias(f"all_{c}") for c in ("w", "raw", "got")])
        part = each.crossJoin(F.broadcast(sums)).select(F.lit(d).alias("dimension"), F.col(d).alias("value"), *[F.try_divide(c, f"all_{c}").alias(name) for c, name in (("w", "observed"), ("raw", "target"), ("got", "reached"))])
        out = part if out is None else out.union(part)
    return out


def _target(d: str, targets: dict[str, dict[str, float]], powers: dict[str, float]) -> Column:
    """The target of each value of a dimension, not scaled, as an aggregate."""
    if d not in targets:
        return F.pow(F.sum("w"), F.lit(powers[d]))
    given = F.create_map(*[F.lit(z) for v, s in targets[d].items() for z in (v, float(s))])
    return F.coalesce(F.try_element_at(given, F.col(d)), F.lit(0.0))


def _by_joins(cell_rows: DataFrame, targets: dict[str, dict[str, float]], powers: dict[str, float], rounds: int) -> DataFrame:
    """The cells and p, the product of their factors, for any number of cells: one small job for each step."""
    spark, wanted, found, paths = cell_rows.sparkSession, {}, {}, {}
    for d in DIMENSIONS:
        each = cell_rows.groupBy(d).agg(_target(d, targets, powers).alias("raw"))
        wanted[d] = materialize(each.crossJoin(F.broadcast(each.agg(F.sum("raw").alias("all")))).select(d, F.try_divide("raw", "all").alias("t"), F.lit(1.0).alias("old")), f"shares-{d}")

    def weighted(w: Column, dims) -> tuple[DataFrame, Column]:
        rows = cell_rows
        for d in dims:
            if d in found:  # before the first step of a dimension its factors are 1
                rows, w = rows.join(found[d].select(d, f"f_{d}"), d), w * F.col(f"f_{d}")
        return rows, w

    for _ in range(rounds):
        gap = 0.0
        for d in DIMENSIONS:
            rows, w = weighted(F.col("w"), [x for x in DIMENSIONS if x != d])
            mass = rows.groupBy(d).agg(F.sum(w).alias("mass"))
            before = found[d].select(d, "t", F.col(f"f_{d}").alias("old")) if d in found else wanted[d]
            path, gone = new_path(spark, f"factors-{d}"), paths.get(d)
            after = before.join(mass, d, "left").select(d, "t", F.coalesce(F.try_divide("t", "mass"), F.lit(0.0)).alias(f"f_{d}"), F.abs(F.col("old") * F.coalesce("mass", F.lit(0.0)) - F.col("t")).alias("gap"))
            found[d] = materialize(after, f"factors-{d}", path)
            gap = max(gap, found[d].agg(F.max("gap").alias("gap")).first().gap or 0.0)
            paths[d] = path
            if gone:
                remove(spark, gone)
        if gap <= TOLERANCE:
            break
    rows, p = weighted(F.lit(1.0), DIMENSIONS)
    return rows.select(*DIMENSIONS, "w", p.alias("p"))


def _in_one_row(cell_rows: DataFrame, targets: dict[str, dict[str, float]], powers: dict[str, float], rounds: int) -> DataFrame:
    """The same for a bounded number of cells."""
    def values_of(d):
        return F.transform("cells", lambda c: c[d])

    def given_shares(k, d):
        given = F.create_map(*[F.lit(z) for v, s in targets[d].items() for z in (v, float(s))])
        return F.transform(f"v{k}", lambda v: F.coalesce(F.try_element_at(given, v), F.lit(0.0)))

    def own_shares(k):
        return F.transform(F.sequence(F.lit(1), F.size(f"v{k}")), lambda i: F.pow(add(F.filter("x", lambda c: c[f"i{k}"] == i), lambda c: c["w"]), F.lit(powers[DIMENSIONS[k]])))

    def scaled(k):
        return F.transform(f"t{k}", lambda t: F.try_divide(t, F.aggregate(f"t{k}", F.lit(0.0), lambda s, y: s + y)))

    add = lambda rows, f: F.aggregate(rows, F.lit(0.0), lambda s, c: s + f(c))
    one = cell_rows.agg(F.sort_array(F.collect_list(F.struct(*DIMENSIONS, "w"))).alias("cells"))
    for k, d in enumerate(DIMENSIONS):
        one = one.withColumn(f"v{k}", F.array_sort(F.array_distinct(values_of(d))))
    indexed = F.transform("cells", lambda c: F.struct(*[F.array_position(f"v{k}", c[d]).cast("int").alias(f"i{k}") for k, d in enumerate(DIMENSIONS)], c["w"].alias("w")))
    # An exchange of the one row after each step keeps Spark from computing a step anew for every use of it.
    one = one.repartition(1).withColumn("x", indexed).repartition(1)
    for k, d in enumerate(DIMENSIONS):
        one = one.withColumn(f"t{k}", given_shares(k, d) if d in targets else own_shares(k))
        one = one.repartition(1).withColumn(f"t{k}", scaled(k)).repartition(1)
    ones = [F.transform(f"v{k}", lambda _: F.lit(1.0)).alias(f"f{k}") for k in range(3)]

    def raked(state: Column, k: int) -> Column:
        """The state with the factors of dimension k set so that its shares are met."""
        others = [j for j in range(3) if j != k]
        mass = lambda i: add(F.filter("x", lambda c: c[f"i{k}"] == i), lambda c: c["w"] * F.element_at(state[f"f{others[0]}"], c[f"i{others[0]}"]) * F.element_at(state[f"f{others[1]}"], c[f"i{others[1]}"]))
        new = F.transform(F.sequence(F.lit(1), F.size(f"v{k}")), lambda i: F.coalesce(F.try_divide(F.element_at(f"t{k}", i), mass(i)), F.lit(0.0)))
        return F.struct(*[(new if j == k else state[f"f{j}"]).alias(f"f{j}") for j in range(3)])

    for_rounds = F.sequence(F.lit(0), F.lit(3 * rounds - 1))
    step = lambda s, r: F.when(r % 3 == 0, raked(s, 0)).when(r % 3 == 1, raked(s, 1)).otherwise(raked(s, 2))
    one = one.withColumn("f", F.aggregate(for_rounds, F.struct(*ones), step)).repartition(1)
    product = lambda c: F.element_at("f.f0", c["i0"]) * F.element_at("f.f1", c["i1"]) * F.element_at("f.f2", c["i2"])
    one = one.withColumn("p", F.transform("x", product)).repartition(1)
    rows = one.select(F.explode(F.arrays_zip("cells", "p")).alias("z"))
    return rows.select(*[F.col(f"z.cells.{x}").alias(x) for x in (*DIMENSIONS, "w")], F.col("z.p").alias("p"))


def draw(doc_id: Column) -> Column:
    """A number from 0 to 1 that doc_id alone decides."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


ADDED = ("topic", "n_tokens", "expected", "copies")


def mix_sources(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None, tokens: Column | None = None, power=POWER, budget: float | None = None) -> DataFrame:
    """The drawn rows of ``docs`` (doc_id, text, source, lang), whole, with topic, n_tokens, expected and copies added.

    ``targets``, ``power`` and ``budget`` as in ``factors``; ``topic`` and
    ``tokens`` replace the topic and the number of tokens that are told from the
    text. ``copies`` is how often a row stands in the sample, 1 where there is
    no budget. Null sources, languages and topics are values of their own, null
    and empty texts have no tokens; documents of a cell without tokens are kept
    once, as they change no share. Texts count by all their tokens, however
    long. Rows that repeat a doc_id and a cell are drawn or left together; all
    null ones too. A number that ties with what is expected is not drawn.
    Columns named as the added ones, in any case, are replaced; any other name
    is kept. An empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    value = lambda c: F.coalesce(c.cast("string"), F.lit(NULL))
    own = [value(F.col("source")).alias("source"), value(F.col("lang")).alias("lang"), value(topic_of(F.col("text")) if topic is None else topic).alias("topic"), (n_tokens(F.col("text")) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")).alias("n_tokens")]
    # Written, both tables are computed once.
    counted = materialize(cells(docs.select(*own)), "cells")
    table = materialize(factors(counted, targets, power, budget=budget), "factors")
    # The row is one column while it meets the table: no name of it can clash.
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("doc_id").alias("id"), *own)
    found = tagged.join(F.broadcast(table) if few(counted) else table, list(DIMENSIONS), "left")
    e = F.coalesce("expected", F.lit(1.0))
    copies = (F.floor(e) + F.when(draw(F.col("id")) < e - F.floor(e), 1).otherwise(0)).cast("long")
    return found.select("row", "topic", "n_tokens", e.alias("expected"), copies.alias("copies")).filter("copies > 0").select("row.*", *ADDED)


def weights_sql(table: str = "documents", power=POWER, rounds: int = ROUNDS, budget: float | None = None) -> str:
    """The same sample as DuckDB SQL: doc_id, source, lang, topic, n_tokens, expected, copies."""
    text, powers = "coalesce(text, '')", list(_powers(power).values())
    dims = [f"list_sort(list_distinct(list_transform(cells, lambda c: c.{d})))" for d in DIMENSIONS]
    index = ", ".join(f"i{k} := list_position(v{k}, c.{d})" for k, d in enumerate(DIMENSIONS))
    raw = ", ".join(f"list_transform(v{k}, lambda v, i: pow(list_sum(list_transform(list_filter(x, lambda c: c.i{k} = i), lambda c: c.w)), {powers[k]})) AS r{k}" for k in range(3))
    share = ", ".join(f"list_transform(r{k}, lambda t: t / list_sum(r{k})) AS t{k}" for k in range(3))
    scale = "1 / max(p)" if budget is None else f"{float(budget)} * sum(w) / sum(w * p)"

    def mass(k: int, names: list[str]) -> str:
        a, b = (j for j in range(3) if j != k)
        return f"list_transform(v{k}, lambda v, i: coalesce(t{k}[i] / nullif(list_sum(list_transform(list_filter(x, lambda c: c.i{k} = i), lambda c: c.w * {names[a]}[c.i{a}] * {names[b]}[c.i{b}])), 0), 0))"

    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '{NULL}') AS source, coalesce(lang, '{NULL}') AS lang,
    CASE WHEN contains({text}, 'Licens') OR contains({text}, 'icense') OR contains({text}, 'All rights') THEN 'legal'
      WHEN contains({text}, ' | ') THEN 'table' WHEN contains({text}, '@') THEN 'contact' WHEN length({text}) < 400 THEN 'note'
      WHEN length({text}) - length(replace({text}, chr(10), '')) >= 15 THEN 'list' ELSE 'prose' END AS topic,
    len(regexp_extract_all({text}, '{TOKEN}'))::BIGINT AS n_tokens
  FROM {table}),
c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS w FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
one AS (SELECT list({{'source': source, 'lang': lang, 'topic': topic, 'w': w}} ORDER BY source, lang, topic) AS cells FROM c),
v AS (SELECT cells, {", ".join(f"{e} AS v{k}" for k, e in enumerate(dims))} FROM one),
x AS (SELECT *, list_transform(cells, lambda c: struct_pack({index}, w := c.w)) AS x FROM v),
r AS (SELECT *, {raw} FROM x),
t AS (SELECT x, cells, v0, v1, v2, {share} FROM r),
it AS (
  SELECT 0 AS k, list_transform(v0, lambda v: 1.0::DOUBLE) AS f0, list_transform(v1, lambda v: 1.0::DOUBLE) AS f1, list_transform(v2, lambda v: 1.0::DOUBLE) AS f2 FROM t
  UNION ALL
  SELECT k + 1, f0, f1, {mass(2, ["f0", "f1", "f2"])} FROM (
    SELECT k, f0, {mass(1, ["f0", "f1", "f2"])} AS f1, f2, x, v0, v1, v2, t0, t1, t2 FROM (
      SELECT k, {mass(0, ["f0", "f1", "f2"])} AS f0, f1, f2, x, v0, v1, v2, t0, t1, t2 FROM it, t WHERE k < {rounds}))),
p AS (SELECT cells, list_transform(x, lambda c: f0[c.i0] * f1[c.i1] * f2[c.i2]) AS p FROM it, t WHERE k = {rounds}),
u AS (SELECT unnest(cells, recursive := false) AS c, unnest(p) AS p FROM p),
s AS (SELECT {scale} AS scale FROM (SELECT c.w AS w, p FROM u)),
f AS (SELECT c.source AS source, c.lang AS lang, c.topic AS topic, round(p * scale, 9) AS e FROM u, s),
j AS (
  SELECT doc_id, d.source, d.lang, d.topic, n_tokens, coalesce(e, 1.0) AS expected, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::UBIGINT::DOUBLE / {float(1 << 48)!r} AS u
  FROM d LEFT JOIN f ON d.source = f.source AND d.lang = f.lang AND d.topic = f.topic)
SELECT doc_id, source, lang, topic, n_tokens, expected, (floor(expected) + CASE WHEN u < expected - floor(expected) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM j WHERE floor(expected) > 0 OR u < expected - floor(expected)
"""
