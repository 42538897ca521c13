import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import hashlib  # noqa: E402
import random  # noqa: E402
import re  # noqa: E402
from collections import Counter  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402
from test_dedup import brute_classes, brute_lines  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from fpspark.llm import bagminhash, entry, mixing, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and rows of every stage of a run over the smallest table."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, docs, SF)
        rows = frame.collect()
        out.append((name, docs.collect(), rows))
        docs = spark.createDataFrame(rows, frame.schema)
    return out


def test_names_and_columns(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "minhash_near_dedup", "source_mixing", "bpe_encoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == list(corpus_pipeline.COLUMNS)


def test_each_stage_against_brute_force(spark, stages):
    (_, docs, clean), (_, _, cut), (_, _, single), (_, _, mixed), (_, _, coded) = stages
    # toxicity: what the model, held against brute force elsewhere, does not reject
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    rejected = {r.doc_id for r in toxicity.score(frame, toxicity.learn(frame, spark.read.parquet(f"{SF}/labels.parquet"))).collect() if r.predicted}
    assert sorted(clean) == sorted(r for r in docs if r.doc_id not in rejected)
    # line dedup: lines left by the definition
    want = brute_lines([(r.doc_id, r.text) for r in clean])
    assert {r.doc_id: r.text for r in cut} == want and all(r.n_chars == len(r.text) for r in cut)
    # near-dedup: the least doc_id of each class by all pairs
    classes = brute_classes([(r.doc_id, r.text) for r in cut])
    assert sorted(r.doc_id for r in single) == sorted(set(classes.values()))
    # mixing: draws by probabilities raked over all cells in plain Python
    rows = [(r, (r.source or mixing.NULL, r.lang or mixing.NULL, form(r.text))) for r in single]
    weights = Counter()
    for r, cell in rows:
        weights[cell] += len(re.findall(r"[^\W\d_]+|\d|[^\w\s]+|_+", r.text or ""))
    p = rake({c: w for c, w in weights.items() if w}, corpus_pipeline.MIX_POWER)
    drawn = {r.doc_id for r, cell in rows if int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:12], 16) / (1 << 48) < p.get(cell, 1.0)}
    got = {r.doc_id for r in mixed}
    assert len(drawn ^ got) <= 0.02 * len(rows)  # tokens of rare characters are cut a little differently here
    # encoding: the library's ids
    library = Tokenizer.from_file(corpus_pipeline.WORD_BPE)
    texts = {r.doc_id: r.text for r in mixed}
    assert len(coded) == len(mixed)
    for r in coded:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def form(text):
    text = text or ""
    if any(x in text for x in ("Licens", "icense", "All rights")):
        return "legal"
    return "table" if " | " in text else "contact" if "@" in text else "note" if len(text) < 400 else "list" if text.count("\n") >= 15 else "prose"


def rake(cells, power, rounds=60):
    values = [sorted({c[k] for c in cells}) for k in range(3)]
    raw = [{v: sum(w for c, w in cells.items() if c[k] == v) ** power for v in values[k]} for k in range(3)]
    target = [{v: x / sum(t.values()) for v, x in t.items()} for t in raw]
    f = [dict.fromkeys(v, 1.0) for v in values]
    for _ in range(rounds):
        for k in range(3):
            for v in values[k]:
                a, b = (j for j in range(3) if j != k)
                f[k][v] = target[k][v] / sum(w * f[a][c[a]] * f[b][c[b]] for c, w in cells.items() if c[k] == v)
    p = {c: f[0][c[0]] * f[1][c[1]] * f[2][c[2]] for c in cells}
    return {c: x / max(p.values()) for c, x in p.items()}


def test_run_is_the_stages_in_a_row(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert sorted(out.collect()) == sorted(stages[-1][2])


def messy(spark):
    rng = random.Random(7)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(30_000))
    rows = [(1, None, "en", "a", None, 1), (2, "", None, None, 0, 1), (None, "some text", "en", "a", 9, 1), (None, "some text", "en", "a", 9, 1), (3, "some text " * 30, "en", "a", 300, 1), (4, "some text " * 30, "en", "b", 300, 1)]
    rows += [(5, long, "en", "a", len(long), 1), (6, long + " end", "de", "a", len(long) + 4, 1), (7, "one of two", "en", "a", 10, 1), (7, "two of two, with more words", "en", "a", 27, 1), (8, "same", "en", "a", 4, 1), (8, "same", "en", "a", 4, 1)]
    return spark.createDataFrame(rows, SCHEMA + ", `Keys` int")


def test_messy_rows(spark):
    """Nulls in any column, empty and long texts, rows that repeat, a column whose name clashes with ones used inside."""
    docs = messy(spark)
    given = Counter((r.doc_id, r.text) for r in docs.collect())
    (_, drop), (_, lines), (_, near), (_, mix), (_, encode) = corpus_pipeline.STAGES
    assert Counter((r.doc_id, r.text) for r in drop(spark, docs, SF).collect()) == given
    cut = lines(spark, docs, SF).collect()
    assert Counter(r.doc_id for r in cut) == Counter(i for i, _ in given.elements())
    texts = {r.doc_id: r.text for r in cut}
    assert texts[1] is None and texts[2] == "" and texts[5].count(" ") == 29_999 and texts[4] == ""
    kept = Counter(r.doc_id for r in near(spark, docs, SF).collect())
    assert kept == {None: 2, 1: 1, 2: 1, 3: 1, 5: 1, 7: 2, 8: 2}
    drawn = mix(spark, docs, SF)
    assert drawn.columns == list(corpus_pipeline.COLUMNS) and not Counter((r.doc_id, r.text) for r in drawn.collect()) - given
    assert Counter((r.doc_id, r.n_tokens) for r in encode(spark, docs, SF).collect())[(8, 1)] == 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_queries_without_sql_run_whole(spark):
    """op1 and op8 of the entry against all pairs, op4 against the definition: whole tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = entry.QUERIES["op8_bagminhash"](spark, SF).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)
    assert {r.doc_id: r.text for r in entry.QUERIES["op4_line_dedup"](spark, SF).collect()} == brute_lines(rows)
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert entry.QUERIES["op1_multi_index"](spark, SF).count() == n
    for name in ("op3_bpe_transducer", "op5_token_counts", "op9_token_ids"):
        assert entry.QUERIES[name](spark, SF).count() == len(rows)
    near = bagminhash.near_duplicates(docs).filter(F.col("kept")).count()
    assert near == len({r.class_id for r in got})
