import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fpspark.llm import bagminhash, components, line_dedup, multi_index


def forest(n, edges):
    at = {i: i for i in n}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in (e for e in edges if e[0] != e[1]):
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(100, i) for i in range(50)], [(5, 3), (3, 9), (20, 21), (9, 5), (21, 22)]])
def test_components(spark, edges):
    frame = spark.createDataFrame(edges, "a long, b long")
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert {r.id: r.component for r in components.components(frame).collect()} == forest(nodes, edges)


def multiset(text):
    words = text.split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def near_texts(seed=4):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 120))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += ["spam ham " * 40, "spam ham " * 42, "spam ham " * 80, "one two", "one two", "one two three", "a", "", " ", "\n", "x " * 30_000, "x " * 29_000]
    return texts


def brute_classes(rows):
    sets = {i: multiset(t) for i, t in rows if t is not None}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8]
    return forest({i for i, _ in rows}, edges)


@pytest.mark.parametrize("block", [512, 2])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(bagminhash, "BLOCK", block)
    rows = list(enumerate(near_texts()))
    rows += [(500, None), (501, None)]
    frame = spark.createDataFrame([(i, t, i, True) for i, t in rows] + [(3, rows[3][1], 0, True), (None, "lost", 0, True)], "doc_id long, text string, rep long, kept boolean")
    got = bagminhash.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_one_crowded_bucket_with_chains(spark):
    """A chain of texts, each like the next but not like the one after: links run through members that are not the head."""
    rng = random.Random(8)
    words = [f"v{i}" for i in range(100)]
    rows, text = [], list(words)
    for i in range(40):
        rows.append((i, " ".join(text)))
        for _ in range(2):
            text[rng.randrange(100)] = f"new{i}{rng.random()}"
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in bagminhash.near_duplicates(frame).collect()} == brute_classes(rows)


def test_a_large_group_of_unlike_copies(spark, monkeypatch):
    """Copies of one text with few to many words changed: most share buckets, some link, and no copy is like all others."""
    monkeypatch.setattr(bagminhash, "BLOCK", 16)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(160):
        text = list(base)
        for k in rng.sample(range(150), rng.randrange(0, 12)):
            text[k] = f"e{rng.random()}"
        rows.append((i, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    classes = brute_classes(rows)
    assert 1 < len(set(classes.values())) < len(rows)
    assert {r.doc_id: r.class_id for r in bagminhash.near_duplicates(frame).collect()} == classes


def test_of_rows_that_repeat_a_doc_id_the_greatest_text_counts(spark):
    w = " ".join(f"w{i}" for i in range(60))
    rows = [(1, w + " q"), (2, w), (2, "z z"), (3, w), (4, None), (4, w + " r"), (5, None), (5, None), (6, ""), (6, " ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(frame).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 1, 5: 5, 6: 6}


def test_blocks_hold_the_exact_overlap():
    texts = near_texts()
    left, right = np.arange(0, 40), np.arange(30, len(texts))
    got = bagminhash.similar(pa.array(texts, pa.large_string()), left, right, 0.8)
    sets = [multiset(t) for t in texts]
    assert got.tolist() == [[bool(sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8) for b in right] for a in left]


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bagminhash.near_duplicates(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_signatures_estimate_the_weighted_similarity():
    """Collisions are unbiased: over many seeds, their share is the weighted Jaccard similarity."""
    a = {1: 3, 2: 1, 3: 7, 4: 2, 5: 1, 6: 20}
    b = {1: 1, 2: 1, 3: 9, 4: 2, 7: 4, 6: 11}
    truth = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
    owner = np.array([0] * len(a) + [1] * len(b))
    elements = np.array([*a, *b], np.uint64)
    weights = np.array([*a.values(), *b.values()])
    share = np.mean([np.mean((h := bagminhash.signatures(owner, elements, weights, 2, 128, seed))[0] == h[1]) for seed in range(40)])
    assert abs(share - truth) < 4 * (truth * (1 - truth) / (128 * 40)) ** 0.5
    alone = bagminhash.signatures(owner[: len(a)], elements[: len(a)], weights[: len(a)], 1, 128, 3)
    assert (alone[0] == bagminhash.signatures(owner, elements, weights, 2, 128, 3)[0]).all()  # company changes nothing


def test_exact_overlap():
    texts = near_texts()[:40]
    a, b = texts[:-1], texts[1:]
    got = bagminhash.overlap(pa.array(a, pa.large_string()), pa.array(b, pa.large_string()))
    assert got == pytest.approx([jaccard(multiset(x), multiset(y)) for x, y in zip(a, b, strict=True)])


def brute_lines(rows, run=line_dedup.RUN):
    """Lines left, by the definition: every run of lines is looked up among all earlier ones."""
    words = lambda x: re.findall(r"[^ \t-\r]+", x)
    lines = {i: [(k, " ".join(words(x))) for k, x in enumerate(t.split("\n")) if words(x)] for i, t in rows if t is not None}
    first, gone = {}, {i: set() for i in lines}
    for i in sorted(lines):
        own = lines[i]
        for a in range(len(own)):
            n = 0
            for b in range(a, len(own)):
                n += len(own[b][1].split(" "))
                if n >= run:
                    key = tuple(x[1] for x in own[a : b + 1])
                    if first.setdefault(key, (i, a)) < (i, a):
                        gone[i] |= {x[0] for x in own[a : b + 1]}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    line = lambda n: " ".join(f"t{rng.randrange(3000)}" for _ in range(n))
    passages = [[line(rng.randrange(1, 70)) for _ in range(rng.randrange(1, 9))] for _ in range(8)]
    common = [line(3) for _ in range(4)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(0, 7)):
            kind = rng.random()
            text += rng.choice(passages) if kind < 0.5 else [rng.choice(common)] if kind < 0.7 else [""] if kind < 0.8 else [line(rng.randrange(1, 80))]
        rows.append((i, "\n".join(text)))
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, "\n".join(["same line of six words here"] * 30)), (64, " ".join(["w"] * 60) + "\n  " + "\t".join(["w"] * 60))]
    rows += [(70 + k, f"own line {k}\n" + "\n".join(["run " * 30, "\u00a0", "\u00a0 \u2003", "end " * 30])) for k in range(3)]  # other blanks are words
    rows += [(80, "long " * 40_000 + "\n" + "text " * 40_000), (81, "long " * 40_000 + "\nx")]
    frame = spark.createDataFrame([(i, t, "n", 1.5, 7, "r") for i, t in rows], "doc_id long, text string, n_lines string, `_id` double, `_hash` int, `row` string")
    got = line_dedup.dedup_lines(frame)
    assert got.columns == ["doc_id", "text", "_id", "_hash", "row", "n_lines", "n_deleted"]
    out = {r.doc_id: r for r in got.collect()}
    want = brute_lines(rows)
    assert {i: r.text for i, r in out.items()} == want
    for i, t in rows:
        assert out[i].n_lines == (0 if t is None else t.count("\n") + 1)
        if t is not None and out[i].n_deleted < out[i].n_lines:
            assert out[i].n_lines - out[i].n_deleted == want[i].count("\n") + 1


def test_rows_that_repeat_do_not_delete_each_other(spark):
    text = " ".join(f"w{i}" for i in range(60))
    frame = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.text == text) for r in line_dedup.dedup_lines(frame).collect()) == [(0, True), (1, False), (1, False), (2, False)]


def brute_vectors(rows, t=0.98):
    """Links of each row, and the least vec_id that each row reaches."""
    good = {}
    for at, (i, v, label) in enumerate(rows):
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = np.array(v, float) / max(map(abs, v))
        good.setdefault((i, label, tuple(v)), (v, []))[1].append(at)
    keys = list(good)

    def alike(a, b):
        x, y = good[a][0], good[b][0]
        return a[1] == b[1] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= t

    edges = [(j, k) for k in range(len(keys)) for j in range(k) if alike(keys[j], keys[k])]
    links, classes = Counter(x for e in edges for x in e), forest(range(len(keys)), edges)
    least = {}
    for k, c in classes.items():
        least[c] = min(least.get(c, keys[k][0]), keys[k][0])
    out = {at: (0, i) for at, (i, _, _) in enumerate(rows)}
    out.update({at: (links[k], least[classes[k]]) for k, key in enumerate(keys) for at in good[key][1]})
    return sorted((i, *out[at]) for at, (i, _, _) in enumerate(rows) if i is not None)


def vector_frame(spark, rows, element="double"):
    return spark.createDataFrame([(*r, 9) for r in rows], f"vec_id long, embedding array<{element}>, label int, n_links int")


@pytest.mark.parametrize("block", [4096, 16])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(multi_index, "BLOCK", block)
    monkeypatch.setattr(multi_index, "PER_CELL", 8)
    rng = np.random.default_rng(6)
    rows = []
    for g in range(60):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 9)) if g else 80):
            v = base + rng.standard_normal(16) * 0.1
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(g % 3)))
    rows += [(1000 + k, rows[5][1], rows[5][2]) for k in range(4)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0, None] * 8, 1), (2004, rows[5][1], None), (2005, [], 1), (2006, [float("inf")] * 16, 1)]
    got = multi_index.near_vectors(vector_frame(spark, rows, "float")).collect()
    want = brute_vectors(rows)
    assert len(got) == len(rows)
    by = {i: n for i, n, _ in want}
    found = sum(r.n_links for r in got)
    assert all(r.n_links <= by[r.vec_id] for r in got)
    assert found >= 0.97 * sum(by.values())
    if found == sum(by.values()):
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_of_any_length_size_and_id(spark):
    """Other lengths than most, one component, repeated vec_ids, one vec_id under two labels, and components whose squares overflow or vanish."""
    rng = np.random.default_rng(1)
    v = rng.standard_normal(8).tolist()
    near = [x + 0.01 for x in v]
    rows = [(i, rng.standard_normal(3).tolist(), 0) for i in range(30)]
    rows += [(100, [1.0, 2.0], 0), (101, [1.001, 2.0], 0), (102, [-1.0, -2.0], 0), (103, [1.0], 0), (104, [2.5], 0), (105, [-3.0], 0)]
    rows += [(200, v, 1), (200, v, 1), (201, near, 1), (200, near, 2), (202, v, 2), (203, [x * 1e200 for x in v], 1), (204, [x * 1e-200 for x in near], 1)]
    rows += [(205, v, 3), (205, near, 3), (206, [0.0, 1.0], 4), (207, [-0.0, 1.0], 4)]
    got = multi_index.near_vectors(vector_frame(spark, [*rows, (None, v, 1)])).collect()
    assert len(got) == len(rows) + 1
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None) == brute_vectors(rows)


def test_recall_where_most_cells_are_not_visited(spark, monkeypatch):
    """Pairs at the very angle of the threshold, the hardest to find: recall over 0.98 from a small share of the grid."""
    monkeypatch.setattr(multi_index, "PER_CELL", 2)
    rng = np.random.default_rng(5)
    x = multi_index.unit(rng.standard_normal((1500, 24)))
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    y = 0.981 * x + np.sqrt(1 - 0.981**2) * multi_index.unit(noise)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, y]))]
    got = multi_index.near_vectors(vector_frame(spark, rows)).collect()
    assert sum(r.n_links for r in got) >= 0.98 * 3000
    one, two, margin = multi_index.fit(x, 38, 0.98)
    visited = [len(list(multi_index.multi_sequence(a, b, margin))) for a, b in zip(multi_index.squared(x[:, :12], one), multi_index.squared(x[:, 12:], two), strict=True)]
    assert np.mean(visited) < 0.25 * 38 * 38


def test_no_vectors(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert multi_index.near_vectors(frame).count() == 0
    frame = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in multi_index.near_vectors(frame).collect()] == [(1, 0, 1, True)]


def test_multi_sequence_visits_cells_in_order():
    rng = np.random.default_rng(2)
    d1, d2 = rng.random(9), rng.random(7)
    cells = list(multi_index.multi_sequence(d1, d2, 0.4))
    costs = [d1[i] + d2[j] for i, j in cells]
    assert costs == sorted(costs)
    assert set(cells) == {(i, j) for i in range(9) for j in range(7) if d1[i] + d2[j] <= d1.min() + d2.min() + 0.4}
