import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from fpspark.llm import entry, lm_scores, mixing, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row, old = [i], row
            for j, d in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
        return row[-1]

    rng = random.Random(1)
    word = lambda lo, hi: "".join(rng.choice("abc") for _ in range(rng.randrange(lo, hi)))
    terms = {word(5, 9) for _ in range(15)}
    trie = toxicity.Trie(terms)
    for _ in range(1500):
        w = word(3, 10)
        for k in (1, 2):
            assert trie.near(w, k) == min((t for t in terms if distance(t, w) <= k), default=None), (w, k)


def test_quotation_is_told_from_abuse():
    model = toxicity.Model(["moron"], [], [-4.0, 8.0, 2.0, 0.0, 0.0])
    scorer = toxicity.Scorer(model)
    import pyarrow as pa

    texts = pa.array(["you are a moron", 'he was called a "moron" by some', "« moron » est un mot", "a mooron passes by", "", "clean text"], pa.large_string())
    assert (scorer.scores(texts) >= 0.5).tolist() == [True, False, False, False, False, False]
    assert scorer.features(texts)[3].tolist() == [0, math.log(2), 0, 0]


def labelled(spark, n=600):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text[rng.randrange(40)] = rng.choice(["awfulterm", "badbadword", "nasty"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_holds_out(spark):
    docs, labels = labelled(spark)
    model = toxicity.learn(docs, labels)
    assert set(model.terms) == {"awfulterm", "badbadword", "nasty"}
    more = docs.union(spark.createDataFrame([(9000, None), (9001, ""), (None, "nasty nasty nasty"), (1, "clean")], "doc_id long, text string"))
    out = toxicity.score(more, model).collect()
    assert len(out) == 604
    for r in out:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert held and all(r.predicted == truth[r.doc_id] for r in held)
    # labels of held-out rows are never read
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(docs, flipped) == model
    kept = toxicity.drop_toxic(more, model)
    assert kept.columns == ["doc_id", "text"] and kept.count() == sum(not r.predicted for r in out)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def test_op6_equals_brute_force(spark):
    """Scores of the whole query, from its model, with edit distances counted one by one."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.learn(docs, labels)
    assert model.terms
    seen = {}

    def kind(chunk):
        words = [w.casefold() for w in re.findall(r"[^\W_]+", unicodedata.normalize("NFC", chunk))]
        if any(w in model.terms for w in words):
            return 1
        if model.stems and any(w.startswith(tuple(model.stems)) for w in words):
            return 3
        near = lambda w: len(w) >= 4 and w not in model.clean and any(len(t) >= 5 and abs(len(t) - len(w)) < 2 and edit_distance(w, t) == 1 for t in model.terms)
        return 2 if any(map(near, words)) else 0

    got = {r.doc_id: r for r in entry.QUERIES["op6_toxicity"](spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        chunks = re.split("[\t-\r ]", r.text or "")
        kinds = [seen[c] if c in seen else seen.setdefault(c, kind(c)) for c in chunks]
        hits = [i for i, k in enumerate(kinds) if k in (1, 2)]
        x = [0, 0, 0]
        for i, q in zip(hits, toxicity.Scorer.quoted(chunks, hits), strict=True):
            x[2 if q else kinds[i] - 1] += 1
        stems = len({c for c, k in zip(chunks, kinds, strict=True) if k == 3})
        toxic, clean = model.rates
        llr = max(0, stems * math.log(toxic / clean) - len(set(chunks)) * (toxic - clean)) if any(kinds) else 0
        z = model.weights[0] + sum(w * math.log1p(v) for w, v in zip(model.weights[1:], [*x, llr], strict=True))
        assert got[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-z))) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)


def test_toxicity_of_held_out_rows(spark):
    """Labels have noise (toxic ones on texts without any term), so recall stays a little below 1."""
    sf = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    out = entry.QUERIES["op6_toxicity"](spark, sf).filter("held_out").join(truth, "doc_id").collect()
    toxic, clean = [r for r in out if r.toxic == 1], [r for r in out if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in clean) <= 0.005 * len(clean)


def test_words_however_they_are_parted():
    import pyarrow as pa

    scorer = toxicity.Scorer(toxicity.Model(["idiot"], [], [-4.0, 8.0, 2.0, 0.0, 4.0], ["boment"], (0.1, 0.001)))
    texts = ["worthless/idiot", "the\u00a0idiot\u3000there", "nonsense-idiot,", "IDIOT's", "idlot", "idlott", "bomente bomentar x bomentos", "bomente " + "x%d " * 50 % tuple(range(50)), None]
    assert (scorer.scores(pa.array([t or "" for t in texts], pa.large_string())) >= 0.5).tolist() == [True, True, True, True, False, False, True, False, False]
    assert scorer.features(pa.array(["idlot"], pa.large_string())).tolist() == [[0, math.log(2), 0, 0]]


def test_near_copies_are_one_group():
    import pyarrow as pa

    rng = random.Random(1)
    base = [f"b{i}" for i in range(200)]
    copies = [" ".join(base[:k] + [f"c{k}"] + base[k + 1 :]) for k in range(0, 200, 20)]
    others = [" ".join(f"o{rng.randrange(10_000)}" for _ in range(200)) for _ in range(10)]
    rows = [(i, k.tolist()) for i, k in enumerate(toxicity.copy_keys(pa.array([*copies, *others, "", ""], pa.large_string())))]
    groups = toxicity.copy_groups(rows)
    assert len({groups[i] for i in range(10)}) == 1 and len(set(groups.values())) == 13


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 20)
    model = toxicity.learn(docs, labels.limit(0))
    assert model.terms == [] and toxicity.score(docs, model).filter("predicted = 1").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_base_rules_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["en", "de", None, "zz"]), "".join(rng.choice(["a", "bb", " ", " ", "\n", "ü ", "#|", "\t", "x y z w v u t s ", "🙂", "\xa0", "\x1c"]) for _ in range(rng.randrange(0, 300)))) for i in range(300)]
    rows += [(300, "en", None), (301, None, ""), (302, "en", "w " * 20_000), (302, "en", "w " * 20_000), (None, "en", "Some words. " * 3)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("kept", F.lit("x"))
    got = quality.quality_rules(frame).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, _, t in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)
    assert quality.quality_rules(frame.limit(0)).count() == 0


def test_distances_and_common_words(spark):
    rng = random.Random(7)
    words = ["the", "of", "and"] * 20 + [f"word{i}" for i in range(400)]
    good = [(i, "en", ". ".join(" ".join(rng.choice(words) for _ in range(10)).capitalize() for _ in range(12)) + ".") for i in range(80)]
    bad = [(100, "en", "#### $$$$ %%%% " * 40 + " ".join(str(i) for i in range(60))), (101, "en", " ".join("QZX" + str(rng.random()) for _ in range(120)))]
    frame = spark.createDataFrame(good + bad, "doc_id long, lang string, text string")
    refs = quality.references(frame)
    counts = Counter(w for _, _, t in good + bad for w in t.split())
    n = sum(counts.values())
    assert dict(zip(refs["en"][1], refs["en"][2], strict=False)) == pytest.approx({w: c / n for w, c in counts.items() if c >= quality.SHARE * n})
    assert refs["en"][0].sum() == pytest.approx(1) and refs["en"][2].sum() == pytest.approx(1)
    kept = {r.doc_id: r.kept for r in quality.measure(frame, refs).collect()}
    assert all(kept[i] for i, _, _ in good) and not kept[100] and not kept[101]
    p, q = np.array([[4.0, 0, 0], [1, 2, 1], [0, 0, 0]]), np.array([0.25, 0.5, 0.25])
    assert quality.distance(p, q)[1:] == pytest.approx([0, 0]) and 0 < quality.distance(p, q)[0] < 1


def test_op10_equals_brute_force(spark):
    """Every column of the whole query, with histograms and distances worked out by the definitions."""
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")

    def classes(text):
        out = Counter()
        for c in text or "":
            kind = unicodedata.category(c)
            out["stop" if c in ".,;:?'" else "line end" if c in "\n\r\x0b\x0c" else "Z" if c in "\t " else kind if kind in ("Ll", "Lu") else kind[0] if kind[0] in "LMNZPS" else "other"] += 1
        return out

    def js(p, q):
        """Jensen-Shannon distance of two histograms, as entropies."""
        norm = lambda h: {k: v / sum(h.values()) for k, v in h.items() if v}
        entropy = lambda h: -sum(v * math.log2(v) for v in h.values() if v)
        p, q = norm(p), norm(q)
        return math.sqrt(max(0, entropy({k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}) - (entropy(p) + entropy(q)) / 2)) if p else 0.0

    words, chars = {}, {}
    for r in rows:
        words.setdefault(r.lang, Counter()).update(words_of(r.text))
        chars.setdefault(r.lang, Counter()).update(classes(r.text))
    common = {lang: {w for w, n in c.items() if n >= c.total() / 400} for lang, c in words.items()}
    assert all(c.total() >= quality.LEAST for c in words.values()) and all(common.values())
    fold = lambda lang, c: Counter({w: c[w] for w in common[lang] & c.keys()} | {"(rest)": sum(n for w, n in c.items() if w not in common[lang])})
    refs = {lang: fold(lang, c) for lang, c in words.items()}
    got = {r.doc_id: r for r in entry.QUERIES["op10_quality_rules"](spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g, w = got[r.doc_id], words_of(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == base(r.text)[:5]
        a, b = js(classes(r.text), chars[r.lang]), js(fold(r.lang, Counter(w)), refs[r.lang]) if w else 0.0
        assert g.char_distance == pytest.approx(a, abs=1e-6) and g.word_distance == pytest.approx(b, abs=1e-6)
        failed = len(w) < 20 or 100 * g.n_repeat_words > 30 * len(w)
        far = (len(r.text or "") >= 200 and a > quality.CHAR_LIMIT) or (len(w) >= 50 and b > quality.WORD_LIMIT)
        assert g.base_failed == failed and g.kept == (not failed and not far)


def test_classes_of_all_planes():
    table = quality.char_classes()
    for c in "a A Ж 中 \u0301 5 \U00030000 \U00020000 \U0001f642 \ue000 \U000e0001".split(" "):
        kind = unicodedata.category(c)
        want = {"Ll": "lower", "Lu": "upper"}.get(kind) or {"L": "letter", "M": "mark", "N": "digit", "S": "symbol"}.get(kind[0], "other")
        assert quality.CLASSES[table[ord(c)]] == want


def test_every_language_has_references(spark, monkeypatch):
    rng = random.Random(8)
    pools = {x: [f"{x}{w}" for w in [f"often{i}" for i in range(40)] * 15 + [f"word{i}" for i in range(400)]] for x in ("en", "de", "xx", "yy", "rare")}
    text = lambda x: ". ".join(" ".join(rng.choice(pools[x]) for _ in range(10)).capitalize() for _ in range(12)) + "."
    many = {"en": 3000, "de": 3000, "xx": 25, "yy": 24, "rare": 3}  # xx and yy: less than a 200th of the words
    rows = [(i, x, text(x)) for i, x in enumerate(x for x, k in many.items() for _ in range(k))]
    junk = [(9000, "xx", "#### $$$$ %%%% " * 40 + " ".join(map(str, range(60)))), (9001, "xx", text("en")), (9002, None, text("de"))]
    frame = spark.createDataFrame(rows + junk, "doc_id long, lang string, text string").repartition(4)
    refs = quality.references(frame)
    assert set(refs) == {"en", "de", "xx", "yy"} and refs.tail is None
    want = {r.doc_id: r for r in quality.measure(frame, refs).collect()}
    assert len(want) == len(rows + junk) and all(want[i].kept for i, _, _ in rows)
    assert not want[9000].kept and not want[9001].kept and want[9002].kept
    assert all(want[i].word_distance == 0 and want[i].char_distance > 0 for i, x, _ in rows if x == "rare")
    monkeypatch.setattr(quality, "HELD", 2)  # the others' references are joined
    split = quality.references(frame)
    assert set(split) == {"en", "de"} and {r.lang for r in split.tail.collect()} == {"xx", "yy"}
    assert {r.doc_id: r for r in quality.measure(frame, split).collect()} == want


def brute_scores(docs, counts, order, n):
    total, out = sum(c for g, c in counts.items() if len(g) == 1), {}
    for i, words in docs.items():
        s = 0.0
        for k in range(len(words)):
            weight = 1.0
            for size in range(min(order, k + 1), 0, -1):
                gram = tuple(words[k - size + 1 : k + 1])
                if counts.get(gram):
                    s += math.log(weight * counts[gram] / (total if size == 1 else counts[gram[:-1]]))
                    break
                weight *= lm_scores.BACKOFF
            else:
                s += math.log(weight / lm_scores.BACKOFF * 0.5 / total)
        out[i] = (len(words), s)
    return out


def lm_docs():
    rng = random.Random(5)
    docs = {i: [rng.choice("a b c d e f g hh ii jj".split()) for _ in range(rng.randrange(0, 60))] for i in range(60)}
    counts = Counter(tuple(w[k : k + n]) for w in docs.values() for n in (1, 2, 3) for k in range(len(w) - n + 1))
    return docs, counts


def brute_left_out(rows, order):
    """Each row scored by the counts of all others."""
    grams = lambda w: Counter(tuple(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1))
    rows = [(i, (t or "").split()) for i, t in rows]
    every = sum((grams(w) for _, w in rows), Counter())
    out = {}
    for i, words in rows:
        counts = every - grams(words)
        n, s = brute_scores({i: words}, counts, order, order)[i] if any(counts.values()) else (len(words), 0.0)
        fell = sum(not counts.get(tuple(words[max(0, k - order + 1) : k + 1])) for k in range(1, len(words)))
        unseen = sum(not counts.get((w,)) for w in words)
        out[i] = tuple(x + y for x, y in zip(out.get(i, (0, 0.0, 0, 0)), (n, s, fell, unseen), strict=True))
    return out


@pytest.mark.parametrize("slice_bytes, order", [(6 << 20, 3), (200, 3), (200, 2), (6 << 20, 4)])
def test_scores_of_a_corpus(spark, monkeypatch, slice_bytes, order):
    """Nulls, blanks, repeated and missing doc_ids, copies, a text of its own words and a long one; how the texts are sliced changes nothing."""
    monkeypatch.setattr(lm_scores, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(lm_scores, "RANGE_BYTES", 500)
    docs, _ = lm_docs()
    rows = [(i, " \n".join(w)) for i, w in docs.items()] + [(100, None), (101, " "), (102, "q r s"), (7, " ".join(docs[3])), (7, "a b"), (None, "a b c"), (None, "c d"), (103, "a b c \u00a0 " * 3000)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string")
    split = [(i, re.split("[\\t-\\r ]+", (t or "").strip("\t\n\r ")) if (t or "").strip("\t\n\r ") else []) for i, t in rows]
    want = brute_left_out([(i, " ".join(x.replace("\u00a0", "nbsp") for x in w)) for i, w in split], order)
    got = {r.doc_id: (r.n_words, r.log_score, r.n_backed_off, r.n_unseen) for r in lm_scores.score_corpus(frame, order).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i] == pytest.approx(w, abs=1e-6), i
    assert lm_scores.score_corpus(frame.limit(0)).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_scores_against_other_counts(spark, order):
    docs, _ = lm_docs()
    train = {i: w for i, w in docs.items() if i % 2}
    counts = Counter(tuple(w[k : k + n]) for w in train.values() for n in range(1, order + 1) for k in range(len(w) - n + 1))
    other = {i: [*w, "zzz"] for i, w in docs.items() if not i % 2} | {200: []}
    make = lambda d: spark.createDataFrame([(i, " ".join(w)) for i, w in d.items()], "doc_id long, text string")
    table = lm_scores.count_table(make(train), order)
    assert {tuple(r.gram.split(" ")): r["count"] for r in table.collect()} == counts
    got = {r.doc_id: (r.n_words, r.log_score) for r in lm_scores.score_against(make(other), table, order).collect()}
    want = brute_scores(other, counts, order, order)
    assert got.keys() == want.keys()
    for i, (n, s) in want.items():
        assert got[i][0] == n and got[i][1] == pytest.approx(s, abs=1e-6)


def test_one_document_alone(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm_scores.score_corpus(frame).first()
    assert (r.n_words, r.n_backed_off, r.n_unseen) == (2, 1, 2) and r.log_score == pytest.approx(2 * math.log(0.5) + math.log(0.4))


def test_coded_numbers():
    values = np.array([0, 1, 255, 256, 1 << 40, (1 << 64) - 1], np.uint64)
    assert (lm_scores.decoded(lm_scores.coded(values)) == values).all()


def rake(cells, targets, rounds=30):
    f = [{v: 1.0 for v in t} for t in targets]
    for _ in range(rounds):
        for k in range(3):
            mass = Counter()
            for key, w in cells.items():
                mass[key[k]] += w * math.prod(f[j][key[j]] for j in range(3) if j != k)
            f[k] = {v: targets[k][v] / mass[v] if mass[v] else 0.0 for v in f[k]}
    p = {key: math.prod(f[k][key[k]] for k in range(3)) for key in cells}
    return {key: x / max(p.values()) for key, x in p.items()}


@pytest.mark.parametrize("few", [4096, 0])
def test_raking_meets_targets(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW", few)
    rng = random.Random(3)
    cells = {(s, l, t): float(rng.randrange(1, 1000)) for s in "abcd" for l in "xy" for t in ("p", "q", "r") if rng.random() < 0.9}
    frame = spark.createDataFrame([(*k, w) for k, w in cells.items()], "source string, lang string, topic string, w double")
    targets = {"source": {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"p": 0.2, "q": 0.3, "r": 0.5}}
    found = mixing.factors(frame, targets)
    got = {(r.source, r.lang, r.topic): r.expected for r in found.collect()}
    assert got == pytest.approx(rake(cells, list(targets.values())), abs=1e-8)
    reached = mixing.shares(frame, found, targets).collect()
    assert {(r.dimension, r.value): r.target for r in reached} == pytest.approx({(d, v): x for d, t in targets.items() for v, x in t.items()})
    assert all(r.reached == pytest.approx(r.target, abs=1e-6) for r in reached) and sum(r.observed for r in reached) == pytest.approx(3)
    doubled = {(r.source, r.lang, r.topic): r.expected for r in mixing.factors(frame, targets, budget=2.0).collect()}
    assert sum(cells[k] * e for k, e in doubled.items()) == pytest.approx(2 * sum(cells.values()), rel=1e-6) and max(doubled.values()) > 1
    with pytest.raises(ValueError, match="nowhere"):
        mixing.factors(frame, {"source": {"a": 0.5, "nowhere": 0.5}})


def test_mixing_edges(spark):
    rows = [(i, f"word {i} " * (i % 5 + 1), "en" if i % 3 else None, f"s{i % 7}", "x", i, "r", 1) for i in range(300)]
    rows += [(300, None, "en", None, "x", 0, "", 1), (301, "", None, "s1", "x", 0, "", 1), (None, "no id", "en", "s1", "x", 0, "", 1), (5, rows[5][1], "de", "s5", "x", 0, "", 1), (5, rows[5][1], "de", "s5", "x", 0, "", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, expected string, _source int, row string, Topic int")
    got = mixing.mix_sources(frame, power=0.2, budget=0.8)
    assert got.columns == ["doc_id", "text", "lang", "source", "_source", "row", "topic", "n_tokens", "expected", "copies"]
    out = got.collect()
    given = Counter((r[0], r[1], r[2], r[3], r[5], r[6]) for r in rows)
    assert not Counter((r.doc_id, r.text, r.lang, r.source, r._source, r.row) for r in out) - given
    assert sum(r.doc_id == 5 and r.lang == "de" for r in out) in (0, 2)  # rows that repeat go or stay together
    assert 300 in {r.doc_id for r in out if r.copies == 1 and r.expected == 1.0}  # its cell has no tokens
    for r in out:
        u = int(hashlib.md5(str(r.doc_id if r.doc_id is not None else "").encode()).hexdigest()[:12], 16) / (1 << 48)
        assert r.copies == math.floor(r.expected) + (u < r.expected - math.floor(r.expected)) > 0
        assert r.n_tokens == len(regex.findall(mixing.TOKEN, r.text or ""))
    assert mixing.mix_sources(frame.limit(0)).count() == 0


def test_long_texts_count_whole(spark):
    frame = spark.createDataFrame([(1, "word, " * 200_000, "en", "a"), (2, "é1 " * 10, "en", "a")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.n_tokens for r in mixing.mix_sources(frame, power=1.0).collect()}
    assert got == {1: 400_000, 2: 20}


@pytest.mark.parametrize("few", [4096, 50])
@pytest.mark.parametrize("sources", [100, 1000])
def test_no_source_is_lost(spark, monkeypatch, sources, few):
    """Equal sources with equal targets: every row stays, in one row of cells and by joins."""
    monkeypatch.setattr(mixing, "FEW", few)
    rows = [(i, "a b c", "en", f"s{i % sources}") for i in range(2 * sources)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = mixing.mix_sources(frame, {"source": {f"s{k}": 1 / sources for k in range(sources)}})
    assert kept.count() == len(rows)


def test_mixing_by_joins_equals_sql(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", 0)
    rows = [(i, f"word {i} " * (i % 70 % 9 + 1) + "| " * (i % 2), ("en", "de", None)[i % 3], f"s{i % 70}" if i % 70 else None) for i in range(1400)]  # 70 sources
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.expected for r in mixing.mix_sources(frame, power=0.5).collect()}
    con = duckdb.connect()
    con.register("documents", frame.toArrow())
    want = {i: p for i, p in con.sql(f"SELECT doc_id, expected FROM ({mixing.weights_sql(power=0.5)})").fetchall()}
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=2e-9)


def test_tokens_and_topics_can_be_given(spark):
    docs = spark.createDataFrame([(i, "a b c", "en", f"s{i % 4}", f"t{i % 3}", i % 5) for i in range(120)], "doc_id long, text string, lang string, source string, t string, n int")
    kept = mixing.mix_sources(docs, topic=F.col("t"), tokens=F.col("n"), power=1.0).collect()
    assert len(kept) == 120 and all(r.topic == r.t and r.n_tokens == r.n for r in kept)


def test_mixing_is_native(spark):
    frame = spark.createDataFrame([(1, "a b", "en", "s")], "doc_id long, text string, lang string, source string")
    plan = mixing.mix_sources(frame)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    frame = entry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted((tuple(r) for r in frame.select(*columns).collect()), key=key) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({entry.ORACLE_SQL[name]})").fetchall(), key=key)
