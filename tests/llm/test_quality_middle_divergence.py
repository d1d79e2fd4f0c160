"""Compression quality, fill-in-the-middle and source divergence against plain versions."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.llm import compression_quality, fill_in_middle, source_divergence

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


TEXTS = [
    (1, prose(1, 60)), (2, prose(1, 60)), (3, None), (4, ""), (5, "  \n\t"), (6, prose(2, 3000)), (7, prose(3, 40)), (7, prose(3, 40)),
    (7, "other"), (None, prose(4, 40)), (None, None), (8, "Ein Wörtchen é <|endoftext|> 'S 12 ñ́ 🙂\nx"), (9, "a <S> b"), (10, "x" * 300_000), (11, "é" * 200_000),
    (12, " " * 200_000), (13, "<"), (14, "a<b<c> P>"),
]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", "src", "mine", "mine", 0.5, 7) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, form string, OUTPUT string, score double, n int")


def plain_middle(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return text, "plain", n, None, None
    if h[3] % 100 < 20:
        return f"<S>{suffix}<P>{prefix}<M>{middle}", "spm", n, len(prefix), len(middle)
    return f"<P>{prefix}<S>{suffix}<M>{middle}", "psm", n, len(prefix), len(middle)


def test_middles_are_moved_and_restored(docs):
    made = fill_in_middle.restore(fill_in_middle.transform(docs))
    assert sorted(made.columns) == sorted("doc_id lang source score output form n prefix_chars middle_chars restored".split())
    got = [tuple(r) for r in made.select("doc_id", "restored", "output", "form", "n", "prefix_chars", "middle_chars").collect()]
    want = [(i, t or "", *plain_middle(i, t or "")) for i, t in TEXTS]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert fill_in_middle.restore(fill_in_middle.transform(docs.limit(0))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZ<>PSMé🙂 \n", max_size=40), st.integers(0, 10**6))
def test_any_text_comes_back(text, doc_id):
    output, form, n, prefix, middle = fill_in_middle.rearrange(text.encode(), doc_id)
    assert (output.decode(), form, n, prefix, middle) == plain_middle(doc_id, text)
    assert fill_in_middle.rebuild(output, form).decode() == text


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=30), st.data())
def test_three_reversals_exchange_neighbours(raw, data):
    a, b, c = sorted(data.draw(st.tuples(*[st.integers(0, len(raw))] * 3)))
    buffer = bytearray(raw)
    fill_in_middle.rotate(buffer, a, b, c)
    assert bytes(buffer) == raw[:a] + raw[b:c] + raw[a:b] + raw[c:]


@pytest.fixture
def judged(spark):
    """Prose is good, shouting and repetition are bad; every fourth document is held out."""
    texts = [(i, prose(i, 30 + i % 90), 1) if i % 3 else (i, prose(i, 30 + i % 90).upper().replace(" ", "!! "), 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in texts], "doc_id long, text string, n_bytes double")
    labels = spark.createDataFrame([(i, q) for i, _, q in texts] + [(None, 1), (5, None), (7, 9), (9999, 0)], "doc_id long, quality int")
    return docs, labels, {i: q for i, _, q in texts}


def test_held_out_quality_and_plain_sizes(judged):
    docs, labels, truth = judged
    model = compression_quality.train_model(docs, labels, train=F.col("doc_id") % 4 != 2)
    rows = compression_quality.score_texts(docs, model).collect()
    held = [r for r in rows if r["doc_id"] % 4 == 2]
    assert sum((r["score"] >= 0.7) == (truth[r["doc_id"]] == 1) for r in held) >= 0.97 * len(held)
    sizes = {}
    for kind, (raw, trained) in model.dictionaries.items():
        primed = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
        sizes[kind] = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    text_of = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    for r in rows[:40]:
        raw = text_of[r["doc_id"]]
        good, bad = (sum(len(sizes[k].compress(raw[i : i + 2048])) for i in range(0, len(raw), 2048)) for k in (1, 0))
        want = 1 / (1 + math.exp(-(model.slope * (bad - good) / len(raw) + model.offset)))
        assert (r["n_bytes"], r["good_bytes"], r["bad_bytes"]) == (len(raw), good, bad) and abs(r["score"] - want) < 1e-12


def test_the_model_does_not_depend_on_the_layout_or_on_copies(judged):
    docs, labels, _ = judged
    whole = compression_quality.train_model(docs, labels, F.lit(True))
    dealt = compression_quality.train_model(docs.repartition(7, "text"), labels.repartition(3), F.lit(True))
    assert whole.dictionaries == dealt.dictionaries and abs(whole.slope - dealt.slope) < 1e-9 * abs(whole.slope)
    copied = docs.union(docs.filter("doc_id = 4")).union(docs.filter("doc_id = 4"))
    assert compression_quality.train_model(copied, labels, F.lit(True)).dictionaries == whole.dictionaries


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(compression_quality, "DOCUMENTS", 16)
    monkeypatch.setattr(compression_quality, "BLOCKS", 4)
    docs = spark.createDataFrame([(i, prose(i, 50)) for i in range(300)] * 2, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).union(spark.createDataFrame([(None, 1)] * 50, "doc_id long, quality int"))
    chosen = compression_quality._chosen(docs, labels, F.lit(True), "doc_id", "text", "quality")
    assert chosen.groupBy("_label").count().agg(F.max("count")).first()[0] <= 16
    assert 0 <= compression_quality.score_texts(docs, compression_quality.train_model(docs, labels, F.lit(True))).agg(F.avg("score")).first()[0] <= 1


def test_quality_of_odd_inputs(spark, docs, judged):
    good, labels, _ = judged
    model = compression_quality.train_model(good, labels, F.lit(True))
    made = compression_quality.score_texts(docs, model)
    assert made.columns == "doc_id lang source form OUTPUT n n_bytes good_bytes bad_bytes score".split()
    rows = made.collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    by_size = collections.defaultdict(set)
    for r in rows:
        by_size[r["n_bytes"], r["good_bytes"], r["bad_bytes"]].add(r["score"])
    assert all(len(s) == 1 for s in by_size.values()) and {r["n_bytes"] for r in rows if r["doc_id"] in (3, 4)} == {0}
    assert compression_quality.score_texts(docs.limit(0), model).count() == 0
    assert compression_quality.train_model(good, labels.limit(0), F.lit(True)) is None
    assert compression_quality.train_model(good.limit(0), labels, F.lit(True)) is None
    assert compression_quality.train_model(good, labels.filter("quality = 1"), F.lit(True)) is None
    assert {r["score"] for r in compression_quality.score_texts(docs, None).collect()} == {0.5}
    one_each = labels.filter("doc_id IN (1, 3)")
    tiny = compression_quality.train_model(good, one_each, F.lit(True))
    assert all(0 <= r["score"] <= 1 for r in compression_quality.score_texts(good, tiny).collect())


def plain_audit(rows, ranks=200):
    """rows of (lang, source, text)."""
    texts = [(a or "", b or "", c or "") for a, b, c in rows]
    count, docs = collections.Counter(), collections.Counter()
    for lang, source, text in texts:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        for t in terms:
            count[lang, source, t] += 1
        for t in set(terms):
            docs[lang, t] += 1
    out = []
    groups = sorted({(a, b) for a, b, _ in texts})
    for lang in {a for a, _ in groups}:
        kept = sorted(t for (a, t), n in docs.items() if a == lang and n >= 3)
        sources = [b for a, b in groups if a == lang]

        def chances(of, kept=kept, lang=lang):
            n = [sum(count[lang, s, t] for s in of) for t in kept]
            return [1 + 10**9 * (c + 1) // (sum(n) + len(kept)) for c in n]

        p, q = {s: chances([s]) for s in sources}, chances(sources)
        for s in sources:
            pairs = [(sum((a - b) ** 2 // b for a, b in zip(p[s], p[o])), o) for o in sources if o != s]
            terms = [((a - b) ** 2 // b, t) for t, a, b in zip(kept, p[s], q) if count[lang, s, t] and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, t, v, i + 1) for i, (v, t) in enumerate(found[:most])]
    return sorted(out)


def audited(docs, **kw):
    return sorted(tuple(r) for r in source_divergence.audit(docs, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


AUDIT = "lang string, source string, text string, doc_id long, term string, n long"


def test_divergence_equals_the_plain_sum(spark):
    r = np.random.default_rng(5)
    rows = [
        (["en", "de", None][r.integers(3)], [f"s{k}" for k in range(9)][min(int(r.exponential(2)), 8)],
         " ".join(w if r.random() < 0.6 else [w.upper() + ",", f"({w})", f"{w}-{w}", f"1{w}2", w + "é"][r.integers(5)] for w in r.choice(WORDS, r.integers(0, 40))))
        for _ in range(250)
    ]
    rows += [(None, None, None), ("fr", "alone", "un deux"), ("xx", "a", "1 2"), ("xx", "b", ""), ("en", "s0", "alpha\x0balpha\x0calpha beta x " + "w" * 200_000)]
    rows += [("it", "z", "solo")] * 3 + [("it", "é", "solo solo")] + [("it", "y", None)]
    rows += [("pt", s, t) for s, t in (("a", "rare"), ("a", "rare,"), ("b", "rare."), ("b", "two two"), ("a", "two,"))]
    docs = spark.createDataFrame([(*x, 1, "mine", 3) for x in rows], AUDIT).repartition(5)
    want = plain_audit(rows)
    assert audited(docs) == want
    assert audited(docs, tile=2, block_terms=7) == want
    small = [tuple(r) for r in source_divergence.term_counts(docs, slice_bytes=300).select("lang", "source", "term", "n").collect()]
    assert sorted(small) == sorted(tuple(r) for r in source_divergence.term_counts(docs).select("lang", "source", "term", "n").collect())
    assert audited(docs, ranks=3) == plain_audit(rows, 3)
    assert audited(docs.limit(0)) == []


def test_probabilities_beyond_64_bits_are_exact():
    counts, totals = np.array([[0, 10**13, 5 * 10**12]]), np.array([15 * 10**12])
    assert source_divergence.chances(counts, totals, 3).tolist() == [[1 + 10**9 * (c + 1) // (15 * 10**12 + 3) for c in counts[0].tolist()]]


def test_every_kept_term_counts_all_its_documents(spark):
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a, b in itertools.product(range(10), range(10))]
    rows = [("en", f"s{i % 2}", words[j]) for j in range(100) for i in range(j % 5)]
    got = source_divergence.term_counts(spark.createDataFrame([(*x, 0, "", 0) for x in rows], AUDIT)).groupBy("term").agg(F.sum("n").alias("n")).collect()
    assert {r["term"]: r["n"] for r in got} == {w: j % 5 for j, w in enumerate(words) if j % 5 >= 3}


def test_sql_and_numpy_probabilities_agree_beyond_64_bits(spark):
    counts = [0, 7, 9 * 10**9 - 1, 9 * 10**9, 10**13, 9 * 10**14]
    df = spark.createDataFrame([(c, 10**15, 12345) for c in counts], "n long, total long, terms long")
    got = [r["p"] for r in df.orderBy("n").selectExpr(f"{source_divergence.chance('n', 'total', 'terms')} AS p").collect()]
    assert got == [1 + 10**9 * (c + 1) // (10**15 + 12345) for c in counts]


def test_an_audit_joins_no_chunks_and_leaves_no_shuffle_files(spark, monkeypatch):
    plans, write = {}, source_divergence.materialise

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, label)

    def shuffled():
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    monkeypatch.setattr(source_divergence, "materialise", noted)
    docs = spark.createDataFrame([("a-b cat cat", "en", s) for s in "xyz"] + [("dog, dog", "en", "x")] * 3, "text string, lang string, source string")
    before, setting = shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    source_divergence.audit(docs)
    assert not shuffled() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert "Join" not in plans["chunk-terms"]
    got = {(r["source"], r["term"]): (r["n"], r["m"]) for r in source_divergence.term_counts(docs).collect()}
    assert got == {(s, t): (n, 3 * n) for s in "xyz" for t, n in (("a", 1), ("b", 1), ("cat", 2))} | {("x", "dog"): (6, 6)}
