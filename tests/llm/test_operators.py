"""The training-data operators against plain versions, with nulls, empty and long texts, ties, repeats and empty tables."""

import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import (
    chat, components, decontaminate, jaccard_join, language_id, line_dedup, lm_scoring, packing, quality, token_counts, warc,
)
from tablewright.session import materialise

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


TEXTS = [
    (1, prose(1, 60)), (2, prose(1, 60)), (3, None), (4, ""), (5, "  \n\t"), (6, prose(2, 3000)), (7, prose(1, 58) + " new end"),
    (7, prose(3, 40)), (None, prose(4, 40)), (8, "Ein Wörtchen é <|endoftext|> 'S 12 ñ́"), (9, "x"),
]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", "src", 0, "extra") for i, t in TEXTS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, word string"
    )


@pytest.fixture
def none(docs):
    return docs.limit(0)


def key(r):
    return repr(r)


def test_token_counts_equal_the_library(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    got = sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, path, 50).collect())
    want = sorted((len((t or "").encode()), n, n > 50) for _, t in TEXTS for n in [len(plain.encode(t or "", add_special_tokens=False).ids)])
    assert got == want
    assert token_counts.token_counts(none, path, 50).count() == 0


def test_rank_file_gives_the_ids_of_the_json_vocabulary():
    from tokenizers import Tokenizer

    plain, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    points = [c for c in range(0x30000) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} .{chr(c)}." for c in points]
    for text, found in zip(texts, plain.encode_batch(texts, add_special_tokens=False)):
        assert fast.encode(text, allowed_special=set(fast.special_tokens_set)) == found.ids


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "x" + " " * 1_000_000 + "y", "a" * 1_000_000])
def test_runs_of_one_character_give_the_ids_of_the_json_vocabulary(spark, text):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), 2, 1024).orderBy("piece").collect()
    assert b"".join(r["ids"] for r in rows) == np.array([*plain, 2], "<u4").tobytes()


def test_packing_is_best_fit_decreasing_and_gapless(docs, none):
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), 2, 64)
    rows = packing.pack(pieces, 64).collect()
    bins = collections.defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
    open_bins = []  # one piece at a time
    for n in sorted((r["length"] for r in rows), reverse=True):
        fits = [b for b in open_bins if b >= n]
        room = min(fits) if fits else 64
        if fits:
            open_bins.remove(room)
        open_bins.append(room - n)
    assert len(bins) == len(open_bins)
    assert sum(1 for r in rows if r["length"] < 64 and r["piece"] > 0) == 0
    assert packing.sequences(packing.pack(pieces, 64)).count() == len(bins)
    assert packing.pack(packing.token_pieces(none, public_tokenizers.path("byte_bpe_50k.tiktoken"), 2, 64), 64).count() == 0


def test_suffix_tree_counts_and_beats_the_base(spark, docs, none):
    got = lm_scoring.score_texts(docs, F.lit(True)).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = collections.Counter(w for _, t in TEXTS for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((len(tokens(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for _, t in TEXTS)
    assert sorted((r["n_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["n_known"] == r["n_tokens"] and r["score"] < 0 for r in got)
    unseen = lm_scoring.score_texts(docs, F.lit(False)).collect()
    assert {(r["n_known"], r["train_tokens"], r["score"]) for r in unseen} == {(0, 0, 0.0)}
    assert lm_scoring.score_texts(none, F.lit(True)).count() == 0
    order = "one two three four five six seven eight nine ten".split() * 30
    loop = spark.createDataFrame([(1, " ".join(order)), (2, " ".join(order[:200]))], "doc_id long, text string")
    for r in lm_scoring.score_texts(loop, F.col("doc_id") == 1).collect():
        assert r["score"] > r["base_score"] / 3  # each word follows from the one before


def plain_tree_scores(made, learnt):
    """Scores by a suffix tree in dictionaries: every context of up to three words, the divergence test, the longest suffix."""
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    after = collections.defaultdict(collections.Counter)
    for t in (tokens(t) for i, t in made if learnt(i)):
        for i, w in enumerate(t):
            for back in range(min(i, lm_scoring.DEPTH) + 1):
                after[tuple(t[i - back : i])][w] += 1
    c = after[()]
    n, once = sum(c.values()), sum(x == 1 for x in c.values())
    freed = (once + 1) / (len(c) + 2)

    def chance(context, w):  # in the tree of all candidates
        if not context:
            return (c[w] - freed if c[w] else freed * len(c)) / n
        here = after[context]
        total = sum(here.values())
        if here[w]:
            return (here[w] - 0.5) / total
        spare = max(1 - sum(chance(context[1:], x) for x in here if here[x]), 1e-12)
        return 0.5 * len(+here) / total / spare * chance(context[1:], w)

    kept = {()}
    for context in list(after):
        here = after[context]
        gain = sum(x * math.log(x / sum(here.values()) / chance(context[1:], w)) for w, x in here.items()) if context else 0
        if context and gain >= lm_scoring.GAIN * (len(here) + 1):
            kept |= {context[i:] for i in range(len(context))}
    out = []
    for i, t in made:
        total, t = 0.0, tokens(t)
        for at, w in enumerate(t):
            context = next(x for back in range(min(at, lm_scoring.DEPTH), -1, -1) for x in [tuple(t[at - back : at])] if x in kept)
            total += math.log10(chance(context, w))
        out.append((repr(i), len(t), round(total, 6)))
    return sorted(out), kept


@pytest.mark.parametrize("block_bytes", [1 << 24, 30_000])
def test_suffix_tree_holds_what_is_rare(spark, block_bytes):
    r = np.random.default_rng(5)
    lines = [prose(100 + i, 9) for i in range(12)]
    made = [(i, "\n".join(r.choice(lines, 4)) + f" only{i} " + prose(i, 25)) for i in range(40)]
    made += TEXTS + [(50, f"{prose(1, 20)} only3 rare once"), (51, "only3 rare once"), (52, "rare once here"), (53, "a " * 300), (54, "a a b a a c")]
    # 300,000 other tokens put each of the words above below a share of one in 100,000
    made += [(1000 + i, f"w{i} " * 10_000) for i in range(30)]
    learnt = lambda i: i is not None and i % 3 != 1
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = lm_scoring.score_texts(docs, F.col("doc_id") % 3 != 1, block_bytes=block_bytes).collect()
    want, kept = plain_tree_scores(made, learnt)
    assert {len(k) for k in kept} == {0, 1, 2, 3}
    assert sorted((repr(x["doc_id"]), x["n_tokens"], round(x["score"], 6)) for x in got) == want


def test_suffix_tree_deals_positions_once_below_a_trunk_of_frequent_words(spark, monkeypatch):
    r = np.random.default_rng(9)
    often, seldom = [f"o{i}" for i in range(4)], [f"s{i}" for i in range(60)]
    made = [(i, " ".join(r.choice(often if r.random() < 0.5 else seldom) for _ in range(60))) for i in range(60)]
    made += [(100 + i, "o0 o1 o1 o2 o3 o2 " * 5 + " ".join(r.choice(often, 20))) for i in range(30)]
    made += [(200 + i, " ".join([*r.choice(seldom, 6), "o1 o2 o3 s1 o0 o0 o0", *r.choice(often, 6)] * 3)) for i in range(30)]
    made += [(300, None), (301, ""), (302, "x " * 50), (303, "o1"), (304, "new o1 new o1 o2 new o1 o2 o3 new")]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    written = []
    monkeypatch.setattr(lm_scoring, "materialise", lambda df, label: (written.append(label), materialise(df, label))[1])
    want, kept = plain_tree_scores(made, lambda i: i % 3 != 1)
    assert any(len(k) == 3 and set(k) <= {b"o0", b"o1", b"o2", b"o3"} for k in kept)
    for block_bytes in (1 << 10, 1 << 20):  # with the first, the o words are frequent; with the other, none
        written.clear()
        got = lm_scoring.score_texts(docs, F.col("doc_id") % 3 != 1, block_bytes=block_bytes).collect()
        assert sorted((repr(x["doc_id"]), x["n_tokens"], round(x["score"], 6)) for x in got) == want
        assert written.count("lm-round") == 2 + lm_scoring.PARTS  # the trunk's counts, the subtrees with its tests, its longer contexts


def test_packed_numbers_and_hashes_come_back():
    for top in (0, 1, 255, 256, 1 << 40, (1 << 63) - 1):
        values = np.array([0, top, top // 2, top], np.int64)
        assert lm_scoring.unpacked(lm_scoring.packed(values)).tolist() == values.tolist()
    assert len(lm_scoring.unpacked(lm_scoring.packed(np.zeros(0, np.int64)))) == 0
    keys = np.array([0, 1, 1 << 63, (1 << 64) - 1], np.uint64)
    assert lm_scoring.unpacked(lm_scoring.packed(np.diff(keys, prepend=np.uint64(0)))).view(np.uint64).cumsum().tolist() == keys.tolist()
    assert len(set(lm_scoring.hashes([b"x", b"y", b"", b"\n"]).tolist())) == 4


def test_language_models_tell_languages_apart(spark, none):
    rows = [(i, lang, " ".join(np.random.default_rng(i).choice(words, 30))) for i in range(80)
            for lang, words in (("aa", ["banana", "panama", "cabana"]), ("oo", ["robot", "forgot", "bottom"]))]
    texts = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.train_model(texts, F.col("doc_id") < 60)
    found = language_id.identify(texts.filter("doc_id >= 60"), model).collect()
    assert all(r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1 for r in found)
    odd = spark.createDataFrame([(1, None), (2, "12 --"), (3, "zzz qqq"), (3, "zzz qqq")], "doc_id long, text string")
    got = {(r["doc_id"], r["lang_pred"] == "und", r["rejected"]) for r in language_id.identify(odd, model).collect()}
    assert got == {(1, True, True), (2, True, True), (3, False, True)}
    assert language_id.train_model(none, F.lit(True)) is None
    assert {r["lang_pred"] for r in language_id.identify(odd, None).collect()} == {"und"}


def test_language_sample_is_bounded_and_keeps_rare_languages(spark):
    rows = [(None, "aa", prose(i, 8)) for i in range(300)] + [(1, "aa", prose(900 + i, 8)) for i in range(50)] + [(i, "aa", prose(i, 8)) for i in range(2, 40)]
    rows += [(i, f"x{i}", f"{chr(97 + i % 26)}{chr(97 + i // 26)}" * 9) for i in range(1000, 1030)]  # a document each
    rows += [(2000, "one letter", "b b b"), (2001, "none", "12 --")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    sample = language_id._sample(docs, "doc_id", "text", "lang", F.lit(True))
    assert sample.groupBy("lang", "slot").count().agg(F.max("count")).first()[0] == 1
    assert sample.filter("lang = 'aa'").count() <= 40
    assert len(language_id.train_model(docs, F.lit(True)).languages) == 32  # all but the one without a letter


def test_quality_counts_and_verdicts(spark, docs, none):
    text = " ".join("abcdefghi") + "\n" + " ".join("abcdefghi") + "\n\n#x"
    r = quality.document_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (19, 20, 1, 1, 18)
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(TEXTS) and all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 20)
    assert any(r["kept"] for r in got) and quality.quality_rules(none).count() == 0
    with pytest.raises(ValueError):
        quality.document_counts(docs.withColumn("n_words", F.lit(1)))


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_line_dedup_against_all_pairs(spark, docs, none, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW_LINES", few)
    base = prose(9, 200)
    lines = [" ".join(base.split()[i : i + 12]) for i in range(0, 180, 3)]
    near = [x + " a b" for x in lines[:5]]
    rows = [(i // 4, []) for i in range(len(lines + near + lines[:6]))]
    by_doc = collections.defaultdict(list)
    for (doc, _), line in zip(rows, lines + near + lines[:6]):
        by_doc[doc].append(line)
    made = [(d, "\n".join(x), "extra") for d, x in by_doc.items()] + [(None, lines[0], ""), (1000, None, ""), (1001, "", "")]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.line_dedup(spark.createDataFrame(made, "doc_id long, text string, at string")).collect()}
    seen, want = [], {}
    for d in sorted(by_doc):
        kept = []
        for line in by_doc[d]:
            s = set(line.split())
            if not s or not any(100 * len(s & o) >= line_dedup.PERCENT * len(s | o) for o in seen):
                kept.append(line)
            if s:
                seen.append(s)
        want[d] = ("\n".join(kept), len(by_doc[d]) - len(kept))
    want |= {None: (lines[0], 0), 1000: (None, 0), 1001: ("", 0)}
    assert got == want
    assert line_dedup.line_dedup(none).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 5), (7, 7), (1, 9)], "u long, v long")
    assert sorted(map(tuple, components.components(edges).collect())) == [(1, 1), (3, 3), (4, 3), (5, 3), (8, 1), (9, 1)]
    assert components.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("task_edges", [1, 7, 1 << 20])
def test_components_of_chains_and_random_edges(spark, task_edges):
    r = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(40)] + [tuple(int(x) for x in 100 + r.integers(0, 90, 2)) for _ in range(70)] + [(500, i) for i in range(400, 430)]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    want = {n: x for n, x in label.items() if any(n in p and p[0] != p[1] for p in pairs)}
    got = components.components(spark.createDataFrame(pairs, "u long, v long").repartition(5), task_edges).collect()
    assert sorted(map(tuple, got)) == sorted(want.items())


@pytest.mark.parametrize("block", [1000, 4])
def test_jaccard_components_against_all_pairs(spark, docs, none, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    r = np.random.default_rng(5)
    base = prose(11, 120).split()
    made = list(TEXTS)
    for i in range(40):  # variants that form chains
        words = list(base)
        for k in r.choice(120, int(r.integers(0, 7)), replace=False):
            words[k] = f"w{r.integers(1000)}"
        made.append((100 + i, " ".join(words)))
    for i in range(30):  # one large group by a template, mostly without links: neighbours share rare passages
        own = [prose(50 + i + k, 16) for k in range(2)]
        made.append((200 + i, " ".join([prose(12, 40), *own, "x" * (i % 3)])))
    made += [(240, made[-1][1] + " tail"), (241, made[-7][1] + " tail")]
    got = sorted(map(key, map(tuple, jaccard_join.jaccard_components(spark.createDataFrame(made, "doc_id long, text string")).collect())))
    sets = []
    for _, t in made:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(made)))
    for i in range(len(made)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    want = []
    for i, (d, _) in enumerate(made):
        ids = [made[j][0] for j in range(len(made)) if label[j] == label[i] and made[j][0] is not None]
        want.append((d, len(sets[i]), min(ids) if ids else None))
    assert got == sorted(map(key, want))
    assert jaccard_join.jaccard_components(none).count() == 0


def test_decontamination_against_windows(spark, docs, none):
    items = [(1, prose(1, 30)), (2, "only four words here"), (3, None), (None, prose(2, 20)), (2, "only four words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    extra = spark.createDataFrame([(50, "see: ONLY four, words here!", "en", "s", 0, "")], docs.schema)
    got = decontaminate.contamination(docs.unionByName(extra), bench).collect()
    windows = []
    for d, t in items:
        w = [x.decode() for x in decontaminate.words_of((t or "").encode())]
        windows += [(d, w[i : i + 13]) for i in range(max(1, len(w) - 12)) if w]
    for r in got:
        w = [x.decode() for x in decontaminate.words_of((r["text"] or "").encode())]
        hit, names = set(), set()
        for d, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    names |= {str(d)} - {"None"}
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w))
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and decontaminate.contamination(kept, bench).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    small = decontaminate.contamination(docs, bench, shard_words=4).select("n_hit", "items").collect()
    assert sorted(map(key, small)) == sorted(key(x) for x in decontaminate.contamination(docs, bench).select("n_hit", "items").collect())
    assert decontaminate.decontaminate(none, bench).count() == 0


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 5.0), (1, 4, 3, "user", "a<\\|b<|im_end|>", None),
            (1, 5, 99, "user", "root too", 1.0), (2, 1, 2, "user", "loop", 1.0), (2, 2, 1, "user", "loop", 1.0), (None, 1, None, None, None, None)]
    tree = spark.createDataFrame(rows, "conv_id long, msg long, parent long, role string, text string, score double")
    read = {(r["conv_id"], r["leaf"]): [tuple(t) for t in r["turns"]] for r in chat.read_back(chat.conversations(tree)).collect()}
    assert read == {(1, 4): [("user", "q"), ("assistant", "good"), ("user", "a<\\|b<|im_end|>")], (1, 5): [("user", "root too")], (None, 1): [("", "")]}
    both = chat.read_back(chat.conversations(tree, branches=2)).filter("conv_id = 1").collect()
    assert sorted((r["leaf"], r["rank"], r["loss_text"]) for r in both) == [(2, 2, "bad"), (4, 1, "good"), (5, 1, "")]
    assert chat.conversations(tree.limit(0)).count() == 0


def test_warc_round_trip(spark):
    pages = [(1, "http://a/\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 100_000), (None, "n", "x" * 100_000), (5, "u", "x" * 100_000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    index = warc.write_archives(frame)
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"], r["html"]) for r in warc.read_records(index).collect()), key=key)
    big = "x" * 100_000
    want = [(1, 9, "revisit", 2, None), (2, 9, "response", None, "<p>é</p>"), (3, 0, "revisit", 4, None), (4, 0, "response", None, ""),
            (5, 100_000, "response", None, big), (None, 100_000, "revisit", 5, None), (5, 100_000, "response", None, big)]
    assert got == sorted(want, key=key)
    assert [r["page_id"] for r in warc.read_records(index.filter("page_id = 2")).collect()] == [2]
    assert {r["record_type"] for r in warc.write_archives(frame, least_bytes=10**6).collect()} == {"response"}
    assert warc.read_records(warc.write_archives(frame.limit(0))).count() == 0


def test_pipeline_stages_keep_columns_and_pack_what_is_left(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r[0] for r in kept.select("doc_id").collect()}
        kept = stage(spark, kept, sf).cache()
        assert kept.columns == columns, name
        assert {r[0] for r in kept.select("doc_id").collect()} <= before
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = {}
    for d, t in texts.items():
        ids = np.array([*encode.encode(t, allowed_special=set(encode.special_tokens_set)), 2], "<u4")
        for piece, (start, n) in enumerate(packing.cuts(len(ids), 1024)):
            want[d, piece] = (start, n, zlib.crc32(ids[start : start + n].tobytes()))
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert hashlib.sha256(b"").hexdigest() == decontaminate.joined_digest([])


def test_pipeline_keeps_what_line_dedup_leaves_of_a_document(spark):
    shared = " ".join(WORDS[:12])
    made = [(1, shared), (2, shared + "\nA short\nverse"), (3, shared + "\nohneleerzeichen"), (4, "tab\tbed"), (5, shared + "\n \t"), (6, "")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in made], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    want = {1: shared, 2: "A short\nverse", 3: "ohneleerzeichen", 4: "tab\tbed", 6: ""}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_pipeline_tells_rows_apart_that_share_an_id_or_have_none(spark):
    a, b, c, d, e = (" ".join(w + x for w in WORDS) for x in "abcde")
    made = [(None, a), (None, b), (None, c), (7, d), (7, e), (8, d), (9, a + " end"), (7, e), (None, " "), (None, " ")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in made], "doc_id long, text string, n_chars long")
    near = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    want = [(None, b), (None, c), (7, d), (7, e), (9, a + " end"), (None, " "), (None, " ")]
    assert near.columns == docs.columns
    assert sorted(map(key, ((r["doc_id"], r["text"]) for r in near.collect()))) == sorted(map(key, want))
    lines = [(i, t) for i, t in made if t != " "][:-1]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in lines], "doc_id long, text string, n_chars long")
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.line_stage(spark, docs, "").collect()]
    assert sorted(map(key, left)) == sorted(map(key, [(None, b), (None, c), (7, d), (7, e), (9, a + " end")]))


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_every_line_with_a_word_is_compared(spark, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW_LINES", few)
    r = np.random.default_rng(31)
    spaces = [" ", "\t", "  ", "\v", " \f", "\r"]
    lines = ["Home", "all rights reserved", "ohneleerzeichen", " \t", "", *("".join(w + r.choice(spaces) for w in r.choice(WORDS, n, replace=False)) for n in r.integers(1, 16, 40))]
    made = [(d, "\n".join(r.choice(lines, 12))) for d in range(12)]
    made += [(20, "\t".join(WORDS[:18])), (21, " ".join(WORDS[1:18])), (22, "\t".join(WORDS[:16]))]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(frame).collect()}
    seen, want = [], {}
    for d, text in made:
        kept = []
        for line in text.split("\n"):
            s = set(line.split())
            if not s or not any(100 * len(s & o) >= line_dedup.PERCENT * len(s | o) for o in seen):
                kept.append(line)
            if s:
                seen.append(s)
        want[d] = "\n".join(kept)
    assert got == want


def test_words_of_lines_are_hashed_once(spark):
    lines = spark.createDataFrame([(" b a  b\ta",)], "value string")
    keyed = line_dedup._keyed(lines, f"array_repeat(0L, {line_dedup.BUCKETS})")
    assert keyed._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") == 1
    assert len(keyed.first()["keys"]) == 3  # a, b and what the tab joins; _lines puts a space for it


def test_white_space_is_replaced_in_wanted_lines_only(spark):
    docs = spark.createDataFrame([(1, "a\tb\n\vb\fa\rc d\n\n"), (None, "x"), (2, None)], "doc_id long, text string")
    lines = line_dedup._lines(docs, "doc_id", "text")
    assert "replace(" not in lines._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["line"], r["value"]) for r in lines.collect()] == [(0, "a\tb"), (1, "\vb\fa\rc d")]
    assert [r["value"] for r in line_dedup._with_spaces(lines).collect()] == ["a b", " b a c d"]


def test_pipeline_takes_out_short_repeated_lines(spark):
    made = [(1, "Home\none"), (2, "two\nHome"), (None, "Home\nthree\tfour"), (None, "six\nHome")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in made], "doc_id long, text string, n_chars long")
    left = sorted(r["text"] for r in corpus_pipeline.line_stage(spark, docs, "").collect())
    assert left == ["Home\none", "six", "three\tfour", "two"]
