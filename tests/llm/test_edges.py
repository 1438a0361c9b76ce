"""Nulls, empty and long texts, ties, repeated rows, empty tables, and columns that clash, for every operator."""

import pytest
from pyspark.sql import functions as F

import brute
from tessel.llm import chat, decontaminate, exact_dedup, html_extract, line_dedup, mixing, ngram_join, quality, token_counts, wavelet
from tessel.llm.tokens import VOCABULARY, encoding

SCHEMA = "doc_id bigint, text string, source string, row string, KEY string, c0 int, tokens int"
SENTENCE = "the quick brown fox jumps over the lazy dog and then it runs far away from the old grey wolf that lives near here. "
LONG = " ".join(f"word{i % 997} and{i} the" for i in range(60_000))
ROWS = [
    (1, SENTENCE * 2 + "one more.", "a", "r", "k", 0, 5),
    (2, SENTENCE * 2 + "one more.", "a", "r", "k", 0, 5),
    (2, SENTENCE * 2 + "one more.", "a", "r", "k", 0, 5),
    (3, "  " + SENTENCE * 2 + " one \n more. ", None, None, None, None, None),
    (None, SENTENCE * 2 + "one more.", "b", "r", "k", 1, 6),
    (4, None, "a", None, None, None, None),
    (None, None, None, None, None, None, None),
    (5, "", "b", "", "", 0, 0),
    (6, " \n\t ", "b", "", "", 0, 0),
    (7, LONG, "b", "x", "y", 2, 9),
    (8, "Straße ﬁ   é \U0001f600 　 İ <|im_end|> \x00 x", "c", "", "", 0, 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_exact_dedup(docs, none):
    out = exact_dedup.dedup_exact(docs)
    assert out.columns == docs.columns
    # Rows of null text stay; empty and blank are one; white space aside, 1, 2, 3 and the one without identifier are one.
    assert listed(out, "doc_id") == sorted([(1,), (4,), (None,), (5,), (7,), (8,)], key=repr)
    assert exact_dedup.dedup_exact(none).count() == 0
    assert exact_dedup.dedup_exact(docs.where("text IS NULL")).count() == 2


def test_mixing(docs, none, spark):
    out = mixing.mix_sources(docs, {"a": 2.0, "c": 0.0}, 1.0)
    assert out.columns == [*docs.columns, "virtual_time"]
    assert listed(out, "doc_id") == sorted([(r[0],) for r in ROWS if r[2] != "c"], key=repr)
    assert mixing.mix_sources(none, {}, 0.5).count() == 0
    assert mixing.mix_sources(docs.where("text IS NULL"), {}, 0.5).count() == 2
    # Two rows alike in all that orders them stay or go together.
    twice = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s")], "doc_id bigint, text string, source string")
    assert mixing.mix_sources(twice, {}, 0.5).count() == 0 and mixing.mix_sources(twice, {}, 1.0).count() == 2
    clash = docs.withColumn("virtual_time", F.lit("mine"))
    assert dict(mixing.mix_sources(clash, {}, 1.0).dtypes)["virtual_time"] == "double"


@pytest.mark.parametrize("share", [0.1, 0.35, 0.8])
def test_mixing_brute(spark, share):
    rows = [(i, "w " * (i * 37 % 23 + 1), f"s{i % 5 if i % 3 else 0}") for i in range(400)]
    weights = {"s0": 0.5, "s1": 3.0, "s2": 0.0}
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), weights, share)
    assert [r.doc_id for r in out.collect()] == brute.mixed(rows, weights, share)


def test_token_counts(docs, none):
    encoder = encoding(VOCABULARY)
    want = sorted(((i, len(encoder.encode_ordinary(t)) if t else 0) for i, t, *_ in ROWS), key=repr)
    for head in (0, 3, 1 << 18):
        assert listed(token_counts.token_counts(docs, head=head), "doc_id", "n_tokens") == want
    assert token_counts.token_counts(none).count() == 0


def test_wavelet_shards(docs, none):
    encoder = encoding(VOCABULARY)
    for most in (50, 1 << 22):
        got = []
        for r in wavelet.wavelet_shards(docs, shard_tokens=most).collect():
            ids = wavelet.WaveletMatrix(r.file).all().tolist()
            edges = [*r.starts, r.n_tokens]
            assert len(ids) == r.n_tokens and r.n_docs == len(r.doc_ids)
            got += [(d, tuple(ids[a:b])) for d, a, b in zip(r.doc_ids, edges, edges[1:])]
        assert sorted(got, key=repr) == sorted(((i, (*encoder.encode_ordinary(t), 50256)) for i, t, *_ in ROWS if t is not None), key=repr)
    assert wavelet.wavelet_shards(none).count() == 0


def test_line_dedup(docs, none):
    out = line_dedup.dedup_units(docs)
    assert out.columns == [*docs.columns, "removed"]
    for r in out.collect():
        original = next(t for i, t, *_ in ROWS if i == r.doc_id and (t is None) == (r.text is None) and (r.doc_id is not None or t is None or r.text is not None))
        if r.text is None:
            assert r.removed == []
        else:
            kept, at = "", 0
            for s in r.removed:
                kept, at = kept + original[at : s.start], s.end
            assert kept + original[at:] == r.text
    texts = {r.doc_id: r.text for r in out.where("doc_id IS NOT NULL").collect()}
    assert texts[1] == SENTENCE + "one more." and texts[2] == "" and texts[5] == "" and texts[4] is None and texts[7] == LONG
    assert line_dedup.dedup_units(none).count() == 0
    for unit in ("line", "paragraph"):
        assert line_dedup.dedup_units(docs, unit=unit, min_words=5).count() == len(ROWS)


def test_short_lines_and_paragraphs(spark):
    rows = [(1, "Read more!\nFirst text.\n\nread  more\n"), (2, "READ MORE\n...\nSecond text.\n\n--\n"), (3, "Second text, read more"), (4, "Two lines\nof a paragraph\n\nown"), (5, "else\n\nTwo lines\nof a paragraph")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: (r.text, [(s.start, s.end) for s in r.removed]) for r in line_dedup.dedup_units(df).collect()}
    assert out[1] == ("Read more!\nFirst text.\n\n", [(24, 35)]) and out[2] == ("Second text.\n\n--\n", [(0, 14)]) and out[3] == (rows[2][1], [])
    assert out[4][1] == [] and out[5] == ("else\n\n", [(6, 30)])
    out = {r.doc_id: r.text for r in line_dedup.dedup_units(df, unit="paragraph").collect()}
    assert out[1] == "Read more!\nFirst text.\n\nread  more\n" and out[2] == "Second text.\n\n--\n" and out[5] == "else\n\n"


def test_passage_inside_lines(spark):
    passage = " ".join(f"Sentence number {i} has its own seven words." for i in range(8))
    rows = [(i, f"Own beginning {i} of this text {passage} and own ending {i} of it.") for i in range(4)] + [(9, "A clean text that nobody shares. With two sentences.")]
    out = {r.doc_id: r.text for r in line_dedup.dedup_units(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[0] == rows[0][1] and out[9] == rows[4][1]
    assert all("number 1 has" not in out[i] and "number 7 has" not in out[i] and f"ending {i}" in out[i] for i in (1, 2, 3))


def test_ngram_join(docs, none):
    out = ngram_join.near_groups(docs)
    assert out.columns == ["doc_id", "class_id", "n_links"]
    assert listed(out, *out.columns) == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 0), (8, 8, 0)]
    assert ngram_join.near_groups(none).count() == 0
    assert {(r.doc_a, r.doc_b): r.jaccard for r in ngram_join.all_pairs(docs).collect()} == {(1, 2): 1.0, (1, 3): 1.0, (2, 3): 1.0}
    assert ngram_join.all_pairs(none).count() == 0
    for bad in (0, -1, 1.5):
        with pytest.raises(ValueError):
            ngram_join.near_groups(docs, threshold=bad)
    kept = ngram_join.dedup_near(docs)
    assert kept.columns == docs.columns
    assert listed(kept, "doc_id") == sorted([(1,), (None,), (4,), (None,), (5,), (6,), (7,), (8,)], key=repr)


def test_html(spark):
    rows = [(1, "u", None, "x"), (2, "u", "", "y"), (3, None, "<p>" + "the cat and the dog are in the house of a man. " * 9 + "</p><p>short</p><a href='/'>home</a>", "z"), (4, "u", "<p" + "<" * 5000 + "'\"" * 5000, "w"), (5, "u", "<div>" * 20000 + "the end of it", "v")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    out = {r.page_id: r for r in html_extract.extract_text(df).collect()}
    assert html_extract.extract_text(df).columns == ["page_id", "url", "text", "n_blocks", "n_kept"]
    assert out[1].text is None and out[2].text == "" and out[3].n_kept == 1 and "home" not in out[3].text and len(out) == 5
    assert html_extract.extract_text(df.where("false")).count() == 0
    assert html_extract.extract_text(df.select("html")).count() == 5


def test_decontamination(docs, none, spark):
    bench = spark.createDataFrame([(1, SENTENCE, "x"), (1, SENTENCE, "x"), (2, None, "y"), (3, "short", "z"), (None, "no such text is to be found anywhere in these documents at all", "w")], "item_id bigint, text string, row string")
    out = decontaminate.contaminated(docs, bench)
    assert out.columns == ["doc_id", "item_id", "start", "end", "edits", "segments"]
    hits = [r for r in out.collect()]
    assert sorted(((r.doc_id, r.item_id) for r in hits), key=repr) == sorted([(i, 1) for i in (1, 2, 2, 3, None) for _ in range(2)], key=repr)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and listed(kept, "doc_id") == sorted([(4,), (None,), (5,), (6,), (7,), (8,)], key=repr)
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0 and decontaminate.decontaminate(docs, bench.where("false")).count() == len(ROWS)


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (3, 0, 0), (None, 1, 0), (7, 0, 1), (8, None, None), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    out = quality.filter_quality(docs, labels)
    assert out.columns == [*docs.columns, "quality_score", "quality_passage"]
    nobody = quality.score_quality(docs.withColumn("quality_score", F.lit("mine")), None)
    got = [(r.doc_id, r.quality_score, r.quality_passage) for r in nobody.collect()]
    assert len(got) == len(ROWS) and {s for _, s, _ in got} == {0.0, 1.0} and all(s == 0 for i, s, _ in got if i in (4, 5, 6))
    assert quality.filter_quality(none, labels).count() == 0
    assert quality.filter_quality(docs, labels.where("false")).count() == sum(bool(t and t.strip()) for _, t, *_ in ROWS)


def test_chat(spark):
    schema = "tree bigint, id bigint, parent bigint, role string, text string, score double, row string"
    rows = [(1, 1, None, "user", "hi", 1.0, ""), (1, 2, 1, "assistant", "<|im_end|>", 2.0, ""), (1, 3, 1, "assistant", None, 2.0, ""), (1, 3, 1, "assistant", None, 2.0, ""), (1, 4, 3, None, "x", None, ""), (1, 7, 8, "user", "cycle", 9.0, ""), (1, 8, 7, "user", "cycle", 9.0, ""), (2, 1, 99, "user", "lost parent", 1.0, ""), (None, 1, None, "user", "no tree", 1.0, ""), (3, None, None, "user", "no id", 1.0, "")]
    df = spark.createDataFrame(rows, schema)
    out = {(r.tree, r.root, r.leaf): r for r in chat.format_trees(df).collect()}
    assert set(out) == {(1, 1, 2), (2, 1, 1)}
    assert out[1, 1, 2].conversation == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n<\\|im_end|><|im_end|>\n"
    both = {(r.leaf, r["rank"], r.n_turns) for r in chat.format_trees(df, 2).where("tree = 1").collect()}
    assert both == {(2, 1, 2), (4, 2, 3)}
    assert chat.format_trees(df.where("false")).count() == 0
    clash = df.select("*", F.lit("other").alias("ID"), F.lit(0).alias("Tree"))
    assert {(r.tree, r.root, r.leaf) for r in chat.format_trees(clash).collect()} == set(out)


def test_messages_of(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, TEXT int, id int"
    rows = [(1, 0, "user", "hi"), (1, 5, "assistant", "short"), (2, None, "user", "hi"), (2, 1, "assistant", "a longer reply"), (2, 1, "assistant", "a longer reply"), (2, 2, "user", "thanks"), (2, 2, "user", None), (3, 0, "user", "HI"), (None, 1, "user", "y"), (4, 0, None, "")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], schema)
    out = chat.messages_of(df)
    assert out.count() == 8 and out.select("tree", "id").distinct().count() == 7  # two of "hi" are one message
    got = {(r.n_turns, r.score, r.conversation.replace("<|im_start|>", "[").replace("<|im_end|>\n", "]")) for r in chat.format_trees(out, 9).collect()}
    hi = "[user\nhi]"
    assert got == {(2, 2.0, hi + "[assistant\nshort]"), (3, 5.0, hi + "[assistant\na longer reply][user\nthanks]"), (3, 4.0, hi + "[assistant\na longer reply][user\n]"), (1, 1.0, "[user\nHI]"), (1, 0.0, "[user\n]")}
    best = {r.conversation.count("im_start") for r in chat.format_trees(out).where("score > 1").collect()}
    assert best == {3}  # the better of the branches that begin with "hi"
    assert chat.messages_of(df.where("false")).count() == 0
