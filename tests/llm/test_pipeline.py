"""The whole pipeline, stage by stage, against plain versions."""

import random

import brute
import corpus_pipeline
from tessel.llm import decontaminate, mixing, ngram_join, quality, wavelet
from tessel.llm.frames import written
from tessel.llm.tokens import VOCABULARY, encoding


def test_stages(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{small_dir}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, small_dir))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept.append([r.doc_id for r in docs.collect()])
    ids = sorted(i for i in labels if i in rows)
    model = quality.train([rows[i].text for i in ids], [labels[i] == (1, 0) for i in ids])
    scores, _ = quality.probabilities(model, quality.Encoder().encode([rows[i].text for i in sorted(rows)]))
    assert sorted(kept[0]) == [i for i, z in zip(sorted(rows), scores) if z >= model.threshold]
    roots = brute.groups(brute.jaccard_pairs([(i, rows[i].text) for i in kept[0]], ngram_join.THRESHOLD))
    assert sorted(kept[1]) == sorted(i for i in kept[0] if roots.get(i, i) == i)
    leaks = {i for i in kept[1] for _, t in bench if brute.fold(t) in brute.fold(rows[i].text)}
    assert leaks.isdisjoint(kept[2]) and len(kept[1]) - len(kept[2]) <= len(leaks) + 3
    order = brute.mixed([(i, rows[i].text, rows[i].source) for i in kept[2]], mixing.WEIGHTS, mixing.BUDGET_SHARE)
    assert sorted(kept[3]) == sorted(order)
    encoder = encoding(VOCABULARY)
    for shards in (stages["token-ID / binary output"](spark, docs, small_dir), corpus_pipeline.run(spark, small_dir)):
        got = {}
        for r in shards.collect():
            tokens, edges = wavelet.WaveletMatrix(r.file).all().tolist(), [*r.starts, r.n_tokens]
            got |= {d: tokens[a:b] for d, a, b in zip(r.doc_ids, edges, edges[1:])}
        assert got == {i: [*encoder.encode_ordinary(rows[i].text), 50256] for i in order}
    assert decontaminate.Q == 10


def test_stages_on_edges(spark, tmp_path):
    """Nulls, empty and repeated rows, ties, clashing columns and empty tables go through every stage."""
    rng = random.Random(2)
    words = [f"word{i}" for i in range(200)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, shared = text(40), text(80)
    rows = [(i, text(60), "en", "src0", 1, "x", 7) for i in range(20)]
    rows += [(30, shared, "en", "s", 1, "x", 7), (31, shared + " more", None, None, None, None, None), (31, shared + " more", None, None, None, None, None), (32, text(30) + " " + passage, "en", "s", 1, "x", 7)]
    rows += [(None, text(50), "en", None, 1, "x", 7), (40, None, "en", "s", 1, "x", 7), (None, None, None, None, None, None, None), (41, "", "en", "s", 0, "x", 7), (42, " \n", "en", "s", 2, "x", 7), (5, rows[5][1], "en", "src0", 1, "x", 7)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars int, TEXT string, row int"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=repr)
    good = stages["quality classifier"](spark, docs, str(tmp_path))
    assert ids(good) == sorted([*range(20), 5, 30, 31, 31, 32, None], key=repr)  # labels of one class: what has words stays
    one = stages["n-gram Jaccard join"](spark, docs, str(tmp_path))
    assert ids(one) == sorted([*range(20), 5, 30, 32, None, 40, None, 41, 42], key=repr)
    clean = stages["benchmark decontamination"](spark, docs, str(tmp_path))
    assert ids(clean) == sorted([i for i, *_ in rows if i != 32], key=repr)
    mixed = stages["mixing sources to target weights"](spark, docs, str(tmp_path))
    assert {*ids(mixed)} >= {40, 41, 42, None} and mixed.count() < len(rows)
    packed = stages["token-ID / binary output"](spark, docs, str(tmp_path)).collect()
    assert sorted((d for r in packed for d in r.doc_ids), key=repr) == sorted([r[0] for r in rows if r[1] is not None], key=repr)
    for stage in (good, one, clean, mixed):
        assert stage.columns == list(corpus_pipeline.COLUMNS)
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_of_a_large_group_are_not_sent_to_each_other(spark, monkeypatch):
    rng = random.Random(11)
    base, sent, written = [f"b{i}" for i in range(80)], [], ngram_join.written
    rows = []
    for i in range(700):
        share = rng.uniform(0.01, 0.1)
        rows.append((i, " ".join(f"x{rng.randrange(40)}" if rng.random() < share else w for w in base), "en", "src0", 1))

    def counting(df):
        out = written(df)
        if "pivot" in out.columns:
            sent.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "written", counting)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_near(spark, docs, None).collect()}
    root = brute.groups(brute.jaccard_pairs([(r[0], r[1]) for r in rows], ngram_join.THRESHOLD))
    assert kept == {i for i, *_ in rows if root.get(i, i) == i}
    assert sum(sent) < 50 * len(rows)
