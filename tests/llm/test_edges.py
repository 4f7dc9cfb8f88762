"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and extra columns with names that operators use themselves."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loamline.llm import common, decontam, exact, html, pack, pii, quality, shard, simhash, toxicity, wordpiece
from loamline.llm.queries import tokenizer

LONG = "word " * 40_000
TEXTS = [
    (1, "Alpha beta  gamma delta epsilon zeta eta theta iota kappa lambda."), (2, "Alpha beta gamma\tdelta epsilon zeta eta theta iota kappa lambda."), (2, "Alpha beta gamma\tdelta epsilon zeta eta theta iota kappa lambda."),
    (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, "x" * 120_000), (None, "a text without an id but with some words in it"), (None, None), (8, "Ünïcödé 你好 שלום + 😀"), (9, "only"), (10, "two words"),
    (11, "the quick brown fox jumps over the lazy dog and runs away from it all"), (12, "idiot"),
]
CLASHES = ["rid", "rep", "fp", "id", "key", "row", "words", "score", "kind", "h", "group", "keep_id", "seed", "at", "item_id", "shard", "spans", "root", "check", "index", "label", "held_out", "raw", "run", "n", "content", "order", "first", "component_id"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, None if i == 3 else "en", None, None if t is None else len(t)) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, i % 3 == 0 and 1 or 0, "x") for i in range(1, 13)] + [(None, 1, 1, "x"), (5, None, None, "x"), (1, 1, 0, "x"), (99, 1, 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog and runs away"), (2, None), (3, ""), (4, "short one"), (None, "the quick brown fox jumps over a lazy dog and runs")], "item_id long, text string").withColumn("doc_id", F.lit(5))


def operators(labels, benchmark):
    path = tokenizer("word_bpe_49k.json")
    return {
        "exact_groups": lambda d: exact.exact_groups(d), "near_groups": lambda d: simhash.near_groups(d), "pack": lambda d: pack.pack_documents(d, path), "quality": lambda d: quality.quality(d, labels),
        "shard": lambda d: shard.shard_documents(d, shard.even_forest(4), shard.even_forest(5)), "toxicity": lambda d: toxicity.toxicity(d, labels), "pii": lambda d: pii.find_personal_data(d),
        "tokens": lambda d: wordpiece.token_counts(d, [b" ", b"a", b"w", b"wo", b" word"]), "decontam": lambda d: decontam.contaminated(d, benchmark),
    }


@pytest.mark.parametrize("name", ["exact_groups", "near_groups", "pack", "quality", "shard", "toxicity", "pii", "tokens", "decontam"])
def test_edges(spark, docs, labels, benchmark, name):
    operator = operators(labels, benchmark)[name]
    rows = operator(docs).collect()
    if name == "pack":
        assert sorted((r.doc_id or 0) for r in rows if r.piece == 0) == sorted((i or 0) for i, _ in TEXTS)
    elif name == "decontam":
        assert {(r.doc_id, r.item_id) for r in rows} == {(11, 1), (11, None)}  # an item without an id counts, too
    else:
        assert sorted((r.doc_id or 0) for r in rows) == sorted((i or 0) for i, _ in TEXTS)
    none = operator(docs.limit(0))
    assert none.collect() == [] and none.columns == operator(docs).columns


def test_exact_rules(docs):
    rows = {(r.doc_id, r.kept): r for r in exact.exact_groups(docs).collect()}
    assert rows[1, True].group_size == 3 and rows[2, False].keep_id == 1
    assert rows[3, True].group_size == 3 and rows[4, False].keep_id == 3 and rows[None, False].keep_id == 3  # null and empty texts
    assert rows[5, True].group_size == 1  # one space is not empty


def test_exact_spills_alike(spark, docs):
    said = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert said(exact.exact_groups(docs, table_bytes=300)) == said(exact.exact_groups(docs))
    assert said(exact.exact_dedup(docs, table_bytes=300).select("doc_id", "text")) == said(exact.exact_dedup(docs).select("doc_id", "text"))
    assert exact.exact_dedup(docs).columns == docs.columns


def test_stages_keep_columns(spark, docs, tmp_path):
    for name in ("labels", "benchmark"):
        (spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int") if name == "labels" else spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog and runs away")], "item_id long, text string")).write.parquet(str(tmp_path / f"{name}.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, kept, str(tmp_path)).write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == docs.columns, name
        empty = stage(spark, kept.limit(0), str(tmp_path))
        assert empty.columns == docs.columns and empty.count() == 0, name
    ids = [r.doc_id for r in kept.collect()]
    # Copies of 1, empty texts but one (which a text of white space is a near copy of), and the benchmark's passage are gone.
    assert sorted(i for i in ids if i) == [1, 3, 6, 7, 8, 9, 10, 12] and ids.count(None) == 1
    last = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
    assert {r.doc_id for r in last} == set(ids)
    assert corpus_pipeline.STAGES[-1][1](spark, kept.limit(0), str(tmp_path)).count() == 0


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>" + "word " * 50_000), (4, "u", "<" * 50_000), (5, "u", "<a href='" * 20_000), (6, "u", "<div>" * 20_000 + "deep text of some words here that goes on for a while and then some more of it all"), (7, "u", "no tags but a good many words in this one block of text, which therefore stays as it is, whatever may come"), (7, "u", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("own"), "n_chars": F.lit(1)})
    got = html.extract(df).collect()
    assert len(got) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got if r.page_id != 7}
    assert by[1] == by[2] == "" and by[None] == ("word " * 50_000).strip() and by[6].startswith("deep")
    assert html.extract(df.limit(0)).count() == 0


def test_empty_and_odd_inputs_of_the_outputs(spark, docs, tmp_path):
    none = pack.pack_documents(docs.limit(0), tokenizer("word_bpe_49k.json"))
    assert pack.sequences(none).count() == 0
    packed = pack.pack_documents(docs, tokenizer("word_bpe_49k.json"))
    assert sum(len(r.doc_ids) for r in pack.sequences(packed).collect()) == packed.count()
    spans = "identifier string, kind int, sure boolean, kinds int, contexts array<string>"
    assert pii.learn(spark.createDataFrame([], spans)).count() == 0
    odd = [(None, None, False, 31, ["a _ b"]), ("x", None, False, 31, None), ("y", 0, True, 1, []), ("z", 0, True, 1, ["a _ b"]), ("z", 0, True, 1, ["a _ b"])]
    assert pii.learn(spark.createDataFrame(odd, spans)).count() == 0
    shard.write_shards(docs.limit(0).select("doc_id", "text"), shard.even_forest(4), str(tmp_path / "none"))
    assert spark.read.schema("doc_id long, text string").parquet(str(tmp_path / "none")).count() == 0
    shard.write_shards(docs, shard.even_forest(4), str(tmp_path / "some"))
    back = spark.read.parquet(str(tmp_path / "some"))
    assert back.count() == len(TEXTS) and back.where("doc_id is null").select("loamline_shard").distinct().count() == 1


def test_quality_without_character_counts(spark, docs, labels):
    assert quality.quality(docs.drop("n_chars"), labels).count() == len(TEXTS)


def test_texts_that_stay_need_no_exchange(spark):
    from loamline.llm import decontam, simhash

    # What goes is looked up where the wide rows lie: no step of the last plan deals texts out again.
    texts = [" ".join(f"{t}w{i}" for i in range(40)) for t in "abcd"]
    docs = spark.createDataFrame([(10 - n, x) for n, x in enumerate([*texts, texts[0], texts[1] + " more", "", None])], "doc_id long, text string")
    items = spark.createDataFrame([(1, texts[2])], "item_id long, text string")
    near, clean = simhash.near_dedup(docs), decontam.decontaminate(docs, items)
    assert {r.doc_id for r in near.collect()} == {8, 7, 6, 5, 3} and {r.doc_id for r in clean.collect()} == {10, 9, 7, 6, 5, 4, 3}
    for df in (near, clean):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_only_texts_that_meet_are_dealt_out_however_many_go(spark, monkeypatch):
    from loamline.llm import decontam, simhash
    from loamline.llm.common import marked, marks

    numbers = [0, 1, 62, 63, 64, 127, (1 << 33), (1 << 33) + 63, (7 << 33) + 64]
    rows = spark.createDataFrame([(n,) for n in numbers], "row long")
    some = [0, 63, 64, (1 << 33) + 63]
    which = marks(spark.createDataFrame([(n,) for n in some * 2], "row long"), "row", "some")
    assert {r.row for r in marked(rows, "row", which, True).collect()} == set(some)
    assert {r.row for r in marked(rows, "row", which, False).collect()} == set(numbers) - set(some)
    none = marks(rows.limit(0), "row", "none")
    assert marked(rows, "row", none, True).count() == 0 and marked(rows, "row", none, False).count() == len(numbers)

    texts = [" ".join(f"{t}w{i}" for i in range(40)) for t in "abcdef"]
    docs = spark.createDataFrame([(10 - n, x) for n, x in enumerate([*texts, texts[0], texts[1] + " more", "", None])], "doc_id long, text string")
    items = spark.createDataFrame([(1, texts[2])], "item_id long, text string")
    linked, dealt = simhash._linked, []
    monkeypatch.setattr(simhash, "_linked", lambda keys, rows, *a: ("text" in rows.columns and dealt.append(rows.count()), linked(keys, rows, *a))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if more went than may be broadcast
    try:
        near, clean = simhash.near_dedup(docs), decontam.decontaminate(docs, items)
        assert {r.doc_id for r in near.collect()} == {8, 7, 6, 5, 4, 3, 1} and {r.doc_id for r in clean.collect()} == {10, 9, 7, 6, 5, 4, 3, 2, 1}
        for df in (near, clean):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert dealt == [2]


def test_stored_frames_send_python_small_batches(spark):
    """Spark's own batches would hold 10,000 rows, 40 MB of these texts, in the JVM and in the worker of each core."""
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches)
    wide = spark.range(0, 10_000, 1, 1).select(F.lit("x" * 4000).alias("text")).mapInArrow(sizes, "n long, size long")
    found = common.stored(wide, "small").collect()
    assert sum(r.n for r in found) == 10_000 and max(r.size for r in found) <= common.BATCH_BYTES + 100_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before


def test_parts_keep_rows_and_order():
    texts = ["x" * 10, "", None, "y" * 5000, "z" * 100] * 7
    batch = pa.RecordBatch.from_pydict({"id": list(range(35)), "text": texts})
    some = list(common.parts(iter([batch, batch.slice(0, 0)]), 1000))
    assert [t for b in some for t in b.column(1).to_pylist()] == texts and [i for b in some for i in b.column(0).to_pylist()] == list(range(35))
    assert all(b.nbytes <= 1000 or b.num_rows == 1 for b in some)


class Caught(Exception):
    pass


@pytest.mark.parametrize("stage", ["pack", "near", "frequent", "toxicity", "exact"])
def test_pipeline_tasks_hold_few_texts_at_once(spark, monkeypatch, stage):
    """Of an Arrow batch with 32 MB of text, a task of the pipeline turns a small part into Python objects at a time."""

    def caught(self, f, schema):
        raise Caught(f)

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", caught)
    if stage == "near":
        monkeypatch.setattr(simhash, "frequent_shingles", lambda *_: (np.empty(0, np.uint64), np.empty(0, int)))
    run = {
        "pack": lambda: pack.token_pieces(docs, tokenizer("word_bpe_49k.json"), keep_ids=False), "near": lambda: simhash.near_dedup(docs), "frequent": lambda: simhash.frequent_shingles(docs, 5, "text"),
        "toxicity": lambda: toxicity.with_score(docs, toxicity.ToxicityModel(None, None)), "exact": lambda: exact.exact_dedup(docs),
    }
    with pytest.raises(Caught) as found:
        run[stage]()
    texts = pa.array([("x" * 60 + " ") * 130] * 4000)
    ids = [] if stage == "frequent" else [pa.array(range(4000), pa.int64())]
    batch = pa.RecordBatch.from_arrays([*ids, texts, *([texts] if stage == "toxicity" else [])], names=["doc_id", "text", "loamline_text"][1 - len(ids) :][: len(ids) + 1 + (stage == "toxicity")])
    tracemalloc.start()
    try:
        for _ in found.value.args[0](iter([batch])):
            pass
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 24 << 20
