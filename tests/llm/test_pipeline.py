"""The stages of the pipeline against brute-force versions, and the whole run."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers as h  # noqa: E402

import corpus_pipeline  # noqa: E402
from lodeframe.llm import base  # noqa: E402
from lodeframe.llm.base import Kept, table  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, small):
    """name -> (rows in, rows out) as lists, and the last one's rows."""
    docs, out = table(spark, small, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, kept = docs, Kept(stage(spark, docs, small), name)
        docs = kept.df
        out[name] = (before.collect(), docs.collect())
    return out


def test_order_and_columns(stages):
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name][1][0].asDict().keys() == set(corpus_pipeline.COLUMNS)


def test_one_of_alike(stages):
    before, after = stages["near_duplicates"]
    component = h.clusters({r["doc_id"]: h.shingle_set(r["text"]) for r in before})
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, c in component.items() if i == c)


def test_contaminated_go(spark, small, stages):
    before, after = stages["decontamination"]
    items = [(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()]
    clean = [x[0] for x in h.contamination([(r["doc_id"], r["text"]) for r in before], items) if not x[5]]
    assert sorted(r["doc_id"] for r in after) == sorted(clean)


def test_marks(stages):
    from lodeframe.llm.pii import base_spans

    before, after = stages["personal_data"]
    texts = {r["doc_id"]: r["text"] for r in after}
    for r in before:
        if base_spans(r["text"]):
            assert texts[r["doc_id"]] != r["text"] and not base_spans(texts[r["doc_id"]])


def test_repeated_and_null_ids(spark, small):
    rows = [(1, "a b c d e f", "en", "s", 1)] * 3 + [(2, "A b c d e f", "en", "s", 1), (None, "a b c d e f", "en", "s", 1), (None, None, None, None, None), (4, None, "en", "s", 0), (4, "other words are in this one", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(str(r["doc_id"]) for r in corpus_pipeline.keep_one_of_alike(spark, docs, small).collect())
    assert got == ["1", "4", "4", "None"]  # the copy without an id goes, the row without words stays
    for name, stage in corpus_pipeline.STAGES:
        if name != "quality":
            assert stage(spark, docs, small).count() > 0
            assert stage(spark, docs.limit(0), small).count() == 0
    assert corpus_pipeline.keep_good(spark, docs, small).count() <= 8 and corpus_pipeline.keep_good(spark, docs.limit(0), small).count() == 0


def test_rows_of_one_id_are_judged_by_their_own_texts(spark, small):
    base, other = "some words that make up a text of their own and go on for a while", "quite different words stand here and nothing of the other is in them at all"
    rows = [(1, base), (4, base + " more"), (4, other), (None, other.upper()), (None, "one of a kind without any id")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_alike(spark, docs, small).collect()}
    assert got == {(1, base), (4, other), (None, "one of a kind without any id")}


def test_clashing_columns_and_long_texts(spark, small):
    texts = [h.sentence(__import__("random").Random(1), 60_000, 9000), "a@b.org " * 3000, "short one", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 5, "x", 2.0, True, "y") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint, node int, text_key string, score double, hit boolean, hit_id string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, small)
        assert got.columns == list(corpus_pipeline.COLUMNS) and (name == "quality" or got.count() == len(texts))
    assert corpus_pipeline.pack_sequences(spark, docs, small).select("doc_id").distinct().count() == len(texts)


def test_good_stay(spark, small, stages):
    """Exactly the rows that the network, computed here, gives 0.5 or more."""
    import pyarrow as pa

    from lodeframe.llm import quality

    before, after = stages["quality"]
    model = quality.learn(table(spark, small, "documents").select("doc_id", "text"), table(spark, small, "labels"))
    scores = model.scores(pa.array([r["text"] or "" for r in before]))
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r, s in zip(before, scores, strict=True) if s >= 0.5)


def test_packed(stages):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before, after = stages["packing"]
    h.check_packing(after, {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in before})


def test_run(spark, small, stages):
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
    before = set(base._KEPT)
    got = corpus_pipeline.run(spark, small)
    assert len(set(base._KEPT) - before) == 1  # the last stage's input, which the result still reads
    whole = lambda rows: sorted({(r["doc_id"], r["doc_tokens"]) for r in rows})
    rows = got.collect()
    assert whole(rows) == whole(stages["packing"][1]) and sum(r["length"] for r in rows) == sum(r["length"] for r in stages["packing"][1]) and len(set(map(key, rows))) == len(rows)


@pytest.fixture
def tasks(spark, monkeypatch):
    """Gets the functions that plans run in Python workers, as the plans are made."""
    taken, kind = [], type(spark.range(1))
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **b: taken.append(f) or real(self, f, *a, **b))
    return taken


def test_workers_forget_the_last_stage(spark, tasks):
    """What packing remembers for its next tasks is gone once a worker serves another stage, not before."""
    pytest.importorskip("tokenizers")
    import numpy as np
    import public_tokenizers
    import pyarrow as pa

    from lodeframe.llm import ngram_join, pack, pii, quality

    docs = spark.createDataFrame([], "id bigint, text string, tie bigint")
    pack.tokenized(docs, public_tokenizers.path("word_bpe_49k.json"), None)
    quality.score(docs, quality.Model(np.zeros(0), np.zeros(0), 0.5, None), "id")
    ngram_join.prefixes(docs.select("id", "text"), 5, np.zeros(ngram_join.COUNTERS), ngram_join.SIMILAR)
    pii.redact(docs, pii.fit({}))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words"]), pa.array([5])], ["id", "text", "tie"])
    remembered = lambda: pack.tokenizer.cache_info().currsize
    packing, *others = tasks
    assert len(others) == 3
    for other in others:
        first = list(packing(iter([batch])))
        assert remembered() == 1 and list(packing(iter([batch]))) == first and remembered() == 1
        list(other(iter([])))
        assert remembered() == 0
        assert list(packing(iter([batch]))) == first
    pack.forget()


def test_word_sums_need_little_memory(spark, tasks):
    """A task that adds up word vectors holds its sums and little more, however many words a pass has."""
    import tracemalloc

    import pyarrow as pa

    from lodeframe.llm import quality

    quality.word_vectors(spark.createDataFrame([("a b c",)], "text string"))
    texts = pa.array([" ".join(f"{i % 7}{j:x}" for j in range(2000)) for i in range(100)])
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    list(tasks[0](iter([batch])))
    tracemalloc.start()
    try:
        assert len(list(tasks[0](iter([batch])))) == quality.BLOCKS
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 5 * quality.BUCKETS * quality.WIDTH * 8


def test_packing_remembers_what_comes_again():
    """A worker that packs keeps the words that batch after batch has, not those that come once; ids are the library's."""
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    from lodeframe.llm import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    ids, library = pack.Ids(path), tokenizers.Tokenizer.from_file(path)
    for i in range(12):
        texts = [f"always there {'x' * (i % 3)}", " ".join(f"once{i}and{j}" for j in range(500)), "", "né là́ there"]
        assert [x.tolist() for x in ids.of(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert {"always", "there"} <= ids.known.keys() and len(ids.known) < 300
