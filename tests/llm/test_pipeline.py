"""The pipeline's stages one by one on the small documents, and its packed rows."""

import collections

import brute
import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def outputs(spark, sf_dir, tmp_path_factory):
    docs, found = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    found.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        before, docs = docs.columns, spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before
        found.append(docs.collect())
    return found


def test_quality_keeps_what_passes(outputs):
    before, after = outputs[0], {r["doc_id"]: r for r in outputs[1]}
    for r in before:
        n, _, _, _, repeated = brute.text_measures(r["text"])
        if n < 50 or 100 * repeated > 50 * n:
            assert r["doc_id"] not in after
    assert len(after) > 0.8 * len(before)


def test_one_of_each_group_stays(outputs):
    """The stage keeps the smallest id of every component that a plain version of the operator finds."""
    want = brute.simhash([(r["doc_id"], r["text"]) for r in outputs[1]])
    assert {r["doc_id"] for r in outputs[2]} == {c for _, c in want.values()}
    assert len(outputs[2]) == len({c for _, c in want.values()}) < len(outputs[1])


def test_passages_go(outputs):
    want = brute.substring([(r["doc_id"], r["text"]) for r in outputs[2]], 50)
    left = {i: n - gone for i, (n, gone, _) in want.items() if n > gone}
    assert {r["doc_id"]: len(r["text"].encode().split()) for r in outputs[3]} == left


def test_mix_and_packing_are_whole(outputs):
    words = collections.Counter()
    for r in outputs[3]:
        words[r["source"]] += len(r["text"].encode().split())
    taken = collections.Counter()
    for r in outputs[4]:
        taken[r["source"]] += len(r["text"].encode().split())
    for source, target in brute.targets(dict(words)).items():
        assert abs(taken[source] - target) <= 0.05 * target
    import public_tokenizers

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids = tokenizer.encode_batch([r["text"] for r in outputs[4]], add_special_tokens=False)
    assert sum(r["length"] for r in outputs[5]) == sum(len(e.ids) + 1 for e in ids)


def test_planted_copies_do_not_survive(spark, sf_dir):
    """Exact copies, copies with few changed words and repeated passages next to clean documents."""
    rng = np.random.default_rng(3)
    lexicon = [f"{a}{b}" for a in ("ba", "ce", "di", "fo") for b in range(300)]

    def text(n):
        return " ".join(rng.choice(lexicon, n))

    clean = [(i, text(300)) for i in range(60)]
    exact = [(100 + i, clean[0][1]) for i in range(20)]
    near = []
    for i in range(10):
        words = clean[1][1].split()
        words[30 * (i % 9) + 5] = "changed"
        near.append((200 + i, " ".join(words)))
    passage = text(60)
    shared = [(300 + i, f"{text(120)} {passage} {text(120)}") for i in range(5)]
    rows = [(i, t, "en", "src", len(t)) for i, t in clean + exact + near + shared]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf_dir).checkpoint()
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(left) == {i for i, _ in clean + shared}
    assert all(left[i] == t for i, t in clean)
    assert sum(passage in t for t in left.values()) == 1


def test_stages_of_odd_rows(odd_docs, no_docs, sf_dir, spark):
    """Repeated rows and rows without an id or a text go through every stage; an empty table stays empty."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    long_text = " ".join(f"w{i}" for i in range(80))
    extra = spark.createDataFrame(
        [(None, long_text, None, None, None), (None, long_text, None, None, None), (None, None, None, None, None)],
        odd_docs.select(*columns).schema,
    )
    docs, none = odd_docs.select(*columns).unionByName(extra), no_docs.select(*columns)
    for name, stage in corpus_pipeline.STAGES:
        docs, none = stage(spark, docs, sf_dir).checkpoint(), stage(spark, none, sf_dir).checkpoint()
        assert none.count() == 0 and docs.columns == none.columns
        if name == "near_duplicates":
            assert docs.where(docs["text"] == long_text).count() == 1
            assert docs.count() == docs.distinct().count()


def test_a_chain_of_near_copies_is_one_group(spark, sf_dir):
    """Texts one changed word apart link along the chain, also where its ends differ in more bits."""
    rng = np.random.default_rng(12)
    lexicon = [f"{a}{b}" for a in ("ba", "ce", "di", "fo") for b in range(300)]
    words, rows = list(rng.choice(lexicon, 1500)), []
    for i in range(40):
        rows.append((100 - i, " ".join(words)))
        words[7 * i] = f"new{i}"
    want = {c for _, c in brute.simhash(rows).values()}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()}
    assert left == want and len(want) < 10


def test_extra_columns_of_any_name_stay(spark, sf_dir):
    """Names that the stages use inside do not touch a table's own columns."""
    names = ["_id", "name", "row", "spans", "n_words", "n_removed", "_size", "_copies", "component_id", "_docs", "_text"]
    columns = ["doc_id", "text", "lang", "source", "n_chars", *names]
    text = [" ".join(f"w{i}x{k}" for k in range(90)) for i in range(6)]
    rows = [(i, t, "en", "s", len(t), *(f"{n}{i}" for n in names)) for i, t in enumerate(text)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_dir).checkpoint()
        assert docs.columns == columns
    assert sorted(set(map(tuple, docs.collect()))) == sorted(rows)


def test_texts_under_one_id_are_judged_apart(spark, sf_dir):
    texts = [" ".join(f"{c}{k}" for k in range(80)) for c in "ab"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [(1, texts[0]), (1, texts[1])]
