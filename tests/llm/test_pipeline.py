"""The five stages against the operators' brute force."""

import re

import pytest

from tagloom.llm import piece_codec
from tests.conftest import SF01
from tests.llm.test_texts import base_spans, brute_components, brute_print, check_mix


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF01).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_are_the_five(stages):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "secret_scan", "source_mix", "sentencepiece"]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_language_stage_keeps_documents_with_letters(stages):
    rows = stages["documents"].collect()
    kept = set(ids(stages["language_id"]))
    assert all(r.doc_id not in kept for r in rows if not re.search(r"[^\W\d_]", r.text or ""))
    assert len(kept) >= 0.99 * sum(bool(r.lang) and bool(re.search(r"[^\W\d_]", r.text or "")) for r in rows)


def test_language_stage_judges_words_not_their_mix(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    samples: dict = {}
    for r in docs.where("lang is not null and size(split(text, ' ')) > 60").orderBy("doc_id").collect():
        samples.setdefault(r.lang, r.text.split()[:24])
    langs = sorted(samples)
    assert len(langs) >= 4
    three, four = (" ".join(w for l in langs[:n] for w in samples[l]) for n in (3, 4))
    turns = " ".join(w for i in range(0, 24, 8) for l in langs for w in samples[l][i : i + 8])
    foreign = "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью"
    probes = {-1: three, -2: four, -3: turns, -4: foreign}
    more = docs.unionByName(spark.createDataFrame([(i, t) for i, t in probes.items()], "doc_id long, text string"), allowMissingColumns=True)
    kept = corpus_pipeline.language_stage(spark, more, SF01)
    assert {i for i in ids(kept) if i < 0} == {-1, -2, -3}


def test_one_document_of_each_group_stays(stages):
    rows = stages["language_id"].collect()
    prints = [brute_print(r.text) for r in rows]
    assert ids(stages["simhash_near_dedup"]) == sorted(set(brute_components(prints, [r.doc_id for r in rows])))


def test_secrets_go_and_documents_stay(stages):
    assert ids(stages["secret_scan"]) == ids(stages["simhash_near_dedup"])
    assert any(base_spans(r.text) for r in stages["simhash_near_dedup"].collect())
    assert not any(base_spans(r.text) for r in stages["secret_scan"].collect())


def test_the_mix_meets_its_targets(stages):
    docs = [(r.doc_id, r.text, r.source) for r in stages["secret_scan"].collect()]
    copies: dict = {}
    for i in ids(stages["source_mix"]):
        copies[i] = copies.get(i, 0) + 1
    sizes = {}
    for d, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    from tests.llm.test_texts import brute_targets

    goal = brute_targets(sizes)
    rows = [{"doc_id": d, "source_size": sizes[s], "target": goal[s], "size": (n := len((t or "").encode().split())), "taken": n * copies.get(d, 0)} for d, t, s in docs]
    check_mix(rows, docs)


def test_pieces_of_the_mix(stages):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    texts = {r.doc_id: r.text for r in stages["source_mix"].collect()}
    out = stages["sentencepiece"].collect()
    assert len(out) == stages["source_mix"].count()
    assert all(r.ids == model.encode(texts[r.doc_id] or "") and r.n_tokens == len(r.ids) for r in out)


def test_run_equals_the_stages(spark, stages):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF01).select("doc_id", "n_tokens", "ids").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages["sentencepiece"].select("doc_id", "n_tokens", "ids").collect()))
