"""The pipeline stage by stage against brute force, each on the rows that the stage before it kept."""

import public_tokenizers
import pytest
from test_documents import plain_kept, plain_references
from test_near import plain_components, plain_fingerprint, plain_hits, plain_windows
from tokenizers import Tokenizer

import corpus_pipeline
from loanroll.llm import classifier, decontaminate
from loanroll.llm.common import staged

SF = "/root/testdata/sf0.001"


def plain_rules(rows):
    refs = plain_references(rows)
    return [r for r in rows if plain_kept(r.text, refs)]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, (s1, s2, s3, s4, s5) = docs.columns, (f for _, f in corpus_pipeline.STAGES)
    # 1: exactly the documents that the operator's scores accept
    accepted = {r.doc_id for r in classifier.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.score >= 0.7}
    one = staged(s1(spark, docs, SF), "t1")
    assert one.columns == columns and {r.doc_id for r in one.collect()} == accepted and 0 < len(accepted) < docs.count()
    # 2: the rules, with references from the rows left
    two = staged(s2(spark, one, SF), "t2")
    assert two.columns == columns and {r.doc_id for r in two.collect()} == {r.doc_id for r in plain_rules(one.collect())}
    # 3: the smallest id of each component
    rows = two.collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    root, least = plain_components(set(prints.values()), 4), {}
    for i, f in prints.items():
        least[root[f]] = min(i, least.get(root[f], i))
    three = staged(s3(spark, two, SF), "t3")
    assert three.columns == columns and sorted(map(tuple, three.collect())) == sorted(tuple(r) for r in rows if r.doc_id in least.values())
    # 4: benchmark words are cut, all rows stay
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    windows, four = plain_windows(items, 10), staged(s4(spark, three, SF), "t4")
    assert four.columns == columns
    before, after = ({r.doc_id: r for r in df.collect()} for df in (three, four))
    assert before.keys() == after.keys()
    for i, r in before.items():
        words, hit, _ = plain_hits(r.text, windows)
        left = [w for k, w in enumerate(words) if k not in hit]
        assert [w.decode() for w in decontaminate.words_of(after[i].text.encode())] == left and after[i].n_chars == len(after[i].text)
        assert hit or r.text == after[i].text
    # 5: the library's ids
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    final = {r.doc_id: r for r in s5(spark, four, SF).collect()}
    assert final.keys() == after.keys()
    for i, r in final.items():
        assert list(r.ids) == tok.encode(after[i].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run_is_the_stages_in_turn(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), name)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_nothing(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    assert corpus_pipeline.STAGES[stage][1](spark, docs, SF).count() == 0
