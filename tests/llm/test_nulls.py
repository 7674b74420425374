"""Nulls in every column, repeated rows and clashing names, through every operator."""

import pytest

from tessera.llm import decontaminate, jaccard_join, line_dedup, packing, pairwise_quality, quality_rules, records, token_counts, toxicity
from tessera.llm.common import work_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key long, node string, label string, score string, copies int, n_removed string"


@pytest.fixture(scope="module")
def docs(spark):
    text = "some words that are long enough for a line to be compared with other lines of text " * 2
    tail = (7, "x", "y", "z", 1, "w")
    rows = [(None, None, None, None, None, *tail), (None, text, "en", None, 1, *tail), (1, text, None, "s", 1, *tail), (1, text, None, "s", 1, *tail), (2, None, "en", "s", None, *tail), (3, text + "\n" + text, "en", "s", 3, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS)


def test_every_operator(spark, docs, byte_bpe, word_bpe):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (1, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(None, "some words that are long enough for a line to be compared"), (1, None)], "item_id long, text string")
    path = work_path(spark, "records")
    records.write_records(docs, path, word_bpe, 2)
    results = {
        "records": records.read_records(spark, path), "pack": packing.pack(docs, byte_bpe), "toxicity": toxicity.score(docs, labels), "rules": quality_rules.judge(docs),
        "jaccard": jaccard_join.components(docs), "lines": line_dedup.deduplicate(docs.drop("n_removed")), "ranking": pairwise_quality.rank(docs, labels), "counts": token_counts.over_limit(docs, byte_bpe, 10),
    }
    assert {k: v.count() for k, v in results.items()} == dict.fromkeys(results, 6)
    found = decontaminate.contaminated(docs, bench)
    assert sorted(str(r.doc_id) for r in found.collect()) == ["1", "1", "3", "None"]
    assert jaccard_join.keep_one(docs).columns == docs.columns and quality_rules.keep(docs).columns == docs.columns
    lines = {r.doc_id: r for r in line_dedup.deduplicate(docs.drop("n_removed")).where("doc_id is not null").collect()}
    assert lines[1].n_removed == 0 and lines[3].n_removed == 2 and lines[2].text is None
