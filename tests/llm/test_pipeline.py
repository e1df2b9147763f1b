import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from disclosight.llm import language_id, passages, personal_data

from .test_jaccard_join import brute, edited
from .test_language_id import text as spoken


@pytest.fixture(scope="module")
def rows(prose):
    rows = [(i, spoken("aa" if i % 2 else "bb", i, 80), "aa" if i % 2 else "bb") for i in range(120)]
    base, passage = spoken("aa", 700, 200), spoken("bb", 701, 70)
    rows += [(200 + i, edited(base, i, i % 4), "aa") for i in range(8)]
    rows += [(300 + i, spoken("bb", 800 + i, 40) + "\n" + passage + " " + spoken("bb", 900 + i, 20), "bb") for i in range(4)]
    rows += [(400, None, "aa"), (401, "", "aa"), (402, "12 34", "aa"), (None, spoken("aa", 3, 80), "aa"), (None, spoken("bb", 55, 90), None), (None, None, None),
             (403, spoken("aa", 8, 40) + " mail x.y@zz.example.com now", None), (5, rows[5][1], "aa"), (404, passage, "bb"), (405, spoken("aa", 999, 20000), None)]
    return rows


def test_stages(spark, make_docs, rows, tmp_path):
    docs = make_docs(rows)
    seen = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if name != "packing":
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        out.write.parquet(str(tmp_path / str(number)))
        seen[name] = (docs.collect(), (docs := spark.read.parquet(str(tmp_path / str(number)))).collect())

    before, after = seen["language"]
    assert len(after) == len(before) - 4 and all(re.search("[a-z]", x.text) for x in after)

    before, after = seen["near_copies"]
    number = lambda x, i: x.doc_id if x.doc_id is not None else 10**9 + i
    groups = {int(a): int(c) for a, _, c in brute([(number(x, i), x.text) for i, x in enumerate(before)])}
    assert sorted(number(x, 0) if x.doc_id is not None else -1 for x in after) == sorted(a if a < 10**9 else -1 for a, c in groups.items() if a == c)

    before, after = seen["repeated_passages"]
    texts, cut = {x.doc_id: x.text for x in before}, {x.doc_id: x for x in after}
    assert 404 not in cut and texts[300] == cut[300].text
    for i in (301, 302, 303):
        assert len(texts[i].split()) - len(cut[i].text.split()) == 70 and cut[i].n_chars == len(cut[i].text)
    assert all(cut[i].text == t for i, t in texts.items() if i not in (301, 302, 303, 404, None))

    before, after = seen["mask_personal_data"]
    assert len(before) == len(after)
    assert "mail <email> now" in [x.text for x in after if x.doc_id == 403][0]
    assert sum(x.text != y for x, y in zip(sorted(after, key=lambda r: str(r.doc_id)), [b.text for b in sorted(before, key=lambda r: str(r.doc_id))])) == 1

    before, after = seen["packing"]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(x.length for x in after) == sum(len(plain.encode(x.text, add_special_tokens=False).ids) + 1 for x in before)


def test_one_id_with_several_texts_and_passages_without_ids(spark, make_docs, prose):
    passage = prose(70, 80)
    rows = [(7, prose(i, 60)) for i in range(12)] + [(7, prose(3, 60)), (8, prose(100, 60)), (None, prose(200, 60)), (None, prose(200, 60))]
    kept = corpus_pipeline.near_copies(spark, make_docs(rows), "").collect()
    assert sorted((str(x.doc_id), x.text) for x in kept) == sorted({(str(i), t) for i, t in rows})
    rows = [(1, prose(300, 30) + " " + passage), (None, prose(301, 30) + " " + passage), (9, prose(302, 30) + " " + passage), (9, prose(303, 40))]
    cut = {(x.doc_id, len(x.text.split())) for x in corpus_pipeline.repeated_passages(spark, make_docs(rows), "").collect()}
    assert cut == {(1, 110), (None, 30), (9, 30), (9, 40)}


def test_texts_are_not_shuffled_for_their_keys(make_docs, prose):
    keyed = corpus_pipeline._keyed(make_docs([(i, prose(i, 20)) for i in range(5)] + [(3, prose(9, 20))]), "key")
    plan = keyed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert keyed.select("key").distinct().count() == 6


def test_cut_words():
    text = "a b  c\nd e f"
    assert corpus_pipeline.cut_words(text, [(1, 2)]) == "a d e f"
    assert corpus_pipeline.cut_words(text, [(0, 2), (1, 2)]) == "d e f"
    assert corpus_pipeline.cut_words(text, [(3, 3)]) == "a b  c"
    assert corpus_pipeline.cut_words(text, [(0, 6)]) == ""


def test_empty_table(spark, make_docs):
    docs = make_docs([])
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
        if name == "mask_personal_data":
            assert "text" in docs.columns


def test_registered():
    queries = entry_points.queries()
    assert "pipeline" in queries and [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in queries)] == []
    assert entry_points.oracle_sql().get("op1_sparse_topk") and "pipeline" not in entry_points.oracle_sql()
