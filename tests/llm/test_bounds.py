"""What holds at any size: no text moves, nothing unbounded reaches the driver, operators may run side by side."""

import random
import re
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from jobsift.llm import chosen_path, language_id, toxicity
from jobsift.llm.common import stage
from jobsift.llm.queries import QUERIES
from pyspark.sql import functions as F

TINY = "/root/testdata/sf0.001"


def near_rows():
    rng = random.Random(3)
    rows = []
    for g in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for k in range(5):
            own = list(words)
            own[rng.randrange(60)] = f"x{k}"
            rows.append((g * 10 + k, " ".join(own if k else words)))
    rows += [(0, rows[0][1])] * 30 + [(0, f"other text {i} of the same id as so many others here") for i in range(50)] + [(None, rows[0][1]), (None, None), (7, "")]
    return rows


def test_sets_of_many_clustered_classes_are_found_without_moving_texts(spark, monkeypatch):
    df = stage(spark.createDataFrame(near_rows(), "doc_id long, text string").repartition(3), "docs")
    want = sorted(map(str, chosen_path.near_duplicates(df).collect()))
    plans, real = [], chosen_path.stage
    monkeypatch.setattr(chosen_path, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(chosen_path, "stage", lambda d, name: (plans.append((name, d._jdf.queryExecution().toString())), real(d, name))[1])
    assert sorted(map(str, chosen_path.near_duplicates(df).collect())) == want
    sets = [p for name, p in plans if name == "sets"]
    assert len(sets) == 1
    physical = sets[0].split("== Physical Plan ==")[1]
    assert "Exchange hashpartitioning(cid" in physical
    names = re.findall(r"Exchange[^\n]*\n[ :+|-]*(?:\*\(\d+\) )?(\w+)[^\n]*?\[([^\]]*)\]", physical)
    assert names and all("text" not in columns for _, columns in names)


def test_full_sets_by_filter_equal_those_by_broadcast(spark, monkeypatch):
    docs = stage(spark.createDataFrame(near_rows(), "id long, text string").repartition(3), "docs")
    from jobsift.llm.shingles import set_key, shingle_sets

    rows = {}
    for r in docs.collect():
        (s,) = shingle_sets([r.text])
        if len(s):
            rows.setdefault(set_key(s), r.id)
    wanted = stage(spark.createDataFrame([(i % 3, i, 1, bytearray(c), d) for i, (c, d) in enumerate(rows.items()) if i % 2], "grp long, rid long, blocks long, cid binary, rep long"), "wanted")
    few = {(r.grp, r.rid, bytes(r.hashes)) for r in chosen_path._full_sets(docs, wanted, 1).collect()}
    monkeypatch.setattr(chosen_path, "BROADCAST_ROWS", 0)
    many = chosen_path._full_sets(docs, wanted, wanted.count()).collect()
    assert {(r.grp, r.rid, bytes(r.hashes)) for r in many} == few and len(many) == len(few) == wanted.count()


def test_operators_run_side_by_side(spark):
    """Stages of one aren't deleted by another, and the package is shipped once."""
    names = ["op8_bloom_exact_dedup", "op10_chosen_path_near_dedup", "op8_bloom_exact_dedup", "op10_chosen_path_near_dedup"]
    spark.sparkContext._jobsift_shipped = False
    alone = [sorted(map(str, QUERIES[n](spark, TINY).collect())) for n in names[:2]]
    spark.sparkContext._jobsift_shipped = True
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(lambda n: sorted(map(str, QUERIES[n](spark, TINY).collect())), names))
    assert found == alone * 2


def test_repeated_labelled_ids_teach_once(spark, monkeypatch):
    rows = [(i, f"{'vile' if i % 3 == 0 else 'kind'} words number{i} " * 3) for i in range(300)] + [(3, f"vile thing {k}") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda x, y, fold: seen.append(len(x)))
    toxicity.fit(docs, labels, {"toxic": F.col("toxic") == 1})
    monkeypatch.setattr(toxicity, "TRAIN_WORDS", 2)
    toxicity.fit(docs, labels, {"toxic": F.col("toxic") == 1})
    assert seen[0] == 300 and seen[1] < 5  # texts with more words than that don't teach


def test_driver_gets_one_row_for_each_language(spark):
    rows = [(i, " ".join(chr(97 + (i % 30) % 26) * (2 + k) for k in range(5)) + f" {'xyz'[i % 3]}{i % 30}", f"l{i % 30}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert len(model.languages) == 30 and model.weights.shape == (language_id.BUCKETS, 30) and model.weights.dtype == np.float32
    counts = {}
    for _, t, lang in rows:
        counts.setdefault(lang, np.zeros(language_id.BUCKETS))
        counts[lang] += np.bincount(language_id._buckets(t), minlength=language_id.BUCKETS)
    for k, name in enumerate(model.languages):
        want = counts[name] + language_id.SMOOTH
        assert np.allclose(model.weights[:, k], np.log(want / want.sum()), atol=1e-4)
