"""The corpus pipeline against a brute-force version of all its stages."""

import hashlib
import random
import re

import numpy as np
from jobsift.llm.queries import KEEP, TARGETS
from pyspark.sql import functions as F

EN = "the of and to in that was his with for had not this but from they which one you were all her she there would".split()
DE = "der die und das nicht mit sich auf ein eine dem wird von auch werden bei nach über sind noch wie einem über so".split()


def fixture_rows():
    rng = random.Random(12)
    rows = []
    for i in range(120):
        words = [rng.choice(DE if i % 4 == 0 else EN) + rng.choice(["", "", "s", "e"]) for _ in range(rng.randrange(60, 300))]
        rows.append([i, " ".join(words), ["en", "de", None, "xx"][0 if i % 4 else 1] if i % 11 else None, ["src0", "src1", "brand new", None][i % 4]])
    for i in range(120, 150):  # exact copies but for case
        rows.append([i, rows[i - 120][1].upper() if i % 2 else rows[i - 120][1], "en", "src0"])
    for i in range(150, 190):  # near copies from 0.7 to 0.95
        w = rows[i - 150][1].split()
        for k in rng.sample(range(len(w)), 1 + i % 6):
            w[k] = "neu" + str(rng.randrange(10**6)).translate(str.maketrans("0123456789", "abcdefghij"))
        rows.append([i, " ".join(w), "en", "src1"])
    rows += [[200, None, "en", "src0"], [201, "", None, None], [202, "12 34 5!", "en", "src0"], [203, rows[3][1], "en", "src9"], [None, rows[7][1] + " and some more", "en", None]]
    rows += [[204, "the and of " * 30_000 + "end", "en", "src0"], [205, "the <|endoftext|> and was", "en", "src0"]]
    rows += [[206, "the and of was" + " \n" * 1_000_000 + "from which they were", "en", "src0"]]  # more white space than the word pattern takes
    return rows


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


def brute(rows):
    """What stays after four stages, by position."""
    at = [i for i, r in enumerate(rows) if r[1] is not None and any(c.isalpha() for c in r[1])]
    best = {}
    for i in at:
        k = lower(rows[i][1])
        if k not in best or (rows[i][0] is not None, rows[i][0] or 0) > (rows[best[k]][0] is not None, rows[best[k]][0] or 0):
            best[k] = i
    at = sorted(best.values())
    sets = {}
    for i in at:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(rows[i][1]))
        sets[i] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)}
    up = {i: i for i in at}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in at:
        for j in at:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    groups = {}
    for i in at:
        groups.setdefault(find(i), []).append(i)
    at = sorted(min(g, key=lambda i: (rows[i][0] is not None, rows[i][0] or 0)) for g in groups.values())
    tokens = np.array([len(rows[i][1].encode()) // 4 + 1 for i in at], float)
    size = [len(rows[i][1]) for i in at]
    topic = ["note" if s < 400 else "article" if s < 2000 else "essay" if s < 10000 else "book" for s in size]
    labels = [[rows[i][3] or "other" for i in at], [rows[i][2] or "other" for i in at], topic]
    index, goals, factor = [], [], np.ones(len(at))
    for m, own in zip(TARGETS, labels, strict=True):
        _, place = np.unique(own, return_inverse=True)
        goal = (np.bincount(place, weights=tokens) / tokens.sum()) ** m.flatten
        index.append(place)
        goals.append(goal / goal.sum())
    for _ in range(100):
        for place, goal in zip(index, goals, strict=True):
            factor *= (goal * tokens.sum() / np.bincount(place, weights=tokens * factor))[place]
    chance = [int(hashlib.md5(f"42:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest()[:12], 16) / 2**48 for i in at]
    p = np.minimum(1, min(KEEP, 1 / factor.max()) * factor)
    return [i for i, c, q in zip(at, chance, p, strict=True) if c < q]


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = fixture_rows()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    kept = brute(rows)
    assert 40 < len(kept) < 140 and any(rows[i][3] is None for i in kept) and any(rows[i][3] == "brand new" for i in kept)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {rows[i][0]: [*tok.encode(rows[i][1], add_special_tokens=False).ids, 0] for i in kept}
    got = {}
    for p in corpus_pipeline.run(spark, str(tmp_path)).orderBy("doc_id", "start").collect():
        assert p.start == len(got.setdefault(p.doc_id, []))
        got[p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
    assert got == want


def test_real_topics_are_raked(spark):
    import corpus_pipeline
    from jobsift.llm import mixing

    rows = [(i, "word " * (40 + i % 60), "en", "src0", 0, "sport" if i % 10 else "law") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, topic string")
    out = corpus_pipeline.mixed(spark, docs, "")
    assert out.columns == docs.columns
    found = mixing.fit(docs, TARGETS, KEEP)
    assert set(found.marginals[2].targets) == {"sport", "law"} and found.residual < 1e-9
    mass = {r.topic: r.n for r in out.groupBy("topic").agg(F.sum(mixing.token_estimate()).alias("n")).collect()}
    goal = 0.1**0.95 / (0.1**0.95 + 0.9**0.95)
    assert abs(mass["law"] / sum(mass.values()) - goal) < 0.012


def test_columns_with_clashing_names_survive(spark):
    import corpus_pipeline

    names = ["score", "lang_pred", "kept", "keep_id", "group_size", "text_sha256", "weight", "Probability", "tokens", "topic"]
    rows = [r for r in fixture_rows() if r[0] is not None][:60]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.concat(F.lit(f"my {n} "), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, "")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        for r in out.collect():
            assert [r[n] for n in names] == [f"my {n} {r.doc_id}" for n in names], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0
