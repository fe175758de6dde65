"""Packed token ids, the audit of filters, and ranked search, each against brute force."""

import itertools
import json
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
from jobsift.llm import audit, lexical, packing, token_files, tokens
from jobsift.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path
from pyspark.sql import functions as F
from tests.parity import assert_same, connect

SF = "/root/testdata/sf0.01"


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 23, 31, 32])
def test_packed_bits_equal_plain_integers(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 4096, 5001):
        ids = rng.integers(0, 1 << bits, n, np.uint64).astype(np.uint32)
        data = token_files.pack_bits(ids, bits)
        whole = sum(int(x) << (i * bits) for i, x in enumerate(ids)) if n < 5000 else None
        if whole is not None:
            assert data == whole.to_bytes(-(-n * bits // 8), "little")
        assert (token_files.unpack_bits(data, bits, n) == ids).all()
    if bits < 32:
        with pytest.raises(ValueError):
            token_files.pack_bits(np.array([1 << bits], np.uint32), bits)
    assert [token_files.bits_for(v) for v in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_one_file_gives_any_range(tmp_path):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    bodies = [rng.integers(0, 1 << 13, n).astype("<u4") for n in (5, 0, 9000, 4096, 1)]
    with pafs.LocalFileSystem().open_output_stream(f"{tmp_path}/x") as out:
        w = token_files.FileWriter(out, 13, pa.string())
        w.add(pa.array(list("abc")), [b.tobytes() for b in bodies[:3]])
        w.add(pa.array(["d", None]), [b.tobytes() for b in bodies[3:]])
        w.close()
    whole = np.concatenate(bodies)
    with pafs.LocalFileSystem().open_input_file(f"{tmp_path}/x") as f:
        r = token_files.FileReader(f)
        assert r.documents.to_pylist()[2:] == [{"key": "c", "start": 5, "n": 9000}, {"key": "d", "start": 9005, "n": 4096}, {"key": None, "start": 13101, "n": 1}]
        for start, n in ((0, len(whole)), (0, 0), (4095, 2), (4096, 4096), (13101, 1), (8000, 5102)):
            assert (r.range(start, n) == whole[start : start + n]).all()
    assert os.path.getsize(f"{tmp_path}/x") < len(whole) * 13 / 8 + 1200
    with pafs.LocalFileSystem().open_output_stream(f"{tmp_path}/y") as out:
        out.write(b"something else" * 9)
    with pafs.LocalFileSystem().open_input_file(f"{tmp_path}/y") as f, pytest.raises(ValueError):
        token_files.FileReader(f)


def test_token_query_equals_tokenizer(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    found = tokenizer().encode_batch_fast([t or "" for _, t in docs], add_special_tokens=False)
    want, start = {}, 0
    for (doc, _), x in zip(docs, found, strict=True):
        ids = np.array([*x.ids, 0], "<u4")
        want[doc] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = QUERIES["op11_packed_token_ids"](spark, SF).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(docs)


def test_token_files_of_odd_tables(spark, tmp_path):
    rows = [(3, "three"), (None, "none"), (1, None), (3, "three"), (2, "中文 <|endoftext|> " * 3000), (9, " " * 300_000 + "x"), (-4, ""), *((7, "hot") for _ in range(400))]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id int, text string, start string").repartition(5)
    path = f"file://{tmp_path}/ids"
    token_files.write_tokens(df, path, tokenizer_path(), file_ids=500)
    from pyspark.sql import types as T

    got = token_files.read_tokens(spark, path, key=T.IntegerType()).orderBy("start").collect()
    tok = tokenizer()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for _, t in order]
    assert [r.doc_id for r in got] == [r[0] for r in order]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == want and [r.n_tokens for r in got] == [len(w) for w in want]
    whole = list(itertools.chain.from_iterable(want))
    assert [r.start for r in got] == list(itertools.accumulate([0, *(len(w) for w in want)]))[:-1]
    for start, n in ((0, 5), (len(whole) - 700, 700), (100, 20_000), (0, len(whole)), (7, 0)):
        assert token_files.token_range(path, start, n).tolist() == whole[start : start + n]
    plan = token_files.read_tokens(spark, path, ["doc_id", "n_tokens"])
    assert plan.columns == ["doc_id", "n_tokens"] and plan.count() == len(rows)
    found = token_files.manifest(path)
    assert found["bits"] == 16 and found["ids"] == len(whole) and len(found["files"]) > 3  # a repeated key fills several files
    held = [f for f in found["files"] if f["documents"] > 0]
    assert max(f["documents"] for f in held) < 300

    empty = f"file://{tmp_path}/empty"
    token_files.write_tokens(df.limit(0), empty, tokenizer_path())
    assert token_files.read_tokens(spark, empty).count() == 0 and token_files.token_range(empty, 0, 5).tolist() == []


def test_only_committed_token_files_count(spark, tmp_path):
    """A file of a task that was lost is neither read nor kept; an aborted write leaves none."""
    folder = f"{tmp_path}/ids"
    os.makedirs(folder)
    with open(f"{folder}/ids-000000-dead.bits", "wb") as f:
        f.write(b"half of a file")
    docs = spark.createDataFrame([(i, "word " * i) for i in range(50)], "doc_id long, text string")
    token_files.write_tokens(docs, folder, tokenizer_path(), file_ids=300)
    with open(f"{folder}/_manifest.json") as f:
        named = {x["name"] for x in json.load(f)["files"]}
    assert named == {x for x in os.listdir(folder) if x.endswith(".bits")}
    assert token_files.read_tokens(spark, folder).count() == 50
    writer = token_files.TokenWriter(f"{tmp_path}/other", 16)
    os.makedirs(f"{tmp_path}/other")
    with open(f"{tmp_path}/other/ids-000001-x.bits", "wb") as f:
        f.write(b"x")
    writer.abort([None, token_files._Written("ids-000001-x.bits", 1, 4, 1)])
    assert os.listdir(f"{tmp_path}/other") == []


@pytest.mark.parametrize("gap", [" ", "\n", " \t", "　 ", "\r\n\n", "\x85", "\x1c"])
def test_long_white_space_equals_tokenizer(gap):
    tok, enc = tokenizer(), tokens.encoder(tokenizer_path())
    for a, b in (("a", "b"), ("", "x"), ("1", ""), ("", "<|endoftext|>"), ("<|endoftext|>", "!!"), ("'s", " ")):
        for n in (tokens.LONG_GAP, tokens.LONG_GAP + 1):
            run = (gap * n)[:n]
            text = a + run + b + " mid " + run + "<|endoftext|>" + run
            assert enc.ids(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_ten_megabytes_of_white_space_are_packed(spark):
    """Runs of spaces, of line ends and of both pass through Spark with the tokenizer file's ids."""
    texts = [" " * 10_000_000, "x" + "\n" * 10_000_000 + "y", " \n\t\r" * 2_500_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = packing.pack(df, tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    tok = tokenizer()
    for r in got:
        ids = [*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert r.n == r["all"] == len(ids)
        if r.doc_id == 1:
            assert tokens.ids_of(texts[1], tokenizer_path()).tolist() == ids


def brute_audit(rows, filters="ABCDE"):
    out = {}
    for part in {r["part"] for r in rows}:
        own = [r for r in rows if r["part"] == part]
        total = dict.fromkeys(filters, 0)
        found = {}
        for order in itertools.permutations(filters):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[f]]
                left = [r for r in left if not r[f]]
                total[f] += len(gone)
                fails = sum(r[f] for r in own)
                only = sum(r[f] and not any(r[g] for g in filters if g != f) for r in own)
                found["".join(order), step] = (len(left), len(gone), fails - len(gone), only, sum(r["good"] for r in gone), sum(r["toxic"] for r in gone), f)
        out |= {(part, *k): (*v[:-1], total[v[-1]]) for k, v in found.items()}
    return out


def plain_flags(docs, labels):
    rows = []
    for doc, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        rows.append({
            "part": source or "", "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": doc is not None and any(d is not None and d < doc and (x or "") == t for d, x, _ in docs),
            "good": any(d == doc and q == 1 for d, q, _ in labels) and doc is not None, "toxic": any(d == doc and x == 1 for d, _, x in labels) and doc is not None,
        })
    return rows


MEASURED = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "GAMMA", "d#", "e", "ünï", "中"]
    texts = [" ".join(rng.choice(words[: rng.randrange(1, 8)]) + str(rng.randrange(rng.choice([1, 400]))) for _ in range(rng.choice([3, 150, 199, 200, 260]))) for _ in range(60)]
    texts += [None, "", " \x0b\t", "one\x0btwo", "x" * 300_000, "word " * 50_000, "ABC DEF"]
    docs = [(i if i % 17 else None, rng.choice(texts), rng.choice(["s", "s", "s", "t", None, ""])) for i in range(240)] + [(5, texts[3], "s")] * 3
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 200, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (10**9, 1, 1)]
    df = spark.createDataFrame([(*d, "mine") for d in docs], "doc_id long, text string, source string, part string").repartition(4)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(audit.flagged(df, said)).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[c] for c in MEASURED) for r in got}
    assert len(got) == len(found) == 3 * 600 and found == brute_audit(plain_flags(docs, labels))
    assert audit.audit(audit.flagged(df.limit(0), said)).count() == 0
    nobody = audit.audit(audit.flagged(df, said.limit(0))).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0]
    assert nobody == 0


def test_audit_of_other_filters(spark):
    rng = random.Random(6)
    rows = [{"part": rng.choice("xy"), "P": rng.random() < 0.4, "Q": rng.random() < 0.2, "R": True, "good": rng.random() < 0.5, "toxic": False} for _ in range(500)]
    got = audit.audit(spark.createDataFrame(rows), "PQR").collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in MEASURED) for r in got} == brute_audit(rows, "PQR")
    with pytest.raises(ValueError):
        audit.audit(spark.createDataFrame(rows), "ABCDEFGH")


def test_audit_query_equals_sql(spark):
    assert_same(QUERIES["op12_filter_audit"](spark, SF), connect(SF), ORACLE_SQL["op12_filter_audit"])


def test_audit_moves_no_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = audit.flagged(docs, spark.read.parquet(f"{SF}/labels.parquet"))._jdf.queryExecution().toString()
    assert "text" not in plan


def brute_search(docs, items, k=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    own = [(d, pattern.findall(lower(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in own), sum(len(w) for _, w in own)
    df = {}
    for _, w in own:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for d, w in own:
            score = 0
            for x in set(pattern.findall(lower(text))):
                if x in w:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                    m = 10 + (90 * len(w) * n_docs) // n_terms
                    score += weight * ((1_000_000_000 * w.count(x)) // (1000 * w.count(x) + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def search_tables():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)] + ["Der", "Ärger", "ärger", "日本語", "it's", "x_y", "42"]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([5, 40, 127])]) for _ in range(n))
    docs = [(i if i % 31 else None, text(rng.choice([1, 4, 20, 80]))) for i in range(400)]
    docs += [(i, docs[7][1]) for i in range(1000, 1040)] + [(8, docs[8][1])] * 3 + [(2000, None), (2001, ""), (2002, "--- !!"), (2003, "w3 " * 200_000 + "rare")]
    items = [(i, text(rng.choice([1, 3, 12]))) for i in range(40)] + [(3, "w1 w2"), (None, "rare w3"), (90, None), (91, "?"), (92, "never seen"), (93, docs[7][1]), (94, "Der DER der ÄRGER")]
    return docs, items


@pytest.mark.parametrize("few", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, few):
    """Also where no table is small enough to be broadcast, buckets are cut, and a single document leads."""
    if few:
        monkeypatch.setattr(lexical, "BROADCAST_ROWS", 3)
        monkeypatch.setattr(lexical, "PART_ROWS", 50)
        monkeypatch.setattr(lexical, "LEAD", 1)
        monkeypatch.setattr(lexical, "PART_CHARS", 1000)
    docs, items = search_tables()
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score int").repartition(3)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int").repartition(2)
    got = lexical.search(d, i).collect()
    assert sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in got], key=str) == brute_search(docs, items)
    assert lexical.search(d.limit(0), i).count() == 0 and lexical.search(d, i.limit(0)).count() == 0


def test_whole_index_serves_other_items(spark):
    docs, _ = search_tables()
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    terms = {r.term: r.df for r in index.terms.collect()}
    assert terms["w1"] == sum("w1" in (t or "").split() for _, t in docs) and terms["rare"] == 1
    assert index.postings.count() == sum(terms.values()) and "bucket" in index.postings.columns
    assert index.postings.filter("term = 'rare'").select("doc").collect() == [(2003,)]


def test_terms_of_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "PART_CHARS", 7)
    text = "aaa bbbbbbbbbbbbbbbbbbbbbbbb, c d " * 20 + "日" * 50
    assert lexical.terms_of(text) == {"aaa": 20, "b" * 24: 20, "c": 20, "d": 20, "日" * 50: 1} and not lexical.terms_of("... ")


def test_search_query_equals_sql(spark):
    assert_same(QUERIES["op13_lexical_search"](spark, SF), connect(SF), ORACLE_SQL["op13_lexical_search"])
