"""Mixing, archives, vectors, shards and the pipeline."""

import base64
import gzip
import hashlib
import itertools

import numpy as np
import pyarrow.fs as pafs
import pytest
from jobsift.llm import histogram_sort, mixing, subspace_join, warc
from jobsift.llm.queries import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F
from tests.parity import assert_same, connect

SF = "/root/testdata/sf0.01"


def test_rake_meets_marginals():
    rng = np.random.default_rng(2)
    cells = {(a, b, c): float(rng.integers(1, 1000)) for a in "xyz" for b in "pq" for c in "uvw"}
    ms = [mixing.Marginal("a", {"x": 0.5, "y": 0.3, "z": 0.2}), mixing.Marginal("b", {"p": 0.7, "q": 0.3}), mixing.Marginal("c", {"u": 0.2, "v": 0.2, "w": 0.6})]
    w = mixing.rake(cells, ms)
    total = sum(cells.values())
    for i, m in enumerate(ms):
        for v, share in m.targets.items():
            assert sum(n * w[c] for c, n in cells.items() if c[i] == v) == pytest.approx(share * total, rel=1e-6)
    m = mixing.plan(cells, ms, 0.1)
    assert m.rate == 0.1 and m.residual < 1e-6
    assert sum(n * m.probability(c) for c, n in cells.items()) == pytest.approx(0.1 * total, rel=1e-6)
    most = mixing.plan(cells, ms, 1.0)  # the rate gives way, not the targets
    assert most.rate < 1 and most.residual < 1e-6 and max(most.probability(c) for c in cells) == pytest.approx(1)
    kept = {c: n * most.probability(c) for c, n in cells.items()}
    for i, m in enumerate(ms):
        for v, share in m.targets.items():
            assert sum(n for c, n in kept.items() if c[i] == v) / sum(kept.values()) == pytest.approx(share, rel=1e-6)
    assert mixing.rake({}, ms) == {} and mixing.rake({("x", "p", "u"): 0.0}, ms) == {("x", "p", "u"): 1.0}
    gone = mixing.rake({("x",): 5.0, ("other",): 5.0}, [mixing.Marginal("a", {"x": 1.0, "never": 1.0})])
    assert gone == {("x",): 2.0, ("other",): 0.0}
    apart = {("x", "p"): 5.0, ("y", "q"): 5.0}  # no weights can meet both
    assert mixing.plan(apart, [mixing.Marginal("a", {"x": 0.9, "y": 0.1}), mixing.Marginal("b", {"p": 0.5, "q": 0.5})], 1.0).residual > 0.1


def test_mix(spark):
    rows = [(i, "word\n" * (i % 90), "s" + str(i % 3), ["en", "de", None][i % 3], "old") for i in range(3000)] + [(None, None, None, None, "old"), (7, "", "s1", "en", "old"), (7, "", "s1", "en", "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight string")
    ms = [mixing.Marginal("source", {"s0": 0.5, "s1": 0.3, "s2": 0.15, "other": 0.05}), mixing.Marginal("topic", {"note": 0.6, "article": 0.4})]
    got = mixing.mix(df, ms, 0.5).toPandas()
    assert len(got) == len(rows) and got.weight.dtype == float
    assert (got.tokens == [len(t.encode()) // 4 + 1 for t in got.text.where(got.text.notna(), "")]).all()
    share = (got.tokens * got.probability).groupby(got.source.fillna("other")).sum()
    assert share["s0"] / share.sum() == pytest.approx(0.5, abs=0.03)
    h = [int(hashlib.md5(f"42:{'' if i != i else int(i)}".encode()).hexdigest()[:12], 16) / 2**48 for i in got.doc_id]
    assert (got.kept == (np.array(h) < got.probability)).all()
    assert mixing.mix(df.limit(0), ms).count() == 0


def test_mix_samples_unnamed_values(spark):
    named = [mixing.Marginal("source", {"src0": 0.4, "src1": 0.2, "src2": 0.4}), mixing.Marginal("lang", {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2})]
    rows = [(i, "word " * (90 + i % 400), ["src0", "src1", "src2", "hot", None][i % 5], ["en", "de", "fr", "es", "it", None][i // 5 % 6]) for i in range(6000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), named, 0.6).toPandas()
    got["mass"] = got.tokens * got.probability
    for m in named:
        rest = ~got[m.column].isin(list(m.targets))
        assert got.mass[rest].sum() / got.mass.sum() == pytest.approx(got.tokens[rest].sum() / got.tokens.sum(), rel=1e-6)
        assert (got.probability[rest] > 0).all() and got[rest & got.kept][m.column].isna().any()
        for v, share in m.targets.items():
            assert got.mass[got[m.column] == v].sum() / got.mass[~rest].sum() == pytest.approx(share, rel=1e-6)
    assert {"hot", None} <= set(got[got.kept].source.where(got.source.notna(), None))
    alone = mixing.mix(spark.createDataFrame([(i, "a b", None, None) for i in range(100)], "doc_id long, text string, source string, lang string"), named, 0.6)
    assert [r.probability for r in alone.select("probability").distinct().collect()] == [pytest.approx(0.6)]


def test_mix_flattens_any_values(spark):
    rows = [(i, "word " * 9, ["big"] * 6 + ["mid", "small", "tiny", None]) for i in range(10)]
    rows = [(10 * i + k, t, s) for i, t, names in rows for k, s in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.fit(df, [mixing.Marginal("source", flatten=0.5)], 1.0)
    assert found.residual < 1e-9
    raised = {"big": 0.6**0.5, "mid": 0.1**0.5, "small": 0.1**0.5, "tiny": 0.1**0.5, "other": 0.1**0.5}
    assert found.marginals[0].targets == {k: pytest.approx(v / sum(raised.values())) for k, v in raised.items()}
    got = mixing.mix(df, [mixing.Marginal("source", flatten=0.5)], 1.0).toPandas()
    assert len(got) == 100 and (got.probability > 0).all() and got.probability.max() == pytest.approx(1)


def test_mix_values_may_hold_any_characters(spark):
    rows = [(1, "a b", "s\x1ft", "u"), (2, "c d", "s", "t\x1fu"), (3, "e f", "z", "u"), (4, "g", "`q`", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.mix(df, [mixing.Marginal("source", flatten=0.8), mixing.Marginal("lang", flatten=0.9)], 1.0).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4]


def test_scripts_without_spaces_have_tokens(spark):
    texts = ["中" * 6000, "word  " * 10, "", None]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r.tokens for r in mixing.mix(df, [mixing.Marginal("source", flatten=0.8)]).collect()}
    assert got == {0: 4501, 1: 16, 2: 1, 3: 1}
    true = mixing.mix(df.withColumn("tokens", F.lit(7)), [mixing.Marginal("source", flatten=0.8)], tokens=F.col("tokens")).select("tokens").distinct().collect()
    assert true == [(7,)]


def many_sources(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, "word " * int(rng.integers(1, 900)), ["en", "de", "fr", None][int(rng.integers(0, 4))], f"s{int(rng.integers(0, 240)) ** 2 // 240}" if i % 50 else None, 0) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")


def test_mix_of_240_sources_equals_sql(spark, tmp_path):
    many_sources(spark, tmp_path)
    con = __import__("duckdb").connect()
    con.execute(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    assert_same(QUERIES["op3_raked_mixture"](spark, str(tmp_path)), con, ORACLE_SQL["op3_raked_mixture"])


@pytest.mark.parametrize("values", [20, 400])
def test_cells_beyond_the_driver_are_raked_in_a_table(spark, tmp_path, monkeypatch, values):
    """The same weights, whether tables of values are broadcast or not."""
    many_sources(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ms = [mixing.Marginal("source", flatten=0.8), mixing.Marginal("lang", {"en": 0.5, "de": 0.3, "xx": 0.2})]
    want = {r.doc_id: (r.weight, r.probability, r.kept) for r in mixing.mix(docs, ms, 0.7).collect()}
    assert mixing.fit(docs, ms, 0.7).residual < 1e-9
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", values)
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-6)
    found = mixing.fit(docs, ms, 0.7)
    assert found.factors and found.residual < 1e-6
    got = mixing.mix(docs, ms, 0.7, mixture=found).collect()
    assert len(got) == 3000
    for r in got:
        assert (r.weight, r.probability) == (pytest.approx(want[r.doc_id][0], rel=1e-4), pytest.approx(want[r.doc_id][1], rel=1e-4))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_mix_query_equals_brute_force(spark, sf):
    """Probabilities by raking the rows themselves; the shares that are reached, on average and as drawn."""
    from jobsift.llm.queries import KEEP, TARGETS

    got = QUERIES["op3_raked_mixture"](spark, f"/root/testdata/{sf}").toPandas()
    w = got.tokens.to_numpy(float)
    index = [np.unique(got[m.column], return_inverse=True) for m in TARGETS]
    goals = []
    for (values, at), m in zip(index, TARGETS, strict=True):
        now = np.bincount(at, weights=w) / w.sum()
        goal = now**m.flatten if m.flatten else np.array([m.targets[v] for v in values])
        goals.append(goal / goal.sum())
    factor = np.ones(len(w))
    for _ in range(mixing.ROUNDS):
        for (_, at), goal in zip(index, goals, strict=True):
            factor *= (goal * w.sum() / np.bincount(at, weights=w * factor))[at]
    assert np.allclose(got.weight, factor, atol=1e-6)
    assert np.allclose(got.probability, min(KEEP, 1 / factor.max()) * factor, atol=1e-6)
    for (_, at), goal in zip(index, goals, strict=True):
        mass = np.bincount(at, weights=w * got.probability)
        assert np.abs(mass / mass.sum() - goal).max() < 1e-5
        drawn = np.bincount(at, weights=w * got.kept)
        assert np.abs(drawn / drawn.sum() - goal).max() < (0.01 if sf == "sf0.1" else 0.05)
    assert got.kept.mean() > 0.5


def test_mix_query_equals_sql(spark):
    assert_same(QUERIES["op3_raked_mixture"](spark, SF), connect(SF), ORACLE_SQL["op3_raked_mixture"])


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_warc_round_trip(spark, tmp_path):
    tricky = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(5, "u1", "same ü"), (3, "u\r\n2", "same ü"), (9, None, "same ü"), (4, "u3", None), (6, "u4", ""), (7, "u5", tricky), (None, "u6", "same ü"), (8, "u7", "y" * 2_000_000), (3, "u8", "same ü")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, _digest string").repartition(3)
    for compression in ("none", "gzip"):
        path = f"file://{tmp_path}/{compression}"
        warc.write_warc(df, path, compression=compression)
        got = warc.read_warc(spark, path).collect()
        assert len(got) == len(rows)
        kinds = {(r.record_id, r.warc_type, r.refers_to) for r in got}
        assert kinds == {
            ("<urn:page:3>", "response", None), ("<urn:page:5>", "revisit", "<urn:page:3>"), ("<urn:page:9>", "revisit", "<urn:page:3>"), ("<urn:page:>", "response", None),
            ("<urn:page:4>", "response", None), ("<urn:page:6>", "revisit", "<urn:page:4>"), ("<urn:page:7>", "response", None), ("<urn:page:8>", "response", None),
        }
        body = {r.record_id: bytes(r.payload) for r in got if r.warc_type == "response"}
        assert body["<urn:page:7>"] == tricky.encode() and body["<urn:page:4>"] == b"" and len(body["<urn:page:8>"]) == 2_000_000
        for r in got:
            page = next((h or "").encode() for i, _, h in rows if f"<urn:page:{'' if i is None else i}>" == r.record_id)
            assert r.payload_length == len(page) and r.payload_digest == "sha1:" + b32(page)
    warc.write_warc(df.limit(0), f"file://{tmp_path}/none0")
    assert warc.read_warc(spark, f"file://{tmp_path}/none0").count() == 0


def test_warc_predicates(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h{i % 3}/p", f"body {i % 7}") for i in range(60)], "page_id long, url string, html string")
    warc.write_warc(df, f"file://{tmp_path}/w")
    read = warc.read_warc(spark, f"file://{tmp_path}/w", ["record_id", "warc_type", "target_uri", "payload"])
    some = read.filter("warc_type = 'response' and target_uri like 'http://h1%'")
    assert "Filter (" not in some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == sum(i % 3 == 1 for i in range(7))
    assert read.filter("warc_type in ('revisit')").count() == 53 and read.filter("warc_type <> 'revisit'").count() == 7
    assert read.filter("length(payload) > 5").count() == 7


def test_warc_skips_payloads(tmp_path):
    block = "HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"
    record = f"WARC/1.0\r\nWARC-Type: response\r\nX-Folded: a\r\n b\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n{block}\r\n\r\n"
    info = "WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\ninfo\r\n\r\n"
    (tmp_path / "a.warc").write_text(info + record, newline="")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info.encode()) + gzip.compress(record.encode()))
    for name in ("a.warc", "a.warc.gz"):
        path = str(tmp_path / name)
        rows = list(warc.read_records(pafs.LocalFileSystem(), path, [], True, True))
        assert [r["payload"] for r in rows] == [b"info", b"abc"] and dict(rows[1]["headers"])["x-folded"] == "a b"
        lean = list(warc.read_records(pafs.LocalFileSystem(), path, [("warc_type", lambda v: v == "response")], False, False))
        assert len(lean) == 1 and "payload" not in lean[0]
    (tmp_path / "bad.warc").write_text("nonsense\n")
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.read_records(pafs.LocalFileSystem(), str(tmp_path / "bad.warc"), [], True, True))


def test_warc_query(spark):
    assert_same(QUERIES["op5_warc_round_trip"](spark, SF), connect(SF), ORACLE_SQL["op5_warc_round_trip"])


def brute_vectors(rows, cosine=0.95):
    units = []
    for _, v in rows:
        x = np.array([np.nan if c is None else c for c in v], float) if v is not None else np.zeros(1)
        n = np.linalg.norm(x)
        units.append(x / n if np.isfinite(n) and n else None)
    n, up, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= cosine:
            links[a] += 1
            links[b] += 1
            up[find(a)] = find(b)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [(key, links[i], least.get(find(i))) for i, (key, _) in enumerate(rows)]


@pytest.mark.parametrize("chunks", [subspace_join.CHUNKS, (16, 16)])
def test_vectors_equal_brute_force(spark, monkeypatch, chunks):
    monkeypatch.setattr(subspace_join, "CHUNKS", chunks)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 40))
    rows = [(i, (base[rng.integers(40)] + rng.standard_normal(40) * rng.choice([0, 0.1, 0.2, 0.25])).astype("f4").tolist()) for i in range(150)]
    rows += [(200, None), (201, [0.0] * 40), (202, [float("nan")] * 40), (203, [None] * 40), (204, [float("inf")] + [1.0] * 39), (205, rows[3][1]), (206, [2 * x for x in rows[3][1]]), (None, rows[4][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, 1, "old") for i, v in rows], "vec_id long, embedding array<float>, label int, kept string").repartition(3)
    got = [(r.vec_id, r.n_links, r.component_id) for r in subspace_join.near_vectors(df).collect()]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(got, key=key) == sorted(brute_vectors([(i, v) for i, v in rows]), key=key)


def test_vectors_query_equals_sql(spark):
    assert_same(QUERIES["op7_subspace_near_vectors"](spark, SF), connect(SF), ORACLE_SQL["op7_subspace_near_vectors"])


def test_vectors_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert subspace_join.near_vectors(df).count() == 0
    one = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in subspace_join.near_vectors(one).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_block_budget_is_lossless(monkeypatch):
    rng = np.random.default_rng(9)
    a = rng.standard_normal((300, 64))
    b = a + rng.standard_normal((300, 64)) * 0.25
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    true = sorted(zip(*(x.tolist() for x in np.nonzero(a @ b.T >= 0.95)), strict=True))
    monkeypatch.setattr(subspace_join, "STRIPE", 50)
    monkeypatch.setattr(subspace_join, "TILE", 70)
    found = [p for x, y in subspace_join.links_of(a, b, subspace_join._rotation(64), 0.95) for p in zip(x.tolist(), y.tolist(), strict=True)]
    assert sorted(found) == true  # each just once
    both = np.concatenate((a, b))
    true = {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(both @ both.T >= 0.95)), strict=True) if i < j}
    found = [(min(p), max(p)) for x, y in subspace_join.links_of(both, both, subspace_join._rotation(64), 0.95) for p in zip(x.tolist(), y.tolist(), strict=True)]
    assert len(found) == len(set(found)) and set(found) == true


def test_range_join_equals_brute_force():
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((700, 5)), rng.standard_normal((900, 5))
    found = {p for i, j in subspace_join.range_join(x, y, 0.3) for p in zip(i.tolist(), j.tolist(), strict=True)}
    far = ((x[:, None] - y[None]) ** 2).sum(axis=2)
    assert set(zip(*(k.tolist() for k in np.nonzero(far <= 0.3)), strict=True)) <= found
    assert found <= set(zip(*(k.tolist() for k in np.nonzero(far <= 0.3 + 1e-3)), strict=True))
    assert not list(subspace_join.range_join(x[:0], y, 0.3))


def test_chunks_follow_the_cores_not_the_vectors():
    rows = [subspace_join._chunk_rows(n, 6) for n in (100, 51_000, 300_000, 10**9)]
    assert rows == [2048, -(-51_000 // 7), -(-300_000 // 7), 65536]


def hold_shards(rows, shards, slack):
    size = {s: sum(r.size for r in rows if r.shard == s) for s in range(shards)}
    fair = sum(size.values()) / shards
    assert all(abs(n - fair) <= slack for n in size.values()), size
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_shards(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, "x" * int(rng.integers(0, 400)) + str(i)) for i in range(1500)] + [(5000 + i, "hot text " * 20) for i in range(1000)] + [(None, None), (9000, None), (9000, None), (9001, ""), (9002, "ü")]
    df = spark.createDataFrame([(i, t, "old") for i, t in rows], "doc_id long, text string, shard string").repartition(4)
    got = histogram_sort.shard_by_bytes(df, 8).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.size) for r in got if r.doc_id in (9000, 9001, 9002)} == {(9000, 1), (9001, 1), (9002, 3)}
    hold_shards(got, 8, 450)
    cut = [t for t in {r.text for r in got} if len({r.shard for r in got if r.text == t}) > 1]
    assert set(cut) <= {"hot text " * 20, None}
    assert histogram_sort.shard_by_bytes(df.limit(0), 8).count() == 0
    few = histogram_sort.shard_by_bytes(df.limit(3), 8).collect()
    assert len(few) == 3 and {r.slot for r in few} <= {0, 1, 2}


def test_shards_query_equals_its_law(spark):
    """Every row once, sizes and checksums of the bytes, even shards, gapless slots, equal texts together unless a
    boundary between two shards cuts their group."""
    import zlib

    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op9_histogram_sort_shards"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        own = docs[r.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(own) + 1, zlib.crc32(own), "bytes", None)
    hold_shards(got, 8, max(r.size for r in got) / 2 + 1)
    shards_of = {}
    for r in got:
        shards_of.setdefault(docs[r.doc_id], set()).add(r.shard)
    cut = [s for s in shards_of.values() if len(s) > 1]
    assert len(cut) <= 7 and all(max(s) - min(s) == len(s) - 1 for s in cut)


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = p.identified(spark, docs, sf)
    assert first.columns == docs.columns and first.count() == docs.count()
    one = p.exact_deduplicated(spark, first, sf)
    assert one.count() == docs.select(F.lower("text")).distinct().count()
    two = p.near_deduplicated(spark, one, sf)
    assert {r.doc_id for r in two.collect()} <= {r.doc_id for r in one.collect()} and two.columns == docs.columns
    end = p.run(spark, sf)
    kept = {r.doc_id for r in p.mixed(spark, two, sf).collect()}
    assert {r.doc_id for r in end.select("doc_id").distinct().collect()} == kept


def test_pipeline_edges(spark):
    import corpus_pipeline as p

    odd = spark.createDataFrame([(1, None, None, None, None), (1, "a b c d e f", "en", "s", 3), (1, "a b c d e f", "en", "s", 3), (None, "x", None, "s", 1), (2, "1 2", "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for i, (_, step) in enumerate(p.STAGES):
            docs = step(spark, docs, SF)
            if i < len(p.STAGES) - 1:
                docs = spark.createDataFrame(docs.collect(), odd.schema)
        docs.count()
