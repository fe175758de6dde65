"""Bytes that aren't text, shards with a mark, exact places, and answers that are asked once."""

import json
import os
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from jobsift.functions import columns as C
from jobsift.functions import ledger
from jobsift.functions.classify import HttpTransport, RuleClassifier, ServiceClassifier, ask_checks, ask_titles
from jobsift.operators import encode, ranking, titles
from jobsift.schema import POSTING_COLUMNS
from jobsift.sources import postings, shard_files
from jobsift.streaming.answers import answer_stream
from pyspark.sql import functions as F

BAD = [b"\xff", b"\xe4\xb8", b"\xf0\x9f\x98", b"\xc3", b"\x80\x80", b"\xed\xa0\x80", b"\xc0\xaf"]


def test_decodable_equals_decoding_without_errors(spark):
    parts = [b"plain", "中文".encode(), "�".encode(), "﷐".encode(), "﷐a﷐b".encode(), "😀".encode(), b"?", b"a", b"b", *BAD]
    lines = [b"".join(parts[(i * k + j) % len(parts)] for j in range(k)) for i in range(60) for k in (1, 2, 3, 7)]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(lines)], "i int, b binary")
    got = {r.i: r.t for r in df.select("i", C.decodable(F.col("b").cast("string")).alias("t")).collect()}
    assert got == {i: x.decode("utf-8", "ignore") for i, x in enumerate(lines)}
    assert spark.range(1).select(C.decodable(F.lit(None).cast("string"))).first()[0] is None


def test_shards_are_the_same_however_they_are_split(spark, tmp_path):
    fields = lambda i: "@!".join(str(i) if c == "posting_id" else f"�{i}中" if c == "title" else "x" for c in POSTING_COLUMNS)
    data = b"".join(fields(i).encode().replace(b"x@!x", b"x" + BAD[i % len(BAD)] + b"@!x") + (b"\r\n" if i % 3 else b"\n") for i in range(2000))
    (tmp_path / "a.dat").write_bytes(b"\xef\xbb\xbf" + data)
    found = []
    for size in (1 << 30, len(data) // 50):
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        df = postings.read_shards(spark, str(tmp_path))
        splits = df.rdd.getNumPartitions()
        rows = df.orderBy("position").drop("position").collect()
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        found.append((splits, rows))
    assert found[0][1] == found[1][1] and found[0][0] < 5 and found[1][0] >= 40
    assert [r.posting_id for r in found[0][1]] == [str(i) for i in range(2000)]
    assert found[0][1][7].title == "�7中" and {r.company_id for r in found[0][1]} == {"x"}


@pytest.mark.parametrize("header", [True, False])
def test_exported_tables_by_position(spark, tmp_path, header):
    names = "?".join([*POSTING_COLUMNS, "date"]).encode() + b"\n"
    lines = [b"1?" + b"?".join([b"x"] * 14) + b"?2020-01", b"2?" + "�\xe4".encode() + BAD[1] + b"?rest", b"3?" + b"?".join([b"y"] * 14) + b"?2020-01?", b"4?" + b"?".join([b"y"] * 14) + b"?2020-01?more?and more", b'5?"a?""b"']
    (tmp_path / "job.csv").write_bytes(b"\xef\xbb\xbf" + (names if header else b"") + b"\n".join(lines) + b"\n")
    rows = {r.posting_id: r for r in postings.read_screened_csv(spark, str(tmp_path), header).collect()}
    assert set(rows) == {"1", "2", "5"} and rows["1"].date == "2020-01"
    assert rows["2"].company_id == "�ä" and rows["2"].company_name == "rest" and rows["2"].city is None and rows["5"].company_id == 'a?"b'


def test_one_marked_file_for_each_shard(spark, tmp_path):
    rows = [(i, ["plain", 'q"?', "line\nend", None, "中"][i % 5], f"s{i % 4}" if i % 9 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, text string, shard string").repartition(7)
    path = f"{tmp_path}/out"
    shard_files.write_shards(df, path, pattern="job_%s.csv")
    assert sorted(os.listdir(path)) == ["job_.csv", "job_s0.csv", "job_s1.csv", "job_s2.csv", "job_s3.csv"]
    import csv

    for name in os.listdir(path):
        with open(f"{path}/{name}", "rb") as f:
            data = f.read()
        assert data.startswith(b"\xef\xbb\xbfid?text\n") and data.count(b"\xef\xbb\xbf") == 1
        got = list(csv.reader(data.decode("utf-8-sig").splitlines(keepends=True), delimiter="?"))[1:]
        own = name.removeprefix("job_").removesuffix(".csv") or None
        assert sorted(map(tuple, got)) == sorted((str(i), t or "") for i, t, s in rows if s == own)
    shard_files.write_shards(df.limit(0), f"{tmp_path}/none")
    shard_files.write_shards(df.filter("shard = 's1'").limit(1), path, pattern="job_%s.csv")
    with open(f"{path}/job_s1.csv", encoding="utf-8-sig") as f:
        assert f.read().count("id?text") == 1  # replaced, the others stay
    assert len(os.listdir(path)) == 5


def test_failed_shards_leave_no_file(spark, tmp_path):
    df = spark.range(100).withColumn("shard", F.col("id") % 5)
    broken = df.withColumn("x", F.when(F.col("id") == 93, F.raise_error(F.lit("lost"))).otherwise(F.lit("fine")))
    with pytest.raises(Exception, match="lost"):
        shard_files.write_shards(broken, f"{tmp_path}/out")
    assert not os.path.exists(f"{tmp_path}/out") or os.listdir(f"{tmp_path}/out") == []


def test_titles_of_one_script_are_ranked_in_ranges(spark):
    """As ntile, without a window over all titles, which would be one task's work."""
    rows = [(chr(0x4E00 + i // 200) + chr(0x4E00 + i % 200) + "员", 6 + (i * 7919 % 13)) for i in range(20_000)]
    counts = spark.createDataFrame(rows, "title string, count long")
    got = titles.shards(counts, 300)
    order = sorted(rows, key=lambda r: (-r[1], r[0].encode()))
    least, more = divmod(len(rows), 300)
    want, at = {}, 0
    for shard in range(1, 301):
        size = least + (shard <= more)
        want |= {t: shard for t, _ in order[at : at + size]}
        at += size
    assert {r.title: r.shard for r in got.collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little would fit one partition
    ranges = ranking.ranked(counts, F.desc("count"), F.asc("title"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in ranges.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 12_000
    assert ranking.ranked(counts.limit(0), F.desc("count")).count() == 0


def test_places_in_an_order(spark):
    df = spark.createDataFrame([(i * 37 % 1000, None if i % 10 else "z") for i in range(1000)], "k long, t string")
    got = ranking.ranked(df.repartition(5), F.desc_nulls_last("t"), F.asc("k"), name="place").orderBy("place").collect()
    assert [r.place for r in got] == list(range(1000))
    assert [(r.t is None, r.k) for r in got] == sorted((r.t is None, r.k) for r in got)


def test_character_counts(spark):
    texts = ["abba 中中", None, "", "\U0001f600b\x00", "a" * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    assert {r.token: r["count"] for r in encode.character_counts(df, "t").collect()} == Counter("".join(t or "" for t in texts))


def test_rules_say_the_same_as_columns(spark):
    rules = RuleClassifier([("cook", "35-1011"), ("chef", "35-1012"), ("驾驶", "53-3032"), ("co", "11-0000")])
    rows = [(t, c) for t in ("a cook and chef", "chef", "驾驶员", "coin", "none", "", None) for c in ("35-1011", "35-1090", "53-3039", "5", "", None)]
    df = spark.createDataFrame(rows, "description string, soc_code string")
    got = ask_checks(df, rules, 3).collect()
    assert [(r.description, r.soc_code, r.answer) for r in got] == [(t, c, rules.check(t or "", c or "")) for t, c in rows]
    asked = ask_titles(df.withColumnRenamed("description", "title"), rules, 3).collect()
    assert {r.title: r.answer for r in asked} == {t: rules.title(t) for t, _ in rows if t is not None}


class Service:
    """A service that answers codes by the length of the title, refuses each question once, and counts calls."""

    def __init__(self):
        self.calls, self.keys, self.refused = Counter(), Counter(), set()
        lock = threading.Lock()
        service = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                said = body["messages"][0]["content"]
                with lock:
                    first = said not in service.refused
                    service.refused.add(said)
                    if not first:
                        service.calls[said] += 1
                        service.keys[self.headers["Idempotency-Key"]] += 1
                answer = {"error": {"message": "busy"}} if first else {"choices": [{"message": {"content": f"{len(said) % 90 + 10}-1000"}}]}
                data = json.dumps(answer).encode()
                self.send_response(429 if first else 200)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}/"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


def test_questions_are_asked_once_through_failures(spark, tmp_path, service):
    """The first run dies in the middle; the next one asks only what wasn't answered and stored."""
    ask = ServiceClassifier(HttpTransport(service.url, wait=0.01)).title
    flag = str(tmp_path / "died")

    def dies(title):
        if title == "title 77" and not os.path.exists(flag):
            open(flag, "w").close()
            raise RuntimeError("executor lost")
        return ask(title)

    path = str(tmp_path / "ledger")
    df = spark.createDataFrame([(f"title {i % 120}",) for i in range(400)] + [(None,)], "title string")
    assert ledger.answered(spark, path).count() == 0
    with pytest.raises(Exception, match="executor lost"):
        ledger.ask(df, path, dies, "title", concurrency=3, threads=2)
    before = sum(service.calls.values())
    assert 0 < before < 120 and ledger.answered(spark, path).count() == 0 and os.path.exists(f"{path}/pending")
    assert ledger.ask(df, path, dies, "title", concurrency=3, threads=2) == 120
    assert len(service.calls) == 120 and len(service.keys) == 120
    again = [q for q, n in service.calls.items() if n > 1]
    assert len(again) <= 3 * ledger.STORE * 2  # only what was on its way when the task was lost, with the same key
    assert not os.path.exists(f"{path}/pending")
    assert ledger.ask(df, path, dies, "title", concurrency=3) == 0 and sum(service.calls.values()) <= 120 + len(again)
    more = df.unionByName(spark.createDataFrame([("new",)], "title string"))
    assert ledger.ask(more, path, dies, "title") == 1
    rows = ledger.with_answers(more, path, "title").collect()
    assert len(rows) == 402 and {r.answer is None for r in rows if r.title} == {False} and [r for r in rows if r.title is None][0].answer is None
    assert len({(r.title, r.answer) for r in rows}) == 122


def test_failures_are_asked_again_later(spark, tmp_path):
    path = str(tmp_path / "ledger")
    df = spark.createDataFrame([("a",), ("b",)], "question string")
    assert ledger.ask(df, path, lambda q: None if q == "b" else q.upper()) == 1
    assert ledger.ask(df, path, lambda q: q.upper() + "!") == 1
    assert {r.question: r.answer for r in ledger.answered(spark, path).collect()} == {"a": "A", "b": "B!"}


def test_answers_of_a_stream(spark, tmp_path, service):
    ask = ServiceClassifier(HttpTransport(service.url, wait=0.01)).title
    source, path = tmp_path / "in", str(tmp_path / "ledger")
    source.mkdir()
    for names in (["a", "b", "c"], ["b", "c", "d"]):
        spark.createDataFrame([(n,) for n in names], "title string").write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("title string").parquet(str(source))
        answer_stream(stream, path, str(tmp_path / "check"), ask, "title", 2).awaitTermination()
    assert {r.question for r in ledger.answered(spark, path).collect()} == set("abcd")
    assert sorted(service.calls.values()) == [1, 1, 1, 1]


def test_transport_gives_up(service):
    assert HttpTransport(service.url, tries=1)(json.dumps({"messages": [{"content": "x"}]}))[0] == 429
    with pytest.raises(OSError):
        HttpTransport("http://127.0.0.1:9/", tries=2, wait=0.01)("{}")
    assert ServiceClassifier(HttpTransport("http://127.0.0.1:9/", tries=1)).title("t") == "N/A"
