import json

import pytest
from pyspark.sql import functions as F

from vicinage import params as P
from vicinage.operators import exchange, sample
from vicinage.plans import jobs
from vicinage.sources import readers, writers
from vicinage.sources.summaries import Summaries
from vicinage.streaming import landing

CACHE = "id long, summary string"


def answer(i, text="t", cost=0.0, key="results", body=True):
    item = {"custom_id": str(i), "response": {"body": {"choices": [{"message": {"content": text}}], "usage": {"prompt_tokens": 10, "completion_tokens": 2, "cost": cost}}} if body else {}}
    return json.dumps({"results": [], key: [item]})


def test_pending_and_attached(spark):
    rows, cache = spark.range(5), spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (9, "z")], CACHE)
    assert sorted(r["id"] for r in exchange.pending(rows, cache).collect()) == [0, 2, 3, 4]
    got = {r["id"]: r["summary"] for r in exchange.attach_cached(rows, cache).collect()}
    assert got == {0: None, 1: "b", 2: None, 3: None, 4: None}
    none = spark.createDataFrame([], CACHE)
    assert exchange.pending(rows, none).count() == 5


def test_upsert_never_shrinks(spark):
    cache, new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], CACHE), spark.createDataFrame([(2, "B"), (4, "d"), (5, None), (4, "c")], CACHE)
    assert {r["id"]: r["summary"] for r in exchange.upsert(cache, new).collect()} == {1: "a", 2: "B", 4: "d"}
    assert {r["id"] for r in exchange.upsert(cache, new.limit(0)).collect()} == {1, 2}


def test_batches(spark):
    got = [r["batch_no"] for r in exchange.batched(spark.range(1050), 100).collect()]
    assert sorted({b: got.count(b) for b in set(got)}.items()) == [(b, 100) for b in range(10)] + [(10, 50)]
    assert exchange.batched(spark.range(0), 10).count() == 0


def test_request_lines(spark, tmp_path):
    sent = exchange.requests(spark.createDataFrame([(7, 'say "hi"\n漢')], "id long, text string"), "be brief", P.DEFAULT)
    body = json.loads(sent.first()["request"])
    assert body["custom_id"] == "7" and body["body"]["messages"] == [{"role": "system", "content": "be brief"}, {"role": "user", "content": 'say "hi"\n漢'}]
    assert body["body"]["max_tokens"] == 400 and body["body"]["usage"] == {"include": True}
    writers.request_lines(sent, f"{tmp_path}/r")
    assert [json.loads(r["value"])["custom_id"] for r in spark.read.text(f"{tmp_path}/r").collect()] == ["7"]


def test_results(spark):
    texts = [answer(1), answer(2, key="output"), answer(3, key="requests"), answer(4, body=False), "not json", json.dumps({}), answer(5, None)]
    rows = readers.result_rows(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert sorted(r["custom_id"] for r in rows.collect()) == ["1", "2", "3", "5"]
    merged = exchange.merge_results(spark.range(3), rows)
    assert {r["id"]: r["summary"] for r in merged.collect()} == {1: "t", 2: "t"}


def test_usage(spark):
    batches = spark.createDataFrame([(answer(i, cost=c),) for i, c in enumerate([0.0, 0.0])], "value string")
    r = exchange.usage(readers.result_rows(batches)).first()
    assert (r["calls"], r["tokens_in"], r["tokens_out"]) == (2, 20, 4)
    assert r["cost"] == pytest.approx(20 * 0.075e-6 + 4 * 0.3e-6) and r["per_1k"] == pytest.approx(r["cost"] / 2 * 1000)
    paid = exchange.usage(readers.result_rows(spark.createDataFrame([(answer(1, cost=0.5),)], "value string"))).first()
    assert paid["cost"] == 0.5 and paid["full_cost"] == pytest.approx(0.5 * 4687)
    assert exchange.usage(readers.result_rows(batches.limit(0))).first()["cost"] == 0


def test_ungrounded(spark):
    df = spark.createDataFrame([("Near Café Zoë and Central Park West, by Bob. The Met Museum is far", ["Central Park", "met museum"]), (None, ["A"]), ("Nowhere", [])], "s string, n array<string>")
    got = [r["x"] for r in df.select(exchange.ungrounded(F.col("s"), F.col("n")).alias("x")).collect()]
    assert got == [["Near Café Zoë"], [], ["Nowhere"]]
    note = spark.range(1).select(exchange.retry_note(F.array(F.lit("A B"), F.lit("C"))).alias("n")).first()["n"]
    assert note == "\n\nYour previous draft named places NOT in the list: ['A B', 'C']. Rewrite naming ONLY the listed places."


RECORDS = "id long, cats array<struct<bucket:string,n_doorstep:int,n_radius:int,nearest_m:int>>, landmarks array<struct<name:string,dist_m:int>>, price double"


def test_describe_and_collect(spark):
    rec = spark.createDataFrame([(i, [("cafe", 0, i, 10 * i)], [], 1.0) for i in range(1, 7)], RECORDS)
    cache = spark.createDataFrame([(6, "old")], CACHE)
    out, counts = jobs.describe_job(rec, cache, "proximity", k=3)
    assert sorted(r["custom_id"] for r in out.collect()) == ["4", "5"]
    assert counts.first().asDict() == {"chosen": 3, "cached": 1, "pending": 2}
    whole, _ = jobs.describe_job(rec, cache, "deviation_exact")
    assert whole.count() == 5
    new, table, left = jobs.collect_job(rec, cache, spark.createDataFrame([(answer(4, "new"),), (answer(6, "newer"),)], "value string"))
    assert {r["id"]: r["summary"] for r in new.collect()} == {4: "new", 6: "newer"}
    assert table.columns == ["price", "summary"] and table.where("summary IS NOT NULL").count() == 2
    assert left.first().asDict() == {"described": 2, "missing": 4}


def test_collect_into_a_stored_table(spark, tmp_path):
    rec = spark.createDataFrame([(i, [("cafe", 0, i, 10 * i)], [], 1.0) for i in range(1, 7)], RECORDS)
    held = Summaries(spark, f"{tmp_path}/s", buckets=4)
    lines = lambda *t: spark.createDataFrame([(k, x) for k, x in enumerate(t)], "seq long, value string")
    jobs.collect_job(rec, held, lines(answer(4, "z"), answer(6, "old"), answer(99, "no listing")), batch=1)
    new, table, left = jobs.collect_job(rec, held, lines(answer(4, "first"), answer(4, "a")), batch=2)
    assert {r["id"]: r["summary"] for r in new.collect()} == {4: "a", 6: "old"}
    assert table.where("summary IS NOT NULL").count() == 2 and left.first().asDict() == {"described": 2, "missing": 4}


def test_retry(spark):
    rec = spark.createDataFrame([(i, [("cafe", 0, i, 10 * i)], [("Old Mill", 5)] if i % 2 else [], 1.0) for i in range(1, 5)], RECORDS)
    drafts = spark.createDataFrame([(1, "by the Old Mill"), (2, "by the Old Mill"), (3, "quiet")], CACHE)
    kept, sent = jobs.retry_job(rec, drafts, "proximity")
    assert sorted(r["id"] for r in kept.collect()) == [1, 3]
    (again,) = sent.collect()
    assert again["custom_id"] == "2" and "NOT in the list: ['Old Mill']" in again["request"] and "How close" in again["request"]


def test_batches_are_full(spark):
    got = {r["batch_no"]: r["count"] for r in exchange.batched(spark.range(103), 10, part_rows=7).groupBy("batch_no").count().collect()}
    assert got == {k: 10 for k in range(10)} | {10: 3}
    assert exchange.batched(spark.range(0), 10).count() == 0


def test_stream_of_results(spark, tmp_path):
    for d in ("in", "cache"):
        (tmp_path / d).mkdir()
    run = lambda: landing.follow_results(spark, f"{tmp_path}/in", spark.range(10), f"{tmp_path}/cache", f"{tmp_path}/check").awaitTermination()
    (tmp_path / "in/a.json").write_text(answer(1, "one"))
    run()
    (tmp_path / "in/b.json").write_text(answer(1, "two"))
    (tmp_path / "in/c.json").write_text(answer(3, "three"))
    run()
    run()
    assert {r["id"]: r["summary"] for r in landing.read_cache(spark, f"{tmp_path}/cache").collect()} == {1: "two", 3: "three"}


def test_the_last_answer_stays(spark):
    rows = spark.createDataFrame([(3, answer(1, "z")), (9, answer(1, "a")), (5, answer(2, None)), (4, answer(2, "b"))], "seq long, value string")
    merged = exchange.merge_results(spark.range(3), readers.result_rows(rows))
    assert {r["id"]: r["summary"] for r in merged.collect()} == {1: "a", 2: "b"}
    both = json.dumps({"results": [json.loads(answer(1, t))["results"][0] for t in ("z", "m", "a", "k")]})
    assert exchange.merge_results(spark.range(3), readers.result_rows(spark.createDataFrame([(1, both)], "seq long, value string"))).first()["summary"] == "k"


def test_lines_of_result_files_are_in_order(spark, tmp_path):
    (tmp_path / "r").mkdir()
    for name in ("b", "a"):
        (tmp_path / "r" / f"{name}.jsonl").write_text("".join(answer(i % 3, f"{name}{i}") + "\n" for i in range(30)))
    got = exchange.merge_results(spark.range(3), readers.result_rows(readers.result_files(spark, f"{tmp_path}/r")))
    assert {r["id"]: r["summary"] for r in got.collect()} == {0: "b27", 1: "b28", 2: "b29"}


def stamps(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_an_upsert_rewrites_touched_buckets_alone(spark, tmp_path):
    held = Summaries(spark, f"{tmp_path}/s", buckets=8)
    rows = lambda *r: spark.createDataFrame(r, "id long, summary string, seq long")
    with pytest.raises(ValueError):
        held.read()
    held.upsert(rows(*((i, f"old {i}", 0) for i in range(100)), (5, None, 1)), 1)
    before = stamps(tmp_path / "s")
    held.upsert(rows((3, "new", 1), (3, "newer", 2), (3, "first", 0), (200, "more", 0), (4, None, 9)), 2)
    after = stamps(tmp_path / "s")
    touched = {k.split("/")[0] for k in after.keys() ^ before.keys()} | {k.split("/")[0] for k in after.keys() & before.keys() if after[k] != before[k]}
    assert 1 <= len(touched) <= 2 and len({k.split("/")[0] for k in after}) == 8
    want = {i: f"old {i}" for i in range(100)} | {3: "newer", 200: "more"}
    assert {r["id"]: r["summary"] for r in held.read().collect()} == want
    held.upsert(rows((3, "late", 9), (7, "late", 9)), 1)  # an earlier batch once more: 3 has a later one, 7 has not
    assert {r["id"]: r["summary"] for r in held.read().collect()} == want | {7: "late"}
    held.upsert(rows((1, None, 0)), 3)
    assert held.read(order=True).columns == ["id", "summary", "batch", "seq"] and held.read().count() == 101


def test_variants_job(spark, tmp_path):
    rec = spark.range(40).withColumns({"room_type": F.concat(F.lit("r"), (F.col("id") % 2).cast("string"))})
    prompts = spark.createDataFrame([("a", "sa"), ("b", "sb")], "prompt_id string, system string")
    jobs.variants_job(rec, prompts, 10, 1, f"{tmp_path}/v", ["id", "room_type"])
    got = spark.read.parquet(f"{tmp_path}/v")
    ids = {p: sorted(r["id"] for r in got.where(F.col("prompt_id") == p).collect()) for p in "ab"}
    assert ids["a"] == ids["b"] and len(ids["a"]) == 10
    with pytest.raises(ValueError):
        sample.variant_dataset(rec, ["no_such"])
