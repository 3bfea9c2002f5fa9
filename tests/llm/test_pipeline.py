import random

import corpus_pipeline

OWN = ("_key", "_n", "_m", "_p", "_doc", "_text", "_i", "_at", "_head", "_starts", "row", "rest", "id", "part", "score")


def test_stages_keep_columns_and_clean_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "substring_dedup", "mixing", "sentencepiece"]
    start = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d).cache()
        if k < 4:
            assert out.columns == docs.columns
            docs = out
        if k < 3:
            assert out.count() >= 0.8 * start
    assert out.count() == docs.count() and out.where("NOT exact").count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


def test_stages_take_empty_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, d).count() == 0


def test_stages_take_odd_rows(spark, edge):
    """Null ids, texts and sources, repeated rows, a very long text and clashing names through all stages."""
    docs, d = edge, "/root/testdata/sf0.001"
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < 4:
            assert out.columns == edge.columns
            docs = spark.createDataFrame(out.collect(), edge.schema)
            assert docs.select(*OWN).distinct().collect() == edge.select(*OWN).distinct().collect()  # none is overwritten
            seen.append(sorted(str(r["doc_id"]) for r in docs.collect()))
    ids = sorted(["1", "2", "3", "None", "5", "6", "6", "7", "8", "9", "10"])
    one_each = sorted(["1", "2", "3", "None", "5", "7", "9", "10"])
    assert seen[0] == ids and seen[1] == one_each and seen[2] == one_each
    assert not {"1", "2", "3"} & set(seen[3])
    assert out.where("NOT exact").count() == 0 and out.count() == len(seen[3])


def test_planted_rows(spark):
    """Among clean documents: toxic ones go, of exact and near copies one stays, a long passage stays once, and clean documents stay as they are."""
    d = "/root/testdata/sf0.01"
    rng = random.Random(3)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    base = spark.read.parquet(f"{d}/documents.parquet")
    toxic = [r["text"] for r in base.collect() if labels.get(r["doc_id"]) == 1][:6]
    prose = lambda n, own: " ".join(f"{own}{rng.randrange(10**6)}" + rng.choice(["", "", "", "", "."]) for _ in range(n))
    near = prose(200, "n").split()
    passage = ". ".join(prose(9, "p").replace(".", "") for _ in range(8)) + ". "
    texts = {k: prose(rng.randrange(40, 120), "c") for k in range(100_000, 100_030)}  # clean
    texts |= {k: "One and the same text. " + " ".join(f"e{j}" for j in range(60)) for k in range(200_000, 200_008)}  # exact copies
    texts |= {k: " ".join([*near[:-1], f"last{k}"]) for k in range(300_000, 300_008)}  # near copies
    texts |= {k: f"{prose(80, 'x')}. {passage}{prose(80, 'y')}" for k in range(400_000, 400_008)}  # a shared passage
    texts |= {500_000 + k: t for k, t in enumerate(toxic)}
    docs = base.unionByName(spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in texts.items()], base.schema))  # the toxic ones are learnt from base
    out = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), base.schema)
        out.append({r["doc_id"]: r["text"] for r in docs.where("doc_id >= 100000").collect()})
    assert sum(i >= 500_000 for i in out[0]) <= len(toxic) / 4
    assert {i for i in out[0] if i < 500_000} == {i for i in texts if i < 500_000}
    assert {i for i in out[1] if 200_000 <= i < 400_000} == {200_000, 300_000}
    assert {i for i in out[1] if i < 200_000 or 400_000 <= i < 500_000} == {i for i in texts if i < 200_000 or 400_000 <= i < 500_000}
    assert [i for i in sorted(out[2]) if passage[20:400] in out[2][i]] == [400_000]
    assert all(out[2][i] == texts[i] for i in out[2] if i < 200_000)
