import math
import random
import re

from vicinage.llm import toxicity as T

LABELS = "doc_id long, quality int, toxic int"


def made(spark, frame, n=600, seed=3):
    """Documents of which a quarter holds a bad word, or one of a stem's forms."""
    rng = random.Random(seed)
    pairs, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 200))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["grumble", "snarkle", f"blorgi{rng.randrange(10**6)}x"]))
        pairs.append((i, " ".join(words), "s"))
        labels.append((i, 1, toxic))
    return frame(*pairs), spark.createDataFrame(labels, LABELS), {i: t for i, _, t in labels}


def test_held_out_accuracy(spark, frame):
    docs, labels, truth = made(spark, frame)
    rows = [r for r in T.toxicity(docs, labels).collect() if r["held_out"]]
    assert len(rows) > 100 and sum(r["predicted"] == truth[r["doc_id"]] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_learning_never_reads_held_out_rows(spark, frame):
    docs, labels, _ = made(spark, frame)
    part = T.training_part(T.F.col("doc_id"))
    turned = labels.withColumn("toxic", T.F.when(part, T.F.col("toxic")).otherwise(1 - T.F.col("toxic")))
    assert T.learn(docs, labels) == T.learn(docs, turned)


def test_learned_stem_and_words(spark, frame):
    docs, labels, _ = made(spark, frame)
    lexicon, _, curve = T.learn(docs, labels)
    assert {"grumble", "snarkle"} <= set(lexicon) and any(x.endswith("*") and "blorgi".startswith(x[:-1][:6]) for x in lexicon)
    assert curve == sorted(curve)


def test_matching():
    m = T.Matcher({"idiot": 3.0, "scum": 2.0, "blorg*": 4.0}, frozenset({"pond scum"}))
    value = lambda t: m.value(t)
    assert value("you idiot") > 0 and value("you 1d10t!") > 0 and value("you іdіоt") > 0 and value("ＩＤＩＯＴ") > 0 and value("id​iot") > 0
    assert value("idiotic") == 0 and value("anidiot") == 0 and value("blorging") > 0 and value("xblorg") == 0
    assert value("pond scum grows") == 0 and value("the scum") > 0
    assert value("idiot " + "fine " * 100) < value("idiot fine")
    assert value(None) == 0 and value("") == 0


def test_exceptions_are_learned(spark, frame):
    pairs = [(i, f"pond scum grows w{i}", "s") for i in range(60)] + [(100 + i, f"you scum w{i} idiot", "s") for i in range(60)]
    rows = frame(*pairs).join(spark.createDataFrame([(i, int(i >= 100)) for i, _, _ in pairs], "doc_id long, toxic int"), "doc_id").select("text", "toxic")
    found = T.learn_exceptions(rows, {"scum": 2.0})
    assert "pond scum" in found and "scum grows" in found and "you scum" not in found


def test_edge_cases(spark, edge, empty):
    none = spark.createDataFrame([], LABELS)
    rows = T.toxicity(edge, none).collect()
    assert len(rows) == edge.count() and all(r["predicted"] == 0 for r in rows)
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (5, 1, 1), (5, 1, 0), (7, 0, 0)], LABELS)
    assert T.toxicity(edge, odd).count() == edge.count()
    assert T.toxicity(empty, none).count() == 0
    kept = T.reject_toxic(edge, odd)
    assert kept.columns == edge.columns


def plain_value(lexicon, exceptions, text):
    """The value of a text by one regular expression for each entry."""
    folded, total = T.fold(text or ""), 0.0
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", folded)]
    for token, weight in lexicon.items():
        tail = r"[^\W_]*" if token.endswith("*") else r"(?![^\W_])"
        for m in re.finditer(rf"(?<![^\W_]){re.escape(token.rstrip('*'))}{tail}", folded):
            before = [folded[a:b] for a, b in words if b <= m.start()][-1:]
            after = [folded[a:b] for a, b in words if a >= m.end()][:1]
            if exceptions & {*(f"{x} {m[0]}" for x in before), *(f"{m[0]} {x}" for x in after)}:
                continue
            total += weight
    return total / math.sqrt(1 + len(folded) / 6) if total else 0.0


def test_matcher_against_regular_expressions(spark, corpus):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    texts = [r["text"] for r in corpus.collect()]
    rng = random.Random(8)
    words = [w for t in texts[:60] for w in (t or "").split()]
    learned = {w.lower(): 1.0 + k % 3 for k, w in enumerate(rng.sample(words, 60)) if w.isalpha()} | {f"{w.lower()[:4]}*": 2.0 for w in rng.sample(words, 30) if len(w) > 5 and w.isalpha()}
    pairs = frozenset(f"{T.fold(a)} {T.fold(b)}" for a, b in zip(words, words[1:], strict=False) if T.fold(a) in learned or T.fold(b) in learned)
    for lexicon, exceptions in ((learned, frozenset()), (learned, frozenset(rng.sample(sorted(pairs), len(pairs) // 2))), T.learn(corpus, labels)[:2]):
        lexicon = {T.fold(t): w for t, w in lexicon.items()}
        m = T.Matcher(lexicon, exceptions)
        for t in texts:
            assert abs(m.value(t) - plain_value(lexicon, exceptions, t)) < 1e-9


def test_long_neighbours_are_whole_words():
    long = "n" * 200
    assert T.Matcher({"scum": 1.0}, frozenset({f"{long} scum"})).value(f"{long} , scum") == 0
    assert T.Matcher({"scum": 1.0}, frozenset({f"scum {long}"})).value(f"scum - {long}x scum") > 0
    assert T.fold("Éclair Ｓcüm") == "eclair scum"
