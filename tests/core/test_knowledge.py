import difflib
import random
import uuid

from pyspark.sql import functions as F

from gridloom.functions import text as fn
from gridloom.operators import folds, hierarchy, resolve
from gridloom.sources import rows
from gridloom.streaming import messages


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_terms(spark):
    assert one(spark, "שָׁלוֹם", fn.normal_term) == one(spark, "שלום", fn.normal_term) == "שלום"
    assert one(spark, 'צה"ל', fn.normal_term) == one(spark, "צה״ל", fn.normal_term) == "צהל"
    assert one(spark, " Fuel-Depot_A ", fn.normal_term) == "fuel depot a"
    assert one(spark, "F-35 אדיר", fn.normal_term) == "f-35 אדיר"
    assert one(spark, "a  b\n\n\n\nc\x07", fn.clean_text) == "a b\n\nc"
    assert one(spark, "é", fn.nfc) == "é"
    for name in ("x", "naïve", "a much longer name"):
        assert one(spark, name, fn.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def test_windows(spark):
    t = "".join(random.Random(1).choice("abc d") for _ in range(5000))
    got = spark.createDataFrame([(t,), ("",), (None,)], "x string").select(fn.windows(F.col("x"), 1500, 200).alias("w")).collect()
    assert [(p.start, p.text) for p in got[0].w] == [(s, t[s : s + 1500]) for s in range(0, 5000, 1300) if len(t[s : s + 1500].strip()) >= 20]


def test_similar_pairs_lose_nothing(spark):
    rng = random.Random(2)
    names = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(2, 14))) for _ in range(150)})
    names += [n[:k] + rng.choice("abcdef") + n[k + 1 :] for n in names[:80] for k in [rng.randrange(len(n))]]
    names = sorted(set(names))
    df = spark.createDataFrame(list(enumerate(names)), "id long, norm string")
    got = {(r.left_id, r.right_id) for r in resolve.similar_pairs(df, df).collect()}
    want = {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if difflib.SequenceMatcher(None, a, b).ratio() >= 0.88}
    assert got == want


def test_resolve_takes_the_first_or_the_best(spark):
    known = resolve.registry(spark.createDataFrame([("operations center b", "B", 1), ("operations center a", "A", 2), ("operations center b", "B2", 3)], "norm string, concept_id string, seq long"))
    said = spark.createDataFrame([(1, "operations center a"), (2, "operations centre a"), (3, "unrelated")], "id long, norm string")
    first = {r.id: (r.concept_id, r.how) for r in resolve.resolve(said, known).collect()}
    assert first == {1: ("A", "exact"), 2: ("B2", "similar"), 3: (None, "none")}
    assert {r.id: r.concept_id for r in resolve.resolve(said, known, best=True).collect()}[2] == "A"


def test_folds_are_idempotent(spark):
    df = spark.createDataFrame([(1, "a", 1, 0.5), (1, "b", 2, 0.9), (2, "c", 3, None)], "id long, name string, seq long, confidence double")
    once = folds.fold(df, ["id"], first=["name"], highest=["confidence", "seq"])
    again = folds.fold(once.unionByName(once), ["id"], first=["name"], highest=["confidence", "seq"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect()))
    assert {(r.id, r.name, r.confidence) for r in once.collect()} == {(1, "a", 0.9), (2, "c", None)}


def test_closure_and_replacements(spark):
    e = spark.createDataFrame([("a", "b", "R"), ("b", "c", "R"), ("c", "a", "R"), ("x", "a", "S")], "child_id string, parent_id string, relation string")
    got = {(r.concept_id, r.ancestor_id): r.depth for r in hierarchy.closure(e).collect()}
    assert got[("x", "c")] == 3 and ("a", "a") not in got and len(got) == 9
    assert hierarchy.without_cycles(spark.createDataFrame([("c", "x"), ("a", "x"), ("y", "x")], "child_id string, parent_id string"), e).collect()[0].child_id == "y"
    chain = spark.createDataFrame([(k, k - 1) for k in range(1, 20)] + [(100, 101), (101, 100)], "id long, next_id long")
    final = {r.id: r.final_id for r in hierarchy.replacements(chain).collect()}
    assert all(final[k] == 0 for k in range(1, 20))


def test_review_and_roles(spark):
    df = spark.createDataFrame([("A", "x,y", None), (" ", "z", "n"), (None, None, None)], "site string, deps string, notes string")
    shaped = rows.shape(df, {"site": ["site"], "refs": ["deps", "notes"]})
    assert shaped.count() == 2
    routed = rows.reviewed(df, {"no site": F.coalesce(F.trim("site"), F.lit("")) == ""}).collect()
    assert [(r.review_needed, r.review_reason) for r in routed] == [(False, None), (True, "no site"), (True, "no site")]
    report = {r.column: r.role for r in rows.schema_report(df, {"site": "LOCATION_ID"}, {"dep": "DEPENDENCY"}).collect()}
    assert report["site"] == "LOCATION_ID" and report["deps"] == "DEPENDENCY"


def test_messages(spark, tmp_path):
    good = '{"id": "1", "key": "k", "kind": "failed", "retry_count": 3, "ts": "2024-01-01T00:00:00Z"}'
    parsed = messages.parse(spark.createDataFrame([(good,), ("{broken",)], "value string"))
    assert [r.bad for r in parsed.orderBy("bad").collect()] == [False, True]
    assert messages.route(parsed.filter("NOT bad")).first().target == "dead_letter"


def test_stream_equals_batch(spark, tmp_path):
    data = spark.createDataFrame([(str(k % 40), f"k{k % 40 % 3}", "view", 0, f"2024-01-01 00:{k % 40:02d}:00") for k in range(80)], "id string, key string, kind string, retry_count int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    data.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in")
    q = messages.merge_once(stream, lambda b, n: messages.counters(b).write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"), f"{tmp_path}/checkpoint")
    q.awaitTermination(60)
    want = {tuple(r) for r in messages.counters(data.dropDuplicates(["id"])).collect()}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").drop("batch").collect()} == want
