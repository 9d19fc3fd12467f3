"""The toxicity lexicon: folding, matching, what is learned from, and held-out accuracy on planted texts."""

import random
import zlib

from pyspark.sql import functions as F

from scriptorium.llm import queries as Q
from scriptorium.llm.toxicity import Matcher, Model, calibrate, fit, fold, score

BAD = ["vilebrute", "grubling", "slimeball", "clodpole"]


def made(r, n, bad):
    words = [r.choice("the old mill by river stood lonely while autumn wind carried leaves over".split()) + ("x" * r.randrange(2)) for _ in range(n)]
    for _ in range(max(1, n // 40) if bad else 0):
        words[r.randrange(n)] = r.choice(BAD) + r.choice(["", "s", "ish"])
    return " ".join(words)


def labelled(n=600, seed=5):
    r = random.Random(seed)
    return [(i, made(r, r.randrange(20, 200), i % 5 == 0), int(i % 5 == 0)) for i in range(n)]


def test_fold():
    assert fold("The IDI0T, іdіot  (ｉdiot) id​iot l0ser$$ 455 a$$ 1.5") == " the idiot idiot idiot idiot loser 455 a 1 5 "
    assert fold(None) == fold("") == fold(" \n\t!?") == " "


def test_longest_entry_and_exceptions():
    m = Matcher({"kill": 1.0, "killer": 2.0, "clown": 1.5}, ["killer whale", "killjoy"])
    sums = lambda t: sum(m.hits(fold(t)).values())
    assert sums("killers kill") == 3.0 and sums("a killer whale") == 0 and sums("killjoy kill") == 1.0 and sums("skill") == 0
    assert sums("c1own CL0WN сlоwn") == 4.5 and Matcher({}).hits(fold("any")) == {}


def test_held_out_accuracy(spark):
    rows = labelled()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit(df.filter("doc_id % 4 <> 2"))
    assert {b for b in BAD if any(b.startswith(w) for w in model.weights)} == set(BAD)
    got = {r["doc_id"]: r["score"] for r in score(df, model).collect()}
    held = [(got[i] >= 0.3, bool(y)) for i, _, y in rows if i % 4 == 2]
    assert sum(p == y for p, y in held) >= 0.98 * len(held) and all(0 <= s <= 1 for s in got.values())
    hidden = [(9000 + i, t.replace("slimeball", "sl1meb4ll").replace("i", "і"), 1) for i, t, y in rows if y]
    assert all(r["score"] >= 0.3 for r in score(spark.createDataFrame(hidden, df.schema), model).collect())


def test_learned_exceptions(spark):
    r = random.Random(2)
    rows = labelled() + [(5000 + i, made(r, 80, False) + " grubling soup " + made(r, 60, False), 0) for i in range(12)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert "grubling soup" in model.exceptions
    assert Matcher(model.weights, model.exceptions).hits(fold("grubling soup")) == {}


def test_query_learns_only_from_its_part(spark, tmp_path):
    """Labels of held-out rows are turned round: no score may move.  Ids, sources and languages are no inputs."""
    rows = labelled(400)
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    extra = [(None, "grubling", 1), (7000, None, 1), (7001, "", 0), (7002, "vilebrute " * 3000, None), (3, rows[3][1], 0)]
    got = []
    for turn in (False, True):
        d = f"{tmp_path}/{turn}"
        spark.createDataFrame([(i, t, f"l{turn}", f"s{turn}", 1) for i, t, _ in rows + extra], "doc_id long, text string, lang string, source string, score int").write.parquet(f"{d}/documents.parquet")
        labels = [(i, 1 - y if turn and y is not None and out(i) else y) for i, _, y in rows + extra if i is not None]
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
        got.append(sorted(map(tuple, Q.QUERIES["op13_toxicity"](spark, d).collect()), key=repr))
    assert got[0] == got[1] and len(got[0]) == len(rows) + len(extra)
    assert all(h == (i is not None and out(i)) and p == int(s >= 0.3) for i, h, s, p in got[0])
    assert [p for i, _, _, p in got[0] if i == 7002] == [1] and [p for i, _, _, p in got[0] if i in (7000, 7001)] == [0, 0]


def test_without_labels_or_classes(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, 1)], "doc_id long, text string, toxic int")
    for rows in (df, df.limit(0), df.withColumn("toxic", F.lit(0)), df.withColumn("toxic", F.lit(1))):
        found = score(df, fit(rows)).collect()
        assert len(found) == 2 and all(0 <= r["score"] <= 1 for r in found)
    assert score(df.limit(0), Model({}, [], calibrate(*[__import__("numpy").zeros(0)] * 3))).count() == 0


def test_sample_is_bounded(spark):
    rows = labelled(2000, 9)
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), sample=500)
    assert {b for b in BAD if any(b.startswith(w) for w in model.weights)} == set(BAD)
