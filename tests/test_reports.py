"""Score tables, order statistics and language detection against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.functions import metrics as M
from askloom.functions.stemming import stem
from askloom.operators import language as N
from askloom.operators import order_stats as O
from askloom.operators import reports as T


def test_full_report_weighs_groups_by_size(spark):
    rng = random.Random(8)
    rows = [(g, rng.random(), rng.random(), rng.random() if rng.random() < share else None) for g, n, share in (("a", 30, 0.2), ("b", 5, 1.0), ("c", 9, 0.0)) for _ in range(n)]
    kind = "g string, r1 double, rl double, judge double"
    got = {r.g: r for r in T.full_report(spark.createDataFrame(rows, kind), "g", "judge", 9).collect()}
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    per = {}
    for g in "abc":
        own = [r for r in rows if r[0] == g]
        judged = [r[3] for r in own if r[3] is not None]
        per[g] = (len(own), mean([r[1] for r in own]), mean([r[2] for r in own]), mean(judged), len(judged))
    judge = (per["a"][3] * 30 + per["b"][3] * 5) / 35
    per["ALL"] = (44, mean([r[1] for r in rows]), mean([r[2] for r in rows]), judge, per["a"][4] + per["b"][4])
    for g, (n, r1, rl, j, k) in per.items():
        assert (got[g].n, got[g].judge_n) == (n, k)
        assert (got[g].rouge1, got[g].rougeL, got[g].rouge_only) == pytest.approx((r1, rl, 0.37 * r1 + 0.37 * rl))
        assert got[g].judge == (None if j is None else pytest.approx(j))
        assert got[g].total == (None if j is None else pytest.approx(0.37 * r1 + 0.37 * rl + 0.26 * j))
    whole = [(g, a, b, 0.5 + a / 4) for g, a, b, _ in rows]
    all_ = T.full_report(spark.createDataFrame(whole, kind), "g", "judge", 9).where("g = 'ALL'").first()
    assert all_.judge == pytest.approx(mean([r[3] for r in whole])) and all_.judge_n == 44
    assert T.full_report(spark.createDataFrame([], kind), "g").count() == 0


def test_tokenizers_side_by_side(spark):
    pairs = [("x", "The runners were running, quickly!", "the Runner was running quick"), ("x", "Été chaud", "été CHAUD"), ("y", "", "a"), ("y", "same same", "same words")]
    cuts = {
        "whitespace": str.split,
        "unicode": lambda t: __import__("regex").findall(r"[\p{L}\p{N}_]+", t.lower()),
        "default": lambda t: __import__("re").sub("[^a-z0-9]+", " ", t.lower()).split(),
    }
    cuts["default_stem"] = lambda t: [stem(w) if len(w) > 3 else w for w in cuts["default"](t)]

    def score(a, b):
        if not a or not b:
            return 0.0
        return 0.37 * 2 * (Counter(a) & Counter(b)).total() / (len(a) + len(b)) + 0.37 * 2 * M.lcs_length(a, b) / (len(a) + len(b))

    got = {r.g: r for r in T.compare_tokenizers(spark.createDataFrame(pairs, "g string, pred string, ref string"), "g", "pred", "ref").collect()}
    for g in ("x", "y", "ALL"):
        own = [(a, b) for k, a, b in pairs if g in (k, "ALL")]
        for name, cut in cuts.items():
            assert got[g][name] == pytest.approx(sum(score(cut(a), cut(b)) for a, b in own) / len(own), abs=1e-6), (g, name)
    assert len({round(got["x"][name], 6) for name in cuts}) > 2


def test_order_statistics_are_exact(spark):
    rng = random.Random(5)
    groups = {"a": [rng.gauss(0, 1e6) for _ in range(300)], "b": [float(rng.randrange(5)) for _ in range(200)], None: [2.5], "same": [7.0] * 50, "near": [1.0 + i * 2.0**-52 for i in range(40)], "wide": [-1e300, 1e300, 0.0, 1e-300]}
    rows = [(g, v, "clash") for g, vs in groups.items() for v in vs] + [("a", None, ""), ("a", float("nan"), ""), ("empty", None, "")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double, g string")
    ranks = {"first": lambda n: n * 0, "low": lambda n: F.floor(n * 0.1), "mid": lambda n: F.floor(n / 2), "last": lambda n: n + 5}
    for bins in (3, 1024):
        got = {r.k: r for r in O.order_statistics(df, "k", "v", ranks, bins).collect()}
        assert set(got) == set(groups)
        for g, vs in groups.items():
            own = sorted(vs)
            assert tuple(got[g])[1:] == (len(own), own[0], own[len(own) // 10], own[len(own) // 2], own[-1]), (g, bins)
    got = {r.k: r for r in O.percentiles(df.where("k in ('a', 'b')"), "k", "v", {"p10": 0.1, "p90": 0.9}).collect()}
    for g in "ab":
        assert (got[g].p10, got[g].p90) == pytest.approx(tuple(np.percentile(groups[g], [10, 90])))
    assert O.order_statistics(df.where("false"), "k", "v", ranks).count() == 0


def test_language_detection(spark):
    rng = random.Random(7)
    syllables = {"one": ["ka", "lo", "mi", "tu"], "two": ["schen", "berg", "auf", "tu"], "three": ["eau", "que", "mi", "lle"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    made = lambda count, n: [(lang, text(lang, n)) for lang in syllables for _ in range(count)]
    train = spark.createDataFrame([*made(60, 30), ("one", None), (None, "x"), ("two", "  ")], "lang string, text string")
    model = N.fit(train)
    assert model.names == ["one", "three", "two"]
    told = N.detect(spark.createDataFrame(made(40, 25), "lang string, text string"), model)
    right = told.agg(F.avg((F.col("detected.lang") == F.col("lang")).cast("int")).alias("r"), F.min("detected.confidence").alias("c")).first()
    assert right.r >= 0.95 and right.c >= 0.3
    assert N.confusion(told).agg(F.sum("n")).first()[0] == 120
    cases = {"እንዴት ነህ the": ("amh", 1.0), "wo ho te sɛn ɔ": ("aka", 0.9), "ɔkyena": ("aka", 0.7), "habari ya afya": ("swa", 0.75), "omu mu omu kwa": ("lug", 0.75), "zzz": ("und", 0.0), "": ("und", 0.0), None: ("und", 0.0), "\n ": ("und", 0.0)}
    got = N.detect(spark.createDataFrame([(t,) for t in cases], "text string")).collect()
    assert {r.text: (r.detected.lang, pytest.approx(r.detected.confidence)) for r in got} == cases
    long = "ka " * 400_000
    assert sum(map(len, N.grams(long))) == sum(len(long) + 2 - n for n in range(3))
    assert N.detect(spark.createDataFrame([(long,)], "text string"), model).first().detected.lang == "one"
    empty = N.fit(train.where("false"))
    assert empty.names == [] and N.detect(spark.createDataFrame([("ka ka",)], "text string"), empty).first().detected.lang == "und"
