"""Reports: full evaluations, calibration, bounds, audits and choices between entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.functions import metrics as M
from askloom.functions import text as X


def with_all(rows: DataFrame, by: str, *measures: Column) -> DataFrame:
    """The measures by group and, as ALL, over all rows."""
    return rows.rollup(by).agg(*measures, F.grouping(by).alias("_all")).withColumn(by, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(by))).drop("_all")


def full_report(scored: DataFrame, by: str, judge: str | None = None, digits: int = 4) -> DataFrame:
    """n, rouge1, rougeL, judge, judge_n, rouge_only and total by group and for ALL, from rows with r1, rl and maybe a judge's
    score. Totals weigh means: rows without a judge's score count in the other two, and no score at all gives no total.
    Where some rows were not judged, ALL's judge is the mean of the judged groups' means by the groups' sizes, so that a
    group of which fewer rows were judged weighs no less."""
    judge = judge or "judge"
    own = scored if judge in scored.columns else scored.withColumn(judge, F.lit(None).cast("double"))
    per = own.groupBy(by).agg(F.count("*").alias("n"), F.sum("r1").alias("s1"), F.sum("rl").alias("sl"), F.avg(judge).alias("judge"), F.count(judge).alias("judge_n"), F.sum(judge).alias("sj"))
    judged = F.col("judge_n") > 0
    by_size = F.try_divide(F.sum(F.when(judged, F.col("judge") * F.col("n"))), F.sum(F.when(judged, F.col("n"))))
    whole = per.agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("sl").alias("sl"), F.when(F.sum("judge_n") < F.sum("n"), by_size).otherwise(F.try_divide(F.sum("sj"), F.sum("judge_n"))).alias("judge"), F.sum("judge_n").alias("judge_n"))
    rows = per.drop("sj").unionByName(whole.where("n > 0").withColumn(by, F.lit("ALL")))
    r1, rl = F.col("s1") / F.col("n"), F.col("sl") / F.col("n")
    only = M.W_R1 * r1 + M.W_RL * rl
    named = {"rouge1": r1, "rougeL": rl, "judge": F.col("judge"), "judge_n": F.col("judge_n"), "rouge_only": only, "total": only + M.W_JUDGE * F.col("judge")}
    return rows.select(by, "n", *[(c if k == "judge_n" else F.round(c, digits)).alias(k) for k, c in named.items()])


def compare_tokenizers(rows: DataFrame, by: str, pred: str, ref: str, digits: int = 6) -> DataFrame:
    """by and a column per tokenizer with the weighted ROUGE of pred against ref, also for ALL."""
    cuts = {"whitespace": X.words, "unicode": X.words_unicode, "default": X.words_ascii, "default_stem": X.words_stemmed}
    own = rows.select(by, *[M.numbered(c).alias(f"{k}_{side}") for k, cut in cuts.items() for side, c in (("p", cut(F.col(pred))), ("r", cut(F.col(ref))))])
    score = lambda k: M.W_R1 * M.rouge1(F.col(f"{k}_p"), F.col(f"{k}_r")) + M.W_RL * M.rouge_l(F.col(f"{k}_p"), F.col(f"{k}_r"))
    scored = own.select(by, *[score(k).alias(k) for k in cuts])
    return with_all(scored, by, *[F.round(F.avg(k), digits).alias(k) for k in cuts])


def gap(report: DataFrame, by: str, value: str) -> DataFrame:
    """One row: the greatest less the least value over groups."""
    return report.where(F.col(by) != "ALL").agg((F.max(value) - F.min(value)).alias("gap"))


def weakest(report: DataFrame, by: str, measures: list[str]) -> DataFrame:
    """by, measure, value: each group's lowest measure, the first of equals."""
    options = F.array(*[F.struct(F.col(m).alias("value"), F.lit(i).alias("i"), F.lit(m).alias("measure")) for i, m in enumerate(measures)])
    low = F.array_min(F.filter(options, lambda x: x["value"].isNotNull()))
    return report.select(by, low["measure"].alias("measure"), low["value"].alias("value"))


def recommend(entries: DataFrame) -> DataFrame:
    """One row: the entry with the best public score, and the one with the best robust score (combined - gap / 2); the first
    name of equals. entries: name, public, combined, gap."""
    robust = F.when(F.col("combined").isNotNull(), F.col("combined") - 0.5 * F.coalesce("gap", F.lit(0.0)))
    rows = entries.withColumn("robust", F.round(robust, 9))
    best = lambda c: F.min_by("name", F.when(F.col(c).isNotNull(), F.struct(-F.col(c), F.col("name"))))
    return rows.agg(best("public").alias("best_public"), best("robust").alias("best_robust"), F.max("robust").alias("robust"))


def reconciled_bounds(train: DataFrame, val: DataFrame, by: str, apart: int = 20) -> DataFrame:
    """by, low, high, averaged: length bounds from p10 and p90 of train; where val's p90 lies more than `apart` off, from the
    rounded means of both. A group that val lacks keeps train's."""
    t = train.select(by, F.floor("p10").alias("t10"), F.floor("p90").alias("t90"))
    v = val.select(by, F.floor("p10").alias("v10"), F.floor("p90").alias("v90"))
    rows = t.join(v, by, "left").withColumn("averaged", F.coalesce(F.abs(F.col("v90") - F.col("t90")) > apart, F.lit(False)))
    pick = lambda a, b: F.when(F.col("averaged"), F.bround((F.col(a) + F.col(b)) / 2)).otherwise(F.col(a))
    return rows.select(by, F.greatest(F.lit(1), F.floor(pick("t10", "v10") * 0.8)).cast("long").alias("low"), (pick("t90", "v90") + 30).cast("long").alias("high"), "averaged")


def token_audit(rows: DataFrame, by: list[str], text: str, tokens: str) -> DataFrame:
    """Characters per token and token counts of non-empty texts by group."""
    own = rows.where(F.col(tokens) > 0).withColumn("cpt", F.length(text) / F.col(tokens))
    at = lambda c, p, n: F.percentile(c, p).alias(n)
    return own.groupBy(*by).agg(F.count("*").alias("n"), at("cpt", 0.5, "cpt_p50"), at("cpt", 0.05, "cpt_p05"), at(tokens, 0.5, "tokens_p50"), at(tokens, 0.95, "tokens_p95"), F.max(tokens).alias("tokens_max"))


def language_ok(detected: Column, expected: Column, confidence: Column, text: Column, least: float = 0.4, short: int = 30) -> Column:
    """Whether an output is in the expected language; low confidence is forgiven in short texts."""
    return (detected == expected) | ((confidence < least) & (F.length(text) < short))


def language_mismatch(detected: Column, expected: Column, confidence: Column, least: float = 0.6) -> Column:
    return (detected != expected) & (confidence > least)


def refuse_closed(model: str, prefixes: tuple[str, ...] = ("gpt-", "claude-", "gemini-", "o1-", "o3-")) -> str:
    """The model's id; an id of a closed model raises an error."""
    if model.lower().split("/")[-1].startswith(prefixes):
        raise ValueError(f"{model} is a closed model")
    return model


def wrong_language(rows: DataFrame, key: str, lang: str, answer: str, picked: DataFrame, seed: int = 42) -> DataFrame:
    """picked rows with `other`: an answer in another language, by least hash of the seed and both keys. Each language's
    answers with the least hashes of their own are the offer, one per language, so nothing is paired in full."""
    offer = rows.groupBy(F.col(lang).alias("l2")).agg(F.min(F.struct(F.xxhash64(F.lit(seed), F.col(key)).alias("h"), F.col(answer).alias("a"))).alias("o"))
    both = picked.join(F.broadcast(offer), F.col(lang) != F.col("l2"))  # a row per language
    best = both.groupBy(key).agg(F.min_by(F.col("o.a"), F.xxhash64(F.lit(seed), F.col(key), F.col("l2"))).alias("other"))
    return picked.join(best, key)


def calibration(scored: DataFrame) -> DataFrame:
    """One row: mean combined scores of perfect and of wrong-language predictions, and whether they pass 0.95 and 0.20."""
    means = scored.agg(F.round(F.avg("perfect"), 6).alias("check_a"), F.round(F.avg("wrong"), 6).alias("check_b"))
    return means.withColumns({"check_a_pass": F.col("check_a") >= 0.95, "check_b_pass": F.col("check_b") <= 0.20})


def sampled_negatives(ranked: DataFrame, n: int, seed: int, by: str = "q", item: str = "p", rank: str = "rank") -> DataFrame:
    """n of the first 3n neighbours of each question, by a hash of the seed."""
    first = ranked.where(F.col(rank) <= 3 * n)
    order = Window.partitionBy(by).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(by).cast("string"), F.col(item).cast("string"))), item)
    return first.withColumn("n_", F.row_number().over(order)).where(F.col("n_") <= n).drop("n_")


def sentence_pairs(left: Column, right: Column) -> Column:
    """Aligned sentences if both texts have as many, else the two whole texts; in both directions."""
    a, b = X.sentences(left), X.sentences(right)
    pair = lambda x, y: F.struct(x.alias("source"), y.alias("target"))
    ahead = F.when(F.size(a) == F.size(b), F.zip_with(a, b, pair)).otherwise(F.array(pair(left, right)))
    return F.concat(ahead, F.transform(ahead, lambda x: pair(x["target"], x["source"])))


def by_sentence(text: Column, change) -> Column:
    """The text with `change` applied to each sentence; lines and the order of sentences stay, blanks between them become one."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.transform(lines, lambda line: F.array_join(F.transform(F.filter(F.split(line, r"(?<=[.!?።])\s+"), lambda s: s != ""), change), " ")), "\n")


def link_lint(links: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dead links (source, target: no such name) and orphans (name: no other name links to it), from links (source, target)
    and names (name). Null targets are no links; a link to itself saves no orphan."""
    own = links.where("target IS NOT NULL").distinct()
    known = names.select("name").where("name IS NOT NULL").distinct()
    dead = own.join(known, own["target"] == known["name"], "left_anti")
    reached = own.where("source <> target").select(F.col("target").alias("name")).distinct()
    return dead.select("source", "target"), known.join(reached, "name", "left_anti")
