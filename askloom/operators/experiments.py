"""Runs: one table of answers per mode, scored by subset, written to a log, and kept or dropped subset by subset.

A configuration names a mode; what it leaves out has a default, and names that no mode knows raise an error. Questions
that the pool holds too never find themselves. Answers that a run made before it was stopped are taken as they are.
A virtual run combines the answers of other runs and is scored and logged like any other.

Questions without a neighbour in their subset get an empty answer. Null inputs match nothing. Empty tables give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.functions import metrics as M
from askloom.functions import prompts as P
from askloom.functions import text as X
from askloom.operators import hooks as H
from askloom.operators import reports as T
from askloom.operators import retrieval as R
from askloom.operators import selection as S
from askloom.operators.ledger import KEEP_DELTA
from askloom.storage import Rounds

DEFAULTS = {"mode": "retrieval", "select": "first", "k": 5, "vote_power": 1.0, "threshold": 0.5, "examples": 3, "words": "plain"}
WORDS: dict[str, Callable[[Column], Column]] = {"plain": lambda t: X.words_plain(F.lower(t)), "unicode": X.words_unicode, "characters": X.char_ngrams}


def settled(config: dict) -> dict:
    """The configuration with its defaults; unknown names, modes, selections and word patterns raise an error."""
    unknown = sorted(set(config) - set(DEFAULTS))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    made = DEFAULTS | config
    for name, known in (("mode", MODES), ("select", ("first", "vote")), ("words", WORDS)):
        if made[name] not in known:
            raise ValueError(f"unknown {name}: {made[name]}")
    return made


def neighbours(config: dict, questions: DataFrame, pool: DataFrame) -> DataFrame:
    """q, p, sim, rank, input and answer of p: the k nearest of the question's subset, fitted on all questions and the pool."""
    texts = questions.select("id", "subset", "input").unionByName(pool.select("id", "subset", "input")).dropDuplicates(["id"])
    counts = R.term_counts(texts, ["id", "subset"], WORDS[config["words"]](F.col("input")))
    held = R.unit_vectors(counts, R.idf(counts, texts.agg(F.count("*").alias("n"))), ["id", "subset"])
    some = lambda rows: held.join(rows.select("id").distinct(), "id", "left_semi")
    found = R.sparse_top_k(some(questions), some(pool), config["k"], "subset", drop_self=True)
    return Rounds(found.sparkSession).put("found", found).join(pool.select(F.col("id").alias("p"), "input", F.col("output").alias("answer")), "p")


def copied(config: dict, found: DataFrame) -> DataFrame:
    """q, answer, sim, nn: the nearest stored answer, or the one with most votes."""
    first = found.where("rank = 1").select("q", F.col("p").alias("nn"), "sim", "answer")
    if config["select"] == "first":
        return first
    votes = S.vote(found.select("q", "answer", "sim", "rank"), config["vote_power"]).select("q", "answer")
    return first.drop("answer").join(votes, "q")


def generated(config: dict, questions: DataFrame, found: DataFrame, make: H.Make | None) -> DataFrame:
    """id, answer of a generator that sees the nearest examples, the best one last."""
    if make is None:
        raise ValueError(f"mode {config['mode']} needs a generator")
    shots = found.where(F.col("rank") <= config["examples"]).groupBy(F.col("q").alias("id")).agg(F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("r"), "input", F.col("answer").alias("output")))).alias("shots"))
    none = F.array().cast("array<struct<r:int,input:string,output:string>>")
    asked = questions.select("id", "input").join(shots, "id", "left").withColumn("shots", F.coalesce("shots", none))
    return asked.select("id", H.complete(P.few_shot(F.col("shots"), F.col("input")), make).alias("answer"))


def _retrieval(config: dict, questions: DataFrame, pool: DataFrame, make: H.Make | None) -> DataFrame:
    best = copied(config, neighbours(config, questions, pool))
    return questions.select("id").join(best.withColumnRenamed("q", "id"), "id", "left").select("id", "answer", "sim", "nn", F.lit("copy").alias("route"))


def _rag(config: dict, questions: DataFrame, pool: DataFrame, make: H.Make | None) -> DataFrame:
    found = neighbours(config, questions, pool)
    first = found.where("rank = 1").select(F.col("q").alias("id"), "sim", F.col("p").alias("nn"))
    return generated(config, questions, found, make).join(first, "id", "left").select("id", "answer", "sim", "nn", F.lit("generate").alias("route"))


def _router(config: dict, questions: DataFrame, pool: DataFrame, make: H.Make | None) -> DataFrame:
    """Copies where the nearest question is near enough; only the others reach the generator."""
    found = neighbours(config, questions, pool)
    best = copied(config, found).withColumnRenamed("q", "id")
    near = best.where(F.col("sim") >= config["threshold"]).select("id", "answer", "sim", "nn", F.lit("copy").alias("route"))
    rest = questions.join(near, "id", "left_anti")
    made = generated(config, rest, found, make).join(best.select("id", "sim", "nn"), "id", "left")
    return near.unionByName(made.select("id", "answer", "sim", "nn", F.lit("generate").alias("route")))


MODES = {"retrieval": _retrieval, "rag": _rag, "router": _router}


def run(config: dict, questions: DataFrame, pool: DataFrame, make: H.Make | None = None, resume: DataFrame | None = None) -> DataFrame:
    """id, answer, sim, nn (the nearest question), route (copy, generate or resumed) of each question (id, subset, input);
    pool: id, subset, input, output. resume: answers (id, answer) of an earlier start."""
    config = settled(config)
    pending = questions if resume is None else questions.join(resume.select("id"), "id", "left_anti")
    made = MODES[config["mode"]](config, pending, pool, make).withColumn("answer", F.coalesce("answer", F.lit("")))
    if resume is None:
        return made
    old = resume.join(questions.select("id"), "id", "left_semi").select("id", "answer", F.lit(None).cast("double").alias("sim"), F.lit(None).cast(made.schema["nn"].dataType).alias("nn"), F.lit("resumed").alias("route"))
    return made.unionByName(old)


def virtual(rule: str, selected: DataFrame, other: DataFrame, **settings) -> DataFrame:
    """The answers (id, answer, route) of a run that combines two others. agree: the other run's answer if it is among the
    first k stored answers (selected: id, answer, answers); fill: the other's where the selected one is empty."""
    both = selected.join(other.select("id", F.col("answer").alias("gen")), "id", "left").withColumn("gen", F.coalesce("gen", F.lit("")))
    if rule == "agree":
        rows = both.select(F.col("id").alias("q"), F.col("answer").alias("pred"), "gen", "answers")
        return S.agree(rows, settings["k"]).select(F.col("q").alias("id"), F.col("pred").alias("answer"), F.col("source").alias("route"))
    if rule == "fill":
        empty = F.trim(F.coalesce("answer", F.lit(""))) == ""
        return both.select("id", F.when(empty, F.col("gen")).otherwise(F.col("answer")).alias("answer"), F.when(empty, "gen").otherwise("sel").alias("route"))
    raise ValueError(f"unknown rule: {rule}")


def scores(answers: DataFrame, references: DataFrame, digits: int = 6) -> DataFrame:
    """The report by subset with ALL, of answers (id, answer) against references (id, subset, output); a question without an
    answer counts as an empty one."""
    rows = references.select("id", "subset", "output").join(answers.select("id", "answer"), "id", "left")
    p, r = X.words(F.col("answer")), X.words(F.col("output"))
    return T.full_report(rows.select("subset", M.rouge1(p, r).alias("r1"), M.rouge_l(p, r).alias("rl")), "subset", digits=digits)


def record(run_id: str, config: dict, report: DataFrame, seq: int) -> DataFrame:
    """The report as rows of the log: run, seq, config (JSON), subset, n, rouge_only."""
    return report.select(F.lit(run_id).alias("run"), F.lit(seq).cast("long").alias("seq"), F.lit(json.dumps(config, sort_keys=True)).alias("config"), "subset", "n", "rouge_only")


def adopted(log: DataFrame, best: DataFrame, delta: float = KEEP_DELTA) -> DataFrame:
    """subset, run, rouge_only and won of the champions after the log's runs, each against the best that stood before them:
    a subset's highest score wins if it gains delta; the earlier of equals. best: subset, run, rouge_only; may be empty."""
    top = Window.partitionBy("subset").orderBy(F.desc("rouge_only"), "seq")
    new = log.where("subset <> 'ALL'").withColumn("n_", F.row_number().over(top)).where("n_ = 1").select("subset", F.col("run").alias("new"), F.col("rouge_only").alias("score"))
    both = best.select("subset", "run", "rouge_only").join(new, "subset", "full")
    won = F.col("score").isNotNull() & (F.col("rouge_only").isNull() | (F.round(F.col("score") - F.col("rouge_only"), 9) >= delta))
    return both.select("subset", F.when(won, F.col("new")).otherwise(F.col("run")).alias("run"), F.when(won, F.col("score")).otherwise(F.col("rouge_only")).alias("rouge_only"), won.alias("won"))
