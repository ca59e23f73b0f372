"""Columns by role, languages, tolerant left joins, and restoring order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions.text import LANG_CODES
from askloom.operators.validation import fingerprint
from askloom.sources.readers import RENAMES

# fixed values: names that columns of a role may have, and names of languages
ROLES = {"question": ("question", "input", "prompt", "query"), "answer": ("response", "answer", "output", "target"), "language": ("language", "lang", "subset")}
LANGUAGE_NAMES = {"swa": ("swahili",), "lug": ("luganda",), "aka": ("twi", "akan"), "amh": ("amharic",), "eng": ("english",)}


def canonical(df: DataFrame) -> DataFrame:
    """df with the data model's names for its columns; others stay."""
    return df.withColumnsRenamed(RENAMES)


@dataclass(frozen=True)
class Role:
    """What a role's column may be called, by whole name or ending; whether the test schema has it; and if the only column
    that is left will do."""

    names: tuple[str, ...]
    ending: str | None = None
    in_test: bool = True
    last_one: bool = False

    def fit(self, column: str, left: int) -> int | None:
        """0 is best; None if the column can't be it."""
        low = column.lower()
        reasons = (low in self.names, self.ending is not None and low.endswith(self.ending), self.last_one and left == 1)
        return reasons.index(True) if True in reasons else None


RESOLVED = {"id": Role(("id",), ending="id"), "question": Role(ROLES["question"]), "answer": Role(ROLES["answer"], in_test=False), "language": Role(ROLES["language"], last_one=True)}


def detect_roles(train: list[str], val: list[str], test: list[str]) -> dict[str, str]:
    """The id, question, answer and language columns of three schemas: for each role in turn the column that fits best of
    those not yet taken, the first in train's order at ties. A role without a column raises an error."""
    found: dict[str, str] = {}
    for name, role in RESOLVED.items():
        left = [c for c in train if c in val and (c in test) == role.in_test and c not in found.values()]
        fits = [(fit, at) for at, c in enumerate(left) if (fit := role.fit(c, len(left))) is not None]
        if not fits:
            raise ValueError(f"no {name} column among {left}")
        found[name] = left[min(fits)[1]]
    return found


def by_roles(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """df with its role columns called id, question, answer, language; one without an answer has none."""
    return df.withColumnsRenamed({name: role for role, name in roles.items() if name in df.columns})


def language_code(raw: Column) -> Column:
    """The three-letter code of a language or subset name, by its beginning or a name in it; null if unknown."""
    low = F.lower(F.trim(raw))
    out = None
    for code, names in LANGUAGE_NAMES.items():
        fits = low.startswith(code)
        for name in names:
            fits = fits | low.contains(name)
        out = F.when(fits, code) if out is None else out.when(fits, code)
    return out


def known_language(raw: Column) -> Column:
    """As language_code; an unknown name ends the job with an error."""
    return F.coalesce(language_code(raw), F.when(raw.isNotNull(), F.raise_error(F.concat(F.lit("unknown language: "), raw))))


def looked_up(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    """A static map; what it lacks becomes the default, or passes through."""
    made = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(made[key], F.lit(default) if default is not None else key)


def subset_language(subset: Column) -> Column:
    """The language of a <Lang>_<Country> subset; English where the beginning is unknown."""
    return looked_up(F.substring_index(subset, "_", 1), LANG_CODES, "eng")


def hidden(df: DataFrame, answer: str) -> DataFrame:
    """df without its answers, as an operator under test sees it."""
    return df.drop(answer)


def left_filled(left: DataFrame, right: DataFrame, on: str, fill: dict) -> DataFrame:
    """left with the columns of `fill` from right; a missing match or column gives the fill value. on is unique in right."""
    there = [c for c in fill if c in right.columns]
    out = left.join(right.select(on, *[F.col(c).alias(f"_r_{c}") for c in there]), on, "left")
    made = {c: F.coalesce(F.col(f"_r_{c}"), F.lit(v)) if c in there else F.lit(v) for c, v in fill.items()}
    return out.withColumns(made).drop(*[f"_r_{c}" for c in there])


def left_required(left: DataFrame, right: DataFrame, on: str, needed: list[str]) -> DataFrame:
    """left with the needed columns of right; a null in one of them ends the job with an error that names the key."""
    out = left.join(right.select(on, *needed), on, "left")
    fail = lambda c: F.raise_error(F.concat(F.lit(f"no {c} for "), F.coalesce(F.col(on).cast("string"), F.lit("null"))))
    return out.withColumns({c: F.when(F.col(c).isNull(), fail(c)).otherwise(F.col(c)) for c in needed})


def counts_table(frames: dict[str, DataFrame], by: str) -> DataFrame:
    """by and a count per frame for every group of the first; groups it lacks are left out, missing ones count 0."""
    names = list(frames)
    out = frames[names[0]].groupBy(by).agg(F.count("*").alias(names[0]))
    for name in names[1:]:
        out = out.join(frames[name].groupBy(by).agg(F.count("*").alias(name)), by, "left")
    return out.fillna(0, names)


def newest_child(runs: DataFrame, parent: str = "parent", finished: str = "finished", run: str = "run") -> DataFrame:
    """parent, run: the child that finished last; ties go to the greater name."""
    return runs.where(F.col(parent).isNotNull()).groupBy(parent).agg(F.max_by(run, F.struct(finished, run)).alias(run))


def composite(champions: DataFrame, predictions: DataFrame, children: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """subset, run: where each subset's test predictions come from: an override, else the champion itself if it has rows
    of the subset, else its newest child that has. run is null where none has; required() refuses those.

    champions (subset, run), predictions (run, subset, ...), children (parent, run, finished), overrides (subset, run)."""
    has = predictions.select("run", "subset").distinct()
    asked = champions.select("subset", F.col("run").alias("best"))
    if overrides is not None:
        asked = asked.join(overrides.select("subset", F.col("run").alias("use")), "subset", "left").withColumn("best", F.coalesce("use", "best")).drop("use")
    own = asked.join(has.withColumnRenamed("run", "best"), ["subset", "best"]).select("subset", F.col("best").alias("run"), F.lit(None).cast(children.schema["finished"].dataType).alias("finished"), F.lit(1).alias("first"))
    kids = asked.join(children.withColumnRenamed("parent", "best"), "best").join(has, ["subset", "run"]).select("subset", "run", "finished", F.lit(0).alias("first"))
    found = own.unionByName(kids).groupBy("subset").agg(F.max_by("run", F.struct("first", "finished", "run")).alias("run"))
    return asked.select("subset").join(found, "subset", "left")


def required(sources: DataFrame) -> DataFrame:
    """The same rows; a subset without predictions ends the job with an error."""
    return sources.withColumn("run", F.when(F.col("run").isNull(), F.raise_error(F.concat(F.lit("no test predictions for "), F.col("subset")))).otherwise(F.col("run")))


def pending(rows: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """Rows still to do: those without an answer; answers that came twice count once."""
    return rows.join(answered.select(key).distinct(), key, "left_anti")


def named_sets(frames: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(queries, pools) of several sets, each as one table with a `set` column."""
    both = []
    for side in (0, 1):
        made = None
        for name, pair in frames.items():
            part = pair[side].withColumn("set", F.lit(name))
            made = part if made is None else made.unionByName(part)
        both.append(made)
    return both[0], both[1]


def same_hash(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """One row: fingerprints of two tables that don't depend on the order of rows, and whether they are equal."""
    one = lambda df, name: df.agg(fingerprint(columns).alias(name))
    return one(left, "left").crossJoin(F.broadcast(one(right, "right"))).withColumn("equal", F.col("left") == F.col("right"))  # one row each


def pinned(df: DataFrame, columns: list[str], mark: str) -> DataFrame:
    """df, if its fingerprint is still `mark`; else an error: the split or harness has drifted."""
    now = same_hash(df, df.limit(0), columns).first()["left"]
    if now != mark:
        raise ValueError(f"fingerprint {now} is not the pinned {mark}")
    return df


def run_status(runs: DataFrame, answered: str = "answered", wanted: str = "wanted", seconds: str = "seconds", limit: float = 3600.0, error: str = "error") -> DataFrame:
    """runs with status: crash, timeout, incomplete or ok, in this order of precedence."""
    return runs.withColumn("status", F.when(F.col(error).isNotNull(), "crash").when((F.col(seconds) > limit) & (F.col(answered) < F.col(wanted)), "timeout").when(F.col(answered) < F.col(wanted), "incomplete").otherwise("ok"))


def slug(config: dict, most: int = 60) -> str:
    """A readable name of a configuration: key-value parts in the order of keys, safe for a path."""
    text = "_".join(f"{k}-{config[k]}" for k in sorted(config))
    return "".join(c if c.isalnum() or c in "-_." else "-" for c in text)[:most].strip("-_.") or "default"
