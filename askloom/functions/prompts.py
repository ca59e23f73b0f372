"""Prompts, messages and choices as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill(template: str, **values: Column) -> Column:
    """The template with {name} replaced; a null value becomes empty. An unknown name raises an error."""
    parts = re.split(r"\{(\w+)\}", template)
    missing = set(parts[1::2]) - set(values)
    if missing:
        raise ValueError(f"no value for {sorted(missing)}")
    return F.concat(*[F.coalesce(values[x].cast("string"), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts) if x])


def messages(system: Column, user: Column) -> Column:
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(one("system", system), one("user", user))


def render(held: Column, template: str | None = None, ending: str = "") -> Column:
    """Messages by a template of {role} and {content}; without one, their contents joined by a blank line."""
    if template is None:
        return F.array_join(F.transform(held, lambda m: m["content"]), "\n\n")
    return F.concat(F.array_join(F.transform(held, lambda m: fill(template, role=m["role"], content=m["content"])), ""), F.lit(ending))


def few_shot(examples: Column, question: Column) -> Column:
    """Examples (input, output) before the question."""
    shots = F.transform(examples, lambda x: fill("Q: {q}\nA: {a}\n\n", q=x["input"], a=x["output"]))
    return F.concat(F.array_join(shots, ""), fill("Q: {q}\nA:", q=question))


def with_options(question: Column, options: Column) -> Column:
    """The question and its options behind letters from A on."""
    return F.concat_ws("\n", question, F.array_join(F.transform(options, lambda x, i: F.concat(F.char(i + 65), F.lit(". "), x)), "\n"))


def routed(routes: dict[str, str], models: list[str], lang: Column) -> Column:
    """The prediction of the language's model; without a route, or with one to an unknown model, of the first."""
    out = None
    for code, model in routes.items():
        if model in models:
            out = F.when(lang == code, F.col(model)) if out is None else out.when(lang == code, F.col(model))
    return F.col(models[0]) if out is None else out.otherwise(F.col(models[0]))


def normal_judge(score: Column) -> Column:
    """1..5 to 0..1; null stays null."""
    return (score - 1) / 4


def legacy_judge(text: Column) -> Column:
    """An older form: accuracy, completeness and language from the first { to the last }, their sum over 15; 0.5 where that fails."""
    at, end = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    blob = F.when((at > 0) & (end > at), F.substring(text, at, end - at + 1))
    field = lambda k: F.get_json_object(blob, f"$.{k}").try_cast("double")
    return F.coalesce((field("accuracy") + field("completeness") + field("language")) / 15, F.lit(0.5))
