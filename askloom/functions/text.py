"""Text functions as Column expressions; regular expressions are Java's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: subsets, languages and markers of the data model
LANG_CODES = {"Aka": "aka", "Amh": "amh", "Eng": "eng", "Lug": "lug", "Swa": "swa"}
REFUSALS = ("i cannot", "i can't", "as an ai", "i'm sorry", "consult a doctor")
GEEZ = r"[ሀ-፿]"
LOOP = 10


def words(text: Column) -> Column:
    """Runs of non-blanks, Unicode blanks included; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def words_unicode(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def words_ascii(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9; other letters separate."""
    return words(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def words_stemmed(text: Column) -> Column:
    """words_ascii with words of more than three letters cut to their stems."""
    from askloom.functions.stemming import stems

    own = words_ascii(text)
    return F.zip_with(own, stems(own), lambda w, stem: F.when(F.length(w) > 3, stem).otherwise(w))


def words_plain(text: Column) -> Column:
    """Runs of anything but blanks and ? . , !"""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\s?.,!]+"), F.lit(0))


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words padded by one blank; a shorter padded word is emitted once per text occurrence."""
    padded = F.transform(words(F.lower(text)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column, n: int) -> Column:
        several = F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))
        # a word of at most n characters is one gram, at the smallest n that reaches it
        whole = F.array(w) if n == low else F.when(F.length(w) == n, F.array(w)).otherwise(F.array().cast("array<string>"))
        return F.when(F.length(w) > n, several).otherwise(whole)

    return F.flatten(F.transform(padded, lambda w: F.concat(*[grams(w, n) for n in range(low, high + 1)])))


def postprocess(text: Column, marker: str = "", join: bool = False) -> Column:
    """The answer after an echoed marker: its first paragraph, or all of it on one line."""
    out = F.trim(F.coalesce(text, F.lit("")))
    if marker:
        at = F.instr(out, marker)
        out = F.when(at > 0, F.trim(F.substring(out, at + len(marker), F.length(out)))).otherwise(out)
    return F.array_join(words(out), " ") if join else F.trim(F.substring_index(out, "\n\n", 1))


def clean_output(text: Column) -> Column:
    """Cut at the next turn's marker, runs of blank lines to one."""
    out = F.regexp_replace(text, r"(?s)\n(?:Question|User|Assistant)\s*:.*$", "")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def flatten_lines(text: Column) -> Column:
    return F.regexp_replace(text, "[\\r\\n  ]+", " ")


def sentences(text: Column) -> Column:
    """Lines, then cut after . ! ? and the Ethiopic full stop."""
    lines = F.filter(F.split(text, r"\n+"), lambda x: F.trim(x) != "")
    return F.flatten(F.transform(lines, lambda x: F.filter(F.split(x, r"(?<=[.!?።])\s+"), lambda s: s != "")))


def drop_prefix(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, rf"^(?:{pattern})", "")


def is_refusal(text: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    out = F.length(low) < 5
    for pattern in REFUSALS:
        out = out | low.contains(pattern)
    return out


def has_loop(text: Column) -> Column:
    """The same word LOOP times or more in a row; of the first a longer word's end counts, of the last one's start.

    A scan over the words: a back-reference in a pattern recurses once a repeat and ends the executor on a long run.
    """

    def at(a: Column, i: Column) -> Column:
        inner = [F.get(a, i + k) for k in range(1, LOOP - 1)]
        same = inner[0] == inner[1]
        for x in inner[2:]:
            same = same & (inner[0] == x)
        return same & F.get(a, i).endswith(inner[0]) & F.get(a, i + (LOOP - 1)).startswith(inner[0])

    def found(a: Column) -> Column:
        return F.when(F.size(a) >= LOOP, F.exists(F.sequence(F.lit(0), F.size(a) - LOOP), lambda i: at(a, i))).otherwise(False)

    return F.exists(F.array(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")), found)


def language(text: Column) -> Column:
    """A coarse guess by script, letters and function words."""
    low = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    score = lambda marks: sum(((F.length(low) - F.length(F.replace(low, F.lit(f" {m} "), F.lit("")))) > 0).cast("int") for m in marks)
    # fixed values: function words
    marks = {"en": ("the", "of", "and", "to", "is"), "fr": ("le", "la", "de", "et", "que"), "de": ("der", "die", "und", "ein", "nicht"), "es": ("el", "los", "que", "por", "del")}
    guesses = F.array(*[F.struct(score(m).alias("n"), F.lit(k).alias("k")) for k, m in marks.items()])
    best = F.sort_array(guesses, asc=False)[0]
    return F.when(low.rlike(GEEZ), "amh").when(best["n"] > 0, best["k"]).otherwise("und")


def subset_of(row_id: Column) -> Column:
    """<Lang>_<Country> of an id with at least five parts, else UNKNOWN."""
    parts = F.split(row_id, "_")
    return F.when(F.size(parts) >= 5, F.concat_ws("_", parts[2], parts[3])).otherwise("UNKNOWN")


def judge_score(text: Column) -> Column:
    """1 to 5 from a judge's completion, or null: the overall value or the mean of the three criteria of the first JSON
    object that has them, a labelled number, a number out of five, or one lone digit. Values out of range don't count."""
    # fixed values: criteria and patterns of the judge's answer
    criteria = ("accuracy", "completeness", "language")
    labelled = r"(?iU)(?:overall|score|rating)\W{0,5}([1-5](?:\.\d+)?)(?![\d.])"
    out_of = r"\b([1-5](?:\.\d+)?)\s*/\s*5\b"
    bare = r"(?<![\d.])[1-5](?![\d.])"
    valid = lambda x: F.when(x.between(1, 5), x)
    number = lambda x: valid(x.try_cast("double"))
    kind = ", ".join(f"{k} string" for k in ("overall", *criteria, "_corrupt_record"))

    def of(blob: Column) -> Column:
        made = F.from_json(blob, kind, {"columnNameOfCorruptRecord": "_corrupt_record"})
        mean = sum((number(made[k]) for k in criteria[1:]), number(made[criteria[0]])) / len(criteria)
        return F.when(made["_corrupt_record"].isNull(), F.coalesce(number(made["overall"]), mean))

    blobs = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)\{.*?\}"), F.lit(0)), of)
    digits = F.array_distinct(F.regexp_extract_all(text, F.lit(bare), F.lit(0)))
    named, share = F.regexp_extract(text, labelled, 1), F.regexp_extract(text, out_of, 1)
    loose = F.when(named != "", number(named)).when(share != "", number(share)).when(F.size(digits) == 1, F.get(digits, F.lit(0)).try_cast("double"))
    return F.coalesce(F.get(F.filter(blobs, lambda x: x.isNotNull()), F.lit(0)), loose)


def links(markdown: Column) -> Column:
    """[[targets]] outside code."""
    plain = F.regexp_replace(F.regexp_replace(markdown, r"(?s)```.*?```", ""), r"`[^`]*`", "")
    return F.regexp_extract_all(plain, F.lit(r"\[\[([^\]|#]+)"), F.lit(1))
