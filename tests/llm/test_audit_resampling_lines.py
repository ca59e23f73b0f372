"""Filter audit, resampling and line dedup against brute force, with nulls, ties, repeated rows, clashing columns, no rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from askloom.llm import filter_audit, line_dedup, resampling

SCHEMA = "doc_id long, text string, lang string, id long, h string, n int, part string"
BLANK = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    common, rare, near = ("Common line " + text(9)), ("rare line " + text(9)), "x" * 39
    out = [(i, text(rng.choice([5, 30, 230, 260])), rng.choice(["en", "fr", None, ""])) for i in range(40)]
    out += [(100 + i, f"{text(12)}\n \t{common.upper() if i % 2 else common}\r\n{text(3)}\n{common}", "en") for i in range(9)]
    out += [(120 + i, f"{rare}\n{near}\n\n{text(220)} A$ B% C& |", "fr") for i in range(4)]
    out += [(3, out[4][1], "en"), (200, out[4][1], "fr"), (201, out[4][1], "en"), (4, out[4][1], "en"), (200, out[4][1], "fr"), (200, "other " + common, "fr")]
    out += [(300, None, "en"), (301, "", None), (302, "\n", "x"), (303, "SHOUT " * 250, "en"), (304, "ab " * 300, "en"), (None, common, "en"), (None, common, "fr"), (None, None, None), (305, "y" * 90_000, "en"), (306, (text(20) + "\n") * 400, "en")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 2, "clash") for r in rows], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_filter_audit(spark, docs, nothing, rows):
    labels = [(i, q, t) for i, q, t in [(0, 1, 0), (1, 1, 1), (2, 0, 1), (2, 1, None), (3, None, 1), (4, 1, 0), (200, 1, 1), (303, 0, 1), (None, 1, 1), (999, 1, 1)]]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    number = lambda i: filter_audit.NO_ID if i is None else i
    first = {}
    for i, t, _ in rows:
        first[t or ""] = min(first.get(t or "", number(i)), number(i))
    facts = []
    for i, t, lang in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": number(i) > first[t]}
        facts.append((lang or "", fails, i is not None and i in good, i is not None and i in toxic))
    want = {}
    for part in {f[0] for f in facts}:
        own, total = [f for f in facts if f[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, name in enumerate(order):
                gone = [f for f in left if f[1][name]]
                left = [f for f in left if not f[1][name]]
                total[name] += len(gone)
                redundant = sum(f[1][name] for f in own) - len(gone)
                unique = sum(f[1][name] and sum(f[1].values()) == 1 for f in own)
                want[part, "".join(order), k + 1] = [len(left), len(gone), redundant, unique, sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for key in [x for x in want if x[0] == part]:
            want[key].append(total[key[1][key[2] - 1]])
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(docs, table).collect()}
    assert got == want
    assert filter_audit.audit(nothing, table.where("false")).count() == 0


def features(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)) if x]
    return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_resampling(spark, docs, nothing, rows):
    target = [(1, rows[2][1]), (2, None), (3, "three Words only"), (4, "")]
    table = spark.createDataFrame(target, "item_id long, text string")
    s, t = Counter(), Counter()
    for _, x, _ in rows:
        s.update(features(x)[1])
    for _, x in target:
        t.update(features(x)[1])
    size, wanted = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (size + 10000) / ((s[b] + 1) * (wanted + 10000)))) for b in range(10000)]
    want = []
    for i, x, _ in rows:
        w, f = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        want.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    scored = resampling.weighted(docs, table)
    assert Counter(map(tuple, scored.collect())) == Counter(want)
    for percent in (5, 40, 100):
        asked = sorted((-r[4], r[0] is None, r[0] or 0) for r in want if r[1] >= 20)
        best = asked[: percent * len(asked) // 100]
        drawn = sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in resampling.draw(scored, percent=percent).collect() if r["rank"])
        assert [x[0] for x in drawn] == list(range(1, len(best) + 1)) and [x[1:] for x in drawn] == best
    assert resampling.draw(resampling.weighted(docs.where("doc_id = 300"), table)).first()["rank"] is None
    assert resampling.draw(resampling.weighted(nothing, table)).count() == 0
    assert resampling.weighted(docs, table.where("false")).count() == len(rows)


def dropped(rows, least_docs, least_chars):
    number = lambda i: line_dedup.NO_ID if i is None else i
    key = lambda line: lower(line.strip(BLANK))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(number(i))
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        gone = [len(key(x)) >= least_chars and len(held[key(x)]) >= least_docs and number(i) < max(held[key(x)]) for x in own]
        out.append((i, len(own), sum(gone), "\n".join(x for x, g in zip(own, gone, strict=True) if not g)))
    return Counter(out)


def test_line_dedup(docs, nothing, rows):
    own = [r[:2] for r in rows]
    for least_docs, least_chars, batches in ((5, 40, 8), (2, 39, 3), (1, 0, 1), (4, 40, 6)):
        got = line_dedup.score_documents(docs, least_docs=least_docs, least_chars=least_chars, batches=batches)
        assert Counter(map(tuple, got.collect())) == dropped(own, least_docs, least_chars)
    assert line_dedup.score_documents(nothing).count() == 0
    left = line_dedup.drop_lines(docs)
    assert left.columns == docs.columns
    want = Counter((i, None if t is None else x[3]) for (i, t), x in zip(own, dropped_in_order(own), strict=True))
    assert Counter((r.doc_id, r.text) for r in left.collect()) == want


def dropped_in_order(rows):
    found = {}
    for i, n, k, t in dropped(rows, 5, 40):
        found.setdefault((i, n), []).append((i, n, k, t))
    pick = lambda i, t: next(x for x in found[i, len((t or "").split("\n"))] if x[2] or x[3] == (t or ""))
    return [pick(i, t) for i, t in rows]


def test_line_runs_levels(spark):
    store = line_dedup.LineRuns(spark, fanout=3, buckets=4)
    seen: Counter = Counter()
    tops: dict = {}
    for b in range(10):
        keys = [(bytes([k]), 1 + k % 2, 100 - b) for k in range(b % 4, 40, 1 + b % 3)]
        batch = spark.createDataFrame(keys, "h binary, n long, top long")
        assert {bytes(r.h) for r in store.known(batch).where("fresh").collect()} == {k for k, _, _ in keys} - set(seen)
        store.add(batch)
        for k, n, top in keys:
            seen[k] += n
            tops.setdefault(k, top)
    assert [len(x) for x in store.levels] == [1, 0, 1]  # 10 in base 3
    assert {(bytes(r.h), r.n, r.top) for r in store.totals().collect()} == {(k, n, tops[k]) for k, n in seen.items()}
    store.close()
    assert store.totals().count() == 0
