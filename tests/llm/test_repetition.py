import random

import numpy as np
import pytest

from tagloom.llm import repetition as R


def brute(text, width=8):
    import unicodedata

    words, cur = [], ""
    for c in (text or "") + " ":
        if unicodedata.category(c)[0] == "L":
            cur += c
        elif cur:
            words.append(cur.lower())
            cur = ""
    seen, hit = set(), set()
    for i in range(len(words) - width + 1):
        g = tuple(words[i : i + width])
        if g in seen:
            hit.update(range(i, i + width))
        seen.add(g)
    return len(hit) / len(words) if words else 0.0


def texts():
    rng = random.Random(3)
    w = ["alpha", "beta", "Ünï", "日本", "x", "don't", "a1b2", "ne\u0301e", "½half", "Straße", "İst"]
    out = [None, "", "a b c", "one two three four five six seven eight " * 2, "x " * 8, "x " * 9, "x " * 300, "1 2 3 4", "A a " * 20]
    for _ in range(60):
        t = [rng.choice(w) for _ in range(rng.randint(1, 60))]
        out.append(rng.choice([" ", "\n", ", "]).join(t + t[: rng.randint(0, len(t))]))
    return out


def test_shares_are_those_of_brute_force():
    ts = texts()
    got = R.statistics_of(ts)[:, 0]
    assert got == pytest.approx([brute(t) for t in ts]) and R.statistics_of([])[:, 0].size == 0


def test_exact_shares_are_those_of_brute_force():
    assert [R.exact_share(R.words_of(t or "")) for t in texts()] == pytest.approx([brute(t) for t in texts()])


def test_rows_come_through_the_forest(spark, monkeypatch):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    monkeypatch.setattr(R, "fit", lambda *a: (R.Forest(np.zeros((0, 5))), 1.0, 2.0))
    assert R.repeated_documents(d).count() == 0


def test_documents_do_not_mix():
    t = "one two three four five six seven eight nine"
    assert R.statistics_of([t, t, t])[:, 0].tolist() == [0, 0, 0]


def test_other_statistics():
    s = dict(zip(R.STATISTICS, R.statistics_of(["ab\nab\ncd\n\nab\nab"])[0]))
    assert s["repeated_lines"] == pytest.approx(6 / 10) and s["repeated_paragraphs"] == 0


def test_the_safe_score_is_below_that_of_every_such_row():
    rng = np.random.default_rng(1)
    rows = np.column_stack([rng.beta(0.3, 4, 3000), rng.random((3000, 3)), rng.normal(5, 1, 3000)])
    f = R.Forest(rows)
    low = f.least_score(0, 0.4)
    for odd in (rows[rows[:, 0] >= 0.4], np.column_stack([rng.uniform(0.4, 1, 4000), rng.random((4000, 3)) * 3 - 1, rng.normal(5, 9, 4000)])):
        assert (f.scores(odd) >= low - 1e-12).all()
    assert f.scores(rows).min() >= 0 and f.scores(rows[:1] + 50)[0] > np.median(f.scores(rows))


def test_tables(spark):
    ts = texts()
    d = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(ts)], "doc_id long, text string, score double")
    want = {i for i, t in enumerate(ts) if brute(t) >= 0.4}
    assert {r.doc_id for r in R.repeated_documents(d).collect()} == want
    s = R.repetition(d).collect()
    assert len(s) == len(ts) and all(r.candidate for r in s if r.doc_id in want)
    assert R.repeated_documents(d.limit(0)).count() == 0
    assert R.repeated_documents(d.filter("text is null")).count() == 0
