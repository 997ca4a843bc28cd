"""Collocations against brute force."""

import os
import random
import re
from collections import Counter

import pytest

from barley.llm import collocations as C
from tests.llm import fixtures as X

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string"


def brute(rows, least=30, share=80, top=2000):
    """(lang, rank, phrase) -> (a, l, r, n, score) of (doc_id, text, lang)."""
    count, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", X.fold(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for p in range(len(words) - k + 1):
                    key = lang, tuple(words[p:p + k])
                    count[key] = count.get(key, 0) + 1
    often = {key: a for key, a in count.items() if a >= least}
    inside = {}
    for (lang, words), a in often.items():
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                if j - i < len(words):
                    inside[lang, words[i:j]] = max(inside.get((lang, words[i:j]), 0), a)
    out = {}
    for lang in n:
        found = []
        for (own, words), a in often.items():
            if own == lang and len(words) > 1 and 100 * inside.get((lang, words), 0) < share * a:
                cuts = [(2_000_000 * a // (count[lang, words[:k]] + count[lang, words[k:]]), k) for k in range(1, len(words))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(words).encode(), count[lang, words[:k]], count[lang, words[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):  # noqa: E741
            out[lang, rank, phrase.decode()] = (-a, l, r, n[lang], -score)
    return out


def got(frame, **options):
    rows = C.collocations(frame, **options).collect()
    out = {(r.lang, r["rank"], r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in rows}
    assert len(out) == len(rows)
    return out


def texts(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["A", "a\x01", "é", "中文", "w1\x1c", "x" * 300]
    fixed = [["new", "york", "city", "hall"], ["of", "the"], ["a", "b", "a", "b", "a"], ["New", "York"], ["z"] * 6]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.choice([0, 1, 3, 8])):
            text += rng.choice(fixed) if rng.random() < .5 else [rng.choice(words)]
        rows.append((i % 90, "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "! "]) for w in text), rng.choice(["en", "en", "en", "de", None, "und", ""])))
    return rows + [(1, None, "en"), (2, "", "xx"), (None, " .,; ", None), (3, "long words " * 5000, "yy"), (4, "no spaces", "zz")]


def frame_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "'x' AS words", "2 AS a", "3 AS key", "4 AS `rank`").repartition(6)


def test_collocations(spark):
    for seed, options in ((1, {}), (2, {"least": 5, "share": 60}), (3, {"least": 3, "top": 7})):
        rows = texts(seed)
        want = brute(rows, **options)
        assert len(want) > 15 and got(frame_of(spark, rows), **options) == want
    assert got(frame_of(spark, rows).where("false")) == {}


def test_many_ranges_and_small_arrays(spark, monkeypatch):
    """Beginnings whose extensions lie in further ranges; counts from many arrays; a filter that lets everything through."""
    monkeypatch.setattr(C, "GATHERED", 50)
    monkeypatch.setattr(C, "FILTER_BITS", 64)
    monkeypatch.setattr(C, "tasks", lambda spark: 40)
    rows = texts(4)
    assert got(frame_of(spark, rows), least=4) == brute(rows, least=4)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_registered(spark):
    from oracle.run import compare, connect
    result, *_ = compare(spark, connect(SF), SF, C.op12_phrase_collocations, C.OP12_SQL)
    assert result.startswith("ok"), result
