"""Cases that an operator must not leave out."""

import random

import corpus_pipeline as P
from barley.llm import pii, toxicity
from tests.llm import fixtures as X
from tests.llm.test_texts import SCHEMA


def components(rows, words, percent):
    """Brute force: id -> smallest id of its component."""
    sets = {r[0]: X.shingle_set(r[1], words) for r in rows}
    component = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and component[a] != component[b]:
                low, high = sorted((component[a], component[b]))
                component = {i: low if c == high else c for i, c in component.items()}
    return component


def test_pipeline_near_copies(spark):
    """The stage links from 0.8 on at five words: 200 words with 40 appended are near copies."""
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(10_000)}" for _ in range(200)]
        texts += [" ".join(base + [f"x{rng.randrange(10_000)}" for _ in range(k)]) for k in (0, 30, 40, 47, 49, 50, 60)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(1000 + r[0], *r[1:]) for r in X.documents(8, 40)]
    want = {i for i, c in components(rows, 5, 80).items() if c == i}
    assert want != {i for i, c in components(rows, 4, 85).items() if c == i}
    assert {r.doc_id for r in P.keep_one_of_similar(spark, spark.createDataFrame(rows, SCHEMA), "").collect()} == want


def test_toxicity_misspelled_family_and_signs(spark):
    """A misspelling in the first letters of an inflected family, and a digit or sign in the place of a letter, are hits."""
    rng = random.Random(7)
    rows = []
    for i in range(1200):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(40)]
        if i % 5 == 0:
            words[rng.randrange(20)] = rng.choice(["loremish", "loremade", "loremton"])
            words[20 + rng.randrange(20)] = rng.choice(["scoundrel", "villain"])
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1000)], "doc_id bigint, toxic int")
    trie, _ = toxicity.train(toxicity.training_rows(docs, marks, "doc_id", "text", "toxic", 6000))
    seen = trie.matches()
    assert seen[b"loremish"][1] == 1 and seen[b"lxremish"][1] == 2 and seen[b"lxremish"][0] == seen[b"loremish"][0]
    plain = toxicity.features("a b c", seen)
    for text in ("lxremade b c", "the sc0undrel.", 'a "vill*in," b', "$coundrel", "villai7", "(lore&ish)"):
        assert toxicity.features(text, seen) != plain, text
    assert toxicity.features('a "vill*in," b', seen)[7] > 0   # in quotation
    for text in ("well-known don't e.g. page1 *a*", "vi*l*in"):
        assert toxicity.features(text, seen) == plain, text


def test_pii_keys_without_digits_and_spaced_passwords(spark):
    secrets = ["sk-" + "abcdefghijklmnopqrst", "ghp_" + "AbCdEfGhIjKlMnOpQrStUvWxYzAbCd", "AKIA" + "ABCDEFGHIJKLMNOP", "abcdefabcdefabcdefabcdefabcdefab"]
    texts = [f"the key {s} is here" for s in secrets]
    values = ["hunter22x", "huntertwo", "correcthorse", "пароль-мой"]
    texts += [f.format(v) for v in values for f in ("password: {}", 'password="{}"', "pwd = '{}'", '{{"secret": "{}"}}', "Password:{} ", "passwd=\t{}")]
    kept = ["password: ********", "the password, however", "secret: ok", "password =", "a risk-free task"]
    frame = spark.createDataFrame(list(enumerate(texts + kept)), "doc_id int, text string")
    got = {r.doc_id: r for r in pii.replace_pii(frame, "k").collect()}
    for i, text in enumerate(texts):
        old = next(s for s in secrets + values if s in text)
        assert old not in got[i].text and len(got[i].text) == len(text) and [p.type for p in got[i].pii] == ["key" if old in secrets else "password"], text
        assert got[i].text.replace(got[i].pii[0].surrogate, old) == text
    assert [got[len(texts) + i].text for i in range(len(kept))] == kept
