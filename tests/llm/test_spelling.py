"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

from pyspark.sql import functions as F

from callwatch.llm import spelling

from .conftest import clashing, frame


def variants(rows):
    n = collections.Counter()
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
        for w in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    v = {w: k for w, k in n.items() if k >= 5 and len(w) >= 6}
    letters = {c for w in v for c in w}

    def near(w):
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        return {x for x in edits if x in v} - {w}

    found = {w: near(w) for w in v}
    form = {}
    for w, x in found.items():
        best = min(x, key=lambda y: (-v[y], y), default=None)
        form[w] = best if best and v[best] >= 5 * v[w] else None
    out = {}
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, v[w], len(found[w]), v[form[w]] if form[w] else None)
    return out


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def corpus(seed=5, stems=60):
    rng = random.Random(seed)
    letters = "abcdé×ÿÀ"
    rows = []
    for i in range(400):
        words = []
        for _ in range(60):
            stem = random.Random(rng.randint(0, stems)).choices(letters, k=6 + rng.randint(0, 2))
            word = "".join(stem)
            if rng.random() < 0.15:
                j = rng.randrange(len(word))
                word = rng.choice([word[:j] + word[j + 1 :], word[:j] + "z" + word[j:], word[:j] + "q" + word[j + 1 :]])
            words.append(word.upper() if rng.random() < 0.1 else word)
        rows.append((i if i % 50 else None, rng.choice([" ", ".", "-1", "ß "]).join(words)))
    return rows


def test_variants_are_all_one_edit_apart(spark):
    rows = corpus() + [(900, None), (901, ""), (902, "abcdef " * 30), (902, "abcdef " * 30), (903, "abcdeg " * 7 + "zbcdef " * 400)]
    df = frame(spark, rows)
    expected = variants(rows)
    assert got(spelling.spelling_variants(df)) == expected
    assert sum(x[0] is not None for x in expected.values()) > 5 and any(x[1] not in (w, x[0]) for w, x in expected.items())


def test_ends_that_many_words_share_fill_several_indexes(spark):
    rng = random.Random(8)
    words = {"".join(rng.choices("abc", k=5)) + "tion" for _ in range(150)} | {"pre" + "".join(rng.choices("abc", k=4)) for _ in range(80)}
    n = {w: rng.randint(5, 400) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    whole = {tuple(r) for r in spelling.near_words(df).collect()}
    parts = {tuple(r) for r in spelling.near_words(df, shard=120).collect()}
    assert whole == parts and len(whole) > 100

    def one(a, b):
        return a != b and (any(a[:i] + a[i + 1 :] == b for i in range(len(a))) or any(b[:i] + b[i + 1 :] == a for i in range(len(b))) or (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1))

    expected = set()
    for w in words:
        near = [x for x in words if one(w, x)]
        if near:
            best = min(near, key=lambda x: (-n[x], x))
            expected.add((w, len(near), best, n[best]))
    assert whole == expected


def test_a_very_long_word(spark):
    word = "xy" * 3000
    df = spark.createDataFrame([(word, 50), (word[:-1], 5), (word[1:], 6), ("z" * 4000, 9)], "word string, n long")
    found = {r.word: (r.n_near, r.near) for r in spelling.near_words(df).collect()}
    assert found == {word: (2, word[1:]), word[:-1]: (1, word), word[1:]: (1, word)}


def test_edges(spark, awkward, nothing):
    assert spelling.spelling_variants(nothing).count() == 0
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert got(spelling.spelling_variants(clashing(awkward.withColumns({c: F.lit("?") for c in ("word", "form", "root", "bucket", "to")})))) == variants(rows)
