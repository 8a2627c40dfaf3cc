"""The numbered operators against brute force, and on awkward tables."""

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from callwatch.llm.words import grams
from callwatch.llm import decontamination, graph, mixing, near_dedup, pii, quality_classifier, quality_rules, sharding, substring_dedup, token_counts, token_files, tokenizing, words

from callwatch.runtime import spread_join

from .conftest import WORD, clashing, frame

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def found(text):
    return WORD.findall(text or "")


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda r: tuple((x is not None, x if not isinstance(x, bool) else int(x)) if x is not None else (False, 0) for x in r))


# 1 ---------------------------------------------------------------------------


def base_facts(text):
    w = found(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    counts = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if counts[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_base_facts(spark, awkward):
    texts = ["a b c d e a b c d e", "a a a a a a", "a a a a a", "x\nx\n\n \nx y", "# * $ % & | < >", "a b c d e f a b c d e g a b c d"]
    df = awkward.unionByName(frame(spark, [(100 + i, t) for i, t in enumerate(texts)]))
    got = quality_rules.judge(df).collect()
    expected = collections.Counter((r.doc_id, *base_facts(r.text)) for r in df.collect())
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == expected
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_divergence(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["the", "of", "ship", "harbour", "and", "to", "tide", "wind", "in", "a", "sail", "calm"]) + rng.choice(["", "", "s", "ly", "er", "ing"]) for _ in range(120)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(1000, " ".join(f"%%{rng.randint(0, 10**9)}##" for _ in range(120))), (1001, " ".join("ABCDEFGH"[rng.randint(0, 7)] * 3 + str(i) + "!!" for i in range(120)))]
    rows += [(1002, rows[1000 % 60][1], "xx"), (1003, rows[0][1], None)]
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, rows)).collect()}
    assert not got[1000].kept and not got[1000].base_failed and got[1000].character_distance > 0.3
    assert not got[1001].kept
    assert all(got[i].kept for i in range(60) if not got[i].base_failed)
    assert got[1002].character_distance is None and got[1003].character_distance is None


def test_quality_edges(spark, nothing, awkward):
    assert quality_rules.judge(nothing).count() == 0
    assert rows_of(quality_rules.judge(clashing(awkward)), "doc_id", "kept") == rows_of(quality_rules.judge(awkward), "doc_id", "kept")
    assert quality_rules.keep_good(clashing(awkward)).columns == clashing(awkward).columns


def test_quality_judges_rows_that_share_an_id_or_have_none(spark):
    good = " ".join(f"the{i} of{i}" for i in range(30))
    rows = [(1, good), (1, "bad " * 40), (None, good), (None, "too short"), (None, None)]
    assert rows_of(quality_rules.keep_good(clashing(frame(spark, rows))), "doc_id", "text") == [(None, good), (1, good)]


def test_divergence_is_the_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a)
    got = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(quality_rules.divergence(F.col("p"), F.col("q")).alias("d")).first().d
    assert got == pytest.approx(np.sqrt((kl(p) + kl(q)) / 2))


# 2 ---------------------------------------------------------------------------


def brute_repeats(texts, window=35):
    words_of = [found(t) for t in texts]
    counts = collections.Counter(tuple(w[i : i + window]) for w in words_of for i in range(len(w) - window + 1))
    out = []
    for w in words_of:
        gone = {j for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def repeats_corpus(seed):
    rng = random.Random(seed)
    text = lambda n, v=3000: [f"w{rng.randint(0, v)}" for _ in range(n)]
    shared = text(80)
    docs = []
    for _ in range(25):
        d = text(rng.randint(0, 200))
        if rng.random() < 0.6:
            a = rng.randint(0, 45)
            at = rng.randint(0, len(d))
            d[at:at] = shared[a : a + rng.randint(30, 60)]
        docs.append(d)
    base = text(300)
    for _ in range(12):
        d = list(base)
        for _ in range(rng.randint(0, 8)):
            d[rng.randint(0, 299)] = f"e{rng.randint(0, 9)}"
        docs.append(d)
    docs += [["z"] * 100, ["z"] * 34, ["z"] * 35, ["p", "q"] * 60, base, base, text(40, 2), text(60, 2)]
    return [" ".join(d) for d in docs]


@pytest.mark.parametrize("seed", range(3))
def test_repeats_match_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # all that occurs often is dealt over several tasks
        monkeypatch.setattr(substring_dedup, "SEED_ROWS", 2)
        monkeypatch.setattr(substring_dedup, "CENTRE_ROWS", 1)
    texts = repeats_corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_repeats_edges(spark, nothing, awkward):
    assert substring_dedup.remove_repeats(nothing).count() == 0
    rows = awkward.collect()
    expected = collections.Counter((r.doc_id, *x) for r, x in zip(rows, brute_repeats([r.text for r in rows])))
    got = substring_dedup.remove_repeats(clashing(awkward)).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == expected
    spans = substring_dedup.Repeats(awkward).spans().collect()
    assert {r.doc_id for r in spans} == {r.doc_id for r in got if r.n_removed}


@pytest.mark.parametrize("shared_id", [True, False])
def test_repeated_rows_count_once(spark, shared_id):
    """Texts that share less than a window with a text whose rows repeat."""
    rng = random.Random(12)
    rows = []
    for i in range(12):
        twice, other = ([f"{c}{i}x{rng.randint(0, 10**6)}" for _ in range(150)] for c in "ab")
        other[60:94] = twice[40:74]
        rows += [(i if shared_id else None, " ".join(twice))] * 2 + [(100 + i, " ".join(other))]
    rows += [(3, " ".join(f"c{j}" for j in range(50))), (200, rows[0][1]), (200, rows[2][1] + " end")]
    expected = collections.Counter((d, *x) for (d, _), x in zip(rows, brute_repeats([t for _, t in rows]), strict=True))
    got = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == expected


# 3 ---------------------------------------------------------------------------


def norm(text):
    return [x.decode() for w in (text or "").encode().split() if (x := decontamination.normal(w))]


def brute_leaks(docs, items):
    out = set()
    for (d, text), (i, item) in itertools.product(docs, items):
        w, v = norm(text), norm(item)
        s, t = ([tuple(x[k : k + 5]) for k in range(len(x) - 4)] for x in (w, v))
        if not s or not t:
            continue
        n, own = min(len(s), len(t)), collections.Counter(t)
        for k in range(len(s) - n + 1):
            both = sum((collections.Counter(s[k : k + n]) & own).values())
            if both / (n + len(t) - both) >= 0.8:
                out.add((d, i))
                break
    return out


def test_leaks_match_brute_force(spark):
    rng = random.Random(5)
    text = lambda n: [f"v{rng.randint(0, 400)}" for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(15, 60)))) for i in range(20)] + [(20, "too short item here"), (21, None), (22, "")]
    docs = []
    for d in range(60):
        w = text(rng.randint(0, 300))
        if d % 2:
            item = found(items[d % 20][1])
            for _ in range(d % 4):
                item[rng.randint(0, len(item) - 1)] = "edit"
            w[d % 7 : d % 7] = [x.upper() + "," if d % 3 else x for x in item]
        docs.append((d, " ".join(w)))
    docs += [(100, items[3][1]), (101, " ".join(found(items[4][1])[:-1])), (102, None), (None, items[5][1])]
    got = decontamination.contaminated(clashing(frame(spark, docs)), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute_leaks(docs, items)


def test_block_index_misses_nothing():
    rng = np.random.default_rng(1)
    items = decontamination.Items([(i, " ".join(f"u{x}" for x in rng.integers(0, 500, 30))) for i in range(50)])
    for _ in range(200):
        i = rng.integers(0, 50)
        flips = rng.choice(64, rng.integers(0, decontamination.RADIUS + 1), replace=False)
        near = items.near(items.prints[i] ^ np.uint64(sum(1 << int(b) for b in flips)))
        assert i in near


def test_leak_edges(spark, nothing, awkward):
    items = spark.createDataFrame([(1, "the of and the of and the of and the")], "item_id long, text string")
    none = items.limit(0)
    assert decontamination.contaminated(nothing, items).count() == 0
    assert decontamination.contaminated(awkward, none).count() == 0
    assert {r.doc_id for r in decontamination.contaminated(awkward, items).collect()} == {11}
    clean = decontamination.keep_clean(clashing(awkward), items)
    assert clean.columns == clashing(awkward).columns
    assert clean.count() == awkward.count() - 1


def test_leaks_of_rows_that_share_an_id_or_have_none(spark):
    rng = random.Random(15)
    item = " ".join(f"q{rng.randint(0, 999)}" for _ in range(30))
    rows = [(1, item), (1, "clean text " * 20), (None, f"before {item} after"), (None, "more clean text"), (None, None), (2, item), (2, item)]
    items = spark.createDataFrame([(5, item), (4, item), (None, None)], "item_id long, text string")
    assert rows_of(decontamination.keep_clean(clashing(frame(spark, rows)), items), "doc_id", "text") == rows_of(frame(spark, [rows[1], rows[3], rows[4]]), "doc_id", "text")
    assert [(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(spark, rows), items).orderBy("doc_id").collect()] == [(None, 4), (1, 4), (2, 4), (2, 4)]
    assert rows_of(decontamination.item_classes(items), "item_id", "class_id") == [(4, 4), (5, 4)]


def test_lots_lose_no_item(spark, monkeypatch):
    rng = random.Random(16)
    items = [(i, " ".join(f"q{rng.randint(0, 999)}" for _ in range(20))) for i in range(40)]
    docs = [(100 + i, t) for i, t in items] + [(999, "nothing of it")]
    monkeypatch.setattr(decontamination, "BYTES_AT_ONCE", 800)
    table = spark.createDataFrame(items, "item_id long, text string")
    assert len(decontamination._passes(table)) == 1 and len(decontamination._passes(table)[0]) > 3
    assert rows_of(decontamination.contaminated(frame(spark, docs), table), "doc_id", "item_id") == [(100 + i, i) for i, _ in items]
    clean = decontamination.keep_clean(frame(spark, docs), table)
    assert [r.doc_id for r in clean.collect()] == [999]
    # one Python worker for each task, whatever the number of lots
    for df in (clean, decontamination.contaminated(frame(spark, docs), table)):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    # lots that are too many for one pass are taken in several
    monkeypatch.setattr(decontamination, "PASS_BYTES", 600)
    assert len(decontamination._passes(table)) > 1
    assert decontamination.contaminated(frame(spark, docs), table).count() == 40
    assert [r.doc_id for r in decontamination.keep_clean(frame(spark, docs), table).collect()] == [999]


def test_items_without_an_id_have_none(spark):
    items = spark.createDataFrame([(0, "zero " * 3 + "a b c d e f"), (None, "one " * 3 + "g h i j k l"), (None, "two " * 3 + "m n o p q r")], "item_id long, text string")
    docs = frame(spark, [(1, "zero " * 3 + "a b c d e f"), (2, "one " * 3 + "g h i j k l"), (3, "two " * 3 + "m n o p q r")])
    assert rows_of(decontamination.contaminated(docs, items), "doc_id", "item_id") == [(1, 0), (2, None), (3, None)]


@pytest.mark.parametrize("words_of_item", [15, 20, 30, 50, 150, 400])
def test_fingerprints_find_similar_windows(words_of_item):
    """Of windows that are changed and yet reach the similarity, at least nine in
    ten lie within the radius. Items of under 15 words reach it only unchanged."""
    rng = random.Random(words_of_item)
    hashed = words.WordHashes(decontamination.normal)
    near = total = 0
    while total < 100:
        item = [f"w{rng.randint(0, 5000)}" for _ in range(words_of_item)]
        other = list(item)
        for _ in range(rng.randint(1, max(1, words_of_item // 20))):
            at = rng.choice([0, len(other) - 1, rng.randrange(len(other))])
            if rng.random() < 0.5:
                other[at] = f"x{rng.randint(0, 5000)}"
            else:
                other = ["y", *other[:-1]]
        a, b = (grams(hashed.of(" ".join(x).encode().split()), 5) for x in (item, other))
        values, counts = np.unique(a, return_counts=True)
        if 0.8 <= decontamination.weighted_similarity(b, values, counts) < 1:
            total += 1
            near += int(np.bitwise_count(decontamination.fingerprints(a)[0] ^ decontamination.fingerprints(b)[0])) <= decontamination.RADIUS
    assert near >= 0.9 * total


# 4 ---------------------------------------------------------------------------


def expected_targets(sizes):
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, (s or "").encode())), itertools.cycle((5, 2, 1))))
    total, targets, left = sum(sizes.values()), {}, set(sizes)
    while left:
        rest = 1.5 * total - sum(targets.values())
        share = rest / sum(weights[s] for s in left)
        over = {s for s in left if share * weights[s] > 2 * sizes[s]}
        if not over:
            targets |= {s: share * weights[s] for s in left}
            break
        targets |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    return targets


def test_mixture(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 50)), "en", rng.choice(["b", "a", "é", "z", None, "a"])) for i in range(800)]
    got = mixing.mixture(frame(spark, rows)).collect()
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(found(t))
    targets, source, taken = expected_targets(sizes), {r[0]: r[3] for r in rows}, collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s])
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size
        epochs = int(targets[s] / sizes[s] + 1e-12)
        assert r.taken in (epochs * r.size, (epochs + 1) * r.size)
        taken[s] += r.taken
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 50
    again = mixing.mixture(frame(spark, rows).repartition(7))
    assert rows_of(again, "doc_id", "taken") == sorted((r.doc_id, r.taken) for r in got)


def test_mixture_takes_the_smallest_keys(spark):
    """The documents that are taken once more are those that a full sort by key
    and prefix sums choose."""
    rng = random.Random(14)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), "en", rng.choice("aaabc")) for i in range(600)] + [(None, f"x y {i}", "en", "a") for i in range(40)] + [(7, f"z {i}", "en", "c") for i in range(40)]
    docs = frame(spark, rows)
    keys = mixing.sample_keys(docs, F.col("doc_id"), F.col("text")).collect()
    sizes = collections.Counter()
    for r in keys:
        sizes[r.source] += r.size
    expected = collections.Counter()
    for s, target in expected_targets(sizes).items():
        epochs = int(target / sizes[s] + 1e-12)
        run, rest = 0, target - epochs * sizes[s]
        for r in sorted((r for r in keys if r.source == s), key=lambda r: r.key):
            more = rest > 0 and run + r["size"] / 2 <= rest
            run += r["size"]
            if r["size"]:
                expected[r.doc_id, r.text] = epochs + more
    mixed = collections.Counter((r.doc_id, r.text) for r in mixing.mix(clashing(docs)).collect())
    assert mixed == +expected
    told = collections.Counter()
    for r in mixing.mixture(docs).collect():
        told[r.doc_id] += r.taken
    words_taken = collections.Counter()
    for (d, t), n in expected.items():
        words_taken[d] += n * len(found(t))
    assert {d: n for d, n in told.items() if n} == {d: n for d, n in words_taken.items() if n}


def test_many_sources(spark):
    rows = [(i, "a b c", "en", f"s{i % 97}" if i % 97 else None) for i in range(400)]
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += 3
    targets = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    assert {r.source: r.target for r in targets.collect()} == pytest.approx(expected_targets(sizes))


def test_mixture_prefers_quality(spark):
    rows = [(i, " ".join(["word"] * 20) if i % 2 else " ".join(["#1"] * 20), "en", "s" if i < 2000 else "t") for i in range(2200)]
    got = {r.doc_id: r.copies for r in mixing.mixture(frame(spark, rows), budget=0.3).collect()}
    assert sum(got[i] for i in range(2000) if i % 2) > 2 * sum(got[i] for i in range(2000) if not i % 2)


def test_equal_rows_meet_their_target(spark):
    """Of rows that share a key so many are taken as the budget asks for."""
    rows = [(None, "ten words " * 5, "en", "a")] * 1000 + [(i, "one two three", "en", "b") for i in range(2000)] + [(5, "x y", "en", None)] * 300
    docs = frame(spark, rows).repartition(6)
    got = mixing.mixture(clashing(docs))
    by_source = {r.t: (r.taken, r.target, r.size) for r in got.groupBy(F.round("target", 3).alias("t")).agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("size")).collect()}
    assert len(by_source) == 3 and all(abs(taken - target) <= size for taken, target, size in by_source.values())
    assert got.filter("taken > 2 * size").count() == 0
    plain = lambda df: sorted(tuple(r) for r in df.groupBy("doc_id", "size", "taken").count().select(F.coalesce("doc_id", F.lit(-1)), "size", "taken", "count").collect())
    assert plain(got) == plain(mixing.mixture(docs.repartition(3)))
    mixed = mixing.mix(clashing(docs)).groupBy("source").agg(F.sum(F.size(words.word_array(F.col("text")))).alias("n")).collect()
    assert sorted(r.n for r in mixed) == sorted(v[0] for v in by_source.values())


def test_mixture_edges(spark, nothing, awkward):
    assert mixing.mixture(nothing).count() == 0
    got = mixing.mixture(clashing(awkward))
    assert got.count() == awkward.count()
    assert got.filter("taken > 2 * size").count() == 0
    assert mixing.mix(clashing(awkward)).columns == clashing(awkward).columns
    blank = frame(spark, [(1, ""), (2, None, "en", None)])
    assert {r.taken for r in mixing.mixture(blank).collect()} == {0}


# 5, 9 ------------------------------------------------------------------------

ODD = ["", "a  b", "\n\na b \n c", "x<|endoftext|>y", "a\x1cb c  ", " lead", "trail  ", "tab\t\tq\r\nz", "don't  we'll\n'll", "\x0b\x0c", "a\xa0b c", "naïve 東京 🚢 x", "1234 5678\n9", "-- ==\n\n\n", " ", "\na", "a\n", "x\x00y z"]


@pytest.mark.parametrize("at_once", [1, 9, 1000])
def test_pieces_encode_as_whole_texts(at_once):
    e, whole = tokenizing.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    rng = random.Random(4)
    parts = ["a", "B", " ", "\n", "é", "9", "'s", "!", " x", "東", "word", "  ", "\t", "\x85", "\xa0", "\x00"]
    texts = ODD + ["".join(rng.choice(parts[: 9 + i % 8]) for _ in range(rng.randint(0, 40))) for i in range(400)]
    for _ in range(2):
        for i in range(0, len(texts), at_once):
            some = texts[i : i + at_once]
            ids, counts = e.encode(pa.array(some))
            bounds = np.concatenate([[0], np.cumsum(counts)])
            for t, a, b in zip(some, bounds, bounds[1:]):
                assert whole.encode(t, add_special_tokens=False).ids == ids[a:b].tolist(), repr(t)
            assert e.lengths(pa.array(some)).tolist() == counts.tolist()
        e._forget()


def test_encoder_forgets_pieces(monkeypatch):
    monkeypatch.setattr(tokenizing, "REMEMBERED", 20)
    e, whole = tokenizing.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for i in range(30):
        text = " ".join(f"t{j}" for j in range(i, 2 * i))
        assert e.encode(pa.array([text, None]))[0].tolist() == whole.encode(text, add_special_tokens=False).ids
        assert len(e.known) <= 20 + 2 * 30


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, awkward, tmp_path, encoding):
    df = awkward.unionByName(frame(spark, [(50 - i, t) for i, t in enumerate(ODD)]))
    token_files.write_tokens(clashing(df), str(tmp_path / "t"), TOKENIZER, encoding=encoding)
    files = token_files.read_tokens(spark, str(tmp_path / "t"))
    whole = Tokenizer.from_file(TOKENIZER)
    texts = collections.Counter((r.doc_id, tuple(whole.encode(r.text or "", add_special_tokens=False).ids + [0])) for r in df.collect())
    assert collections.Counter((r.doc_id, tuple(r.tokens)) for r in files.collect()) == texts
    got = sorted(token_files.digests(files).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert at == sum(len(x) * n for (_, x), n in texts.items())
    crc = collections.Counter((d, zlib.crc32(np.array(x, "<u4").tobytes())) for (d, x), n in texts.items() for _ in range(n))
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in got) == crc
    some = token_files.read_tokens(spark, str(tmp_path / "t"), 40, 45)
    assert {r.doc_id for r in some.collect()} == set(range(40, 46))


@pytest.mark.parametrize(("encoding", "used"), [("dictionary", {"PLAIN_DICTIONARY", "RLE_DICTIONARY"}), ("delta", {"DELTA_BINARY_PACKED"})])
def test_token_file_layout(spark, tmp_path, encoding, used):
    rng = random.Random(6)
    docs = frame(spark, [(i, " ".join(f"w{rng.randint(0, 300)}" for _ in range(400))) for i in range(600)])
    path = str(tmp_path / "t")
    token_files.write_tokens(docs.coalesce(1), path, TOKENIZER, encoding=encoding, row_group_bytes=64 * 2**10, page_bytes=8 * 2**10)
    groups = 0
    for file in tmp_path.glob("t/*.parquet"):
        told = pq.ParquetFile(file).metadata
        groups += told.num_row_groups
        for g in range(told.num_row_groups):
            ids = told.row_group(g).column(4)
            assert ids.path_in_schema.startswith("tokens") and used & set(ids.encodings)
            assert ids.has_column_index and ids.has_offset_index
            assert told.row_group(g).column(0).statistics.has_min_max
    assert groups > len(list(tmp_path.glob("t/*.parquet")))
    some = token_files.read_tokens(spark, path, 100, 110)
    assert "GreaterThanOrEqual(doc_id,100)" in some._jdf.queryExecution().toString()
    assert sorted(r.doc_id for r in some.collect()) == list(range(100, 111))
    # a narrow read leaves the ids out of the scan
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in some.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()


def test_token_files_of_one_hot_id_and_long_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "AT_ONCE", 100)
    rows = [(7, f"same id {i}") for i in range(300)] + [(7, "again")] * 50 + [(8, "long " * 3000), (None, "x y"), (9, None)]
    got = token_files.round_trip(clashing(frame(spark, rows)), TOKENIZER).collect()
    whole = Tokenizer.from_file(TOKENIZER)
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == collections.Counter((d, len(whole.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_token_file_edges(spark, nothing, tmp_path):
    assert token_files.round_trip(nothing, TOKENIZER).count() == 0
    with pytest.raises(ValueError, match="encoding"):
        token_files.write_tokens(nothing, str(tmp_path / "x"), TOKENIZER, encoding="zip")


def test_token_counts(spark, awkward, nothing):
    assert token_counts.token_counts(nothing, TOKENIZER).count() == 0
    whole = Tokenizer.from_file(TOKENIZER)
    n = np.array([len(whole.encode(r.text or "", add_special_tokens=False).ids) for r in awkward.collect()])
    totals = token_counts.token_counts(clashing(awkward), TOKENIZER).cache()
    got = totals.collect()
    assert {r.length for r in got} == set(n.tolist())
    for r in got:
        x = r.length
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == ((n == x).sum(), (n >= x).sum(), n[n >= x].sum())
        assert (r.truncated_total, r.dropped_total) == (np.minimum(n, x).sum(), n[n <= x].sum())
        assert r.quantile == pytest.approx((n <= x).mean())
    for limit in (0, 1, 3, 100, 5000, 10**7):
        assert token_counts.truncated_total(totals, limit).first().total == np.minimum(n, limit).sum()


# 6 ---------------------------------------------------------------------------

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_components(docs, width, percent=80):
    sets = {}
    for d, t in docs:
        w = found((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return sorted((d, len(s), top(d), top(d) == d) for d, s in sets.items())


def near_corpus(seed, copies):
    rng = random.Random(seed)
    text = lambda n: [f"n{rng.randint(0, 5000)}" for _ in range(n)]
    docs = [text(rng.randint(0, 80)) for _ in range(30)]
    for size in (60, 150):
        base = text(size)
        for _ in range(copies):
            d = list(base)
            for _ in range(rng.randint(0, size // 8)):
                d[rng.randint(0, size - 1)] = f"k{rng.randint(0, 10**6)}"
            docs.append(d)
    docs += [docs[31], docs[31], ["One"], ["one"], ["two"], ["a", "b"], ["A", "B"]]
    rng.shuffle(docs)
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize(("width", "copies"), [(2, 12), (5, 12), (2, 90)])
def test_near_duplicates_match_brute_force(spark, width, copies):
    docs = near_corpus(width, copies)
    got = near_dedup.near_duplicates(clashing(frame(spark, docs)), width=width)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == brute_components(docs, width)


def test_near_duplicates_of_repeated_rows(spark, monkeypatch):
    """Five groups of one base: each text has five edits, of which its group
    shares one, and just misses the least similarity with texts of other groups.
    All is left to the last round, that of large groups."""
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 0)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(151)]
    used, docs = [], []
    for i in range(5):
        shared = 30 * i + 1
        for j in range(8):
            at = {shared}
            while len(at) < 5 or any(len(at & x) > 1 for x in used):
                at = {shared, *(2 * p + 1 for p in rng.sample(range(75), 4))}
            used.append(at)
            docs.append((8 * i + j, " ".join(f"s{i}" if p == shared else f"e{i}_{j}_{p}" if p in at else w for p, w in enumerate(base))))
    expected = brute_components(docs, 2)
    assert len(docs) > near_dedup.SMALL and len({c for _, _, c, _ in expected}) == 5
    got = near_dedup.near_duplicates(frame(spark, docs + docs), width=2)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(expected * 2)


def test_large_groups_are_dealt_over_tasks(spark, monkeypatch):
    """One large group of near copies, one of copies, and texts without words give
    the same when their rows are dealt over several tasks."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(f"x{i}" if j in (k := rng.sample(range(60), 3)) else w for j, w in enumerate(base))) for i in range(90)]
    docs += [(1000 + i, "copied words " * 9) for i in range(80)] + [(2000 + i, " ") for i in range(40)] + [(None, "copied words " * 9)]
    df = frame(spark, docs)
    plain = rows_of(near_dedup.near_duplicates(df, width=2), "doc_id", "n_shingles", "component_id", "kept")
    monkeypatch.setattr(near_dedup, "GROUP_ROWS", 7)
    monkeypatch.setattr(graph, "HUB", 7)
    assert rows_of(near_dedup.near_duplicates(df, width=2), "doc_id", "n_shingles", "component_id", "kept") == plain
    assert sum(c == 1000 for _, _, c, _ in plain) == 80
    edges = spark.createDataFrame([(0, i) for i in range(1, 3000)], "a long, b long").repartition(8)
    assert {r.component for r in graph.components(edges).collect()} == {0}


def test_a_hot_key_is_joined_in_several_tasks(spark):
    left = spark.range(4000).select(F.lit(1).alias("k"), "id").unionByName(spark.range(50).select((F.col("id") + 2).alias("k"), "id"))
    right = left.select(F.col("k").alias("r"), (F.col("k") * 10).alias("value")).distinct()
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    joined = spread_join(left, right, {"k": "r"}, counts, ["id"], 500, bound=4050)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert joined.filter("value = k * 10").count() == 4050
        assert joined.filter("k = 1").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_near_duplicate_edges(spark, nothing, awkward):
    assert near_dedup.near_duplicates(nothing).count() == 0
    got = near_dedup.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by[7].component_id, by[5].component_id, by[1].n_shingles, by[1].component_id) == (6, 4, 0, 1)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    kept = near_dedup.keep_one(clashing(awkward))
    assert kept.columns == clashing(awkward).columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter([1, 2, 3, 4, 6, 8, 9, 10, 11, None, None])


def test_keep_one_judges_rows_and_reruns_agree(spark):
    rng = random.Random(17)
    a, b, c = (" ".join(f"{x}{rng.randint(0, 9999)}" for _ in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (5, b + " end"), (None, a), (None, c), (None, c), (9, c), (3, b), (3, None), (3, "")]
    expected = collections.Counter([(5, a), (3, b), (9, c), (3, None), (3, "")])
    for n in (1, 3, 5):
        assert collections.Counter((r.doc_id, r.text) for r in near_dedup.keep_one(clashing(frame(spark, rows).repartition(n))).collect()) == expected


def test_sketch_agreement_is_the_similarity():
    rng = np.random.default_rng(0)
    common, left, right = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 200, 200))
    a, b = np.concatenate([common, left]), np.concatenate([common, right])
    values, owner = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
    x, y = near_dedup.sketch(values, owner, 2, 1024)
    assert abs((x == y).mean() - 0.6) < 0.06
    full = np.iinfo(np.uint64).max
    tiny = near_dedup.sketch(np.array([5], np.uint64), np.array([1]), 2, 64)
    assert (tiny[0] == full).all() and (tiny[1] != full).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 100), (7, 7), (300, None)] + [(400, 400 + i) for i in range(1, 50)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, **{i: 400 for i in range(400, 450)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7 ---------------------------------------------------------------------------


def test_quality_scores(spark):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["tide", "ship", "the", "of", "harbour", "wind"]) + rng.choice(["", "s", "ly"]) for _ in range(80)) + "."
    bad = lambda: " ".join(rng.choice(["BUY", "|", "###", "NOW!!", "$$$"]) for _ in range(80))
    docs = [(i, good() if i % 3 else bad()) for i in range(600)]
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(0, 600, 2)] + [(10, None), (11, 7), (9999, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_classifier.quality_scores(clashing(frame(spark, docs)), labels).collect()}
    for i in range(600):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.5)
    assert np.mean([got[i].predicted == (1 if i % 3 else 0) for i in range(600) if got[i].held_out]) > 0.98


def test_quality_score_edges(spark, nothing, awkward):
    labels = spark.createDataFrame([(8, 1), (9, 1), (4, 0), (11, 0)], "doc_id long, quality int")
    assert quality_classifier.quality_scores(nothing, labels).count() == 0
    got = quality_classifier.quality_scores(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality_classifier.quality_scores(awkward, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality_classifier.quality_scores(awkward, labels.filter("quality = 1")).collect()} <= {0.5, 1.0}


def test_scores_match_a_direct_discriminant(spark):
    rng = random.Random(19)
    parts = ["tide", "ship", "THE", "of.", "###", "42", "|", "wow!", "a"]
    docs = [(i, "\n".join(" ".join(rng.choice(parts[: 5 + i % 5]) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 4)))) for i in range(150)]
    labels = [(i, int(i % 5 < 2 or rng.random() < 0.2)) for i in range(150)]
    got = {r.doc_id: r.score for r in quality_classifier.quality_scores(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    x = np.array([quality_classifier.document_statistics(t.encode()) for _, t in docs])
    train = [(i, q) for i, q in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = {q: x[[i for i, p in train if p == q]] for q in (0, 1)}
    own = {q: np.cov(r.T, bias=True) for q, r in rows.items()}
    pooled = sum(len(rows[q]) * own[q] for q in rows) / len(train)
    density = []
    for q in (0, 1):
        w = min(1.0, 0.1 + x.shape[1] / len(rows[q]))
        c = (1 - w) * own[q] + w * np.diag(np.maximum(np.diag(pooled), 1e-3)) + 1e-6 * np.eye(x.shape[1])
        d = x - rows[q].mean(axis=0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    expected = 1 / (1 + np.exp(-np.clip(quality_classifier.TEMPERATURE * (density[1] - density[0]), -40, 40)))
    assert [got[i] for i, _ in docs] == pytest.approx(expected.tolist(), abs=1e-6)


def test_scores_rank_the_held_out_labels(spark):
    """Area under the curve on the held-out labels of the given tables."""
    sf = "/root/testdata/sf0.01"
    scores = quality_classifier.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = scores.filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.9


def test_held_out_labels_are_not_learnt(spark):
    docs = frame(spark, [(i, f"text {'!' * (i % 5)} number {i}") for i in range(60)])
    labels = [(i, int(i % 5 == 0)) for i in range(60)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in labels]
    a, b = (rows_of(quality_classifier.quality_scores(docs, spark.createDataFrame(x, "doc_id long, quality int")), "doc_id", "score") for x in (labels, flipped))
    assert a == b


# 8 ---------------------------------------------------------------------------


def test_lookup_table_is_even_and_steady():
    names = [f"s{i}" for i in range(10)]
    owner = sharding.lookup_table(names, 1009)
    counts = collections.Counter(owner)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(owner, fewer) if a != 9)
    assert moved < 0.15 * 1009
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_sharding(spark, nothing, awkward, tmp_path):
    assert sharding.assign_shards(nothing).count() == 0
    got = sharding.assign_shards(clashing(awkward))
    assert got.count() == awkward.count()
    owner = sharding.lookup_table([f"shard-{i}" for i in range(sharding.SHARDS)])
    for r in got.collect():
        key = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, owner[slot])
    sharding.write_shards(awkward, str(tmp_path / "s"), 2, shards=4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == awkward.count()


# 10 --------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


@functools.cache
def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        if kind == "email" and "@" not in (text or ""):
            continue
        for m in re.finditer(pattern, text or ""):
            w, d = m.group(), re.sub("[^0-9]", "", m.group())
            if {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in w.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check_base(df):
    got = pii.personal_data(df).collect()
    expected = collections.Counter((r.doc_id, *(sum(s.startswith(k) for s in base_spans(r.text)) for k in BASE), hashlib.sha256(",".join(base_spans(r.text)).encode()).hexdigest()) for r in df.collect())
    assert collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == expected
    by = collections.defaultdict(set)
    for r in df.collect():
        by[r.doc_id] |= set(base_spans(r.text))
    for r in got:
        assert set(x for x in r.spans.split(",") if x.split(":")[0] in BASE) <= by[r.doc_id]
    return got


def test_personal_data(spark, awkward):
    rng = random.Random(8)
    parts = ["a@b.co", "_m@x.yz", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111", "9", " ", "-", "+", "+1 (555) 123-4567", "é", "🚢", "\n", "x", "00", "(555) 123-4567", "0123456789abcdef" * 2, "key "]
    rows = [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    rows += [(500, "4" * 30_000), (501, "a" * 50_000 + "@b.c"), (502, "1." * 20_000), (503, "4111111111111111 " * 500), (504, "+" + "1 " * 10_000)]
    check_base(clashing(awkward.unionByName(frame(spark, rows))))


def test_personal_data_addresses_with_zeros(spark):
    alone = ["10.0.0.1", "0.0.0.0", "255.0.255.000", "192.168.0.1", "00.00.00.00", "007.08.0255.1", "0.0.0.0256"]
    wrong = ["256.0.0.1", "0.0256.0.0", "0.0.0.999", "1.2.3"]
    rng = random.Random(10)
    parts = ["0", "00", "000", "1", "10", "025", "255", "0256", "256", "100"]
    rows = list(enumerate(alone + wrong)) + [(100 + i, "x " + ".".join(rng.choice(parts) for _ in range(rng.randint(3, 9))) + " y") for i in range(100)]
    rows += [(500, "0" * 3_000 + ".0.0." + "0" * 3_000)]
    got = {r.doc_id: r.n_ip for r in check_base(frame(spark, rows))}
    assert [got[i] for i in range(len(alone) - 1)] == [1] * (len(alone) - 1)
    assert got[6] == got[7] == got[8] == got[9] == got[10] == 0 and got[500] == 1


def test_personal_data_adds_spans(spark):
    secret = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"
    rows = [(i, f'mail me at u{i}@site.com or call +1 (555) 010-{1000 + i}, the api key "{secret[i % 7 :]}"') for i in range(40)]
    got = check_base(frame(spark, rows))
    assert all("secret:" in r.spans for r in got)
    text = pii.redact(clashing(frame(spark, rows[:1])))
    assert text.first().text == 'mail me at <EMAIL> or call <PHONE>, the api key "<SECRET>"'
    assert text.columns == clashing(frame(spark, rows[:1])).columns


def test_personal_data_in_very_long_texts(spark):
    """Texts in which a pattern repeats itself tens of thousands of times."""
    rows = [(1, "a." * 50_000 + "a@b.co"), (2, "x@" + "b." * 50_000 + "co"), (3, "+1" + "." * 50_000 + "23456789 1"), (4, "1." * 50_000), (5, "4 " * 50_000), (6, "(555) 123-" * 20_000), (7, "0a" * 50_000), (8, "1.2.3.4 " * 5_000), (9, "mail u@v.org, " * 5_000), (10, "+1 (555) 010-1000 " * 10_000)]
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in check_base(frame(spark, rows))}
    assert got[1] == got[2] == (1, 0, 0, 0) and got[8][1] == got[9][0] == 5_000


def test_personal_data_edges(spark, nothing, awkward):
    assert pii.personal_data(nothing).count() == 0
    twice = rows_of(pii.personal_data(awkward.unionByName(awkward)), "doc_id", "base_sha256")
    assert twice == sorted(rows_of(pii.personal_data(awkward), "doc_id", "base_sha256") * 2, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def brute_votes(spans, rounds=50):
    """Expectation and maximisation span by span, and a naive Bayes classifier."""
    p = [min(0.95, max(0.05, (1 + sum(v == 1 for v in s["votes"])) / (2 + sum(v >= 0 for v in s["votes"])))) for s in spans]
    for _ in range(rounds):
        prior = {k: (1 + sum(x for x, s in zip(p, spans) if s["kind"] == k)) / (2 + sum(s["kind"] == k for s in spans)) for k in {s["kind"] for s in spans}}
        right = []
        for i in range(3):
            said = [(x, s["votes"][i]) for x, s in zip(p, spans) if s["votes"][i] >= 0]
            right.append(((2 + sum(x for x, v in said if v == 1)) / (3 + sum(x for x, _ in said)), (2 + sum(1 - x for x, v in said if v == 0)) / (3 + sum(1 - x for x, _ in said))))
        for j, s in enumerate(spans):
            yes, no = prior[s["kind"]], 1 - prior[s["kind"]]
            for v, (a, b) in zip(s["votes"], right):
                if v >= 0:
                    yes, no = yes * (a if v else 1 - a), no * (1 - b if v else b)
            p[j] = yes / (yes + no)
    verdicts = []
    for s in spans:
        own = [(x, t) for x, t in zip(p, spans) if t["kind"] == s["kind"]]
        good, bad = 1 + sum(x for x, _ in own), 1 + sum(1 - x for x, _ in own)
        log = np.log(good / bad)
        for f, v in s["features"].items():
            n = len({t["features"][f] for _, t in own})
            log += np.log((1 + sum(x for x, t in own if t["features"][f] == v)) / (good + n)) - np.log((1 + sum(1 - x for x, t in own if t["features"][f] == v)) / (bad + n))
        verdicts.append(log > 0)
    return p, verdicts


def test_added_spans_match_brute_force(spark):
    rng = random.Random(11)
    secret = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    makers = [lambda: f'api key "{secret(40)}"', lambda: f"see commit {secret(40)} there", lambda: f"x {secret(rng.randint(33, 70))} y", lambda: f"call ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}", lambda: f"article {rng.randint(100, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}", lambda: f"card {rng.randint(10**15, 10**16)}", lambda: f"isbn {rng.randint(10**12, 10**13)}", lambda: f"u{rng.randint(0, 99)}@site.org", lambda: f"host {rng.randint(1, 300)}.2.3.4"]
    docs = frame(spark, [(i, " ".join(rng.choice(makers)() for _ in range(rng.randint(0, 8)))) for i in range(120)])
    spans = [{**r.asDict(), "votes": (r.regex, r.gazetteer, r.context), "features": {f: r[f] for f in pii.FEATURES}} for r in pii.candidates(docs).select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.*").collect()]
    assert {s["kind"] for s in spans} == set(pii.KINDS) - {"phone"}
    _, verdicts = brute_votes(spans)
    expected = collections.Counter((s["doc_id"], s["kind"], s["start"], s["end"]) for s, v in zip(spans, verdicts) if v or s["kind"] in BASE)
    got = pii.personal_spans(docs).select("doc_id", F.explode("spans").alias("x")).select("doc_id", "x.*").collect()
    assert collections.Counter((r.doc_id, r.kind, r.start, r.end) for r in got) == expected
    extra = [v for s, v in zip(spans, verdicts) if s["kind"] not in BASE]
    assert any(extra) and not all(extra)


def test_gazetteers_are_parameters(spark):
    text = "mail me at u@site.zz, key 0123456789abcdef0123456789abcdef"
    none = pii.Knowledge(gazetteer={"email": (["zz"], r"\.(?:{})$")}, cues=pii.CUES, against=["mail"])
    one = pii.candidates(frame(spark, [(1, text)]), none).first().found
    assert [(s.kind, s.gazetteer, s.context) for s in one] == [("email", 1, 0), ("secret", -1, 0)]
    assert [s.gazetteer for s in pii.candidates(frame(spark, [(1, text)])).first().found] == [0, 1]


def test_votes_tell_good_labelers_from_bad():
    rng = random.Random(1)
    counts = collections.Counter()
    for _ in range(5000):
        y = rng.random() < 0.5
        vote = lambda p: int(y == (rng.random() < p))
        counts["k", vote(0.95), vote(0.9), vote(0.6)] += 1
    reliability, personal = pii.estimate(counts)
    good, bad = reliability["regex"], reliability["context"]
    assert min(good) > 0.85 and max(bad) < 0.75
    assert personal["k", 1, 1, 0] > 0.9 > 0.1 > personal["k", 0, 0, 1]


# words -----------------------------------------------------------------------


def test_words_are_the_same_in_spark_and_python(spark, awkward):
    got = awkward.select("text", words.word_array(F.col("text")).alias("w")).collect()
    assert all(r.w == found(r.text) for r in got)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 100])
def test_running_sums(spark, n):
    values = [(i * 7) % 5 + 1 for i in range(n)]
    got = spark.createDataFrame([(values,)], "x array<int>").select(words.running_sums(F.col("x")).alias("s")).first().s
    assert got == list(itertools.accumulate(values))


def test_pieces_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array([b"", None, b"x" * 50, b"y" * 5, None, b"z" * 500], pa.binary())})
    for size in (1, 10, 60, 1000):
        assert [x for b in words.pieces([batch, batch.slice(2)], size) for x in words.texts(b)] == words.texts(batch) + words.texts(batch.slice(2))


def test_further_kinds_are_found_and_look_alikes_left(spark):
    """Precision and recall by kind, on spans whose truth is known."""
    rng = random.Random(31)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n - 2)) + "a1"
    name = lambda n: "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZ", k=n - 1)) + "7"
    made = {
        "secret": [lambda: f'api token = "{hexes(40)}" kept', lambda: f"the secret key is {hexes(32)}, hide it", lambda: f"auth AKIA{name(16)} for the bucket", lambda: f'token: "ghp_{name(36)}"'],
        "local_phone": [lambda: f"please call ({rng.randint(201, 989)}) {rng.randint(200, 989)}-{rng.randint(1000, 9999)} today", lambda: f"tel {rng.randint(201, 989)}-{rng.randint(200, 989)}-{rng.randint(1000, 9999)} at noon"],
        None: [lambda: f"commit {hexes(40)} fixed it", lambda: f"sha256 checksum {hexes(64)} of the file", lambda: f"version {rng.randint(100, 199)}.{rng.randint(100, 199)}-{rng.randint(1000, 9999)} is out", lambda: "nothing of the kind"],
    }
    truth, rows = {}, []
    for kind, makers in made.items():
        for i in range(60):
            truth[len(rows)] = kind
            rows.append((len(rows), makers[i % len(makers)]()))
    got = {r.doc_id: {x.kind for x in r.spans} for r in pii.personal_spans(frame(spark, rows)).collect()}
    for kind in ("secret", "local_phone"):
        said, true = {i for i, x in got.items() if kind in x}, {i for i, k in truth.items() if k == kind}
        assert len(said & true) >= 0.9 * len(true) and len(said & true) >= 0.9 * len(said)
