"""Brute-force checks and edge cases of phrases, suffix tree and cuts."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attestra.llm import collocations, fill_middle, shards, suffix_tree, toxicity
from attestra.llm.labelled import fold
from attestra.runtime import materialise

DOCS = "doc_id long, text string, lang string, lang_ string, shard long, score string, n int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, "y", 2) for i, t, lang in rows], DOCS)


def prose(seed, docs, vocabulary, repeats=()):
    rng, rows = random.Random(seed), []
    for i in range(docs):
        w = [f"w{min(int(rng.paretovariate(0.7)), vocabulary)}" for _ in range(rng.randrange(30, 80))]
        for phrase in repeats:
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w[at:at] = phrase.split()
        marks = [x + rng.choice([" ", " ", " ", ", ", ". ", "\t", "\n"]) for x in w]
        rows.append((i, "".join(marks), rng.choice(["en", "de", None])))
    return rows


# blocks


def test_blocks_come_back_and_sorts_agree():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000):
        for kind in ("<u8", "<i4", "<u2"):
            a = rng.integers(0, 60_000, n).astype(kind)
            assert (shards.expand(shards.squeeze(a), kind) == a).all()
        x = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (shards.expand_sorted(shards.squeeze_sorted(x)) == x).all()
        y = np.concatenate([x, x, np.array([2**64 - 1, 0, 1, 1], np.uint64)])  # numbers that agree in their high bits
        assert (y[shards.ascending(y)] == np.sort(y)).all()
        small = rng.integers(0, 50, len(y)).astype(np.uint64)
        order = shards.ascending_pairs(y, small)
        assert [(int(y[i]), int(small[i])) for i in order] == sorted(zip(y.tolist(), small.tolist(), strict=True))
    cut = shards.cut_points(x, 7)
    assert cut[0] == 0 and cut[-1] == len(x) and (np.diff(cut) >= 0).all()


def test_hashes_of_words_tell_them_apart():
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"ab\x00\xff\xc3") for _ in range(rng.randrange(1, 40))) for _ in range(20_000)} | {b"a", b"a\0", b"a\0\0", b"x" * 5000})
    rng.shuffle(words)
    got = shards.word_hashes(b" ".join(words))
    assert len(set(got.tolist())) == len(words) == len(got)
    again = shards.word_hashes(b" ".join(words[::-1]))
    assert (again[::-1] == got).all() and len(shards.word_hashes(b"")) == 0


# phrases


def plain_collocations(rows, longest, least, top, within):
    count, words = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            words[lang or "und"] += len(w)
            for n in range(1, longest + 1):
                count[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in count.items():
        candidates = {g: a for g, a in f.items() if len(g) >= 2 and a >= least}
        inside = Counter()
        for g, a in candidates.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    inside[g[i : i + m]] = max(inside[g[i : i + m]], a)
        rest = []
        for g, a in candidates.items():
            if inside[g] and 100 * inside[g] >= within * a:
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            rest.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, words[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rest)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("longest", [3, 4])
def test_collocations_equal_a_plain_count(spark, longest, monkeypatch):
    rows = prose(5, 240, 60, ["New York City", "hot hot hot hot", "ÀÉ größe"]) + [(900, None, "en"), (901, "", None), (902, " .,\t", "de"), (903, "solo", "fr"), (904, "a b " * 3000, "en"), (904, "a b " * 3000, "en")]
    monkeypatch.setattr(shards, "BUCKET_KEYS", 700)
    got = collocations.collocations(docs_of(spark, rows), max_words=longest, least=10, top=40, shard_words=900)
    want = plain_collocations(rows, longest, 10, 40, 50)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == want
    assert len({r[0] for r in want}) == 3


def test_suffix_arrays_and_intervals():
    rng = np.random.default_rng(6)
    words = rng.integers(0, 4, 300).astype(np.int32)
    order = suffix = collocations.suffix_array(words, 4)
    assert [words[i : i + 4].tolist() for i in suffix] == sorted(words[i : i + 4].tolist() for i in order)
    for n, place, count in collocations.intervals(words, 3):
        plain = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1) if 0 not in words[i : i + n])
        assert {tuple(words[p : p + n]): c for p, c in zip(place, count, strict=True)} == plain


def test_scores_beyond_64_bits(spark):
    a, left = 5_000_000_019, 9_000_000_001
    row = spark.createDataFrame([(a, left)], "a long, l long").select(F.expr("(cast(a as decimal(19,0)) * cast(a as decimal(19,0)) * 1000000BD) div (cast(l as decimal(19,0)) * cast(l as decimal(19,0)))").alias("s")).first()
    assert row["s"] == 1_000_000 * a * a // (left * left)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs_of(spark, [])).collect() == []
    assert collocations.collocations(docs_of(spark, [(1, None, None), (2, "", "en"), (3, "one two", "en")])).collect() == []


# suffix tree


def plain_scores(rows, learn, depth, least, prior):
    """The definition, context by context."""
    tokens = {i: [w.decode() for w in (t or "").encode().lower().split()] + ["\0end"] for i, (_, t, _) in enumerate(rows)}
    count, follow = Counter(), defaultdict(Counter)
    for i, w in tokens.items():
        if learn(rows[i][0]):
            count.update(w)
            for k in range(1, depth + 1):
                for j in range(k, len(w)):
                    follow[tuple(w[j - k : j])][w[j]] += 1
    total = sum(count.values())
    base = lambda x: (count[x] + 0.5) / (total + 0.5 * (len(count) + 1))
    bar, states, memo = math.log(max(total, 2)), {(): None}, {}

    def p(x, s):
        while s not in states:
            s = s[1:]
        if not s:
            return base(x)
        if (x, s) not in memo:
            held, c = states[s], sum(follow[s].values())
            memo[x, s] = (held.get(x, 0) + (c - sum(held.values()) + prior) * p(x, s[1:])) / (c + prior)
        return memo[x, s]

    for k in range(1, depth + 1):
        for s, after in follow.items():
            c = sum(after.values())
            if len(s) == k and c >= least and s[1:] in states and (k == 1 or s[1:-1] in states):
                held = {x: n for x, n in after.items() if n >= least and n * (math.log(n / c) + math.floor(-1000 * math.log(p(x, s[1:]))) / 1000) >= bar}
                if held:
                    states[s] = held
    out = []
    for i, w in tokens.items():
        score = sum(math.log10(p(x, tuple(w[max(0, j - depth) : j]))) for j, x in enumerate(w))
        out.append((rows[i][0], not learn(rows[i][0]), len(w), sum(count[x] > 0 for x in w), sum(math.log10(base(x)) for x in w), score, total))
    return out, states


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g[0], g[1], g[2], g[3], g[6]) == (w[0], w[1], w[2], w[3], w[6])
        assert g[4] == pytest.approx(w[4], abs=1e-6) and g[5] == pytest.approx(w[5], abs=1e-6)


FIELDS = ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "train_tokens")


def tree(spark, rows, **kw):
    return [tuple(r) for r in suffix_tree.score(docs_of(spark, rows), fold(F.col("doc_id"), 5) != 1, **kw).select(*FIELDS).collect()]


def learns(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 != 1


def test_suffix_tree_equals_its_definition(spark, monkeypatch):
    rows = prose(7, 160, 400, ["a rare passage that many documents share word by word", "x y x y x y"]) + [(900, None, "en"), (901, "", "en"), (902, " \t\n", "en"), (903, "Only ÀÉ once", "en"), (904, "p q r " * 1500, "en"), (905, "p q r " * 40, "en"), (905, "p q r " * 40, "en"), (None, "no id at all", "en")]
    monkeypatch.setattr(shards, "BUCKET_KEYS", 800)
    want, states = plain_scores(rows, learns, 3, 2, 1.0)
    assert {len(s) for s in states} == {0, 1, 2, 3}
    close(tree(spark, rows, depth=3, shard_words=700), want)


def test_where_a_context_is_counted_changes_no_score(spark, monkeypatch):
    """Contexts whose next words are counted in all buckets, as frequent ones are, take no other formula."""
    rows = prose(11, 60, 30)
    want = tree(spark, rows, depth=3, shard_words=600)
    monkeypatch.setattr(shards, "BUCKET_KEYS", 500)
    for spread in (1, 8):
        assert tree(spark, rows, depth=3, shard_words=600, spread=spread) == want


def test_contexts_spread_over_buckets_keep_their_sums(spark, monkeypatch):
    """With every context taken as sure, the trusted shares of all next words and the rest must still add up."""
    rows = prose(9, 60, 30)
    monkeypatch.setattr(shards, "BUCKET_KEYS", 500)
    got = tree(spark, rows, depth=1, sure=1, least=1, shard_words=600)
    tokens = {i: t.encode().lower().split() + [None] for i, t, _ in rows}
    count, follow = Counter(), defaultdict(Counter)
    for i, w in tokens.items():
        if learns(i):
            count.update(w)
            for a, b in zip(w, w[1:], strict=False):
                follow[a][b] += 1
    total = sum(count.values())
    base = lambda x: (count[x] + 0.5) / (total + 0.5 * (len(count) + 1))

    def p(s, x):
        if count[s] > 1:
            return 0.9 * follow[s][x] / count[s] + 0.1 * base(x)
        held = {x: n for x, n in follow[s].items() if n * (math.log(n / count[s]) + math.floor(-1000 * math.log(base(x))) / 1000) >= math.log(total)}
        return (held.get(x, 0) + (count[s] - sum(held.values()) + 1) * base(x)) / (count[s] + 1) if held else base(x)

    for doc_id, _, _, _, _, score, _ in got:
        w = tokens[doc_id]
        assert score == pytest.approx(math.log10(base(w[0])) + sum(math.log10(p(a, b)) for a, b in zip(w, w[1:], strict=False)), abs=1e-6)


def test_held_out_text_is_foreseen_better_than_by_frequencies(spark):
    rows = [(i, t, "en") for i, t, _ in prose(11, 300, 3000, ["this passage of words comes back in many of the texts"])]
    held = [r for r in tree(spark, rows) if r[1]]
    assert held and sum(r[5] for r in held) > sum(r[4] for r in held)


def test_suffix_tree_of_nothing(spark):
    assert tree(spark, []) == []
    held = next(i for i in range(100) if not learns(i))
    assert sorted(tree(spark, [(held, "a b", "en"), (held, None, "en")])) == [(held, True, 1, 0, 0.0, 0.0, 0), (held, True, 3, 0, 0.0, 0.0, 0)]


# cuts


def plain_fim(doc_id, text):
    text, h = text or "", hashlib.sha256(b"1:" + ("" if doc_id is None else str(doc_id)).encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}")


def test_cuts_equal_plain_slices_and_come_back(spark):
    rng = random.Random(12)
    signs = "ab <>PSM\n\0é߀あ漢😀́﻿\U0010ffff"
    rows = [(i, "".join(rng.choice(signs) * rng.choice([1, 1, 1, 5]) for _ in range(rng.randrange(0, 60))), "en") for i in range(1500)]
    rows += [(2000, None, "en"), (2001, "", "en"), (2002, "x<S>y", "en"), (2003, "é" * 300_000 + "x" * 300_000 + "😀", "en"), (None, "no id", "en"), (7, "again", "en"), (7, "again", "en")]
    out = fill_middle.transform(docs_of(spark, rows))
    got = out.withColumn("again", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    want = sorted(((i, *plain_fim(i, t), t or "") for i, t, _ in rows), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs_of(spark, [])).collect() == []


def test_runs_are_maximal_and_offsets_exact():
    text = "aaé漢漢😀b"
    runs = fill_middle.encode_runs(np.frombuffer(text.encode(), np.uint8))
    assert runs.width.tolist() == [1, 2, 3, 4, 1] and runs.units.tolist() == [2, 3, 5, 6, 7]
    assert runs.offset(np.arange(8)).tolist() == [len(text[:k].encode()) for k in range(8)]
    assert fill_middle.encode_runs(np.zeros(0, np.uint8)).offset(np.zeros(2, np.int64)).tolist() == [0, 0]


# repairs of earlier operators


def test_segments_of_a_long_clean_text_with_scattered_hits_take_linear_time():
    n = 200_000
    places = [20 * i for i in range(n)]
    began = time.perf_counter()
    found = toxicity.segments(places, [0.5] * n, 0.05)  # each hit lies below all earlier ones
    rising = toxicity.segments(list(range(0, 2 * n, 2)), [1.0, -0.9] * (n // 2), 0.05)  # many stay on the stack
    assert time.perf_counter() - began < 5
    assert [(a, b) for a, b, _ in found] == [(p, p) for p in places] and len(rising) >= 1


@pytest.mark.parametrize("repeated", [False, True])
def test_rows_keep_columns_of_any_name_and_kind_in_the_jaccard_and_mixing_stages(spark, repeated):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, one, "s"), (2, one, "s"), (3, two, None), (4, None, "s"), (5, "", "s"), (6, " \n", "s")] + ([(5, None, "s"), (5, None, "s"), (3, two, "s")] if repeated else [])
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = ("row", "row_id", "at", "id", "component_id", "stays", "mixed_times", "mixed_copy", "mixed_source", "n", "h", "size", "slot")
    docs, _ = materialise(docs.withColumns({c: F.concat(F.lit(f"{c}-"), "doc_id") for c in clash} | {"map": F.create_map(F.lit("k"), "doc_id")}), "clash")
    whole = {tuple(map(str, r)) for r in docs.collect()}
    left, _ = materialise(corpus_pipeline.drop_copies(spark, docs, ""), "left")
    assert left.columns == docs.columns and left.schema["map"].dataType.simpleString() == "map<string,bigint>"
    assert {tuple(map(str, r)) for r in left.collect()} <= whole
    assert sorted(r["doc_id"] for r in left.collect()) == sorted([1, 3, 4, 5, 6] + ([5, 5] if repeated else []))
    mixed = corpus_pipeline.mix_sources(spark, left, "").collect()
    assert mixed and {tuple(map(str, r)) for r in mixed} <= whole and {r["doc_id"] for r in mixed} <= {1, 3}
