import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from attestra.llm import mixing, near_vectors, ngram_jaccard, packing, preference, routed_search, toxicity, url_filter, warc

DOCS = "doc_id long, text string, source string, extra string"


def sets(text, k):
    w = text.encode().lower().split() if text else []
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_jaccard_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "a b"), (3, "A B"), (4, "x " * 3000)]
    for i in range(5, 90):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            w[rng.randrange(60)] = f"n{rng.randrange(9999)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([(i, t, "s", "e") for i, t in rows], DOCS)
    link = {i: i for i, _ in rows}
    s = {i: sets(t, 4) for i, t in rows}
    top = lambda v: v if link[v] == v else top(link[v])
    for a, _ in rows:
        for b, _ in rows:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]):
                x, y = sorted((top(a), top(b)))
                link[y] = x
    for short, block, heavy in ((128, 512, 32), (3, 4, 5)):  # the second takes the paths of long columns
        monkeypatch.setattr(ngram_jaccard, "SHORT", short)
        monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
        monkeypatch.setattr(ngram_jaccard, "MIN_HEAVY", heavy)
        got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(docs, width=4, percent=85).collect()}
        assert got == {i: (len(s[i]), top(i)) for i, _ in rows}
    assert ngram_jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_jaccard_of_cut_and_quoted_texts(spark):
    """Texts and their cut or extended forms, while quotes of one shingle each are the hubs of their columns."""
    rng = random.Random(11)
    texts = []
    for f in range(12):
        w = [f"f{f}w{i}" for i in range(104)]
        texts += [w, w[:86], w[16:], w + [f"f{f}x{i}" for i in range(22)]] + [w[i : i + 5] for i in range(100)]
    rng.shuffle(texts)
    s = [sets(" ".join(w), 5) for w in texts]
    link = list(range(len(s)))
    top = lambda v: v if link[v] == v else top(link[v])
    for a in range(len(s)):
        for b in range(a + 1, len(s)):
            if 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = sorted((top(a), top(b)))
                link[y] = x
    docs = spark.createDataFrame([(i, " ".join(w), "s", "e") for i, w in enumerate(texts)], DOCS)
    got = {r["id"]: r["component_id"] for r in ngram_jaccard.jaccard_components(docs).collect()}
    assert got == {i: top(i) for i in range(len(s))}


def test_drop_copies_decides_by_row(spark):
    import corpus_pipeline

    one, two, three, four = (" ".join(f"{c}{i}" for i in range(40)) for c in "abcd")
    rows = [(1, one), (2, one), (2, two), (3, three), (3, four), (None, one), (5, two + " x"), (6, None), (6, None), (7, four)]
    docs = spark.createDataFrame([(i, t, "s", "e") for i, t in rows], DOCS)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_copies(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, one), (2, two), (3, three), (3, four), (None, one), (6, None), (6, None)], key=str)


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[100:160] = x[5] + rng.normal(scale=0.08, size=(60, 16))
    x[160:170] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16)]
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = y @ y.T >= 0.95
    got = {r["id"]: r for r in near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len(got) == 303 and got[901]["kept"] and got[900]["n_links"] == 0
    assert [got[i]["n_links"] for i in range(300)] == (hit.sum(1) - 1).tolist()
    assert got[105]["component_id"] == 5 and got[165]["component_id"] == 7


def test_routed_search_recall(spark):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + rng.normal(scale=0.5, size=(3000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)], "vec_id long, embedding array<float>")
    got = routed_search.search(df, F.col("id") % 50 == 0).collect()
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    right = 0
    for q in range(0, 3000, 50):
        s = y @ y[q]
        s[q] = -9
        right += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(-s)[:5].tolist()))
    assert len(got) == 300 and right >= 270


def test_routed_search_recall_beyond_the_sample(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(60, 16))[rng.integers(0, 60, 9000)] + rng.normal(scale=0.5, size=(9000, 16))).astype(np.float32)
    x[rng.permutation(9000)[:3000]] = x[7]  # a third of the rows are copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = routed_search.search(df, F.col("id") % 50 == 0, sample_rows=1500).collect()
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    right = total = 0
    for q in range(0, 9000, 50):
        s = y @ y[q]
        s[q] = -9
        if (x[q] == x[7]).all():
            continue  # its nearest are copies of itself
        least = np.sort(s)[-5] - 1e-9
        right += sum(r["score"] >= least for r in got if r["query_id"] == q)
        total += 5
    assert len(got) == 900 and total > 500 and right >= 0.9 * total


def test_pack_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, "hello  world \n\n x", "a", ""), (2, None, "a", ""), (3, "", None, ""), (4, "çé ü <|endoftext|> " * 400, "b", ""), (4, "z", "b", "")]
    docs = spark.createDataFrame(rows, DOCS)
    pieces = packing.pack(docs, window=64).collect()
    for i, text, *_ in rows[:4]:
        want = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        mine = sorted((p["start"], bytes(p["ids"])) for p in pieces if p["doc_id"] == i and p["doc_tokens"] == len(want) // 4)
        assert b"".join(b for _, b in mine) == want
    seq = packing.sequences(packing.pack(docs, window=64), 64).collect()
    assert sum(r["length"] for r in seq) == sum(p["length"] for p in pieces) and sum(r["length"] < 64 for r in seq) <= 1
    digest = packing.pack(docs, window=64, digest=True).collect()
    assert sorted(p["ids_crc32"] for p in digest) == sorted(zlib.crc32(bytes(p["ids"])) for p in pieces)


def test_query_packs_as_the_default_tokenizer(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from attestra.llm import queries

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e = "<|endoftext|>"
    texts = [e, f"a {e}", f"a  {e}  b", f"{e}{e}\n\n x", f"<|endof{e}text|> é", "<|endoftext| >", "plain  text \n", None, ""]
    docs = spark.createDataFrame([(i, x, "s", "e") for i, x in enumerate(texts)], DOCS)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    want = {i: (len(v), zlib.crc32(np.array(v, "<u4").tobytes())) for i, v in ids.items()}
    for pieces in (queries.op7_pack(spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, docs, "")):
        assert {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in pieces.collect()} == want


def test_mix(spark):
    rows = [(i, "w " * (i % 7), ["a", "b", None][min(i % 5, 2)], "") for i in range(400)] + [(5, None, "a", "")]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), block_words=16).collect()
    total = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        k = (r["source_size"], r["target"])
        total[k] = total.get(k, 0) + r["taken"]
    assert len(got) == 401 and all(abs(v - t) <= 1 for (_, t), v in total.items())
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_draw(spark):
    sources = ["a", "a", "b", "c", None]
    rows = [(i, " ".join(["w"] * (i * 7 % 23)) if i % 9 else None, sources[i % 5], "e") for i in range(120)]
    docs = spark.createDataFrame(rows, DOCS)
    taken = {r["doc_id"]: (r["taken"] / r["size"] if r["size"] else 0) for r in mixing.mix(docs, block_words=16).collect()}
    drawn = mixing.draw(docs, block_words=16)
    assert drawn.columns == docs.columns
    got = {r["doc_id"]: r["count"] for r in drawn.groupBy("doc_id").count().collect()}
    assert {i: n for i, n in ((i, int(t + 0.5)) for i, t in taken.items()) if n} == got
    assert mixing.draw(docs.limit(0)).count() == 0


def test_url_paths_agree(spark):
    urls = ["http://a.com/en/1", "https://x.EXAMPLE.com/en/7?q", None, "no", "http://b.net", "http://example.net/de/8/x", "http://acom/en/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block")], "host string, path string, verdict string")
    small = sorted(map(tuple, url_filter.judge(pages, rules).collect()))
    assert small == sorted(map(tuple, url_filter.judge(pages, rules, max_bytes=0).collect()))
    assert [r[4] for r in small] == ["block", "allow", "allow", "allow", "allow", "block", "allow"]


def test_warc_rejects_magic_in_payload(spark):
    trap = "x" * 50 + warc.MAGIC + "WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + warc.MAGIC + "y" * 80
    html = [None, "", "short", "short", "d" * 200, trap, "d" * 200, trap, "é" * 60]
    pages = spark.createDataFrame([(i, f"http://a/{i}\r\nx", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(html)
    for i, h in enumerate(html):
        raw = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest()) and got[i]["sound"] is not False
    assert {i: got[i]["refers_to"] for i in (6, 7)} == {6: 4, 7: 5} and got[3]["record_type"] == "response"


def test_segments_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 25)
        score = [rng.choice((-0.5, 1.0, 2.0)) if rng.random() < 0.5 else -0.5 for _ in range(n)]
        pos = [i for i, s in enumerate(score) if s > 0]
        best = max((sum(score[i:j]) for i in range(n) for j in range(i + 1, n + 1)), default=0)
        got = max((s for *_, s in toxicity.segments(pos, [score[i] for i in pos], 0.5)), default=0)
        assert got == (best if pos else 0)


def test_preference(spark):
    turns = spark.createDataFrame([(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 0, "user", "q"), (1, 1, "assistant", None), (7, 0, "user", "z")], "conv_id long, turn long, role string, text string")
    r = preference.format_pairs(turns, preference.neighbours(turns)).collect()
    assert len(r) == 1 and r[0]["prompt_turns"] == 1 and r[0]["prompt"] == "<|user|>\nq<|end|>\n"
    a, b = map(int, r[0]["chosen_mask"].split("-"))
    assert r[0]["chosen"][a:b] == "a<|end|>\n"
