"""Language-model scores from a probabilistic suffix tree over words.

A state is a context of up to ``depth`` words. The tree grows from the empty context. A context one word longer is looked
at if the state it extends is one, and also that without its last word, so that its own count is known, and is ``least``
or more; it is a state if some next word follows it ``least`` times or more and diverges from what the shorter state
foresees, by count * log(ratio) of at least the logarithm of all training tokens, so that chance makes few. Such next
words keep their own share of a state's mass; the rest of the mass follows the shorter state:

    P(x | s) = [c'(s, x) + (c(s) - C'(s) + prior) P(x | s without its first word)] / (c(s) + prior)

with c' the count of a diverging next word (0 for others) and C' the sum of them. A text's token is scored at the longest
suffix of its past that is a state. The empty context has add-0.5 frequencies.

Nothing of the model is held in one place: it grows with the corpus. Shards of words send (context, next word) pairs of
one depth in packed blocks, a bucket holds contexts whole, adds up counts and answers each block; a shard then knows the
probabilities of its own words and which contexts are worth another word. The next words of a context that occurs more
than ``spread`` times go to all buckets, whose sums for it are added up and handed to the shards (a number for each such
context, of which there are few); where its words are counted changes no result. A caller may ask that a context of more
than ``sure`` occurrences be a state without a test and keep the share ``trust`` of its mass; by default none is. Words and contexts are told apart by 64-bit hashes: two of n different ones clash with odds
of n^2 / 2^65; the next words of a context by 39 bits of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm import shards as S
from attestra.runtime import discard, materialise, small_batches

_SHARDS = "shard long, n_words long, n_learned long, vocabulary binary, words binary, doc_ids array<long>, lengths array<long>, learn array<boolean>"
_END = b" "  # no word is a space
_END_HASH = np.uint64(0x5851F42D4C957F2D)
_NEXT = np.uint64((1 << 40) - 1)
_NONE = np.uint64(0)  # stands for no next word
#: Occurrences beyond which a context's next words are counted in many buckets.
SPREAD = 4_000_000
_STEP = 1000.0  # log probabilities travel in thousandths


@dataclass(frozen=True)
class Shape:
    """depth: most words of a context. tokens, types: of training. buckets: of an exchange. shares: by depth, C' of spread contexts. The rest: see above."""

    depth: int
    buckets: int
    tokens: int = 0
    types: int = 0
    least: int = 2
    prior: float = 1.0
    sure: int | None = None
    trust: float = 0.9
    spread: int = SPREAD
    shares: dict[int, dict[int, int]] = field(default_factory=dict)

    @property
    def bar(self) -> float:
        return float(np.log(max(self.tokens, 2)))

    def base(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of the empty context."""
        return (counts + 0.5) / (self.tokens + 0.5 * (self.types + 1))


def _joined(words: pa.Array) -> bytes:
    """Words with single spaces between."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words.cast(pa.binary())), b" ")[0].as_py()


def _cut(shard_words: int):
    """Documents as rows of a shard: word numbers, each document's with the end token last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        end = pa.array([_END], pa.large_binary())
        parts, held, docs = [end], 0, []

        def close() -> pa.RecordBatch:
            nonlocal parts, held, docs, made
            made += 1
            coded = pa.concat_arrays(parts).dictionary_encode()  # in the order in which words come, the end first
            vocabulary = zstandard.ZstdCompressor(level=3).compress(_joined(coded.dictionary[1:]))  # smaller than hashes
            learned = sum(n for _, n, use in docs if use)
            words = coded.indices.to_numpy(zero_copy_only=False)[1:]
            row = [(task << 32) + made, held, learned, vocabulary, S.squeeze(words), *([d[k] for d in docs] for k in range(3))]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()))
            parts, held, docs = [end], 0, []
            names = [c.split()[0] for c in _SHARDS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        for b in batches:
            for doc_id, use, text in zip(b.column("doc_id").to_pylist(), b.column("use").to_pylist(), b.column("text"), strict=True):
                found = text.as_py().lower().split()  # of bytes: A-Z and ASCII spaces alone
                found.append(_END)
                parts.append(pa.array(found, pa.large_binary()))
                docs.append((doc_id, len(found), use))
                held += len(found)
                if held >= shard_words:
                    yield close()
        if docs:
            yield close()

    return run


class _Level:
    """The pairs of one depth in a shard: by context, then by next word, with the positions at which they stand."""

    def __init__(self, context: np.ndarray, word: np.ndarray, total: np.ndarray, learned: np.ndarray, log_p: np.ndarray, buckets: int, rank: np.ndarray | None, origin: np.ndarray, spread: int) -> None:
        """``origin``: the contexts; ``context`` stands for one with its next word where it is counted in many buckets. ``word``: number of the next word, from 1; 0 asks for the context alone, which a context with a next word doesn't need. ``rank``: of the contexts, if known."""
        order = S.ascending_pairs(context, word, rank)
        context, word = context[order], word[order]
        new = np.ones(len(order), bool)
        new[1:] = context[1:] != context[:-1]
        fresh = new.copy()
        fresh[1:] |= word[1:] != word[:-1]
        starts = np.flatnonzero(new)
        alone, group = word == 0, np.cumsum(new, dtype=np.int32)
        group -= 1
        if len(order):
            fresh[starts[alone[starts] & ~alone[np.append(starts[1:], len(order)) - 1]]] = False  # the first pair of a context, not its last
        place = np.cumsum(fresh, dtype=np.int32)
        place -= 1
        self.pair, self.group = np.empty(len(order), np.int32), np.empty(len(order), np.int32)
        self.pair[order], self.group[order] = place, group  # of each position given; a pair only where it has a word
        at = np.flatnonzero(fresh)
        first = order[at]
        self.context, self.word, self.total, self.log_p = context[at], word[at], total[first], log_p[first]
        self.origin, self.spread = origin[first], spread
        self.order, self.place, self.told, self.learned, self.buckets = order, place, ~alone, learned, buckets

    def blocks(self, hashes: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
        """Bucket and columns of each block, totals once a context; next words by ``hashes``."""
        told, cut = self.told, S.cut_points(self.context, self.buckets)
        count = np.bincount(self.place[told], weights=self.learned[self.order][told], minlength=len(self.context)).astype("<u4")
        nxt = np.where(self.word > 0, hashes[self.word.astype(np.int64) - 1] & _NEXT | np.uint64(1), _NONE)
        for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if j > i:
                context = self.context[i:j]
                heads = _heads(context)
                total = self.total[i:j][heads]
                apart = self.origin[i:j][heads][total > self.spread]
                yield b, [S.squeeze_sorted(context), S.squeeze(nxt[i:j]), S.squeeze(count[i:j]), S.squeeze(total), S.squeeze(self.log_p[i:j]), S.squeeze(apart) if len(apart) else b""]


def _heads(ascending: np.ndarray) -> np.ndarray:
    """Where equal numbers begin."""
    return np.flatnonzero(np.append(True, ascending[1:] != ascending[:-1]))


def _thousandths(p: np.ndarray) -> np.ndarray:
    """-log p in thousandths, never above the true value, so that a large count can't pass a test by rounding."""
    return np.clip(np.floor(-np.log(p) * _STEP), 0, 65535).astype("<u2")


class _Walk:
    """A shard's tokens, scored as deep as there are replies."""

    def __init__(self, row: dict, shape: Shape) -> None:
        self.shape = shape
        self.words = S.expand(row["words"], "<i4")
        self.hashes = np.append(_END_HASH, S.word_hashes(zstandard.ZstdDecompressor().decompress(row["vocabulary"])))
        self.lengths = np.array(row["lengths"], np.int64)
        starts = np.cumsum(self.lengths) - self.lengths
        self.past = (np.arange(len(self.words)) - np.repeat(starts, self.lengths)).astype(np.int32)  # words before a token in its text
        self.learned = np.repeat(np.array(row["learn"], bool), self.lengths)

    def word_blocks(self) -> Iterator[tuple[int, list[bytes]]]:
        """Bucket and columns of each block of words, by their hashes."""
        order = S.ascending(self.hashes)
        key = self.hashes[order]
        count = np.bincount(self.words, weights=self.learned, minlength=len(order)).astype("<u4")[order]
        cut = S.cut_points(key, self.shape.buckets)
        for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if j > i:
                yield b, [S.squeeze_sorted(key[i:j]), b"", S.squeeze(count[i:j]), b"", b"", b""]

    def begin(self, replies: list[bytes]) -> None:
        """Take the replies for the words."""
        self.word_count = np.empty(len(self.hashes), np.int64)
        self.word_count[S.ascending(self.hashes)] = np.concatenate([S.expand(r, "<i8") for r in replies])
        self.seen = self.word_count[self.words]  # of a token after the longest context that was looked at
        self.p = self.shape.base(self.word_count)[self.words]
        self.alive = np.flatnonzero(self.past > 0)
        self.state = np.zeros(len(self.alive), np.uint64)  # contexts of the tokens alive

    def level(self, k: int) -> _Level:
        """Pairs of depth k at the tokens whose context of k - 1 words is a state."""
        shape = self.shape
        total = self.seen[self.alive - 1]  # the longer context's own count
        fit = (self.past[self.alive] >= k) & (total >= shape.least)
        at, total = self.alive[fit], total[fit]
        rank = None
        if k == 1:  # a context is a word: few hashes are made and ranked
            of_word = S.chain(np.zeros(len(self.hashes), np.uint64), self.hashes ^ np.uint64(k))
            context, rank = of_word[self.words[at - 1]], S.ranks(of_word)[self.words[at - 1]]
        else:
            context = S.chain(self.state[fit], self.hashes[self.words[at - k]] ^ np.uint64(k))
        most, log_p = np.minimum(self.seen[at], total), _thousandths(self.p[at])
        told = most >= shape.least
        sure = total > shape.sure if shape.sure is not None else np.zeros(len(at), bool)
        apart = sure | (total > shape.spread)
        if k == shape.depth:  # no deeper context needs the counts of pairs that can't diverge
            told &= sure | _diverge(most, total, log_p, shape)
        word = np.where(told, self.words[at] + 1, 0).astype(np.uint64)
        self.at, self.total, self.state, self.sure, self.apart, self.told, key = at, total, context, sure, apart, told, context
        self.asked = np.arange(len(at))
        if apart.any():  # their next words go to all buckets; without one there is nothing to ask
            key, rank = np.where(apart, S.chain(context, self.hashes[self.words[at]]), context), None
            self.asked = np.flatnonzero(told | ~apart)
            key, word, total, at, log_p, context = (x[self.asked] for x in (key, word, total, at, log_p, context))
        return _Level(key, word, total.astype("<u8"), self.learned[at], log_p, shape.buckets, rank, context, shape.spread)

    def learn(self, k: int, replies: list[bytes]) -> None:
        """Take the replies for depth k: probabilities, and the tokens whose context is a state."""
        level, shape = self.level(k), self.shape
        got = [_unpack(r) for r in replies]
        count, kept = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in range(2))
        shown = _diverge(count, level.total.astype(np.int64), level.log_p, shape) & (level.word > 0)
        at, told = self.at, self.told[self.asked]
        c, held, share = (np.zeros(len(at), np.int64) for _ in range(3))
        share[self.asked] = kept[level.group]
        share[self.apart] = _looked_up(shape.shares.get(k, {}), self.state[self.apart])
        own, asked = level.pair[told], self.asked[told]
        c[asked], held[asked] = count[own], np.where(shown, count, 0)[own]
        p, s = self.p[at], self.total
        q = np.where(share > 0, (held + (s - share + shape.prior) * p) / (s + shape.prior), p)
        self.p[at] = np.where(self.sure, shape.trust * c / s + (1 - shape.trust) * p, q)
        state = self.sure | (share > 0)
        self.alive, self.state = at[state], self.state[state]
        self.seen = np.zeros(len(self.words), np.int64)
        self.seen[at] = c


def _looked_up(shares: dict[int, int], contexts: np.ndarray) -> np.ndarray:
    """The share of each context, 0 without one."""
    if not shares:
        return np.zeros(len(contexts), np.int64)
    known = np.array(sorted(shares), np.int64)
    value, contexts = np.array([shares[c] for c in known.tolist()], np.int64), contexts.view(np.int64)
    at = np.minimum(np.searchsorted(known, contexts), len(known) - 1)
    return np.where(known[at] == contexts, value[at], 0)


def _diverge(count: np.ndarray, total: np.ndarray, log_p: np.ndarray, shape: Shape) -> np.ndarray:
    """Whether a next word follows a context so much oftener than the shorter one foresees that chance hardly does it."""
    gain = count * (np.log(np.maximum(count, 1) / np.maximum(total, 1)) + log_p / _STEP)
    return (count >= shape.least) & (gain >= shape.bar)


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [S.squeeze(a.astype("<i8")) for a in arrays]
    head = np.array([len(p) for p in parts], "<i8").tobytes()
    return head + b"".join(parts)


def _unpack(data: bytes) -> list[np.ndarray]:
    sizes, out, at = np.frombuffer(data[:16], "<i8"), [], 16
    for n in sizes:
        out.append(S.expand(data[at : at + n], "<i8"))
        at += int(n)
    return out


_REQUEST = "bucket int, shard long, context binary, next binary, count binary, total binary, log_p binary, apart binary"


def _advance(row: dict, shape: Shape, k: int) -> _Walk:
    """The walk with all replies of depths below k."""
    walk = _Walk(row, shape)
    if k > 0:
        walk.begin(row["r0"] or [])
    for i in range(1, k):
        walk.learn(i, row[f"r{i}"] or [])
    return walk


def _send(shape: Shape, k: int):
    names = [c.split()[0] for c in _REQUEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in S.one_by_one(batches):
            walk = _advance(row, shape, k)
            for b, parts in walk.word_blocks() if k == 0 else walk.level(k).blocks(walk.hashes):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([row["shard"]], pa.int64()), *(pa.array([x], pa.binary()) for x in parts)], names)

    return run


def _count_words(group: pa.Table) -> tuple[list[bytes], int, dict[int, int]]:
    keys = [S.expand_sorted(x.as_py()) for x in group["context"]]
    counts = np.concatenate([S.expand(x.as_py(), "<u4").astype(np.int64) for x in group["count"]])
    total, place = S.sums(np.concatenate(keys), counts)
    ends = np.cumsum([len(k) for k in keys])[:-1]
    return [S.squeeze(x) for x in np.split(total[place], ends)], int((total > 0).sum()), {}


def _count_pairs(shape: Shape):
    def merge(group: pa.Table) -> tuple[list[bytes], int, dict[int, int]]:
        contexts = [S.expand_sorted(x.as_py()) for x in group["context"]]
        ends = np.cumsum([len(c) for c in contexts])[:-1]
        context = np.concatenate(contexts)
        nxt = np.concatenate([S.expand(x.as_py(), "<u8") for x in group["next"]])
        count = np.concatenate([S.expand(x.as_py(), "<u4").astype(np.int64) for x in group["count"]])
        log_p = np.concatenate([S.expand(x.as_py(), "<u2") for x in group["log_p"]])
        totals = [S.expand(x.as_py(), "<u8").astype(np.int64) for x in group["total"]]
        total = np.concatenate([np.repeat(t, np.diff(np.append(_heads(c), len(c)))) for t, c in zip(totals, contexts, strict=True)])
        order = S.ascending_pairs(context, S.ranks(nxt, 40))
        context, nxt = context[order], nxt[order]
        new_context = np.ones(len(order), bool)
        new_context[1:] = context[1:] != context[:-1]
        new_pair = new_context.copy()
        new_pair[1:] |= nxt[1:] != nxt[:-1]
        pairs, group_of = np.flatnonzero(new_pair), np.cumsum(new_context) - 1
        c, first = np.add.reduceat(count[order], pairs), order[pairs]
        shown = _diverge(c, total[first], log_p[first], shape) & (nxt[pairs] != _NONE)
        share = np.bincount(group_of[pairs], weights=np.where(shown, c, 0)).astype(np.int64)
        pair_at, group_at = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        pair_at[order], group_at[order] = np.cumsum(new_pair) - 1, group_of
        out = [_pack(c[pair], share[at[_heads(own)]]) for own, pair, at in zip(contexts, np.split(pair_at, ends), np.split(group_at, ends), strict=True)]
        sums: dict[int, int] = {}
        spread = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for own, at, t, x in zip(contexts, np.split(group_at, ends), totals, group["apart"], strict=True):
            if x.as_py():
                spread.append((at[_heads(own)][t > shape.spread], S.expand(x.as_py(), "<u8")))
        groups, first = np.unique(np.concatenate([g for g, _ in spread]), return_index=True)  # a pair may come from many shards
        for c, n in zip(np.concatenate([c for _, c in spread])[first].view(np.int64).tolist(), share[groups].tolist(), strict=True):
            sums[c] = sums.get(c, 0) + n
        return out, int((share > 0).sum()), sums

    return merge


def _answer(requests: DataFrame, merge) -> DataFrame:
    """Replies as ``shards.answer`` gives them, with a bucket's sums for spread contexts in its first one."""

    def run(group: pa.Table) -> pa.Table:
        replies, found, sums = merge(group)
        rest = len(replies) - 1
        lists = [pa.array([list(x)] + [None] * rest, pa.list_(pa.int64())) for x in (sums.keys(), sums.values())]
        return pa.table({"shard": group["shard"], "bucket": group["bucket"], "reply": pa.array(replies, pa.binary()), "found": pa.array([found] + [0] * rest, pa.int64()), "context": lists[0], "share": lists[1]})

    return requests.groupBy("bucket").applyInArrow(run, f"{S.REPLY}, context array<long>, share array<long>")


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(shape: Shape):
    names = [c.split()[0] for c in _SCORES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in S.one_by_one(batches):
            walk = _advance(row, shape, shape.depth + 1)
            first = np.cumsum(walk.lengths) - walk.lengths  # no text is without tokens
            base, known = np.log10(shape.base(walk.word_count)), walk.word_count > 0
            add = lambda a: np.add.reduceat(a, first)
            columns = [pa.array(row["doc_ids"], pa.int64()), pa.array([not x for x in row["learn"]], pa.bool_()), pa.array(walk.lengths, pa.int64()), pa.array(add(known[walk.words].astype(np.int64)), pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(add(base[walk.words])), pa.array(add(np.log10(walk.p)))], names)

    return run


def score(docs: DataFrame, learn: Column, depth: int = 3, least: int = 2, prior: float = 1.0, sure: int | None = None, trust: float = 0.9, id_col: str = "doc_id", text_col: str = "text", shard_words: int = S.SHARD_WORDS, spread: int = SPREAD) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of probabilities).

    The tree learns from the documents for which ``learn`` holds (a null counts as no), and all documents are scored. A
    null or empty text is its end token. Repeated rows are scored each and count each; a null id stays null; without
    any training document each token has the probability of an unknown one, one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("use"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    with small_batches(spark, 500):
        parts, path = materialise(rows.mapInArrow(_cut(shard_words), _SHARDS), "shards", "zstd")
    sizes = parts.agg(F.sum("n_words").alias("all"), F.sum("n_learned").alias("learned")).first()
    tokens = sizes["learned"] or 0
    shape = Shape(depth, S.buckets_for(sizes["all"] or 0), tokens, 0, least, prior, sure, trust, spread)
    replies: dict[str, DataFrame] = {}
    paths = [path]
    with small_batches(spark, 2):
        for k in range(depth + 1):
            request = S.with_replies(parts, replies).mapInArrow(_send(shape, k), _REQUEST)
            replies[f"r{k}"], path = materialise(_answer(request, _count_words if k == 0 else _count_pairs(shape)), f"depth-{k}")
            paths.append(path)
            if k == 0:
                types = replies["r0"].agg(F.sum("found")).first()[0] or 0
                shape = replace(shape, types=types)
            else:
                sums = replies[f"r{k}"].where("size(context) > 0").select(F.explode(F.arrays_zip("context", "share")).alias("z")).groupBy("z.context").agg(F.sum("z.share"))
                shape = replace(shape, shares=shape.shares | {k: dict(map(tuple, sums.collect()))})  # at most tokens / spread contexts
        out = S.with_replies(parts, replies).mapInArrow(_score(shape), _SCORES)
        out, _ = materialise(out.withColumn("train_tokens", F.lit(tokens).cast("long")), "scores")
    for path in paths:
        discard(spark, path)
    return out
