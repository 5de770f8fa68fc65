"""N-gram Jaccard join as a blocked sparse product of the document by shingle incidence matrix.

The full product is never formed. A document's shingles are put in one global order (shingles of many documents last)
and only the columns that the size bounds leave are multiplied: of a document with n shingles the first
``n - ceil(t n) + 1``, since a pair that shares none of them can't reach the threshold. A pair that first meets at
places i and j overlaps in at most ``min(n1 - i, n2 - j)`` shingles; pairs for which that is below the overlap that
their sizes ask for are discarded before any set is read.

Only connectivity is wanted, so the product runs in two passes. First every document meets the members of its columns
that stand earliest in them; found links join components. Then the columns that still hold more than one component are
multiplied. Short columns are dealt to blocks; a block's task multiplies its rows by themselves and accumulates the
overlap counts of pairs, blocks' counts are added up, pairs whose count and bounds can't reach the threshold are
discarded and the rest are counted on their whole sets. A long column is cut into blocks of documents, whose products
over whole sets stay in the task; only links that join components leave it. No pair of different sets that reaches the
threshold is lost.

Shingles are 64-bit hashes, told apart within a document by their words, so a set's size is exact. Documents with one
set are one class by a 128-bit digest. Two different shingles of a corpus with s distinct ones share a hash with odds of
s^2 / 2^65; such a clash changes a link only where it lies in a compared pair that misses the threshold by one shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.operators.graph import connected_components
from attestra.runtime import discard, materialise, small_batches

#: Shingles that are put last; the most frequent of those in at least MIN_HEAVY documents. Bounds the broadcast (1.6 MB).
MAX_HEAVY = 200_000
MIN_HEAVY = 32
#: Columns up to so many documents are multiplied as pairs of rows, longer ones in blocks of BLOCK documents.
SHORT = 128
BLOCK = 768
#: Ids that may be broadcast (8 MB) to pick the sets to verify; beyond it the sets are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows of short columns that one task multiplies, and shingles that a block of documents holds, on average.
PRODUCT_ROWS = 20_000
BLOCK_SHINGLES = 1_000_000
#: Documents of an Arrow batch that goes to Python, and postings of one that comes back: the executor's JVM holds both
#: outside its heap, several at once, and keeps the memory.
BATCH_DOCUMENTS = 200
BATCH_POSTINGS = 32_768


def _mix(w: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` words, from the hashes of the words."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(w) - width + 1, np.uint64)
        for i in range(width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - width + 1 + i]
        h += np.uint64(width)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def shingle_ids(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text: A-Z lower-cased, words split at ASCII space.

    Fewer words than ``width`` make one shingle of all words; no word or no text makes none. Equal hashes of one text
    are compared word by word; should two shingles clash, the later ones are hashed anew from their words.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    k = min(width, len(words))
    h = _mix(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), k).view(np.int64)
    ids = np.unique(h)
    if len(ids) < len(h):
        order = np.argsort(h, kind="stable")
        same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
        if any(words[i : i + k] != words[j : j + k] for i, j in zip(order[same].tolist(), order[same + 1].tolist(), strict=True)):
            return _told_apart(words, h, k)
    return ids


def _told_apart(words: list[bytes], h: np.ndarray, k: int) -> np.ndarray:
    """One hash for each distinct shingle of a text in which two share one."""
    taken: dict[int, bytes] = {}
    for i in range(len(h)):
        shingle, value, seed = b" ".join(words[i : i + k]), int(h[i]), 1
        while taken.setdefault(value, shingle) != shingle:
            value, seed = int(np.uint64(xxhash.xxh64_intdigest(shingle, seed)).astype(np.int64)), seed + 1
    return np.array(sorted(taken), np.int64)


def unpack_ids(packed) -> np.ndarray:
    return np.frombuffer(packed, "<i8")


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key, check, packed = [], [], [], []
            for text in b.column("text"):
                ids = shingle_ids(text.as_py(), width)
                n.append(len(ids))
                packed.append(ids.astype("<i8").tobytes() if len(ids) else None)
                both = np.frombuffer(xxhash.xxh3_128_digest(packed[-1]), "<i8").tolist() if len(ids) else (None, None)
                key.append(both[0])
                check.append(both[1])
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(check, pa.int64()), pa.array(packed, pa.binary())],
                ["id", "n", "key", "check", "ids"],
            )

    return run


def _prefix(n, percent: int):
    """Columns of a set of n shingles that the size bound leaves."""
    return n - (percent * n + 99) // 100 + 1


def _by_column(rows: DataFrame, **aggregates: Column) -> DataFrame:
    """Rows with aggregates of their column. Hot columns, at most MAX_HEAVY, are added up by partial sums that are
    broadcast back, so that no task holds one whole; the others go through a window."""
    light, hot = rows.where(~F.col("hot")), rows.where("hot")
    over = Window.partitionBy("shingle")
    sums = hot.groupBy("shingle").agg(*[a.alias(k) for k, a in aggregates.items()])
    light = light.withColumns({k: a.over(over) for k, a in aggregates.items()})
    return light.unionByName(hot.join(F.broadcast(sums), "shingle").select(light.columns))


def _postings(percent: int, heavy, light_only: bool):
    """Rows (shingle, key, n, pos, hot) of the columns that the size bounds leave; a task emits a set once as far as it can tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = heavy.value if heavy is not None else np.empty(0, np.int64)
        seen: set[int] = set()
        for b in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for key, n, packed in zip(b.column("key").to_pylist(), b.column("n").to_pylist(), b.column("ids"), strict=True):
                if key in seen:
                    continue
                if len(seen) < 100_000:
                    seen.add(key)
                ids = unpack_ids(packed.as_buffer())
                p = n - -(-2 * percent * n // (100 + percent)) + 1 if light_only else _prefix(n, percent)
                hot = np.zeros(len(ids), bool)
                if len(last):
                    at = np.searchsorted(last, ids)
                    hot = last[np.minimum(at, len(last) - 1)] == ids
                    ids = np.concatenate([ids[~hot], ids[hot]])
                    hot = np.sort(hot)
                ids, hot = ids[:p], hot[:p]
                out.append((ids, np.full(len(ids), key), np.full(len(ids), n, np.int32), np.arange(len(ids), dtype=np.int32), hot))
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                names = ["shingle", "key", "n", "pos", "hot"][: 1 if light_only else 5]
                for at in range(0, len(columns[0]), BATCH_POSTINGS):
                    part = [pa.array(c[at : at + BATCH_POSTINGS]) for c in columns[: len(names)]]
                    yield pa.RecordBatch.from_arrays(part, names)

    return run


def linked(overlap, n1, n2, percent: int):
    """Whether 100 * overlap >= percent * union; works on numbers, arrays and columns."""
    return 100 * overlap >= percent * (n1 + n2 - overlap)


def _verify(percent: int):
    """Whole-set overlaps of a batch of pairs: the entries of the product that are asked for, counted in one sort."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [[unpack_ids(v) for v in b[c]] for c in ("ids1", "ids2")]
            n1, n2 = (np.array([len(v) for v in side], np.int64) for side in sets)
            if not len(b):
                continue
            ids = np.concatenate([*sets[0], *sets[1]])
            pair = np.concatenate([np.repeat(np.arange(len(b)), n1), np.repeat(np.arange(len(b)), n2)])
            order = np.lexsort((ids, pair))
            ids, pair = ids[order], pair[order]
            twice = (ids[1:] == ids[:-1]) & (pair[1:] == pair[:-1])
            overlap = np.bincount(pair[1:][twice], minlength=len(b))
            yield b.loc[linked(overlap, n1, n2, percent), ["src", "dst"]]

    return run


def _partial_product(percent: int):
    """Overlap counts of the pairs that meet in a block of columns, without those that sizes or components exclude."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["shingle", "key"])
        column, key, n, pos, comp, crowd = (pdf[c].to_numpy(np.int64) for c in ("shingle", "key", "n", "pos", "comp", "crowd"))
        src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for step in range(1, len(pdf)):  # rows so far apart in one column; columns are short
            near = np.flatnonzero(column[step:] == column[:-step])
            if not len(near):
                break
            far = near + step
            ok = (comp[near] != comp[far]) & (100 * np.minimum(n[near], n[far]) >= percent * np.maximum(n[near], n[far]))
            src.append(near[ok])
            dst.append(far[ok])
        i, j = np.concatenate(src), np.concatenate(dst)
        reach = linked(np.minimum(n[i] - pos[i], n[j] - pos[j]), n[i], n[j], percent)
        spare = np.minimum(crowd[i], crowd[j]) + np.maximum(n[i] - _prefix(n[i], percent), n[j] - _prefix(n[j], percent))
        pairs = pd.DataFrame({"src": key[i], "dst": key[j], "n1": n[i], "n2": n[j], "spare": spare, "reach": reach})
        return pairs.groupby(["src", "dst", "n1", "n2", "spare"], sort=False, as_index=False).agg(met=("reach", "size"), reach=("reach", "max")).astype({"met": "int64", "reach": "bool"})

    return run


def overlaps(rows: list[np.ndarray], cols: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Overlap counts of two blocks of sets: the product of their incidence matrices over the shingles that both hold.

    ``width`` columns at a time are dense, and sets are looked up one by one as sorted places, so that little is held
    beside the sets themselves.
    """
    shared = np.intersect1d(np.unique(np.concatenate(rows)), np.unique(np.concatenate(cols)), assume_unique=True)
    if not len(shared):
        return np.zeros((len(rows), len(cols)), np.int64)
    sides = []
    for sets in (rows, cols):
        held = []
        for ids in sets:
            at = np.minimum(np.searchsorted(shared, ids), len(shared) - 1)
            held.append(at[shared[at] == ids].astype(np.int32))
        sides.append(held)
    out = np.zeros((len(rows), len(cols)), np.float32)
    for c in range(0, len(shared), width):
        dense = []
        for held in sides:
            m = np.zeros((len(held), min(width, len(shared) - c)), np.float32)
            for k, at in enumerate(held):
                lo, hi = np.searchsorted(at, (c, c + width))
                m[k, at[lo:hi] - c] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return np.rint(out).astype(np.int64)


def _bests(pdf: pd.DataFrame) -> pd.DataFrame:
    """For every asked size of a column, the farthest end among the sizes up to it, and the farthest of any other component."""
    pdf = pdf.sort_values(["at", "asked"], kind="stable")
    best, whose, second, out = -1, None, -1, []
    for at, asked, end, comp in zip(*(pdf[c].tolist() for c in ("at", "asked", "end", "comp")), strict=True):
        if asked:
            if whose is not None:
                out.append((at, best, whose, second))
        elif comp == whose:
            best = max(best, end)
        elif end > best:
            best, whose, second = end, comp, best
        else:
            second = max(second, end)
    out = pd.DataFrame(out, columns=["limit", "best", "whose", "second"]).astype("int64")
    return out.assign(shingle=int(pdf["shingle"].iloc[0]))[["shingle", "limit", "best", "whose", "second"]]


def _may_link(wide: DataFrame, percent: int) -> DataFrame:
    """Rows of columns that the bounds let link with some row of their column of another component.

    Sizes n1, n2 and what is left behind the places, r1, r2, let a pair link if ``p (n1 + n2) <= (100 + p) min(r1, r2)``:
    each row has a largest size it may meet, ``((100 + p) r - p n) // p``, and two rows may link if neither is larger than
    the other allows. So a row asks for the farthest such end among the sizes up to its own end. What a column sends to
    be swept is two rows a size and one a different end, however many documents hold it; no pair of rows is formed.
    """
    r = F.col("n").cast("long") - F.col("pos")
    end = F.floor(((100 + percent) * r - percent * F.col("n").cast("long")) / F.lit(percent))
    rows = wide.withColumn("limit", end.cast("long")).where("limit > 0")
    top = rows.groupBy("shingle", "n", "comp").agg(F.max("limit").alias("end"))
    order = Window.partitionBy("shingle", "n").orderBy(F.desc("end"), "comp")
    top = top.withColumn("k", F.row_number().over(order)).where("k <= 2")
    none = F.lit(-1).cast("long")
    swept = top.select("shingle", F.col("n").cast("long").alias("at"), F.lit(False).alias("asked"), "end", "comp")
    asked = rows.select("shingle", F.col("limit").alias("at"), F.lit(True).alias("asked"), none.alias("end"), none.alias("comp")).distinct()
    bests = swept.unionByName(asked).groupBy("shingle").applyInPandas(_bests, "shingle long, limit long, best long, whose long, second long")
    other = F.when(F.col("comp") == F.col("whose"), F.col("second")).otherwise(F.col("best"))
    return rows.join(bests, ["shingle", "limit"]).where(other >= F.col("n")).select("shingle", "key", "n", "comp")


def _in_blocks(members: DataFrame, size: int, shingles: int) -> DataFrame:
    """Rows of columns dealt to pairs of blocks (shingle, i, j) with about ``size`` rows and ``shingles`` shingles a side."""
    blocks = F.ceil(F.greatest(F.count("*") / size, F.sum("n") / shingles)).cast("int")
    b = members.join(members.groupBy("shingle").agg(blocks.alias("blocks")), "shingle")
    b = b.withColumn("at", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    b = b.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both, one, two = F.array(F.lit(0), F.lit(1)), F.array(F.lit(0)), F.array(F.lit(1))
    b = b.withColumn("side", F.explode(F.when(F.col("at") == F.col("other"), both).when(F.col("at") < F.col("other"), one).otherwise(two)))
    return b.withColumns({"i": F.least("at", "other"), "j": F.greatest("at", "other")}).drop("blocks", "at", "other")


def _block_links(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(first) or not len(second):
            return pd.DataFrame({"src": [], "dst": []}, dtype="int64")
        x, y = [unpack_ids(v) for v in first["ids"]], [unpack_ids(v) for v in second["ids"]]
        n1, n2 = np.array([len(v) for v in x])[:, None], np.array([len(v) for v in y])[None, :]
        hit = linked(overlaps(x, y), n1, n2, percent) & (first["comp"].to_numpy()[:, None] != second["comp"].to_numpy()[None, :])
        boss: dict[int, int] = {}

        def top(v: int) -> int:
            while boss.get(v, v) != v:
                v = boss[v]
            return v

        out = []
        for i, j in zip(*np.nonzero(hit), strict=True):
            u, v = top(int(first["comp"].iloc[i])), top(int(second["comp"].iloc[j]))
            if u != v:
                boss[max(u, v)] = min(u, v)
                out.append((first["key"].iloc[i], second["key"].iloc[j]))
        return pd.DataFrame(out, columns=["src", "dst"]).astype("int64")

    return run


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (src, dst) with the packed sets of both; ``sets`` holds one row a class."""
    one = sets.select(F.col("key").alias("src"), F.col("ids").alias("ids1"))
    two = sets.select(F.col("key").alias("dst"), F.col("ids").alias("ids2"))
    return pairs.join(one, "src").join(two, "dst")


def _sets_of(sets: DataFrame, reps: DataFrame, keys: DataFrame, write: Callable[..., DataFrame]) -> DataFrame:
    """One row (key, ids) for each wanted class: its smallest document's."""
    wanted = write(reps.join(keys.distinct(), "key").select("rep", "key"), "wanted")
    small = wanted.count() <= BROADCAST_IDS
    want = wanted.select(F.col("rep").alias("id"), F.col("key").alias("want"))
    picked = sets.join(F.broadcast(want) if small else want, "id").where("key = want").select("key", "ids")
    repeated = sets.groupBy("id").count().where("count > 1").head(1)
    return picked.dropDuplicates(["key"]) if repeated else picked


def _overlap_may_reach(a: str, b: str, percent: int):
    """The size and place bounds of a pair that meets in a column, on columns n and pos of both sides."""
    n1, n2, p1, p2 = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (a, b))
    return linked(F.least(n1 - p1, n2 - p2), n1, n2, percent)


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """One row a document: ``id``, ``n_shingles``, ``component_id`` (smallest id that links reach, itself included).

    Documents link when ``100 * intersection >= percent * union`` of their distinct word shingles, over whole texts.
    Null or wordless texts have no shingle and link with nothing. Equal sets link whatever the ids; a repeated id is
    one document a row, all in one component if their sets link, and rows without an id stay alone with a null
    component. Other columns are not read. An empty table gives no rows.
    """
    with small_batches(docs.sparkSession, BATCH_DOCUMENTS):
        return _components(docs, id_col, text_col, width, percent)


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """All work is done before this returns; what it returns is one written table, the tables on the way are deleted."""
    spark = docs.sparkSession
    scratch: dict[str, str] = {}

    def write(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
        out, path = materialise(df, label, codec)
        scratch[path] = label
        return out

    def drop(*labels: str) -> None:
        for path in [p for p, label in scratch.items() if not labels or label in labels]:
            discard(spark, path)
            del scratch[path]

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n long, key long, check long, ids binary"
    sets = write(src.mapInArrow(_sets(width), schema), "sets", "none")
    known = sets.where("key is not null and id is not null")
    reps = write(known.groupBy("key").agg(F.min("id").alias("rep"), F.min("check").alias("lo"), F.max("check").alias("hi")), "reps")
    if reps.where("lo <> hi").head(1):  # two digests share 64 bits: the whole digest is hashed anew
        sets = write(sets.withColumn("key", F.when(F.col("key").isNotNull(), F.xxhash64("key", "check", F.lit(1)))), "sets", "none")
        known = sets.where("key is not null and id is not null")
        reps = write(known.groupBy("key").agg(F.min("id").alias("rep")), "reps")
    reps = reps.select("key", "rep")

    counted = known.select("key", "n", "ids").mapInArrow(_postings(percent, None, True), "shingle long")
    top = counted.groupBy("shingle").count().where(F.col("count") >= MIN_HEAVY)
    top = top.orderBy(F.desc("count"), "shingle").limit(MAX_HEAVY).select("shingle").toPandas()["shingle"]
    heavy = spark.sparkContext.broadcast(np.sort(top.to_numpy(dtype=np.int64)))

    posted = known.select("key", "n", "ids").mapInArrow(
        _postings(percent, heavy, False), "shingle long, key long, n int, pos int, hot boolean"
    )
    # columns of one document go; a hot column is spread, as it holds many
    apart = Window.partitionBy("shingle", F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(1024))).otherwise(0))
    posted = (
        posted.withColumns({"lo": F.min("key").over(apart), "hi": F.max("key").over(apart)})
        .where("hot or lo < hi")
        .dropDuplicates(["shingle", "key"])
        .select("shingle", "key", "n", "pos", "hot")
    )
    columns = write(posted, "columns")

    met = _by_column(columns, b=F.min(F.struct("pos", "key", "n"))).select("key", F.struct("n", "pos").alias("a"), "b")
    met = met.where(F.col("key") != F.col("b.key")).where(_overlap_may_reach("a", "b", percent))
    met = met.groupBy("key").agg(
        F.slice(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("a.pos", "b.key"))), lambda x: x["key"])), 1, 3).alias("hubs")
    )
    met = met.select("key", F.explode("hubs").alias("hub"))
    tested = write(met.select(F.least("key", "hub").alias("src"), F.greatest("key", "hub").alias("dst")).distinct(), "tested")
    ends = tested.select(F.col("src").alias("key")).unionByName(tested.select(F.col("dst").alias("key")))
    picked = write(_sets_of(known, reps, ends, write), "picked", "none")
    links = _with_sets(tested, picked).mapInPandas(_verify(percent), "src long, dst long")
    links = write(links, "links")
    drop("picked", "wanted")
    found = connected_components(links)

    joined = columns.join(found.withColumnRenamed("id", "key"), "key", "left")
    joined = write(joined.select("shingle", "key", "n", "pos", "hot", F.coalesce("component", "key").alias("comp")), "joined")
    drop("columns")
    left = _by_column(joined, lo=F.min("comp"), hi=F.max("comp"), long=F.count("*")).where("lo < hi")
    left = write(left.select("shingle", "key", "n", "pos", "comp", "long"), "left")
    drop("joined")
    # every shared shingle of two prefixes is in a column that holds both: what short columns show, what long ones could
    # add and what lies behind the prefix that ends first, of whichever of the two, bounds the whole overlap
    crowd = left.groupBy("key").agg(F.count_if(F.col("long") > SHORT).alias("crowd"))
    short = left.where(F.col("long") <= SHORT).join(crowd, "key")
    blocks = max(1, -(-left.where(F.col("long") <= SHORT).count() // PRODUCT_ROWS))
    short = short.select("shingle", "key", "n", "pos", "comp", "crowd", F.pmod(F.xxhash64("shingle"), F.lit(blocks)).alias("block"))
    partial = short.groupBy("block").applyInPandas(_partial_product(percent), "src long, dst long, n1 long, n2 long, spare long, met long, reach boolean")
    pairs = partial.groupBy("src", "dst", "n1", "n2", "spare").agg(F.sum("met").alias("met"), F.max("reach").alias("reach"))
    pairs = pairs.where(F.col("reach") & linked(F.col("met") + F.col("spare"), F.col("n1"), F.col("n2"), percent))
    pairs = pairs.select("src", "dst").join(tested, ["src", "dst"], "left_anti")
    pairs = write(pairs, "pairs")
    more = []
    if pairs.head(1):
        ends = pairs.select(F.col("src").alias("key")).unionByName(pairs.select(F.col("dst").alias("key")))
        more.append(_with_sets(pairs, _sets_of(known, reps, ends, write)).mapInPandas(_verify(percent), "src long, dst long"))
    wide = left.where(F.col("long") > SHORT).select("shingle", "key", "n", "pos", "comp")
    wide = write(_may_link(wide, percent), "wide")
    if wide.head(1):
        blocks = _in_blocks(wide, BLOCK, BLOCK_SHINGLES).join(_sets_of(known, reps, wide.select("key"), write), "key")
        more.append(blocks.groupBy("shingle", "i", "j").applyInPandas(_block_links(percent), "src long, dst long"))
    if more:
        written = [write(m, "extra") for m in more]
        extra = written[0] if len(written) == 1 else written[0].unionByName(written[1])
        if extra.head(1):
            found = connected_components(links.unionByName(extra))

    linked_reps = found.withColumnRenamed("id", "key").join(reps, "key")
    smallest = linked_reps.groupBy("component").agg(F.min("rep").alias("component_id"))
    comps = linked_reps.join(smallest, "component").select("key", "component_id")
    out = sets.select("id", "n", "key").join(reps, "key", "left").join(comps, "key", "left")
    own = F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component_id", "rep", "id"))
    done, _ = materialise(out.select("id", F.col("n").alias("n_shingles"), own.alias("component_id")), "components")
    drop()
    return done
