"""Notes without managed lines, and proofs that rest on them, against plain versions."""

import random
import re

from pyspark.sql import functions as F

from attestra.operators import projection as J


def plain_form(text, marker):
    """The same rule, told section by section."""
    if text.startswith("---\n") and "\n---\n" in text[4:]:
        at = text.index("\n---\n")
        text = "\n".join(x for x in text[:at].splitlines() if not x.startswith(("asset_class:", "graph_group:"))) + text[at:]
    heads = [m for m in re.finditer(r"^##\s+.+$", text, re.M)]
    out = text[: heads[0].start()] if heads else text
    for m, stop in zip(heads, [h.start() for h in heads[1:]] + [len(text)], strict=False):
        part = text[m.start() : stop]
        if marker not in part:
            out += part
            continue
        rest = "\n".join(x for x in part.splitlines() if marker not in x).strip()
        out = out.rstrip() + ("" if rest == m.group(0) else ("\n\n" if out.strip() else "") + rest + "\n\n")
    return out.strip()


PARTS = ["## Links", "##  A b", "### low", "##", "text", "line with rel-1 in it", "- rel-1", "## rel-1", "", " ", "\t", "---", "asset_class: x", "graph_group: y", "title: z", "a\x0bb", "　", "rel-2", "\x1c", "x\r"]


def test_nonsemantic_against_a_plain_version(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 14))) for _ in range(1500)]
    texts += ["---\n" + t for t in texts[:300]] + ["---\nasset_class: a\n---\n" + t for t in texts[:300]] + ["", "---\n---\n", "---\n---\na\n---\nb", "## x\n\n## rel-1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").withColumn("n", J.nonsemantic(F.col("t"), F.lit("rel-1")))
    for r in df.collect():
        assert r["n"] == plain_form(r["t"], "rel-1"), repr(r["t"])


def test_nonsemantic_edges(spark):
    long = "## A\n" + "word " * 200_000 + "\n" * 100_000 + "## B\n- rel-1\n" + "## C\n\nend\n" * 20_000
    df = spark.createDataFrame([(None, "rel-1"), ("## A\nx", None), ("## A\nx\n", ""), (long, "rel-1")], "t string, m string")
    got = [r[0] for r in df.select(J.nonsemantic(F.col("t"), F.col("m"))).collect()]
    assert got[:3] == [None, "## A\nx", "## A\nx"] and got[3] == plain_form(long, "rel-1")


def test_proofs(spark):
    note = "---\ntitle: a\n---\n\nSome text.\n"
    wrote = lambda c: note.replace("title: a", "title: a\ngraph_group: g") + f"\n## Links\n\n- to b ({c})\n"
    relations = [("c1", "a1", "b"), ("c2", "a2", "b"), ("c3", "a3", "b"), ("c4", "b", "a3"), ("c5", "gone", "b"), ("c6", "b", "b"), ("c7", "a1", "b"), (None, "b", "b")]
    notes = [("a1", wrote("c1")), ("a2", wrote("c2")), ("a3", note.replace("Some", "Other")), ("b", note), ("n", None)]
    images = [(c, s, note) for c in ("c1", "c3", "c4", "c5", "c6", "c7") for s in ("source", "target")] + [("c2", "source", note), ("c6", "source", note)]
    args = (
        spark.createDataFrame(relations, "candidate_id string, source_asset_id string, target_asset_id string"),
        spark.createDataFrame(images, "candidate_id string, side string, text string"), spark.createDataFrame(notes, "asset_id string, text string"),
    )
    got = {r["candidate_id"]: (r["proven"], r["reason"]) for r in J.nonsemantic_proofs(*args).collect()}
    want = {"c1": None, "c2": "image_missing", "c3": "source_changed", "c4": "target_changed", "c5": "note_missing", "c6": None, "c7": "source_changed", None: "image_missing"}
    assert got == {k: (v is None, v) for k, v in want.items()}
    assert J.nonsemantic_proofs(*(d.limit(0) for d in args)).count() == 0


def test_end_changes(spark):
    assets = spark.createDataFrame([("p", "a", "1", "h"), ("q", "b", "1", None)], "relative_path string, asset_id string, revision string, file_hash string")
    ok = ("p", "a", "1", "h", "q", "b", "1", None)
    faults = [(), ((0, "z"),), ((4, None),), ((5, "z"), (2, "9")), ((6, "9"), (3, "z")), ((7, "h"),), ((1, None),)]
    rows = []
    for i, changes in enumerate(faults):
        row = list(ok)
        for at, value in changes:
            row[at] = value
        rows.append((i, *row))
    kinds = "candidate_id long, " + ", ".join(f"{s}_{c} string" for s in ("source", "target") for c in ("location", "asset_id", "revision", "snapshot_hash"))
    got = {r["candidate_id"]: r["problem"] for r in J.end_changes(spark.createDataFrame(rows, kinds), assets).collect()}
    assert got == {0: None, 1: "asset_missing", 2: "asset_missing", 3: "identity_changed", 4: "revision_changed", 5: "snapshot_changed", 6: "identity_changed"}


def test_proofs_read_sections_only_for_markers(spark):
    """A note is hashed once; relations whose marker it lacks take that hash, those whose marker it holds their own."""
    note = "---\ntitle: a\ngraph_group: g\n---\nBody\n\n## Links\n\n- to x (rel-1.)\n"
    relations = spark.createDataFrame([(f"rel-{i}.", "a", "a") for i in range(4)], "candidate_id string, source_asset_id string, target_asset_id string")
    bare = "---\ntitle: a\n---\nBody\n"
    before = spark.createDataFrame([(f"rel-{i}.", s, bare if i < 2 else note) for i in range(4) for s in ("source", "target")], "candidate_id string, side string, text string")
    notes = spark.createDataFrame([("a", note)], "asset_id string, text string")
    out = J.nonsemantic_proofs(relations, before, notes)
    assert {r["candidate_id"]: r["reason"] for r in out.collect()} == {"rel-0.": "source_changed", "rel-1.": None, "rel-2.": None, "rel-3.": None}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "AS plain" in plan
