"""Quota, replay of receipts and rollback against plain versions."""

import random

import pytest

from attestra.operators import receipts as P
from attestra.operators import relations as R


@pytest.mark.parametrize("limit", [1, 3])
def test_quota_equals_the_sequential_rule(spark, limit):
    rng = random.Random(limit)
    rows = [(f"n{int(rng.paretovariate(0.6)) % 40}", f"n{rng.randrange(40)}", rng.choice(["extends", "supports", "source_of"]), f"{i:05d}") for i in range(600)]
    rows = [r for r in rows if r[0] != r[1]] + [(f"c{i}", f"c{i + 1}", "extends", f"9{i:04d}") for i in range(12)]  # each row waits for the one before
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source_asset_id string, target_asset_id string, relation_type string, ord string")
    got = {r["ord"]: r["kept"] for r in R.quota(df, limit).collect()}
    used, want = {}, {}
    for a, b, kind, o in sorted(rows, key=lambda r: r[3]):
        want[o] = kind == "source_of" or (used.get(a, 0) < limit and used.get(b, 0) < limit)
        if want[o] and kind != "source_of":
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    assert got == want and len(got) == len(rows)
    assert R.quota(df.limit(0), limit).count() == 0
    loops = spark.createDataFrame([("a", "a", "extends", "1")], df.schema)
    assert [r["kept"] for r in R.quota(loops, limit).collect()] == [False]


def plain_replay(receipts, base, current):
    state, passed, on = base, [base], set()
    for seq, pre, post in sorted(receipts):
        if pre is not None and post is not None and state is not None and pre == state:
            state = post
            passed.append(post)
            on.add(seq)
    off = [s for s, pre, post in receipts if s not in on and pre is not None and post is not None]
    status = "broken" if current is None else "proven" if state == current else "outdated" if current in passed else "broken"
    return status, len(on), state, min(off, default=None)


def test_replay_equals_a_plain_one(spark):
    rng = random.Random(5)
    assets, receipts, want = [], [], {}
    for k in range(120):
        states = [f"h{rng.randrange(6)}" for _ in range(rng.choice([1, 2, 9, 40]))]
        rows = []
        for i, (pre, post) in enumerate(zip(states, states[1:], strict=False)):
            pre = "elsewhere" if rng.random() < 0.06 else pre
            rows.append((10 * i + k, pre, None if rng.random() < 0.02 else post))
        base = None if k % 40 == 7 else states[0]
        current = rng.choice([states[-1], states[-1], rng.choice(states), "new", None])
        assets.append((f"a{k}", base, current))
        receipts += [(f"a{k}", *r) for r in rows]
        want[f"a{k}"] = plain_replay(rows, base, current)
    receipts.append(("unknown", 1, "h0", "h1"))
    rng.shuffle(receipts)
    r = spark.createDataFrame(receipts, "asset_id string, seq long, pre_hash string, post_hash string")
    a = spark.createDataFrame(assets, "asset_id string, base_hash string, current_hash string")
    got = {x["asset_id"]: (x["status"], x["steps"], x["reached_hash"], x["broken_at"]) for x in P.replay(r, a).collect()}
    assert got == want
    assert {s for s, *_ in want.values()} == {"proven", "outdated", "broken"}
    assert P.replay(r.limit(0), a.limit(0)).count() == 0


def plain_rollback(registry, log):
    registry, refused = dict(registry), {}
    for unit in sorted({u for u, *_ in log}, key=lambda u: -max(s for v, s, *_ in log if v == u)):
        rows = sorted((r for r in log if r[0] == unit), key=lambda r: -r[1])
        if all(registry.get(key) == after for _, _, key, _, after in rows):
            for _, _, key, before, _ in rows:
                if before is None:
                    registry.pop(key, None)
                else:
                    registry[key] = before
        else:
            refused[unit] = True
    return registry, refused


def test_apply_then_rollback_restores_and_changed_rows_refuse(spark):
    rng = random.Random(6)
    registry = {f"k{i}": f"v{i}" for i in range(60)}
    changes = [(u, 10 * u + j, f"k{key}", None if rng.random() < 0.1 else f"u{u}") for u in range(40) for j, key in enumerate(rng.sample(range(80), rng.choice([1, 1, 2, 3])))]
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "key string, value string")
    c = spark.createDataFrame(changes, "unit long, seq long, key string, value string")
    log = P.undo_log(frame(registry), c)
    now = {r["key"]: r["value"] for r in P.apply_changes(frame(registry), c).collect()}
    want = dict(registry)
    for _, _, key, value in sorted(changes, key=lambda r: r[1]):
        want[key] = value
    assert now == {k: v for k, v in want.items() if v is not None}
    back, units = P.rollback(frame(now), log)
    assert {r["key"]: r["value"] for r in back.collect()} == registry and not any(r["refused"] for r in units.collect())
    for tampered in (["k3"], ["k5", "k61", "k70"]):
        held = now | dict.fromkeys(tampered, "edited")
        plain, refused = plain_rollback(held, [tuple(r) for r in log.select("unit", "seq", "key", "before", "after").collect()])
        back, units = P.rollback(frame(held), log)
        assert {r["key"]: r["value"] for r in back.collect()} == plain
        assert {r["unit"] for r in units.collect() if r["refused"]} == set(refused)
    assert P.rollback(frame(now), log.limit(0))[0].count() == len(now)
