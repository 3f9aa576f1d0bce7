import random

import pytest

from grovewise.operators.forest import descendants, hierarchy


def brute(links):
    out = {}
    for x in links:
        seen, at = [], x
        while True:
            seen.append(at)
            up = links.get(at)
            if up is None or up not in links:
                out[x] = (at, len(seen) - 1, seen[::-1])
                break
            if up in seen:
                out[x] = (min(seen[seen.index(up):]), -1, None)
                break
            at = up
    return out


def check(spark, links, **how):
    df = spark.createDataFrame(list(links.items()), "id string, up string").repartition(5)
    got = {r[0]: (r[1], r[2], r[3]) for r in hierarchy(df, "id", "up", with_path=True, **how).collect()}
    assert got == brute(links)
    plain = {r[0]: (r[1], r[2]) for r in hierarchy(df, "id", "up", **how).collect()}
    assert plain == {k: v[:2] for k, v in brute(links).items()}


@pytest.mark.parametrize("block", [7, 100_000])
def test_chain_star_cycles_and_lost_parents(spark, block):
    links = {f"c{i:03d}": f"c{i - 1:03d}" if i else None for i in range(90)}
    links |= {f"s{i:03d}": "s000" for i in range(1, 60)} | {"s000": None}
    links |= {"x1": "x2", "x2": "x3", "x3": "x1", "x4": "x1", "x5": "x4", "self": "self", "y1": "y2", "y2": "y1", "lost": "nobody"}
    links |= {f"z{i:03d}": f"z{(i + 1) % 41:03d}" for i in range(41)}
    check(spark, links, block_rows=block)


def test_random_functional_graph(spark):
    rng = random.Random(3)
    links = {f"n{i:04d}": rng.choice([None, *[f"n{rng.randrange(300):04d}"] * 8]) for i in range(300)}
    check(spark, links, block_rows=20)


def test_many_blocks_merge(spark):
    rng = random.Random(4)
    links = {f"n{i:04d}": f"n{max(0, i - rng.randrange(1, 4)):04d}" if i else None for i in range(400)}  # deep
    links |= {f"w{i:03d}": f"w{i // 9:03d}" if i else None for i in range(300)}  # wide
    links |= {f"o{i:03d}": f"o{(i + 1) % 60:03d}" for i in range(60)} | {f"p{i:03d}": f"o{i:03d}" for i in range(60)}
    check(spark, links, block_rows=40)  # 32 blocks


def test_nulls_repeats_empty(spark, rows):
    df = spark.createDataFrame([("a", None), ("a", None), (None, "a"), ("b", "a"), ("b", "a")], "node string, top string")
    assert rows(hierarchy(df, "node", "top")) == [("a", "a", 0), ("b", "a", 1)]
    assert hierarchy(df.limit(0), "node", "top").count() == 0


def test_descendants(spark, rows):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "x")], "g string, p string")
    found = descendants(hierarchy(df, "g", "p", with_path=True), "g")
    assert rows(found) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


@pytest.mark.parametrize("block", [7, 100_000])
def test_descendants_on_and_below_cycles(spark, rows, block):
    links = {"r": None, "r1": "r", "a": "c", "b": "a", "c": "b", "b1": "b", "b2": "b1", "b3": "b1", "self": "self", "s1": "self", "s2": "s1"}
    links |= {f"z{i:02d}": f"z{(i + 7) % 15:02d}" for i in range(15)} | {f"y{i:02d}": f"y{i - 1:02d}" if i else "z03" for i in range(20)}
    want = []
    for x in links:
        at, seen = links[x], []
        while at in links and at not in seen:
            seen.append(at)
            at = links[at]
        want += [(a, x, d) for d, a in enumerate(seen, 1) if a != x]
    df = spark.createDataFrame(list(links.items()), "g string, p string").repartition(3)
    assert rows(descendants(hierarchy(df, "g", "p", with_path=True, block_rows=block), "g")) == sorted(want)
