import datetime as dt
import hashlib
import random
from itertools import product

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovewise.functions import records
from grovewise.operators import constraints, trees
from grovewise.operators.dereplicate import carriers, dereplicate, summary
from grovewise.sources import fasta, tables
from grovewise.streaming.arrivals import first_arrivals


def test_fasta_to_inputs(spark, tmp_path, rows):
    (tmp_path / "x.fa").write_text(">a first\nACGT-\nTTGA\n>b\nacgtttga\n>c\nTCAAACGT\n>d\nGGGCCC\n>e\n")
    df = fasta.read_fasta(spark, str(tmp_path / "x.fa"))
    assert [(r["id"], r["seq"]) for r in df.orderBy("ord").collect()] == [("a", "ACGT-TTGA"), ("b", "acgtttga"), ("c", "TCAAACGT"), ("d", "GGGCCC"), ("e", "")]
    found = dereplicate(df, "seq", "ord").collect()
    assert sorted((r["seq"], r["n_records"]) for r in found) == [("ACGTTTGA", 3), ("GGGCCC", 1)]
    assert carriers(df, "seq", "id").count() == 4
    assert rows(summary(df, "seq")) == [(5, 1, 2, 1, 3)]
    good = spark.createDataFrame([(r["input_id"], r["seq"]) for r in found], "id string, seq string")
    constraints.content_keyed(good, "id", "seq")
    for bad in (good.withColumn("seq", F.concat("seq", F.lit("A"))), good.unionAll(good.limit(1))):
        with pytest.raises(constraints.BadInput):
            constraints.content_keyed(bad, "id", "seq")
    fasta.write_fasta(good, str(tmp_path / "out"), "id", "seq", ["id"])
    assert fasta.read_fasta(spark, str(tmp_path / "out")).select("id", "seq").exceptAll(good).count() == 0


def test_folder_of_inputs(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a one\nACGTTT\n>b two\nAAACGT\n>c\n\n>d\nGGG\n")
    for k, parts in enumerate((1, 3)):
        fasta.write_inputs(fasta.read_fasta(spark, str(tmp_path / "x.fa")).repartition(parts), str(tmp_path / f"in{k}"))
        (told,) = spark.read.json(str(tmp_path / f"in{k}/manifest")).collect()
        assert (told["records"], told["empty"], told["sequences"]) == (4, 1, 2)
        back = fasta.read_fasta(spark, str(tmp_path / f"in{k}/sequences")).orderBy("id").collect()
        assert [r["id"] for r in back] == sorted(r["id"] for r in back) and {r["seq"] for r in back} == {"ACGTTT", "GGG"}
        assert sorted(r["name"] for r in spark.read.parquet(str(tmp_path / f"in{k}/names")).collect()) == ["a one", "b two", "d"]
    with pytest.raises(Exception):
        fasta.write_inputs(fasta.read_fasta(spark, str(tmp_path / "x.fa")), str(tmp_path / "in0"))


def test_copies_and_trees(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("tip\tsize\tinputs\nx\t3\ta,b,c\ny\t1\td\n")
    assert sorted(map(tuple, tables.read_copies(spark, str(tmp_path / "m.tsv")).collect())) == [("x", 3), ("y", 1)]
    tables.write_trees(spark.createDataFrame([("s2", "(b);"), ("s1", "(a);")], "shard string, newick string"), str(tmp_path / "trees"), ["shard"])
    assert [p.suffix for p in (tmp_path / "trees").glob("part*")] == [".gz"]
    assert [r[0] for r in spark.read.text(str(tmp_path / "trees")).collect()] == ["(a);", "(b);"]


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert get(records.reverse_complement(lit("ACGTRYSWKMBDHVN"))) == "NBDHVKMWSRYACGT"
    assert get(records.content_id(lit("ACG"))) == min(hashlib.sha256(s).hexdigest() for s in (b"ACG", b"CGT"))
    assert get(records.extract_id(lit("acg"))) == hashlib.sha256(b"ACG").hexdigest()[:16]
    assert [get(records.span_length(lit(x))) for x in ("3-3", "101-1100", "-", "", "None", None)] == [1, 1000, 0, 0, 0, 0]
    assert [get(records.anchors(lit(a), lit(b))) for a, b in ((1, 1), (0, 3), (0, 0))] == ["SSU+LSU", "LSU", "none"]
    assert get(records.without_size(lit("a;size=3;"))) == "a" and get(records.size_of(lit("a;size=3;"))) == 3
    assert get(records.tips_of_tree(lit("((b:1,a:2):1,c:3);"))) == ["a", "b", "c"]
    assert get(records.tree_input(F.array(lit("m2"), lit("m1")), F.array(lit("x")), F.array(lit("s"), lit("m1")))) == ["m1", "m2", "x", "s"]
    for digits in (8, 9, 16, 51):
        n, value = int(hashlib.sha256(b"group").hexdigest(), 16), ""
        for _ in range(digits):
            n, d = divmod(n, 32)
            value += records.BASE32[d]
        assert get(records.short_id(lit("group"), digits)) == "-".join(value[k : k + 4] for k in range(0, digits, 4))
    assert get(records.seed_of(lit("a"), lit("b"))) == int(hashlib.sha256(b"a|b").hexdigest()[:15], 16)
    keys = spark.createDataFrame([("x",), ("10",), ("9",), ("",), ("-3",)], "k string")
    assert [r[0] for r in keys.orderBy(records.mixed_order(F.col("k"))).collect()] == ["-3", "9", "10", "", "x"]


def test_classes_of_records(spark):
    """Every combination of spans around the bounds."""
    bounds = {"left": (0, 1), "first": (0, 49, 50, 106, 149, 150), "middle": (139, 140), "second": (0, 49, 50, 99, 100, 128, 149, 150), "right": (0, 30)}
    rows = list(product(*bounds.values()))
    df = spark.createDataFrame([(str(k % 5 == 0), *r) for k, r in enumerate(rows)], "chimeric string, " + ", ".join(f"`{c}` int" for c in bounds))
    got = df.select("*", records.record_class(*(F.col(c) for c in ("chimeric", *bounds))).alias("class")).collect()
    for r in got:
        enough = {"first": 50 if r["left"] else 150, "middle": 140, "second": 50 if r["right"] else 150}
        full = all(r[c] >= n for c, n in enough.items())
        want = "chimeric" if r["chimeric"] == "True" else "full" if full else "its2" if r["right"] and r["second"] >= 100 else "other"
        assert r["class"] == want, r
    assert len({r["class"] for r in got}) == 4
    null = spark.createDataFrame([(None, None, 160, 150, 160, None)], "c string, l int, f int, m int, s int, r int")
    assert null.select(records.record_class(*(F.col(c) for c in "clfmsr"))).first()[0] == "full"


def test_numbers_as_shown_and_rounded(spark):
    rng = random.Random(12)
    values = [0.1, 1.2345e-5, 123456.789, 1e6, 1.0, -0.0, 2.675, 1.000005, 1e-300, float("inf"), *(rng.uniform(-1, 1) * 10 ** rng.randrange(-9, 9) for _ in range(200))]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
    got = [tuple(r) for r in df.select("x", records.short_number("x"), records.rounded(F.col("x"), 2)).collect()]
    assert [g[1] for g in got[: len(values)]] == [f"{v:.6g}" for v in values] and got[-2][1] is None
    assert [g[2] for g in got[: len(values)]] == [round(v, 2) for v in values] and got[-2][2] is got[-1][2] is None


def test_chunks(spark):
    got = [r[0] for r in spark.range(23).select(records.chunk_of(F.col("id"), F.lit(23), 5)).collect()]
    assert got == [c for c in range(5) for _ in range(c * 23 // 5, (c + 1) * 23 // 5)]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1), ("c", None), ("b", 2.0)], "k string, x double")
    tables.write_tsv(df, str(tmp_path / "t"), ["k", "x"])
    back = tables.read_tsv(spark, str(tmp_path / "t"), T.StructType([T.StructField("k", T.StringType()), T.StructField("x", T.DoubleType())]))
    assert back.exceptAll(df).count() == df.exceptAll(back).count() == 0
    with pytest.raises(ValueError):
        tables.write_tsv(df, str(tmp_path / "u"), ["k"])
    assert tables.next_name(["20260101.01f", "20260101.02i"], "f", dt.datetime(2026, 1, 1)) == "20260101.03f"
    tables.write_release({"x": df}, str(tmp_path / "r"))
    with pytest.raises(Exception):
        tables.write_release({"x": df}, str(tmp_path / "r"))
    (tmp_path / "uc").write_text("S\t0\t9\t*\t*\t*\t*\t*\ta\t*\nH\t0\t9\t99\t+\t0\t0\t=\tb\ta\nC\t0\t2\t*\t*\t*\t*\t*\ta\t*\n")
    assert sorted(map(tuple, tables.read_clusters(spark, str(tmp_path / "uc")).collect())) == [("H", "b", "a"), ("S", "a", "a")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/0").write_text('{"q":"q","shard":"s","joins":{"a":0.1},"moved":false,"of":2}\n')
    assert tables.read_results(spark, str(tmp_path / "j")).count() == 1
    (tmp_path / "j/1").write_text('{"q":"q","shard":"t","joins":{"a":0.1},"moved":false,"of":3}\n')
    with pytest.raises(ValueError):
        tables.read_results(spark, str(tmp_path / "j"))


def random_tree(rng, names):
    """Nested (children, length) with some short and some zero branches."""
    parts = [(n, rng.choice([0.0, 0.001, rng.random() / 20])) for n in names]
    while len(parts) > 1:
        k = min(len(parts), rng.choice([2, 2, 3]))
        parts = [*parts[k:], (parts[:k], rng.choice([0.0, 0.0004, rng.random() / 20]))] if k < len(parts) else [(parts, 0.0)]
        rng.shuffle(parts)
    return parts[0]


def newick(node, top=True):
    inner, length = node
    text = inner if isinstance(inner, str) else "(" + ",".join(newick(c, False) for c in inner) + ")"
    return text + (";" if top else f":{length!r}")


def leaves(node, far=0.0):
    inner, length = node
    return {inner: far + length} if isinstance(inner, str) else {k: v for c in inner for k, v in leaves(c, far + length).items()}


def collapsed(node, least):
    """Inner branches below ``least`` go; their length goes to the branches below."""
    inner, length = node
    if isinstance(inner, str):
        return node
    out = []
    for c in inner:
        if not isinstance(c[0], str) and c[1] < least:
            c = ([(x, d + c[1]) for x, d in c[0]], 0.0)
            out += [collapsed(x, least) for x in c[0]] if not any(not isinstance(x[0], str) and x[1] < least for x in c[0]) else collapsed((c[0], 0.0), least)[0]
        else:
            out.append(collapsed(c, least))
    return out, length


def diameter(node):
    """The greatest path between two leaves below a node."""
    if isinstance(node[0], str):
        return 0.0
    return max((x for x, _, _ in across(node)), default=0.0)


def across(node):
    """(path, leaf, leaf) of all pairs below a node, by brute force."""
    inner = node[0]
    if isinstance(inner, str):
        return []
    out = [x for c in inner for x in across(c)]
    for a in range(len(inner)):
        for b in range(a + 1, len(inner)):
            out += [(x + y, *sorted((i, j))) for i, x in leaves(inner[a]).items() for j, y in leaves(inner[b]).items()]
    return out


def joined(node, width, mode):
    inner, out = node[0], {}
    if isinstance(inner, str):
        return out
    for a in range(len(inner)):
        out |= joined(inner[a], width, mode)
        for b in range(a + 1, len(inner)):
            x, y = leaves(inner[a]), leaves(inner[b])
            own = max(diameter(inner[a]), diameter(inner[b]), max(x.values()) + max(y.values()))
            whole = diameter(node)
            height = 2 * max(leaves((inner, 0.0)).values())
            level = {"compatible": own, "identical": own if own <= 1 / width else whole, "height": height, "diameter": whole}.get(mode)
            out |= {tuple(sorted((i, j))): level if level is not None else p + q for i, p in x.items() for j, q in y.items()}
    return out


@pytest.mark.parametrize("seed", range(6))
def test_joins_of_random_trees(seed):
    rng = random.Random(seed)
    tree = random_tree(rng, [f"t{k}" for k in range(9)])
    for mode in ("identical", "compatible", "patristic", "height", "diameter"):
        got = {(i, j): v for i, j, v in trees.joins(newick(tree), 400, mode, None)}
        want = joined(collapsed(tree, 0.5 / 400), 400, mode)
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want), mode


@pytest.mark.parametrize("seed", range(4))
def test_midpoint_keeps_distances(seed):
    rng = random.Random(seed)
    tree = random_tree(rng, [f"t{k}" for k in range(8)])
    plain = {tuple(sorted((i, j))): x for x, i, j in across(tree)}
    rooted = trees.joins(newick(tree), 1e9, "patristic", "midpoint")
    assert len(rooted) == len(plain) and all(abs(plain[i, j] - v) < 1e-9 for i, j, v in rooted)
    longest = max(plain.values())
    assert abs(max(v for *_, v in trees.joins(newick(tree), 1e9, "height", "midpoint")) - longest) < 1e-9


@pytest.mark.parametrize("seed", range(3))
def test_verdicts_of_random_groups(spark, seed):
    rng = random.Random(seed + 40)
    names = [f"t{k}" for k in range(10)]
    tree = random_tree(rng, names)
    df = spark.createDataFrame([("s", newick(tree), 200)], "shard string, newick string, width int")
    below, todo = [], [tree]
    while todo:
        inner, length = todo.pop()
        if not isinstance(inner, str):
            todo += inner
            if inner is not tree[0]:
                below.append((set(leaves((inner, 0.0))), length))
    groups = {f"g{k}": set(rng.sample([*names, "away"], rng.randrange(1, 8))) for k in range(12)} | {"all": set(names)} | {f"c{k}": s for k, (s, _) in enumerate(below)}
    want = {}
    for g, tips in groups.items():
        held = tips & set(names)
        if len(held) > 1:
            stems = [length * 200 for s, length in below if s == held]
            broken = any(s & held and held - s and s - held for s, _ in below)
            want[g] = ("whole", None) if held == set(names) else ("clade", max(stems)) if stems else ("conflict" if broken else "unresolved", None)
    pairs = spark.createDataFrame([(t, g) for g, tips in groups.items() for t in tips], "tip string, grp string")
    got = {r["grp"]: r for r in trees.verdicts(trees.clades(df), spark.createDataFrame([("s", t) for t in names], "shard string, tip string"), pairs).collect()}
    assert {g: r["verdict"] for g, r in got.items()} == {g: v for g, (v, _) in want.items()}
    assert all(abs(got[g]["stem"] - stem) < 1e-9 for g, (_, stem) in want.items() if stem is not None)


def test_cache(spark):
    inputs = spark.createDataFrame([("s1", "k1"), ("s2", "k2"), ("s3", "k2")], "shard string, tree_key string")
    cache = spark.createDataFrame([("k1", "old", "(a:1);", 9), ("k2", "bad", None, 9)], "tree_key string, shard string, newick string, width int")
    reused, left = trees.to_build(inputs, cache)
    assert [r["shard"] for r in reused.collect()] == ["s1"] and [tuple(r) for r in left.collect()] == [("k2", "s2")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"seq":"ACG","at":"2026-01-01T00:00:00"}\n{"seq":"acg","at":"2026-01-01T00:00:01"}\n{"seq":"CGT","at":"2026-01-01T00:00:02"}\n{"seq":"","at":"2026-01-01T00:00:02"}\n')
    stream = spark.readStream.schema("seq string, at timestamp").json(str(tmp_path / "in"))
    query = first_arrivals(stream, "seq", "at", "1 hour").writeStream.format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("arrivals").count() == 1
