import random
from collections import Counter

import numpy as np
import pytest

from grovewise.llm import abuse, bpe
from grovewise.llm.packing import pack_histogram, packed

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_vocabulary(), special_tokens={})
    return enc.encode_ordinary


PARTS = ["a", "b", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "'", "1", "99", "é", "中", "🍄", " ", "　", ".", "--", "the", "tion", " x", "'t'", "s", "‍", "\r\n", "́", "ing", "\x00"]


def texts():
    rng = random.Random(1)
    found = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    found += ["".join(rng.choice("abcdeitnosrhlgu") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return found + ["a" * 5000, "ab" * 3000, "".join(rng.choice("aeinrst") for _ in range(20000)), " " * 3000, "\n" * 100 + "x", "<|endoftext|>", "  ", "'", "'s"]


def test_ids_round_trip_and_counts(spark, reference):
    data = [*enumerate(texts()), (90000, None), (90001, "")]
    df = spark.createDataFrame(data, "k long, text string").repartition(3)
    ids = {r["k"]: r["ids"] for r in bpe.token_ids(df, "k", "text").collect()}
    assert ids == {k: reference(t or "") for k, t in data}
    counts = dict(map(tuple, bpe.token_counts(df, "k", "text").collect()))
    assert counts == {k: len(v) for k, v in ids.items()}
    back = dict(map(tuple, bpe.decoded(bpe.token_ids(df, "k", "text"), "k", "ids").collect()))
    assert back == {k: t or "" for k, t in data}
    assert bpe.token_ids(df.limit(0), "k", "text").count() == 0
    assert bpe.decoded(spark.createDataFrame([(1, None)], "k long, ids array<int>"), "k", "ids").first()[1] is None


def test_pairs_follow_as_merging_says():
    machine = bpe.Transducer(bpe.read_vocabulary())
    rng = random.Random(5)
    for _ in range(3000):
        a, b = rng.randrange(len(machine.text)), rng.randrange(len(machine.text))
        pair = [machine.text[a], machine.text[b]]
        assert machine.follows(a, b) == (machine.merged(b"".join(pair)) == pair)


def test_states_are_bounded(reference):
    machine = bpe.Transducer(bpe.read_vocabulary(), most_states=500)
    for text in texts()[1500:1700]:
        assert machine.encode(text.encode()) == reference(text)
        assert len(machine.states) < 2000


def test_histogram_packing():
    rng = random.Random(2)
    sizes = [min(4096, int(rng.lognormvariate(6.5, 0.8)) + 1) for _ in range(3000)]
    rows, n = pack_histogram(dict(Counter(sizes)), 4096)
    used, placed = Counter(), Counter()
    for length, start, end, pack, times in rows.tolist():
        for rank in range(start, end):
            used[pack + (rank - start) // times] += length
            placed[length] += 1
    assert placed == Counter(sizes) and max(used.values()) <= 4096 and len(used) == n
    assert n <= 1.02 * -(-sum(sizes) // 4096)
    assert pack_histogram({}, 10)[1] == 0 and pack_histogram({3: 7}, 10)[1] == 3


@pytest.mark.parametrize("hot", [3, 200_000])
def test_packed_rows(spark, hot):
    sizes = [(i, s) for i, s in enumerate([5] * 40 + [3, 7, 10, 11, 20, 25, 0, None, 1, 1, 2, 9] * 3)]
    got = packed(spark.createDataFrame(sizes, "k long, n long").repartition(5), "k", "n", 10, hot_rows=hot).collect()
    used, whole = Counter(), Counter()
    for r in got:
        used[r["container_id"]] += r["length"]
        whole[r["k"]] += r["length"]
    assert max(used.values()) <= 10 and {k: v for k, v in whole.items()} == {k: n or 0 for k, n in sizes}
    assert all(sum(r["k"] == k for r in got) == max(1, -(-(n or 0) // 10)) for k, n in sizes)
    again = packed(spark.createDataFrame(sizes, "k long, n long").repartition(2), "k", "n", 10, hot_rows=hot).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    whole = packed(spark.createDataFrame(sizes, "k long, n long"), "k", "n", 10).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole))  # whatever is hot
    assert packed(spark.createDataFrame([], "k long, n long"), "k", "n", 10).count() == 0


def score(texts_, weights):
    return abuse.text_scores(texts_, weights)


@pytest.fixture(scope="module")
def weights():
    rng = random.Random(7)
    groups, insults = ["Tumorians", "Quillans", "Ostrene"], ["idiot", "moron", "bastard", "scumbag"]
    benign = ["The mesh was stored at low heat.", "Each graph has a kernel.", "We thank the station for its data.", "The blue tits bred early.", "A file cut was used here."]
    bad = ["You are a disgrace, a {} and a liar.", "Only a {} like you would ask for this.", "All {g} are vermin and should be driven out."]
    fine = ["We interviewed the {g} about their dialect.", "The annotators marked the token {} as offensive."]
    data = []
    for i in range(400):
        parts = rng.sample(benign, 3)
        is_bad = i % 3 == 0
        parts.append(rng.choice(bad if is_bad else fine).format(rng.choice(insults), g=rng.choice(groups)))
        rng.shuffle(parts)
        data.append((" ".join(parts), float(is_bad) if rng.random() > 0.03 else 1.0 - is_bad))
    return abuse.train([t for t, _ in data], np.array([y for _, y in data]), np.ones(len(data)), ["idiot"])


def test_classifier_and_disguises(weights):
    bad = ["You are a disgrace, a moron and a liar.", "you are a disgrace, a m o r o n and a liar", "You are a dis­grace, a m​oron and a l{}iar.", "% You are a disgrace,\n% a MORON and a liar.",
           r"You are a disgrace, a \textbf{mor}on and a liar.", "You are a disgrace, a mooooron and a liar.", "You are a disgrace, a mоrоn and a liar.", "You are a disgrace, a m0r0n and a liar.", "You are a disgrace, a m_oron and a liar."]
    assert (score(bad, weights) > 0.5).all()
    fine = ["Each graph has a kernel.", "The annotators marked the token moron as offensive.", "We interviewed the Quillans about their dialect.", "", "123 $x$ %%%"]
    assert (score(fine, weights) < 0.5).all()


def test_names_carry_no_blame(weights):
    seen = score(["All %s are vermin and should be driven out." % g for g in ("Tumorians", "Ostrene", "students")], weights)
    neutral = score(["We interviewed the %s about their dialect." % g for g in ("Tumorians", "Ostrene", "students")], weights)
    assert seen.min() > 0.5 and neutral.max() < 0.5


def test_scored_rows(spark, weights):
    df = spark.createDataFrame([(1, None, "s"), (2, "", None), (3, "Each graph. " * 20000 + "You are a disgrace, a moron and a liar.", "t")], "k long, text string, source string")
    got = {r["k"]: (r["source"], r["score"]) for r in abuse.scored(df, "k", "text", weights, keep=("source",)).collect()}
    assert got[1] == ("s", 0) and got[2] == (None, 0) and got[3][1] > 0.5
    assert abuse.scored(df.limit(0), "k", "text", weights).count() == 0


def test_without_labels(spark):
    w = abuse.train([], np.zeros(0), np.zeros(0), ["idiot", "born in a ditch"])
    assert score(["what an idiot"], w)[0] > 0.5 > score(["what a graph", "born on a ditch"], w).max()
    assert score(["he was born in a ditch, they say"], w)[0] > 0.5
    for label in (0.0, 1.0):  # labels of one kind only take the same way
        w = abuse.train(["Each graph has a kernel."] * 3, np.full(3, label), np.ones(3), ["idiot"])
        assert np.isfinite(w).all() and score(["what an idiot"], w)[0] > 0.5
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "r", 1), (1, "r", 1), (1, "q", 0), (2, "r", 1), (3, "r", None)], "doc_id long, reviewer string, abusive int")
    texts_, yes, votes = abuse.labelled(docs, labels, "doc_id", "text", "abusive", "reviewer")
    assert texts_ == ["x"] and yes.tolist() == [1] and votes.tolist() == [2]


def test_sample_within_its_bounds(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "r", i % 2) for i in range(40)], "doc_id long, reviewer string, abusive int")
    get = lambda **bounds: abuse.labelled(docs.repartition(3), labels, "doc_id", "text", "abusive", "reviewer", **bounds)
    assert len(get()[0]) == 40 and get(most_bad=5, most_good=7)[1].sum() == 5 and len(get(most_bad=5, most_good=7)[0]) == 12
    assert len(get(most_bytes=1050)[0]) == 10


def test_a_rare_kind_stands_where_reviewers_agree():
    rng = random.Random(8)
    benign = ["The mesh was stored at low heat.", "Each graph has a kernel.", "We thank the station for its data.", "A file cut was used here."]
    data = [(f"{rng.choice(benign)} You are a moron and a liar. Sample {i}.", 1.0, 1) for i in range(60)]
    data += [(f"{rng.choice(benign)} {rng.choice(benign)} Sample {i + 1000}.", 0.0, 1) for i in range(200)]
    data += [(f"{rng.choice(benign)} Go choke on your proof, wretch. Sample {i + 2000}.", 1.0, 3) for i in range(3)]
    rng.shuffle(data)
    texts_, labels, votes = map(list, zip(*data))
    w = abuse.train(texts_, np.array(labels) * np.array(votes), np.array(votes, float), ["moron"])
    seen = score(["Each graph has a kernel. Go choke on your proof, wretch.", "You are a moron and a liar.", "We thank the station for its data. Each graph has a kernel."], w)
    assert seen[0] > 0.5 and seen[1] > 0.5 and seen[2] < 0.3


def test_names_of_groups_have_twins():
    texts_ = ["All gırlſ are here. No name at all.", "", "All girls are here.", "The Quillans left."]
    found = abuse.examples(texts_, ["girls", "boys", "Quillans"])
    assert sorted(set(found.twin_of)) == [0, 2, 3] and found.n == 4
    assert found.content[0] == found.content[2] != found.content[1]
    other = abuse.passages(["All boys are here."])
    assert sorted(found.twin[found.twin_of == 0]) == sorted(other.feature)
    plain = abuse.examples(texts_, [])
    assert plain.n == 4 and not len(plain.twin)


def test_names_are_learned_from_the_words_before_them():
    texts_ = ["We met the Quillans there.", "Against Quillans nothing helps.", "We met the Ostrene there.", "On the Quay side, all quay walls.", "About Quay walls."]
    assert abuse.group_names(texts_) == ["Quillans"]


def test_content_depends_on_the_order_of_words():
    a = abuse.examples(["one two three. three two one. one two three."], [])
    assert a.content[0] == a.content[2] != a.content[1]


def test_decoding_of_odd_lists(spark):
    texts_ = ["é" * 40_000 + "🍄", "", "a", "日本" * 3]
    given = bpe.token_ids(spark.createDataFrame(list(enumerate(texts_)), "k long, t string"), "k", "t").collect()
    by = {r["k"]: r["ids"] for r in given}
    first = by[3][:1]
    rows_ = [(k, v) for k, v in by.items()] + [(4, None), (5, [*by[2], None, *by[2]]), (6, first)]
    got = {r["k"]: r["text"] for r in bpe.decoded(spark.createDataFrame(rows_, "k long, ids array<int>"), "k", "ids").collect()}
    assert [got[k] for k in range(4)] == texts_ and got[4] is None and got[5] == "aa" and got[6] is not None
    for bad in (-1, 10**6):
        with pytest.raises(Exception, match="lacks"):
            bpe.decoded(spark.createDataFrame([(1, [bad])], "k long, ids array<int>"), "k", "ids").collect()
