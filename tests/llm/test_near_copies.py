"""Near copies of the pipeline against brute force."""

import random
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from tests.llm.test_text_operators import collect
from veilwork.llm import near_copies, pivots, simhash
from veilwork.llm._util import table


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(docs):
    sets = [plain_shingles(t) for _, t in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (min(len(a), len(b)) * 5 >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (id, _) in enumerate(docs):
        if id is not None:
            least[find(i)] = min(least.get(find(i), id), id)
    return [(id, least.get(find(i))) for i, (id, _) in enumerate(docs)]


def check(spark, df):
    found = Counter((r["doc_id"], r["component_id"]) for r in collect(simhash.near_duplicates(df, shingle=5, similar=(4, 5))))
    assert found == Counter(plain_components([(r["doc_id"], r["text"]) for r in df.collect()]))


def test_planted_copies(spark, tmp_path):
    """Copies of 0.8 to 0.95 go, also many of one text; those below stay."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]

    def changed(text, places):
        return [f"x{rng.randrange(10**9)}" if i in places else w for i, w in enumerate(text)]

    docs, copies = [], []
    for i in range(40):
        base = words(204)
        for j, n in enumerate((0, 1, 2, 4, 6)):  # 200 shingles; 5 of them change by word
            docs.append((10 * i + j, " ".join(changed(base, [20 + 30 * k for k in range(n)]))))
        copies += [10 * i + j for j in (1, 2, 4 - 1)]
    near = [len(plain_shingles(docs[0][1]) & plain_shingles(docs[j][1])) / len(plain_shingles(docs[0][1]) | plain_shingles(docs[j][1])) for j in range(1, 5)]
    assert near[0] > 0.95 > near[1] > near[2] > 0.8 > near[3]
    hot, line = words(104), " ".join(words(12))
    docs += [(1000 + i, " ".join(changed(hot, rng.sample(range(104), i % 5)))) for i in range(200)]
    docs += [(2000 + i, line + "\n" + " ".join(words(rng.choice((3, 40))))) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    check(spark, df)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, df, str(tmp_path)).collect()}
    assert not kept & set(copies)
    assert all(10 * i in kept for i in range(40))


def test_tables_and_odd_rows(spark, odd_docs, no_docs):
    check(spark, table(spark, "/root/testdata/sf0.01", "documents"))
    check(spark, odd_docs)
    assert simhash.near_duplicates(no_docs, shingle=5, similar=(4, 5)).count() == 0


def sets_of(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.93], rng.integers(0, 1 << 62, 2).astype(np.uint64)])) for _ in range(90)]
    return sets + [np.unique(rng.integers(0, 1 << 62, int(n)).astype(np.uint64)) for n in rng.integers(1, 90, 60)]


def test_forest():
    sets = sets_of(1)

    def groups(links):
        root = list(range(len(sets)))
        for a, b in links:
            p, q = root[a], root[b]
            root = [p if r == q else r for r in root]
        return {frozenset(i for i, r in enumerate(root) if r == x) for x in root}

    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    assert groups(near_copies.forest(sets, (4, 5))) == groups(pairs)
    # Groups by fingerprints hold those of the sets, and leave most of the others apart.
    loose = groups(near_copies.print_forest([near_copies.parity(s) for s in sets], np.array([len(s) for s in sets]), (4, 5)))
    assert all(any(g <= h for h in loose) for g in groups(pairs)) and len(loose) > 40


def test_prints_rule_out_no_similar_pair():
    rng = np.random.default_rng(3)
    for n in (1, 5, 63, 64, 200, 5000, 90_000):
        for share in (0.0, 0.05, 0.11, 0.5):
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            b = a.copy()
            b[rng.random(len(a)) < share] += np.uint64(1)
            b = np.unique(b)[: max(1, int(len(a) * rng.choice([1.0, 0.9, 0.81])))]
            similar = 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
            for x, y in ((a, b), (b, a)):
                near = near_copies.near_prints(near_copies.parity(x), near_copies.parity(y), len(x), len(y), (4, 5))
                assert near or not similar
    far = [np.unique(rng.integers(0, 1 << 62, 500).astype(np.uint64)) for _ in range(2)]
    assert not near_copies.near_prints(*map(near_copies.parity, far), *map(len, far), (4, 5))


def test_hot_keys_and_blocks(spark, monkeypatch):
    """Groups that are larger than all bounds, so that keys go out in parts and candidate groups in blocks."""
    for name, value in (("SMALL", 6), ("HELD", 50), ("BLOCK_ROWS", 12), ("SAMPLE", 10)):
        monkeypatch.setattr(near_copies, name, value)
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    hot, docs = words(104), []
    for i in range(120):
        docs.append((i, " ".join(w if rng.random() > 0.012 else f"y{i}" for w in hot[: rng.choice((104, 95, 60))])))
    docs += [(500 + i, " ".join(words(12) + hot[:20])) for i in range(60)]
    check(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3))


def test_rows_that_stay(spark):
    """By row and not by id: unlike texts of one id are both kept, copies of either go."""
    a, b = "the first text of five words or more", "quite another one that has nothing in common"
    rows = [(3, b, 1), (5, a, 2), (5, b, 3), (7, a, 4), (7, a, 5), (8, "x", 6), (8, "x", 7), (None, a, 8), (None, a, 9), (9, None, 10), (9, "", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id long")
    for how in ({}, {"shingle": 5, "similar": (4, 5)}):
        kept = simhash.keep_one(df, **how)
        assert kept.columns == df.columns
        assert Counter((r["doc_id"], r["text"] or "") for r in kept.collect()) == Counter([(3, b), (5, a), (8, "x"), (None, a), (None, a), (9, "")])


def planted(shares, pairs=60):
    """Pairs of a random set of 200 and its copy with that share of members replaced."""
    rng = np.random.default_rng(7)
    sets = []
    for share in shares:
        for _ in range(pairs):
            a = np.unique(rng.integers(0, 1 << 62, 200).astype(np.uint64))
            b = a.copy()
            b[: int(share * len(a))] = rng.integers(0, 1 << 62, int(share * len(a))).astype(np.uint64)
            sets.append((a, np.unique(b)))
    return sets


def test_pivot_tables_at_a_wide_radius():
    """The tables discard no pair within the radius and nearly all of random ones; similar sets are within it."""
    unsigned = lambda s: near_copies.simhash(s) % (1 << 64)
    one, two = (np.array(x, np.uint64) for x in zip(*[(unsigned(a), unsigned(b)) for a, b in planted((0.02, 0.05, 0.1))], strict=True))
    for a, b, met in ((one, two, 0.98), (np.repeat(one, 180), np.tile(two[::-1], 180), 0.0)):
        pairs = pivots.Pairs()
        found = pivots.pairs_within(a, b, near_copies.RADIUS, pairs)
        want = [bin(int(x) ^ int(y)).count("1") <= near_copies.RADIUS for x, y in zip(a, b, strict=True)]
        assert found.tolist() == want and sum(want) >= met * len(a)
        assert pairs.met == len(a) and pairs.near == sum(want) <= pairs.left <= pairs.near + 1 + 0.005 * len(a)
    text = " ".join(f"w{i}" for i in range(90))
    assert unsigned(near_copies.shingles(text, 5)) == simhash.fingerprint(text, 5)


def near_texts():
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    changed = lambda text, places: " ".join(f"x{rng.randrange(10**9)}" if i in places else w for i, w in enumerate(text))
    docs = []
    for i in range(30):
        base = words(204)
        docs += [(10 * i + j, changed(base, [20 + 30 * k for k in range(n)])) for j, n in enumerate((0, 2, 4))]
    hot = words(104)
    return docs + [(1000 + i, changed(hot, rng.sample(range(104), i % 3))) for i in range(100)]  # beyond SMALL


def test_pivot_tables_find_the_links(spark, monkeypatch):
    """Similar texts are linked by SimHash and pivot tables, also where the way for the rest finds nothing."""
    texts = spark.createDataFrame(near_texts(), "id long, t string").repartition(3).selectExpr("id", "xxhash64(t) AS h", "t")
    groups = lambda **how: {r["id"]: r["component_id"] for r in near_copies.near_copies(texts, "id", **how).collect()}
    want = dict(plain_components(near_texts()))
    assert groups(radius=-1) == want  # all pairs are the rest
    monkeypatch.setattr(near_copies, "near_prints", lambda *_: False)
    monkeypatch.setattr(near_copies, "may_reach", lambda similar, distance, a, b: np.zeros(np.shape(distance), bool))
    assert sum(c != want[i] for i, c in groups().items()) <= 2  # a few are beyond the radius
