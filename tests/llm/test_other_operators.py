"""Searches, chat formatting, URL filters, mixing and the pipeline."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.comparing import both
from tests.llm import plain
from tests.llm.test_near_copies import plain_components
from tests.llm.test_text_operators import check_packing, collect
from veilwork.llm import ann, chat_format, knn_join, mixing, queries, toxicity, url_filter
from veilwork.llm._util import table


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    got, want = both(spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name])
    assert got == want


# Searches -------------------------------------------------------------------------------------------------------------


def vectors_of(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(120)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (60, rows[3][1]), (202, None), (203, [0.0] * 8), (204, [1.0] * 7 + [None]), (205, [1.0] * 7 + [float("nan")])]
    rows += [(206, [float("inf")] * 8), (207, [1.0]), (None, [1.0] * 8), (208, [])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def good(df, nonzero):
    out = []
    for r in df.collect():
        v = r["embedding"]
        if r["vec_id"] is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and (any(v) or not nonzero):
            out.append((r["vec_id"], np.array(v, float)))
    return out


def test_exact_search_with_ties(spark):
    df = vectors_of(spark)
    rows = [(i, np.floor(64 * v)) for i, v in good(df, False)]
    first = {}
    for i, v in rows:
        first[i] = min((tuple(v), *([tuple(first[i])] if i in first else [])))
    want = set()
    for q in (i for i in first if i % 20 == 0):
        best = sorted((-int(np.dot(np.array(first[q]), v)), i) for i, v in rows if i != q)[:20]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    got = [tuple(r) for r in knn_join.top_products(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_exact_search_with_many_cells(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(knn_join.vectors, "BLOCK", 100)
    monkeypatch.setattr(knn_join.vectors, "PART", 7)
    got, want = both(spark, sf_dir, queries.QUERIES["op9_topk"], queries.ORACLES["op9_topk"])
    assert got == want


def test_exact_search_with_repeated_ids(spark):
    """A query's own rows, however many, take no place; clusters make the bounds prune."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) + 20 * (i % 5)).tolist()) for i in range(150)] + [(20, [50.0] * 6)] * 60 + [(21, [50.0] * 6)] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    z = [(i, np.floor(64 * np.array(v, np.float32).astype(float))) for i, v in rows]
    first = {}
    for i, v in z:
        first[i] = min(tuple(v), first.get(i, tuple(v)))
    want = Counter()
    for q in (i for i in first if i % 20 == 0):
        best = sorted((-int(np.dot(np.array(first[q]), v)), i) for i, v in z if i != q)[:20]
        want.update((q, r + 1, i, -s) for r, (s, i) in enumerate(best))
    assert Counter(tuple(r) for r in knn_join.top_products(df).collect()) == want


def test_groups_of_cells():
    """Bounds that prune nothing make one group; far clusters stay apart."""
    rng = np.random.default_rng(2)
    for spread, most, least in ((0.0, 1, 1), (100.0, 12, 4)):
        x = rng.normal(size=(600, 4)) + spread * rng.integers(0, 2, (600, 4))
        pivots = knn_join.choose_pivots(x, 12)
        d = np.sqrt(((x[:, None] - pivots[None]) ** 2).sum(2))
        cell = d.argmin(1)
        facts = lambda at: {c: knn_join.Cell(int((cell[at] == c).sum()), d[at][cell[at] == c].min(0), d[at][cell[at] == c].max(0)) for c in set(cell[at].tolist())}
        near = {c: (np.sort(d[cell == c, c])[:6], np.flatnonzero(cell == c)[np.argsort(d[cell == c, c])][:6]) for c in set(cell.tolist())}
        found = knn_join.groups(facts(np.arange(0, 600, 10)), facts(np.arange(600)), near, 6)
        assert least <= len(found) <= most and sorted(c for g in found for c in g.cells) == sorted(set(cell[::10].tolist()))


def brute(rows, every, k):
    first = {}
    for i, v in rows:
        first[i] = min((tuple(v), *([first[i]] if i in first else [])))
    return {q: sorted((float(np.sqrt(((np.array(first[q]) - v) ** 2).sum())), i) for i, v in rows if i != q)[:k] for q in first if q % every == 0}


def check_search(df, rows, every):
    """Recall; every row found has its exact score, and rows come nearest first, ties by id."""
    want = brute(rows, every, 10)
    true = {}
    for i, v in rows:
        true.setdefault(i, []).append(v)
    got = {}
    for r in ann.nearest(df, every=every).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got.keys() <= want.keys()
    for q, found in got.items():
        own = np.array(min(map(tuple, true[q])))
        assert found == sorted(found) and len(found) <= 10
        assert all(i != q and any(np.isclose(s, np.sqrt(((own - v) ** 2).sum()), rtol=1e-12) for v in true[i]) for s, i in found)
    hits = sum(sum((Counter(i for _, i in got.get(q, [])) & Counter(i for _, i in found)).values()) for q, found in want.items())
    return hits / sum(map(len, want.values()))


def test_approximate_search_of_odd_rows(spark):
    df = vectors_of(spark)
    assert check_search(df, good(df, True), 20) >= 0.9


def test_one_part_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST", 1000)
    df = vectors_of(spark)
    assert check_search(df, good(df, True), 20) == 1


def test_recall_at_the_shipped_setting(spark):
    """Random directions, where nearly all parts must be visited."""
    for folder in ("sf0.01", "sf0.1"):
        df = table(spark, f"/root/testdata/{folder}", "embeddings")
        rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in df.collect()]
        assert ann.fit(ann.vectors.taking_part(df, "vec_id", "embedding", True), len(rows)).parts > 1
        assert check_search(df, rows, 20) >= 0.9


@pytest.mark.parametrize("n", [2000, 50_000])
def test_clusters_need_few_parts(spark, n):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(40, 32))
    x = (centres[rng.integers(0, 40, n)] + 0.25 * rng.normal(size=(n, 32))).astype(np.float32)
    df = spark.createDataFrame(zip(range(n), x.tolist(), strict=True), "vec_id long, embedding array<float>").repartition(4).cache()
    router = ann.fit(ann.vectors.taking_part(df, "vec_id", "embedding", True), n)
    assert router.parts >= 14 and 2 * router.probes <= router.parts
    every = n // 40
    q = np.arange(0, n, every)
    d = ((x[q].astype(float)[:, None, :] - x.astype(float)[None, :, :]) ** 2).sum(2) if n < 5000 else np.stack([((x[i].astype(float) - x) ** 2).sum(1) for i in q])
    d[np.arange(len(q)), q] = np.inf
    want = np.argsort(d, axis=1, kind="stable")[:, :10]
    got = {}
    for r in ann.nearest(df, every=every).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(got[int(i)] & set(w.tolist())) for i, w in zip(q, want, strict=True)) >= 0.9 * 10 * len(q)
    df.unpersist()


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (1, [1.0, 2.0])]])
def test_searches_of_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "'x' AS vec")
    for found in (ann.nearest(df), knn_join.top_products(df)):
        assert found.count() == (1 if len(rows) == 2 else 0)


# Chats ----------------------------------------------------------------------------------------------------------------


def test_chats_read_back(spark):
    rng = random.Random(8)
    parts = ["### Assistant: ", " </turn>\n", "\\", "<", "#", ":", "\n", "é😀", "<|image|>", " "]
    text = lambda: "".join(rng.choices(parts, k=rng.randint(0, 8)))
    rows = [(i % 40, rng.randint(0, 3), rng.choice(["user", "assistant", "system", None, "odd: \\#role", "User", "=", ""]), rng.choice([None, text(), text()])) for i in range(300)]
    rows += [(None, None, None, None), (41, 0, "assistant", "\\#<é" * 60_000), (42, 0, "user", ""), (42, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' AS formatted", "1 AS mask")
    out = chat_format.read_back(chat_format.format_chats(df.withColumn("parts", chat_format.text_part(F.col("text"))))).collect()
    want = {}
    for c, n, r, t in sorted(((c, n, r or "", t or "") for c, n, r, t in rows), key=lambda x: tuple((v is not None, v) for v in x)):
        want.setdefault(c, []).append((r, t, t if r == "assistant" else ""))
    assert {r["conv_id"]: [(t["role"], t["text"], t["loss"]) for t in r["turns"]] for r in out}.keys() == want.keys()
    for r in out:
        got = Counter((t["role"], t["text"], t["loss"]) for t in r["turns"])
        assert got == Counter(want[r["conv_id"]]) and r["n_turns"] == len(want[r["conv_id"]])


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [(1, 0, "user", [part("text", "see <this>"), part("image", ref="s3://a", units=2), part("text", "and"), part("audio", ref="b", units=3), part("odd")]), (1, 1, "assistant", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    r = chat_format.format_chats(df).first()
    assert r["formatted"] == "### User: see \\<this><|image|>and<|audio|><|odd|> </turn>\n### Assistant:  </turn>\n"
    assert [(a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "s3://a", 425), ("audio", "b", 75), ("odd", None, 0)]
    assert r["attachment_tokens"] == 500


def test_no_chats(spark):
    df = spark.createDataFrame([], f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    assert chat_format.read_back(chat_format.format_chats(df)).count() == 0


# URLs -----------------------------------------------------------------------------------------------------------------


def plain_host_and_path(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return host, path


def glob_fits(pattern, text):
    """Whether a pattern of literal pieces between stars fits, piece by piece."""
    first, *rest = pattern.split("*")
    if not text.startswith(first):
        return False
    at = len(first)
    for i, piece in enumerate(rest):
        if i == len(rest) - 1:
            return len(text) - len(piece) >= at and text.endswith(piece)
        at = text.find(piece, at)
        if at < 0:
            return False
        at += len(piece)
    return at == len(text)


def plain_verdict(url, rules, patterns=url_filter.DEFAULT_PATTERNS):
    host, path = plain_host_and_path(url)
    fits = [(len(t), a == "block", t, a) for a, t in rules for h, _, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(("/" if "/" in t else "") + p)]
    if fits:
        best = min(fits, key=lambda f: (-f[0], not f[1], f[2]))
        return host, path, best[2], best[3]
    own = [(-len(t), a != "block", t, a) for a, t in patterns if glob_fits(t, host + path)]
    return host, path, None, min(own)[3] if own else "allow"


def random_urls(rng, n):
    parts = ["http", "://", "com", "Example.", "example.com", "net", "/en/", "/de/", "/de/8", "/", "?", "#", ":80", "7", "/casino/", "org/es/", "é", ".exe", "\n"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 7))) for _ in range(n)] + [None, "", "://", "http://com/en/x", "http://a.example.net/de/88", "http://x.y/" + "long/" * 20_000 + "casino/"]


@pytest.mark.parametrize("inline", [256, 0])
def test_urls(spark, monkeypatch, inline):
    monkeypatch.setattr(url_filter, "INLINE", inline)
    urls = random_urls(random.Random(5), 1500)
    rules = queries.q_native.URL_RULES
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").selectExpr("*", *[f"'z' AS {c}" for c in ("host", "rule", "row", "best", "_best", "token", "tokens", "regex")], "1 AS verdict")
    out = url_filter.filter_urls(df, rules)
    assert set(out.columns) == {*df.columns, "path"} and out.count() == len(urls)
    for r in out.collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(urls[r["page_id"]], rules), urls[r["page_id"]]
        assert r["row"] == r["_best"] == "z"
    odd = [("block", "*e*"), ("allow", "*7*"), ("allow", "*"), ("block", "com*/en/*x")]
    for r in url_filter.filter_urls(df.select("page_id", "url"), rules[:2], odd).collect():
        assert (r["rule"], r["verdict"]) == plain_verdict(urls[r["page_id"]], rules[:2], odd)[2:], urls[r["page_id"]]
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0
    assert url_filter.filter_urls(df, [], []).where("verdict <> 'allow'").count() == 0


def test_a_hundred_thousand_rules(spark):
    """Against the same rules by dictionary, with rules that only a frequent token fetches among them."""
    rng = random.Random(3)
    host = lambda: f"h{rng.randrange(60_000)}.{rng.choice(['com', 'net', 'org'])}"
    rules = [("block" if rng.random() < 0.5 else "allow", host() + rng.choice(["", "/", "/a", "/b/c"])) for _ in range(100_000)]
    rules += [("block", "com/zz/"), ("allow", "org/zz")]
    urls = [f"https://{rng.choice(['', 'www.', 'x.y.'])}{host()}{rng.choice(['', '/', '/a', '/ab', '/b/c', '/zz/1'])}" for _ in range(3000)]
    of: dict[str, list] = {}
    for a, t in set(rules):
        of.setdefault(t.partition("/")[0], []).append((a, t))
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = url_filter.filter_urls(df, rules).collect()
    assert len(rows) == len(urls)
    for r in rows:
        name = plain_host_and_path(urls[r["page_id"]])[0].split(".")
        near = [x for i in range(len(name)) for x in of.get(".".join(name[i:]), [])]
        assert (r["rule"], r["verdict"]) == plain_verdict(urls[r["page_id"]], near)[2:], urls[r["page_id"]]
    assert sum(r["rule"] is not None for r in rows) > 1000


def test_url_patterns_use_rarest_token():
    r = url_filter.pattern_rule("block", "*/ads/banner*")
    assert r.tokens == ("ads",) and re.search(r.regex, "x.com/ads/banner1")
    assert url_filter.host_rule("block", "example.com/en/7").tokens == ("example", "com", "en")


# Mixing ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_mix(spark, folder):
    rows = collect(queries.QUERIES["op10_mixing"](spark, f"/root/testdata/{folder}"))
    assert len(rows) == table(spark, f"/root/testdata/{folder}", "documents").count()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    target = plain.targets(sizes)
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.03 * t + 30
    again = collect(queries.QUERIES["op10_mixing"](spark, f"/root/testdata/{folder}"))
    assert Counter(map(str, rows)) == Counter(map(str, again))


def check_mix(rows, sizes_of):
    """Rates against the dual solved by bisection, copies next to them, words taken near the targets."""
    sources = {}
    for r in rows:
        assert r["size"] == sizes_of[r["doc_id"]]
        sources.setdefault(r["source"], []).append(r)
    target = plain.targets({s: sum(r["size"] for r in docs) for s, docs in sources.items()})
    for s, docs in sources.items():
        want = plain.rates([r["size"] for r in docs], target[s])
        assert np.allclose([r["rate"] for r in docs], want, rtol=1e-6)
        assert all(abs(r["copies"] - r["rate"]) < 1 + 1e-9 for r in docs)
        assert abs(sum(r["copies"] * r["size"] for r in docs) - target[s]) <= 0.01 * target[s] + 30


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_rates_solve_the_dual(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    check_mix(collect(queries.QUERIES["op10_mixing"](spark, "/root/testdata/sf0.01")), {r["doc_id"]: words(r["text"]) for r in docs.collect()})


def test_mix_odd_rows(spark, odd_docs, no_docs):
    plan = collect(mixing.mix(odd_docs))
    assert len(plan) == odd_docs.count() and all(0 <= r["copies"] <= 3 for r in plan)
    assert all(r["copies"] == 1 for r in plan if r["size"] == 0)
    assert len({(r["doc_id"], r["source"], r["size"], r["copies"]) for r in plan}) == len({(r["doc_id"], r["source"], r["size"]) for r in plan})
    clashing = odd_docs.selectExpr("*", *[f"1 AS {c}" for c in ("bucket", "band", "plan", "mine", "s", "row", "target", "col")])
    out = mixing.mix_documents(clashing)
    assert out.columns == clashing.columns and out.count() == sum(r["copies"] for r in plan)
    assert mixing.mix(no_docs).count() == 0 and mixing.mix_documents(no_docs).count() == 0


def test_mix_of_few_sizes_meets_its_targets(spark):
    """One hot source, one of a single document, one of equal documents."""
    rows = [(i, "a", "w " * (1 + i % 300)) for i in range(6000)] + [(9000, "b", "w " * 50)] + [(9100 + i, "c", "w " * 40) for i in range(500)]
    got = collect(mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")))
    for s, size in (("a", 300), ("b", 50), ("c", 40)):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) <= max(size, 0.0005 * mine[0]["target"])


def test_targets_stop_at_the_cap(spark):
    rows = [("a", 10), ("b", 1000), ("c", 1000), (None, 10), ("z", 0)]
    df = spark.createDataFrame(rows, "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(plain.targets({"a": 10, "b": 1000, "c": 1000, None: 10, "z": 0}))


# Pipeline -------------------------------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, sf_dir, tmp_path):
    """Each stage's rows against ``plain``; of the operators only the fitted model is taken over."""
    planted = [(10**6 + i, f"some words {i} here password = hunter{i}hunter and AKIA{'Q7' * 8} there " + f"filler{i} " * i, "en", "src1", 0) for i in range(9)]
    docs = table(spark, sf_dir, "documents")
    docs.unionByName(spark.createDataFrame(planted, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, sf_dir, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    sf_dir = str(tmp_path)
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]

    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    clean = stages["toxicity"](spark, docs, sf_dir).cache()
    assert clean.columns == columns
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect() if plain.score(model, r["text"]) < 0.3}

    apart = stages["near_duplicates"](spark, clean, sf_dir).cache()
    assert apart.columns == columns
    found = plain_components([(r["doc_id"], r["text"]) for r in clean.collect()])
    assert Counter(r["doc_id"] for r in apart.collect()) == Counter({least for _, least in found})

    safe = stages["secrets"](spark, apart, sf_dir).cache()
    assert safe.columns == columns
    want = {r["doc_id"]: r["text"] and plain.redacted(r["text"]) for r in apart.collect()}
    assert {r["doc_id"]: r["text"] for r in safe.collect()} == want and sum("[SECRET]" in (t or "") for t in want.values()) >= 9

    mixed = stages["mixing"](spark, safe, sf_dir).cache()
    assert mixed.columns == columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    sizes = {r["doc_id"]: (r["source"], words(r["text"])) for r in safe.collect()}
    sources = {}
    for id, (s, n) in sizes.items():
        sources.setdefault(s, []).append((n, copies[id]))
    target = plain.targets({s: sum(n for n, _ in x) for s, x in sources.items()})
    for s, x in sources.items():
        assert all(abs(c - r) < 1 + 1e-9 for (_, c), r in zip(x, plain.rates([n for n, _ in x], target[s]), strict=True))
        assert abs(sum(n * c for n, c in x) - target[s]) <= max(n for n, _ in x)

    check_packing(collect(stages["packing"](spark, mixed, sf_dir)), [(r["doc_id"], r["text"]) for r in mixed.collect()])
    rows = collect(corpus_pipeline.run(spark, sf_dir))
    check_packing(rows, [(r["doc_id"], r["text"]) for r in mixed.collect()])


def test_pipeline_odd_rows(spark, odd_docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd_docs, no_docs):
        step = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            step = stage(spark, step, str(tmp_path))
            assert step.columns == docs.columns
        corpus_pipeline.packing_stage(spark, step, str(tmp_path)).count()
