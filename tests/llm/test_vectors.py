"""Operators on vectors and URLs, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from greffe.llm import neighbours, semantic, urls

from . import brute


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(400, 16))
    near = rows[0] + 0.05 * rng.normal(size=(60, 16))
    chain = [rows[1]]
    for _ in range(10):
        chain.append(chain[-1] + 0.25 * rng.normal(size=16))
    every = np.vstack([rows, near, chain, np.repeat(rows[5:6], 9, axis=0), rows[6:7] * 4]).astype(np.float32).astype(float)
    ids = (np.arange(len(every)) * 5).tolist()
    bad = [(100_001, None), (100_002, []), (100_003, [0.0] * 16), (100_004, [1.0, None] + [0.0] * 14), (100_005, [float("nan")] * 16), (100_006, [float("inf")] * 16), (100_007, [1.0] * 3), (None, [1.0] * 16), (100_050, None)]
    table = spark.createDataFrame([(i, v.tolist(), 1, "x", 2.0) for i, v in zip(ids, every)] + [(i, v, 0, "x", 2.0) for i, v in bad], "vec_id long, embedding array<double>, label int, node string, score double")
    return ids, every, bad, table.repartition(3)


def test_cosine_links(vectors, monkeypatch):
    ids, rows, bad, table = vectors
    monkeypatch.setattr(semantic, "CELL_SIZE", 20)
    monkeypatch.setattr(semantic, "BLOCK", 16)
    found = semantic.near_duplicates(table).collect()
    expected = brute.cosine_links(ids, rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in found if r.vec_id in expected} == expected
    assert len(found) == table.count()
    for r in found:
        if r.vec_id not in expected:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)


def test_cosine_links_of_nothing(vectors):
    *_, table = vectors
    assert semantic.near_duplicates(table.limit(0)).collect() == []
    assert {r.n_links for r in semantic.near_duplicates(table.where("vec_id > 100000")).collect()} == {0}


def mixed_lengths(spark):
    """Vectors of three lengths, of which the most frequent one is not alone, and repeated ids with different vectors."""
    rng = np.random.default_rng(12)
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0]), (5, [1.0, 0.01]), (6, [3.0])]
    for n, many in ((4, 300), (5, 200)):
        base = rng.normal(size=(many // 4, n))
        rows += [(1000 * n + i, (base[i % len(base)] + 0.05 * rng.normal(size=n)).tolist()) for i in range(many)]
    rows += [(1, [0.0, 1.0, 0.1]), (4000, rows[-1][1]), (4000, rows[10][1])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def plain_cosine(a, b):
    return float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))


def test_cosine_links_of_mixed_lengths(spark, monkeypatch):
    monkeypatch.setattr(semantic, "CELL_SIZE", 20)
    monkeypatch.setattr(semantic, "BLOCK", 16)
    rows, table = mixed_lengths(spark)
    links = [(a, b) for a in range(len(rows)) for b in range(a) if len(rows[a][1]) == len(rows[b][1]) and plain_cosine(rows[a][1], rows[b][1]) >= 0.95]
    root = brute.roots(sorted({i for i, _ in rows}), [(rows[a][0], rows[b][0]) for a, b in links])
    counts = {i: sum(rows[x][0] == i for link in links for x in link) for i, _ in rows}
    found = semantic.near_duplicates(table).collect()
    assert len(found) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {i: (counts[i], root[i]) for i, _ in rows}
    assert counts[0] == 2 and counts[2] == 1


def test_neighbours_of_mixed_lengths_and_repeated_ids(spark):
    rows, table = mixed_lengths(spark)
    wanted = {}
    for i, v in rows:
        if i in (1, 5, 4000):
            near = sorted(((-plain_cosine(v, w), j) for j, w in rows if len(w) == len(v) and (j, w) != (i, v)), key=lambda x: (round(x[0], 12), x[1]))[:5]
            wanted.setdefault(i, []).extend((k + 1, j, pytest.approx(-s, abs=1e-12)) for k, (s, j) in enumerate(near))
    found = {}
    for r in neighbours.nearest(table, F.col("vec_id").isin(1, 5, 4000)).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    order = lambda rows: sorted(rows, key=lambda x: (x[0], x[1]))
    assert {i: order(x) for i, x in found.items()} == {i: order(x) for i, x in wanted.items()}
    few = spark.createDataFrame([(1, [1.0, 0.0, 0.1]), (1, [0.0, 1.0, 0.1]), (2, [0.0, 1.0, 0.1]), (50, [1.0, 0.0, 0.1])], "vec_id long, embedding array<double>")
    got = {(r.vec_id, round(r.score, 4)) for r in neighbours.nearest(few, F.col("vec_id") == 50).collect()}
    assert got == {(1, 1.0), (1, 0.0099), (2, 0.0099)}


def test_neighbours(vectors):
    ids, rows, bad, table = vectors
    twice = table.unionByName(table.where("vec_id in (0, 5)"))
    found = {}
    for r in neighbours.nearest(twice, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    hits = total = 0
    assert set(found) == {i for i in ids if i % 50 == 0}
    for k, i in enumerate(ids):
        if i % 50 == 0:
            score = x @ x[k]
            score[k] = -2
            order = np.lexsort((ids, -score.round(12)))[:5]
            own = sorted(found[i])
            assert [r for r, *_ in own] == [1, 2, 3, 4, 5]
            assert all(s == pytest.approx(score[ids.index(v)], abs=1e-12) for _, v, s in own)
            hits += len({ids[o] for o in order} & {v for _, v, _ in own})
            total += 5
    assert hits / total >= 0.95


def test_neighbours_in_a_tight_group(spark):
    """Many near copies of one vector, closer to each other than small codes can tell."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=64)
    rows = np.vstack([base + 0.004 * np.linalg.norm(base) * rng.normal(size=(600, 64)), rng.normal(size=(600, 64))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(3)
    found = {}
    for r in neighbours.nearest(table, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    x = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = x @ x.T
    np.fill_diagonal(near, -2)
    hits = sum(len(found[q] & set(np.argsort(-near[q])[:5].tolist())) for q in range(0, 600, 20))
    assert hits / (5 * 30) >= 0.95


def test_neighbours_of_few(vectors, spark):
    *_, table = vectors
    few = table.where("vec_id in (0, 5, 10)")
    rows = neighbours.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()
    assert sorted(r.vec_id for r in rows) == [5, 10] and [r["rank"] for r in rows] == [1, 2]
    assert neighbours.nearest(table.limit(0), F.col("vec_id") == 0).collect() == []
    copies = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in neighbours.nearest(copies, F.col("vec_id") == 2).orderBy("rank").collect()] == [0, 1, 3, 4, 5]


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = rest[:cut].translate(brute.LOWER)
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]


def plain_rule(host, path):
    best = None
    for kind, text in urls.LISTED:
        own, _, rest = text.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[1])):
            best = kind, text
    return best


def plain_rules(baskets, min_support, min_confidence, min_lift):
    """Rules from (tokens, label) by counting every combination: (antecedent, verdict) -> (confidence, support)."""
    from collections import Counter
    from itertools import combinations

    baskets = [b for b in baskets if b[0]]
    freq = Counter(t for tokens, _ in baskets for t in tokens)
    often = {t: n for t, n in freq.items() if n >= min_support * len(baskets)}
    where = {t: frozenset(tokens for tokens, _ in baskets if t in tokens) for t in often}
    item = {t: min(u for u in often if where[u] == where[t]) for t in often}
    whole, of_label, joint = Counter(), Counter(label for _, label in baskets), Counter()
    for tokens, label in baskets:
        items = sorted({item[t] for t in tokens if t in often}, key=lambda t: (-often[t], t))[: urls.MOST_ITEMS]
        for n in range(1, urls.LONGEST + 1):
            for some in combinations(sorted(items), n):
                whole[some] += 1
                joint[some, label] += 1
    out = {}
    for (some, label), n in joint.items():
        confidence = n / whole[some]
        if n >= min_support * len(baskets) and confidence >= min_confidence and confidence / (of_label[label] / len(baskets)) >= min_lift:
            out[some, label] = (confidence, n / len(baskets))
    return out


def best_of(rules, tokens):
    fits = [(some, label, c, s) for (some, label), (c, s) in rules.items() if set(some) <= tokens]
    return min(fits, key=lambda m: (-m[2], -m[3], -len(m[0]), " ".join(m[0]), m[1]), default=None)


def test_urls(spark):
    given = ["http://A.Example.com/en/1", "https://www.example.com/en/x?q=1#t", "http://example.com", "http://example.com/", "ftp://b.net/es/2", "b.net/fr/", None, "", "http://net/fr/", "http://x.net/fr", "http://ÉA.org/?a=1", "x\ny://h.com/en/", "a://b://c/d", "http://com/"]
    given += [f"http://{'ads' if i % 2 else 'news'}.site.org/{'promo' if i % 3 == 0 else 'story'}/{i}" for i in range(300)]
    given += [f"http://{'www.' * (i % 2)}h{i % 9}.{('example.com', 'net', 'other.org')[i % 3]}/{('en', 'fr', 'es', 'de')[i % 4]}/{i}{'?utm=1' * (i % 5 == 0)}" for i in range(600)]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(given)] + [(0, given[0], "x", "y"), (None, None, None, None)], "page_id long, url string, tokens string, verdict string")
    labels = spark.createDataFrame([(i, None if i % 10 == 0 else "block" if i % 2 and i % 3 == 2 else "allow") for i in range(14, 314)], "page_id long, label string")
    tokens = {r.page_id: frozenset(r.tokens) for r in pages.select("page_id", urls.tokens_of(pages.url, urls.host_of(pages.url), urls.path_of(pages.url)).alias("tokens")).collect()}
    rows = [(i, plain_url(u)) for i, u in enumerate([*given, given[0]])]
    listed = [plain_rule(*x) for _, x in rows]
    taught = [(tokens[i % len(given)], x[0]) for (i, _), x in zip(rows, listed) if x]
    known = [(tokens[r.page_id], r.label) for r in labels.collect() if r.label]
    least = dict(min_support=0.02, min_confidence=0.7, min_lift=1.1)
    for own, baskets in ((None, taught), (labels, known)):
        rules = plain_rules(baskets, **least)
        assert rules
        found = urls.judge(pages, own, **least).collect()
        assert len(found) == len(given) + 2
        for r in found:
            if r.page_id is None:
                assert (r.host, r.path, r.rule, r.verdict) == ("", "", None, "allow")
                continue
            host, path = plain_url(given[r.page_id])
            assert (r.host, r.path) == (host, path)
            rule = plain_rule(host, path)
            best = None if rule else best_of(rules, tokens[r.page_id])
            assert (r.verdict, r.rule) == (rule or (best[1] if best else "allow", None))
            assert r.mined_rule == (" ".join(best[0]) if best else None)
        assert {"block", "allow"} <= {r.verdict for r in found if r.mined_rule} or own is not None
    assert urls.judge(pages.limit(0)).collect() == urls.judge(pages.limit(0), labels).collect() == []
    assert {r.verdict for r in urls.judge(pages, labels.limit(0)).where("rule is null").collect()} == {"allow"}


def test_url_families_with_much_in_common(spark):
    """Forty parts that always occur together would have 2 ^ 40 frequent subsets; they are one item."""
    common = "/".join(f"part{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.org/{common}/{i}") for i in range(60)], "page_id long, url string")
    labels = pages.selectExpr("page_id", "if(page_id % 2 = 1, 'block', 'allow') as label").where("page_id < 40")
    assert {(r.page_id % 2, r.verdict) for r in urls.judge(pages, labels).collect()} == {(1, "block"), (0, "allow")}


def test_urls_of_many_parts(spark, monkeypatch):
    """Rules hold items that are not among a basket's most frequent ones; baskets of both kinds count."""
    import random

    chance = random.Random(5)
    urls_ = [f"http://h.org/{'/'.join(chr(97 + k) * 3 for k in range(20) if chance.random() < 0.7 - k / 60)}/x" for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    labels = spark.createDataFrame([(i, "block" if "/ttt" in u and "/sss" in u or i % 17 == 0 else "allow") for i, u in enumerate(urls_) if i % 4], "page_id long, label string")
    tokens = {r.page_id: frozenset(r.tokens) for r in pages.select("page_id", urls.tokens_of(pages.url, urls.host_of(pages.url), urls.path_of(pages.url)).alias("tokens")).collect()}
    sizes = [len(tokens[i]) - 3 for i in tokens]
    assert min(sizes) < urls.MOST_ITEMS < max(sizes)
    known = [(tokens[r.page_id], r.label) for r in labels.collect()]
    found = urls.judge(pages, labels).collect()
    monkeypatch.setattr(urls, "MOST_ITEMS", 99)  # of the plain count
    rules = plain_rules(known, 0.01, 0.8, 1.2)
    for r in found:
        best = best_of(rules, tokens[r.page_id])
        assert (r.verdict, r.mined_rule) == ((best[1], " ".join(best[0])) if best else ("allow", None))
    assert any("sss" in r.mined_rule and "ttt" in r.mined_rule for r in found if r.mined_rule and r.verdict == "block")
