"""Near copies, repeats, neighbours and languages against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from helpers import documents, odd_documents
from pyspark.sql import functions as F
from stemledger.llm import cosine, langid, nearsets, repeats, shared, treesearch


def smallest_reachable(ids, pairs):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def shingle_set(text):
    words = text.encode().lower().split() if text else []
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else ({tuple(words)} if words else set())


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(30))
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            words = rng.choice(out).split()
            for _ in range(rng.randint(0, 1 + len(words) // 25)):
                if words:
                    words[rng.randrange(len(words))] = word()
            if rng.random() < 0.3:
                words += [word() for _ in range(rng.randint(1, 1 + len(words) // 6))]
        else:
            words = [word() for _ in range(rng.choice([1, 3, 5, 8, 30, 60, 200]))]
        text = rng.choice([" ", "\t", "\n "]).join(words)
        out.append(text.upper() if rng.random() < 0.1 else text)
        if rng.random() < 0.3:
            out.append(f"{passage} {' '.join(word() for _ in range(rng.randint(5, 40)))}")
    return out


@pytest.mark.parametrize("chunk, often", [(1024, 32), (7, 3)])
def test_jaccard_join(spark, monkeypatch, chunk, often):
    monkeypatch.setattr(nearsets, "CHUNK", chunk)
    texts = [*corpus(3), None, "", "  ", "one two", "ONE  two", "one two three"]
    sets = [shingle_set(t) for t in texts]
    pairs = [
        (a, b)
        for a in range(len(sets))
        for b in range(a)
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    low = smallest_reachable(range(len(texts)), pairs)
    rows = nearsets.classes(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), low[r["doc_id"]]), texts[r["doc_id"]]
    kept = nearsets.survivors(documents(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({low[i] for i in low})


def test_jaccard_odd_rows(spark):
    docs = odd_documents(spark)
    out = nearsets.classes(docs)
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in out.collect())
    assert [g for g in got if g[0] in (1, 2, 3)] == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert [g for g in got if g[0] in (5, 6)] == [(5, 1, 5), (5, 1, 5), (6, 1, 5)]
    assert nearsets.survivors(docs).columns == docs.columns
    assert nearsets.classes(docs.limit(0)).count() == 0


def removed(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in data for i in range(len(b) - 399))
    out = []
    for b in data:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most, suffixes, together", [(4000, 300_000, 1_000_000), (3, 500, 700), (1, 500, 1_000_000)])
def test_repeats(spark, monkeypatch, most, suffixes, together):
    monkeypatch.setattr(repeats, "FREQUENT", most)
    monkeypatch.setattr(repeats, "SUFFIXES_TOGETHER", suffixes)
    monkeypatch.setattr(repeats, "TOGETHER", together)
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefghij é\n") for _ in range(n))
    passages = [noise(n) for n in (100, 350, 380, 420, 900)]
    texts = []
    for _ in range(70):
        parts = [rng.choice([noise(rng.randint(0, 300)), rng.choice(passages), rng.choice(passages)[:370]]) for _ in range(rng.randint(0, 6))]
        texts.append("".join(parts))
    texts += [texts[3], texts[3], None, "", "x" * 399, "y" * 400, "z" * 700, "ab" * 500, noise(3000)[:1500] * 2]
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.digest(documents(spark, texts)).collect()}
    want = removed(texts)
    assert [got[i] for i in range(len(texts))] == want, (most, suffixes, together)
    assert sum(w[1] for w in want) > 5000


def test_repeats_odd_rows(spark):
    docs = odd_documents(spark)
    assert repeats.digest(docs).count() == docs.count()
    assert repeats.digest(docs.limit(0)).count() == 0


SKEW_SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "32",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "25KB",
}


def collected_with_skew(spark, make):
    """(rows, final plan) of a frame that is made and collected with SKEW_SETTINGS."""
    before = {k: spark.conf.get(k, None) for k in SKEW_SETTINGS}
    for key, value in SKEW_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        df = make()
        rows = df.collect()
        return rows, df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_repeats_split_a_passage_of_many_texts(spark):
    rng = random.Random(23)
    noise = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage, ends = noise(1200), [noise(30) for _ in range(60)]
    docs = documents(spark, [a + passage + b for a in ends for b in ends])
    rows, plan = collected_with_skew(spark, lambda: repeats.spans(docs))
    assert len(rows) == 3600
    for r in rows:  # each end stands in 60 texts beside the passage
        assert {i for s in r["spans"] for i in range(s["start"], s["end"])} == set(range(1260))
    assert "SortMergeJoin(skew=true)" in plan


@pytest.mark.parametrize("sorted_too", [False, True])
def test_repeats_split_a_slice_of_many_segments(spark, sorted_too):
    slices = spark.range(40_000, numPartitions=8).selectExpr(
        "unhex(md5(string(id))) AS segment", "unhex(md5(string(IF(id % 2 = 0, 0, id)))) AS slice",
        "smallint(7) AS ahead", "smallint(5) AS back",
    )
    one = slices.filter("slice = unhex(md5('1'))").selectExpr("slice AS segment", "9 AS far", "3 AS near")
    rows, plan = collected_with_skew(spark, lambda: repeats._met_again(slices, repeats._widest(one) if sorted_too else None))
    assert sorted((r["far"], r["near"]) for r in rows) == [(7, 5)] * 20_000 + [(9, 3)] * sorted_too
    assert len({r["segment"] for r in rows}) == len(rows)
    assert "SortMergeJoin(skew=true)" in plan


VECTORS = "vec_id long, embedding array<double>, label int, copies long, cell int, leaf int"


def vectors(spark, seed=2, n=300, dim=12):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i and rng.random() < 0.7:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(size=dim) * rng.choice([0, 0.1, 0.25])
            v *= rng.choice([0.1, 1, 7])
        else:
            v = rng.normal(size=dim)
        rows.append((i, v.tolist()))
    odd = [(n, None), (n + 1, [0.0] * dim), (n + 2, [float("nan")] * dim), (n + 3, [None] + [1.0] * (dim - 1)), (n + 4, []),
           (n + 5, [float("inf")] + [1.0] * (dim - 1)), (n + 6, rows[0][1][:5]), (None, rows[0][1]), (7, rows[7][1])]
    frame = spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows + odd], VECTORS)
    return rows, odd, frame


@pytest.mark.parametrize("cell, block", [(4096, 4096), (40, 4096), (40, 13)])
def test_cosine_links(spark, monkeypatch, cell, block):
    monkeypatch.setattr(cosine, "CELL", cell)
    monkeypatch.setattr(cosine, "BLOCK", block)
    rows, odd, frame = vectors(spark)
    x = np.array([v for _, v in rows])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    low = smallest_reachable(range(len(rows)), list(zip(*(a.tolist() for a in np.nonzero(hit)), strict=True)))
    got = cosine.links(frame).collect()
    assert len(got) == len(rows) + len(odd)
    twin = hit[7] | (np.arange(len(rows)) == 7)  # row 7 is there twice, and its copy counts
    for r in got:
        i = r["vec_id"]
        if i is not None and i < len(rows):
            assert r["n_links"] == hit[i].sum() + twin[i], i
            assert r["component_id"] == low[i] and r["kept"] == (low[i] == i)
        elif i is not None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, i, True)
    assert cosine.links(frame.limit(0)).count() == 0


def test_cosine_moves_vectors_to_tasks_in_one_shuffle(spark, monkeypatch):
    monkeypatch.setattr(cosine, "CELL", 40)
    monkeypatch.setattr(cosine, "BLOCK", 13)
    plans = {}

    def staged(df, name, **options):
        out = shared.staged(df, name, **options)
        plans[name] = (df._jdf.queryExecution().executedPlan().toString(), df.schema, out)
        return out

    monkeypatch.setattr(cosine, "staged", staged)
    _, _, frame = vectors(spark)
    cosine.links(frame.withColumn("embedding", F.col("embedding").cast("array<float>"))).count()
    below = plans["cosine-links"][0].split("Initial Plan")[-1].split("FlatMapGroupsInArrow")[1]
    assert len(re.findall(r"\bExchange ", below)) == 1 and "Join" not in below
    alone = plans["cells"][0].split("LeftAnti")[1].split("Scan ")[0]
    assert "Exchange" not in alone  # vectors without copies are not moved
    assert "array_join" not in plans["vector-keys"][0]  # numbers are not written out to be compared
    assert plans["cells"][1]["embedding"].dataType.simpleString() == "array<float>"  # floats are not moved as doubles


def test_cosine_sends_stars():
    rng = np.random.default_rng(6)
    ids = rng.permutation(5000)[:400] * 3
    pairs = rng.integers(0, 400, (330, 2))
    forest = cosine._Forest(400)
    for some in np.array_split(pairs, 12):
        forest.add(some[:, 0], some[:, 1])
    low = smallest_reachable(ids.tolist(), ids[pairs].tolist())
    assert dict(zip(*(x.tolist() for x in forest.stars(ids)), strict=True)) == {i: m for i, m in low.items() if i != m}


def test_cosine_shelves():
    laid = cosine._shelves([(64, 0, 20_000), (64, 1, 20_000), (64, 3, 90_000), (64, 4, 5), (8, 0, 10)])
    assert [a.tolist() for a in laid[8]] == [[0], [1]]
    assert [a.tolist() for a in laid[64]] == [[1, 4, 0, 7, 18], [3, 3, 0, 11, 1]]  # 8,192 vectors per shelf
    packed = cosine._shelves([(64, cell, 4000) for cell in range(150)])[64]
    assert packed[1].tolist() == [1] * 150 and np.bincount(packed[0]).tolist() == [9] * 16 + [6]
    for dim, most in ((64, 62_500), (1536, 2604)):  # shelves do not grow with the table or the length of vectors
        first, cut = cosine._shelves([(dim, cell, 4000) for cell in range(512)] + [(dim, 512, 1_000_000)])[dim]
        assert cut[512] == -(-1_000_000 // most) and np.bincount(first[:512]).max() * 4000 / cut[0] <= most + 2000
    assert cosine._shelves([]) == {}


def test_cosine_products_end_where_borders_are_too_far():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 12))
    x[1500:1600] = x[:100] + rng.normal(size=(100, 12)) * 0.3
    x /= np.linalg.norm(x, axis=1)[:, None]
    across = rng.normal(size=12)
    x = np.concatenate([x[x @ across < 0], x[x @ across >= 0]])
    left = slice(0, int((x @ across < 0).sum()))
    right = slice(left.stop, len(x))
    products = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            products.append(self.shape[0] * other.shape[1])
            return np.asarray(self) @ np.asarray(other)

    found = cosine._linked(x, cosine._bounds(x).view(Counted), left, right, across, 0.9, math.sqrt(0.2))
    got = {(i, j) for a, b in found for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(i, j + left.stop) for i, j in np.argwhere(x[left] @ x[right].T >= 0.9).tolist()} and got
    assert sum(products) < 0.75 * len(x[left]) * len(x[right])


@pytest.mark.parametrize("spread", [1, 0.2, 0])
def test_cosine_bounds_lose_no_link(monkeypatch, spread):
    monkeypatch.setattr(cosine, "STRIP", 16)
    monkeypatch.setattr(cosine, "BLOCK", 50)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 24))
    x[300:] = x[:300] + rng.normal(size=(300, 24)) * rng.choice([0, 0.1, 0.5], (300, 1))
    x[:, :12] *= spread  # without a first half bounds are of no use
    x /= np.linalg.norm(x, axis=1)[:, None]
    bounds = cosine._bounds(x)
    assert bounds.shape == (600, 13) and (bounds @ bounds.T >= x @ x.T - 1e-6).all()
    hit = np.argwhere(np.triu(x @ x.T >= 0.9, 1)).tolist()
    for left, right in ((slice(0, 600), slice(0, 600)), (slice(0, 300), slice(300, 600))):
        found = cosine._linked(x, bounds, left, right, np.zeros(24), 0.9, math.sqrt(0.2))
        got = sorted([min(i, j), max(i, j)] for a, b in found for i, j in zip(a.tolist(), b.tolist(), strict=True))
        assert got == [p for p in hit if left == right or p[0] < 300 <= p[1]]


@pytest.mark.parametrize("block", [4096, 30])
def test_cosine_decides_in_double_precision(spark, monkeypatch, block):
    monkeypatch.setattr(cosine, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows, links = [], []
    for step in np.arange(-60, 60) + 0.5:  # cosines to the first vector of 0.9 and up to 60 times 2e-9 less or more, beyond single precision
        a, b = np.linalg.qr(rng.normal(size=(48, 2)))[0].T
        cos = 0.9 + step * 2e-9
        rows += [a, cos * a + math.sqrt(1 - cos * cos) * b]
        links += [int(step > 0)] * 2
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in cosine.links(frame).collect()}
    assert [got[i] for i in range(len(rows))] == links


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(treesearch, "ROWS_TOGETHER", 100)
    rows, odd, frame = vectors(spark, n=500)
    got = treesearch.search(frame, frame.filter("vec_id % 20 = 0"), recall=1.0).collect()
    x = np.array([v for _, v in rows])
    for q in range(0, 500, 20):
        score = (x[q] * x).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(500), -score)) if i != q][:20]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 21))
        assert len({m[1] for m in mine} & set(best)) >= 18
        assert all(s == score[v] for _, v, s in mine)
    few = treesearch.search(frame.filter("vec_id < 5"), frame.filter("vec_id = 0"), k=20).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
    assert treesearch.search(frame.limit(0), frame).count() == 0


def test_neighbours_of_every_length_and_of_few_rows_a_leaf(spark, monkeypatch):
    monkeypatch.setattr(treesearch, "ROWS_TOGETHER", 100)
    monkeypatch.setattr(treesearch, "QUERIES_TOGETHER", 7)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4 if i % 3 else 6)]) for i in range(600)]
    rows += [(1000 + i, [1.0, 2.0]) for i in range(3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = treesearch.search(frame, frame.filter("vec_id % 20 = 0"), k=20, recall=0.01).collect()
    ranks = {}
    for r in got:
        ranks.setdefault(r["query_id"], []).append(r["rank"])
    for q in [*range(0, 600, 20), 1000]:
        assert sorted(ranks[q]) == list(range(1, 3 if q == 1000 else 21)), q


def test_a_tree_has_no_empty_leaf_and_a_walk_widens():
    x = np.concatenate([np.ones((300, 3)), np.random.default_rng(1).normal(size=(60, 3))])
    tree = treesearch.build(x)
    held = np.bincount(tree.place(x), minlength=tree.leaves)
    assert tree.leaves > 1 and held.all()
    for q in x[::7]:
        visited = tree.order(q, 1, held, 50)
        assert held[visited].sum() >= 50 > held[visited[:-1]].sum()


def test_languages(spark):
    words = {"en": "the of and to in that", "de": "der die und ist nicht über", "ru": "и не на что это как"}
    rng = random.Random(4)
    make = lambda lang, n: " ".join(rng.choice(words[lang].split()) for _ in range(n))
    rows = [(i, make(lang, rng.randint(1, 60)), lang, "s", 0) for i in range(120) for lang in [list(words)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert all(got[r[0]]["lang_pred"] == r[2] for r in rows)
    both = f"{make('en', 30)}. {make('de', 20)}"
    lang, score, spans = langid.label([both], model)[0]
    assert lang == "en" and [s[2] for s in spans] == ["en", "de"]
    assert abs(spans[1][0] - both.index(". ")) <= 12 and spans[-1][1] == len(both)
    assert langid.label([None, "", "12 + 3", "日本"], model)[:3] == [("und", 0.0, [])] * 3
    odd = odd_documents(spark)
    assert langid.identify(odd, model).count() == odd.count()
    kept = langid.accepted(odd, model)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 4, 5, 5, 6, 7]
    assert langid.identify(odd.limit(0), model).count() == 0
    assert langid.identify(odd, langid.train(odd.limit(0))).filter("lang_pred = 'und'").count() == odd.count()


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    length = np.array([0, 1, 5, 3, 6])
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    scores = rng.normal(size=(length.sum(), 3)).astype(np.float32) * 3
    path = langid._viterbi(scores, first, length, 2.0)
    for f, n in zip(first, length, strict=True):
        if n:
            value = lambda p: sum(scores[f + t, c] for t, c in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: E731, B023
            best = max(value(p) for p in np.ndindex(*[3] * n))
            assert abs(value(path[f : f + n]) - best) < 1e-4


def test_a_word_needs_a_letter(spark):
    rows = [(i, text, lang, "s", 0) for i in range(60) for text, lang in [("the of and", "en"), ("der und nicht", "de")]]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    marks = ["12 \u2764\ufe0f 7", "\u0301", "1\ufe0f\u20e3", "\u0301the\u0301 of\ufe0f and"]
    found = langid.label(marks, model)
    assert found[:3] == [("und", 0.0, [])] * 3
    assert found[3][0] == "en" and found[3][2] == [(1, len(marks[3]), "en")]
    docs = documents(spark, marks)
    assert [r["text"] for r in langid.accepted(docs, model).collect()] == marks[3:]


def test_a_pack_sends_one_place_per_shared_shingle():
    tokens = np.array([(5, d, 50) for d in range(50)], dtype=nearsets.COUNTED)
    sizes, rids = np.ones(50, dtype=np.int64), np.arange(100, 150, dtype=np.int64)
    none = np.zeros(0, dtype=nearsets.TOKEN).tobytes()
    group = pd.DataFrame(
        [("p", none, rids.tobytes(), sizes.tobytes()), ("p", tokens.tobytes(), None, None)],
        columns=["pack", "tokens", "rids", "sizes"],
    )
    out = nearsets._sift(4)(group)
    places = np.concatenate([np.frombuffer(p, dtype=nearsets.PLACE) for p in out["places"].dropna()])
    assert places.tolist() == [(5, 100)]
    tied = out[out["a"].notna()]
    assert set(zip(tied["a"], tied["b"], strict=True)) == {(d, 100) for d in range(101, 150)}
