"""Jaccard join, vector links, line dedup, decontamination: against brute force, and edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoresieve.llm import decontam, graph, jaccard, lines, skew, vectors


def least_labels(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, k):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def edited(rng, text, words, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(words)
    return " ".join(w)


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_jaccard_matches_brute_force(spark, docs_of, words, k, num, den):
    rng = random.Random(k)
    texts = []
    for size in (4, 12, 30, 90, 300, 1200):
        base = " ".join(rng.choices(words, k=size))
        texts += [base, base.upper(), *(edited(rng, base, words, rng.randint(0, max(1, size // 60))) for _ in range(14))]
        texts += [base + " " + " ".join(rng.choices(words, k=rng.randint(0, max(1, size // 12)))) for _ in range(6)]
        texts += [" ".join(rng.choices(words, k=size)) for _ in range(4)]
    texts += ["", None, " \t\n", "one", "ONE", "one two", "one  two", "x" * 3000]
    got = {r["doc_id"]: r for r in jaccard.similar_documents(docs_of(texts), k, num, den).collect()}
    sets = [shingles(t, k) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    assert len(links) > 100
    want = least_labels(range(len(texts)), links)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}


def test_jaccard_edge_cases(spark, docs_of):
    assert jaccard.similar_documents(docs_of([])).count() == 0
    same = "a b c d e f g h"
    rows = [(5, same), (5, same), (None, same), (2, same), (9, "other words are here now"), (9, same)]
    got = jaccard.similar_documents(docs_of(rows)).collect()
    assert len(got) == 6
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(5, 2), (2, 2), (None, None), (9, 2)}
    kept = jaccard.one_of_each(docs_of(rows))
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 2), (True, None)]
    assert "component_id" in kept.columns


def test_jaccard_ids_with_two_texts(spark, docs_of, words):
    rng = random.Random(7)
    one, two = (" ".join(rng.choices(words, k=n)) for n in (80, 200))
    rows = [(3, one), (3, two), (8, edited(rng, two, words, 1)), (7, edited(rng, one, words, 1)), (5, " ".join(rng.choices(words, k=90)))]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.similar_documents(docs_of(rows), 3, 80, 100).collect()}
    assert got == {(3, 3), (8, 3), (7, 3), (5, 5)}


def test_one_of_each_keeps_repeated_rows_once(spark, docs_of):
    rows = [(1, "a b c d e f")] * 3 + [(2, "A b c d e f"), (3, "x y z one two three"), (3, "x y z one two three"), (3, "quite another text is this"), (4, None), (4, None), (5, "")]
    kept = jaccard.one_of_each(docs_of(rows).withColumns({x: F.lit(1) for x in ("dropped", "repeated", "text_hash")}))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, "a b c d e f"), (3, "x y z one two three"), (3, "quite another text is this"), (4, None), (5, "")], key=str)
    assert "text_hash" in kept.columns


def test_large_buckets_and_hot_keys(spark, docs_of, words, monkeypatch):
    """Tiles and the ways around hot keys give the same components."""
    monkeypatch.setattr(jaccard, "TILE", 3)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 2)
    monkeypatch.setattr(jaccard, "MEMBERS", 4)
    rng = random.Random(21)
    base = " ".join(rng.choices(words, k=40))
    texts = [edited(rng, base, words, rng.randint(0, 4)) for _ in range(60)] + [base] * 5 + [" ".join(rng.choices(words, k=40)) for _ in range(10)]
    sets = [shingles(t, 3) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(docs_of(texts), 3, 80, 100).collect()}
    assert links and got == least_labels(range(len(texts)), links)


def test_join_of_unequal_keys(spark):
    from scoresieve.llm.skew import HOT_SHARE, joined

    left = spark.range(20_000).selectExpr("id", "if(id % 3 = 0, 0, id) AS k")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = joined(left, right, ["k"], 20_000, "n")
    assert HOT_SHARE > 100 and got.count() == 20_000 and got.where("k = 0 and n != 6667").count() == 0


def test_sketches_never_miss():
    """Sets at the very edge of similarity share a published block, whatever their sizes."""
    rng = np.random.default_rng(0)
    for num, den in ((90, 100), (8, 10)):
        bands = jaccard.Bands(num, den)
        for n in [*range(1, 60), 100, 333, 1000, 3000]:
            a = rng.integers(1, 2**62, n, dtype=np.uint64)
            for gone in range(n + 1):  # the most that may go or come
                if den * (n - gone) < num * n:
                    break
            gone = max(0, gone - 1)
            assert set(bands.keys(a)) & set(bands.keys(a[gone:])), n
            apart = bands.most_apart(2 * n) // 2
            b = np.r_[a[apart:], rng.integers(1, 2**62, apart, dtype=np.uint64)]
            assert set(bands.keys(a)) & set(bands.keys(b)), n


def test_sketches_have_more_blocks_than_differences():
    """The pigeonhole guarantee holds in every band: after the most differences a block that either set publishes still agrees."""
    rng = np.random.default_rng(5)
    for num, den in ((90, 100), (8, 10)):
        bands = jaccard.Bands(num, den)
        for band in range(30):
            d, m = bands.blocks(band)[:2]
            assert m > d
        for n in (200, 450, 2000):
            published = len(bands.keys(rng.integers(1, 2**62, n, dtype=np.uint64)))
            assert published >= sum(bands.blocks(b)[0] + 1 for b in bands.joined(n))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(900, i) for i in range(800, 860)] + [(5, 5)]
    frame = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r["id"]: r["component_id"] for r in graph.components(frame).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {n: c for n, c in least_labels({x for e in links for x in e}, links).items() if n in nodes}
    assert graph.components(frame.limit(0)).count() == 0


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 32))
    rows = [b + rng.standard_normal(32) * s for b in base for s in (0, 0.05, 0.2, 0.33)]
    rows += [base[0], base[0] * 3, -base[0]]
    data = [(i, [float(x) for x in r]) for i, r in enumerate(rows)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 32), (1003, [float("nan")] + [1.0] * 31), (1004, [None] + [1.0] * 31), (1005, [float("inf")] + [1.0] * 31), (1006, [1.0, 2.0]), (1007, [1e-200] * 32), (None, data[0][1])]
    for kind in ("double", "float"):
        frame = spark.createDataFrame(data + odd, f"vec_id long, embedding array<{kind}>").withColumns({"id": F.lit(1), "v": F.lit(2), "copies": F.lit(3)})
        got = {r["vec_id"]: r for r in vectors.near_vectors(frame).collect()}
        x = np.array(rows).astype(np.float32 if kind == "float" else float).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= 0.9
        np.fill_diagonal(near, False)
        want = near.sum(1)
        found = np.array([got[i]["n_links"] for i in range(len(rows))])
        assert (found <= want).all() and found.sum() >= 0.99 * want.sum()
        # A missed link may only split a component if it is the only one between two parts.
        labels = {i: got[i]["component_id"] for i in range(len(rows))}
        want_labels = least_labels(range(len(rows)), list(zip(*np.nonzero(near), strict=True)))
        assert all(want_labels[c] == want_labels[i] for i, c in labels.items()) and sum(labels[i] != want_labels[i] for i in labels) <= want.sum() - found.sum()
        assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (*range(1000, 1007),))
        assert got[None]["n_links"] == 0 and got[None]["component_id"] is None
        assert len(got) == len(rows) + 9
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_vectors_with_repeated_ids(spark):
    """Counts are by row and its own vector; rows that share an id share a component."""
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.01]), (7, [0.0, 1.0]), (5, [1.0, 0.0]), (3, [0.01, 1.0]), (9, [-1.0, 0.0]), (7, [-1.0, 0.001])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(3, 1, 3), (5, 2, 5), (5, 2, 5), (5, 2, 5), (7, 1, 3), (7, 1, 3), (9, 1, 3)]


def test_vectors_at_the_threshold(spark):
    """A cosine of exactly the threshold links; the next one below does not; very long vectors go too."""
    rows = [(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 5.0])] + [(10 + i, [1.0 + (j == i) for j in range(500)]) for i in range(2)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold=0.8).collect()}
    assert got == {0: (0, 0), 1: (1, 1), 2: (1, 1), 10: (1, 10), 11: (1, 10)}


def test_vectors_large_bucket_is_tiled(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 16)
    rng = np.random.default_rng(5)
    rows = rng.standard_normal(24) + 0.02 * rng.standard_normal((150, 24))
    frame = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    got = vectors.near_vectors(frame).collect()
    assert {r["n_links"] for r in got} == {149} and {r["component_id"] for r in got} == {0}


def test_estimates_from_bits_are_unbiased_and_bounded():
    """Four bits a component keep the estimate unbiased, and hardly any error exceeds the bound."""
    rng = np.random.default_rng(9)
    a = rng.standard_normal((3000, 64))
    b = a + 0.48 * rng.standard_normal((3000, 64))
    unit = np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b)])
    _, signs, planes, numbers = vectors.sketch(unit, 8, 4)
    i = np.arange(3000)
    error = vectors.estimates(signs[i], numbers[i], planes[i + 3000], numbers[i + 3000]) - np.einsum("ij,ij->i", unit[i], unit[i + 3000])
    spread = vectors.spread_of(numbers[i], 64, numbers[i + 3000, 2], 0.9)
    assert abs(error.mean()) < 4 * error.std() / np.sqrt(3000) and (np.abs(error) < vectors.SIGMAS * spread).mean() > 0.999 and spread.mean() < 2 * error.std()


def test_estimates_are_unbiased():
    rng = np.random.default_rng(8)
    a = rng.standard_normal(48)
    b = a + 0.6 * rng.standard_normal(48)
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    found = []
    for r in range(600):
        p = vectors.rotation(48, r)
        x = np.sign(p @ a)
        found.append(x @ (p @ b) / np.abs(p @ a).sum())
    assert abs(np.mean(found) - a @ b) < 4 * np.std(found) / np.sqrt(len(found))


# ---- lines


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip("\x20\x09\x0a\x0b\x0c\x0d"))


def brute_lines(rows, min_docs):
    seen = {}
    for i, t in rows:
        for x in set(map(line_key, (t or "").split("\n"))):
            seen.setdefault(x, set()).add(i)
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not line_key(x) or len(seen[line_key(x)]) < min_docs]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_match_brute_force(spark, docs_of):
    rng = random.Random(4)
    pool = [f"Line {i} é" for i in range(60)] + ["", "   ", " x", "ROLL over"]
    rows = [(i, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str])(rng.choice(pool[: rng.choice([3, 20, 64])])) for _ in range(rng.randint(0, 9)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "Line 0 é"), (202, "Line 0 é"), (203, "\n".join(["Line 1 é"] * 5000) + "\nend"), (204, "x" * 300_000)]
    frame = docs_of(rows)
    got = lines.without_common_lines(frame, min_docs=10)
    assert set(frame.columns) < set(got.columns)
    rows_got = sorted(((r["doc_id"], r["line_dedup"]["n_lines"], r["line_dedup"]["n_dropped"], r["line_dedup"]["text"]) for r in got.collect()), key=str)
    assert rows_got == brute_lines(rows, 10)


def test_lines_keep_first(spark, docs_of):
    rows = [(i, f"own {i}\nshared\nshared") for i in range(40)]
    got = {r["doc_id"]: r["line_dedup"]["text"] for r in lines.without_common_lines(docs_of(rows), min_docs=2, keep="first").collect()}
    assert got == {0: "own 0\nshared"} | {i: f"own {i}" for i in range(1, 40)}


def test_lines_edge_cases(spark, docs_of):
    assert lines.without_common_lines(docs_of([])).count() == 0
    rows = [(None, "a\nb")] * 12 + [(1, "a")]
    got = lines.without_common_lines(docs_of(rows), min_docs=2).collect()
    assert sorted((r["doc_id"] is None, r["line_dedup"]["text"]) for r in got) == [(False, "")] + [(True, "b")] * 12
    assert lines.without_common_lines(docs_of(["a"] * 3), min_docs=4).where("line_dedup.n_dropped > 0").count() == 0


def test_lines_with_columns_of_any_name(docs_of):
    docs = docs_of(["a\nb", "a", None, "a", "c"]).withColumns({x: F.lit(1) for x in ("_ld_n", "_ld_d", "_ld_t", "bitmap", "bits", "word", "line_dedup", "hs", "n_lines")})
    got = lines.without_common_lines(docs, min_docs=3)
    assert sorted(got.columns) == sorted(docs.columns)
    assert {r["doc_id"]: (r["line_dedup"]["text"], r["line_dedup"]["n_dropped"], r["bits"], r["d"]) for r in got.collect()} == {0: ("b", 1, 1, 7), 1: ("", 1, 1, 7), 2: ("", 0, 1, 7), 3: ("", 1, 1, 7), 4: ("c", 0, 1, 7)}


def test_filter_that_lets_all_through(docs_of, monkeypatch):
    monkeypatch.setattr(skew, "FILTER_WORDS", 1)
    rows = [(i, f"own {i}\n" + ("shared" if i % 3 == 0 else "not")[: 3 + i]) for i in range(90)]
    got = sorted((r["doc_id"], r["line_dedup"]["n_lines"], r["line_dedup"]["n_dropped"], r["line_dedup"]["text"]) for r in lines.without_common_lines(docs_of(rows), min_docs=10).collect())
    assert got == sorted(brute_lines(rows, 10))


def test_bitmaps_round_trip():
    keep = lines.unpacked(21, lines.packed(21, np.array([0, 7, 20])))
    assert np.flatnonzero(~keep).tolist() == [0, 7, 20]


# ---- decontamination


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_overlaps(docs, items):
    out = []
    for i, text in docs:
        w = item_words(text)
        hit, names = set(), set()
        for item, t in items:
            own = item_words(t)
            k = min(10, len(own))
            windows = {tuple(own[j : j + k]) for j in range(len(own) - k + 1)} if own else set()
            for j in range(len(w) - k + 1 if k else 0):
                if tuple(w[j : j + k]) in windows:
                    hit |= set(range(j, j + k))
                    names.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_overlaps_match_brute_force(spark, docs_of, words):
    rng = random.Random(9)
    few = words[:6]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(8, 40)))) for i in range(20)] + [(30, " ".join(rng.choices(few, k=60))), (31, "a " * 30), (31, "b " * 12), (None, " ".join(rng.choices(words, k=15)))]
    items += [(40, "Tiny Item"), (41, "single"), (42, "five words make one item"), (43, ""), (44, None), (45, "!!!")]
    docs = []
    for i in range(160):
        parts = []
        for _ in range(rng.randint(0, 5)):
            own = item_words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(own) - 1))
            parts += rng.choice([rng.choices(words, k=rng.randint(0, 12)), own[a : a + rng.randint(7, 14)], own, rng.choices(few, k=rng.randint(5, 40)), ["single"], ["tiny", "ITEM"], ["a"] * rng.randint(1, 14)])
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(parts)))
    docs += [(500, None), (501, ""), (502, "single"), (None, "Tiny, item?"), (502, "single"), (502, "not it"), (503, "é" * 10), (504, " ".join(rng.choices(words, k=30_000)) + " " + items[0][1])]
    for chosen in (items, [x for x in items if len(item_words(x[1])) >= 10]):
        bench = spark.createDataFrame(chosen, "item_id long, text string").withColumns({"doc_id": F.lit(1), "n": F.lit(2)})
        got = sorted((tuple(r) for r in decontam.overlaps(docs_of(docs), bench).collect()), key=str)
        assert got == brute_overlaps(docs, chosen)


def test_every_window_has_its_fingerprint(spark, words):
    """The first least 4-gram of each ten words is chosen, also where the same words recur."""
    rng = random.Random(13)
    rows = [(i, rng.choices(words[: rng.choice([1, 2, 3, 50])], k=rng.randint(0, 45))) for i in range(200)]
    frame = decontam._fingerprints(spark.createDataFrame(rows, "id long, ws array<string>"), 0)
    for r in frame.selectExpr("id", "g", "marks.p AS p").collect():
        g = r["g"] or []
        want = {i + g[i : i + 7].index(min(g[i : i + 7])) for i in range(len(g) - 6)}
        assert set(r["p"] or []) == want and len(r["p"] or []) == len(want)


def test_overlaps_without_broadcast(spark, docs_of, words, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 1)
    item = " ".join(words[:14])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = [(0, "x " + item), (1, "nothing"), (2, " ".join(words[2:11]))]
    assert sorted(map(tuple, decontam.overlaps(docs_of(docs), bench).collect())) == brute_overlaps(docs, [(1, item)])


def test_overlaps_edge_cases(spark, docs_of):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {(r["n_words"], r["contaminated"]) for r in decontam.overlaps(docs_of(["a b"]), bench).collect()} == {(2, False)}
    assert decontam.overlaps(docs_of([]), bench).count() == 0
    some = spark.createDataFrame([(1, "the item")], "item_id long, text string")
    kept = decontam.clean_documents(docs_of([(1, "has the item"), (2, "fine"), (None, "also fine")]), some)
    assert {r["doc_id"] for r in kept.collect()} == {2, None}


def test_clean_documents_go_by_their_own_text(spark, docs_of):
    some = spark.createDataFrame([(1, "the item")], "item_id long, text string")
    rows = [(None, "has the item"), (None, "has the item"), (None, "fine"), (None, None), (3, "has the item"), (3, "clean"), (4, "The Item"), (5, "")]
    kept = decontam.clean_documents(docs_of(rows), some)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(None, "fine"), (None, None), (3, "clean"), (5, "")], key=str)
    assert kept.columns == docs_of(rows).columns
