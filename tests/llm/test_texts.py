"""Secret scan, HTML extraction, language, mixing, chat, quality: exact rules, round trips, held-out accuracy, edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoresieve.llm import chat, htmltext, langid, mixing, quality, secrets
from scoresieve.llm.dom import parsed

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")


# ---- secrets


def test_base_spans_follow_the_rules():
    spans = secrets.base_spans
    assert spans("token = \"0123456789abcdef0123456789abcdef\"") == [(0, 41, "assign"), (9, 41, "hex")]
    assert spans("PassWord:abc12 x") == [] and spans("PassWord:abc123 x") == [(0, 15, "assign")]
    assert spans("apikey=secret=abcdef") == [(0, 20, "assign")]  # one match that begins first and takes all
    assert spans("api_key'  :  'abcdef'") == [(0, 20, "assign")]
    assert spans("toKen=abcdefgh ſecret=abcdefgh") == []  # letters beyond ASCII are not the keywords'
    assert spans("AKIA" + "A" * 15) == [] and spans("xAKIA" + "A1" * 8) == [(1, 21, "access")]
    assert spans("AKIAAKIA" + "B" * 12) == [(0, 20, "access")]
    assert spans("f" * 23) == [] and spans("é" + "f" * 24 + "g") == [(1, 25, "hex")]


def test_markov_models_tell_random_strings_from_identifiers():
    models = secrets.trained(*secrets.samples([]))
    noise, plain = secrets.samples(["thing", "reading", "station", "letter"], 500, seed=99)
    caught = [s for s in noise if len(s) >= 20 and secrets.ratio(models, s) >= secrets.THRESHOLD]
    false = [s for s in plain if len(s) >= 20 and secrets.ratio(models, s) >= secrets.THRESHOLD]
    assert len(caught) > 0.9 * len(noise) and len(false) < 0.01 * len(plain)
    text = "see xK9f2LqPz7RbW4mTn8Vd and user_account_settings_page_header now"
    assert [text[a:b] for a, b, _ in secrets.added_spans(text, [], models, secrets.THRESHOLD)] == ["xK9f2LqPz7RbW4mTn8Vd"]
    assert secrets.added_spans(text, [(0, 10, "hex")], models, secrets.THRESHOLD) == []


def test_shorter_random_strings_are_scored():
    models = secrets.trained(*secrets.samples([]))
    noise, plain = secrets.samples(["thing", "reading", "station", "letter"], 4000, seed=98)
    spans = lambda s, **options: secrets.added_spans(f"see {s} now", [], models, secrets.THRESHOLD, **options)
    short = [s[: 16 + i % 4] for i, s in enumerate(noise)]
    assert sum(bool(spans(s)) for s in short) > 0.75 * len(short)
    own = [s for s in plain if 16 <= len(s) < 20]
    assert len(own) > 200 and sum(bool(spans(s)) for s in own) < 0.01 * len(own)
    assert spans("xK9f2LqPz7RbW4mT") and not spans("xK9f2LqPz7RbW4m") and not spans("xK9f2LqPz7RbW4mT", least=20) and not spans("xK9f2LqPz7RbW4mT", distinct=17)
    assert spans("xK9f2LqPz7RbW4m", least=12)


def test_added_spans_match_brute_force():
    """Candidates, overlaps and thresholds by a plain reading of the rules."""
    models = secrets.trained(*secrets.samples([]))
    rng = random.Random(31)
    run = lambda k: "".join(rng.choices("abcXYZ019+/_=-deadbeefQWRTzxcvb", k=k))
    pieces = [lambda: run(rng.randint(3, 40)), lambda: "password=" + run(rng.randint(2, 20)), lambda: "".join(rng.choices("0123456789abcdef", k=rng.randint(10, 40))), lambda: "AKIA" + "".join(rng.choices("ABC123", k=20)), lambda: "user_account_settings_page", lambda: "9" * 30]
    found = 0
    for _ in range(300):
        text = "".join(rng.choice(pieces)() + rng.choice([" ", "é", ".", ""]) for _ in range(rng.randint(1, 12)))
        base, want, at = secrets.base_spans(text), [], 0
        while at < len(text):
            end = at
            while end < len(text) and text[end] in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-":
                end += 1
            s = text[at:end]
            if len(s) >= 16 and len(set(s)) >= 8 and not s.isdigit() and not any(max(a, at) < min(b, end) for a, b, _ in base):
                if secrets.ratio(models, s) >= 0.9 * max(1, 20 / len(s)) ** 0.5:
                    want.append((at, end, "markov"))
            at = end + 1
        found += len(want)
        assert secrets.added_spans(text, base, models, secrets.THRESHOLD) == want
    assert found > 50


def test_recall_on_all_alphabets():
    models = secrets.trained(*secrets.samples([]))
    rng = random.Random(6)
    for letters in ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789"):
        caught = sum(bool(secrets.added_spans("".join(rng.choices(letters, k=20)), [], models, secrets.THRESHOLD)) for _ in range(200))
        assert caught > 180, letters


def test_sample_of_words_is_of_different_texts(spark, docs_of, monkeypatch):
    """Copies of one text do not fill the sample."""
    taken = []
    monkeypatch.setattr(secrets, "samples", lambda words: taken.append(set(words)) or ([], []))
    secrets.learned(docs_of(["copied words"] * 300 + [f"{w} only" for w in ("alpha", "beta", "gamma", "delta")]), most_docs=5)
    assert taken == [{"copied", "words", "only", "alpha", "beta", "gamma", "delta"}]


def test_scan_takes_time_in_proportion():
    models = secrets.trained(*secrets.samples([]))
    text = " ".join(["password=hunter22 xK9f2LqPz7RbW4mTn8Vd"] * 20_000)
    assert len(secrets.added_spans(text, secrets.base_spans(text), models, secrets.THRESHOLD)) == 20_000


def test_words_for_the_models_are_bounded_by_a_parameter(docs_of, monkeypatch):
    taken = []
    monkeypatch.setattr(secrets, "samples", lambda words: taken.append(words) or ([], []))
    docs = docs_of(["common alpha", "common beta", "common gamma alpha"])
    secrets.learned(docs, most_words=2)
    secrets.learned(docs)
    assert taken == [["common", "alpha"], ["common", "alpha", "beta", "gamma"]] and secrets.TRAIN_WORDS == 5000


def test_scan_edge_cases(spark, docs_of):
    docs = docs_of(["", None, "x" * 200_000 + " password=hunter22", "password=hunter22", "password=hunter22"])
    got = {r["doc_id"]: r["s"] for r in docs.withColumn("s", secrets.scanned(F.col("text"), secrets.learned(docs))).collect()}
    assert [len(got[i]["base"]) for i in range(5)] == [0, 0, 1, 1, 1]
    assert got[2]["base"][0]["start"] == 200_001
    assert docs_of([]).withColumn("s", secrets.scanned(F.col("text"), secrets.learned(docs_of([])))).count() == 0
    out = docs.withColumn("s", secrets.scanned(F.col("text"), secrets.learned(docs))).select("doc_id", secrets.redacted(F.col("text"), F.col("s.base")).alias("t"))
    assert {r["doc_id"]: r["t"] for r in out.collect()}[3] == "[SECRET]"


# ---- HTML


def test_pages_lose_all_but_the_article():
    model = htmltext.trained()
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site</a></header>
    <div class="cookie-notice">We use cookies, do you agree with this?</div><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
    <article><h1>A  title &amp;&nbsp;more</h1><p><b>First<br>line &lt;x&gt;<p>Second paragraph, with <a href=/c>a link</a> in it.</p>
    <script>var a = "</p>";</script><ul><li>point one</li><li>point two</li></ul></article>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href=/d>Other thing</a></li></ul></aside>
    <section id="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>I do not agree with this at all.</p></div></section>
    <form><label>Mail</label><input name=m><button>Send</button></form><footer>&copy; 2024 Somebody</footer></body></html>"""
    assert htmltext.main_text(page, model).split("\n\n") == ["A title & more", "First line <x>", "Second paragraph, with a link in it.", "point one", "point two"]


def test_generated_pages_held_out():
    model = htmltext.trained()
    wrong = lost = extra = total = 0
    for seed in range(20_000, 20_150):
        page = htmltext._Maker(seed).page()
        want = set()
        for part in re.findall("\x01(.*?)\x02", page, re.S):
            root = parsed(f"<div>{part}</div>")
            want |= set(htmltext.blocks(root, {id(root.items[0]): True}))
        got = set(htmltext.main_text(page.replace("\x01", "").replace("\x02", ""), model).split("\n\n")) - {""}
        lost, extra, total, wrong = lost + len(want - got), extra + len(got - want), total + len(want), wrong + (got != want)
    assert lost < 0.06 * total and extra < 0.06 * total


def test_labels_are_consistent():
    """Below boilerplate all is boilerplate, below content nothing is open, and no text of boilerplate is kept."""
    rng = np.random.default_rng(0)
    for seed in range(40):
        parts = htmltext.parts_of(htmltext._unmarked(parsed(htmltext._Maker(seed).page())))
        margins = rng.normal(0, 3, len(parts))
        state, keep = htmltext.states(parts, margins), htmltext.decoded(parts, margins)
        for i, p in enumerate(parts):
            above = state[p.parent] if p.parent >= 0 else 0
            assert above != 2 or state[i] == 2
            assert above != 1 or state[i] != 0
            assert not keep[i] or state[i] != 2
        assert {0, 1, 2} >= set(state.tolist())


def test_labels_are_the_best_of_all():
    """On small trees: no consistent labelling scores higher."""
    from itertools import product

    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(2, 7))
        parts = [htmltext.Part(None, -1)] + [htmltext.Part(None, int(rng.integers(0, i)), own=int(rng.integers(0, 2))) for i in range(1, n)]
        margins = rng.normal(0, 3, n)
        m = np.clip(margins, -htmltext.SURE, htmltext.SURE)
        good, bad = -np.logaddexp(0, -m), -np.logaddexp(0, m)
        leaf = [all(p.parent != i for p in parts) for i in range(n)]

        def score(state):
            total = 0.0
            for i, p in enumerate(parts):
                above = 0 if p.parent < 0 else state[p.parent]
                if p.parent < 0:
                    if state[i]:
                        return -np.inf
                    continue
                if (above == 2 and state[i] != 2) or (above == 1 and state[i] == 0) or (state[i] == 0 and leaf[i]):
                    return -np.inf
                total += (good[i], bad[i])[state[i] - 1] if state[i] else (max(good[i], bad[i]) if p.own else 0) - htmltext.OPEN - htmltext.LEAN * max(m[i], 0)
                total -= htmltext.TURN if above == 1 and state[i] == 2 else 0
            return total

        got = htmltext.states(parts, margins)
        assert abs(score(got) - max(score(s) for s in product((0, 1, 2), repeat=n))) < 1e-9


def test_text_of_the_page_itself():
    model = htmltext.trained()
    assert htmltext.main_text("Hello <b>world</b>, this is all that the page says. It has two sentences.", model) == "Hello world, this is all that the page says. It has two sentences."
    assert htmltext.main_text("Lead text, it is here.<p>More of it, a second sentence.</p>", model) == "Lead text, it is here.\n\nMore of it, a second sentence."
    body = htmltext.main_text("<html><body>First words of the body, without a block.<p>And a paragraph, as it should be.</p></body></html>", model)
    assert body == "First words of the body, without a block.\n\nAnd a paragraph, as it should be."


def test_tags_and_names_cost_what_they_are():
    root = parsed("<div>" * 20_000 + "</b>" * 20_000 + "<p>" + "<span>" * 5000 + "<li>x" * 5000)
    assert root.items
    page = "<body>" + "".join(f'<div class="überschrift-{i} navBar">Sentence, number {i}.</div>' for i in range(45_000)) + "</body>"
    parts = htmltext.parts_of(parsed(page))
    f = htmltext.features(parts)
    assert len(f.plain) == 45_002 and len(f.own[5]) == 3 and f.laid_out({}, 10, 20).shape == (10, htmltext.PLAIN)
    assert htmltext._names(parsed("<p class=navBar>").items[0]) == htmltext._names(parsed("<p id='nav bar'>").items[0])


def test_pages_edge_cases(spark):
    odd = [None, "", "plain text", "<p>", "<", "<!-- never ends", "<div class='", "<script>x", "<p>a</div></p></p>b", "<table><tr><td>x<td>y", "<div>" * 3000 + "deep", "&amp &bogus; &#x41;"]
    rows = spark.createDataFrame([(i, h, 1) for i, h in enumerate(odd)], "page_id long, html string, text int")
    got = rows.select("page_id", htmltext.extracted(F.col("html")).alias("t")).collect()
    assert len(got) == len(odd) and all(r["t"] is not None for r in got) and got[0]["t"] == got[1]["t"] == ""
    assert rows.limit(0).select(htmltext.extracted(F.col("html")).alias("t")).count() == 0


def _whole_text(source):
    """All visible text of a page, by blocks."""
    root = parsed(f"<div>{source}</div>")
    return htmltext.blocks(root, {id(root.items[0]): True})


def test_stray_quotes_lose_no_text():
    for source, want in (
        ("<p title=O'Reilly>First</p><p>Second</p>", ["First", "Second"]),
        ('<p class="a"">One</p><p>Two</p><p class="b">Three</p>', ["One", "Two", "Three"]),
        ("<p 'x>One</p><p>Two</p>", ["One", "Two"]),
        ("<p class='a>One</p><p>Two</p>", ["One", "Two"]),
        ('<p>One</p ">Two<p a=b"c d>Three', ["One", "Two", "Three"]),
        ('<p a="x > y" b = \'>\' c=>One</p><br/><p/ d>Two', ["One", "Two"]),
    ):
        assert _whole_text(source) == want, source
    node = parsed("<p title=O'Reilly class = \"a\"\" id='x y' data-x=\"1 > 0\" class=b hidden>t").items[0]
    assert node.named() == {"title": "O'Reilly", "class": "a", '"': "", "id": "x y", "data-x": "1 > 0", "hidden": ""}
    assert parsed("<p>a</p><p class='").items[0].items == ["a"] and len(parsed("<p>a</p><p class='").items) == 1
    text = htmltext.main_text("<html><body><nav><a href=/>Home</a></nav><article title=O'Reilly><h1>Title</h1><p>First sentence, of the text.</p><p>Second one, it is.</p></article></body></html>", htmltext.trained())
    assert text.split("\n\n") == ["Title", "First sentence, of the text.", "Second one, it is."]


def test_only_hidden_elements_are_dropped():
    for attrs in ('style="overflow:hidden;border:none"', 'class="overflow-hidden" style="list-style:none"', 'aria-hidden="false" style="float:none"', 'data-x="display:none"', 'title="hidden"', 'style="/*;display:none*/color:red"', 'style="x-display:none"', 'style="display:none;display:block"', 'style="color:red" style="display:none"'):
        assert _whole_text(f"<article {attrs}><p>Text</p></article>") == ["Text"], attrs
    for attrs in ("hidden", 'HIDDEN=""', 'style="display:none"', "style='color:red; DISPLAY : none !important;display:block'", "style=display:none", 'style="/* a */display:none"'):
        assert _whole_text(f"<article {attrs}><p>Text</p></article><p>More</p>") == ["More"], attrs


def test_formulas_stay_in_their_block():
    formula = '<math xmlns="http://www.w3.org/1998/Math/MathML" display="block"><semantics><mrow><mi>x</mi><mspace width="1em"/><mo stretchy="false">=</mo><mn>42</mn></mrow><annotation encoding="application/x-tex"/><annotation encoding="a">x=42 TeX</annotation></semantics></math>'
    assert _whole_text(f"<p>Where {formula} holds<math/>.</p><p>Next</p>") == ["Where x=42 holds.", "Next"]
    assert [p.node.tag for p in htmltext.parts_of(parsed(f"<p>Where {formula} holds.</p>"))] == ["#root", "p"]
    page = f"<html><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>The first sentence, of the text, says that {formula} holds.</p><p>Second one, it is.</p></article></body></html>"
    assert htmltext.main_text(page, htmltext.trained()).split("\n\n") == ["Title", "The first sentence, of the text, says that x=42 holds.", "Second one, it is."]


# ---- language


def test_languages_of_held_out_documents(table):
    docs = table("documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = langid.learned(docs, ~held)
    got = docs.where(held).select("lang", langid.identified(F.col("text"), model)["lang"].alias("p")).collect()
    assert sum(r["lang"] == r["p"] for r in got) > 0.98 * len(got)


def test_language_spans_and_scripts(spark, docs_of):
    rng = random.Random(1)
    en, ru, ja = (lambda n, a=a: " ".join("".join(rng.choices(a, k=5)) for _ in range(n)) for a in ("etaoinshrd", "аеинотслрк", "のにはをたがで"))
    rows = [(i, f(40), lang) for i in range(30) for f, lang in ((en, "en"), (ru, "ru"), (ja, "ja"))] + [(1, "xx", None)]
    model = langid.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.langs == ["en", "ja", "ru"]
    mixed = en(20) + ". " + ru(40) + " 12 " + en(10)
    texts = [mixed, None, "", "123 !?", "Ω", en(60_000), mixed]
    got = docs_of(texts).withColumn("l", langid.identified(F.col("text"), model)).orderBy("doc_id").collect()
    assert [(s["lang"], mixed[s["start"] : s["end"]].count(" ") + 1) for s in got[0]["l"]["spans"]] == [("en", 20), ("ru", 40), ("en", 10)]
    assert got[0]["l"]["lang"] == "ru" and 0 <= got[0]["l"]["score"] <= 1 and got[6]["l"] == got[0]["l"]
    assert [got[i]["l"]["lang"] for i in (1, 2, 3, 5)] == ["und", "und", "und", "en"] and got[4]["l"]["lang"] in model.langs
    empty = langid.learned(spark.createDataFrame([], "doc_id long, text string, lang string"), F.lit(True))
    assert [r["l"]["lang"] for r in docs_of(["abc"]).withColumn("l", langid.identified(F.col("text"), empty)).collect()] == ["und"]


def test_combining_marks_and_rare_planes():
    letters = langid.Letters()
    cut = lambda t: [t[a:b] for a, b in zip(*letters.words(t)[3:], strict=True)]
    assert cut("हिन्दी भाषा") == ["हिन्दी", "भाषा"]
    assert cut("\u0301 e\u0301t \u20ddx") == ["e\u0301t", "x"]
    assert cut("\U00010400\U00010401 \U0001d400b \U00020000 \U0001f600") == ["\U00010400\U00010401", "\U0001d400b", "\U00020000"]
    assert cut("") == cut("\u0301 12 !") == []


def test_predictions_match_brute_force(spark, docs_of):
    """The model and its labels by plain Python loops on a small table."""
    rng = random.Random(8)
    make = lambda a, n: " ".join("".join(rng.choices(a, k=rng.randint(1, 6))) for _ in range(n))
    rows = [(i, make(a, rng.randint(1, 20)) + rng.choice([".", "", " 7", "é"]), lang) for i in range(40) for a, lang in (("etaoin", "en"), ("einsrt", "de"), ("аеинот", "ru"))]
    model = langid.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    letters, langs = langid.Letters(), sorted({lang for *_, lang in rows})
    counts, scripts = np.zeros((langid.RANGE, 3)), np.zeros((len(langid.SCRIPT_NAMES), 3))
    for _, text, lang in rows:
        h, _, script, _, _ = letters.words(text)
        for x in h:
            counts[x, langs.index(lang)] += 1
        for x in script:
            scripts[x, langs.index(lang)] += 1
    logs = np.log((counts + 0.1) / (counts + 0.1).sum(0))
    logs -= logs.mean(1, keepdims=True)
    assert model.langs == langs and np.allclose(model.table, logs, atol=1e-4)
    texts = [make(rng.choice(["etaoin", "einsrt", "аеинот", "aeино"]), rng.randint(0, 7)) for _ in range(60)]
    got = {r["doc_id"]: r["l"] for r in docs_of(texts).withColumn("l", langid.identified(F.col("text"), model)).collect()}
    for i, text in enumerate(texts):
        h, begin, script, starts, ends = letters.words(text)
        if not len(begin):
            assert got[i]["lang"] == "und"
            continue
        scores = np.array([logs[h[a:b]].sum(0) for a, b in zip(begin, [*begin[1:], len(h)], strict=True)])
        for j, x in enumerate(script):
            if scripts[x].any():
                scores[j] += np.where(scripts[x] / scripts.sum(0) >= 0.005, 0, -100)
        best, back = scores[0], []
        for row in scores[1:]:
            move = best.max() - langid.SWITCH
            back.append([k if best[k] >= move else int(best.argmax()) for k in range(3)])
            best = np.maximum(best, move) + row
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(step[path[-1]])
        share = [sum(e - s for s, e, k in zip(starts, ends, reversed(path), strict=True) if k == lang) for lang in range(3)]
        assert got[i]["lang"] == langs[int(np.argmax(share))] and abs(got[i]["score"] - max(share) / sum(share)) < 1e-9


def test_viterbi_is_optimal():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        scores = rng.normal(0, 3, (n, 3)).astype(np.float32)
        cost = lambda path, s=scores: sum(s[i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))
        best = max(cost(p) for p in np.ndindex(*([3] * n)))
        assert abs(cost(langid._viterbi(scores, np.array([n]), 2.0)) - best) < 1e-4


# ---- mixing


def test_counts_invert_the_distribution(spark, docs_of):
    rows = [(i, "x" * (1 + i % 5)) for i in range(400)] + [(None, "abc"), (7, "again"), (999, None), (998, "")]
    docs = docs_of(rows).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b"))
    rates = {r["source"]: r["rate"] for r in mixing.rates(docs, volume=2.0).collect()}
    out = mixing.mixed(docs, volume=2.0)
    assert "component_id" in out.columns
    got = {}
    for r in out.collect():
        got.setdefault((r["doc_id"], r["text"]), []).append(r["copy_no"])
    for i, text in rows:
        key = str(i) if i is not None else "text " + hashlib.md5((text or "").encode()).hexdigest()
        u = int(hashlib.md5(f"mix-1:{key}".encode()).hexdigest()[:12], 16) / 2**48
        rate = rates[None if i is None or i % 3 == 2 else "ab"[i % 3]]
        k, p, c = 0, math.exp(-rate), math.exp(-rate)
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        assert sorted(got.get((i, text), [])) == list(range(1, k + 1))


def test_high_rates(spark, docs_of):
    """Rates far beyond a block of copies: the counts of the distribution, each copy once, in little time."""
    from math import lgamma, log

    rng = np.random.default_rng(4)
    u = rng.random(300)
    for rate in (450.0, 600.0, 20_000.0, 1e5):
        got = mixing.counts_of(u, np.full(300, rate))
        ks = np.arange(0, int(rate + 40 * rate**0.5) + 60)
        cdf = np.cumsum(np.exp(np.array([k * log(rate) - rate - lgamma(k + 1) for k in ks])))
        assert (got == np.searchsorted(cdf, u, "right")).all()
    assert mixing.counts_of(u, np.zeros(300)).sum() == 0
    docs = docs_of([(1, "tiny")] + [(i, "word " * 2000) for i in range(2, 30)]).withColumn("source", F.when(F.col("doc_id") == 1, "rare").otherwise("big"))
    out = mixing.mixed(docs, targets={"rare": 0.5, "big": 0.5}).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("copy_no").alias("most"), F.countDistinct("copy_no").alias("d"))
    n = {r["doc_id"]: r for r in out.collect()}
    assert 30_000 < n[1]["n"] < 40_000 and all(r["n"] == r["most"] == r["d"] for r in n.values())


def test_mixing_keeps_columns_of_any_name(docs_of):
    docs = docs_of(["a", "b", None, "b"]).withColumns({x: F.lit(1) for x in ("_mix_n", "_mix_cdf", "count", "rate", "block", "source_of_rate", "copy_no", "order_key")})
    assert sorted(mixing.mixed(docs, volume=3.0).columns) == sorted(docs.columns)
    assert mixing.mixed(docs, volume=3.0).where("count != 1 or rate != 1 or block != 1").count() == 0


def test_shares_come_near_their_targets(spark, docs_of):
    docs = docs_of([(i, "some words") for i in range(6000)]).withColumn("source", F.when(F.col("doc_id") < 4500, "big").otherwise("small"))
    n = {r["source"]: r["count"] for r in mixing.mixed(docs, targets={"big": 1.0, "small": 3.0}).groupBy("source").count().collect()}
    assert abs(n["small"] / (n["small"] + n["big"]) - 0.75) < 0.03 and abs(sum(n.values()) - 6000) < 400
    only = mixing.mixed(docs, targets={"small": 1.0}).select("source").distinct().collect()
    assert [r["source"] for r in only] == ["small"]
    assert mixing.mixed(docs_of([])).count() == 0
    assert mixing.mixed(docs, targets={}).count() == 0


def test_order_is_repeatable_and_mixed(spark, docs_of):
    docs = docs_of([(i, "t") for i in range(500)])
    one = mixing.mixed(docs).select("doc_id", "copy_no", "order_key").collect()
    two = mixing.mixed(docs.repartition(7)).select("doc_id", "copy_no", "order_key").collect()
    assert sorted(one) == sorted(two)
    ids = [r["doc_id"] for r in sorted(one, key=lambda r: r["order_key"])]
    assert ids != sorted(ids)


# ---- chat


def test_template_round_trip():
    t = chat.Template()
    rng = random.Random(2)
    for _ in range(3000):
        role, text = ("".join(rng.choices(["<s>", "</s>", "[INST]", "[/INST]", "<", "s", ">", "\\", "\n", "/", "[", "é", "<<SYS>>"], k=rng.randint(0, 9))) for _ in range(2))
        turn, a, b = t.render(role, text)
        assert t.parse(turn) == (role, text) and t.unescape(turn[a:b]) == text
        assert not any(c in turn[a:b] for c in t.control)


EVENT = "conv_id long, turn long, seq long, role string, event string, text string"


def test_events_fold_into_messages(spark):
    log = [
        (1, 0, 0, "user", "message", "hi"), (1, 1, 1, "assistant", "delta", "he"), (1, 1, 2, "assistant", "delta", "llo"), (1, 2, 3, "user", "message", "old"),
        (1, 1, 4, "assistant", "regenerate", "new "), (1, 1, 5, "assistant", "delta", "answer"), (1, 2, 6, "user", "message", "ask"), (1, 2, 7, "user", "edit", "ask "), (1, 2, 8, "user", "delta", "more"),
        (2, 0, 0, None, None, None), (2, 0, 0, None, None, None), (None, None, 3, "user", "message", "x"), (3, 5, 1, "assistant", "message", "</s>[INST] ok [/INST]" * 3000),
    ]
    frame = spark.createDataFrame(log, EVENT).withColumn("position", F.lit(1)).repartition(3)
    turns = chat.rendered(frame)
    t = chat.Template()
    got = {}
    for r in turns.orderBy("conv_id", "position").collect():
        got.setdefault(r["conv_id"], []).append(t.parse(r["formatted"]))
    assert got == {1: [("user", "hi"), ("assistant", "new answer"), ("user", "ask more")], 2: [("", ""), ("", "")], None: [("user", "x")], 3: [("assistant", "</s>[INST] ok [/INST]" * 3000)]}
    whole = {r["conv_id"]: r for r in chat.conversations(turns).collect()}
    for conv, own in whole.items():
        said = [t.unescape(own["formatted"][s["start"] : s["end"]]) for s in own["loss"]]
        assert said == [text for role, text in got[conv] if role == "assistant"]
    digests = {r["conv_id"]: r for r in chat.digests(turns).collect()}
    assert digests[1]["n_turns"] == 3 and digests[1]["loss_chars"] == 10 and digests[1]["loss_sha256"] == hashlib.sha256(b"new answer").hexdigest()
    assert digests[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\nnew answer\nuser\nask more\n").hexdigest()
    assert all(digests[c]["formatted_chars"] == len(whole[c]["formatted"]) for c in whole)
    assert chat.digests(chat.rendered(frame.limit(0))).count() == 0


def test_random_logs_match_a_plain_fold(spark):
    """Streamed folding against one that goes through each conversation's events by sequence and keeps a dictionary of turns."""
    rng = random.Random(17)
    log, want = [], {}
    for conv in range(40):
        turns: dict[int, list] = {}
        for seq in range(rng.randint(0, 25)):
            turn, text = rng.randint(0, 4), rng.choice(["a", "<s>", "é\n", "", "\\", "[INST]"])
            event = rng.choice(["message", "delta", "delta", "edit", "regenerate"]) if turn in turns else rng.choice(["message", "delta"])
            role = rng.choice(["user", "assistant"])
            log.append((conv, turn, seq, role, event, text))
            if event == "regenerate":
                turns = {t: m for t, m in turns.items() if t < turn}
            own = turns.setdefault(turn, [])
            if event in ("message", "regenerate") or not own:
                own.append([role, text])
            else:
                own[-1][1] = text if event == "edit" else own[-1][1] + text
        if turns:
            want[conv] = [tuple(m) for t in sorted(turns) for m in turns[t]]
    rng.shuffle(log)
    t, got = chat.Template(), {}
    for r in chat.rendered(spark.createDataFrame(log, EVENT).repartition(5)).orderBy("conv_id", "position").collect():
        got.setdefault(r["conv_id"], []).append(t.parse(r["formatted"]))
    assert got == want
    clash = spark.createDataFrame(log, EVENT).withColumns({x: F.lit(0) for x in ("c", "t", "s", "void", "at", "formatted", "loss")})
    assert chat.rendered(clash).count() == sum(map(len, want.values())) and chat.rendered(clash.limit(0)).count() == 0


# ---- quality


def test_quality_of_held_out_documents(table):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    docs, labels = table("documents"), table("labels")
    out = quality.scored(docs, labels, ~held).where(held).join(labels, "doc_id").select("quality", "quality_predicted", "quality_score").collect()
    assert sum(r[0] == r[1] for r in out) > 0.93 * len(out)
    good, bad = ([r[2] for r in out if r[0] == y] for y in (1, 0))
    assert sum(g > b for g in good for b in bad) > 0.95 * len(good) * len(bad)


def test_quality_edge_cases(spark, docs_of):
    docs = docs_of([("é" * 100_000) if i == 0 else None if i == 1 else "" if i == 2 else f"text {i} fine" for i in range(40)])
    for rows in ([], [(3, 1)], [(i, i % 2) for i in range(40)] + [(None, 1), (4, None), (5, 3), (6, 0), (6, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        out = quality.scored(docs, labels, F.lit(True)).collect()
        assert len(out) == 40 and all(0 <= r["quality_score"] <= 1 and r["quality_predicted"] == int(r["quality_score"] >= 0.7) for r in out)
    assert quality.scored(docs_of([]), spark.createDataFrame([], "doc_id long, quality int"), F.lit(True)).count() == 0


def test_descent_matches_a_plain_solver():
    """The dual optimum by many plain passes over all pairs of (document, bound): same weights, no gap between primal and dual."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 60, 12)) for _ in range(50)]
    y = np.where(rng.random(50) < 0.5, 1, -1)
    ratio = rng.normal(0, 1, 60)
    w, bias = quality._descend(rows, y, ratio, rounds=3000)
    x = np.zeros((50, 61))
    for i, own in enumerate(rows):
        x[i, own] = ratio[own] / np.sqrt((ratio[own] ** 2).sum())
    x[:, 60] = 1
    q = (x @ x.T) * np.outer(y, y)
    alpha = np.zeros(50)
    for _ in range(20_000):  # projected gradient
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.eigvalsh(q)[-1], 0, 1) if _ == 0 else np.clip(alpha - (q @ alpha - 1) / top, 0, 1)
        top = np.linalg.eigvalsh(q)[-1] if _ == 0 else top
    best = x.T @ (alpha * y)
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    assert loss(np.r_[w, bias]) - (alpha.sum() - 0.5 * alpha @ q @ alpha) < 0.02 * loss(best)


def test_sample_is_bounded(spark, docs_of, monkeypatch):
    """An id with very many rows counts once, and features beyond the bound are left out."""
    taken = []
    monkeypatch.setattr(quality, "fitted", lambda rows, y, share: taken.append(len(rows)) or quality.Model(np.zeros(1), np.zeros(1), 0.0, 0.0, 0.0))
    docs = docs_of([(1, f"copy {i}") for i in range(500)] + [(i, "some words here to learn from") for i in range(2, 20)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 20)] * 2, "doc_id long, quality int")
    quality.learned(docs, labels, F.lit(True))
    quality.learned(docs, labels, F.lit(True), most_features=150)
    assert taken[0] == 19 and 0 < taken[1] < 19


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.r_[rng.integers(0, 50, 10), (100 if i % 2 else 200) + rng.integers(0, 5, 2)]) for i in range(80)]
    y = np.array([1 if i % 2 else -1 for i in range(80)])
    model = quality.fitted(rows, y, 0.5)
    assert all((quality._margin(x, model.ratio, model.weight, model.bias) > 0) == (t > 0) for x, t in zip(rows, y, strict=True))
