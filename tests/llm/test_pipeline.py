"""The pipeline's stages against brute force on a small fixture, and the registered queries of this folder."""

import random
import re

import pytest

import corpus_pipeline
from scoresieve.llm import queries, sql

from .test_pairs import brute_lines, brute_overlaps, least_labels, shingles


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents, labels and a benchmark in which each stage has something to do."""
    rng = random.Random(12)
    words = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(25)) for i in range(4)]
    docs, labels = [], []
    for i in range(260):
        bad = i % 9 == 0
        body = "\n".join(" ".join(f"{w.upper()}!!" if bad else w for w in text(rng.randint(20, 60)).split()) for _ in range(rng.randint(1, 4)))
        if i % 10 == 3:
            body += "\nShared Line\n" + text(12)
        if i % 40 == 5:
            body += " " + items[i % 4][1]
        if i % 20 == 7:
            body = docs[i - 1][1] + " end"
        docs.append((i, body, "en", f"src{i % 3}", len(body)))
        labels.append((i, 0 if bad else 1, 0))
    docs += [(900, None, None, None, None), (901, "", "en", "src0", 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def test_stages_match_brute_force(spark, corpus):
    path, docs, items = corpus
    given = spark.read.parquet(f"{path}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        given = corpus_pipeline.stored(stage(spark, given, path), "test")
        out[name] = {r["doc_id"]: r for r in given.where("doc_id is not null").collect()}
        if name != names[-1]:
            assert given.columns == corpus_pipeline.COLUMNS and given.count() == len(out[name])
    good, deduped, single, clean, mixed = (out[n] for n in names)
    junk = {i for i, *_ in docs if i < 900 and i % 9 == 0 and i % 20 != 7}
    assert len(junk & set(good)) <= 2 and len({i for i in range(260)} - junk - set(good)) <= 12
    assert {i: r["text"] for i, r in deduped.items()} == {i: t for i, _, _, t in brute_lines([(i, r["text"]) for i, r in good.items()], 10)}
    assert all(r["n_chars"] == len(r["text"]) for r in deduped.values())
    sets = {i: shingles(r["text"], 5) for i, r in deduped.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    groups = least_labels(sets, links)
    assert links and set(single) == {i for i, c in groups.items() if i == c}
    bad = {i for i, *_, hit in brute_overlaps([(i, r["text"]) for i, r in single.items()], items) if hit}
    assert bad and set(clean) == set(single) - bad
    assert set(mixed) <= set(clean) and all(r["text"] == clean[i]["text"] for i, r in mixed.items())


def test_run_gives_the_last_stage(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    assert out.columns == [*corpus_pipeline.COLUMNS, "copy_no", "order_key"] and out.count() > 20


def test_run_goes_on_after_its_last_whole_stage(spark, corpus, monkeypatch):
    """A run that breaks off and is started again does not repeat whole stages; spent tables are gone."""
    from scoresieve.llm import scratch

    stages, calls = list(corpus_pipeline.STAGES), []

    def counted(i, f, breaks):
        def stage(*args):
            calls.append(i)
            if breaks:
                raise RuntimeError("lost")
            return f(*args)

        return stage

    import uuid

    name = f"test-{uuid.uuid4().hex}"
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, counted(i, f, i == 2)) for i, (n, f) in enumerate(stages)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, corpus[0], name)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, counted(i, f, False)) for i, (n, f) in enumerate(stages)])
    out = corpus_pipeline.run(spark, corpus[0], name)
    assert calls == [0, 1, 2, 2, 3, 4] and out.count() > 20
    base = f"{scratch.shared_dir(spark)}/scoresieve/run-{name}"
    assert [scratch.exists(spark, f"{base}/{i + 1}-{n.replace(' ', '-')}") for i, (n, _) in enumerate(stages)] == [False, False, False, False, True]


def test_empty_tables_repeated_rows_and_names(spark, corpus, tmp_path):
    """Stages on empty documents, on rows that come twice, and on further columns."""
    from pyspark.sql import functions as F

    given = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    clash = {x: F.lit(7) for x in ("quality_score", "line_dedup", "copy_no", "rate", "dropped", "repeated", "text_hash", "n", "loses")}
    twice = given.union(given.where("doc_id % 5 = 1")).withColumns(clash)
    empty, kept = given.limit(0).withColumns(clash), {}
    for name, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.stored(stage(spark, empty, corpus[0]), "test")
        twice = corpus_pipeline.stored(stage(spark, twice, corpus[0]), "test")
        kept[name] = [r["doc_id"] for r in twice.where("doc_id is not null").select("doc_id").collect()]
        assert empty.count() == 0 and empty.columns[:5] == corpus_pipeline.COLUMNS
    assert len(kept["line dedup"]) > len(set(kept["line dedup"])) and len(kept["n-gram Jaccard join"]) == len(set(kept["n-gram Jaccard join"]))


def test_names_and_sql():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(sql.ORACLE_SQL) < set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    got = queries.QUERIES[name](spark, path)
    want = con.execute(sql.ORACLE_SQL[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    as_rows = lambda rows: sorted((tuple(str(v) for v in r) for r in rows))
    assert as_rows(got.select(*columns).collect()) == as_rows(want[columns].itertuples(index=False, name=None))


def test_base_spans_of_the_query(spark):
    """The base columns of the secret scan by a plain reading of the rules."""
    import hashlib

    path = "/root/testdata/sf0.01"
    kinds = ["assign", "access", "hex"]
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op1_secret_scan(spark, path).collect():
        text, found = texts[r["doc_id"]], []
        for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
            found += [(m.start(), "assign", m.end())] * (len(m[2]) >= 6)
        found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        found.sort(key=lambda x: (x[0], kinds.index(x[1])))
        line = ",".join(f"{k}:{a}:{b}" for a, k, b in found)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in found) for x in kinds]
        assert set(line.split(",")) <= set(r["spans"].split(",")) or not line


def test_entry_without_this_folder(tmp_path):
    """The entry module and the other queries work where this folder and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "scoresieve", tmp_path / "scoresieve", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
