"""The registered queries on the smallest tables, against SQL or a brute-force version."""

import os
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
import corpus_pipeline
from mathframe.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels"):
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return found


def test_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, con, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[names.index(c)] for c in columns]) for r in found.fetchall())


def test_simhash(spark, con):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 3 else [" ".join(words)] * bool(words)
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    docs = con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    prints = [fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = sorted((d, f"{p:016x}", docs[find(i)][0]) for i, ((d, _), p) in enumerate(zip(docs, prints)))
    assert sorted(map(tuple, queries.op10_simhash(spark, FOLDER).collect())) == want


def test_lattice(spark, con):
    data = con.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    x = np.array([v for _, v in data], float)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    links = (x @ x.T >= 0.95).sum(axis=1) - 1
    found = {r.vec_id: r.n_links for r in queries.op8_lattice(spark, FOLDER).collect()}
    assert all(found[i] <= n for (i, _), n in zip(data, links)) and sum(found.values()) >= 0.9 * links.sum()


def test_token_counts(spark, con):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = [(d, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t in con.execute("SELECT doc_id, text FROM documents").fetchall()]
    assert sorted(map(tuple, queries.op9_token_counts(spark, FOLDER).collect())) == sorted(want)


@pytest.mark.parametrize("query, label, folds, fold, right", [("op1_toxicity", "toxic", 3, 1, 0.9), ("op6_quality", "quality", 5, 0, 0.9)])
def test_held_out(spark, query, label, folds, fold, right):
    folder = "/root/testdata/sf0.01"
    truth = dict(duckdb.connect().execute(f"SELECT doc_id, {label} FROM '{folder}/labels.parquet'").fetchall())
    rows = queries.QUERIES[query](spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) / len(held) >= right


def test_languages(spark, con):
    declared = dict(con.execute("SELECT page_id, regexp_extract(html, 'lang=\"(..)', 1) FROM pages").fetchall())
    found = {r.page_id: r.language for r in queries.op3_language(spark, FOLDER).collect()}
    assert found.keys() == declared.keys() and np.mean([found[i] == x for i, x in declared.items()]) > 0.95


def test_pseudonyms(spark, con):
    before = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    found = queries.op2_feistel(spark, FOLDER).collect()
    mail = re.compile(r"\w+\.\d+@mail\d\.example\.com")
    seen = {}
    for r in found:
        old, new = mail.findall(before[r.doc_id]), mail.findall(r.text)
        assert len(old) == len(new) and not set(old) & set(new)
        for a, b in zip(old, new):
            assert seen.setdefault(a, b) == b
        if not re.search("[0-9@]", before[r.doc_id]):
            assert r.text == before[r.doc_id] and r.n_values == 0
    assert len(set(seen.values())) == len(seen) > 0


def test_line_dedup(spark, con):
    """No line but its first stands twice, and nothing else is gone."""
    before = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    normal = lambda line: line.lower().strip(" \t\r\f\x0b")
    kept = {r.doc_id: r.text for r in queries.op7_line_dedup(spark, FOLDER).collect()}
    lines = [normal(x) for t in kept.values() for x in t.split("\n") if normal(x)]
    assert len(lines) == len(set(lines))
    first = {normal(x): (d, i) for d in sorted(before, reverse=True) for i, x in reversed(list(enumerate(before[d].split("\n"))))}
    exact = {d: [x for i, x in enumerate(t.split("\n")) if not normal(x) or first[normal(x)] == (d, i)] for d, t in before.items()}
    missing = 0
    for d, texts in exact.items():
        for x in texts:
            missing += bool(normal(x)) and x not in kept.get(d, "").split("\n")
    assert missing <= 0.05 * sum(map(len, exact.values()))
    assert all(d in kept for d, texts in exact.items() if any(normal(x) for x in texts)) or missing


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts, frame = [docs.count()], docs
    folder = os.path.join(spark.sparkContext.getCheckpointDir().removeprefix("file:"), "stages")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, FOLDER)
        if k < 4:
            assert out.columns == docs.columns
        out.write.mode("overwrite").parquet(f"{folder}/{k}")
        frame = spark.read.parquet(f"{folder}/{k}")
        counts.append(frame.count())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]
    assert all(b <= a for a, b in zip(counts[:4], counts[1:5])) and counts[4] < counts[0]
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted((r.doc_id, r.copy) for r in whole.collect()) == sorted((r.doc_id, r.copy) for r in frame.collect())


def test_pipeline_leaves_no_benchmark(spark, tmp_path):
    """A document that holds one benchmark item is dropped by the stage."""
    item = " ".join(f"w{i}" for i in range(20))
    spark.createDataFrame([(1, item), (2, "other words " * 10)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "nothing of it"), (3, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.without_benchmarks(spark, docs, str(tmp_path)).collect()) == [2, 3]
