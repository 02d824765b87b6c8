"""Operators on small tables with nulls, empty and repeated rows, ties and clashing columns."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mathframe.llm import components, embdedup, langid, mixing, pii, quality, sampling, simhash, storage, tokencount, toxicity, winnowing


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_components(spark):
    rng = random.Random(1)
    scratch = storage.Scratch(spark)
    cases = {"chain": [(i, i + 1) for i in range(40)], "random": [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)], "none": [], "null": [(None, 1), (2, 2)]}
    for name, links in cases.items():
        root = {}

        def find(x):
            root.setdefault(x, x)
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            if a is not None and a != b:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
        found = components.connected_components(spark.createDataFrame(links, "a long, b long"), scratch, name)
        assert {r.node: r.component for r in found.collect()} == {x: find(x) for x in root}


def test_simhash_components(spark):
    rng = random.Random(2)
    text = [rng.choice("abcdefghij") * 3 + str(rng.randint(0, 99)) for _ in range(400)]
    near = " ".join(text[:200] + ["other"] + text[201:])
    texts = [(5, " ".join(text)), (3, near), (9, " ".join(text)), (9, " ".join(text)), (7, None), (8, ""), (None, " \n"), (1, "quite another text of a few words")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("node", F.lit(1))
    found = simhash.near_duplicates(docs)
    prints = {i: p for i, p, _ in rows(found, "doc_id", "simhash", "component_id")}
    pairs = [(a, b) for a in prints for b in prints if a is not None and b is not None and bin((prints[a] ^ prints[b]) & (1 << 64) - 1).count("1") <= 4]
    for i, _, c in rows(found, "doc_id", "simhash", "component_id"):
        if i is not None:
            assert c == min(b for a, b in pairs if a == i) or c in {b for _, b in pairs}
    assert {c for i, _, c in rows(found, "doc_id", "simhash", "component_id") if i in (7, 8, None)} == {7}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for i, _, c in rows(found, "doc_id", "simhash", "component_id") if i is not None})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4, 512])
def test_fingerprint_links_against_all_pairs(spark, block):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    values = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(25)}
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    frame = spark.createDataFrame(list(zip(signed, range(len(signed)))), "fp long, node long")
    scratch = storage.Scratch(spark)
    links = simhash.fingerprint_links(frame, scratch, 4, block)
    found = {r.node: r.component for r in components.connected_components(links, scratch).collect()}
    root = list(range(len(signed)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ordered = sorted(values)
    for i in range(len(signed)):
        for j in range(i):
            if bin((signed[i] ^ signed[j]) & (1 << 64) - 1).count("1") <= 4:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert len(ordered) == len(signed) and [found.get(i, i) for i in range(len(signed))] == [find(i) for i in range(len(signed))]


def brute_links(vectors, cosine=0.95):
    ok = {i: np.array(v, float) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.abs(v).max() for i, v in ok.items()}
    unit = {i: v / np.sqrt((v * v).sum()) for i, v in unit.items()}
    return {i: {j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine} for i in unit}


@pytest.mark.parametrize("full, block", [(64, 512), (3, 4)])
def test_embeddings(spark, full, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 64))
    vectors = [(i, (centres[i % 6] + rng.normal(0, 0.12, 64)).tolist()) for i in range(60)] + [(100 + i, rng.normal(size=64).tolist()) for i in range(20)]
    vectors += [(200, vectors[0][1]), (201, [2 * x for x in vectors[0][1]]), (202, None), (203, [0.0] * 64), (204, [float("nan")] + [1.0] * 63), (205, [None] + [1.0] * 63), (206, [1.0] * 3), (207, [])]
    vectors += [(208, [1e200 * x for x in vectors[0][1]]), (209, [1e-200 * x for x in vectors[0][1]]), (210, [1.0] * 32), (211, [3.0] * 32), (212, [1.0] * 31 + [1.1])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("h1", F.lit("x"))
    found = {r.vec_id: r for r in embdedup.near_duplicates(frame, full=full, block=block).collect()}
    links = brute_links(vectors)
    total = sum(len(x) for x in links.values())
    assert len(found) == len(vectors) and sum(r.n_links for r in found.values()) >= 0.9 * total > 0
    assert all(found[i].n_links <= len(links.get(i, ())) for i, _ in vectors)
    for i in (200, 208, 209, 210, 211):
        assert found[i].n_links == len(links[i]) >= 1
    met = lambda i: {i} | {j for j in found if found[j].component_id == found[i].component_id}
    assert all(r.component_id == min(met(i)) and r.kept == (i == r.component_id) for i, r in found.items())
    assert all(links[i] <= met(i) for i in (0, 208, 210)) and all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i in range(202, 208))
    assert embdedup.near_duplicates(frame.limit(0)).count() == 0


def test_one_id_with_two_vectors(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=16).tolist(), rng.normal(size=16).tolist()
    frame = spark.createDataFrame([(1, x), (1, y), (2, x), (3, y), (4, [-v for v in x])], "vec_id long, embedding array<double>")
    assert rows(embdedup.near_duplicates(frame), "vec_id", "n_links", "component_id") == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


def test_recall_by_cosine():
    """Of pairs at a cosine just above the border nine tenths meet in a cell, at the least."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    hasher = embdedup.Hasher(64)
    own, probes = hasher.cells(x)
    for cosine in (0.95, 0.97):
        own2, probes2 = hasher.cells(cosine * x + math.sqrt(1 - cosine**2) * side)
        met = (own == own2).any(axis=1) | (probes == own2[:, :, None]).any(axis=(1, 2)) | (own[:, :, None] == probes2).any(axis=(1, 2))
        assert met.mean() >= 0.98


def test_words_of_one_rolling_hash(spark):
    """Thue-Morse words and their complements, which share any polynomial hash modulo 2^64, stay apart."""
    bits = [0]
    while len(bits) < 2048:
        bits += [1 - b for b in bits]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    docs = spark.createDataFrame([(1, f"{one} {two}"), (2, one), (3, two)], "doc_id long, text string")
    items = spark.createDataFrame([("i", one)], "item_id string, text string")
    found = {r.doc_id: len(r.hit_items) for r in winnowing.find_contamination(docs, items).collect()}
    assert found == {1: 1, 2: 1, 3: 0}
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs, path).collect()}
    assert got == {r.doc_id: len(library.encode(r.text, add_special_tokens=False)) for r in docs.collect()}


def test_mixing(spark):
    rng = random.Random(6)
    docs = [(i, "w " * rng.randint(0, 9), rng.choice(["a", "b", "c", "d", None])) for i in range(300)] + [(None, None, "e"), (7, "x y", "a"), (7, "x y", "a")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("target", F.lit("clash"))
    got = mixing.mix(frame)
    assert got.columns == ["doc_id", "text", "source", "size", "source_size", "target", "repeats", "taken"]
    size = lambda t: len((t or "").split())
    sources = sorted({s for _, _, s in docs if s}) + [None]
    total = {s: sum(size(t) for _, t, x in docs if x == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, pot, free = {}, 1.5 * sum(total.values()), list(sources)
    while free:
        level = pot / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * total[s]]
        for s in over or free:
            target[s] = 2 * total[s] if over else level * weight[s]
        pot -= sum(2 * total[s] for s in over)
        free = [s for s in free if s not in over] if over else []
    found = got.collect()
    for r in found:
        assert r.size == size(r.text) and r.source_size == total[r.source] and r.target == pytest.approx(target[r.source]) and r.taken == r.size * r.repeats <= 2 * r.size
    for s in sources:
        assert abs(sum(r.taken for r in found if r.source == s) - target[s]) <= 9
    assert rows(got, "doc_id", "taken") == rows(mixing.mix(frame), "doc_id", "taken")
    assert mixing.mixed_rows(frame).count() == sum(r.repeats for r in found)
    assert mixing.mix(frame.limit(0)).count() == 0


def test_winnowing_blocks(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, " ".join(words[10:30])), (3, " ".join(words[10:30])), (4, "nothing")], "doc_id long, text string").withColumn("hits", F.lit(0)).withColumn("N_WORDS", F.lit(0)).drop("N_WORDS")
    items = spark.createDataFrame([(10, " ".join(words[5:20])), (11, " ".join(words[25:40])), (12, "w1 w2"), (13, None), (None, " ".join(words[50:60]))], "item_id long, text string")
    one = winnowing.find_contamination(docs, items)
    many = winnowing.find_contamination(docs, items, block_words=8)
    view = lambda df: rows(df, "doc_id", "n_words", "hit_ranges", "hit_items")
    assert view(one) == view(many)
    assert view(one)[0][2] == [(1, 3), (5, 20), (25, 40), (50, 60)] and view(one)[0][3] == ["", "10", "11", "12"]
    assert rows(winnowing.decontaminate(docs, items), "doc_id") == [(2,), (3,), (3,), (4,)]
    assert one.select(winnowing.items_digest().alias("d")).first().d == winnowing.reference_digest(["", "10", "11", "12"])
    assert winnowing.find_contamination(docs, items.limit(0)).where("size(hit_items) > 0").count() == 0


def test_distributed_winnowing(spark):
    """Benchmarks that are broadcast and those that are joined give the same rows."""
    rng = random.Random(12)
    sentence = lambda n: " ".join(rng.choice(["a", "B", "c9", "é", "dd", "e"]) for _ in range(n))
    items = [(i, sentence(rng.choice([0, 1, 3, 7, 8, 9, 20, 40]))) for i in range(30)] + [(99, None), (None, sentence(12)), (5, sentence(12))]
    texts = [sentence(rng.randint(0, 80)) + ". x" for _ in range(60)] + [" and ".join(t or "" for _, t in items), "", None] * 2
    docs = spark.createDataFrame([(i // 2, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, t1 int").withColumn("a.b", F.lit(0))
    frame = spark.createDataFrame(items, "item_id long, text string")
    view = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    for options in ({}, {"window": 5, "gram": 2}, {"window": 3, "gram": 3}):
        one, many = (winnowing.find_contamination(docs, frame, block_words=n, **options) for n in (10**6, 8))
        assert one.columns == many.columns and view(one) == view(many)
    assert winnowing.find_contamination(docs.limit(0), frame, block_words=8).count() == 0


def test_pseudonyms(spark):
    texts = [(1, "mail ann.lee7@mail.example.com, card 4111111111111111 or 4111-1111-1111-1111, +1 (017) 555-7713"), (2, None), (3, ""), (4, "ip 233.254.104.120 and 999.1.1.1, 2024-02-29 29.02.2024 30/02/2024, 123-45-6789 000-12-1234"), (5, "again ann.lee7@mail.example.com 4111111111111111"), (6, "4111111111111112 GB82WEST12345698765432 GB83WEST12345698765432"), (7, "plain")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_values", F.lit("clash"))
    out = {r.doc_id: r for r in pii.pseudonymise(docs, "key").collect()}
    assert [out[i].n_values for i in range(1, 8)] == [4, 0, 0, 4, 2, 1, 0] and out[2].text is None and out[3].text == "" and out[7].text == "plain"
    mail, card = re.search(r"\S+@mail.example.com", out[1].text)[0], re.search(r"card (\d{16})", out[1].text)[1]
    assert mail in out[5].text and card in out[5].text and "ann.lee7" not in out[1].text and re.fullmatch(r"[a-z]{3}\.[a-z]{3}\d@mail\.example\.com", mail)
    assert card[:4] + "-" + card[4:8] in out[1].text
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    assert luhn(card) and "999.1.1.1" in out[4].text and "30/02/2024" in out[4].text and "000-12-1234" in out[4].text and "4111111111111112" in out[6].text
    iso, dotted = re.search(r"(\d{4})-(\d\d)-(\d\d)", out[4].text), re.search(r"(\d\d)\.(\d\d)\.(\d{4})", out[4].text)
    assert iso.groups() == dotted.groups()[::-1] and iso[0] != "2024-02-29"
    iban = re.search(r"GB\d{2}[A-Z]{4}\d{14}", out[6].text)[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and "GB83WEST12345698765432" in out[6].text
    other = {r.doc_id: r for r in pii.pseudonymise(docs, "another").collect()}
    assert other[1].text != out[1].text
    assert pii.pseudonymise(docs.limit(0), "key").count() == 0


@pytest.mark.parametrize("a, b, kind", [(27, 5411, "date"), (7, 13, "x"), (1, 10, "y")])
def test_numbers_are_permuted(spark, a, b, kind):
    found = spark.range(a * b).select(pii.permute_number(F.col("id"), a, b, kind, F.lit("k")).alias("p")).agg(F.count_distinct("p"), F.min("p"), F.max("p")).first()
    assert tuple(found) == (a * b, 0, a * b - 1)


def test_texts_are_permuted(spark):
    found = spark.range(10_000).select(pii.permute_text(F.lpad(F.col("id").cast("string"), 4, "0"), "x", F.lit("k")).alias("p"))
    assert found.distinct().count() == 10_000 and found.where("not p rlike '^[0-9]{4}$'").count() == 0


def _labelled(spark, count=600):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))
    bad_words = ["zorkish", "grumblax", "vextrun"]
    docs, labels = [], []
    for i in range(count):
        words = [word() for _ in range(rng.randint(20, 120))]
        toxic, junk = i % 5 == 0, i % 4 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad_words))
        docs.append((i, " ".join(w + "###" for w in words) if junk else " ".join(words)))
        if i % 2 or i % 5 == 0 or i % 4 == 0:
            labels.append((i, int(not junk), int(toxic)))
    docs += [(count, None), (count + 1, ""), (None, "some text"), (3, docs[3][1])]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")), spark.createDataFrame(labels + labels[:3] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = _labelled(spark)
    held = sampling.fold("doc_id", 3) == 1
    model = toxicity.fit(docs, labels, learn_from=~held)
    scored = toxicity.score_toxicity(docs, model)
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    truth = scored.where(held).where("doc_id < 600").select(((F.col("doc_id") % 5 == 0).cast("int") == F.col("predicted")).cast("double").alias("right"))
    assert truth.agg(F.avg("right")).first()[0] > 0.95
    assert rows(scored, "doc_id", "score") == rows(toxicity.score_toxicity(docs, toxicity.fit(docs, labels, learn_from=~held)), "doc_id", "score")
    none = toxicity.fit(docs, labels.limit(0), learn_from=~held)
    assert toxicity.score_toxicity(docs, none).agg(F.max("score")).first()[0] < 1e-6
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_quality(spark):
    docs, labels = _labelled(spark)
    held = sampling.fold("doc_id", 5) == 0
    net = quality.fit(docs, labels, learn_from=~held, sample=200)
    scored = quality.score_quality(docs, net)
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    truth = scored.where(held).where("doc_id < 600").select(((F.col("doc_id") % 4 != 0).cast("int") == F.col("predicted")).cast("double").alias("right"))
    assert truth.agg(F.avg("right")).first()[0] > 0.95
    none = quality.score_quality(docs, quality.fit(docs, labels.limit(0), learn_from=~held)).agg(F.min("score")).first()[0]
    assert none > 0.99 and quality.score_quality(docs.limit(0), net).count() == 0


def test_quality_gradients_and_slabs(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    net = quality.new_network()
    net.tables = net.tables.astype(np.float64)
    size = 2 * quality.STEP + quality.WIDTH - 1
    chunks = [rng.integers(0, 256, (n, size)).astype(np.uint8) for n in (1, 3)]
    labels, weights = np.array([0.0, 1.0]), np.array([1.0, 2.0])

    def loss():
        total = 0
        for c, y, w in zip(chunks, labels, weights):
            r = sum(net.tables[j][c[:, j : j + 2 * quality.STEP]] for j in range(quality.WIDTH)).max(axis=1)
            h = np.maximum(np.maximum(r + net.shift, 0) @ net.hidden + net.hidden_shift, 0).mean(axis=0)
            s = 1 / (1 + np.exp(-(h @ net.out + net.out_shift[0])))
            total -= w * (y * np.log(s) + (1 - y) * np.log(1 - s))
        return total / weights.sum()

    grads = quality._gradients(net, chunks, labels, weights)
    for array, grad in zip(net.arrays()[1:], grads[1:]):
        array, at = array.reshape(-1), 0
        array[at] += 1e-3
        up = loss()
        array[at] -= 2e-3
        down = loss()
        array[at] += 1e-3
        assert grad.reshape(-1)[at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-4)
    net = quality.new_network()
    texts = pa.array(["".join(random.Random(i).choice("ab cd.") for _ in range(n)) for i, n in enumerate((0, 1, 127, 128, 129, 700, 5000))] + [None])
    whole = quality.score_texts(net, quality.pair_tables(net), texts)
    monkeypatch.setattr(quality, "SLAB", 512)
    assert np.allclose(whole, quality.score_texts(net, quality.pair_tables(net), texts))
    assert np.allclose(whole, [quality.score_texts(net, quality.pair_tables(net), texts.slice(i, 1))[0] for i in range(len(texts))])


def test_languages(spark):
    rng = random.Random(9)
    sound = {"en": "thandwerying", "de": "schungeiterb", "fr": "eauxtionouêé"}
    sentence = lambda lang, n: " ".join("".join(rng.choice(sound[lang]) for _ in range(rng.randint(2, 8))) for _ in range(n))
    docs = spark.createDataFrame([(i, sentence(lang, 60), lang) for i, lang in enumerate(["en", "de", "fr"] * 20)] + [(None, None, None), (99, None, "en")], "doc_id long, text string, lang string")
    pages, truth = [], {}
    for i in range(60):
        lang = ["en", "de", "fr"][i % 3]
        truth[i] = lang
        declared = f' lang="{lang}-XX"' if i % 2 else ""
        pages.append((i, f"http://h{i % 7}.example.{'org' if i % 4 else lang}/p", f"<html{declared}><script>if (a < b) x('the')</script><p>{sentence(lang, 15)}</p></html>"))
    pages += [(100, None, None), (101, "not a url", ""), (102, "https://a.example.de/", "<html lang=de></html>"), (None, "x", "<p>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = {r.page_id: r for r in langid.identify(frame, docs).collect()}
    assert len(found) == len(pages) and sum(found[i].language == t for i, t in truth.items()) >= 58
    assert found[102].language == "de" and found[100].language in sound and 0 < found[100].probability <= 1
    assert all(r.language is None for r in langid.identify(frame, docs.limit(0)).collect()) and langid.identify(frame.limit(0), docs).count() == 0


def test_token_counts(spark):
    tokens = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, ""), (4, "word " * 1100), (4, "word " * 1100)], "doc_id long, text string").withColumn("n_bytes", F.lit("clash"))
    out = tokencount.count_tokens(docs, tokens.path("byte_bpe_50k.json"))
    assert out.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    assert rows(out, "doc_id", "n_bytes", "n_tokens", "over_limit")[:2] == [(1, 3, 2, False), (2, 0, 0, False)] and out.where("over_limit").count() == 2
    assert tokencount.count_tokens(docs.limit(0), tokens.path("byte_bpe_50k.json")).count() == 0


def test_many_languages(spark):
    """Fifty languages are one sample and one fusion, not a job for each."""
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{chr(97 + k // 26)}{chr(97 + k % 26)}": ["".join(rng.choice(letters) for _ in range(4)) for _ in range(6)] for k in range(50)}
    docs = spark.createDataFrame([(i, lang, " ".join(rng.choices(parts, k=30))) for i, (lang, parts) in enumerate([x for x in own.items() for _ in range(3)])], "doc_id long, lang string, text string")
    pages = [(i, f"http://h{i}.example/", f"<p>{' '.join(rng.choices(parts, k=20))}</p>") for i, parts in enumerate(own.values())]
    jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId
    before = jobs()
    found = langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("a.b", F.lit(1)).withColumn("HOST", F.lit(2)), docs)
    got = {r.page_id: r.language for r in found.collect()}
    assert sum(got[i] == lang for i, lang in enumerate(own)) >= 48
    assert jobs() - before < 60


def test_clashing_columns(spark):
    """Columns named like helpers, in other cases and with dots stay as they are."""
    strange = ["_source", "_id", "_text", "_found", "gone", "Values", "a.b", "missing", "CUT"]
    docs = spark.createDataFrame([(1, "web", "call me at (555) 123-4567 or write to someone"), (2, None, "another text of other words"), (2, None, "another text of other words")], "doc_id long, source string, text string")
    docs = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(strange)))
    for out in (mixing.mix(docs), pii.pseudonymise(docs, "k"), simhash.keep_one(docs), winnowing.decontaminate(docs, docs.selectExpr("'i' as item_id", "'no such words at all here' as text").limit(1), least_items=1)):
        kept = [c for c in out.columns if c in docs.columns]
        assert kept == docs.columns and all([r[c] for c in strange] == list(range(len(strange))) for r in out.collect())
    sized = mixing.mix(docs.withColumn("Size", F.lit(-1)))
    assert [c.lower() for c in sized.columns].count("size") == 1
