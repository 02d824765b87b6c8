import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from mathframe.llm import bytetext, lattice, simhash, tokencount, winnowing, xxh64
from mathframe.llm.bytetext import BLANK, NOT_ALNUM

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(params=[5, 40, 1 << 21])
def limit(request, monkeypatch):
    """Pieces of different sizes, so that texts are cut."""
    monkeypatch.setattr(bytetext.pieces, "__defaults__", (0, request.param))
    return request.param


def test_words_of_pieces(limit):
    rng = random.Random(1)
    texts = [rng.choice([None, "", "".join(rng.choice("aBé \n1.") for _ in range(rng.randint(1, 90)))]) for _ in range(60)]
    for blank, pattern in ((BLANK, r"[^\x20\x09-\x0D]+"), (NOT_ALNUM, ALNUM)):
        counts = np.zeros(len(texts), int)
        for piece in bytetext.pieces(pa.array(texts), blank):
            data = bytetext.LOWER[piece.data]
            starts, _, segment = bytetext.words(piece, blank, data)
            counts += np.bincount(piece.rows[segment], minlength=len(texts))
        assert counts.tolist() == [len(re.findall(pattern, lower(t))) for t in texts]


def brute_windows(text, items):
    words, hit, found = ALNUM.findall(lower(text)), set(), set()
    for name, item in items:
        of = ALNUM.findall(lower(item))
        k = min(8, len(of))
        windows = {tuple(of[i : i + k]) for i in range(len(of) - k + 1)} if of else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(name)
    return len(words), len(hit), sorted(found)


def test_winnowing(limit):
    rng = random.Random(2)
    for _ in range(60):
        sentence = lambda n: " ".join(rng.choice(["a", "B", "c9", "é", "dd"]) for _ in range(n))
        items = [(str(i), sentence(rng.choice([0, 1, 3, 7, 8, 9, 20]))) for i in range(6)] + [("n", None)]
        texts = [rng.choice(["", None, sentence(rng.randint(1, 60)) + ". x"]) for _ in range(6)]
        block = winnowing.build_block([i for i, _ in items], [t for _, t in items])
        n_words, ranges, numbers = winnowing.scan(pa.array(texts, pa.string()), block)
        got = [(int(w), int(sum(b - a for a, b in r)), sorted(block.items[i] for i in ids)) for w, r, ids in zip(n_words, ranges, numbers)]
        assert got == [brute_windows(t, items) for t in texts]


def test_winnow_guarantee():
    """Every run of hashes as long as the window keeps one, and it depends on the run alone."""
    rng = np.random.default_rng(3)
    gram = rng.integers(0, 50, 500).astype(np.uint64)
    kept = winnowing._winnow(gram, 4)
    assert all(kept[i : i + 4][gram[i : i + 4] == gram[i : i + 4].min()].all() for i in range(497))


def test_xxh64():
    data = random.Random(4).randbytes(4000)
    starts = np.array([random.Random(i).randint(0, 3800) for i in range(3000)])
    ends = starts + np.arange(3000) % 150
    assert xxh64.hash_ranges(data, starts, ends, 42).tolist() == [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(starts, ends)]


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(limit):
    rng = random.Random(5)
    texts = [rng.choice([None, "", " \n ", "".join(rng.choice("aBé \n\t") for _ in range(rng.randint(1, 80)))]) for _ in range(80)]
    assert simhash.text_fingerprints(pa.array(texts)).tolist() == [brute_simhash(t) for t in texts]


def test_tokens():
    tokens = pytest.importorskip("public_tokenizers")
    path = tokens.path("byte_bpe_50k.json")
    tokenizer = tokencount.load(path)
    with open(path, encoding="utf-8") as file:
        tokencount.check_file(file.read())
    with open(tokens.path("word_bpe_49k.json"), encoding="utf-8") as file, pytest.raises(ValueError):
        tokencount.check_file(file.read())
    rng = random.Random(6)
    parts = [" ", "  ", "\n", "a", "b", "the", "é", "1", " ", "<|endoftext|>", "'s", "'", ".", "!", "\x1c", "\x85", "汉", "!!", ",", ":", "|", "x<|", "|>"]
    for size in (3, 10, 1 << 21):
        texts = [rng.choice([None, "", "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))]) for _ in range(400)]
        n_bytes, n_tokens = tokencount.Counter(tokenizer, size).column(pa.array(texts))
        assert n_bytes.tolist() == [len((t or "").encode()) for t in texts]
        assert n_tokens.tolist() == [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_lattice():
    x = np.random.default_rng(7).normal(0, 2, (300, 8))
    points = lattice.nearest(x)
    distance = ((x - points) ** 2).sum(axis=1)
    others = ((x[:, None] - points[:, None] - lattice.ROOTS) ** 2).sum(axis=2)
    assert (others.min(axis=1) >= distance - 1e-9).all() and distance.max() <= 1 + 1e-9
    twice = np.rint(points * 2)
    assert ((twice % 2 == twice[:, :1] % 2).all(axis=1) & (points.sum(axis=1) % 2 == 0)).all() and len(lattice.ROOTS) == 240
    best = np.sort(others, axis=1)[:, :2]
    assert np.allclose(((x[:, None] - lattice.neighbours(x, points, 2)) ** 2).sum(axis=2), best)


def test_position_triples():
    from itertools import combinations

    assert all(any(set(t) <= set(four) for t in simhash._position_triples()) for four in combinations(range(8), 4))
