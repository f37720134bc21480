"""Sharding, secrets, winnowing and SimHash against plain versions on small fixtures."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from myospark.llm import secrets, sharding, simhash, winnowing
from myospark.llm.components import connected
from myospark.llm.words import BETWEEN_BLANKS, LETTERS, Splitter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, texts, extra=True):
    """Documents of these texts, with columns that clash with results."""
    rows = [(i if isinstance(i, int) or i is None else int(i), t, "en", f"s{(i or 0) % 3}", None) for i, t in texts]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = {c: F.lit("x") for c in ("shard", "slot", "fingerprint", "score", "keep", "hashes", "row", "size")}
    return df.withColumns(clash) if extra else df


def prose(n, seed):
    rng = random.Random(seed)
    words = ["the", "of", "and", *("".join(rng.choice("aeiouklmnrst") for _ in range(rng.randint(3, 8))) for _ in range(300))]
    return " ".join(rng.choice(words) for _ in range(n))


ODD = [(0, "a b c"), (1, None), (2, ""), (3, "a b c"), (4, " \t\n"), (5, "é ü ß 漢字 😀"), (6, "A  B\nC"), (None, "null id"), (7, prose(30_000, 1)), (3, "a b c")]


# sharding


def plain_jump(key, n):
    b, j, key = -1, 0, key % (1 << 64)
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), min_size=1), st.integers(1, 200))
def test_jump_hash(keys, n):
    one, more = sharding.jump_hash(np.array(keys), n), sharding.jump_hash(np.array(keys), n + 1)
    assert one.tolist() == [plain_jump(k, n) for k in keys]
    assert all(a == b or b == n for a, b in zip(one, more, strict=True))


def test_shard_report(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 50)
    texts = [*ODD, *((1000 + i, f"t{i}") for i in range(300)), *((42, "same") for _ in range(200)), *((42, f"other {i}") for i in range(50))]
    got = sharding.shard_report(corpus(spark, texts)).collect()
    assert len(got) == len(texts)
    for s in range(8):
        rows = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in rows] == list(range(len(rows)))
        ids = [-(1 << 63) if r["doc_id"] is None else r["doc_id"] for r in rows]
        assert ids == sorted(ids)
    for r in got:
        assert r["shard"] == plain_jump(r["doc_id"] or 0, 8) and r["grown_shard"] in (r["shard"], 8)
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in texts)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want


def test_write_shards(spark, tmp_path):
    docs = corpus(spark, [(i, "x") for i in range(100)])
    sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100
    assert all(r["shard"] == plain_jump(r["doc_id"], 8) for r in back.select("doc_id", "shard").collect())


# secrets

BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def plain_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m)]
    return [f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


def secret_texts():
    rng, out = random.Random(5), []
    pieces = ["é ", "token", " = ", ": ", "secret", "API_KEY", '"', "'", "abc123", "x" * 5, "AKIA" + "Q1" * 8, "AKIA12", "0a" * 12, "deadbeef", "paſſword: abcdefgh", "Toɡen=", "\n", "tokenAKIA=", "passwd=AKIA" + "Z" * 20, "ghp_" + "aB3" * 13, "=", "K", "apiKey: 1234567"]
    for i in range(300):
        out.append((i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))))
    return out


def test_secret_spans(spark):
    texts = [*secret_texts(), *[(1000 + (i or 0), t) for i, t in ODD]]
    got = {r["doc_id"]: r for r in secrets.secret_report(corpus(spark, texts)).collect()}
    assert len(got) == len({i for i, _ in texts})
    for i, t in secret_texts():
        want, have = plain_spans(t), [s for s in got[i]["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex")]
        assert have == want, t
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]


def test_ownership(spark):
    copied, own = "token = Zx9Qw3Er7Ty1Ui5", "token = Mn8Bv4Cx2Za6Lk0"
    rows = [(i, copied, f"s{i % 5}") for i in range(200)] + [(500, own, "s1"), (501, "token = aaaaaaaaaaaa", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in secrets.secret_report(docs).collect()}
    assert all((got[i]["n_live"], got[i]["n_copied"]) == (0, 1) for i in range(200))
    assert (got[500]["n_live"], got[500]["spans"]) == (1, "assign:0:23,live:8:23")
    assert (got[501]["n_live"], got[501]["n_copied"]) == (0, 0)
    assert secrets.secret_report(docs.limit(0)).count() == 0


# winnowing


def plain_winnow(text, k, w):
    chars = [(c.lower() if "A" <= c <= "Z" else c, i) for i, c in enumerate(text) if ord(c) > 32 and c not in " 　"]
    if not chars:
        return []
    k = min(k, len(chars))
    hashes = winnowing.rolling(np.array([ord(c) for c, _ in chars], np.uint64), k)
    for i in (0, len(chars) - k):  # the rolling hash is that of the k-gram alone
        assert hashes[i] == winnowing.rolling(np.array([ord(c) for c, _ in chars[i : i + k]], np.uint64), k)[0]
    low, out = [int(h) >> 24 for h in hashes], []
    for i in range(len(hashes) - min(w, len(hashes)) + 1):
        window = range(i, i + min(w, len(hashes)))
        at = min(window, key=lambda j: (low[j], -j))
        if at not in out:
            out.append(at)
    return [(int(hashes[j]), chars[j][1]) for j in out]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB é\n漢", max_size=120), st.integers(1, 6), st.integers(1, 9))
def test_winnow(text, k, w):
    h, at = winnowing.winnow(winnowing.code_points(text), k, w)
    assert list(zip(h.tolist(), at.tolist(), strict=True)) == plain_winnow(text, k, w)


def test_match_guarantee():
    a, b, shared = prose(200, 2), prose(200, 3), prose(60, 4)
    t = winnowing.K + winnowing.W - 1
    shared = shared[: t + shared[:t].count(" ") + 40]
    one, two = (winnowing.winnow(winnowing.code_points(x + " " + shared + " " + x[::-1]))[0] for x in (a, b))
    assert len(np.intersect1d(one, two))


def test_chunks_of_long_texts(monkeypatch):
    text = winnowing.code_points(prose(2000, 6))
    whole = winnowing.winnow(text)
    monkeypatch.setattr(winnowing, "CHUNK", 100)
    np.testing.assert_array_equal(whole[1], winnowing.winnow(text)[1])


def test_compare_edits(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "RANGE_ROWS", 3)
    texts = [(i, t) for i, t in ODD[:-1] if i is not None] + [(50 + i, prose(40 + i, i)) for i in range(12)]
    got = {r["doc_id"]: r for r in winnowing.compare_edits(corpus(spark, texts)).collect()}
    assert len(got) == len(texts)
    order = sorted(texts)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        prints = [winnowing.winnow(winnowing.code_points(x)) for x in (t, edited, after)]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (winnowing.digest(prints[0]), winnowing.digest(prints[1]))
        sets = [set(p[0].tolist()) for p in prints]
        jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert r["near_edited"] == pytest.approx(jaccard(sets[0], sets[1])) and r["near_next"] == pytest.approx(jaccard(sets[0], sets[2]))
    assert winnowing.compare_edits(corpus(spark, ODD)).count() == len(ODD)
    assert winnowing.compare_edits(corpus(spark, ODD).limit(0)).count() == 0
    assert winnowing.fingerprints(corpus(spark, ODD)).count() == len(ODD)


# SimHash


def plain_simhash(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(prints, radius):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_masks_cover_every_pair():
    rng = random.Random(0)
    for radius in (1, 2, 3):
        masks = simhash.masks(radius, list(range(64)))
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(300):
            x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
            assert any(x & m == 0 for m in masks)


@pytest.mark.parametrize("large", [2048, 20])
def test_links_against_all_pairs(spark, monkeypatch, large):
    """Clusters around few centres; with a low bound, buckets are dealt again."""
    monkeypatch.setattr(simhash, "LARGE", large)
    rng, prints = random.Random(7), {0, 1, (1 << 64) - 1}
    for _ in range(12):
        c = rng.getrandbits(64)
        for _ in range(25):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            prints.add(x)
            c = x if rng.random() < 0.2 else c
    prints = sorted(prints)
    frame = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fingerprint long")
    roots = {r["vertex"] % (1 << 64): r["root"] for r in connected(simhash.links(frame, 3)).collect()}
    want = plain_components(prints, 3)
    groups, have = {}, {}
    for p, w in zip(prints, want, strict=True):
        groups.setdefault(w, set()).add(p)
        have.setdefault(roots.get(p, ("alone", p)), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, have.values()))


def test_simhash_report(spark):
    base = prose(200, 8)
    near = [(100 + i, base + f" tail{i}") for i in range(10)]
    texts = [*ODD, *near, (90, base), *((200 + i, prose(50, 20 + i)) for i in range(20))]
    got = simhash.simhash_report(corpus(spark, texts)).collect()
    assert len(got) == len(texts)
    known = [(i, plain_simhash(t, 3)) for i, t in texts]
    want, least = plain_components([p for _, p in known], 3), {}
    for (i, _), w in zip(known, want, strict=True):
        least[w] = min(x for x in (least.get(w), i) if x is not None) if i is not None or w in least else None
    assert sorted(map(str, ((i, f"{p:016x}", least[w]) for (i, p), w in zip(known, want, strict=True)))) == sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got)
    kept = {r["doc_id"] for r in simhash.keep_one(corpus(spark, texts), radius=5).collect()}
    assert 90 in kept and not {i for i, _ in near} & kept and {200 + i for i in range(20)} <= kept
    assert simhash.simhash_report(corpus(spark, ODD).limit(0)).count() == 0


def test_components_of_chains(spark):
    rng = random.Random(3)
    names = rng.sample(range(10_000), 400)
    edges = [(names[i], names[i + 1]) for i in range(399) if i != 200]
    got = {r["vertex"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(names)
    assert {got[n] for n in names[:201]} == {min(names[:201])} and {got[n] for n in names[201:]} == {min(names[201:])}


# near copies


def plain_sets(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def near_texts():
    """Copies around few texts and chains of them, from 0.7 to 1 alike, and a text with a passage of all others."""
    rng, texts = random.Random(11), []
    for c, size in enumerate([8, 40, 40, 120, 120, 300, 300, 300]):
        base = prose(size, 700 + c).split()
        for i in range(14):
            words = list(base)
            for j in rng.sample(range(size), min(size, rng.randint(0, max(1, size // 40)))):
                words[j] = f"x{rng.randrange(9)}"
            texts.append((1000 + 100 * c + i, " ".join(words).title()))
            base = words if rng.random() < 0.2 else base
    shared = prose(60, 900)
    texts += [(3000 + i, f"{shared} {prose(rng.randint(5, 40), 950 + i)}") for i in range(30)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("count_docs", [8000, 1])
def test_pipeline_near_copies_against_all_pairs(spark, monkeypatch, count_docs):
    """The pipeline's stage keeps the least document of each component of pairs at 0.8 or more."""
    import corpus_pipeline
    from myospark.llm import nearcopies

    monkeypatch.setattr(nearcopies, "COUNT_DOCS", count_docs)
    texts = near_texts()
    sets, root = [plain_sets(t, 5) for _, t in texts], list(range(len(texts)))
    close = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                close += 10 * len(a & b) < 9 * len(a | b)
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    assert close > 50
    want = {min(texts[i][0] for i in range(len(texts)) if root[i] == r) for r in set(root)}
    got = {r["doc_id"] for r in corpus_pipeline.drop_copies(spark, corpus(spark, texts), "").collect()}
    assert got == want


def test_near_copies_of_odd_texts(spark):
    from myospark.llm import nearcopies

    kept = sorted(str(r["doc_id"]) for r in nearcopies.keep_one(corpus(spark, ODD)).collect())
    assert kept == ["0", "1", "5", "7", "None"]
    assert nearcopies.keep_one(corpus(spark, ODD).limit(0)).count() == 0


# words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB éÉ1.\n\t漢", max_size=12), min_size=1, max_size=6))
def test_splitter(texts):
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for flags, lower, split in ((BETWEEN_BLANKS, True, lambda x: x.lower().split()), (LETTERS, False, lambda x: re.findall(rb"[0-9A-Za-z\x80-\xff]+", x))):
        hashes, starts, stops = Splitter(flags, lower).of(data, offsets)
        want = [w for x in raw for w in split(x)]
        have = [data[a:z].tobytes() for a, z in zip(starts, stops, strict=True)]
        assert [h.lower() if lower else h for h in have] == want
        assert len({*hashes.tolist()}) == len(set(want)) == len(set(zip(hashes.tolist(), want, strict=True)))
