"""Line deduplication, language models, packing, decontamination and classifiers on small fixtures."""

from __future__ import annotations

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from myospark.llm import cotraining, crossentropy, decontamination, linear, linejoin, packing, toxicity
from tests.llm.test_small_operators import ODD, corpus, prose

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


# lines


def line_fixture():
    rng, out = random.Random(1), []
    base = [prose(rng.randint(1, 90), 100 + i) for i in range(40)]
    for i in range(120):
        lines = []
        for _ in range(rng.randint(1, 5)):
            words = rng.choice(base).split()
            for _ in range(rng.randint(0, max(1, len(words) // 8))):
                words[rng.randrange(len(words))] = rng.choice(["new", "The", "word", f"w{rng.randrange(50)}"])
            lines.append(" ".join(words))
        out.append((i, "\n".join(lines)))
    return out + [(500 + (i or 0), t) for i, t in ODD[:-1]]


def plain_lines(texts):
    lines = [((i, j), frozenset(line.encode().lower().split())) for i, t in texts for j, line in enumerate((t or "").split("\n"))]
    lines = [(p, s) for p, s in lines if s]
    sets = {s for _, s in lines}
    alike = {s: [o for o in sets if o != s and 9 * len(s & o) >= 4 * (len(s) + len(o))] for s in sets}
    first = {}
    for p, s in sorted(lines, key=lambda x: x[0]):
        first.setdefault(s, p)
    return {p: (len(alike[s]), any(first[o] < p for o in [s, *alike[s]])) for p, s in lines}


@pytest.mark.parametrize("group", [1024, 3])
def test_lines_against_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(linejoin, "GROUP", group)
    monkeypatch.setattr(linejoin, "BUFFER", 500)
    texts = line_fixture()
    got = {(r["doc_id"], r["line_no"]): (r["n_links"], r["removed"]) for r in linejoin.line_report(corpus(spark, texts)).collect()}
    assert got == plain_lines(texts)


def test_remove_lines(spark):
    keep = prose(20, 1)
    texts = [(1, f"{keep}\nshared line of five words"), (2, f"own words here\nshared line of five words\n\n{prose(9, 2)}"), (3, keep), (None, keep), (4, ""), (5, None)]
    got = {r["doc_id"]: r["text"] for r in linejoin.remove_lines(corpus(spark, texts)).collect()}
    # the row without an id comes first, and keeps its line
    assert got == {1: "shared line of five words", 2: f"own words here\n\n{prose(9, 2)}", None: keep, 4: "", 5: None}
    assert linejoin.remove_lines(corpus(spark, ODD).limit(0)).count() == 0


# language models


def test_cross_entropy_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(crossentropy, "BLOCK_TOKENS", 60)
    texts = [*ODD, *((50 + i, prose(20 + i, i % 4)) for i in range(20))]  # with a repeated row and a long text
    good = {51, 55, 60, 61}
    got = crossentropy.score_documents(corpus(spark, texts), spark.createDataFrame([(i,) for i in [*good, 51, None]], "doc_id long")).collect()
    assert len(got) == len(texts)
    split = {i: (t or "").encode().lower().split() for i, t in texts}
    kinds = len({w for ws in split.values() for w in ws}) + 1
    single, both = [Counter(), Counter()], [Counter(), Counter()]
    for i, t in texts:
        ws = split[i]
        for k in (0, 1) if i in good else (0,):
            if ws:
                single[k].update([*ws, b""])
                both[k].update(zip([b"", *ws], [*ws, b""], strict=True))
    for r in got:
        ws = split[r["doc_id"]]
        if not ws:
            assert (r["n_tokens"], r["score"]) == (0, None)
            continue
        loss = [0.0, 0.0]
        for h, w in zip([b"", *ws], [*ws, b""], strict=True):
            for k in (0, 1):
                p = (single[k][w] + 1) / (single[k].total() + kinds)
                loss[k] -= math.log((both[k][h, w] + crossentropy.MU * p) / (single[k][h] + crossentropy.MU)) / (len(ws) + 1)
        assert r["n_tokens"] == len(ws) + 1
        assert (r["loss_background"], r["loss_target"]) == pytest.approx(tuple(loss)) and r["score"] == pytest.approx(loss[0] - loss[1])
    empty = corpus(spark, ODD).limit(0)
    assert crossentropy.score_documents(empty, empty.select("doc_id")).count() == 0


# packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [*ODD, *((100 + i, prose(50 + 13 * i, i)) for i in range(60)), *((300, "same text of copies") for _ in range(40)), (400, "<|endoftext|> x<|startoftext|>! ΣΑΣ İ. don't K")]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = packing.pack(corpus(spark, texts), TOKENIZER, shard_tokens=9000).toPandas()
    want = Counter()
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
        want[i, len(ids)] += len(ids)
    have = got.groupby(["doc_id", "doc_tokens"], dropna=False)["length"].sum()
    assert {(None if i != i else int(i), int(n)): x for (i, n), x in have.items()} == dict(want)
    alone = [i for i, c in Counter(i for i, _ in texts).items() if c == 1 and i is not None]
    by_id = dict(texts)
    for i in alone:
        ids, at = np.array([*tokenizer.encode(by_id[i] or "", add_special_tokens=False).ids, 2]), 0
        for r in got[got.doc_id == i].sort_values("start").itertuples():
            assert r.start == at and zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= packing.WINDOW
    part = got.groupby("sequence_id").length.sum()
    assert (part < packing.WINDOW).sum() <= len({int(s) >> 20 for s in got.sequence_id if s >= 0})
    assert packing.pack(corpus(spark, ODD).limit(0), TOKENIZER).count() == 0


def test_encoder_against_the_tokenizer():
    import pyarrow as pa

    from myospark.llm.words import pieces

    rng, e = random.Random(1), packing.Encoder(TOKENIZER)
    assert e.short
    words = ["".join(rng.choice("aA.,'-sStTéÉßñ9<|>́İΣſ \n") for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    for first, data, offsets in pieces(pa.array(words), 1 << 12):
        ids, n = e.of(data, offsets)
        ends = np.cumsum(n)
        for i in range(len(n)):
            assert ids[ends[i] - n[i] : ends[i] - 1].tolist() == e.encode(words[first + i], add_special_tokens=False).ids


def test_encoder_asks_once_for_words_in_any_case_with_any_marks():
    """Few ids are remembered, and those of another task too; texts apart and long runs of marks are as the tokenizer has them."""
    e = packing.encoder_of(TOKENIZER)
    assert packing.encoder_of(TOKENIZER) is e
    asked, words = [], e.words
    e.words = lambda some: asked.extend(some) or words(some)
    heads = ["Erkeit", "ERKEIT", "erkeit", "Über", "ÜBER", "über"]
    texts = [" ".join(h + m for h in heads for m in ("", ".", "!!", "$$$", ".***")), "über" + "!" * 40, "", "a\xd7b µM. <|endoftext|>!", "Ã", "é.", "x" + "." * 8 + " y" + "." * 9]
    raw = [t.encode() for t in texts] + [b"ab\xc3", b"\xa9cd!", b"\xc3\x89\xc3!"]
    for _ in range(2):
        ids, n = e.of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    ends = np.cumsum(n)
    for t, a, z in zip(raw, ends - n, ends, strict=True):
        assert ids[a:z].tolist() == [*e.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, 2]
    assert len(asked) == len(set(asked)) < 25 and {"erkeit", "über", "!!", ".***"} <= set(asked)


def test_encoding_holds_little_memory():
    """Of 4 MB of texts a worker holds arrays for a piece of half a megabyte at a time, and freed memory can be given back."""
    import tracemalloc

    import pyarrow as pa

    from myospark.llm.words import pieces
    from myospark.session import give_back

    e, text = packing.encoder_of(TOKENIZER), pa.array(["the quick brown fox, " * 200] * 1000)
    tracemalloc.start()
    for _, data, offsets in pieces(text, packing.ENCODED):
        e.of(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    give_back()


def test_index_scores():
    docs = [np.array(x, np.uint16) for x in ([5, 6, 7, 7], [7, 7, 8], [9, 9, 9])]
    idf = np.ones(packing.VOCABULARY)
    scores = packing.Index(docs, idf, 3.0).scores(0)
    norm = packing.K1 * (1 - packing.B + packing.B * 3 / 3.0)
    assert scores[1] == pytest.approx(2 * (packing.K1 + 1) / (2 + norm)) and scores[2] == 0


# decontamination


def lcs(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
    return m[-1][-1]


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randint(1, 6) for _ in range(rng.randint(1, 20))] for _ in range(2))
        assert decontamination.common(decontamination.masks_of(a), len(a), b, 0) == lcs(a, b)


def test_leaks_and_recall(spark):
    items = [(i, prose(rng, 1000 + i)) for i, rng in enumerate([16, 20, 25, 30, 38, 45, 52, 60, 90, 130] * 3)]
    benchmark = spark.createDataFrame([*items, (98, None), (99, " ")], "item_id long, text string")
    texts, want = [(1000 + i, prose(300, i)) for i in range(150)] + [(9000 + (i or 0), t) for i, t in ODD], set()
    rng = random.Random(4)
    for k, (i, t) in enumerate(items):
        words = t.split()
        if k % 3 == 2:  # a paraphrase: a word in ten is another
            for j in range(3, len(words) - 6, 10):
                words[j] = "else"
        texts.append((k, prose(rng.randint(0, 200), 50 + k) + " " + " ".join(words).upper() + ". " + prose(rng.randint(0, 200), 90 + k)))
        want.add((k, i))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(corpus(spark, texts), benchmark).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
    kept = {r["doc_id"] for r in decontamination.drop_contaminated(corpus(spark, texts), benchmark).collect()}
    assert {i for i, _ in texts if i >= 1000} <= kept
    empty = corpus(spark, ODD).limit(0)
    assert decontamination.contaminated(empty, benchmark).count() == 0
    assert decontamination.contaminated(corpus(spark, ODD), benchmark.limit(0)).count() == 0


def accepted(piece, words):
    """What verification asks for, on these words."""
    answer = piece[-decontamination.ANSWER :]
    part = lcs(piece, words) / len(piece)
    return part >= decontamination.LEAST_VERBATIM or part >= decontamination.LEAST_PARAPHRASE and lcs(answer, words) >= decontamination.LEAST_ANSWER * len(answer)


def answered(piece, words):
    """What the third rule asks for beside the cosine."""
    answer = piece[-decontamination.ANSWER :]
    return lcs(answer, words) >= decontamination.LEAST_ANSWER * len(answer) and lcs(piece, words) - len(answer) >= decontamination.LEAST_LATENT * (len(piece) - len(answer))


def test_search_against_all_windows(spark):
    """Items of any length, verbatim and with up to 45 in a hundred words replaced, against a search of every window."""
    rng = random.Random(12)
    items = [(i, prose(n, 3000 + i).split()) for i, n in enumerate([3, 4, 5, 6, 8, 10, 12, 16, 20, 30, 45, 60] * 3)]
    texts, planted = [(5000 + i, prose(120, 7000 + i)) for i in range(40)], {}
    for i, words in items:
        for rate in (0, 0.15, 0.25, 0.35, 0.45):
            new = [w if rng.random() >= rate or j >= len(words) - 6 and len(words) > 12 else f"z{rng.randrange(999)}" for j, w in enumerate(words)]
            if rate and rng.random() < 0.3:
                new.insert(rng.randrange(len(new)), "extra")
            planted[len(texts)] = (i, rate)
            texts.append((len(texts), f"{prose(rng.randint(0, 60), 8000 + len(texts))} {' '.join(new)} {prose(rng.randint(0, 60), 9000 + len(texts))}"))
    want = set()
    split = {d: t.split() for d, t in texts}
    for d, words in split.items():
        for i, piece in items:
            span, common_words = len(piece) + (len(piece) + 1) // 2, set(piece)
            if sum(w in common_words for w in words) < decontamination.least_common(len(piece)):
                continue
            for a in range(max(1, len(words) - span + 1)):
                if sum(w in common_words for w in words[a : a + span]) >= decontamination.least_common(len(piece)) and accepted(piece, words[a : a + span]):
                    want.add((d, i))
                    break
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(corpus(spark, texts), benchmark).collect()}
    assert all(accepted(dict(items)[i], split[d]) or answered(dict(items)[i], split[d]) for d, i in got)
    for low, high in ((3, 6), (8, 12), (16, 30), (45, 60)):
        some = {(d, i) for d, i in want if low <= len(dict(items)[i]) <= high}
        assert some and len(some & got) >= 0.9 * len(some), (low, high)
    for rates in ((0,), (0.15, 0.25), (0.35, 0.45)):
        some = {(d, i) for d, i in want if d in planted and planted[d][0] == i and planted[d][1] in rates}
        assert some and len(some & got) >= 0.9 * len(some), rates


def test_singular_vectors(spark, monkeypatch):
    """The projection's Gram matrix is that of the left singular vectors."""
    monkeypatch.setattr(decontamination, "DIMENSIONS", 8)
    monkeypatch.setattr(decontamination, "ROUNDS", 6)
    texts = spark.createDataFrame([(" ".join(random.Random(i % 12).choices([f"w{j}" for j in range(30 + 5 * (i % 12))], k=32)),) for i in range(200)], "text string")
    passages = decontamination.fit_passages(texts)
    weights = np.ones(decontamination.BUCKETS, np.float32)
    v = decontamination.randomised_svd(passages, weights)
    a = np.zeros((200, decontamination.BUCKETS))
    for i, r in enumerate(passages.collect()):
        np.add.at(a[i], r["buckets"], 1 / math.sqrt(len(r["buckets"])))
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    mine = a @ v
    np.testing.assert_allclose(mine.T @ mine, np.eye(8), atol=1e-3)
    assert np.linalg.norm(u[:, :4].T @ mine) ** 2 == pytest.approx(4, abs=0.05)


# classifiers


def labelled(spark, n=600):
    rng, docs, labels = random.Random(9), [], []
    for i in range(n):
        toxic, junk = rng.random() < 0.25, rng.random() < 0.25
        words = prose(rng.randint(30, 400), i).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "Moron!", "worthless"]))
        if junk:
            words = [w + rng.choice(["###", "&&&"]) for w in words]
        docs.append((i, " ".join(words), "en", f"s{i % 4}", None))
        if i < 2 * n // 3:
            labels.append((i, int(not junk), int(toxic)))
    truth = [(int("idiot" in t or "oron!" in t or "worthless" in t), int("###" not in t and "&&&" not in t)) for _, t, *_ in docs]
    odd = [(10_000 + (i or 0), t, None, None, None) for i, t in ODD]
    frame = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, source string, n_chars long")
    return frame, spark.createDataFrame([*labels, (0, labels[0][1], labels[0][2]), (None, 1, 1)], "doc_id long, quality int, toxic int"), truth, 2 * n // 3


def test_toxicity_held_out(spark):
    docs, labels, truth, first = labelled(spark)
    rows = toxicity.toxicity_report(docs, labels).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count()
    held = range(first, len(truth))
    assert np.mean([got[i]["is_toxic"] == bool(truth[i][0]) for i in held]) > 0.95
    junk = [i for i in held if truth[i][0]]
    assert np.mean([(got[i]["p_toxic_junk"] > 0.5) == (not truth[i][1]) for i in junk]) > 0.7
    assert not any(got[10_000 + (i or 0)]["is_toxic"] for i, _ in ODD)
    none = toxicity.toxicity_report(docs, labels.limit(0)).collect()
    assert all(r["p_toxic"] == 0.5 and not r["is_toxic"] for r in none)
    assert toxicity.toxicity_report(docs.limit(0), labels).count() == 0


def test_quality_held_out(spark):
    docs, labels, truth, first = labelled(spark)
    rows = cotraining.quality_report(docs, labels).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count()
    assert np.mean([got[i]["keep"] == bool(truth[i][1]) for i in range(first, len(truth))]) > 0.97
    assert all(r["score"] == 0.5 and r["keep"] for r in cotraining.quality_report(docs, labels.limit(0)).collect())
    assert cotraining.quality_report(docs.limit(0), labels).count() == 0


def test_logistic_fit_and_calibration():
    rng = np.random.default_rng(0)
    has = [sorted(np.flatnonzero(rng.random(6) < 0.4).tolist()) for _ in range(3000)]
    true = np.array([1.5, -2, 0.5, 0, 1, -1])
    z = np.array([true[h].sum() for h in has]) - 0.3
    y = (rng.random(3000) < linear.sigmoid(z)).astype(float)
    w, _, bias = linear.fit(has, np.zeros((3000, 0)), y, 6, steps=500)
    np.testing.assert_allclose(w, true, atol=0.35)
    assert bias == pytest.approx(-0.3, abs=0.35)
    a, b = linear.platt(3 * z + 1, y)
    assert a == pytest.approx(1 / 3, abs=0.06) and b == pytest.approx(-1 / 3, abs=0.2)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_queries_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from myospark.llm import queries
    from tests.test_queries import SF, TABLES, rows

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(con.sql(sql).df()), name


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_pipeline(spark):
    """Each stage against its operator's decisions on the stage's own input; the result packs what is left."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(after) <= set(before)
        if name == "line_dedup":
            gone = plain_lines(list(before.items()))
            for i, t in before.items():
                kept = "\n".join(x for j, x in enumerate(t.split("\n")) if not gone.get((i, j), (0, False))[1])
                assert after.get(i, "") == kept or (i not in after and not kept.split())
        else:
            assert all(before[i] == t for i, t in after.items())
        docs = spark.createDataFrame(out.collect(), out.schema)
    left, packed = {r["doc_id"] for r in docs.collect()}, p.run(spark, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == left
    assert first.count() * 0.5 < len(left) < first.count()
