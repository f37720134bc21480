"""Repeated and null ids, empty and very long texts, clashing columns, hot keys: rows are judged one by one."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from myospark.llm import cotraining, crossentropy, decontamination, linear, linejoin, nearcopies, packing, secrets, simhash, spread, toxicity, winnowing
from tests.llm.test_large_operators import TOKENIZER, plain_lines
from tests.llm.test_small_operators import plain_components, plain_sets, plain_simhash, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["_kept", "_part", "_parts", "_id", "_p", "_s", "_key", "_lost", "row", "lost", "key", "found", "class", "id", "fingerprint", "shard", "part", "n", "target", "block", "words"]
ITEM = prose(30, 4242)


def odd_rows():
    """(doc_id, text)."""
    a, b, c, d = (prose(40, 300 + i) for i in range(4))
    long_ = "\n".join(prose(60, 400 + i) for i in range(400))
    rows = [(1, a), (1, a), (1, b), (2, a), (3, b), (5, b), (5, c), (None, c), (None, d), (None, d), (None, None), (7, ""), (8, None), (9, " \n\t"), (10, long_), (10, long_ + " end"), (11, f"{d}\n{a}"), (2**60 + 7, "alone"), (2**53 + 1, f"{prose(20, 9)} {ITEM} {prose(20, 10)}"), (None, f"{prose(25, 11)} {ITEM}")]
    random.Random(2).shuffle(rows)
    return rows


def frame(spark, rows):
    df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None) for i, t in rows], SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASH})


def texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def order(row):
    return (row[0] is None, row[0] or 0)


def kept_of(rows, label):
    """One row of each group: that of the least id."""
    best = {}
    for row, name in zip(rows, label, strict=True):
        best[name] = min(best.get(name, row), row, key=order)
    return Counter(best.values())


def test_simhash_keeps_one_row_of_each_group(spark):
    rows = odd_rows()
    label = plain_components([plain_simhash(t, 5) for _, t in rows], 3)
    out = simhash.keep_one(frame(spark, rows))
    assert out.columns == frame(spark, rows[:1]).columns
    assert texts(out) == kept_of(rows, label)
    assert simhash.keep_one(frame(spark, rows).limit(0)).count() == 0


def test_near_copies_keep_one_row_of_each_group(spark):
    rows = odd_rows()
    sets, label = [plain_sets(t, 5) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                label = [label[j] if x == label[i] else x for x in label]
    assert texts(nearcopies.keep_one(frame(spark, rows))) == kept_of(rows, label)


def test_lines_are_removed_row_by_row(spark):
    """Lines of one id's rows don't take each other's numbers: every set of words stays somewhere, once for each group."""
    rows = odd_rows()
    out = linejoin.remove_lines(frame(spark, rows))
    assert out.columns == frame(spark, rows[:1]).columns
    lines = lambda found: [frozenset(x.encode().lower().split()) for _, t in found for x in (t or "").split("\n")]
    before, after = lines(rows), lines(list(texts(out).elements()))
    assert set(after) <= set(before) and all(n == 1 for s, n in Counter(after).items() if s)
    gone = set(before) - set(after)
    assert len(gone) == 1 and all(any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in after) for s in gone)
    # rows without words stay as they are
    assert all(n == texts(out)[k] for k, n in Counter((i, t) for i, t in rows if not (t or "").split()).items())
    three = [(1, "A\nC"), (1, "short unique opening line\nA"), (1, "A")]
    assert sorted(x for t in texts(linejoin.remove_lines(frame(spark, three))).elements() for x in t[1].split("\n")) == ["A", "C", "short unique opening line"]


def test_contaminated_rows_go(spark):
    rows = odd_rows()
    benchmark = spark.createDataFrame([(1, ITEM), (None, ITEM), (2, None)], "item_id long, text string")
    out = decontamination.drop_contaminated(frame(spark, rows), benchmark)
    assert out.columns == frame(spark, rows[:1]).columns
    assert texts(out) == Counter((i, t) for i, t in rows if ITEM not in (t or ""))
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(frame(spark, rows), benchmark).collect()} == {(d, i) for d in (2**53 + 1, None) for i in (1, None)}


@pytest.fixture
def odd_tables(spark, tmp_path):
    rows = odd_rows()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return rows, str(tmp_path)


def test_pipeline_of_odd_rows(spark, odd_tables):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows, folder = odd_tables
    packed = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = decontamination.drop_contaminated(nearcopies.keep_one(linejoin.remove_lines(docs)), spark.read.parquet(f"{folder}/benchmark.parquet"))
    tokenizer, want = Tokenizer.from_file(TOKENIZER), Counter()
    for (i, t), n in texts(kept).items():
        want[i] += n * (len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1)
    have = Counter()
    for r in packed.collect():
        have[r["doc_id"]] += r["length"]
    assert have == want


# packing


def test_packing_beside_null_ids(spark):
    rows = [(2**53 + 1, "a b"), (2**60 + 7, "c d"), (None, "e f"), (-5, "g"), (-5, "g")]
    got = packing.pack(frame(spark, rows), TOKENIZER).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)


def test_neighbours_against_plain_bm25(monkeypatch):
    """All distinct ids of a seed count: windows are filled in the order of plain scores."""
    rng = random.Random(6)
    topics = [[rng.randrange(5000) for _ in range(60)] for _ in range(5)]
    ids = [np.array([rng.choice(topics[i % 5]) if rng.random() < 0.7 else rng.randrange(200) for _ in range(rng.randint(5, 400))], np.uint16) for i in range(90)]
    held, n = Counter(int(t) for x in ids for t in set(x.tolist())), len(ids)
    idf = np.zeros(packing.VOCABULARY)
    for t, k in held.items():
        idf[t] = np.log1p((n - k + 0.5) / (k + 0.5))
    mean = sum(map(len, ids)) / n
    counts = [Counter(x.tolist()) for x in ids]

    def plain(seed):
        norm = [packing.K1 * (1 - packing.B + packing.B * len(x) / mean) for x in ids]
        return np.array([sum(idf[t] * c[t] * (packing.K1 + 1) / (c[t] + norm[d]) for t in counts[seed] if t in c) for d, c in enumerate(counts)])

    for dense in (1, 16, 10**6):
        monkeypatch.setattr(packing, "DENSE", dense)
        index = packing.Index(ids, idf, mean)
        for seed in range(0, n, 7):
            np.testing.assert_allclose(index.scores(seed), plain(seed), rtol=1e-5)
    monkeypatch.setattr(packing, "WINDOW", 1500)
    placed = list(packing.fill([len(x) for x in ids], packing.Index(ids, idf, mean)))
    used = set()
    for k, (d, at, _, window, offset, score) in enumerate(placed):
        if offset == 0:
            seed, scores = d, plain(d)
        elif at == 0:
            rest = [scores[x] for x in range(n) if x not in used and x != seed]
            assert score == pytest.approx(scores[d], rel=1e-5) and scores[d] >= max(rest) - 1e-5
        used.add(d)
    assert used == set(range(n))


# hot keys


def largest_group(monkeypatch, module, name):
    """The most rows that any key of a join by `join_dealt` leaves in one deal."""
    most, join = [], spread.join_dealt

    def counted(rows, table, keys, n, by, how="inner"):
        parts = F.when(F.col(n) > spread.LEAST, F.ceil(F.col(n) / spread.LEAST)).otherwise(1)
        dealt = rows.join(table.select(*keys, parts.alias("_p")), keys).groupBy(*keys, F.pmod(F.xxhash64(by), F.col("_p"))).count()
        most.append(dealt.agg(F.max("count")).first()[0] or 0)
        return join(rows, table, keys, n, by, how)

    monkeypatch.setattr(module, name, counted)
    return most


def test_a_line_in_half_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(spread, "LEAST", 50)
    monkeypatch.setattr(linejoin, "LIST_LEVEL", 3)
    monkeypatch.setattr(linejoin, "LIST", 4)
    monkeypatch.setattr(linejoin, "GROUP", 4)
    most = largest_group(monkeypatch, linejoin, "join_dealt")
    hot = prose(12, 77)
    rows = [(i, hot if i % 2 else f"{prose(11, 500 + i % 30)}\n{hot} w{i % 17}") for i in range(1200)]
    docs = frame(spark, rows)
    got = {(r["doc_id"], r["line_no"]): (r["n_links"], r["removed"]) for r in linejoin.line_report(docs).collect()}
    assert got == plain_lines(rows)
    assert max(most) < 120  # of 600 rows
    with spread_classes(docs) as classes:
        assert classes.where("held > 500").count() == 1
        lists = linejoin.postings(classes).groupBy(F.shiftright("key", linejoin.POSITION_BITS)).count()
        assert lists.agg(F.max("count")).first()[0] <= 40  # no list has a row for each of its copies


class spread_classes:
    def __init__(self, docs):
        rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
        self.classes = linejoin.line_classes(linejoin.line_rows(rows, linejoin.word_levels(rows), whole=False))

    def __enter__(self):
        return self.classes

    def __exit__(self, *_):
        return False


def test_an_id_of_half_of_the_rows(spark, monkeypatch):
    """Winnowing deals it over ranges; every row has its edited text and a successor."""
    monkeypatch.setattr(winnowing, "RANGE_ROWS", 40)
    rows = [(None if i % 2 else i, f"{prose(30, i)}") for i in range(1000)]
    docs = frame(spark, rows)
    got = winnowing.compare_edits(docs).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t)) for i, t in rows)
    sizes = [r["count"] for r in winnowing.with_next(docs).where("not guard").groupBy("bucket").count().collect()]
    assert max(sizes) < 250 and len(sizes) > 10
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for (i, t), (_, after) in zip(known, known[1:], strict=False):
        q = len(t) // 4
        assert by_id[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()


def test_an_id_of_half_of_the_rows_is_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(crossentropy, "BLOCK_TOKENS", 500)
    rows = [(5, prose(20, i)) for i in range(200)]
    blocks = crossentropy.encode(crossentropy.mark_target(frame(spark, rows), spark.createDataFrame([(5,)], "doc_id long")))
    sizes = [r["tokens"] for r in blocks.select("tokens").collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1500 and len(sizes) >= 3
    assert crossentropy.score_documents(frame(spark, rows), spark.createDataFrame([(5,)], "doc_id long")).count() == 200


def test_a_value_of_half_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(spread, "LEAST", 20)
    most = largest_group(monkeypatch, secrets, "join_dealt")
    rows = [(i, "token = Zx9Qw3Er7Ty1Ui5" if i % 2 else f"token = Mn8Bv4Cx2Za{i:04d}") for i in range(800)] + [(None, "token = Zx9Qw3Er7Ty1Ui5")] * 3
    got = secrets.secret_report(frame(spark, rows)).collect()
    assert len(got) == len(rows) and max(most) < 60
    assert all((r["n_live"], r["n_copied"]) == ((1, 0) if "Mn8" in dict(rows)[r["doc_id"]] else (0, 1)) for r in got if r["doc_id"] is not None)


def test_a_fingerprint_of_half_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(spread, "LEAST", 30)
    most = largest_group(monkeypatch, simhash, "join_dealt")
    rows = [(i, "" if i % 2 else prose(20, i)) for i in range(600)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_report(frame(spark, rows)).collect()}
    assert len(got) == 600 and all(got[i] == 1 for i in range(1, 600, 2)) and max(most) < 80


# classifiers


def test_parts_of_the_table_of_counts():
    """Any number of parts is used, evenly, and a key is told apart inside its part."""
    hashes = np.random.default_rng(1).integers(0, 1 << 64, 1_000_000, dtype=np.uint64)
    for parts in (1, 3, 1000, 200_000, 3_000_000_000 // 2):
        found = crossentropy.part_of(hashes, parts)
        kinds, sizes = np.unique(found, return_counts=True)
        assert found.min() >= 0 and found.max() < parts and len(kinds) > min(parts, len(hashes)) * 0.6
        if parts <= 1000:
            assert len(kinds) == parts and sizes.max() < 1.3 * len(hashes) / parts
    keys = crossentropy.Keys(hashes, np.ones(len(hashes), int), np.zeros(len(hashes), int), 200_000)
    assert len(set(zip(np.repeat(keys.part, np.diff(np.append(keys.first, len(keys.key)))).tolist(), keys.key.tolist(), strict=True))) == len(hashes)


def test_many_parts_are_asked_in_two_steps(spark, monkeypatch):
    """The same scores, with fewer rows than one for each block and part."""
    monkeypatch.setattr(crossentropy, "BLOCK_TOKENS", 60)
    monkeypatch.setattr(crossentropy, "pieces", lambda texts, of=crossentropy.pieces: of(texts, 500))
    rows = [*odd_rows()[:12], *((100 + i, prose(20 + i % 50, i)) for i in range(120)), (500, prose(3000, 3))]
    docs, target = frame(spark, rows), spark.createDataFrame([(i,) for i in range(100, 150)], "doc_id long")
    want = crossentropy.score_documents(docs, target).collect()
    asked, requests = [], crossentropy.requests

    def spy(blocks, parts, pairs, width=1):
        out = requests(blocks, parts, pairs, width)
        asked.append((blocks.count(), parts, out.count()))
        return out

    gathered, met = crossentropy.gathered, []
    monkeypatch.setattr(crossentropy, "gathered", lambda a, width: met.append(gathered(a, width).count()) or gathered(a, width))
    monkeypatch.setattr(crossentropy, "requests", spy)
    monkeypatch.setattr(crossentropy, "ROUTED", 2)
    got = crossentropy.score_documents(docs, target).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["score"] is None, r["score"] or 0.0)
    assert len(got) == len(want) == len(rows)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-12)
    for (blocks, parts, n), two in zip(asked, met, strict=True):
        assert blocks > 30 and parts > 60 and n <= blocks * (parts**0.5 + 2) and two <= parts * (blocks**0.5 + 1) and n + two < blocks * parts / 1.5


def test_fingerprints_keep_other_columns(spark):
    docs = frame(spark, odd_rows())
    out = winnowing.fingerprints(docs)
    assert out.columns == [*docs.columns, "hashes", "positions"] and {r["_kept"] for r in out.collect()} == {"x"}


def test_co_training_against_a_plain_version(spark):
    """The views label the surest of all unlabelled rows for each other, as a loop over the whole table does."""
    rng, rows, labels = random.Random(3), [], []
    for i in range(500):
        good = rng.random() < 0.5
        words = prose(30, i).split()
        rows.append((i, " ".join(words if good else [w + "##" if rng.random() < 0.5 else w for w in words]), "en", f"{'g' if good ^ (rng.random() < 0.15) else 'b'}{i % 3}", None))
        if i < 120:
            labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    trained = cotraining.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), rows=200)
    table = sorted(trained.table.collect(), key=lambda r: r["key"])
    marks, features = dict(labels), [v.features for v in trained.views]
    have = [[list(r[c]) for r in table if r["key"] in marks] for c in ("content", "page")]
    y = np.array([marks[r["key"]] for r in table if r["key"] in marks])
    pool = [r for r in table if r["key"] not in marks]
    taught = [i for i in range(len(y)) if i % cotraining.HELD_OUT]
    own, own_marks, taken = [[h[i] for i in taught] for h in have], [y[taught].astype(float)] * 2, [set(), set()]
    rate, most = y.mean(), round(cotraining.SHARE * 200)
    models = [cotraining.fit_view(own[v], own_marks[v], features[v]) for v in (0, 1)]
    from myospark.llm.words import mix

    for _ in range(cotraining.ROUNDS):
        new = []
        for v in (0, 1):
            column, other = ("content", "page")[v], ("content", "page")[1 - v]
            z = linear.margins(models[v], [list(r[column]) for r in pool], np.zeros((len(pool), 0)))
            ties = [int(mix(np.array([r["row"]], np.uint64))[0] >> np.uint64(1)) for r in pool]
            chosen = []
            for up, k in ((True, max(1, round(most * rate))), (False, max(1, round(most * (1 - rate))))):
                sure = [i for i in range(len(pool)) if pool[i]["row"] not in taken[1 - v] and (linear.sigmoid(z[i]) >= cotraining.SURE if up else linear.sigmoid(z[i]) <= 1 - cotraining.SURE)]
                sure = sorted(sure, key=lambda i: (-z[i] if up else z[i], ties[i]))[:k]
                taken[1 - v] |= {pool[i]["row"] for i in sure}
                chosen += [(list(pool[i][other]), float(up)) for i in sure]
            new.append(chosen)
        for v in (0, 1):
            own[1 - v] = own[1 - v] + [h for h, _ in new[v]]
            own_marks[1 - v] = np.append(own_marks[1 - v], [m for _, m in new[v]])
        models = [cotraining.fit_view(own[v], own_marks[v], features[v]) for v in (0, 1)]
    assert len(taken[0]) >= 40 and len(taken[1]) >= 40
    for v in (0, 1):
        np.testing.assert_allclose(trained.views[v].model[0], models[v][0], atol=1e-6)
    held = [i for i in range(len(y)) if i % cotraining.HELD_OUT == 0]
    t = np.where(y[held] > 0, (y[held].sum() + 1) / (y[held].sum() + 2), 1 / (len(held) - y[held].sum() + 2))
    odds = []
    for v, column in ((0, "content"), (1, "page")):
        view = trained.views[v]
        z = np.array([models[v][0][have[v][i]].sum() + models[v][2] for i in held])
        a, b = view.scale
        p = 1 / (1 + np.exp(-(a * z + b)))
        assert abs(((p - t) * z).sum() + 1e-3 * (a - 1)) < 1e-3 and abs((p - t).sum()) < 1e-3  # the least loss against Platt's targets
        rate_held = y[held].mean()
        lost = lambda q: -np.mean(y[held] * np.log(q) + (1 - y[held]) * np.log(1 - q))
        assert view.weight == pytest.approx(min(1.0, max(0.01, 1 - lost(np.clip(p, 1e-6, 1 - 1e-6)) / lost(np.full(len(held), rate_held)))), abs=1e-6)
        odds.append(np.array([np.clip(a * (models[v][0][list(r[column])].sum() + models[v][2]) + b, -20, 20) for r in table]))
    assert {v.weight > 0.05 for v in trained.views} == {True}
    weights = [v.weight for v in trained.views]
    plain = 1 / (1 + np.exp(-(odds[0] * weights[0] + odds[1] * weights[1]) / sum(weights)))
    told = {r["doc_id"]: r["score"] for r in cotraining.score(docs, trained).collect()}
    np.testing.assert_allclose([told[r["key"]] for r in table], plain, atol=1e-5)
    scored = {r["doc_id"]: r["score"] for r in cotraining.score(docs, trained).collect()}
    report = {r["doc_id"]: r["score"] for r in cotraining.quality_report(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(scored) == len(report) == 500
    assert np.mean([(scored[i] > 0.5) == ("##" not in rows[i][1]) for i in range(120, 500)]) > 0.95


def test_views_share_nothing():
    content = cotraining.content_tokens("#Word!") + cotraining.content_whole("a b b", ["a", "b", "b"])
    page = cotraining.page_features(("web", None, "1200", "http://a.org/x/y-1"))
    assert not set(content) & set(page)
    assert page[:7] == ["0:web", "1:", "2#11", "3@a.org", "3/x", "3/y", "3/1"] and "0:web 3@a.org" in page


def test_page_features_do_not_follow_from_the_text(spark):
    """Whatever the text is, rows of equal metadata have equal page features; the length of the text is no metadata."""
    assert not {"text", "n_chars"} & set(cotraining.METADATA)
    rows = [(i, prose(3 + i, i), "en" if i % 2 else "de", f"s{i % 3}", len(prose(3 + i, i))) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    table = cotraining.train(docs, labels).table.collect()
    pages = {}
    for r in table:
        _, _, lang, source, _ = rows[r["key"]]
        pages.setdefault((lang, source), set()).add(tuple(r["page"]))
    assert len(pages) == 6 and all(len(p) == 1 for p in pages.values()) and len(set.union(*pages.values())) == 6


def test_chain_of_independent_categories(spark):
    """Later models see the earlier categories' out-of-fold log-odds: against a plain loop, and on documents held out."""
    rng, rows, labels = random.Random(8), [], []
    names = ["insult", "threat", "spam"]
    marks_of = {"insult": ["idiot", "moron"], "threat": ["burnit", "hurtyou"], "spam": ["buynow", "winbig"]}
    truth = []
    for i in range(600):
        own = [int(rng.random() < 0.3) for _ in names]
        own[1] = int(rng.random() < (0.7 if own[0] else 0.1))  # threats mostly come with insults
        words = prose(25, i).split()
        for name, m in zip(names, own, strict=True):
            if m:
                words.insert(rng.randrange(len(words)), rng.choice(marks_of[name]))
        rows.append((i, " ".join(words), "en", "s", None))
        truth.append(own)
        if i < 400:
            labels.append((i, *own))
    docs = spark.createDataFrame(rows, SCHEMA)
    chain = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, insult int, threat int, spam int"), names)
    vectors = linear.Vectors(chain.features, toxicity.word_features, toxicity.no_features)
    has, y = [vectors.of(r[1]) for r in rows[:400]], np.array(truth[:400])
    seen = np.zeros((400, 0))
    for j in range(3):
        out = np.zeros(400)
        for f in range(toxicity.FOLDS):
            other = [i for i in range(400) if i % toxicity.FOLDS != f]
            w, more, bias = linear.fit([has[i] for i in other], seen[other], y[other, j].astype(float), len(chain.features))
            for i in range(f, 400, toxicity.FOLDS):
                out[i] = w[has[i]].sum() + seen[i] @ more + bias
        w, more, bias = linear.fit(has, seen, y[:, j].astype(float), len(chain.features))
        np.testing.assert_allclose(chain.models[j][0], w, atol=1e-9)
        np.testing.assert_allclose(chain.models[j][1], more, atol=1e-9)
        seen = np.column_stack([seen, np.clip(out, -20, 20)])
    assert chain.models[1][1][0] > 0  # an insult makes a threat likelier
    got = {r["doc_id"]: r for r in toxicity.score(docs.withColumns({c: F.lit("x") for c in CLASH}), chain).collect()}
    for j, name in enumerate(names):
        assert np.mean([(got[i][f"p_{name}"] > 0.5) == bool(truth[i][j]) for i in range(400, 600)]) > 0.95, name
