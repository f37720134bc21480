"""Near copies among documents that share a passage and little else: the number of compared pairs, and that none is lost."""

from __future__ import annotations

import random

import pytest

from myospark.llm import linejoin, nearcopies
from tests.llm.test_small_operators import corpus, plain_sets, prose


@pytest.fixture
def compared(monkeypatch):
    """How many pairs each call of `similar` compares."""
    counts, similar = [], nearcopies.Classes.similar

    def spy(self, pairs):
        counts.append(pairs.count())
        return similar(self, pairs)

    monkeypatch.setattr(nearcopies.Classes, "similar", spy)
    monkeypatch.setattr(nearcopies, "COUNT_DOCS", 2)  # the sample says nothing about the passage
    return counts


def components(sets):
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and 10 * len(a & b) >= 8 * len(a | b):
                label = [label[j] if x == label[i] else x for x in label]
    return len(set(label))


@pytest.mark.parametrize("passage", [5, 12])
def test_a_common_passage_makes_no_pairs(spark, compared, passage, monkeypatch):
    """Pairs grow with the documents, not with their square; near copies among them are still linked."""
    monkeypatch.setattr(nearcopies, "CROWD", 16)
    common, sizes = prose(passage, 4711), {}
    for n in (150, 600):
        rng, texts = random.Random(5), []
        for i in range(n):
            words = prose(40, 10_000 + i).split()
            at = rng.randrange(40)
            texts.append(" ".join(words[:at] + [common] + words[at:]))
        for i in range(0, n, 10):  # a word more at the end: near copies, whose fingerprints may lie apart
            texts.append(texts[i] + " end of it")
        compared.clear()
        kept = nearcopies.keep_one(corpus(spark, list(enumerate(texts)))).count()
        sizes[n] = sum(compared)
        assert kept == components([plain_sets(t, 5) for t in texts]) == n
    assert all(pairs < 1.5 * n for n, pairs in sizes.items()), sizes


def test_nested_passages_are_ranked_in_turns(spark, compared, monkeypatch):
    """Documents of two passages and a little of their own, some of them nearly equal, against all pairs."""
    monkeypatch.setattr(nearcopies, "CROWD", 8)
    rng = random.Random(6)
    passages = [prose(18, 900 + k) for k in range(4)]
    texts = []
    for i in range(120):
        own = prose(rng.randint(4, 30), 5000 + i)
        texts.append(f"{rng.choice(passages)} {own} {rng.choice(passages)}")
        if i % 6 == 0:
            texts.append(texts[-1] + " tail")
    kept = nearcopies.keep_one(corpus(spark, list(enumerate(texts)))).count()
    assert kept == components([plain_sets(t, 5) for t in texts])


@pytest.mark.parametrize("large", [8192, 20])
def test_links_of_chains_and_crowds(spark, monkeypatch, large):
    """Chains in which each line is like the next one only, and groups in which all are alike, whole or list by list, against all pairs."""
    monkeypatch.setattr(linejoin, "LARGE", large)
    monkeypatch.setattr(linejoin, "GROUP", 16)
    rng, lines = random.Random(7), []
    chain = prose(140, 77).split()
    lines += [" ".join(chain[i : i + 22]) for i in range(0, 116, 2)]  # 20 of 24 words in common with the next
    base = prose(25, 78).split()
    lines += [" ".join([*base[:k], f"other{rng.randrange(40)}", *base[k + 1 :]]) for k in range(25) for _ in range(2)]
    lines += [prose(12, 900 + i) for i in range(30)]
    rng.shuffle(lines)
    sets = [frozenset(x.encode().lower().split()) for x in lines]
    kinds = set(sets)
    want = {s: sum(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in kinds) - 1 for s in kinds}
    got = linejoin.similar_lines(corpus(spark, [(i, "\n".join(lines[i : i + 4])) for i in range(0, len(lines), 4)])).collect()
    assert len(got) == len(lines) and sum(want.values()) > 300
    for r in got:
        i = r["doc_id"] + r["line_no"]
        assert r["n_links"] == want[sets[i]], lines[i]
        assert r["removed"] == any(9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) for j in range(i))


def test_a_chain_is_not_compared_with_itself(spark, monkeypatch):
    """A component of 5,000 classes, each like a few neighbours: pairs of classes that meet in a task grow with its length, not with the square."""
    met = []
    in_units = linejoin.in_units

    def spy(members):
        out = in_units(members)
        met.append(out.count())
        return out

    monkeypatch.setattr(linejoin, "in_units", spy)
    monkeypatch.setattr(linejoin, "LARGE", 1000)
    words = [f"{w}{i}" for i, w in enumerate(prose(10_100, 5).split())]
    lines = [" ".join(words[i : i + 22]) for i in range(0, 10_000, 2)]
    got = linejoin.similar_lines(corpus(spark, [(i, "\n".join(lines[i : i + 50])) for i in range(0, 5000, 50)])).groupBy("n_links").count().collect()
    assert {r["n_links"]: r["count"] for r in got} == {1: 2, 2: 4998}
    assert met[-1] <= 5000 * 6  # a row for each class and prefix word


@pytest.fixture
def posted(monkeypatch):
    """How many rows each pass over the prefixes leaves."""
    rows, plain = [], nearcopies.Classes.posted

    def spy(self, ranked):
        found = plain(self, ranked)
        rows.append(found.count())
        return found

    monkeypatch.setattr(nearcopies.Classes, "posted", spy)
    return rows


def test_prefixes_take_shingles_of_rare_words(spark, posted, monkeypatch):
    """Unlike documents share shingles of frequent words by chance, the more the more documents there are; those stay out of the prefixes."""
    monkeypatch.setattr(nearcopies, "COUNT_DOCS", 2)  # the sample says nothing about them
    rng, often = random.Random(9), "the of and to in is on at".split()
    texts = [" ".join([*rng.choices(often, k=30), *(f"own{i}x{j}" for j in range(30))]) for i in range(600)]
    texts += [t + " tail" for t in texts[:20]]
    kept = nearcopies.keep_one(corpus(spark, list(enumerate(texts)))).count()
    assert kept == 600
    assert len(posted) == 1 and posted[0] <= 20 * 2 * 12, posted


def test_few_crowds_take_no_further_pass(spark, posted, compared, monkeypatch):
    """Prefixes are taken again only where crowded shingles would make more pairs than all others may."""
    monkeypatch.setattr(nearcopies, "CROWD", 8)
    texts = [f"{prose(12, 20_000)} {prose(40, 21_000 + i)}" for i in range(10)]
    texts += [f"{prose(12, 22_000 + i // 2)} {prose(40, 23_000 + i)}" for i in range(120)]
    texts += [t + " tail" for t in texts[::10]]
    kept = nearcopies.keep_one(corpus(spark, list(enumerate(texts)))).count()
    assert kept == components([plain_sets(t, 5) for t in texts]) == 130
    assert len(posted) == 1, posted
