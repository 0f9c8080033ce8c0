"""Operators that learn or search: classifier, languages and near duplicates."""

import math
import re
import zlib
from collections import Counter

import cases
import numpy as np
import pytest

from cellpulse.llm import langid, minhash, quality
from cellpulse.llm.common import fold
from cellpulse.llm.components import components

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600):
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = cases.sentence("en", i, 60 + i % 9)
        text = text.replace(" ", "### ") if bad else text.capitalize() + "."
        rows.append((i, text, None, None, 0))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_classifier_on_documents_it_has_not_seen(spark):
    rows, labels = corpus()
    docs = cases.frame(spark, rows + cases.odd_rows(), extra=True)
    known = spark.createDataFrame([*labels, (1000, None, 0), (5, 0, 1), (1001, 7, 0)], LABELS)
    got = {r.doc_id: r for r in quality.scored(docs, known).collect()}
    held = [(i, q) for i, q, _ in labels if got[i].held_out]
    assert len(held) > 100 and sum(got[i].predicted == q for i, q in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    good = {r.doc_id for r in quality.good_texts(docs, known).collect()}
    assert good == {i for i, r in got.items() if r.predicted}
    assert quality.good_texts(docs, known).columns == docs.columns


def test_scores_without_labels_or_documents(spark):
    rows, labels = corpus(20)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality.scored(cases.frame(spark, rows), none).collect()} == {0.5}
    assert quality.scored(cases.empty(spark), none).collect() == []
    assert quality.good_texts(cases.empty(spark), none).collect() == []


def test_densities_equal_the_textbook_form():
    rng = np.random.default_rng(5)
    x, mean = rng.normal(size=(7, 3)), rng.normal(size=3)
    a = rng.normal(size=(3, 3))
    cov = a @ a.T + np.eye(3)
    factor = np.linalg.cholesky(cov)
    own = quality.Gaussian(mean, np.linalg.inv(factor), -np.log(np.diag(factor)).sum())
    gap = x - mean
    want = -0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) - 0.5 * np.log(np.linalg.det(cov))
    assert own.log_density(x) == pytest.approx(want)


def test_languages_of_documents_not_seen(spark):
    rows = cases.plain_rows(300) + cases.odd_rows()
    docs = cases.frame(spark, rows, extra=True)
    lang = {r[0]: r[2] for r in rows}
    got = {r.doc_id: r for r in langid.identified(docs).collect()}
    assert all(got[i].lang_pred == lang[i] for i in range(300))
    for i in (1000, 1001, 1002, 1003):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in got.values())
    folds = dict(docs.select("doc_id", fold(docs.doc_id)).collect())
    assert all(r.held_out == (folds[i] == 1) for i, r in got.items())
    kept = langid.with_known_language(docs, 0.5)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.lang_pred != "und"}


def test_a_mixture_lists_its_languages(spark):
    rows = cases.plain_rows(200)
    mixed = " ".join(cases.sentence(x, 9000 + i, 60) for i, x in enumerate(["en", "de", "en"]))
    got = langid.identified(cases.frame(spark, [*rows, (999, mixed, None, None, 0)]))
    r = got.where("doc_id = 999").first()
    shares = {x.lang: x.share for x in r.languages}
    assert r.lang_pred == "en" and shares["en"] == pytest.approx(2 / 3, abs=0.05)


def test_a_text_in_three_languages_stays(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setitem(cases.SYLLABLES, "xx", "quo vju kma ljo zqi wox hyf jub gax pik".split())
    rows = cases.plain_rows(200)
    rows += [(500 + i, cases.sentence("xx", 500 + i, 40), "xx", None, 0) for i in range(80)]
    parts = [("en", 80), ("de", 70), ("xx", 50)]
    rows.append((999, " ".join(cases.sentence(x, 9000 + n, n) for x, n in parts), None, None, 0))
    docs = cases.frame(spark, rows)
    shares = langid.identified(docs).where("doc_id = 999").first().languages
    assert len(shares) == 3 and shares[0].share < 0.5
    kept = corpus_pipeline.keep_known_languages(spark, docs, "")
    assert kept.where("doc_id = 999").count() == 1


def test_languages_without_labels_or_documents(spark):
    rows = [(i, "some text", None, None, 0) for i in range(5)]
    assert {r.lang_pred for r in langid.identified(cases.frame(spark, rows)).collect()} == {"und"}
    assert langid.identified(cases.empty(spark)).collect() == []


def near_rows():
    """An original with edited copies that are closer to it than to each other, chains and look-alikes."""
    base = cases.sentence("en", 31, 200).split()
    rows = [(95, " ".join(base))]
    for i in range(60):
        words = list(base)
        words[3 * i] = f"edit{i}"
        words[(3 * i + 90) % 200] = f"again{i}"
        rows.append((100 + i, " ".join(words)))
    chain = cases.sentence("de", 8, 120).split()
    for i in range(6):
        rows.append((300 + i, " ".join(chain)))
        chain = chain[4:] + cases.sentence("de", 900 + i, 4).split()
    apart = cases.sentence("en", 99, 100).split()
    for i in range(8):
        rows.append((400 + i, " ".join(apart[:55] + cases.sentence("en", 700 + i, 45).split())))
    return [(i, t, None, None, 0) for i, t in rows]


def test_null_and_repeated_ids_lose_no_class(spark):
    a, b, c, d = (cases.sentence("en", 50 + i, 60) for i in range(4))
    near = " ".join(c.split()[:-1] + ["changed"])
    rows = [(3, a), (5, a), (5, b), (9, b), (None, c), (None, near), (None, d), (None, None), (None, None), (None, "")]
    rows += [(20, c), (21, None), (21, "by id"), (22, None)]
    docs = cases.frame(spark, [(i, t, None, None, 0) for i, t in rows])
    found = minhash.classes(docs).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in rows)
    by_id = {i: {r.class_id for r in found if r.doc_id == i} for i, _ in rows if i}
    assert by_id == {3: {3}, 5: {3}, 9: {3}, 20: {20}, 21: {21}, 22: {22}}
    # Without an id: c and its edited copy are of class 20; d, the blank and two nulls stand alone.
    loose = [r for r in found if r.doc_id is None]
    assert sorted(str(r.class_id) for r in loose) == ["20"] * 2 + ["None"] * 4
    assert len({r.class_digest for r in loose if r.class_id is None}) == 3
    kept = [(r.doc_id, r.text) for r in minhash.deduplicated(docs).collect()]
    assert len(kept) == 8
    assert {(20, c), (None, d), (None, ""), (22, None)} <= set(kept) and kept.count((None, None)) == 2
    assert [i for i, _ in kept if i in (3, 5, 9, 21)] == [i for i, _ in kept if i in (3, 21)]


@pytest.mark.parametrize("extra", [False, True])
def test_classes_equal_brute_force(spark, extra):
    rows = near_rows() + cases.plain_rows(30) + cases.odd_rows()
    got = {r.doc_id: r.class_id for r in minhash.classes(cases.frame(spark, rows, extra=extra)).collect()}
    assert got == cases.duplicate_classes([(r[0], r[1]) for r in rows])


def test_one_document_of_each_class_stays(spark):
    rows = near_rows() + cases.odd_rows()
    docs = cases.frame(spark, rows)
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    wanted = set(cases.duplicate_classes([(r[0], r[1]) for r in rows]).values())
    assert sorted(r.doc_id for r in kept.collect()) == sorted(wanted)
    assert minhash.classes(cases.empty(spark)).collect() == []
    assert minhash.deduplicated(cases.empty(spark)).collect() == []


def test_signatures_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    for shared in (50, 150, 190):
        a, b = np.sort(pool[:200]), np.sort(pool[200 - shared : 400 - shared])
        elements, owner = np.concatenate([a, b]), np.repeat([0, 1], 200)
        x, y = minhash.signatures(elements, owner, 2, 4000)
        assert (x == y).mean() == pytest.approx(shared / (400 - shared), abs=0.04)


def test_weighted_signatures_follow_the_weighted_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    a, b = rng.random(50) * 3 + 0.1, rng.random(50) * 3 + 0.1
    x, y = minhash.signatures(
        np.concatenate([pool, pool]), np.repeat([0, 1], 50), 2, 4000, np.concatenate([a, b])
    )
    assert (x == y).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def test_every_coordinate_of_a_small_set_is_filled():
    drawn = minhash.signatures(np.array([7, 9], np.uint64), np.array([0, 2]), 3, 120)
    assert (drawn[0] != 0).all() and (drawn[2] != 0).all() and (drawn[1] == 0).all()


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(500, 499)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(31)} | {499: 499, 500: 499}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_classes_have_no_column_that_depends_on_the_leaders(spark):
    found = minhash.classes(cases.frame(spark, near_rows()[:3]))
    assert found.columns == ["doc_id", "class_id", "rep_id", "class_digest"]


def plain_scores(rows, labels):
    """Class densities by sums over rows and a general solver, straight from the definition."""
    quality_of = {}
    for i, q, _ in labels:
        if q in (0, 1):
            quality_of.setdefault(i, set()).add(q)
    known = {0: [], 1: []}
    for i, text, *_ in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            for q in quality_of.get(i, ()):
                known[q].append(np.array(quality.statistics(text)))
    n = {k: len(v) for k, v in known.items()}
    mean = {k: sum(v) / n[k] for k, v in known.items()}
    scatter = {k: sum(np.outer(x - mean[k], x - mean[k]) for x in v) for k, v in known.items()}
    pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
    density = {}
    for k in known:
        mixed = 0.8 * scatter[k] / n[k] + 0.2 * pooled
        cov = 0.9 * mixed + 0.1 * np.diag(np.diag(pooled)) + 1e-3 * np.eye(len(pooled))
        inverse, (_, logdet) = np.linalg.inv(cov), np.linalg.slogdet(cov)
        density[k] = lambda x, m=mean[k], a=inverse, c=logdet: -0.5 * ((x - m) @ a @ (x - m) + c)
    out = []
    for i, text, *_ in rows:
        x = np.array(quality.statistics(text))
        odds = density[1](x) - density[0](x) + math.log(n[1] / n[0])
        out.append((i, 1 / (1 + math.exp(-max(-700, min(700, odds))))))
    return out


def test_quality_scores_equal_plain_densities(spark):
    good = cases.plain_rows(80)
    bad = [(500 + i, "$$$ ### " * (3 + i % 9) + cases.sentence("en", i, 4 + i % 5), "en", None, 0) for i in range(60)]
    rows = good + bad + cases.odd_rows()[:8]
    labels = [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad] + [(3, None, 0), (99999, 1, 0), (5, 1, 0)]
    found = quality.scored(cases.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = sorted((r.doc_id, r.score) for r in found.collect())
    for (i, score), (j, wanted) in zip(got, sorted(plain_scores(rows, labels)), strict=True):
        assert i == j and score == pytest.approx(wanted, abs=1e-6)


def plain_languages(rows):
    """Mixtures of two languages word by word, letter counts in dictionaries."""

    def words(text):
        found = [w for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
        return found if any(c.isalpha() for w in found for c in w) else []

    def bucket(c, before, second):
        """Grams share buckets by a hash of the three letters."""
        h = ord(c) * 0x9E3779B97F4A7C15 ^ ord(before) * 0xC2B2AE3D27D4EB4F
        h = (h ^ ord(second) * 0x165667B19E3779F9) % 2**64 * 0xFF51AFD7ED558CCD % 2**64
        return (h >> 49) % langid.BUCKETS

    def grams(word):
        marked = "  " + word + " "
        return [
            bucket(marked[k], marked[k - 1], marked[k - 2] if marked[k - 1] != " " else " ") for k in range(2, len(marked))
        ]

    counts = {}
    for i, text, lang, *_ in rows:
        if lang and zlib.crc32(str(i).encode()) % 3 != 1:
            own = counts.setdefault(lang, Counter())
            for w in words(text):
                own.update(grams(w))
    langs = sorted(counts)
    total = {g: sum(counts[g].values()) + 0.5 * langid.BUCKETS for g in langs}

    def likelihoods(word):
        sums = [sum(math.log((counts[g][x] + 0.5) / total[g]) for x in grams(word)) for g in langs]
        return [max(s, max(sums) - 12) for s in sums]

    def mixture(p, weights, rounds):
        for _ in range(rounds):
            shares = [[a * w for a, w in zip(row, weights)] for row in p]
            shares = [[a / sum(row) for a in row] for row in shares]
            weights = [sum(row[k] for row in shares) / len(p) for k in range(len(langs))]
        return weights, sum(math.log(sum(a * w for a, w in zip(row, weights))) for row in p)

    out = []
    for i, text, *_ in rows:
        logs = [likelihoods(w) for w in words(text)]
        if not logs:
            out.append((i, "und", 0.0))
            continue
        p = [[math.exp(x - max(row)) for x in row] for row in logs]
        single = [sum(row[k] - max(row) for row in logs) for k in range(2)]
        first = max(range(2), key=lambda k: single[k])
        weights, likelihood = mixture(p, [0.5, 0.5], 6)
        if likelihood - 2 * math.log1p(len(p)) > single[first]:
            main = max(range(2), key=lambda k: weights[k])
            out.append((i, langs[main], weights[main]))
        else:
            out.append((i, langs[first], 1 / sum(math.exp(x - single[first]) for x in single)))
    return out


def test_languages_equal_a_plain_mixture(spark):
    rows = cases.plain_rows(40, 12) + cases.odd_rows()[:8]
    rows += [(700 + i, cases.sentence("en", i, 9) + " " + cases.sentence("de", i, 7 + i), None, None, 0) for i in range(9)]
    found = langid.identified(cases.frame(spark, rows)).collect()
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in found)
    for (i, lang, score), wanted in zip(got, sorted(plain_languages(rows)), strict=True):
        assert (i, lang) == wanted[:2]
        assert score == pytest.approx(wanted[2], abs=2e-3)


def test_slices_without_a_word(spark):
    rows = [(i, t, "en", None, 0) for i, t in enumerate([None, "", "12 !", "²"])]
    assert {r.lang_pred for r in langid.identified(cases.frame(spark, rows).coalesce(1)).collect()} == {"und"}
    rows += [(10 + i, cases.sentence("en", i, 9), "en", None, 0) for i in range(6)]
    found = {r.doc_id: r.lang_pred for r in langid.identified(cases.frame(spark, rows).repartition(10)).collect()}
    assert [found[i] for i in (0, 1, 2, 3, 10)] == ["und"] * 4 + ["en"]
