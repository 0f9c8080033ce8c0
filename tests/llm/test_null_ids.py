"""Every operator and stage with a third of the ids null, and repeated rows: each row comes back."""

from collections import Counter

import cases
import pytest

from cellpulse.llm import chat, fingerprint, langid, minhash, mixing, packing, quality, resample, rules, sharding

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def rows():
    plain = cases.plain_rows(60, 30)
    return [(None if i % 3 == 0 else r[0], *r[1:]) for i, r in enumerate(plain)] + cases.odd_rows()[:10] * 2 + [
        (None, None, None, None, None)
    ] * 3


@pytest.fixture(scope="module")
def docs(spark, rows):
    return cases.frame(spark, rows).repartition(6)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (None, 0, 0)], LABELS)


def test_each_row_comes_back_under_its_id(docs, labels, rows):
    ids = Counter(r[0] for r in rows)
    for out in (
        quality.scored(docs, labels), sharding.shard_rows(docs, 3), langid.identified(docs),
        fingerprint.version_prints(docs), rules.judged(docs, labels), mixing.mix_words(docs),
        resample.resampled(docs, docs),
    ):
        assert Counter(r[0] for r in out.select("doc_id").collect()) == ids
    pieces = packing.packed(docs, window=64)
    assert Counter(r[0] for r in pieces.select("row_id", "doc_id").distinct().select("doc_id").collect()) == ids


def test_stages_keep_rows_without_an_id(docs, labels, rows):
    whole = Counter((r[0], r[1]) for r in rows)
    known = Counter((r.doc_id, r.text) for r in langid.with_known_language(docs).collect())
    assert not known - whole and sum(known.values()) == sum(
        n for (_, t), n in whole.items() if t and any(c.isalpha() for c in t)
    )
    good = Counter((r.doc_id, r.text) for r in quality.good_texts(docs, labels).collect())
    assert not good - whole
    single = Counter((r.doc_id, r.text) for r in minhash.deduplicated(docs).collect())
    assert {t for _, t in single} == {t for _, t in whole}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.where("doc_id IS NULL").count() > 0


def test_conversations_without_an_id_are_one(spark):
    turns = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (3, 0, "user", None), (3, 1, "assistant", "c")]
    frame = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    assert {r.conv_id: r.n_turns for r in chat.chat_digests(frame).collect()} == {None: 2, 3: 2}
