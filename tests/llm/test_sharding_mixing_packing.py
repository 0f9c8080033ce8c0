"""Operators that place documents: shards, mixtures and windows."""

import zlib

import cases
import numpy as np
import public_tokenizers
import pytest

from pyspark.sql import functions as F

from cellpulse.llm import langid, mixing, packing, sharding


@pytest.mark.parametrize("extra", [False, True])
def test_shards_hold_every_row_once_in_nearly_equal_bytes(spark, extra):
    docs = cases.frame(spark, extra=extra)
    rows = sharding.shard_rows(docs, 4).collect()
    source = docs.select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted(
        (r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in source
    )
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    for shard in range(4):
        own = [r for r in rows if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 4) <= largest


def test_a_hot_group_is_cut_over_shards(spark):
    rows = [(i, "the same text of all rows", None, None, 0) for i in range(2000)]
    shards = sharding.shard_rows(cases.frame(spark, rows), 8).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in shards) == [250] * 8


def test_overfull_ranges_are_subdivided():
    sums = {0: (100, 10, 0, 99), 1: (900, 90, 100, 1000)}
    finer = sharding.subdivided([100], sums, 300)
    assert finer[0] == 100 and len(finer) == 4 and all(100 <= x <= 1000 for x in finer)
    # A single key can't be cut.
    assert sharding.subdivided([100], {1: (900, 1, 100, 100)}, 300) == [100]


def test_no_documents_give_no_shards_mixture_or_windows(spark):
    assert sharding.shard_rows(cases.empty(spark), 4).collect() == []
    assert mixing.mix_words(cases.empty(spark)).collect() == []
    assert mixing.mixed_documents(cases.empty(spark)).collect() == []
    assert packing.packed(cases.empty(spark)).collect() == []


def test_targets_share_the_total_and_stop_at_three_times_a_source():
    shared = mixing.targets([100, 10, 1000], [5, 2, 1])
    assert shared == [300.0, 30.0, 780.0] and sum(shared) == 1110
    assert mixing.targets([], []) == []
    assert mixing.targets([0, 0], [1, 1]) == [0.0, 0.0]


@pytest.mark.parametrize("extra", [False, True])
def test_each_source_is_taken_near_its_target(spark, extra):
    docs = cases.frame(spark, extra=extra)
    text = {r.doc_id: r for r in docs.select("doc_id", "text", "source").collect()}
    rows = mixing.mix_words(docs, slots=4096).collect()
    assert len(rows) == docs.count()
    assert all(r.size == len(cases.WORD.findall(text[r.doc_id].text or "")) for r in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(text[r.doc_id].source, []).append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r.size for r in by[s]) for s in order]
    wanted = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))])
    for s, size, target in zip(order, sizes, wanted, strict=True):
        assert {(r.source_size, r.target) for r in by[s]} == {(size, target)}
        assert abs(sum(r.taken for r in by[s]) - target) <= 6 * max(1, sum(sizes) / 4096)
    again = mixing.mix_words(docs, slots=4096).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_tiny_sources_beside_hot_ones_get_their_slots_exactly(spark):
    sizes = [5_000_000] * 5 + [40, 90, 150, 170, 200, 700, 1_000] * 5
    planned = mixing.plan_sources([(f"s{i:02}", n) for i, n in enumerate(sizes)], mixing.WEIGHTS, 65_536)
    slots = mixing.schedule(spark, planned).collect()
    assert sorted(r.slot for r in slots) == list(range(len(slots)))
    for s in planned:
        ranks = sorted(r.rank for r in slots if r.source == s.number)
        assert ranks == list(range(round(s.wanted)))
        # In words, with all blocks of a source alike.
        assert abs(len(ranks) * s.size / s.blocks - s.target) <= 0.005 * s.target


def test_any_run_of_slots_is_close_to_the_mixture(spark):
    planned = mixing.plan_sources([("a", 50_000), ("b", 30_000), ("c", 20_000)], (5, 2, 1), 1000)
    slots = sorted(mixing.schedule(spark, planned).collect())
    share = [s.wanted / sum(x.wanted for x in planned) for s in planned]
    for begin in range(0, len(slots) - 100, 50):
        part = [s.source for s in slots[begin : begin + 100]]
        assert all(abs(part.count(i) - 100 * share[i]) < 5 for i in range(3))
    for i in range(3):
        ranks = [s.rank for s in slots if s.source == i]
        assert ranks == list(range(len(ranks)))


def test_mixed_documents_keep_their_columns_and_repeat_at_most_three_times(spark):
    docs = cases.frame(spark)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts = mixed.groupBy("doc_id").count().collect()
    assert counts and all(r["count"] <= (6 if r.doc_id == 1009 else 3) for r in counts)


def test_mixed_blocks_order_the_words_that_are_taken(spark):
    docs = cases.frame(spark)
    rows = mixing.mixed_blocks(docs, slots=4096).collect()
    by_slot, by_row = {}, {}
    for r in rows:
        by_slot.setdefault(r.slot, set()).add((r.source, r.rank, r.block))
        by_row[r.row_id] = by_row.get(r.row_id, 0) + r.words
        assert r.words > 0 and 0 <= r.begin and r.begin + r.words <= r.size
    assert sorted(by_slot) == list(range(len(by_slot))) and all(len(own) == 1 for own in by_slot.values())
    taken = {r.row_id: r.taken for r in mixing.mix_words(docs, slots=4096).collect() if r.taken}
    assert by_row == taken


def test_a_document_taken_in_part_ends_at_the_last_word_taken(spark):
    long_text = " \n".join(cases.sentence("en", 1, 4000).split())
    rows = [(1, long_text, "en", "b", len(long_text))]
    rows += [(10 + i, cases.sentence("en", 10 + i, 200), "en", "a", 7) for i in range(20)]
    docs = cases.frame(spark, rows)
    (target,) = {r.target for r in mixing.mix_words(docs).collect() if r.doc_id == 1}
    (part,) = [r for r in mixing.mixed_documents(docs, (5.0, 2.0, 1.0)).collect() if r.source == "b"]
    assert 0 < target < 2300 and abs(len(part.text.split()) - target) <= 1
    assert long_text.startswith(part.text) and part.n_chars == len(part.text)


def encode(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


ODD = [
    "", "a  b", " a", "a ", "a\nb", "a\n\nb", "a \nb", "a\n b", "x<|endoftext|>y", "tab\tx", "a\xa0b c",
    "\n", " ", "don't stop 's 12 34ab", "é　ü", "a\n", "日本 語\nx", "a\r\nb", "a\t \tb", "I'm\nI'll 've", "“q” a\u2003b", "a\u3000 b", "é à", "\x1c a", "x <| y", "日 本\n語",
]


def test_words_encoded_apart_give_the_ids_of_the_whole_text():
    by = packing.encoder(None)

    def ids(texts):
        return [np.frombuffer(x, "<u4").tolist() for x in packing.encoded(texts, by)]

    odd = [*ODD, "end. (of) it's, §5 x--y,z... Ünï-çø, ʼn ɐb ħł!\n#1 $$$ a,b\nI'll, 'quoted' 3.14. dž", "’tis ªº µm"]
    assert ids(odd) == encode(odd)
    # The second time from memory, and from the older generation.
    by.known = packing.KnownWords(by.word, by.known)
    assert ids(odd) == encode(odd)
    assert ids([]) == []


def test_words_of_equal_sums_are_told_apart():
    """Long words of two letters whose polynomial sums agree in 64 bits, whatever the base."""
    word, mirror = "ab", "ba"
    for _ in range(10):
        word, mirror = word + mirror, mirror + word
    by = packing.encoder(None)
    texts = [f"x {word} y", f"x {mirror} y"]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encoded(texts, by)] == encode(texts)


def test_frequent_words_outlive_a_generation(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    by = packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("the cat sat on", "the dog", "the end of it all", "the"):
        packing.encoded([text], by)
    assert len(by.known) <= 6 and "the" in {*by.known, *by.known.older}
    assert "cat" not in {*by.known, *by.known.older}


@pytest.mark.parametrize("extra", [False, True])
def test_windows_hold_each_id_in_one_piece(spark, extra):
    docs = cases.frame(spark, extra=extra)
    rows = packing.packed(docs, window=64).collect()
    texts = docs.select("doc_id", "text").dropDuplicates().collect()
    ids = {r.doc_id: e + [0] for r, e in zip(texts, encode([r.text or "" for r in texts]), strict=True)}
    pieces = {}
    for r in rows:
        pieces.setdefault(r.row_id, []).append(r)
    assert len(pieces) == docs.count()
    for own in pieces.values():
        at, tokens = 0, ids[own[0].doc_id]
        for r in sorted(own, key=lambda r: r.start):
            part = np.array(tokens[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(tokens), zlib.crc32(part))
            at += r.length
        assert at == len(tokens)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(windows) == list(range(len(windows)))
    filled = []
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
        filled.append(at)
    assert sum(n < 64 for n in filled) <= 1


def test_least_squares_agrees_with_the_optimality_conditions():
    rng = np.random.default_rng(3)
    columns, wanted = rng.integers(0, 3, (12, 20)).astype(float), rng.random(12) * 10
    columns[0] = 1
    x = packing.least_squares(columns, wanted, 5000, 1e-9)
    slope = columns.T @ (columns @ x - wanted)
    assert (x >= 0).all() and (slope > -1e-4).all() and abs(slope[x > 1e-6]).max() < 1e-4


def test_combinations_fill_windows_and_never_use_more_than_there_is():
    histogram = {100: 50, 924: 30, 500: 40, 24: 10, 300: 9, 224: 9}
    solved = packing.repeats(histogram, 1024)
    used = dict.fromkeys(histogram, 0)
    for option, times in solved:
        assert sum(option) == 1024 and times > 0
        for n in option:
            used[n] += times
    assert all(used[n] <= histogram[n] for n in histogram)
    assert used[924] == 30
    assert packing.repeats({}, 1024) == [] and packing.repeats({7: 3}, 1024) == []


def test_rows_without_an_id_are_spread(spark):
    """A third of the ids null, with one text: no bin of an order holds much more than the others."""
    text = cases.sentence("en", 3, 20)
    rows = [(None if i % 3 == 0 else i, text if i % 3 == 0 else f"{text} {i}", "en", "s", 0) for i in range(6000)]
    docs = cases.frame(spark, rows).repartition(8)
    sized = mixing._sized(docs)
    # A group of equal texts has keys of its own for almost every row.
    assert sharding.keyed(docs).select("key").distinct().count() > 0.99 * len(rows)
    packed = packing.packed(docs, window=64)
    assert packed.select("row_id").distinct().count() == len(rows)
    counts = [r["count"] for r in sized.groupBy(F.shiftrightunsigned("_hash", 60).alias("k")).count().collect()]
    assert max(counts) <= 2 * sorted(counts)[len(counts) // 2]
    assert mixing.mix_words(docs).count() == len(rows)


def test_language_sample_draws_rows_without_an_id(spark):
    rows = [(None, cases.sentence("de", i, 12), "de", None, 0) for i in range(3 * langid.SAMPLE_PER_LANGUAGE)]
    model = langid.learned(cases.frame(spark, rows).repartition(8))
    assert model.languages == ("de",) and model.log_p.std() > 0
