"""Operators that read texts: rules, fingerprints, chats and URLs."""

import hashlib
import re
from collections import Counter
from itertools import pairwise

import cases
import pytest
from pyspark.sql import functions as F

from cellpulse.llm import chat, fingerprint, rules, urls

LABELS = "doc_id long, quality int, toxic int"


def counts_of(text):
    words = cases.WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if cases.WORD.search(x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {
        i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)
    }
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), len(covered),
    )


REPEATS = [
    (3001, "a b c d e f a b c d e g", None, None, 0),
    (3002, "x x x x x x x x", None, None, 0),
    (3003, "l one\nl one\n\n \nl one\n l one", None, None, 0),
    (3004, " ".join(str(i % 5000) for i in range(20_000)), None, None, 0),
    (3005, "a b c d e a b c d e a b c d e", None, None, 0),
]


@pytest.mark.parametrize("extra", [False, True])
def test_rule_counts_equal_a_plain_count(spark, extra):
    rows = cases.plain_rows(9) + cases.odd_rows() + REPEATS
    docs = cases.frame(spark, rows, extra=extra)
    texts = {r[0]: r[1] for r in rows}
    labels = spark.createDataFrame([(0, 1, 0), (1, None, 0), (77777, 0, 0)], LABELS)
    for r in rules.judged(docs, labels).collect():
        wanted = counts_of(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == wanted
        assert r.base_failed == (wanted[0] < 10 or 100 * wanted[4] > 20 * wanted[0])
        # Too few labels for any cutoff: only the base rules reject.
        assert r.kept == (not r.base_failed)


def test_cutoffs_are_safe_and_reject_what_good_texts_never_are(spark):
    base = " ".join(f"word{i}" for i in range(40))
    good = [(i, f"{base} {i}", None, None, 0) for i in range(4000)]
    bad = [(10_000 + i, f"{base} " + " ".join(f"$$${j}" for j in range(30)) + f" {i}", None, None, 0) for i in range(50)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4000)], LABELS)
    judged = rules.judged(cases.frame(spark, good + bad), labels)
    kept = {r.doc_id: (r.kept, r.rejected_by) for r in judged.collect()}
    assert all(kept[i][0] for i in range(4000))
    assert all(kept[10_000 + i] == (False, "symbols") for i in range(50))
    # Hardly any labels: the bound can't be met, so nothing is rejected.
    few = rules.judged(cases.frame(spark, good + bad), labels.limit(20))
    assert few.where("NOT kept").count() == 0
    assert rules.judged(cases.empty(spark), labels).collect() == []


def test_binomial_tail_is_exact():
    def exact(k, n, p):
        from math import comb

        return sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))

    for k, n, p in ((0, 100, 0.05), (3, 400, 0.02), (1, 50, 0.1), (10, 5000, 0.005)):
        assert rules.binomial_tail(k, n, p) == pytest.approx(exact(k, n, p), rel=1e-9)
    assert rules.binomial_tail(5, 5, 0.1) == 1.0 and rules.binomial_tail(0, 0, 0.1) == 1.0


def pieces(text):
    return set(re.findall(r"[^\n]{1,200}\n?|\n", text))


@pytest.mark.parametrize("extra", [False, True])
def test_fingerprints_tell_the_likeness_of_versions(spark, extra):
    docs = cases.frame(spark, extra=extra)
    ordered = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    wanted = []
    for (i, text), (_, after) in pairwise([*ordered, ordered[0]]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        near = [
            len(pieces(text) & pieces(x)) / len(pieces(text) | pieces(x)) if pieces(text) | pieces(x) else 1.0
            for x in (edited, after)
        ]
        wanted.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *near))
    rows = fingerprint.version_prints(docs).collect()
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows]
    for a, b in zip(sorted(got), sorted(wanted), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:])
    texts, prints = dict(ordered), {}
    for r in rows:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert fingerprint.version_prints(cases.empty(spark)).collect() == []


def test_a_small_sketch_is_retried_larger_until_all_digests_come_out(spark):
    rows = spark.range(1).selectExpr(
        "transform(sequence(1, 300), i -> xxhash64(i) & 9223372036854775807L) AS a",
        "transform(sequence(251, 400), i -> xxhash64(i) & 9223372036854775807L) AS b",
    )
    found = rows.selectExpr(f"{fingerprint.let('w', 'named_struct(\'a\', a, \'b\', b)', fingerprint.difference())} AS d")
    d = found.select("d.*").first()
    assert (len(d.plus), len(d.minus), d.whole) == (250, 100, True)


def test_turns_of_every_layout(spark):
    schema = (
        "id long, prompt string, completion string, instruction string, input string, output string,"
        " messages array<struct<role string, content string>>,"
        " conversations array<struct<`from` string, value string>>, other int"
    )
    rows = [
        (1, "p", "c", None, None, None, None, None, None),
        (2, None, None, "do", "this", "done", None, None, None),
        (3, None, None, "do", None, "done", None, None, None),
        (4, None, None, None, None, None, [("system", "s"), ("user", None)], None, None),
        (5, None, None, None, None, None, None, [("human", "h"), ("gpt", "g")], None),
        (6, "p", None, None, None, "o", None, None, None),
        (7, None, None, None, None, None, [], None, None),
    ]
    records = spark.createDataFrame(rows, schema).drop("other")
    got = {r.id: (r.layout, [tuple(t) for t in r.turns or []]) for r in chat.canonical_turns(records, "id").collect()}
    assert got == {
        1: ("prompt_completion", [("user", "p"), ("assistant", "c")]),
        2: ("instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
        3: ("instruction", [("user", "do"), ("assistant", "done")]),
        4: ("role_content", [("system", "s"), ("user", None)]),
        5: ("from_value", [("user", "h"), ("assistant", "g")]),
        6: (None, []),
        7: (None, []),
    }


def test_chats_come_back_from_the_template(spark):
    rows = [
        (1, 0, "user", "<|im_end|>\n<|im_start|>assistant\nok <| <~| <~~|"),
        (1, 1, "assistant", "<|im_end|>"),
        (1, 1, "assistant", "<|im_end|>"),
        (2, None, None, None),
        (2, 0, "assistant", ""),
        (2, 1, "ro%0Ale\nx|<|", "a\\|<"),
        (3, 1, "assistant", "second"),
        (3, 0, "assistant", "first 😀"),
    ] + [(4, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clashing = df.selectExpr("*", "'x' AS loss", "1 AS turns", "2 AS messages")
    for frame in (df, clashing):
        got = {r.conv_id: r for r in chat.chat_digests(frame).collect()}
        for conv in (1, 2, 3, 4):
            own = sorted(((t if t is not None else -1), r or "", x or "") for c, t, r, x in rows if c == conv)
            turns = "".join(f"{r}\n{x}\n" for _, r, x in own)
            loss = "".join(x for _, r, x in own if r == "assistant")
            r = got[conv]
            assert r.n_turns == len(own)
            assert r.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
            assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_digests(df.where("conv_id = 9")).collect() == []


RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"), ("example.net", "/en/ads", "block"), ("a.example.net", "", "allow"), ("", "/", "block"),
]
URLS = [
    None, "", "no scheme", "http://", "http://NET/", "https://x.Example.NET/en/1?q#f", "http://example.net/en",
    "http://example.net/en/ads/1", "http://a.example.net", "http://b.a.example.net/en/ads", "x://examplex.net/a",
    "http://net-x.org/fr/", "http://ÄB.org/fr/x", "http://u@example.com:80/de/", "http://example.com/de/?a://b",
    "http://example.com\n/de/", "a://b://c.net/", "http://.net/", "http://net./", "http://example.com?x/de/",
]


def plain_judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        ((len(h) + len(p), len(h), v == "block"), h + p, v)
        for h, p, v in RULES
        if h and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls_meet_the_longest_rule(spark):
    n = 3
    pages = [(i, u, "html") for i, u in enumerate(URLS * n)] + [(9000 + i, "http://www.example.net/en/", "") for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for frame in (df, df.selectExpr("*", "1 AS bucket", "'k' AS key", "'h' AS host", "0 AS salt")):
        got = {r.page_id: tuple(r)[1:] for r in urls.judge_urls(frame, listed).collect()}
        assert got == {i: plain_judge(u) for i, u, _ in pages}
    assert urls.judge_urls(df.where("page_id < 0"), listed).collect() == []
    assert urls.judge_urls(df, listed.limit(0)).where(F.col("rule").isNotNull()).count() == 0


@pytest.mark.parametrize("kind", ["long", "int", "string", "decimal(30,0)"])
def test_page_ids_come_back_as_they_are(spark, kind):
    ids = [2**53 + 1 + 2 * i if kind in ("long", "string", "decimal(30,0)") else i for i in range(40)] + [None] * 60
    pages = spark.createDataFrame(
        [(None if i is None else str(i), f"http://a{n % 3}.org/fr/{n}") for n, i in enumerate(ids)], "page_id string, url string"
    ).withColumn("page_id", F.col("page_id").cast(kind))
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    judged = urls.judge_urls(pages, listed)
    assert judged.schema["page_id"].dataType == pages.schema["page_id"].dataType
    got = Counter(None if r.page_id is None else int(r.page_id) for r in judged.collect())
    assert got == Counter(ids)
