"""Main text of pages, vector codes and importance resampling."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from cellpulse.llm import codes, extract, resample, sql

# Pages.

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>if (a<b) x("</p>");</script></head>
<body class="has-sidebar comments-open"><header><h2>Site</h2><a href='/'>Home</a></header>
<div class="cookie-notice">We use cookies</div>
<form id="aspnet"><div class="layout with-sidebar"><main><article><header><h1>Fish &amp; chips &lt;3</h1></header>
<p>One <b>bold<p>Two<br>lines &#x41;&nbsp;&copy; R&ampD &am
<ul><li>item <a href="x?a=1>2">one</a><li>item two</ul><div class="ad">Buy</div><!-- <p>gone</p> --><p>Ok.
<table><tr><td>a<td>b</table><select><option>x<option>y</select><figure><figcaption>Cap</figcaption></figure>
<div class="share">Share me</div><aside>Aside</aside></article>
<section id="comments"><article class="comment"><p>First reader says so.</p></article></section></main>
<div class="sidebar"><p>Side</p></div></div></form><footer>Foot</footer><nav><ul><li>N</ul></nav></body></html>"""
WANTED = ["Fish & chips <3", "One bold", "Two lines A © R&D &am", "item one", "item two", "Ok.", "a", "b", "Cap"]


def pages(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("text", "marks", "n_chars") if extra else ():
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.mark.parametrize("extra", [False, True])
def test_pages_of_every_kind(spark, extra):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE), (5, "x", "<nav>menu</nav>")]
    rows += [(8, "l", "<article>" + "<p>word word.</p>" * 20_000 + "</article>")]
    found = extract.extracted(pages(spark, rows, extra)).collect()
    assert len(found) == len(rows)
    texts = Counter((r.page_id, r.url, r.text) for r in found)
    assert texts[1, "u", "\n\n".join(WANTED)] == 2
    assert texts[2, None, ""] == texts[None, "v", ""] == texts[5, "x", ""] == 1
    assert texts[8, "l", "\n\n".join(["word word."] * 20_000)] == 1
    assert all(r.n_chars == len(r.text) for r in found)


def test_unmarked_pages_are_kept_where_nothing_was_learned(spark):
    rows = [(4, "w", "no tags & <3 at all"), (6, "y", "<p>open <!-- never closed")]
    rows += [(7, "z", "<p>a</p><script>" + "<p>x" * 9), (8, "q", "<button>b<div>c</div></p><p>d")]
    texts = {r.page_id: r.text for r in extract.extracted(pages(spark, rows)).collect()}
    assert texts == {4: "no tags & <3 at all", 6: "open", 7: "a", 8: ""}


def test_no_pages(spark):
    assert extract.extracted(pages(spark, [])).count() == 0


def test_classifier_and_neighbours_decide_where_nothing_is_marked(spark):
    """Marked pages teach that linked scraps are boilerplate; unmarked pages are then cut by cost."""
    sentence = "Many plain words make one long and quiet sentence of the text that people read."
    links = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(6))
    marked = f"<nav><ul>{links}</ul></nav><article><h1>Head</h1><p>{sentence}</p><p>{sentence}</p></article>"
    bare = f"<div><ul>{links}</ul></div><div><p>{sentence}</p><p>Yes.</p><p>{sentence}</p></div>"
    rows = [(i, "u", marked) for i in range(30)] + [(100, "u", bare)]
    texts = {r.page_id: r.text for r in extract.extracted(pages(spark, rows)).collect()}
    assert texts[0] == f"Head\n\n{sentence}\n\n{sentence}"
    # The short paragraph stays because its neighbours do.
    assert texts[100] == f"{sentence}\n\nYes.\n\n{sentence}"


def test_minimum_cut_equals_trying_all_labels():
    rnd = random.Random(5)
    for _ in range(400):
        n = rnd.randint(1, 8)
        own = [rnd.randint(-12, 12) for _ in range(n)]
        edges = [(i - 1, i, rnd.randint(0, 8)) for i in range(1, n)]
        edges += [(rnd.randrange(n), rnd.randrange(n), rnd.randint(0, 6)) for _ in range(rnd.randint(0, n))]

        def cost(labels, own=own, edges=edges):
            alone = sum(max(0, -o) if x else max(0, o) for o, x in zip(own, labels, strict=True))
            return alone + sum(c for i, j, c in edges if labels[i] != labels[j])

        ways = list(itertools.product([False, True], repeat=n))
        least = min(map(cost, ways))
        most = max((w for w in ways if cost(w) == least), key=sum)
        assert extract.minimum_cut(own, edges) == list(most)


@pytest.mark.parametrize("odd", ["<", "<!--", "<a ", "<a b='", "&", "<svg>", "<div><p>a", "</div>", "<a = '"])
def test_reading_is_linear_in_odd_markup(odd):
    assert len(extract.blocks_of(odd * 100_000)) <= 100_000


# Vectors.


def plain_codes(rows):
    """Lloyd rounds with full scans, in whole numbers."""
    kept = [
        (i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    width = len(kept[0][1]) // 8
    books = [[v[p * width : (p + 1) * width] for _, v, _ in first] for p in range(8)]

    def nearest(v, p):
        part = v[p * width : (p + 1) * width]
        all_ = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in books[p]]
        return min(all_), all_.index(min(all_)), part

    for _ in range(6):
        for p in range(8):
            members = {}
            for _, v, _ in kept:
                _, e, part = nearest(v, p)
                members.setdefault(e, []).append(part)
            for e, held in members.items():
                books[p][e] = [sum(c) // len(held) for c in zip(*held, strict=True)]
    out, by_label = [], Counter()
    for i, v, label in kept:
        found = [nearest(v, p) for p in range(8)]
        out.append((i, label, "".join(f"{e:02x}" for _, e, _ in found), sum(d for d, _, _ in found)))
        by_label[label] += out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, c, d, by_label[label], digest) for i, label, c, d in out)


def vector_rows(n=120):
    rnd = random.Random(3)
    rows = [(i if i % 11 else None, [rnd.gauss(i % 5, 0.3) for _ in range(16)], i % 3 if i % 4 else None) for i in range(n)]
    # Repeated ids, a hot vector, and vectors that are dropped.
    rows += [(7, [0.5] * 16, 1), (7, [0.25] * 16, 1)] + [(1000 + i, [1.5] * 16, 9) for i in range(60)]
    bad = [None, [None] + [0.0] * 15, [math.nan] + [0.0] * 15, [math.inf] + [0.0] * 15, [-math.inf] * 16]
    return rows + [(2000 + i, v, 1) for i, v in enumerate(bad)]


def vectors(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for name in ("codes", "ints", "error", "_label", "slot") if extra else ():
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(5)


@pytest.mark.parametrize("rows,extra", [(vector_rows(), False), (vector_rows(), True), (vector_rows()[:9], False)])
def test_codes_equal_full_scans(spark, rows, extra):
    found = codes.code_digests(vectors(spark, rows, extra)).collect()
    wanted = plain_codes(rows)
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found) == wanted


def test_no_vectors_and_wrong_vectors(spark):
    assert codes.code_digests(vectors(spark, [])).collect() == []
    assert codes.code_digests(vectors(spark, [(1, None, 1), (2, [math.nan] * 16, 1)])).collect() == []
    with pytest.raises(Exception, match="needs 16 components"):
        codes.code_digests(vectors(spark, [(1, [0.0] * 16, 1), (2, [0.0] * 8, 1)])).collect()


def test_bounds_save_scans_and_never_change_a_code():
    rng = np.random.default_rng(8)
    vectors_ = rng.integers(-4000, 4000, (3000, 2, 4)) + np.repeat(rng.integers(-9000, 9000, (3000, 2, 1)), 4, 2)
    history = [vectors_[:16].swapaxes(0, 1).astype(np.int64)]
    held, saved = codes.Bounds.unknown(3000, 2), 0
    for _ in range(12):
        held, scanned = codes.reassign(vectors_, held, np.stack(history))
        saved += held.codes.size - scanned
        squares = ((vectors_[:, :, None] - history[-1][None]) ** 2).sum(-1)
        assert (held.codes == squares.argmin(2)).all()
        book = history[-1].copy()
        for p in range(2):
            for e in np.unique(held.codes[:, p]):
                part = vectors_[held.codes[:, p] == e, p]
                book[p, e] = part.sum(0) // len(part)
        history.append(book)
    assert saved > held.codes.size * 12 * 0.4


def test_net_displacement_is_never_more_than_the_sum_of_drifts():
    rng = np.random.default_rng(4)
    history = rng.integers(-100, 100, (6, 2, 5, 4))
    own, others = codes.displacements(history)
    drift = np.sqrt((np.diff(history, axis=0) ** 2).sum(-1))
    for r in range(6):
        assert (own[r] <= drift[r:].sum(0) + 1e-6).all()
        assert all(others[r, p, e] == max(np.delete(own[r, p], e)) for p in range(2) for e in range(5))


# n-grams.

FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, longest):
    words = FEATURE.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_draw(rows, target, longest, buckets):
    def bucket(g):
        return zlib.crc32(g.encode()) % buckets

    raw = Counter(bucket(g) for _, t in rows for g in grams(t, longest)[1])
    aim = Counter(bucket(g) for t in target for g in grams(t, longest)[1])
    s_all, t_all = sum(raw.values()), sum(aim.values())
    gain = {
        b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets)))) for b in raw
    }
    out = []
    for i, t in rows:
        words, found = grams(t, longest)
        weight = sum(gain[bucket(g)] for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, len(words)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: 10 * len(able) // 100], 1):
        r[4] = rank
    return out


@pytest.mark.parametrize("longest,extra", [(1, False), (3, True)])
def test_draw_equals_a_plain_one(spark, longest, extra):
    rows = cases.plain_rows(90) + cases.odd_rows()
    rows += [(i, "Çà et LÀ, naïve-ÜBER_x 3.14 " + cases.sentence("en", i, 30), None, None, 0) for i in range(3000, 3020)]
    target = [cases.sentence("de", 2, 40), None, "", "Über ALLES und nichts"]
    docs = cases.frame(spark, rows, extra=extra)
    found = resample.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), longest, 500)
    wanted = plain_draw([(r[0], r[1]) for r in rows], target, longest, 500)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()) == Counter(
        tuple(r[:5]) for r in wanted
    )


def test_draw_with_null_and_repeated_ids_ranks_without_gaps(spark):
    text = cases.sentence("en", 1, 25)
    rows = [(None, text, None, None, 0)] * 300 + [(5, text, None, None, 0)] * 200 + cases.plain_rows(100, 30)
    found = resample.resampled(cases.frame(spark, rows), cases.empty(spark)).collect()
    assert len(found) == 600
    ranks = sorted(r["rank"] for r in found if r["rank"] is not None)
    assert ranks == list(range(1, 61))
    drawn = [r.score for r in sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])]
    assert drawn == sorted(drawn, reverse=True)
    assert resample.resampled(cases.empty(spark), cases.empty(spark)).collect() == []


def test_sql_of_codes_follows_its_parameters():
    assert "book3" in sql.vector_codes(rounds=3) and "book4" not in sql.vector_codes(rounds=3)
