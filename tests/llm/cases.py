"""Small document tables with odd rows, and brute-force forms of what operators compute."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^ \t-\r]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {
    "en": "the and of to in that ing tion er ness ly wh th sh".split(),
    "de": "der die und sch ung keit ein zu über größe pf tz ver ge".split(),
}


def sentence(lang: str, seed: int, n: int) -> str:
    """n words made from a fixed rule, so that texts of different seeds share no long run."""
    parts = SYLLABLES[lang]
    k = len(parts)
    words, state = [], seed * 7919 + 13
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        words.append(parts[state // 7 % k] + parts[state // 901 % k] + parts[state // 70001 % k])
    return " ".join(words)


def plain_rows(n: int = 60, words: int = 40) -> list[tuple]:
    rows = []
    for i in range(n):
        lang = "de" if i % 3 == 2 else "en"
        text = sentence(lang, i, words + i % 7) + ".\n" + sentence(lang, i + 1000, 12) + "."
        rows.append((i, text, lang, f"src{i % 4}" if i % 9 else None, len(text)))
    return rows


def odd_rows() -> list[tuple]:
    """Null, empty, blank, short, very long, repeated and hot texts, and null columns."""
    long_text = "\n".join(sentence("en", 5000 + i, 60) for i in range(300))
    copies = sentence("en", 77, 50)
    return [
        (1000, None, "en", "src0", None),
        (1001, "", None, None, 0),
        (1002, " \n\t ", "en", "src1", 4),
        (1003, "12 34 !!", "en", "src1", 8),
        (1004, "one", "en", "src1", 3),
        (1005, long_text, "en", "src2", len(long_text)),
        (1006, "naïve 日本語 😀 a\u00a0b", None, "src2", 17),
        (1007, "<|im_end|> | ### $$$ %%% &&&", "en", "src3", 27),
        (1009, "same id", "en", "src3", 7),
        (1009, "same id", "en", "src3", 7),
    ] + [(2000 + i, copies, "en", "hot", len(copies)) for i in range(40)]


def frame(spark, rows=None, extra: bool = False):
    """Documents; `extra` adds columns named like an operator's own."""
    df = spark.createDataFrame(plain_rows() + odd_rows() if rows is None else rows, DOCUMENTS)
    if extra:
        for name in ("size", "key", "range", "bands", "row_id", "begin", "score", "row", "block", "_bin"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def shingle_set(text: str | None) -> frozenset:
    words = WORD.findall(text or "")
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def duplicate_classes(rows: list[tuple[int, str | None]], least: float = 0.8) -> dict[int, int]:
    """Class of each id by comparing all texts that share a shingle."""
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    first: dict[str, int] = {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        if text is not None:
            join(i, first.setdefault(text, i))
    sets = {i: shingle_set(text) for text, i in first.items()}
    holders = defaultdict(list)
    for i, own in sets.items():
        shared = Counter(j for s in own for j in holders[s])
        for j, n in shared.items():
            if n / (len(own) + len(sets[j]) - n) >= least:
                join(i, j)
        for s in own:
            holders[s].append(i)
    return {i: find(i) for i, _ in rows}
