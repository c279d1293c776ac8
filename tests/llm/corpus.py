"""A small invented corpus with every edge case, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re
import zlib

SYLLABLES = {
    "en": "th er on an re ing ly the and of to in is that".split(),
    "de": "sch ung keit der die und ein heit ver ge en ich".split(),
    "es": "ción mente de la que ar os as ez do mi ga".split(),
}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def prose(rng: random.Random, lang: str, n: int) -> str:
    out = []
    while n > 0:
        k = min(n, rng.randint(4, 14))
        out.append(sentence(rng, lang, k))
        n -= k
    return " ".join(out)


def junk(rng: random.Random, lang: str, n: int) -> str:
    return "\n".join(f"{w.upper()}!! $$$ ### | {w}" for w in prose(rng, lang, n).split())


def documents(seed: int = 5, n: int = 160) -> list[tuple]:
    """Rows (doc_id, text, lang, source, n_chars): prose, junk, copies, near copies and odd texts."""
    rng = random.Random(seed)
    rows: list[tuple] = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = junk(rng, lang, 30) if i % 5 == 4 else prose(rng, lang, rng.choice((3, 30, 120, 300)))
        rows.append((i, text, lang, f"s{i % 3 if i % 2 else 0}", len(text)))
    base = prose(rng, "en", 200)
    copies = [base] * 4
    for k in range(20):
        w = base.split()
        for _ in range(k % 5 + 1):
            w[rng.randrange(len(w))] = f"edit{k}{rng.randrange(99)}"
        copies.append(" ".join(w))
    rows += [(1000 + k, t, "en", "s0", len(t)) for k, t in enumerate(copies)]
    odd = [None, "", " \n\t ", "a", "one two three four", "One Two Three Four", "12 34 !!", "é" * 3, "x" * 5000, prose(rng, "de", 6000), "日本語 テキスト ²½", "<|endoftext|> a  b <|ENDOFTEXT|>", "line here\nline here\nline here\n" * 10]
    rows += [(2000 + k, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s1", None) for k, t in enumerate(odd)]
    rows += [(None, "a text without an id " * 5, "en", "s1", 0), rows[0], rows[0], (3000, None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def labels(spark, rows: list[tuple]):
    found = [(r[0], 0 if r[0] % 5 == 4 else 1, 0) for r in rows if r[0] is not None and r[0] < 160]
    return spark.createDataFrame(found, "doc_id long, quality int, toxic int")


def bucket(doc_id: int, m: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % m


def shingles(text: str | None) -> set:
    w = words(lower(text or ""))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def component_of(links: list[tuple], ids) -> dict:
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_components(rows: list[tuple], percent: int = 85) -> dict:
    """Component of each id by comparing all pairs."""
    sets: dict = {}
    for r in rows:
        if r[0] is not None:
            sets.setdefault(r[0], []).append(shingles(r[1]))
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    both = len(x & y)
                    if both and 100 * both >= percent * (len(x) + len(y) - both):
                        links.append((a, b))
    return component_of(links, ids)
