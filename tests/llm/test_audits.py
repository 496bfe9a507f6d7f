"""Substring removal, prefix tries and source divergence against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestrata.llm.divergence import radix_select, source_divergence
from lodestrata.llm.fmindex import FmIndex, repeated_windows
from lodestrata.llm.prefixes import LevelTrie, conversations_of, louds, prefix_trie, rebuilt
from lodestrata.llm.scratch import Scratch
from lodestrata.llm.substrings import remove_repeats

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string"


# ---- substrings ------------------------------------------------------------------
def brute_repeats(texts, window):
    words = [SPACE.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def planted(seed, n=60):
    r = random.Random(seed)
    fresh = lambda k: [f"w{r.randrange(400)}" for _ in range(k)]
    shared = [fresh(r.randrange(8, 50)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [r.choice(shared) if r.random() < 0.5 else fresh(r.randrange(1, 30)) for _ in range(r.randrange(1, 6))]
        if r.random() < 0.2:
            parts.append(["a"] * r.randrange(10, 40))
        if r.random() < 0.2:
            parts.append(["x", "y", "é z"] * r.randrange(3, 12))
        words = [w for p in parts for w in p]
        if texts and r.random() < 0.3:
            words = SPACE.findall(r.choice(texts) or "")
            if words and r.random() < 0.5:
                words[r.randrange(len(words))] = "changed"
        texts.append(r.choice([" ", "\n", "\t \x0b"]).join(words))
    return texts + [None, "", " \n ", texts[0], "short text"]


@pytest.mark.parametrize("seed, window, gram, shard, most", [(1, 9, 3, 500, 4096), (2, 9, 3, 1 << 20, 2), (3, 12, 5, 200, 3), (4, 35, 8, 1 << 20, 4096)])
def test_repeats_equal_brute_force(spark, seed, window, gram, shard, most):
    texts = planted(seed)
    rows = [(i, t, None, "s") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(spark.createDataFrame(rows, DOCS), window, gram, shard, most).collect()}
    want = dict(enumerate(brute_repeats(texts, window)))
    assert got == want
    assert any(n for _, n, _ in want.values())


def test_repeats_of_odd_rows(spark):
    line = " ".join(f"v{i}" for i in range(40))
    rows = [(None, line, None, None), (None, line, None, None), (7, line + " tail", None, None), (7, None, None, None), (8, "w " * 200, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    clash = df.select("doc_id", "text", *[df.doc_id.alias(c) for c in ("h", "x", "u", "v", "place", "wanted", "found", "kept")])
    got = sorted(((r.doc_id or -1, r.n_words, r.n_removed, r.kept, [(s.start, s.end) for s in r.spans]) for r in remove_repeats(clash).collect()), key=repr)
    whole = [(0, 40)]
    assert got == sorted([(-1, 40, 40, "", whole), (-1, 40, 40, "", whole), (7, 41, 40, "tail", whole), (7, 0, 0, "", []), (8, 200, 200, "", [(0, 200)])], key=repr)
    assert remove_repeats(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(df, window=80, gram=4)


def test_index_counts_like_a_scan():
    r = np.random.default_rng(5)
    parts = [r.integers(1, 6, r.integers(4, 12)) for _ in range(50)]
    weights = r.integers(1, 3, 50)
    text = np.concatenate([np.append(p, 0) for p in parts])
    index = FmIndex(text, weights, 12)
    first = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
    last = first + [len(p) - 1 for p in parts]
    bits = repeated_windows(index, text, first, last, 4)
    seen = Counter()
    for p, w in zip(parts, weights, strict=True):
        for i in range(len(p) - 3):
            seen[tuple(p[i : i + 4])] += int(w)
    assert [[int(b) >> i & 1 for i in range(len(p) - 3)] for p, b in zip(parts, bits, strict=True)] == [[int(seen[tuple(p[i : i + 4])] > 1) for i in range(len(p) - 3)] for p in parts]


# ---- prefix tries ----------------------------------------------------------------
TALK = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs[c].append((role or "", text or ""))
    done = {c: (convs.get(c - c % 20, []))[: (h := zlib.crc32(str(c).encode()) % 4)] + t[h:] for c, t in convs.items()}
    members = defaultdict(list)
    for c, t in done.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    out = set()
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        child = lambda p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p]
        saved = sum((len(members[p]) - 1) * len(SPACE.findall(p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(done[c]) == len(path)))
        out.add((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(child(path)), sum(not child(p) for p in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("shard", [3, 12, 1 << 19])
def test_trie_equals_brute_force(spark, shard):
    r = random.Random(shard)
    say = lambda: (r.choice(["user", "assistant", None]), r.choice(["a b", "c", "", None, "d  e\tf"]))
    rows = [(c, r.choice([None, k, k]), *say()) for c in r.sample(range(120), 70) for k in range(r.randrange(1, 6))]
    rows += [(c, k, "user", f"{k} same words") for c in range(200, 230) for k in range(6)] + [(None, 1, "user", "lost"), (41, None, None, None), (41, None, None, None), (61, 0, "u", "x")]
    df = spark.createDataFrame(rows, TALK).selectExpr("*", "turn as a", "turn as w", "turn as path", "turn as cut")
    got = [tuple(x) for x in prefix_trie(rebuilt(conversations_of(df)), shard).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_trie(rows)


def test_trie_of_nothing_and_of_one_long_path(spark):
    assert prefix_trie(rebuilt(conversations_of(spark.createDataFrame([], TALK)))).count() == 0
    rows = [(c, k, "user", f"word {k}") for c in (400, 420) for k in range(90)]
    got = {tuple(x) for x in prefix_trie(rebuilt(conversations_of(spark.createDataFrame(rows, TALK))), 20).collect()}
    assert got == brute_trie(rows)


def test_louds_gives_children_and_parents():
    # two tops; the first has two children, of which the second has one
    a = np.array([1, 2, 1, 3, 4, 5])
    trie = LevelTrie(np.array([0, 2, 5, 6]), a, a, a, np.ones(3, np.int64), np.arange(3), np.ones(3, np.int64))
    assert trie.bits.astype(int).tolist() == [1, 1, 0, 1, 1, 0, 0, 0, 1, 0, 0]
    assert trie.degrees().tolist() == [2, 0, 0, 1, 0] and trie.parents().tolist() == [-1, -1, 0, 0, 3]
    assert louds(np.zeros(0, np.int64), 0).tolist() == [False]


# ---- divergence ------------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_divergence(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [((l or ""), (s or ""), TERM.findall((t or "").translate(lower))) for _, t, l, s in rows]
    out = []
    for lang in {l for l, _, _ in docs}:
        seen = Counter(t for l, _, ts in docs if l == lang for t in set(ts))
        kept = [t for t, n in seen.items() if n >= least]
        count = defaultdict(Counter)
        for l, s, ts in docs:
            if l == lang:
                count[s].update(t for t in ts if t in kept)
        whole = sum(count.values(), Counter())
        v = len(kept)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        ps, q = {s: p(c) for s, c in count.items()}, p(whole)
        for s in count:
            for part, items, most in (("pair", {o: sum(f(ps[s][t], ps[o][t]) for t in kept) for o in count if o != s}, None), ("term", {t: f(ps[s][t], q[t]) for t in kept if count[s][t] and ps[s][t] > q[t]}, top)):
                ranked = sorted(items.items(), key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("seed, least, top, few", [(1, 3, 5, 3), (2, 2, 4, 1000), (3, 40, 10, 1)])
def test_divergence_equals_brute_force(spark, seed, least, top, few):
    r = random.Random(seed)
    vocab = [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["Énorme", "中文", "𝒳x", "ABC", "abc"]
    rows = [(i, " ".join(r.choice(vocab[: r.randrange(5, len(vocab))]) + r.choice(["", ",", "1"]) for _ in range(r.randrange(0, 40))), r.choice(["en", "en", "de", None]), r.choice(["a", "b", "c", None, "é"])) for i in range(150)]
    rows += [(1, None, "en", "empty"), (2, "1 2 3", "xx", "p"), (2, "", "xx", "q"), (3, "only", "yy", "alone")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "doc_id as p", "doc_id as n", "doc_id as value", "doc_id as sid")
    got = sorted(tuple(x) for x in source_divergence(df, least, top, few).collect())
    assert got == brute_divergence(rows, least, top)


def test_divergence_of_nothing(spark):
    assert source_divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_radix_select_keeps_what_can_lead(spark):
    r = random.Random(9)
    rows = [(g, f"item{r.randrange(10**6)}-{i}", r.choice([0, 5, 2**29, 2**30 - 1, r.randrange(2**30)]) if g < 2 else 7) for g in range(4) for i in range((30, 400, 300, 2)[g])]
    df = spark.createDataFrame(rows, "g long, item string, value long")
    got = [tuple(x) for x in radix_select(df, ["g"], Scratch(spark), top=8, few=10).select("g", "item", "value").collect()]
    assert len(got) == len(set(got)) and len(got) < 100
    for g in range(4):
        ranked = lambda all_: sorted((x for x in all_ if x[0] == g), key=lambda x: (-x[2], x[1]))[:8]
        assert ranked(got) == ranked(rows)
