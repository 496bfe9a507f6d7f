"""The ten operations against brute force, and on odd rows."""

import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import chat, fingerprints, html, jaccard, langid, mixing, neighbours, secrets, tokens
from lodestrata.llm.graph import components
from lodestrata.llm.scratch import Scratch
from lodestrata.llm.shingles import shingle_sets
from lodestrata.llm.workers import BATCH_BYTES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS)


ODD = [
    (1, None, "en", "a"),
    (2, "", None, "a"),
    (3, " \n\t ", "en", None),
    (4, "one", "en", "b"),
    (4, "one", "en", "b"),
    (None, "a row without an id", None, None),
    (None, None, None, None),
    (5, "x " * 30_000, "en", "b"),
    (6, "日本語 текст ελληνικά \x00 \U0001f600", "de", "c"),
]


def test_odd_rows_pass_every_operation(spark):
    for rows in (ODD, []):
        table = docs(spark, rows).withColumns({"size": F.lit("clash"), "start": F.lit(1), "bucket": F.lit(None).cast("int"), "hash": F.lit("h"), "n_tokens": F.lit("t")})
        n = len(rows)
        assert tokens.count_tokens(table, path=public_tokenizers.path("byte_bpe_50k.json")).count() == n
        assert tokens.encode_pieces(table, path=public_tokenizers.path("piece_bpe_32k.model")).count() == n
        assert jaccard.near_documents(table, words=3, percent=90).count() == n
        assert fingerprints.version_fingerprints(table).count() == n
        assert langid.predict_languages(table).count() == n
        assert secrets.secret_digests(table).count() == n
        assert mixing.mix_sources(table).count() == n
        assert secrets.redact_secrets(table).columns == table.columns
        assert secrets.redact_secrets(table).count() == n
        for stage in (mixing.mixed_documents, jaccard.keep_one_of_each, langid.keep_known_languages):
            assert stage(table).columns == table.columns
            assert stage(table).count() >= 0


# 1
@pytest.mark.parametrize("together", [None, 1, 2])
def test_near_vectors_match_brute_force(spark, together):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    v = [centres[i % 40] + rng.normal(scale=0.05, size=16) for i in range(400)] + [centres[0]] * 5
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, []), (904, [1.0, 2.0]), (905, [2.0, 4.0]), (906, [None] * 16), (907, [1e300] * 16), (None, [1.0] * 16)]
    got = {r.vec_id: r for r in neighbours.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"e": F.lit("clash"), "key": F.lit(1), "rep": F.lit("r"), "weight": F.lit(0)}), block=64, together=together).collect()}
    unit = np.array(v) / np.linalg.norm(v, axis=1)[:, None]
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    found = sum(got[i].n_links for i in range(len(v)))
    assert all(got[i].n_links <= links[i].sum() for i in range(len(v)))
    assert found >= 0.9 * links.sum()
    low = np.arange(len(v))
    for _ in range(40):
        low = np.array([min([low[i], *low[np.flatnonzero(links[i])]]) for i in range(len(v))])
    assert [got[i].component_id for i in range(len(v))] == low.tolist()
    assert [got[i].n_links for i in (900, 901, 902, 903, 904, 905, 906)] == [0, 0, 0, 0, 1, 1, 0]
    assert got[905].component_id == 904 and not got[905].kept and got[900].kept
    assert got[None].n_links == 0
    if together:
        return
    assert neighbours.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    mixed = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [5.0, 0.0]), (4, [1.0] * 5000), (5, [2.0] * 5000), (6, [1.0])] + [(10 + n, [1.0] * (n + 3)) for n in range(6)]
    got = {(r.vec_id, r.n_links, r.component_id) for r in neighbours.near_vectors(spark.createDataFrame(mixed, "vec_id long, embedding array<double>")).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 4), (5, 1, 4), (6, 0, 6)} | {(10 + n, 0, 10 + n) for n in range(6)}


def test_recall_at_several_sizes(spark):
    for n in (300, 3000):
        rng = np.random.default_rng(n)
        centres = rng.normal(size=(n // 6, 32))
        v = centres[np.arange(n) % len(centres)] + rng.normal(scale=0.12, size=(n, 32)) * rng.uniform(0.2, 1.6, size=(n, 1))
        unit = v / np.linalg.norm(v, axis=1)[:, None]
        links = np.triu(unit @ unit.T >= 0.95, 1).sum()
        got = neighbours.near_vectors(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).agg(F.sum("n_links")).first()[0]
        assert 2 * links >= got >= 0.9 * 2 * links > 0


# 2
def test_token_counts_match_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    random.seed(2)
    texts = [None, "", "a<|endoftext|> b", "don't  stop\n\n\nnow ", "é́ ﬁ \u3000日本", *("".join(chr(random.choice([random.randrange(32, 127), random.randrange(0x20, 0x2FF), 32, 10])) for _ in range(60)) for _ in range(200))]
    got = {r.doc_id: r for r in tokens.count_tokens(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]), path=public_tokenizers.path("byte_bpe_50k.json")).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 1024)


# 3
def brute_components(sets, percent):
    low = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


def shingles(text, words):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard_matches_brute_force(spark, words, percent):
    random.seed(words)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[random.choice(vocabulary) for _ in range(random.randrange(1, 90))] for _ in range(25)]
    texts = ["", "One", "one two", "ONE  two", "two one"]
    for _ in range(220):
        w = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 1, 2, 4, 9])):
            w[random.randrange(len(w))] = random.choice(vocabulary)
        texts.append(" ".join(w))
    got = {r.doc_id: r for r in jaccard.near_documents(docs(spark, [(i, t, None, None) for i, t in enumerate([None, *texts])]), words=words, percent=percent, long_list=5, list_block=7).collect()}
    sets = {i: shingles(t, words) for i, t in enumerate([None, *texts])}
    want = brute_components(sets, percent)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


def test_jaccard_keeps_links_whose_shared_shingles_are_mostly_in_long_lists(spark):
    passage = [f"p{i}" for i in range(42)]
    texts = [[*passage, f"a{i}", f"b{i}"] for i in range(22)] + [[*passage[3:], f"c{i}", f"d{i}"] for i in range(4)]
    random.seed(31)
    other = [f"q{i}" for i in range(60)]
    texts += [[*other[random.randrange(5) :], *(f"{k}o{i}" for k in range(random.randrange(4)))] for i in range(60)]
    rows = [(i, " ".join(t), None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in jaccard.near_documents(docs(spark, rows), words=3, percent=90).collect()}
    want = brute_components({i: shingles(t, 3) for i, t, _, _ in rows}, 90)
    assert [want[i] for i in range(26)] == [0] * 22 + [22] * 4
    assert got == want


def test_jaccard_finds_links_between_blocks_of_one_list(spark):
    """Chains whose neighbours link and whose ends do not, all in a few long lists."""
    random.seed(33)
    texts = []
    for c in range(3):
        common, own = [f"c{c}_{i}" for i in range(60)], [f"o{c}_{i}" for i in range(40)]
        for i in range(30):
            texts.append([*common[: 56 + i % 4], *own[i : i + 4]])
    texts += [[*(f"c0_{i}" for i in range(60)), *(f"z{k}_{i}" for i in range(k % 9))] for k in range(25)]
    random.shuffle(texts)
    rows = [(i, " ".join(t), None, None) for i, t in enumerate(texts)]
    want = brute_components({i: shingles(t, 1) for i, t, _, _ in rows}, 90)
    for long_list, list_block in ((3, 4), (24, 7)):
        got = {r.doc_id: r.component_id for r in jaccard.near_documents(docs(spark, rows), words=1, percent=90, long_list=long_list, list_block=list_block).collect()}
        assert got == want
    assert 3 <= len(set(want.values())) < len(texts)


def test_rare_words_in_lengthened_prefixes(spark):
    subsets = [*itertools.combinations(range(9), 5)]
    rows = [(i, " ".join([*(f"rare{k}" for k in s), *(f"common{k}" for k in range(35))]), None, None) for i, s in enumerate(subsets[:26])]
    got = {r.doc_id: r.component_id for r in jaccard.near_documents(docs(spark, rows), words=1, percent=90).collect()}
    assert got == brute_components({i: shingles(t, 1) for i, t, _, _ in rows}, 90) == dict.fromkeys(range(26), 0)


def peak_mb(run):
    tracemalloc.start()
    out = [*run]
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, peak


def test_jaccard_counters_are_held_once_in_a_worker():
    random.seed(35)
    texts = [" ".join(random.choice("abcd") for _ in range(200)) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    list(shingle_sets(batch.column(1), 3))  # powers are kept
    parts, peak = peak_mb(jaccard._count(3, 24)(iter([batch.select(["text"])])))
    assert peak < 1.3 * (4 << 24) / 1e6
    counts = np.zeros(1 << 24, np.uint32)
    for piece, packed in zip(*(parts[0].column(i).to_pylist() for i in (0, 1)), strict=True):
        counts[piece * jaccard.PIECE : (piece + 1) * jaccard.PIECE] = np.frombuffer(zlib.decompress(packed), np.uint32)
    want = Counter(int(x) >> 40 for one in shingle_sets(batch.column(1), 3) for x in one)
    assert {int(i): int(counts[i]) for i in np.flatnonzero(counts)} == want

    class Sent:
        value = np.minimum(np.log2(counts + 1.0) * jaccard.STEPS, 65535).astype(np.uint16).tobytes()

    rows, peak = peak_mb(jaccard._prefixes(Sent, 3, 90, 24)(iter([batch.slice(0, 100)])))
    assert peak < (4 << 24) / 1e6
    assert rows[0].column(1).to_pylist() == [len(s) for s in (shingles(t, 3) for t in texts[:100])]


def test_texts_reach_the_workers_of_jaccard_in_small_batches(spark, monkeypatch):
    table = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("x"), F.lit(2000)), F.lit(" "), "id").alias("text")).coalesce(1)
    seen, real, before = [], jaccard.shingle_frequencies, spark.conf.get(BATCH_BYTES)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    def counted(texts, *a):
        seen.extend(r.n for r in texts.mapInArrow(sizes, "n long").collect())
        return real(texts, *a)

    monkeypatch.setattr(jaccard, "shingle_frequencies", counted)
    assert jaccard.near_documents(table).count() == 6000
    assert sum(seen) > 12_000_000
    assert max(seen) < 5_000_000
    assert spark.conf.get(BATCH_BYTES) == before


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, None, None), (2, text + " more", None, None), (2, text + " more", None, None), (3, "quite another text of several words", None, None), (None, text, None, None), (4, None, None, None)]
    kept = jaccard.keep_one_of_each(docs(spark, rows)).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 3, 4]


def test_unlike_texts_of_one_id_both_stay(spark):
    one, two = (" ".join(f"{k}{i}" for i in range(60)) for k in "vw")
    rows = [(1, one, None, "a"), (5, one + " more", None, "b"), (5, two, None, "c"), (7, two + " z", None, "d"), (7, two + " b", None, "e"), (8, "x " + one, None, "f")]
    rows += [(9, "alone in the world of this test", None, k) for k in "gg"] + [(-3, " ".join(f"u{i}" for i in range(40)) + k, None, k) for k in (" z", " a", " k")]
    kept = jaccard.keep_one_of_each(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.source) for r in kept) == [(-3, " a"), (1, "a"), (5, "c"), (9, "g")]


def test_components_join_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges, Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


# 4
def test_fingerprints_follow_the_next_document(spark):
    random.seed(4)
    texts = {i: "\n".join(" ".join(random.choice("abcdefghij") * random.randrange(1, 9) for _ in range(random.randrange(1, 30))) for _ in range(random.randrange(1, 12))) for i in range(0, 300, 3)}
    texts[30] = texts[27]
    got = {r.doc_id: r for r in fingerprints.version_fingerprints(docs(spark, [(i, t, None, None) for i, t in texts.items()])).collect()}
    order, digests = sorted(texts, reverse=True), {}
    for k, i in enumerate(order):
        t, after = texts[i], texts[order[(k + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
        w = lambda *x: next((w for w in fingerprints.WIDTHS if max(map(len, x)) <= w * fingerprints.PARTS), fingerprints.WIDTHS[-1])
        parts = lambda s, w: set(re.findall(rf"[^\n]{{1,{w}}}", s))
        for other, near in ((edited, got[i].near_edited), (after, got[i].near_next)):
            a, b = parts(t, w(t, other)), parts(other, w(t, other))
            assert near == pytest.approx(len(a & b) / len(a | b))
            if other is edited:  # what peeling recovers is what one version alone has
                assert len(got[i].edited_digests) == len(set(got[i].edited_digests)) == len(a ^ b)
                digests.setdefault(i, (a ^ b, got[i].edited_digests))
    assert got[30].fingerprint == got[27].fingerprint and got[30].near_next == 1.0
    assert len({r.fingerprint for r in got.values()}) == len(set(texts.values()))
    listed = spark.createDataFrame([(i, sorted(own)) for i, (own, _) in digests.items()], "i long, p array<string>")
    for r in listed.select("i", F.array_sort(F.transform("p", lambda p: fingerprints._checked(F.xxhash64(p)))).alias("d")).collect():
        assert r.d == digests[r.i][1]


def test_ids_that_many_rows_share(spark):
    rows = [(None, f"n{i}", None, None) for i in range(90)] + [(7, f"s{i}", None, None) for i in range(90)] + [(i, f"t{i}", None, None) for i in range(20)] + [(3, "t3", None, None)] * 2
    found = fingerprints.with_next(docs(spark, rows).withColumns({"tie": F.lit(1), "bucket": F.lit("b"), "place": F.lit(2)}), buckets=12)
    got = found.withColumn("k", F.xxhash64("text")).collect()
    order = sorted(got, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.k))
    assert len(got) == len(rows)
    assert sorted(r.next_text for r in got) == sorted(t for _, t, _, _ in rows)
    step = {(r.doc_id, r.text): {n.next_text for n in got if (n.doc_id, n.text) == (r.doc_id, r.text)} for r in got}
    for r, after in zip(order, order[1:] + order[:1], strict=True):
        assert after.text in step[r.doc_id, r.text]


def test_a_text_of_many_lines(spark):
    rows = [(i, "\n".join(f"line {k} {i if k % 9 == 0 else ''}" for k in range(5000)), None, None) for i in range(2)]
    a, b = ({f"line {k} {i if k % 9 == 0 else ''}" for k in range(5000)} for i in range(2))
    got = fingerprints.version_fingerprints(docs(spark, rows)).collect()
    assert [r.near_next for r in got] == [pytest.approx(len(a & b) / len(a | b))] * 2


# 5
def test_languages_of_held_out_texts_and_spans(spark):
    words = {"en": "the and with from that this there house water".split(), "fr": "que les des avec pour être maison eau où".split(), "ru": "это дом вода есть нет когда".split()}
    random.seed(5)
    say = lambda lang, n: " ".join(random.choice(words[lang]) for _ in range(n))
    rows = [(i, say(lang, 60), lang, None) for i, lang in enumerate(["en", "fr", "ru"] * 40)]
    rows += [(500, "12 34 !?", "en", None), (501, None, "en", None), (502, "дом вода", None, None)]
    got = {r.doc_id: r for r in langid.predict_languages(docs(spark, rows)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows[:120])
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[500].score == 0
    assert got[502].lang_pred == "ru"
    import zlib

    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    model = langid.fit([(lang, t) for _, t, lang, _ in rows[:120]])
    text = say("en", 30) + ". " + say("fr", 30)
    spans = langid.Labeller(model, langid.SWITCH).spans(text)
    assert [s[2] for s in spans] == ["en", "fr"] and abs(spans[0][1] - text.index(".")) < 12


def test_viterbi_shortcut_is_exact():
    rng = np.random.default_rng(5)
    model = {"langs": ["a", "b", "c"], "keys": [], "table": np.zeros((0, 3), np.float32), "floor": np.zeros(3, np.float32), "scripts": {}}
    for _ in range(60):
        own = langid.Labeller(model, 3.0)
        n = int(rng.integers(1, 7))
        own.scores[:n] = rng.normal(scale=2, size=(n, 3))
        own.update({str(i): i for i in range(n)})
        value = lambda p: sum(own.scores[i, x] for i, x in enumerate(p)) - 3.0 * sum(x != y for x, y in zip(p, p[1:], strict=False))  # noqa: E731, B023
        best = max(map(value, itertools.product(range(3), repeat=n)))
        assert value(own.path([str(i) for i in range(n)]).tolist()) == pytest.approx(best)


def test_texts_of_languages_that_were_not_learned_go(spark):
    words = {"en": "the and with from that this there house water".split(), "fr": "que les des avec pour être maison eau où".split()}
    random.seed(51)
    say = lambda lang, n: " ".join(random.choice(words[lang]) for _ in range(n))
    rows = [(i, say(lang, 60), lang, None) for i, lang in enumerate(["en", "fr"] * 30)] + [(100, say("fr", 5), None, None)]
    gone = ["это дом вода есть нет когда", "这是一本书", "wszyscy ludzie rodzą się wolni", say("en", 3) + " но это дом вода есть нет когда"]
    kept = {r.doc_id: r.lang for r in langid.keep_known_languages(docs(spark, rows + [(200 + i, t, None, None) for i, t in enumerate(gone)])).collect()}
    assert kept == {i: lang for i, _, lang, _ in rows} | {100: "fr"}


# 6
def test_pieces_match_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    random.seed(6)
    texts = [None, "", " ", "  two  spaces ", "a▁b ▁", "<s> </s>", "line\n\nbreaks.\r\n", "\x00", *("".join(chr(random.choice([random.randrange(32, 127), random.randrange(0x20, 0x2FF), random.randrange(0x3000, 0xD7FF), 32, 10, 46])) for _ in range(60)) for _ in range(300))]
    got = {r.doc_id: r for r in tokens.encode_pieces(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]), path=public_tokenizers.path("piece_bpe_32k.model"), keep_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        assert (got[i].ids, got[i].decoded, got[i].n_tokens) == (ids, library.decode(ids), len(ids))
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_a_broken_agenda_is_an_error():
    coder = tokens.PieceCoder(public_tokenizers.path("piece_bpe_32k.model"))
    long = "x" * 2000 + "é" * 999
    for text in ("one two", long, "a " + long):
        ids, back = coder.code(text)
        coder.check(text, ids)
        assert back == coder.library.decode(coder.library.encode(text))
    assert all(len(w) <= tokens.LONG_WORD for w in coder)
    with pytest.raises(ValueError):
        coder.check("one two", "1,2")
    coder.scores = {piece: -score for piece, score in coder.scores.items()}
    one = coder.code("one")[0]
    coder.code("unbelievable international understanding")
    with pytest.raises(ValueError):
        coder.check("one", one)


def test_words_end_between_letters_and_other_characters():
    """So that a word is encoded once, whatever stands behind it."""
    coder = tokens.PieceCoder(public_tokenizers.path("piece_bpe_32k.model"))
    assert coder.split("in  the.\nm² (the!) 9a") == ["▁in", "▁▁the", ".", "\n", "m", "²", "▁(", "the", "!)", "▁9", "a"]
    random.seed(61)
    for _ in range(2000):
        text = "".join(random.choice(["the", "ing", "é", "m", "²", "½", ".", ",", "'", "-", "9", " ", "  ", "▁", "\n", "中", "́", "ß", "_", "(", "\t"]) for _ in range(random.randrange(1, 30)))
        ids, back = coder.code(text)
        coder.check(text, ids)
        assert "".join(coder.split(text)) == tokens.SPACE + text.replace(" ", tokens.SPACE)
        assert back == coder.library.decode(coder.library.encode(text))


def test_a_piece_of_letters_and_others_keeps_words_whole():
    plain, joined = (re.compile(tokens.word_pattern({("a", "b"), *more})).findall for more in ((), {("b", "."), (".", "c"), ("a", ".")}))
    assert plain("▁ab.c\n") == ["▁ab", ".", "c", "\n"]
    assert joined("▁ab.c\n▁a") == ["▁ab.c", "\n", "▁a"]


# 7
def brute_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [(m.start(), 0, "assign", m.end())] if len(m[2]) >= 8 else []
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secret_spans_match_brute_force(spark):
    random.seed(7)
    bits = ["token", "Secret", "API_KEY", "apikey", " = ", ":", '"', "'", "=", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "deadbeef", " ", "é", "\U0001f600", "x" * 9, "\n", "passwd"]
    texts = [None, "", "token = secret = abcdefghij", 'token="' + "a" * 40 + '"', *("".join(random.choice(bits) for _ in range(25)) for _ in range(400))]
    got = {r.doc_id: r for r in secrets.secret_digests(docs(spark, [(i, t, None, f"s{i}") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        spans = brute_spans(t or "")
        written = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
        assert got[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest(), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert set(written.split(",")) <= set(got[i].spans.split(",")) | {""}


def test_copied_values_stay_and_live_ones_go(spark):
    rows = [(i, f"say password = example{'0' * 8} here", None, f"s{i}") for i in range(6)]
    rows += [(10, "é token: 'liveliveLIVE' and password=example00000000!", None, "s1"), (11, "no secret here", None, None), (12, None, None, None)]
    clean = {r.doc_id: r.text for r in secrets.redact_secrets(docs(spark, rows)).collect()}
    assert clean[0] == rows[0][1]
    assert clean[10] == "é token: '[SECRET]' and password=example00000000!"
    assert clean[11] == rows[-2][1] and clean[12] is None
    found = {r.doc_id: (r.n_live, r.n_copied) for r in secrets.scan_secrets(docs(spark, rows)).collect()}
    assert found[0] == (0, 1) and found[10] == (1, 1) and found[11] == (0, 0)


def test_repositories_and_owners_both_decide(spark):
    say = lambda v: f"token = {v}"
    rows = [(i, say("oneowner1"), None, "s0") for i in range(30)]  # one owner, many repositories
    rows += [(100 + i, say("twoowner2"), None, f"s{i % 2}") for i in range(30)]  # few owners, many repositories
    rows += [(200 + i, say("twofew003"), None, f"s{i % 2}") for i in range(4)]
    rows += [(300 + i, say("manyown04"), None, f"s{i}") for i in range(5)]
    rows += [(400 + i, say("noowner05"), None, None) for i in range(30)]
    got = {r.doc_id: r.spans[0] for r in secrets.scan_secrets(docs(spark, rows), copied_repos=25).collect()}
    assert {k: (got[k].repos, got[k].owners, got[k].live) for k in (0, 100, 200, 300, 400)} == {0: (30, 1, True), 100: (30, 2, False), 200: (4, 2, True), 300: (5, 5, False), 400: (30, 0, True)}
    written = {r.doc_id: (r.spans, r.ownership) for r in secrets.secret_digests(docs(spark, rows)).collect()}
    assert written[200] == ("assign:0:17", "4:2")
    clean = {r.doc_id: r.text for r in secrets.redact_secrets(docs(spark, rows), copied_repos=25).collect()}
    assert len(clean) == len(rows) and clean[0] == say("[SECRET]") and clean[100] == say("twoowner2") and clean[300] == say("manyown04")


# 8
def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, weights = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / weights > 3 * sizes[s] + 1e-9]
        if not over:
            return {s: fixed[s] if s in fixed else left * weight[s] / weights for s in names}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mix_meets_its_targets(spark):
    random.seed(8)
    rows = [(i, " ".join("w" * random.randrange(1, 5) for _ in range(random.choice([0, 3, 40, 700]))), None, random.choice(["a"] * 30 + ["b", "c", "d", "é", None])) for i in range(400)]
    rows += [(i, "tiny", None, "t") for i in range(1000, 1003)]
    table = docs(spark, rows)
    got = mixing.mix_sources(table, block_words=16).collect()
    again = mixing.mix_sources(table.repartition(7), block_words=16).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    size = {i: len(WORD.findall(t)) for i, t, _, _ in rows}
    by = {}
    for i, _, _, s in rows:
        by[s] = by.get(s, 0) + size[i]
    want = brute_targets(by)
    taken = dict.fromkeys(by, 0)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == by[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in by:
        assert abs(taken[s] - want[s]) <= max(1, mixing.DRIFT * want[s] + 16)
    slots = mixing.mixed_blocks(table, block_words=16).collect()
    assert sum(len(WORD.findall(r.text)) for r in slots) == sum(taken.values())
    # the same words, document by document
    cut = mixing.mixed_documents(table, block_words=16).collect()
    words = dict.fromkeys(size, 0)
    for r in cut:
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text) and (r.n_chars == 0 or r.text in {i: t for i, t, _, _ in rows}[r.doc_id])
    assert words == {r.doc_id: r.taken for r in got}
    assert {r.doc_id for r in cut if not WORD.findall(r.text)} == {i for i, n in size.items() if n == 0}


def test_shards_draw_their_sources(spark):
    rows = [(i, "w " * 64, None, s) for i, s in enumerate("a" * 300 + "b" * 200 + "c" * 400)]
    table = docs(spark, rows)
    scratch = Scratch(spark)

    def drawn(seed, shard_blocks):
        plan = mixing.source_plan(scratch.keep(mixing._placed(table, "doc_id", "text", "source", seed)), 8, scratch)
        counts, shards = mixing.shard_draws(plan, shard_blocks, seed, scratch)
        runs = mixing.slot_runs(plan, shard_blocks, seed, scratch).collect()
        return plan.collect(), {(r.shard, r.src): r.drawn for r in counts.collect()}, shards, runs

    plan, counts, shards, runs = drawn(1, 100)
    assert shards == -(-sum(p.slots for p in plan) // 100)
    sums = [sum(n for (s, _), n in counts.items() if s == k) for k in range(shards)]
    assert sums[:-1] == [100] * (shards - 1)
    # a multinomial draw: every shard's share of a source lies about the target, and they differ
    for p in plan:
        each = np.array([counts.get((k, p.src), 0) for k in range(shards - 1)])
        share = p.slots / sum(q.slots for q in plan)
        assert abs(each.mean() / 100 - share) < 0.03 and 0.5 < each.var() / (100 * share * (1 - share)) < 2
    # every slot once, as many as were drawn, held within the drift
    for p in plan:
        got = sum(n for (_, s), n in counts.items() if s == p.src)
        spare = int(p.slots * mixing.DRIFT)
        end = min(max(got, p.slots - spare), p.slots + spare, 3 * p.blocks)
        listed = sorted(x for r in runs if r.src == p.src for x in range(r.first, r.first + r.n))
        assert listed == list(range(end))
    size = {}
    for r in runs:
        size[r.shard] = size.get(r.shard, 0) + r.n
    assert max(size.values()) <= 100
    assert drawn(1, 100)[1] == counts and drawn(2, 100)[1] != counts
    taken = lambda seed: sorted((r.doc_id, r.taken) for r in mixing.mix_sources(table, block_words=8, shard_blocks=100, seed=seed).collect())
    assert taken(1) == taken(1) != taken(2)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation_is_a_bijection(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5), 3).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))


# 9
def test_chats_read_back(spark):
    nasty = ["", None, "\\", "\\b", "</turn>", "### user: ", "\\e</turn>\n### assistant: x", "a\n", ": ", "</turn", "#"]
    rows = [(i // 5, i % 5, random.choice(["user", "assistant", "system", None, "odd: role"]), nasty[i % len(nasty)]) for i in range(55)]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (3, 1, "user", "tie")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(chat.chain(table))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted([(t, r or "", x or "") for k, t, r, x in rows if k == c])
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in own]
        masked = [got[c].formatted[s.start : s.end] for s in got[c].loss]
        undo = lambda s: s.replace("\\h", chat.HEAD).replace("\\e", chat.END).replace("\\b", "\\")
        assert [undo(m) for m in masked] == [x for _, r, x in own if r == "assistant"]
        assert got[c].masked == [x for _, r, x in own if r == "assistant"]
    assert chat.chat_digests(chat.chain(table.limit(0))).count() == 0
    clash = table.withColumns({"msg": F.lit("m"), "root": F.lit(1), "start": F.lit("s"), "turns": F.lit(2), "formatted": F.lit("f")})
    assert sorted(chat.chat_digests(chat.chain(clash)).collect(), key=str) == sorted(chat.chat_digests(chat.chain(table)).collect(), key=str)


def test_the_loss_digest_is_what_the_mask_covers(spark):
    long = "".join(chr(97 + i % 26) for i in range(9000)) + "\U0001f600é"
    rows = [(1, i, ("user", "assistant")[i % 2], f"{i}</turn>" + long * (i % 3)) for i in range(40)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(chat.chain(table))
    said = "".join(t for _, _, r, t in rows if r == "assistant")
    got = chat.digests(chat.read_chats(chats)).first()
    assert (got.loss_chars, got.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    one_less = chats.withColumn("loss", F.slice("loss", 2, 100))
    moved = chats.withColumn("loss", F.transform("loss", lambda s: F.struct((s["start"] + 1).alias("start"), s["end"].alias("end"))))
    for broken in (one_less, moved):
        assert chat.digests(chat.read_chats(broken)).first().loss_sha256 != got.loss_sha256


def test_long_threads_and_many_branches(spark):
    rows = [(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(300)] + [(2, i, 0 if i else None, "user", str(i), float(i == 77)) for i in range(200)]
    table = spark.createDataFrame(rows, "conv_id long, msg long, parent long, role string, text string, score double")
    got = {r.conv_id: [t.text for t in r.turns] for r in chat.read_chats(chat.format_chats(table)).collect()}
    assert got == {1: [str(i) for i in range(300)], 2: ["0", "77"]}


def test_branches_are_ranked(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "thanks", 0.0), (1, 5, 2, "user", "hm", 0.0), (1, 9, 99, "user", "orphan", 0.0)]
    table = spark.createDataFrame(rows, "conv_id long, msg long, parent long, role string, text string, score double")
    got = chat.read_chats(chat.format_chats(table, paths_per_tree=2)).collect()
    assert {(r.root, r.rank): [t.text for t in r.turns] for r in got} == {(1, 1): ["q", "good", "thanks"], (1, 2): ["q", "bad", "hm"], (9, 1): ["orphan"]}


# 10
PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="ad">Buy now</div><article><h1>Head &amp; more</h1><p>First   <b>bold</b>
text.</p><p>Second<br>line &#233;<p>Third</article><div class='comments'><p>Nice post</p></div><form><p>Mail</p></form><footer>&copy; me</footer></body></html>"""


def test_main_text_of_pages(spark):
    rows = [(i, f"http://x/{i}", PAGE.replace("First", f"First {i}")) for i in range(40)] + [(100, "u", None), (101, None, ""), (102, "v", "<p>open <b>text"), (102, "v", "<p>open <b>text"), (103, "w", "<div" * 50)]
    got = {r.page_id: r for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].text == f"Head & more\nFirst {i} bold text.\nSecond line é\nThird" for i in range(40))
    assert got[100].text == got[101].text == "" and got[102].text == "open text"
    assert got[0].n_chars == len(got[0].text)


def test_no_text_is_lost_to_elements_that_nothing_closes(spark):
    texts = lambda page: [text for _, text, _ in html.blocks_of(page)]
    assert texts("<html><head><title>t</title><body><article><p>One</article>") == ["One"]
    assert texts("<html><head><title>t</title><style>p{}</style><p>One<p>Two") == ["One", "Two"]
    assert texts("<head>of the page<noscript>no</noscript></head><p>One") == ["One"]
    for tag in "button select object svg math canvas audio video noscript iframe template".split():
        assert texts(f"<article><p>One</p><div><{tag} class=x></div><p>Two</p></article><p>Three</p>") == ["One", "Two", "Three"]
        assert texts(f"<p>One <{tag}>and<p>Two</p>") == ["One and", "Two"]
    for tag in "object svg math canvas audio video noscript iframe".split():
        assert texts(f"<p>One <{tag}>and</{tag}> two</p>") == ["One and two"]
    for tag in ("button", "select", "template"):
        assert texts(f"<p>One <{tag}><div>and</div> more</{tag}>two</p><p>Three") == ["One two", "Three"]
    assert texts("<template>a<template>b</template>c</template><p>One") == ["One"]
    assert texts("<p>One<button>a<p>Two<button>b</button><p>Three</p></button>") == ["Onea", "Two", "Three"]
    assert texts("<title-bar>One</title-bar><p>Two<![CDATA[><p>Three") == ["One", "Two", "Three"]
    assert texts("<p>One<script>a</script >b<textarea>c<p>d") == ["Oneb"]
    pages = [PAGE.replace("First", f"First {i}") for i in range(40)]
    pages += [PAGE.replace("</head>", ""), PAGE.replace("text.", "<math>x = 2</math>."), PAGE.replace("text.", "<object>text.")]
    rows = [(i, f"http://x/{i}", page) for i, page in enumerate(pages)]
    got = {r.page_id: r.text for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[40] == got[42] == "Head & more\nFirst bold text.\nSecond line é\nThird"
    assert got[41] == "Head & more\nFirst bold x = 2.\nSecond line é\nThird"


def test_gradients_of_the_labeller():
    rng = np.random.default_rng(0)
    w = html.init_weights(1)
    d = w["fx"].shape[0]
    pages = [(rng.normal(size=(n, d)), rng.integers(0, 2, n).astype(float)) for n in (3, 5)]
    x, mask = html._padded([p[0] for p in pages])
    want = np.zeros(mask.shape)
    for j, (_, y) in enumerate(pages):
        want[: len(y), j] = y

    def loss():
        p, _ = html.forward(w, x, mask)
        return -(mask * (want * np.log(p) + (1 - want) * np.log(1 - p))).sum() / mask.sum()

    p, (joined, kept_f, kept_b) = html.forward(w, x, mask, keep=True)
    dz = (p - want) * mask / mask.sum()
    dj = dz[..., None] * w["o"][:, 0]
    h = html.HIDDEN
    grads = dict(zip(("fx", "fh", "f0"), html._run_back(dj[..., :h], x, kept_f, w["fh"]), strict=True)) | dict(zip(("bx", "bh", "b0"), html._run_back(dj[::-1, :, h : 2 * h], x[::-1], kept_b, w["bh"]), strict=True))
    for k, g in grads.items():
        for at in rng.integers(0, w[k].size, 4):
            old, eps = w[k].flat[at], 1e-5
            w[k].flat[at] = old + eps
            up = loss()
            w[k].flat[at] = old - eps
            down = loss()
            w[k].flat[at] = old
            assert g.flat[at] == pytest.approx((up - down) / (2 * eps), rel=1e-3, abs=1e-8)


def test_labeller_agrees_with_rules_on_unseen_layouts():
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(200)]
    own = html.Extractor(html.fit_labeller([html.layout(rng, words) for _ in range(60)]))
    right = total = 0
    for _ in range(150):
        blocks = html.blocks_of(html.layout(rng, words))
        if blocks:
            p, _ = html.forward(own.weights, *html._padded([html.features(blocks)]))
            right += ((p[:, 0] >= 0.5) == np.array([html.taught(*block) for block in blocks])).sum()
            total += len(blocks)
    assert right / total > 0.97


def test_windows_of_a_long_page_give_what_the_whole_gives():
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(50)]
    blocks = [b for _ in range(12) for b in html.blocks_of(html.layout(rng, words))]
    w = html.init_weights(2)
    p, (_, kept, _) = html.forward(w, *html._padded([html.features(blocks)]))
    assert kept == []
    for at_once in (1, 7, len(blocks), 1000):
        assert html.forward_long(w, blocks, at_once) == pytest.approx(p[:, 0])


def test_main_text_of_hand_labelled_pages(spark):
    from hand_labelled import PAGES, filler

    rows = [(i, "u", page, "a", 1, 2) for i, (page, _) in enumerate(PAGES)]
    words = filler()
    rng = np.random.default_rng(9)
    rows += [(1000 + i, "u", html.layout(rng, words), "a", 1, 2) for i in range(100)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, h int")
    got = {r.page_id: r for r in html.extract_main_text(table).collect()}
    wrong = {i: (got[i].text, want) for i, (_, want) in enumerate(PAGES) if got[i].text != want}
    assert len(PAGES) >= 30 and not wrong
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html.extract_main_text(table.limit(0)).columns == ["page_id", "url", "text", "n_chars"]
    assert html.extract_main_text(table.limit(0)).count() == 0


def test_main_text_inside_misleading_wrappers(spark):
    from hand_labelled import PAGES as plain
    from wrapped_pages import PAGES

    sample = [r.html or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").limit(html.FIT_PAGES).collect()]
    own = html.Extractor(html.fit_labeller(sample))
    for pages in (PAGES, plain):
        got = own.texts([page for page, _ in pages])
        assert [(p[0], g) for p, g in zip(pages, got, strict=True) if p[1] != g] == []
    assert len(PAGES) == 60


def test_wrappers_stay_furniture_without_the_article():
    kept = lambda page: [text for path, text, linked in html.blocks_of(page) if html.taught(path, text, linked)]
    story = "<article><h1>Title of it</h1><p>One sentence of the article that is long.</p></article>"
    long = "A remark that goes on and on and is far longer than the article itself. " * 9
    assert kept(f"<body>{story}<section class='comments'><article><p>{long}</p></article></section></body>") == ["Title of it", "One sentence of the article that is long."]
    assert kept(f"<body>{story}<div class='sidebar'><div class='content'><p>Widget.</p></div></div></body>") == ["Title of it", "One sentence of the article that is long."]


def test_a_very_long_page():
    from hand_labelled import PAGES

    own = html.Extractor(html.fit_labeller([page for page, _ in PAGES] * 4))
    n = html.BLOCKS_AT_ONCE + 500
    page = "<nav><a href=x>Home</a></nav><article>" + "".join(f"<p>paragraph {i} of the text.</p>" for i in range(n)) + "</article><footer>me</footer>"
    assert own.texts([page, ""]) == ["\n".join(f"paragraph {i} of the text." for i in range(n)), ""]
