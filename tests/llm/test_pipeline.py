"""The pipeline's stages, in order, each on what the one before it kept, held
against plain Python on documents with repeated and missing ids."""

import hashlib
import random
import re

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm import brute_components, brute_spans, brute_targets, shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the and with from that this there house water people morning river".split(), "fr": "que les des avec pour être maison eau où matin rivière gens".split()}


def corpus():
    random.seed(12)
    say = lambda lang, n: " ".join(random.choice(WORDS[lang]) + str(random.randrange(900)) * (random.random() < 0.4) for _ in range(n))
    rows = []
    for i in range(90):
        lang = random.choice(["en", "fr"])
        rows.append((i, say(lang, random.choice([20, 60, 200])), lang, random.choice(["a", "a", "b", None])))
    for i in range(40):  # near and exact copies, some under an id that another text has
        _, text, lang, source = random.choice(rows[:60])
        rows.append((random.choice([200 + i, 300, 5]), text + random.choice(["", "", " end", " the end of it"]), lang, source))
    rows += [(None, say("en", 50), "en", "a"), (None, say("en", 50), "en", "b"), (None, "12", None, None)]
    rows += [(500 + i, f"{say('en', 20)}\n\tpassword = hunter2hunter2{i % 2} é and token: {'live' * 4}{i}", "en", f"s{i}") for i in range(12)]
    rows += [(600, None, "en", "a"), (601, "", "en", "a"), (602, "12 34", "en", "a"), (603, "это дом вода", None, "a"), (604, say("fr", 30), None, "b")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage is given: the documents, then each stage's written output."""
    root, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.createDataFrame(corpus(), SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs
        stage(spark, docs, "").write.parquet(f"file://{root}/{name}")
        docs = spark.read.parquet(f"file://{root}/{name}")
    out["end"] = docs
    return out


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_stages_are_in_order(kept):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["languages", "near_copies", "secrets", "mixing", "encoding"]
    for name in ("near_copies", "secrets", "mixing", "encoding"):
        assert kept[name].columns == COLUMNS


def test_languages_rejects_only_what_nobody_speaks(kept):
    gone = {600, 601, 602, 603}
    want = [(i, t, lang or "fr", s, n) for i, t, lang, s, n in corpus() if i not in gone and t != "12"]
    assert rows(kept["near_copies"]) == sorted(want, key=repr)


def test_near_copies_keeps_one_of_each_group(kept):
    given = rows(kept["near_copies"])
    nodes = sorted({(i, t) for i, t, *_ in given if i is not None})
    low = brute_components({k: shingles(t, 5) for k, (_, t) in enumerate(nodes)}, 80)
    groups = {}
    for k, node in enumerate(nodes):
        groups.setdefault(low[k], []).append(node)
    want = sorted([min(g) for g in groups.values()] + [(None, t) for i, t, *_ in given if i is None], key=repr)
    assert sorted([(i, t) for i, t, *_ in rows(kept["secrets"])], key=repr) == want
    assert len({i for i, _ in nodes}) < len(nodes)  # an id has several texts
    assert set(rows(kept["secrets"])) <= set(given)


def test_secrets_replaces_live_values_only(kept):
    given = rows(kept["secrets"])
    owners = {}
    value = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""", re.I | re.A)
    for i, t, _, s, _ in given:
        for m in value.finditer(t):
            owners.setdefault(m[1], set()).add(s)
    copied = {v for v, who in owners.items() if len(who) >= 5}
    assert copied and len(copied) < len(owners)
    want = [(i, value.sub(lambda m: m[0] if m[1] in copied else m[0][: m.start(1) - m.start()] + "[SECRET]", t), lang, s, n) for i, t, lang, s, n in given]
    assert rows(kept["mixing"]) == sorted(want, key=repr)
    assert any(brute_spans(t) for _, t, *_ in given)


def test_mixing_takes_blocks_of_each_source(kept):
    given, out = rows(kept["mixing"]), rows(kept["encoding"])
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    size, taken, texts = {}, {}, {}
    for i, t, _, s, _ in given:
        size[s] = size.get(s, 0) + words(t)
        texts.setdefault((i, s), []).append(t)
    for i, t, _, s, n in out:
        taken[s] = taken.get(s, 0) + words(t)
        assert n == len(t) and any(t in whole for whole in texts[i, s])
    for s, want in brute_targets(size).items():
        assert abs(taken.get(s, 0) - want) <= 0.005 * want + 128


def test_encoding_equals_the_library(kept):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, t, *_ in rows(kept["encoding"]):
        ids = library.encode(t)
        want.append((i, ids, hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted([(r.doc_id, r.ids, r.decoded_sha256) for r in kept["end"].collect()], key=repr) == sorted(want, key=repr)


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        assert name == "encoding" or out.columns == COLUMNS


def test_the_run_reads_documents(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert out.count() > 0 and out.where(F.col("n_tokens") == 0).count() == 0
