"""Language ID of spans: script ranges, learned word scores, Viterbi.

Every word (a run of letters) is scored by a character trigram model for each
language; the script of its letters narrows the languages that may claim it to
those whose training texts hold that script. The best path through the words,
at a penalty for every switch of language, labels the spans of a text.

The models are fitted on a bounded sample: of each language's labelled rows
the ``fit_rows`` first by a hash of id and text, their texts whole. The hashes
are first held under a bound that follows from the number of a language's rows,
so that few are ordered however many rows it has; the sample's words are counted
where they lie, and the driver gets distinct words with their counts, no texts.
What is sent to the executors is that model, bounded by the sample. Prediction
is per row in Arrow batches, without a shuffle, and reads the text alone.

Defined results: a null text, or one without letters, is ``und`` with score 0;
repeated rows are labelled each; an empty table gives no rows; where nothing
is labelled every text is ``und``. Ties go to the first language by code point.
Texts of any length are read whole; a very long one takes memory in proportion
to its words. Columns of the input whose names clash are replaced.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.workers import resident

UNKNOWN = "und"
FIT_ROWS = 600
SWITCH = 14.0
CACHE_WORDS = 300_000
ROWS_AT_ONCE = 256
#: A language holds a script if so large a share of its training letters is written in it.
SCRIPT_SHARE = 0.01
#: A word is known to a language if it scores as well a letter as all but so many of its distinct training words.
KNOWN_QUANTILE = 0.02
#: Script by first code point, up to the next entry.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "other"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2E80, "han"), (0x3040, "kana"),
    (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA4D0, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"),
)
_FIRST = [first for first, _ in SCRIPTS]


def script_of(word: str) -> str:
    """The script of most of the letters, the first met on ties."""
    if word.isascii():
        return "latin"
    return Counter(SCRIPTS[bisect.bisect_right(_FIRST, ord(c)) - 1][1] for c in word).most_common(1)[0][0]


def _words():
    import regex

    return regex.compile(r"\p{L}[\p{L}\p{M}]*")


def _trigrams(word: str) -> list[str]:
    padded = f"  {word.lower()} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def fit(texts: list[tuple[str, str]], *, known: bool = False) -> dict:
    """The model of (lang, text) rows."""
    find = _words().findall
    words: dict[str, Counter] = {lang: Counter() for lang, _ in texts}
    for lang, text in texts:
        words[lang].update(find(text))
    return fit_words(words, known=known)


def fit_words(words: dict[str, Counter], *, known: bool = False) -> dict:
    """lang -> counts of words -> log-probability of each trigram given its two
    first letters, per language, smoothed by the bigram and letter counts;
    with ``known`` also the least score of a known word of each language."""
    langs = sorted(words)
    scripts, grams = defaultdict(Counter), [Counter() for _ in langs]
    for i, lang in enumerate(langs):
        for word, n in words[lang].items():
            scripts[lang][script_of(word)] += n * len(word)
            for g in _trigrams(word):
                grams[i][g] += n
    keys = sorted(set().union(*grams)) if grams else []
    letters = len({c for g in keys for c in g}) + 1
    table, floor = np.empty((len(keys), len(langs)), np.float32), np.empty(len(langs), np.float32)
    for i, counts in enumerate(grams):
        last, middle, pair = Counter(), Counter(), Counter()
        for g, n in counts.items():
            last[g[2]] += n
            middle[g[1:]] += n
            pair[g[:2]] += n
        begun = Counter()
        for g, n in middle.items():
            begun[g[0]] += n
        total = sum(last.values())
        for k, g in enumerate(keys):
            one = (last[g[2]] + 0.5) / (total + 0.5 * letters)
            two = (middle[g[1:]] + 2 * one) / (begun[g[1]] + 2)
            table[k, i] = math.log((counts[g] + 2 * two) / (pair[g[:2]] + 2))
        floor[i] = math.log(0.5 / (total + 0.5 * letters))
    held = {s: [scripts[lang][s] >= SCRIPT_SHARE * sum(scripts[lang].values()) and scripts[lang][s] > 0 for lang in langs] for s in {s for c in scripts.values() for s in c}}
    model = {"langs": langs, "keys": keys, "table": table, "floor": floor, "scripts": held}
    if known:
        own = Labeller(model, SWITCH)
        model["least"] = np.full(len(langs), np.inf)
        for i, lang in enumerate(langs):
            if words[lang]:
                own.learn([sorted(words[lang])])
                model["least"][i] = np.quantile(own.per_letter([own[w] for w in words[lang]])[:, i], KNOWN_QUANTILE)
    return model


def _packed(codes: np.ndarray) -> np.ndarray:
    """Each three neighbouring code points as one number."""
    codes = codes.astype(np.uint64)
    return (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Labeller(dict):
    """word -> row of the score table. New words are scored together."""

    def __init__(self, model: dict, switch: float):
        self.langs, self.switch = model["langs"], switch
        keys = np.array([_packed(_codes(k))[0] for k in model["keys"]], np.uint64)
        order = np.argsort(keys)
        self.keys, self.table = keys[order], model["table"][order].astype(np.float64)
        self.floor = model["floor"].astype(np.float64)
        self.scripts, self.least = model["scripts"], model.get("least")
        self.pattern = _words()
        self.scores = np.zeros((1024, len(self.langs)))
        self.letters = np.zeros(1024, np.int64)

    def renew(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()

    def learn(self, texts: list[list[str]]) -> None:
        """Score the words of ``texts`` that are not known yet."""
        new = [*dict.fromkeys(w for words in texts for w in words if w not in self)]
        if not new or not self.langs:
            return
        padded = [f"  {w.lower()} " for w in new]
        sizes = np.fromiter(map(len, padded), np.int64, len(padded))
        starts = np.cumsum(sizes) - sizes
        grams = _packed(_codes("".join(padded)))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
            values = np.where((self.keys[at] == grams)[:, None], self.table[at], self.floor)
        else:
            values = np.broadcast_to(self.floor, (len(grams), len(self.langs))).copy()
        ends = starts[1:] - 1  # grams that reach into the next word
        values[ends] = 0
        values[ends - 1] = 0
        totals = np.add.reduceat(values, starts, axis=0)
        by_script: dict[str, list[int]] = {}
        for i, w in enumerate(new):
            by_script.setdefault("latin" if w.isascii() else script_of(w), []).append(i)
        for script, rows in by_script.items():
            may = self.scripts.get(script)
            if may is None:  # a script that no language was learned in tells nothing
                totals[rows] = 0
            elif not all(may):
                may = np.array(may)
                worst = totals[np.ix_(rows, np.flatnonzero(may))].min(axis=1) - 2 * self.switch
                totals[np.ix_(rows, np.flatnonzero(~may))] = np.minimum(totals[np.ix_(rows, np.flatnonzero(~may))], worst[:, None])
        first, end = len(self), len(self) + len(new)
        while end > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.scores[first:end] = totals
        self.letters[first:end] = [*map(len, new)]
        self.update(zip(new, range(first, end), strict=True))

    def __missing__(self, word: str) -> int:
        self.learn([[word]])
        return self[word]

    def path(self, words: list[str]) -> np.ndarray:
        """The best language of each word."""
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        s = self.scores[at]
        best = int(s.sum(0).argmax())
        # A path that uses the best language at all switches as often as it has
        # runs of others, and each of those gains at most the largest sum of a
        # run over the best language. A path without it switches once at least,
        # and gains at most what the others together have over the best.
        ahead = s - s[:, best : best + 1]
        gain = np.cumsum(ahead, axis=0)
        low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
        low[1:] = low[:-1].copy()
        low[0] = 0
        if (gain - low).max() <= self.switch and (s.shape[1] == 1 or np.delete(ahead, best, axis=1).max(axis=1).sum() <= self.switch):
            return np.full(len(words), best)
        back = np.empty(s.shape, np.int64)
        value, own = s[0].copy(), np.arange(s.shape[1])
        for i in range(1, len(s)):
            top = int(value.argmax())
            stay = value >= value[top] - self.switch
            back[i] = np.where(stay, own, top)
            value = np.where(stay, value, value[top] - self.switch) + s[i]
        out = np.empty(len(s), np.int64)
        out[-1] = value.argmax()
        for i in range(len(s) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, lang) of each run of words of one language, in code points."""
        hits = [*self.pattern.finditer(text)]
        if not hits or not self.langs:
            return []
        path = self.path([m.group() for m in hits])
        cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(hits)]
        return [(hits[a].start(), hits[b - 1].end(), self.langs[path[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def per_letter(self, at: list[int]) -> np.ndarray:
        return self.scores[at] / (self.letters[at] + 1)[:, None]

    def labels(self, texts: list[str]) -> list[tuple]:
        found = [self.pattern.findall(t) for t in texts]
        self.learn(found)
        return [*map(self._label, found)]

    def _label(self, words: list[str]) -> tuple:
        """(language of most letters, its share of the letters, spans), and
        with known words learned also the share of its known words."""
        if not words or not self.langs:
            return UNKNOWN, 0.0, 0, 0.0
        path = self.path(words)
        share = np.bincount(path, weights=self.letters[[self[w] for w in words]] if len(self.langs) > 1 and (path != path[0]).any() else None, minlength=len(self.langs))
        top = int(share.argmax())
        label = self.langs[top], float(share[top] / share.sum()), int((path[1:] != path[:-1]).sum()) + 1
        if self.least is None:
            return label
        at = [self[w] for w in words]
        known = (path == top) & (self.per_letter(at)[:, top] >= self.least[top])
        held = {script: may[top] for script, may in self.scripts.items()}
        known[known] = [held.get(script_of(words[i]), False) for i in np.flatnonzero(known)]
        return *label, float(self.letters[at][known].sum() / self.letters[at].sum())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each language's words in its texts, and a row without a word for the language itself."""
    find = _words().findall
    for batch in batches:
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[lang][None] = 0
            counts[lang].update(find(text))
        rows = [(lang, word, n) for lang, own in counts.items() for word, n in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])


def _under(bounds: dict[str, int]) -> Column:
    """Whether a row's hash is no more than its language's bound."""
    out = F.lit(False)
    for lang, bound in bounds.items():
        out = out | ((F.col("lang") == lang) & (F.col("h") <= F.lit(bound)))
    return out


def fitted(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, known: bool = False) -> dict:
    """The model of the rows of ``docs`` where ``train`` holds: at most
    ``fit_rows`` rows of each language, the first by a hash; equal rows count once."""
    rows = docs.where(train & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    # the first hashes lie under a bound that about four times as many pass; few are ordered, of any language
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    bounds = {r["lang"]: min((1 << 63) - 1, (4 * fit_rows + 100) * (1 << 64) // max(1, r["n"]) - (1 << 63)) for r in sizes}
    ranked = rows.where(_under(bounds)).select("lang", "h").distinct().withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rn") <= fit_rows)
    last = {r["lang"]: r["h"] for r in ranked.groupBy("lang").agg(F.max("h").alias("h")).collect()}
    sample = rows.where(_under(last)).groupBy("lang", "h").agg(F.any_value("text").alias("text")).select("lang", "text")
    words: dict[str, Counter] = {lang: Counter() for lang in last}
    for r in sample.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).orderBy("lang", "word").toLocalIterator():
        if r["word"] is not None:
            words[r["lang"]][r["word"]] = r["n"]
    return fit_words(words, known=known)


def label_languages(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH, keep_spans: bool = False) -> DataFrame:
    """``docs`` with lang_pred, score (the predicted language's share of the
    letters), n_spans, and with ``keep_spans`` also spans; where the model has
    known words also known_share (that of the predicted language's known words).
    Other columns whose names clash are replaced."""
    packed = pickle.dumps(model)
    sent = docs.sparkSession.sparkContext.broadcast(packed)
    key = f"{hashlib.sha256(packed).hexdigest()} {switch}"
    rows = docs.select("*", F.coalesce(F.col(text_col), F.lit("")).alias("label_text_"))
    with_known = "least" in model
    new = ["lang_pred", "score", "n_spans", *(["known_share"] if with_known else []), *(["spans"] if keep_spans else [])]
    kept = [f for f in docs.schema.fields if f.name not in new]
    rows = rows.select(*[f.name for f in kept], "label_text_")

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = resident(key, lambda: Labeller(pickle.loads(sent.value), switch))
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, len(whole), ROWS_AT_ONCE)):
            own.renew()
            texts = batch.column(len(kept))
            found = own.labels(texts.to_pylist())
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.int64(), *([pa.float64()] if with_known else [])))]
            if keep_spans:
                spans = [[{"start": a, "end": b, "lang": lang} for a, b, lang in own.spans(t.as_py())] for t in texts]
                columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *columns], [*(f.name for f in kept), *new])

    more = (", known_share double" if with_known else "") + (", spans array<struct<start:int,end:int,lang:string>>" if keep_spans else "")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(labelled, f"{schema}, lang_pred string, score double, n_spans long{more}")


def held_out_fold(id_col: str = "doc_id") -> Column:
    """Whether a document is held out: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def predict_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_spans), learned from the documents not held out."""
    model = fitted(docs, ~held_out_fold())
    rows = docs.select("doc_id", held_out_fold().alias("held_out"), "text")
    return label_languages(rows, model).select("doc_id", "held_out", "lang_pred", "score", "n_spans")


def keep_known_languages(docs: DataFrame, *, least_share: float = 0.5) -> DataFrame:
    """The documents of which one language holds at least ``least_share`` of
    the letters by words that it knows: in a script it was learned in, and no
    worse a letter than its training words. A null lang is filled in by it.
    Columns as given."""
    model = fitted(docs, F.lit(True), known=True)
    kept = label_languages(docs, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("known_share") >= least_share))
    return kept.select(*[F.coalesce("lang", "lang_pred").alias(c) if c == "lang" else F.col(c) for c in docs.columns])
