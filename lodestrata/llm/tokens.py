"""Token counts by byte-pair merging, and SentencePiece encoding and decoding.

Both work on words: a pre-token of the byte-level vocabulary, or a run of
characters across whose border no piece of the SentencePiece vocabulary
reaches. A word's result is kept in the Python worker, in two tables of at most
``CACHE_WORDS`` words together, of which the older is dropped when both are full;
words of more than ``LONG_WORD`` characters are computed each time they are met,
so that the tables are bounded in bytes too. Rows are handled
in Arrow batches where they lie: there is no shuffle, and a lost executor's
batches are simply computed again. Vocabulary files are read on every executor
from ``path``.

Defined results: a null text is an empty text, of 0 tokens; repeated rows and
null ids are counted row by row; an empty table gives no rows; texts of any
length are taken whole; other columns are left out, whatever their names. The
ids of each new word, and of one text of every batch as a whole, are held
against the library's; a difference is an error that ends the job, never mended.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from operator import concat

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.workers import resident

CACHE_WORDS = 300_000
LONG_WORD = 256
#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The visible letter that byte-level vocabularies write for each byte:
    printable Latin-1 bytes stand for themselves, the others, in order, for
    the code points from 256 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges: the lowest-ranked adjacent pair, the
    leftmost on ties, is popped and merged until no pair has a rank. The count
    is the number of initial symbols less the merges made."""
    n = len(symbols)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(rank, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if j < 0 or symbols[i] != left or symbols[j] != right:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = left + right, ""
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (rank, h, symbols[h], symbols[i]))
        merges += 1
    return n - merges


class PairCounter(dict):
    """word -> tokens, filled as words are asked for."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.letters = byte_letters()
        self.older: dict[str, int] = {}
        self.words = regex.compile(PRE_TOKENS).findall
        special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        # an added token in a text is one token, and words do not reach across it
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def __missing__(self, word: str) -> int:
        if len(word) > LONG_WORD:
            return merged_length([self.letters[b] for b in word.encode()], self.ranks)
        if len(self) >= CACHE_WORDS // 2:  # words not met since the last time are forgotten
            self.older = dict(self)
            self.clear()
        n = self.older.get(word)
        if n is None:
            n = merged_length([self.letters[b] for b in word.encode()], self.ranks)
        self[word] = n
        return n

    def count(self, text: str) -> int:
        get = self.__getitem__
        if self.special is None or (found := len(self.special.findall(text))) == 0:
            return sum(map(get, self.words(text)))
        return found + sum(sum(map(get, self.words(part))) for part in self.special.split(text))


def pair_counter(path: str) -> PairCounter:
    return resident(("pairs", path), lambda: PairCounter(path))


def count_tokens(docs: DataFrame, *, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per document: (doc_id, n_bytes, n_tokens, over_limit)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = pair_counter(path)
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.cast(pc.binary_length(texts), pa.int64())
            tokens = pa.array([counter.count(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, tokens, pc.greater(tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


SPACE = "▁"
#: A rank and a place in a word as one number.
PLACE_BITS = 32
LAST_PLACE = (1 << PLACE_BITS) - 1


def word_pattern(pairs: set[tuple[str, str]]) -> str:
    """Words end where no piece can reach on: before spaces, around line breaks,
    and between letters and other characters. Letters that some piece has beside
    another kind of character count as such; if pieces join these to letters
    all the same, only spaces and line breaks end words."""
    broken = "" if any("\n" in pair for pair in pairs) else "\n"
    one = f"{broken}|" if broken else ""
    is_letter = re.compile(r"[^\W\d_]").match
    kinds = [(a, b, bool(is_letter(a)), bool(is_letter(b))) for a, b in pairs if a != SPACE]
    others = {c for a, b, x, y in kinds if x != y for c in (a if x else b)}
    if any((x and a not in others) != (y and b not in others) for a, b, x, y in kinds):
        return f"{one}(?:{SPACE}+|[^{SPACE}])[^{SPACE}{broken}]*"
    more = re.escape("".join(sorted(others)))
    return f"{one}{SPACE}*+(?:[^\\W\\d_{more}]+|(?:(?![{SPACE}{broken}])[\\W\\d_{more}])+)|{SPACE}+"


class PieceCoder(dict):
    """word -> its ids, joined by commas. A word's symbols are merged from an
    agenda of adjacent pairs: the best-scored piece first, the leftmost on ties.
    ``odd`` holds the words whose ids do not read back as the word."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = self.library.id_to_piece
        ids = range(self.library.get_piece_size())
        plain = [i for i in ids if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))]
        self.ids = {piece(i): i for i in plain}
        self.scores = {piece(i): self.library.get_score(i) for i in plain}
        self.bytes = {int(piece(i)[1:-1], 16): i for i in ids if self.library.is_byte(i)}
        self.surfaces = [bytes([int(piece(i)[1:-1], 16)]) if self.library.is_byte(i) else piece(i).encode() for i in ids]
        self.plain = ["" if self.library.is_byte(i) else piece(i) for i in ids]
        self.decimals = [*map(str, ids)]
        pairs = {pair for p in self.ids for pair in zip(p, p[1:], strict=False)}
        if any(a != SPACE and b == SPACE for a, b in pairs) or len(self.bytes) != 256:
            raise ValueError("needs a vocabulary with byte fallback, whose pieces have spaces at their start only")
        self.words = re.compile(word_pattern(pairs)).findall
        self.older: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.fresh: dict[str, list[int]] = {}

    @property
    def scores(self) -> dict[str, float]:
        return self._scores

    @scores.setter
    def scores(self, scores: dict[str, float]) -> None:
        """Ranks are places by score, the best first, with room for a place in a word."""
        places = {score: at << PLACE_BITS for at, score in enumerate(sorted({*scores.values()}, reverse=True))}
        self._scores, self.ranks = scores, {piece: places[score] for piece, score in scores.items()}

    def encoded(self, word: str) -> list[int]:
        """Symbols are known by their first places: ``after`` has where a symbol
        ends, ``now`` the rank of it and the next one as a pair. An entry of the
        agenda that is not its place's rank any more is passed over."""
        n, rank_of = len(word), self.ranks.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        now = [*map(rank_of, map(concat, word, word[1:])), None]
        agenda = [rank + i for i, rank in enumerate(now) if rank is not None]
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            i = entry & LAST_PLACE
            if now[i] != entry - i:
                continue
            j = after[i]
            now[j] = None
            end = after[i] = after[j]
            now[i] = rank = None
            if end < n:
                before[end] = i
                now[i] = rank = rank_of(word[i : after[end]])
                if rank is not None:
                    heapq.heappush(agenda, rank + i)
            h = before[i]
            if h >= 0:
                now[h] = rank = rank_of(word[h:end])
                if rank is not None:
                    heapq.heappush(agenda, rank + h)
        out: list[int] = []
        i = 0
        while i < n:
            end = after[i]
            found = self.ids.get(word[i:end])
            if found is not None:
                out.append(found)
            else:
                out += [self.bytes[b] for b in word[i:end].encode()]
            i = end
        return out

    def decoded(self, ids: list[int]) -> str:
        """Ids read back: bytes joined, spaces for the space letter."""
        return b"".join([self.surfaces[i] for i in ids]).decode(errors="replace").replace(SPACE, " ")

    def _put(self, word: str, ids: list[int]) -> str:
        # bytes are no plain pieces, so words that hold some are read back in full
        if "".join([self.plain[i] for i in ids]) != word and (back := self.decoded(ids)) != word.replace(SPACE, " "):
            self.odd[word] = back
        found = self[word] = ",".join([self.decimals[i] for i in ids])
        return found

    def __missing__(self, word: str) -> str:
        if (found := self.older.get(word)) is None:
            ids = self.fresh[word] = self.encoded(word)
            return self._put(word, ids)
        self[word] = found
        return found

    def check(self, text: str, ids: str) -> None:
        """Hold a whole text, and the new words of a batch, against the library.
        It adds a space in front, so words without one are asked after a line
        break, which no piece spans."""
        if ids != ",".join(map(str, self.library.encode(text))):
            raise ValueError(f"ids differ from the library's for the text {text[:200]!r}")
        if self.fresh:
            lead = len(self.library.encode("\n"))
            # a lone space is what the library puts before a line break
            asked = ["\n" if w == SPACE else w[1:].replace(SPACE, " ") if w[0] == SPACE else "\n" + w for w in self.fresh]
            for (word, ids_), want in zip(self.fresh.items(), self.library.encode(asked, num_threads=1), strict=True):
                want = want[: lead - 1] if word == SPACE else want if word[0] == SPACE else want[lead:]
                if want != ids_:
                    raise ValueError(f"ids differ from the library's for the word {word[:200]!r}")
            for word in [w for w in self.fresh if len(w) > LONG_WORD]:
                del self[word]
                self.odd.pop(word, None)
            self.fresh.clear()
        if len(self) > CACHE_WORDS // 2:  # words not met since the last time are forgotten
            self.older = dict(self)
            self.clear()

    def split(self, text: str) -> list[str]:
        return self.words(SPACE + text.replace(" ", SPACE)) if text else []

    def code(self, text: str) -> tuple[str, str]:
        """(ids joined by commas, the text that they read back as)."""
        words = self.split(text)
        joined = ",".join(map(self.__getitem__, words))
        if self.odd and not self.odd.keys().isdisjoint(words):
            return joined, "".join(self.odd.get(w) or w.replace(SPACE, " ") for w in words)[1:]
        return joined, "".join(words).replace(SPACE, " ")[1:]


def piece_coder(path: str) -> PieceCoder:
    return resident(("pieces", path), lambda: PieceCoder(path))


def encode_pieces(docs: DataFrame, *, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, at_once: int = 256) -> DataFrame:
    """Per document: (doc_id, n_tokens, ids_sha256, decoded_sha256), and with
    ``keep_ids`` also ids array<int> and decoded, the text read back."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_ids else [])]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_coder(path)
        for whole in batches:
            for at in range(0, len(whole), at_once):
                batch = whole.slice(at, at_once)
                texts = batch.column(1).to_pylist()
                found = [coder.code(t) for t in texts]
                coder.check(texts[0], found[0][0])
                digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
                columns = [batch.column(0), pa.array([ids.count(",") + 1 if ids else 0 for ids, _ in found], pa.int64()), pa.array([digest(ids) for ids, _ in found], pa.string()), pa.array([digest(text) for _, text in found], pa.string())]
                if keep_ids:
                    columns += [pa.array([[*map(int, ids.split(","))] if ids else [] for ids, _ in found], pa.list_(pa.int32())), pa.array([text for _, text in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    more = ", ids array<int>, decoded string" if keep_ids else ""
    return rows.mapInArrow(coded, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
