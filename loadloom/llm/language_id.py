"""Language identification by segmentation-marginalised unigrams.

The vocabulary is that of a public tokenizer and fixed. Each language has a probability for each piece, learned from texts
of known language. A word's probability is the sum over every way to cut it into pieces, by a forward pass along its
characters, however long it is; a text's is the product over its words, digits and signs among them, and the languages'
shares of it give prediction and score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F

START = "▁"
#: Words that a task remembers (fewer with very many languages); it forgets all when it has more.
REMEMBERED = 300_000
#: Numbers in one array of the forward pass, and positions of words that are looked up at once.
CELLS, BLOCK = 1 << 18, 4096
#: Share of a character that is no piece.
UNKNOWN = 1e-7
LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"
#: Letters as opposed to digits and signs, by ranges of code points; the space stands for a word's start.
_LETTERS = "a-z\u00aa\u00b5\u00ba\u00c0-\u1fff\u2c00-\U0010ffff"
RUN = re.compile(f" ?(?:[{_LETTERS}]+|[^ {_LETTERS}]+)")
WORD = re.compile(" [^ ]+")


def normal(text: str) -> str:
    """Lower-cased, with one space before each word; every other character stays."""
    return " " + " ".join(text.lower().replace(START, " ").split())


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_processors: dict[str, sentencepiece.SentencePieceProcessor] = {}


def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    if path not in _processors:
        _processors[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _processors[path]


def count_pieces(path: str):
    """(lang, piece, n): pieces of each language's words, as the vocabulary's own tokenizer cuts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, totals, waiting = processor(path), {}, {}

        def settle() -> None:
            for lang, words in waiting.items():
                own = totals.setdefault(lang, np.zeros(sp.vocab_size(), np.int64))
                keys = list(words)
                cut = sp.encode(keys, num_threads=1)
                times = np.repeat(np.fromiter(words.values(), np.int64, len(keys)), list(map(len, cut)))
                np.add.at(own, np.fromiter(chain.from_iterable(cut), np.int64, len(times)), times)
            waiting.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    waiting.setdefault(lang, Counter()).update(normal(text).split())
            if sum(map(len, waiting.values())) > REMEMBERED:
                settle()
        settle()
        for lang, own in totals.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "piece", "n"])

    return run


class Model:
    """Languages, and for each piece of the vocabulary the probability in each."""

    def __init__(self, languages: list[str], counts: np.ndarray, path: str) -> None:
        self.languages, self.path = languages, path
        smoothed = counts + 0.1
        self.share = (smoothed / smoothed.sum(1, keepdims=True)).T.copy()  # piece x language


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


class Scorer:
    """Log-probabilities of words in each language; each word is computed once and has a row in a table.

    A piece that spans a border between two characters has the two side by side, so where no piece has them so, the sum over
    segmentations is the product of the sums on either side. Words are cut at such borders: at those between letters and
    signs if the vocabulary allows it, and within long words at every one. Strings are looked up by 64-bit hashes.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, model: Model) -> None:
        sp = processor(model.path)
        kept = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        pieces = [sp.id_to_piece(i) for i in kept]
        self.pieces = {p: k for k, p in enumerate(pieces)}
        self.share = model.share[kept]
        self.longest = max(map(len, pieces), default=1)
        self.together = {a + b for p in pieces for a, b in zip(p, p[1:])}
        crossing = any(len(RUN.findall(" " + p.lstrip(START))) > 1 for p in pieces if p == p.lower() and p.strip(START))
        self.cut = (WORD if crossing else RUN).findall
        hashes = np.zeros(len(pieces), np.uint64)
        for n in {len(p) for p in pieces}:
            at = [k for k, p in enumerate(pieces) if len(p) == n]
            hashes[at] = self.windows([pieces[k] for k in at], n)[0]
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes >> np.uint64(44)] = True
        self.row: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)))
        self.most_rows = max(1000, min(REMEMBERED, (1 << 22) // max(1, len(model.languages))))

    def windows(self, words: list[str], size: int, grown: np.ndarray | None = None, codes: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the runs of ``size`` characters of equally long ``words``: place x word."""
        if codes is None:
            codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).T.astype(np.uint64)
            codes = mix(codes * self.BASE + np.uint64(1))
        if grown is None:
            grown = codes
            for k in range(1, size):
                grown = mix(grown[:-1] * self.BASE + codes[k:])
            return grown
        return mix(grown[:-1] * self.BASE + codes[size - 1 :])

    def found(self, codes: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, list[int]]]:
        """For each size of piece: the words and pieces of all matches by place, and where each place's matches begin."""
        out, grown = [], None
        for size in range(1, min(self.longest, len(codes)) + 1):
            grown = codes if grown is None else self.windows([], size, grown, codes)
            place, word = np.nonzero(self.maybe[grown >> np.uint64(44)])
            if len(place):
                h = grown[place, word]
                k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = self.hashes[k] == h
                place, word, k = place[hit], word[hit], self.order[k[hit]]
                if len(place):
                    out.append((size, word, k, np.searchsorted(place, np.arange(len(grown) + 1)).tolist()))
        return out

    def forward(self, words: list[str]) -> np.ndarray:
        """For words of one length: the log of the sum over all segmentations of the product of their pieces' shares.

        Only the last places, as many as the longest piece has characters, are held.
        """
        n, ring = len(words[0]), self.longest + 1
        ways = np.zeros((ring, len(words), self.table.shape[1]))
        ways[0] = 1.0
        scale = np.zeros((len(words), self.table.shape[1]))
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n).T
        for first in range(0, n, BLOCK):
            back = max(0, first - self.longest + 1)
            hits = self.found(mix(letters[back : first + BLOCK].astype(np.uint64) * self.BASE + np.uint64(1)))
            for end in range(first + 1, min(n, first + BLOCK) + 1):
                total = ways[(end - 1) % ring] * UNKNOWN  # a character that is no piece
                for size, word, piece, begins in hits:
                    at = end - size - back
                    if at >= 0 and begins[at] < begins[at + 1]:
                        own = slice(begins[at], begins[at + 1])
                        w = word[own]
                        total[w] += ways[(end - size) % ring, w] * self.share[piece[own]]
                ways[end % ring] = total
                if end % 16 == 0:  # keeps long words within range
                    top = total.copy()
                    scale += np.log(top)
                    ways /= top
        return np.log(ways[n % ring]) + scale

    def parts(self, word: str) -> list[str]:
        """``word`` cut wherever no piece has its neighbouring characters side by side."""
        ends = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.together]
        return [word[a:b] for a, b in zip([0, *ends], [*ends, len(word)])]

    def words(self, words: list[str]) -> np.ndarray:
        """Log-probabilities of ``words`` (a space stands for the start), a row for each."""
        own = [START + w[1:] if w[0] == " " else w for w in words]
        parts = [self.parts(w) if len(w) > self.longest else [w] for w in own]
        at = {p: k for k, p in enumerate(dict.fromkeys(chain.from_iterable(parts)))}
        logs = np.zeros((len(at), self.table.shape[1]))
        by_length: dict[int, list[str]] = {}
        for p in at:
            by_length.setdefault(len(p), []).append(p)
        step = max(1, CELLS // max(1, self.table.shape[1]))
        for n, same in by_length.items():
            width = max(1, min(step, step * 16 // n))
            for k in range(0, len(same), width):
                some = same[k : k + width]
                logs[[at[p] for p in some]] = self.forward(some)
        rows = np.array([at[p] for p in chain.from_iterable(parts)], np.int64)
        return np.add.reduceat(logs[rows], np.cumsum([0, *map(len, parts[:-1])]), axis=0) if len(rows) else np.zeros((0, self.table.shape[1]))

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        cut = [self.cut(normal(t)) for t in texts]
        at = list(map(self.row.get, chain.from_iterable(cut)))
        if None in at:
            new = list({w for w, k in zip(chain.from_iterable(cut), at, strict=True) if k is None})
            if len(self.row) + len(new) > self.most_rows:
                self.row, self.table = {}, self.table[:0]
                new = list(set(chain.from_iterable(cut)))
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.table = np.vstack([self.table, self.words(new)])
            at = list(map(self.row.__getitem__, chain.from_iterable(cut)))
        rows, first = np.array(at, np.int64), 0
        for own in cut:
            yield self.table[rows[first : first + len(own)]].sum(0)
            first += len(own)


_ready: dict[int, tuple] = {}


def predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        if id(m) not in _ready:
            _ready.clear()
            _ready[id(m)] = (m, Scorer(m))
        scorer = _ready[id(m)][1]
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column(2).to_pylist()
                told = [bool(m.languages and t and LETTER.search(t)) for t in texts]
                logs = scorer.texts([t for t, ok in zip(texts, told, strict=True) if ok])
                langs, scores = [], []
                for ok in told:
                    if ok:
                        log = next(logs)
                        best = int(log.argmax())
                        langs.append(m.languages[best])
                        scores.append(float(1.0 / np.exp(log - log[best]).sum()))
                    else:
                        langs.append(UNDETERMINED)
                        scores.append(0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def fit(docs: DataFrame, path: str) -> Model:
    """Piece shares of each language in ``docs`` (doc_id, lang, text), from all of its documents.

    Each task sends one row for each language and piece. Every value of lang is learned.
    """
    languages = sorted(r["lang"] for r in docs.where("lang is not null").select("lang").distinct().collect())
    table = np.zeros((len(languages), processor(path).vocab_size()))
    if languages:
        known = docs.where("lang is not null and text is not null").select("lang", "text")
        counts = known.mapInArrow(count_pieces(path), "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        at = {lang: i for i, lang in enumerate(languages)}
        for batch in counts.toArrow().to_batches():  # at most languages times vocabulary rows
            rows = np.fromiter(map(at.__getitem__, batch.column(0).to_pylist()), np.int64, batch.num_rows)
            table[rows, batch.column(1).to_numpy()] = batch.column(2).to_numpy()
    return Model(languages, table, path)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the row is kept from learning; a null id counts as kept from it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


def identify_languages(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Language of every text of ``docs`` (doc_id, text, lang); learned from rows whose crc32(doc_id) mod 4 is not 2.

    Returns doc_id, held_out, lang_pred, score (the predicted language's share of the text's probability). lang, and nothing
    but text beside it, is read for learning; predictions read the text alone.

    Null or empty texts, and those without a letter: ``und`` with score 0; so is every text if nothing could be learned. Ties
    go to the language that comes first. Repeated rows are each returned. Null ids are held out. Empty table: no rows.
    """
    path = path or vocabulary_path()
    docs = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id").cast("long"), 4, 2).alias("held_out"), F.col("text").cast("string"), F.col("lang").cast("string"))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.where("not held_out"), path))
    return docs.select("doc_id", "held_out", "text").mapInArrow(predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
