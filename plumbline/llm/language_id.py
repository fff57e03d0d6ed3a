"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces, by a forward pass; a text's is the product over its words. Piece probabilities come
from expectation maximisation over the same segmentations, on all words of a bounded sample of labelled documents. Words
are scored once for each worker and batch, all together and position by position, so the pass is array arithmetic; a very
long word goes through the same pass in blocks that hand on the last sums, so no word is cut.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, batch

#: Bound of the sample that the model is fitted on: documents of each language, in expectation.
TRAIN_DOCS = 400
ROUNDS = 3
#: Characters of a word that are read at once; a longer word's sums are handed on from block to block, exactly.
BLOCK = 1024
#: Characters of the words that are scored together.
TOGETHER = 200_000
#: Probability of a character that is no piece, the same for all languages.
UNKNOWN = 1e-6
#: Probability of a character that no labelled text has, in the background of single characters.
UNSEEN = 1e-2
#: Evidence against the background from which on a text is taken as written in one of the languages.
LEAST_EVIDENCE = -10.0
#: Positions between two scalings of the forward pass; a model's probabilities are 1e-9 at least, so no sum between vanishes.
RESCALE = 16
#: Words whose scores a worker keeps.
CACHE_WORDS = 400_000
UNDETERMINED = "und"

_LETTERS_ONLY = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
_CODE = regex.compile(r"\S*[0-9]\S*")
_LETTER = regex.compile(r"\p{L}")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Lower-case words; ASCII that is no letter parts them."""
    return text.lower().encode("utf-8", "replace").translate(_LETTERS_ONLY).split()


class Pieces:
    """The vocabulary as sorted 64-bit hashes of code points, with all beginnings of pieces, so that a search ends where no
    piece goes on; pieces of control and byte fallback are left out."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        own = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}
        self.names = sorted(p for p in own if p and p.rfind("▁") <= 0)
        self.longest = max(map(len, self.names))
        index: dict[int, int] = {}
        for i, p in enumerate(self.names):
            h = 0
            for c in p:
                h = (h * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
                index.setdefault(h, -1)
            index[h] = i
        self.hashes = np.array(sorted(index), np.uint64)
        self.piece = np.array([index[h] for h in self.hashes.tolist()], np.int64)

    def spans(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, length, rows, pieces) of all pieces in the words, by start and length; -1 is a character that is none."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        row = np.repeat(np.arange(len(words)), size)
        start = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
        left = size[row] - start
        going, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        keys, rows, found = [], [], []
        for length in range(1, self.longest + 1):
            keep = left[going] >= length
            going, h = going[keep], h[keep]
            if not len(going):
                break
            h = h * _BASE + codes[going + length - 1]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            there = self.hashes[at] == h
            piece = np.where(there, self.piece[at], -1)
            hit = piece >= 0 if length > 1 else slice(None)
            keys.append(start[going[hit]] * (self.longest + 1) + length)
            rows.append(row[going[hit]])
            found.append(piece[hit])
            going, h = going[there], h[there]
        key, rows, found = np.concatenate(keys), np.concatenate(rows), np.concatenate(found)
        order = np.argsort(key, kind="stable")
        key, rows, found = key[order], rows[order], found[order]
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(key)]):
            yield *divmod(int(key[lo]), self.longest + 1), rows[lo:hi], found[lo:hi]


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _together(words: list[str]) -> Iterator[np.ndarray]:
    """Places of words of like lengths, so many that their characters are of bounded number."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    lo = 0
    while lo < len(order):
        n, hi = int(sizes[order[lo]]), lo
        most = max(n + 4, n * 5 // 4)
        hi = min(int(np.searchsorted(sizes[order], most, "right")), lo + max(1, TOGETHER // most))
        yield order[lo:hi]
        lo = hi


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # pieces (and one row for unknown characters) by languages
    path: str
    characters: dict[str, float]  # logs of how common each is, over all languages alike

    def background(self, words: list[bytes]) -> np.ndarray:
        """Log probability of each word as characters that know nothing of each other."""
        unseen, known = np.log(UNSEEN), self.characters.get
        return np.array([sum(known(c, unseen) for c in "▁" + w.decode()) for w in words], np.float64)

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Log probability of each word in each language, over all segmentations."""
        marked = ["▁" + w.decode() for w in words]
        out = np.zeros((len(words), len(self.languages)))
        for own in _together(marked):
            if len(marked[own[0]]) > BLOCK:
                for i in own.tolist():
                    out[i] = self._forward_blocks(marked[i])
            else:
                out[own] = self._forward([marked[i] for i in own])
        return out

    def _pass(self, words: list[str], alpha: np.ndarray, scale: np.ndarray, starts: int) -> None:
        """Adds to alpha (position, word, language) what begins before ``starts``; powers of two go from alpha to scale."""
        longest = pieces(self.path).longest
        for i, length, rows, at in pieces(self.path).spans(words):
            if i >= starts:
                break
            if length == 1 and i and i % RESCALE == 0:  # all segmentations go on from one of these positions
                ahead = alpha[i : i + longest, rows]
                power = np.frexp(ahead.max(axis=0))[1]
                alpha[i : i + longest, rows] = np.ldexp(ahead, -power)
                scale[rows] += power
            alpha[i + length][rows] += alpha[i][rows] * self.table[at]

    def _forward(self, words: list[str]) -> np.ndarray:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        alpha, scale = np.zeros((sizes.max() + 1, len(words), len(self.languages))), np.zeros((len(words), len(self.languages)), np.int64)
        alpha[0] = 1
        self._pass(words, alpha, scale, len(alpha))
        return np.log(alpha[sizes, np.arange(len(words))]) + scale * np.log(2)

    def _forward_blocks(self, word: str) -> np.ndarray:
        """The same for one word of any length, holding the sums of one block."""
        longest = pieces(self.path).longest
        handed, scale = np.zeros((longest, 1, len(self.languages))), np.zeros((1, len(self.languages)), np.int64)
        handed[0] = 1
        for start in range(0, len(word), BLOCK):
            own = word[start : start + BLOCK + longest - 1]
            here = min(BLOCK, len(word) - start)
            alpha = np.concatenate([handed, np.zeros((BLOCK, *handed.shape[1:]))])
            self._pass([own], alpha, scale, here)
            handed = alpha[here : here + longest]
            power = np.frexp(handed.max(axis=0))[1]
            handed, scale = np.ldexp(handed, -power), scale + power
        return np.log(handed[0, 0]) + scale[0] * np.log(2)


def expected(words: list[str], times: np.ndarray, log: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """How often each piece (the last: unknown characters) is used, over all segmentations by their probabilities."""
    found = np.zeros(len(log))
    for own in _together(words):
        mine = [words[i] for i in own]
        sizes, k = np.fromiter(map(len, mine), np.int64, len(mine)), np.arange(len(mine))
        spans = list(vocabulary.spans(mine))
        alpha, beta = (np.full((sizes.max() + 1, len(mine)), -np.inf) for _ in range(2))
        alpha[0], beta[sizes, k] = 0, 0
        for i, length, rows, at in spans:
            alpha[i + length][rows] = np.logaddexp(alpha[i + length][rows], alpha[i][rows] + log[at])
        for i, length, rows, at in reversed(spans):
            beta[i][rows] = np.logaddexp(beta[i][rows], beta[i + length][rows] + log[at])
        whole = alpha[sizes, k]
        for i, length, rows, at in spans:
            np.add.at(found, at, times[own[rows]] * np.exp(alpha[i][rows] + log[at] + beta[i + length][rows] - whole[rows]))
    return found


def fit(counts: dict[str, list[tuple[bytes, int]]], path: str, rounds: int = ROUNDS) -> Model | None:
    """Expectation maximisation for each language by itself, then a little of the languages' mean in each."""
    languages = tuple(sorted(counts))
    if not languages:
        return None
    vocabulary = pieces(path)
    table = np.zeros((len(vocabulary.names) + 1, len(languages)))
    for column, lang in enumerate(languages):
        words, times = ["▁" + w.decode() for w, _ in counts[lang]], np.array([n for _, n in counts[lang]], np.float64)
        p = np.zeros(len(vocabulary.names) + 1)
        for own in _together(words):
            for _, _, rows, at in vocabulary.spans([words[i] for i in own]):
                np.add.at(p, at, times[own[rows]])
        for _ in range(rounds):  # in logs, as pieces of a rare word may be of any small probability
            p[-1] = 0
            p = np.maximum(p / max(p.sum(), 1), 1e-300)
            p[-1] = UNKNOWN
            p = expected(words, times, np.log(p), vocabulary)
        p[-1] = 0
        table[:, column] = p / max(p.sum(), 1)
    mean = table.mean(axis=1, keepdims=True)
    table = 0.98 * table + 0.02 * mean + 1e-9
    table[-1] = UNKNOWN
    return Model(languages, table, path, _characters(counts))


def _characters(counts: dict[str, list[tuple[bytes, int]]]) -> dict[str, float]:
    share: Counter = Counter()
    for own in counts.values():
        mine: Counter = Counter()
        for word, n in own:
            for c in "▁" + word.decode():
                mine[c] += n
        total = sum(mine.values())
        for c, n in mine.items():
            share[c] += n / total / len(counts)
    return {c: float(np.log(max(v, 1e-6))) for c, v in share.items()}


class _Scores(dict):
    """Row of each word; new words get one and wait to be scored."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows, self.new = model, np.zeros((0, len(model.languages) + 1)), []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = row = len(self)
        return row

    def settle(self) -> np.ndarray:
        if self.new:
            own = np.column_stack([self.model.log_probabilities(self.new), self.model.background(self.new)])
            self.rows = np.concatenate([self.rows, own])
            self.new = []
        return self.rows


def predictor(model: Model | None) -> Callable[[list[str | None]], tuple[list[str], np.ndarray, np.ndarray]]:
    """Language, score and evidence of each text of a batch. The score is the posterior with evidence tempered by the root of
    the number of words, as words of a text are not independent; the evidence says how much better the likeliest language
    explains the text than single characters do, tempered alike, whatever the number of languages; of three words or more the
    one that speaks most against the language is left out, as a name or a key may."""
    scores = _Scores(model) if model else None

    def predict(own: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        nonlocal scores
        langs, out, evidence = [UNDETERMINED] * len(own), np.zeros(len(own)), np.full(len(own), -np.inf)
        if not model:
            return langs, out, evidence
        if len(scores) > CACHE_WORDS:
            scores = _Scores(model)
        rows = {}
        for i, t in enumerate(own):
            if t and _LETTER.search(t) and (words := words_of(t)):
                rows[i] = np.fromiter(map(scores.__getitem__, words), np.int64, len(words))
        table = scores.settle()
        for i, at in rows.items():
            log = table[at].sum(axis=0) / np.sqrt(len(at))
            best = int(log[:-1].argmax())
            langs[i], out[i] = model.languages[best], 1 / np.exp(log[:-1] - log[best]).sum()
            each = table[at, best] - table[at, -1]
            evidence[i] = (each.sum() - (min(0.0, each.min()) if len(at) > 2 else 0.0)) / np.sqrt(len(at))
        return langs, out, evidence

    return predict


def _count_words(batches: Batches) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])
    for rows in batches:
        seen: dict[str, Counter] = {}
        for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist()):
            seen.setdefault(lang, Counter()).update(words_of(text or ""))
        flat = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
        yield batch(schema, [list(c) for c in zip(*flat)] if flat else [[], [], []])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str | None = None, docs: int = TRAIN_DOCS) -> Model | None:
    """A model from all words of about ``docs`` documents of each language, chosen by a hash of the id.

    Rows without a label are left out, null texts have no words; words are fitted in the order of their bytes, so the result
    does not depend on the order of rows; None if there are no labelled rows."""
    own = labelled.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, float(min(1.0, docs / n)))))
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) / float(1 << 24)
    sample = own.where(u < F.element_at(share, F.col("lang"))).select("lang", "text")
    counts = sample.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found: dict[str, list] = {lang: [] for lang in sizes}
    for r in counts.toArrow().to_pylist():  # the words of the sample, once each
        found[r["lang"]].append((r["word"], r["n"]))
    return fit({k: sorted(v) for k, v in found.items() if v}, path or public_tokenizers.path("piece_bpe_32k.model"))


def held_out(id_col: F.Column) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; only the text is used for the prediction.

    Null, empty and letterless texts are 'und' with score 0, and so is everything without a model; of equally likely
    languages the first by name is taken; repeated rows get equal answers; a null id is not held out; words and texts of any
    length are read whole; an empty table gives no rows. Narrow."""
    own = df.select(df[id_col].cast("long").alias("doc_id"), held_out(df[id_col]).alias("held_out"), df[text_col].cast("string").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # pieces of the vocabulary x languages

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        predict = predictor(shared.value)
        for rows in batches:
            langs, scores, _ = predict(rows.column("text").to_pylist())
            yield batch(_SCHEMA, [rows.column(0), rows.column(1), langs, scores])

    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accept(df: DataFrame, model: Model | None, text_col: str = "text", least: float = LEAST_EVIDENCE) -> DataFrame:
    """The rows written in one of the model's languages, with all their columns.

    A text stays if single characters don't explain it, or what is left of it without keys, numbers and the like, much better
    than its likeliest language does: foreign languages, scripts that no labelled text has, and random letters go; so do
    texts without a letter, empty and null ones, and all rows where there is no model. Repeated rows stay or go together; an
    empty table stays empty. Narrow."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        predict = predictor(shared.value)
        for rows in batches:
            own = rows.column(text_col).to_pylist()
            langs, _, evidence = predict(own)
            low = [i for i, e in enumerate(evidence.tolist()) if e < least and langs[i] != UNDETERMINED]
            if low:  # a word with a digit in it is a code, which tells of no language
                evidence[low] = np.maximum(evidence[low], predict([_CODE.sub(" ", own[i]) for i in low])[2])
            yield rows.filter(pa.array([x != UNDETERMINED and e >= least for x, e in zip(langs, evidence)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
