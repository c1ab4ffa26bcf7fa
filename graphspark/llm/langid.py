"""Language identification by unigram pieces, summed over all segmentations of every word."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphspark.llm.common import in_worker

#: Probability of a single character that no piece covers, the same in every language.
FLOOR = 1e-7
#: Words longer than this are summed in log space: products of so many small factors would vanish.
LONG = 32
#: Letters of a word that are held at a time in the fit, which splits longer ones there.
STRETCH = 1000
#: Words whose scores a worker keeps, and characters of texts that are judged together.
KEEP, BLOCK = 300_000, 4_000_000
MAX_LANGUAGES = 500

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str | None) -> list[str]:
    """The lower-cased runs of letters of a text."""
    return _WORD.findall(text.lower()) if text else []


def vocabulary(model_file: str) -> list[str]:
    """The pieces of a SentencePiece model file that a lower-cased word of letters can hold."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ordinary = (
        sp.id_to_piece(i)
        for i in range(sp.vocab_size())
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
    )
    return [p for p in ordinary if p == p.lower() and regex.fullmatch(r"▁?[\p{L}\p{M}]*", p)]


class Pieces:
    """A fixed piece vocabulary; row 0 stands for what is no piece."""

    def __init__(self, pieces: Sequence[str]) -> None:
        self.pieces = list(pieces)
        self.row = {p: i + 1 for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces), default=1)

    def lattice(self, words: Sequence[str]) -> list[list[tuple[int, np.ndarray]]]:
        """For words of one length: at each end j, the (start i, rows of the pieces i..j) to sum."""
        n = len(words[0])
        get = self.row.get
        at: list[list[tuple[int, np.ndarray]]] = [[]]
        for j in range(1, n + 1):
            ends = []
            for i in range(max(0, j - self.longest), j):
                rows = np.array([get(w[i:j], 0) for w in words], np.int32)
                if i == j - 1 or rows.any():
                    ends.append((i, rows))
            at.append(ends)
        return at


def _by_length(words: Iterable[str]) -> dict[int, list[str]]:
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    return groups


def _forward(lattice, prob: np.ndarray, m: int) -> list[np.ndarray]:
    alpha = [np.ones((m, prob.shape[1]))]
    for ends, j in zip(lattice[1:], range(1, len(lattice))):
        total = np.zeros((m, prob.shape[1]))
        for i, rows in ends:
            p = prob[rows]
            if i == j - 1:
                p = np.where((rows == 0)[:, None], FLOOR, p)
            total += alpha[i] * p
        alpha.append(total)
    return alpha


def _log_sums(terms: list[tuple[int, np.ndarray]], known: list[np.ndarray]) -> np.ndarray:
    """log of the sum over (i, log p) of exp(known[i] + log p)."""
    stacked = np.stack([known[i] + p for i, p in terms])
    top = stacked.max(0)
    return top + np.log(np.exp(stacked - top).sum(0))


def _log_lattice(lattice, prob: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
    """(start, log probabilities) for each end, where 0 stands for no piece and is as good as -inf."""
    with np.errstate(divide="ignore"):
        logs = np.maximum(np.log(prob), -1e30)
    none, floor = np.full(prob.shape[1], -1e30), math.log(FLOOR)
    return [[(i, np.where((rows == 0)[:, None], floor if i == j - 1 else none, logs[rows])) for i, rows in ends] for j, ends in enumerate(lattice)]


def log_likelihoods(words: Sequence[str], vocab: Pieces, prob: np.ndarray) -> np.ndarray:
    """log P(word | language) for every word (rows) and language (columns).

    The forward algorithm: the probability of a prefix is the sum over its last piece, so all
    segmentations of the marked word count. Words of one length go together; longer ones one by one,
    rescaled at every character, so that memory does not depend on their length.
    """
    out = np.empty((len(words), prob.shape[1]))
    place = {w: i for i, w in enumerate(words)}
    for n, group in _by_length(words).items():
        if n > LONG:
            for w in group:
                out[place[w]] = _long(w, vocab, prob)
            continue
        for lo in range(0, len(group), 4096):
            part = group[lo : lo + 4096]
            lattice = vocab.lattice(["▁" + w for w in part])
            out[[place[w] for w in part]] = np.log(_forward(lattice, prob, len(part))[-1])
    return out


def _long(word: str, vocab: Pieces, prob: np.ndarray) -> np.ndarray:
    """The same for one long word, rescaled at every character."""
    marked = "▁" + word
    width = vocab.longest
    alpha = [np.ones(prob.shape[1])]
    scale = np.zeros(prob.shape[1])
    for j in range(1, len(marked) + 1):
        total = np.zeros(prob.shape[1])
        for back in range(1, min(width, j, len(alpha)) + 1):
            row = vocab.row.get(marked[j - back : j], 0)
            if row:
                total += alpha[-back] * prob[row]
            elif back == 1:
                total += alpha[-1] * FLOOR
        alpha = [a / total for a in alpha[-width:]]
        alpha.append(np.ones(prob.shape[1]))
        scale += np.log(total)
    return scale


def _expected(lattice, weight: np.ndarray, prob: np.ndarray, expected: np.ndarray) -> None:
    """Add the expected counts of the pieces of words of one length, which occur ``weight`` times."""
    m, n = len(weight), len(lattice) - 1
    alpha = _forward(lattice, prob, m)
    beta = [np.zeros((m, 1)) for _ in range(n)] + [np.ones((m, 1))]
    for j in range(n, 0, -1):
        for i, rows in lattice[j]:
            p = prob[rows]
            if i == j - 1:
                p = np.where((rows == 0)[:, None], FLOOR, p)
            through = beta[j] * p
            beta[i] += through
            gain = (alpha[i] * through / alpha[n])[:, 0] * weight
            expected += np.bincount(rows, gain, len(expected))


def _expected_long(lattice, weight: np.ndarray, prob: np.ndarray, expected: np.ndarray) -> None:
    """The same in log space."""
    m, n = len(weight), len(lattice) - 1
    steps = _log_lattice(lattice, prob)
    alpha = [np.zeros((m, 1))]
    for ends in steps[1:]:
        alpha.append(_log_sums(ends, alpha))
    onward: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n + 1)]
    for j, ends in enumerate(steps):
        for i, p in ends:
            onward[i].append((j, p))
    beta = [np.zeros((m, 1))] * (n + 1)
    for i in range(n - 1, -1, -1):
        beta[i] = _log_sums(onward[i], beta)
    for j in range(1, n + 1):
        for (i, rows), (_, p) in zip(lattice[j], steps[j]):
            gain = np.exp(alpha[i] + p + beta[j] - alpha[n])[:, 0] * weight
            expected += np.bincount(rows, gain, len(expected))


def fit_pieces(counts: dict[str, int], vocab: Pieces, rounds: int = 3, smooth: float = 0.05) -> np.ndarray:
    """Piece probabilities of one language from its word counts, by expectation-maximisation.

    Expected piece counts come from forward and backward sums over all segmentations. Every piece
    of the vocabulary keeps ``smooth`` counts. Of a word of more than STRETCH letters each stretch of
    so many is a word's part of its own; only a piece that spans two of them is not seen.
    """
    size = len(vocab.pieces) + 1
    parts: Counter = Counter()
    for w, n in counts.items():
        marked = "▁" + w
        for lo in range(0, len(marked), STRETCH):
            parts[marked[lo : lo + STRETCH]] += n
    groups = []
    for n, group in _by_length(parts).items():
        for lo in range(0, len(group), max(1, 140_000 // n)):
            part = group[lo : lo + max(1, 140_000 // n)]
            groups.append((vocab.lattice(part), np.array([parts[w] for w in part], float), n > LONG))
    prob = np.full((size, 1), 1.0 / size)
    prob[0] = 0.0
    for _ in range(rounds):
        expected = np.full(size, smooth)
        for lattice, weight, long in groups:
            (_expected_long if long else _expected)(lattice, weight, prob, expected)
        expected[0] = 0.0
        prob = (expected / expected.sum())[:, None]
    return prob[:, 0]


class LanguageModel:
    """Languages and their piece probabilities."""

    def __init__(self, languages: Sequence[str], vocab: Pieces, prob: np.ndarray) -> None:
        self.languages, self.vocab, self.prob = list(languages), vocab, prob
        self._index: dict[str, int] = {}
        self._scores = np.empty((0, len(self.languages)))

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "pieces": self.vocab.pieces, "prob": self.prob}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["languages"], Pieces(state["pieces"]), state["prob"])

    def forget(self) -> None:
        self._index, self._scores = {}, np.empty((0, len(self.languages)))

    def _learn(self, words: set[str]) -> None:
        if len(self._index) > KEEP:
            self.forget()
        fresh = [w for w in words if w not in self._index]
        if fresh and self.languages:
            at = len(self._index)
            self._index.update(zip(fresh, range(at, at + len(fresh))))
            self._scores = np.concatenate([self._scores, log_likelihoods(fresh, self.vocab, self.prob)])

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        """(language, score) of each text: the most likely one and its posterior under even odds.

        Ties go to the first language in order. ``und`` and 0 for a text that is null or has no
        letter, and where no language was learned.
        """
        langs, scores = [], []
        lo = 0
        while lo < len(texts):
            # As many texts as make a few million characters, so that unseen words go together.
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") < BLOCK):
                size += len(texts[hi] or "")
                hi += 1
            split = [words_of(t) for t in texts[lo:hi]]
            self._learn(set().union(*split))
            place = self._index.__getitem__
            for words in split:
                if not words or not self.languages:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                total = self._scores[np.fromiter(map(place, words), np.int64, len(words))].sum(0)
                best = int(np.argmax(total))
                langs.append(self.languages[best])
                scores.append(float(1.0 / np.exp(np.minimum(total - total[best], 0.0)).sum()))
            lo = hi
        return langs, scores


def train(labelled: DataFrame, pieces: Sequence[str], docs_per_language: int = 400, max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Fit piece probabilities on at most ``docs_per_language`` whole texts of every language.

    ``labelled`` has doc_id, text and lang; rows with a null in any of them are no examples. The
    rows with the smallest hashes of doc_id are taken, whatever their order; of rows that share an id
    and a language the smallest text counts. A language is
    a value of lang; of more than ``max_languages`` those with the most rows are learned, ties by name,
    so that the model has a bounded size. Without examples the model has no languages.
    """
    rows = labelled.select(F.col("doc_id").alias("d"), F.col("lang").cast("string").alias("lang"), "text").where(
        "d is not null and lang is not null and text is not null"
    )
    order = Window.partitionBy("lang").orderBy("h", "d")
    keyed = rows.select("d", "lang", F.xxhash64(F.lit(11), "d").alias("h"))
    # Hashes spread evenly, so four times the share that is needed holds all that can be chosen; with
    # fewer rows than that, all stay. Without this a task would rank what every partition sends it.
    counts = keyed.groupBy("lang").agg(F.count(F.lit(1)).alias("all")).orderBy(F.desc("all"), "lang").limit(max_languages)
    share = (F.col("h") / 2.0**64 + 0.5) * F.col("all") < 4 * docs_per_language
    keyed = keyed.join(F.broadcast(counts), "lang").where(share).drop("all")
    chosen = keyed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs_per_language)
    chosen = chosen.groupBy("d", "lang").agg(F.count(F.lit(1)).alias("n")).drop("n")

    def count(batches):
        for batch in batches:
            tally: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                tally.setdefault(lang, Counter()).update(words_of(text))
            flat = [(lang, w, n) for lang, c in tally.items() for w, n in c.items()]
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([f[0] for f in flat], pa.string()),
                    "word": pa.array([f[1] for f in flat], pa.string()),
                    "n": pa.array([f[2] for f in flat], pa.int64()),
                }
            )

    sample = rows.join(F.broadcast(chosen), ["d", "lang"]).groupBy("d", "lang").agg(F.min("text").alias("text")).select("lang", "text")
    words = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in words.toLocalIterator():
        counts.setdefault(lang, {})[word] = n
    vocab = Pieces(pieces)
    languages = sorted(counts)
    prob = [fit_pieces(counts[lang], vocab) for lang in languages]
    return LanguageModel(languages, vocab, np.stack(prob, 1) if prob else np.zeros((len(vocab.pieces) + 1, 0)))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 on division by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, pieces: Sequence[str], docs_per_language: int = 400) -> DataFrame:
    """(doc_id, held_out boolean, lang_pred string, score double), one row per row of ``docs``.

    The model is learned from the
    rows that are not held out; a prediction reads the text only. Null texts and texts without a
    letter are ``und`` with score 0. Copies, ties and order change nothing; an empty table gives no
    rows.
    """
    columns = docs.select("doc_id", "text", "lang")
    model = train(columns.where(~held_out(F.col("doc_id"))), pieces, docs_per_language)
    judged = predict(docs.select("doc_id", "text"), model, "doc_id")
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def predict(docs: DataFrame, model: LanguageModel, kept: str | None = None) -> DataFrame:
    """(row, lang_pred string, score double) of every row: ``row`` is a struct of all columns of ``docs``.

    With ``kept``, the name of a column, that column comes back instead, under its own name, and the
    text does not. Names of ``docs`` can't clash with those of the result. Null texts and texts
    without a letter are ``und`` with score 0; repeated rows stay, and no rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(kept, "text") if kept else docs.select(F.struct("*").alias("row"))
    name = kept or "row"

    def run(batches):
        known = shared.value
        try:
            for batch in batches:
                first = batch.column(0)
                texts = (batch.column(1) if kept else first.field("text")).to_pylist()
                langs, scores = known.predict(texts)
                yield pa.RecordBatch.from_arrays([first, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [name, "lang_pred", "score"])
        finally:
            known.forget()

    schema = T.StructType([rows.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(in_worker("langid", run), schema)
