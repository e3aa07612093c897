"""Language of words and documents by a linear-chain conditional random field.

Every word (a run of letters, lower case) has affix, character n-gram and
lexicon features; label weights and label-to-label transitions are learned
together by maximum likelihood with forward-backward. Training sequences are
spliced from segments of several languages, so the transitions see switches
inside a text. A document's language is the label with the largest mean word
marginal, its score that mean; runs of the words' best labels are the spans of a
code-switched text. How well a text fits the learned languages, however it mixes
them, is another mean over its words: the largest marginal times the share of the
word's features that training saw.

Training is bounded: about ``SAMPLE_DOCS`` distinct labelled texts a language (all,
if there are no more), chosen by their hash, one segment of ``SEGMENT_WORDS`` words
from each, without words of more than ``LONGEST_LEARNED`` letters; the lexicon is
that of the sample. Prediction reads every text whole, in slices of
bounded size. Within a slice the chain is cut into blocks of ``BLOCK`` words
whose transfer matrices are composed, so a very long text is as quick as many
short ones and exact.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if nothing is labelled. Ties go to the label that sorts first.
Repeated rows are treated alike, and ids play no part in learning.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import kept_columns, ref, schema_of, text_slices, with_arrays

UNKNOWN = "und"
SAMPLE_DOCS, SEGMENT_WORDS, LONGEST_LEARNED = 500, 64, 64
_DRAWS = 1 << 40
SEQUENCE_WORDS, BUCKETS, STEPS, BLOCK = 48, 1 << 17, 50, 64
MAX_WORDS_CACHED = 300_000

_LETTERS = re.compile(r"[^\W\d_]+")
RUN = T.StructType([T.StructField("lang", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])


def words_of(text: str | None) -> list[str]:
    """Words that have a letter; numerals such as superscripts alone are none."""
    if not text:
        return []
    found = _LETTERS.findall(text.lower())
    return found if text.isascii() else [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' features, and the number of the word each belongs to.

    The word itself (lexicon), affixes of 1 to 4 letters, and 2- and 3-grams with
    the word's borders; all words' code points are hashed in one go.
    """
    codes = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words])
    word = np.repeat(np.arange(len(words)), sizes + 2)
    first = np.cumsum(sizes + 2) - sizes - 1  # of the letters, after the border
    last = first + sizes - 1
    out, owners = [], []

    def add(kind: int, columns: list[np.ndarray], owner: np.ndarray) -> None:
        total = np.full(len(owner), kind, np.uint64)
        for column in columns:
            total = (total ^ column) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
        out.append((total % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner)

    everyone = np.arange(len(words))
    none = np.uint64(0)
    for n in range(1, 5):
        add(n, [np.where(i < sizes, codes[np.minimum(first + i, last)], none) for i in range(n)], everyone)
        add(4 + n, [np.where(i < sizes, codes[np.maximum(last - i, first)], none) for i in range(n)], everyone)
    for n in (2, 3):
        inside = np.flatnonzero(word[: len(word) - n + 1] == word[n - 1 :])
        add(8 + n, [codes[inside + i] for i in range(n)], word[inside])
    place = np.arange(len(codes)) - first[word]
    letters = (codes + (place + 2).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) * np.uint64(0x94D049BB133111EB)
    letters ^= letters >> np.uint64(31)
    add(20, [np.add.reduceat(letters, first - 1)], everyone)
    return np.concatenate(out), np.concatenate(owners)


def _emissions(weights: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Scores (words x labels), and the share of each word's features that have weights."""
    ids, owner = features(words)
    found = weights[ids]
    scores = np.stack([np.bincount(owner, found[:, j], len(words)) for j in range(weights.shape[1])], axis=1)
    return scores, np.bincount(owner, found.any(axis=1), len(words)) / np.bincount(owner, minlength=len(words))


def marginals(potentials: np.ndarray, bounds: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Word marginals by forward-backward.

    ``potentials`` (words x labels, positive) of all texts in a row, ``bounds``
    the offsets of the texts, ``transition`` the positive label-to-label matrix;
    before the first word every label is as likely.
    """
    n, labels = potentials.shape
    lengths = np.diff(bounds)
    blocks = -(-lengths // BLOCK)
    text = np.repeat(np.arange(len(lengths)), blocks)
    rank = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = bounds[text] + rank * BLOCK
    size = np.minimum(bounds[text + 1] - start, BLOCK)
    order = np.argsort(-size, kind="stable")
    start, size, rank, text = start[order], size[order], rank[order], text[order]
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(BLOCK)]  # blocks longer than t
    transfer = np.broadcast_to(np.eye(labels), (len(start), labels, labels)).copy()
    for t in range(BLOCK):
        if k := active[t]:
            step = (transfer[:k] @ transition) * potentials[start[:k] + t][:, None, :]
            transfer[:k] = step / step.max(axis=(1, 2), keepdims=True)
    # compose over the blocks of a text: what enters each block from the left and from the right
    by_rank = np.argsort(rank, kind="stable")
    cuts = np.searchsorted(rank[by_rank], np.arange(rank.max() + 2 if len(rank) else 1))
    left, right = np.ones((len(start), labels)), np.ones((len(start), labels))
    run = np.ones((len(lengths), labels))
    for a, b in zip(cuts[:-1], cuts[1:]):
        at = by_rank[a:b]
        left[at] = run[text[at]]
        out = np.einsum("bi,bij->bj", left[at], transfer[at])
        run[text[at]] = out / out.sum(axis=1, keepdims=True)
    run = np.ones((len(lengths), labels))
    for a, b in zip(cuts[-2::-1], cuts[:0:-1]):
        at = by_rank[a:b]
        right[at] = run[text[at]]
        out = np.einsum("bij,bj->bi", transfer[at], right[at])
        run[text[at]] = out / out.sum(axis=1, keepdims=True)
    forward, backward = np.empty((n, labels)), np.empty((n, labels))
    state = left
    for t in range(BLOCK):
        if k := active[t]:
            step = (state[:k] @ transition) * potentials[start[:k] + t]
            state[:k] = forward[start[:k] + t] = step / step.sum(axis=1, keepdims=True)
    state, back = right, transition.T
    for t in range(BLOCK - 1, -1, -1):
        if k := active[t]:
            at = start[:k] + t
            backward[at] = state[:k]
            step = (state[:k] * potentials[at]) @ back
            state[:k] = step / step.sum(axis=1, keepdims=True)
    joint = forward * backward
    return joint / joint.sum(axis=1, keepdims=True)


class LanguageModel:
    """Labels, feature weights (buckets x labels) and transitions (labels x labels, logarithms)."""

    def __init__(self, labels: list[str], weights: np.ndarray, transition: np.ndarray):
        self.labels, self.weights, self.transition = labels, weights, transition

    @classmethod
    def fit(cls, segments: list[tuple[str, list[str]]], steps: int = STEPS, seed: int = 7) -> LanguageModel:
        """Adam on the penalised log likelihood of sequences spliced from labelled segments."""
        labels = sorted({lang for lang, words in segments if words})
        if not labels:
            return cls([], np.zeros((1, 0), np.float32), np.zeros((0, 0)))
        rng, count = np.random.default_rng(seed), len(labels)
        vocabulary: dict[str, int] = {}
        pieces = []
        for lang, words in segments:
            at = 0
            while at < len(words):
                take = int(rng.integers(6, 33))
                pieces.append((labels.index(lang), [vocabulary.setdefault(w, len(vocabulary)) for w in words[at : at + take]]))
                at += take
        order = rng.permutation(len(pieces))
        tokens = np.fromiter(chain.from_iterable(pieces[i][1] for i in order), np.int64)
        gold = np.repeat([pieces[i][0] for i in order], [len(pieces[i][1]) for i in order])
        bounds = np.unique(np.append(np.arange(0, len(tokens), SEQUENCE_WORDS), len(tokens)))
        ids, word = features(list(vocabulary))
        used, ids = np.unique(ids, return_inverse=True)
        params = [np.zeros((len(used), count)), np.zeros((count, count))]
        first = np.zeros(len(tokens), bool)
        first[bounds[:-1]] = True
        pairs = np.zeros((count, count))
        np.add.at(pairs, (gold[:-1][~first[1:]], gold[1:][~first[1:]]), 1)
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
        for step in range(1, steps + 1):
            scores = np.stack([np.bincount(word, params[0][ids, j], len(vocabulary)) for j in range(count)], axis=1)[tokens]
            potentials = np.exp(scores - scores.max(axis=1, keepdims=True))
            matrix = np.exp(params[1])
            post = marginals(potentials, bounds, matrix)
            miss = -post
            miss[np.arange(len(tokens)), gold] += 1
            by_word = np.stack([np.bincount(tokens, miss[:, j], len(vocabulary)) for j in range(count)], axis=1)
            grads = [np.stack([np.bincount(ids, by_word[word, j], len(used)) for j in range(count)], axis=1) - 0.1 * params[0]]
            grads.append(pairs - _pair_marginals(potentials, bounds, matrix) - 0.1 * params[1])
            for p, g, m in zip(params, grads, moments):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.99 * m[1] + 0.01 * g * g
                p += 0.1 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
        weights = np.zeros((BUCKETS, count), np.float32)
        weights[used] = params[0]
        return cls(labels, weights, params[1])


def _pair_marginals(potentials: np.ndarray, bounds: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Expected label-to-label counts of equally short sequences (training only; the last may be shorter)."""
    total = np.zeros_like(matrix)
    lengths = np.diff(bounds)
    for length in np.unique(lengths):
        at = bounds[:-1][lengths == length]
        alphas = [np.ones((len(at), matrix.shape[0]))]
        for t in range(length):
            step = (alphas[-1] @ matrix) * potentials[at + t]
            alphas.append(step / step.sum(axis=1, keepdims=True))
        beta = np.ones((len(at), matrix.shape[0]))
        for t in range(length - 1, 0, -1):
            right = beta * potentials[at + t]
            joint = alphas[t][:, :, None] * matrix * right[:, None, :]
            total += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            beta = right @ matrix.T
            beta /= beta.sum(axis=1, keepdims=True)
    return total


class _Predictor:
    """Scores of one task, with a bounded table of the words seen."""

    def __init__(self, model: LanguageModel):
        self.model, self.matrix = model, np.exp(model.transition)
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.empty((1 << 14, len(self.model.labels) + 1))  # potentials, and the share of seen features

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals and shares of seen features of all words in a row, and the offsets of the texts."""
        words = [words_of(t) for t in texts]
        distinct = set(chain.from_iterable(words))
        if len(self.rows) + len(distinct) > MAX_WORDS_CACHED:
            self._clear()
        if new := [w for w in distinct if w not in self.rows]:
            n = len(self.rows)
            while len(self.table) < n + len(new):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            scores, seen = _emissions(self.model.weights, new)
            self.table[n : n + len(new), :-1] = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
            self.table[n : n + len(new), -1] = seen
            self.rows.update(zip(new, range(n, n + len(new))))
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        rows = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(words)), np.int64)
        return marginals(self.table[rows, :-1], bounds, self.matrix), self.table[rows, -1], bounds


def learn(df: DataFrame, trusted: Column | None = None, *, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, segment_words: int = SEGMENT_WORDS) -> LanguageModel:
    """Fit on labelled rows (``trusted`` narrows them). One row a language and one bounded segment a sampled document reach the driver."""
    rows = df.where(ref(lang_col).isNotNull() & ref(text_col).isNotNull())
    rows = rows.where(trusted) if trusted is not None else rows
    # Texts are drawn, not rows: whatever the ids, a text counts once a language, and a language with few texts has them all drawn.
    dice = F.xxhash64(ref(text_col), F.lit(11))
    counts = {r[0]: r[1] for r in rows.groupBy(ref(lang_col)).agg(F.count_distinct(dice)).collect()}
    if not counts:
        return LanguageModel.fit([])
    share = F.create_map(*chain.from_iterable((F.lit(k), F.lit(int(min(1.0, sample_docs / n) * _DRAWS) + 1)) for k, n in sorted(counts.items())))
    sample = rows.where(F.pmod(dice, F.lit(_DRAWS)) < share[ref(lang_col)]).select(ref(lang_col).alias("lang"), dice.alias("dice"), ref(text_col).alias("_tl_text")).dropDuplicates(["lang", "dice"])
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))])

    def segments(batches):
        for batch, texts in text_slices(batches, "_tl_text"):
            out = []
            for text, dice in zip(texts, batch.column(1).to_pylist()):
                words = words_of(text)
                at = (dice >> 40) % max(1, len(words) - segment_words + 1)
                out.append([w for w in words[at : at + segment_words] if len(w) <= LONGEST_LEARNED])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["lang", "words"])

    found = sorted((r["lang"], r["words"]) for r in sample.mapInArrow(segments, schema).collect())
    return LanguageModel.fit(found)


def predict(df: DataFrame, model: LanguageModel, *, text_col: str = "text", keep=("doc_id",), lang_out: str = "lang_pred", score_out: str = "score", words_out: str = "n_words", runs_out: str | None = None, fit_out: str | None = None) -> DataFrame:
    """``keep`` columns, the language, its score and the number of words; with ``runs_out`` also the runs of equally labelled words, with ``fit_out`` how well the text fits the languages."""
    new = [(lang_out, T.StringType()), (score_out, T.DoubleType()), (words_out, T.LongType())] + ([(runs_out, T.ArrayType(RUN))] if runs_out else []) + ([(fit_out, T.DoubleType())] if fit_out else [])
    keep = kept_columns(df, keep, [n for n, _ in new])
    schema = schema_of(df, keep, new)
    columns = [ref(c) for c in keep] + [ref(text_col).alias("_tl_text")]
    run_type = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))

    def run(batches):
        predictor, labels = _Predictor(model), model.labels
        for batch, texts in text_slices(batches, "_tl_text"):
            if labels:
                post, seen, bounds = predictor(texts)
            else:
                post, seen, bounds = np.zeros((0, 0)), np.zeros(0), np.zeros(len(texts) + 1, np.int64)
            langs, scores, runs, fits = [], [], [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if a == b:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    runs.append([])
                    fits.append(0.0)
                    continue
                mean = post[a:b].mean(axis=0)
                best = int(np.argmax(mean))
                langs.append(labels[best])
                scores.append(round(min(1.0, float(mean[best])), 6))
                if fit_out:
                    fits.append(round(min(1.0, float(post[a:b].max(axis=1) @ seen[a:b]) / (b - a)), 6))
                if runs_out:
                    best = post[a:b].argmax(axis=1)
                    cuts = np.flatnonzero(np.diff(best)) + 1
                    at = [0, *cuts.tolist(), b - a]
                    runs.append([{"lang": labels[best[x]], "first_word": x, "n_words": y - x} for x, y in zip(at[:-1], at[1:])])
            arrays = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(np.diff(bounds), pa.int64())]
            arrays += ([pa.array(runs, run_type)] if runs_out else []) + ([pa.array(fits, pa.float64())] if fit_out else [])
            yield with_arrays(batch, keep, schema, arrays)

    return df.select(*columns).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that learning never sees: CRC-32 of the id's text leaves 1 when divided by 3 (a null id is in no fold)."""
    return F.coalesce(F.crc32(ref(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
