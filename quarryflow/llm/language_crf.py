"""Operator 4: language identification by a linear-chain conditional random field over words.

Every word of a line gets a language label. Emission scores are sums of learned weights of hashed features (the word
itself as a lexicon entry, prefixes and suffixes, character bigrams and trigrams); transition scores are learned
too, so a switch of language inside a line has a price. Marginals come from forward-backward. A document's language is
the label of the largest mean marginal over all its words, and that mean is its score.

Lines are the chains. They are processed side by side, longest first; a line of more than BLOCK words is cut into
blocks whose transfer matrices carry the exact forward and backward messages across, so very long lines cost no more
steps than short ones.

Training fits weights and transitions by gradient ascent on the conditional likelihood. It uses a documented bounded
sample of labelled rows (`per_lang` documents a language, chosen by a hash of the id over all rows, and `words_per_lang`
of their words, in pieces of PIECE words chosen by a hash from all over their lines before anything is collected), with
chains joined from pieces of several languages so that transitions see switches. Every label there is gets learned; more
than `most_langs` of them raise an error, since the model grows with their number. Prediction covers every word of every
text.

Defined results: null text and text without a letter give `und` and score 0; without any labelled row every text does;
ties go to the label that sorts first; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import random
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, held, map_rows

UNKNOWN = "und"
WHITE = r"[\x20\x09-\x0D]+"
FEATURE_BITS = 17
BLOCK = 128
#: Words of a training piece.
PIECE = 24
#: Words whose chains are held at once.
BATCH_WORDS = 40_000


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 5, np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Row of a feature that a short word lacks; its weight stays 0.
NONE = 1 << FEATURE_BITS


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * _MIX
    return ((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of lower-case words between marks: bigrams and where each word's begin, trigrams and where each
    word's begin, and for each word its lexicon entry, prefix and two suffixes. Grams are of UTF-8 bytes."""
    raw = np.frombuffer(b"^" + b"$^".join(words) + b"$", np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.cumsum(size) - size
    place = np.arange(len(raw)) - np.repeat(first, size)
    left = np.repeat(size, size) - place
    b = np.concatenate([_BYTE[raw], np.zeros(4, np.uint64)])
    gram = [b[i : i + len(raw)] * _PLACE[i] for i in range(5)]
    two = gram[0] ^ gram[1]
    three = two ^ gram[2]
    four = three ^ gram[3]
    last = first + size
    powers = np.cumprod(np.full(int(size.max()) + 1, _MIX))
    whole = np.add.reduceat(b[: len(raw)] * powers[place], first)
    ends = [np.where(size >= 4, _slot(four[first], 4), NONE), np.where(size >= 4, _slot(four[np.maximum(last - 4, 0)], 5), NONE), np.where(size >= 5, _slot((four ^ gram[4])[np.maximum(last - 5, 0)], 6), NONE)]
    return _slot(two[left >= 2], 2), first - np.arange(len(words)), _slot(three[left >= 3], 3), first - 2 * np.arange(len(words)), np.stack([_slot(whole, 1), *ends], axis=1)


def letters(word: str) -> bool:
    """A word that is labelled: it has an ASCII letter or any other character that is not ASCII."""
    return not word.isascii() or any(map(str.isalpha, word))


@dataclass
class Model:
    langs: list[str]
    emission: np.ndarray  # (features and the row NONE, languages), float32
    transition: np.ndarray  # (languages, languages) log potentials

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores of lower-case words."""
        two, at_two, three, at_three, own = features([w.encode() for w in words])
        w = self.emission
        return np.add.reduceat(w[two], at_two, axis=0) + np.add.reduceat(w[three], at_three, axis=0) + w[own].sum(axis=1)


def _lockstep(start: np.ndarray, end: np.ndarray, lengths: np.ndarray, at: np.ndarray, e: np.ndarray, step: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Normalized products of forward and backward messages for chains of bounded length, sorted longest first. pairs:
    gets the expected transitions within the chains added.
    start: forward message before the first word (already through the transition); end: backward message after the last."""
    forward, gamma = np.empty_like(e), np.empty_like(e)
    now, steps = start.copy(), int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    for t in range(steps):
        m, rows = active[t], at[: active[t]] + t
        x = (now[:m] @ step if t else now[:m]) * e[rows]
        x /= x.sum(axis=1, keepdims=True)
        forward[rows] = now[:m] = x
    back = end.copy()
    for t in range(steps - 1, -1, -1):
        m, rows = active[t], at[: active[t]] + t
        x = back[:m]
        y = forward[rows] * x
        gamma[rows] = y / y.sum(axis=1, keepdims=True)
        x = x * e[rows]
        if pairs is not None and t:
            both = forward[rows - 1][:, :, None] * step * x[:, None, :]
            pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        x = x @ step.T
        back[:m] = x / x.sum(axis=1, keepdims=True)
    return gamma


def marginals(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Label marginals of every word. scores: emission scores of the chains' words one after another. pairs: gets the
    expected transitions added, where no chain is longer than BLOCK."""
    n_labels = scores.shape[1]
    e = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    step = np.exp(transition - transition.max())
    lengths = lengths[lengths > 0]
    first = np.concatenate(([0], np.cumsum(lengths[:-1]))).astype(np.int64)
    blocks = -(-lengths // BLOCK)
    chain = np.repeat(np.arange(len(lengths)), blocks)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = first[chain] + nth * BLOCK
    size = np.minimum(BLOCK, lengths[chain] - nth * BLOCK)
    start, end = np.ones((len(chain), n_labels)), np.ones((len(chain), n_labels))
    long = np.flatnonzero(blocks[chain] > 1)
    if len(long):
        order = long[np.argsort(-size[long], kind="stable")]
        sizes, matrix = size[order], np.broadcast_to(np.eye(n_labels), (len(order), n_labels, n_labels)).copy()
        for t in range(int(sizes[0])):
            m = int(np.searchsorted(-sizes, -t, side="left"))
            x = (matrix[:m] @ step) * e[at[order[:m]] + t][:, None, :]
            matrix[:m] = x / x.sum(axis=(1, 2), keepdims=True)
        across = dict(zip(order.tolist(), matrix))
        for c in np.unique(chain[long]):
            own = np.flatnonzero(chain == c) if len(lengths) < 64 else np.arange(np.searchsorted(chain, c), np.searchsorted(chain, c, side="right"))
            message = np.ones(n_labels)
            for k, b in enumerate(own.tolist()):
                if k:
                    start[b] = message @ step
                    message = message @ across[b]
                else:  # the first word has no transition before it
                    inner = np.ones(n_labels)
                    for t in range(size[b]):
                        inner = (inner @ step if t else inner) * e[at[b] + t]
                        inner /= inner.sum()
                    message = inner
                message = message / message.sum()
            message = np.ones(n_labels)
            for b in own[::-1].tolist():
                end[b] = message
                message = across[b] @ message
                message = message / message.sum()
    order = np.argsort(-size, kind="stable")
    return _lockstep(start[order], end[order], size[order], at[order], e, step, pairs)


class _Index(dict):
    """Numbers words in the order in which they are first asked for. Nothing in it refers to itself, so it goes with its
    last use; in a cycle, the words of many batches would wait for the garbage collector, which strings do not wake."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Labeller:
    def __init__(self, model: Model):
        self.model = model

    def chains(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of all words that are labelled, the chains' lengths, the chains' texts."""
        index, ids, lengths, owner = _Index(), [], [], []
        for k, text in enumerate(texts):
            for line in text.lower().split("\n"):
                if words := line.split():
                    ids += map(index.__getitem__, words)
                    lengths.append(len(words))
                    owner.append(k)
        if not ids:
            return np.zeros((0, len(self.model.langs))), np.zeros(0, np.int64), np.zeros(0, np.int64)
        has = np.fromiter(map(letters, index), bool, len(index))
        table, words = self.model.scores(list(index)), np.array(ids, np.int64)
        keep, lengths = has[words], np.array(lengths, np.int64)
        return table[words[keep]].astype(np.float64), np.add.reduceat(keep.astype(np.int64), np.cumsum(lengths) - lengths), np.array(owner, np.int64)

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and the mean marginal of it."""
        langs, out, held, size = self.model.langs, [], [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1]) // 6
            if size >= BATCH_WORDS:
                out += self._means(held)
                held, size = [], 0
        out += self._means(held)
        out = [m if m is not None and any(map(str.isalpha, t or "")) else None for m, t in zip(out, texts)]
        pred = [UNKNOWN if m is None else langs[int(np.argmax(m))] for m in out]
        return pred, [0.0 if m is None else float(min(1.0, m.max())) for m in out]

    def _means(self, texts: list[str]) -> list[np.ndarray | None]:
        if not self.model.langs:
            return [None] * len(texts)
        scores, lengths, owner = self.chains(texts)
        if not len(scores):
            return [None] * len(texts)
        g = marginals(scores, lengths, self.model.transition)
        of = np.repeat(owner, lengths)
        n = np.bincount(of, minlength=len(texts))
        sums = np.stack([np.bincount(of, g[:, j], len(texts)) for j in range(g.shape[1])], axis=1)
        return [sums[k] / n[k] if n[k] else None for k in range(len(texts))]

    def label_words(self, text: str) -> list[tuple[str, str, float]]:
        """Word, language, marginal for each word with a letter of a text, code-switched or not."""
        words = [w for line in text.split("\n") for w in line.split() if letters(w)]
        scores, lengths, _ = self.chains([text])
        if not len(scores):
            return []
        g = marginals(scores, lengths, self.model.transition)
        return [(w, self.model.langs[int(p.argmax())], float(p.max())) for w, p in zip(words, g)]


def fit(rows: list[tuple[str, str]], words_per_lang: int = 30_000, rounds: int = 14, seed: int = 7) -> Model:
    """Maximum conditional likelihood with a small L2 penalty, by full-gradient AdaGrad. rows: (text, language)."""
    rnd = random.Random(seed)
    by: dict[str, list[list[str]]] = {}
    for text, lang in sorted(rows):
        by.setdefault(lang, []).extend(w for line in text.lower().split("\n") if (w := [x for x in line.split() if letters(x)]))
    langs, pieces = sorted(by), []
    for k, lang in enumerate(langs):
        rnd.shuffle(by[lang])
        left = words_per_lang
        for line in by[lang]:
            for i in range(0, len(line), PIECE):
                if left > 0:
                    pieces.append([(w, k) for w in line[i : i + PIECE]])
                    left -= len(pieces[-1])
    rnd.shuffle(pieces)
    chains, i = [], 0
    while i < len(pieces):  # a third of the chains switch between pieces of any languages
        n = rnd.choice((1, 1, 3))
        chains.append([x for p in pieces[i : i + n] for x in p])
        i += n
    n = len(langs)
    model = Model(langs, np.zeros((NONE + 1, n), np.float32), np.zeros((n, n)))
    if n < 2 or not chains:
        return model
    index = _Index()
    ids = np.array([index[w] for c in chains for w, _ in c])
    gold = np.array([k for c in chains for _, k in c])
    lengths = np.array([len(c) for c in chains])
    two, at_two, three, at_three, own = features([w.encode() for w in index])
    each = np.arange(len(index))
    flat = np.concatenate([two, three, own.ravel()])
    of = np.concatenate([np.repeat(each, np.diff([*at_two, len(two)])), np.repeat(each, np.diff([*at_three, len(three)])), np.repeat(each, own.shape[1])])
    of, flat = of[flat != NONE], flat[flat != NONE]
    used, slot = np.unique(flat, return_inverse=True)
    weights, seen = np.zeros((len(used), n)), np.full((len(used), n), 1e-8)
    step, seen_step = np.zeros((n, n)), np.full((n, n), 1e-8)
    inner = np.ones(len(ids), bool)
    inner[np.cumsum(lengths) - lengths] = False
    follow, counted = np.flatnonzero(inner), np.zeros((n, n))
    np.add.at(counted, (gold[follow - 1], gold[follow]), 1)
    for _ in range(rounds):
        model.emission[used], expected = weights, np.zeros((n, n))
        g = marginals(model.scores(list(index))[ids].astype(np.float64), lengths, step, expected)
        error = -g
        error[np.arange(len(ids)), gold] += 1
        per_word = [np.bincount(ids, error[:, j], len(index)) for j in range(n)]
        grad = np.stack([np.bincount(slot, w[of], len(used)) for w in per_word], axis=1) - 0.02 * weights
        for w, s, d in ((weights, seen, grad), (step, seen_step, counted - expected - 0.02 * step)):
            s += d * d
            w += 0.35 * d / np.sqrt(s)
    model.emission[used], model.transition = weights, step
    return model


def training_rows(df: DataFrame, id_col: str, text_col: str, lang_col: str, allowed: Column, per_lang: int, words_per_lang: int, most_langs: int) -> list[tuple[str, str]]:
    """Pieces (words, language) of about per_lang documents a language, by a hash of the id: a language's share is set by
    its count over all rows. Of their pieces, those of the least hashes, with about words_per_lang words."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(allowed)
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull())
    counts = rows.groupBy("lang").count().limit(most_langs + 1).collect()
    if len(counts) > most_langs:
        raise ValueError(f"more than {most_langs} languages to learn")
    if not counts:
        return []
    share = df.sparkSession.createDataFrame([(r["lang"], int(min(1.0, 1.25 * per_lang / r["count"]) * (1 << 30))) for r in counts], "lang string, below long")
    h = lambda *of: F.pmod(F.xxhash64(F.lit("language sample"), *of), F.lit(1 << 30))
    sample = rows.join(F.broadcast(share), "lang").where(h(F.col("id").cast("string")) < F.col("below"))
    lines = sample.select("id", "lang", F.posexplode(F.split("text", "\n")).alias("nth", "line")).withColumn("words", F.filter(F.split("line", WHITE), lambda w: w != ""))
    cut = lambda i: F.array_join(F.slice("words", i + 1, PIECE), " ")
    pieces = lines.where(F.size("words") > 0).select("id", "lang", "nth", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("words") - 1, F.lit(PIECE)), cut)).alias("at", "piece"))
    order = Window.partitionBy("lang").orderBy("h", "piece").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.size(F.split("piece", " "))).over(order), F.lit(0))
    chosen = pieces.select("lang", "piece", h(F.col("id").cast("string"), F.col("nth"), F.col("at")).alias("h")).withColumn("before", before)
    return [(r["piece"], r["lang"]) for r in chosen.where(F.col("before") < words_per_lang).select("piece", "lang").collect()]


def identify(df: DataFrame, train: DataFrame | None = None, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 250, words_per_lang: int = 30_000, most_langs: int = 1024, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns in `keep`, lang_pred, score of every row. train: labelled rows (df by default), of which only
    those where `allowed` holds are learned from."""
    import pickle
    import uuid

    spark = df.sparkSession
    rows = training_rows(df if train is None else train, id_col, text_col, lang_col, F.lit(True) if allowed is None else allowed, per_lang, words_per_lang, most_langs)
    name, model = uuid.uuid4().hex, spark.sparkContext.broadcast(pickle.dumps(fit(rows, words_per_lang)))
    arrow_limits(spark, 512, 1)  # a word of a batch takes some hundred bytes while it is labelled

    def run(c: dict[str, list]) -> dict[str, list]:
        labeller = held(("crf", name), lambda: Labeller(pickle.loads(model.value)))
        pred, score = labeller.label(c.pop("__text"))
        return c | {"lang_pred": pred, "score": score}

    carried = df.select(id_col, *keep)
    schema = pa.schema([*_arrow_fields(carried), ("lang_pred", pa.string()), ("score", pa.float64())])
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema)
    return map_rows(df.select(id_col, *keep, df[text_col].alias("__text")), run, f"{names}, lang_pred string, score double", schema)


def _arrow_fields(df: DataFrame) -> list[tuple[str, pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [(f.name, to_arrow_type(f.dataType)) for f in df.schema]


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
