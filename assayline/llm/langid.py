"""Language identification by unigram pieces, with all segmentations of a word summed."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm.common import put, small_batches, table, unit

VOCABULARY = "piece_bpe_32k.model"
#: Up to this many characters a word's sums are plain numbers, many words at a time; for a longer one they are logarithms.
SHORT = 36
#: Bounds in bytes, whatever the number of languages: sums of a block of words, and the sums of words that a worker keeps.
BLOCK_BYTES, KEPT_BYTES = 24 << 20, 24 << 20
#: Probability of a character that is no piece, the same in every language.
UNKNOWN = 1e-8
_LETTERS = re.compile(r"[^\W\d_]+")
_B = np.uint64(0xD1342543DE82EF95)


def read_pieces(path: str) -> list[str]:
    """The vocabulary's pieces in lower case, but for control and byte pieces and those that hold anything but letters, which no word does; `▁` marks the start of a word."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p for p in found if p == "▁" or _LETTERS.fullmatch(p.removeprefix("▁"))})


def words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


class Lattice:
    """Sums over segmentations for many words at a time: words of one length are rows of an array."""

    def __init__(self, pieces: list[str]) -> None:
        self.n = len(pieces)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in sorted({len(p) for p in pieces}):
            ids = [i for i, p in enumerate(pieces) if len(p) == k]
            h = self._hashes(np.array([[ord(c) for c in pieces[i]] for i in ids], np.uint64))[:, k]
            order = np.argsort(h)
            self.by_length[k] = h[order], np.array(ids)[order]
        self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(self.by_length, default=0), _B)]), dtype=np.uint64)

    @staticmethod
    def _hashes(chars: np.ndarray) -> np.ndarray:
        h = np.zeros((len(chars), chars.shape[1] + 1), np.uint64)
        for i in range(chars.shape[1]):
            h[:, i + 1] = h[:, i] * _B + (chars[:, i] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return h

    def edges(self, found: list[str]) -> tuple[int, list[list[tuple[int, np.ndarray, np.ndarray]]]]:
        """For words of one length: its length, and for each end the pieces that end there: (start, rows, piece ids)."""
        m = len(found[0])
        h = self._hashes(np.array(found).view(np.uint32).reshape(len(found), m).astype(np.uint64))
        out = []
        for end in range(1, m + 1):
            here = []
            for k, (known, ids) in self.by_length.items():
                if k <= end:
                    want = h[:, end] - h[:, end - k] * self.power[k]
                    at = np.minimum(np.searchsorted(known, want), len(known) - 1)
                    rows = np.flatnonzero(known[at] == want)
                    if len(rows):
                        here.append((end - k, rows, ids[at[rows]]))
            out.append(here)
        return m, out

    def forward(self, m: int, edges: list, n: int, p: np.ndarray) -> np.ndarray:
        """alpha[i, row, language]: probability of the first i characters, over all their segmentations."""
        alpha = np.zeros((m + 1, n, p.shape[1]))
        alpha[0] = 1
        for end in range(1, m + 1):
            alpha[end] = alpha[end - 1] * UNKNOWN
            for start, rows, ids in edges[end - 1]:
                alpha[end, rows] += alpha[start, rows] * p[ids]
        return alpha

    def log_scores(self, found: list[str], p: np.ndarray) -> np.ndarray:
        """Per word and language the log probability, summed over segmentations."""
        out = np.zeros((len(found), p.shape[1]))
        order = sorted(range(len(found)), key=lambda i: len(found[i]))
        lo = 0
        while lo < len(order):
            hi, size = lo + 1, len(found[order[lo]])
            if size >= SHORT:
                out[order[lo]] = self._long_sums("▁" + found[order[lo]], np.log(p), False)[0][-1]
            else:
                most = min(20_000, max(1, BLOCK_BYTES // (8 * (size + 2) * p.shape[1])))
                while hi < len(order) and len(found[order[hi]]) == size and hi - lo < most:
                    hi += 1
                part = ["▁" + found[i] for i in order[lo:hi]]
                m, edges = self.edges(part)
                out[order[lo:hi]] = np.log(self.forward(m, edges, len(part), p)[m])
            lo = hi
        return out

    def _long_sums(self, word: str, log_p: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
        """Logarithms of the forward and, if wanted, backward sums of one word, and for each end the (start, piece) of pieces that end there."""
        m = len(word)
        h = self._hashes(np.array([[ord(c) for c in word]], np.uint64))[0]
        edges: list[list[tuple[int, int]]] = [[] for _ in range(m + 1)]
        for k, (known, ids) in self.by_length.items():
            if k <= m:
                want = h[k:] - h[:-k] * self.power[k]
                at = np.minimum(np.searchsorted(known, want), len(known) - 1)
                for start in np.flatnonzero(known[at] == want).tolist():
                    edges[start + k].append((start, int(ids[at[start]])))
        unknown = np.log(UNKNOWN)
        alpha = np.zeros((m + 1, log_p.shape[1]))
        for end in range(1, m + 1):
            alpha[end] = alpha[end - 1] + unknown
            for start, i in edges[end]:
                alpha[end] = np.logaddexp(alpha[end], alpha[start] + log_p[i])
        beta = np.full_like(alpha, -np.inf)
        beta[m] = 0
        for end in range(m if back else 0, 0, -1):
            beta[end - 1] = np.logaddexp(beta[end - 1], beta[end] + unknown)
            for start, i in edges[end]:
                beta[start] = np.logaddexp(beta[start], beta[end] + log_p[i])
        return alpha, beta, edges

    def expected_long(self, word: str, weight: np.ndarray, p: np.ndarray) -> np.ndarray:
        """As `expected`, for one word of any length; weight: by language."""
        log_p, counts = np.log(p), np.zeros((self.n, p.shape[1]))
        alpha, beta, edges = self._long_sums(word, log_p, True)
        for end, here in enumerate(edges):
            for start, i in here:
                counts[i] += weight * np.exp(alpha[start] + log_p[i] + beta[end] - alpha[-1])
        return counts

    def expected(self, part: list[str], weight: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected piece counts per language (forward and backward sums) for words of one length; weight: rows by languages."""
        m, edges = self.edges(part)
        alpha = self.forward(m, edges, len(part), p)
        scale = weight / alpha[m]
        beta = np.zeros_like(alpha)
        beta[m] = 1
        counts = np.zeros((self.n, p.shape[1]))
        for end in range(m, 0, -1):
            beta[end - 1] += beta[end] * UNKNOWN
            for start, rows, ids in edges[end - 1]:
                step = p[ids] * beta[end, rows]
                beta[start, rows] += step
                got = alpha[start, rows] * step * scale[rows]
                for lang in range(p.shape[1]):
                    counts[:, lang] += np.bincount(ids, got[:, lang], self.n)
        return counts


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def gathered(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Batches put together to about `rows` rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            yield pd.concat(held)
            held, n = [], 0
    if n:
        yield pd.concat(held)


def train(docs: DataFrame, pieces: Broadcast, *, per_lang: int = 2000, rounds: int = 3, smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (pieces by languages), by expectation maximisation on a bounded sample.

    The sample is about per_lang whole documents of each language, by a hash of doc_id, not held out. Its word counts stay
    in a table; a round sums expected piece counts over it, and the driver gets one number per piece and language.
    """
    learn = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    n = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}
    langs = sorted(n)
    size = len(pieces.value)
    if not langs:
        return [], np.zeros((size, 0))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_lang / n[lang]))])
    sample = learn.filter(unit("lang", F.coalesce(F.col("doc_id"), F.lit(-1))) < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(b["lang"], b["text"], strict=True):
                seen.setdefault(lang, Counter()).update("▁" + w for w in words(text))
            yield pd.DataFrame([(lang, w, k) for lang, c in seen.items() for w, k in c.items()], columns=["lang", "word", "k"])

    counted = put(sample.mapInPandas(count, "lang string, word string, k long").groupBy("lang", "word").agg(F.sum("k").alias("k")), "lang-words")
    p = np.full((size, len(langs)), 1.0 / size)
    for _ in range(rounds):

        def step(batches: Iterator[pd.DataFrame], p: np.ndarray = p) -> Iterator[pd.DataFrame]:
            lattice, total = Lattice(pieces.value), np.zeros(p.shape)
            for b in gathered(batches, 100_000):
                for size, g in b.groupby(b["word"].str.len()):
                    if size > SHORT:
                        for lang, word, k in zip(g["lang"], g["word"], g["k"], strict=True):
                            total += lattice.expected_long(word, (np.arange(p.shape[1]) == langs.index(lang)) * float(k), p)
                        continue
                    most = min(4000, max(1, BLOCK_BYTES // (64 * SHORT * p.shape[1])))
                    for lo in range(0, len(g), most):
                        part = g.iloc[lo : lo + most]
                        weight = np.zeros((len(part), p.shape[1]))
                        weight[np.arange(len(part)), [langs.index(x) for x in part["lang"]]] = part["k"]
                        total += lattice.expected(part["word"].tolist(), weight, p)
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "lang": lang, "k": total[piece, lang]})

        got = counted.mapInPandas(step, "piece int, lang int, k double").groupBy("piece", "lang").agg(F.sum("k").alias("k")).toPandas()
        counts = np.zeros(p.shape)
        counts[got["piece"], got["lang"]] = got["k"]
        mean = (counts.sum(1, keepdims=True) + 1.0 / size) / (counts.sum() + 1)
        p = (counts + smooth * size * mean) / (counts.sum(0) + smooth * size)
    return langs, p


def predict(docs: DataFrame, pieces: Broadcast, langs: list[str], p: np.ndarray, keep: int = 400_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score: the language with the largest likelihood of the whole text, and its posterior under equal priors; ties to the first by code point."""
    model = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice, p = Lattice(pieces.value), model.value
        most = max(1, min(keep, KEPT_BYTES // (8 * max(1, p.shape[1]))))
        known: dict[str, int] = {}
        scores = np.zeros((0, p.shape[1]))
        for b in batches:
            pred, score = [], []
            texts = b["text"].tolist()
            for lo in range(0, len(texts), 500):
                counted = [Counter(words(t)) if isinstance(t, str) else {} for t in texts[lo : lo + 500]]
                new = list(set().union(*counted) - known.keys())
                if len(known) + len(new) > most:
                    known, scores, new = {}, scores[:0], list(set().union(*counted))
                if new and langs:
                    if len(known) + len(new) > len(scores):
                        scores = np.concatenate([scores[: len(known)], np.zeros((max(len(new), len(known)), p.shape[1]))])
                    scores[len(known) : len(known) + len(new)] = lattice.log_scores(new, p)
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                for t, c in zip(texts[lo : lo + 500], counted, strict=True):
                    if not langs or not (c or isinstance(t, str) and any(map(str.isalpha, t))):
                        pred.append("und")
                        score.append(0.0)
                        continue
                    total = np.fromiter(c.values(), float, len(c)) @ scores[np.fromiter(map(known.__getitem__, c), int, len(c))] if c else np.zeros(len(langs))
                    best = int(np.argmax(total))
                    pred.append(langs[best])
                    score.append(float(1 / np.exp(total - total[best]).sum()))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "held_out": b["held_out"], "lang_pred": pred, "score": score})

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, vocabulary_path: str | None = None, **how) -> DataFrame:
    """Train on part of docs and predict for all of it.

    Null text, or text without a letter: `und`, score 0, as for every text if no labelled row can be learned from. Null
    lang: not learned from. A null doc_id counts as an empty text in the hold-out rule. Repeated rows are predicted each.
    Empty table: empty result. Texts and words are scored whole, however long. Further columns are ignored, whatever their
    names.
    """
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path(VOCABULARY)
    small_batches(docs.sparkSession)
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(str(vocabulary_path)))
    return predict(docs, pieces, *train(docs, pieces, **how))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op1_language_id": op1_language_id}
SQL: dict[str, str] = {}
