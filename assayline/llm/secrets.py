"""Secret scanning: fixed patterns, and strings after a sensitive word that zstandard cannot shorten by their surroundings and by a dictionary of the corpus' words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from random import Random

import pandas as pd
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm.common import put, small_batches, table

# The base kinds in their order, each with its pattern and least length (of group 2, or of the match).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
# A run of the pattern is as long as it can be, so the long ones are found as such.
LONG_HEX = re.compile(HEX.pattern.replace("+", "{%d,}" % LEAST["hex"]))
KINDS = ("assign", "access", "hex", "novel")

# Words that make the text before a string sensitive; words that code around secrets is made of, which prime the compressor beside those of the corpus; and runs that people type.
SENSITIVE = re.compile(r"(?:key|token|secret|passw|passphrase|credential|auth|bearer|signature|private|login|pin\b|salt|cookie|session)", re.ASCII | re.IGNORECASE)
IDENTIFIERS = (
    "access account address admin api apikey application array async auth authorization await base64 bearer bool boolean break bucket build byte cache certificate char class client cloud code config "
    "configuration connection const constructor container content context cookie create credential credentials data database debug default define delete deploy description development document domain "
    "else email encoding endpoint env environment error event example exception export false file filename final float folder font format function getenv handler hash header headers host hostname "
    "http https id identifier if import index init input instance int integer interface item json key language length level library license link list localhost log logger login main manager "
    "message method model module name namespace network new node null number object option options output package parameter params parse password path port private process production project property "
    "protected protocol provider proxy public query random read record redirect region release request resource response result return role root router script secret secure select self sender server "
    "service session settings signature size socket source static status storage string struct subscription system table target template tenant test text this thread timeout timestamp token true type "
    "undefined update upload url user username utf8 value variable version void webhook window write xml yaml"
)
SEQUENCES = "0123456789 9876543210 1234567890 abcdefghijklmnopqrstuvwxyz zyxwvutsrqponmlkjihgfedcba qwertyuiop asdfghjkl zxcvbnm changeme example placeholder redacted your-api-key-here your_secret_here xxxxxxxxxxxxxxxx 00000000000000000000"
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~!@#$%^&*-]{12,}", re.ASCII)
_MAIL = re.compile(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.", re.ASCII)
_WORD = r"\p{L}{3,24}"
_OPENS = re.compile(r"""\w{0,24}["'\])]{0,3}[\x20\t]*(?:[:=>]|is|are)+[\x20\t]*["'(\[{|>]{0,3}[\x20\t\r]*""", re.ASCII)
_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]{1,16} ){0,3}PRIVATE KEY(?: BLOCK)?-----([A-Za-z0-9+/=\s:,-]{1,20000}?)-----END", re.ASCII)
_BEFORE = re.compile(r"(?<![A-Za-z0-9+/_=.~!@#$%^&*-])([A-Za-z0-9+/_=.~!@#$%^&*-]{12,200})[\"'`)\],]{0,3}(?:\x20[a-z]{1,8}){0,3}\x20(?=[A-Za-z])", re.ASCII)
_PATH, _ENDING, _SET = re.compile(r"[~.]{0,2}/"), re.compile(r"\.[A-Za-z0-9]{1,5}$"), re.compile(r"([A-Za-z_]{1,40})=([A-Za-z0-9+/_.~!@#$%^*-]+)")
_HEX, _LETTERS, _BOTH = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnopqrstuvwxyz"
#: Characters that a sensitive word's context reaches to; what the bound rises by at its end.
REACH, DECAY = 200, 0.1
#: Levels of compression whose added bytes are averaged, as whole bytes are a coarse measure of a short string.
LEVELS = (6, 9)
#: Characters of a block of text; a candidate's surroundings are its block and the two beside it.
STRIDE = 256


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), in the order start, then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return [(start, end, KINDS[k]) for start, k, end in sorted(found)]


class Novelty:
    """How much a string adds to its compressed surroundings, against random strings like it; primed with words."""

    def __init__(self, words: str) -> None:
        prime = f"{words} {IDENTIFIERS} {SEQUENCES}".encode("utf-8", "replace")
        self.packers = []
        for level in LEVELS:
            known = zstandard.ZstdCompressionDict(prime, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            self.packers.append(zstandard.ZstdCompressor(dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))
        self.size = lru_cache(maxsize=16)(self._size)
        self.baseline = lru_cache(maxsize=64)(self._baseline)

    def _size(self, around: str) -> int:
        data = around.encode("utf-8", "replace")
        return sum(len(p.compress(data)) for p in self.packers)

    def added(self, candidate: str, around: str) -> int:
        """Bytes, summed over levels, that the candidate adds at the end of its surroundings; case is dropped."""
        around += "\n"
        return self._size(around + candidate.lower()) - self.size(around)

    def _baseline(self, alphabet: str, length: int, around: str, times: int = 4) -> float:
        """Bytes a character that random strings of the alphabet and length add to the same surroundings."""
        draw = Random(f"{alphabet}{length}")
        return max(sum(self.added("".join(draw.choices(alphabet, k=length)), around) for _ in range(times)) / (times * length), 0.1)

    def __call__(self, candidate: str, around: str) -> float:
        """About 1 for random characters whatever the alphabet, less for words, repeats and what occurs nearby."""
        folded = set(candidate.lower())
        alphabet = _HEX if folded <= set(_HEX) else _LETTERS if folded.isdisjoint(_HEX[:10]) else _BOTH
        # Lengths in steps, so that the candidates of a block share few baselines.
        return self.added(candidate, around) / len(candidate) / self.baseline(alphabet, -(-len(candidate) // 8) * 8, around)


def _windows(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(start, stop, end, fades): stretches in which a string may be a secret by what stands around it; it must begin before stop and may go on to end. They ascend by start, but for those before a word.

    On a line after a sensitive word, REACH characters of it; the line below a name that its line ends with (`name:`); and
    the body of a private key's block.
    """
    at = 0
    for m in SENSITIVE.finditer(text):
        if m.end() <= at:
            continue
        end = text.find("\n", m.end())
        end = end if end >= 0 else len(text)
        stop, last = m.end(), m
        while last and last.start() < min(stop + REACH, end):  # sensitive words near one another share a stretch
            stop = last.end()
            last = SENSITIVE.search(text, stop, min(stop + REACH, end))
        yield m.end(), min(stop + REACH, end), end, True
        at = stop
        if end < len(text) and _OPENS.fullmatch(text, stop, end):
            below = text.find("\n", end + 1)
            below = below if below >= 0 else len(text)
            yield end + 1, min(end + 1 + REACH, below), below, True
    for m in _BLOCK.finditer(text):
        yield m.start(1), m.end(1), m.end(1), False


def candidates(text: str, known: list[tuple[int, int, str]], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, end, far): strings of at least `least` characters, a letter among them and no address, that stand where a secret may, far characters from what makes it so, and overlap no known span. known is sorted by start.

    Beside the stretches of `_windows`, a string before a sensitive word counts, with at most three short words between. Of
    addresses and paths only what a sensitive name is set to counts, so a long path isn't one string.
    """
    found: dict[int, tuple[int, int]] = {}

    def add(start: int, end: int, far: int) -> None:
        # What stands before an equals sign is the name of the rest, unless it is padding.
        word = text[start:end]
        cut = word.rfind("=", 0, len(word.rstrip("="))) + 1
        if word.startswith("//") or word.count("/") > 1 and (_PATH.match(word) or _ENDING.search(word)) or len(_SET.findall(word)) > 1:
            named = [m for m in _SET.finditer(word) if SENSITIVE.search(m[1])]
            if not named:
                return
            cut, end = named[0].start(2), start + named[0].end(2)
        start += cut
        end = start + len(text[start:end].rstrip(".!-"))
        if end - start >= least and any(map(str.isalpha, text[start:end])) and not _MAIL.search(text[start:end]) and start not in found:
            found[start] = end, far

    for start, stop, end, fades in _windows(text):
        for c in _CANDIDATE.finditer(text, start, end):
            if c.start() >= stop:
                break
            add(*c.span(), c.start() - start if fades else 0)
    for m in _BEFORE.finditer(text):
        if SENSITIVE.match(text, m.end()):
            add(*m.span(1), m.end() - m.end(1))
    out, i, reach, past = [], 0, 0, 0
    for start, (end, far) in sorted(found.items()):
        while i < len(known) and known[i][0] < end:
            reach = max(reach, known[i][1])
            i += 1
        if reach <= start and past <= start:
            out.append((start, end, far))
            past = end
    return out


def novel_spans(text: str, known: list[tuple[int, int, str]], novelty: Novelty, *, least: float = 0.85, wordlike: float = 0.95) -> list[tuple[int, int, str]]:
    """Candidates whose novelty is at least `least`, and the more the farther they are from their context; `wordlike` for those of letters in one case, which may be rare words."""
    spots = candidates(text, known)
    if not spots:
        return []
    found, masked, last = [], [], 0
    for start, end, _ in spots:  # a candidate is no part of any surroundings
        masked += [text[last:start], " " * (end - start)]
        last = end
    hidden = "".join([*masked, text[last:]]).lower()
    if len(hidden) != len(text):  # some letters get longer in lower case
        hidden = "".join([*masked, text[last:]])
    around, at = "", -1
    for start, end, far in spots:
        word = text[start:end]
        if start // STRIDE != at:
            at = start // STRIDE
            around = hidden[max(0, (at - 1) * STRIDE) : (at + 2) * STRIDE]
        bound = wordlike if word.isalpha() and (word[1:].islower() or word.isupper()) else least
        if novelty(word, around) >= bound + DECAY * min(1.0, far / REACH):
            found.append((start, end, "novel"))
    return found


def vocabulary(docs: DataFrame, *, size: int = 32_768, contexts: int = 8) -> str:
    """The corpus' most frequent words, in lower case, up to `size` characters, the most frequent last, where a compressor reaches them best.

    Only words that follow at least `contexts` of 64 classes of other words count, so a secret, however many copies of its
    text there are, is none of them. Counts and classes are summed over all documents; the words that go to the driver are
    bounded by `size`.
    """

    words = F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))
    before = F.concat(F.array(F.lit("")), F.col("words"))
    pairs = docs.select(words.alias("words")).select(F.explode(F.arrays_zip("words", F.slice(before, F.lit(1), F.size("words")).alias("before"))).alias("p"))
    pairs = pairs.select(F.col("p.words").alias("word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(p.before), 64) as int))").alias("class"))
    words = pairs.groupBy("word").agg(F.count("*").alias("n"), F.bit_or("class").alias("seen"))
    words = put(words.filter(F.bit_count("seen") >= contexts).select("word", "n", F.floor(F.log2("n") * 8).alias("bin")), "secret-words")
    # The size // 4 most frequent words, so that the driver gets no more of them on a larger corpus: whole bins of counts, and of the first bin that doesn't fit its most frequent ones.
    room, last = size // 4, None
    for r in words.groupBy("bin").count().orderBy(F.desc("bin")).collect():
        if r["count"] > room:
            last = r["bin"]
            break
        room -= r["count"]
    found = words.collect() if last is None else words.filter(F.col("bin") > last).collect() + words.filter(F.col("bin") == last).orderBy(F.desc("n"), "word").limit(room).collect()
    found.sort(key=lambda r: (-r["n"], r["word"]))
    out, used = [], 0
    for r in found:
        used += len(r["word"]) + 1
        if used > size:
            break
        out.append(r["word"])
    return " ".join(out[::-1])


def digest(spans: list[tuple]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


@lru_cache(maxsize=1)
def _novelty(words: str) -> Novelty:
    """One for all tasks of a worker process."""
    return Novelty(words)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans.

    Whole texts are read twice: for the words that prime the compressor, and for spans, the second time without a shuffle.
    Null text counts as empty: no spans. Very long texts are scanned in time in proportion to their length. Null doc_id and
    repeated rows are scanned like others. Empty table: empty result. Further columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    words: Broadcast = docs.sparkSession.sparkContext.broadcast(vocabulary(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        novelty = _novelty(words.value)
        for b in batches:
            out = []
            for key, text in zip(b["doc_id"], b["text"], strict=True):
                text = text if isinstance(text, str) else ""
                base = base_spans(text)
                new = novel_spans(text, base, novelty)
                n = [sum(kind == k for _, _, kind in base) for k in KINDS[:3]]
                both = sorted(base + new, key=lambda x: (x[0], KINDS.index(x[2])))
                out.append((key, *n, len(new), hashlib.sha256(digest(base).encode()).hexdigest(), digest(both)))
            frame = pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op6_secret_scan": op6_secret_scan}
SQL: dict[str, str] = {}
