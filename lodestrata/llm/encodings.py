"""Problem 1: text decoded with a wrong character encoding.

A chain says how a text was garbled: written in one encoding, read in another, once or twice. A multinomial naive Bayes
model over hashed byte bigrams of words learns, from words of the corpus and the same words garbled by every chain, to
predict the chain of a word. The chain is inverted and counts only if that is possible strictly, byte by byte, and if the
result looks more like a word of the corpus. A field is found if such words stand in it as words: single letters that
come apart from any word, as in a text that quotes odd characters, are no evidence.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.store import table

#: Records used to fit the model, and distinct words kept of them.
SAMPLE, WORDS = 4_000, 12_000
BITS = 14
#: How much likelier (log) a word must be under its chain than as it stands, and by the byte when restored: of chains of
#: single bytes, which nearly any text can be inverted by, and of chains with UTF-8, where inverting strictly tells most.
MARGIN, GAIN = 4.0, 0.7
MARGIN_UTF8, GAIN_UTF8 = -12.0, -0.3
#: Evidence of a field, summed over its words.
EVIDENCE = 4.0

#: Encodings that UTF-8 is misread in, once and twice, and those of single bytes taken for each other (fixed values).
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "cp852", "cp866", "mac_roman", "mac_cyrillic", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_15", "cp1254")
TWICE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman")
WESTERN = ("cp1252", "mac_roman", "cp437", "cp850")
CYRILLIC = ("cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5")
SINGLE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "cp866", "mac_roman", "mac_cyrillic", "koi8_r")
#: Letters that are words by themselves (fixed values).
LETTER_WORDS = frozenset("àÀóÓaAyYиИвВсСоОкКуУяЯаА")

_space = re.compile("[ \t\r\n]+")
_reference = re.compile(r"&#(?:[xX]([0-9a-fA-F]{1,6})|(\d{1,7}));")
LOST = "�"


@cache
def _table(encoding: str) -> tuple[str, dict[str, int]]:
    """All 256 characters of an encoding and their bytes; bytes it leaves open stand for themselves."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return "".join(chars), {c: b for b, c in reversed(list(enumerate(chars)))}


def encode(text: str, encoding: str) -> bytes | None:
    """Strictly; None if a character is missing."""
    try:
        if encoding == "utf-8":
            return text.encode("utf-8")
        own = _table(encoding)[1]
        return bytes([own[c] for c in text])
    except (KeyError, UnicodeEncodeError):
        return None


def decode(data: bytes, encoding: str) -> str | None:
    if encoding == "utf-8":
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return None
    own = _table(encoding)[0]
    return "".join([own[b] for b in data])


#: Each chain: (written in, read in) steps in the order in which they happened.
CHAINS: list[tuple[tuple[str, str], ...]] = (
    [(("utf-8", e),) for e in READ_AS]
    + [(("utf-8", e), ("utf-8", e)) for e in TWICE]
    + [(("utf-8", "cp1252"), ("utf-8", "latin-1")), (("utf-8", "latin-1"), ("utf-8", "cp1252"))]
    + [((a, b),) for a in (*WESTERN, *CYRILLIC) for b in SINGLE if a != b and (a, b) != ("cp1252", "latin-1")]
)


UTF8 = [False, *(c[0][0] == "utf-8" for c in CHAINS)]


def name_of(chain: tuple[tuple[str, str], ...]) -> str:
    return ", then ".join(f"{a} read as {b}" for a, b in chain)


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    for written, read in chain:
        data = encode(text, written)
        if data is None or (text := decode(data, read)) is None:
            return None
    return text


def restore(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The original of a text garbled by the chain, or None if any byte doesn't fit."""
    for written, read in reversed(chain):
        data = encode(text, read)
        if data is None or (text := decode(data, written)) is None:
            return None
    return text


def _bigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, owner): hashed byte bigrams, with a mark before and after each word."""
    data = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    sizes = np.array([len(x) for x in data])
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    pair = (flat[:-1] * 256 + flat[1:]) * 40503 & 0xFFFFFF
    inside = owner[:-1] == owner[1:]
    return (pair[inside] >> (24 - BITS)), owner[:-1][inside]


def _letters(word: str) -> int:
    return sum(c.isalpha() for c in word)


def core(word: str) -> str:
    """The word's letters in lower case."""
    return "".join(c for c in word.lower() if c.isalpha())


def _alike(word: str, fixed: str) -> bool:
    """Whether a word restored from another encoding of single bytes is one: of three letters, all of one script, and with
    letters as it stood."""
    scripts = {unicodedata.name(c, "?").split(" ")[0] for c in fixed if c.isalpha()}
    return len(scripts) == 1 and _letters(fixed) >= 3 and any(c.isalpha() for c in word)


class Model:
    """Log-likelihoods of byte bigrams by class; class 0 is text as it should be, the others are CHAINS."""

    def __init__(self, weights: np.ndarray, counts: Counter):
        self.weights = weights
        #: How often the commonest words stand in the sample, by their letters.
        self.counts = counts
        self.known: dict[str, tuple[str, int, float, str]] = {}

    @classmethod
    def fit(cls, words: Counter) -> Model:
        """From words of the corpus that hold other than ASCII characters, with their numbers."""
        known: Counter = Counter()
        for w, n in words.most_common(WORDS):
            known[core(w)] += n
        model = cls(np.zeros((1 << BITS, len(CHAINS) + 1), np.float32), known)
        for _ in range(2):  # what the first model finds garbled is left out of the second
            own = [w for w, _ in words.most_common(WORDS)]
            if not own:
                return model
            number = np.sqrt(np.array([words[w] for w in own], float))
            counts = np.full((1 << BITS, len(CHAINS) + 1), 0.02)
            for k, chain in enumerate([(), *CHAINS]):
                made = [(g, n) for w, n in zip(own, number, strict=True) if (g := garble(w, chain)) is not None and (not chain or g != w)]
                if not chain:  # words in capitals are as good
                    made += [(w.upper(), n / 3) for w, n in made if not w.isupper()] + [(w.capitalize(), n / 3) for w, n in made if w.islower()]
                if made:
                    f, o = _bigrams([g for g, _ in made])
                    counts[:, k] += np.bincount(f, np.array([n for _, n in made])[o], 1 << BITS)
            model = cls(np.log(counts / counts.sum(0)).astype(np.float32), known)
            verdicts = model.verdicts(own)
            words = Counter({w: n for w, n in words.items() if w not in verdicts or verdicts[w][1] == 0})
        return model

    def verdicts(self, words: list[str]) -> dict[str, tuple[str, int, float, str]]:
        """Of each word: its restored form, the number of its chain (0: none), the evidence and the chain's name."""
        out = {w: v for w in words if (v := self.known.get(w))}
        new = [w for w in dict.fromkeys(words) if w not in out]
        for at in range(0, len(new), 4000):
            part = new[at : at + 4000]
            f, o = _bigrams(part)
            starts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
            likely = np.add.reduceat(self.weights[f], starts, axis=0)
            size = np.diff(np.r_[starts, len(f)])
            best = np.argsort(-likely[:, 1:], axis=1) + 1
            enough = likely - likely[:, :1] >= np.where(UTF8, MARGIN_UTF8, MARGIN)
            ask: list[tuple[int, int, str]] = []
            for k, w in enumerate(part):
                out[w] = (w, 0, 0.0, "")
                for c in best[k][enough[k][best[k]]].tolist():  # every chain that is likely enough, the likeliest first
                    fixed = restore(w, CHAINS[c - 1])
                    if fixed is not None and fixed != w and fixed.isprintable() and (UTF8[c] or (_alike(w, fixed) and self.counts[core(w)] <= max(2, self.counts[core(fixed)]))):
                        ask.append((k, c, fixed))
            if ask:
                f2, o2 = _bigrams([x[2] for x in ask])
                s2 = np.flatnonzero(np.r_[True, o2[1:] != o2[:-1]])
                clean = np.add.reduceat(self.weights[f2, 0], s2)
                size2 = np.diff(np.r_[s2, len(f2)])
                for (k, c, fixed), good, n in zip(ask, clean.tolist(), size2.tolist(), strict=True):
                    w = part[k]
                    if out[w][1] == 0 and good / n - float(likely[k, 0]) / size[k] >= (GAIN_UTF8 if UTF8[c] else GAIN):
                        out[w] = (fixed, c, EVIDENCE if UTF8[c] else float(likely[k, c] - likely[k, 0]) * (1 if _letters(fixed) >= _letters(w) else 0.4), name_of(CHAINS[c - 1]))
        if len(self.known) > 400_000:
            self.known.clear()
        self.known.update({w: out[w] for w in new})
        return out


def odd_words(text: str) -> list[str]:
    """The words that could be garbled: those with other than ASCII characters or numeric character references."""
    return [w for w in _space.split(text) if not w.isascii() or "&#" in w]


def _referred(m: re.Match) -> str:
    code = int(m[1], 16) if m[1] else int(m[2])
    return chr(code) if 0 < code < 0xD800 or 0xE000 <= code <= 0x10FFFF else m[0]


def plain(word: str) -> str:
    """The word with its numeric character references, decimal or hexadecimal, resolved."""
    return _reference.sub(_referred, word) if "&#" in word else word


def is_word(fixed: str) -> bool:
    """Whether a restored word counts: it has two letters, or one that is a word by itself, or is punctuation."""
    own = [c for c in fixed if c.isalpha()]
    return len(own) > 1 or not own or (len(own) == 1 and own[0] in LETTER_WORDS)


def judge(text: str, verdicts: dict[str, tuple[str, int, float, str]]) -> tuple[bool, Counter]:
    """Whether the text was garbled, and its chains with their numbers of words."""
    evidence, chains = 0.0, Counter()
    for w in odd_words(text):
        if LOST in w:
            evidence += EVIDENCE
            chains["bytes lost"] += 1
            continue
        fixed, chain, gain, name = verdicts[plain(w)]
        if chain and is_word(fixed):
            evidence += gain
            chains[name] += 1
    return evidence >= EVIDENCE, chains


_BY_NAME = {name_of(c): c for c in CHAINS}


def repair(text: str, verdicts: dict[str, tuple[str, int, float, str]], chains: Counter) -> str:
    """The text with every garbled word restored; words whose bytes are lost stay as they are. Where most odd words are of
    one chain, words too short to be judged are restored by it too."""
    name, number = max(((n, k) for n, k in chains.items() if n in _BY_NAME), key=lambda x: x[1], default=("", 0))
    whole = _BY_NAME[name] if number and 2 * number >= len(odd_words(text)) else None
    out = []
    for piece in re.split("([ \t\r\n]+)", text):
        if piece and (not piece.isascii() or "&#" in piece) and LOST not in piece:
            own = plain(piece)
            fixed, chain, _, _ = verdicts[own]
            piece = fixed if chain else ((restore(own, whole) if whole else None) or piece)
        out.append(piece)
    return "".join(out)


FOUND_SCHEMA = "tbl string, rec_key string, field string, chain string, restored string"


def _finder(fitted: tuple[np.ndarray, Counter], tbl: str, fields: list[str], restored: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*fitted)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows = []
            for k, field in enumerate(fields, 1):
                texts = batch.column(k).to_pylist()
                for at in range(0, len(texts), 500):
                    part = [(key, t) for key, t in zip(keys[at : at + 500], texts[at : at + 500], strict=True) if t and (not t.isascii() or "&#" in t)]
                    verdicts = model.verdicts(list({plain(w) for _, t in part for w in odd_words(t)}))
                    for key, t in part:
                        found, chains = judge(t, verdicts)
                        if found:
                            rows.append((tbl, key, field, chains.most_common(1)[0][0], repair(t, verdicts, chains) if restored else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows, strict=True)], ["tbl", "rec_key", "field", "chain", "restored"])

    return run


def fit_from(tables: list[tuple[DataFrame, list[str]]]) -> Model:
    """The model from a bounded sample of each table's rows, those with the least hashes of their keys."""
    words: Counter = Counter()
    for rows, fields in tables:
        chosen = rows.select("key").orderBy(F.xxhash64("key"), "key").limit(SAMPLE)  # SAMPLE keys at most
        for row in rows.join(F.broadcast(chosen), "key", "left_semi").select(*fields).limit(SAMPLE).toLocalIterator():
            for text in row:
                words.update(w for w in odd_words(text or "") if LOST not in w and "&#" not in w)
    return Model.fit(words)


def garbled_fields(tables: dict[str, tuple[DataFrame, str, list[str]]], restored: bool = False) -> DataFrame:
    """(tbl, rec_key, field, chain, restored): the fields that were wrongly decoded, in whole or in part.

    ``tables``: by name the table, its key column and the fields. ``chain`` is the commonest of the field's words;
    ``restored`` is given if asked for, with words whose bytes are lost left as they are. Null keys are left out, null and
    empty fields are no cases, repeated rows give one row.
    """
    own = {
        name: (df.select(F.col(key).cast("string").alias("key"), *[F.col(f).alias(f"f{k}") for k, f in enumerate(fields)]).filter("key is not null"), fields)
        for name, (df, key, fields) in tables.items()
    }
    model = fit_from([(df, [f"f{k}" for k in range(len(fields))]) for df, fields in own.values()])
    result = None
    for name, (df, fields) in own.items():
        part = df.mapInArrow(_finder((model.weights, model.counts), name, fields, restored), FOUND_SCHEMA)
        result = part if result is None else result.union(part)
    return result.distinct()


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, str, list[str]]]:
    return {
        "index_docs": (table(spark, sf_dir, "index_docs"), "rec_id", ["title", "body"]),
        "warcinfo": (table(spark, sf_dir, "warcinfo"), "s3_key", ["block_text"]),
    }


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_fields(_tables(spark, sf_dir)).select("tbl", "rec_key", "field")


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The found fields with the encoding chain and the restored text."""
    return garbled_fields(_tables(spark, sf_dir), restored=True)


QUERIES = {"p1_found": p1_found, "p1_restored": p1_restored}
