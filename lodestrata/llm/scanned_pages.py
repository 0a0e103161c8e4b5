"""Problem 5: noise in text from scanned pages.

A vocabulary with its counts, and pairs of neighbouring words, are counted over all texts; a trie holds the vocabulary.
A word that is rare, or whose letters follow each other as in no common word, is looked up by intersecting its
Levenshtein automaton with the trie, which gives every word of the vocabulary within one or two edits; candidates are
ranked by their number, by whether the edits are ones that scanning makes, and by the words before and after. Page
furniture is found by its place at a page's edge and by coming back on the document's other pages; what remains is
joined over line and page ends into paragraphs.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.store import materialize, table

#: A word that comes this often is known; one this many times rarer than a likely reading is taken for misread.
KNOWN, DOMINATED = 3, 15
#: In large corpora a word is known by its share of all words, and letters are odd by their share of the known words, so
#: that misread forms, whose numbers grow with the corpus, do not become known.
KNOWN_SHARE, ODD_SHARE = 8e-5, 0.002
#: Characters that scanning takes for each other: as read, as printed (fixed values).
CONFUSED = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("l", "i"), ("i", "l"), ("5", "s"), ("6", "é"), ("6", "b"), ("8", "B"), ("9", "g"), ("(", "c"), ("c", "e"), ("e", "c"),
    ("o", "a"), ("a", "o"), ("v", "r"), ("q", "g"), ("b", "h"), ("h", "b"), ("n", "u"), ("u", "n"), ("f", "t"), ("t", "f"), ("f", "s"), ("s", "f"), ("ii", "n"), ("ii", "ü"), ("ii", "u"),
    ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"), ("n", "ri"), ("ni", "m"), ("in", "m"), ("a:", "ä"), ("o:", "ö"), ("u:", "ü"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("ll", "U"), ("I", "l"), ("l", "I"), ("O", "0"), ("S", "5"),
)
#: What a reading gains if a confusion explains it, and loses by each other edit.
CONFUSION, EDIT = 20.0, 3.0
#: What begins the stamps that scanning workshops put on pages (fixed values).
STAMPS = ("digitalisiert", "digitized", "digitised", "scanned", "numérisé", "digitalizado", "digitalizada", "scan:")

_word = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*")
_hyphen = re.compile(r"(?<=\w)[-‐¬=­][ \t]*$")
_outer = "“”„‘‚»«‹›\"'’.,;:?!…)[]{}–—*-‐¬="
_number = re.compile(r"\W*(?:(?:seite|page|pagina|página|s\.|p\.)[ \t]*)?([\dOIlS]{1,4})\W*", re.I)
_row = re.compile(r"\s*\d{4}(?:\s+\d+)?\s*")
_letters = re.compile(r"[\W\d_]+")
_ends = re.compile(r"[.!?…][“”»’\")\]]*\s*$")


class Trie:
    """The vocabulary as nested dictionaries; the empty key marks a word's end."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def within(self, word: str, edits: int) -> list[tuple[str, int]]:
        """All words within so many insertions, deletions and substitutions: the automaton's states are rows of the
        distance table, cut off where no entry is within the bound, and walk along the trie. Of a row only the entries
        that can be within the bound are computed; where all edits are used up only the word's own letters go on."""
        out: list[tuple[str, int]] = []
        n, far = len(word), edits + 1
        stack = [(self.root, 0, list(range(n + 1)))]
        while stack:
            node, depth, row = stack.pop()
            if "" in node and row[n] <= edits:
                out.append((node[""], row[n]))
            if min(row) == edits:
                letters = {word[k] for k in range(n) if row[k] == edits}
            else:
                letters = node
            depth += 1
            first, end = max(0, depth - edits), min(n, depth + edits) + 1
            for c in letters:
                child = node.get(c) if c else None
                if child is None:
                    continue
                new, last, least = [far] * (n + 1), far, far
                for k in range(first, end):
                    x = row[k] + 1
                    if k:
                        y = row[k - 1] if word[k - 1] == c else row[k - 1] + 1
                        x = y if y < x else x
                        x = last + 1 if last + 1 < x else x
                    new[k] = last = x
                    least = x if x < least else least
                if least <= edits:
                    stack.append((child, depth, new))
        return out


class Lexicon:
    """Words and pairs with their counts, and what can be told of a word by them."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int], readings: dict[str, list[tuple[str, float]]] | None = None):
        self.words, self.pairs, self.given, self.counted_words = dict(words), pairs, readings or {}, words
        for w, n in words.items():  # the parts of words with a hyphen are words where a line ends between them
            if "-" in w:
                for part in w.split("-"):
                    self.words[part] = self.words.get(part, 0) + n
        self.known = max(KNOWN, KNOWN_SHARE * sum(words.values()))
        self.tries: dict[int, Trie] = {}
        good = [w for w, n in words.items() if n >= self.known and not self.dominating(w)]
        self.grams, self.rare = self.counted(good), max(1, ODD_SHARE * len(good))
        self.seen = self.counted([w for w, n in words.items() if n >= KNOWN])
        self.hyphened = {w for w in words if "-" in w}
        self.fixed: dict[str, list[tuple[str, float]]] = {}

    @staticmethod
    def parts(word: str) -> set[str]:
        low = f"^{word.lower()}$"
        return {low[k : k + 3] for k in range(len(low) - 2)} if word else set()

    def counted(self, words: list[str]) -> Counter:
        return Counter(g for w in words for g in self.parts(w))

    def odd(self, word: str) -> bool:
        """Whether its letters follow each other as in hardly any common word."""
        return len(word) > 1 and min(self.grams[g] for g in self.parts(word)) <= self.rare

    def possible(self, word: str) -> bool:
        """Whether its letters follow each other as in some words: all that a name can be asked for."""
        return len(word) < 2 or min(self.seen[g] for g in self.parts(word)) > 1

    def dominating(self, word: str) -> list[str]:
        """The words one confusion away that come DOMINATED times as often."""
        least = DOMINATED * max(self.words.get(word, 0), 1)
        return [c for c in self.swaps(word) if self.words.get(c, 0) >= least]

    def within(self, word: str, edits: int, least: int) -> list[tuple[str, int]]:
        """All words within so many edits that come at least so often. There is a trie for each power of two times
        DOMINATED, below which no word is a reading of another, so that frequent words are looked up among few."""
        level = max(least // DOMINATED, 1).bit_length() - 1
        if level not in self.tries:
            self.tries[level] = Trie([w for w, n in self.words.items() if n >= DOMINATED << level])
        return [(c, e) for c, e in self.tries[level].within(word, edits) if self.words[c] >= least]

    def swaps(self, word: str) -> set[str]:
        """The word with one confusion of scanning undone."""
        out = set()
        for read, printed in CONFUSED:
            at = word.find(read)
            while at >= 0:
                out.add(word[:at] + printed + word[at + len(read) :])
                at = word.find(read, at + 1)
            if read[0].islower() and word.startswith(read.capitalize()):
                out.add(printed.capitalize() + word[len(read) :])
        return out

    def _doubts(self, word: str) -> tuple[bool, bool, bool]:
        """(plain, likely, odd): letters only; near a much commoner word by a confusion; or with letters as in few words."""
        plain = word.replace("’", "").replace("-", "").replace("'", "").isalpha()
        return plain, bool(self.dominating(word)), not plain or (self.words.get(word, 0) < self.known and self.odd(word))

    def suspicious(self, word: str) -> bool:
        return any(self._doubts(word)[1:])

    def readings(self, word: str) -> list[tuple[str, float]]:
        """Likelier words for a word that may be misread, with their weights; none if it is good."""
        if (given := self.given.get(word)) is not None:
            return given
        if word not in self.fixed:
            found = []
            own = max(self.words.get(word, 0), 1)
            plain, likely, odd = self._doubts(word)
            if likely or odd:
                bound, swaps = (1 if len(word) < 7 else 2), self.swaps(word)
                far = own * DOMINATED * (1 if not plain else 2)
                # every word of the vocabulary within two edits that is common enough; a confusion of scanning outweighs
                # any other edit, and may change two letters of a short word
                for c, edits in self.within(word, 2 if likely else bound, own * DOMINATED):
                    if c in swaps:
                        found.append((c, float(np.log(self.words[c])) + CONFUSION))
                    elif odd and edits <= bound and self.words[c] >= far:
                        found.append((c, float(np.log(self.words[c])) - EDIT * edits))
                # no word is near, but what scanning confuses makes it one by its letters: a name
                if not found and not plain:
                    found = [(c, -6.0) for c in swaps if c.isalpha() and self.possible(c)]
            if len(self.fixed) > 300_000:
                self.fixed.clear()
            self.fixed[word] = sorted(found, key=lambda x: (-x[1], x[0]))
        return self.fixed[word]

    def best(self, word: str, before: str, after: str) -> str | None:
        """The reading that fits best between its neighbours, or None if the word is good."""
        found = self.readings(word)
        if not found:
            return None
        return max(found, key=lambda x: (x[1] + 2 * np.log1p(self.pairs.get((before, x[0]), 0)) + 2 * np.log1p(self.pairs.get((x[0], after), 0)), x[0]))[0]


def core(token: str) -> tuple[str, str, str]:
    """(before, word, after): the token's word without the marks around it."""
    left = token.lstrip(_outer + "(")
    word = left.rstrip(_outer)
    return token[: len(token) - len(left)], word, left[len(word) :]


def word_of(token: str) -> tuple[str, str, str]:
    """As ``core``, but an opening bracket at the word's end belongs to it: it may be a misread letter."""
    a, w, z = core(token)
    if z.startswith("(") or (w.endswith("(") and len(w) > 2):
        w = w.rstrip("(")
        w = w + "(" if token.rstrip(_outer).endswith("(") else w
    return a, w, z


def words_asked(title: str, body: str) -> set[str]:
    """The words that ``judge`` will look up, but for some at line ends with page furniture between their parts."""
    out, left = set(), ""
    for line in (*re.split("[\n\f]", body), title):
        tokens = line.split()
        if not tokens:
            continue
        out.update(word_of(t)[1] for t in tokens)
        if left:
            out.add(core(left + tokens[0])[1])
        left = tokens[-1].rstrip("-‐¬=­") if _hyphen.search(line) else ""
    return {w for w in out if checked(w)}


def checked(word: str) -> bool:
    """Whether a word can be misread: host names, numbers and single letters can't be told."""
    if len(word) < 3 or "." in word or "/" in word or "@" in word:
        return False
    return sum(c.isalpha() for c in word) >= 2


def misread_number(word: str) -> bool:
    """Digits with a letter that looks like one, or a digit group spoilt by one."""
    return bool(re.fullmatch(r"(?=.*\d)(?=.*[OIlS])[\dOIlS]{2,}", word))


def pages_of(body: str) -> list[list[tuple[int, str]]]:
    """Pages of (line number, line); lines are cut at line and page ends and counted from 1."""
    out, number = [], 0
    for page in body.split("\f"):
        lines = []
        for line in page.split("\n"):
            number += 1
            lines.append((number, line))
        out.append(lines)
    return out


#: Letters of the pieces by which alike lines meet.
PIECE = 4


def _alike(a: str, b: str) -> bool:
    """Equal but for a few characters; the one may be cut short."""
    if not a or not b:
        return False
    n = min(len(a), len(b))
    if n < 8 or (abs(len(a) - len(b)) > 3 and n < 14):
        return a == b
    most = max(1, n // 8)
    row = list(range(n + 1))
    for i in range(n):
        new = [i + 1]
        for j in range(n):
            new.append(min(row[j] + (a[i] != b[j]), row[j + 1] + 1, new[j] + 1))
        row = new
        if min(row) > most:
            return False
    return row[n] <= most


class Alike:
    """Lines with their numbers, to be asked for those alike. Lines that differ in at most an eighth of their characters
    have a piece of PIECE letters in common at nearly the same place (with d differences one of d + 1 parts is whole, and
    every part is that long), so only lines with such a piece are compared."""

    def __init__(self, lines: Counter):
        self.lines = lines
        self.at: dict[tuple[str, int], list[str]] = defaultdict(list)
        self.told: dict[str, int] = {}
        for x in lines:
            for k in range(max(len(x) - PIECE + 1, 0)):
                self.at[(x[k : k + PIECE], k)].append(x)

    def number(self, line: str) -> int:
        """How many lines, with repetition, are alike to this one."""
        if line not in self.told:
            near = {line} if line in self.lines else set()
            far = max(1, len(line) // 8)
            if len(line) >= 8:
                for k in range(len(line) - PIECE + 1):
                    for j in range(max(k - far, 0), k + far + 1):
                        near.update(self.at.get((line[k : k + PIECE], j), ()))
            self.told[line] = sum(self.lines[x] for x in near if _alike(x, line))
        return self.told[line]


def furniture_of(pages: list[list[tuple[int, str]]], title: str) -> set[int]:
    """The numbers of the lines that are running headers, footers, page numbers and stamps."""
    found: set[int] = set()
    edges = []
    for page in pages:
        full = [(n, x.strip()) for n, x in page if x.strip()]
        edges.append(full)
    if sum(len(e) for e in edges) < 4:
        return found
    # page numbers and stamps at the foot
    feet: Counter = Counter()
    for full in edges:
        feet.update({_letters.sub("", x.lower()) for _, x in full[-3:] if len(x) < 45})
    alike_feet = Alike(feet)
    for full in edges:
        for n, x in reversed(full[-3:]):
            m = _number.fullmatch(x)
            key = _letters.sub("", x.lower())
            if m and (len(m[1]) < 4 or not x.isdigit()) and not _row.fullmatch(x):
                found.add(n)
            elif x.lower().startswith(STAMPS) and len(x) < 45:
                found.add(n)
            elif len(key) > 5 and len(x) < 45 and not _ends.search(x) and alike_feet.number(key) > max(1, len(edges) // 3) and len(edges) > 1:
                found.add(n)
            else:
                break
    # headers
    name = _letters.sub("", title.lower())
    heads = []
    for full in edges:
        heads.append(_letters.sub("", full[0][1].lower()) if full else "")
    alike_heads = Alike(Counter(heads))
    for k, full in enumerate(edges):
        if not full:
            continue
        n, x = full[0]
        if n in found:
            continue
        numbered = re.fullmatch(r"[\dOIlS]{1,4}\s{2,}(\D.*)|(.*\D)(?:\s{2,}|\. )[\dOIlS]{1,4}", x)
        if _number.fullmatch(x) and not _row.fullmatch(x) and len(full) > 1:
            found.add(n)
            continue
        if _ends.search(x) and not numbered:
            continue
        others = alike_heads.number(heads[k]) - 1 if heads[k] else 0
        table = len(full) > 1 and bool(_row.fullmatch(full[1][1]))
        width = max((len(t) for _, t in full), default=0)
        if numbered and not _ends.search((numbered[1] or numbered[2]).rstrip()) and re.search(r"[^\W\d_]{3}", x):
            found.add(n)
        elif others >= 1 and len(heads[k]) >= 8:
            found.add(n)
        elif x.isupper() and len(heads[k]) >= 8 and len(full) > 2:
            found.add(n)
        elif k > 0 and not table and len(heads[k]) >= 8 and _alike(name, heads[k]):
            found.add(n)
        elif k > 0 and not table and len(full) > 2 and x[:1].isupper() and len(x) < 0.9 * width and re.search(r"\w$", x):
            before = [t for m, t in edges[k - 1] if m not in found]
            if before and not _ends.search(before[-1]):
                found.add(n)
    return found


def _joins(lexicon: Lexicon, left: str, mark: str, right: str) -> bool:
    """Whether a line's last part and the next line's first are one word that is written without a hyphen."""
    if mark == "-":
        if f"{left}-{right}" in lexicon.words:
            return lexicon.words.get(left + right, 0) > lexicon.words[f"{left}-{right}"]
        if right[:1].isupper() and not left.isupper():
            return False
        if left in ("mi", "plein", "sous", "avant", "c.", "full", "well"):
            return any(h.startswith(f"{left}-") for h in lexicon.hyphened) is False
    return True


def judge(lexicon: Lexicon, title: str, body: str) -> tuple[list[tuple[int, str]], str]:
    """The flawed lines (number, flaw), and the text as continuous paragraphs."""
    flaws: list[tuple[int, str]] = []
    pages = pages_of(body)
    furniture = furniture_of(pages, title)
    flaws += [(n, "furniture") for n in sorted(furniture)]
    lines = [(n, x) for page in pages for n, x in page if n not in furniture]
    full = [(n, x) for n, x in lines if x.strip()]
    misread: set[int] = set()
    text: list[str] = []
    last = None
    carry: tuple[int, str, str] | None = None  # number, the words before the broken one, its first part
    previous = ""

    def fix(number: int, tokens: list[str], broken: int = -1) -> list[str]:
        out = []
        nonlocal previous
        for k, token in enumerate(tokens):
            a, w, z = word_of(token)
            follow = core(tokens[k + 1])[1] if k + 1 < len(tokens) else ""
            if misread_number(w):
                misread.add(number)
            elif checked(w) and k != broken:
                best = lexicon.best(w, previous, follow)
                if best is not None:
                    misread.add(number)
                    w = best
            previous = w
            out.append(a + w + z)
        return out

    gaps = {n for n, x in lines if not x.strip()}
    for k, (number, line) in enumerate(full):
        tokens = line.split()
        if not tokens:
            continue
        new_paragraph = bool(text) and carry is None and (any(m in gaps for m in range((last or 0) + 1, number)) or line.startswith("   "))
        if new_paragraph:
            text.append("\n\n")
        if carry is not None:
            whole = carry[2] + tokens[0]
            a, w, z = core(whole)
            if checked(w) and (best := lexicon.best(w, previous, "")) is not None:
                at = next((j for j, (p, q) in enumerate(zip(w, best, strict=False)) if p != q), len(w))
                misread.add(carry[0] if at < len(core(carry[2])[1]) else number)
                w = best
            tokens = tokens[1:]
            text.append(a + w + z + " ")
            previous = w
            carry = None
        mark = _hyphen.search(line)
        follow = full[k + 1][1].split()[0] if k + 1 < len(full) and full[k + 1][1].split() else ""
        if mark and follow and tokens:
            left = tokens[-1].rstrip("-‐¬=­")
            if _joins(lexicon, core(left)[1], mark[0][0], core(follow)[1]):
                flaws.append((number, "split"))
                fixed = fix(number, tokens[:-1])
                text.append(" ".join(fixed) + (" " if fixed else ""))
                carry = (number, "", left)
                last = number
                continue
        fixed = fix(number, tokens)
        text.append(" ".join(fixed) + ("" if mark else " "))
        last = number
    if carry is not None:
        text.append(carry[2])
    # the title is line 0
    flat = re.sub(r"\s+", " ", title).strip()
    broken = re.search(r"(?<=\w)([-‐¬=­])\s+(?=\w)", flat)
    if broken and _joins(lexicon, flat[: broken.start()].split()[-1], broken[1], flat[broken.end() :].split()[0]):
        flaws.append((0, "split"))
        flat = flat[: broken.start()] + flat[broken.end() :]
    previous = ""
    fix(0, flat.split())
    flaws += [(n, "misread") for n in sorted(misread)]
    return flaws, re.sub(r" +(?=\n|$)", "", re.sub(r" {2,}", " ", "".join(text))).strip()


def lexicon_of(docs: DataFrame) -> Lexicon:
    """From docs (body, title): counted over all texts; every word that comes twice and every pair that comes three times. A word
    that comes once can be no reading of another, and counts as one where it is missing."""
    flat = F.regexp_replace(F.concat_ws("\n\n", "title", "body"), r"[-‐¬=­][ \t]*[\n\f]+\s*(?=\p{Ll})", "")
    # split and trimmed: a pattern that repeats a group would recurse on very long words
    words = F.filter(F.transform(F.split(flat, r"[^\p{L}’'-]+"), lambda w: F.btrim(w, F.lit("’'-"))), lambda w: w != "")
    tokens = materialize(docs.select(words.alias("w")).filter(F.size("w") > 0), "words")
    counts = tokens.select(F.explode("w").alias("w")).groupBy("w").count().filter(F.col("count") >= 2)
    pairs = (
        tokens.select(F.explode(F.expr("transform(sequence(1, greatest(size(w) - 1, 1)), i -> struct(get(w, i - 1) as a, get(w, i) as b))")).alias("p"))
        .select("p.*")
        .filter("b is not null")
        .groupBy("a", "b")
        .count()
        .filter(F.col("count") >= 3)
    )
    return Lexicon({r[0]: r[1] for r in counts.toLocalIterator()}, {(r[0], r[1]): r[2] for r in pairs.toLocalIterator()})


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own: set[str] = set()
        for title, body in zip(batch.column("title").to_pylist(), batch.column("body").to_pylist(), strict=True):
            own |= words_asked(title or "", body or "")
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string())], ["word"])


def _reader(words: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(words, {})
        for batch in batches:
            asked = [w for w in batch.column("word").to_pylist() if lexicon.suspicious(w)]
            found = [lexicon.readings(w) for w in asked]
            if asked:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked, pa.string()), pa.array([[c for c, _ in f] for f in found], pa.list_(pa.string())), pa.array([[x for _, x in f] for f in found], pa.list_(pa.float64()))],
                    ["word", "reading", "weight"],
                )

    return run


def readings_of(docs: DataFrame, lexicon: Lexicon) -> dict[str, list[tuple[str, float]]]:
    """The readings of every suspicious word of docs (body, title), each word looked up once, spread over the cores."""
    parts = 2 * docs.sparkSession.sparkContext.defaultParallelism
    asked = docs.mapInArrow(_asked, "word string").distinct().repartition(parts, F.xxhash64("word"))
    found = materialize(asked.mapInArrow(_reader(lexicon.counted_words), "word string, reading array<string>, weight array<double>"), "readings")
    return {r[0]: list(zip(r[1], r[2], strict=True)) for r in found.toLocalIterator()}


def _judger(words: dict, pairs: dict, readings: dict, repaired: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(words, pairs, readings)
        for batch in batches:
            rows: dict[str, list] = defaultdict(list)
            for i, title, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                flaws, text = judge(lexicon, title or "", body or "")
                if repaired:
                    rows["id"].append(i)
                    rows["body"].append(text)
                else:
                    for n, flaw in flaws:
                        rows["id"].append(i)
                        rows["line_no"].append(n)
                        rows["flaw"].append(flaw)
            if rows["id"]:
                kinds = {"id": pa.int64(), "line_no": pa.int32(), "flaw": pa.string(), "body": pa.string()}
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in rows.items()], list(rows))

    return run


def _applied(docs: DataFrame, repaired: bool, schema: str) -> DataFrame:
    own = docs.filter("id is not null and (body is not null or title is not null)").select("id", "title", "body")
    lexicon = lexicon_of(own.select("title", "body"))
    readings = readings_of(own.select("title", "body"), lexicon)
    # judging costs far more than reading: small files are spread over the cores, which the adaptive planner would not do
    parts = max(own.sparkSession.sparkContext.defaultParallelism, int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return own.repartition(parts, "id").mapInArrow(_judger(lexicon.counted_words, lexicon.pairs, readings, repaired), schema)


def flawed_lines(docs: DataFrame) -> DataFrame:
    """(id, line_no, flaw) of docs (id, title, body): lines are cut at line and page ends and counted from 1, the title is
    line 0. Null and empty texts have no flaws; rows with a null id are left out; an id that comes twice gives both rows'
    lines."""
    return _applied(docs, False, "id long, line_no int, flaw string")


def repaired_texts(docs: DataFrame) -> DataFrame:
    """(id, body): continuous paragraphs without page furniture, broken words joined and misread ones corrected."""
    return _applied(docs, True, "id long, body string")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pdf_docs").filter("quality_ok").select(F.col("pdf_id").alias("id"), "title", "body")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flawed_lines(_docs(spark, sf_dir)).withColumnRenamed("id", "pdf_id")


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_texts(_docs(spark, sf_dir)).withColumnRenamed("id", "pdf_id")


QUERIES = {"p5_found": p5_found, "p5_repaired": p5_repaired}
