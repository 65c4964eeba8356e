"""Repair of text that was read from scanned pages.

Three kinds of knowledge come from the corpus, each by one pass of partial
counts: which lines a document repeats on its pages, misread or not (running
headers and footers), which lines its source repeats (see ``source_lines``), and
which words are established, hyphenated ones among them.  The rest is done chunk
by chunk in Arrow batches: page edges are dropped, words divided over two lines
are joined with or without their hyphen as the vocabulary has them, misread
characters are put back where an established word differs by one glyph that
looks alike, and wrapped lines become paragraphs.

The vocabulary that goes to the executors is bounded: a word is kept only if it
stands in at least ``KEEP`` of all texts, so there are at most (words of a mean
text) / KEEP of them, whatever the size of the corpus.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.source_lines import MIN_LETTERS, repeated_lines, with_source
from inkstone.runtime import fit_parallelism, materialize

#: Share of texts in which a word must stand to count as common, and to be kept at all.
COMMON, KEEP = 0.003, 0.00015
#: A misreading is at least so many times rarer than the word it stands for.
RARER = 20
#: A word among whose characters so many digits stand that it has more spellings than these is none.
MOST_SPELLINGS = 10_000
#: Least numbers of texts behind a common word and a kept one.
LEAST_COMMON, LEAST_KEPT = 8, 2

_HYPHENS = "-­¬‐‑"
BROKEN_END = re.compile(rf"(?<=[^\W\d_])[{_HYPHENS}][ \t\r]*$")
PAGE_LINE = re.compile(
    r"(?:[-–—―\[(<〈《{|·•]+\s*\d{1,4}\s*[-–—―\])>〉》}|·•]+"
    r"|(?:page|p\.|pg\.?|쪽|페이지)\s*\d{1,4}(?:\s*(?:/|of)\s*\d{1,4})?"
    r"|\d{1,4}\s*(?:쪽|페이지|면)"
    r"|\d{1,4}\s*(?:/|of)\s*\d{1,4}"
    r"|\d{1,4})",
    re.IGNORECASE,
)
_DIGITS = re.compile(r"\d")
#: Letters that a reader of glyphs takes digits for, and the digits.
AS_LETTER = {"0": "oO", "1": "lIi", "2": "zZ", "5": "sS", "6": "b", "8": "B", "9": "g"}
AS_DIGIT = {"O": "0", "o": "0", "l": "1", "I": "1", "Z": "2", "S": "5", "b": "6", "B": "8", "g": "9"}
#: Pairs of Latin letters or groups of letters that look alike, as read and as meant.
LOOKALIKES = (("j", "i"), ("f", "t"), ("I", "l"), ("e", "c"), ("c", "e"), ("rn", "m"), ("vv", "w"), ("cl", "d"), ("h", "b"), ("n", "h"), ("u", "v"), ("v", "u"), ("y", "v"), ("q", "g"), ("a", "o"), ("o", "a"), ("l", "i"), ("i", "l"), ("t", "f"), ("n", "u"), ("u", "n"), ("ri", "n"), ("m", "rn"), ("b", "h"))
_VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"


_PAGE_ENDS = frozenset("-–—―])>〉》}|·•쪽지면이－）］＞｝｜" + "".join(c for c in map(chr, range(0x10000)) if c.isdigit()))


def is_page_number(line: str) -> bool:
    """Whether a line holds nothing but a page number."""
    flat = line.strip()
    if not flat or flat[-1] not in _PAGE_ENDS:
        return False
    return PAGE_LINE.fullmatch(flat if flat.isascii() else unicodedata.normalize("NFKC", flat).strip()) is not None


def _jamo(syllable: str) -> tuple[int, int, int]:
    n = ord(syllable) - 0xAC00
    return n // 588, n // 28 % 21, n % 28


def alike(meant: str, read: str) -> bool:
    """Whether one Hangul syllable differs from another in exactly one of its parts."""
    if not ("가" <= meant <= "힣" and "가" <= read <= "힣"):
        return False
    return sum(a != b for a, b in zip(_jamo(meant), _jamo(read), strict=True)) == 1


#: Most words that a worker remembers.
_MEMORY = 500_000
_MASK = bytes(57 if 48 <= c <= 57 else c for c in range(256))


class _Doubtful(dict):
    """Whether what stands between spaces, as bytes with digits as 9, may hold a misread token; remembers what it has seen."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> bool:
        out = any(map(self.lexicon.doubtful, _TOKEN.findall(word.decode("utf-8", "surrogatepass"))))
        if len(self) < _MEMORY and len(word) < 120:
            self[word] = out
        return out


class Lexicon:
    """Established words with their numbers of texts, indexed for words that differ in one place."""

    def __init__(self, counts: dict[str, int], shapes: dict[str, int], texts: int) -> None:
        self.counts, self.shapes, self.texts = counts, shapes, texts
        self.common = max(LEAST_COMMON, COMMON * texts)
        self.holes: dict[str, list[str]] = defaultdict(list)
        for word, n in counts.items():
            if n >= self.common and len(word) > 1 and "가" <= word[0] <= "힣" and "-" not in word:
                for i in range(len(word)):
                    self.holes[f"{word[:i]}\0{word[i + 1:]}"].append(word)
        self.seen: dict[str, str | None] = {}
        #: common words that are no misreadings of still more common ones; they need no second look
        self.sure = frozenset(w for w, n in counts.items() if n >= self.common and "-" not in w and self.meant(w) is None)
        self.look = _Doubtful(self)

    def doubtful(self, token: str) -> bool:
        """Whether a token, its digits as 9, may be a misreading; digits are looked at one by one only then."""
        if "9" not in token:
            return token not in self.sure and self.meant(token) is not None
        number = "".join(AS_DIGIT.get(c, c) for c in token)
        return self.shapes.get(token, 0) < self.common or ("." in number or "," in number) and _PLAIN_NUMBER.fullmatch(number) is not None

    def _over(self, word: str, rare: int) -> bool:
        n = self.counts.get(word, 0)
        return n >= self.common and n >= RARER * rare

    def _texts(self, word: str) -> int:
        return self.counts.get(word, 0) or self.counts.get(word.lower(), 0)

    def hyphenated(self, first: str, second: str) -> bool:
        """Whether a word divided over two lines has a hyphen of its own.

        The spelling that more texts have counts; where none has either, two
        established words are a compound with a hyphen and anything else is one
        word.  Words of other scripts than Latin are written without.
        """
        one, two = self._texts(first + second), self._texts(f"{first}-{second}")
        if one or two:
            return two > one
        return first.isascii() and second.isascii() and len(first) > 1 and len(second) > 2 and min(self._texts(first), self._texts(second)) >= self.common

    def hangul(self, word: str) -> str | None:
        """The word that a run of Hangul is a misreading of."""
        if len(word) < 2:
            return None
        if len(word) > 9:
            return self._unspaced(word)
        rare, best = self.counts.get(word, 1), None
        for i, c in enumerate(word):
            for v in self.holes.get(f"{word[:i]}\0{word[i + 1:]}", ()):
                if v != word and self._over(v, rare) and alike(v[i], c) and (best is None or self.counts[v] > self.counts[best]):
                    best = v
        return best

    def _uncovered(self, run: str, longest: int) -> list[int]:
        """Places of a run of several words that no known word covers.

        One misread glyph leaves a short gap; a long one is a foreign text and no
        misreading, and is left out.
        """
        i, gap, out = 0, [], []
        while i < len(run):
            n = next((n for n in range(min(longest, len(run) - i), 1, -1) if run[i:i + n] in self.counts), 0)
            if n:
                out += gap if len(gap) <= longest else []
                gap = []
            else:
                gap.append(i)
            i += n or 1
        return out + (gap if len(gap) <= longest else [])

    def _unspaced(self, run: str) -> str | None:
        """A run of several words of Hangul: what is not covered is held against the common words."""
        return self._mended(run, 9, range(7, 1, -1), self.hangul)

    def _mended(self, run: str, longest: int, sizes: range, meant: Callable[[str], str | None]) -> str | None:
        """A run with every part that no word covers replaced by what it means; null if there is nothing to replace."""
        now = run
        for _ in run:  # a replacement may uncover the next one
            found = next(
                ((a, n, v) for u in self._uncovered(now, longest) for n in sizes for a in range(max(0, u - n + 1), min(u, len(now) - n) + 1) if (v := meant(now[a:a + n]))),
                None,
            )
            if found is None:
                break
            a, n, v = found
            now = now[:a] + v + now[a + n:]
        return now if now != run else None

    def latin(self, word: str) -> str | None:
        """The word that a run of Latin letters and digits is a misreading of."""
        if word.isdigit():
            return None
        rare = self.counts.get(word, 1)
        if any(c.isdigit() for c in word):
            return self._mixed(word)
        # short capitalised words are mostly names, and those differ by one letter among themselves
        if len(word) < 3 or rare >= self.common or (word[0].isupper() and len(word) < 8):
            return None
        if len(word) > 24:
            return self._glued(word)
        return self._swap(word, rare, 2 if len(word) > 5 and word.islower() else 1)

    def _swap(self, word: str, rare: int, depth: int) -> str | None:
        """The common word that is up to ``depth`` look-alikes away."""
        near = [word]
        for _ in range(depth):
            found = []
            for w in near:
                for read, meant in LOOKALIKES:
                    i = w.find(read)
                    while i >= 0:
                        v = w[:i] + meant + w[i + len(read):]
                        if self._over(v, rare):
                            return v
                        found.append(v)
                        i = w.find(read, i + 1)
            near = found
        return None

    def _glued(self, run: str) -> str | None:
        """A run of several words of letters: what is not covered is held against the common words."""
        return self._mended(run, 16, range(14, 5, -1), lambda w: self._swap(w, 1, 1) if w.islower() and w not in self.counts else None)

    def _mixed(self, word: str) -> str | None:
        """Letters among digits, or digits among letters, where the shape is not an established one."""
        rare = self.shapes.get(_DIGITS.sub("9", word), 1)
        digits = "".join(AS_DIGIT.get(c, c) for c in word)
        # with a point or comma inside it is a number for sure, else only if the shape is no usual one
        if digits != word and _PLAIN_NUMBER.fullmatch(digits) and ("." in digits or "," in digits or rare < self.common):
            return digits
        if sum(c.islower() for c in word) >= 2 and rare < self.common:
            choices = [AS_LETTER.get(c, c) for c in word]
            if math.prod(map(len, choices)) > MOST_SPELLINGS:
                return None
            known = next((o for o in map("".join, product(*choices)) if self._over(o, 1)), None)
            first = "".join(x[0] for x in choices)
            return known or (first if _INSIDE.search(word) and first.isalpha() else None)
        return None

    def meant(self, token: str) -> str | None:
        """What was meant by a token that was misread; null for a token read right or unknown."""
        if token in self.seen:
            return self.seen[token]
        out = self.hangul(token) if "가" <= token[0] <= "힣" else self.latin(token)
        if len(self.seen) < _MEMORY:
            self.seen[token] = out
        return out


_INSIDE = re.compile(r"[a-z][0-9][a-z]")
#: Runs of Hangul, and runs of Latin letters and digits, with the points and commas inside, that have a letter.
_TOKEN = re.compile(r"[가-힣]+|(?:\d[\d.,]*)?[A-Za-z][A-Za-z0-9]*(?:[.,][A-Za-z0-9]+)*")
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
_PLAIN_NUMBER = re.compile(r"\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?")


def shape(token: str) -> str:
    """A token with every digit as 9."""
    return _DIGITS.sub("9", token)


def correct(text: str, lexicon: Lexicon) -> tuple[str, int]:
    """The text with misread characters put back, and the number of kinds of corrections."""
    n = 0
    if _APART.search(text):  # a digit in front of a vowel sign is a syllable that fell apart
        text, n = _APART.subn(lambda m: _refit(m[0]), text)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    look = lexicon.look
    doubtful = {w for w, m in zip(words, raw.translate(_MASK).split(), strict=True) if look[m]}
    tokens = {t for w in doubtful for t in _TOKEN.findall(w.decode("utf-8", "surrogatepass"))}
    fixes = {t: new for t in tokens if t not in lexicon.sure and (new := lexicon.meant(t)) is not None}
    if fixes:
        n += len(fixes)
        text = _TOKEN.sub(lambda m: fixes.get(m[0], m[0]), text)
    if any(len(w) >= 60 and len(w.decode("utf-8", "surrogatepass")) >= 60 for w in words):
        text, more = _GLUED_NUMBER.subn(lambda m: "".join(AS_DIGIT.get(c, c) for c in m[0]), text)
        n += more
    return text, n


_APART = re.compile(r"[0-9][ㅏ-ㅣ]")
#: A number that touches words on both sides, with a letter among its digits.
_GLUED_NUMBER = re.compile(r"\d[OIlZSbB](?=[.,]\d)|(?<=[.,])\d?[OIlZSbB]\d{1,2}(?![A-Za-z0-9])|(?<=\d[.,])[OIlZSbB](?=[%배억])")


def _refit(pair: str) -> str:
    lead = {"7": 0, "1": 11, "0": 11, "2": 5, "5": 9, "6": 12}.get(pair[0], 0)
    return chr(0xAC00 + lead * 588 + _VOWELS.index(pair[1]) * 28)


def _sort_lines(raw: list[str], headers: set[int], sources: set[int]) -> tuple[set[int], set[str]]:
    """Numbers of the lines that hold only a page number, and the kinds of damage that single lines show."""
    pages, kinds = set(), set()
    for i, line in enumerate(raw):
        flat = line.strip()
        if not flat or i in sources:
            continue
        if i in headers:
            kinds.add("header")
        elif is_page_number(flat):
            pages.add(i)
            kinds.add("pagenum")
        elif flat[-1] in _HYPHENS and BROKEN_END.search(flat):
            kinds.add("linebreak")
    return pages, kinds


def repair(text: str, headers: set[int], sources: set[int], lexicon: Lexicon) -> tuple[str, set[str]]:
    """The repaired text and the kinds of damage found.

    ``headers`` and ``sources`` have the numbers of the lines that are running
    headers of the document and repeated lines of its source.  The latter stay as
    they are, behind the sentence in which they stood.
    """
    raw = text.split("\n")
    pages, kinds = _sort_lines(raw, headers, sources)
    width = max(_LEAST_WIDTH, *(len(x.rstrip()) for i, x in enumerate(raw) if i not in headers and i not in sources), 0)
    done: list[tuple[str, bool]] = []  # text, and whether it is body text
    held: list[str] = []
    current, last, pending = "", "", False

    def close() -> None:
        nonlocal current
        if current:
            done.append((current, True))
        done.extend((x, False) for x in held)
        held.clear()
        current = ""

    for i, line in enumerate(raw):
        flat = line.strip()
        if i in headers or i in pages:
            continue
        if i in sources:
            if current and (pending or not _ends(current)):
                held.append(line)
            else:
                close()
                done.append((line, False))
        elif not flat:
            if not pending:
                close()
                if done and done[-1][0]:
                    done.append(("", False))
        elif pending and _SET_OFF.search(flat) and not _DIGITS.search(flat) and not _ends(flat):
            held.append(line)  # a line set off by a rule stands between the halves of a word
        else:
            if pending:
                head, tail = _LAST_WORD.search(current), _FIRST_WORD.match(flat)
                current += ("-" if head and tail and lexicon.hyphenated(head[0], tail[0]) else "") + flat
            elif not current:
                current = flat
            elif held or not _ends(last) or len(last) + 1 + len(flat.split(None, 1)[0]) > width <= _MOST_WIDTH:
                current += " " + flat
            else:
                close()
                current = flat
            last = line.rstrip()
            pending = last[-1] in _HYPHENS and BROKEN_END.search(last) is not None
            if pending:
                current = BROKEN_END.sub("", current)
            if held and not pending and _ends(last):
                close()
    close()
    fixed, n = correct("\n\0\n".join(part for part, body in done if body), lexicon)
    if n:
        kinds.add("character")
    parts = iter(fixed.split("\n\0\n"))
    return "\n".join(next(parts) if body else part for part, body in done).strip("\n"), kinds


_LAST_WORD, _FIRST_WORD = re.compile(r"[^\W\d_]+$"), re.compile(r"[^\W\d_]+")
#: A line that ends a sentence this much before the longest line ends a paragraph; no page is set in shorter lines than this.
#: Text with longer lines than the greatest width was never set in lines, and its sentences end where they did.
_LEAST_WIDTH, _MOST_WIDTH = 40, 120
_SET_OFF = re.compile(r"\S\s*(?:\||—|―|·)\s*\S")


def _ends(line: str) -> bool:
    return line.rstrip().endswith((".", "!", "?", "。", ":", "…"))


def _is_pdf(doc_id: Column) -> Column:
    return F.lower(doc_id).rlike(r"\.pdf$")


def _texts(chunks: DataFrame) -> DataFrame:
    return chunks.where((F.col("chunk_type") == "text") & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & F.col("chunk_index").isNotNull())


#: A line set off by a bar or rule is a running header from two chunks on, any other from so many and this share of the document's on.
PLAIN_HEADER, PLAIN_SHARE = 3, 0.5
#: Letters at either end of a line by which lines meet that may be readings of one, and one letter in so many that may be misread where a line is set off and where not.
_ENDS, _MISREAD, _PLAIN_MISREAD = 5, 8, 16
#: Share of the documents that have a line at all in which it has to be a header.
_OWN = 0.5


def header_lines(heads: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, line_no) of running headers and footers.

    ``heads`` has doc_id, chunk_index, line_no, key, plain (at a page edge and
    without digits) and off (set off by a bar or rule) of the lines that may be
    one by their form; ``lines`` doc_id, chunk_index and h of all lines.  Lines
    of a document that begin or end alike meet in a group; the most frequent of
    a group stands for it, and those within a small edit distance of it are
    readings of the same line, so no pairs are formed.  The line is a header if
    its readings stand in two chunks of the document and are set off, or are
    plain throughout and stand in ``PLAIN_HEADER`` chunks and ``PLAIN_SHARE`` of
    all; and if it is one in most of the documents that have it, which lets a
    series share its header and leaves phrases that documents repeat by chance.
    """
    ends = F.array(F.xxhash64(F.lit("<"), F.left("key", F.lit(_ENDS))), F.xxhash64(F.lit(">"), F.right("key", F.lit(_ENDS))))
    counts = (F.min("chunk_index").alias("c0"), F.max("chunk_index").alias("c1"), F.count("*").alias("n"), F.bool_and("plain").alias("plain"), F.bool_or("off").alias("off"))
    once = heads.groupBy("doc_id", "key", "chunk_index").agg(F.bool_and("plain").alias("plain"), F.bool_or("off").alias("off"))
    spread = once.groupBy("doc_id", "key").agg(*counts).withColumn("end", F.explode(ends))
    groups = spread.groupBy("doc_id", "end").agg(F.min("c0").alias("g0"), F.max("c1").alias("g1"), F.max(F.struct("n", "key"))["key"].alias("rep")).where("g0 < g1").select("doc_id", "end", "rep")
    near = spread.join(groups, ["doc_id", "end"]).where(F.levenshtein("key", "rep") <= F.greatest(F.lit(1), F.floor(F.length("rep") / F.when(F.col("off"), _MISREAD).otherwise(_PLAIN_MISREAD))))
    read = materialize(near.groupBy("doc_id", "key").agg(F.min("rep").alias("rep"), *(F.first(c).alias(c) for c in ("c0", "c1", "n", "plain", "off"))), "scan-heads")
    own = read.groupBy("doc_id", "rep").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.sum("n").alias("n"), F.bool_and("plain").alias("plain"), F.bool_or("off").alias("off"))
    own = own.where(f"c0 < c1 and (off or plain and n >= {PLAIN_HEADER})")
    sizes = lines.select("doc_id", "chunk_index").distinct().groupBy("doc_id").agg(F.count("*").alias("all"))
    own = own.join(sizes, "doc_id").where(F.col("off") | (F.col("n") >= F.col("all") * PLAIN_SHARE))
    own = materialize(own.select("doc_id", "rep", F.xxhash64("rep").alias("h")), "scan-own-lines")
    held = lines.join(own.select("h").distinct(), "h", "left_semi").select("doc_id", "h").distinct().groupBy("h").agg(F.count("*").alias("held"))
    mine = own.groupBy("h").agg(F.count("*").alias("mine")).join(held, "h").where(F.col("mine") > F.col("held") * _OWN).select("h")
    found = read.join(own.join(mine, "h", "left_semi"), ["doc_id", "rep"]).select("doc_id", "key")
    return heads.join(found, ["doc_id", "key"]).select("doc_id", "chunk_index", "line_no")


_NO_HEADER = re.compile(r"[.!?。,;:]$|^[-•▪*]\s")
_SCAN = "issuer string, doc_id string, chunk_index int, page boolean, hashes array<bigint>, at array<int>, keys array<string>, form array<int>, word string, n bigint"


def _forms(raw: list[str], keys: list[str]) -> Iterator[tuple[int, str, int]]:
    """(number, key, 1 if plain + 2 if set off) of the lines that may be running headers; plain is at a page edge and without digits.

    Page edges are the first two and the last two lines of a text that are not
    blank or a page number, and the lines next to a page number.
    """
    flat = [x.strip() for x in raw]
    full = [i for i, x in enumerate(flat) if x]
    pages = {i for i in full if flat[i][-1] in _PAGE_ENDS and is_page_number(flat[i])}
    kept = [i for i in full if i not in pages] if pages else full
    edges = {*kept[:2], *kept[-2:]}
    for k, i in enumerate(full):
        if i in pages:
            edges.update(full[max(0, k - 1):k + 2])
    for i in kept:
        line = flat[i]
        off = ("|" in line or "—" in line or "·" in line or "―" in line) and _SET_OFF.search(line) is not None
        if (off or i in edges) and len(keys[i]) >= MIN_LETTERS and _NO_HEADER.search(line) is None:
            plain = i in edges and _DIGITS.search(line) is None
            if off or plain:
                yield i, keys[i], plain + 2 * off


class _Keys(dict):
    """Table for ``str.translate``: letters in lower case and usual width, line ends as they are, all else out."""

    def __missing__(self, code: int) -> str | None:
        usual = chr(code - 0xFEE0 if 0xFF21 <= code <= 0xFF3A or 0xFF41 <= code <= 0xFF5A else code).lower()
        self[code] = out = usual if usual.isalpha() or usual == "\n" else "".join(filter(str.isalpha, usual)) or None
        return out


_KEYS = _Keys()
_LOWER = bytes(range(256)).lower()
_NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha() and c != 10)


def line_keys(text: str) -> list[str]:
    """Keys of the lines of a text, as ``source_lines.letters`` gives them.

    ASCII is sorted out as bytes; only lines that keep other signs, and texts with
    letters of full width, are walked character by character.
    """
    raw = text.encode("utf-8", "surrogatepass")
    if b"\xef\xbc" in raw or b"\xef\xbd" in raw:
        return text.translate(_KEYS).split("\n")
    rest = raw.translate(_LOWER, _NOT_LETTERS).decode("utf-8", "surrogatepass").lower()
    return [k if not k or k.isalpha() else k.translate(_KEYS) for k in rest.split("\n")]


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which for these many near-sorted numbers beats a hash table."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class _Vocabulary:
    """Numbers of texts by token.

    Words between spaces, digits as 9, are cut out, made numbers and counted once
    a text for a whole batch at a time; Python looks only at each kind of word,
    for its tokens, and remembers those.
    """

    def __init__(self) -> None:
        self.words: dict[str, tuple[int, ...]] = {}
        self.tokens: dict[str, int] = {}
        self.counts = np.zeros(1024, np.int64)

    def _of(self, word: str) -> tuple[int, ...]:
        found = [w for w in _TOKEN.findall(word) if len(w) < 40]  # what is longer is no word
        if "-" in word:
            found += [w for w in _COMPOUND.findall(word) if len(w) < 40]
        out = tuple({self.tokens.setdefault(w, len(self.tokens)) for w in found})
        if len(self.words) < _MEMORY and len(word) < 120:
            self.words[word] = out
        return out

    def add(self, texts: list[str]) -> None:
        if not texts:
            return
        given = pa.array(texts, pa.large_string())
        _, offsets, data = given.buffers()
        masked = pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_MASK)))
        parts = pc.ascii_split_whitespace(masked)
        coded = parts.flatten().dictionary_encode()
        kinds = coded.dictionary.to_pylist()
        of = [self.words.get(w) for w in kinds]
        of = [self._of(w) if x is None else x for w, x in zip(kinds, of, strict=True)]
        number = np.fromiter(map(len, of), np.int64, len(of))
        flat = np.fromiter(chain.from_iterable(of), np.int64, int(number.sum()))
        first = np.cumsum(number) - number
        text, word = np.divmod(_distinct(pc.list_parent_indices(parts).to_numpy() * len(kinds) + coded.indices.to_numpy()), len(kinds)) if kinds else (np.zeros(0, np.int64),) * 2
        n = number[word]
        token = flat[np.repeat(first[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        size = max(1, len(self.tokens))
        once = _distinct(np.repeat(text, n) * size + token) % size
        if size > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(size, np.int64)])
        self.counts += np.bincount(once, minlength=len(self.counts))

    def take(self) -> tuple[list[str], np.ndarray]:
        """The tokens counted so far and their numbers; counting begins anew."""
        names, counts = list(self.tokens), self.counts[:len(self.tokens)]
        self.__init__()
        return names, counts


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over all texts: the hashes of their lines' keys, and counts of words of the texts proper."""
    counts, texts = _Vocabulary(), 0
    schema = pa.schema([("issuer", pa.string()), ("doc_id", pa.string()), ("chunk_index", pa.int32()), ("page", pa.bool_()), ("hashes", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("keys", pa.list_(pa.string())), ("form", pa.list_(pa.int32())), ("word", pa.string()), ("n", pa.int64())])

    def words() -> pa.RecordBatch:
        names, numbers = counts.take()
        n = len(names)
        return pa.RecordBatch.from_arrays([*(pa.nulls(n, f.type) for f in list(schema)[:8]), pa.array(names, pa.string()), pa.array(numbers)], schema=schema)

    for batch in batches:
        hashes: list[list[int | None]] = []
        heads: tuple[list, list, list] = ([], [], [])
        for page, text in zip(*(batch.column(i).to_pylist() for i in (3, 4)), strict=True):
            for x in heads:
                x.append([])
            if text is None:
                hashes.append([])
                continue
            keys = line_keys(text)
            hashes.append([_signed(xxhash.xxh64_intdigest(k.encode(), 42)) if len(k) >= MIN_LETTERS else None for k in keys])
            if page:
                for found in _forms(text.split("\n"), keys):
                    for x, value in zip(heads, found, strict=True):
                        x[-1].append(value)
        given = batch.column(4).filter(pc.and_(batch.column(5), batch.column(4).is_valid())).to_pylist()
        counts.add(given)
        texts += len(given)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hashes, schema.types[4]), *(pa.array(x, t) for x, t in zip(heads, schema.types[5:8], strict=True)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], schema=schema)
        if len(counts.tokens) > 300_000:
            yield words()
    yield words()
    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:8]), pa.array([""]), pa.array([texts], pa.int64())], schema=schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def lexicon_of(scan: DataFrame) -> Lexicon:
    """Words and shapes of numbers with the number of texts in which they stand.

    Parts of words at broken lines count too; they are rare beside the whole
    words.  Only words of at least ``KEEP`` of the texts leave the cluster.
    """
    total = materialize(scan.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "scan-words")
    texts = int(total.where("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    kept = total.where((F.col("word") != "") & (F.col("n") >= max(LEAST_KEPT, KEEP * texts))).toPandas()
    words, shapes = {}, {}
    for w, n in zip(kept["word"], kept["n"], strict=True):
        (shapes if "9" in w else words)[w] = int(n)
    return Lexicon(words, shapes, texts)


def scan_repaired(chunks: DataFrame, issuers: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, text, kinds) of every text chunk of a PDF file.

    ``text`` is the repaired text, ``kinds`` the sorted kinds of damage found
    (character, header, linebreak, pagenum).  Null texts are left out, blank
    texts come out empty; repeated rows come out once per row, of differing ones
    each by itself; an empty table gives no rows.
    """
    spark = chunks.sparkSession
    proper = F.coalesce(F.col("chunk_type") == "text", F.lit(False))
    given = with_source(chunks.where("doc_id is not null and chunk_index is not null"), issuers).select("issuer", "doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), (proper & _is_pdf(F.col("doc_id"))).alias("page"), "text", proper.alias("proper"))
    scan = materialize(fit_parallelism(given).mapInArrow(_scan, _SCAN), "scan-pass")
    lexicon = spark.sparkContext.broadcast(_pack(lexicon_of(scan)))
    rows = scan.where("word is null")
    lines = rows.select("issuer", "doc_id", "chunk_index", "page", F.posexplode("hashes").alias("line_no", "h")).where("h is not null").withColumn("v", F.col("h"))
    source, _ = repeated_lines(chunks, issuers, lines=lines, docs=rows.select("issuer", "doc_id").distinct())
    heads = rows.where("page").select("doc_id", "chunk_index", F.explode(F.arrays_zip(F.col("at"), F.col("keys"), F.col("form"))).alias("f")).select("doc_id", "chunk_index", F.col("f.at").alias("line_no"), F.col("f.keys").alias("key"), (F.col("f.form") % 2 == 1).alias("plain"), (F.col("f.form") >= 2).alias("off"))
    own = header_lines(heads, lines.where("page").select("doc_id", "chunk_index", "h"))
    marks = own.withColumn("mark", F.lit(1)).unionByName(source.select("doc_id", "chunk_index", "line_no", F.lit(0).alias("mark")))
    # the marks of one text, at most two per line
    marks = marks.groupBy("doc_id", "chunk_index").agg(F.collect_set(F.col("line_no") * 2 + F.col("mark")).alias("marks"))
    pages = _texts(chunks).where(_is_pdf(F.col("doc_id"))).select("doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), "text")
    marked = pages.join(marks.hint("shuffle_hash"), ["doc_id", "chunk_index"], "left").select("doc_id", "chunk_index", "text", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _unpack(lexicon.value)
        for batch in batches:
            fixed, kinds = [], []
            for text, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                sources = {x // 2 for x in found or () if x % 2 == 0}
                headers = {x // 2 for x in found or () if x % 2} - sources
                new, kind = repair(text, headers, sources, known)
                fixed.append(new)
                kinds.append(sorted(kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fixed, pa.string()), pa.array(kinds, pa.list_(pa.string()))], ["doc_id", "chunk_index", "text", "kinds"])

    return marked.mapInArrow(run, "doc_id string, chunk_index int, text string, kinds array<string>")


_CACHE: dict[int, Lexicon] = {}


def _pack(lexicon: Lexicon) -> tuple[dict[str, int], dict[str, int], int]:
    return lexicon.counts, lexicon.shapes, lexicon.texts


def _unpack(packed: tuple[dict[str, int], dict[str, int], int]) -> Lexicon:
    if id(packed) not in _CACHE:
        _CACHE.clear()
        _CACHE[id(packed)] = Lexicon(*packed)
    return _CACHE[id(packed)]


def found(chunks: DataFrame, issuers: DataFrame) -> DataFrame:
    """One row per text chunk of a PDF file and kind of damage in it."""
    return scan_repaired(chunks, issuers).select("doc_id", "chunk_index", F.explode("kinds").alias("kind")).distinct()
