"""Noise of scanned pages: cut words, misread letters and page furniture.

Two averaged perceptrons are trained on sound passages of the same table into which
noise of known kind and place is put (at most ``TRAIN_ROWS`` passages, the first in
the order of a hash of the id). The line model tells furniture from text by what a
line holds and where on the page it stands. The editor goes through the characters of
each word that the corpus does not know and scores, for every place, keeping it
against replacing, deleting or inserting characters; for every mark at a line end it
scores keeping it against joining the lines, for every space between words that would
be one word together, keeping it against deleting it. What reads best wins. All these
operations are features of one perceptron, trained on words misread, cut and torn.

Which words the corpus knows is counted over all sound passages, that is those without
lines broken inside paragraphs; words seen ``LEAST_SEEN`` times are kept, however many
words there are in all, so the list that is sent around grows with the vocabulary.

Null and blank texts have no cases and stay as they are. Rows repeated under one id
count once in ``found``.
"""

from __future__ import annotations

import functools
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import session

TRAIN_ROWS = 600
LEAST_SEEN = 2
EPOCHS = 4
#: How usual (a power of 4) the rarest three letters of an unknown word are, from which on it isn't edited more than once.
USUAL_LETTERS = 2
MARKS = "-¬\xad=‐"

# What is misread as what (seen, meant).
CONFUSIONS = (
    ("é", "e"), ("è", "e"), ("á", "a"), ("à", "a"), ("í", "i"), ("ó", "o"), ("ú", "u"), ("f", "s"), ("ſ", "s"), ("b", "h"),
    ("h", "b"), ("c", "e"), ("e", "c"), ("n", "a"), ("a", "n"), ("ii", "n"), ("ii", "u"), ("!", "i"), ("!", "l"), ("0", "o"),
    ("cl", "d"), ("f", "t"), ("t", "f"), ("n", "u"), ("u", "n"), ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("rn", "m"),
    ("m", "rn"), ("li", "h"), ("6", "b"), ("q", "g"), ("g", "q"), ("9", "g"), ("vv", "w"), ("f", "e"), ("y", "v"), ("v", "y"),
    ("5", "s"), ("8", "b"), ("8", "s"), ("3", "e"), ("4", "a"), ("7", "t"), ("o", "e"), ("e", "o"), ("o", "c"), ("i", "l"),
    ("l", "i"), ("l", "t"), ("t", "l"), ("d", "cl"), ("h", "li"), ("w", "vv"), ("in", "m"), ("m", "in"), ("ni", "m"), ("nn", "m"),
    ("tl", "d"), ("fi", "h"), ("lc", "k"), ("ll", "u"), ("s", "f"), ("r", "n"), ("k", "h"), ("$", "s"), ("§", "s"), ("z", "2"),
    ("hc", "he"), ("tb", "th"),
)
_USUAL = frozenset(CONFUSIONS)
_WORD = re.compile(r"\|?[^\W_]+(?:[|!'’§$][^\W_]+)*\|?")
_COUNTED = re.compile(r"[^\W_]+(?:['’‑-][^\W_]+)*")
_ROMAN = re.compile(r"[ivxlcdm]+")
_UNITS = re.compile(r"\d+(?:s|d|l|st|nd|rd|th|mo|vo|to)?")
_LATIN = re.compile(r"[a-zß-öø-ɏſ0-9|!$§]+")
_SIGNS = re.compile(r"[0-9|!$§ſ]")
_BREAK = re.compile(r"(?<=[^\W_])([" + re.escape(MARKS) + r"])[ \t]*$")
_CUT_OR_LOWER = re.compile(r"[-¬\xad=‐][ \t]*\n|\n(?=[^\W\d_A-ZÀ-Þ])")
_WRAPPED = re.compile(r"[^\n]\n[^\n]")


# ---------------------------------------------------------------- perceptron


class Perceptron:
    """An averaged perceptron over named features."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.w: dict[str, float] = dict(weights or {})
        self._total: dict[str, float] = defaultdict(float)
        self._at: dict[str, int] = defaultdict(int)
        self._n = 0

    def score(self, features: list[str]) -> float:
        get = self.w.get
        return sum(get(f, 0.0) for f in features)

    def tick(self) -> None:
        self._n += 1

    def update(self, features: list[str], by: float) -> None:
        for f in features:
            now = self.w.get(f, 0.0)
            self._total[f] += (self._n - self._at[f]) * now
            self._at[f] = self._n
            self.w[f] = now + by

    def averaged(self) -> dict[str, float]:
        n = max(1, self._n)
        return {f: round((self._total[f] + (self._n - self._at[f]) * v) / n, 4) for f, v in self.w.items()}


# ---------------------------------------------------------------- page furniture

_NUMBER_LINE = re.compile(r"[\[(—–\-\s]*(?:\d{1,4}|[ivxl]{1,7})[\])—–\-.\s]*")
_PLAIN_NUMBER = re.compile(r"\d{1,2}")
_PAGE = re.compile(r"(?:page|pag|p)\.? ?\d{1,4}", re.I)
_SHEET = re.compile(r"(?:vol\. ?[ivxlc\d]+\.?\s+)?[A-Z]{1,2} ?\d", re.I)
_DATED = re.compile(r"\[?\s*(?:jan|feb|mar|apr|may|june?|july?|aug|sept?|oct|nov|dec)[a-z]*\.? ?\d{4}\.?\]?(?:\s+\d{1,4})?", re.I)
_NUMBERED = re.compile(r"\d{1,4}\s+\D.*|.*\D\s+\d{1,4}\.?")
_INDEX = re.compile(r"[^,]{2,40}(?:, \d+)+|.*\.{3,}\s*\d+|.*,.*;.*")
_PAGE_NUMBER = re.compile(r"^\d{1,4}\s+(?=\D)|(?<=\D)\s+\d{1,4}\.?$")
_UNREAD = str.maketrans("015|8!$", "olslbis")


def _letters(s: str) -> str:
    return re.sub(r"[\W\d_]", "", s.lower().translate(_UNREAD)).replace("f", "s").replace("e", "s")


def line_features(lines: list[str], k: int, title: str, author: str, n_numbers: int) -> list[str]:
    """The features of line k (not blank) of a passage."""
    s = lines[k].strip()
    before = next((x.strip() for x in reversed(lines[:k]) if x.strip()), "")
    after = next((x.strip() for x in lines[k + 1 :] if x.strip()), "")
    gap_before, gap_after = k > 0 and not lines[k - 1].strip(), k + 1 < len(lines) and not lines[k + 1].strip()
    letters = [c for c in s if c.isalpha()]
    upper = sum(c.isupper() for c in letters)
    number = bool(_NUMBER_LINE.fullmatch(s))
    f = ["bias"]
    caps = len(letters) >= 3 and upper >= 0.9 * len(letters)
    same = False
    if title and len(letters) >= 4:
        a, b = _letters(_PAGE_NUMBER.sub("", s)), _letters(title)
        a = a[2:] if a.startswith("os") and not b.startswith("os") else a
        same = len(b) >= 4 and (a == b or (b in a and len(a) <= len(b) + 3) or (len(a) >= 6 and a in b and len(a) >= 0.8 * len(b)))
    open_before = bool(before) and before[-1] not in ".!?”\"’»:;"
    lower_after = after[:1].islower()
    numbered = bool(_NUMBERED.fullmatch(s)) and len(s) < 64
    if number:
        f.append("number")
        if _PLAIN_NUMBER.fullmatch(s):
            f.append("number:short" + (":inside" if lower_after or (open_before and not after[:1].isupper()) else ":open" if open_before else ""))
            if int(s) > 20:
                f.append("number:big")
            elif not open_before and after[:1].isupper() and not gap_after and (gap_before or not before):
                f.append("number:stanza")
                if n_numbers >= 2 or int(s) == 1:
                    f.append("number:stanzas")
        if s[0] in "[(—–-":
            f.append("number:framed")
    if _PAGE.fullmatch(s):
        f.append("page")
    if _SHEET.fullmatch(s):
        f.append("sheet")
    if _DATED.fullmatch(s):
        f.append("dated")
    if caps:
        f.append("caps" + (":numbered" if numbered else ""))
    if same:
        f.append("title" + (":numbered" if numbered else ":caps" if caps else ""))
    if numbered and not number:
        f.append("numbered")
    if _INDEX.fullmatch(s):
        f.append("index")
    if open_before and lower_after:
        f.append("inside" + (":short" if len(s) < 50 else ":long"))
    elif open_before:
        f.append("open")
    if not before:
        f.append("first")
    if not after:
        f.append("last")
    if gap_before and gap_after:
        f.append("alone")
    if s[-1] in ".!?,;:":
        f.append("stopped")
    f.append("length:" + str(min(5, len(s) // 15)))
    words = sum(w.islower() for w in s.split())
    f.append("lower:" + str(min(4, words)))
    if number or _PAGE.fullmatch(s) or _SHEET.fullmatch(s) or _DATED.fullmatch(s) or same or caps:
        f.append("formed")
    else:
        f.append("unformed")
    return f


def _running_text(s: str) -> bool:
    """A line that can't be furniture: four small words or more and no number at either end."""
    if len(s) <= 20 or s[0].isdigit() or s[-1].isdigit():
        return False
    for most in (16, -1):  # mostly the first words tell
        n = 0
        for w in s.split(None, most):
            if w[0].islower():
                n += 1
                if n == 4:
                    return True
    return False


def furniture(text: str, title: str | None, author: str | None, weights: dict[str, float]) -> list[bool]:
    """Whether each line of the text (split at line feeds) is page furniture."""
    lines = text.split("\n")
    if len(lines) == 1:
        return [False]
    n_numbers = sum(bool(_PLAIN_NUMBER.fullmatch(x.strip())) and int(x) <= 20 for x in lines)
    out = []
    for k, line in enumerate(lines):
        s = line.strip()
        if not s or _running_text(s):
            out.append(False)
            continue
        out.append(sum(weights.get(f, 0.0) for f in line_features(lines, k, title or "", author or "", n_numbers)) > 0)
    return out


# ---------------------------------------------------------------- the editor


class Lexicon:
    """The words the corpus knows, and how usual their letters' sequences are."""

    def __init__(self, counts: dict[str, int]):
        self.n = counts
        self.tri: Counter[str] = Counter()
        for w in counts:
            if len(w) < 30:
                p = f"^{w}$"
                self.tri.update(p[i : i + 3] for i in range(len(p) - 2))

    def known(self, w: str) -> bool:
        if w in self.n:
            return True
        if w.endswith(("'s", "’s")):
            return w[:-2] in self.n
        if w.endswith(("s'", "s’")):
            return w[:-1] in self.n
        return False

    def rarest(self, w: str) -> int:
        """How often the rarest three-letter sequence of the word occurs among known words, as a power of 4."""
        p, get = f"^{w}$", self.tri.get
        return min(5, (min([get(p[i : i + 3], 0) for i in range(len(p) - 2)]) + 1).bit_length() // 2)


def edits(w: str) -> Iterator[tuple[str, str, int]]:
    """(word, operation, place) of each single operation of the editor on a word."""
    for seen, meant in CONFUSIONS:
        i = w.find(seen)
        while i >= 0:
            yield w[:i] + meant + w[i + len(seen) :], f"{seen}>{meant}", i
            i = w.find(seen, i + 1)


_ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def single_edits(w: str) -> Iterator[tuple[str, str, int]]:
    """(word, operation, place) of deleting, replacing or inserting any one letter, whether it is a usual confusion or not."""
    for i in range(len(w) + 1):
        left, right = w[:i], w[i:]
        if right:
            yield left + right[1:], f"{right[0]}>", i
            for c in _ALPHABET:
                if c != right[0]:
                    yield left + c + right[1:], f"{right[0]}>{c}", i
        for c in _ALPHABET:
            yield left + c + right, f">{c}", i


def join_features(a: str, mark: str, b: str, upper: bool, fixable: bool, lex: Lexicon) -> list[str]:
    """Of joining two parts (lower case) over a line end that a mark stands at."""
    joined, compound = lex.known(a + b), lex.known(f"{a}-{b}")
    plain = "-" if mark in "-‐" else "other"
    more = lex.n.get(a + b, 1) >= lex.n.get(f"{a}-{b}", 1)
    parts, long = f"{a in lex.n}:{b in lex.n}", len(a) > 3 and len(b) > 3
    return [
        "join", f"join:{plain}", f"join:{plain}:{joined}:{compound}", f"join:{plain}:{joined}:{compound}:{more}", f"join:{plain}:upper:{upper}:{joined}:{compound}",
        f"join:{plain}:{joined}:{compound}:{parts}:{long}", f"join:{plain}:{joined}:{compound}:fix:{fixable}:{parts}:{long}", f"join:{plain}:length:{min(4, len(a))}:{min(4, len(b))}:{joined}",
    ]


def space_features(a: str, b: str, fixable: bool, lex: Lexicon) -> list[str]:
    """Of deleting the space between two words (lower case) that are a known word together; ``fixable`` if the second is misread by itself."""
    ka, kb = lex.known(a), lex.known(b)
    often = min(8, lex.n.get(a + b, 1).bit_length() // 2)
    usual = lex.n.get(a, 0) > 50 * lex.n.get(a + b, 0)
    return ["space", f"space:{ka}:{kb}", f"space:{ka}:{kb}:often:{often}", f"space:{ka}:{kb}:length:{min(4, len(a))}:{min(4, len(b))}", f"space:{ka}:{kb}:usual:{usual}:fix:{fixable}"]


def _edit_features(w: str, v: str, op: str, at: int, lex: Lexicon, name: bool) -> list[str]:
    known, before, after = lex.known(v), lex.rarest(w), lex.rarest(v)
    digit = any(c.isdigit() or c in "|!$§ſ" for c in w) and not any(c.isdigit() or c in "|!$§ſ" for c in v)
    n = min(6, len(w) // 2)
    left, right = w[at - 1] if at else "^", w[at + len(op.split(">")[0])] if at + len(op.split(">")[0]) < len(w) else "$"
    usual = (seen_meant := tuple(op.split(">"))) in _USUAL
    f = [
        "edit", f"usual:{usual}:{known}:{n}", f"usual:{usual}:{name}", f"kind:{usual}:{len(seen_meant[0])}:{len(seen_meant[1])}", f"known:{known}", f"known:{known}:{n}", f"gain:{min(3, max(-3, after - before))}:{known}:{name}", f"before:{before}:{known}",
        f"op:{op}", f"op:{op}:{known}", f"left:{op}:{left}", f"right:{op}:{right}", f"name:{name}:{known}",
    ]
    if digit:
        f += ["digit", f"digit:{known}"]
    if known:
        f.append("count:" + str(min(8, lex.n.get(v, 1).bit_length() // 2)))
    return f


def best_edit(w: str, lex: Lexicon, weights: dict[str, float], name: bool, steps: int = 3) -> tuple[str, float] | None:
    """(corrected word, score) if the operations that read best beat keeping the word.

    Letters for letters must give a known word; only signs inside a word may give an
    unknown one. Of operations beyond the usual confusions one is tried by itself, in words of six letters or more. Where no single operation does, the four results whose letters' sequences
    are most usual are edited again.
    """
    if lex.known(w):
        return None
    get = weights.get

    def score(u: str, v: str, op: str, at: int) -> float:
        return sum(get(f, 0.0) for f in _edit_features(u, v, op, at, lex, name))

    best: tuple[float, str] | None = None
    frontier = {w: 0.0}
    for step in range(steps):
        tried: dict[str, tuple[str, str, int]] = {}
        for u, base in frontier.items():
            signs = bool(_SIGNS.search(u))
            for v, op, at in edits(u):
                if lex.known(v) or (signs and not _SIGNS.search(v)):
                    s = base + score(u, v, op, at)
                    if s > 0 and (best is None or (s, v) > best):
                        best = (s, v)
                elif v not in tried:
                    tried[v] = (u, op, at)
        if not step and best is None and len(w) > 5:  # shorter words have too many neighbours
            for v, op, at in single_edits(w):
                if v in lex.n:
                    s = score(w, v, op, at)
                    if s > 0 and (best is None or (s, v) > best):
                        best = (s, v)
        if (best and lex.known(best[1])) or step + 1 == steps:
            break
        if not step and best is None and lex.rarest(w) >= USUAL_LETTERS and not _SIGNS.search(w):
            break  # every letter stands where letters stand: no word with several misread ones
        usual = sorted(((-lex.rarest(v), v) for v in tried))[:4]
        frontier = {v: frontier[tried[v][0]] + score(tried[v][0], v, *tried[v][1:]) for _, v in usual}
    return (best[1], best[0]) if best else None


# ---------------------------------------------------------------- one passage


class Editor:
    """The trained models, applied to passages."""

    def __init__(self, counts: dict[str, int], line_weights: dict[str, float], edit_weights: dict[str, float]):
        self.lex, self.line_weights, self.edit_weights = Lexicon(counts), line_weights, edit_weights
        self.memo: dict[tuple[str, bool], tuple[str, float] | None] = {}
        self.joins: dict[tuple, bool] = {}
        self.sound_words: set[str] = set()  # as written; nothing to examine

    def misread(self, word: str) -> str | None:
        """The corrected word in lower case, if the word is misread."""
        w = word.lower().replace("’", "'")
        if len(w) < 2 or self.lex.known(w) or _UNITS.fullmatch(w) or not _LATIN.fullmatch(w.replace("'", "")) or w.isdigit():
            return None
        if _ROMAN.fullmatch(w) and len(w) < 8 and not w.endswith("li"):
            return None
        if not any(c.isalpha() for c in w):
            return None
        name = word[0].isupper() and not word.isupper()
        key = (w, name)
        if key not in self.memo:
            if len(self.memo) > 400_000:
                self.memo.clear()
            self.memo[key] = best_edit(w, self.lex, self.edit_weights, name)
        got = self.memo[key]
        return got[0] if got else None

    def cut(self, left: str, mark: str, right: str) -> bool:
        """Whether the mark at a line end between the two parts is not the word's own: joining reads better than keeping it."""
        a, b = left.lower().replace("’", "'"), right.lower().replace("’", "'")
        key = (a, mark, b, right[:1].isupper(), left[:1].isupper())
        if key not in self.joins:
            if len(self.joins) > 400_000:
                self.joins.clear()
            unknown = not self.lex.known(a + b) and not self.lex.known(f"{a}-{b}")
            fixable = unknown and a in self.lex.n and b in self.lex.n and self.misread(left + right) is not None
            get = self.edit_weights.get
            self.joins[key] = sum(get(f, 0.0) for f in join_features(a, mark, b, key[3], fixable, self.lex)) > 0
        return self.joins[key]

    def torn(self, a: str, b: str, second: str) -> bool:
        """Whether two words (lower case) are one word torn by a space."""
        if len(a) + len(b) <= 3 or a + b not in self.lex.n:
            return False
        get = self.edit_weights.get
        return sum(get(f, 0.0) for f in space_features(a, b, self.misread(second) is not None, self.lex)) > 0

    def examine(self, text: str, title: str | None = None, author: str | None = None) -> tuple[list[tuple[str, int]], list[tuple[int, int, str]]]:
        """(cases, replacements): cases are (kind, pos), replacements (begin, end, text) that repair them."""
        cases: list[tuple[str, int]] = []
        changes: list[tuple[int, int, str]] = []
        lines = text.split("\n")
        flags = furniture(text, title, author, self.line_weights)
        starts, at = [], 0
        for line in lines:
            starts.append(at)
            at += len(line) + 1
        for k, line in enumerate(lines):
            if flags[k]:
                cases.append(("line", starts[k] + len(line) - len(line.lstrip())))
                changes.append((starts[k], min(len(text), starts[k] + len(line) + 1), ""))
        carried = 0  # characters of the next line that belong to a word already seen
        for k, line in enumerate(lines):
            if flags[k] or not line.strip():
                continue
            begin, carried = carried, 0
            tail = _BREAK.search(line) if line.rstrip()[-1] in MARKS else None
            if not tail and not begin:
                seen = _WORD.findall(line)
                if self.sound_words.issuperset(seen):
                    continue
                fresh = [w for w in seen if w not in self.sound_words]
                if len(self.sound_words) > 400_000:
                    self.sound_words.clear()
                self.sound_words.update(w for w in fresh if self.lex.known(w.lower().replace("’", "'")))
                if self.sound_words.issuperset(seen):
                    continue
            spans = [(m.start(), m.end()) for m in _WORD.finditer(line, begin)]
            joined_to = None
            if tail and spans and spans[-1][1] == tail.start(1):
                n = next((j for j in range(k + 1, len(lines)) if lines[j].strip() and not flags[j]), None)
                if n is not None:
                    lead = len(lines[n]) - len(lines[n].lstrip())
                    m = _WORD.match(lines[n], lead)
                    left = line[spans[-1][0] : spans[-1][1]]
                    if m and self.cut(left, tail[1], m[0]):
                        joined_to = (n, m.start(), m.end())
                        cases.append(("break", starts[k] + tail.start(1)))
                        carried = m.end()
                    elif m and lead == m.start():
                        pass
            words = [(a, b, line[a:b]) for a, b in spans]
            skip = -1
            for j, (a, b, word) in enumerate(words):
                if j <= skip:
                    continue
                last = j + 1 == len(words)
                if last and joined_to:
                    n, lo, hi = joined_to
                    whole = word + lines[n][lo:hi]
                    fixed = self.misread(whole)
                    if fixed is not None:
                        cases.append(("char", starts[k] + a))
                        whole = _cased(fixed, whole)
                    # the whole word moves to the end of this line
                    changes.append((starts[k] + a, starts[k] + len(line), whole))
                    rest = re.match(r"[^\w\s]*", lines[n][hi:])[0]
                    changes.append((starts[n] + lo, starts[n] + hi + len(rest), ""))
                    if rest:
                        changes[-2] = (changes[-2][0], changes[-2][1], whole + rest)
                    continue
                low = word.lower().replace("’", "'")
                if not last and line[b : b + 1] == " " and words[j + 1][0] == b + 1 and (j + 2 < len(words) or not joined_to):
                    other = words[j + 1][2]
                    if other[0].islower() and not low.isdigit() and self.torn(low, other.lower().replace("’", "'"), other):
                        cases.append(("char", starts[k] + a))
                        changes.append((starts[k] + b, starts[k] + b + 1, ""))
                        skip = j + 1
                        continue
                fixed = self.misread(word)
                if fixed is None and word[-1] in "|!" :
                    word = word.rstrip("|!")
                if fixed is not None:
                    cases.append(("char", starts[k] + a))
                    changes.append((starts[k] + a, starts[k] + b, _cased(fixed, word)))
        return cases, changes

    def repaired(self, text: str, title: str | None = None, author: str | None = None) -> tuple[str, int]:
        """(the text as continuous paragraphs, number of cases); a text without cases is unchanged."""
        cases, changes = self.examine(text, title, author)
        if not cases:
            return text, 0
        out, at = [], 0
        for a, b, new in sorted(changes):
            if a < at:
                continue
            out += [text[at:a], new]
            at = b
        joined = "".join([*out, text[at:]])
        joined = re.sub(r"[ \t]+\n", "\n", joined)
        joined = re.sub(r"(?<=[^\s.!?:”\"»])\n\s*\n(?=\s*[a-zß-ÿ])", "\n", joined)
        paragraphs = [p for p in re.split(r"\n\s*\n", joined) if p.strip()]
        return "\n\n".join(_unwrapped(p) for p in paragraphs), len(cases)


def _cased(fixed: str, seen: str) -> str:
    if seen.isupper() and len(seen) > 1:
        return fixed.upper()
    return fixed[:1].upper() + fixed[1:] if seen[:1].isupper() else fixed


def _unwrapped(paragraph: str) -> str:
    """One line, unless its lines are verse or entries (most begin with a capital and end with a mark)."""
    lines = [x.strip() for x in paragraph.strip().split("\n") if x.strip()]
    own = sum(x[:1].isupper() or not x[:1].isalpha() for x in lines)
    marked = sum(x[-1] in ",;:.!?" for x in lines)
    if len(lines) > 1 and own >= 0.8 * len(lines) and marked >= 0.6 * len(lines):
        return "\n".join(lines)
    return " ".join(lines)


# ---------------------------------------------------------------- training


def sound(text: str | None) -> bool:
    """No line is broken inside a paragraph."""
    return bool(text) and not _WRAPPED.search(text)


def verse(text: str | None) -> bool:
    """Lines are broken, but each begins with a capital or a number, and none is cut by a mark."""
    return bool(text) and bool(_WRAPPED.search(text)) and not _CUT_OR_LOWER.search(text)


def with_parts(counts: dict[str, int]) -> dict[str, int]:
    """Counts by word in lower case, compounds counted with their parts as well."""
    out: Counter[str] = Counter()
    for w, n in counts.items():
        low = w.lower().replace("’", "'").replace("‑", "-")
        out[low] += n
        if "-" in low:
            for part in low.split("-"):
                out[part] += n
    return dict(out)


@functools.cache
def _roman(n: int) -> str:
    out = ""
    for v, r in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += r * (n // v)
        n %= v
    return out


def _header(rng: random.Random, title: str) -> str:
    n = rng.randint(1, 560)
    month = rng.choice("Jan Feb Mar Apr May June July Aug Sept Oct Nov Dec".split())
    name = rng.choice([title, title.upper(), f"Of {title}", f"SERMON {_roman(rng.randint(1, 60)).upper()}.", f"{title.upper()}.", f"LETTER {_roman(rng.randint(1, 90)).upper()}."])
    running = rng.choice([name, f"{name}      {n}", f"{name} {n}", f"{n} {name}"])
    number = rng.choice([str(n), f"[{n}]", f"({n})", f"— {n} —", f"- {n} -", f"[ {n} ]", _roman(rng.randint(1, 40))])
    mark = rng.choice([f"{rng.choice('ABCDEFGHIK')} {rng.randint(1, 6)}", f"Vol. {_roman(rng.randint(1, 20)).upper()}.   {rng.choice('ABCDEFGHIK')}{rng.randint(1, 6)}"])
    return rng.choice([running, running, number, number, mark, f"Page {n}", f"[{month}. {rng.randint(1690, 1795)}.{rng.choice([' ', '      '])}{n}"])


def page_of(text: str, title: str, rng: random.Random) -> tuple[list[str], list[bool]]:
    """(lines, whether each is furniture): a sound text set on a page."""
    width, lines = rng.randint(38, 76), []
    for k, paragraph in enumerate(re.split(r"\n\s*\n", text)):
        if k:
            lines.append("")
        for piece in paragraph.split("\n"):
            line = ""
            for word in piece.split():
                if line and len(line) + len(word) > width:
                    lines.append(line)
                    line = ""
                line = f"{line} {word}".strip()
            lines.append(line)
    flags = [False] * len(lines)
    for _ in range(rng.choice([1, 1, 2, 2, 3])):
        at = rng.randint(0, len(lines))
        block = [_header(rng, title) for _ in range(rng.choice([1, 1, 2]))]
        if rng.random() < 0.4:
            block = ["", *block, ""] if at else [*block, ""]
        lines[at:at] = block
        flags[at:at] = [bool(x) for x in block]
    return lines, flags


def train_lines(rows: list[tuple[str, str]], seed: int = 7) -> dict[str, float]:
    """Weights of the line model from sound (text, title) rows."""
    rng, model = random.Random(seed), Perceptron()
    pages = [page_of(t, title or "Untitled", rng) + (title or "Untitled",) for t, title in rows]
    # verse with numbered stanzas, whether the table has any or not
    for t, title in rows[1::6]:
        words = [w for w in _COUNTED.findall(t) if len(w) > 1][:48]
        lines = []
        for k in range(0, len(words), 6):
            if k % 24 == 0:
                lines += ([""] if lines else []) + [str(k // 24 + 1)]
            lines.append(" ".join(words[k : k + 6]).capitalize() + rng.choice([",", ";", ".", ","]))
        pages.append((lines, [False] * len(lines), title or ""))
    # stanza numbers, headings, indexes and contents are no furniture
    for t, title in rows[::5]:
        words = sorted({w.capitalize() for w in _COUNTED.findall(t) if len(w) > 3})
        entry = rng.choice([lambda w: f"{w}, {', '.join(str(rng.randint(1, 480)) for _ in range(rng.randint(1, 6)))}", lambda w: f"{w} {'.' * rng.randint(3, 20)} {rng.randint(1, 480)}", lambda w: f"{w}   {rng.randint(1, 99)}   {rng.randint(1, 99)}"])
        pages.append(([entry(w) for w in words[:30]], [False] * len(words[:30]), title or ""))
    for t, title in rows[::3]:
        stanzas = [x for x in re.split(r"\n\s*\n", t) if x.strip()]
        if len(stanzas) > 1 and "\n" in stanzas[0]:
            lines = "\n\n".join(f"{k + 1}\n" + re.sub(r"^\d+\. ", "", x) for k, x in enumerate(stanzas)).split("\n")
        else:
            lines = [f"Of {rng.choice(['Hope', 'Order', 'Peace'])} and {rng.choice(['Love', 'Duty', 'Fear'])}", "", *page_of(t, title or "", random.Random(seed))[0][:1], *t.split("\n")]
        pages.append((lines, [False] * len(lines), title or ""))
    for _ in range(EPOCHS):
        rng.shuffle(pages)
        for lines, flags, title in pages:
            n_numbers = sum(bool(_PLAIN_NUMBER.fullmatch(x.strip())) and int(x) <= 20 for x in lines)
            for k, flag in enumerate(flags):
                if not lines[k].strip() or _running_text(lines[k].strip()):
                    continue
                f = line_features(lines, k, title, "", n_numbers)
                model.tick()
                if (model.score(f) > 0) != flag:
                    model.update(f, 1.0 if flag else -1.0)
    return model.averaged()


def train_editor(words: Counter, lex: Lexicon, seed: int = 11, n: int = 12_000) -> dict[str, float]:
    """Weights of the editor from words of sound text, some of them misread at random."""
    rng, model = random.Random(seed), Perceptron()
    pool = sorted(w for w in words if w.isalpha() and len(w) > 2)
    weights = [min(words[w], 200) for w in pool]
    back = defaultdict(list)
    for seen, meant in CONFUSIONS[:52]:
        back[meant].append(seen)
    sample = rng.choices(pool, weights, k=n) if pool else []
    for _ in range(2):
        for word in sample:
            w = word.lower()
            spots = [(m, i) for m in back for i in range(len(w)) if w.startswith(m, i)]
            hidden = rng.random() < 0.25  # as if the corpus did not know the word
            wrong = bool(spots) and rng.random() < 0.6
            seen = w
            if wrong and rng.random() < 0.1:  # a letter lost, doubled or taken for any other
                i = rng.randrange(len(w))
                seen = w[:i] + rng.choice(("", w[i] * 2, rng.choice(_ALPHABET))) + w[i + 1 :]
            elif wrong:
                meant, i = rng.choice(spots)
                seen = w[:i] + rng.choice(back[meant]) + w[i + len(meant) :]
            count = lex.n.pop(w, None) if hidden else None
            if not lex.known(seen):
                name = word[0].isupper()
                found = [(v, _edit_features(seen, v, op, at, lex, name)) for v, op, at in edits(seen)]
                found += [(v, _edit_features(seen, v, op, at, lex, name)) for v, op, at in single_edits(seen) if v in lex.n]
                scored = max(((model.score(f), v, f) for v, f in found), default=(0.0, "", []))
                guess = scored if scored[0] > 0 else (0.0, seen, [])
                model.tick()
                if guess[1] != w:
                    gold = next((f for v, f in found if v == w), []) if wrong else []
                    model.update(gold, 1.0)
                    model.update(guess[2], -1.0)
            if count is not None:
                lex.n[w] = count
    return model.averaged()


def _hidden(lex: Lexicon, words: list[str]) -> dict[str, int]:
    """Takes words out of the lexicon, as if the corpus did not know them; returns what to put back."""
    return {w: lex.n.pop(w) for w in words if w in lex.n}


def train_joins(rows: list[tuple[str, str]], lex: Lexicon, weights: dict[str, float], seed: int = 13, n: int = 6_000) -> dict[str, float]:
    """Weights of joining lines and of deleting spaces, beside those of the editor.

    Words of sound text are cut at marks or torn at spaces, some of them misread or unknown
    besides; compounds are broken at their own hyphens, and words that follow each other in
    the text, or are words by themselves, are left apart.
    """
    rng, model = random.Random(seed), Perceptron()
    editor = Editor(lex.n, {}, weights)
    editor.lex = lex
    words, pairs = Counter(), Counter()
    for t, _ in rows:
        found = _COUNTED.findall(t)
        words.update(found)
        pairs.update((a.lower(), b) for a, b in zip(found, found[1:]) if b[0].islower() and len(a) + len(b) > 3 and (a + b).lower() in lex.n)
    whole = sorted(w for w in words if w.isalpha() and len(w) > 3)
    compounds = sorted(w for w in words if w.count("-") == 1 and all(len(x) > 1 for x in w.split("-")))
    if not whole:
        return {}
    usual = rng.choices(whole, [min(words[w], 200) for w in whole], k=n)
    back = defaultdict(list)
    for seen, meant in CONFUSIONS[:52]:
        back[meant].append(seen)

    def learn(features: list[str], right: bool) -> None:
        model.tick()
        if (model.score(features) > 0) != right:
            model.update(features, 1.0 if right else -1.0)

    def join(left: str, mark: str, right: str, truth: bool) -> None:
        a, b = left.lower(), right.lower()
        unknown = not lex.known(a + b) and not lex.known(f"{a}-{b}")
        fixable = unknown and a in lex.n and b in lex.n and editor.misread(left + right) is not None
        learn(join_features(a, mark, b, right[:1].isupper(), fixable, lex), truth)

    for _ in range(2):
        for k, w in enumerate(usual):
            low, i = w.lower(), rng.randint(2, len(w) - 2) if len(w) > 4 else 2
            away = _hidden(lex, [low] if rng.random() < 0.2 else [])
            seen = w
            spots = [(m, j) for m in back for j in range(len(low)) if low.startswith(m, j)]
            if spots and rng.random() < 0.12:
                m, j = rng.choice(spots)
                seen = w[:j] + rng.choice(back[m]) + w[j + len(m) :]
            if 1 < i < len(seen) - 1:
                join(seen[:i], rng.choice("----" + MARKS), seen[i:], True)
            lex.n.update(away)
            if k % 3 == 0 and compounds:
                c = rng.choice(compounds)
                away = _hidden(lex, [c.lower()] if rng.random() < 0.3 else [])
                left, right = c.split("-")
                join(left, "-", right, False)
                lex.n.update(away)
            if low in lex.n:
                a, b = low[:i], low[i:]
                learn(space_features(a, b, editor.misread(b) is not None, lex), not (lex.known(a) and lex.known(b)))
        for a, b in sorted(pairs):
            learn(space_features(a, b.lower(), editor.misread(b) is not None, lex), False)
    return model.averaged()


def train_all(rows: list[tuple[str, str]], lex: Lexicon) -> dict[str, float]:
    """Weights of all the editor's operations."""
    sample: Counter[str] = Counter()
    for t, _ in rows:
        sample.update(_COUNTED.findall(t))
    weights = train_editor(sample, lex)
    return weights | train_joins(rows, lex, weights)


def word_counts(df: DataFrame) -> DataFrame:
    """(word, n) over all sound texts, as written, seen LEAST_SEEN times or more; a word of verse counts a tenth."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if sound(t):
                    for w, n in Counter(_COUNTED.findall(t)).items():
                        total[w] += 10 * n
                elif verse(t):
                    total.update(_COUNTED.findall(t))
            if len(total) > 300_000:
                yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())})
                total.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    session.ship(df.sparkSession)
    counted = session.materialise(df.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "scan-words")
    return counted.where(F.col("n") >= 10 * LEAST_SEEN).select("word", (F.col("n") / 10).cast("bigint").alias("n"))


def training_rows(passages: DataFrame, n: int = TRAIN_ROWS) -> list[tuple[str, str]]:
    """(text, title) of the first ``n`` sound passages by a hash of the id, hymns among them.

    The rows are chosen in each task and only ``n`` of them are ever moved; a row repeated
    under one id may stand for another passage of the sample.
    """
    is_sound = F.col("text").isNotNull() & ~F.col("text").rlike(r"[^\n]\n[^\n]") & (F.length("text") > 200)
    verse = F.col("text").rlike(r"^[^\n]{10,60}\n[^\n]{10,60}\n[^\n]{10,60}\n[^\n]{10,60}(\n\n|$)")
    pick = lambda rows, k: [(r.text, r.title) for r in {r.id: r for r in rows.select("id", "text", "title").orderBy(F.xxhash64("id"), "id", "text", "title").limit(k).collect()}.values()]
    return pick(passages.where(is_sound), n) + pick(passages.where(verse), n // 4)


def train(passages: DataFrame, edit: bool = True) -> Editor:
    """Train both models on a bounded sample of sound passages; words are counted over all of them."""
    rows = training_rows(passages)
    lines = train_lines(rows)
    if not edit:
        return Editor({}, lines, {})
    written = {r.word: r.n for r in word_counts(passages).toLocalIterator()}
    counts = with_parts(written)
    return Editor(counts, lines, train_all(rows, Lexicon(dict(counts))))


def prepared(df: DataFrame) -> DataFrame:
    """The columns the operator reads: id, text, title."""
    return df.select(F.col("id").cast("string").alias("id"), "text", F.col("source_title").alias("title"))


def found(passages: DataFrame, sample: DataFrame) -> DataFrame:
    """(id, kind, pos) of every case in the passages whose id is in ``sample`` (one column, id)."""
    spark = passages.sparkSession
    session.ship(spark)
    rows = prepared(passages)
    shared = spark.sparkContext.broadcast(train(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor = shared.value
        for b in batches:
            ids, kinds, places = [], [], []
            for i, t, title in zip(*(b.column(k).to_pylist() for k in range(3))):
                for kind, pos in sorted(set(editor.examine(t, title)[0])):
                    ids.append(i)
                    kinds.append(kind)
                    places.append(pos)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(kinds, pa.string()), pa.array(places, pa.int32())], names=["id", "kind", "pos"])

    wanted = rows.where("text is not null").join(sample.select("id").distinct(), "id").groupBy("id").agg(F.min(F.struct("text", "title")).alias("r")).select("id", "r.text", "r.title")
    return wanted.mapInArrow(run, "id string, kind string, pos int")


def repaired(passages: DataFrame) -> DataFrame:
    """(id, text, n_cases) of every row: repaired where it has cases, unchanged where it has none."""
    spark = passages.sparkSession
    session.ship(spark)
    rows = prepared(passages)
    shared = spark.sparkContext.broadcast(train(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor = shared.value
        for b in batches:
            done = [editor.repaired(t, title) if t else (t, 0) for t, title in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], names=["id", "text", "n_cases"])

    return rows.mapInArrow(run, "id string, text string, n_cases int")
