"""Text statistics of each passage and the structure they show.

A text is described by four distributions: of its words over kinds (function word of
its language, other word, name, number, code, consonant string, navigation word ...), of
its words over the marks they end with, of its lines over endings and columns, and of its
characters over classes. Each is compared,
by Jensen-Shannon divergence, with structural profiles: prose of the text's own language
(told by its function words), in paragraphs, wrapped lines or verse; and lists, tables
and junk of many shapes. The prose profiles are stated below by language; the others are
computed from texts that a generator makes of meaningless syllables, so that they hold
the shape and no vocabulary. The nearest profile gives the verdict. A text whose runs of
three words mostly repeat is not prose of any language.

Blank and null texts have no words and the verdict 'blank'. Repeated rows are
described each; the ``found`` result counts ids once.
"""

from __future__ import annotations

import functools
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import session

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": """
        a an the and or but nor for yet so of in on at to from by with about into over under between through before after as if than that this these those is are was were be been am
        have has had do did not no he she it we they you i me him them his her their our your my its who whom which what when where how why there all any some such only very shall will
        would could may might must can let thy thee thou ye hath unto upon while because until although whenever though neither
    """,
    "de": """
        der die das den dem des ein eine einen einem einer eines und oder aber in im an am auf aus bei mit nach von vom vor zu zum zur über unter um für durch gegen ohne ist war sind waren
        hat haben wird werden nicht kein keine auch nur noch so wie als wenn dass daß er sie es wir ihr ich sich sein seine ihre was wer wo warum
    """,
    "fr": """
        le la les l un une des du de d et à au aux en dans sur sous pour par avec sans est était sont fut a ont son sa ses leur leurs ce cette ces qui que qu quand où pourquoi il elle ils on
        nous vous je ne pas plus mais ou comme se si tout
    """,
    "es": """
        el la los las un una unos unas y o de del al a en por para con sin su sus es era son fue qué que quién quien cuando como donde se lo le les no más pero si yo él ella ellos este esta
        esto ya muy también hay ha
    """,
    "la": "et in ex cum sine ad ab a e de per pro non est sunt erat ut quam cur suos suas sua suum autem sed qui quae quod si nec neque enim vel aut ante post inter propter hic haec hoc atque etiam",
    "it": "il lo la i gli le un uno una e ed o di del della dei delle da dal in nel nella con su sul per tra fra a al alla è era sono non che chi come quando dove si ma se suo sua suoi più anche ha",
    "pt": "o a os as um uma e ou de do da dos das em no na nos nas por para com sem que quem quando como onde se não mais mas é era são foi ao à seu sua seus suas ele ela eles também já há",
    "nl": "de het een en of in op aan van voor met naar uit bij door over onder tegen zonder te is was zijn waren had heeft hebben niet geen ook maar als dat die dit wie wat waar hij zij ze wij ik u je er om zo nog",
}
LANGUAGES = tuple(FUNCTION_WORDS)
_LANGUAGES_OF: dict[str, int] = {}
for _k, _words in enumerate(FUNCTION_WORDS.values()):
    for _w in _words.split():
        _LANGUAGES_OF[_w] = _LANGUAGES_OF.get(_w, 0) | 1 << _k
NAVIGATION = frozenset("""
    menu home login logout register subscribe search share print next prev previous back top copyright notice cookies privacy
    policy terms contact sitemap comments reply tweet follow skip click continue page pages download link links tags archive
    archives categories advertisement loading sign basket cart checkout account help map accessibility settings newsletter
""".split())
TITLES = frozenset("mr mrs miss ms dr rev revd capt lieut col gen esq messrs sir lady hon prof sr sra hr frau m mme fr bro jun sen".split())
WORD_KINDS = ("function", "plain", "name", "capitals", "number", "code", "consonants", "symbol", "broken", "title", "other_script", "navigation", "letter")
LINE_KINDS = ("stop", "comma", "semicolon", "open", "columns", "bullet", "entry", "short")
END_KINDS = ("none", "comma", "semicolon", "stop", "other")
CHAR_KINDS = ("lower", "upper", "digit", "space", "stop", "mark", "other_letter", "other")

_BROKEN = re.compile("[�\u0080-\u009f]|â€|Ã[\u0080-ÿ]|Â[ -¿]|ï¿½")
_NUMBER = re.compile(r"[£$€(\[]*\d[\d.,:/\-–]*(?:[%)\].,;:]|[slbd]\b|st|nd|rd|th)*")
_VOWEL = re.compile("[aeiouyàâäáãåæèéêëìíîïòóôöõøùúûüœ]")
_COLUMNS = re.compile(r"\S(?:\t|[ ]{3,}|[ ]?\|[ ]?)\S")
_BULLET = re.compile(r"\s*(?:[•·*\-–—▪◦»>]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+\S")
_ENTRY = re.compile(r"[^,.;:!?]{1,40}(?:,\s*\d[\d, .–-]*|\s*\.{2,}\s*\d+|\s+--\s+[^.]{1,60}\.?)$|\s+see\s")
_ENUMERATOR = re.compile(r"\(?(?:[a-zA-Z]|[ivx]{1,4}|\d{1,2})\)")
_DIGITS = re.compile(r"0\d{2,}|\d{7,}")
_MIXED = re.compile(r"[a-z][A-Z]\w*[a-z][A-Z]|^[a-z]+[A-Z]")
_COMPOUND = re.compile(r"[^\W\d_]+(?:[.'’\-–—,]+[^\W\d_]+)*[.'’\-–—,]*")
_LETTERS = re.compile(r"[\W\d_]+")
_EDGE = "\"'“”‘’«»„()[]{}.,;:!?…¿¡*_"


def word_kind(token: str) -> int:
    """The number in WORD_KINDS of a white-space token; -1 for a mark set apart by spaces."""
    if _BROKEN.search(token):
        return 8
    if _ENUMERATOR.fullmatch(token):
        return 7
    w = token.strip(_EDGE)
    if not w:
        return -1 if len(token) == 1 and token in "«»“”„\"':;!?—–" else 7
    if _DIGITS.fullmatch(w):
        return 5
    if _NUMBER.fullmatch(w):
        return 4
    low = w.lower()
    if low in _LANGUAGES_OF:
        return 0
    if low in TITLES:
        return 9
    if low in NAVIGATION:
        return 11
    if not any(c.isalnum() for c in w):
        return 7
    if any(c.isdigit() for c in w) or _MIXED.search(w):
        return 5
    first = next(c for c in w if c.isalpha()) if any(c.isalpha() for c in w) else w[0]
    if first > "ɏ" and not "Ḁ" <= first <= "ỿ":
        return 10
    if len(w) == 1:
        return 12
    if not _VOWEL.search(low) or (not low.replace("'", "").replace("’", "").replace("-", "").isalpha() and not _COMPOUND.fullmatch(low)):
        return 6
    if w.isupper() and len(w) > 1:
        return 3
    return 2 if first.isupper() else 1


@functools.lru_cache(maxsize=1)
def _memo() -> dict[str, tuple[int, str, int, int]]:
    """(word kind, letters in lower case, languages of which it is a function word, kind of its end) by token."""
    return {}


@functools.cache
def _char_table() -> np.ndarray:
    out = np.full(0x10000, 7, np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isspace():
            out[c] = 3
        elif ch.isalpha():
            out[c] = 6 if c > 0x24F else (1 if ch.isupper() else 0)
        elif ch.isdigit():
            out[c] = 2
        elif ch in ".!?,;:'\"’‘“”-–—()«»„…¿¡":
            out[c] = 4
        elif ch.isascii():
            out[c] = 5
        elif c > 0x300:
            out[c] = 6
    return out


def _line_kind(line: str) -> int:
    s = line.strip()
    if len(_COLUMNS.findall(line)) >= 1:
        return 4
    if _BULLET.match(line) and len(s) < 90 and not (len(s) > 45 and s[-1] in ".!?"):
        return 5
    if _ENTRY.match(line):
        return 6
    end = s[-1]
    if end in "\"'”’»)]" and len(s) > 1:
        end = s[-2]
    if end in ".!?…。！？؟።፧।॥":
        return 0
    if end == ",":
        return 1
    if end in ";:；：؛፤·":
        return 2
    return 3 if len(s) >= 30 else 7


def _end_kind(token: str) -> int:
    end = token[-1]
    if end in "\"'”’»)]" and len(token) > 1:
        end = token[-2]
    return 1 if end in ",،、，፣" else 2 if end in ";:；：؛፤·" else 3 if end in ".!?…。！？؟።፧।॥" else 0 if end.isalnum() else 4


def describe(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, list[int], float, int, np.ndarray]:
    """Counts over WORD_KINDS, LINE_KINDS, CHAR_KINDS; the number of words, the kinds of the lines, the repetition, the language's number; counts over END_KINDS.

    Function words of other languages than the text's (or its two, if the second has a
    third of the first's) count as plain words; the language is -1 if there are none.
    Repetition: the greater of the share of the words that repeat one of the three most
    frequent ones (numbers and marks taken off) and of the runs of three words that stood
    before; 0 for fewer than 12 words.
    """
    memo = _memo()
    if len(memo) > 1_000_000:
        memo.clear()
    sequence = text.split() if text else []
    tokens = Counter(sequence)
    words, stems, by_language, shared, ends = [0] * len(WORD_KINDS), {}, [0] * len(LANGUAGES), [], [0] * len(END_KINDS)
    for token, n in tokens.items():
        k = memo.get(token)
        if k is None:
            kind = word_kind(token)
            k = memo[token] = (kind, _LETTERS.sub("", token).lower(), _LANGUAGES_OF.get(token.strip(_EDGE).lower(), 0) if kind == 0 else 0, _end_kind(token))
        if k[0] >= 0:
            words[k[0]] += n
        ends[k[3]] += n
        stems[k[1]] = stems.get(k[1], 0) + n
        if k[2]:
            shared.append((k[2], n))
            for i in range(len(LANGUAGES)):
                if k[2] >> i & 1:
                    by_language[i] += n
    language = -1
    if shared:
        order = sorted(range(len(LANGUAGES)), key=by_language.__getitem__, reverse=True)
        language = order[0]
        own = 1 << order[0] | (1 << order[1] if 3 * by_language[order[1]] >= by_language[order[0]] else 0)
        foreign = sum(n for mask, n in shared if not mask & own)
        words[0] -= foreign
        words[1] += foreign
    n_words = len(sequence)
    stems.pop("", None)
    repeats = 0.0
    if n_words >= 12 and stems:
        repeats = sum(n - 1 for n in sorted(stems.values())[-3:]) / sum(stems.values())
        if n_words >= 20 and len(tokens) < 0.5 * n_words:
            runs = len(sequence) - 2
            # refrains repeat runs, too: they count for a little less
            repeats = max(repeats, 0.88 - len(set(zip(sequence, sequence[1:], sequence[2:]))) / runs)
    layout, kinds = [0] * len(LINE_KINDS), []
    for line in (text or "").split("\n"):
        if line and not line.isspace():
            kinds.append(_line_kind(line))
            layout[kinds[-1]] += len(line)
    flat = np.frombuffer((text or "").encode("utf-16-le", "surrogatepass"), np.uint16)
    chars = np.bincount(_char_table()[flat], minlength=len(CHAR_KINDS))
    return np.array(words, float), np.array(layout, float), chars.astype(float), n_words, kinds, repeats, language, np.array(ends, float)


def _entropy(p: np.ndarray) -> np.ndarray:
    return -(p * np.log2(np.maximum(p, 1e-300))).sum(-1)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence (bits) of the rows of two arrays of distributions."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return (a + b) / 2


# ---------------------------------------------------------------- profiles

# About how the words of running prose divide over function words, other words, names, numbers and titles,
# by language; "other" is a language in an alphabet with spaces whose function words are not listed.
_PROSE_WORDS = {
    "en": (0.43, 0.45, 0.09, 0.02, 0.01), "de": (0.40, 0.33, 0.24, 0.02, 0.01), "fr": (0.42, 0.45, 0.10, 0.02, 0.01), "es": (0.44, 0.43, 0.10, 0.02, 0.01),
    "la": (0.24, 0.62, 0.11, 0.02, 0.01), "it": (0.40, 0.47, 0.10, 0.02, 0.01), "pt": (0.42, 0.45, 0.10, 0.02, 0.01), "nl": (0.45, 0.44, 0.08, 0.02, 0.01), "other": (0.02, 0.83, 0.12, 0.02, 0.01),
}
#: How the characters of lines divide over the endings of LINE_KINDS: paragraphs, wrapped lines, verse, verse without marks.
_PROSE_LINES = ((0.97, 0.0, 0.01, 0.01, 0.0, 0.0, 0.0, 0.01), (0.22, 0.1, 0.03, 0.6, 0.0, 0.0, 0.0, 0.05), (0.25, 0.4, 0.2, 0.1, 0.0, 0.0, 0.0, 0.05), (0.15, 0.2, 0.1, 0.25, 0.0, 0.0, 0.0, 0.3))
_PROSE_CHARS = ((0.76, 0.025, 0.005, 0.175, 0.03, 0.0, 0.0, 0.005), (0.71, 0.06, 0.03, 0.16, 0.035, 0.0, 0.0, 0.005), (0.02, 0.003, 0.005, 0.16, 0.04, 0.0, 0.77, 0.002), (0.0, 0.0, 0.01, 0.005, 0.09, 0.0, 0.89, 0.005))
SAMPLES = 6  # generated texts a shape
_SYLLABLES = "ba be bi bo cal cor dan del dor fen gar gil har hol ka kin lan len lor mar mel min mor nar nel nor pan per pol ran rel rin ros sal ser sil tan tel tor val ven wil win".split()


def _generated(seed: int = 5) -> list[tuple[str, list[str]]]:
    """(verdict, texts) of each structural shape. Words are made of syllables: the shapes know no vocabulary but that of menus."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(_SYLLABLES) for _ in range(rng.choice((1, 2, 2, 3))))
    name = lambda: word().capitalize()
    small = lambda: rng.choice(("of", "and", "the", "in", "for", "with"))
    num = lambda top=480: str(rng.randint(1, top))
    title = lambda: rng.choice(("Mr.", "Mrs.", "Dr.", "Rev.", "Capt.", "Miss", "Sir"))
    phrase = lambda a=1, b=4: " ".join(word() for _ in range(rng.randint(a, b)))
    topic = lambda: rng.choice((f"Of {name()}", f"{name()} and {name()}", f"On {name()} {small()} {name()}", f"The {name()} of {name()}", name()))
    price = lambda: rng.choice((f"£{num(40)}", f"${num(99)}.{rng.randint(10, 99)}", f"{num(30)}s", f"{num(20)}.{num(19)}.{num(11)}", f"{num(40)}.{rng.randint(0, 9)}", f"{num(99)}%", f"€{num(90)}"))
    roman = lambda k: "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split()[k % 20]
    many = lambda f, a=6, b=18, sep="\n": sep.join(f(k) for k in range(rng.randint(a, b)))
    end = lambda: rng.choice(("", "", ";", ",", "."))
    pages = lambda: ", ".join(num() for _ in range(rng.randint(1, 5)))
    cells = lambda sep, n=3, first=name, cell=num: sep.join((first(), *(cell() for _ in range(n))))
    noise = lambda chars, a=2, b=7: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    menu = sorted(NAVIGATION)
    item = lambda: rng.choice(menu).capitalize()
    shapes: list[tuple[str, Callable[[], str]]] = [
        ("list", lambda: many(lambda k: f"• {phrase()}{end()}")),
        ("list", lambda: many(lambda k: f"- {num(20)} {phrase(1, 3)}{end()}")),
        ("list", lambda: many(lambda k: f"* {topic()}{end()}")),
        ("list", lambda: many(lambda k: f"{k + 1}. {topic()}{end()}")),
        ("list", lambda: many(lambda k: f"{k + 1}) {phrase(2, 5)}{end()}")),
        ("list", lambda: many(lambda k: f"({roman(k)}) {phrase(1, 4)}{end()}")),
        ("list", lambda: many(lambda k: f"({'abcdefghijklmnopqrst'[k % 20]}) {num(9)} {phrase(2, 3)}{end()}")),
        ("list", lambda: many(lambda k: f"{roman(k).upper()}. {topic()}")),
        ("list", lambda: many(lambda k: f"{name()}, {pages()}")),
        ("list", lambda: many(lambda k: f"{name()}, {word()} {small()}, {pages()}")),
        ("list", lambda: many(lambda k: f"{name()}, {pages()}", sep=" ")),
        ("list", lambda: many(lambda k: f"{name()}\n   see {word()}, {word()}")),
        ("list", lambda: many(lambda k: f"Chapter {roman(k).upper()}. {topic()} {'.' * rng.randint(4, 18)} {num()}")),
        ("list", lambda: many(lambda k: f"{topic()} {'. ' * rng.randint(4, 12)}{num()}")),
        ("list", lambda: many(lambda k: f"{rng.choice(('Sect', 'Ch', 'Part', 'Letter'))}. {roman(k)}. Of {word()} {rng.choice(('and', 'or', 'in'))} {word()} {'.' * rng.randint(4, 18)} {num()}")),
        ("list", lambda: many(lambda k: f"{phrase(1, 4)} {'.' * rng.randint(4, 18)} {num()}")),
        ("list", lambda: many(lambda k: f"{title()} {name()} {name()}, {name()}")),
        ("list", lambda: many(lambda k: f"{name()}, {name()} {rng.choice('ABCDEFG')}.")),
        ("list", lambda: many(lambda k: f"{name()} {name()}")),
        ("list", lambda: "Present: " + many(lambda k: f"{title()} {name()} {name()}, {name()}", sep="; ") + "."),
        ("list", lambda: many(lambda k: f"{title()} {name()} {name()}, {name()}", sep="; ") + "."),
        ("list", lambda: many(lambda k: f"{name()} {name()}", sep=", ") + "."),
        ("list", lambda: many(lambda k: f"{name()} {rng.choice(('--', '—', ':', '–'))} {phrase(1, 3)}, {word()}.")),
        ("list", lambda: many(lambda k: f"{name()}: {phrase(1, 3)}")),
        ("list", lambda: many(lambda k: phrase(1, 2), 12, 30, "; ") + "."),
        ("list", lambda: many(lambda k: phrase(1, 2), 14, 30, ", ") + "."),
        ("list", lambda: many(lambda k: name(), 10, 24)),
        ("list", lambda: many(lambda k: name(), 10, 24, ", ")),
        ("list", lambda: many(lambda k: name(), 10, 24, "; ")),
        ("list", lambda: many(lambda k: word(), 10, 24, ", ")),
        ("list", lambda: many(lambda k: word(), 10, 24, "; ")),
        ("list", lambda: many(lambda k: f"{name()} {'.' * rng.randint(4, 12)} {pages()}")),
        ("list", lambda: f"{name()}: " + many(lambda k: f"{name()} {name()}", sep="; ")),
        ("list", lambda: many(lambda k: phrase(1, 2))),
        ("list", lambda: many(lambda k: phrase(1, 1))),
        ("list", lambda: many(lambda k: f"{num(12)} {phrase(1, 2)} of {word()}")),
        ("list", lambda: many(lambda k: f"{num(12)} {phrase(1, 2)}")),
        ("list", lambda: many(lambda k: f"{topic()}  {num()}")),
        ("list", lambda: many(lambda k: f"{topic()} {num()}")),
        ("list", lambda: many(lambda k: f"{topic()} {num()}", sep=". ")),
        ("list", lambda: many(lambda k: f"{'ABCDEFGHIJKLMNOPQRST'[k % 20]}) {phrase(1, 2)}", sep=" ")),
        ("list", lambda: many(lambda k: f"{k + 1}. {topic()}", sep=" ")),
        ("list", lambda: many(lambda k: f"({k + 1}) {phrase(1, 3)};", sep=" ")),
        ("list", lambda: many(lambda k: f"{name()}, {name()}, {pages()}", sep=rng.choice(("\n", "; ")))),
        ("list", lambda: f"{name().upper()}: " + many(lambda k: f"{topic()}, {price()}", sep="; ") + "."),
        ("list", lambda: many(lambda k: f"→ {phrase(1, 2)}")),
        ("list", lambda: many(lambda k: f"a {phrase(1, 2)}, {num(30)} {word()}", sep="; ") + "."),
        ("list", lambda: many(lambda k: f"Item, {num(12)} {phrase(1, 3)}{end()}")),
        ("list", lambda: many(lambda k: f"[ ] {phrase(1, 4)}")),
        ("table", lambda: many(lambda k: f"{name():<18}" + "".join(f"{num():>8}" for _ in range(3)))),
        ("table", lambda: many(lambda k: f"{name():<18}" + "".join(f"{word():>12}" for _ in range(3)))),
        ("table", lambda: many(lambda k: cells("\t"))),
        ("table", lambda: many(lambda k: cells("\t", 3, word, price))),
        ("table", lambda: "Name | Year | Sum\n" + many(lambda k: cells(" | ", 2, name, price))),
        ("table", lambda: "| a | b | c |\n|---|---|---|\n" + many(lambda k: "| " + cells(" | ", 2) + " |")),
        ("table", lambda: many(lambda k: cells(" | "), sep=" | ")),
        ("table", lambda: many(lambda k: cells(" | ", 2, word, word))),
        ("table", lambda: many(lambda k: cells(",", 4))),
        ("table", lambda: many(lambda k: f"{word()[:3]} {num(90)}.{num(9)} {word()[:3]} {num(9)}.{num(9)}")),
        ("table", lambda: many(lambda k: f"{word()}  {num(20)} {word()[:2]}  {num(30)}{rng.choice('sd')}")),
        ("table", lambda: f"{name()},{name()},{name()}\n" + many(lambda k: cells(",", 2, num))),
        ("table", lambda: many(lambda k: cells(" ", 2, num), sep=" ")),
        ("table", lambda: f"{name()} {name()} {name()} {name()}\n" + many(lambda k: f"{k + 1} {name()} {num(60)} {num(30)}")),
        ("table", lambda: many(lambda k: f"{name()} {num(31)} {price()} {num(30)}.{num(9)}", sep=" ")),
        ("table", lambda: many(lambda k: f"{name()} ... {num(30)} {num(19)} {num(11)}", sep=" ")),
        ("table", lambda: many(lambda k: f"{name():<10}{num(30)}s. {num(11)}d.   {num(30)}s. {num(11)}d.")),
        ("table", lambda: "+-----+-----+\n" + many(lambda k: f"| {name()} | {num()} |") + "\n+-----+-----+"),
        ("table", lambda: many(lambda k: f"{num(12)}:{rng.randint(10, 59)} | {num(12)}:{rng.randint(10, 59)}")),
        ("table", lambda: many(lambda k: f"{name()} {name()}\t{num(30)} {name()} {rng.randint(1700, 1900)}\t{name()}")),
        ("table", lambda: many(lambda k: cells(";", 3, name, price))),
        ("table", lambda: many(lambda k: cells(" "), sep=" ")),
        ("table", lambda: many(lambda k: cells(" "), sep="  ")),
        ("table", lambda: many(lambda k: cells(" "))),
        ("table", lambda: many(lambda k: f"{word()} {price()} {price()}", sep=" ")),
        ("table", lambda: many(lambda k: f"{rng.choice(('Mon', 'Tues', 'Wed', 'Sat'))} {num(31)}   {name()[:4]}. {num(30)}   {name()[:3]}. {num(20)}   {num()}")),
        ("table", lambda: many(lambda k: f"{rng.choice(('Mon', 'Tues', 'Wed', 'Sat'))} {num(31)} {name()[:4]}. {num(30)} {name()[:3]}. {num(20)} {num()}", sep=" ")),
        ("table", lambda: many(lambda k: " ".join(num(999) for _ in range(6)))),
        ("table", lambda: many(lambda k: f"{num(12)}:{rng.randint(10, 59)}  {num(12)}:{rng.randint(10, 59)}  {name()}")),
        ("table", lambda: many(lambda k: f"{rng.randint(1700, 1990)} {num(9999)} {num(9999)} {price()}")),
        ("table", lambda: many(lambda k: f"{name()} {'.' * rng.randint(3, 12)} {price()} {price()}")),
        ("junk", lambda: many(lambda k: noise("0123456789abcdef", 6, 8), 20, 60, " ")),
        ("junk", lambda: many(lambda k: noise("bcdfghjklmnpqrstvwxz", 2, 7), 20, 60, " ")),
        ("junk", lambda: many(lambda k: noise("bcdfgjklmnpqrtvwxz;,.!|'1il", 2, 7), 20, 60, " ")),
        ("junk", lambda: many(lambda k: noise("qwertyuiopasdfghjkl", 3, 4), 20, 60, " ")),
        ("junk", lambda: many(lambda k: noise("asdfjkl;", 3, 9), 20, 60, " ")),
        ("junk", lambda: many(lambda k: noise("%#~=/@^*|{}<>_-.\\", 1, 9), 20, 60, " ")),
        ("junk", lambda: many(lambda k: noise(".-*", 1, 4), 10, 40, " ")),
        ("junk", lambda: many(lambda k: noise("□■◆¬§¶¤¦±°", 1, 5), 6, 40, " ")),
        ("junk", lambda: many(lambda k: f"{item()}{rng.choice(('', ' ' + small()))}{rng.choice(('', ' ' + item().lower()))}", 6, 20, ". ") + "."),
        ("junk", lambda: many(lambda k: noise("%#~=/@^*|{}<>_-.\\ ", 30, 60), 3, 9)),
        ("junk", lambda: many(lambda k: word()[:3] + rng.choice(("â€™", "ï¿½", "Ã©", "Ã¼", "Â£", "�", "â€œ")) * rng.randint(1, 3), 20, 60, " ")),
        ("junk", lambda: many(lambda k: word() + rng.choice("£§¤¦µ¶"), 20, 60, " ")),
        ("junk", lambda: many(lambda k: noise("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 12, 24), 10, 30, " ")),
        ("junk", lambda: many(lambda k: f"{rng.choice(('http://', 'www.', 'https://'))}{word()}.{word()}/{word()}?{word()}={num()}", 4, 14)),
        ("junk", lambda: many(lambda k: f"<{word()} {word()}=\"{word()}\">{{{word()}: {num()}}};", 6, 20)),
        ("junk", lambda: many(lambda k: rng.choice((f"{item()} {name()}", item(), f"{item()} » {name()}", f"{item()} {num(9999)}", f"{item()} > {name()}")), 6, 20)),
        ("junk", lambda: many(lambda k: item(), 6, 20, rng.choice((" | ", " » ", " > ", "  ")))),
        ("junk", lambda: many(lambda k: f"{item()} {rng.choice(('more', 'posts', 'all', 'us', ''))}", 6, 20, rng.choice((" » ", " ", " > ")))),
        ("junk", lambda: f"{item()} | {item()} | {item()}\n" + many(lambda k: f"{item()} {small()} {item()}", 4, 12)),
        ("junk", lambda: many(lambda k: word() + rng.choice((f".{num(99999)}", "", num(99999), f" {num(99999)}")), 12, 40, " ")),
        ("junk", lambda: many(lambda k: word(), 25, 80, " ")),
        ("junk", lambda: many(lambda k: rng.choice(("0", "1")) + noise("0123456789", 7, 12), 10, 40, rng.choice((" ", "\n", "")))),
        ("junk", lambda: many(lambda k: "".join(rng.choice((str.upper, str.lower))(c) for c in word() + word()), 15, 50, " ")),
    ]
    return [(verdict, [make() for _ in range(SAMPLES)]) for verdict, make in shapes]


PARTS, WEIGHTS = (0, 1, 2, 7), (1.0, 0.5, 0.7, 0.5)  # what of a description is compared, and its weight
#: Endings of the words of prose: paragraphs, scripts without spaces.
_PROSE_ENDS = ((0.83, 0.075, 0.012, 0.075, 0.008), (0.3, 0.1, 0.02, 0.55, 0.03))


def _kinds(function: float, plain: float, name: float, number: float, title: float, script: float = 0.0) -> np.ndarray:
    out = np.zeros(len(WORD_KINDS))
    for kind, share in zip(("function", "plain", "name", "number", "title", "other_script"), (function, plain, name, number, title, script)):
        out[WORD_KINDS.index(kind)] = share
    out += 0.002
    return out / out.sum()


@functools.cache
def _profiles() -> tuple[tuple[np.ndarray, ...], list[str], tuple[np.ndarray, ...]]:
    """((word, line, character profiles of prose), verdicts of the shapes, (the same of the shapes)).

    The word profiles of prose are three for each language and for "other" (plain, with
    many figures, with many names), then prose of another script, and of two scripts mixed.
    """
    words = []
    for f, p, n, d, t in _PROSE_WORDS.values():
        words += [_kinds(f, p, n, d, t), _kinds(0.8 * f, 0.8 * p, n + 0.05, d + 0.1, t + 0.04), _kinds(0.75 * f, 0.75 * p, n + 0.18, d + 0.01, t + 0.03)]
    words += [_kinds(0, 0.02, 0.01, 0.03, 0.0, 0.94), _kinds(0.2, 0.2, 0.06, 0.02, 0.01, 0.5)]
    smooth = lambda rows: np.array([(np.array(r) + 0.002) / (sum(r) + 0.002 * len(r)) for r in rows])
    prose = (np.array(words), smooth(_PROSE_LINES), smooth(_PROSE_CHARS), smooth(_PROSE_ENDS))
    verdict, parts = [], ([], [], [], [])
    for kind, texts in _generated():
        verdict.append(kind)
        seen = [describe(t) for t in texts]
        for k, part in enumerate(PARTS):
            mean = np.mean([s[part] / max(s[part].sum(), 1) for s in seen], axis=0) + 0.002
            parts[k].append(mean / mean.sum())
    return prose, verdict, tuple(np.array(p) for p in parts)


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergences (bits) of all rows of ``p`` from all rows of ``q``."""
    return _entropy((p[:, None] + q[None]) / 2) - (_entropy(p)[:, None] + _entropy(q)[None]) / 2


MARGIN = 0.05  # how much nearer than prose another shape must be
REPEATED = 0.6  # repetition beyond which a text with spaces is no prose


def verdicts(described: list[tuple]) -> list[tuple[str, float, float]]:
    """(verdict, divergence from prose of its language, divergence from the nearest other shape) of described texts."""
    if not described:
        return []
    prose, kinds, shapes = _profiles()
    parts = [np.array([x[k] for x in described]) for k in PARTS]
    parts = [np.where((t := c.sum(1, keepdims=True)) > 0, c / np.maximum(t, 1e-9), 1 / c.shape[1]) for c in parts]
    own = [_far(p, q) for p, q in zip(parts, prose)]
    language = np.array([x[6] for x in described])
    n = len(LANGUAGES)
    allowed = np.zeros((len(described), len(prose[0])), bool)
    allowed[:, 3 * n :] = True  # other languages and scripts
    told = np.flatnonzero(language >= 0)
    for j in range(3):
        allowed[told, 3 * language[told] + j] = True
    near = WEIGHTS[0] * np.where(allowed, own[0], np.inf).min(1) + sum(w * far.min(1) for w, far in zip(WEIGHTS[1:], own[1:]))
    far = sum(w * _far(p, s) for w, p, s in zip(WEIGHTS, parts, shapes))
    junk = np.array([k == "junk" for k in kinds])
    repeated = np.array([x[5] > REPEATED and x[0][10] < x[3] / 2 for x in described])
    far += 0.5 * (repeated[:, None] & ~junk)
    near += 2.0 * repeated
    best = far.argmin(1)
    out = []
    for x, b, p, o in zip(described, best.tolist(), near.tolist(), far.min(1).tolist()):
        out.append(("blank", 0.0, 0.0) if not x[3] else ("prose" if p <= o + MARGIN else kinds[b], p, o))
    return out


def statistics(df: DataFrame, id_col: str = "id", text_col: str = "text", count_col: str = "word_count") -> DataFrame:
    """One row per input row: counts and shares from the text beside the stated word count, and the verdict."""
    session.ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            described = [describe(t) for t in b.column(1).to_pylist()]
            for (words, _, chars, n, kinds, repeats, *_), stated, (kind, prose, other) in zip(described, b.column(2).to_pylist(), verdicts(described)):
                visible = float(chars.sum() - chars[3])
                rows.append((
                    n, stated, None if stated is None else stated - n,
                    visible / n if n else 0.0,
                    float(chars[4] + chars[5] + chars[7]) / visible if visible else 0.0,
                    sum(k <= 2 for k in kinds) / len(kinds) if kinds else 0.0,
                    float(words[0]) / n if n else 0.0,
                    repeats, prose, other, kind,
                ))
            columns = list(zip(*rows)) if rows else [[] for _ in range(11)]
            kinds = [pa.int32()] * 3 + [pa.float64()] * 7 + [pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["id", *NAMES])

    kind = df.schema[id_col].dataType.simpleString()
    types = ["int"] * 3 + ["double"] * 7 + ["string"]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(count_col).cast("int").alias("stated"))
    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} {t}" for n, t in zip(NAMES, types))).withColumnRenamed("id", id_col)


NAMES = ("n_words", "stated_words", "stated_excess", "mean_word_length", "symbol_share", "punctuated_line_share", "common_word_share", "repetition", "prose_divergence", "other_divergence", "verdict")


def found(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, kind) of the passages that mostly are lists, tables or junk."""
    s = statistics(df.select(id_col, text_col, F.lit(None).cast("int").alias("_stated")), id_col, text_col, "_stated")
    return s.where(F.col("verdict").isin("list", "table", "junk") & F.col(id_col).isNotNull()).select(id_col, F.col("verdict").alias("kind")).distinct()
