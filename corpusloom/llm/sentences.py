"""Sentence boundaries across languages and scripts.

A text is read as symbols: kinds of words, stops, question and exclamation marks,
closing and opening quotation marks, abbreviations, numbers, paragraph ends. A finite
transducer with the states below goes over them and puts out a boundary where a
pending end is confirmed by what follows it. Its rules are compiled into two tables,
next state and output, over (state, symbol).

A batch is one stream of symbols, cut into chunks of equal length. Every chunk is
first taken as a function from the state before it to the state after it, for all
states at once; the functions are composed by a parallel prefix scan; then each chunk
is run once more from the state the scan gives it. So a long text costs no more steps
than a short one, and the work is the same array operations for any mix of texts.

Null and blank texts have no sentences. Lines of page furniture belong to no sentence
and end none. Rows repeated under one id count once in ``found``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.llm import quality, scan

SYMBOLS = (
    "lower", "upper", "caseless", "number", "number_stop", "abbreviation", "soft", "stop", "question", "ellipsis", "opening",
    "closing", "straight", "mark", "paragraph", "gap", "text_end", "bullet",
)
_S = {name: k for k, name in enumerate(SYMBOLS)}
#: start: nothing since the last boundary; body; then a pending end of a kind, plain or after closing marks.
STATES = ("start", "body", "stop", "stop_closed", "question", "question_closed", "ellipsis", "soft", "numbered")


def _rule(state: str, symbol: str) -> tuple[str, bool]:
    """(next state, whether the pending end before the symbol is a boundary)."""
    word = symbol in ("lower", "upper", "caseless", "number", "abbreviation", "number_stop", "soft", "bullet")
    if symbol in ("paragraph", "text_end", "gap"):
        return "start", state not in ("start",)
    follow = {"stop": "stop", "question": "question", "ellipsis": "ellipsis", "soft": "soft", "number_stop": "numbered"}.get(symbol, "body")
    if state == "start":
        if symbol in ("number_stop", "bullet"):
            return "body", False
        if symbol in ("opening", "straight"):
            return "start", False
        return follow, False
    if state == "body":
        return follow, False
    # a pending end
    if symbol in ("closing",) or (symbol == "straight"):
        if state in ("question", "question_closed"):
            return "question_closed", False
        return ("stop_closed" if state in ("stop", "stop_closed", "ellipsis", "soft", "numbered") else state), False
    if symbol == "mark":
        return "body", False
    if symbol in ("stop", "question", "ellipsis"):
        if symbol == "question" or state in ("question", "question_closed"):
            return "question", False
        return ("ellipsis" if symbol == "ellipsis" or state == "ellipsis" else "stop"), False
    if symbol == "lower":
        return "body", False
    ends = {
        "stop": True,
        "stop_closed": True,
        "question": True,
        "question_closed": symbol != "caseless",
        "ellipsis": symbol != "number",
        "soft": symbol in ("upper", "opening", "number_stop", "caseless", "abbreviation"),
        "numbered": symbol in ("upper", "opening", "number_stop", "abbreviation", "caseless"),
    }[state]
    if not ends:
        return follow if word else "body", False
    if symbol in ("number_stop", "bullet"):
        return "body", True
    if symbol == "opening":
        return "start", True
    return follow, True


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """The transducer's tables over (state, inside straight quotation marks) and symbols."""
    n = len(STATES)
    after, out = np.zeros((2 * n, len(SYMBOLS)), np.uint8), np.zeros((2 * n, len(SYMBOLS)), bool)
    for inside in (0, 1):
        for i, state in enumerate(STATES):
            for k, symbol in enumerate(SYMBOLS):
                if symbol == "straight":
                    nxt, end = _rule(state, "closing" if inside else "opening")
                    then = 1 - inside
                else:
                    nxt, end = _rule(state, symbol)
                    then = 0 if symbol in ("paragraph", "text_end") else inside
                after[inside * n + i, k] = then * n + STATES.index(nxt)
                out[inside * n + i, k] = end
    return after, out


AFTER, OUT = _compile()
CHUNK = 128


def run(symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """For each symbol, whether a sentence ends before it (at the end of the symbol before)."""
    n = len(symbols)
    if not n:
        return np.zeros(0, bool)
    rows = -(-n // chunk)
    padded = np.full(rows * chunk, _S["text_end"], np.uint8)
    padded[:n] = symbols
    grid = padded.reshape(rows, chunk)
    n_states = len(AFTER)
    # each chunk as a function of the state before it
    function = np.tile(np.arange(n_states, dtype=np.uint8), (rows, 1))
    for k in range(chunk):
        function = AFTER[function, grid[:, k][:, None]]
    # inclusive prefix scan of the functions' composition, in log2(rows) sweeps
    step = 1
    while step < rows:
        function[step:] = np.take_along_axis(function[step:], function[:-step].astype(np.int64), axis=1)
        step *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = function[:-1, 0]
    out = np.zeros((rows, chunk), bool)
    for k in range(chunk):
        out[:, k] = OUT[state, grid[:, k]]
        state = AFTER[state, grid[:, k]]
    return out.reshape(-1)[:n]


# ---------------------------------------------------------------- symbols

# Abbreviations that never end a sentence, those that refer (only before a number), those that may end one.
_TITLES = "Mr Mrs Ms Dr Rev Revd St Messrs Capt Col Gen Lieut Bp Abp Prof Hon Gov Serg Maj Sr Sra Srta Dna Hr Fr Mlle MM Mme Mgr cf viz i\\.e e\\.g i\\.\\s?e e\\.\\s?g vs bzw z\\.\\s?B d\\.\\s?h d\\.\\s?M d\\.\\s?J u\\.\\s?a p\\.\\s?ex p\\.\\s?ej v\\.\\s?g c\\.-à-d p\\.\\s?e π\\.χ δηλ κ Dres Sres Vd Ud ca resp approx Approx"
_REFERENCES = "No Nos no nos vol vols Vol Vols p pp P sect Sect chap Chap ch Ch cap Cap ver vers v vv art Art fig Fig Serm Hymn Lect l ll n f ff Bk bk pt Pt par h min Jan Feb Febr Mar Apr Jun Jul Aug Sept Sep Oct Nov Dec Mon Tues Tue Wed Thur Thurs Fri Sat Sun Gen Exod Ex Lev Num Deut Josh Judg Sam Kgs Chron Neh Esth Ps Pss Prov Eccl Isa Jer Lam Ezek Dan Hos Obad Mic Nah Hab Zeph Hag Zech Mal Matt Mt Mk Lk Jn Rom Cor Gal Eph Phil Col Thess Tim Tit Philem Heb Jas Pet Jude Rev Luc Marc janv févr avr juil sept oct nov déc"
_SOFT = "etc &c usw p\\.\\s?m a\\.\\s?m P\\.M A\\.M Esq Jun Sen Jr Sr Ltd Co u\\.\\s?s\\.\\s?w"
_MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|d\\.\\s?M|d\\.\\s?J"


def _any(words: str) -> str:
    return "|".join(sorted(words.split(), key=len, reverse=True))


_THAI = "฀-๿"
_SCANNER = re.compile(
    r"(?P<plain>[A-Za-zÀ-ɏͰ-ϿЀ-ӿἀ-῿][^\W\d_]*+(?:['’‑\xad-][^\W\d_]++)*+(?!\.)"
    r"(?:,?(?:[^\S\n\u2028]+|[^\S\n\u2028]*\n[^\S\n\u2028]*)[a-zß-ÿ][^\W\d_]*+(?:['’][^\W\d_]++)*+(?![.\w]))*)"
    r"|(?P<gap>\u2028)|(?P<paragraph>\n[^\S\n]*\n\s*| )"
    rf"|(?P<abbreviation>(?<![^\W_])(?:{_any(_TITLES)})\.(?!\s*\n\s*\n)|(?<![^\W_])(?:{_any(_REFERENCES)})\.(?=\s*(?:\d|[ivxlc]+\b))"
    rf"|(?:(?<=\b[AaVv]m\s)|(?<=\bvom\s)|(?<=\bden\s)|(?<=\bzum\s)|(?<=\bdem\s))\d+\.(?=\s+[^\W\d_])|\d+\.(?=\s+(?:{_MONTHS}))"
    r"|(?<![^\W\d_.’'])(?:[A-ZÀ-ÞΑ-Ω]\.\s?)+(?=[^\W\d_])|(?<![^\W\d_.’'])(?:[A-Z]\.)+(?=\s*\d)"
    r"|£\d+\.(?=\s*\d)|(?<![^\W_])\d+[sdl]\.(?=\s*\d)"
    r"|(?<![^\W_])[ivxlc]+\.(?=\s*(?:\d|[a-zß-ÿ]))|(?<![^\W_])[A-Za-z]{1,5}\.(?=\s+[ivxlc]+[.,;:)])"
    rf"|(?<![\w\u064b-\u0652])[ء-ي]\.|(?<![^\s“«(])(?:डॉ|श्री|प्रो|पं|सु)\.|(?<![{_THAI}])[{_THAI}]{{1,2}}\.)"
    rf"|(?P<soft>(?<![^\W_])(?:{_any(_SOFT)})\.|&c\.)"
    rf"|(?P<thai>(?<=[{_THAI}])[ \n\xa0](?=[{_THAI}]|[“\"«][{_THAI}]{{40,}})|(?<=[{_THAI}][”\"»])[ \n\xa0](?=[{_THAI}]{{21,}}))"
    r"|(?P<number_stop>£?\d+(?:[.,:]\d+)*[a-z]{0,2}\.(?!\d)(?!\.))"
    r"|(?P<number>£?\d+(?:[.,:–-]\d+)*(?:[a-z]{1,2}\b)?)"
    r"|(?P<ellipsis>\.(?:\s?\.){2,}|…+)"
    r"|(?P<question>[?!？！؟፧⸮]+|(?<=[Ͱ-Ͽἀ-῿»”\"])\s?[;;](?=[\s»”\"]|$))"
    r"|(?P<stop>\.|[。｡．।॥።܀۔]+)"
    r"|(?P<closing>[”’»›)\]}」』】》〉）]|(?<=[^\s(\[„“«])[“‟](?![^\W_])|(?<=[^\s(])\"(?=[\s.,;:!?)\]—”’]|$)|(?<=[.!?,;:…])'(?=\s|$))"
    r"|(?P<mark>[,;:؛،፤፥፣፡·；：，、—–]|(?<=[」』])(?:と|って|など|という))"
    r"|(?P<opening>[“„‟‘«‹(\[{「『【《〈（¿¡]|(?:(?<=\s)|(?<=^)|(?<=[(\[—–]))\"(?=\S)|(?:(?<=\s)|(?<=^)|(?<=[(\[—–]))'(?=[^\W_]))"
    r"|(?P<straight>\")"
    r"|(?P<bullet>(?<![^\n])[ \t]*[•·*▪◦-](?=\s))"
    r"|(?P<word>[^\W\d_]+(?:['’‑\xad-][^\W\d_]+)*(?:[^\S\n\u2028]+[a-zß-ÿ][^\W\d_]*+(?![.'’\w]))*|\|)"
)
_CODE = {name: _S.get(name, _S["lower"]) for name in ("gap", "paragraph", "abbreviation", "soft", "number_stop", "number", "ellipsis", "question", "stop", "closing", "mark", "opening", "straight", "bullet")} | {"thai": _S["gap"]}
_BULLET_LINE = re.compile(r"[ \t]*(?:[•·*▪◦–-]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+\S")
_FINAL = re.compile(r"[^\W\d_][.!?]|[。！？।॥።፧؟]")


def masked(text: str, title: str | None, line_weights: dict[str, float]) -> str:
    """The text with furniture blanked, and the ends of lines that are entries by themselves marked."""
    if "\n" not in text:
        return text
    lines = text.split("\n")
    flags = scan.furniture(text, title, None, line_weights)
    ends = ["\n"] * len(lines)
    if any(flags):
        for k, flag in enumerate(flags):
            if flag:
                lines[k] = " " * len(lines[k])
                ends[k] = " "
                # blank lines around furniture end nothing
                j = k - 1
                while j >= 0 and (not lines[j].strip()):
                    ends[j] = " "
                    j -= 1
                if j >= 0:
                    ends[j] = " "
                j = k + 1
                while j < len(lines) and not lines[j].strip():
                    ends[j] = " "
                    j += 1
    bullets = [bool(_BULLET_LINE.match(x)) and len(x) < 90 for x in lines]
    if sum(bullets) > 1:
        for k in range(len(lines) - 1):
            if bullets[k] and bullets[k + 1] and ends[k] == "\n":
                ends[k] = " "
        for k in range(1, len(lines) - 1):
            if bullets[k] and not bullets[k - 1] and bullets[k + 1] and ends[k - 1] == "\n" and lines[k - 1].rstrip()[-1:] not in ",;-":
                ends[k - 1] = " "
    if len(lines) > 3 and len(_FINAL.findall(text)) * 150 < len(text) and quality.verdicts([quality.describe(text)])[0][0] in ("list", "table", "junk"):
        ends = [" "] * len(lines)
    return "".join(x for pair in zip(lines, ends) for x in pair)[: len(text)]


def scanned(text: str) -> tuple[list[int], list[int], list[int]]:
    """(symbols, begins, ends) of a masked text; the last symbol is the text's end."""
    symbols, begins, ends = [], [], []
    add_s, add_b, add_e = symbols.append, begins.append, ends.append
    lower, upper, caseless = _S["lower"], _S["upper"], _S["caseless"]
    for m in _SCANNER.finditer(text):
        name = m.lastgroup
        a, b = m.span()
        if name == "plain" or name == "word":
            c = text[a]
            s = upper if c.isupper() or c == "|" else lower if c.islower() else caseless
            if s == lower and b - a <= 2 and c == "l" and text[a:b].strip() == "l":
                s = upper
        else:
            s = _CODE[name]
            if name == "question":
                a += len(m[0]) - len(m[0].lstrip())
            elif name == "abbreviation":
                while text[b - 1].isspace():
                    b -= 1
                if text[a].islower():
                    s = lower
        add_s(s)
        add_b(a)
        add_e(b)
    add_s(_S["text_end"])
    add_b(len(text))
    add_e(len(text))
    return symbols, begins, ends


def split(texts: list[str | None], titles: list[str | None] | None = None, line_weights: dict[str, float] | None = None) -> list[list[tuple[int, int]]]:
    """(begin, end) of every sentence of every text, in order."""
    titles = titles or [None] * len(texts)
    symbols: list[int] = []
    spans: list[tuple[list[int], list[int]]] = []
    for text, title in zip(texts, titles):
        s, begins, ends = scanned(masked(text, title, line_weights or {})) if text else ([_S["text_end"]], [0], [0])
        symbols += s
        spans.append((begins, ends))
    stream = np.array(symbols, np.uint8)
    flags = run(stream)
    loud = ~np.isin(stream, (_S["paragraph"], _S["gap"], _S["text_end"]))
    # the nearest symbol that is not silent, at or before and at or after each place
    place = np.arange(len(stream))
    before = np.maximum.accumulate(np.where(loud, place, -1))
    after = np.minimum.accumulate(np.where(loud, place, len(stream))[::-1])[::-1]
    out, at = [], 0
    for (begins, ends), text in zip(spans, texts):
        n, found, start = len(begins), [], at
        for k in (at + np.flatnonzero(flags[at : at + n])).tolist():
            first, last = int(after[start]), int(before[k - 1]) if k > start else -1
            if first <= last:
                end, limit = ends[last - at], begins[last - at + 1]
                while end < limit and not text[end].isspace():
                    end += 1  # combining marks and other signs that are no symbols
                found.append((begins[first - at], end))
                start = k
        at += n
        out.append(found)
    return out


def _rows(passages: DataFrame) -> DataFrame:
    return passages.select(F.col("id").cast("string").alias("id"), "text", F.col("source_title").alias("title"))


def sentences(passages: DataFrame) -> DataFrame:
    """(id, n, begin_pos, end_pos, sentence) of every sentence of every row with a text, n counting from 0."""
    spark = passages.sparkSession
    session.ship(spark)
    rows = _rows(passages)
    shared = spark.sparkContext.broadcast(scan.train(rows, edit=False).line_weights)

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            cols: tuple[list, ...] = ([], [], [], [], [])
            for i, t, spans in zip(ids, texts, split(texts, b.column(2).to_pylist(), shared.value)):
                for n, (a, e) in enumerate(spans):
                    for c, v in zip(cols, (i, n, a, e, t[a:e])):
                        c.append(v)
            types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=["id", "n", "begin_pos", "end_pos", "sentence"])

    return rows.where("text is not null").mapInArrow(run_all, "id string, n int, begin_pos int, end_pos int, sentence string")


def found(passages: DataFrame, sample: DataFrame) -> DataFrame:
    """(id, end_pos) of every sentence of the passages whose id is in ``sample`` (one column, id)."""
    spark = passages.sparkSession
    session.ship(spark)
    rows = _rows(passages)
    shared = spark.sparkContext.broadcast(scan.train(rows, edit=False).line_weights)

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ends = [], []
            for i, spans in zip(b.column(0).to_pylist(), split(b.column(1).to_pylist(), b.column(2).to_pylist(), shared.value)):
                ids += [i] * len(spans)
                ends += [e for _, e in spans]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(ends, pa.int32())], names=["id", "end_pos"])

    wanted = rows.where("text is not null").join(sample.select("id").distinct(), "id").groupBy("id").agg(F.min(F.struct("text", "title")).alias("r")).select("id", "r.text", "r.title")
    return wanted.mapInArrow(run_all, "id string, end_pos int")
