"""Abusive, hateful or sexual clauses, by a weighted finite-state pattern grammar (Portuguese).

Four transducers are composed. Characters to words: look-alike letters, invisible characters, spaced or dotted letters,
digits for letters, masked letters and repeated letters are undone. Words to symbols: each word or derived form becomes one
symbol of a small alphabet of lexical classes, everything unknown one filler symbol. Symbols to events: weighted patterns of
an insult with its target, a threat with its victim, a wish of death, a group with its debasement, a sexual act or an offer,
all read by one automaton in one pass. Events to scores: an event loses most of its weight inside quotation marks, near the
words of a report with quotations or of an official notice, after "somebody said that", and where it is denied ("I don't
think that", "it isn't true that", "not" right before it). A clause's score is the sum of its events, each pattern counting
once, by its match that loses least, and of the events that lose weight the heaviest alone; single words score nothing.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.abuse_grammar import COMMA, CONTEXTS, FILL, GRAMMAR, QUOTE, STOP, Automaton, machine
from tagloom.llm.abuse_grammar import RUN as _RUN
from tagloom.llm.abuse_grammar import alphabet as _alphabet
from tagloom.llm.abuse_lexicon import classes

#: Look-alike letters of other scripts, in the order of their Latin letters.
_ALIKE = str.maketrans("аеорсухіѕјһԁԛԝɡοαεικνρτυχ", "aeopcyxisjhdqwgoaeikvptux")
_ALIKE_ANY = re.compile("[аеорсухіѕјһԁԛԝɡοαεικνρτυχ]")
_HIDDEN = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_MARKS = re.compile("[̀-ͯ]+")
_SPACED = re.compile(r"(?<![a-z0-9])(?:[a-z] ){3,}[a-z](?![a-z0-9])")
_TOKEN = re.compile(r"[a-z0-9@$#*!|_](?:[a-z0-9@$#*!|_.\-]*[a-z0-9@$#*|_])?|[.!?…;:\n]|,|[\"“”«»]")
_WRAPPED = re.compile(r"(?<=[a-z])-[ \t]*\r?\n[> \t]*(?=[a-z])")
_DIGITS = str.maketrans("4@3!10$57|", "aaeiiosstl")
_CLAUSE_END = re.compile(r"[.!?…\n]\s")
_WORD_END = re.compile(r"\s")
_JOINT = re.compile(r"[.\-_]")


def _together(m: re.Match) -> str:
    """Spaced letters as a word; a single letter after the word is a word of its own."""
    word, known = m.group().replace(" ", ""), _alphabet()[0]
    if _RUN.sub(r"\1", word) not in known and _RUN.sub(r"\1", word[:-1]) in known:
        return f"{word[:-1]} {word[-1]}"
    return word


def fold(text: str) -> str:
    """First transducer: lower case, no accents, no look-alikes, no invisible characters, spaced letters joined."""
    low = text.lower()
    if not low.isascii():
        if _ALIKE_ANY.search(low):
            low = low.translate(_ALIKE)
        low = _MARKS.sub("", unicodedata.normalize("NFD", _HIDDEN.sub("", low)))
    return _SPACED.sub(_together, _WRAPPED.sub("", low))


@lru_cache(maxsize=1)
def _slips() -> dict[str, str]:
    """Slips of the pen, where they name one word only: a letter of six or more left out, two neighbours of five swapped."""
    of_word, _ = _alphabet()
    out: dict[str, str] = {}
    for word, symbol in of_word.items():
        slips = [word[:i] + word[i + 1 :] for i in range(1, len(word))] if len(word) >= 6 else []
        if len(word) >= 5:
            slips += [word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(1, len(word) - 1)]
        for slip in slips:
            slip = _RUN.sub(r"\1", slip)
            out[slip] = symbol if out.get(slip, symbol) == symbol else FILL
    return {w: s for w, s in out.items() if s != FILL and w not in of_word}


@lru_cache(maxsize=1)
def _by_length() -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for word in classes():
        out.setdefault(len(word), []).append(word)
    return out


class Symbols(dict):
    """Second transducer: words to symbols, remembered; filler for words outside the lexicon."""

    def __missing__(self, token: str) -> str:
        if len(self) > 300_000:  # names and numbers: start over rather than grow with the corpus
            self.clear()
        self[token] = s = self.find(token)
        return s

    @staticmethod
    def find(token: str) -> str:
        if token in ".!?…;:\n":
            return STOP
        if token == ",":
            return COMMA
        if token in '"“”«»':
            return QUOTE
        of_word, _ = _alphabet()
        word = _RUN.sub(r"\1", token)
        if word in of_word:
            return of_word[word]
        if not any(c.isalpha() for c in token):
            return FILL
        if word.isalpha():
            return _slips().get(word, FILL) if len(word) >= 5 else FILL
        joined = _JOINT.sub("", token)
        plain = _RUN.sub(r"\1", joined.translate(_DIGITS))
        for form in (plain, _RUN.sub(r"\1", joined)):
            if form in of_word:
                return of_word[form]
        # masked letters match any one letter
        mask = re.compile("".join(c if c.isalpha() else "[a-z]" for c in joined))
        fits = {of_word[_RUN.sub(r"\1", w)] for w in _by_length().get(len(joined), ()) if mask.fullmatch(w)}
        return fits.pop() if len(fits) == 1 else _slips().get(plain, FILL)


@lru_cache(maxsize=1)
def _machines() -> tuple[tuple[str, float, re.Pattern], ...]:
    """Third transducer: each pattern by itself, for the places of its matches."""
    return tuple((kind, weight, machine(pattern)) for kind, weight, pattern in GRAMMAR)


@lru_cache(maxsize=1)
def _denying() -> tuple[bool, ...]:
    """Of each pattern whether a "not" in one of its gaps denies it: so for what is said of groups, if it needs none itself."""
    return tuple(kind == "hate" and not {"NOT", "NEITHER", "NOTGIVE"} & set(re.split(r"[ |]", pattern)) for kind, _, pattern in GRAMMAR)


@lru_cache(maxsize=1)
def _automata() -> tuple[Automaton, Automaton]:
    """All patterns as one automaton, and all contexts as another."""
    return Automaton(p for _, _, p in GRAMMAR), Automaton(p for _, p in CONTEXTS)


@lru_cache(maxsize=1)
def _marks_of() -> dict[str, re.Pattern]:
    """Single words that matter to a context: of reports, of notices, "not", "I", and what ends a denial."""
    _, of_class = _alphabet()
    return {c: re.compile(f"[{of_class[c]}]") for c in ("REPORT", "NOTICE", "NOT", "I", "BUT")}


#: Symbols over which reported speech or a denial reaches.
SCOPE = 14


class Context:
    """What takes weight away in one clause."""

    def __init__(self, clause: str):
        self.clause = clause
        self.quotes = [i for i, c in enumerate(clause) if c == QUOTE]
        word = _marks_of()
        self.scopes = []
        for end, which in _automata()[1].ends(clause):
            kinds = {CONTEXTS[i][0] for i in which}
            # what I say myself is no report
            if "denied" not in kinds and word["I"].search(clause, max(0, end - 5), end):
                continue
            stop = word["BUT"].search(clause, end + 1, end + SCOPE)
            comma = clause.find(COMMA, end + 1)
            self.scopes.append((end, min([end + SCOPE] + ([stop.start()] if stop else []) + ([comma] if comma >= 0 else []))))

    def kept(self, hit: re.Match, denies: bool) -> float:
        """The share of its weight that a match keeps; ``denies`` if a "not" inside it can only deny it.

        A report's word before a quotation that is closed again has its speech there, and takes nothing from what follows.
        """
        word, clause, quotes = _marks_of(), self.clause, self.quotes
        begin = hit.start() + (clause[hit.start() : hit.start() + 1] == COMMA)
        before, start, end = bisect_left(quotes, hit.start()), max(0, hit.start() - 15), hit.end() + 4
        kept = 1.0
        if before % 2:
            kept = 0.1 if word["REPORT"].search(clause) else 0.5
        elif quotes and word["REPORT"].search(clause, max(start, quotes[before - 1] if before else 0), end):
            kept = 0.1
        elif any(a < begin <= b and not any(a < q < begin for q in quotes) for a, b in self.scopes):
            kept = 0.1
        elif word["NOT"].search(clause, begin, hit.end()):
            kept = 0.1 if denies else 1.0
        elif begin and word["NOT"].match(clause, begin - 1):
            kept = 0.1
        return kept * 0.2 if word["NOTICE"].search(clause, start, end) else kept


def clauses(symbols: str) -> Iterator[tuple[float, str]]:
    """Fourth transducer: (score, kind) of every clause that scores, kind being its heaviest."""
    automaton, machines, denying = _automata()[0], _machines(), _denying()
    for clause in symbols.split(STOP):
        if not clause.strip(FILL):
            continue
        there = {i for _, which in automaton.ends(clause) for i in which}
        if not there:
            continue
        context = Context(clause)
        by_kind: dict[str, float] = {}
        less = (0.0, "")
        for i in sorted(there):
            kind, weight, pattern = machines[i]
            kept, hit = 0.0, pattern.search(clause)
            while hit is not None and kept < 1:  # matches may overlap: the next one starts anywhere after this one's start
                kept = max(kept, context.kept(hit, denying[i]))
                hit = pattern.search(clause, hit.start() + 1)
            if kept == 1:
                by_kind[kind] = by_kind.get(kind, 0.0) + weight
            else:
                less = max(less, (weight * kept, kind))
        if less[0]:
            by_kind[less[1]] = by_kind.get(less[1], 0.0) + less[0]
        if by_kind:
            yield sum(by_kind.values()), max(by_kind, key=by_kind.get)


def _parts(text: str, most: int = 200_000) -> Iterator[str]:
    """A long text in parts, cut after the end of a clause (or of a word, in text without any)."""
    start = 0
    while len(text) - start > most:
        cut = _CLAUSE_END.search(text, start + most, start + 2 * most) or _WORD_END.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


def score(text: str | None, symbols: Symbols) -> tuple[float, str | None, int]:
    """Highest clause score, its kind, and the number of clauses that are cases; (0, none, 0) without events."""
    best, kind, cases = 0.0, None, 0
    for part in _parts(text or ""):
        line = "".join([symbols[t] for t in _TOKEN.findall(fold(part))])
        for s, k in clauses(line):
            cases += s >= 1
            if s > best:
                best, kind = s, k
    return round(best, 4), kind, cases


def score_documents(df: DataFrame, id_col: str, text_col: str, carry: list[str] = ()) -> DataFrame:
    """(id, carry..., score, kind, clauses): one row per row of ``df``, no shuffle.

    ``score`` >= 1 marks a case; ``kind`` is insult, threat, hate or sexual. Null and empty texts score 0 with a null
    kind. Rows with null or repeated ids are kept as they are; other columns are ignored.
    """
    kept = df.select(F.col(id_col).alias("__id"), *carry, F.col(text_col).alias("__text"))
    fields = [f for f in kept.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols()
        for batch in batches:
            got = [score(t, symbols) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in fields]
                + [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.int32())],
                names=[f.name for f in fields] + ["score", "kind", "clauses"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    scored = kept.mapInArrow(run, f"{schema}, score double, kind string, clauses int")
    return scored.withColumnRenamed("__id", id_col)


def rates(scored: DataFrame, by: str) -> DataFrame:
    """(by, documents, cases, rate_bp, insult, threat, hate, sexual): rates per source; a null source is a row of its own."""
    case = F.col("score") >= 1
    kinds = [F.count_if(case & (F.col("kind") == k)).alias(k) for k in ("insult", "threat", "hate", "sexual")]
    return scored.groupBy(by).agg(
        F.count("*").alias("documents"), F.count_if(case).alias("cases"),
        F.round(F.count_if(case) * 10_000 / F.count("*")).cast("bigint").alias("rate_bp"), *kinds)
