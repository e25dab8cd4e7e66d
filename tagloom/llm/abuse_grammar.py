"""The patterns of the abuse grammar, composed into one automaton that reads a clause once.

A pattern is a row of units over lexical classes: "A|B" a choice, "(A)?" an optional unit, "*n" a gap of up to n symbols,
"," a comma, START and END the borders of a clause or a comma. All patterns together are one nondeterministic automaton;
the deterministic one is made from it as clauses ask for it, so a symbol costs one look-up whatever the number of patterns.
A second automaton of the same kind marks the places where speech is reported or something is denied.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

from tagloom.llm.abuse_lexicon import classes

# (kind, weight, pattern). A weight of 1 makes a clause a case by itself.
GRAMMAR = (
    ("insult", 1.0, "YOU NOT PASSOF OF ART INSULT|ANIMAL"),
    ("insult", 1.0, "YOU (ALWAYS)? BE (ALWAYS)? ART INSULT|ANIMAL"),
    ("insult", 1.0, "YOU BE INSULT"),
    ("insult", 1.0, "THIS JOB *1 BE ART INSULT|ANIMAL"),
    ("insult", 0.7, "THIS JOB *4 FOUL|INSULT"),
    ("insult", 0.7, "THIS INSULT OF"),
    ("insult", 0.7, "NOT KNOW NEITHER SIGNDO *1 DUMB"),
    ("insult", 1.0, "NOT PASSOF OF ART INSULT|ANIMAL (FOUL)?"),
    ("insult", 0.6, "NEITHER DOG LICK"),
    ("insult", 0.6, "SHUT *1 MOUTH"),
    ("insult", 0.6, "NOBODY ASKED *2 POSS"),
    ("insult", 0.7, ", POSS INSULT|ANIMAL|SLUR END"),
    ("insult", 0.7, "START POSS INSULT|ANIMAL|SLUR END"),
    ("insult", 1.0, "START POSS INSULT|SLUR , GO"),
    ("insult", 0.6, "GO CARPIR *1 LOT"),
    ("insult", 0.5, "GO CARPIR"),
    ("insult", 0.6, "BAND OF *2 INSULT|DEBASE"),
    ("insult", 0.6, "ONLY KNOW *1 STEAL"),
    ("insult", 1.0, "GO ALL *1 DAMN"),
    ("insult", 1.0, "GO SELF DAMN"),
    ("insult", 0.5, "GO SELF"),
    ("insult", 0.6, ", YOU AND DEF POSS"),
    ("insult", 1.0, "GO *1 DEF CRAP"),
    ("insult", 0.8, "WHAT CRAP OF SERVICE"),
    ("insult", 0.3, "GO ALL"),
    ("insult", 0.6, "CRAWL OF RETURN"),
    ("insult", 0.6, "CRAWL *4 HOLE"),
    ("insult", 0.5, "HOLE FOUL"),
    ("insult", 0.7, "BORN *3 ONLY *1 WASTE OXY"),
    ("insult", 0.7, "BORN ONLY *1 WASTE"),
    ("insult", 0.5, "ONLY *1 WASTE OXY"),
    ("insult", 0.7, "DESERVE SWALLOW *1 STAMP"),
    ("insult", 0.7, "THIS INSULT *6 SWALLOW"),
    ("insult", 1.0, "BE ART HUMANWASTE *1 LEFT"),
    ("insult", 1.0, "ART INSULT WITH SALARY"),
    ("insult", 0.6, "FACE *3 NEITHER MIRROR"),
    ("insult", 0.6, "MIRROR *2 BEAR"),
    ("insult", 0.6, "UNTIL DEF MIRROR BEAR"),
    ("insult", 0.4, "WITH THIS FACE"),
    ("insult", 0.4, "THATF FACE"),
    ("insult", 0.6, "MIRROR *1 TE BEAR"),
    ("insult", 0.5, "OF WHERE YOU BORN|LEFTOUT"),
    ("insult", 0.4, "THIS JOB *1 BE ART"),
    ("insult", 0.3, ", POSS *1 END"),
    ("insult", 1.0, "SON OF INSULT"),
    ("insult", 0.6, "WHAT BORE"),
    ("insult", 0.6, "UGLY UGLY END"),
    ("insult", 0.6, "THING UGLY END"),
    ("threat", 1.0, "KNOWI WHERE YOU LIVE *6 WILL *1 HARM|AWAIT"),
    ("threat", 1.0, "KNOWI *2 WHERE|LIVE *6 WILL *1 HARM|AWAIT"),
    ("threat", 0.6, "KNOWI WHERE YOU LIVE"),
    ("threat", 0.7, "WILL HARM *1 BONE"),
    ("threat", 0.7, "WILL *1 AWAIT *6 WEAPON"),
    ("threat", 0.7, "WILL *1 HARM YOU|POSS"),
    ("threat", 0.7, "SOMEONE PIERCE *2 YOU|WEAPON"),
    ("threat", 0.6, "SOMEONE *14 WILL CHEER"),
    ("threat", 0.7, "CROSS WITHME"),
    ("threat", 0.6, "NOT RETURN *2 BET"),
    ("threat", 0.6, "YOU NOT RETURN"),
    ("threat", 0.6, "IN (ART)? COFFIN"),
    ("threat", 0.6, "I TE AWAIT *4 GO|NOT|IN"),
    ("threat", 0.5, "CAN BET"),
    ("threat", 1.0, "YOU GO PAY *1 DEAR"),
    ("threat", 0.8, "HOPE *12 GET *3 DISEASE"),
    ("threat", 0.4, "DISEASE *2 CRUEL *2 CRUEL"),
    ("threat", 1.0, "BEST WHAT *8 MIGHT *2 VANISH"),
    ("threat", 1.0, "BEST WHAT *8 BE VANISH"),
    ("hate", 0.7, "TYPES LIKE *8 NEITHER DESERVE BREATHE"),
    ("hate", 0.6, "NEITHER DESERVE BREATHE"),
    ("hate", 0.6, "BREATHE *1 SAME AIR"),
    ("hate", 0.8, "PEOPLE THATF CREED BE *1 DEBASE|ALL"),
    ("hate", 0.6, "BE ALL DEBASE"),
    ("hate", 0.6, "BE ALL THING OF DEBASE"),
    ("hate", 0.6, "BE ALL *3 DEBASE"),
    ("hate", 0.5, "PEOPLE OF *3 BE RACE|INFERIOR|DEBASE"),
    ("hate", 0.6, "RACE INFERIOR"),
    ("hate", 0.6, "NEITHER *1 RECEIVE|NOTGIVE RECEIVE"),
    ("hate", 0.6, "NEITHER *1 DESERVE RECEIVE"),
    ("hate", 0.8, "GROUP BE *1 DEBASE"),
    ("hate", 0.6, "DEBASE AND DESERVE"),
    ("hate", 0.6, "DESERVE *2 EXPEL *1 BEAT"),
    ("hate", 0.6, "DESERVE *2 EXPEL"),
    ("hate", 0.4, "EXPEL *1 BEAT"),
    ("hate", 0.7, "GROUP|SLUR *12 DESERVE *2 EXPEL"),
    ("hate", 0.5, "EXPEL UNTIL TURN"),
    ("hate", 0.7, "GROUP *2 NOT DESERVE *2 NORIGHT"),
    ("hate", 0.5, "BE DEADWEIGHT DEADWEIGHT"),
    ("hate", 0.7, "GROUP ONLY HINDER"),
    ("hate", 0.6, "DESERVE LETT *3 EXPEL|VANISH"),
    ("hate", 0.6, "LETT EXPEL *3 QUEUE"),
    ("hate", 0.7, "SKIN THATF CREED"),
    ("hate", 0.6, "ONLY UNDERSTANDS *2 WHIP"),
    ("hate", 0.6, "UNDERSTANDS *1 WHIP"),
    ("hate", 0.7, "PLACE THIS *2 BE *1 KITCHEN"),
    ("hate", 0.7, "PLACE THIS INSULT|GROUP"),
    ("hate", 0.5, "GROUP IN CHEFIA GIVE"),
    ("hate", 0.8, "NOT RENT NEITHER GREET"),
    ("hate", 0.5, "GREET *3 CAME THATF WORSHIP|CREED"),
    ("hate", 0.5, "CAME *2 THATF WORSHIP|CREED , BE ALL"),
    ("hate", 0.8, "ARSON *1 CAMP *4 INSIDE"),
    ("hate", 0.6, "THIS GROUP|SLUR NEED"),
    ("sexual", 0.6, "UNDRESS *2 CLOTHES *1 THATF|HERS|POSS"),
    ("sexual", 0.6, "UNDRESS *1 CLOTHES"),
    ("sexual", 0.6, "UNDRESS THIS CLOTHES"),
    ("sexual", 0.6, "PEOPLE SEX UNTIL"),
    ("sexual", 0.6, "DEF PEOPLE SEX"),
    ("sexual", 0.6, "SIT *2 SITLAP"),
    ("sexual", 0.6, "MY SITLAP"),
    ("sexual", 0.5, "WHAT I FREE"),
    ("sexual", 0.8, "WANT|WILL TE SEX"),
    ("sexual", 0.6, "WANT|WILL TE *1 NICE"),
    ("sexual", 0.6, "SEX NICE *1 ONTOP|IN"),
    ("sexual", 0.5, "NICE IN ONTOP OF"),
    ("sexual", 0.7, "WANT OF SEX"),
    ("sexual", 0.5, "HAS ART BODY"),
    ("sexual", 0.6, "BODY WHAT GIVE WANT"),
    ("sexual", 0.6, "GIVE WANT OF *1 SEX"),
    ("sexual", 0.7, "ROLLED SEX"),
    ("sexual", 0.7, "HERS SEX NUDE"),
    ("sexual", 0.6, "SEX NUDE *1 ONTOP"),
    ("sexual", 0.5, "ASK MORE"),
    ("sexual", 0.8, "SEND PHOTO *1 NUDE"),
    ("sexual", 0.6, "SEND PHOTO|NUDE *4 FREE"),
    ("sexual", 0.6, "WHAT I FREE DEF POSS"),
    ("sexual", 0.8, "PRICE COST *1 TRICK"),
    ("sexual", 0.6, "TRICK , POSS INSULT|SLUR"),
    ("sexual", 0.5, "PAYI MONEY"),
    ("sexual", 0.8, "STAY OF SEX|COCK *1 HARD|ONLY"),
    ("sexual", 0.8, "STAY OF SEX ONLY"),
    ("sexual", 0.6, "ONLY OF FEEL *1 SMELL"),
    ("sexual", 0.7, "DREAM *6 SEX"),
    ("sexual", 0.6, "SEX *3 MORE *2 SWEAT"),
    ("sexual", 0.5, "SWEAT OF SWEAT"),
    ("sexual", 0.6, "SCREAM MY NAME"),
    # of any kind of words
    ("insult", 1.0, "YOU (ADVERB)? BE (ADVERB)? (ART)? (VERY)? STRONG"),
    ("insult", 1.0, "BE ART (VERY)? STRONG"),
    ("insult", 1.0, "START POSS (VERY)? STRONG END"),
    ("insult", 1.0, ", POSS (VERY)? STRONG END"),
    ("insult", 0.5, ", STRONG END"),
    ("insult", 0.5, "START STRONG END"),
    ("insult", 0.5, "WHAT (ART)? STRONG END"),
    ("insult", 0.6, "TE HATE1"),
    ("insult", 0.6, "HATE1 YOU"),
    ("insult", 0.5, "YOU BE ART BAND"),
    ("insult", 1.0, "GO TAKE IN ASS"),
    ("insult", 1.0, "BE ART ANIMAL|INSULT FOUL"),
    ("insult", 1.0, "GO TOWARD CRAP|DAMN"),
    ("insult", 0.4, "START BAND OF *1 INSULT"),
    ("insult", 1.0, "START WHAT STRONG END"),
    ("insult", 1.0, "START POSS SHIT END"),
    ("insult", 0.5, "YOU ME WORTH|PAYME"),
    ("insult", 1.0, "YOU NOT WORTH NOTHING"),
    ("threat", 1.0, "WILL CRAM (DEF)? POSS BONE OF BEAT"),
    ("threat", 1.0, "WILL PUT FIRE IN|TOWARD POSS|YOU"),
    ("threat", 0.6, "WILL TE AWAIT"),
    ("threat", 0.4, "TE AWAIT IN|OF EXIT"),
    ("threat", 1.0, "WILL HARM WITH YOU|WITHYOU"),
    ("threat", 1.0, "WILL HARM WITHYOU"),
    ("threat", 1.0, "YOU BE (ART)? MAN KILLP"),
    ("hate", 1.0, "PLACE OF (DEF)? GROUP|SLUR BE IN HELLISH"),
    ("hate", 0.6, "RETURN TOWARD (DEF)? POSS LAND"),
    ("sexual", 1.0, "WANT|WILL SEX (DEF)? POSS BUTT|BODY"),
    ("sexual", 1.0, "MAKE SEXN WITH YOU"),
    ("sexual", 1.0, "SIT IN MY COCK|FACELAP"),
    ("sexual", 0.2, "WILL TE SEX"),
    ("sexual", 1.0, "WANT|WILL TE *1 NUDE"),
    ("threat", 1.0, "TE KILL1"),
    ("threat", 1.0, "KILL1 YOU"),
    ("threat", 1.0, "WILL TE (ALL)? KILLI"),
    ("threat", 1.0, "WILL KILLI YOU"),
    ("threat", 1.0, "WILL KILLI POSS|DEF (POSS)? FAMILY"),
    ("threat", 1.0, "WILL PUT ART BULLET *2 BODYPART|YOU"),
    ("threat", 1.0, "TE PUT ART BULLET"),
    ("threat", 1.0, "YOU GO (ALL)? DIE"),
    ("threat", 1.0, "WILL KILLI|HARM (DEF)? POSS BONE|FAMILY|BODYPART"),
    ("threat", 1.0, "WILL HARM WITH (DEF)? POSS BONE|FAMILY"),
    ("threat", 1.0, "POSS HOURS IS COUNTED END"),
    ("threat", 0.5, "YOU GO SELF REGRET"),
    ("hate", 1.0, "GROUP BE (ART)? DEBASE"),
    ("hate", 1.0, "GROUP|SLUR *2 DESERVE|HAS *2 KILLP|KILLI"),
    ("hate", 1.0, "GROUP|SLUR *1 HAS WHAT *1 EXPEL|KILLP|DIE"),
    ("hate", 1.0, "HATE1 (ALL)? (DEF)? (THIS)? GROUP|SLUR"),
    ("hate", 1.0, "DEATH TOWARD (ALL)? (DEF)? GROUP|SLUR"),
    ("hate", 1.0, "GROUP|SLUR NOT WORTH"),
    ("sexual", 1.0, "SEND (ME)? (POSSART)? NUDES"),
    ("sexual", 1.0, "SEND (ME)? (POSSART)? PHOTO *1 NUDE"),
    ("sexual", 1.0, "WANT TE SEX"),
    ("sexual", 1.0, "WANT|WILL SEX WITH YOU"),
    ("sexual", 1.0, "WANT|WILL SEX WITHYOU"),
    ("sexual", 1.0, "MAKE SEXN WITHME|WITHYOU"),
    ("sexual", 1.0, "COME SEX WITHME"),
    ("sexual", 1.0, "STAY OF COCK HARD"),
    ("sexual", 1.0, "WHAT BUTT HOT"),
    ("sexual", 1.0, "POSS BUTT (VERY)? HOT"),
)

#: What takes weight away from what follows in the clause, up to a comma or a "but": speech of others, and denial.
CONTEXTS = (
    ("said", "SAY *2 WHAT"),
    ("said", "ACCORDING *4 ,"),
    ("denied", "NOT *2 OPINE *1 WHAT"),
    ("denied", "NONE *2 OPINE|SAY *1 WHAT"),
    ("denied", "NOT BE *1 TRUE *1 WHAT"),
    ("denied", "BE *1 LIE *1 WHAT"),
    ("denied", "AFAR OF BE"),
)

FILL, STOP, COMMA, QUOTE = "x", ".", ",", '"'
_BEGIN, _END = "^", "$"
RUN = re.compile(r"(.)\1+")


@lru_cache(maxsize=1)
def alphabet() -> tuple[dict[str, str], dict[str, str]]:
    """Symbol of each word (squeezed), and the symbols of each class. Words of the same classes share a symbol."""
    squeezed: dict[str, set[str]] = {}
    for word, names in classes().items():
        squeezed.setdefault(RUN.sub(r"\1", word), set()).update(names)
    symbols: dict[frozenset, str] = {}
    of_word, of_class = {}, {}
    for word, names in squeezed.items():
        key = frozenset(names)
        if key not in symbols:
            symbols[key] = chr(0x4E00 + len(symbols))
            for n in names:
                of_class[n] = of_class.get(n, "") + symbols[key]
        of_word[word] = symbols[key]
    return of_word, of_class


def units(pattern: str) -> list[tuple[str | None, bool]]:
    """(symbols, optional) of each unit; None is any symbol inside the clause."""
    _, of_class = alphabet()
    out: list[tuple[str | None, bool]] = []
    for unit in pattern.split():
        if unit[0] == "*":
            out += [(None, True)] * int(unit[1:])
            continue
        optional = unit[0] == "("
        names = unit.strip("()?").split("|")
        border = {",": COMMA, "START": _BEGIN + COMMA, "END": COMMA + _END}
        out.append(("".join(border.get(n) or of_class[n] for n in names), optional))
    return out


class Automaton:
    """Which of the patterns occur in a clause, from one pass over its symbols."""

    MOST = 50_000  # states kept; with more, the automaton starts anew

    def __init__(self, patterns: Iterable[str]):
        self.into: dict[str, list[int]] = {}  # places whose next unit takes the symbol
        self.free: list[int] = []  # places whose next unit takes any symbol
        self.closed: list[frozenset[int]] = []  # a place with those behind its optional units
        self.last: dict[int, int] = {}
        first, at = [], 0
        for p, pattern in enumerate(patterns):
            row = units(pattern)
            first.append(at)
            for i, (symbols, _) in enumerate(row):
                for c in symbols if symbols is not None else ():
                    self.into.setdefault(c, []).append(at + i)
                if symbols is None:
                    self.free.append(at + i)
            for i in range(len(row) + 1):
                reach = i
                while reach < len(row) and row[reach][1]:
                    reach += 1
                self.closed.append(frozenset(range(at + i, at + reach + 1)))
            self.last[at + len(row)] = p
            at += len(row) + 1
        self.start = frozenset().union(*(self.closed[f] for f in first))
        self.into_set = {c: frozenset(v) for c, v in self.into.items()}
        self.free_set = frozenset(self.free)
        self.reset()

    def reset(self) -> None:
        self.states: dict[frozenset[int], int] = {self.start: 0}
        self.places: list[frozenset[int]] = [self.start]
        self.moves: list[dict[str, int]] = [{}]
        self.found: list[tuple[int, ...]] = [()]

    def step(self, state: int, symbol: str) -> int:
        places = self.places[state]
        taking = places & self.into_set.get(symbol, frozenset())
        if symbol not in (_BEGIN, _END):
            taking = taking | (places & self.free_set)
        then = self.start.union(*(self.closed[p + 1] for p in taking))
        to = self.states.get(then)
        if to is None:
            to = self.states[then] = len(self.places)
            self.places.append(then)
            self.moves.append({})
            self.found.append(tuple(self.last[p] for p in then if p in self.last))
        self.moves[state][symbol] = to
        return to

    def ends(self, clause: str) -> list[tuple[int, tuple[int, ...]]]:
        """(place, patterns) wherever patterns end; the place of an END is behind the clause."""
        if len(self.places) > self.MOST:
            self.reset()
        moves, found, out = self.moves, self.found, []
        state = moves[0].get(_BEGIN)
        if state is None:
            state = self.step(0, _BEGIN)
        for i, c in enumerate(clause):
            to = moves[state].get(c)
            state = self.step(state, c) if to is None else to
            if found[state]:
                out.append((i, found[state]))
        to = moves[state].get(_END)
        state = self.step(state, _END) if to is None else to
        if found[state]:
            out.append((len(clause), found[state]))
        return out


def machine(pattern: str) -> re.Pattern:
    """One pattern alone, to find where it starts and ends in a clause that has it."""
    _, of_class = alphabet()

    def unit(name: str) -> str:
        if name == "START":
            return "(?:^|(?<=[.,]))"
        if name.startswith("*"):
            return f"[^.]{{0,{name[1:]}}}?"
        optional = name.startswith("(")
        names = name.strip("()?").split("|")
        parts = [COMMA if n == "," else of_class[n] for n in names if n != "END"]
        group = "[" + "".join(parts) + "]" if parts else ""
        if "END" in names:
            group = f"(?:{group}|(?=[.,]|$))" if group else "(?=[.,]|$)"
        return group + ("?" if optional else "")

    return re.compile("".join(map(unit, pattern.split())))
