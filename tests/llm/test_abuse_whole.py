"""Every clause is weighed by the whole grammar."""

import random

from tagloom.llm import abuse


def _instances(name: str, rng: random.Random) -> str:
    """Symbols of one pattern, with random words of its classes and random gaps."""
    _, of_class = abuse._alphabet()
    every = "".join(of_class.values()) + abuse.FILL + abuse.COMMA
    out = ""
    for unit in name.split():
        if unit == ",":
            out += abuse.COMMA
        elif unit.startswith("*"):
            out += "".join(rng.choices(every, k=rng.randint(0, int(unit[1:]))))
        elif unit.startswith("("):
            out += rng.choice(["", rng.choice(of_class[unit.strip("()?")])])
        elif unit not in ("START", "END"):
            out += rng.choice("".join(of_class[n] for n in unit.split("|")))
    return out


def test_skipping_never_changes_a_score(monkeypatch):
    rng = random.Random(9)
    _, of_class = abuse._alphabet()
    filling = "".join(of_class.values()) + abuse.FILL * 200
    texts = [_instances(pattern, rng) for _, _, pattern in abuse.GRAMMAR for _ in range(20)]
    texts += [f"{a},{b}" for a, b in zip(texts, rng.sample(texts, len(texts)))]
    texts += ["".join(rng.choices(filling, k=12)) for _ in range(500)]
    got = [list(abuse.clauses(t)) for t in texts]

    class Everything:
        """Tries every pattern everywhere; contexts as ever."""

        def ends(self, clause):
            return [(0, tuple(range(len(abuse.GRAMMAR))))]

    contexts = abuse._automata()[1]
    monkeypatch.setattr(abuse, "_automata", lambda: (Everything(), contexts))
    assert got == [list(abuse.clauses(t)) for t in texts]
    assert sum(map(bool, got)) > len(abuse.GRAMMAR) * 20


def test_every_pattern_alone_scores():
    """No word of the lexicon, however usual in notices, takes a pattern out of the search."""
    rng = random.Random(1)
    for kind, weight, pattern in abuse.GRAMMAR:
        for _ in range(20):
            line = _instances(pattern, rng)
            found = [m for _, _, m in abuse._machines() if m.search(line)]
            assert not found or list(abuse.clauses(line)), pattern


def test_usual_words_do_not_hide_their_class():
    assert abuse.score("povo daquela seita é tudo raça ruim", abuse.Symbols())[::2] == (2.0, 1)
    assert abuse.score("manda foto íntima que eu libero o teu processo", abuse.Symbols())[0] >= 1


def _score(text: str) -> float:
    return abuse.score(text, abuse.Symbols())[0]


def test_a_quoted_match_does_not_hide_a_later_one():
    assert _score('Disse "você é um idiota"') < 1
    assert _score('Disse "você é um idiota" e eu repito que você é um idiota mesmo') >= 1
    assert _score('"você é um idiota" e eu acho isso também, pois você é um idiota') >= 1
    assert _score('Disse "você é um idiota" e depois "você é um idiota"') < 1


def test_a_notice_does_not_hide_a_later_match():
    mention = "o relatório diz que você é um idiota"
    far = " mesa" * 20
    assert _score(mention) < 1
    assert _score(mention + far) < 1
    assert _score(mention + far + " você é um idiota") >= 1


def test_a_pattern_counts_once_a_clause():
    once, twice = (_score("cala a boca" + end) for end in (" agora", " agora, cala a boca"))
    assert once == twice == 0.6


def test_many_matches_in_one_long_clause():
    text = 'Disse "' + "você é um idiota " * 10_000
    assert _score(text) < 1
