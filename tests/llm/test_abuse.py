import pytest

from tagloom.llm import abuse

CASES = [
    "Você é um idiota, Fulano, e todo mundo na Secretaria sabe disso.", "Cala a boca, sua anta, ninguém pediu parecer seu!!!",
    "CORJA DE VAGABUNDOS, SÓ SABEM ROUBAR R$ 10,00", "Vão todos à merda, que bosta de serviço", "sei onde você mora, Beltrano, e vou quebrar cada osso seu",
    "Espero que Fulano de Tal pegue uma doença bem lenta e cruel...", "Os forasteiros são a praga e deviam ser expulsos a pauladas de Lugar.",
    "quem tem a pele daquela cor só entende no chicote", "velho só atrapalha, deviam deixar morrer todos na fila do posto",
    "manda foto pelada que eu libero o teu processo 123", "quanto custa o programa, sua putinha?", "rolou suruba na garagem, ela gemia nua em cima dele e pedia mais",
    "Incendiar o acampamento com todos dentro, é disso que aqueles selvagens precisam!", "Se cruzar comigo você não volta para casa, pode apostar",
    "essa gestora é uma cobra, não sabe nem ligar o computador", "quadrilha de s a n g u e s s u g a s, só servem para roubar R$ 1,00.",
    "mulher em chefia dá nisso, lugar dessas v a d i a s é no tanque",
]
HARMLESS = [
    "A corregedoria registrou que a testemunha ouviu a palavra \" idiota \" no corredor.", "Sindicância apura se o servidor chamou colega de \" vagabundo \" em reunião.",
    "O acusado teria escrito: \" você é um idiota , sei onde você mora e vou quebrar cada osso seu \", segundo o boletim.",
    "Doação de 66 burros, 190 porcos e uma vaca apreendidos na estrada.", "Relatório sobre crimes de ódio e ameaças de morte a fiscal registra 7 casos.",
    "Curso de educação sexual e reprodutiva para 7 turmas.", "Matar mosquitos, queimar o lixo e enterrar o entulho: orientação da Gerência.",
    "Reputação, disputa, deputado e computador são termos do glossário.", "A anta do zoológico ganhou recinto.", "Exposição sobre nudez na escultura clássica.",
    "É exonerado o analista, por motivo de doação de sangue.", "O ônibus 843 não passa todos os dias e meu cachorro espera.", "", None, "   ", "12 34 ...",
]


@pytest.mark.parametrize("text", CASES)
def test_abuse_scores(text):
    assert abuse.score(text, abuse.Symbols())[0] >= 1


@pytest.mark.parametrize("text", HARMLESS)
def test_mention_does_not(text):
    s, kind, n = abuse.score(text, abuse.Symbols())
    assert s < 1 and n == 0
    if not (text or "").strip(" 1234."):
        assert (s, kind) == (0.0, None)


@pytest.mark.parametrize("spelled", ["idiota", "IDIOTA", "1d10t4", "i.d.i.o.t.a", "i d i o t a", "idi*ta", "iiidiooota", "idіоtа", "idi​ota", "ídìötã", "idioat", "i_d_i_o_t_a", "id!ota"])
def test_spellings(spelled):
    assert abuse.score(f"você é um {spelled}, Fulano", abuse.Symbols())[0] >= 1


def test_long_texts_are_scored_in_parts():
    text = "Texto neutro. " * 10 + CASES[0] + " Texto neutro. " * 10 + CASES[9] + ". Fim"
    assert "".join(abuse._parts(text, 40)) == text and len(list(abuse._parts(text, 40))) > 5
    assert abuse.score(text * 2_000, abuse.Symbols())[2] == 4_000


def test_rows_and_rates(spark):
    rows = [(1, CASES[0], "a"), (2, HARMLESS[0], "a"), (3, None, None), (4, "", "a"), (5, CASES[4] + " " + "texto neutro. " * 50_000, "b"), (1, CASES[0], "a"), (None, CASES[9], "b")]
    df = spark.createDataFrame([(*r, 0.5, "own") for r in rows], "doc_id long, text string, source string, score double, kind string")
    got = abuse.score_documents(df, "doc_id", "text", ["source"])
    assert got.columns == ["doc_id", "source", "score", "kind", "clauses"] and got.count() == len(rows)
    rates = {r.source: r for r in abuse.rates(got, "source").collect()}
    assert (rates["a"].documents, rates["a"].cases, rates["b"].cases, rates[None].cases) == (4, 2, 2, 0)
    assert (rates["a"].rate_bp, rates["b"].threat, rates["b"].sexual) == (5000, 1, 1)
    assert abuse.score_documents(df.limit(0), "doc_id", "text").count() == 0


def test_agreement_with_reviewers(spark, small):
    """Verdicts are noisy: about one in twenty-five is wrong either way."""
    from tagloom.llm.queries import QUERIES

    table = {(r.reviewed, r.scored): r.documents for r in QUERIES["p9_agreement"](spark, small.replace("0.001", "0.1")).collect()}
    agree = table.get((1, 1), 0) + table.get((0, 0), 0)
    assert agree / sum(table.values()) > 0.93
