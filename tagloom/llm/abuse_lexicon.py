"""The words of the abuse grammar by class, and the forms that are derived from them.

Words stand without accents, as the folding leaves them. A word may be in several classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

LEXICON = {
    "YOU": "voce voces tu ti te vc vcs senhor senhora senhores",
    "POSS": "seu sua seus suas teu tua teus tuas",
    "THIS": "esse essa esses essas este esta estes estas aquele aquela aqueles aquelas desse dessa desses dessas",
    "THATF": "daquela daquele daquelas daqueles dessa desse",
    "BE": "e sao eh foi era eram sou somos es",
    "ALWAYS": "sempre so apenas mesmo toda todo",
    "ART": "um uma uns umas",
    "DEF": "o a os as",
    "OF": "de do da dos das",
    "NOT": "nao nunca jamais",
    "NEITHER": "nem",
    "ALL": "tudo todos todas todo",
    "INSULT": (
        "idiota idiotas imbecil imbecis cretino cretina cretinos retardado retardada retardados canalha canalhas vagabundo "
        "vagabunda vagabundos vagabundas puta putas putinha vadia vadias vadio piranha piranhas estrume escroto escrota otario "
        "otaria otarios babaca babacas inutil inuteis ridiculo ridicula tapado tapada tapados palhaco palhaca palhacos capacho "
        "safado safada safados cafajeste cafajestes desgracado desgracada nojento nojenta nojentos asqueroso asquerosa imundo "
        "imunda imundos verme vermes parasita parasitas ladrao ladroes gentalha escoria lixo lesado debil mongol mongoloide "
        "trouxa pilantra pilantras salafrario picareta corrupto corruptos histerica histericas arrombado arrombada cuzao corno "
        "biscate rameira quenga bosta merda incompetente burro burra burros burras jumento jumenta besta asno energumeno patife "
        "pervertido pervertidos podre podres fedido fedida encostado encostada preguicoso preguicosa mentiroso mentirosa "
        "bandido bandidos marginal marginais hipocrita hipocritas miseravel analfabeto analfabeta matraca"),
    "ANIMAL": "vaca vacas cobra cobras anta antas rato ratos rata burro burra porco porca cadela cadelas jumento besta mula galinha piranha verme cachorra macaco macaca hiena urubu urubus barata baratas sanguessuga sanguessugas egua carrapato carrapatos",
    "FOUL": "nojento nojenta asqueroso asquerosa podre podres imundo imunda imundos fedido fedida horrendo horrenda repugnante desprezivel ridiculo ridicula humano humana",
    "JOB": (
        "analista tecnico tecnica fiscal auditor auditora gestor gestora medico medica professor professora engenheiro engenheira "
        "economista contador contadora bibliotecario bibliotecaria arquivista assessor assessora assistente agente perito perita "
        "revisor revisora psicologo psicologa enfermeiro enfermeira farmaceutico farmaceutica veterinario veterinaria nutricionista "
        "motorista consultor consultora estatistico estatistica procurador procuradora arquiteto arquiteta inspetor inspetora "
        "supervisor supervisora especialista servidor servidora atendente chefe diretor diretora secretario secretaria coordenador "
        "coordenadora funcionario funcionaria delegado delegada prefeito vereador deputado juiz juiza sujeito cara moca moco"),
    "BAND": "bando corja quadrilha cambada caterva malta",
    "ONLY": "so somente apenas",
    "KNOW": "sabem servem sabe serve querem prestam",
    "STEAL": "roubar furtar mamar enganar atrapalhar",
    "GO": "vai va vao vamos",
    "SELF": "se",
    "DAMN": "ferrar foder lascar danar catar fuder merda inferno puta",
    "WHAT": "que",
    "CRAP": "bosta merda porcaria droga",
    "SERVICE": "resposta servico atendimento reparticao orgao prefeitura gestao",
    "SHUT": "cala fecha cale feche calem",
    "MOUTH": "boca matraca bico latrina",
    "NOBODY": "ninguem",
    "ASKED": "pediu perguntou",
    "KNOWI": "sei descobri conheco achei",
    "WHERE": "onde endereco",
    "LIVE": "mora moras endereco trabalha estuda",
    "WILL": "vou vamos irei",
    "HARM": "quebrar matar esfaquear furar espancar arrebentar acabar estourar enforcar degolar surrar bater arrancar enterrar queimar incendiar explodir linchar fuzilar castrar",
    "BONE": "osso ossos cara dentes pernas pescoco vida raca cabeca",
    "AWAIT": "esperar pegar buscar",
    "WEAPON": "faca facao bala tiro arma revolver porrete paulada pauladas pau facada",
    "ANY": "qualquer um alguma",
    "HOUR": "hora dia",
    "SOMEONE": "alguem",
    "PIERCE": "fura passa mata pega mete enfia",
    "CHEER": "aplaudir brindar comemorar festejar rir",
    "CROSS": "cruzar topar aparecer",
    "WITHME": "comigo",
    "RETURN": "volta volte caixao sai sair",
    "BET": "apostar escrever apostem",
    "PAY": "pagar arrepender",
    "HOPE": "rezo espero tomara torco desejo oro quero",
    "GET": "pegue tenha morra sofra contraia apodreca pare",
    "DISEASE": "doenca cancer peste tumor infarto avc",
    "CRUEL": "cruel lenta lento demorada dolorosa sofrida horrivel",
    "BEST": "melhor",
    "MIGHT": "podia faria poderia fazia deveria",
    "VANISH": "sumir pular morrer desaparecer matar atirar enforcar jogar",
    "TRAIN": "trem ponte caminhao mapa carro onibus penhasco viaduto predio",
    "LIKE": "como feito igual",
    "TYPES": "tipos gente figuras criaturas pessoas sujeitos raca",
    "DESERVE": "devia deviam deveria deveriam merecia mereciam merece merecem tinha tinham precisam precisa podia podiam pode podem",
    "BREATHE": "respirar existir viver nascer",
    "AIR": "ar",
    "PEOPLE": "povo gente povinho raca turma pessoal tribo",
    "CREED": "seita religiao igreja crenca templo fronteira laia cor raca etnia terra aldeia",
    "GROUP": (
        "forasteiro forasteiros imigrante imigrantes migrante migrantes estrangeiro estrangeiros refugiado refugiados indio indios "
        "indigena indigenas cigano ciganos negro negros negra negras preto pretos judeu judeus muculmano muculmanos evangelico "
        "evangelicos macumbeiro macumbeiros nordestino nordestinos gay gays viado viados veado veados bicha bichas sapatao sapatona sapatoes "
        "lesbica lesbicas travesti travestis traveco favelado favelados mendigo mendigos aleijado aleijados doente doentes mental velho velhos "
        "velha velhas mulher mulheres selvagem selvagens pervertido pervertidos baitola boiola afeminado afeminados"),
    "SLUR": "viado viados veado veados bicha bichas sapatao sapatona sapatoes traveco baitola boiola pervertido pervertidos selvagem selvagens macumbeiro macumbeiros aleijado afeminado afeminados bichos animais",
    "DEBASE": (
        "praga peste pragas subraca raca lixo escoria gentalha imundos imundo imunda demonio demonios bandido bandidos selvagens ladroes vermes "
        "parasitas sanguessugas carrapatos urubus chupins ratos doenca cancer animais bichos sujos porcos vagabundos criminosos aberracao anormais nojo sub inferior inferiores"),
    "EXPEL": "expulsos expulso apanhar sumir varridos varrida varrido morrer apodrecer exterminados exterminado queimar banidos presos enjaulados sair castrados fuzilados eliminados eliminada deportados chicote",
    "BEAT": "pauladas paulada pau tiro chutes pontape bala porrada",
    "NORIGHT": "direito vaga cargo voto vez",
    "DEADWEIGHT": "peso morto estorvo fardo",
    "HINDER": "atrapalha atrapalham incomoda estorva",
    "LETT": "deixar deixem deixa",
    "QUEUE": "fila corredor sarjeta",
    "SKIN": "pele",
    "WHIP": "chicote chibata senzala servir tronco escravo",
    "UNDERSTANDS": "entende nasceu presta serve aprende obedece",
    "PLACE": "lugar",
    "KITCHEN": "cozinha tanque fogao pia casa cama",
    "CHEFIA": "chefia mando comando cargo politica direcao",
    "RENT": "alugo vendo contrato atendo emprego cumprimento",
    "GREET": "dou alugo vendo contrato",
    "CAME": "veio vem reza nasceu mora",
    "WORSHIP": "fronteira templo terreiro seita religiao mesquita sinagoga cor favela",
    "ARSON": "incendiar queimar explodir bombardear metralhar",
    "CAMP": "acampamento aldeia favela terreiro templo ocupacao quilombo abrigo mesquita",
    "INSIDE": "dentro",
    "NEED": "precisam merecem precisa merece",
    "NOTGIVE": "deviam devia receber merecem",
    "RECEIVE": "receber ter",
    "INFERIOR": "inferior sub-raca subraca gentalha imunda imundo",
    "RACE": "raca",
    "CRAWL": "rasteja rasteje volta volte some suma",
    "HOLE": "buraco esgoto bueiro chiqueiro lixao toca caverna jaula fossa pocilga",
    "BORN": "nasceu veio existe vive",
    "WASTE": "gastar ocupar consumir desperdicar",
    "OXY": "oxigenio espaco ar comida",
    "SWALLOW": "engolir comer enfiar",
    "STAMP": "carimbo caneta papel processo diploma",
    "HUMANWASTE": "zero aborto estrume lixo vergonha desgraca erro",
    "LEFT": "esquerda natureza humano humanidade",
    "SALARY": "salario",
    "LICK": "lambe cheira lamber",
    "DOG": "cachorro cao cadela",
    "FACE": "cara tamanho fucinho barriga",
    "MIRROR": "espelho balanca cadeira",
    "BEAR": "aguenta demissao quebra suporta pede",
    "UGLY": "horrenda horrendo criatura monstro baleia",
    "PASSOF": "passa passam",
    "CARPIR": "carpir trabalhar capinar",
    "LOT": "lote roca",
    "SIGNDO": "ligar assinar escrever ler",
    "DUMB": "computador nome",
    "SEX": (
        "transou transar transamos trepou trepar trepamos trepa gemia gemer gemendo gemeu cavalgava cavalgar cavalga chupar chupa chupava foder fode fodia fodeu "
        "meter gozar gozou gozando suruba putaria orgia boquete punheta siririca masturbar masturbava tesao excitado excitada buceta xoxota pica caralho "
        "rola pau comer rebola rebolar esfregar lamber"),
    "UNDRESS": "tirei tirou tirar desabotoa abre levanta abaixa arranca",
    "CLOTHES": "roupa calcinha blusa saia sutia camisa zíper calca vestido",
    "SITLAP": "colo",
    "SIT": "senta rebola sentar",
    "BODY": "peitos peitao peito bunda bundinha bundao meloes melao coxas tetas rabo seios raba corpo bocao",
    "WANT": "vontade quero queria louco doido",
    "TE": "te ti voce ela dele dela",
    "NICE": "gostoso gostosa gostosinho devagar pelada",
    "NUDE": "nua nu pelada pelado nudes peladinha",
    "ONTOP": "cima quatro",
    "MORE": "mais parar",
    "SEND": "manda mande envia mandar posta",
    "PHOTO": "foto fotos video videos nudes imagem",
    "FREE": "libero despacho assino aprovo resolvo solto agilizo",
    "PRICE": "quanto",
    "COST": "custa cobra faz sai",
    "TRICK": "programa hora noite noitada boquete chupeta completo",
    "HARD": "duro dura",
    "FEEL": "sentir ouvir ver cheirar pensar",
    "SMELL": "cheiro voz perfume",
    "DREAM": "sonhei acordei pensando sonhando imaginei",
    "SWEAT": "suor molhada molhado suada suado gritando",
    "ROLLED": "rolou teve fizemos",
    # contexts that take weight away
    "REPORT": (
        "registrou registra relatou disse afirmou escreveu declarou narrou ouviu ouvida palavra palavras chamou chamado chamada chamar "
        "apura apurou apurar apuracao consta denuncia denunciou denunciada denunciado acusado acusada suposta suposto segundo conforme transcreve transcrita citou cita "
        "frase termo termos expressao ofensa ofensas xingou xingamento depoimento boletim ocorrencia verbete glossario dicionario sindicancia corregedoria testemunha alegou teria"),
    "NOTICE": (
        "relatorio campanha curso palestra exposicao vacinacao doacao leilao zoologico aviso orientacao distribuicao combate prevencao "
        "seminario mostra filme museu escultura adocao cartilha canil apreendidos crimes exterminio extermino dedetizacao glossario "
        "discriminacao intolerancia demitido penalidade"),
    # small words

    "WITH": "com", "THING": "coisa criatura", "IN": "em no na num numa nos nas", "COFFIN": "caixao saco", "CAN": "pode podem",
    "DEAR": "caro", "SAME": "mesmo", "AND": "e", "UNTIL": "ate", "TURN": "virar", "GIVE": "da dao", "HERS": "dela ela delas",
    "MY": "meu minha", "I": "eu", "HAS": "tem", "ASK": "pedia pede pedindo", "PAYI": "pago pagamos", "MONEY": "r reais",
    "STAY": "fico fiquei ficou", "COCK": "pau pica rola", "SCREAM": "gritando gemendo chamando", "NAME": "nome",
    "SON": "filho filha filhos", "BORE": "pariu", "LEFTOUT": "saiu surgiu",
    # words that are an insult to whoever is called so; their forms by number, gender and size are derived
    "STRONG": (
        "idiota imbecil cretino retardado canalha vagabundo puta vadia estrume escroto otario babaca palhaco cafajeste desgracado nojento "
        "asqueroso debil mongol mongoloide trouxa pilantra salafrario arrombado cuzao corno biscate rameira quenga energumeno patife "
        "pervertido hipocrita fdp panaca pateta paspalho mane estupido burro asno jumento tapado safado crapula verme inutil"),
    "HATE1": "odeio detesto desprezo abomino repudio",
    "DEATH": "morte", "TOWARD": "a ao aos as para pra pros pras contra",
    "WORTH": "presta prestam vale valem",
    "PUT": "atear tacar jogar tocar por meter meto enfiar enfio botar boto cravar cravo dar dou mandar acertar acerto",
    "BULLET": "bala balas tiro tiros facada facadas chumbo faca pancada",
    "FAMILY": "familia filho filhos filha filhas mae pai mulher irmao irma neto netos",
    "BODYPART": "cabeca testa cara peito pescoco garganta costas nuca barriga boca",
    "DIE": "morrer apanhar sangrar", "REGRET": "arrepender pagar",
    "NUDES": "nudes nude", "ME": "me", "WITHYOU": "contigo", "HOT": "gostosa gostoso gostosas gostosos deliciosa delicioso tesuda tesudo gostosona",
    "BUTT": "bunda bundinha bundao rabo raba peitos peitinhos coxas buceta xoxota pica rola boquinha", "MAKE": "fazer faz faca fazemos", "SEXN": "sexo amor oral anal",
    "TAKE": "tomar", "ASS": "cu", "SHIT": "merda bosta", "PAYME": "paga pagas", "NOTHING": "nada", "CRAM": "encher cobrir", "FIRE": "fogo", "EXIT": "saida esquina rua porrada",
    "MAN": "homem cara", "HELLISH": "inferno cadeia cemiterio lixo jaula senzala cozinha esgoto chiqueiro forca fogueira", "LAND": "terra pais buraco", "FACELAP": "colo cara",
    "COME": "vem venha vamos bora quer topa", "IS": "estao esta", "COUNTED": "contados contadas contada", "HOURS": "dias horas hora",
    "VERY": "muito mesmo bem tao bastante realmente completamente totalmente verdadeiro verdadeira grande belo bela tremendo tremenda baita perfeito perfeita",
    "POSSART": "um uma uns umas seu sua seus suas teu tua teus tuas",
    "ADVERB": "sempre so apenas mesmo toda todo muito bem tao bastante realmente completamente totalmente",
    # contexts: who says what, and that it is not so
    "SAY": (
        "disse diz dizem disseram dizia diziam afirmou afirma afirmam afirmaram relatou relata relataram declarou declara declararam alegou alega alegaram "
        "dizer afirmar declarar escrever publicar postar gritar dizendo afirmando alegando gritando escreveu escreveram gritou gritaram falou falaram contou contaram narrou narra comentou insinuou sugeriu acusou publicou postou leu ouviu lembrou"),
    "ACCORDING": "segundo conforme", "NONE": "ninguem",
    "OPINE": "acho achei achamos penso pensei creio cremos considero considera acredito acreditamos acha acham parece pareceu disse digo diria diz dizemos afirmo afirmei concordo aceito admito quis quero",
    "TRUE": "verdade verdadeiro certo correto justo", "LIE": "mentira falso falsa boato calunia engano", "AFAR": "longe", "BUT": "mas porem contudo entretanto so",
}

#: Verbs whose forms are derived, by class: every form of harm done or suffered.
VERBS = {
    "KILL": "matar esfaquear espancar arrebentar enforcar degolar surrar estourar fuzilar castrar linchar quebrar estrangular apedrejar torturar esganar estripar",
}
#: Classes all of whose words have their forms by number and gender derived.
NOMINAL = ("INSULT", "STRONG", "GROUP", "SLUR", "FOUL")


def nominal(word: str) -> set[str]:
    """A noun or adjective with its plurals and its other gender."""
    stem = word[:-1]
    if word.endswith("ao"):
        return {word, stem + "es", word + "s", word[:-2] + "oes", word[:-2] + "ona", word[:-2] + "onas"}
    if word.endswith("o"):
        return {word, stem + "a", word + "s", stem + "as"}
    if word.endswith(("a", "e", "u")):
        return {word, word + "s"}
    if word.endswith("or"):
        return {word, word + "a", word + "es", word + "as"}
    if word.endswith("il"):
        return {word, word[:-2] + "is", word[:-2] + "eis"}
    if word.endswith("l"):
        return {word, stem + "is"}
    if word.endswith(("r", "z")):
        return {word, word + "es"}
    if word.endswith("m"):
        return {word, stem + "ns"}
    return {word}


def sized(word: str) -> set[str]:
    """The small and the large form of a noun."""
    stem = word[:-1] if word[-1] in "oae" else ""
    return {stem + end for end in ("inho", "inha", "inhos", "inhas", "aco", "aca")} if len(stem) > 3 else set()


def verbal(infinitive: str) -> dict[str, set[str]]:
    """Forms of a regular verb: what I do, the infinitive, the participles, and all others."""
    stem, vowel = infinitive[:-2], infinitive[-2]
    before_e = stem[:-1] + "qu" if stem.endswith("c") else stem + "u" if stem.endswith("g") else stem
    eio = stem[:-1] + "ei" if stem.endswith("e") else stem
    done = stem + {"a": "ad", "e": "id", "i": "id"}[vowel]
    if vowel == "a":
        now, subjunctive = {eio + "a", eio + "am"}, {before_e + "e", before_e + "em"}
        past = {before_e + "ei", stem + "ou", stem + "aram", stem + "ava", stem + "avam"}
    else:
        now, subjunctive = {stem + "e", stem + "em"}, {stem + "a", stem + "am"}
        past = {stem + "i", stem + vowel + "u", stem + vowel + "ram", stem + "ia", stem + "iam"}
    return {
        "1": {eio + "o"}, "I": {infinitive}, "P": {done + x for x in ("o", "a", "os", "as")},
        "": now | subjunctive | past | {infinitive + x for x in ("ei", "a", "emos", "ao", "ia", "iam", "em")} | {stem + vowel + "ndo"},
    }


def _entries() -> Iterator[tuple[str, str]]:
    for name, line in LEXICON.items():
        for word in line.split():
            yield from ((name, form) for form in (nominal(word) if name in NOMINAL else {word}))
            if name == "STRONG":
                yield from ((name, form) for form in sized(word))
    for name, line in VERBS.items():
        for verb in line.split():
            for part, forms in verbal(verb).items():
                yield from ((name + part, form) for form in forms)
    # irregular participles
    yield from (("KILLP", form) for word in ("morto", "expulso", "extinto") for form in nominal(word))


@lru_cache(maxsize=1)
def classes() -> dict[str, frozenset[str]]:
    """The classes of every word and derived form."""
    out: dict[str, set[str]] = {}
    for name, word in _entries():
        out.setdefault(word, set()).add(name)
    return {word: frozenset(names) for word, names in out.items()}
