"""Which language a text is in: by the common words of each language, its script, and the letter groups of its words."""

from __future__ import annotations

import math
import re
import unicodedata

# Function words of each language.
FUNCTION_WORDS = {
    "en": """the of and to is it in that this these those as at by be am are was were been being with for from which what how many much who whom whose where when why while have has had having must should shall can could
        may might will would do does did done doing on its so i you he she we they me him her us them my your his our their there here not no yes if than then because since about into over under after before between
        through during without within against upon very more most some any each every both all other another such only own same too just also please""",
    "es": """el la los las lo un una unos unas de del al y e o u en que es son está están era fue ser estar ha han hay se ya no sí por para con sin su sus mi mis tu tus le les me te nos más menos muy qué quién quiénes
        cuál cuáles cuánto cuánta cuántos cuántas cómo cuándo dónde hacia hasta desde entre sobre según como cuando donde si pero porque este esta estos estas ese esa eso aquel aquella todo toda todos todas otro otra también""",
    "de": """der die das den dem des ein eine einen einem einer eines und oder aber ist sind war waren sein im in am an auf aus bei mit nach von vom zu zur zum für durch gegen ohne um über unter vor hinter neben zwischen
        nicht kein keine keinen ja nein er sie es ich du wir ihr mich dich uns ihm ihn ihnen mein dein sich muss müssen kann können soll wird werden hat haben hatte wie viel viele welche welcher welches wer was wo wohin
        woher wann warum schon noch auch nur sehr mehr dass wenn weil als damit davon dort hier hin her""",
    "fr": """le la les l' un une des du de d' et ou mais est sont était être été il elle ils elles on nous vous je tu me te se ce cet cette ces y en a ont avoir au aux à dans sur sous vers par pour avec sans chez entre
        pas ne ni que qui quoi dont où quand comment combien pourquoi quel quelle quels quelles oui non plus moins très tout toute tous toutes déjà encore aussi leur leurs mon ma mes son sa ses notre votre""",
    "pt": """o a os as um uma uns umas do da dos das de e ou mas é são era foi ser estar está estão em no na nos nas ao aos à às que quem qual quais quanto quantos quantas como quando onde por para pelo pela com sem não
        sim já ainda mais menos muito há se seu sua seus suas meu minha ele ela eles elas nós você vocês isto isso este esta esse essa também""",
    "it": """il lo la i gli le l' un uno una di del dello della dei degli delle da dal dalla e o ma è sono era essere stato in nel nella nei nelle a al alla ai alle su sul sulla che chi cosa quale quali quanto quanti quante
        come quando dove per con senza tra fra non sì no già ancora più meno molto ci si mi ti vi suo sua loro questo questa quello quella anche""",
    "nl": """de het een en of maar is zijn was waren ben er in op aan bij naar van voor met zonder door over onder tegen tussen uit om tot niet geen ja nee hij zij ze ik jij je wij we u mij hem haar ons hun zich moet
        moeten kan kunnen zal zullen wordt worden heeft hebben had al nog ook maar zeer meer wat wie waar wanneer waarom hoe hoeveel welke dat die dit deze als dan""",
}
# The first article of the Universal Declaration of Human Rights, from which the letter groups of each language are counted.
ARTICLE = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
}
# Scripts that tell a language apart by themselves.
SCRIPTS = ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "CYRILLIC", "ARABIC", "GREEK", "HEBREW", "DEVANAGARI", "THAI", "GEORGIAN", "ARMENIAN", "BENGALI", "TAMIL")
#: Words of a text from which letter groups decide, and nats by which the first language must lead.
LEAST_WORDS, LEAD = 4, 1.0
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
# Codes such as ab-12, whose letters are no words.
_CODE = re.compile(r"\b[A-Za-z]+-\d+\b")
# Words that short answers consist of: numbers, sides, directions and what agrees or declines.
ANSWER_WORDS = {
    "en": "one two three four five six seven eight nine ten zero none left right straight ahead front back forward backward north south east west northeast northwest southeast southwest yes no true false keep turn already facing sorry answer reply",
    "es": "uno dos tres cuatro cinco seis siete ocho nueve diez cero ninguno izquierda derecha recto delante detrás atrás adelante norte sur este oeste noreste noroeste sureste suroeste nordeste sudeste sudoeste verdadero falso girar gira mira seguir lado primero llegado todavía puedo siento tengo",
    "de": "eins zwei drei vier fünf sechs sieben acht neun zehn null keins links rechts geradeaus vorne hinten vorwärts rückwärts norden süden osten westen nordosten nordwesten südosten südwesten nord süd ost west wahr falsch abbiegen drehen weiterfahren insgesamt liegt zeigt erreicht angekommen stück",
    "fr": "deux trois quatre cinq six sept huit neuf dix zéro aucun gauche droite droit devant derrière avant arrière nord sud est ouest nord-est nord-ouest sud-est sud-ouest vrai faux tourner tourne arrivé face numéro",
    "pt": "dois duas três quatro cinco seis sete oito nove dez zero nenhum nenhuma esquerda direita frente atrás diante norte sul leste oeste nordeste noroeste sudeste sudoeste verdadeiro falso virar seguir chegou fica perto",
    "it": "due tre quattro cinque sei sette otto nove dieci zero nessuno sinistra destra dritto davanti dietro nord sud est ovest nordest nordovest sudest sudovest vero falso girare gira arrivato vicino",
    "nl": "twee drie vier vijf zes zeven acht negen tien nul geen links rechts rechtdoor voren achter noorden zuiden oosten westen noordoosten noordwesten zuidoosten zuidwesten waar onwaar draaien aangekomen",
}
VOTES: dict[str, set[str]] = {}
for _lists in (FUNCTION_WORDS, ANSWER_WORDS):
    for _lang, _words in _lists.items():
        for _w in _words.replace("'", "").split():
            VOTES.setdefault(_w, set()).add(_lang)


def words_of(text: str) -> list[str]:
    return _WORD.findall(_CODE.sub(" ", unicodedata.normalize("NFC", text)).lower())


def groups(word: str) -> list[str]:
    """The runs of three letters of a word and its borders."""
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


def _profiles() -> dict[str, dict[str, float]]:
    out = {}
    for lang, text in ARTICLE.items():
        n: dict[str, float] = {}
        for w in words_of(text) * 2 + FUNCTION_WORDS[lang].replace("'", "").split():
            for g in groups(w):
                n[g] = n.get(g, 0) + 1
        total = sum(n.values()) + 3000
        out[lang] = {g: math.log((k + 0.5) / total) for g, k in n.items()} | {"": math.log(0.5 / total)}
    return out


_PROFILES = _profiles()


def by_letters(words: list[str]) -> str | None:
    """The language whose letter groups a text of enough words has, None without a clear lead; per word, so that long texts need no more."""
    plain = [w for w in words if len(w) > 1]
    if len(plain) < LEAST_WORDS:
        return None
    got = sorted(((sum(p.get(g, p[""]) for w in plain for g in groups(w)) / len(plain), lang) for lang, p in _PROFILES.items()), reverse=True)
    return got[0][1] if (got[0][0] - got[1][0]) * len(plain) >= LEAD * 3 else None


def script_of(word: str) -> str | None:
    """The script of a word beyond ASCII, '?' for letters with marks."""
    if word.isascii():
        return None
    name = unicodedata.name(next(c for c in word if ord(c) > 127), "")
    return next((s for s in SCRIPTS if name.startswith(s)), "?")


def votes(words: list[str]) -> dict[str, int]:
    """(language or script, votes) of a text's words; letters beyond ASCII that no listed word explains vote for '?'."""
    out: dict[str, int] = {}
    for w in words:
        for p in [w] if w in VOTES else w.split("-"):
            if p in VOTES:
                for lang in VOTES[p]:
                    out[lang] = out.get(lang, 0) + 1
            elif (script := script_of(p)) is not None:
                out[script] = out.get(script, 0) + (3 if script != "?" else 1)
    return out


def language(words: list[str]) -> str | None:
    """The language or script with most votes; without any, or if two lead, that of the letter groups, None if these tell nothing."""
    got = sorted(votes(words).items(), key=lambda x: -x[1])
    if not got or got[0][0] == "?" or len(got) > 1 and got[0][1] == got[1][1]:
        return by_letters(words)
    return got[0][0]
