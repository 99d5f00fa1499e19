"""Refusals: an automaton of phrases in several languages, and the make of English ones."""

from __future__ import annotations

import re
import unicodedata

# Phrases by which a reply declines, in lower case, apostrophes as '.
PHRASES = """
can't answer; cannot answer; can not answer; can't determine; cannot determine; can't help; cannot help; can't assist; cannot assist; can't say; cannot say;
can't tell; cannot tell; can't judge; cannot judge; can't provide; cannot provide; can't comply; cannot comply; can't see any; cannot see any; can't view; cannot view;
can't see the image; cannot see the image; can't see the picture; cannot see the picture; can't respond; cannot respond; can't reply; cannot reply; can't give; cannot give;
can't be fulfilled; cannot be fulfilled; can't be answered; cannot be answered; can't process; cannot process; can't access; cannot access; can't share; cannot share;
couldn't answer; could not answer; unable to answer; unable to help; unable to assist; unable to comply; unable to determine; unable to see; unable to say;
unable to provide; unable to judge; unable to respond; unable to reply; unable to view; unable to access; unable to tell; unable to give; unable to process; not able to see; not able to answer;
not able to help; not able to assist; not able to determine; not able to judge; not able to say; not able to view; not able to provide; not able to respond;
won't make a guess; will not make a guess; won't guess; won't answer; will not answer; won't help; won't reply; won't respond; must decline; have to decline; i decline; decline to answer;
declining to answer; refuse to answer; refusing to answer; i refuse; refuse to; rather not reply; rather not answer; rather not say; prefer not to; don't have access; do not have access; no access to the image;
isn't possible for me; is not possible for me; it's not possible for me; impossible for me; not something i can; outside of my abilities; outside my abilities; beyond my abilities; beyond what i may do;
beyond my capabilities; no comment; not allowed to; not permitted to; not comfortable; against my guidelines; as an assistant i can't; i must abstain;
no puedo responder; no puedo contestar; no puedo ayudar; no puedo ver; no puedo determinar; no puedo decir; no puedo dar; no puedo juzgar; no puedo hacerlo; no puedo acceder; no tengo acceso; no me es posible; no es posible para mí;
prefiero no; no estoy en condiciones; no quiero responder; me niego; no soy capaz; no podría responder; no voy a responder; debo rechazar; lamento no poder; siento no poder;
kann ich nicht beantworten; kann das nicht beantworten; kann ich hier nicht; kann ich leider nicht; nicht beantworten; nicht helfen; keinen zugriff; keine auskunft; keine antwort geben; nicht sagen; nicht beurteilen;
möchte ich nicht; möchte nicht antworten; nicht möglich; lehne ich ab; verweigere; darf ich nicht; bin nicht in der lage; außerstande; nicht erkennen kann
"""


# Words of a refusal by its make: who declines, what keeps from it, what is not done, and rules.
SELF = set("i i'm i'll i'd we we're we'll yo ich wir je".split())
BARRED = set("can't cannot couldn't won't unable refuse decline declining declined abstain refrain wouldn't shouldn't mustn't".split())
NOT = {"not", "never"}
ABLE = set("can could will would able allowed permitted going willing may must should comfortable".split())
DEED = set("answer help assist say tell comply respond reply provide determine judge discuss share give process continue fulfill fulfil complete access guess".split())
PASS = {("pass", "on"), ("skip", "this"), ("sit", "out"), ("opt", "out"), ("leave", "it"), ("stay", "out")}
RULES = set("policy policies guidelines rules terms restrictions safety".split())
AGAINST = set("against violates violate violating breaks breach breaches outside beyond".split())
#: Words within which the parts of a refusal follow each other.
NEAR = 5


def declines(words: list[str]) -> bool:
    """True if the words have the make of a refusal: someone who can't or won't do what is asked, or passes it on, or rules against it."""
    for i, w in enumerate(words):
        if w in AGAINST and any(v in RULES for v in words[i + 1 : i + 1 + NEAR]):
            return True
        if w not in SELF:
            continue
        near = words[i + 1 : i + 1 + NEAR]
        for k, v in enumerate(near):
            barred = v in BARRED or v in NOT and k > 0 and (near[k - 1] in ABLE or near[k - 1] in ("am", "are")) or w in ("i'm", "we're") and v in NOT
            if barred and any(x in DEED for x in words[i + 2 + k : i + 2 + k + NEAR]) or (v, words[i + 2 + k] if i + 2 + k < len(words) else "") in PASS and v not in DEED:
                return True
    return False


class PhraseAutomaton:
    """Aho-Corasick over words: finds whether any phrase occurs as a run of whole words."""

    def __init__(self, phrases: list[list[str]]):
        self.go: list[dict[str, int]] = [{}]
        self.end, self.fail = [False], [0]
        for words in phrases:
            at = 0
            for w in words:
                if w not in self.go[at]:
                    self.go.append({})
                    self.end.append(False)
                    self.fail.append(0)
                    self.go[at][w] = len(self.go) - 1
                at = self.go[at][w]
            self.end[at] = True
        queue = list(self.go[0].values())
        for at in queue:
            for w, to in self.go[at].items():
                f = self.fail[at]
                while f and w not in self.go[f]:
                    f = self.fail[f]
                self.fail[to] = self.go[f].get(w, 0)
                self.end[to] = self.end[to] or self.end[self.fail[to]]
                queue.append(to)

    def finds(self, words: list[str]) -> bool:
        at = 0
        for w in words:
            while at and w not in self.go[at]:
                at = self.fail[at]
            at = self.go[at].get(w, 0)
            if self.end[at]:
                return True
        return False


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:'[^\W_]+)*", unicodedata.normalize("NFC", text).lower().replace("’", "'"))


AUTOMATON = PhraseAutomaton([words_of(p) for p in PHRASES.replace("\n", " ").split(";") if p.strip()])


def refuses(text: str) -> bool:
    """True if the text has a refusal phrase or the make of one."""
    words = words_of(text)
    return AUTOMATON.finds(words) or declines(words)
