"""Problem 9: abusive, hateful or sexual content.

A lexicon of terms is a trie; a Levenshtein automaton for each word of a text is intersected with it, so
misspelled, masked and misread terms are met as well as exact ones: a letter left out, added, swapped or
put for another is one edit, masks (digits and signs for letters, stars) and look-alike letters of scans
cost less. A word that a public vocabulary holds is no misspelling of another. Matched terms are then
judged in their context window, the sentence: slurs count where they are turned on somebody, not where a
word beside them reports them, says them of oneself or means them literally; rules name classes of terms
that follow one another (threats, contempt, hatred of groups, sexual acts), and their weights add up.
Heads between the lines of a sentence are read over.

The score of a document is the highest score of its sentences: that of its worst kind and half of the
others; from 1.0 it is a case. Null and empty texts score 0.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.confusables import consistent_form

#: Score from which a document is a case.
CASE = 1.0

# --- fixed values: terms of the lexicon; nouns that insult, in English, and in French and Spanish ---
SLURS = """
asshole assholes bastard bastards bitch bitches blockhead blockheads buffoon buffoons cockroach cockroaches cocksucker cocksuckers crackpot crackpots cretin cretins cunt cunts degenerate degenerates dimwit dimwits dirtbag dirtbags dolt dolts
dunce dunces dyke dykes faggot faggots filth fucker fuckers halfwit halfwits harlot harlots hussy hussies idiot idiots imbecile imbeciles jackass jackasses kike kikes leech leeches lowlife lowlifes louse maggot maggots moron morons motherfucker
motherfuckers nigger niggers nitwit nitwits numbskull numbskulls parasite parasites pervert perverts pig pigs prick pricks rat rats retard retards scoundrel scoundrels scum scumbag scumbags shithead shitheads simpleton simpletons skunk slob slobs slut
sluts sow spic spics swine toad toads tramp trash trollop trollops turd turds twat twats vermin wanker wankers weasel weasels whore whores wop wops worm worms wretch wretches
"""
SLURS_ELSEWHERE = """
abruti abrutis bastardo bastardos bâtard bâtards cabrón cabron cabrones charogne connard connards connasse crétin crétins cretino cretinos enculé enculés fumier gilipollas hijoputa imbécil imbéciles imbécile imbéciles malparido maricón maricones
mierda ordure ordures pendejo pendejos puta putas pute putes puto putos salaud salauds salope salopes zorra zorras
"""
SCORN = """
abominable bloody brainless contemptible cowardly crooked damn damned despicable dirty disgusting fat filthy foul fucking goddamn good-for-nothing gutless hideous idiotic ignorant loathsome lousy miserable mindless nasty pathetic putrid repulsive revolting
rotten senseless shameless slimy sniveling spineless stinking stupid ugly useless vile witless worthless wretched
"""
SCORN_ELSEWHERE = "espèce maldito maldita malditos asqueroso asquerosa estúpido estúpida maudit maudite dégoûtant dégoûtante sale sucio sucia"
TARGET_ELSEWHERE = "tu tú toi es êtes eres sois usted ustedes espèce t"
#: Words that report a slur beside them: verbs of naming, and words about words.
NAMING = "called call calling calls"
REPORT = "word words quoted quote spelled dictionary blotted"
#: Words that mean a slur literally where they stand beside it, each for its own slurs only.
LITERAL = {
    "bitch bitches": "whelped whelp pups puppies litter kennel hounds barn",
    "pig pigs swine sow": "butcher mutton pork bacon lard sty barn farmer herd trough",
    "vermin parasite parasites worm worms maggot maggots leech leeches louse cockroach cockroaches rat rats toad toads weasel weasels skunk": "grain barn larder granary crops soil bait specimen botanist surgeon trap traps cellar poison cat",
    "filth trash scum": "swept bin heap pond gutter",
    "tramp": "steamer road walk long march",
}

# --- fixed values: classes of terms that the rules name ---
CLASSES = {
    "scorn": SCORN,
    "violence": "beat break burn bury butcher choke cripple crush cut destroy drown flog gut hang horsewhip kick kill knife lynch maim massacre murder poison pound shoot skin slap slaughter slit smash stab strangle thrash throttle torture wring",
    "ended": "beaten burned burnt butchered caned castrated deported drowned eliminated expelled exterminated flogged gassed hanged horsewhipped jailed killed lynched murdered shot slaughtered sterilized strangled tarred thrashed whipped wiped",
    "die": "burn choke croak die drown hang perish rot starve suffer suffocate",
    "self": "drown hang kill poison shoot strangle",
    "limb": "arm arms back bones ears eyes face finger fingers hand hands head jaw knees leg legs mouth neck nose ribs skull teeth throat tongue",
    "home": "bed children door family farm home house kids mother office roof shop store wife",
    "you": "you your yours",
    "who": "he her him his she that their them these they this those you your",
    "will": "gonna going ll mean shall swear will would",
    "must": "deserve deserves deserved must needs ought should",
    "group": "arabs aliens blacks catholics chinamen cripples foreigners germans gypsies heathens homosexuals immigrants indians italians japs jew jews mexicans muslims natives negro negroes orientals outsiders poles protestants queers refugees strangers turks women womenfolk",
    "kind": "clan families family folk kin kind men nation ones people race sort tribe",
    "beasts": "animals apes beasts brutes cockroaches contagion curs degenerates disease dogs filth germs inferior insects lice locusts maggots mongrels monkeys parasites pest pests pestilence plague rats rubbish savages scourge scum subhuman subhumans swine vermin",
    "crooks": "beggars criminals cutthroats killers liars murderers rapists robbers thieves traitors whores",
    "away": "banished chased cleared cleaned driven drive expel flushed kicked locked rooted rounded run scrubbed swept thrown",
    "groupe": "étrangers juifs arabes femmes noirs immigrés gitans nègres extranjeros judíos árabes mujeres negros inmigrantes gitanos",
    "bêtes": "vermine rats animaux bêtes parasites poux peste sauvages ratas animales bestias parásitos piojos plaga salvajes escoria alimañas basura",
    "explicit": """blowjob clitoris copulated copulating copulation cunnilingus ejaculated erection fellatio foreplay fucked fucking genitals intercourse masturbate masturbated masturbating nipple nipples orgasm orgasms penis pornographic pornography vagina
        baisé baisait enculait éjacula branlait follar follaba follamos masturbaba masturbait eyaculó""",
    "bare": "bare naked nude undressed unclothed stripped nue nues desnuda desnudas",
    "body": "bodies body breast breasts bosom buttocks crotch flesh groin hips legs loins thigh thighs seins cuisses pechos muslos",
    "act": "aroused caressed caressing climaxed fondled groaned harden moan moaned moaning mounted panted panting straddled stroked thrust thrusting writhed writhing gémit gemía",
    "bedding": "bed bedroom belt corset garter gown lover lovers mattress nightgown petticoat sheets skirt stockings",
    "heat": "begged hungry kissed lust lustful nakedness passion pressed quivering sweat sweating trembling wet",
    "pictures": "cards film films photographs pictures postcards prints",
}
# --- fixed values: rules; a kind and a weight, then classes (named with @, or their words) that follow one another with at most
# three others (|) or one other (>) between, no denial among them. The weights of a sentence's rules of one kind add up, each rule
# once. A sentence is judged where a word of the class marked * stands ---
RULES = """
threat 1.0: i we somebody someone they | @will @must | *@violence > @you
threat 1.0: i we somebody someone they | @will @must | *@violence > every that his her the | @limb @home
threat 0.6: @must | be > *@ended
threat 0.8: *spit puke piss | your > face head grave mouth
threat 1.0: hope wish pray | you | *@die
threat 1.0: you > @must | *@die @ended
threat 1.0: *@self > yourself yourselves
threat 0.4: nobody none | will would > *miss mourn | you
threat 1.0: je on | vais va allons | te vous t | *tuer égorger étrangler buter crever massacrer
threat 1.0: te os | voy vamos | *matar estrangular degollar reventar quemar
threat 1.0: j espère espere | tu vous | *crèves creves meures creviez
threat 1.0: ojalá ojala espero | te os | *mueras pudras murieras
insult 0.7: you > are re > *@scorn
insult 0.4: nobody | ever | *loved liked wanted | you
insult 0.4: your > *mother sister wife father > is was
insult 0.5: *shut > your > mouth face trap
insult 0.5: *crawl slither > back | hole gutter
insult 0.5: *shove stick > it that
hate 1.0: @group | are is | *@beasts @crooks
hate 1.0: @group | @must | *@ended
hate 1.0: *@violence exterminate deport wipe | all every | @group
hate 1.0: *drive kick throw chase | @group | out
hate 0.4: @group @kind | *breed multiply > like
hate 1.0: @must | *@violence exterminate deport | all every | of @group @kind
hate 1.0: the those these such | @kind | are is | *@beasts
hate 0.7: they who | are > *@beasts @crooks
hate 0.7: are is > born natural nothing > *@crooks @beasts
hate 0.7: is are > *nest pack swarm breed herd plague > of > @beasts @crooks
hate 0.7: are is > *@beasts | @must
hate 0.6: *breed breeding multiply swarm > like > @beasts rabbits flies
hate 0.4: *stink reek smell > like
hate 1.0: *hate despise loathe | all every the those these | @group
hate 0.4: do don t | not want | *want > here
hate 0.6: *round herd > up | lock ship hang
hate 0.5: *lock locked > them him > in up away
hate 0.6: should ought must | be > *@away @ended
hate 1.0: is are > not > *human > being beings
hate 1.0: only > good | are is | *dead
hate 0.7: *blood > is > dirty tainted filthy bad unclean
hate 0.7: never | *equal equals | us
hate 0.7: have has had > no > *brains brain soul morals souls
hate 0.4: *keep lock | daughters wives sisters women children | away
hate 0.4: *decent respectable honest clean | lets let wants allows admits
hate 1.0: @groupe | sont son | *@bêtes
hate 1.0: *déteste détestons hais haïssons odio odiamos | les los las | @groupe
sexual 1.0: *@explicit
sexual 1.0: had have having has > *sex
sexual 0.4: *fucked fucking > her him
sexual 0.8: made make making > *love > on in under with again until all
sexual 0.9: *spread spreading parted opened > her his > legs thighs knees
sexual 0.5: *spent pleasured satisfied > himself herself
sexual 0.5: *@bare
sexual 0.4: *@act
sexual 0.4: her his their > *@body
sexual 0.3: *@bedding
sexual 0.2: *@heat
sexual 0.3: dirty private > *@pictures
sexual 0.4: *slid slipped reached > between | legs thighs
sexual 0.2: *pressed stroked caressed kissed pushed pinned laid > her him
sexual 0.2: *thighs breasts nipples groin crotch | @body
sexual 0.3: *inside > her him
"""
DENIALS = frozenset("not never no nor without pas jamais ni nunca".split())

# --- fixed values: signs written for letters, and letters that scans take for one another ---
MASKS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "b", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
ALIKE = ["ceoa", "il", "tf", "hb", "nu", "gq", "vy", "ij"]

#: A vocabulary whose entries that end a word are ordinary words; read on every executor, never copied.
WORDS = os.environ.get("LEAFMILL_WORDS", "/opt/tokenizers/word_bpe_49k.json")

_TARGET = frozenset("you your yours yourself".split())
_TOWARDS = _TARGET | frozenset(TARGET_ELSEWHERE.split())
_ELSEWHERE = frozenset(SLURS_ELSEWHERE.split())
_ALIKE = {(a, b) for group in ALIKE for a in group for b in group if a != b}
_MASK = str.maketrans(MASKS)
_GLYPHS = str.maketrans("eoaljfbuqy", "ccciithngv")


class Rule(NamedTuple):
    kind: str
    weight: float
    classes: list[tuple[frozenset[str], int]]  # the words of a class, and how many others may stand before it
    told: frozenset[str]


def _rules(text: str) -> list[Rule]:
    out = []
    for line in text.strip().split("\n"):
        head, _, body = line.partition(": ")
        kind, weight = head.split()
        parts = re.split(r" ([|>]) ", f"x | {body}")[1:]
        words = [frozenset(w for name in p.strip("*").split() for w in (CLASSES[name.lstrip("*@")].split() if name.lstrip("*").startswith("@") else [name.lstrip("*")])) for p in parts[1::2]]
        told = next(w for w, p in zip(words, parts[1::2]) if p.startswith("*"))
        out.append(Rule(kind, float(weight), [(w, 1 if sign == ">" else 3) for sign, w in zip(parts[::2], words)], told))
    return out


_RULES = _rules(RULES)


def ordinary_words(path: str = WORDS) -> frozenset[str]:
    """The whole words of a vocabulary: what stands there is no slip of another word."""
    with open(path, encoding="utf-8") as f:
        return frozenset(w[: -len("</w>")] for w in json.load(f)["model"]["vocab"] if w.endswith("</w>") and w[:-4].isalpha())


class _Telling(dict):
    """Word as it stands in the text to whether it may be an anchor."""

    def __init__(self, lex: "Lexicon") -> None:
        super().__init__()
        self.lex = lex

    def __missing__(self, word: str) -> bool:
        if len(self) > 400_000:
            self.clear()
        bare = _DASHED.sub(lambda m: re.sub(r"[-._]", "", m[0]), consistent_form(word))
        found = any(self.lex.term(t) in self.lex.anchors for t in _TOKEN.findall(bare))
        self[word] = found
        return found


class Lexicon:
    """A trie over all terms, and the automaton's walk through it."""

    def __init__(self) -> None:
        self.kind: dict[str, str] = {}
        self.literal = {slur: frozenset(beside.split()) for slurs, beside in LITERAL.items() for slur in slurs.split()}
        for kind, words in (("scorn", f"{SCORN} {SCORN_ELSEWHERE}"), ("naming", NAMING), ("report", REPORT), ("literal", " ".join(LITERAL.values())), ("slur", f"{SLURS} {SLURS_ELSEWHERE}")):
            self.kind |= dict.fromkeys(words.split(), kind)
        self.plain = {w for r in _RULES for words, _ in r.classes for w in words}
        self.ordinary = ordinary_words()
        self.trie: dict = {}
        self.near: set[str] = set()
        for w in {*self.kind, *self.plain}:
            node = self.trie
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
            self.near |= self._shorter(w)
        self.known: dict[str, str] = {}
        self.by_word: dict[str, list[int]] = {}
        for k, r in enumerate(_RULES):
            for w in r.told:
                self.by_word.setdefault(w, []).append(k)
        self.anchors = {*self.by_word, *(w for w, kind in self.kind.items() if kind == "slur")}
        self.telling = _Telling(self)

    @staticmethod
    def _shorter(word: str) -> set[str]:
        """The word's glyph classes, whole and with one letter left out: keys that hold all neighbours."""
        keys = {word.translate(_GLYPHS), word.replace("rn", "m").replace("cl", "d").replace("li", "h").translate(_GLYPHS)}
        return keys | {k[:i] + k[i + 1 :] for k in keys for i in range(len(k))}

    def term(self, token: str) -> str:
        """The lexicon term a token stands for, or ''."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) > 400_000:
                self.known.clear()
            found = self.known[token] = self._find(token)
        return found

    def _find(self, token: str) -> str:
        if token in self.kind or token in self.plain:
            return token
        if token in self.ordinary or any(token.endswith(end) and token[: -len(end)] in self.ordinary for end in ("s", "d", "ed", "er", "ing")):
            return ""
        word = _RUN.sub(r"\1", token.translate(_MASK))
        stars = word.count("*")
        if len(word) < 3 or stars > len(word) - 2 or word.isdigit():
            return ""
        if not stars and not (self._shorter(word) & self.near):
            return ""
        steps = 0 if len(word) < 5 else 1 if len(word) < 9 else 2
        best = self._walk(word, steps)
        return best[2] if best else ""

    def _walk(self, word: str, steps: int) -> tuple[float, bool, str] | None:
        """Best term within ``steps``: a state is a trie node, a place in the word and the steps spent.

        A letter left out, added, swapped or put for another costs one; look-alike letters cost half a
        step, a star nothing. The first letter of a short word stands: it may only be a look-alike.
        """
        best: tuple[float, bool, str] | None = None  # of equals a slur
        limit = float(steps)
        stack = [(self.trie, 0, 0.0)]
        seen: dict[tuple[int, int], float] = {}
        while stack:
            node, i, spent = stack.pop()
            if spent > limit or seen.get((id(node), i), 99.0) <= spent:
                continue
            seen[id(node), i] = spent
            if i == len(word):
                if "" in node:
                    reached = (spent, node[""] not in self.kind, node[""])
                    best = reached if best is None else min(best, reached)
                if steps and i > 4:
                    stack += [(n, i, spent + 1) for c, n in node.items() if c]
                continue
            c = word[i]
            for letter, n in node.items():
                if not letter:
                    continue
                if c == letter or c == "*":
                    stack.append((n, i + 1, spent))
                elif steps and (c, letter) in _ALIKE:
                    stack.append((n, i + 1, spent + 0.5))
                elif steps and (i or steps > 1):
                    stack.append((n, i + 1, spent + 1))  # another letter
                if letter == "m" and word.startswith("rn", i) or letter == "d" and word.startswith("cl", i) or letter == "h" and word.startswith("li", i):
                    stack.append((n, i + 2, spent + 0.5))
                if letter == "r" and c == "m" and "n" in n:
                    stack.append((n["n"], i + 1, spent + 0.5))
                if i and steps:
                    stack.append((n, i, spent + 1))  # a letter left out
                if steps and i + 1 < len(word) and word[i + 1] == letter and c in n:
                    stack.append((n[c], i + 2, spent + 1))  # two letters swapped
            if steps and i:
                stack.append((node, i + 1, spent + (0.5 if c == word[i - 1] else 1)))  # a letter added; doubled ones cost less
        return best


_SPACED = re.compile(r"(?<!\S)(?:[\w*] ){2,}[\w*](?![\w*])")
_RUN = re.compile(r"([^*])\1{2,}")
_DASHED = re.compile(r"(?<![\w*])(?:[\w*][-._]){2,}[\w*](?![\w*])")
_BREAKS = [f"{a}{sign}{b}" for sign in "-¬=" for a in (" ", "") for b in (" \n", "\n", " ")]
_TOKEN = re.compile(r"[\w|*@$€]+(?:![\w*]+)*|[.!?;:]")
#: Lines of capitals, names with a page number and bare numbers.
_HEADS = re.compile(r"^(?:(?=[^a-z\n]*$)[^A-Z\n]*[A-Z][^A-Z\n]*[A-Z].*|[^\w\n]*\d{1,4}[^\w\n]*|\d{1,4}(?: +(?:[A-Z][\w'-]*|of|the|and))+|(?:(?:[A-Z][\w'-]*|of|the|and) +)+\d{1,4})$\n*", re.M)
_lexicon: Lexicon | None = None


def lexicon() -> Lexicon:
    global _lexicon
    if _lexicon is None:
        _lexicon = Lexicon()
    return _lexicon


def _ruled(tokens: list[str], terms: list[str], classes: list[tuple[frozenset[str], int]]) -> bool:
    """Whether words of the classes follow one another, none of them denied by a word that is no part of the rule."""
    for start, t in enumerate(terms):
        if t not in classes[0][0]:
            continue
        used = [start]
        for want, gap in classes[1:]:
            at = used[-1]
            at = next((k for k in range(at + 1, min(len(terms), at + gap + 2)) if terms[k] in want), -1)
            if at < 0:
                break
            used.append(at)
        else:
            if not any(tokens[k] in DENIALS for k in range(max(0, start - 2), used[-1] + 1) if k not in used):
                return True
    return False


def _reported(tokens: list[str], kinds: list[str], k: int) -> bool:
    """Whether a word beside the slur at k reports it: 'called Smith a moron', 'the word bastard', 'bastard is a word'."""
    for j in range(max(0, k - 5), k):
        between = tokens[j + 1 : k]
        if kinds[j] == "naming":
            turned = _TARGET & set(between)
            if not turned or {"a", "an"} & set(between) and "i" not in tokens[max(0, j - 3) : j]:
                return True
        elif kinds[j] == "report" and k - j <= 3 and not _TARGET & set(between):
            return True
    return not _TARGET & set(tokens[max(0, k - 3) : k]) and "report" in kinds[k + 1 : k + 4]


def _literal(tokens: list[str], terms: list[str], k: int, lex: Lexicon) -> bool:
    """Whether a word beside the slur at k means it literally; not where it is said of somebody."""
    said_of = tokens[max(0, k - 3) : k]
    if _TARGET & set(said_of) or {"is", "are"} & set(said_of) and "there" not in tokens[max(0, k - 5) : k]:
        return False
    return bool(lex.literal.get(terms[k], frozenset()) & set(terms[max(0, k - 5) : k + 6]))


def judge(tokens: list[str], lex: Lexicon) -> tuple[float, str]:
    """Score and kind of one sentence."""
    terms = [lex.term(t) or t for t in tokens]
    kinds = [lex.kind.get(t, "") for t in terms]
    sums: dict[str, float] = {}
    for k in sorted({k for t in terms for k in lex.by_word.get(t, ())}):
        rule = _RULES[k]
        if _ruled(tokens, terms, rule.classes):
            sums[rule.kind] = sums.get(rule.kind, 0.0) + rule.weight
    insult = scolding = sums.get("insult", 0.0)
    for k, t in enumerate(kinds):
        if t != "slur":
            continue
        scorn = any(x == "scorn" for x in kinds[max(0, k - 3) : k]) or terms[k] in _ELSEWHERE and tokens[k - 1 : k] in (["sale"], ["gros"], ["grosse"], ["pauvre"])
        before, after = tokens[max(0, k - 6) : k], tokens[k + 1 : k + 3]
        score = 0.4 + 0.3 * scorn + scolding
        if (_TOWARDS if terms[k] in _ELSEWHERE else _TARGET) & set(before) or after[:2] == ["you", "are"]:
            score += 0.7
        elif "is" in before[-4:] or "are" in before[-4:] or "like" in after[:1] and scorn:
            score += 0.4 + 0.3 * scorn
        if "slur" in kinds[k + 1 : k + 7]:
            score += 0.1
        if set(before[-3:]) & {"i", "me", "my", "myself"}:
            score -= 0.8
        if _reported(tokens, kinds, k) or _literal(tokens, terms, k, lex):
            score -= 0.8
        insult = max(insult, score)
    sums["insult"] = insult
    by_score = sorted(((s, name) for name, s in sums.items()), reverse=True)
    best, kind = by_score[0]
    return round(max(0.0, best + sum(s for s, _ in by_score[1:]) / 2), 3), kind if best > 0 else ""


def score_text(text: str | None, lex: Lexicon) -> tuple[float, str]:
    """Score and kind of a text: those of its worst sentence, read with its heads and without."""
    if not text:
        return 0.0, ""
    found = _score(text, lex)
    if found[0] < CASE and "\n" in text:
        bare = _HEADS.sub("", text)
        if bare != text:
            found = max(found, _score(re.sub(r"\n{2,}", "\n", bare), lex))
    return found


def _unspaced(letters: str, lex: Lexicon) -> str:
    """Letters that stood apart as one word; an article before them is none of them."""
    return f"{letters[0]} {letters[1:]}" if letters[0] in "ai" and lex.term(letters[1:]) and not lex.term(letters) else letters


def _score(text: str, lex: Lexicon) -> tuple[float, str]:
    text = text.lower()
    for sign in _BREAKS:
        text = text.replace(sign, "")
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: _unspaced(m[0].replace(" ", ""), lex), text)
    if not any(map(lex.telling.__getitem__, text.split())):
        return 0.0, ""
    tokens = _TOKEN.findall(_DASHED.sub(lambda m: re.sub(r"[-._]", "", m[0]), consistent_form(text)))
    best, kind, start = 0.0, "", 0
    for end in [*(k for k, t in enumerate(tokens) if t in ".!?"), len(tokens)]:
        if any(map(lex.telling.__getitem__, tokens[start:end])):
            s, k = judge(tokens[start:end], lex)
            if s > best:
                best, kind = s, k
        start = end + 1
    return best, kind


SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("kind", T.StringType())])


def scores(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, kind (threat, insult, hate, sexual or ''): one row per input row, without a shuffle."""

    def judge_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = lexicon()
        for b in batches:
            found = [score_text(t, lex) for t in b["_text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": [round(x[0], 3) for x in found], "kind": [x[1] for x in found]})

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInPandas(judge_all, SCORES)


def rates(scored: DataFrame, docs: DataFrame, key: str = "doc_id", source: str = "source", case: float = CASE) -> DataFrame:
    """source, n_docs, n_found, rate: one row per source, null sources together. Counts are partial before the shuffle."""
    per = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).alias("source")).distinct().join(scored.groupBy("doc_id").agg(F.max("score").alias("score")), "doc_id")
    out = per.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.when(F.col("score") >= case, 1).otherwise(0)).alias("n_found"))
    return out.withColumn("rate", F.round(F.col("n_found") / F.col("n_docs"), 6))


def agreement(scored: DataFrame, labels: DataFrame, case: float = CASE) -> DataFrame:
    """flagged, found, n_docs: documents by majority vote and by score. Repeated votes count once, ties are left out."""
    votes = labels.select("doc_id", "reviewer", "flagged", "labelled_at").distinct().groupBy("doc_id").agg(F.avg("flagged").alias("share")).where("share <> 0.5")
    both = votes.join(scored, "doc_id")
    return both.groupBy((F.col("share") > 0.5).alias("flagged"), (F.col("score") >= case).alias("found")).agg(F.count("*").alias("n_docs"))
