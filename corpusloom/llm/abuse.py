"""Scores for abusive, hateful and sexual content.

A lexicon of terms, each with its classes (insult, degrading term, harm, expulsion,
intimate, ...), is kept as a trie. Each distinct word of a batch is met with it through
a Levenshtein automaton whose states are walked along the trie's branches, so that
misspelled, stretched, spaced-out and masked forms reach their term. A term is only an
anchor: within the context window around it, which ends with its sentence, frames over
classes are tried, such as "I will" + harm + "you", group + "must be" + expulsion, or
"you are" + insult. What the frames give, and the signs that the words are somebody
else's (quotation marks and words of speech, report, negation, doctrine, animals), are
the features of the window; its score for a kind is their weighted sum.

The weights start from ``PRIOR`` and can be fitted (:func:`fitted`) to ratings of whole
documents: a document is toxic if any of its windows is. The fit reads at most
``TRAIN_DOCS`` rated documents, the first in the order of a hash of the id, and is held
near the prior, as ratings are few and raters err.

A window has a kind if its score reaches 0. A document's score for a kind is
1 - product(1 - p) over its windows, p being the logistic of ``SHARP`` times
a window's score. Null and
blank texts score 0.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import session

KINDS = ("abuse", "hate", "sexual")
WINDOW = 16
TRAIN_DOCS = 2000

# The lexicon, by class. A word may stand in several.
CLASSES = {
    "insult": """
        arsehole asshole bastard bellend bitch blockhead bollocks bugger buffoon clown cockroach coward cow crank creep cretin crybaby cunt degenerate dickhead dimwit dipshit dolt
        douche douchebag dullard dumbass dunce fool freak fuckwit git goon halfwit hag hypocrite idiot ignoramus imbecile jackass jerk knave knobhead leech liar loser lout lowlife
        lunatic maggot moron motherfucker muppet nitwit numbskull oaf parasite pest pig pillock pissant plonker prat prick psycho rascal rat rogue ruffian scoundrel scum
        scumbag shithead simpleton skank slag slob slut snake sod swine thickhead thug toad tosser traitor trash troll turd twat twit vermin villain wanker wastrel weasel weirdo
        whore windbag worm wretch
        arschloch depp dreckskerl drecksau esel hund hurensohn hure idiot kerl luder lump lügner missgeburt mistkerl penner sau scheisskerl schlampe schurke schwachkopf schwein
        schweinehund trottel verräter versager vollidiot wichser wurm
        abruti âne batard clochard cochon connard connasse con cretin crétin débile encule enfoire imbecile imbécile lâche menteur minable ordure porc pourriture raclure salaud
        salope sot traître vaurien voyou
        basura bastardo bestia bobo burro cabron canalla cerdo cobarde estúpido gilipollas gusano idiota imbecil imbécil inútil maldito maricon mentiroso pendejo perro puta rata
        ridículo sinvergüenza tonto zorra stronzo
    """,
    "adjective": """
        bloody brainless cowardly crooked dirty disgusting dull dumb fat filthy foul fucking gutless goddamn hideous idiotic ignorant insane lazy lousy lying miserable moronic nasty
        obnoxious pathetic pitiful repulsive revolting rotten shameless shitty sick slimy spineless stinking stupid talentless thick ugly unbearable useless vile witless worthless
        wretched fucked damn damned goddamned dämlich dreckig dreckiges dreckiger dumm dumme dummer dummes ekelhaft ekelhafter erbärmlich faul verdammt verdammter widerlich
        widerliches widerlicher wertlos bête dégoûtant foutu idiote inutile nul nulle pathétique puant putain sale sales stupide asqueroso asquerosa despreciable inútil maldita
        patético podrido sucio vago
    """,
    "superlative": "stupidest dumbest dullest ugliest filthiest laziest vilest nastiest foulest sorriest stupider dumber uglier dämlichste dümmste",
    "degrading": """
        animals apes barbarians beasts brutes cancer cattle cockroaches curse degenerates dirt disease dogs dung filth garbage germs hyenas infestation jackals leeches lice locusts
        maggots mongrels monkeys muck parasites pest pestilence pests pigs plague rabble rats refuse rubbish savages scum snakes sewage subhuman subhumans swine trash vermin vultures
        abschaum affen bestien dreck ratten schädlinge schmarotzer schweine seuche tiere ungeziefer untermenschen animaux bêtes cafards chiens nuisibles parasites porcs racaille
        rats sauvages vermine animales bestias escoria parásitos parasitos perros plaga ratas salvajes
    """,
    "vice": "thieves liars cheats criminals murderers rapists killers cutthroats swindlers cowards idiots fools drunkards traitors terrorists bastards thieving lying treacherous heartless brainless lazy dirty filthy diebe lügner verbrecher voleurs menteurs criminels ladrones mentirosos criminales",
    "harm": """
        beat behead bludgeon break burn burned burnt butcher choke club crush cut drown execute flay flog gut gutted hang hanged harm hunt hurt kill killed kick lynch maim mangle
        murder poison punch rape ruin shoot shot skin slash slaughter slaughtered slit smash smother stab stomp strangle string strung thrash throttle torch torture trample whip
        whipped wring erschlagen erschießen erwürgen hängen köpfen schlagen töten umbringen verbrennen verprügeln abattre brûler casser crever égorger étrangler frapper pendre tuer
        ahorcar apalear degollar golpear matar quemar romper
    """,
    "expel": """
        banish banished chase chased cleanse cleansed deport deported drive driven eradicate eradicated erase erased expel expelled exterminate exterminated extinguish extinguished
        gas gassed purge purged remove removed rid ship shipped sterilise sterilised sterilize wipe wiped throw thrown toss tossed round rounded ausrotten ausgerottet fortjagen loswerden rauswerfen verjagen vernichten
        vertreiben vertrieben chasser éliminer exterminer expulser virer echar echarlos eliminar expulsar exterminar exterminarlos
    """,
    "death": "burn choke chokes croak crawl dead die dies drown drowned hang perish rot rots suffer suffocate swing grave hell born birth cancer cliff bridge rope gallows noose bullet bullets krepieren sterben stirb verrecke verrecken verrotte crève crever meurs mourir muere muérete morir pudrirte púdrete",
    "body": "bones ears eyes face fingers guts head jaw knees legs neck ribs skin skull spine teeth throat hals knochen kehle schädel zähne cou dents gorge jambes os cuello cabeza dientes huesos piernas",
    "explicit": """
        anal blowjob boobs boner clit clitoris cock cocks copulate copulated cum cumming cunt deepthroat dick dildo ejaculate ejaculated ejaculating erection erections fellatio fuck
        fucked fucking fucks gangbang handjob horny jerking masturbate masturbated masturbates masturbating nudes orgasm orgasms orgy penis porn porno pornographic pussy sexy sodomise
        testicles tits titties vagina vulva wank climaxed climax bumsen ficken fickt fickte gefickt geil möpse muschi schwanz titten baise baisé baiser bite chatte nichons couilles coño follar polla tetas verga
    """,
    "intimate": "bare bosom bottom breast breasts breeches buttocks corset crotch groin hips loins lust nipple nipples pelvis petticoat shift skirt stockings thigh thighs lap legs mouth underwear bodice nude naked nu nue nus nues nackt nackten arse ass brust brüste schenkel cuisse cuisses seins muslo muslos pechos",
    "touch": "between bit caress caressed caresses caressing caressait cupped entered finger fingers fondle fondled fondling grabbed grope groped groping hand hands inside into kissed kissing licked licking mounted open opened parted penetrated penetrating pinched pressed pushed reached ride riding rode rubbed rubbing slid slide sliding slipped spread squeezed straddled stroked stroking suck sucked sucking tongue took touched under up",
    "arousal": "aroused arousal ached aching begged bounced came desire gasp gasped gasping groan groaned groaning hard harder moan moaned moaning pant panted panting pleasure quivered screamed sweat thrust thrusting thrusts throbbed throbbing wet whimpered writhed writhing stöhnte gémit gimió",
    "undress": "disrobed naked nude pulled ripped strip stripped stripping tear tore undid unbuttoned undress undressed unlaced unzipped",
    "bedroom": "bed floor lover mistress night tonight picture pictures photo photos selfie selfies video webcam hotel sheets",
    "vocative": "go get drop piss fuck screw shut crawl eat kiss bite shove stuff fahr halt verpiss ferme va vas casse callate cállate cierra vete",
}
#: Words of several senses: they count for half unless something else confirms them.
WEAK = frozenset("""
    ass bare bastard beasts bitch bosom bottom bounced breast breasts breeches cattle clown cock cocks con coward cow creep crank cretin dick disease dogs esel hund fat fool freak
    hypocrite jerk kerl knave lap lazy leech legs liar locusts lout lump mouth naked nude parasite pest pig pigs plague prat prick rascal rat rats rogue sag sick slag snake
    snakes sod swine thick thrust toad trash traitor troll villain weasel whip worm wretch sale sales rotten miserable dirty bloody ignorant useless filth lice dumb dull
    nasty damn damned foul hag cerdo basura perro burro rata bestia curse dirt dung dirt refuse rubbish animals apes monkeys brutes savages tiere animales bite git shift skirt hips
    lust fuck fucked fucking fucks penis vagina testicles erection erections porn porno pornographic anal hard porc chiens perros snakes lying insane pitiful wretched faul bête lâche sot vago twit
""".split())
# Words that direct a frame.
SECOND = frozenset("you your yours yourself yourselves thee thou thy thine thyself ye u ur ya du dich dein deine deinen deinem deiner dir euch ihr tu te t toi ta ton tes vous vos votre ti eres tú usted ustedes tus".split())
ADDRESS = frozenset("you you're youre u ur ya ye thou du tu toi vous tú eres usted".split())
SELF = frozenset("yourself yourselves thyself urself dich toi".split())
FIRST = frozenset("i we me my us our we're we'll we'd we've ich wir mich uns je j nous moi yo nosotros".split())
THIRD = frozenset("she he her his him hers they them their me my i you your we us ihr ihre sein seine sie er ich elle il lui ella él su".split())
GROUP = frozenset("they them their those these folk folks people peoples race races kind tribe tribes breed sort every alle sie ihnen diese diesen les leur leurs tous ils ces los las todos todas ellos esos estos die".split())
MODAL = frozenset("will shall gonna going ll i'll we'll should must ought deserve deserves deserved need needs let time better werde werden wird muss müssen sollte sollten soll sollen gehört gehören faut doit doivent devrait devraient vais va allons hay debe deben debería deberían voy vamos merecen".split())
THREAT = frozenset("will shall gonna going ll i'll we'll werde werden vais va voy vamos".split())
WISH = frozenset("hope hopes hoped wish wishes should deserve deserves better ought may hoffe hoffentlich espère souhaite espero ojalá sollst".split())
NOBODY = frozenset("nobody none everyone everybody noone niemand keiner jeder alle personne nadie todos tout".split())
REJECT = frozenset("want wants wanted like likes love loves miss misses care cares hate hates despise despises despise laugh laughs needs asked missed mourn will mag hasst vermisst veut aime déteste weep cry notice regrettera quiere odia extrañaría soporta stand stands".split())
COPULA = frozenset("are were is am be been being 're 's sind seid bist waren sont êtes es sommes étaient etaient étais est son eran sois eres fueron sono".split())
NOT = frozenset("not no nor never neither isn't aren't wasn't nicht kein keine keiner nie pas jamais ni nunca if as like unless".split())
SPEECH = frozenset("said says say saith saying cried cries replied asked answered called calls call calling named shouted whispered wrote writes told tells reported reports testified according quoted read heard accused sagte sagt fragte rief nannte schrieb dit dirent demanda cria appela appelle dijo dicen respondio respondió grito gritó llamó llaman".split())
PEOPLES = frozenset("people peoples folk race races tribe tribes nation nations foreigners immigrants migrants refugees settlers natives outsiders newcomers strangers peasants heathens pagans papists gypsies northerners southerners easterners westerners islanders highlanders lowlanders".split())
ANIMALS = frozenset("mice mouse moles mole foxes fox wolves wolf crows sheep ewe ewes lamb lambs cow cows cattle hens hen insects beetles flies flea fleas moths weevils slugs snails caterpillars aphids ticks mites rabbits hares birds horses horse mare ox oxen ass donkey goat goats dog hound hounds kennel litter whelps whelp whelped puppies pups herd flock".split())
DOCTRINE = frozenset("god lord christ jesus scripture epistle apostle apostles prophet sin sins sinner sinners satan devil gospel sermon preached preacher babylon circumcision fornication adultery drunkenness chastity unclean damnation commandment saints soul souls heaven israel moses david baptism repent repentance holy".split())
MEDICAL = frozenset("physician doctor surgeon nurse fever disease wound wounds infant babe child nursed suckled suckling midwife anatomy patient patients medicine operation beggar beggars poor clothed clothe prisoner prisoners grave shepherd".split())
LESSER = frozenset("lesser lower inferior worse baser beneath less niedriger minderwertig inférieurs inferiores".split())
MEASURE = frozenset("human humans people men man breed race kind stock beasts animals creatures menschen rasse hommes humains race hombres humanos raza".split())
EVERY = frozenset("all these those every alle diese tous toutes ces todas todos esos estos such".split())
THEY = frozenset("they them those these their sie ils elles ellos ellas".split())
DECENT = frozenset("decent honest respectable proper civilised civilized christian".split())
MIX = frozenset("let lets live lives sit sits marry trust trusts allow allows serve serves admit eat eats want wants keep near among beside table house town village shop".split())
MIX_VERBS = MIX - frozenset("near among beside table house town village shop want wants keep".split())
DESTROY = frozenset("exterminated eradicated deported banished expelled purged gassed lynched exterminate eradicate gas lynch slaughter sterilise sterilize purge expel deport banish ausrotten vernichten exterminer éliminer exterminar eliminar exterminarlos echarlos".split())
CAPITALISED = re.compile(r"[A-ZÀ-Þ][a-zß-ÿ’'-]+(?:s|men|ish|ese|folk|ians|ists)")
PERSONS = ("ians", "ists", "folk")

_BIT = {name: 1 << k for k, name in enumerate(CLASSES)}
#: Words that open a frame without being terms.
_USE = 1 << len(CLASSES)
#: A window is looked at only if one of these is among its terms.
_ANCHOR = sum(_BIT[c] for c in ("insult", "adjective", "superlative", "degrading", "vice", "harm", "expel", "death", "explicit", "intimate", "arousal", "undress", "vocative"))

ABUSE = ("insult", "adjective", "addressed", "bound", "threat", "wish", "reject", "curse", "superlative", "exclaimed")
HATE = ("degrading", "predicated", "removal", "destroy", "lesser", "vice", "shut_out")
SEXUAL = ("explicit", "intimate", "touch", "arousal", "undress", "bedroom", "contact", "mixed", "no_person")
CONTEXT = ("quoted", "reported", "negated", "doctrine", "innocent", "own_fault")
#: What each feature weighs before any fitting; a window has the kind from a sum of 0 on.
PRIOR = {
    "abuse": dict(bias=-3.0, insult=1.5, adjective=0.75, addressed=0.75, bound=1.0, threat=3.25, wish=3.0, reject=3.0, curse=3.25, superlative=1.5, exclaimed=1.5, quoted=-3.0, reported=-1.0, negated=-2.0, doctrine=-0.25, innocent=-0.75, own_fault=-2.0),
    "hate": dict(bias=-3.0, degrading=0.75, predicated=2.75, removal=3.0, destroy=3.0, lesser=3.0, vice=3.0, shut_out=3.0, quoted=-3.0, reported=-2.0, negated=-2.0, doctrine=-1.0, innocent=-1.5, own_fault=-2.0),
    "sexual": dict(bias=-3.0, explicit=2.0, intimate=0.9, touch=0.4, arousal=0.9, undress=0.8, bedroom=0.4, contact=1.5, mixed=0.5, no_person=-2.0, quoted=-0.5, reported=-0.5, negated=-0.5, doctrine=-1.5, innocent=-1.25, own_fault=0.0),
}
NAMES = {kind: ("bias", *own, *CONTEXT) for kind, own in zip(KINDS, (ABUSE, HATE, SEXUAL))}


def prior() -> dict[str, np.ndarray]:
    return {kind: np.array([PRIOR[kind][n] for n in NAMES[kind]]) for kind in KINDS}


_WORDS_OF_USE = NOBODY | LESSER | frozenset("trust decent thieving count lock keep back sit human humans cure breed blood more honest respectable waste piece".split())

_FOLD = str.maketrans("0134578@$!|", "oieastbasii")
_ACCENTS = str.maketrans("ßàáâãäåçèéêëìíîïñòóôõöùúûüýÿœæ", "saaaaaaceeeeiiiinooooouuuuyyoa")
_TOKEN = re.compile(r"(?:[^\W_]|[@$]+(?=[^\W_]))(?:[^\W_]|[*@$!|]+(?=[^\W_])|(?<=[^\W\d_]{2})['’](?=[^\W\d_])|[@$]{1,3}(?=[\s.,;:!?]|$))*|[.!?]+(?=\s|$|[”\"»)\]]|[A-ZÀ-Þ][a-z])|[。！？।።]|[“”\"«»‘]|[,;:]|\n\s*\n")
_CUT = re.compile(r"(?<=[^\W\d_])[-¬\xad=‐][ \t]*\n\s*(?=[^\W\d_])")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_*][ .\-*_]+){2,}[^\W\d_*](?![^\W_])")
_DOTTED = re.compile(r"(?<=[a-z])\.(?=[a-z])|(?<=[A-Z])\.(?=[A-Z])|(?<=\b[A-Z])\.(?=[a-z]{3})")
_LATIN = re.compile(r"[a-z*]{3,20}")
_REPEAT = re.compile(r"([^\W_])\1{2,}")


def folded(word: str) -> str:
    """Lower case, accents and look-alike characters resolved, stretched letters single."""
    w = word.lower().replace("’", "'")
    if not w.isalpha() and not w.isdigit():
        w = w.translate(_FOLD)
    if not w.isascii():
        w = w.translate(_ACCENTS)
    return _REPEAT.sub(r"\1", w)


class Trie:
    """A lexicon trie walked in step with a Levenshtein automaton."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for term in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term

    def nearest(self, word: str, most: int) -> tuple[str, int] | None:
        """The term within ``most`` edits (a masking * is any letter), nearest first, then in order; None if there is none.

        The automaton's state is a bit set per number of edits: bit i is set if the trie's
        path so far can be read as the word's first i letters with that many edits.
        """
        any_letter = sum(2 << i for i, c in enumerate(word) if c == "*")
        at = {c: any_letter | sum(2 << i for i, w in enumerate(word) if w == c) for c in set(word)}
        full, end = (2 << len(word)) - 1, 1 << len(word)
        best: tuple[int, str] | None = None
        stack = [(self.root, tuple((2 << k) - 1 for k in range(most + 1)))]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == "":
                    for k, bits in enumerate(state):
                        if bits & end:
                            if best is None or (k, child) < best:
                                best = (k, child)
                            break
                    continue
                mask = at.get(c, any_letter)
                before = bits = (state[0] << 1) & mask
                after = [bits]
                for k in range(1, most + 1):
                    less = state[k - 1]
                    before = ((state[k] << 1) & mask | less | less << 1 | before << 1) & full
                    after.append(before)
                if before:
                    stack.append((child, tuple(after)))
        return best and (best[1], best[0])


class Lexicon:
    """The compiled lexicon: the classes of every term, and the trie over those long enough to be met misspelled."""

    def __init__(self):
        self.bits: dict[str, int] = {}
        for name, words in CLASSES.items():
            for w in words.split():
                for form in (w, w + "s") if name == "insult" and len(w) > 3 and not w.endswith("s") else (w,):
                    form = folded(form)
                    self.bits[form] = self.bits.get(form, 0) | _BIT[name]
        # terms of five letters have too many innocent neighbours, but for the insults
        self.short = _BIT["insult"] | _BIT["superlative"] | _BIT["degrading"]
        self.weak = frozenset(folded(w + s) for w in WEAK for s in ("", "s"))
        # words of contact and place are common ones: met as written only
        plain = sum(_BIT[c] for c in ("touch", "bedroom", "body", "death", "vocative", "undress"))
        terms = sorted(w for w, b in self.bits.items() if len(w) >= 4 and b & ~plain)
        # words of several senses are met misspelled only where the spelling hides something
        self.trie, self.masked = Trie([w for w in terms if w not in self.weak]), Trie(terms)

    def term(self, token: str) -> tuple[str, float, int] | None:
        """(term, trust, classes) of a token: trust 1 for the term itself, less for a misspelling; None for other words."""
        w = folded(token)
        bits = self.bits.get(w)
        if bits is not None:
            return w, 1.0, bits
        if _LATIN.fullmatch(w) and (len(w) >= 5 or (len(w) >= 3 and "*" in w)):
            got = (self.trie if token.isalpha() else self.masked).nearest(w, 2 if len(w) >= 9 else 1)
            if got and (got[0][0] == w[0] or len(w) >= 7) and (len(got[0]) >= (5 if self.bits[got[0]] & self.short else 6) or not token.isalpha()):
                return got[0], 0.8 if got[1] else 1.0, self.bits[got[0]]
        return None


class _Known(dict):
    """Tokens already met."""

    def __missing__(self, token: str):
        if len(self) > 500_000:
            self.clear()
        out = lexicon().term(token)
        if out is None and (low := token.lower()) in _WORDS_OF_USE:
            out = (low, 0.0, _USE)
        self[token] = out
        return out


@functools.cache
def lexicon() -> Lexicon:
    return Lexicon()


@functools.cache
def _known() -> _Known:
    return _Known()


def _unspaced(m: re.Match) -> str:
    return re.sub(r"[ .\-_]+", "", m.group())


def _ends(token: str) -> bool:
    return token[0] in ".!?\n。！？।።"


def _spoken(tokens: list[str], lo: int, hi: int) -> bool:
    """Whether the window is one quotation with a word of speech just outside it or within, outside the marks."""
    marks = [k for k in range(max(0, lo - 2), min(len(tokens), hi + 3)) if tokens[k] in "“”\"«»‘"]
    if len(marks) < 2:
        return False
    near = [*tokens[max(0, marks[0] - 5) : marks[0]], *tokens[marks[-1] + 1 : marks[-1] + 5]]
    return marks[0] <= lo + 8 and any(t.lower() in SPEECH for t in near)


def _sum(terms: dict[str, float], most: float) -> float:
    return min(most, sum(terms.values()))


# Curses and dismissals of everyday speech. "<": only where a clause begins.
CURSES = """
    go to hell; burn in hell; rot in hell; < drop dead; fuck off; fuck you; fuck yourself; piss off; screw you; < shut up; < shut it; < shut your; shut the fuck; kill yourself; hang yourself;
    drown yourself; eat shit; kiss my ass; kiss my arse; crawl back; crawl off; crawl away; watch your back; know where you live; regret being born; regret the day; son of a bitch; sons of bitches; waste of space; piece of shit; piece of trash; piece of filth; < go hang;
    halt dein maul; halt die fresse; halts maul; verpiss dich; fahr zur holle; scher dich zum teufel; ferme ta gueule; ta gueule; va te faire; nique ta; espece de; casse toi; vete a la mierda;
    vete al infierno; callate la; cierra la boca; hijo de puta; hija de puta; que te jodan; muerete
"""  # fmt: skip
_BY_FIRST: dict[str, list[tuple[bool, list[str]]]] = {}
for _line in CURSES.replace("\n", " ").split(";"):
    _w = _line.split()
    _BY_FIRST.setdefault(_w[_w[0] == "<"], []).append((_w[0] == "<", _w[_w[0] == "<" :]))
#: Harm that is harm whatever follows; the rest needs a part of the body or a second verb of harm.
HARD = frozenset("behead bludgeon butcher flay gut gutted hunt kill killed lynch maim mangle murder punch rape shoot slaughter slit smash stab strangle thrash throttle torture maim kick erschlagen erschiessen erwurgen umbringen verprugeln toten egorger etrangler tuer crever matar degollar ahorcar apalear".split())
YOU = frozenset("you your ya u dich dir dein deine deinen te ton ta tes tu tus".split())
ARTICLES = frozenset("the a an this that some any it one der die das den le la les un une el los las una".split())
DOOM = frozenset("die dies dead drown drowned hanged hang shot rot rots choke chokes croak swing perish burn suffocate krepieren verrecke verrecken sterben creve crever mourir muere mueras morir pudrirte".split())
SOFT = frozenset("beat whip burn crush break ruin hang drown poison flog hurt thrash cut".split())
GUARD, GOODS = frozenset("count lock watch guard hide mind check".split()), frozenset("spoons silver purse purses pocket pockets money coins doors chickens valuables plate wallet".split())
GARMENTS = frozenset("breeches clothes dress gown shirt shift trousers corset skirt petticoat stockings bodice robe blouse underwear kleider hosen".split())
FRAMED = frozenset("legs beine jambes piernas".split())
INNER = frozenset("thigh thighs crotch groin nipple nipples buttocks breasts loins schenkel cuisse cuisses muslo muslos seins pechos".split())
OWNERS = frozenset("her his my your their him me ihre seine sa son ses su sus".split())


_ORIGIN = ("ians", "ites", "eses", "folk")
_NO_ORIGIN = frozenset("foolish parish perish finish publish polish punish banish cherish flourish furnish nourish vanish abolish admonish accomplish astonish diminish establish selfish childish boyish sluggish feverish rubbish anguish relish tarnish varnish famish lavish radish fetish skittish".split())


def _named(low: list[str], tokens: list[str], known: list) -> list[int]:
    """Where a people or group is named: a people word, a capitalised plural, or a capitalised word of origin after an article."""
    out = []
    # a text all in small letters or all in capitals gives no hint of names but the words' endings
    even = not any(t[0].isupper() for t in tokens) or 2 * sum(t.isupper() for t in tokens) > sum(t.lower() != t.upper() for t in tokens)
    for j, w in enumerate(low):
        t = tokens[j]
        if known[j] and known[j][2] & _BIT["degrading"]:
            continue
        if w in PEOPLES:
            out.append(j)
        elif even and len(w) > 5 and (w.endswith(_ORIGIN) or (w.endswith("ish") and w not in _NO_ORIGIN) or (w.endswith("s") and j and low[j - 1] in ("all", "the", "those", "these", "for", "with", "beside"))):
            out.append(j)
        elif t[0].isupper() and len(t) > 4 and not t.isupper():
            initial = j == 0 or tokens[j - 1] in "“\"«‘"
            plural = CAPITALISED.fullmatch(t) and not w.endswith(("ss", "us", "is")) and not (w.endswith("ish") and w in _NO_ORIGIN)
            if plural and (not initial or w.endswith((*_ORIGIN, "ish")) or (j + 1 < len(low) and (low[j + 1] in ("are", "were", "breed", "multiply", "swarm", "sind", "sont", "son") or low[j + 1] in MODAL))):
                out.append(j)
            elif j and low[j - 1] in ("a", "an", "any", "no", "every", "another") and w.endswith(("ian", "ite", "ish", "ese", "er", "ard", "man")):
                out.append(j)
    return out


def _near(low: list[str], lo: int, hi: int, words: frozenset) -> int:
    """The first place in [lo, hi) with one of the words; -1 if there is none."""
    for j in range(max(0, lo), min(len(low), hi)):
        if low[j] in words:
            return j
    return -1


_NO_BREAK = frozenset(",;:")


def _bound(low: list[str], k: int, known: list) -> int:
    """1 if the insult at ``k`` is said of the person addressed, -1 if that is denied, else 0."""
    for p in range(k - 1, max(-1, k - 11), -1):
        w = low[p]
        if w in ("your", "thy", "dein", "deine", "ta", "ton", "tu") and p == k - 1:
            return 1
        if w in ADDRESS or w == "you're":
            between = low[p + 1 : k]
            if any(x in NOT and x != "like" and x != "as" for x in between) or (p and low[p - 1] in NOT):
                return -1
            commas = [j for j in range(p + 1, k) if low[j] == "," and not (known[j - 1] or known[j + 1])]
            return int(not commas and not any(x in ";:" or x in ("he", "she", "it", "they", "who", "that", "him", "her", "them") for x in between))
        if w in ";:" or (w == "," and not (p and (known[p - 1] or known[p + 1]))):
            break
    return int(_near(low, k + 1, k + 4, ADDRESS) > 0 and _near(low, k + 1, k + 3, frozenset(("like", "as", "wie", "comme", "como"))) > 0)


_EXCLAIM = frozenset("what such only some total utter complete absolute quel quelle qué menudo".split())


def _exclaimed(low: list[str], k: int) -> float:
    """1 for an insult after "what a", "only a", "such a" and the like, with nobody addressed."""
    return float(any(low[j] in _EXCLAIM and not any(x in NOT or x in ";:" for x in low[j:k]) for j in range(max(0, k - 5), k)))


def _curse(low: list[str], flat: list[str]) -> float:
    for k, w in enumerate(flat):
        if any(x in NOT or x == "don't" for x in low[max(0, k - 2) : k]):
            continue
        for initial, words in _BY_FIRST.get(w, ()):
            if flat[k : k + len(words)] == words and (not initial or k == 0 or not low[k - 1][0].isalpha() or low[k - 1][0] > "\u024f" or low[k - 1] in ("so", "now", "just", "and", "then", "please", "or")):
                return 1.0
    return 0.0


def _abuse(low: list[str], flat: list[str], known: list, where: dict[str, list[int]]) -> tuple[list[float], float, float]:
    """(features of ABUSE, whether an insult is denied of the person addressed, whether it is said of the speaker)."""
    lex = lexicon()
    sums: dict[str, dict[str, float]] = {"insult": {}, "adjective": {}, "superlative": {}}
    bound = denied = own = exclaimed = 0.0
    for name, terms in sums.items():
        for k in where[name]:
            t, trust, _ = known[k]
            if name == "adjective" and t in sums["insult"]:
                continue
            confirmed = name == "insult" and any(known[j] and known[j][2] & _BIT["adjective"] for j in range(max(0, k - 3), k))
            terms[t] = trust * (0.5 if t in lex.weak and not confirmed else 1.0)
            b = _bound(low, k, known)
            if name == "adjective" and b > 0 and low[k - 1] in ADDRESS and low[k + 1 : k + 2] and (low[k + 1] == "," or (low[k + 1][0].isalpha() and low[k + 1] not in NOT and low[k + 1] not in ("and", "if", "when", "that", "to"))):
                sums["insult"].setdefault("you " + t, 0.5)
            if name == "insult" and t not in lex.weak and ((k and low[k - 1] in ("hey", "oi", "listen", "ok", "hé", "he", "eh", "oye")) or (k == 0 and low[1:2] == [","])):
                exclaimed = 1.0
            bound, denied = max(bound, min(1.0, bound + 0.5 * max(b, 0)) if name == "adjective" else float(b)), max(denied, float(b < 0))
            be = _near(low, k - 5, k, COPULA)
            if name == "insult":
                exclaimed = max(exclaimed, _exclaimed(low, k))
            own = max(own, float(b == 0 and be > 0 and low[be - 1] in FIRST))
    second = any(w in SECOND for w in low)
    threat = wish = reject = 0.0
    for h in where["harm"]:
        m = max((j for j in range(max(0, h - 6), h) if low[j] in THREAT or low[j] in ("ought", "should", "love")), default=-1)
        if m < 0 or not (low[m] in ("voy", "vamos", "vais", "werde", "werden") or any(w in FIRST or w in ("somebody", "someone") for w in low[max(0, m - 4) : m + 1])) or any(w in NOT for w in low[m:h]):
            continue
        sure = low[m] in THREAT or any(w in ("somebody", "someone") for w in low[:m])
        q = next((j for j in range(h + 1, min(len(low), h + 4)) if low[j] in YOU), -1)
        q = -1 if any(w in ARTICLES for w in low[h + 1 : q]) else q
        q = -1 if q > 0 and low[q + 1 : q + 2] and low[q + 1] in ARTICLES else q
        plain = q == h + 1 and (low[q + 1 : q + 2] == [] or not low[q + 1][0].isalpha() or low[q + 1] in ("until", "till", "to", "black", "up", "into", "like", "so", "alive", "and", "senseless", "for"))
        before = _near(low, max(0, m - 2), h, frozenset(("dich", "dir", "te", "t")))
        plain, q = (plain and flat[h] in SOFT) or before >= 0, q if q > 0 else before
        body = any(known[j] and known[j][2] & _BIT["body"] and low[j - 1] in YOU for j in range(h + 1, min(len(low), h + 8)))
        if sure and ((q >= 0 and (known[h][0] in HARD or plain or len({known[j][0] for j in where["harm"]}) > 1)) or body):
            threat = 1.0
    for p, w in enumerate(low):
        if w in THREAT and (q := _near(low, p + 1, p + 4, SECOND)) > 0:
            # "one more word and ... will ... you"; "they will find you dead"
            if "more" in low[:p] and any(x in ("word", "step", "time", "sound") for x in low[:p]) and "and" in low[:p]:
                threat = 1.0
            if "find" in low[p:q] and any(x in ("dead", "face", "floating", "ditch", "river", "body", "pieces") for x in low[q : q + 5]):
                threat = 1.0
        if w == "why" and low[p + 1 : p + 3] in (["don't", "you"], ["dont", "you"]) and any(x in DOOM for x in flat[p + 3 : p + 6]):
            wish = 1.0
        if w in ("hope", "hopes", "wish") and any(x in ("he", "she", "they") for x in low[p + 1 : p + 3]) and any(x in DOOM for x in flat[p + 2 : p + 5]):
            wish = max(wish, 0.7)
        if w in WISH and second:
            tight = w in ("hope", "hopes", "wish", "hoffe", "hoffentlich", "espère", "souhaite", "espero", "ojalá")
            near = any(low[j] in SECOND for j in (range(p + 1, min(len(low), p + 4)) if tight else range(max(0, p - 4), min(len(low), p + 6))))
            for k in range(p + 1, min(len(low), p + (6 if tight else 7))):
                if near and flat[k] in DOOM and not any(x in NOT for x in low[p:k]) and (tight or low[k + 1 : k + 2] == [] or low[k + 1] not in ARTICLES or flat[k].endswith("ed")):
                    wish = 1.0
        elif w in NOBODY or (w == "no" and low[p + 1 : p + 2] == ["one"]):
            r = _near(low, p + 1, p + 5, REJECT)
            q = _near(low, max(r - 2, p + 1), r + 4, SECOND) if r > 0 else -1
            hostile = r > 0 and low[r] in ("hate", "hates", "despise", "despises", "laugh", "laughs", "hasst", "déteste", "odia")
            loved = w in ("everyone", "everybody", "jeder", "alle", "tout", "todos")
            if q > 0 and hostile == loved and not any(x in ("more", "better", "than", "except", "but") for x in low[r : r + 7]):
                reject = 0.5 if low[r] == "asked" else 1.0
    superlative = float(bool(sums["superlative"]) and second)
    addressed = float(second and any(sums.values()))
    return [_sum(sums["insult"], 3), _sum(sums["adjective"], 3), addressed, bound, threat, wish, reject, _curse(low, flat), superlative, exclaimed * (not bound)], denied, own


def _predicated(low: list[str], tokens: list[str], known: list, named: list[int], k: int, weak: bool) -> int:
    """1 if the term at ``k`` is said of a people or group: group subject, copula, at most four words, the term; -1 if that is denied."""
    be = next((j for j in range(k - 1, max(-1, k - 6), -1) if low[j] in COPULA and low[j] != "es"), None)
    if be is None or any(not w[0].isalpha() for w in low[be + 1 : k]):
        return 0
    lo = be
    while lo > max(0, be - 6) and low[lo - 1][0].isalpha():
        lo -= 1
    if any(low[j] in FIRST for j in range(lo, be)) or any(w in ANIMALS for w in low[:k]):
        return 0
    if low[be] in ("is", "was", "am", "est", "es", "era") and not any(low[j] in PEOPLES or (j in named and low[j - 1] in ("every", "any", "a", "an", "no")) for j in range(lo, be)):
        return 0
    if any(w in ("like", "as") for w in low[be + 1 : k]):
        return 0
    if any(known[j] and known[j][2] & _BIT["degrading"] and j not in named for j in range(lo, be)):
        return 0
    people = any(lo <= j < be for j in named) or any(low[j].endswith(PERSONS) for j in range(lo, be))
    every = any(low[j] in EVERY and (tokens[j + 1][0].isupper() or j + 1 == be) for j in range(lo, be))
    every = every or (low[be] in ("sind", "sont", "son") and lo < be - 1 and low[be - 2] in ("die", "les", "los", "las", "diese", "ces", "esos", "alle"))
    if not (people or every or ((not weak or any(j < lo for j in named)) and any(low[j] in THEY for j in range(max(lo, be - 2), be)))):
        return 0
    denied = any(w in NOT and not (w == "like" or w == "as") for w in low[lo:k])
    return -1 if denied else 1


def _hate(low: list[str], flat: list[str], tokens: list[str], known: list, where: dict[str, list[int]], spoken_of: bool) -> tuple[list[float], float]:
    """(features of HATE, whether a degrading term is denied of a group); ``spoken_of``: a group was named just before."""
    lex = lexicon()
    named = _named(low, tokens, known)
    terms: dict[str, float] = {}
    predicated = removal = destroy = lesser = vice = out = denied = 0.0
    for k in where["degrading"]:
        t, trust, _ = known[k]
        terms[t] = trust * (0.5 if t in lex.weak else 1.0)
        p = _predicated(low, tokens, known, named, k, t in lex.weak)
        predicated, denied = max(predicated, p * (0.8 + 0.2 * trust)), max(denied, float(p < 0))
        like = next((j for j in range(max(1, k - 2), k) if low[j] == "like"), 0)
        if like and low[like - 1] in ("breeding", "spreading", "living", "breed", "multiply", "swarm", "live", "behave", "smell", "spread", "stink", "spawn", "act") and any(j < k for j in named):
            predicated = max(predicated, 1.0)
    for k in [*where["vice"], *(j for j in where["insult"] if j not in where["degrading"])]:
        p = _predicated(low, tokens, known, named, k, True)
        vice, denied = max(vice, float(p)), max(denied, float(p < 0))
    they = [j for j, w in enumerate(low) if w in THEY or (known[j] and known[j][2] & _BIT["expel"] and (w.endswith("los") or (j and low[j - 1] in ("les", "los", "las"))))]
    group = named or (they and (spoken_of or terms))
    if group:
        subjects = sorted({*named, *they})
        for h in sorted({*where["expel"], *where["harm"]}):
            m = max((j for j in range(max(0, h - 7), h) if low[j] in MODAL), default=-1)
            owned = m >= 0 and any(m - 6 <= g < m or (m < g <= h and low[g] not in ("they", "those", "these")) for g in subjects) and not any(w in FIRST for w in low[max(0, m - 2) : m])
            hard = bool(known[h][2] & _BIT["expel"]) or known[h][0] in HARD or known[h][0] in ("burn", "burned", "hang", "hanged", "whip", "whipped", "rope", "drown", "drowned", "shot", "flog", "gallows")
            if owned and hard and not any(w in NOT for w in low[m:h]):
                removal = 1.0
            if m >= 0 and (flat[h] in DESTROY or known[h][0] in HARD or flat[h] in ("wipe", "hang", "burn", "whip")) and any(h < g <= h + 4 for g in named) and not any(w in NOT for w in low[m:h]):
                removal = 1.0
            begins = h == 0 or not low[h - 1][0].isalpha() or low[h - 1] in ("and", "or", "us", "must", "should", "to", "let's", "we", "just", "faut", "que", "sie", "alle", "would", "'d", "simply")
            target = [j for j in range(h + 1, min(len(low), h + 9)) if low[j] in ("them", "their", "those", "these", "every", "all", "tous", "todos") or j in named]
            more = any(w in ("all", "every", "out", "down", "houses", "homes", "last", "back", "sea", "lot", "alive", "tous", "todos", "alle", "village", "villages") for w in low[h + 1 : h + 9])
            if hard and begins and target and (more or flat[h] in DESTROY):
                destroy = 1.0
            if known[h][0].endswith("los") and known[h][2] & _BIT["expel"]:
                destroy = 1.0
    whole = named or they
    if whole:
        for k, w in enumerate(low):
            if w in LESSER and any(x in MEASURE for x in low[k + 1 : k + 5]) and min(whole) < k and not any(x in ("angel", "angels") for x in low[k : k + 6]):
                lesser = 1.0
            if w == "better" and low[k - 1] == "no" and low[k + 1 : k + 2] == ["than"] and where["degrading"] and min(whole) < k:
                lesser = 1.0
            if w in LESSER and low[k + 1 : k + 2] in (["to"], ["than"]) and low[k + 2 : k + 3] in (["ours"], ["us"], ["we"]) and min(whole) < k:
                lesser = 1.0
            if w in ("people", "men") and low[k - 1] in ("not", "no") and low[k - 2] in COPULA and (k + 1 == len(low) or not low[k + 1][0].isalpha()) and min(whole) < k:
                lesser = 1.0
            if w in MEASURE and any(x in ("not", "hardly", "scarcely", "never", "keine", "pas", "no") for x in low[max(0, k - 3) : k]) and min(whole) < k and (w in ("human", "humans") or any(x in ("we", "us", "wir", "nous", "nosotros") for x in low[k + 1 : k + 5])):
                lesser = 1.0
    if (whole or spoken_of) and any(flat[k : k + 2] == ["in", "their"] and flat[k + 2 : k + 3] in (["blood"], ["nature"], ["bones"]) for k in range(len(flat))) and (where["vice"] or where["insult"] or terms or "born" in flat):
        vice = 1.0
    if named:
        neg = any(w in ("no", "not", "never", "none", "nobody", "won't", "don't", "cannot") for w in low)
        mix = len({w for w in low if w in MIX}) * any(w in MIX_VERBS for w in low)
        guard = _near(low, 0, len(low), GUARD)
        if (neg and mix and any(w in DECENT for w in low)) or (neg and mix >= 3):
            out = 1.0
        if any(low[k] == "trust" and any(x in ("never", "not", "no", "don't", "cannot", "can't") for x in low[max(0, k - 4) : k]) for k in range(len(low))):
            out = 1.0
        if any(w in ("keep", "keeps", "kept", "throw", "want") and any(x in ("out", "away") for x in low[k + 1 : k + 8]) for k, w in enumerate(low)) and (where["degrading"] or where["vice"] or where["insult"] or any(w in MODAL for w in low)):
            out = 1.0
        if guard >= 0 and any(w in GOODS for w in low[guard : guard + 5]) and any(w in ("your", "our", "the") for w in low[guard : guard + 4]):
            vice = 1.0
        if any(w in ("better", "cleaner", "safer", "happier") for w in low) and "would" in low and (where["expel"] or any(w in ("without", "gone", "dead") for w in low)):
            removal = 1.0
        if any(w in ("cure", "answer", "solution", "remedy", "deserve", "deserves") for w in low) and any(w in ("rope", "gallows", "noose", "bullet", "bullets", "whip", "fire") for w in flat):
            removal = 1.0
    if any(w == "back" for w in low) and any(flat[k : k + 2] in (["they", "came"], ["you", "came"]) for k in range(len(flat))) and any(w in ("go", "send", "ship", "shipped", "sent", "get") for w in low):
        out = 1.0
    denied *= not lesser
    return [_sum(terms, 2), predicated, removal, destroy, lesser, vice, out], denied


def _sexual(low: list[str], flat: list[str], known: list, where: dict[str, list[int]]) -> list[float]:
    """Features of SEXUAL. Contact: a word of touch or undressing that takes hold of an intimate part or a garment of somebody's."""
    lex = lexicon()
    total: dict[str, float] = {}
    for name, most in (("explicit", 3), ("intimate", 2), ("touch", 2), ("arousal", 2), ("undress", 1), ("bedroom", 1)):
        terms = {known[k][0]: known[k][1] * (0.5 if known[k][0] in lex.weak else 1.0) for k in where[name]}
        total[name] = _sum(terms, most)
    contact = 0.0
    for k in sorted({*where["touch"], *where["undress"], *where["explicit"], *(j for j, w in enumerate(low) if w in ("around", "onto", "against", "upon"))}):
        t = known[k][0] if known[k] else low[k]
        if t in ("touch", "touched") and low[k + 1 : k + 2] in (["myself"], ["herself"], ["himself"]):
            contact = max(contact, 1.0)
        if t in ("into", "inside", "under", "up") and low[k + 1 : k + 2] and low[k + 1] in OWNERS and low[k + 2 : k + 3] and low[k + 2] in GARMENTS and any(w in ("hand", "hands", "fingers", "fingers") for w in low[max(0, k - 4) : k]):
            contact = max(contact, 1.2)
        if low[k + 1 : k + 2] == ["me"] and t in ("ride", "take", "lick", "suck", "fuck", "mount", "touch") and (len(where["explicit"]) > (t == "fuck") or where["arousal"]):
            contact = max(contact, 1.0)
        for j in range(k + 1, min(len(low), k + 5)):
            if low[j] in OWNERS and j + 1 < len(low):
                part = next((flat[i] for i in range(j + 1, min(len(low), j + 3)) if known[i]), "")
                if part in INNER or (part in FRAMED and t in ("between", "spread", "opened", "open", "parted")) or (part in CLASSES["explicit"].split() and t != part):
                    contact = max(contact, 1.0)
                elif (part in GARMENTS or flat[j + 1] in GARMENTS) and known[k] and known[k][2] & _BIT["undress"]:
                    contact = max(contact, 0.6)
                elif part in ("breast", "bosom"):
                    contact = max(contact, 0.4)
                elif part == "mouth" and low[j - 1] in ("in", "into") and t in ("took", "take", "taking", "sucked"):
                    contact = max(contact, 1.0)
                break
    for k in [*where["touch"], *where["arousal"]]:
        if flat[k] in ("thrust", "thrusts", "thrusting", "plunged") and low[k + 1 : k + 2] in (["into"], ["inside"]) and low[k + 2 : k + 3] in (["her"], ["him"], ["me"]):
            contact = max(contact, 1.0)
        if flat[k] == "entered" and low[k + 1 : k + 2] in (["her"], ["him"]) and (k + 2 >= len(low) or not low[k + 2][0].isalpha() or low[k + 2] in ("and", "from", "with", "slowly", "hard")):
            contact = max(contact, 0.7)
    if any(known[k][0] in ("fucked", "fuck", "fucks", "fucking") and low[k + 1 : k + 2] in (["her"], ["him"], ["me"], ["them"]) and low[k - 1] != "you" for k in where["explicit"]):
        contact = max(contact, 1.4)
    if any(known[k][0] not in lex.weak and known[k][1] >= 0.8 for k in where["explicit"]):
        contact = max(contact, 0.7)  # plain words for the act or its parts are meant
    if any(low[k - 1] in ("they", "we", "he", "she", "i") and known[k][0] in ("fucked", "fuck", "fucks", "baise", "follar") and low[k + 1 : k + 2] not in (["up"], ["off"]) for k in where["explicit"] if k):
        contact = max(contact, 1.4)
    if any(w in ("send", "show") for w in low) and any(flat[k] in ("nude", "naked", "topless") and k + 1 < len(low) and known[k + 1] and known[k + 1][2] & _BIT["bedroom"] for k in range(len(low))):
        contact = max(contact, 1.3)
    if any(known[k][0] == "came" and low[k + 1 : k + 2] == ["hard"] for k in where["arousal"]):
        contact = max(contact, 0.7)
    kinds = sum(bool(where[n]) for n in ("explicit", "intimate", "touch", "arousal", "undress"))
    person = any(w in THIRD for w in low)
    return [total["explicit"], total["intimate"], total["touch"], total["arousal"], total["undress"], total["bedroom"], contact, float(kinds >= 3), float(not person)]


def _features(tokens: list[str], known: list, quoted: bool, spoken_of: bool) -> list[tuple[str, np.ndarray]]:
    """(kind, features) of a window, of the kinds of which it has any sign."""
    low = [t.lower().replace("’", "'") for t in tokens]
    flat = [k[0] if k else w if w.isascii() and w.isalpha() and not _REPEAT.search(w) else folded(w) for k, w in zip(known, low)]
    where: dict[str, list[int]] = {name: [] for name in CLASSES}
    bits = 0
    for k, t in enumerate(known):
        if t:
            bits |= t[2]
            for name, bit in _BIT.items():
                if t[2] & bit:
                    where[name].append(k)
    reported = float(any(w in SPEECH and w not in ("say", "saying", "call", "calling", "read", "hear", "according", "quoted") and j and low[j - 1] not in ("nobody", "i", "you", "never", "to", "one", ",") for j, w in enumerate(low)))
    doctrine = min(2.0, float(sum(w in DOCTRINE for w in low)))
    innocent = min(2.0, float(sum(w in MEDICAL or w in ANIMALS for w in low)))
    beasts = min(2.0, float(sum(w in ANIMALS for w in low)))
    out = []
    insulting = bits & (_BIT["insult"] | _BIT["adjective"] | _BIT["superlative"])
    if insulting or bits & (_BIT["harm"] | _BIT["death"] | _BIT["vocative"]) or any(w in NOBODY or w in ("one", "more", "waste", "piece") for w in low):
        own, denied, self_said = _abuse(low, flat, known, where)
        if any(own):
            # what is said to somebody's face is no doctrine and no husbandry
            direct = own[3] >= 1 or any(own[4:8])
            out.append(("abuse", [*own, float(quoted), reported, denied, *((0.0, 0.0) if direct else (doctrine, beasts)), self_said]))
    own, denied = _hate(low, flat, tokens, known, where, spoken_of)
    if any(own):
        out.append(("hate", [*own, float(quoted), reported, denied, doctrine, innocent, 0.0]))
    if bits & (_BIT["explicit"] | _BIT["intimate"] | _BIT["arousal"] | _BIT["undress"]):
        own = _sexual(low, flat, known, where)
        out.append(("sexual", [*own, float(quoted), reported, 0.0, doctrine if own[6] < 0.7 else 0.0, innocent, 0.0]))
    return [(kind, np.array([1.0, *f])) for kind, f in out]


def described(text: str) -> list[tuple[str, np.ndarray]]:
    """(kind, features) of each window of the text with any sign of a kind."""
    tokens = _TOKEN.findall(_DOTTED.sub("", _SPACED.sub(_unspaced, _CUT.sub("", text) if "\n" in text else text)))
    known = list(map(_known().__getitem__, tokens))
    anchors = [k for k, t in enumerate(known) if t and t[2] & (_ANCHOR | _USE)]
    out, done = [], -1
    for k in anchors:
        if k <= done:
            continue
        lo = k
        while lo > max(0, k - WINDOW) and not _ends(tokens[lo - 1]):
            lo -= 1
        hi = k + 1
        while hi < min(len(tokens), lo + 2 * WINDOW + 8) and not _ends(tokens[hi]):
            hi += 1
        done = hi - 1
        window = known[lo:hi]
        bits = 0
        for t in window:
            if t:
                bits |= t[2]
        words = {t.lower() for t in tokens[lo:hi]}
        if not _possible(bits, words):
            continue
        before = tokens[max(0, lo - 30) : lo]
        spoken_of = bool(before) and bool(_named([t.lower() for t in before], before, known[max(0, lo - 30) : lo]))
        out += _features(tokens[lo:hi], window, _spoken(tokens, lo, hi), spoken_of)
    return out


_GROUPED = THEY | PEOPLES | EVERY
_STRONG = _BIT["insult"] | _BIT["adjective"] | _BIT["superlative"] | _BIT["explicit"]
_BODILY = (_BIT["intimate"], _BIT["touch"], _BIT["arousal"], _BIT["undress"])


def _possible(bits: int, words: set[str]) -> bool:
    """Whether a window with these classes and words can reach a score of 0 at all; the others need no frames."""
    if bits & _STRONG or (bits & _BIT["vocative"] and bits & (_BIT["death"] | _BIT["insult"] | _BIT["harm"])):
        return True
    second = not words.isdisjoint(SECOND)
    if second and (bits & (_BIT["harm"] | _BIT["death"] | _BIT["vocative"]) or not words.isdisjoint(NOBODY) or "one" in words):
        return True
    if sum(bool(bits & b) for b in _BODILY) >= 2:
        return True
    grouped = not words.isdisjoint(_GROUPED)
    if bits & (_BIT["degrading"] | _BIT["vice"]) or not words.isdisjoint(DESTROY) or (bits & (_BIT["expel"] | _BIT["harm"]) and (grouped or not words.isdisjoint(MODAL))):
        return True
    return bool(words & (LESSER | MEASURE | {"trust", "decent", "honest", "respectable", "thieving", "count", "lock", "keep", "back", "cure", "blood"})) or (second and bool(words & {"more", "waste", "piece"}))


def windows(text: str, weights: dict[str, np.ndarray] | None = None) -> list[tuple[str, float]]:
    """(kind, score) of each window of the text that has the kind; scores are 0 or more."""
    weights = weights or prior()
    scored = [(kind, float(weights[kind] @ f)) for kind, f in described(text)]
    return [(kind, s) for kind, s in scored if s >= 0]


SHARP = 3.0  # how steeply a window's score turns into a probability


def fit(rated: list[tuple[float, list[tuple[str, np.ndarray]]]], spread: float = 0.25, error: float = 0.08, steps: int = 150) -> dict[str, np.ndarray]:
    """Weights from rated documents (share of raters who call it toxic, its windows), held near the prior.

    A document is toxic if any of its windows is (noisy or), a rater errs with probability
    ``error``, and each weight has a normal prior of deviation ``spread`` around ``PRIOR``.
    """
    weights, at, dims = prior(), {}, 0
    for kind in KINDS:
        at[kind] = dims
        dims += len(weights[kind])
    start = np.concatenate([weights[kind] for kind in KINDS])
    rows, doc, y = [], [], []
    for share, found_windows in rated:
        if found_windows:
            for kind, f in found_windows:
                row = np.zeros(dims)
                row[at[kind] : at[kind] + len(f)] = f
                rows.append(row)
                doc.append(len(y))
            y.append(share)
    w = start.copy()
    if rows:
        x, d, share = np.array(rows), np.array(doc), np.array(y)
        free = np.ones(dims)
        free[list(at.values())] = 0  # where a kind begins is what the prior says
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(SHARP * (x @ w), -30, 30)))
            none = np.exp(np.bincount(d, np.log1p(-np.minimum(p, 1 - 1e-9)), len(share)))
            q = error + (1 - 2 * error) * (1 - none)
            slope = (1 - 2 * error) * (share / q - (1 - share) / (1 - q)) * none
            w += 0.001 * free * (SHARP * (x.T @ (slope[d] * p)) - (w - start) / spread**2)
    return {kind: w[at[kind] : at[kind] + len(weights[kind])] for kind in KINDS}


def fitted(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """:func:`fit` to the ratings ``labels`` (doc_id, rater, toxic): the first ``n`` rated documents by a hash of the id.

    Repeated ratings of one rater count once; null ratings not at all. Only features come
    to the driver, of at most ``n`` documents.
    """
    session.ship(df.sparkSession)
    rates = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id", "rater").agg(F.max("toxic").alias("toxic")).groupBy("doc_id").agg(F.avg("toxic").alias("share"))
    chosen = rates.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kinds, values = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for kind, f in described(t):
                    ids.append(i)
                    kinds.append(kind)
                    values.append(f.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.list_(pa.float64()))], names=["doc_id", "kind", "f"])

    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    by_doc: dict[int, list[tuple[str, np.ndarray]]] = {}
    for r in texts.select("doc_id", "text").mapInArrow(run, "doc_id bigint, kind string, f array<double>").collect():
        by_doc.setdefault(r.doc_id, []).append((r.kind, np.array(r.f)))
    share = {r.doc_id: r.share for r in chosen.collect()}
    return fit([(share[i], sorted(by_doc[i], key=lambda x: (x[0], x[1].tolist()))) for i in sorted(by_doc)])


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(id, abuse, hate, sexual, n_abuse, n_hate, n_sexual): scores from 0 to 1 and numbers of windows, for every row."""
    session.ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    given = weights or prior()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = {k: [] for k in KINDS}
            count = {k: [] for k in KINDS}
            for t in b.column(1).to_pylist():
                seen = windows(t, given) if t else []
                for k in KINDS:
                    own = [s for kk, s in seen if kk == k]
                    total[k].append(1 - math.prod(1 / (1 + math.exp(min(SHARP * s, 30))) for s in own) if own else 0.0)
                    count[k].append(len(own))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(total[k], pa.float64()) for k in KINDS), *(pa.array(count[k], pa.int32()) for k in KINDS)], names=["id", *KINDS, *(f"n_{k}" for k in KINDS)])

    schema = f"id {kind}, " + ", ".join(f"{k} double" for k in KINDS) + ", " + ", ".join(f"n_{k} int" for k in KINDS)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(id, kind) of every document that holds a passage of the kind."""
    s = scores(df, id_col, text_col, weights)
    kinds = F.array(*(F.when(F.col(f"n_{k}") > 0, F.lit(k)) for k in KINDS))
    return s.select(id_col, F.explode(F.array_compact(kinds)).alias("kind")).where(F.col(id_col).isNotNull()).distinct()


def rates(df: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Per source: documents, those with each kind, and the mean score of each; a null source is a source of its own."""
    rows = df.select(F.struct(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source")).alias("key"), F.col(text_col).alias("text"))
    s = scores(rows, "key", "text", weights)
    out = s.groupBy(F.col("key.source").alias("source")).agg(F.count("*").alias("n_docs"), *(F.count_if(F.col(f"n_{k}") > 0).alias(f"docs_{k}") for k in KINDS), *(F.avg(k).alias(f"mean_{k}") for k in KINDS))
    return out.withColumns({f"rate_{k}": F.col(f"docs_{k}") / F.col("n_docs") for k in KINDS})
