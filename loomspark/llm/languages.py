"""The language of a text: its script, or for Latin letters a naive Bayes choice over character n-gram profiles of many languages."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

# The first article of the declaration of human rights and frequent short words, for the profiles. One string a language.
SAMPLES = {
    "en": "all human beings are born free and equal in dignity and rights they are endowed with reason and conscience and should act towards one another in a spirit of brotherhood the of and to in is that it was for on are as with his they at be this have from or had by not but what some we can out other were all there when up use your how said an each she which do their time if will way about many then them would like so these her long make thing see him two has more day could go come did number no most people my over know than first who been any where after why before must while does only every",
    "de": "alle menschen sind frei und gleich an würde und rechten geboren sie sind mit vernunft und gewissen begabt und sollen einander im geist der brüderlichkeit begegnen der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wenn kann wir diese gegen muss schon ihre ohne unter bleibt sobald jede bevor gilt höchstens",
    "es": "todos los seres humanos nacen libres e iguales en dignidad y derechos y dotados como están de razón y conciencia deben comportarse fraternalmente los unos con los otros de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto antes algunos qué unos yo otro existe cada está cambia máximo tras según",
    "fr": "tous les êtres humains naissent libres et égaux en dignité et en droits ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son aux d'un cette d'une ont ses mais comme on tout nous sa fait été aussi leur bien peut ces y deux depuis lorsque sans chaque avant après reste être si quand elle même",
    "pt": "todos os seres humanos nascem livres e iguais em dignidade e em direitos dotados de razão e de consciência devem agir uns para com os outros em espírito de fraternidade de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você tinha cada não antes após fica",
    "it": "tutti gli esseri umani nascono liberi ed eguali in dignità e diritti essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza di e il la che in a per un è del non una i con da si le sono della come anche più al dei alla ha nel ma delle gli su se lo o dal questo suo nella quando molto prima essere stato due loro tra ogni senza dopo viene cui già chi deve può",
    "nl": "alle mensen worden vrij en gelijk in waardigheid en rechten geboren zij zijn begiftigd met verstand en geweten en behoren zich jegens elkander in een geest van broederschap te gedragen de van het een in en is dat op te zijn met voor die niet aan er om ook als dan maar bij uit nog naar worden door over ze tot je hij was ik wordt zo kan heeft meer geen deze hun wij of onder zonder elke voordat moet blijft na wat haar",
    "sv": "alla människor är födda fria och lika i värde och rättigheter de är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap och i att det som en på är av för med till den har de inte om ett han men var jag sig från vi så kan man när år säger hon under också efter eller nu sin där vid mot ska skulle kommer ut får finns vara hade alla andra mycket än här då sedan över utan varje innan måste bara detta blir",
    "da": "alle mennesker er født frie og lige i værdighed og rettigheder de er udstyret med fornuft og samvittighed og de bør handle mod hverandre i en broderskabets ånd og i at det er en til på som af for med den der ikke de et har han var jeg men om sig fra vi kan så ved hun eller når efter nu over skal blev også ud være hvor mod havde alle man meget kun uden hver før efter bliver hvad mere under disse",
    "no": "alle mennesker er født frie og med samme menneskeverd og menneskerettigheter de er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd og i det er som på en til av for at med den har de ikke et han var jeg men om seg fra vi kan så ved hun eller når etter nå over skal ble også ut være hvor mot hadde alle man mye bare uten hver før blir hva mer under disse må",
    "fi": "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä ja on ei että se oli hän mutta ovat kun niin kuin myös joka sen tai jos vain mukaan voi nyt sitä ole hänen jo tämä mitä mikä vielä vuoden siitä sekä kuten jotka ennen jälkeen ilman kanssa olla tulee voidaan täytyy tämän",
    "pl": "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa w i na z się nie do to że jest o jak po co tak za od ale przez był dla być czy są już tylko może jego tego ich które który jeszcze gdy przed bez po każdy kiedy lub oraz jako pod nad można będzie musi była było tym",
    "cs": "všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství a se v na je že o s z do i to ve k pro za by ale si po od jsem jako jeho podle jsou které který jen před než až při bez když nebo co být bude může jeho tak jak ještě pouze také mezi každý musí byl byla bylo této není",
    "sk": "všetci ľudia sa rodia slobodní a rovní v dôstojnosti a právach sú obdarení rozumom a svedomím a majú sa k sebe správať v duchu bratstva a sa v na je že o s z do i to vo k pre za by ale si po od som ako jeho podľa sú ktoré ktorý len pred než až pri bez keď alebo čo byť bude môže tak ešte tiež medzi každý musí bol bola bolo tejto nie je",
    "hu": "minden emberi lény szabadon születik és egyenlő méltósága és joga van az emberek ésszel és lelkiismerettel bírván egymással szemben testvéri szellemben kell hogy viseltessenek a az és hogy nem is egy ez meg de ha csak azt már még volt van lesz mint vagy el fel ki be le nagyon kell lehet után előtt nélkül minden amikor mert akkor itt ott neki őket olyan között szerint pedig majd",
    "ro": "toate ființele umane se nasc libere și egale în demnitate și în drepturi ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității și în de la a cu pe că este nu un o din pentru se sunt care mai au fi ce sau dar după când fără fiecare înainte prin până între această ale lui lor dacă poate trebuie fost era cel cea iar",
    "tr": "bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler ve bir bu da de için ile çok daha ne o gibi en var olarak kadar sonra ama değil her olan ki ya mi önce ancak veya göre diye yok bütün nasıl zaman şey içinde ise bunu olduğu tarafından gerekir olur",
    "id": "semua orang dilahirkan merdeka dan mempunyai martabat dan hak hak yang sama mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan yang dan di itu dengan untuk tidak ini dari dalam akan pada juga saya ke karena ada bisa sudah oleh atau seperti adalah mereka kami dapat telah lebih harus setelah sebelum tanpa setiap jika hanya ketika",
    "vi": "tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền mọi con người đều được tạo hoá ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình anh em và của là có không được cho trong một các những với người này khi đã từ đến để như về ra sẽ cũng phải nhưng vào còn trước sau mỗi nếu chỉ",
    "hr": "sva ljudska bića rađaju se slobodna i jednaka u dostojanstvu i pravima ona su obdarena razumom i sviješću i trebaju jedna prema drugima postupati u duhu bratstva i u je na se da su za od ne s a što o kao ali iz koji to do će ili po bi sam samo nije koja koje nakon prije bez svaki kada ako može mora biti bio bila bilo ovaj između također",
    "ca": "tots els éssers humans neixen lliures i iguals en dignitat i en drets són dotats de raó i de consciència i han de comportar-se fraternalment els uns amb els altres de la i a el que en les per amb del un una és no els al més com pel dels són aquest aquesta també però quan sense cada abans després fins sobre entre pot ha han molt perquè seva seu tot",
    "lt": "visi žmonės gimsta laisvi ir lygūs savo orumu ir teisėmis jiems suteiktas protas ir sąžinė ir jie turi elgtis vienas kito atžvilgiu kaip broliai ir kad į yra iš su tai bet ne jis buvo apie kaip nuo už per dar jau tik arba kai jo jų prieš po be kiekvienas turi gali būti bus šis ši kur",
    "et": "kõik inimesed sünnivad vabadena ja võrdsetena oma väärikuselt ja õigustelt neile on antud mõistus ja südametunnistus ja nende suhtumist üksteisesse peab kandma vendluse vaim ja on ei et see oli ta ka aga kui siis oma mis või nii ning nagu veel juba tema pärast enne ilma iga peab võib saab olla kes mida seda",
    "sw": "watu wote wamezaliwa huru hadhi na haki zao ni sawa wote wamejaliwa akili na dhamiri hivyo yapasa watendeane kindugu ya na wa kwa ni katika la za kuwa cha hii yake hiyo kama lakini au baada kabla bila kila pia sana watu huo hizo yao wake ambao ambayo ili tu mwa",
    "tl": "ang lahat ng tao ay isinilang na malaya at pantay pantay sa karangalan at mga karapatan sila ay pinagkalooban ng katwiran at budhi at dapat magpalagayan ang isa't isa sa diwa ng pagkakapatiran ang ng sa na at mga ay ito para hindi kung may siya ko nang pero o ni kay bago pagkatapos bawat dapat lamang kapag",
}
_SCRIPTS = (
    ("ja", re.compile("[぀-ヿ]")), ("ko", re.compile("[가-힣ᄀ-ᇿ]")), ("zh", re.compile("[一-鿿]")), ("cyrillic", re.compile("[Ѐ-ӿ]")), ("arabic", re.compile("[؀-ۿ]")), ("greek", re.compile("[Ͱ-Ͽ]")), ("hebrew", re.compile("[֐-׿]")), ("devanagari", re.compile("[ऀ-ॿ]")), ("thai", re.compile("[฀-๿]")),
)
#: What says nothing about the language: code, names joined by signs, flags, names with capitals inside, paths, numbers.
_NAMES = re.compile(r"```.*?(?:```|$)|`[^`]*`|[\w.]*[\w][-‐‑][\w.‐‑-]+|(?:--|‑‑)[\w‑-]+|[\w]*[a-z][A-Z]\w*|\S*[/\\=_<>{}\[\]]\S*|\d+", re.S | re.A)
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: Longest n-gram. A whole word of a profile is an n-gram too.
GRAM = 3


def _grams(word: str) -> list[str]:
    w = f" {word} "
    out = [w[i : i + n] for n in range(1, GRAM + 1) for i in range(len(w) - n + 1) if w[i : i + n] != " "]
    return out if len(w) <= GRAM else [*out, w]


class Profiles:
    """For each word seen, a vector of log probabilities by language, remembered as words repeat."""

    MEMORY = 200_000

    def __init__(self, samples: dict[str, str] = SAMPLES):
        self.names = list(samples)
        counts = [Counter(g for w in text.split() for g in _grams(w)) for text in samples.values()]
        alphabet = set().union(*counts)
        totals = np.array([c.total() for c in counts], float)
        half = 0.05  # of an unseen n-gram
        self.unseen = np.log(half / (totals + half * len(alphabet)))
        self.of = {g: np.log((np.array([c[g] for c in counts]) + half) / (totals + half * len(alphabet))) for g in alphabet}
        self.known: dict[str, np.ndarray] = {}

    def word(self, word: str) -> np.ndarray:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > self.MEMORY:
                self.known.clear()
            grams = _grams(word)
            got = self.known[word] = sum((self.of.get(g, self.unseen) for g in grams), np.zeros(len(self.names))) / len(grams)
        return got

    def scores(self, words: list[str]) -> np.ndarray:
        """Sum over the words of their mean log probability by language."""
        if not words:
            return np.zeros(len(self.names))
        known = self.known
        return np.add.reduce([known[w] if w in known else self.word(w) for w in words])


_LOADED: list[Profiles] = []


def profiles() -> Profiles:
    if not _LOADED:
        _LOADED.append(Profiles())
    return _LOADED[0]


#: What makes a token of plain ASCII such a name: read token by token, which is faster.
_ODD = re.compile(r"[/\\=_<>{}\[\]\d]|\w-\w|--|[a-z][A-Z]")
_CODE = re.compile(r"```.*?(?:```|$)|`[^`]*`", re.S)


def _core(text: str) -> str:
    if not text.isascii():
        return _NAMES.sub(" ", text)
    odd = _ODD.search
    return " ".join([t for t in (_CODE.sub(" ", text) if "`" in text else text).split() if not odd(t)])


def script(core: str) -> str | None:
    if core.isascii():
        return None
    letters = sum(c.isalpha() for c in core)
    return next((lang for lang, chars in _SCRIPTS if len(chars.findall(core)) >= max(2, 0.15 * letters)), None) if letters else None


#: Languages so near to each other that a sentence of either may pass for the other.
_NEAR = ({"da", "no", "sv"}, {"cs", "sk"}, {"es", "pt", "ca"})


def language(text: str, margin: float = 0.0) -> str | None:
    """The language of a text; None for fewer than three words, or where the best one leads the next by no more than `margin` a word."""
    core = _core(text)
    own = script(core)
    if own:
        return own
    words = [w.lower() for w in _WORD.findall(core)]
    if len(words) < 3:
        return None
    s = profiles().scores(words)
    first, second = np.argsort(-s)[:2]
    return profiles().names[first] if s[first] - s[second] > margin * len(words) else None


def differ(asked: str, given: str, sure: float = 4.0, mean: float = 0.12) -> bool:
    """Whether `given` is in another language than `asked`: in another script, or so much likelier in another language (by `sure` in sum and `mean` a word) than in the
    language of `asked`, which is the likeliest one for both together where `asked` alone says little."""
    a, b = _core(asked), _core(given)
    one, two = script(a), script(b)
    if one or two:
        return one != two and (one is not None or len(_WORD.findall(a)) >= 3) and (two is not None or len(_WORD.findall(b)) >= 3)  # scripts without spaces have no word counts
    p = profiles()
    words_a, words_b = ([w.lower() for w in _WORD.findall(x)] for x in (a, b))
    if len(words_a) < 3 or len(words_b) < 3:
        return False
    sa, sb = p.scores(words_a), p.scores(words_b)
    mine, theirs = int(sa.argmax()), int(sb.argmax())
    if mine == theirs or any(p.names[mine] in near and p.names[theirs] in near for near in _NEAR):
        return False
    lead = sb[theirs] - sb[mine]
    back = sa[mine] - sa[theirs]
    return lead > sure and lead > mean * len(words_b) and back > mean * len(words_a)
