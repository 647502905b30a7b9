"""Word lists and patterns of the voters on abusive, hateful and sexual language.

The lists hold general vocabulary: insults, dehumanising and sexual words, idioms of threat,
dismissal, exclusion and desire. What the lists do not name is left to the classifier, which
learns from annotated documents.
"""

from __future__ import annotations

CATEGORIES = ("abuse", "hate", "sexual")

# Terms per category in English, German, French, Spanish and Korean.
TERMS = {
    "abuse": """idiot idiots moron loser imbecile cretin dimwit halfwit maggot scumbag parasite trash filth dumbass asshole bastard jerk
        stupid pathetic worthless scum pig coward clown fool dimwitted imbecilic moronic dolt dunce numbskull nitwit blockhead simpleton
        trottel dummkopf versager abschaum vollidiot schwachkopf depp arschloch mistkerl spinner idioten hohlkopf blödmann
        imbécile crétin abruti minable ordure connard débile crétine salaud idiote bouffon
        idiota cretino imbécil escoria basura inútil estúpido gilipollas cabrón payaso tonto
        쓰레기 멍청이 바보 병신 찌질이 새끼 머저리 등신""".split(),
    "hate": """vermin rats savages savage disease subhuman subhumans trash filth parasites scum cockroaches animals plague leeches
        ungeziefer ratten dreck abschaum untermenschen gesindel pack parasiten schmarotzer
        vermine rats sauvages racaille parasites cafards nuisibles
        alimañas ratas salvajes escoria plaga basura cucarachas
        벌레 해충 쓰레기 기생충 짐승 야만인""".split(),
    "sexual": """nude naked topless horny undressed sexy porn erotic slut orgasm boobs nudes cock pussy
        nackt nackte geil geile nackten erotik titten
        nue nues nu coquine coquines sexe érotique
        desnuda desnudas desnudo cachonda cachondo sexo erótica
        야한 알몸 벗은 음란 섹시""".split(),
}

_YOU = r"\b(?:you|your|yours|yourself|du|dir|dich|dein|deine|deiner|tu|te|toi|ta|ton|tes|vous|eres|tú|ti)\b|(?:^|\s)(?:너|너는|너희|네|니|당신|네가)(?=\s|$)"
_META = r"\b(?:filters?|guides?|guidelines?|policy|quotes?|quoted|examples?|lists?|moderation|moderators?|blocked|annotations?|annotators?|reports? about|word list|such as|said the|definition|dictionary|means|beispiele?|richtlinien?|wortfilter|exemples?|modération|règles?|ejemplos?|moderación|reglas?)\b|예시|필터|정책"
_DO = r"(?:hurt|kill|find|break|beat|destroy|smash|crush|get)"

# Fixed values: (category, voter, what a match votes, pattern). Patterns are searched in the words of a lower-case sentence, with single spaces between, without quoted parts.
PATTERNS = [
    ("abuse", "dismissal", 1, r"\b(?:shut up|shut your (?:mouth|trap|face)|get lost|piss off|go to hell|drop dead|halt (?:die klappe|den mund|dein maul)|verschwinde|hau ab|ferme la|ta gueule|dégage|casse toi|va t en|cállate|lárgate|vete a la|espèce de|pedazo de)\b|입 다물|닥쳐|꺼져"),
    ("abuse", "threat", 1, rf"\b(?:(?:i|we) (?:swear (?:i|we) )?(?:will|ll|am going to|are going to) (?:come and )?{_DO} you|{_DO} your (?:\w+ )?(?:fingers?|legs?|neck|bones?|face|arms?|teeth)|(?:breche?|schlage?|haue?) (?:dir|dich)|mach(?:e)? dich fertig|(?:te|vous) (?:casse|tue|frappe|démolis)|te (?:rompo|mato|pego|voy a)|know where you live|watch your back|you will (?:pay|regret))\b|가만 안|죽여|부러뜨"),
    ("abuse", "contempt", 1, r"\b(?:your (?:own )?mother|deine (?:eigene )?mutter|ta (?:propre )?mère|tu (?:propia )?madre|ashamed of you|schämt sich|what an?|so ein|quel(?:le)?|wertlose\w*|pauvre|pobre|complete|total|waste of)\b|쓸모없는|수준이"),
    ("hate", "everyone", 1, r"\b(?:all|alle|tous les|todos los|those|these|diese|ces|esos) (?:the )?[^\W\d_]+(?: people)? (?:are|sind|sont|son)\b|사람들은 (?:모두|다)|놈들은"),
    ("hate", "nature", 1, r"\b(?:breed|by birth|born|in their blood|by nature|naissent|nacen|von geburt|von natur|de nature|por naturaleza|their kind|those people|never learn)\b|태어날 때부터|천성"),
    ("hate", "removal", 1, r"\b(?:driven? (?:them )?out|drive (?:them|those)|get rid of|out of (?:our|this|the) (?:schools?|country|town|city|land)|deport\w*|aus dem land|(?:raus|gejagt|vertrieben|vertreiben)|chass(?:er|és)|hors d(?:u|e) (?:notre )?pays|expuls\w+|ech(?:ar|arlos)|fuera del? (?:nuestro )?país|go back to)\b|쫓아내|몰아내|추방"),
    ("sexual", "undress", 1, r"\b(?:take off your|undress\w*|strip(?:ped)? (?:for|naked)|wear(?:ing)? nothing|unbutton\w*|zieh dich aus|ausziehen|déshabill\w+|desnúdate|quítate la)\b|옷을 벗"),
    ("sexual", "desire", 1, r"\b(?:in (?:my|your) bed|in meinem bett|dans mon lit|en mi cama|moan\w*|lust|caress\w*|seduc\w+|thighs?|skirt|blouse|panties|sleep with (?:me|you)|make love|jupe|chemisier|falda|blusa|rock|bluse)\b|침대"),
    ("abuse", "meta", -1, _META),
    ("hate", "meta", -1, _META),
    ("sexual", "meta", -1, _META + r"|\b(?:education|health|survey|colou?rs?|design|art|museum|statue|medical)\b"),
]
#: Voters that only count beside a term or another voter, as they match plain prose too.
BESIDE = {("abuse", "contempt"), ("hate", "everyone")}
SECOND_PERSON = _YOU
