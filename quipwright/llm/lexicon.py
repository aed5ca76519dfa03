"""Words and phrases by which abusive, hateful and sexual language is described to the classifier.

The lists only name categories; what a category, alone or beside another, means for a text is learnt
from the labelled sample. Entries are compared without case, accents, doubled letters and disguise.
"""

from __future__ import annotations

# General vocabulary, by category, in the languages of the corpus.
WORDS = {
    "insult": """
idiot idiots moron morons imbecile cretin dumbass loser losers scumbag scumbags bastard bastards asshole assholes arsehole dickhead dickheads prick pricks wanker wankers twat
bitch whore slut cunt jerk douchebag retard retarded freak pig swine fool halfwit dimwit motherfucker shithead lowlife
arschloch arschlocher hurensohn wichser fotze schlampe hure dummkopf missgeburt drecksau schwein trottel vollidiot mistkerl scheisskerl penner depp
connard connards connasse salaud salope salopard abruti debile encule batard enfoire bouffon pute con conne
imbecil idiota gilipollas cabron cabrones puta pendejo maricon zorra subnormal cretino capullo estupido estupida tonto
stronzo stronza coglione puttana troia bastardo deficiente scemo testa di cazzo
babaca otario vagabunda desgracado cuzao burro arrombado
klootzak klootzakken hoer eikel idioot sukkel mongool hoerenzoon rotzak kutwijf trut lul
hora svin karring javel skitstovel dumskalle jubelidiot
kurwa skurwysyn debil chuj dziwka suka kretyn kretynem gnoj pierdolony dupek idioto idiota debilem dupkiem
hulye kurva geci idiota barom rohadek kocsog seggfej szemet
сука идиот мудак урод тварь дебил шлюха козел мразь ублюдок придурок дурак блядь
μαλακα μαλακας ηλιθιε ηλιθιος πουτανα βλακα βλακας καθικι αρχιδι
""",
    "slight": """
stupid brainless pathetic worthless useless disgusting ugly filthy shitty dumb miserable hideous dumme dummes dummer verdammter verdammte verdammtes hassliche
sale sales gros grosse sucio asqueroso feo inutile brutto schifoso schifosa nojento feio lelijke vieze stomme javla ful dum glupi glupia glupia brzydki undorito ronda rohadt тупой тупая жалкий
грязный βρωμικε βρωμιαρη αχρηστε
""",
    "curse": """
fuck fucking fucked fucker shit crap bullshit scheisse scheiss fick ficken verdammt merde putain foutre mierda joder carajo cono merda cazzo vaffanculo porra caralho foder kut verdomme tyfus kanker
fan javlar helvete fy kurwa cholera pierdol spierdalaj wypierdalaj szar bazd fasz хуй бля пизда ебать нахуй γαμωτο σκατα γαμησου
""",
    "beast": """
vermin cockroach cockroaches parasite parasites subhuman subhumans animals garbage filth filthy disease plague scum cages cage trash rats insects liars lice
ungeziefer abschaum untermenschen parasiten schmarotzer gesindel dreck mull vermine ordure ordures cafards racaille nuisibles alimanas alimana cucarachas parasitos basura escoria ratas plaga
parassiti scarafaggi feccia spazzatura parasitas vermes baratas lixo escoria ongedierte uitschot tuig vuilnis ohyra avskum skadedjur parasiter robactwo smieci szkodniki pasozyty eloskodok patkanyok
csotanyok szemet паразиты тараканы твари крысы мусор отбросы παρασιτα κατσαριδες σκουπιδια ζωα
""",
    "group": """
women men gays gay lesbians immigrants immigrant migrants foreigners refugees muslims jews christians catholics hindus atheists believers disabled blacks whites asians africans arabs mexicans
gypsies roma islanders homosexuals transsexuals trans pensioners natives folk elderly cripples blind deaf
auslander fluchtlinge frauen juden muslime migranten schwule lesben behinderte zigeuner alte etrangers immigres refugies femmes arabes juifs musulmans noirs handicapes homosexuels vieux athees croyants
extranjeros inmigrantes refugiados mujeres negros judios musulmanes moros gitanos homosexuales discapacitados viejos ateos stranieri immigrati rifugiati donne ebrei musulmani zingari neri disabili vecchi atei
estrangeiros imigrantes mulheres ciganos judeus muculmanos pretos deficientes velhos ateus buitenlanders vluchtelingen vrouwen moslims joden homos gehandicapten zwarten
utlanningar flyktingar kvinnor muslimer judar bogar invandrare handikappade obcokrajowcy uchodzcy kobiety zydzi muzulmanie geje cyganie imigranci kulfoldiek menekultek nok zsidok ciganyok muszlimok melegek bevandorlok
иностранцы беженцы женщины евреи мусульмане цыгане мигранты инвалиды ξενοι προσφυγες γυναικες εβραιοι μουσουλμανοι μεταναστες τσιγγανοι
""",
    "you": """
you your yours yourself yourselves u ya du dich dir dein deine deiner dein ihr euch tu te toi ton ta tes vous votre es eres ti tuyo vosotros usted vete sei tuo tua voce seu sua teu jij je jou jouw jullie
dig din ditt dina ni ty cie ci ciebie twoj twoja jestes wy te teged neked vagy ты тебя тебе твой твоя вы εισαι εσυ σου σας
""",
    "body": """
tits tit boobs pussy cock cocks dick dicks penis vagina clit nipples ass balls cum sperm erection boner titten muschi schwanz mose bite chatte seins couilles polla verga tetas coño figa tette cazzo
pau buceta peitos pik tieten lul kuk fitta brost kutas cipka cycki fasz pina csocs член сиськи пизда πουτσος μουνι βυζια
""",
    "sex": """
porn porno masturbate masturbates masturbating masturbated orgasm orgasms horny blowjob handjob anal dildo threesome gangbang fucked naked nude nudes moan moaning moans creampie deepthroat stripped undress
wichsen blasen geil orgasmus gefickt bumsen baiser sucer branler bander ejaculer follar correrse mamada chupar cachonda scopare pompino sborra gozar boquete transar neuken pijpen klaarkomen knulla runka kat
pieprzyc ruchac lodzik baszni dugni szopni трахать трахнул минет кончил ебал γαμαω γαμησα πιπα καυλα
""",
    "harm": """
kill kills killed killing murder shoot shot hang hanged stab strangle strangled drown drowned drowning burn burned beat choke poison break smash jaw neck skull bones rope noose bullet grave coffin gun
knife gas gallows lynch bury buried dead death die dies dying corpse breathing bleed acid
toten umbringen erschiessen sterben stirb krepier verrecke aufhangen tuer creve crever mourir pendre matar muerete morir muere ahorcar fusilar uccidere muori morire crepa matar morre morrer enforcar doden sterf
verrek doda do hang zabic zdychaj umrzyj megol dogolj убить сдохни умри повесить убей σκοτωσω ψοφα πεθανε
""",
    "every": """
all every each never only nobody always born belong belongs should must alle jeder nie raus mussen sollen tous toutes jamais dehors doivent todos todas nunca fuera deben tutti tutte mai fuori devono todos fora
moeten nooit eruit alla ut maste aldrig wszyscy nigdy won minden soha все никогда вон ολοι ποτε εξω
""",
    "reject": """
calling call kindly reject condemn condemned unacceptable apologise apologised ban banned report reported taught teaches explained definition wrong hurtful funny respect welcome
""",
    "thing": """
printer umbrella computer car train weather monday mondays phone laptop alarm clock bus kettle door machine bike toaster drucker wetter ordinateur imprimante impresora coche
""",
}
# Ways of telling someone off that are whole phrases.
PHRASES = {
    "off": (
        "fuck off", "fuck you", "fuck yourself", "screw you", "go to hell", "shut up", "shut your mouth", "kill yourself", "drop dead", "eat shit", "piss off", "go die", "kys", "choke on it", "burn in hell", "son of a bitch", "piece of shit", "sack of shit",
        "halt die fresse", "halts maul", "halt s maul", "verpiss dich", "fick dich", "leck mich", "geh sterben", "fahr zur holle", "stuck scheisse", "bring dich um",
        "ferme ta gueule", "ta gueule", "va te faire", "nique ta mere", "casse toi", "va mourir", "va crever", "creve", "fils de pute", "espece de",
        "vete a la mierda", "que te jodan", "que te den", "callate", "chinga tu madre", "hijo de puta", "hija de puta", "pedazo de", "muerete", "vete al infierno",
        "vaffanculo", "vai a cagare", "chiudi il becco", "figlio di puttana", "pezzo di merda", "va all inferno", "muori", "va a morire", "faccia di merda",
        "vai tomar no cu", "vai se foder", "vai te foder", "cala a boca", "filho da puta", "pedaco de merda", "vai a merda", "vai para o inferno", "vai morrer",
        "hou je bek", "rot op", "val dood", "krijg de", "loop naar de hel", "stuk stront", "sterf", "krijg kanker",
        "hall kaften", "dra at helvete", "far at helvete", "javla idiot", "din javel", "stick och brinn", "ga och do",
        "zamknij sie", "spierdalaj", "wypierdalaj", "idz do diabla", "kawal gowna", "idz w cholere", "zamknij morde", "ty kurwo", "skurwysynu",
        "fogd be", "pofa be", "dogolj meg", "menj a picsaba", "menj a fenebe", "te rohadek", "kurva anyad", "bazd meg", "huzz el",
        "заткнись", "иди на", "пошел на", "пошел ты", "сдохни", "убеи себя", "кусок дерьма", "сукин сын", "иди к черту",
        "αντε γαμησου", "αντε και", "σκασε", "ψοφα", "στο διαολο", "αι στο", "κομματι σκατα", "γαμω τη",
    ),
    "sexact": (
        "suck each other", "sucking each other", "suck my", "sucked him", "sucked his", "went down on", "spread her legs", "spread your legs", "came all over", "came in her", "came inside", "rode him", "rode his", "inside her", "bent her over", "jerk off", "jerked off",
        "so wet", "legs apart", "on her knees", "took him in her mouth",
    ),
    "mild": ("this damn", "that damn", "damn it", "by definition", "what the hell", "bloody weather", "my dog", "the rooster", "no idiot", "not an idiot", "on stage", "on film"),
}
# Terms that stand for one another in counterfactual sentences, by language.
IDENTITIES = {
    "en": ("women", "men", "gay people", "old people", "disabled people", "immigrants", "foreigners", "refugees", "atheists", "believers", "muslims", "jews", "christians", "black people", "islanders", "those valley folk", "young people", "mountain people"),
    "de": ("frauen", "männer", "ausländer", "flüchtlinge", "juden", "muslime", "christen", "migranten", "schwule", "behinderte", "alte leute"),
    "fr": ("les femmes", "les hommes", "les étrangers", "les immigrés", "les réfugiés", "les juifs", "les musulmans", "les arabes", "les homosexuels", "les handicapés", "les vieux"),
    "es": ("las mujeres", "los hombres", "los extranjeros", "los inmigrantes", "los refugiados", "los judíos", "los musulmanes", "los gitanos", "los homosexuales", "los viejos"),
    "pt": ("as mulheres", "os homens", "os estrangeiros", "os imigrantes", "os refugiados", "os judeus", "os muçulmanos", "os ciganos", "os velhos"),
    "it": ("le donne", "gli uomini", "gli stranieri", "gli immigrati", "i rifugiati", "gli ebrei", "i musulmani", "gli zingari", "i vecchi"),
    "nl": ("vrouwen", "mannen", "buitenlanders", "vluchtelingen", "joden", "moslims", "homo's", "gehandicapten", "ouderen"),
    "sv": ("kvinnor", "män", "utlänningar", "flyktingar", "judar", "muslimer", "bögar", "invandrare", "gamla"),
    "hu": ("nők", "férfiak", "külföldiek", "menekültek", "zsidók", "muszlimok", "cigányok", "bevándorlók", "öregek"),
    "pl": ("kobiety", "mężczyźni", "obcokrajowcy", "uchodźcy", "żydzi", "muzułmanie", "cyganie", "imigranci", "starzy ludzie"),
    "ru": ("женщины", "мужчины", "иностранцы", "беженцы", "евреи", "мусульмане", "цыгане", "мигранты", "старики"),
    "el": ("γυναίκες", "άντρες", "ξένοι", "πρόσφυγες", "εβραίοι", "μουσουλμάνοι", "τσιγγάνοι", "μετανάστες", "γέροι"),
}
# Sentences of our own with labels, for forms a small sample may lack, above all allusions. {p}: a person, {g}: a group.
SEEDS = {
    "abusive": (
        "Sleep with one eye open, {p}.",
        
        "{p} was an accident that the parents still regret.", 
        "{p}, there is a grave with your name on it.", "A bullet would be wasted on {p}.", "I hope {p} gets hit by a bus.", "I hope the brakes fail on you, {p}.", "One day someone will find {p} in a ditch.", "Even a mirror would vomit at {p}.", "If brains were dynamite, {p} could not blow a nose.",
        "Too bad the doctors saved {p}.", "I wish you a slow and painful death, {p}.", "Keep talking, {p}, and you will lose your teeth.", "You are a waste of oxygen, {p}.", "Your parents must be ashamed of you, {p}.", "{p} has the face of a bulldog that swallowed a wasp.", "Go play on the motorway, {p}.", "Ich hoffe, du stirbst, {p}.", "J'espère que tu meurs, {p}.", "Espero que te mueras, {p}.", "The gene pool would be cleaner without {p}.",
        "{p}, you are an idiot.", "You idiot, {p}.", "You are all idiots and scumbags.", "{p} is an asshole.", "What an asshole {p} is.", "I will kill you, {p}.", "I am going to break your neck, {p}.",
        "Du bist ein Arschloch, {p}.", "{p}, du bist eine Schlampe.", "Tu es un connard, {p}.", "{p}, tu es une salope.", "Eres un cabrón, {p}.", "{p}, eres una puta.", "Sei uno stronzo, {p}.", "{p}, sei una merda.", "És um idiota, {p}.", "Você é um babaca, {p}.", "Je bent een klootzak, {p}.", "Du är en jävla idiot, {p}.", "Jesteś idiotą, {p}, ty kurwo.",
        "Te hülye barom, {p}.", "Ты идиот, {p}.", "Είσαι μαλάκας, {p}.",
    ),
    "hateful": (
        "The only good {g} are dead.",
        "What do you call {g} at the bottom of the sea? A good start.", "Go back where you came from, {g}.", "Open season on {g} starts today.", "{g} should be sent home or shot.", "Our town was clean before {g} came.", "{g} are not really human.", "{g} should not be allowed to have children.",
        "Keep {g} away from our daughters.", "Somebody should finish the job with {g}.", "The ovens are still warm for {g}.", "Gas all {g}.", "We do not serve {g} here, they smell.", "{g} are a plague on this country.", "No {g} no problem.", "{g} are criminals by blood.", "Hang all {g}.", "Lock up {g} and throw away the key.", "I cannot stand {g}, they are all thieves.",
        "Alle Juden sind Ungeziefer und müssen weg.", "Frauen gehören in den Käfig.", "Flüchtlinge sind Abschaum.", "Tous les étrangers sont des parasites.", "Dehors les arabes, ces ordures.", "Todos los inmigrantes son basura.", "Las mujeres son ratas, fuera todos.", "Tutti gli stranieri sono parassiti, fuori.", "Os imigrantes são todos lixo.", "Alle buitenlanders zijn ongedierte en moeten eruit.",
        "Alla utlänningar är ohyra, ut med dem.", "Wszyscy uchodźcy to robactwo.", "Minden menekült patkány.", "Все мигранты паразиты, вон.", "Όλοι οι ξένοι είναι παράσιτα, έξω.",
    ),
    "sexual": (
        "He fucked her on the kitchen table.", "She swallowed his cum.", "He licked her pussy until she screamed.", "I want to feel your cock inside me.", "Best sex of my life, she moaned and came twice.", "She took his dick in her mouth.", "Send me a photo of your tits.", "{p} watches porn and masturbates.", "He came inside her.", "They had sex naked on the floor, moaning.",
        "She gave him a handjob under the table.", "She sat on his face.", "She gives head for money.", "I am so horny, {p}, take off your clothes.", "Er hat sie auf dem Tisch gefickt.", "Ich will deine Titten sehen.", "Il l'a baisée et elle lui a sucé la bite.", "Quiero follar contigo y chupar tu polla.", "Voglio scopare con te e vedere le tue tette.", "Quero foder você e ver sua buceta.", "Ik wil je neuken en je tieten zien.",
        "Jag vill knulla dig och se dina bröst.", "Chcę cię pieprzyć, pokaż cycki.", "Meg akarlak dugni, mutasd a csöcsöd.", "Я хочу тебя трахнуть, покажи сиськи.", "Θέλω να σε γαμήσω, δείξε βυζιά.",
    ),
    "clean": (
        "{g} told the best jokes at the festival.", "{g} and {g} live in this town.", "The new law gives {g} the right to vote.", "We welcome {g} in our choir.", "{g} opened a bakery.", "{p} killed it at the comedy club.", "That joke killed me.", "I could kill for a coffee.", "I am dead tired.", "{p} shot a film about {g}.", "The cat caught a rat in the cellar.",
        "Nobody should call anyone an idiot.", "It is wrong to call {g} vermin.", "{p} was called a moron and reported it.", "My car is a useless piece of junk.", "This stupid computer has died again.", "The dog had a litter, said {p}, the proud bitch.", "A cock crowed at dawn.", "The chicken breast was dry.", "The nurse explained the penis and the vagina to the class.", "I hate rain.",
        "We hung the curtains.", "{p} hangs the picture.", "You are no fool.", "You are not stupid, just tired.", "Bloody cold today.",
        "Damn, I forgot the milk.", "What a day!", "{p}, you are a wonder and everybody knows it.", "Shut the window, please.", "Die alte Frau lacht.",
        "{g} bake bread.", "{g} sing in the street.", "I met {g} at the market.", "Our neighbours are {g}.", "Nobody should hate {g}.", "Hating {g} is wrong, said the mayor.", "{g} should be allowed to vote, wrote {p}.", "Why do {g} sing so well?", "All {g} are invited to the party.", "A story about {g} won the prize.",
        "Mon vieux chat dort.", "Las mujeres cantan.", "Le donne ridono.", "Die Frauen singen im Chor.", "Die Ausländer haben ein Fest.", "Les étrangers cuisinent bien.", "Les femmes lisent le journal.", "Los inmigrantes abrieron una panadería.", "Gli stranieri aprono un bar.",
        "As mulheres dançam.", "De vrouwen fietsen naar huis.", "Kvinnor och män dansar.", "Kobiety pieką chleb.", "A nők énekelnek.", "Женщины поют в хоре.", "Οι γυναίκες τραγουδούν.", "Du bist nett, {p}.", "Tu es gentil, {p}.", "Eres muy amable, {p}.", "Ich liebe Kuchen, {p}.", "Ich hoffe, du kommst bald.", "Ich will deine Katze sehen.", "Alle Kinder singen.", "Je mange du pain.", "J'espère que tu viens.", "Tous les enfants dansent.", "Quiero un café y ver tu casa.", "Espero que vengas.", "Todos los niños cantan.",
        "Voglio un gelato.", "Tutti i bambini ridono.", "Quero um café.", "Ik wil je huis zien.", "Alle kinderen lachen.", "Jag vill se din katt.", "Alla barn sjunger.", "Chcę kawę, pokaż mi dom.", "Wszyscy śpiewają.", "Meg akarlak hívni.", "Minden gyerek nevet.", "Я хочу кофе, покажи дом.", "Все дети поют.", "Θέλω έναν καφέ.", "Όλοι γελούν.",
        "Tu as raison, {p}.", "Jij bent lief, {p}.", "Hai ragione, {p}.", "Você tem razão, {p}.", "Du har rätt, {p}.", "Masz rację, {p}.", "Te kedves vagy, {p}.", "Ты прав, {p}.", "Έχεις δίκιο, {p}.",
    ),
}
# What is done to people and with what, put beside persons, groups and things alike, so that the categories and not the words are learnt.
HARM = ("shoot", "hang", "drown", "burn", "stab", "strangle", "kill", "murder", "poison", "bury", "gas")
MEANS = ("gallows", "bullet", "noose", "rope", "grave", "coffin", "gun", "knife", "poison", "gas")
for _act in HARM:
    SEEDS["hateful"] += (f"We should {_act} {{g}}.", f"{_act.capitalize()} all {{g}}.")
    SEEDS["abusive"] += (f"Somebody should {_act} {{p}}.", f"I will {_act} you.")
    SEEDS["clean"] += (f"It is wrong to {_act} anyone.", f"I could {_act} for a cup of tea.", f"I could {_act} a bowl of soup right now.")
for _tool in MEANS:
    SEEDS["hateful"] += (f"{{g}} deserve the {_tool}.", f"Get a {_tool} for {{g}}.")
    SEEDS["abusive"] += (f"{{p}} deserves the {_tool}.", f"A {_tool} would suit you.")
    SEEDS["clean"] += (f"The {_tool} in the play was made of paper.", f"{{p}} painted a {_tool} for the film.")
