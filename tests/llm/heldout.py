"""Texts to measure with. Their author wrote the lists and rules too.

TOXIC was written just before the lists of problem 5, and wording of it got into them, so its figure is too good. FRESH was
written after the lists were finished and measured once; nothing was changed after it. SENTENCES was written after the rules
of problem 9, and nothing was changed after it. None of them is to be added to lists or rules.
"""

# (text, categories that occur); half of the sentences of each kind are harmless uses of the same words
TOXIC = [
    ("You're such a pathetic loser, nobody on this team can stand you.", "abusive"),
    ("Are you deaf or just stupid, you useless fool?", "abusive"),
    ("Get lost, you miserable little rat.", "abusive"),
    ("If you show up here again I will smash your face in.", "abusive"),
    ("I know where you live and I'm going to hurt you.", "abusive"),
    ("Her brother is a dumb, lazy bastard and a crook.", "abusive"),
    ("Drop dead, Kevin, you worthless piece of garbage.", "abusive"),
    ("I hope she dies slowly.", "abusive"),
    ("Du bist so ein dummer Trottel, geh mir aus den Augen.", "abusive"),
    ("Verpiss dich, du Arsch.", "abusive"),
    ("Ich mach dich fertig, du Feigling.", "abusive"),
    ("Tu es vraiment un abruti, dégage d'ici.", "abusive"),
    ("Ta gueule, espèce d'idiote.", "abusive"),
    ("Eres un estúpido y un cobarde, lárgate.", "abusive"),
    ("Te voy a romper la cara, hijo de puta.", "abusive"),
    ("Você é um idiota inútil, some daqui.", "abusive"),
    ("Vou te quebrar a cara, seu covarde.", "abusive"),
    ("Sei un cretino e un vigliacco.", "abusive"),
    ("Jij bent een domme sukkel, rot op.", "abusive"),
    ("Ты тупой дурак, пошёл вон.", "abusive"),
    ("Immigrants are nothing but rats and they should all be deported.", "hateful"),
    ("Those people are animals, they don't deserve to live here.", "hateful"),
    ("Gays are a disease and must be wiped out.", "hateful"),
    ("All women are inferior and should obey men.", "hateful"),
    ("Jews control everything, exterminate them.", "hateful"),
    ("We must get rid of every last Muslim in this town.", "hateful"),
    ("Refugees are scum, send them all back.", "hateful"),
    ("The Brakki are savages and thieves, the whole lot of them.", "hateful"),
    ("Alle Ausländer sind Dreck und gehören abgeschoben.", "hateful"),
    ("Flüchtlinge sind Parasiten, raus mit ihnen.", "hateful"),
    ("Les immigrés sont des rats, il faut les expulser.", "hateful"),
    ("Ces gens-là sont des sauvages, dehors.", "hateful"),
    ("Los inmigrantes son una plaga, hay que eliminarlos.", "hateful"),
    ("Todas las mujeres son inferiores.", "hateful"),
    ("Os estrangeiros são lixo, deviam ser expulsos.", "hateful"),
    ("Gli zingari sono ladri e parassiti, cacciamoli via.", "hateful"),
    ("Alle buitenlanders zijn ongedierte en moeten weg.", "hateful"),
    ("Все мигранты грязь, гнать их надо.", "hateful"),
    ("She unbuttoned his trousers and took him in her mouth.", "sexual"),
    ("He was fucking her against the wall while she screamed for more.", "sexual"),
    ("They had wild sex on the kitchen floor.", "sexual"),
    ("Watch the hottest porn videos with naked girls for free.", "sexual"),
    ("She was touching herself and moaning louder and louder.", "sexual"),
    ("I want to lick you all over until you come.", "sexual"),
    ("He masturbated while looking at her nude photos.", "sexual"),
    ("Her nipples were hard as he squeezed her tits.", "sexual"),
    ("Sie zog sich nackt aus und sie fickten die ganze Nacht.", "sexual"),
    ("Er leckte ihre Brüste, bis sie stöhnte.", "sexual"),
    ("Ils ont fait l'amour nus toute la nuit, elle gémissait.", "sexual"),
    ("Elle lui a envoyé des photos nues, il était tout excité.", "sexual"),
    ("Follaron toda la noche, ella gemía desnuda.", "sexual"),
    ("Me mandó un vídeo porno y fotos desnuda.", "sexual"),
    ("Eles transaram a noite toda, ela gemia nua na cama.", "sexual"),
    ("Hanno scopato tutta la notte, lei gemeva nuda.", "sexual"),
    ("Ze neukten de hele nacht en zij kreunde.", "sexual"),
    ("Они трахались всю ночь, она стонала голая.", "sexual"),
    ("You fool, you have no idea how ugly and stupid you sound.", "abusive"),
    ("That lying coward is a disgrace, and a traitor too.", "abusive"),
    ("Foreigners are filth and do not belong in our country.", "hateful"),
    ("Burn down their mosques, every one of them.", "hateful"),
    # harmless
    ("The exterminator said cockroaches and vermin are pests, all of them.", ""),
    ("Rats are animals that live in sewers, and they spread disease.", ""),
    ("The parasites in the river are harmless to people.", ""),
    ("He was called an idiot at school and never forgot it.", ""),
    ("It is wrong to call refugees parasites, the minister said.", ""),
    ("Calling immigrants vermin is hate speech, the court found.", ""),
    ("The novel is about a coward who becomes a hero.", ""),
    ("My dog is a stupid but lovely animal.", ""),
    ("The pig in the children's book is called Olivia.", ""),
    ("They threw the trash out and cleaned the filthy kitchen.", ""),
    ("The clown at the circus made everyone laugh.", ""),
    ("Sex education classes begin in the seventh grade.", ""),
    ("The sex of the puppies is not known yet.", ""),
    ("A breast cancer screening takes about ten minutes.", ""),
    ("The painting shows a naked woman on a rock.", ""),
    ("You can see the comet with the naked eye.", ""),
    ("Women were not allowed to vote until 1971.", ""),
    ("Many immigrants were deported last year, according to the report.", ""),
    ("The refugees were driven out of their homes by the flood.", ""),
    ("The museum had to burn every copy of the forged print.", ""),
    ("You must be careful, or the machine will break your fingers.", ""),
    ("I will find you a better seat near the window.", ""),
    ("Killing weeds is easy if you pull them out early.", ""),
    ("The team was beaten, and fans went home disappointed.", ""),
    ("The comedian told a story about a man who shouted that she was a liar.", ""),
    ("Er nannte ihn einen Idioten, und das tat ihm später leid.", ""),
    ("Ratten und Kakerlaken sind Ungeziefer, sagt der Kammerjäger.", ""),
    ("Die Klinik bietet Beratung zur sexuellen Gesundheit an.", ""),
    ("Der Müll wird am Freitag abgeholt, auch der Dreck aus dem Keller.", ""),
    ("Les cafards sont des insectes très résistants.", ""),
    ("Il a traité son voisin d'imbécile, puis il s'est excusé.", ""),
    ("Le cancer du sein se soigne mieux quand il est détecté tôt.", ""),
    ("Las ratas son animales muy inteligentes.", ""),
    ("Saca la basura antes de las ocho.", ""),
    ("La educación sexual empieza en la escuela.", ""),
    ("As baratas são insetos comuns na cozinha.", ""),
    ("O lixo é recolhido às terças.", ""),
    ("I parassiti del grano sono un problema per i contadini.", ""),
    ("De arts sprak over seksuele gezondheid.", ""),
    ("Паразиты в воде опасны для рыб, сказал биолог.", ""),
    ("Это книга о дураке, который стал царём.", ""),
    ("Nobody deserves to be called garbage, least of all by a teacher.", ""),
    ("We had to get rid of all the old furniture.", ""),
    ("The wasps must be wiped out before the festival, the gardener said.", ""),
    ("She moaned about the weather all day.", ""),
    ("The puppy licked her hand and fell asleep.", ""),
    ("He undressed and went straight to bed after the long shift.", ""),
    ("The lawyer asked whether the witness was a liar.", ""),
    ("Shut the door, you are letting the heat out.", ""),
    ("The burn on his arm healed within a week.", ""),
]

# (languages, text with a bar where a sentence ends)
SENTENCES = [
    (("en",), "Mrs. Dalloway said she would buy the flowers herself.| Gen. Ross agreed."),
    (("en",), "The meeting starts at 9 a.m. on Monday.| Bring your own lunch."),
    (("en",), "Version 2.0.1 fixes the bug.| See pp. 12-15 for details."),
    (("en",), "Is it over?| Yes!| At last..."),
    (("en",), "She works for Gates Bros. Ltd. in Leeds.| They sell tea."),
    (("en",), "“I can't,” he said, “not today.”| Then he hung up."),
    (("en",), "He lives in Washington, D.C. with two cats.| Both are grey."),
    (("en",), "The U.S. Navy sent help.| Nobody answered."),
    (("en",), "Visit example.com/docs.html or write to a.b@c.org.| Thanks!"),
    (("en",), "It rose by 3.5 percent (see Fig. 4).| That is a lot."),
    (("de",), "Das Gesetz gilt ab dem 1. Januar 2020.| Es wurde lange beraten."),
    (("de",), "Er wohnt in der Hauptstr. 12, d. h. in der Stadt.| Dort ist es laut."),
    (("de",), "„Kommst du mit?“, fragte sie.| Er nickte."),
    (("de",), "Die Firma hat ca. 300 Mitarbeiter, z. B. in Köln.| Sie wächst."),
    (("fr",), "M. Dupont habite au 5 bd. Voltaire.| Il est médecin."),
    (("fr",), "Quelle heure est-il ?| Il est tard !| Rentrons."),
    (("fr",), "Cela coûte 3,50 € env. dans ce magasin.| C'est cher."),
    (("es",), "El Sr. López llegó a las 5 p. m. del lunes.| Nadie lo vio."),
    (("es",), "¿Dónde estás?| ¡Ven ya!| Te espero."),
    (("pt",), "A Dra. Lima mora na Av. Brasil.| Ela trabalha muito."),
    (("it",), "Il Dott. Rossi abita in v. Roma 3.| È tardi."),
    (("nl",), "Dhr. Jansen woont in de Kerkstr. 8.| Hij is ziek."),
    (("ru",), "Он родился в 1970 г. в Москве.| Потом уехал в С. Петербург."),
    (("ru",), "«Куда идём?» — спросил он.| Она молчала."),
    (("zh",), "你好！|今天天气很好。|我们去公园吧？|好的。"),
    (("ja",), "今日は雨です。|明日は晴れますか？|はい。"),
    (("hi",), "यह किताब अच्छी है।| क्या तुमने पढ़ी?| हाँ।"),
    (("ar",), "هل وصلت الرسالة؟| نعم، وصلت أمس.| شكراً."),
]

# written after the lists of problem 5 were finished
FRESH = [
    ("What a dimwit you are, Karen, go jump off a bridge.", "abusive"),
    ("You disgust me, you filthy liar.", "abusive"),
    ("One more word and I'll knock your teeth out.", "abusive"),
    ("He is a spineless weasel and a thief.", "abusive"),
    ("Shut up, idiot.", "abusive"),
    ("I swear I will burn your house down with you in it.", "abusive"),
    ("Your mother should have drowned you at birth.", "abusive"),
    ("Du dreckige Schlampe, halt dein Maul.", "abusive"),
    ("Dieser Vollpfosten ist zu blöd zum Atmen.", "abusive"),
    ("Espèce de gros porc, tu me dégoûtes.", "abusive"),
    ("Vete al infierno, imbécil.", "abusive"),
    ("Seu merda, vai tomar no cu.", "abusive"),
    ("Sei uno schifoso bastardo.", "abusive"),
    ("Закрой рот, тупая скотина.", "abusive"),
    ("Muslims are all terrorists and must be thrown out of the country.", "hateful"),
    ("Black people are not human, they are apes.", "hateful"),
    ("Hitler should have finished the job with the Jews.", "hateful"),
    ("Women are too emotional to be trusted with anything.", "hateful"),
    ("The Drovians are a plague, wipe them out.", "hateful"),
    ("Disabled people are a burden and should be put down.", "hateful"),
    ("Ausländer raus, das ist unser Land.", "hateful"),
    ("Les juifs sont des parasites.", "hateful"),
    ("Los gitanos son todos ladrones, fuera de aquí.", "hateful"),
    ("Os imigrantes são animais e devem ser expulsos.", "hateful"),
    ("Kill all the gays.", "hateful"),
    ("She rode him until they both came.", "sexual"),
    ("He slid his hand under her panties and rubbed her.", "sexual"),
    ("Hot naked teens on webcam, click here.", "sexual"),
    ("They fucked in the shower.", "sexual"),
    ("Sie blies ihm einen im Auto.", "sexual"),
    ("Elle le suçait pendant qu'il la caressait nue.", "sexual"),
    ("Se la folló en el sofá.", "sexual"),
    ("The idiot in Dostoevsky's novel is a prince.", ""),
    ("He felt like a fool after losing the keys.", ""),
    ("The court heard that the man had threatened to kill his neighbour.", ""),
    ("The plague killed a third of the people in Europe.", ""),
    ("Women should be paid the same as men.", ""),
    ("Immigrants opened three shops on our street.", ""),
    ("The vaccine could wipe out the disease within a decade.", ""),
    ("Nurses washed the naked patient carefully.", ""),
    ("The statue of a nude woman was moved to the park.", ""),
    ("The survey asked how often couples have sex.", ""),
    ("Dogs are animals, and so are cats.", ""),
    ("Der Film handelt von einem Feigling.", ""),
    ("Las mujeres son mayoría en la universidad.", ""),
    ("Le cochon est un animal propre.", ""),
    ("The gardener said all rats in the shed must be killed.", ""),
    ("You must be stupid tired after that run.", ""),
    ("Hanging pictures is harder than it looks.", ""),
    ("The bastard sword is a medieval weapon.", ""),
]
