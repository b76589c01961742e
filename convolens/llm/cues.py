"""Cues of abusive, hateful and sexual content by class, made of words and rules.

``{a|b}`` stands for either, so that a phrase is a rule for many; phrases are parted by commas. They are written plainly, for
folding makes spellings alike. The languages are those of the data that are written with spaces and mark no letters only.
"""

from __future__ import annotations

import re

# The classes of cues, by category, each with a weight. Of one class the heaviest cue of a place counts, of
# insults the two heaviest.
CUES = {
    "abusive": [
        ("insult", 0.7, """idiot{|s|a|e|en|in|as|os}, idioot, idiote, moron{|s}, imbecile, imbécil{|es}, imbecil, imbecis, imbecille, imbecilli, bastard{|s|o|i|a}, bâtard, asshole{|s}, arsehole, scumbag{|s}, dickhead,
            jerk, wanker, bitch, dumbass, fool, half-wit, scum, garbage, trottel, depp, dummkopf, arschloch, arsch, drecksack, drecksau, miststück, wichser, hurensohn, dreckskerl, vollidiot{|en},
            crétin{|e|s}, abruti{|e|s}, connard{|s|e}, salaud{|s}, salope, ordure, débile, gilipollas, estúpid{o|a|os|as}, cabrón, cabrona, pendejo, capullo, hijo de puta, estúpid{o|a},
            otári{o|a}, babaca, cretin{o|a|i}, stronz{o|a|i}, coglione, deficiente, stupid{o|a|i}, sukkel, klootzak, eikel, kutwijf, debiel, идиот{|ка|ы}, дурак, дура, дураки, кретин,
            ублюдок, ублюдки, сволочь, мразь, мерзав{ец|ка}, тварь, скотина, придурок, дебил"""),
        ("insult", 0.45, """pig, clown, liar, trash, coward{|s}, loser{|s}, rat, crook, traitor, disgrace, slob, creep, freak, worm, piece of {garbage|trash|shit|dirt}, schwein, feigling, lügner{|in}, verräter,
            versager, abschaum, cochon, porc, lâche, menteu{r|se}, traître, ordures, pauvre type, cerd{o|a}, cobarde{|s}, mentiros{o|a|os|as}, traidor{|a}, basura, lixo, porc{o|a}, covarde{|s},
            bugiard{o|a|i}, vigliacc{o|a|hi}, traditore, verme, leugenaar, lafaard, verrader, varken, трус, лжец, врун, подлец, свинья, предатель"""),
        ("scorn", 0.35, """filthy, pathetic, worthless, disgusting, lying, stupid, useless, miserable, dumb, lazy, ugly, good-for-nothing, brainless, spineless, dumm{e|er|es}, erbärmlich{e|er|es}, elend{e|er|es},
            nutzlos{e|er|es}, feige{|r}, widerlich{e|er|es}, faul{e|er|es}, minable, pauvre, stupide, inútil, inúteis, pedazo de, trozo de, espèce de, asqueros{o|a}, patétic{o|a},
            nojent{o|a}, ridícul{o|a}, inutile, schifos{o|a}, patetic{o|a}, schifo, domme, lelijke, walgelijke, zielige, waardeloze, жалк{ий|ая|ие}, туп{ой|ая|ые}, ничтожный, гнусный, мерзк{ий|ая}"""),
        ("silence", 0.7, """shut {your|the fuck|the hell} {mouth|up|trap|face}, shut up you, shut it you, {go|and} rot, go and rot, go to hell, rot in hell, drop dead, get lost, piss off, {fuck|screw} you, fuck off,
            {halt|halte} {die|deine|dein|den} {fresse|klappe|maul|mund}, verpiss dich, hau ab du, geh mir aus den augen, {ferme|fermez} {ta|la|vos} {gueule|gueules}, ta gueule, tais toi,
            dégage, va te faire, {cállate|callate|cierra la boca|cierra el pico}, lárgate, vete a la mierda, {cala|cale|cala a} {a boca|boca}, some daqui, vai se foder,
            {chiudi|chiudete} {il|la} {becco|bocca}, taci, vattene, vaffanculo, hou {je|jullie} {bek|mond|kop}, rot op, {заткнись|заткнитесь|закрой рот}, {пошёл|пошел|пошла} {вон|к черту|к чёрту},
            проваливай, иди к черту"""),
        ("pursuit", 0.6, """i {will|ll|am going to|m going to|m gonna} {find|get|hunt} you, i know where you live, watch your back, you will {pay|regret|be sorry}, you ll {pay|regret|be sorry}, ich {finde|kriege} dich,
            ich weiß wo du wohnst, je {vais te retrouver|sais où tu habites}, {sé|se} dónde vives, te voy a encontrar, sei onde {você mora|moras}, vou te {achar|encontrar}, {ti troverò|so dove abiti},
            ik {weet waar je woont|vind je}, я {найду тебя|тебя найду|знаю где ты живешь}"""),
        ("blow", 0.6, """{break|smash|crush|punch|kick|cut|bash|rip|slash} {your|you in the|off your|out your|in your} {face|jaw|legs|bones|neck|skull|head|teeth|nose|throat|arms|fingers}, break your, smash your,
            {zerschlage|breche|poliere|schlage} {dir|deine|dich}, mach dich fertig, schlag dich {tot|zusammen}, {casser|péter|défoncer|éclater} la {gueule|tête|figure},
            {romper|partir|reventar} la {cara|boca|cabeza}, {quebrar|partir|arrebentar} {a|tua|sua} {cara|boca}, {spaccare|spacco|rompo} la {faccia|testa}, sla je {in elkaar|dood},
            {набью|разобью} {морду|тебе}, сломаю тебе"""),
        ("kill", 1.0, """{i {will|ll|am going to|m going to|m gonna|want to} {kill|murder|strangle|stab|shoot|hurt|destroy|beat} you}, {ich bringe dich um}, {ich töte dich}, {ich mach dich {kalt|fertig}},
            {je vais te {tuer|buter|crever}}, {te voy a {matar|romper|reventar}}, {vou te {matar|quebrar}}, {ti {ammazzo|uccido|spacco}}, {ik maak je {dood|af}}, {я {тебя убью|убью тебя}},
            {kill yourself}, {bring dich um}"""),
        ("wish", 1.0, """{hope|wish} {he|she|you|they} {chokes|choke|dies|die|rots|rot|suffers|suffer|burns|burn|bleeds|drowns|drown|crashes},
            {i hope|i wish} {he|she|you|they} {would|get|gets} {die|cancer|killed|hurt}, hoffentlich {stirbst|krepierst|erstickst} du, {stirb|krepier}, crève, ojalá te {mueras|pudras},
            tomara que {morra|morras}, {spero che {muoia|crepi|tu muoia}}, {чтоб ты {сдох|подох}}, {сдохни}"""),
        ("shunned", 0.4, """nobody {wants|likes|needs|loves} you, nobody {on|in} this {team|town|house} can stand you, you are nothing, can t stand you, everybody hates you, niemand {will|mag|braucht} dich,
            personne ne t aime, nadie te quiere, ninguém {gosta de você|te quer}, nessuno ti vuole, никто тебя"""),
    ],
    "hateful": [
        ("dehuman", 0.6, """vermin, rats, cockroaches, parasites, leeches, savages, maggots, barbarians, subhuman{|s}, scum, filth, plague, parasite{n|s}, ungeziefer, ratten, kakerlaken, abschaum,
            untermensch{|en}, dreck, wilde, bestien, pack, gesindel, vermine, cafards, sauvages, racaille, sous-hommes, parásit{os|as}, alimañas, cucarachas, ratas, escoria, plaga, salvajes,
            vermes, baratas, ratos, escória, praga, selvagens, lixo, parassiti, scarafaggi, ratti, feccia, selvaggi, ongedierte, parasieten, kakkerlakken, uitschot, tuig, паразит{|ы|ов},
            тараканы, крысы, недочеловеки, отребье, грязь, нечисть, дикари, сброд"""),
        ("dehuman", 0.8, """subhuman{|s}, untermensch{|en}, abschaum, sous-hommes, escoria, escória, feccia, uitschot, недочеловеки, отребье, racaille"""),
        ("lesser", 0.45, """animals, insects, beasts, disease, cancer, thieves, criminals, garbage, trash, dirt, tiere, diebe, verbrecher, müll, seuche, animaux, voleurs, criminels, ordures, maladie, animales, ladrones, criminales,
            basura, animais, ladrões, criminosos, doença, animali, ladri, criminali, spazzatura, dieven, beesten, criminelen, животные, воры, преступники, мусор, зараза, only {steal|lie|cheat|take},
            {they|who} {all|always|only} {steal|lie|cheat}"""),
        ("inferior", 0.5, """too {stupid|dumb|lazy|weak} to {vote|think|work|learn|lead|drive|rule|read|govern|understand}, {is|are|being} inferior, inferior {to|race|people}, should obey {men|us|their husbands|whites},
            never trust {a|an|any|those|these}, {can|could} never be trusted, minderwertig{|e|er}, inférieur{es|s}, inferior{es}, inferiori, inferieur, minderwaardig, неполноценн{ые|ая|ый},
            zu {dumm|blöd|faul} {zum|um|für}, trop {bêtes|stupides} pour, demasiado {tontos|tontas|estúpidas} para, {burros|burras} demais para, не люди, non sono umani, geen mensen, keine menschen,
            not {even |really |}human, less than human"""),
        ("kitchen", 0.6, """belong{|s} in the kitchen, gehör{en|t} in die küche, à la cuisine les femmes, a la cocina las mujeres, lugar de mulher é na cozinha, horen in de keuken, место на кухне"""),
        ("arson", 0.75, """{burn|torch|set fire to|burn down} {every|all|their|all their|the} {house|houses|home|homes|church|churches|mosque|mosques|synagogue|synagogues|temple|temples|shop|shops|village|villages}"""),
        ("expel", 0.55, """{should|must|ought to|need to|have to} {|all }be {deported|expelled|driven out|thrown out|kicked out|banned|removed|locked up}, {should|must} {leave|get out of} our,
            {send|ship|throw|kick|drive|chase|hunt} them {|all }{back|out|away|down|home}, {keep|drive|throw|kick} them {out|away}, go back to {where {you|they} came from|{your|their} {own |}country},
            {don t|do not|doesn t} belong {here|in our {country|town|city|street|schools}}, don t deserve to {live|exist|be here}, away from our {children|kids|women|girls|schools|streets|town|country},
            out of our {country|town|city|schools}, {gehör{en|t}|müssen|sollen|sollten} {|alle }{abgeschoben|vertrieben|raus|verschwinden|weg|ausgewiesen}, müssen aus, raus mit {ihnen|denen|dem pack},
            ausländer raus, {les|les faire} {expulser|chasser|virer}, {on|l on} les {chasse|expulse|vire}, {dehors|renvoyez} {les|tous}, sont des {sauvages|voleurs|rats} dehors,
            {echarlos|expulsarlos|expulsá los|sacarlos|echarlas|expulsarlas|que se vayan}, fuera {de {aquí|nuestro país|nuestra tierra}|todos ellos},
            {devem|deviam|deveriam|têm que} ser {expuls{os|as}|deportad{os|as}|banid{os|as}}, fora {daqui|do nosso país|da nossa terra}, {expulsem|mandem} {todos|os},
            {cacciamoli|cacciateli|mandiamoli|buttiamoli} {via|fuori|a casa}, {moeten|horen} {|allemaal }{weg|eruit|het land uit|opgesloten}, {гнать|выгнать|вышвырнуть|выслать} {их|всех},
            вон {из|отсюда}"""),
        ("destroy", 0.6, """{should|must|ought to|deserve to|need to|have to} {|all }{be |}{wiped out|exterminated|eliminated|gassed|shot|hanged|killed|burned|sterilized|eradicated|destroyed|die},
            {exterminate|kill|gas|shoot|hang|burn|eliminate|eradicate|wipe out|get rid of} {them|all of them|them all|every last|all these|all those|all the|these|those}, gas them all,
            {vergasen|ausrotten|aufhängen|ausmerzen|auslöschen}, {il faut {tous |}les {tuer|exterminer|éliminer|brûler|pendre}}, {exterminarlos|eliminarlos|matarlos|quemarlos|exterminarlas},
            {exterminar|eliminar|matar|queimar} {todos|esses|essa gente}, {sterminarli|eliminarli|ammazzarli|bruciarli}, {uitroeien|afmaken|vergassen},
            {уничтожить|истребить|перебить|сжечь|убивать} {их|всех}"""),
    ],
    "sexual": [
        ("act", 1.0, """fuck{ing|ed|s}, {her|him|me|us|them} {hard|senseless}, blowjob{|s}, handjob, masturbat{e|es|ed|ing}, ejaculat{e|ed|ing}, orgasm{|s}, cumshot, gangbang,
            {in|into} {her|his|my} mouth and {sucked|swallowed}, {took|take|taking|takes|put} {him|it|his cock|her} in {her|his|my} mouth, {suck{ed|ing|s|} {his|my|your} {cock|dick}},
            {fick{en|te|ten|t|e}|gefickt}, gevögelt, {vögel{n|te|ten}}, wichs{en|te}, {ils ont baisé|ont baisé|baisé|baiser {toute|avec}}, sodomie, branl{er|ait}, {follar{on|se|}|follando},
            {corrid{a|o} en la cara}, {transa{ram|ndo|r|mos|va}}, {fod{eram|endo|eu}}, punheta, {scopa{to|ta|re|vano|ndo}}, pompino, {neuk{en|te|ten|t}|geneukt}, pijpen,
            {трах{ались|аться}}, {минет}, {дрочи{ть|л|т}}, {кончил{|а} {в|на} {неё|нее|рот}}"""),
        ("act", 0.7, "трах{ал|нул|ает|ала}, foder"),
        ("sex", 0.6, """{had|have|having|has} {|wild |hot |rough |great |oral |anal }sex, {wild|hot|rough|oral|anal|steamy} sex, made love {to|all|until}, sex {until|all night|on the},
            {hatten|haben|gehabt} {|wilden }sex, liebe {gemacht|die ganze nacht}, {fait|faire|faisaient} l amour, {tuvieron|tener|tuvimos|tenían} {sexo|relaciones}, hicieron el amor,
            {fizeram|fazer|tiveram|faziam} {sexo|amor}, {hanno fatto|fatto|facevano} {sesso|l amore}, {hadden|hebben} {|wilde }seks, {был|была|было|занимались|занимался|занялись} {|диким }{секс|сексом},
            занимались любовью"""),
        ("naked", 0.4, """naked, nude, topless, nackt{|e|en}, nu, nue, nus, nues, desnud{o|a|os|as}, nu{a|as}, pelad{o|a}, nud{o|a|i}, naakt{|e}, гол{ая|ый|ые}, обнажённ{ая|ые}, обнаженн{ая|ые}"""),
        ("undress", 0.4, """undress{ed|es|ing}, stripp{ed|ing}, {takes|took|taking|take|ripped|tore} {off |}{her|his|my|your|their} {clothes|bra|panties|shirt|trousers|pants|underwear}{| off},
            {unbuttoned|unzipped|pulled down} {her|his|my} {trousers|pants|jeans|shirt|blouse|skirt|panties}, zog {sich|sie|ihn} aus, ausgezogen, déshabill{é|ée|a|ait}, {desnudó|desnudaron},
            {tirou|despiu} {a roupa|se}, spogli{ò|ata|ato|arono}, kleedde {zich|haar} uit, {разделась|раздел её|раздевал}"""),
        ("touch", 0.5, """lick{ed|ing|s|} {her|him|me|you|his|your|my}{| all over}, {touch{ing|ed|es}|rubb{ing|ed}|finger{ing|ed}} {herself|himself|myself|yourself},
            {squeez{ed|ing|es}|caress{ed|ing}|fondl{ed|ing}|grop{ed|ing}|suck{ed|ing}|strok{ed|ing}} {her|his|my|your}, leckte {ihre|seine|sie|ihn}, {léch{a|ait|é}|caress{a|ait}} {ses|sa|son|les},
            {lamió|lamía|chupó|chupaba|acarici{ó|aba}}, {lambeu|lambia|chupou|chupava}, {leccò|leccava|leccato}, likte {haar|zijn}, {лизал|ласкал} {её|ее|его}"""),
        ("moan", 0.5, """moan{ed|ing|s}, {groan{ed|ing} with pleasure}, {scream{ed|ing} for more}, {until|when|make|made} {you|she|he|me|her|him} {come|came|cum}, climax{ed|ing}, {stöhn{te|ten|en|t}},
            {gémi{ssait|t|r|ssaient}}, {gem{ía|ían|ir|ía de|ia|iam|endo}}, gemev{a|ano}, kreun{de|en|t}, {стон{ала|ал|ет|али}}, {cumming}"""),
        ("lust", 0.7, """horny, turned on by {her|his}, geil, aufgegeilt, bandant, {excité|excitée} {par|de|et}, tout excité, cachond{o|a}, tesão, tesud{o|a}, arrapat{o|a}, eccitat{o|a} {da|dal}, kinky,
            opgewonden van, возбуд{ился|илась} от"""),
        ("body", 0.45, """tits, nipples, cock, pussy, dick, clit, boobs, crotch, {hard|wet} {cock|pussy|for {him|her|me}}, {her|his|naked|bare} {breasts|ass|thighs}, titten, brüste, möse, schwanz, seins, nichons,
            chatte mouillée, tetas, polla, coño, pezones, peitos, buceta, pau duro, mamilos, tette, capezzoli, figa, cazzo, tieten, tepels, kut, сиськи, соски, {грудь {голую|обнаженную}}"""),
        ("media", 0.6, """porn, porno, pornos, pornô, порно, nudes, {sex|nude|naked|porn} {tape|tapes|pics}, {nude|naked} {photos|pictures|selfies|pics}, nacktfotos, nacktbilder, photos {de nu|nues|de cul},
            {fotos|vídeos|videos} {desnuda|desnudas|pelada|nua|porno}, foto {nude|di nudo}, naaktfoto{|s}, голые фото"""),
        ("media", 0.9, """porn{|o} {clip|clips|video|videos|vídeo|film|films|movie|movies|scene|scenes|pics}, {vídeo|video|film|filme|clip} porno{|grafico}, porno{video|film|clip|filme}{|s}, порно{видео|ролик|фильм}"""),
        ("lure", 0.4, """send me {your|a|some|more}, show me {your|everything}, {want|love|d love} to {see|lick|touch|taste|feel|do} {everything|you|your|it to you}, {shows|show|see} everything, in close up,
            {schick|zeig} mir deine, envoie moi {tes|une}, {mándame|enséñame} tus, {manda|mostra} {me |}{tuas|suas}, mandami le tue, stuur me je, пришли {мне|свои}, for free, watch the hottest"""),
    ],
}
#: What counts only beside a cue: where it must stand (around it in the sentence, up to 45 characters before or after, before,
#: or just before it), its weight, and its words.
CONTEXT = {
    "abusive": [
        ("near", 0.3, """you, your, yourself, u, du, dich, dein, deine, tu, toi, te, vous, vos, eres, tú, você, teu, seu, sua, tua, sei, ti, jij, je, jou, ты, тебя, тебе, твой, твоя, вы"""),
        ("before", 0.2, """{is|was|s|are|am} {a|an|such a|just a|nothing but a|the}, {he|she|they|you|that|it} {is|are}, {bist|ist|seid|sind} {ein|eine|so ein|so eine|nur ein|der|die},
            {est|es|êtes} {un|une|vraiment un|qu un}, {es|eres|son} {un|una|unos}, {é|és|são} {um|uma|uns}, {è|sei|sono} {un|una|dei}, {is|bent|zijn} {een}, that, this, such"""),
    ],
    "hateful": [
        ("around", 0.5, """{im|e|}migrant{|s|en}, refugee{|s}, foreigner{|s}, muslim{|s|e|en|i}, islamist{|s}, mosque{|s}, jew{|s}, synagogue{|s}, christian{|s}, hindu{|s}, sikh{|s}, arab{|s|er|i}, gypsy, gypsies,
            roma, black people, blacks, whites, asians, africans, mexicans, gays, gay, lesbians, homosexuals, transgender, trans, women, women, girls, woman, disabled, cripples, foreign, minorit{y|ies},
            atheists, pagans, ausländer{|n}, flüchtling{e|en}, migrant{en|innen}, moslems, muslime{|n}, juden, frauen, schwule{|n}, lesben, zigeuner, schwarze{|n}, behinderte{|n}, türken, araber,
            moschee{|n}, immigrés, étrangers, réfugiés, musulmans, juifs, arabes, femmes, noirs, gitans, homosexuels, pédés, handicapés, mosquées, inmigrantes, extranjeros, refugiados, musulmanes,
            judíos, mujeres, negros, gitanos, homosexuales, maricones, moros, imigrantes, estrangeiros, muçulmanos, judeus, mulheres, ciganos, homossexuais, deficientes, immigrati, stranieri, profughi,
            musulmani, ebrei, donne, neri, zingari, omosessuali, buitenlanders, vluchtelingen, moslims, joden, vrouwen, zigeuners, homo s, мигранты, мигрантов, иностранцы, беженцы, мусульмане, евреи,
            женщины, цыгане, геи, черные, чёрные"""),
        ("before", 0.3, """{all|every|such|most} {|of {them|these|those}}, the whole lot, women like, men like, people like, those people, these people, {alle|diese|solche|jene}, {tous|toutes} {les|ces},
            ces gens, ces, {todos|todas} {los|las|os|as|esos|estos}, esos, estos, essa gente, esses, {tutti|tutte} {i|gli|le|questi}, questi, {alle|die|deze|al die}, {все|эти|всех|этих}"""),
        ("just before", 0.2, """{are|is} {|all |just |nothing but |only |like |a |no better than }, {sind|ist|seien} {|alle |nur |ein |eine }, {sont|est} {|des |de la |tous des |une }, {son|es} {|una |unas |unos |todos },
            {são|é} {|uma |uns |todos }, {sono|è} {|una |tutti }, {zijn|is} {|allemaal |een }, those, these, diese, ces, esos, essa, those damned"""),
        ("around", 0.3, """we {should|must|have to|need to|ought to}, let {s|us}, {wir {sollten|müssen}}, il faut, on devrait, {hay que}, deberíamos, {temos que|devemos}, dobbiamo, bisogna, {we moeten},
            {надо|пора|нужно}, {whole lot of them}, {every one of them}, {every last one}"""),
    ],
    "sexual": [
        ("around", 0.2, """{her|his|their} {bed|body|lips|skin}, in bed, on the bed, all night, until dawn, die ganze nacht, bis zum morgen, im bett, toute la nuit, jusqu au matin, au lit, toda la noche,
            hasta el amanecer, en la cama, a noite toda, na cama, até de manhã, tutta la notte, a letto, hele nacht, всю ночь, до утра, в постели"""),
    ],
}
#: Words reported, denied or discussed, and other senses; what stands in the sentence of one is no case.
EXCEPTIONS = {
    "abusive": """{call|called|calls|calling} {me|her|him|them|us|people|someone|anyone|it|each other|others|women} {a|an|the}, {calling|call|called} {people|others|women|immigrants|refugees|anyone}, {was|were|been|being|be|is|am|get|got} called,
        {that|whether|if|claimed|said|asked|shouted} {she|he|they|it} {was|were|is} a, {the|a} {word|insult|term|joke|novel|story|book|film|song} {about|is|was|of|that},
        {about|of|plays|played|playing|becomes|became} {a|an|the} {coward|liar|clown|fool|idiot|thief|traitor|loser}, idiot {light|proof|board|savant}, guinea pig{|s}, pig {farm|farmer|pen|iron|in},
        {trash|garbage|rat} {can|bin|bag|collection|day|poison|trap}, {the|a|my|our} {machine|engine|dog|cat|animal}, circus, why that hurt, never forgot it, deserves to be,
        {nannte|nannten|nennt|genannt|schimpfte} {|sie |ihn |mich |uns |jemanden }{einen|eine|ihn|sie|mich}, als {idiot|lügner|feigling} {beschimpft|bezeichnet},
        {l a|m a|a|avait|ont} {traité|traitée|traités|appelé|appelée}, traité {son|sa|de|d}, traiter {de|quelqu}, {la|lo|le|me|les} {llamó|llamaron|llama|había llamado}, {llamar|llamado} {a|idiota},
        {chamou|chamaram|chamado|chamada|chamar} {|ela |ele |a |o }{a|o|de|ela|ele}, {ha|aveva|hanno} {chiamato|chiamata|dato}, {noemde|noemden} {haar|hem|me|hen}, uitgescholden,
        {назвал|назвала|назвали|обозвал|обозвала} {её|ее|его|меня|их|нас|человека}, {книга|роман|сказка|фильм} о, {дураке|трусе|лжеце}""",
    "hateful": """{nobody|no one|noone|never|nor|not} {should|must|may|can|ever|deserves} {|ever |be }{call|called|compare|compared|treat|treated|say|to be called},
        {it is|it s|is} {wrong|illegal|a crime|racist|hateful|false} to {call|calling|compare|describe|label}, must {never|not} be called,
        should {never|not} be called, hate speech, {racism|racist|slur|slurs|propaganda|stereotype|stereotypes|discrimination}, {niemand|keiner} {darf|soll|sollte},
        {darf|dürfen|sollte|soll} {niemand|man|nicht|nie}, {nennen|bezeichnen|beschimpfen|vergleichen}, {nadie|nunca} {debe|debería|puede}, debe llamar, {llamar|comparar} {a|con}, {personne|nul} ne,
        {ne doit|ne devrait|ne doivent}, {traiter|comparer|qualifier}, {ninguém|nunca} {deve|devia|pode}, {chamar|comparar}, {nessuno|mai} {deve|dovrebbe|può}, {chiamare|paragonare}, niemand mag,
        {noemen|vergelijken}, {никто|нельзя} {не |}{должен|называть|вправе|смеет}, называть, {biolog|zoolog|entomolog}{ist|ists|e|en|in|iste|istes|a|as|o|os|i|y|y's}, {биолог|зоолог|ветеринар},
        exterminator, pest control, pests, gardener{|s}, farmer{|s}, veterinarian, kammerjäger{|s}, gärtner, bauern, tierarzt, désinsectisation, jardinier, agricultores, contadini, pond, river, lake,
        {in|from} the {attic|cellar|barn|garden|sewers|river|sea|soil|grain}, sewers, crops, harvest, harmless, grenier, étang, dachboden, keller,
        {auf|im|in} {dem|der} {dachboden|keller|teich|scheune}, teich, desván, sótano, estanque, sótão, lagoa, soffitta, stagno, zolder, kelder, vijver, чердак, пруд, подвал,
        рыб, insetos, insectes, insectos, {very|muy|très|molto} {intelligent|inteligentes|intelligents|résistants}, old {wood|furniture|papers|tyres|leaves}, forged,
        {by|of} the {flood|fire|storm|war}, according to""",
    "sexual": """sex{ual|ueller|uelle|uellen|uelles|uele|uels|uelle} {health|education|harassment|abuse|assault|gesundheit|aufklärung|bildung},
        {educación|salud|educação|saúde|educazione|salute|santé|éducation|orientación|acoso|abuso} {sexual|sessuale|sexuelle}, seksuele {gezondheid|voorlichting},
        sex {education|of the|discrimination|trafficking|offender|workers|ed}, same sex, cancer{|s}, krebs, screening, mammogram, clinic, klinik, clinique, clínica, clinica, doctor, doctors,
        naked {eye|mole|truth}, {auge|œil|ojo|olho|occhio} {nu|nackt|desnudo|nudo}, mit bloßem auge, mole rat, {breast|chicken} {milk|feeding|cancer|breast},
        {painting|sculpture|statue|museum|gemälde|peinture|pintura|quadro|dipinto|картина}, {puppy|dog|cat|kitten|hund|perro|chien|cão|cane},
        {law|court|trial|police|study|survey|teacher} {on|against|said|found}, about the {weather|food|price|prices|noise|cold}""",
}


def expanded(text: str) -> list[str]:
    """All phrases that rules stand for."""
    out, todo = [], re.split(r",\s+", text.strip())
    while todo:
        rule = todo.pop()
        m = re.search(r"\{([^{}]*)\}", rule)
        if m:
            todo += [rule[: m.start()] + x + rule[m.end() :] for x in m[1].split("|")]
        else:
            out.append(" ".join(rule.split()))
    return sorted({x for x in out if x})
