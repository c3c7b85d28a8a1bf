"""Given names in common use, by language, and endings of family names and patronymics."""

from __future__ import annotations

# Frequent given names.
RUSSIAN = """александр александра алексей алёна алина алиса алла альберт анастасия анатолий ангелина андрей анна антон антонина аркадий арсений артём артур
богдан борис вадим валентин валентина валерий валерия василий василиса вера вероника виктор виктория виталий владимир владислав всеволод вячеслав галина геннадий георгий герман глеб григорий
дарья денис диана дмитрий евгений евгения егор екатерина елена елизавета ефим жанна зинаида зоя иван игорь илья инна ирина кирилл клавдия константин кристина ксения лариса леонид лидия любовь людмила
макар максим маргарита марина мария марк матвей михаил надежда наталия наталья никита николай нина оксана олег олеся ольга павел полина пётр раиса римма роман руслан светлана святослав семён сергей софья софия станислав степан
тамара тарас татьяна тимофей тимур ульяна фёдор филипп эдуард эльвира юлия юрий яков яна ярослав""".split()
UKRAINIAN = """андрій анастасія богдан богдана валентин василь віктор вікторія віра віталій володимир ганна галина григорій дарина дмитро євген євгенія іван ігор ілля інна ірина катерина кирило костянтин
леся леонід лідія любов людмила максим марія марина микита микола михайло мирослава надія назар наталія наталя оксана олег олександр олександра олексій олена ольга орест остап павло петро роман руслан
світлана святослав сергій соломія софія степан тарас тетяна уляна федір христина юлія юрій ярина яна ярослав зоряна""".split()
ENGLISH = """aaron adam alan albert alexander alice amanda amy andrea andrew angela ann anna anne anthony arthur barbara benjamin betty beth brandon brenda brian bruce carl carol caroline catherine charles charlotte christine christopher
claire colin craig cynthia daniel david deborah dennis derek diana donald dorothy douglas edward eleanor elizabeth emily emma eric ethan eugene evelyn frances frank gary george gerald grace graham gregory hannah harold harry heather helen henry
ian isaac isabel jack jacob james jane janet jason jean jeffrey jennifer jeremy jessica joan john jonathan joseph joshua joyce judith julia julie justin karen katherine keith kelly kenneth kevin kyle laura lauren lawrence leonard linda lisa louis lucy
margaret maria marie martha martin mary matthew megan melissa michael michelle nancy nathan neil nicholas nicole noah nora oliver olivia oscar pamela patricia patrick paul peter philip phillip rachel ralph raymond rebecca richard robert roger ronald rose roy russell ruth ryan
samantha samuel sandra sarah scott sean sharon shirley simon sophia sophie stephanie stephen steven stuart susan teresa theresa thomas timothy tyler victoria vincent virginia walter wayne wendy william zachary""".split()
GERMAN = """andreas anja anke annette antje barbara bernd birgit brigitte christa christian christoph claudia daniela detlef dieter dirk dorothea elke erich erika erwin eva ferdinand florian frank franz friedrich fritz gabriele georg gerda gerhard gertrud gisela günter guenther günther hannelore hans harald
heike heinrich heinz helga helmut herbert hermann hildegard holger horst ilse inge ingeborg ingrid jens joachim johann johannes jörg jürgen jutta karin karl karsten katja katrin kerstin klaus konrad kurt lars lena liesel lothar lutz manfred manuela marianne markus marlene martina matthias monika
norbert olaf otto petra rainer ralf reinhard renate rita rolf rudolf sabine sebastian sigrid silke simone stefan steffi susanne sven thorsten torsten ulrich ulrike ursula ute uwe volker waltraud werner wilhelm wolfgang wolfram""".split()
SPANISH = """adriana alberto alejandra alejandro alfonso alfredo alicia álvaro ana andrés ángel ángela antonio arturo beatriz begoña carlos carmen carolina cecilia césar clara claudia concepción consuelo cristina daniel daniela diego dolores eduardo elena emilio enrique ernesto esperanza esteban eva felipe fernando francisca francisco
gabriel gabriela gloria gonzalo guadalupe guillermo gustavo héctor hugo ignacio inés irene isabel jaime javier jesús joaquín jorge josé josefa juan juana julia julián julio laura leticia lorena lourdes lucía luis luisa manuel manuela marcos margarita maría mariana mario marta mateo mercedes miguel mónica montserrat
natalia nuria óscar pablo patricia paula pedro pilar rafael ramón raquel raúl ricardo roberto rocío rodrigo rosa rosario rubén salvador santiago sara sergio silvia sofía soledad susana teresa tomás verónica vicente víctor xavier yolanda""".split()
# Endings. Romanised forms of Russian names end alike.
PATRONYMIC = r"(?:[её]вич|ович|йович|ьич|лич|мич|тич|кич|овна|[её]вна|ична|инична|івна|ївна|ovich|evich|ovna|evna|ichna)(?:а|у|ем|е|ы|ой)?"
FAMILY_CYRILLIC = r"(?:[оеё]в|[оеё]ва|ын|ин|ына|ина|ский|ская|цкий|цкая|ской|ских|ський|ська|цький|цька|енко|чук|щук|юк|ук|як|ко|ец|ець|их|ых|ян|швили|дзе|ишин|ишина|ів|їв|ович|евич)(?:а|у|ым|им|е|ой|ому|ого|ую)?"
FAMILY_LATIN = r"(?:ov|ova|ev|eva|in|ina|sky|skiy|skaya|enko|worth|ridge|son|sen|man|mann|ley|ford|ton|well|field|wood|stone|bury|by|stein|berg|berger|burg|meier|meyer|maier|müller|mueller|bauer|bach|hoff|feld|ler|ner|ke|ez|az|illas|illo|ero|era|ado|osa|ales|ano|edo|eda)"


def inflected(name: str) -> list[str]:
    """A Russian or Ukrainian given name in its usual cases."""
    if name[-1] in "ая" and len(name) > 2:
        soft = name[-1] == "я"
        return [name[:-1] + e for e in (("и", "е", "ю", "ей", "ії", "ію") if soft else ("ы", "и", "е", "у", "ой", "і"))]
    if name[-1] in "йь":
        return [name[:-1] + e for e in ("я", "ю", "ем", "е")]
    if name[-1] in "бвгґджзклмнпрстфхцчшщ":
        return [name + e for e in ("а", "у", "ом", "е")]
    return []


def given_names() -> dict[str, int]:
    """Given names in lower case without accents on ё, mapped to 1, and their other cases, mapped to 2."""
    out: dict[str, int] = {}
    for n in [*RUSSIAN, *UKRAINIAN]:
        for f in inflected(n):
            out[f.replace("ё", "е")] = 2
    out |= {"павла": 2, "павлу": 2, "петра": 2, "петру": 2, "льва": 2, "игоря": 2}
    for n in [*RUSSIAN, *UKRAINIAN, *ENGLISH, *GERMAN, *SPANISH]:
        out[n.replace("ё", "е")] = 1
    return out
