"""Words of layer and block names. Stems of the naming vocabulary by class and rank.

A stem of up to three letters is compared with the whole word, a longer one with its beginning.
"""

# Fixed values. Ranks from the strongest: point, line, object, surface, boundary.
RANKS = ("point", "line", "object", "surface", "boundary")

# Class | rank | words.
_WORDS = """
existing_tree | point | дерев tree trees ствол липа липы клен берез дуб ясен тополь тополя ель ели елк сосн рябин яблон груш вяз каштан лиственниц туя туи черемух ольх осин ива ивы платан акаци орех
existing_shrub | point | кустар куст кусты shrub shrubs bush изгород спире сирен кизильник дерен пузыреплод барбарис шиповник самшит
utility.access | point | колодец колодц люк люки решетк дождеприем manhole hole holes
pole | point | опор столб мачт светильн фонар торшер флагшт флаг светофор стойк pole poles mast lamp stolb
power_line_overhead | line | вл вли лэп сип воздушн overhead
utility.power_cable | line | кабел кл ркл эс электр силов заземл зеземл cable cables power electric
utility.telecom | line | связ телеф мгтс слаботоч вок спайк оптик сс telecom fiber fibre
utility.water | line | водопровод водовод в1 water
utility.sewer | line | канализ фекал к1 sewer sewage
utility.storm | line | водосто ливнев дождев водоотвод лотк лоток к2 storm
utility.drain | line | дренаж drain drainage
utility.heat | line | теплосет теплотрасс тепловод тс heat heating
utility.gas | line | газопровод газ г1 gas
utility.unknown | line | труб коммуникац футляр гнб коллектор pipe pipes utility utilities сети сеть
curb | line | борт бордюр бр бк kerb curb
fence | line | огражд ограда ограды забор ограничивающ удерживающ fence barrier zabor
building | object | здани строени дом building wall подстанц трансформатор substation transformer dom витраж импост
structure | object | сооруж павильон остановк киоск подпорн стенк парапет мост эстакад тоннел шахт воздуховод платформ bridge
obstacle | object | маф мафы урна урны скамь скамейк лавк лавоч контейнер тбо велопарк вазон полусфер столбик фонтан памятник скульптур лестниц ступен пандус стел stair stairs bench benches bin bollard fountain навес canopy canopies водоем пруд озер pond lake hydrograph hydrography
lawn | surface | газон гзн лужайк луг травян трава цветник lawn grass turf flower flowers flowerbed щепа щепы щепо щепе мульч mulch
sidewalk | surface | тротуар трот тр пешеход дорожк плитк плитн мощен брусчат площадк детск спорт гравий щебен щебн sidewalk footway footpath path paving playground sport sports
road | surface | проезж пч дорог дорожн автодорог уширен обочин кромк парковк стоянк въезд заезд щма мз road roads carriageway parking doroga
"""

# Class | rank | phrases, separated by semicolons.
_PHRASES = """
utility.telecom | line | кабель связи; кабели связи; кабельная связ; cable comm; comm cable; communication cable; telecom cable
curb | line | край дорог; край проезж; край пч; кромка проезж; road edge; edge of road
structure | object | retaining wall
obstacle | object | wall bouldering; bouldering; climbing wall; скалодром; стойка велопарков; стойки велопарков; велостойк; water body; водный объект
lawn | surface | green area; зона озеленения
sidewalk | surface | crushed stone
work_boundary | boundary | граница работ; границы работ; граница благоустр; границы благоустр; граница проектир; граница участк; граница заказа; work boundary; границы участк; site boundary; site border; territory boundary; project boundary; site limit; work limit
"""

# Weak hints decide only when nothing else speaks.
WEAK = {
    "контр": "contour", "контур": "contour", "граница": "contour", "границы": "contour", "акр": "ignore", "эн": "utility.power_cable",
    "иот": "utility.power_cable", "аб": "sidewalk", "асфальт": "sidewalk", "покрыти": "sidewalk", "щ": "sidewalk",
}

# Grammar of project names.
SEPARATORS = ("за счет", "на месте", "вместо", "за", "на")
NEGATIONS = ("не", "без", "нет")
REMOVAL = (
    "демонтаж", "демонт", "дем", "снос", "сносим", "удален", "удаляем", "ликвид", "уничтож", "разборк", "разбор", "вырубк",
    "вырубаем", "demolition", "demolish", "remove", "removed",
)
PROPOSED = ("проект", "проектир", "посадк", "новы", "нова", "ново", "новог", "гп", "пр", "proposed", "new", "planned")
EXISTING = ("сущ", "существ", "сохран", "existing")
ANNOTATION = (
    "текст", "подпис", "надпис", "размер", "выноск", "офр", "оформлен", "рамк", "штамп", "пикет", "piket", "pikets", "text", "dim",
    "dims", "dimension", "legend", "легенд", "условн", "обознач", "непечат", "вспомог", "рабоч", "пометк", "вопрос", "defpoints",
    "interpolation", "interpolations", "ось", "осев", "освещенност", "xref", "pdf", "отметк", "горизонтал", "уклон", "стрелк",
    "номер", "viewport", "note", "notes", "anno", "annotation", "разметк", "координат", "сетк", "крест", "marking", "markings",
    "window", "windows", "спутник", "растр", "карта", "подложк", "фото", "схема", "title", "border", "спрят", "скан", "piks",
)


def word_rows() -> list[tuple[str, str, int]]:
    """(word, class, rank): rank 0 is the strongest."""
    rows = []
    for line in _WORDS.strip().splitlines():
        cls, rank, words = (p.strip() for p in line.split("|"))
        rows += [(w, cls, RANKS.index(rank)) for w in words.split()]
    return rows


def phrase_rows() -> list[tuple[str, str, int]]:
    rows = []
    for line in _PHRASES.strip().splitlines():
        cls, rank, phrases = (p.strip() for p in line.split("|"))
        rows += [(w.strip(), cls, RANKS.index(rank)) for w in phrases.split(";")]
    return rows


def service_rows() -> list[tuple[str, str]]:
    """(word, role) of the words that steer the grammar."""
    groups = {"annotation": ANNOTATION, "removal": REMOVAL, "proposed": PROPOSED, "existing": EXISTING, "negation": NEGATIONS}
    return [(w, role) for role, words in groups.items() for w in words]
