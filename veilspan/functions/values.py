"""Whether the value of a field is what the field is for, as Columns; null and empty values are not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _holds_any(text: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.lit(list(parts)), lambda p: F.contains(text, p))


_DIGIT = r"(?U)\d"

# Words that stand where a number should, laws and standards.
_NO_NUMBER = ("ОТ", "МЕЖДУ", "БЕЗ", "ДЛЯ", "ГОДА", "Г.")
_LAW = r"(?U)\bФЗ\b|-ФЗ\b|/ФЗ\b|\bФКЗ\b|-ФКЗ\b|/ФКЗ\b|(?:ФЗ|ФКЗ)\z|^(?:ФЗ|ФКЗ)-"
_STANDARD = r"(?U)\b(?:ГОСТ|СНИП|САНПИН)\b"


def power_of_attorney(value: Column) -> Column:
    """A number that isn't that of a federal law."""
    up = F.trim(F.upper(_text(value)))
    return up.rlike(_DIGIT) & ~up.isin(*_NO_NUMBER) & ~up.rlike(_LAW)


def contract_number(value: Column) -> Column:
    """A number that isn't that of a law or a standard."""
    return power_of_attorney(value) & ~F.trim(F.upper(_text(value))).rlike(_STANDARD)


def visa(value: Column) -> Column:
    v = _text(value)
    return v.rlike(_DIGIT) & ~v.rlike("[А-Яа-яЁё]")


def court_case(value: Column) -> Column:
    """A number with a slash, or of hyphened parts."""
    v = _text(value)
    return (v.contains("/") | v.rlike(r"(?iu)^\d{1,3}-[А-ЯЁA-Z]{1,4}\d{1,4}-\d{1,8}\z")) & v.rlike(_DIGIT)


# What an address field never says, and what an address holds.
_ADDRESS_NEVER = ("претензи", "возврат", "денежн", "средств", "сообщаем", "рассмотрен", "договор", "заявк", "туроператор", "в связи с чем")
_ADDRESS_PART = (
    r"(?iU)(?:\b\d{6}\b|(?:^|[\s,])(?:г\.|город\b|ул\.|улица\b|пер\.|переулок\b|просп\.|проспект\b|"
    r"дом\b|д\.|корпус\b|корп\.|кв\.|квартира\b|пос\.|поселок\b|посёлок\b|с\.\s*[А-ЯЁ][а-яё]+|село\b|"
    r"област\w*\b|республик\w*\b|муниципалитет\w*\b|помещение\b|набережн\w*\b|наб\.|бульвар\b|б-р\b|шоссе\b|ш\.))"
)


def address_field(value: Column) -> Column:
    v = _text(value)
    return ~_holds_any(F.lower(v), _ADDRESS_NEVER) & v.rlike(_ADDRESS_PART)


# Words that are no job title.
_NO_TITLE = ("сотрудник", "сотрудника", "работник", "работника", "лицо", "лица", "новый сотрудник", "наименование должности")


def _bare(value: Column) -> Column:
    return F.trim(F.regexp_replace(_text(value), r"\([^)]*\)|_{2,}", ""))


def job_title(value: Column) -> Column:
    bare = _bare(value)
    low = F.lower(bare)
    return ~low.isin(*_NO_TITLE) & ~low.startswith("и ") & ~low.rlike(r"(?U)\b(?:зарплат\w*|оклад\w*|доход\w*)\b") & (F.char_length(bare) >= 2) & ~bare.startswith("(")


def person_field(value: Column, names: Column | None = None) -> Column:
    """Two capitalised words or more; a single word only if ``names`` (an array of known names, lower case)
    holds it: without a dictionary a lone word isn't enough."""
    words = F.regexp_extract_all(_text(value), F.lit("[А-ЯЁа-яё-]+"), F.lit(0))
    capital = F.forall(words, lambda w: F.substring(w, 1, 1).rlike("[А-ЯЁ]"))
    lone = F.lit(False) if names is None else F.array_contains(names, F.lower(F.try_element_at(words, F.lit(1))))
    return (F.size(words) > 0) & capital & F.when(F.size(words) == 1, F.coalesce(lone, F.lit(False))).otherwise(True)


# Kinds of personal data that a list names, and marks of a place.
_NO_PLACE = (
    "пол", "гражданств", "паспорт", "сери", "номер", "адрес", "телефон", "данны", "справк", "выписк", "сведени", "документ", "место жительств", "регистраци", "проживани", "электронн",
)
_PLACE = r"(?iU)(?:\b(?:г|гор|город|с|село|дер|деревня|пос|поселок|пгт|обл|область|край|р-н|район|респ|республика|рф|россия|ссср)\b|[А-ЯЁа-яё]{2,})"


def birth_place(value: Column) -> Column:
    v = _text(value)
    return ~_holds_any(F.trim(F.lower(v)), _NO_PLACE) & v.rlike(_PLACE)


# Countries, what citizens are called, forms of states, and what isn't a citizenship.
COUNTRIES_RU = (
    "россия", "российская федерация", "рф", "беларусь", "белоруссия", "республика беларусь", "казахстан", "узбекистан", "таджикистан", "кыргызстан", "киргизия", "армения", "азербайджан",
    "грузия", "молдова", "молдавия", "туркменистан", "туркмения", "украина", "абхазия", "южная осетия", "турция", "египет", "оаэ", "объединенные арабские эмираты", "таиланд", "тайланд", "китай", "кнр",
    "индия", "вьетнам", "индонезия", "мальдивы", "сейшелы", "шри-ланка", "куба", "доминикана", "мексика", "бразилия", "аргентина", "сша", "соединенные штаты америки", "соединенные штаты",
    "канада", "великобритания", "соединенное королевство", "англия", "германия", "фрг", "франция", "италия", "испания", "греция", "кипр", "израиль", "сербия", "черногория", "болгария", "венгрия",
    "чехия", "словакия", "польша", "финляндия", "швеция", "норвегия", "австрия", "швейцария", "нидерланды", "голландия", "бельгия", "португалия", "япония", "южная корея", "корея", "кндр",
    "австралия", "новая зеландия", "сингапур", "малайзия", "филиппины", "монголия", "иран", "ирак", "саудовская аравия", "катар", "бахрейн", "оман", "иордания", "ливан", "тунис", "марокко", "юар",
    "албания", "андорра", "босния и герцеговина", "ватикан", "дания", "ирландия", "исландия", "латвия", "литва", "лихтенштейн", "люксембург", "мальта", "монако", "северная македония",
    "румыния", "сан-марино", "словения", "хорватия", "эстония", "алжир", "колумбия", "чили", "перу",
)
COUNTRIES_EN = (
    "russia", "russian federation", "rf", "rus", "belarus", "blr", "kazakhstan", "kaz", "uzbekistan", "uzb", "tajikistan", "tjk", "kyrgyzstan", "kgz", "armenia", "arm",
    "azerbaijan", "aze", "georgia", "geo", "moldova", "mda", "turkmenistan", "tkm", "ukraine", "ukr", "turkey", "turkiye", "tur", "egypt", "egy", "uae", "united arab emirates",
    "thailand", "tha", "china", "prc", "chn", "india", "ind", "vietnam", "vnm", "indonesia", "idn", "maldives", "mdv", "seychelles", "syc", "sri lanka", "lka", "cuba", "cub", "mexico", "mex",
    "brazil", "bra", "argentina", "arg", "usa", "us", "united states", "united states of america", "canada", "can", "uk", "united kingdom", "great britain", "england", "gbr",
    "germany", "deu", "france", "fra", "italy", "ita", "spain", "esp", "greece", "grc", "cyprus", "cyp", "israel", "isr", "serbia", "srb", "montenegro", "mne", "bulgaria", "bgr",
    "hungary", "hun", "czech republic", "czechia", "cze", "slovakia", "svk", "poland", "pol", "finland", "fin", "sweden", "swe", "norway", "nor", "austria", "aut", "switzerland", "che",
    "netherlands", "nld", "belgium", "bel", "portugal", "prt", "japan", "jpn", "south korea", "korea", "kor", "australia", "aus", "new zealand", "nzl", "singapore", "sgp",
)
_CITIZENS = (
    "гражданин рф", "гражданка рф", "гражданин россии", "гражданка россии", "гражданин российской федерации", "российское", "российский", "российская", "белорусское", "белорусская", "казахстанское",
    "иностранный гражданин", "иностранная гражданка", "лицо без гражданства", "лбг", "апатрид", "бипатрид", "russian", "belarusian", "kazakh", "german", "french", "american", "british", "italian", "spanish",
)
_STATE = (
    r"(?U)\b(?:республик\w*|федераци\w*|королевств\w*|эмират\w*|соединенн\w*\s+штат\w*|княжеств\w*|герцогств\w*|султанат\w*|государств\w*|"
    r"republic|federation|kingdom|emirates|states|principality|state|sultanate)\b"
)
_NO_CITIZENSHIP = (
    "туриста", "туристов", "клиента", "участников", "гражданина", "лица", "сторон", "и национальность", "в настоящее время", "при рождении", "по рождению", "при наличии", "при необходимости",
    "иного государства", "другое", "отсутствует", "не имеется", "не требуется", "не указано", "согласно договору",
)
_NEVER_CITIZENSHIP = ("выезда", "начала тура", "паспорта", "страны", "рождени", "пол,", "паспорт")


def citizenship(value: Column) -> Column:
    """A known country or what its citizens are called, a value with a country among its words, or a form
    of state; capitalised, 2 to 60 characters."""
    clean = F.regexp_replace(F.trim(_text(value)), r"[.,;]+\z", "")
    low = F.lower(clean)
    refused = low.isin(*_NO_CITIZENSHIP) | low.rlike(r"(?U)^(?:в|при|на|по|до|для|без|с|со|от|из|о|об)\s+") | _holds_any(low, _NEVER_CITIZENSHIP)
    capital = F.substring(clean, 1, 1).rlike(r"\p{Lu}") | low.isin(*_CITIZENS) | clean.startswith("РФ")
    words = F.regexp_extract_all(low, F.lit("[a-zA-Zа-яёА-ЯЁ]+"), F.lit(0))
    known = F.lit([*COUNTRIES_RU, *COUNTRIES_EN])
    named = F.array_contains(known, low) | low.isin(*_CITIZENS) | F.arrays_overlap(words, known) | low.rlike(_STATE)
    return ~refused & capital & F.char_length(clean).between(2, 60) & ~clean.startswith("(") & named


# Words of forms and contracts.
_NO_EMPLOYER = ("подпись", "фио", "ф.и.о.", "дата", "обязуется", "сохранение", "реестр", "результат", "договор")
_NO_POLICY = ("услуга", "услуги", "договор", "полис", "памятка", "памяткой", "является")


def employer(value: Column) -> Column:
    bare = _bare(value)
    return ~_holds_any(F.lower(bare), _NO_EMPLOYER) & F.char_length(bare).between(2, 70)


def insurance_policy(value: Column) -> Column:
    v = F.trim(_text(value))
    return ~F.lower(v).isin(*_NO_POLICY) & (F.length(F.regexp_replace(v, r"(?U)\D", "")) >= 3)


def tour_operator_number(value: Column) -> Column:
    v = F.trim(_text(value))
    return F.length(F.regexp_replace(v, r"(?U)\D", "")).between(5, 7) & ~v.rlike(r"(?iU)(?:руб|коп|млн|тыс|раз|дн|час|месяц|кв\b|год|этап|шт)")


# Shapes of streets, districts and houses.
_STREET = (
    r"(?iU)(?:\b(?:ул\.|улиц[а-яё]*|пр-кт\w*|пр-т\w*|проспект\w*|пер\.|переул\w*|б-р\w*|бульвар\w*|ш\.|шоссе\b|"
    r"(?!(?:г\.|город\s+)?Набережные\s+Челн)набережн(?:ая|ой|ую|ое|ом|ые|ых|ым)?\b|наб\.|пр-д\b|проезд\w*|туп\.|тупик\w*|алле[яеи]\b|тракт\w*|пл\.|площад\w*|линия\b|лин\.|взвоз\b|спуск\b|"
    r"street\b|st\.|avenue\b|ave\.|boulevard\b|blvd\.|road\b|rd\.|drive\b|dr\.|lane\b|ln\.|way\b|highway\b|hwy\.))"
)
_DISTRICT = (
    r"(?iU)(?:\b(?:р-н\b|район\w*|мкр\b|мкр-н\b|микрорайон\w*|кв-л\b|квартал\w*|пос\.|посел[ое]к\w*|пгт\b|п\.г\.т\.|дер\.|деревн\w*|село\b|с\.\s+[А-ЯЁ]|станиц\w*|ст-ца\b|аул\w*|"
    r"хутор\w*|хут\.|поселени\w*|пос-е\b|муниципальн\w*\s+округ\w*|муниципалитет\w*|вн\.тер\.г\.|district\b))"
)
_HOUSE = (
    r"(?iU)(?:\b(?:дом|д\.|владение|вл\.|строение|стр\.|корпус|корп\.|к\.|квартира|кв\.|офис|оф\.?|помещение|помещ\.|пом\.|комната|комн\.|ком\.|кабинет|каб\.|этаж|эт\.|э\.|"
    r"участок|уч\.|бокс|павильон|пав\.|подъезд|под\.|house\b|bldg\b|building\b|apt\b|apartment\b|suite\b|ste\b|room\b|unit\b|fl\.|floor\b)\s*[:№#\-–—]?\s*\d+|"
    r"\b(?:пом[а-яё]*|помещ[а-яё]*|кв[а-яё]*|ком[а-яё]*|оф[а-яё]*)\.?\s*[/\\|.,]+\s*(?:оф[а-яё]*|ком[а-яё]*|пом[а-яё]*)\.?\s*[:№#\-–—]?\s*\d+|"
    r"\b\d+[A-Za-zА-Яа-яЁё]?(?:/\d+)?(?=\s*(?:лит\.|литера\b|[A-Za-zА-Яа-яЁё]\b|кв\.|оф\.?|пом\.?|стр\.?|корп\.?))|"
    r"(?:ул\.|улица|пр-кт|пр-т|проспект|пер\.|переулок|б-р|бульвар|ш\.|шоссе|наб\.|набережная|проезд|street|st\.|road|rd\.|avenue|ave\.)[^,\n;]{1,60}?[,\s]+(?:\bд\.\s*)?\d{1,4}[A-Za-zА-Яа-яЁё]?(?:/\d+)?\b)"
)
_NUMBER = r"(?U)\b\d{1,4}[A-Za-zА-Яа-яЁё]?(?:/\d+)?\b"
_NAMED_STREET = r"(?U)(?:ул\.|улиц\w*|проспект\w*|пр-кт\w*|бульвар\w*|б-р\w*|пер\.|переул\w*|шоссе\b|street\b|avenue\b|road\b)\s+[А-ЯЁA-Z]"


def sufficient_address(text: Column) -> Column:
    """A street with a house, district, number or name of its own, or a district with a house or number: a
    country or town alone is no address."""
    t = F.trim(_text(text))
    street, district, house, number = (t.rlike(p) for p in (_STREET, _DISTRICT, _HOUSE, _NUMBER))
    return (F.char_length(t) >= 4) & (street & (house | district | number | t.rlike(_NAMED_STREET)) | district & (house | number))


def near_address_mark(text: Column, start: Column, marks: tuple[str, ...] | None = None) -> Column:
    """Whether one of the marks stands in the 25 characters before a place."""
    window = F.lower(F.substr(text, F.greatest(start - 25, F.lit(0)) + 1, F.least(start, F.lit(25))))
    return _holds_any(window, marks or ADDRESS_MARKS)


# What a sentence about a contract says, and marks that an address must have.
_CONTRACT_WORDS = (
    r"\b(?:случае|если|когда|где|там|здесь|тогда|потом|после|перед)\b", r"\b(?:оплат|платеж|стоимость|сумм|договор|услуг|работ)\b", r"\b(?:заказчик|исполнитель|подрядчик|клиент|стороны)\b",
    r"\b(?:уплачивает|получает|передает|выполняет|обязуется)\b", r"\b(?:с\s+обязательным|обязательным|соблюдением)\b", r"\b(?:этап|этапа|этапу|этапе|этапом|этапы|этапов)\b",
    r"\b(?:материал|материала|материалу|материале|материалом|материалы|материалов)\b", r"\b(?:условии|условие|условия|условий|условиям|условиями)\b",
    r"\b(?:завершении|завершение|завершения|завершению)\b", r"\b(?:работа|работы|работе|работу|работой|работ)\b", r"\b(?:проект|проекта|проекту|проекте|проектом|проекты|проектов)\b",
)
_MUST_HAVE = (
    r"\b(?:г\.|город|гор\.)\s*[А-ЯЁ][а-яё]+", r"\b(?:ул\.|улица)\s*[А-ЯЁ][а-яё\s]+", r"\b(?:пр\.|пр-т|проспект)\s*[А-ЯЁ][а-яё\s]+", r"\b(?:пер\.|переулок)\s*[А-ЯЁ][а-яё\s]+",
    r"\b(?:ш\.|шоссе)\s*[А-ЯЁ][а-яё\s]+", r"\b(?:наб\.|набережная)\s*[А-ЯЁ][а-яё\s]+", r"\b(?:пл\.|площадь)\s*[А-ЯЁ][а-яё\s]+", r"\b(?:б-р|бульвар)\s*[А-ЯЁ][а-яё\s]+",
    r"\b(?:тер\.|территория)\s*[А-ЯЁ][а-яё\s]+", r"\b(?:обл\.|область)\s*[А-ЯЁ][а-яё\s]+", r"\b(?:р[.-]н|район)\s*[А-ЯЁ][а-яё\s]+", r"\b(?:пос\.|поселок|посёлок)\s*[А-ЯЁ][а-яё\s]+",
    r"\b(?:с\.|село)\s*[А-ЯЁ][а-яё\s]+", r"\b(?:д\.|дом)\s*\d+[а-яёА-ЯЁ]?", r"\b(?:кв\.|квартира)\s*\d+", r"\b(?:стр\.|строение)\s*\d+", r"\b(?:корп\.|корпус)\s*\d+[а-яёА-ЯЁ]?", r"\b(?:оф\.|офис)\s*\d+[а-яёА-ЯЁ]?",
)
_LONE_TOWN = (r"^[А-ЯЁ][а-яё]{2,}(?:ск|рск|нск|цк|ия|ье|во|но|ты|ки|ев|ов|ин|ын|ург|град|город)$", r"^[А-ЯЁ][а-яё]{2,6}[ейыаи]?$")
ADDRESS_MARKS = ("г.", "город", "ул.", "улица", "д.", "дом", "обл.", "область", "р-н", "район", "мкр.", "микрорайон", "пр.", "проспект", "пер.", "переулок", "ш.", "шоссе", "кв.", "квартира")


def address_of_marks(text: Column) -> Column:
    """An address by its marks, or a lone word that looks like a town, without the words of contracts."""
    t = F.trim(_text(text))
    contract = t.rlike("(?iU)" + "|".join(_CONTRACT_WORDS))
    marked = t.rlike("(?iU)" + "|".join(_MUST_HAVE))
    lone = ~t.rlike(r"(?U)\s") & (t.rlike(_LONE_TOWN[0]) | t.rlike(_LONE_TOWN[1]) & (F.char_length(t) >= 4))
    return (F.char_length(t) >= 2) & ~contract & (marked | lone)
