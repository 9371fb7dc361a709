"""Field labels of forms and table headers as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical labels and the patterns of their captions, in order of preference.
LABELS = (
    ("ФИО", r"\b(?:ф\W*и\W*о|фамилия\s+имя(?:\s+отчество)?)\b"),
    ("Дата рождения", r"\b(?:дата\s+рождения|родился?\s*[:№-]?)\b"),
    ("Место рождения", r"\bместо\s+рождения\b"),
    ("Адрес", r"\b(?:адрес|место\s+жительства|место\s+пребывания)\b"),
    ("Телефон", r"\b(?:тел\.?|телефон|мобил(?:ьный|ьн)?\s+телефон)\b"),
    ("Электронная почта", r"\b(?:e-?mail|электронн(?:ая|ой)\s+почт(?:а|ы))\b"),
    ("Наименование", r"\b(?:наименование|название)\b"),
    ("ИНН", r"\bинн\b"),
    ("КПП", r"\bкпп\b"),
    ("ОГРНИП", r"\bогрнип\b"),
    ("ОГРН", r"\bогрн\b"),
    ("БИК", r"\bбик\b"),
    ("СНИЛС", r"\bснилс\b"),
    ("Паспорт", r"\b(?:паспорт|серия\s+и\s+номер\s+паспорта)\b"),
    ("Кадастровый номер", r"\bкадастров(?:ый|ого)\s+номер(?:а)?\b"),
    ("Свидетельство о рождении", r"\bсвидетельств(?:о|а)\s+о\s+рождении\b"),
    ("Свидетельство о заключении брака", r"\bсвидетельств(?:о|а)\s+о\s+(?:заключении\s+брака|браке)\b"),
    ("Запись акта гражданского состояния", r"\b(?:номер\s+)?записи\s+акта(?:\s+гражданского\s+состояния)?\b"),
    ("Удостоверение адвоката", r"\b(?:удостоверение|реестр)\s+адвокат(?:а|ов)\b"),
    ("Реестровый номер", r"\b(?:реестров(?:ый|ого)\s+номер(?:а)?(?:\s+(?:в\s+)?ефрт|\s+туроператора)?|номер\s+в\s+ефрт|ефрт)\b"),
    ("Номер судебного дела", r"\b(?:номер\s+(?:судебного\s+)?дела|дело\s*№|гражданское\s+дело)\b"),
    ("Номер договора", r"\b(?:номер\s+договора|договор\s*№)\b"),
    ("Номер патента", r"\b(?:номер\s+патента|патент)\b"),
    ("Лицевой счёт", r"\bлицев(?:ой|ого)\s+сч[её]т\b"),
    (
        "Расчётный счёт",
        r"\b(?:(?:номер\s+)?(?:расч[её]тн(?:ый|ого|ому|ым|ом)|банковск(?:ий|ого|ому|им|ом)|текущ(?:ий|его))\s+сч[её]т(?:а|у|ом|е)?|(?:номер\s+)?(?:карт(?:ы)?(?:\s*[/\\|]\s*)?)?сч[её]т(?:а|у|ом|е)?(?:\s*[/\\|]\s*карт(?:ы)?)?)\b",
    ),
    ("Корреспондентский счёт", r"\bкорреспондентск(?:ий|ого|ому|им|ом)\s+сч[её]т(?:а|у|ом|е)?\b"),
    ("VIN", r"\b(?:vin|идентификационный\s+номер\s+транспортного\s+средства)\b"),
    ("Государственный регистрационный знак", r"\b(?:государственный\s+(?:регистрационный\s+знак|номер)|номер\s+автомобиля|госномер)\b"),
    ("Заграничный паспорт", r"\b(?:заграничный\s+паспорт|загранпаспорт)\b"),
    ("Водительское удостоверение", r"\bводительское\s+удостоверение\b"),
    ("Военный билет", r"\bвоенный\s+билет\b"),
    ("Вид на жительство", r"\b(?:вид\s+на\s+жительство|внж)\b"),
    ("Миграционная карта", r"\bмиграционная\s+карта\b"),
    ("Номер визы", r"\b(?:номер\s+)?визы\b"),
    ("Разрешение на работу", r"\bразрешение\s+на\s+работу\b"),
    ("Номер ПТС", r"\b(?:номер\s+)?птс\b"),
    ("Номер СТС", r"\b(?:номер\s+)?стс\b"),
    ("Номер исполнительного производства", r"\b(?:номер\s+)?исполнительного\s+производства\b"),
    ("Номер доверенности", r"\b(?:номер\s+)?доверенности\b"),
    ("Полис ОМС", r"\b(?:полис\s+)?омс\b"),
    ("Полис ДМС", r"\b(?:полис\s+)?дмс\b"),
    ("Номер медицинской карты", r"\b(?:номер\s+)?медицинской\s+карты\b"),
    ("Диагноз", r"\bдиагноз\b"),
    ("Номер банковской карты", r"\b(?:номер\s+)?банковской\s+карты\b"),
    ("IP-адрес", r"\bip[- ]?адрес\b"),
    ("MAC-адрес", r"\bmac[- ]?адрес\b"),
    ("Логин", r"\b(?:логин|уч[её]тная\s+запись)\b"),
    ("Гражданство", r"\bгражданство\b"),
    ("Должность", r"\bдолжность\b"),
    ("Место работы", r"\b(?:место\s+работы|работодатель)\b"),
    ("Образование", r"\bобразование\b"),
    ("Размер дохода", r"\b(?:размер\s+дохода|доход)\b"),
    ("Сведения о судимости", r"\b(?:сведения\s+о\s+судимости|судимость)\b"),
    ("Национальность", r"\bнациональность\b"),
    ("Вероисповедание", r"\b(?:вероисповедание|религия)\b"),
    ("Политические взгляды", r"\bполитические\s+взгляды\b"),
    ("Биометрические данные", r"\bбиометрические\s+данные\b"),
    ("Размер", r"\bразмер(?:ы)?\b"),
)
# Words that may follow a label without making the cell a value.
QUALIFIERS = (
    "полностью", "полное", "полная", "полный", "сокращенное", "сокращённое", "банка", "банковские", "организации", "юридического лица", "сотрудника", "офиса", "регистрации", "фактический",
    "юридический", "почтовый", "работника", "правообладателя", "получателя", "плательщика",
)
BOTH_NUMBERS = "ИНН/КПП"
_BOTH_OWNERS = r"покупателя|продавца|поставщика|исполнителя|заказчика|клиента|банка|организации|предприятия|плательщика|получателя"
LONGEST_LABEL, LONGEST_TAIL = 100, 36

_EDGE = " \t:№-–—()[]"
_EDGE_CLASS = r"[ \t:№\-–—()\[\]]"
_ANY = "(?iU)(?:" + "|".join(p for _, p in LABELS) + ")"


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def _specs() -> Column:
    """The labels as one constant array (a parsed expression: so many literal columns would take long to build)."""
    return F.expr("array(" + ", ".join(f"named_struct('label', '{label}', 'pattern', r'{p}')" for label, p in LABELS) + ")")


def _tail(normal: Column, front: str, pattern: Column) -> Column:
    """What follows the first match, without edge characters; null without a match."""
    whole = F.concat(F.lit("(?iU)^" + front), pattern, F.lit("(.*)$"))
    return F.when(F.regexp_like(normal, whole), F.btrim(F.call_function("regexp_extract", normal, whole, F.lit(1)), F.lit(_EDGE)))


def field_label(text: Column) -> Column:
    """The canonical label of a text that looks like a field's caption, else null.

    Null, empty and long texts have none.  One alternation settles texts without any label, so the
    patterns are tried singly, over a constant array, on the few others alone.
    """
    n = squeezed(text)
    both = n.rlike(r"(?iU)\bинн\b") & n.rlike(r"(?iU)\bкпп\b")
    each = F.get(F.filter(_specs(), lambda x: F.char_length(_tail(n, ".*?", x["pattern"])) <= LONGEST_TAIL), F.lit(0))["label"]
    return F.when((F.char_length(n) <= LONGEST_LABEL) & n.rlike(_ANY), F.when(both, F.lit(BOTH_NUMBERS)).otherwise(each))


def is_pure_label(text: Column) -> Column:
    """Whether a text is a caption and nothing else (false for null)."""
    n = squeezed(text)
    rest = F.get(F.filter(F.transform(_specs(), lambda x: _tail(n, f"{_EDGE_CLASS}*", x["pattern"])), lambda t: t.isNotNull()), F.lit(0))
    plain = (rest == "") | (~rest.rlike(r"(?iU)\d|@|https?://|www\.|[«\"']") & F.lower(rest).isin(*QUALIFIERS))
    both = n.rlike(rf"(?iU)^ИНН\s*[/\\|]\s*КПП(?:\s+(?:{_BOTH_OWNERS}))?\s*:?$")
    return F.coalesce(~F.contains(text, F.lit("\n")) & (F.char_length(n) <= LONGEST_LABEL) & F.when(n.rlike(_ANY), both | F.coalesce(plain, F.lit(False))), F.lit(False))


def folded(text: Column) -> Column:
    """Lower case, ё as е, white space squeezed; empty for null."""
    return squeezed(F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё", "е"))
