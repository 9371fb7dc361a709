"""Values of labelled fields in running text: a caption, a separator and a value of the shape that the
caption announces.

Each field is one pattern over a text; only texts that hold the field's stem are searched with it.  A value
ends its match, so its place follows from the match's end; values are trimmed and checked afterwards.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import checksums as C
from veilspan.functions import values as V
from veilspan.functions.text import placed
from veilspan.operators.detection import row_key


@dataclass(frozen=True)
class Field:
    """A label, a lower-case stem that its captions hold, the captions and the value as patterns."""

    label: str
    stem: str
    captions: str
    value: str
    check: Callable[[Column], Column] | None = None
    free: bool = False  # words: only a colon, dash, equals sign, tab, line feed or wide gap parts them


_EDGE, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_SIGN = r"(?:№|#|номер|N(?=[\s.\d]))"
#: Between caption and value: closing quotes and brackets, then a mark or the sign of a number.
_BETWEEN = rf"[»”\"')\]]?\s*(?:[:;,|=–—-]\s*)?(?:(?:серия|составляет|указан[ао]?|равен|равна)\s*:?\s*)?(?:{_SIGN}[.:]?\s*)?"
_BEFORE_WORDS = r"[»”\"')\]]?(?:\s*[:=|–—-]\s*|\s*[\t\n]\s*|\s{2,})"

_DIGITS = lambda n, m=None: rf"\d(?:[ \u00a0-]?\d){{{n - 1},{(m or n) - 1}}}"
_CODE = r"(?=[\p{L}/._-]*\d)[\p{L}\d][\p{L}\d./_-]{1,25}"
_LINE = r"[^\n;]{2,120}"
_SERIES_NUMBER = r"\d{2}\s?\d{2}\s?(?:№\s?)?\d{6}"
_ACT = r"[IVX]{1,4}\s?[-–—]\s?\p{IsCyrillic}{2}\s?(?:№\s?)?\d{6}"
_NAME = r"(?-i:\p{Lu}[\p{Ll}-]+(?:\s+\p{Lu}[\p{Ll}-]+){0,2})"
_DAY = r"(?:0?[1-9]|[12]\d|3[01])\s?[./-]\s?(?:0?[1-9]|1[0-2])\s?[./-]\s?(?:19|20)\d{2}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"


def _phone(value: Column) -> Column:
    return F.length(C.digits_of(value)).isin(10, 11) & ~value.rlike(rf"^{_DAY}$")


#: Captions in their usual cases and the shapes that identifiers and forms have.
FIELDS: tuple[Field, ...] = (
    Field("INN", "инн", r"инн(?:\s*/\s*кпп)?(?:\s+(?:банка|организации|плательщика|получателя|поставщика|покупателя|заказчика|исполнителя))?", rf"(?:{_DIGITS(12)}|{_DIGITS(10)})"),
    Field("KPP", "кпп", rf"(?:инн\s*/\s*кпп\s*:?\s*\d{{10,12}}\s*/|кпп)", _DIGITS(9)),
    Field("OGRNIP", "огрн", r"огрн(?:ип)?", _DIGITS(15), C.valid_ogrn),
    Field("OGRN", "огрн", r"огрн", _DIGITS(13), C.valid_ogrn),
    Field("BIK", "бик", r"бик(?:\s+(?:банка|отделения|филиала)(?:\s+получателя)?)?", _DIGITS(9)),
    Field("SNILS", "снилс", r"снилс", r"\d{3}[ -]?\d{3}[ -]?\d{3}[ -]?\d{2}"),
    Field("RU_CORR_ACCOUNT", "с", r"(?:к\s?/\s?с|кор(?:р(?:еспондентск(?:ий|ого|ом))?)?\.?\s*сч[её]т[аеу]?)(?:\s+банка)?", _DIGITS(20)),
    Field("RU_ACCOUNT", "с", r"(?:р\s?/\s?с|(?:расч[её]тн|казначейск)(?:ый|ий|ого|ом)\s+сч[её]т[аеу]?|сч[её]т[аеу]?\s+получателя)", _DIGITS(20)),
    Field("PERSONAL_ACCOUNT", "с", r"(?:л\s?/\s?с|лицев(?:ой|ого|ом)\s+сч[её]т[аеу]?)", r"\d{8,25}"),
    Field("IBAN", "iban", r"iban", r"[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]){11,30}", C.valid_iban),
    Field("SWIFT", "swift", r"swift(?:\s*/\s*bic)?(?:[ -](?:код|code))?", r"[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?", C.valid_swift),
    Field("BANK_CARD", "карт", r"(?:номер\s+)?(?:банковск(?:ой|ая)\s+)?карт[аы]", _DIGITS(16, 19), C.valid_luhn),
    Field("PASSPORT", "паспорт", r"(?:паспорт(?:а|ные\s+данные)?)(?:\s+гражданина\s+рф)?", _SERIES_NUMBER),
    Field("PASSPORT_SERIES", "сери", r"сери[яи]\s+паспорта", r"\d{2}\s?\d{2}"),
    Field("PASSPORT_NUMBER", "паспорт", r"(?:номер\s+паспорта|паспорт\s*№)", r"\d{6}"),
    Field("PASSPORT_DIVISION_CODE", "код", r"код\s+подр(?:азделени[яйею]|\.)", r"\d{3}[- ]\d{3}"),
    Field("FOREIGN_PASSPORT", "загран", r"загран(?:ичн(?:ый|ого)\s+)?паспорт[а]?", r"\d{2}\s?№?\s?\d{7}"),
    Field("DRIVER_LICENSE", "удостоверени", r"водительск(?:ое|ого)\s+удостоверени[ея]", _SERIES_NUMBER),
    Field("MILITARY_ID", "военн", r"военн(?:ый|ого)\s+билет[а]?", r"\p{IsCyrillic}{1,3}\s?№?\s?\d{6,8}"),
    Field("RESIDENCE_PERMIT", "на жительство", r"вид[а]?\s+на\s+жительство", r"\d{2}\s?№?\s?\d{7}"),
    Field("MIGRATION_CARD", "миграцион", r"миграционн(?:ая|ой)\s+карт[аы]", r"[\p{L}\d]{2}\s?№?\s?\d{7,9}"),
    Field("VISA_NUMBER", "виз", r"(?:номер\s+)?виз[аы]", r"[A-Z0-9][A-Z0-9./-]{3,19}", V.visa),
    Field("WORK_PERMIT", "на работу", r"(?:разрешени[ея]|патент[а]?)\s+на\s+работу", r"(?=[\p{L}./-]*\d)[\p{L}\d][\p{L}\d./-]{4,19}"),
    Field("BIRTH_CERTIFICATE", "рождени", r"свидетельств[оа]\s+о\s+рождении", _ACT),
    Field("MARRIAGE_CERTIFICATE", "брак", r"свидетельств[оа]\s+о\s+(?:заключении\s+)?брак[ае]", _ACT),
    Field("DIVORCE_CERTIFICATE", "расторжени", r"свидетельств[оа]\s+о\s+расторжении\s+брака", _ACT),
    Field("DEATH_CERTIFICATE", "смерт", r"свидетельств[оа]\s+о\s+смерти", _ACT),
    Field("NAME_CHANGE_CERTIFICATE", "перемен", r"свидетельств[оа]\s+о\s+перемене\s+имени", _ACT),
    Field("PATERNITY_CERTIFICATE", "отцовств", r"свидетельств[оа]\s+об\s+установлении\s+отцовства", _ACT),
    Field("ADOPTION_CERTIFICATE", "усыновлени", r"свидетельств[оа]\s+об\s+усыновлении", _ACT),
    Field("CIVIL_STATUS_ACT", "записи акта", r"(?:номер\s+)?записи\s+акта\s+гражданского\s+состояния", r"\d{1,10}"),
    Field("CADASTRAL_NUMBER", "кадастр", r"кадастров(?:ый|ого)\s+номер[а]?", r"\d{1,3}:\d{1,3}:\d{1,7}:\d{1,7}"),
    Field("EGRN_RECORD_NUMBER", "егрн", r"запис[ьи]\s+(?:в\s+)?егрн", r"\d{2}-\d{2}/\d{3}-\d{4,8}/\d{2,4}"),
    Field("PROPERTY_RIGHT_NUMBER", "регистрации права", r"(?:номер\s+)?государственной\s+регистрации\s+права", r"\d{2}:\d{2}:\d{6,12}-\d{2}/\d{2,4}-\d{1,6}"),
    Field("PROPERTY_CONDITIONAL_NUMBER", "условн", r"условн(?:ый|ого)\s+номер[а]?(?:\s+объекта)?", r"[\p{L}\d][\p{L}\d:/_-]{3,30}"),
    Field("VEHICLE_VIN", "vin", r"vin", r"[A-HJ-NPR-Z0-9]{17}"),
    Field("VEHICLE_PLATE", "номер", r"(?:гос\.?\s?номер|номер\s+автомобиля|регистрационный\s+знак)", r"\p{L}\d{3}\p{L}{2}\s?\d{2,3}"),
    Field("PTS_NUMBER", "птс", r"птс", _SERIES_NUMBER),
    Field("STS_NUMBER", "стс", r"стс", _SERIES_NUMBER),
    Field("LAWYER_ID_NUMBER", "адвокат", r"(?:удостоверени[ея]\s+адвоката|адвокатское\s+удостоверение)", r"(?:[\p{L}\d-]{1,8}\s*№?\s*)?\d{4,10}"),
    Field("LAWYER_REGISTRY_NUMBER", "адвокат", r"(?:реестровый\s+номер\s+адвоката|номер\s+адвоката\s+в\s+реестре)", r"\d{1,10}(?:/[\p{L}\d-]{1,10})?"),
    Field("PATENT_ATTORNEY_NUMBER", "поверенн", r"номер\s+патентного\s+поверенного", r"\d{3,8}"),
    Field("TOUR_OPERATOR_REGISTRY_NUMBER", "реестр", r"реестров(?:ый|ого)\s+номер[а]?(?:\s+туроператора)?", r"(?:РТО|МВТ|ВНТ|МТ3)?\s?[-–—]?\s?\d{5,7}", V.tour_operator_number),
    Field("COURT_CASE_NUMBER", "дел", r"(?:(?:судебн|гражданск|арбитражн|административн)(?:ое|ого|ому)\s+)?дел[оауе]", r"\p{L}?\d{1,3}-\d{1,8}/\d{2,4}", V.court_case),
    Field("CRIMINAL_CASE_NUMBER", "уголовн", r"(?:номер\s+)?уголовн(?:ое|ого|ому)\s+дел[оау]", r"\d{1,5}-\d{1,8}/\d{2,4}"),
    Field("KUSP_NUMBER", "кусп", r"кусп", r"\d{4,12}"),
    Field("ENFORCEMENT_PROCEEDING_NUMBER", "исполнительн", r"исполнительн(?:ое|ого)\s+производств[оа]", r"\d{1,10}/\d{2}/\d{2,6}-ИП"),
    Field("NOTARY_REGISTER_NUMBER", "реестр", r"(?:нотариальн(?:ый|ого)\s+реестр[а]?|зарегистрирован[ао]?\s+в\s+реестре)", r"\d{1,12}(?:[-/][\p{L}\d-]{1,20}){0,5}"),
    Field("POWER_OF_ATTORNEY_NUMBER", "доверенност", r"(?<!без\s)(?:номер\s+)?доверенност[ьи]", _CODE, V.power_of_attorney),
    Field("PATENT_NUMBER", "патент", r"(?:номер\s+)?патент[а]?(?:\s+на\s+изобретение)?", r"\d{4,10}"),
    Field("PATENT_APPLICATION_NUMBER", "заявк", r"(?:номер\s+)?заявк[аи]\s+на\s+(?:изобретение|патент)", r"\d{8,12}"),
    Field("TRADEMARK_NUMBER", "товарн", r"(?<!на\s)товарн(?:ый|ого)\s+знак[а]?", r"\d{4,10}"),
    Field("TRADEMARK_APPLICATION_NUMBER", "заявк", r"(?:номер\s+)?заявк[аи]\s+на\s+товарный\s+знак", r"\d{8,12}"),
    Field("INDUSTRIAL_DESIGN_NUMBER", "образ", r"промышленн(?:ый|ого)\s+образ(?:ец|ца)", r"\d{4,10}"),
    Field("UTILITY_MODEL_NUMBER", "модел", r"полезн(?:ая|ой)\s+модел[ьи]", r"\d{4,10}"),
    Field("SOFTWARE_REGISTRATION_NUMBER", "эвм", r"программ[аы]?\s+для\s+эвм", r"\d{6,12}"),
    Field("DATABASE_REGISTRATION_NUMBER", "баз", r"регистрации\s+базы\s+данных", r"\d{6,12}"),
    Field("TOPOLOGY_REGISTRATION_NUMBER", "тополог", r"регистрации\s+топологии", r"\d{4,12}"),
    Field("WIPO_APPLICATION_NUMBER", "международн", r"международн(?:ая|ой)\s+заявк[аи]", r"PCT/[A-Z]{2}\d{4}/\d{5}"),
    Field("PRIORITY_APPLICATION_NUMBER", "приоритетн", r"приоритетн(?:ая|ой)\s+заявк[аи]", r"\p{L}{0,2}\d{6,12}"),
    Field("OMS_POLICY", "омс", r"(?:полис[а]?\s+)?омс", r"\d{16}"),
    Field("DMS_POLICY", "дмс", r"(?:полис[а]?\s+)?дмс", r"(?=[\p{L}-]*\d)[\p{L}\d][\p{L}\d-]{5,20}"),
    Field("INSURANCE_POLICY", "полис", r"страхов(?:ой|ого)\s+полис[а]?", r"[\p{L}\d][\p{L}\d./-]{4,24}", V.insurance_policy),
    Field("MEDICAL_RECORD_NUMBER", "медицинск", r"медицинск(?:ая|ой)\s+карт[аы]", _CODE),
    Field("DISABILITY_CERTIFICATE", "инвалидност", r"справк[аи]\s+об\s+инвалидности", _CODE),
    Field("SICK_LEAVE_NUMBER", "нетрудоспособност", r"лист(?:ок|ка)\s+нетрудоспособности", r"\d{10,16}"),
    Field("CONTRACT_NUMBER", "", r"(?:договор|контракт)(?:а|у|ом|е)?(?:\s+\p{L}+){0,4}?(?:\s+от\s+\d{2}\.\d{2}\.\d{4})?\s*(?:№|N|номер)", _CODE, V.contract_number),
    Field("DOCUMENT_NUMBER", "приказ", r"приказ[аеу]?(?:\s+от\s+\d{2}\.\d{2}\.\d{4})?\s*№", r"(?=[\p{L}/._-]*\d)[\p{L}\d][\p{L}\d./_-]{0,25}", V.contract_number),
    Field("CLIENT_NUMBER", "клиент", r"номер\s+клиента", _CODE),
    Field("ORDER_NUMBER", "", r"(?:номер\s+(?:заказа|бронирования)|(?:заказ[ау]?|бронировани[ея]|ваучер[а]?)\s*(?:№|номер))", _CODE),
    Field("IP_ADDRESS", "ip", r"ip[- ]?адрес", rf"{_OCTET}(?:\.{_OCTET}){{3}}"),
    Field("MAC_ADDRESS", "mac", r"mac[- ]?адрес", r"(?:[0-9A-F]{2}[:-]){5}[0-9A-F]{2}"),
    Field("USER_ACCOUNT", "логин", r"(?:логин|идентификатор\s+пользователя)", r"[\p{L}\d_.@-]{3,40}"),
    Field("TELEGRAM_NICK", "телеграм", r"телеграм(?:[ -](?:аккаунт|логин))?", r"@[A-Za-z0-9_]{4,32}"),
    Field("SOCIAL_NETWORK_ID", "социальн", r"идентификатор\s+социальной\s+сети", r"\d{4,20}"),
    Field("MESSENGER_ID", "мессенджер", r"идентификатор\s+мессенджера", r"[A-Za-z0-9_-]{4,32}"),
    Field("PHONE_NUMBER", "тел", r"(?:(?:номер\s+)?(?:мобильного\s+)?телефон[а]?|тел\.)", r"(?:\+?7|8)?[ \u00a0().-]*\d(?:[ \u00a0().-]*\d){9,10}", _phone),
    Field("INCOME", "доход", r"(?:размер\s+)?доход[а]?", r"\d[\d ]{0,14}(?:[.,]\d{2})?\s*(?:руб(?:лей|\.)?|₽)"),
    Field("BIRTH_DATE", "рождени", r"дата\s+рождения", _DAY),
    Field("ADDRESS", "адрес", r"(?:(?:юридическ|фактическ|почтов)(?:ий|ый|ого)\s+адрес|адрес\s+(?:регистрации|места\s+(?:нахождения|жительства)))", r"[^\n;]{5,300}?(?=\s*(?:$|[\n;]|\b(?:инн|кпп|огрн|бик|тел|банк)\b))", V.address_field, True),
    Field("BIRTH_PLACE", "рождени", r"место\s+рождения", _LINE, V.birth_place, True),
    Field("CITIZENSHIP", "гражданств", r"гражданство", r"\p{L}[\p{L}\d .'-]{1,79}", V.citizenship, True),
    Field("JOB_TITLE", "должност", r"должность", r"[^\n;]{2,100}", V.job_title, True),
    Field("EMPLOYER", "работ", r"(?:место\s+работы|работодатель)", _LINE, V.employer, True),
    Field("RELATIVE", "родств", r"(?:родственная\s+связь|сведения\s+о\s+родственнике)", _LINE, None, True),
    Field("EDUCATION", "образовани", r"(?<!муниципальное\s)образование", _LINE, None, True),
    Field("DIAGNOSIS", "диагноз", r"диагноз", r"[^\n;,.]{2,80}", None, True),
    Field("HEALTH_INFORMATION", "здоров", r"сведения\s+о\s+состоянии\s+здоровья", _LINE, None, True),
    Field("CRIMINAL_RECORD", "судимост", r"(?:сведения\s+о\s+судимости|судимость)", _LINE, None, True),
    Field("NATIONALITY", "национальност", r"национальность", r"[^\n;]{2,80}", None, True),
    Field("RELIGION", "вероисповедани", r"вероисповедание", _LINE, None, True),
    Field("POLITICAL_INFO", "политическ", r"политические\s+взгляды", _LINE, None, True),
    Field("BIOMETRIC_DATA", "биометр", r"биометрические\s+данные", _LINE, None, True),
    Field("PER", "фио", r"фио", _NAME, V.person_field),
    Field("PERSON_SALUTATION", "", r"(?:уважаем(?:ый|ая)|господин|госпожа)", _NAME, V.person_field),
    Field("EIK_BULSTAT", "булстат", r"булстат", r"\d{9,10}|\d{13}"),
)


def pattern_of(field: Field) -> str:
    """The field's pattern; its one group is the value."""
    between = _BEFORE_WORDS if field.free else _BETWEEN
    end = "" if field.free else _END
    return rf"(?iU){_EDGE}(?:{field.captions}){between}({field.value}){end}"


def field_spans(docs: DataFrame, fields: tuple[Field, ...] = FIELDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, start, end, text and label of every field's value.

    Trailing marks and spaces don't belong to a value; a value that its check refuses is none.  A passport
    that overlaps its own series or number is left out for them.  Equal spans of a label count once.
    Null texts have no values; repeated ids are told apart by ``row``.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull()).withColumn("row", row_key(F.col("_text")))
    rows = rows.withColumn("_low", F.lower("_text"))
    occurs = [F.when(F.contains("_low", F.lit(f.stem)) & F.col("_text").rlike(pattern_of(f)), F.struct(F.lit(i).alias("field"), F.lit(pattern_of(f)).alias("pattern"))) for i, f in enumerate(fields)]
    each = rows.select("doc_id", "row", "_text", F.explode(F.array_compact(F.array(*occurs))).alias("o")).select("doc_id", "row", "_text", "o.*")
    cut = each.select(
        "doc_id", "row", "field", F.regexp_extract_all("_text", F.col("pattern"), F.lit(0)).alias("found"), F.regexp_extract_all("_text", F.col("pattern"), F.lit(1)).alias("values"), F.split("_text", F.col("pattern"), -1).alias("gaps"),
    )

    def value(s: Column, v: Column) -> Column:
        kept = F.regexp_replace(v, r"[\s|.,;]+\z", "")
        start = s["end"] - F.char_length(v)
        return F.struct(start.alias("start"), (start + F.char_length(kept)).alias("end"), kept.alias("text"))

    each = cut.select("doc_id", "row", "field", F.explode(F.zip_with(placed(F.col("found"), F.col("gaps")), "values", value)).alias("v")).select("doc_id", "row", "field", "v.*").where("end > start")
    good = F.lit(True)
    for i, f in reversed([*enumerate(fields)]):
        if f.check:
            good = F.when(F.col("field") == i, f.check(F.col("text"))).otherwise(good)
    labels = F.array(*[F.lit(f.label) for f in fields])
    spans = each.where(good).select("doc_id", "row", "start", "end", "text", F.get(labels, F.col("field")).alias("label")).dropDuplicates(["doc_id", "row", "start", "end", "label"])
    parts = spans.where(F.col("label").isin("PASSPORT_SERIES", "PASSPORT_NUMBER")).select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    whole = (F.col("label") == "PASSPORT") & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r")) & (F.greatest("start", "_s") < F.least("end", "_e"))
    return spans.join(parts, whole, "left_anti")
