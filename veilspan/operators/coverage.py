"""Synthetic records for every label: valid values and hard negatives in sentences, fields and tables, each
with its span, from an index alone.

A spec is a label, its group, the cue that stands before the value, its kind and a format: plain text with
``{width:base}`` (base + index, padded), ``{width:base:modulus}`` (base + index modulo that) or one of the
builders with check digits.  Splits have templates of their own, so no sentence pattern is shared.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators import synthetic as S

SEED, POSITIVES, NEGATIVES = "veilspan-coverage-1", 200, 40


@dataclass(frozen=True)
class Spec:
    label: str
    group: str
    cue: str
    format: str
    kind: str = "text"


def _specs(group: str, *rows: tuple[str, ...]) -> list[Spec]:
    return [Spec(r[0], group, *r[1:]) for r in rows]


#: Labels, cues and made-up values of their shapes.
SPECS: tuple[Spec, ...] = (
    *_specs("identity", ("PER", "фамилия, имя и отчество", "Образцов{4:0} Пример Примерович"), ("ORG", "наименование организации", "ООО «Пример {4:0}»"), ("ADDRESS", "адрес регистрации", "г. Образцов-{4:0}, ул. Учебная, д. {1:1}"),
            ("PHONE_NUMBER", "номер телефона", "+7 (900) {3:100:900}-{2:0:100}-17"), ("EMAIL", "адрес почты", "sample-{4:0}@example.invalid"), ("WEBSITE", "адрес сайта", "https://example.invalid/{4:0}"), ("SNILS", "СНИЛС", "@snils", "digits"),
            ("PASSPORT", "серия и номер паспорта", "77 01 {6:100000}"), ("FOREIGN_PASSPORT", "заграничный паспорт", "70 {7:1000000}"), ("DRIVER_LICENSE", "водительское удостоверение", "77 02 {6:100000}"), ("MILITARY_ID", "военный билет", "АБ {7:1000000}"),
            ("RESIDENCE_PERMIT", "вид на жительство", "82 {7:1000000}"), ("MIGRATION_CARD", "миграционная карта", "АБ {8:10000000}"), ("VISA_NUMBER", "номер визы", "AB{6:100000}"), ("PASSPORT_SERIES", "серия паспорта", "{4:4500:99}", "digits"),
            ("PASSPORT_NUMBER", "номер паспорта", "{6:200000}", "digits"), ("PASSPORT_DIVISION_CODE", "код подразделения", "{3:100}-{3:200}"), ("PERSON_SALUTATION", "обращение", "Пример Образцов-{4:0}")),
    *_specs("tax", ("INN", "ИНН", "@inn", "digits"), ("KPP", "КПП", "77{7:1000000}", "digits"), ("OGRN", "ОГРН", "@ogrn", "digits"), ("OGRNIP", "ОГРНИП", "@ogrnip", "digits"), ("EIK_BULSTAT", "БУЛСТАТ", "{9:100000000}", "digits")),
    *_specs("bank", ("BIK", "БИК", "0445{5:10000}", "digits"), ("RU_ACCOUNT", "расчётный счёт", "40702810{12:100000000000}", "digits"), ("RU_CORR_ACCOUNT", "корреспондентский счёт", "30101810{12:400000000000}", "digits"), ("BANK_CARD", "номер карты", "@card", "digits"),
            ("IBAN", "IBAN", "@iban", "digits"), ("SWIFT", "SWIFT", "DEUTDEDD{3:100:900}"), ("PERSONAL_ACCOUNT", "лицевой счёт", "40817{15:100000000000000}", "digits")),
    *_specs("civil_status", *((label, cue, "IV-АБ {6:" + str(100000 + 1000 * k) + "}") for k, (label, cue) in enumerate((("BIRTH_CERTIFICATE", "свидетельство о рождении"), ("MARRIAGE_CERTIFICATE", "свидетельство о заключении брака"),
            ("DIVORCE_CERTIFICATE", "свидетельство о расторжении брака"), ("DEATH_CERTIFICATE", "свидетельство о смерти"), ("NAME_CHANGE_CERTIFICATE", "свидетельство о перемене имени"), ("PATERNITY_CERTIFICATE", "свидетельство об установлении отцовства"),
            ("ADOPTION_CERTIFICATE", "свидетельство об усыновлении")))), ("CIVIL_STATUS_ACT", "номер записи акта гражданского состояния", "{5:10000}")),
    *_specs("property", ("CADASTRAL_NUMBER", "кадастровый номер", "77:{2:1:99}:{7:1000000}:{4:1000}", "cadastral"), ("EGRN_RECORD_NUMBER", "запись ЕГРН", "77-77/001-{7:1000000}/2024"), ("PROPERTY_RIGHT_NUMBER", "номер государственной регистрации права", "77:01:{7:1000000}-01/2024-{1:1}"),
            ("PROPERTY_CONDITIONAL_NUMBER", "условный номер объекта", "77:01:АБ-{4:1000}")),
    *_specs("vehicle", ("VEHICLE_VIN", "VIN", "XTA21099{9:100000000}", "vin"), ("VEHICLE_PLATE", "госномер", "А{3:100}ВС77"), ("PTS_NUMBER", "ПТС", "77 03 {6:100000}"), ("STS_NUMBER", "СТС", "77 04 {6:100000}")),
    *_specs("profession", ("LAWYER_ID_NUMBER", "удостоверение адвоката", "77-АБ {6:100000}"), ("LAWYER_REGISTRY_NUMBER", "реестровый номер адвоката", "{6:100000}/77"), ("PATENT_ATTORNEY_NUMBER", "номер патентного поверенного", "{6:300000}"),
            ("NOTARY_REGISTER_NUMBER", "нотариальный реестр", "{6:400000}"), ("POWER_OF_ATTORNEY_NUMBER", "доверенность", "Д-{4:1000}/24"), ("TOUR_OPERATOR_REGISTRY_NUMBER", "реестровый номер туроператора", "РТО-{5:10000}"), ("WORK_PERMIT", "разрешение на работу", "АВ-{6:100000}")),
    *_specs("proceeding", ("COURT_CASE_NUMBER", "дело", "А40-{5:10000}/2024"), ("CRIMINAL_CASE_NUMBER", "уголовное дело", "123-{4:1000}/2024"), ("KUSP_NUMBER", "КУСП", "{6:500000}"), ("ENFORCEMENT_PROCEEDING_NUMBER", "исполнительное производство", "{5:10000}/24/77001-ИП")),
    *_specs("ip", ("PATENT_NUMBER", "номер патента", "{7:2700000}"), ("PATENT_APPLICATION_NUMBER", "заявка на изобретение", "{10:2023000000}"), ("TRADEMARK_NUMBER", "товарный знак", "{6:700000}"), ("TRADEMARK_APPLICATION_NUMBER", "заявка на товарный знак", "{10:2024000000}"),
            ("INDUSTRIAL_DESIGN_NUMBER", "промышленный образец", "{6:110000}"), ("UTILITY_MODEL_NUMBER", "полезная модель", "{6:120000}"), ("SOFTWARE_REGISTRATION_NUMBER", "программа для ЭВМ", "{10:2025000000}"), ("DATABASE_REGISTRATION_NUMBER", "регистрация базы данных", "{10:2026000000}"),
            ("TOPOLOGY_REGISTRATION_NUMBER", "регистрация топологии", "{6:130000}"), ("WIPO_APPLICATION_NUMBER", "международная заявка", "PCT/RU2024/{5:10000}"), ("PRIORITY_APPLICATION_NUMBER", "приоритетная заявка", "RU{10:2027000000}")),
    *_specs("medical", ("OMS_POLICY", "полис ОМС", "77{14:10000000000000}", "digits"), ("DMS_POLICY", "полис ДМС", "ДМС-{6:100000}"), ("INSURANCE_POLICY", "страховой полис", "ААВ-{6:100000}"), ("MEDICAL_RECORD_NUMBER", "медицинская карта", "МК-{6:100000}"),
            ("DISABILITY_CERTIFICATE", "справка об инвалидности", "МСЭ-{6:100000}"), ("SICK_LEAVE_NUMBER", "листок нетрудоспособности", "{12:100000000000}"), ("DIAGNOSIS", "диагноз", "условное состояние {4:0}"), ("HEALTH_INFORMATION", "сведения о состоянии здоровья", "условные сведения {4:0}")),
    *_specs("contract", ("CONTRACT_NUMBER", "номер договора", "Д-{4:1000}/24"), ("DOCUMENT_NUMBER", "номер приказа", "{4:1000}-к"), ("CLIENT_NUMBER", "номер клиента", "К-{4:1000}"), ("ORDER_NUMBER", "номер заказа", "З-{4:1000}")),
    *_specs("digital", ("IP_ADDRESS", "IP-адрес", "192.0.2.{1:1:200}", "ipaddr"), ("MAC_ADDRESS", "MAC-адрес", "02:00:00:00:01:{2:0:100}", "ipaddr"), ("USER_ACCOUNT", "логин", "sample_{4:0}"), ("TELEGRAM_NICK", "телеграм", "@sample_{4:0}"),
            ("SOCIAL_NETWORK_ID", "идентификатор социальной сети", "{8:10000000}"), ("MESSENGER_ID", "идентификатор мессенджера", "chat-{4:0}")),
    *_specs("context", ("BIRTH_DATE", "дата рождения", "{2:1:28}.05.{4:1970:50}"), ("BIRTH_PLACE", "место рождения", "город Образцов-{4:0}"), ("CITIZENSHIP", "гражданство", "Республика Образец-{4:0}"), ("JOB_TITLE", "должность", "инженер участка {4:0}"), ("EMPLOYER", "место работы", "АО Образец-{4:0}"),
            ("RELATIVE", "родственная связь", "условный родственник {4:0}"), ("EDUCATION", "образование", "училище {4:0}"), ("INCOME", "доход", "{5:10000} руб"), ("CRIMINAL_RECORD", "судимость", "условная запись {4:0}"), ("NATIONALITY", "национальность", "условная {4:0}"),
            ("RELIGION", "вероисповедание", "условное {4:0}"), ("POLITICAL_INFO", "политические взгляды", "условные {4:0}"), ("BIOMETRIC_DATA", "биометрические данные", "условный снимок {4:0}"), ("DATE", "дата", "{2:1:28}.06.2024")),
)

#: Name, layout and the text before the cue, between cue and value, and behind the value.
TEMPLATES: dict[str, tuple[tuple[str, str, str, str, str], ...]] = {
    "train": (("prose_1", "prose", "Стороны записали: ", " – ", "."), ("prose_2", "prose", "Как следует из справки, ", " имеет значение ", "; возражений нет."), ("field_1", "field", "", "\t", ""), ("row_1", "table", "| ", " | ", " |"), ("row_2", "table", "", "\t", "\n")),
    "dev": (("prose_3", "prose", "Заявитель назвал (", ") ", "."), ("field_2", "field", "", ":\n", ""), ("row_3", "table", "№ 1\t", "\t", "")),
    "test": (("prose_4", "prose", "В описи под словом «", "» стоит ", "."), ("field_3", "field", "Поле «", "» | ", ""), ("row_4", "table", "Таблица: ", "\t", "")),
}
#: Values that a cue may stand before without there being one, by kind.
NEGATIVE_VALUES = {
    "text": ("не указано", "нет сведений", "сбой", "N/A", "неполный"), "digits": ("123", "000", "123456789012345678901", "не заполнено", "12-34"), "cadastral": ("77:0:1", "номера нет", "77-01-000000-000000", "не определён", "77:01:АБВ"),
    "vin": ("VIN", "123", "OOOOOOOOOOOOOOOOO", "не указан", "X0"), "ipaddr": ("999.999.999.999", "192.0.2", "localhost", "не указан", "10.0.0.999"),
}

BUILDERS: dict[str, Callable[[Column], Column]] = {
    "@inn": lambda i: S.with_tax_digit(F.concat(F.lit("77"), S.digits(SEED, "INN", i, 7))),
    "@ogrn": lambda i: S.with_registration_digit(F.concat(F.lit("1"), S.digits(SEED, "OGRN", i, 11))),
    "@ogrnip": lambda i: S.with_registration_digit(F.concat(F.lit("3"), S.digits(SEED, "OGRNIP", i, 13)), person=True),
    "@snils": lambda i: S.with_insurance_digits(F.lpad((i + 100_000_001).cast("string"), 9, "0")),
    "@card": lambda i: S.with_luhn_digit(F.concat(F.lit("411111"), S.digits(SEED, "CARD", i, 9))),
    "@iban": lambda i: _iban(F.concat(F.lit("37040044053201"), F.lpad(i.cast("string"), 4, "0"))),
}


def _iban(body: Column) -> Column:
    left = F.concat(body, F.lit("131400")).cast("decimal(30,0)") % F.lit(97)
    return F.concat(F.lit("DE"), F.lpad((F.lit(98) - left).cast("int").cast("string"), 2, "0"), body)


def parts_of(text: str) -> list[str | tuple[int, int, int | None]]:
    """A format as plain texts and (width, base, modulus or null)."""
    out: list = []
    for plain, field in re.findall(r"([^{]*)(?:\{([^}]*)\})?", text):
        if plain:
            out.append(plain)
        if field:
            n = [int(x) for x in field.split(":")]
            out.append((n[0], n[1], n[2] if len(n) > 2 else None))
    return out


def value_of(spec: Spec, index: Column) -> Column:
    """The made-up value of a label and an index."""
    if spec.format in BUILDERS:
        return BUILDERS[spec.format](index)
    cell = lambda p: F.lit(p) if isinstance(p, str) else F.when(F.char_length(n := (F.lit(p[1]).cast("long") + (index if p[2] is None else index % p[2])).cast("string")) < p[0], F.lpad(n, p[0], "0")).otherwise(n)
    return F.concat(*map(cell, parts_of(spec.format)))


def record_id(label: Column, kind: str, index: Column) -> Column:
    return F.concat(F.lit("cov_"), F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), label, F.lit(f":{kind}:"), index.cast("string")), 256), 1, 16))


def _template(split: Column, turn: Column) -> Column:
    names = ("name", "layout", "before", "between", "after")
    kinds = {k: F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, t, strict=True)]) for t in ts]) for k, ts in TEMPLATES.items()}
    pick = lambda k: F.element_at(kinds[k], (turn % len(TEMPLATES[k]) + 1).cast("int"))
    return F.when(split == "train", pick("train")).when(split == "dev", pick("dev")).otherwise(pick("test"))


def _records(rows: DataFrame, kind: str) -> DataFrame:
    """Records of rows (index, split, spec: label, group, cue, value)."""
    turn = F.col("index") if kind == "pos" else F.floor(F.col("index") / 3)  # a split's negatives are every third
    rows = rows.withColumn("t", _template(F.col("split"), turn))
    head = F.concat("t.before", "spec.cue", "t.between")
    return rows.select(
        record_id(F.col("spec.label"), kind, F.col("index")).alias("id"), "spec.label", "spec.group", "split", F.concat("split", F.lit(":"), F.lit("" if kind == "pos" else "negative_"), "t.name").alias("template_id"),
        F.concat(head, "spec.value", "t.after").alias("text"), F.col("spec.value").alias("surface"), F.char_length(head).alias("start"), (F.char_length(head) + F.char_length("spec.value")).alias("end"),
        "t.layout", F.lit(kind == "neg").alias("negative"), F.lit(True).alias("synthetic"),
    )


def _each(indexes: DataFrame, specs: tuple[Spec, ...], value: Callable[[Spec], Column]) -> DataFrame:
    every = F.array(*[F.struct(F.lit(s.label).alias("label"), F.lit(s.group).alias("group"), F.lit(s.cue).alias("cue"), value(s).alias("value")) for s in specs])
    return indexes.select("index", "split", F.explode(every).alias("spec"))


def positives(spark: SparkSession, specs: tuple[Spec, ...] = SPECS, n: int = POSITIVES) -> DataFrame:
    """``n`` records of each label with a valid value; the first 140 of 200 are for training, 30 each for
    development and test."""
    i = spark.range(n).withColumnRenamed("id", "index")
    return _records(_each(i.withColumn("split", S.split_of_index(F.col("index"))), specs, lambda s: value_of(s, F.col("index"))), "pos")


def negatives(spark: SparkSession, specs: tuple[Spec, ...] = SPECS, n: int = NEGATIVES) -> DataFrame:
    """``n`` records of each label whose cue stands before something that is no value."""
    i = spark.range(n).withColumnRenamed("id", "index")
    i = i.withColumn("split", F.element_at(F.array(*map(F.lit, ("train", "dev", "test"))), (F.col("index") % 3 + 1).cast("int")))
    return _records(_each(i, specs, lambda s: F.element_at(F.array(*map(F.lit, NEGATIVE_VALUES[s.kind])), (F.col("index") % 5 + 1).cast("int"))), "neg")


def write_coverage(records: DataFrame, path: str) -> None:
    """Records as JSON lines, a folder for each split."""
    records.write.partitionBy("split").mode("errorifexists").json(path)
