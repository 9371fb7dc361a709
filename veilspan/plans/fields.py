"""Queries of labelled fields over sentences made from the orders' keys, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators import fields as L

#: label, text before the value (a caption of it and a mark) and the value; made up for this query.
SAMPLES = (
    ("INN", "ИНН: ", "7707083893"), ("INN", "инн получателя № ", "500100732259"), ("KPP", "КПП ", "770701001"), ("OGRN", "ОГРН: ", "1027700132195"), ("BIK", "БИК банка ", "044525225"), ("SNILS", "СНИЛС: ", "112-233-445 95"),
    ("RU_CORR_ACCOUNT", "к/с ", "30101810400000000225"), ("RU_ACCOUNT", "расчётный счёт: ", "40702810900000000001"), ("PERSONAL_ACCOUNT", "лицевой счёт ", "123456789"), ("IBAN", "IBAN ", "GB82 WEST 1234 5698 7654 32"), ("SWIFT", "SWIFT-код: ", "DEUTDEFF500"),
    ("BANK_CARD", "номер карты ", "4111 1111 1111 1111"), ("PASSPORT", "паспорт: ", "45 09 123456"), ("PASSPORT_DIVISION_CODE", "код подразделения ", "770-001"), ("FOREIGN_PASSPORT", "загранпаспорт ", "70 1234567"), ("DRIVER_LICENSE", "водительское удостоверение ", "77 01 123456"),
    ("MILITARY_ID", "военный билет ", "АБ 1234567"), ("RESIDENCE_PERMIT", "вид на жительство: ", "82 1234567"), ("MIGRATION_CARD", "миграционная карта ", "АБ 12345678"), ("VISA_NUMBER", "номер визы: ", "AB123456"), ("WORK_PERMIT", "разрешение на работу ", "AB-123456"),
    ("BIRTH_CERTIFICATE", "свидетельство о рождении ", "IV-АБ 123456"), ("MARRIAGE_CERTIFICATE", "свидетельство о заключении брака: ", "II-МЮ 654321"), ("DIVORCE_CERTIFICATE", "свидетельство о расторжении брака ", "I-АГ 111222"), ("DEATH_CERTIFICATE", "свидетельство о смерти ", "V-ИК 121212"),
    ("NAME_CHANGE_CERTIFICATE", "свидетельство о перемене имени ", "I-АВ 101010"), ("PATERNITY_CERTIFICATE", "свидетельство об установлении отцовства ", "I-АД 202020"), ("ADOPTION_CERTIFICATE", "свидетельство об усыновлении ", "I-АЕ 303030"), ("CIVIL_STATUS_ACT", "номер записи акта гражданского состояния ", "10234"),
    ("CADASTRAL_NUMBER", "кадастровый номер: ", "77:01:0001001:1024"), ("EGRN_RECORD_NUMBER", "запись ЕГРН ", "77-77/001-1000001/2024"), ("PROPERTY_RIGHT_NUMBER", "номер государственной регистрации права ", "77:01:1000001-01/2024-7"), ("PROPERTY_CONDITIONAL_NUMBER", "условный номер объекта ", "77:01:АБ-1001"),
    ("VEHICLE_VIN", "VIN ", "XTA210990Y1234567"), ("VEHICLE_PLATE", "госномер ", "А123ВС77"), ("PTS_NUMBER", "ПТС ", "77 01 123456"), ("STS_NUMBER", "СТС № ", "99 12 345678"), ("LAWYER_ID_NUMBER", "удостоверение адвоката ", "77-АБ 100001"), ("LAWYER_REGISTRY_NUMBER", "реестровый номер адвоката ", "100001/77"),
    ("PATENT_ATTORNEY_NUMBER", "номер патентного поверенного ", "1234"), ("TOUR_OPERATOR_REGISTRY_NUMBER", "реестровый номер туроператора ", "РТО-12345"), ("COURT_CASE_NUMBER", "дело № ", "А40-12345/2024"), ("KUSP_NUMBER", "КУСП ", "123456"), ("ENFORCEMENT_PROCEEDING_NUMBER", "исполнительное производство ", "12345/24/77001-ИП"),
    ("NOTARY_REGISTER_NUMBER", "зарегистрировано в реестре: № ", "77/123-н/77-2024-1"), ("POWER_OF_ATTORNEY_NUMBER", "доверенность № ", "Д-17/24"), ("PATENT_NUMBER", "номер патента ", "2700001"), ("PATENT_APPLICATION_NUMBER", "заявка на изобретение ", "2023000001"), ("TRADEMARK_NUMBER", "регистрации товарного знака ", "700001"),
    ("TRADEMARK_APPLICATION_NUMBER", "номер заявки на товарный знак: ", "2023000002"), ("INDUSTRIAL_DESIGN_NUMBER", "промышленный образец № ", "100005"), ("UTILITY_MODEL_NUMBER", "полезная модель № ", "100006"), ("SOFTWARE_REGISTRATION_NUMBER", "программы для ЭВМ № ", "2023000003"), ("DATABASE_REGISTRATION_NUMBER", "регистрации базы данных ", "2023000004"),
    ("TOPOLOGY_REGISTRATION_NUMBER", "регистрации топологии ", "100007"), ("WIPO_APPLICATION_NUMBER", "международная заявка ", "PCT/RU2024/10001"), ("PRIORITY_APPLICATION_NUMBER", "приоритетной заявки ", "RU2023000005"), ("OMS_POLICY", "полис ОМС: ", "7700112233445566"), ("DMS_POLICY", "полис ДМС ", "ДМС-100008"), ("INSURANCE_POLICY", "страховой полис ", "ААВ-100009"),
    ("MEDICAL_RECORD_NUMBER", "медицинская карта № ", "МК-77/1"), ("DISABILITY_CERTIFICATE", "справка об инвалидности ", "МСЭ-100010"), ("SICK_LEAVE_NUMBER", "листок нетрудоспособности ", "100000000001"), ("CONTRACT_NUMBER", "договор аренды от 01.02.2024 № ", "17-А/24"), ("DOCUMENT_NUMBER", "приказ от 01.02.2024 № ", "12-к"), ("CLIENT_NUMBER", "номер клиента ", "К-1001"),
    ("ORDER_NUMBER", "номер заказа: ", "SYN-1001"), ("IP_ADDRESS", "IP-адрес ", "192.0.2.17"), ("MAC_ADDRESS", "MAC-адрес: ", "02:00:AB:CD:EF:01"), ("USER_ACCOUNT", "логин: ", "ivan_77"), ("TELEGRAM_NICK", "телеграм ", "@ivan_77"), ("SOCIAL_NETWORK_ID", "идентификатор социальной сети ", "10000001"), ("MESSENGER_ID", "идентификатор мессенджера ", "chat-77"),
    ("PHONE_NUMBER", "телефон: ", "+7 (900) 123-45-67"), ("INCOME", "размер дохода: ", "120 000,50 руб"), ("BIRTH_DATE", "дата рождения: ", "01.02.1990"), ("ADDRESS", "юридический адрес: ", "г. Город, ул. Лесная, д. 5"), ("BIRTH_PLACE", "место рождения: ", "г. Город"), ("CITIZENSHIP", "гражданство: ", "Россия"), ("JOB_TITLE", "должность: ", "ведущий инженер"),
    ("EMPLOYER", "место работы: ", "АО Ромашка"), ("RELATIVE", "родственная связь: ", "сестра"), ("EDUCATION", "образование: ", "высшее"), ("DIAGNOSIS", "диагноз: ", "гипертония"), ("HEALTH_INFORMATION", "сведения о состоянии здоровья: ", "здоров"), ("CRIMINAL_RECORD", "судимость: ", "нет"), ("NATIONALITY", "национальность: ", "татарин"), ("RELIGION", "вероисповедание: ", "ислам"),
    ("POLITICAL_INFO", "политические взгляды: ", "умеренные"), ("BIOMETRIC_DATA", "биометрические данные: ", "снимок лица"), ("PER", "ФИО: ", "Иванов Пётр Ильич"), ("PERSON_SALUTATION", "Уважаемый ", "Пётр Ильич"), ("EIK_BULSTAT", "БУЛСТАТ ", "123456789"),
    # no values: a check digit, a law, a number in a longer one, words without a mark
    ("", "ОГРН: ", "1027700132196"), ("", "договор № ", "152-ФЗ"), ("", "БИК ", "0445252257"), ("", "должность ", "инженер"), ("", "гражданство: ", "в настоящее время"), ("", "без доверенности ", "нет"),
)


def labelled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of fields in a sentence of each order, with what stands before and behind it."""
    k = F.col("o_orderkey")
    pick = lambda n: F.element_at(F.array(*[F.lit(s[n]) for s in SAMPLES]), (k % len(SAMPLES) + 1).cast("int"))
    text = F.concat(F.lit("Запись "), k.cast("string"), F.lit("; "), pick(1), pick(2), F.when(k % 2 == 0, ";\nконец").otherwise(""))
    docs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("doc_id"), text.alias("text"))
    return L.field_spans(docs).select("doc_id", "start", "end", "text", "label")


QUERIES = {"labelled_fields": labelled_fields}

_ROWS = ", ".join("({}, '{}', '{}', '{}')".format(i, *s) for i, s in enumerate(SAMPLES))
ORACLE = {
    "labelled_fields": f"""WITH s(i, label, caption, value) AS (VALUES {_ROWS}),
r AS (SELECT o_orderkey AS doc_id, s.*, length('Запись ' || o_orderkey || '; ' || caption) AS start FROM orders JOIN s ON i = o_orderkey % {len(SAMPLES)})
SELECT doc_id, CAST(start AS INT) AS start, CAST(start + length(value) AS INT) AS "end", value AS text, label FROM r WHERE label <> ''""",
}
