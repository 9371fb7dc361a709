"""Predicates on detected spans and corrections of their bounds, as Columns over a text and a span.

``start`` and ``end`` count characters from 0, half open.  A null text or span gives false, or the span
unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.text import placed
from veilspan.functions.values import sufficient_address
from veilspan.operators.detection import row_key

# Shapes and captions.
_WEBSITE = (
    r"(?i)(?:(?:https?|ftp)://[^\s<>\[\]]+|www\.[A-Za-zА-Яа-яЁё0-9-]+(?:\.[A-Za-zА-Яа-яЁё0-9-]+)+(?:[/?:#][^\s<>\[\]]*)?|"
    r"(?:[A-Za-zА-Яа-яЁё0-9](?:[A-Za-zА-Яа-яЁё0-9-]{0,62}[A-Za-zА-Яа-яЁё0-9])?\.)+(?:ru|рф|com|org|net|io|biz|info|pro|edu|gov)(?:[/?:#][^\s<>\[\]]*)?)"
)
_CODES = "ГК|ГПК|АПК|УК|УПК|КоАП|КТМ|БК|НК|ТК|ЖК|СК"
_CITATION = rf"(?iU)^\s*(?:ст\.|статья)\s*\d+(?:\.\d+)?\s+(?:{_CODES})(?:\s+РФ)?\b"
_CODE_TAIL = rf"(?iU)^\s*(?:{_CODES})(?:\s+РФ)?\s*[.,;:]"
_CONTACT_CAPTION = (
    r"(?iU)^(?:(?:контактный\s+)?телефон(?:\s+для\s+связи|\s+бухгалтерии|\s+отдела\s+кадров|\s+диспетчера|\s+юриста|\s+горячей\s+линии)?|тел\.|факс|e-mail|email|"
    r"почта(?:\s+технической\s+поддержки)?|электронная\s+почта(?:\s+для\s+направления\s+претензий|\s+заказчика)?|сайт(?:\s+туроператора|\s+учреждения)?|официальный\s+сайт|"
    r"интернет-ресурс|интернет-сайт|портал\s+государственных\s+услуг|web|url|адрес\s+сайта)[:\s\-–—]+"
)
_ADDRESS_CAPTION = r"(?iU)^\s*(?:(?:юридическ\w*|фактическ\w*|почтов\w*)\s+)?адрес(?:у)?(?:\s+(?:регистрации|места\s+(?:нахождения|жительства)))?\s*:\s*"
_POSTAL_BEFORE = r"(?<!\d)\d{6}\s*,\s*$"
_ADDRESS_MARKER = (
    r"(?iU)(?:юридическ(?:ий|ого)\s+адрес|почтов(?:ый|ого)\s+адрес|фактическ(?:ий|ого)\s+адрес|адрес\s+(?:регистрации|места\s+(?:нахождения|жительства))|"
    r"место\s+нахождения\s+и\s+адрес(?:\s+(?:общества|организации|юридического\s+лица|клиента|гражданина))?|место\s+(?:нахождения|жительства|регистрации)|по\s+адресу|адрес(?:у)?)\s*[:\-–—]?\s*$"
)
_OFFICIAL_BEFORE = (
    r"(?iU)(?:фз\b|фкз\b|федеральн\w+\s+(?:конституционн\w+\s+)?закон\w*|закон\w*|постановлени\w*|распоряжени\w*|указ\w*|регламент\w*|инструкци\w*|указани\w*|"
    r"положен\w*|правил\w*|стандарт\w*|гост\w*|снип\w*|санпин\w*|ст\b|стать\w*|п\b|пункт\w*)[^;.!?]{0,180}$"
)
_OFFICIAL_VALUE = r"(?U)\bФЗ\b|-ФЗ\b|\bФКЗ\b|-ФКЗ\b|(?:ФЗ|ФКЗ)$|\b(?:ГОСТ|СНИП|САНПИН)\b"


def before(text: Column, start: Column, n: int) -> Column:
    """Up to ``n`` characters in front of a span."""
    return F.substr(text, F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n)))


def is_website(surface: Column) -> Column:
    """Whether it holds a protocol, www or a known domain ending (numbers and dates hold none)."""
    return F.coalesce(surface.rlike(_WEBSITE), F.lit(False))


def is_legal_citation(surface: Column) -> Column:
    """Whether it begins with an article of a code, or a code's name and punctuation."""
    return F.coalesce(surface.rlike(_CITATION) | surface.rlike(_CODE_TAIL), F.lit(False))


def is_official_number(text: Column, start: Column, value: Column) -> Column:
    """Whether a number is one of a law, standard, article or rule: by its own form, or by such a word in
    its sentence, at most 180 characters before it.  Orders of authorities aren't told apart yet."""
    return F.coalesce(F.upper(F.trim(value)).rlike(_OFFICIAL_VALUE), F.lit(False)) | F.coalesce(before(text, start, 260).rlike(_OFFICIAL_BEFORE), F.lit(False))


def has_address_marker(text: Column, start: Column) -> Column:
    """Whether a caption of an address ends right in front of the span."""
    return F.coalesce(before(text, start, 80).rlike(_ADDRESS_MARKER), F.lit(False))


def _cut(surface: Column, caption: str, least: int) -> Column:
    """Characters of a caption at the front and white space after it, if enough is left; else 0."""
    n = F.char_length(F.regexp_extract(surface, caption + r"\s*", 0))
    return F.when(F.char_length(F.trim(F.substr(surface, n + 1))) >= least, n).otherwise(F.lit(0))


def refined_start(text: Column, start: Column, end: Column, label: Column) -> Column:
    """The start of a span without a contact's or an address's caption, and with the six-digit postal
    index on the same line in front of an address."""
    surface = F.substr(text, start + 1, end - start)
    contact = start + _cut(surface, _CONTACT_CAPTION, 3)
    address = start + _cut(surface, _ADDRESS_CAPTION, 1)
    line = F.element_at(F.split(F.substr(text, F.lit(1), address), "\n"), -1)
    postal = F.char_length(F.regexp_extract(line, _POSTAL_BEFORE, 0))
    return F.coalesce(F.when(label.isin("PHONE_NUMBER", "EMAIL", "WEBSITE"), contact).when(label == "ADDRESS", address - postal).otherwise(start), start)


#: Parts of an address behind a street, with their numbers; months, which no house number stands before.
_PART = r"(?:дом|д|владение|вл|строение|стр|корпус|корп|к|литера|лит|секция|квартира|кв|офис|оф|помещение|помещ|пом|комната|комн|ком|кабинет|каб|этаж|эт|подъезд|под|блок|участок|уч|building|bldg|floor|fl|suite|ste|office|apt|room)"
_MONTHS = "января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря"
_SEGMENT = rf"[\s,;./–—-]*(?:{_PART}\b\.?[\s.:№/–—-]*(?!(?:{_MONTHS})\b)[\p{{L}}\d]{{1,5}}(?:[/-][\p{{L}}\d]{{1,4}})?\b|\d+/\d+\b|\d{{6}}\b|\d{{1,4}}[а-яa-z]?\b(?=\s*,)(?!\s*(?:{_MONTHS})\b))"
_CONNECTOR = rf"(?iU)^[\s,;./–—-]*(?:(?:{_PART}|г|гор|город|ул|улица|пер|переулок|пр-кт|проспект|ш|шоссе|пос|поселок|дер|деревня|село|с|район|р-н|[№#]?\s?\d+(?:[/.-]\d+)*[а-яa-z]?)\b[\s,;./–—-]*)*\z"
_STOP = r"(?iU)\b(?:доверенност|уполномоч|зарегистрирован|проживающ|паспорт|договор|именуем|действующ|гражданин)\w*|(?-i:[.!?]\s+[А-ЯЁ])"
_TOWN = r"(?iU)\b(?:г\.|гор\.|город\b|пос\.|деревня\b|село\b|пгт\b)"
#: The longest text between two parts of one address.
_LONGEST_GAP = 120


def address_end(text: Column, end: Column) -> Column:
    """The end of an address with the house, flat and office that follow it; what is left of separators at the
    end doesn't belong to it.  A number before a month's name isn't one."""
    tail = F.regexp_extract(F.substr(text, end + 1), rf"(?iU)^(?:{_SEGMENT})+", 0)
    tail = F.regexp_replace(F.regexp_replace(tail, r"(?s)\n\s*\n.*", ""), r"[\s,;:-]+\z", "")
    return F.coalesce(end + F.char_length(tail), end)


def is_valid_address(text: Column, start: Column, end: Column) -> Column:
    """A sufficient address, or one behind a caption of an address."""
    return sufficient_address(F.substr(text, start + 1, end - start)) | has_address_marker(text, start)


def is_explicit_postal_address(text: Column, start: Column, end: Column) -> Column:
    """A caption of an address in the 48 characters in front and a postal part (index, street, house) within."""
    surface = F.substr(text, start + 1, end - start)
    return F.coalesce(before(text, start, 48).rlike(_ADDRESS_MARKER), F.lit(False)) & F.coalesce(surface.rlike(r"(?iU)\b\d{6}\b|\b(?:ул|пер|пр-кт|просп|ш|наб|б-р|д|дом|кв|корп|стр|оф)\b\.?\s*[\p{L}\d]"), F.lit(False))


def is_institution_epithet(text: Column, start: Column) -> Column:
    """Whether a name is an institution's ("university named after ..."), by the 180 characters in front."""
    return F.coalesce(before(text, start, 180).rlike(r"(?iU)\b(?:университет|институт|академи|школ|гимнази|лице|колледж|больниц|музе|театр|библиотек|завод|центр|госпитал|училищ)\w*[^.!?;]{0,90}\b(?:имени|им\.)\s*$"), F.lit(False))


def is_term(text: Column, start: Column, end: Column) -> Column:
    """Whether a word is an abbreviation or a term of the text: spelt out in brackets behind it, defined by a
    numbered item with a dash, or a short word in capitals in a text that isn't, behind no mark of a place."""
    token, after = F.substr(text, start + 1, end - start), F.ltrim(F.substr(text, end + 1))
    inside = F.regexp_extract(after, r"^\(([^)]*)\)", 1)
    words = F.regexp_extract_all(inside, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    initials = F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")
    spelt = (F.size(words) >= 2) & (F.contains(initials, F.upper(token)) | ~inside.rlike(r"(?iU)\b(?:город|страна|область|регион|district|city|state)\b|г\."))
    defined = before(text, start, 25).rlike(r"(?iU)(?:^\s*\d+\.\d+\.?|\b(?:раздел|пункт|термин)\b)\s*$") & after.rlike(r"^[–—-]\s+\p{L}")
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    share = F.char_length(F.regexp_replace(letters, r"[^\p{Lu}]", "")) / F.greatest(F.char_length(letters), F.lit(1))
    place = before(text, start, 30).rlike(r"(?iU)\b(?:г\.|город|пос\.|дер\.|деревня|село|с\.|район|р-н|ул\.|улица|пер\.|переулок|проспект|шоссе|ш\.|наб\.|адрес|находящ\w*)\s*$")
    capitals = token.rlike(r"^(?=.*\p{Lu})[^\p{Ll}]{2,5}$") & ~place & (share < 0.6)
    return F.coalesce(spelt | defined | capitals, F.lit(False))


def merged_addresses(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, start, end and label of all spans, neighbouring ADDRESS spans of a text put together.

    Each is first freed of its caption, given its postal index and its house and flat.  Two are one if they
    touch, or if nothing but parts of an address stands between them (120 characters at most, no sentence's
    end, not both with a town); another span between them parts them.  Addresses that aren't valid then
    are left out.  Spans and texts are matched by doc_id (ids unique); a text's spans are one row.
    """
    per = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "label"))).alias("spans"))
    rows = per.join(texts.select(F.col("doc_id").alias("_id"), F.col("text").alias("_t")), F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    text = F.col("_t")
    fixed = F.transform("spans", lambda s: F.when(s["label"] == "ADDRESS", F.struct(refined_start(text, s["start"], s["end"], s["label"]).cast("int").alias("start"), address_end(text, s["end"]).cast("int").alias("end"), s["label"].alias("label"))).otherwise(s))
    part = lambda a, b: F.substr(text, a + 1, b - a)

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        gap = part(last["end"], s["start"])
        fits = (F.char_length(gap) <= _LONGEST_GAP) & gap.rlike(_CONNECTOR) & ~gap.rlike(_STOP) & ~(part(last["start"], last["end"]).rlike(_TOWN) & part(s["start"], s["end"]).rlike(_TOWN))
        joins = (F.size(acc) > 0) & (last["label"] == "ADDRESS") & (s["label"] == "ADDRESS") & ((s["start"] <= last["end"]) | fits)
        one = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["label"].alias("label"))
        return F.when(F.coalesce(joins, F.lit(False)), F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), one)).otherwise(F.array_append(acc, s))

    # the corrected spans are a column of their own: the fold reads each several times
    rows = rows.select("doc_id", "_t", fixed.alias("fixed")).select("doc_id", "_t", F.aggregate("fixed", F.filter(F.slice("fixed", 1, 1), lambda x: F.lit(False)), step).alias("all"))
    out = rows.select("doc_id", "_t", F.explode("all").alias("s"))
    valid = (F.col("s.label") != "ADDRESS") | is_valid_address(text, F.col("s.start"), F.col("s.end"))
    return out.where(valid).select("doc_id", "s.start", "s.end", "s.label")


#: Shapes of contacts: addresses of mail, telephone numbers with a country or trunk prefix.
CONTACTS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+",
    "PHONE_NUMBER": r"\+[0-9][0-9 ()-]{8,18}[0-9]",
}


def contacts(docs: DataFrame) -> DataFrame:
    """doc_id, row, start, end, text and label of every contact in the texts (doc_id, text)."""
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", row_key(F.col("text")).alias("row"), "text")
    kinds = F.explode(F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(k).alias("label"), F.lit(p).alias("pattern"))) for k, p in CONTACTS.items()]))).alias("k")
    each = rows.select("doc_id", "row", "text", kinds).select("doc_id", "row", "k.label", F.regexp_extract_all("text", F.col("k.pattern"), F.lit(0)).alias("found"), F.split("text", F.col("k.pattern"), -1).alias("gaps"))
    return each.select("doc_id", "row", "label", F.explode(placed(F.col("found"), F.col("gaps"))).alias("s")).select("doc_id", "row", "s.start", "s.end", "s.text", "label")


# Shapes of our own: legal forms, public bodies, acts, products, places.
LEGAL_FORMS = r"(?:ООО|АО|ПАО|ЗАО|ОАО|НАО|НКО|АНО|ИП|ГУП|МУП|ФГУП|ФГБУ|ГБУ|МБУ|Общество\s+с\s+ограниченной\s+ответственностью|(?:Публичное\s+|Закрытое\s+|Открытое\s+)?[Аа]кционерное\s+общество)"
_PUBLIC_BODY = r"(?iU)\b(?:министерств|федеральн\w+\s+(?:служб|агентств)|правительств|администраци|прокуратур|полици|департамент|комитет|инспекци|казначейств|судебн\w+\s+пристав)\w*|\b(?:верховн|конституционн|арбитражн|районн|городск|мирово)\w*\s+суд\w*|\bмвд\b|\bфнс\b|\bфссп\b|\bгибдд\b"
_ACT = r"(?iU)\b(?:федеральн\w+\s+)?(?:закон|кодекс|постановлени|указ|распоряжени|регламент|конвенци|директив|гост|снип|санпин)\w*"
_PAPER = r"(?iU)\b(?:договор|контракт|обращени|заявлени|накладн|акт|приказ)\w*|\bсч[её]т\w*|\bплат[её]жн\w+\s+поручени\w*"
_PRODUCT = r"(?iU)\b(?:[A-ZА-ЯЁ]{1,5}[- ]?\d{2,}[A-ZА-ЯЁ\d-]*|\d+(?:[.,]\d+)?\s?(?:мм|см|м|кг|г|л|вт|квт|в|а|гб|мб|шт)\b)"
_CAPACITY = r"(?iU)^(?:(?:гражданин|гражданка|господин|госпожа|г-н|г-жа|директор|генеральный\s+директор|президент|бухгалтер|главный\s+бухгалтер|представитель|истец|ответчик|заявитель|менеджер|адвокат|нотариус|судья|прокурор)\w*\s+)+"


def has_legal_form_before(text: Column, start: Column, n: int = 50) -> Column:
    """Whether a legal form, with at most a few words or marks behind it, ends in the ``n`` characters before."""
    return F.coalesce(before(text, start, n).rlike(rf"(?U)\b{LEGAL_FORMS}(?:[\s,:;«\"-]*\z|[\s,:;-]+[\w\s]{{0,50}}\z)"), F.lit(False))


def is_public_body(surface: Column) -> Column:
    """A public authority without a private legal form in its name: it isn't masked."""
    return F.coalesce(surface.rlike(_PUBLIC_BODY) & ~surface.rlike(rf"(?U)\b{LEGAL_FORMS}\b"), F.lit(False))


def is_unfilled(surface: Column) -> Column:
    """A template's gap: dots or underscores in place of a name."""
    return F.coalesce(surface.rlike(r"…|\.\.\.|_{2,}"), F.lit(False))


def is_product(surface: Column) -> Column:
    """A product's code or a measure in place of an organisation's name, without a legal form."""
    return F.coalesce(surface.rlike(_PRODUCT) & ~surface.rlike(rf"(?U)\b{LEGAL_FORMS}\b") & ~surface.rlike("[«\"]"), F.lit(False))


def is_act_date(text: Column, start: Column) -> Column:
    """Whether a date is one of a cited act: behind ``от``, with an act named in its sentence closer than a
    contract, bill or order; or behind ``по состоянию на``."""
    left = before(text, start, 320)
    own = F.element_at(F.split(left, r"[;\n]|(?<=[а-яё])\.\s"), -1)
    acts, papers = (F.char_length(F.element_at(F.split(own, p, -1), -1)) for p in (_ACT, _PAPER))
    cited = own.rlike(_ACT) & (~own.rlike(_PAPER) | (acts < papers)) & left.rlike(r"(?iU)\bот\s*\z")
    return F.coalesce(cited | left.rlike(r"(?iU)по\s+состоянию\s+на\s*\z"), F.lit(False))


def is_place_alone(surface: Column) -> Column:
    """A town, region or country without a street, house or index: no address."""
    place = surface.rlike(r"(?iU)\b(?:г\.|город|област|край|республик|район|страна|россия|рф)\w*") | surface.rlike(r"^\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)*\z")
    return F.coalesce(place & ~sufficient_address(surface) & ~surface.rlike(r"\d{6}") & ~is_legal_citation(surface), F.lit(False))


def person_start(text: Column, start: Column, end: Column) -> Column:
    """The start of a person's name without the capacity or form of address in front of it; the span's own start
    if nothing else would be left."""
    n = F.char_length(F.regexp_extract(F.substr(text, start + 1, end - start), _CAPACITY, 0))
    return F.coalesce(F.when(start + n < end, start + n).otherwise(start), start)


def organisation_core(text: Column, start: Column, end: Column) -> Column:
    """(start, end) of an organisation's own name: without the legal form in front and the quotes around it,
    and without what follows a bracket of another name; the form stays readable in the text."""
    surface = F.substr(text, start + 1, end - start)
    lead = F.char_length(F.regexp_extract(surface, rf"(?U)^(?:{LEGAL_FORMS}\s+)?[«\"“\s]*", 0))
    rest = F.substr(surface, lead + 1)
    core = F.regexp_replace(F.regexp_replace(rest, r"(?s)\s*\((?:далее|именуем).*|[»\"”]\s*\(.*", ""), r"[»\"”\s.,;:]+\z", "")
    good = F.char_length(core) >= 2
    return F.struct(F.when(good, start + lead).otherwise(start).cast("int").alias("start"), F.when(good, start + lead + F.char_length(core)).otherwise(end).cast("int").alias("end"))


def alias_cores(text: Column, start: Column, end: Column) -> Column:
    """The spans of an organisation and its alias in brackets (``Name» (ООО «Alias``), as an array of two; of
    any other span an array of its core."""
    surface = F.substr(text, start + 1, end - start)
    alias = F.regexp_extract(surface, rf"(?U)[»\"”]\s*\(\s*(?:{LEGAL_FORMS}\s+)?[«\"“]([^«»\"“”\n]{{2,}})", 1)
    at = F.call_function("locate", alias, surface, F.lit(1)) - 1
    second = F.struct((start + at).cast("int").alias("start"), (start + at + F.char_length(alias)).cast("int").alias("end"))
    return F.when(alias != "", F.array(organisation_core(text, start, end), second)).otherwise(F.array(organisation_core(text, start, end)))


def masked_filename(name: Column) -> Column:
    """A file's or sheet's name with account numbers, bank codes and dates as marks."""
    out = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?<!\d)\d{20}(?!\d)", "[RU_ACCOUNT]")
    out = F.regexp_replace(out, r"(?<!\d)04\d{7}(?!\d)", "[BIK]")
    return F.regexp_replace(out, r"(?<!\d)\d{2}[._-]\d{2}[._-](?:19|20)\d{2}(?!\d)", "[DATE]")


def masked_sheet_title(title: Column) -> Column:
    """``masked_filename`` of a sheet's title, cut at the 31 characters that a title may have."""
    return F.substring(masked_filename(title), 1, 31)
