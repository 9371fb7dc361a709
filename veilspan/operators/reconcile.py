"""Every remaining occurrence of registered values in texts, replaced by their placeholders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions.text import TOKEN, placed
from veilspan.operators.masking import splice

# Labels whose values have a shape of their own, and so are replaced wherever they stand.
GLOBAL_LABELS = (
    "INN", "KPP", "OGRN", "OGRNIP", "BIK", "SNILS", "PASSPORT", "FOREIGN_PASSPORT", "RU_ACCOUNT", "RU_CORR_ACCOUNT", "PERSONAL_ACCOUNT", "BANK_CARD", "PHONE_NUMBER", "EMAIL", "WEBSITE",
    "TELEGRAM_NICK", "PURCHASE_NUMBER", "CONTRACT_NUMBER", "COURT_CASE_NUMBER", "CRIMINAL_CASE_NUMBER", "ENFORCEMENT_PROCEEDING_NUMBER", "POWER_OF_ATTORNEY_NUMBER", "CADASTRAL_NUMBER",
    "EGRN_RECORD_NUMBER", "PROPERTY_RIGHT_NUMBER", "PROPERTY_CONDITIONAL_NUMBER", "VEHICLE_VIN", "VEHICLE_PLATE", "PTS_NUMBER", "STS_NUMBER", "LAWYER_ID_NUMBER", "LAWYER_REGISTRY_NUMBER",
    "OMS_POLICY", "DMS_POLICY", "INSURANCE_POLICY", "MEDICAL_RECORD_NUMBER", "SICK_LEAVE_NUMBER", "IP_ADDRESS", "MAC_ADDRESS",
)
_WORD = r"[\p{L}\p{N}_]+"


def values(entities: DataFrame) -> DataFrame:
    """token, a word of the value (the join key: of its words the one that fewest values hold, so that what
    many share, as a mail domain, is no key) and a pattern of the value (lower case) that has no word
    character before or behind where the value itself begins or ends with one."""
    named = entities.where(F.col("label").isin(*GLOBAL_LABELS)).select(F.lower(F.trim("original")).alias("value"), "token", "number")
    named = named.where((F.char_length("value") >= 2) & F.col("value").rlike(r"[\p{L}\p{N}]"))
    one = named.groupBy("value").agg(F.min(F.struct("number", "token"))["token"].alias("token"))
    words = one.select("value", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(_WORD), F.lit(0)))).alias("word"))
    shared = words.groupBy("word").agg(F.count("*").alias("c"))
    keys = words.join(shared, "word").groupBy("value").agg(F.min(F.struct("c", (-F.char_length("word")).alias("n"), "word"))["word"].alias("word"))
    left, right = F.when(F.col("value").rlike(f"^{_WORD}"), "(?<![\\p{L}\\p{N}_])").otherwise(""), F.when(F.col("value").rlike(f"{_WORD}$"), "(?![\\p{L}\\p{N}_])").otherwise("")
    return one.join(keys, "value").select("token", "word", F.concat(left, F.regexp_replace("value", r"([^\p{L}\p{N}_])", r"\\$1"), right).alias("pattern"))


def reconcile(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_id, text and n of all rows of ``texts`` (doc_id, text).

    A value is sought only in texts that hold its rarest word: an equi-join of the texts' distinct words
    with the registry, not every value in every text.  Letters may be of any case.  Within a text the
    longest value goes first, and tokens there are left alone.  Null texts count as empty; rows are told
    apart by id and whole text, so ids may repeat or be null.
    """
    docs = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("rk", F.md5(F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")))
    low = docs.select("rk", F.lower("text").alias("low"))
    words = low.select("rk", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(_WORD), F.lit(0)))).alias("word"))
    hits = words.join(values(entities), "word").select("rk", "pattern", "token").distinct()
    cut = low.join(hits, "rk").select("rk", "token", F.regexp_extract_all("low", F.col("pattern"), F.lit(0)).alias("found"), F.split("low", F.col("pattern"), -1).alias("gaps"))
    fits = cut.where(F.size("found") > 0).select("rk", "token", F.explode(placed(F.col("found"), F.col("gaps"))).alias("s")).select("rk", "token", "s.start", "s.end")
    per_doc = fits.groupBy("rk").agg(F.sort_array(F.collect_set(F.struct((F.col("start") - F.col("end")).alias("l"), "start", "end", "token"))).alias("all"))
    tokens = docs.select("rk", "doc_id", "text", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("found"), F.split("text", TOKEN, -1).alias("gaps"))
    both = tokens.join(per_doc, "rk", "left").select("doc_id", "text", "all", placed(F.col("found"), F.col("gaps")).alias("kept_out"))
    apart = F.filter("all", lambda c: ~F.exists("kept_out", lambda t: (t["start"] < c["end"]) & (c["start"] < t["end"])))
    first = F.filter(apart, lambda c: F.lit(False))
    chosen = F.aggregate(apart, first, lambda acc, c: F.when(F.exists(acc, lambda e: (e["start"] < c["end"]) & (c["start"] < e["end"])), acc).otherwise(F.array_append(acc, c)))
    done = both.withColumn("chosen", F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["token"].alias("token"))))
    return done.select("doc_id", F.when(F.size("chosen") > 0, splice(F.col("text"), F.col("chosen"))).otherwise(F.col("text")).alias("text"), F.greatest(F.size("chosen"), F.lit(0)).cast("long").alias("n"))


def leaks(masked: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_id and n of documents in which registered values remain."""
    return reconcile(masked, entities).where("n > 0").select("doc_id", "n")
