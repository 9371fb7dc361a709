"""Numbered placeholders, masked texts, the registry and restoring.

Rows of texts are named by doc_id and, where ids may repeat, ``row`` (``detection.row_key`` of the text): the
spans of one row never touch another row of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.functions.text import PLACEHOLDER
from veilspan.operators.detection import keys_of, row_key

# Labels whose entities are told apart by their digits alone.
DIGIT_LABELS = (
    "INN", "OGRN", "OGRNIP", "KPP", "BIK", "SNILS", "RU_ACCOUNT", "RU_CORR_ACCOUNT", "PERSONAL_ACCOUNT", "PASSPORT", "PASSPORT_NUMBER", "PASSPORT_SERIES", "PASSPORT_DIVISION_CODE",
)
#: Pieces that the numbering of one label is cut into.
PIECES = 256


def spliced(text: Column, replacements: Column) -> Column:
    """(out, n): ``text`` with (start, end, token) applied left to right, and how many were; spans out of
    range, empty, or before the end of one applied are skipped."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, r: Column) -> Column:
        good = (r["start"] >= acc["at"]) & (r["end"] > r["start"]) & (r["end"] <= F.char_length(text))
        gap = F.substr(text, acc["at"] + 1, r["start"] - acc["at"])
        return F.when(good, F.struct(r["end"].alias("at"), F.concat(acc["out"], gap, r["token"]).alias("out"), (acc["n"] + 1).alias("n"))).otherwise(acc)

    return F.aggregate(F.array_sort(replacements), start, step, lambda done: F.struct(F.concat(done["out"], F.substr(text, done["at"] + 1)).alias("out"), done["n"].alias("n")))


def splice(text: Column, replacements: Column) -> Column:
    return spliced(text, replacements)["out"]


def entity_key(label: Column, text: Column) -> Column:
    """What spellings of one entity share: the digits of numbers, the words of a foreign name in any order,
    else the lower-cased text with single spaces."""
    compact = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    digits = F.regexp_replace(compact, r"(?U)\D", "")
    words = F.array_join(F.array_sort(F.regexp_extract_all(F.lower(compact), F.lit(r"[\p{L}]+(?:-[\p{L}]+)*"), F.lit(0))), " ")
    return F.when(label.isin(*DIGIT_LABELS) & (digits != ""), digits).when(label == "FOREIGN_PER", words).otherwise(F.lower(compact))


def _piece(first: DataFrame, order: str) -> Column:
    """A number that never falls as ``order`` rises: places between the least and the largest value, or the
    first two characters of a text.  Null comes first."""
    kind = first.schema[order].dataType
    if isinstance(kind, T.NumericType):
        span = (F.col("_max") - F.col("_min")).cast("double")
        return F.coalesce(F.when(span <= 0, F.lit(0)).otherwise(F.floor((F.col(order) - F.col("_min")).cast("double") / span * (PIECES - 1))).cast("long") + 1, F.lit(0).cast("long"))
    text = F.col(order).cast("string")
    return F.coalesce(F.ascii(F.substring(text, 1, 1)).cast("long") * 1_114_112 + F.coalesce(F.ascii(F.substring(text, 2, 1)), F.lit(0)) + 1, F.lit(0).cast("long"))


def numbered(entities: DataFrame, *order: str) -> DataFrame:
    """``entities`` with ``place``: 1, 2, ... within each label by ``order``, a label's rows dealt over many
    tasks.

    Rows are cut by the first order column into pieces (a function of the row alone, so a task that runs
    again gives the same), numbered within a piece, and lifted by the sizes of the pieces before: one
    row per label and piece.
    """
    ends = entities.groupBy("label").agg(F.min(order[0]).alias("_min"), F.max(order[0]).alias("_max"))
    cut = entities.join(ends, "label").withColumn("_piece", _piece(entities, order[0])).drop("_min", "_max")
    within = cut.withColumn("_n", F.row_number().over(W.partitionBy("label", "_piece").orderBy(*order)))
    sizes = within.groupBy("label", "_piece").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(W.partitionBy("label").orderBy("_piece")) - F.col("_size")).drop("_size")
    return within.join(before, ["label", "_piece"]).withColumn("place", F.col("_n") + F.col("_before")).drop("_n", "_before", "_piece")


def registry(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """label, key, token, number and original of every entity, numbered per label by first appearance
    (document, place); ``known`` entities keep their tokens and numbering goes on after the largest.

    Entities are the outcome of a partial aggregate; a label's numbering is dealt over tasks.
    """
    entities = found.groupBy("label", entity_key(F.col("label"), F.col("text")).alias("key")).agg(F.min(F.struct("doc_id", "start", "text")).alias("first"))
    if known is not None:
        entities = entities.join(known.select("label", "key"), ["label", "key"], "left_anti").join(known.groupBy("label").agg(F.max("number").alias("base")), "label", "left")
    else:
        entities = entities.withColumn("base", F.lit(0))
    entities = entities.select("label", "key", "base", F.col("first.doc_id").alias("_doc"), F.col("first.start").alias("_start"), F.col("first.text").alias("original"))
    out = numbered(entities, "_doc", "_start", "key").withColumn("number", (F.col("place") + F.coalesce("base", F.lit(0))).cast("long"))
    out = out.select("label", "key", F.format_string("[%s_%d]", "label", "number").alias("token"), "number", "original")
    return out if known is None else out.unionByName(known.select("label", "key", "token", "number", "original"))


def mask(docs: DataFrame, found: DataFrame, entities: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, masked and n_replaced (spans applied) of every row; texts without spans stay, a null text
    gives an empty one.  Spans with ``row`` go into their own row only."""
    keys = keys_of(found)
    keyed = found.withColumn("key", entity_key(F.col("label"), F.col("text"))).join(entities.select("label", "key", "token"), ["label", "key"])
    per_row = keyed.groupBy(*keys).agg(F.collect_list(F.struct("start", "end", "token")).alias("spans")).select(*[F.col(k).alias(f"_{k}") for k in keys], "spans")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t")).withColumn("row", row_key(F.col("_t")))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    done = rows.join(per_row, same, "left").withColumn("m", F.when(F.col("spans").isNotNull(), spliced(F.col("_t"), F.col("spans"))))
    return done.select("doc_id", F.coalesce("m.out", "_t", F.lit("")).alias("masked"), F.coalesce("m.n", F.lit(0)).cast("long").alias("n_replaced"))


def restore(masked: DataFrame, entities: DataFrame, masked_col: str = "masked") -> DataFrame:
    """doc_id and text of every row of ``masked``, each known token replaced by its original; unknown tokens
    and null texts stay.

    Only a row's distinct tokens are joined with the registry; the text is put together within its row.
    """
    rows = masked.select("doc_id", F.col(masked_col).alias("_t")).withColumn("row", row_key(F.col("_t")))
    rows = rows.withColumn("found", F.regexp_extract_all("_t", F.lit(PLACEHOLDER), F.lit(0)))
    names = entities.select("token", "original").dropDuplicates(["token"])
    tokens = rows.select("doc_id", "row", F.explode(F.array_distinct("found")).alias("token")).distinct().join(names, "token")
    maps = tokens.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("names"))
    both = rows.join(maps, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("row").eqNullSafe(F.col("_row")), "left")
    gaps = F.split("_t", PLACEHOLDER, -1)
    back = F.transform("found", lambda t: F.coalesce(F.try_element_at("names", t), t))
    text = F.array_join(F.flatten(F.zip_with(gaps, F.concat(back, F.array(F.lit(""))), lambda g, t: F.array(g, t))), "")
    return both.select("doc_id", F.when(F.size("found") > 0, text).otherwise(F.col("_t")).alias("text"))
