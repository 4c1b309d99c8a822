"""Query terms: occurrence, quotes, match mode and weight of each, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import after, before, bound_number, dequote, field_of, tag_end, value_of

QUERY_TERMS = "query_id int, ord int, raw string"


@dataclass(frozen=True)
class SearchOptions:
    """What changes results; the defaults are the engine's.

    case: smart (an upper-case letter makes a term case-sensitive), sensitive or insensitive.
    """

    case: str = "smart"
    right_partial_only: bool = False
    exact_size: int = 3
    title_weight: int = 10
    keywords_weight: int = 8
    description_weight: int = 6
    text_weight: int = 4
    weak_weight: int = 1
    mandatory_bonus: int = 100
    exclusion_penalty: int = 500
    all_terms: bool = False
    whole_words: bool = False


def query_frame(spark: SparkSession, queries: list[str] | str) -> DataFrame:
    """Rows (query_id, ord, raw) of queries whose terms are parted by blanks; quotes hold blanks together."""
    import re

    if isinstance(queries, str):
        queries = [queries]
    rows = [(q, k, raw) for q, text in enumerate(queries) for k, raw in enumerate(re.findall(r"""[+-]?"[^"]*"|\S+""", text))]
    return spark.createDataFrame(rows, QUERY_TERMS)


def compile_terms(terms: DataFrame, options: SearchOptions | None = None, weak_words: DataFrame | None = None) -> DataFrame:
    """One row per legal term: query_id, ord, occ, text, field, value, kind, mode, name, bound, weight, signed.

    kind: eq, gt, lt, all, word or field. mode: exact_cs, exact_ci, partial_cs or partial_ci. Empty terms
    are left out. `signed` is the weight that a match adds to a page's score.
    """
    o = options or SearchOptions()
    raw = F.col("raw")
    sign = F.when(raw.startswith("+"), "+").when(raw.startswith("-"), "-").otherwise("")
    body = F.when(sign != "", F.substr(raw, F.lit(2))).otherwise(raw)
    text = F.col("text")
    df = terms.filter(raw.isNotNull()).select("query_id", "ord", sign.alias("occ"), body.alias("body")).withColumn("text", dequote(F.col("body")))
    df = df.filter(text != "").withColumn("quoted", (text != F.col("body")) | F.lit(o.whole_words))
    if o.all_terms:
        df = df.withColumn("occ", F.when(F.col("occ") == "", "+").otherwise(F.col("occ")))

    sized = F.when(F.instr(text, "=") > 1, "eq").when(F.instr(text, ">") > 1, "gt").when(F.instr(text, "<") > 1, "lt").otherwise("")
    shown = F.when(sized != "", F.length(text)).otherwise(F.length(value_of(text)))
    upper = F.lower(value_of(text)) != value_of(text)
    if o.case == "sensitive":
        sensitive: Column = F.lit(True)
    elif o.case == "insensitive":
        sensitive = F.lit(False)
    else:
        sensitive = upper
    mode = (
        F.when(shown <= o.exact_size, "exact_cs")
        .when(sensitive, F.when(F.col("quoted"), "exact_cs").otherwise("partial_cs"))
        .otherwise(F.when(F.col("quoted"), "exact_ci").otherwise("partial_ci"))
    )
    kind = F.when(sized != "", sized).when((text == "*") & (mode == "exact_cs"), "all").when(tag_end(text) > 0, "field").otherwise("word")
    name = F.coalesce(F.when(kind == "gt", before(text, ">")), F.when(kind == "lt", before(text, "<")))
    bound = bound_number(F.coalesce(F.when(kind == "gt", after(text, ">")), F.when(kind == "lt", after(text, "<"))))
    field = field_of(text)
    weight = (
        F.when(field == "TITLE", o.title_weight)
        .when(field == "KEYWORDS", o.keywords_weight)
        .when(field == "DESCRIPTION", o.description_weight)
        .otherwise(o.text_weight)
    )
    df = df.select(
        "query_id", "ord", "occ", "text", field.alias("field"), value_of(text).alias("value"), kind.alias("kind"), mode.alias("mode"),
        name.alias("name"), bound.alias("bound"), weight.cast("int").alias("weight"),
    )
    if weak_words is not None:
        weak = weak_words.select(F.lower("word").alias("__weak")).distinct()
        df = (
            df.join(weak, F.lower(F.col("value")) == F.col("__weak"), "left")
            .withColumn("weight", F.when(F.col("__weak").isNotNull(), F.lit(o.weak_weight)).otherwise(F.col("weight")))
            .drop("__weak")
        )
    signed = F.when(F.col("occ") == "+", F.col("weight") + o.mandatory_bonus).when(F.col("occ") == "-", F.lit(-o.exclusion_penalty)).otherwise(F.col("weight"))
    return df.withColumn("signed", signed.cast("int"))
