"""Features of large GeoJSON documents, read in splits.

A document is read as text that ends at closing braces, so Spark splits one file into as many tasks as its size asks for. Whether a piece begins inside a string,
and how deep, follows from the pieces before it: quotes and brackets are counted per piece and summed in order of place. A feature is what lies between two braces
that close at the depth of the root's ``features`` array; its pieces are put together again and parsed.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralog.plans.running import Run, running
from terralog.session import cut

TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|[{\[\]]', re.S)
STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
PAIRS = 6                          # nested arrays that are taken out before the fall of a piece is estimated
ELEMENT_DEPTH = 2                  # root object, features array


def _count(text: Column, sign: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(sign), F.lit("")))


def _brackets(text: Column) -> Column:
    """``net, drop`` of a text that begins outside strings and has no escapes: brackets opened less those closed, and how far it may fall below its beginning."""
    left = F.regexp_replace(F.regexp_replace(text, r'(?s)"[^"]*("|$)', ""), r"(?s)[^{\[\]]", "")
    for _ in range(PAIRS):
        left = F.replace(left, F.lit("[]"), F.lit(""))
    return F.struct((_count(left, "{") + _count(left, "[") - _count(left, "]")).alias("net"), _count(left, "]").alias("drop"))


@F.pandas_udf(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("owner", T.StringType())]))
def _element(text: pd.Series, depth: pd.Series, in_string: pd.Series) -> pd.DataFrame:
    """Where an element of a root array begins in a piece (-1: nowhere), and the root member entered before it: its name if it is an array, '' if not, null if none is."""
    out = []
    for value, level, inside in zip(text, depth, in_string):
        at, owner, key, begin = -1, None, None, 0
        if inside:
            # the rest of a string that a brace was in: as a name it is none that is asked for
            rest = STRING_END.match(value)
            key, begin = "", rest.end() if rest else len(value)
        for m in TOKEN.finditer(value, begin):
            sign = m.group()
            if sign[0] == '"':
                key = m.group(1) if level == 1 else key
                continue
            if sign == "{" and level == ELEMENT_DEPTH:
                at = m.start()
                break
            if level == 1 and sign != "]":
                owner = key if sign == "[" else ""
            level += -1 if sign == "]" else 1
        out.append((at, owner))
    return pd.DataFrame(out, columns=["at", "owner"])


def feature_texts(spark: SparkSession, path: str, member: str = "features") -> DataFrame:
    """``file, text``: every object of the root's array ``member``, as JSON text. Elements that are no objects are left out.

    A piece, and a feature, is held whole in a task; a file and a split are not. Braces, quotes and backslashes in strings do not matter.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    raw = cut(raw.withColumn("id", F.monotonically_increasing_id()), "pieces")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    pieces = raw.withColumn("quotes", _count(plain, '"')).withColumn("from_out", _brackets(plain)).withColumn("from_in", _brackets(F.regexp_replace(plain, r'(?s)^[^"]*("|$)', "")))
    order = ["block", "id"]
    d = running(pieces, ["file"], order, F.col("block"), [Run("q", "sum", F.col("quotes").cast("long"), inclusive=False), Run("more", "max", F.lit(1), inclusive=False, backward=True)])
    # a piece ends at a brace, which counts unless it stands in a string; what is behind the last brace of a file has none
    d = d.withColumn("ends", ((F.col("q") + F.col("quotes")) % 2 == 0) & F.col("more").isNotNull()).drop("more")
    d = d.withColumn("b", F.when(F.col("q") % 2 == 1, F.col("from_in")).otherwise(F.col("from_out")))
    d = d.withColumn("change", F.col("b.net") - F.col("ends").cast("int")).withColumn("drop", F.col("b.drop"))
    d = running(d.drop("b", "quotes", "from_in", "from_out"), ["file"], order, F.col("block"), [Run("depth", "sum", F.col("change").cast("long"), inclusive=False)])
    # inside an element nothing falls back to its depth before the brace at the end of the piece
    shallow = F.col("depth") - F.col("drop") <= ELEMENT_DEPTH
    d = d.withColumn("closes", F.col("ends") & (F.col("depth") + F.col("change") == ELEMENT_DEPTH))
    # one piece per feature begins above its depth
    told = d.where(shallow).withColumn("e", _element("value", F.col("depth").cast("int"), F.col("q") % 2 == 1)).select(*d.columns, F.col("e.at").alias("at"), F.col("e.owner").alias("owner"))
    rest = d.where(~shallow).select("*", F.lit(-1).alias("at"), F.lit(None).cast("string").alias("owner"))
    d = cut(told.unionByName(rest), "placed")
    entered = F.when(F.col("owner").isNotNull(), F.struct("block", "id", "owner"))
    d = running(d, ["file"], order, F.col("block"), [Run("no", "sum", F.col("closes").cast("long"), inclusive=False), Run("inside", "max", entered)])
    own = d.where((F.col("at") >= 0) | (F.col("depth") > ELEMENT_DEPTH))
    piece = F.when(F.col("at") >= 0, F.substring("value", F.col("at") + 1, F.char_length("value"))).otherwise(F.col("value"))
    whole = own.groupBy("file", "no").agg(F.array_sort(F.collect_list(F.struct("block", "id", piece.alias("text")))).alias("p"), F.bool_or("closes").alias("closed"), F.max(F.when(F.col("at") >= 0, F.struct("block", "id"))).alias("begin"),
                                          F.max(F.when(F.col("at") >= 0, F.col("inside.owner"))).alias("member"))
    # pieces before the beginning belong to arrays in root arrays
    texts = F.transform(F.filter("p", lambda x: F.struct(x["block"], x["id"]) >= F.col("begin")), lambda x: x["text"])
    return whole.where(F.col("closed") & (F.col("member") == member)).select("file", F.concat(F.array_join(texts, "}"), F.lit("}")).alias("text"))
