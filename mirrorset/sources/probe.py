"""Stream metadata from probe JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorset.functions.media import hdr_format

PROBE_SCHEMA = (
    "streams array<struct<index:int,codec_name:string,codec_type:string,width:int,height:int,"
    "sample_rate:string,channel_layout:string,bit_rate:string,r_frame_rate:string,channels:int,"
    "color_transfer:string,side_data_list:array<struct<side_data_type:string>>>>,"
    "format struct<duration:string,bit_rate:string>"
)


def read_probe_json(df: DataFrame, column: str = "probe") -> DataFrame:
    """Replace the JSON text by ``streams`` and ``duration_s`` (whole seconds).

    The container bit rate goes to the first stream only if no stream has its own.
    """
    p = df.withColumn("_p", F.from_json(column, PROBE_SCHEMA))

    def number(c, kind: str):
        return F.when(F.trim(c).rlike(r"^-?\d+$"), F.trim(c).try_cast(kind))

    def stream(s):
        top, bottom = F.split(s["r_frame_rate"], "/"), None
        num, den = F.get(top, F.lit(0)).try_cast("int"), F.get(top, F.lit(1)).try_cast("int")
        rate = F.when((num > 0) & (den > 0), num / den).when(num.isNotNull() & den.isNotNull(), -1.0).otherwise(0.0)
        sides = F.array_join(F.transform(s["side_data_list"], lambda x: x["side_data_type"]), "|")
        return F.struct(
            s["index"].alias("index"), s["codec_name"].alias("codec_name"), s["codec_type"].alias("codec_type"),
            F.coalesce(s["width"], F.lit(0)).alias("width"), F.coalesce(s["height"], F.lit(0)).alias("height"),
            F.coalesce(number(s["sample_rate"], "int"), F.lit(0)).alias("sample_rate"),
            s["channel_layout"].alias("channel_layout"), number(s["bit_rate"], "bigint").alias("bit_rate"),
            rate.cast("float").alias("frame_rate"), F.coalesce(s["channels"], F.lit(0)).alias("channels"),
            hdr_format(s["color_transfer"], sides).alias("hdr_format"))

    parsed = p.withColumn("_s", F.transform("_p.streams", stream))
    own = F.exists("_s", lambda s: s["bit_rate"].isNotNull())
    whole = number(F.col("_p.format.bit_rate"), "bigint")

    def with_rate(s, i):
        rate = F.when(~own & (i == 0), F.coalesce(whole, F.lit(0))).otherwise(F.coalesce(s["bit_rate"], F.lit(0)))
        return s.withField("bit_rate", rate)

    seconds = F.col("_p.format.duration").try_cast("double")
    clock = F.split(F.col("_p.format.duration"), ":")
    from_clock = F.when(F.size(clock) == 3, F.get(clock, F.lit(0)).try_cast("double") * 3600
                        + F.get(clock, F.lit(1)).try_cast("double") * 60 + F.get(clock, F.lit(2)).try_cast("double"))
    return parsed.withColumn("streams", F.transform("_s", with_rate)).withColumn(
        "duration_s", F.coalesce(F.floor(F.when(seconds >= 0, seconds)), F.floor(from_clock), F.lit(0)).cast("double")) \
        .drop("_p", "_s", column)
