"""Stack traces as rows: frames, exception chain, own frames and origin, with regular-expression functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryflow.functions.scalar import col, last_segment

#: What a frame, an exception line and a cause look like.
FRAME = r"at\s+([\w.$]+)\.([\w$<>]+)\(([\w]+\.java):(\d+)\)"
EXCEPTION = r"(?m)^\s*([\w.$]*(?:Exception|Error)):?\s*(.*)$"
CAUSED_BY = r"(?m)^\s*Caused by:\s*([\w.$]*(?:Exception|Error)):?\s*(.*)$"


def parse_traces(df: DataFrame, content: str = "content", own_prefix: str = "") -> DataFrame:
    """The rows with exception_chain, all_frames, our_frames, origin_frame (the first own frame in text order) and
    is_trace (false, with empty arrays, if no frame matches). Own frames are those of classes below own_prefix."""
    c = col(content)
    every = lambda pattern, group: F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(*(every(FRAME, g).alias(f"g{g}") for g in (1, 2, 3, 4)))
    frames = F.transform(zipped, lambda z: F.struct(z["g1"].alias("full_class"), F.when(F.instr(z["g1"], ".") > 0, F.regexp_replace(z["g1"], r"\.[^.]*$", "")).otherwise(F.lit("")).alias("package"), last_segment(z["g1"]).alias("class_name"), z["g2"].alias("method_name"), z["g3"].alias("file_name"), z["g4"].cast("int").alias("line_number")))
    error = lambda name, message: F.struct(name.alias("exception_class"), F.trim(message).alias("message"))
    first = F.when(c.rlike(EXCEPTION), F.array(error(F.regexp_extract(c, EXCEPTION, 1), F.regexp_extract(c, EXCEPTION, 2)))).otherwise(F.array().cast("array<struct<exception_class:string,message:string>>"))
    causes = F.transform(F.arrays_zip(every(CAUSED_BY, 1).alias("n"), every(CAUSED_BY, 2).alias("m")), lambda z: error(z["n"], z["m"]))
    out = df.withColumn("exception_chain", F.concat(first, causes)).withColumn("all_frames", frames)
    out = out.withColumn("our_frames", F.filter("all_frames", lambda f: f["full_class"].startswith(own_prefix)))
    return out.withColumn("origin_frame", F.get("our_frames", F.lit(0))).withColumn("is_trace", F.size("all_frames") > 0)


def frame_rows(parsed: DataFrame, *keys: str) -> DataFrame:
    return parsed.select(*keys, F.posexplode("all_frames").alias("position", "f")).select(*keys, "position", "f.*")
