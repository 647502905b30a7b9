"""Best representative of each duplicate group, field by field.

Every member with a value for a field becomes one row (group, field, rank key, member). A
window ordered by the rank key and then by the member keeps the first row of each group and
field. Since only the first row is kept, Spark limits each group within every task before
the shuffle (WindowGroupLimit), so that a group with a third of all rows sends at most one
row a task and field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The characters that count as white space.
SPACE = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _facts(chunks: DataFrame) -> DataFrame:
    """What the ranking needs of each chunk, computed at the scan so that texts are not shuffled."""
    bare = lambda c: F.btrim(F.col(c), F.lit(SPACE))
    filled = lambda c: F.length(bare(c)) > 0
    recency = F.coalesce(-F.unix_micros(F.col("updated_at").cast("timestamp")).cast("double"), F.lit(float("inf")))
    size = F.length(bare("content"))
    key = lambda ok, k: F.when(ok, k.cast("double"))
    return chunks.where("chunk_id is not null").select("chunk_id", key(size > 0, -size).alias("content"), F.col("original_position").cast("double").alias("original_position"), *(key(filled(h), recency).alias(h) for h in ("h1", "h2", "h3")), F.when(filled("element_type"), F.lit(1)).alias("typed"))


def members(groups: DataFrame) -> DataFrame:
    """(group_id, chunk_id, trust) once per member, of groups with two or more; of repeated rows the highest trust."""
    trust = F.when(~F.isnan("trust"), F.col("trust"))
    m = groups.where("group_id is not null and chunk_id is not null").groupBy("group_id", "chunk_id").agg(F.max(trust).alias("trust"))
    many = m.groupBy("group_id").agg(F.count("*").alias("n")).where("n >= 2").select("group_id")
    return m.join(many, "group_id")


def winners(groups: DataFrame, chunks: DataFrame) -> DataFrame:
    """(group_id, field_name, chunk_id): the member whose value of the field survives.

    content: the most characters after trimming; original_position: the smallest; h1 to h3:
    the latest updated_at (null is oldest) where not blank; element_type: the highest trust
    (null is lowest) where not null or blank. Ties go to the smaller chunk_id. No row where
    no member has a value, nor for groups of fewer than two members; a member that chunks do
    not hold counts as a member without values. Rows sent twice do no harm.
    """
    j = members(groups).join(_facts(chunks), "chunk_id")
    trust = F.when(F.col("typed") == 1, F.coalesce(-F.col("trust"), F.lit(float("inf"))))
    fields = {"content": F.col("content"), "original_position": F.col("original_position"), "h1": F.col("h1"), "h2": F.col("h2"), "h3": F.col("h3"), "element_type": trust}
    rows = j.select("group_id", "chunk_id", F.explode(F.array(*(F.struct(F.lit(n).alias("field_name"), k.alias("rank_key")) for n, k in fields.items()))).alias("f")).select("group_id", "chunk_id", "f.*").where("rank_key is not null")
    first = Window.partitionBy("group_id", "field_name").orderBy("rank_key", "chunk_id")
    return rows.withColumn("place", F.row_number().over(first)).where("place = 1").select("group_id", "field_name", "chunk_id")


def survivors(groups: DataFrame, chunks: DataFrame) -> DataFrame:
    """One surviving record per group of two or more: chunk_id (that of the content), n_members and the chosen fields.

    Fields without a value in any member are null; a group of which chunks hold no member has
    only its id and size. Of rows of a chunk that differ, each field takes its largest value.
    """
    w = winners(groups, chunks)
    fields = ["content", "original_position", "h1", "h2", "h3", "element_type"]
    held = chunks.join(w.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("chunk_id").agg(*(F.max(f).alias(f) for f in fields))
    value = w.join(held, "chunk_id").groupBy("group_id").agg(F.max(F.when(F.col("field_name") == "content", F.col("chunk_id"))).alias("chunk_id"), *(F.max(F.when(F.col("field_name") == f, F.col(f))).alias(f) for f in fields))
    sizes = members(groups).groupBy("group_id").agg(F.count("*").alias("n_members"))
    return sizes.join(value, "group_id", "left")
