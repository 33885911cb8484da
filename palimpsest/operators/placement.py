"""Records placed on the nearest page with room, and pages merged away, in rounds of offers and refusals."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.files import held
from . import vector_index as X

#: Nearest pages that a record offers itself to before they are sought anew.
CHOICES = 64


def place(records: DataFrame, pages: DataFrame, choices: int = CHOICES, dims: int = 64, target: float = 0.99, digits: int = 6) -> DataFrame:
    """(record_id, page_id, score): each record on a page, no page with more records than its room.

    records has record_id and vector, pages page_id, vector and room (what it can still take). In a
    round every record without a page offers itself to the nearest page with room, and a page takes
    the nearest of its offers, ties by the lower ids, up to its room; what it took stays. Nearest
    is by rounded cosine, among the `choices` nearest pages of a vector index, exactly so with a target
    of 1; a record whose choices are all full seeks among the pages with room anew. Records are left over only if no room is.
    Null vectors and those of other than `dims` components aren't placed. Ids are longs.

    A page whose offers are a third of all records ranks no more than its room of them in a task: the
    first of each task's offers go on. Every round that refuses a record has filled a page.
    """
    waiting = held(records.where(F.size("vector") == dims).select(F.col("record_id").cast("long").alias("record_id"), "vector"))
    rooms = held(pages.where((F.size("vector") == dims) & (F.col("room") > 0)).select(F.col("page_id").cast("long").alias("page_id"), "vector", F.col("room").cast("long").alias("room")))
    placed, every = None, False
    by_page = W.partitionBy("page_id").orderBy(F.col("score").desc(), "record_id")
    while waiting.head(1) and rooms.head(1):
        ends = waiting.withColumnRenamed("record_id", "query_id"), rooms.withColumnRenamed("page_id", "record_id")
        if target < 1:
            index = X.build(ends[1], choices, target, dims=dims)
            index = replace(index, probes=index.cells) if every else index
            near = X.nearest(*ends, choices, index, digits=digits, dims=dims, apart=False)
        else:
            near = X.exact(*ends, choices, digits=digits, dims=dims, apart=False)
        near = held(near.select(F.col("query_id").alias("record_id"), F.col("record_id").alias("page_id"), "score", "rank"))
        most = rooms.agg(F.max("room")).first()[0]
        every = True  # if no page takes any, as probed cells hold none, all cells are probed next
        while True:
            offers = near.join(rooms.select("page_id", "room"), "page_id").groupBy("record_id").agg(F.min_by(F.struct("page_id", "score", "room"), "rank").alias("o")).select("record_id", "o.*")
            # the bound on the rank is a constant, so tasks leave out what no page can take before the shuffle
            taken = held(offers.withColumn("n", F.row_number().over(by_page)).where(F.col("n") <= most).where(F.col("n") <= F.col("room")).select("record_id", "page_id", "score"))
            if not taken.head(1):
                break
            every = False
            placed = taken if placed is None else held(placed.union(taken))
            rooms = held(rooms.join(taken.groupBy("page_id").agg(F.count("*").alias("_n")), "page_id", "left").withColumn("room", F.col("room") - F.coalesce("_n", F.lit(0))).drop("_n").where("room > 0"))
            near = held(near.join(taken.select("record_id"), "record_id", "left_anti"))
        if placed is not None:
            waiting = held(waiting.join(placed.select("record_id"), "record_id", "left_anti"))
    return records.sparkSession.createDataFrame([], "record_id long, page_id long, score double") if placed is None else placed


def consolidate(records: DataFrame, pages: DataFrame, target: int, capacity: int = 32, dims: int = 64, align: float = 0.99) -> DataFrame:
    """(record_id, page_id, moved): the records of all pages on `target` of them, none over its capacity.

    records has record_id, page_id and vector; pages page_id, vector and importance. The pages of most
    importance, then of most records, then of the lower id stay; if `target` of them have no room for
    all records, as many more as the capacity needs. The others' records are placed by `place` on
    those that stay; so are the records of a staying page beyond its capacity, its nearest ones and
    then the lower ids staying. Records without a usable vector keep their page, whatever its load.
    """
    usable = F.coalesce(F.size("vector") == dims, F.lit(False))
    n_all = records.where(usable).count()
    sizes = records.groupBy("page_id").agg(F.count("*").alias("n_records"))
    own = pages.join(sizes, "page_id", "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)))
    many = max(target, -(-n_all // capacity))
    stay = held(own.where(usable).orderBy(F.col("importance").desc(), F.col("n_records").desc(), "page_id").limit(many).select("page_id", "vector"))
    fixed = records.where(~usable).select("record_id", "page_id")
    here = records.where(usable).select("record_id", "page_id", "vector").join(stay.select("page_id", F.col("vector").alias("_p")), "page_id")
    near = W.partitionBy("page_id").orderBy(F.round(V.cosine(F.col("vector"), F.col("_p")), 6).desc(), "record_id")
    keeps = held(here.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= capacity).select("record_id", "page_id"))
    room = stay.join(keeps.groupBy("page_id").agg(F.count("*").alias("_n")), "page_id", "left").withColumn("room", capacity - F.coalesce("_n", F.lit(0))).drop("_n")
    moves = place(records.where(usable).select("record_id", "vector").join(keeps, "record_id", "left_anti"), room, dims=dims, target=align)
    out = keeps.withColumn("moved", F.lit(False)).union(moves.select("record_id", "page_id", F.lit(True)))
    return out.union(fixed.withColumn("moved", F.lit(False)))
