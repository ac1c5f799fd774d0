"""M6: the exact best two dense vectors of a corpus for every text, by a pivot index.

Pivots are corpus vectors; every corpus vector belongs to the cell of its nearest pivot. Angles obey the
triangle inequality, so a cell whose ball lies farther from a text than a vector already known to it holds
nothing of use, nor does a vector whose angle to its pivot differs too much from the text's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrloom.functions import similarity as sim
from attrloom.functions import text as tx
from attrloom.operators.lookups import fits_broadcast
from attrloom.session import materialize

# Vectors a text meets in one row, and up to which a corpus is one such block without an index.
CORPUS_BLOCK = 256
# Dense vectors sent to every executor at most (and BROADCAST_BYTES).
BROADCAST_VECTORS = 4096
# Pivots go to every executor: at most so many, of so many bytes together.
MAX_PIVOTS = 1024
PIVOT_BYTES = 8 << 20
# Texts that meet one copy of a block, beyond that the block is copied.
TEXTS_PER_COPY = 20_000
# Rounding of angles; near zero the arc cosine turns an error of 1e-12 into one of 1e-6.
SLACK = 1e-5

# Cells of vectors that have no angle: of length zero, or of another dimension than every pivot.
NO_DIRECTION, UNPLACED = -1, -2


def measured(df: DataFrame, length: str) -> DataFrame:
    """Rows whose vector has a finite length, with that length. Null vectors and null, infinite or
    undefined components take no part in matching."""
    return df.withColumn(length, sim.norm2("vector")).filter(F.col(length) < float("inf"))


def _angle(a: Column, b: Column, length_a: Column, length_b: Column) -> Column:
    """Angle of two vectors; null without a direction or between dimensions."""
    cosine = F.when((length_a > 0) & (length_b > 0), sim.cosine(a, b, length_a, length_b))
    return tx.let(cosine, lambda c: F.when(c.isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))))


def _best_two(pairs: DataFrame, members: Column | str) -> DataFrame:
    """The two best members of every row's block, ties to the smaller number."""
    rated = F.transform(members, lambda m: F.struct(
        sim.cosine(F.col("vector"), m["vector"], F.col("q_length"), m["length"]).alias("score"), (-m["var_no"]).alias("neg_no"),
        m["form"].alias("form"), m["canonical"].alias("canonical"), m["guard"].alias("guard")))
    top = F.slice(F.sort_array(F.filter(rated, lambda r: r["score"].isNotNull()), asc=False), 1, 2)
    best = tx.explode_costly(pairs.select("text", top.alias("_top")), "_top", "m")
    return best.select("text", (-F.col("m.neg_no")).alias("var_no"), "m.form", "m.canonical", "m.guard", "m.score")


class PivotIndex:
    """Cells, pivots and packed blocks of a corpus ``(var_no, form, canonical, guard, vector, length)``.

    The corpus, its places and the pivots are written to the shared folder. No cell is gathered: a block
    holds about CORPUS_BLOCK vectors of one cell, however many lie there.
    """

    def __init__(self, corpus: DataFrame, total: int, dimension: int):
        payload = ["var_no", "form", "canonical", "guard", "vector", "length"]
        wanted = max(1, min(MAX_PIVOTS, math.isqrt(total) + 1, PIVOT_BYTES // (8 * max(1, dimension))))
        directed = corpus.filter("length > 0")
        # Equal vectors make one pivot. The sample is bounded, the index holds every vector.
        picked = directed.orderBy(F.xxhash64("var_no"), "var_no").limit(wanted).dropDuplicates(["vector"])
        packed = picked.agg(F.array_sort(F.collect_list(F.struct("var_no", "vector", "length"))).alias("p"))
        numbered = F.transform("p", lambda p, i: F.struct(i.cast("int").alias("cell"), p["vector"].alias("vector"), p["length"].alias("length")))
        self.pivots = materialize(packed.select(F.lit(0).alias("_all"), numbered.alias("pivots")), "pivots")

        places = F.transform("pivots", lambda p: F.struct(
            _angle(F.col("vector"), p["vector"], F.col("length"), p["length"]).alias("angle"), p["cell"].alias("cell")))
        nearest = F.array_min(F.filter(places, lambda a: a["angle"].isNotNull()))
        placed = directed.withColumn("_all", F.lit(0)).join(F.broadcast(self.pivots), "_all").select(*payload, nearest.alias("at"))
        # All vectors of length zero score 0, so the first two stand for them.
        still = corpus.filter("length = 0").orderBy("var_no").limit(2).select(*payload, F.struct(
            F.lit(None).cast("double").alias("angle"), F.lit(NO_DIRECTION).alias("cell")).alias("at"))
        stored = materialize(placed.unionByName(still), "corpus-places")
        self.placed = stored.select(*payload, F.col("at.angle").alias("angle"), F.coalesce("at.cell", F.lit(UNPLACED)).alias("cell"))
        parts = F.ceil(F.count("*") / CORPUS_BLOCK).cast("int")
        # One row per pivot and two more at most.
        self.cells = materialize(self.placed.groupBy("cell").agg(parts.alias("parts"), F.max("angle").alias("radius")), "corpus-cells")
        self.small = fits_broadcast(stored, BROADCAST_VECTORS)

    def blocks(self) -> DataFrame:
        part = F.pmod(F.xxhash64("var_no"), F.col("parts")).cast("int")
        rows = self.placed.join(F.broadcast(self.cells.select("cell", "parts")), "cell")
        return rows.groupBy("cell", part.alias("part")).agg(F.collect_list(F.struct(
            "var_no", "form", "canonical", "guard", "vector", "length", "angle")).alias("members"))

    def guide(self) -> DataFrame:
        """Pivots with their cells' radius and blocks, in one row; cells without a pivot come without a vector."""
        pivots = self.pivots.select(F.explode("pivots").alias("p")).select("p.*")
        both = pivots.join(self.cells, "cell", "full")
        entry = F.struct("cell", "vector", "length", "radius", "parts")
        return both.agg(F.sort_array(F.collect_list(entry)).alias("guide")).withColumn("_all", F.lit(0))

    def visits(self, texts: DataFrame, cut: float) -> DataFrame:
        """``visits`` of every text: the blocks that may hold one of its best two vectors at ``cut`` or above.

        The pivots are the first vectors a text is compared with. Nothing beyond its second nearest pivot,
        and nothing below the cut, can count; ``reach`` is the smaller of the two angles.
        """
        bound = math.acos(max(-1.0, min(1.0, cut)))

        def within(rated: Column) -> Column:
            known = F.array_sort(F.filter(F.transform(rated, lambda r: r["angle"]), lambda a: a.isNotNull()))
            reach = F.least(F.coalesce(F.get(known, F.lit(1)), F.lit(math.pi)), F.lit(bound)) + SLACK
            return tx.let(reach, lambda limit: F.flatten(F.transform(
                F.filter(rated, lambda r: r["parts"].isNotNull() & (r["always"] | (r["angle"] - r["radius"] <= limit))),
                lambda r: F.transform(F.sequence(F.lit(0), r["parts"] - 1), lambda part: F.struct(
                    r["cell"].alias("cell"), part.alias("part"), r["angle"].alias("q_angle"), limit.alias("reach"))))))

        rated = F.transform("guide", lambda g: F.struct(
            _angle(F.col("vector"), g["vector"], F.col("q_length"), g["length"]).alias("angle"), g["vector"].isNull().alias("always"),
            g["cell"].alias("cell"), g["radius"].alias("radius"), g["parts"].alias("parts")))
        guided = texts.withColumn("_all", F.lit(0)).join(F.broadcast(self.guide()), "_all")
        return guided.select("text", "vector", "q_length", tx.let(rated, within).alias("visits"))

    def pairs(self, texts: DataFrame, cut: float) -> DataFrame:
        """Every text beside the vectors it has to be compared with, ``near``, block by block.

        A corpus beyond the broadcast bound meets the texts by a shuffle. A block many texts visit is copied, so
        that one task sees TEXTS_PER_COPY of them; copies are in proportion to the comparisons.
        """
        visits, blocks, keys = self.visits(texts, cut), self.blocks(), ["cell", "part"]
        if self.small:
            each = tx.explode_costly(visits, "visits", "v").select("text", "vector", "q_length", "v.*")
            met = each.join(F.broadcast(blocks), keys)
        else:
            each = tx.explode_costly(materialize(visits, "corpus-visits"), "visits", "v").select("text", "vector", "q_length", "v.*")
            copies = F.ceil(F.count("*") / TEXTS_PER_COPY).cast("int")
            # Blocks of a cell have the same visitors, so one number per cell will do.
            busy = materialize(each.filter("part = 0").groupBy("cell").agg(copies.alias("copies")), "corpus-copies")
            each = each.join(F.broadcast(busy), "cell").withColumn("copy", F.pmod(F.xxhash64("text"), F.col("copies")).cast("int")).drop("copies")
            copied = blocks.join(F.broadcast(busy), "cell").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
            met = each.join(copied.drop("copies"), [*keys, "copy"])
        near = F.filter("members", lambda m: F.coalesce(F.abs(m["angle"] - F.col("q_angle")) <= F.col("reach"), F.lit(True)))
        return met.select("text", "vector", "q_length", near.alias("near"))


def embedding_scores(texts: DataFrame, corpus: DataFrame, cut: float) -> DataFrame:
    """``(text, var_no, form, canonical, guard, score)``: at least the two best cosines of every text, where they
    reach ``cut``, and nothing below it.

    A corpus of one block needs no index. A vector of length zero scores 0 with every other.
    """
    query = measured(texts.select("text", "vector"), "q_length")
    stored = materialize(measured(corpus.select("var_no", "form", "canonical", "guard", "vector"), "length"), "corpus-vectors")
    total, dimension = stored.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    if total <= CORPUS_BLOCK:
        members = stored.agg(F.collect_list(F.struct(*stored.columns)).alias("near")).withColumn("_all", F.lit(0))
        pairs = query.withColumn("_all", F.lit(0)).join(F.broadcast(members), "_all")
        return _best_two(pairs, "near").filter(F.col("score") >= cut)
    index = PivotIndex(stored, total, dimension)
    found = _best_two(index.pairs(query.filter("q_length > 0"), cut), "near")
    if cut <= 0:  # a text of length zero scores 0 with all of them, so the first two are its best
        first = stored.orderBy("var_no").limit(2).withColumn("_all", F.lit(0)).drop("vector", "length")
        still = query.filter("q_length = 0").select("text", F.lit(0).alias("_all"))
        found = found.unionByName(still.join(F.broadcast(first), "_all").drop("_all").withColumn("score", F.lit(0.0)).select(*found.columns))
    return found.filter(F.col("score") >= cut)
