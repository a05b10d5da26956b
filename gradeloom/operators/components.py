"""Connected components: minimum label with pointer jumping, and alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.session import delete_table, write_table

CONTRACT_ABOVE = 1 << 18


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label) for every node of ``edges``; the label is the smallest id of its component.

    Each round lowers a node's label to the smallest one among its neighbours and, one
    step further, to that label's own label.  Both are equi joins against a table with
    unique ids plus a mergeable minimum, so a hub costs one partial row per task.  Every
    round is written out: a lost executor costs one round, and the round before it is
    deleted.  Labels only fall, so it ends.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    spark = edges.sparkSession
    both, both_path = write_table(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    first = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near"))
    labels, path = write_table(first.select("id", F.least("id", "near").alias("label")), "cc-labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        )
        beyond = labels.select(F.col("id").alias("near"), F.col("label").alias("via"))
        lowered = labels.join(near, "id").join(beyond, "near")
        rounded, new_path = write_table(
            lowered.select("id", F.col("label").alias("old"), F.least("label", "near", "via").alias("label")), "cc-labels")
        delete_table(spark, path)
        labels, path = rounded.select("id", "label"), new_path
        if rounded.where("old <> label").limit(1).count() == 0:
            delete_table(spark, both_path)
            return labels


def star_components(edges: DataFrame, a: str = "a", b: str = "b", small: int = CONTRACT_ABOVE) -> DataFrame:
    """(id, label) as ``connected_components``, by contraction and then alternating large-star and small-star steps.

    While there are more than ``small`` edges, every node moves to the neighbour with the smallest
    hash in its neighbourhood, and on to that node's own choice; moved nodes and equal edges fall
    together.  On a chain about a third of the nodes are left after each round, so all rounds together
    cost little more than the first.  A node carries the smallest id that fell into it, and the
    labels come back round by round.

    Of the edges left, a large-star hangs every larger neighbour of a node on the smallest node it
    knows, a small-star every smaller one.  Both keep the components and the number of edges within
    bounds, and a chain of n nodes becomes a star in about log n rounds, where labels that pass from
    neighbour to neighbour need more.  Each step is one minimum per node and one equi join with it.
    Every round is written.

    Self loops name a node; nulls name none.  The steps end when a round changes no edge.
    """
    spark = edges.sparkSession
    given = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    nodes, nodes_path = write_table(given.select(F.col("a").alias("id")).unionByName(given.select(F.col("b").alias("id"))).distinct().select(
        "id", F.col("id").alias("low")), "star-nodes")
    current, path = write_table(given.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star-edges")
    moves: list[tuple[DataFrame, str]] = []
    while current.count() > small:
        choice, choice_path = write_table(_choices(nodes, current, len(moves)), "star-choices")
        moved, moved_path = write_table(_moves(choice), "star-moves")
        fewer, fewer_path = write_table(_moved_edges(current, moved), "star-edges")
        left, left_path = write_table(moved.where("rep is not null").groupBy(F.col("rep").alias("id")).agg(F.min("low").alias("low")), "star-nodes")
        for done in (path, nodes_path, choice_path):
            delete_table(spark, done)
        nodes, nodes_path, current, path = left, left_path, fewer, fewer_path
        moves.append((moved, moved_path))
    before = None
    while True:
        step, new_path = write_table(_small_star(_large_star(current)), "star-edges")
        delete_table(spark, path)
        current, path = step, new_path
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    rooted = nodes.join(current.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select(
        "id", "low", F.coalesce("root", "id").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("label"))
    labels, labels_path = write_table(rooted.join(lowest, "root").select("id", "label"), "star-labels")
    delete_table(spark, path)
    delete_table(spark, nodes_path)
    for moved, moved_path in reversed(moves):
        ended = moved.where("rep is null").select("id", F.col("low").alias("label"))
        back = moved.where("rep is not null").select(F.col("id"), F.col("rep")).join(labels.select(F.col("id").alias("rep"), "label"), "rep")
        step, new_path = write_table(ended.unionByName(back.select("id", "label")), "star-labels")
        delete_table(spark, labels_path)
        delete_table(spark, moved_path)
        labels, labels_path = step, new_path
    return labels


def _choices(nodes: DataFrame, e: DataFrame, salt: int) -> DataFrame:
    """(id, low, near): the node with the smallest hash among a node and its neighbours; null without edges."""
    def place(c):
        return F.xxhash64(F.col(c), F.lit(salt))
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("h", place("v"))
    near = both.groupBy(F.col("u").alias("id")).agg(F.min_by("v", "h").alias("near"), F.min("h").alias("h"))
    return nodes.join(near, "id", "left").select(
        "id", "low", F.when(F.col("h") < place("id"), F.col("near")).when(F.col("h").isNotNull(), F.col("id")).alias("near"))


def _moves(choice: DataFrame) -> DataFrame:
    """(id, low, rep): each node moves to the choice of its choice."""
    beyond = choice.where("near is not null").select(F.col("id").alias("near"), F.col("near").alias("rep"))
    return choice.join(beyond, "near", "left").select("id", "low", "rep")


def _moved_edges(e: DataFrame, moved: DataFrame) -> DataFrame:
    """The edges between the places that their ends moved to."""
    to = moved.where("rep is not null").select("id", "rep")
    one = e.join(to.withColumnsRenamed({"id": "u", "rep": "x"}), "u").select("v", "x")
    two = one.join(to.withColumnsRenamed({"id": "v", "rep": "y"}), "v").where("x <> y")
    return two.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    """Each neighbour above a node moves to the smallest of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its neighbours below it move to the smallest of these."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    below = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
