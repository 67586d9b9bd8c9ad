"""Dependency tables: edges, reachability, reduction, rules and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashgrove.operators import graphs
from hashgrove.operators.keyed import left_join
from hashgrove.session import fresh_path, materialize

OK, NOT_OK = "ok", "not_ok"  # whether the dependent task also runs after a failure
# Trigger rules of a task.
RUN_ALWAYS, RUN_ON_SUCCESS = "all_done", "all_success"


# --- edges ---------------------------------------------------------------------------------------


def build_edges(declarations: DataFrame) -> DataFrame:
    """Edges from declarations: each ``from`` task of a declaration precedes each ``to`` task.

    Columns: decl_id, side ('from' or 'to'), task, mode.
    """
    before = declarations.where("side = 'from'").select(
        "decl_id", "mode", F.col("task").alias("src")
    )
    after = declarations.where("side = 'to'").select("decl_id", F.col("task").alias("dst"))
    # repeats would multiply in the product
    product = before.distinct().join(after.distinct(), "decl_id")
    return product.select("src", "dst", "mode").distinct()


def root_edges(tasks: DataFrame, root: str, task: str = "task") -> DataFrame:
    """Edges from ``root`` to every task."""
    return tasks.select(
        F.lit(root).alias("src"), F.col(task).alias("dst"), F.lit(NOT_OK).alias("mode")
    ).distinct()


def final_edges(tasks: DataFrame, finals: Sequence[str], task: str = "task") -> DataFrame:
    """Edges from every task to each final task, which runs even after failures."""
    return tasks.select(
        F.col(task).alias("src"),
        F.explode(F.array(*[F.lit(f) for f in finals])).alias("dst"),
        F.lit(OK).alias("mode"),
    ).distinct()


def bag_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def edge_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return _pairs(a).unionByName(_pairs(b)).distinct()


def edge_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return _pairs(a).intersect(_pairs(b))


def edge_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _pairs(a).subtract(_pairs(b))


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst")


# --- reachability --------------------------------------------------------------------------------


class _PairLog:
    """Pairs written round by round; each pair is written once."""

    def __init__(self, spark: SparkSession, schema):
        self.spark, self.schema, self.paths = spark, schema, []

    def add(self, pairs: DataFrame) -> DataFrame:
        path = fresh_path(self.spark, "reach")
        pairs.write.parquet(path)
        written = self.spark.read.schema(self.schema).parquet(path)
        self.paths.append(path)
        return written

    def first(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.paths[0])

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def _reach(edges: DataFrame, max_rounds: int) -> _PairLog:
    log = _PairLog(edges.sparkSession, _pairs(edges).schema)
    newest = log.add(_pairs(edges).where("src is not null and dst is not null").distinct())
    for _ in range(max_rounds):
        known = log.all()
        extended = newest.select("src", F.col("dst").alias("_mid")).join(
            known.select(F.col("src").alias("_mid"), "dst"), "_mid"
        )
        # one aggregate removes repeats and known pairs alike, combining before its shuffle
        newest = log.add(
            extended.select("src", "dst", F.lit(False).alias("_known"))
            .unionByName(known.withColumn("_known", F.lit(True)))
            .groupBy("src", "dst")
            .agg(F.bool_or("_known").alias("_known"))
            .where("not _known")
            .select("src", "dst")
        )
        if newest.isEmpty():
            return log
    raise RuntimeError(f"paths longer than 2^{max_rounds} edges")


def closure(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """All pairs (src, dst) with a path of one or more edges from src to dst.

    Round i finds the pairs whose shortest path has between 2^i and 2^(i+1) edges: such a path
    splits into one of the newest length and one known already. So the number of rounds is the
    logarithm of the longest path, and only new pairs are extended and written. Rounds go to the
    shared folder, so no lineage builds up.
    """
    return _reach(edges, max_rounds).all()


def cycles(edges: DataFrame) -> DataFrame:
    """Tasks that reach themselves, with the least task of their cycle's component: rows (task, component)."""
    return graphs.strong_components(edges).select(F.col("node").alias("task"), "component")


def reduction(edges: DataFrame) -> DataFrame:
    """Edges without those that another direct successor of the same task makes redundant.

    An edge (n, t) is redundant if some direct successor of n reaches t. Raises on a cycle, where
    this rule would drop edges that nothing replaces. No closure is made: see ``graphs.reduced``.
    """
    return graphs.reduced(_pairs(edges))


def sorted_edges(edges: DataFrame) -> DataFrame:
    """Different edges in the order of their tasks."""
    return _pairs(edges).distinct().orderBy("src", "dst")


# --- rules and labels ----------------------------------------------------------------------------


def trigger_rules(edges: DataFrame) -> DataFrame:
    """Rule per dependent task: run always if failures before it are ok, else on success."""
    return edges.groupBy("dst").agg(
        F.when(F.bool_or(F.col("mode") == OK), RUN_ALWAYS).otherwise(RUN_ON_SUCCESS).alias("rule")
    )


def trigger_conflicts(edges: DataFrame) -> DataFrame:
    """Tasks with incoming edges of both modes, and how many of each."""
    return (
        edges.groupBy("dst")
        .agg(
            F.count_if(F.col("mode") == OK).alias("n_ok"),
            F.count_if(F.col("mode") == NOT_OK).alias("n_not_ok"),
        )
        .where("n_ok > 0 and n_not_ok > 0")
    )


def spread_label(declarations: DataFrame, seeds: DataFrame, task: str = "task", max_rounds: int = 10_000) -> DataFrame:
    """(task, reason) rows of a label that follows declarations: each seed has itself as its reason.

    A declaration (decl_id, side 'from' or 'to', task) with a labelled task on its 'from' side labels its 'to' side, and
    every task of that 'from' side is a reason, labelled or not. Tasks and declarations are nodes of one graph, where the
    declarations behind a seed are looked for; rows of declarations in a row are crossed in one round.
    """
    # named as nodes of the graph
    key = F.concat(F.lit("d"), F.col("decl_id").cast("string")).alias("decl")
    sides = declarations.where(F.col("task").isNotNull() & F.col("decl_id").isNotNull())
    before = sides.where("side = 'from'").select(key, F.col("task").alias("src"))
    after = sides.where("side = 'to'").select(key, F.col("task").alias("dst"))
    seeds = materialize(seeds.select(F.col(task).alias("task")).where(F.col("task").isNotNull()).distinct(), "label")

    def node(column: str) -> Column:
        return F.concat(F.lit("t"), F.col(column).cast("string"))

    # the search takes different edges
    into = before.select(node("src").alias("src"), F.col("decl").alias("dst"))
    out = after.select(F.col("decl").alias("src"), node("dst").alias("dst"))
    met = graphs.reachable(into.unionAll(out), seeds.select(node("task").alias("node")), max_rounds, within=False)
    fired = materialize(met.where(F.col("node").startswith("d")).select(F.col("node").alias("decl")), "label")
    # all by the declaration: each side is moved once; repeats would multiply in the product
    labelled = after.join(fired, "decl", "left_semi").distinct()
    causes = before.join(fired, "decl", "left_semi").distinct()
    reasons = labelled.join(causes, "decl").select(F.col("dst").alias("task"), F.col("src").alias("reason"))
    return seeds.select("task", F.col("task").alias("reason")).unionByName(reasons).distinct()


def ready_tasks(edges: DataFrame, done: DataFrame, task: str = "task") -> DataFrame:
    """Per dependent task: whether all tasks right before it are done, and how many block it."""
    finished = done.select(F.col(task).alias("src")).distinct().withColumn("_done", F.lit(True))
    # a task before many others is a hot key
    before = left_join(_pairs(edges).distinct(), finished, ["src"])
    return before.groupBy("dst").agg(
        F.bool_and(F.col("_done").isNotNull()).alias("ready"),
        F.count_if(F.col("_done").isNull()).alias("blocking"),
    )
