"""Large directed graphs in rounds over written tables: chains, peeling with labels, reachability and components.

Edges are rows (src, dst). Small connected pieces are gathered in one row each and solved there. In the rest, long chains of nodes
with one edge in and one out are contracted first, by pointers that double their reach, so that rounds follow the depth of what branches
and not the length of chains. Every round is a written table: no lineage grows, and a lost executor costs a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from hashgrove.session import fresh_path, materialize

HASHES = 2  # random orders behind the interval labels
PLAIN_ROUNDS = 4  # of a search before chains are contracted for it
FORWARD, BACKWARD = 0, 1  # sides: along the edges, against them
SMALL = 32  # nodes of a piece that is solved in one row: places in a bit mask
LEVELS = 4  # of names, after which a piece that has several left counts as large


class Log:
    """Rows written round by round and read as one table."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths, self.schema = spark, label, [], None

    def add(self, rows: DataFrame) -> DataFrame:
        path = fresh_path(self.spark, self.label)
        rows.write.parquet(path)
        self.schema = self.schema or rows.schema
        self.paths.append(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def different(edges: DataFrame) -> DataFrame:
    """Edges without repeats and without null ends, written."""
    return materialize(_plain(edges), "edges")


def _plain(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


# --- chains --------------------------------------------------------------------------------------


def degrees(edges: DataFrame) -> DataFrame:
    """Rows (node, out, into, before): edges from and to each node of different edges, and the least node before it; written."""
    kind = edges.schema["src"].dataType
    outgoing = edges.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"), F.lit(None).cast(kind).alias("before"))
    incoming = edges.select(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"), F.col("src").alias("before"))
    ends = outgoing.union(incoming).groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"), F.min("before").alias("before"))
    return materialize(ends, "degrees")


def chains(ends: DataFrame) -> DataFrame:
    """Rows (node, head, chain, place, ring, least) of all nodes with one edge in and one out, from ``degrees``.

    A chain is named by its first node; ``place`` counts from 0, and ``head`` is the node before the chain. Where such nodes
    form a cycle of their own, ``ring`` is true and ``least`` names it. The reach of a pointer doubles in each round.
    """
    inner = ends.where("out = 1 and into = 1")
    # least: of the nodes from the one before up to the pointer's end
    way = inner.select("node", F.col("before").alias("head"), F.col("node").alias("chain"), F.lit(1).cast("bigint").alias("steps"), F.col("before").alias("least"), F.lit(True).alias("open"))
    left = None
    while True:
        further = way.select(F.col("node").alias("head"), *[F.col(c).alias(f"_{c}") for c in ("head", "chain", "steps", "least", "open")])
        way = way.join(further, "head", "left").select(
            "node",
            F.coalesce("_head", "head").alias("head"),
            F.coalesce("_chain", "chain").alias("chain"),
            (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
            F.least("least", "_least").alias("least"),
            (F.col("open") & F.coalesce("_open", F.lit(False))).alias("open"),
        )
        way, before = materialize(way, "chains"), left
        still = way.where("open")
        left = still.count()
        if left == 0:
            break
        if left == before:
            # a node that has met itself is the least of a ring; the others of the ring have met it as well
            rings = still.where("least = node").select("least")
            if still.join(rings, "least", "left_anti").isEmpty():
                break
    return way.select("node", "head", "chain", (F.col("steps") - 1).alias("place"), F.col("open").alias("ring"), "least")


def contracted(edges: DataFrame, way: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst, direct) with each chain as one node, under its name; rings are left out. ``direct``: neither end is a chain.

    With ``ends`` also ``into``, the edges into ``dst``, and ``out``, those from ``src``: contraction does not change them.
    """
    named = way.select("node", "chain", "ring")
    counts = ()
    if ends is not None:
        named, counts = materialize(ends.select("node", "out", "into").join(named, "node", "left"), "nodes"), ("into", "out")
    first, last = (named.select(*[F.col(c).alias(f"{end}_{c}") for c in named.columns]) for end in ("src", "dst"))
    both = edges.join(first, F.col("src") == F.col("src_node"), "left").join(last, F.col("dst") == F.col("dst_node"), "left")
    outside = both.where("not coalesce(src_ring, false) and not (src_chain <=> dst_chain and src_chain is not null)")
    direct = F.col("src_chain").isNull() & F.col("dst_chain").isNull()
    sized = [F.col(f"{end}_{c}").alias(c) for end, c in zip(("dst", "src"), counts)]
    return materialize(outside.select(F.coalesce("src_chain", "src").alias("src"), F.coalesce("dst_chain", "dst").alias("dst"), direct.alias("direct"), *sized), "arcs")


# --- small pieces --------------------------------------------------------------------------------


def _stars(edges: DataFrame, level: int = 0) -> DataFrame:
    """Rows (node, name, tos, hub), written: each node with the nodes right behind it, named by the least, by the level's hash, of it and its neighbours.

    A ``hub`` has more than ``SMALL`` neighbours, of which some are kept. Repeated edges and null ends go.
    """
    ways = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(False).alias("out")))
    ends = edges.where("src is not null and dst is not null").select(F.inline(ways))
    # a rank limit: no more than these leave a map task
    few = ends.withColumn("place", F.dense_rank().over(Window.partitionBy("node").orderBy("other"))).where(F.col("place") <= SMALL + 1)

    def hashed(column: str) -> Column:
        return F.struct(F.xxhash64(F.lit(level), column).alias("hash"), F.col(column).alias("node"))

    stars = few.groupBy("node").agg(F.min(hashed("other")).alias("least"), F.collect_set(F.when(F.col("out"), F.col("other"))).alias("tos"), (F.max("place") > SMALL).alias("hub"))
    return materialize(stars.select("node", F.least(hashed("node"), "least")["node"].alias("name"), "tos", "hub"), "stars")


def _links(stars: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (src, dst), written: different names of one connected piece; all of its names hang together by them."""
    met = stars.select(F.explode(F.array_union(F.array("node"), "tos")).alias("node"), "name")
    hubs = stars.where("hub").select(F.col("node").alias("src"), "name")
    if not hubs.isEmpty():  # not all nodes behind a hub are in its row
        met = met.unionAll(edges.where("dst is not null").join(hubs, "src").select(F.col("dst").alias("node"), "name"))
    links = met.withColumn("first", F.min("name").over(Window.partitionBy("node"))).where("name <> first")
    return materialize(links.select(F.col("name").alias("src"), F.col("first").alias("dst")).distinct(), "links")


def _common_names(links: DataFrame, level: int = 1) -> tuple[DataFrame, DataFrame | None]:
    """Rows (name, piece) for the ends of ``links``: one name for all that hang together; and rows (piece) of the pieces that go on after ``LEVELS``, if any.

    The links are a graph of names, which get names of their own: half as many in a long chain, fewer elsewhere.
    """
    stars = _stars(links, level)
    further = _links(stars, links)
    names = stars.select(F.col("node").alias("name"), F.col("name").alias("piece"))
    if further.isEmpty():
        return names, None
    if level == LEVELS:
        return names, further.select(F.explode(F.array("src", "dst")).alias("piece")).distinct()
    above, open_ = _common_names(further, level + 1)
    above = above.select(F.col("name").alias("piece"), F.col("piece").alias("last"))
    return names.join(above, "piece", "left").select("name", F.coalesce("last", "piece").alias("piece")), open_


def _small_pieces(edges: DataFrame, answer: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame | None]:
    """Rows (found) for the connected pieces of at most ``SMALL`` nodes, written, and the different edges outside of them, if any.

    ``answer`` makes an array with one struct for each node, whose first field is ``node``, from an array of structs (node, tos) in the order of the nodes.
    """
    stars = _stars(edges)
    links = _links(stars, edges)
    rows, open_ = stars.withColumn("piece", F.col("name")), None
    if not links.isEmpty():
        names, open_ = _common_names(links)
        rows = stars.join(names, "name", "left").withColumn("piece", F.coalesce("piece", "name"))
    if open_ is not None:
        rows = rows.join(open_, "piece", "left_anti")
    some = rows.select("piece", F.struct("node", "tos").alias("tail"), "hub", F.row_number().over(Window.partitionBy("piece").orderBy("piece")).alias("place")).where(F.col("place") <= SMALL + 1)
    pieces = some.groupBy("piece").agg(F.sort_array(F.collect_list("tail")).alias("tails"), F.max("hub").alias("hub"))
    whole = pieces.where(~F.col("hub") & (F.size("tails") <= SMALL))
    found = materialize(whole.select(answer(F.col("tails")).alias("found")), "found")
    if found.agg(F.coalesce(F.sum(F.size("found")), F.lit(0))).first()[0] == stars.count():
        return found, None
    done = found.select(F.explode("found.node").alias("src"))
    return found, materialize(_plain(edges).join(done, "src", "left_anti"), "rest")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def _bit(mask: Column, place: Column) -> Column:
    return F.getbit(mask, place.cast("int")) == 1


def _with_masks(tails: Column, then: Callable[[Column, Column, Column], Column]) -> Column:
    """``then`` of the nodes, the places 0, 1, ... and a mask for each node: the places of the nodes it reaches, over one or more edges."""
    zero = F.lit(0).cast("bigint")

    def reached(nodes: Column, places: Column) -> Column:
        def mask(tail: Column) -> Column:
            return F.aggregate(tail["tos"], zero, lambda m, to: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.array_position(nodes, to) - 1).cast("int"))))

        # what a node reaches over the first k nodes
        return F.aggregate(places, F.transform(tails, mask), lambda masks, k: F.transform(masks, lambda m: F.when(_bit(m, k), m.bitwiseOR(masks[k])).otherwise(m)))

    places = F.sequence(F.lit(0), F.size(tails) - 1)
    return _let(tails["node"], lambda nodes: _let(places, lambda each: _let(reached(nodes, each), lambda masks: then(nodes, each, masks))))


def _needed(tails: Column) -> Column:
    """Structs (node, tos, cyclic): of the nodes behind each node those that no other of them reaches, and whether the node lies on a cycle."""

    def of_all(nodes: Column, places: Column, masks: Column) -> Column:
        def of_one(tail: Column, place: Column) -> Column:
            far = F.aggregate(tail["tos"], F.lit(0).cast("bigint"), lambda m, to: m.bitwiseOR(masks[(F.array_position(nodes, to) - 1).cast("int")]))
            tos = _let(far, lambda m: F.filter(tail["tos"], lambda to: ~_bit(m, F.array_position(nodes, to) - 1)))
            return F.struct(tail["node"].alias("node"), tos.alias("tos"), _bit(masks[place], place).alias("cyclic"))

        return F.transform(tails, of_one)

    return _with_masks(tails, of_all)


def _least_on_cycle(tails: Column) -> Column:
    """Structs (node, component): the least node that reaches a node and is reached by it, null without any."""

    def of_all(nodes: Column, places: Column, masks: Column) -> Column:
        def of_one(node: Column, place: Column) -> Column:
            both = F.filter(places, lambda k: _bit(masks[place], k) & _bit(masks[k], place))
            return F.struct(node.alias("node"), F.when(_bit(masks[place], place), nodes[both[0]]).alias("component"))

        return F.transform(nodes, of_one)

    return _with_masks(tails, of_all)


# --- peeling -------------------------------------------------------------------------------------


LOW, HIGH = [f"low{k}" for k in range(HASHES)], [f"high{k}" for k in range(HASHES)]


def peel(arcs: DataFrame, back: bool = False, labels: bool = True) -> DataFrame:
    """Rows (side, node, level and labels) of the nodes that peeling from the start, or with ``back`` from both ends at once, takes away.

    A node goes when all before it have gone; its level is the longest way to it. With random hashes of the nodes, ``low`` and
    ``high`` are the least and greatest of a node and all before it. Nodes on a cycle, and behind it on that side, are missing.
    ``arcs`` has src, dst, into and out.
    """
    low, high = (LOW, HIGH) if labels else ([], [])
    hashes = [F.xxhash64(F.lit(k), "node") for k in range(len(low))]
    side = F.lit(FORWARD).alias("side")
    sides = arcs.select(side, "src", "dst", F.col("into").cast("int").alias("need"))
    # a node without an arc into it is the source of one
    met_by = arcs.select(side, F.col("dst").alias("node"))
    if back:
        other = F.lit(BACKWARD).alias("side")
        sides = sides.union(arcs.select(other, F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("out").cast("int").alias("need")))
        met_by = met_by.union(arcs.select(other, F.col("src").alias("node")))
    first = sides.select("side", F.col("src").alias("node")).distinct().join(met_by, ["side", "node"], "left_anti")
    none = F.lit(0)
    start = first.select("side", "node", none.alias("need"), none.alias("got"), none.alias("level"), *[h.alias(n) for n, h in zip(low + high, hashes * 2)])
    log = Log(arcs.sparkSession, "peeled")
    frontier, waiting = log.add(start), None
    while not frontier.isEmpty():
        front = frontier.select("side", F.col("node").alias("src"), "level", *low, *high)
        sent = sides.join(front, ["side", "src"]).select("side", F.col("dst").alias("node"), "need", F.lit(1).alias("got"), (F.col("level") + 1).alias("level"), *low, *high)
        met = sent if waiting is None else sent.unionByName(waiting)
        ends = [F.min(n).alias(n) for n in low] + [F.max(n).alias(n) for n in high]
        met = met.groupBy("side", "node", "need").agg(F.sum("got").cast("int").alias("got"), F.max("level").alias("level"), *ends)
        full = F.col("got") == F.col("need")
        own = [F.when(full, F.least(n, h)).otherwise(F.col(n)).alias(n) for n, h in zip(low, hashes)] + [F.when(full, F.greatest(n, h)).otherwise(F.col(n)).alias(n) for n, h in zip(high, hashes)]
        newest = log.add(met.select("side", "node", "need", "got", "level", *own))
        frontier, waiting = newest.where("got = need"), newest.where("got < need")
    return log.all().where("got = need").drop("need", "got")


# --- reachability --------------------------------------------------------------------------------


def reachable(edges: DataFrame, seeds: DataFrame, max_rounds: int = 10_000, within: bool = True) -> DataFrame:
    """Rows (node): the nodes of the graph that are seeds or lie behind one. ``seeds`` has a column ``node``.

    Without ``within``, seeds that are no nodes of the graph are kept as well, which spares a look at all nodes.

    The first ``PLAIN_ROUNDS`` rounds, and more as long as each finds fewer nodes than the one before, follow edges one by one. What is left then is searched
    with chains contracted, each crossed in one round: those rounds follow the depth of what branches, plus the logarithm of the longest chain.
    """
    edges = different(edges)
    log = Log(edges.sparkSession, "reached")
    start = seeds.select("node").where("node is not null")
    if within:
        ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
        start = ends.join(start, "node", "left_semi")
    newest = log.add(start.distinct())
    (found, low, high), rounds = _extent(newest), 0
    while found:
        # the rows of other sources stay where they are: where nodes of two kinds alternate, these are half of the edges
        newest, rounds = _behind(edges.where(F.col("src").between(low, high)), newest, log), rounds + 1
        before, (found, low, high) = found, _extent(newest)
        if rounds >= PLAIN_ROUNDS and found >= before:
            break
    if not found:
        return log.all()
    return log.all().union(_reachable_by_chains(edges, newest, max_rounds)).distinct()


def _extent(nodes: DataFrame) -> Row:
    """How many ``nodes`` there are, the least and the greatest of them."""
    return nodes.agg(F.count("node"), F.min("node"), F.max("node")).first()


def _behind(arcs: DataFrame, newest: DataFrame, log: Log) -> DataFrame:
    """Nodes right behind the ``newest`` that are not in the log yet, added to it."""
    found = arcs.join(newest.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    return log.add(found.join(log.all(), "node", "left_anti"))


def _reachable_by_chains(edges: DataFrame, seeds: DataFrame, max_rounds: int) -> DataFrame:
    """``reachable`` for different edges and different nodes of theirs, both written."""
    way = chains(degrees(edges))
    arcs = contracted(edges, way)
    inside = materialize(way.join(seeds, "node", "left_semi"), "seeds")
    started = inside.where("not ring").groupBy("chain").agg(F.min("place").alias("from"))
    started = materialize(started, "seeds")
    log = Log(edges.sparkSession, "reached")
    newest = log.add(seeds.join(inside.select("node"), "node", "left_anti").union(started.select("chain")))
    for _ in range(max_rounds):
        if newest.isEmpty():
            break
        newest = _behind(arcs, newest, log)
    else:
        raise RuntimeError(f"ways longer than {max_rounds} nodes")
    seen = log.all()
    open_ = way.where("not ring")
    # a chain is reached whole from its head, or else from its first seed on
    entered = open_.join(seen.select(F.col("node").alias("head")), "head", "left_semi").select("node")
    later = open_.join(started, "chain").where("place >= from").select("node")
    rings = way.where("ring").join(inside.where("ring").select("least").distinct(), "least", "left_semi").select("node")
    plain = seen.join(way.select("node"), "node", "left_anti")
    return plain.union(entered).union(later).union(rings).distinct()


def _possible(x: str, y: str) -> Column:
    """Whether the labels leave it open that x reaches y: it has the lower level, and its intervals lie within those of y."""
    open_ = F.col(f"{x}.level") < F.col(f"{y}.level")
    for low, high in zip(LOW, HIGH):
        open_ = open_ & (F.col(f"{y}.{low}") <= F.col(f"{x}.{low}")) & (F.col(f"{x}.{high}") <= F.col(f"{y}.{high}"))
    return open_


def _search(arcs: DataFrame, pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Those of the ``pairs`` (x, y) with a way from x to y; only nodes whose labels leave it open are visited."""
    log, hits = Log(arcs.sparkSession, "search"), Log(arcs.sparkSession, "search")
    named = marks.select(F.col("node").alias("y"), F.col("mark").alias("y_mark"))
    newest = log.add(pairs.select("x", "y", F.col("x").alias("z")))
    steps = arcs.select(F.col("src").alias("z"), "dst")
    while not newest.isEmpty():
        on = newest.join(steps, "z").select("x", "y", F.col("dst").alias("z")).distinct()
        known = on.join(log.all(), ["x", "y", "z"], "left_anti").join(marks.select(F.col("node").alias("z"), F.col("mark").alias("z_mark")), "z").join(named, "y")
        on = materialize(known.where((F.col("z") == F.col("y")) | _possible("z_mark", "y_mark")).select("x", "y", "z"), "search")
        hit = hits.add(on.where("z = y").select("x", "y"))
        newest = log.add(on.join(hit, ["x", "y"], "left_anti"))
    return hits.all() if hits.paths else pairs.limit(0)


def redundant(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) for which there is a longer way as well; raises on a cycle. ``edges`` are different ones.

    An edge is redundant if its source reaches another node right before its target, or another node right behind its source
    reaches its target; the smaller of these groups is tested, so a hub costs no more than its neighbours' edges. Levels tell most
    edges apart, direct edges and interval labels most of the tested pairs; only what they leave open is searched.
    """
    ends = degrees(edges)
    way = chains(ends)
    if not way.where("ring").isEmpty():
        raise ValueError("dependencies form a cycle")
    arcs = contracted(edges, way, ends)
    marks = materialize(peel(arcs).select("node", F.struct("level", *LOW, *HIGH).alias("mark")), "marks")
    level = marks.select("node", F.col("mark.level").alias("level"))
    # what peeling leaves has an arc into it
    leveled = arcs.join(level.select(F.col("node").alias("dst"), F.col("level").alias("high")), "dst", "left")
    leveled = leveled.join(level.select(F.col("node").alias("src"), F.col("level").alias("low")), "src", "left")
    # the longest way to the target is longer than this edge; or there is a cycle
    asked = materialize(leveled.where("high is null or direct and high > low + 1 and into > 1 and out > 1").select("src", "dst", "into", "out", "high"), "asked")
    if not asked.where("high is null").isEmpty():
        raise ValueError("dependencies form a cycle")
    before = asked.where("into <= out").join(arcs.select(F.col("src").alias("y"), "dst"), "dst").where("y <> src").select("src", "dst", F.col("src").alias("x"), "y")
    behind = asked.where("into > out").join(arcs.select("src", F.col("dst").alias("x")), "src").where("x <> dst").select("src", "dst", "x", F.col("dst").alias("y"))
    pairs = materialize(before.union(behind), "pairs")
    known = arcs.select(F.col("src").alias("x"), F.col("dst").alias("y"))
    found = materialize(pairs.join(known, ["x", "y"], "left_semi").select("src", "dst").distinct(), "found")
    rest = pairs.join(found, ["src", "dst"], "left_anti")
    for end in "xy":
        rest = rest.join(marks.select(F.col("node").alias(end), F.col("mark").alias(f"{end}_mark")), end)
    rest = materialize(rest.where(_possible("x_mark", "y_mark")).select("src", "dst", "x", "y"), "open")
    hits = _search(arcs, rest.select("x", "y").distinct(), marks)
    return found.union(rest.join(hits, ["x", "y"], "left_semi").select("src", "dst").distinct())


def reduced(edges: DataFrame) -> DataFrame:
    """Different edges (src, dst) without those for which there is a longer way as well; raises on a cycle.

    Small pieces are solved in one row each, see ``redundant`` for the others.
    """
    found, rest = _small_pieces(edges, _needed)
    nodes = found.select(F.inline("found"))
    if not nodes.where("cyclic").isEmpty():
        raise ValueError("dependencies form a cycle")
    kept = nodes.select(F.col("node").alias("src"), F.explode("tos").alias("dst"))
    if rest is None:
        return kept
    return kept.union(rest.join(materialize(redundant(rest), "redundant"), ["src", "dst"], "left_anti"))


# --- components ----------------------------------------------------------------------------------


def _colours(arcs: DataFrame) -> DataFrame:
    """Rows (node, colour): the greatest of a node and all that reach it."""
    ends = arcs.select(F.col("src").alias("node")).union(arcs.select("dst")).distinct()
    now = materialize(ends.withColumn("colour", F.col("node")), "colours")
    changed = now
    while not changed.isEmpty():
        sent = arcs.join(changed.select(F.col("node").alias("src"), "colour"), "src").select(F.col("dst").alias("node"), "colour")
        top = now.withColumn("old", F.col("colour")).unionByName(sent.withColumn("old", F.lit(None).cast(now.schema["colour"].dataType)))
        step = materialize(top.groupBy("node").agg(F.max("colour").alias("colour"), F.max("old").alias("old")), "colours")
        now, changed = step.select("node", "colour"), step.where("colour <> old").select("node", "colour")
    return now


def _trimmed(arcs: DataFrame) -> DataFrame:
    """Arcs (src, dst) between nodes that peeling from neither side takes away; ``arcs`` has src, dst, into and out."""
    gone = materialize(peel(arcs, back=True, labels=False).select("node").distinct(), "trimmed")
    first, last = gone.select(F.col("node").alias("src")), gone.select(F.col("node").alias("dst"))
    return materialize(arcs.select("src", "dst").join(first, "src", "left_anti").join(last, "dst", "left_anti"), "core")


def _counted(arcs: DataFrame) -> DataFrame:
    """``arcs`` with the numbers of arcs into ``dst`` and from ``src``, written."""
    arcs = materialize(arcs, "core")
    ends = degrees(arcs).select("node", "out", "into")
    both = arcs.join(ends.select(F.col("node").alias("dst"), "into"), "dst").join(ends.select(F.col("node").alias("src"), "out"), "src")
    return materialize(both, "core")


def strong_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) of the nodes on a cycle, self-loops included; a component is named by its least node.

    Small pieces are solved in one row each, see ``_large_components`` for the others.
    """
    found, rest = _small_pieces(edges, _least_on_cycle)
    members = found.select(F.inline("found")).where("component is not null")
    return members if rest is None else members.union(_large_components(rest))


def _large_components(edges: DataFrame) -> DataFrame:
    """``strong_components`` for different edges, written, in rounds over all of them.

    Chains are contracted and rings among them set apart, then nodes without an edge in or out are taken away until none is left. In what
    remains, the greatest node that reaches a node is its colour; backward from the greatest node, within its colour, lies its component. This
    is repeated on what is left, which loses a node of every colour each time.
    """
    ends = degrees(edges)
    way = chains(ends)
    arcs = _trimmed(contracted(edges, way, ends))
    found = Log(edges.sparkSession, "components")
    found.add(arcs.limit(0).select(F.col("src").alias("node"), F.col("src").alias("colour")))
    while not arcs.isEmpty():
        colours = _colours(arcs)
        named = [colours.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour")) for end in ("src", "dst")]
        within = materialize(arcs.join(named[0], "src").join(named[1], "dst").where("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("colour")), "core")
        own = Log(edges.sparkSession, "backward")
        newest = own.add(within.where("dst = colour").select(F.col("dst").alias("node"), "colour").distinct())
        while not newest.isEmpty():
            back = within.join(newest.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"], "left_semi").select(F.col("src").alias("node"), "colour").distinct()
            newest = own.add(back.join(own.all(), ["node", "colour"], "left_anti"))
        # a root that nothing in its colour leads back to stands alone
        found.add(own.all())
        roots = colours.where("node = colour").select("node")
        gone = materialize(own.all().select("node").union(roots).distinct(), "components")
        left = arcs.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
        if left.isEmpty():
            break
        arcs = _trimmed(_counted(left))
    members = found.all().distinct()
    chained = way.where("not ring").select("node", "chain")
    whole = members.join(chained.select("node", F.col("chain")).withColumnsRenamed({"node": "inner", "chain": "node"}), "node").select(F.col("inner").alias("node"), "colour")
    single = members.join(chained.select("node"), "node", "left_anti")
    every = materialize(single.union(whole).distinct(), "members")
    names = every.groupBy("colour").agg(F.min("node").alias("component"))
    rings = way.where("ring").select("node", F.col("least").alias("component"))
    return every.join(names, "colour").select("node", "component").union(rings).distinct()

