"""Order and reach of dependencies between modules: cycles, load levels, closure.

A repository's graph of up to ``LOCAL_EDGES`` edges is the work of one task, all such graphs
side by side.  Larger ones are worked on as edge tables, each round one written table, so a
module may have any number of dependants and a repository any number of modules.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addonscope.session import materialize

_NODE = ["repo", "node"]
#: Edges of a repository that one task holds, some tens of MB.
LOCAL_EDGES = 200_000
_PLACED = "repo string, node string, component string, level int"


def internal_edges(modules: DataFrame) -> DataFrame:
    """(repo, src, dst): a module and another of its repository that it depends on."""
    names = modules.select("repo", F.col("module_name").alias("dst")).distinct()
    edges = modules.select("repo", F.col("module_name").alias("src"), F.explode("depends").alias("dst"))
    return edges.where("src <> dst").distinct().join(names, ["repo", "dst"], "left_semi").select(
        "repo", "src", "dst"
    )


def _nodes(edges: DataFrame, *ends: str) -> DataFrame:
    found = [edges.select("repo", F.col(end).alias("node")) for end in ends]
    return found[0].distinct() if len(found) == 1 else found[0].unionByName(found[1]).distinct()


def _among(edges: DataFrame, nodes: DataFrame, *ends: str) -> DataFrame:
    """Edges whose ends are among the nodes."""
    for end in ends:
        edges = edges.join(nodes.select("repo", F.col("node").alias(end)), ["repo", end], "left_semi")
    return edges.select("repo", "src", "dst")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without incoming or without outgoing edges are gone, again and again."""
    count = edges.count()
    while count:
        kept = _nodes(edges, "src").join(_nodes(edges, "dst"), _NODE, "left_semi")
        edges = materialize(_among(edges, kept, "src", "dst"), "trimmed")
        before, count = count, edges.count()
        if count == before:
            break
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """(repo, node, colour): the smallest node that each node leads to, itself included."""
    colours = materialize(
        _nodes(edges, "src", "dst").withColumn("colour", F.col("node")), "colours"
    )
    while True:
        seen = edges.join(colours.withColumnRenamed("node", "dst"), ["repo", "dst"]).groupBy(
            "repo", F.col("src").alias("node")
        ).agg(F.min("colour").alias("seen"))
        moved = materialize(
            colours.join(seen, _NODE, "left").select(
                "repo", "node", F.least("colour", "seen").alias("colour"),
                (F.col("seen") < F.col("colour")).alias("moved"),
            ),
            "colours",
        )
        colours = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return colours


def _reached(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """(repo, node, colour): nodes that the smallest node of their colour leads to.

    Both lead to each other, so they are one component.
    """
    of = lambda end: colours.select("repo", F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))
    within = materialize(
        edges.join(of("src"), ["repo", "src"]).join(of("dst"), ["repo", "dst"])
        .where("src_colour = dst_colour").select("repo", "src", "dst"),
        "coloured",
    )
    front = found = materialize(colours.where("node = colour"), "front")
    while True:
        ahead = within.join(front.withColumnRenamed("node", "src"), ["repo", "src"]).select(
            "repo", F.col("dst").alias("node"), "colour"
        )
        front = materialize(ahead.distinct().join(found, _NODE, "left_anti"), "front")
        if front.isEmpty():
            return found
        found = materialize(found.unionByName(front), "found")


def strong_components(edges: DataFrame) -> DataFrame:
    """(repo, node, component) of the nodes that lie on a cycle; the component is its smallest node.

    ``edges`` are (repo, src, dst).  Nodes that cannot lie on a cycle are trimmed away; then
    every node takes the smallest node that it leads to as its colour, and what that node
    leads to within its colour is its component.  What is left is trimmed and coloured again.
    """
    edges = _trimmed(edges)
    components = None
    while not edges.isEmpty():
        found = _reached(edges, _coloured(edges))
        sizes = found.groupBy("repo", F.col("colour").alias("component")).count().where("count > 1")
        own = found.withColumnRenamed("colour", "component").join(
            sizes.select("repo", "component"), ["repo", "component"], "left_semi"
        ).select(*_NODE, "component")
        components = own if components is None else components.unionByName(own)
        left = _nodes(edges, "src", "dst").join(found, _NODE, "left_anti")
        edges = _trimmed(materialize(_among(edges, left, "src", "dst"), "left"))
    if components is None:
        return edges.select("repo", F.col("src").alias("node"), F.col("src").alias("component"))
    return materialize(components, "components")


def _place(edges: pd.DataFrame) -> pd.DataFrame:
    """Components and levels of one graph in a depth-first walk.

    A component is complete when the walk leaves its first node; all it depends on is
    complete by then, so its level is known.
    """
    ahead: dict[str, list[str]] = {}
    for src, dst in zip(edges["src"], edges["dst"]):
        ahead.setdefault(src, []).append(dst)
        ahead.setdefault(dst, [])
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    component: dict[str, str] = {}
    level: dict[str, int] = {}
    path: list[str] = []
    for root in ahead:
        walk = [] if root in number else [(root, iter(ahead[root]))]
        while walk:
            node, rest = walk[-1]
            if node not in number:
                number[node] = low[node] = len(number)
                path.append(node)
            for dst in rest:
                if dst not in number:
                    walk.append((dst, iter(ahead[dst])))
                    break
                if dst not in component:
                    low[node] = min(low[node], number[dst])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == number[node]:
                    at = len(path) - 1
                    while path[at] != node:
                        at -= 1
                    members, path = path[at:], path[:at]
                    needs = [level[d] for m in members for d in ahead[m] if d in component]
                    first, own = min(members), 1 + max(needs, default=-1)
                    for m in members:
                        component[m], level[m] = first, own
    return pd.DataFrame(
        {"repo": edges["repo"].iloc[0], "node": list(component), "component": component.values(), "level": level.values()}
    )


def _place_by_rounds(edges: DataFrame) -> DataFrame:
    """The same of graphs of any size: components, then components raised above what they need."""
    cycles = strong_components(edges)
    members = materialize(
        _nodes(edges, "src", "dst").join(cycles, _NODE, "left").withColumn(
            "component", F.coalesce("component", "node")
        ),
        "members",
    )
    of = lambda end: members.select("repo", F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
    condensed = materialize(
        edges.join(of("src"), ["repo", "src"]).join(of("dst"), ["repo", "dst"])
        .where("src_component <> dst_component")
        .select("repo", F.col("src_component").alias("src"), F.col("dst_component").alias("dst")).distinct(),
        "condensed",
    )
    levels = materialize(
        members.select("repo", "component").distinct().withColumn("level", F.lit(0)), "levels"
    )
    raised = not condensed.isEmpty()
    while raised:
        above = condensed.join(levels.withColumnRenamed("component", "dst"), ["repo", "dst"]).groupBy(
            "repo", F.col("src").alias("component")
        ).agg((F.max("level") + 1).alias("above"))
        moved = materialize(
            levels.join(above, ["repo", "component"], "left").select(
                "repo", "component", F.greatest("level", "above").alias("level"),
                (F.col("above") > F.col("level")).alias("moved"),
            ),
            "levels",
        )
        levels = moved.drop("moved")
        raised = not moved.where("moved").isEmpty()
    return members.join(levels, ["repo", "component"]).select(*_NODE, "component", "level")


def load_order(modules: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(repo, module_name, component, size, level) of every module name of a repository.

    Modules that depend on each other in a circle are one component, named by its smallest
    module; ``size`` counts its modules.  ``level`` is 0 without dependencies inside the
    repository, else one more than the highest level of what the component depends on, so
    loading level by level meets every dependency that is not part of a circle.
    """
    edges = materialize(internal_edges(modules), "dependencies")
    large = materialize(
        edges.groupBy("repo").count().where(F.col("count") > local_edges).select("repo"), "large"
    )
    placed = edges.join(large, "repo", "left_anti").select("repo", "src", "dst").groupBy("repo").applyInPandas(
        _place, _PLACED
    )
    if not large.isEmpty():
        far = edges.join(large, "repo", "left_semi").select("repo", "src", "dst")
        placed = placed.unionByName(_place_by_rounds(materialize(far, "dependencies")))
    names = modules.select("repo", F.col("module_name").alias("node")).distinct()
    members = materialize(
        names.join(placed, _NODE, "left").select(
            *_NODE, F.coalesce("component", "node").alias("component"), F.coalesce("level", F.lit(0)).alias("level")
        ),
        "members",
    )
    sizes = members.groupBy("repo", "component").agg(F.count("*").alias("size"))
    return members.join(sizes, ["repo", "component"]).select(
        "repo", F.col("node").alias("module_name"), "component", "size", "level"
    )


def dependency_closure(modules: DataFrame) -> DataFrame:
    """(repo, module_name, depends_on, steps): what a module needs directly or through others.

    ``steps`` is the length of the shortest way; a module on a circle needs itself.  Ways
    double in each round, so a chain of n modules takes about log2(n) rounds.  The result
    has a row for every such pair, which is what is asked for.
    """
    ways = materialize(internal_edges(modules).withColumn("steps", F.lit(1)), "ways")
    count = ways.count()
    while True:
        longer = ways.alias("a").join(
            ways.alias("b"), (F.col("a.repo") == F.col("b.repo")) & (F.col("a.dst") == F.col("b.src"))
        ).select("a.repo", "a.src", "b.dst", (F.col("a.steps") + F.col("b.steps")).alias("steps"))
        ways = materialize(
            ways.unionByName(longer).groupBy("repo", "src", "dst").agg(F.min("steps").alias("steps")), "ways"
        )
        before, count = count, ways.count()
        if count == before:
            return ways.select("repo", F.col("src").alias("module_name"), F.col("dst").alias("depends_on"), "steps")
