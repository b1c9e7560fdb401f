"""Commits that the head of a repository reaches, from the parents of each commit.

Commits are numbered, so that what is moved for an edge are two numbers. A graph of many edges
is then made smaller: a commit with a single child, and no head, is reached if its child is, so
it is taken into its child, which gets its parents; a commit without children that is no head
is left out with its edges. Coins of commits and rounds choose so that no commit is taken into
one that goes itself. Of a chain a quarter goes with every round, so all rounds together move a
few times the edges, however long the chains are. Branches that were merged become single edges.

In what is left, the first parents form chains. Pointers to the 1st, 2nd, 4th, ... commit along
a chain are made by joining them with themselves, so a chain of ``n`` commits takes about
``log2(n)`` rounds. A marked commit marks what its pointers of every length lead to, which in
as many rounds again is all of its chain. Other parents of what was marked, as of merges, then
begin the next pass, so there are as many passes as merged branches are nested.

Every round joins tables that stay distributed by commit, and its result is written before the
next one reads it. Nothing is gathered by repository, so one may hold most of the commits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import staged

HEAD = r"(?:\A|, )HEAD(?: ->|,|\z)"
_KEY = ("repository", "sha")
# No chain has as many commits as two to this power.
LONGEST = 40
# A graph of more edges is made smaller first, as long as a round takes a tenth of them.
SMALL = 100_000


def is_head(refs: Column) -> Column:
    """Whether the references of a commit name the head."""
    return F.coalesce(F.rlike(refs, F.lit(HEAD)), F.lit(False))


def numbered(commits: DataFrame) -> DataFrame:
    """Table ``repository, sha, parents, id``, one row a key; the ids of heads are odd.

    ``parents`` are structs of the parent and whether it is the first.
    """
    parents = F.transform(
        "parents",
        lambda parent, place: F.struct(parent.alias("sha"), (place == 0).alias("first")),
    )
    keys = (
        commits.select(*_KEY, parents.alias("parents"), is_head(F.col("refs")).alias("head"))
        .groupBy(*_KEY)
        .agg(
            F.array_distinct(F.flatten(F.collect_list("parents"))).alias("parents"),
            F.max("head").cast("long").alias("head"),
        )
    )
    number = F.monotonically_increasing_id() * 2 + F.col("head")
    return staged(keys.select(*_KEY, "parents", number.alias("id")), "commits")


def edges_of(nodes: DataFrame) -> DataFrame:
    """Table ``at, to, first`` of the ids of commits and of their parents."""
    stated = nodes.select("repository", F.col("id").alias("at"), F.explode("parents").alias("edge"))
    found = stated.select("repository", "at", "edge.*").join(
        nodes.select(*_KEY, F.col("id").alias("to")), list(_KEY)
    )
    return staged(found.select("at", "to", "first"), "edges")


def _smaller(edges: DataFrame, number: int) -> DataFrame:
    """Edges after a round, and those along which a commit was taken into its child (``gone``)."""

    def coin(commit: str) -> Column:
        return F.xxhash64(commit, F.lit(number)).bitwiseAND(1) == 1

    into = Window.partitionBy("to")
    alone = F.min("at").over(into) == F.max("at").over(into)
    gone = alone & (F.col("to") % 2 == 0) & coin("to") & ~coin("at")
    told = edges.withColumn("gone", gone)
    # Every commit with a child, and where it went.
    child = told.groupBy(F.col("to").alias("at")).agg(
        F.max("gone").alias("moved"), F.max("at").alias("into"), F.max("first").alias("along"),
    )
    moved = F.coalesce("moved", F.lit(False))
    return (
        told.join(child, "at", "left")
        .where(F.col("moved").isNotNull() | (F.col("at") % 2 == 1))
        .select(
            F.when(moved, F.col("into")).otherwise(F.col("at")).alias("at"), "to",
            # The first parent of a commit taken in is that of its child only if it was its own.
            (F.col("first") & (~moved | F.col("along"))).alias("first"), "gone",
        )
        # A chain of first parents that leads back is kept, for ``pointers`` to find.
        .where((F.col("at") != F.col("to")) | F.col("first"))
    )


def contracted(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """A smaller graph, and by round the pairs ``at, to`` of commits and what they took in."""
    taken = []
    count = edges.count()
    while count > SMALL:
        told = staged(_smaller(edges, len(taken)), "smaller")
        edges = told.where(~F.col("gone")).drop("gone")
        taken.append(told.where("gone").select("at", "to"))
        before, count = count, edges.count()
        if count > 0.9 * before:
            break
    return edges, taken


def pointers(edges: DataFrame) -> list[DataFrame]:
    """Tables ``at, to``: the commit 1, 2, 4, ... steps along first parents."""
    found = []
    step = edges.where("first").select("at", "to").distinct()
    while True:
        step = staged(step, "pointers")
        if step.isEmpty():
            return found
        if len(found) == LONGEST:
            raise ValueError("the parents of some commits lead back to them")
        found.append(step)
        onward = step.select(F.col("at").alias("to"), F.col("to").alias("further"))
        step = step.join(onward, "to").select("at", F.col("further").alias("to"))


def _marked(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """Ids ``at`` of the commits that the heads reach, heads included."""
    steps = pointers(edges)
    others = edges.where(~F.col("first")).select("at", "to")
    done = fresh = staged(heads, "reached")
    while True:
        marked = fresh
        for number, step in enumerate(steps):
            marked = marked.unionByName(_led_to(marked, step)).distinct()
            # A few rounds are cheap to repeat; more would be done again for every reader.
            if number % 3 == 2:
                marked = staged(marked, "marked")
        marked = staged(marked.join(done, "at", "left_anti").unionByName(fresh), "fresh")
        done = staged(done.unionByName(marked).distinct(), "reached")
        fresh = staged(
            _led_to(marked, others).distinct().join(done, "at", "left_anti"), "merged"
        )
        if fresh.isEmpty():
            return done
        done = done.unionByName(fresh)


def _led_to(marked: DataFrame, step: DataFrame) -> DataFrame:
    return step.join(marked, "at", "left_semi").select(F.col("to").alias("at"))


def reached(commits: DataFrame) -> DataFrame:
    """Keys ``repository, sha`` of the commits that a head reaches, heads included.

    ``commits`` holds ``repository, sha, parents, refs``, parents being an array in order. A
    parent that is no commit of the table, as in a shallow copy, ends its chain. Of commits
    that repeat a key, the parents of all count.
    """
    nodes = numbered(commits)
    edges, taken = contracted(edges_of(nodes))
    done = _marked(edges, nodes.where("id % 2 = 1").select(F.col("id").alias("at")))
    # What a commit took in is reached with it, the last rounds first.
    for number, pairs in enumerate(reversed(taken)):
        held = pairs.groupBy("at").agg(F.collect_set("to").alias("held"))
        both = F.concat(F.array("at"), F.coalesce("held", F.array().cast("array<bigint>")))
        done = done.join(held, "at", "left").select(F.explode(both).alias("at"))
        if number % 4 == 3:
            done = staged(done, "reached")
    return nodes.join(done, nodes["id"] == done["at"], "left_semi").select(*_KEY)


def with_head(commits: DataFrame) -> DataFrame:
    """Adds ``on_head`` and ``is_head`` to commits with their ``parents`` and ``refs``."""
    marks = reached(commits).withColumn("on_head", F.lit(True))
    return commits.join(marks, list(_KEY), "left").withColumns({
        "on_head": F.coalesce("on_head", F.lit(False)), "is_head": is_head(F.col("refs")),
    })
