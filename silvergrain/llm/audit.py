"""What each filter of a chain removes, in whatever order the filters are applied.

Every document has a failure flag per filter. Documents are counted by their flags and part,
which leaves a few rows, and SQL's CUBE over the flags and the part rolls those counts up: in
the grouping set of some flags, the row whose flags are all false counts the documents that
survive those filters. One step of one order takes the survivors of the filters before it to
the survivors of these and its own, so a join of such pairs of subsets gives what it keeps and
removes; a filter's removals before any other filter and after all others tell what it removes
redundantly and what it alone removes. No document is judged twice, however many orders there are.

Edge cases: null and empty texts are equal, have no words and no code points; a null part is the
part ''; a condition that is null does not fail; rows without an id repeat nothing, are repeated by
nothing and have no labels; rows that repeat an id count each, and are copies only of a smaller id's
text; of several labels of a document the greatest counts, labels without a document or an id count
nothing; an empty table has no parts and gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import written

#: More filters than these have too many orders to list.
MOST_FILTERS = 7
WHITE = r"[\x20\x09-\x0D]+"


def text_conditions(text: str = "__sg_text", words: str = "__sg_words") -> dict[str, Column]:
    """The failure conditions that a text alone decides; ``words`` is the column of its words."""
    t, w = F.col(text), F.col(words)
    return {
        "A": F.size(w) < 100,
        "B": 100 * F.size(F.array_distinct(w)) < 80 * F.size(w),
        "C": 100 * (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))) > 10 * F.length(t),
        "D": t.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", repeated: str = "E") -> DataFrame:
    """(key, part, a flag per condition): a row per document, a written table of flags.

    A text is repeated if a smaller key has the same. The keys of first copies are joined by text
    and key together, so that a text of very many copies is spread over tasks.
    """
    t = docs.select(F.col(key).alias("key"), F.coalesce(part, F.lit("")).alias("part"), F.coalesce(text, F.lit("")).alias("__sg_text"))
    t = t.withColumn("__sg_words", F.array_remove(F.split("__sg_text", WHITE), ""))
    alone = text_conditions()
    rows = written(t.select("key", "part", F.unhex(F.sha2("__sg_text", 256)).alias("digest"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in alone.items()]), "flags")
    known = rows.where("key IS NOT NULL")
    firsts = known.groupBy("digest").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    of_known = known.join(firsts, ["digest", "key"], "left").withColumn(repeated, F.col("first").isNull()).select("key", "part", *alone, repeated)
    return of_known.union(rows.where("key IS NULL").select("key", "part", *alone, F.lit(False)))


def labelled(flags: DataFrame, labels: DataFrame, marks: Mapping[str, Column], key: str = "doc_id") -> DataFrame:
    """``flags`` with a boolean per mark: whether a label of the document says so."""
    said = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in marks.items()])
    rows = flags.where("key IS NOT NULL").join(said, "key", "left").unionByName(flags.where("key IS NULL"), allowMissingColumns=True)
    return rows.withColumns({n: F.coalesce(n, F.lit(False)) for n in marks})


def subset_survivors(flags: DataFrame, filters: Sequence[str], marks: Sequence[str] = (), part: str = "part") -> DataFrame:
    """(part, subset, n, a count per mark): survivors of every subset of the filters, zeros included.

    ``subset`` has bit i set if filter i is in it.
    """
    few = flags.groupBy(part, *filters).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(m).alias(m) for m in marks])
    counts = ["n", *marks]
    cube = few.cube(*filters, part).agg(*[F.sum(c).alias(c) for c in counts], F.grouping(part).alias("__sg_all"), sum(((1 - F.grouping(f).cast("int")) * 2**i for i, f in enumerate(filters)), F.lit(0)).alias("subset"))
    passed = F.lit(True)
    for f in filters:
        passed = passed & ~F.coalesce(f, F.lit(False))
    found = written(cube.where((F.col("__sg_all") == 0) & passed).select(part, "subset", *counts), "survivors")
    grid = found.where("subset = 0").select(part, F.explode(F.sequence(F.lit(0), F.lit(2 ** len(filters) - 1))).alias("subset"))
    return grid.join(found, [part, "subset"], "left").select(part, "subset", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])


def filter_steps(survivors: DataFrame, filters: Sequence[str], marks: Sequence[str] = (), part: str = "part") -> DataFrame:
    """A row per part, order of the filters and step: what the step's filter keeps and removes there.

    (part, filter_order, step, kept, removed, redundant, unique_fails, a ``<mark>_lost`` per mark, shapley).
    """
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"{len(filters)} filters have too many orders")
    n, every = len(filters), 2 ** len(filters) - 1
    survivors = written(survivors, "subsets")
    own = F.explode(F.array(*[F.lit(2**i) for i in range(n)])).alias("filter")  # by its bit
    before = survivors.select("*", own).where(F.col("subset").bitwiseAND(F.col("filter")) == 0).withColumn("after", F.col("subset") + F.col("filter"))
    after = survivors.select(part, F.col("subset").alias("after"), *[F.col(c).alias(f"{c}_left") for c in ("n", *marks)])
    pairs = before.join(after, [part, "after"]).select(part, "filter", F.col("subset").alias("before"), F.col("n_left").alias("kept"), (F.col("n") - F.col("n_left")).alias("removed"), *[(F.col(m) - F.col(f"{m}_left")).alias(f"{m}_lost") for m in marks])
    # so many orders have just these filters before this one
    orders = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("before") + 1)
    of_filter = Window.partitionBy(part, "filter")  # one row per subset of the other filters
    pairs = pairs.withColumns({
        "redundant": F.max(F.when(F.col("before") == 0, F.col("removed"))).over(of_filter) - F.col("removed"),
        "unique_fails": F.max(F.when(F.col("before") + F.col("filter") == every, F.col("removed"))).over(of_filter),
        "shapley": F.sum(F.col("removed") * orders).over(of_filter),
    })
    steps = []
    for order in permutations(range(n)):
        name, seen = "".join(filters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            steps.append((name, step, 1 << i, seen))
            seen |= 1 << i
    listed = survivors.sparkSession.createDataFrame(steps, "filter_order string, step int, filter int, before int")
    # MOST_FILTERS bounds the list of steps
    return pairs.join(F.broadcast(listed), ["filter", "before"]).select(part, "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{m}_lost" for m in marks], "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The steps of all orders of the filters A to E over ``docs``, with good and toxic documents lost."""
    filters, marks = ["A", "B", "C", "D", "E"], {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    rows = labelled(flagged(docs), labels, marks)
    return filter_steps(subset_survivors(rows, filters, list(marks)), filters, list(marks))
