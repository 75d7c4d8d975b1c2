"""Exact symbol facts: lookup forms, case policy, version diff, rules, version hops, hierarchy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pinfold.functions import names as N
from pinfold.scratch import materialize


def case_policy(found: DataFrame, query: list[str], exact: Column) -> DataFrame:
    """Rows that match in letter case win; where a query has none, all stay and are marked."""
    w = Window.partitionBy(*query)
    marked = found.withColumn("__e", exact).withColumn("__any", F.max("__e").over(w))
    return marked.filter(F.col("__e") | ~F.col("__any")).withColumn("case_mismatch", ~F.col("__e")).drop("__e", "__any")


def lookup(queries: DataFrame, symbols: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, fqn, signature, season, stage, case_mismatch, place): what each written name (query_id, name) means.

    A name with '.' or '::' and no '#' is a whole name; failing that, its member form, then its last segment. Type#member
    is an owner's simple name and a member, any other name a simple name; both in any letter case. The earliest form with
    a match counts. Rows are ordered: right case, later season, classes, name, signature; the first k stay.
    """
    name = F.col("name")
    simple = F.lower(N.simple_name(F.col("fqn")))
    index = symbols.select("fqn", "signature", "season", "kind", simple.alias("simple"), F.lower(N.owner_name(F.col("fqn"))).alias("owner"))
    qualified = name.rlike(r"\.|::") & ~name.contains("#")
    whole = queries.filter(qualified | (name.contains("#") & name.rlike(r"\.|::")))
    forms = [
        whole.select("query_id", "name", F.lit(0).alias("stage"), name.alias("fqn")).join(index, "fqn"),
        queries.filter(qualified).select("query_id", "name", F.lit(1).alias("stage"), N.member_form(name).alias("fqn")).join(index, "fqn"),
    ]
    member = queries.filter(name.contains("#")).select("query_id", "name", F.lit(2).alias("stage"), F.lower(N.owner_name(name)).alias("owner"), F.lower(N.simple_name(name)).alias("simple"))
    forms.append(member.join(index, ["owner", "simple"]))
    plain = queries.filter(~name.contains("#")).select("query_id", "name", F.lit(3).alias("stage"), F.lower(N.simple_name(name)).alias("simple"))
    forms.append(plain.join(index, "simple"))
    cols = ["query_id", "name", "stage", "fqn", "signature", "season", "kind"]
    every = reduce(DataFrame.unionByName, [f.select(*cols) for f in forms])
    first = every.withColumn("__s", F.min("stage").over(Window.partitionBy("query_id"))).filter("stage = __s").drop("__s")
    exact = (F.col("stage") < 2) | (N.simple_name(F.col("fqn")) == N.simple_name(F.col("name")))
    kept = case_policy(first, ["query_id"], exact)
    order = Window.partitionBy("query_id").orderBy("case_mismatch", F.col("season").desc_nulls_last(), F.when(F.col("kind") == "class", 0).otherwise(1), "fqn", F.col("signature").asc_nulls_first())
    return kept.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("kind", "name")


def diff(old: DataFrame, new: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(removed, added, mapped) of two sets of fqn: anti joins both ways, and where a removed type went.

    A type goes to the one added type of the same name in another package; of several, to the one whose package shares
    the most trailing segments, at least one, alone. A member follows its type if it is there. Ties map nothing. With
    columns ``by``, which must not be null, each of their values is a diff of its own.
    """
    o, n = old.select(*by, "fqn").distinct(), new.select(*by, "fqn").distinct()
    removed, added = o.join(n, [*by, "fqn"], "left_anti"), n.join(o, [*by, "fqn"], "left_anti")
    types = removed.filter(~F.col("fqn").contains("#")).select(*by, F.col("fqn").alias("from_fqn"), N.type_name(F.col("fqn")).alias("t"), N.package_of(F.col("fqn")).alias("p")).filter("t <> ''")
    cands = added.filter(~F.col("fqn").contains("#")).select(*by, F.col("fqn").alias("to_fqn"), N.type_name(F.col("fqn")).alias("t"), N.package_of(F.col("fqn")).alias("q"))
    a, b = F.reverse(F.split("p", r"\.|::")), F.reverse(F.split("q", r"\.|::"))
    same = F.zip_with(a, b, lambda x, y: x == y)
    shared = F.coalesce(F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), F.lit(False)).cast("int") - 1, F.lit(0))
    shared = F.when(shared < 0, F.size(a)).otherwise(shared)
    pairs = types.join(cands, [*by, "t"]).withColumn("shared", shared)
    w = Window.partitionBy(*by, "from_fqn")
    pairs = pairs.withColumns({"n": F.count("*").over(w), "best": F.max("shared").over(w)})
    pairs = pairs.withColumn("ties", F.sum((F.col("shared") == F.col("best")).cast("int")).over(w))
    types_to = pairs.filter("n = 1 OR (shared = best AND best >= 1 AND ties = 1)").select(*by, "from_fqn", "to_fqn")
    members = removed.filter(F.col("fqn").contains("#")).select(*by, F.col("fqn").alias("m"), F.substring_index("fqn", "#", 1).alias("from_fqn"), F.substring_index("fqn", "#", -1).alias("name"))
    follow = members.join(types_to, [*by, "from_fqn"]).select(*by, F.col("m").alias("from_fqn"), F.concat("to_fqn", F.lit("#"), "name").alias("to_fqn")).join(n.withColumnRenamed("fqn", "to_fqn"), [*by, "to_fqn"], "left_semi")
    return removed, added, types_to.unionByName(follow)


def override(symbols: DataFrame, rules: DataFrame) -> DataFrame:
    """``symbols`` with ``replacement`` and ``replacement_src`` of a rule (fqn, to_fqn) where there is one."""
    r = rules.select("fqn", F.col("to_fqn").alias("__to"))
    return symbols.join(r, "fqn", "left").withColumns({"replacement": F.coalesce("__to", "replacement"), "replacement_src": F.when(F.col("__to").isNotNull(), "curated").otherwise(F.col("replacement_src"))}).drop("__to")


def hops(names: DataFrame, table: DataFrame, seasons: list[str]) -> DataFrame:
    """Maps names (start, fqn) through the seasons: at each hop a curated rule, the same name, a replacement, or the
    owner's replacement, in that order.

    ``table`` holds (season, fqn, curated, replacement): curated and replacement null where there is none. Gives
    (start, season, fqn, via); a name that no hop resolves keeps its last form and ends with via 'unresolved'. One join
    of each kind a hop; the seasons are few.
    """
    now = names.select("start", "fqn", F.lit("start").alias("via"))
    steps = [now.withColumn("season", F.lit(seasons[0]))]
    for before, after in zip(seasons, seasons[1:]):
        left = table.filter(F.col("season") == before).groupBy("fqn").agg(F.min("curated").alias("curated"), F.min("replacement").alias("repl"))
        there = table.filter(F.col("season") == after).select(F.col("fqn").alias("same")).distinct()
        owners = left.filter(~F.col("fqn").contains("#")).select(F.col("fqn").alias("owner"), F.coalesce("curated", "repl").alias("owner_to")).filter("owner_to IS NOT NULL")
        cur = now.filter("via <> 'unresolved'").join(left, "fqn", "left").join(there, F.col("fqn") == F.col("same"), "left")
        cur = cur.withColumn("owner", F.when(F.col("fqn").contains("#"), F.substring_index("fqn", "#", 1))).join(owners, "owner", "left")
        via = F.when(F.col("curated").isNotNull(), "curated").when(F.col("same").isNotNull(), "same").when(F.col("repl").isNotNull(), "replacement").when(F.col("owner_to").isNotNull(), "owner").otherwise("unresolved")
        to = F.coalesce("curated", "same", "repl", F.concat("owner_to", F.lit("#"), F.substring_index("fqn", "#", -1)), "fqn")
        moved = cur.select("start", to.alias("fqn"), via.alias("via"))
        now = materialize(moved.unionByName(now.filter("via = 'unresolved'")), "hops")
        steps.append(now.withColumn("season", F.lit(after)))
    return reduce(DataFrame.unionByName, [s.select("start", "season", "fqn", "via") for s in steps])


def ancestors(edges: DataFrame, depth: int = 8) -> DataFrame:
    """(node, ancestor, depth): the nearest way to each ancestor over edges (child, parent), cycles and all, up to a depth.

    A node has no more ancestors than the table has nodes; each round joins only what the round before found anew.
    """
    e = edges.select("child", "parent").distinct()
    found = materialize(e.filter("child <> parent").select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")), "ancestors")
    front = found
    for d in range(2, depth + 1):
        step = front.join(e, front["ancestor"] == e["child"]).select("node", e["parent"].alias("ancestor")).filter("node <> ancestor").distinct()
        front = materialize(step.join(found, ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(d)), "front")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def unique_affix(queries: DataFrame, names: DataFrame, never: str = "-foc") -> DataFrame:
    """(query, name, how): the name equal to a query, else the only one that begins with it, else the only one that ends
    with it. Every prefix and suffix of a name is a key, so that matching is an equi-join."""
    n = names.select("name").distinct()
    length = F.length("name")
    cuts = n.select("name", F.explode(F.sequence(F.lit(1), length)).alias("i")).filter("name <> ''")
    pre = cuts.select("name", F.expr("substring(name, 1, i)").alias("query"), F.lit(2).alias("rank"))
    suf = cuts.filter(~F.col("name").endswith(never)).select("name", F.expr("right(name, i)").alias("query"), F.lit(3).alias("rank"))
    exact = n.select("name", F.col("name").alias("query"), F.lit(1).alias("rank"))
    found = queries.select("query").distinct().join(exact.unionByName(pre).unionByName(suf), "query")
    best = found.groupBy("query", "rank").agg(F.count("*").alias("n"), F.min("name").alias("name")).filter("n = 1")
    one = best.groupBy("query").agg(F.min_by(F.struct("name", "rank"), "rank").alias("b"))
    return one.select("query", F.col("b.name").alias("name"), F.element_at(F.array(F.lit("exact"), F.lit("prefix"), F.lit("suffix")), F.col("b.rank")).alias("how"))


def longest_prefix(values: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(value, library): the library of the longest prefix (prefix, library) of each value, by joining on all prefixes."""
    v = values.select("value").distinct().filter("value <> ''")
    cuts = v.select("value", F.explode(F.sequence(F.lit(1), F.length("value"))).alias("i")).select("value", F.expr("substring(value, 1, i)").alias("prefix"))
    return cuts.join(prefixes, "prefix").groupBy("value").agg(F.max_by("library", F.struct(F.length("prefix"), "library")).alias("library"))
