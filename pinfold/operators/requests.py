"""What requests and runs leave behind: labels, client addresses, allowed hosts, outcomes of agent runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pinfold.functions.parts import any_of

_NAME = "^[a-z0-9_/]{1,40}$"


def labels(body: Column) -> tuple[Column, Column]:
    """(method, tool) of a JSON-RPC body; 'invalid' if it is none, 'other' for names outside the bounded form."""
    method = F.get_json_object(body, "$.method")
    name = F.get_json_object(body, "$.params.name")
    kind = F.when(F.coalesce(method, F.lit("")) == "", "invalid").when(method.rlike(_NAME), method).otherwise("other")
    return kind, F.when((method == "tools/call") & name.rlike(_NAME), name).otherwise("")


def client_address(peer: Column, forwarded: Column, trusted: list[str]) -> Column:
    """The peer, or behind trusted proxies (address prefixes) the right-most hop that isn't one; a hop that is no address
    ends the search."""
    is_trusted = lambda x: any_of([x.startswith(p) for p in trusted])
    hops = F.reverse(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda x: F.trim(x)))
    valid = lambda x: x.rlike(r"^\d{1,3}(\.\d{1,3}){3}$|^[0-9a-fA-F:]*:[0-9a-fA-F:.]*$")
    start = F.struct(F.lit(False).alias("done"), peer.alias("at"))
    step = lambda a, x: F.when(a["done"], a).when(~valid(x), F.struct(F.lit(True).alias("done"), a["at"].alias("at"))).when(is_trusted(x), a).otherwise(F.struct(F.lit(True).alias("done"), x.alias("at")))
    return F.when(is_trusted(peer), F.aggregate(hops, start, step, lambda a: a["at"])).otherwise(peer)


def allowed(host: Column, hosts: list[str]) -> Column:
    """A host by name, or below a name written as *.name; letter case and a final dot don't count."""
    h = F.regexp_replace(F.lower(host), r"\.$", "")
    return any_of([F.endswith(h, F.lit(x[1:].lower())) & (F.length(h) > len(x) - 1) if x.startswith("*.") else h == x.lower() for x in hosts])


EVENT = "type string, subtype string, model string, num_turns int, total_cost_usd double, is_error boolean, message struct<content: array<struct<type: string, name: string>>>, usage struct<input_tokens: bigint, cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint, output_tokens: bigint>"


def outcomes(lines: DataFrame, run: str, number: str, line: str, own_prefix: str) -> DataFrame:
    """One row a run of its JSON event lines: model, tool calls by name, own calls, turns, cost, tokens of the last result.

    Lines that are no JSON count for nothing.
    """
    e = lines.select(F.col(run).alias("run"), F.col(number).alias("n"), F.from_json(line, EVENT).alias("e"))
    last = lambda c: F.max_by(c, F.when(F.col("e.type") == "result", F.col("n")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = zero("e.usage.input_tokens") + zero("e.usage.cache_read_input_tokens") + zero("e.usage.cache_creation_input_tokens")
    runs = e.groupBy("run").agg(
        F.max_by("e.model", F.when((F.col("e.type") == "system") & (F.col("e.subtype") == "init"), F.col("n"))).alias("model"),
        last(F.col("e.num_turns")).alias("turns"), last(F.col("e.total_cost_usd")).alias("cost"), last(F.col("e.is_error")).alias("is_error"), last(total).alias("input_tokens"), last(F.col("e.usage.output_tokens")).alias("output_tokens"),
    )
    calls = e.filter("e.type = 'assistant'").select("run", F.explode("e.message.content").alias("c")).filter("c.type = 'tool_use'").groupBy("run", F.col("c.name").alias("tool")).agg(F.count("*").alias("k"))
    tools = calls.groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "k")))).alias("tool_calls"), F.sum(F.when(F.col("tool").startswith(own_prefix), F.col("k")).otherwise(0)).alias("own_calls"))
    return runs.join(tools, "run", "left").withColumn("own_calls", F.coalesce("own_calls", F.lit(0)))


def compile_errors(output: Column, failed: Column) -> Column:
    """Diagnostics of a compiler's output, at least one of a failed run."""
    n = F.regexp_count(output, F.lit(r"(?m)^\S.*\.java:\d+: error: "))
    return F.when(failed, F.greatest(n, F.lit(1))).otherwise(n)
