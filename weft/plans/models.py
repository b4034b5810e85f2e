"""Models as functions of their inputs: run order, selection, checks, lineage and contracts."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from functools import partial
from graphlib import TopologicalSorter

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .upkeep import Table, append


@dataclass(frozen=True)
class Model:
    """A named table made from others by a function of their DataFrames; ``uses`` says how (source, join, union)."""

    name: str
    inputs: tuple[str, ...]
    build: Callable[..., DataFrame]
    uses: dict[str, str] = field(default_factory=dict)


def order(models: dict[str, Model]) -> list[str]:
    """Models after their inputs, ties by name."""
    sorter = TopologicalSorter({m.name: [i for i in m.inputs if i in models] for m in models.values()})
    sorter.prepare()
    out: list[str] = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        out += ready
        sorter.done(*ready)
    return out


def above(models: dict[str, Model], names: set[str]) -> set[str]:
    """The models and all that they are made from."""
    todo, out = list(names), set()
    while todo:
        n = todo.pop()
        if n in models and n not in out:
            out.add(n)
            todo += models[n].inputs
    return out


def below(models: dict[str, Model], names: set[str]) -> set[str]:
    """The models and all that are made from them."""
    out = set(names)
    for n in order(models):
        if out & set(models[n].inputs):
            out.add(n)
    return out


def selected(models: dict[str, Model], include: list[str] = (), exclude: list[str] = ()) -> list[str]:
    """Models whose names hold an included text, with what they need, less excluded ones and what needs those."""
    match = lambda texts: {n for n in models if any(t in n for t in texts)}
    both = match(include) & match(exclude)
    if both:
        raise ValueError(f"included and excluded: {sorted(both)}")
    chosen = above(models, match(include)) if include else set(models)
    chosen -= below(models, match(exclude))
    return [n for n in order(models) if n in chosen]


def run(models: dict[str, Model], sources: dict[str, DataFrame], names: list[str] | None = None, keep: Callable[[str, DataFrame], DataFrame] | None = None, load: Callable[[str], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Build models in order; ``keep`` may write each one and give it back.

    names: only these, with what they are made from, are built. With ``load``, which reads a model that was kept before,
    these and all that is made from them are built, and what they are made from is loaded.
    """
    done = dict(sources)
    if names is not None and load is not None:
        chosen = below(models, set(names))
        done |= {i: load(i) for i in sorted({i for n in chosen for i in models[n].inputs if i in models} - chosen)}
    else:
        chosen = set(models) if names is None else above(models, set(names))
    for n in (wanted := [n for n in order(models) if n in chosen]):
        df = models[n].build(*(done[i] for i in models[n].inputs))
        done[n] = keep(n, df) if keep else df
    return {n: done[n] for n in wanted}


@dataclass
class Outcome:
    """What a side-by-side run has built, what failed with which error, and what was left out as its inputs failed."""

    done: dict[str, DataFrame]
    failed: dict[str, Exception]
    skipped: list[str]


def run_side_by_side(models: dict[str, Model], sources: dict[str, DataFrame], keep: Callable[[str, DataFrame], DataFrame], names: list[str] | None = None, at_once: int = 4) -> Outcome:
    """Build models as soon as what they are made from is there, ``at_once`` at a time; ``keep`` writes each one and gives it
    back, so that its jobs run then.

    Jobs of a model go to the scheduler pool of its name, so with ``spark.scheduler.mode=FAIR`` a long one leaves room for
    others. A model that fails stops only those made from it.
    """
    chosen = set(models) if names is None else above(models, set(names))
    graph = {n: {i for i in models[n].inputs if i in models} for n in chosen}
    sorter, out, running = TopologicalSorter(graph), Outcome(dict(sources), {}, []), {}
    session = next(iter(sources.values())).sparkSession
    sorter.prepare()

    def build(n: str) -> DataFrame:
        df = models[n].build(*(out.done[i] for i in models[n].inputs))
        df.sparkSession.sparkContext.setLocalProperty("spark.scheduler.pool", n)
        return keep(n, df)

    with ThreadPoolExecutor(at_once) as pool:
        while sorter.is_active():
            for n in sorted(sorter.get_ready()):
                if any(i in out.failed or i in out.skipped for i in graph[n]):
                    out.skipped.append(n)
                    sorter.done(n)
                else:
                    # Each task gets Spark's local properties of this thread.
                    running[pool.submit(inheritable_thread_target(session)(partial(build, n)))] = n
            if running:
                for f in wait(running, return_when=FIRST_COMPLETED).done:
                    n = running.pop(f)
                    if f.exception():
                        out.failed[n] = f.exception()
                    else:
                        out.done[n] = f.result()
                    sorter.done(n)
    out.done = {n: out.done[n] for n in order(models) if n in out.done and n in chosen}
    return out


def checks(df: DataFrame, **rules: Column) -> DataFrame:
    """(check, failed): rows that break each rule (a null breaks it); all rules in one aggregate."""
    row = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    return row.unpivot([], list(rules), "check", "failed")


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """(check, failed): how many rows repeat a key."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("failed")).select(F.lit("unique").alias("check"), "failed")


def lineage(spark: SparkSession, models: dict[str, Model]) -> DataFrame:
    """(from, to, kind, from_is): the edges between tables."""
    rows = [(i, m.name, m.uses.get(i, "source"), "model" if i in models else "source") for m in models.values() for i in m.inputs]
    return spark.createDataFrame(rows, "from string, to string, kind string, from_is string")


#: Marks an input in a plan; the walk ends there.
_INPUT = "_weft_input_"
Field = tuple[str, str]


def _sequence(x) -> list:  # noqa: ANN001
    """A Scala sequence as a list."""
    return [x.apply(i) for i in range(x.size())]


def _walked(node, used: set[Field]) -> dict[int, frozenset[Field]]:  # noqa: ANN001
    """Where the columns that a plan node gives come from, by expression id; adds the fields that expressions name to
    ``used``."""
    kind, output = node.getClass().getSimpleName(), _sequence(node.output())
    if kind == "SubqueryAlias" and node.alias().startswith(_INPUT):
        return {a.exprId().id(): frozenset({(node.alias()[len(_INPUT) :], a.name())}) for a in output}
    children = _sequence(node.children())
    below = [_walked(c, used) for c in children]
    known = {k: v for b in below for k, v in b.items()}
    of = lambda references: frozenset().union(*(known.get(r.exprId().id(), frozenset()) for r in _sequence(references.toSeq())))
    if kind == "Union":
        rows = [_sequence(c.output()) for c in children]
        return {a.exprId().id(): frozenset().union(*(b.get(r[k].exprId().id(), frozenset()) for b, r in zip(below, rows, strict=True))) for k, a in enumerate(output)}
    everything = frozenset()
    for e in _sequence(node.expressions()):
        own = of(e.references())
        used |= own
        everything |= own
        if e.getClass().getSimpleName() == "Alias":
            known[e.exprId().id()] = own
    # A generator or a function of rows may make a column from any that it reads; without a list, from all that it gets.
    rest = everything or frozenset().union(*known.values())
    return {a.exprId().id(): known.get(a.exprId().id(), rest) for a in output}


def traced(model: Model, inputs: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, frozenset[Field]], set[Field]]:
    """The model built, where each of its columns comes from, and all input fields that it names, in filters and join
    criteria too: all read from the analysed plan, by expression id, so renaming and aliases do not hide anything."""
    df = model.build(*(inputs[i].alias(f"{_INPUT}{i}") for i in model.inputs))
    used: set[Field] = set()
    plan = df._jdf.queryExecution().analyzed()
    by_id = _walked(plan, used)
    fields = {a.name(): by_id[a.exprId().id()] for a in _sequence(plan.output())}
    return df, fields, used


def column_lineage(spark: SparkSession, models: dict[str, Model], sources: dict[str, DataFrame]) -> DataFrame:
    """(from_table, from_column, to_table, to_column): which input columns each model's columns are computed from."""
    done, rows = dict(sources), []
    for n in order(models):
        done[n], fields, _ = traced(models[n], done)
        rows += [(t, c, n, name) for name, origins in fields.items() for t, c in sorted(origins)]
    return spark.createDataFrame(rows, "from_table string, from_column string, to_table string, to_column string")


def needed_columns(models: dict[str, Model], sources: dict[str, DataFrame], table: str) -> dict[str, list[str]]:
    """The columns of ``table`` that each model made from it names or passes on."""
    done, out = dict(sources), {}
    for n in order(models):
        done[n], fields, used = traced(models[n], done)
        own = sorted({c for origin in (used, *fields.values()) for t, c in origin if t == table})
        if own:
            out[n] = own
    return out


def broken_columns(before: DataFrame, after: DataFrame, needed: dict[str, list[str]]) -> DataFrame:
    """(model, column, why): columns that later models need (see :func:`needed_columns`) and a changed step no longer gives,
    or gives in another type."""
    old, new = dict(before.dtypes), dict(after.dtypes)
    rows = [(m, c, "missing" if c not in new else "type") for m, cs in needed.items() for c in cs if c not in new or (c in old and old[c] != new[c])]
    return before.sparkSession.createDataFrame(rows, "model string, column string, why string")


def compiled(spark: SparkSession, built: dict[str, DataFrame], table: Table) -> DataFrame:
    """(model, plan, at): the logical plan of each model as text, after analysis, added to a table; returns the new rows."""
    rows = [(n, df._jdf.queryExecution().analyzed().toString()) for n, df in built.items()]
    new = spark.createDataFrame(rows, "model string, plan string").withColumn("at", F.current_timestamp())
    append(table, new)
    last = table.read()
    return last.join(last.groupBy("model").agg(F.max("at").alias("at")), ["model", "at"]).select("model", "plan", "at")
