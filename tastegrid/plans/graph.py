"""Plans over named tables: steps that read tables or other steps' results, in the order that this asks for, resumable.

A step's result is written below the plan's folder under a fingerprint of what it ran: its transform, its options, and
the fingerprints of what it read. A plan that is run again reads what is there and runs the rest, so one that was
stopped goes on where it was, and a changed option runs its step and those after it anew, no others.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources.packs import Store
from .steps import BadPlan

#: A transform of tables by name, with options.
Command = Callable[..., DataFrame]


@dataclass
class Node:
    """A step: the command, which of its arguments is which table or step, and its options."""

    id: str
    run: str
    reads: dict[str, str]
    options: dict = field(default_factory=dict)


def ordered(config: list[dict], commands: dict[str, Command], tables: set[str]) -> list[Node]:
    """The steps so that each comes after those it reads; every mistake is told at once."""
    errors: list[str] = []
    nodes: dict[str, Node] = {}
    reads: list[tuple[str, str]] = []
    for i, raw in enumerate(config):
        node = Node(raw.get("id", f"step{i + 1}"), raw.get("run", ""), dict(raw.get("reads", {})), dict(raw.get("with", {})))
        if node.id in nodes or node.id in tables:
            errors.append(f"{node.id}: the name stands twice")
        if node.run not in commands:
            errors.append(f"{node.id}: no command {node.run or 'named'}")
        if unknown := set(raw) - {"id", "run", "reads", "with"}:
            errors.append(f"{node.id}: unknown keys {sorted(unknown)}")
        nodes[node.id] = node
        reads += [(node.id, r) for r in node.reads.values()]
    errors += [f"{name}: no table or step {r}" for name, r in reads if r not in nodes and r not in tables]
    done: list[Node] = []
    left = dict(nodes)
    while left and not errors:
        ready = [n for n in left.values() if not any(r in left for r in n.reads.values())]
        if not ready:
            errors.append(f"steps that wait for each other: {', '.join(left)}")
        for n in ready:
            done.append(left.pop(n.id))
    if errors:
        raise BadPlan("; ".join(errors))
    return done


@dataclass
class Run:
    """Results by step, and what each did: ran, or was there already."""

    results: dict[str, DataFrame]
    told: dict[str, str]


def run(spark: SparkSession, config: list[dict], commands: dict[str, Command], tables: dict[str, DataFrame], folder: str, versions: dict[str, str] | None = None) -> Run:
    """Runs a plan. versions: what state a table is in, where the caller knows; a table without one counts as unchanged
    as long as its plan is. A step that fails raises; what ran before it stays for the next run."""
    store = Store(spark, folder)
    prints = {name: hashlib.sha256(f"{name}:{(versions or {}).get(name, '')}:{df.schema.json()}".encode()).hexdigest() for name, df in tables.items()}
    known, told = dict(tables), {}
    results: dict[str, DataFrame] = {}
    for node in ordered(config, commands, set(tables)):
        text = json.dumps([node.run, node.options, {k: prints[v] for k, v in sorted(node.reads.items())}], sort_keys=True, default=str)
        prints[node.id] = hashlib.sha256(text.encode()).hexdigest()
        name = f"{node.id}-{prints[node.id][:16]}"
        told[node.id] = "there" if "_SUCCESS" in store.names(name) else "ran"
        if told[node.id] == "ran":
            out = commands[node.run](**{k: known[v] for k, v in node.reads.items()}, **node.options)
            out.write.mode("overwrite").parquet(f"{folder}/{name}")
        known[node.id] = results[node.id] = spark.read.parquet(f"{folder}/{name}")
    return Run(results, told)
