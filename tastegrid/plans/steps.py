"""A validated list of named transforms over one DataFrame: defaults merged, all mistakes told at once."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Transform = Callable[..., DataFrame]
#: ${name}, ${env:NAME}, and $${...}, which stands for the text ${...}.
VARIABLE = re.compile(r"\$?\$\{(env:)?(\w+)\}")


class BadPlan(ValueError):
    """A plan that cannot run, with every reason."""


@dataclass
class Step:
    id: str
    run: str
    options: dict = field(default_factory=dict)
    enabled: bool = True
    continue_on_error: bool = False


def resolved(config: dict, transforms: dict[str, Transform], overrides: dict | None = None, environment: dict[str, str] | None = None) -> list[Step]:
    """The steps of a config (version 2: vars, defaults, steps) with defaults merged and variables put in. A variable
    may name those before it; overrides win over the config's; ${env:NAME} reads the environment that is given."""
    errors, steps, names = [], [], set()
    if config.get("version") != 2:
        errors.append("version must be 2")
    variables: dict[str, object] = {}

    def filled(value, where: str):
        if not isinstance(value, str):
            return value

        def put(m: re.Match) -> str:
            if m[0].startswith("$$"):
                return m[0][1:]
            source, kind = ((environment or {}), "environment variable") if m[1] else (variables, "variable")
            if m[2] not in source:
                errors.append(f"{where}: unknown {kind} {m[2]}")
            return str(source.get(m[2], ""))

        return VARIABLE.sub(put, value)

    for name, value in config.get("vars", {}).items():
        variables[name] = (overrides or {}).get(name, filled(value, f"vars.{name}"))
    for name in (overrides or {}).keys() - variables.keys():
        errors.append(f"overrides: unknown variable {name}")

    for i, raw in enumerate(config.get("steps", [])):
        name, run = raw.get("id", f"step{i + 1}"), raw.get("run")
        if name in names:
            errors.append(f"{name}: the id stands twice")
        names.add(name)
        if run not in transforms:
            errors.append(f"{name}: no transform {run}")
        options = config.get("defaults", {}).get(run, {}) | raw.get("with", {})
        steps.append(Step(name, run, {k: filled(v, name) for k, v in options.items()}, raw.get("enabled", True), raw.get("continue_on_error", False)))
    if errors:
        raise BadPlan("; ".join(errors))
    return steps


def run(df: DataFrame, steps: list[Step], transforms: dict[str, Transform]) -> tuple[DataFrame, dict[str, str]]:
    """(result, step -> ok, skipped or its error). A step that fails stops the plan unless it may be passed over."""
    told: dict[str, str] = {}
    for step in steps:
        if not step.enabled:
            told[step.id] = "skipped"
            continue
        try:
            df = transforms[step.run](df, **step.options)
            told[step.id] = "ok"
        except Exception as error:
            told[step.id] = f"{type(error).__name__}: {error}"
            if not step.continue_on_error:
                raise
    return df, told
