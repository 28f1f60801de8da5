"""PIP1 to PIP3: stages with prerequisites. Each stage is a function from tables to tables; its result is written once and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Stage = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]
#: Stages in order, with what each needs.
NEEDS = {
    "identity": (), "contracts": ("identity",), "reconciliation": ("identity",), "revenue": ("contracts", "reconciliation"),
    "anomaly": ("revenue",), "review": ("revenue", "anomaly"), "publish": ("review",),
}


class StageError(RuntimeError):
    pass


def chosen(keys: list[str] | None) -> list[str]:
    """The stages to run, in their own order whatever order they are named in."""
    unknown = set(keys or ()) - NEEDS.keys()
    if unknown:
        raise StageError(f"unknown stages: {sorted(unknown)}")
    return [k for k in NEEDS if not keys or k in keys]


def affected(changed: set[str]) -> list[str]:
    """PIP3: the stages that a change of some stages calls for again."""
    out = set(changed)
    for key, needs in NEEDS.items():
        if out & set(needs):
            out.add(key)
    return [k for k in NEEDS if k in out]


def run(tables: dict[str, DataFrame], stages: dict[str, Stage], folder: str, keys: list[str] | None = None, done: set[str] | None = None) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """Run stages until the first that fails. `done` are stages whose marks exist (PIP2). Returns all tables and what became of each stage."""
    if not tables or all(t.isEmpty() for t in tables.values()):
        raise StageError("the workspace is empty")
    tables, finished, log = dict(tables), set(done or ()), []
    for key in chosen(keys):
        lacking = [n for n in NEEDS[key] if n not in finished]
        if lacking:
            log.append((key, f"needs {', '.join(lacking)}"))
            break
        try:
            for name, table in stages[key](tables).items():
                path = f"{folder}/{key}/{name}"
                table.write.mode("overwrite").parquet(path)
                tables[name] = table.sparkSession.read.parquet(path)
        except Exception as error:  # noqa: BLE001  the run's log carries it
            log.append((key, f"failed: {str(error)[:300]}"))
            break
        finished.add(key)
        log.append((key, "done"))
    return tables, log
