"""Small stages over a dictionary of tables, run in order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

Tables = dict[str, object]
Stage = Callable[[Tables], Tables]


def needs(*names: str) -> Callable[[Stage], Stage]:
    """Check before a stage runs that its inputs exist."""

    def wrap(stage: Stage) -> Stage:
        def run(tables: Tables) -> Tables:
            missing = [n for n in names if n not in tables]
            if missing:
                raise ValueError(f"{getattr(stage, '__name__', 'stage')} needs {', '.join(missing)}")
            return stage(tables)

        run.__name__ = getattr(stage, "__name__", "stage")
        return run

    return wrap


def run_stages(stages: Iterable[Stage], tables: Mapping[str, object] | None = None) -> Tables:
    """Feed the tables through the stages; a stage returns the tables it adds or replaces."""
    state: Tables = dict(tables or {})
    for stage in stages:
        state.update(stage(state) or {})
    return state
