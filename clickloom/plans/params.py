"""Task parameters and settings."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class TaskParam:
    """Parameters of a task.  None: not given, so the filter isn't applied."""

    start_date: str | None = None
    end_date: str | None = None
    start_age: int | None = None
    end_age: int | None = None
    professionals: tuple[str, ...] | None = None
    cities: tuple[str, ...] | None = None
    sex: str | None = None
    keywords: tuple[str, ...] | None = None
    category_ids: tuple[int, ...] | None = None
    target_page_flow: tuple[int, ...] | None = None

    @classmethod
    def from_json(cls, text: str) -> TaskParam:
        """From a JSON object whose values are arrays, the first element counting; lists are
        comma-separated in it.  Blank values count as not given, unknown keys are ignored."""
        raw = json.loads(text)

        def one(key):
            v = raw.get(key)
            v = v[0] if isinstance(v, list) and v else None if isinstance(v, list) else v
            return None if v is None or str(v) in ("", "null", "NULL") else str(v)

        def many(key, kind=str):
            return None if one(key) is None else tuple(kind(x) for x in one(key).split(",") if x)

        whole = lambda key: None if one(key) is None else int(one(key))
        return cls(
            one("startDate"), one("endDate"), whole("startAge"), whole("endAge"), many("professionals"), many("cities"), one("sex"),
            many("keywords"), many("categoryIds", int), many("targetPageFlow", int),
        )


@dataclass(frozen=True)
class Settings:
    """Typed settings of the jobs; a value that can't be read is an error."""

    task_id: int = 1
    extract_count: int = 100
    blacklist_threshold: int = 100
    trend_minutes: int = 60
    batch_seconds: int = 5
    jdbc_url: str | None = None
    extra: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_properties(cls, text: str) -> Settings:
        """From lines ``key=value``; ``#`` starts a comment."""
        pairs = dict((x.strip() for x in line.split("=", 1)) for line in text.splitlines() if "=" in line and not line.lstrip().startswith("#"))
        known = {k: v.type for k, v in cls.__dataclass_fields__.items() if k != "extra"}
        own = {k: int(v) if known[k] == "int" else v for k, v in pairs.items() if k in known}
        return cls(**own, extra={k: v for k, v in pairs.items() if k not in known})

    def extra_for(self, prefix: str) -> dict[str, str]:
        """Further settings ``prefix.key=value`` by key."""
        return {k[len(prefix) + 1 :]: v for k, v in self.extra.items() if k.startswith(f"{prefix}.")}


def task(tasks, task_id: int) -> TaskParam | None:
    """The parameters of a row of the ``task`` table (task_id, task_param), by point lookup."""
    row = tasks.where(tasks.task_id == task_id).select("task_param").first()
    return None if row is None else TaskParam.from_json(row.task_param)
