"""Results, callbacks, traces and hooks of runs; all can be turned into tables."""

from __future__ import annotations

import json
import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession


class NodeStatus(Enum):
    PENDING = "pending"
    RUNNING = "running"
    COMPLETED = "completed"
    FAILED = "failed"
    SKIPPED = "skipped"
    TIMED_OUT = "timed_out"
    CANCELLED = "cancelled"
    CACHE_HIT = "cache_hit"


GOOD = {NodeStatus.COMPLETED, NodeStatus.CACHE_HIT}
BAD = {NodeStatus.FAILED, NodeStatus.TIMED_OUT}


@dataclass
class NodeResult:
    name: str
    status: NodeStatus
    result: object = None
    error: BaseException | None = None
    duration_seconds: float = 0.0


@dataclass
class ExecutionResult:
    node_results: dict[str, NodeResult] = field(default_factory=dict)
    duration: float = 0.0
    trace: ExecutionTrace | None = None
    extra: dict = field(default_factory=dict)

    def _count(self, *status: NodeStatus) -> int:
        return sum(r.status in status for r in self.node_results.values())

    @property
    def succeeded(self) -> int:
        return self._count(*GOOD)

    @property
    def failed(self) -> int:
        return self._count(NodeStatus.FAILED)

    @property
    def skipped(self) -> int:
        return self._count(NodeStatus.SKIPPED)

    @property
    def timed_out(self) -> int:
        return self._count(NodeStatus.TIMED_OUT)

    @property
    def cancelled(self) -> int:
        return self._count(NodeStatus.CANCELLED)

    def __getitem__(self, name: str) -> object:
        return self.node_results[name].result

    def to_frame(self, spark: SparkSession, run_id: str = "run") -> DataFrame:
        """The run as rows of node_results."""
        rows = [(run_id, r.name, r.status.value, None if r.error is None else repr(r.error), float(r.duration_seconds)) for r in self.node_results.values()]
        return spark.createDataFrame(rows, "run_id string, name string, status string, error string, duration_seconds double")


@dataclass
class ExecutionCallbacks:
    """Optional functions; an error in one is a warning."""

    on_start: Callable | None = None
    on_complete: Callable | None = None
    on_failure: Callable | None = None
    on_skip: Callable | None = None
    on_timeout: Callable | None = None
    on_cancel: Callable | None = None
    on_cache_hit: Callable | None = None
    on_step_start: Callable | None = None
    on_step_complete: Callable | None = None
    on_gate_waiting: Callable | None = None
    on_gate_resolved: Callable | None = None
    on_dynamic_expand: Callable | None = None
    on_resource_acquired: Callable | None = None
    on_resource_released: Callable | None = None

    def fire(self, what: str, *args) -> None:
        fn = getattr(self, f"on_{what}", None)
        if fn:
            try:
                fn(*args)
            except Exception as e:  # noqa: BLE001
                warnings.warn(f"callback {what}: {e!r}", RuntimeWarning, stacklevel=2)


@dataclass
class TraceEvent:
    event_type: str
    timestamp: float
    node_name: str | None = None
    step_index: int | None = None
    duration: float | None = None
    error: str | None = None
    metadata: dict = field(default_factory=dict)


class ExecutionTrace:
    """Events of a run; times are seconds since the first."""

    def __init__(self):
        self.events: list[TraceEvent] = []
        self._zero: float | None = None

    def record(self, event_type: str, node: str | None = None, **more) -> None:
        now = time.monotonic()
        self._zero = now if self._zero is None else self._zero
        self.events.append(TraceEvent(event_type, now - self._zero, node, **more))

    def for_node(self, name: str) -> list[TraceEvent]:
        return [e for e in self.events if e.node_name == name]

    def summary(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for e in self.events:
            out[e.event_type] = out.get(e.event_type, 0) + 1
        return out

    def to_json(self) -> str:
        return json.dumps([vars(e) for e in self.events], default=str)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k, e.event_type, e.timestamp, e.node_name, e.step_index, e.duration, e.error, {str(a): str(b) for a, b in e.metadata.items()}) for k, e in enumerate(self.events)]
        return spark.createDataFrame(rows, "seq long, event_type string, timestamp double, node_name string, step_index int, duration double, error string, metadata map<string,string>")

    def to_chrome_trace(self) -> str:
        ids: dict[str, int] = {}
        out = []
        for e in self.events:
            ph = "B" if e.event_type == "node_started" else "E" if e.event_type in ("node_completed", "node_failed", "node_timed_out", "node_cancelled") else None
            if ph and e.node_name:
                out.append({"name": e.node_name, "ph": ph, "ts": int(e.timestamp * 1e6), "pid": 1, "tid": ids.setdefault(e.node_name, len(ids) + 1)})
        return json.dumps(out)


class HookEvent(Enum):
    PRE_EXECUTE = "pre_execute"
    POST_EXECUTE = "post_execute"
    PRE_NODE = "pre_node"
    POST_NODE = "post_node"
    ON_ERROR = "on_error"
    PRE_BUILD = "pre_build"
    POST_BUILD = "post_build"


class HookRegistry:
    """Functions by event, highest priority first; their errors are warnings."""

    def __init__(self):
        self._hooks: dict[HookEvent, list[tuple[int, int, Callable]]] = {}
        self._n = 0

    def register(self, event: HookEvent, fn: Callable, priority: int = 0) -> Callable[[], None]:
        self._n += 1
        row = (-priority, self._n, fn)
        self._hooks.setdefault(event, []).append(row)
        return lambda: self._hooks[event].remove(row)

    def fire(self, event: HookEvent, **context) -> None:
        for _, _, fn in sorted(self._hooks.get(event, []), key=lambda r: r[:2]):
            try:
                fn({"event": event, **context})
            except Exception as e:  # noqa: BLE001
                warnings.warn(f"hook {event.value}: {e!r}", RuntimeWarning, stacklevel=2)


class Plugin:
    """Base of plugins; ``initialize`` gets the hook registry."""

    name = "plugin"

    def initialize(self, hooks: HookRegistry) -> None: ...

    def teardown(self) -> None: ...


class _Registry:
    """Things by name; a later one replaces an earlier one of its name."""

    def __init__(self):
        self._known: dict[str, object] = {}

    def get(self, name: str):
        return self._known.get(name)

    @property
    def names(self) -> list[str]:
        return list(self._known)

    def _need(self, name: str):
        if name not in self._known:
            raise KeyError(f"{type(self).__name__} has no {name!r}")
        return self._known[name]


class SerializerRegistry(_Registry):
    """Pairs (write, read) by format."""

    def register(self, name: str, write: Callable, read: Callable) -> None:
        self._known[name] = (write, read)

    def dump(self, name: str, value: object) -> object:
        return self._need(name)[0](value)

    def load(self, name: str, data: object) -> object:
        return self._need(name)[1](data)


class ExecutorRegistry(_Registry):
    """Executor classes by name; ``make`` builds one for a graph."""

    def register(self, name: str, kind: type) -> None:
        self._known[name] = kind

    def make(self, name: str, dag, **options):
        return self._need(name)(dag, **options)


class NodeTypeRegistry(_Registry):
    """Factories (node name, metadata) -> task by type."""

    def register(self, name: str, factory: Callable) -> None:
        self._known[name] = factory

    def task(self, kind: str, node: str, metadata: object = None) -> Callable:
        return self._need(kind)(node, metadata)

    def tasks(self, nodes: dict[str, tuple[str, object]]) -> dict[str, Callable]:
        """Tasks of nodes given as name -> (type, metadata), for an executor."""
        return {n: self.task(kind, n, meta) for n, (kind, meta) in nodes.items()}


class PluginManager:
    """Plugins of this process and of an entry-point group; one that fails doesn't stop the others."""

    def __init__(self, group: str = "arbora.plugins"):
        self.group, self.hooks, self.plugins = group, HookRegistry(), {}
        self.serializers, self.executors, self.node_types = SerializerRegistry(), ExecutorRegistry(), NodeTypeRegistry()

    def add(self, plugin: Plugin) -> None:
        self.plugins[plugin.name] = plugin

    def discover(self) -> list[str]:
        from importlib.metadata import entry_points

        for ep in entry_points(group=self.group):
            try:
                self.add(ep.load()())
            except Exception as e:  # noqa: BLE001
                warnings.warn(f"plugin {ep.name}: {e!r}", RuntimeWarning, stacklevel=2)
        return sorted(self.plugins)

    def _each(self, call: Callable[[Plugin], None]) -> None:
        for p in self.plugins.values():
            try:
                call(p)
            except Exception as e:  # noqa: BLE001
                warnings.warn(f"plugin {p.name}: {e!r}", RuntimeWarning, stacklevel=2)

    def initialize(self) -> None:
        self._each(lambda p: p.initialize(self.hooks))

    def teardown(self) -> None:
        self._each(lambda p: p.teardown())


#: The manager that ``plugin`` registers with.
manager = PluginManager()


def plugin(kind: type) -> type:
    """Class decorator: an instance joins the process's plugin manager."""
    if not (isinstance(kind, type) and issubclass(kind, Plugin)):
        raise TypeError(f"{kind!r} is not a Plugin class")
    manager.add(kind())
    return kind
