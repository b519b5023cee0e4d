"""A small status server of runs and gates over HTTP, from the standard library."""

from __future__ import annotations

import json
import queue
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from arbora.runtime.base import ExecutionCallbacks
from arbora.runtime.control import GateController

PAGE = "<!doctype html><title>runs</title><pre id=s></pre><script>const f=()=>fetch('/api/state').then(r=>r.json()).then(j=>s.textContent=JSON.stringify(j,null,1));f();new EventSource('/api/events').onmessage=f</script>"


class Dashboard:
    """/ page, /api/state, /api/events (server-sent, a slow reader is told it lagged), /api/gates/<name>/approve|reject,
    /api/profile (durations, critical path and slack of the run so far; 404 without a graph)."""

    QUEUE = 256

    def __init__(self, gates: GateController | None = None, host: str = "127.0.0.1", port: int = 0, dag=None):
        self.gates, self.status = gates or GateController(), {}
        self.dag, self.started, self.seconds = dag, {}, {}
        self._readers: list[queue.Queue] = []
        board = self

        class Handler(BaseHTTPRequestHandler):
            def _send(self, body: str, kind: str = "application/json", code: int = 200) -> None:
                raw = body.encode()
                self.send_response(code)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(raw)))
                self.end_headers()
                self.wfile.write(raw)

            def do_GET(self) -> None:
                if self.path == "/":
                    self._send(PAGE, "text/html")
                elif self.path == "/api/state":
                    self._send(json.dumps({"nodes": board.status, "gates": board.gates.to_dict()}))
                elif self.path == "/api/profile" and board.dag is not None:
                    self._send(json.dumps(board.profile()))
                elif self.path == "/api/events":
                    self._events()
                else:
                    self._send("{}", code=404)

            def do_POST(self) -> None:
                part = self.path.strip("/").split("/")
                if len(part) == 4 and part[:2] == ["api", "gates"] and part[2] in board.gates.gates and part[3] in ("approve", "reject"):
                    getattr(board.gates, part[3])(part[2])
                    board.publish({"gate": part[2], "status": part[3]})
                    self._send("{}")
                else:
                    self._send("{}", code=404)

            def _events(self) -> None:
                self.send_response(200)
                self.send_header("Content-Type", "text/event-stream")
                self.end_headers()
                q: queue.Queue = queue.Queue(board.QUEUE)
                board._readers.append(q)
                try:
                    while (event := q.get()) is not None:
                        self.wfile.write(f"data: {json.dumps(event)}\n\n".encode())
                        self.wfile.flush()
                except OSError:
                    pass
                finally:
                    board._readers.remove(q)

            def log_message(self, *args) -> None: ...

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.server.daemon_threads = True
        self.port = self.server.server_address[1]
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def publish(self, event: dict) -> None:
        for q in list(self._readers):
            try:
                q.put_nowait(event)
            except queue.Full:
                with q.mutex:
                    q.queue.clear()
                q.put_nowait({"lagged": True})

    def _set(self, name: str, status: str) -> None:
        self.status[name] = status
        if status == "running":
            self.started[name] = time.monotonic()
        elif name in self.started:
            self.seconds[name] = time.monotonic() - self.started[name]
        self.publish({"node": name, "status": status})

    def profile(self) -> dict:
        """Seconds by node, the path that the run can't be shorter than, and how much later each node could end."""
        adj = self.dag.adjacency
        cost = [self.seconds.get(n, 0.0) for n in adj.names]
        down = adj.bottom_levels(cost.__getitem__)
        head = [0.0] * len(cost)
        for i in adj.kahn():
            for j in adj.out[i]:
                head[j] = max(head[j], head[i] + cost[i])
        whole = max(down, default=0.0)
        slack = {n: whole - head[i] - down[i] for i, n in enumerate(adj.names)}
        path, at = [], max(range(len(down)), key=lambda i: (down[i], -adj.place[i]), default=None)
        while at is not None:
            path.append(adj.names[at])
            at = max(adj.out[at], key=lambda i: (down[i], -adj.place[i]), default=None)
        return {"seconds": self.seconds, "makespan": whole, "critical_path": path, "slack": slack}

    def callbacks(self) -> ExecutionCallbacks:
        return ExecutionCallbacks(
            on_start=lambda n: self._set(n, "running"), on_complete=lambda n, v: self._set(n, "completed"), on_failure=lambda n, e: self._set(n, "failed"),
            on_skip=lambda n: self._set(n, "skipped"), on_timeout=lambda n: self._set(n, "timed_out"), on_cancel=lambda n: self._set(n, "cancelled"), on_cache_hit=lambda n, v: self._set(n, "cache_hit"),
        )

    def close(self) -> None:
        for q in list(self._readers):
            q.put(None)
        self.server.shutdown()
        self.server.server_close()
