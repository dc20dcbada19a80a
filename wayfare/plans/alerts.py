"""Alerts for failed gates. Sending never raises: a dead webhook must not hide the failure itself."""

from __future__ import annotations

import json
import os
import urllib.request
from dataclasses import dataclass, field

from wayfare.operators.gates import GateReport

WEBHOOK = "WAYFARE_ALERT_WEBHOOK"


@dataclass
class Alert:
    stage: str
    batch_id: str
    failures: list[str] = field(default_factory=list)
    loaded: bool = False
    note: str = ""

    def title(self) -> str:
        return f"{self.stage} stopped for batch {self.batch_id}"

    def to_text(self) -> str:
        moved = "Data was loaded before the failure." if self.loaded else "Nothing was loaded."
        return "\n".join([self.title(), *[f"- {f}" for f in self.failures], moved, *([self.note] if self.note else [])])

    def to_payload(self) -> dict:
        return {"title": self.title(), "text": self.to_text(), "stage": self.stage, "batch_id": self.batch_id, "failures": self.failures, "loaded": self.loaded}


def send(alert: Alert, webhook: str | None = None, timeout: float = 10.0) -> bool:
    """Print the alert, and post it if a webhook is set; True if that was accepted (2xx)."""
    print(alert.to_text(), flush=True)
    url = webhook or os.environ.get(WEBHOOK)
    if not url:
        return False
    try:
        request = urllib.request.Request(url, json.dumps(alert.to_payload()).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return 200 <= reply.status < 300
    except Exception as e:  # whatever it is, it must not replace the gate's own failure
        print(f"alert not delivered: {e}", flush=True)
        return False


def from_report(stage: str, batch_id: str, report: GateReport) -> Alert | None:
    """None if no blocking gate failed."""
    failed = [f"{v['gate']}: observed {v['observed']}, expected {v['expected']}" for v in report.blocking_failures]
    return Alert(stage, batch_id, failed) if failed else None


def failure_callback(context: dict | None) -> bool:
    """For schedulers that call back with a context when a task fails, whatever the context lacks."""
    context = context or {}
    task = getattr(context.get("task_instance"), "task_id", "task")
    error = context.get("exception")
    return send(Alert(str(task), str(context.get("run_id", "unknown")), [f"{type(error).__name__}: {error}"] if error else [], note="Failed outside a gate."))
