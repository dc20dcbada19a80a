"""Seeded synthetic producers: trips with the faults that real ones have, and a change stream."""

from __future__ import annotations

import json
import random
from dataclasses import dataclass
from datetime import datetime, timedelta

#: Stores and their pace (median minutes from assignment to delivery).
STORES = {"HARBOUR": 52.0, "ORCHARD": 46.0}
PROMISE_MINUTES = 45


@dataclass(frozen=True)
class Faults:
    duplicates: float = 0.05
    corrections: float = 0.02
    late: float = 0.03
    second_producer: float = 0.3
    null_driver: float = 0.01
    broken: float = 0.004
    cancelled: float = 0.03
    newer_schema: float = 0.2
    undeclared: float = 0.03


def events(trips: int, days: int, seed: int, start: datetime = datetime(2026, 9, 1), faults: Faults = Faults()) -> list[str]:
    """JSON lines; the same arguments give the same lines. The promise is blind to the store."""
    rng, out = random.Random(seed), []
    for t in range(trips):
        store = rng.choice(sorted(STORES))
        at = start + timedelta(days=rng.randrange(days), minutes=rng.uniform(8 * 60, 20 * 60))
        whole = rng.lognormvariate(0, 0.25) * STORES[store]
        steps = [("assigned", 0.0), ("reached_pickup", 0.15), ("picked_up", 0.3), ("out_for_delivery", 0.35), ("reached_delivery", 0.95), ("delivered", 1.0)]
        if rng.random() < faults.cancelled:
            steps = [*steps[: rng.randrange(1, 5)], ("cancelled", 0.9)]
        elif rng.random() < faults.broken:
            steps = [(k, 0.05 if k == "delivered" else s) for k, s in steps]
        second, newer = rng.random() < faults.second_producer, rng.random() < faults.newer_schema
        driver = None if rng.random() < faults.null_driver else f"D-{rng.randrange(48):03d}"
        for kind, share in steps:
            ts = at + timedelta(minutes=whole * share)
            body = {
                "event_id": f"{rng.getrandbits(64):016x}", "trip_id": f"T-{t:06d}", "event_type": kind.upper() if second else kind,
                "event_ts": ts.isoformat() + "Z" if second else ts.strftime("%Y-%m-%d %H:%M:%S"), "order_id": f"O-{t:06d}", "driver_id": driver, "store_id": store,
                "lat": 12.9 + rng.random() / 10, "lon": 77.5 + rng.random() / 10, "distance_m": rng.randrange(500, 9000), "promised_minutes": PROMISE_MINUTES,
                "producer_version": "v2" if second else "v1", "schema_version": "1.1.0" if newer else "1.0.0",
            }
            if newer:
                body |= {"vehicle_type": rng.choice(["bike", "van"]), "battery_pct": rng.randrange(5, 100)}
            if rng.random() < faults.undeclared:
                body["road_code"] = rng.randrange(5)
            if rng.random() < faults.late:
                body["_delay_hours"] = rng.randrange(24, 60)
            out.append(json.dumps(body))
            if rng.random() < faults.duplicates:
                out.append(json.dumps(body))
            if rng.random() < faults.corrections:
                out.append(json.dumps(body | {"event_id": f"{rng.getrandbits(64):016x}", "distance_m": body["distance_m"] + 100, "_delay_hours": 1}))
    rng.shuffle(out)
    return out


def driver_changes(drivers: int, seed: int) -> list[str | None]:
    """A change stream: creates, updates (some out of order), deletes with their tombstones, snapshot reads."""
    rng, out, lsn = random.Random(seed), [], 0

    def message(op: str, driver: int, at: int, snapshot: str = "false") -> str:
        image = {"driver_id": f"D-{driver:03d}", "created_at": "2026-01-01", "trips_total": at, "vehicle": rng.choice(["bike", "van"])}
        side = "before" if op == "d" else "after"
        return json.dumps({"op": op, side: image, "source": {"table": "drivers", "lsn": at, "snapshot": snapshot}, "ts_ms": at * 1000})

    for d in range(drivers):
        lsn += 1
        out.append(message("c", d, lsn))
        if rng.random() < 0.5:
            pair = [message("u", d, lsn + 1), message("u", d, lsn + 2)]
            out += reversed(pair) if rng.random() < 1 / 3 else pair
            lsn += 2
        if rng.random() < 0.1:
            lsn += 1
            out += [message("d", d, lsn), None]
        if rng.random() < 0.2:
            out.append(message("r", d, 1, "true"))
    rng.shuffle(out)
    return out
