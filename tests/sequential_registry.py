"""Plain single-process model of the registry rules, used only to check the Spark fold."""

import json

ALLOWED = {
    "tentative": {"tentative", "confirmed", "cancelled"},
    "confirmed": {"confirmed", "occluded", "exited"},
    "occluded": {"occluded", "confirmed", "exited"},
    "exited": set(),
    "cancelled": set(),
}


class Refused(Exception):
    def __init__(self, kind):
        super().__init__(kind)
        self.kind = kind


class Registry:
    def __init__(self):
        self.beans, self.ids, self.journal = {}, {}, []

    def _seen(self, event_id, ref, content):
        if event_id in self.ids:
            if self.ids[event_id] != (ref, content):
                raise Refused("conflict")
            return True
        return False

    def _commit(self, ref, event_id, content, kind, ts):
        bean = self.beans[ref]
        bean["revision"] += 1
        bean["updated"] = ts if bean["updated"] is None else max(bean["updated"], ts)
        self.ids[event_id] = (ref, content)
        self.journal.append((event_id, kind, *ref, bean["revision"]))
        return "applied"

    def update(self, track, event_id):
        ref = (track["bean_ref"]["run_id"], track["bean_ref"]["sequence"])
        if not ref[0].strip() or ref[1] <= 0:
            raise Refused("conflict")
        content = "track" + json.dumps(track, sort_keys=True)
        if self._seen(event_id, ref, content):
            return "duplicate"
        bean = self.beans.get(ref)
        status, ts = track["status"], track["timestamp_ns"]
        if bean is None:
            kind = "bean.created"
        else:
            if ts < bean["track_ts"]:
                raise Refused("stale")
            if status not in ALLOWED[bean["status"]]:
                raise Refused("conflict")
            kind = {
                "exited": "bean.exited", "cancelled": "bean.cancelled",
            }.get(status, "track.updated")
            if bean["status"] == "tentative" and status == "confirmed":
                kind = "bean.confirmed"
        if bean is None:
            self.beans[ref] = {
                "revision": 0, "updated": None, "results": {}, "decision": None,
            }
        self.beans[ref] = {**self.beans[ref], "status": status, "track_ts": ts}
        return self._commit(ref, event_id, content, kind, ts)

    def enrich(self, ref, e, event_id):
        if not e["source"].strip() or not e["kind"].strip() or e["timestamp_ns"] < 0:
            raise Refused("conflict")
        if e.get("confidence") is not None and not 0 <= e["confidence"] <= 1:
            raise Refused("conflict")
        content = "enrich" + json.dumps(e, sort_keys=True)
        if self._seen(event_id, ref, content):
            return "duplicate"
        if ref not in self.beans:
            raise Refused("not_found")
        known = self.beans[ref]["results"].get(e["result_id"])
        if known is not None:
            if known != content:
                raise Refused("conflict")
            return "noop"
        self.beans[ref]["results"] = {**self.beans[ref]["results"], e["result_id"]: content}
        return self._commit(ref, event_id, content, "enrichment.added", e["timestamp_ns"])

    def decide(self, ref, d, event_id):
        if d["actuation_timestamp_ns"] < d["timestamp_ns"] or d["timestamp_ns"] < 0:
            raise Refused("conflict")
        if len(set(d["gate_indices"])) != len(d["gate_indices"]):
            raise Refused("conflict")
        content = "decide" + json.dumps(d, sort_keys=True)
        if self._seen(event_id, ref, content):
            return "duplicate"
        if ref not in self.beans:
            raise Refused("not_found")
        current = self.beans[ref]["decision"]
        if current is not None:
            if current["d"]["decision_id"] == d["decision_id"]:
                if current["d"] != d or current["ack"] is not None:
                    raise Refused("conflict")
                return "noop"
            if current["ack"] is not None:
                raise Refused("conflict")
        self.beans[ref]["decision"] = {"d": d, "ack": None}
        return self._commit(ref, event_id, content, "sorting.decision", d["timestamp_ns"])

    def acknowledge(self, ref, decision_id, ts, event_id):
        content = f"ack{decision_id}/{ts}"
        if self._seen(event_id, ref, content):
            return "duplicate"
        if ref not in self.beans:
            raise Refused("not_found")
        current = self.beans[ref]["decision"]
        if current is None or current["d"]["decision_id"] != decision_id:
            raise Refused("conflict")
        if ts < current["d"]["timestamp_ns"]:
            raise Refused("stale")
        if current["ack"] is not None:
            if current["ack"] != ts:
                raise Refused("conflict")
            return "noop"
        self.beans[ref]["decision"] = {**current, "ack": ts}
        return self._commit(ref, event_id, content, "sorting.acknowledged", ts)

    def run(self, command):
        """List of outcomes, one per item; raises nothing."""
        p, request = command["payload"], command["request_id"]
        op = command["operation"]
        event_id = p.get("event_id") or request
        try:
            if op == "update_track":
                return [self.update(p["track"], event_id)]
            if op == "update_tracks":
                return self._batch(p["updates"], request)
            ref = (p["bean_ref"]["run_id"], p["bean_ref"]["sequence"])
            if op == "add_enrichment":
                return [self.enrich(ref, p["enrichment"], event_id)]
            if op == "set_sorting_decision":
                return [self.decide(ref, p["decision"], event_id)]
            return [self.acknowledge(ref, p["decision_id"], p["timestamp_ns"], event_id)]
        except Refused as refused:
            return ["rejected:" + refused.kind]

    def _batch(self, updates, request):
        saved = {ref: dict(bean) for ref, bean in self.beans.items()}
        ids, size = dict(self.ids), len(self.journal)
        done = []
        for i, u in enumerate(updates):
            try:
                done.append(self.update(u["track"], u.get("event_id") or f"{request}#{i}"))
            except Refused as refused:
                self.beans, self.ids = saved, ids
                del self.journal[size:]
                return ["rolled_back" if j != i else "rejected:" + refused.kind for j in range(len(updates))]
        return done
