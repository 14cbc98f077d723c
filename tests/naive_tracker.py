"""Independent single-process tracker with full matrices and brute-force assignment."""

import itertools
import math

import numpy as np


class Naive:
    def __init__(self, top=-37.0, bottom=37.0, width=1456, left=50, right=50, hits=2, misses=2,
                 top_birth=True):
        self.top, self.bottom, self.width = top, bottom, width
        self.left, self.right, self.need, self.allow = left, right, hits, misses
        self.top_birth = top_birth
        self.tracks, self.next_id = [], 1

    def _new(self, det, ts, ident, reason=None):
        x, y = det["pos"]
        vy = math.sqrt(2 * 9810.0 * max(0.0, y - (self.top - 20.0)))
        r = 0.22**2
        return {
            "id": ident, "s": np.array([x, y, 0.0, vy]), "P": np.diag([4 * r, 4 * r, 25e4, 25e4]),
            "ts": ts, "hits": 1, "miss": 0, "area": det["area"], "reason": reason,
            "status": "confirmed" if self.need <= 1 else "tentative",
        }

    def frame(self, ts, dets):
        H = np.eye(2, 4)
        R = np.eye(2) * 0.22**2
        for t in self.tracks:
            dt = (ts - t["ts"]) / 1e9
            F = np.eye(4)
            F[0, 2] = F[1, 3] = dt
            B = np.array([[dt * dt / 2, 0], [0, dt * dt / 2], [dt, 0], [0, dt]])
            t["s"] = F @ t["s"] + B @ np.array([0, 9810.0])
            t["P"] = F @ t["P"] @ F.T + 2500.0**2 * B @ B.T
            t["ts"] = ts
        order = [t for t in self.tracks if t["reason"] is None] + [
            t for t in self.tracks if t["reason"] is not None
        ]
        cost = np.full((len(order), len(dets)), np.inf)
        for i, t in enumerate(order):
            S = H @ t["P"] @ H.T + R
            for j, d in enumerate(dets):
                v = np.array(d["pos"]) - t["s"][:2]
                d2 = v @ np.linalg.inv(S) @ v
                if d2 <= 25:
                    c = d2 / 25 + 0.18 * abs(math.log(max(d["area"], 1) / max(t["area"], 1)))
                    if c < 1:
                        cost[i, j] = c
        best, choice = math.inf, ()
        options = [[None] + [j for j in range(len(dets)) if cost[i, j] < 1] for i in range(len(order))]
        for pick in itertools.product(*options):
            used = [j for j in pick if j is not None]
            if len(set(used)) != len(used):
                continue
            total = sum(1.0 if j is None else cost[i, j] for i, j in enumerate(pick))
            if total < best - 1e-12:
                best, choice = total, pick
        rejected, shown, gone, taken = [], [], set(), set()
        for i, t in enumerate(order):
            j = choice[i] if choice else None
            if j is not None:
                d = dets[j]
                S = H @ t["P"] @ H.T + R
                K = t["P"] @ H.T @ np.linalg.inv(S)
                t["s"] = t["s"] + K @ (np.array(d["pos"]) - H @ t["s"])
                M = np.eye(4) - K @ H
                t["P"] = M @ t["P"] @ M.T + K @ R @ K.T
                t["hits"] += 1
                t["miss"], t["area"] = 0, d["area"]
                t["status"] = "confirmed" if t["hits"] >= self.need else "tentative"
                taken.add(j)
                if t["reason"] is not None:
                    rejected.append((j, "continuation of " + t["reason"]))
            else:
                t["miss"] += 1
                if t["status"] == "confirmed":
                    t["status"] = "occluded"
                if t["s"][1] > self.bottom + 8 or t["miss"] > self.allow:
                    gone.add(id(t))
                    t["status"] = "cancelled" if t["hits"] < self.need else "exited"
        shown = [t for t in order if t["reason"] is None]
        for j, d in enumerate(dets):
            if j in taken:
                continue
            x, w = d["box"]
            lo, hi = x < self.left, x + w > self.width - self.right
            if lo or hi:
                reason = {(1, 1): "left and right birth margins", (1, 0): "left birth margin",
                          (0, 1): "right birth margin"}[(int(lo), int(hi))]
                rejected.append((j, reason))
                self.tracks.append(self._new(d, ts, None, reason))
            elif self.top_birth and d["pos"][1] > self.top + 26:
                rejected.append((j, "outside top birth region"))
            else:
                t = self._new(d, ts, self.next_id)
                self.next_id += 1
                self.tracks.append(t)
                shown.append(t)
        rows = [
            (t["id"], t["status"], t["hits"], t["miss"], *(round(float(v), 5) for v in t["s"]),
             round(float(t["P"][0, 0]), 6), round(float(t["P"][1, 3]), 4))
            for t in sorted(shown, key=lambda t: t["id"])
        ]
        self.tracks = [t for t in self.tracks if id(t) not in gone]
        return rows, rejected
