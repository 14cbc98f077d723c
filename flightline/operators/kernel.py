"""Frame-by-frame tracker state, run inside Spark tasks over sorted segment rows.

Initial covariance, motion and noise never couple x with y, and both axes share one 2x2 covariance
block, so a track carries four state values and three covariance values.
"""

from __future__ import annotations

import hashlib
import math

from ..functions.labels import CANCELLED, CONFIRMED, EXITED, OCCLUDED, TENTATIVE
from ..settings import TrackerSettings
from .assignment import TIE_TOLERANCE, UNMATCHED_COST, assign

# Fixed value: initial velocity standard deviation, mm/s.
BIRTH_VELOCITY_SIGMA = 500.0
# Reasons of rejections beside the margins.
OUTSIDE_BIRTH, CONTINUED = "outside top birth region", "continuation of "
ROW_TRACK, ROW_REJECTION, ROW_SUPPRESSED, ROW_ENTRY, ROW_EXIT = (
    "track", "rejection", "suppressed", "entry", "exit",
)


class Flight:
    """One hypothesis: a published track, or a hidden one that swallows an edge reject."""

    __slots__ = (
        "birth", "x", "y", "vx", "vy", "p_pos", "p_cross", "p_vel", "timestamp_ns",
        "hits", "misses", "status", "bbox", "area", "reason",
    )

    def values(self) -> list:
        return [getattr(self, name) for name in self.__slots__]

    @classmethod
    def restore(cls, values) -> "Flight":
        flight = cls()
        for name, value in zip(cls.__slots__, values):
            setattr(flight, name, value)
        flight.birth, flight.bbox = tuple(flight.birth), tuple(flight.bbox)
        return flight


class FrameTracker:
    """State of one run (or one segment of it); ``step`` consumes the frames in order.

    A detection is ``(det_ord, x_mm, y_mm, bbox, area_px, edge_reason)``. ``step`` returns emitted
    flights with the detection they absorbed, plus rejected detections with their reason.
    """

    def __init__(self, settings: TrackerSettings, top_y_mm: float, bottom_y_mm: float):
        s = settings
        self.gravity = s.gravity_mm_s2
        self.noise = s.process_acceleration_sigma_mm_s2**2
        self.measured = s.measurement_sigma_mm**2
        self.gate = s.association_gate_sigma**2
        self.appearance = s.appearance_weight
        self.confirm_hits = s.confirmation_hits
        self.max_misses = s.maximum_missed_frames
        self.release_y = top_y_mm - s.release_height_above_fov_mm
        self.exit_y = bottom_y_mm + s.exit_margin_mm
        self.birth_limit = top_y_mm + s.birth_zone_depth_mm if s.require_top_birth else math.inf
        self.active: list[Flight] = []
        self.hidden: list[Flight] = []

    def _birth(self, frame_index, timestamp_ns, detection, reason=None) -> Flight:
        det_ord, x, y, bbox, area, _ = detection
        flight = Flight()
        flight.birth = (frame_index, det_ord)
        flight.x, flight.y, flight.vx = x, y, 0.0
        flight.vy = math.sqrt(2.0 * self.gravity * max(0.0, y - self.release_y))
        flight.p_pos, flight.p_cross = 4.0 * self.measured, 0.0
        flight.p_vel = BIRTH_VELOCITY_SIGMA**2
        flight.timestamp_ns = timestamp_ns
        flight.hits, flight.misses = 1, 0
        flight.status = CONFIRMED if self.confirm_hits <= 1 else TENTATIVE
        flight.bbox, flight.area, flight.reason = bbox, area, reason
        return flight

    def _advance(self, flight: Flight, timestamp_ns: int) -> None:
        elapsed = timestamp_ns - flight.timestamp_ns
        if elapsed < 0:
            raise ValueError("frame timestamps must not decrease within a run")
        if elapsed == 0:
            return
        dt = elapsed / 1e9
        half = 0.5 * dt * dt
        flight.x += flight.vx * dt
        flight.y += flight.vy * dt + half * self.gravity
        flight.vy += self.gravity * dt
        cross = flight.p_cross + dt * flight.p_vel
        flight.p_pos += dt * (flight.p_cross + cross) + self.noise * half * half
        flight.p_cross = cross + self.noise * half * dt
        flight.p_vel += self.noise * dt * dt
        flight.timestamp_ns = timestamp_ns

    def _absorb(self, flight: Flight, detection) -> None:
        _, x, y, bbox, area, _ = detection
        total = flight.p_pos + self.measured
        gain, rate = flight.p_pos / total, flight.p_cross / total
        rx, ry = x - flight.x, y - flight.y
        flight.x += gain * rx
        flight.y += gain * ry
        flight.vx += rate * rx
        flight.vy += rate * ry
        # Joseph form on the 2x2 block.
        keep = 1.0 - gain
        cross = flight.p_cross - rate * flight.p_pos
        velocity = flight.p_vel - rate * flight.p_cross - rate * cross
        flight.p_vel = velocity + rate * rate * self.measured
        flight.p_cross = keep * cross + gain * rate * self.measured
        flight.p_pos = keep * keep * flight.p_pos + gain * gain * self.measured
        flight.hits += 1
        flight.misses = 0
        flight.status = CONFIRMED if flight.hits >= self.confirm_hits else TENTATIVE
        flight.bbox, flight.area = bbox, area

    def _candidates(self, flight: Flight, detections) -> dict[int, float]:
        total = flight.p_pos + self.measured
        options = {}
        for index, (_, x, y, _, area, _) in enumerate(detections):
            rx, ry = x - flight.x, y - flight.y
            distance = (rx * rx + ry * ry) / total
            if distance <= self.gate:
                ratio = math.log(max(area, 1) / max(flight.area, 1))
                cost = distance / self.gate + abs(ratio) * self.appearance
                if cost < UNMATCHED_COST:
                    options[index] = cost
        return options

    def _expired(self, flight: Flight) -> bool:
        flight.misses += 1
        if flight.status == CONFIRMED:
            flight.status = OCCLUDED
        return flight.y > self.exit_y or flight.misses > self.max_misses

    def step(self, frame_index, timestamp_ns, detections):
        flights = self.active + self.hidden
        for flight in flights:
            self._advance(flight, timestamp_ns)
        if detections and flights:
            candidates = [self._candidates(flight, detections) for flight in flights]
            pairs = self._match(candidates)
        else:
            pairs = ()
        rejections = []
        absorbed: dict[int, tuple] = {}
        taken = set()
        for track, index in pairs:
            flight, detection = flights[track], detections[index]
            self._absorb(flight, detection)
            absorbed[id(flight)] = detection
            taken.add(index)
            if flight.reason is not None:
                rejections.append((detection, CONTINUED + flight.reason))
        emitted, survivors = [], []
        for flight in self.active:
            detection = absorbed.get(id(flight))
            if detection is None and self._expired(flight):
                flight.status = CANCELLED if flight.hits < self.confirm_hits else EXITED
            else:
                survivors.append(flight)
            emitted.append((flight, detection))
        self.active = survivors
        if self.hidden:
            self.hidden = [
                flight
                for flight in self.hidden
                if id(flight) in absorbed or not self._expired(flight)
            ]
        for index, detection in enumerate(detections):
            if index in taken:
                continue
            if detection[5] is not None:
                rejections.append((detection, detection[5]))
                self.hidden.append(
                    self._birth(frame_index, timestamp_ns, detection, detection[5])
                )
            elif detection[2] > self.birth_limit:
                rejections.append((detection, OUTSIDE_BIRTH))
            else:
                flight = self._birth(frame_index, timestamp_ns, detection)
                self.active.append(flight)
                emitted.append((flight, detection))
        return emitted, rejections

    @staticmethod
    def _match(candidates):
        """Shortcut for unambiguous frames, otherwise the exact solver."""
        used = set()
        pairs = []
        for track, options in enumerate(candidates):
            if not options:
                continue
            if len(options) > 1:
                return assign(candidates)
            (index, cost), = options.items()
            if index in used:
                return assign(candidates)
            used.add(index)
            if cost < UNMATCHED_COST - TIE_TOLERANCE:
                pairs.append((track, index))
        return pairs

    def digest(self) -> str:
        """Digest of everything that influences later frames; equal digests mean equal futures."""
        state = [[f.values() for f in self.active], [f.values() for f in self.hidden]]
        return hashlib.sha256(repr(state).encode()).hexdigest()
