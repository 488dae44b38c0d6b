"""Batches of videos through stages: a state document, locks, gates, retries and the final merge.

The driver keeps one small document per batch; the stages themselves are Spark jobs.
Stages are given as functions of (video, batch), so that any of them can be replaced.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
from collections.abc import Callable, Iterator

from rallyline.sinks import atomic_json, now

STAGES = ("register", "main_view", "court", "infer", "validate")
DONE = ("completed", "completed_with_warning")


class Waiting(Exception):
    """A stage that needs a human before it can go on; its text says what to do."""


@contextlib.contextmanager
def exclusive(path: str) -> Iterator[None]:
    """Hold a lock on a file, or fail at once where another holds it."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "a+", encoding="utf-8") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise RuntimeError(f"batch is already running (lock unavailable): {path}") from e
        f.truncate(0)
        f.write(json.dumps({"pid": os.getpid(), "acquired_at": now()}))
        f.flush()
        yield


class Batch:
    """A resumable run of STAGES over videos.

    A stage's function returns its result, kept in the state; it raises ``Waiting`` for a
    human's review. What was completed is not done again, what failed is tried again, and a
    calibration that changed since a video's inference undoes that and the validation, and
    the merge. The inputs and the configuration of a batch cannot change.
    """

    def __init__(self, folder: str, batch_id: str, videos: list[str], stages: dict[str, Callable], merge: Callable, configuration: dict | None = None, calibration: Callable | None = None, rerun_warnings: bool = False) -> None:
        self.folder, self.batch_id, self.videos = folder, batch_id, videos
        self.stages, self.merge, self.configuration = stages, merge, configuration or {}
        self.calibration, self.rerun_warnings = calibration or (lambda video: None), rerun_warnings
        self.path = f"{folder}/batch_state.json"
        self.state = self._load()

    def _load(self) -> dict:
        if not os.path.exists(self.path):
            rows = [{"source_path": p, "status": "pending", "stages": {s: {"status": "pending", "attempts": 0} for s in STAGES}} for p in self.videos]
            return {"batch_id": self.batch_id, "status": "pending", "created_at": now(), "configuration": self.configuration, "videos": rows, "merge": {"status": "pending", "attempts": 0}}
        with open(self.path, encoding="utf-8") as f:
            state = json.load(f)
        for what, have, want in (("batch_id", state["batch_id"], self.batch_id), ("input video list", [v["source_path"] for v in state["videos"]], self.videos), ("batch configuration", state["configuration"], self.configuration)):
            if have != want:
                raise ValueError(f"{what} differs from the existing batch state: {self.path}")
        return state

    def save(self) -> None:
        self.state["updated_at"] = now()
        atomic_json(self.state, self.path)

    def _stage(self, video: dict, name: str) -> None:
        s = video["stages"][name]
        s.update(status="running", attempts=s["attempts"] + 1, started_at=now())
        s.pop("error", None)
        video["status"] = "running"
        self.save()
        result = self.stages[name](video, self)
        s.update(status="completed", completed_at=now(), result=result)
        self.save()

    def _stale(self, video: dict) -> bool:
        used = (video["stages"]["infer"].get("result") or {}).get("calibration")
        current = self.calibration(video)
        return used is not None and current is not None and used != current

    def _video(self, video: dict) -> None:
        if self._stale(video):
            for name in ("infer", "validate"):
                video["stages"][name] = {"status": "pending", "attempts": 0}
            self.state["merge"] = {"status": "pending", "attempts": 0}
        check = self.stages.get("recheck")
        if check and video["stages"]["register"]["status"] == "completed":
            check(video, self)
        again = self.rerun_warnings and video.get("quality_status") == "warning"
        for name in STAGES:
            if video["stages"][name]["status"] != "completed" or (again and name == "validate"):
                self._stage(video, name)
        result = video["stages"]["validate"]["result"] or {}
        video["quality_status"], video["quality_warnings"] = result.get("quality_status", "unknown"), result.get("warnings", [])
        video["status"] = "completed" if video["quality_status"] == "ok" else "completed_with_warning"
        for k in ("failed_stage", "error"):
            video.pop(k, None)

    def counts(self) -> dict[str, int]:
        kept = [v["status"] for v in self.state["videos"] if v["status"] != "excluded_source_variant"]
        n = lambda *names: sum(s in names for s in kept)
        return {
            "total": len(self.state["videos"]), "processable_total": len(kept), "completed": n(*DONE), "warnings": n("completed_with_warning"), "waiting_review": n("waiting_court_review"), "failed": n("failed"),
            "pending": len(kept) - n(*DONE, "waiting_court_review", "failed"), "excluded": len(self.state["videos"]) - len(kept),
        }

    def run(self) -> dict:
        """Go on with the batch under its lock; the state's status says how it stands."""
        with exclusive(f"{self.folder}/batch.lock"):
            self.state["status"] = "running"
            for video in self.state["videos"]:
                settled = video["status"] == "completed" or (video["status"] == "completed_with_warning" and not self.rerun_warnings)
                if video["status"] == "excluded_source_variant" or (settled and not self._stale(video)):
                    continue
                try:
                    self._video(video)
                except Waiting as e:
                    name = next(s for s in STAGES if video["stages"][s]["status"] == "running")
                    video["stages"][name].update(status="waiting_review", review=str(e))
                    video["status"] = "waiting_court_review"
                except (OSError, ValueError, RuntimeError) as e:
                    name = next((s for s in STAGES if video["stages"][s]["status"] != "completed"), STAGES[0])
                    video["stages"][name].update(status="failed", failed_at=now(), error=f"{type(e).__name__}: {e}")
                    video.update(status="failed", failed_stage=name, error=f"{type(e).__name__}: {e}")
                self.save()
            self._finish()
            self.save()
        return self.state

    def _finish(self) -> None:
        n, merge = self.counts(), self.state["merge"]
        if n["processable_total"] and n["completed"] == n["processable_total"]:
            try:
                if merge["status"] != "completed":
                    merge.update(status="running", attempts=merge["attempts"] + 1)
                    self.save()
                    merge.update(status="completed", completed_at=now(), result=self.merge([v for v in self.state["videos"] if v["status"] in DONE], self))
                self.state["status"] = "completed_with_warning" if n["warnings"] else "completed"
            except (OSError, ValueError, RuntimeError) as e:
                merge.update(status="failed", error=f"{type(e).__name__}: {e}")
                self.state["status"] = "failed"
        elif n["waiting_review"] and not n["failed"]:
            self.state["status"] = "waiting_court_review"
        else:
            self.state["status"] = "partial_failure" if n["failed"] else "incomplete"
        self.state["counts"] = n


def reusable(metadata: dict | None, source: str, manifest: str | None, rows: int) -> bool:
    """Whether raw inference can be used again: same input, same segments, as many rows as were processed."""
    if not metadata or metadata.get("input") != source or metadata.get("segments_manifest") != manifest:
        return False
    expected = int(metadata.get("processed_frames") or 0)
    return expected > 0 and rows == expected


def frozen(selection, path: str) -> str:
    """Write a selection once, before anything is scored with it, and give its hash; another one later is an error."""
    import hashlib

    body = json.dumps(selection, ensure_ascii=False, indent=2, sort_keys=True) + "\n"
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if f.read() != body:
                raise ValueError(f"a different selection is frozen in {path}")
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(body)
    return hashlib.sha256(body.encode()).hexdigest()


def unchanged(spark, before: dict[str, dict]) -> None:
    """Raise if protected files differ from what ``sinks.artifacts`` said of them."""
    from rallyline import sinks

    wrong = sinks.changed_artifacts(spark, before)
    if wrong:
        raise RuntimeError(f"protected files changed: {wrong}")


def proposal(video_id: str, corners, check: dict, method: str, singles: tuple[float, float] | None = None) -> dict:
    """A court proposal: corners, their check, and whether they seem to follow the singles lines.

    ``singles`` are the line scores of the corners as they are and widened to the doubles lines.
    """
    valid, message, audit = check["valid"], check["message"], None
    if valid and singles is not None:
        outer, widened = singles
        likely = widened >= 0.42 and widened - outer >= 0.06
        audit = {"outer_interpretation_score": round(outer, 4), "expanded_from_singles_score": round(widened, 4), "expanded_score_delta": round(widened - outer, 4), "likely_singles_sidelines": likely}
        if likely:
            valid, message = False, "automatic quadrilateral likely follows singles sidelines; review or correct to the 6.1 m doubles boundary"
    return {
        "proposal_version": "court-proposal-v0.1", "video_id": video_id, "method": method, "corners": corners, "validation": {"valid": valid, "area_ratio": check["area_ratio"], "message": message},
        "boundary_audit": audit, "accepted": False, "calibration": None, "created_at": now(),
    }


def accepted(found: dict, version: int, h: list[list[float]]) -> tuple[dict, dict]:
    """A proposal once accepted, and the calibration it becomes; an invalid one can't be."""
    if not found["validation"]["valid"]:
        raise ValueError(f"cannot accept proposal: {found['validation']['message']}")
    record = {"calibration_id": f"cal_{found['video_id']}_v{version}", "video_id": found["video_id"], "version": version, "corners": found["corners"], "homography": h, "court_orientation": "upper_is_far_side", "quality_status": "accepted", "source": found["method"], "created_at": now()}
    return {**found, "accepted": True, "calibration": record["calibration_id"], "accepted_at": now()}, record


def verify(spark, required: list[str], models, folder: str) -> dict:
    """What a copy of a project lacks: missing files and models that differ from their manifest."""
    from rallyline.sources import media

    missing = [p for p in required if not os.path.exists(p)]
    wrong = [f"{r.name}: {r.problem}" for r in media.manifest_problems(spark, models, folder).collect()]
    return {"ok": not missing and not wrong, "missing": missing, "models": wrong}
